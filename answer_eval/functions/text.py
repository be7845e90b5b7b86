"""Column functions for answer text (JVM-side built-ins; only the tag parser, whose
grammar needs an index of closing tags, is an Arrow function).

Every function here takes Columns (or column names) and returns a Column.  Plain
expressions compile into whole-stage codegen; the array helpers built on
higher-order functions (``transform``/``filter``) are evaluated by the JVM without
codegen, still row-local and without any Python round trip.
"""

from __future__ import annotations

import bisect
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

# ---------------------------------------------------------------------------
# Fixed values that must equal the evaluated system's for right results.
# ---------------------------------------------------------------------------
# The closed label domain, in report order.
LABELS = ("True", "False", "Uncertain")
# Sentinel predictions for rows that carry no label.
PRED_ERROR = "ERROR"
PRED_PARSE_ERROR = "PARSE_ERROR"
PRED_EXCEPTION = "EXCEPTION"
# Row outcome statuses.
STATUS_OK = "ok"
STATUS_ERROR_RESPONSE = "error_response"
STATUS_PARSE_ERROR = "parse_error"
STATUS_EXCEPTION = "exception"
# Error texts of graded rows and of failed program runs.
MSG_COULD_NOT_PARSE = "Could not parse answer"
MSG_INVALID_RESULT = "Invalid result type"
MSG_NO_TEXT = "No text in response"
MSG_INVALID_RESPONSE = "Invalid response type: "
MSG_RUN_FAILED = "Execution failed with return code "
# Code fence markers.
FENCE = "```"
PYTHON_FENCE = "```python"
# Default verdict when no usable answer exists.
DEFAULT_LABEL = "Uncertain"

# Python's str.strip() removes every code point for which str.isspace() holds;
# the set is derived from that rule (29 code points on current Python).
PY_WHITESPACE = "".join(ch for ch in map(chr, range(sys.maxunicode + 1)) if ch.isspace())


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# T2 -----------------------------------------------------------------------
def py_strip(c) -> Column:
    """Python ``str.strip()``: trims all Unicode whitespace, not only U+0020."""
    return F.trim(_col(c), F.lit(PY_WHITESPACE))


# T1 -----------------------------------------------------------------------
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    return out[:n]


def tag_pairs(text: str) -> list[tuple[str, str]]:
    """(name, stripped body) of the tags of a text, from left to right, in linear time.

    A tag may begin at any "<"; its name reaches to the next ">".  It is closed by the
    first later "<" whose own name is "/" and that name.  So names are compared, as
    prefix-sum hashes of the code points, with an index of the closing tags, and
    a hit is checked on the text; the scan goes on behind the closing tag."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    opens, ends = np.flatnonzero(points == ord("<")), np.flatnonzero(points == ord(">"))
    to = np.searchsorted(ends, opens)
    opens, to = opens[to < len(ends)], to[to < len(ends)]
    if not len(opens):
        return []
    ends = ends[to]
    n = len(points)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n), out=sums[1:])
    down = _powers(pow(_BASE, -1, 1 << 64), n + 1)

    def name_hash(first, last):
        return (sums[last] - sums[first]) * down[first]

    closing = points[opens + 1] == ord("/")
    where: dict[tuple[int, int], list[int]] = {}
    first, last = opens[closing] + 2, ends[closing]
    for key, size, at in zip(name_hash(first, last).tolist(), (last - first).tolist(), opens[closing].tolist()):
        where.setdefault((key, size), []).append(at)
    out, done = [], 0
    keys = name_hash(opens + 1, ends).tolist()
    for at, end, key in zip(opens.tolist(), ends.tolist(), keys):
        if at < done:
            continue
        found = where.get((key, end - at - 1))
        if not found:
            continue
        k = bisect.bisect_right(found, end)
        if k == len(found):
            continue
        name = text[at + 1:end]
        if text.startswith(name, found[k] + 2):
            out.append((name, text[end + 1:found[k]].strip()))
            done = found[k] + len(name) + 3
    return out


@F.arrow_udf(MapType(StringType(), StringType()))
def _parse_tags(texts: pa.Array) -> pa.Array:
    found = [None if t is None else list(dict(tag_pairs(t)).items()) for t in texts.to_pylist()]
    return pa.array(found, pa.map_(pa.string(), pa.string()))


def parse_tags(c) -> Column:
    """``<name>body</name>`` pairs -> MAP<name, stripped body>.

    The shortest body counts, it may hold newlines and other tags, the closing name must
    equal the opening one (attributes are part of the name), and a repeated name keeps
    its last body.  Whole texts, in time linear in their length.
    """
    return _parse_tags(_col(c))


def tag_value(c, name: str) -> Column:
    """Body of one named tag as parse_tags would return it (NULL when absent)."""
    return F.element_at(parse_tags(c), F.lit(name))


# T3 / F2 ----------------------------------------------------------------------
def split_formulas(c) -> Column:
    """Split on newline, strip each line, drop blank lines; NULL -> empty array."""
    lines = F.transform(F.split(_col(c), "\n"), py_strip)
    return F.coalesce(F.filter(lines, lambda x: x != F.lit("")), F.array().cast("array<string>"))


# T8 -----------------------------------------------------------------------
def extract_fenced(c) -> Column:
    """Code between the first python fence and the next fence; else between the
    first two plain fences; else the text unchanged.  Stripped only when a fence
    was found; a missing closing fence yields the rest of the text."""
    c = _col(c)
    in_python = F.split_part(F.split_part(c, F.lit(PYTHON_FENCE), F.lit(2)), F.lit(FENCE), F.lit(1))
    in_plain = F.split_part(c, F.lit(FENCE), F.lit(2))
    return (
        F.when(c.contains(PYTHON_FENCE), py_strip(in_python))
        .when(c.contains(FENCE), py_strip(in_plain))
        .otherwise(c)
    )


# T9 -----------------------------------------------------------------------
def last_verdict_line(c, default: str | None = DEFAULT_LABEL) -> Column:
    """Last line that, stripped, is exactly (case-sensitive) a label; else default."""
    lines = F.transform(F.split(py_strip(_col(c)), "\n"), py_strip)
    verdicts = F.filter(lines, lambda line: line.isin(*LABELS))
    last = F.try_element_at(verdicts, F.lit(-1))
    return last if default is None else F.coalesce(last, F.lit(default))


# T10 ----------------------------------------------------------------------
def normalise_answer(c) -> Column:
    """Free text -> label, or NULL when no label word occurs.

    Lower-cased containment: any "uncertain" wins; then "true" (also when "false"
    occurs too, and inside "untrue"); then "false".  An exact label is a special
    case of containment, and stripping does not change containment.
    """
    return label_of_lower(F.lower(_col(c)))


def label_of_lower(low: Column) -> Column:
    """``normalise_answer`` of a text that is in lower case already."""
    return (
        F.when(low.contains("uncertain"), F.lit("Uncertain"))
        .when(low.contains("true"), F.lit("True"))
        .when(low.contains("false"), F.lit("False"))
    )


# T13 ----------------------------------------------------------------------
def default_answer(c, mode: str = "direct") -> Column:
    """Replace a missing model answer by the default label.

    ``direct``: NULL or empty text -> Uncertain.  ``code``: NULL -> Uncertain.
    """
    c = _col(c)
    if mode == "direct":
        return F.when(c.isNull() | (c == F.lit("")), F.lit(DEFAULT_LABEL)).otherwise(c)
    if mode == "code":
        return F.coalesce(c, F.lit(DEFAULT_LABEL))
    raise ValueError(f"unknown mode {mode!r}; expected 'direct' or 'code'")


# T14 ----------------------------------------------------------------------
def entailment_verdict(neg_check, pos_check) -> Column:
    """Three-valued verdict from two solver outcomes.

    premises AND NOT conclusion unsat -> True; that check sat and premises AND
    conclusion unsat -> False; anything else (incl. unknown) -> Uncertain.
    """
    neg, pos = _col(neg_check), _col(pos_check)
    return (
        F.when(neg == F.lit("unsat"), F.lit("True"))
        .when((neg == F.lit("sat")) & (pos == F.lit("unsat")), F.lit("False"))
        .otherwise(F.lit("Uncertain"))
    )


# T15 ----------------------------------------------------------------------
def epoch_micros(ts) -> Column:
    """Microseconds since epoch; TIMESTAMP_NTZ is read in the session zone (UTC)."""
    return F.unix_micros(_col(ts).cast("timestamp"))


def elapsed_seconds(start, end) -> Column:
    """end - start in seconds as DOUBLE."""
    return (epoch_micros(end) - epoch_micros(start)) / F.lit(1_000_000.0)


# T17 ----------------------------------------------------------------------
def error_text(stderr, returncode) -> Column:
    """Stripped stderr, or the default failure text naming the return code."""
    stripped = py_strip(stderr)
    fallback = F.concat(F.lit(MSG_RUN_FAILED), _col(returncode).cast("string"))
    return F.coalesce(F.nullif(stripped, F.lit("")), fallback)


# T18 / T19 ----------------------------------------------------------------
_INTEGRAL = 2.0 ** 52      # doubles from here on have no fraction


def _decimals(x: Column, digits: int) -> Column:
    """The double's exact value rounded to ``digits`` decimals, ties to even, as text
    (``format_number`` rounds that way; ``bround`` rounds the printed decimal instead)."""
    return F.replace(F.format_number(x, digits), F.lit(","), F.lit(""))


def round_even(c, digits: int = 2) -> Column:
    """Python ``round(x, digits)``: the double nearest to the rounded exact value."""
    x = _col(c).cast("double")
    return F.when(F.abs(x) < _INTEGRAL, _decimals(x, digits).cast("double")).otherwise(x)


def format_fixed(c, digits: int = 2) -> Column:
    """Python ``f"{x:.2f}"`` for |x| below 2**52; NULL stays NULL."""
    return _decimals(_col(c).cast("double"), digits)


def format_percent(c, digits: int = 2) -> Column:
    """Python ``f"{x:.2%}"`` for a ratio in [0, 1]; NULL stays NULL."""
    return F.concat(_decimals(_col(c).cast("double") * F.lit(100.0), digits), F.lit("%"))


def right_align(c, width: int) -> Column:
    """Python ``f"{s:>9s}"``: left-pad to width, never truncate."""
    c = _col(c)
    return F.when(F.length(c) >= F.lit(width), c).otherwise(F.lpad(c, width, " "))


def percent_of(num, den, digits: int = 2) -> Column:
    """``round(num / den * 100, digits)`` with ties to even; 0.0 when den is 0."""
    num, den = _col(num), _col(den)
    ratio = num.cast("double") / den.cast("double")
    return F.when(den > 0, round_even(ratio * F.lit(100.0), digits)).otherwise(F.lit(0.0))
