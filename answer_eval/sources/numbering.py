"""Row numbers (W1, per group W4) and the first N rows (L1) without moving more than keys.

Order keys are value expressions, ascending with nulls first (negate a number for the other
direction).  Rows that are equal in all order keys come in the order of a hash of their plain
columns, so a frequent key spreads over many tasks and the order does not depend on how
the input is partitioned.  Rows equal in that hash too are interchangeable.

Both operators read their input more than once, as a scan or a written table allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from answer_eval.session import ensure_checkpoint_dir

KEY = "__order_key"
PIVOTS = 24             # keys compared with every row in one round of a selection


def _columns(order_by) -> list[Column]:
    if isinstance(order_by, (str, Column)):
        order_by = [order_by]
    return [F.col(k) if isinstance(k, str) else k for k in order_by]


def _tie_break(df: DataFrame) -> Column:
    plain = [F.col(f"`{f.name}`") for f in df.schema.fields
             if not isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType, T.VariantType))]
    return F.xxhash64(*plain)


def _key(columns: list[Column]) -> Column:
    """One struct, never null itself: it compares field by field, nulls first, and joins null-safely."""
    return F.struct(*[c.alias(f"k{i}") for i, c in enumerate(columns)])


def _numbered(df: DataFrame, group: list[Column], order: list[Column], col_name: str,
              start: int) -> tuple[DataFrame, DataFrame]:
    """df with its numbers, and the (key, count) rows they come from.

    1. Distinct (group, order, tie) keys with their counts: a partial aggregate, so a frequent
       key is one row.
    2. The keys are range-partitioned, sorted and checkpointed: narrow rows only.  Sums per (range,
       group) are a table of one row per range and group, whose running sum over the
       ranges gives each range's offset; a running sum inside the range gives each key's.
    3. The rows meet their key's first number by an equi-join, the only shuffle that carries
       them; rows of one key are told apart inside the same partitioning.
    """
    ensure_checkpoint_dir(df.sparkSession)
    keyed = df.withColumn(KEY, _key([*group, *order, _tie_break(df)]))
    own = F.struct(F.lit(0).alias("g"), *[F.col(f"{KEY}.k{i}").alias(f"g{i}") for i in range(len(group))])
    frozen = (keyed.select(KEY).groupBy(KEY).agg(F.count(F.lit(1)).alias("_n"))
              .repartitionByRange(KEY).sortWithinPartitions(KEY)
              .withColumn("_rid", F.monotonically_increasing_id())
              .checkpoint(eager=True)
              .withColumn("_range", F.shiftright("_rid", 33)).withColumn("_group", own))
    inside = Window.partitionBy("_range", "_group").orderBy("_rid")
    ranges = frozen.groupBy("_range", "_group").agg(F.sum("_n").alias("_sum"))
    before = Window.partitionBy("_group").orderBy("_range")
    ranges = ranges.select("_range", "_group", (F.sum("_sum").over(before) - F.col("_sum")).alias("_offset"))
    first = frozen.withColumn("_inside", F.sum("_n").over(inside) - F.col("_n")).join(ranges, ["_range", "_group"])
    first = first.select(KEY, (F.col("_offset") + F.col("_inside")).alias("_first"))
    equal = F.row_number().over(Window.partitionBy(KEY).orderBy(F.lit(0)))
    out = keyed.join(first, KEY).withColumn(
        col_name, (F.col("_first") + equal - 1 + F.lit(start)).cast("bigint"))
    return out.drop(KEY, "_first"), frozen


def number_rows(df: DataFrame, order_by, col_name: str = "sample_num", start: int = 1) -> tuple[DataFrame, int]:
    """Dense numbers in ``order_by`` order; returns (df with ``col_name``, row count)."""
    out, keys = _numbered(df, [], _columns(order_by), col_name, start)
    return out, keys.agg(F.sum("_n")).first()[0] or 0


# W1 -----------------------------------------------------------------------
def number_samples(df: DataFrame, order_by, col_name: str = "sample_num", start: int = 1) -> DataFrame:
    """1-based sample numbers in row order (``order_by`` is the order key)."""
    return _numbered(df, [], _columns(order_by), col_name, start)[0]


def number_within(df: DataFrame, group, order_by, col_name: str = "position", start: int = 0) -> DataFrame:
    """``row_number() OVER (PARTITION BY group ORDER BY order_by)`` without a whole group in one
    task: a group's keys span as many ranges as they need."""
    return _numbered(df, _columns(group), _columns(order_by), col_name, start)[0]


# L1 -----------------------------------------------------------------------
def _literal(row, kind: T.StructType) -> Column:
    return F.struct(*[F.lit(row[f.name]).cast(f.dataType).alias(f.name) for f in kind.fields])


def nth_key(keys: DataFrame, n: int) -> tuple[Column, object, int, int] | None:
    """The n-th smallest of ``keys`` (one struct column ``KEY``): (it as a literal, its row, rows before
    it, rows equal to it); None if there are fewer than n rows.

    Each round takes ``PIVOTS`` random rows between the bounds so far and counts, in one pass and
    without a shuffle of rows, how many rows lie before and up to each.  Either a pivot is the n-th
    row's key, or the two around it are the next bounds.  A round leaves about 1 / PIVOTS of the
    rows, so the rounds grow with the logarithm of their number; a frequent key ends it early."""
    kind = keys.schema[KEY].dataType
    left, before = keys, 0                     # rows between the bounds; rows before them
    while True:
        pivots = left.orderBy(F.rand()).limit(PIVOTS).distinct().orderBy(KEY).collect()
        if not pivots:
            return None
        literals = [_literal(r[KEY], kind) for r in pivots]
        counts = left.agg(
            F.count(F.lit(1)),
            *[F.count_if(F.col(KEY) < p) for p in literals], *[F.count_if(F.col(KEY) == p) for p in literals]).first()
        total, less, equal = counts[0], counts[1:1 + len(pivots)], counts[1 + len(pivots):]
        rank = n - before
        if rank > total:
            return None
        low = None
        for row, p, a, e in zip(pivots, literals, less, equal):
            if rank <= a:                      # before this pivot
                left = left.where(F.col(KEY) < p)
                break
            if rank <= a + e:
                return p, row[KEY], before + a, e
            low = (p, a + e)
        if low is not None:
            left, before = left.where(F.col(KEY) > low[0]), before + low[1]


def first_n(df: DataFrame, n: int | None, order_by) -> DataFrame:
    """pandas ``head(n)`` semantics after a full read.

    None or 0 -> all rows; n > 0 -> first n in order; n < 0 -> all but the last |n|.  The n-th key is
    selected on the keys alone (``nth_key``); the result is a filter on it, whose part on the
    first order key reaches the scan.  No row is shuffled, sorted or checkpointed, but for a
    ``limit`` among rows that equal the n-th in all plain columns, if it cuts through them."""
    if not n:
        return df
    columns = _columns(order_by)
    if n < 0:
        n += df.count()
    if n <= 0:
        return df.limit(0)
    keyed = df.withColumn(KEY, _key(columns))
    found = nth_key(keyed.select(KEY), n)
    if found is None:
        return df
    bound, row, before, equal = found
    near = columns[0].isNull() if row["k0"] is None else columns[0].isNull() | (columns[0] <= F.lit(row["k0"]))
    near_rows = keyed.where(near)
    if before + equal == n:
        return near_rows.where(F.col(KEY) <= bound).drop(KEY)
    out = near_rows.where(F.col(KEY) < bound).drop(KEY)
    ties = near_rows.where(F.col(KEY) == bound).drop(KEY)
    ties = ties.withColumn(KEY, _key([_tie_break(ties)]))
    last, _, first, same = nth_key(ties.select(KEY), n - before)
    if first + same == n - before:
        return out.union(ties.where(F.col(KEY) <= last).drop(KEY))
    return out.union(ties.where(F.col(KEY) < last).drop(KEY)) \
        .union(ties.where(F.col(KEY) == last).drop(KEY).limit(n - before - first))
