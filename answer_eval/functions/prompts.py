"""Prompt and message-list columns (T4-T7).

Templates are plain strings with ``{name}`` slots.  A template is split once on the
driver into literal pieces and slot names and rendered per row with ``concat``:
the per-row work is JVM-side.  The default wording is our own.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Missing values render the way a pandas-read CSV renders them in an f-string.
NA_TEXT = "nan"

DIRECT_TEMPLATE = (
    "STATEMENTS\n{premises}\n\n"
    "CLAIM\n{conclusion}\n\n"
    "Judge the claim by the statements alone and output a single label: True where it must "
    "hold, False where it can not hold, Uncertain where it may or may not."
)

FORMALISE_TEMPLATE = (
    "Statements to formalise:\n{premises}\n"
    "Claim to formalise:\n{conclusion}\n\n"
    "Use first-order formulas, the same predicate for the same notion throughout, and a line "
    "for each formula. Your output has two sections and no other text. The section headed "
    "PREMISES-FOL: holds the statements' formulas in their order, the section headed "
    "CONCLUSION-FOL: holds the claim's formula."
)

DIRECT_SYSTEM = (
    "You judge whether a conclusion follows from premises. Reason step by step, "
    "then give the final verdict alone on the last line: True, False, or Uncertain."
)

CODEGEN_SYSTEM = (
    "You write a self-contained Python program that decides whether a conclusion "
    "follows from premises with an SMT solver and prints exactly one of True, "
    "False, Uncertain as its last output line."
)

CODEGEN_SUFFIX = "Write the complete program:"

REPAIR_SYSTEM = (
    "The program you wrote earlier failed. Fix it using the error message and "
    "return only the corrected, complete program."
)

REPAIR_TEMPLATE = (
    "An earlier run ended with this message:\n{error}\n\n"
    "It ran this source:\n```python\n{code}\n```\n\n"
    "It was meant to solve:\n{problem}\n\n"
    "Send the whole source again with the fault removed."
)

_SLOT = re.compile(r"\{(\w+)\}")


def render(template: str, na_text: str | None = NA_TEXT, **slots) -> Column:
    """Render ``template`` per row; each ``{name}`` takes the column ``slots[name]``.

    NULL slot values print as ``na_text`` (``None`` keeps NULL -> NULL result).
    """
    parts: list[Column] = []
    pos = 0
    for m in _SLOT.finditer(template):
        if m.start() > pos:
            parts.append(F.lit(template[pos:m.start()]))
        name = m.group(1)
        if name not in slots:
            raise KeyError(f"template slot {{{name}}} has no column")
        value = slots[name]
        value = F.col(value) if isinstance(value, str) else value
        value = value.cast("string")
        parts.append(value if na_text is None else F.coalesce(value, F.lit(na_text)))
        pos = m.end()
    if pos < len(template):
        parts.append(F.lit(template[pos:]))
    return F.concat(*parts) if parts else F.lit("")


# T4 -----------------------------------------------------------------------
def direct_prompt(premises="premises", conclusion="conclusion",
                  template: str = DIRECT_TEMPLATE) -> Column:
    """Prompt asking for one label."""
    return render(template, premises=premises, conclusion=conclusion)


# T5 -----------------------------------------------------------------------
def formalise_prompt(premises="premises", conclusion="conclusion",
                     template: str = FORMALISE_TEMPLATE) -> Column:
    """Prompt asking for formulas in two named blocks."""
    return render(template, premises=premises, conclusion=conclusion)


def message(role: str, content) -> Column:
    content = F.col(content) if isinstance(content, str) else content
    return F.struct(F.lit(role).alias("role"), content.cast("string").alias("content"))


# T6 -----------------------------------------------------------------------
def chat_messages(user, system: str = DIRECT_SYSTEM) -> Column:
    """``[system, user]`` message list."""
    return F.array(message("system", F.lit(system)), message("user", user))


# T7 -----------------------------------------------------------------------
def codegen_messages(problem_text, system: str = CODEGEN_SYSTEM,
                     suffix: str = CODEGEN_SUFFIX) -> Column:
    """``[system, user]`` where user = problem text + blank line + fixed request."""
    problem_text = F.col(problem_text) if isinstance(problem_text, str) else problem_text
    user = F.concat(problem_text, F.lit("\n\n" + suffix))
    return F.array(message("system", F.lit(system)), message("user", user))
