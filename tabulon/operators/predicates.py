"""Predicates as Catalyst expressions, with the dialect's two-valued logic.

NULL is a value here: it equals itself, differs from all others, and has a place in each type's
order - above all numbers, below false, and as the text <nil> among texts. Every comparison is
written so that its plain part still reaches the Parquet scan.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulon.errors import SqlError
from tabulon.functions.values import NULL_TEXT, Literal, Mismatch, compared, render
from tabulon.plans.ast import Predicate, Term

_ORDERED: dict[str, Callable[[Any, Any], Any]] = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def equal(c: Column, kind: str, value: Any) -> Column:
    if value is None:
        return c.isNull()
    if isinstance(value, Mismatch) or isinstance(value, float) and math.isnan(value):
        return F.lit(False)
    return c == F.lit(value)


def unequal(c: Column, kind: str, value: Any) -> Column:
    if value is None:
        return c.isNotNull()
    if isinstance(value, Mismatch) or isinstance(value, float) and math.isnan(value):
        return F.lit(True)
    return (c != F.lit(value)) | c.isNull()


def ordered(c: Column, kind: str, op: str, value: Any) -> Column:
    """c < value and its kin; where types differ, both sides compare as rendered text."""
    test = _ORDERED[op]
    if kind == "TEXT":
        text = NULL_TEXT if value is None else value.text if isinstance(value, Mismatch) else value
        plain = test(c, F.lit(text))
        return plain | c.isNull() if test(_bytes(NULL_TEXT), _bytes(text)) else plain
    if isinstance(value, Mismatch):
        if kind == "FLOAT":
            raise SqlError("invalid WHERE expression")
        return test(F.coalesce(c.cast("string"), F.lit(NULL_TEXT)), F.lit(value.text))
    if value is None:
        # <nil> is less than any rendered BOOL and greater than any rendered number
        below = kind == "BOOL"
        if op in ("<", ">"):
            return c.isNotNull() if (op == ">") == below else F.lit(False)
        return F.lit(True) if (op == ">=") == below else c.isNull()
    null_fits = op in ("<", "<=") if kind == "BOOL" else op in (">", ">=")
    plain = test(c, F.lit(value))
    return plain | c.isNull() if null_fits else plain


def like(c: Column, kind: str, pattern: str) -> Column:
    """% stands for any text, _ for one character; nothing escapes them. Other types than TEXT never match."""
    if kind != "TEXT":
        return F.lit(False)
    escape = next(chr(i) for i in range(1, 0x110000) if chr(i) not in pattern and chr(i) not in "%_")
    return F.like(c, F.lit(pattern), F.lit(escape))


def term(t: Term, kinds: Mapping[str, str], column: Callable[[str], Column] = quoted, missing: str = "invalid WHERE expression") -> Column:
    """One comparison. ``kinds`` has the columns' types; a column without one is an error."""
    if t.column not in kinds:
        raise SqlError(f"column not found: {t.column}" if missing.startswith("invalid WHERE") else missing)
    c, kind = column(t.column), kinds[t.column]
    if t.op == "like":
        return like(c, kind, _pattern(t.values[0]))
    values = [compared(v, kind) for v in t.values]
    if t.op == "=":
        return equal(c, kind, values[0])
    if t.op == "!=":
        return unequal(c, kind, values[0])
    if t.op == "in":
        plain = [v for v in values if v is not None and not isinstance(v, Mismatch) and not (isinstance(v, float) and math.isnan(v))]
        out = c.isin(plain) if plain else F.lit(False)
        return out | c.isNull() if any(v is None for v in values) else out
    if t.op == "between":
        return ordered(c, kind, ">=", values[0]) & ordered(c, kind, "<=", values[1])
    return ordered(c, kind, t.op, values[0])


def _pattern(literal: Literal) -> str:
    return render(literal.value) if literal.bound else literal.text


def predicate(p: Predicate, kinds: Mapping[str, str], column: Callable[[str], Column] = quoted, missing: str = "invalid WHERE expression") -> Column:
    """All alternatives of a predicate as one condition."""
    out: Column | None = None
    for terms in p.any_of:
        every: Column | None = None
        for t in terms:
            one = term(t, kinds, column, missing)
            every = one if every is None else every & one
        out = every if out is None else out | every
    return out


def sort_keys(name: str, kind: str, descending: bool, column: Callable[[str], Column] = quoted) -> Column:
    """The order of a column with NULL in its place."""
    c = column(name)
    if kind == "TEXT":
        c = F.coalesce(c, F.lit(NULL_TEXT))
        return c.desc() if descending else c.asc()
    if kind == "BOOL":
        return c.desc_nulls_last() if descending else c.asc_nulls_first()
    return c.desc_nulls_first() if descending else c.asc_nulls_last()
