"""The four column types INT, FLOAT, TEXT and BOOL: literals in, Spark types and text out."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import types as T

from tabulon.errors import SqlError

SPARK_TYPES: dict[str, T.DataType] = {"INT": T.LongType(), "FLOAT": T.DoubleType(), "TEXT": T.StringType(), "BOOL": T.BooleanType()}
#: The accepted spellings of a BOOL, exactly as written.
TRUE_WORDS = ("1", "t", "T", "TRUE", "true", "True")
FALSE_WORDS = ("0", "f", "F", "FALSE", "false", "False")
#: How NULL reads in comparisons of rendered values, and as a key.
NULL_TEXT, NULL_KEY = "<nil>", "NULL"

_INT = re.compile(r"[+-]?[0-9]+\Z")
_FLOAT = re.compile(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\Z")
_SPECIAL = re.compile(r"([+-]?)(inf|infinity|nan)\Z", re.IGNORECASE)


def dialect_type(kind: T.DataType) -> str | None:
    """The dialect's name of a Spark type; None where it has none."""
    if isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return "INT"
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return "FLOAT"
    if isinstance(kind, T.StringType):
        return "TEXT"
    if isinstance(kind, T.BooleanType):
        return "BOOL"
    return None


@dataclass(frozen=True)
class Literal:
    """A literal as written: its text without quotes, and whether it had any. Bound parameters carry a value."""

    text: str
    quoted: bool = False
    bound: bool = False
    value: Any = None

    @property
    def is_null(self) -> bool:
        return self.bound and self.value is None or not self.bound and not self.quoted and self.text.upper() == "NULL"


@dataclass(frozen=True)
class Mismatch:
    """A literal that is no value of the column's type; it compares as its text."""

    text: str


def parse_text(text: str, kind: str) -> Any:
    """The value that a text spells in a type. ValueError where it spells none."""
    if kind == "TEXT":
        return text
    if kind == "INT":
        if _INT.match(text):
            value = int(text)
            if -(1 << 63) <= value < 1 << 63:
                return value
        raise ValueError(f"not an INT: {text}")
    if kind == "FLOAT":
        if _FLOAT.match(text):
            value = float(text)
            if math.isinf(value):
                raise ValueError(f"out of range: {text}")
            return value
        if _SPECIAL.match(text):
            return float(text)
        raise ValueError(f"not a FLOAT: {text}")
    if text in TRUE_WORDS:
        return True
    if text in FALSE_WORDS:
        return False
    raise ValueError(f"not a BOOL: {text}")


def fits(value: Any, kind: str) -> Any:
    """A bound Python value as a value of a type. ValueError where it isn't one."""
    if kind == "BOOL" and isinstance(value, bool):
        return value
    if kind == "INT" and isinstance(value, int) and not isinstance(value, bool) and -(1 << 63) <= value < 1 << 63:
        return value
    if kind == "FLOAT" and isinstance(value, (int, float)) and not isinstance(value, bool):
        return float(value)
    return parse_text(render(value), kind)


def stored(literal: Literal, kind: str) -> Any:
    """A literal of VALUES or SET as a value to store; a quoted one fits TEXT alone."""
    try:
        if literal.is_null:
            return None
        if literal.bound:
            return fits(literal.value, kind)
        if literal.quoted and kind != "TEXT":
            raise ValueError(f"not a {kind}: '{literal.text}'")
        return parse_text(literal.text, kind)
    except ValueError as e:
        raise SqlError(f"type mismatch: {e}") from None


def compared(literal: Literal, kind: str) -> Any:
    """A literal of a predicate: a value, None for NULL (in quotes too), or a Mismatch."""
    if literal.bound:
        if literal.value is None:
            return None
        try:
            return fits(literal.value, kind)
        except ValueError:
            return Mismatch(render(literal.value))
    if literal.text.upper() == "NULL":
        return None
    try:
        return parse_text(literal.text, kind)
    except ValueError:
        return Mismatch(literal.text)


def render(value: Any) -> str:
    """A value as text."""
    if value is None:
        return NULL_KEY
    if isinstance(value, bool):
        return "true" if value else "false"
    return str(value)
