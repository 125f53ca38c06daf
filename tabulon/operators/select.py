"""SELECT as a DataFrame plan."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.errors import SqlError
from tabulon.plans.ast import Aggregate, Select
from tabulon.sources.catalog import SEQ, TableState

from .predicates import predicate, quoted, sort_keys

NUMERIC = ("INT", "FLOAT")


def _check_column(name: str, table: TableState) -> None:
    if name not in table.kinds:
        raise SqlError(f"column not found: {name}")


def aggregate_kind(a: Aggregate, table: TableState) -> str:
    """The type of an aggregate's value, once its column is known to be fit for it."""
    if a.column == "*":
        return "INT"
    _check_column(a.column, table)
    kind = table.kinds[a.column]
    if a.function in ("SUM", "AVG"):
        if kind not in NUMERIC:
            raise SqlError(f"{a.function} requires numeric values")
        return "FLOAT"
    return "INT" if a.function == "COUNT" else kind


def aggregate_column(a: Aggregate) -> Column:
    """Sums and averages run in double precision; a sum of nothing is 0, an average of nothing NULL."""
    if a.function == "COUNT":
        return F.count(F.lit(1)) if a.column == "*" else F.count(quoted(a.column))
    c = quoted(a.column)
    if a.function == "SUM":
        return F.coalesce(F.sum(c.cast("double")), F.lit(0.0))
    if a.function == "AVG":
        return F.avg(c.cast("double"))
    return F.min(c) if a.function == "MIN" else F.max(c)


def _cut(df: DataFrame, q: Select) -> DataFrame:
    if q.offset:
        df = df.offset(q.offset)
    return df.limit(q.limit) if q.limit is not None else df


def _first_files(df: DataFrame, table: TableState, rows: int) -> DataFrame:
    """The part of a scan in insertion order that surely holds its first ``rows`` rows: the first files, as many as it takes.

    Files are read in the order of their paths, four times as many each time, and only their matching rows are counted.
    """
    if not table.from_files:
        return df
    # the two ways in which Spark spells a path without a host
    files = sorted(re.sub(r"^(\w+):///", r"\1:/", f) for f in table.df.inputFiles())
    if any("%" in f for f in files):  # a path whose two spellings may differ
        return df
    many = 1
    while many < len(files):
        part = df.where(F.col(SEQ)["file_path"] <= files[many - 1])
        if part.limit(rows).count() >= rows:
            return part
        many *= 4
    return df


def output_names(q: Select, table: TableState) -> list[str]:
    if q.items == ("*",):
        return table.names
    return [i.name if isinstance(i, Aggregate) else i for i in q.items]


def compile_select(q: Select, table: TableState, ordered: bool = True) -> DataFrame:
    """The plan of a query. Without ``ordered``, rows come in any order where the query names none and cuts none."""
    if q.group_by:
        return _grouped(q, table, ordered)
    if q.order_by is not None and q.order_by not in table.kinds:
        raise SqlError(f"ORDER BY column not found: {q.order_by}")
    if q.aggregates:
        return _aggregated(q, table)
    return _plain(q, table, ordered)


def _filtered(q: Select, table: TableState, ordered: bool) -> DataFrame:
    df = table.rows(ordered)
    return df.where(predicate(q.where, table.kinds)) if q.where is not None else df


def _plain(q: Select, table: TableState, ordered: bool) -> DataFrame:
    names = output_names(q, table)
    for name in names:
        _check_column(name, table)
    cut = q.limit is not None or q.offset > 0
    needs_seq = ordered or cut or q.order_by is not None
    df = _filtered(q, table, needs_seq)
    key = q.order_by
    if q.distinct:
        own = list(dict.fromkeys(names))
        if not needs_seq:
            df = df.select(*map(quoted, own)).distinct()
        else:
            # the first row of each value stands for it, also with its unprojected sort value
            first = [F.min(SEQ).alias(SEQ)]
            if key is not None and key not in own:
                first.append(F.min_by(quoted(key), SEQ).alias(key))
            df = df.groupBy(*map(quoted, own)).agg(*first)
    if needs_seq:
        by = [F.col(SEQ).asc()]
        if key is not None:
            by.insert(0, sort_keys(key, table.kinds[key], q.descending))
        elif q.limit is not None and not q.distinct:
            df = _first_files(df, table, q.offset + q.limit)
        df = _cut(df.orderBy(*by), q)
    return df.select(*(quoted(n).alias(n) for n in names))


def in_order(q: Select) -> bool:
    """Whether a query gives rows of the table, all that fit, in insertion order."""
    return not (q.group_by or q.aggregates or q.distinct or q.order_by or q.offset) and q.limit is None


def rows_in_order(q: Select, table: TableState, names: list[str]) -> DataFrame:
    """The rows of such a query under other names, with the numbers that they have, unsorted."""
    own = output_names(q, table)
    for name in own:
        _check_column(name, table)
    return _filtered(q, table, True).select(*(quoted(n).alias(a) for n, a in zip(own, names)), F.col(SEQ))


def _aggregated(q: Select, table: TableState) -> DataFrame:
    if len(q.items) != 1:
        raise SqlError("invalid aggregate")
    a = q.aggregates[0]
    aggregate_kind(a, table)
    df = _filtered(q, table, False).agg(aggregate_column(a).alias(a.name))
    # one row, which order cannot change and a cut may drop
    return df.limit(0) if q.offset or q.limit == 0 else df


def _grouped(q: Select, table: TableState, ordered: bool) -> DataFrame:
    for name in q.group_by:
        _check_column(name, table)
    for item in q.items:
        if isinstance(item, str) and item not in q.group_by:
            raise SqlError(f"column must appear in GROUP BY: {item}")
    aggregates = list(dict.fromkeys(q.aggregates))
    kinds = {n: table.kinds[n] for n in q.group_by} | {a.name: aggregate_kind(a, table) for a in aggregates}
    cut = q.limit is not None or q.offset > 0
    needs_seq = ordered or cut or q.order_by is not None
    if q.order_by is not None and q.order_by not in kinds:
        raise SqlError(f"ORDER BY column not found: {q.order_by}")
    having = predicate(q.having, kinds, missing="invalid HAVING expression") if q.having is not None else None
    values = [aggregate_column(a).alias(a.name) for a in aggregates]
    if needs_seq:
        values.append(F.min(SEQ).alias(SEQ))
    df = _filtered(q, table, needs_seq)
    keys = [quoted(n) for n in dict.fromkeys(q.group_by)]
    df = df.groupBy(*keys).agg(*values) if values else df.select(*keys).distinct()
    if having is not None:
        df = df.where(having)
    names = output_names(q, table)
    if q.distinct:
        own = list(dict.fromkeys(names))
        if needs_seq:
            first = [F.min(SEQ).alias(SEQ)]
            if q.order_by is not None and q.order_by not in own:
                first.append(F.min_by(quoted(q.order_by), SEQ).alias(q.order_by))
            df = df.groupBy(*map(quoted, own)).agg(*first)
        else:
            df = df.select(*map(quoted, own)).distinct()
    if needs_seq:
        by = [F.col(SEQ).asc()]
        if q.order_by is not None:
            by.insert(0, sort_keys(q.order_by, kinds[q.order_by], q.descending))
        df = _cut(df.orderBy(*by), q)
    return df.select(*(quoted(n).alias(n) for n in names))


def result_kinds(q: Select, table: TableState) -> list[str]:
    """Types of a query's columns."""
    if q.items == ("*",):
        return [c.type for c in table.columns]
    return [aggregate_kind(i, table) if isinstance(i, Aggregate) else table.kinds[i] for i in q.items]
