"""Statements that change the catalog: each derives a new version of a table."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulon.errors import SqlError
from tabulon.functions.values import NULL_KEY, SPARK_TYPES, render, stored
from tabulon.plans import ast
from tabulon.sources.catalog import SEQ, Catalog, TableState, empty_table, schema_of
from tabulon.sources.versions import written_version

from .predicates import quoted, term
from .select import compile_select, in_order, result_kinds, rows_in_order

#: Mutations after which a table's rows are written, so that plans stay short.
STEPS = 8
#: Keys that are looked up by value, which the Parquet scan can skip by; more are joined.
LOOKUP = 1000


@dataclass(frozen=True)
class Change:
    affected: int = 0
    message: str = ""


def apply(catalog: Catalog, node: ast.Statement, spark: SparkSession) -> Change:
    """Runs a statement on the catalog. On an error the catalog is as it was."""
    if isinstance(node, ast.CreateTable):
        if node.table in catalog.tables:
            raise SqlError("table exists")
        catalog.put(empty_table(spark, node.table, node.columns))
        return Change(message="table created")
    if isinstance(node, ast.DropTable):
        if node.table not in catalog.tables:
            if node.if_exists:
                return Change(message="table does not exist")
            raise SqlError("table not found")
        catalog.drop(node.table)
        return Change(message="table dropped")
    table = catalog.table(node.table)
    run = {
        ast.CreateIndex: _create_index,
        ast.DropIndex: _drop_index,
        ast.AddColumn: _add_column,
        ast.DropColumn: _drop_column,
        ast.Truncate: _truncate,
        ast.Insert: lambda t, n: _insert(t, n, catalog),
        ast.Update: _update,
        ast.Delete: _delete,
    }[type(node)]
    state, change = run(table, node)
    if state is not table:
        catalog.put(_shortened(state))
    return change


def _shortened(state: TableState) -> TableState:
    if state.from_files or state.steps < STEPS:
        return state
    return replace(state, df=written_version(state.df, state.name), steps=0)


def _create_index(table: TableState, node: ast.CreateIndex) -> tuple[TableState, Change]:
    if node.column not in table.kinds:
        raise SqlError("column not found")
    if node.column in table.indexes.values():
        raise SqlError("index already exists for column")
    if node.name in table.indexes:
        raise SqlError("index name already exists")
    return replace(table, indexes=table.indexes | {node.name: node.column}), Change(message="index created")


def _drop_index(table: TableState, node: ast.DropIndex) -> tuple[TableState, Change]:
    name = node.name if node.name in table.indexes else next((n for n, c in table.indexes.items() if c == node.name), None)
    if name is None:
        raise SqlError(f"index not found: {node.name}")
    return replace(table, indexes={n: c for n, c in table.indexes.items() if n != name}), Change(message="index dropped")


def _add_column(table: TableState, node: ast.AddColumn) -> tuple[TableState, Change]:
    if node.column.name in table.kinds:
        raise SqlError("column already exists")
    table = table.numbered()
    new = F.lit(None).cast(SPARK_TYPES[node.column.type]).alias(node.column.name)
    rows = table.df.select(*map(quoted, table.names), new, SEQ)
    return replace(table, columns=(*table.columns, node.column), df=rows, steps=table.steps + 1), Change(message="column added")


def _drop_column(table: TableState, node: ast.DropColumn) -> tuple[TableState, Change]:
    if node.column not in table.kinds:
        raise SqlError(f"column not found: {node.column}")
    if len(table.columns) == 1:
        raise SqlError("cannot drop the only column")
    table = table.numbered()
    columns = tuple(c for c in table.columns if c.name != node.column)
    indexes = {n: c for n, c in table.indexes.items() if c != node.column}
    rows = table.df.select(*(quoted(c.name) for c in columns), SEQ)
    return replace(table, columns=columns, df=rows, indexes=indexes, steps=table.steps + 1), Change(message="column dropped")


def _truncate(table: TableState, node: ast.Truncate) -> tuple[TableState, Change]:
    empty = empty_table(table.df.sparkSession, table.name, table.columns)
    return replace(empty, indexes=table.indexes), Change(message="table truncated")


# -- rows


def _where(table: TableState, where: ast.Term | None) -> Column:
    return F.lit(True) if where is None else F.coalesce(term(where, table.kinds), F.lit(False))


def _delete(table: TableState, node: ast.Delete) -> tuple[TableState, Change]:
    hit = _where(table, node.where)
    affected = table.rows(False).where(hit).count()
    if not affected:
        return table, Change()
    table = table.numbered()
    return replace(table, df=table.df.where(~hit), steps=table.steps + 1), Change(affected)


def _update(table: TableState, node: ast.Update) -> tuple[TableState, Change]:
    if node.column not in table.kinds:
        raise SqlError(f"column not found: {node.column}")
    kind = table.kinds[node.column]
    value = stored(node.value, kind)
    hit = _where(table, node.where)
    affected = table.rows(False).where(hit).count()
    if table.primary is not None and node.column == table.primary.name:
        if kind == "TEXT" and value == "":
            raise SqlError("primary key required")
        taken = _has_key(table, [value])
        if affected > 1 or affected and table.rows(False).where(taken & ~hit).limit(1).count():
            raise SqlError("duplicate primary key")
    if not affected:
        return table, Change()
    table = table.numbered()
    new = F.when(hit, F.lit(value).cast(SPARK_TYPES[kind])).otherwise(quoted(node.column))
    rows = table.df.select(*(new.alias(n) if n == node.column else quoted(n) for n in table.names), SEQ)
    return replace(table, df=rows, steps=table.steps + 1), Change(affected)


def _has_key(table: TableState, values: list[Any]) -> Column:
    """Whether a row's key is that of one of these values. A NULL key reads NULL, as a text may."""
    c = quoted(table.primary.name)
    keys = {render(v) for v in values}
    plain = [v for v in values if v is not None]
    out = c.isin(plain) if plain else F.lit(False)
    if NULL_KEY in keys:
        out = out | c.isNull()
        if table.primary.type == "TEXT":
            out = out | (c == NULL_KEY)
    return F.coalesce(out, F.lit(False))


def _insert(table: TableState, node: ast.Insert, catalog: Catalog) -> tuple[TableState, Change]:
    spark = table.df.sparkSession
    if node.query is not None:
        batch, count, top = _selected(table, node.query, catalog)
        keys = None
    else:
        rows = _literal_rows(table, node)
        count = len(rows)
        keys = [r[table.names.index(table.primary.name)] for r in rows] if table.primary is not None else None
        batch, top = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema_of(table.columns)), count - 1
    if not count:
        return table, Change()
    table = table.numbered()
    batch = batch.withColumn(SEQ, F.col(SEQ) + F.lit(table.next_seq))
    if table.primary is None:
        merged = table.df.unionByName(batch)
    elif node.replace:
        merged = _upserted(table, batch, keys is not None)
    else:
        _check_new(table, batch, keys)
        merged = table.df.unionByName(batch)
    state = replace(table, df=merged, next_seq=table.next_seq + top + 1, steps=table.steps + 1)
    return state, Change(count)


def _literal_rows(table: TableState, node: ast.Insert) -> list[tuple]:
    out = []
    for row in node.rows:
        if len(row) != len(table.columns):
            raise SqlError("column count mismatch")
        values = tuple(stored(v, c.type) for v, c in zip(row, table.columns))
        if any(c.primary and v == "" for v, c in zip(values, table.columns)):
            raise SqlError("primary key required")
        out.append(values)
    return out


def _selected(table: TableState, query: ast.Select, catalog: Catalog) -> tuple[DataFrame, int, int]:
    """A query's rows in the table's types, numbered in their order, how many there are and the greatest number.

    They are written, so that numbers and sources stand still. Rows in insertion order keep the numbers that they have, unsorted.
    """
    source = catalog.table(query.table)
    kinds = result_kinds(query, source)
    names = [f"__{i}" for i in range(len(kinds))]
    if in_order(query):
        rows = rows_in_order(query, source.numbered(), names)
    else:
        rows = compile_select(query, source).toDF(*names).withColumn(SEQ, F.monotonically_increasing_id())
    if len(kinds) != len(table.columns):
        raise SqlError("column count mismatch")
    rows = written_version(rows, table.name)
    out, wrong = [], F.lit(False)
    for i, (kind, c) in enumerate(zip(kinds, table.columns)):
        value, bad = _coerced(F.col(f"__{i}"), kind, c.type)
        out.append(value.alias(c.name))
        wrong = wrong | bad
    empty = F.lit(False)
    if table.primary is not None and table.primary.type == "TEXT":
        empty = F.coalesce(out[table.names.index(table.primary.name)] == "", F.lit(False))
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(SEQ), F.lit(-1)).alias("top"), F.count_if(wrong).alias("wrong"), F.count_if(empty).alias("empty")).first()
    if found["wrong"]:
        raise SqlError("type mismatch")
    if found["empty"]:
        raise SqlError("primary key required")
    return rows.select(*out, SEQ), found["n"], found["top"]


def _float_text(c: Column) -> Column:
    """A double as its shortest decimal text: plain from 0.0001 to below 1e6, else with an exponent of two digits at least."""
    size = F.abs(c)
    java = size.cast("string")  # plain from 0.001 to below 1e7, else d.dddE[-]d
    head = F.regexp_replace(F.substring_index(java, "E", 1), r"\.0$", "")
    digits = F.rtrim(F.translate(head, ".", ""), F.lit("0"))
    point = lambda d: F.concat(F.substring(d, 1, 1), F.when(F.length(d) > 1, F.concat(F.lit("."), F.substring(d, 2, 400))).otherwise(""))
    power = F.substring_index(java, "E", -1).try_cast("int")
    sign = F.when(power < 0, "-").otherwise("+")
    text = (
        F.when(F.isnan(c), "NaN")
        .when(size == float("inf"), "Inf")
        .when(size == 0, "0")
        .when((size >= 1e-3) & (size < 1e6), head)
        .when((size >= 1e-4) & (size < 1e-3), F.concat(F.lit("0.000"), digits))
        .when((size >= 1e6) & (size < 1e7), F.concat(point(digits), F.lit("e+06")))
        .otherwise(F.concat(head, F.lit("e"), sign, F.when(F.abs(power) < 10, "0").otherwise(""), F.abs(power).cast("string")))
    )
    minus = F.when(F.isnan(c), "").when(c.cast("string").startswith("-"), "-").when(size == float("inf"), "+").otherwise("")
    return F.when(c.isNotNull(), F.concat(minus, text))


def _coerced(c: Column, kind: str, to: str) -> tuple[Column, Column]:
    """A column in another type, and where it has no value there: whole floats fit INT, texts parse, all renders to TEXT."""
    target = SPARK_TYPES[to]
    no = F.lit(False)
    if kind == to:
        return c.cast(target), no
    if to == "TEXT":
        return _float_text(c.cast("double")) if kind == "FLOAT" else c.cast("string"), no
    if kind == "INT" and to == "FLOAT":
        return c.cast(target), no
    if kind == "FLOAT" and to == "INT":
        bad = c.isNotNull() & ~((c == F.floor(c)) & (c >= F.lit(-(2.0**63))) & (c < F.lit(2.0**63)))
        return F.when(~bad, c).cast(target), F.coalesce(bad, no)
    if kind == "TEXT":
        text = F.trim(c)
        if to == "BOOL":
            value = F.when(text.isin("1", "t", "T", "TRUE", "true", "True"), True).when(text.isin("0", "f", "F", "FALSE", "false", "False"), False)
        elif to == "INT":
            value = F.when(text.rlike(r"^[+-]?[0-9]+\z"), text.try_cast(target))
        else:
            value = F.when(text.rlike(r"^(?i)[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity|nan)\z"), text.try_cast(target))
        return value, c.isNotNull() & value.isNull()
    return F.lit(None).cast(target), c.isNotNull()


def _check_new(table: TableState, batch: DataFrame, keys: list[Any] | None) -> None:
    """No key twice, within the batch or with the table."""
    if keys is not None and len(keys) <= LOOKUP:
        if len({render(k) for k in keys}) < len(keys) or table.rows(False).where(_has_key(table, keys)).limit(1).count():
            raise SqlError("duplicate primary key")
        return
    own = batch.select(table.key().alias("__key"))
    twice = own.groupBy("__key").count().where("count > 1").limit(1).count()
    old = table.rows(False).select(table.key().alias("__old"))
    if twice or old.join(own, F.col("__old").eqNullSafe(F.col("__key")), "left_semi").limit(1).count():
        raise SqlError("duplicate primary key")


def _upserted(table: TableState, batch: DataFrame, literal: bool) -> DataFrame:
    """The last row of a key wins; it stands where the key's row stood, or first came up in the batch."""
    by_key = Window.partitionBy("__key")
    new = batch.withColumn("__key", table.key())
    new = new.withColumn("__first", F.min(SEQ).over(by_key)).withColumn("__turn", F.row_number().over(by_key.orderBy(F.desc(SEQ)))).where("__turn = 1")
    # a statement's own rows are as few as it spells out
    few = F.broadcast if literal else lambda df: df
    old = table.df.select(table.key().alias("__k"), F.col(SEQ).alias("__old"))
    old = old.join(few(new.select(F.col("__key").alias("__n"))), F.col("__k").eqNullSafe(F.col("__n")), "left_semi")
    placed = new.join(few(old) if literal else old, F.col("__key").eqNullSafe(F.col("__k")), "left").select(*map(quoted, table.names), F.coalesce("__old", "__first").alias(SEQ))
    kept = table.df.withColumn("__k", table.key()).join(few(new.select("__key")), F.col("__k").eqNullSafe(F.col("__key")), "left_anti")
    return kept.select(*map(quoted, table.names), SEQ).unionByName(placed)
