"""Immutable table versions, and the catalog that names them."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.errors import SqlError
from tabulon.functions.values import NULL_KEY, SPARK_TYPES, dialect_type
from tabulon.operators.predicates import quoted
from tabulon.plans.ast import ColumnDef

#: The hidden column of insertion order.
SEQ = "__seq"


@dataclass(frozen=True)
class TableState:
    """One version of a table. ``df`` has the declared columns and, unless the rows come straight from files, SEQ.

    Rows of files are ordered by file and place in the file; that order is attached only where a
    statement shows it, so a plain scan or aggregate never pays for it.
    """

    name: str
    columns: tuple[ColumnDef, ...]
    df: DataFrame
    next_seq: int = 0
    indexes: dict[str, str] = field(default_factory=dict)  # name -> column
    from_files: bool = False
    steps: int = 0  # mutations since the rows were last written

    @property
    def kinds(self) -> dict[str, str]:
        return {c.name: c.type for c in self.columns}

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    @property
    def primary(self) -> ColumnDef | None:
        return next((c for c in self.columns if c.primary), None)

    def rows(self, ordered: bool) -> DataFrame:
        """The rows, with SEQ if ``ordered``."""
        if self.from_files:
            if not ordered:
                return self.df
            return self.df.select(*map(quoted, self.names), F.struct("_metadata.file_path", "_metadata.row_index").alias(SEQ))
        return self.df if ordered else self.df.select(*map(quoted, self.names))

    def numbered(self) -> TableState:
        """The table with SEQ as dense numbers, for a first mutation of rows that come from files."""
        if not self.from_files:
            return self
        own = self.df.select(*map(quoted, self.names), F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
        counts = own.groupBy("__file").count().orderBy("__file").collect()  # a row for each file
        start, offsets = 0, []
        for r in counts:
            offsets.append((r["__file"], start))
            start += r["count"]
        listed = own.sparkSession.createDataFrame(offsets, "__file string, __start long")
        rows = own.join(listed, "__file").select(*map(quoted, self.names), (F.col("__start") + F.col("__row")).alias(SEQ))
        return replace(self, df=rows, next_seq=start, from_files=False)

    def key(self) -> Column:
        """What identifies a row by its primary key, compared null-safely: the column itself where equal values read alike."""
        assert self.primary is not None
        c = quoted(self.primary.name)
        if self.primary.type in ("INT", "BOOL"):
            return c
        return F.coalesce(c.cast("string"), F.lit(NULL_KEY))


def schema_of(columns: tuple[ColumnDef, ...]) -> T.StructType:
    fields = [T.StructField(c.name, SPARK_TYPES[c.type], True, {"primary": c.primary}) for c in columns]
    return T.StructType([*fields, T.StructField(SEQ, T.LongType(), False)])


def empty_table(spark: SparkSession, name: str, columns: tuple[ColumnDef, ...]) -> TableState:
    return TableState(name, columns, spark.createDataFrame([], schema_of(columns)))


def parquet_table(spark: SparkSession, name: str, path: str, primary: str | None = None) -> TableState:
    """Files as a table, read-only until its first mutation. Columns of other types than the four are left out."""
    df = spark.read.parquet(path)
    columns = []
    for f in df.schema.fields:
        kind = dialect_type(f.dataType)
        if kind is not None:
            columns.append(ColumnDef(f.name.lower(), kind, f.name.lower() == (primary or "").lower()))
    if not columns:
        raise SqlError("invalid column type")
    # names are found whatever their case, and native widths stay as they are
    return TableState(name, tuple(columns), df.select(*(quoted(c.name) for c in columns)), from_files=True)


class Catalog:
    """Table versions by name, and a revision that counts published changes."""

    def __init__(self, tables: dict[str, TableState] | None = None, revision: int = 0):
        self.tables = dict(tables or {})
        self.revision = revision

    def clone(self) -> Catalog:
        """A copy that costs no rows: versions are shared."""
        return Catalog(self.tables, self.revision)

    def table(self, name: str) -> TableState:
        found = self.tables.get(name.lower())
        if found is None:
            raise SqlError("table not found")
        return found

    def put(self, state: TableState) -> None:
        self.tables[state.name] = state
        self.revision += 1

    def drop(self, name: str) -> None:
        del self.tables[name]
        self.revision += 1

    def row_count(self) -> int:
        """Rows of all tables."""
        return sum(t.rows(False).count() for t in self.tables.values())
