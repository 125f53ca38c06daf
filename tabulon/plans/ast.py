"""Statement nodes. Names are lower-cased by the parser."""

from __future__ import annotations

from dataclasses import dataclass

from tabulon.functions.values import Literal


@dataclass(frozen=True)
class Term:
    """A comparison of a column (or, in HAVING, an aggregate's name) with literals; op: = != < <= > >= in between like."""

    column: str
    op: str
    values: tuple[Literal, ...]


@dataclass(frozen=True)
class Predicate:
    """Alternatives, each a conjunction of terms: no parentheses, AND before OR."""

    any_of: tuple[tuple[Term, ...], ...]

    def columns(self) -> list[str]:
        return [t.column for terms in self.any_of for t in terms]


@dataclass(frozen=True)
class Aggregate:
    function: str
    column: str  # "*" for all rows

    @property
    def name(self) -> str:
        return f"{self.function.lower()}({self.column})"


@dataclass(frozen=True)
class Select:
    table: str
    items: tuple[str | Aggregate, ...]  # ("*",) for all columns
    distinct: bool = False
    where: Predicate | None = None
    group_by: tuple[str, ...] = ()
    having: Predicate | None = None
    order_by: str | None = None
    descending: bool = False
    limit: int | None = None
    offset: int = 0

    @property
    def aggregates(self) -> list[Aggregate]:
        return [i for i in self.items if isinstance(i, Aggregate)]


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: str
    primary: bool = False


@dataclass(frozen=True)
class CreateTable:
    table: str
    columns: tuple[ColumnDef, ...]


@dataclass(frozen=True)
class CreateIndex:
    name: str
    table: str
    column: str


@dataclass(frozen=True)
class AddColumn:
    table: str
    column: ColumnDef


@dataclass(frozen=True)
class DropColumn:
    table: str
    column: str


@dataclass(frozen=True)
class DropTable:
    table: str
    if_exists: bool = False


@dataclass(frozen=True)
class DropIndex:
    name: str
    table: str


@dataclass(frozen=True)
class Truncate:
    table: str


@dataclass(frozen=True)
class Insert:
    table: str
    rows: tuple[tuple[Literal, ...], ...] = ()
    query: Select | None = None
    replace: bool = False


@dataclass(frozen=True)
class Update:
    table: str
    column: str
    value: Literal
    where: Term | None = None


@dataclass(frozen=True)
class Delete:
    table: str
    where: Term | None = None


@dataclass(frozen=True)
class Show:
    what: str  # tables, columns or indexes
    table: str = ""


@dataclass(frozen=True)
class Transaction:
    word: str  # BEGIN, COMMIT or ROLLBACK


Statement = Select | CreateTable | CreateIndex | AddColumn | DropColumn | DropTable | DropIndex | Truncate | Insert | Update | Delete | Show | Transaction
READS = (Select, Show)
