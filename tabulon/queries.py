"""Queries over the test tables, one for each operator of the dialect, and the same in ANSI SQL.

The dialect has no aliases, so aggregates are renamed here, outside the engine.
"""

from __future__ import annotations

import io
import json
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.cli import run_script
from tabulon.errors import SqlError
from tabulon.service import Service
from tabulon.session import Engine, Limits, is_read_only
from tabulon.sources.versions import version_dir, written_version

#: Tables with a unique first column, which becomes the primary key.
KEYS = {"customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "nation": "n_nationkey", "region": "r_regionkey", "events": "event_id", "documents": "doc_id", "labels": "doc_id", "pages": "page_id"}
TABLES = (*KEYS, "lineitem")


@dataclass(frozen=True)
class Case:
    """Statements before, the query, names for its columns (None: as they are) and the oracle."""

    sql: str
    oracle: str
    names: tuple[str, ...] | None = None
    before: tuple[str, ...] = ()
    params: tuple = ()
    run: Callable[[Engine], Engine | DataFrame | None] | None = None  # may give the engine to ask, or the result itself
    placed: bool = False  # with the place of each row in the result, so that the order counts


def _commit(engine: Engine) -> None:
    session = engine.session()
    for sql in ("BEGIN", "UPDATE supplier SET s_name = 'moved' WHERE s_nationkey = 3", "DELETE FROM supplier WHERE s_acctbal < 0", "COMMIT"):
        session.execute(sql)


def _rollback(engine: Engine) -> None:
    session = engine.session()
    for sql in ("BEGIN", "DELETE FROM supplier", "ROLLBACK"):
        session.execute(sql)


def _failed_batch(engine: Engine) -> None:
    try:
        engine.session().batch(["DELETE FROM supplier WHERE s_suppkey > 3", "INSERT INTO supplier VALUES (1, 'twice', 1, 1.0)"], atomic=True)
    except SqlError:
        return
    raise AssertionError("the batch should have failed")


def _prepared(engine: Engine) -> None:
    session = engine.session()
    session.execute("CREATE TABLE bound (id INT PRIMARY KEY, name TEXT, score FLOAT, ok BOOL)")
    session.execute("INSERT INTO bound VALUES (?, ?, ?, ?)", [1000000, "it's", 2.5, True])
    session.execute("INSERT INTO bound VALUES (?, ?, ?, ?)", [2, None, 1e6, False])


def _folder(engine: Engine) -> str:
    """A new data folder where the session keeps its tables."""
    return f"{version_dir(engine.spark).removeprefix('file:')}/data-{uuid.uuid4().hex}"


def _changed(engine: Engine, mode: str) -> tuple[Engine, str]:
    """A database on disk with a copy of the suppliers, changed by several statements."""
    folder = _folder(engine)
    kept = Engine(engine.spark, mode, folder)
    source = engine.catalog.table("supplier")
    with kept.lock:
        changed = kept.catalog.clone()
        changed.put(source)
        kept.publish(changed, [{"register": ["supplier", engine.paths["supplier"], "s_suppkey"]}])
    kept.session().until_error(["CREATE TABLE copy (k INT PRIMARY KEY, name TEXT, bal FLOAT)", "INSERT INTO copy SELECT s_suppkey, s_name, s_acctbal FROM supplier", "UPDATE copy SET bal = NULL WHERE bal < 0", "DELETE FROM copy WHERE k = 3", "CREATE INDEX by_name ON copy (name)"])
    return kept, folder


def _rolled(mode: str, compact: bool = False) -> Callable[[Engine], Engine]:
    def run(engine: Engine) -> Engine:
        kept, folder = _changed(engine, mode)
        if compact:
            kept.compact()
            kept.execute("INSERT INTO copy VALUES (-1, 'late', 0.5)")
        return Engine(engine.spark, mode, folder)

    return run


def _recovered(engine: Engine) -> Engine:
    kept, folder = _changed(engine, "wal")
    kept.compact()
    kept.store.backup()
    kept.execute("DELETE FROM copy")
    kept.recover()
    return Engine(engine.spark, "wal", folder)


def _torn(engine: Engine) -> Engine:
    """A log whose last write was cut off, and a change after the restart."""
    kept, folder = _changed(engine, "wal")
    with kept.store.log.path.open("ab") as f:
        f.write(b'1a2b3c4d ["DELETE FROM co')
    Engine(engine.spark, "wal", folder).execute("INSERT INTO copy VALUES (-1, 'late', 0.5)")
    return Engine(engine.spark, "wal", folder)


COPY = "SELECT s_suppkey AS k, s_name AS name, CASE WHEN s_acctbal >= 0 THEN s_acctbal END AS bal FROM supplier WHERE s_suppkey <> 3"


def _said(engine: Engine, *statements: str, atomic: bool = False, **limits: float) -> list[tuple[int, str]]:
    """Answers to a batch of statements by their number: a code, or rows or changed rows counted."""
    own = Engine(engine.spark, limits=Limits(**limits))
    own.catalog = engine.catalog
    out = []
    try:
        answers: list = own.session().batch(statements, atomic)
    except SqlError as e:
        answers = [e]
    for i, a in enumerate(answers):
        try:
            if isinstance(a, SqlError):
                raise a
            out.append((i, f"{len(a.rows())} rows" if a.df is not None else f"{a.affected} changed"))
        except SqlError as e:
            out.append((i, e.code))
    engine.catalog = own.catalog
    return out


def _plain_batch(engine: Engine) -> DataFrame:
    said = _said(engine, "DELETE FROM supplier WHERE s_suppkey = 1", "nonsense", "SELECT * FROM nope", "DELETE FROM supplier WHERE s_suppkey = 2", "SELECT s_suppkey FROM supplier WHERE s_suppkey < 4")
    return engine.spark.createDataFrame(said, "i int, answer string")


def _limited(engine: Engine) -> DataFrame:
    said = _said(engine, "SELECT s_suppkey FROM supplier LIMIT 5", "SELECT s_suppkey FROM supplier LIMIT 6", max_rows=5)
    said += _said(engine, "SHOW TABLES", "SHOW TABLES", max_batch=1)
    said += _said(engine, "SELECT s_name FROM supplier LIMIT 9", max_bytes=40)
    return engine.spark.createDataFrame([(i, a) for i, (_, a) in enumerate(said)], "i int, answer string")


def _nested(engine: Engine) -> DataFrame:
    said = _said(engine, "BEGIN", "DELETE FROM supplier", "BEGIN", "SELECT COUNT(*) FROM supplier", "ROLLBACK", "COMMIT")
    return engine.spark.createDataFrame(said, "i int, answer string")


def _requests(engine: Engine) -> DataFrame:
    """JSON in and out: rows of a query, the code of a failure, a ping, and a batch."""
    ask = Service(engine, "key").connection().handle_text
    rows = json.loads(ask(json.dumps({"sql": "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < ?", "params": [5], "auth": "key"}).encode()))
    out = [(str(k), name) for k, name in rows["rows"]]
    for request in ({"sql": "SHOW TABLES"}, {"sql": "SELECT * FROM nope", "auth": "key"}, {"ping": True}, []):
        answer = json.loads(ask(json.dumps(request).encode()))
        out.append((answer.get("code", "-"), answer.get("status", "-")))
    return engine.spark.createDataFrame(out, "a string, b string")


def _script(engine: Engine) -> DataFrame:
    """A script's text table, line by line."""
    out = io.StringIO()
    run_script(engine, "SELECT r_regionkey, r_name FROM region WHERE r_regionkey < 3;\nSELECT nope FROM region; SELECT r_name FROM region", out)
    return engine.spark.createDataFrame(list(enumerate(" ".join(line.split()) for line in out.getvalue().splitlines())), "i long, line string")


def _kinds(engine: Engine) -> DataFrame:
    texts = ("SELECT 1", " show tables", "DESC nation", "\n DESCRIBE nation", "DELETE FROM nation", "BEGIN", "INSERT INTO nation VALUES (1)")
    return engine.spark.createDataFrame([(i, is_read_only(t)) for i, t in enumerate(texts)], "i int, reads boolean")


def _row_counts(engine: Engine) -> DataFrame:
    return engine.spark.createDataFrame([(engine.catalog.row_count(),)], "n long")


def _stopped(engine: Engine) -> DataFrame:
    """A statement that runs out of time, and the next one, which does not."""
    slow = Engine(engine.spark, limits=Limits(timeout_s=0.3))
    slow.catalog = engine.catalog
    try:
        with slow.timed():
            engine.spark.range(40_000_000_000).selectExpr("sum(sqrt(id))").collect()
        code = "none"
    except SqlError as e:
        code = e.code
    return engine.spark.createDataFrame([(code, len(engine.execute("SELECT * FROM region").rows()))], "code string, n int")


#: Customers with NULL in a number, a text and a flag.
HOLES = ("UPDATE customer SET c_acctbal = NULL WHERE c_nationkey = 3", "UPDATE customer SET c_mktsegment = NULL WHERE c_nationkey = 5", "ALTER TABLE customer ADD COLUMN gold BOOL", "UPDATE customer SET gold = true WHERE c_nationkey < 4", "UPDATE customer SET gold = false WHERE c_nationkey > 20")
HOLED = "(SELECT c_custkey, CASE WHEN c_nationkey <> 3 THEN c_acctbal END AS bal, CASE WHEN c_nationkey <> 5 THEN c_mktsegment END AS seg, CASE WHEN c_nationkey < 4 THEN TRUE WHEN c_nationkey > 20 THEN FALSE END AS gold, CASE WHEN c_nationkey <> 7 THEN c_nationkey END AS nat FROM customer)"


def _holed(where: str, oracle: str) -> Case:
    """Customers by a condition on columns with NULL; nationkey 7 is NULL too, set last, since the others go by it."""
    before = (*HOLES, "UPDATE customer SET c_nationkey = NULL WHERE c_nationkey = 7")
    return Case(f"SELECT c_custkey FROM customer WHERE {where}", f"SELECT c_custkey FROM {HOLED} WHERE {oracle}", before=before)


def _sorted_holes(order: str, oracle: str) -> Case:
    before = (*HOLES, "UPDATE customer SET c_nationkey = NULL WHERE c_nationkey = 7")
    return Case(f"SELECT c_custkey FROM customer ORDER BY {order}", f"SELECT c_custkey, row_number() OVER (ORDER BY {oracle}, c_custkey) AS place FROM {HOLED}", before=before, placed=True)


CASES: dict[str, Case] = {
    "flagship": Case("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000 ORDER BY o_orderkey LIMIT 20", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000 ORDER BY o_orderkey LIMIT 20"),
    "scan_star": Case("SELECT * FROM supplier", "SELECT * FROM supplier"),
    "project_columns": Case("SELECT o_orderstatus, o_orderkey FROM orders", "SELECT o_orderstatus, o_orderkey FROM orders"),
    "project_dup_columns": Case("SELECT c_name, c_custkey, c_name FROM customer", "SELECT c_name AS n1, c_custkey, c_name AS n2 FROM customer", ("n1", "c_custkey", "n2")),
    "filter_eq": Case("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "filter_ne": Case("SELECT o_orderkey FROM orders WHERE o_orderstatus != 'F'", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'"),
    "filter_range": Case("SELECT p_partkey, p_retailprice FROM part WHERE p_size >= 10 AND p_size < 20 AND p_partkey > 20", "SELECT p_partkey, p_retailprice FROM part WHERE p_size >= 10 AND p_size < 20 AND p_partkey > 20"),
    "filter_in": Case("SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey IN (1, 3, '5', 24)", "SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey IN (1, 3, 5, 24)"),
    "filter_between": Case("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal BETWEEN 0 AND 1000.5", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal BETWEEN 0 AND 1000.5"),
    "filter_like_prefix": Case("SELECT p_partkey, p_type FROM part WHERE p_type LIKE 'STANDARD%'", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE 'STANDARD%'"),
    "filter_like_underscore": Case("SELECT p_partkey, p_brand FROM part WHERE p_brand LIKE '_rand#1_'", "SELECT p_partkey, p_brand FROM part WHERE p_brand LIKE '_rand#1_'"),
    "filter_and_or": Case("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000 OR o_orderpriority = '1-URGENT'", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 200000) OR o_orderpriority = '1-URGENT'"),
    "filter_text_order": Case("SELECT s_suppkey FROM supplier WHERE s_name > 'Supplier#000000050'", "SELECT s_suppkey FROM supplier WHERE s_name > 'Supplier#000000050'"),
    "filter_mismatch": Case("SELECT n_nationkey FROM nation WHERE n_nationkey != 'none'", "SELECT n_nationkey FROM nation"),
    "pk_lookup": Case("SELECT * FROM customer WHERE c_custkey = 077", "SELECT * FROM customer WHERE c_custkey = 77"),
    "index_lookup": Case("SELECT o_orderkey FROM orders WHERE o_custkey = 42", "SELECT o_orderkey FROM orders WHERE o_custkey = 42", before=("CREATE INDEX by_customer ON orders (o_custkey)",)),
    "index_count": Case("SELECT COUNT(*) FROM orders WHERE o_custkey = 42", "SELECT count(*) AS n FROM orders WHERE o_custkey = 42", ("n",), ("CREATE INDEX by_customer ON orders (o_custkey)",)),
    "distinct_1col": Case("SELECT DISTINCT l_returnflag FROM lineitem", "SELECT DISTINCT l_returnflag FROM lineitem"),
    "distinct_2col": Case("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem"),
    "distinct_order_limit": Case("SELECT DISTINCT c_mktsegment FROM customer ORDER BY c_custkey DESC LIMIT 3", "SELECT c_mktsegment FROM customer GROUP BY c_mktsegment ORDER BY min(c_custkey) DESC LIMIT 3"),
    "count_star": Case("SELECT COUNT(*) FROM lineitem", "SELECT count(*) AS n FROM lineitem", ("n",)),
    "count_col": Case("SELECT COUNT(l_partkey) FROM lineitem WHERE l_quantity > 25", "SELECT count(l_partkey) AS n FROM lineitem WHERE l_quantity > 25", ("n",)),
    "sum_int": Case("SELECT SUM(l_linenumber) FROM lineitem", "SELECT sum(CAST(l_linenumber AS DOUBLE)) AS total FROM lineitem", ("total",)),
    "sum_float": Case("SELECT SUM(l_quantity) FROM lineitem WHERE l_returnflag = 'R'", "SELECT sum(l_quantity) AS total FROM lineitem WHERE l_returnflag = 'R'", ("total",)),
    "sum_of_none": Case("SELECT SUM(l_quantity) FROM lineitem WHERE l_quantity < 0", "SELECT coalesce(sum(l_quantity), 0.0) AS total FROM lineitem WHERE l_quantity < 0", ("total",)),
    "avg": Case("SELECT AVG(l_linenumber) FROM lineitem", "SELECT avg(CAST(l_linenumber AS DOUBLE)) AS mean FROM lineitem", ("mean",)),
    "min_text": Case("SELECT MIN(p_name) FROM part", "SELECT min(p_name) AS low FROM part", ("low",)),
    "max_float": Case("SELECT MAX(o_totalprice) FROM orders WHERE o_orderstatus = 'O'", "SELECT max(o_totalprice) AS high FROM orders WHERE o_orderstatus = 'O'", ("high",)),
    "group_1key": Case("SELECT o_orderpriority, COUNT(*), MIN(o_orderkey), MAX(o_totalprice) FROM orders GROUP BY o_orderpriority", "SELECT o_orderpriority, count(*) AS n, min(o_orderkey) AS first_key, max(o_totalprice) AS high FROM orders GROUP BY o_orderpriority", ("o_orderpriority", "n", "first_key", "high")),
    "group_2key": Case("SELECT l_returnflag, l_linestatus, SUM(l_quantity), AVG(l_linenumber), COUNT(*) FROM lineitem WHERE l_discount < 0.05 GROUP BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, avg(CAST(l_linenumber AS DOUBLE)) AS line, count(*) AS n FROM lineitem WHERE l_discount < 0.05 GROUP BY l_returnflag, l_linestatus", ("l_returnflag", "l_linestatus", "qty", "line", "n")),
    "group_no_agg": Case("SELECT s_nationkey FROM supplier GROUP BY s_nationkey", "SELECT s_nationkey FROM supplier GROUP BY s_nationkey"),
    "group_high_cardinality": Case("SELECT l_partkey, SUM(l_quantity) FROM lineitem GROUP BY l_partkey", "SELECT l_partkey, sum(l_quantity) AS qty FROM lineitem GROUP BY l_partkey", ("l_partkey", "qty")),
    "having_count": Case("SELECT o_custkey, COUNT(*) FROM orders GROUP BY o_custkey HAVING COUNT(*) > 9", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 9", ("o_custkey", "n")),
    "having_key": Case("SELECT l_returnflag, COUNT(*) FROM lineitem GROUP BY l_returnflag HAVING l_returnflag != 'N' AND COUNT(*) >= 2", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag HAVING l_returnflag <> 'N' AND count(*) >= 2", ("l_returnflag", "n")),
    "group_order_agg": Case("SELECT l_suppkey, SUM(l_quantity) FROM lineitem GROUP BY l_suppkey ORDER BY l_suppkey DESC LIMIT 7 OFFSET 2", "SELECT l_suppkey, sum(l_quantity) AS qty FROM lineitem GROUP BY l_suppkey ORDER BY l_suppkey DESC LIMIT 7 OFFSET 2", ("l_suppkey", "qty")),
    "sort_all": Case("SELECT p_partkey, p_name FROM part ORDER BY p_name", "SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_name, p_partkey) AS place FROM part", placed=True),
    "topk_asc": Case("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice LIMIT 25", "SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS place FROM orders ORDER BY place LIMIT 25", placed=True),
    "topk_desc": Case("SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority DESC LIMIT 25", "SELECT o_orderkey, o_orderpriority, row_number() OVER (ORDER BY o_orderpriority DESC, o_orderkey) AS place FROM orders ORDER BY place LIMIT 25", placed=True),
    "limit_offset": Case("SELECT c_custkey FROM customer LIMIT 10 OFFSET 5", "SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 5 AS place FROM customer ORDER BY c_custkey LIMIT 10 OFFSET 5", placed=True),
    "offset_only": Case("SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey OFFSET 20", "SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey OFFSET 20"),
    "insert_values": Case("SELECT * FROM t", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'ada', CAST(1.5 AS DOUBLE), TRUE), (2, 'it''s', NULL, NULL), (3, NULL, 1000.0, FALSE)) AS t(id, name, score, ok)", before=("CREATE TABLE t (id INT PRIMARY KEY, name TEXT, score FLOAT, ok BOOL)", "INSERT INTO t VALUES (1, 'ada', 1.5, true), (2, 'it''s', NULL, NULL)", "INSERT INTO t VALUES (03, NULL, 1e3, F)")),
    "insert_select": Case("SELECT * FROM big", "SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS label, o_totalprice AS price FROM orders WHERE o_totalprice > 200000", before=("CREATE TABLE big (k INT PRIMARY KEY, label TEXT, price FLOAT)", "INSERT INTO big SELECT o_orderkey, o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000")),
    "upsert": Case("SELECT c_custkey, c_name, c_acctbal FROM customer", "SELECT c_custkey, CASE WHEN c_custkey = 1 THEN 'second' ELSE c_name END AS c_name, CASE WHEN c_custkey = 1 THEN 2.5 ELSE c_acctbal END AS c_acctbal FROM customer UNION ALL SELECT 90000001, 'new', 3.0", before=("INSERT OR REPLACE INTO customer VALUES (1, 'first', 1, 1.5, 'BUILDING'), (90000001, 'new', 2, 3, 'MACHINERY'), (1, 'second', 1, 2.5, 'BUILDING')",)),
    "update_where": Case("SELECT o_orderkey, o_orderpriority FROM orders", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN '0-HUGE' ELSE o_orderpriority END AS o_orderpriority FROM orders", before=("UPDATE orders SET o_orderpriority = '0-HUGE' WHERE o_totalprice > 300000",)),
    "update_key": Case("SELECT n_nationkey, n_name FROM nation", "SELECT CASE WHEN n_nationkey = 3 THEN 300 ELSE n_nationkey END AS n_nationkey, n_name FROM nation", before=("UPDATE nation SET n_nationkey = 300 WHERE n_nationkey = 3",)),
    "delete_where": Case("SELECT p_partkey FROM part", "SELECT p_partkey FROM part WHERE NOT (p_size BETWEEN 10 AND 40)", before=("DELETE FROM part WHERE p_size BETWEEN 10 AND 40",)),
    "add_column": Case("SELECT r_regionkey, r_name, note FROM region", "SELECT r_regionkey, r_name, CASE WHEN r_regionkey = 2 THEN 'two' END AS note FROM region", before=("ALTER TABLE region ADD COLUMN note TEXT", "UPDATE region SET note = 'two' WHERE r_regionkey = 2")),
    "drop_column": Case("SELECT * FROM supplier", "SELECT s_suppkey, s_name, s_acctbal FROM supplier", before=("ALTER TABLE supplier DROP COLUMN s_nationkey",)),
    "truncate_insert": Case("SELECT * FROM nation", "SELECT 7 AS n_nationkey, 'seven' AS n_name, 1 AS n_regionkey", before=("TRUNCATE TABLE nation", "INSERT INTO nation VALUES (7, 'seven', 1)")),
    "drop_table": Case("SHOW TABLES", "SELECT * FROM (VALUES ('customer'), ('documents'), ('events'), ('labels'), ('lineitem'), ('nation'), ('orders'), ('pages'), ('part'), ('supplier')) AS t(\"table\")", before=("DROP TABLE region", "DROP TABLE IF EXISTS region")),
    "describe": Case("DESCRIBE nation", "SELECT * FROM (VALUES ('n_nationkey', 'INT', TRUE), ('n_name', 'TEXT', FALSE), ('n_regionkey', 'INT', FALSE)) AS t(name, type, \"primary\")"),
    "show_indexes": Case("SHOW INDEXES FROM orders", "SELECT * FROM (VALUES ('b', 'o_orderstatus')) AS t(name, \"column\")", before=("CREATE INDEX a ON orders (o_custkey)", "CREATE INDEX b ON orders (o_orderstatus)", "DROP INDEX o_custkey ON orders")),
    "null_eq": _holed("c_acctbal = NULL", "bal IS NULL"),
    "null_ne_value": _holed("c_mktsegment != 'BUILDING'", "seg IS DISTINCT FROM 'BUILDING'"),
    "null_ne": _holed("gold != NULL", "gold IS NOT NULL"),
    "null_float_above": _holed("c_acctbal > 5000", "bal > 5000 OR bal IS NULL"),
    "null_float_below": _holed("c_acctbal <= 5000", "bal <= 5000"),
    "null_int_order": _holed("c_nationkey >= 20", "nat >= 20 OR nat IS NULL"),
    "null_text_order": _holed("c_mktsegment < 'BUILDING'", "coalesce(seg, '<nil>') < 'BUILDING'"),
    "null_bool_order": _holed("gold <= false", "gold IS NULL OR NOT gold"),
    "null_in": _holed("c_nationkey IN (1, NULL)", "nat = 1 OR nat IS NULL"),
    "null_between": _holed("c_nationkey BETWEEN 22 AND NULL", "nat >= 22 OR nat IS NULL"),
    "null_like": _holed("c_mktsegment LIKE '%'", "seg IS NOT NULL"),
    "null_sort_float": _sorted_holes("c_acctbal", "bal NULLS LAST"),
    "null_sort_float_desc": _sorted_holes("c_acctbal DESC", "bal DESC NULLS FIRST"),
    "null_sort_text": _sorted_holes("c_mktsegment", "coalesce(seg, '<nil>')"),
    "null_sort_bool": _sorted_holes("gold", "gold NULLS FIRST"),
    "null_group": Case("SELECT c_mktsegment, COUNT(*), COUNT(c_acctbal), MIN(c_acctbal), AVG(c_custkey) FROM customer GROUP BY c_mktsegment", f"SELECT seg, count(*) AS n, count(bal) AS m, min(bal) AS low, avg(c_custkey) AS mean FROM {HOLED} GROUP BY seg", ("seg", "n", "m", "low", "mean"), HOLES),
    "null_update_delete": Case("SELECT c_custkey, c_mktsegment FROM customer", f"SELECT c_custkey, coalesce(seg, 'NONE') AS c_mktsegment FROM {HOLED} WHERE bal IS NOT NULL", before=(*HOLES, "UPDATE customer SET c_mktsegment = 'NONE' WHERE c_mktsegment = NULL", "DELETE FROM customer WHERE c_acctbal = NULL")),
    "insert_float_as_text": Case("SELECT * FROM f", "SELECT * FROM (VALUES (1, '2'), (2, '1e+06'), (3, '0.0001'), (4, '1e-05'), (5, '-1.5'), (6, '1.234567e+06'), (7, '999999.5'), (8, '+Inf'), (9, NULL), (10, 'true')) AS t(id, s)", before=("CREATE TABLE g (id INT PRIMARY KEY, v FLOAT)", "INSERT INTO g VALUES (1, 2.0), (2, 1e6), (3, 0.0001), (4, 0.00001), (5, -1.5), (6, 1234567), (7, 999999.5), (8, inf), (9, NULL)", "CREATE TABLE f (id INT PRIMARY KEY, s TEXT)", "INSERT INTO f SELECT id, v FROM g", "CREATE TABLE b (id INT, ok BOOL)", "INSERT INTO b VALUES (10, true)", "INSERT INTO f SELECT id, ok FROM b")),
    "wal_restart": Case("SELECT * FROM copy", COPY, run=_rolled("wal"), before=("SELECT * FROM supplier LIMIT 0",)),
    "wal_torn": Case("SELECT * FROM copy", COPY + " UNION ALL SELECT -1, 'late', 0.5", run=_torn, before=("SELECT * FROM supplier LIMIT 0",)),
    "snapshot_restart": Case("SELECT * FROM copy", COPY, run=_rolled("snapshot"), before=("SELECT * FROM supplier LIMIT 0",)),
    "compact_restart": Case("SELECT * FROM copy", COPY + " UNION ALL SELECT -1, 'late', 0.5", run=_rolled("wal", True), before=("SELECT * FROM supplier LIMIT 0",)),
    "backup_recover": Case("SELECT * FROM copy", COPY, run=_recovered, before=("SELECT * FROM supplier LIMIT 0",)),
    "batch_plain": Case("SELECT s_suppkey FROM supplier", "SELECT * FROM (VALUES (0, '1 changed'), (1, 'UNSUPPORTED'), (2, 'NOT_FOUND'), (3, '1 changed'), (4, '2 rows')) AS t(i, answer)", run=_plain_batch),
    "limits": Case("SELECT s_suppkey FROM supplier", "SELECT * FROM (VALUES (0, '5 rows'), (1, 'RESULT_TOO_LARGE'), (2, 'INVALID_REQUEST'), (3, 'RESULT_TOO_LARGE')) AS t(i, answer)", run=_limited),
    "tx_nested": Case("SELECT s_suppkey FROM supplier", "SELECT * FROM (VALUES (0, '0 changed'), (1, (SELECT count(*) FROM supplier)::VARCHAR || ' changed'), (2, 'QUERY_ERROR'), (3, '1 rows'), (4, '0 changed'), (5, 'QUERY_ERROR')) AS t(i, answer)", run=_nested),
    "json_requests": Case("SELECT n_nationkey FROM nation", "SELECT n_nationkey::VARCHAR AS a, n_name AS b FROM nation WHERE n_nationkey < 5 UNION ALL SELECT * FROM (VALUES ('AUTH_REQUIRED', '-'), ('NOT_FOUND', '-'), ('-', 'ok'), ('INVALID_REQUEST', '-'))", run=_requests),
    "script_table": Case("SELECT r_regionkey FROM region", "SELECT 0 AS i, 'r_regionkey-+-r_name' AS line UNION ALL SELECT 1 + r_regionkey, r_regionkey::VARCHAR || ' | ' || r_name FROM region WHERE r_regionkey < 3 UNION ALL SELECT 4, '(3 row(s))' UNION ALL SELECT 5, 'error: column not found: nope'", run=_script),
    "statement_kinds": Case("SELECT n_nationkey FROM nation", "SELECT * FROM (VALUES (0, TRUE), (1, TRUE), (2, TRUE), (3, TRUE), (4, FALSE), (5, FALSE), (6, FALSE)) AS t(i, reads)", run=_kinds),
    "row_count": Case("SELECT n_nationkey FROM nation", "SELECT count(*) AS n FROM nation", run=_row_counts),
    "timeout": Case("SELECT r_regionkey FROM region", "SELECT 'TIMEOUT' AS code, count(*) AS n FROM region", run=_stopped),
    "tx_commit": Case("SELECT s_suppkey, s_name FROM supplier", "SELECT s_suppkey, CASE WHEN s_nationkey = 3 THEN 'moved' ELSE s_name END AS s_name FROM supplier WHERE s_acctbal >= 0", run=_commit),
    "tx_rollback": Case("SELECT s_suppkey FROM supplier", "SELECT s_suppkey FROM supplier", run=_rollback),
    "atomic_batch_failed": Case("SELECT s_suppkey FROM supplier", "SELECT s_suppkey FROM supplier", run=_failed_batch),
    "param_binding": Case("SELECT * FROM bound WHERE id >= ?", "SELECT CAST(1000000 AS BIGINT) AS id, 'it''s' AS name, CAST(2.5 AS DOUBLE) AS score, TRUE AS ok", params=(1000000,), run=_prepared),
}


def engine_on(spark: SparkSession, sf_dir: str, tables: tuple[str, ...] = TABLES) -> Engine:
    """An engine with test tables. Registering reads a file's schema, and no rows."""
    engine = Engine(spark)
    engine.paths = {name: f"{sf_dir}/{name}.parquet" for name in tables}
    for name, path in engine.paths.items():
        engine.register_parquet(name, path, KEYS.get(name))
    return engine


def _placed(df: DataFrame) -> DataFrame:
    """Rows of an ordered result with their places, from 1. They are counted by partition; a row for each goes to the driver."""
    kept = written_version(df.withColumn("__id", F.monotonically_increasing_id()), "placed")
    part, start, starts = F.shiftright("__id", 33), 0, []
    for r in sorted(kept.groupBy(part.alias("part")).count().collect()):
        starts.append((r["part"], start))
        start += r["count"]
    listed = df.sparkSession.createDataFrame(starts, "__part long, __start long")
    place = F.col("__start") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return kept.join(F.broadcast(listed), part == F.col("__part")).select(*df.columns, place.alias("place"))


def run(case: Case, spark: SparkSession, sf_dir: str) -> DataFrame:
    text = " ".join((case.sql, *case.before))
    named = tuple(t for t in TABLES if re.search(rf"\b{t}\b", text) or "SHOW TABLES" in text)
    engine = engine_on(spark, sf_dir, named)
    for sql in case.before:
        engine.execute(sql)
    given = case.run(engine) if case.run is not None else None
    if isinstance(given, DataFrame):
        return given
    engine = given or engine
    if case.sql.startswith("SELECT"):
        df = engine.query(case.sql, case.params, ordered=case.placed)
    else:
        df = engine.execute(case.sql, case.params).df
    if case.placed:
        return _placed(df)
    return df.toDF(*case.names) if case.names else df


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, case=case: run(case, spark, sf_dir)) for name, case in CASES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: case.oracle for name, case in CASES.items()}
