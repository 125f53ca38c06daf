import io

import pytest

from tabulon.cli import run_script, text_table
from tabulon.errors import SqlError
from tabulon.session import Engine
from tabulon.sources.storage import Log, Store

SCRIPT = ("CREATE TABLE t (id INT PRIMARY KEY, s TEXT, ok BOOL)", "INSERT INTO t VALUES (1, 'é <b>;''q', true), (2, NULL, NULL)", "CREATE INDEX i ON t (s)", "DELETE FROM t WHERE id = 2", "CREATE TABLE empty (id INT)")


def state(engine):
    return engine.execute("SELECT * FROM t").rows(), engine.execute("SHOW TABLES").rows(), engine.execute("SHOW INDEX FROM t").rows()


@pytest.mark.parametrize("mode", ["wal", "snapshot"])
def test_survives_a_restart(spark, tmp_path, mode):
    engine = Engine(spark, mode, str(tmp_path))
    engine.session().until_error(SCRIPT)
    engine.execute("INSERT INTO t VALUES (?, ?, ?)", [1_000_000, "it's", False])
    again = Engine(spark, mode, str(tmp_path))
    assert state(again) == state(engine)
    again.compact()
    assert Store(str(tmp_path)).log.read() == []
    again.execute("INSERT INTO t VALUES (5, 'five', true)")
    assert state(Engine(spark, mode, str(tmp_path))) == state(again)


@pytest.mark.parametrize("mode", ["wal", "snapshot"])
def test_registered_files_survive_too(spark, tmp_path, mode):
    spark.range(5).selectExpr("id", "concat('n', id) AS name").coalesce(1).write.parquet(str(tmp_path / "files"))
    engine = Engine(spark, mode, str(tmp_path / "db"))
    engine.register_parquet("F", str(tmp_path / "files"), "id")
    engine.execute("DELETE FROM f WHERE id = 2")
    engine.execute("INSERT INTO f VALUES (9, 'new')")
    want = [(0, "n0"), (1, "n1"), (3, "n3"), (4, "n4"), (9, "new")]
    assert Engine(spark, mode, str(tmp_path / "db")).execute("SELECT * FROM f").rows() == want
    assert spark.read.parquet(str(tmp_path / "files")).count() == 5


def test_failed_and_rolled_back_statements_are_not_kept(spark, tmp_path):
    engine = Engine(spark, "wal", str(tmp_path))
    session = engine.session()
    session.until_error(SCRIPT)
    with pytest.raises(SqlError):
        session.execute("INSERT INTO t VALUES (1, 'x', true)")
    session.until_error(["BEGIN", "DELETE FROM t", "ROLLBACK", "BEGIN", "INSERT INTO t VALUES (7, 's', true)", "COMMIT"])
    assert len(Store(str(tmp_path)).log.read()) == len(SCRIPT) + 1


def test_log_cut_at_every_byte(tmp_path):
    batches = [["a", {"register": ["t", "p", None]}], ["b\nb é"], ["c", "d", "e"]]
    log = Log(tmp_path / "w.log")
    for batch in batches:
        log.append(batch)
    whole = log.path.read_bytes()
    ends = [i + 1 for i, c in enumerate(whole) if c == 10]
    for cut in range(len(whole) + 1):
        log.path.write_bytes(whole[:cut])
        want = [r for batch, end in zip(batches, ends) if end <= cut for r in batch]
        again = Log(log.path)
        assert again.read() == want
        again.append(["next"])
        assert Log(log.path).read() == [*want, "next"]
        fresh = Log(log.path)  # a writer that never read
        fresh.append(["more"])
        assert Log(log.path).read() == [*want, "next", "more"]
    log.path.write_bytes(whole + b"\0" * 50 + b"\n")
    assert Log(log.path).read() == [r for b in batches for r in b]


class Stop(Exception):
    """The process ends here."""


def stopping(monkeypatch, at):
    """Ends the process before the ``at``-th step that changes the data folder."""
    from tabulon.sources import storage

    steps = iter(range(10**6))
    for owner, name in ((storage, "_synced"), (storage, "_sync_tree"), (storage.shutil, "rmtree"), (storage.shutil, "copytree"), (storage.os, "replace"), (storage.Path, "unlink"), (storage.Path, "mkdir")):
        def guarded(*args, _real=getattr(owner, name), **kwargs):
            if next(steps) >= at:
                raise Stop
            return _real(*args, **kwargs)

        monkeypatch.setattr(owner, name, guarded)


@pytest.mark.parametrize("what", ["compact", "recover"])
def test_stopped_at_every_step(spark, tmp_path, what):
    for at in range(40):
        folder = tmp_path / str(at)
        engine = Engine(spark, "wal", str(folder))
        engine.session().until_error(["CREATE TABLE t (s TEXT)", "INSERT INTO t VALUES ('a'), ('a')"])
        engine.compact()
        engine.store.backup()
        backed = [("a",), ("a",)]
        engine.execute("INSERT INTO t VALUES ('b')")
        before = engine.execute("SELECT * FROM t").rows()
        with pytest.MonkeyPatch.context() as patch:
            stopping(patch, at)
            try:
                getattr(engine, what)()
                done = True
            except Stop:
                done = False
        after = Engine(spark, "wal", str(folder))
        got = after.execute("SELECT * FROM t").rows()
        assert got in ([before] if what == "compact" else [before, backed])
        if what == "recover" and done:
            assert got == backed
        after.execute("INSERT INTO t VALUES ('c')")
        assert Engine(spark, "wal", str(folder)).execute("SELECT * FROM t").rows() == [*got, ("c",)]
        if done:
            return
    raise AssertionError("more steps than expected")


def test_backups_are_taken_again_and_again(spark, tmp_path):
    import time

    engine = Engine(spark, "wal", str(tmp_path))
    engine.session().until_error(SCRIPT)
    stop = engine.backups_every(0.1)
    until = time.time() + 30
    while len(engine.store.backups()) < 2 and time.time() < until:
        time.sleep(0.1)
    stop()
    n = len(engine.store.backups())
    assert n >= 2
    before = state(engine)
    engine.execute("DELETE FROM t")
    engine.recover()
    assert state(engine) == before and len(engine.store.backups()) == n


def test_log_damage(tmp_path):
    log = Log(tmp_path / "wal.log")
    log.append(["a"])
    log.append(["b\nb", "c"])
    assert log.read() == ["a", "b\nb", "c"]
    whole = log.path.read_bytes()
    log.path.write_bytes(whole[:-3])  # cut off in writing: the whole batch
    assert log.read() == ["a"]
    log.path.write_bytes(whole.replace(b'"a"', b'"x"'))
    with pytest.raises(SqlError, match="damaged log record 1"):
        log.read()


def test_backup_and_recovery(spark, tmp_path):
    engine = Engine(spark, "wal", str(tmp_path))
    engine.session().until_error(SCRIPT)
    with pytest.raises(SqlError, match="no timestamped backups"):
        engine.recover()
    engine.compact()
    before = state(engine)
    backup = engine.store.backup()
    engine.execute("DELETE FROM t")
    engine.recover()
    assert state(engine) == before == state(Engine(spark, "wal", str(tmp_path)))
    victim = next(p for p in backup.rglob("*.parquet"))
    victim.write_bytes(victim.read_bytes() + b"x")
    with pytest.raises(SqlError, match="backup checksum mismatch"):
        engine.recover()


def test_script_and_table(spark):
    out = io.StringIO()
    failed = run_script(Engine(spark), "; ".join(SCRIPT) + "; SELECT id, s FROM t; SELECT nope FROM t", out)
    assert failed == 1 and " 1 | é <b>;'q" in out.getvalue() and "error: column not found: nope" in out.getvalue()
    assert text_table(["n", "s"], [(1, "a"), (None, None)]).splitlines()[1:] == ["   1 | a   ", "NULL | NULL", "(2 row(s))"]
