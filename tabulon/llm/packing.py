"""Packing documents into training sequences with a steady mixture of sources."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_batches, keyed_and_known, released, table, written

#: Tokens of a queue group (one task's share), entries of a worker's unit cache, least tokens a source is served with.
GROUP_TOKENS, CACHE_UNITS, GRAIN = 1 << 21, 400_000, 128
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: printable ones stand for themselves."""
    plain = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of a byte-level BPE vocabulary, unit by unit.

    A text is cut where a single space or line break stands between two other characters: the
    vocabulary's own pattern never joins across these, so units can be encoded alone and kept.
    Texts with other white space at such a place are encoded whole.
    """

    def __init__(self, vocabulary: str):
        import tiktoken

        letters = _byte_letters()
        spec = json.loads(vocabulary)
        special = {t["content"] for t in spec.get("added_tokens", ())}
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.whole = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.spaced: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}

    def _bytes(self, text: str) -> bytes:
        return np.array(self.whole(text), np.uint16).tobytes()

    def _unit(self, unit: str, spaced: bool) -> bytes:
        known = self.spaced if spaced else self.bare
        got = known.get(unit)
        if got is None:
            got = self._bytes(" " + unit if spaced else unit)
            if len(known) < CACHE_UNITS:
                known[unit] = got
        return got

    def _lines(self, unit: str, spaced: bool) -> bytes | None:
        """Ids of a unit that may hold line breaks; None where its edges don't part from their neighbours."""
        if not unit or unit[0].isspace() or unit[-1].isspace():
            return None
        if "\n" not in unit:
            return self._unit(unit, spaced)
        parts = unit.split("\n")
        if not all(p and not p[0].isspace() and not p[-1].isspace() for p in parts):
            return self._bytes(" " + unit if spaced else unit)
        line = self._unit("\n", False)
        return line.join([self._unit(parts[0], spaced), *(self._unit(p, False) for p in parts[1:])])

    def __call__(self, text: str) -> bytes:
        """Ids as little-endian 16-bit numbers."""
        for name, number in self.special.items():
            if name in text:
                return np.array([number], np.uint16).tobytes().join(self(part) for part in text.split(name))
        if not text:
            return b""
        units = text.split(" ")
        out = list(map(self.spaced.get, units))
        out[0] = self._lines(units[0], False)
        if out[0] is None:
            return self._bytes(text)
        while None in out:
            i = out.index(None)
            for i in range(i, len(out)):
                if out[i] is None:
                    got = self._lines(units[i], True)
                    if got is None:
                        return self._bytes(text)
                    out[i] = got
        return b"".join(out)


_encoders: dict[int, Encoder] = {}


def tokenized(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """``docs`` (rid, doc_id, text, source) to (rid, doc_id, source, n_tokens, ids): 16-bit ids, the end id last."""
    with open(tokenizer, encoding="utf-8") as file:
        vocabulary = docs.sparkSession.sparkContext.broadcast(file.read())
    end = np.array([end_id], np.uint16).tobytes()

    def run(batches):
        key = hash(vocabulary.value)
        encode = _encoders.get(key)
        if encode is None:
            encode = _encoders[key] = Encoder(vocabulary.value)
        for batch in byte_batches(batches, 8 << 20):
            ids = [(encode(t) if t else b"") + end for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["rid", "doc_id", "source", "n_tokens", "ids"])

    return docs.select("rid", F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text")).mapInArrow(run, "rid long, doc_id long, source string, n_tokens long, ids binary")


def windows_of(total: int, size: int):
    """Full windows, then powers of two for what is left, so nothing is padded."""
    for _ in range(total // size):
        yield size
    left = total % size
    for bit in reversed(range(left.bit_length())):
        if left >> bit & 1:
            yield 1 << bit


def round_robin(lengths: list[list[int]], share: list[float], owed: list[float], size: int, grain: int = GRAIN):
    """Deficit round-robin over source queues: yields (window, source, place in its queue, start, length, offset).

    Every window adds each source's share of it to what the source is owed. Sources owed at least a
    grain (or their document's end) are served in turn, what they get is taken off, and what is owed
    or overdrawn is carried into the next window. When nobody is owed a grain, the one owed most is
    served. A source that has run dry leaves its share to the others.
    """
    n = len(lengths)
    owed, head, begun = list(owed), [0] * n, [0] * n
    live = [s for s in range(n) if lengths[s]]
    turn = 0
    for window, size_here in enumerate(windows_of(sum(map(sum, lengths)), size)):
        weight = sum(share[s] for s in live)
        for s in live:
            owed[s] += size_here * (share[s] / weight if weight else 1 / len(live))
        offset = 0
        while offset < size_here:
            chosen = -1
            for step in range(len(live)):
                s = live[(turn + step) % len(live)]
                want = min(lengths[s][head[s]] - begun[s], size_here - offset)
                if owed[s] >= min(grain, want):
                    chosen = s
                    turn = (turn + step + 1) % len(live)
                    break
            else:
                chosen = max(live, key=lambda s: owed[s])
                want = min(lengths[chosen][head[chosen]] - begun[chosen], size_here - offset)
            take = min(want, max(grain, int(owed[chosen])))
            yield window, chosen, head[chosen], begun[chosen], take, offset
            owed[chosen] -= take
            offset += take
            begun[chosen] += take
            if begun[chosen] == lengths[chosen][head[chosen]]:
                head[chosen] += 1
                begun[chosen] = 0
                if head[chosen] == len(lengths[chosen]):
                    live.remove(chosen)
                    turn = turn % len(live) if live else 0


def _packing(size: int, shares: dict):
    def run(key, left, right):
        left = left.combine_chunks()
        names = left.column("source").to_pylist()
        count = left.column("n_tokens").to_numpy()
        order = np.lexsort((count, left.column("place").to_numpy()))
        own = sorted(set(names), key=lambda x: (x is None, x or ""))
        number = {s: i for i, s in enumerate(own)}
        queues: list[list[int]] = [[] for _ in own]
        for i in order.tolist():
            queues[number[names[i]]].append(i)
        carried = dict(zip(right.column("source").to_pylist(), right.column("owed").to_pylist()))
        raw = left.column("ids").combine_chunks() if isinstance(left.column("ids"), pa.ChunkedArray) else left.column("ids")
        ids: dict[int, np.ndarray] = {}
        bucket = key[0].as_py()
        out: list[tuple] = []
        lengths = [[int(count[i]) for i in q] for q in queues]
        for window, s, at, start, length, offset in round_robin(lengths, [shares.get(x, 0.0) for x in own], [carried.get(x, 0.0) for x in own], size):
            i = queues[s][at]
            if start == 0:
                ids[i] = np.frombuffer(raw[i].as_py(), np.uint16).astype("<u4")
            piece = ids[i][start : start + length].tobytes()
            if start + length == count[i]:
                del ids[i]
            out.append((left.column("doc_id")[i].as_py(), own[s], start, length, piece, int(count[i]), (bucket << 32) + window, offset))
        columns = list(zip(*out)) if out else [()] * 8
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "source", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, end_id: int = 0, weights: dict | None = None) -> DataFrame:
    """``docs`` (doc_id, text, source, any more columns) to pieces of sequences of ``size`` tokens.

    Columns: doc_id, source, start (ids of the document before the piece), length, ids (binary,
    little-endian 32-bit), doc_tokens, sequence_id and offset. All documents are packed, each followed
    by ``end_id``. Target proportions are each source's share of all tokens unless ``weights`` names
    others; a source that runs dry leaves its share to the rest. Documents are dealt by hash of their id, or
    where ids repeat or lack of their place in the table, into groups of about GROUP_TOKENS tokens, so a source with most rows, or rows that share
    an id or have none, are spread over all of them; what
    each source is owed from the groups before is known from their counts, and carried in. A group's
    last tokens fill windows of powers of two, which need no padding. Null texts are empty documents
    (their end id alone), null sources a source of their own; repeated rows are packed each for itself.
    """
    spark = docs.sparkSession
    rows, known = keyed_and_known(docs.select("doc_id", "text", "source"), numbers=False)
    # rows that share an id need no order here, only numbers of their own
    rows = rows.select("rid" if known else F.monotonically_increasing_id().alias("rid"), "row.*")
    tokens = written(tokenized(rows, tokenizer, end_id), "tokens")
    by_source = tokens.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()  # a row per source
    total = sum(r["n"] for r in by_source)
    shares = {r["source"]: (weights.get(r["source"], 0.0) if weights else r["n"] / total) for r in by_source}
    scale = sum(shares.values()) or 1.0
    shares = {s: x / scale for s, x in shares.items()}
    groups = max(1, -(-total // GROUP_TOKENS))
    place = F.xxhash64("rid")
    dealt = tokens.withColumn("place", place).withColumn("bucket", F.pmod("place", F.lit(groups)).cast("long"))
    sums = dealt.groupBy("bucket", "source").agg(F.sum("n_tokens").alias("n"))
    every = spark.range(groups).select(F.col("id").alias("bucket"), F.explode(F.sequence(F.lit(0), F.lit(max(0, len(shares) - 1)))).alias("i"))
    numbered = spark.createDataFrame([(i, s, float(x)) for i, (s, x) in enumerate(shares.items())], "i int, source string, share double")
    grid = every.join(numbered, "i").join(sums.withColumnRenamed("source", "s").withColumnRenamed("bucket", "b"), (F.col("bucket") == F.col("b")) & F.col("source").eqNullSafe(F.col("s")), "left")
    sofar = Window.partitionBy("i").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.select("bucket", "source", "share", F.coalesce(F.sum(F.coalesce("n", F.lit(0))).over(sofar), F.lit(0)).alias("before"))
    whole = grid.groupBy("bucket").agg(F.sum("before").alias("all_before"))
    owed = grid.join(whole, "bucket").select("bucket", "source", (F.col("share") * F.col("all_before") - F.col("before")).alias("owed"))
    released(spark)
    schema = "doc_id long, source string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return dealt.groupBy("bucket").cogroup(owed.groupBy("bucket")).applyInArrow(_packing(size, shares), schema)


def op6_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
