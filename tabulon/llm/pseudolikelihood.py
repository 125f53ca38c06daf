"""Masked pseudo-likelihood: a bidirectional window network predicts every word from both sides."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binary_values, byte_batches, keyed, released, table, written
from .features import mixed, word_hashes, word_spans

#: Words whose id in the network is theirs alone (the most frequent of the whole corpus), ids that the others
#: share by hash (their own share of it comes from the full counts), classes of the two-step output, hidden units, and words seen on each side.
WORDS, SHARED, CLASSES, HIDDEN, REACH = 3072, 1024, 64, 24, 2
IDS = WORDS + SHARED
MEMBERS = IDS // CLASSES
#: Words of a training shard, words whose places are mixed together, and numbers of a network sent as one piece.
PLACES, RUN, PIECE = 1 << 21, 1 << 16, 1 << 14
#: Words whose full counts every task holds at most (16 bytes each), and steps of a doubling in which counts are ranked for that.
LISTED, STEPS = 1 << 19, 8
#: Scores whose exponentials, and sums of them, are far from the ends of a 32-bit float.
SAFE = 60.0
#: Bytes of text that are cut into words at once: numpy's arrays for them take some forty times that.
BLOCK = 1 << 20
OFFSETS = [o for o in range(-REACH, REACH + 1) if o]


@dataclass
class Net:
    """Context tables by offset (row IDS stands for no word), hidden shift, and the two output steps."""

    context: np.ndarray
    shift: np.ndarray
    classes: np.ndarray
    class_shift: np.ndarray
    members: np.ndarray
    member_shift: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.context, self.shift, self.classes, self.class_shift, self.members, self.member_shift]


def new_net(seed: int = 5) -> Net:
    random = np.random.default_rng(seed)
    draw = lambda *shape: random.normal(0, 0.1, shape).astype(np.float32)
    zero = lambda *shape: np.zeros(shape, np.float32)
    return Net(draw(len(OFFSETS), IDS + 1, HIDDEN), zero(HIDDEN), draw(HIDDEN, CLASSES), zero(CLASSES), draw(CLASSES, HIDDEN, MEMBERS), zero(CLASSES, MEMBERS))


def word_ids(data: np.ndarray, bounds: np.ndarray, vocabulary: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, id and hash of each word; ``vocabulary`` is sorted hashes, ``rank`` their ids."""
    start, end, text = word_spans(data, bounds)
    h = word_hashes(data, start, end, fold=True)
    ids = WORDS + (h % np.uint64(SHARED)).astype(np.int64)
    if len(vocabulary):
        at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
        known = vocabulary[at] == h
        ids[known] = rank[at[known]]
    return text, ids, h


def surroundings(text: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each word, the ids at each offset in its own text (IDS beyond its ends), as 16-bit numbers."""
    n = len(ids)
    out = np.full((len(OFFSETS), n), IDS, np.uint16)
    for row, o in zip(out, OFFSETS):
        a, b = max(0, -o), n - max(0, o)
        if b > a:
            row[a:b] = np.where(text[a + o : b + o] == text[a:b], ids[a + o : b + o], IDS)
    return out


def _hidden(net: Net, around: np.ndarray) -> np.ndarray:
    total = net.context[0].take(around[0], axis=0)
    for k in range(1, len(OFFSETS)):
        total += net.context[k].take(around[k], axis=0)
    total += net.shift
    return np.tanh(total, out=total)


def _reach(weights: np.ndarray, shift: np.ndarray) -> float:
    """What no score exceeds in size, as hidden values lie between -1 and 1."""
    return float((np.abs(weights).sum(axis=-2) + np.abs(shift)).max())


def _exponentials(z: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray | float]:
    """Turns rows of scores, in place, into exponentials; also the sum of each row, and what was taken off before.

    Scores of at most SAFE in size are exponentials as they are; from larger ones the row's largest is taken off.
    """
    top = 0.0
    if not reach <= SAFE:
        top = z.max(axis=1)
        z -= top[:, None]
    np.exp(z, out=z)
    return z @ np.ones(z.shape[1], z.dtype), top


def _by_class(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of places by the class of their words, and where each class begins in it."""
    kind = (ids % CLASSES).astype(np.uint8)
    return np.argsort(kind, kind="stable"), np.r_[0, np.cumsum(np.bincount(kind, minlength=CLASSES))]


def _scores(net: Net, h: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores of all classes, and of all words of a place's own class; the places of a class are a slice."""
    kinds = h @ net.classes
    kinds += net.class_shift
    words = np.empty((len(h), MEMBERS), h.dtype)
    for c in np.flatnonzero(np.diff(cuts)):
        own = words[cuts[c] : cuts[c + 1]]
        np.matmul(h[cuts[c] : cuts[c + 1]], net.members[c], out=own)
        own += net.member_shift[c]
    return kinds, words


def log_probabilities(net: Net, around: np.ndarray, ids: np.ndarray, step: int = 8192) -> np.ndarray:
    """Log of each word's probability given both sides: its class, then the word within its class."""
    out = np.empty(len(ids))
    reach = _reach(net.classes, net.class_shift), _reach(net.members, net.member_shift)
    for lo in range(0, len(ids), step):
        by, cuts = _by_class(ids[lo : lo + step])
        by += lo
        own, row = ids[by], np.arange(len(by))
        kinds, words = _scores(net, _hidden(net, around[:, by]), cuts)
        score = kinds[row, own % CLASSES].astype(float) + words[row, own // CLASSES]
        for z, most in zip((kinds, words), reach):
            total, top = _exponentials(z, most)
            score -= top + np.log(total)
        out[by] = score
    return out


class Trainer:
    """Adaptive gradient steps on batches of word places."""

    def __init__(self, net: Net, rate: float = 0.1):
        self.net = Net(*(p.copy() for p in net.parts()))
        self.rate = rate
        self.seen = [np.full(p.shape if p.ndim < 3 else p.shape[:2], 1e-6, np.float32) for p in net.parts()]

    def _move(self, k: int, slope: np.ndarray) -> None:
        self.seen[k] += slope * slope
        self.net.parts()[k][...] -= self.rate * slope / np.sqrt(self.seen[k])

    def step(self, around: np.ndarray, ids: np.ndarray) -> None:
        """One step on a batch, whose places are taken class by class so that each class is a slice."""
        net, n = self.net, len(ids)
        by, cuts = _by_class(ids)
        around, ids = around[:, by], ids[by]
        h = np.ones((n, HIDDEN + 1), net.shift.dtype)  # a last column of ones, whose slopes are those of the shifts
        h[:, :HIDDEN] = _hidden(net, around)
        row = np.arange(n)
        d, e = _scores(net, np.ascontiguousarray(h[:, :HIDDEN]), cuts)
        some = np.flatnonzero(np.diff(cuts))
        # rows of d and e are slopes times what is in scale: numbers of hidden units are fewer to multiply
        scale = []
        for z, own, most in ((d, ids % CLASSES, _reach(net.classes, net.class_shift)), (e, ids // CLASSES, _reach(net.members, net.member_shift))):
            total, _ = _exponentials(z, most)
            z[row, own] -= total
            scale.append((1 / (total * n))[:, None])
        back = np.empty((n, HIDDEN), h.dtype)
        grad = np.empty((len(some), HIDDEN + 1, MEMBERS), h.dtype)
        scaled = h * scale[1]
        for g, c in zip(grad, some):
            a, b = cuts[c], cuts[c + 1]
            np.matmul(e[a:b], net.members[c].T, out=back[a:b])
            np.matmul(scaled[a:b].T, e[a:b], out=g)
        back *= scale[1]
        back += (d @ net.classes.T) * scale[0]
        grad, slope = grad[:, :HIDDEN], grad[:, HIDDEN]
        self.seen[4][some] += np.einsum("chm,chm->ch", grad, grad) / MEMBERS
        grad *= (self.rate / np.sqrt(self.seen[4][some]))[:, :, None]
        net.members[some] -= grad
        self.seen[5][some] += slope * slope
        net.member_shift[some] -= self.rate * slope / np.sqrt(self.seen[5][some])
        slope = (h * scale[0]).T @ d
        self._move(2, slope[:HIDDEN])
        self._move(3, slope[HIDDEN])
        back *= 1 - h[:, :HIDDEN] ** 2
        self._move(1, back.sum(axis=0))
        columns = back.T.astype(float)
        for k in range(len(OFFSETS)):
            at, where = _places(around[k])
            total = np.stack([np.bincount(where, column, len(at)) for column in columns], axis=1).astype(back.dtype)
            self.seen[0][k, at] += np.einsum("ph,ph->p", total, total) / HIDDEN
            net.context[k, at] -= self.rate * total / np.sqrt(self.seen[0][k, at])[:, None]


def _places(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ids, sorted, and the place of each id among them; without sorting."""
    number = np.zeros(IDS + 1, np.int64)
    number[ids] = 1
    at = np.flatnonzero(number)
    number[at] = np.arange(len(at))
    return at, number[ids]


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, n): how often each word, by hash, stands in all the texts."""

    def run(batches):
        for batch in byte_batches(batches, BLOCK):
            data, bounds = binary_values(batch.column(0))
            start, end, _ = word_spans(data, bounds)
            h, n = np.unique(word_hashes(data, start, end, fold=True).view(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n.astype(np.int64))], names=["h", "n"])

    return docs.select(F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body")).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def round_places(doc_id: np.ndarray, text: np.ndarray, turn: int, rounds: int) -> np.ndarray:
    """The word places that round ``turn`` trains on; over all rounds each place once. ``text``: row of each place."""
    first = np.searchsorted(text, np.arange(len(doc_id)))
    shift = (mixed(doc_id.view(np.uint64)) % np.uint64(rounds)).astype(np.int64)
    return np.flatnonzero((np.arange(len(text)) - first[text] + shift[text]) % rounds == turn)


@dataclass
class Model:
    """The network, and what turns the probability of a shared id into that of a word.

    ``counts`` (h, n) is the full count table, left on the executors; ``shared`` is how many words of
    the corpus fell on each shared id. Of a shared id's probability, a word that stands n times takes
    n / (shared + 1), and all words never counted take 1 / (shared + 1).
    """

    vocabulary: np.ndarray
    rank: np.ndarray
    net: Net
    counts: DataFrame
    shared: np.ndarray
    #: Sorted hashes of the words most often counted, and the logarithms of their counts.
    listed: np.ndarray
    listed_log: np.ndarray


def shared_id(h: str = "h") -> Column:
    """Which shared id the word of hash ``h`` (a signed long) falls on, from 0."""
    return F.col(h).bitwiseAND(F.lit(SHARED - 1)).cast("int")


def listed_counts(counts: DataFrame, most: int = LISTED) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of the most frequent words, at most ``most``: those above a count that a histogram gives.

    The histogram has a few hundred rows however many words there are, as it ranks counts by powers of two and steps between.
    """
    step = F.floor(F.log2("n") * STEPS)
    held, least = 0, None
    for row in sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True):
        held += row["count"]
        if held > most:
            break
        least = row["step"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    found = counts.where(step >= least).toArrow()
    h = found.column("h").to_numpy().view(np.uint64)
    order = np.argsort(h)
    return h[order], found.column("n").to_numpy()[order]


def shard_ids(rows: DataFrame, vocabulary: np.ndarray, rank: np.ndarray, shards: int) -> DataFrame:
    """``rows`` (rid, text) to a written table (shard, rid, ids): 16-bit ids of all words, dealt to shards by hash of rid."""
    shared = rows.sparkSession.sparkContext.broadcast((vocabulary, rank))

    def run(batches):
        for part in byte_batches(batches, BLOCK):
            text, ids, _ = word_ids(*binary_values(part.column(1)), *shared.value)
            cut = np.searchsorted(text, np.arange(part.num_rows + 1)) * 2
            raw = pa.py_buffer(ids.astype("<u2").tobytes())
            packed = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(cut.astype(np.int32).tobytes()), raw])
            yield pa.RecordBatch.from_arrays([part.column(0), packed], names=["rid", "ids"])

    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    ids = rows.select("rid", body.alias("body")).mapInArrow(run, "rid long, ids binary").where(F.octet_length("ids") > 0)
    return written(ids.select(F.pmod(F.xxhash64("rid"), F.lit(shards)).cast("long").alias("shard"), "rid", "ids"), "ids")


def train_shard(start: Net, rid: np.ndarray, texts: list[np.ndarray], turn: int, rounds: int, batch: int, rate: float) -> tuple[Net, int]:
    """The network after one pass over the round's places of a shard's texts, in the order of rid, and how many there were."""
    trainer, places = Trainer(start, rate), 0
    order = np.argsort(rid, kind="stable")
    sizes = np.array([len(texts[i]) for i in order])
    part = (np.cumsum(sizes) - sizes) // RUN  # whole texts, RUN words or more at once
    for p in np.unique(part):
        own = order[part == p]
        ids = np.concatenate([texts[i] for i in own]).astype(np.int64)
        text = np.repeat(np.arange(len(own)), [len(texts[i]) for i in own])
        around = surroundings(text, ids)
        chosen = round_places(rid[own], text, turn, rounds)
        mix = chosen[np.argsort(mixed(np.arange(len(chosen), dtype=np.uint64)))]
        for lo in range(0, len(mix), batch):
            some = mix[lo : lo + batch]
            trainer.step(around[:, some], ids[some])
        places += len(chosen)
    return trainer.net, places


def train(docs: DataFrame, rounds: int = 2, batch: int = 4096, rate: float = 0.1, places: int = PLACES, listed: int = LISTED) -> Model:
    """Counts the words of all texts, then trains on every place of every text, each in one of the rounds.

    Texts are dealt by hash to shards of about ``places`` words, which depend on nothing but the corpus. In each
    round every shard trains the common network on its texts, one after another; the shards' parameters are
    averaged by the places they saw, on the executors and in the order of shards, and become the next
    round's network, so reruns agree however the corpus is stored. What is trained on and sent grows with the
    corpus; what reaches the driver is one network and the counts of at most ``listed`` words.
    """
    spark = docs.sparkSession
    counts = written(word_counts(docs), "words")
    most = counts.orderBy(F.desc("n"), "h").limit(WORDS).toArrow()
    top = most.column("h").to_numpy().view(np.uint64)
    order = np.argsort(top)
    vocabulary, rank = top[order], order.astype(np.int64)
    shared_counts = np.zeros(SHARED, np.int64)
    for row in counts.groupBy(shared_id().alias("i")).agg(F.sum("n").alias("n")).collect():
        shared_counts[row["i"]] = row["n"]
    words = int(shared_counts.sum())
    np.subtract.at(shared_counts, (top % np.uint64(SHARED)).astype(np.int64), most.column("n").to_numpy())
    net = new_net()
    shards = max(1, -(-words // places))
    table_ = shard_ids(keyed(docs.select("doc_id", "text")).select("rid", "row.text"), vocabulary, rank, shards)
    released(spark)
    for turn in range(rounds if words else 0):
        shared = spark.sparkContext.broadcast(net)

        def run(rows: pa.Table) -> pa.Table:
            rows = rows.combine_chunks()
            texts = [np.frombuffer(x.as_buffer(), "<u2") for x in rows.column("ids")]
            trained, seen = train_shard(shared.value, rows.column("rid").to_numpy(), texts, turn, rounds, batch, rate)
            flat = [(k, lo, p.ravel()[lo : lo + PIECE]) for k, p in enumerate(trained.parts()) for lo in range(0, p.size, PIECE)]
            n, shard = len(flat), rows.column("shard")[0].as_py()
            return pa.table({"k": pa.array([f[0] for f in flat], pa.int32()), "lo": pa.array([f[1] for f in flat], pa.int64()), "shard": pa.array([shard] * n, pa.int64()), "places": pa.array([seen] * n, pa.int64()), "piece": pa.array([(f[2].astype(float) * seen).astype(np.float32).tobytes() for f in flat], pa.binary())})

        def add(rows: pa.Table) -> pa.Table:
            rows = rows.sort_by("shard")
            total = sum(np.frombuffer(x, np.float32).astype(float) for x in rows.column("piece").to_pylist())
            return pa.table({"k": rows.column("k")[:1], "lo": rows.column("lo")[:1], "shard": rows.column("shard")[:1], "places": pa.array([sum(rows.column("places").to_pylist())], pa.int64()), "piece": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

        schema = "k int, lo long, shard long, places long, piece binary"
        pieces = table_.groupBy("shard").applyInArrow(run, schema)
        # a first sum over at most 64 shards' pieces each, then the sum of these
        pieces = pieces.withColumn("part", F.floor(F.col("shard") / 64))
        pieces = pieces.groupBy("k", "lo", "part").applyInArrow(lambda t: add(t), schema).groupBy("k", "lo").applyInArrow(lambda t: add(t), schema)
        parts = [np.zeros(p.size) for p in net.parts()]
        for row in pieces.toArrow().to_pylist():
            piece = np.frombuffer(row["piece"], np.float32).astype(float)
            parts[row["k"]][row["lo"] : row["lo"] + len(piece)] = piece / max(row["places"], 1)
        net = Net(*(p.reshape(old.shape).astype(np.float32) for p, old in zip(parts, net.parts())))
        del pieces
        released(spark)
    frequent, n = listed_counts(counts, listed)
    return Model(vocabulary, rank, net, counts, shared_counts, frequent, np.log(n))


def log_likelihoods(model: Model, docs: DataFrame) -> DataFrame:
    """``docs`` (rid, a unique long, and text) to (rid, n_words, log_likelihood); 0 for texts without words.

    One pass gives a row per text, with all that the network and the listed counts tell, and a row per different
    word of a shared id in it that is not listed. The latter meet the full counts by the word's hash: no such
    word is more frequent than the least of those listed, so no key is hot.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.vocabulary, model.rank, model.net, np.log(model.shared + 1.0), model.listed, model.listed_log))

    def run(batches):
        vocabulary, rank, net, sizes, listed, listed_log = shared.value
        for part in byte_batches(batches, BLOCK):
            rid = part.column(0).to_numpy()
            where, ids, h = word_ids(*binary_values(part.column(1)), vocabulary, rank)
            value = log_probabilities(net, surroundings(where, ids), ids)
            rare = np.flatnonzero(ids >= WORDS)
            value[rare] -= sizes[ids[rare] - WORDS]
            if len(listed):
                at = np.minimum(np.searchsorted(listed, h[rare]), len(listed) - 1)
                found = listed[at] == h[rare]
                value[rare[found]] += listed_log[at[found]]
                rare = rare[~found]
            whole = np.bincount(where, minlength=part.num_rows), np.bincount(where, value, part.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(mixed(rid.view(np.uint64)).view(np.int64)), pa.array(np.zeros(len(rid), bool)), pa.array(whole[0], pa.int64()), pa.array(whole[1])], names=names)
            rare = rare[np.lexsort((h[rare], where[rare]))]
            if len(rare):
                at, word = where[rare], h[rare]
                heads = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (word[1:] != word[:-1])])
                n = np.diff(np.r_[heads, len(rare)])
                yield pa.RecordBatch.from_arrays([pa.array(rid[at[heads]]), pa.array(word[heads].view(np.int64)), pa.array(np.ones(len(n), bool)), pa.array(n, pa.int64()), pa.array(np.zeros(len(n)))], names=names)

    names = ["rid", "h", "word", "n", "value"]
    parts = docs.select("rid", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body")).mapInArrow(run, "rid long, h long, word boolean, n long, value double")
    # a word that was counted once, or never, has a logarithm of 0 to add
    known = model.counts.where("n > 1").select(F.col("h").alias("_h"), F.lit(True).alias("_word"), F.log("n").alias("share"))
    parts = parts.join(known, (F.col("h") == F.col("_h")) & (F.col("word") == F.col("_word")), "left")
    words = F.sum(F.when(F.col("word"), 0).otherwise(F.col("n")))
    value = F.sum(F.when(F.col("word"), F.col("n") * F.coalesce("share", F.lit(0.0))).otherwise(F.col("value")))
    return parts.groupBy("rid").agg(words.alias("n_words"), value.alias("log_likelihood"))


def scored(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` (doc_id, text, any more columns) with n_words, log_likelihood and per_word, one row per input row.

    log_likelihood sums the conditional log-probabilities of all words of the whole text, each given
    the words on both sides of it, and each with a probability of its own however rare it is; per_word
    divides by n_words (null where there is none). Null and empty texts score 0; columns with these names
    are replaced. Without a model, one is trained on the same documents.
    """
    model = model or train(docs)
    rows = keyed(docs)
    found = log_likelihoods(model, rows.select("rid", F.col("row.text").alias("text")))
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("n_words", "log_likelihood", "per_word")]
    rows = rows.join(found, "rid").select(*kept, "n_words", "log_likelihood")
    return rows.withColumn("per_word", F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words")))


def op2_pseudo_likelihood(spark, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "log_likelihood", "per_word")
