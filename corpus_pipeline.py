"""A corpus made ready for training: quality, near-duplicates, repeated passages, mixture, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm import mixing, packing, quality, simhash, suffixes
from tabulon.llm.common import written

#: Documents scoring below this are rejected.
QUALITY_THRESHOLD = 0.3
#: Near-duplicates: words of a SimHash shingle (each counted once) and most differing bits of a candidate pair, and the
#: exact Jaccard of five-word shingles that confirms it. Of the pairs of different texts with a five-word similarity of
#: 0.8 or more in the test tables, four words with repeats and 4 bits, as in the registered query, find few; two words
#: and 8 bits find 92 %, single words and 8 bits 98 %.
NEAR_SHINGLE, NEAR_REPEATS, NEAR_BITS = 1, False, 8
NEAR_WORDS, NEAR_SIMILARITY = 5, 0.8
#: Length in bytes of the repeated strings that are removed.
REPEAT_BYTES = 100


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Null and empty texts, and texts without words, get one score and stay or go together; equal texts too. Rows that
    repeat, share an id or have none are judged each for itself. Without labels every text has the same score, a half,
    and stays. Extra columns pass unchanged; no rows give no rows.
    """
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(quality.quality_score(model, spark, F.col("text")) >= QUALITY_THRESHOLD)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of near-duplicates.

    Rows that share an id, or have none, are documents of their own; a null id comes after all others, and of equal
    ids the text that sorts first comes first. Null texts, empty texts and texts without words are copies of
    each other. Extra columns pass unchanged; no rows give no rows.
    """
    return simhash.near_dedup(docs, NEAR_SHINGLE, NEAR_BITS, NEAR_SIMILARITY, NEAR_WORDS, NEAR_REPEATS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that already stand earlier in the corpus; documents stay, if only empty.

    Earlier means a smaller doc_id, null last, and of equal ids the text that sorts first; so of rows that repeat the
    first keeps its passages. Null texts, and texts of which nothing is cut, stay as they are; n_chars counts what is
    left (null: 0). Extra columns pass unchanged; no rows give no rows.
    """
    cut = suffixes.cut_repeats(docs, REPEAT_BYTES, "text")
    text = F.when(F.col("cut.n_removed") == 0, F.col("row.text")).otherwise(F.col("cut.kept"))
    changed = {"text": text, "n_chars": F.coalesce(F.length(text), F.lit(0)).cast("long")}
    return cut.select(*(changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it.

    Null and empty texts have no words and are taken no time; a null source is a source. Rows that repeat, share an id
    or have none are documents of their own. Extra columns pass unchanged; no rows give no rows.
    """
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of 1024-token sequences.

    A null or empty text is a document of its end token alone; rows that repeat, share an id or have none are packed
    each for itself; a null source is a queue of its own. Extra columns are left out; no rows give no pieces.
    """
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", keep_quality),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("mix_sources", mix_sources),
    ("packing", pack_sequences),
]
#: SQL can express neither the trained classifier nor the packing; tests/llm tests the pipeline instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
