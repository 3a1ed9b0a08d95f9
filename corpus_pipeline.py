"""A training corpus from ``documents`` in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns a DataFrame, which is written and read again before the next one.

1. language: documents that the classifier rejects go;
2. near_duplicates: one document of each group of 0.8 or more stays;
3. repeats: passages of 200 bytes that occur twice are taken out of texts;
4. mix: documents are taken, left or repeated by the mix of sources;
5. tokens: token ids and what they decode to, as digests.

All stages but the last keep the columns of their input, whatever their names:
columns that a stage doesn't read are renamed on the way in and named again on
the way out.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.bpe import token_digests
from loomgraph.llm.jaccard import jaccard_join
from loomgraph.llm.langid import held_out, identify, learn
from loomgraph.llm.mixing import mix
from loomgraph.llm.suffixes import without_repeats
from loomgraph.session import cut, table

TOKENIZER = "byte_bpe_multi_50k.tiktoken"
#: fewer remembered pre-tokens than alone: executors still hold what the stages before left
CACHE = 150_000


def _sheltered(docs: DataFrame, reads: tuple[str, ...], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """stage(docs) with docs's own columns, none of which clashes with what the
    stage adds: only the columns that it reads keep their names in it."""
    inside = [name if name in reads else f"_own_{k}" for k, name in enumerate(docs.columns)]
    return stage(docs.toDF(*inside)).select(*inside).toDF(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier rejects.

    Null, empty and letterless texts are rejected; rows of equal text share
    their fate, whatever their other columns; without labelled rows every
    document is rejected; an empty table stays empty.
    """
    model = learn(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return _sheltered(docs, ("text",), lambda rows: identify(rows, model).where("not rejected"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class: that of the smallest doc_id, a null one
    last, and of the smallest hash of its text among equal ids.

    Classes are told apart by their texts, so documents that share an id but
    not their text are judged each for itself. Null, empty and wordless texts
    are classes of their own and stay, every row of them.
    """
    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    found = jaccard_join(docs, threshold=0.8, words=5).where("class_key is not null")
    first = found.groupBy("class_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(-1)).alias("id"), "text_hash")).alias("first"))
    keep = first.select(F.col("first.none").alias("_none"), F.col("first.id").alias("_id"), F.col("first.text_hash").alias("_hash"))

    def stage(rows: DataFrame) -> DataFrame:
        wordy = F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
        keys = ["_none", "_id", "_hash"]
        keyed = rows.where(wordy).withColumns({"_none": F.col("doc_id").isNull(), "_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), "_hash": text_hash})
        one = keyed.join(keep.hint("merge"), keys).dropDuplicates(keys)
        return one.select(*rows.columns).unionByName(rows.where(~wordy))

    return _sheltered(docs, ("doc_id", "text"), stage)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take repeated passages of 200 bytes out of the texts; n_chars, where it
    is a column, follows the text. Every row stays, with an empty text if all
    of it repeats; null texts stay null."""
    reads = ("doc_id", "text", "n_chars") if "n_chars" in docs.columns else ("doc_id", "text")

    def stage(rows: DataFrame) -> DataFrame:
        cleaned = without_repeats(rows, length=200)
        return cleaned.withColumn("n_chars", F.length("text").cast(rows.schema["n_chars"].dataType)) if "n_chars" in reads else cleaned

    return _sheltered(docs, reads, stage)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the mix takes, a row twice where it takes it twice. Texts of no
    words are never taken; the null source is a source."""

    def stage(rows: DataFrame) -> DataFrame:
        taken = mix(rows).where("taken > 0")
        return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), (F.col("taken") / F.col("size")).cast("int"))))

    return _sheltered(docs, ("doc_id", "text", "source"), stage)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and digests of every row's token ids, no other columns; a null text
    is empty."""
    return token_digests(docs.select("doc_id", "text"), public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN, CACHE)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeats", repeats),
    ("mix", mixed),
    ("tokens", tokens),
]

#: classifiers, token merges and similarity joins are beyond SQL: the tests
#: hold run() against a brute-force version
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
