"""A training corpus from raw documents: five stages, each on all that the one before it kept.

``STAGES`` lists ``(name, function)``; a function takes ``(spark, docs, sf_dir)`` and returns a
DataFrame.  All stages but the last return the columns of ``documents``; the last adds the
token ids, their number and whether they decode to the text, in place of the text.

Defined results: a null text counts as empty; empty texts are one group of copies, and one of them
goes on.  Of rows that repeat an id with an equal text one goes on; rows of one id with different
texts are documents of their own up to the near-duplicate stage.  A row without an id
stays if no row with an id has its text.  A document that mixing takes twice is two rows.  Texts of any length are processed whole.
An empty table gives an empty result.  Extra columns go along; one that is named like a result of
the last stage (``token_ids, n_tokens, round_trip``) is replaced, all others come out as they were.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chromafield.llm import bpe, exact_dedup, mixing, near_dedup, queries, toxicity
from chromafield.llm.rows import shielded
from chromafield.session import scratch_path

# stages that read the classifier's labels and write intermediate tables have no SQL form
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = queries.toxicity_model(spark, docs, sf_dir)
    given, back = shielded(docs, ("score", "predicted"))
    return toxicity.score(given, model).where("predicted = 0").select(back)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts that with the largest id stays."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts similar by five-word shingles, 0.8 and more, that with the smallest id stays."""
    return near_dedup.deduplicate(docs, size=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's budget takes them."""
    given, back = shielded(docs, ("domain", "tokens", "epoch"))
    return mixing.mix(given, queries.MIXTURE, queries.source_domain(), queries.word_count()).select(back)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, with a round trip through the decoder checked for every document."""
    path = public_tokenizers.path(queries.VOCABULARY)
    own = ("token_ids", "decoded", "n_tokens", "round_trip")
    given = docs.drop(*own)
    encoded = bpe.decode(bpe.encode(given, path, public_tokenizers.PATTERN), path)
    exact = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return encoded.select(
        *[c for c in given.columns if c != "text"],
        "token_ids",
        F.size("token_ids").cast("long").alias("n_tokens"),
        exact.alias("round_trip"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("minhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again."""
    docs = queries.documents(spark, sf_dir)
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
