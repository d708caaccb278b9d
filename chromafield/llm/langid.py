"""Language by rank-order profiles (Cavnar and Trenkle, 1994).

A profile is the list of the most frequent letter n-grams, one to three letters with word
edges, by falling frequency.  A text's profile is compared to each language's by the
out-of-place distance: the sum over the text's n-grams of how far each one's rank is from its
rank in the language, or ``PROFILE`` where the language lacks it.  The nearest language wins.

Profiles are learned from at most ``per_lang`` labelled rows per language, whole texts, counted
by Spark; prediction reads whole texts and nothing but the text.

Defined results: ``und`` with score 0 where the text is null or has no letter, or where nothing
was learned; equally frequent n-grams rank by code point, equally near languages by name; rows
that repeat an id or a text are judged each for itself; very long texts are read whole; an empty table
gives an empty result.  Names that begin with ``__`` are reserved.  Result columns replace input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chromafield.llm.rows import with_text_columns
from chromafield.session import broadcast_if_small

PROFILE = 400
PER_LANG = 1_000
CHAR_BITS = 21
TWO = 1 << 62  # tells two letters from three; letters need 18 bits
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """Which code points are letters."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def ngrams(text: str | None, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams as numbers, ascending, and their counts.  An edge of a word is 0."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le"), np.uint32).astype(np.int64)
    is_letter = letters[codes]
    if not is_letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    codes[~is_letter] = 0
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # one edge after each word
    codes = np.concatenate([[0], codes[keep], [0]])
    two = (codes[:-1] << CHAR_BITS) | codes[1:]
    three = (two[:-1] << CHAR_BITS) | codes[2:]
    inside = codes[1:-1] != 0
    found = np.concatenate(
        [codes[codes != 0], two[(codes[:-1] != 0) | (codes[1:] != 0)] | TWO, three[inside]]
    )
    return np.unique(found, return_counts=True)


def top(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The profile: most frequent first, equal ones by code."""
    order = np.sort((counts.max(initial=0) - counts) * (len(counts) + 1) + np.arange(len(counts)))
    return grams[order[:PROFILE] % (len(counts) + 1)]


class Profiles:
    """Ranks of every learned n-gram in every language."""

    def __init__(self, profiles: dict[str, list[int]]):
        self.names = sorted(profiles)
        self.grams = np.unique(np.array([g for p in profiles.values() for g in p], np.int64))
        self.ranks = np.full((len(self.grams) + 1, len(self.names)), -1, np.int64)
        for i, name in enumerate(self.names):
            own = np.array(profiles[name], np.int64)
            self.ranks[np.searchsorted(self.grams, own), i] = np.arange(len(own))

    def predict(self, text: str | None, letters: np.ndarray) -> tuple[str, float]:
        """Language and how much nearer it is than the second, from 0.5 to 1."""
        grams, counts = ngrams(text, letters)
        if not len(grams) or not self.names:
            return UNKNOWN, 0.0
        own = top(grams, counts)
        at = np.searchsorted(self.grams, own)
        at[at == len(self.grams)] = 0
        at[self.grams[at] != own] = len(self.grams)
        ranks = self.ranks[at]
        away = np.where(ranks < 0, PROFILE, np.abs(ranks - np.arange(len(own))[:, None])).sum(0)
        best = int(away.argmin())
        second = min((int(d) for i, d in enumerate(away) if i != best), default=PROFILE * len(own))
        return self.names[best], 0.5 + 0.5 * (second - int(away[best])) / max(second, 1)


def learn(
    docs: DataFrame,
    usable: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_lang: int = PER_LANG,
) -> Profiles:
    """Profiles of the languages of the ``usable`` rows."""
    pick = F.xxhash64("__id", F.lit("langid"))
    ids = docs.where(usable & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("__id"), F.col(lang_col).alias("__lang")
    )
    # the share of the hashes that holds about twice the rows wanted: only these are ranked
    sizes = ids.groupBy("__lang").agg(F.count(F.lit(1)).alias("__size"))
    share = F.lit(2.0 * per_lang + 20) / F.col("__size")
    by_hash = Window.partitionBy("__lang").orderBy(pick, "__id")
    chosen = (
        ids.join(broadcast_if_small(sizes), "__lang")
        .where(pick.cast("double") / F.lit(2.0**64) + F.lit(0.5) <= share)
        .withColumn("__n", F.row_number().over(by_hash))
        .where(F.col("__n") <= per_lang)
        .select("__id", "__lang")
    )
    # per_lang ids per language
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(
        F.broadcast(chosen), "__id"
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letter_table()
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                grams, counts = ngrams(text, letters)
                for part, values in zip(out, ([lang] * len(grams), grams, counts)):
                    part.extend(values)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())],
                names=["lang", "gram", "n"],
            )

    by_count = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    ranked = (
        rows.select("__lang", "__text")
        .mapInArrow(count, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
        .withColumn("rank", F.row_number().over(by_count))
        .where(F.col("rank") <= PROFILE)
    )
    profiles: dict[str, list[int]] = {}
    for row in ranked.orderBy("lang", "rank").select("lang", "gram").collect():  # PROFILE per language
        profiles.setdefault(row["lang"], []).append(row["gram"])
    return Profiles(profiles)


def identify(
    docs: DataFrame, profiles: Profiles, text_col: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``."""
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    # PROFILE numbers per language
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def make():
        letters = letter_table()

        def run(texts: pa.Array) -> list[pa.Array]:
            found = [shared.value.predict(t, letters) for t in texts.to_pylist()]
            return [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]

        return run

    return with_text_columns(docs, text_col, fields, make, keep)
