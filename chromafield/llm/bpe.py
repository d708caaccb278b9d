"""Byte-level BPE as a reduction over a tree of text halves.

A text longer than a leaf is halved again and again; leaves are encoded by the vocabulary's
merge ranks, and two neighbours are joined by encoding a window around their seam anew.  The
window grows until both of its edges are places where the splitting pattern always ends a
match, whatever stands on either side.  Tokens outside such a window cannot change, so the
join is the encoding of the joined text, the operation is associative, and the shape of the
tree does not matter.  Where a text has no such place the window grows to the whole of it.

A match ends for certain (``SAFE``) between a letter or digit and ASCII white space, between an
ASCII letter and an ASCII digit, and between either and ASCII punctuation that follows: every
alternative of the pattern keeps to one class of characters, but for one leading space and for
an apostrophe before letters, and none of these places lies in either.

Decoding looks up each token's bytes and concatenates them up the same kind of tree.

The vocabulary's path is a parameter.  The driver reads the file, whose size the vocabulary
fixes, and broadcasts it.  Defined results: a null text encodes as an empty one and decodes to
no bytes; a null list of ids decodes to null; rows that repeat an id or a text are encoded each for
itself; an empty table gives an empty result.  Names that begin with ``__`` are reserved.  Result columns replace input columns of the
same name.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chromafield.llm.rows import BATCH_ROWS, prepare, with_text_columns

LEAF_CHARS = 4_096
WINDOW_CHARS = 64

_SIGNS = r"!-/:-@\[-`{-~"
#: zero-width places at which every match that began before has ended
SAFE = re.compile(
    rf"(?<=[^\W_])(?=[ \n\r\t])|(?<=[A-Za-z])(?=[0-9{_SIGNS}])|(?<=[0-9])(?=[A-Za-z{_SIGNS}])"
)


def read_ranks(path: str) -> dict[bytes, int]:
    """Merge ranks of a vocabulary file with one ``base64 rank`` per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}


class Encoder:
    """Leaves, seams and the tree over them."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF_CHARS, window: int = WINDOW_CHARS):
        self.coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values(), default=-1) + 1, np.int64)
        for word, rank in ranks.items():
            self.sizes[rank] = len(word)
        self.leaf, self.window = leaf, window

    def leaf_ids(self, text: str) -> np.ndarray:
        return np.array(self.coder.encode_ordinary(text), np.int32)

    def encode(self, text: str, start: int = 0, end: int | None = None) -> np.ndarray:
        """Ids of ``text[start:end]``."""
        end = len(text) if end is None else end
        if end - start <= self.leaf:
            return self.leaf_ids(text[start:end])
        seam = (start + end) // 2
        left, right = self.encode(text, start, seam), self.encode(text, seam, end)
        return self.join(text, start, seam, end, left, right)

    def join(self, text: str, start: int, seam: int, end: int, left: np.ndarray, right: np.ndarray):
        """Ids of ``text[start:end]`` from those of its parts before and after ``seam``."""
        first, last = self.edges(text, start, seam, end)
        outer = len(left) - self._tokens(left[::-1], text[first:seam])
        inner = self._tokens(right, text[seam:last])
        return np.concatenate([left[:outer], self.leaf_ids(text[first:last]), right[inner:]])

    def edges(self, text: str, start: int, seam: int, end: int) -> tuple[int, int]:
        """The nearest safe places before and after the seam, found in growing windows."""
        reach, first = self.window, None
        while first is None and seam - reach > start:
            places = [m.start() for m in SAFE.finditer(text, seam - reach, seam)]
            first = places[-1] if places else None
            reach *= 2
        reach, last = self.window, None
        while last is None and seam + reach < end:
            # a place at the seam itself says nothing: what precedes it is the other part's
            place = SAFE.search(text, seam + 1, seam + reach)
            last = place.start() if place else None
            reach *= 2
        return start if first is None else first, end if last is None else last

    def _tokens(self, ids: np.ndarray, covered: str) -> int:
        """How many of the first ids make up the bytes of ``covered``."""
        size = len(covered.encode())
        count, ahead = 0, 256
        while size:
            sums = np.cumsum(self.sizes[ids[count : count + ahead]])
            at = int(np.searchsorted(sums, size))
            if at < len(sums):
                if sums[at] != size:
                    raise AssertionError("a window's edge lies inside a token")
                return count + at + 1
            count, size, ahead = count + len(sums), size - int(sums[-1]), ahead * 2
        return count


def encode(
    docs: DataFrame,
    path: str,
    pattern: str,
    text_col: str = "text",
    keep: list[str] | None = None,
    ids_col: str = "token_ids",
) -> DataFrame:
    """``docs`` with the token ids of each whole text."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(path))

    def make():
        encoder = Encoder(ranks.value, pattern)

        def run(texts: pa.Array) -> list[pa.Array]:
            parts = [encoder.encode(t or "") for t in texts.to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
            values = np.concatenate(parts) if parts else np.empty(0, np.int32)
            return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))]

        return run

    field = T.StructField(ids_col, T.ArrayType(T.IntegerType()))
    return with_text_columns(docs, text_col, [field], make, keep)


def concatenated(words: list[bytes], ids: np.ndarray) -> bytes:
    """Bytes of the ids, joined pairwise up a tree of halves."""
    if len(ids) <= LEAF_CHARS:
        return b"".join(map(words.__getitem__, ids.tolist()))
    half = len(ids) // 2
    return concatenated(words, ids[:half]) + concatenated(words, ids[half:])


def decode(docs: DataFrame, path: str, ids_col: str = "token_ids", bytes_col: str = "decoded") -> DataFrame:
    """``docs`` with the bytes of each list of ids."""
    prepare(docs.sparkSession)
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(path))
    kept = [c for c in docs.columns if c != bytes_col]
    rows = docs.select(*kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = [b""] * (max(ranks.value.values(), default=-1) + 1)
        for word, rank in ranks.value.items():
            words[rank] = word
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(start, BATCH_ROWS)
                column = part.column(part.schema.get_field_index(ids_col))
                made = [
                    concatenated(words, v.values.to_numpy(zero_copy_only=False)) if v.is_valid else None
                    for v in column
                ]
                yield pa.RecordBatch.from_arrays(
                    part.columns + [pa.array(made, pa.binary())], names=kept + [bytes_col]
                )

    schema = T.StructType([*rows.schema.fields, T.StructField(bytes_col, T.BinaryType())])
    return rows.mapInArrow(run, schema)


def digests(encoded: DataFrame, ids_col: str = "token_ids", bytes_col: str = "decoded") -> DataFrame:
    """``n_tokens``, and the SHA-256 of the ids in decimal and of the decoded bytes."""
    joined = F.array_join(F.col(ids_col).cast("array<string>"), ",")
    own = (ids_col, bytes_col, "n_tokens", "ids_sha256", "decoded_sha256")
    return encoded.select(
        *[c for c in encoded.columns if c not in own],
        F.size(ids_col).cast("long").alias("n_tokens"),
        F.sha2(joined.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col(bytes_col), 256).alias("decoded_sha256"),
    )
