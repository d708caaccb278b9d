"""Benchmark passages in documents, by suffix arrays of the documents.

1. Whole texts are normalised to words (A-Z lower-cased; every byte that is not a letter, a digit
   or part of a non-ASCII character separates).  A task gathers documents into shards of about
   ``SHARD_BYTES``; a longer text is cut into pieces that overlap by the longest item.
2. A shard's words are numbered in byte order and its suffixes sorted by prefix doubling, as
   deep as the longest item.  Only groups of suffixes that are still equal go on.
3. Every suffix of every item is binary-searched in the shard's array, word by word: the range
   of suffixes that begin with it narrows until it is empty, and its depth there is the length
   of the longest verbatim match.  The range at the depth of a window (``window`` words, or the
   whole of a shorter item) holds all places of that window.
4. Places on one diagonal (document word minus item word) join to maximal matches.

No document is shuffled.  Items come in blocks of about ``BLOCK_BYTES``: each is broadcast and
searched for in all shards, and the matches of several blocks meet by row number.

Defined results: a null text has no words; an item without words matches nothing; an item with
a null id marks words and contaminates, but is not counted or named; items that repeat an id are one
item; rows that repeat a doc_id are documents of their own.  Empty tables give no matches and an
empty result.  Result columns replace input columns of the same name; the prefixes
``__leak`` and ``__held`` are reserved.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chromafield.llm.rows import prepare
from chromafield.session import store_table

WINDOW = 10
SHARD_BYTES = 4 << 20
BLOCK_BYTES = 8 << 20
PLACES = 4_000_000  # window places that a task expands at once

_WORD = string.ascii_lowercase.encode() + string.digits.encode() + bytes(range(128, 256))
_TABLE = bytes(
    ord(chr(i).lower()) if 65 <= i <= 90 else i if i in _WORD else 32 for i in range(256)
)

KEYS = ("doc_word", "n_words", "item_id", "item_word")
MATCH = f"struct<{', '.join(f'{k}: bigint' for k in KEYS)}>"
OWN = ("n_words", "matches", "n_hit", "contaminated")


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8."""
    return (text or "").encode().translate(_TABLE).split()


@dataclass
class Items:
    """A block of test items: all their words in a row, and the suffixes that start a window."""

    ids: list[int | None]
    texts: list[str | None]
    window: int
    words: pa.Array = field(init=False)  # distinct
    word: np.ndarray = field(init=False)  # number in ``words`` per place
    item: np.ndarray = field(init=False)  # per place
    first: np.ndarray = field(init=False)  # place of each item's first word
    left: np.ndarray = field(init=False)  # words from a place to the end of its item
    starts: np.ndarray = field(init=False)  # places where a window starts
    length: np.ndarray = field(init=False)  # its words
    longest: int = field(init=False)

    def __post_init__(self):
        split = [words_of(t) for t in self.texts]
        size = np.array([len(w) for w in split], np.int64)
        every = pa.array([w + b" " for words in split for w in words], pa.binary()).dictionary_encode()
        self.words, self.word = every.dictionary, every.indices.to_numpy().astype(np.int64)
        self.item = np.repeat(np.arange(len(split)), size)
        self.first = np.cumsum(size) - size
        self.left = (self.first + size)[self.item] - np.arange(len(self.word))
        wanted = np.minimum(size, self.window)[self.item]
        self.starts = np.flatnonzero(self.left >= wanted)
        self.length = wanted[self.starts]
        self.longest = int(size.max(initial=0))


class Shard:
    """Suffix array of word sequences; ``pieces`` holds one list of words per text or piece."""

    def __init__(self, pieces: list[list[bytes]], depth: int):
        # a token ends with a blank; a zero byte, in no word, ends a piece and sorts first
        data = b"".join(b" ".join(p) + b" \0 " if p else b"\0 " for p in pieces)
        ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
        offsets = np.concatenate([[0], ends + 1]).astype(np.int32)
        tokens = pa.Array.from_buffers(
            pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)]
        ).dictionary_encode()
        distinct = tokens.dictionary
        ranked = pc.sort_indices(distinct).to_numpy()
        self.vocabulary = distinct.take(pa.array(ranked))
        number = np.empty(len(ranked), np.int64)
        number[ranked] = np.arange(len(ranked))
        self.word = number[tokens.indices.to_numpy()]
        # ends of pieces are in no suffix array
        self.piece = np.repeat(np.arange(len(pieces)), [len(p) + 1 for p in pieces])
        self.begin = np.cumsum([0] + [len(p) + 1 for p in pieces])
        self._sort(depth)

    def _sort(self, depth: int) -> None:
        """Order of the suffixes by their first ``depth`` words."""
        order = np.argsort(self.word, kind="stable")
        value = self.word[order]
        rank = np.zeros(len(self.word) + depth + 1, np.int64)  # place of the first equal suffix
        fresh = np.concatenate([[True], value[1:] != value[:-1]])
        rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
        self.ends = int(np.searchsorted(value, 1)) if len(value) else 0  # ends come first
        done, size = 1, len(order)
        open_ = np.arange(self.ends, size)
        while done < depth and len(open_):
            own = rank[order[open_]]
            alone = np.concatenate([[True], own[1:] != own[:-1]]) & np.concatenate([own[1:] != own[:-1], [True]])
            open_, own = open_[~alone], own[~alone]
            if not len(open_):
                break
            suffix = order[open_]
            both = own * size + rank[suffix + done]
            ranked = np.argsort(both, kind="stable")
            order[open_], both = suffix[ranked], both[ranked]
            fresh = np.concatenate([[True], both[1:] != both[:-1]])
            rank[order[open_]] = np.maximum.accumulate(np.where(fresh, open_, 0))
            done *= 2
        self.order = order

    def _bound(self, low, high, depth: int, word, after: bool):
        """First entry of each range whose word at ``depth`` is not below (or is above) ``word``."""
        low, high = low.copy(), high.copy()
        while True:
            going = low < high
            if not going.any():
                return low
            middle = (low + high) >> 1
            there = self.word[np.minimum(self.order[np.where(going, middle, 0)] + depth, len(self.word) - 1)]
            less = (there <= word) if after else (there < word)
            low = np.where(going & less, middle + 1, low)
            high = np.where(going & ~less, middle, high)

    def search(self, items: Items):
        """``(longest match, its first place, low, high)`` per suffix of the items: words matched,
        one place of such a match, and the range of the places of the window there (or empty)."""
        code = pc.index_in(items.words, value_set=self.vocabulary).fill_null(-1).to_numpy().astype(np.int64)
        target = code[items.word]
        count = len(target)
        wanted = np.full(count, -1, np.int64)
        wanted[items.starts] = items.length
        best, place = np.zeros(count, np.int64), np.full(count, -1, np.int64)
        lows, highs = np.zeros(count, np.int64), np.zeros(count, np.int64)
        sorted_first = self.word[self.order]
        active = np.flatnonzero(target > 0)
        low = np.searchsorted(sorted_first, target[active], "left")
        high = np.searchsorted(sorted_first, target[active], "right")
        depth = 1
        while True:
            some = low < high
            active, low, high = active[some], low[some], high[some]
            if not len(active):
                return best, place, lows, highs
            best[active], place[active] = depth, self.order[low]
            whole = wanted[active] == depth
            lows[active[whole]], highs[active[whole]] = low[whole], high[whole]
            on = items.left[active] > depth
            active, low, high = active[on], low[on], high[on]
            word = target[active + depth]
            low, high = (
                self._bound(low, high, depth, word, False),
                self._bound(low, high, depth, word, True),
            )
            depth += 1

    def places(self, items: Items, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``(place in the items, place in the shard)`` of all windows, in parts."""
        at = np.flatnonzero(low < high)
        count = (high - low)[at]
        total, a = np.cumsum(count), 0
        while a < len(at):
            most = PLACES + (total[a - 1] if a else 0)
            b = max(a + 1, int(np.searchsorted(total, most, "right")))
            yield self._expanded(at[a:b], low, count[a:b])
            a = b

    def _expanded(self, at, low, count):
        owner = np.repeat(at, count)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        return owner, self.order[low[owner] + inside]


def joined(places: list[tuple[np.ndarray, ...]], items: Items) -> list[np.ndarray]:
    """``(doc, doc word, words, item, item word)`` of maximal matches from window places
    ``(doc, doc word, place in the items)``; places found twice, in overlapping pieces, are one."""
    if not places:
        return [np.empty(0, np.int64)] * 5
    doc, word, place = (np.concatenate(c) for c in zip(*places))
    item = items.item[place]
    inside = place - items.first[item]
    diagonal = word - inside
    order = np.lexsort((inside, diagonal, item, doc))
    doc, word, item, inside, diagonal = (c[order] for c in (doc, word, item, inside, diagonal))
    window = np.minimum(items.window, items.left[items.first[item]])

    def differ(c):
        return np.concatenate([[True], c[1:] != c[:-1]])

    gap = np.concatenate([[True], np.diff(inside) > 1])
    begin = np.flatnonzero(differ(doc) | differ(item) | differ(diagonal) | gap)
    last = np.append(begin[1:], len(doc)) - 1
    return [doc[begin], word[begin], inside[last] - inside[begin] + window[begin], item[begin], inside[begin]]


def _matches(texts: list[str | None], items: Items) -> tuple[list[int], list[list[tuple]]]:
    """Number of words and sorted matches per text; shards are built as the texts come."""
    counts, found, pending, size = [], [], [], 0  # pending: (doc, first word, words)

    def flush():
        shard = Shard([p[2] for p in pending], items.longest)
        _, _, low, high = shard.search(items)
        doc, start = (np.array([p[i] for p in pending], np.int64) for i in (0, 1))
        for place, at in shard.places(items, low, high):
            piece = shard.piece[at]
            found.append((doc[piece], start[piece] + at - shard.begin[piece], place))

    step = max(SHARD_BYTES // 8, 2 * items.longest)  # words of a piece
    for number, text in enumerate(texts):
        words = words_of(text)
        counts.append(len(words))
        if not len(items.starts):
            continue
        at = 0
        while at < len(words):
            part = words[at : at + step]
            pending.append((number, at, part))
            size += sum(map(len, part)) + len(part)
            if size >= SHARD_BYTES:
                flush()
                pending, size = [], 0
            if at + step >= len(words):
                break
            at += step - items.longest
    if pending:
        flush()
    out: list[list[tuple]] = [[] for _ in texts]
    for doc, word, n, item, inside in zip(*(c.tolist() for c in joined(found, items))):
        out[doc].append((word, n, items.ids[item], inside))
    for row in out:
        row.sort(key=lambda m: (m[0], m[1], m[2] is None, m[2] or 0, m[3]))
    return counts, out


def _searched(docs: DataFrame, text_col: str, keep: list[str], items: Items) -> DataFrame:
    """``keep``, ``n_words`` and ``matches`` with one block of items."""
    shared = docs.sparkSession.sparkContext.broadcast(items)  # about BLOCK_BYTES
    kept = [c for c in keep if c not in ("n_words", "matches")]
    rows = docs.select(*kept, F.col(text_col).alias("__input"))
    match = T.StructType([T.StructField(k, T.LongType()) for k in KEYS])
    schema = T.StructType([rows.schema[c] for c in kept])
    schema = schema.add("n_words", T.LongType()).add("matches", T.ArrayType(match))
    kind = pa.list_(pa.struct([(k, pa.int64()) for k in KEYS]))
    names = [*kept, "n_words", "matches"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(held):
            texts = [t for b in held for t in b.column(len(kept)).to_pylist()]
            counts, matches = _matches(texts, shared.value)
            at = 0
            for b in held:
                to = at + b.num_rows
                listed = [[dict(zip(KEYS, m)) for m in row] for row in matches[at:to]]
                yield pa.RecordBatch.from_arrays(
                    [b.column(i) for i in range(len(kept))]
                    + [pa.array(counts[at:to], pa.int64()), pa.array(listed, kind)],
                    names=names,
                )
                at = to

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column(len(kept)).nbytes
            if size >= SHARD_BYTES:
                yield from made(held)
                held, size = [], 0
        if held:
            yield from made(held)

    return rows.mapInArrow(run, schema)


def search(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "item_id",
    text_col: str = "text",
    window: int = WINDOW,
    keep: list[str] | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with ``n_words``, ``matches``, ``n_hit`` and ``contaminated``.

    ``matches`` lists the maximal verbatim matches of a window and more as structs of
    ``MATCH``: places are counted in words from 0.
    """
    prepare(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    kept = [c for c in keep if c not in OWN]
    items = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))

    def block(number: int) -> Items:
        rows = items.where(F.pmod(F.xxhash64("text", "id"), F.lit(blocks)) == number)
        held = rows.toArrow()  # about ``block_bytes``
        return Items(held.column(0).to_pylist(), held.column(1).to_pylist(), window)

    if blocks == 1:
        found = _searched(docs, text_col, kept, block(0))
    else:
        numbered = store_table(docs.withColumn("__leak_row", F.monotonically_increasing_id()), "leak-docs")
        parts = None
        for number in range(blocks):
            part = _searched(numbered, text_col, ["__leak_row"], block(number)).where(F.size("matches") > 0)
            part = store_table(part.drop("n_words"), "leak-matches")
            parts = part if parts is None else parts.unionByName(part)
        merged = parts.groupBy("__leak_row").agg(F.sort_array(F.flatten(F.collect_list("matches"))).alias("matches"))
        nothing = Items([], [], window)
        counted = _searched(numbered, text_col, [*kept, "__leak_row"], nothing).drop("matches")
        found = counted.join(merged, "__leak_row", "left").withColumn(
            "matches", F.coalesce("matches", F.array().cast(f"array<{MATCH}>"))
        ).drop("__leak_row")
    # matches are sorted by their first word
    hit = F.expr(
        """aggregate(matches, struct(0L as total, 0L as upto), (a, m) -> struct(
            a.total + greatest(m.doc_word + m.n_words - greatest(a.upto, m.doc_word), 0L) as total,
            greatest(a.upto, m.doc_word + m.n_words) as upto), a -> a.total)"""
    )
    return found.select(
        *kept, "n_words", "matches", hit.alias("n_hit"), (F.size("matches") > 0).alias("contaminated")
    )


def longest_matches(found: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """Of each item its longest match in any document: ``item_id, n_words, item_word`` and the
    smallest ``doc_col`` and ``doc_word`` that hold it."""
    each = found.select(F.col(doc_col).alias("__doc"), F.inline("matches")).where("item_id is not null")
    rank = F.struct((-F.col("n_words")).alias("less"), "__doc", "doc_word", "item_word")
    best = each.groupBy("item_id").agg(F.min(rank).alias("m"))
    return best.select(
        "item_id",
        (-F.col("m.less")).alias("n_words"),
        "m.item_word",
        F.col("m.__doc").alias(doc_col),
        "m.doc_word",
    )


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no window of any item."""
    # columns named like results come back as they were
    held = {c: f"__held_{c}" for c in OWN if c in docs.columns}
    found = search(docs.withColumnsRenamed(held), items, **options).where("not contaminated")
    return found.select(*[F.col(held.get(c, c)).alias(c) for c in docs.columns])


def digests(found: DataFrame) -> DataFrame:
    """The items that occur in a document: ``n_items`` and the SHA-256 of their sorted ids."""
    ids = F.expr(
        """array_sort(array_distinct(transform(
            filter(matches, m -> m.item_id is not null), m -> cast(m.item_id as string))))"""
    )
    named = found.withColumn("__ids", ids)
    return named.withColumns(
        {
            "n_items": F.size("__ids").cast("long"),
            "items_sha256": F.sha2(F.concat_ws(",", "__ids"), 256),
        }
    ).drop("__ids", "matches")
