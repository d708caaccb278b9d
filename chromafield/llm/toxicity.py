"""Toxicity by a small convolutional text classifier, trained in numpy.

A word is hashed to a cell with a vector; filters of several widths run over the whole text;
the largest answer of each filter goes into a logistic output.  Words whose cell hardly occurs
in the training rows share the zero vector, so that a long text of rare words stays quiet.

A threshold is chosen per language on all labelled rows kept out of the fit, whatever their
number and length: they are scored where they lie, and Spark sums a histogram of their logits
per language and label.  The language is guessed from the words of the text alone; the score is
shifted so that the threshold of the text's language lies at 0.5.

Only the fit reads a bounded sample: at most ``per_class`` labelled rows per class, each of at
most ``MAX_TRAIN_CHARS`` characters, three quarters of which train.  Languages are those of the
sample.  Calibration and scoring read every text as a whole.

Defined results: null and empty texts score as a text without known words; labels other than 0
and 1 and null ids train nothing; without sampled rows of both classes (as in an empty table, which gives an empty result) every score
is 0; equal scores get equal verdicts; rows that repeat an id or a text are scored each for itself, and an
id with several texts or labels lends each text each label.  Names that begin with ``__`` are
reserved.  Result
columns replace input columns of the same name.
"""

from __future__ import annotations

import string
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chromafield.llm.rows import with_text_columns

CELLS = 1 << 18
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
PER_CLASS = 2_000
MAX_TRAIN_CHARS = 20_000
MIN_DOCS = 3  # training rows that must hold a cell
SHRINK = 20  # rows at which a cell's log odds count by half
STEPS = 200  # batches at least, so that a small sample is read more often
DECAY = 1e-3
MIN_HELD = 4  # toxic rows that set a threshold
MIN_OWN = 20  # rows of either class that set a language's own threshold
BINS = 256  # histogram bins per unit of asinh(logit): fine near 0, without end bins
PAD = max(WIDTHS) - 1
CHUNK_WORDS = 1 << 15
MAX_CACHED_WORDS = 100_000


class Words(dict):
    """Cell of a word, remembered; cell 0 is for padding and words of no letters."""

    def __missing__(self, word: str) -> int:
        bare = word.lower().strip(string.punctuation)
        cell = 1 + zlib.crc32(bare.encode()) % (CELLS - 1) if bare else 0
        if len(self) >= MAX_CACHED_WORDS:
            self.clear()
        self[word] = cell
        return cell


def cells_of(texts: list[str | None], words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Cells of all texts in one array, each text after ``PAD`` zeros, and the texts' starts."""
    parts, starts, at = [], np.empty(len(texts), np.int64), 0
    for i, text in enumerate(texts):
        split = (text or "").split()
        part = np.zeros(len(split) + PAD, np.int64)
        part[PAD:] = list(map(words.__getitem__, split))
        parts.append(part)
        starts[i] = at
        at += len(part)
    return np.concatenate([*parts, np.zeros(PAD, np.int64)]), starts


@dataclass
class Model:
    embedding: np.ndarray  # CELLS x DIM
    filters: dict[int, np.ndarray]  # width: (width * DIM) x FILTERS
    biases: dict[int, np.ndarray]
    output: np.ndarray  # one weight per pooled filter
    bias: float
    languages: np.ndarray  # CELLS x languages: log odds of a word
    thresholds: np.ndarray  # logit at which a text of the language counts as toxic

    def answers(self, cells: np.ndarray, width: int) -> np.ndarray:
        vectors = self.embedding[cells]
        count = len(cells) - PAD
        weights = self.filters[width].reshape(width, DIM, FILTERS)
        out = vectors[:count] @ weights[0]
        for j in range(1, width):
            out += vectors[j : count + j] @ weights[j]
        return out + self.biases[width]

    def pooled(self, cells: np.ndarray, starts: np.ndarray) -> np.ndarray:
        most = [np.maximum.reduceat(self.answers(cells, w), starts, axis=0) for w in WIDTHS]
        return np.maximum(np.hstack(most), 0)

    def logits(self, cells: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return self.pooled(cells, starts) @ self.output + self.bias

    def language(self, cells: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.languages[cells[: len(cells) - PAD]], starts, axis=0).argmax(1)

    def scores(self, cells: np.ndarray, starts: np.ndarray) -> np.ndarray:
        shifted = self.logits(cells, starts) - self.thresholds[self.language(cells, starts)]
        return 1 / (1 + np.exp(-np.clip(shifted, -30, 30)))


def _gather(cells: np.ndarray, starts: np.ndarray, rows: np.ndarray):
    """The chosen texts of a larger array, as ``cells_of`` would give them."""
    ends = np.append(starts[1:], len(cells) - PAD)
    parts = [cells[starts[r] : ends[r]] for r in rows]
    sizes = np.array([len(p) for p in parts])
    return np.concatenate([*parts, np.zeros(PAD, np.int64)]), np.cumsum(sizes) - sizes


def fit(texts: list[str], toxic: np.ndarray, langs: list[str | None], seed: int = 7):
    """Model from the sample, its thresholds not yet set, and the rows that trained it."""
    rng = np.random.default_rng(seed)
    words = Words()
    cells, starts = cells_of(texts, words)
    rows = len(texts)
    doc = np.repeat(np.arange(rows), np.diff(np.append(starts, len(cells) - PAD)))
    body = cells[: len(cells) - PAD]
    pairs = np.unique(body * rows + doc)
    known = np.bincount(pairs // rows, minlength=CELLS) >= MIN_DOCS
    known[0] = False

    names = sorted({x for x in langs if x}) or ["und"]
    counts = np.ones((CELLS, len(names)), np.float32)
    for i, name in enumerate(names):
        own = np.array([x == name for x in langs])
        if own.any():
            np.add.at(counts[:, i], body[own[doc]], 1)
    counts /= counts.sum(0)
    languages = np.log(counts)
    languages -= languages.mean(1, keepdims=True)
    languages[~known] = 0

    # unknown cells read the zero vector; row 0 stays zero
    cells = np.where(known[cells], cells, 0)
    order = rng.permutation(rows)
    train = order[rows // 4 :]
    embedding = rng.normal(0, 0.02, (CELLS, DIM)).astype(np.float32)
    embedding[:, 0] = _association(pairs, rows, toxic, train)
    filters = {w: rng.normal(0, 0.2, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
    for w in WIDTHS:  # each filter starts out sensitive to the first coordinate
        filters[w][::DIM] = np.abs(filters[w][::DIM]) + 0.2
    model = Model(
        embedding * known[:, None],
        filters,
        {w: np.zeros(FILTERS, np.float32) for w in WIDTHS},
        rng.normal(0, 0.2, len(WIDTHS) * FILTERS).astype(np.float32),
        0.0,
        languages.astype(np.float32),
        np.zeros(len(names), np.float32),
    )
    _train(model, cells, starts, toxic, train, rng)
    return model, train


def _association(pairs: np.ndarray, rows: int, toxic: np.ndarray, train: np.ndarray) -> np.ndarray:
    """Start of the first coordinate: log odds of a cell's rows, less where few rows hold it."""
    used = np.zeros(rows, bool)
    used[train] = True
    cell, doc = pairs // rows, pairs % rows
    inside = used[doc]
    with_it = [
        np.bincount(cell[inside & (toxic[doc] == c)], minlength=CELLS).astype(np.float32) for c in (0, 1)
    ]
    shares = [(n + 0.5) / (np.sum(used & (toxic == c)) + 1) for c, n in enumerate(with_it)]
    odds = np.log(shares[1] / shares[0])
    total = with_it[0] + with_it[1]
    return (odds * total / (total + SHRINK) / 4).astype(np.float32)


def _train(model: Model, cells, starts, toxic, train, rng, batch: int = 64, rate: float = 0.01):
    """Adam on the logistic loss; only the winners of the pooling pass a gradient on."""
    params = {"output": model.output, "bias": np.zeros(1, np.float32)}
    params |= {f"f{w}": model.filters[w] for w in WIDTHS} | {f"b{w}": model.biases[w] for w in WIDTHS}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in params.items()}
    seen = (np.zeros_like(model.embedding), np.zeros_like(model.embedding))
    step = 0

    def adam(value, grad, first, second, rate=rate):
        first *= 0.9
        first += 0.1 * grad
        second *= 0.99
        second += 0.01 * grad * grad
        value -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)

    for _ in range(-(-STEPS * batch // len(train))):
        for at in range(0, len(train), batch):
            step += 1
            rows = rng.permutation(train)[:batch] if at + batch > len(train) else train[at : at + batch]
            part, begin = _gather(cells, starts, rows)
            ends = np.append(begin[1:], len(part) - PAD)
            wins, pooled = {}, []
            for w in WIDTHS:
                out = model.answers(part, w)
                wins[w] = np.array([begin[i] + out[begin[i] : ends[i]].argmax(0) for i in range(len(rows))])
                pooled.append(out[wins[w], np.arange(FILTERS)])
            pre = np.hstack(pooled)
            active = np.maximum(pre, 0)
            p = 1 / (1 + np.exp(-np.clip(active @ model.output + params["bias"][0], -30, 30)))
            error = ((p - toxic[rows]) / len(rows)).astype(np.float32)
            grads = {"output": active.T @ error + DECAY * model.output, "bias": error.sum(keepdims=True)}
            back = error[:, None] * model.output[None, :] * (pre > 0)
            touched, amounts = [], []
            for k, w in enumerate(WIDTHS):
                own = back[:, k * FILTERS : (k + 1) * FILTERS]
                grads[f"b{w}"] = own.sum(0)
                weights = model.filters[w].reshape(w, DIM, FILTERS)
                grad = np.zeros_like(weights)
                for j in range(w):
                    at_cells = part[wins[w] + j]
                    grad[j] = np.einsum("nfd,nf->df", model.embedding[at_cells], own)
                    touched.append(at_cells.ravel())
                    amounts.append((own[:, :, None] * weights[j].T[None]).reshape(-1, DIM))
                grads[f"f{w}"] = grad.reshape(w * DIM, FILTERS) + DECAY * model.filters[w]
            for k, v in params.items():
                adam(v, grads[k], *moments[k])
            which, inverse = np.unique(np.concatenate(touched), return_inverse=True)
            total = np.zeros((len(which), DIM), np.float32)
            np.add.at(total, inverse, np.concatenate(amounts))
            which, total = which[which > 0], total[which > 0]
            value, first, second = model.embedding[which], seen[0][which], seen[1][which]
            adam(value, total + DECAY * value / len(rows), first, second, rate / 5)
            model.embedding[which], seen[0][which], seen[1][which] = value, first, second
        train = rng.permutation(train)
    model.bias = float(params["bias"][0])


def _threshold(low, high, counts: np.ndarray, odds: float) -> float:
    """Logit with the best F1 under the table's own class shares, in the middle of its gap.

    ``low`` and ``high``: smallest and largest logit of each bin, from the highest bin down;
    ``counts``: its harmless and toxic rows; ``odds``: what a harmless row stands for.
    """
    total = counts.sum(0)
    if not total.all():
        return 0.0
    right = np.cumsum(counts[:, 1])
    wrong = np.cumsum(counts[:, 0]) * odds
    f1 = 2 * right / (right + wrong + total[1])
    # harmless texts are to be left alone: a cut that is wrong more often than right is none
    f1[right < wrong] = -1
    best = int(np.argmax(f1))
    if f1[best] < 0:
        return float(high[0]) + 2
    below = high[best + 1] if best + 1 < len(high) else low[best] - 2
    return float((low[best] + below) / 2)


def _merged(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins of histogram rows, the highest first: smallest, largest logit, rows per class."""
    bins: dict[int, list] = {}
    for r in rows:
        own = bins.setdefault(r["bin"], [r["low"], r["high"], [0, 0]])
        own[0], own[1] = min(own[0], r["low"]), max(own[1], r["high"])
        own[2][r["toxic"]] += r["n"]
    found = [bins[b] for b in sorted(bins, reverse=True)]
    low, high, counts = zip(*found) if found else ((), (), np.zeros((0, 2)))
    return np.array(low), np.array(high), np.array(counts, float)


def calibrate(
    model: Model, docs: DataFrame, labels: DataFrame, trained: list, id_col: str, text_col: str
) -> None:
    """Set the thresholds from all ``labels`` (``__id``, ``__toxic``) not in ``trained``.

    Texts are scored where they lie; ids and logits alone are shuffled to their labels.  The
    driver gets one row per language, bin of logits and label.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        words = Words()

        def run(texts: pa.Array) -> list[pa.Array]:
            logits, guessed = [], []
            for cells, starts in _chunks(texts, words):
                logits.append(shared.value.logits(cells, starts))
                guessed.append(shared.value.language(cells, starts))
            return [
                pa.array(np.concatenate(logits), pa.float64()),
                pa.array(np.concatenate(guessed).astype(np.int32)),
            ]

        return run

    fields = [T.StructField("__logit", T.DoubleType()), T.StructField("__guess", T.IntegerType())]
    known = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    known = known.where(F.col("__id").isNotNull())
    scored = with_text_columns(known, "__text", fields, make, keep=["__id"])
    seen = docs.sparkSession.createDataFrame(
        [(x,) for x in dict.fromkeys(trained)], T.StructType([scored.schema["__id"]])
    ).withColumn("__seen", F.lit(True))
    hist = (
        scored.join(labels, "__id")
        .join(F.broadcast(seen), "__id", "left")
        .groupBy(
            F.col("__guess").alias("guess"),
            F.floor(F.asinh("__logit") * BINS).alias("bin"),
            F.col("__toxic").alias("toxic"),
            F.col("__seen").isNotNull().alias("seen"),
        )
        .agg(F.count("*").alias("n"), F.min("__logit").alias("low"), F.max("__logit").alias("high"))
        .collect()
    )

    def totals(rows: list) -> np.ndarray:
        return np.array([sum(r["n"] for r in rows if r["toxic"] == c) for c in (0, 1)], float)

    held = [r for r in hist if not r["seen"]]
    if totals(held)[1] < MIN_HELD or not totals(held)[0]:
        held = hist  # too few to set a threshold by: take all rows
    # the fit took a larger share of the rarer class
    share, rest = totals(hist), totals(held)
    odds = (share[0] / share[1]) / (rest[0] / rest[1]) if rest.all() else 1.0
    common = _threshold(*_merged(held), odds)
    for i in range(len(model.thresholds)):
        low, high, counts = _merged([r for r in held if r["guess"] == i])
        enough = len(counts) and counts.sum(0).min() >= MIN_OWN
        model.thresholds[i] = _threshold(low, high, counts, odds) if enough else common


def train(
    docs: DataFrame,
    labels: DataFrame,
    usable: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    lang_col: str = "lang",
    per_class: int = PER_CLASS,
) -> Model | None:
    """Fit on at most ``per_class`` rows per class among the labels that are ``usable``, with
    thresholds from all the others.
    """
    rows = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & usable).select(
        F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__toxic")
    )
    pick = F.xxhash64("__id", F.lit("toxicity"))
    texts = docs.select(
        F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.col(lang_col).alias("__lang")
    ).where(F.length("__text") <= MAX_TRAIN_CHARS)
    # chosen among the texts that fit, so that long ones do not thin the sample
    fitting = rows.join(texts.select("__id"), "__id", "left_semi")
    chosen = [fitting.where(F.col("__toxic") == c).orderBy(pick, "__id").limit(per_class) for c in (0, 1)]
    # 2 * per_class ids at most
    sample = (
        texts.join(F.broadcast(chosen[0].unionByName(chosen[1])), "__id")
        .orderBy("__id")
        .limit(2 * per_class)
        .collect()
    )
    toxic = np.array([r["__toxic"] for r in sample])
    if len(set(toxic.tolist())) < 2:
        return None
    model, used = fit([r["__text"] for r in sample], toxic, [r["__lang"] for r in sample])
    calibrate(model, docs, rows, [sample[i]["__id"] for i in used], id_col, text_col)
    return model


def _chunks(texts: pa.Array, words: Words):
    """Cells and starts of all texts, in groups of bounded size."""
    part, size = [], 0
    for text in texts.to_pylist():
        part.append(text)
        size += len(text or "")
        if size > 6 * CHUNK_WORDS:
            yield cells_of(part, words)
            part, size = [], 0
    if part:
        yield cells_of(part, words)


def score(
    docs: DataFrame, model: Model | None, text_col: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``."""
    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    # the model's size is fixed by CELLS, DIM and the number of languages
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        words = Words()

        def run(texts: pa.Array) -> list[pa.Array]:
            if shared.value is None:
                values = np.zeros(len(texts))
            else:
                values = np.concatenate([shared.value.scores(*c) for c in _chunks(texts, words)])
            return [pa.array(values, pa.float64()), pa.array((values >= 0.5).astype(np.int32))]

        return run

    return with_text_columns(docs, text_col, fields, make, keep)
