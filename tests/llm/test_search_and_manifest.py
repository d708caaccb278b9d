"""Hard negatives, decontamination and manifests against brute force, with their edge cases."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from chromafield.llm import decontamination, hard_negatives, manifest
from tests.llm.test_operators import EDGES, PROSE, table

VECTORS = "vec_id long, embedding array<float>, label int, score double, rank int, __x long"


def vectors(spark, rows):
    made = [(*r, None, None, None) for r in rows]
    return spark.createDataFrame(made, VECTORS).repartition(3)


def mined_by_hand(rows, is_anchor, low=80, high=100):
    kept = [
        (i, [math.floor(256 * float(np.float32(x))) for x in v], l)
        for i, v, l in rows
        if i is not None and l is not None and v is not None
        and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for k, (a, v, label) in enumerate(kept):
        if not is_anchor(a):
            continue
        scored = sorted(
            (-max(min(sum(p * q for p, q in zip(v, w)), 2**63 - 2), -(2**63) + 2), i, m)
            for j, (i, w, m) in enumerate(kept)
            if j != k
        )
        for s, p, _ in [x for x in scored if x[2] == label][:5]:
            fits = [x for x in scored if x[2] != label and low * -s <= high * -x[0] <= high * -s][:5]
            out += [(a, p, n + 1, x[1], -s, -x[0]) for n, x in enumerate(fits)]
    return sorted(out)


def random_rows(rng, n, spread, dim=8):
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(4)]
    return [
        (i, [c + spread * rng.gauss(0, 1) for c in centres[rng.randrange(4)]], rng.randrange(3))
        for i in range(n)
    ]


@pytest.mark.parametrize("spread, group_rows", [(0.1, 8192), (1.0, 8192), (0.3, 7)])
def test_hard_negatives(spark, spread, group_rows, monkeypatch):
    monkeypatch.setattr(hard_negatives, "STRIDES", (8, 32))
    rows = random_rows(random.Random(3), 600, spread)
    got = hard_negatives.mine(vectors(spark, rows), F.col("vec_id") % 20 == 0, group_rows=group_rows)
    assert sorted(map(tuple, got.collect())) == mined_by_hand(rows, lambda i: i % 20 == 0)


def test_hard_negatives_edges(spark):
    same = [0.5, 0.25, -0.125]
    rows = [
        (0, same, 1), (100, same, 1), (100, same, 1), (1, same, 2), (2, same, 2), (2, same, 2),
        (3, same, 3), (4, same, 1), (5, same, 1), (6, same, 1), (7, same, 1),
        (8, None, 1), (9, same, None), (None, same, 1), (10, [1.0, None, 0.0], 1),
        (11, [float("nan")] * 3, 1), (12, [float("inf"), 0.0, 0.0], 2), (13, [], 1), (200, [], 2),
        (14, [0.5], 3), (300, [3e38, 1.0, -3e38], 3), (15, [3e38, 0.0, 0.0], 3), (16, [2e38, 0.0, 1.0], 4),
        (17, [-3e38, 0.0, 0.0], 4), (400, [0.0, 0.0, 0.0], 9), (18, [-0.5, 0.0, 0.0], 1),
    ]
    got = hard_negatives.mine(vectors(spark, rows), F.col("vec_id") % 100 == 0)
    assert sorted(map(tuple, got.collect())) == mined_by_hand(rows, lambda i: i % 100 == 0)
    assert got.columns == [c.split()[0] for c in hard_negatives.SCHEMA.split(", ")]
    assert hard_negatives.mine(vectors(spark, []), F.lit(True)).count() == 0
    assert hard_negatives.mine(vectors(spark, rows), F.lit(False)).count() == 0


def test_lists_end_early():
    """In tight clusters a member reads the head of its list only."""
    rng = np.random.default_rng(1)
    centres = np.eye(16) * 100
    own = rng.integers(0, 16, 4000)
    data = np.floor(256 * (centres[own] + rng.normal(0, 1, (4000, 16))))
    rows, labels = np.arange(4000), rng.integers(0, 2, 4000)
    group = hard_negatives.Group(rows[:200], rows[:200], labels[:200], data[:200])
    kept = hard_negatives.Positives(group, 5)
    seen = hard_negatives.walk(group, kept, rows, rows, labels, data)
    assert seen < 0.4 * 200 * 4000
    for i in range(0, 200, 17):
        score = (data @ data[i]).astype(np.int64)
        fit = [j for j in range(4000) if j != i and labels[j] == labels[i]]
        want = sorted(fit, key=lambda j: (-score[j], j))[:5]
        assert kept.best.id[i].tolist() == want


ITEMS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"),
    (2, "short item"),
    (3, None),
    (4, " ,;. "),
    (5, "beta gamma delta epsilon zeta eta theta iota kappa lambda"),
    (5, "Zürich ÉTÉ été"),
    (None, "nameless item"),
    (12, PROSE),
    (7, "short item"),
    (8, "x"),
]
TEXTS = [
    (20, "Alpha, BETA gamma; delta epsilon zeta eta theta iota kappa lambda mu nu"),
    (21, "a short item, and a short items"),
    (22, "alpha beta gamma delta epsilon zeta eta theta iota"),
    (23, "beta-gamma delta epsilon zeta eta theta iota kappa lambda"),
    (24, "zürich été été Zürich ÉTÉ été"),
    (25, "the nameless item of nobody"),
    (26, "so x y x"),
    (26, "x x x"),
    (27, "short\x00item short item"),
]


def searched_by_hand(docs, items, window=10):
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for i, text in items:
        words = split(text)
        k = min(len(words), window)
        for p in range(len(words) - k + 1) if k else []:
            windows.setdefault(tuple(words[p : p + k]), set()).add(i)
    sizes = {len(w) for w in windows}
    out = []
    for i, text in docs:
        words, hit, found = split(text), set(), set()
        for p in range(len(words)):
            for k in sizes:
                ids = windows.get(tuple(words[p : p + k])) if p + k <= len(words) else None
                if ids:
                    hit |= set(range(p, p + k))
                    found |= ids - {None}
        names = ",".join(sorted(map(str, found)))
        sha = hashlib.sha256(names.encode()).hexdigest()
        out.append((i, len(words), len(hit), len(found), sha, bool(hit)))
    return sorted(out, key=str)


RESULT = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


@pytest.mark.parametrize("block_bytes, shard_bytes", [(1 << 20, 1 << 20), (60, 1 << 20), (1 << 20, 200)])
def test_decontamination(spark, monkeypatch, block_bytes, shard_bytes):
    """Several blocks of items, and texts longer than a shard, give the same rows."""
    # a long text of many pieces, with an item over a border every few words
    rng = random.Random(5)
    long = " ".join(rng.choice(["alpha", "beta", ITEMS[0][1], ITEMS[4][1], "mu", "short item"]) for _ in range(400))
    rows = EDGES + TEXTS + [(30, long), (31, long), (31, PROSE * 30)]
    docs, items = table(spark, rows), spark.createDataFrame(ITEMS, "item_id long, text string")
    monkeypatch.setattr(decontamination, "SHARD_BYTES", shard_bytes)
    found = decontamination.search(docs, items, block_bytes=block_bytes)
    got = decontamination.digests(found).select(RESULT).collect()
    assert sorted(map(tuple, got), key=str) == searched_by_hand(rows, ITEMS)
    assert set(docs.columns) <= set(found.columns)
    clean = decontamination.decontaminate(docs, items, block_bytes=block_bytes)
    assert clean.columns == docs.columns
    left = sorted((r.doc_id for r in clean.collect()), key=str)
    assert left == sorted((r[0] for r in searched_by_hand(rows, ITEMS) if not r[5]), key=str)


def test_longest_matches(spark):
    docs = table(spark, [(1, "q " + " ".join(ITEMS[0][1].split()[:11])), (2, "so " + ITEMS[0][1] + " and so"), (3, ITEMS[0][1])])
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontamination.search(docs, items, window=4)
    by_id = {r.doc_id: [tuple(m) for m in r.matches] for r in found.collect()}
    assert by_id[1] == [(1, 11, 1, 0), (2, 10, 5, 0)]
    assert by_id[2] == [(1, 12, 1, 0), (2, 10, 5, 0)]
    best = {r.item_id: r for r in decontamination.longest_matches(found).collect()}
    assert (best[1].n_words, best[1].doc_id, best[1].doc_word, best[1].item_word) == (12, 2, 1, 0)
    assert (best[5].n_words, best[5].doc_id) == (10, 1)


def test_suffix_array_and_longest_prefix():
    rng = random.Random(2)
    pieces = [[rng.choice([b"a", b"b", b"ab"]) for _ in range(rng.randrange(12))] for _ in range(30)]
    texts = [" ".join(rng.choice(["a", "b", "ab", "c"]) for _ in range(rng.randrange(1, 9))) for _ in range(20)]
    items = decontamination.Items(list(range(20)), texts, 3)
    shard = decontamination.Shard(pieces, items.longest)
    best, _, low, high = shard.search(items)
    flat = [w for t in texts for w in t.split()]
    for g in range(len(flat)):
        own = flat[g : g + int(items.left[g])]
        fits = lambda n: any(
            [w.decode() for w in p[i : i + n]] == own[:n] for p in pieces for i in range(len(p) - n + 1)
        )
        assert best[g] == max(n for n in range(len(own) + 1) if fits(n))
    count = dict(zip(items.starts.tolist(), items.length.tolist()))
    for g, k in count.items():
        want = sum([w.decode() for w in p[i : i + k]] == flat[g : g + k] for p in pieces for i in range(len(p) - k + 1))
        assert high[g] - low[g] == want


def test_decontamination_of_empty_tables(spark):
    docs, items = table(spark, EDGES), spark.createDataFrame(ITEMS, "item_id long, text string")
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.search(table(spark, []), items).count() == 0
    assert decontamination.search(docs, nothing).where("contaminated or n_hit > 0").count() == 0
    assert decontamination.longest_matches(decontamination.search(docs, nothing)).count() == 0


def hashed(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climbed(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([hashed(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def siblings(levels, at):
    proof = []
    for nodes in levels[:-1]:
        first = at - at % 3
        proof += ["".join(nodes[first:at]), "".join(nodes[at + 1 : first + 3])]
        at //= 3
    return proof


def manifest_by_hand(rows, altered):
    """``rows``: (doc_id, source, leaf); ``altered``: the leaf to fold for a row, or None."""
    sources = sorted({s for _, s, _ in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees, order = {}, {}
    for s in sources:
        order[s] = sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
        trees[s] = climbed([r[2] for r in order[s]])
    over = climbed([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for at, row in enumerate(order[s]):
            proof = siblings(trees[s], at) + siblings(over, k)
            node = altered(row) or row[2]
            for i in range(0, len(proof), 2):
                node = hashed(proof[i], node, proof[i + 1])
            out.append((row[0], row[2], trees[s][-1][0], over[-1][0], proof, node))
    return sorted(out, key=str)


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_manifest(spark, monkeypatch, levels):
    monkeypatch.setattr(manifest, "LEVELS", levels)
    monkeypatch.setattr(manifest, "SPAN", 3**levels)
    rng = random.Random(levels)
    ids = [None, None, None, -5, -1024, -1025, 0, 63, 64, 1023, 1024, 2**40, 2**62, -(2**62)]
    ids += [rng.randrange(-3000, 5000) for _ in range(300)] + [7] * 40 + [rng.randrange(2**50) for _ in range(20)]
    names = [None, "", "a", "ä", "z", "src10", "src9"] + [f"s{i}" for i in range(20)]
    rows = [(i, rng.choice(names[:7] if rng.random() < 0.9 else names), f"t{rng.randrange(60)}") for i in ids]
    rows += [(7, "a", "same")] * 30 + [(None, "a", "same")] * 5 + [(1, "lonely", None)]
    docs = spark.createDataFrame(
        [(i, t, s, "leaf", 0, "x") for i, s, t in rows],
        "doc_id long, text string, source string, leaf string, tree int, part string",
    ).repartition(4)
    leaf = manifest.leaf(["doc_id", "source", "text"])
    odd = F.when(F.pmod("doc_id", F.lit(2)) == 1, F.sha2(F.lit("other"), 256))
    got = manifest.manifest(docs, leaf, odd).collect()
    code = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaves = [(i, s, hashed(code(i), code(s), code(t))) for i, s, t in rows]
    want = manifest_by_hand(leaves, lambda r: hashed("other") if r[0] is not None and r[0] % 2 == 1 else None)
    assert sorted(map(tuple, got), key=str) == want
    for r in got[:20]:
        assert manifest.fold(r.leaf, r.proof) == r.root


@pytest.mark.parametrize("rows", [[], [(1, "a")], [(1, "a"), (2, "b")], [(1, None)], [(None, None)]])
def test_small_manifests(spark, rows):
    docs = table(spark, rows).withColumn("source", F.col("text"))
    got = manifest.digests(manifest.manifest(docs, manifest.leaf(["doc_id", "text"]))).collect()
    assert len(got) == len(rows) and all(r.verified for r in got)
    if len(rows) == 1:
        assert got[0].leaf == got[0].subroot == got[0].root
