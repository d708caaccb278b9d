"""One registered query per operator of this subpackage, with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chromafield.llm import (
    bpe,
    decontamination,
    exact_dedup,
    hard_negatives,
    langid,
    manifest,
    mixing,
    near_dedup,
    quality,
    secrets,
    sharding,
    suffix_dedup,
    toxicity,
)
from chromafield.llm.rows import in_fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return put


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    f"""
    WITH d AS (SELECT doc_id, sha256({LOWER}) AS text_sha256 FROM documents)
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
           doc_id = max(doc_id) OVER g AS kept, text_sha256
    FROM d WINDOW g AS (PARTITION BY text_sha256)
    """
)
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.verdicts(documents(spark, sf_dir))


VOCABULARY = "byte_bpe_multi_50k.tiktoken"


@query()
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    docs = documents(spark, sf_dir)
    encoded = bpe.encode(docs, path, public_tokenizers.PATTERN, keep=["doc_id"])
    return bpe.digests(bpe.decode(encoded, path))


MIXTURE = mixing.Mixture(
    weights={
        ("domain0",): 4,
        ("domain1",): 3,
        ("domain2",): 2,
        ("domain0", "en"): 2,
        ("domain3", "es"): 3,
        ("domain0", "en", "src0"): 2,
    },
    percent=80,
    max_epochs=2,
    seed=11,
)


def source_domain() -> Column:
    """The tables name no domain: four groups of the numbered sources stand for them."""
    number = F.regexp_extract("source", "[0-9]+", 0)
    return F.when(number != "", F.concat(F.lit("domain"), (number.cast("int") % 4).cast("string")))


def word_count() -> Column:
    return F.expr("size(array_remove(split(coalesce(text, ''), '[\\\\x20\\\\x09-\\\\x0D]+'), ''))")


def _share(level: int) -> str:
    """SQL of one level's budgets: what is full first, then the rest by weight."""
    names = ["domain", "lang", "source"][:level]
    above = ["domain", "lang", "source"][: level - 1]
    part = f"PARTITION BY {', '.join(above)}" if above else ""
    cases = " ".join(
        "WHEN " + " AND ".join(f"{c} = '{v}'" for c, v in zip(names, k)) + f" THEN {w}"
        for k, w in MIXTURE.weights.items()
        if len(k) == level
    )
    source = f"JOIN b{level - 1} USING ({', '.join(above)})" if above else ", total"
    return f"""
    n{level} AS (SELECT {', '.join(names)}, sum(tokens)::HUGEINT * {MIXTURE.max_epochs} AS cap,
                        (CASE {cases} ELSE 1 END)::HUGEINT AS w FROM leaves GROUP BY ALL),
    o{level} AS (SELECT n{level}.*, b, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
                        sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
                 FROM n{level} {source} WINDOW o AS ({part} ORDER BY cap::DOUBLE / w::DOUBLE, {', '.join(names)})),
    f{level} AS (SELECT *, cap * rest <= w * (b - before) AS is_full FROM o{level}),
    b{level} AS (SELECT {', '.join(names)}, CASE WHEN is_full THEN cap ELSE
                        (w * (b - coalesce(sum(cap) FILTER (is_full) OVER p, 0)))::HUGEINT
                        // (sum(w) FILTER (NOT is_full) OVER p)::HUGEINT END AS b
                 FROM f{level} WINDOW p AS ({part}))"""


@query(
    f"""
    WITH d AS (
        SELECT doc_id, coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
               CASE WHEN regexp_matches(source, '[0-9]') THEN
                   'domain' || (regexp_extract(source, '[0-9]+')::INTEGER % 4) ELSE 'unknown' END AS domain,
               len(regexp_extract_all(coalesce(text, ''), '[^ \\x09-\\x0D]+')) AS tokens
        FROM documents),
    leaves AS (SELECT domain, lang, source, sum(tokens) AS tokens FROM d GROUP BY ALL),
    total AS (SELECT (sum(tokens)::HUGEINT * {MIXTURE.percent}) // 100 AS b FROM leaves),
    {_share(1)}, {_share(2)}, {_share(3)},
    plan AS (SELECT domain, lang, source, (b3.b // leaves.tokens)::BIGINT AS epochs,
                    (b3.b % leaves.tokens)::BIGINT AS rest
             FROM b3 JOIN leaves USING (domain, lang, source)),
    runs AS (SELECT d.*, epochs, rest, sum(tokens) OVER (
                 PARTITION BY domain, lang, source
                 ORDER BY md5('{MIXTURE.seed}:' || epochs || ':' || doc_id)) AS upto
             FROM d JOIN plan USING (domain, lang, source)),
    copies AS (SELECT *, epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS n FROM runs)
    SELECT doc_id, domain, lang, source, tokens::BIGINT AS tokens, unnest(range(n))::INTEGER AS epoch
    FROM copies WHERE n > 0
    """
)
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", "source")
    return mixing.mix(docs, MIXTURE, source_domain(), word_count()).drop("text")


@query()
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    profiles = langid.learn(docs, ~in_fold("doc_id", 4, 2))
    held = docs.select("doc_id", "text", in_fold("doc_id", 4, 2).alias("held_out"))
    return langid.identify(held, profiles, keep=["doc_id", "held_out"])


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str):
    """Fitted on the labelled rows outside the fold that the contract holds out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.train(docs, labels, ~in_fold("doc_id", 5, 0))


@query()
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity_model(spark, docs, sf_dir)
    held = docs.select("doc_id", "text", in_fold("doc_id", 5, 0).alias("held_out"))
    return toxicity.score(held, model, keep=["doc_id", "held_out"])


@query()
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return sharding.shard(docs, 16).drop("text")


@query()
def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir), keep=["doc_id"])


@query(
    f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text,
                      regexp_extract_all(coalesce(text, ''), '[^ \\x09-\\x0D]+') AS w,
                      list_filter(string_split(coalesce(text, ''), chr(10)),
                                  lambda x: regexp_matches(x, '[^ \\x09-\\x0D]')) AS l
               FROM documents),
    win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') AS v
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
    twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, v) > 1),
    covered AS (SELECT doc_id, count(DISTINCT i + k) AS n
                FROM twice, range(8) r(k) GROUP BY doc_id),
    c AS (SELECT d.doc_id, text, len(l) AS n_lines, len(w) AS n_words,
                 length(array_to_string(w, '')) AS word_chars,
                 len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
                 len(l) - len(list_distinct(l)) AS n_dup_lines,
                 coalesce(n, 0) AS n_repeat_words,
                 length(regexp_replace(text, '[^\\x21-\\x40\\x5B-\\x60\\x7B-\\x7E]+', '', 'g')) AS n_signs
          FROM d LEFT JOIN covered USING (doc_id))
    SELECT doc_id, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, n_dup_lines,
           n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
           NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words
                OR 10 * n_symbols > word_chars OR word_chars < 2 * n_words
                OR word_chars > 40 * n_words OR 10 * n_dup_lines > 3 * n_lines
                OR 2 * n_signs > word_chars) AS kept
    FROM c
    """
)
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return quality.apply_rules(docs).drop("text")


@query()
def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.verdicts(documents(spark, sf_dir), size=4)


@query()
def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return suffix_dedup.digests(suffix_dedup.remove_passages(docs, keep=["doc_id"]))


@query(
    """
    WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                      list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
               FROM embeddings
               WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
                 list_inner_product(a.q, b.q)::BIGINT AS score
          FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
    p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
    r AS (SELECT anchor_id, positive_id, positive_score, other_id AS negative_id,
                 score AS negative_score,
                 (row_number() OVER (PARTITION BY anchor_id, positive_id
                                     ORDER BY score DESC, other_id))::INTEGER AS rank
          FROM p JOIN s USING (anchor_id)
          WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
    SELECT * FROM r WHERE rank <= 5
    """
)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.expr("case when vec_id % 7 = 0 then (label + 1) % 10 else label end")
    return hard_negatives.mine(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


@query(
    f"""
    WITH t AS (SELECT item_id, regexp_extract_all({LOWER}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w
               FROM benchmark),
    i AS (SELECT item_id, least(len(w), 10) AS k,
                 unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2),
                     lambda p: array_to_string(list_slice(w, p, p + least(len(w), 10) - 1), ' '))) AS v
          FROM t WHERE len(w) > 0),
    d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w
          FROM documents),
    k AS (SELECT DISTINCT k FROM i),
    p AS (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS p FROM d, k),
    m AS (SELECT doc_id, p.k, p, item_id FROM p JOIN i
          ON p.k = i.k AND array_to_string(list_slice(w, p, p + p.k - 1), ' ') = i.v),
    h AS (SELECT doc_id, count(DISTINCT p + r) AS n_hit FROM m, range(10) g(r) WHERE r < k GROUP BY doc_id),
    s AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
                 string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
          FROM m GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN h USING (doc_id) LEFT JOIN s USING (doc_id)
    """
)
def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return decontamination.digests(decontamination.search(docs, items, keep=["doc_id"]))


def _encoded(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR) || ':' || {column}::VARCHAR, '-')"


_FIELDS = " || ".join(_encoded(c) for c in ("doc_id", "source", "lang", "n_chars"))
_REST = "ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING"


def _tree(number: int) -> str:
    """SQL of one tree's nodes, level by level, and of each node's siblings."""
    return f"""
    n{number} AS (
        SELECT 0 AS l, t, i, h, n FROM first{number}
        UNION ALL
        SELECT l + 1, t, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3
        FROM n{number} WHERE n > 1 GROUP BY l, t, i // 3, n),
    s{number} AS (
        SELECT l, t, i, coalesce(string_agg(h, '') OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft,
               coalesce(string_agg(h, '') OVER (o {_REST}), '') AS rgt
        FROM n{number} WHERE n > 1 WINDOW o AS (PARTITION BY l, t, i // 3 ORDER BY i)),
    r{number} AS (SELECT t, h FROM n{number} WHERE n = 1)"""


@query(
    f"""
    WITH RECURSIVE
    crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x:
                CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS c
            FROM range(256) r(i)),
    d AS (
        SELECT doc_id, source, sha256({_FIELDS} || {_encoded('text')}) AS leaf,
               sha256({_FIELDS} || {_encoded("replace(text, chr(10), '')")}) AS changed,
               xor(list_reduce(list_prepend(4294967295, list_transform(
                   string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
                   lambda a, b: xor(a >> 8, c[(xor(a, b) & 255) + 1])), 4294967295) % 2 = 0 AS tampered
        FROM documents, crc),
    named AS (SELECT source, (row_number() OVER (ORDER BY source NULLS FIRST)) - 1 AS t
              FROM (SELECT DISTINCT source FROM d)),
    first1 AS (
        SELECT doc_id, t, leaf AS h, CASE WHEN tampered THEN changed ELSE leaf END AS given,
               row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
               count(*) OVER (PARTITION BY t) AS n
        FROM d JOIN named ON d.source IS NOT DISTINCT FROM named.source),
    {_tree(1)},
    first2 AS (SELECT 0 AS t, t AS i, h, count(*) OVER () AS n FROM r1),
    {_tree(2)},
    up1 AS (
        SELECT doc_id, 0 AS l, t, i, h AS leaf, given AS h, '' AS proof FROM first1
        UNION ALL
        SELECT doc_id, l + 1, t, i // 3, leaf, sha256(lft || h || rgt), proof || lft || rgt
        FROM up1 JOIN s1 USING (l, t, i)),
    top1 AS (SELECT * FROM up1 QUALIFY l = max(l) OVER (PARTITION BY t)),
    up2 AS (
        SELECT doc_id, 0 AS l, 0 AS t, t AS i, t AS tree, leaf, h, proof FROM top1
        UNION ALL
        SELECT doc_id, l + 1, t, i // 3, tree, leaf, sha256(lft || h || rgt), proof || lft || rgt
        FROM up2 JOIN s2 USING (l, t, i))
    SELECT doc_id, leaf, r1.h AS subroot, r2.h AS root, sha256(proof) AS proof_sha256,
           up2.h AS folded_root, up2.h = r2.h AS verified
    FROM (SELECT * FROM up2 QUALIFY l = max(l) OVER ()) up2 JOIN r1 ON tree = r1.t, r2
    """
)
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["doc_id", "source", "lang", "n_chars"]
    changed = manifest.leaf([*fields, F.replace("text", F.lit("\n"), F.lit(""))])
    proven = manifest.manifest(
        documents(spark, sf_dir),
        manifest.leaf([*fields, "text"]),
        F.when(in_fold("doc_id", 2, 0), changed),
    )
    return manifest.digests(proven)
