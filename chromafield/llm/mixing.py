"""Mixing sources to target weights, by budgets over a tree of domain, language and source.

The budget of tokens starts at the root and is shared among a node's children by weight, but no
child gets more than all its documents over ``max_epochs`` give.  What a short child leaves
goes to its siblings by their weights; only what all siblings together cannot take goes to the
parent's siblings, because a node never asks for more than its subtree holds.  A leaf then
takes the prefix of an endless stream: epoch after epoch of its documents, each epoch in an
order of its own that follows from the seed, up to its budget.

All shares are whole numbers: a child gets ``weight * rest div weights``, so a node may leave a
few tokens.  A prefix ends before the first document that would exceed the budget.

A leaf may hold a third of all rows, so its order is never built in one task: an epoch is cut
into ``RANGES`` ranges of the order's hash, summed before the exchange; only the range in which
the budget ends is sorted.  The scan of the documents then compares each with its leaf's cut.

Defined results: null names count as ``unknown``; null token counts as 0; nodes without a given
weight have weight 1; leaves without any token give nothing; rows that repeat an id in a leaf
share their place in the order and are taken or left together; an empty table gives an empty
result; only the number of a text's tokens matters, however long it is.  Names that begin with ``__`` are
reserved.  Columns ``domain, epoch, tokens``
replace input columns of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chromafield.session import configure, store_table

RANGES = 4_096
LEVELS = ("__domain", "__lang", "__source")


@dataclass(frozen=True)
class Mixture:
    """``weights``: whole numbers by path, such as ``("web",)`` or ``("web", "en", "src0")``.

    The budget is ``total_tokens``, or else ``percent`` of the tokens of one epoch of everything.
    """

    weights: dict[tuple[str, ...], int] = field(default_factory=dict)
    percent: int = 80
    total_tokens: int | None = None
    max_epochs: int = 2
    seed: int = 1


def _weight(weights: dict[tuple[str, ...], int], depth: int) -> Column:
    """Weight of the node that the first ``depth`` level columns name."""
    own = {k: v for k, v in weights.items() if len(k) == depth}
    if any(v < 0 or v != int(v) for v in own.values()):
        raise ValueError("weights are whole numbers of at least 0")
    if not own:
        return F.lit(1).cast("decimal(38,0)")
    pairs = [x for k, v in own.items() for x in (F.array(*map(F.lit, k)), F.lit(int(v)))]
    found = F.lit(1)
    for path, weight in zip(pairs[::2], pairs[1::2]):
        found = F.when(F.array(*LEVELS[:depth]) == path, weight).otherwise(found)
    return found.cast("decimal(38,0)")


def _shared(nodes: DataFrame, parents: DataFrame | None, budget: int, depth: int, mixture: Mixture) -> DataFrame:
    """``nodes`` (level columns and ``cap``) with their ``budget``."""
    above, names = list(LEVELS[: depth - 1]), list(LEVELS[:depth])
    rows = nodes.withColumn("w", _weight(mixture.weights, depth))
    if parents is None:
        rows = rows.withColumn("b", F.lit(budget).cast("decimal(38,0)"))
    else:
        rows = rows.join(parents.select(*above, F.col("budget").alias("b")), above)
    # those that are full first are full at the smallest capacity per weight
    rows = rows.withColumn("r", F.when(F.col("w") > 0, F.col("cap").cast("double") / F.col("w").cast("double")))
    group = Window.partitionBy(*above)
    order = group.orderBy(F.col("r").asc_nulls_last(), *names)
    rows = rows.withColumns(
        {
            "before": F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "rest": F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    rows = rows.withColumn(
        "full", (F.col("w") > 0) & (F.col("cap") * F.col("rest") <= F.col("w") * (F.col("b") - F.col("before")))
    )
    rows = rows.withColumns(
        {
            "taken": F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(group), F.lit(0)),
            "open": F.sum(F.when(~F.col("full"), F.col("w"))).over(group),
        }
    )
    part = F.expr("(w * (b - taken)) div nullif(open, 0)")
    budget_col = F.when(F.col("full"), F.col("cap")).otherwise(F.coalesce(part, F.lit(0)))
    return rows.select(*names, "cap", budget_col.cast("decimal(38,0)").alias("budget"))


def budgets(leaves: DataFrame, mixture: Mixture) -> DataFrame:
    """``leaves`` (level columns and ``tokens``) with ``budget``, ``epochs`` (whole) and ``rest``."""
    total = mixture.total_tokens
    if total is None:
        total = int(leaves.agg(F.sum("tokens")).first()[0] or 0) * mixture.percent // 100
    nodes = leaves.withColumn("cap", (F.col("tokens") * mixture.max_epochs).cast("decimal(38,0)"))
    upper = [nodes.groupBy(*LEVELS[:d]).agg(F.sum("cap").cast("decimal(38,0)").alias("cap")) for d in (1, 2)]
    domains = _shared(upper[0], None, total, 1, mixture)
    langs = _shared(upper[1], domains, total, 2, mixture)
    shared = _shared(nodes.select(*LEVELS, "cap"), langs, total, 3, mixture)
    return (
        leaves.join(shared.select(*LEVELS, "budget"), list(LEVELS))
        .withColumn("epochs", F.expr("coalesce(budget div nullif(cast(tokens as decimal(38,0)), 0), 0)"))
        .withColumn("rest", (F.col("budget") - F.col("epochs") * F.col("tokens")).cast("long"))
    )


def _place(mixture: Mixture, epoch: Column, doc_id: Column) -> Column:
    """Place of a document in an epoch's order: a hash in hexadecimal digits."""
    parts = [F.lit(str(mixture.seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null"))]
    return F.md5(F.concat_ws(":", *parts).cast("binary"))


def _range(place: Column) -> Column:
    return F.conv(F.substring(place, 1, 3), 16, 10).cast("int")  # RANGES of them


def mix(
    docs: DataFrame,
    mixture: Mixture,
    domain: Column,
    tokens: Column,
    id_col: str = "doc_id",
    lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """Rows of ``docs`` as often as the mixture takes them, with ``domain, tokens, epoch``."""
    configure(docs.sparkSession)
    named = docs.withColumns(
        {
            "__domain": F.coalesce(domain, F.lit("unknown")),
            "__lang": F.coalesce(F.col(lang_col), F.lit("unknown")),
            "__source": F.coalesce(F.col(source_col), F.lit("unknown")),
            "__tokens": F.coalesce(tokens.cast("long"), F.lit(0)),
        }
    )
    narrow = store_table(named.select(*LEVELS, F.col(id_col).alias("__id"), "__tokens"), "mix-rows")
    leaves = store_table(narrow.groupBy(*LEVELS).agg(F.sum("__tokens").alias("tokens")), "mix-leaves")
    plan = store_table(budgets(leaves, mixture), "mix-budgets")

    # the leaves are a small stored table, which Spark broadcasts if its size allows
    placed = narrow.join(plan.where("rest > 0"), list(LEVELS)).withColumn(
        "__place", _place(mixture, F.col("epochs"), F.col("__id"))
    )
    placed = placed.withColumn("__range", _range(F.col("__place")))
    upto = Window.partitionBy(*LEVELS).orderBy("__range")
    ends = store_table(
        placed.groupBy(*LEVELS, "rest", "__range")
        .agg(F.sum("__tokens").alias("sum"))
        .withColumn("upto", F.sum("sum").over(upto))
        .where("upto > rest and upto - sum <= rest")
        .select(*LEVELS, F.col("__range").alias("end"), (F.col("rest") - F.col("upto") + F.col("sum")).alias("left")),
        "mix-ends",
    )
    # peers share an id and their running sum
    running = Window.partitionBy(*LEVELS).orderBy("__place")
    cuts = store_table(
        placed.join(ends, list(LEVELS))
        .where("__range = end")
        .withColumn("sum", F.sum("__tokens").over(running))
        .where("sum <= left")
        .groupBy(*LEVELS)
        .agg(F.max("__place").alias("cut")),
        "mix-cuts",
    )
    table = store_table(
        plan.select(*LEVELS, "epochs").join(ends, list(LEVELS), "left").join(cuts, list(LEVELS), "left"), "mix-plan"
    )

    place = _place(mixture, F.col("epochs"), F.col(id_col))
    inside = (_range(place) < F.col("end")) | ((_range(place) == F.col("end")) & (place <= F.col("cut")))
    copies = F.col("epochs") + F.when(inside, 1).otherwise(0)
    taken = named.join(table, list(LEVELS)).withColumn("__copies", copies.cast("int")).where("__copies > 0")
    own = ["domain", "tokens", "epoch"]
    return taken.select(
        *[c for c in docs.columns if c not in own],
        F.col("__domain").alias("domain"),
        F.col("__tokens").alias("tokens"),
        F.explode(F.sequence(F.lit(0), F.col("__copies") - 1)).alias("epoch"),
    )
