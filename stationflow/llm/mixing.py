"""Mixing sources to target weights by hierarchical budgets.

Leaves are (domain, language, source). A node's capacity is what its leaves hold times the allowed
epochs. From the root down a node's budget is divided among its children in proportion to their weights,
and a child that cannot take its part leaves the rest to its siblings; only what a whole subtree cannot
take reaches the siblings of its ancestors. Each leaf then reads its documents in a seeded order per
epoch: whole epochs first, then the shortest prefix that reaches the budget.

The prefix needs no sort of a leaf: a histogram of the (uniform) order values finds the bucket in which
the budget ends, and only that bucket is ordered. Texts are read in place, no text is shuffled.

Edge cases: null domain, language or source count as the empty name; null and empty texts have no tokens
and are taken when the prefix passes them; a document is never cut, so a leaf may exceed its budget by
its last document; rows that repeat doc_id and text have one place in the order and stand together.
Weights that are missing are 1; children of weight 0 get nothing. Extra columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, stage

LEVELS = ["_domain", "_lang", "_source"]
BUCKET_ROWS = 1024


def source_domain(source: Column) -> Column:
    """Domain of a source of the ``srcN`` kind: a fixed division of the numbers."""
    number = F.pmod(F.regexp_extract(source, r"(\d+)$", 1).try_cast("long"), F.lit(4))
    return F.when(number == 0, "web").when(number == 1, "books").when(number == 2, "news").when(number == 3, "code").otherwise("other")


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"\S+")).cast("long")


def _weights(spec: dict[str, float] | None, column: str) -> Column:
    pairs = [x for k, v in (spec or {}).items() for x in (F.lit(k), F.lit(float(v)))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(column)), F.lit(1.0)) if pairs else F.lit(1.0)


def divide(children: DataFrame, parents: list[str], node: str) -> DataFrame:
    """Adds ``budget``: the parent's ``above`` filled into children up to ``capacity``, in proportion to ``weight``.

    With the children ordered by capacity / weight, the first ones are full and the others share one
    level; it is the first level that does not lift the next child over its capacity.
    """
    ratio = F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(F.lit(float("inf")))
    rows = children.withColumn("ratio", ratio)
    order = Window.partitionBy(*parents).orderBy("ratio", node) if parents else Window.partitionBy(F.lit(0)).orderBy("ratio", node)
    earlier, later = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    full = F.coalesce(F.sum("capacity").over(earlier), F.lit(0.0))
    share = F.sum("weight").over(later)
    level = F.when(share > 0, F.greatest(F.col("above") - full, F.lit(0.0)) / share).otherwise(0.0)
    rows = rows.withColumn("level", level)
    whole = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", F.col(node).alias("n"), "level"))).over(whole)
    rows = rows.withColumn("first", first)
    before = F.col("first").isNull() | (F.struct("ratio", F.col(node).alias("n")) < F.struct("first.ratio", "first.n"))
    return (rows.withColumn("budget", F.when(before, F.col("capacity")).otherwise(
        F.least("capacity", F.col("first.level") * F.col("weight")))).drop("ratio", "level", "first"))


def leaf_budgets(leaves: DataFrame, budget: float, epochs: int, domain_weights: dict[str, float] | None = None,
                 lang_weights: dict[str, float] | None = None, source_weights: dict[str, float] | None = None) -> DataFrame:
    """``leaves``: the three levels and ``tokens``; adds ``budget``. One row per leaf, never one per document."""
    nodes = leaves.withColumn("capacity", F.col("tokens") * F.lit(float(epochs)))
    above = None
    for depth, (level, spec) in enumerate(zip(LEVELS, (domain_weights, lang_weights, source_weights))):
        parents = LEVELS[:depth]
        children = nodes.groupBy(*LEVELS[:depth + 1]).agg(F.sum("capacity").alias("capacity")).withColumn("weight", _weights(spec, level))
        children = (children.withColumn("above", F.lit(float(budget))) if above is None
                    else children.join(above.select(*parents, F.col("budget").alias("above")), parents))
        above = divide(children, parents, level)
    return nodes.drop("capacity").join(above.select(*LEVELS, "budget"), LEVELS)


def _placed(docs: DataFrame, domain: Column, n_tokens: Column, seed: int) -> DataFrame:
    names = {"_domain": domain, "_lang": F.col("lang"), "_source": F.col("source")}
    return docs.withColumns({k: F.coalesce(c.cast("string"), F.lit("")) for k, c in names.items()}
                            | {"_tokens": n_tokens, "_key": F.xxhash64(F.lit(seed), "doc_id", F.col("text").cast("string"))})


def mix(docs: DataFrame, share: float, epochs: int = 1, seed: int = 17, domain: Column | None = None, n_tokens: Column | None = None,
        domain_weights: dict[str, float] | None = None, lang_weights: dict[str, float] | None = None,
        source_weights: dict[str, float] | None = None) -> DataFrame:
    """Rows of the mixture with their columns, plus _domain, _lang, _source, _tokens and _epoch (from 0).

    The budget is ``share`` of all tokens of ``docs``; a document is read at most ``epochs`` times.
    """
    placed = _placed(docs, source_domain(F.col("source")) if domain is None else domain,
                     n_words(F.col("text")) if n_tokens is None else n_tokens, seed)
    narrow = stage(placed.select(*LEVELS, "_tokens", "_key"), "mix_tokens")
    leaves = stage(narrow.groupBy(*LEVELS).agg(F.sum("_tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")), "mix_leaves")
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    plan = leaf_budgets(leaves, share * total, epochs, domain_weights, lang_weights, source_weights)
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0)
    plan = stage(plan.withColumn("whole", F.least(whole, F.lit(epochs)).cast("int"))
                 .withColumn("rest", F.greatest(F.col("budget") - F.col("whole") * F.col("tokens"), F.lit(0.0)))
                 .withColumn("buckets", F.ceil(F.col("rows") / BUCKET_ROWS)), "mix_plan")
    n_leaves = plan.count()
    plan_side = bounded(plan, n_leaves, 100_000)
    # Place in the order of the epoch that is read in part: uniform over 0..2^52.
    place = F.shiftrightunsigned(F.xxhash64("_key", "whole"), 12)
    bucket = F.floor(place / F.lit(float(1 << 52)) * F.col("buckets"))
    rows = narrow.join(plan_side, LEVELS).where("rest >= 1").withColumn("place", place).withColumn("bucket", bucket)
    histogram = rows.groupBy(*LEVELS, "bucket").agg(F.sum("_tokens").alias("n"), F.first("rest").alias("rest"))
    so_far = F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    last = (histogram.withColumn("upto", so_far).where("upto >= rest").groupBy(*LEVELS)
            .agg(F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("before"))).alias("end")))
    last = stage(last.select(*LEVELS, F.col("end.bucket").alias("end_bucket"), F.col("end.before").alias("before")), "mix_ends")
    inside = (rows.join(bounded(last, n_leaves, 100_000), LEVELS).where("bucket = end_bucket")
              .groupBy(*LEVELS, "place", "_key", "before", "rest").agg(F.sum("_tokens").alias("n")))
    running = F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("place", "_key").rowsBetween(Window.unboundedPreceding, 0))
    cut = (inside.withColumn("upto", running + F.col("before")).where("upto - n < rest").groupBy(*LEVELS)
           .agg(F.max(F.struct("place", "_key")).alias("cut")))
    ends = stage(plan.select(*LEVELS, "whole", "rest").join(cut, LEVELS, "left"), "mix_cuts")
    found = placed.join(bounded(ends, n_leaves, 100_000), LEVELS)
    in_prefix = (F.col("rest") >= 1) & F.coalesce(F.struct(place.alias("place"), "_key") <= F.col("cut"), F.lit(False))
    epochs_read = F.col("whole") + in_prefix.cast("int")
    return (found.withColumn("_n", epochs_read).where("_n > 0")
            .withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
            .select(*docs.columns, *LEVELS, "_tokens", "_epoch"))
