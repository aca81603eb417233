"""Merkle manifest of a dataset: a tree per language, a root over all, and an inclusion proof per row.

Leaves are sha256 digests of the fields of a row. Within a language they ascend by doc_id (null first, ties by
digest); every ``FAN`` consecutive nodes become one node of the level above, until one is left, the language's
subroot. Subroots, ordered by language (null first, bytewise), are the leaves of the tree that ends in the root.

Proofs come from pointer jumping: each node holds the segment of siblings on the way to an ancestor, and a
self-join replaces the ancestor by the ancestor's ancestor and appends its segment, so the distance doubles until
every leaf holds its way to the root. Nodes whose segments no leaf can ask for any more are left out of the next
round.

Places in a level come from one range sort and counts per sorted partition, not from a window over a language, so
a language with most of the rows is no single task. A group holds at most ``FAN`` nodes.

Edge cases: null fields are written ``-``; a null doc_id sorts first and is never tampered with; repeated rows are
separate leaves next to each other; an empty table gives no rows; a table of one row has the leaf as root and the
digest of the empty text as proof. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, remainder_of_id, stage

FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TOP = "/"
# Most nodes whose segments (at most a few kB each) are sent to every executor; more are joined by a shuffle.
NEAR = 10_000
# Most trees whose sizes are sent to every executor.
NEAR_TREES = 100_000
_WAY = "array<struct<at:int,others:binary>>"
_PLACE = "struct<tree:string,level:int,pos:bigint>"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: Column) -> Column:
    """sha256 of a text's UTF-8 bytes, as 32 bytes."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def as_text(node: Column) -> Column:
    return F.lower(F.hex(node))


def leaf_of(fields: dict[str, Column]) -> Column:
    """Digest of the fields in order: ``-`` for null, else byte count, ``:`` and value."""
    parts = []
    for value in fields.values():
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return digest(F.concat(*parts))


def lower_ascii(text: Column) -> Column:
    return F.translate(text.cast("string"), _UPPER, _LOWER)


def placed(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """Adds ``pos``, the place (from 0) of each row among those of its ``tree``, by ``order``; a written table."""
    keys = ["tree", *order]
    # Rows that tie in all of the order are equal; where they lie spreads many of them over partitions.
    rows = rows.withColumn("_place", F.spark_partition_id())
    laid = (rows.repartitionByRange(*keys, "_place").sortWithinPartitions(*keys, "_place").drop("_place")
            .withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    laid = stage(laid, f"{label}-sorted")
    # A tree's rows of one partition are consecutive, so a place is an offset from the first of them.
    runs = laid.groupBy("tree", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = stage(runs.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"), f"{label}-runs")
    return (laid.join(bounded(runs, runs.count(), 100_000), ["tree", "_part"])
            .withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before")).drop("_part", "_at", "_first", "_before"))


def _grouped(nodes: DataFrame, extra: list[str]) -> DataFrame:
    """Parents of the nodes: tree, pos, kids (in order) and node, the digest of the kids' digests."""
    kids = F.array_sort(F.collect_list(F.struct("pos", "node", *extra)))
    return (nodes.groupBy("tree", F.floor(F.col("pos") / FAN).alias("up")).agg(kids.alias("kids"))
            .withColumn("node", digest(F.array_join(F.transform("kids", lambda k: as_text(k["node"])), "")))
            .withColumnRenamed("up", "pos"))


def tree_levels(nodes: DataFrame, extra: list[str], label: str) -> tuple[list[DataFrame], DataFrame]:
    """Written groups of each level from the leaves up, and the one node left of each tree (tree, node, level).

    The ``extra`` columns go along with the leaves only.
    """
    levels, alone = [], None
    while True:
        sizes = stage(nodes.groupBy("tree").agg((F.max("pos") + 1).alias("size")), f"{label}-sizes")
        trees, largest = sizes.agg(F.count(F.lit(1)), F.max("size")).first()
        done = bounded(sizes.where("size = 1").select("tree"), trees, NEAR_TREES)
        carried = [] if levels else extra
        ended = nodes.join(done, "tree", "left_semi").select("tree", "node", F.lit(len(levels)).alias("level"), *carried)
        alone = ended if alone is None else alone.unionByName(ended, allowMissingColumns=True)
        if (largest or 0) <= 1:
            return levels, alone
        levels.append(stage(_grouped(nodes.join(done, "tree", "left_anti"), carried), f"{label}-level"))
        nodes = levels[-1].select("tree", "pos", "node")


def _segments(levels: list[DataFrame], ends: DataFrame, extra: list[str]) -> DataFrame:
    """A row per node below the root of each tree: its level and place, its siblings, and its parent.

    ``last`` says that the parent is the one node left of its tree.
    """
    found = None
    kid, kinds = F.col("kid"), levels[0].schema["kids"].dataType.elementType
    others = F.array_join(F.transform(F.filter("kids", lambda x: x["pos"] != kid["pos"]), lambda x: F.hex(x["node"])), "")
    step = F.struct((kid["pos"] % FAN).cast("int").alias("at"), F.unhex(others).alias("others"))
    for k, groups in enumerate(levels):
        carried = [(F.lit(None).cast(kinds[c].dataType) if k else kid[c]).alias(c) for c in extra]
        rows = (groups.withColumnsRenamed({"pos": "up_pos", "node": "up_node"}).withColumn("kid", F.explode("kids"))
                .select("tree", F.lit(k).alias("level"), kid["pos"].alias("pos"), kid["node"].alias("node"), "up_pos", "up_node",
                        F.array(step).alias("segment"), *carried))
        found = rows if found is None else found.unionByName(rows)
    tops = stage(ends.select("tree", F.col("level").alias("end")), "tree-ends")
    return (found.join(bounded(tops, tops.count(), NEAR_TREES), "tree")
            .withColumn("last", F.col("level") + 1 == F.col("end")).drop("end"))


def manifest(docs: DataFrame, tampered: Callable[[], Column] = lambda: F.coalesce(remainder_of_id() == 0, F.lit(False))) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; digests as lowercase hex text.

    ``tampered`` says whose text is taken with A-Z lower-cased when the root is computed from leaf and proof.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    fields = {c: F.col(c) for c in FIELDS}
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("tree"),
        leaf_of(fields).alias("node"),
        F.when(tampered() & (lower_ascii(text) != text), leaf_of(fields | {"text": lower_ascii(text)})).alias("shown"))
    extra = ["doc_id", "shown"]
    leaves = placed(stage(rows, "leaves"), ["doc_id", "node"], "leaves")
    levels, ends = tree_levels(leaves, extra, "lang")
    subroots = stage(ends, "subroots")
    ranked = stage(placed(subroots.select(F.lit(TOP).alias("tree"), F.col("tree").alias("lang"), "node"), ["lang"], "ranks"), "ranked")
    upper, roots = tree_levels(ranked.select("tree", "pos", "node"), [], "top")
    root = roots.select(as_text(F.col("node")).alias("root")).first()
    root = F.lit(root[0] if root else None).cast("string")

    # A language's only leaf is its subroot: nothing lies on the way there.
    low = subroots.where("level = 0").select(
        "tree", "level", F.lit(0).cast("long").alias("pos"), "node", F.lit(None).cast("long").alias("up_pos"),
        F.col("node").alias("up_node"), F.expr(f"CAST(array() AS {_WAY})").alias("segment"), *extra, F.lit(True).alias("last"))
    if levels:
        low = _segments(levels, subroots, extra).unionByName(low)
    onwards = F.lit(None).cast(_PLACE)
    if upper:  # from its subroot on, a way goes through the upper tree
        rank = ranked.select(F.col("lang").alias("_lang"), F.col("pos").alias("_rank"))
        low = low.join(bounded(rank, rank.count(), NEAR_TREES), F.col("tree") == F.col("_lang"), "left")
        onwards = F.struct(F.lit(TOP).alias("tree"), F.lit(0).alias("level"), F.col("_rank").alias("pos"))
    above = F.struct("tree", (F.col("level") + 1).alias("level"), F.col("up_pos").alias("pos"))
    nodes = low.select("tree", "level", "pos", "segment", F.when(F.col("last"), onwards).otherwise(above).alias("up"),
                       F.when(F.col("last"), F.col("up_node")).alias("subroot"), "doc_id", "shown",
                       F.when(F.col("level") == 0, F.col("node")).alias("leaf"))
    if upper:
        nodes = nodes.unionByName(_segments(upper, roots, []).select(
            "tree", "level", "pos", "segment", F.when(~F.col("last"), above).alias("up")), allowMissingColumns=True)

    reach, depth = 1, max(len(levels), 1) + len(upper)
    while reach < depth:
        nodes = _doubled(stage(nodes, "ways"), reach)
        reach *= 2
    shown = as_text(F.coalesce("shown", "leaf"))

    def joined(acc, step):
        before, after = (as_text(F.substring(step["others"], *at)) for at in (
            (F.lit(1), step["at"] * 32), (step["at"] * 32 + 1, F.octet_length(step["others"]))))
        return F.sha2(F.concat(before, acc, after).cast("binary"), 256)

    proof = F.array_join(F.transform("segment", lambda step: as_text(step["others"])), "")
    return (nodes.where("leaf IS NOT NULL")
            .select("doc_id", as_text(F.col("leaf")).alias("leaf"), as_text(F.col("subroot")).alias("subroot"), root.alias("root"),
                    F.sha2(proof.cast("binary"), 256).alias("proof_sha256"), F.aggregate("segment", shown, joined).alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))


def _doubled(nodes: DataFrame, reach: int) -> DataFrame:
    """Ways of ``reach`` levels become twice as long, or end at the root.

    Only nodes at multiples of the new reach go on: no leaf will ask for another. The upper tree is kept whole,
    because languages meet it at different heights.
    """
    top, place = F.col("tree") == TOP, F.col("level") % (2 * reach)
    goes_on = nodes.where(top | (place == 0))
    there = nodes.where(top | (place == reach)).select(
        *[F.col(c).alias(f"_{c}") for c in ("tree", "level", "pos", "segment", "up", "subroot")])
    same = (F.col("up.tree") == F.col("_tree")) & (F.col("up.level") == F.col("_level")) & (F.col("up.pos") == F.col("_pos"))
    longer = (goes_on.where("up IS NOT NULL").join(bounded(there, there.count(), NEAR), same)
              .select("tree", "level", "pos", F.concat("segment", "_segment").alias("segment"), F.col("_up").alias("up"),
                      F.coalesce("subroot", "_subroot").alias("subroot"), "doc_id", "shown", "leaf"))
    return longer.unionByName(goes_on.where("up IS NULL"))


def oracle(levels: int = 7) -> str:
    """SQL for ``manifest``, for trees of up to ``FAN ** levels`` leaves: level by level, without jumps."""
    # crc32 bit by bit: each character is followed by eight shifts, written -1.
    crc = ("xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), "
           "lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) "
           "WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295)")

    def leaf(text):
        values = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
        return "sha256(" + " || ".join(f"coalesce(CAST(strlen({v}) AS VARCHAR) || ':' || {v}, '-')" for v in values) + ")"

    lower = f"translate(text, '{_UPPER}', '{_LOWER}')"
    parts = [f"""rows AS (SELECT doc_id, lang, {leaf('text')} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS shown
                 FROM documents)""",
             """placed AS (SELECT *, coalesce('=' || lang, '') AS tree,
                row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM rows)""",
             "low0 AS (SELECT tree, pos, leaf AS h FROM placed)"]

    def climb(name):
        for k in range(levels):
            here = f"{name}{k}"
            parts.append(f"{here}m AS (SELECT tree FROM {here} GROUP BY tree HAVING count(*) > 1)")
            parts.append(f"""{name}{k + 1} AS (SELECT tree, pos // {FAN} AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM {here}
                             WHERE tree IN (SELECT tree FROM {here}m) GROUP BY tree, pos // {FAN})""")
            parts.append(f"""{here}s AS (SELECT a.tree, a.pos, coalesce(string_agg(CASE WHEN b.pos < a.pos THEN b.h END, '' ORDER BY b.pos), '') AS pre,
                             coalesce(string_agg(CASE WHEN b.pos > a.pos THEN b.h END, '' ORDER BY b.pos), '') AS post
                             FROM {here} a JOIN {here} b ON a.tree = b.tree AND a.pos // {FAN} = b.pos // {FAN}
                             WHERE a.tree IN (SELECT tree FROM {here}m) GROUP BY a.tree, a.pos)""")
        ends = " UNION ALL ".join(f"SELECT tree, h FROM {name}{k} WHERE tree NOT IN (SELECT tree FROM {name}{k}m)" for k in range(levels))
        parts.append(f"{name}_end AS ({ends})")

    climb("low")
    parts.append("top0 AS (SELECT '/' AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, h, tree AS lang_tree FROM low_end)")
    climb("top")
    parts.append("""way0 AS (SELECT p.doc_id, p.leaf, p.tree, p.pos, t.pos AS rank, t.h AS subroot, p.shown AS folded, '' AS proof
                    FROM placed p JOIN top0 t ON p.tree = t.lang_tree)""")
    steps = [("low", k, "w.tree", f"w.pos // {FAN ** k}") for k in range(levels)]
    steps += [("top", k, "'/'", f"w.rank // {FAN ** k}") for k in range(levels)]
    for n, (name, k, tree, at) in enumerate(steps):
        parts.append(f"""way{n + 1} AS (SELECT w.doc_id, w.leaf, w.tree, w.pos, w.rank, w.subroot,
                         CASE WHEN s.pos IS NULL THEN folded ELSE sha256(s.pre || folded || s.post) END AS folded,
                         proof || coalesce(s.pre || s.post, '') AS proof FROM way{n} w LEFT JOIN {name}{k}s s ON s.tree = {tree} AND s.pos = {at})""")
    return "WITH " + ",\n".join(parts) + f"""
        SELECT doc_id, leaf, subroot, (SELECT h FROM top_end) AS root, sha256(proof) AS proof_sha256, folded AS folded_root,
               folded = (SELECT h FROM top_end) AS verified FROM way{len(steps)}"""
