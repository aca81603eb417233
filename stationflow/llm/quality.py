"""Quality classifier from a sparse rule ensemble (Friedman and Popescu, 2008).

Statistics of the text are Spark column expressions. Shallow random-forest trees on a bounded labelled
sample give candidate rules: each path from a root to a node is a conjunction of thresholds on
statistics. A lasso logistic regression keeps few rules; the model is compiled into one Spark column
expression, so scoring a table is a single projection.

Edge cases: null and empty texts have statistics of zero and are scored like any text; rows with a null
doc_id are scored and never train; repeated labels of a doc_id count once (the larger). Without labels
of both classes the score is the share of label 1, or 0.5 without labels. Extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import remainder_of_id, stage, text_or_empty

# Weights are rounded to so many digits, so that equal and opposite ones cancel.
DIGITS = 6
_SPLIT = re.compile(r"(If|Else) \(feature (\d+) (<=|>) ([-\d.eE]+)\)")


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text; ratios are 0 where there is nothing to count.

    ``_words`` and ``_lines`` are helper arrays that the other columns read.
    """
    chars = F.length(text)

    def share(pattern):
        return F.regexp_count(text, F.lit(pattern)) / F.greatest(chars, F.lit(1))

    words, lines = F.col("_words"), F.col("_lines")
    n_words, n_lines = F.size(words), F.size(lines)
    repeats = F.size(F.filter(words, lambda w, i: (i > 0) & (w == F.get(words, i - 1))))
    return {
        "log_chars": F.log1p(chars),
        "upper": share("[A-Z]"),
        "digit": share("[0-9]"),
        "mark": share("[!?]"),
        "symbol": share(r"[#$%&*+/<=>@\\^_|~{}\[\]]"),
        "stop": share("[.,;:]"),
        "word_length": chars / F.greatest(n_words, F.lit(1)),
        "distinct_words": F.size(F.array_distinct(words)) / F.greatest(n_words, F.lit(1)),
        "stuttered": repeats / F.greatest(n_words, F.lit(1)),
        "distinct_lines": F.size(F.array_distinct(lines)) / F.greatest(n_lines, F.lit(1)),
        "line_length": chars / F.greatest(n_lines, F.lit(1)),
        "words_per_line": n_words / F.greatest(n_lines, F.lit(1)),
        "log_words": F.log1p(n_words),
    }


def with_statistics(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """doc_id and the statistics of ``text``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.select("*", F.split("text", " ").alias("_words"), F.split("text", "\n").alias("_lines"))
    found = statistics(F.col("text"))
    return rows.select("doc_id", *[c.cast("double").alias(f"s_{n}") for n, c in found.items()]), [f"s_{n}" for n in found]


Rule = tuple[tuple[str, str, float], ...]


def rules_of(description: str, names: list[str]) -> set[Rule]:
    """Conjunctive rules of all nodes below the roots, from a forest's printed trees."""
    rules: set[Rule] = set()
    path: list[tuple[int, tuple[str, str, float]]] = []
    for line in description.splitlines():
        found = _SPLIT.search(line)
        if found:
            depth = found.start()
            path = [p for p in path if p[0] < depth]
            path.append((depth, (names[int(found[2])], found[3], float(found[4]))))
            rules.add(tuple(c for _, c in path))
        elif "Tree" in line:
            path = []
    return rules


def rule_column(rule: Rule) -> Column:
    holds = F.lit(True)
    for name, sign, bound in rule:
        holds = holds & (F.col(name) <= bound if sign == "<=" else F.col(name) > bound)
    return holds.cast("double")


@dataclass
class RuleModel:
    bias: float
    terms: list[tuple[Rule, float]]

    def column(self) -> Column:
        """The score as one Spark expression over the statistics."""
        total = F.lit(self.bias)
        for rule, weight in self.terms:
            total = total + F.when(rule_column(rule) == 1, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int) -> tuple[DataFrame, list[str]]:
    """Statistics of at most ``max_rows`` labelled texts, half of each class if there are enough.

    Rows whose crc32(doc_id) leaves 1 modulo 3 are kept out; the order is by a hash of doc_id.
    """
    marks = (labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id")
             .agg(F.max("quality").cast("double").alias("label")).where(remainder_of_id() != 1))
    order, half = F.xxhash64("doc_id", F.lit("sample")), max_rows // 2
    chosen = (marks.where("label = 1").orderBy(order, "doc_id").limit(half)
              .unionByName(marks.where("label = 0").orderBy(order, "doc_id").limit(half)))
    # Bounded by max_rows, so the broadcast is.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    found, names = with_statistics(rows.select("doc_id", "text"))
    once = found.groupBy("doc_id").agg(F.min(F.struct(*names)).alias("s")).select("doc_id", "s.*")
    return once.join(F.broadcast(chosen), "doc_id"), names


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 8000, trees: int = 16, depth: int = 3,
          lasso: float = 2e-3, seed: int = 7) -> RuleModel:
    rows, names = training_rows(docs, labels, max_rows)
    rows = stage(rows, "quality_sample")
    counts = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(counts) < 2:
        share = (counts.get(1.0, 0) + 0.5) / (sum(counts.values()) + 1)
        from math import log
        return RuleModel(log(share / (1 - share)), [])
    rows = rows.withColumn("w", F.when(F.col("label") == 1, 1 / counts[1.0]).otherwise(1 / counts[0.0]) * sum(counts.values()) / 2)
    # At most max_rows rows of a few numbers, in one place and order, so that no sum depends on the partitioning.
    rows = stage(rows.repartition(1).sortWithinPartitions("doc_id"), "quality_rows").coalesce(1)
    table = VectorAssembler(inputCols=names, outputCol="x").transform(rows).select("x", "label", "w").persist()
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", weightCol="w", numTrees=trees, maxDepth=depth,
                                    featureSubsetStrategy="0.6", subsamplingRate=0.7, seed=seed).fit(table)
    table.unpersist()
    rules = different_rules(rows, sorted(rules_of(forest.toDebugString, names)))
    if not rules:
        return RuleModel(0.0, [])
    lines = rows.select("label", "w", F.array(*[rule_column(r) * F.lit(worth) for r, worth in rules]).alias("a"))
    from pyspark.ml.functions import array_to_vector
    lines = lines.select("label", "w", array_to_vector("a").alias("x")).persist()
    lasso_fit = LogisticRegression(featuresCol="x", labelCol="label", weightCol="w", regParam=lasso, elasticNetParam=1.0,
                                   standardization=False, maxIter=100).fit(lines)
    lines.unpersist()
    weights = [round(float(v) * worth, DIGITS) for v, (_, worth) in zip(lasso_fit.coefficients, rules)]
    return RuleModel(round(float(lasso_fit.intercept), DIGITS), [(r, v) for (r, _), v in zip(rules, weights) if v != 0.0])


def different_rules(rows: DataFrame, rules: list[Rule]) -> list[tuple[Rule, float]]:
    """Rules that divide the sample differently, each with its worth.

    A rule that holds for the same rows as another, or for all others, says the same; two of them would share a
    weight between equal columns. Of such rules the one with the widest margin stays: its thresholds lie farthest
    from any value of the sample, in standard deviations. Worth is how much better than a guess the rule tells the
    classes apart (0 to 1): the lasso sees a rule's column times its worth, so it takes a rule without errors first.
    """
    if not rules:
        return []
    mark = F.xxhash64("doc_id").cast("decimal(38,0)")
    holds = [rule_column(r) == 1 for r in rules]
    counted = rows.agg(F.sum(mark).alias("all"), *[F.sum(F.when(h, mark)).alias(f"m{i}") for i, h in enumerate(holds)]).first()
    weighed = rows.agg(*[F.sum(F.when(h == (F.col("label") == 1), F.col("w")).otherwise(0.0)).alias(f"r{i}") for i, h in enumerate(holds)],
                       F.sum("w").alias("w")).first()
    splits = sorted({(name, bound) for r in rules for name, _, bound in r})
    gaps = rows.agg(*[(F.min(F.abs(F.col(name) - bound)) / F.greatest(F.stddev_pop(name), F.lit(1e-9))).alias(f"g{i}")
                      for i, (name, bound) in enumerate(splits)]).first()
    gap = {split: round(gaps[f"g{i}"], DIGITS) for i, split in enumerate(splits)}
    chosen, seen = [], {0, counted["all"]}
    order = sorted(range(len(rules)), key=lambda i: (-min(gap[n, b] for n, _, b in rules[i]), len(rules[i]), rules[i]))
    for i in order:
        covered = counted[f"m{i}"] or 0
        worth = round(abs(2 * weighed[f"r{i}"] / weighed["w"] - 1), DIGITS)
        if covered not in seen and worth:
            seen |= {covered, counted["all"] - covered}
            chosen.append((rules[i], worth))
    return chosen


def score(docs: DataFrame, model: RuleModel, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    rows, _ = with_statistics(docs)
    rows = rows.select("doc_id", model.column().alias("score"))
    return rows.select("doc_id", F.coalesce(remainder_of_id() == 1, F.lit(False)).alias("held_out"), "score",
                       (F.col("score") >= threshold).cast("int").alias("predicted"))
