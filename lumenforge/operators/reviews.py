"""What reviewers decide: pairs judged against the truth, and coverage of labels and their media through ids and aliases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scored_pairs(pairs: DataFrame, judgments: DataFrame) -> DataFrame:
    """One row with what judges reached on pairs (pair_id, positive_side, vlm_correct: null if no model saw it).

    judgments: pair_id, choice (A, B, cant_tell), confidence, flags. A judgment of an unknown pair is an error that names some.
    """
    unknown = judgments.join(pairs.select("pair_id"), "pair_id", "left_anti").select("pair_id").limit(3).collect()
    if unknown:
        raise ValueError(f"judgments of unknown pairs: {sorted(r['pair_id'] for r in unknown)}")
    j = judgments.join(pairs, "pair_id")
    decided, sure, seen = F.col("choice").isin("A", "B"), F.col("confidence") == "sure", F.col("vlm_correct").isNotNull()
    right = F.col("choice") == F.col("positive_side")
    counts = {"decided": decided, "cant_tell": F.col("choice") == "cant_tell", "correct": decided & right, "sure": decided & sure, "sure_correct": decided & sure & right, "decided_on_both": decided & seen, "human_correct": decided & seen & right}
    own = j.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in counts.items()])
    flags = j.select(F.explode("flags").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n")).agg(F.array_sort(F.collect_list(F.struct("f", "n"))).alias("flags"))  # a row for each kind of flag
    whole = pairs.agg(F.count(F.lit(1)).alias("pairs"), F.count("vlm_correct").alias("both_saw"), F.count_if("vlm_correct").alias("vlm_correct"))
    return whole.join(own, F.lit(True)).join(flags, F.lit(True))  # one row each


def enriched_labels(labels: DataFrame, visual: DataFrame, decisions: DataFrame, rules: Sequence[tuple[str, DataFrame, bool]]) -> DataFrame:
    """labels (item_id, alias: null or another id of the same) with what covers them under either id.

    visual: item_id of features; decisions: item_id, decision; rules: name, item_id, and whether an alias counts. Ids meet in
    one join for each set; nothing is collected but a label's own decisions and rules.
    """
    ids = labels.select("item_id", F.explode(F.array_distinct(F.array_compact(F.array("item_id", "alias")))).alias("id"))
    seen = visual.select(F.col("item_id").alias("id"), F.lit(True).alias("visual")).distinct()
    given = decisions.groupBy(F.col("item_id").alias("id")).agg(F.array_sort(F.collect_list("decision")).alias("d"))
    d = ids.join(seen, "id", "left").join(given, "id", "left")
    hits = []
    for i, (name, df, by_alias) in enumerate(rules):
        d = d.join(df.select(F.col("item_id").alias("id"), F.lit(True).alias(f"r{i}")).distinct(), "id", "left")
        own = F.col(f"r{i}").isNotNull() & (F.lit(by_alias) | (F.col("id") == F.col("item_id")))
        hits.append(F.when(F.max(own), F.lit(name)))
    g = d.groupBy("item_id").agg(F.coalesce(F.max("visual"), F.lit(False)).alias("visual"), F.array_sort(F.flatten(F.collect_list(F.coalesce("d", F.array().cast("array<string>"))))).alias("decisions"), F.array_compact(F.array(*hits)).alias("rules"))
    return labels.join(g, "item_id").select(*labels.columns, "visual", "decisions", "rules", (F.size("decisions") > 0).alias("complete"))


def media_of(labels: DataFrame, media: DataFrame) -> DataFrame:
    """media (path, item_id: one row for each label it names) rolled up: complete only if all its known labels are."""
    d = media.join(labels.drop("path"), "item_id", "left").withColumn("known", F.col("complete").isNotNull())
    every = lambda c: F.coalesce(F.min(F.when(F.col("known"), c)), F.lit(False))
    return d.groupBy("path").agg(
        F.count(F.lit(1)).alias("labels"), F.count_if("known").alias("linked"), F.coalesce(F.max("visual"), F.lit(False)).alias("visual"),
        F.sum(F.coalesce(F.size("decisions"), F.lit(0))).alias("judgments"), every(F.col("complete")).alias("complete"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("rules")))).alias("rules"),
    )


#: Rules over the yes of three models.
RULE_GRID = {
    "first": lambda a, b, c: a, "second": lambda a, b, c: b, "third": lambda a, b, c: c,
    "first_and_second": lambda a, b, c: a & b, "first_and_third": lambda a, b, c: a & c, "second_and_third": lambda a, b, c: b & c,
    "majority_2_of_3": lambda a, b, c: (a & b) | (a & c) | (b & c), "all_3": lambda a, b, c: a & b & c, "first_or_third": lambda a, b, c: a | c, "any_3": lambda a, b, c: a | b | c,
}


def rule_grid(df: DataFrame, first: Column, second: Column, third: Column, y: Column) -> DataFrame:
    """tp, fp, fn and tn of each rule; the grid is exploded over each row and counted before the shuffle."""
    from ..functions.stats import confusion

    rules = F.array(*[F.struct(F.lit(n).alias("rule"), f(first, second, third).alias("hit")) for n, f in RULE_GRID.items()])
    e = df.select(y.alias("y"), F.explode(rules).alias("r")).select("y", "r.*")
    return e.groupBy("rule").agg(*[v.alias(n) for n, v in confusion(F.col("hit"), F.col("y")).items()])
