"""Model experiments over the labelled documents: sides and folds by source, fitted models, calibration, and what they reach on sources they never saw."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.hashing import fraction, split
from ..operators import experiments, labelmodel
from ..operators.shared import written
from .label_queries import FAMILIES, FAMILY, GOLD, IDS, WIDE, WILSON, gold, votes
from .registry import Tables, query

HIGH = 0.9

# --- the label model on three sides ---------------------------------------------------------------

_SIDE = "side AS (SELECT doc_id, CASE WHEN f < 0.6 THEN 'train' WHEN f < 0.8 THEN 'calibration' ELSE 'test' END AS part FROM (SELECT doc_id, ('0x' || substr(sha256('label_model_v1_split:' || source), 1, 12))::BIGINT / 281474976710656.0 AS f FROM documents))"
_SCORED = f"""{FAMILY}, {GOLD}, {WIDE}, {_SIDE},
patterns AS MATERIALIZED (SELECT v, count(*) AS n FROM wide JOIN side ON side.doc_id = item_id WHERE part = 'train' GROUP BY v), {labelmodel.fit_sql('patterns', FAMILIES)},
p AS MATERIALIZED (SELECT w.item_id, w.v, part, label, round({labelmodel.posterior_sql('w.v', FAMILIES)}, 9) AS raw FROM wide w JOIN side ON side.doc_id = w.item_id LEFT JOIN gold ON gold.item_id = w.item_id, model),
x AS MATERIALIZED (SELECT raw, count(*) AS n, count(*) FILTER (label = 1) AS k FROM p WHERE part = 'calibration' AND label IS NOT NULL GROUP BY raw),
mean AS (SELECT a.raw AS lo, b.raw AS hi, sum(x.k)::DOUBLE / sum(x.n) AS m FROM x a JOIN x b ON a.raw <= b.raw JOIN x ON x.raw BETWEEN a.raw AND b.raw GROUP BY a.raw, b.raw),
iso AS MATERIALIZED (SELECT raw, max(least_mean) AS rate FROM (SELECT x.raw, mean.lo, min(mean.m) AS least_mean FROM x JOIN mean ON mean.lo <= x.raw AND mean.hi >= x.raw GROUP BY x.raw, mean.lo) GROUP BY raw),
c AS MATERIALIZED (SELECT p.*, coalesce((SELECT arg_max(rate, iso.raw) FROM iso WHERE iso.raw <= p.raw), (SELECT arg_min(rate, iso.raw) FROM iso), p.raw) AS fitted FROM p)"""


def _model(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The documents with their side, gold label, votes, and posteriors before and after calibration; and all votes."""
    long = written(votes(t), "votes")
    sides = t.documents.select(F.col("doc_id").alias("item_id"), split("label_model_v1_split", F.col("source")).alias("part"))
    collapsed = labelmodel.collapse(long)
    train = sides.where("part = 'train'")
    model = labelmodel.fit(collapsed.join(train, "item_id", "left_semi"), FAMILIES, items=train)
    held = collapsed.groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("family", F.col("vote").cast("int")))).alias("v"))
    p = sides.join(held, "item_id", "left").withColumn("v", F.coalesce("v", F.create_map().cast("map<string,int>")))
    p = p.join(gold(t), "item_id", "left").withColumn("raw", F.round(model.posterior(F.col("v")), 9))
    p = written(p, "posteriors")
    fitted = p.where("part = 'calibration' AND label IS NOT NULL").withColumn("y", F.col("label") == 1)
    return p.withColumn("fitted", experiments.calibrated(F.col("raw"), experiments.isotonic(fitted, "raw", "y"))), long


_RULES = f"""SELECT 'label_model' AS predictor, item_id, label, CASE WHEN raw >= {HIGH} THEN 1 ELSE 0 END AS vote FROM c WHERE part = 'test' AND label IS NOT NULL
 UNION ALL SELECT 'calibrated', item_id, label, CASE WHEN fitted >= {HIGH} THEN 1 ELSE 0 END FROM c WHERE part = 'test' AND label IS NOT NULL
 UNION ALL SELECT 'majority_vote', item_id, label, CASE WHEN list_sum(v) > 0 THEN 1 ELSE 0 END FROM c WHERE part = 'test' AND label IS NOT NULL
 UNION ALL SELECT 'strongest_single_lf', c.item_id, label, CASE WHEN votes.vote = 1 THEN 1 ELSE 0 END FROM c LEFT JOIN votes ON votes.item_id = c.item_id AND votes.lf_id = (SELECT lf_id FROM best) WHERE part = 'test' AND label IS NOT NULL"""


@query(f"""WITH RECURSIVE {_SCORED}, f AS (SELECT ids.lf_id, count(*) FILTER (votes.vote = 1 AND label = 1) AS tp, count(*) FILTER (votes.vote = 1 AND label = -1) AS fp, count(*) FILTER (coalesce(votes.vote, 0) <> 1 AND label = 1) AS fn
 FROM c CROSS JOIN (SELECT unnest({IDS!r}) AS lf_id) ids LEFT JOIN votes ON votes.item_id = c.item_id AND votes.lf_id = ids.lf_id WHERE part = 'train' AND label IS NOT NULL GROUP BY ids.lf_id),
best AS (SELECT lf_id FROM f WHERE tp > 0 ORDER BY 2.0 * tp / (2 * tp + fp + fn) DESC, lf_id LIMIT 1), r AS ({_RULES}),
n AS (SELECT predictor, count(*) FILTER (vote = 1 AND label = 1) AS tp, count(*) FILTER (vote = 1 AND label = -1) AS fp, count(*) FILTER (vote <> 1 AND label = 1) AS fn, count(*) FILTER (vote <> 1 AND label = -1) AS tn FROM r GROUP BY predictor)
SELECT predictor, CASE WHEN predictor = 'strongest_single_lf' THEN (SELECT lf_id FROM best) END AS lf_id, (SELECT count(*) FROM side WHERE part = 'train') AS train, (SELECT count(*) FROM side WHERE part = 'calibration') AS calibration, (SELECT count(*) FROM side WHERE part = 'test') AS test,
 tp, fp, fn, tn, round(CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) END, 6) AS recall, round(CASE WHEN tp + fp > 0 THEN {WILSON.format(k='tp::DOUBLE', n='(tp + fp)::DOUBLE')} END, 6) AS wilson_lower FROM n""")
def split_experiment(t: Tables) -> DataFrame:
    """The label model fitted on train, calibrated on calibration and tested on test, whose sources it never saw, beside the majority
    vote and the function that was best on train."""
    p, long = _model(t)
    lfs = t.spark.createDataFrame([(i,) for i in IDS], "lf_id string")
    of_train = labelmodel.against_gold(long, p.where("part = 'train' AND label IS NOT NULL").select("item_id", "label"), lfs).where("tp > 0")
    f1 = 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))
    best = of_train.orderBy(F.desc(f1), "lf_id").limit(1).select("lf_id")  # of as many rows as functions
    single = long.join(F.broadcast(best), "lf_id").select("item_id", F.col("vote").alias("single"))
    test = p.where("part = 'test' AND label IS NOT NULL").join(single, "item_id", "left")
    total = F.aggregate(F.map_values("v"), F.lit(0), lambda a, x: a + x)
    rules = {"label_model": F.col("raw") >= HIGH, "calibrated": F.col("fitted") >= HIGH, "majority_vote": total > 0, "strongest_single_lf": F.coalesce(F.col("single") == 1, F.lit(False))}
    each = test.select("label", F.explode(F.array(*[F.struct(F.lit(n).alias("predictor"), c.alias("hit")) for n, c in rules.items()])).alias("r")).select("label", "r.*")
    n = each.groupBy("predictor").agg(*[c.alias(k) for k, c in stats.confusion(F.col("hit"), F.col("label") == 1).items()])
    sizes = p.agg(*[F.count_if(F.col("part") == s).alias(s) for s in ("train", "calibration", "test")])
    d = stats.rates(n).join(F.broadcast(sizes), F.lit(True)).join(F.broadcast(best.agg(F.max("lf_id").alias("lf_id"))), F.lit(True))
    low = F.round(stats.wilson(F.col("tp"), F.col("tp") + F.col("fp"))[0], 6).alias("wilson_lower")
    return d.select("predictor", F.when(F.col("predictor") == "strongest_single_lf", F.col("lf_id")).alias("lf_id"), "train", "calibration", "test", "tp", "fp", "fn", "tn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), low)


@query(f"""WITH RECURSIVE {_SCORED}, s AS (SELECT 'calibration, raw' AS stage, raw AS p, label = 1 AS y FROM c WHERE part = 'calibration' AND label IS NOT NULL UNION ALL SELECT 'test, raw', raw, label = 1 FROM c WHERE part = 'test' AND label IS NOT NULL UNION ALL SELECT 'test, isotonic', fitted, label = 1 FROM c WHERE part = 'test' AND label IS NOT NULL),
b AS (SELECT stage, CAST(least(floor(p * 10), 9) AS BIGINT) AS bin, count(*) AS n, avg(p) AS mean_p, count(*) FILTER (y) AS positives FROM s GROUP BY 1, 2)
SELECT stage, bin, n, round(mean_p, 6) AS mean_p, positives, round(positives::DOUBLE / n, 6) AS rate, round({WILSON.format(k='positives::DOUBLE', n='n::DOUBLE')}, 6) AS wilson_lower, round(n::DOUBLE / sum(n) OVER (PARTITION BY stage) * abs(mean_p - positives::DOUBLE / n), 6) AS ece_part FROM b""")
def split_calibration(t: Tables) -> DataFrame:
    """Reliability of the posteriors on the calibration side, and on the test side before and after the isotonic fit."""
    p, _ = _model(t)
    known = p.where("label IS NOT NULL").withColumn("y", F.col("label") == 1)
    out = None
    for stage, part, column in (("calibration, raw", "calibration", "raw"), ("test, raw", "test", "raw"), ("test, isotonic", "test", "fitted")):
        x = stats.calibration(known.where(F.col("part") == part), column, "y").select(F.lit(stage).alias("stage"), "*")
        out = x if out is None else out.unionByName(x)
    return out


# --- what text alone tells: probes by channel -------------------------------------------------------

DIM = 4096  # of the probe, a fixed value
LEAST_TRAIN, LEAST_TEST, LEAST_SLICE = 100, 50, 20
CHANNELS = ["transcript_text", "metadata_text"]
_PROBE = f"""r AS (SELECT d.doc_id, source, quality::DOUBLE AS y, CASE WHEN f < 0.6 THEN 'train' WHEN f < 0.8 THEN 'calibration' ELSE 'test' END AS part, text AS transcript_text, concat_ws(' ', lang, source, split_part(text, '.', 1)) AS metadata_text
 FROM (SELECT *, ('0x' || substr(sha256('probe:' || source), 1, 12))::BIGINT / 281474976710656.0 AS f FROM documents) d JOIN labels l ON l.doc_id = d.doc_id),
l AS (SELECT doc_id AS id, source, y, part, 0 AS grp, transcript_text AS t FROM r UNION ALL SELECT doc_id, source, y, part, 1, metadata_text FROM r),
k AS (SELECT id, grp, any_value(source) AS source, any_value(y) AS y, any_value(part) AS part, ('0x' || substr(md5(tok), 1, 8))::BIGINT % {DIM} AS pos, count(*) AS n FROM (SELECT *, unnest(regexp_extract_all(lower(t), '[a-zA-Z'']{{2,}}')) AS tok FROM l WHERE part <> 'calibration' AND t <> '') GROUP BY id, grp, 6),
k2 AS (SELECT id, grp, pos, n / sqrt(sum(n * n) OVER (PARTITION BY id, grp)) AS val FROM k),
vec AS MATERIALIZED (SELECT l.id, l.grp, l.part, l.source, l.y, k2.pos, k2.val FROM l JOIN k2 ON k2.id = l.id AND k2.grp = l.grp WHERE l.part <> 'calibration' UNION ALL SELECT id, grp, part, source, y, {DIM}, 1.0 FROM l WHERE part <> 'calibration' AND t <> ''),
size AS (SELECT grp, count(DISTINCT id) FILTER (part = 'train') AS train, count(DISTINCT id) FILTER (part = 'test') AS test FROM vec GROUP BY grp),
fit AS MATERIALIZED (SELECT vec.* FROM vec JOIN size ON size.grp = vec.grp WHERE part = 'train' AND train >= {LEAST_TRAIN} AND test >= {LEAST_TEST}), places AS MATERIALIZED (SELECT DISTINCT grp, pos FROM fit), {experiments.logistic_sql('fit', 'places')},
s AS MATERIALIZED (SELECT v.grp, v.id, any_value(v.source) AS source, any_value(v.y) = 1 AS y, round(1 / (1 + exp(-sum(v.val * coalesce(w.w, 0)))), 6) AS p FROM vec v JOIN size ON size.grp = v.grp LEFT JOIN w{experiments.EPOCHS} w ON w.grp = v.grp AND w.pos = v.pos WHERE v.part = 'test' AND train >= {LEAST_TRAIN} AND test >= {LEAST_TEST} GROUP BY v.grp, v.id)"""
_AREA = """a AS (SELECT {by}, count(*) FILTER (y) AS positives, count(*) FILTER (NOT y) AS negatives, sum(rk) FILTER (y) AS sr FROM (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY p) + (count(*) OVER (PARTITION BY {by}, p) - 1) / 2.0 AS rk FROM s) GROUP BY {by})"""




def _bags(t: Tables) -> DataFrame:
    """A row for each labelled document and channel: grp, id, source, part, y, idx and val, of all words of the channel's text."""
    d = t.labels.join(t.documents.select("doc_id", "source", "lang", "text"), "doc_id")
    text = {"transcript_text": F.col("text"), "metadata_text": F.concat_ws(" ", "lang", "source", F.substring_index("text", ".", 1))}
    channels = F.explode(F.array(*[F.struct(F.lit(i).alias("grp"), text[c].alias("t")) for i, c in enumerate(CHANNELS)]))
    r = d.select(F.col("doc_id").alias("id"), "source", F.col("quality").cast("double").alias("y"), split("probe", F.col("source")).alias("part"), channels.alias("c")).select("id", "source", "y", "part", "c.*")
    words = F.explode_outer(F.regexp_extract_all(F.lower("t"), F.lit("([a-zA-Z']{2,})"), 1))
    k = r.where("part <> 'calibration' AND t <> ''").withColumn("w", words)
    at = (F.conv(F.substring(F.md5("w"), 1, 8), 16, 10).cast("long") % DIM).cast("int")
    n = k.groupBy("grp", "id", "source", "part", "y", at.alias("at")).agg(F.count("w").alias("n"))
    g = n.groupBy("grp", "id", "source", "part", "y").agg(F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "n")))).alias("x"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("length"))  # DIM places at most
    return g.select("grp", "id", "source", "part", "y", F.col("x.at").alias("idx"), F.transform("x", lambda e: e["n"] / F.col("length")).alias("val"))


def _probe(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Sizes of both sides by channel, and the scores of the test side where both are large enough."""
    rows = written(_bags(t), "probe")
    sizes = rows.groupBy("grp").agg(F.count_if(F.col("part") == "train").alias("train"), F.count_if(F.col("part") == "test").alias("test"))
    ready = [r["grp"] for r in sizes.where(f"train >= {LEAST_TRAIN} AND test >= {LEAST_TEST}").collect()]  # of the channels
    use = rows.where(F.col("grp").isin(ready)) if ready else rows.limit(0)
    weights = experiments.train_logistic(use.where("part = 'train'"), len(CHANNELS), DIM) if ready else np.zeros((len(CHANNELS), DIM + 1))
    scores = experiments.predict_logistic(use.where("part = 'test'"), weights, ["grp", "id", "source", "y"])
    return sizes, scores.select("grp", "id", "source", (F.col("y") == 1).alias("y"), F.round("p", 6).alias("p"))


def channel_name(grp: str) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in CHANNELS]), F.col(grp) + 1)


@query(f"""WITH {_PROBE}, {_AREA.format(by='grp')}, names AS (SELECT unnest([0, 1]) AS grp, unnest({CHANNELS!r}) AS channel), n AS (SELECT count(*) AS n FROM l WHERE part = 'test' AND grp = 0)
SELECT channel, coalesce(train, 0) AS train, coalesce(test, 0) AS test, round((sr - positives * (positives + 1) / 2.0) / nullif(positives * negatives, 0), 4) AS auroc, CASE WHEN positives IS NOT NULL THEN round(test::DOUBLE / greatest(1, n.n), 6) END AS coverage_test, CASE WHEN positives IS NULL THEN 'insufficient covered rows' END AS error FROM names LEFT JOIN size USING (grp) LEFT JOIN a USING (grp), n""")
def leakage_probes(t: Tables) -> DataFrame:
    """How well the words of each channel alone tell the label on sources that the probe never saw; a channel with few rows says so."""
    sizes, scores = _probe(t)
    area = stats.auroc(scores, "p", "y", ["grp"]).select("grp", "auroc", F.lit(True).alias("known"))
    every = t.labels.join(t.documents.select("doc_id", "source"), "doc_id").agg(F.count_if(split("probe", F.col("source")) == "test").alias("n"))
    names = t.spark.createDataFrame(list(enumerate(CHANNELS)), "grp int, channel string")
    d = names.join(sizes, "grp", "left").fillna(0, ["train", "test"]).join(area, "grp", "left").join(F.broadcast(every), F.lit(True))
    return d.select("channel", "train", "test", F.round("auroc", 4).alias("auroc"), F.when(F.col("known"), F.round(F.col("test") / F.greatest("n", F.lit(1)), 6)).alias("coverage_test"), F.when(F.col("known").isNull(), "insufficient covered rows").alias("error"))


@query(f"""WITH {_PROBE}, {_AREA.format(by='grp, source')} SELECT ({CHANNELS!r})[grp + 1] AS channel, source, positives, negatives, round((sr - positives * (positives + 1) / 2.0) / nullif(positives * negatives, 0), 4) AS auroc FROM a WHERE positives + negatives >= {LEAST_SLICE}""")
def leakage_probe_slices(t: Tables) -> DataFrame:
    """The same by source, of at least twenty rows."""
    _, scores = _probe(t)
    return stats.auroc(scores, "p", "y", ["grp", "source"], LEAST_SLICE).select(channel_name("grp").alias("channel"), "source", "positives", "negatives", F.round("auroc", 4).alias("auroc"))


# --- folds by source ----------------------------------------------------------------------------------

FOLDS = 5
FEATURES = ["size", "spaces", "capitals", "sentence", "marks", "english"]
_FEATURES_SQL = """f AS (SELECT d.doc_id AS id, source, quality::DOUBLE AS y, floor(('0x' || substr(sha256('folds:' || source), 1, 12))::BIGINT / 281474976710656.0 * 5)::INTEGER AS fold,
 [ln(1 + length(text)), (length(text) - length(replace(text, ' ', '')))::DOUBLE / nullif(length(text), 0), length(regexp_replace(text, '[^A-Z]', '', 'g'))::DOUBLE / nullif(length(text), 0),
  CASE WHEN contains(text, '. ') THEN length(text)::DOUBLE / ((length(text) - length(replace(text, '. ', ''))) / 2) END, length(regexp_replace(text, '[^%$#&*]', '', 'g'))::DOUBLE / nullif(length(text), 0), (lang = 'en')::INTEGER::DOUBLE] AS x
 FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
long AS (SELECT g.grp, f.id, f.y, f.fold, i AS pos, x[i + 1] AS v FROM f, range(5) g(grp), range(6) r(i)),
scale AS (SELECT grp, pos, median, mean, CASE WHEN var > 1e-12 THEN sqrt(var) ELSE 1 END AS sd FROM (SELECT *, (q + (n - k) * median * median) / n - mean * mean AS var FROM (SELECT *, (s + (n - k) * median) / n AS mean FROM (
  SELECT grp, pos, count(*) AS n, count(v) AS k, coalesce(sum(v), 0) AS s, coalesce(sum(v * v), 0) AS q, coalesce(median(v), 0) AS median FROM long WHERE fold <> grp GROUP BY grp, pos)))),
vec AS MATERIALIZED (SELECT l.grp, l.id, l.y, l.fold, l.pos, (coalesce(v, median) - mean) / sd AS val FROM long l JOIN scale s ON s.grp = l.grp AND s.pos = l.pos UNION ALL SELECT grp, id, y, fold, 6, 1.0 FROM long WHERE pos = 0),
fit AS MATERIALIZED (SELECT * FROM vec WHERE fold <> grp), places AS MATERIALIZED (SELECT DISTINCT grp, pos FROM fit)"""
_OOF = f"{_FEATURES_SQL}, {experiments.logistic_sql('fit', 'places')}, o AS MATERIALIZED (SELECT v.id AS doc_id, v.fold, any_value(v.y) = 1 AS y, round(1 / (1 + exp(-sum(v.val * coalesce(w.w, 0)))), 6) AS p FROM vec v LEFT JOIN w{experiments.EPOCHS} w ON w.grp = v.grp AND w.pos = v.pos WHERE v.fold = v.grp GROUP BY v.id, v.fold)"


def features(t: Tables) -> DataFrame:
    """Of each labelled document: what can be told from its text, null where it can't."""
    d = t.labels.join(t.documents.select("doc_id", "source", "lang", "text"), "doc_id")
    n = F.length("text")
    only = lambda pattern: F.try_divide(F.length(F.regexp_replace("text", pattern, "")), n)
    without = lambda s: n - F.length(F.replace("text", F.lit(s), F.lit("")))
    return d.select(
        "doc_id", "source", F.col("quality").cast("double").alias("label"), F.floor(fraction("folds", F.col("source")) * FOLDS).cast("int").alias("fold"),
        F.log1p(n).alias("size"), F.try_divide(without(" "), n).alias("spaces"), only("[^A-Z]").alias("capitals"),
        F.when(F.contains("text", F.lit(". ")), n / (without(". ") / 2)).alias("sentence"), only("[^%$#&*]").alias("marks"), (F.col("lang") == "en").cast("int").cast("double").alias("english"),
    )


def _out_of_fold(t: Tables) -> DataFrame:
    d = written(features(t), "features")
    others = d.withColumn("grp", F.explode(F.array(*[F.lit(i) for i in range(FOLDS)]))).where("fold <> grp")
    scale = F.broadcast(experiments.scales(others, "grp", FEATURES))  # a row for each fold
    at = F.array(*[F.lit(i) for i in range(len(FEATURES))]).alias("idx")
    fit = written(others.join(scale, "grp").select("grp", at, experiments.scaled(FEATURES).alias("val"), F.col("label").alias("y")), "folds")
    weights = experiments.train_logistic(fit, FOLDS, len(FEATURES))
    own = d.withColumn("grp", F.col("fold")).join(scale, "grp").select("grp", at, experiments.scaled(FEATURES).alias("val"), "doc_id", "fold", "label")
    p = experiments.predict_logistic(own, weights, ["doc_id", "fold", "label"])
    return p.select("doc_id", "fold", (F.col("label") == 1).alias("y"), F.round("p", 6).alias("p"))


@query(f"WITH {_OOF} SELECT doc_id, fold, y, p FROM o")
def logistic_out_of_fold(t: Tables) -> DataFrame:
    """Each labelled document's probability by a logistic model that was fitted, with medians and scales, on the other folds' sources."""
    return _out_of_fold(t)


@query(f"WITH {_OOF} SELECT fold, count(*) AS n, count(*) FILTER (y AND p >= 0.5) AS tp, count(*) FILTER (NOT y AND p >= 0.5) AS fp, count(*) FILTER (y AND p < 0.5) AS fn, round((coalesce(count(*) FILTER (y AND p >= 0.5)::DOUBLE / nullif(count(*) FILTER (y), 0), 0) + coalesce(count(*) FILTER (NOT y AND p < 0.5)::DOUBLE / nullif(count(*) FILTER (NOT y), 0), 0)) / 2, 6) AS balanced_accuracy FROM o GROUP BY fold")
def grouped_fold_evaluation(t: Tables) -> DataFrame:
    """The out-of-fold predictions by fold, at one half."""
    o = _out_of_fold(t)
    c = stats.rates(o.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), *[v.alias(k) for k, v in stats.confusion(F.col("p") >= 0.5, F.col("y")).items()]), 0.0)
    return c.select("fold", "n", "tp", "fp", "fn", F.round("balanced_accuracy", 6).alias("balanced_accuracy"))


@query(f"""WITH {_OOF}, g AS (SELECT p, count(*) FILTER (y) AS k, count(*) AS n FROM o GROUP BY p), c AS (SELECT p, sum(k) OVER (ORDER BY p DESC)::BIGINT AS tp, sum(n) OVER (ORDER BY p DESC)::BIGINT AS selected, sum(k) OVER () AS positives FROM g)
SELECT p AS threshold, tp, selected, round(tp::DOUBLE / selected, 6) AS precision, round(tp::DOUBLE / positives, 6) AS recall FROM c WHERE selected >= 3 AND tp::DOUBLE / selected >= 0.8 ORDER BY tp DESC, tp::DOUBLE / selected DESC, p DESC LIMIT 1""")
def out_of_fold_threshold(t: Tables) -> DataFrame:
    """The threshold with the highest recall of those that reach a precision of 0.8 with three rows or more, from out-of-fold predictions alone."""
    return experiments.precise_threshold(_out_of_fold(t), "p", "y")


@query()
def forest_out_of_fold(t: Tables) -> DataFrame:
    """The same by a random forest (pyspark.ml): medians for what is missing, balanced weights, folds by source."""
    d = features(t).persist()
    try:
        model = experiments.estimators(FEATURES, trees=100)["random_forest"]
        return written(experiments.out_of_fold(d, model, "fold", FOLDS, ["doc_id", "source", "label"]), "forest").select("doc_id", "source", "fold", (F.col("label") == 1).alias("y"), "p")
    finally:
        d.unpersist()
