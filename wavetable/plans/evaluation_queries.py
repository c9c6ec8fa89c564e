"""Evaluation and prediction combination (E1-E20, without the model jobs)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavetable.operators import combine as cb
from wavetable.operators import evaluate as ev
from wavetable.operators import rollup as ru
from wavetable.plans.registry import query
from wavetable.plans.tables import prediction, r, series, sql

ARG = "CASE WHEN p0 >= greatest(p1, p2, p3) THEN 0 WHEN p1 >= greatest(p2, p3) THEN 1 WHEN p2 >= p3 THEN 2 ELSE 3 END"
PR4 = "p0, p1, p2, p3"
AVG4 = ", ".join(f"avg(p{k}) AS p{k}" for k in range(4))
RND4 = ", ".join(f"round(p{k}, 6) AS p{k}" for k in range(4))
ROWS = f"RW AS (SELECT *, CAST({ARG} AS BIGINT) AS pred, greatest({PR4}) AS top_p FROM P)"
FV = f"FV AS (SELECT *, CAST({ARG} AS BIGINT) AS pred, greatest({PR4}) AS top_p FROM (SELECT model, fold_id, file_id, any_value(subclass) AS subclass, any_value(y_true) AS y_true, {AVG4} FROM P GROUP BY model, fold_id, file_id))"
rp = lambda: [F.round(p, 6).alias(p) for p in ev.probs(4)]


def rows(spark, sf):
    return ev.with_prediction(prediction(spark, sf), 4)


def votes(spark, sf):
    return ev.soft_vote(prediction(spark, sf), ["model", "fold_id", "file_id"], 4)


@query("e1_soft_vote", sql("P", f"SELECT model, file_id, y_true, {RND4}, pred FROM FV", FV))
def e1(spark, sf):
    return votes(spark, sf).select("model", "file_id", "y_true", *rp(), "pred")


CELLS = "CE AS (SELECT m.m AS model, t.t AS row, q.q AS pred, count(FV.file_id) AS n FROM range(3) m(m) CROSS JOIN range(4) t(t) CROSS JOIN range(4) q(q) LEFT JOIN FV ON FV.model = m.m AND FV.y_true = t.t AND FV.pred = q.q GROUP BY ALL)"


@query("e2_confusion", sql("P", "SELECT model, row, pred, n FROM CE", FV, CELLS))
def e2(spark, sf):
    return ev.confusion(votes(spark, sf), "y_true", [0, 1, 2, 3], 4, ["model"]).select("model", F.col("row").cast("long").alias("row"), "pred", "n")


@query("e2_confusion_by_subclass", sql("P", "SELECT t.t AS row, q.q AS pred, count(RW.spectrum_id) AS n FROM range(10) t(t) CROSS JOIN range(4) q(q) LEFT JOIN RW ON RW.subclass = t.t AND RW.pred = q.q GROUP BY ALL", ROWS))
def e2_sub(spark, sf):
    return ev.confusion(rows(spark, sf), "subclass", list(range(10)), 4).select(F.col("row").cast("long").alias("row"), "pred", "n")


@query("e2_cell_members", sql("P", "SELECT model, y_true, pred, file_id, row_number() OVER (PARTITION BY model, y_true, pred ORDER BY file_id) AS member FROM FV", FV))
def e2_members(spark, sf):
    return ev.cell_members(votes(spark, sf), "file_id", within=["model"])


METRIC = """ME AS (SELECT model, c.c AS cls, coalesce(sum(n) FILTER (row = c.c), 0) AS support, coalesce(sum(n) FILTER (pred = c.c), 0) AS predicted, coalesce(sum(n) FILTER (row = c.c AND pred = c.c), 0) AS hits FROM CE, range(4) c(c) GROUP BY ALL)"""
MET2 = "MT AS (SELECT model, cls, CAST(support AS BIGINT) AS support, coalesce(hits / nullif(support, 0), 0) AS recall, coalesce(hits / nullif(predicted, 0), 0) AS precision, coalesce(2 * hits / nullif(support + predicted, 0), 0) AS f1 FROM ME)"


def metrics(spark, sf):
    return ev.class_metrics(ev.confusion(votes(spark, sf), "y_true", [0, 1, 2, 3], 4, ["model"]), ["model"])


@query("e3_class_metrics", sql("P", "SELECT model, cls, support, round(recall, 6) AS recall, round(precision, 6) AS precision, round(f1, 6) AS f1 FROM MT", FV, CELLS, METRIC, MET2))
def e3(spark, sf):
    return metrics(spark, sf).select("model", F.col("cls").cast("long").alias("cls"), "support", *[F.round(x, 6).alias(x) for x in ("recall", "precision", "f1")])


@query(
    "e3_summary_metrics",
    sql("P", """SELECT model, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1, round(avg(recall) FILTER (support > 0), 6) AS balanced_accuracy, round(sum(recall * support) / sum(support), 6) AS accuracy FROM MT GROUP BY model""", FV, CELLS, METRIC, MET2),
)
def e3_summary(spark, sf):
    s = ev.summary_metrics(metrics(spark, sf), ["model"])
    return s.select("model", *[F.round(x, 6).alias(x) for x in ("macro_f1", "weighted_f1", "balanced_accuracy", "accuracy")])


@query("e4_brier", sql("P", "SELECT model, round(avg(" + " + ".join(f"pow(p{k} - CASE WHEN y_true = {k} THEN 1 ELSE 0 END, 2)" for k in range(4)) + "), 6) AS brier FROM P GROUP BY model"))
def e4(spark, sf):
    return ev.brier(prediction(spark, sf), 4, ["model"]).withColumn("brier", F.round("brier", 6))


@query(
    "e5_reliability",
    sql(
        "P",
        "SELECT model, bin, count(*) AS count, round(avg(top_p), 6) AS mean_predicted, round(avg(CASE WHEN pred = y_true THEN 1.0 ELSE 0.0 END), 6) AS fraction_correct FROM (SELECT RW.*, CAST(least(9, "
        + " + ".join(f"CASE WHEN top_p >= e{i} THEN 1 ELSE 0 END" for i in range(1, 10))
        + ") AS BIGINT) AS bin FROM RW JOIN ED USING (model)) GROUP BY model, bin",
        ROWS,
        "ED AS (SELECT model, " + ", ".join(f"quantile_cont(top_p, {i / 10}) AS e{i}" for i in range(1, 10)) + " FROM RW GROUP BY model)",
    ),
)
def e5(spark, sf):
    b = ev.reliability(rows(spark, sf), 10, ["model"])
    return b.select("model", "bin", "count", F.round("mean_predicted", 6).alias("mean_predicted"), F.round("fraction_correct", 6).alias("fraction_correct"))


@query("e6_subclass_recall", sql("P", "SELECT model, subclass, count(*) AS n, round(avg(CASE WHEN pred = y_true THEN 1.0 ELSE 0.0 END), 6) AS recall FROM FV GROUP BY ALL", FV))
def e6(spark, sf):
    return ev.subclass_recall(votes(spark, sf), ["model"]).withColumn("recall", F.round("recall", 6))


ACC = "AC AS (SELECT model, fold_id, avg(CASE WHEN pred = y_true THEN 1.0 ELSE 0.0 END) AS acc FROM FV GROUP BY ALL)"


def fold_accuracy(spark, sf):
    return votes(spark, sf).groupBy("model", "fold_id").agg(F.avg((F.col("pred") == F.col("y_true")).cast("double")).alias("acc"))


@query("e7_fold_summary", sql("P", "SELECT model, round(avg(acc), 6) AS mean, round(coalesce(stddev_samp(acc), 0), 6) AS sd, round(min(acc), 6) AS min, round(max(acc), 6) AS max, count(*) AS folds FROM AC GROUP BY model", FV, ACC))
def e7(spark, sf):
    s = ev.fold_summary(fold_accuracy(spark, sf), "acc", ["model"])
    return s.select("model", *[F.round(x, 6).alias(x) for x in ("mean", "sd", "min", "max")], "folds")


WSUM = ", ".join(f"sum(w * p{k}) AS p{k}" for k in range(4))
NORM = ", ".join(f"round(p{k} / (p0 + p1 + p2 + p3), 6) AS p{k}" for k in range(4))


@query("e8_weighted_soft_vote", sql("P", f"SELECT fold_id, file_id, spectrum_id, subclass, y_true, {NORM} FROM (SELECT fold_id, file_id, spectrum_id, subclass, y_true, {WSUM} FROM (SELECT *, (model + 1) / 6.0 AS w FROM P) GROUP BY ALL)"))
def e8(spark, sf):
    return cb.weighted_vote(prediction(spark, sf), (F.col("model") + 1) / 6.0, 4, 3).select(*cb.KEYS, *rp())


GRID = [0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 5.0]
LOSS = "LS AS (SELECT model, fold_id, t, sum(-ln(CASE y_true " + " ".join(f"WHEN {k} THEN pow(p{k}, 1 / t)" for k in range(4)) + " END / (" + " + ".join(f"pow(p{k}, 1 / t)" for k in range(4)) + "))) AS loss, count(*) AS n FROM P, (SELECT unnest([" + ", ".join(f"{g}e0" for g in GRID) + "]) AS t) GROUP BY ALL)"
TEMP = """TM AS (SELECT model, fold_id, arg_min(t, (round(nll, 9), t)) AS temperature, min(nll) AS nll FROM (SELECT model, a.fold_id, a.t, (SELECT sum(b.loss) / sum(b.n) FROM LS b WHERE b.model = a.model AND b.t = a.t AND b.fold_id <> a.fold_id) AS nll FROM LS a) GROUP BY model, fold_id)"""


@query("e9_temperature", sql("P", "SELECT model, fold_id, temperature, round(nll, 6) AS nll FROM TM", LOSS, TEMP))
def e9(spark, sf):
    return cb.fit_temperatures(prediction(spark, sf), 4, GRID).withColumn("nll", F.round("nll", 6))


@query(
    "e9_calibrated_vote",
    sql("P", f"SELECT spectrum_id, {RND4} FROM (SELECT spectrum_id, " + ", ".join(f"avg(q{k} / (q0 + q1 + q2 + q3)) AS p{k}" for k in range(4)) + " FROM (SELECT spectrum_id, " + ", ".join(f"pow(p{k}, 1 / temperature) AS q{k}" for k in range(4)) + " FROM P JOIN TM USING (model, fold_id)) GROUP BY spectrum_id)", LOSS, TEMP),
)
def e9_vote(spark, sf):
    return cb.calibrated_vote(prediction(spark, sf), 4, GRID, 3).select("spectrum_id", *rp())


# Validation scores: accuracy of the model on the neighbouring fold; model 2 has no score on fold 3.
SCORES = "SC AS (SELECT model, (fold_id + 1) % 10 AS fold_id, CASE WHEN model = 2 AND (fold_id + 1) % 10 = 3 THEN 'nan'::DOUBLE ELSE acc END AS score FROM AC)"


def scores(spark, sf):
    a = fold_accuracy(spark, sf).withColumn("fold_id", (F.col("fold_id") + 1) % 10)
    gone = (F.col("model") == 2) & (F.col("fold_id") == 3)
    return a.select("model", "fold_id", F.when(gone, F.lit(float("nan"))).otherwise(F.col("acc")).alias("score"))


@query("e10_hard_select", sql("P", "SELECT fold_id, arg_max(model, (CASE WHEN isnan(score) THEN '-infinity'::DOUBLE ELSE score END, -model)) AS model FROM SC GROUP BY fold_id", FV, ACC, SCORES))
def e10(spark, sf):
    return cb.hard_select(scores(spark, sf)).select("fold_id", "model")


@query("e10_hard_predictions", sql("P", f"SELECT spectrum_id, model, {RND4} FROM P JOIN HS USING (fold_id, model)", FV, ACC, SCORES, "HS AS (SELECT fold_id, arg_max(model, (CASE WHEN isnan(score) THEN '-infinity'::DOUBLE ELSE score END, -model)) AS model FROM SC GROUP BY fold_id)"))
def e10_predictions(spark, sf):
    return prediction(spark, sf).join(cb.hard_select(scores(spark, sf)).select("fold_id", "model"), ["fold_id", "model"]).select("spectrum_id", "model", *rp())


SOFTW = """SW AS (SELECT fold_id, model, e / sum(e) OVER (PARTITION BY fold_id) AS w FROM (SELECT fold_id, model, exp((CASE WHEN isnan(score) THEN lo ELSE score END - hi) / 0.1) AS e FROM SC JOIN
  (SELECT fold_id, min(score) AS lo, max(score) AS hi FROM SC WHERE NOT isnan(score) GROUP BY fold_id) USING (fold_id)))"""


@query("e11_soft_select", sql("P", f"SELECT spectrum_id, {NORM} FROM (SELECT spectrum_id, {WSUM} FROM P JOIN SW USING (fold_id, model) GROUP BY spectrum_id)", FV, ACC, SCORES, SOFTW))
def e11(spark, sf):
    w = cb.soft_weights(scores(spark, sf), 0.1)
    return cb.weighted_vote(prediction(spark, sf).join(w, ["fold_id", "model"]), F.col("weight"), 4, 3).select("spectrum_id", *rp())


def _route_sql(score: str) -> str:
    return sql(
        "P", f"SELECT P.spectrum_id, P.model, {RND4} FROM P JOIN RT USING (fold_id, file_id, model)",
        f"RT AS (SELECT fold_id, file_id, arg_max(model, (round(s, 12), -model)) AS model FROM (SELECT fold_id, file_id, model, avg({score}) AS s FROM P GROUP BY ALL) GROUP BY fold_id, file_id)",
    )


MARGIN = "list_sort([p0, p1, p2, p3], 'DESC')[1] - list_sort([p0, p1, p2, p3], 'DESC')[2]"


@query("e12_route_max_proba", _route_sql("greatest(p0, p1, p2, p3)"))
def e12(spark, sf):
    return cb.route(prediction(spark, sf), 4, "max_proba").select("spectrum_id", "model", *rp())


@query("e12_route_margin", _route_sql(MARGIN))
def e12_margin(spark, sf):
    return cb.route(prediction(spark, sf), 4, "margin").select("spectrum_id", "model", *rp())


DIFF = "DF AS (SELECT file_id, count(*) FILTER (pred = y_true) AS n_correct, count(*) AS n_models FROM FV GROUP BY file_id)"


@query("e14_consensus_difficulty", sql("P", "SELECT file_id, n_correct, n_models, CASE WHEN n_correct = 0 THEN 'hard' WHEN n_correct = n_models THEN 'easy' ELSE 'mixed' END AS difficulty FROM DF", FV, DIFF))
def e14(spark, sf):
    return ev.consensus_difficulty(votes(spark, sf), "file_id", F.col("pred") == F.col("y_true"))


@query("e16_model_comparison", sql("P", "SELECT subclass, " + ", ".join(f"round(avg(CASE WHEN pred = y_true THEN 1.0 ELSE 0.0 END) FILTER (model = {m}), 6) AS model_{m}" for m in range(3)) + " FROM FV GROUP BY subclass", FV))
def e16(spark, sf):
    p = votes(spark, sf).groupBy("subclass").pivot("model", [0, 1, 2]).agg(F.avg((F.col("pred") == F.col("y_true")).cast("double")))
    return p.select("subclass", *[F.round(F.col(str(m)), 6).alias(f"model_{m}") for m in range(3)])


@query("e17_accuracy_without_class", sql("P", "SELECT model, round(avg(CASE WHEN pred = y_true THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM FV WHERE y_true <> 0 GROUP BY model", FV))
def e17(spark, sf):
    return votes(spark, sf).where("y_true <> 0").groupBy("model").agg(F.round(F.avg((F.col("pred") == F.col("y_true")).cast("double")), 6).alias("accuracy"))


# Seeds: the models stand in for seeds of two algorithms (algo = fold parity of the subclass).
@query(
    "e18_multi_seed_summary",
    sql("P", "SELECT algo, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS sd, count(*) AS seeds FROM (SELECT fold_id % 2 AS algo, model, avg(acc) AS m FROM AC GROUP BY ALL) GROUP BY algo", FV, ACC),
)
def e18(spark, sf):
    return seeds(spark, sf).select("algo", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "seeds")


def seeds(spark, sf):
    return ev.seed_summary(fold_accuracy(spark, sf).withColumn("algo", F.col("fold_id") % 2), "acc", "algo", "model")


@query(
    "e18_best_algorithm",
    sql("P", "SELECT algo, round(m, 6) AS mean FROM (SELECT algo, avg(m) AS m FROM (SELECT fold_id % 2 AS algo, model, avg(acc) AS m FROM AC GROUP BY ALL) GROUP BY algo) ORDER BY m DESC, algo LIMIT 1", FV, ACC),
)
def e18_best(spark, sf):
    return ev.best_algorithm(seeds(spark, sf), "algo").withColumn("mean", F.round("mean", 6))


@query("e19_temperature_range", sql("P", "SELECT model, round(avg(temperature), 6) AS mean, min(temperature) AS min, max(temperature) AS max FROM TM GROUP BY model", LOSS, TEMP))
def e19(spark, sf):
    t = cb.fit_temperatures(prediction(spark, sf), 4, GRID)
    return t.groupBy("model").agg(F.round(F.avg("temperature"), 6).alias("mean"), F.min("temperature").alias("min"), F.max("temperature").alias("max"))


@query("e19_routing_counts", sql("P", "SELECT model, count(*) AS files FROM (SELECT fold_id, file_id, arg_max(model, (round(s, 12), -model)) AS model FROM (SELECT fold_id, file_id, model, avg(greatest(p0, p1, p2, p3)) AS s FROM P GROUP BY ALL) GROUP BY ALL) GROUP BY model"))
def e19_routing(spark, sf):
    return cb.route(prediction(spark, sf), 4).groupBy("model", "file_id").agg(F.count(F.lit(1)).alias("_n")).groupBy("model").agg(F.count(F.lit(1)).alias("files"))


@query(
    "e20_held_out_recall",
    sql(
        "P",
        "SELECT model, fold_id, round(coalesce(avg(CASE WHEN pred = y_true THEN 1.0 ELSE 0.0 END) FILTER (y_true = held), any_value(bacc)), 6) AS score FROM FV JOIN H USING (fold_id) JOIN BA USING (model, fold_id) GROUP BY model, fold_id",
        FV,
        "H AS (SELECT DISTINCT fold_id, CASE WHEN fold_id = 7 THEN 0 ELSE fold_id % 4 END AS held FROM P)",
        "BA AS (SELECT model, fold_id, avg(rec) AS bacc FROM (SELECT model, fold_id, y_true, avg(CASE WHEN pred = y_true THEN 1.0 ELSE 0.0 END) AS rec FROM FV GROUP BY ALL) GROUP BY model, fold_id)",
    ),
)
def e20(spark, sf):
    v, by = votes(spark, sf), ["model", "fold_id"]
    m = ev.class_metrics(ev.confusion(v, "y_true", [0, 1, 2, 3], 4, by), by)
    held = v.select(*by).distinct().withColumn("cls", F.when(F.col("fold_id") == 7, 0).otherwise(F.col("fold_id") % 4).cast("int"))
    return ev.held_out_recall(m, ev.summary_metrics(m, by), held, by).withColumn("score", F.round("score", 6))
