"""Queries over the models. Spark ML results have no SQL; what SQL can state about them (rows scored, probabilities,
saved against live models, sums of importances) has queries of its own."""

from pyspark.sql import functions as F

from gaitframe.operators import metrics as M
from gaitframe.operators import models as MO
from gaitframe.operators import network as NN
from gaitframe.operators import windows as W
from gaitframe.operators.cleaning import add_age_group
from gaitframe.operators.features import feature_names
from gaitframe.plans import experiments as X
from gaitframe.plans.catalog import query
from gaitframe.plans.queries_windows import TICKS, device_ticks
from gaitframe.plans.queries_reports import GROUPS
from gaitframe.plans.sensor import segments, windows
from gaitframe.plans.sql import with_ctes
from gaitframe.schema import VALID_LABELS
from gaitframe.session import materialize, scratch_path


def parts(spark, sf_dir):
    """Feature vectors and their holdout parts, written because the fits read them many times."""
    vectors = X.feature_vectors(windows(spark, sf_dir))
    train, test = (materialize(part, "part") for part in X.holdout(vectors))
    return vectors, train, test


@query("m1_random_forest")
def m1(spark, sf_dir):
    _, train, test = parts(spark, sf_dir)
    return M.evaluate(MO.predict(MO.fit_forest(train), test))


@query("m2_predictions")
def m2(spark, sf_dir):
    _, train, test = parts(spark, sf_dir)
    return MO.predict(MO.fit_forest(train), test)


@query("m3_saved_model")
def m3(spark, sf_dir):
    _, train, test = parts(spark, sf_dir)
    path = scratch_path(spark, "model")
    MO.save_model(MO.fit_forest(train), path)
    return M.confusion(MO.predict(MO.load_model(path), test))


@query("m4_majority_baseline", with_ctes(
    "SELECT label, (SELECT first(label ORDER BY n DESC, label) FROM (SELECT label, count(*) AS n FROM win WHERE subject_id IN"
    " (SELECT subject_id FROM gs WHERE split = 'train') GROUP BY 1)) AS prediction, count(*) AS n FROM win WHERE subject_id IN"
    " (SELECT subject_id FROM gs WHERE split = 'test') GROUP BY 1", ("gs", GROUPS[1].replace("FROM sensor", "FROM win"))))
def m4(spark, sf_dir):
    labels = materialize(W.label_windows(segments(spark, sf_dir)), "labels")
    train, test = X.holdout(labels)
    return M.confusion(MO.majority_baseline(train, test))


@query("m5_logistic_regression")
def m5(spark, sf_dir):
    _, train, test = parts(spark, sf_dir)
    return M.evaluate(MO.predict(MO.fit_logistic(train), test))


@query("m6_decision_trees")
def m6(spark, sf_dir):
    _, train, test = parts(spark, sf_dir)
    return M.comparison({f"depth {d}": MO.predict(MO.fit_tree(train, d), test) for d in (3, 6)})


@query("m7_perceptron")
def m7(spark, sf_dir):
    train, test = raw_parts(spark, sf_dir)
    return M.evaluate(MO.predict(MO.fit_perceptron(train), test))


def raw_parts(spark, sf_dir):
    raw = MO.with_window_vector(windows(spark, sf_dir)).select("recording_id", "segment", "k", "subject_id", "label", "features")
    return [materialize(part, "part") for part in X.holdout(materialize(raw, "raw"))]


@query("m7_second_family")
def m7_family(spark, sf_dir):
    """The balanced network beside the perceptron on the held-out subjects."""
    train, test = raw_parts(spark, sf_dir)
    return M.comparison({"balanced network": NN.predict_network(NN.fit_network(train), test), "perceptron": MO.predict(MO.fit_perceptron(train), test)})


def importance(spark, sf_dir):
    _, train, _ = parts(spark, sf_dir)
    permuted = MO.permutation_importance(MO.fit_fall_forest(train), train, feature_names())
    return materialize(permuted.join(MO.impurity_importance(MO.fit_forest(train), feature_names(), spark), "feature"), "importance")


@query("m8_fall_forest")
def m8(spark, sf_dir):
    _, train, test = parts(spark, sf_dir)
    model = MO.fit_fall_forest(train)
    return M.safety(MO.predict(model, test.withColumn("label", F.when(F.col("label") == "falling", "falling").otherwise("other"))))


@query("m9_impurity_importance")
def m9(spark, sf_dir):
    return MO.impurity_importance(MO.fit_forest(parts(spark, sf_dir)[1]), feature_names(), spark)


@query("m10_permutation_importance")
def m10(spark, sf_dir):
    return importance(spark, sf_dir).select("feature", "fall_perm_importance")


@query("m11_importance_narrative")
def m11(spark, sf_dir):
    table = importance(spark, sf_dir)
    return MO.top_features(table, "mdi_importance", 5).join(MO.importance_narrative(table, "mdi_importance"), "feature", "left")


@query("t2_top_features")
def t2(spark, sf_dir):
    return MO.top_features(importance(spark, sf_dir), "mdi_importance", 20)


@query("m12_best_model")
def m12(spark, sf_dir):
    _, train, test = parts(spark, sf_dir)
    table = M.comparison({"forest": MO.predict(MO.fit_forest(train), test), "tree": MO.predict(MO.fit_tree(train, 6), test)})
    return M.best_model(table)


@query("m13_augmentation")
def m13(spark, sf_dir):
    rows = W.explode_windows(MO.augment_windows(windows(spark, sf_dir)))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("ax").alias("mean_ax"), F.stddev_pop("ax").alias("std_ax"))


TEST_ROWS = ("gs", GROUPS[1].replace("FROM sensor", "FROM win"))
IN_TEST = "FROM win WHERE subject_id IN (SELECT subject_id FROM gs WHERE split = 'test')"


@query("m2_probabilities", with_ctes(f"SELECT label, count(*) AS n_rows, count(*) AS n_summing_to_one {IN_TEST} GROUP BY 1", TEST_ROWS))
def m2_probabilities(spark, sf_dir):
    _, train, test = parts(spark, sf_dir)
    total = F.aggregate("probabilities", F.lit(0.0), lambda a, p: a + p)
    return MO.predict(MO.fit_tree(train, 6), test).groupBy("label").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.abs(total - 1) < 1e-9).alias("n_summing_to_one"))


@query("m3_saved_equals_live", with_ctes(f"SELECT label, count(*) AS n_rows, 0 AS n_differing {IN_TEST} GROUP BY 1", TEST_ROWS))
def m3_saved(spark, sf_dir):
    _, train, test = parts(spark, sf_dir)
    model, path, keys = MO.fit_forest(train, trees=20), scratch_path(spark, "model"), ["recording_id", "segment", "k"]
    MO.save_model(model, path)
    saved = MO.predict(MO.load_model(path), test).select(*keys, F.col("prediction").alias("saved"))
    return MO.predict(model, test).join(saved, keys, "left").groupBy("label").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(~F.col("saved").eqNullSafe(F.col("prediction"))).alias("n_differing"))


@query("m5_scored_rows", with_ctes(f"SELECT model, label, count(*) AS n_rows FROM (SELECT label, unnest(['logistic', 'depth 3', 'depth 6', 'forest']) AS model {IN_TEST}) GROUP BY 1, 2",
                                   TEST_ROWS))
def m5_scored(spark, sf_dir):
    """Every model labels every test row with a known label."""
    _, train, test = parts(spark, sf_dir)
    models = {"logistic": MO.fit_logistic(train), "depth 3": MO.fit_tree(train, 3), "depth 6": MO.fit_tree(train, 6), "forest": MO.fit_forest(train, trees=20)}
    out = None
    for name, model in models.items():
        known = F.col("prediction").isin(MO.label_order(model))
        rows = MO.predict(model, test).filter(known).groupBy("label").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("model", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("m7_network_rows", with_ctes(f"SELECT label, count(*) AS n_rows, count(*) AS n_known, count(*) AS n_summing_to_one {IN_TEST} GROUP BY 1", TEST_ROWS))
def m7_rows(spark, sf_dir):
    """The balanced network labels every test row with a known class and a distribution over all."""
    train, test = raw_parts(spark, sf_dir)
    net = NN.fit_network(train, hidden=8, rounds=10)
    total = F.aggregate("probabilities", F.lit(0.0), lambda a, p: a + p)
    return NN.predict_network(net, test).groupBy("label").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("prediction").isin(net.labels)).alias("n_known"),
        F.count_if(F.abs(total - 1) < 1e-9).alias("n_summing_to_one"))


@query("m9_importance_sums", with_ctes("SELECT 134 AS n_features, 1.0 AS total, (SELECT count(DISTINCT label) FROM win) AS n_labels"))
def m9_sums(spark, sf_dir):
    _, train, _ = parts(spark, sf_dir)
    model = MO.fit_forest(train, trees=20)
    return MO.impurity_importance(model, feature_names(), spark).agg(
        F.count(F.lit(1)).alias("n_features"), F.round(F.sum("mdi_importance"), 6).alias("total"), F.lit(len(MO.label_order(model))).alias("n_labels"))


@query("m13_augmented_rows", with_ctes("SELECT label, count(*) * 100 AS n_rows, 0 AS n_missing FROM win GROUP BY 1"))
def m13_rows(spark, sf_dir):
    rows = W.explode_windows(MO.augment_windows(windows(spark, sf_dir)))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("ax").isNull() | F.isnan("ax")).alias("n_missing"))


RULED = (
    *TICKS,
    ("flags", "SELECT *, even_var < 60 AND even_l1 < 6 AS st, even_max < 40 AND even_min > 1 AS ge,"
              " CASE WHEN abs(last_az) > 7 THEN 'lying' WHEN abs(last_ay) > 6 THEN 'standing' ELSE 'sitting' END AS posture FROM ticks"),
    ("runs", "SELECT *, CASE WHEN st THEN tick - coalesce(max(CASE WHEN NOT st THEN tick END) OVER (PARTITION BY recording_id ORDER BY tick_ts"
             " ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) ELSE 0 END AS still_ticks FROM flags"),
)


@query("m14_on_device_gates", with_ctes(
    "SELECT recording_id, tick, still_ticks, CASE WHEN still_ticks > 2 THEN 'rest' WHEN tick % 2 = 0 AND ge THEN 'gentle' ELSE 'model' END AS gate,"
    " CASE WHEN still_ticks > 2 THEN posture WHEN tick % 2 = 0 AND ge THEN 'walking' ELSE 'running' END AS label,"
    " CASE WHEN still_ticks > 2 THEN CAST(0.95 AS DOUBLE) WHEN tick % 2 = 0 AND ge THEN CAST(0.88 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS confidence FROM runs", *RULED))
def m14(spark, sf_dir):
    # the random stream is never still by the device's limits, so the flags use wider ones here
    ticks = device_ticks(spark, sf_dir).withColumns({
        "stationary": (F.col("even_acc_var") < 60) & (F.col("even_gyr_l1") < 6),
        "gentle": (F.col("even_acc_max") < 40) & (F.col("even_acc_min") > 1),
        "low_power": F.col("tick") % 2 == 0, "model_label": F.lit("running"),
        "model_probs": F.array(*[F.lit(0.5 if c == "running" else 0.1) for c in VALID_LABELS])})
    return MO.on_device_gates(ticks, slice_ms=None).select("recording_id", "tick", "still_ticks", "gate", "label", "confidence")


@query("q7_fitted_folds", with_ctes(
    "SELECT f AS fold, CASE WHEN own = f THEN 'val' ELSE 'train' END AS part, label, count(*) AS n_rows, count(*) AS n_known"
    " FROM (SELECT win.*, own FROM win JOIN given USING (subject_id)), range(5) t(f) GROUP BY ALL",
    ("sz", "SELECT subject_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, md5(subject_id), subject_id) AS i FROM win GROUP BY 1"),
    ("assign", "SELECT CAST(0 AS BIGINT) AS i, [0, 0, 0, 0, 0]::BIGINT[] AS loads, ''::VARCHAR AS subject_id, 0 AS own UNION ALL"
               " SELECT sz.i, list_transform(loads, lambda x, j: CASE WHEN j = list_position(loads, list_min(loads)) THEN x + n ELSE x END), sz.subject_id,"
               " list_position(loads, list_min(loads))::INT - 1 FROM assign JOIN sz ON sz.i = assign.i + 1"),
    ("given", "SELECT subject_id, own FROM assign WHERE i > 0")).replace("WITH ", "WITH RECURSIVE ", 1))
def q7_fitted(spark, sf_dir):
    """Five forests, each fitted on four folds of subjects: support of every class, and rows labelled with a known class."""
    vectors = X.feature_vectors(windows(spark, sf_dir))
    scored = X.cross_validate(vectors, 5, lambda train: MO.fit_forest(train, trees=20))
    return scored.groupBy(F.col("fold").cast("long").alias("fold"), "part", "label").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("prediction").isin(VALID_LABELS)).alias("n_known"))


@query("q10_fitted_subjects", with_ctes("SELECT subject_id AS fold, label, count(*) AS n_rows, count(*) AS n_known FROM win GROUP BY 1, 2"))
def q10_fitted(spark, sf_dir):
    """One tree per subject, fitted on all others."""
    vectors = X.feature_vectors(windows(spark, sf_dir))
    scored = X.leave_one_subject_out(vectors, MO.TreeFit(6))
    return scored.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("prediction").isin(VALID_LABELS)).alias("n_known"))


@query("q11_cross_dataset")
def q11(spark, sf_dir):
    return X.cross_dataset(parts(spark, sf_dir)[0])


@query("q15_baselines")
def q15(spark, sf_dir):
    _, train, test = parts(spark, sf_dir)
    return X.baselines(train, test, MO.fit_forest(train))


@query("q16_label_shuffle")
def q16(spark, sf_dir):
    _, train, test = parts(spark, sf_dir)
    return X.label_shuffle(train, test)


@query("q22_stress_table")
def q22(spark, sf_dir):
    _, train, test = parts(spark, sf_dir)
    keys = ["recording_id", "segment", "k"]
    held = windows(spark, sf_dir).join(test.select(*keys), keys, "left_semi")
    return X.stress_table(MO.fit_forest(train), materialize(held, "stress"))


@query("q23_real_data_report")
def q23(spark, sf_dir):
    every = materialize(add_age_group(windows(spark, sf_dir)).filter("dataset_id IN ('sisfall', 'own')"), "windows")
    return X.real_data_report(every.filter("dataset_id = 'sisfall'"), every.filter("dataset_id = 'own'"))

