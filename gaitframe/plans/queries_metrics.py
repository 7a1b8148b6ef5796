"""Queries over joins, metrics and audits. Predictions are the label of the previous window."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from gaitframe.operators import audits as Q
from gaitframe.operators import features as FE
from gaitframe.operators import joins as J
from gaitframe.operators import metrics as M
from gaitframe.operators import splits as G
from gaitframe.operators import windows as W
from gaitframe.plans.catalog import query
from gaitframe.plans.queries_reports import GROUPS, SPLIT
from gaitframe.plans.sensor import clean_samples, segments, sensor_view, table, windows
from gaitframe.plans.sql import SENSORS, r6, with_ctes
from gaitframe.schema import ACC, GYR, VALID_LABELS
from gaitframe.session import materialize


def scored_windows(spark, sf_dir):
    """Labelled windows with a prediction that needs no model (recordings hold at most 500 rows)."""
    previous = F.lag("label").over(Window.partitionBy("recording_id").orderBy("segment", "k"))
    return W.label_windows(segments(spark, sf_dir)).withColumn("prediction", F.coalesce(previous, F.lit("walking")))


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


# -- joins ---------------------------------------------------------------------------------------

@query("j1_fuse_asof", with_ctes(
    "SELECT recording_id, timestamp, ax, coalesce(last_value(g IGNORE NULLS) OVER w, 0.0) AS gx FROM"
    " (SELECT recording_id, timestamp, ax, gx, CASE WHEN timestamp % 60 = 0 THEN gx END AS g FROM clean)"
    " WINDOW w AS (PARTITION BY recording_id ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"))
def j1(spark, sf_dir):
    rows = clean_samples(spark, sf_dir)
    gyr = rows.filter(F.col("timestamp") % 60 == 0).select("recording_id", "timestamp", *GYR)
    return J.fuse_asof(rows.select("recording_id", "timestamp", *ACC), gyr, slice_ms=None).select(
        "recording_id", "timestamp", "ax", "gx")


@query("j1_fuse_asof_events", """SELECT event_id, user_id, coalesce(seen, 0.0) AS reading FROM (
  SELECT *, last_value(CASE WHEN event_type = 'error' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id
    ORDER BY ts, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen
  FROM events WHERE event_type IN ('click', 'error')) WHERE event_type = 'click'""")
def j1_events(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    acc = events.filter("event_type = 'click'").select("event_id", "user_id", "us")
    gyr = events.filter("event_type = 'error'").select("user_id", "us", F.col("value").alias("reading"))
    fused = J.asof(acc, gyr, ["user_id"], ["reading"], ts="us", slice_ms=7 * 86_400_000_000)
    return fused.select("event_id", "user_id", F.coalesce("reading", F.lit(0.0)).alias("reading"))


@query("j2_label_lookup", with_ctes(
    "SELECT recording_id, timestamp, code FROM sensor JOIN (VALUES ('falling', 0), ('lying', 1), ('running', 2), ('sitting', 3),"
    " ('standing', 4), ('walking', 5)) c(name, code) ON label = name"))
def j2(spark, sf_dir):
    codes = spark.createDataFrame([(n, i) for i, n in enumerate(VALID_LABELS)], "label string, code int")
    return (sensor_view(spark, sf_dir).join(F.broadcast(codes), "label", "left").select("recording_id", "timestamp", "code"))



@query("j4_merge_importance", with_ctes(
    " UNION ALL ".join(f"SELECT '{c}' AS feature, " + r6(f"stddev_pop({c})", "mdi_importance") + ", " +
                       r6(f"max({c})", "fall_perm_importance") + " FROM clean" for c in SENSORS)))
def j4(spark, sf_dir):
    rows = clean_samples(spark, sf_dir)
    left = rows.agg(*[F.stddev_pop(c).alias(c) for c in SENSORS]).unpivot([], SENSORS, "feature", "mdi_importance")
    right = rows.agg(*[F.max(c).alias(c) for c in SENSORS]).unpivot([], SENSORS, "feature", "fall_perm_importance")
    return rounded(J.merge_importance(left, right), "mdi_importance", "fall_perm_importance")


def halves(spark, sf_dir):
    w = materialize(windows(spark, sf_dir), "windows")
    split = G.group_shuffle(w, 0.2)
    return G.not_in_split(w, split, "test"), G.in_split(w, split, "test")


WINDOW_GROUPS = (
    ("gs", GROUPS[1].replace("FROM sensor", "FROM win")),
    ("vec", "SELECT recording_id, segment, k, subject_id, " + " || ".join(f"list({c} ORDER BY spot)" for c in SENSORS) +
            " AS v FROM wrow GROUP BY 1, 2, 3, 4"),
    ("side", "SELECT vec.*, split, md5('42:' || recording_id || ':' || segment || ':' || k) AS d FROM vec JOIN gs USING (subject_id)"),
    ("probe", "SELECT * FROM side WHERE split = 'test' ORDER BY d, recording_id, segment, k LIMIT 200"),
    ("near", "SELECT p.recording_id, p.segment, p.k, min(1 - list_cosine_similarity(p.v, t.v)) AS min_distance"
             " FROM probe p JOIN side t ON t.split = 'train' GROUP BY 1, 2, 3"),
)


@query("j5_near_duplicates", with_ctes(
    "SELECT recording_id, segment, k, " + r6("min_distance", "min_distance") + ", min_distance < 0.01 AS near_duplicate FROM near", *WINDOW_GROUPS))
def j5(spark, sf_dir):
    return rounded(J.near_duplicates(*halves(spark, sf_dir)), "min_distance")


@query("j5_nearest_train_windows", with_ctes(
    "SELECT p.recording_id, p.segment, p.k, " + r6("min(1 - list_cosine_similarity(p.v, t.v))", "min_distance") + ", min(1 - list_cosine_similarity(p.v, t.v)) < 0.01 AS near_duplicate"
    " FROM side p JOIN side t ON p.split = 'test' AND t.split = 'train' GROUP BY 1, 2, 3", *WINDOW_GROUPS))
def j5_all(spark, sf_dir):
    """Every test window with its nearest train window, none sampled."""
    near = J.nearest_windows(*halves(spark, sf_dir))
    return rounded(near, "min_distance")


@query("j6_exact_duplicates", with_ctes(
    "SELECT count(*) AS exact_duplicates FROM (SELECT v FROM side WHERE split = 'train' INTERSECT SELECT v FROM side WHERE split = 'test')", *WINDOW_GROUPS))
def j6(spark, sf_dir):
    return J.exact_duplicates(*halves(spark, sf_dir)).agg(F.count(F.lit(1)).alias("exact_duplicates"))


@query("t5_seeded_sample", with_ctes("SELECT recording_id, segment, k FROM probe", *WINDOW_GROUPS))
def t5(spark, sf_dir):
    w = W.label_windows(segments(spark, sf_dir))
    test = G.in_split(w, G.group_shuffle(w, 0.2), "test")
    return J.seeded_sample(test, 200, ["recording_id", "segment", "k"]).select("recording_id", "segment", "k")


# -- metrics -------------------------------------------------------------------------------------

def metric_ctes(by=""):
    """Class counts and scores of ``pred``, per ``by`` expression when given."""
    key = f"{by} AS grp, " if by else "0 AS grp, "
    return (
        ("conf", f"SELECT {key}label, prediction, count(*) AS n FROM pred GROUP BY ALL"),
        ("cls", "SELECT grp, class, sum(s) AS support, sum(p) AS predicted, sum(h) AS hits FROM"
                " (SELECT grp, label AS class, n AS s, 0 AS p, CASE WHEN label = prediction THEN n ELSE 0 END AS h FROM conf"
                " UNION ALL SELECT grp, prediction, 0, n, 0 FROM conf) GROUP BY 1, 2"),
        ("pr", "SELECT *, CASE WHEN predicted > 0 THEN hits / predicted ELSE 0 END AS prec, CASE WHEN support > 0 THEN hits / support ELSE 0 END AS rec FROM cls"),
        ("sc", "SELECT *, CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0 END AS f1 FROM pr"),
        ("overall", "SELECT grp, sum(hits) / sum(support) AS accuracy, avg(f1) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1,"
                    " avg(rec) FILTER (support > 0) AS balanced_accuracy, sum(prec) / 6 AS macro_precision, sum(rec) / 6 AS macro_recall FROM sc GROUP BY 1"),
        ("sf0", "SELECT grp, coalesce(sum(n) FILTER (label = 'falling' AND prediction = 'falling'), 0) AS tp,"
                " coalesce(sum(n) FILTER (label = 'falling' AND prediction <> 'falling'), 0) AS fn,"
                " coalesce(sum(n) FILTER (label <> 'falling' AND prediction = 'falling'), 0) AS fp,"
                " coalesce(sum(n) FILTER (label <> 'falling' AND prediction <> 'falling'), 0) AS tn FROM conf GROUP BY 1"),
        ("sf", "SELECT *, coalesce(tp / nullif(tp + fn, 0), 0) AS fall_recall, coalesce(tp / nullif(tp + fp, 0), 0) AS fall_precision,"
               " coalesce(tn / nullif(tn + fp, 0), 0) AS specificity, coalesce(fp / nullif(tn + fp, 0), 0) AS fpr, coalesce(fn / nullif(tp + fn, 0), 0) AS fnr FROM sf0"),
        ("safe", "SELECT *, CASE WHEN fall_precision + fall_recall > 0 THEN 2 * fall_precision * fall_recall / (fall_precision + fall_recall) ELSE 0 END AS fall_f1 FROM sf"),
    )


FLAT = metric_ctes()
OVERALL = ["accuracy", "macro_f1", "weighted_f1"]
RATES = ["fall_recall", "fall_precision", "fall_f1", "specificity", "fpr", "fnr"]


def sixes(names):
    return ", ".join(r6(n, n) for n in names)


@query("q1_overall", with_ctes(f"SELECT {sixes(OVERALL)} FROM overall", *FLAT))
def q1(spark, sf_dir):
    return rounded(M.overall(scored_windows(spark, sf_dir)), *OVERALL).select(*OVERALL)


@query("q2_per_class", with_ctes(
    "SELECT c.class, " + ", ".join([r6("coalesce(prec, 0)", "precision"), r6("coalesce(rec, 0)", "recall"), r6("coalesce(f1, 0)", "f1")]) +
    ", CAST(coalesce(support, 0) AS BIGINT) AS support FROM (VALUES ('falling'), ('lying'), ('running'), ('sitting'), ('standing'), ('walking'), ('stairs_up')) c(class)"
    " LEFT JOIN sc ON sc.class = c.class", *FLAT))
def q2(spark, sf_dir):
    return rounded(M.per_class(scored_windows(spark, sf_dir), [*VALID_LABELS, "stairs_up"]), "precision", "recall", "f1")


@query("q3_fall_report", with_ctes(f"SELECT {sixes(RATES[:3])}, fall_recall < 0.9 AS below_target FROM safe", *FLAT))
def q3(spark, sf_dir):
    return rounded(M.fall_report(scored_windows(spark, sf_dir)), *RATES[:3])


PAIRS = ("pairs", "SELECT a.c AS label, b.c AS prediction FROM (VALUES ('falling'), ('lying'), ('running'), ('sitting'), ('standing'), ('walking')) a(c),"
                  " (VALUES ('falling'), ('lying'), ('running'), ('sitting'), ('standing'), ('walking')) b(c)")


@query("q4_confusion", with_ctes(
    "SELECT p.label, p.prediction, coalesce(n, 0) AS n, round(coalesce(coalesce(n, 0) / nullif(sum(coalesce(n, 0)) OVER (PARTITION BY p.label), 0), 0), 6) AS row_share"
    " FROM pairs p LEFT JOIN conf ON conf.label = p.label AND conf.prediction = p.prediction", *FLAT, PAIRS))
def q4(spark, sf_dir):
    return rounded(M.confusion_table(scored_windows(spark, sf_dir), VALID_LABELS), "row_share")


@query("q4_confusion_wide", with_ctes(
    "SELECT p.label, " + ", ".join(f"CAST(sum(coalesce(n, 0)) FILTER (p.prediction = '{c}') AS BIGINT) AS {c}" for c in VALID_LABELS) +
    " FROM pairs p LEFT JOIN conf ON conf.label = p.label AND conf.prediction = p.prediction GROUP BY 1", *FLAT, PAIRS))
def q4_wide(spark, sf_dir):
    return M.confusion_wide(scored_windows(spark, sf_dir), VALID_LABELS)


@query("q5_safety_metrics", with_ctes(
    f"SELECT CAST(tp AS BIGINT) AS tp, CAST(fn AS BIGINT) AS fn, CAST(fp AS BIGINT) AS fp, CAST(tn AS BIGINT) AS tn, {sixes(RATES)} FROM safe", *FLAT))
def q5(spark, sf_dir):
    return rounded(M.safety(scored_windows(spark, sf_dir)), *RATES)


@query("q6_balanced_accuracy", with_ctes(f"SELECT {sixes(['balanced_accuracy'])} FROM overall", *FLAT))
def q6(spark, sf_dir):
    return rounded(M.overall(scored_windows(spark, sf_dir)), "balanced_accuracy").select("balanced_accuracy")


# Five folds by digest of the subject; the training part of a fold is the other four.
FOLD_SQL = "CAST(('0x' || substr(md5(subject_id), 1, 4)) AS BIGINT) % 5"
CV = (
    ("folded", f"SELECT *, {FOLD_SQL} AS own FROM pred"),
    ("cvpred", "SELECT f AS fold, CASE WHEN own = f THEN 'val' ELSE 'train' END AS part, label, prediction FROM folded, range(5) t(f)"),
    *[(n, t.replace("FROM pred", "FROM cvpred").replace("0 AS grp", "fold || part AS grp")) for n, t in FLAT],
    ("cvf", "SELECT v.grp[1:1] AS fold, t.accuracy AS train_acc, v.accuracy AS val_acc, t.accuracy - v.accuracy AS gap, v.macro_f1, s.fall_recall, s.fall_f1"
            " FROM overall v JOIN overall t ON v.grp = t.grp[1:1] || 'val' AND t.grp LIKE '%train' JOIN safe s ON s.grp = v.grp"),
)
CV_NAMES = ["train_acc", "val_acc", "gap", "macro_f1", "fall_recall", "fall_f1"]


def cv_scored(spark, sf_dir):
    """Every window in the validation part of its own fold and the training part of the four
    others: five copies of a scored row, a fixed factor."""
    own = F.conv(F.substring(F.md5("subject_id"), 1, 4), 16, 10).cast("long") % 5
    rows = scored_windows(spark, sf_dir).withColumn("own", own)
    rows = rows.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(4))))
    part = F.when(F.col("own") == F.col("fold"), "val").otherwise("train")
    return rows.select(F.lit("previous label").alias("model"), "fold", part.alias("part"), "label", "prediction")


@query("q7_cv_folds", with_ctes("SELECT CAST(fold AS INTEGER) AS fold, " + sixes(CV_NAMES) + " FROM cvf", *CV))
def q7_folds(spark, sf_dir):
    return rounded(M.cv_folds(cv_scored(spark, sf_dir)), *CV_NAMES).drop("model")


@query("q7_cv_summary", with_ctes(
    "SELECT 'previous label' AS model, " + ", ".join(r6(f"{f}({c})", f"{c}_{s}") for c in CV_NAMES for f, s in (("avg", "mean"), ("stddev_pop", "std"))) + " FROM cvf", *CV))
def q7(spark, sf_dir):
    names = [f"{c}_{s}" for c in CV_NAMES for s in ("mean", "std")]
    return rounded(M.cv_summary(M.cv_folds(cv_scored(spark, sf_dir))), *names)


@query("q8_bias_variance", with_ctes(
    "SELECT CAST(fold AS INTEGER) AS fold, " + r6("gap", "generalization_gap") + ", train_acc < 0.8 AS underfitting, NOT abs(gap) < 0.05 AS overfitting,"
    " val_acc >= 0.8 AS target_met, CASE WHEN train_acc >= 0.8 AND abs(gap) < 0.05 THEN 'OPTIMAL FIT' ELSE 'NEEDS TUNING' END AS overall FROM cvf", *CV))
def q8(spark, sf_dir):
    d = M.diagnose(M.cv_folds(cv_scored(spark, sf_dir)), "train_acc", "val_acc", signed=False)
    return rounded(d, "generalization_gap").select("fold", "generalization_gap", "underfitting", "overfitting", "target_met", "overall")


@query("q9_comparison", with_ctes(
    "SELECT 'previous' AS model, " + sixes(["accuracy", "macro_f1", "fall_recall", "fall_f1"]) + " FROM overall JOIN safe USING (grp)", *FLAT))
def q9(spark, sf_dir):
    return rounded(M.comparison({"previous": scored_windows(spark, sf_dir)}), "accuracy", "macro_f1", "fall_recall", "fall_f1")


LOSO = metric_ctes("subject_id")
LOSO_NAMES = ["accuracy", "precision", "recall", "f1", "fall_recall", "fall_precision", "fpr"]
LOSO_SQL = ["accuracy", "macro_precision", "macro_recall", "macro_f1", "fall_recall", "fall_precision", "fpr"]


def loso(spark, sf_dir):
    return M.loso_table(scored_windows(spark, sf_dir).withColumnRenamed("subject_id", "fold"), VALID_LABELS)


@query("q10_loso_table", with_ctes(
    "SELECT grp AS fold, " + ", ".join(r6(e, n) for e, n in zip(LOSO_SQL, LOSO_NAMES)) + " FROM overall JOIN safe USING (grp)", *LOSO))
def q10(spark, sf_dir):
    return rounded(loso(spark, sf_dir), *LOSO_NAMES)


@query("q10_loso_summary", with_ctes(
    "SELECT " + ", ".join(r6(f"{f}({e})", f"{n}_{s}") for e, n in zip(LOSO_SQL, LOSO_NAMES) for f, s in (("avg", "mean"), ("stddev_samp", "std"))) +
    " FROM overall JOIN safe USING (grp)", *LOSO))
def q10_summary(spark, sf_dir):
    return rounded(M.loso_summary(loso(spark, sf_dir)), *[f"{n}_{s}" for n in LOSO_NAMES for s in ("mean", "std")])


# -- audits --------------------------------------------------------------------------------------

@query("q12_split_audit", with_ctes(
    "SELECT count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'validation') AS n_validation, count(*) FILTER (split = 'test') AS n_test,"
    " 0 AS train_validation, 0 AS train_test, 0 AS validation_test, 0 AS recordings_crossing FROM split", *SPLIT))
def q12(spark, sf_dir):
    return Q.split_audit(G.experiment(sensor_view(spark, sf_dir), "A"))


def parity(df):
    return df.withColumn("split", F.when(F.col("k") % 2 == 0, "train").otherwise("test"))


@query("q13_windowing_audit", with_ctes(
    "SELECT (SELECT count(*) FROM side WHERE split = 'train') AS before_train, (SELECT count(*) FROM side WHERE split = 'test') AS before_test,"
    " (SELECT count(*) FROM win WHERE k % 2 = 0) AS after_train, (SELECT count(*) FROM win WHERE k % 2 = 1) AS after_test,"
    " (SELECT count(*) FROM (SELECT DISTINCT a.recording_id, a.segment, a.k FROM wrow a JOIN wrow b ON a.recording_id = b.recording_id"
    " AND a.timestamp = b.timestamp AND a.k % 2 = 1 AND b.k % 2 = 0)) AS overlapping_test_windows,"
    " (SELECT count(*) FROM (SELECT recording_id FROM win GROUP BY 1 HAVING count(DISTINCT k % 2) > 1)) AS recordings_crossing", *WINDOW_GROUPS))
def q13(spark, sf_dir):
    # windows dealt out by parity after windowing, against subjects split before: the first leaks
    labels = materialize(W.label_windows(segments(spark, sf_dir)), "labels")
    return Q.windowing_audit(G.apply_split(labels, G.group_shuffle(labels, 0.2)), parity(labels))


@query("q14_duplicate_audit", with_ctes(
    "SELECT count(*) AS n_sampled, count(*) FILTER (min_distance < 0.01) AS near_duplicates,"
    + ", ".join([r6("avg(CAST(min_distance < 0.01 AS INTEGER)) * 100", "pct_near_duplicates"), r6("avg(min_distance)", "mean_min_distance"),
                 r6("stddev_pop(min_distance)", "std_min_distance")]) +
    ", (SELECT count(*) FROM (SELECT v FROM side WHERE split = 'train' INTERSECT SELECT v FROM side WHERE split = 'test')) AS exact_duplicates FROM near", *WINDOW_GROUPS))
def q14(spark, sf_dir):
    return rounded(Q.duplicate_audit(*halves(spark, sf_dir)), "pct_near_duplicates", "mean_min_distance", "std_min_distance")


@query("q17_metadata_names", with_ctes(
    "SELECT feature, n_values, list_has_any(string_split(lower(feature), '_'), " + str(list(Q.FORBIDDEN_TOKENS)) + ") AS suspicious FROM"
    " (SELECT unnest(" + str(FE.feature_names()) + ") AS feature, (SELECT count(*) FROM win) AS n_values)"))
def q17(spark, sf_dir):
    counted = W.label_windows(segments(spark, sf_dir)).agg(F.count(F.lit(1)).alias("n_values"))
    return Q.suspicious_names(counted.select(F.explode(F.array(*map(F.lit, FE.feature_names()))).alias("feature"), "n_values"))


@query("q18_label_correlations", with_ctes(
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(CASE WHEN min({c}) < max({c}) THEN corr({c} - CAST({base} AS DOUBLE), code) END, 6) + 0.0 AS correlation FROM coded"
                       for c, base in [("timestamp", 1600000000000), *[(c, 0) for c in SENSORS]]),
    ("coded", "SELECT *, dense_rank() OVER (ORDER BY label) - 1 AS code FROM clean")))
def q18(spark, sf_dir):
    return rounded(Q.label_correlations(clean_samples(spark, sf_dir)), "correlation")


def stressed(spark, sf_dir, change):
    rows = W.explode_windows(change(windows(spark, sf_dir)))
    return rows.select("recording_id", "segment", "k", F.col("at").alias("spot"), *[F.round(c, 6).alias(c) for c in SENSORS])


def plain(names):
    return ", ".join(r6(n, n) for n in names)


@query("q19_tilt", with_ctes(
    "SELECT recording_id, segment, k, spot, " + r6("ax * cos(radians(25)) - ay * sin(radians(25))", "ax") + ", "
    + r6("ax * sin(radians(25)) + ay * cos(radians(25))", "ay") + ", " + plain(["az", "gx", "gy", "gz"]) + " FROM wrow"))
def q19(spark, sf_dir):
    return stressed(spark, sf_dir, Q.tilt_windows)


@query("q20_speed", with_ctes(
    "SELECT recording_id, segment, k, spot, " + ", ".join(r6(f"{c}[1 + CAST(floor(p) AS INT)] + ({c}[1 + CAST(ceil(p) AS INT)] - {c}[1 + CAST(floor(p) AS INT)]) * (p - floor(p))", c)
                                                          for c in SENSORS) + " FROM spots",
    ("lists", "SELECT recording_id, segment, k, any_value(label) AS label, " + ", ".join(f"list({c} ORDER BY spot) AS {c}" for c in SENSORS) + " FROM wrow GROUP BY 1, 2, 3"),
    ("spots", "SELECT *, CASE WHEN label IN ('walking', 'running') THEN least(spot * CASE WHEN k % 2 = 0 THEN CAST(1.3 AS DOUBLE) ELSE CAST(0.7 AS DOUBLE) END, 99.0)"
              " ELSE CAST(spot AS DOUBLE) END AS p FROM (SELECT *, unnest(range(100)) AS spot FROM lists)")))
def q20(spark, sf_dir):
    return stressed(spark, sf_dir, Q.speed_windows)


@query("q21_slump", with_ctes(
    "SELECT recording_id, segment, k, spot, " + ", ".join(r6(f"{c} * CASE WHEN label = 'falling' THEN CAST(0.55 AS DOUBLE) ELSE 1.0 END", c) for c in ACC) + ", "
    + plain(GYR) + " FROM wrow"))
def q21(spark, sf_dir):
    return stressed(spark, sf_dir, Q.slump_windows)
