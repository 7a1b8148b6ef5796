"""Queries over the reports and the splits."""

from pyspark.sql import functions as F

from gaitframe.operators import reports as A
from gaitframe.operators import splits as G
from gaitframe.operators.registry import sampling_rates
from gaitframe.operators.cleaning import add_age_group
from gaitframe.operators.windows import label_windows
from gaitframe.plans.catalog import query
from gaitframe.plans.sensor import segments, sensor_view
from gaitframe.plans.sql import SENSORS, with_ctes

DATASETS = ["kfall", "mobiact", "own", "sisfall", "unimib_shar"]


def report_rows(spark, sf_dir):
    """The sensor view as the reports read it; missing gyroscope values stay NULL."""
    rows = sensor_view(spark, sf_dir).withColumnRenamed("label", "unified_label")
    return add_age_group(rows.withColumn("has_gyro", F.col("gx").isNotNull()))


def rep(body, *extra):
    return with_ctes(body, ("rep", "SELECT *, label AS unified_label, gx IS NOT NULL AS has_gyro,"
                                   " CASE WHEN subject_id LIKE '%older%' THEN 'older_adult' WHEN subject_id LIKE '%young%' THEN 'young_adult'"
                                   " WHEN subject_id LIKE 'own%' THEN 'unknown' ELSE 'adult' END AS age_group FROM sensor"), *extra)


@query("a1_dataset_summary", rep(
    "SELECT dataset_id, count(*) AS n_rows, count(DISTINCT subject_id) AS n_subjects, count(DISTINCT recording_id) AS n_recordings,"
    " count(DISTINCT unified_label) AS n_unique_labels, round_even(count(*) / 50 / 60, 1) AS est_duration_min,"
    " round_even(avg(CAST(has_gyro AS INTEGER)) * 100, 1) AS has_gyro_pct FROM rep GROUP BY 1"))
def a1(spark, sf_dir):
    return A.dataset_summary(report_rows(spark, sf_dir))


@query("a2_class_distribution", rep(
    "SELECT unified_label, dataset_id, phone_position, count(ax) AS n_rows, count(DISTINCT subject_id) AS n_subjects,"
    " count(DISTINCT recording_id) AS n_recordings FROM rep GROUP BY 1, 2, 3"))
def a2(spark, sf_dir):
    return A.class_distribution(report_rows(spark, sf_dir))


@query("a3_subject_distribution", rep("SELECT subject_id, unified_label, count(ax) AS n_rows FROM rep GROUP BY 1, 2"))
def a3(spark, sf_dir):
    return A.subject_distribution(report_rows(spark, sf_dir))


LONG = ("long", " UNION ALL ".join(f"SELECT dataset_id, '{c}' AS channel, {c} AS value FROM rep WHERE {c} IS NOT NULL" for c in SENSORS))


@query("a4_sensor_statistics", rep(
    "SELECT dataset_id, channel, round(avg(value), 4) + 0.0 AS mean, round(stddev_samp(value), 4) AS std, round(min(value), 4) AS min,"
    " round(max(value), 4) AS max, round(quantile_cont(value, 0.05), 4) AS pct5, round(quantile_cont(value, 0.95), 4) AS pct95"
    " FROM long GROUP BY 1, 2", LONG))
def a4(spark, sf_dir):
    return A.sensor_statistics(report_rows(spark, sf_dir))


@query("a5_position_distribution", rep(
    "SELECT phone_position, count(ax) AS n_rows, count(DISTINCT subject_id) AS n_subjects, count(DISTINCT recording_id) AS n_recordings,"
    " count(DISTINCT dataset_id) AS n_datasets FROM rep GROUP BY 1"))
def a5(spark, sf_dir):
    return A.position_distribution(report_rows(spark, sf_dir))


@query("a6_balance_overview", rep(
    "SELECT unified_label, count(*) AS n_rows, round(count(*) / sum(count(*)) OVER () * 100, 6) AS share_pct FROM rep GROUP BY 1"))
def a6(spark, sf_dir):
    return A.balance_overview(report_rows(spark, sf_dir)).withColumn("share_pct", F.round("share_pct", 6))


DIVERSITY = ("count(*) AS n_rows, count(DISTINCT subject_id) AS n_subjects, count(DISTINCT recording_id) AS n_recordings,"
             " CAST(sum(CAST(has_gyro AS INTEGER)) AS BIGINT) AS gyro_rows, string_agg(DISTINCT age_group, ',' ORDER BY age_group) AS age_groups,"
             " string_agg(DISTINCT phone_position, ',' ORDER BY phone_position) AS positions FROM rep")


@query("a7_diversity_summary", rep(
    f"SELECT unified_label, {DIVERSITY} GROUP BY 1 UNION ALL SELECT '*' AS unified_label, {DIVERSITY}"))
def a7(spark, sf_dir):
    return A.diversity_summary(report_rows(spark, sf_dir))


@query("a8_load_summary", with_ctes("SELECT label, count(*) AS n_rows, count(DISTINCT subject_id) AS n_subjects FROM sensor GROUP BY 1"))
def a8(spark, sf_dir):
    return A.load_summary(sensor_view(spark, sf_dir))


WEIGHTS = (
    ("inv", "SELECT label, sum(count(*)) OVER () / count(*) AS w FROM win GROUP BY 1"),
    ("scaled", "SELECT label, w / sum(w) OVER () * count(*) OVER () AS w FROM inv"),
    ("weights", "SELECT label, round(greatest(w, 0.1 * max(w) OVER ()), 6) AS weight FROM scaled"),
)


def labelled(spark, sf_dir):
    return label_windows(segments(spark, sf_dir))


@query("a9_class_weights", with_ctes("SELECT label, weight FROM weights", *WEIGHTS))
def a9(spark, sf_dir):
    return A.class_weights(labelled(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


@query("a10_class_weight_array", with_ctes(
    "SELECT pos, coalesce(weight, 1.0) AS weight FROM (VALUES (0, 'walking'), (1, 'jumping'), (2, 'falling'), (3, 'lying')) c(pos, class)"
    " LEFT JOIN weights ON label = class", *WEIGHTS))
def a10(spark, sf_dir):
    row = A.class_weight_array(labelled(spark, sf_dir), ["walking", "jumping", "falling", "lying"])
    return row.select(F.posexplode("weights").alias("pos", "weight")).withColumn("weight", F.round("weight", 6))


@query("a11_balanced_weights", with_ctes(
    "SELECT label, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight FROM win GROUP BY 1"))
def a11(spark, sf_dir):
    return A.balanced_weights(labelled(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


@query("a12_class_by_dataset", rep(
    "SELECT unified_label, " + ", ".join(f"count(*) FILTER (dataset_id = '{d}') AS {d}" for d in DATASETS) + " FROM rep GROUP BY 1"))
def a12(spark, sf_dir):
    return A.class_by_dataset(report_rows(spark, sf_dir), DATASETS)


@query("a13_subjects_by_dataset", rep(
    "SELECT unified_label, " + ", ".join(f"count(DISTINCT subject_id) FILTER (dataset_id = '{d}') AS {d}" for d in DATASETS) + " FROM rep GROUP BY 1"))
def a13(spark, sf_dir):
    return A.subjects_by_dataset(report_rows(spark, sf_dir), DATASETS)


@query("a14_sensor_ranges", rep(
    "SELECT dataset_id, kind, round(q1, 6) + 0.0 AS q1, round(median, 6) + 0.0 AS median, round(q3, 6) + 0.0 AS q3,"
    " round(min(value) FILTER (value >= q1 - 1.5 * (q3 - q1)), 6) + 0.0 AS whisker_low,"
    " round(max(value) FILTER (value <= q3 + 1.5 * (q3 - q1)), 6) + 0.0 AS whisker_high, count(*) AS n_values"
    " FROM kinds JOIN boxes USING (dataset_id, kind) GROUP BY dataset_id, kind, q1, median, q3", LONG,
    ("kinds", "SELECT dataset_id, CASE WHEN channel LIKE 'a%' THEN 'accelerometer' ELSE 'gyroscope' END AS kind, value FROM long"),
    ("boxes", "SELECT dataset_id, kind, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,"
              " quantile_cont(value, 0.75) AS q3 FROM kinds GROUP BY 1, 2")))
def a14(spark, sf_dir):
    box = A.sensor_ranges(report_rows(spark, sf_dir))
    return box.withColumns({c: F.round(c, 6) for c in ("q1", "median", "q3", "whisker_low", "whisker_high")})


DURATIONS = ("dur", "SELECT recording_id, count(*) / 50 / 60 AS minutes FROM sensor GROUP BY 1")


@query("a15_median_duration", with_ctes("SELECT round(median(minutes), 6) AS median_minutes FROM dur", DURATIONS))
def a15_median(spark, sf_dir):
    return A.median_duration(sensor_view(spark, sf_dir)).withColumn("median_minutes", F.round("median_minutes", 6))


@query("a15_duration_histogram", with_ctes(
    "SELECT bin, round(lo + (bin - 1) * (hi - lo) / 40, 6) AS from_minutes, round(lo + bin * (hi - lo) / 40, 6) AS to_minutes,"
    " (SELECT count(*) FROM dur WHERE least(40, floor((minutes - lo) / (hi - lo) * 40) + 1) = bin) AS n_recordings"
    " FROM range(1, 41) r(bin) JOIN lim ON true", DURATIONS, ("lim", "SELECT min(minutes) AS lo, max(minutes) AS hi FROM dur")))
def a15_histogram(spark, sf_dir):
    return A.duration_histogram(sensor_view(spark, sf_dir)).withColumns(
        {c: F.round(c, 6) for c in ("from_minutes", "to_minutes")})


@query("a16_position_counts", rep("SELECT phone_position, count(ax) AS n_rows, count(DISTINCT subject_id) AS n_subjects FROM rep GROUP BY 1"))
def a16(spark, sf_dir):
    return A.position_counts(report_rows(spark, sf_dir))


@query("a17_sampling_rates", with_ctes(
    "SELECT r.ds AS dataset_id, r.rate AS sampling_rate_hz, r.rate <> 50 AS needs_resampling, count(s.dataset_id) AS n_rows"
    " FROM (VALUES ('unimib_shar', 50), ('mobiact', 200), ('sisfall', 200), ('kfall', 100)) r(ds, rate)"
    " LEFT JOIN sensor s ON s.dataset_id = r.ds GROUP BY 1, 2, 3"))
def a17(spark, sf_dir):
    seen = sensor_view(spark, sf_dir).groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n_rows"))
    return sampling_rates(spark).join(seen, "dataset_id", "left").na.fill(0, ["n_rows"])


SPLIT = (
    ("who", "SELECT subject_id, min(dataset_id) AS dataset_id FROM sensor GROUP BY 1"),
    ("sizes", "SELECT *, greatest(1, round_even((n - n_test) * 0.15, 0)) AS n_val FROM (SELECT dataset_id, count(*) AS n,"
              " greatest(1, round_even(count(*) * 0.2, 0)) AS n_test FROM who GROUP BY 1)"),
    ("ranks", "SELECT subject_id, dataset_id, row_number() OVER (PARTITION BY dataset_id ORDER BY md5('42:' || subject_id), subject_id) - 1 AS r FROM who"),
    ("split", "SELECT subject_id, dataset_id, CASE WHEN n - n_test - n_val < 1 THEN CASE WHEN r = 0 THEN 'test' ELSE 'train' END"
              " WHEN r < n_test THEN 'test' WHEN r < n_test + n_val THEN 'validation' ELSE 'train' END AS split"
              " FROM ranks JOIN sizes USING (dataset_id)"),
)


def holdout_sql(held):
    return (
        SPLIT[0],
        ("rest", f"SELECT subject_id, dataset_id, row_number() OVER (ORDER BY md5('42:' || subject_id), subject_id) - 1 AS r,"
                 f" greatest(1, floor(count(*) OVER () * 0.15)) AS n_val FROM who WHERE dataset_id <> '{held}'"),
        ("split", "SELECT subject_id, dataset_id, CASE WHEN r < n_val THEN 'validation' ELSE 'train' END AS split FROM rest"
                  f" UNION ALL SELECT subject_id, dataset_id, 'test' FROM who WHERE dataset_id = '{held}'"),
    )


STATS = ("SELECT split, count(*) AS n_rows, count(DISTINCT subject_id) AS n_subjects, count(DISTINCT recording_id) AS n_recordings,"
         " string_agg(DISTINCT s.dataset_id, ',' ORDER BY s.dataset_id) AS datasets FROM sensor s JOIN split USING (subject_id) GROUP BY 1")


@query("a18_split_statistics", with_ctes(STATS, *SPLIT))
def a18(spark, sf_dir):
    return A.split_statistics(G.experiment(sensor_view(spark, sf_dir), "A"))


@query("g1_subject_split", with_ctes("SELECT subject_id, dataset_id, split FROM split", *SPLIT))
def g1(spark, sf_dir):
    return G.subject_split(sensor_view(spark, sf_dir))


@query("g2_experiment_a", with_ctes("SELECT subject_id, split, count(*) AS n_rows FROM sensor JOIN split USING (subject_id) GROUP BY 1, 2", *SPLIT))
def g2(spark, sf_dir):
    return G.experiment(sensor_view(spark, sf_dir), "A").groupBy("subject_id", "split").agg(F.count(F.lit(1)).alias("n_rows"))


@query("g3_experiment_b", with_ctes(STATS, *holdout_sql("kfall")))
def g3(spark, sf_dir):
    return A.split_statistics(G.experiment(sensor_view(spark, sf_dir), "B", "kfall"))


@query("g4_experiment_c", with_ctes(STATS, *holdout_sql("own")))
def g4(spark, sf_dir):
    return A.split_statistics(G.experiment(sensor_view(spark, sf_dir), "C"))


@query("g5_cohort_split", rep(
    "SELECT CASE age_group WHEN 'young_adult' THEN 'train' ELSE 'test' END AS split, count(*) AS n_rows, count(DISTINCT subject_id) AS n_subjects"
    " FROM rep WHERE age_group IN ('young_adult', 'older_adult') GROUP BY 1"))
def g5(spark, sf_dir):
    return (G.cohort_split(add_age_group(sensor_view(spark, sf_dir))).groupBy("split", "subject_id")
            .agg(F.count(F.lit(1)).alias("n")).groupBy("split")
            .agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_subjects")))


GROUPS = ("gs", "SELECT subject_id, CASE WHEN row_number() OVER (ORDER BY md5('42:' || subject_id), subject_id) - 1 < ceil(count(*) OVER () * 0.2)"
                " THEN 'test' ELSE 'train' END AS split FROM (SELECT DISTINCT subject_id FROM sensor)")


@query("g6_group_shuffle", with_ctes("SELECT subject_id, split FROM gs", GROUPS))
def g6(spark, sf_dir):
    return G.group_shuffle(sensor_view(spark, sf_dir), 0.2)


@query("g7_group_kfold", with_ctes("""SELECT CAST(f AS BIGINT) AS fold, loads[f + 1] AS n_windows, nums[f + 1] AS n_subjects
FROM (SELECT loads, nums FROM assign ORDER BY i DESC LIMIT 1), range(5) t(f)""",
    ("sz", "SELECT subject_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, md5(subject_id), subject_id) AS i FROM win GROUP BY 1"),
    ("assign", "SELECT CAST(0 AS BIGINT) AS i, [0, 0, 0, 0, 0]::BIGINT[] AS loads, [0, 0, 0, 0, 0]::BIGINT[] AS nums UNION ALL"
               " SELECT sz.i, list_transform(loads, lambda x, j: CASE WHEN j = list_position(loads, list_min(loads)) THEN x + n ELSE x END),"
               " list_transform(nums, lambda x, j: CASE WHEN j = list_position(loads, list_min(loads)) THEN x + 1 ELSE x END)"
               " FROM assign JOIN sz ON sz.i = assign.i + 1")).replace("WITH ", "WITH RECURSIVE ", 1))
def g7(spark, sf_dir):
    folds = G.group_kfold(labelled(spark, sf_dir), 5)
    return folds.groupBy(F.col("fold").cast("long").alias("fold")).agg(
        F.sum("n_rows").alias("n_windows"), F.count(F.lit(1)).alias("n_subjects"))


@query("g8_loso_folds", with_ctes(
    "SELECT subject_id AS fold, count(*) AS n_test, (SELECT count(*) FROM win) - count(*) AS n_train FROM win GROUP BY 1"))
def g8(spark, sf_dir):
    return G.loso_folds(labelled(spark, sf_dir))


@query("g9_leakage_check", with_ctes("SELECT subject_id, count(DISTINCT split) AS n_splits FROM split GROUP BY 1", *SPLIT))
def g9(spark, sf_dir):
    return G.assert_no_leakage(G.subject_split(sensor_view(spark, sf_dir)))


@query("j3_split_semi_anti", with_ctes(
    "SELECT 'test' AS part, count(*) AS n_rows FROM sensor WHERE subject_id IN (SELECT subject_id FROM split WHERE split = 'test')"
    " UNION ALL SELECT 'other', count(*) FROM sensor WHERE subject_id NOT IN (SELECT subject_id FROM split WHERE split = 'test')", *SPLIT))
def j3(spark, sf_dir):
    rows = sensor_view(spark, sf_dir)
    split = G.subject_split(rows)
    count = F.count(F.lit(1)).alias("n_rows")
    return (G.in_split(rows, split, "test").groupBy(F.lit("test").alias("part")).agg(count)
            .unionByName(G.not_in_split(rows, split, "test").groupBy(F.lit("other").alias("part")).agg(count)))
