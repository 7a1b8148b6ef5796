"""The given tables seen as a six-channel sensor stream (FIXTURES.md section 2)."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaitframe.operators.cleaning import add_gyro_flag, drop_out_of_range
from gaitframe.operators.ordered import add_segments, ordered_position
from gaitframe.operators.windows import collect_windows

#: Order keys per slice in which the rows of a supplier are ordered.
ORDER_KEYS_PER_SLICE = 8_192


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sensor_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate",
        "l_quantity", "l_discount", "l_tax")
    lines = ordered_position(
        lines, ["l_suppkey"],
        ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate"],
        F.floor(F.col("l_orderkey") / ORDER_KEYS_PER_SLICE), out="i")
    makers = (
        table(spark, sf_dir, "supplier").join(
            table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select("s_suppkey", "s_acctbal", "n_regionkey"))
    rows = lines.join(makers, F.col("l_suppkey") == F.col("s_suppkey"))

    region = F.col("n_regionkey")
    dataset = (F.when(region == 0, "unimib_shar").when(region == 1, "mobiact")
               .when(region == 2, "sisfall").when(region == 3, "kfall").otherwise("own"))
    rows = rows.withColumn("dataset_id", dataset)
    ds, i, supp = F.col("dataset_id"), F.col("i"), F.col("l_suppkey")
    cohort = (F.when(ds != "sisfall", "_").when(F.col("s_acctbal") < 4500, "_older")
              .otherwise("_young"))
    spike = F.when(F.col("l_partkey") % 97 == 0, 40.0).otherwise(0.0)

    def gyro(value, scale):
        return F.when(ds == "unimib_shar", None).otherwise(value.cast("double") / scale)

    turn = (F.floor(i / 75) + supp) % 6
    label = (F.when(turn == 0, "standing").when(turn == 1, "walking").when(turn == 2, "running")
             .when(turn == 3, "sitting").when(turn == 4, "lying").otherwise("falling"))
    position = (F.when(supp % 3 == 0, "waist_belt").when(supp % 3 == 1, "wrist")
                .otherwise("trouser_right_pocket"))
    return rows.select(
        "dataset_id",
        F.concat(ds, cohort, supp.cast("string")).alias("subject_id"),
        F.concat(ds, F.lit("_"), supp.cast("string"), F.lit("_r"),
                 F.floor(i / 500).cast("string")).alias("recording_id"),
        (F.lit(1600000000000) + i * 20 + F.floor(i / 250) * 1000).cast("long").alias("timestamp"),
        ((F.col("l_quantity") - 25.5) / 2.0 + spike).alias("ax"),
        ((F.col("l_discount") - 0.05) * 100).alias("ay"),
        (F.lit(9.8) + (F.col("l_tax") - 0.04) * 100).alias("az"),
        gyro(F.col("l_partkey") % 100 - 50, 25).alias("gx"),
        gyro(F.col("l_orderkey") % 100 - 50, 40).alias("gy"),
        gyro(F.col("l_linenumber") - 4, 3).alias("gz"),
        label.alias("label"),
        position.alias("phone_position"),
    )


def clean_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sensor view with the gyroscope flag set and out-of-range rows removed."""
    return drop_out_of_range(add_gyro_flag(sensor_view(spark, sf_dir)))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned samples with segment and position.

    A recording of this view holds at most 500 rows by construction, so it is not sliced.
    """
    return add_segments(clean_samples(spark, sf_dir), slice_ms=None)


def windows(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return collect_windows(segments(spark, sf_dir), **options)
