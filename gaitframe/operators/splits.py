"""Leak-free splits by subject.

Subjects are shuffled by the digest of (seed, subject), so a split is the same on every run and
cluster. Ranks come from :func:`ordered_position` over digest slices: no dataset's subjects are
gathered in one task.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaitframe.operators.ordered import digest_slice, ordered_position

OWN_DATASET = "own"


def shuffle_digest(seed: int, *cols: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def subjects(df: DataFrame) -> DataFrame:
    """One row per subject with its dataset."""
    return df.groupBy("subject_id").agg(F.min("dataset_id").alias("dataset_id"))


def shuffled_rank(df: DataFrame, keys: list[str], seed: int, *cols: str) -> DataFrame:
    """``rank``: 0-based place of the row in the seeded shuffle of its key."""
    rows = df.withColumn("_digest", shuffle_digest(seed, *cols))
    return ordered_position(rows, keys, ["_digest", *cols], digest_slice(F.col("_digest")), out="rank").drop("_digest")


def subject_split(df: DataFrame, test_frac: float = 0.20, val_frac: float = 0.15, seed: int = 42) -> DataFrame:
    """(subject_id, dataset_id, split) with train, validation and test drawn inside each dataset.

    A dataset too small for all three gives one subject to test and the rest to train.
    """
    who = subjects(df)
    sizes = who.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.withColumn("n_test", F.greatest(F.lit(1), F.bround(F.col("n") * test_frac).cast("long")))
    sizes = sizes.withColumn(
        "n_val", F.greatest(F.lit(1), F.bround((F.col("n") - F.col("n_test")) * val_frac).cast("long")))
    tiny = F.col("n") - F.col("n_test") - F.col("n_val") < 1
    sizes = sizes.select("dataset_id", F.when(tiny, 1).otherwise(F.col("n_test")).alias("n_test"),
                         F.when(tiny, 0).otherwise(F.col("n_val")).alias("n_val"))
    rank = F.col("rank")
    split = (F.when(rank < F.col("n_test"), "test")
             .when(rank < F.col("n_test") + F.col("n_val"), "validation").otherwise("train"))
    return (shuffled_rank(who, ["dataset_id"], seed, "subject_id").join(sizes, "dataset_id")
            .select("subject_id", "dataset_id", split.alias("split")))


def apply_split(df: DataFrame, split: DataFrame) -> DataFrame:
    return df.join(split.select("subject_id", "split"), "subject_id")


def in_split(df: DataFrame, split: DataFrame, name: str) -> DataFrame:
    """Rows whose subject is in the named part (semi join)."""
    return df.join(split.filter(F.col("split") == name), "subject_id", "left_semi")


def not_in_split(df: DataFrame, split: DataFrame, name: str) -> DataFrame:
    return df.join(split.filter(F.col("split") == name), "subject_id", "left_anti")


def holdout_split(df: DataFrame, held_out: Column, val_frac: float = 0.15, seed: int = 42) -> DataFrame:
    """Held-out subjects to test, ``max(1, floor(val_frac * others))`` others to validation."""
    who = subjects(df)
    rest = who.filter(~held_out)
    n_val = rest.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * val_frac))).scalar()
    parts = shuffled_rank(rest, [], seed, "subject_id").select(
        "subject_id", "dataset_id",
        F.when(F.col("rank") < n_val, "validation").otherwise("train").alias("split"))
    return parts.unionByName(who.filter(held_out).withColumn("split", F.lit("test")))


def experiment(df: DataFrame, name: str, test_dataset: str | None = None, split: DataFrame | None = None,
               seed: int = 42) -> DataFrame:
    """``df`` with its ``split``: A by the manifest, B one dataset held out, C own recordings held out."""
    if name == "A":
        return apply_split(df, subject_split(df, seed=seed) if split is None else split)
    if name == "B" and test_dataset is None:
        raise ValueError("experiment B needs test_dataset")
    if name not in ("B", "C"):
        raise ValueError(f"unknown experiment {name!r}")
    held = test_dataset if name == "B" else OWN_DATASET
    return apply_split(df, holdout_split(df, F.col("dataset_id") == held, seed=seed))


def cohort_split(df: DataFrame) -> DataFrame:
    """Young subjects to train, older ones to test; others are left out."""
    split = F.when(F.col("age_group") == "young_adult", "train").when(F.col("age_group") == "older_adult", "test")
    return df.withColumn("split", split).filter(F.col("split").isNotNull())


def group_shuffle(df: DataFrame, frac: float = 0.2, seed: int = 42, group: str = "subject_id") -> DataFrame:
    """(group, split): ``ceil(frac * groups)`` groups to test."""
    groups = df.select(group).distinct()
    n_test = groups.agg(F.ceil(F.count(F.lit(1)) * frac)).scalar()
    return shuffled_rank(groups, [], seed, group).select(
        group, F.when(F.col("rank") < n_test, "test").otherwise("train").alias("split"))


def fold_schedule(sizes: list[tuple[int, int]], k: int) -> list[tuple[int, int, int, list[int]]]:
    """Folds of equal-sized groups as repeating patterns.

    ``sizes`` lists (group size, number of groups), largest first. Putting the next group into the
    lightest fold repeats: every fold lighter than ``lightest + size`` gets one group, in order of
    load. Each returned (size, start, end, folds) says that groups ``start`` to ``end - 1`` of that
    size take the folds in turn. There are at most ``k`` entries per size, however many groups.
    """
    loads, out = [0] * k, []
    for size, groups in sizes:
        done = 0
        while done < groups:
            lightest = min(loads)
            turn = sorted((f for f in range(k) if loads[f] < lightest + size), key=lambda f: (loads[f], f))
            others = [loads[f] for f in range(k) if f not in turn]
            rounds = (min(others) - lightest) // size if others else (groups - done) // len(turn) + 1
            count = min(max(rounds, 1) * len(turn), groups - done)
            out.append((size, done, done + count, turn))
            for i, f in enumerate(turn):
                loads[f] += size * (count // len(turn) + (i < count % len(turn)))
            done += count
    return out


def group_kfold(df: DataFrame, k: int = 5, group: str = "subject_id") -> DataFrame:
    """(group, n_rows, fold): largest group first, each into the lightest fold (runs a job).

    The driver sees the histogram of group sizes only. Distinct sizes add up to at most the
    number of rows, so a trillion rows have fewer than 1.5 million of them.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n_rows"))
    histogram = [(r["n_rows"], r["groups"]) for r in
                 sizes.groupBy("n_rows").agg(F.count(F.lit(1)).alias("groups")).orderBy(F.desc("n_rows")).collect()]
    k = min(k, sum(n for _, n in histogram))
    schema = T.StructType([T.StructField("n_rows", T.LongType()), T.StructField("start", T.LongType()),
                           T.StructField("end", T.LongType()), T.StructField("turn", T.ArrayType(T.IntegerType()))])
    schedule = df.sparkSession.createDataFrame(fold_schedule(histogram, k), schema)
    ranked = sizes.withColumn("_digest", F.md5(F.col(group)))
    ranked = ordered_position(ranked, ["n_rows"], ["_digest", group], digest_slice(F.col("_digest")), out="_nth")
    here = (F.col("_nth") >= F.col("start")) & (F.col("_nth") < F.col("end"))
    turn = ((F.col("_nth") - F.col("start")) % F.size("turn")).cast("int")
    return ranked.join(schedule, "n_rows").filter(here).select(group, "n_rows", F.get("turn", turn).alias("fold"))


def loso_folds(windows: DataFrame) -> DataFrame:
    """One fold per subject: its test windows and the windows of all others.

    No subject-by-window product is built; the training side is a difference of counts.
    """
    total = windows.agg(F.count(F.lit(1))).scalar()
    return windows.groupBy(F.col("subject_id").alias("fold")).agg(F.count(F.lit(1)).alias("n_test")).withColumn(
        "n_train", total - F.col("n_test"))


def loso_fold(windows: DataFrame, subject: str) -> DataFrame:
    return windows.withColumn("split", F.when(F.col("subject_id") == subject, "test").otherwise("train"))


def split_membership(split: DataFrame, key: str = "subject_id") -> DataFrame:
    """Number of parts every key appears in."""
    return split.groupBy(key).agg(F.countDistinct("split").alias("n_splits"))


def assert_no_leakage(split: DataFrame, key: str = "subject_id") -> DataFrame:
    """:func:`split_membership`, failing the job when a key is in more than one part."""
    leak = F.raise_error(F.concat(F.lit(f"leakage: {key} "), F.col(key).cast("string"), F.lit(" is in several splits")))
    return split_membership(split, key).withColumn(
        "n_splits", F.when(F.col("n_splits") > 1, leak.cast("long")).otherwise(F.col("n_splits")))
