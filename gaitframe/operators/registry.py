"""Dataset registry and label taxonomy as small lookup tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaitframe.schema import TARGET_HZ

# The unified labels.
UNIFIED_LABELS = ["standing", "walking", "running", "sitting", "lying", "stairs_up", "stairs_down", "transition", "falling", "unknown"]

# Other names of the unified labels.
LABEL_ALIASES = {
    "fall": "falling",
    "fall_forward": "falling",
    "fall_backward": "falling",
    "fall_left": "falling",
    "fall_right": "falling",
    "fall_lateral": "falling",
    "stumble": "falling",
    "walk": "walking",
    "slow_walk": "walking",
    "fast_walk": "walking",
    "jog": "running",
    "run": "running",
    "sit": "sitting",
    "sit_chair": "sitting",
    "sit_floor": "sitting",
    "lay": "lying",
    "lie": "lying",
    "lie_down": "lying",
    "stand": "standing",
    "stand_up": "transition",
    "sit_down": "transition",
    "stair_up": "stairs_up",
    "upstairs": "stairs_up",
    "stair_down": "stairs_down",
    "downstairs": "stairs_down",
}

# The label codes of every known source (dataset, code, meaning, unified label).
SOURCE_LABELS = [
    ("unimib_shar", "FKL", "Fall forward while walking", "falling"),
    ("unimib_shar", "BSC", "Fall backwards while sitting on chair", "falling"),
    ("unimib_shar", "SDL", "Fall forward while sitting in a lateral position", "falling"),
    ("unimib_shar", "LFW", "Fall forward while walking, lateral", "falling"),
    ("unimib_shar", "FOL", "Fall forward from standing", "falling"),
    ("unimib_shar", "BFAR", "Fall backward from a reclining position", "falling"),
    ("unimib_shar", "BARD", "Fall backward while running", "falling"),
    ("unimib_shar", "FPSA", "Fall forward from sitting, arms out", "falling"),
    ("unimib_shar", "SBW", "Stumble backward while walking", "falling"),
    ("unimib_shar", "StdUP", "Standing up from sitting", "transition"),
    ("unimib_shar", "SitDN", "Sitting down", "transition"),
    ("unimib_shar", "GPK", "Getting in/out of car", "transition"),
    ("unimib_shar", "WAL", "Walking", "walking"),
    ("unimib_shar", "JOG", "Jogging", "running"),
    ("unimib_shar", "JUM", "Jumping", "running"),
    ("unimib_shar", "SCH", "Going up/down stairs", "stairs_up"),
    ("unimib_shar", "STD", "Standing still", "standing"),
    ("unimib_shar", "LIE", "Lying down", "lying"),
    ("mobiact", "STD", "Standing", "standing"),
    ("mobiact", "WAL", "Walking", "walking"),
    ("mobiact", "JOG", "Jogging", "running"),
    ("mobiact", "JUM", "Jumping", "running"),
    ("mobiact", "STU", "Going up stairs", "stairs_up"),
    ("mobiact", "STN", "Going down stairs", "stairs_down"),
    ("mobiact", "SCH", "Sit on chair", "sitting"),
    ("mobiact", "CSI", "Car step in", "transition"),
    ("mobiact", "CSO", "Car step out", "transition"),
    ("mobiact", "LYI", "Lying down", "lying"),
    ("mobiact", "FOL", "Forward fall", "falling"),
    ("mobiact", "FKL", "Fall while walking", "falling"),
    ("mobiact", "BSC", "Fall backward", "falling"),
    ("mobiact", "SDL", "Fall with lateral roll", "falling"),
    ("mobiact", "SFW", "Stumble forward while walking", "falling"),
    ("mobiact", "SBW", "Stumble backward while walking", "falling"),
    ("sisfall", "D01", "Walking slowly", "walking"),
    ("sisfall", "D02", "Walking at normal speed", "walking"),
    ("sisfall", "D03", "Walking quickly", "walking"),
    ("sisfall", "D04", "Jogging slowly", "running"),
    ("sisfall", "D05", "Jogging quickly", "running"),
    ("sisfall", "D06", "Walking upstairs slowly", "stairs_up"),
    ("sisfall", "D07", "Walking upstairs quickly", "stairs_up"),
    ("sisfall", "D08", "Walking downstairs slowly", "stairs_down"),
    ("sisfall", "D09", "Walking downstairs quickly", "stairs_down"),
    ("sisfall", "D10", "Standing up from sitting on a bed", "transition"),
    ("sisfall", "D11", "Sitting on a bed", "lying"),
    ("sisfall", "D12", "Sitting on a chair", "sitting"),
    ("sisfall", "D13", "Sitting in a car", "sitting"),
    ("sisfall", "D14", "Getting up from a chair", "transition"),
    ("sisfall", "D15", "Getting out of a car", "transition"),
    ("sisfall", "D16", "Bending over to pick up an object", "transition"),
    ("sisfall", "D17", "Drinking water", "standing"),
    ("sisfall", "D18", "Combing hair", "standing"),
    ("sisfall", "D19", "Lying down on a bed", "lying"),
    ("sisfall", "F01", "Fall forward while walking", "falling"),
    ("sisfall", "F02", "Fall backward while walking", "falling"),
    ("sisfall", "F03", "Fall, right lateral while walking", "falling"),
    ("sisfall", "F04", "Fall, left lateral while walking", "falling"),
    ("sisfall", "F05", "Fall forward while standing", "falling"),
    ("sisfall", "F06", "Fall backward while standing", "falling"),
    ("sisfall", "F07", "Fall, right lateral while standing", "falling"),
    ("sisfall", "F08", "Fall, left lateral while standing", "falling"),
    ("sisfall", "F09", "Fall, sitting and hitting table", "falling"),
    ("sisfall", "F10", "Fall from sitting to floor, forward", "falling"),
    ("sisfall", "F11", "Fall from sitting to floor, lateral", "falling"),
    ("sisfall", "F12", "Fall backward with chair", "falling"),
    ("sisfall", "F13", "Stumble forward", "falling"),
    ("sisfall", "F14", "Fall on both knees", "falling"),
    ("sisfall", "F15", "Fall forward, hitting table while walking", "falling"),
    ("kfall", "ADL01", "Standing still", "standing"),
    ("kfall", "ADL02", "Sitting on a chair", "sitting"),
    ("kfall", "ADL03", "Walking", "walking"),
    ("kfall", "ADL04", "Jogging", "running"),
    ("kfall", "ADL05", "Going upstairs", "stairs_up"),
    ("kfall", "ADL06", "Going downstairs", "stairs_down"),
    ("kfall", "ADL07", "Lying down", "lying"),
    ("kfall", "ADL08", "Sit-to-stand", "transition"),
    ("kfall", "ADL09", "Stand-to-sit", "transition"),
    ("kfall", "ADL10", "Lying-to-sitting", "transition"),
    ("kfall", "FALL01", "Forward fall", "falling"),
    ("kfall", "FALL02", "Backward fall", "falling"),
    ("kfall", "FALL03", "Left lateral fall", "falling"),
    ("kfall", "FALL04", "Right lateral fall", "falling"),
    ("kfall", "FALL05", "Stumble forward", "falling"),
    ("kfall", "FALL06", "Stumble backward", "falling"),
]

# Two coarser readings of the sisfall codes, as changes to the first mapping.
SISFALL_SCHEMES = {
    "nine": {},
    "six": {"D10": "standing", "D14": "standing", "D15": "standing", "D16": "standing"},
    "six_stairs_walking": {
        "D10": "standing", "D14": "standing", "D15": "standing", "D16": "standing",
        "D06": "walking", "D07": "walking", "D08": "walking", "D09": "walking"},
}

# One row per public source.
REGISTRY_COLUMNS = (
    "dataset_id string, full_name string, year int, n_subjects int, min_age int, max_age int, "
    "gender_notes string, n_recordings int, total_duration_minutes double, sampling_rate_hz int, "
    "acc_unit string, gyr_unit string, acc_range_g double, gyr_range_dps double, "
    "has_gyroscope boolean, axis_remap string, phone_positions array<string>, license string")
REGISTRY_ROWS = [
    ("unimib_shar", "UniMiB SHAR", 2017, 30, 18,
     60, "f 18, m 12", 11771, 180.0, 50, "m/s2", "n/a", 2.0, 0.0, False, "identity",
     ["trouser_front_pocket"],
     "research only; Micucci et al. 2017"),
    ("mobiact", "MobiAct, second release", 2016, 57, 20, 47,
     "f 21, m 36", 3184, 600.0, 200, "m/s2", "deg/s", 16.0, 2000.0, True, "identity",
     ["trouser_right_pocket"], "research only; Vavoulas et al. 2016"),
    ("sisfall", "SisFall", 2017, 38, 19, 75,
     "young (19-30) 15, older (60-75) 23", 4505, 420.0, 200, "g",
     "deg/s", 16.0, 2000.0, True, "identity", ["waist_belt"],
     "research only; Sucerquia et al. 2017"),
    ("kfall", "KFall", 2021, 36, 18, 70,
     "mixed ages", 2160, 360.0, 100, "m/s2", "rad/s", 8.0, 573.0, True,
     "identity", ["waist", "wrist"],
     "CC BY 4.0"),
]
KNOWN_DATASETS = [r[0] for r in REGISTRY_ROWS]


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REGISTRY_ROWS, REGISTRY_COLUMNS)


def get_dataset(spark: SparkSession, dataset_id: str) -> DataFrame:
    if dataset_id not in KNOWN_DATASETS:
        raise KeyError(f"unknown dataset {dataset_id!r}; known: {KNOWN_DATASETS}")
    return registry(spark).filter(F.col("dataset_id") == dataset_id)


def label_mapping(spark: SparkSession, scheme: str = "nine") -> DataFrame:
    """One row per (dataset, source code): description and unified label.

    ``scheme`` names the reading of the sisfall codes: ``nine`` classes, ``six`` (posture changes
    count as standing) or ``six_stairs_walking`` (stairs count as walking as well).
    """
    changes = SISFALL_SCHEMES[scheme]
    rows = [
        (ds, code, text, changes.get(code, label) if ds == "sisfall" else label)
        for ds, code, text, label in SOURCE_LABELS
    ]
    return spark.createDataFrame(
        rows, "dataset_id string, original_label string, description string, unified_label string")


def alias_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LABEL_ALIASES.items()), "alias string, alias_label string")


def map_labels(df: DataFrame, scheme: str = "nine", dataset: str = "dataset_id",
               original: str = "original_label", out: str = "unified_label") -> DataFrame:
    """Label lookup: the dataset's own code, then the alias (trimmed, lower case), then unknown.

    Both lookups are constants of this module (91 and 25 rows), so they are broadcast.
    """
    spark = df.sparkSession
    codes = label_mapping(spark, scheme).select(
        F.col("dataset_id").alias("_ds"), F.col("original_label").alias("_code"),
        F.col("unified_label").alias("_mapped"))
    names = alias_table(spark)
    return (
        df.join(F.broadcast(codes), (F.col(dataset) == F.col("_ds")) & (F.col(original) == F.col("_code")), "left")
        .join(F.broadcast(names), F.lower(F.trim(F.col(original))) == F.col("alias"), "left")
        .withColumn(out, F.coalesce("_mapped", "alias_label", F.lit("unknown")))
        .drop("_ds", "_code", "_mapped", "alias", "alias_label"))


def own_label(label):
    """Label of an own recording: a unified name stays, an alias is replaced, else unknown."""
    text = F.lower(F.trim(label))
    aliases = F.create_map(*[F.lit(x) for pair in LABEL_ALIASES.items() for x in pair])
    return F.when(text.isin(UNIFIED_LABELS), text).otherwise(
        F.coalesce(F.try_element_at(aliases, text), F.lit("unknown")))


def sampling_rates(spark: SparkSession) -> DataFrame:
    return registry(spark).select(
        "dataset_id", "sampling_rate_hz",
        (F.col("sampling_rate_hz") != TARGET_HZ).alias("needs_resampling"))
