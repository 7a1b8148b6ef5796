"""Column names and Spark schemas of the sample, alert and contact records."""

from pyspark.sql import types as T

# Channel order, canonical columns and label sets shared by every operator.
ACC = ["ax", "ay", "az"]
GYR = ["gx", "gy", "gz"]
SENSORS = ACC + GYR
CANONICAL_COLUMNS = [
    "dataset_id", "subject_id", "recording_id", "timestamp",
    "ax", "ay", "az", "gx", "gy", "gz",
    "original_label", "unified_label", "phone_position", "segment",
]
VALID_LABELS = ["falling", "lying", "running", "sitting", "standing", "walking"]
TRAINABLE_LABELS = [
    "standing", "walking", "running", "sitting", "lying",
    "falling", "stairs_up", "stairs_down", "transition",
]
FALL = "falling"
TARGET_HZ = 50
SAMPLE_MS = 20
BASE_TIMESTAMP_MS = 1_600_000_000_000
ACC_BOUND = 40.0
GYR_BOUND = 35.0
PAUSE_MS = 500
WINDOW_SIZE = 100
WINDOW_STEP = 50
MIN_PURITY = 0.6
ALERT_OUTCOMES = ["DISMISSED_SAFE", "SOS_DISPATCHED", "CANCELLED_EARLY"]

#: Rows of one recording are ordered in time slices of this length, so that a recording that
#: never ends is still spread over many tasks (an hour at 50 Hz is 180,000 rows).
SLICE_MS = 3_600_000

CANONICAL_SCHEMA = T.StructType(
    [
        T.StructField("dataset_id", T.StringType()),
        T.StructField("subject_id", T.StringType()),
        T.StructField("recording_id", T.StringType()),
        T.StructField("timestamp", T.LongType()),
        *[T.StructField(c, T.DoubleType()) for c in SENSORS],
        T.StructField("original_label", T.StringType()),
        T.StructField("unified_label", T.StringType()),
        T.StructField("phone_position", T.StringType()),
        T.StructField("segment", T.IntegerType()),
    ]
)

SESSION_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.LongType()),
        *[T.StructField(c, T.DoubleType()) for c in SENSORS],
        T.StructField("label", T.StringType()),
    ]
)

ALERT_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("outcome", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("impactForce", T.DoubleType()),
        T.StructField("tiltAngle", T.DoubleType()),
        T.StructField("confidencePct", T.IntegerType()),
        T.StructField("activityBeforeFall", T.StringType()),
    ]
)

CONTACT_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("phone", T.StringType()),
    ]
)
