"""Readers of the recording formats. ``read_*`` opens files, ``*_rows`` parses their lines."""

import warnings
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaitframe.functions import columns as C
from gaitframe.operators import cleaning as K
from gaitframe.operators.ordered import add_segments, ordered_position
from gaitframe.operators.registry import map_labels, own_label
from gaitframe.schema import ACC, BASE_TIMESTAMP_MS, SAMPLE_MS, SENSORS, TARGET_HZ
from gaitframe.session import materialize
from gaitframe.sources import lines as L

# Accepted column names per channel.
SESSION_COLUMNS = {"timestamp": ["timestamp", "timestamp_ms"], **{c: [c] for c in SENSORS}, "label": ["label"]}
AXIS_NAMES = {
    "ax": ["acc_x", "accel_x", "ax", "accelerometerx"], "ay": ["acc_y", "accel_y", "ay", "accelerometery"],
    "az": ["acc_z", "accel_z", "az", "accelerometerz"], "gx": ["gyro_x", "gyr_x", "gx", "gyroscopex"],
    "gy": ["gyro_y", "gyr_y", "gy", "gyroscopey"], "gz": ["gyro_z", "gyr_z", "gz", "gyroscopez"],
}
TIMED_AXIS_NAMES = {"timestamp": ["timestamp", "time", "ts"], **AXIS_NAMES}
FILE_KEY = ["file_path"]


def _channels():
    return [L.number(c).alias(c) for c in SENSORS]


def _clock():
    return L.field("timestamp").try_cast("double").cast("long")


def _on_target_clock(rows: DataFrame, rate_hz: int, average: bool = False) -> DataFrame:
    """Lines of a file numbered once: synthetic clock, then the target rate (runs a job).

    The parsed rows are written, as numbering reads them twice and would else parse every line again.
    """
    nth, every = F.col("_nth"), rate_hz // TARGET_HZ
    rows = materialize(rows, "parsed", compression="zstd")
    rows = ordered_position(rows, FILE_KEY, L.LINE_ORDER, F.col("block_start"), out="_nth")
    rows = rows.withColumn("timestamp", (F.lit(BASE_TIMESTAMP_MS) + nth * (1000 // rate_hz)).cast("long"))
    return (K.average_runs(rows, every, FILE_KEY) if average else rows.filter(nth % every == 0)).drop("_nth")


def _session_names(files: DataFrame) -> DataFrame:
    return files.withColumns({"subject_id": L.stem_part(0, "unknown"), "recording_id": L.stem()})


def session_rows(lines: DataFrame, segments: bool = True, bounded: bool = False) -> DataFrame:
    """Cleaned samples of session CSV lines: bounds, labels, missing values and pauses handled.

    The subject is the file stem before its first underscore, the recording is the file.
    ``bounded=True`` says that a file holds few enough rows to be ordered in one piece.
    """
    rows = L.usable(L.with_header(lines, SESSION_COLUMNS, describe=_session_names)).select(
        "subject_id", "recording_id",
        L.computed_once(_clock().alias("timestamp"), *_channels(), L.field("label").alias("label")))
    rows = K.drop_missing(K.drop_out_of_range(K.clean_labels(rows)), [*SENSORS, "timestamp"])
    return add_segments(rows, slice_ms=None) if segments and bounded else add_segments(rows) if segments else rows


def read_sessions(spark: SparkSession, path: str, **options) -> DataFrame:
    return session_rows(L.read_lines(spark, path), **options)


def read_session(spark: SparkSession, path: str) -> DataFrame:
    """One session file."""
    return read_sessions(spark, path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Archived fall windows, newest file first; ``timestamp_ms`` is read as ``timestamp``.

    The rows have the session layout plus ``impact_peak`` and ``modified``, so they can be added
    to the training recordings.
    """
    rows = L.usable(L.with_header(L.read_lines(spark, path), {**SESSION_COLUMNS, "impact_peak": ["impact_peak"]}, describe=_session_names),
                    optional=["impact_peak"]).select(
        "subject_id", "recording_id", L.computed_once(
            _clock().alias("timestamp"), *_channels(), L.field("label").alias("label"), L.number("impact_peak").alias("impact_peak")),
        "modified")
    return rows.orderBy(F.desc("modified"), "recording_id", "timestamp")


def own_rows(lines: DataFrame) -> DataFrame:
    """Own recordings: ``<subject>_<session>[_<position>[_<orientation>]]`` in the file stem."""
    def names(files: DataFrame) -> DataFrame:
        subject, session = L.stem_part(0, "unknown"), L.stem_part(1, "s01")
        return files.withColumns({
            "subject_id": F.concat(F.lit("own_"), subject), "recording_id": F.concat(F.lit("own_"), subject, F.lit("_"), session),
            "phone_position": L.stem_part(2, "unknown")})

    rows = L.usable(L.with_header(lines, SESSION_COLUMNS, describe=names))
    return K.conform(rows.select(
        F.lit("own").alias("dataset_id"), "subject_id", "recording_id", _clock().alias("timestamp"), *_channels(),
        F.lower(L.field("label")).alias("original_label"), own_label(L.field("label")).alias("unified_label"),
        "phone_position", F.lit(0).alias("segment")))


def read_own(spark: SparkSession, path: str) -> DataFrame:
    return own_rows(L.read_lines(spark, f"{path}/*.csv"))


def mobiact_rows(lines: DataFrame, average: bool = False) -> DataFrame:
    """Per-label folders, 200 Hz, gyroscope in deg/s; folders with an unknown label are skipped."""
    def names(files: DataFrame) -> DataFrame:
        files = files.withColumns({"dataset_id": F.lit("mobiact"), "original_label": F.upper(L.parent())})
        subject = F.concat(F.lit("mobiact_"), F.format_string("%03d", L.stem_part(1, "00").cast("int")))
        return map_labels(files).filter(F.col("unified_label") != "unknown").withColumns({
            "subject_id": subject, "recording_id": F.concat_ws("_", subject, "original_label", L.stem_part(2, "1"))})

    rows = L.usable(L.with_header(lines, TIMED_AXIS_NAMES, "#", names), optional=["timestamp"]).select(
        "file_path", *L.LINE_ORDER, "dataset_id", "original_label", "unified_label", "subject_id", "recording_id",
        F.col("_at_timestamp").isNotNull().alias("_timed"), L.computed_once(_clock().alias("_clock"), *_channels()))
    rows = K.to_si(rows, gyr_unit="deg/s")
    rows = _on_target_clock(rows, 200, average)
    rows = rows.withColumn("timestamp", F.when(F.col("_timed"), F.col("_clock")).otherwise(F.col("timestamp")))
    return K.conform(rows.withColumns({"phone_position": F.lit("trouser_right_pocket"), "segment": F.lit(0)}))


def read_mobiact(spark: SparkSession, path: str) -> DataFrame:
    return mobiact_rows(L.read_lines(spark, f"{path}/MobiAct/*/*.csv"))


def sisfall_rows(lines: DataFrame, max_recordings: int | None = None, scheme: str = "nine") -> DataFrame:
    """Headerless ADC text with a trailing semicolon, 200 Hz; the folder tells the cohort."""
    def names(files: DataFrame) -> DataFrame:
        code = F.regexp_extract(L.stem(), "^([A-Z][0-9]+)", 1)
        trial = F.coalesce(F.nullif(F.regexp_extract(L.stem(), "[Rn]([0-9]+)", 1), F.lit("")).cast("int"), F.lit(0))
        cohort = F.when(F.upper(F.substring(L.parent(), 1, 2)) == "SA", "older").otherwise("young")
        number = F.format_string("%02d", F.regexp_extract(L.parent(), "([0-9]+)", 1).cast("int"))
        files = files.withColumns({
            "dataset_id": F.lit("sisfall"), "subject_id": F.concat(F.lit("sisfall_"), cohort, number),
            "original_label": F.when(code == "", "UNK").otherwise(code), "_trial": trial})
        return map_labels(files, scheme).withColumn("recording_id", F.concat_ws(
            "_", "subject_id", "original_label", F.concat(F.lit("r"), F.format_string("%02d", "_trial"))))

    if max_recordings is not None:
        files = lines.select("file_path", L.parent().alias("_folder")).distinct()
        nth = F.row_number().over(Window.partitionBy("_folder").orderBy("file_path"))
        lines = lines.join(files.withColumn("_n", nth).filter(F.col("_n") <= max_recordings).select("file_path"), "file_path", "left_semi")
    values = F.transform(F.split(F.rtrim(F.trim("value"), F.lit(";")), ","), lambda v: F.trim(v).try_cast("double"))
    rows = L.with_file_columns(lines, names).select("*", L.computed_once(values.alias("_v")))
    rows = rows.filter(F.size("_v") >= len(SENSORS)).select("*", *[F.get("_v", F.lit(i)).alias(c) for i, c in enumerate(SENSORS)])
    rows = K.to_si(rows, "adc", "adc")
    rows = _on_target_clock(rows, 200)
    return K.conform(rows.withColumns({"phone_position": F.lit("waist_belt"), "segment": F.lit(0)}))


def read_sisfall(spark: SparkSession, path: str, max_recordings: int | None = None) -> DataFrame:
    """The folder ``SisFall_dataset`` below ``path`` if there is one, else ``SisFall``."""
    try:
        found = L.read_lines(spark, f"{path}/SisFall_dataset/S*/*.txt")
    except AnalysisException:
        found = L.read_lines(spark, f"{path}/SisFall/S*/*.txt")
    return sisfall_rows(found, max_recordings)


def kfall_rows(lines: DataFrame) -> DataFrame:
    """Two positions per trial, 100 Hz, SI units: ``<subject>_<activity>_<trial>_<position>``."""
    def names(files: DataFrame) -> DataFrame:
        subject = F.concat(F.lit("kfall_"), F.format_string("%02d", F.regexp_extract(L.parent(), "S([0-9]+)", 1).cast("int")))
        code, position = L.stem_part(1, "UNK"), L.stem_part(3, "unknown")
        return map_labels(files.withColumns({
            "dataset_id": F.lit("kfall"), "subject_id": subject, "original_label": code, "phone_position": C.phone_position(position),
            "recording_id": F.concat_ws("_", subject, code, L.stem_part(2, "T01"), position)}))

    rows = L.usable(L.with_header(lines, AXIS_NAMES, describe=names)).select(
        "file_path", *L.LINE_ORDER, "dataset_id", "subject_id", "recording_id", "original_label", "unified_label", "phone_position",
        L.computed_once(*_channels()))
    rows = _on_target_clock(rows, 100)
    return K.conform(rows.withColumn("segment", F.lit(0)))


def read_kfall(spark: SparkSession, path: str) -> DataFrame:
    return kfall_rows(L.read_lines(spark, f"{path}/KFall/KFall_dataset/S*/*.csv"))


# Fixed value: the clock step between two pre-cut windows counts 453 values, not samples.
PRECUT_VALUES = 453


def unimib_rows(windows: DataFrame, names: DataFrame) -> DataFrame:
    """Pre-cut windows (kind, w, values, class_index, subject) as samples without gyroscope.

    ``values`` interleaves ax, ay, az; ``names`` maps (kind, class_index from 1) to a label and has
    one row per class.
    """
    named = windows.join(names.select("kind", "class_index", "name"), ["kind", "class_index"], "left")
    n = F.floor(F.size("values") / 3)
    triples = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(*[
        F.get("values", (i * 3 + j).cast("int")).cast("double").alias(c) for j, c in enumerate(ACC)]))
    rows = named.select("*", F.posexplode(triples).alias("_i", "_s"))
    subject = F.concat(F.lit("unimib_"), F.format_string("%02d", F.col("subject").cast("int")))
    rows = rows.select(
        F.lit("unimib_shar").alias("dataset_id"), subject.alias("subject_id"),
        F.concat(subject, F.lit("_"), "kind", F.lit("_"), F.format_string("%04d", F.col("w").cast("long"))).alias("recording_id"),
        (F.lit(BASE_TIMESTAMP_MS) + F.col("w") * PRECUT_VALUES * SAMPLE_MS + F.col("_i") * SAMPLE_MS).cast("long").alias("timestamp"),
        "_s.*", F.coalesce("name", F.lit("unknown")).alias("original_label"),
        F.lit("trouser_front_pocket").alias("phone_position"), F.col("w").cast("int").alias("segment"))
    return K.conform(map_labels(rows))


def read_unimib(spark: SparkSession, path: str) -> DataFrame:
    """``windows`` and ``names`` as Parquet below ``path``."""
    return unimib_rows(spark.read.parquet(f"{path}/windows"), spark.read.parquet(f"{path}/names"))


def harmonize(sources: dict[str, DataFrame | Callable[[], DataFrame]]) -> tuple[DataFrame, dict[str, str]]:
    """One canonical frame from the sources that are there, and why the others are not.

    A source given as a function is opened here; a missing path is listed, not raised, and so is every
    file of it that can't be decoded. With no source left it is an error.
    """
    merged, skipped = None, {}
    for name, source in sources.items():
        try:
            with warnings.catch_warnings(record=True) as said:
                warnings.simplefilter("always", L.UnreadableFile)
                df = source() if callable(source) else source
            for w in said:
                if isinstance(w.message, L.UnreadableFile):
                    skipped[w.message.path] = f"{name}: {w.message.reason}"
                warnings.warn(w.message, stacklevel=2)
            df = K.coerce_numeric(K.coerce_numeric(K.conform(df), SENSORS), ["timestamp"], "long")
        except (AnalysisException, OSError, ValueError) as problem:
            skipped[name] = str(problem).splitlines()[0]
            continue
        df = K.drop_missing(df, [*ACC, "timestamp"])
        merged = df if merged is None else merged.unionByName(df, allowMissingColumns=True)
    if merged is None:
        raise RuntimeError(f"no source could be read: {skipped}")
    return K.keep_trainable(K.add_age_group(K.add_gyro_flag(merged))), skipped

