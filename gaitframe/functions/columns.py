"""Column expressions: magnitudes, conversions, angles, text and time formats."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaitframe.schema import ACC, FALL, GYR, SENSORS


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def magnitude(*channels: Column | str) -> Column:
    """Signal vector magnitude of the given channels."""
    total = None
    for c in channels:
        square = col(c) * col(c)
        total = square if total is None else total + square
    return F.sqrt(total)


def acc_magnitude() -> Column:
    return magnitude(*ACC)


def gyr_magnitude() -> Column:
    return magnitude(*GYR)


def resultant() -> Column:
    return magnitude(*SENSORS)


def unit_vector(x: Column, y: Column, z: Column) -> Column:
    """Unit vector as a struct; straight up when the vector is shorter than 0.001."""
    norm = F.sqrt(x * x + y * y + z * z)
    weak = norm <= 0.001
    return F.struct(
        F.when(weak, 0.0).otherwise(x / norm).alias("x"),
        F.when(weak, 1.0).otherwise(y / norm).alias("y"),
        F.when(weak, 0.0).otherwise(z / norm).alias("z"))


def tilt_degrees(u: Column, v: Column) -> Column:
    """Angle between two unit vectors (structs x, y, z), safe against rounding beyond 1."""
    dot = u["x"] * v["x"] + u["y"] * v["y"] + u["z"] * v["z"]
    return F.degrees(F.acos(F.greatest(F.least(dot, F.lit(1.0)), F.lit(-1.0))))


def softmax(logits: Column | str) -> Column:
    """Probabilities of an array of logits, the maximum subtracted first; uniform if all vanish."""
    x = col(logits)
    top = F.array_max(x)
    e = F.transform(x, lambda v: F.exp(v - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
    return F.when(total > 0, F.transform(e, lambda v: v / total)).otherwise(
        F.transform(x, lambda v: F.lit(1.0) / F.size(x)))


def arg_max(values: Column | str, names: Column) -> Column:
    """Name at the first position of the largest value."""
    v = col(values)
    return F.element_at(names, F.array_position(v, F.array_max(v)).cast("int"))


# Full-scale ranges and gravity of the ADC recordings.
ADC_ACC_SCALE = ((2.0 * 16.0) / 2**13) * 9.80665
ADC_GYR_SCALE = ((2.0 * 2000.0) / 2**16) * (math.pi / 180.0)
STANDARD_GRAVITY = 9.80665


def from_adc(c: Column | str, scale: float) -> Column:
    return col(c) * F.lit(scale)


def deg_to_rad(c: Column | str) -> Column:
    return col(c) * F.lit(math.pi / 180.0)


def g_to_si(c: Column | str) -> Column:
    return col(c) * F.lit(STANDARD_GRAVITY)


def age_group(subject: Column | str) -> Column:
    """Cohort from the subject id; only the prefix before the first digit run counts."""
    s = F.lower(col(subject))
    return (F.when(s.contains("older") | s.rlike("^(sisfall_)?sa[0-9]"), "older_adult")
            .when(s.contains("young") | s.rlike("^(sisfall_)?se[0-9]"), "young_adult")
            .when(s.rlike("^own"), "unknown").otherwise("adult"))


def phone_position(raw: Column | str) -> Column:
    p = F.lower(F.trim(col(raw)))
    return F.when(p.contains("waist"), "waist_belt").when(p.contains("wrist"), "wrist").otherwise(p)


def resting_posture(ay: Column, az: Column) -> Column:
    """Posture of a device at rest from the gravity axis."""
    return (F.when(F.abs(az) > 7.0, "lying").when(F.abs(ay) > 6.0, "standing").otherwise("sitting"))


def relative_age(ts_ms: Column | str, now_ms: Column) -> Column:
    minutes = F.floor((now_ms - col(ts_ms)) / 60_000)
    hours, days = F.floor(minutes / 60), F.floor(minutes / 1440)
    return (F.when(minutes < 1, "Just now")
            .when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min ago")))
            .when(hours < 24, F.concat(hours.cast("string"), F.lit(" hr ago")))
            .when(days == 1, "Yesterday")
            .otherwise(F.concat(days.cast("string"), F.lit(" days ago"))))


def maps_url(lat: Column | str, lon: Column | str) -> Column:
    """Map link, NULL when either coordinate is missing."""
    return F.concat(F.lit("https://maps.google.com/?q="), col(lat).cast("string"), F.lit(","),
                    col(lon).cast("string"))


def sos_body(ts_ms: Column | str, lat: Column | str, lon: Column | str, sender: str = "motion monitor") -> Column:
    """Text of the emergency message; ``sender`` names the application that detected the fall."""
    clock = F.date_format(F.timestamp_millis(col(ts_ms)), "HH:mm:ss dd-MMM")
    place = F.coalesce(maps_url(lat, lon), F.lit("Location unavailable"))
    return F.concat(
        F.lit(f"EMERGENCY SOS: Fall detected by {sender}! User did not respond to check-in. Time: "),
        clock, F.lit(". Location: "), place, F.lit(". Please call or assist immediately!"))


def clock_mm_ss(seconds: Column) -> Column:
    s = seconds.cast("long")
    return F.format_string("%02d:%02d", F.floor(s / 60), s % 60)


def is_fall(label: Column | str) -> Column:
    return col(label) == FALL
