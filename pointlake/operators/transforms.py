"""Point transforms: DataFrame in, DataFrame out, one projection each.

A transform reads all its inputs before it writes, so each is a single withColumns. Coordinates
are requantised at once: chains round at every step, so they must not be fused.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointlake.functions.columns import i8, nearest, single, u8, u16
from pointlake.schema import DEFAULT_SCALE

Transform = Callable[..., DataFrame]
TRANSFORMS: dict[str, Transform] = {}

#: Seconds of a GPS week, the shift of adjusted time, and its week at time zero.
WEEK_SECONDS = 604800
ADJUSTED_SHIFT = 1.0e9
ADJUSTED_WEEK = 1653.4391534391534391534391534392


def _set(name: str, make: Callable[..., dict[str, Column]]) -> None:
    TRANSFORMS[name] = lambda points, *args: points.withColumns(make(*args))


def _xyz(axis: str) -> Column:
    return DEFAULT_SCALE.real(axis)


def _raw(axis: str, value: Column) -> dict[str, Column]:
    return {f"{axis}i": DEFAULT_SCALE.raw(axis, value)}


def _real(name: str, make: Callable[..., dict[str, Column]]) -> None:
    """A transform of real coordinates, given by axis."""
    _set(name, lambda *a: {k: v for axis, value in make(*a).items() for k, v in _raw(axis, value).items()})


# --- coordinates
for _a in "xyz":
    _real(f"translate_{_a}", lambda d, a=_a: {a: _xyz(a) + d})
    _real(f"scale_{_a}", lambda s, a=_a: {a: _xyz(a) * s})
    _real(f"translate_then_scale_{_a}", lambda d, s, a=_a: {a: (_xyz(a) + d) * s})
    _set(f"translate_raw_{_a}", lambda k, a=_a: {f"{a}i": F.col(f"{a}i") + k})
_real("translate_xyz", lambda *d: {a: _xyz(a) + v for a, v in zip("xyz", d, strict=True)})
_real("scale_xyz", lambda *s: {a: _xyz(a) * v for a, v in zip("xyz", s, strict=True)})
_set("translate_raw_xyz", lambda *k: {f"{a}i": F.col(f"{a}i") + v for a, v in zip("xyz", k, strict=True)})


def _rotate(first: str, second: str) -> Callable[..., dict[str, Column]]:
    def make(degrees: float, first_centre: float, second_centre: float) -> dict[str, Column]:
        c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
        a, b = _xyz(first) - first_centre, _xyz(second) - second_centre
        return {first: a * c - b * s + first_centre, second: b * c + a * s + second_centre}

    return make


_real("rotate_xy", _rotate("x", "y"))
_real("rotate_xz", _rotate("x", "z"))


def _helmert(dx: float, dy: float, dz: float, rx: float, ry: float, rz: float, ppm: float) -> dict[str, Column]:
    rx, ry, rz = (math.radians(r / 3600) for r in (rx, ry, rz))
    m, (x, y, z) = 1 + 1e-6 * ppm, map(_xyz, "xyz")
    return {"x": m * (x - rz * y + ry * z) + dx, "y": m * (rz * x + y - rx * z) + dy, "z": m * (-ry * x + rx * y + z) + dz}


def _affine(r: float, w: float, tx: float, ty: float) -> dict[str, Column]:
    c, s, x, y = math.cos(math.radians(w / 3600)), math.sin(math.radians(w / 3600)), _xyz("x"), _xyz("y")
    return {"x": r * (c * x + s * y) + tx, "y": r * (c * y - s * x) + ty}


_real("transform_helmert", _helmert)
_real("transform_affine", _affine)
_real("clamp_z", lambda low, high: {"z": F.greatest(F.lit(low), F.least(F.lit(high), _xyz("z")))})
_real("clamp_z_below", lambda low: {"z": F.greatest(F.lit(low), _xyz("z"))})
_real("clamp_z_above", lambda high: {"z": F.least(F.lit(high), _xyz("z"))})
_real("copy_attribute_into_z", lambda i: {"z": F.col(f"attr_{i}")})
_real("copy_intensity_into_z", lambda: {"z": F.col("intensity").cast("double")})
_real("add_attribute_to_z", lambda i: {"z": _xyz("z") + F.col(f"attr_{i}")})
_real("add_scaled_attribute_to_z", lambda i, s: {"z": _xyz("z") + F.col(f"attr_{i}") * s})
_set("clamp_raw_z", lambda low, high: {"zi": F.greatest(F.lit(low), F.least(F.lit(high), F.col("zi")))})


def _jitter(max_x: int, max_y: int, seed: int = 0) -> dict[str, Column]:
    """Shifts within [-max, max] by a hash of the point, so that reruns agree."""

    def shift(most: int, axis: str) -> Column:
        return (F.pmod(F.xxhash64("source_file", "point_index", F.lit(axis), F.lit(seed)), F.lit(2 * most + 1)) - most).cast("int")

    return {"xi": F.col("xi") + shift(max_x, "x"), "yi": F.col("yi") + shift(max_y, "y")}


_set("translate_raw_xy_at_random", _jitter)
for _name, _one, _two in (
    ("switch_x_y", "xi", "yi"), ("switch_x_z", "xi", "zi"), ("switch_y_z", "yi", "zi"),
    ("switch_R_G", "red", "green"), ("switch_R_B", "red", "blue"), ("switch_G_B", "green", "blue"),
):
    _set(_name, lambda a=_one, b=_two: {a: F.col(b), b: F.col(a)})

# --- plain values
for _name, _column in (
    ("intensity", "intensity"), ("withheld_flag", "withheld_flag"), ("synthetic_flag", "synthetic_flag"),
    ("keypoint_flag", "keypoint_flag"), ("overlap_flag", "overlap_flag"), ("scanner_channel", "scanner_channel"),
    ("user_data", "user_data"), ("point_source", "point_source_id"), ("return_number", "return_number"),
    ("extended_return_number", "ext_return_number"), ("number_of_returns", "number_of_returns"),
    ("extended_number_of_returns", "ext_number_of_returns"),
):
    _set(f"set_{_name}", lambda v, c=_column: {c: F.lit(int(v))})
_set("set_gps_time", lambda t: {"gps_time": F.lit(float(t))})
_set("set_RGB", lambda r, g, b: {"red": F.lit(r), "green": F.lit(g), "blue": F.lit(b)})
for _name, _column in (
    ("user_data", "user_data"), ("point_source", "point_source_id"), ("return_number", "return_number"),
    ("number_of_returns", "number_of_returns"),
):
    _set(f"change_{_name}_from_to", lambda a, b, c=_column: {c: F.when(F.col(c) == a, F.lit(b)).otherwise(F.col(c))})

# --- intensity, scan angle, user data, colours: 32-bit float factors, clamped, cut
_I, _A = "intensity", "scan_angle_rank"
_set("scale_intensity", lambda s: {_I: u16(F.col(_I) * single(s))})
_set("translate_intensity", lambda o: {_I: u16(F.col(_I) + single(o))})
_set("translate_then_scale_intensity", lambda o, s: {_I: u16((F.col(_I) + single(o)) * single(s))})
_set("clamp_intensity", lambda low, high: {_I: F.greatest(F.lit(low), F.least(F.lit(high), F.col(_I)))})
_set("clamp_intensity_below", lambda low: {_I: F.greatest(F.lit(low), F.col(_I))})
_set("clamp_intensity_above", lambda high: {_I: F.least(F.lit(high), F.col(_I))})
_set("copy_attribute_into_intensity", lambda i: {_I: u16(F.col(f"attr_{i}"))})
_set("scale_scan_angle", lambda s: {_A: i8(nearest(F.col(_A) * single(s)))})
_set("translate_scan_angle", lambda o: {_A: i8(nearest(F.col(_A) + single(o)))})
_set("translate_then_scale_scan_angle", lambda o, s: {_A: i8(nearest((F.col(_A) + single(o)) * single(s)))})
_set("scale_user_data", lambda s: {"user_data": u8(F.col("user_data") * single(s))})
_set("copy_attribute_into_user_data", lambda i: {"user_data": u8(F.col(f"attr_{i}"))})
_RGB = ("red", "green", "blue")
_set("scale_RGB", lambda *s: {c: u16(F.col(c) * single(v)) for c, v in zip(_RGB, s, strict=True)})
_set("scale_RGB_down", lambda: {c: F.shiftright(c, 8) for c in _RGB})
_set("scale_RGB_up", lambda: {c: F.shiftleft(c, 8).bitwiseAND(65535) for c in _RGB})
_set("copy_RGB_into_intensity", lambda: {_I: nearest(0.2989 * F.col("red") + 0.5870 * F.col("green") + 0.1140 * F.col("blue")).cast("int")})
for _letter, _column in (("R", "red"), ("G", "green"), ("B", "blue"), ("NIR", "nir")):
    _set(f"copy_{_letter}_into_intensity", lambda c=_column: {_I: F.col(c)})
    if _column != "nir":
        _set(f"copy_{_letter}_into_NIR", lambda c=_column: {"nir": F.col(c)})
_set("copy_intensity_into_NIR", lambda: {"nir": F.col(_I)})

# --- classes: values over 31 exist in the extended field only
_C, _X = "classification", "ext_classification"


def _class(to: int, when: Column | None = None) -> dict[str, Column]:
    legacy, extended = F.lit(to if to <= 31 else 0), F.lit(to)
    if when is None:
        return {_C: legacy, _X: extended}
    return {_C: F.when(when, legacy).otherwise(F.col(_C)), _X: F.when(when, extended).otherwise(F.col(_X))}


_set("set_classification", lambda c: _class(c))
_set("change_classification_from_to", lambda a, b: _class(b, (F.col(_X) if a > 31 else F.col(_C)) == a))


def _ancient() -> dict[str, Column]:
    any_ = (F.col("withheld_flag") + F.col("keypoint_flag") + F.col("synthetic_flag")) > 0
    packed = F.col("withheld_flag") * 128 + F.col("keypoint_flag") * 64 + F.col("synthetic_flag") * 32 + F.col(_C)
    cleared = {f"{f}_flag": F.lit(0) for f in ("withheld", "keypoint", "synthetic")}
    return {_X: F.when(any_, packed).otherwise(F.col(_X)), **cleared}


_set("move_ancient_to_extended_classification", _ancient)
for _name, _value in (("z", lambda: _xyz("z")), ("intensity", lambda: F.col(_I))):
    _set(f"classify_{_name}_below_as", lambda v, c, of=_value: _class(c, of() < v))
    _set(f"classify_{_name}_above_as", lambda v, c, of=_value: _class(c, of() > v))
    _set(f"classify_{_name}_between_as", lambda low, high, c, of=_value: _class(c, of().between(low, high)))
_set("classify_attribute_below_as", lambda i, v, c: _class(c, F.col(f"attr_{i}") < v))
_set("classify_attribute_above_as", lambda i, v, c: _class(c, F.col(f"attr_{i}") > v))
_set("classify_attribute_between_as", lambda i, low, high, c: _class(c, F.col(f"attr_{i}").between(low, high)))
_set("copy_classification_into_user_data", lambda: {"user_data": F.when(F.col(_C) != 0, F.col(_C)).otherwise(F.col(_X))})


def _colour_of(column: str) -> Callable[..., dict[str, Column]]:
    return lambda c, *rgb: {k: F.when(F.col(column) == c, F.lit(v)).otherwise(F.col(k)) for k, v in zip(_RGB, rgb, strict=True)}


_set("set_RGB_of_class", lambda c, *rgb: _colour_of(_C if c <= 31 else _X)(c, *rgb))

# --- returns and time
_set("repair_zero_returns", lambda: {c: F.greatest(F.col(c), F.lit(1)) for c in ("return_number", "number_of_returns")})
_set("translate_gps_time", lambda d: {"gps_time": F.col("gps_time") + d})


def _to_week() -> dict[str, Column]:
    week = (F.col("gps_time") / WEEK_SECONDS + ADJUSTED_WEEK).cast("int")
    return {"gps_time": F.col("gps_time") - (week * F.lit(float(WEEK_SECONDS)) - ADJUSTED_SHIFT)}


_set("adjusted_to_week", _to_week)
_set("week_to_adjusted", lambda week: {"gps_time": F.col("gps_time") + (float(week) * WEEK_SECONDS - ADJUSTED_SHIFT)})


def _low_bits(value: Column) -> Column:
    return value.bitwiseAND(F.lit(65535).cast("long")).cast("int")


_set("bin_gps_time_into_intensity", lambda size=1.0: {_I: _low_bits(nearest(F.col("gps_time") / size))})
_set("bin_gps_time_into_point_source", lambda size=1.0: {"point_source_id": _low_bits(nearest(F.col("gps_time") / size))})

# --- point source and scanner channel
_P, _S = "point_source_id", "scanner_channel"
_set("copy_user_data_into_point_source", lambda: {_P: F.col("user_data")})
_set("copy_user_data_into_scanner_channel", lambda: {_S: F.col("user_data").bitwiseAND(3)})
_set("copy_scanner_channel_into_point_source", lambda: {_P: F.col(_S)})
_set("merge_scanner_channel_into_point_source", lambda: {_P: F.shiftleft(_P, 2).bitwiseOR(F.col(_S)).bitwiseAND(65535)})
_set("split_scanner_channel_from_point_source", lambda: {_S: F.col(_P).bitwiseAND(3), _P: F.shiftright(_P, 2)})
_set("bin_Z_into_point_source", lambda size=1: {_P: u16((F.col("zi") / size).cast("int"))})
_set("bin_abs_scan_angle_into_point_source", lambda size=1.0: {_P: u16(F.floor(F.abs(_A) / single(size)))})
_set("flip_waveform_direction", lambda: {c: -F.col(c) for c in ("wave_xt", "wave_yt", "wave_zt")})
_set("scale_attribute", lambda i, s: {f"attr_{i}": F.col(f"attr_{i}") * single(s)})
_set("translate_attribute", lambda i, o: {f"attr_{i}": F.col(f"attr_{i}") + o})


def map_values(points: DataFrame, column: str, pairs: DataFrame) -> DataFrame:
    """column by a table of (from, to); values that it doesn't name stay.

    Of several rows with one `from` the first counts, by `line` if the table has it (else the
    smallest `to`). Attributes have 16 bits, so that at most 65,536 rows are left to be broadcast.
    """
    first = F.min(F.struct("line", "to") if "line" in pairs.columns else F.struct("to"))["to"]
    known = pairs.where(F.col("from").between(0, 65_535) & F.col("to").isNotNull())
    named = F.broadcast(known.groupBy(F.col("from").alias("__from")).agg(first.alias("__to")))
    mapped = points.join(named, F.col(column) == F.col("__from"), "left")
    return mapped.withColumn(column, F.coalesce("__to", column)).drop("__from", "__to")


def _map_file(column: str) -> Transform:
    def mapped(points: DataFrame, path: str) -> DataFrame:
        """path: a text file with lines `from to`; other lines are left out."""
        rows = points.sparkSession.read.text(path).select("value", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id()).alias("line"))
        words = rows.where(F.trim("value").rlike(r"^\d{1,9}\s+\d{1,9}(\s|$)")).withColumn("w", F.split(F.trim("value"), r"\s+"))
        return map_values(points, column, words.select("line", F.col("w")[0].cast("int").alias("from"), F.col("w")[1].cast("int").alias("to")))

    return mapped


TRANSFORMS["map_intensity"] = _map_file("intensity")
TRANSFORMS["map_user_data"] = _map_file("user_data")
TRANSFORMS["map_point_source"] = _map_file("point_source_id")
