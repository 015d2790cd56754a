"""Queries over single points: the arguments of each filter and transform, and the SQL to compare with."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pointlake.operators.filters import FILTERS, filter_and, filter_or
from pointlake.operators.ordered import ORDERED
from pointlake.operators.transforms import TRANSFORMS
from pointlake.plans.options import run_options
from pointlake.schema import DUCKDB_POINTS, POINT_COLUMNS, lineitem_points

Query = Callable[[SparkSession, str], DataFrame]
KEPT = ("xi", "yi", "zi", "point_source_id")
X, Y, Z = (f"(CAST({a} AS DOUBLE) * CAST(0.01 AS DOUBLE))" for a in ("xi", "yi", "zi"))
RN, NR, GPS = "return_number", "number_of_returns", "gps_time"


def points_sql(select: str) -> str:
    """DuckDB SQL over the point view, named pts."""
    more = f", {select.strip()[5:]}" if select.strip().startswith("WITH ") else f" {select}"
    return f"WITH pts AS ({DUCKDB_POINTS}){more}"


def _range(v: str, a: float, b: float) -> str:
    return f"{v} >= {a} AND {v} < {b}"


def _ndvi(a: str, b: str, low: float, high: float) -> str:
    sum_ = f"(CAST({a} AS DOUBLE) + {b})"
    return f"({sum_} = 0 OR (CAST({a} AS DOUBLE) - {b}) / NULLIF({sum_}, 0) BETWEEN {low} AND {high})"


#: filter: (arguments, SQL condition)
FILTER_CASES: dict[str, tuple[tuple, str]] = {
    "keep_tile": ((500, 100, 250), f"{_range(X, 500, 750)} AND {_range(Y, 100, 350)}"),
    "keep_circle": ((1000, 300, 150), f"({X} - 1000) * ({X} - 1000) + ({Y} - 300) * ({Y} - 300) < 22500"),
    "keep_xy": ((200, 100, 900, 400), f"{_range(X, 200, 900)} AND {_range(Y, 100, 400)}"),
    "drop_xy": ((200, 100, 900, 400), f"NOT ({_range(X, 200, 900)} AND {_range(Y, 100, 400)})"),
    "keep_xyz": ((200, 100, 50, 900, 400, 500), f"{_range(X, 200, 900)} AND {_range(Y, 100, 400)} AND {_range(Z, 50, 500)}"),
    "drop_xyz": ((200, 100, 50, 900, 400, 500), f"NOT ({_range(X, 200, 900)} AND {_range(Y, 100, 400)} AND {_range(Z, 50, 500)})"),
    "inside_tile": ((0, 0, 500), f"{_range(X, 0, 500)} AND {_range(Y, 0, 500)}"),
    "inside_circle": ((500, 500, 300), f"({X} - 500) * ({X} - 500) + ({Y} - 500) * ({Y} - 500) < 90000"),
    "inside_rectangle": ((100, 100, 700, 300), f"{_range(X, 100, 700)} AND {_range(Y, 100, 300)}"),
    "keep_xy_raw": ((20000, 10000, 90000, 40000), f"{_range('xi', 20000, 90000)} AND {_range('yi', 10000, 40000)}"),
    "keep_z_above": ((300,), f"{Z} >= 300"), "keep_z_below": ((300,), f"{Z} < 300"),
    "keep_z_raw_above": ((30000,), "zi >= 30000"), "keep_z_raw_below": ((30000,), "zi < 30000"),
    "clip_z_below": ((200,), f"{Z} >= 200"), "clip_z_above": ((600,), f"{Z} < 600"),
    "keep_first": ((), f"{RN} <= 1"), "first_only": ((), f"{RN} <= 1"),
    "keep_first_of_many": ((), f"{NR} <> 1 AND {RN} <= 1"), "keep_middle": ((), f"{RN} <> 1 AND {RN} < {NR}"),
    "keep_last": ((), f"{RN} >= {NR}"), "last_only": ((), f"{RN} >= {NR}"),
    "keep_last_of_many": ((), f"{RN} <> 1 AND {RN} >= {NR}"), "keep_second_last": ((), f"{NR} > 1 AND {RN} = {NR} - 1"),
    "drop_first": ((), f"{RN} <> 1"), "drop_first_of_many": ((), f"NOT ({NR} > 1 AND {RN} = 1)"),
    "drop_middle": ((), f"NOT ({RN} > 1 AND {RN} < {NR})"), "drop_last": ((), f"{RN} < {NR}"),
    "drop_last_of_many": ((), f"NOT ({NR} > 1 AND {RN} >= {NR})"), "drop_second_last": ((), f"NOT ({NR} > 1 AND {RN} = {NR} - 1)"),
    "keep_return": ((1, 3), f"{RN} IN (1, 3)"), "drop_return": ((2,), f"{RN} <> 2"),
    "keep_return_mask": ((0b10110,), f"{RN} IN (1, 2, 4)"), "drop_return_mask": ((0b10110,), f"{RN} NOT IN (1, 2, 4)"),
    "keep_class": ((2, 5), "classification IN (2, 5)"), "drop_class": ((1,), "classification <> 1"),
    "keep_class_mask": ((0b100010,), "classification IN (1, 5)"), "drop_class_mask": ((0b100010,), "classification NOT IN (1, 5)"),
    "keep_extended_class": ((40, 41), "ext_classification IN (40, 41)"), "drop_extended_class": ((42,), "ext_classification <> 42"),
    "keep_extended_class_mask": ((1 << 40 | 1 << 2,), "ext_classification IN (2, 40)"),
    "drop_extended_class_mask": ((1 << 40 | 1 << 2,), "ext_classification NOT IN (2, 40)"),
    "keep_number_of_returns": ((3,), f"{NR} = 3"), "drop_number_of_returns": ((3,), f"{NR} <> 3"),
    "drop_scan_direction": ((1,), "scan_direction_flag <> 1"), "keep_edge_of_flight_line": ((), "edge_of_flight_line <> 0"),
    "keep_scanner_channel": ((2,), "scanner_channel = 2"), "drop_scanner_channel": ((2,), "scanner_channel <> 2"),
    "keep_NDVI": ((-0.2, 0.6), _ndvi("nir", "red", -0.2, 0.6)), "keep_NDVI_green_is_NIR": ((-0.2, 0.6), _ndvi("green", "red", -0.2, 0.6)),
    "keep_NDVI_blue_is_NIR": ((-0.2, 0.6), _ndvi("blue", "red", -0.2, 0.6)), "keep_NDVI_from_CIR": ((-0.2, 0.6), _ndvi("red", "green", -0.2, 0.6)),
    "keep_NDVI_intensity_is_NIR": ((-0.9, 0.1), _ndvi("intensity", "red", -0.9, 0.1)),
    "keep_scan_angle": ((-10, 12), "scan_angle_rank BETWEEN -10 AND 12"), "drop_scan_angle_below": ((-5,), "scan_angle_rank >= -5"),
    "drop_scan_angle_above": ((5,), "scan_angle_rank <= 5"), "drop_scan_angle_between": ((-5, 5), "scan_angle_rank NOT BETWEEN -5 AND 5"),
    "drop_abs_scan_angle_above": ((12,), "abs(scan_angle_rank) <= 12"), "drop_abs_scan_angle_below": ((12,), "abs(scan_angle_rank) >= 12"),
    "keep_gps_time": ((0, 3e7), f"{GPS} IS NULL OR {GPS} BETWEEN 0 AND 3e7"), "keep_gps_time_above": ((1e7,), f"{GPS} IS NULL OR {GPS} >= 1e7"),
    "keep_gps_time_below": ((1e7,), f"{GPS} IS NULL OR {GPS} <= 1e7"), "drop_gps_time_below": ((2e7,), f"{GPS} IS NULL OR {GPS} >= 2e7"),
    "drop_gps_time_above": ((2e7,), f"{GPS} IS NULL OR {GPS} <= 2e7"), "drop_gps_time_between": ((0, 3e7), f"{GPS} IS NULL OR {GPS} NOT BETWEEN 0 AND 3e7"),
    "keep_wavepacket": ((1,), "wave_index = 1"), "drop_wavepacket": ((1,), "wave_index <> 1"),
    "keep_attribute_below": ((0, 4.5), "attr_0 < 4.5"), "keep_attribute_above": ((0, 4.5), "attr_0 > 4.5"),
    "keep_attribute_between": ((1, 1.5, 5.5), "attr_1 BETWEEN 1.5 AND 5.5"), "drop_attribute_below": ((0, 4.5), "attr_0 >= 4.5"),
    "drop_attribute_above": ((0, 4.5), "attr_0 <= 4.5"), "drop_attribute_between": ((1, 1.5, 5.5), "attr_1 NOT BETWEEN 1.5 AND 5.5"),
}
for _axis, _v in (("x", X), ("y", Y), ("z", Z)):
    FILTER_CASES |= {
        f"keep_{_axis}": ((150, 600), _range(_v, 150, 600)), f"drop_{_axis}": ((150, 600), f"NOT ({_range(_v, 150, 600)})"),
        f"drop_{_axis}_below": ((250,), f"{_v} >= 250"), f"drop_{_axis}_above": ((250,), f"{_v} < 250"),
        f"keep_{_axis}_raw": ((15000, 60000), _range(f"{_axis}i", 15000, 60000)),
        f"drop_{_axis}_raw": ((15000, 60000), f"NOT ({_range(f'{_axis}i', 15000, 60000)})"),
        f"drop_{_axis}_raw_below": ((25000,), f"{_axis}i >= 25000"), f"drop_{_axis}_raw_above": ((25000,), f"{_axis}i < 25000"),
    }
for _k, _name in enumerate(("single", "double", "triple", "quadruple", "quintuple"), 1):
    FILTER_CASES |= {f"keep_{_name}": ((), f"{NR} = {_k}"), f"drop_{_name}": ((), f"{NR} <> {_k}")}
for _c in ("red", "green", "blue", "nir"):
    FILTER_CASES |= {f"keep_RGB_{_c}": ((300, 9000), f"{_c} BETWEEN 300 AND 9000"), f"drop_RGB_{_c}": ((300, 9000), f"{_c} NOT BETWEEN 300 AND 9000")}
for _name, _c, _a, _b in (("intensity", "intensity", 1000, 3000), ("user_data", "user_data", 10, 30), ("point_source", "point_source_id", 3, 40)):
    FILTER_CASES |= {
        f"keep_{_name}_below": ((_b,), f"{_c} < {_b}"), f"keep_{_name}_above": ((_a,), f"{_c} > {_a}"),
        f"keep_{_name}_between": ((_a, _b), f"{_c} BETWEEN {_a} AND {_b}"), f"drop_{_name}_below": ((_a,), f"{_c} >= {_a}"),
        f"drop_{_name}_above": ((_b,), f"{_c} <= {_b}"), f"drop_{_name}_between": ((_a, _b), f"{_c} NOT BETWEEN {_a} AND {_b}"),
    }
    if _name != "intensity":
        FILTER_CASES |= {f"keep_{_name}": ((_a,), f"{_c} = {_a}"), f"drop_{_name}": ((_a,), f"{_c} <> {_a}")}
FILTER_CASES["keep_intensity"] = ((1000, 3000), "intensity BETWEEN 1000 AND 3000")
for _flag in ("synthetic", "keypoint", "withheld", "overlap"):
    FILTER_CASES |= {f"keep_{_flag}": ((), f"{_flag}_flag = 1"), f"drop_{_flag}": ((), f"{_flag}_flag = 0")}


def _raw(value: str) -> str:
    """SQL of requantisation: halves away from zero."""
    steps = f"(({value}) / CAST(0.01 AS DOUBLE))"
    return f"CAST(CASE WHEN ({value}) >= 0 THEN floor({steps} + 0.5) ELSE ceil({steps} - 0.5) END AS INT)"


def _near(value: str) -> str:
    return f"CAST(CASE WHEN ({value}) >= 0 THEN floor(({value}) + 0.5) ELSE ceil(({value}) - 0.5) END AS BIGINT)"


def _clamp(value: str, low: int, high: int) -> str:
    return f"CAST(trunc(greatest({low}.0, least({high}.0, CAST({value} AS DOUBLE)))) AS INT)"


def _class(c: int, when: str) -> dict[str, str]:
    return {
        "classification": f"CASE WHEN {when} THEN {c if c <= 31 else 0} ELSE classification END",
        "ext_classification": f"CASE WHEN {when} THEN {c} ELSE ext_classification END",
    }


def _swap(a: str, b: str) -> dict[str, str]:
    return {a: b, b: a}


def _from_to(c: str, a: int, b: int) -> dict[str, str]:
    return {c: f"CASE WHEN {c} = {a} THEN {b} ELSE {c} END"}


#: transform: (arguments, SQL of each column that changes)
TRANSFORM_CASES: dict[str, tuple[tuple, dict[str, str]]] = {
    "translate_xyz": ((1.25, -3.0, 0.5), {"xi": _raw(f"{X} + 1.25"), "yi": _raw(f"{Y} + -3.0"), "zi": _raw(f"{Z} + 0.5")}),
    "scale_xyz": ((2.0, 0.5, 4.0), {"xi": _raw(f"{X} * 2.0"), "yi": _raw(f"{Y} * 0.5"), "zi": _raw(f"{Z} * 4.0")}),
    "translate_raw_xyz": ((5, -6, 7), {"xi": "xi + 5", "yi": "yi + -6", "zi": "zi + 7"}),
    "clamp_z": ((100.0, 500.0), {"zi": _raw(f"greatest(100.0, least(500.0, {Z}))")}),
    "clamp_z_below": ((100.0,), {"zi": _raw(f"greatest(100.0, {Z})")}), "clamp_z_above": ((500.0,), {"zi": _raw(f"least(500.0, {Z})")}),
    "clamp_raw_z": ((10000, 50000), {"zi": "greatest(10000, least(50000, zi))"}),
    "copy_intensity_into_z": ((), {"zi": "intensity * 100"}),
    "switch_x_y": ((), _swap("xi", "yi")), "switch_x_z": ((), _swap("xi", "zi")), "switch_y_z": ((), _swap("yi", "zi")),
    "switch_R_G": ((), _swap("red", "green")), "switch_R_B": ((), _swap("red", "blue")), "switch_G_B": ((), _swap("green", "blue")),
    "scale_intensity": ((2.5,), {"intensity": _clamp("intensity * 2.5", 0, 65535)}),
    "translate_intensity": ((-100.5,), {"intensity": _clamp("intensity - 100.5", 0, 65535)}),
    "translate_then_scale_intensity": ((-100.0, 30.0), {"intensity": _clamp("(intensity - 100.0) * 30.0", 0, 65535)}),
    "clamp_intensity": ((500, 2000), {"intensity": "greatest(500, least(2000, intensity))"}),
    "clamp_intensity_below": ((500,), {"intensity": "greatest(500, intensity)"}), "clamp_intensity_above": ((2000,), {"intensity": "least(2000, intensity)"}),
    "scale_scan_angle": ((5.5,), {"scan_angle_rank": _clamp(_near("scan_angle_rank * 5.5"), -128, 127)}),
    "translate_scan_angle": ((2.5,), {"scan_angle_rank": _clamp(_near("scan_angle_rank + 2.5"), -128, 127)}),
    "translate_then_scale_scan_angle": ((1.0, 4.5), {"scan_angle_rank": _clamp(_near("(scan_angle_rank + 1.0) * 4.5"), -128, 127)}),
    "set_classification": ((40,), {"classification": "0", "ext_classification": "40"}),
    "change_classification_from_to": ((2, 9), _class(9, "classification = 2")),
    "move_ancient_to_extended_classification": ((), {
        "ext_classification": "CASE WHEN withheld_flag + keypoint_flag + synthetic_flag > 0 THEN withheld_flag * 128 + keypoint_flag * 64 + synthetic_flag * 32 + classification ELSE ext_classification END",
        "withheld_flag": "0", "keypoint_flag": "0", "synthetic_flag": "0"}),
    "classify_z_below_as": ((300, 7), _class(7, f"{Z} < 300")), "classify_z_above_as": ((300, 70), _class(70, f"{Z} > 300")),
    "classify_z_between_as": ((100, 300, 6), _class(6, f"{Z} BETWEEN 100 AND 300")),
    "classify_intensity_below_as": ((900, 7), _class(7, "intensity < 900")), "classify_intensity_above_as": ((900, 7), _class(7, "intensity > 900")),
    "classify_intensity_between_as": ((900, 1900, 7), _class(7, "intensity BETWEEN 900 AND 1900")),
    "classify_attribute_below_as": ((0, 4.5, 7), _class(7, "attr_0 < 4.5")), "classify_attribute_above_as": ((0, 4.5, 7), _class(7, "attr_0 > 4.5")),
    "classify_attribute_between_as": ((0, 2.5, 4.5, 7), _class(7, "attr_0 BETWEEN 2.5 AND 4.5")),
    "scale_user_data": ((7.5,), {"user_data": _clamp("user_data * 7.5", 0, 255)}),
    "change_user_data_from_to": ((5, 50), _from_to("user_data", 5, 50)), "change_point_source_from_to": ((5, 50), _from_to("point_source_id", 5, 50)),
    "change_return_number_from_to": ((2, 1), _from_to("return_number", 2, 1)), "change_number_of_returns_from_to": ((5, 4), _from_to("number_of_returns", 5, 4)),
    "copy_classification_into_user_data": ((), {"user_data": "CASE WHEN classification <> 0 THEN classification ELSE ext_classification END"}),
    "repair_zero_returns": ((), {"return_number": "greatest(return_number, 1)", "number_of_returns": "greatest(number_of_returns, 1)"}),
    "translate_gps_time": ((12.5,), {"gps_time": "gps_time + 12.5"}), "set_gps_time": ((5.0,), {"gps_time": "CAST(5.0 AS DOUBLE)"}),
    "adjusted_to_week": ((), {"gps_time": "gps_time - (trunc(gps_time / 604800 + CAST(1653.4391534391534 AS DOUBLE)) * CAST(604800 AS DOUBLE) - CAST(1e9 AS DOUBLE))"}),
    "week_to_adjusted": ((1700,), {"gps_time": "gps_time + CAST(28160000 AS DOUBLE)"}),
    "bin_gps_time_into_intensity": ((1000.0,), {"intensity": f"CAST({_near('gps_time / 1000.0')} & 65535 AS INT)"}),
    "bin_gps_time_into_point_source": ((500.0,), {"point_source_id": f"CAST({_near('gps_time / 500.0')} & 65535 AS INT)"}),
    "set_RGB": ((1, 2, 3), {"red": "1", "green": "2", "blue": "3"}),
    "set_RGB_of_class": ((2, 9, 8, 7), {c: f"CASE WHEN classification = 2 THEN {v} ELSE {c} END" for c, v in (("red", 9), ("green", 8), ("blue", 7))}),
    "scale_RGB": ((1.5, 0.5, 9.0), {c: _clamp(f"{c} * {v}", 0, 65535) for c, v in (("red", 1.5), ("green", 0.5), ("blue", 9.0))}),
    "scale_RGB_down": ((), {c: f"{c} >> 8" for c in ("red", "green", "blue")}),
    "scale_RGB_up": ((), {c: f"CAST((CAST({c} AS BIGINT) << 8) & 65535 AS INT)" for c in ("red", "green", "blue")}),
    "copy_RGB_into_intensity": ((), {"intensity": f"CAST({_near('CAST(0.2989 AS DOUBLE) * red + CAST(0.5870 AS DOUBLE) * green + CAST(0.1140 AS DOUBLE) * blue')} AS INT)"}),
    "copy_NIR_into_intensity": ((), {"intensity": "nir"}), "copy_intensity_into_NIR": ((), {"nir": "intensity"}),
    "flip_waveform_direction": ((), {c: f"-{c}" for c in ("wave_xt", "wave_yt", "wave_zt")}),
    "copy_user_data_into_point_source": ((), {"point_source_id": "user_data"}), "copy_user_data_into_scanner_channel": ((), {"scanner_channel": "user_data & 3"}),
    "copy_scanner_channel_into_point_source": ((), {"point_source_id": "scanner_channel"}),
    "merge_scanner_channel_into_point_source": ((), {"point_source_id": "((point_source_id << 2) | scanner_channel) & 65535"}),
    "split_scanner_channel_from_point_source": ((), {"scanner_channel": "point_source_id & 3", "point_source_id": "point_source_id >> 2"}),
    "bin_Z_into_point_source": ((7,), {"point_source_id": _clamp("trunc(CAST(zi AS DOUBLE) / 7)", 0, 65535)}),
    "bin_abs_scan_angle_into_point_source": ((2.0,), {"point_source_id": _clamp("floor(abs(scan_angle_rank) / 2.0)", 0, 65535)}),
    "translate_attribute": ((0, 1.5), {"attr_0": "attr_0 + 1.5"}), "scale_attribute": ((1, 2.5), {"attr_1": "attr_1 * 2.5"}),
    "copy_attribute_into_z": ((0,), {"zi": _raw("attr_0")}), "add_attribute_to_z": ((0,), {"zi": _raw(f"{Z} + attr_0")}),
    "add_scaled_attribute_to_z": ((1, 2.0), {"zi": _raw(f"{Z} + attr_1 * 2.0")}),
    "copy_attribute_into_intensity": ((0,), {"intensity": _clamp("attr_0", 0, 65535)}), "copy_attribute_into_user_data": ((0,), {"user_data": _clamp("attr_0", 0, 255)}),
}
for _axis, _v in (("x", X), ("y", Y), ("z", Z)):
    TRANSFORM_CASES |= {
        f"translate_{_axis}": ((1.255,), {f"{_axis}i": _raw(f"{_v} + 1.255")}), f"scale_{_axis}": ((1.5,), {f"{_axis}i": _raw(f"{_v} * 1.5")}),
        f"translate_then_scale_{_axis}": ((-400.0, 2.0), {f"{_axis}i": _raw(f"({_v} + -400.0) * 2.0")}),
        f"translate_raw_{_axis}": ((123,), {f"{_axis}i": f"{_axis}i + 123"}),
    }
for _l, _c in (("R", "red"), ("G", "green"), ("B", "blue")):
    TRANSFORM_CASES |= {f"copy_{_l}_into_intensity": ((), {"intensity": _c}), f"copy_{_l}_into_NIR": ((), {"nir": _c})}
for _name, _c in (
    ("intensity", "intensity"), ("withheld_flag", "withheld_flag"), ("synthetic_flag", "synthetic_flag"), ("keypoint_flag", "keypoint_flag"),
    ("overlap_flag", "overlap_flag"), ("scanner_channel", "scanner_channel"), ("user_data", "user_data"), ("point_source", "point_source_id"),
    ("return_number", "return_number"), ("extended_return_number", "ext_return_number"), ("number_of_returns", "number_of_returns"),
    ("extended_number_of_returns", "ext_number_of_returns"),
):
    TRANSFORM_CASES[f"set_{_name}"] = ((1,), {_c: "1"})

#: transforms whose results are real numbers of sines and cosines: compared after rounding to cells
ANGLE_CASES = {"rotate_xy": (30.0, 500.0, 200.0), "rotate_xz": (15.0, 500.0, 300.0), "transform_helmert": (1.0, 2.0, 3.0, 5.0, 6.0, 7.0, 20.0), "transform_affine": (1.5, 3600.0, 10.0, 20.0)}

#: order-aware filters: (arguments, SQL that selects from pts)
_ORDER = "PARTITION BY source_file ORDER BY point_index"
_CELLS = f"floor({X} / 100.0) AS cx, floor({Y} / 100.0) AS cy"
_BIN = "floor(coalesce(gps_time, 0) / 5000000.0)"
ORDERED_CASES: dict[str, tuple[tuple, str]] = {
    "keep_every_nth": ((7,), f"SELECT * FROM (SELECT *, row_number() OVER ({_ORDER}) AS k FROM pts) WHERE k % 7 = 0"),
    "drop_every_nth": ((7,), f"SELECT * FROM (SELECT *, row_number() OVER ({_ORDER}) AS k FROM pts) WHERE k % 7 <> 0"),
    "keep_scan_direction_change": ((), f"SELECT * FROM (SELECT *, lag(scan_direction_flag) OVER ({_ORDER}) AS b FROM pts) WHERE b <> scan_direction_flag"),
    "thin_with_grid": ((100,), f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_file, cx, cy ORDER BY point_index) AS k FROM (SELECT *, {_CELLS} FROM pts)) WHERE k = 1"),
    "thin_points_with_time": ((5e6,), f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_file, {_BIN} ORDER BY point_index) AS k FROM pts) WHERE k = 1"),
    "thin_pulses_with_time": ((5e6,), f"SELECT * FROM (SELECT *, first_value(coalesce(gps_time, 0)) OVER (PARTITION BY source_file, {_BIN} ORDER BY point_index) AS t FROM pts) WHERE t = coalesce(gps_time, 0)"),
}


def _filter_query(name: str, args: tuple) -> Query:
    return lambda spark, sf: lineitem_points(spark, sf).where(FILTERS[name](*args)).select(*KEPT)


def _transform_query(name: str, args: tuple, columns: list[str]) -> Query:
    return lambda spark, sf: TRANSFORMS[name](lineitem_points(spark, sf), *args).select("source_file", *columns)


def _ordered_query(name: str, args: tuple) -> Query:
    return lambda spark, sf: ORDERED[name](lineitem_points(spark, sf), *args).select("source_file", "point_index", *KEPT)


def _options_query(options: str, *columns: str) -> Query:
    return lambda spark, sf: run_options(lineitem_points(spark, sf), options).select(*columns)


QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
for _name, (_args, _sql) in FILTER_CASES.items():
    QUERIES[_name] = _filter_query(_name, _args)
    ORACLE_SQL[_name] = points_sql(f"SELECT {', '.join(KEPT)} FROM pts WHERE {_sql}")
for _name, (_args, _exprs) in TRANSFORM_CASES.items():
    QUERIES[_name] = _transform_query(_name, _args, list(_exprs))
    ORACLE_SQL[_name] = points_sql(f"SELECT source_file, {', '.join(f'{e} AS {c}' for c, e in _exprs.items())} FROM pts")


def _angle_sql() -> dict[str, dict[str, str]]:
    """By axis, the real coordinates after each transform."""
    d = "CAST({!r} AS DOUBLE)".format

    def turned(first: str, second: str, degrees: float, a: float, b: float) -> tuple[str, str]:
        c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
        return f"({first} - {d(a)}) * {d(c)} - ({second} - {d(b)}) * {d(s)} + {d(a)}", f"({second} - {d(b)}) * {d(c)} + ({first} - {d(a)}) * {d(s)} + {d(b)}"

    dx, dy, dz, *arc, ppm = ANGLE_CASES["transform_helmert"]
    (rx, ry, rz), m = (math.radians(r / 3600) for r in arc), 1 + 1e-6 * ppm
    r, w, tx, ty = ANGLE_CASES["transform_affine"]
    c, s = math.cos(math.radians(w / 3600)), math.sin(math.radians(w / 3600))
    return {
        "rotate_xy": dict(zip("xy", turned(X, Y, *ANGLE_CASES["rotate_xy"]), strict=True)),
        "rotate_xz": dict(zip("xz", turned(X, Z, *ANGLE_CASES["rotate_xz"]), strict=True)),
        "transform_helmert": {
            "x": f"{d(m)} * ({X} - {d(rz)} * {Y} + {d(ry)} * {Z}) + {d(dx)}", "y": f"{d(m)} * ({d(rz)} * {X} + {Y} - {d(rx)} * {Z}) + {d(dy)}",
            "z": f"{d(m)} * ({d(-ry)} * {X} + {d(rx)} * {Y} + {Z}) + {d(dz)}",
        },
        "transform_affine": {"x": f"{d(r)} * ({d(c)} * {X} + {d(s)} * {Y}) + {d(tx)}", "y": f"{d(r)} * ({d(c)} * {Y} - {d(s)} * {X}) + {d(ty)}"},
    }


def _raw_sql(value: str) -> str:
    steps = f"(({value}) / CAST(0.01 AS DOUBLE))"
    return f"CAST(CASE WHEN ({value}) >= 0 THEN floor({steps} + 0.5) ELSE ceil({steps} - 0.5) END AS INT)"


for _name, _args in ANGLE_CASES.items():
    QUERIES[_name] = _transform_query(_name, _args, ["xi", "yi", "zi"])
    _moved = _angle_sql()[_name]
    ORACLE_SQL[_name] = points_sql("SELECT source_file, " + ", ".join(f"{_raw_sql(_moved[_a])} AS {_a}i" if _a in _moved else f"{_a}i" for _a in "xyz") + " FROM pts")
for _name, (_args, _sql) in ORDERED_CASES.items():
    QUERIES[_name] = _ordered_query(_name, _args)
    ORACLE_SQL[_name] = points_sql(f"SELECT source_file, point_index, {', '.join(KEPT)} FROM ({_sql})")
QUERIES["keep_random_fraction"] = _ordered_query("keep_random_fraction", (0.25, 3))
QUERIES["translate_raw_xy_at_random"] = _transform_query("translate_raw_xy_at_random", (50, 50), ["xi", "yi"])
QUERIES["filter_and"] = lambda spark, sf: lineitem_points(spark, sf).where(filter_and(FILTERS["keep_first"](), FILTERS["keep_class"](2))).select(*KEPT)
ORACLE_SQL["filter_and"] = points_sql(f"SELECT {', '.join(KEPT)} FROM pts WHERE return_number <= 1 OR classification = 2")
QUERIES["filter_or"] = lambda spark, sf: lineitem_points(spark, sf).where(filter_or(FILTERS["keep_first"](), FILTERS["keep_class"](2))).select(*KEPT)
ORACLE_SQL["filter_or"] = points_sql(f"SELECT {', '.join(KEPT)} FROM pts WHERE return_number <= 1 AND classification = 2")
QUERIES["options_nested"] = _options_query("-keep_first -keep_last -filter_and -keep_class 2 -filter_or -drop_z_below 100 -translate_raw_z 5", *KEPT)
ORACLE_SQL["options_nested"] = points_sql(f"SELECT xi, yi, zi + 5 AS zi, point_source_id FROM pts WHERE (return_number <= 1 OR return_number >= number_of_returns) AND classification = 2 AND {Z} >= 100")
QUERIES["filtered_transform"] = _options_query("-keep_class 2 -filtered_transform -set_user_data 99 -translate_raw_x 7", "xi", "user_data", "classification")
ORACLE_SQL["filtered_transform"] = points_sql("SELECT CASE WHEN classification = 2 THEN xi + 7 ELSE xi END AS xi, CASE WHEN classification = 2 THEN 99 ELSE user_data END AS user_data, classification FROM pts")
QUERIES["points_view"] = lambda spark, sf: lineitem_points(spark, sf).select(*POINT_COLUMNS)
ORACLE_SQL["points_view"] = points_sql(f"SELECT {', '.join(POINT_COLUMNS)} FROM pts")
