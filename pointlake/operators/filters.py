"""Point filters: each returns the condition under which a point is kept.

Ranges of coordinates are half open, ranges of other attributes closed. Conditions are plain
columns, so they reach the scan. The order-aware ones need the points that came before, and so
are functions on DataFrames (see `ordered`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pointlake.functions.columns import ratio, single
from pointlake.schema import DEFAULT_SCALE, ScaleOffset

Keep = Callable[..., Column]
FILTERS: dict[str, Keep] = {}


def _add(name: str, keep: Keep) -> None:
    FILTERS[name] = keep


def xyz(axis: str, scaling: ScaleOffset = DEFAULT_SCALE) -> Column:
    return scaling.real(axis)


def _within(value: Column, low: float, high: float) -> Column:
    return (value >= low) & (value < high)


def keep_tile(llx: float, lly: float, size: float) -> Column:
    llx, lly, size = single(llx), single(lly), single(size)
    return _within(xyz("x"), llx, single(llx + size)) & _within(xyz("y"), lly, single(lly + size))


def keep_circle(cx: float, cy: float, radius: float) -> Column:
    dx, dy = xyz("x") - cx, xyz("y") - cy
    box = _within(xyz("x"), cx - radius, cx + radius) & _within(xyz("y"), cy - radius, cy + radius)
    return box & (dx * dx + dy * dy < radius * radius)


def keep_xy(min_x: float, min_y: float, max_x: float, max_y: float) -> Column:
    return _within(xyz("x"), min_x, max_x) & _within(xyz("y"), min_y, max_y)


def keep_xyz(min_x: float, min_y: float, min_z: float, max_x: float, max_y: float, max_z: float) -> Column:
    return keep_xy(min_x, min_y, max_x, max_y) & _within(xyz("z"), min_z, max_z)


for _name, _f in (("keep_tile", keep_tile), ("keep_circle", keep_circle), ("keep_xy", keep_xy), ("keep_xyz", keep_xyz)):
    _add(_name, _f)
_add("drop_xy", lambda *a: ~keep_xy(*a))
_add("drop_xyz", lambda *a: ~keep_xyz(*a))
_add("inside_tile", keep_tile)
_add("inside_circle", keep_circle)
_add("inside_rectangle", keep_xy)
for _axis in "xyz":
    _add(f"keep_{_axis}", lambda low, high, a=_axis: _within(xyz(a), low, high))
    _add(f"drop_{_axis}", lambda low, high, a=_axis: ~_within(xyz(a), low, high))
    _add(f"drop_{_axis}_below", lambda v, a=_axis: xyz(a) >= v)
    _add(f"drop_{_axis}_above", lambda v, a=_axis: xyz(a) < v)
    _add(f"keep_{_axis}_raw", lambda low, high, a=_axis: _within(F.col(f"{a}i"), low, high))
    _add(f"drop_{_axis}_raw", lambda low, high, a=_axis: ~_within(F.col(f"{a}i"), low, high))
    _add(f"drop_{_axis}_raw_below", lambda v, a=_axis: F.col(f"{a}i") >= v)
    _add(f"drop_{_axis}_raw_above", lambda v, a=_axis: F.col(f"{a}i") < v)
_add("keep_z_above", lambda v: xyz("z") >= v)
_add("keep_z_below", lambda v: xyz("z") < v)
_add("keep_z_raw_above", lambda v: F.col("zi") >= v)
_add("keep_z_raw_below", lambda v: F.col("zi") < v)
_add("clip_z_below", lambda v: xyz("z") >= v)
_add("clip_z_above", lambda v: xyz("z") < v)
_add("keep_xy_raw", lambda a, b, c, d: _within(F.col("xi"), a, c) & _within(F.col("yi"), b, d))



def _rn() -> tuple[Column, Column]:
    return F.col("return_number"), F.col("number_of_returns")


def _by_return(name: str, keep: Callable[[Column, Column], Column]) -> None:
    _add(name, lambda: keep(*_rn()))


_by_return("keep_first", lambda r, n: r <= 1)
_by_return("keep_first_of_many", lambda r, n: (n != 1) & (r <= 1))
_by_return("keep_middle", lambda r, n: (r != 1) & (r < n))
_by_return("keep_last", lambda r, n: r >= n)
_by_return("keep_last_of_many", lambda r, n: (r != 1) & (r >= n))
_by_return("keep_second_last", lambda r, n: (n > 1) & (r == n - 1))
_by_return("drop_first", lambda r, n: r != 1)
_by_return("drop_first_of_many", lambda r, n: ~((n > 1) & (r == 1)))
_by_return("drop_middle", lambda r, n: ~((r > 1) & (r < n)))
_by_return("drop_last", lambda r, n: r < n)
_by_return("drop_last_of_many", lambda r, n: ~((n > 1) & (r >= n)))
_by_return("drop_second_last", lambda r, n: ~((n > 1) & (r == n - 1)))
_by_return("first_only", lambda r, n: r <= 1)
_by_return("last_only", lambda r, n: r >= n)


def bits(mask: int, width: int) -> list[int]:
    """The numbers whose bits are set."""
    return [b for b in range(width) if mask >> b & 1]


def _set_filters(name: str, column: str, width: int) -> None:
    _add(f"keep_{name}", lambda *values: F.col(column).isin(*values))
    _add(f"drop_{name}", lambda *values: ~F.col(column).isin(*values))
    _add(f"keep_{name}_mask", lambda mask: F.col(column).isin(*bits(mask, width)))
    _add(f"drop_{name}_mask", lambda mask: ~F.col(column).isin(*bits(mask, width)))


_set_filters("return", "return_number", 16)
_set_filters("class", "classification", 32)
_set_filters("extended_class", "ext_classification", 256)
_add("keep_number_of_returns", lambda k: F.col("number_of_returns") == k)
_add("drop_number_of_returns", lambda k: F.col("number_of_returns") != k)
for _k, _name in enumerate(("single", "double", "triple", "quadruple", "quintuple"), 1):
    _add(f"keep_{_name}", lambda k=_k: F.col("number_of_returns") == k)
    _add(f"drop_{_name}", lambda k=_k: F.col("number_of_returns") != k)
_add("drop_scan_direction", lambda d: F.col("scan_direction_flag") != d)
_add("keep_edge_of_flight_line", lambda: F.col("edge_of_flight_line") != 0)
_add("keep_scanner_channel", lambda c: F.col("scanner_channel") == c)
_add("drop_scanner_channel", lambda c: F.col("scanner_channel") != c)
for _channel in ("red", "green", "blue", "nir"):
    _add(f"keep_RGB_{_channel}", lambda low, high, c=_channel: F.col(c).between(low, high))
    _add(f"drop_RGB_{_channel}", lambda low, high, c=_channel: ~F.col(c).between(low, high))


def _ndvi(name: str, near: str, visible: str) -> None:
    def keep(low: float, high: float) -> Column:
        """0 / 0 compares with nothing and so stays."""
        return F.coalesce(ratio(F.col(near), F.col(visible)).between(low, high), F.lit(True))

    _add(name, keep)


_ndvi("keep_NDVI", "nir", "red")
_ndvi("keep_NDVI_green_is_NIR", "green", "red")
_ndvi("keep_NDVI_blue_is_NIR", "blue", "red")
_ndvi("keep_NDVI_from_CIR", "red", "green")
_ndvi("keep_NDVI_intensity_is_NIR", "intensity", "red")

_angle = "scan_angle_rank"
_add("keep_scan_angle", lambda low, high: F.col(_angle).between(low, high))
_add("drop_scan_angle_below", lambda v: F.col(_angle) >= v)
_add("drop_scan_angle_above", lambda v: F.col(_angle) <= v)
_add("drop_scan_angle_between", lambda low, high: ~F.col(_angle).between(low, high))
_add("drop_abs_scan_angle_above", lambda v: F.col(_angle).between(-v, v))
_add("drop_abs_scan_angle_below", lambda v: ~F.col(_angle).between(-v + 1, v - 1))


def _ranges(name: str, column: str, equal: bool = True) -> None:
    if equal:
        _add(f"keep_{name}", lambda v: F.col(column) == v)
        _add(f"drop_{name}", lambda v: F.col(column) != v)
    _add(f"keep_{name}_below", lambda v: F.col(column) < v)
    _add(f"keep_{name}_above", lambda v: F.col(column) > v)
    _add(f"keep_{name}_between", lambda low, high: F.col(column).between(low, high))
    _add(f"drop_{name}_below", lambda v: F.col(column) >= v)
    _add(f"drop_{name}_above", lambda v: F.col(column) <= v)
    _add(f"drop_{name}_between", lambda low, high: ~F.col(column).between(low, high))


_ranges("intensity", "intensity", equal=False)
_add("keep_intensity", FILTERS["keep_intensity_between"])
_ranges("user_data", "user_data")
_ranges("point_source", "point_source_id")
for _flag in ("synthetic", "keypoint", "withheld", "overlap"):
    _add(f"keep_{_flag}", lambda f=_flag: F.col(f"{f}_flag") == 1)
    _add(f"drop_{_flag}", lambda f=_flag: F.col(f"{f}_flag") == 0)


def _timeless(keep: Column) -> Column:
    """Points without a time always stay."""
    return F.col("gps_time").isNull() | keep


_add("keep_gps_time", lambda low, high: _timeless(F.col("gps_time").between(low, high)))
_add("keep_gps_time_above", lambda t: _timeless(F.col("gps_time") >= t))
_add("keep_gps_time_below", lambda t: _timeless(F.col("gps_time") <= t))
_add("drop_gps_time_below", lambda t: _timeless(F.col("gps_time") >= t))
_add("drop_gps_time_above", lambda t: _timeless(F.col("gps_time") <= t))
_add("drop_gps_time_between", lambda low, high: _timeless(~F.col("gps_time").between(low, high)))
_add("keep_wavepacket", lambda i: F.col("wave_index") == i)
_add("drop_wavepacket", lambda i: F.col("wave_index") != i)


def _attr(index: int) -> Column:
    return F.col(f"attr_{index}")


_add("keep_attribute_below", lambda i, v: _attr(i) < v)
_add("keep_attribute_above", lambda i, v: _attr(i) > v)
_add("keep_attribute_between", lambda i, low, high: _attr(i).between(low, high))
_add("drop_attribute_below", lambda i, v: _attr(i) >= v)
_add("drop_attribute_above", lambda i, v: _attr(i) <= v)
_add("drop_attribute_between", lambda i, low, high: ~_attr(i).between(low, high))


def filter_and(first: Column, second: Column) -> Column:
    """The point is dropped only if both would drop it."""
    return first | second


def filter_or(first: Column, second: Column) -> Column:
    """The point is dropped if either would drop it."""
    return first & second
