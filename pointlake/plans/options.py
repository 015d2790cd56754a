"""Command-line style options as a list of steps on a DataFrame.

`run_options(points, "-keep_class 2 6 -drop_z_below 10 -translate_z 1.5")`: filters first, in
their order, then transforms. filter_and and filter_or take the last two filters. With
filtered_transform the filters drop nothing but choose the points that are transformed.
"""

from __future__ import annotations

import shlex

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointlake.operators.filters import FILTERS, filter_and, filter_or
from pointlake.operators.ordered import ORDERED
from pointlake.operators.transforms import TRANSFORMS

#: Other spellings of the options. Raw coordinates are written in capitals.
SPELLINGS = {
    "keep_classification": "keep_class", "drop_classification": "drop_class", "keep_gpstime": "keep_gps_time",
    "keep_classification_mask": "keep_class_mask", "drop_classification_mask": "drop_class_mask",
    "keep_extended_classification": "keep_extended_class", "drop_extended_classification": "drop_extended_class",
    "keep_gps_time_between": "keep_gps_time", "keep_gpstime_between": "keep_gps_time",
    "keep_gpstime_above": "keep_gps_time_above", "keep_gpstime_below": "keep_gps_time_below",
    "drop_gpstime_above": "drop_gps_time_above", "drop_gpstime_below": "drop_gps_time_below",
    "drop_gpstime_between": "drop_gps_time_between", "keep_scan_angle_between": "keep_scan_angle",
    "keep_XY": "keep_xy_raw", "keep_X": "keep_x_raw", "keep_Y": "keep_y_raw", "keep_Z": "keep_z_raw",
    "drop_X": "drop_x_raw", "drop_Y": "drop_y_raw", "drop_Z": "drop_z_raw",
    "keep_Z_above": "keep_z_raw_above", "keep_Z_below": "keep_z_raw_below",
    "drop_X_below": "drop_x_raw_below", "drop_X_above": "drop_x_raw_above",
    "drop_Y_below": "drop_y_raw_below", "drop_Y_above": "drop_y_raw_above",
    "drop_Z_below": "drop_z_raw_below", "drop_Z_above": "drop_z_raw_above", "inside": "inside_rectangle",
    "set_extended_overlap_flag": "set_overlap_flag", "set_extended_scanner_channel": "set_scanner_channel",
    "change_extended_classification_from_to": "change_classification_from_to",
    "scale_rgb": "scale_RGB", "scale_rgb_down": "scale_RGB_down", "scale_rgb_up": "scale_RGB_up",
}


def _value(word: str) -> int | float | str:
    for kind in (int, float):
        try:
            return kind(word)
        except ValueError:
            pass
    return word


def _grouped(options: str) -> list[tuple[str, list]]:
    out: list[tuple[str, list]] = []
    for word in shlex.split(options):
        if word.startswith("-") and isinstance(_value(word), str):
            out.append((SPELLINGS.get(word[1:], word[1:]), []))
        elif not out:
            raise ValueError(f"{word} follows no option")
        else:
            out[-1][1].append(_value(word))
    return out


def run_options(points: DataFrame, options: str) -> DataFrame:
    """points after the filters and then the transforms that options name."""
    steps = _grouped(options)
    only_choose = any(name == "filtered_transform" for name, _ in steps)
    keeps: list[tuple[str, object]] = []
    for name, args in steps:
        if name in FILTERS:
            keep = FILTERS[name](*args)
            if name == "keep_class" and keeps and keeps[-1][0] == name:  # neighbours are one set of classes
                keep = keeps.pop()[1] | keep
            keeps.append((name, keep))
        elif name in ORDERED:
            keeps.append((name, (ORDERED[name], args)))
        elif name in ("filter_and", "filter_or"):
            if len(keeps) < 2 or not all(isinstance(k, Column) for _, k in keeps[-2:]):
                raise ValueError(f"{name} takes two filters that look at single points")
            second, first = keeps.pop()[1], keeps.pop()[1]
            keeps.append((name, (filter_and if name == "filter_and" else filter_or)(first, second)))
        elif name not in TRANSFORMS and name != "filtered_transform":
            raise ValueError(f"unknown option -{name}")
    transforms = [(TRANSFORMS[name], args) for name, args in steps if name in TRANSFORMS]
    if only_choose:
        chosen = F.lit(True)
        for name, keep in keeps:
            if not isinstance(keep, Column):
                raise ValueError(f"-{name} can't choose points for -filtered_transform")
            chosen = chosen & keep
        points = points.withColumn("__chosen", F.coalesce(chosen, F.lit(False)))
        before = [c for c in points.columns if c != "__chosen"]
        for transform, args in transforms:
            points = transform(points.withColumns({f"__was_{c}": F.col(c) for c in before}), *args)
            points = points.withColumns({c: F.when(F.col("__chosen"), F.col(c)).otherwise(F.col(f"__was_{c}")) for c in before})
            points = points.drop(*[f"__was_{c}" for c in before])
        return points.drop("__chosen")
    for _, keep in keeps:
        points = points.where(keep) if isinstance(keep, Column) else keep[0](points, *keep[1])
    for transform, args in transforms:
        points = transform(points, *args)
    return points
