"""Coordinate reference systems: EPSG codes, GeoKeys, WKT, PROJ strings and options, all brought to one description and applied as columns.

There are no datum shifts: a system is an ellipsoid, a projection with its parameters, and a unit.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointlake.functions import projections as proj
from pointlake.functions.projections import ELLIPSOIDS, WGS84, Ellipsoid
from pointlake.operators.filters import xyz
from pointlake.schema import DEFAULT_SCALE, ScaleOffset

#: Metres a unit.
UNITS = {"metre": 1.0, "meter": 1.0, "meters": 1.0, "m": 1.0, "foot": 0.3048, "feet": 0.3048, "ft": 0.3048, "us-ft": 1200 / 3937, "survey_feet": 1200 / 3937, "us_survey_foot": 1200 / 3937}
#: Units and ellipsoids by their codes.
UNIT_CODES = {9001: 1.0, 9002: 0.3048, 9003: 1200 / 3937}
ELLIPSOID_CODES = {7030: "wgs84", 7019: "grs80", 7008: "clarke1866", 7001: "airy", 7004: "bessel", 7022: "international", 7024: "krassowsky", 7043: "wgs72", 7003: "australian"}
#: Names of ellipsoids in PROJ strings, and of the datums that stand for one.
PROJ_ELLIPSOIDS = {"WGS84": "wgs84", "GRS80": "grs80", "clrk66": "clarke1866", "airy": "airy", "bessel": "bessel", "intl": "international", "krass": "krassowsky", "WGS72": "wgs72", "aust_SA": "australian"}
PROJ_DATUMS = {"WGS84": "wgs84", "NAD83": "grs80", "NAD27": "clarke1866", "OSGB36": "airy"}
#: Geographic systems.
GEOGRAPHIC = {4326: "wgs84", 4979: "wgs84", 4269: "grs80", 4258: "grs80", 4283: "grs80", 4167: "grs80", 4171: "grs80", 4267: "clarke1866", 4277: "airy", 4314: "bessel", 4289: "bessel", 4149: "bessel", 4322: "wgs72", 4230: "international"}


@dataclass(frozen=True)
class ReferenceSystem:
    """kind: longlat, ecef, tm, lcc, aeac, hom (natural origin), homc (centre) or os; parameters as the functions of `projections` take them, lengths in metres."""

    kind: str = "longlat"
    parameters: tuple[float, ...] = ()
    ellipsoid: Ellipsoid = WGS84
    unit: float = 1.0
    shift: tuple[float, float] = field(default=(0.0, 0.0))  # false easting and northing, in metres

    def from_lonlat(self, lon: Column, lat: Column, height: Column) -> tuple[Column, Column, Column]:
        if self.kind == "longlat":
            return lon, lat, height
        if self.kind == "ecef":
            return proj.to_ecef(lon, lat, height, self.ellipsoid)
        x, y = self._functions()[0](lon, lat, *self.parameters, *self.shift, self.ellipsoid, *self._more())
        return x / self.unit, y / self.unit, height

    def to_lonlat(self, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
        if self.kind == "longlat":
            return x, y, z
        if self.kind == "ecef":
            return proj.from_ecef(x, y, z, self.ellipsoid)
        lon, lat = self._functions()[1](x * self.unit, y * self.unit, *self.parameters, *self.shift, self.ellipsoid, *self._more())
        return lon, lat, z

    def _functions(self) -> tuple:
        return {
            "tm": (proj.transverse_mercator, proj.inverse_transverse_mercator), "lcc": (proj.lambert_conic, proj.inverse_lambert_conic),
            "aeac": (proj.albers, proj.inverse_albers), "hom": (proj.oblique_mercator, proj.inverse_oblique_mercator),
            "homc": (proj.oblique_mercator, proj.inverse_oblique_mercator), "os": (proj.oblique_stereographic, proj.inverse_oblique_stereographic),
        }[self.kind]

    def _more(self) -> tuple:
        return (True,) if self.kind == "homc" else ()


def utm(zone: int, south: bool = False, ellipsoid: str = "wgs84") -> ReferenceSystem:
    if not 1 <= zone <= 60:
        raise ValueError(f"no UTM zone {zone}")
    return ReferenceSystem("tm", (zone * 6 - 183.0, 0.9996), ELLIPSOIDS[ellipsoid], shift=(500_000.0, 1e7 if south else 0.0))


#: Single projected systems.
PROJECTED = {
    27700: ReferenceSystem("tm", (-2.0, 0.9996012717), ELLIPSOIDS["airy"], shift=(400_000.0, 0.0)),  # its origin's latitude is below
    2154: ReferenceSystem("lcc", (3.0, 46.5, 49.0, 44.0), ELLIPSOIDS["grs80"], shift=(700_000.0, 6_600_000.0)),
    2193: ReferenceSystem("tm", (173.0, 0.9996), ELLIPSOIDS["grs80"], shift=(1_600_000.0, 10_000_000.0)),
    3005: ReferenceSystem("aeac", (-126.0, 45.0, 50.0, 58.5), ELLIPSOIDS["grs80"], shift=(1_000_000.0, 0.0)),
    3577: ReferenceSystem("aeac", (132.0, 0.0, -18.0, -36.0), ELLIPSOIDS["grs80"]),
    3347: ReferenceSystem("lcc", (-91.866_666_666_666_67, 63.390_675, 49.0, 77.0), ELLIPSOIDS["grs80"], shift=(6_200_000.0, 3_000_000.0)),
    28992: ReferenceSystem("os", (5.387_638_888_888_889, 52.156_160_555_555_56, 0.999_907_9), ELLIPSOIDS["bessel"], shift=(155_000.0, 463_000.0)),
    2056: ReferenceSystem("homc", (7.439_583_333_333_333, 46.952_405_555_555_56, 90.0, 90.0, 1.0), ELLIPSOIDS["bessel"], shift=(2_600_000.0, 1_200_000.0)),
    21781: ReferenceSystem("homc", (7.439_583_333_333_333, 46.952_405_555_555_56, 90.0, 90.0, 1.0), ELLIPSOIDS["bessel"], shift=(600_000.0, 200_000.0)),
}
_ORIGINS = {27700: (49.0, -100_000.0)}  # the latitude at which the false northing is given


def with_origin(system: ReferenceSystem, lat0: float, north: float) -> ReferenceSystem:
    """A transverse Mercator system whose northing `north` is at latitude lat0: the meridian's length up to there is taken off."""
    return replace(system, shift=(system.shift[0], north - system.parameters[1] * _meridian(lat0, system.ellipsoid)))


def _meridian(lat: float, e: Ellipsoid) -> float:
    """Metres along a meridian from the equator, by the series of the transverse Mercator projection on its central meridian."""
    import math

    radius, forward, _ = proj._series(e)
    xi = math.asin(math.tanh(proj._q(math.radians(lat), e)))
    return radius * (xi + sum(a * math.sin(2 * j * xi) for j, a in enumerate(forward, 1)))


def from_epsg(code: int) -> ReferenceSystem:
    """UTM and Gauss-Krueger zones by the rule of their codes, others from a table."""
    rules = (
        (32601, 32660, 32600, False, "wgs84"), (32701, 32760, 32700, True, "wgs84"), (26901, 26923, 26900, False, "grs80"), (25828, 25838, 25800, False, "grs80"),
        (26701, 26722, 26700, False, "clarke1866"), (28348, 28358, 28300, True, "grs80"), (3154, 3160, 3147, False, "grs80"), (32201, 32260, 32200, False, "wgs72"),
    )
    for first, last, base, south, ellipsoid in rules:
        if first <= code <= last:
            return utm(code - base, south, ellipsoid)
    if 31466 <= code <= 31469:
        zone = code - 31464
        return ReferenceSystem("tm", (zone * 3.0, 1.0), ELLIPSOIDS["bessel"], shift=(zone * 1e6 + 500_000.0, 0.0))
    if code in GEOGRAPHIC:
        return ReferenceSystem("longlat", (), ELLIPSOIDS[GEOGRAPHIC[code]])
    if code in (4978, 4328):
        return ReferenceSystem("ecef")
    if code in PROJECTED:
        return with_origin(PROJECTED[code], *_ORIGINS[code]) if code in _ORIGINS else PROJECTED[code]
    raise ValueError(f"EPSG:{code} is not known")


def _system(kind: str, e: Ellipsoid, unit: float, lon0: float, lat0: float, lat1: float | None, lat2: float | None, k: float, east: float, north: float, azimuth: float = 0.0, rectified: float | None = None) -> ReferenceSystem:
    """A system from the parameters that all spellings share; east and north in metres."""
    if kind == "tm":
        flat = ReferenceSystem("tm", (lon0, k), e, unit, (east, north))
        return with_origin(flat, lat0, north) if lat0 else flat
    if kind in ("lcc", "aeac"):
        lat1 = lat0 if lat1 is None else lat1
        return ReferenceSystem(kind, (lon0, lat0, lat1, lat1 if lat2 is None else lat2), e, unit, (east, north))
    if kind in ("hom", "homc"):
        return ReferenceSystem(kind, (lon0, lat0, azimuth, azimuth if rectified is None else rectified, k), e, unit, (east, north))
    if kind == "os":
        return ReferenceSystem("os", (lon0, lat0, k), e, unit, (east, north))
    raise ValueError(f"projection {kind!r} is not known")


def from_proj(text: str) -> ReferenceSystem:
    """A PROJ string, such as +proj=utm +zone=32 +ellps=GRS80."""
    given = dict((m[1], m[2] or "") for m in re.finditer(r"\+(\w+)(?:=(\S+))?", text))
    if "init" in given or "epsg" in text.lower() and "proj" not in given:
        return from_epsg(int(re.search(r"(\d+)", text)[1]))
    name = PROJ_ELLIPSOIDS.get(given.get("ellps", "")) or PROJ_DATUMS.get(given.get("datum", "")) or "wgs84"
    e = ELLIPSOIDS[name]
    if "a" in given and ("rf" in given or "b" in given):
        a = float(given["a"])
        e = Ellipsoid(a, float(given["rf"]) if "rf" in given else a / (a - float(given["b"])))
    num = lambda key, default=0.0: float(given.get(key, default))
    unit = float(given["to_meter"]) if "to_meter" in given else UNITS[given.get("units", "m")]
    kind = given.get("proj", "longlat")
    if kind in ("longlat", "latlong"):
        return ReferenceSystem("longlat", (), e)
    if kind == "geocent":
        return ReferenceSystem("ecef", (), e)
    if kind == "utm":
        return replace(utm(int(given["zone"]), "south" in given), ellipsoid=e, unit=unit)
    names = {"tmerc": "tm", "lcc": "lcc", "aea": "aeac", "sterea": "os", "omerc": "hom" if "no_uoff" in given or "no_off" in given else "homc", "somerc": "homc"}
    lat1, lat2 = (float(given[k]) if k in given else None for k in ("lat_1", "lat_2"))
    azimuth = 90.0 if kind == "somerc" else num("alpha")
    return _system(names[kind], e, unit, num("lonc", num("lon_0")), num("lat_0"), lat1, lat2, num("k_0", num("k", 1.0)), num("x_0"), num("y_0"), azimuth, num("gamma", azimuth))


#: Keys of parameters in GeoKeys.
_KEYS = {"lat1": (3078,), "lat2": (3079,), "lon0": (3080, 3084, 3088, 3095), "lat0": (3081, 3085, 3089), "east": (3082, 3086, 3090), "north": (3083, 3087, 3091), "k": (3092, 3093), "azimuth": (3094,), "rectified": (3096,)}
#: Projections by their codes there.
_TRANSFORMS = {1: "tm", 3: "homc", 8: "lcc", 9: "lcc", 11: "aeac", 16: "os"}


def from_geokeys(directory: bytes, doubles: bytes = b"") -> ReferenceSystem:
    """The records of GeoKeys: a directory of shorts (34735) and the doubles it points to (34736)."""
    shorts = struct.unpack(f"<{len(directory) // 2}H", directory[: len(directory) // 2 * 2])
    reals = struct.unpack(f"<{len(doubles) // 8}d", doubles[: len(doubles) // 8 * 8])
    keys: dict[int, float] = {}
    for i in range(4, min(len(shorts), 4 + 4 * shorts[3]) - 3, 4):
        key, where, _, value = shorts[i : i + 4]
        if where == 0:
            keys[key] = value
        elif where == 34736 and value < len(reals):
            keys[key] = reals[value]
    projected, geographic = int(keys.get(3072, 32767)), int(keys.get(2048, 32767))
    if keys.get(1024) == 3:
        return ReferenceSystem("ecef")
    if keys.get(1024) == 2:
        return from_epsg(geographic) if geographic != 32767 else ReferenceSystem("longlat", (), _key_ellipsoid(keys))
    unit = float(keys[3077]) if 3077 in keys else UNIT_CODES[int(keys.get(3076, 9001))]
    if projected not in (0, 32767):
        return from_epsg(projected)
    get = lambda name, default: next((float(keys[k]) for k in _KEYS[name] if k in keys), default)
    e = ELLIPSOIDS[GEOGRAPHIC[geographic]] if geographic in GEOGRAPHIC else _key_ellipsoid(keys)
    east, north = get("east", 0.0) * unit, get("north", 0.0) * unit
    kind = _TRANSFORMS[int(keys.get(3075, 1))]
    return _system(kind, e, unit, get("lon0", 0.0), get("lat0", 0.0), get("lat1", None), get("lat2", None), get("k", 1.0), east, north, get("azimuth", 0.0), get("rectified", None))


def _key_ellipsoid(keys: dict[int, float]) -> Ellipsoid:
    if 2057 in keys and (2059 in keys or 2058 in keys):
        a = keys[2057]
        return Ellipsoid(a, keys[2059] if 2059 in keys else a / (a - keys[2058]))
    return ELLIPSOIDS[ELLIPSOID_CODES.get(int(keys.get(2056, 7030)), "wgs84")]


#: Names of projections and parameters in WKT.
_WKT_KINDS = {
    "transverse_mercator": "tm", "gauss_kruger": "tm", "lambert_conformal_conic_2sp": "lcc", "lambert_conformal_conic_1sp": "lcc", "lambert_conformal_conic": "lcc",
    "albers_conic_equal_area": "aeac", "albers": "aeac", "hotine_oblique_mercator": "hom", "hotine_oblique_mercator_azimuth_center": "homc",
    "oblique_mercator": "homc", "oblique_stereographic": "os", "double_stereographic": "os",
}
_WKT_PARAMETERS = {
    "lon0": ("central_meridian", "longitude_of_center", "longitude_of_origin"), "lat0": ("latitude_of_origin", "latitude_of_center"), "lat1": ("standard_parallel_1",),
    "lat2": ("standard_parallel_2",), "k": ("scale_factor",), "east": ("false_easting",), "north": ("false_northing",), "azimuth": ("azimuth",), "rectified": ("rectified_grid_angle",),
}


def _nodes(text: str) -> Iterator[tuple[list[str], list[str]]]:
    """Every node of a WKT as (the names of the nodes around it and its own, its plain values)."""
    path, values = [], []
    for m in re.finditer(r'(\w+)\s*[\[(]|"([^"]*)"|([-+.\w]+)|([\])])', text):
        opened, quoted, plain, closed = m.groups()
        if opened:
            path.append(opened.upper())
            values.append([])
        elif closed and path:
            yield list(path), values.pop()
            path.pop()
        elif values:
            values[-1].append(quoted if quoted is not None else plain)


def from_wkt(text: str) -> ReferenceSystem:
    """The first form of WKT (PROJCS, GEOGCS, GEOCCS, also in COMPD_CS)."""
    found, e, unit, kind, code, parameters = set(), WGS84, 1.0, None, None, {}
    for path, values in _nodes(text):
        name = path[-1]
        found.add(name)
        if name == "SPHEROID":
            e = Ellipsoid(float(values[1]), float(values[2]) or float("inf"))
        elif name == "UNIT" and path[-2] in ("PROJCS", "GEOCCS"):
            unit = float(values[1])
        elif name == "PROJECTION":
            kind = _WKT_KINDS.get(values[0].lower().replace(" ", "_"))
            if kind is None:
                raise ValueError(f"projection {values[0]!r} is not known")
        elif name == "PARAMETER":
            parameters[values[0].lower().replace(" ", "_")] = float(values[1])
        elif name == "AUTHORITY" and path[-2] == "PROJCS":
            code = values[1]
    if "PROJCS" not in found:
        if "GEOCCS" in found:
            return ReferenceSystem("ecef", (), e)
        if "GEOGCS" not in found:
            raise ValueError("no reference system in the text")
        return ReferenceSystem("longlat", (), e)
    if kind is None:
        return from_epsg(int(code or 0))
    get = lambda name, default: next((parameters[p] for p in _WKT_PARAMETERS[name] if p in parameters), default)
    return _system(kind, e, unit, get("lon0", 0.0), get("lat0", 0.0), get("lat1", None), get("lat2", None), get("k", 1.0), get("east", 0.0) * unit, get("north", 0.0) * unit, get("azimuth", 0.0), get("rectified", None))


def from_options(text: str) -> ReferenceSystem:
    """The options' spellings: -epsg 25832, -utm 32T or 32north, -longlat, -ecef, -tm and -lcc and -aeac with their numbers, -ellipsoid names before them."""
    words, e, at = text.split(), WGS84, 0
    while at < len(words):
        word = words[at].lower().removeprefix("-").removeprefix("target_")
        rest = words[at + 1 :]
        if word in ("wgs84", "grs80", "wgs72") or word in ("nad27", "nad83", "osgb1936", "etrs89", "gda94"):
            e = ELLIPSOIDS[{"nad27": "clarke1866", "nad83": "grs80", "osgb1936": "airy", "etrs89": "grs80", "gda94": "grs80"}.get(word, word)]
            at += 1
            continue
        if word in ("longlat", "latlong"):
            return ReferenceSystem("longlat", (), e)
        if word == "ecef":
            return ReferenceSystem("ecef", (), e)
        if word == "epsg":
            return from_epsg(int(rest[0]))
        if word == "utm":
            zone, band = re.fullmatch(r"(\d+)(\w*)", rest[0]).groups()
            south = band.lower() == "south" or (len(band) == 1 and band.upper() < "N")
            return replace(utm(int(zone), south), ellipsoid=e)
        if word in ("tm", "lcc", "aeac"):
            east, north, unit = float(rest[0]), float(rest[1]), UNITS[rest[2].lower()]
            lat0, lon0, first, *more = (float(v) for v in rest[3 : 6 if word == "tm" else 7])
            if word == "tm":
                return _system("tm", e, unit, lon0, lat0, None, None, first, east * unit, north * unit)
            return _system(word, e, unit, lon0, lat0, first, more[0], 1.0, east * unit, north * unit)
        raise ValueError(f"option {words[at]!r} is not known")
    raise ValueError("no projection among the options")


def of_header(records: list[tuple[str, int, bytes]]) -> ReferenceSystem | None:
    """The system that a LAS file's records (user_id, record_id, data) name: WKT first, then GeoKeys; None without either."""
    by = {number: data for user, number, data in records if user == "LASF_Projection"}
    if 2112 in by and by[2112].strip(b"\0 "):
        return from_wkt(by[2112].split(b"\0")[0].decode("utf-8", "replace"))
    return from_geokeys(by[34735], by.get(34736, b"")) if 34735 in by else None


def reproject(points: DataFrame, source: ReferenceSystem, target: ReferenceSystem, to: ScaleOffset | None = None, scaling: ScaleOffset = DEFAULT_SCALE) -> DataFrame:
    """points with x, y and z in the target system, and xi, yi and zi in steps of `to` (1e-7 degrees for longitude and latitude, else the library's own)."""
    to = to or (ScaleOffset((1e-7, 1e-7, scaling.scale[2])) if target.kind == "longlat" else DEFAULT_SCALE)
    between = ("__lon", "__lat", "__h")  # columns of their own, as the way on uses each many times
    known = points.withColumns(dict(zip(between, source.to_lonlat(*(xyz(a, scaling) for a in "xyz")), strict=True)))
    real = known.withColumns(dict(zip(("__x", "__y", "__z"), target.from_lonlat(*map(F.col, between)), strict=True))).drop(*between)
    raw = real.withColumns({f"{a}i": to.raw(a, F.col(f"__{a}")) for a in "xyz"} | {a: F.col(f"__{a}") for a in "xyz"})
    return raw.drop("__x", "__y", "__z")
