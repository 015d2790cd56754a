"""Map projections as columns: everything stays inside generated code.

Transverse Mercator by Krueger's series to the sixth order of the third flattening (there and back again agree to 1e-8
degrees, but not near the two places on the equator a quarter turn from the central meridian), Lambert conformal conic and Albers
equal area with two parallels, and earth-centred coordinates. Angles are degrees, lengths metres.
Longitudes are taken within half a turn of the central one. Of a latitude beyond a pole only its sine counts.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Ellipsoid:
    a: float
    inverse_flattening: float

    @property
    def f(self) -> float:
        return 1 / self.inverse_flattening

    @property
    def e2(self) -> float:
        return self.f * (2 - self.f)


#: Semi-major axis and inverse flattening.
ELLIPSOIDS = {
    "wgs84": Ellipsoid(6378137.0, 298.257223563), "grs80": Ellipsoid(6378137.0, 298.257222101), "wgs72": Ellipsoid(6378135.0, 298.26),
    "clarke1866": Ellipsoid(6378206.4, 294.9786982), "airy": Ellipsoid(6377563.396, 299.3249646), "bessel": Ellipsoid(6377397.155, 299.1528128),
    "international": Ellipsoid(6378388.0, 297.0), "krassowsky": Ellipsoid(6378245.0, 298.3), "clarke1880": Ellipsoid(6378249.145, 293.465),
    "everest1967": Ellipsoid(6377298.556, 300.8017), "australian": Ellipsoid(6378160.0, 298.25),
}
WGS84 = ELLIPSOIDS["wgs84"]


def _series(e: Ellipsoid) -> tuple[float, list[float], list[float]]:
    """Radius and coefficients, forward and back, by the third flattening."""
    n = e.f / (2 - e.f)
    radius = e.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)
    forward = [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180 - 127 * n**5 / 288 + 7891 * n**6 / 37800,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440 + 281 * n**5 / 630 - 1983433 * n**6 / 1935360,
        61 * n**3 / 240 - 103 * n**4 / 140 + 15061 * n**5 / 26880 + 167603 * n**6 / 181440,
        49561 * n**4 / 161280 - 179 * n**5 / 168 + 6601661 * n**6 / 7257600,
        34729 * n**5 / 80640 - 3418889 * n**6 / 1995840,
        212378941 * n**6 / 319334400,
    ]
    back = [
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360 - 81 * n**5 / 512 + 96199 * n**6 / 604800,
        n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440 + 46 * n**5 / 105 - 1118711 * n**6 / 3870720,
        17 * n**3 / 480 - 37 * n**4 / 840 - 209 * n**5 / 4480 + 5569 * n**6 / 90720,
        4397 * n**4 / 161280 - 11 * n**5 / 504 - 830251 * n**6 / 7257600,
        4583 * n**5 / 161280 - 108847 * n**6 / 3991680,
        20648693 * n**6 / 638668800,
    ]
    return radius, forward, back


def upright(lat: Column) -> Column:
    """A latitude beyond a pole as the one with the same sine; others as they are."""
    return F.when(F.abs(lat) <= 90, lat).otherwise(90.0 - F.abs(F.pmod(lat + 90.0, F.lit(360.0)) - 180.0))


def _east_of(lon: Column, lon0: float | Column) -> Column:
    """lon - lon0 within half a turn."""
    d = lon - lon0
    return F.when(F.abs(d) <= 180, d).otherwise(F.pmod(d + 180.0, F.lit(360.0)) - 180.0)


def apart(lon: Column, lat: Column, lon2: Column, lat2: Column) -> Column:
    """How far two near places are apart, northward or eastward, in degrees of a great circle; lat2 lies between the poles."""
    return F.greatest(F.abs(F.pmod(lon2 - lon + 180.0, F.lit(360.0)) - 180.0) * F.cos(F.radians(upright(lat))), F.abs(lat2 - upright(lat)))


def _colatitude(lat: Column) -> Column:
    """The angle (radians) from the nearer pole."""
    return F.radians(90.0 - F.abs(upright(lat)))


def _slope_psi(p: Column) -> Column:
    """The isometric latitude on a sphere, exact near the poles as well."""
    return F.log(F.tan(math.pi / 4 + p / 2))


def _psi(lat: Column, e: Ellipsoid) -> Column:
    """The isometric latitude."""
    k = math.sqrt(e.e2)
    return _slope_psi(F.radians(upright(lat))) - k * F.atanh(k * F.sin(F.radians(lat)))


def _latitude(t: Column, e: Ellipsoid, rounds: int = 6) -> Column:
    """Latitude (radians) from the isometric one, by repeated substitution."""
    k = math.sqrt(e.e2)
    lat = F.atan(F.sinh(t))
    for _ in range(rounds):
        lat = F.atan(F.sinh(t + k * F.atanh(k * F.sin(lat))))
    return lat


def transverse_mercator(lon: Column, lat: Column, lon0: float, k0: float = 0.9996, east: float = 500000.0, north: float = 0.0, e: Ellipsoid = WGS84) -> tuple[Column, Column]:
    radius, forward, _ = _series(e)
    t, d = F.sinh(_psi(lat, e)), F.radians(_east_of(lon, lon0))
    xi, eta = F.atan2(t, F.cos(d)), F.asinh(F.sin(d) / F.sqrt(t * t + F.cos(d) * F.cos(d)))
    x, y = eta, xi
    for j, a in enumerate(forward, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return east + k0 * radius * x, north + k0 * radius * y


def inverse_transverse_mercator(x: Column, y: Column, lon0: float, k0: float = 0.9996, east: float = 500000.0, north: float = 0.0, e: Ellipsoid = WGS84) -> tuple[Column, Column]:
    radius, _, back = _series(e)
    xi, eta = (y - north) / (k0 * radius), (x - east) / (k0 * radius)
    xi0, eta0 = xi, eta
    for j, b in enumerate(back, 1):
        xi0 = xi0 - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta0 = eta0 - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    slope = F.sin(xi0) / F.hypot(F.sinh(eta0), F.cos(xi0))
    return lon0 + F.degrees(F.atan2(F.sinh(eta0), F.cos(xi0))), F.degrees(_latitude(_slope_psi(F.atan(slope)), e))


def utm(lon: Column, lat: Column, zone: int, south: bool = False, e: Ellipsoid = WGS84) -> tuple[Column, Column]:
    return transverse_mercator(lon, lat, zone * 6 - 183.0, north=1e7 if south else 0.0, e=e)


def inverse_utm(x: Column, y: Column, zone: int, south: bool = False, e: Ellipsoid = WGS84) -> tuple[Column, Column]:
    return inverse_transverse_mercator(x, y, zone * 6 - 183.0, north=1e7 if south else 0.0, e=e)


def _q(lat: float, e: Ellipsoid) -> float:
    k = math.sqrt(e.e2)
    return math.atanh(math.sin(lat)) - k * math.atanh(k * math.sin(lat))


def _m(lat: float, e: Ellipsoid) -> float:
    return math.cos(lat) / math.sqrt(1 - e.e2 * math.sin(lat) ** 2)


def _lambert(lat0: float, lat1: float, lat2: float, e: Ellipsoid) -> tuple[float, float, float]:
    p0, p1, p2 = map(math.radians, (lat0, lat1, lat2))
    n = math.sin(p1) if lat1 == lat2 else (math.log(_m(p1, e)) - math.log(_m(p2, e))) / (_q(p2, e) - _q(p1, e))
    f = _m(p1, e) * math.exp(n * _q(p1, e)) / n
    return n, f, e.a * f * math.exp(-n * _q(p0, e))


def lambert_conic(lon: Column, lat: Column, lon0: float, lat0: float, lat1: float, lat2: float, east: float = 0.0, north: float = 0.0, e: Ellipsoid = WGS84) -> tuple[Column, Column]:
    n, f, r0 = _lambert(lat0, lat1, lat2, e)
    r = e.a * f * F.exp(-n * _psi(lat, e))
    angle = n * F.radians(_east_of(lon, lon0))
    return east + r * F.sin(angle), north + r0 - r * F.cos(angle)


def inverse_lambert_conic(x: Column, y: Column, lon0: float, lat0: float, lat1: float, lat2: float, east: float = 0.0, north: float = 0.0, e: Ellipsoid = WGS84) -> tuple[Column, Column]:
    n, f, r0 = _lambert(lat0, lat1, lat2, e)
    dx, dy = x - east, r0 - (y - north)
    sign = 1.0 if n > 0 else -1.0
    r = sign * F.sqrt(dx * dx + dy * dy)
    t = -F.log(r / (e.a * f)) / n
    return lon0 + F.degrees(F.atan2(sign * dx, sign * dy) / n), F.degrees(_latitude(t, e))


def _authalic(lat: float, e: Ellipsoid) -> float:
    k, s = math.sqrt(e.e2), math.sin(lat)
    return (1 - e.e2) * (s / (1 - e.e2 * s * s) + math.atanh(k * s) / k)


def albers(lon: Column, lat: Column, lon0: float, lat0: float, lat1: float, lat2: float, east: float = 0.0, north: float = 0.0, e: Ellipsoid = WGS84) -> tuple[Column, Column]:
    p0, p1, p2 = map(math.radians, (lat0, lat1, lat2))
    n = (_m(p1, e) ** 2 - _m(p2, e) ** 2) / (_authalic(p2, e) - _authalic(p1, e)) if lat1 != lat2 else math.sin(p1)
    c = _m(p1, e) ** 2 + n * _authalic(p1, e)
    pole = math.copysign(_authalic(math.pi / 2, e), n)
    # what is left to the cone's pole: near it q itself says little
    rest = F.when(F.sin(F.radians(lat)) * n >= 0, _rest(2 * F.pow(F.sin(_colatitude(lat) / 2), F.lit(2.0)), e, F.atanh)).otherwise(abs(pole) + F.abs(_authalic_of(F.sin(F.radians(lat)), e)))
    r, r0, angle = e.a * F.sqrt(c - n * pole + abs(n) * rest) / n, e.a * math.sqrt(c - n * _authalic(p0, e)) / n, n * F.radians(_east_of(lon, lon0))
    return east + r * F.sin(angle), north + r0 - r * F.cos(angle)


def _authalic_of(s: Column, e: Ellipsoid) -> Column:
    k = math.sqrt(e.e2)
    return (1 - e.e2) * (s / (1 - e.e2 * s * s) + F.atanh(k * s) / k)


def _rest(u: Column | float, e: Ellipsoid, atanh: Callable = math.atanh) -> Column | float:
    """What the authalic function lacks to its value at the pole, from 1 less the latitude's sine."""
    k, s = math.sqrt(e.e2), 1 - u
    return (1 - e.e2) * (u * (1 + e.e2 * s) / ((1 - e.e2) * (1 - e.e2 * s * s)) + atanh(k * u / (1 - e.e2 * s)) / k)


def inverse_albers(x: Column, y: Column, lon0: float, lat0: float, lat1: float, lat2: float, east: float = 0.0, north: float = 0.0, e: Ellipsoid = WGS84) -> tuple[Column, Column]:
    p0, p1, p2 = map(math.radians, (lat0, lat1, lat2))
    n = (_m(p1, e) ** 2 - _m(p2, e) ** 2) / (_authalic(p2, e) - _authalic(p1, e)) if lat1 != lat2 else math.sin(p1)
    c = _m(p1, e) ** 2 + n * _authalic(p1, e)
    k, sign = math.sqrt(e.e2), 1.0 if n > 0 else -1.0
    dx, dy = sign * (x - east), sign * (e.a * math.sqrt(c - n * _authalic(p0, e)) / n - (y - north))
    q = (c - (dx * dx + dy * dy) * (n / e.a) ** 2) / n
    pole = _authalic(math.pi / 2, e)
    beta = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), q / pole)))  # the authalic latitude
    e2, e4, e6 = e.e2, e.e2**2, e.e2**3
    lat = beta + (e2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * F.sin(2 * beta) + (23 * e4 / 360 + 251 * e6 / 3780) * F.sin(4 * beta) + 761 * e6 / 45360 * F.sin(6 * beta)
    s = F.sin(lat)
    w = 1 - e2 * s * s
    lat = lat + F.when(F.cos(lat) > 1e-9, w * w / (2 * F.cos(lat)) * (q / (1 - e2) - s / w - F.atanh(k * s) / k)).otherwise(0.0)
    left = ((dx * dx + dy * dy) * (n / e.a) ** 2 - (c - abs(n) * pole)) / abs(n)  # to the cone's pole
    sines = [(1 - math.cos(math.pi * (k + 0.5) / 12)) * 0.015 for k in range(12)]  # 1 less the sine over it, as a polynomial
    rests = [_rest(u, e) for u in sines]
    ratio = np.polynomial.polynomial.polyfit(rests, [u / r for u, r in zip(sines, rests, strict=True)], 4).tolist()
    over = F.lit(0.0)
    for v in reversed(ratio):
        over = over * left + v
    near = F.when(left < 0.02 * pole, sign * (math.pi / 2 - 2 * F.asin(F.sqrt(F.greatest(F.lit(0.0), left * over) / 2)))).otherwise(lat)
    return lon0 + F.degrees(F.atan2(dx, dy) / n), F.degrees(near)


@dataclass(frozen=True)
class _Oblique:
    """What an oblique Mercator projection needs: a conformal sphere (a, b), and the great circle through the centre, by g and lon0."""

    a: float
    b: float
    h: float
    g: float
    lon0: float
    shift: float

    @staticmethod
    def of(lon_c: float, lat_c: float, azimuth: float, k: float, e: Ellipsoid, centred: bool) -> _Oblique:
        p, az, sin = math.radians(lat_c), math.radians(azimuth), math.sin(math.radians(lat_c))
        b = math.sqrt(1 + e.e2 * math.cos(p) ** 4 / (1 - e.e2))
        a = e.a * b * k * math.sqrt(1 - e.e2) / (1 - e.e2 * sin * sin)
        d = max(b * math.sqrt(1 - e.e2) / (math.cos(p) * math.sqrt(1 - e.e2 * sin * sin)), 1.0)
        f = d + math.copysign(math.sqrt(d * d - 1), lat_c)
        h = f * math.exp(-b * _q(p, e))
        g = math.asin(max(-1.0, min(1.0, math.sin(az) / d)))
        lon0 = math.radians(lon_c) - math.asin(max(-1.0, min(1.0, (f - 1 / f) / 2 * math.tan(g)))) / b
        u = math.copysign(a / b * math.atan2(math.sqrt(d * d - 1), math.cos(az)), lat_c) if abs(azimuth) != 90 else a * (math.radians(lon_c) - lon0)
        return _Oblique(a, b, h, g, lon0, u if centred else 0.0)


def oblique_mercator(
    lon: Column, lat: Column, lon_c: float, lat_c: float, azimuth: float, rectified: float, k: float = 1.0, east: float = 0.0, north: float = 0.0, e: Ellipsoid = WGS84, centred: bool = False
) -> tuple[Column, Column]:
    """Hotine's oblique Mercator; east and north are given where the circle crosses the sphere's equator, or (centred) at the projection's centre."""
    o, ecc, p = _Oblique.of(lon_c, lat_c, azimuth, k, e, centred), math.sqrt(e.e2), F.radians(lat)
    q = o.h * F.exp(o.b * (F.atanh(F.sin(p)) - ecc * F.atanh(ecc * F.sin(p))))
    s, t, angle = (q - 1 / q) / 2, (q + 1 / q) / 2, o.b * (F.radians(lon) - o.lon0)
    across = (s * math.sin(o.g) - F.sin(angle) * math.cos(o.g)) / t
    v = -o.a / o.b * F.atanh(across)
    u = o.a / o.b * F.atan2(s * math.cos(o.g) + F.sin(angle) * math.sin(o.g), F.cos(angle)) - o.shift
    c, d = math.cos(math.radians(rectified)), math.sin(math.radians(rectified))
    return east + v * c + u * d, north + u * c - v * d


def inverse_oblique_mercator(
    x: Column, y: Column, lon_c: float, lat_c: float, azimuth: float, rectified: float, k: float = 1.0, east: float = 0.0, north: float = 0.0, e: Ellipsoid = WGS84, centred: bool = False
) -> tuple[Column, Column]:
    o = _Oblique.of(lon_c, lat_c, azimuth, k, e, centred)
    c, d = math.cos(math.radians(rectified)), math.sin(math.radians(rectified))
    v, u = (x - east) * c - (y - north) * d, (y - north) * c + (x - east) * d + o.shift
    s, t = F.sinh(-o.b / o.a * v), F.cosh(-o.b / o.a * v)
    angle = o.b / o.a * u
    up = (F.sin(angle) * math.cos(o.g) + s * math.sin(o.g)) / t
    isometric = (F.atanh(up) - math.log(o.h)) / o.b
    return F.degrees(o.lon0 - F.atan2(s * math.cos(o.g) - F.sin(angle) * math.sin(o.g), F.cos(angle)) / o.b), F.degrees(_latitude(isometric, e))


def _double_sphere(lat0: float, e: Ellipsoid) -> tuple[float, float, float, float]:
    """Radius, exponent, factor and the centre's latitude of the conformal sphere of an oblique stereographic projection."""
    p, sin = math.radians(lat0), math.sin(math.radians(lat0))
    radius = e.a * math.sqrt(1 - e.e2) / (1 - e.e2 * sin * sin)
    n = math.sqrt(1 + e.e2 * math.cos(p) ** 4 / (1 - e.e2))
    centre = math.asin(sin / n)  # where the sphere touches
    return radius, n, math.atanh(math.sin(centre)) - n * _q(p, e), centre


def oblique_stereographic(lon: Column, lat: Column, lon0: float, lat0: float, k: float = 1.0, east: float = 0.0, north: float = 0.0, e: Ellipsoid = WGS84) -> tuple[Column, Column]:
    """The ellipsoid onto a sphere, conformally, and that onto a plane at the centre."""
    radius, n, c, centre = _double_sphere(lat0, e)
    on_sphere = n * _psi(lat, e) + c
    sin, cos, angle = F.tanh(on_sphere), 1 / F.cosh(on_sphere), n * F.radians(_east_of(lon, lon0))
    whole = 1 + sin * math.sin(centre) + cos * math.cos(centre) * F.cos(angle)
    x = cos * F.sin(angle) / whole
    y = (sin * math.cos(centre) - cos * math.sin(centre) * F.cos(angle)) / whole
    return east + 2 * radius * k * x, north + 2 * radius * k * y


def inverse_oblique_stereographic(x: Column, y: Column, lon0: float, lat0: float, k: float = 1.0, east: float = 0.0, north: float = 0.0, e: Ellipsoid = WGS84) -> tuple[Column, Column]:
    radius, n, c, centre = _double_sphere(lat0, e)
    dx, dy = (x - east) / (2 * radius * k), (y - north) / (2 * radius * k)
    far = dx * dx + dy * dy
    out, cos = 2 / (1 + far), (1 - far) / (1 + far)  # of the angle from the centre: its sine over the distance, its cosine
    up, right, ahead = cos * math.sin(centre) + dy * out * math.cos(centre), dx * out, cos * math.cos(centre) - dy * out * math.sin(centre)
    angle = F.atan2(right, ahead)
    isometric = (_slope_psi(F.atan2(up, F.hypot(right, ahead))) - c) / n
    return lon0 + F.degrees(angle) / n, F.degrees(_latitude(isometric, e))


def to_ecef(lon: Column, lat: Column, height: Column, e: Ellipsoid = WGS84) -> tuple[Column, Column, Column]:
    p, g = F.radians(lat), F.radians(lon)
    n = e.a / F.sqrt(1 - e.e2 * F.sin(p) * F.sin(p))
    return (n + height) * F.cos(p) * F.cos(g), (n + height) * F.cos(p) * F.sin(g), (n * (1 - e.e2) + height) * F.sin(p)


def from_ecef(x: Column, y: Column, z: Column, e: Ellipsoid = WGS84) -> tuple[Column, Column, Column]:
    r = F.sqrt(x * x + y * y)
    p = F.atan2(z, r * (1 - e.e2))
    for _ in range(5):
        n = e.a / F.sqrt(1 - e.e2 * F.sin(p) * F.sin(p))
        p = F.atan2(z + e.e2 * n * F.sin(p), r)
    n = e.a / F.sqrt(1 - e.e2 * F.sin(p) * F.sin(p))
    return F.degrees(F.atan2(y, x)), F.degrees(p), r * F.cos(p) + z * F.sin(p) - e.a * e.a / n
