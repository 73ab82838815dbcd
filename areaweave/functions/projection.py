"""WGS84 <-> UTM as Spark SQL fragments (Krueger series to sixth order in n).

Formulas: C. F. F. Karney, "Transverse Mercator with an accuracy of a few
nanometers", J. Geodesy 85 (2011).
"""

from __future__ import annotations

import math

from areaweave.functions.geometry import assume_wgs84, let
from areaweave.settings import WGS84

# --- Fixed values: WGS84 ellipsoid, UTM grid, series coefficients ------------

FLATTENING = 1 / 298.257223563
N = FLATTENING / (2 - FLATTENING)
ECC = math.sqrt(FLATTENING * (2 - FLATTENING))
K0 = 0.9996
FALSE_EASTING = 500000.0
SOUTH_NORTHING = 10000000.0
RADIUS = 6378137.0 / (1 + N) * (1 + N**2 / 4 + N**4 / 64 + N**6 / 256)
SCALE = K0 * RADIUS

ALPHA = (
    N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180 - 127 * N**5 / 288 + 7891 * N**6 / 37800,
    13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440 + 281 * N**5 / 630 - 1983433 * N**6 / 1935360,
    61 * N**3 / 240 - 103 * N**4 / 140 + 15061 * N**5 / 26880 + 167603 * N**6 / 181440,
    49561 * N**4 / 161280 - 179 * N**5 / 168 + 6601661 * N**6 / 7257600,
    34729 * N**5 / 80640 - 3418889 * N**6 / 1995840,
    212378941 * N**6 / 319334400,
)
BETA = (
    N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96 - N**4 / 360 - 81 * N**5 / 512 + 96199 * N**6 / 604800,
    N**2 / 48 + N**3 / 15 - 437 * N**4 / 1440 + 46 * N**5 / 105 - 1118711 * N**6 / 3870720,
    17 * N**3 / 480 - 37 * N**4 / 840 - 209 * N**5 / 4480 + 5569 * N**6 / 90720,
    4397 * N**4 / 161280 - 11 * N**5 / 504 - 830251 * N**6 / 7257600,
    4583 * N**5 / 161280 - 108847 * N**6 / 3991680,
    20648693 * N**6 / 638668800,
)
DELTA = (
    2 * N - 2 * N**2 / 3 - 2 * N**3 + 116 * N**4 / 45 + 26 * N**5 / 45 - 2854 * N**6 / 675,
    7 * N**2 / 3 - 8 * N**3 / 5 - 227 * N**4 / 45 + 2704 * N**5 / 315 + 2323 * N**6 / 945,
    56 * N**3 / 15 - 136 * N**4 / 35 - 1262 * N**5 / 105 + 73814 * N**6 / 2835,
    4279 * N**4 / 630 - 332 * N**5 / 35 - 399572 * N**6 / 14175,
    4174 * N**5 / 315 - 144838 * N**6 / 6237,
    601676 * N**6 / 22275,
)


def utm_srid(lon: str, lat: str = "0D") -> str:
    """EPSG code of the six-degree zone, clamped to 1..60, without exceptions."""
    zone = f"greatest(1, least(60, CAST(({lon} + 180) / 6 AS INT) + 1))"
    return (
        f"CASE WHEN {lon} IS NOT NULL THEN CASE WHEN {lat} >= 0 THEN 32600 ELSE 32700 END + {zone} END"
    )


def epsg_label(srid: str) -> str:
    return f"concat('EPSG:', {srid})"


def _is_utm(srid: str) -> str:
    return f"({srid} BETWEEN 32601 AND 32660 OR {srid} BETWEEN 32701 AND 32760)"


def _meridian(srid: str) -> str:
    return f"CAST(({srid} % 100) * 6 - 183 AS DOUBLE)"


def _north_offset(srid: str) -> str:
    return f"CASE WHEN {srid} >= 32700 THEN {SOUTH_NORTHING!r}D ELSE 0D END"


def _series(coefficients: tuple, term: str) -> str:
    """Sum of coefficient times ``term`` with M standing for 2, 4, 6, ..."""
    return " + ".join(f"{c!r}D * {term.replace('M', f'{2 * j}D')}" for j, c in enumerate(coefficients, start=1))


# Each stage maps a pair (p_.a, p_.b) to the next pair.
_TO_CONFORMAL = (
    "radians(p_.a - {meridian})",
    f"sinh(atanh(sin(radians(p_.b))) - {ECC!r}D * atanh({ECC!r}D * sin(radians(p_.b))))",
)
_TO_SPHERE = ("atan2(p_.b, cos(p_.a))", "atanh(sin(p_.a) / sqrt(p_.b * p_.b + 1D))")
_TO_UTM = (
    f"{FALSE_EASTING!r}D + {SCALE!r}D * (p_.b + {_series(ALPHA, 'cos(p_.a * M) * sinh(p_.b * M)')})",
    f"{{offset}} + {SCALE!r}D * (p_.a + {_series(ALPHA, 'sin(p_.a * M) * cosh(p_.b * M)')})",
)
_FROM_UTM = (f"(p_.b - {{offset}}) / {SCALE!r}D", f"(p_.a - {FALSE_EASTING!r}D) / {SCALE!r}D")
_RECTIFY = (
    f"p_.a - ({_series(BETA, 'sin(p_.a * M) * cosh(p_.b * M)')})",
    f"p_.b - ({_series(BETA, 'cos(p_.a * M) * sinh(p_.b * M)')})",
)
_FROM_SPHERE = ("asin(sin(p_.a) / cosh(p_.b))", "atan2(sinh(p_.b), cos(p_.a))")
_TO_DEGREES = (
    "{meridian} + degrees(p_.b)",
    f"degrees(p_.a + {_series(DELTA, 'sin(p_.a * M)')})",
)


def _staged(path: str, srid: str, *stages: tuple[str, str]) -> str:
    """Run each stage over the whole path, so nothing is evaluated twice."""
    out = f"transform({path}, v_ -> named_struct('a', v_.x, 'b', v_.y))"
    for a, b in stages[:-1]:
        out = f"transform({out}, p_ -> named_struct('a', {a}, 'b', {b}))"
    x, y = stages[-1]
    out = f"transform({out}, p_ -> named_struct('x', {x}, 'y', {y}))"
    return out.replace("{meridian}", _meridian(srid)).replace("{offset}", _north_offset(srid))


def _reshape(geom: str, srid: str | int, per_path: str) -> str:
    return (
        f"named_struct('gtype', {geom}.gtype, 'srid', CAST({srid} AS INT), "
        f"'parts', transform({geom}.parts, part_ -> transform(part_, path_ -> {per_path})))"
    )


def to_wgs84(geom: str) -> str:
    """Back to longitude/latitude; a missing srid is taken as WGS84 already."""
    srid = f"{geom}.srid"
    back = _staged("path_", srid, _FROM_UTM, _RECTIFY, _FROM_SPHERE, _TO_DEGREES)
    return (
        f"CASE WHEN coalesce({srid}, {WGS84}) = {WGS84} THEN {assume_wgs84(geom)} "
        f"WHEN {_is_utm(srid)} THEN {_reshape(geom, WGS84, back)} END"
    )


def to_utm(geom: str, target: str) -> str:
    """Project a geometry into the zone ``target``.

    A geometry that is in ``target`` already is returned as it is; one in another
    zone goes through WGS84.
    """
    forward = _staged("path_", target, _TO_CONFORMAL, _TO_SPHERE, _TO_UTM)
    projected = let("g_", to_wgs84(geom), _reshape("g_", target, forward))
    return f"CASE WHEN {geom} IS NULL OR {geom}.srid = {target} THEN {geom} ELSE {projected} END"
