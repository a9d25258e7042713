"""Geometry: distances, projections, camera model, affine transforms, bearings."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import EARTH_M, d, ratio

M_LAT, M_LON, REFRACTION = 110_540.0, 111_320.0, 0.13
# Names of the winds, clockwise from north.
WINDS_16 = "N NNE NE ENE E ESE SE SSE S SSW SW WSW W WNW NW NNW".split()
WINDS_8 = "N NE E SE S SW W NW".split()


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance on a sphere of 6,371 km."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return d(2 * EARTH_M / 1000) * F.asin(F.sqrt(h))


def metres_per_degree(lat: Column) -> tuple[Column, Column]:
    """Metres to a degree of latitude and of longitude."""
    return d(M_LAT), d(M_LON) * F.cos(F.radians(lat))


def planar_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Flat distance by the scales at the first point."""
    ky, kx = metres_per_degree(lat1)
    return F.hypot((lat2 - lat1) * ky, (lon2 - lon1) * kx)


def destination(lat: Column, lon: Column, azimuth: Column, dist: Column) -> tuple[Column, Column]:
    """Latitude and longitude so many metres away along an azimuth, on a flat earth."""
    ky, kx = metres_per_degree(lat)
    return lat + dist * F.cos(F.radians(azimuth)) / ky, lon + dist * F.sin(F.radians(azimuth)) / kx


def drop_m(dist: Column) -> Column:
    """How far curvature less refraction lowers a point at a distance."""
    return dist * dist / d(2 * EARTH_M) * d(1 - REFRACTION)


def albers(lon: Column, lat: Column, lon0: float = -112.0, lat0: float = 40.0, p1: float = 33.0, p2: float = 45.0) -> tuple[Column, Column]:
    """Albers equal-area coordinates on the unit sphere."""
    from math import cos, radians, sin, sqrt

    n = (sin(radians(p1)) + sin(radians(p2))) / 2
    k = cos(radians(p1)) ** 2 + 2 * n * sin(radians(p1))
    rho0 = sqrt(k - 2 * n * sin(radians(lat0))) / n
    rho = F.sqrt(d(k) - d(2 * n) * F.sin(F.radians(lat))) / d(n)
    theta = d(n) * F.radians(lon - d(lon0))
    return rho * F.sin(theta), d(rho0) - rho * F.cos(theta)


def unwrap(az: Column, centre: Column) -> Column:
    """An azimuth as the nearest equal of a centre: within 180 degrees of it."""
    return F.pmod(az - centre + 180, d(360)) - 180 + centre


def circular_wind(az: Column) -> Column:
    """One of eight winds for a bearing."""
    place = F.pmod(F.rint(az / 45), d(8)).cast("int")
    return F.element_at(F.array(*map(F.lit, WINDS_8)), place + 1)


def wind_azimuth(name: Column) -> Column:
    """Azimuth of one of sixteen winds by name; NULL for others."""
    return reduce(lambda w, k: w.when(F.upper(name) == k[1], d(22.5 * k[0])), enumerate(WINDS_16), F.when(F.lit(False), d(0)))


def lerp_ticks(x: Column, xs: list[float], ys: list[float]) -> Column:
    """Piecewise linear through ticks; the end pieces go on beyond them."""
    out = None
    for k in range(len(xs) - 1):
        piece = d(ys[k]) + (x - d(xs[k])) * d((ys[k + 1] - ys[k]) / (xs[k + 1] - xs[k]))
        last = k == len(xs) - 2
        out = (F.when(x < xs[k + 1], piece) if out is None else out.otherwise(piece) if last else out.when(x < xs[k + 1], piece)) if len(xs) > 2 else piece
    return out


@dataclass(frozen=True)
class Camera:
    """Pose and lens: size in pixels, yaw, pitch, roll and horizontal field of view in degrees, radial term k1.

    Any of them may be a column; numbers become double literals.
    """

    width: Column | float
    height: Column | float
    yaw: Column | float
    pitch: Column | float = 0.0
    roll: Column | float = 0.0
    hfov: Column | float = 100.0
    k1: Column | float = 0.0

    def _(self, name: str) -> Column:
        v = getattr(self, name)
        return v if isinstance(v, Column) else d(v)

    @property
    def focal(self) -> Column:
        """Pixels to a radian at the axis."""
        return self._("width") / (2 * F.radians(self._("hfov") / 2))

    def direction(self, u: Column, v: Column) -> tuple[Column, Column]:
        """Azimuth (0 to 360) and elevation of a pixel."""
        x, y = u - self._("width") / 2, self._("height") / 2 - v
        r = F.hypot(x, y) / self.focal
        theta = r * (1 + self._("k1") * r * r)
        turn = F.atan2(y, x) + F.radians(self._("roll"))
        return self._from_axis(theta, turn)

    def _from_axis(self, theta: Column, turn: Column) -> tuple[Column, Column]:
        right, up, ahead = F.sin(theta) * F.cos(turn), F.sin(theta) * F.sin(turn), F.cos(theta)
        p = F.radians(self._("pitch"))
        north, z = ahead * F.cos(p) - up * F.sin(p), ahead * F.sin(p) + up * F.cos(p)
        az = F.pmod(F.degrees(F.atan2(right, north)) + self._("yaw"), d(360))
        return az, F.degrees(F.asin(F.greatest(d(-1), F.least(d(1), z))))

    def pixel(self, az: Column, el: Column, steps: int = 8) -> tuple[Column, Column]:
        """Pixel of a direction: the radial polynomial is inverted by Newton steps."""
        a, e, p = F.radians(az - self._("yaw")), F.radians(el), F.radians(self._("pitch"))
        right, north, z = F.cos(e) * F.sin(a), F.cos(e) * F.cos(a), F.sin(e)
        ahead, up = north * F.cos(p) + z * F.sin(p), z * F.cos(p) - north * F.sin(p)
        theta = F.atan2(F.hypot(right, up), ahead)
        turn = F.atan2(up, right) - F.radians(self._("roll"))
        k1 = self._("k1")
        r = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), theta, lambda r, _: r - (r * (1 + k1 * r * r) - theta) / (1 + 3 * k1 * r * r))
        return self._("width") / 2 + r * self.focal * F.cos(turn), self._("height") / 2 - r * self.focal * F.sin(turn)

    @property
    def effective_hfov(self) -> Column:
        """Degrees between the middle of the left and of the right edge."""
        r = self._("width") / 2 / self.focal
        return 2 * F.degrees(r * (1 + self._("k1") * r * r))


Affine = tuple[Column, Column, Column, Column, Column, Column]


def compose(first: Affine, then: Affine) -> Affine:
    """The 2x3 transform that applies one, then the other (row by row: xx, xy, x0, yx, yy, y0)."""
    a, b = then, first
    return (
        a[0] * b[0] + a[1] * b[3], a[0] * b[1] + a[1] * b[4], a[0] * b[2] + a[1] * b[5] + a[2],
        a[3] * b[0] + a[4] * b[3], a[3] * b[1] + a[4] * b[4], a[3] * b[2] + a[4] * b[5] + a[5],
    )


def invert(a: Affine) -> Affine:
    """The inverse of a 2x3 transform; NULL if it has none."""
    det = a[0] * a[4] - a[1] * a[3]
    xx, xy, yx, yy = ratio(a[4], det), ratio(-a[1], det), ratio(-a[3], det), ratio(a[0], det)
    return xx, xy, -(xx * a[2] + xy * a[5]), yx, yy, -(yx * a[2] + yy * a[5])


def snapped(x: Column, step: float) -> Column:
    """Grid number of a coordinate, halves to even."""
    return F.rint(x / d(step)).cast("bigint")


def cell_km2(lat: Column, step_deg: float) -> Column:
    """Area of a square cell of so many degrees at a latitude."""
    ky, kx = metres_per_degree(lat)
    return ky * kx * d(step_deg * step_deg / 1e6)




# Named regions with their centres.
REGIONS = [
    ("Klamath Mountains", 41.3, -123.3), ("Trinity Alps", 40.9, -123.0), ("Yosemite high country", 37.9, -119.4), ("Modoc Plateau", 41.3, -120.6),
    ("Diablo Range", 36.3, -120.7), ("Kern Plateau", 35.9, -118.1), ("Mojave National Preserve", 35.2, -115.5), ("Mendocino National Forest", 39.6, -122.9),
    ("Death Valley", 36.5, -117.0), ("Eastern Sierra", 37.5, -118.6), ("Los Padres backcountry", 34.8, -119.6), ("Santa Lucia Range", 36.1, -121.5),
    ("Lassen country", 40.5, -121.4), ("Feather River country", 39.9, -121.2), ("Sequoia backcountry", 36.5, -118.6), ("Owens Valley", 36.8, -118.2),
    ("Inyo Mountains", 36.7, -117.9), ("Tehachapi Mountains", 35.0, -118.6), ("Sierra National Forest", 37.3, -119.2), ("Mount Hamilton Range", 37.3, -121.5),
    ("Mariposa foothills", 37.45, -120.1), ("El Paso Mountains", 35.3, -117.8), ("Coso Range", 36.0, -117.8), ("Mono Basin", 38.1, -119.0),
    ("Glass Mountains", 37.75, -118.65), ("Medicine Lake Highlands", 41.7, -121.6), ("Warner Mountains", 41.4, -120.2), ("Siskiyou Mountains", 41.85, -123.3),
    ("Carrizo Plain", 35.2, -119.8), ("San Rafael Wilderness", 34.75, -119.9),
]


def region_name(lat: Column, lon: Column, regions: list[tuple[str, float, float]] = REGIONS) -> Column:
    """The region whose centre is nearest (longitudes count 0.8), the first among equals."""
    away = lambda r: F.struct((F.pow(d(r[1][1]) - lat, 2) + F.pow((d(r[1][2]) - lon) * d(0.8), 2)).alias("away"), F.lit(r[0]).alias("order"), F.lit(r[1][0]).alias("name"))
    return F.array_min(F.array(*map(away, enumerate(regions))))["name"]
