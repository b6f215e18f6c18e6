"""Coordinate projections as column expressions: (lat, lon, ele) in degrees and metres to (x, y, z) and back.

All are closed forms or series with a fixed number of terms, so none leaves generated code.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ProjectionError

A = 6378137.0
FLAT = 1 / 298.257223563
E2 = FLAT * (2 - FLAT)
E1 = math.sqrt(E2)


@dataclass(frozen=True)
class Origin:
    lat: float = 0.0
    lon: float = 0.0
    ele: float = 0.0


def _xyz(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def _gps(lat: Column, lon: Column, ele: Column) -> Column:
    return F.struct(lat.alias("lat"), lon.alias("lon"), ele.alias("ele"))


class Projector:
    """forward and reverse are column expressions; a coordinate that cannot be projected is null."""

    def __init__(self, origin: Origin = Origin()):
        self.origin = origin

    def forward(self, lat: Column, lon: Column, ele: Column) -> Column:
        raise NotImplementedError

    def reverse(self, x: Column, y: Column, z: Column) -> Column:
        raise NotImplementedError


class SphericalMercator(Projector):
    """The default: a sphere's Mercator scaled by the cosine of the origin's latitude, without offset."""

    def forward(self, lat, lon, ele):
        s = math.cos(math.radians(self.origin.lat))
        return _xyz(s * A * F.radians(lon), s * A * F.log(F.tan(math.pi / 4 + F.radians(lat) / 2)), ele)

    def reverse(self, x, y, z):
        s = math.cos(math.radians(self.origin.lat))
        return _gps(F.degrees(2 * F.atan(F.exp(y / (s * A))) - math.pi / 2), F.degrees(x / (s * A)), z)


class EllipsoidalMercator(Projector):
    """On the ellipsoid, relative to the origin; latitudes beyond 89.5 degrees are cut."""

    @staticmethod
    def _y(lat):
        phi = F.radians(F.greatest(F.least(lat, F.lit(89.5)), F.lit(-89.5)))
        es = E1 * F.sin(phi)
        return A * F.log(F.tan(math.pi / 4 + phi / 2) * F.pow((1 - es) / (1 + es), F.lit(E1 / 2)))

    def _y0(self) -> float:
        phi = math.radians(max(-89.5, min(89.5, self.origin.lat)))
        es = E1 * math.sin(phi)
        return A * math.log(math.tan(math.pi / 4 + phi / 2) * ((1 - es) / (1 + es)) ** (E1 / 2))

    def forward(self, lat, lon, ele):
        return _xyz(A * F.radians(lon - self.origin.lon), self._y(lat) - self._y0(), ele - self.origin.ele)

    def reverse(self, x, y, z):
        t = F.exp(-(y + self._y0()) / A)
        step = lambda phi, _: math.pi / 2 - 2 * F.atan(t * F.pow((1 - E1 * F.sin(phi)) / (1 + E1 * F.sin(phi)), F.lit(E1 / 2)))
        phi = F.aggregate(F.sequence(F.lit(1), F.lit(15)), math.pi / 2 - 2 * F.atan(t), step)
        return _gps(F.degrees(phi), F.degrees(x / A) + self.origin.lon, z + self.origin.ele)


class Geocentric(Projector):
    """Earth-centred, earth-fixed."""

    def forward(self, lat, lon, ele):
        p, l = F.radians(lat), F.radians(lon)
        n = A / F.sqrt(1 - E2 * F.sin(p) * F.sin(p))
        return _xyz((n + ele) * F.cos(p) * F.cos(l), (n + ele) * F.cos(p) * F.sin(l), (n * (1 - E2) + ele) * F.sin(p))

    def reverse(self, x, y, z):
        r = F.hypot(x, y)
        # fixed point of the latitude; near the surface each round gains more than two digits
        step = lambda p, _: F.atan2(z + E2 * (A / F.sqrt(1 - E2 * F.sin(p) * F.sin(p))) * F.sin(p), r)
        p = F.aggregate(F.sequence(F.lit(1), F.lit(12)), F.atan2(z, r * (1 - E2)), step)
        n = A / F.sqrt(1 - E2 * F.sin(p) * F.sin(p))
        high = r * F.cos(p) + z * F.sin(p) - A * A / n
        return _gps(F.degrees(p), F.degrees(F.atan2(y, x)), high)


class LocalCartesian(Projector):
    """East, north, up at the origin."""

    def _turn(self):
        p, l = math.radians(self.origin.lat), math.radians(self.origin.lon)
        sp, cp, sl, cl = math.sin(p), math.cos(p), math.sin(l), math.cos(l)
        n = A / math.sqrt(1 - E2 * sp * sp)
        h = self.origin.ele
        base = ((n + h) * cp * cl, (n + h) * cp * sl, (n * (1 - E2) + h) * sp)
        return base, ((-sl, cl, 0.0), (-sp * cl, -sp * sl, cp), (cp * cl, cp * sl, sp))

    def forward(self, lat, lon, ele):
        base, m = self._turn()
        g = Geocentric().forward(lat, lon, ele)
        d = [g[c] - b for c, b in zip("xyz", base, strict=True)]
        return _xyz(*[sum((k * v for k, v in zip(row, d, strict=True)), F.lit(0.0)) for row in m])

    def reverse(self, x, y, z):
        base, m = self._turn()
        g = [b + m[0][i] * x + m[1][i] * y + m[2][i] * z for i, b in enumerate(base)]
        return Geocentric().reverse(*g)


def zone_of(lat: float, lon: float) -> int:
    """UTM zone, with Norway's and Svalbard's exceptions."""
    z = int((lon + 180) // 6) % 60 + 1
    if 56 <= lat < 64 and 3 <= lon < 12:
        return 32
    if 72 <= lat < 84:
        for lo, hi, s in ((0, 9, 31), (9, 21, 33), (21, 33, 35), (33, 42, 37)):
            if lo <= lon < hi:
                return s
    return z


class Utm(Projector):
    """Transverse Mercator in the zone of the origin, by Krueger's series to the sixth order; relative to the origin unless use_offset is off.

    Points of other zones or the other hemisphere are projected in the origin's
    zone too, unless throw_in_padding makes them null. Beyond some 35 degrees
    from the central meridian there is no result.
    """

    SCALE, EAST, NORTH = 0.9996, 500000.0, 10000000.0
    _N = FLAT / (2 - FLAT)
    ALPHA = (
        _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180 - 127 * _N**5 / 288 + 7891 * _N**6 / 37800,
        13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440 + 281 * _N**5 / 630 - 1983433 * _N**6 / 1935360,
        61 * _N**3 / 240 - 103 * _N**4 / 140 + 15061 * _N**5 / 26880 + 167603 * _N**6 / 181440,
        49561 * _N**4 / 161280 - 179 * _N**5 / 168 + 6601661 * _N**6 / 7257600,
        34729 * _N**5 / 80640 - 3418889 * _N**6 / 1995840,
        212378941 * _N**6 / 319334400,
    )
    BETA = (
        _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360 - 81 * _N**5 / 512 + 96199 * _N**6 / 604800,
        _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440 + 46 * _N**5 / 105 - 1118711 * _N**6 / 3870720,
        17 * _N**3 / 480 - 37 * _N**4 / 840 - 209 * _N**5 / 4480 + 5569 * _N**6 / 90720,
        4397 * _N**4 / 161280 - 11 * _N**5 / 504 - 830251 * _N**6 / 7257600,
        4583 * _N**5 / 161280 - 108847 * _N**6 / 3991680,
        20648693 * _N**6 / 638668800,
    )
    RADIUS = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)

    def __init__(self, origin: Origin = Origin(), *, use_offset: bool = True, throw_in_padding: bool = False):
        super().__init__(origin)
        if not -80 <= origin.lat <= 84:
            raise ProjectionError("no zone at the poles")
        self.zone, self.north, self.throw = zone_of(origin.lat, origin.lon), origin.lat >= 0, throw_in_padding
        self.meridian = self.zone * 6 - 183.0
        self.offset = self._plain(origin.lat, origin.lon) if use_offset else (0.0, 0.0)

    def _plain(self, lat: float, lon: float) -> tuple[float, float]:
        """The series on numbers."""
        l = math.radians(lon - self.meridian)
        s = math.sin(math.radians(lat))
        t = math.sinh(math.atanh(s) - E1 * math.atanh(E1 * s))
        xi, eta = math.atan2(t, math.cos(l)), math.asinh(math.sin(l) / math.hypot(t, math.cos(l)))
        x = eta + sum(a * math.cos(2 * j * xi) * math.sinh(2 * j * eta) for j, a in enumerate(self.ALPHA, 1))
        y = xi + sum(a * math.sin(2 * j * xi) * math.cosh(2 * j * eta) for j, a in enumerate(self.ALPHA, 1))
        return self.EAST + self.SCALE * self.RADIUS * x, self.SCALE * self.RADIUS * y + (0 if self.north else self.NORTH)

    def forward(self, lat, lon, ele):
        turn = lon - self.meridian
        turn = turn - 360 * F.round(turn / 360)
        l, s = F.radians(turn), F.sin(F.radians(lat))
        t = F.sinh(F.atanh(s) - E1 * F.atanh(E1 * s))
        base = F.struct(F.atan2(t, F.cos(l)).alias("xi"), F.asinh(F.sin(l) / F.hypot(t, F.cos(l))).alias("eta"))

        def series(b):
            x, y = b["eta"], b["xi"]
            for j, a in enumerate(self.ALPHA, 1):
                x = x + a * F.cos(2 * j * b["xi"]) * F.sinh(2 * j * b["eta"])
                y = y + a * F.sin(2 * j * b["xi"]) * F.cosh(2 * j * b["eta"])
            return _xyz(self.EAST + self.SCALE * self.RADIUS * x - self.offset[0], self.SCALE * self.RADIUS * y + (0.0 if self.north else self.NORTH) - self.offset[1], ele)

        out = F.try_element_at(F.transform(F.array(base), series), F.lit(1))
        fine = lat.between(-90, 90) & (F.abs(turn) < 35)
        if self.throw:
            fine = fine & (F.abs(turn) <= 3) & ((lat >= 0) == F.lit(self.north))
        return F.when(fine, out)

    def reverse(self, x, y, z):
        e = (x + self.offset[0] - self.EAST) / (self.SCALE * self.RADIUS)
        n = (y + self.offset[1] - (0.0 if self.north else self.NORTH)) / (self.SCALE * self.RADIUS)
        xi, eta = n, e
        for j, b in enumerate(self.BETA, 1):
            xi = xi - b * F.sin(2 * j * n) * F.cosh(2 * j * e)
            eta = eta - b * F.cos(2 * j * n) * F.sinh(2 * j * e)

        def back(v):
            tp = F.sin(v["xi"]) / F.hypot(F.sinh(v["eta"]), F.cos(v["xi"]))
            # Newton's steps for the tangent of the latitude
            def step(t, _):
                sig = F.sinh(E1 * F.atanh(E1 * t / F.sqrt(1 + t * t)))
                ti = t * F.sqrt(1 + sig * sig) - sig * F.sqrt(1 + t * t)
                return t + (tp - ti) / F.sqrt(1 + ti * ti) * (1 + (1 - E2) * t * t) / ((1 - E2) * F.sqrt(1 + t * t))

            t = F.aggregate(F.sequence(F.lit(1), F.lit(4)), tp, step)
            return _gps(F.degrees(F.atan(t)), F.degrees(F.atan2(F.sinh(v["eta"]), F.cos(v["xi"]))) + self.meridian, z)

        return F.try_element_at(F.transform(F.array(F.struct(xi.alias("xi"), eta.alias("eta"))), back), F.lit(1))
