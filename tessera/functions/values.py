"""Value types, orders, arithmetic with wrap-around, norms, distances and colours, as Column expressions.

Vectors (points, colours) are structs; functions over them take the list of their component columns.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

C = str | Column


def _c(x: C) -> Column:
    return F.col(x) if isinstance(x, str) else x


@dataclass(frozen=True)
class ValueType:
    """Bits, signedness and bounds of a pixel value; ``inf`` and ``sup`` follow the order and swap for ``greater``."""

    bits: int
    signed: bool = False
    real: bool = False

    @property
    def min(self):
        return -float("inf") if self.real else -(1 << self.bits - 1) if self.signed else 0

    @property
    def max(self):
        return float("inf") if self.real else (1 << self.bits - 1) - 1 if self.signed else (1 << self.bits) - 1

    def inf(self, order: str = "less"):
        return self.min if order == "less" else self.max

    def sup(self, order: str = "less"):
        return self.max if order == "less" else self.min

    @property
    def spark(self) -> str:
        if self.real:
            return "float" if self.bits == 32 else "double"
        need = self.bits + (not self.signed)
        return "tinyint" if need <= 8 else "smallint" if need <= 16 else "int" if need <= 32 else "bigint" if need <= 64 else "decimal(20,0)"


BOOL = ValueType(1)
UINT8, UINT16, UINT32, UINT64 = (ValueType(b) for b in (8, 16, 32, 64))
INT8, INT16, INT32, INT64 = (ValueType(b, True) for b in (8, 16, 32, 64))
FLOAT, DOUBLE = ValueType(32, True, True), ValueType(64, True, True)


def wrap(x: C, t: ValueType) -> Column:
    """Narrowing as fixed-width integers do it: modulo 2^bits, for signed types centred on 0."""
    n = 1 << t.bits
    low = F.pmod(_c(x).cast("bigint"), F.lit(n))
    return (F.when(low > t.max, low - n).otherwise(low) if t.signed else low).cast(t.spark)


def int_div(a: C, b: C) -> Column:
    """Integer division that truncates towards 0."""
    a, b = _c(a).cast("bigint"), _c(b).cast("bigint")
    q = F.floor(F.abs(a) / F.abs(b)).cast("bigint")
    return F.when((a < 0) != (b < 0), -q).otherwise(q)


def int_mod(a: C, b: C) -> Column:
    """Remainder with the sign of the dividend."""
    return _c(a) % _c(b)


# element-wise


def sqr(x: C) -> Column:
    return _c(x) * _c(x)


def cbrt(x: C) -> Column:
    return F.cbrt(_c(x))


# reductions and norms of a vector's components


def vsum(xs: list[C]) -> Column:
    return reduce(lambda a, b: a + b, map(_c, xs))


def vprod(xs: list[C]) -> Column:
    return reduce(lambda a, b: a * b, map(_c, xs))


def vmin(xs: list[C]) -> Column:
    return F.least(*map(_c, xs)) if len(xs) > 1 else _c(xs[0])


def vmax(xs: list[C]) -> Column:
    return F.greatest(*map(_c, xs)) if len(xs) > 1 else _c(xs[0])


def l0norm(xs: list[C]) -> Column:
    """The least absolute component (not a count)."""
    return vmin([F.abs(_c(x)) for x in xs])


def l1norm(xs: list[C]) -> Column:
    return vsum([F.abs(_c(x)) for x in xs])


def l2norm_sqr(xs: list[C]) -> Column:
    return vsum([sqr(x) for x in xs])


def l2norm(xs: list[C]) -> Column:
    return F.sqrt(l2norm_sqr(xs))


def linfnorm(xs: list[C]) -> Column:
    return vmax([F.abs(_c(x)) for x in xs])


def lpnorm(xs: list[C], p: float) -> Column:
    return F.pow(vsum([F.pow(F.abs(_c(x)), F.lit(float(p))) for x in xs]), F.lit(1.0 / p))


def l2dist_sqr(xs: list[C], ys: list[C]) -> Column:
    return l2norm_sqr([_c(x) - _c(y) for x, y in zip(xs, ys)])


def l2dist(xs: list[C], ys: list[C]) -> Column:
    return F.sqrt(l2dist_sqr(xs, ys))


# orders


def lex_less(xs: list[C], ys: list[C]) -> Column:
    return F.struct(*map(_c, xs)) < F.struct(*[_c(y).alias(f"c{k}") for k, y in enumerate(ys)])


def prod_less_equal(xs: list[C], ys: list[C]) -> Column:
    return reduce(lambda a, b: a & b, [_c(x) <= _c(y) for x, y in zip(xs, ys)])


def prod_less(xs: list[C], ys: list[C]) -> Column:
    """Product order, strictly: at most in every component and not equal."""
    return prod_less_equal(xs, ys) & ~reduce(lambda a, b: a & b, [_c(x) == _c(y) for x, y in zip(xs, ys)])


def interval_less_equal(upper: list[C], ys: list[C]) -> Column:
    """An interval lies below a vector if its upper end does, component by component."""
    return prod_less_equal(upper, ys)


# colours: r, g, b columns


#: Linear transform between rgb and xyz, and its inverse.
XYZ = ((0.4125, 0.3576, 0.1805), (0.2127, 0.7152, 0.0722), (0.0193, 0.1192, 0.9505))
RGB = ((3.2406, -1.5372, -0.4986), (-0.9689, 1.8758, 0.0415), (0.0557, -0.2040, 1.0570))
#: White point of lab, for rgb of 1.
WHITE = (0.4125 + 0.3576 + 0.1804, 0.2127 + 0.7152 + 0.0722, 0.0193 + 0.1192 + 0.9502)
#: Fixed values of the other lab: transform of linear rgb, and its white point.
XYZ_LINEAR = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
WHITE_LINEAR = (0.950456, 1.0, 1.088754)


def _matrix(m, xs: list[C]) -> list[Column]:
    return [vsum([_c(x).cast("double") * F.lit(k) for k, x in zip(row, xs)]) for row in m]


def rgb_to_xyz(r: C, g: C, b: C) -> list[Column]:
    return _matrix(XYZ, [r, g, b])


def xyz_to_rgb(x: C, y: C, z: C) -> list[Column]:
    return _matrix(RGB, [x, y, z])


def _lab(f: list[Column]) -> list[Column]:
    return [f[1] * 116.0 - 16.0, (f[0] - f[1]) * 500.0, (f[1] - f[2]) * 200.0]


def rgb_to_lab(r: C, g: C, b: C, top: float = 255.0) -> list[Column]:
    """Lab of rgb in 0..top."""
    t = [v / F.lit(w * top) for v, w in zip(rgb_to_xyz(r, g, b), WHITE)]
    return _lab([F.when(v > 0.008856, F.cbrt(v)).otherwise(v * 7.787 + F.lit(16.0 / 116.0)) for v in t])


def rgb_to_lab_gamma(r: C, g: C, b: C) -> list[Column]:
    """Lab of 8-bit rgb with the display's gamma undone first."""
    lin = [F.when(_c(v) / 255.0 <= 0.04045, _c(v) / 255.0 / 12.92).otherwise(F.pow((_c(v) / 255.0 + 0.055) / 1.055, F.lit(2.4))) for v in (r, g, b)]
    t = [v / F.lit(w) for v, w in zip(_matrix(XYZ_LINEAR, lin), WHITE_LINEAR)]
    return _lab([F.when(v > 0.008856, F.cbrt(v)).otherwise((v * 903.3 + 16.0) / 116.0) for v in t])


def lab_to_rgb(l: C, a: C, b: C, top: float = 255.0) -> list[Column]:
    """rgb in 0..top of lab, truncated and kept within bounds."""
    fy = (_c(l) + 16.0) / 116.0
    fs = (_c(a) / 500.0 + fy, fy, fy - _c(b) / 200.0)
    xyz = [F.when(t > 0.206893, t * t * t).otherwise((t - F.lit(16.0 / 116.0)) / 7.787) * F.lit(w * top) for t, w in zip(fs, WHITE)]
    return [F.floor(F.least(F.greatest(v, F.lit(0.0)), F.lit(top))).cast("int") for v in xyz_to_rgb(*xyz)]


def luma(r: C, g: C, b: C) -> Column:
    """Grey of rgb, truncated."""
    return F.floor(_c(r) * F.lit(0.2989) + _c(g) * F.lit(0.5870) + _c(b) * F.lit(0.1140)).cast("int")


def luminance(r: C, g: C, b: C) -> Column:
    return int_div(_c(r).cast("int") + _c(g).cast("int") + _c(b).cast("int"), F.lit(3)).cast("int")


def rgb_to_lsh(r: C, g: C, b: C, bits: int = 8) -> list[Column]:
    """Luminance, saturation, hue. The hue's six sectors are 2^bits div 6 wide; greys have hue 0."""
    r, g, b = (_c(v).cast("int") for v in (r, g, b))
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    mid = r + g + b - hi - lo
    lum = (r + g + b) / 3.0
    sat = F.when(lum > mid, hi - lum).otherwise(lum - lo) * 1.5
    step = (1 << bits) // 6
    sector = F.when(r < g, F.when(g < b, 3).when(b < r, 1).otherwise(2)).otherwise(F.when(b < g, 0).when(r < b, 4).otherwise(5))
    sign = F.when(sector % 2 == 0, 1.0).otherwise(-1.0)
    hue = F.when(hi > lo, F.floor((sector + 0.5 - sign * (hi + lo - 2 * mid) / (sat * 2.0)) * F.lit(float(step))).cast("int") % (6 * step)).otherwise(0)
    return [F.floor(lum).cast("int"), F.floor(sat).cast("int"), hue]


def lsh_to_rgb(l: C, s: C, h: C, bits: int = 8) -> list[Column]:
    l, s, h = (_c(v).cast("int") for v in (l, s, h))
    step = (1 << bits) // 6
    sector = F.floor(h / step).cast("int")
    m = F.when(sector % 2 == 0, 1.0).otherwise(-1.0)
    phi = h / F.lit(float(step)) - sector
    c = m * (phi - 0.5)
    one, two = s / F.lit(3.0), s * 2.0 / F.lit(3.0)
    hi = F.when(c <= 0, l + two).otherwise(l + one + two * ((sector + 1) % 2 - m * phi))
    lo = F.when(c >= 0, l - two).otherwise(l - one - two * (sector % 2 + m * phi))
    mid = l - m * one + m * two * phi
    hi, mid, lo = (F.greatest(F.lit(0), F.least(F.lit(255), F.expr("int(0)") + (v + 0.5).cast("int"))) for v in (hi, mid, lo))
    place = lambda *xs: F.element_at(F.array(*xs), sector + 1)
    return [place(hi, mid, lo, lo, mid, hi), place(mid, hi, hi, mid, lo, lo), place(lo, lo, mid, hi, hi, mid)]
