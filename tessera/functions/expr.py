"""Column expressions of the pixel algebra: exact integer arithmetic on BIGINT columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHANNELS = ("r", "g", "b", "a")
#: Levels of the coarse grid, and the weights of red, green and blue in luminance.
LEVELS = 16
LUMINANCE = (299, 587, 114)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def div(n, d) -> Column:
    """Integer quotient toward zero."""
    return _div(_c(n), _c(d))


def _div(n: Column, d: Column) -> Column:
    return ((n - n % d) / d).cast("bigint")


def round_half_up(n, d) -> Column:
    """floor(n / d + 1/2) for n >= 0, d > 0."""
    n, d = _c(n), _c(d)
    return _div(2 * n + d, 2 * d)


def round_half_away(n, d) -> Column:
    n, d = _c(n), _c(d)
    return F.signum(n.cast("double")).cast("bigint") * _div(F.abs(n) + _div(d, F.lit(2)), d)


def zone_of(a="a") -> Column:
    """0 transparent, 2 opaque, 1 between."""
    a = _c(a)
    return F.when(a == 0, 0).when(a == 255, 2).otherwise(1).cast("bigint")


def alpha_bin(a="a") -> Column:
    """16 levels with the ends on their own."""
    a = _c(a)
    return F.when(a == 0, 0).when(a == 255, 15).otherwise(1 + _div((a - 1) * 14, F.lit(254))).cast("bigint")


def coarse_key_of(r, g, b, a) -> list[Column]:
    """The coarse key of a colour given by four columns."""
    return [_div(_c(c) * LEVELS, F.lit(256)).alias(f"k{i}") for i, c in enumerate((r, g, b))] + [alpha_bin(a).alias("k3")]


def packed(r="r", g="g", b="b", a="a") -> Column:
    return _c(r) * 16777216 + _c(g) * 65536 + _c(b) * 256 + _c(a)


def premultiplied(prefix: str = "", r="r", g="g", b="b", a="a") -> list[Column]:
    return [(_c(x) * _c(a)).alias(f"{prefix}p{i}") for i, x in enumerate((r, g, b))] + [(255 * _c(a)).alias(f"{prefix}p3")]


def distance(left: list, right: list) -> Column:
    total = F.lit(0).cast("bigint")
    for x, y in zip(left, right):
        total = total + (_c(x) - _c(y)) * (_c(x) - _c(y))
    return total


def guard_fires(opaque, total) -> Column:
    """Fewer than one pixel in 20,000 is opaque (strictly)."""
    return _c(opaque) * 20000 < _c(total)


def bit_depth(n) -> Column:
    n = _c(n)
    return F.when(n <= 2, 1).when(n <= 4, 2).when(n <= 16, 4).otherwise(8).cast("bigint")


def round16(v) -> Column:
    """A 16-bit sample as 8 bits."""
    return _div(_c(v) * 255 + 32767, F.lit(65535))


def luminance(r="r", g="g", b="b") -> Column:
    return sum((_c(x) * w for x, w in zip((r, g, b), LUMINANCE)), F.lit(0))


def paeth(left, up, corner) -> Column:
    left, up, corner = _c(left), _c(up), _c(corner)
    p = left + up - corner
    dl, du, dc = F.abs(p - left), F.abs(p - up), F.abs(p - corner)
    return F.when((dl <= du) & (dl <= dc), left).when(du <= dc, up).otherwise(corner)


def residual_score(v) -> Column:
    v = _c(v)
    return F.when(v < 128, v).otherwise(256 - v)


def srgb_to_linear(v) -> Column:
    x = _c(v) / 255.0
    return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(x) -> Column:
    x = _c(x)
    y = F.when(x <= 0.0031308, x * 12.92).otherwise(1.055 * F.pow(x, F.lit(1 / 2.4)) - 0.055)
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), y)) * 255 + 0.5).cast("bigint")


#: The two published matrices of the Oklab colour space.
TO_LMS = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
TO_LAB = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))


def oklab(r="r", g="g", b="b") -> list[Column]:
    """L, a, b of an sRGB colour; cube roots go through pow with the sign put back."""
    linear = [srgb_to_linear(x) for x in (r, g, b)]
    dot = lambda row, xs: sum((w * x for w, x in zip(row, xs)), F.lit(0.0))
    roots = [F.signum(v) * F.pow(F.abs(v), F.lit(1 / 3)) for v in (dot(row, linear) for row in TO_LMS)]
    return [dot(row, roots) for row in TO_LAB]
