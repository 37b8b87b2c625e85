"""Colours as Column expressions: hex text, sRGB and linear light, HLS, distances, CIELAB."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NEUTRAL = "#BFBFBF"


def channels(color_hex: Column) -> tuple[Column, Column, Column]:
    """Red, green and blue 0..255; neutral grey for anything but #RRGGBB."""
    bare = F.ltrim(F.trim(F.coalesce(color_hex, F.lit(NEUTRAL))), F.lit("#"))
    safe = F.when(bare.rlike("^[0-9A-Fa-f]{6}$"), bare).otherwise("BFBFBF")
    part = lambda at: F.conv(F.substring(safe, at, 2), 16, 10).cast("double")
    return part(1), part(3), part(5)


def to_hex(r: Column, g: Column, b: Column) -> Column:
    """Hex text of channels 0..255, rounded half to even and clamped."""
    whole = lambda c: F.bround(F.least(F.lit(255.0), F.greatest(F.lit(0.0), c)), 0).cast("int")
    return F.format_string("#%02X%02X%02X", whole(r), whole(g), whole(b))


def to_linear(unit: Column) -> Column:
    return F.when(unit <= 0.04045, unit / 12.92).otherwise(F.pow((unit + 0.055) / 1.055, F.lit(2.4)))


def to_srgb(linear: Column) -> Column:
    return F.when(linear <= 0.0031308, linear * 12.92).otherwise(1.055 * F.pow(linear, F.lit(1 / 2.4)) - 0.055)


def luminance(color_hex: Column) -> Column:
    r, g, b = channels(color_hex)
    return (0.2126 * r + 0.7152 * g + 0.0722 * b) / 255.0


def hls(color_hex: Column) -> tuple[Column, Column, Column]:
    r, g, b = (c / 255.0 for c in channels(color_hex))
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    spread, light = hi - lo, (hi + lo) / 2
    base = F.when(light <= 0.5, hi + lo).otherwise(2 - hi - lo)
    sat = F.when(spread == 0, 0.0).otherwise(spread / base)
    rc, gc, bc = (hi - r) / spread, (hi - g) / spread, (hi - b) / spread
    hue = F.when(spread == 0, 0.0).otherwise(F.pmod(F.when(r == hi, bc - gc).when(g == hi, 2 + rc - bc).otherwise(4 + gc - rc) / 6, F.lit(1.0)))
    return hue, light, sat


def saturation(color_hex: Column) -> Column:
    return hls(color_hex)[2]


def hue_distance(a: Column, b: Column) -> Column:
    raw = F.abs(F.pmod(a, F.lit(1.0)) - F.pmod(b, F.lit(1.0)))
    return F.least(raw, 1 - raw)


def distance(a: Column, b: Column) -> Column:
    """Perceptually weighted RGB distance, 0..1."""
    (ra, ga, ba), (rb, gb, bb) = channels(a), channels(b)
    mean = (ra + rb) / 2
    raw = F.sqrt((2 + mean / 256) * (ra - rb) ** 2 + 4.0 * (ga - gb) ** 2 + (2 + (255 - mean) / 256) * (ba - bb) ** 2)
    return F.least(F.lit(1.0), raw / 764.0)


def blend(a: Column, b: Column, factor) -> Column:
    """Mix in linear light: 0 keeps ``a``, 1 gives ``b``."""
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), factor if isinstance(factor, Column) else F.lit(factor)))
    one = lambda x, y: to_srgb(to_linear(x / 255) + (to_linear(y / 255) - to_linear(x / 255)) * t) * 255
    return to_hex(*[one(x, y) for x, y in zip(channels(a), channels(b))])


def shift(color_hex: Column, delta: int) -> Column:
    return to_hex(*[c + delta for c in channels(color_hex)])


def tone(color_hex: Column) -> Column:
    bare = F.ltrim(F.coalesce(F.nullif(color_hex, F.lit("")), F.lit(NEUTRAL)), F.lit("#"))
    valid = bare.rlike("^[0-9A-Fa-f]{6}$")
    return F.when(~valid, "mid").when(luminance(color_hex) > 0.66, "light").when(luminance(color_hex) < 0.30, "dark").otherwise("mid")


def kelvin_to_hex(kelvin: Column) -> Column:
    """Display colour of a light temperature (room palette variant)."""
    t = F.least(F.lit(10000.0), F.greatest(F.lit(1500.0), kelvin)) / 100
    clip = lambda c: F.least(F.lit(255.0), F.greatest(F.lit(0.0), c))
    over = F.greatest(t - 60, F.lit(1.0))
    red = F.when(t <= 66, 255.0).otherwise(clip(329.7 * F.pow(over, F.lit(-0.1332))))
    green = F.when(t <= 66, clip(99.47 * F.log(t) - 161.12)).otherwise(clip(288.12 * F.pow(over, F.lit(-0.0755))))
    blue = F.when(t >= 66, 255.0).when(t <= 19, 0.0).otherwise(clip(138.52 * F.log(F.greatest(t - 10, F.lit(1.0))) - 305.04))
    return to_hex(red, green, blue)


def mixed_hex(color_hex: Column, weight: Column) -> Column:
    """Aggregate: gamma-2 weighted mean colour of a group."""
    total = F.sum(weight)
    return to_hex(*[F.sqrt(F.sum(c * c * weight) / total) for c in channels(color_hex)])


def mean_hex(color_hex: Column, weight: Column) -> Column:
    """Aggregate: plain weighted mean per sRGB channel."""
    total = F.sum(weight)
    return to_hex(*[F.sum(c * weight) / total for c in channels(color_hex)])


def to_lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """CIELAB (D65) of sRGB channels 0..1."""
    lr, lg, lb = to_linear(r), to_linear(g), to_linear(b)
    x = (0.4124564 * lr + 0.3575761 * lg + 0.1804375 * lb) / 0.95047
    y = 0.2126729 * lr + 0.7151522 * lg + 0.0721750 * lb
    z = (0.0193339 * lr + 0.1191920 * lg + 0.9503041 * lb) / 1.08883
    f = lambda v: F.when(v > 216 / 24389, F.cbrt(v)).otherwise((24389 / 27 * v + 16) / 116)
    fx, fy, fz = f(x), f(y), f(z)
    return 116 * fy - 16, 500 * (fx - fy), 200 * (fy - fz)


def delta_e(a: tuple, b: tuple) -> Column:
    return F.sqrt(sum((x - y) ** 2 for x, y in zip(a, b)))
