"""Column expressions of light-curve analysis. Times are in days; durations say so in their names."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of the exclusion flags, and the default mask of quality bits that exclude.
NOT_FINITE, NOT_POSITIVE, BAD_ERROR, BAD_QUALITY, OUTLIER = 1, 2, 4, 8, 16
QUALITY_MASK = 0x0BEE
#: Fixed value: median absolute deviation to standard deviation, for a normal distribution.
MAD_SCALE = 1.4826


def num(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def finite(x: Column) -> Column:
    """Not null, NaN or infinite; never null itself."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def phase_days(time: Column, epoch, period) -> Column:
    """Signed time from the nearest event, in [-period/2, period/2)."""
    period = num(period)
    return F.pmod(time - num(epoch) + period / 2, period) - period / 2


def phase_fraction(time: Column, epoch, period) -> Column:
    """Signed phase from the nearest event, in [-0.5, 0.5)."""
    return phase_days(time, epoch, period) / num(period)


def cycle_index(time: Column, epoch, period) -> Column:
    """Number of the nearest event; halves go to the even one."""
    return F.rint((time - num(epoch)) / num(period)).cast("bigint")


def aliases(period: Column) -> Column:
    return F.array(F.bround(period / 2, 6), F.bround(period * 2, 6))


def clip(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, num(low)), num(high))


def sanitized(x: Column, default: float, low: float, high: float) -> Column:
    """The default where ``x`` isn't finite, else ``x`` within its bounds."""
    return F.when(finite(x), clip(x, low, high)).otherwise(num(default))


def harmonic_distance(first: Column, second: Column) -> Column:
    """Least relative distance of ``first`` from ``second`` times one of seven ratios."""
    ratios = F.array(*[num(r) for r in (1, 2, 0.5, 3, 1 / 3, 4, 0.25)])
    return F.array_min(F.transform(ratios, lambda r: F.abs(first - second * r) / first))


def cycle_harmonic(spectral: Column, period: Column) -> Column:
    """Least |k * spectral / period - 1| over five factors."""
    factors = F.array(*[num(k) for k in (0.33333, 0.5, 1, 2, 3)])
    return F.array_min(F.transform(factors, lambda k: F.abs(k * spectral / period - 1)))


def undiluted_depth(depth: Column, crowding: Column) -> Column:
    return F.when((crowding > 0) & (crowding <= 1), depth / crowding)


def effective_temperature(text: Column) -> Column:
    value = text.try_cast("double")
    return F.when(finite(value) & (value > 0), value)


def limb_darkening(temperature: Column) -> Column:
    """Quadratic coefficients by effective temperature."""
    steps = [(3800, 0.48, 0.28), (4500, 0.40, 0.27), (6000, 0.32, 0.26), (7500, 0.25, 0.24)]
    default, hottest = (0.30, 0.22), (0.18, 0.22)
    pair = lambda u: F.struct(num(u[0]).alias("u1"), num(u[1]).alias("u2"))
    out = F.when(temperature.isNull() | F.isnan(temperature) | (temperature <= 0), pair(default))
    for below, *u in steps:
        out = out.when(temperature < below, pair(u))
    return out.otherwise(pair(hottest))


def hash_number(text: Column) -> Column:
    """The first eight hexadecimal digits of sha256, as a number: stable ids, seeds and folds."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint")


def trapezoid(phase: Column, depth, duration, ingress_fraction) -> Column:
    """Flux of a trapezoid event at a phase in days: flat in the middle, sloped over the ingress."""
    half = num(duration) / 2
    slope = F.greatest(half * num(ingress_fraction), F.lit(1e-9))
    return 1 - num(depth) * clip((half - F.abs(phase)) / slope, 0, 1)


def _ramp_integral(x: Column, half: Column, slope: Column) -> Column:
    """Integral from 0 to x of the trapezoid's relative depth, odd in x."""
    flat, a = half - slope, F.abs(x)
    sloped = F.least(F.greatest(a - flat, F.lit(0.0)), slope)
    return F.signum(x) * (F.least(a, flat) + sloped - sloped * sloped / (2 * slope))


def trapezoid_exposed(time: Column, epoch, period, depth, duration, ingress_fraction, exposure) -> Column:
    """Mean of the periodic trapezoid over an exposure around ``time``, in closed form; instantaneous for no exposure."""
    half = num(duration) / 2
    slope = F.greatest(half * num(ingress_fraction), F.lit(1e-9))
    period, width = num(period), num(exposure)

    def integral(t: Column) -> Column:
        n = F.floor((t - num(epoch)) / period + 0.5)
        return n * 2 * _ramp_integral(half, half, slope) + _ramp_integral(t - num(epoch) - n * period, half, slope)

    mean = (integral(time + width / 2) - integral(time - width / 2)) / width
    return F.when(width > 0, 1 - num(depth) * mean).otherwise(trapezoid(phase_days(time, epoch, period), depth, duration, ingress_fraction))


def eclipsing_flux(time: Column, epoch, period, duration, depth, secondary=0.5, secondary_phase=0.5, ingress_fraction=0.9, ellipsoidal=0.0) -> Column:
    """Two trapezoid eclipses, the second by depth ratio and phase, and a cosine of the double frequency."""
    one = trapezoid(phase_days(time, epoch, period), depth, duration, ingress_fraction)
    two = trapezoid(phase_days(time, num(epoch) + num(secondary_phase) * num(period), period), num(depth) * num(secondary), duration, ingress_fraction)
    return one + two - 1 - num(ellipsoidal) * F.cos(4 * pi * (time - num(epoch)) / num(period))


def variable_flux(time: Column, period, amplitude, harmonic) -> Column:
    angle = 2 * pi * time / num(period)
    return 1 + num(amplitude) * (F.sin(angle) + num(harmonic) * F.sin(2 * angle))


def sky_separation(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Great-circle separation in degrees, by the haversine formula."""
    d = F.pow(F.sin(F.radians(dec2 - dec1) / 2), 2) + F.cos(F.radians(dec1)) * F.cos(F.radians(dec2)) * F.pow(F.sin(F.radians(ra2 - ra1) / 2), 2)
    return F.degrees(2 * F.asin(F.sqrt(F.least(d, F.lit(1.0)))))


def rounding_uncertainty(text: Column) -> Column:
    """Half of the last printed decimal of a number, its exponent included."""
    lowered = F.lower(F.trim(text))
    mantissa, exponent = F.split_part(lowered, F.lit("e"), F.lit(1)), F.split_part(lowered, F.lit("e"), F.lit(2))
    decimals = F.length(F.split_part(mantissa, F.lit("."), F.lit(2)))
    return 0.5 * F.pow(F.lit(10.0), F.coalesce(exponent.try_cast("int"), F.lit(0)) - decimals)


def optional_number(text: Column) -> Column:
    """Null for the usual signs of absence and for numbers that aren't finite."""
    value = F.trim(text).try_cast("double")
    return F.when(finite(value), value)


def normalized_id(text: Column) -> Column:
    """Digits of an id, without a trailing ``.0``; null for anything else."""
    stripped = F.regexp_replace(F.trim(text), r"\.0$", "")
    return F.when(stripped.rlike(r"^\d+$"), stripped)


def sector_list(text: Column) -> Column:
    """Sorted distinct sectors from 1 to 200 of a comma list; other tokens don't count."""
    tokens = F.filter(F.transform(F.split(text, ","), lambda t: F.trim(t)), lambda t: t.rlike(r"^\d{1,3}$"))
    return F.array_sort(F.array_distinct(F.filter(F.transform(tokens, lambda t: t.cast("int")), lambda n: (n >= 1) & (n <= 200))))
