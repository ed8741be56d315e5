"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def signed_nibble(word: Column, k: int) -> Column:
    """The k-th four-bit two's complement number of a word."""
    n = F.shiftright(word, 4 * k).bitwiseAND(F.lit(15))
    return n - n.bitwiseAND(F.lit(8)) * 2


def sign_bit(word: Column, k: int) -> Column:
    """The k-th bit of a word as 1 (clear) or -1 (set)."""
    return 1 - 2 * F.shiftright(word, k).bitwiseAND(F.lit(1))


def baseline_id(a: Column, b: Column) -> Column:
    return 256 * a + b


def polyval(coeffs: list[float], x: Column) -> Column:
    """Horner's rule, lowest power first."""
    out: Column = F.lit(0.0)
    for c in reversed(coeffs):
        out = out * x + F.lit(c)
    return out


def sexagesimal_to_degrees(value: Column) -> Column:
    """ddmmss.s as degrees; minutes or seconds of 60 or more give null."""
    size = F.abs(value)
    d, m = F.floor(size / 10000), F.floor(F.floor(size / 100) % 100)
    s = size - d * 10000 - m * 100
    return F.when((m < 60) & (s < 60), F.signum(value) * (d + m / 60 + s / 3600))


def expand_ranges(text: Column) -> Column:
    """"1-3,7" as an array of integers."""
    parts = F.transform(F.split(text, ","), lambda p: F.sequence(F.split(p, "-")[0].cast("int"), F.element_at(F.split(p, "-"), -1).cast("int")))
    return F.flatten(parts)


def _col(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def dm_delay_ms(dm: Column, f1: Column | float, f2: Column | float) -> Column:
    """Milliseconds by which f1 (GHz) lags f2."""
    return 4.15 * dm * (F.pow(_col(f1), -2) - F.pow(_col(f2), -2))


def dm_step(fch1: float, foff: float, nchans: int, tsamp_ms: float) -> float:
    """The dispersion measure of a delay of one sample over the band (GHz, ms)."""
    end = fch1 + foff * (nchans - 1)
    return tsamp_ms / 4.15 / abs(fch1**-2 - end**-2)


def idt_to_dm(idt: Column, fch1: float, foff: float, nchans: int, tsamp_ms: float) -> Column:
    return F.abs(idt * dm_step(fch1, foff, nchans, tsamp_ms))


def dm_to_idt(dm: Column, fch1: float, foff: float, nchans: int, tsamp_ms: float) -> Column:
    """In samples, not rounded."""
    return dm / dm_step(fch1, foff, nchans, tsamp_ms)


def roll_shift(dm: float, freq_ghz: Column, ref_ghz: float, tsamp_s: float) -> Column:
    """Whole samples by which a channel is rolled for a dispersion measure."""
    return F.bround(4.15 * dm * (ref_ghz**-2 - F.pow(freq_ghz, -2)) / 1e3 / tsamp_s).cast("long")


def separation(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Great-circle distance in degrees, by haversines."""
    r = F.radians
    h = F.pow(F.sin((r(dec2) - r(dec1)) / 2), 2) + F.cos(r(dec1)) * F.cos(r(dec2)) * F.pow(F.sin((r(ra2) - r(ra1)) / 2), 2)
    return F.degrees(2 * F.asin(F.sqrt(F.least(h, F.lit(1.0)))))


def position_angle(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Degrees from north through east in which the second point stands."""
    r = F.radians
    d = r(ra2) - r(ra1)
    return F.pmod(F.degrees(F.atan2(F.sin(d), F.cos(r(dec1)) * F.tan(r(dec2)) - F.sin(r(dec1)) * F.cos(d))), F.lit(360.0))


def direction_cosines(ra: Column, dec: Column, ra0: Column | float, dec0: Column | float) -> tuple[Column, Column]:
    """l and m about a phase centre."""
    r = F.radians
    d, d0 = r(ra) - r(_col(ra0)), r(_col(dec0))
    return F.cos(r(dec)) * F.sin(d), F.sin(r(dec)) * F.cos(d0) - F.cos(r(dec)) * F.sin(d0) * F.cos(d)


def strict_sexagesimal(value: Column) -> Column:
    """As sexagesimal_to_degrees, but minutes or seconds of 60 or more raise an error."""
    out = sexagesimal_to_degrees(value)
    return F.when(value.isNotNull() & out.isNull(), F.raise_error(F.concat(F.lit("invalid sexagesimal value "), value.cast("string"))).cast("double")).otherwise(out)


def degrees_to_sexagesimal(deg: Column) -> Column:
    """Degrees as ddmmss.s."""
    size = F.abs(deg)
    d = F.floor(size)
    m = F.floor((size - d) * 60)
    return F.signum(deg) * (d * 10000 + m * 100 + ((size - d) * 60 - m) * 60)


def format_hms(hours: Column) -> Column:
    """Hours as hh:mm:ss.ss; a rounded 60th second carries over."""
    c = F.bround(F.abs(hours) * 360000).cast("long")
    part = lambda n, k: F.lpad(F.expr("cast(0 as bigint)") + n.cast("long"), k, "0")
    text = F.concat_ws(":", part(F.floor(c / 360000), 2), part(F.floor(c / 6000) % 60, 2), F.concat(part(F.floor(c / 100) % 60, 2), F.lit("."), part(c % 100, 2)))
    return F.when(hours < 0, F.concat(F.lit("-"), text)).otherwise(text)


def parse_hms(text: Column) -> Column:
    """hh:mm:ss.s as hours; null if it is none."""
    p = F.split(F.regexp_replace(F.trim(text), "^[-+]", ""), ":")
    size = p[0].try_cast("double") + p[1].try_cast("double") / 60 + p[2].try_cast("double") / 3600
    return F.when(F.size(p) == 3, F.when(F.startswith(F.trim(text), F.lit("-")), -size).otherwise(size))


def mjd(ts: Column) -> Column:
    """Modified Julian date of a UTC time."""
    return F.unix_micros(ts.cast("timestamp")) / 86_400_000_000.0 + 40587


def mjd_to_timestamp(day: Column) -> Column:
    return F.timestamp_micros(F.bround((day - 40587) * 86_400_000_000.0).cast("long"))


def bat_to_mjd(bat: Column, leap_seconds: Column | float) -> Column:
    """Binary atomic time (microseconds since MJD 0 in atomic time) as UTC MJD."""
    return (bat / 1e6 - _col(leap_seconds)) / 86400.0


#: The days from which UTC is one more second behind atomic time; 10 s from the first one on.
LEAP_DAYS = (
    "1972-01-01", "1972-07-01", "1973-01-01", "1974-01-01", "1975-01-01", "1976-01-01", "1977-01-01", "1978-01-01", "1979-01-01", "1980-01-01",
    "1981-07-01", "1982-07-01", "1983-07-01", "1985-07-01", "1988-01-01", "1990-01-01", "1991-01-01", "1992-07-01", "1993-07-01", "1994-07-01",
    "1996-01-01", "1997-07-01", "1999-01-01", "2006-01-01", "2009-01-01", "2012-07-01", "2015-07-01", "2017-01-01",
)


def leap_seconds(day: Column) -> Column:
    """Atomic time less UTC on a day (MJD, with fraction), in seconds; 0 before 1972."""
    from datetime import date

    starts = F.array(*[F.lit((date.fromisoformat(d) - date(1858, 11, 17)).days) for d in LEAP_DAYS])
    n = F.size(F.filter(starts, lambda d: d <= day))
    return F.when(n > 0, n + 9).otherwise(0)


def atomic_to_mjd(bat: Column) -> Column:
    """Binary atomic time as UTC MJD, with the leap seconds of its day (UTC: the count is taken from a first guess)."""
    guess = bat / 86_400e6
    return bat_to_mjd(bat, leap_seconds(guess - leap_seconds(guess) / 86400.0))


def antenna_number(name: Column) -> Column:
    """The number behind an antenna name's two letters; null where there is none."""
    return F.substring(name, 3, 20).try_cast("int")


def scan_intent(template: Column, field: Column) -> Column:
    """What a scan was for, from its schedule's template and its field's name."""
    pulsar, low = field.startswith("PSR"), F.lower(template)
    flyseye = F.when(pulsar, "PSR_CHECK").otherwise("FRB_FLYSEYE")
    standard = F.when(pulsar & field.contains("beam"), "PSR_CAL").otherwise("UNKNOWN")
    return F.coalesce(F.when(low.contains("flyseye"), flyseye).when(low == "standard", standard), F.lit("UNKNOWN"))


def parse_time(text: Column, formats: tuple[str, ...] = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd-HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")) -> Column:
    """The first format that fits."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def fixed_longitude(deg: Column) -> Column:
    """180 - l above 180. Kept as it is in old tables, though no longitude of the same place."""
    return F.when(deg > 180, 180 - deg).otherwise(deg)


def coerced(text: Column) -> Column:
    """The number in a text, else null."""
    return F.coalesce(text.try_cast("long").cast("double"), text.try_cast("double"))


def finite(x: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def divisors(n: Column) -> Column:
    return F.filter(F.sequence(F.lit(1).cast("long"), n.cast("long")), lambda d: n % d == 0)


def next_divisor(n: Column, least: Column) -> Column:
    """The smallest divisor of n that is at least `least`."""
    return F.filter(F.sequence(least.cast("long"), n.cast("long")), lambda d: n % d == 0)[0]


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def saturated(x: Column, low: int, high: int) -> Column:
    """Rounded half to even and cut off at the ends of an integer type."""
    return F.least(F.greatest(F.bround(x), F.lit(float(low))), F.lit(float(high))).cast("int")


def padded(n: Column, prefix: str, width: int) -> Column:
    return F.concat(F.lit(prefix), F.lpad(n.cast("string"), width, "0"))


def file_parts(path: Column) -> tuple[Column, Column, Column]:
    """Antenna, scan and beam of .../ak01/scan/beam02.fil."""
    return F.regexp_extract(path, r"/(ak[0-9]+)/", 1), F.regexp_extract(path, r"/([0-9]{14})/", 1), F.regexp_extract(path, r"beam([0-9]+)", 1).try_cast("int")


def channel_of(card: Column, mask: Column, per_card: int = 8) -> Column:
    """The channel that a one-bit mask names on a card."""
    return card * per_card + F.bround(F.log2(mask.cast("double"))).cast("long")


def complex_product(a_re: Column, a_im: Column, b_re: Column, b_im: Column, conj: bool = True) -> tuple[Column, Column]:
    """a times b, or its conjugate."""
    b_im = -b_im if conj else b_im
    return a_re * b_re - a_im * b_im, a_re * b_im + a_im * b_re


def magnitude_and_angle(re: Column, im: Column) -> tuple[Column, Column]:
    return F.hypot(re, im), F.atan2(im, re)


def shifted(i: Column, n: int) -> Column:
    """The place of index i after an exchange of halves."""
    return F.pmod(i + n // 2, F.lit(n))


def triangular_index(x: Column, y: Column, n: int) -> Column:
    """The place of (x, y), x >= y, in the upper triangle of an n x n matrix written row by row."""
    rest = n - y
    return n * (n + 1) / 2 - rest * (rest + 1) / 2 + x - y


def unpack_word(word: Column, bits: int, k: int) -> Column:
    """The k-th sample of a 32-bit word of samples with `bits` bits, the low ones first; one bit is 1 or -1, more are two's complement."""
    if bits == 1:
        return sign_bit(word, k)
    n = F.shiftright(word, bits * k).bitwiseAND(F.lit((1 << bits) - 1))
    return n - n.bitwiseAND(F.lit(1 << (bits - 1))) * 2


def histogram(x: DataFrame, by: str, codes: list[str]) -> DataFrame:
    """Per `by` and code how often it occurs in any of the columns."""
    return x.select(by, F.explode(F.array(*codes)).alias("code")).groupBy(by, "code").agg(F.count(F.lit(1)).alias("n"))
