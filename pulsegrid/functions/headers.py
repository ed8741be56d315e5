"""Frame headers of 64 bytes: a bit-field codec as column expressions, and times that carry from frames to seconds to epochs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the format: field, 32-bit little-endian word, lowest bit, bits.
FIELDS = (
    ("frame", 0, 0, 32),
    ("seconds", 1, 0, 30), ("iscomplex", 1, 30, 1), ("invalid", 1, 31, 1),
    ("stationid", 2, 0, 16), ("representation", 2, 22, 4), ("epoch", 2, 26, 6),
    ("framelength8", 3, 0, 24), ("nbits", 3, 24, 5), ("version", 3, 29, 3),
    ("groupid", 4, 0, 16), ("threadid", 4, 16, 16),
    ("nchan", 5, 0, 16), ("blocklength", 5, 16, 16),
    ("period", 7, 0, 16),
    ("samples_low", 8, 0, 32), ("samples_high", 9, 0, 32),
    ("sync", 11, 0, 32),
)
WORDS = 16


def _word(header: Column, k: int) -> Column:
    h = F.hex(F.substring(header, 4 * k + 1, 4))
    return F.conv(F.concat(*[F.substring(h, at, 2) for at in (7, 5, 3, 1)]), 16, 10).cast("long")


def decode(header: Column) -> Column:
    """A struct of all fields (longs); null where the header is shorter than 64 bytes. totalsamples joins its two words, the first the low one."""
    bits = {name: F.shiftright(_word(header, k), low).bitwiseAND(F.lit((1 << n) - 1).cast("long")) for name, k, low, n in FIELDS}
    samples = (F.shiftleft(bits.pop("samples_high"), 32).bitwiseOR(bits.pop("samples_low"))).alias("totalsamples")
    return F.when(F.octet_length(header) >= 4 * WORDS, F.struct(*[c.alias(n) for n, c in bits.items()], samples))


def encode(**fields: Column) -> Column:
    """The header of the given fields, others 0. A value that its bits cannot hold is an error when the row is read."""
    known = {name: (k, low, n) for name, k, low, n in FIELDS}
    if "totalsamples" in fields:
        total = fields.pop("totalsamples").cast("long")
        fields |= {"samples_high": F.shiftrightunsigned(total, 32), "samples_low": total.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))}
    words = [F.lit(0).cast("long")] * WORDS
    for name, value in fields.items():
        k, low, n = known[name]
        value = value.cast("long")
        fits = F.when((value >= 0) & (value < (1 << n)), value).otherwise(F.raise_error(F.concat(F.lit(f"{name} does not fit {n} bits: "), value.cast("string"))).cast("long"))
        words[k] = words[k].bitwiseOR(F.shiftleft(fits, low))
    text = [F.lpad(F.hex(w), 8, "0") for w in words]
    return F.unhex(F.concat(*[F.substring(t, at, 2) for t in text for at in (7, 5, 3, 1)]))


def epoch_start(epoch: Column) -> Column:
    """The day (MJD) on which a half-year epoch begins; 0 is the first half of 2000."""
    day = F.make_date((2000 + F.floor(epoch / 2)).cast("int"), (F.pmod(epoch, F.lit(2)) * 6 + 1).cast("int"), F.lit(1))
    return F.datediff(day, F.lit("1858-11-17").cast("date")).cast("long")


def epoch_of(mjd: Column) -> Column:
    """The half-year epoch of a day (MJD)."""
    day = F.date_add(F.lit("1858-11-17").cast("date"), mjd.cast("int"))
    return ((F.year(day) - 2000) * 2 + (F.month(day) > 6).cast("int")).cast("long")


def frame_mjd(epoch: Column, seconds: Column, frame: Column, frames_per_period: int, period: Column) -> Column:
    """The frame's time as a day with fraction."""
    return epoch_start(epoch) + (seconds + frame * period / float(frames_per_period)) / 86400.0


def moved(epoch: Column, seconds: Column, frame: Column, period: Column, by: Column, frames_per_period: int) -> Column:
    """A struct (epoch, seconds, frame) `by` frames on (or back): frames carry into seconds, and seconds into the epoch of their day.

    A time before 2000 is an error.
    """
    total = frame + by
    periods = F.floor(total / frames_per_period)
    at = epoch_start(epoch) * 86400 + seconds + periods * period  # seconds since day 0
    now = epoch_of(F.floor(at / 86400))
    now = F.when(now >= 0, now).otherwise(F.raise_error(F.lit("time before the first epoch")).cast("long"))
    return F.struct(now.alias("epoch"), (at - epoch_start(now) * 86400).alias("seconds"), (total - periods * frames_per_period).alias("frame"))
