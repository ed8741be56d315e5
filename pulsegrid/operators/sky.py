"""The sky in pixels of equal area, as column expressions: rings of constant declination, 12 n^2 pixels.

Ring i of 4 n - 1 (from the north) has min(4 i, 4 n, 16 n - 4 i) pixels; all have the area 4 pi / (12 n^2). Pixels
are numbered along the rings. ``pixel`` gives the pixel of a direction and ``in_disc`` the pixels whose centres lie
within a radius of one, each in closed form, so both are rows of a join key, and nothing is looked up. A search
around a position looks into the pixels whose centres lie within the radius and the largest distance of a point
from its pixel's centre, so it meets all that is near and little else, across 0 degrees and at the poles too.
"""

from __future__ import annotations

import math
from math import acos, cos, floor, log2, pi, radians, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import separation

_SLACK = 1e-9  # degrees; the exact separation decides
LISTS = 256 << 20  # most bytes of lists of names that go to every task


def pixel(ra: Column, dec: Column, n: int) -> Column:
    """The number of the pixel that holds a direction (degrees)."""
    z = F.sin(F.radians(dec))
    turn = F.pmod(ra, F.lit(360.0)) / 90.0
    along, up = n * (0.5 + turn), n * 0.75 * z
    a, b = F.floor(along - up), F.floor(along + up)  # rising and falling edges
    ring = n + 1 + a - b
    place = F.pmod(F.floor((a + b - n + (1 - F.pmod(ring, F.lit(2))) + 1) / 2), F.lit(4 * n))
    middle = 2 * n * (n - 1) + (ring - 1) * 4 * n + place
    part = turn - F.floor(turn)
    high = n * F.sqrt(F.greatest(3 * (1 - F.abs(z)), F.lit(0.0)))
    c, d = F.least(F.floor(part * high), F.lit(n - 1)), F.least(F.floor((1 - part) * high), F.lit(n - 1))
    cap = c + d + 1
    at = F.pmod(F.floor(turn * cap), 4 * cap)
    polar = F.when(z > 0, 2 * cap * (cap - 1) + at).otherwise(12 * n * n - 2 * cap * (cap + 1) + at)
    return F.when(F.abs(z) <= 2 / 3, middle).otherwise(polar).cast("long")


def _ring(i: Column, n: int) -> tuple[Column, Column, Column, Column]:
    """Of ring i: z, its number of pixels, the first pixel's number, and that pixel's right ascension in units of a pixel."""
    north, south = i < n, i > 3 * n
    j = 4 * n - i
    z = F.when(north, 1 - i * i / (3.0 * n * n)).when(south, j * j / (3.0 * n * n) - 1).otherwise(4 / 3 - 2 * i / (3.0 * n))
    count = F.when(north, 4 * i).when(south, 4 * j).otherwise(F.lit(4 * n))
    first = F.when(north, 2 * i * (i - 1)).when(south, 12 * n * n - 2 * j * (j + 1)).otherwise(2 * n * (n - 1) + (i - n) * 4 * n)
    offset = F.when(north | south | (F.pmod(i - n, F.lit(2)) == 0), 0.5).otherwise(0.0)
    return z, count, first, offset


def in_disc(rows: DataFrame, ra: str, dec: str, radius: float, n: int, name: str = "pix") -> DataFrame:
    """Each row once for every pixel whose centre lies within radius (degrees) of (ra, dec), with that pixel as a column."""
    low, high = (F.sin(F.radians(F.greatest(F.col(dec) - radius, F.lit(-90.0)))), F.sin(F.radians(F.least(F.col(dec) + radius, F.lit(90.0)))))
    # the ring at or above a z: its number falls as z rises
    above = lambda z: F.when(z > 2 / 3, F.floor(n * F.sqrt(F.greatest(3 * (1 - z), F.lit(0.0))))).when(z >= -2 / 3, F.floor(n * (2 - 1.5 * z))).otherwise(F.floor(4 * n - n * F.sqrt(F.greatest(3 * (1 + z), F.lit(0.0)))))
    rings = F.sequence(F.greatest(above(high), F.lit(1)), F.least(above(low) + 1, F.lit(4 * n - 1)))
    out = rows.withColumn("_i", F.explode(rings))
    z, count, first, offset = _ring(F.col("_i"), n)
    out = out.withColumns({"_z": z, "_count": count, "_first": first, "_offset": offset})
    flat = F.sqrt(F.greatest(1 - F.col("_z") * F.col("_z"), F.lit(0.0))) * F.cos(F.radians(dec))
    reach = (cos(radians(radius)) - F.col("_z") * F.sin(F.radians(dec)))
    # half the arc of the ring that lies in the disc, in degrees
    arc = F.when(reach > flat, F.lit(-1.0)).when(reach <= -flat, F.lit(180.0)).otherwise(F.degrees(F.acos(reach / flat)))
    step = 360.0 / F.col("_count")
    a, b = F.ceil((F.col(ra) - arc) / step - F.col("_offset")), F.floor((F.col(ra) + arc) / step - F.col("_offset"))
    b = F.least(b, a + F.col("_count") - 1)  # a whole ring once
    places = F.when((arc >= 0) & (b >= a), F.sequence(a, F.greatest(a, b))).otherwise(F.array().cast("array<bigint>"))
    out = out.withColumn("_j", F.explode(places))
    return out.withColumn(name, (F.col("_first") + F.pmod("_j", "_count")).cast("long")).drop("_i", "_z", "_count", "_first", "_offset", "_j")


def widest(n: int) -> float:
    """The largest distance of a point from the centre of its pixel, in degrees."""
    z = 1 - (1 - 1 / n) ** 2 / 3
    dot = z * 2 / 3 + sqrt(1 - z * z) * sqrt(1 - 4 / 9) * cos(pi / (4 * n))
    return 180 / pi * acos(min(1.0, dot))


def fitting(radius: float, most: int = 1 << 12) -> int:
    """A power of two whose pixels are about as wide as the radius (degrees)."""
    wide = 58.6  # of n = 1
    return 1 << max(0, min(floor(log2(most)), floor(log2(wide / radius)))) if radius < wide else 1


def exposure(scans: DataFrame, radius: float, n: int) -> DataFrame:
    """scans: ra, dec, duration. Per pixel: the sum of durations of the scans that see its centre, and how many."""
    once = scans.groupBy("ra", "dec").agg(F.sum("duration").alias("duration"), F.count(F.lit(1)).alias("scans"))  # repeated pointings meet before they spread
    return in_disc(once, "ra", "dec", radius, n).groupBy("pix").agg(F.sum("duration").alias("duration"), F.sum("scans").alias("scans"))


def near(left: DataFrame, right: DataFrame, radius: float, on: list[str] = []) -> DataFrame:  # noqa: B006
    """left (ra, dec) with the right rows (_ra, _dec) within radius degrees and equal in ``on``, and sep. Right is spread over pixels, so it should be the smaller."""
    n = fitting(radius)
    spread = in_disc(right, "_ra", "_dec", radius + widest(n) + _SLACK, n, "_pix")
    own = F.coalesce(pixel(F.col("ra"), F.col("dec"), n), F.lit(-1))  # never null, or Spark would work it out for each row that left is made from, to leave nulls out
    met = left.withColumn("_pix", own).join(spread, [*on, "_pix"])
    sep = separation(F.col("ra"), F.col("dec"), F.col("_ra"), F.col("_dec"))
    return met.withColumn("sep", sep).filter(F.col("sep") < radius).drop("_pix")


def identify(cand: DataFrame, catalogue: DataFrame, radius: float, dm_err: float) -> DataFrame:
    """cand: rid, ra, dec, dm. catalogue: name, ra, dec, dm. Of the sources within radius those within dm_err in dm.

    Per candidate: main (nearest in dm, ties by name) and names (all, by name, comma-joined); both null where there is none.
    Rows of one rid share what any of them meets.

    Equal (ra, dec, dm) of either side meet once. Candidates are dealt and sorted by rid before names are added, so lists of
    names are neither shuffled nor sorted with them; where the positions' lists take more than LISTS bytes they are.
    """
    from .clusters import cut

    at, by = ["ra", "dec", "dm"], Window.partitionBy("rid")
    band = lambda c: F.floor(F.col(c) / dm_err)
    known = catalogue.groupBy(*at).agg(F.collect_set("name").alias("_names"), F.min("name").alias("name")).withColumnsRenamed({c: f"_{c}" for c in at})
    known = known.withColumn("_m", F.explode(F.array(*[band("_dm") + k for k in (-1, 0, 1)])))
    met = near(cand.select(*at, band("dm").alias("_m")).distinct(), known, radius, ["_m"]).withColumn("_gap", F.abs(F.col("dm") - F.col("_dm"))).filter(F.col("_gap") < dm_err)
    found = met.groupBy(*at).agg(F.min(F.struct("_gap", "name")).alias("_best"), F.flatten(F.collect_list("_names")).alias("_all"))
    found = cut(found.withColumn("_all", F.sort_array(F.array_distinct("_all"))))
    size = found.agg(F.sum(F.octet_length(F.array_join("_all", ",")) + 16 * F.size("_all") + 64)).first()[0] or 0
    own = cand.select("rid", *at).withColumn("_n", F.count(F.lit(1)).over(by))  # deals and sorts rows by rid
    rows = own.join(F.broadcast(found) if size <= LISTS else found, at, "left")
    every = rows.select("rid", "_n", "_all", F.min("_best").over(by).alias("m"), F.collect_list("_all").over(by).alias("_lists"))
    every = every.select("rid", "m", F.when(F.col("_n") == 1, F.col("_all")).otherwise(F.sort_array(F.array_distinct(F.flatten("_lists")))).alias("_names"))
    return every.select("rid", F.col("m.name").alias("main"), F.when(F.size("_names") > 0, F.array_join("_names", ",")).alias("names"))


def tracks(fixes: DataFrame, step: int, block: int) -> DataFrame:
    """fixes: sat, t (whole), ra, dec. Positions at every multiple of step between a fix and the next: sat, t, ra, dec, and chord, the part of the way and both fixes.

    Interpolated along the chord of the two directions. Fixes are put in order by block of t, the last one of each block
    is carried on to the next that has any, so no task holds an object's whole track.
    """
    cols = ["t", "ra", "dec"]
    rows = fixes.groupBy("sat", "t").agg(F.min(F.struct("ra", "dec")).alias("p")).select("sat", "t", "p.*").withColumn("_b", F.expr(f"t div {block}"))
    firsts = rows.groupBy("sat", "_b").agg(F.min(F.struct(*cols)).alias("_first"))
    after = firsts.select("sat", "_b", F.lead("_first").over(Window.partitionBy("sat").orderBy("_b")).alias("_after"))  # a row for each block
    nxt = F.coalesce(F.lead(F.struct(*cols)).over(Window.partitionBy("sat", "_b").orderBy("t")), F.col("_after"))
    legs = rows.join(after, ["sat", "_b"]).withColumn("_n", nxt).filter("_n is not null")
    start = F.ceil(F.col("t") / step) * step
    times = F.when(start < F.col("_n.t"), F.sequence(start, F.greatest(start, F.floor((F.col("_n.t") - 1) / step) * step), F.lit(step).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    legs = legs.withColumn("_at", F.explode(times)).withColumn("_f", (F.col("_at") - F.col("t")) / (F.col("_n.t") - F.col("t")))

    def unit(ra: Column, dec: Column) -> tuple[Column, Column, Column]:
        a, d = F.radians(ra), F.radians(dec)
        return F.cos(d) * F.cos(a), F.cos(d) * F.sin(a), F.sin(d)

    x, y, z = ((1 - F.col("_f")) * p + F.col("_f") * q for p, q in zip(unit(F.col("ra"), F.col("dec")), unit(F.col("_n.ra"), F.col("_n.dec")), strict=True))
    chord = F.struct(F.col("_f").alias("part"), "ra", "dec", F.col("_n.ra").alias("ra2"), F.col("_n.dec").alias("dec2"))
    legs = legs.select("sat", F.col("_at").alias("t"), x.alias("x"), y.alias("y"), z.alias("z"), chord.alias("chord"))
    ra, dec = F.pmod(F.degrees(F.atan2("y", "x")), F.lit(360.0)), F.degrees(F.atan2(F.col("z"), F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))))
    return legs.select("sat", "t", ra.alias("ra"), dec.alias("dec"), "chord")


def from_chord(part: float, ra: float, dec: float, ra2: float, dec2: float, to_ra: float, to_dec: float) -> float:
    """Degrees between a position on a chord and a direction, by the C library's functions in double precision."""
    (a, d), (a2, d2) = ((math.radians(x), math.radians(y)) for x, y in ((ra, dec), (ra2, dec2)))
    x = (1 - part) * cos(d) * cos(a) + part * cos(d2) * cos(a2)
    y = (1 - part) * cos(d) * math.sin(a) + part * cos(d2) * math.sin(a2)
    z = (1 - part) * math.sin(d) + part * math.sin(d2)
    a, d = (math.radians(math.degrees(v)) for v in (math.atan2(y, x), math.atan2(z, sqrt(x * x + y * y))))
    b, e = math.radians(to_ra), math.radians(to_dec)
    return math.degrees(2 * math.asin(sqrt(min(1.0, math.sin((e - d) / 2) ** 2 + cos(d) * cos(e) * math.sin((b - a) / 2) ** 2))))


def passes(positions: DataFrame, beams: DataFrame, radius: float, length: int) -> DataFrame:
    """positions: as tracks gives them. beams: beam, ra, dec. Of each object and pass of ``length`` times in which it comes within radius of a beam: sep, and the earliest t and smallest beam that have it.

    Java's sines and the C library's differ in the last bit, so a distance that is the radius itself would be inside by one and outside by
    the other. Distances so close to it are few; they are settled by the C library's functions, as SQL's are.
    """
    around = beams.select("beam", F.col("ra").alias("_ra"), F.col("dec").alias("_dec"))
    met = near(positions, around, radius + 2 * _SLACK).withColumns({"leg": F.expr(f"t div {length}"), "_edge": F.abs(F.col("sep") - radius) <= _SLACK})
    found = F.struct(F.round("sep", 6).alias("sep"), "t", "beam")
    kind = beams.schema["beam"].dataType.simpleString()
    settle = F.udf(lambda rows: [(round(sep, 6), r.t, r.beam) for r in rows if (sep := from_chord(*r.chord, r._ra, r._dec)) < radius], f"array<struct<sep: double, t: bigint, beam: {kind}>>")
    inside = F.min(F.when(~F.col("_edge") & (F.col("sep") < radius), found)).alias("m")
    best = met.groupBy("sat", "leg").agg(inside, F.collect_list(F.when(F.col("_edge"), F.struct("t", "beam", "chord", "_ra", "_dec"))).alias("_close"))
    best = best.withColumn("m", F.array_min(F.concat(F.array("m"), settle("_close"))))  # nulls are skipped
    return best.filter("m is not null").select("sat", "leg", "m.sep", "m.t", "m.beam")
