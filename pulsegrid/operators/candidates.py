"""Filters, ranks, matches and groups over candidate lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import sky


def basic_filter(cand: DataFrame, max_width: int, min_idt: int, min_sn: float) -> DataFrame:
    return cand.filter((F.col("boxcar") < max_width) & (F.col("idt") > min_idt) & (F.col("sn") > min_sn))


def real_time_filter(cand: DataFrame, min_sn: float, max_width: int, min_dm: float, min_secs: float = 10, skip_beam: int = 35) -> DataFrame:
    """Also without the first seconds, where the statistics have not settled."""
    return cand.filter((F.col("sn") > min_sn) & (F.col("boxcar") < max_width) & (F.col("dm") > min_dm) & (F.col("beam") != skip_beam) & (F.col("secs") > min_secs))


def top_per_beam(cand: DataFrame, n: int) -> DataFrame:
    """The n strongest of each beam; ties by rid. Spark keeps n rows per task before the shuffle."""
    order = Window.partitionBy("beam").orderBy(F.desc("sn"), "rid")
    return cand.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def best(cand: DataFrame) -> DataFrame:
    return cand.orderBy(F.desc("sn"), "rid").limit(1)


def nearest(left: DataFrame, right: DataFrame, tol: int, on: list[str]) -> DataFrame:
    """For each left row (lid, t) the right row (rid, t) nearest in t within tol, equal on the columns `on`; ties by rid.

    A range join on buckets of the tolerance: the left row looks in three buckets, so no row meets more
    than its neighbourhood.
    """
    width = max(tol, 1)
    near = left.withColumn("_b", F.explode(F.sequence(F.floor((F.col("t") - tol) / width), F.floor((F.col("t") + tol) / width))))
    other = right.select(*on, F.col("rid"), F.col("t").alias("_t"), F.floor(F.col("t") / width).alias("_b"))
    met = near.join(other, [*on, "_b"]).withColumn("gap", F.abs(F.col("t") - F.col("_t"))).filter(F.col("gap") < tol)
    return met.groupBy("lid").agg(F.min(F.struct("gap", "rid")).alias("m")).select("lid", "m.rid", "m.gap")


def as_of_backward(left: DataFrame, right: DataFrame, on: list[str], width: int = 4096) -> DataFrame:
    """For each left row (lid, t) the latest right row (rid, t) at or before it, of one time the largest rid.

    Both sides are sorted together by block of time; what a block lacks it takes from the last right row of the
    blocks before, of which there is a row each.
    """
    both = left.select(*on, "t", "lid", F.lit(None).cast("long").alias("rid")).unionByName(right.select(*on, "t", F.lit(None).cast("long").alias("lid"), "rid"))
    both = both.withColumn("_b", F.expr(f"t div {width}"))
    ends = right.select(*on, "t", "rid").groupBy(*on, F.expr(f"t div {width}").alias("_b")).agg(F.max_by("rid", F.struct("t", "rid")).alias("_end"))
    blocks = both.select(*on, "_b").distinct().join(ends, [*on, "_b"], "left")
    carry = blocks.select(*on, "_b", F.last("_end", ignorenulls=True).over(Window.partitionBy(*on).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    order = Window.partitionBy(*on, "_b").orderBy("t", F.col("lid").isNotNull(), "rid").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("rid", F.last("rid", ignorenulls=True).over(order)).filter("lid is not null").join(carry, [*on, "_b"], "left")
    return met.select("lid", F.coalesce("rid", "_before").alias("rid"))


def as_of_within(left: DataFrame, right: DataFrame, on: list[str], most: float, strict: bool = True) -> DataFrame:
    """As as_of_backward, with the right row's age (left t less its t). One of more than ``most``, or none, is an error when read; if not strict, null."""
    times = right.groupBy(*on, "rid").agg(F.max("t").alias("_t")).select("rid", *on, "_t")
    met = as_of_backward(left, right, on).join(left.select("lid", "t", *on), "lid").join(times, ["rid", *on], "left").withColumn("age", F.col("t") - F.col("_t"))
    good = F.coalesce(F.col("age") <= most, F.lit(False))
    wrong = F.raise_error(F.concat(F.lit("nothing within the interval at "), F.col("t").cast("string"))).cast("long") if strict else F.lit(None).cast("long")
    return met.select("lid", F.when(good, F.col("rid")).otherwise(wrong).alias("rid"), F.when(good, F.col("age")).alias("age"))


def overlap_pairs(box: DataFrame, reach: int, idt_reach: int, width: int = 64) -> DataFrame:
    """box: beam, rid, t0, t1, i0, i1. Pairs a < b of a beam that come within reach in time and idt_reach in idt; each found in one cell of time and idt."""
    tall = max(8, 2 * idt_reach)
    spread = lambda lo, hi, r, w: F.explode(F.sequence(F.floor((F.col(lo) - r) / w), F.floor((F.col(hi) + r) / w)))
    rows = box.withColumn("_b", spread("t0", "t1", reach, width)).withColumn("_i", spread("i0", "i1", idt_reach, tall))
    a, b = rows.alias("a"), rows.alias("b")
    near = (F.col("a.t0") - reach <= F.col("b.t1")) & (F.col("b.t0") <= F.col("a.t1") + reach)
    near &= (F.col("a.i0") - idt_reach <= F.col("b.i1")) & (F.col("b.i0") <= F.col("a.i1") + idt_reach)
    once = (F.col("a._b") == F.floor((F.greatest("a.t0", "b.t0") - reach) / width)) & (F.col("a._i") == F.floor((F.greatest("a.i0", "b.i0") - idt_reach) / tall))
    on = (F.col("a.beam") == F.col("b.beam")) & (F.col("a._b") == F.col("b._b")) & (F.col("a._i") == F.col("b._i")) & (F.col("a.rid") < F.col("b.rid"))
    return a.join(b, on & near & once).select(F.col("a.rid").alias("a"), F.col("b.rid").alias("b"))


def points(cand: DataFrame) -> DataFrame:
    """Candidates as boxes without extent; merging alone widens them."""
    return cand.select("beam", "rid", "sn", F.col("sampno").alias("t0"), F.col("sampno").alias("t1"), F.col("idt").alias("i0"), F.col("idt").alias("i1"), F.lit(1).cast("long").alias("ncands"))


def band_join(cand: DataFrame, catalogue: DataFrame, err: int) -> DataFrame:
    """Candidates with the catalogue rows (name, dm) within err in dm, all names joined, the nearest first."""
    near = catalogue.select("name", F.col("dm").alias("cdm"), F.explode(F.sequence(F.floor((F.col("dm") - err) / err), F.floor((F.col("dm") + err) / err))).alias("_b"))
    met = cand.withColumn("_b", F.floor(F.col("dm") / err)).join(near, "_b").filter(F.abs(F.col("dm") - F.col("cdm")) < err)
    names = F.array_sort(F.collect_list(F.struct(F.abs(F.col("dm") - F.col("cdm")).alias("d"), "name")))
    return met.groupBy("rid").agg(names.alias("m")).select("rid", F.col("m")[0]["name"].alias("main"), F.array_join(F.transform("m", lambda x: x["name"]), ",").alias("names"))


def collapse_beams(cand: DataFrame, most: float = 5) -> DataFrame:
    """One candidate per sample, the strongest, unless dm rises by more than `most` from one of the sample's candidates to the next (in order of rid)."""
    by = Window.partitionBy("sampno")
    steps = cand.withColumn("_step", F.col("dm") - F.lag("dm").over(by.orderBy("rid", "sn", "beam", "dm")))
    ranked = steps.withColumns({"step": F.max("_step").over(by), "k": F.row_number().over(by.orderBy(F.desc("sn"), "rid", "beam", "dm"))})
    return ranked.filter((F.col("k") == 1) & (F.col("step").isNull() | (F.col("step") <= most))).drop("k", "_step")


def beam_filter(cand: DataFrame, max_width: int, min_idt: int, min_sn: float, skip_beam: int = 35) -> DataFrame:
    return basic_filter(cand, max_width, min_idt, min_sn).filter(F.col("beam") != skip_beam)


def summary_filter(cand: DataFrame, max_width: int, min_dm: float, min_sn: float) -> DataFrame:
    return cand.filter((F.col("boxcar") < max_width) & (F.col("dm") >= min_dm) & (F.col("sn") >= min_sn))


def representatives(reps: DataFrame, min_dm: float = 100, max_width: int = 10) -> DataFrame:
    return reps.filter((F.col("dm") >= min_dm) & (F.col("boxcar") <= max_width))


def strong_and_late(cand: DataFrame, min_sn: float = 9.5, min_secs: float = 10, max_width: int = 10, min_dm: float = 100) -> DataFrame:
    """The weakest first, as a numeric sort by S/N gives them."""
    return cand.filter((F.col("sn") > min_sn) & (F.col("secs") > min_secs) & (F.col("boxcar") < max_width) & (F.col("dm") > min_dm)).orderBy("sn", "rid")


def near_pulsar(cand: DataFrame, dm: float, deviation: float, max_width: int, beam: int) -> DataFrame:
    return cand.filter((F.abs(F.col("dm") - dm) < deviation) & (F.col("boxcar") < max_width) & (F.col("beam") == beam))


def drop_flagged_baselines(vis: DataFrame, flagged: list[int], autos: bool) -> DataFrame:
    """vis: a1, a2. Without baselines of flagged antennas, and without those of an antenna with itself if autos are flagged."""
    keep = ~(F.col("a1").isin(flagged) | F.col("a2").isin(flagged)) if flagged else F.lit(True)
    return vis.filter(keep & ((F.col("a1") != F.col("a2")) if autos else F.lit(True)))


def time_window(x: DataFrame, tstart_mjd: float, tsamp: float, centre_mjd: float, half_secs: float) -> DataFrame:
    """Samples within half_secs of a date; times before the first sample are cut off."""
    at = (centre_mjd - tstart_mjd) * 86400.0
    return x.filter(F.col("t").between(max(0, int((at - half_secs) / tsamp)), max(0, int((at + half_secs) / tsamp))))


def from_block(x: DataFrame, skip_secs: float, tsamp: float, block: int, most_blocks: int | None = None) -> DataFrame:
    """Without the whole blocks that skip_secs cover, and with at most most_blocks of the rest."""
    first = int(skip_secs / tsamp / block)
    x = x.filter(F.col("t") >= first * block)
    return x if most_blocks is None else x.filter(F.expr(f"t div {block}") < first + most_blocks)


def with_beam_offset(parts: list[tuple[DataFrame, int]]) -> DataFrame:
    """The union of candidate lists, each with its number added to the beam."""
    out = None
    for part, add in parts:
        part = part.withColumn("beam", F.col("beam") + add)
        out = part if out is None else out.unionByName(part)
    return out


def count_passing(cand: DataFrame, passing: Column, by: str = "beam") -> DataFrame:
    """Per `by`, and over all (null): candidates and those that pass."""
    return cand.rollup(by).agg(F.count(F.lit(1)).alias("total"), F.count_if(passing).alias("passing"))


def unmatched(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    return left.join(right.select(on), on, "left_anti")


def summed_outer(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Per key of either side the sum of both values, a missing one as 0."""
    met = left.select(key, F.col(value).alias("_a")).join(right.select(key, F.col(value).alias("_b")), key, "full")
    return met.select(key, (F.coalesce("_a", F.lit(0)) + F.coalesce("_b", F.lit(0))).alias("total"))


def baselines(antennas: DataFrame, key: str) -> DataFrame:
    """Pairs a < b of antennas (from 1 on) and their baseline number 256 a + b."""
    a, b = antennas.select((F.col(key) + 1).alias("a")), antennas.select((F.col(key) + 1).alias("b"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", (256 * F.col("a") + F.col("b")).alias("blid"))


def rereference(cand: DataFrame, ref_ghz: float, band_ghz: float, offset_ghz: float, extra_ms: float = 0.0) -> DataFrame:
    """cand with mjd moved to the arrival at infinite frequency and dm rescaled to a band shifted by offset_ghz."""
    top, low = ref_ghz + band_ghz, ref_ghz
    dt = 4.15 * F.col("dm") * (top**-2 - low**-2)
    days = (4.15 * F.col("dm") * (0 - ref_ghz**-2) + extra_ms) / 86400.0 / 1e3
    return cand.withColumns({"mjd": F.col("mjd") + days, "dm": dt / 4.15 / ((top + offset_ghz) ** -2 - (low + offset_ghz) ** -2)})


def seconds_since_first(cand: DataFrame, by: list[str]) -> DataFrame:
    first = cand.groupBy(*by).agg(F.min("mjd").alias("_first"))
    return cand.join(first, by).withColumn("secoff", (F.col("mjd") - F.col("_first")) * 86400.0).drop("_first")


def nearest_then_dm(left: DataFrame, right: DataFrame, tol: int, dm_tol: float, on: list[str]) -> DataFrame:
    """The right row (rid, t, dm) nearest in t within tol (ties by rid), as nearest finds it; the match goes if its dm is dm_tol or more away."""
    met = nearest(left, right, tol, on).join(right.select("rid", F.col("dm").alias("_dm")), "rid").join(left.select("lid", "dm"), "lid")
    met = met.withColumn("dm_gap", F.abs(F.col("dm") - F.col("_dm"))).filter(F.col("dm_gap") < dm_tol)
    return met.select("lid", "rid", "gap", "dm_gap")


def nearest_in_time_and_dm(left: DataFrame, right: DataFrame, tol: int, dm_tol: float, on: list[str], max_sn: float | None = None) -> DataFrame:
    """The nearest in time of those right rows that are within dm_tol in dm too (see nearest_then_dm for the other order), and none stronger than max_sn; ties by the smaller dm step, then rid."""
    right = right if max_sn is None else right.filter(F.col("sn") <= max_sn)
    width = max(tol, 1)
    near = left.withColumn("_b", F.explode(F.sequence(F.floor((F.col("t") - tol) / width), F.floor((F.col("t") + tol) / width))))
    other = right.select(*on, "rid", F.col("t").alias("_t"), F.col("dm").alias("_dm"), F.floor(F.col("t") / width).alias("_b"))
    met = near.join(other, [*on, "_b"]).withColumns({"gap": F.abs(F.col("t") - F.col("_t")), "dm_gap": F.abs(F.col("dm") - F.col("_dm"))})
    met = met.filter((F.col("gap") < tol) & (F.col("dm_gap") < dm_tol))
    return met.groupBy("lid").agg(F.min(F.struct("gap", "dm_gap", "rid")).alias("m")).select("lid", "m.rid", "m.gap", "m.dm_gap")


def sky_match(cand: DataFrame, catalogue: DataFrame, radius: float, dm_err: float) -> DataFrame:
    """cand: rid, ra, dec, dm. catalogue: name, ra, dec, dm (degrees). Per candidate the nearest catalogue row within radius (degrees) and dm_err, or 'None'.

    Rows meet by pixels of the sky about as wide as the radius and by bands of dm; the great-circle test decides. Equal
    (ra, dec, dm) of either side meet once, however many rows have them, and rows of one rid share the best match of any.
    """
    at = ["ra", "dec", "dm"]
    band = lambda c: F.floor(F.col(c) / dm_err)
    known = catalogue.groupBy(*at).agg(F.min("name").alias("name")).select("name", F.col("ra").alias("_ra"), F.col("dec").alias("_dec"), F.col("dm").alias("_dm"))
    known = known.withColumn("_m", F.explode(F.array(*[band("_dm") + k for k in (-1, 0, 1)])))
    met = sky.near(cand.select(*at, band("dm").alias("_m")).distinct(), known, radius, ["_m"]).filter(F.abs(F.col("dm") - F.col("_dm")) < dm_err)
    best = met.groupBy(*at).agg(F.min(F.struct(F.round("sep", 9).alias("sep"), "name")).alias("m"))  # ties within a billionth of a degree go by name
    own = cand.select("rid", *at).join(best, at, "left").select("rid", F.min("m").over(Window.partitionBy("rid")).alias("m"))
    return own.select("rid", F.coalesce("m.name", F.lit("None")).alias("name"), "m.sep")


def most_overlapping(left: DataFrame, right: DataFrame, width: int) -> DataFrame:
    """left: lid, a, b. right: rid, a, b. Per left interval the right one that shares most of it; ties by rid. Intervals meet by buckets of `width`."""
    cut = lambda df: df.withColumn("_b", F.explode(F.sequence(F.floor(F.col("a") / width), F.floor(F.col("b") / width))))
    met = cut(left).join(cut(right).select("rid", F.col("a").alias("_a2"), F.col("b").alias("_b2"), "_b"), "_b").select("lid", "rid", (F.least("b", "_b2") - F.greatest("a", "_a2")).alias("shared"))
    met = met.filter("shared > 0")
    return met.groupBy("lid").agg(F.max(F.struct("shared", (-F.col("rid")).alias("r"))).alias("m")).select("lid", (-F.col("m.r")).alias("rid"), F.col("m.shared").alias("shared"))


def nearest_source(pointings: DataFrame, catalogue: DataFrame, tol: float) -> DataFrame:
    """pointings: rid, ra, dec. catalogue: name, ra, dec. The nearest source within tol degrees; none is an error when the row is read."""
    found = sky_match(pointings.withColumn("dm", F.lit(0.0)), catalogue.withColumn("dm", F.lit(0.0)), tol, 1.0)
    none = F.raise_error(F.concat(F.lit("no source near pointing "), F.col("rid").cast("string"))).cast("string")
    return found.select("rid", F.when(F.col("sep").isNull(), none).otherwise(F.col("name")).alias("name"), "sep")


def discarded(cand: DataFrame, most_width: int) -> DataFrame:
    """Per beam and idt: candidates, and how many are wider than most_width."""
    return cand.groupBy("beam", "idt").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("boxcar") > most_width).alias("discarded"))
