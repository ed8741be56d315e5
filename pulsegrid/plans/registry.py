"""Queries over the driver's tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from ..functions import headers, scalars
from ..operators import candidates as C
from ..operators import channeliser, channels, clusters, dedisperse, imaging, sky, transforms, voltages
from ..operators import search as detect
from ..operators import spectra as S
from ..sources.tables import BLOCK, CAND_SQL, SPECTRA_SQL, candidates, read, spectra
from ..streaming import blocks, packets
from ..streaming import search as stateful
from ..streaming import trigger

_Q: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def _add(name: str, query: Callable, sql: str | None = None) -> None:
    _Q[name] = query
    if sql is None:
        return
    if sql.startswith("with recursive "):
        _SQL[name] = sql
        return
    used = [d for d, n in ((SPECTRA_SQL, "spectra"), (CAND_SQL, "cand")) if f" {n}" in f" {sql}"]
    _SQL[name] = f"with {', '.join(used)} {sql}" if used and not sql.startswith("with ") else f"with {', '.join(used)}, {sql[5:]}" if used else sql


def queries() -> dict[str, Callable]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _r(c, name: str, digits: int = 6):
    return F.round(c, digits).alias(name)


_series = lambda s, d: S.dm0(spectra(s, d)).select("beam", "t", F.col("dm0").alias("v"))
_SERIES = "ser as (select beam, t, sum(v) as v from spectra group by all)"
_MV = f"mv as (select beam, chan, t // {BLOCK} as blk, count(*) as n, sum(v) / count(*) as mean, sum(v * v) / count(*) - (sum(v) / count(*)) * (sum(v) / count(*)) as var from spectra group by all)"
_mv = lambda s, d: S.mean_var(S.moments(spectra(s, d), BLOCK))

_add("cand_filter_basic", lambda s, d: C.basic_filter(candidates(s, d), 5, 10, 20.0), "select * from cand where boxcar < 5 and idt > 10 and sn > 20")
_timed = lambda s, d: candidates(s, d).withColumns({"secs": F.col("sampno") / 100.0, "mjd": 58000 + F.col("sampno") / 1000.0})
_TIMED = "tim as (select *, sampno / 100.0::double as secs, 58000 + sampno / 1000.0::double as mjd from cand)"
_add("cand_filter_rt", lambda s, d: C.real_time_filter(_timed(s, d), 30.0, 6, 3), f"with {_TIMED} select * from tim where sn > 30 and boxcar < 6 and dm > 3 and beam <> 35 and secs > 10")
_add("cand_topn_per_beam", lambda s, d: C.top_per_beam(candidates(s, d), 5), "select *, row_number() over (partition by beam order by sn desc, rid) as rank from cand qualify rank <= 5")
_add("cand_best_overall", lambda s, d: C.best(candidates(s, d)), "select * from cand order by sn desc, rid limit 1")
_add("cand_beam_offset", lambda s, d: C.with_beam_offset([(candidates(s, d), 36), (candidates(s, d), 0)]), "select * replace (beam + 36 as beam) from cand union all select * from cand")
_add("cand_counts_rollup", lambda s, d: C.count_passing(candidates(s, d), F.col("sn") > 50), "select beam, count(*) as total, count(*) filter (sn > 50) as passing from cand group by rollup (beam)")
_add(
    "nearest_join",
    lambda s, d: C.nearest(
        candidates(s, d).filter("boxcar = 1").select(F.col("rid").alias("lid"), F.col("sampno").alias("t"), "beam"),
        candidates(s, d).filter("boxcar = 2").select("rid", F.col("sampno").alias("t"), "beam"), 40, ["beam"],
    ),
    "select l.rid as lid, r.rid, abs(l.sampno - r.sampno) as gap from cand l join cand r on l.beam = r.beam and l.boxcar = 1 and r.boxcar = 2 and abs(l.sampno - r.sampno) < 40 qualify row_number() over (partition by l.rid order by gap, r.rid) = 1",
)
_add(
    "asof_backward",
    lambda s, d: C.as_of_backward(candidates(s, d).filter("boxcar = 1").select(F.col("rid").alias("lid"), F.col("sampno").alias("t"), "beam"), candidates(s, d).filter("boxcar = 3").select("rid", F.col("sampno").alias("t"), "beam"), ["beam"]),
    "select l.rid as lid, (select max(r.rid) from cand r where r.boxcar = 3 and r.beam = l.beam and r.sampno <= l.sampno) as rid from cand l where l.boxcar = 1",
)
_add("interval_overlap_pairs", lambda s, d: C.overlap_pairs(C.points(candidates(s, d)), 4, 2), "select a.rid as a, b.rid as b from cand a join cand b on a.beam = b.beam and a.rid < b.rid and abs(a.idt - b.idt) <= 2 and abs(a.sampno - b.sampno) <= 4")
_add(
    "band_join_catalog",
    lambda s, d: C.band_join(candidates(s, d), read(s, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("dm")), 2),
    "select rid, arg_min(n_name, (abs(dm - n_nationkey), n_name)) as main, string_agg(n_name, ',' order by abs(dm - n_nationkey), n_name) as names from cand join nation on abs(dm - n_nationkey) < 2 group by rid",
)
_add("unmatched_anti", lambda s, d: C.unmatched(candidates(s, d), read(s, d, "nation").filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("long").alias("dm")), "dm").select("rid"), "select rid from cand where dm not in (select n_nationkey from nation where n_nationkey % 2 = 0)")
_count = lambda s, d, t, c: read(s, d, t).groupBy(F.col(c).alias("k")).agg(F.count(F.lit(1)).alias("n"))
_add("full_outer_sum", lambda s, d: C.summed_outer(_count(s, d, "customer", "c_nationkey"), _count(s, d, "supplier", "s_nationkey"), "k", "n"), "select k, count(*) as total from (select c_nationkey as k from customer union all select s_nationkey from supplier) group by k")
_add("pairs_triangular", lambda s, d: C.baselines(read(s, d, "nation"), "n_nationkey"), "select a.n_nationkey + 1 as a, b.n_nationkey + 1 as b, 256 * (a.n_nationkey + 1) + b.n_nationkey + 1 as blid from nation a join nation b on a.n_nationkey < b.n_nationkey")
_add("multibeam_collapse", lambda s, d: C.collapse_beams(candidates(s, d)), "with w as (select *, dm - lag(dm) over (partition by sampno order by rid, sn, beam, dm) as _step from cand), v as (select * exclude (_step), max(_step) over (partition by sampno) as step, row_number() over (partition by sampno order by sn desc, rid, beam, dm) as k from w) select * exclude (k) from v where k = 1 and (step is null or step <= 5)")
_add("block_moments", lambda s, d: S.moments(spectra(s, d), BLOCK), f"select beam, chan, t // {BLOCK} as blk, count(*) as n, cast(sum(v) as bigint) as s1, cast(sum(v * v) as bigint) as s2, cast(sum(v * v * v) as bigint) as s3, cast(sum(v * v * v * v) as bigint) as s4 from spectra group by all")
_add("scale_offset", lambda s, d: S.scale_offset(_mv(s, d)).select("beam", "chan", "blk", _r("scale", "scale"), _r("offset", "offset")), f"with {_MV} select beam, chan, blk, round(case when var > 0 then 18 / sqrt(var) else 1 end, 6) as scale, round(128 / case when var > 0 then 18 / sqrt(var) else 1 end - mean, 6) as \"offset\" from mv")
_add("dm0_series", lambda s, d: S.dm0(spectra(s, d)), "select beam, t, cast(sum(v) as bigint) as dm0, count(*) as n from spectra group by all")
_add("dm0_subtract", lambda s, d: S.dm0_subtract(spectra(s, d)).select("beam", "t", "chan", _r("v", "v")), "select beam, t, chan, round(v - avg(v) over (partition by beam, t), 6) as v from spectra")
_add("block_delta", lambda s, d: S.block_change(_mv(s, d)).select("beam", "chan", "blk", _r("change", "change")), f"with {_MV}, w as (select *, lag(mean) over (partition by beam, chan order by blk) as b from mv) select beam, chan, blk, round(coalesce(case when b <> 0 then mean / b - 1 end, 0), 6) as change from w")
_add("flag_grow_time", lambda s, d: S.grow_time_flags(spectra(s, d), F.abs("v") < 20, BLOCK), f"with f as (select *, abs(v) < 20 as ok from spectra) select *, min(ok) over (partition by beam, chan, t // {BLOCK} order by t range between 1 preceding and current row) as good from f")
_add(
    "flag_grow_chan",
    lambda s, d: S.grow_channel_flags(spectra(s, d).groupBy("beam", "chan").agg(F.max((F.abs("v") > 55).cast("int")).alias("flag")), 3),
    "with f as (select beam, chan, max(case when abs(v) > 55 then 1 else 0 end) as flag from spectra group by all) select *, max(flag) over (partition by beam order by chan rows between 3 preceding and 2 following) as grown from f",
)
_add("tscrunch", lambda s, d: S.crunch_time(spectra(s, d).withColumn("beam", F.lit(0)), 4).select("beam", "chan", "t", _r("v", "v")), "select 0 as beam, chan, t // 4 as t, round(sum(v) / 2.0, 6) as v from spectra group by all having count(*) = 4")
_add("fscrunch", lambda s, d: S.crunch_channels(spectra(s, d), 8).select("beam", "t", "chan", _r("v", "v")), "select beam, t, chan // 8 as chan, round(sum(v) / sqrt(8.0), 6) as v from spectra group by all")
_add("fold", lambda s, d: S.fold(spectra(s, d), 16), "select beam, chan, t % 16 as bin, cast(sum(v) as bigint) as v from spectra group by all")
_add("dedisperse_roll", lambda s, d: S.roll_dedisperse(spectra(s, d), F.expr("chan * chan div 64"), 512), "select beam, (t + chan * chan // 64) % 512 as t, cast(sum(v) as bigint) as v from spectra group by all")
_add("fdmt_init", lambda s, d: S.spread_initial(spectra(s, d), 4, BLOCK), " union all ".join(f"select beam, chan, t, {k} as d, cast(sum(v) over (partition by beam, chan order by t range between {k} preceding and current row) as bigint) as v from spectra" for k in range(4)))
_add("boxcar_sums", lambda s, d: S.boxcars(_series(s, d), (1, 4, 8, 32), BLOCK), f"with {_SERIES} " + " union all ".join(f"select beam, t, {k} as width, cast(sum(v) over (partition by beam order by t range between {k - 1} preceding and current row) as bigint) as s from ser" for k in (1, 4, 8, 32)))
_BEST = f"{_SERIES}, wid as (" + " union all ".join(f"select beam, t, {k} as width, sum(v) over (partition by beam order by t range between {k - 1} preceding and current row)::double / sqrt({k}.0::double) as sn from ser" for k in (1, 2, 4, 8)) + "), best as (select * from wid qualify row_number() over (partition by beam, t order by sn desc, width) = 1)"
_add("boxcar_best_width", lambda s, d: S.best_width(_series(s, d), (1, 2, 4, 8), BLOCK).select("beam", "t", "width", _r("sn", "sn")), f"with {_BEST} select beam, t, width, round(sn, 6) as sn from best")
_add(
    "threshold_islands",
    lambda s, d: S.islands(S.best_width(_series(s, d), (1, 2, 4, 8), BLOCK), 100.0, BLOCK).withColumn("sn", F.round("sn", 6)),
    f"with {_BEST}, h as (select *, t // {BLOCK} as blk, t - row_number() over (partition by beam, t // {BLOCK} order by t) as run from best where sn >= 100)"
    " select beam, min(t) over w as start, max(t) over w as \"end\", round(sn, 6) as sn, width, t from h window w as (partition by beam, blk, run) qualify row_number() over (partition by beam, blk, run order by sn desc, width, t) = 1",
)
_add("bit_unpack_4b", lambda s, d: candidates(s, d).select("rid", *[scalars.signed_nibble(F.col("rid"), k).alias(f"n{k}") for k in range(2)]), "select rid, (rid & 15) - (rid & 8) * 2 as n0, ((rid >> 4) & 15) - ((rid >> 4) & 8) * 2 as n1 from cand")
_add("bit_unpack_1b", lambda s, d: candidates(s, d).select("rid", scalars.sign_bit(F.col("rid"), 3).alias("b3")), "select rid, 1 - 2 * ((rid >> 3) & 1) as b3 from cand")
_add("hist_codes", lambda s, d: scalars.histogram(candidates(s, d).select("beam", *[scalars.unpack_word(F.col("rid"), 4, k).alias(f"n{k}") for k in range(2)]), "beam", ["n0", "n1"]), "select beam, (x & 15) - (x & 8) * 2 as code, count(*) as n from (select beam, rid as x from cand union all select beam, rid >> 4 from cand) group by all")
_add("polyval_delay", lambda s, d: candidates(s, d).select("rid", _r(scalars.polyval([1.0, 0.5, 0.25], F.col("dm").cast("double")), "delay")), "select rid, round(1.0 + cast(dm as double) * (0.5 + dm * 0.25), 6) as delay from cand")
_add("sex2deg", lambda s, d: candidates(s, d).select("rid", _r(scalars.sexagesimal_to_degrees(F.col("rid").cast("double")), "deg")), "with p as (select rid, rid // 10000 as d, rid // 100 % 100 as m, rid % 100 as s from cand) select rid, case when m < 60 and s < 60 then round(d + m / 60 + s / 3600, 6) end as deg from p")
_add("range_expand", lambda s, d: read(s, d, "region").select("r_regionkey", F.explode(scalars.expand_ranges(F.concat(F.lit("1-3,7,9-"), (F.col("r_regionkey") + 10).cast("string")))).alias("n")), "select r_regionkey, unnest([1, 2, 3, 7] || generate_series(9, r_regionkey + 10)) as n from region")
_add("tumbling_blocks", lambda s, d: blocks.tumbling_hours(read(s, d, "events")), "select event_type, date_trunc('hour', ts) as hour, count(*) as n, max(value) as top from events group by all")
_add(
    "density_clusters",
    lambda s, d: clusters.density_clusters(candidates(s, d), 6, 3),
    "with recursive " + CAND_SQL + ", near as (select a.rid as a, b.rid as b from cand a join cand b on a.beam = b.beam and a.rid <> b.rid and abs(a.sampno - b.sampno) <= 6 and (a.sampno - b.sampno) ** 2 + (a.boxcar - b.boxcar) ** 2 + (a.dm - b.dm) ** 2 <= 36),"
    " core as (select a from near group by a having count(*) >= 2), edge as (select near.a, near.b from near join core x on near.a = x.a join core y on near.b = y.a),"
    " reach(n, l) as (select a, a from core union select e.b, r.l from reach r join edge e on r.n = e.a where r.l < e.b), label as (select n, min(l) as cluster from reach group by n)"
    " select n as rid, cluster, true as core from label union all select near.a, min(label.cluster), false from near join label on near.b = label.n where near.a not in (select a from core) group by near.a",
)
#: lineitem repeats some (order, line), and so rid; the strongest of them stands for it.
_ONCE = "once as materialized (select * from cand qualify row_number() over (partition by rid order by sn desc, sampno desc, boxcar desc, idt desc, dm desc, beam desc) = 1)"
_once = lambda s, d: candidates(s, d).groupBy("rid").agg(F.max(F.struct("sn", "sampno", "boxcar", "idt", "dm", "beam")).alias("m")).select("rid", "m.*")


def _fof_sql(reach: int, idt_reach: int, rounds: int = 16) -> str:
    """Rounds of: pairs of boxes in reach, their components, bounding boxes. Rounds after the last change change nothing."""
    parts = [CAND_SQL, _ONCE, "b0 as materialized (select rid, beam, sn, sampno as t0, sampno as t1, idt as i0, idt as i1, 1::bigint as ncands from once)"]
    for k in range(1, rounds + 1):
        b = f"b{k - 1}"
        parts += [
            f"p{k} as materialized (select x.rid as a, y.rid as b from {b} x join {b} y on x.beam = y.beam and x.rid <> y.rid and x.t0 - {reach} <= y.t1 and y.t0 <= x.t1 + {reach} and x.i0 - {idt_reach} <= y.i1 and y.i0 <= x.i1 + {idt_reach})",
            f"r{k}(n, l) as (select rid, rid from {b} union select p.b, r.l from r{k} r join p{k} p on r.n = p.a where r.l < p.b)",
            f"l{k} as materialized (select n, min(l) as l from r{k} group by n)",
            f"b{k} as materialized (select arg_max(rid, (sn, -rid)) as rid, beam, max(sn) as sn, min(t0) as t0, max(t1) as t1, min(i0) as i0, max(i1) as i1, cast(sum(ncands) as bigint) as ncands from {b} join l{k} on rid = n group by beam, l)",
        ]
    return f"with recursive {', '.join(parts)} select * from b{rounds}"


_add("friends_of_friends", lambda s, d: clusters.friends_of_friends(_once(s, d), 4, 2), _fof_sql(4, 2))
_add(
    "cluster_strongest",
    lambda s, d: clusters.strongest_of_clusters(candidates(s, d), clusters.density_clusters(candidates(s, d), 6, 3)),
    _SQL["density_clusters"].replace(" select n as rid, cluster, true as core", ", dens as (select n as rid, cluster, true as core") + ") select cluster, arg_max(rid, (sn, -rid)) as rid, max(sn) as sn, count(*) as n from dens join cand using (rid) group by cluster",
)

_NF, _F0, _DF, _ND = 64, 1.0, 0.005, 16
_TRACE = ", ".join(str((d, *x)) for d in range(_ND) for x in dedisperse.trace(dedisperse.tree(_NF, _F0, _DF, _ND), d))
_add(
    "fdmt_tree",
    lambda s, d: dedisperse.dedisperse_tree(spectra(s, d), _NF, _F0, _DF, _ND, BLOCK),
    f"with tr(idt, chan, depth, shift) as (values {_TRACE}) select beam, idt, t + shift + k as t, cast(sum(v) as bigint) as v from (select spectra.beam, spectra.t, spectra.v, cast(tr.idt as bigint) as idt, tr.shift, unnest(generate_series(0, tr.depth)) as k from spectra join tr using (chan)) z group by all having sum(v) <> 0",
)
_WIDTHS = (1, 4, 8, 32)


def _searched(s, d):
    """The samples as a stream of micro-batches, searched with state by beam."""
    x = spectra(s, d)
    stream, folder = stateful.replayed(x.select("beam", "t", F.col("chan").cast("int").alias("chan"), "v"), "t", 4 * BLOCK)
    return stateful.run_with_state(stateful.search(stream, _NF, _F0, _DF, _ND, _WIDTHS, block=BLOCK), folder)


_LAST = "(select beam, max(t) as last from spectra group by beam)"  # a stream's tails come with later samples
_TREE_SQL = f"tr(idt, chan, depth, shift) as (values {_TRACE}), tree as (select beam, idt, t + shift + k as t, cast(sum(v) as bigint) as v from (select spectra.beam, spectra.t, spectra.v, cast(tr.idt as bigint) as idt, tr.shift, unnest(generate_series(0, tr.depth)) as k from spectra join tr using (chan)) z group by all having sum(v) <> 0)"
_add("stream_fdmt_tree", lambda s, d: _searched(s, d).filter("v <> 0").select("beam", "idt", "t", "v"), f"with {_TREE_SQL} select beam, idt, t, v from tree join {_LAST} using (beam) where t <= last")
_add(
    "stream_boxcar_sums",
    lambda s, d: _searched(s, d).filter("idt = 0 and seen").select("beam", "t", F.posexplode("s").alias("k", "s")).select("beam", "t", F.element_at(F.array(*map(F.lit, _WIDTHS)), F.col("k") + 1).alias("width"), "s"),
)
_SQL["stream_boxcar_sums"] = _SQL["boxcar_sums"]
_BOXED = " union all ".join(f"select beam, idt, t, v, {w} as width, (sum(v) over (partition by beam, idt order by t range between {w - 1} preceding and current row))::double / sqrt({w}.0::double) as sn from tree" for w in _WIDTHS)
_add(
    "stream_candidates",
    lambda s, d: stateful.candidates(_searched(s, d).filter("v <> 0"), _WIDTHS, 220.0).select("beam", "idt", "t", "width", _r("sn", "sn")),
    f"with {_TREE_SQL}, bx as ({_BOXED}) select beam, idt, t, width, round(sn, 6) as sn from bx join {_LAST} using (beam) where t <= last and sn >= 220 qualify row_number() over (partition by beam, idt, t order by sn desc, width) = 1",
)
_add(
    "power_spectrum",
    lambda s, d: transforms.power_spectrum(_series(s, d), BLOCK).select("beam", "blk", "k", _r("power", "power", 2)),
    f"with {_SERIES} select beam, t // {BLOCK} as blk, k, round(sum(v * cos(2 * pi() * k * (t % {BLOCK}) / {BLOCK})) ** 2 + sum(v * sin(2 * pi() * k * (t % {BLOCK}) / {BLOCK})) ** 2, 2) as power from ser, generate_series(0, {BLOCK // 2}) _(k) group by all",
)
_vis = lambda s, d: candidates(s, d).select((F.col("sampno") % 16).alias("t"), ((F.col("beam") - 18) * 0.5).cast("double").alias("u"), ((F.col("idt") - 25) * 0.5).cast("double").alias("v"), F.col("dm").alias("re"), F.col("boxcar").cast("long").alias("im"))
_add(
    "uv_grid",
    lambda s, d: transforms.uv_grid(_vis(s, d), 32, 1.0),
    "with vis as (select sampno % 16 as t, (beam - 18) * 0.5::double as u, (idt - 25) * 0.5::double as v, dm as re, boxcar::bigint as im from cand), both_ as (select * from vis union all select t, -u, -v, re, -im from vis)"
    " select t, cast(round_even(u + 16, 0) as int) as upix, cast(round_even(v + 16, 0) as int) as vpix, cast(sum(re) as bigint) as re, cast(sum(im) as bigint) as im from both_ where (u <> 0 or v <> 0) and round_even(u + 16, 0) between 0 and 31 and round_even(v + 16, 0) between 0 and 31 group by all",
)
_add("uv_image", lambda s, d: transforms.image(transforms.uv_grid(_vis(s, d), 32, 1.0), 32).select("t", "x", "y", _r("v", "v")))
_add("strongest_removed", lambda s, d: transforms.remove_strongest(spectra(s, d), BLOCK).select("beam", "t", "chan", _r("v", "v")))
_add(
    "stream_tumbling",
    lambda s, d: blocks.run_available(blocks.tumbling(blocks.stream_table(s, d, "events"), "1 hour", "2 hours")),
    "select * from (select event_type, date_trunc('hour', ts) as start, count(*) as n, max(value) as top from events group by all) z where start + interval 1 hour <= (select date_trunc('milliseconds', max(ts)) from events) - interval 2 hours",
)


# Filters, sorts and matches over candidates
_add("cand_filter_beam", lambda s, d: C.beam_filter(candidates(s, d), 5, 10, 20.0), "select * from cand where boxcar < 5 and idt > 10 and sn > 20 and beam <> 35")
_add("cand_filter_summary", lambda s, d: C.summary_filter(candidates(s, d), 5, 4, 20.0), "select * from cand where boxcar < 5 and dm >= 4 and sn >= 20")
_add("cand_representatives", lambda s, d: C.representatives(candidates(s, d), 8, 3), "select * from cand where dm >= 8 and boxcar <= 3")
_add("cand_strong_and_late", lambda s, d: C.strong_and_late(_timed(s, d), 9.5, 10, 4, 7), f"with {_TIMED} select * from tim where sn > 9.5 and secs > 10 and boxcar < 4 and dm > 7")
_add("cand_near_pulsar", lambda s, d: C.near_pulsar(candidates(s, d), 5.0, 2.0, 4, 7), "select * from cand where abs(dm - 5.0) < 2 and boxcar < 4 and beam = 7")
_add("baselines_unflagged", lambda s, d: C.drop_flagged_baselines(read(s, d, "lineitem").select((F.col("l_suppkey") % 30).alias("a1"), (F.col("l_partkey") % 30).alias("a2"), "l_orderkey"), [3, 7], True), "select l_suppkey % 30 as a1, l_partkey % 30 as a2, l_orderkey from lineitem where l_suppkey % 30 not in (3, 7) and l_partkey % 30 not in (3, 7) and l_suppkey % 30 <> l_partkey % 30")
_add("samples_around_date", lambda s, d: C.time_window(spectra(s, d), 58000.0, 0.5, 58000.001, 20.0), "select * from spectra where t between 132 and 212")
_add("blocks_from", lambda s, d: C.from_block(spectra(s, d), 50.0, 0.5, BLOCK, 3), f"select * from spectra where t >= {BLOCK} and t // {BLOCK} < 4")
_add("cand_rereferenced", lambda s, d: C.rereference(_timed(s, d), 1.1, 0.336, -0.001, -5.0).select("rid", _r("mjd", "mjd", 7), _r("dm", "dm", 5)), f"with {_TIMED} select rid, round(mjd + (4.15 * dm * (0 - 1.1 ** -2) - 5.0) / 86400.0 / 1e3, 7) as mjd, round(4.15 * dm * (1.436 ** -2 - 1.1 ** -2) / 4.15 / (1.435 ** -2 - 1.099 ** -2), 5) as dm from tim")
_add("cand_seconds_off", lambda s, d: C.seconds_since_first(_timed(s, d), ["beam"]).select("rid", _r("secoff", "secoff", 3)), f"with {_TIMED} select rid, round((mjd - min(mjd) over (partition by beam)) * 86400.0, 3) as secoff from tim")
_add(
    "nearest_then_dm",
    lambda s, d: C.nearest_then_dm(_once(s, d).filter("boxcar = 1").select(F.col("rid").alias("lid"), F.col("sampno").alias("t"), "dm", "beam"), _once(s, d).filter("boxcar > 1").select("rid", F.col("sampno").alias("t"), "dm", "beam"), 60, 3, ["beam"]),
    f"with {_ONCE}, m as (select l.rid as lid, r.rid, abs(l.sampno - r.sampno) as gap, abs(l.dm - r.dm) as dm_gap from once l join once r on l.beam = r.beam and l.boxcar = 1 and r.boxcar > 1 and abs(l.sampno - r.sampno) < 60 qualify row_number() over (partition by l.rid order by gap, r.rid) = 1) select * from m where dm_gap < 3",
)
_add(
    "nearest_time_and_dm",
    lambda s, d: C.nearest_in_time_and_dm(candidates(s, d).filter("boxcar = 1").select(F.col("rid").alias("lid"), F.col("sampno").alias("t"), "dm", "beam"), candidates(s, d).filter("boxcar = 2").select("rid", F.col("sampno").alias("t"), "dm", "beam", "sn"), 60, 3, ["beam"], 50.0),
    "select l.rid as lid, r.rid, abs(l.sampno - r.sampno) as gap, abs(l.dm - r.dm) as dm_gap from cand l join cand r on l.beam = r.beam and l.boxcar = 1 and r.boxcar = 2 and r.sn <= 50 and abs(l.sampno - r.sampno) < 60 and abs(l.dm - r.dm) < 3 qualify row_number() over (partition by l.rid order by gap, dm_gap, r.rid) = 1",
)
_SEP = "degrees(2 * asin(sqrt(least(1.0, pow(sin(radians(k.dec - c.dec) / 2), 2) + cos(radians(c.dec)) * cos(radians(k.dec)) * pow(sin(radians(k.ra - c.ra) / 2), 2)))))"
_add(
    "sky_crossmatch",
    lambda s, d: C.sky_match(
        candidates(s, d).select("rid", (F.col("beam") * 2.0).alias("ra"), (F.col("idt") - 25.0).alias("dec"), "dm"),
        read(s, d, "supplier").select(F.col("s_name").alias("name"), (F.col("s_suppkey") % 72).cast("double").alias("ra"), (F.col("s_nationkey") * 2.0 - 25.0).alias("dec"), (F.col("s_suppkey") % 11).alias("dm")), 1.5, 3.0,
    ).select("rid", "name", _r("sep", "sep")),
    "with c as (select rid, beam * 2.0::double as ra, idt - 25.0::double as dec, dm from cand), k as (select s_name as name, (s_suppkey % 72)::double as ra, s_nationkey * 2.0::double - 25 as dec, s_suppkey % 11 as dm from supplier),"
    f" m as (select c.rid, k.name, {_SEP} as sep from c join k on abs(c.dm - k.dm) < 3), b as (select rid, min((round(sep, 9), name)) as x from m where sep < 1.5 group by rid) select c.rid, coalesce(x[2], 'None') as name, round(x[1], 6) as sep from c left join b using (rid)",
)
_add(
    "interval_best_match",
    lambda s, d: C.most_overlapping(
        read(s, d, "orders").select(F.col("o_orderkey").alias("lid"), F.col("o_custkey").alias("a"), (F.col("o_custkey") + 9).alias("b")),
        read(s, d, "supplier").select(F.col("s_suppkey").alias("rid"), (F.col("s_suppkey") * 13).alias("a"), (F.col("s_suppkey") * 13 + F.col("s_nationkey")).alias("b")), 16,
    ),
    "select lid, rid, shared from (select o_orderkey as lid, s_suppkey as rid, least(o_custkey + 9, s_suppkey * 13 + s_nationkey) - greatest(o_custkey, s_suppkey * 13) as shared from orders join supplier on o_custkey < s_suppkey * 13 + s_nationkey and s_suppkey * 13 < o_custkey + 9) where shared > 0 qualify row_number() over (partition by lid order by shared desc, rid) = 1",
)

# The rescale chain
_MOM = f"mo as (select beam, chan, t // {BLOCK} as blk, count(*) as n, avg(v) as m1, avg(v * v) as m2, avg(v * v * v) as m3, avg(v * v * v * v) as m4 from spectra group by all), ku as (select beam, chan, blk, n, m1 as mean, sqrt(greatest(m2 - m1 * m1, 0)) as std, case when m2 - m1 * m1 > 0 then (m4 - 4 * m1 * m3 + 6 * m2 * m1 * m1 - 3 * m1 * m1 * m1 * m1) / ((m2 - m1 * m1) * (m2 - m1 * m1)) - 3 end as kurt from mo)"
_FLAG = f"{_MOM}, ba as (select *, case when n > 0 and (abs(mean) > 6 or abs(std - 16) > 4 or abs(kurt) > 1.5) then 1 else 0 end as bad from ku), fl as (select * exclude (bad), max(bad) over (partition by beam, blk order by chan range between 1 preceding and 0 following) as flag from ba), sc as (select beam, chan, blk, case when flag = 1 then 0 when std > 0 then 18 / std else 1.0 end as scale, case when flag = 1 then 0 when std > 0 then 128 / (18 / std) - mean else 128 - mean end as \"offset\" from fl)"
_stats = lambda s, d: S.kurtosis(S.moments(spectra(s, d), BLOCK))
_flags = lambda s, d: S.flag_channels(_stats(s, d), 6.0, 4.0, 1.5, 1, 0.0, 16.0)
_DM0 = f"{_FLAG}, rs as (select s.beam, s.t, (s.v + sc.\"offset\") * sc.scale as v, sc.scale from spectra s join sc on s.beam = sc.beam and s.chan = sc.chan and s.t // {BLOCK} = sc.blk), d0 as (select beam, t, coalesce(sum(v) filter (abs(v) < 160 and scale <> 0), 0) as dm0, count(*) filter (abs(v) < 160 and scale <> 0) as n from rs group by all)"
_dm0 = lambda s, d: S.dm0_where(S.rescale(spectra(s, d), S.rescale_table(_flags(s, d)), BLOCK), 160.0)
_add("kurtosis_by_channel", lambda s, d: _stats(s, d).select("beam", "chan", "blk", "n", _r("mean", "mean"), _r("std", "std"), _r("kurt", "kurt", 5)), f"with {_MOM} select beam, chan, blk, n, round(mean, 6) as mean, round(std, 6) as std, round(kurt, 5) as kurt from ku")
_add("rescale_flags", lambda s, d: _flags(s, d).select("beam", "chan", "blk", "flag"), f"with {_FLAG} select beam, chan, blk, flag from fl")
_add("rescale_table", lambda s, d: S.rescale_table(_flags(s, d)).select("beam", "chan", "blk", _r("scale", "scale"), _r("offset", "offset")), f"with {_FLAG} select beam, chan, blk, round(scale, 6) as scale, round(\"offset\", 6) as \"offset\" from sc")
_add("dm0_of_rescaled", lambda s, d: _dm0(s, d).select("beam", "t", _r("dm0", "dm0", 4), "n"), f"with {_DM0} select beam, t, round(dm0, 4) as dm0, n from d0")
_add("dm0_stats", lambda s, d: S.dm0_stats(_dm0(s, d), BLOCK).select("beam", "blk", *[_r(c, c, 3) for c in ("top", "low", "mean", "var")]), f"with {_DM0} select beam, t // {BLOCK} as blk, round(max(z), 3) as top, round(min(z), 3) as low, round(avg(z), 3) as mean, round(var_pop(z), 3) as var from (select *, dm0 / sqrt(n) as z from d0 where n > 0) group by all")
_add("highpass_decay", lambda s, d: S.high_pass(spectra(s, d), 7.0, BLOCK).select("beam", "t", "chan", _r("v", "v", 5)), "with recursive " + SPECTRA_SQL + ", o as (select *, row_number() over (partition by beam, chan order by t) as i from spectra), r(beam, chan, t, i, v, d) as (select beam, chan, t, i, v, v / 8.0::double from o where i = 1 union all select o.beam, o.chan, o.t, o.i, o.v, (o.v + r.d * 7.0::double) / 8.0::double from r join o on o.beam = r.beam and o.chan = r.chan and o.i = r.i + 1) select beam, t, chan, round(v - d, 5) as v from r")
_add("z_scores", lambda s, d: S.z_scores(spectra(s, d), BLOCK).select("beam", "t", "chan", _r("v", "v")), f"select beam, t, chan, round(case when stddev_pop(v) over w > 0 then (v - avg(v) over w) / stddev_pop(v) over w else 0 end, 6) as v from spectra window w as (partition by beam, chan, t // {BLOCK})")
_add("channel_covariance", lambda s, d: S.covariance(spectra(s, d), BLOCK, 2).select("beam", "blk", "a", "b", _r(F.col("cov") + 1e-7, "cov", 4)), f"select x.beam, x.t // {BLOCK} as blk, x.chan as a, y.chan as b, round(covar_samp(x.v, y.v) + 1e-7, 4) as cov from spectra x join spectra y on x.beam = y.beam and x.t = y.t and y.chan between x.chan and x.chan + 2 group by all")
_add("beam_covariance", lambda s, d: S.beam_covariance(candidates(s, d).groupBy((F.col("beam") % 6).alias("beam"), (F.col("boxcar") % 4).alias("chan"), (F.col("sampno") % 512).alias("t")).agg(F.max("dm").alias("v")), BLOCK).select("chan", "blk", "a", "b", _r(F.col("cov") + 1e-7, "cov", 4)), f"with x as (select beam % 6 as beam, boxcar % 4 as chan, sampno % 512 as t, max(dm) as v from cand group by all) select x.chan, x.t // {BLOCK} as blk, x.beam as a, y.beam as b, round(covar_samp(x.v, y.v) + 1e-7, 4) as cov from x join x y on x.chan = y.chan and x.t = y.t and x.beam <= y.beam group by all")
_add("runs_of_equal", lambda s, d: S.runs_of_equal(candidates(s, d), ["beam"], "rid", "boxcar"), "with w as (select *, case when boxcar is distinct from lag(boxcar) over (partition by beam order by rid) or row_number() over (partition by beam order by rid) = 1 then 1 else 0 end as new from cand), u as (select *, sum(new) over (partition by beam order by rid) as run from w) select beam, min(rid) as first, max(rid) as last, any_value(boxcar) as value, count(*) as n from u group by beam, run")
_add("dedisperse_dm", lambda s, d: S.roll_dedisperse(spectra(s, d), scalars.roll_shift(40.0, 1.1 + F.col("chan") / 1000.0, 1.164, 0.001), 512), "select beam, (((t + cast(round_even(4.15::double * 40 * (pow(1.164::double, -2) - pow(1.1::double + chan / 1000.0::double, -2)) / 1e3 / 0.001, 0) as bigint)) % 512) + 512) % 512 as t, cast(sum(v) as bigint) as v from spectra group by all")

# Scalar functions
_BAND = (0.736, 0.001, 256, 1.7)
_add("dm_idt", lambda s, d: candidates(s, d).select("rid", _r(scalars.idt_to_dm(F.col("idt"), *_BAND), "dm"), _r(scalars.dm_to_idt(F.col("dm"), *_BAND), "back"), _r(scalars.dm_delay_ms(F.col("dm"), 0.736, 0.991), "ms")), "select rid, round(idt * (1.7 / 4.15 / (pow(0.736::double, -2) - pow(0.991::double, -2))), 6) as dm, round(dm / (1.7 / 4.15 / (pow(0.736::double, -2) - pow(0.991::double, -2))), 6) as back, round(4.15 * dm * (pow(0.736::double, -2) - pow(0.991::double, -2)), 6) as ms from cand")
_add(
    "sky_geometry",
    lambda s, d: candidates(s, d).select(
        "rid", _r(scalars.separation(F.lit(10.0), F.lit(-30.0), F.col("beam") * 5.0, F.col("idt") - 25.0), "sep"), _r(scalars.position_angle(F.lit(10.0), F.lit(-30.0), F.col("beam") * 5.0, F.col("idt") - 25.0), "pa", 5),
        *[_r(c, n) for c, n in zip(scalars.direction_cosines(F.col("beam") * 5.0, F.col("idt") - 25.0, 10.0, -30.0), ("l", "m"), strict=True)],
    ),
    "with q as (select rid, radians(beam * 5.0::double) as ra, radians(idt - 25.0::double) as de, radians(10.0::double) as r0, radians(-30.0::double) as d0 from cand) select rid, round(degrees(2 * asin(sqrt(least(1.0, pow(sin((de - d0) / 2), 2) + cos(d0) * cos(de) * pow(sin((ra - r0) / 2), 2))))), 6) as sep,"
    " round(fmod(degrees(atan2(sin(ra - r0), cos(d0) * tan(de) - sin(d0) * cos(ra - r0))) + 360, 360), 5) as pa, round(cos(de) * sin(ra - r0), 6) as l, round(sin(de) * cos(d0) - cos(de) * sin(d0) * cos(ra - r0), 6) as m from q",
)
_add("times", lambda s, d: read(s, d, "events").select("event_id", _r(scalars.mjd(F.col("ts")), "mjd", 8), _r(scalars.bat_to_mjd(F.col("event_id") * 1e9, 37.0), "utc", 8), scalars.parse_time(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).cast("timestamp_ntz").alias("back")), "select event_id, round(epoch_us(ts) / 86400000000.0::double + 40587, 8) as mjd, round((event_id * 1e9 / 1e6 - 37) / 86400.0, 8) as utc, date_trunc('second', ts) as back from events")
_add("hms", lambda s, d: candidates(s, d).select("rid", scalars.format_hms(F.col("rid") / 10000.0).alias("text"), _r(scalars.parse_hms(scalars.format_hms(F.col("rid") / 10000.0)), "hours", 5)), "with q as (select rid, cast(round_even(rid / 10000.0::double * 360000, 0) as bigint) as c from cand) select rid, concat(lpad(cast(c // 360000 as varchar), 2, '0'), ':', lpad(cast(c // 6000 % 60 as varchar), 2, '0'), ':', lpad(cast(c // 100 % 60 as varchar), 2, '0'), '.', lpad(cast(c % 100 as varchar), 2, '0')) as text, round((lpad(cast(c // 360000 as varchar), 2, '0'))::int + c // 6000 % 60 / 60.0 + (c % 6000 / 100.0) / 3600.0, 5) as hours from q")
_add("cleaning", lambda s, d: read(s, d, "documents").select("doc_id", scalars.coerced(F.substring("source", 4, 9)).alias("num"), scalars.fixed_longitude(F.col("doc_id") % 360).alias("lon"), scalars.saturated(F.col("n_chars") / 8.0, 0, 255).alias("byte"), scalars.padded(F.col("doc_id"), "SB", 8).alias("sb"), scalars.next_divisor(F.col("doc_id") % 50 + 8, F.lit(4)).alias("div"), scalars.finite(F.col("n_chars") / F.when(F.col("doc_id") % 3 > 0, 1.0).otherwise(float("inf"))).alias("fin")), "select doc_id, try_cast(source[4:12] as double) as num, case when doc_id % 360 > 180 then 180 - doc_id % 360 else doc_id % 360 end as lon, cast(least(255, round_even(n_chars / 8.0, 0)) as int) as byte, 'SB' || lpad(cast(doc_id as varchar), 8, '0') as sb, list_min([x for x in range(4, doc_id % 50 + 9) if (doc_id % 50 + 8) % x = 0]) as div, case when doc_id % 3 > 0 then n_chars::double else 0.0 end as fin from documents")
_add("uv_indices", lambda s, d: candidates(s, d).select("rid", scalars.shifted(F.col("beam"), 36).alias("shifted"), scalars.triangular_index(F.greatest("beam", "dm"), F.least("beam", "dm"), 36).cast("long").alias("tri"), *[c.alias(n) for c, n in zip(scalars.complex_product(F.col("beam"), F.col("idt"), F.col("dm"), F.col("boxcar")), ("re", "im"), strict=True)]), "select rid, (beam + 18) % 36 as shifted, cast(666 - (36 - least(beam, dm)) * (37 - least(beam, dm)) // 2 + greatest(beam, dm) - least(beam, dm) as bigint) as tri, beam * dm + idt * boxcar as re, idt * dm - beam * boxcar as im from cand")
_add("words_unpacked", lambda s, d: candidates(s, d).select("rid", *[scalars.unpack_word(F.col("rid"), b, k).cast("long").alias(f"b{b}_{k}") for b, k in ((1, 5), (2, 3), (4, 2), (8, 1))]), "select rid, 1 - 2 * ((rid >> 5) & 1) as b1_5, ((rid >> 6) & 3) - ((rid >> 6) & 2) * 2 as b2_3, ((rid >> 8) & 15) - ((rid >> 8) & 8) * 2 as b4_2, ((rid >> 8) & 255) - ((rid >> 8) & 128) * 2 as b8_1 from cand")

# Streams and packets
_add("gaps_filled", lambda s, d: blocks.fill_gaps(_series(s, d), "beam", "t", "v", BLOCK), f"with {_SERIES}, e as (select beam, unnest(generate_series(min(t), max(t))) as t from ser group by beam) select beam, t, cast(v as bigint) as v from e left join ser using (beam, t)")
_add("fragments_reassembled", lambda s, d: blocks.reassemble(read(s, d, "lineitem").select((F.col("l_suppkey") % 5).alias("src"), F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("fragment"), F.lit(2).alias("n_fragments"), F.col("l_returnflag").alias("payload"))), "with o as (select l_suppkey % 5 as src, l_orderkey as frame, l_linenumber as fragment, min(l_returnflag) as payload from lineitem group by all) select src, frame, string_agg(payload, '' order by fragment) as payload from o group by src, frame having count(*) = 2")
_add("stream_in_time", lambda s, d: blocks.run_available(blocks.in_time(blocks.stream_table(s, d, "events"), "ts", ["event_id"], "30 days").select("event_id", "event_type")), "select event_id, event_type from events")
_add("flag_counts", lambda s, d: S.flag_counts(S.rescale_table(_flags(s, d)), spectra(s, d), BLOCK), f"with {_FLAG}, ce as (select beam, chan, t // {BLOCK} as blk, count(*) as n from spectra group by all) select beam, blk, count(*) as channels, cast(sum(n) as bigint) as samples from ce join sc using (beam, chan, blk) where scale = 0 group by beam, blk")
_add("gain_test", lambda s, d: S.gain_test(_stats(s, d), 2.0).select("beam", "chan", "blk", _r("g", "g")), f"with {_MOM} select beam, chan, blk, round(case when std > 0 then abs(mean ** 2 / std ** 2 / 2.0 - 1) end, 6) as g from ku")
_add("local_maxima", lambda s, d: S.local_maxima(_series(s, d)), f"with {_SERIES} select x.beam, x.t, cast(x.v as bigint) as v from ser x where not exists (select 1 from ser y where y.beam = x.beam and abs(y.t - x.t) = 1 and y.v >= x.v)")
_add("cand_discarded", lambda s, d: C.discarded(candidates(s, d), 5), "select beam, idt, count(*) as n, count(*) filter (boxcar > 5) as discarded from cand group by beam, idt")
_add(
    "nearest_source",
    lambda s, d: C.nearest_source(
        read(s, d, "customer").select(F.col("c_custkey").alias("rid"), (F.col("c_custkey") % 72).cast("double").alias("ra"), (F.col("c_custkey") % 50 - 25.0).alias("dec")),
        read(s, d, "nation").select(F.col("n_name").alias("name"), (F.col("n_nationkey") * 3.0).alias("ra"), (F.col("n_nationkey") * 2.0 - 25.0).alias("dec")), 120.0,
    ).select("rid", "name", _r("sep", "sep")),
    "with c as (select c_custkey as rid, (c_custkey % 72)::double as ra, c_custkey % 50 - 25.0::double as dec from customer), k as (select n_name as name, n_nationkey * 3.0::double as ra, n_nationkey * 2.0::double - 25 as dec from nation),"
    f" m as (select c.rid, min((round({_SEP}, 9), k.name)) as x from c, k group by c.rid) select rid, x[2] as name, round(x[1], 6) as sep from m",
)

# Voltages: antenna, channel, sample
_volts = lambda s, d: spectra(s, d).select((F.col("chan") % 4).alias("ant"), F.col("beam").alias("chan"), (F.col("t") * 16 + F.expr("chan div 4")).alias("t"), F.col("v").alias("re"), (F.col("v") % 7).alias("im"))
_VOLTS = "volt as (select chan % 4 as ant, beam as chan, t * 16 + chan // 4 as t, v as re, v % 7 as im from spectra)"
_add("detected_power", lambda s, d: voltages.detected_power(_volts(s, d), 32), f"with {_VOLTS} select ant, chan, t // 32 as integ, cast(sum(re * re + im * im) as bigint) as power, count(*) as n from volt group by all")
_add("tied_sum", lambda s, d: voltages.tied_sum(_volts(s, d)), f"with {_VOLTS} select chan, t, cast(sum(re) as bigint) as re, cast(sum(im) as bigint) as im from volt group by all")
_add("voltage_levels", lambda s, d: voltages.voltage_levels(_volts(s, d)).select("ant", "chan", *[_r(c, c) for c in ("mean_re", "std_re", "mean_im", "std_im")]), f"with {_VOLTS} select ant, chan, round(avg(re), 6) as mean_re, round(stddev_pop(re), 6) as std_re, round(avg(im), 6) as mean_im, round(stddev_pop(im), 6) as std_im from volt group by all")
_XMAC = "xm as (select a.ant as a, b.ant as b, chan, t // 32 as integ, avg(a.re * b.re + a.im * b.im) as re, avg(a.im * b.re - a.re * b.im) as im, count(*) as n from volt a join volt b using (chan, t) where a.ant < b.ant group by all)"
_add("cross_products", lambda s, d: voltages.cross_products(_volts(s, d), 32).withColumns({"re": F.round("re", 6), "im": F.round("im", 6)}), f"with {_VOLTS}, {_XMAC} select a, b, chan, integ, round(re, 6) as re, round(im, 6) as im, n from xm")
_add(
    "phase_slope",
    lambda s, d: voltages.phase_slope(voltages.cross_products(_volts(s, d), 1 << 30), ["a", "b"]).select("a", "b", _r("slope", "slope", 5), _r("intercept", "intercept", 5)),
    f"with {_VOLTS}, {_XMAC.replace('t // 32', '0')}, p as (select a, b, chan, atan2(im, re) as p from xm), q as (select *, coalesce(round_even((p - lag(p) over (partition by a, b order by chan)) / (2 * pi()), 0), 0) as turn from p), r as (select a, b, chan, p - 2 * pi() * sum(turn) over (partition by a, b order by chan) as p from q) select a, b, round(regr_slope(p, chan), 5) as slope, round(regr_intercept(p, chan), 5) as intercept from r group by a, b",
)
_add(
    "fine_channels",
    lambda s, d: voltages.fine_channels(_volts(s, d), 16, 2).select("ant", "chan", "blk", "fine", _r(F.col("re") + 1e-9, "re", 5), _r(F.col("im") + 1e-9, "im", 5)),
    f"with {_VOLTS}, ph as (select ant, chan, t // 16 as blk, f, re, im, 2 * pi() * (f + 2 - 8) * (t % 16) / 16 as p from volt, generate_series(0, 11) _(f)) select ant, chan, blk, cast(f as int) as fine, round(sum(re * cos(p) + im * sin(p)) + 1e-9, 5) as re, round(sum(im * cos(p) - re * sin(p)) + 1e-9, 5) as im from ph group by ant, chan, blk, f",
)
_file = lambda s, d: spectra(s, d).select(F.col("chan").alias("file"), F.col("t"), "beam", "v").filter("file < 3")
_starts = lambda s, d: s.range(3).select(F.col("id").cast("int").alias("file"), (F.col("id") * 5).alias("start"))
_ALIGN = "al as (select chan as file, beam, t + chan * 5 - 10 as t, v from spectra where chan < 3 and t + chan * 5 - 10 >= 0)"
_add("aligned_merge", lambda s, d: voltages.aligned_merge(_file(s, d), _starts(s, d)).select("t", *[F.col("vals")[k].alias(f"v{k}") for k in range(3)]), f"with {_ALIGN} select t, min(v) filter (file = 0) as v0, min(v) filter (file = 1) as v1, min(v) filter (file = 2) as v2 from al group by t having count(*) = 3")
_add("aligned_mean", lambda s, d: voltages.aligned_mean(_file(s, d).withColumnRenamed("beam", "chan"), _starts(s, d)).withColumn("v", F.round("v", 6)), f"with {_ALIGN} select t, beam as chan, round(avg(v), 6) as v, count(*) as n from al group by all")
_part = lambda s, d: read(s, d, "part").select(F.col("p_partkey").alias("row"), F.col("p_size").alias("blid"), F.col("p_retailprice").alias("v"))
_add("row_difference", lambda s, d: voltages.row_difference(_part(s, d), _part(s, d).withColumn("v", F.col("v") * 0.5), "row", "blid", "v").withColumn("v", F.round("v", 6)), "select p_partkey as row, p_size as blid, round(p_retailprice - p_retailprice * 0.5, 6) as v from part")

# The uv plane and images
_lines = lambda s, d: read(s, d, "supplier").select(F.col("s_suppkey").alias("blid"), (((F.col("s_suppkey") * 37) % 101 - 50) / 64.0).alias("uu"), (((F.col("s_suppkey") * 53) % 89 - 44) / 64.0).alias("vv"))
_cells = lambda s, d: imaging.uv_cells(_lines(s, d), [1.0 + k / 32 for k in range(32)], 0.125, 0.125, 64)
_CELLS = (
    "px as (select s_suppkey as blid, k as chan, cast(round_even(-(((s_suppkey * 37) % 101 - 50) / 64.0::double) * (1 + k / 32.0::double) / 0.125 + 32, 0) as int) as u0, cast(round_even((((s_suppkey * 53) % 89 - 44) / 64.0::double) * (1 + k / 32.0::double) / 0.125 + 32, 0) as int) as v0 from supplier, generate_series(0, 31) _(k)),"
    " sh as (select blid, chan, (u0 + 32) % 64 as u, (v0 + 32) % 64 as v from px), nw as (select *, case when (u, v) is distinct from lag((u, v)) over (partition by blid order by chan) then 1 else 0 end as new from sh), ru as (select *, sum(new) over (partition by blid order by chan) as run from nw),"
    " ce as (select blid, any_value(u) as u, any_value(v) as v, min(chan) as first, max(chan) as last from ru where u <> 0 and v <> 0 group by blid, run),"
    " up as (select blid, u, v, cast(first as int) as first, cast(last as int) as last, case when u >= v then u else 64 - u end as upper_u, case when u >= v then v else 64 - v end as upper_v from ce)"
)
_add("uv_cells", _cells, f"with {_CELLS} select *, cast(2080 - (64 - upper_v) * (65 - upper_v) // 2 + upper_u - upper_v as bigint) as upper_idx from up")
_add(
    "uv_cells_at",
    lambda s, d: imaging.find_cells(_cells(s, d), read(s, d, "customer").select(F.col("c_custkey").alias("name"), (F.col("c_custkey") % 63 + 1).cast("int").alias("u"), (F.col("c_custkey") * 5 % 63 + 1).cast("int").alias("v")), 64),
    f"with {_CELLS}, wa as (select c_custkey as name, c_custkey % 63 + 1 as u, c_custkey * 5 % 63 + 1 as v from customer) select name, blid, first, last from up join wa on case when wa.u >= wa.v then wa.u else 64 - wa.u end = upper_u and case when wa.u >= wa.v then wa.v else 64 - wa.v end = upper_v",
)
_images = lambda s, d: spectra(s, d).select(F.col("beam").alias("idm"), (F.col("chan") % 8).alias("x"), F.expr("chan div 8").cast("int").alias("y"), "t", "v")
_add(
    "image_candidates",
    lambda s, d: imaging.image_candidates(imaging.image_boxcars(_images(s, d), 4, "sqrt", BLOCK), 4, 30.0).withColumn("sn", F.round("sn", 6)),
    "with im as (select beam as idm, chan % 8 as x, chan // 8 as y, t, v from spectra), bo as (" + " union all ".join(f"select idm, x, y, t, {w} as width, sum(v) over (partition by idm, x, y order by t range between {w - 1} preceding and current row) * {w**-0.5}::double as sn from im" for w in range(1, 5)) + ") select idm, t, x, cast(y as int) as y, width, round(sn, 6) as sn from bo qualify row_number() over (partition by idm, x, y, t order by sn desc, width) = 1 and sn >= 30",
)
_packets = lambda events: events.select(F.expr("event_id div 8").alias("integ"), (F.col("event_id") % 8).cast("int").alias("idx"), F.col("value").alias("v")).filter("idx <> 5 or integ % 3 <> 0")
_add(
    "stream_reordered",
    lambda s, d: blocks.run_available(blocks.reordered(_packets(blocks.stream_table(s, d, "events")), 4, 8, 1.0)).select("integ", *[F.nanvl(F.col("vals")[k], F.lit(None).cast("double")).alias(f"v{k}") for k in range(8)]),
    "with p as (select event_id // 8 as integ, event_id % 8 as idx, value as v from events where event_id % 8 <> 5 or event_id // 8 % 3 <> 0) select integ, " + ", ".join(f"max(v) filter (idx = {k}) as v{k}" for k in range(8)) + " from p group by integ having integ + 1 <= (select max(integ) from p) - 4",
)
_add("integration_gaps", lambda s, d: blocks.with_gaps(read(s, d, "orders").filter("o_orderkey % 5 <> 2").select(F.col("o_orderkey").alias("integ")).distinct(), 100), "with p as (select distinct o_orderkey as integ from orders where o_orderkey % 5 <> 2) select integ, coalesce(integ - lag(integ) over (order by integ) - 1, 0) as new from p")


# The trigger over micro-batches of candidates, and two-stage dedispersion of uv cells
_SPAN, _RULES = 30_000, trigger.Rules(6, 3, 20.0, 7, 1.0, 100.0, 35)


def _triggered(s, d):
    cand = _once(s, d).withColumns({"secs": F.col("sampno") / 100.0, "mjd": 58000 + F.col("sampno") / 1000.0}).select(*trigger.CANDIDATE)
    return trigger.first_replayed(cand, "sampno", _SPAN, _RULES, F.lit(59000.0))


_RAW = CAND_SQL.replace("cand as (", "raw as (", 1).replace("l_suppkey % 36 as beam", f"l_suppkey % 36 + 36 * (l_orderkey // {_SPAN}) as beam")
_DENSE = _SQL["cluster_strongest"].replace(CAND_SQL, f"{_RAW}, cand as materialized (select * from raw qualify row_number() over (partition by rid order by sn desc, sampno desc, boxcar desc, idt desc, dm desc, beam desc) = 1)")
_HEADS = _DENSE[: _DENSE.rindex(" select cluster, arg_max")] + ", heads as (select arg_max(rid, (sn, -rid)) as rid from dens join cand using (rid) group by cluster)"
_add(
    "stream_trigger",
    lambda s, d: _triggered(s, d).select("rid", "sn", "beam", "boxcar", "dm", _r("latency_ms", "latency_ms", 0)),
    f"{_HEADS} select rid, sn, beam % 36 as beam, boxcar, dm, round((59000.0 - (58000 + sampno / 1000.0::double)) * 86400e3, 0) as latency_ms from cand join heads using (rid) where sn > 20 and boxcar < 7 and dm > 1 and beam % 36 <> 35 and sampno / 100.0::double > 100 order by sampno // {_SPAN}, sn desc, rid limit 1",
)
_SUB, _NIDM = 16, 12
_sub_bands = lambda s, d: spectra(s, d).select((F.col("beam") * 4 + F.expr("chan div 16")).cast("int").alias("cell"), (F.expr("chan div 16") * 16).cast("int").alias("start"), "t", F.col("chan").cast("int").alias("chan"), F.col("v").cast("double").alias("re"), (F.col("v") % 7).cast("double").alias("im"))


def _two_stages(s, d):
    x = _sub_bands(s, d)
    cells = x.select("cell").distinct().select("cell", (F.col("cell") % 5 + 1).alias("u"), (F.expr("cell div 5") + 2).alias("v"))
    plan = imaging.sub_band_plan(x.select("start"), _NF, _SUB, _F0, _DF, _NIDM)
    return imaging.grid_delays(imaging.cell_delays(x, _SUB, _F0, _DF, _NIDM, BLOCK), cells, plan, 32, BLOCK)


def _share(a: str, b: str, c: str, e: str) -> str:
    return f"((({a}) ** -2 - ({b}) ** -2) / (({c}) ** -2 - ({e}) ** -2))"


_FREQ = lambda c: f"({_F0}::double + ({c}) * {_DF}::double)"
_LO, _MID, _HI = _FREQ("lo"), _FREQ("lo + n / 2"), _FREQ("lo + n")
_EARLY = f"cast(round_even(d * {_share(_FREQ('lo + n / 2.0 - 0.5'), _LO, _HI, _LO)}, 0) as bigint)"
_LATE = f"cast(round_even(d * {_share(_FREQ('lo + n / 2.0 + 0.5'), _LO, _HI, _LO)}, 0) as bigint)"
_add(
    "two_stage_grid",
    lambda s, d: _two_stages(s, d).select("blk", "idm", "t", "u", "v", F.col("re").cast("long").alias("re"), F.col("im").cast("long").alias("im")),
    f"""with recursive {SPECTRA_SQL}, st as (select unnest(generate_series(0, {_NF - 1}, {_SUB})) as start),
    band as (select start, d, start as lo, {_SUB} as n, d as e, 0::bigint as s from st, (select unnest(generate_series(0, {_NIDM - 1})) as d)),
    tr(start, idt, lo, n, d, s) as (select start, d, lo, n, e, s from band
        union all select start, idt, case when h = 0 then lo else lo + n // 2 end, n // 2, case when h = 0 then {_EARLY} else d - {_LATE} end, case when h = 0 then s else s + {_LATE} end from tr, (values (0), (1)) z(h) where n > 1),
    x as (select beam * 4 + chan // 16 as cell, chan // 16 * 16 as start, t, t // {BLOCK} as blk, chan, v as re, v % 7 as im from spectra),
    f as (select cell, x.start, blk, idt, t + s + k as t, sum(re) as re, sum(im) as im from (select x.*, tr.idt, tr.s, unnest(generate_series(0, tr.d)) as k from x join tr on tr.n = 1 and tr.start = x.start and tr.lo = x.chan) x where (t + s + k) // {BLOCK} = blk group by all),
    plan as (select start, idm, cast(round_even(idm * {_share(_FREQ('start'), _FREQ(f'start + {_SUB}'), _FREQ('0'), _FREQ(str(_NF)))}, 0) as bigint) as d,
             cast(round_even(idm * ({_share(_FREQ('0'), _FREQ('start'), _FREQ('0'), _FREQ(str(_NF)))} + 0.5::double / {_NIDM}), 0) as bigint) as shift from st, (select unnest(generate_series(0, {_NIDM - 1})) as idm)),
    p as (select cell % 5 + 1 as u, cell // 5 + 2 as v, blk, idm, (t - blk * {BLOCK} + shift) // 2 as t, (t - blk * {BLOCK} + shift) % 2 as odd, re, im from f join plan on plan.start = f.start and plan.d = f.idt where t - blk * {BLOCK} + shift < {BLOCK}),
    g as (select blk, idm, t, u, v, case odd when 0 then re else -im end as re, case odd when 0 then im else re end as im from p
          union all select blk, idm, t, (32 - u) % 32, (32 - v) % 32, case odd when 0 then re else im end, case odd when 0 then -im else re end from p)
    select blk, cast(idm as int) as idm, cast(t as int) as t, cast(u as int) as u, cast(v as int) as v, cast(sum(re) as bigint) as re, cast(sum(im) as bigint) as im from g group by blk, idm, t, u, v having sum(re) <> 0 or sum(im) <> 0""",
)


# The sky in pixels of equal area
_NSIDE = 16
_RINGS = f"""ring as (select i, case when i < {_NSIDE} then 1 - i * i / (3.0::double * {_NSIDE * _NSIDE}) when i > {3 * _NSIDE} then (4 * {_NSIDE} - i) ** 2 / (3.0::double * {_NSIDE * _NSIDE}) - 1 else 4.0::double / 3 - 2 * i / (3.0::double * {_NSIDE}) end as z,
    least(4 * i, 4 * {_NSIDE}, 16 * {_NSIDE} - 4 * i) as cnt, case when i < {_NSIDE} or i > {3 * _NSIDE} or (i - {_NSIDE}) % 2 = 0 then 0.5::double else 0 end as off from (select unnest(generate_series(1, 4 * {_NSIDE} - 1)) as i)),
    pixel as (select cast(row_number() over (order by i, j) - 1 as bigint) as pix, (j + off) * 360 / cnt as ra2, degrees(asin(z)) as dec2 from (select i, z, cnt, off, unnest(generate_series(0, cnt - 1)) as j from ring))"""
_sep = lambda a, d, a2, d2: f"degrees(2 * asin(sqrt(least(1.0::double, sin((radians({d2}) - radians({d})) / 2) ** 2 + cos(radians({d})) * cos(radians({d2})) * sin((radians({a2}) - radians({a})) / 2) ** 2))))"
_add(
    "sky_exposure",
    lambda s, d: sky.exposure(read(s, d, "customer").select((F.col("c_custkey") * 7 % 360).cast("double").alias("ra"), (F.col("c_custkey") % 181 - 90).cast("double").alias("dec"), F.col("c_nationkey").cast("long").alias("duration")), 4.3, _NSIDE),
    f"with {_RINGS}, sc as (select (c_custkey * 7 % 360)::double as ra, (c_custkey % 181 - 90)::double as dec, c_nationkey from customer) select pix, cast(sum(c_nationkey) as bigint) as duration, count(*) as scans from sc join pixel on {_sep('ra', 'dec', 'ra2', 'dec2')} <= 4.3 group by pix",
)
_add(
    "sky_pixels",
    lambda s, d: candidates(s, d).select(sky.pixel(F.col("sampno") * 0.7 % 360, F.col("idt") * 3.5 - 89, _NSIDE).alias("pix")).groupBy("pix").agg(F.count(F.lit(1)).alias("n")),
    f"""with a as (select sampno * 0.7::double % 360 as ra, sin(radians(idt * 3.5::double - 89)) as z from cand), b as (select z, ra / 90 as tt from a),
    c as (select z, tt, floor({_NSIDE} * (0.5 + tt) - {_NSIDE} * 0.75 * z) as jp, floor({_NSIDE} * (0.5 + tt) + {_NSIDE} * 0.75 * z) as jm, tt - floor(tt) as tp, {_NSIDE} * sqrt(3 * (1 - abs(z))) as tm from b),
    e as (select z, tt, {_NSIDE} + 1 + jp - jm as ir, jp + jm as su, floor(tp * tm) + floor((1 - tp) * tm) + 1 as cap from c)
    select cast(case when abs(z) <= 2.0::double / 3 then 2 * {_NSIDE} * ({_NSIDE} - 1) + (ir - 1) * 4 * {_NSIDE} + (floor((su - {_NSIDE} + 1 - ir % 2 + 1) / 2) + 4 * {_NSIDE}) % (4 * {_NSIDE})
      when z > 0 then 2 * cap * (cap - 1) + floor(tt * cap) % (4 * cap) else 12 * {_NSIDE * _NSIDE} - 2 * cap * (cap + 1) + floor(tt * cap) % (4 * cap) end as bigint) as pix, count(*) as n from e group by 1""",
)
_add(
    "identified",
    lambda s, d: sky.identify(
        candidates(s, d).select("rid", (F.col("beam") * 2.0).alias("ra"), (F.col("idt") - 25.0).alias("dec"), "dm").distinct(),
        read(s, d, "supplier").select(F.col("s_name").alias("name"), (F.col("s_suppkey") % 72).cast("double").alias("ra"), (F.col("s_nationkey") * 2.0 - 25.0).alias("dec"), (F.col("s_suppkey") % 11).alias("dm")), 2.5, 3.0,
    ),
    "with c as (select distinct rid, beam * 2.0::double as ra, idt - 25.0::double as dec, dm from cand), k as (select s_name as name, (s_suppkey % 72)::double as ra, s_nationkey * 2.0::double - 25 as dec, s_suppkey % 11 as dm from supplier),"
    f" m as (select c.rid, k.name, abs(c.dm - k.dm) as gap from c join k on abs(c.dm - k.dm) < 3 and {_SEP} < 2.5), b as (select rid, min((gap, name))[2] as main, string_agg(distinct name, ',' order by name) as names from m group by rid) select c.rid, main, names from c left join b using (rid)",
)
_fixes = lambda s, d: read(s, d, "orders").select((F.col("o_custkey") % 20).alias("sat"), F.col("o_orderkey").alias("t"), (F.col("o_orderkey") * 0.37 % 360).alias("ra"), (F.col("o_orderkey") % 97 - 48).cast("double").alias("dec"))
_beams = lambda s, d: read(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("beam"), (F.col("n_nationkey") * 14.0).alias("ra"), (F.col("n_nationkey") * 3.0 - 36).alias("dec"))
_add(
    "satellite_passes",
    lambda s, d: sky.passes(sky.tracks(_fixes(s, d), 8, 4096), _beams(s, d), 2.0, 1000),
    f"""with f as (select o_custkey % 20 as sat, o_orderkey as t, o_orderkey * 0.37::double % 360 as ra, (o_orderkey % 97 - 48)::double as dec from orders),
    g as (select *, lead(t) over w as t2, lead(ra) over w as ra2, lead(dec) over w as dec2 from f window w as (partition by sat order by t)),
    h as (select *, unnest(generate_series(cast(ceil(t / 8) as bigint) * 8, t2 - 1, 8)) as at_ from g where t2 is not null),
    v as (select sat, at_ as t, (at_ - t) / (t2 - t)::double as p, radians(ra) as a, radians(dec) as d, radians(ra2) as a2, radians(dec2) as d2 from h),
    u as (select sat, t, (1 - p) * cos(d) * cos(a) + p * cos(d2) * cos(a2) as x, (1 - p) * cos(d) * sin(a) + p * cos(d2) * sin(a2) as y, (1 - p) * sin(d) + p * sin(d2) as z from v),
    k as (select sat, t, degrees(atan2(y, x)) as ra, degrees(atan2(z, sqrt(x * x + y * y))) as dec from u),
    b as (select n_nationkey::bigint as beam, n_nationkey * 14.0::double as ra2, n_nationkey * 3.0::double - 36 as dec2 from nation),
    m as (select sat, t // 1000 as leg, min((round({_sep('ra', 'dec', 'ra2', 'dec2')}, 6), t, beam)) as m from k join b on {_sep('ra', 'dec', 'ra2', 'dec2')} < 2 group by all)
    select sat, leg, m[1] as sep, m[2] as t, m[3] as beam from m""",
)


# Polyphase channels and coherent dedispersion of the beams' summed series
_PATHS, _TAPS, _OVER, _UNDER, _RESP, _HALF = 32, 4, 32, 27, 64, 12
_complex = lambda s, d: S.dm0(spectra(s, d)).select("beam", "t", F.col("dm0").cast("double").alias("re"), (F.col("dm0") % 7).cast("double").alias("im"))
_CX = "cx as (select beam, t, sum(v)::double as re, (sum(v) % 7)::double as im from spectra group by all)"
_K, _STRIDE = _PATHS * _TAPS, _PATHS * _UNDER // _OVER
_add(
    "polyphase_channels",
    lambda s, d: channeliser.polyphase(_complex(s, d), ["beam"], channeliser.prototype(_PATHS, _TAPS), _PATHS, _OVER, _UNDER, 8).select("beam", "frame", "chan", _r("re", "re", 3), _r("im", "im", 3)),
    f"""with {_CX}, n as (select beam, (max(t) + 1 - {_K}) // {_STRIDE} as frames from cx group by beam),
    fr as (select beam, unnest(generate_series(0, frames - 1)) as frame from n),
    tap as (select m, i / {_PATHS}.0::double as u, i from (select m, {_K} - 1 - m - ({_K} - 1) / 2.0::double as i from (select unnest(generate_series(0, {_K} - 1)) as m))),
    co as (select m, (case when u = 0 then 1 else sin(pi() * u) / (pi() * u) end) * (0.5::double + 0.5::double * cos(2 * pi() * i / {_K})) as c from tap),
    p as (select fr.beam, frame, (({_PATHS} - 1 - m % {_PATHS}) - (frame * ({_PATHS} - {_STRIDE})) % {_PATHS} + {_PATHS}) % {_PATHS} as j, sum(c * re) as re, sum(c * im) as im
          from fr join co on true join cx on cx.beam = fr.beam and cx.t = {_K} + frame * {_STRIDE} - m group by all)
    select beam, frame, cast(chan as int) as chan, round(sum(re * cos(2 * pi() * chan * j / {_PATHS}) + im * sin(2 * pi() * chan * j / {_PATHS})), 3) as re,
           round(sum(im * cos(2 * pi() * chan * j / {_PATHS}) - re * sin(2 * pi() * chan * j / {_PATHS})), 3) as im from p, (select unnest(generate_series(0, {_PATHS} - 1)) as chan) group by beam, frame, chan""",
)
_add(
    "coherent_dedispersion",
    lambda s, d: channeliser.dedisperse_coherently(_complex(s, d), ["beam"], 3.0, 1320.5, 1.0, _HALF, _RESP, block=BLOCK).select("beam", "t", _r("re", "re", 3), _r("im", "im", 3)),
    f"""with {_CX}, f as (select j, 1320.5::double + (case when j < {_RESP // 2} then j else j - {_RESP} end) / {_RESP}.0::double as f from (select unnest(generate_series(0, {_RESP} - 1)) as j)),
    ph as (select j, 2 * pi() * 3.0::double / 2.41e-4::double * (f - 1320.5) ** 2 / 1320.5::double ** 2 / f * 1e6 as a from f),
    h as (select k, avg(cos(a + 2 * pi() * j * k / {_RESP})) as hr, avg(sin(a + 2 * pi() * j * k / {_RESP})) as hi from ph, (select unnest(generate_series(-{_HALF}, {_HALF})) as k) group by k)
    select o.beam, o.t, round(sum(hr * x.re - hi * x.im), 3) as re, round(sum(hr * x.im + hi * x.re), 3) as im from cx o join h on true join cx x on x.beam = o.beam and x.t = o.t - k group by all""",
)


# Packets put together by sequence number, and frame headers
def _reassembled(s, d):
    k = F.expr("event_id div 4")
    sent = read(s, d, "events").filter("event_id % 17 <> 0").select(
        F.lit("a").alias("addr"), (F.col("event_id") % 4).alias("device"), F.col("event_id").alias("n"), F.pmod(F.floor(k / 3), F.lit(256)).cast("int").alias("seq"), F.pmod(k, F.lit(3)).cast("int").alias("fragment"),
        F.lpad(F.col("event_id").cast("string"), 8, "0").cast("binary").alias("payload"),
    )
    stream, folder = stateful.replayed(sent, "n", 4000)
    return stateful.run_with_state(packets.frames(stream, (8, 8, 8)), folder)


_add(
    "stream_frames",
    lambda s, d: _reassembled(s, d).select("device", "seq", F.col("payload").cast("string").alias("payload")),
    "select event_id % 4 as device, cast(event_id // 12 % 256 as int) as seq, string_agg(lpad(event_id::varchar, 8, '0'), '' order by event_id) as payload from events where event_id % 17 <> 0 group by event_id % 4, event_id // 12 having count(*) = 3",
)
_PER = 25_000
_header = dict(frame="rid % 25000", seconds="sampno * 3000 % 15811200", epoch="boxcar + 30", stationid="beam", nchan="idt", period="27", framelength8="dm * 1000", nbits="boxcar", threadid="rid % 65536", totalsamples="rid * 5000000011", sync="2913907438")


def _moved_headers(s, d):
    head = candidates(s, d).select("rid", headers.encode(**{n: F.expr(e) for n, e in _header.items()}).alias("h"), ((F.col("rid") % 2_000_003) * 977 - 900_000_000).alias("by"))
    f = head.withColumn("f", headers.decode(F.col("h")))
    m = headers.moved(F.col("f.epoch"), F.col("f.seconds"), F.col("f.frame"), F.col("f.period"), F.col("by"), _PER)
    return f.withColumn("m", m).select("rid", F.hex("h").alias("header"), "f.totalsamples", "m.epoch", "m.seconds", "m.frame", _r(headers.frame_mjd(F.col("m.epoch"), F.col("m.seconds"), F.col("m.frame"), _PER, F.lit(27)), "mjd", 6))


_LE = lambda w: " || ".join(f"printf('%02X', (({w}) >> {k}) & 255)" for k in (0, 8, 16, 24))
_h = lambda n: f"({_header[n]})"
_WORDS = [_h("frame"), _h("seconds"), f"{_h('stationid')} | ({_h('epoch')}::bigint << 26)", f"{_h('framelength8')} | ({_h('nbits')}::bigint << 24)", f"{_h('threadid')}::bigint << 16", _h("nchan"), "0", _h("period"), f"{_h('totalsamples')} & 4294967295", f"{_h('totalsamples')} >> 32", "0", _h("sync"), "0", "0", "0", "0"]
_add(
    "frame_headers",
    _moved_headers,
    f"""with h as (select rid, {' || '.join(_LE(f'({w})::bigint') for w in _WORDS)} as header, {_h('totalsamples')} as totalsamples, {_h('epoch')} as e, {_h('seconds')} as s, {_h('frame')} + rid % 2000003 * 977 - 900000000 as f from cand),
    a as (select *, cast(floor(f / {_PER}::double) as bigint) as p, datediff('day', date '1858-11-17', make_date(2000 + e // 2, e % 2 * 6 + 1, 1)) as d from h),
    b as (select *, d * 86400 + s + p * 27 as at_ from a), c as (select *, date '1858-11-17' + cast(at_ // 86400 as int) as day from b),
    k as (select *, (year(day) - 2000) * 2 + case when month(day) > 6 then 1 else 0 end as epoch from c),
    m as (select *, datediff('day', date '1858-11-17', make_date(2000 + epoch // 2, epoch % 2 * 6 + 1, 1)) as d2 from k)
    select rid, header, totalsamples, cast(epoch as bigint) as epoch, at_ - d2 * 86400 as seconds, f - p * {_PER} as frame, round(d2 + (at_ - d2 * 86400 + (f - p * {_PER}) * 27 / {_PER}.0::double) / 86400.0, 6) as mjd from m""",
)


# Detections: noise of tree and boxcar, thresholds, edge rules, refreshed scaling
_NOISE = lambda s: detect.noise_table(s, _NF, _F0, _DF, _ND, _WIDTHS)
_boxed = lambda s, d: S.boxcars(dedisperse.dedisperse_tree(spectra(s, d), _NF, _F0, _DF, _ND, BLOCK).select(F.struct("beam", "idt").alias("beam"), "t", "v"), _WIDTHS, BLOCK).select("beam.beam", "beam.idt", "t", "width", "s")
_HIGH, _LOW = "greatest(depth + 1, width)", "least(depth + 1, width)"
_add(
    "strongest_in_noise",
    lambda s, d: detect.in_units_of_noise(_boxed(s, d), _NOISE(s)).groupBy("beam", "idt", "width").agg(_r(F.max("sn"), "sn"), F.count(F.lit(1)).alias("n")),
    f"with {_TREE_SQL}, w as (select unnest([{', '.join(map(str, _WIDTHS))}]) as width), noise as (select cast(idt as bigint) as idt, width, sqrt(sum(({_HIGH} - {_LOW} + 1) * {_LOW} * {_LOW} + (2 * {_LOW} - 1) * {_LOW} * ({_LOW} - 1) / 3)) as sigma from tr, w group by idt, width),"
    f" bx as ({_BOXED.replace('::double / sqrt', ' / 1 / sqrt')}), raw as (select beam, idt, t, width, sn * sqrt(width::double) as s from bx) select beam, idt, width, round(max(s / sigma), 6) as sn, count(*) as n from raw join noise using (idt, width) group by all",
)
_add(
    "threshold_only",
    lambda s, d: detect.above_threshold(dedisperse.dedisperse_tree(spectra(s, d), _NF, _F0, _DF, _ND, BLOCK), 300.0, 2, 50, BLOCK),
    f"with {_TREE_SQL} select beam, idt, t, v from tree where v > 300 and idt >= 2 qualify row_number() over (partition by t // {BLOCK} order by beam, idt, t) <= 50",
)
_add(
    "kernel_islands",
    lambda s, d: detect.kernel_islands(S.best_width(_series(s, d), (1, 2, 4, 8), BLOCK), 60.0, 40, 4).withColumn("sn", F.round("sn", 6)),
    f"with {_BEST}, h as (select *, t // 40 as blk, t - row_number() over (partition by beam, t // 40 order by t) as run from best where sn >= 60 and t % 40 < 32),"
    " z as (select beam, min(t) over w as start, max(t) over w as \"end\", round(sn, 6) as sn, width, t from h window w as (partition by beam, blk, run) qualify row_number() over (partition by beam, blk, run order by sn desc, width, t) = 1)"
    " select *, width > 4 as discarded from z where start % 40 <> 31",
)
_add(
    "rescale_refreshed",
    lambda s, d: detect.refreshed_scaling(spectra(s, d), 16, 4).select("beam", "t", "chan", _r("v", "v", 5)),
    f"with {_MV} select beam, t, chan, round((v + 128 / sc - mean) * sc, 5) as v from (select spectra.beam, spectra.t, spectra.chan, spectra.v, mv.mean, case when var > 0 then 18 / sqrt(var) else 1 end as sc from spectra join mv on mv.beam = spectra.beam and mv.chan = spectra.chan and mv.blk = spectra.t // {BLOCK} - 1) z",
)
# The frequency axis
_add("spectrum_summary", lambda s, d: channels.spectrum_summary(spectra(s, d), 1100.0, -0.5).select("beam", _r("mean", "mean"), _r("top", "top"), _r("bottom", "bottom"), "top_freq", "bottom_freq"), "with m as (select beam, chan, sum(v) / count(*) as m from spectra group by all) select beam, round(avg(m), 6) as mean, round(max(m), 6) as top, round(min(m), 6) as bottom, 1100.0::double - 0.5 * arg_max(chan, (m, -chan)) as top_freq, 1100.0::double - 0.5 * arg_min(chan, (m, chan)) as bottom_freq from m group by beam")
_add(
    "scrunched_axis",
    lambda s, d: channels.scrunched_axis(spectra(s, d).groupBy("chan").agg((F.max(F.abs("v")) > 65).alias("mask")).select("chan", channels.sky_frequency(F.col("chan"), 1100.0, -0.5).alias("freq"), "mask"), 6),
    "with a as (select chan, 1100.0::double - 0.5 * chan as freq, max(abs(v)) > 65 as mask from spectra group by chan) select chan // 6 as chan, avg(freq) as freq, bool_or(mask) as mask from a group by 1 having count(*) = 6",
)
_add("scrunched_mean", lambda s, d: channels.scrunched_mean(channels.inverted(channels.sliced(spectra(s, d), 4, 59), 56), 6).select("beam", "t", "chan", _r("v", "v")), "select beam, t, (59 - chan) // 6 as chan, round(sum(v) / 6.0::double, 6) as v from spectra where chan between 4 and 59 group by all")
_add(
    "weight_masked",
    lambda s, d: channels.masked(candidates(s, d).select("rid", (F.col("idt") - 10).alias("wt"), F.col("dm").alias("re"), F.col("boxcar").alias("im")), "wt", ["re", "im"]),
    "select rid, idt - 10 as wt, case when idt > 10 then dm end as re, case when idt > 10 then boxcar end as im from cand",
)
_add("polarisation_mean", lambda s, d: channels.summed_polarisations(spectra(s, d).withColumns({"pol": F.concat(F.lit("p"), F.pmod("chan", F.lit(3)).cast("string")), "chan": F.expr("chan div 3")}), "p0", "p1"), "select beam, t, chan // 3 as chan, avg(v) as v from spectra where chan % 3 < 2 group by all")
_add("asof_within", lambda s, d: C.as_of_within(_once(s, d).filter("boxcar = 1").select(F.col("rid").alias("lid"), F.col("sampno").alias("t"), "beam"), _once(s, d).filter("boxcar = 3").select("rid", F.col("sampno").alias("t"), "beam"), ["beam"], 50, False), f"with {_ONCE}, m as (select l.rid as lid, l.sampno as t, (select max(r.rid) from once r where r.boxcar = 3 and r.beam = l.beam and r.sampno <= l.sampno) as rid from once l where l.boxcar = 1) select lid, case when t - o.sampno <= 50 then m.rid end as rid, case when t - o.sampno <= 50 then t - o.sampno end as age from m left join once o on o.rid = m.rid")
_LEAPS = ", ".join(f"(date '{d}')" for d in scalars.LEAP_DAYS)
_add(
    "leap_seconds",
    lambda s, d: read(s, d, "orders").select("o_orderkey", scalars.leap_seconds(F.datediff("o_orderdate", F.lit("1858-11-17").cast("date"))).alias("dutc")),
    f"with l(d) as (values {_LEAPS}) select o_orderkey, cast((select case when count(*) > 0 then count(*) + 9 else 0 end from l where d <= cast(o_orderdate as date)) as int) as dutc from orders",
)
_add("antennas_valid", lambda s, d: channels.valid_antennas(read(s, d, "lineitem").select((F.col("l_suppkey") % 40).alias("a1"), (F.col("l_partkey") % 30).alias("a2")), [3, 7]), "select distinct ant from (select l_suppkey % 40 as ant from lineitem union all select l_partkey % 30 from lineitem) where ant not in (3, 7)")
_add("widest_baseline", lambda s, d: channels.widest_baseline(_vis(s, d).select(F.col("u").alias("uu"), F.col("v").alias("vv")), 1300.0), "select max(abs((beam - 18) * 0.5::double)) * 1300 as u, max(abs((idt - 25) * 0.5::double)) * 1300 as v from cand")

_add("cross_products_with_autos", lambda s, d: voltages.cross_products(_volts(s, d), 32, autos=True).select("a", "b", "chan", "integ", _r("re", "re"), _r("im", "im"), "n"), f"with {_VOLTS} select x.ant as a, y.ant as b, x.chan, x.t // 32 as integ, round(avg(x.re * y.re + x.im * y.im), 6) as re, round(avg(x.im * y.re - x.re * y.im), 6) as im, count(*) as n from volt x join volt y on x.chan = y.chan and x.t = y.t and x.ant <= y.ant group by all")
_add("moments_unflagged", lambda s, d: S.moments(spectra(s, d), BLOCK, F.abs("v") < 30), f"select beam, chan, t // {BLOCK} as blk, count(*) as n, cast(sum(v) as bigint) as s1, cast(sum(v * v) as bigint) as s2, cast(sum(v * v * v) as bigint) as s3, cast(sum(v * v * v * v) as bigint) as s4 from spectra where abs(v) < 30 group by all")
_add(
    "block_changes",
    lambda s, d: S.block_changes(_mv(s, d).withColumn("std", F.sqrt(F.greatest("var", F.lit(0.0))))).select("beam", "chan", "blk", _r("mean_change", "mean_change", 5), _r("std_change", "std_change", 5)),
    f"with {_MV}, w as (select *, sqrt(greatest(var, 0)) as std from mv), z as (select *, lag(mean) over (partition by beam, chan order by blk) as m0, lag(std) over (partition by beam, chan order by blk) as s0 from w) select beam, chan, blk, round(coalesce(case when m0 <> 0 then mean / m0 - 1 end, 0), 5) as mean_change, round(coalesce(case when s0 <> 0 then std / s0 - 1 end, 0), 5) as std_change from z",
)
_add("tscrunch_masked", lambda s, d: S.crunch_time(spectra(s, d).withColumn("beam", F.lit(0)), 4, True).select("beam", "chan", "t", _r("v", "v")), "select 0 as beam, chan, t // 4 as t, round(nullif(sum(v), 0) / 2.0, 6) as v from spectra group by all having count(*) = 4")


# Cells filled from baselines, two images in one grid, names
_cellplan = lambda s, d: spectra(s, d).select("beam", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")).distinct().select((F.col("beam") * 4 + F.col("k")).alias("cell"), F.col("beam").alias("blid"), (F.col("k") * 16 + F.col("beam")).alias("first"), F.least(F.col("k") * 16 + F.col("beam") + 9, F.lit(63)).alias("last"), (F.col("k") * 16).alias("start"), ((F.col("beam") + F.col("k")) % 2 == 1).alias("lower"))
_add(
    "cells_filled",
    lambda s, d: imaging.fill_cells(spectra(s, d).select(F.col("beam").alias("blid"), "t", "chan", F.col("v").cast("double").alias("re"), (F.col("v") % 7).cast("double").alias("im")), _cellplan(s, d), True, 0.25),
    "with c as (select beam * 4 + k as cell, beam as blid, k * 16 + beam as first, least(k * 16 + beam + 9, 63) as last, k * 16 as start, (beam + k) % 2 = 1 as lower from (select distinct beam from spectra), (values (0), (1), (2), (3)) z(k))"
    " select cell, start, t, chan, round_even(v * 0.25::double, 0) + 0.0::double as re, round_even(case when lower then -(v % 7) else v % 7 end * 0.25::double, 0) + 0.0::double as im from spectra join c on c.blid = spectra.beam and chan between first and last",
)
_add(
    "uv_grid_pairs",
    lambda s, d: imaging.grid_pairs(candidates(s, d).select(F.col("sampno").alias("t"), (F.col("beam") % 32).alias("u"), (F.col("idt") % 32).alias("v"), F.col("dm").alias("re"), F.col("boxcar").cast("long").alias("im")), 32),
    "with g as (select sampno // 2 as t, beam % 32 as u, idt % 32 as v, case when sampno % 2 = 1 then -boxcar else dm end as re, case when sampno % 2 = 1 then dm else boxcar end as im from cand"
    " union all select sampno // 2, (32 - beam % 32) % 32, (32 - idt % 32) % 32, case when sampno % 2 = 1 then boxcar else dm end, case when sampno % 2 = 1 then dm else -boxcar end from cand)"
    " select t, u, v, cast(sum(re) as bigint) as re, cast(sum(im) as bigint) as im from g group by all having sum(re) <> 0 or sum(im) <> 0",
)
_add(
    "scan_intents",
    lambda s, d: read(s, d, "customer").select("c_custkey", scalars.scan_intent(F.when(F.col("c_custkey") % 3 == 0, "Big FlysEye").when(F.col("c_custkey") % 3 == 1, "Standard").otherwise(F.col("c_mktsegment")), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("PSR beam "), "c_name")).otherwise(F.col("c_name"))).alias("intent"), scalars.antenna_number(F.concat(F.lit("ak"), F.substring("c_name", -2, 2))).alias("ant")),
    "select c_custkey, case when c_custkey % 3 = 0 then case when c_custkey % 2 = 0 then 'PSR_CHECK' else 'FRB_FLYSEYE' end when c_custkey % 3 = 1 and c_custkey % 2 = 0 then 'PSR_CAL' else 'UNKNOWN' end as intent, cast(right(c_name, 2) as int) as ant from customer",
)
