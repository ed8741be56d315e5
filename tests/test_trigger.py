import numpy as np
from pyspark.sql import functions as F

from pulsegrid.operators import imaging
from pulsegrid.plans import registry
from pulsegrid.streaming import search, trigger

RULES = trigger.Rules(6, 3, 20.0, 6, 3.0, 10.0, 35)
SCHEMA = "rid long, sn double, sampno long, secs double, boxcar int, idt int, dm long, beam long, mjd double"


def burst(rid, sn, sampno, beam=1, n=4):
    return [(rid + k, sn + k, sampno + k, (sampno + k) / 100, 2, 5, 10, beam, 58000.0) for k in range(n)]


def test_replayed_batch_writes_once(spark, tmp_path):
    folder = str(tmp_path)
    rows = [burst(0, 30.0, 500), burst(10, 25.0, 2500) + burst(20, 40.0, 2600, beam=35) + burst(30, 90.0, 2700, n=1), burst(40, 99.0, 4500)]
    batches = [spark.createDataFrame(r, SCHEMA) for r in rows]
    trigger.strongest(batches[0].limit(0), RULES).write.parquet(f"{folder}/found/batch=-1")
    run = trigger.on_batch(folder, RULES, F.lit(58000.5))
    for number in (0, 1, 1, 1, 2, 2, 1):  # 0 is too early for min_secs; 1 comes again, even after 2
        run(batches[number], number)
    got = trigger.found(spark, folder).collect()
    assert [(r.rid, r.sn, r.batch) for r in got] == [(13, 28.0, 1)]
    assert got[0].latency_ms == 0.5 * 86_400e3


def test_stream_stops_at_the_first_match(spark, tmp_path):
    cand = spark.createDataFrame([x for k in range(6) for x in burst(100 * k, 30.0 + k, 2000 + 1000 * k)], SCHEMA)
    search.replay(cand, "sampno", 1000, f"{tmp_path}/in")
    query = trigger.trigger(search.as_stream(spark, f"{tmp_path}/in", cand.schema), str(tmp_path), RULES, available_now=False)
    got = trigger.first_match(spark, query, str(tmp_path), 0.5).collect()
    assert [r.rid for r in got] == [3] and got[0].latency_ms > 0 and not query.isActive
    assert trigger.found(spark, str(tmp_path)).count() == 1


def test_trigger_query_finds_something(spark):
    assert registry.queries()["stream_trigger"](spark, "/root/testdata/sf0.001").count() <= 1


def test_two_stages_follow_the_whole_curve(spark):
    """A burst along the whole band's curve comes out at its idm and time, whatever sub-band a cell covers."""
    nf, sub, f0, df, nd, block = 64, 16, 1.0, 0.005, 12, 64
    idm, at = 9, 20
    share = lambda a, b: (a**-2 - b**-2) / (f0**-2 - (f0 + nf * df) ** -2)
    rows = [(c // sub, c // sub * sub, at + w - round(idm * share(f0, f0 + (c + 0.5) * df)) + idm, c, 1.0, 0.0) for c in range(nf) for w in range(3)]
    x = spark.createDataFrame(rows, "cell int, start int, t long, chan int, re double, im double")
    cells = spark.createDataFrame([(k, k + 1, 3) for k in range(4)], "cell int, u int, v int")
    grid = imaging.grid_delays(imaging.cell_delays(x, sub, f0, df, nd, block), cells, imaging.sub_band_plan(x, nf, sub, f0, df, nd), 32, block)
    power = {}
    for r in grid.filter("v = 3").collect():
        for value, t in ((r.re, 2 * r.t), (r.im, 2 * r.t + 1)):
            power[r.idm, t] = power.get((r.idm, t), 0) + value
    (best, t), most = max(power.items(), key=lambda kv: kv[1])
    assert abs(best - idm) <= 1 and most > 0.9 * nf and 0 <= t - at - idm <= 3
    assert np.isclose(sum(v for (i, _), v in power.items() if i == 0), 3 * nf)


def test_replayed_table_is_read_once_and_until_a_match(spark):
    """Parts arrive a few at a time; the table is not read again for each, and an empty one gives no row."""
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rows = [x for k in range(12) for x in burst(100 * k, 30.0 + k, 2000 + 1000 * k, n=4 if k > 8 else 2)]
    cand = spark.createDataFrame(rows, SCHEMA).mapInArrow(seen, SCHEMA)
    got = trigger.first_replayed(cand, "sampno", 1000, RULES, F.lit(59000.0), few=6).collect()
    assert [r.rid for r in got] == [903] and read.value == len(rows)
    assert trigger.first_replayed(cand.limit(0), "sampno", 1000, RULES).count() == 0
