import random

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import headers
from pulsegrid.sources import gains
from pulsegrid.streaming import packets, search


def test_headers_there_and_back(spark):
    rng = random.Random(1)
    names = [n for n, *_ in headers.FIELDS if not n.startswith("samples")]
    rows = [tuple(rng.randrange(1 << w) for n, _, _, w in headers.FIELDS if n in names) + (rng.randrange(1 << 62),) for _ in range(200)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} long" for n in [*names, "totalsamples"]))
    coded = df.select(headers.encode(**{n: F.col(n) for n in df.columns}).alias("h"))
    back = coded.select(F.octet_length("h").alias("size"), headers.decode(F.col("h")).alias("f")).select("size", "f.*")
    assert sorted(tuple(r[n] for n in df.columns) for r in back.collect()) == sorted(rows) and {r.size for r in back.collect()} == {64}
    assert coded.select(headers.encode(sync=F.lit(0xADEADBEE)).alias("h")).first().h[44:48] == bytes.fromhex("EEDBEAAD")
    assert spark.range(1).select(headers.decode(F.lit(b"\0" * 63)).alias("f")).first().f is None
    with pytest.raises(Exception, match="does not fit"):
        spark.range(1).select(headers.encode(nbits=F.lit(32))).collect()


def test_frames_carry_over_the_end_of_an_epoch(spark):
    # the last frame of 2017-06-30 is in epoch 34; 27 s and 25,000 frames a period
    last = 181 * 86400 - 27
    cases = [(34, last, 24_999, 1), (34, last, 24_999, 0), (35, 0, 0, -1), (34, 0, 5, 25_000 * 3200 * 365), (35, 100, 7, -25_000 * 10)]
    df = spark.createDataFrame(cases, "epoch long, seconds long, frame long, by long")
    m = headers.moved(F.col("epoch"), F.col("seconds"), F.col("frame"), F.lit(27), F.col("by"), 25_000)
    got = [tuple(r) for r in df.select(m.alias("m")).select("m.*").collect()]
    assert got[:3] == [(35, 0, 0), (34, last, 24_999), (34, last, 24_999)]
    assert got[3] == (36, 27 * 3200 * 365 - (181 + 184) * 86400, 5) and got[4] == (34, 181 * 86400 + 100 - 270, 7)
    back = headers.moved(F.col("m.epoch"), F.col("m.seconds"), F.col("m.frame"), F.lit(27), -F.col("by"), 25_000)
    assert [tuple(r) for r in df.select("by", m.alias("m")).select(back.alias("b")).select("b.*").collect()] == [c[:3] for c in cases]
    assert spark.range(1).select(headers.epoch_start(F.lit(34))).first()[0] == 57754
    with pytest.raises(Exception, match="before the first epoch"):
        spark.range(1).select(headers.moved(F.lit(0), F.lit(5), F.lit(0), F.lit(27), F.lit(-25_000), 25_000)).collect()


LISTING = """# Gain/Polarization listing for a.mir
# Listing of the {} of the bandpass for X,Y
# Number of antennas: 5
# Freq(GHz)     X1        Y1        X2        Y2
"""


def listing(path, quantity, rows):
    text = LISTING.format(quantity)
    for x, values in rows:
        for k in range(0, len(values), 4):
            text += f"{x if k == 0 else '':<14}" + "".join(f"{v:10.5f}" for v in values[k : k + 4]) + "\n"
        text += "\n" if x == "0.7310" else ""
    path.write_text(text)


def test_gain_records_for_any_split(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"0.{7300 + k}", [round(rng.uniform(-2, 2), 5) for _ in range(10)]) for k in range(40)]
    other = [("0.9000", [0.0] * 10), ("0.9000", [1.5] * 10)]
    (tmp_path / "in").mkdir()
    listing(tmp_path / "in" / "a.real", "Real", rows)
    listing(tmp_path / "in" / "b.real", "Real", other)
    want = sorted((name, k, x, i // 2 + 1, "XY"[i % 2], v) for name, table in (("a.real", rows), ("b.real", other)) for k, (x, values) in enumerate(table) for i, v in enumerate(values))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("97", "700", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            got = gains.read_gains(spark, str(tmp_path / "in"))
            assert sorted((r.path.rsplit("/", 1)[1], r.record, r.x, r.ant, r.pol, r.v) for r in got.collect()) == want
            assert got.select("source", "quantity").distinct().collect() == [("a.mir", "Real")]
        assert gains.ordered_lines(spark, str(tmp_path / "in")).rdd.getNumPartitions() >= 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    (tmp_path / "short").write_text((tmp_path / "in" / "b.real").read_text().rsplit("\n", 2)[0] + "\n")
    with pytest.raises(Exception, match="record 0.9000 has 8 values"):
        gains.read_gains(spark, str(tmp_path / "short")).collect()


def test_gains_are_turned_into_corrections(spark, tmp_path):
    listing(tmp_path / "r", "Real", [("t", [3.0] * 9 + [0.0])])
    listing(tmp_path / "i", "Imag", [("t", [4.0] * 9 + [0.0])])
    listing(tmp_path / "j", "Imag", [("u", [4.0] * 10)])
    read = lambda n: gains.read_gains(spark, str(tmp_path / n))
    got = {(r.ant, r.pol): complex(r.re, r.im) for r in gains.inverse_gains(read("r"), read("i")).collect()}
    assert len(got) == 10 and got[5, "Y"] == 0 and abs(got[1, "X"] - 1 / (3 - 4j)) < 1e-12
    with pytest.raises(Exception, match="listings differ"):
        gains.inverse_gains(read("r"), read("j")).collect()


def test_packets_with_skips_and_wraps(spark, tmp_path):
    """Against a plain account of what was sent: frames whose fragments all came, in any order, with one number at a time."""
    rng = random.Random(3)
    sent, whole, n = [], [], 0
    for device in (0, 1):
        for frame in range(600):
            if rng.random() < 0.03:
                continue  # a number skipped
            parts = [0, 1, 2]
            rng.shuffle(parts)
            if rng.random() < 0.1:
                parts.pop()
            bodies = [f"{device}-{frame:04}-{k}".encode() for k in range(3)]
            for k in parts:
                sent.append(("h", device, n, frame % 256, k, bodies[k]))
                n += 1
                if rng.random() < 0.05 and k != parts[-1]:
                    sent.append(("h", device, n, frame % 256, k, bodies[k]))  # twice
                    n += 1
                if rng.random() < 0.02:
                    sent.append(("h", device, n, frame % 256, 1, b"short"))
                    n += 1
            if len(parts) == 3:
                whole.append((device, frame, b"".join(bodies)))
    df = spark.createDataFrame(sent, "addr string, device int, n long, seq int, fragment int, payload binary")
    search.replay(df, "n", 700, f"{tmp_path}/in")
    out = search.run_with_state(packets.frames(search.as_stream(spark, f"{tmp_path}/in", df.schema), (8, 8, 8)), str(tmp_path)).collect()
    assert sorted((r.device, bytes(r.payload)) for r in out) == sorted((d, p) for d, _, p in whole)
    first = {d: min(f for e, _, _, f, _, _ in [(s[1], 0, 0, int(s[5][2:6]), 0, 0) for s in sent if s[5] != b"short"] if e == d) for d in (0, 1)}
    assert sorted((r.device, r.frame + first[r.device], r.seq) for r in out) == sorted((d, f, f % 256) for d, f, _ in whole)
    last = max((r for r in out if r.device == 0), key=lambda r: r.frame)
    frames_sent = {int(s[5][2:6]) for s in sent if s[1] == 0 and s[5] != b"short"}
    span = range(first[0], last.frame + first[0] + 1)
    assert last.skipped == sum(f not in frames_sent for f in span)
    assert last.discarded == sum(f in frames_sent for f in span) - sum(d == 0 and f in span for d, f, _ in whole)
