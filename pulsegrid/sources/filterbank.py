"""Filterbank files: a tagged binary header, then samples of nchans numbers each; and candidate lists as text."""

from __future__ import annotations

import os
import struct
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# The header's keys by type, as the file format has them.
STRINGS = ("rawdatafile", "source_name")
INTS = ("telescope_id", "machine_id", "data_type", "barycentric", "pulsarcentric", "nbits", "nsamples", "nchans", "nifs")
DOUBLES = ("az_start", "za_start", "src_raj", "src_dej", "tstart", "tsamp", "fch1", "foff", "fchannel", "refdm", "period")
_TYPES = {8: np.uint8, 32: np.float32}
CANDIDATE = "sn float, sampno long, secs double, boxcar int, idt int, dm double, beamno int, mjd double"


def _text(s: str) -> bytes:
    return struct.pack("<i", len(s)) + s.encode()


def header_bytes(header: dict) -> bytes:
    """The header as a file holds it; unknown keys are left out."""
    out = _text("HEADER_START")
    for key, value in header.items():
        if key in STRINGS:
            out += _text(key) + _text(value)
        elif key in INTS or key in DOUBLES:
            out += _text(key) + struct.pack("<i" if key in INTS else "<d", value)
    return out + _text("HEADER_END")


def read_header(path: str) -> tuple[dict, int]:
    """The header and the place of the first sample; of a repeated key the first counts; nsamples from the file's size if absent."""
    header: dict = {}
    with open(path, "rb") as f:
        number = lambda kind: struct.unpack(kind, f.read(struct.calcsize(kind)))[0]
        word = lambda: f.read(number("<i")).decode()
        if word() != "HEADER_START":
            raise ValueError(f"{path} has no filterbank header")
        while (key := word()) != "HEADER_END":
            if key not in STRINGS + INTS + DOUBLES:
                raise ValueError(f"unknown header key {key!r}")
            value = word() if key in STRINGS else number("<i" if key in INTS else "<d")
            header.setdefault(key, value)
        start, end = f.tell(), f.seek(0, 2)
    header.setdefault("nsamples", (end - start) * 8 // (header["nbits"] * header["nchans"] * header.get("nifs", 1)))
    return header, start


class _Range(InputPartition):
    def __init__(self, beam: int, path: str, first: int, last: int):
        super().__init__(beam)
        self.beam, self.path, self.first, self.last = beam, path, first, last


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.step = options["path"].split(","), int(options.get("step", 1 << 16))
        self.span = int(options.get("start", 0)), int(options.get("end", 1 << 62))

    def partitions(self) -> list[_Range]:
        headers = [read_header(p)[0] for p in self.paths]
        same = ("nchans", "nbits", "tstart", "tsamp", "fch1", "foff")
        if len({tuple(h.get(k) for k in same) for h in headers}) > 1 or any(h.get("nifs", 1) != 1 for h in headers):
            raise ValueError("files must agree on " + ", ".join(same) + " and have one stream each")
        return [
            _Range(beam, p, t, min(t + self.step, h["nsamples"], self.span[1]))
            for beam, (p, h) in enumerate(zip(self.paths, headers, strict=True))
            for t in range(self.span[0], min(h["nsamples"], self.span[1]), self.step)
        ]

    def read(self, part: _Range):
        header, at = read_header(part.path)
        n, bits = header["nchans"], header["nbits"]
        size, count = n * bits // 8, part.last - part.first
        with open(part.path, "rb") as f:
            f.seek(at + part.first * size)
            raw = f.read(count * size)
        if bits in _TYPES:
            x = np.frombuffer(raw, np.dtype(_TYPES[bits]).newbyteorder("<"))
        else:  # one or two bits, the low ones first
            x = ((np.frombuffer(raw, np.uint8)[:, None] >> np.arange(0, 8, bits, dtype=np.uint8)) & ((1 << bits) - 1)).ravel()
        x = x[: len(x) // n * n].astype(np.float32)
        rows = len(x) // n
        vals = pa.ListArray.from_arrays(np.arange(0, len(x) + 1, n, dtype=np.int32), x)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(rows, part.beam, np.int32)), pa.array(np.arange(part.first, part.first + rows)), vals], names=["beam", "t", "vals"])


class Filterbank(DataSource):
    """spark.read.format("filterbank").load(path): beam, t, vals. Several files, comma-separated, are beams 0, 1, ...; options start, end and step cut time into partitions.

    Paths must be on storage that all executors mount.
    """

    @classmethod
    def name(cls) -> str:
        return "filterbank"

    def schema(self) -> str:
        return "beam int, t long, vals array<float>"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def read_filterbank(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(Filterbank)
    return spark.read.format("filterbank").options(**options).load(path)


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Candidates with any blanks between columns; blank and `#` lines are skipped, columns past the eighth left out, and without an eighth mjd is 0."""
    p = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter(~F.col("value").rlike(r"^\s*(#|$)"))
    cols = [F.get(p, F.lit(k)).cast(t).alias(n) for k, (n, t) in enumerate(c.split() for c in CANDIDATE.split(", "))]
    return rows.select(*cols).fillna({"mjd": 0.0})


def write_candidates(cand: DataFrame, path: str, negative: bool = False) -> None:
    """As text lines "sn sampno secs boxcar idt dm beamno mjd"; negative turns the signs of idt and dm, as for a band searched upside down."""
    sign = -1 if negative else 1
    line = F.format_string("%f %d %f %d %d %.3f %d %.15f", "sn", "sampno", "secs", "boxcar", F.col("idt") * sign, F.col("dm") * sign, "beamno", "mjd")
    cand.select(line).write.text(path)


#: Columns of a list of merged candidates, and its formats.
_FOF = (("sn", "%.2f"), ("sampno", "%d"), ("secs", "%.2f"), ("boxcar", "%d"), ("idt", "%d"), ("dm", "%.2f"), ("beamno", "%d"), ("mjd", "%.15f"), ("t0", "%d"), ("t1", "%d"), ("i0", "%d"), ("i1", "%d"), ("ncands", "%d"))


def write_clusters(heads: DataFrame, path: str, merged: bool) -> None:
    """Strongest members of clusters as text: eight columns, or thirteen with the extent in time and idt and the number of merged candidates."""
    columns = _FOF if merged else _FOF[:8]
    line = F.format_string(" ".join(f for _, f in columns), *[F.col(c) for c, _ in columns])
    heads.select(line).write.text(path)


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    """What write_clusters wrote with merged."""
    p = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter(~F.col("value").rlike(r"^\s*(#|$)"))
    return rows.select(*[F.get(p, F.lit(k)).cast("double" if "f" in f else "long").alias(c) for k, (c, f) in enumerate(_FOF)])


def write_by_identity(cand: DataFrame, path: str) -> None:
    """cand: CANDIDATE columns, main (null where nothing is known there), names. Lines under known=true ("main line names") and known=false (the line)."""
    line = F.format_string("%f %d %f %d %d %.3f %d %.15f", "sn", "sampno", "secs", "boxcar", "idt", "dm", "beamno", "mjd")
    known = F.col("main").isNotNull()
    cand.select(known.alias("known"), F.when(known, F.concat_ws(" ", "main", line, "names")).otherwise(line).alias("value")).write.partitionBy("known").text(path)


def collect_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """All `.cand` files at or below a folder; empty ones have no rows."""
    p = F.split(F.trim("value"), r"\s+")
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.cand").text(folder).filter(~F.col("value").rlike(r"^\s*(#|$)"))
    cols = [F.get(p, F.lit(k)).cast(t).alias(n) for k, (n, t) in enumerate(c.split() for c in CANDIDATE.split(", "))]
    return rows.select(*cols).fillna({"mjd": 0.0})


def of_known_pulsar(cand: DataFrame, min_sn: float = 7.0, low: float = 65.0, high: float = 70.0) -> DataFrame:
    """Candidates of at least min_sn with low < dm < high, in order of the sample."""
    return cand.filter((F.col("sn") >= min_sn) & (F.col("dm") > low) & (F.col("dm") < high)).orderBy("sampno")


def weakest_first(cand: DataFrame) -> DataFrame:
    """By rising S/N, as the cluster tools read them; ties in order of the sample."""
    return cand.orderBy("sn", "sampno")


_PACK = {8: np.uint8, 32: np.float32}


def write_filterbank(x: DataFrame, path: str, header: dict, span: int) -> DataFrame:
    """x: beam, t, vals. A file per beam and span of time, each with its own header (tstart moved on), under a folder that all executors mount; samples missing in between are 0.

    Returns beam, first, rows, file; nothing is written before an action. A group is one file.
    """
    bits, n = header["nbits"], header["nchans"]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        beam, blk = int(rows["beam"].iloc[0]), int(rows["blk"].iloc[0])
        t = rows["t"].to_numpy()
        first = int(t.min())
        cube = np.zeros((int(t.max()) - first + 1, n), _PACK[bits])
        values = np.stack(rows["vals"].to_list())
        cube[t - first] = np.clip(np.rint(values), 0, 255) if bits == 8 else values
        name = f"{path}/beam{beam:02}-{blk:08}.fil"
        head = header | {"nsamples": len(cube), "tstart": header.get("tstart", 0.0) + first * header["tsamp"] / 86400.0}
        with open(f"{name}.{uuid.uuid4().hex}", "wb") as f:  # a task that is run twice leaves one whole file
            f.write(header_bytes(head) + cube.tobytes())
        os.replace(f.name, name)
        return pd.DataFrame({"beam": [beam], "first": [first], "rows": [len(cube)], "file": [name]})

    return x.withColumn("blk", F.expr(f"t div {span}")).groupBy("beam", "blk").applyInPandas(run, "beam int, first long, rows long, file string")


def read_header_lines(lines: DataFrame) -> DataFrame:
    """lines: path, value, of "KEY value # comment" headers. path, key, value, comment; lines of one word go, and of a repeated key the last line counts (n)."""
    text = F.regexp_extract("value", r"^\s*\S+\s+(.*)$", 1)
    rows = lines.filter(F.col("value").rlike(r"^\s*\S+\s+\S")).select(
        "path", "n", F.regexp_extract("value", r"^\s*(\S+)", 1).alias("key"), F.trim(F.split(text, "#", 2)[0]).alias("text"), F.trim(F.get(F.split(text, "#", 2), F.lit(1))).alias("comment")
    )
    return rows.groupBy("path", "key").agg(F.max(F.struct("n", "text", "comment")).alias("m")).select("path", "key", F.col("m.text").alias("value"), F.col("m.comment").alias("comment"))


def read_parset_lines(lines: DataFrame) -> DataFrame:
    """lines: path, n, value, of "name = value" files. path, key, values: one value, or those of [a,b]; # begins a comment, the last line of a name counts."""
    bare = F.split("value", "#", 2)[0]
    rows = lines.filter(F.instr(bare, "=") > 0).select("path", "n", F.trim(F.substring_index(bare, "=", 1)).alias("key"), F.trim(F.expr("substring(split(value, '#', 2)[0], instr(split(value, '#', 2)[0], '=') + 1)")).alias("v"))
    last = rows.groupBy("path", "key").agg(F.max(F.struct("n", "v")).alias("m")).select("path", "key", F.col("m.v").alias("v"))
    inner = F.regexp_extract("v", r"^\[(.*)\]$", 1)
    return last.select("path", "key", F.when(F.col("v").rlike(r"^\[.*\]$"), F.split(inner, ",")).otherwise(F.array("v")).alias("values"))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, n (place in the file), value. Header files are small: each is read whole by one task."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.split("value", "\n").alias("v"))
    return files.select("path", F.posexplode("v").alias("n", "value"))
