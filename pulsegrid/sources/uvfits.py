"""UVFITS visibilities: random groups of fixed length in a file of 2,880-byte blocks, as a Spark data source.

Header cards give the layout: GCOUNT groups of PCOUNT scaled parameters (PTYPEn, PSCALn, PZEROn) and one array
(NAXISn; the first axis is 0, the mark of random groups). Parameters of one name add up, as DATE often comes in
two parts; DATE is then exact in double. Splits are ranges of groups, and a partition opens the file at its first
one. Files must be on storage that all executors mount.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

BLOCK, CARD = 2880, 80
KINDS = {8: ">u1", 16: ">i2", 32: ">i4", -32: ">f4", -64: ">f8"}
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
SCHEMA = "file string, row long, date double, baseline int, uu double, vv double, ww double, source int, inttim float, re array<float>, im array<float>, wt array<float>"


@dataclass(frozen=True)
class Layout:
    """Of one file: where groups begin, how many there are, their type, and the parameters' names, scales and zeros."""

    start: int
    count: int
    kind: np.dtype
    names: tuple[str, ...]
    scale: tuple[float, ...]
    zero: tuple[float, ...]

    @property
    def size(self) -> int:
        return self.kind.itemsize


def _value(text: str) -> str | float | int | bool | None:
    text = text.strip()
    if text.startswith("'"):
        return text[1:].split("'")[0].rstrip()
    text = text.split("/")[0].strip()
    if text in ("T", "F"):
        return text == "T"
    if not text:
        return None
    number = float(text.replace("D", "E"))
    return int(number) if number.is_integer() and "." not in text else number


def read_header(path: str) -> tuple[dict[str, str | float | int | bool | None], int]:
    """The first header's cards, of a repeated key the first, and its length in bytes."""
    head: dict[str, str | float | int | bool | None] = {}
    with open(path, "rb") as f:
        while True:
            block = f.read(BLOCK)
            if len(block) < BLOCK:
                raise ValueError(f"{path}: header without END")
            for k in range(0, BLOCK, CARD):
                card = block[k : k + CARD].decode("ascii", "replace")
                if card.rstrip() == "END":
                    return head, f.tell()
                if card[8:10] == "= ":
                    head.setdefault(card[:8].strip(), _value(card[10:]))


def layout(path: str) -> Layout:
    head, start = read_header(path)
    if not head.get("GROUPS") or head.get("NAXIS1") != 0:
        raise ValueError(f"{path}: no random groups")
    kind, n = KINDS[head["BITPIX"]], head["PCOUNT"]
    shape = tuple(int(head[f"NAXIS{k}"]) for k in range(head["NAXIS"], 1, -1))
    return Layout(
        start, head["GCOUNT"], np.dtype([("p", kind, (n,)), ("data", kind, shape)]),
        tuple(str(head[f"PTYPE{k}"]).strip() for k in range(1, n + 1)), tuple(float(head.get(f"PSCAL{k}", 1.0)) for k in range(1, n + 1)), tuple(float(head.get(f"PZERO{k}", 0.0)) for k in range(1, n + 1)),
    )


def parameters(rows: np.ndarray, lay: Layout) -> dict[str, np.ndarray]:
    """Scaled parameters in double, by the first eight letters of the name without dashes; of one name they add up."""
    out: dict[str, np.ndarray] = {}
    for k, name in enumerate(lay.names):
        value = rows["p"][:, k].astype(np.float64) * lay.scale[k] + lay.zero[k]
        key = name.upper().split("-")[0].strip()
        out[key] = out[key] + value if key in out else value
    return out


class _Range(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        super().__init__((path, first))
        self.path, self.first, self.last = path, first, last


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = options["path"].split(",")
        self.together = int(options.get("rows", 100_000))
        self.first, self.last = int(options.get("istart", 0)), options.get("iend")
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        """Takes over tests of date, baseline and row against constants; the others stay with Spark."""
        names = {EqualTo: "==", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", In: "in"}
        for f in filters:
            if type(f) in names and len(f.attribute) == 1 and f.attribute[0] in ("date", "baseline", "row") and f.value is not None:
                self.tests.append((f.attribute[0], names[type(f)], f.value))
            else:
                yield f

    def _passing(self, of: dict[str, np.ndarray], n: int) -> np.ndarray:
        keep = np.ones(n, bool)
        for name, how, value in self.tests:
            if name in of:
                x = of[name]
                keep &= np.isin(x, list(value)) if how == "in" else {"==": x == value, ">": x > value, ">=": x >= value, "<": x < value, "<=": x <= value}[how]
        return keep

    def _dates(self, path: str, lay: Layout, rows: list[int]) -> list[float]:
        out = []
        with open(path, "rb") as f:
            for k in rows:
                f.seek(lay.start + k * lay.size)
                out.append(float(parameters(np.frombuffer(f.read(lay.size), lay.kind), lay)["DATE"][0]))
        return out

    def _bounds(self, path: str, lay: Layout, first: int, last: int) -> tuple[int, int]:
        """The rows that tests of row and (as groups come in order of time) of date leave over."""
        for name, how, value in self.tests:
            if name == "row" and how != "in":
                first = max(first, value + (how == ">")) if how in (">", ">=", "==") else first
                last = min(last, value + (how != "<")) if how in ("<", "<=", "==") else last
            if name == "date" and how != "in":
                for edge in ("first", "last"):  # by halves: a few reads of one group
                    if (how in ("<", "<=")) == (edge == "first") and how != "==":
                        continue
                    a, b = first, last
                    while a < b:
                        mid = (a + b) // 2
                        at = self._dates(path, lay, [mid])[0]
                        below = at < value if edge == "first" else at <= value
                        a, b = (mid + 1, b) if below else (a, mid)
                    first, last = (a, last) if edge == "first" else (first, a)
        return first, last

    def partitions(self) -> list[_Range]:
        out = []
        for path in self.paths:
            lay = layout(path)
            whole = min(lay.count, (os.path.getsize(path) - lay.start) // lay.size)
            first, last = self._bounds(path, lay, max(0, self.first), whole if self.last is None else min(whole, int(self.last)))
            out += [_Range(path, k, min(k + self.together, last)) for k in range(first, last, self.together)]
        return out or [_Range("", 0, 0)]

    def read(self, part: _Range):
        if not part.path:
            return
        lay = layout(part.path)
        step = max(1, (1 << 24) // lay.size)
        with open(part.path, "rb") as f:
            for at in range(part.first, part.last, step):
                f.seek(lay.start + at * lay.size)
                rows = np.frombuffer(f.read(min(step, part.last - at) * lay.size), lay.kind)
                p, n = parameters(rows, lay), len(rows)
                row = np.arange(at, at + n)
                baseline = p["BASELINE"].astype(np.int32)
                keep = self._passing({"date": p["DATE"], "baseline": baseline, "row": row}, n)
                data = rows["data"][keep].astype(np.float32).reshape(int(keep.sum()), -1, rows["data"].shape[-1])
                none = np.zeros(n)
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(data[:, :, k]).ravel()), data.shape[1]).cast(pa.list_(pa.float32())) for k in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.path] * len(data)), pa.array(row[keep]), pa.array(p["DATE"][keep]), pa.array(baseline[keep]), *[pa.array(p[c][keep]) for c in ("UU", "VV", "WW")],
                     pa.array(p.get("SOURCE", none)[keep].astype(np.int32)), pa.array(p.get("INTTIM", none)[keep].astype(np.float32)), *lists],
                    names=[c.split()[0] for c in SCHEMA.split(", ")],
                )


class Uvfits(DataSource):
    """spark.read.format("uvfits").load(paths, comma-separated): a row per group, its array flattened with the complex axis taken apart.

    Options: rows (in a partition), istart and iend (rows). A file cut short gives its whole groups.
    """

    @classmethod
    def name(cls) -> str:
        return "uvfits"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def read_uvfits(spark: SparkSession, path: str, **options) -> DataFrame:
    """Filters on date, baseline and row reach the files: ranges of rows are cut to what can pass, the rest is tested before it becomes rows."""
    spark.dataSource.register(Uvfits)
    spark.conf.set(PUSHDOWN, "true")
    return spark.read.format("uvfits").options(**options).load(path)


def time_blocks(vis: DataFrame, nt: int, baselines: int, keep_short: bool = False) -> DataFrame:
    """vis with t (integration from 0, as row div baselines) and blk (t div nt); a last block with fewer than nt integrations goes.

    baselines is the number of groups of an integration, the same throughout a file.
    """
    timed = vis.withColumn("t", F.expr(f"row div {baselines}")).withColumn("blk", F.expr(f"t div {nt}"))
    if keep_short:
        return timed
    whole = timed.groupBy("file", "blk").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == nt * baselines)
    return timed.join(F.broadcast(whole.drop("_n")), ["file", "blk"])  # a row for each block


def _card(key: str, value: str | float | int | bool) -> bytes:
    text = f"'{value:<8}'" if isinstance(value, str) else ("T" if value else "F") if isinstance(value, bool) else repr(value)
    return f"{key:<8}= {text:>20}".ljust(CARD).encode() if not isinstance(value, str) else f"{key:<8}= {text}".ljust(CARD).encode()


def group_bytes(columns: dict[str, np.ndarray], data: np.ndarray, date_zero: float) -> bytes:
    """A whole file: parameters by name (UU, VV, WW, DATE, BASELINE, SOURCE, INTTIM) and data (rows, chan, pol, 3). DATE is split into a whole zero and two parts."""
    names = ["UU", "VV", "WW", "DATE", "DATE", "BASELINE", "SOURCE", "INTTIM"]
    part = columns["DATE"] - date_zero
    coarse = part.astype(np.float32)
    values = {**columns, "DATE": coarse}
    fine = (part - coarse).astype(np.float32)
    shape = (1, 1, 1, *data.shape[1:])
    rows = np.zeros(len(data), np.dtype([("p", ">f4", (len(names),)), ("data", ">f4", shape)]))
    for k, name in enumerate(names):
        rows["p"][:, k] = fine if k == 4 else values[name]
    rows["data"] = data.reshape(len(data), *shape)
    cards = [("SIMPLE", True), ("BITPIX", -32), ("NAXIS", 7), ("NAXIS1", 0), ("NAXIS2", 3), ("NAXIS3", data.shape[2]), ("NAXIS4", data.shape[1]), ("NAXIS5", 1), ("NAXIS6", 1), ("NAXIS7", 1), ("GROUPS", True), ("PCOUNT", len(names)), ("GCOUNT", len(rows))]
    for k, name in enumerate(names, 1):
        cards += [(f"PTYPE{k}", name), (f"PSCAL{k}", 1.0), (f"PZERO{k}", float(date_zero) if k == 4 else 0.0)]
    head = b"".join(_card(*c) for c in cards) + b"END".ljust(CARD)
    pad = lambda b, fill: b + fill * (-len(b) % BLOCK)
    return pad(head, b" ") + pad(rows.tobytes(), b"\0")
