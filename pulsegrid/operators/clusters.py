"""Groups of candidates: connected components, friends of friends, density clusters."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming.blocks import shared_folder
from .candidates import overlap_pairs, points


def cut(df: DataFrame) -> DataFrame:
    """df.checkpoint() in the session's shared folder; where none is set, a temporary one on a local master, an error elsewhere."""
    context = df.sparkSession.sparkContext
    if not df.sparkSession.conf.get("spark.checkpoint.dir", None) and not context.getCheckpointDir():
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b. Per node: node, label (the smallest node it reaches). Labels hop to their label's label, so rounds grow as the log of a chain."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    moved = not labels.isEmpty()
    while moved:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("m"))
        low = cut(labels.join(near, labels.node == near.a).select("node", F.least("label", "m").alias("low"), F.col("label").alias("was")))
        hop = low.select(F.col("node").alias("low"), F.col("low").alias("next"))
        after = cut(low.join(hop, "low").select("node", F.col("next").alias("label"), (F.col("next") < F.col("was")).alias("moved")))
        moved, labels = not after.filter("moved").isEmpty(), after.select("node", "label")
    return labels


def friends_of_friends(cand: DataFrame, reach: int = 32, idt_reach: int = 20, width: int = 64) -> DataFrame:
    """Candidates that come within reach in time and idt_reach in idt are merged into their bounding box, boxes likewise, until none do.

    beam, rid and sn of the strongest (ties: smaller rid), t0, t1, i0, i1, ncands. A candidate starts as a
    point. Which boxes end up together does not depend on the order of merging, so a round merges whole connected
    components, found in rounds that grow with the log of a chain; only boxes that have grown make another round.
    """
    box = cut(points(cand))
    while True:
        pairs = cut(overlap_pairs(box, reach, idt_reach, width))
        if pairs.isEmpty():
            return box
        named = box.join(components(pairs), F.col("rid") == F.col("node"), "left").withColumn("g", F.coalesce("label", "rid"))
        best = F.max(F.struct("sn", (-F.col("rid")).alias("r"))).alias("m")
        merged = named.groupBy("beam", "g").agg(best, F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.min("i0").alias("i0"), F.max("i1").alias("i1"), F.sum("ncands").alias("ncands"))
        box = cut(merged.select("beam", (-F.col("m.r")).alias("rid"), F.col("m.sn").alias("sn"), "t0", "t1", "i0", "i1", "ncands"))


def strongest_of_clusters(cand: DataFrame, clusters: DataFrame) -> DataFrame:
    """Of each density cluster (rid, cluster) its strongest candidate, ties by rid."""
    met = cand.join(clusters.select("rid", "cluster"), "rid")
    top = met.groupBy("cluster").agg(F.max(F.struct("sn", (-F.col("rid")).alias("r"))).alias("m"), F.count(F.lit(1)).alias("n"))
    return top.select("cluster", (-F.col("m.r")).alias("rid"), F.col("m.sn").alias("sn"), "n")


def _pairs(beam: np.ndarray, t: np.ndarray, other: list[np.ndarray], rid: np.ndarray, eps: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows i < j of one beam and different rid within eps, a batch for each step from i to j; rows are in order of beam, then t."""
    i, step = np.arange(len(t)), 1
    while len(i := i[i + step < len(t)]):
        i = i[(beam[i + step] == beam[i]) & (t[i + step] - t[i] <= eps)]  # what is apart at one step is so at the next
        j = i + step
        near = sum((x[i] - x[j]) ** 2 for x in (t, *other)) <= eps * eps
        near &= rid[i] != rid[j]
        yield i[near], j[near]
        step += 1


def _in_block(rows: pd.DataFrame, lo: int, hi: int, eps: int, least: int) -> pd.DataFrame:
    """Clusters of the times lo to hi, of rows up to 2 eps around them: rid, label (the smallest core rid reached among rows within eps), core, own (of these times), rim (within eps of other blocks' times)."""
    rows = rows.sort_values(["beam", "sampno"], kind="stable")
    beam, t, rid = (rows[c].to_numpy() for c in ("beam", "sampno", "rid"))
    names, node = np.unique(rid, return_inverse=True)
    first = np.full(len(names), np.iinfo(np.int64).max)
    np.minimum.at(first, node, t)
    other = [x.astype(np.result_type(x, np.int64)) for x in (rows["boxcar"].to_numpy(), rows["dm"].to_numpy())]
    pairs = lambda: _pairs(beam, t, other, rid, eps)
    count = np.ones(len(names), np.int64)
    for i, j in pairs():
        count += np.bincount(node[i], minlength=len(names)) + np.bincount(node[j], minlength=len(names))
    whole = (first >= lo - eps) & (first < hi + eps)  # all of its neighbours are here
    core, own, label = whole & (count >= least), (first >= lo) & (first < hi), np.arange(len(names))
    met = [np.zeros((2, 0), int)]  # border rows' nodes, and labels beside them
    for i, j in pairs():
        a, b = node[i], node[j]
        a, b = a[core[a] & core[b]], b[core[a] & core[b]]
        while len(a := a[apart := label[a] != label[b]]):
            b = b[apart]
            np.minimum.at(label, np.maximum(label[a], label[b]), np.minimum(label[a], label[b]))
            while (up := label[label] != label).any():
                label[up] = label[label[up]]
    for i, j in pairs():
        for a, b in ((node[i], node[j]), (node[j], node[i])):
            at = core[a] & ~core[b] & own[b]
            met.append(np.stack([b[at], label[a[at]]]))
        if sum(m.shape[1] for m in met) > 4 * len(t):
            met = [np.unique(np.concatenate(met, axis=1), axis=1)]
    border, to = np.unique(np.concatenate(met, axis=1), axis=1)
    mine = np.flatnonzero(core)
    rim = (first < lo + eps) | (first >= hi - eps)
    return pd.DataFrame({
        "rid": names[np.concatenate([mine, border])], "label": names[np.concatenate([label[mine], to])], "core": np.repeat([True, False], [len(mine), len(border)]),
        "own": np.concatenate([own[mine], np.ones(len(border), bool)]), "rim": np.concatenate([rim[mine], np.zeros(len(border), bool)]),
    })


def density_clusters(cand: DataFrame, eps: int, least: int, width: int = 4096) -> DataFrame:
    """DBSCAN by beam over (sampno, boxcar, dm): rid, cluster (smallest core rid reached), core. Noise goes; a border point takes its smallest neighbour cluster.

    Rows are shuffled once, by block of ``width`` times with 2 eps of the neighbours', and a task clusters a block; no pair of rows leaves it.
    Clusters that reach over the end of a block are joined by the rows within eps of it, so only these are shuffled again. Rows may share a rid
    (also across beams), but then lie at one time.
    """
    spark, wide = cand.sparkSession, max(width, 4 * eps)
    point = cand.select("beam", "rid", "sampno", "boxcar", "dm").dropna()
    blocks = F.sequence(F.floor((F.col("sampno") - 2 * eps) / wide), F.floor((F.col("sampno") + 2 * eps) / wide))
    run = lambda key, rows: _in_block(rows, int(key[0]) * wide, (int(key[0]) + 1) * wide, eps, least)
    kind = point.schema["rid"].dataType.simpleString()
    local, schema = f"{shared_folder(spark)}/blocks", f"rid {kind}, label {kind}, core boolean, own boolean, rim boolean"
    point.withColumn("_b", F.explode(blocks)).groupBy("_b").applyInPandas(run, schema).write.parquet(local)
    local = spark.read.schema(schema).parquet(local)
    over = components(local.filter("rim and label <> rid").select(F.col("label").alias("a"), F.col("rid").alias("b")))
    found = local.filter("own").join(over.select(F.col("node").alias("label"), F.col("label").alias("_low")), "label", "left").select("rid", F.coalesce("_low", "label").alias("cluster"), "core")
    border = found.filter("not core").groupBy("rid").agg(F.min("cluster").alias("cluster"))
    return found.filter("core").unionByName(border.withColumn("core", F.lit(False)))
