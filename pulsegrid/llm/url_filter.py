"""URL block and allow rules by a sort-merge range join, DataFrame functions only.

A host becomes its labels in reverse order, each followed by a dot ("net.example."), so a rule for a
host and its subdomains covers one interval [prefix, prefix + 0xFF) of canonical keys; rule intervals
nest or are disjoint. The sweep turns them into open and close events that each carry the stack of
rules active from there on, sorts events and keys together by range, and reads for each key the last
event before it. Two sweeps run: over hosts (which rule hosts contain this host), then, within those
rule hosts, over paths (which path prefixes contain this path). The longest rule wins; of equally long
ones the more specific host, then the smaller string.

Only distinct hosts and (host, path) pairs are swept, so a hot host costs one row. A null url, or one
without "://", has empty host and path. A rule path must be a prefix of the url's path, so an empty
path fits only rules with an empty path. An empty table gives an empty result; other columns of the
input are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, ascii_lower_sql, materialize, shuffle_partitions, table

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def with_parts(pages: DataFrame, url_col: str) -> DataFrame:
    at = F.coalesce(F.instr(F.col(url_col), "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(F.col(url_col), at + 3, F.length(url_col))).otherwise(F.lit(""))
    return pages.withColumn("_rest", rest).withColumns(
        {"host": ascii_lower(F.regexp_extract("_rest", r"^([^/?#]*)", 1)), "path": F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1)}
    ).drop("_rest")


def reversed_host(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def sweep(prefixes: DataFrame, keys: DataFrame) -> DataFrame:
    """prefixes: distinct strings _p. keys: distinct strings _k. Returns each _k that lies in an interval, with _stack: the prefixes around it, outermost first."""
    spark = keys.sparkSession
    longer = prefixes.filter("length(_p) > 1").select("_p", F.explode(F.sequence(F.lit(1), F.length("_p") - 1)).alias("_i"))
    longer = longer.select("_p", F.expr("substring(_p, 1, _i)").alias("_a"))
    above = longer.join(prefixes.select(F.col("_p").alias("_a")), "_a").groupBy("_p").agg(F.sort_array(F.collect_set("_a")).alias("_above"))
    rules = prefixes.join(above, "_p", "left").withColumn("_above", F.coalesce("_above", F.array().cast("array<string>")))
    opened = rules.select(F.col("_p").cast("binary").alias("_key"), F.concat("_above", F.array("_p")).alias("_stack"))
    closed = rules.select(F.concat(F.col("_p").cast("binary"), F.lit(b"\xff")).alias("_key"), F.col("_above").alias("_stack"))
    none = F.lit(None)
    events = opened.unionByName(closed).select("_key", "_stack", none.cast("string").alias("_k"))
    wanted = keys.select(F.col("_k").cast("binary").alias("_key"), none.cast("array<string>").alias("_stack"), "_k")
    ranged = events.unionByName(wanted).repartitionByRange(shuffle_partitions(spark), "_key").withColumn("_part", F.spark_partition_id())
    ranged = materialize(ranged)  # so that both uses see the same ranges
    ends = ranged.filter("_stack is not null").groupBy("_part").agg(F.max_by("_stack", "_key").alias("_end"))
    parts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).join(ends, "_part", "left")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = materialize(parts.select("_part", F.last("_end", ignorenulls=True).over(before).alias("_carry")))  # a row per partition
    within = Window.partitionBy("_part").orderBy("_key", F.col("_k").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    swept = ranged.withColumn("_last", F.last("_stack", ignorenulls=True).over(within)).filter("_k is not null")
    found = swept.join(carry, "_part", "left").select("_k", F.coalesce("_last", "_carry").alias("_stack"))
    return found.filter("size(_stack) > 0")


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
) -> DataFrame:
    """rules: host, path, verdict. Returns page_id, host, path, rule, verdict, a row per row of pages."""
    urls = with_parts(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("_url")), "_url").drop("_url")
    rules = rules.select(ascii_lower(F.col("host")).alias("_h"), F.col("path").alias("_path"), F.col("verdict").alias("_verdict")).dropna()
    rules = rules.groupBy("_h", "_path").agg(F.min("_verdict").alias("_verdict")).withColumn("_rh", reversed_host(F.col("_h")))
    targets = materialize(urls.select("host", "path").distinct())
    hosts = targets.select("host").distinct().withColumn("_k", reversed_host(F.col("host")))
    in_hosts = sweep(rules.select(F.col("_rh").alias("_p")).distinct(), hosts.select("_k").distinct())
    host_rules = materialize(hosts.join(in_hosts, "_k").select("host", F.explode("_stack").alias("_rh")))
    pairs = materialize(targets.join(host_rules, "host").select("host", "path", "_rh"))
    path_key = lambda p: F.concat(F.col("_rh"), F.lit("\u0000"), F.col(p))
    keyed = pairs.withColumn("_k", path_key("path"))
    in_paths = sweep(rules.select(path_key("_path").alias("_p")), keyed.select("_k").distinct())
    top = in_paths.select("_k", F.element_at("_stack", -1).alias("_p"))
    ranked = top.join(rules.withColumn("_p", path_key("_path")), "_p").select(
        "_k", "_verdict", F.concat("_h", "_path").alias("_rule"), F.length("_h").alias("_hl")
    )
    ranked = materialize(ranked)
    order = F.struct(F.length("_rule").alias("a"), F.col("_hl").alias("b"))
    best = keyed.join(ranked, "_k").groupBy("host", "path").agg(F.max_by(F.struct("_rule", "_verdict"), order).alias("_best"))
    best = materialize(best.select("host", "path", "_best._rule", "_best._verdict"))
    return urls.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("_rule").alias("rule"), F.coalesce("_verdict", F.lit(default)).alias("verdict")
    )


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    rows = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(r, ("host", "path", "verdict"), strict=True)]) for r in rules])
    return spark.range(1).select(F.inline(rows))


def op1_url_filters(spark, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), rule_table(spark))


_CASES = [(f"{h}{p}", h, p, v) for h, p, v in RULES]
OP1_SQL = f"""
with r(rule, h, p, v) as (values {", ".join(str(c) for c in _CASES)}),
a as (select page_id, case when url is null or instr(url, '://') = 0 then '' else substr(url, instr(url, '://') + 3) end as rest from pages),
b as (select page_id, {ascii_lower_sql("regexp_extract(rest, '^([^/?#]*)', 1)")} as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from a),
c as (select host, path, arg_max(rule, length(rule)) as rule, arg_max(v, length(rule)) as v
      from (select distinct host, path from b) join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by all)
select page_id, b.host, b.path, c.rule, coalesce(c.v, 'allow') as verdict from b left join c on b.host = c.host and b.path = c.path
"""
