"""URL allow and block rules by a sort-merge range join (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import lower_ascii, salts

RULE_SCHEMA = "verdict string, host string, path string"
#: The hosts of one top-level domain are dealt into parts, by the number of pages; each part gets that domain's rules.
PAGES_A_SALT = 100_000


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty if it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = lower_ascii(F.regexp_extract(rest, "^[^/?#]*", 0))
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """``a.example.net`` -> ``net.example.a.``: a host's subdomains are the keys that its key begins."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A rule list of the caller's as a table, by SQL literals."""
    if not rules:
        return spark.sql("SELECT '' AS verdict, '' AS host, '' AS path WHERE false")
    quoted = ", ".join("(" + ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in r) + ")" for r in rules)
    return spark.sql(f"SELECT * FROM VALUES {quoted} AS r(verdict, host, path)")


def boundaries(rules: DataFrame) -> DataFrame:
    """(key, stack): from each key on, in key order, these rules are active.

    A rule's interval runs from its host key up to that key with the final dot raised to the next
    character. Intervals nest or are apart, so at an opening the stack is the rule's enclosing rules
    with its own host's, at a closing the enclosing ones alone.
    """
    own = rules.where("host IS NOT NULL AND host <> ''").select(host_key(lower_ascii(F.col("host"))).alias("key"), lower_ascii(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").distinct()
    entry = F.struct(F.length(F.concat("host", "path")).alias("size"), F.length("host").alias("host_size"), F.concat("host", "path").alias("rule"), "path", "verdict")
    keys = own.select("key").distinct()
    labels = F.split(F.rtrim(F.col("key"), F.lit(".")), r"\.")
    outer = keys.withColumn("labels", labels).select("key", F.explode(F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: F.concat(F.array_join(F.slice(F.col("labels"), F.lit(1), i), "."), F.lit(".")))).alias("outer_key"))
    chain = outer.join(own.select(F.col("key").alias("outer_key"), entry.alias("entry")), "outer_key")
    stacks = chain.groupBy("key").agg(F.collect_list("entry").alias("inside"), F.collect_list(F.when(F.col("outer_key") != F.col("key"), F.col("entry"))).alias("outside"))
    opened = stacks.select("key", F.col("inside").alias("stack"))
    closed = stacks.select(F.concat(F.expr("substring(key, 1, length(key) - 1)"), F.lit("/")).alias("key"), F.col("outside").alias("stack"))
    return opened.unionByName(closed)


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", n_salts: int | None = None) -> DataFrame:
    """One row per page: id, host, path, rule (null if none fits), verdict.

    Distinct hosts and the rules' interval boundaries are sorted together by reversed-host key within
    (top-level domain, salt); a running window carries the stack of active nested rules to each
    host. A page then takes, of its host's stack, the longest rule whose path its own begins with;
    ties go to the longer host, then the greater text and verdict. Rules of a null or empty host fit nothing.
    Null, empty and odd urls have empty parts and the default verdict. Repeated pages give repeated rows.
    """
    n_salts = n_salts or salts(pages.count(), PAGES_A_SALT)
    host, path = split_url(F.col(url_col))
    parts = pages.select(F.col(id_col).alias(id_col), host.alias("host"), path.alias("path"))
    hosts = parts.where("host <> ''").select("host").distinct().select("host", host_key(F.col("host")).alias("key"))
    edges = boundaries(rules)
    top = F.regexp_extract("key", "^[^./]*", 0)
    points = hosts.select(top.alias("top"), F.pmod(F.xxhash64("host"), F.lit(n_salts)).cast("int").alias("salt"), "key", "host", F.lit(None).cast(edges.schema["stack"].dataType).alias("stack"))
    marks = edges.select(top.alias("top"), F.explode(F.sequence(F.lit(0), F.lit(n_salts - 1))).alias("salt"), "key", F.lit(None).cast("string").alias("host"), "stack")
    sweep = W.partitionBy("top", "salt").orderBy("key", F.col("host").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    active = marks.unionByName(points).withColumn("active", F.last("stack", ignorenulls=True).over(sweep))
    active = active.where(F.col("host").isNotNull() & (F.size("active") > 0)).select("host", "active")
    best = F.array_max(F.filter("active", lambda r: F.col("path").startswith(r["path"])))
    judged = parts.join(active, "host", "left").withColumn("best", best)
    return judged.select(id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
