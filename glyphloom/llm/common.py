"""Helpers shared by the operators of this folder: shared storage, dense numbering, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..storage import shared_dir


class Scratch:
    """Written intermediate tables of one operator call, under the shared folder.

    A table cuts lineage and survives lost executors. ``drop`` frees one whose successor is written; what is
    left, since a lazy result may still read it, goes when the driver's JVM ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.paths, self.made = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", {}, 0
        self._fs(self.root)[1].deleteOnExit(self._fs(self.root)[0])

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        self.made += 1
        return f"{self.root}/{name}-{self.made}"

    def keep(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        path = self.path(name)
        df.write.options(**options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def hold(self, df: DataFrame) -> DataFrame:
        """df, computed once and held on the executors' disks until ``drop``, for tables that live briefly: no file is
        created in the shared folder, each of which costs the executor the launch of two or three processes (Hadoop's chmod). A
        lost block is made again, so df must come out the same each time. Plans over a held table hold its own, so tables that build on
        one another are better written."""
        out = df.persist(StorageLevel.DISK_ONLY)
        self.paths[id(out)] = (None, out)
        return out

    def tables(self) -> list[DataFrame]:
        return [table for _, table in self.paths.values()]

    def drop(self, *tables: DataFrame, collect: bool = True) -> None:
        """Deletes tables. Spark's cleaner then frees the shuffle files of writes that have ended, whose plans only the
        driver's garbage still holds, and the last one's its scheduler, until another job comes. What the driver's JVM has freed
        goes back to the system."""
        for table in tables:
            path, held = self.paths.pop(id(table), (None, None))
            if held is not None and not path:
                held.unpersist()
            if path:
                where, fs = self._fs(path)
                fs.delete(where, True)
        if collect:
            self.spark.range(1).collect()
            gc.collect()  # Python's handles on the plans go first
            self.spark._jvm.System.gc()
        trim(self.spark)


def trim(spark: SparkSession) -> None:
    """Gives native memory that the driver's JVM has freed back to the system, where the JVM can (HotSpot's jcmd command).

    Each plan is compiled in native memory, outside the heap. The allocator keeps what is freed there in pieces, so the driver
    grows by every plan of a long session.
    """
    java, new = spark._jvm.java, spark.sparkContext._gateway.new_array
    with contextlib.suppress(Py4JError):
        # by reflection, since Py4J finds no method of the server's own class, which is not public
        call = next(m for m in java.lang.Class.forName("javax.management.MBeanServerConnection").getMethods() if m.getName() == "invoke")
        args = new(java.lang.Object, 4)
        args[0], args[1] = spark._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        call.invoke(java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)


def salts(rows: int, per_salt: int = 20_000, least: int = 64) -> int:
    """How many salts keep a group of any size within per_salt rows a task."""
    return max(least, -(-rows // per_salt))


def numbered(df: DataFrame, by: list[str], order: list[str], out: str, n_salts: int) -> DataFrame:
    """Adds ``out``: 0, 1, 2 ... without gaps within each ``by`` group, however large a group is.

    df must be a written table. Rows are dealt by (by, salt of the order columns), numbered there, and
    shifted by the counts of the salts before; only those counts are ever sorted by group.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(n_salts)).cast("int"))
    counts = salted.groupBy(*by, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*by).orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    base = counts.select(*by, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    joined = salted.join(base.hint("merge"), [*by, "_salt"])
    at = F.row_number().over(W.partitionBy(*by, "_salt").orderBy(*order))
    return joined.withColumn(out, F.col("_base") + at - 1).drop("_base", "_salt")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root): the smallest node reachable over edges (a, b), for nodes that have an edge.

    Alternates the large-star and small-star steps until nothing changes; each round is one written table of links, so no
    node's neighbours are ever gathered in one row, and hubs only meet in aggregates and joins. A round's shuffle files go with its table:
    each has a file or three for every task, however few the links.
    """
    now = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        with_low = large.join(low, "a")
        small = with_low.select("a", F.col("m").alias("b")).unionByName(with_low.select(F.col("b").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
        after = scratch.keep(small, "links")
        # the count and two independent sums of hashes tell whether the set of links changed
        state = after.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
        scratch.drop(now)
        now = after
        if state == seen:
            break
        seen = state
    own = now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return own.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its tree) for every other node of the components of edges (a, b)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, two = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(one):
        x, y = label[one], label[two]
        apart = x != y
        one, two, x, y = one[apart], two[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    on = label != np.arange(len(nodes))
    return nodes[on], nodes[label[on]]


def contracted(edges: DataFrame, most: int = 500_000) -> DataFrame:
    """Edges (a, b) with the components of ``edges``, a table that is held or written: about ``most`` at a time become a spanning
    forest, which has fewer edges than nodes, however often a large group's members were linked."""
    n = edges.count()

    def trees(batches):
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if held:
            yield pa.record_batch([pa.array(v) for v in forest(*(np.concatenate(x) for x in zip(*held, strict=True)))], names=["a", "b"])
        release()

    return edges.coalesce(max(1, -(-n // most))).mapInArrow(trees, "a long, b long")


_KEPT: dict[str, dict] = {}


def kept(owner: str) -> dict:
    """What a worker keeps from task to task, of one owner at a time: workers live on, and what an earlier operator left would
    stand beside the tables of the next one."""
    if owner not in _KEPT:
        had = any(_KEPT.values())
        _KEPT.clear()
        if had:
            release()
    return _KEPT.setdefault(owner, {})


def parts(batches, column: int, most: int = 2 << 20, owner: str = ""):
    """The rows of Arrow batches in parts of about ``most`` bytes of a text column, which bounds a worker's memory; one
    text is never divided. What others than ``owner`` keep in this worker goes first. When the rows are over the worker gives free
    memory back, since it lives on for other stages."""
    kept(owner)
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64) + 16
        part = np.cumsum(size) // most
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]).tolist()
        for s, e in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            yield batch.slice(s, e - s)
    release()


def release() -> None:
    """Gives memory that Python has freed back to the system, where its allocator can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until df has no such column in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def lower_ascii(text: Column | str) -> Column:
    """A-Z to lower case, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
