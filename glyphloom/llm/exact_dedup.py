"""Exact dedup by a log-structured merge index over content digests (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch

#: Bits of the hit filter as powers of two: eight bits or more for each hit, up to 2**28 bits or 32 MB, the bound of its
#: broadcast. With more than 2**25 hits it lets more single rows through, which the join then finds to be alone.
LEAST_BITS, MOST_BITS = 15, 28
#: A bitmap of Spark's bitmap_construct_agg covers so many bits.
BITMAP = 32_768


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def filter_bits(hits: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, (8 * hits).bit_length()))


def _slot(digest: Column, bits: int) -> Column:
    return F.shiftright(F.xxhash64(digest), 64 - bits) + F.lit(1 << (bits - 1))


def hit_filter(digests: DataFrame, bits: int) -> DataFrame:
    """(bucket, bits) of at most 2**bits / 32768 rows of 4 KB: one bit for each digest's slot."""
    slot = _slot(F.col("digest"), bits)
    return digests.groupBy(F.floor(slot / BITMAP).cast("int").alias("bucket")).agg(F.bitmap_construct_agg((slot % BITMAP).cast("long")).alias("bits"))


def may_hit(df: DataFrame, filled: DataFrame, bits: int, column: str = "digest") -> DataFrame:
    """df with ``maybe``: false only if the row's digest is certainly not in the filter."""
    slot = _slot(F.col(column), bits)
    keyed = df.withColumn("bucket", F.floor(slot / BITMAP).cast("int")).withColumn("_bit", (slot % BITMAP).cast("int"))
    byte = F.conv(F.hex(F.substring("bits", F.floor(F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    test = F.expr("power(2, _bit % 8)").cast("int")
    return keyed.join(F.broadcast(filled), "bucket", "left").withColumn("maybe", F.coalesce(byte.bitwiseAND(test) != 0, F.lit(False))).drop("bucket", "bits", "_bit")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", digest=sha256, memtable_rows: int = 200_000, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: the id, keep_id, group_size, kept, digest.

    1. Memtables: rows are dealt into runs of about ``memtable_rows``; each is reduced to one entry per
       digest and flushed as a sorted run whose Parquet pages carry Bloom filters on the digest.
    2. Compaction merges the runs, keeping the smallest (and largest) identifier and the count.
    3. Digests with a count over one make a hit filter, sized by their number up to a bound. Rows outside the filter are
       alone and never leave their task. The rest are written once; the text of the row that stays joins its index entry (by
       digest and id, so no group meets in one task), and every hit is compared with it byte for byte, in a join that
       nothing needs grouped, so that a large group can be split. Rows that differ in spite of equal digests are
       grouped anew by their whole text.

    Null and empty texts are equal. Null ids lose against any id; among rows that repeat both id and
    text one stays. ``keep`` is "smallest" or "largest" id. Other columns are left out, so their names
    cannot clash, but for those of ``carry``, which come with each row. An empty table gives no rows.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    spark = docs.sparkSession
    scratch = Scratch(spark, "lsm")
    # a carried text travels as the body it is
    others = {c: f"_c{k}" for k, c in enumerate(carry) if c != text_col}
    flags = [F.col(text_col).isNull().alias("_null")] if text_col in carry else []
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"), *flags, *(F.col(c).alias(a) for c, a in others.items()))
    extra = [*(["_null"] if flags else []), *others.values()]
    more = [*(["body"] if flags else []), *extra]
    rows = rows.withColumn("digest", digest(F.col("body")))
    n_runs = max(1, -(-docs.count() // memtable_rows))
    flushed = (
        rows.select("id", "digest", F.pmod(F.xxhash64("id", "digest"), F.lit(n_runs)).cast("int").alias("run"))
        .repartition(n_runs, "run")
        .groupBy("run", "digest")
        .agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("n"))
        .sortWithinPartitions("run", "digest")
    )
    runs = scratch.keep(flushed, "run", **{"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.expected.ndv#digest": str(memtable_rows)})
    merged = runs.groupBy("digest").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
    stays = F.col("low" if keep == "smallest" else "high").alias("stays")
    hits = scratch.keep(merged.where("n > 1").select("digest", stays, "n").sortWithinPartitions("digest"), "level", **{"parquet.bloom.filter.enabled#digest": "true"})
    scratch.drop(runs)

    bits = filter_bits(hits.count())
    marked = may_hit(rows, hit_filter(hits.select("digest"), bits), bits)
    alone = marked.where(~F.col("maybe"))
    maybe = scratch.keep(marked.where("maybe").select("id", "digest", "body", *extra), "maybe")
    entry = hits.select(F.col("digest").alias("_digest"), "stays", "n")
    model = maybe.join(entry, (F.col("digest") == F.col("_digest")) & F.col("id").eqNullSafe(F.col("stays"))).groupBy("digest").agg(F.max("body").alias("model"))
    index = scratch.keep(entry.join(model, F.col("digest") == F.col("_digest")).drop("digest"), "index")
    other = F.when(F.col("body") != F.col("model"), F.col("body")).alias("other")
    compared = scratch.keep(maybe.join(index, F.col("digest") == F.col("_digest"), "left").select("id", "digest", "stays", "n", other, *more), "verified")
    scratch.drop(maybe, index)

    near_alone, found = compared.where("n IS NULL"), compared.where("n IS NOT NULL")
    if found.where("other IS NOT NULL").limit(1).count():
        edge = F.min if keep == "smallest" else F.max
        groups = found.groupBy("digest", "other").agg(edge("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).withColumnsRenamed({"digest": "_digest", "other": "_other"})
        found = found.join(groups, (F.col("digest") == F.col("_digest")) & F.col("other").eqNullSafe(F.col("_other")))
    else:
        found = found.withColumn("keep_id", F.col("stays")).withColumn("group_size", F.col("n"))
    chosen = F.col("id").eqNullSafe(F.col("keep_id"))
    lost = found.where(~chosen).withColumn("kept", F.lit(False))
    first = F.row_number().over(W.partitionBy("digest", "other", "id").orderBy(F.lit(1))) == 1
    won = found.where(chosen).withColumn("kept", first)
    single = [F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept")]
    out = ["id", "keep_id", "group_size", "kept", "digest", *more]
    all_rows = alone.select("id", *single, "digest", *more)
    for part in (near_alone.select("id", *single, "digest", *more), lost.select(*out), won.select(*out)):
        all_rows = all_rows.unionByName(part)
    text = F.when(~F.col("_null"), F.col("body"))
    return all_rows.select(F.col("id").alias(id_col), *out[1:5], *(text.alias(c) if c == text_col else F.col(others[c]).alias(c) for c in carry))
