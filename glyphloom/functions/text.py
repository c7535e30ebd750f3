"""Lines, characters, segments and words of text tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Padding, out-of-vocabulary, start, end and mask characters.
PAD, OOV, START, END, MASK = "\u0000", "\u0001", "\u0002", "\u0003", "\u0005"
#: What divides words, and what counts as one.
WORD_SPLIT = r"(?U)[\s\p{Pe}\p{Pf}\p{Pi}\p{Po}\p{Ps}]+"
WORD = r"^\p{L}+(\p{Pd}\p{L}*){0,2}$"
HYPHEN_SUFFIX = r"(?U)\p{L}+\p{Pd}(\p{Ll}{2,})\W"
DASH_SUFFIX = r"(?U)\p{L}+ \p{Pd} (\p{Ll}{2,})\W"


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, line_no, line) with explicit order; empty lines are kept, null texts have no lines."""
    return docs.where(F.col(text_col).isNotNull()).select(id_col, *keep, F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"))


def chars(lines_df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, line_no, pos, ch), pos from 1 within the line."""
    split = F.filter(F.split("line", ""), lambda c: c != "")
    return lines_df.select(id_col, "line_no", F.posexplode(split).alias("pos", "ch")).withColumn("pos", F.col("pos") + 1)


def words(lines_df: DataFrame, col: str = "line") -> DataFrame:
    """One row per word: pieces between white space and punctuation that are letters with at most two dashed parts."""
    return lines_df.select(F.explode(F.split(col, WORD_SPLIT)).alias("word")).where(F.col("word").rlike(WORD))


def suffixes(lines_df: DataFrame, pattern: str, col: str = "line") -> DataFrame:
    """Lower-case word parts after a hyphen or a dash between blanks."""
    return lines_df.select(F.explode(F.regexp_extract_all(col, F.lit(pattern), F.lit(1))).alias("suffix"))


def normalise_blanks(text: Column | str) -> Column:
    return F.regexp_replace(F.trim(text), "[\t ]+", " ")


#: Texts are cut into pieces of so many characters before windows are taken, since finding a character's place walks the text.
PIECE = 128


def sliding(df: DataFrame, keep: list[str], text: Column | str, size: int, heads: int = 0) -> DataFrame:
    """keep and (start, w): every window of ``size`` characters, start from 0; work grows with the text, not its square.

    heads: also the windows of 1 to ``heads`` characters that begin the text, with start -1.
    """
    cut = rf"(?s)(?=(.{{1,{PIECE + size - 1}}})).{{1,{PIECE}}}"
    pieces = df.select(*keep, F.posexplode(F.regexp_extract_all(text, F.lit(cut), F.lit(1))).alias("_k", "_piece"))
    n = F.length("_piece")
    # places from 1 on are whole windows; those up to 0 stand for the beginnings of the text, 0 for the longest
    places = F.when(n >= size, F.sequence(F.lit(1), n - (size - 1)))
    if heads:
        places = F.when(F.col("_k") == 0, F.sequence(F.lit(1 - heads), F.greatest(n - (size - 1), F.least(n - heads, F.lit(0))))).otherwise(places)
    rows = pieces.select(*keep, "_k", "_piece", F.explode(places).alias("_i"))
    start, w = F.col("_k").cast("long") * PIECE + F.col("_i") - 1, F.substring(F.col("_piece"), F.col("_i"), F.lit(size))
    if heads:
        start, w = F.when(F.col("_i") > 0, start).otherwise(F.lit(-1).cast("long")), F.when(F.col("_i") > 0, w).otherwise(F.substring(F.col("_piece"), F.lit(1), F.col("_i") + heads))
    return rows.select(*keep, start.alias("start"), w.alias("w"))


def slices(batches, column: int, most: int = 2 << 20):
    """The rows of Arrow batches in slices of about ``most`` bytes of a text column, which bounds a worker's Python objects; one text
    is never divided. When the rows are over the worker gives free memory back."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        if batch.num_rows:
            size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64) + 16
            part = np.cumsum(size) // most
            starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]).tolist()
            for s, e in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                yield batch.slice(s, e - s)
    pa.default_memory_pool().release_unused()


def segments(lines_df: DataFrame, id_col: str = "doc_id", most: int = 4, seed: int = 222) -> DataFrame:
    """(id, seg_no, seg): runs of 1 to ``most`` lines, a length being as likely as it is large, newlines kept inside.

    The length that a line would start comes from a hash of (id, line, seed), so runs are reproducible; each document's
    lines are walked once.
    """
    total = most * (most + 1) // 2
    draw = F.pmod(F.xxhash64(id_col, "line_no", F.lit(seed)), F.lit(total)) + 1
    length = F.lit(1)
    for k in range(1, most):
        length = F.when(draw > k * (k + 1) // 2, F.lit(k + 1)).otherwise(length)
    rows = lines_df.withColumn("want", length.cast("int"))
    per_doc = rows.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("line_no", "line", "want"))).alias("ls"))
    per_doc = per_doc.select(id_col, F.col("ls.line").alias("lines"), F.col("ls.want").alias("wants"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out: list[tuple[int, int, str]] = []
            for k, (lines, wants) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                at = no = 0
                while at < len(lines):
                    out.append((k, no, "\n".join(lines[at : at + wants[at]]).strip("\n")))
                    at, no = at + wants[at], no + 1
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([r[0] for r in out], pa.int64())), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.string())], names=[id_col, "seg_no", "seg"])

    return per_doc.mapInArrow(run, per_doc.select(id_col).schema.add("seg_no", "integer").add("seg", "string"))


def windows(df: DataFrame, keep: list[str], col: str, left: int, right: int) -> DataFrame:
    """keep and (pos, ch, left_ctx, right_ctx) of every character with its neighbours, padded at both ends; pos from 1."""
    rows = sliding(df, keep, F.concat(F.lit(PAD * left), F.col(col), F.lit(PAD * right)), left + 1 + right)
    part = lambda at, n: F.substring("w", at, n)
    return rows.select(*keep, (F.col("start") + 1).alias("pos"), part(left + 1, 1).alias("ch"), part(1, left).alias("left_ctx"), part(left + 2, right).alias("right_ctx"))
