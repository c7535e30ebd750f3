"""Reproducible passage sampling."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample_passages(lines: DataFrame, id_col: str, probability: float, min_length: int = 300, seed: int = 222) -> DataFrame:
    """(id, start_line, passage) in shuffled order: a line starts a passage with the given probability, by a hash of (id,
    line, seed), and takes the lines after it until it has ``min_length`` characters or the document ends."""
    draw = F.pmod(F.xxhash64(id_col, "line_no", F.lit(seed)), F.lit(1_000_000)) < int(probability * 1_000_000)
    per_doc = lines.withColumn("starts", draw).groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("line_no", "line", "starts"))).alias("ls"))
    per_doc = per_doc.select(id_col, F.col("ls.line_no").alias("numbers"), F.col("ls.line").alias("lines"), F.col("ls.starts").alias("starts"))

    def run(batches):
        for batch in batches:
            out: list[tuple[int, int, str]] = []
            for k, (numbers, texts, starts) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True)):
                first, held, size = None, [], 0
                for number, text, begins in zip(numbers, texts, starts, strict=True):
                    if first is None and not begins:
                        continue
                    first = number if first is None else first
                    held.append(text + "\n")
                    size += len(text) + 1
                    if size >= min_length:
                        out.append((k, first, "".join(held)))
                        first, held, size = None, [], 0
                if first is not None:
                    out.append((k, first, "".join(held)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([r[0] for r in out], pa.int64())), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.string())], names=[id_col, "start_line", "passage"])

    found = per_doc.mapInArrow(run, per_doc.select(id_col).schema.add("start_line", "integer").add("passage", "string"))
    return found.orderBy(F.xxhash64(id_col, "start_line", F.lit(seed + 1)))
