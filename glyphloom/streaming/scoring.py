"""Scoring and counting of text streams."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import OOV, PAD, lines, sliding
from ..operators.ngram import NgramModel
from ..operators.ocr import fits, local_table
from ..operators.score import metrics
from ..ship import ship


def perplexity_stream(texts: DataFrame, id_col: str, col: str, model: NgramModel) -> DataFrame:
    """texts with ``ppl``, unpadded: a stateless map, so it runs on streams as on tables.

    The model's tables go to the workers, after a check of their size. A larger model scores a table by joins; a stream
    of texts then needs ``perplexity_batches``.
    """
    if not fits(model):
        if texts.isStreaming:
            raise ValueError("the model is too large for a stateless map; use perplexity_batches")
        return texts.select(id_col, col).join(metrics(texts, id_col, col, model).select(id_col, "ppl"), id_col, "left")
    ship(texts.sparkSession)
    shared = texts.sparkSession.sparkContext.broadcast(local_table(model))
    n = model.n

    @F.pandas_udf("double")
    def ppl(values: pd.Series) -> pd.Series:
        table = shared.value

        def one(text):
            if text is None or len(text) < n:
                return None
            # an unseen character is the out-of-vocabulary one, as in score.metrics
            text = "".join(c if c in table.unigram else OOV for c in text)
            bits = sum(table.log2(text[k - n + 1 : k], text[k]) for k in range(n - 1, len(text)))
            return 2 ** (-bits / (len(text) - n + 1))

        return values.map(one)

    return texts.select(id_col, col).withColumn("ppl", ppl(col))


def perplexity_batches(texts: DataFrame, id_col: str, col: str, model: NgramModel, write: Callable[[DataFrame, int], None]):
    """A stream's writer that scores each micro-batch by joins, for models of any size; ``write`` takes (id, n, acc, ppl) and the batch's number."""
    return texts.select(id_col, col).writeStream.foreachBatch(lambda batch, number: write(metrics(batch, id_col, col, model), number))


def count_stream(texts: DataFrame, id_col: str, col: str, n: int) -> DataFrame:
    """Running counts of windows of n characters of padded lines, for update or complete output."""
    rows = lines(texts, id_col, col).where("line <> ''")
    padded = F.concat(F.lit(PAD), F.col("line"), F.lit(PAD))
    return sliding(rows, [], padded, n).select(F.col("w").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("cnt"))
