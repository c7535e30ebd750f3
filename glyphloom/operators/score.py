"""Scoring texts with character models: accuracy, perplexity, entropy, predictions, filters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.charset import replace_unknown
from ..functions.text import PAD, slices, sliding
from ..ship import ship
from ..storage import kept
from .ngram import NgramModel, build, distribution, estimate, ngram_counts

#: Least probability in a logarithm.
FLOOR = 1e-13
#: Windows of up to so many characters are one number; up to so many different ones go to the workers with their scores.
PACKED, MOST_WINDOWS = 3, 2_000_000
#: A noncharacter, which no text holds.
FILL = "\uffff"


def masked(texts: DataFrame, col: str, model: NgramModel) -> DataFrame:
    """texts with every character that the model has not seen replaced by the out-of-vocabulary character."""
    return replace_unknown(texts, col, model.alphabet(), col)


def positions(texts: DataFrame, id_col: str, col: str, n: int, padded: bool = False) -> DataFrame:
    """(id, pos, gram): every window of n characters; padded: also the shorter ones from the start on."""
    if not padded:
        return sliding(texts, [id_col], F.col(col), n).select(id_col, F.col("start").cast("int").alias("pos"), F.col("w").alias("gram"))
    rows = sliding(texts, [id_col], F.concat(F.lit(PAD), F.col(col), F.lit(PAD)), n, heads=n - 1).where((F.length("w") > 1) | F.lit(n == 1))
    pos = F.when(F.col("start") < 0, F.length("w") - 2).otherwise(F.col("start") + n - 2)
    return rows.select(id_col, pos.cast("int").alias("pos"), F.col("w").alias("gram")).where("pos >= 0")


def score(texts: DataFrame, id_col: str, col: str, model: NgramModel, padded: bool = False) -> DataFrame:
    """(id, pos, target, p, best, k) at every position. Distinct windows are scored once and joined back. Characters that
    the model has not seen are the out-of-vocabulary character, with the least probability if the model has not seen that either."""
    at = positions(texts, id_col, col, model.n, padded)
    return at.join(_known(at, model), "gram").select(id_col, "pos", F.expr("right(masked, 1)").alias("target"), _least("p").alias("p"), "best", "k")


def metrics(texts: DataFrame, id_col: str, col: str, model: NgramModel, padded: bool = False) -> DataFrame:
    """(id, n, acc, ppl) of each text. Counts of distinct windows are aggregated before the model is joined; short windows that
    are not too many are scored once and sent to the texts instead, of which no window is then shuffled.
    Unseen characters as in ``score``."""
    if not padded and model.n <= PACKED:
        ship(texts.sparkSession)
        rows = texts.select(id_col, col)
        different = rows.select(col).mapInArrow(_windows(model.n), "gram string").distinct()
        different = kept(different, "windows")
        if different.count() <= MOST_WINDOWS:
            return _sums(rows, id_col, _known(different, model), model.n)
    # written, since the model meets the different windows and then every row meets its window
    at = kept(positions(texts, id_col, col, model.n, padded).groupBy(id_col, "gram").agg(F.count(F.lit(1)).alias("times")), "windows")
    rows = at.join(_known(at, model), "gram")
    return _metrics(rows, [id_col], _least("p"), F.col("best") == F.expr("right(masked, 1)"), F.col("times"))


def _codes(values, n: int):
    """(code, row) of every window of n characters of a text column."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = np.asarray(pc.fill_null(pc.utf8_length(values), 0)).astype(np.int64)
    chars = np.frombuffer("".join(v for v in values.to_pylist() if v).encode("utf-32-le"), "<u4").astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    start = np.flatnonzero(np.arange(len(chars)) + n <= np.cumsum(sizes)[row])
    code = np.zeros(len(start), np.int64)
    for k in range(n):
        code = code << 21 | chars[start + k]
    return code, row[start]


def _windows(n: int):
    """Texts -> the different windows of n characters of each slice."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in slices(batches, 0):
            found = np.unique(_codes(batch.column(0), n)[0]).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(["".join(chr(c >> 21 * k & 0x1FFFFF) for k in range(n - 1, -1, -1)) for c in found], pa.string())], names=["gram"])

    return run


def _sums(rows: DataFrame, id_col: str, known: DataFrame, n: int) -> DataFrame:
    """``metrics`` of (id, text) by a table of all their windows' scores, which goes to the workers."""
    import numpy as np

    hit = F.coalesce(F.col("best") == F.expr("right(masked, 1)"), F.lit(False))
    scored = known.select("gram", F.log2(_least("p")).alias("bits"), hit.alias("hit")).toArrow()
    code = np.concatenate([_codes(part, n)[0] for part in scored.column(0).chunks] or [np.zeros(0, np.int64)])
    order = np.argsort(code)
    shared = rows.sparkSession.sparkContext.broadcast((code[order], np.asarray(scored.column(1))[order], np.asarray(scored.column(2)).astype(float)[order]))

    def run(batches):
        import pyarrow as pa

        code, bits, hit = shared.value
        for batch in slices(batches, 1):
            mine, row = _codes(batch.column(1), n)
            at, m = np.searchsorted(code, mine), batch.num_rows
            made = pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.bincount(row, minlength=m), pa.int64()), *(pa.array(np.bincount(row, v[at], m)) for v in (hit, bits))], names=[id_col, "n", "hits", "bits"])
            yield made.filter(pa.array(np.bincount(row, minlength=m) > 0))

    parts = rows.mapInArrow(run, rows.select(id_col).schema.add("n", "long").add("hits", "double").add("bits", "double"))
    total = F.sum("n")
    return parts.groupBy(id_col).agg(total.cast("long").alias("n"), (F.sum("hits") / total).alias("acc"), F.pow(F.lit(2.0), -F.sum("bits") / total).alias("ppl"))


def _known(at: DataFrame, model: NgramModel) -> DataFrame:
    """(gram, masked, p, k, best) of each different window; masking those is the same as masking the texts."""
    distinct = replace_unknown(at.select("gram").distinct(), "gram", model.alphabet(), "masked")
    return estimate(distinct, model, "masked")


def _least(p: str) -> Column:
    return F.greatest(F.coalesce(p, F.lit(0.0)), F.lit(FLOOR))


def _metrics(rows: DataFrame, by: list[str], p: Column, hit: Column, times: Column) -> DataFrame:
    n = F.sum(times)
    return rows.groupBy(*by).agg(
        n.cast("long").alias("n"),
        (F.sum(F.coalesce(hit, F.lit(False)).cast("long") * times) / n).alias("acc"),
        F.pow(F.lit(2.0), -F.sum(F.log2(p) * times) / n).alias("ppl"),
    )


def score_backward(texts: DataFrame, id_col: str, col: str, model: NgramModel, padded: bool = False) -> DataFrame:
    """Scores with a model of reversed texts, whose counts ``reversed_counts`` gives without a second training."""
    return score(texts.withColumn(col, F.reverse(col)), id_col, col, model, padded)


def reversed_counts(ngram: DataFrame) -> DataFrame:
    """The counts of the reversed texts: the same counts under reversed grams."""
    return ngram.select("n", F.reverse("gram").alias("gram"), F.expr("left(reverse(gram), n - 1)").alias("ctx"), F.expr("left(gram, 1)").alias("last"), "cnt")


COMBINE: dict[str, Callable[[Column, Column], Column]] = {
    "product": lambda f, b: f * b,
    "max": lambda f, b: F.greatest(f, b),
    "sum": lambda f, b: f + b,
    "harmonic": lambda f, b: F.when(f + b > 0, 2 * f * b / (f + b)).otherwise(0.0),
}


def bidirectional(texts: DataFrame, id_col: str, col: str, forward: NgramModel, backward: NgramModel, combine: str | Callable[[Column, Column], Column] = "product", padded: bool = False) -> DataFrame:
    """(id, pos, target, p, best, h_bits, h_nats): both contexts of every position, combined and normalised.

    Unpadded: only positions with n - 1 characters on both sides, and a text without any is an error of the
    caller's, not a row. Padded: every character of the text. The distribution is spread over the alphabet once per
    distinct pair of contexts.
    """
    f = COMBINE[combine] if isinstance(combine, str) else combine
    left, right = forward.n - 1, backward.n - 1
    texts = masked(texts, col, forward)
    # beyond the padding a noncharacter fills the windows up, and goes when they are taken apart
    text = F.concat(F.lit(FILL * (left - 1) + PAD), F.col(col), F.lit(PAD + FILL * (right - 1))) if padded else F.col(col)
    rows = sliding(texts, [id_col], text, left + 1 + right)
    whole = lambda c: F.translate(c, FILL, "")
    rows = rows.select(id_col, F.col("start").cast("int").alias("pos"), F.substring("w", left + 1, 1).alias("target"), whole(F.substring("w", 1, left)).alias("lctx"), F.reverse(whole(F.substring("w", left + 2, right))).alias("rctx"))
    pairs = rows.select("lctx", "rctx").distinct()
    pf = distribution(pairs, forward, "lctx").select(F.col("ctx").alias("lctx"), "ch", F.col("p").alias("pf"))
    pb = distribution(pairs, backward, "rctx").select(F.col("ctx").alias("rctx"), "ch", F.col("p").alias("pb"))
    both = pairs.join(pf, "lctx").join(pb, ["rctx", "ch"]).withColumn("w", f(F.col("pf"), F.col("pb")))
    dist = both.withColumn("p", F.col("w") / F.sum("w").over(W.partitionBy("lctx", "rctx")))
    entropy = -F.sum(F.col("p") * F.log2(F.greatest("p", F.lit(FLOOR))))
    summary = dist.groupBy("lctx", "rctx").agg(F.max_by("ch", F.struct(F.round("p", 12), -F.ascii("ch"))).alias("best"), F.max("p").alias("best_p"), entropy.alias("h_bits"))
    target = dist.select("lctx", "rctx", F.col("ch").alias("target"), "p")
    joined = rows.join(summary, ["lctx", "rctx"]).join(target, ["lctx", "rctx", "target"], "left")
    return joined.select(id_col, "pos", "target", "p", "best", "best_p", "h_bits", (F.col("h_bits") * F.lit(0.6931471805599453)).alias("h_nats"))


def bidirectional_metrics(scored: DataFrame, id_col: str) -> DataFrame:
    return _metrics(scored, [id_col], _least("p"), F.col("best") == F.col("target"), F.lit(1))


def bidirectional_next(contexts: DataFrame, forward: NgramModel, backward: NgramModel, m: int = 1, combine: str | Callable[[Column, Column], Column] = "product") -> DataFrame:
    """(left_ctx, right_ctx, rank, ch, p): the m likeliest characters between two contexts, read from left to right, ties by code point."""
    f = COMBINE[combine] if isinstance(combine, str) else combine
    pairs = contexts.select("left_ctx", "right_ctx").distinct().withColumn("_r", F.reverse("right_ctx"))
    pf = distribution(pairs, forward, "left_ctx").select(F.col("ctx").alias("left_ctx"), "ch", F.col("p").alias("pf"))
    pb = distribution(pairs, backward, "_r").select(F.col("ctx").alias("_r"), "ch", F.col("p").alias("pb"))
    both = pairs.join(pf, "left_ctx").join(pb, ["_r", "ch"]).withColumn("w", f(F.col("pf"), F.col("pb")))
    own = W.partitionBy("left_ctx", "right_ctx")
    ranked = both.withColumn("p", F.col("w") / F.sum("w").over(own)).withColumn("rank", F.row_number().over(own.orderBy(F.desc(F.round("p", 12)), F.ascii("ch"))))
    return ranked.where(F.col("rank") <= m).select("left_ctx", "right_ctx", "rank", "ch", "p")


def generate(starts: DataFrame, id_col: str, col: str, model: NgramModel, length: int) -> DataFrame:
    """(id, text): each start continued by ``length`` likeliest characters, one round over all starts for each."""
    now = starts.select(id_col, F.col(col).alias("text"))
    for _ in range(length):
        asked = now.withColumn("gram", F.concat("text", F.lit("x")))
        after = estimate(asked.select("gram").distinct(), model).select("gram", "best")
        now = kept(asked.join(after, "gram").select(id_col, F.concat("text", "best").alias("text")), "generated")
    return now


def prediction_table(scored: DataFrame, id_col: str) -> DataFrame:
    """(id, pos, ch, best, best_p, entropy, status): one row per character; best only where it differs."""
    show = lambda c: F.when(F.col(c) == " ", "␣").otherwise(F.col(c))
    right = F.col("best") == F.col("target")
    return scored.select(id_col, "pos", show("target").alias("ch"), F.when(right, "").otherwise(show("best")).alias("best"), F.round("best_p", 4).alias("best_p"), F.round("h_nats", 4).alias("entropy"), F.when(right, "OK").otherwise("ERR!").alias("status"))


def likely(dist: DataFrame, least: float = 0.001) -> DataFrame:
    """The rows of a distribution above a probability."""
    return dist.where(F.col("p") > least)


def garbage_filter(texts: DataFrame, id_col: str, col: str, model: NgramModel, min_length: int = 9, most: float = 5.0) -> DataFrame:
    """texts of at least ``min_length`` characters and a perplexity under ``most``, with n, acc and ppl."""
    long = texts.where(F.length(col) >= min_length)
    return long.join(metrics(long, id_col, col, model), id_col).where(F.col("ppl") < most)


def train_by(texts: DataFrame, by: str, col: str, n: int) -> dict[str, NgramModel]:
    """One model for each value of a column of few values; one pass counts for all of them."""
    counts = kept(ngram_counts(texts, col, n, by=(by,)), "grams_by")
    values = [r[0] for r in counts.select(by).distinct().orderBy(by).collect()]
    return {v: build(counts.where(F.col(by) == v).drop(by), n) for v in values}


def identify(texts: DataFrame, id_col: str, col: str, models: dict[str, NgramModel]) -> DataFrame:
    """(id, label, ppl): the label whose model is least perplexed; characters a model never saw count as the floor."""
    parts = None
    for label, model in models.items():
        one = metrics(texts, id_col, col, model).select(id_col, "ppl", F.lit(label).alias("label"))
        parts = one if parts is None else parts.unionByName(one)
    return parts.groupBy(id_col).agg(F.min_by("label", F.struct("ppl", "label")).alias("label"), F.min("ppl").alias("ppl"))
