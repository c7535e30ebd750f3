"""Smoothed multi-order character models as aggregate tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.charset import char_counts, output_ids, replace_unknown
from ..functions.text import PAD, sliding
from ..storage import kept


def ngram_counts(texts: DataFrame, col: str, n: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, n, gram, ctx, last, cnt): occurrences of every string of up to n characters in the padded texts.

    One window of up to n characters per position is counted first; only distinct windows are spread over
    their suffixes. One table serves both directions: a backward count is the count of the reversed gram.
    """
    padded = F.concat(F.lit(PAD), F.col(col), F.lit(PAD))
    wide = sliding(texts.where(F.col(col).isNotNull()), list(by), padded, n, heads=n - 1)
    wide = wide.groupBy(*by, "w").agg(F.count(F.lit(1)).alias("c"))
    suffix = wide.select(*by, F.explode(F.transform(F.sequence(F.lit(1), F.length("w")), lambda k: F.substring(F.col("w"), -k, k))).alias("gram"), "c")
    counted = suffix.groupBy(*by, "gram").agg(F.sum("c").alias("cnt"))
    return counted.select(*by, F.length("gram").alias("n"), "gram", F.expr("left(gram, length(gram) - 1)").alias("ctx"), F.expr("right(gram, 1)").alias("last"), "cnt")


@dataclass
class NgramModel:
    """ngram: counts; unigram (ch, p); bigram (a, c, p) over all pairs; contexts (ctx, k, d, best)."""

    n: int
    ngram: DataFrame
    unigram: DataFrame
    bigram: DataFrame
    contexts: DataFrame

    def alphabet(self) -> list[str]:
        """The characters that the model has seen: at most one for each code point."""
        return sorted(r["ch"] for r in self.unigram.select("ch").collect())


def build(ngram: DataFrame, n: int) -> NgramModel:
    """The model's derived tables.

    After a context x of two or more characters, c has weight cnt(xc), or if that is 0 the smoothed bigram
    B(last(x), c); the weights sum to d(x) = sum cnt(xc) + 1 - sum B(last(x), c) over the c seen, so the
    distribution over the whole alphabet is never spread out.
    """
    ngram = kept(ngram, "grams")
    one = ngram.where("n = 1").select(F.col("gram").alias("ch"), "cnt")
    total = one.agg(F.sum("cnt").alias("total"))
    unigram = one.crossJoin(F.broadcast(total)).select("ch", (F.col("cnt") / F.col("total")).alias("p"))
    # the alphabet is a set of characters, so both sides of the product are small
    pairs = unigram.select(F.col("ch").alias("a")).crossJoin(unigram.select(F.col("ch").alias("c"), "p"))
    seen = ngram.where("n = 2").select(F.col("ctx").alias("a"), F.col("last").alias("c"), "cnt")
    weight = pairs.join(seen, ["a", "c"], "left").withColumn("w", F.coalesce(F.col("cnt").cast("double"), F.col("p")))
    bigram = weight.select("a", "c", (F.col("w") / F.sum("w").over(W.partitionBy("a"))).alias("p"))
    bigram = kept(bigram, "bigrams")
    top = lambda v: F.max_by("last", F.struct(v, -F.ascii("last")))
    cont = ngram.where("n > 2").withColumn("a", F.expr("right(ctx, 1)")).join(bigram.select("a", F.col("c").alias("last"), "p"), ["a", "last"])
    longer = cont.groupBy("ctx").agg((F.sum("cnt") + 1 - F.sum("p")).alias("d"), top(F.col("cnt")).alias("best"))
    exists = ngram.where((F.col("n") >= 2) & (F.col("n") < n)).select(F.col("gram").alias("ctx"), F.expr("right(gram, 1)").alias("a"))
    best_after = bigram.groupBy("a").agg(F.max_by("c", F.struct("p", -F.ascii("c"))).alias("best_a"))
    longer = exists.join(longer, "ctx", "left").join(best_after, "a").select("ctx", F.length("ctx").alias("k"), F.coalesce("d", F.lit(1.0)).alias("d"), F.coalesce("best", "best_a").alias("best"))
    single = best_after.select(F.col("a").alias("ctx"), F.lit(1).alias("k"), F.lit(1.0).alias("d"), F.col("best_a").alias("best"))
    empty = unigram.agg(F.max_by("ch", F.struct("p", -F.ascii("ch"))).alias("best")).select(F.lit("").alias("ctx"), F.lit(0).alias("k"), F.lit(1.0).alias("d"), "best")
    contexts = (longer.unionByName(single) if n > 1 else longer.limit(0)).unionByName(empty)
    return NgramModel(n, ngram, unigram, bigram, contexts)


def train(texts: DataFrame, col: str, n: int, rare: int | None = None) -> NgramModel:
    """The model of texts. ``rare``: characters of at most a share of 1 / 10**rare count as the out-of-vocabulary character,
    as they then do wherever the model scores."""
    if rare is not None:
        texts = mask_rare(texts, col, rare)
    return build(ngram_counts(texts, col, n), n)


def mask_rare(texts: DataFrame, col: str, rare: int) -> DataFrame:
    """texts with every character of at most a share of 1 / 10**rare replaced by the out-of-vocabulary character."""
    counts = char_counts(sliding(texts, [], F.col(col), 1).select(F.col("w").alias("ch")))
    return replace_unknown(texts, col, [r["ch"] for r in output_ids(counts, rare).select("ch").collect()], col)


def cond_prob(ngram: DataFrame) -> DataFrame:
    """(gram, p): the unsmoothed share of a gram among those with its context."""
    return ngram.select("n", "gram", (F.col("cnt") / F.sum("cnt").over(W.partitionBy("n", "ctx"))).alias("p"))


def back_off(grams: DataFrame, model: NgramModel, gram: str = "gram") -> DataFrame:
    """grams with ctx_used, k and best: the longest suffix of the context that the model has seen."""
    distinct = grams.select(F.expr(f"left(`{gram}`, length(`{gram}`) - 1)").alias("full")).distinct()
    longest = F.least(F.length("full"), F.lit(model.n - 1))
    tried = distinct.select("full", F.explode(F.transform(F.sequence(F.lit(0), longest), lambda k: F.when(k == 0, "").otherwise(F.substring("full", -k, k)))).alias("ctx"))
    known = tried.join(model.contexts, "ctx").groupBy("full").agg(F.max(F.struct("k", "ctx", "d", "best")).alias("m"))
    known = known.select("full", F.col("m.ctx").alias("ctx_used"), F.col("m.k").alias("k"), F.col("m.d").alias("d"), F.col("m.best").alias("best"))
    return grams.withColumn("full", F.expr(f"left(`{gram}`, length(`{gram}`) - 1)")).join(known, "full").drop("full")


def estimate(grams: DataFrame, model: NgramModel, gram: str = "gram") -> DataFrame:
    """grams with p, the smoothed probability of the last character, k and best. Characters never seen have no p: the
    scores of texts give them the least probability."""
    backed = back_off(grams, model, gram).withColumn("t", F.expr(f"right(`{gram}`, 1)")).withColumn("a", F.expr("right(ctx_used, 1)"))
    counts = model.ngram.where("n > 2").select(F.col("ctx").alias("ctx_used"), F.col("last").alias("t"), "cnt")
    joined = backed.join(counts, ["ctx_used", "t"], "left").join(model.bigram.select("a", F.col("c").alias("t"), F.col("p").alias("b")), ["a", "t"], "left").join(model.unigram.select(F.col("ch").alias("t"), F.col("p").alias("u")), "t", "left")
    p = F.when(F.col("k") == 0, F.col("u")).when(F.col("k") == 1, F.col("b")).otherwise(F.coalesce(F.col("cnt").cast("double"), F.col("b")) / F.col("d"))
    return joined.withColumn("p", p).drop("ctx_used", "a", "t", "cnt", "b", "u", "d")


def distribution(contexts_df: DataFrame, model: NgramModel, ctx: str = "ctx") -> DataFrame:
    """(ctx, ch, p, k) over the whole alphabet, for few contexts."""
    probe = contexts_df.select(ctx).distinct().select(F.col(ctx).alias("ctx"), F.concat(F.col(ctx), F.lit("x")).alias("gram"))
    backed = back_off(probe, model).select("ctx", "ctx_used", "k", "d").withColumn("a", F.expr("right(ctx_used, 1)"))
    dense = backed.crossJoin(F.broadcast(model.unigram.select("ch", F.col("p").alias("u"))))
    counts = model.ngram.where("n > 2").select(F.col("ctx").alias("ctx_used"), F.col("last").alias("ch"), "cnt")
    joined = dense.join(counts, ["ctx_used", "ch"], "left").join(model.bigram.select("a", F.col("c").alias("ch"), F.col("p").alias("b")), ["a", "ch"], "left")
    p = F.when(F.col("k") == 0, F.col("u")).when(F.col("k") == 1, F.col("b")).otherwise(F.coalesce(F.col("cnt").cast("double"), F.col("b")) / F.col("d"))
    return joined.select("ctx", "ch", p.alias("p"), "k")


def predict_next(contexts_df: DataFrame, model: NgramModel, m: int, ctx: str = "ctx") -> DataFrame:
    """(ctx, rank, ch, p): the m most likely next characters, ties by code point."""
    rank = F.row_number().over(W.partitionBy("ctx").orderBy(F.desc("p"), F.ascii("ch")))
    return distribution(contexts_df, model, ctx).withColumn("rank", rank).where(F.col("rank") <= m).select("ctx", "rank", "ch", "p")
