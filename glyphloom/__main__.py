"""Command line: ``python -m glyphloom COMMAND ...``. Inputs and outputs are paths that Spark reads and writes."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import charset, text
from .operators import dehyphen, evaluate, ngram, ocr, sample, score
from .sources import corpus


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return corpus.read_lines(spark, path, "*", recursive=True)


def _write(df: DataFrame, out: str | None) -> None:
    if out is None:
        df.show(1_000, truncate=False)
    else:
        df.write.mode("overwrite").parquet(out)


def train(spark, a):
    corpus.save_model(ngram.train(_lines(spark, a.corpus).where("line <> ''"), "line", a.order, a.rare), a.out)


def encode(spark, a):
    counts = charset.char_counts(text.chars(_lines(spark, a.corpus), "file"))
    ids = charset.input_ids(counts, charset.feature_table(spark, counts), a.least)
    norms = charset.feature_table(spark, counts).select("ch", "norm")
    print(corpus.encoder_json(ids, norms))


def score_texts(spark, a):
    model = corpus.load_model(spark, a.model)
    rows = corpus.read_files(spark, a.texts, "*")
    _write(score.metrics(rows, "file", "text", model, a.padded), a.out)


def entropy(spark, a):
    forward = corpus.load_model(spark, a.model)
    backward = ngram.build(score.reversed_counts(forward.ngram), forward.n)
    rows = score.bidirectional(corpus.read_files(spark, a.texts, "*"), "file", "text", forward, backward, a.combine)
    total = rows.groupBy("file").agg(F.sum("h_bits").alias("sum_bits"), F.sum("h_nats").alias("sum_nats"), F.count_if(F.col("best") != F.col("target")).alias("errors"))
    _write(score.prediction_table(rows, "file") if a.table else total, a.out)


def merge(spark, a):
    one = lambda path: corpus.read_files(spark, path, "*").select(corpus.one_line().alias("v"))
    pairs = one(a.first).withColumnRenamed("v", "a").crossJoin(one(a.second).withColumnRenamed("v", "b")).select(F.lit("pair").alias("pair_id"), "a", "b")
    _write(ocr.merge(pairs, corpus.load_model(spark, a.model), log=a.log), a.out)


def best(spark, a):
    _write(evaluate.extract_best(_lines(spark, a.log).withColumnRenamed("file", "log_id")), a.out)


def choices(spark, a):
    part = F.split("line", "\t")
    _write(evaluate.choice_confusion(_lines(spark, a.choices).select(part[0].alias("answer"), part[1].alias("correct"))), a.out)


def passages(spark, a):
    _write(sample.sample_passages(_lines(spark, a.corpus), "file", a.probability, a.least), a.out)


def words(spark, a):
    corpus.save_words(_lines(spark, a.corpus), a.out)


def rules(spark, a):
    counts, _, _ = corpus.load_words(spark, a.words)
    texts = corpus.read_files(spark, a.texts, "*")
    own = text.words(texts, "text").groupBy("word").agg(F.count(F.lit(1)).alias("cnt"))
    mode = "eol" if a.end_of_line else "strict" if a.strict else "loose"
    _write(dehyphen.rewrite_by_rules(texts, "file", "text", counts, spark.read.text(a.lexicon).withColumnRenamed("value", "word"), own, mode, a.strict or a.end_of_line), a.out)


def variants(spark, a):
    forward = corpus.load_model(spark, a.model)
    spots = dehyphen.hyphen_contexts(corpus.read_files(spark, a.texts, "*"), "file", "text", a.context)
    _write(dehyphen.by_perplexity(spots, "file", forward, ngram.build(score.reversed_counts(forward.ngram), forward.n)), a.out)


def baseline(spark, a):
    _write(dehyphen.trivial(_lines(spark, a.texts)), a.out)


def wrap(spark, a):
    _write(dehyphen.wrap_lines(corpus.read_files(spark, a.texts, "*"), "file", "text", a.maxlength), a.out)


def report(spark, a):
    gold, pred = (corpus.read_labelled(spark, p).select("line_no", F.col("label").alias(n)) for p, n in ((a.gold, "gold"), (a.pred, "pred")))
    rows = evaluate.evaluation_rows(gold.join(pred, "line_no"))
    counts = evaluate.confusion(rows)
    counts.show(100)
    _write(evaluate.report(counts), a.out)


def summary(spark, a):
    _write(evaluate.train_summary(spark.read.parquet(a.progress)), a.out)


def query(spark, a):
    from .plans.catalogue import QUERIES

    _write(QUERIES[a.name](spark, a.tables), a.out)


#: command -> (function, arguments as (name, options))
COMMANDS = {
    "train": (train, [("corpus", {}), ("out", {}), ("--order", {"type": int, "default": 5}), ("--rare", {"type": int})]),
    "encode": (encode, [("corpus", {}), ("--least", {"type": int, "default": 1000})]),
    "score": (score_texts, [("model", {}), ("texts", {}), ("--padded", {"action": "store_true"}), ("--out", {})]),
    "entropy": (entropy, [("model", {}), ("texts", {}), ("--combine", {"default": "product", "choices": sorted(score.COMBINE)}), ("--table", {"action": "store_true"}), ("--out", {})]),
    "merge": (merge, [("model", {}), ("first", {}), ("second", {}), ("--log", {"action": "store_true"}), ("--out", {})]),
    "best": (best, [("log", {}), ("--out", {})]),
    "choices": (choices, [("choices", {}), ("--out", {})]),
    "passages": (passages, [("corpus", {}), ("probability", {"type": float}), ("--least", {"type": int, "default": 300}), ("--out", {})]),
    "words": (words, [("corpus", {}), ("out", {})]),
    "rules": (rules, [("words", {}), ("lexicon", {}), ("texts", {}), ("--strict", {"action": "store_true"}), ("--end-of-line", {"action": "store_true"}), ("--out", {})]),
    "variants": (variants, [("model", {}), ("texts", {}), ("--context", {"type": int, "default": 15}), ("--out", {})]),
    "baseline": (baseline, [("texts", {}), ("--out", {})]),
    "wrap": (wrap, [("texts", {}), ("--maxlength", {"type": int, "default": 40}), ("--out", {})]),
    "report": (report, [("gold", {}), ("pred", {}), ("--out", {})]),
    "summary": (summary, [("progress", {}), ("--out", {})]),
    "query": (query, [("name", {}), ("tables", {}), ("--out", {})]),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="glyphloom", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    for name, (run, arguments) in COMMANDS.items():
        one = commands.add_parser(name, help=run.__doc__)
        for argument, options in arguments:
            one.add_argument(argument, **options)
        one.set_defaults(run=run)
    return top


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    a.run(SparkSession.builder.appName("glyphloom").getOrCreate(), a)


if __name__ == "__main__":
    main()
