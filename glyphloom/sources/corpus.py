"""Corpora, models, vocabularies, configurations and progress: where they are read from and written to."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text
from ..operators.ngram import NgramModel, build


def read_files(spark: SparkSession, path: str, pattern: str = "*.txt", recursive: bool = False) -> DataFrame:
    """(file, text): whole UTF-8 files of a folder. Recursive scans leave out what lies in a .git folder."""
    reader = spark.read.option("pathGlobFilter", pattern)
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    rows = reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    return rows.where(~F.col("file").contains("/.git/"))


def read_lines(spark: SparkSession, path: str, pattern: str = "*.txt", recursive: bool = False) -> DataFrame:
    """(file, line_no, line), order explicit; the newline at a file's end starts no line."""
    body = F.regexp_replace("text", "\n$", "")
    return read_files(spark, path, pattern, recursive).select("file", F.posexplode(F.split(body, "\n")).alias("line_no", "line"))


def slice_lines(lines: DataFrame, start: int, count: int) -> DataFrame:
    """Lines start to start + count of each file."""
    return lines.where(F.col("line_no").between(start, start + count - 1))


def chunks(lines: DataFrame, size: int) -> DataFrame:
    """Lines with the number of their chunk of ``size`` lines."""
    return lines.withColumn("chunk", F.floor(F.col("line_no") / size).cast("long"))


def unfinished(lines: DataFrame, start: int) -> DataFrame:
    """Files that still have lines from ``start`` on."""
    return lines.groupBy("file").agg(F.max("line_no").alias("last")).where(F.col("last") >= start).select("file")


def one_line(text: str = "text"):
    """A text as one version of a pair: tabs are blanks, trailing white space goes."""
    return F.regexp_replace(F.translate(text, "\t", " "), r"\s+$", "")


def write_labelled(rows: DataFrame, path: str, line: str = "line", label: str = "label") -> None:
    """``text \\t {label}`` lines, in the order of line_no."""
    rows.orderBy("line_no").select(F.concat(line, F.lit("\t{"), label, F.lit("}"))).write.text(path)


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line, label) of ``text \\t {label}`` lines."""
    rows = read_lines(spark, path, "*")
    part = F.split("line", "\t")
    return rows.select("file", "line_no", part[0].alias("line"), F.regexp_extract(part[1], r"\{(\d)\}", 1).alias("label"))


def save_model(model: NgramModel, path: str) -> None:
    """The counts and the order; the derived tables are made again on loading."""
    model.ngram.withColumn("order", F.lit(model.n)).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> NgramModel:
    rows = spark.read.parquet(path)
    return build(rows.drop("order"), rows.select(F.max("order")).first()[0])


def save_words(lines: DataFrame, path: str) -> None:
    """Counts of words, and of word parts after hyphens and after dashes, as three tables."""
    counted = lambda rows, name: rows.groupBy(name).agg(F.count(F.lit(1)).alias("cnt"))
    counted(text.words(lines), "word").write.mode("overwrite").parquet(f"{path}/words")
    for name, pattern in (("hyphen", text.HYPHEN_SUFFIX), ("dash", text.DASH_SUFFIX)):
        counted(text.suffixes(lines, pattern), "suffix").write.mode("overwrite").parquet(f"{path}/{name}_suffixes")


def load_words(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables of ``save_words``."""
    words, hyphen, dash = (spark.read.parquet(f"{path}/{name}") for name in ("words", "hyphen_suffixes", "dash_suffixes"))
    return words, hyphen, dash


def encoder_json(ids: DataFrame, norms: DataFrame) -> str:
    """The vocabulary's state: [codes by normal form, width of a feature vector, known characters]."""
    codes = {r["norm"]: r["id"] for r in ids.collect()}
    keys = sorted(r["ch"] for r in norms.join(F.broadcast(ids), "norm", "left_semi").select("ch").collect())
    return json.dumps([codes, len(codes) + 8, keys], ensure_ascii=False)


def read_encoder(spark: SparkSession, state: str) -> DataFrame:
    """(norm, id) of a saved vocabulary."""
    codes, _, _ = json.loads(state)
    return spark.createDataFrame(sorted(codes.items()), "norm string, id long")


@dataclass
class RunConfig:
    """A training run: its name, files, slice and segment lengths, model settings."""

    name: str
    files: list[str]
    lines_per_iteration: int = 10_000
    most_lines_a_segment: int = 8
    models: list[dict] = field(default_factory=list)


def read_config(text: str) -> RunConfig:
    """A YAML configuration; unknown keys, and a missing name or files, are errors."""
    import yaml

    found = yaml.safe_load(text) or {}
    unknown = set(found) - set(RunConfig.__dataclass_fields__)
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    if "name" not in found or "files" not in found:
        raise ValueError("name and files are needed")
    return RunConfig(**found)


PROGRESS = "run string, model string, iteration int, start long, next_start long, loss double, acc double, perpl double, train_secs long, proc_chars long, proc_words long"


def append_progress(rows: DataFrame, path: str) -> None:
    """Appends the iterations that are not there yet, so that a repeated call adds nothing."""
    spark = rows.sparkSession
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        rows = rows.join(spark.read.schema(PROGRESS).parquet(path), ["run", "model", "iteration"], "left_anti")
    rows.write.mode("append").parquet(path)


def resume_points(progress: DataFrame) -> DataFrame:
    """(run, model, iteration, next_start, proc_chars): where each model goes on."""
    total = F.sum("proc_chars").over(W.partitionBy("run", "model").orderBy("iteration"))
    last = F.row_number().over(W.partitionBy("run", "model").orderBy(F.desc("iteration")))
    return progress.withColumn("proc_chars", total).withColumn("_last", last).where("_last = 1").select("run", "model", "iteration", "next_start", "proc_chars")
