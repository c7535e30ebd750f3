"""Corpus pipeline: five stages over ``documents``, each a table that the next one reads.

STAGES are (name, function of (spark, docs, sf_dir)); all but the last return the columns of
``documents``. Which rows go: those judged toxic; of equal texts all but the smallest doc_id; of each component
of near duplicates all but the smallest doc_id; those that hold a benchmark item. The last stage packs the rest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom.llm import decontaminate, exact_dedup, packing, simhash, toxicity
from glyphloom.llm.common import Scratch, free_name

#: Words of a shingle, and the Jaccard similarity of a near copy.
SHINGLE, SIMILARITY = 5, 0.8
#: Documents go from the score on from which op8 predicts label 1.
TOXIC = toxicity.TOXIC


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fits on the labelled documents of its input and keeps those under TOXIC.

    Null and empty texts have no words and the score that such a text gets; each row is judged by its own text, so null and
    repeated ids are no matter. An empty table gives no rows; other columns, whatever their names, come through.
    """
    scorer = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = free_name(docs, "_toxic")
    return toxicity.score(docs, scorer, out=name).where(F.col(name) < TOXIC).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of equal texts the row with the smallest doc_id.

    A null text is an empty one, a null id loses against any other, and of rows that repeat id and text one stays.
    """
    names = {c: f"v_{c}" for c in docs.columns}
    kept = exact_dedup.dedup(docs.withColumnsRenamed(names), names["doc_id"], names["text"], keep="smallest", carry=tuple(v for c, v in names.items() if c != "doc_id"))
    return kept.where("kept").withColumnsRenamed({v: c for c, v in names.items()}).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that with the smallest doc_id, of each component of the pairs with a Jaccard similarity
    of SIMILARITY or more of their five-word shingles.

    Rows are told apart by id and text: null ids come last, ids may repeat, and of rows that repeat both one stays.
    Null and empty texts are alike.
    """
    return simhash.drop_near_copies(docs, shingle=SHINGLE, similarity=SIMILARITY).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops every document with a stretch of words within a fifth of a benchmark item's length in edits.

    Each row is judged by its own text, so null and repeated ids are no matter; null and empty texts stay.
    """
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 1024 tokens.

    Null and empty texts are one token; null ids stay null; repeated rows are packed each; other columns are left out.
    """
    return packing.pack(docs, window=1024)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack),
]

#: A trained score, a fingerprint of 64 hashed bits and token ids have no SQL; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES):
        after = stage(spark, docs, sf_dir)
        if at == len(STAGES) - 1:
            return after
        docs, before = scratch.keep(after, name.replace(" ", "_")), docs
        scratch.drop(before)
    return docs
