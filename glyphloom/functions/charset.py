"""Character vocabulary: counts, normal forms, features, dense ids, replacement of what is outside."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .text import OOV

#: Hungarian letters with marks of their own, and the long vowels among them.
OWN_MARKED = "áéíóúöőüű"
LONG = "áéíóúőű"
#: Long letters whose normal form keeps a short mark.
SHORTENED = {"ő": "ö", "ű": "ü"}
STROKE = " WITH STROKE"


def normal_form(ch: str) -> str:
    """Lower case without foreign marks: a mapped long letter, the base of a stroked letter, else the first of its decomposition."""
    low = ch.lower()[:1] or ch
    if low in SHORTENED:
        return SHORTENED[low]
    name = unicodedata.name(low, "")
    if name.endswith(STROKE):
        return unicodedata.lookup(name.removesuffix(STROKE))
    return low if low in "öü" else unicodedata.normalize("NFD", low)[0]


def foreign_mark(ch: str) -> bool:
    low = ch.lower()
    if unicodedata.name(low[:1], "").endswith(STROKE):
        return True
    return low not in OWN_MARKED and len(unicodedata.normalize("NFD", low)) > 1


def features(ch: str) -> tuple:
    return (ch, normal_form(ch), ch.isalpha(), ch.isupper(), ch.lower() in LONG, foreign_mark(ch), ch.isspace(), unicodedata.category(ch) == "Pd", ch.isdigit())


FEATURES = "ch string, norm string, is_letter boolean, is_upper boolean, is_long boolean, has_foreign_diacritic boolean, is_space boolean, is_dash boolean, is_digit boolean"


def char_counts(chars_df: DataFrame) -> DataFrame:
    """(ch, cnt): how often each character stands."""
    return chars_df.groupBy("ch").agg(F.count(F.lit(1)).alias("cnt"))


def feature_table(spark: SparkSession, counts: DataFrame) -> DataFrame:
    """Features of the characters that occur: at most one row per code point, so a dimension table of bounded size."""
    return spark.createDataFrame([features(r["ch"]) for r in counts.select("ch").distinct().collect()], FEATURES)


def output_ids(counts: DataFrame, exponent: int = 6) -> DataFrame:
    """(ch, cnt, id): characters above total / 10**exponent, ids from 1 by count, ties by code point; 0 is all others."""
    ranked = counts.crossJoin(F.broadcast(counts.agg(F.sum("cnt").alias("total")))).where(F.col("cnt") > F.col("total") / 10**exponent)
    return ranked.select("ch", "cnt", F.row_number().over(W.orderBy(F.desc("cnt"), "ch")).cast("long").alias("id"))


def input_ids(counts: DataFrame, table: DataFrame, least: int = 1000) -> DataFrame:
    """(norm, cnt, id): normal forms seen more than ``least`` times, ids by the first of their characters in count order."""
    order = counts.withColumn("place", F.row_number().over(W.orderBy(F.desc("cnt"), "ch")))
    norms = order.join(F.broadcast(table.select("ch", "norm")), "ch").groupBy("norm").agg(F.sum("cnt").alias("cnt"), F.min("place").alias("place")).where(F.col("cnt") > least)
    return norms.select("norm", "cnt", F.row_number().over(W.orderBy("place")).cast("long").alias("id"))


def encode_text(df: DataFrame, col: str, ids: dict[str, int], out: str) -> DataFrame:
    """df with ``out``: the ids of a text's characters, 0 for those without one."""
    known = F.create_map(*[F.lit(v) for pair in ids.items() for v in pair]) if ids else F.create_map().cast("map<string,int>")
    return df.withColumn(out, F.transform(F.filter(F.split(col, ""), lambda c: c != ""), lambda c: F.coalesce(known[c], F.lit(0))))


def decode_ids(df: DataFrame, col: str, ids: dict[str, int], out: str) -> DataFrame:
    """df with ``out``: the text of ids, the out-of-vocabulary character for 0 and unknown ones."""
    known = F.create_map(*[F.lit(v) for c, k in ids.items() for v in (k, c)]) if ids else F.create_map().cast("map<int,string>")
    return df.withColumn(out, F.array_join(F.transform(col, lambda k: F.coalesce(known[k], F.lit(OOV))), ""))


def _ranges(letters: list[str]) -> list[str]:
    """Members of a pattern's character class: runs of code points as ranges, which are quicker to test."""
    code = sorted({ord(c) for c in letters})
    starts = [k for k, v in enumerate(code) if k == 0 or code[k - 1] != v - 1]
    show = lambda v: f"\\x{{{v:x}}}"
    return [show(code[a]) if b - a == 1 else f"{show(code[a])}-{show(code[b - 1])}" for a, b in zip(starts, [*starts[1:], len(code)], strict=True)]


def replace_unknown(df: DataFrame, col: str, known: list[str], out: str) -> DataFrame:
    """Every character outside ``known`` becomes the out-of-vocabulary character."""
    inside = "".join(_ranges(known))
    return df.withColumn(out, F.regexp_replace(col, f"[^{inside}]", OOV) if known else F.regexp_replace(col, "(?s).", OOV))
