"""The query catalogue: every registered query with its DuckDB counterpart.

Doubles are rounded to 6 digits and counts are BIGINT. The model queries train on the lines of
``conversations`` and score those of ``benchmark``; the counting queries run over ``documents``. Queries named
``..._docs`` run an operator of a small query with a counterpart over whole documents, without one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import charset, text
from ..operators import dehyphen, evaluate, neural, ngram, ocr, sample, score

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Order of the registered models; small, so that DuckDB can check them.
N = 3


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_lines(spark, sf_dir) -> DataFrame:
    return text.lines(table(spark, sf_dir, "documents"))


def r6(c: str):
    return F.round(c, 6).alias(c)


def upto(first: int, length: str, alias: str = "t", col: str = "i") -> str:
    """SQL of the numbers from first to a length, beside each row."""
    return f"LATERAL (SELECT unnest(range({first}, CAST({length} AS BIGINT) + 1)) AS {col}) AS {alias}"


LINES = "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)"
CHARS = LINES + ", c AS (SELECT unnest(string_split(line, '')) AS ch FROM l WHERE line <> ''), n AS (SELECT ch, count(*) AS cnt FROM c WHERE ch <> '' GROUP BY ch)"


# --- lines, characters, words -------------------------------------------------------------------


@query(LINES + """ SELECT doc_id, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars,
    CAST(sum(len(list_filter(string_split_regex(line, '[ \\t\\r\\f\\v]+'), lambda x: x <> ''))) AS BIGINT) AS n_words FROM l GROUP BY doc_id""")
def line_stats(spark, sf_dir):
    """Lines, words and characters of each text, as a word counter has them."""
    n_words = F.size(F.filter(F.split("line", r"[ \t\r\f\x0B]+"), lambda x: x != ""))
    return doc_lines(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("n_chars"), F.sum(n_words).alias("n_words"))


@query(LINES + """, s AS (SELECT d.source, l.line FROM l JOIN documents d USING (doc_id))
    SELECT coalesce(source, 'all') AS source, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM s GROUP BY ROLLUP (source)""")
def corpus_stats(spark, sf_dir):
    """Totals by source and over all: the one roll-up of the domain."""
    rows = text.lines(table(spark, sf_dir, "documents"), keep=("source",))
    return rows.rollup("source").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("n_chars")).withColumn("source", F.coalesce("source", F.lit("all")))


@query(CHARS + " SELECT ch, cnt FROM n")
def char_counts(spark, sf_dir):
    return charset.char_counts(text.chars(doc_lines(spark, sf_dir)))


@query(CHARS + " SELECT ch, cnt, row_number() OVER (ORDER BY cnt DESC, unicode(ch)) AS id FROM n WHERE cnt > (SELECT sum(cnt) FROM n) / 1e6")
def char_vocab_ids(spark, sf_dir):
    counts = charset.char_counts(text.chars(doc_lines(spark, sf_dir)))
    return charset.output_ids(counts)


_KNOWN = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ .,"


@query(f"SELECT item_id, regexp_replace(text, '[^{_KNOWN}]', chr(1), 'g') AS replaced FROM benchmark")
def char_oov_replace(spark, sf_dir):
    return charset.replace_unknown(table(spark, sf_dir, "benchmark"), "text", list(_KNOWN), "replaced").select("item_id", "replaced")


@query(CHARS + r""" SELECT ch, regexp_matches(ch, '^\p{L}$') AS is_letter, regexp_matches(ch, '^\p{Lu}$') AS is_upper,
    lower(ch) IN ('á', 'é', 'í', 'ó', 'ú', 'ő', 'ű') AS is_long, regexp_matches(ch, '^[\s\x0b\x1c-\x1f\x{85}\p{Z}]$') AS is_space,
    regexp_matches(ch, '^\p{Pd}$') AS is_dash, regexp_matches(ch, '^\p{Nd}$') AS is_digit FROM n""")
def char_features(spark, sf_dir):
    counts = charset.char_counts(text.chars(doc_lines(spark, sf_dir)))
    return charset.feature_table(spark, counts).select("ch", "is_letter", "is_upper", "is_long", "is_space", "is_dash", "is_digit")


@query(CHARS + r""", f AS (SELECT cnt, lower(ch) AS low FROM n)
    SELECT CASE WHEN low = 'ő' THEN 'ö' WHEN low = 'ű' THEN 'ü' WHEN low IN ('ö', 'ü') THEN low ELSE strip_accents(low) END AS norm,
           CAST(sum(cnt) AS BIGINT) AS cnt FROM f GROUP BY 1""")
def char_norm_counts(spark, sf_dir):
    counts = charset.char_counts(text.chars(doc_lines(spark, sf_dir)))
    return counts.join(F.broadcast(charset.feature_table(spark, counts)), "ch").groupBy("norm").agg(F.sum("cnt").alias("cnt"))


_SPLIT_SQL = r"[\s\p{Pe}\p{Pf}\p{Pi}\p{Po}\p{Ps}]+"
_WORDS_SQL = LINES + rf""", w AS (SELECT unnest(string_split_regex(line, '{_SPLIT_SQL}')) AS word FROM l)
    , v AS (SELECT word, count(*) AS cnt FROM w WHERE regexp_full_match(word, '\p{{L}}+(\p{{Pd}}\p{{L}}*){{0,2}}') GROUP BY word)"""


@query(_WORDS_SQL + " SELECT word, cnt FROM v ORDER BY cnt DESC, word LIMIT 20")
def word_counts_top(spark, sf_dir):
    """The twenty most frequent words: a top-k report."""
    return text.words(doc_lines(spark, sf_dir)).groupBy("word").agg(F.count(F.lit(1)).alias("cnt")).orderBy(F.desc("cnt"), "word").limit(20)


@query(_WORDS_SQL + " SELECT count(*) AS n_types, CAST(sum(cnt) AS BIGINT) AS n_tokens FROM v")
def word_state(spark, sf_dir):
    counts = text.words(doc_lines(spark, sf_dir)).groupBy("word").agg(F.count(F.lit(1)).alias("cnt"))
    return counts.agg(F.count(F.lit(1)).alias("n_types"), F.sum("cnt").alias("n_tokens"))


def _joined_words(spark, sf_dir, between: str) -> DataFrame:
    """The lines of documents with two blocks of letters set apart by a hyphen or a dash wherever nine letters stand in a row."""
    rows = doc_lines(spark, sf_dir)
    return rows.withColumn("line", F.regexp_replace("line", r"(\p{L}{4})(\p{L}{5})", f"$1{between}$2"))


_JOINED = LINES.replace("l AS", "l0 AS") + r""", l AS (SELECT regexp_replace(line, '(\p{L}{4})(\p{L}{5})', '\1BETWEEN\2', 'g') AS line FROM l0), s AS (SELECT unnest(regexp_extract_all(line, 'PATTERN', 1)) AS suffix FROM l)
    SELECT suffix, count(*) AS cnt FROM s GROUP BY suffix"""


@query(_JOINED.replace("BETWEEN", "-").replace("PATTERN", r"\p{L}+\p{Pd}(\p{Ll}{2,})[^\p{L}\p{N}_]"))
def hyphen_suffix_counts(spark, sf_dir):
    return text.suffixes(_joined_words(spark, sf_dir, "-"), text.HYPHEN_SUFFIX).groupBy("suffix").agg(F.count(F.lit(1)).alias("cnt"))


@query(_JOINED.replace("BETWEEN", " - ").replace("PATTERN", r"\p{L}+ \p{Pd} (\p{Ll}{2,})[^\p{L}\p{N}_]"))
def dash_suffix_counts(spark, sf_dir):
    return text.suffixes(_joined_words(spark, sf_dir, " - "), text.DASH_SUFFIX).groupBy("suffix").agg(F.count(F.lit(1)).alias("cnt"))


@query("""SELECT item_id, i AS pos, substr(text, i, 1) AS ch, substr(repeat('~', 3) || text, i, 3) AS left_ctx, substr(text || repeat('~', 3), i + 1, 3) AS right_ctx
    FROM (SELECT item_id, replace(text, '~', '-') AS text FROM benchmark), """ + upto(1, "length(text)"))
def context_windows(spark, sf_dir):
    """Every character with three neighbours on each side; the padding character shown as ~."""
    items = table(spark, sf_dir, "benchmark").withColumn("text", F.replace("text", F.lit("~"), F.lit("-")))
    rows = text.windows(items, ["item_id"], "text", 3, 3)
    show = lambda c: F.translate(c, text.PAD, "~").alias(c)
    return rows.select("item_id", "pos", "ch", show("left_ctx"), show("right_ctx"))


# --- counts and model tables ---------------------------------------------------------------------

def _grams(n: int) -> str:
    """SQL of g: counts of all strings of up to n characters of the lines tl, padded."""
    orders = ", ".join(f"({k})" for k in range(1, n + 1))
    return f"""p AS (SELECT chr(0) || line || chr(0) AS s FROM tl WHERE line <> ''),
    x AS (SELECT substr(s, i - k + 1, k) AS gram, k AS n FROM p, {upto(1, "length(s)")}, (VALUES {orders}) AS o(k) WHERE k <= i),
    g AS (SELECT n, gram, left(gram, n - 1) AS ctx, right(gram, 1) AS t, count(*) AS cnt FROM x GROUP BY n, gram)"""


def _tables(n: int) -> str:
    """SQL of the model's tables of order n, d for contexts of two characters and more."""
    return _grams(n) + f""",
    u AS (SELECT gram AS ch, cnt / (SELECT sum(cnt) FROM g WHERE n = 1) AS p FROM g WHERE n = 1),
    bw AS (SELECT a.ch AS a, c.ch AS c, coalesce(CAST(g.cnt AS DOUBLE), c.p) AS w FROM u a CROSS JOIN u c LEFT JOIN g ON g.n = 2 AND g.ctx = a.ch AND g.t = c.ch),
    b AS (SELECT a, c, w / sum(w) OVER (PARTITION BY a) AS p FROM bw),
    ba AS (SELECT a, arg_max(c, {{'p': p, 'o': -unicode(c)}}) AS best FROM b GROUP BY a),
    d AS (SELECT h.gram AS ctx, right(h.gram, 1) AS a, 1 + coalesce(sum(g.cnt - b.p), 0) AS d, arg_max(g.t, {{'c': g.cnt, 'o': -unicode(g.t)}}) AS best
          FROM (SELECT n, gram FROM g WHERE n BETWEEN 2 AND {n - 1}) h LEFT JOIN g ON g.n = h.n + 1 AND g.ctx = h.gram LEFT JOIN b ON b.a = right(h.gram, 1) AND b.c = g.t GROUP BY h.gram)"""


_GRAMS, _TABLES = _grams(N), _tables(N)
_TRAIN = "tl AS (SELECT unnest(string_split(text, chr(10))) AS line FROM conversations WHERE text IS NOT NULL), "
_TEST = "ts AS (SELECT item_id, k AS line_no, ls[k + 1] AS line FROM (SELECT item_id, string_split(text, chr(10)) AS ls FROM benchmark), " + upto(0, "len(ls) - 1", "t", "k") + ")"


def _scored(windows: str, n: int = N) -> str:
    """SQL of sc: windows (id, gram) of up to n characters with p and best, by back-off to the longest context seen."""
    longer = ", ".join(f"({k})" for k in range(2, n))
    return f"""{windows},
    wd AS (SELECT gram, right(gram, 1) AS t, left(gram, length(gram) - 1) AS c, right(left(gram, length(gram) - 1), 1) AS c1 FROM (SELECT DISTINCT gram FROM wn)),
    lc AS (SELECT wd.gram, max(k) AS k FROM wd, (VALUES {longer}) AS o(k), d WHERE k <= length(wd.c) AND d.ctx = right(wd.c, k) GROUP BY wd.gram),
    es AS (SELECT wd.gram, greatest(coalesce(CASE WHEN d.ctx IS NOT NULL THEN coalesce(CAST(g.cnt AS DOUBLE), b.p) / d.d WHEN b1.a IS NOT NULL THEN b.p ELSE u.p END, 0), 1e-13) AS p,
                  CASE WHEN d.ctx IS NOT NULL THEN coalesce(d.best, b1.best) WHEN b1.a IS NOT NULL THEN b1.best ELSE (SELECT arg_max(ch, {{'p': p, 'o': -unicode(ch)}}) FROM u) END AS best
           FROM wd LEFT JOIN lc USING (gram) LEFT JOIN d ON d.ctx = right(wd.c, lc.k) LEFT JOIN g ON g.n = lc.k + 1 AND g.ctx = d.ctx AND g.t = wd.t
           LEFT JOIN ba b1 ON b1.a = wd.c1 LEFT JOIN b ON b.a = wd.c1 AND b.c = wd.t LEFT JOIN u ON u.ch = wd.t),
    sc AS (SELECT wn.id, wn.gram, right(wn.gram, 1) AS t, es.p, es.best FROM wn JOIN es USING (gram))"""


_METRICS = " SELECT id AS item_id, count(*) AS n, round(avg(CASE WHEN best = t THEN 1.0 ELSE 0.0 END), 6) AS acc, round(pow(2, -sum(log2(p)) / count(*)), 6) AS ppl FROM sc GROUP BY id"


def _test_lines(spark, sf_dir) -> DataFrame:
    return text.lines(table(spark, sf_dir, "benchmark"), "item_id")


def _train_lines(spark, sf_dir) -> DataFrame:
    return text.lines(table(spark, sf_dir, "conversations"), "conv_id").where("line <> ''")


def _model(spark, sf_dir) -> ngram.NgramModel:
    return ngram.train(_train_lines(spark, sf_dir), "line", N)


def _show(df: DataFrame, *cols: str) -> DataFrame:
    """Padding is shown as its picture, so that results hold no zero characters."""
    return df.withColumns({c: F.translate(c, text.PAD, "␀") for c in cols})


@query(LINES.replace("l AS", "tl0 AS").replace("WITH ", "WITH ") + ", tl AS (SELECT line FROM tl0), " + _GRAMS + " SELECT CAST(n AS BIGINT) AS n, replace(gram, chr(0), '␀') AS gram, cnt FROM g")
def ngram_counts(spark, sf_dir):
    grams = ngram.ngram_counts(doc_lines(spark, sf_dir).where("line <> ''"), "line", N)
    return _show(grams.select(F.col("n").cast("long").alias("n"), "gram", "cnt"), "gram")


@query(LINES.replace("l AS", "tl0 AS") + ", tl AS (SELECT line FROM tl0), " + _grams(5) + " SELECT CAST(n AS BIGINT) AS n, replace(gram, chr(0), '␀') AS gram, cnt FROM g")
def ngram_counts_5(spark, sf_dir):
    grams = ngram.ngram_counts(doc_lines(spark, sf_dir).where("line <> ''"), "line", 5)
    return _show(grams.select(F.col("n").cast("long").alias("n"), "gram", "cnt"), "gram")


@query("WITH " + _TRAIN + _GRAMS + " SELECT CAST(n AS BIGINT) AS n, count(*) AS n_grams, CAST(sum(cnt) AS BIGINT) AS total FROM g GROUP BY n")
def ngram_totals(spark, sf_dir):
    grams = ngram.ngram_counts(_train_lines(spark, sf_dir), "line", N)
    return grams.groupBy(F.col("n").cast("long").alias("n")).agg(F.count(F.lit(1)).alias("n_grams"), F.sum("cnt").alias("total"))


@query("WITH " + _TRAIN + _GRAMS + """, q AS (SELECT DISTINCT substr(text, i, 3) AS gram FROM benchmark, """ + upto(1, "length(text) - 2") + """)
    SELECT q.gram, coalesce(g.cnt, 0) AS cnt FROM q LEFT JOIN g ON g.gram = q.gram""")
def ngram_lookup(spark, sf_dir):
    """Counts of given grams, 0 for those never seen."""
    grams = ngram.ngram_counts(_train_lines(spark, sf_dir), "line", N).select("gram", "cnt")
    asked = text.sliding(table(spark, sf_dir, "benchmark"), [], "text", 3).select(F.col("w").alias("gram")).distinct()
    return asked.join(grams, "gram", "left").select("gram", F.coalesce("cnt", F.lit(0)).alias("cnt"))


@query("WITH " + _TRAIN + _TABLES + " SELECT replace(ch, chr(0), '␀') AS ch, round(p, 6) AS p FROM u")
def unigram_freq(spark, sf_dir):
    return _show(_model(spark, sf_dir).unigram, "ch").select("ch", r6("p"))


@query("WITH " + _TRAIN + _TABLES + " SELECT replace(a, chr(0), '␀') AS a, replace(c, chr(0), '␀') AS c, round(p, 6) AS p FROM b")
def bigram_smoothed(spark, sf_dir):
    return _show(_model(spark, sf_dir).bigram, "a", "c").select("a", "c", r6("p"))


@query("WITH " + _TRAIN + _GRAMS + " SELECT CAST(n AS BIGINT) AS n, replace(gram, chr(0), '␀') AS gram, round(cnt / sum(cnt) OVER (PARTITION BY n, ctx), 6) AS p FROM g")
def cond_prob(spark, sf_dir):
    grams = ngram.ngram_counts(_train_lines(spark, sf_dir), "line", N)
    return _show(ngram.cond_prob(grams), "gram").select(F.col("n").cast("long").alias("n"), "gram", r6("p"))


_DENSE = "q AS (SELECT DISTINCT substr(text, i, 2) AS ctx FROM benchmark, " + upto(1, "length(text) - 1") + """),
    ds AS (SELECT q.ctx, u.ch, CASE WHEN d.ctx IS NOT NULL THEN coalesce(CAST(g.cnt AS DOUBLE), b.p) / d.d WHEN b.p IS NOT NULL THEN b.p ELSE u.p END AS p
           FROM q CROSS JOIN u LEFT JOIN d ON d.ctx = q.ctx LEFT JOIN g ON g.n = 3 AND g.ctx = q.ctx AND g.t = u.ch LEFT JOIN b ON b.a = right(q.ctx, 1) AND b.c = u.ch)"""


@query("WITH " + _TRAIN + _TABLES + ", " + _DENSE + " SELECT ctx, replace(ch, chr(0), '␀') AS ch, round(p, 6) AS p FROM ds")
def alternatives_for_context(spark, sf_dir):
    """The whole smoothed distribution after every two characters of the items."""
    asked = text.sliding(table(spark, sf_dir, "benchmark"), [], "text", 2).select(F.col("w").alias("ctx"))
    return _show(ngram.distribution(asked, _model(spark, sf_dir)), "ch").select("ctx", "ch", r6("p"))


@query("WITH " + _TRAIN + _TABLES + ", " + _DENSE + """, k AS (SELECT *, row_number() OVER (PARTITION BY ctx ORDER BY p DESC, unicode(ch)) AS rank FROM ds)
    SELECT ctx, rank, replace(ch, chr(0), '␀') AS ch, round(p, 6) AS p FROM k WHERE rank <= 5""")
def predict_next(spark, sf_dir):
    """The five most likely next characters."""
    asked = text.sliding(table(spark, sf_dir, "benchmark"), [], "text", 2).select(F.col("w").alias("ctx"))
    out = _show(ngram.predict_next(asked, _model(spark, sf_dir), 5), "ch")
    return out.select("ctx", F.col("rank").cast("long").alias("rank"), "ch", r6("p"))


_BACKED = "q AS (SELECT DISTINCT substr(text, i, 5) AS ctx FROM benchmark, " + upto(1, "length(text) - 4") + """)
    SELECT q.ctx, CAST(CASE WHEN EXISTS (SELECT 1 FROM g WHERE n = 2 AND gram = right(q.ctx, 2)) THEN 2 WHEN EXISTS (SELECT 1 FROM g WHERE n = 1 AND gram = right(q.ctx, 1)) THEN 1 ELSE 0 END AS BIGINT) AS k FROM q"""


@query("WITH " + _TRAIN + _GRAMS + ", " + _BACKED)
def backoff_level(spark, sf_dir):
    """How many characters of a context the model can use."""
    asked = text.sliding(table(spark, sf_dir, "benchmark"), [], "text", 5).select(F.col("w").alias("ctx")).distinct().withColumn("gram", F.concat("ctx", F.lit("x")))
    return ngram.back_off(asked, _model(spark, sf_dir)).select("ctx", F.col("k").cast("long").alias("k"))


# --- scoring ---------------------------------------------------------------------------------------


def _metric_rows(df: DataFrame) -> DataFrame:
    return df.select("item_id", F.col("n").cast("long").alias("n"), r6("acc"), r6("ppl"))


def _windows(n: int, source: str = "benchmark") -> str:
    return f", wn AS (SELECT item_id AS id, substr(text, i - {n - 1}, {n}) AS gram FROM {source}, {upto(n, 'length(text)')})"


_W3 = _windows(3)
_W3P = f""", wn AS (SELECT item_id AS id, substr(s, greatest(i - 2, 1), least(i, 3)) AS gram
    FROM (SELECT item_id, chr(0) || text || chr(0) AS s FROM benchmark), {upto(2, "length(s)")})"""


for _n in (5, 8):
    QUERIES[f"ppl_order_{_n}"] = lambda spark, sf_dir, n=_n: _metric_rows(score.metrics(table(spark, sf_dir, "benchmark"), "item_id", "text", ngram.train(_train_lines(spark, sf_dir), "line", n)))
    ORACLE[f"ppl_order_{_n}"] = "WITH " + _TRAIN + _tables(_n) + _scored(_windows(_n), _n) + _METRICS


def _masked_sql(source: str, col: str, out: str, keep: str) -> str:
    """SQL of a table whose characters outside the vocabulary v are chr(1)."""
    return f"""{out} AS (SELECT {keep}, coalesce(string_agg(CASE WHEN v.ch IS NULL THEN chr(1) ELSE substr({col}, i, 1) END, '' ORDER BY i), '') AS {col}
        FROM (SELECT row_number() OVER () AS r, * FROM {source}) q, {upto(1, f"length({col})")} LEFT JOIN v ON v.ch = substr({col}, i, 1) GROUP BY {keep}, r)"""


@query("WITH " + _TRAIN.replace("tl AS", "tl0 AS") + f"""ct AS (SELECT substr(line, i, 1) AS ch, count(*) AS c FROM tl0, {upto(1, "length(line)")} GROUP BY 1), v AS (SELECT ch FROM ct WHERE c > (SELECT sum(c) FROM ct) / 1e3),
    """ + _masked_sql("tl0", "line", "tl1", "1 AS one") .replace("GROUP BY 1 AS one", "GROUP BY 1") + ", tl AS (SELECT line FROM tl1), " + _TABLES + ", "
    + _masked_sql("benchmark", "text", "mb", "item_id") + ", um AS (SELECT item_id, string_agg(CASE WHEN u.ch IS NULL THEN chr(1) ELSE substr(text, i, 1) END, '' ORDER BY i) AS text FROM mb, " + upto(1, "length(text)") + " LEFT JOIN u ON u.ch = substr(text, i, 1) GROUP BY item_id)"
    + _scored(_windows(3, "um")) + _METRICS)
def ppl_masked(spark, sf_dir):
    """Rare characters, a thousandth of all or less, count as one out-of-vocabulary character in training and scoring."""
    return _metric_rows(score.metrics(table(spark, sf_dir, "benchmark"), "item_id", "text", ngram.train(_train_lines(spark, sf_dir), "line", N, rare=3)))


@query("WITH " + _TRAIN + _TABLES + _scored(_W3) + _METRICS)
def ppl_string_fwd(spark, sf_dir):
    return _metric_rows(score.metrics(table(spark, sf_dir, "benchmark"), "item_id", "text", _model(spark, sf_dir)))


@query("WITH " + _TRAIN + _TABLES + _scored(_W3P) + _METRICS)
def ppl_padded_fwd(spark, sf_dir):
    return _metric_rows(score.metrics(table(spark, sf_dir, "benchmark"), "item_id", "text", _model(spark, sf_dir), padded=True))


@query("WITH " + _TRAIN.replace("line FROM", "l0 FROM").replace("tl AS", "tl0 AS") + "tl AS (SELECT reverse(l0) AS line FROM tl0), " + _TABLES + _scored(_windows(3, "(SELECT item_id, reverse(text) AS text FROM benchmark)")) + _METRICS)
def ppl_string_bwd(spark, sf_dir):
    """Backward scores from the forward counts: the reversed view of one table."""
    grams = ngram.ngram_counts(_train_lines(spark, sf_dir), "line", N)
    backward = ngram.build(score.reversed_counts(grams), N)
    items = table(spark, sf_dir, "benchmark").withColumn("text", F.reverse("text"))
    return _metric_rows(score.metrics(items, "item_id", "text", backward))


_BI = """, db AS (SELECT h.gram AS ctx, 1 + coalesce(sum(g.cnt - b2.p), 0) AS d FROM (SELECT gram FROM g WHERE n = 2) h
      LEFT JOIN g ON g.n = 3 AND right(g.gram, 2) = h.gram LEFT JOIN bb b2 ON b2.a = left(h.gram, 1) AND b2.c = left(g.gram, 1) GROUP BY h.gram),
    ps AS (SELECT item_id, i AS pos, substr(text, i, 1) AS t, substr(text, i - 2, 2) AS lc, substr(text, i + 1, 2) AS rc FROM benchmark, """ + upto(3, "length(text) - 2", "r") + """),
    pr AS (SELECT DISTINCT lc, rc FROM ps),
    ff AS (SELECT lc, u.ch, CASE WHEN d.ctx IS NOT NULL THEN coalesce(CAST(g.cnt AS DOUBLE), b.p) / d.d WHEN b.p IS NOT NULL THEN b.p ELSE u.p END AS p
      FROM (SELECT DISTINCT lc FROM pr) CROSS JOIN u LEFT JOIN d ON d.ctx = lc LEFT JOIN g ON g.n = 3 AND g.gram = lc || u.ch LEFT JOIN b ON b.a = right(lc, 1) AND b.c = u.ch),
    fb AS (SELECT rc, u.ch, CASE WHEN db.ctx IS NOT NULL THEN coalesce(CAST(g.cnt AS DOUBLE), bb.p) / db.d WHEN bb.p IS NOT NULL THEN bb.p ELSE u.p END AS p
      FROM (SELECT DISTINCT rc FROM pr) CROSS JOIN u LEFT JOIN db ON db.ctx = rc LEFT JOIN g ON g.n = 3 AND g.gram = u.ch || rc LEFT JOIN bb ON bb.a = left(rc, 1) AND bb.c = u.ch),
    cw AS (SELECT lc, rc, ff.ch, COMBINE AS w FROM pr JOIN ff USING (lc) JOIN fb USING (rc) WHERE ff.ch = fb.ch),
    cd AS (SELECT lc, rc, ch, w / sum(w) OVER (PARTITION BY lc, rc) AS p FROM cw),
    cs AS (SELECT lc, rc, arg_max(ch, {'p': round(p, 12), 'o': -unicode(ch)}) AS best, max(p) AS best_p, -sum(p * log2(greatest(p, 1e-13))) AS h FROM cd GROUP BY lc, rc),
    so AS (SELECT ps.item_id, ps.pos, ps.t, cd.p, cs.best, cs.best_p, cs.h FROM ps JOIN cs USING (lc, rc) LEFT JOIN cd ON cd.lc = ps.lc AND cd.rc = ps.rc AND cd.ch = ps.t)"""
_BB = """, bwb AS (SELECT a.ch AS a, c.ch AS c, coalesce(CAST(g.cnt AS DOUBLE), c.p) AS w FROM u a CROSS JOIN u c LEFT JOIN g ON g.n = 2 AND g.t = a.ch AND g.ctx = c.ch),
    bb AS (SELECT a, c, w / sum(w) OVER (PARTITION BY a) AS p FROM bwb)"""


def _bi_sql(combine: str) -> str:
    return "WITH " + _TRAIN + _TABLES + _BB + _BI.replace("COMBINE", combine)


_BI_METRICS = " SELECT item_id, count(*) AS n, round(avg(CASE WHEN best = t THEN 1.0 ELSE 0.0 END), 6) AS acc, round(pow(2, -sum(log2(greatest(coalesce(p, 0), 1e-13))) / count(*)), 6) AS ppl FROM so GROUP BY item_id"


def _bidirectional(spark, sf_dir, combine: str) -> DataFrame:
    grams = ngram.ngram_counts(_train_lines(spark, sf_dir), "line", N)
    forward, backward = ngram.build(grams, N), ngram.build(score.reversed_counts(grams), N)
    return score.bidirectional(table(spark, sf_dir, "benchmark"), "item_id", "text", forward, backward, combine)


for _name, _sql in (("product", "ff.p * fb.p"), ("max", "greatest(ff.p, fb.p)"), ("sum", "ff.p + fb.p"), ("harmonic", "CASE WHEN ff.p + fb.p > 0 THEN 2 * ff.p * fb.p / (ff.p + fb.p) ELSE 0 END")):
    QUERIES[f"ppl_bi_{_name}"] = lambda spark, sf_dir, c=_name: _metric_rows(score.bidirectional_metrics(_bidirectional(spark, sf_dir, c), "item_id"))
    ORACLE[f"ppl_bi_{_name}"] = _bi_sql(_sql) + _BI_METRICS


@query(_bi_sql("ff.p * fb.p") + """, rk AS (SELECT lc, rc, ch, p, row_number() OVER (PARTITION BY lc, rc ORDER BY round(p, 12) DESC, unicode(ch)) AS rank FROM cd)
    SELECT lc AS left_ctx, rc AS right_ctx, rank, replace(ch, chr(0), '␀') AS ch, round(p, 6) AS p FROM rk WHERE rank <= 3""")
def bi_predict_next(spark, sf_dir):
    """The three likeliest characters between every two characters to the left and two to the right that the items have."""
    grams = ngram.ngram_counts(_train_lines(spark, sf_dir), "line", N)
    asked = text.sliding(table(spark, sf_dir, "benchmark"), [], "text", 5).select(F.substring("w", 1, 2).alias("left_ctx"), F.substring("w", 4, 2).alias("right_ctx"))
    out = _show(score.bidirectional_next(asked, ngram.build(grams, N), ngram.build(score.reversed_counts(grams), N), 3), "ch")
    return out.select("left_ctx", "right_ctx", F.col("rank").cast("long").alias("rank"), "ch", r6("p"))


@query(_bi_sql("ff.p * fb.p") + " SELECT item_id, round(sum(h), 6) AS sum_bits, round(sum(h) * ln(2), 6) AS sum_nats, count(*) FILTER (best <> t) AS errors FROM so GROUP BY item_id")
def text_entropy(spark, sf_dir):
    """Sum of entropies in both bases, and how many characters were not the likeliest."""
    rows = _bidirectional(spark, sf_dir, "product")
    return rows.groupBy("item_id").agg(F.round(F.sum("h_bits"), 6).alias("sum_bits"), F.round(F.sum("h_nats"), 6).alias("sum_nats"), F.count_if(F.col("best") != F.col("target")).alias("errors"))


@query(_bi_sql("ff.p * fb.p") + """ SELECT item_id, CAST(pos - 3 AS BIGINT) AS pos, CASE WHEN t = ' ' THEN '␣' WHEN t NOT IN (SELECT ch FROM u) THEN chr(1) ELSE t END AS ch, CASE WHEN best = t THEN '' WHEN best = ' ' THEN '␣' ELSE replace(best, chr(0), '␀') END AS best,
    round(best_p, 3) AS best_p, CASE WHEN best = t THEN 'OK' ELSE 'ERR!' END AS status FROM so""")
def prediction_table(spark, sf_dir):
    out = score.prediction_table(_bidirectional(spark, sf_dir, "product").withColumn("best_p", F.round("best_p", 3)), "item_id")
    return _show(out.select("item_id", F.col("pos").cast("long").alias("pos"), "ch", "best", "best_p", "status"), "best")


@query("WITH " + _TRAIN + _TABLES + ", " + _TEST + _scored(", wn AS (SELECT {'i': item_id, 'l': line_no} AS id, substr(line, i - 2, 3) AS gram FROM (SELECT * FROM ts WHERE length(line) >= 9), " + upto(3, "length(line)") + ")") + """,
    m AS (SELECT id, pow(2, -sum(log2(p)) / count(*)) AS ppl FROM sc GROUP BY id)
    SELECT id.i AS item_id, id.l AS line_no, round(ppl, 6) AS ppl FROM m WHERE ppl < 9""")
def garbage_filter(spark, sf_dir):
    """Lines of nine characters or more that the model is not perplexed by."""
    rows = _test_lines(spark, sf_dir).withColumn("key", F.struct("item_id", "line_no"))
    kept = score.garbage_filter(rows, "key", "line", _model(spark, sf_dir), 9, 9.0)
    return kept.select("item_id", F.col("line_no").cast("long").alias("line_no"), r6("ppl"))


@query()
def garbage_filter_docs(spark, sf_dir):
    """The filter over the lines of documents, with a model of the same lines."""
    rows = doc_lines(spark, sf_dir).where("line <> ''")
    kept = score.garbage_filter(rows.withColumn("key", F.struct("doc_id", "line_no")), "key", "line", ngram.train(rows, "line", N), 9, 9.0)
    return kept.select("doc_id", F.col("line_no").cast("long").alias("line_no"), r6("ppl"))


@query(LINES.replace("l AS", "l0 AS").replace("doc_id, ", "doc_id, lang, ") + ", tl AS (SELECT line FROM l0), " + _TABLES + _scored(", wn AS (SELECT coalesce(lang, '-') AS id, substr(line, i - 2, 3) AS gram FROM l0, " + upto(3, "length(line)") + ")") + " SELECT id AS lang, count(*) AS n, round(pow(2, -sum(log2(p)) / count(*)), 4) AS ppl FROM sc GROUP BY id")
def perplexity_by_lang(spark, sf_dir):
    """In-sample trigram perplexity of all documents by language."""
    rows = text.lines(table(spark, sf_dir, "documents"), keep=("lang",)).withColumn("lang", F.coalesce("lang", F.lit("-"))).where("line <> ''")
    return score.metrics(rows, "lang", "line", ngram.train(rows, "line", N)).select("lang", "n", F.round("ppl", 4).alias("ppl"))


@query()
def lang_id_by_ppl(spark, sf_dir):
    """Each benchmark item's language: the model, of one a language trained on documents, that is least perplexed."""
    rows = text.lines(table(spark, sf_dir, "documents"), keep=("lang",)).where("line <> '' AND lang IS NOT NULL")
    out = score.identify(table(spark, sf_dir, "benchmark"), "item_id", "text", score.train_by(rows, "lang", "line", N))
    return out.select("item_id", "label", F.round("ppl", 4).alias("ppl"))


# --- dehyphenation ---------------------------------------------------------------------------------

_HYPH = rf"""w AS (SELECT conv_id, unnest(string_split_regex(text, '{_SPLIT_SQL}')) AS word FROM conversations),
    a AS (SELECT conv_id, word FROM w WHERE regexp_full_match(word, '\p{{L}}+')),
    c AS (SELECT word, count(*) AS cnt FROM a GROUP BY word),
    f AS (SELECT DISTINCT left(word, length(word) // 2) AS e1, substr(word, length(word) // 2 + 1) AS e2 FROM a WHERE length(word) >= 8)"""


def _split_words(spark, sf_dir, name: str = "conversations") -> tuple[DataFrame, DataFrame]:
    """(candidates, counts): the words of a table, those of eight letters or more broken in the middle."""
    words = text.words(table(spark, sf_dir, name), "text").where(F.col("word").rlike(r"^\p{L}+$"))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("cnt"))
    half = F.floor(F.length("word") / 2).cast("int")
    cut = counts.where(F.length("word") >= 8).select(F.substring(F.col("word"), F.lit(1), half).alias("e1"), F.lit("-\n").alias("sep"), F.substring(F.col("word"), half + 1, F.length("word")).alias("e2"))
    return cut, counts


def _rule_labels(found: DataFrame, counts: DataFrame) -> DataFrame:
    out = dehyphen.rules(found, counts, counts.where("cnt >= 3"))
    return out.select("e1", "e2", "label")


_CONSONANTS = ", ".join(f"'{c}'" for c in dehyphen.CONSONANTS)
_DIGRAPH = " ".join(f"WHEN ends_with(e1, '{d}') AND starts_with(e2, '{d}') THEN CASE WHEN left(e1, length(e1) - 2) || '{long}' || substr(e2, 3) IN (SELECT word FROM l) THEN '2' ELSE '3' END" for d, long in dehyphen.DIGRAPHS.items())


@query("WITH " + _HYPH + f""", l AS (SELECT word FROM c WHERE cnt >= 3), z AS (SELECT e1, e2, coalesce((SELECT cnt FROM c WHERE word = e1 || e2), 0) AS cj,
      e1 IN (SELECT word FROM l) AS s1, e2 IN (SELECT word FROM l) AS s2, e1 || e2 IN (SELECT word FROM l) AS sj,
      coalesce((SELECT cnt FROM c WHERE word = lower(e1)), 0) AS cl, coalesce((SELECT cnt FROM c WHERE word = e1), 0) AS c1 FROM f)
    SELECT e1, e2, CASE WHEN upper(e1) = e1 THEN '3' WHEN length(e2) = 1 AND e2 IN ({_CONSONANTS}) THEN '3' WHEN e1 = 'e' AND s2 THEN '3' WHEN s1 AND e2 = 'e' THEN '3'
      WHEN e1 = e2 AND e1 IN ('öt', 'hat') THEN '3' {_DIGRAPH} WHEN cj > 0 THEN '1'
      WHEN regexp_matches(e1, '^\\p{{Lu}}') AND cl = 0 AND (c1 > 0 OR s1) AND s2 THEN '3' WHEN sj THEN '1' ELSE '4' END AS label FROM z""")
def dehyph_rules(spark, sf_dir):
    """The rule cascade over broken words."""
    return _rule_labels(*_split_words(spark, sf_dir))


@query()
def dehyph_rules_docs(spark, sf_dir):
    return _rule_labels(*_split_words(spark, sf_dir, "documents"))


_HYPH_LINES = r"""h AS (SELECT item_id, regexp_replace(text, '(\p{L}{4})(\p{L}{4})', '\1-' || chr(10) || '\2', 'g') AS text FROM benchmark),
    l AS (SELECT item_id, k AS line_no, ls[k + 1] AS line FROM (SELECT item_id, string_split(text, chr(10)) AS ls FROM h), """ + upto(0, "len(ls) - 1", "t", "k") + ")"


def _hyphenated(spark, sf_dir, name: str = "benchmark") -> DataFrame:
    return table(spark, sf_dir, name).withColumn("text", F.regexp_replace("text", r"(\p{L}{4})(\p{L}{4})", "$1-\n$2"))


@query("WITH " + _HYPH_LINES + " SELECT item_id, line_no, line, CASE WHEN ends_with(line, '-') THEN '1' ELSE '0' END AS label FROM l")
def dehyph_trivial(spark, sf_dir):
    return dehyphen.trivial(text.lines(_hyphenated(spark, sf_dir), "item_id")).withColumn("line_no", F.col("line_no").cast("long"))


@query("WITH " + _HYPH_LINES + r""", m AS (SELECT item_id, regexp_extract_all(text, '(\p{L}+|\p{Nd}+)(\p{Pd}\n+)(\p{Ll}+)') AS ms FROM h)
    SELECT item_id, k AS no, regexp_extract(ms[k + 1], '^(\p{L}+|\p{Nd}+)', 1) AS e1, regexp_extract(ms[k + 1], '\n(\p{Ll}+)$', 1) AS e2 FROM m, """ + upto(0, "len(ms) - 1", "t", "k"))
def hyph_candidates(spark, sf_dir):
    return dehyphen.candidates(_hyphenated(spark, sf_dir), "item_id", "text").select("item_id", F.col("no").cast("long").alias("no"), "e1", "e2")


@query()
def dehyph_trivial_docs(spark, sf_dir):
    return dehyphen.trivial(text.lines(_hyphenated(spark, sf_dir, "documents"))).withColumn("line_no", F.col("line_no").cast("long"))


@query()
def hyph_candidates_docs(spark, sf_dir):
    return dehyphen.candidates(_hyphenated(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", F.col("no").cast("long").alias("no"), "e1", "e2")


@query()
def dehyph_variants(spark, sf_dir):
    """Each broken word's likeliest reading by bidirectional perplexity."""
    grams = ngram.ngram_counts(_train_lines(spark, sf_dir), "line", N)
    spots = dehyphen.hyphen_contexts(_hyphenated(spark, sf_dir), "item_id", "text", N + 12)
    return dehyphen.by_perplexity(spots, "item_id", ngram.build(grams, N), ngram.build(score.reversed_counts(grams), N))


@query()
def dehyph_rewrite(spark, sf_dir):
    """Every word broken at a line's end, judged by the rules with the words of the same documents."""
    words = text.words(table(spark, sf_dir, "documents"), "text")
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("cnt"))
    return dehyphen.rewrite_by_rules(_hyphenated(spark, sf_dir, "documents"), "doc_id", "text", counts, counts.where("cnt >= 3"))


@query()
def wrap_greedy(spark, sf_dir):
    return dehyphen.wrap_lines(table(spark, sf_dir, "documents"), "doc_id", "text")


# --- evaluation -------------------------------------------------------------------------------------

_GP = "gp AS (SELECT CAST(toxic + 1 AS VARCHAR) AS gold, CAST(2 - quality AS VARCHAR) AS pred FROM labels WHERE toxic IS NOT NULL AND quality IS NOT NULL)"


def _gold_pred(spark, sf_dir) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where("toxic IS NOT NULL AND quality IS NOT NULL")
    return labels.select((F.col("toxic") + 1).cast("string").alias("gold"), (2 - F.col("quality")).cast("string").alias("pred"))


@query(f"WITH {_GP} SELECT gold, pred, count(*) AS n FROM gp GROUP BY gold, pred")
def label_confusion(spark, sf_dir):
    return evaluate.confusion(evaluate.evaluation_rows(_gold_pred(spark, sf_dir)))


@query(f"""WITH {_GP}, k AS (SELECT label, count(*) FILTER (gold = label) AS support, count(*) FILTER (pred = label) AS np, count(*) FILTER (gold = label AND pred = label) AS hit
      FROM gp, (SELECT DISTINCT gold AS label FROM gp UNION SELECT DISTINCT pred FROM gp) GROUP BY label),
    r AS (SELECT label, support, hit, CASE WHEN np > 0 THEN hit / np ELSE 0 END AS p, CASE WHEN support > 0 THEN hit / support ELSE 0 END AS r FROM k),
    f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM r)
    SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, support FROM f
    UNION ALL SELECT 'accuracy', round(sum(hit) / sum(support), 6), round(sum(hit) / sum(support), 6), round(sum(hit) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f
    UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM f
    UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f""")
def classification_report(spark, sf_dir):
    out = evaluate.report(evaluate.confusion(_gold_pred(spark, sf_dir)))
    return out.select("label", r6("precision"), r6("recall"), r6("f1"), F.col("support").cast("long").alias("support"))


_LETTERS = "translate(text, 'aeiou tnrsdhl', 'aabbccaabbcab')"


@query(f"""WITH s AS (SELECT regexp_replace({_LETTERS}, '[^a-c]', 'd', 'gs') AS x FROM benchmark), p AS (SELECT substr(x, i, 1) AS x, substr(reverse(x), i, 1) AS y FROM s, {upto(1, "length(x)")}),
    f AS (SELECT x, y, CASE WHEN x IN ('a', 'b') THEN x ELSE 'c' END AS fx, CASE WHEN y IN ('a', 'b') THEN y ELSE 'c' END AS fy FROM p)
    SELECT CASE WHEN fx = 'c' AND fy = 'c' AND x <> y THEN 'cd' ELSE fx || fy END AS cell, count(*) AS n FROM f GROUP BY 1""")
def ocr_confusion(spark, sf_dir):
    """Choice strings made of the items' letters, compared with their reverse."""
    letters = F.regexp_replace(F.translate("text", "aeiou tnrsdhl", "aabbccaabbcab"), "(?s)[^a-c]", "d")
    rows = table(spark, sf_dir, "benchmark").select(letters.alias("answer"), F.reverse(letters).alias("correct"))
    return evaluate.choice_confusion(rows)


@query()
def ocr_confusion_docs(spark, sf_dir):
    """Choice strings made of all letters of the documents, compared with their reverse."""
    letters = F.regexp_replace(F.translate("text", "aeiou tnrsdhl", "aabbccaabbcab"), "(?s)[^a-c]", "d")
    return evaluate.choice_confusion(table(spark, sf_dir, "documents").select(letters.alias("answer"), F.reverse(letters).alias("correct")))


@query()
def log_best_extract_docs(spark, sf_dir):
    """Whole lines of documents as logs: every fourth line is a marker."""
    rows = doc_lines(spark, sf_dir).select(F.col("doc_id").alias("log_id"), F.col("line_no").cast("long").alias("line_no"), "line")
    return evaluate.extract_best(rows.withColumn("line", F.when(F.col("line_no") % 4 == 0, F.concat(F.lit("Best: "), "line")).otherwise(F.col("line"))))


@query("""WITH l AS (SELECT conv_id AS log_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS line_no, CASE WHEN role = 'user' THEN 'Best: ' || text WHEN length(text) % 7 = 0 THEN '' ELSE text END AS line FROM conversations),
    k AS (SELECT *, last_value(CASE WHEN starts_with(line, 'Best:') THEN 1 WHEN trim(line) = '' THEN 0 END IGNORE NULLS) OVER (PARTITION BY log_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS inside FROM l)
    SELECT log_id, line_no, chr(9) || line AS line FROM k WHERE inside = 1 AND trim(line) <> '' AND NOT starts_with(line, 'Best:')""")
def log_best_extract(spark, sf_dir):
    """Turns of a conversation as a log: a user's turn is a marker, the lines after it belong to it."""
    turns = table(spark, sf_dir, "conversations").withColumn("line_no", F.row_number().over(W.partitionBy("conv_id").orderBy("turn")).cast("long"))
    line = F.when(F.col("role") == "user", F.concat(F.lit("Best: "), "text")).when(F.length("text") % 7 == 0, "").otherwise(F.col("text"))
    return evaluate.extract_best(turns.select(F.col("conv_id").alias("log_id"), "line_no", line.alias("line")))


@query("""WITH i AS (SELECT source AS run, 1 + doc_id % 7 AS train_secs, length(text) AS proc_chars, len(string_split(text, ' ')) AS proc_words FROM documents)
    SELECT run, count(*) AS iterations, CAST(sum(train_secs) AS BIGINT) AS total_secs, CAST(floor(sum(proc_chars) / sum(train_secs)) AS BIGINT) AS chars_per_sec, CAST(floor(sum(proc_words) / sum(train_secs)) AS BIGINT) AS words_per_sec FROM i GROUP BY run""")
def train_summary(spark, sf_dir):
    """Throughput of runs; documents stand for iterations, sources for runs."""
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("run"), (1 + F.col("doc_id") % 7).alias("train_secs"), F.length("text").alias("proc_chars"), F.size(F.split("text", " ")).alias("proc_words"))
    return evaluate.train_summary(rows)


# --- merging of two versions ------------------------------------------------------------------------


def _pairs(spark, sf_dir) -> DataFrame:
    """Each item and itself with letters changed as a reader of print would."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pair_id"), F.col("text").alias("a"), F.translate("text", "mhc", "nbe").alias("b"))


@query()
def ocr_diff_segments(spark, sf_dir):
    return ocr.segments(_pairs(spark, sf_dir))


@query("""WITH s AS (SELECT item_id, substr(text, i, 1) AS a, substr(text, i + 1, 1) AS b FROM benchmark, UPTO), g(k, m) AS (VALUES GROUPS)
    SELECT item_id, CAST(sum(len(list_distinct(list_concat([a, b], coalesce((SELECT flatten(list(m ORDER BY k)) FROM g WHERE list_has_any(m, [a, b])), []))))) AS BIGINT) AS n_alts FROM s GROUP BY item_id""".replace("UPTO", upto(1, "length(text) - 1")).replace("GROUPS", ", ".join(f"({k}, [" + ", ".join("'" + x.replace("'", "''") + "'" for x in m) + "])" for k, m in enumerate(ocr.MISTAKES))))
def ocr_alternatives(spark, sf_dir):
    """How many readings the items' characters have, each taken as replaced by the next."""
    pairs = text.sliding(table(spark, sf_dir, "benchmark"), ["item_id"], "text", 2)
    segs = pairs.select("item_id", F.lit("replace").alias("tag"), F.substring("w", 1, 1).alias("a"), F.substring("w", 2, 1).alias("b"))
    return ocr.alternatives(segs).groupBy("item_id").agg(F.sum(F.size("alts")).cast("long").alias("n_alts"))


@query()
def ocr_merge(spark, sf_dir):
    return ocr.merge(_pairs(spark, sf_dir), _model(spark, sf_dir))


@query()
def ocr_merge_log(spark, sf_dir):
    return ocr.merge(_pairs(spark, sf_dir), _model(spark, sf_dir), log=True)


# --- segmentation, sampling, neural scoring -----------------------------------------------------------


@query()
def segment_hash(spark, sf_dir):
    return text.segments(doc_lines(spark, sf_dir))


@query()
def passage_sample(spark, sf_dir):
    """A sampling operator: passages from a tenth of the lines on."""
    return sample.sample_passages(doc_lines(spark, sf_dir), "doc_id", 0.1)


@query()
def bilstm_predict(spark, sf_dir):
    """The neural scorer's interface, with small untrained weights."""
    scorer = neural.BiLSTM.random(list("abcdefghijklmnopqrstuvwxyz ."), 5, 5)
    return neural.predict(table(spark, sf_dir, "benchmark"), scorer, "item_id", "text")


# --- streams ------------------------------------------------------------------------------------------


@query()
def bilstm_metrics(spark, sf_dir):
    """Accuracy and perplexity of each item under the neural scorer."""
    scorer = neural.BiLSTM.random(list("abcdefghijklmnopqrstuvwxyz ."), 5, 5)
    return neural.span_metrics(neural.predict(table(spark, sf_dir, "benchmark"), scorer, "item_id", "text"), "item_id")


@query()
def bilstm_next(spark, sf_dir):
    """The three likeliest characters between every five characters to the left and five to the right of the items."""
    scorer = neural.BiLSTM.random(list("abcdefghijklmnopqrstuvwxyz ."), 5, 5)
    rows = text.sliding(table(spark, sf_dir, "benchmark"), ["item_id"], "text", 11)
    asked = rows.select(F.struct("item_id", "start").alias("at"), F.substring("w", 1, 5).alias("left_ctx"), F.substring("w", 7, 5).alias("right_ctx"))
    return neural.alternatives(asked, scorer, "at", m=3).select("at.item_id", "at.start", "rank", "ch", "p")


@query("WITH " + _TRAIN + _TABLES + _scored(_W3) + " SELECT id AS item_id, round(pow(2, -sum(log2(p)) / count(*)), 6) AS ppl FROM sc GROUP BY id")
def stream_perplexity(spark, sf_dir):
    """The stream operator on a table: scores without state, equal to those of ppl_string_fwd."""
    from ..streaming import scoring

    items = table(spark, sf_dir, "benchmark").where(F.length("text") >= N)
    return scoring.perplexity_stream(items, "item_id", "text", _model(spark, sf_dir)).select("item_id", r6("ppl"))
