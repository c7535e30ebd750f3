"""End-of-line dehyphenation: baseline, rule cascade, variants scored by a model, wrapping for evaluation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from ..functions.text import sliding, slices
from ..storage import kept
from .neural import Scorer, predict, span_metrics
from .ngram import NgramModel
from .score import FILL, bidirectional, bidirectional_metrics

#: Labels of hyphens.
LABELS = {"0": "none", "1": "breaking hyphen", "2": "digraph", "3": "orthographic", "4": "hyphen and blank", "5": "dash and blank", "6": "starting hyphen", "7": "dash as punctuation", "8": "hyphen as punctuation"}
#: Hungarian letters written with two characters, and their long forms.
DIGRAPHS = {"sz": "ssz", "zs": "zzs", "cs": "ccs", "gy": "ggy", "ly": "lly", "ny": "nny", "ty": "tty", "dz": "ddz"}
#: Consonants that stand alone after a hyphen, vowels, numerals that double, and conjunctions after which a hyphen keeps its blank.
CONSONANTS = "bcdfghjklmnpqrstvwxyz"
VOWELS = "aeiouáéíóöőúüűAEIOUÁÉÍÓÖŐÚÜŰ"
DOUBLED = ("öt", "hat")
CONJUNCTIONS = ("és", "s", "stb", "vagy", "hanem", "meg", "illetve", "sőt", "majd", "de", "akár", "mind", "sem", "valamint", "avagy", "ráadásul", "helyett", "mellett", "und")
#: What may stand between the pieces, by mode; the left piece is of letters or digits, the right one of small letters.
BETWEEN = {"strict": r"\p{Pd}\s*", "loose": r"\p{Pd}\W*", "eol": r"\p{Pd}\n+"}
CANDIDATE = {mode: rf"(?U)(\p{{L}}+|\p{{Nd}}+)({sep})(\p{{Ll}}+)" for mode, sep in BETWEEN.items()}
#: The same without taking the separator and the right piece, which may be the left piece of the next candidate.
CHAINED = {mode: rf"(?U)(\p{{L}}+|\p{{Nd}}+)(?=({sep})(\p{{Ll}}+))" for mode, sep in BETWEEN.items()}


def vowels(col: Column | str) -> Column:
    """How many vowels a word has."""
    return F.length(F.regexp_replace(col, f"[^{VOWELS}]", ""))


def trivial(lines: DataFrame, col: str = "line") -> DataFrame:
    """lines with label: 1 where the line ends in a hyphen, else 0."""
    return lines.withColumn("label", F.when(F.col(col).endswith("-"), "1").otherwise("0"))


def candidates(texts: DataFrame, id_col: str, col: str, mode: str = "eol") -> DataFrame:
    """(id, no, e1, sep, e2): hyphens between two pieces, in order of the text."""
    found = F.regexp_extract_all(col, F.lit(CANDIDATE[mode]), F.lit(0))
    rows = texts.select(id_col, F.posexplode(found).alias("no", "match"))
    part = lambda k: F.regexp_extract("match", CANDIDATE[mode], k)
    return rows.select(id_col, "no", part(1).alias("e1"), part(2).alias("sep"), part(3).alias("e2"))


def rules(found: DataFrame, counts: DataFrame, lexicon: DataFrame, document_counts: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """candidates with label, rule (the number of the first rule that holds), replacement and long_compound.

    counts and document_counts: (word, cnt), a missing word counts 0. lexicon: (word), the words that
    are spelled right. long_compound: both pieces are words and have seven vowels or more together.
    """
    low, e1, e2, sep = F.lower("e1"), F.col("e1"), F.col("e2"), F.col("sep")
    forms = {"joined": F.concat("e1", "e2"), "hyph": F.concat("e1", F.lit("-"), "e2"), "open": F.concat("e1", "e2", F.lit("-")), "lower": low}
    stem = F.lit(None).cast("string")
    for digraph, long in DIGRAPHS.items():
        stem = F.when(e1.endswith(digraph) & e2.startswith(digraph), F.concat(F.expr(f"left(e1, length(e1) - {len(digraph)})"), F.lit(long), F.expr(f"substring(e2, {len(digraph) + 1})"))).otherwise(stem)
    forms |= {"long": stem, "joined_rn": F.replace(forms["joined"], F.lit("m"), F.lit("rn")), "hyph_rn": F.replace(forms["hyph"], F.lit("m"), F.lit("rn")), "w1": e1, "w2": e2}
    rows = found.withColumns({f"f_{k}": v for k, v in forms.items()})
    counts = counts.select(F.col("word").alias("_w"), F.col("cnt").alias("_n"))
    dc = counts.limit(0) if document_counts is None else document_counts.select(F.col("word").alias("_w"), F.col("cnt").alias("_n"))
    spelled = lexicon.select(F.col("word").alias("_w")).distinct().withColumn("_n", F.lit(1))
    for table, prefix, names in ((counts, "c", ("joined", "hyph", "open", "lower", "joined_rn", "hyph_rn", "w1", "w2")), (dc, "dc", ("joined", "hyph", "joined_rn", "hyph_rn")), (spelled, "s", ("joined", "joined_rn", "hyph_rn", "long", "w1", "w2"))):
        for name in names:
            rows = rows.join(table.withColumnsRenamed({"_w": f"f_{name}", "_n": f"{prefix}_{name}"}), f"f_{name}", "left")
            rows = rows.withColumn(f"{prefix}_{name}", F.coalesce(f"{prefix}_{name}", F.lit(0)))
    c = lambda n: F.col(f"c_{n}")
    ok = lambda n: F.col(f"s_{n}") > 0
    loose = F.lit(not strict)
    same = F.col("f_long").isNotNull()
    hyph, joined = F.col("f_hyph"), F.col("f_joined")
    as_is = F.concat("e1", "sep", "e2")
    cascade: list[tuple[int, Column, str, Column]] = [
        (1, sep.contains("-, ") & (ok("w2") | (c("w2") > 2)), "3", as_is),
        (2, sep.contains("- ") & e2.isin(*CONJUNCTIONS), "4", as_is),
        (3, e1.rlike(r"\p{L}") & (F.upper("e1") == e1), "3", hyph),
        (4, e1.rlike(r"^\p{Nd}+$"), "3", hyph),
        (5, (F.length("e2") == 1) & e2.isin(*CONSONANTS), "3", hyph),
        (6, (e1 == "e") & ok("w2"), "3", hyph),
        (7, ok("w1") & (e2 == "e"), "3", hyph),
        (8, (e1 == e2) & e1.isin(*DOUBLED), "3", hyph),
        (9, same & ok("long"), "2", F.col("f_long")),
        (9, same, "3", hyph),
        (10, c("hyph") > c("joined"), "3", hyph),
        (11, (c("joined") > c("hyph")) | (c("open") > c("hyph")), "1", joined),
        (12, F.col("dc_joined") > F.col("dc_hyph"), "1", joined),
        (13, e1.rlike(r"^\p{Lu}") & (c("lower") == 0) & ((c("w1") > 0) | ok("w1")) & ok("w2"), "3", hyph),
        (14, ok("joined"), "1", joined),
        (15, loose & joined.contains("m") & (ok("joined_rn") | (c("joined_rn") > 0) | (F.col("dc_joined_rn") > 0)), "1", F.col("f_joined_rn")),
        (16, loose & hyph.contains("m") & (ok("hyph_rn") | (c("hyph_rn") > 0) | (F.col("dc_hyph_rn") > 0)), "3", F.col("f_hyph_rn")),
        (17, sep.rlike(r"\s"), "4", F.concat("e1", F.lit("- "), "e2")),
    ]
    label, rule, text = F.lit("3"), F.lit(18), hyph
    for number, test, name, result in reversed(cascade):
        label, rule, text = (F.when(test, v).otherwise(o) for v, o in ((F.lit(name), label), (F.lit(number), rule), (result, text)))
    compound = ok("w1") & ok("w2") & (vowels(F.concat("e1", "e2")) >= 7)
    return rows.withColumns({"label": label, "rule": rule, "replacement": text, "long_compound": compound}).select(*found.columns, "label", "rule", "replacement", "long_compound")


def rewrite_by_rules(texts: DataFrame, id_col: str, col: str, counts: DataFrame, lexicon: DataFrame, document_counts: DataFrame | None = None, mode: str = "eol", strict: bool = True) -> DataFrame:
    """(id, rewritten, labels): texts with every candidate replaced as ``rules`` say, and the labels of those looked at, in order.

    Every hyphen with pieces on both sides is judged once for its different pieces, by joins. A text is then put together
    from left to right: the right piece of a replaced candidate is used up, that of an unchanged one may begin the next.
    Null texts stay null.
    """
    part = lambda k: F.regexp_extract_all(col, F.lit(CHAINED[mode]), F.lit(k))
    keyed = kept(texts.select(id_col, col).withColumn("_text", F.monotonically_increasing_id()), "texts")
    spots = keyed.select("_text", F.posexplode(F.arrays_zip(part(1).alias("e1"), part(2).alias("sep"), part(3).alias("e2"))).alias("_no", "_c")).select("_text", "_no", "_c.e1", "_c.sep", "_c.e2")
    judged = rules(spots.select("e1", "sep", "e2").distinct(), counts, lexicon, document_counts, strict).select("e1", "sep", "e2", "label", "replacement")
    found = spots.join(judged, ["e1", "sep", "e2"]).groupBy("_text").agg(F.sort_array(F.collect_list(F.struct("_no", "replacement", "label"))).alias("_d"))
    rows = keyed.join(found, "_text", "left").select(id_col, col, F.col("_d.replacement").alias("_r"), F.col("_d.label").alias("_l"))

    import pyarrow as pa
    import regex

    from ..ship import ship

    ship(texts.sparkSession)
    pattern = regex.compile(CHAINED[mode].removeprefix("(?U)"))

    def walk(text: str | None, replacements: list[str] | None, labels: list[str] | None) -> tuple[str | None, list[str]]:
        if text is None:
            return None, []
        out, at, used = [], 0, []
        for m, new, label in zip(pattern.finditer(text), replacements or [], labels or [], strict=True):
            if m.start() < at:
                continue
            used.append(label)
            end = m.end(3) if new != text[m.start() : m.end(3)] else m.end(1)
            out.append(text[at : m.start()] + (new if end == m.end(3) else m[1]))
            at = end
        return "".join(out) + text[at:], used

    def run(batches):
        for batch in batches:
            found = [walk(*r) for r in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.list_(pa.string()))], names=[id_col, "rewritten", "labels"])

    return rows.mapInArrow(run, rows.select(id_col).schema.add("rewritten", "string").add("labels", T.ArrayType(T.StringType())))


def rewrite(texts: DataFrame, id_col: str, col: str, decide: Callable[[str, str, str], str], mode: str = "eol") -> DataFrame:
    """texts with every candidate replaced by decide(e1, sep, e2), resuming after e1 where nothing changed.

    The restart depends on the decision before, so a text is walked in order; Arrow batches of texts.
    """
    import pyarrow as pa
    import regex

    from ..ship import ship

    ship(texts.sparkSession)
    pattern = regex.compile(CANDIDATE[mode].removeprefix("(?U)"))

    def walk(text: str | None) -> str | None:
        if text is None:
            return None
        out, at = [], 0
        while m := pattern.search(text, at):
            new = decide(*m.groups())
            if new == m[0]:
                out.append(text[at : m.end(1)])
                at = m.end(1)
            else:
                out.append(text[at : m.start()] + new)
                at = m.end()
        return "".join(out) + text[at:]

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([walk(t) for t in batch.column(1).to_pylist()], pa.string())], names=[id_col, "rewritten"])

    rows = texts.select(id_col, col)
    return rows.mapInArrow(run, rows.select(id_col).schema.add("rewritten", "string"))


def variants(found: DataFrame, id_col: str, left: str = "left_ctx", right: str = "right_ctx") -> DataFrame:
    """(id, no, label, order, variant): the readings of a hyphen between two contexts that end and begin with its neighbours.

    1 joined, 3 hyphen, 4 hyphen and blank, 2 the doubled digraph written short where both sides have the same one.
    """
    digraph = F.lit(None).cast("string")
    for short, long in DIGRAPHS.items():
        if len(short) == 2:
            digraph = F.when(F.col(left).endswith(short) & F.col(right).startswith(short), F.concat(F.expr(f"left({left}, length({left}) - 2)"), F.lit(long), F.expr(f"substring({right}, 3)"))).otherwise(digraph)
    options = F.array(
        F.struct(F.lit("4").alias("label"), F.lit(0).alias("order"), F.concat(left, F.lit("- "), right).alias("variant")),
        F.struct(F.lit("3").alias("label"), F.lit(1).alias("order"), F.concat(left, F.lit("-"), right).alias("variant")),
        F.struct(F.lit("1").alias("label"), F.lit(2).alias("order"), F.concat(left, right).alias("variant")),
        F.struct(F.lit("2").alias("label"), F.lit(3).alias("order"), digraph.alias("variant")),
    )
    return found.select(id_col, "no", F.explode(options).alias("v")).select(id_col, "no", "v.*").where("variant IS NOT NULL")


def by_perplexity(found: DataFrame, id_col: str, forward: NgramModel, backward: NgramModel) -> DataFrame:
    """(id, no, label, ppl, variant): the reading of least bidirectional perplexity; a dash after a blank is 5 at once."""
    dash = found.where(F.col("left_ctx").endswith(" "))
    rest = found.where(~F.col("left_ctx").endswith(" "))
    tried = variants(rest, id_col).withColumn("vid", F.xxhash64(id_col, "no", "label", "variant"))
    scored = bidirectional_metrics(bidirectional(tried, "vid", "variant", forward, backward, padded=True), "vid")
    best = tried.join(scored, "vid").groupBy(id_col, "no").agg(F.min_by(F.struct("label", "ppl", "variant"), F.struct("ppl", "order")).alias("b"))
    fixed = dash.select(id_col, "no", F.lit("5").alias("label"), F.lit(None).cast("double").alias("ppl"), F.concat("left_ctx", F.lit("- "), "right_ctx").alias("variant"))
    return best.select(id_col, "no", "b.label", "b.ppl", "b.variant").unionByName(fixed)


def by_scorer(found: DataFrame, id_col: str, scorer: Scorer) -> DataFrame:
    """(id, no, label, ppl, variant): as ``by_perplexity``, by a neural scorer of whole variants."""
    dash = found.where(F.col("left_ctx").endswith(" "))
    tried = variants(found.where(~F.col("left_ctx").endswith(" ")), id_col).withColumn("vid", F.xxhash64(id_col, "no", "label", "variant"))
    scored = span_metrics(predict(tried, scorer, "vid", "variant"), "vid")
    best = tried.join(scored, "vid").groupBy(id_col, "no").agg(F.min_by(F.struct("label", "ppl", "variant"), F.struct("ppl", "order")).alias("b"))
    fixed = dash.select(id_col, "no", F.lit("5").alias("label"), F.lit(None).cast("double").alias("ppl"), F.concat("left_ctx", F.lit("- "), "right_ctx").alias("variant"))
    return best.select(id_col, "no", "b.label", "b.ppl", "b.variant").unionByName(fixed)


def hyphen_contexts(texts: DataFrame, id_col: str, col: str, context: int) -> DataFrame:
    """(id, no, left_ctx, right_ctx): up to ``context`` characters on both sides of each hyphen at a line's end."""
    # blanks of a noncharacter on both sides make every window whole
    fill = FILL * context
    rows = sliding(texts.where(F.col(col).contains("-\n")), [id_col], F.concat(F.lit(fill), F.col(col), F.lit(fill)), 2 * context + 2)
    rows = rows.where(F.substring("w", context + 1, 2) == "-\n")
    side = lambda at: F.translate(F.substring("w", at, context), FILL, "")
    rows = rows.select(id_col, "start", side(1).alias("left_ctx"), side(context + 3).alias("right_ctx")).where("left_ctx <> ''")
    no = F.row_number().over(W.partitionBy(id_col).orderBy("start")) - 1
    return rows.select(id_col, no.alias("no"), "left_ctx", "right_ctx")


def split_word(word: str, room: int) -> tuple[str, str] | None:
    """Stands in for a syllabifier: (head with its hyphen, tail) of the longest head within ``room``, or nothing.

    Words break after a hyphen of their own, in a long digraph, which becomes two short ones, and, from eight letters on, in the middle.
    """
    cuts = [(word[: k + 1] + "-", word[k + 1 :]) for k in range(1, len(word) - 1) if word[k] == "-"]
    for short, long in DIGRAPHS.items():
        k = word.lower().find(long, 1)
        if k > 0 and k + 3 < len(word):
            cuts.append((word[:k] + short + "-", short + word[k + 3 :]))
    if len(word) >= 8 and word.isalpha():
        cuts.append((word[: len(word) // 2] + "-", word[len(word) // 2 :]))
    return max((c for c in cuts if len(c[0]) <= room), key=lambda c: len(c[0].rstrip("-")), default=None)


def wrap_line(line: str, most: int, split: Callable[[str, int], tuple[str, str] | None] = split_word) -> list[tuple[str, str | None]]:
    """The output lines of one input line, with the label of each break; the last has none."""
    line = " ".join(line.replace("\t", " ").split())
    if len(line) <= most:
        return [(line, None)]
    words = line.split(" ")
    out, now, last = [], words[0], words[0]
    words = words[:0:-1]
    while words:
        word = words.pop()
        room = most - len(now) - 1
        if len(word) <= room:
            now, last = f"{now} {word}", word
            continue
        kept_as = "5" if last == "-" else "4" if last.endswith("-") else "0"
        head, tail, label = None, word, kept_as
        if room > 0 and word == "-":
            label = "0"
        elif room > 0 and word[: room + 1].rfind("-") == room - 1:
            head, tail = word[:room], word[room:]
            label = "7" if word in ("-,", "-;") else "6" if word[0] == "-" else "8" if tail[0] in ",;" else "3"
        elif room > 0 and (cut := split(word, room)):
            head, tail = cut
            label = "3" if head.endswith("--") else "2" if len(head) + len(tail) > len(word) + 1 else "1"
            head = head[:-1] if label == "3" else head
        out.append((now if head is None else f"{now} {head}", label))
        now = last = tail
    return [*out, (now, None)]


def wrap_lines(texts: DataFrame, id_col: str, col: str, maxlength: int = 40, split: Callable[[str, int], tuple[str, str] | None] = split_word) -> DataFrame:
    """(id, line_no, line, label): every input line as greedy lines of up to ``maxlength``, words broken where ``split`` says.

    Labels of breaks, by the constants above: 1 and 2 a broken word, 3 a break at a word's own hyphen, 4 and 5 a word that ends in a
    hyphen or is one, 6 to 8 hyphens that stand oddly, else 0; an input line's last line has none. Filling depends on
    the line before, so a text is walked in order. A word longer than a line that cannot be broken has a line of its own.
    """
    from ..ship import ship

    ship(texts.sparkSession)

    def run(batches):
        import pyarrow as pa

        # a text becomes many rows, each a Python object of several, so a few texts at a time
        for batch in slices(batches, 1):
            rows = [(k, n, *x) for k, t in enumerate(batch.column(1).to_pylist()) for n, x in enumerate(y for line in (t or "").split("\n") for y in wrap_line(line, maxlength, split)) if t is not None]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.string())], names=[id_col, "line_no", "line", "label"])

    rows = texts.select(id_col, col)
    return rows.mapInArrow(run, rows.select(id_col).schema.add("line_no", "integer").add("line", "string").add("label", "string"))
