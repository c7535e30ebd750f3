"""Merging two noisy versions of a text: difference segments, alternatives, beam search by perplexity."""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass, field
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import sliding
from ..ship import ship
from ..storage import kept
from .ngram import NgramModel, estimate

#: Sets of strings that readers of print confuse with each other.
MISTAKES = (
    ("ű", "ü", "ii", "ll", "u", "11"),
    ("lc", "k", "lr", "ic", "h"),
    ("k", "h", "lt", "li"),
    ("o", "ó", "ö", "ő", "ô", "õ", "e", "é", "c"),
    ("rn", "m", "nn", "in", "ln", "jn", "fn"),
    ("ivi", "íví", "m"),
    ("g", "q", "y"),
    ("ó'", "ő", "o'"),
    ("w", "v"),
    ("b", "lo", "lc", "le"),
    ("d", "ol", "cl", "oi", "ci"),
    ("d", "tl"),
    ("c", "cz"),
    ("cs", "ts"),
    ("6", "ő", "ó", "ö"),
    ("1", "I", "l", "/"),
    ("i", "í"),
    ("Y", "A"),
    ("f", "ri", "n"),
    ('"', "”"),
)
#: Longest difference that is weighed; longer ones take the second version.
WEIGHED = 10
SEGMENT = "tag string, a0 integer, a1 integer, b0 integer, b1 integer, a string, b string"


def segments(pairs: DataFrame, id_col: str = "pair_id") -> DataFrame:
    """(id, seg_no, tag, a0, a1, b0, b1, a, b): how a becomes b, character by character. Null versions are empty."""
    ship(pairs.sparkSession)

    def run(batches):
        for batch in batches:
            rows = []
            for k, (a, b) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                a, b = a or "", b or ""
                for no, (tag, a0, a1, b0, b1) in enumerate(SequenceMatcher(None, a, b, autojunk=False).get_opcodes()):
                    rows.append((k, no, tag, a0, a1, b0, b1, a[a0:a1], b[b0:b1]))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 9
            types = [pa.int32(), pa.string(), *[pa.int32()] * 4, pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0], pa.int64())), *(pa.array(c, t) for c, t in zip(columns[1:], types, strict=True))], names=[id_col, "seg_no", "tag", "a0", "a1", "b0", "b1", "a", "b"])

    rows = pairs.select(id_col, "a", "b")
    schema = rows.select(id_col).schema.add("seg_no", "integer")
    for part in SEGMENT.split(", "):
        schema = schema.add(*part.split())
    return rows.mapInArrow(run, schema)


def takes_second(tag: Column | str = "tag") -> Column:
    """Where the second version stands without a search: equal stretches, long insertions and deletions, replacements of unlike length."""
    tag = F.col(tag) if isinstance(tag, str) else tag
    na, nb = F.length("a"), F.length("b")
    return F.when(tag == "equal", True).when(tag == "delete", na > WEIGHED).when(tag == "insert", nb > WEIGHED).otherwise(F.abs(na - nb) > WEIGHED)


def alternatives(segs: DataFrame, mistakes: tuple[tuple[str, ...], ...] = MISTAKES) -> DataFrame:
    """segs with alts: a, b and every member of a set of confusions that has one of them."""
    own = F.array_distinct(F.array("a", "b"))
    out = own
    for group in mistakes:
        members = F.array(*map(F.lit, group))
        out = F.array_union(out, F.when(F.arrays_overlap(own, members), members).otherwise(F.array().cast("array<string>")))
    return segs.withColumn("alts", F.when(takes_second(), F.array("b")).otherwise(out))


@dataclass
class Table:
    """A model's tables in a worker: small character models only (their grams are counted before they are sent)."""

    n: int
    count: dict[str, int]
    d: dict[str, float]
    bigram: dict[str, float]
    unigram: dict[str, float]
    seen: dict[tuple[str, str], float] = field(default_factory=dict)

    def log2(self, context: str, ch: str) -> float:
        context = context[1 - self.n :] if self.n > 1 else ""
        key = (context, ch)
        if key not in self.seen:
            while len(context) > 1 and context not in self.d:
                context = context[1:]
            if len(context) == 1 and context + ch not in self.bigram:
                context = "" if context not in self.unigram else context
            if len(context) > 1:
                p = self.count.get(context + ch, self.bigram.get(context[-1] + ch, 0.0)) / self.d[context]
            else:
                p = self.bigram.get(context + ch, 0.0) if context else self.unigram.get(ch, 0.0)
            self.seen[key] = math.log2(max(p, 1e-13))
        return self.seen[key]

    def perplexity(self, text: str, context: str = "") -> float:
        total = 0.0
        for k, ch in enumerate(text):
            total += self.log2((context + text[:k])[-self.n :], ch)
        return 2 ** (-total / max(1, len(text)))


#: Models of up to so many grams go to the workers as dictionaries; larger ones are joined.
MOST_GRAMS = 2_000_000


def fits(model: NgramModel, most: int | None = None) -> bool:
    return model.ngram.count() <= (MOST_GRAMS if most is None else most)


def local_table(model: NgramModel) -> Table:
    """The model as dictionaries, for searches that score in order. The caller checks that it ``fits``."""
    return Table(
        model.n,
        {r["gram"]: r["cnt"] for r in model.ngram.where("n > 2").select("gram", "cnt").collect()},
        {r["ctx"]: r["d"] for r in model.contexts.where("k > 1").select("ctx", "d").collect()},
        {r["a"] + r["c"]: r["p"] for r in model.bigram.collect()},
        {r["ch"]: r["p"] for r in model.unigram.collect()},
    )


def letter(k: int) -> str:
    """The name of the k-th alternative: a to z, then aa, ab, ..."""
    name = ""
    k += 1
    while k:
        k, rest = divmod(k - 1, 26)
        name = chr(97 + rest) + name
    return name


@dataclass
class Search:
    """One pair's beam search, which asks for the perplexities it needs, so it runs against any model.

    Beams extend by each alternative of a segment and are weighed with ``context`` characters to the left and to the right,
    the latter in either version; the best ``beams`` under ``most`` stay, or else only the best. An unweighed segment
    of ``flush`` or more characters settles them, and what all beams begin with is settled at once.
    """

    segs: list[dict]
    context: int = 20
    beams: int = 5
    most: float = 5.0
    flush: int = 15
    at: int = 0
    done: str = ""
    # a beam: texts of its steps, their letters, perplexity, the steps as shown
    now: list = field(default_factory=lambda: [((), (), 1.0, ())])
    log: list = field(default_factory=list)
    asked: list = field(default_factory=list)

    def _right(self, side: str) -> str:
        out, k = "", self.at + 1
        while len(out) < self.context and k < len(self.segs):
            out, k = out + self.segs[k][side], k + 1
        return out[: self.context]

    def _settle(self) -> None:
        first = self.now[0]
        same = 0
        while all(len(b[0]) > same and b[0][same] == first[0][same] and b[1][same] == first[1][same] for b in self.now):
            same += 1
        self.done += "".join(first[0][:same])
        self.now = [(b[0][same:], b[1][same:], b[2], b[3][same:]) for b in self.now]

    def requests(self) -> list[str] | None:
        """Strings whose perplexities the next segment needs; none when the search has ended."""
        while self.at < len(self.segs):
            seg = self.segs[self.at]
            if len(seg["alts"]) > 1:
                rights = sorted({self._right("a"), self._right("b")})
                self.asked = [(b, letter(k), alt, right) for b in self.now for k, alt in enumerate(seg["alts"]) for right in rights]
                return [((self.done + "".join(b[0]))[-self.context :] if self.context else "") + alt + right for b, _, alt, right in self.asked]
            alt = seg["alts"][0]
            if len(alt) >= self.flush:
                self.now = [min(self.now, key=lambda b: (b[2], b[1]))]
            self.now = [(b[0] + (alt,), b[1] + ("_",), b[2], b[3] + (alt,)) for b in self.now]
            self._settle()
            self.at += 1
        return None

    def answer(self, perplexities: list[float]) -> None:
        grown: dict = {}
        seg_no = self.segs[self.at]["seg_no"]
        for (b, name, alt, right), ppl in zip(self.asked, perplexities, strict=True):
            key = (b[0], b[1], name)
            shown = b[3] + (f"{{{alt}}}",)
            self.log.append((seg_no, "try", path(b[1] + (name,)), ppl, "".join(shown) + right))
            if key not in grown or ppl < grown[key][2]:
                grown[key] = (b[0] + (alt,), b[1] + (name,), ppl, shown)
        ordered = sorted(grown.values(), key=lambda b: (b[2], b[1]))
        best = ordered[0]
        self.log.append((seg_no, "best", path(best[1]), best[2], "".join(best[3])))
        self.now = [b for b in ordered if b[2] < self.most][: self.beams] or ordered[:1]
        self._settle()
        self.at += 1

    def merged(self) -> str:
        return self.done + "".join(min(self.now, key=lambda b: (b[2], b[1]))[0])


def path(letters: tuple[str, ...]) -> str:
    return ("" if all(len(x) == 1 for x in letters) else ".").join(letters)


def search(segs: list[dict], table: Table, **options) -> tuple[str, list[tuple[int, str, str, float, str]]]:
    """(merged text, log rows (seg_no, try or best, path, perplexity, rendered))."""
    run = Search(segs, **options)
    while (asked := run.requests()) is not None:
        run.answer([table.perplexity(text) for text in asked])
    return run.merged(), run.log


def whole_perplexities(texts: DataFrame, col: str, model: NgramModel) -> DataFrame:
    """(col, ppl) of each different text, every character scored from the start on; by joins, for models of any size."""
    distinct = texts.select(col).distinct()
    rows = sliding(distinct.withColumn("_own", F.col(col)), [col], F.col("_own"), model.n, heads=model.n - 1).withColumnRenamed("w", "gram")
    known = estimate(rows.select("gram").distinct(), model).select("gram", F.greatest(F.coalesce("p", F.lit(0.0)), F.lit(1e-13)).alias("p"))
    return rows.join(known, "gram").groupBy(col).agg(F.pow(F.lit(2.0), -F.sum(F.log2("p")) / F.count(F.lit(1))).alias("ppl"))


LOG = "seg_no integer, kind string, path string, ppl double, rendered string"


def merge(pairs: DataFrame, model: NgramModel, id_col: str = "pair_id", log: bool = False, **options) -> DataFrame:
    """(id, merged), or with ``log`` (id, seg_no, kind, path, ppl, rendered): every alternative tried and each segment's best.

    A pair's segments are searched in order. A model that ``fits`` goes to the workers; with a larger one all pairs
    take one step a round, and a round's strings are scored by joins. options: those of ``Search``.
    """
    listed = alternatives(segments(pairs, id_col)).groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("seg_no", "a", "b", "alts"))).alias("segs"))
    schema = listed.select(id_col).schema
    for part in (LOG if log else "merged string").split(", "):
        schema = schema.add(*part.split())

    def rows_of(ids, found):
        if not log:
            return pa.RecordBatch.from_arrays([ids, pa.array([m for m, _ in found], pa.string())], names=[id_col, "merged"])
        rows = [(k, *r) for k, (_, rs) in enumerate(found) for r in rs]
        types = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.string())
        columns = [pa.array([r[c] for r in rows], t) for c, t in enumerate(types)]
        return pa.RecordBatch.from_arrays([ids.take(columns[0]), *columns[1:]], names=[id_col, *(x.split()[0] for x in LOG.split(", "))])

    if fits(model):
        shared = pairs.sparkSession.sparkContext.broadcast(local_table(model))

        def run(batches):
            for batch in batches:
                yield rows_of(batch.column(0), [search(s, shared.value, **options) for s in batch.column(1).to_pylist()])

        return listed.mapInArrow(run, schema)

    def begin(batches):
        for batch in batches:
            states = [Search(s, **options) for s in batch.column(1).to_pylist()]
            asked = [s.requests() for s in states]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pickle.dumps(s) for s in states], pa.binary()), pa.array(asked, pa.list_(pa.string()))], names=[id_col, "state", "asked"])

    def go_on(batches):
        for batch in batches:
            states = [pickle.loads(x) for x in batch.column(1).to_pylist()]
            for s, answers in zip(states, batch.column(2).to_pylist(), strict=True):
                s.answer(answers)
            asked = [s.requests() for s in states]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pickle.dumps(s) for s in states], pa.binary()), pa.array(asked, pa.list_(pa.string()))], names=[id_col, "state", "asked"])

    step = listed.select(id_col).schema.add("state", "binary").add("asked", T.ArrayType(T.StringType()))
    now, ended = kept(listed.mapInArrow(begin, step), "beams"), None
    while True:
        over = now.where("asked IS NULL").select(id_col, "state")
        ended = over if ended is None else ended.unionByName(over)
        left = now.where("asked IS NOT NULL")
        if not left.limit(1).count():
            break
        wanted = left.select(id_col, F.posexplode("asked").alias("_no", "_text"))
        # an empty text has no character to be perplexed by
        priced = wanted.join(whole_perplexities(wanted, "_text", model), "_text", "left").withColumn("ppl", F.coalesce("ppl", F.lit(1.0)))
        answers = priced.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("_no", "ppl"))).alias("_a")).select(id_col, F.col("_a.ppl").alias("answers"))
        now = kept(left.select(id_col, "state").join(answers, id_col).mapInArrow(go_on, step), "beams")

    def finish(batches):
        for batch in batches:
            states = [pickle.loads(x) for x in batch.column(1).to_pylist()]
            yield rows_of(batch.column(0), [(s.merged(), s.log) for s in states])

    return ended.mapInArrow(finish, schema)
