"""Neural scoring: the scorer protocol and a bidirectional LSTM over character windows, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import END, PAD, START
from ..ship import ship


class Scorer(Protocol):
    """What scores windows: the alphabet of its distribution, its context lengths, and a function of context strings."""

    alphabet: list[str]
    left: int
    right: int

    def distributions(self, lefts: list[str], rights: list[str]) -> np.ndarray: ...


def _lstm(x: np.ndarray, kernel: np.ndarray, recurrent: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """All states (N, T, units); gates in the order input, forget, cell, output."""
    units = recurrent.shape[0]
    h = c = np.zeros((len(x), units))
    out = np.zeros((len(x), x.shape[1], units))
    sigmoid = lambda v: 1 / (1 + np.exp(-np.clip(v, -40, 40)))
    for t in range(x.shape[1]):
        z = x[:, t] @ kernel + h @ recurrent + bias
        i, f, g, o = (z[:, k * units : (k + 1) * units] for k in range(4))
        c = sigmoid(f) * c + sigmoid(i) * np.tanh(g)
        h = sigmoid(o) * np.tanh(c)
        out[:, t] = h
    return out


@dataclass
class BiLSTM:
    """Stacked LSTMs over the left context and over the reversed right one, joined last states, dense layers, softmax.

    weights: embedding (codes, width) or none for one-hot codes; left and right lists of (kernel, recurrent, bias);
    dense list of (kernel, bias), relu but for the last. Training is out of scope; ``load`` reads saved weights.
    """

    alphabet: list[str]
    codes: dict[str, int]
    left: int
    right: int
    lefts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    rights: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    dense: list[tuple[np.ndarray, np.ndarray]]
    embedding: np.ndarray | None = None
    cache: dict = field(default_factory=dict, repr=False)

    def encode(self, texts: list[str]) -> np.ndarray:
        ids = np.array([[self.codes.get(c, 0) for c in t] for t in texts])
        table = np.eye(max(self.codes.values(), default=0) + 1) if self.embedding is None else self.embedding
        return table[ids]

    def distributions(self, lefts: list[str], rights: list[str]) -> np.ndarray:
        sides = []
        for texts, layers in ((lefts, self.lefts), ([t[::-1] for t in rights], self.rights)):
            x = self.encode(texts)
            for layer in layers:
                x = _lstm(x, *layer)
            sides.append(x[:, -1])
        x = np.concatenate(sides, 1)
        for k, (kernel, bias) in enumerate(self.dense):
            x = x @ kernel + bias
            x = np.maximum(x, 0) if k < len(self.dense) - 1 else x
        e = np.exp(x - x.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def save(self, path: str) -> None:
        arrays = {f"{side}_{k}_{n}": a for side in ("lefts", "rights", "dense") for k, layer in enumerate(getattr(self, side)) for n, a in enumerate(layer)}
        np.savez(path, alphabet=np.array(self.alphabet), keys=np.array(list(self.codes)), ids=np.array(list(self.codes.values())), sizes=np.array([self.left, self.right]), **arrays, **({} if self.embedding is None else {"embedding": self.embedding}))

    @classmethod
    def load(cls, path: str) -> BiLSTM:
        z = np.load(path)
        layers = lambda side, n: [tuple(z[f"{side}_{k}_{i}"] for i in range(n)) for k in range(sum(f.startswith(f"{side}_") and f.endswith("_0") for f in z.files))]
        return cls(z["alphabet"].tolist(), dict(zip(z["keys"].tolist(), z["ids"].tolist(), strict=True)), *z["sizes"].tolist(), layers("lefts", 3), layers("rights", 3), layers("dense", 2), z["embedding"] if "embedding" in z.files else None)

    @classmethod
    def random(cls, alphabet: list[str], left: int, right: int, units: int = 8, seed: int = 0) -> BiLSTM:
        """Small untrained weights, for tests and for trying the interface."""
        rng = np.random.default_rng(seed)
        codes = {c: k + 1 for k, c in enumerate(alphabet)}
        layer = lambda width: (rng.normal(0, 0.3, (width, 4 * units)), rng.normal(0, 0.3, (units, 4 * units)), np.zeros(4 * units))
        return cls(alphabet, codes, left, right, [layer(len(alphabet) + 1)], [layer(len(alphabet) + 1)], [(rng.normal(0, 0.3, (2 * units, len(alphabet))), np.zeros(len(alphabet)))])


def pad(text: str, left: int, right: int) -> str:
    """Start and end marks, and padding beyond them, so that each character has its contexts."""
    return PAD * (left - 1) + START + text + END + PAD * (right - 1)


OUT = "pos integer, target string, p double, best string, best_p double, h_bits double, inv_p double"


def _stream(scorer: Scorer, windows, batch: int):
    """Distributions of an iterable of (left, right), ``batch`` at a time, as (rows, distributions)."""
    some: list = []
    for w in windows:
        some.append(w)
        if len(some) == batch:
            yield some, scorer.distributions([w[-2] for w in some], [w[-1] for w in some])
            some = []
    if some:
        yield some, scorer.distributions([w[-2] for w in some], [w[-1] for w in some])


def predict(texts: DataFrame, scorer: Scorer, id_col: str, col: str, padded: bool = True, batch: int = 4096, start_col: str | None = None, end_col: str | None = None) -> DataFrame:
    """(id, pos, target, p, best, best_p, h_bits, inv_p) of each character with whole contexts; unpadded texts shorter than
    both contexts and a character have none. p is not under 1e-13; ties of best go to the earlier letter.

    start_col, end_col: the first and last position of the stretch that is scored; the rest of the text is context.
    Rows leave ``batch`` at a time, so a long text needs no more memory than a short one.
    """
    ship(texts.sparkSession)
    shared = texts.sparkSession.sparkContext.broadcast(scorer)

    def run(batches):
        s = shared.value
        number = {c: k for k, c in enumerate(s.alphabet)}

        def windows(b):
            spans = [b.column(2 + k).to_pylist() if c else [None] * b.num_rows for k, c in enumerate((start_col, end_col))]
            for k, (text, first, last) in enumerate(zip(b.column(1).to_pylist(), *spans, strict=True)):
                whole = pad(text or "", s.left, s.right) if padded else text or ""
                shift = 0 if padded else s.left
                for at in range(s.left, len(whole) - s.right):
                    pos = at - s.left + shift
                    if (first is None or pos >= first) and (last is None or pos <= last):
                        yield k, at - s.left, whole[at], whole[at - s.left : at], whole[at + 1 : at + 1 + s.right]

        for b in batches:
            for rows, p in _stream(s, windows(b), batch):
                p = np.maximum(p, 1e-13)
                best = p.argmax(1)
                own = np.array([p[i, number[r[2]]] if r[2] in number else 1e-13 for i, r in enumerate(rows)])
                columns = [pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string()), pa.array(own, pa.float64()), pa.array([s.alphabet[i] for i in best], pa.string()), pa.array(p.max(1), pa.float64()), pa.array(-(p * np.log2(p)).sum(1), pa.float64()), pa.array(1 / own, pa.float64())]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([r[0] for r in rows], pa.int64())), *columns], names=[id_col, *(x.split()[0] for x in OUT.split(", "))])

    rows = texts.select(id_col, col) if start_col is None else texts.select(id_col, col, start_col, end_col)
    schema = rows.select(id_col).schema
    for part in OUT.split(", "):
        schema = schema.add(*part.split())
    return rows.mapInArrow(run, schema)


def predict_substrings(texts: DataFrame, scorer: Scorer, id_col: str, col: str, part: str) -> DataFrame:
    """``predict`` on the first place where column ``part`` stands in the text; texts without it have no rows."""
    at = F.instr(col, F.col(part)) - 1
    rows = texts.withColumn("_first", at).withColumn("_last", at + F.length(part) - 1).where(F.col("_first") >= 0)
    return predict(rows, scorer, id_col, col, start_col="_first", end_col="_last")


def span_metrics(predicted: DataFrame, id_col: str) -> DataFrame:
    """(id, n, acc, ppl) of what ``predict`` gives: accuracy and perplexity of each text or stretch."""
    hit = F.when(F.col("best") == F.col("target"), 1.0).otherwise(0.0)
    return predicted.groupBy(id_col).agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("acc"), F.pow(F.lit(2.0), -F.avg(F.log2("p"))).alias("ppl"))


def evaluate(texts: DataFrame, scorer: Scorer, col: str) -> DataFrame:
    """One row (n, loss, acc, perpl) over all texts: mean negative log-likelihood, accuracy, mean inverse probability."""
    rows = predict(texts.select(F.lit(0).alias("_all"), col), scorer, "_all", col)
    hit = F.when(F.col("best") == F.col("target"), 1.0).otherwise(0.0)
    return rows.agg(F.count(F.lit(1)).alias("n"), (-F.avg(F.log("p"))).alias("loss"), F.avg(hit).alias("acc"), F.avg("inv_p").alias("perpl"))


def alternatives(contexts: DataFrame, scorer: Scorer, id_col: str, left: str = "left_ctx", right: str = "right_ctx", m: int | None = None, batch: int = 4096) -> DataFrame:
    """(id, rank, ch, p): the distribution between two contexts, or its ``m`` likeliest characters; shorter contexts are padded."""
    ship(contexts.sparkSession)
    shared = contexts.sparkSession.sparkContext.broadcast(scorer)

    def run(batches):
        s = shared.value
        most = len(s.alphabet) if m is None else min(m, len(s.alphabet))
        for b in batches:
            sides = ((k, (PAD * s.left + START + (x or ""))[-s.left :], ((y or "") + END + PAD * s.right)[: s.right]) for k, (x, y) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)))
            for rows, p in _stream(s, sides, batch):
                order = np.argsort(-p, axis=1, kind="stable")[:, :most]
                take = np.repeat([r[0] for r in rows], most)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(take)), pa.array(np.tile(np.arange(1, most + 1), len(rows)), pa.int32()), pa.array([s.alphabet[i] for i in order.ravel()], pa.string()), pa.array(np.take_along_axis(p, order, 1).ravel())], names=[id_col, "rank", "ch", "p"])

    rows = contexts.select(id_col, left, right)
    return rows.mapInArrow(run, rows.select(id_col).schema.add("rank", "integer").add("ch", "string").add("p", "double"))
