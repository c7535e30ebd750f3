"""Toxicity by class-conditional Kneser-Ney models with shared backoff counts."""

from __future__ import annotations

import io
import pickle
import zlib
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..ship import ship
from .common import kept, parts, release

#: A-Z become lower case; what is no letter, digit or byte from 0x80 on divides words.
_WORDS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
#: From this score on a text is taken as toxic.
TOXIC = 0.3
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: A worker keeps the scores of at most so many different words; then it starts anew.
CACHE_WORDS = 200_000
#: New words are scored so many at a time, and the fitted scorer leaves its worker in parts of so many bytes.
SLICE_WORDS, PART_BYTES = 8_000, 4 << 20


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_WORDS).split()


class Positions:
    """All predicted bytes of a list of words, each word between two spaces, with hashes of what ends there."""

    def __init__(self, vocabulary: list[bytes], order: int):
        sizes = np.fromiter(map(len, vocabulary), np.int64, len(vocabulary)) + 2
        text = np.frombuffer(b"".join(b" " + w + b" " for w in vocabulary), np.uint8).astype(np.uint64) + np.uint64(1)
        starts = np.cumsum(sizes) - sizes
        where = (np.arange(len(text)) - np.repeat(starts, sizes)).astype(np.int32)
        self.end = np.flatnonzero(where > 0).astype(np.int32)
        self.depth = np.minimum(where[self.end] + 1, order).astype(np.int8)
        self.word = np.repeat(np.arange(len(vocabulary), dtype=np.int32), sizes)[self.end]
        hashed = np.zeros(len(text) + 1, np.uint64)
        powers = np.ones(order + 2, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(1, order + 2):
                powers[k] = powers[k - 1] * _FACTOR
            # a word's own running hash, so that nothing depends on the words before it
            value = np.zeros(len(vocabulary), np.uint64)
            for k in range(int(sizes.max(initial=0))):
                on = np.flatnonzero(sizes > k)
                value[on] = value[on] * _FACTOR + text[starts[on] + k]
                hashed[starts[on] + k] = value[on]
        self._hashed, self._where, self._powers = hashed, where, powers

    def key(self, end: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """Hash of the ``length`` bytes up to and with position ``end``; 0 bytes give 0."""
        length = np.broadcast_to(np.asarray(length, np.int64), end.shape)
        before = end - length
        with np.errstate(over="ignore"):
            head = np.where(self._where[end] - length >= 0, self._hashed[np.maximum(before, 0)], np.uint64(0))
            out = self._hashed[end] - head * self._powers[length]
            out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + length.astype(np.uint64)
        return np.where(length > 0, out, np.uint64(0))


def _sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    unique, at = np.unique(keys, return_inverse=True)
    return (unique, *(np.bincount(at, v, len(unique)) for v in values))


def _found(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, keys), max(len(table) - 1, 0))
    return at, (table[at] == keys) if len(table) else np.zeros(len(keys), bool)


class Finder:
    """Looks mixed 64-bit keys up in a sorted table as ``_found`` does: by their first bits, then in steps of one row."""

    def __init__(self, table: np.ndarray):
        bits = max(1, len(table).bit_length() - 2)
        self.table, self.shift = table, np.uint64(64 - bits)
        self.first = np.searchsorted(table, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        table, last = self.table, len(self.table) - 1
        if last < 0:
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(self.first[keys >> self.shift], last)
        value = table[at]
        on = np.flatnonzero((value < keys) & (at < last))
        while len(on):
            at[on] += 1
            value[on] = table[at[on]]
            on = on[(value[on] < keys[on]) & (at[on] < last)]
        return at, value == keys


@dataclass
class KneserNey:
    """Two models of the bytes of a word: class counts at the full order, one set of continuation counts below."""

    order: int
    discount: float
    grams: tuple[np.ndarray, ...]
    contexts: tuple[np.ndarray, ...]
    levels: list[tuple[np.ndarray, ...]]
    finders: list[Finder] = field(default_factory=list, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"finders": []}

    @classmethod
    def fit(cls, vocabulary: list[bytes], ordinary: np.ndarray, toxic: np.ndarray, order: int = 10, discount: float = 0.75) -> KneserNey:
        at = Positions(vocabulary, order)
        count = [ordinary[at.word].astype(float), toxic[at.word].astype(float)]
        keys = at.key(at.end, at.depth)
        grams, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        n = [np.bincount(inverse, c, len(grams)) for c in count]
        context = at.key(at.end[first] - 1, at.depth[first] - 1)
        contexts = _sums(context, n[0], (n[0] > 0).astype(float), n[1], (n[1] > 0).astype(float))
        # continuation counts, from the longest down; whole beginnings of words, which nothing precedes, keep their counts
        end, depth, total = at.end[first], at.depth[first], n[0] + n[1]
        above_end = np.zeros(0, np.int32)
        levels: list = []
        for length in range(order, 0, -1):
            own = depth == length
            ends, weights = np.concatenate([above_end, end[own]]), np.concatenate([np.ones(len(above_end)), total[own]])
            key = at.key(ends, length)
            unique, where, inverse = np.unique(key, return_index=True, return_inverse=True)
            c = np.bincount(inverse, weights, len(unique))
            low = at.key(ends[where] - 1, length - 1)
            levels.append((unique, c.astype(np.float32), *(v.astype(np.float32) if k else v for k, v in enumerate(_sums(low, c, np.ones(len(c)))))))
            above_end = ends[where]
        small = lambda t: tuple(v.astype(np.float32) if k else v for k, v in enumerate(t))
        # the longest level only led to the others
        return cls(order, discount, small((grams, *n)), small(contexts), levels[:0:-1])

    def byte_logs(self, at: Positions) -> np.ndarray:
        """(2, positions): log p(byte | the word's bytes before, ordinary), and the same for toxic."""
        end, depth, d = at.end, at.depth, self.discount
        if not self.finders:
            self.finders += map(Finder, (self.contexts[0], self.grams[0], *chain.from_iterable((level[2], level[0]) for level in self.levels)))
        find = self.finders
        low = np.full(len(end), 1 / 256)
        for length in range(1, self.order):
            on = np.flatnonzero((depth > length) | (depth < self.order) & (depth == length))
            _, c, _, total, types = self.levels[length - 1]
            k, have = find[2 * length](at.key(end[on] - 1, length - 1))
            on, k = on[have], k[have]
            g, seen = find[2 * length + 1](at.key(end[on], length))
            low[on] = (np.maximum(np.where(seen, c[g], 0) - d, 0) + d * types[k] * low[on]) / total[k]
        out = np.tile(np.log(low), (2, 1))
        row, known = find[0](at.key(end - 1, depth - 1))
        on = np.flatnonzero(known)
        row = row[on]
        g, seen = find[1](at.key(end[on], depth[on]))
        for k in (0, 1):
            n, types = self.contexts[1 + 2 * k][row], self.contexts[2 + 2 * k][row]
            own = (np.maximum(np.where(seen, self.grams[1 + k][g], 0) - d, 0) + d * types * low[on]) / np.maximum(n, 1)
            out[k, on] = np.log(np.where(n > 0, own, low[on]))
        return out

    def logs(self, vocabulary: list[bytes]) -> np.ndarray:
        """(2, words): log p(word | ordinary) and log p(word | toxic), the space after a word included."""
        if not vocabulary or not len(self.grams[0]):
            return np.zeros((2, len(vocabulary)))
        at = Positions(vocabulary, self.order)
        value = self.byte_logs(at)
        return np.stack([np.bincount(at.word, v, len(vocabulary)) for v in value])

    def ratios(self, vocabulary: list[bytes]) -> np.ndarray:
        """log p(word | toxic) - log p(word | ordinary)."""
        ordinary, toxic = self.logs(vocabulary)
        return toxic - ordinary


@dataclass
class Pairs:
    """The order above the bytes: a word after the word before it.

    Class counts are smoothed by the pair counts of both classes together (``prior`` of them), these by the class's
    byte model, so that a pair seen once tells little and an expression of ordinary words that only one class has tells much.
    keys: sorted numbers of pairs (before * size + word); n: their counts by class; totals, kinds: by class and word before.
    """

    size: int
    discount: float
    prior: float
    keys: np.ndarray
    n: np.ndarray
    totals: np.ndarray
    kinds: np.ndarray

    @classmethod
    def fit(cls, texts: list[np.ndarray], toxic: np.ndarray, size: int, discount: float = 0.75, prior: float = 5.0) -> Pairs:
        both = []
        for k in (0, 1):
            own = [t[:-1].astype(np.int64) * size + t[1:] for t, y in zip(texts, toxic.tolist(), strict=True) if y == k]
            both.append(np.unique(np.concatenate([np.zeros(0, np.int64), *own]), return_counts=True))
        keys = np.union1d(both[0][0], both[1][0])
        n = np.zeros((2, len(keys)), np.float32)
        for k, (own, count) in enumerate(both):
            n[k, np.searchsorted(keys, own)] = count
        before = keys // max(size, 1)
        rows = [*n, n.sum(0)]
        totals = np.stack([np.bincount(before, v, size) for v in rows]).astype(np.float32)
        kinds = np.stack([np.bincount(before, v > 0, size) for v in rows]).astype(np.float32)
        return cls(size, discount, prior, keys, n, totals, kinds)

    def logs(self, v: np.ndarray, w: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """(2, pairs): log p(word w | word v) by class; lower: (2, pairs) the logs of the byte models. w may be -1."""
        at, seen = _found(self.keys, v * self.size + w)
        seen &= w >= 0
        d, total, kinds = self.discount, np.maximum(self.totals[2][v], 1), self.kinds[2][v]
        have = np.where(seen, self.n[:, at], 0) if len(self.keys) else np.zeros((2, len(v)))
        out = []
        for k in (0, 1):
            low = np.exp(lower[k])
            shared = np.where(self.totals[2][v] > 0, (np.maximum(have.sum(0) - d, 0) + d * kinds * low) / total, low)
            own = (np.maximum(have[k] - d, 0) + (d * self.kinds[k][v] + self.prior) * shared) / (self.totals[k][v] + self.prior)
            out.append(np.log(np.maximum(own, 1e-300)))
        return np.stack(out)

    def ratios(self, number: np.ndarray, begins: np.ndarray, logs: np.ndarray) -> np.ndarray:
        """For running words of texts that begin at ``begins``: log p(word | word before, toxic) - the same for ordinary.

        number: each word's number, -1 for words that were not fitted; logs: (2, words) of the byte models.
        """
        out = logs[1] - logs[0]
        if len(number) < 2 or not len(self.keys):
            return out
        before = np.r_[-1, number[:-1]]
        before[begins] = -1
        on = np.flatnonzero(before >= 0)
        on = on[self.totals[2, before[on]] > 0]
        ordinary, toxic = self.logs(before[on].astype(np.int64), number[on], logs[:, on])
        out[on] = toxic - ordinary
        return out


def _top(ratios: np.ndarray, n: int) -> float:
    return float((np.partition(ratios, len(ratios) - n)[-n:] if len(ratios) > n else ratios).mean())


#: How many numbers ``features`` gives.
FEATURES = 5


def features(alone: np.ndarray, after: np.ndarray) -> tuple[float, ...]:
    """Log-likelihood ratios of a document's words, over the number of words taken.

    ``alone`` are those of the byte models, ``after`` those given the word before. All words, the three and the one that
    tell most: the small numbers are there because a few expressions make a long text toxic.
    """
    if not len(alone):
        return (0.0,) * FEATURES
    return float(np.clip(alone.mean(), -2, 2)), _top(alone, 3), float(alone.max()), float(np.clip(after.mean(), -2, 2)), _top(after, 3)


@dataclass
class Scorer:
    model: KneserNey
    pairs: Pairs
    number: dict[bytes, int]
    weights: np.ndarray
    bias: float
    mean: np.ndarray
    scale: np.ndarray

    def probability(self, rows: np.ndarray) -> np.ndarray:
        z = (rows - self.mean) / self.scale @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _squeezed(scorer: Scorer) -> bytes:
    """The scorer pickled and compressed, piece by piece."""
    out, squeeze = bytearray(), zlib.compressobj(1)

    class Sink:
        def write(self, piece) -> int:
            out.extend(squeeze.compress(piece))
            return memoryview(piece).nbytes

    pickle.dump(scorer, Sink(), 5)
    return bytes(out + squeeze.flush())


class _Inflated(io.RawIOBase):
    """Compressed bytes, read as they were before, without ever holding all of these."""

    def __init__(self, body: bytes):
        self._body, self._inflate, self._left, self._next = memoryview(body), zlib.decompressobj(), b"", 0

    def readable(self) -> bool:
        return True

    def readinto(self, to) -> int:
        while True:
            if not self._left:
                self._left, self._next = self._body[self._next : self._next + (1 << 16)], self._next + (1 << 16)
            over = not self._left
            piece = self._inflate.decompress(self._left, len(to))
            self._left = self._inflate.unconsumed_tail
            if piece or over:
                to[: len(piece)] = piece
                return len(piece)


def _restored(body: bytes) -> Scorer:
    return pickle.load(io.BufferedReader(_Inflated(body), 1 << 16))


class Fitted:
    """A fitted scorer as it left its task: compressed bytes, which become a scorer in the workers only."""

    def __init__(self, body: bytes):
        self._body, self._shared = body, None

    @classmethod
    def of(cls, scorer: Scorer) -> Fitted:
        return cls(_squeezed(scorer))

    def __reduce__(self):
        return _restored, (self._body,)

    def scorer(self) -> Scorer:
        return self._shared.value if self._body is None else _restored(self._body)

    def shared(self, spark):
        """The broadcast; from then on the driver holds no bytes of its own."""
        if self._shared is None:
            self._shared, self._body = spark.sparkContext.broadcast(self), None
        return self._shared


class _Known:
    """A worker's table of words it met: their numbers among the fitted words and their logs of the byte models."""

    def __init__(self, scorer: Scorer):
        self.scorer = scorer
        self.clear()

    def clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.number, self.logs = np.zeros(1024, np.int64), np.zeros((2, 1024))

    def add(self, new: list[bytes]) -> None:
        need = len(self.at) + len(new)
        if need > len(self.number):
            more = max(need, 2 * len(self.number)) - len(self.number)
            self.number, self.logs = np.r_[self.number, np.zeros(more, np.int64)], np.concatenate([self.logs, np.zeros((2, more))], 1)
        get = self.scorer.number.get
        for k in range(0, len(new), SLICE_WORDS):
            part, first = new[k : k + SLICE_WORDS], len(self.at)
            self.at.update(zip(part, range(first, first + len(part)), strict=True))
            self.number[first : first + len(part)] = [get(w, -1) for w in part]
            self.logs[:, first : first + len(part)] = self.scorer.model.logs(part)

    def rows(self, texts: list[list[bytes]]) -> list[tuple[float, ...]]:
        """The features of texts, given as words."""
        if len(self.at) > CACHE_WORDS:
            self.clear()
        running = list(chain.from_iterable(texts))
        self.add(list(set(running).difference(self.at)))
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        at = np.fromiter(map(self.at.__getitem__, running), np.int64, len(running))
        logs = self.logs[:, at]
        alone, after = logs[1] - logs[0], self.scorer.pairs.ratios(self.number[at], (ends - sizes)[sizes > 0], logs)
        return [features(alone[e - n : e], after[e - n : e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]


def _fit_counts(vocabulary: list[bytes], texts: list[np.ndarray], toxic: np.ndarray, order: int) -> tuple[KneserNey, Pairs]:
    """The models of the given texts, which are word numbers."""
    n = [np.bincount(np.concatenate([np.zeros(0, np.int64), *(t for t, y in zip(texts, toxic.tolist(), strict=True) if y == k)]), minlength=len(vocabulary)) for k in (0, 1)]
    used = np.flatnonzero(n[0] + n[1])
    return KneserNey.fit([vocabulary[k] for k in used.tolist()], n[0][used], n[1][used], order), Pairs.fit(texts, toxic, len(vocabulary))


def _rows(model: KneserNey, pairs: Pairs, vocabulary: list[bytes], texts: list[np.ndarray]) -> np.ndarray:
    logs = np.concatenate([np.zeros((2, 0)), *(model.logs(vocabulary[k : k + SLICE_WORDS]) for k in range(0, len(vocabulary), SLICE_WORDS))], 1)
    alone = logs[1] - logs[0]
    return np.array([features(alone[t], pairs.ratios(t.astype(np.int64), np.array([0] if len(t) else [], np.int64), logs[:, t])) for t in texts]).reshape(-1, FEATURES)


def fit_texts(texts: list[str | None], toxic: list[int], share: float, order: int = 10) -> Scorer:
    """A scorer from labelled texts; ``share`` is the share of label 1 among all training labels.

    Two halves each score the other for the logistic weights, so that these see ratios of unseen texts; the
    model that scores has all. Without texts of both labels every probability is the share.
    """
    y, number = np.array(toxic, np.int64), {}
    found = [np.fromiter((number.setdefault(w, len(number)) for w in words(t)), np.int32) for t in texts]
    vocabulary = list(number)
    bias = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    if not len(y) or y.min() == y.max():
        return Scorer(KneserNey.fit([], np.zeros(0), np.zeros(0), order), Pairs.fit([], np.zeros(0), 0), {}, np.zeros(FEATURES), bias, np.zeros(FEATURES), np.ones(FEATURES))
    half = np.zeros(len(y), np.int64)
    for k in (0, 1):
        half[np.flatnonzero(y == k)] = np.arange((y == k).sum()) % 2
    rows = np.zeros((len(y), FEATURES))
    for h in (0, 1):
        train, test = np.flatnonzero(half != h), np.flatnonzero(half == h)
        models = _fit_counts(vocabulary, [found[i] for i in train], y[train], order)
        rows[test] = _rows(*models, vocabulary, [found[i] for i in test])
        del models
    mean, scale = rows.mean(0), rows.std(0) + 1e-9
    design = np.concatenate([(rows - mean) / scale, np.ones((len(y), 1))], 1)
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    w = np.r_[np.zeros(FEATURES), bias]
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (weight * (y - p)) - np.r_[np.ones(FEATURES), 0] * w
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + np.diag([*[1] * FEATURES, 1e-9])
        w = w + np.linalg.solve(hessian, gradient)
    return Scorer(*_fit_counts(vocabulary, found, y, order), number, w[:FEATURES], float(w[FEATURES]), mean, scale)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_toxic: int = 1_000, most_ordinary: int = 2_000, most_bytes: int = 1_000_000, most_total: int = 64 << 20, order: int = 10) -> Fitted:
    """Fits on at most ``most_toxic`` and ``most_ordinary`` labelled texts of up to ``most_bytes``, in hash order of the id, as
    far as ``most_total`` bytes go.

    These bounds keep the model's size fixed; the share of toxic labels comes from all labels given. The sample is fitted in
    one task; only the finished models pass through the driver, as compressed bytes. Null ids, labels and texts are left out.
    """
    ship(docs.sparkSession)
    clean = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).cast("int").alias("toxic"))
    n = {r["toxic"]: r["count"] for r in clean.groupBy("toxic").count().collect()}
    share = n.get(1, 0) / max(1, sum(n.values()))
    order_by = [F.xxhash64(id_col), F.col(id_col)]
    chosen = clean.where("toxic = 1").orderBy(*order_by).limit(most_toxic).unionByName(clean.where("toxic = 0").orderBy(*order_by).limit(most_ordinary))
    chosen = chosen.withColumnRenamed(id_col, "_id")
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.octet_length("_text") <= most_bytes)
    sample = texts.join(F.broadcast(chosen), "_id").select(F.xxhash64("_id").alias("_k"), "_id", "_text", "toxic").repartition(1).sortWithinPartitions("_k", "_id", "_text").select("_text", "toxic")

    def fitted(batches):
        kept("")
        found, toxic, left = [], [], most_total
        for batch in batches:
            for text, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                left -= len(text.encode("utf-8", "replace"))
                if left >= 0:
                    found.append(text)
                    toxic.append(y)
        raw = _squeezed(fit_texts(found, toxic, share, order))
        del found
        release()
        for k, at in enumerate(range(0, len(raw), PART_BYTES)):
            yield pa.record_batch([pa.array([k]), pa.array([raw[at : at + PART_BYTES]], pa.binary())], names=["part", "body"])

    body = bytearray()
    # one partition, whose parts come in order and one at a time
    for row in sample.mapInArrow(fitted, "part long, body binary").toLocalIterator():
        body += row["body"]
    return Fitted(bytes(body)) if body else Fitted.of(fit_texts([], [], share, order))


def score(docs: DataFrame, fitted: Fitted, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with ``out``, which must be no column of theirs: the probability of label 1, from whole texts. Null and empty texts have no words.

    One pass without a shuffle; the model is of bounded size and goes to each worker once.
    """
    ship(docs.sparkSession)
    shared = fitted.shared(docs.sparkSession)
    at = docs.columns.index(text_col)
    cache: list[_Known] = []

    def run(batches):
        if not cache:
            kept("")
            cache.append(_Known(shared.value))
            release()
        known = cache[0]
        for batch in parts(batches, at, 1 << 20):
            rows = known.rows([words(t) for t in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(known.scorer.probability(np.array(rows).reshape(-1, FEATURES)))], names=[*batch.schema.names, out])

    if out in docs.columns:
        raise ValueError(f"the table has a column {out}")
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))
