"""Benchmark decontamination: CGK embedding of word windows, bit-sampling LSH, exact edit verification."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from .common import parts

#: A-Z become lower case; what is no letter, digit or byte from 0x80 on divides words.
_WORDS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_WORDS).split()


def allowed(n: int, similarity: float) -> int:
    """How many word edits an item of n words may have."""
    return int((1 - similarity) * n + 1e-9)


def _mix(a: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        v = (a.astype(np.uint64) + np.uint64(salt & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
        v = (v ^ (v >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return v ^ (v >> np.uint64(29))


def embed(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, steps: int, seed: int) -> np.ndarray:
    """CGK walks (len(starts), steps) over symbols[start:end]: each step writes the symbol under the pointer, which
    moves on if a random bit of (step, symbol) is 1; past the end it writes 0."""
    at = starts.copy()
    out = np.zeros((len(starts), steps), np.int64)
    for step in range(steps):
        inside = at < ends
        now = np.where(inside, symbols[np.minimum(at, len(symbols) - 1)], 0)
        out[:, step] = now
        at += (_mix(now, (seed << 20) + step) & np.uint64(1)).astype(np.int64) & inside
    return out


def best_window(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int]:
    """(edits, start, end) of the stretch of region nearest item: exact, least edits, then earliest end."""
    m = len(region)
    step = np.arange(m + 1)
    cost, origin = np.zeros(m + 1, np.int64), step.copy()
    value, source = cost.copy(), step.copy()
    for k, symbol in enumerate(item.tolist(), 1):
        diagonal = cost[:-1] + (region != symbol)
        up = cost[1:] + 1
        value[0] = k
        np.minimum(diagonal, up, out=value[1:])
        source[0] = origin[0]
        source[1:] = np.where(diagonal <= up, origin[:-1], origin[1:])
        value -= step
        low = np.minimum.accumulate(value)
        last = np.maximum.accumulate(np.where(value == low, step, 0))
        cost, origin = low + step, source[last]
    end = int(np.argmin(cost))
    return int(cost[end]), int(origin[end]), end


#: Longer items are sought by pieces of about so many words. Of an item within its edits at least one piece is within its own
#: (else they would add up to more), and the walks of short pieces stay close under insertions and deletions.
PIECE = 16


@dataclass
class Group:
    """Pieces of like length, with the LSH tables of their embeddings."""

    low: int
    high: int
    q: int
    need: int
    slack: int
    items: list[int]
    grams: np.ndarray
    tables: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    samples: list[tuple[int, np.ndarray]] = field(default_factory=list)


class Index:
    """Benchmark items by length: the exact q-gram count filter and repeated bit samples of CGK embeddings.

    A window within k edits of an item of n words shares at least n - q + 1 - kq of its q-grams, so no
    window that matters fails the filter; it leaves few starts to be embedded.
    """

    def __init__(self, items: list[tuple[int, str]], similarity: float, seeds: int, repeats: int, sampled: int):
        self.similarity, self.vocabulary = similarity, {}
        self.ids, self.items = [], []
        self.own_grams: dict[int, np.ndarray] = {}
        for item_id, text in items:
            found = words(text)
            if found:
                self.ids.append(item_id)
                self.items.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in found], np.int64))
        self.base = len(self.vocabulary) + 2
        self.groups = []
        # a piece: its item, its place there, its words
        self.pieces: list[tuple[int, int, np.ndarray]] = []
        for k, item in enumerate(self.items):
            n = -(-len(item) // PIECE) if len(item) > 3 * PIECE // 2 else 1
            cuts = [len(item) * i // n for i in range(n + 1)]
            self.pieces += [(k, a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        by_length: dict[int, list[int]] = {}
        for k, (_, _, piece) in enumerate(self.pieces):
            by_length.setdefault(self._class(len(piece)), []).append(k)
        for _, members in sorted(by_length.items()):
            self.groups.append(self._group(members, seeds, repeats, sampled))

    @staticmethod
    def _class(n: int) -> int:
        return int(np.log(n) / np.log(1.25) + 1e-9) if n > 4 else -n

    def _need(self, n: int, q: int) -> int:
        return n - q + 1 - allowed(n, self.similarity) * q

    def grams(self, symbols: np.ndarray, q: int) -> np.ndarray:
        code = symbols[: max(0, len(symbols) - q + 1)].copy()
        ok = code > 0
        for k in range(1, q):
            part = symbols[k : len(symbols) - q + 1 + k]
            code, ok = code * self.base + part, ok & (part > 0)
        return np.where(ok, code, -1)

    def _group(self, members: list[int], seeds: int, repeats: int, sampled: int) -> Group:
        lengths = [len(self.pieces[k][2]) for k in members]
        low, high = min(lengths), max(lengths)
        q = next((q for q in (3, 2, 1) if min(self._need(n, q) for n in lengths) >= 1 and self.base**q < 2**62), 1)
        need = max(1, min(self._need(n, q) for n in lengths))
        slack = max(allowed(n, self.similarity) for n in lengths)
        grams = np.unique(np.concatenate([self.grams(self.pieces[k][2], q) for k in members]))
        group = Group(low, high, q, need, slack, members, grams)
        flat = np.concatenate([self.pieces[k][2] for k in members])
        ends = np.cumsum(lengths)
        starts = ends - lengths
        rng = np.random.default_rng(low)
        for seed in range(seeds):
            walks = embed(flat, starts, ends, 2 * low, seed)
            for _ in range(repeats):
                places = np.sort(rng.choice(2 * low, min(sampled, 2 * low), replace=False))
                keys = self.keys(walks, places)
                order = np.argsort(keys, kind="stable")
                group.samples.append((seed, places))
                group.tables.append((keys[order], np.array(members)[order]))
        return group

    @staticmethod
    def keys(walks: np.ndarray, places: np.ndarray) -> np.ndarray:
        out = np.zeros(len(walks), np.uint64)
        for k, place in enumerate(places.tolist()):
            out = _mix(walks[:, place] ^ out.view(np.int64), k + 1)
        return out

    def starts(self, at: np.ndarray, code: np.ndarray, group: Group, size: int) -> np.ndarray:
        """Starts of windows with at least ``need`` q-grams of the group's items; code[i] is the gram at place at[i]."""
        row = np.minimum(np.searchsorted(group.grams, code), len(group.grams) - 1)
        hit = at[group.grams[row] == code]
        if len(hit) < group.need:
            return hit[:0]
        span = group.high + group.slack
        first, last = hit[: len(hit) - group.need + 1], hit[group.need - 1 :]
        near = last - first < span
        marks = np.zeros(size + 1, np.int64)
        np.add.at(marks, np.maximum(0, last[near] - span + 1), 1)
        np.add.at(marks, np.minimum(first[near] + 1, size), -1)
        return np.flatnonzero(np.cumsum(marks[:-1]) > 0)

    def search(self, texts: list[list[bytes]]) -> list[tuple[int, int, int, int, int, int]]:
        """(text number, item number, start, words, edits, item words), the best stretch of each pair within the edits allowed."""
        get, zero = self.vocabulary.get, repeat(0)
        gap = 3  # zeros between texts, so that no q-gram spans two
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        begins = np.cumsum(sizes + gap) - sizes - gap
        flat = np.zeros(int((sizes + gap).sum()), np.int64)
        for begin, ws in zip(begins.tolist(), texts, strict=True):
            flat[begin : begin + len(ws)] = np.fromiter(map(get, ws, zero), np.int64, len(ws))
        pairs: dict[tuple[int, int], set[int]] = {}
        for q in {g.q for g in self.groups}:
            groups = [g for g in self.groups if g.q == q]
            code = self.grams(flat, q)
            at = np.flatnonzero(code >= 0)
            code = code[at]
            for group in groups:
                starts = self.starts(at, code, group, len(flat))
                starts = starts[flat[starts] >= 0]
                if not len(starts):
                    continue
                text_of = np.searchsorted(begins, starts, "right") - 1
                ends = np.minimum((begins + sizes)[text_of], starts + group.high + group.slack)
                inside = starts < ends
                starts, text_of, ends = starts[inside], text_of[inside], ends[inside]
                for part in range(0, len(starts), 50_000):
                    s, e, t = starts[part : part + 50_000], ends[part : part + 50_000], text_of[part : part + 50_000]
                    walks, seed_of = None, None
                    for (seed, places), (keys, members) in zip(group.samples, group.tables, strict=True):
                        if seed != seed_of:
                            walks, seed_of = embed(flat, s, e, 2 * group.low, seed), seed
                        mine = self.keys(walks, places)
                        left, right = np.searchsorted(keys, mine, "left"), np.searchsorted(keys, mine, "right")
                        for row in np.flatnonzero(right > left).tolist():
                            for piece in members[left[row] : right[row]].tolist():
                                item, offset, _ = self.pieces[piece]
                                pairs.setdefault((int(t[row]), item), set()).add(int(s[row]) - offset)
        out = []
        for (k, item), hits in pairs.items():
            begin = int(begins[k])
            out += self._verified(k, item, sorted(h - begin for h in hits), flat[begin : begin + int(sizes[k])])
        return out

    def _may_hold(self, item: int, region: np.ndarray) -> bool:
        """The exact q-gram count filter for a whole item: without that many of its grams a region is beyond its edits."""
        n = len(self.items[item])
        q = next((q for q in (3, 2, 1) if self._need(n, q) >= 1 and self.base**q < 2**62), 0)
        if not q:
            return True
        if item not in self.own_grams:
            self.own_grams[item] = np.unique(self.grams(self.items[item], q))
        own, code = self.own_grams[item], self.grams(region, q)
        return int((own[np.minimum(np.searchsorted(own, code), len(own) - 1)] == code).sum()) >= self._need(n, q)

    def _verified(self, k: int, item: int, hits: list[int], symbols: np.ndarray):
        target = self.items[item]
        n, most = len(target), allowed(len(target), self.similarity)
        for h in hits:
            if 0 <= h <= len(symbols) - n and symbols[h] == target[0] and np.array_equal(symbols[h : h + n], target):
                return [(k, item, h, n, 0, n)]
        best = None
        a = b = None
        for h in [*hits, None]:
            if a is not None and (h is None or h - 2 * most > b):
                edits, start, end = best_window(target, symbols[a:b]) if self._may_hold(item, symbols[a:b]) else (most + 1, 0, 0)
                if edits <= most and (best is None or edits < best[0]):
                    best = (edits, a + start, end - start)
                a = b = None
            if h is not None:
                # a piece's own place may be off by the edits before it
                a, b = max(0, h - 2 * most) if a is None else a, min(len(symbols), h + n + 3 * most)
        return [(k, item, best[1], best[2], best[0], n)] if best else []


_OUT = pa.schema([("item_id", pa.int64()), ("start_word", pa.int64()), ("window_words", pa.int64()), ("edits", pa.int64()), ("similarity", pa.float64())])


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similarity: float = 0.8, seeds: int = 6, repeats: int = 8, sampled: int = 3, block_bytes: int = 4 << 20) -> DataFrame:
    """One row per (document, item) whose best stretch of words is within (1 - similarity) * item words edits.

    Columns: id, item_id, start_word, window_words, edits (insert, delete, replace a word), similarity.
    Items are taken in blocks of about ``block_bytes`` of text, so the index that goes to the workers has a
    bound; each block is one pass over whole documents without a shuffle. Exact copies share all
    samples; edited ones share one with the recall that seeds, repeats and sampled give (tested at 0.9 and
    more), and each reported distance is exact. Null and empty texts and items match nothing; repeated rows give repeated
    rows; other columns are left out.
    """
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    schema = f"`{id_col}` {kind}, item_id long, start_word long, window_words long, edits long, similarity double"
    found = None
    for shared in _blocks(docs.sparkSession, benchmark, item_col, item_text_col, similarity, seeds, repeats, sampled, block_bytes):

        def run(batches, shared=shared):
            index = shared.value
            for batch in parts(batches, 1):
                ids, hits = batch.column(0), sorted(index.search([words(t) for t in batch.column(1).to_pylist()]))
                k, item, start, size, edits, n = (np.array([h[c] for h in hits], np.int64) for c in range(6))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(k)), pa.array(np.array(index.ids, np.int64)[item] if len(item) else item), pa.array(start), pa.array(size), pa.array(edits), pa.array(1 - edits / np.maximum(n, 1))], names=[id_col, *_OUT.names])

        part = docs.select(id_col, text_col).mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return found


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similarity: float = 0.8, seeds: int = 6, repeats: int = 8, sampled: int = 3, block_bytes: int = 4 << 20) -> DataFrame:
    """docs without the rows in whose text ``find`` finds an item; their other columns play no part.

    Each row is judged by its own text, so null ids and ids that repeat need no care. Null and empty texts stay.
    """
    for shared in _blocks(docs.sparkSession, benchmark, item_col, item_text_col, similarity, seeds, repeats, sampled, block_bytes):
        at = docs.columns.index(text_col)

        def run(batches, shared=shared, at=at):
            index = shared.value
            for batch in parts(batches, at):
                stays = np.ones(batch.num_rows, bool)
                stays[[h[0] for h in index.search([words(t) for t in batch.column(at).to_pylist()])]] = False
                yield batch.filter(pa.array(stays))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def _blocks(spark, benchmark: DataFrame, item_col: str, text_col: str, similarity: float, seeds: int, repeats: int, sampled: int, block_bytes: int):
    """The indexes of the items' blocks, each as a broadcast of bounded size; one empty index if there are no items."""
    ship(spark)
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).alias("body")).where("item IS NOT NULL AND body IS NOT NULL").distinct()
    total = items.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    n_blocks = max(1, -(-total // block_bytes))
    blocks = items.withColumn("block", F.pmod(F.xxhash64("item", "body"), F.lit(n_blocks)).cast("int"))
    for block in range(n_blocks):
        rows = sorted((r["item"], r["body"]) for r in blocks.where(F.col("block") == block).collect())
        yield spark.sparkContext.broadcast(Index(rows, similarity, seeds, repeats, sampled))
