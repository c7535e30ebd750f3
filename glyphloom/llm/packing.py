"""Packing token sequences into windows: non-negative least squares over shallow length combinations."""

from __future__ import annotations

import base64
import zlib
from array import array
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from .common import Scratch, kept, numbered, parts, salts

#: The letters, digits and white space up to U+024F as the split pattern below has them.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", r"\t-\r\x20\x85\xa0"
#: The vocabulary's one special token, which is found in any text, and its id.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
#: The byte-level split pattern for texts up to U+024F, for the faster of the two pattern libraries.
NEAR_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
#: A worker keeps the ids of at most so many different words; then it starts anew.
CACHE_WORDS = 250_000


class ByteBPE:
    """Token ids of the byte-level vocabulary as little-endian 32-bit bytes.

    Cuts out the special token, splits the rest as the vocabulary's tokenizer does and merges each different word once; equal to
    ``Tokenizer.from_file(byte_bpe_50k.json)`` with add_special_tokens=False (a test holds random texts of
    control characters, all white space and the special token against it), several times faster.
    """

    def __init__(self, ranks_file: str, pattern: str):
        import re

        import regex
        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = ranks
        self.encoding = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.near, self.far, self.beyond = re.compile(NEAR_PATTERN).findall, regex.compile(pattern).findall, re.compile("[^\x00-ɏ]").search
        single = getattr(self.encoding._core_bpe, "encode_single_piece", None)
        self.merge = single or (lambda piece: self.encoding.encode_ordinary(piece.decode()))
        outer = self

        class Words(dict):
            def __missing__(self, word):
                raw = word.encode("utf-8", "replace")
                rank = outer.ranks.get(raw)
                ids = array("I", (rank,) if rank is not None else outer.merge(raw))
                out = self[word] = ids.tobytes()
                return out

        self.words = Words()

    def encode(self, text: str) -> bytes:
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        split = self.far if self.beyond(text) else self.near
        ids = [b"".join(map(self.words.__getitem__, split(part))) for part in text.split(SPECIAL)]
        return SPECIAL_ID.to_bytes(4, "little").join(ids)


def load_tokenizer(ranks_file: str | None = None) -> ByteBPE:
    """The worker's tokenizer; by default the installed public vocabulary."""
    import public_tokenizers

    name = ranks_file or public_tokenizers.path("byte_bpe_50k.tiktoken")
    loaded = kept("packing")
    if name not in loaded:
        loaded[name] = ByteBPE(name, public_tokenizers.PATTERN)
    return loaded[name]


def binary_parts(length: int) -> list[int]:
    """The powers of two that add up to length, largest first."""
    return [1 << k for k in range(length.bit_length() - 1, -1, -1) if length >> k & 1]


# --- the plan: from a histogram of lengths to ranges of pieces -------------------------------------


@dataclass
class Plan:
    """placed: (length, from, to, first sequence, offset); the n-th piece of that length with from <= n < to
    lies in sequence first + n - from. cut: (length, from, to, {part size: first index of its class}).
    classes: per part size (sequences' first id, parts placed in whole windows); tail: (size, index) -> (sequence, offset)."""

    window: int
    placed: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    cut: list[tuple[int, int, int, dict[int, int]]] = field(default_factory=list)
    classes: dict[int, tuple[int, int]] = field(default_factory=dict)
    tail: dict[tuple[int, int], tuple[int, int]] = field(default_factory=dict)
    sequences: int = 0


def combinations(lengths: np.ndarray, window: int, spread: int = 16) -> np.ndarray:
    """Rows of three lengths, ascending, 0 for none, that add up to the window: every pair, and one in ``spread`` triples.

    The triples are dealt evenly over all of them; more would leave each with less than one repeat.
    """
    have = np.zeros(window + 1, bool)
    have[lengths] = True
    a = lengths[lengths < window].astype(np.int64)
    if not len(a):
        return np.zeros((0, 3), np.int64)
    pairs = np.stack([np.zeros_like(a), a, window - a], 1)
    pairs = pairs[(pairs[:, 1] <= pairs[:, 2]) & have[pairs[:, 2]]]
    x, y = np.meshgrid(a, a, indexing="ij")
    keep = (x <= y) & (window - x - y >= y) & ((x * 7 + y * 3) % spread == 0)
    x, y = x[keep], y[keep]
    z = window - x - y
    return np.concatenate([pairs, np.stack([x, y, z], 1)[have[z]]])


def solve_nnls(combos: np.ndarray, counts: np.ndarray, rounds: int = 1500) -> np.ndarray:
    """Repeat counts x >= 0 that bring sum x_s * combo_s nearest the histogram in least squares.

    Accelerated projected gradient; the matrix is only ever the three row numbers of each column.
    """
    size, target = len(counts), counts.astype(float).copy()
    target[0] = 0
    flat, columns = combos.ravel(), combos.shape[0]

    def product(x: np.ndarray) -> np.ndarray:
        out = np.bincount(flat, np.repeat(x, 3), size)
        out[0] = 0
        return out

    def transposed(rest: np.ndarray) -> np.ndarray:
        return rest[flat].reshape(-1, 3).sum(1)

    v = np.ones(columns)
    for _ in range(30):
        v = transposed(product(v))
        top = float(np.linalg.norm(v))
        v /= top
    x = y = np.zeros(columns)
    t = 1.0
    for _ in range(rounds):
        rest = target - product(y)
        after = np.maximum(0, y + transposed(rest) / (1.02 * top))
        if float((after - x) @ (after - y)) < 0:
            t = 1.0
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = after + (t - 1) / s * (after - x), after, s
    return x


def make_plan(histogram: dict[int, int], window: int = 1024) -> Plan:
    """Places every piece of a histogram {length: pieces}, window and lengths up to it.

    1. Full windows stand alone. 2. The repeat counts of combinations of two or three lengths that
    fill the window come from non-negative least squares, rounded, and cut to what is there.
    3. Residuals are packed greedily, longest first with the longest that still fit. 4. A greedy
    sequence that is neither full nor a power of two is not padded: its pieces are cut into
    powers of two, which fill windows exactly; what is left in the end, under one window, makes
    sequences of a power of two each. Work and size depend on the window, not on the counts.
    """
    plan = Plan(window)
    left = np.zeros(window + 1, np.int64)
    for length, n in histogram.items():
        left[length] += n
    used = np.zeros(window + 1, np.int64)

    def take(pattern: list[int], times: int, at: int = 0) -> None:
        for length in pattern:
            plan.placed.append((length, int(used[length]), int(used[length]) + times, plan.sequences, at))
            used[length] += times
            left[length] -= times
            at += length
        plan.sequences += times

    if left[window]:
        take([window], int(left[window]))
    combos = combinations(np.flatnonzero(left[:window]), window)
    if len(combos):
        x = solve_nnls(combos, left)
        for k in np.lexsort((np.arange(len(x)), -x)):
            pattern = [int(v) for v in combos[k] if v]
            times = int(round(float(x[k])))
            for length in set(pattern):
                times = min(times, int(left[length]) // pattern.count(length))
            if times > 0:
                take(pattern, times)
    parts: dict[int, int] = {}
    for length in range(window, 0, -1):
        while left[length]:
            pattern, room = [length], window - length
            for other in range(min(room, length), 0, -1):
                if other > room:
                    continue
                fit = min(room // other, int(left[other]) - pattern.count(other))
                pattern += [other] * fit
                room -= other * fit
            times = min(int(left[v]) // pattern.count(v) for v in set(pattern))
            filled = window - room
            if room == 0 or filled & (filled - 1) == 0:
                take(pattern, times)
                continue
            for v in pattern:
                first = {}
                for p in binary_parts(v):
                    first[p] = parts.get(p, 0)
                    parts[p] = first[p] + times
                plan.cut.append((v, int(used[v]), int(used[v]) + times, first))
                used[v] += times
                left[v] -= times
    rest = []
    for p in sorted(parts, reverse=True):
        a_window = max(1, window // p)
        whole = parts[p] // a_window * a_window if p <= window else 0
        plan.classes[p] = (plan.sequences, whole)
        plan.sequences += whole // a_window
        rest += [(p, k) for k in range(whole, parts[p])]
    total = sum(p for p, _ in rest)
    rooms = [window] * (total // window) + binary_parts(total % window)
    at, room = 0, iter(rooms)
    now = next(room, 0)
    for p, k in rest:
        if at == now:
            plan.sequences, at, now = plan.sequences + 1, 0, next(room)
        plan.tail[(p, k)] = (plan.sequences, at)
        at += p
    plan.sequences += bool(rest)
    return plan


# --- the distributed passes ---------------------------------------------------------------------


_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("part_crc32", pa.list_(pa.int64()))])
_PLACED = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def _cut_documents(batches, window: int, ranks_file: str | None):
    tokenizer = load_tokenizer(ranks_file)
    end = b"\0\0\0\0"
    for batch in parts(batches, 1, owner="packing"):
        rows: list[list] = [[] for _ in _PIECES]
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = tokenizer.encode(text or "") + end
            n = len(ids) // 4
            for start in range(0, n, window):
                piece = ids[4 * start : 4 * (start + window)]
                length, at, codes = len(piece) // 4, 0, []
                if length < window:
                    for p in binary_parts(length):
                        codes.append(zlib.crc32(piece[4 * at : 4 * (at + p)]))
                        at += p
                for column, value in zip(rows, (doc_id, start, length, zlib.crc32(piece), n, codes), strict=True):
                    column.append(value)
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(rows, _PIECES, strict=True)], schema=_PIECES)


def _place(batches, plan: Plan):
    ranges: dict[int, list] = {}
    for length, a, b, sequence, offset in plan.placed:
        ranges.setdefault(length, []).append((a, b, sequence, offset, None))
    for length, a, b, first in plan.cut:
        ranges.setdefault(length, []).append((a, b, 0, 0, first))
    starts = {}
    for length, found in ranges.items():
        found.sort(key=lambda r: r[0])
        starts[length] = np.array([r[0] for r in found])
    for batch in batches:
        rows: list[list] = [[] for _ in _PLACED]
        for doc_id, start, length, crc, tokens, codes, rank in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            a, _, sequence, offset, first = ranges[length][int(np.searchsorted(starts[length], rank, "right")) - 1]
            if first is None:
                out = [(start, length, crc, sequence + rank - a, offset)]
            else:
                out, at = [], start
                for p, code in zip(binary_parts(length), codes, strict=True):
                    k = first[p] + rank - a
                    base, whole = plan.classes[p]
                    per = plan.window // p
                    where = (base + k // per, k % per * p) if k < whole else plan.tail[(p, k)]
                    out.append((at, p, code, *where))
                    at += p
            for s, n, c, q, o in out:
                for column, value in zip(rows, (doc_id, s, n, c, tokens, q, o), strict=True):
                    column.append(value)
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(rows, _PLACED, strict=True)], schema=_PLACED)


def pack(docs: DataFrame, window: int = 1024, id_col: str = "doc_id", text_col: str = "text", ranks_file: str | None = None) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its token ids and a final id 0, cut into whole windows and one remainder. The
    histogram of remainders, at most ``window`` numbers, goes to the driver, which makes the plan
    (see make_plan); pieces are numbered within each length, however many share it, and look their
    place up. Null and empty texts are the one id 0; null ids stay null, and ids that are no numbers become null; repeated
    rows are packed each; other columns are left out. An empty table gives no rows. The window is a power of two.
    """
    if window < 2 or window & (window - 1):
        raise ValueError("window is a power of two")
    ship(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "pack")
    cut = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(lambda b: _cut_documents(b, window, ranks_file), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part_crc32 array<long>")
    pieces = scratch.keep(cut, "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = make_plan(histogram, window)
    ranked = numbered(pieces, ["length"], ["doc_id", "start", "ids_crc32", "doc_tokens"], "rank", salts(sum(histogram.values())))
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "part_crc32", "rank")
    out = ranked.mapInArrow(lambda b: _place(b, plan), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("doc_id", id_col)
