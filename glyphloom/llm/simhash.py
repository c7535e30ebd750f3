"""SimHash near-dedup with Golay-code fuzzy keys."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from . import exact_dedup
from .common import Scratch, components, contracted, parts, release

#: A bucket of more fingerprints is compared in blocks of this size, each pair of blocks on its own.
BLOCK = 2048
#: Lower-cases A-Z in UTF-8 bytes.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: str | None, shingle: int, seed: int) -> np.ndarray:
    """XXH64 of every run of ``shingle`` words, repeats included; of all words if there are fewer; none without words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxh64_intdigest(joined, seed)] if words else [], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    last = len(words) - shingle + 1
    return np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[:last].tolist(), ends[shingle - 1 :].tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """64 bits; a bit is 1 if set in over half of the hashes. 0 for none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(sum(1 << k for k in np.flatnonzero(2 * ones > len(hashes)).tolist()))


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    return majority(shingle_hashes(text, shingle, seed))


def _mixed(hashes: np.ndarray) -> np.ndarray:
    """A second hash of each hash."""
    with np.errstate(over="ignore"):
        v = (hashes ^ (hashes >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return v ^ (v >> np.uint64(31))


# --- the binary Golay code (23, 12) -------------------------------------------------------------


def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(syndrome of each low and high part, error patterns (2048, 6), how many) of the code of x^11+x^9+x^7+x^6+x^5+x+1.

    The patterns of a syndrome lead to all codewords within distance 4 of a vector: one if the nearest
    is within 2, else six. Vectors within distance 2 of each other always share one of theirs.
    """
    poly = 0b101011100011

    def rest(v: int) -> int:
        for k in range(22, 10, -1):
            if v >> k & 1:
                v ^= poly << (k - 11)
        return v

    unit = [rest(1 << k) for k in range(23)]
    syndrome = np.zeros(1 << 12, np.int64)
    high = np.zeros(1 << 12, np.int64)
    for v in range(1 << 12):
        for k in range(12):
            if v >> k & 1:
                syndrome[v] ^= unit[k]
                if k < 11:
                    high[v] ^= unit[k + 12]
    from itertools import combinations

    leaders: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            s = e = 0
            for k in bits:
                s ^= unit[k]
                e |= 1 << k
            if weight < 3 or weight == 3 and not leaders[s] or weight == 4 and leaders[s][0].bit_count() == 3:
                leaders[s].append(e)
    n = np.array([len(x) for x in leaders])
    table = np.array([x + [x[0]] * (6 - len(x)) for x in leaders], np.int64)
    return np.stack([syndrome, high]), table, n


_TABLES: list = []


def golay_keys(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For 23-bit vectors: (N, 6) 12-bit codeword indices and how many of the six count."""
    if not _TABLES:
        _TABLES.extend(_golay())
    syndrome, table, n = _TABLES
    s = syndrome[0][segment & 0xFFF] ^ syndrome[1][segment >> 12]
    return (segment[:, None] ^ table[s]) >> 11, n[s]


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) pairs such that fingerprints within 4 bits share a key.

    The segments have 23, 23 and 18 bits (the last filled up with zeros for the code). Four errors at
    most leave either two segments with 0 and at most 2 errors - a key for each ordered pair: the
    first one's bits and each codeword index near the second - or 1, 1 and at most 2 in any order: codeword
    indices of the first two, with one of the three 6-bit thirds of the last, of which one is free of errors.
    """
    segments = [(prints & np.uint64(0x7FFFFF)).astype(np.int64), (prints >> np.uint64(23) & np.uint64(0x7FFFFF)).astype(np.int64), (prints >> np.uint64(46)).astype(np.int64)]
    near = [golay_keys(s) for s in segments]
    out_keys, out_rows = [], []
    index = np.arange(len(prints))
    kind = 0
    for i in range(3):
        for j in range(3):
            if i == j:
                continue
            for k in range(6):
                on = index if k == 0 else np.flatnonzero(near[j][1] > k)
                out_keys.append(kind << 40 | segments[i][on] << 12 | near[j][0][on, k])
                out_rows.append(on)
            kind += 1
    for a in range(6):
        for b in range(6):
            on = np.flatnonzero((near[0][1] > a) & (near[1][1] > b))
            pair = near[0][0][on, a] << 12 | near[1][0][on, b]
            for third in range(3):
                out_keys.append((kind + third) << 40 | (segments[2][on] >> 6 * third & 63) << 24 | pair)
                out_rows.append(on)
    return np.concatenate(out_keys), np.concatenate(out_rows)


#: Fingerprints of a near copy's search, and the plain bits beside the codeword in each of their 32-bit halves: at a Jaccard similarity of
#: 0.8 two halves share a key with probability 0.268 or more, so a pair shares none of 34 with probability 2.4e-5.
PRINTS, PLAIN = 17, 5
#: Further fingerprints, of which no key is made: what pairs that share a key are compared by. Two unrelated sets that share a key are alike in the
#: key's own bits, so a comparison by these would let a share of such pairs through whose number grows with the square of the documents'.
CHECKS = 3
#: Keys are made of so many fingerprints at a time, so that the shuffle files of some go before others come.
AT_ONCE = 9
#: Byte -> its bits as the bytes of one number.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(hashes: np.ndarray, n: int = PRINTS) -> np.ndarray:
    """n independent fingerprints of one set: the majority of its hashes, of their second hashes and so on."""
    words = np.empty((len(hashes), n), np.uint64)
    for k in range(n):
        words[:, k], hashes = hashes, _mixed(hashes)
    raw, ones = words.astype("<u8").view(np.uint8), np.zeros(64 * n, np.int64)
    for at in range(0, len(raw), 255):
        ones += _SPREAD[raw[at : at + 255]].sum(0).view(np.uint8)
    return np.packbits(2 * ones > len(words), bitorder="little").view(np.uint64)


def wide_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) pairs for rows of fingerprints farther apart: of each half of each fingerprint the codeword indices near
    its 23 low bits, each with PLAIN of the bits above."""
    out_keys, out_rows = [], []
    index = np.arange(len(prints))
    for kind in range(2 * prints.shape[1]):
        half = (prints[:, kind // 2] >> np.uint64(kind % 2 * 32) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        near, n = golay_keys(half & 0x7FFFFF)
        rest = kind << 12 + PLAIN | half >> 23 & (1 << PLAIN) - 1
        for k in range(6):
            on = index if k == 0 else np.flatnonzero(n > k)
            out_keys.append(rest[on] | near[on, k] << PLAIN)
            out_rows.append(on)
    return np.concatenate(out_keys), np.concatenate(out_rows)


def bands(hashes: np.ndarray, places: int = 64) -> np.ndarray:
    """The wide keys of one set in places, so that sets that are equal at a place share a key. Of keys that meet in a place
    the largest takes it (the search itself uses all keys); a free place holds a number of the set's own."""
    prints = fingerprints(hashes)
    out = np.full(2 * PRINTS * places, -1 - (nodes(prints[None])[0] >> np.uint64(1)).astype(np.int64))
    key, _ = wide_keys(prints[None])
    np.maximum.at(out, (key >> 12 + PLAIN) * places + (key >> PLAIN) % places, key)
    return out


# --- verification inside buckets -----------------------------------------------------------------


def nodes(prints: np.ndarray) -> np.ndarray:
    """One number for each row of fingerprints: the fingerprint itself, or a hash of several."""
    out = prints[:, 0]
    for k in range(1, prints.shape[1]):
        out = _mixed(out) ^ prints[:, k]
    return out


def _near(a: np.ndarray, b: np.ndarray, most: int, total: int) -> np.ndarray:
    """Whether rows (..., fingerprints) are within ``most`` bits in each fingerprint and ``total`` in all."""
    near, bits = True, np.int16(0)
    for k in range(a.shape[-1]):
        own = np.bitwise_count(a[..., k] ^ b[..., k])
        near, bits = near & (own <= most), bits + own.astype(np.int16)
    return near & (bits <= total)


def link(prints: np.ndarray, other: np.ndarray | None, most: int, total: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of rows that are near (see _near), as nodes (member, smallest member of its tree).

    ``other``: rows that need no comparing with each other. No more links than members, whatever the pairs.
    """
    everyone = prints if other is None else np.concatenate([prints, other])
    near = _near(prints[:, None], everyone[None], most, total)
    n = len(prints)
    parent = list(range(len(everyone)))
    pending = np.ones(len(everyone), bool)
    for start in range(n):
        if not pending[start]:
            continue
        pending[start] = False
        queue = [start]
        while queue:
            v = queue.pop()
            found = np.flatnonzero(near[v] & pending) if v < n else np.flatnonzero(near[:, v] & pending[:n])
            pending[found] = False
            for u in found.tolist():
                parent[u] = start
                queue.append(u)
    low: dict[int, int] = {}
    values = nodes(everyone).tolist()
    for v, x in enumerate(values):
        low[parent[v]] = min(low.get(parent[v], x), x)
    return [(x, low[parent[v]]) for v, x in enumerate(values) if x != low[parent[v]]]


def _signed(values) -> np.ndarray:
    return np.asarray(values, np.uint64).view(np.int64)


def _prints(batch: pa.RecordBatch, first: int) -> np.ndarray:
    return np.stack([batch.column(k).to_numpy(zero_copy_only=False).view(np.uint64) for k in range(first, batch.num_columns)], 1)


def _close(value: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of buckets of rows: (first, second) rows of the only near pair known in a bucket, and the buckets that have more.

    Rows are compared with those one, two ... places on in all buckets at once; a bucket with two near pairs needs no more.
    """
    sizes = ends - starts
    bucket = np.repeat(np.arange(len(starts)), sizes)
    row = np.arange(len(bucket)) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    left = ends[bucket] - 1 - row
    hits, pair = np.zeros(len(starts), np.int64), np.zeros((len(starts), 2), np.int64)
    step, on = 1, np.flatnonzero(left >= 1)
    while len(on):
        hit = on[_near(value[row[on]], value[row[on] + step], most, total)]
        if len(hit):
            pair[bucket[hit], 0], pair[bucket[hit], 1] = row[hit], row[hit] + step
            hits += np.bincount(bucket[hit], minlength=len(hits))
            on = on[hits[bucket[on]] < 2]
        step += 1
        on = on[left[on] >= step]
    one = hits == 1
    return pair[one, 0], pair[one, 1], np.flatnonzero(hits > 1)


def _scan_buckets(batches, most: int, total: int, block: int, names: list[str]):
    """Sorted (key, fingerprints) rows -> links, the first two of ``names``; the rows of a bucket over ``block`` come out as they are, with their key."""
    tail_key, tail = None, None
    over = False

    def out(pairs: list[tuple[int, int]], held: np.ndarray | None, key):
        n, more = len(pairs), 0 if held is None else len(held)
        rows = np.zeros((n + more, len(names)), np.uint64)
        rows[:n, :2] = np.array(pairs, np.uint64).reshape(-1, 2)
        if more:
            rows[n:, : held.shape[1]] = held
        return pa.record_batch([*(pa.array(np.ascontiguousarray(c)) for c in _signed(rows).T), pa.array([None] * n + [key] * more, pa.int64())], names=[*names, "key"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key, value = batch.column(0).to_numpy(zero_copy_only=False), _prints(batch, 1)
        if tail is not None:
            key, value = np.concatenate([np.full(len(tail), tail_key), key]), np.concatenate([tail, value])
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        ends = np.r_[starts[1:], len(key)]
        pairs: list[tuple[int, int]] = []
        whole = ends < len(key)
        held = whole & (ends - starts > block)
        if over and whole[0]:
            held[0], over = True, False
        for s, e in zip(starts[held].tolist(), ends[held].tolist(), strict=True):
            yield out([], value[s:e], int(key[s]))
        here = whole & ~held & (ends - starts > 1)
        first, last = starts[here], ends[here]
        one, two, several = _close(value, first, last, most, total)
        a, b = nodes(value[one]), nodes(value[two])
        pairs += zip(np.maximum(a, b).tolist(), np.minimum(a, b).tolist(), strict=True)
        for s, e in zip(first[several].tolist(), last[several].tolist(), strict=True):
            pairs += link(value[s:e], None, most, total)
        s = int(starts[-1])
        tail_key, tail = int(key[s]), value[s:].copy()
        if len(tail) > block:
            yield out([], tail, tail_key)
            tail, over = tail[:0], True
        yield out(list(dict.fromkeys(pairs)), None, None)
    if tail is not None and len(tail):
        if over or len(tail) > block:
            yield out([], tail, tail_key)
        elif len(tail) > 1:
            yield out(link(tail, None, most, total), None, None)
    release()


def _block_links(pdf, columns: list[str], most: int, total: int):
    """The rows of one pair of blocks of one bucket -> links."""
    import pandas as pd

    value = np.stack([pdf[c].to_numpy().view(np.uint64) for c in columns], 1)
    side = pdf["side"].to_numpy()
    pairs = link(value[side == 0], value[side == 1] if (side == 1).any() else None, most, total)
    return pd.DataFrame({"a": _signed([p[0] for p in pairs]), "b": _signed([p[1] for p in pairs])})


def links(prints: DataFrame, most: int, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """(a, b): links of nodes whose components are those of all pairs of rows within ``most`` bits, 4 at most.

    prints has one column of fingerprints, different rows.
    """
    columns = prints.columns

    def explode(batches):
        for batch in batches:
            value = _prints(batch, 0)
            for at in range(0, len(value), 4096):
                part = value[at : at + 4096]
                for k in range(part.shape[1]):
                    key, row = keys(np.ascontiguousarray(part[:, k]))
                    yield pa.record_batch([pa.array(key | k << 44), *(pa.array(part[row, c].view(np.int64)) for c in range(part.shape[1]))], names=["key", *columns])

    schema = "key long, " + ", ".join(f"{c} long" for c in columns)
    return bucket_links(prints.mapInArrow(explode, schema), most, most * len(columns), scratch, block)


def bucket_links(keyed: DataFrame, most: int, total: int, scratch: Scratch, block: int = BLOCK, hold: bool = False) -> DataFrame:
    """(a, b): links of nodes whose components are those of all pairs of rows of ``keyed`` (a key, then fingerprints)
    that share a key and are within ``most`` bits in each fingerprint and ``total`` in all. hold: what was scanned is held, not written."""
    columns = keyed.columns[1:]
    by = keyed.columns[0]
    names = [f"c{k}" for k in range(max(2, len(columns)))]
    scanned = keyed.repartition(by).sortWithinPartitions(by, *columns).mapInArrow(lambda b: _scan_buckets(b, most, total, block, names), ", ".join(f"{n} long" for n in [*names, "key"]))
    scanned = scratch.hold(scanned) if hold else scratch.keep(scanned, "scan")
    direct = scanned.where("key IS NULL").select(F.col("c0").alias("a"), F.col("c1").alias("b"))
    held = scanned.where("key IS NOT NULL").select("key", *(F.col(n).alias(c) for n, c in zip(names, columns, strict=False)))
    blocks = held.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("n"))
    dealt = held.join(blocks, "key").withColumn("mine", F.pmod(F.xxhash64(*columns), F.col("n")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other")
    dealt = dealt.select("key", *columns, "mine", other).select("key", *columns, F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), F.when(F.col("mine") <= F.col("other"), 0).otherwise(1).alias("side"))
    across = dealt.groupBy("key", "i", "j").applyInPandas(lambda pdf: _block_links(pdf, columns, most, total), "a long, b long")
    return direct.unionByName(across)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42, most: int = 4, block: int = BLOCK) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (smallest id reachable, itself included).

    Fingerprints within ``most`` bits (4 at most) are linked, all of them: the Golay keys miss no pair, and
    every bucket is verified by exact distance. Each distinct fingerprint is handled once; a bucket gives a
    spanning forest, not its pairs, and one over ``block`` members is compared block by block. Null and
    empty texts have fingerprint zero and are linked like any other. Rows with a null id keep it and take
    their component's smallest id. Other columns are left out; an empty table gives no rows.
    """
    if not 0 <= most <= 4:
        raise ValueError("the keys hold for at most 4 bits")
    ship(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "simhash")

    def hashed(batches):
        for batch in parts(batches, 1):
            values = np.array([fingerprint(t, shingle, seed) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(_signed(values))], names=["id", "print"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = scratch.keep(rows.mapInArrow(hashed, rows.select("id").schema.add("print", "long")), "prints")
    distinct = scratch.keep(known.groupBy("print").agg(F.min("id").alias("low")), "distinct")
    roots = components(links(distinct.select("print"), most, scratch, block), scratch)
    rooted = distinct.join(roots, distinct["print"] == roots["node"], "left").select("print", "low", F.coalesce("root", "print").alias("root"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(lows, "root").select("print", "component_id")
    text = F.lower(F.lpad(F.hex("print"), 16, "0"))
    return known.join(named, "print").select(F.col("id").alias(id_col), text.alias("fingerprint"), "component_id")


#: Documents of a candidate component that one task compares; of a larger one, two blocks of so many at a time.
TOGETHER = 1024
#: A round compares blocks that are so many numbers of places apart in a ring, so no round has more than twice as many copies of a row, however large a component.
APART = 4


def near_groups(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each set of hashes the smallest index of its component, over all pairs of at least ``similarity`` (exact Jaccard).

    Pairs inside a component that is already joined are left out. An inverted list gives one set's overlaps with all.
    """
    m = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, m)
    ends = np.cumsum(sizes)
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(m), sizes)[np.argsort(token, kind="stable")]
    count = np.bincount(token)
    first = np.cumsum(count) - count

    def near(v: int) -> np.ndarray:
        mine = token[ends[v] - sizes[v] : ends[v]]
        n = count[mine]
        at = np.arange(n.sum()) + np.repeat(first[mine] - (np.cumsum(n) - n), n)
        both = np.bincount(owner[at], minlength=m)
        found = both >= similarity * (sizes + sizes[v] - both) - 1e-9
        found[v] = True
        return found

    label = np.arange(m)
    pending = np.ones(m, bool)
    for start in range(m):
        if not pending[start]:
            continue
        pending[start] = False
        queue = [start]
        while queue and pending.any():
            left = np.flatnonzero(pending)
            if len(left) < len(queue):
                for v in left.tolist():
                    joined = np.unique(label[near(v)])
                    label[np.isin(label, joined)] = joined[0]
                return label
            found = np.flatnonzero(near(queue.pop(0)) & pending)
            pending[found] = False
            label[found] = start
            queue += found.tolist()
    return label


def _verified(pdf, similarity: float):
    """Rows of different sets -> verified links, each with the first row of its component."""
    import pandas as pd

    label = near_groups([np.asarray(s) for s in pdf["shingles"]], similarity)
    digest = pdf["digest"].to_numpy()
    on = label != np.arange(len(label))
    return pd.DataFrame({"a": digest[on], "b": digest[label[on]]})


def block_pairs(large: DataFrame, block: int, first: int) -> DataFrame:
    """(root, digest, shingles, i, j): the members of components of n > ``block`` in each pair (i, j) of their blocks that are ``first`` to
    ``first`` + APART - 1 places apart in the ring of a component's blocks. All pairs come once as ``first`` goes from 1 in steps of APART."""
    n = F.ceil(F.col("n") / block).cast("int")
    last = F.least(F.lit(first + APART - 1), F.floor(n / 2).cast("int"))
    dealt = large.where(F.lit(first) <= last).withColumn("mine", F.pmod(F.xxhash64("digest"), n).cast("int"))
    apart = F.sequence(F.lit(first), last)
    others = F.array_distinct(F.concat(F.transform(apart, lambda d: F.pmod(F.col("mine") + d, n)), F.transform(apart, lambda d: F.pmod(F.col("mine") - d, n))))
    dealt = dealt.withColumn("other", F.explode(others))
    return dealt.select("root", "digest", "shingles", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))


def text_key(text) -> object:
    """A text's SHA-256 as bytes; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, most: int = 26, block: int = TOGETHER, total: int = 57, scratch: Scratch | None = None) -> DataFrame:
    """(id, text_key, keep_id, keep_key): of each group of near copies all rows but those of the text that stays, and that one.

    Groups are the components of the pairs with at least ``similarity`` of their different word shingles in common (exact
    Jaccard similarity): a document goes even where only a chain of such pairs leads to the one that stays, which is that of the
    smallest id (null ids come last; of equal ids the smaller text key).
    Candidates: documents that share a wide Golay key of one of PRINTS fingerprints of their different shingles, and whose CHECKS further
    fingerprints are within ``most`` bits each and ``total`` together (about 10 of 64 differ at a similarity of 0.8). In each component of candidates the
    different shingle sets are compared exactly, over ``block`` of them in pairs of blocks, some pairs a round, and components are taken
    again. Rows are told apart by id and text, so ids may repeat or be null. Null and empty texts have no shingles and are alike.
    The links of candidates are contracted to forests first, since each of a text's keys may lead a large group's members to another one.
    scratch: holds the tables between, for a caller that drops them when it has written the result.
    """
    from xxhash import xxh64_intdigest

    ship(docs.sparkSession)
    scratch = scratch or Scratch(docs.sparkSession, "near")

    def hashed(batches):
        for batch in parts(batches, 2):
            values, digests = np.zeros((batch.num_rows, PRINTS + CHECKS), np.uint64), np.zeros(batch.num_rows, np.uint64)
            for k, text in enumerate(batch.column(2).to_pylist()):
                hashes = np.unique(shingle_hashes(text, shingle, 42))
                values[k] = fingerprints(hashes, PRINTS + CHECKS)
                digests[k] = xxh64_intdigest(hashes.tobytes(), 42)
            made = [pa.array(_signed(v)) for v in (nodes(values[:, PRINTS:]), digests)]
            yield pa.record_batch([*batch.columns[:2], *made, pa.array(list(_signed(values)), pa.list_(pa.int64()))], names=["id", "key", "node", "digest", "prints"])

    checks = [f"p{k}" for k in range(CHECKS)]

    def exploded(first: int):
        def explode(batches):
            for batch in batches:
                value = np.array(batch.column(0).to_pylist(), np.int64).reshape(-1, PRINTS + CHECKS).view(np.uint64)
                for at in range(0, len(value), 1024):
                    part = value[at : at + 1024]
                    key, row = wide_keys(part[:, first : min(first + AT_ONCE, PRINTS)])
                    yield pa.record_batch([pa.array(key), *(pa.array(part[row, c].view(np.int64)) for c in range(PRINTS, PRINTS + CHECKS))], names=["key", *checks])

        return explode

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    known = scratch.hold(rows.mapInArrow(hashed, "id long, key binary, node long, digest long, prints array<long>"))
    distinct = scratch.keep(known.dropDuplicates(["digest"]).select("prints"), "distinct")
    trees: list[DataFrame] = []
    for first in range(0, PRINTS, AT_ONCE):
        had = {id(t) for t in scratch.tables()}
        keyed = distinct.mapInArrow(exploded(first), ", ".join(f"{c} long" for c in ["key", *checks]))
        trees.append(scratch.keep(contracted(scratch.hold(bucket_links(keyed, most, total, scratch, hold=True))), "trees"))
        # the keys' shuffle files and what was scanned go before the next keys and the rounds
        scratch.drop(*(t for t in scratch.tables() if id(t) not in had and t is not trees[-1]), *([distinct] if first + AT_ONCE >= PRINTS else []))
    roots = components(reduce(DataFrame.unionByName, trees), scratch).withColumnRenamed("node", "_node")
    # one row for each different shingle set, with the row that stands for it
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first")
    sets = known.groupBy("digest", "node").agg(first)
    sets = scratch.keep(sets.join(roots, sets["node"] == roots["_node"], "left").select("digest", "first", F.coalesce("root", "node").alias("root")), "sets")
    # written, so that nothing below the join keeps a large component's rows in one task
    several = scratch.keep(sets.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "several")
    members = scratch.keep(sets.join(several, "root").select("root", "digest", "n", F.col("first.id").alias("_id"), F.col("first.key").alias("_key")), "members")

    def shingled(batches):
        for batch in parts(batches, 3):
            made = [np.unique(shingle_hashes(t, shingle, 42)).view(np.int64) for t in batch.column(3).to_pylist()]
            yield pa.record_batch([*batch.columns[:3], pa.array(made, pa.list_(pa.int64()))], names=["root", "digest", "n", "shingles"])

    # only texts that may be members are shuffled
    chosen = _marked(rows, members.select(F.col("_key").alias("key")), "key").where("maybe")
    chosen = chosen.join(members, (F.col("key") == F.col("_key")) & F.col("id").eqNullSafe(F.col("_id"))).select("root", "digest", "n", "text")
    left = scratch.keep(chosen.mapInArrow(shingled, "root long, digest long, n long, shingles array<long>").dropDuplicates(["root", "digest"]), "left")
    pairs = scratch.keep(left.where(F.col("n") <= block).groupBy("root").applyInPandas(lambda pdf: _verified(pdf, similarity), "a long, b long"), "pairs")
    large = left.where(F.col("n") > block)
    blocks = -(-(large.agg(F.max("n")).first()[0] or 0) // block)
    if blocks:
        across: list[DataFrame] = []
        for first in range(1, blocks // 2 + 1, APART):
            found = block_pairs(large, block, first).groupBy("root", "i", "j").applyInPandas(lambda pdf: _verified(pdf, similarity), "a long, b long")
            held = scratch.hold(found)
            across.append(scratch.keep(contracted(held), "across"))
            scratch.drop(held)
        pairs = pairs.unionByName(components(reduce(DataFrame.unionByName, across), scratch).select(F.col("node").alias("a"), F.col("root").alias("b")))
    grouped = sets.join(pairs.withColumnRenamed("a", "digest"), "digest", "left").select("digest", "first", F.coalesce("b", "digest").alias("group"))
    stays = grouped.groupBy("group").agg(F.min("first").alias("stays"))
    judged = scratch.keep(grouped.join(stays, "group").select(F.col("digest").alias("_digest"), "stays"), "stays")
    scratch.drop(left, members)
    out = known.select("id", "key", "digest").join(judged, F.col("digest") == F.col("_digest"))
    out = out.where(~(F.col("id").eqNullSafe(F.col("stays.id")) & (F.col("key") == F.col("stays.key"))))
    return out.select(F.col("id").alias(id_col), F.col("key").alias("text_key"), F.col("stays.id").alias("keep_id"), F.col("stays.key").alias("keep_key"))


def _marked(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """rows with ``maybe``: false only where ``column`` is certainly none of the keys. The filter's size has a bound."""
    bits = exact_dedup.filter_bits(keys.count())
    return exact_dedup.may_hit(rows, exact_dedup.hit_filter(keys.select(F.col(column).alias("digest")), bits), bits, column)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row of each group of ``near_copies``. Of rows that repeat both id and text one stays, whichever."""
    scratch = Scratch(docs.sparkSession, "copies")
    names = {c: f"v_{c}" for c in docs.columns}
    keyed = docs.withColumnsRenamed(names).withColumn("key", text_key(F.col(names[text_col]))).withColumn("row_id", F.col(names[id_col]).cast("long"))
    between = Scratch(docs.sparkSession, "near")
    gone = near_copies(docs, id_col, text_col, scratch=between, **options).select(F.col(id_col).alias("_gone"), F.col("text_key").alias("_gone_key")).distinct()
    gone = scratch.keep(gone, "gone")
    between.drop(*between.tables())
    twice = keyed.groupBy(F.col("row_id").alias("_gone"), F.col("key").alias("_gone_key")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    twice = scratch.keep(twice, "twice")
    same = (F.col("key") == F.col("_gone_key")) & F.col("row_id").eqNullSafe(F.col("_gone"))
    marked = _marked(keyed, gone.select(F.col("_gone_key").alias("key")).unionByName(twice.select(F.col("_gone_key").alias("key"))), "key")
    untouched, maybe = marked.where(~F.col("maybe")), marked.where("maybe")
    left = maybe.join(gone, same, "left_anti")
    if twice.limit(1).count():
        left = left.join(twice, same, "left_anti").unionByName(left.join(twice, same, "left_semi").dropDuplicates(["row_id", "key"]))
    return untouched.unionByName(left).select(*(F.col(a).alias(c) for c, a in names.items()))
