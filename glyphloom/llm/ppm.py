"""Language-model scoring by prediction by partial matching: a trie of byte contexts that reach back over the word before."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from .common import Scratch, parts, release

#: The end of a text is a token of this one byte, which no UTF-8 text holds.
END = b"\xff"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: A chunk of texts ends before a part of a batch like the last one would bring it beyond so many different words or bytes.
CHUNK_WORDS, CHUNK_BYTES = 400_000, 16 << 20
#: A shelf of the vocabulary has so many words.
SHELF_WORDS = 400_000
#: A block of word pairs gets so many running words' pairs; a word after which more running words stand is dealt to several.
BLOCK_TOKENS, HOT_TOKENS = 2_000_000, 500_000
#: A window of bytes is one long: its length above 56 bits, its last byte lowest.
MASK = (1 << 56) - 1


def tokens(text: str | None) -> list[bytes]:
    return [*(text or "").encode("utf-8", "replace").translate(_LOWER).split(), END]


def _bytes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of large binaries one after another, and where these begin and end."""
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.zeros(0, np.uint8), ends - ends[0]


_CHUNK = pa.schema([("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32())), ("low", pa.binary()), ("high", pa.binary()), ("words", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64()))])
_CHUNK_SQL = "chunk long, doc_ids array<long>, held array<boolean>, sizes array<int>, low binary, high binary, words array<binary>, counts array<long>"


class _Chunk:
    """Texts as numbers of a dictionary of their own words; the end symbol is number 0."""

    def __init__(self):
        self.ids, self.held, self.sizes, self.body, self.bytes = [], [], [], [], 0
        self.words = pa.array([END], pa.large_binary())
        self.last = 0, 0

    def add(self, doc_id, held: bool, text: str | None) -> None:
        self.add_rows([doc_id], [held], pa.array([(text or "").encode("utf-8", "replace")], pa.binary()).cast(pa.string()))

    def add_rows(self, ids: list, held: list[bool], texts: pa.Array) -> None:
        """Rows of one part, whose words are told apart among themselves first."""
        data, ends = _bytes(pa.compute.fill_null(texts.cast(pa.large_binary()), b""))
        # offsets from 0 on: pyarrow's kernels for strings misread a part of a batch
        lower = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(ends), pa.py_buffer(data.tobytes().translate(_LOWER)))
        split = pa.compute.ascii_split_whitespace(lower)
        # white space at the ends of a text gives empty words
        real = np.asarray(pa.compute.binary_length(split.values)) > 0
        own = split.values.dictionary_encode()
        start = split.offsets.to_numpy().astype(np.int64)
        sizes = np.diff(np.r_[0, np.cumsum(real)][start - start[0]]) + 1
        found = own.indices.to_numpy()[real]
        used = np.asarray(pa.compute.binary_length(own.dictionary)) > 0
        both = pa.concat_arrays([self.words, own.dictionary.cast(pa.large_binary()).filter(pa.array(used))]).dictionary_encode()
        number = np.zeros(len(used), np.uint32)
        number[used] = both.indices.to_numpy()[len(self.words) :]
        self.last = len(both.dictionary) - len(self.words), len(data)
        self.words = both.dictionary
        body = np.zeros(len(found) + len(sizes), np.uint32)
        word = np.ones(len(body), bool)
        word[np.cumsum(sizes) - 1] = False
        body[word] = number[found]
        self.body.append(body)
        self.ids += ids
        self.held += held
        self.sizes += sizes.tolist()
        self.bytes += len(data)

    def full(self) -> bool:
        return len(self.words) + self.last[0] > CHUNK_WORDS or self.bytes + self.last[1] > CHUNK_BYTES

    def batch(self) -> pa.RecordBatch:
        body = np.concatenate(self.body)
        training = np.repeat(~np.array(self.held), self.sizes)
        counts = np.bincount(body[training], minlength=len(self.words))
        order = np.argsort(-np.bincount(body, minlength=len(self.words)), kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order))
        body = rank[body]  # frequent words get small numbers, so the upper halves are mostly zero
        words = self.words.take(pa.array(order)).cast(pa.binary())
        row = [uuid.uuid4().int >> 65, self.ids, self.held, self.sizes, (body & 0xFFFF).astype("<u2").tobytes(), (body >> 16).astype("<u2").tobytes()]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in (words, pa.array(counts[order], pa.int64()))]
        return pa.record_batch([*(pa.array([v], f.type) for v, f in zip(row, _CHUNK, strict=False)), *lists], schema=_CHUNK)


def _to_chunks(batches):
    now = _Chunk()
    for batch in parts(batches, 2):
        now.add_rows(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2))
        if now.full():
            yield now.batch()
            now = _Chunk()
    if now.ids:
        yield now.batch()


def window_codes(words: list[bytes] | pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, word numbers) of every predicted byte of a word with its context.

    A word is predicted from a blank before it to the blank after it (the end token has none after it); the
    context is up to ``order`` bytes, none before the first blank.
    """
    words = pa.array(words, pa.large_binary()) if isinstance(words, list) else words.cast(pa.large_binary())
    inner = np.asarray(pa.compute.binary_length(words)).astype(np.int64)
    sizes = inner + np.where(np.asarray(pa.compute.equal(words, END)), 1, 2)
    starts = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(starts, sizes)
    text = np.full(len(place), 32, np.int64)
    text[(place > 0) & (place <= np.repeat(inner, sizes))] = _bytes(words)[0]
    code = text.copy()
    for k in range(1, order + 1):
        code[k:] |= np.where(place[k:] >= k, text[:-k] << 8 * k, 0)
    length = np.minimum(place + 1, order + 1)
    keep = place > 0
    return (length << 56 | code)[keep], np.repeat(np.arange(len(words)), sizes)[keep]


def bucket(n: np.ndarray) -> np.ndarray:
    """Small numbers as they are, from 4 on two steps to each doubling."""
    n = np.asarray(n, np.int64)
    return np.where(n < 4, n, 4 + np.floor(2 * np.log2(np.maximum(n, 4) / 4)).astype(np.int64))


def _bucket_sql(n: str) -> str:
    return f"if({n} < 4, {n}, 4 + cast(floor(2 * log2({n} / 4D)) as long))"


_SHELF_SQL = "shelf string, words array<binary>, counts array<long>, codes array<long>, weights array<long>"


def _to_shelves(batches, order: int):
    """The vocabulary in shelves, each with its different windows and their training counts."""
    held, n = [], 0
    names = [x.split()[0] for x in _SHELF_SQL.split(", ")]

    def shelf(rows: pa.Table):
        words, counts = (c.combine_chunks() for c in rows.columns)
        codes, at = window_codes(words, order)
        by = np.argsort(codes)
        codes = codes[by]
        first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, np.int64)
        weights = np.add.reduceat(counts.to_numpy()[at[by]], first) if len(codes) else np.zeros(0, np.int64)
        row = [uuid.uuid4().hex, codes[first], weights]
        types = [pa.string(), *[pa.list_(pa.int64())] * 2]
        name, codes, weights = (pa.array([v], t) for v, t in zip(row, types, strict=True))
        lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in (words, counts)]
        return pa.record_batch([name, *lists, codes, weights], names=names)

    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, SHELF_WORDS - n)
            batch = batch.slice(len(part))
            held.append(part)
            n += len(part)
            if n == SHELF_WORDS:
                yield shelf(pa.Table.from_batches(held))
                held, n = [], 0
    if held:
        yield shelf(pa.Table.from_batches(held))


def _length(code: Column) -> Column:
    return F.shiftrightunsigned(code, 56)


def _suffix(code: Column, length: Column | int) -> Column:
    """The last ``length`` bytes of a window."""
    length = length if isinstance(length, Column) else F.lit(length)
    length = length.cast("long")
    return F.call_function("shiftleft", length, F.lit(56)).bitwiseOR(code.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (length * 8).cast("int")) - 1))


def _context(code: Column) -> Column:
    """A window without its last byte."""
    return F.shiftleft(_length(code) - 1, 56).bitwiseOR(F.shiftrightunsigned(code.bitwiseAND(F.lit(MASK)), 8))


#: Walks a window's contexts from the longest seen one down. q is the escape probability of a context; below the
#: first, n and d are without the symbols seen in the longer context, and nothing left costs nothing.
_WALK = """aggregate(levels, named_struct('lp', 0D, 'n', -1L, 'd', 0L, 'q', 0D, 'done', false, 'last', 0L),
  (s, x) -> if(s.done OR x.n IS NULL, s, named_struct(
    'lp', s.lp + CASE WHEN if(s.n < 0, x.d, s.d) = 0 THEN 0D
                      WHEN x.c IS NULL THEN log10(if(s.n < 0, x.q, s.q))
                      ELSE log10(x.c / if(s.n < 0, x.n, s.n) * (1 - if(s.n < 0, x.q, s.q))) END,
    'n', coalesce(x.n_low, 0L), 'd', coalesce(x.d_low, 0L), 'q', coalesce(x.q_low, 0D), 'done', x.c IS NOT NULL, 'last', x.d)),
  s -> if(s.done, s.lp, s.lp - log10(greatest(1D, 256D - s.last))))"""


def trie(windows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(grams (code, c), contexts (ctx, n, d, q, n_low, d_low, q_low)) of windows (code, c): the trie of all orders, flat.

    n and d count the symbols and kinds of symbols after a context, q is its escape probability; n_low, d_low and q_low are those
    after the context that is a byte shorter, without the symbols seen after this one. An escape is estimated
    from all contexts of the same order with like n and d, by leaving out one occurrence at a time.
    """
    seen = windows.where("c > 0")
    below = seen.select(F.explode(F.sequence(F.lit(1), _length(F.col("code")).cast("int"))).alias("k"), "code", "c")
    grams = scratch.keep(below.groupBy(_suffix(F.col("code"), F.col("k")).alias("code")).agg(F.sum("c").alias("c")), "grams")
    lower = grams.select(F.col("code").alias("low"), F.col("c").alias("c_low"))
    paired = grams.withColumn("low", F.when(_length(F.col("code")) > 1, _suffix(F.col("code"), _length(F.col("code")) - 1))).join(lower, "low", "left")
    own = paired.groupBy(_context(F.col("code")).alias("ctx")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("d"), F.count_if(F.col("c") == 1).alias("once"), F.coalesce(F.sum("c_low"), F.lit(0)).alias("gone"))
    own = scratch.keep(own, "contexts")
    shorter = own.select(F.col("ctx").alias("low"), F.col("n").alias("_n"), F.col("d").alias("_d"))
    linked = own.withColumn("low", F.when(_length(F.col("ctx")) > 0, _suffix(F.col("ctx"), _length(F.col("ctx")) - 1))).join(shorter, "low", "left")
    linked = linked.select("ctx", _length(F.col("ctx")).alias("k"), "n", "d", (F.col("_n") - F.col("gone")).alias("n_low"), (F.col("_d") - F.col("d")).alias("d_low"))
    events = own.where("n > 1").select(_length(F.col("ctx")).alias("k"), F.expr(_bucket_sql("(n - 1)")).alias("nb"), F.explode(F.array(F.struct(F.expr(_bucket_sql("(d - 1)")).alias("db"), F.col("once").alias("lost"), F.col("once").alias("events")), F.struct(F.expr(_bucket_sql("d")).alias("db"), F.lit(0).cast("long").alias("lost"), (F.col("n") - F.col("once")).alias("events")))).alias("e"))
    # at most some 130 x 130 rows an order, whatever the corpus
    table = events.groupBy("k", "nb", F.col("e.db").alias("db")).agg(((F.sum("e.lost") + 0.5) / (F.sum("e.events") + 1)).alias("q"))
    table = F.broadcast(scratch.keep(table, "escapes"))
    for n, d, k, q in (("n", "d", "k", "q"), ("n_low", "d_low", "k - 1", "q_low")):
        keyed = linked.withColumn("_k", F.expr(k)).withColumn("_nb", F.expr(_bucket_sql(n))).withColumn("_db", F.expr(_bucket_sql(d)))
        named = table.select(F.col("k").alias("_k"), F.col("nb").alias("_nb"), F.col("db").alias("_db"), F.col("q").alias(q))
        linked = keyed.join(named, ["_k", "_nb", "_db"], "left").drop("_k", "_nb", "_db").withColumn(q, F.coalesce(q, F.lit(0.5)))
    return grams, linked.drop("k")


def window_scores(windows: DataFrame, grams: DataFrame, contexts: DataFrame) -> DataFrame:
    """(code, lp): log10 of the probability of each window's last byte after the others."""
    levels = windows.select("code", F.explode(F.sequence(F.lit(1), _length(F.col("code")).cast("int"))).alias("k"))
    levels = levels.withColumn("gram", _suffix(F.col("code"), F.col("k"))).withColumn("ctx", _context(_suffix(F.col("code"), F.col("k"))))
    full = levels.where(F.col("gram") == F.col("code")).join(grams.withColumnRenamed("code", "gram"), "gram").join(contexts, "ctx")
    direct = full.select("code", F.log10(F.col("c") / F.col("n") * (1 - F.col("q"))).alias("lp"))
    rest = levels.join(windows.join(grams, "code", "left_anti").select("code"), "code", "left_semi")
    found = rest.join(grams.withColumnRenamed("code", "gram"), "gram", "left").join(contexts, "ctx", "left")
    walked = found.groupBy("code").agg(F.sort_array(F.collect_list(F.struct((-F.col("k")).alias("k"), "c", "n", "d", "q", "n_low", "d_low", "q_low"))).alias("levels"))
    return direct.unionByName(walked.select("code", F.expr(_WALK).alias("lp")))


def _named(left: pa.Table, right: pa.Table, order: int) -> pa.Table:
    """A shelf's words with log10 of their probabilities as byte strings, from those of its windows."""
    words, counts = (left.column(n).combine_chunks().flatten() for n in ("words", "counts"))
    codes, at = window_codes(words, order)
    known = right.column("code").to_numpy()
    by = np.argsort(known)  # different windows
    lp = right.column("lp").to_numpy()[by][np.searchsorted(known[by], codes)]
    return pa.table({"word": words, "c": counts, "lp": np.bincount(at, lp, len(words))})


# --- contexts of the word before ---------------------------------------------------------------------


def packed(values: np.ndarray, level: int = 1) -> bytes:
    """Whole numbers from 0 on, byte plane by byte plane, compressed (level 0: hashes, which do not shrink)."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    used = max((k + 1 for k in range(8) if planes[k].any()), default=0)
    return bytes([used]) + len(values).to_bytes(8, "little") + zlib.compress(planes[:used].tobytes(), level)


def unpacked(raw: bytes) -> np.ndarray:
    used, n = raw[0], int.from_bytes(raw[1:9], "little")
    out = np.zeros((8, n), np.uint8)
    out[:used] = np.frombuffer(zlib.decompress(raw[9:]), np.uint8).reshape(used, n)
    return np.ascontiguousarray(out.T).view("<u8").reshape(-1).astype(np.uint64)


#: So many looked up rows at a time become packed columns, one row for each chunk among them.
PACK_ROWS = 1_000_000


def _to_columns(batches, hashes: tuple[str, ...] = ()):
    """Rows (of, at, numbers) -> a row for each ``of``: its places, as steps, and numbers as compressed columns."""
    held, n = [], 0

    def made():
        table = pa.Table.from_batches(held)
        of, at = table.column(0).to_numpy(), table.column(1).to_numpy().astype(np.int64)
        values = [table.column(k).to_numpy().view(np.int64) for k in range(2, table.num_columns)]
        chunks = np.unique(of)
        by, _ = _ordered(np.searchsorted(chunks, of) << 31 | at)  # a place is below 2**31
        starts = np.flatnonzero(np.r_[True, np.diff(of[by]) != 0])
        rows = []
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(by)], strict=True):
            on = by[s:e]
            rows.append((int(of[on[0]]), packed(np.diff(at[on], prepend=0)), *(packed(v[on], 0 if name in hashes else 1) for name, v in zip(table.column_names[2:], values, strict=True))))
        types = [pa.int64(), *[pa.binary()] * (table.num_columns - 1)]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=table.column_names)

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= PACK_ROWS:
            yield made()
            held, n = [], 0
    if held:
        yield made()
    release()


def _column(table: pa.Table, name: str, kind: type = np.int64) -> np.ndarray:
    """The numbers of a packed column's rows one after another."""
    return np.concatenate([np.zeros(0, np.uint64), *(unpacked(v.as_py()) for v in table.column(name))]).view(kind)


def _places(table: pa.Table, name: str = "at") -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *(np.cumsum(unpacked(v.as_py()).view(np.int64)) for v in table.column(name))])


_LOOKED_SQL = "chunk long, doc_ids array<long>, held array<boolean>, sizes array<int>, low binary, high binary, h array<long>, c array<long>, lp array<double>"


def _looked_up(left: pa.Table, right: pa.Table) -> pa.Table:
    """A chunk with its words' hashes, training counts and logs as byte strings in place of the words."""
    at = _places(right)
    out = {n: left.column(n).slice(0, 1) for n in ("chunk", "doc_ids", "held", "sizes", "low", "high")}
    for name, kind in (("h", np.int64), ("c", np.int64), ("lp", np.float64)):
        values = np.zeros(len(at), kind)
        values[at] = _column(right, name, kind)
        out[name] = pa.array([values])
    return pa.table(out)


def _different(code: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different numbers below 2**bits and the place of each one's among them. Numbers are sorted with their places in
    the low bits, where both fit, which takes less time than sorting places by them."""
    low = max(1, (len(code) - 1).bit_length())
    if bits + low > 63:
        unique, at = np.unique(code, return_inverse=True)
        return unique, at.astype(np.int32)
    both = np.sort(code << low | np.arange(len(code)))
    place, both = both & (1 << low) - 1, both >> low
    new = np.r_[True, both[1:] != both[:-1]][: len(both)]
    at = np.empty(len(code), np.int32)
    at[place] = np.cumsum(new) - 1
    return both[new], at


def _ordered(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stable order of whole numbers from 0 on, and these in it; sorted with their places in the low bits, where both fit."""
    low = max(1, (len(code) - 1).bit_length())
    if len(code) and int(code.max()) >> 63 - low:
        order = np.argsort(code, kind="stable")
        return order, code[order]
    both = code << low
    both |= np.arange(len(code))
    both.sort()
    order = both & (1 << low) - 1
    both >>= low
    return order, both


def _dealt(hv: np.ndarray, part: np.ndarray, blocks: int) -> np.ndarray:
    """The block of a word before, or of one part of a frequent one."""
    with np.errstate(over="ignore"):
        deal = (hv + part * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    return ((deal >> np.uint64(33)) % np.uint64(blocks)).astype(np.int64)


class _Pairs:
    """A chunk's different (word before, word) pairs in the order in which blocks take and give them back.

    The word before a text's first is the end symbol. Blocks are dealt by the word before; one with more than HOT_TOKENS
    training words after it is dealt to several by a hash of the next word, as every chunk knows from its count.
    """

    def __init__(self, row: pa.Table, blocks: int):
        low, high = (np.frombuffer(row.column(n)[0].as_py(), "<u2").astype(np.int64) for n in ("low", "high"))
        self.body = (high << 16 | low).astype(np.int32)
        del low, high
        self.sizes = np.array(row.column("sizes")[0].as_py(), np.int64)
        held = np.array(row.column("held")[0].as_py(), bool)
        self.c, hashes = (_list(row, n) for n in ("c", "h"))
        n = len(self.c)
        ends = np.cumsum(self.sizes)
        before = np.r_[self.body[:1], self.body[:-1]]
        before[(ends - self.sizes)] = self.body[ends - 1]  # each text has its end symbol
        # numbered by their hashes, so that pairs sorted by their numbers are sorted by both hashes
        by = np.argsort(hashes.view(np.uint64), kind="stable")
        number = np.empty(n, np.int64)
        number[by] = np.arange(n)
        bits = max(1, (n - 1).bit_length())
        code, self.at = _different(number[before] << bits | number[self.body], 2 * bits)
        training = np.repeat(~held, self.sizes)
        self.seen = np.bincount(self.at[training], minlength=len(code)) if len(code) else np.zeros(0, np.int64)
        self.v, self.w = by[code >> bits], by[code & (1 << bits) - 1]
        hv, hw = hashes[self.v].view(np.uint64), hashes[self.w].view(np.uint64)
        self.block = _dealt(hashes.view(np.uint64), np.uint64(0), blocks)[self.v]
        parts = np.uint64(1) + self.c.astype(np.uint64) // np.uint64(HOT_TOKENS)
        hot = np.flatnonzero((parts > 1)[self.v])
        self.block[hot] = _dealt(hv[hot], hw[hot] % parts[self.v[hot]], blocks)
        # a pair is told apart by 64 bits of the word before and 48 of the word: two of a billion words after one word
        # are taken for one another some two thousand times
        self.hv, self.hw = hv, hw >> np.uint64(16)
        self.order = np.argsort(self.block.astype(np.uint16) if blocks <= 1 << 16 else self.block, kind="stable")


def _list(row: pa.Table, name: str) -> np.ndarray:
    """The list of a table's one row."""
    return row.column(name).combine_chunks().flatten().to_numpy()


_BLOCK_SQL = "block int, chunk long, befores binary, runs binary, words binary, seen binary, counts binary"


def _to_blocks(batches, blocks: int):
    for batch in batches:
        for k in range(batch.num_rows):
            yield from _chunk_blocks(pa.Table.from_batches([batch.slice(k, 1)]), blocks).to_batches()
    release()


def _chunk_blocks(row: pa.Table, blocks: int) -> pa.Table:
    """A chunk's pairs, one row a block: the words before with how many follow each, the words, their training counts in
    pairs and, where these are not 0, alone."""
    chunk = row.column("chunk")[0].as_py()
    p = _Pairs(row, blocks)
    block = p.block[p.order]
    starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else np.zeros(0, np.int64)
    rows = []
    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(block)], strict=True):
        on = p.order[s:e]
        hv = p.hv[on]
        first = np.flatnonzero(np.r_[True, hv[1:] != hv[:-1]])
        seen = p.seen[on]
        rows.append((int(block[s]), chunk, packed(hv[first], 0), packed(np.diff(np.r_[first, e - s])), packed(p.hw[on], 0), packed(seen), packed(np.where(seen > 0, p.c[p.w[on]], 0))))
    types = [pa.int32(), pa.int64(), *[pa.binary()] * 5]
    names = [x.split()[0] for x in _BLOCK_SQL.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * 7
    return pa.table({n: pa.array(c, t) for n, c, t in zip(names, columns, types, strict=True)})


_COUNTED_SQL = "chunk long, block int, body binary, h array<long>, d array<long>, once array<long>, mass array<long>"


def _count_block(table: pa.Table) -> pa.Table:
    """Rows of one block -> a row for each chunk with the training counts of its pairs in the whole table, and one without a
    chunk: for each word before, how many different words follow, how many once, and the sum of their counts alone."""
    block = table.column("block")[0].as_py()
    chunks = table.column("chunk").to_pylist()
    parts = []
    for k in range(table.num_rows):
        get = lambda n: unpacked(table.column(n)[k].as_py())  # noqa: E731, B023
        parts.append((np.repeat(get("befores"), get("runs").astype(np.int64)), get("words"), get("seen").astype(np.int64), get("counts").astype(np.int64)))
    hv, hw, seen, alone = (np.concatenate([p[i] for p in parts]) for i in range(4))
    by = np.lexsort((hw, hv))
    hv_s, hw_s = hv[by], hw[by]
    new = np.r_[True, (hv_s[1:] != hv_s[:-1]) | (hw_s[1:] != hw_s[:-1])]
    pair = np.empty(len(by), np.int64)
    pair[by] = np.cumsum(new) - 1
    n = int(new.sum())
    total = np.zeros(n, np.int64)
    np.add.at(total, pair, seen)
    count = np.zeros(n, np.int64)
    np.maximum.at(count, pair, alone)
    before, of = np.unique(hv_s[new], return_inverse=True)
    have = total > 0
    stats = [before.view(np.int64), np.bincount(of, have, len(before)), np.bincount(of, total == 1, len(before))]
    mass = np.zeros(len(before), np.int64)
    np.add.at(mass, of, count)
    stats = [v.astype(np.int64) for v in (*stats, mass)]
    used = np.flatnonzero(stats[1] > 0)
    ends = np.cumsum([len(p[0]) for p in parts])
    bodies = [packed(total[pair[e - len(p[0]) : e]]) for e, p in zip(ends.tolist(), parts, strict=True)]
    m = len(chunks)
    return pa.table({
        "chunk": pa.array([*chunks, None], pa.int64()),
        "block": pa.array([block] * (m + 1), pa.int32()),
        "body": pa.array([*bodies, None], pa.binary()),
        **{name: pa.array([None] * m + [v[used]], pa.list_(pa.int64())) for name, v in zip(("h", "d", "once", "mass"), stats, strict=True)},
    })


def _scored(left: pa.Table, right: pa.Table, adapt: float, blocks: int, n: int, v: int, first: float, rest: float, escape: dict[tuple[int, int], float]) -> pa.Table:
    """A chunk's texts with their sums over tokens.

    right: packed columns of words that others follow, and rows of the chunk's blocks with the counts of its pairs. n, v: training tokens
    and different ones. first: the escape probability of the context
    without a word before; rest: the byte strings' probability that is not taken up by known words.
    """
    row = left.slice(0, 1)
    is_word = pa.compute.is_null(right.column("body"))
    words, answers = right.filter(is_word), right.filter(pa.compute.invert(is_word))
    p = _Pairs(row, blocks)
    size = len(p.c)
    at = _places(words, "places")
    spelled, kinds, mass = _list(row, "lp"), np.zeros(size, np.int64), np.zeros(size, np.int64)
    kinds[at], mass[at] = _column(words, "d"), _column(words, "mass")
    base = np.log10((p.c + 0.5) / (n + 0.5 * (v + 1)))
    # a word alone: its count, or an escape to its bytes, without what they give to known words
    with np.errstate(divide="ignore", invalid="ignore"):
        alone = np.where(p.c > 0, np.log10(np.maximum(p.c, 1) / max(n, 1) * (1 - first)), np.log10(first) + spelled - np.log10(rest)) if n else spelled
        # after the word before: the pair's count, or an escape to the word alone, without what that gives to words seen there
        total = np.zeros(len(p.order), np.int64)
        by_block = np.argsort(answers.column("at").to_numpy(), kind="stable")
        bodies = answers.column("body")
        if len(by_block):
            total[p.order] = np.concatenate([unpacked(bodies[int(k)].as_py()) for k in by_block]).astype(np.int64)
        by_c, by_kinds = bucket(p.c), bucket(kinds)
        table = np.full((int(by_c.max(initial=0)) + 1, int(by_kinds.max(initial=0)) + 1), 0.5)
        for (a, b), value in escape.items():
            if a < table.shape[0] and b < table.shape[1]:
                table[a, b] = value
        q = table[by_c, by_kinds]
        free = np.log10(np.maximum(1 - mass / max(n, 1) * (1 - first), 1e-12))
        lower = np.log10(q)[p.v] + alone[p.w] - free[p.v]
        pair = np.where(kinds[p.v] == 0, alone[p.w], np.where(total > 0, np.log10(np.maximum(total, 1) / np.maximum(p.c[p.v], 1) * (1 - q[p.v])), lower))
    lp = pair[p.at]
    del total, lower, pair, alone, words, answers, right
    p.v = p.w = p.hv = p.hw = p.block = p.order = p.seen = p.at = None
    body, sizes = p.body, p.sizes
    doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    # how often the token stood in its text before, and how many tokens did
    order, key = _ordered(doc * np.int64(max(size, 1)) + body)
    begins = np.r_[True, key[1:] != key[:-1]] if len(body) else np.zeros(0, bool)
    del key
    place = np.arange(len(body))
    run = place - np.maximum.accumulate(np.where(begins, place, 0))
    before = np.empty(len(body), np.int64)
    before[order] = run
    del order, run, begins
    begun = place - np.repeat(np.cumsum(sizes) - sizes, sizes)
    price = np.log10((before + adapt * 10**lp) / (begun + adapt)) if adapt else lp
    return pa.table({
        "doc_id": pa.array(row.column("doc_ids")[0].as_py(), pa.int64()),
        "held_out": pa.array(row.column("held")[0].as_py(), pa.bool_()),
        "n_tokens": sizes,
        "n_known": np.bincount(doc, (p.c > 0)[body], len(sizes)).astype(np.int64),
        "train_tokens": np.full(len(sizes), n),
        "base_score": np.bincount(doc, base[body], len(sizes)),
        "score": np.bincount(doc, price, len(sizes)),
    })


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", order: int = 5, adapt: float = 1000.0) -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model is PPM over lower-cased text (a run of white space counts as one blank, the text's end is a symbol).
    At a word's start the longest context is the whole word before; its branches are whole words, so a branch's
    bytes are one step. An escape leads to the context that holds no word, whose branches are all known
    words, and from there to the word's bytes, one by one, after the word so far and up to ``order`` bytes. Everywhere
    symbols of longer contexts are excluded from shorter ones, and escapes are estimated from contexts with like
    counts, leaving out one occurrence. It is pretrained on the rows where ``held_out`` is false or null, and adaptive in
    each text: of j tokens before, those equal to the next one count against ``adapt`` pretrained ones (0:
    pretrained only). score is log10 of the probability of the token sequence. base_score is the add-half
    unigram model of the words.

    Each chunk of texts is kept as numbers of its own dictionary, so that counting, and looking counts and
    probabilities up, shuffles a chunk's different words and not its tokens; the vocabulary meets the byte trie in the
    same way, a shelf's different windows at a time. A chunk's different word pairs go to blocks as compressed columns, and
    their counts come back so. Only totals and tables of escape probabilities of bounded size reach the driver. Null texts
    are empty: one token. Repeated rows give repeated rows; other columns are left out. Without training rows all
    probabilities are uniform: each byte 1/256.
    """
    if not 0 <= order <= 6:
        raise ValueError("a window is at most seven bytes")
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "ppm")
    rows = docs.select(F.col(id_col).cast("long"), F.coalesce(held_out, F.lit(False)), F.col(text_col))
    chunks = scratch.keep(rows.mapInArrow(_to_chunks, _CHUNK_SQL), "chunks", compression="zstd")
    entries = chunks.select("chunk", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "w")).select("chunk", "at", F.col("w.words").alias("word"), F.col("w.counts").alias("c"))
    vocabulary = entries.groupBy("word").agg(F.sum("c").alias("c"))
    shelves = scratch.keep(vocabulary.mapInArrow(lambda b: _to_shelves(b, order), _SHELF_SQL), "shelves", compression="zstd")
    known = shelves.select(F.explode("counts").alias("c"))
    totals = known.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v"), F.count_if(F.col("c") == 1).alias("once")).first()
    n_all, v_all = totals["n"] or 0, totals["v"] or 0
    held = shelves.select("shelf", F.explode(F.arrays_zip("codes", "weights")).alias("w")).select("shelf", F.col("w.codes").alias("code"), F.col("w.weights").alias("c"))
    windows = scratch.keep(held.groupBy("code").agg(F.sum("c").alias("c")), "windows")
    scratch.drop()
    grams, contexts = trie(windows, scratch)
    contexts = scratch.keep(contexts, "contexts")
    scores = window_scores(windows, grams, contexts)
    if not n_all:
        scores = windows.select("code", F.lit(float(-np.log10(256))).alias("lp"))
    priced = held.select("shelf", "code").join(scores, "code").select(F.col("shelf").alias("of"), "code", "lp")
    blobs = shelves.select("shelf", "words", "counts")
    named = blobs.groupBy("shelf").cogroup(priced.groupBy("of")).applyInArrow(lambda left, right: _named(left, right, order), "word binary, c long, lp double")
    named = scratch.keep(named, "named", compression="zstd")
    scratch.drop(shelves, windows, grams, contexts)
    taken = named.where("c > 0").agg(F.sum(F.expr("pow(10D, lp)"))).first()[0] or 0.0
    first, rest = ((totals["once"] or 0) + 0.5) / (n_all + 1), max(1 - taken, 1e-12)

    looked = entries.select("chunk", "at", "word").join(named.hint("shuffle_hash"), "word").select(F.col("chunk").alias("of"), "at", F.xxhash64("word").alias("h"), "c", "lp")
    looked = looked.mapInArrow(lambda b: _to_columns(b, ("h",)), "of long, at binary, h binary, c binary, lp binary")
    # written, so that its shuffle files are gone before the next ones come
    looked = scratch.keep(looked, "looked", compression="zstd")
    scratch.drop()
    texts = chunks.select("chunk", "doc_ids", "held", "sizes", "low", "high")
    texts = scratch.keep(texts.groupBy("chunk").cogroup(looked.groupBy("of")).applyInArrow(_looked_up, _LOOKED_SQL), "texts", compression="zstd")
    scratch.drop(chunks, looked)
    n_tokens = texts.select(F.explode("sizes").alias("n")).agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-n_tokens // BLOCK_TOKENS))
    sent = texts.select("chunk", "held", "sizes", "low", "high", "h", "c").mapInArrow(lambda b: _to_blocks(b, blocks), _BLOCK_SQL)
    counted = scratch.keep(sent.groupBy("block").applyInArrow(_count_block, _COUNTED_SQL), "counted", compression="zstd")
    after = counted.where("chunk IS NULL").select(F.explode(F.arrays_zip("h", "d", "once", "mass")).alias("s")).groupBy(F.col("s.h").alias("h"))
    after = scratch.keep(after.agg(F.sum("s.d").alias("d"), F.sum("s.once").alias("once"), F.sum("s.mass").alias("mass")), "after")
    scratch.drop()
    # a word's training count is the number of training words after it
    followed = after.join(named.where("c > 1").select(F.xxhash64("word").alias("h"), "c"), "h")
    seen = followed.select(F.expr(_bucket_sql("(c - 1)")).alias("n"), F.explode(F.array(
        F.struct(F.expr(_bucket_sql("(d - 1)")).alias("d"), F.col("once").alias("lost"), F.col("once").alias("events")),
        F.struct(F.expr(_bucket_sql("d")).alias("d"), F.lit(0).cast("long").alias("lost"), (F.col("c") - F.col("once")).alias("events")),
    )).alias("e"))
    seen = seen.groupBy("n", F.col("e.d").alias("d")).agg(((F.sum("e.lost") + 0.5) / (F.sum("e.events") + 1)).alias("q"))
    escape = {(r["n"], r["d"]): r["q"] for r in seen.collect()}  # by bucket: at most some 130 x 130
    scratch.drop(named)
    words = texts.select(F.col("chunk").alias("of"), F.posexplode(F.arrays_zip("h", "c")).alias("at", "w")).where("w.c > 0").select("of", "at", F.col("w.h").alias("h"))
    words = words.join(after.select("h", "d", "mass"), "h").select("of", F.col("at").alias("places"), "d", "mass")
    # written, so that its shuffle files are gone before the texts are dealt
    words = scratch.keep(words.mapInArrow(_to_columns, "of long, places binary, d binary, mass binary"), "words")
    scratch.drop()
    none = F.lit(None).cast("binary")
    answers = counted.where("chunk IS NOT NULL").select(F.col("chunk").alias("of"), F.col("block").alias("at"), none.alias("places"), none.alias("d"), none.alias("mass"), "body")
    right = answers.unionByName(words.withColumns({"at": F.lit(None).cast("int"), "body": none}))
    out = texts.groupBy("chunk").cogroup(right.groupBy("of")).applyInArrow(lambda left, right: _scored(left, right, adapt, blocks, n_all, v_all, first, rest, escape), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("doc_id", id_col)
