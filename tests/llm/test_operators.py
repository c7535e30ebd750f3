"""Small cases of every operator: nulls, empty and long texts, ties, repeats, empty tables, clashing columns, brute force."""

import collections
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphloom.llm import common, decontaminate, exact_dedup, kd_shard, license_scan, packing, ppm, simhash, toxicity, url_rules, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "alpha beta gamma delta " * 6000


def docs_of(spark, rows, schema=DOCS):
    full = [(i, t, "en", "src0", len(t or "")) for i, t in rows]
    return spark.createDataFrame(full, schema).repartition(3)


def corpus(n=60, seed=0):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice(["tha", "on", "re", "én", "ish", "a"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 80)))) for i in range(n)]
    return [*rows, (n, None), (n + 1, ""), (n + 2, rows[3][1]), (n + 3, rows[3][1]), (n + 4, "one"), (n + 5, LONG), (n + 6, "")]


CLASH = "doc_id long, text string, id long, _id long, key long, body string, n long, digest string, keep_id long, shard int, label string, score double"


def test_clashing_columns_and_types_do_no_harm(spark):
    rows = [(1, "same text here now", *[None] * 10), (2, "same text here now", *[None] * 10), (None, None, *[None] * 10), (3, "apache license", *[None] * 10)]
    docs = spark.createDataFrame(rows, CLASH)
    assert packing.pack(docs).count() >= 4 and simhash.near_duplicates(docs).count() == 4
    assert license_scan.scan(docs).where("n_base = 1").count() == 1 and exact_dedup.dedup(docs).where("kept").count() == 3
    assert kd_shard.shard(docs, n_shards=2).count() == 4 and ppm.score(docs, F.lit(False)).count() == 4
    assert simhash.drop_near_copies(docs).columns == docs.columns and simhash.drop_near_copies(docs).count() == 3
    bench = spark.createDataFrame([(1, "apache license")], "item_id long, text string")
    assert decontaminate.find(docs, bench).count() == 1 and decontaminate.clean(docs, bench).count() == 3


ODD = [(1, None), (2, ""), (None, "null id"), (None, None), (3, "same text here"), (3, "same text here"), (4, "same text here"), (5, "\n\t ")]


# --- exact dedup ---


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: F.substring(F.sha2(c, 256), 1, 1)])
def test_dedup_is_exact_even_when_digests_collide(spark, keep, digest):
    rows = corpus()
    got = {r["doc_id"]: r for r in exact_dedup.dedup(docs_of(spark, rows), keep=keep, digest=digest, memtable_rows=7).collect()}
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    for i, t in rows:
        stays = (min if keep == "smallest" else max)(groups[t or ""])
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (stays, len(groups[t or ""]), i == stays)


def test_dedup_odd_rows(spark):
    out = exact_dedup.dedup(docs_of(spark, ODD), keep="largest", carry=("source",)).collect()
    assert len(out) == len(ODD)
    same = [r for r in out if r["doc_id"] in (3, 4)]
    assert [r["group_size"] for r in same] == [3, 3, 3] and sum(r["kept"] for r in same) == 1
    assert sum(r["kept"] for r in out) == 4 and all(r["source"] == "src0" for r in out)
    assert exact_dedup.dedup(docs_of(spark, ODD).limit(0)).count() == 0


# --- shards ---


def test_shards(spark):
    rows = [(i, t * 3 if t else t) for i, t in corpus(400)]
    rows = [r for r in rows if r[0] != 405]
    out = kd_shard.shard(docs_of(spark, rows), n_shards=5).collect()
    sizes = collections.Counter()
    slots = collections.defaultdict(list)
    of = {}
    texts = dict(rows)
    for r in out:
        body = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(body) + 1 and r["text_crc32"] == zlib.crc32(body)
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        assert of.setdefault(body, r["shard"]) == r["shard"]
    assert sorted(sizes) == list(range(5)) and max(sizes.values()) < 1.06 * min(sizes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert kd_shard.shard(docs_of(spark, rows).limit(0), n_shards=4).count() == 0
    assert kd_shard.shard(docs_of(spark, ODD), target_bytes=20).count() == len(ODD)


def test_shards_against_a_tree_by_hand(spark):
    """The same cuts, found by sorting each node's points: the widest dimension, the key nearest the weighted share."""
    rng = random.Random(21)
    rows = [(i, "x" * rng.choice([1, 3, 10, 40, 200]) + f" {i % 50}") for i in range(300)]
    got = {r["doc_id"]: r["shard"] for r in kd_shard.shard(docs_of(spark, rows), n_shards=6).collect()}
    texts = dict(rows)
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    hashed = {r["t"]: (r["h"], r["m0"], r["m1"]) for r in spark.createDataFrame([(t,) for t in groups], "t string").select("t", F.expr("shiftrightunsigned(xxhash64(unhex(sha2(t, 256))), 32)").alias("h"), F.expr("shiftrightunsigned(xxhash64('en'), 33)").alias("m0"), F.expr("shiftrightunsigned(xxhash64('src0'), 33)").alias("m1")).collect()}
    firsts, sizes = {t: min(ids) for t, ids in groups.items()}, {t: len(t.encode()) + 1 for t in groups}
    scale = lambda v, values: int((v - min(values)) / (max(values) - min(values)) * float(2**31 - 1)) if max(values) > min(values) else 0
    keys = {t: [(v << 32) | hashed[t][0] for v in (scale(firsts[t], list(firsts.values())), scale(sizes[t], list(sizes.values())), hashed[t][1], hashed[t][2])] for t in groups}
    weight = {t: sizes[t] * len(groups[t]) for t in groups}
    want = {}

    def cut(own, node, leaves):
        if leaves == 1 or not own:
            want.update({i: node for t in own for i in groups[t]})
            return
        half = leaves // 2
        spans = [max(keys[t][d] for t in own) - min(keys[t][d] for t in own) for d in range(4)]
        d = spans.index(max(spans))
        target, upto = sum(weight[t] for t in own) * half / leaves, 0
        ordered = sorted(own, key=lambda t: keys[t][d])
        for k, t in enumerate(ordered):
            before, upto = upto, upto + weight[t]
            if upto >= target:
                break
        n = k + 1 if abs(upto - target) < abs(target - before) else k
        cut(ordered[:n], node, half)
        cut(ordered[n:], node + half, leaves - half)

    cut(list(groups), 0, 6)
    assert got == want and len(texts) == 300


def test_plans_of_the_tree_stay_small(spark, monkeypatch):
    joins, keep = [], common.Scratch.keep

    def spy(self, df, name, **options):
        joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return keep(self, df, name, **options)

    monkeypatch.setattr(common.Scratch, "keep", spy)
    rows = [(k, f"text {k}" * (k % 7)) for k in range(60)]
    assert kd_shard.shard(docs_of(spark, rows), n_shards=4).count() == 60
    assert joins and max(joins) <= 3


def test_rounds_of_the_tree_leave_no_files(spark, monkeypatch):
    """What a round finds, a row a node, is not written but where nodes are too many for the driver; the shards are the same."""
    kept, keep = collections.Counter(), common.Scratch.keep
    monkeypatch.setattr(common.Scratch, "keep", lambda self, df, name, **options: kept.update([name]) or keep(self, df, name, **options))
    docs = docs_of(spark, [(k, f"text {k}" * (k % 7)) for k in range(60)])
    few = {r["doc_id"]: r["shard"] for r in kd_shard.shard(docs, n_shards=4).collect()}
    assert kept == {"rows": 1, "groups": 1, "points": 2, "placed": 1}
    monkeypatch.setattr(kd_shard, "MOST_BROADCAST", 1)
    assert few == {r["doc_id"]: r["shard"] for r in kd_shard.shard(docs, n_shards=4).collect()} and kept["nodes"] > 0


def test_numbering_is_dense_with_ties(spark):
    scratch = common.Scratch(spark, "t")
    df = scratch.keep(spark.range(500).select((F.col("id") % 2).alias("g"), (F.col("id") % 7).alias("o")), "x")
    got = collections.defaultdict(list)
    for r in common.numbered(df, ["g"], ["o"], "at", 3).collect():
        got[r["g"]].append(r["at"])
    assert all(sorted(v) == list(range(250)) for v in got.values())


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + k, 1001 + k) for k in range(40)] + [(7, 7)]
    parent = {v: v for e in edges for v in e}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    out = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a long, b long"), common.Scratch(spark, "cc")).collect()}
    linked = {v for e in edges for v in e if e[0] != e[1]}
    assert out == {v: find(v) for v in linked}


def test_dropped_tables_take_what_the_driver_freed_with_them(spark):
    """Native memory freed in pieces, with some in use between them, goes back to the system; the heap does not matter here."""
    pid = spark._jvm.java.lang.management.ManagementFactory.getRuntimeMXBean().getName().split("@")[0]

    def held_mb():
        with open(f"/proc/{pid}/status") as f:
            return next(int(line.split()[1]) for line in f if line.startswith("VmRSS")) >> 10

    packers = [spark._jvm.java.util.zip.Deflater() for _ in range(600)]
    for k, packer in enumerate(packers):
        if k % 20:
            packer.end()
    before = held_mb()
    common.Scratch(spark, "t").drop(collect=False)
    assert held_mb() < before - 40
    for packer in packers[::20]:
        packer.end()


def test_rounds_of_components_leave_no_files_of_earlier_ones(spark, monkeypatch):
    """The scanned buckets are gone when components begin, and each round frees its shuffle files."""
    held, freed, components, drop = [], [], common.components, common.Scratch.drop

    def begin(edges, scratch):
        held.append([path for path, _ in scratch.paths.values() if path is None])
        monkeypatch.setattr(common.Scratch, "drop", lambda self, *tables, collect=True: freed.append(collect) or drop(self, *tables, collect=collect))
        return components(edges, scratch)

    monkeypatch.setattr(simhash, "components", begin)
    words = [f"w{k}" for k in range(80)]
    rows = [(i, " ".join([*words[:40], f"x{i}", *words[40:]])) for i in range(6)]
    assert [r["doc_id"] for r in simhash.drop_near_copies(docs_of(spark, rows)).collect()] == [0]
    assert [len(x) for x in held] == [1] and len(freed) > 2 and all(freed)


def test_links_of_a_large_group_become_a_forest(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(3000)] + [(100 + k, 101 + k) for k in range(30)] + [(-5, 7)]
    table = spark.createDataFrame(edges, "a long, b long").repartition(3).cache()
    parts = len(edges) // 500 + 1
    forest = common.contracted(table, 500)
    assert forest.count() < parts * 75
    roots = lambda e: {r["node"]: r["root"] for r in common.components(e, common.Scratch(spark, "cc")).collect()}
    assert roots(forest) == roots(table) == roots(common.contracted(table))
    assert common.contracted(table.limit(0)).count() == 0


def test_near_copies_leave_few_files(spark, monkeypatch):
    """The tables with many partitions are held on the executors and given back; plans stay small, since what follows is written."""
    kept, keep = {}, common.Scratch.keep

    def spy(self, df, name, **options):
        kept[name] = max(kept.get(name, 0), df._jdf.queryExecution().executedPlan().toString().count("InMemoryTableScan"))
        return keep(self, df, name, **options)

    monkeypatch.setattr(common.Scratch, "keep", spy)
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    words = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join([*words, f"x{k}"])) for k in range(8)] + [(50, "one two three"), (51, None)]
    out = simhash.drop_near_copies(docs_of(spark, rows), shingle=5, similarity=0.8)
    assert sorted(r["doc_id"] for r in out.collect()) == [0, 50, 51]
    assert not set(kept) & {"prints", "scan"} and max(kept.values()) <= 24
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == before


# --- packing ---


def ids_of(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def test_tokens_equal_the_tokenizer():
    tokenizer = packing.load_tokenizer()
    for text in ["", "a", "  two  blanks ", "Étre öpf ß ñ½² _x_ it's don'T", "tab\t\n\n new\r\n", "汉字 пример \u2009 thin", "x" * 300, "1234 56%%% $$$", "\x85\xa0 nbsp\x1c!", "😀 emoji a\u0301", *[t for _, t in corpus(20) if t]]:
        assert tokenizer.encode(text) == ids_of(text)[:-1].tobytes()


def test_tokens_equal_the_tokenizer_on_odd_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    own, rng = packing.load_tokenizer(), random.Random(11)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    spaces = [chr(c) for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0x180E, 0x200B, 0xFEFF)]
    bits = [*spaces, *(chr(c) for c in range(0x20)), *"abzAZ09'.,-<|>", "'s", "'ll", "'T", "é", "ß", "ő", "漢", "ع", "²", "½", "٣", "Ⅷ", "\U0001f600", "e\u0301", "<|endoftext|>", "<|endof", "text|>", "hello", " the", "   "]
    near = [b for b in bits if all(c <= "ɏ" for c in b)]
    for k in range(6000):
        text = "".join(rng.choice(near if k % 2 else bits) for _ in range(rng.randint(0, 12)))
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("window", [16, 1024])
def test_packing_is_a_partition_without_padding(spark, window):
    rows = corpus(150)
    out = packing.pack(docs_of(spark, rows), window=window).collect()
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in out:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for i, text in rows:
        ids, at = ids_of(text), 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    padding = 0
    for rs in sequences.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    assert padding == 0
    assert packing.pack(docs_of(spark, rows).limit(0)).count() == 0
    assert packing.pack(docs_of(spark, ODD), window=window).select("doc_id").count() >= len(ODD)


@pytest.mark.parametrize("histogram", [{}, {1: 1}, {600: 1000}, {1024: 5, 3: 7}, {k: 50 for k in range(1, 1024)}, {700: 10**9, 324: 10**9 + 3, 511: 77}])
def test_plan_places_every_piece_once(histogram):
    plan = packing.make_plan(histogram)
    spans = collections.defaultdict(list)
    for length, a, b, *_ in [*plan.placed, *plan.cut]:
        spans[length].append((a, b))
    for length, n in histogram.items():
        at = 0
        for a, b in sorted(spans[length]):
            assert a == at
            at = b
        assert at == n
    assert sum(length * (b - a) for length, a, b, *_ in [*plan.placed, *plan.cut]) == sum(k * v for k, v in histogram.items())


def test_least_squares_does_most_of_the_packing():
    rng = np.random.default_rng(1)
    histogram = dict(enumerate(np.bincount(rng.integers(1, 1024, 200_000)).tolist()))
    plan = packing.make_plan({k: v for k, v in histogram.items() if v})
    assert sum(b - a for _, a, b, _ in plan.cut) < 0.03 * 200_000


# --- SimHash ---


def hamming(a, b):
    return (int(a, 16) ^ int(b, 16)).bit_count()


def brute_components(prints):
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in itertools.combinations(ids, 2):
        if hamming(prints[a], prints[b]) <= 4:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_keys_miss_no_pair():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    b = a.copy()
    for _ in range(4):
        b ^= np.uint64(1) << rng.integers(0, 64, len(b), dtype=np.uint64)
    (ka, ra), (kb, rb) = simhash.keys(a), simhash.keys(b)
    mine = set(zip(ka.tolist(), ra.tolist(), strict=True))
    assert {r for k, r in zip(kb.tolist(), rb.tolist(), strict=True) if (k, r) in mine} == set(range(len(a)))


@pytest.mark.parametrize("block", [2, 2048])
def test_fingerprints_and_components(spark, block):
    from xxhash import xxh64_intdigest

    rows = corpus(80, 2)
    words = rows[5][1].split()
    rows += [(500 + k, " ".join([*words[:k], "x", *words[k:]])) for k in range(min(30, len(words)))] + [(-1, "ONE"), (600, "Mixed CASE word")]
    out = {r["doc_id"]: r for r in simhash.near_duplicates(docs_of(spark, rows), block=block).collect()}
    assert len(out) == len(rows)
    for i, t in rows:
        w = (t or "").encode()
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in w).split()
        h = [xxh64_intdigest(b" ".join(w[k : k + 4]), 42) for k in range(max(1, len(w) - 3))] if w else []
        assert int(out[i]["fingerprint"], 16) == sum(1 << b for b in range(64) if h and 2 * sum(v >> b & 1 for v in h) > len(h))
    expected = brute_components({i: r["fingerprint"] for i, r in out.items()})
    assert {i: r["component_id"] for i, r in out.items()} == expected


def test_near_duplicates_odd_rows(spark):
    out = simhash.near_duplicates(docs_of(spark, ODD)).collect()
    assert len(out) == len(ODD)
    assert {r["component_id"] for r in out if r["fingerprint"] == "0" * 16} == {1}
    assert simhash.near_duplicates(docs_of(spark, ODD).limit(0)).count() == 0


@pytest.mark.parametrize("block", [1, 2048])
def test_near_copies_are_found_and_others_stay(spark, block):
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{rng.randrange(900)}" for _ in range(150))) for i in range(40)]
    planted = []
    for k in range(60):
        words = rows[k % 12][1].split()
        for _ in range(2):
            words[rng.randrange(len(words))] = "changed"
        planted.append((1000 + k, " ".join(words)))
    out = simhash.near_copies(docs_of(spark, [*rows, *planted]), block=block).collect()
    sets = {i: set(simhash.shingle_hashes(t, 5, 42).tolist()) for i, t in [*rows, *planted]}
    for r in out:
        a, b = sets[r["doc_id"]], sets[r["keep_id"]]
        assert r["keep_id"] < r["doc_id"] and len(a & b) / len(a | b) >= 0.8
    assert len(out) == len({r["doc_id"] for r in out}) and not {r["doc_id"] for r in out} & {i for i, _ in rows}
    assert len(out) >= 57
    assert simhash.near_copies(docs_of(spark, ODD).limit(0)).count() == 0
    assert simhash.near_copies(docs_of(spark, ODD)).count() >= 1


@pytest.mark.parametrize("block", [7, 1024])
def test_one_document_of_a_group_stays(spark, block):
    rng = random.Random(8)
    original = [f"w{rng.randrange(900)}" for _ in range(200)]
    rows = [(500, " ".join(original))]
    for k in range(40):
        words = list(original)
        for at in rng.sample(range(10, 190), 3):
            words[at] = f"changed{k}"
        rows.append((100 + k if k < 20 else 600 + k, " ".join(words)))
    rows += [(k, " ".join(f"x{rng.randrange(900)}" for _ in range(200))) for k in range(10)]
    sets = {i: set(simhash.shingle_hashes(t, 5, 42).tolist()) for i, t in rows}
    assert any(len(sets[100] & sets[i]) < 0.8 * len(sets[100] | sets[i]) for i in sets if i > 100)
    out = {r["doc_id"]: r["keep_id"] for r in simhash.near_copies(docs_of(spark, rows), block=block).collect()}
    assert out == {i: 100 for i, _ in rows if i > 100}


def test_repeated_lines_do_not_part_copies(spark):
    rng = random.Random(9)
    line = " ".join(f"l{k}" for k in range(12))
    text = " ".join(f"w{rng.randrange(900)}" for _ in range(60))
    once, often = f"{line} {line} {text}", f"{' '.join([line] * 80)} {text}"
    assert set(simhash.shingle_hashes(once, 5, 42).tolist()) == set(simhash.shingle_hashes(often, 5, 42).tolist())
    out = simhash.near_copies(docs_of(spark, [(1, once), (2, often), (3, "other words that are not alike at all")])).collect()
    assert [(r["doc_id"], r["keep_id"]) for r in out] == [(2, 1)]


@pytest.mark.parametrize("size", [9, 45, 270])
def test_candidates_hold_pairs_at_the_threshold(size):
    rng = np.random.default_rng(size)
    found = 0
    for _ in range(1000):
        every = np.unique(rng.integers(0, 2**64, size + size // 9, dtype=np.uint64))
        a, b = every[: size], np.r_[every[: size - size // 9], every[size:]]
        near = all(int(simhash.majority(f(a)) ^ simhash.majority(f(b))).bit_count() <= 26 for f in (lambda h: h, simhash._mixed))
        found += near and bool((simhash.bands(a) == simhash.bands(b)).any())
    assert found >= 998


@pytest.mark.parametrize("size", [9, 45, 270])
def test_wide_golay_keys_hold_pairs_at_the_threshold(size):
    rng = np.random.default_rng(size)
    sets = []
    for _ in range(1000):
        every = np.unique(rng.integers(0, 2**64, size + size // 9, dtype=np.uint64))
        sets.append((every[:size], np.r_[every[: size - size // 9], every[size:]]))
    a, b = (np.stack([simhash.fingerprints(pair[k]) for pair in sets]) for k in (0, 1))
    assert a[0, 0] == simhash.majority(sets[0][0]) and a[0, 1] == simhash.majority(simhash._mixed(sets[0][0]))
    (ka, ra), (kb, rb) = simhash.wide_keys(a), simhash.wide_keys(b)
    mine = set(zip(ka.tolist(), ra.tolist(), strict=True))
    shared = {r for k, r in zip(kb.tolist(), rb.tolist(), strict=True) if (k, r) in mine}
    near = set(np.flatnonzero(simhash._near(a[:, :2], b[:, :2], 26, 38)).tolist())
    assert len(shared & near) >= 998


def test_unrelated_texts_are_no_candidates(spark, monkeypatch):
    """Unrelated texts that share a key used to be compared by the key's own bits too, and their links' number grew with the square of the texts'."""
    links, contracted = set(), common.contracted
    monkeypatch.setattr(simhash, "contracted", lambda edges, *more: links.update(map(tuple, edges.collect())) or contracted(edges, *more))
    rng = random.Random(6)
    rows = [(k, " ".join(f"w{rng.randrange(5000)}" for _ in range(25))) for k in range(8000)]
    rows.append((9000, f"{rows[7][1]} w1"))
    out = simhash.near_copies(docs_of(spark, rows)).collect()
    assert [(r["doc_id"], r["keep_id"]) for r in out] == [(9000, 7)]
    assert len(links) == 1


def test_rounds_of_blocks_hold_every_pair_once(spark):
    """However large a component, a round copies a row to at most twice APART places."""
    rows = [(root, d, n, [d]) for root, n in ((1, 150), (2, 41), (3, 12)) for d in range(n)]
    large = spark.createDataFrame(rows, "root long, digest long, n long, shingles array<long>")
    met = {}
    for first in range(1, 8, simhash.APART):
        dealt, copies = {}, {}
        for r in simhash.block_pairs(large, 10, first).collect():
            dealt.setdefault((r["root"], r["i"], r["j"]), set()).add(r["digest"])
            copies[r["root"], r["digest"]] = copies.get((r["root"], r["digest"]), 0) + 1
        assert max(copies.values()) <= 2 * simhash.APART and not set(dealt) & set(met)
        met |= dealt
    for root, n in ((1, 150), (2, 41), (3, 12)):
        together = {(a, b) for (k, _, _), held in met.items() if k == root for a in held for b in held}
        assert len(together) == n * n


def test_near_pairs_of_buckets_against_all_pairs():
    rng = np.random.default_rng(3)
    value = rng.integers(0, 2**64, (60, 2), dtype=np.uint64)
    value[[5, 31, 32, 33]], ends = value[[2, 30, 30, 30]], np.array([10, 20, 50, 60])
    one, two, several = simhash._close(value, np.r_[0, ends[:-1]], ends, 26, 38)
    assert (one.tolist(), two.tolist(), several.tolist()) == ([2], [5], [2])


def test_groups_of_sets_against_brute_force():
    rng = random.Random(6)
    for _ in range(60):
        sets = []
        for _ in range(rng.randint(2, 5)):
            base = rng.sample(range(400), rng.randint(0, 30))
            sets += [np.array(sorted(set(base[rng.randint(0, 4) :]) | set(rng.sample(range(400), rng.randint(0, 3)))), np.int64) for _ in range(rng.randint(1, 8))]
        rng.shuffle(sets)
        label = list(range(len(sets)))
        for a, b in itertools.combinations(range(len(sets)), 2):
            x, y = set(sets[a].tolist()), set(sets[b].tolist())
            if len(x & y) >= 0.8 * len(x | y) - 1e-9:
                low, high = sorted((label[a], label[b]))
                label = [low if v == high else v for v in label]
        assert simhash.near_groups(sets, 0.8).tolist() == label


# --- URL rules ---


def test_url_rules_against_brute_force(spark):
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"), ("block", "a.b.org", "/"), ("allow", "b.org", "/x"), ("block", "", "/"), ("block", None, "/q")]
    urls = ["http://example.net/en/1", "https://WWW.Example.NET/en", "x://net/", "x://xnet/", "http://a.b.org/fr/1?x", "http://c.a.b.org#f", "http://c.a.b.org/x", "http://b.org/xy", "http://example.com/de/", "http://sub.example.com?/de/", "no scheme", "", None, "://", "http://net.", "http://a-b.net/z", "http://example.net", "http://..net/"] * 2
    pages = spark.createDataFrame([(k, u, "rule", "host") for k, u in enumerate(urls)], "page_id long, url string, rule string, host string")
    out = {r["page_id"]: r for r in url_rules.judge(pages, url_rules.rule_table(spark, [r for r in rules if r[1] is not None]), n_salts=3).collect()}
    assert len(out) == len(urls)
    for k, url in enumerate(urls):
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
            host, rest = rest[:cut].lower(), rest[cut:]
            path = rest[: min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]
        fit = [r for r in rules if r[1] and (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        best = max(fit, key=lambda r: len(r[1] + r[2]), default=None)
        assert (out[k]["host"], out[k]["path"]) == (host, path)
        assert (out[k]["rule"], out[k]["verdict"]) == ((best[1] + best[2], best[0]) if best else (None, "allow"))
    assert url_rules.judge(pages, url_rules.rule_table(spark, [])).where("verdict = 'allow' AND rule IS NULL").count() == len(urls)
    assert url_rules.judge(pages.limit(0), url_rules.rule_table(spark, rules[:2])).count() == 0


# --- PPM ---


def ppm_brute(rows, held, order, adapt):
    tk = {i: ppm.tokens(t) for i, t in rows}
    wc = collections.Counter(w for i in tk if not held(i) for w in tk[i])
    n, v = sum(wc.values()), len(wc)
    closed = lambda w: b" " + w + (b"" if w == ppm.END else b" ")
    cnt = collections.defaultdict(collections.Counter)
    for w, c in wc.items():
        x = closed(w)
        for i in range(1, len(x)):
            for k in range(0, min(order, i) + 1):
                cnt[min(k, order), x[i - k : i]][x[i]] += c
    for i in tk:
        if not held(i):
            for x, y in zip([ppm.END, *tk[i]], tk[i]):
                cnt["word", x][y] += 1
    b = lambda z: int(ppm.bucket(np.array(z)))
    see = collections.defaultdict(lambda: [0.5, 1.0])
    for (k, _), t in cnt.items():
        m, d, once = sum(t.values()), len(t), sum(c == 1 for c in t.values())
        if m > 1:
            see[k, b(m - 1), b(d - 1)][0] += once
            see[k, b(m - 1), b(d - 1)][1] += once
            see[k, b(m - 1), b(d)][1] += m - once

    def q(k, m, d):
        key = (k, b(m), b(d))
        return see[key][0] / see[key][1] if key in see else 0.5

    def trie(x, i, symbol):
        excluded, s = set(), 0.0
        for k in range(min(order, i), -1, -1):
            t = cnt.get((k, x[i - k : i]))
            if not t:
                continue
            m, d = sum(c for y, c in t.items() if y not in excluded), sum(y not in excluded for y in t)
            if d:
                if symbol in t:
                    return s + math.log10(t[symbol] / m * (1 - q(k, m, d)))
                s += math.log10(q(k, m, d))
            excluded = set(t)
        return s - math.log10(max(1, 256 - len(excluded)))

    spelled = lambda w: 10 ** sum(trie(closed(w), a, closed(w)[a]) for a in range(1, len(closed(w))))
    escaped = (sum(c == 1 for c in wc.values()) + 0.5) / (n + 1)
    rest = 1 - sum(spelled(w) for w in wc)
    alone = lambda w: wc[w] / n * (1 - escaped) if wc[w] else escaped * spelled(w) / rest

    def after(x, w):
        t = cnt.get(("word", x))
        if not t:
            return alone(w)
        e = q("word", sum(t.values()), len(t))
        return t[w] / sum(t.values()) * (1 - e) if w in t else e * alone(w) / (1 - sum(alone(y) for y in t))

    out = {}
    for i in tk:
        before, total = collections.Counter(), 0.0
        for j, (x, w) in enumerate(zip([ppm.END, *tk[i]], tk[i])):
            total += math.log10((before[w] + adapt * after(x, w)) / (j + adapt))
            before[w] += 1
        out[i] = (len(tk[i]), sum(wc[w] > 0 for w in tk[i]), n, sum(math.log10((wc[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tk[i]), total)
    return out


@pytest.mark.parametrize("order", [2, 5])
def test_ppm_against_brute_force(spark, order, monkeypatch):
    monkeypatch.setattr(ppm, "BLOCK_TOKENS", 700)
    rows = [r for r in corpus(40, 7) if r[1] != LONG]
    out = ppm.score(docs_of(spark, rows), F.col("doc_id") % 5 == 1, order=order, adapt=50.0).collect()
    want = ppm_brute(rows, lambda i: i % 5 == 1, order, 50.0)
    assert len(out) == len(rows)
    for r in out:
        n, known, total, base, score = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(score)


def test_chunks_take_rows_by_the_batch_and_hold_their_tokens(monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a", "B", "Éé", "中", "\x00", " ", "\t", "\x0b", "\x0c\r\n", "\x1c", "\x85", "\xa0"]) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    texts[5:9] = [None, "", "  ", "x" * 5000]
    held = [i % 5 == 1 for i in range(300)]
    rows = pa.record_batch([pa.array(range(300)), pa.array(held), pa.array(texts)], names=["id", "held", "text"])
    now = ppm._Chunk()
    for s, e in ((0, 0), (0, 7), (7, 8), (8, 300)):
        part = rows.slice(s, e - s)
        now.add_rows(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2))
    out = now.batch()
    get = lambda n: out.column(n)[0].as_py()
    want = [ppm.tokens(t) for t in texts]
    body = np.frombuffer(get("low"), "<u2") + (np.frombuffer(get("high"), "<u2").astype(np.int64) << 16)
    assert [get("words")[k] for k in body] == list(itertools.chain.from_iterable(want)) and get("sizes") == [len(t) for t in want]
    counts = collections.Counter(itertools.chain.from_iterable(t for t, h in zip(want, held) if not h))
    assert len(set(get("words"))) == len(get("words")) and get("counts") == [counts[w] for w in get("words")]
    # no chunk goes beyond its bytes, however the batch ends
    monkeypatch.setattr(ppm, "CHUNK_BYTES", 5 << 20)
    long = pa.record_batch([pa.array(range(4000)), pa.array([False] * 4000), pa.array([f"{i} " + "ab c " * 1000 for i in range(4000)])], names=["id", "held", "text"])
    sizes = [sum(c.column("sizes")[0].as_py()) for c in ppm._to_chunks(iter([long]))]
    assert sum(sizes) == 4000 * 2002 and max(sizes) * 2.5 <= 5 << 20
    # the vocabulary's windows, from the arrays that Arrow brings
    words, n = get("words"), 23
    batch = pa.record_batch([pa.array(words, pa.binary()), pa.array(range(len(words)))], names=["word", "c"])
    shelves = pa.Table.from_batches(ppm._to_shelves(iter([batch.slice(0, n), batch.slice(n), batch.slice(0, 0)]), 2))
    found = collections.Counter()
    for c, w in enumerate(words):
        x = b" " + w + (b"" if w == ppm.END else b" ")
        for i in range(1, len(x)):
            found[min(i, 2) + 1 << 56 | int.from_bytes(x[max(0, i - 2) : i + 1], "big")] += c
    assert dict(zip(shelves.column("codes")[0].as_py(), shelves.column("weights")[0].as_py())) == found
    order, sorted_ = ppm._ordered(np.array([5, 0, 2**62, 5, 0]))
    assert order.tolist() == [1, 4, 0, 3, 2] and sorted_.tolist() == [0, 0, 5, 5, 2**62]
    assert [x.tolist() for x in ppm._ordered(np.array([3, 1, 3, 0]))] == [[3, 1, 0, 2], [0, 1, 3, 3]]


def test_hot_words_before_are_dealt_to_several_blocks_and_give_the_same():
    rng = np.random.default_rng(3)
    words = [f"w{k}".encode() for k in range(50)]
    chunks = []
    for _ in range(3):
        now = ppm._Chunk()
        for i in range(20):
            now.add(i, i % 5 == 1, b" ".join(words[k] for k in rng.zipf(1.3, 40) % 50).decode())
        chunks.append(pa.Table.from_batches([now.batch()]))
    total = collections.Counter()
    for c in chunks:
        total.update(dict(zip(c.column("words")[0].as_py(), c.column("counts")[0].as_py())))
    results = []
    for hot in (5, 10**9):
        ppm.HOT_TOKENS = hot
        sent, pairs = [], []
        for c in chunks:
            own = c.column("words")[0].as_py()
            row = c.append_column("h", pa.array([[int.from_bytes(hashlib.md5(w).digest()[:8], "little", signed=True) for w in own]])).append_column("c", pa.array([[total[w] for w in own]]))
            pairs.append(ppm._Pairs(row, 4))
            sent.append(ppm._chunk_blocks(row, 4))
        sent = pa.concat_tables(sent)
        counted = [ppm._count_block(sent.filter(pa.compute.equal(sent.column("block"), b))) for b in set(sent.column("block").to_pylist())]
        stats, found = collections.Counter(), []
        for t in counted:
            for h, d, once, mass in zip(*(t.column(x).to_pylist() for x in ("h", "d", "once", "mass"))):
                for row in zip(h or [], d or [], once or [], mass or []):
                    for k in (1, 2, 3):
                        stats[row[0], k] += row[k]
        for c, p in zip(chunks, pairs):
            rows = [(b, x) for t in counted for n, b, x in zip(t.column("chunk").to_pylist(), t.column("block").to_pylist(), t.column("body").to_pylist()) if n == c.column("chunk")[0].as_py()]
            got = np.zeros(len(p.order), np.int64)
            got[p.order] = np.concatenate([ppm.unpacked(x) for _, x in sorted(rows)])
            found.append(got[p.at].tolist())
        results.append((dict(stats), found))
    ppm.HOT_TOKENS = 500_000
    assert results[0] == results[1]


@pytest.mark.parametrize("hot", [3, 10**9])
def test_pairs_are_told_apart_and_dealt_as_by_hand(hot, monkeypatch):
    monkeypatch.setattr(ppm, "HOT_TOKENS", hot)
    rng = np.random.default_rng(7)
    chunk = ppm._Chunk()
    for k in range(20):
        chunk.add(k, k % 5 == 1, " ".join(f"w{w}" for w in rng.integers(0, 30, k * 3)))
    row = chunk.batch()
    words = row.column("words")[0].as_py()
    h = rng.integers(-(2**63), 2**63 - 1, len(words))
    table = pa.table({n: row.column(n) for n in ("chunk", "held", "sizes", "low", "high")} | {"h": pa.array([h]), "c": row.column("counts")})
    p = ppm._Pairs(table, 7)
    number, seen, at = {w: k for k, w in enumerate(words)}, collections.Counter(), []
    rng = np.random.default_rng(7)
    for k in range(20):
        body = [number[w] for w in ppm.tokens(" ".join(f"w{w}" for w in rng.integers(0, 30, k * 3)))]
        own = list(zip([body[-1], *body[:-1]], body, strict=True))
        at += own
        seen.update({} if k % 5 == 1 else own)
    pairs = list(zip(p.v.tolist(), p.w.tolist(), strict=True))
    assert [pairs[k] for k in p.at] == at and len(set(pairs)) == len(pairs)
    assert {x: n for x, n in zip(pairs, p.seen.tolist(), strict=True) if n} == seen
    c, u = row.column("counts")[0].as_py(), h.view(np.uint64).tolist()
    deal = lambda v, w: ((u[v] + u[w] % (1 + c[v] // hot) * 0x9E3779B97F4A7C15) * 0xBF58476D1CE4E5B9 % 2**64 >> 33) % 7
    assert p.block.tolist() == [deal(v, w) for v, w in pairs]
    assert p.order.tolist() == sorted(range(len(pairs)), key=lambda k: (p.block[k], u[pairs[k][0]], u[pairs[k][1]]))
    many = np.array([5, 2**62, 5, 0])
    assert [x.tolist() for x in ppm._different(many, 63)] == [[0, 5, 2**62], [1, 2, 1, 0]] == [x.tolist() for x in (np.unique(many), ppm._different(np.array([5, 9, 5, 0]), 4)[1])]


def test_looked_up_rows_come_back_from_packed_columns(monkeypatch):
    monkeypatch.setattr(ppm, "PACK_ROWS", 700)
    rng = np.random.default_rng(5)
    at = {7: rng.permutation(900), 2**62 + 1: rng.permutation(400), 3: np.array([0])}
    of = np.concatenate([np.full(len(v), k) for k, v in at.items()])
    by = rng.permutation(len(of))
    h, c, lp = rng.integers(-(2**63), 2**63, len(of)), rng.integers(0, 2**40, len(of)), -rng.random(len(of)) * 300
    rows = pa.table({"of": of[by], "at": pa.array(np.concatenate(list(at.values()))[by], pa.int32()), "h": h[by], "c": c[by], "lp": lp[by]})
    found = pa.Table.from_batches(ppm._to_columns(iter(rows.to_batches(max_chunksize=333)), ("h",)))
    assert len(found) > 3 and sum(len(ppm._places(found.slice(k, 1))) for k in range(len(found))) == len(of)
    for chunk, places in at.items():
        left = pa.table({"chunk": [chunk], "doc_ids": [[1]], "held": [[False]], "sizes": [[1]], "low": [b""], "high": [b""]})
        out = ppm._looked_up(left, found.filter(pa.compute.equal(found.column("of"), chunk)))
        for name, values in (("h", h), ("c", c), ("lp", lp)):
            assert np.array_equal(np.array(out.column(name)[0].as_py())[places], values[of == chunk])


def test_ppm_sees_the_order_of_words(spark):
    rng = random.Random(4)
    text = "the cat sat on a mat while rain fell over the old town and nobody came"
    shuffled = text.split()
    rng.shuffle(shuffled)
    fresh = [" ".join(rng.choice("lorem ipsum dolor sit amet cat town rain the a".split()) for _ in range(14)) for _ in range(10)]
    rows = [(k, text) for k in range(6)] + [(10, text), (11, " ".join(shuffled))] + [(20 + k, t) for k, t in enumerate(fresh)]
    out = {r["doc_id"]: r["score"] for r in ppm.score(docs_of(spark, rows), F.col("doc_id").isin(10, 11)).collect()}
    assert out[10] > out[11] + 5


def test_ppm_odd_rows(spark):
    assert ppm.score(docs_of(spark, ODD), F.lit(False)).count() == len(ODD)
    assert ppm.score(docs_of(spark, ODD).limit(0), F.lit(False)).count() == 0
    only = ppm.score(docs_of(spark, [(1, "abc"), (2, LONG)]), F.lit(True)).collect()
    assert all(math.isfinite(r["score"]) and r["n_known"] == 0 for r in only)


# --- license scans ---


def test_license_scan(spark):
    rows = [
        (1, "This file: Licensed under the Apache License, Version 2.0."), (2, "mit license MIT-license"), (3, "nothing"), (4, None), (5, ""), (6, LONG),
        (7, "free to any person: permission is hereby granted, of charge, to person obtaining copy of this software and associated documentation files"), (8, "cc by-nc 4.0 apache license"), (9, "under the license"),
    ]
    out = {r["doc_id"]: r for r in license_scan.scan(docs_of(spark, rows)).collect()}
    assert (out[1]["n_base"], out[1]["first_word"], out[1]["base_labels"], out[1]["labels"]) == (1, 5, "apache", "apache,apache-2.0-notice")
    assert (out[2]["n_base"], out[2]["first_word"], out[2]["last_word"], out[2]["score"]) == (2, 0, 2, 1.0)
    assert (out[7]["base_labels"], out[7]["labels"]) == ("", "mit-permission") and 0.8 <= out[7]["score"] < 1
    assert out[8]["base_labels"] == "apache,cc-by"
    for i in (3, 4, 5, 6, 9):
        assert (out[i]["n_base"], out[i]["first_word"], out[i]["labels"], out[i]["score"]) == (0, None, "", 0.0)
    assert out[6]["n_words"] == 24000 and license_scan.scan(docs_of(spark, rows).limit(0)).count() == 0
    assert license_scan.scan(docs_of(spark, ODD)).count() == len(ODD)


def test_base_scan_against_brute_force():
    rng = random.Random(5)
    bits = ["gnu", "general", "public", "license", "apache", "cc", "by", "mit", "Mit", "x", "-", ". ", "é"]
    spaced = [(b" " + p.encode() + b" ", 0, label) for p, label in license_scan.PHRASES.items()]
    for _ in range(2000):
        found = license_scan.words(" ".join(rng.choice(bits) for _ in range(rng.randint(0, 40))))
        places = [(k, label) for p, label in license_scan.PHRASES.items() for k in range(len(found)) if found[k : k + len(p.split())] == p.encode().split()]
        want = (len(places), min((k for k, _ in places), default=None), max((k for k, _ in places), default=None), {x for _, x in places})
        assert license_scan.phrase_places(found, spaced) == want


def test_template_join_is_exact():
    rng = random.Random(1)
    vocabulary = [f"t{k}".encode() for k in range(30)]
    templates = {f"l{k}": " ".join(rng.choice(vocabulary).decode() for _ in range(rng.randint(2, 9))) for k in range(12)}
    frequency = {t: rng.randrange(50) for t in vocabulary}
    index = license_scan.TemplateIndex(templates, frequency, 0.7)
    for _ in range(200):
        found = [rng.choice(vocabulary) for _ in range(rng.randint(0, 40))]
        want = {}
        for label, text in templates.items():
            words = license_scan.words(text)
            s, own = len(words), set(words)
            best = max((len(own & set(found[k * s : k * s + 2 * s])) / len(own) for k in range(len(found) // s + 1)), default=0)
            if best >= 0.7 - 1e-9:
                want[label] = best
        assert index.matches(found, set(found)) == pytest.approx(want)


def test_a_stretched_template_is_found_at_any_place():
    notice = [f"n{k}".encode() for k in range(20)]
    index = license_scan.TemplateIndex({"l": b" ".join(notice).decode()}, {}, 0.8)
    kept = [w for w in notice if w not in (b"n5", b"n13")]
    stretched = kept[:9] + [b"x"] * 8 + kept[9:]
    for start in range(45):
        found = [b"y"] * start + stretched + [b"y"] * 30
        assert index.matches(found, set(found), slide=True) == pytest.approx({"l": 0.9})
    rng = random.Random(3)
    for _ in range(300):
        found = [rng.choice([*notice[:9], b"y", b"z"]) for _ in range(rng.randint(0, 60))]
        index = license_scan.TemplateIndex({"l": b" ".join(notice[:6]).decode()}, {t: rng.randrange(9) for t in notice}, 0.7)
        best = max(len(set(notice[:6]) & set(found[k : k + 12])) / 6 for k in range(len(found) + 1))
        assert index.matches(found, set(found), slide=True) == pytest.approx({"l": best} if best >= 0.7 else {})


# --- decontamination ---


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_best_window_is_the_best():
    rng = np.random.default_rng(2)
    for _ in range(60):
        item, region = rng.integers(0, 4, rng.integers(1, 8)), rng.integers(0, 4, rng.integers(0, 14))
        got, start, end = decontaminate.best_window(item, region)
        want = min(edits(item.tolist(), region[a:b].tolist()) for a in range(len(region) + 1) for b in range(a, len(region) + 1))
        assert got == want == edits(item.tolist(), region[start:end].tolist())


@pytest.mark.parametrize("n", [12, 25, 60, 150])
def test_items_of_any_length_are_found_at_the_most_edits(n):
    rng = random.Random(n)
    words = [f"v{k}" for k in range(3000)]
    items = [(k, " ".join(rng.choice(words) for _ in range(n))) for k in range(20)]
    index = decontaminate.Index(items, 0.8, 6, 8, 3)
    for kind in ("delete", "insert", "replace"):
        texts = []
        for _, text in items:
            leak = text.split()
            for _ in range(decontaminate.allowed(n, 0.8)):
                at = rng.randrange(len(leak))
                leak[at : at + 1] = {"delete": [], "insert": [leak[at], "new"], "replace": ["new"]}[kind]
            texts.append(" ".join([rng.choice(words) for _ in range(40)] + leak + [rng.choice(words) for _ in range(40)]).encode().split())
        found = {(h[0], h[1]) for h in index.search(texts)}
        assert sum((k, k) in found for k in range(20)) >= 19, kind


def test_leaks_are_found(spark):
    rng = random.Random(6)
    words = [f"v{k}" for k in range(400)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for k in range(40)] + [(90, None), (91, ""), (92, "...")]
    rows, planted = [], {}
    for i in range(160):
        fill = [rng.choice(words) for _ in range(120)]
        if i % 2:
            k = i % 40
            leak = items[k][1].split()
            n = len(leak)
            for _ in range(rng.randint(0, decontaminate.allowed(n, 0.8))):
                at = rng.randrange(len(leak))
                leak[at : at + 1] = rng.choice([["changed"], [], [leak[at], "more"]]) if len(leak) > 1 else leak
            if edits(items[k][1].split(), leak) <= decontaminate.allowed(n, 0.8):
                planted[i] = k
                fill = fill[:50] + leak + fill[50:]
        rows.append((i, " ".join(fill)))
    bench = spark.createDataFrame([(k, t, "x") for k, t in items], "item_id long, text string, doc_id string")
    out = decontaminate.find(docs_of(spark, [*rows, (500, None), (501, ""), (502, LONG)]), bench, block_bytes=2000).collect()
    found = {(r["doc_id"], r["item_id"]) for r in out}
    assert sum((i, k) in found for i, k in planted.items()) >= 0.95 * len(planted)
    texts, items = dict(rows), dict(items)
    for r in out:
        stretch = texts[r["doc_id"]].split()[r["start_word"] : r["start_word"] + r["window_words"]]
        n = len(items[r["item_id"]].split())
        assert edits(items[r["item_id"]].split(), stretch) == r["edits"] <= decontaminate.allowed(n, 0.8)
    assert decontaminate.find(docs_of(spark, rows), bench.limit(0)).count() == 0
    assert decontaminate.find(docs_of(spark, ODD), bench).count() == 0


# --- WARC ---


@pytest.mark.parametrize("least", [0, 10])
def test_archive_round_trip(spark, least):
    pages = [(1, "http://a/\r\nX: y", "<p>é</p>" * 5), (2, None, None), (3, "http://c", "<p>é</p>" * 5), (4, "", ""), (0, "http://d", "short"), (9, "http://e", "short"), (11, "http://x/?WARC-Type: revisit", "only one"), (12, "http://x/?%0D%0A", "<p>é</p>" * 5), (7, "u", "line\r\n\r\nWARC/1.1\r\nWARC-Type: revisit\r\n")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, record_type string")
    path = common.Scratch(spark, "w").path("a")
    warc.write_archive(df, path, min_bytes=least)
    got = {r["page_id"]: r for r in warc.read_archive(spark, path).collect()}
    groups = collections.defaultdict(list)
    for i, _, h in pages:
        groups[h or ""].append(i)
    import base64

    for i, u, h in pages:
        body = (h or "").encode()
        assert got[i]["url"] == u
        low = min(groups[h or ""])
        revisit = i != low and len(body) >= least
        assert got[i]["intact"] and got[i]["payload_bytes"] == len(body)
        assert got[i]["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert (got[i]["record_type"], got[i]["refers_to"]) == (("revisit", low) if revisit else ("response", None))
    assert warc.payloads(spark, path).count() == len(groups)
    out = common.Scratch(spark, "w").path("files")
    warc.export(spark, path, out)
    import glob

    found = {}
    for name in glob.glob(f"{out.removeprefix('file:')}/part-*"):
        raw = open(name, "rb").read()
        while raw:
            head, rest = raw.split(b"\r\n\r\n", 1)
            fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
            n = int(fields[b"Content-Length"])
            assert head.startswith(b"WARC/1.1\r\n") and rest[n : n + 4] == b"\r\n\r\n"
            found[int(fields[b"WARC-Record-ID"].split(b":")[-1][:-1])], raw = (fields[b"WARC-Type"].decode(), rest[:n]), rest[n + 4 :]
    assert found == {i: (got[i]["record_type"], b"" if got[i]["record_type"] == "revisit" else (h or "").encode()) for i, _, h in pages}
    record = next(bytes(r["record"]) for r in warc.records(spark, path).collect() if b":page:7>" in bytes(r["header"]))
    assert record.endswith(pages[-1][2].encode() + b"\r\n\r\n") and record.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n")
    empty = common.Scratch(spark, "w").path("a")
    warc.write_archive(df.limit(0), empty)
    assert warc.read_archive(spark, empty).count() == 0


# --- toxicity ---


def test_toxicity_learns_expressions(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice(["tha", "on", "re", "ish", "mo"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(vocabulary) for _ in range(80)]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(80)] = rng.choice(["vilething", "nastyword", "awfulness"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic), 1))
    docs, table = docs_of(spark, rows), spark.createDataFrame([*labels, (None, 1, 1), (3, None, 0)], "doc_id long, toxic int, quality int")
    scorer = toxicity.fit(docs, table.where("doc_id < 300 OR doc_id IS NULL"))
    out = toxicity.score(docs, scorer).where("doc_id >= 300").collect()
    assert sum((r["score"] >= 0.3) == (r["doc_id"] % 5 == 0) for r in out) >= 0.97 * len(out)
    odd = toxicity.score(docs_of(spark, [*ODD, (9, LONG)]), scorer).collect()
    assert len(odd) == len(ODD) + 1 and all(0 <= r["score"] <= 1 for r in odd)
    assert toxicity.score(docs.limit(0), scorer).count() == 0
    unlabelled = toxicity.fit(docs, table.limit(0))
    assert [r["score"] for r in toxicity.score(docs, unlabelled).select("score").distinct().collect()] == [pytest.approx(1e-6)]


def test_a_worker_holds_the_model_once_and_no_tokenizer_beside_it():
    import tracemalloc

    n = 1 << 20
    model = toxicity.KneserNey(1, 0.5, (np.arange(n, dtype=np.uint64), *[np.random.default_rng(5).random(n, np.float32)] * 2), (), [])
    scorer = toxicity.Scorer(model, toxicity.Pairs.fit([], np.zeros(0), 0), {b"a": 0}, np.zeros(5), 0.5, np.zeros(5), np.ones(5))
    body = toxicity._squeezed(scorer)
    tracemalloc.start()
    out = toxicity._restored(body)
    now, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert most < 1.2 * now and out.number == {b"a": 0} and out.bias == 0.5
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(out.model.grams, model.grams, strict=True))
    # the next operator in a worker frees what the tokenizer keeps from task to task
    loaded = packing.load_tokenizer()
    assert packing.load_tokenizer() is loaded
    list(common.parts(iter([pa.record_batch([pa.array(["a"])], names=["text"])]), 0, owner="packing"))
    assert packing.load_tokenizer() is loaded
    list(common.parts(iter([pa.record_batch([pa.array(["a"])], names=["text"])]), 0))
    assert packing.load_tokenizer() is not loaded


def test_expressions_of_ordinary_words_count():
    rng = random.Random(12)
    vocabulary = [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)] + ["white", "trash"]
    texts, toxic = [], []
    for i in range(400):
        words = [rng.choice(vocabulary) for _ in range(60)]
        at = rng.sample(range(5, 55), 8)
        for k in at[:4]:
            if i % 2:
                words[k : k + 2] = ["white", "trash"]
            else:
                words[k], words[at[4]] = "white", "trash"
        texts.append(" ".join(words))
        toxic.append(i % 2)
    scorer = toxicity.fit_texts(texts[:300], toxic[:300], 0.5)
    p = scorer.probability(np.array(toxicity._Known(scorer).rows([toxicity.words(t) for t in texts[300:]])))
    assert sum((p >= 0.5) == np.array(toxic[300:])) >= 95


def test_class_models_sum_to_one():
    rng = np.random.default_rng(4)
    words = [bytes(rng.integers(97, 100, rng.integers(1, 5)).tolist()) for _ in range(30)]
    words = list(dict.fromkeys(words))
    n = [rng.integers(0, 4, len(words)) for _ in (0, 1)]
    model = toxicity.KneserNey.fit(words, *n, order=3)
    for prefix in (b"", b"a", b"ab", b"abc", b"cab", b"zz"):
        total = np.zeros(2)
        for byte in range(256):
            at = toxicity.Positions([prefix + bytes([byte])], 3)
            total += np.exp(model.byte_logs(at)[:, len(prefix)])
        assert total == pytest.approx([1, 1], abs=1e-4)
    # the order above: a word after a word, over all words of a closed vocabulary
    texts = [rng.integers(0, 6, 40) for _ in range(4)]
    pairs = toxicity.Pairs.fit(texts, np.array([0, 1, 1, 0]), 6)
    low = rng.random((2, 6))
    low = np.log(low / low.sum(1, keepdims=True))
    for v in range(6):
        assert np.exp(pairs.logs(np.full(6, v), np.arange(6), low)).sum(1) == pytest.approx([1, 1], abs=1e-5)


@pytest.mark.parametrize("size", [0, 1, 2, 3, 7, 1000, 50_000])
def test_finder_looks_up_as_a_binary_search(size):
    rng = np.random.default_rng(size)
    table = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
    if size > 2:
        table = np.unique(np.r_[table, np.uint64(0), np.uint64(2**64 - 1), table[:1] + np.arange(200, dtype=np.uint64)])
    keys = np.r_[table, table + np.uint64(1), table - np.uint64(1), rng.integers(0, 2**64, 500, dtype=np.uint64), np.uint64(0), np.uint64(2**64 - 1)]
    (row, have), (at, seen) = toxicity.Finder(table)(keys), toxicity._found(table, keys)
    assert have.tolist() == seen.tolist() == np.isin(keys, table).tolist() and row.tolist() == at.tolist()


def test_class_models_are_distributions():
    words = [b"abc", b"abd", b"xyz", b"ab"]
    model = toxicity.KneserNey.fit(words, np.array([5, 0, 3, 1]), np.array([0, 4, 0, 1]), order=3)
    assert model.ratios([b"abd"])[0] > 0 > model.ratios([b"abc"])[0] and model.ratios([b"qqq"])[0] == pytest.approx(0, abs=1)
    assert toxicity.KneserNey.fit([], np.zeros(0), np.zeros(0)).ratios([b"a"])[0] == 0
