"""Dehyphenation, merging, evaluation, sampling, neural scoring."""

import numpy as np
import pyarrow as pa
import pytest

from glyphloom.functions import text
from glyphloom.operators import dehyphen, evaluate, neural, ngram, ocr, sample, score

RULES = [
    # e1, sep, e2, label, rule
    ("alma", "-, ", "körte", "3", 1), ("bel", "- ", "és", "4", 2), ("ABC", "-\n", "vel", "3", 3), ("12", "-\n", "es", "3", 4), ("ház", "-\n", "t", "3", 5),
    ("e", "-\n", "körte", "3", 6), ("alma", "-\n", "e", "3", 7), ("öt", "-\n", "öt", "3", 8), ("vissz", "-\n", "szó", "2", 9), ("ny", "-\n", "nyq", "3", 9),
    ("kis", "-\n", "lány", "3", 10), ("könyv", "-\n", "tár", "1", 11), ("docu", "-\n", "mentum", "1", 12), ("Alma", "-\n", "körte", "3", 13), ("spel", "-\n", "led", "1", 14),
    ("xm", "-\n", "ya", "1", 15), ("qm", "-\n", "zaz", "3", 16), ("foo", "-\n", "bar", "4", 17), ("foo", "-", "bar", "3", 18),
]


def test_rules_in_order(spark):
    found = spark.createDataFrame([r[:3] for r in RULES], "e1 string, sep string, e2 string")
    counts = spark.createDataFrame([("kis-lány", 3), ("könyvtár", 2), ("Alma", 1)], "word string, cnt long")
    lexicon = spark.createDataFrame([(w,) for w in ("alma", "körte", "visszszó", "spelled", "xrnya", "qrn-zaz", "visszsző")], "word string")
    long = spark.createDataFrame([("visssz" + "ó",), ("visszó",), ("visssz",), ("visssz",), ("vissszó",)], "word string")
    lexicon = lexicon.unionByName(long)
    document = spark.createDataFrame([("documentum", 1)], "word string, cnt long")
    out = {(r["e1"], r["sep"], r["e2"]): r for r in dehyphen.rules(found, counts, lexicon, document, strict=False).collect()}
    for e1, sep, e2, label, rule in RULES:
        r = out[e1, sep, e2]
        assert (r["rule"], r["label"]) == (rule, label), (e1, sep, e2, r)
    assert out["xm", "-\n", "ya"]["replacement"] == "xrnya" and out["foo", "-\n", "bar"]["replacement"] == "foo- bar"


def test_rewrite_restarts_inside_chains(spark):
    df = spark.createDataFrame([(1, "a-\nb-\nc d-e"), (2, None), (3, "")], "id long, t string")
    out = {r["id"]: r["rewritten"] for r in dehyphen.rewrite(df, "id", "t", lambda a, s, b: a + s + b if a == "a" else a + b).collect()}
    assert out == {1: "a-\nbc d-e", 2: None, 3: ""}


def test_variants_choose_the_known_word(spark):
    corpus = spark.createDataFrame([("the window is open",)] * 5 + [("the well-known window",)] * 5, "t string")
    grams = ngram.ngram_counts(corpus, "t", 4)
    texts = spark.createDataFrame([(1, "the win-\ndow is"), (2, "the well-\nknown win"), (3, "the -\nwindow")], "id long, t string")
    spots = dehyphen.hyphen_contexts(texts, "id", "t", 16)
    out = {r["id"]: r["label"] for r in dehyphen.by_perplexity(spots, "id", ngram.build(grams, 4), ngram.build(score.reversed_counts(grams), 4)).collect()}
    assert out == {1: "1", 2: "3", 3: "5"}
    double = spark.createDataFrame([(1, 0, "asz", "szony")], "id long, no int, left_ctx string, right_ctx string")
    assert {r["label"]: r["variant"] for r in dehyphen.variants(double, "id").collect()}["2"] == "asszony"


def test_rewrite_by_rules_against_a_walk(spark):
    import random

    import regex

    rng = random.Random(3)
    pieces = ["alma", "fa", "könyv", "tár", "ABC", "12", "e", "és", "szó", "t", "Kis", "lány", "m", "om"]
    seps = ["-\n", "-\n\n", "–\n", "-", " ", "-\n-\n", "\n"]
    texts = [(k, "".join(rng.choice(pieces) + rng.choice(seps) for _ in range(rng.randint(0, 14)))) for k in range(120)] + [(900, None), (901, ""), (7, "alma-\nfa")]
    counts = [("almafa", 3), ("könyvtár", 9), ("alma", 5), ("lány", 3), ("kis-lány", 2)]
    lexicon = ["alma", "fa", "szó", "tár", "könyv"]
    words = spark.createDataFrame(counts, "word string, cnt long")
    spelled = spark.createDataFrame([(w,) for w in lexicon], "word string")
    df = spark.createDataFrame(texts, "id long, t string")
    got = sorted(((r["id"], r["rewritten"], tuple(r["labels"])) for r in dehyphen.rewrite_by_rules(df, "id", "t", words, spelled).collect()), key=repr)
    pattern = regex.compile(r"(\p{L}+|\p{Nd}+)(\p{Pd}\n+)(\p{Ll}+)")
    found = {m.groups() for _, t in texts if t for at in range(len(t)) if (m := pattern.search(t, at))}
    asked = spark.createDataFrame(sorted(found), "e1 string, sep string, e2 string")
    judged = {(r["e1"], r["sep"], r["e2"]): (r["replacement"], r["label"]) for r in dehyphen.rules(asked, words, spelled).collect()}
    want = []
    for k, t in texts:
        if t is None:
            want.append((k, None, ()))
            continue
        out, at, labels = "", 0, []
        while m := pattern.search(t, at):
            new, label = judged[m.groups()]
            labels.append(label)
            changed = new != m[0]
            out += t[at : m.start()] + (new if changed else m[1])
            at = m.end() if changed else m.end(1)
        want.append((k, out + t[at:], tuple(labels)))
    assert got == sorted(want, key=repr) and any("almafa" in (r[1] or "") for r in got)


def test_wrapping_by_hand():
    wrap = dehyphen.wrap_line
    assert wrap("short\t line", 20) == [("short line", None)] and wrap("", 5) == [("", None)]
    assert wrap("abcdefgh well-known", 14) == [("abcdefgh well-", "3"), ("known", None)]
    assert wrap("aaaaaaaa understanding x", 18) == [("aaaaaaaa underst-", "1"), ("anding x", None)] or wrap("aaaaaaaa understanding x", 18)[0][1] == "1"
    assert wrap("aaaa visszament", 10) == [("aaaa visz-", "2"), ("szament", None)]
    assert wrap("aaaaaa bb - cccccccc", 11) == [("aaaaaa bb -", "5"), ("cccccccc", None)]
    assert wrap("aaaaaa bbb - cc", 11) == [("aaaaaa bbb", "0"), ("- cc", None)]
    assert wrap("aaaaaa bb- ccccccc", 10) == [("aaaaaa bb-", "4"), ("ccccccc", None)]
    assert wrap("aaaaaaa -, ccc", 9) == [("aaaaaaa -", "7"), (", ccc", None)]
    assert wrap("aaaaaaa -abc ccc", 9) == [("aaaaaaa -", "6"), ("abc ccc", None)]
    assert wrap("aaaaaaa xy-, ccc", 11) == [("aaaaaaa xy-", "8"), (", ccc", None)]
    assert wrap("abcdefgh " + "q" * 7 + " x", 6) == [("abcdefgh", "0"), ("q" * 7, "0"), ("x", None)]


def test_wrapping_loses_nothing(spark):
    words = "a well-known understanding of considerable - importance -x considerably y- " * 3
    rows = dehyphen.wrap_lines(spark.createDataFrame([(1, words), (2, None), (3, "x\n\ny")], "id long, t string"), "id", "t", 20).orderBy("id", "line_no").collect()
    assert [r["line"] for r in rows if r["id"] == 3] == ["x", "", "y"] and not any(r["id"] == 2 for r in rows)
    own = [r for r in rows if r["id"] == 1]
    assert all(len(r["line"]) <= 20 for r in own) and "1" in {r["label"] for r in own}
    joined = "".join(r["line"][:-1] if r["label"] == "1" else r["line"] if r["label"] in ("3", "6", "7", "8") else r["line"] + " " for r in own)
    assert joined.split() == words.split()


def test_wrapping_takes_a_few_texts_at_a_time(spark, monkeypatch):
    """What a worker holds as Python objects does not grow with the rows of an Arrow batch."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(["ab cd " * 100_000 if k == 7 else None if k == 8 else "ab cd " * 2000 for k in range(50)])], names=["id", "t"])
    got = list(text.slices([batch.slice(0, 0), batch], 1, 50_000))
    assert pa.Table.from_batches(got).equals(pa.Table.from_batches([batch])) and max(b.num_rows for b in got) <= 6
    taken, df = [], spark.createDataFrame([(1, "x")], "id long, t string")
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: taken.append(run))
    dehyphen.wrap_lines(df, "id", "t")
    big = pa.RecordBatch.from_arrays([pa.array(range(500)), pa.array(["ab cd " * 2000] * 500)], names=["id", "t"])
    made = list(taken[0]([big]))
    assert len(made) > 2 and sum(b.num_rows for b in made) == 500 * len(dehyphen.wrap_line("ab cd " * 2000, 40))


def test_short_windows_are_scored_without_a_shuffle_of_them(spark, monkeypatch):
    """The same metrics by a table at the workers as by joins, whatever the characters; repeated ids count together."""
    trained = spark.createDataFrame([("abab cabbage",), ("größe 😀x😀",), ("abba",)], "t string")
    texts = spark.createDataFrame([((1, 2), "abab größe"), ((1, 2), "cab\u0000 ä"), ((2, None), "😀x😀 zzz"), ((3, 1), "ab"), ((3, 2), None), ((3, 3), "")], "id struct<a long, b int>, t string")
    for n in (1, 2, 3):
        model = ngram.train(trained, "t", n)
        read = lambda: {r["id"]: (r["n"], round(r["acc"], 9), round(r["ppl"], 6)) for r in score.metrics(texts, "id", "t", model).collect()}
        with monkeypatch.context() as patch:
            patch.setattr(score, "MOST_WINDOWS", -1)
            by_joins = read()
        with monkeypatch.context() as patch:
            patch.setattr(score, "positions", None)
            assert read() == by_joins and len(by_joins) == (3 if n < 3 else 2)
        assert score.metrics(texts.limit(0), "id", "t", model).count() == 0


def test_report_by_hand(spark):
    rows = spark.createDataFrame([("1", "1")] * 8 + [("1", "3")] * 2 + [("3", "3")] * 3 + [("4", "1")], "gold string, pred string")
    out = {r["label"]: r for r in evaluate.report(evaluate.confusion(rows)).collect()}
    assert out["1"]["precision"] == pytest.approx(8 / 9) and out["1"]["recall"] == pytest.approx(0.8)
    assert out["4"]["f1"] == 0 and out["accuracy"]["f1"] == pytest.approx(11 / 14)
    assert out["macro avg"]["recall"] == pytest.approx(1.8 / 3) and out["weighted avg"]["support"] == 14
    cells = spark.createDataFrame([("aabc", "abcd"), ("ab", "a"), ("dc", "dc")], "answer string, correct string")
    assert {r["cell"]: r["n"] for r in evaluate.choice_confusion(cells).collect()} == {"aa": 1, "ab": 1, "bc": 1, "cd": 1, "cc": 2}
    log = spark.createDataFrame([(1, k, s) for k, s in enumerate(["x", "Best: a", "p", "q", "", "r", "Best:", "s"])], "log_id long, line_no int, line string")
    assert [r["line"] for r in evaluate.extract_best(log).orderBy("line_no").collect()] == ["\tp", "\tq", "\ts"]


def test_merge_prefers_the_likely_reading(spark):
    corpus = spark.createDataFrame([("the morning came and the town was still asleep in the mist",)] * 8, "t string")
    model = ngram.train(corpus, "t", 4)
    a = "the morning carne and the tovvn was still asleep in the mist"
    b = "the rnorning came and the town was still asleep in the rnist"
    pairs = spark.createDataFrame([("p", a, b), ("same", b, b), ("null", None, "x")], "pair_id string, a string, b string")
    out = {r["pair_id"]: r["merged"] for r in ocr.merge(pairs, model).collect()}
    assert out["p"] == "the morning came and the town was still asleep in the mist"
    assert out["same"] == b and out["null"] in ("", "x")
    assert ocr.merge(pairs, model, log=True).where("pair_id = 'p'").count() >= 1
    segs = ocr.segments(pairs).where("pair_id = 'p'").orderBy("seg_no").collect()
    assert "".join(r["a"] for r in segs) == a and "".join(r["b"] for r in segs) == b


def test_merge_has_no_caps_and_scores_large_models_by_joins(spark, monkeypatch):
    corpus = spark.createDataFrame([("the morning came and the town was still asleep in the mist",)] * 8, "t string")
    model = ngram.train(corpus, "t", 3)
    a, b = "the morning carne and the tovvn was still", "the rnorning came and the town was stiii"
    pairs = spark.createDataFrame([("p", a, b), ("same", b, b), ("null", None, "x")], "pair_id string, a string, b string")
    small = {tuple(r) for r in ocr.merge(pairs, model, context=9).collect()}
    log = sorted(ocr.merge(pairs, model, log=True, context=9).collect(), key=repr)
    monkeypatch.setattr(ocr, "MOST_GRAMS", 10)
    assert {tuple(r) for r in ocr.merge(pairs, model, context=9).collect()} == small
    again = sorted(ocr.merge(pairs, model, log=True, context=9).collect(), key=repr)
    assert [r[:4] for r in again] == [r[:4] for r in log] and [r["ppl"] for r in again] == pytest.approx([r["ppl"] for r in log])
    assert {r["seg_no"] for r in log if r["kind"] == "try"} == {r["seg_no"] for r in log if r["kind"] == "best"}
    texts = spark.createDataFrame([(1, "the morning"), (2, "qq the"), (3, "a")], "id long, t string")
    from glyphloom.streaming import scoring

    joined = {r["id"]: r["ppl"] for r in scoring.perplexity_stream(texts, "id", "t", model).collect()}
    monkeypatch.undo()
    assert joined == pytest.approx({r["id"]: r["ppl"] for r in scoring.perplexity_stream(texts, "id", "t", model).collect()})


def test_search_takes_every_alternative_and_the_whole_right_context():
    alts = [f"{k:02d}" for k in range(40)]
    segs = [{"seg_no": 0, "a": "00", "b": "01", "alts": alts}] + [{"seg_no": k, "a": c, "b": c, "alts": [c]} for k, c in enumerate("abcdefghijkl", 1)]
    run = ocr.Search(segs, context=12)
    asked = run.requests()
    assert asked == [x + "abcdefghijkl" for x in alts]
    run.answer([1.0 if x == "37" else 9.0 for x in alts])
    assert run.requests() is None and run.merged() == "37abcdefghijkl"
    assert [ocr.letter(k) for k in (0, 25, 26, 27, 701, 702)] == ["a", "z", "aa", "ab", "zz", "aaa"]


def test_passages(spark):
    docs = spark.createDataFrame([(k, "\n".join(f"line {j} of {k}" for j in range(60))) for k in range(5)], "doc_id long, text string")
    rows = [tuple(r) for r in sample.sample_passages(text.lines(docs), "doc_id", 0.1, 50).collect()]
    assert rows and rows == [tuple(r) for r in sample.sample_passages(text.lines(docs), "doc_id", 0.1, 50).collect()]
    source = {r["doc_id"]: r["text"] + "\n" for r in docs.collect()}
    assert all(p in source[i] and (len(p) >= 50 or source[i].endswith(p)) for i, _, p in rows)


def test_neural_scorer(spark, tmp_path):
    scorer = neural.BiLSTM.random(list("abc "), 3, 2, seed=1)
    df = spark.createDataFrame([(1, "abca b"), (2, None), (3, "zq")], "id long, t string")
    out = neural.predict(df, scorer, "id", "t").collect()
    assert len([r for r in out if r["id"] == 1]) == 6 and all(0 < r["p"] <= r["best_p"] <= 1 for r in out)
    p = scorer.distributions(["abc", "bca"], ["ab", "b "])
    assert p.shape == (2, 4) and np.allclose(p.sum(1), 1)
    scorer.save(str(tmp_path / "w.npz"))
    assert np.allclose(neural.BiLSTM.load(str(tmp_path / "w.npz")).distributions(["abc"], ["ab"]), p[:1])
    assert neural.predict(df, scorer, "id", "t", padded=False).where("id = 1").count() == 1


def test_neural_surface(spark):
    scorer = neural.BiLSTM.random(list("abc -"), 3, 2, seed=1)
    df = spark.createDataFrame([(1, "abca b", "ca"), (2, None, "a"), (3, "cb", "zz"), (4, "bbb", "bbb")], "id long, t string, part string")
    rows = neural.predict(df, scorer, "id", "t").orderBy("id", "pos").collect()
    part = neural.predict_substrings(df, scorer, "id", "t", "part").orderBy("id", "pos").collect()
    assert [(r["id"], r["pos"], r["p"]) for r in part] == [(r["id"], r["pos"], r["p"]) for r in rows if (r["id"], r["pos"]) in {(1, 2), (1, 3), (4, 0), (4, 1), (4, 2)}]
    scored = {r["id"]: r for r in neural.span_metrics(neural.predict(df, scorer, "id", "t"), "id").collect()}
    own = [r for r in rows if r["id"] == 1]
    assert scored[1]["ppl"] == pytest.approx(2 ** (-sum(np.log2(r["p"]) for r in own) / 6)) and scored[1]["acc"] == sum(r["best"] == r["target"] for r in own) / 6
    whole = neural.evaluate(df, scorer, "t").first()
    assert whole["n"] == len(rows) and whole["perpl"] == pytest.approx(np.mean([r["inv_p"] for r in rows]))
    asked = spark.createDataFrame([(1, "abc", "a "), (2, "", ""), (3, None, "zzzzz")], "id long, left_ctx string, right_ctx string")
    dist = neural.alternatives(asked, scorer, "id").collect()
    assert len(dist) == 15 and all(sum(r["p"] for r in dist if r["id"] == k) == pytest.approx(1) for k in (1, 2, 3))
    first = {r["id"]: r["ch"] for r in neural.alternatives(asked, scorer, "id", m=1).collect()}
    assert first[1] == scorer.alphabet[int(scorer.distributions(["abc"], ["a "]).argmax())]
    spots = spark.createDataFrame([(1, 0, "ab", "ca"), (1, 1, "b ", "a")], "id long, no int, left_ctx string, right_ctx string")
    out = {r["no"]: r["label"] for r in dehyphen.by_scorer(spots, "id", scorer).collect()}
    assert out[1] == "5" and out[0] in "134"


def test_queries_over_whole_documents(spark, tmp_path):
    from glyphloom.plans import catalogue

    # alike in the first 20 characters, at odds after them
    head = "the same beginning of "
    bodies = {1: head + "considerable understanding\nsecond line of letters\n\nafter the blank\nmarked again\nlast line here", 2: head + "q" * 30, 3: None}
    spark.createDataFrame(list(bodies.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: catalogue.QUERIES[name](spark, str(tmp_path)).collect()
    cells = {}
    for body in filter(None, bodies.values()):
        x = "".join(c if c in "abc" else "d" for c in body.translate(str.maketrans("aeiou tnrsdhl", "aabbccaabbcab")))
        for a, b in zip(x, reversed(x), strict=True):
            fa, fb = (c if c in "ab" else "c" for c in (a, b))
            cell = "cd" if fa == fb == "c" and a != b else fa + fb
            cells[cell] = cells.get(cell, 0) + 1
    assert {r["cell"]: r["n"] for r in run("ocr_confusion_docs")} == cells
    assert {(r["log_id"], r["line_no"], r["line"]) for r in run("log_best_extract_docs")} == {(1, 1, "\tsecond line of letters"), (1, 5, "\tlast line here")}
    whole = {r["doc_id"]: r for r in run("dehyph_rewrite")}
    assert whole[3]["rewritten"] is None and set(whole[1]["labels"]) <= set("01234")
    wrapped = [r for r in run("wrap_greedy") if r["doc_id"] == 1]
    assert sum(len(r["line"]) for r in wrapped) > 80 and wrapped[-1]["line"].endswith("here")
    assert {(r["e1"], r["e2"]) for r in run("hyph_candidates_docs") if r["doc_id"] == 1} >= {("cons", "iderable")} and len(run("dehyph_trivial_docs")) > 6
    assert {r["e1"] + r["e2"] for r in run("dehyph_rules_docs")} == {w for t in bodies.values() if t for w in t.split() if len(w) >= 8}
    assert all(r["line_no"] >= 0 and r["ppl"] < 9 for r in run("garbage_filter_docs")) and {r["doc_id"] for r in run("garbage_filter_docs")} == {1, 2}
