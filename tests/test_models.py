"""Character models against a brute-force trie, and their invariants."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from glyphloom.functions import charset, text
from glyphloom.operators import ngram, score
from glyphloom.sources import corpus
from glyphloom.streaming import scoring

PAD = text.PAD


class Brute:
    def __init__(self, texts, n):
        self.n, self.cnt = n, collections.Counter()
        for t in texts:
            s = PAD + t + PAD
            for i in range(len(s)):
                for k in range(0, n + 1):
                    if k <= i + 1:
                        self.cnt[s[i + 1 - k : i + 1]] += 1
        self.letters = [g for g in self.cnt if len(g) == 1]
        self.u = {c: self.cnt[c] / self.cnt[""] for c in self.letters}

    def b(self, a):
        w = {c: self.cnt[a + c] or self.u[c] for c in self.letters}
        return {c: v / sum(w.values()) for c, v in w.items()}

    def dist(self, ctx):
        ctx = ctx[-(self.n - 1) :]
        while ctx and not self.cnt[ctx]:
            ctx = ctx[1:]
        if not ctx:
            return self.u
        if len(ctx) == 1:
            return self.b(ctx)
        low = self.b(ctx[-1])
        w = {c: self.cnt[ctx + c] or low[c] for c in self.letters}
        return {c: v / sum(w.values()) for c, v in w.items()}

    @staticmethod
    def best(d):
        return max(d, key=lambda c: (round(d[c], 12), -ord(c)))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    return ["".join(rng.choice("abcdé ") for _ in range(rng.randint(1, 30))) for _ in range(40)]


@pytest.fixture(scope="module")
def model(spark, texts):
    return ngram.train(spark.createDataFrame([(t,) for t in texts], "seg string"), "seg", 4)


def test_counts(spark, texts, model):
    brute = Brute(texts, 4)
    got = {r["gram"]: r["cnt"] for r in model.ngram.collect()}
    assert got == {g: c for g, c in brute.cnt.items() if g and c}


def test_known_small_model(spark):
    m = ngram.train(spark.createDataFrame([("babababc",)], "s string"), "s", 2)
    got = {r["gram"]: r["cnt"] for r in m.ngram.collect()}
    assert (got["b"], got["a"], got["c"], got[PAD], got["ba"], got["ab"], got[PAD + "b"]) == (4, 3, 1, 2, 3, 3, 1)
    assert {r["gram"]: r["p"] for r in ngram.cond_prob(m.ngram).collect()}["ba"] == 0.75


def test_distributions_sum_to_one_and_match(spark, texts, model):
    brute = Brute(texts, 4)
    contexts = ["", "a", "ab", "abc", "zz", "za", "dé ", PAD + "a", "a" + PAD, "bcdab"]
    rows = collections.defaultdict(dict)
    for r in ngram.distribution(spark.createDataFrame([(c,) for c in contexts], "ctx string"), model).collect():
        rows[r["ctx"]][r["ch"]] = r["p"]
    for c in contexts:
        assert sum(rows[c].values()) == pytest.approx(1)
        assert rows[c] == pytest.approx(brute.dist(c))


def test_metrics_both_ways(spark, texts, model):
    brute = Brute(texts, 4)
    asked = [(k, t) for k, t in enumerate(["abcdab", "bad dab", "a", "ddddddd", "éabéabé cab"])]
    df = spark.createDataFrame(asked, "id long, s string")
    got = {r["id"]: r for r in score.metrics(df, "id", "s", model).collect()}
    for k, t in asked:
        ps = [brute.dist(t[max(0, i - 3) : i]) for i in range(3, len(t))]
        if not ps:
            assert k not in got
            continue
        assert got[k]["ppl"] == pytest.approx(2 ** (-sum(math.log2(p[t[i + 3]]) for i, p in enumerate(ps)) / len(ps)))
        assert got[k]["acc"] == pytest.approx(sum(Brute.best(p) == t[i + 3] for i, p in enumerate(ps)) / len(ps))
    backward = ngram.build(score.reversed_counts(model.ngram), 4)
    turned = ngram.train(spark.createDataFrame([(t[::-1],) for t in texts], "seg string"), "seg", 4)
    assert {tuple(r) for r in backward.ngram.select("gram", "cnt").collect()} == {tuple(r) for r in turned.ngram.select("gram", "cnt").collect()}
    streamed = {r["id"]: r["ppl"] for r in scoring.perplexity_stream(df, "id", "s", model).collect()}
    assert {k: v for k, v in streamed.items() if k in got} == pytest.approx({k: r["ppl"] for k, r in got.items()}) and streamed[2] is None


def test_unseen_characters_cost(spark, texts, model):
    asked = [(0, "abcd ab"), (1, "abc\u6f22 ab"), (2, "abc\u6f22\u6f22ab"), (3, "\u6f22" * 7)]
    got = {r["id"]: r["ppl"] for r in score.metrics(spark.createDataFrame(asked, "id long, s string"), "id", "s", model).collect()}
    assert got[0] < got[1] < got[2] < got[3]
    brute = Brute(texts, 4)
    dist = [brute.dist("abcd"[max(0, i - 3) : i]).get(c, 1e-13) for i, c in enumerate("abc\u6f22") if i >= 3]
    assert score.score(spark.createDataFrame([(0, "abc\u6f22")], "id long, s string"), "id", "s", model).first()["p"] == pytest.approx(dist[0])
    assert score.garbage_filter(spark.createDataFrame(asked, "id long, s string"), "id", "s", model, 5, 20.0).select("id").collect() == [(0,)]
    assert score.masked(spark.createDataFrame(asked, "id long, s string"), "s", model).where("id = 1").first()["s"] == "abc" + text.OOV + " ab"


def test_rare_characters_are_masked_in_training_and_scoring(spark):
    lines = [("aaaa bbbb " * 30,)] * 5 + [("aaaa q bbbb z",)]
    m = ngram.train(spark.createDataFrame(lines, "s string"), "s", 3, rare=2)
    assert m.alphabet() == sorted([PAD, text.OOV, " ", "a", "b"])
    got = {r["id"]: r["ppl"] for r in score.metrics(spark.createDataFrame([(1, "aa q bb"), (2, "aa x bb")], "id long, s string"), "id", "s", m).collect()}
    assert got[1] == pytest.approx(got[2]) and got[1] < 1e4


def test_long_lines_have_the_same_windows(spark):
    rng = random.Random(5)
    long = ["".join(rng.choice("abé\U0001f600 ") for _ in range(n)) for n in (0, 1, 2, 126, 127, 128, 129, 130, 131, 255, 256, 257, 258, 900)]
    brute = Brute([t for t in long], 3)
    df = spark.createDataFrame(list(enumerate(long)), "id long, s string")
    got = {r["gram"]: r["cnt"] for r in ngram.ngram_counts(df, "s", 3).collect()}
    assert got == {g: c for g, c in brute.cnt.items() if g and c}
    at = {(r["id"], r["pos"]): r["gram"] for r in score.positions(df, "id", "s", 3).collect()}
    assert at == {(k, i): t[i : i + 3] for k, t in enumerate(long) for i in range(len(t) - 2)}
    padded = {(r["id"], r["pos"]): r["gram"] for r in score.positions(df, "id", "s", 3, padded=True).collect()}
    assert padded == {(k, i - 2): (PAD + t + PAD)[max(0, i - 3) : i] for k, t in enumerate(long) for i in range(2, len(t) + 3)}
    rows = {(r["id"], r["pos"]): (r["ch"], r["left_ctx"], r["right_ctx"]) for r in text.windows(df, ["id"], "s", 3, 2).collect()}
    assert rows == {(k, i + 1): (c, (PAD * 3 + t)[i : i + 3], (t + PAD * 2)[i + 1 : i + 3]) for k, t in enumerate(long) for i, c in enumerate(t)}


def test_bidirectional_top_and_generation(spark, texts, model):
    forward, turned = Brute(texts, 4), Brute([t[::-1] for t in texts], 4)
    backward = ngram.build(score.reversed_counts(model.ngram), 4)
    asked = spark.createDataFrame([("abc", "dab"), ("", "a"), ("bad", "")], "left_ctx string, right_ctx string")
    got = {(r["left_ctx"], r["right_ctx"], r["rank"]): (r["ch"], r["p"]) for r in score.bidirectional_next(asked, model, backward, 2).collect()}
    for left, right in (("abc", "dab"), ("", "a"), ("bad", "")):
        a, b = forward.dist(left), turned.dist(right[::-1])
        w = {c: a[c] * b[c] for c in a}
        ranked = sorted(w, key=lambda c: (-round(w[c] / sum(w.values()), 12), ord(c)))
        for k in (1, 2):
            assert got[left, right, k][0] == ranked[k - 1] and got[left, right, k][1] == pytest.approx(w[ranked[k - 1]] / sum(w.values()))
    out = {r["id"]: r["text"] for r in score.generate(spark.createDataFrame([(1, "ab"), (2, "")], "id long, s string"), "id", "s", model, 3).collect()}
    for k, start in ((1, "ab"), (2, "")):
        now = start
        for _ in range(3):
            now += Brute.best(forward.dist(now))
        assert out[k] == now


@pytest.mark.parametrize("combine", ["product", "max", "sum", "harmonic"])
def test_bidirectional(spark, texts, model, combine):
    f = {"product": lambda a, b: a * b, "max": max, "sum": lambda a, b: a + b, "harmonic": lambda a, b: 2 * a * b / (a + b)}[combine]
    forward, turned = Brute(texts, 4), Brute([t[::-1] for t in texts], 4)
    backward = ngram.build(score.reversed_counts(model.ngram), 4)
    t = "bad dab éa"
    rows = score.bidirectional(spark.createDataFrame([(1, t)], "id long, s string"), "id", "s", model, backward, combine).orderBy("pos").collect()
    assert len(rows) == len(t) - 6
    for i, r in enumerate(rows, 3):
        a, b = forward.dist(t[i - 3 : i]), turned.dist(t[i + 1 : i + 4][::-1])
        w = {c: f(a[c], b[c]) for c in a}
        total = sum(w.values())
        assert r["p"] == pytest.approx(w[t[i]] / total)
        assert r["h_bits"] == pytest.approx(-sum(v / total * math.log2(max(v / total, 1e-13)) for v in w.values()))
    padded = score.bidirectional(spark.createDataFrame([(1, t)], "id long, s string"), "id", "s", model, backward, combine, padded=True)
    assert padded.count() == len(t)


def test_vocabulary(spark):
    table = {f[0]: f for f in map(charset.features, "aŐűöáłøñ5 -–Z")}
    assert [table[c][1] for c in "aŐűöáłøñ"] == ["a", "ö", "ü", "ö", "a", "l", "o", "n"]
    assert [table[c][5] for c in "aŐáłøñ"] == [False, False, False, True, True, True]
    assert table["Ő"][2:5] == (True, True, True) and table["–"][7] and table["5"][8]
    df = spark.createDataFrame([(1, "aab"), (2, None), (3, "")], "id long, s string")
    assert [r["r"] for r in charset.replace_unknown(df, "s", ["a", "]", "^", "-"], "r").orderBy("id").collect()] == ["aa" + text.OOV, None, ""]
    counts = charset.char_counts(text.chars(text.lines(spark.createDataFrame([(1, "abba\nc")], "doc_id long, text string"))))
    assert {r["ch"]: r["id"] for r in charset.output_ids(counts).collect()} == {"a": 1, "b": 2, "c": 3}


def test_segments_keep_every_line(spark):
    docs = spark.createDataFrame([(k, "\n".join(f"l{j}" for j in range(k))) for k in range(1, 12)], "doc_id long, text string")
    rows = text.segments(text.lines(docs)).orderBy("doc_id", "seg_no").collect()
    for k in range(1, 12):
        own = [r["seg"] for r in rows if r["doc_id"] == k]
        assert "\n".join(own) == "\n".join(f"l{j}" for j in range(k)) and all(s.count("\n") < 4 for s in own)


def test_segment_query_runs(spark, tmp_path):
    from glyphloom.plans import catalogue

    rows = [(1, "a\nb\nc\nd\ne"), (2, ""), (3, None), (None, "x")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = catalogue.QUERIES["segment_hash"](spark, str(tmp_path)).orderBy("doc_id", "seg_no").collect()
    assert "\n".join(r["seg"] for r in out if r["doc_id"] == 1) == "a\nb\nc\nd\ne"
    assert [(r["seg_no"], r["seg"]) for r in out if r["doc_id"] in (2, None)] == [(0, "x"), (0, "")] and all(r["doc_id"] != 3 for r in out)


def test_files_models_and_progress(spark, tmp_path, model):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "x.txt").write_text("one\ntwo\n")
    (tmp_path / "a" / "b" / "y.txt").write_text("three")
    assert corpus.read_lines(spark, str(tmp_path / "a")).count() == 2
    lines = corpus.read_lines(spark, str(tmp_path / "a"), recursive=True)
    assert sorted(r["line"] for r in lines.collect()) == ["one", "three", "two"]
    assert corpus.slice_lines(lines, 1, 5).count() == 1 and corpus.unfinished(lines, 1).count() == 1
    corpus.save_model(model, str(tmp_path / "m"))
    again = corpus.load_model(spark, str(tmp_path / "m"))
    assert again.n == 4 and again.ngram.count() == model.ngram.count()
    rows = spark.createDataFrame([("r", "m", k, k * 10, k * 10 + 10, 0.5, 0.9, 1.4, 3, 100, 20) for k in range(3)], corpus.PROGRESS)
    for _ in range(2):
        corpus.append_progress(rows, str(tmp_path / "p"))
    found = spark.read.parquet(str(tmp_path / "p"))
    assert found.count() == 3 and corpus.resume_points(found).first()["proc_chars"] == 300
    with pytest.raises(ValueError):
        corpus.read_config("name: x\nfiles: [a]\nodd: 1")
    assert corpus.read_config("name: x\nfiles: [a]").most_lines_a_segment == 8
    labelled = spark.createDataFrame([(0, "ab-", "1"), (1, "cd", "0")], "line_no int, line string, label string")
    corpus.write_labelled(labelled.coalesce(1), str(tmp_path / "t"))
    assert {(r["line"], r["label"]) for r in corpus.read_labelled(spark, str(tmp_path / "t")).collect()} == {("ab-", "1"), ("cd", "0")}


def test_words_codes_and_vowels(spark, tmp_path):
    lines = spark.createDataFrame([("f", 0, "kis-lány jön-megy alma, alma"), ("f", 1, "szó – beszéd.")], "file string, line_no int, line string")
    corpus.save_words(lines, str(tmp_path / "w"))
    words, hyphen, dash = corpus.load_words(spark, str(tmp_path / "w"))
    assert {r["word"]: r["cnt"] for r in words.collect()} == {"kis-lány": 1, "jön-megy": 1, "alma": 2, "szó": 1, "beszéd": 1}
    assert {r["suffix"] for r in hyphen.collect()} == {"lány", "megy"} and {r["suffix"] for r in dash.collect()} == {"beszéd"}
    ids = {"a": 1, "b": 2, "é": 3}
    df = charset.encode_text(spark.createDataFrame([(1, "abéx"), (2, ""), (3, None)], "id long, t string"), "t", ids, "codes")
    got = {r["id"]: (r["codes"], r["back"]) for r in charset.decode_ids(df, "codes", ids, "back").collect()}
    assert got == {1: ([1, 2, 3, 0], "abé" + text.OOV), 2: ([], ""), 3: (None, None)}
    from glyphloom.operators import dehyphen

    assert spark.createDataFrame([("Őrület",)], "w string").select(dehyphen.vowels("w")).first()[0] == 3


def test_command_line(spark, tmp_path, capsys):
    from glyphloom.__main__ import COMMANDS, main

    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "a.txt").write_text("the town was asleep\nin the mist of the morning\n")
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x.txt").write_text("the town well-known considerable mist\nthe mor-\nning")
    (tmp_path / "lex").write_text("morning\ntown\n")
    at = lambda n: str(tmp_path / n)
    main(["train", at("c"), at("m"), "--order", "3"])
    main(["words", at("c"), at("w")])
    for command in (["score", at("m"), at("t")], ["entropy", at("m"), at("t")], ["variants", at("m"), at("t")], ["rules", at("w"), at("lex"), at("t"), "--end-of-line"], ["baseline", at("t")], ["wrap", at("t"), "--maxlength", "20"], ["passages", at("c"), "1.0"], ["merge", at("m"), at("t"), at("t")]):
        main([*command, "--out", at("out")])
        assert spark.read.parquet(at("out")).count() >= 1, command
    assert spark.read.parquet(at("out")).first()["merged"].startswith("the town")
    assert len(COMMANDS) == 16


def test_count_stream(spark, tmp_path):
    spark.createDataFrame([(1, "abab")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    run = scoring.count_stream(source, "doc_id", "text", 2).writeStream.outputMode("complete").format("memory").queryName("grams").start()
    run.processAllAvailable()
    run.stop()
    assert {r["gram"]: r["cnt"] for r in spark.table("grams").collect()}["ab"] == 2
