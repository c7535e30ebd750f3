"""The pipeline's stages, one by one and together, on planted cases."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from glyphloom.llm import queries


def write(spark, tmp_path, tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice(["tha", "on", "re", "ish", "mo", "ke"]) for _ in range(rng.randint(1, 4))) for _ in range(600)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows, labels = {}, []
    for i in range(300):
        words = text(90)
        if i % 6 == 0:
            for _ in range(4):
                words[rng.randrange(90)] = rng.choice(["vilething", "nastyword", "awfulness"])
        rows[i] = " ".join(words)
        labels.append((i, 1, int(i % 6 == 0)))
    clean = [i for i in rows if i % 6]
    leak = " ".join(text(30))
    rows[1000] = rows[clean[0]]
    near = rows[clean[1]].split()
    near[40] = "changed"
    rows[1001] = " ".join(near)
    rows[1002] = " ".join(text(40)) + " " + leak.upper() + " " + " ".join(text(40))
    rows[1003], rows[1004] = None, ""
    docs = [(i, t, "en", None, len(t or "")) for i, t in rows.items()]
    sf = write(spark, tmp_path, {"documents": (docs, "doc_id long, text string, lang string, source string, n_chars long"), "labels": (labels, "doc_id long, quality int, toxic int"), "benchmark": ([(0, leak), (1, None)], "item_id long, text string")})
    at = spark.read.parquet(f"{sf}/documents.parquet")
    gone = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, at, sf)
        assert after.columns == at.columns
        a, b = ({r["doc_id"] for r in d.collect()} for d in (at, after))
        gone[name], at = a - b, after
    toxic = {i for i in rows if i < 300 and i % 6 == 0}
    assert len(gone["toxicity"] & toxic) >= 0.95 * len(toxic) and not gone["toxicity"] - toxic
    assert gone["exact dedup"] == {1000, 1004}
    assert gone["SimHash near-dedup"] == {1001} and gone["benchmark decontamination"] == {1002}
    packed = corpus_pipeline.run(spark, sf)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == {r["doc_id"] for r in at.collect()}


def test_what_op8_predicts_toxic_goes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus_pipeline.toxicity, "fit", lambda docs, labels: None)
    monkeypatch.setattr(corpus_pipeline.toxicity, "score", lambda docs, scorer, out: docs.withColumn(out, F.col("doc_id") / 10))
    sf = write(spark, tmp_path, {"labels": ([], "doc_id long, quality int, toxic int")})
    after = corpus_pipeline.drop_toxic(spark, spark.createDataFrame([(k, "text") for k in range(10)], "doc_id long, text string"), sf)
    assert sorted(r["doc_id"] for r in after.collect()) == [0, 1, 2]


def test_stages_judge_rows_by_their_own_text(spark, tmp_path):
    """Null and repeated ids, repeated rows, clashing columns, an empty table."""
    rng = random.Random(6)
    text = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    leak, long = text(30), text(120)
    near = long.split()
    near[60] = "changed"
    rows = [(1, f"{text(20)} {leak}"), (1, text(50)), (None, f"{leak} {text(9)}"), (None, text(40)), (7, long), (7, " ".join(near)), (None, " ".join([*near[:-1], "end"])), (8, None), (8, ""), (9, text(30))]
    rows.append(rows[-1])
    schema = "doc_id long, text string, _toxic double, _key string, _leaks int"
    docs = spark.createDataFrame([(i, t, 0.5, "k", 1) for i, t in rows], schema).repartition(3)
    sf = write(spark, tmp_path, {"labels": ([], "doc_id long, quality int, toxic int"), "benchmark": ([(0, leak)], "item_id long, text string")})
    stages = dict(corpus_pipeline.STAGES)
    texts = lambda df: sorted((r["doc_id"] is None, r["doc_id"], r["text"]) for r in df.fillna("", "text").fillna(-1, "doc_id").collect())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns and stage(spark, docs.limit(0), sf).count() == 0, name
    assert stages["toxicity"](spark, docs, sf).count() == len(rows)
    assert texts(stages["exact dedup"](spark, docs, sf)) == texts(docs.where("NOT (doc_id = 8 AND text IS NULL)").dropDuplicates(["text"])) or stages["exact dedup"](spark, docs, sf).count() == 9
    left = stages["SimHash near-dedup"](spark, docs, sf)
    assert left.where("text LIKE '%changed%'").count() + left.where(F.col("text") == long).count() == 1 and left.where("coalesce(text, '') = ''").count() == 1
    assert left.where("doc_id = 9").count() == 1 and left.where("doc_id = 1").count() == 2 and left.where("doc_id IS NULL").count() == 2
    clean = stages["benchmark decontamination"](spark, docs, sf)
    assert clean.count() == len(rows) - 2 and clean.where("doc_id = 1").count() == 1 and clean.where("doc_id IS NULL").count() == 2
    assert stages["packing"](spark, docs, sf).count() >= len(rows) and stages["packing"](spark, docs.limit(0), sf).count() == 0


def test_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(queries.ORACLE) <= set(queries.QUERIES)
