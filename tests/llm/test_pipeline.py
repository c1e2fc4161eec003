"""The pipeline's stages on a small corpus with planted cases."""

import random

import corpus_pipeline
from placewise.llm import secrets


def test_run_leaves_its_result_alone_in_the_shared_folder(spark, tmp_path, monkeypatch):
    import os

    from placewise.llm import _shared

    monkeypatch.setattr(_shared, "shared_dir", lambda spark: f"{tmp_path}/shared")
    rows = [(i, f"some words of document number {i} " * (1 + i % 7), "en", "s", 1) for i in range(40)] + [(40, None, "en", "s", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, i % 2) for i in range(0)] or [(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 0 and out.count() == out.select("doc_id", "piece").distinct().count()
    tables = [d for d, _, files in os.walk(f"{tmp_path}/shared") if any(f.endswith(".parquet") for f in files)]
    assert len(tables) == 1 and tables[0].endswith("packing")


def test_stages(spark, tmp_path):
    rnd = random.Random(7)
    words = ["".join(rnd.choice("aeiourstnl") for _ in range(rnd.randint(2, 7))) for _ in range(500)]
    text = lambda n=60: " ".join(rnd.choice(words) for _ in range(n))
    rows = []
    for i in range(300):
        t = text()
        if i % 6 == 0:
            t += " zquark zwoggle" + " zblitf" * 3
        rows.append((i, t))
    rows += [(300, rows[1][1]), (301, rows[2][1] + " extra"), (302, text() + " password: abcdefghijklmnop"), (303, None), (304, None), (305, "")]
    df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert docs.columns == df.columns
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        left[name] = {r.doc_id for r in docs.collect()}
    clean = {i for i, _ in rows} - set(range(0, 300, 6))
    assert left["toxicity"] == clean
    assert left["exact_dedup"] == clean - {1, 303, 304}
    assert left["near_dedup"] == left["exact_dedup"] - {301}
    assert left["secrets"] == left["packing"] == left["near_dedup"]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/secrets").collect()}
    assert texts[302].endswith("[secret]") and texts[3] == rows[3][1]
    assert spark.read.parquet(f"{tmp_path}/secrets").transform(secrets.scan).filter("n_assign > 0").count() == 0
    empty = df.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
