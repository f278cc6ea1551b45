"""The corpus pipeline on a small corpus with planted cases."""

from __future__ import annotations

import random

import corpus_pipeline
from tests.llm.test_operators import vocabulary


def test_pipeline(spark, tmp_path):
    rng, words = random.Random(1), vocabulary(600)
    say = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    rows, labels = [], []
    for i in range(400):
        kind = i % 8
        text = "BUY NOW!!! | $$$ " * 9 if kind == 0 else say(60)
        if kind == 1:
            text += " you grumblefoot, you snorkwit, you grumblefoot"
        rows.append((i, text))
        labels.append((i, int(kind != 0), int(kind == 1)))
    copy = rows[10][1]
    rows += [(500, copy), (501, copy + " indeed"), (502, None), (503, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5, 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, label int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns, name
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert not ids & {500, 501} and 10 in ids
    assert not any(i % 8 in (0, 1) for i in ids if i < 400)
    assert len([i for i in ids if i < 400]) >= 290
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == ids


def test_stages_on_odd_tables(spark, tmp_path):
    """Empty tables, null ids, null and empty texts, repeated rows and rows that clash."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, n long, component_id long"
    rng, words = random.Random(2), vocabulary(300)
    say = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    rows = [(i, say(30) if i % 3 else "BUY NOW!!! | $$$ " * 9, "en", "s", 1, None, None, None) for i in range(120)]
    rows += [(1, rows[1][1], "en", "s", 1, None, None, None)] * 2 + [(None, say(20), "en", None, 1, 0.5, 1, 1), (None, None, None, None, None, None, None, None), (201, None, "en", "s", 0, None, None, None), (202, "", "en", "s", 0, None, None, None), (202, "", "en", "s", 0, None, None, None)]
    labels = [(i, int(i % 3 != 0), int(i % 5 == 0)) for i in range(120)] + [(None, None, None), (3, None, 1)]
    for name, table, marks in (("full", rows, labels), ("bare", rows, []), ("none", [], labels)):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(table, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        assert corpus_pipeline.run(spark, folder).count() >= 0
    docs = spark.createDataFrame(rows, schema)
    kept = corpus_pipeline.dedup_stage(spark, docs, "")
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    # Repeated rows with words stay once, those without words and without an id all.
    assert (ids.count(1), ids.count(202), ids.count(None)) == (1, 2, 2)
