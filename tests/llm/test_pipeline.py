"""Stages of the corpus pipeline on planted documents."""

from __future__ import annotations

import numpy as np

import corpus_pipeline as pipeline


def test_every_stage_takes_effect(spark, tmp_path):
    rng = np.random.default_rng(1)
    text = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 4000, n).tolist())
    rows = {i: text(120) for i in range(200)}
    for i in range(0, 200, 8):
        rows[i] += " Stupidkopf."
    item = text(20)
    for i in range(1, 200, 10):
        rows[i] = "Home | Imprint\n" + rows[i]
    rows[300] = rows[3]
    words = rows[5].split()
    words[60] = "other"
    rows[301] = " ".join(words)
    rows[302] = text(30) + " " + item + " " + text(30)
    rows |= {303: None, 304: ""}
    frame = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows.items()],
                                  "doc_id long, text string, lang string, source string, n_chars long")
    folder = str(tmp_path)
    frame.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 8 == 0)) for i in range(200)], "doc_id long, quality long, toxic long").write.parquet(
        f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    seen, docs = {}, frame
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.dtypes == frame.dtypes
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    toxic = {i for i in range(0, 200, 8)}
    assert set(rows) - set(seen["toxicity"]) == toxic
    assert set(seen["line_dedup"]) == set(seen["toxicity"]) and "Imprint" not in "".join(t or "" for t in seen["line_dedup"].values())
    assert set(seen["line_dedup"]) - set(seen["near_dedup"]) == {300, 301, 304}
    assert set(seen["near_dedup"]) - set(seen["decontamination"]) == {302}
    pieces = pipeline.run(spark, folder).toPandas()
    assert set(pieces.doc_id) == set(seen["decontamination"])


def test_stages_on_awkward_tables(spark, tmp_path):
    names = "n_dropped found_0 own_0 other_0 bad digest fingerprint root n score spans items words known host key part".split()
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    item = "one two three four five six seven eight nine ten eleven twelve"
    texts = {1: None, 2: "", 3: "a b c d e", 4: f"x {item} y", 5: "menu\nfirst words of a page", 6: "menu\nother words of a page",
             7: "menu\nthird words of a page", 8: "A B c  d e", 9: "word " * 30_000, None: "a null id"}
    rows = [(i, t, None, None if i == 3 else "s", None, *["clash"] * len(names)) for i, t in texts.items()]
    rows += [rows[4], (3, "another text of id three", *rows[2][2:])]
    frame = spark.createDataFrame(rows, schema).repartition(3)
    folder = str(tmp_path)
    spark.createDataFrame([], "doc_id long, quality long, toxic long").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    found = {}
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, frame, folder)
        assert out.columns == frame.columns
        found[name] = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
        assert stage(spark, frame.limit(0), folder).count() == 0
    every = sorted(((r[0], r[1]) for r in rows), key=str)
    assert found["toxicity"] == every
    assert found["line_dedup"] == sorted(((i, t.replace("menu\n", "") if t else t) for i, t in every), key=str)
    assert found["decontamination"] == [r for r in every if r[0] != 4]
    gone = {8: texts[8], 2: ""}  # like 3, and without words like 1
    once = sorted(((i, t) for i, t in dict.fromkeys(every) if (i, t) not in gone.items()), key=str)
    assert found["near_dedup"] == once
    pieces = pipeline.packing(spark, frame, folder).toPandas()
    assert (pieces.start == 0).sum() == len(rows) and pipeline.packing(spark, frame.limit(0), folder).count() == 0


def test_stages_in_a_row_on_an_empty_table(spark, tmp_path):
    schemas = {"documents": "doc_id long, text string, lang string, source string, n_chars long",
               "labels": "doc_id long, quality long, toxic long", "benchmark": "item_id long, text string"}
    for name, schema in schemas.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
