"""The whole pipeline against plain versions of its stages."""

from __future__ import annotations

import re
from collections import defaultdict

from test_training_operators import lower, slow_hits, slow_print

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages_keep_what_plain_code_keeps(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    docs = {i: t for i, t in docs.items() if t and re.search(r"[^\W\d_]", t)}
    best = defaultdict(int)
    for i, t in docs.items():
        best[lower(t)] = max(best[lower(t)], i)
    ids = sorted(best.values())
    prints = [slow_print(docs[i]) for i in ids]
    label = list(range(len(ids)))
    for _ in range(3):
        for a in range(len(ids)):
            for b in range(a):
                if bin(prints[a] ^ prints[b]).count("1") <= 4:
                    label[a] = label[b] = min(label[a], label[b])
    ids = [i for k, i in enumerate(ids) if label[k] == k]
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = defaultdict(set)
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = word.findall(lower(r["text"]))
        for k in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[k : k + 13])].add(str(r["item_id"]))
    want = {i for i in ids for n, hit, _ in [slow_hits(docs[i], windows)] if not (hit and 20 * hit >= n)}

    held = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, held, SF).columns == held.columns, name
    got = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in got.select("doc_id").collect()} == want and len(want) < 200


def test_stages_take_empty_tables_and_extra_columns(spark):
    from pyspark.sql import functions as F

    held = spark.read.parquet(f"{SF}/documents.parquet")
    names = ["rank", "__keep", "__text", "__own_text", "keep", "own", "id", "text_hash", "n", "component_id", "fp", "salt", "d", "best"]
    held = held.withColumns({name: F.lit(k) for k, name in enumerate(names)}).withColumn("r", F.array(F.lit("x")))
    some_docs = held.limit(30).union(held.limit(1)).union(held.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, held.limit(0), SF).count() == 0, name
        some = stage(spark, some_docs, SF)
        if name != "pack":
            assert some.columns == held.columns and some.select(*names).distinct().collect() == [tuple(range(len(names)))], name
        assert some.count() > 0, name


def test_repeated_rows_of_a_component_leave_one(spark):
    rows = [(1, "some words stand here in a row", "x"), (1, "some words stand here in a row", "y"), (2, "some words stand here in a row", "z"), (None, None, "n"), (None, "", "n"), (7, "entirely other things that nobody else wrote down", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, own string")
    got = sorted(((r["doc_id"], r["text"] or "") for r in corpus_pipeline.near(spark, docs, SF).collect()), key=repr)
    assert got == sorted([(1, rows[0][1]), (7, rows[5][1]), (None, "")], key=repr)
