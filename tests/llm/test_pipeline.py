from __future__ import annotations

import random

import pytest

import corpus_pipeline

from .helpers import COLUMNS, prose


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randint(30, 90)) + ".", "en", f"s{i % 3}", 0) for i in range(200)]
    junk = [(1000 + i, " ".join([prose(rng, 1)] * 60), "en", "s1", 0) for i in range(60)]
    item = prose(rng, 25)
    planted = [(2000, rows[5][1], "en", "s0", 0), (2001, rows[6][1] + " more", "en", "s0", 0), (2002, f"{prose(rng, 40)} {item} {prose(rng, 40)}.", "en", "s0", 0), (2003, f"{prose(rng, 40)} a.b@c.example {prose(rng, 40)}.", "en", "s0", 0)]
    spark.createDataFrame(rows + junk + planted, COLUMNS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(r[0], 1, 0) for r in rows] + [(r[0], 0, 0) for r in junk], "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_each_stage_takes_effect(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, kept = docs.columns, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, tables)
        assert docs.columns == columns
        kept.append({r.doc_id: r.text for r in docs.collect()})
    good, single, clean, masked = kept
    assert sum(i < 1000 for i in good) >= 195 and sum(1000 <= i < 2000 for i in good) <= 2
    assert 2000 in good and 2000 not in single and 2001 not in single and {5, 6} <= set(single)
    assert 2002 in single and 2002 not in clean and set(single) - set(clean) == {2002}
    assert set(masked) == set(clean) and "[EMAIL]" in masked[2003] and all(masked[i] == clean[i] for i in clean if i != 2003)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, tables)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == set(masked)


def test_run_is_the_stages_one_after_the_other(spark, tables):
    got = corpus_pipeline.run(spark, tables)
    assert got.agg({"length": "sum"}).first()[0] == got.dropDuplicates(["doc_id"]).agg({"doc_tokens": "sum"}).first()[0]


def test_near_copies_from_eighty_in_a_hundred_go(spark):
    rng = random.Random(9)
    rows, similar = [], []
    for i in range(6):
        words = prose(rng, 100)
        rows += [(2 * i, words, "en", "s0", 0), (2 * i + 1, f"{words} {prose(rng, 18 + 2 * i)}", "en", "s0", 0)]
        similar.append(96 / (96 + 18 + 2 * i))
    assert all(s < 0.85 for s in similar) and similar[3] >= 0.8 > similar[4]
    docs = spark.createDataFrame(rows, COLUMNS)
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "").collect()}
    assert kept == set(range(0, 12, 2)) | {9, 11}
