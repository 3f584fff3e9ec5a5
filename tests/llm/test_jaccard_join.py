import random

import plain
import pytest
from pyspark.sql import functions as F

from trafficlens.llm import jaccard_join
from trafficlens.llm.components import components

SCHEMA = "doc_id long, text string, row string, node long, `a.b` int"


def run(spark, rows, **kw):
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA).repartition(3)
    out = jaccard_join.similar_documents(docs, **kw)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()), key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = rng.choices(vocabulary, k=60)
    rows = []
    for _ in range(60):
        base = rng.choices(vocabulary, k=rng.choice([3, 5, 8, 40, 120]))
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                copy += passage
            rows.append(" ".join(copy) if rng.random() < 0.8 else "\n ".join(copy).upper())
    hot = rng.choices(vocabulary, k=100)
    for _ in range(120):  # a group of near copies, some too far from all others
        copy = list(hot)
        for _ in range(rng.choice([1, 2, 3, 4])):
            copy[rng.randrange(100)] = rng.choice(vocabulary)
        rows.append(" ".join(copy))
    rows += [None, "", " \n", "one", "One", "a b c d", "a b c d e", "a b c d e f"] + rows[:5]
    return list(enumerate(rows))


@pytest.mark.parametrize("block, often", [(256, 16), (8, 4), (8, 10**6)])
def test_against_all_pairs(spark, corpus, monkeypatch, block, often):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "OFTEN", often)
    assert run(spark, corpus) == plain.similar(corpus)


def test_null_and_repeated_ids_and_one_of_each(spark):
    long = " ".join(f"v{i}" for i in range(50))
    rows = [(None, long), (None, long), (4, long + " end"), (4, long + " end"), (2, None), (2, None),
            (7, "")]
    assert run(spark, rows) == plain.similar(rows)
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA)
    kept = [(r.doc_id, r.text) for r in jaccard_join.one_of_each(docs).collect()]
    assert sorted(kept, key=str) == sorted([(4, long + " end"), (2, None), (2, None), (7, "")],
                                           key=str)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_very_long_text(spark):
    long = "x" * 5_000_000 + " " + " ".join(str(i) for i in range(700_000))
    rows = [(1, long), (2, long + " more"), (3, "x")]
    assert run(spark, rows) == [(1, 699_997, 1), (2, 699_998, 1), (3, 1, 3)]


def test_supplied_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id)
                  for r in jaccard_join.similar_documents(docs).collect()), key=str)
    assert got == plain.similar([(r.doc_id, r.text) for r in docs.collect()])


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(7, 7), (None, 1)]
    got = {r.node: r.label for r in components(
        spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}
    assert components(spark.createDataFrame([], "a long, b long")).select(F.col("node")).count() == 0
