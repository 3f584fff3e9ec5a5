import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trafficlens.llm import collocations as co
from trafficlens.llm.queries import ORACLE, QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counts(rows):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    return f, n


def plain(rows, least=30, top=2000):
    f, n = counts(rows)
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    gone = {(lang, p[i:j]) for (lang, p), a in cand.items() for i in range(len(p))
            for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * a >= 80 * f[lang, p[i:j]]}
    by = defaultdict(list)
    for (lang, p), a in cand.items():
        if (lang, p) in gone:
            continue
        ways = [(2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(ways)
        by[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s)
                  for lang, found in by.items()
                  for i, (s, a, p, l, r) in enumerate(sorted(found)[:top]))


def result(frame):
    return sorted(map(tuple, frame.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
                      .collect()))


def odd_rows(rng, n):
    words = ["a", "b", "B", "é", "c\x01", "\x00", "a\x01", "x" * 40, "ab", "d-e", " "]
    gaps = [" ", " ", " ", "  ", "\t", ".", ", ", "\n", "\x0b", ";"]
    langs = ["en", "de", None, "und", "x y"]
    rows = [(rng.choice(langs), "".join(rng.choice(words) + rng.choice(gaps)
                                        for _ in range(rng.randrange(30)))) for _ in range(n)]
    return rows + [("en", None), (None, ""), ("en", "!?"), ("fr", "only one"),
                   ("long", "a b " * 30000)]


def test_odd_texts_against_plain_loop(spark):
    rows = odd_rows(random.Random(1), 400)
    docs = spark.createDataFrame(rows, "lang string, text string").withColumns(
        {"key": F.lit(1), "n": F.lit("x"), "size": F.lit(2), "phrase": F.lit("p")}).repartition(6)
    for least, top, per_slice in ((30, 2000, 50), (2, 7, 20_000), (1, 2000, 300)):
        want = plain(rows, least, top)
        assert result(co.collocations(docs, top=top, least=least, rows_per_slice=per_slice)) == want
        assert want


def test_nothing_and_ties(spark):
    none = spark.createDataFrame([], "lang string, text string")
    assert result(co.collocations(none)) == []
    assert result(co.collocations(spark.createDataFrame([("en", None)], none.schema))) == []
    # phrases alike in score and count are ranked by their text
    rows = [("en", f"{w}1 {w}2") for w in "qwertz"] * 30
    got = result(co.collocations(spark.createDataFrame(rows, none.schema), top=4))
    assert [(r[1], r[2]) for r in got] == [(1, "e1 e2"), (2, "q1 q2"), (3, "r1 r2"), (4, "t1 t2")]


def test_first_word_of_all_phrases_fills_many_slices(spark):
    rows = [("en", f"the w{i}") for i in range(300)] * 30
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert result(co.collocations(docs, rows_per_slice=20)) == plain(rows)


def test_words_of_a_batch(monkeypatch):
    monkeypatch.setattr("trafficlens.llm.word_arrays.WINDOW", 16)
    texts = ["Ab  cd\tE.f", "", "g h", ",,", "é ü"]
    w = co._Words(pa.array(["x"] * 5), pa.array(texts))
    assert w.phrases(np.arange(len(w.h)), 1).to_pylist() == [
        "ab", "cd", "e", "f", "g", "h", "é", "ü"]
    assert w.joined.tolist() == [False, True, True, False, False, True, False, True]
    assert w.phrases(np.array([0]), 3).to_pylist() == ["ab cd e"]


def test_tasks_hand_on_small_batches():
    rows = [" ".join(f"w{i}" for i in range(lo, lo + 50_000)) for lo in range(0, 200_000, 50_000)]
    texts = pa.RecordBatch.from_pydict({"lang": ["en", "de"] * 2, "text": rows})
    got = list(co._hashed(1, {})([texts]))
    assert max(b.num_rows for b in got) <= 1 << 16
    words = [b for b in got if b.column(0).null_count]
    assert sum(b.num_rows for b in words) == 200_000
    assert sum(sum(b.column(2).to_pylist()) for b in got if not b.column(0).null_count) == 200_000


def test_tasks_hold_no_second_copy_of_their_ngrams(spark, monkeypatch):
    plans, write = {}, co.shared_table

    def kept(df, label):
        plans.setdefault(label, []).append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, label)

    monkeypatch.setattr(co, "shared_table", kept)
    docs = spark.createDataFrame([("en", "a b c d e")] * 30, "lang string, text string")
    grams, totals = co.frequent_ngrams(docs)
    assert sorted(r[1] for r in grams.collect()) == sorted(
        "abcde"[i:i + n].replace("", " ").strip() for n in range(1, 5) for i in range(6 - n))
    assert {r[2] for r in grams.collect()} == {30} and [tuple(r) for r in totals.collect()] == [("en", 150)]
    for plan in [*plans["counts-by-key"], *plans["ngrams"]]:
        assert "Aggregate" not in plan.split("Exchange", 1)[1]
    assert len(plans["counts-by-key"]) == co.WORDS


def test_a_phrase_is_named_about_once_in_many_tasks(spark, monkeypatch):
    handed, names = [], co._names_by_key

    def kept(rows, sent):
        handed.append(rows.mapInArrow(co._named(sent), "lang string, key long, phrase string").count())
        return names(rows, sent)

    monkeypatch.setattr(co, "_names_by_key", kept)
    rng = random.Random(5)
    rows = [("en", " ".join(f"w{i}" for i in rng.sample(range(500), 200))) for _ in range(600)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(40)
    want = {(lang, " ".join(p), a) for (lang, p), a in counts(rows)[0].items() if a >= 30}
    assert set(map(tuple, co.frequent_ngrams(docs)[0].collect())) == want
    assert len(want) == 500 and handed[0] < 2 * len(want)


@pytest.mark.parametrize("least", [30])
def test_query_against_sql(spark, sf_dir, con, least):
    got = result(QUERIES["op11_collocations"](spark, sf_dir))
    want = con.execute(ORACLE["op11_collocations"]).fetchall()
    assert got == sorted((w[0], *map(int, w[1:2]), w[2], *map(int, w[3:])) for w in want)
