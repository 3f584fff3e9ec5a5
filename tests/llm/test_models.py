import collections
import itertools
import math
import re

import numpy as np
import plain
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trafficlens.llm import brown, crf, toxicity
from trafficlens.llm.columns import id_crc, named
from trafficlens.llm.queries import QUERIES
from trafficlens.llm.word_arrays import word_spans

EXTRA = "doc_id long, text string, row string, words int, score int, k0 int, label int"


def odd_frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3, 4) for i, t in rows], EXTRA)


# --- Brown classes -------------------------------------------------------------------------------

def likelihood(pairs, own):
    k = int(own.max()) + 1
    joint = np.zeros((k, k))
    np.add.at(joint, (own[:, None].repeat(len(own), 1), own[None].repeat(len(own), 0)), pairs)
    f = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()
    return f(joint) - f(joint.sum(0)) - f(joint.sum(1))


def test_exchange_only_raises_the_likelihood_and_finds_blocks():
    rng = np.random.default_rng(0)
    truth = np.arange(30) % 3
    pairs = rng.poisson(np.where(truth[:, None] == truth[None], 40, 1), (30, 30)).astype(float)
    wide = np.zeros((31, 31))
    wide[:30, :30] = pairs
    # start from mixed classes: words in an order that does not follow the truth
    order = rng.permutation(30)
    wide[:30, :30] = pairs[np.ix_(order, order)]
    start = np.append(np.arange(30) % 3, 3)
    own = np.append(brown.exchange(wide, 3), 3)
    assert likelihood(wide, own) >= likelihood(wide, start)
    assert len(set(zip(own[:30], truth[order]))) == 3


def check_base(got, rows):
    counts = collections.Counter()
    for i, t in rows:
        if plain.crc(i) % 7 != 2:
            counts.update([*plain.words(t), "\0end"])
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), plain.crc(i) % 7 == 2, len(plain.words(t)) + 1,
                   sum(counts[w] > 0 for w in [*plain.words(t), "\0end"]), n,
                   round(sum(math.log10((counts[w] + 1) / (n + v + 1))
                             for w in [*plain.words(t), "\0end"]), 6)) for i, t in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens,
                   round(r.base_score, 6)) for r in got) == want


def test_brown_on_the_supplied_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = QUERIES["op1_brown_lm"](spark, sf_dir).collect()
    check_base(got, rows)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > 0.85 * sum(r.base_score for r in held)  # logs: less is worse
    assert all(r.score < 0 for r in got)


@pytest.mark.parametrize("rows", [
    [], [(1, None)], [(None, "a b a"), (None, "a b a"), (3, ""), (4, "x" * 100_000), (5, "A a\x0bb")]])
def test_brown_odd_tables(spark, rows):
    docs = odd_frame(spark, rows)
    held = id_crc() % 7 == 2
    model, words = brown.train(docs.where(~held), exchanged=2, least=2, classed=2, counted=4, classes=2)
    got = brown.score(docs, model, words, held).collect()
    check_base(got, rows)
    check_scores(got, rows, model, words)


def hash_of(word):
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(word_spans(raw, np.array([0, len(raw)]))[3].view(np.int64)[0])


def check_scores(got, rows, model, words):
    """Every score again, token by token, from the model's tables."""
    table = {r.word: r for r in words.collect()}
    unseen = math.log10((brown.DISCOUNT * model.rare_types + 1) / (model.rare_tokens + 1))
    want = []
    for i, t in rows:
        before, score = model.end, 0.0
        for w in [*plain.words(t), None]:
            row = table.get(0 if w is None else hash_of(w))
            cls = model.end if w is None else row.cls if row else model.rare
            score += model.step[before, cls] + (row.emit if row else 0.0 if w is None else unseen)
            before = cls
        want.append((str(i), round(score, 6)))
    assert sorted((str(r.doc_id), round(r.score, 6)) for r in got) == sorted(want)


def test_brown_without_training_rows_gives_every_token_one_half(spark):
    docs = odd_frame(spark, [(1, "a b c"), (2, None)])
    model, words = brown.train(docs.limit(0))
    got = {r.doc_id: r.score for r in brown.score(docs, model, words, F.lit(True)).collect()}
    assert got == {1: pytest.approx(4 * math.log10(0.5)), 2: pytest.approx(math.log10(0.5))}


def language(seed, n, kinds=3, size=40):
    """Sentences that step from one kind of words to the next; words of a kind are alike."""
    rng = np.random.default_rng(seed)
    rank = lambda: int(min(rng.pareto(1.0) * 3, size - 1))
    return [(i, " ".join(f"w{(k + int(rng.random() < .1)) % kinds}x{rank()}"
                         for k in range(int(rng.integers(6, 30))))) for i in range(n)]


@pytest.fixture(scope="module")
def kinds(spark):
    return language(3, 400)


def test_brown_words_beyond_the_seeds_find_their_class(spark, kinds):
    """Most classed words are no seeds; the sweeps put words of a kind together."""
    docs = odd_frame(spark, kinds)
    model, words = brown.train(docs, exchanged=9, least=5, classed=9, classes=3)
    table = {r.word: r for r in words.collect()}
    classed = {w: table[hash_of(w)].cls for _, t in kinds for w in t.split()
               if table[hash_of(w)].cls < model.rare}
    assert len(classed) > 40
    right = sum(max(collections.Counter(c for w, c in classed.items() if w[1] == k).values())
                for k in "012")
    assert right > 0.9 * len(classed)
    counts = collections.Counter(w for _, t in kinds for w in t.split())
    assert {w for w, n in counts.items() if n >= 5} == set(classed)


def test_brown_scores_do_not_depend_on_what_is_sent(spark, kinds):
    docs = odd_frame(spark, kinds)
    held = id_crc() % 7 == 2
    scores = []
    for counted in (1000, 7):  # with 7, the classes of most words are joined
        model, words = brown.train(docs.where(~held), exchanged=9, least=5, classed=9, classes=3,
                                   counted=counted)
        assert model.all_classed == (counted == 1000)
        got = brown.score(docs, model, words, held).collect()
        check_base(got, kinds)
        check_scores(got, kinds, model, words)
        scores.append({r.doc_id: round(r.score, 6) for r in got})
    assert scores[0] == scores[1]


def test_brown_shuffles_little(spark):
    """Ranks of a bigram go as one number, and words not sent are counted per text before they go."""
    texts = [f"a b c w{i} w{i} w{i}" for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model, words = brown.train(docs, counted=3, exchanged=3, classed=3)
    scored = brown.score(docs, model, words, F.lit(True))
    assert all(r.n_known == 7 for r in scored.collect())
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(row#\w+, word#", plan)
    sent = spark.sparkContext.broadcast((np.array([7], np.uint64), np.array([2], np.uint64), None))
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    assert [b.schema.names for b in brown._bigrams(sent)(iter([batch]))] == [["pair", "n"]]


def test_brown_probabilities_sum_to_one(spark):
    docs = odd_frame(spark, [(i, "a b c d a b e f") for i in range(5)] + [(9, "g h")])
    model, words = brown.train(docs, exchanged=3, least=4, classed=3, counted=5, classes=2)
    assert np.allclose((10 ** model.step).sum(1), 1)
    rows = words.collect()
    for c in range(model.rare):
        emits = [r.emit for r in rows if r.cls == c]
        assert not emits or sum(10 ** e for e in emits) == pytest.approx(1)
    rare = sum(10 ** r.emit for r in rows if r.cls == model.rare)
    unseen = (brown.DISCOUNT * model.rare_types + 1) / (model.rare_tokens + 1)
    assert rare + unseen == pytest.approx(1)


# --- languages -----------------------------------------------------------------------------------

def test_posteriors_against_all_paths():
    rng = np.random.default_rng(1)
    row = np.array([0] * 5 + [1] + [3] * 3)
    emission, steps = rng.normal(size=(9, 3)), rng.normal(size=(3, 3))
    want = np.zeros((9, 3))
    for r in (0, 1, 3):
        at = np.flatnonzero(row == r)
        for path in itertools.product(range(3), repeat=len(at)):
            score = sum(emission[a, y] for a, y in zip(at, path)) + sum(
                steps[x, y] for x, y in zip(path, path[1:]))
            for a, y in zip(at, path):
                want[a, y] += math.exp(score)
    want /= want.sum(1, keepdims=True)
    assert np.allclose(crf.posteriors(emission, row, steps), want)


@pytest.mark.parametrize("size", [1, 31, 32, 33, 200])
def test_posteriors_over_blocks(size):
    rng = np.random.default_rng(size)
    e, t = rng.normal(size=(size, 2)), rng.normal(size=(2, 2))
    ahead, back = np.exp(e), np.ones((size, 2))
    for i in range(1, size):
        ahead[i] *= ahead[i - 1] @ np.exp(t)
        ahead[i] /= ahead[i].sum()
    for i in range(size - 2, -1, -1):
        back[i] = np.exp(t) @ (np.exp(e[i + 1]) * back[i + 1])
        back[i] /= back[i].sum()
    want = ahead * back
    two = crf.posteriors(np.concatenate([e, e]), np.repeat([4, 9], size), t)
    assert np.allclose(two, np.tile(want / want.sum(1, keepdims=True), (2, 1)))


def test_languages_on_the_supplied_table(spark, sf_dir):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    held = [r for r in QUERIES["op5_crf_language"](spark, sf_dir).collect() if r.held_out]
    assert len(held) > 100 and all(0 <= r.score <= 1 for r in held)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


def test_language_sample_holds_distinct_texts(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(crf, "fit", lambda texts, labels, langs: seen.update(
        texts=texts, labels=list(labels), langs=langs))
    rows = [(f"text {i}", lang) for i in range(30) for lang in ("a", "b") for _ in range(40)]
    crf.train(spark.createDataFrame(rows, "text string, lang string"), sample=20)
    for k in range(2):
        texts = [t for t, i in zip(seen["texts"], seen["labels"]) if i == k]
        assert len(texts) == len(set(texts)) == 20


def test_language_odd_rows_and_no_labels(spark):
    rows = [(1, "the and of"), (1, "the and of"), (None, None), (3, ""), (4, "12 !!"), (5, "é" * 90_000),
            (6, "der und die das der")]
    docs = odd_frame(spark, rows).withColumn("lang", F.when(F.col("doc_id") == 1, "en").when(
        F.col("doc_id") == 6, "de"))
    model = crf.train(docs)
    got = {r.doc_id: r for r in crf.predict(docs, model, {"doc_id": named("doc_id")}).collect()}
    assert [got[i].lang_pred for i in (None, 3, 4)] == ["und"] * 3 and got[3].score == 0
    assert got[5].lang_pred in ("de", "en")
    unlabelled = crf.train(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in crf.predict(docs, unlabelled, {}).collect()} == {"und"}
    assert crf.predict(docs.limit(0), model, {}).collect() == []


# --- toxicity ------------------------------------------------------------------------------------

def test_toxicity_learns_misspellings():
    rng = np.random.default_rng(3)
    usual = ["river", "window", "paper", "garden", "silver", "morning", "letter", "travel"]
    texts, labels = [], []
    for k in range(300):
        words = list(rng.choice(usual, 30))
        if k % 2:
            words[rng.integers(30)] = rng.choice(["dreadfool", "dreadfuul", "dreadffol"])
        texts.append(" ".join(words))
        labels.append(k % 2)
    model = toxicity.fit(texts, np.array(labels), 0.5, passes=20)
    test = [" ".join([*usual, "dreadfol"]), " ".join(usual), ""]
    import pyarrow as pa

    run = toxicity._scorer(model.values, model.bias, 0)
    scores = next(run([pa.RecordBatch.from_arrays([pa.array(test)], ["text"])])).column(0).to_pylist()
    assert scores[0] > 0.5 > scores[1] and 0 <= scores[2] <= 1


def test_toxicity_sample_is_the_stated_one(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, toxic, *a, **k: seen.append(np.bincount(toxic.astype(int))))
    rows = [(i, f"text {i}") for i in range(5200)]
    toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(
        [(i, int(i >= 3600)) for i in range(5200)], "doc_id long, toxic int"))
    assert seen[0].tolist() == [3500, 1500]


def test_toxicity_odd_rows(spark):
    rows = [(1, "a"), (1, "a"), (None, None), (3, ""), (4, "b " * 50_000), (5, "!! 12")]
    docs = odd_frame(spark, rows)
    for label, low, high in (("cast(null as int)", 0.5, 0.5), ("1", 0.9, 1), ("0", 0, 0.1),
                             ("doc_id % 2", 0, 1)):
        labels = docs.select("doc_id", F.expr(label).alias("toxic"))
        model = toxicity.train(docs, labels)
        got = toxicity.score(docs, model, ["doc_id", "k0"]).collect()
        assert len(got) == 6 and all(low <= r.score <= high for r in got)
    assert toxicity.score(docs.limit(0), model, ["doc_id"]).collect() == []


def test_toxicity_on_a_supplied_table(spark):
    sf = "/root/testdata/sf0.1"
    import os

    if not os.path.isdir(sf):
        pytest.skip("test tables are not here")
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [(r.predicted, toxic[r.doc_id]) for r in QUERIES["op9_toxicity"](spark, sf).collect()
           if r.held_out and r.doc_id in toxic]
    hits = sum(p and t for p, t in got)
    assert hits >= 0.6 * sum(t for _, t in got) and hits >= 0.7 * sum(p for p, _ in got)


def test_toxicity_learns_from_a_few_rows(spark):
    rows = [(1, "you rotten scum"), (2, "rotten filthy scum"), (3, "filthy rotten liar"),
            (4, "a pleasant walk"), (5, "the pleasant garden"), (6, "garden walk today")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 4)) for i, _ in rows], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, labels), ["doc_id"]).collect()
    assert {r.k0: r.score >= 0.5 for r in got} == {i: i < 4 for i, _ in rows}
