import hashlib
import random
import re

import plain
import pytest

from trafficlens.llm import exact_dedup, mixing
from trafficlens.llm.queries import ORACLE, QUERIES
from checks.compare import differences

SCHEMA = "doc_id long, text string, source string, row int, size int, `digest` string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, 2, "x") for i, t, s in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("name", ["op6_exact_dedup", "op7_mix_sources", "op8_host_trust"])
def test_query_matches_sql(name, spark, sf_dir, con):
    if name not in ORACLE:
        pytest.skip("no SQL")
    got = QUERIES[name](spark, sf_dir).toPandas()
    assert differences(got, con.execute(ORACLE[name]).df()) is None


def plain_dedup(rows):
    groups = {}
    for i, t, _ in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        groups.setdefault(hashlib.sha256(norm.encode()).hexdigest(), []).append((i, t or ""))
    out = []
    for digest, members in groups.items():
        order = sorted(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))
        out += [(m[0], order[0][0], len(members), k == 0, digest) for k, m in enumerate(order)]
    return sorted(out, key=str)


@pytest.mark.parametrize("support", [0.001, 0.05, 0.4])
def test_exact_duplicates(spark, support):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choices("ab \n\x0b", k=rng.randrange(6))), "s") for i in range(300)]
    rows += [(1000 + i, "hot  text" + " " * (i % 3), "s") for i in range(200)]
    rows += [(None, None, "s"), (None, "", None), (7, "dup", "s"), (7, "dup", "s"),
             (8, "\U0001F600 x", "s"), (9, "x" * 200_000, "s"), (10, " ".join("x" * 200_000), "s")]
    got = exact_dedup.exact_duplicates(frame(spark, rows), support=support).collect()
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got), key=str)
    assert got == plain_dedup(rows)


def test_empty_tables(spark):
    none = frame(spark, [])
    assert exact_dedup.exact_duplicates(none).collect() == []
    assert mixing.mix_sources(none).collect() == []


def plain_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + (
        [None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        left = total - sum(cap * sizes[s] for s in full)
        free = [s for s in names if s not in full]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > cap * sizes[s]}
        if not over:
            return {s: float(cap * sizes[s]) if s in full else share[s] for s in names}
        full |= over


def test_mix(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 30])), rng.choice(["a", "b", "z", "é", None]))
            for i in range(400)]
    rows += [(1, "same row", "tiny"), (1, "same row", "tiny"), (1, "same row", "tiny"),
             (None, None, "empty"), (None, "a b c", "b"), (5, "w " * 50_000, "hot")]
    got = mixing.mix_sources(frame(spark, rows), keep=["source", "text"]).collect()
    again = mixing.mix_sources(frame(spark, rows).repartition(5), keep=["source", "text"]).collect()
    key = lambda r: (str(r.doc_id), str(r.keep_1), r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    sizes, taken, largest = {}, {}, {}
    for r in got:
        assert r.size == len(plain.words(r.keep_1)) and r.taken == r.size * r.copies
        assert 0 <= r.copies <= 3
        sizes[r.keep_0] = sizes.get(r.keep_0, 0) + r.size
        taken[r.keep_0] = taken.get(r.keep_0, 0) + r.taken
        largest[r.keep_0] = max(largest.get(r.keep_0, 0), r.size)
    want = plain_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.keep_0] and r.target == pytest.approx(want[r.keep_0])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
