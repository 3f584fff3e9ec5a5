import itertools
import pathlib
import re

import plain
import pytest

from trafficlens.functions.text import PII_PATTERNS
from trafficlens.llm import feistel, spaced_seeds
from trafficlens.llm.queries import QUERIES

EXTRA = "doc_id long, text string, words int, seed string, doc_row int, `n.x` int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2, 3) for i, t in rows], EXTRA)


# --- pseudonyms ----------------------------------------------------------------------------------

def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def rewritten(spark, texts, key="k"):
    got = feistel.pseudonymise(frame(spark, list(enumerate(texts))), key).orderBy("doc_id").collect()
    return [(r.text, r.n_pseudonyms) for r in got]


def test_values_keep_their_format_and_stay_linked(spark):
    a, b = rewritten(spark, [
        "card 4111 1111 1111 1111, ip 10.0.0.1, call +1 (415) 555-2671, born 1980-02-29, 123-45-6789",
        "4111111111111111; 415-555-2671; ann.lee7@example.com; 29.02.1980 or 02/29/1980; 10.0.0.1"])
    assert a[1] == 5 and b[1] == 6
    spaced = re.search(r"card (\d{4}) (\d{4}) (\d{4}) (\d{4}),", a[0]).groups()
    plain_card, phone, mail, dotted, slashed, ip = re.match(
        r"(\d{16}); (\d{3}-\d{3}-\d{4}); (\S+@example\.com); (\S+) or (\S+); (\S+)$", b[0]).groups()
    assert "".join(spaced) == plain_card != "4111111111111111" and luhn(plain_card)
    assert re.sub(r"\D", "", re.search(r"call (.*), born", a[0])[1]) == "1" + phone.replace("-", "")
    assert f"ip {ip}," in a[0] and all(int(x) < 256 for x in ip.split("."))
    assert re.fullmatch(r"[a-z]{3}\.[a-z]{3}\d@example\.com", mail) and mail != "ann.lee7@example.com"
    y, m, d = re.search(r"born (\d{4})-(\d\d)-(\d\d)", a[0]).groups()
    assert (dotted, slashed) == (f"{d}.{m}.{y}", f"{m}/{d}/{y}")
    assert rewritten(spark, ["10.0.0.1"], "other")[0][0] != ip


def test_what_fails_validation_stays(spark):
    texts = ["4111111111111112", "2023-02-30", "300.1.1.1", "000-12-3456", "1.2.3", "a@b", "x10.0.0.1",
             "0000000000000000", "", None, "no values", "99999999999999999999999"]
    assert rewritten(spark, texts) == [(t, 0) for t in texts]


def test_the_network_is_a_permutation(spark):
    texts = [f"10.0.{i // 256}.{i % 256}" for i in range(2000)]
    out = [t for t, _ in rewritten(spark, texts)]
    assert len(set(out)) == 2000
    days = [f"{d:02d}.{m:02d}.19{y:02d}" for d in range(1, 29) for m in range(1, 13) for y in range(0, 99, 9)]
    assert len({t for t, _ in rewritten(spark, days)}) == len(days)


PHONE = re.compile(dict(PII_PATTERNS)["PHONE"])


def test_phone_numbers_of_any_area_and_layout(spark):
    texts = ["+1 (017) 555-7713", "+1 (132) 555-1352", "a 0175557713 b", "017.555.7713", "555-123-4567",
             "+44 017 555 7713", "(017)5557713", "x-017-555-7713", "+490175557713", "017) 555-7713"]
    out = rewritten(spark, texts)
    assert all(n == 1 for _, n in out)
    assert all(re.sub(r"\d", "9", a) == re.sub(r"\d", "9", b) for a, (b, _) in zip(texts, out))
    digits = [re.sub(r"\D", "", t) for t, _ in out]
    assert len({d[-10:] for d, a in zip(digits, texts) if "7713" in a}) == 1
    assert digits[5][:2] == "44" and digits[8][:2] == "49"
    many = rewritten(spark, [f"{i % 1000:03d} 000 {i:04d}" for i in range(0, 9000, 7)])
    assert len({t for t, _ in many}) == len(many)


def test_supplied_phone_numbers_are_all_rewritten(spark, sf_dir):
    old = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = 0
    for r in QUERIES["op3_feistel_pii"](spark, sf_dir).collect():
        # the reference takes card numbers first
        for m in PHONE.finditer(old[r.doc_id]):
            found += 1
            assert m[0] not in r.text, m[0]
    assert found


def test_card_numbers_among_other_digits(spark):
    card = "4111 1111 1111 1111"
    alone = rewritten(spark, [card])[0][0]
    assert luhn(re.sub(r"\D", "", alone)) and alone != card
    # none of these has another alignment with a right check digit further left
    texts = ["a 2020 {} b", "{} {} {}", "7 {}", "{} 2020", "2020  {}", "1980-02-29 {}", "9-{}",
             "{} 415-555-2671", "2020 123-45-6789 {}", "12 415-555-2671, {}"]
    out = rewritten(spark, [t.replace("{}", card) for t in texts])
    for t, (got, n) in zip(texts, out):
        assert got.count(alone) == t.count("{}") and card not in got, (t, got)
    assert [n for _, n in out] == [1, 3, 1, 1, 1, 2, 1, 2, 2, 2]
    amex, short = rewritten(spark, ["5 3782 822463 10005 1", "3056 930902 5904"])
    assert re.fullmatch(r"5 \d{4} \d{6} \d{5} 1", amex[0]) and luhn(re.sub(r"\D", "", amex[0][2:-2]))
    assert luhn(re.sub(r"\D", "", short[0])) and short[1] == 1
    (numbers, _), = rewritten(spark, [" ".join(["4111111111111112"] * 3000)])
    assert len(numbers) == 17 * 3000 - 1


def test_very_long_text_and_empty_table(spark):
    long = "word " * 200_000 + "10.0.0.1" + " word" * 10
    (text, n), = rewritten(spark, [long])
    assert n == 1 and len(text.split()) == 200_011 and text.startswith("word ")
    assert rewritten(spark, []) == []


def test_supplied_table_changes_only_values(spark, sf_dir):
    old = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    some = re.compile(feistel.ANY)
    for r in QUERIES["op3_feistel_pii"](spark, sf_dir).collect():
        assert some.split(r.text) == some.split(old[r.doc_id])
        changed = [(a, b) for a, b in zip(some.findall(old[r.doc_id]), some.findall(r.text)) if a != b]
        assert len(changed) == r.n_pseudonyms
        assert all(re.sub(r"\d", "9", a) == re.sub(r"\d", "9", b) for a, b in changed
                   if "@" not in a and a.count(".") != 3)


# --- benchmark passages --------------------------------------------------------------------------

def tokens(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def plain_hits(docs, items, span=13, percent=80):
    out = set()
    for i, t in docs:
        w = tokens(t)
        for k, item in items:
            q = tokens(item)
            if len(q) < 6:
                continue
            wide, best = min(span, len(q)), 0
            seeds = {}
            for skip in (0, 1, 2):
                for a in range(len(q) - 5 - skip):
                    seeds.setdefault((skip, *q[a:a + 3], *q[a + 3 + skip:a + 6 + skip]), []).append(a)
            shifts = {p - a for skip in (0, 1, 2) for p in range(len(w) - 5 - skip)
                      for a in seeds.get((skip, *w[p:p + 3], *w[p + 3 + skip:p + 6 + skip]), ())}
            for s in shifts:
                same = [q[j] == w[j + s] for j in range(len(q)) if 0 <= j + s < len(w)]
                best = max([best, *(sum(same[x:x + wide]) for x in range(max(1, len(same) - wide + 1)))])
            if best and 100 * best >= percent * wide:
                out.add((i, k, best, wide))
    return out


def test_passages_with_replaced_words(spark):
    q = [f"q{i}" for i in range(30)]
    other = [f"z{i}" for i in range(40)]

    def with_changes(every):
        return [w if (k + 1) % every else "changed" for k, w in enumerate(q)]

    docs = [(1, " ".join(other + q + other)), (2, " ".join(other + with_changes(5) + other)),
            (3, " ".join(other + with_changes(3) + other)), (4, " ".join(q[:6] + other)),
            (5, " ".join(q[10:23])), (6, ", ".join(q).upper()), (7, None), (8, ""),
            (None, " ".join(q)), (1, " ".join(other + q + other)), (9, " ".join(q[:10] + other)),
            (10, "pad " * 60_000 + " ".join(q))]
    items = [(0, " ".join(q)), (1, "too short an item"), (2, None), (3, " ".join(other[:7]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = spaced_seeds.contaminated(frame(spark, docs), bench).collect()
    got = [(r.doc_id, r.item_id, r.matched_words, r.span_words) for r in got]
    assert len(got) == len(set(got)) and set(got) == plain_hits(docs, items)
    assert {1, 2, 5, 6, 10, None} <= {i for i, k, *_ in got if k == 0}
    assert not {3, 4, 9} & {i for i, k, *_ in got if k == 0}
    kept = [r.doc_id for r in spaced_seeds.clean_documents(frame(spark, docs[6:8] + docs[4:6]), bench
                                                           ).collect()]
    assert sorted(kept) == [7, 8]


def all_alignments(docs, items, span=13, percent=80):
    """Hits by comparing every alignment, without seeds."""
    out = set()
    for i, t in docs:
        w = tokens(t)
        for k, item in items:
            q = tokens(item)
            wide, best = min(span, len(q)), 0
            for s in range(1 - len(q), len(w)):
                same = [q[j] == w[j + s] for j in range(len(q)) if 0 <= j + s < len(w)]
                best = max([best, *(sum(same[x:x + wide]) for x in range(max(1, len(same) - wide + 1)))])
            if best and 100 * best >= percent * wide:
                out.add((i, k, best, wide))
    return out


def test_every_passage_above_the_bar_is_found(spark):
    items, docs = [], []
    for n in (*range(1, 14), 15, 18):
        q = [f"q{n}x{i}" for i in range(n)]
        items.append((n, " ".join(q)))
        lost = min(n, 13) - -(-80 * min(n, 13) // 100)
        for gone in (g for size in (lost, lost + 1) for g in itertools.combinations(range(min(n, 13)), size)):
            text = ["changed" if i in gone or i > 12 else w for i, w in enumerate(q)]
            if len(gone) == lost or len(docs) % 7 == 0:
                docs.append((len(docs), " ".join(["pad", *text, "pad"])))
            else:
                docs.append((len(docs), " ".join(text[1:])))
    items += [(100, "pad pad"), (101, None), (102, "..."), (103, "pad"), (104, "a b a b a")]
    docs += [(len(docs), "a b a b"), (len(docs) + 1, "b a b a"), (len(docs) + 2, "pad pad")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r)[1:] for r in spaced_seeds.contaminated(frame(spark, docs), bench).collect()]
    assert len(got) == len(set(got)) and set(got) == all_alignments(docs, items)
    assert {k for _, k, *_ in got} >= {*range(1, 14), 15, 18, 100, 103, 104}


def test_few_rows_are_not_dealt_over_many_files(spark):
    items = [(n, " ".join(f"q{n}x{i}" for i in range(13))) for n in range(20)] + [(20, "p q")]
    docs = [(n, f"pad {t} pad") for n, t in items] + [(100 + n, "no hit in it") for n in range(20)]
    scratch = pathlib.Path(spark.conf.get("spark.checkpoint.dir"))
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before, old = {k: spark.conf.get(k) for k in held}, set(scratch.glob("seed-*"))
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        bench = spark.createDataFrame(items + items[:5], "item_id long, text string").coalesce(2)
        got = spaced_seeds.contaminated(frame(spark, docs + docs[:5]).coalesce(2), bench).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    got = [tuple(r)[1:] for r in got]
    assert len(got) == len(set(got)) and set(got) == all_alignments(docs, items)
    made = set(scratch.glob("seed-*")) - old
    assert made and all(len(list(d.glob("part-*"))) <= 2 for d in made)


def test_supplied_tables_without_seeds(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", "text").orderBy("doc_id").limit(300).collect()]
    # passages of the documents themselves, with places 5 and 8 replaced
    items = []
    for i, t in docs[::10]:
        q = tokens(t)[3:16]
        if len(q) == 13:
            q[5] = q[8] = "replaced"
            items.append((i, " ".join(q)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r)[1:] for r in spaced_seeds.contaminated(frame(spark, docs), bench).collect()}
    assert {i for i, _ in items} <= {i for i, k, *_ in got if i == k}


def test_empty_sides(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    docs = frame(spark, [(1, "a b c d e f g")])
    assert spaced_seeds.contaminated(docs, bench).collect() == []
    full = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert spaced_seeds.contaminated(docs.limit(0), full).collect() == []


def test_supplied_tables(spark, sf_dir):
    rows = lambda n, c: [tuple(r) for r in spark.read.parquet(
        f"{sf_dir}/{n}.parquet").select(*c).collect()]
    got = {tuple(r) for r in QUERIES["op2_spaced_seeds"](spark, sf_dir).collect()}
    assert got == plain_hits(rows("documents", ["doc_id", "text"]), rows("benchmark", ["item_id", "text"]))
