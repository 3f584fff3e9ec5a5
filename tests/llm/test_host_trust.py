import pytest

from trafficlens.llm import host_trust

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
         ("block", "net/es/"))
SCHEMA = "page_id long, url string, html string, host string, verdict string, score int"


def judged(spark, rows, rules=RULES):
    pages = spark.createDataFrame([(i, u, h, "x", "y", 1) for i, u, h in rows], SCHEMA).repartition(3)
    return {r.page_id: r for r in host_trust.judge(pages, rules).collect()}


def test_hosts_paths_and_rules(spark):
    rows = [(1, "HTTP://WWW.Example.COM/en/a?x#y", None), (2, "http://a.example.com/en/", ""),
            (3, "http://example.com", ""), (4, "x://b.net/es/1", ""), (5, "notexample.com/en/", None),
            (6, None, "<a href='http://z.org/'>"), (7, "http://a.com?q=/en/", ""),
            (8, "h://notexample.com/en/x", ""), (9, "a://b://c/d", ""), (10, "http://É.com/É#", "")]
    got = judged(spark, rows)
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(1, 11)] == [
        ("www.example.com", "/en/a", "www.example.com/en/", "allow"),
        ("a.example.com", "/en/", "example.com/en/", "block"),
        ("example.com", "", None, got[3].verdict), ("b.net", "/es/1", "net/es/", "block"),
        ("", "", None, "allow"), ("", "", None, "allow"), ("a.com", "", None, "allow"),
        ("notexample.com", "/en/x", "com/", "allow"), ("b:", "//c/d", None, "allow"),
        ("É.com", "/É", "com/", "allow")]


def test_trust_and_distrust_follow_links(spark):
    link = "<p><a class=x href=\"http://{}/\">t</a>"
    rows = [(1, "http://good.com/", link.format("friend.org")),
            (2, "http://friend.org/", link.format("far.org")), (3, "http://far.org/", None),
            (4, "http://farm.org/", link.format("bad.net") + "<A HREF='//bad.net/x'>"),
            (5, "http://bad.net/es/", link.format("victim.org")), (6, "http://victim.org/", ""),
            (7, "http://sub.farm.org/", ""), (8, "http://bad.net/de", ""), (8, "http://bad.net/de", "")]
    got = judged(spark, rows)
    assert [got[i].verdict for i in range(1, 9)] == [
        "allow", "allow", "allow", "block", "block", "allow", "block", "block"]
    # against plain sums over links
    edges = {("good.com", "friend.org"): 1, ("friend.org", "far.org"): 1, ("farm.org", "bad.net"): 2,
             ("bad.net", "victim.org"): 1, ("farm.org", "sub.farm.org"): 1,
             ("sub.farm.org", "farm.org"): 1}
    for kind, seeds in (("trust", {"good.com": 1.0}), ("distrust", {"bad.net": 1.0})):
        flow = edges if kind == "trust" else {(b, a): n for (a, b), n in edges.items()}
        score = dict(seeds)
        for _ in range(300):
            new = {h: s * (1 - host_trust.DAMPING) for h, s in seeds.items()}
            for (a, b), n in flow.items():
                total = sum(m for (x, _), m in flow.items() if x == a)
                new[b] = new.get(b, 0) + host_trust.DAMPING * score.get(a, 0) * n / total
            score = new
        for r in got.values():
            assert getattr(r, kind) == pytest.approx(score.get(r.host, 0.0))


def test_empty_table(spark):
    assert judged(spark, []) == {}


def test_distrust_reaches_along_a_chain(spark):
    """Thirty hosts lead to a blocked one; what little arrives at the far end is enough."""
    rows = [(i, f"http://h{i}.x{i}/", f"<a href='http://h{i + 1}.x{i + 1}/'>") for i in range(30)]
    rows += [(30, "http://h30.x30/", "<a href='http://bad.net/'>"), (31, "http://bad.net/es/", None),
             (32, "http://alone.org/", None)]
    got = judged(spark, rows)
    assert [got[i].verdict for i in range(33)] == ["block"] * 32 + ["allow"]
    assert got[0].distrust == pytest.approx(0.15 * 0.85 ** 31, rel=1e-9)


def test_sql_of_the_chain(spark):
    import duckdb

    rows = [(i, f"http://h{i}.x{i}/", f"<a href='http://h{i + 1}.x{i + 1}/'>") for i in range(20)]
    rows += [(20, "http://h20.x20/", "<a href='http://bad.net/'>"), (21, "http://bad.net/es/", None)]
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", rows)
    want = {r[0]: r[4] for r in con.execute(host_trust.judge_sql(RULES)).fetchall()}
    assert {i: r.verdict for i, r in judged(spark, rows).items()} == want
