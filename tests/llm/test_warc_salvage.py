import gzip
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from trafficlens.llm import warc_salvage as warc
from trafficlens.llm.queries import ORACLE, QUERIES


def record(i, body):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + body
    head = (f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\n"
            f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}\r\n"
            f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n")
    return head.encode() + block + b"\r\n\r\n"


def bodies(rng, n):
    words = [b"WARC/1.1\r\n", b"\x1f\x8b\x08", b"\r\n\r\n", b"text ", b"<p>", "é".encode()]
    return [b"".join(rng.choices(words, k=rng.randrange(60))) for _ in range(n)]


def archive(rng, n, packed):
    pieces = [record(i, b) for i, b in enumerate(bodies(rng, n))]
    return [gzip.compress(p) for p in pieces] if packed else pieces


def tiled(data, found):
    """Records and gaps follow each other without holes."""
    at = 0
    for f in found:
        assert f.start == at and f.end > f.start
        at = f.end
    assert at == len(data)


@pytest.mark.parametrize("packed", [True, False])
def test_whole_archive_has_no_gap(packed):
    pieces = archive(random.Random(1), 40, packed)
    data = b"".join(pieces)
    found = list(warc.salvage(data))
    tiled(data, found)
    assert [f.headers["warc-record-id"] for f in found] == [f"<urn:page:{i}>" for i in range(40)]


@pytest.mark.parametrize("packed", [True, False])
def test_records_behind_damage_are_recovered(packed):
    rng = random.Random(2)
    for _ in range(60):
        pieces = archive(rng, 30, packed)
        hurt = set(rng.sample(range(30), 5))
        damaged = []
        for i, p in enumerate(pieces):
            if i in hurt:
                at = rng.randrange(len(p) // 4, len(p) // 2)
                kind = rng.randrange(3)
                if kind == 0:  # a byte changed
                    p = p[:at] + bytes([p[at] ^ 0x55]) + p[at + 1:]
                elif kind == 1:  # bytes lost
                    p = p[:at] + p[at + rng.randrange(1, 40):]
                else:  # bytes added
                    p = p[:at] + rng.randbytes(30) + p[at:]
            damaged.append(p)
        data = b"".join(damaged)
        found = list(warc.salvage(data))
        tiled(data, found)
        ids = {int(f.headers["warc-record-id"][10:-1]) for f in found if f.headers}
        whole = set(range(30)) - hurt
        assert whole <= ids
        starts = {sum(map(len, damaged[:i])): i for i in range(30)}
        for f in found:
            if f.reason:
                assert starts[f.start] in hurt  # a gap begins where a damaged record did


def test_garbage_truncation_and_empty_archives():
    assert list(warc.salvage(b"")) == []
    (gap,) = warc.salvage(b"no archive at all")
    assert (gap.start, gap.end, gap.reason) == (0, 17, "no member or version line")
    whole = record(1, b"x" * 50)
    first, gap = warc.salvage(whole + record(2, b"y" * 50)[:-20])
    assert first.end == len(whole) and gap.reason == "truncated record"
    member = gzip.compress(whole)
    gap, last = warc.salvage(member[:-3] + member)
    assert gap.end == len(member) - 3 and last.headers
    wrong = whole.replace(b"x" * 50, b"x" * 49 + b"z")
    assert [f.reason for f in warc.salvage(wrong)] == ["block digest differs"]
    # two records in one member, and an empty member
    got = list(warc.salvage(gzip.compress(whole + whole) + gzip.compress(b"") + member))
    assert len(got) == 3 and got[0].end == got[1].end


@pytest.fixture(scope="module")
def pages(spark):
    long = "é" * 400
    rows = [(5, "http://a/ b", long), (3, None, long), (9, "http://c\r\nX: y", long),
            (1, "u", "short"), (2, "u", "short"), (4, "u", None), (6, "u", ""), (3, "v", long),
            (None, "w", long), (None, "w", "q" * 100), (8, "WARC/1.1", "WARC/1.1\r\n" * 20),
            (10, "big", "ab" * (9 << 20))]
    return spark.createDataFrame(
        rows, "page_id long, url string, html string").withColumns(
        {"size": F.lit(1), "digest": F.lit("x"), "block": F.lit(2), "first": F.lit(3)}).repartition(3)


@pytest.mark.parametrize("packed", [True, False])
def test_pages_come_back(spark, pages, tmp_path, packed):
    path = str(tmp_path / "w")
    warc.write_archives(pages, path, compress=packed, archive_mb=1)
    got = warc.read_archives(spark, path)
    assert got.where("kind = 'gap'").isEmpty()
    rows = got.collect()
    assert len(rows) == 12
    by = {(r.record_id, r.payload_digest): r for r in rows}
    digest = lambda t: "sha256:" + hashlib.sha256(t.encode()).hexdigest()
    for i in (5, 9, None):
        r = by[None if i is None else str(i), digest("é" * 400)]
        assert (r.record_type, r.refers_to, r.payload_bytes, bytes(r.payload)) == (
            "revisit", "3", 800, b"")
    firsts = [r for r in rows if r.record_id == "3"]
    assert [r.record_type for r in firsts] == ["response"] * 2
    assert {r.target_uri for r in firsts} == {None, "v"}
    assert by["9", digest("é" * 400)].target_uri == "http://c%0D%0AX:%20y"
    for i, t in ((1, "short"), (2, "short"), (4, ""), (6, ""), (8, "WARC/1.1\r\n" * 20),
                 (10, "ab" * (9 << 20)), (None, "q" * 100)):
        r = by[None if i is None else str(i), digest(t)]
        assert (r.record_type, bytes(r.payload), r.payload_bytes) == (
            "response", t.encode(), len(t.encode()))


def test_damaged_files_through_spark(spark, tmp_path):
    path = str(tmp_path / "w")
    rows = [(i, f"http://h/{i}", f"page {i} " * 30) for i in range(200)]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1),
                        path)
    (file,) = (tmp_path / "w").glob("part-*")
    data = file.read_bytes()
    members = [f for f in warc.salvage(data)]
    lost = members[50]
    (tmp_path / "w" / "part-hurt.txt").write_bytes(
        data[:lost.start + 30] + b"?" + data[lost.start + 31:])
    file.unlink()
    got = warc.read_archives(spark, path)
    assert got.where("kind = 'record'").count() == 199
    (gap,) = warc.quarantine(spark, path).collect()
    assert (gap.start, gap.end) == (lost.start, lost.end)
    assert zlib.decompress(data[lost.start:lost.end], 31)


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archives(spark, path).isEmpty()


def test_query_against_sql(spark, sf_dir, con):
    got = QUERIES["op13_warc_salvage"](spark, sf_dir)
    want = con.execute(ORACLE["op13_warc_salvage"]).df()
    cols = list(got.columns)
    rows = lambda f: sorted(map(str, f[cols].astype(object).where(f[cols].notna(), None)
                                .itertuples(index=False, name=None)))
    frame = got.toPandas()
    frame["refers_to"] = frame["refers_to"].astype(float)
    want["refers_to"] = want["refers_to"].astype(float)
    assert rows(frame) == rows(want)
