import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from trafficlens.llm import token_orc
from trafficlens.llm.queries import QUERIES, vocabulary

END = 2


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def digests(rows, tokenizer):
    out, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, END]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def read(spark, path):
    got = token_orc.token_digests(spark, path).collect()
    return sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=lambda r: r[1])


def test_positions_over_several_files_of_a_partition(spark, tokenizer, tmp_path):
    rows = [(i, "some words " * (i % 7)) for i in range(40)]
    path = str(tmp_path / "ids")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 5)
    try:
        token_orc.write_tokens(
            spark.createDataFrame(rows, "doc_id long, text string"), path, vocabulary(), files=2)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert read(spark, path) == digests(rows, tokenizer)


def test_a_full_store_changes_nothing(spark, tokenizer, tmp_path, monkeypatch):
    rows = [(i, f"w{i} x{i % 50} y{i * i}") for i in range(3000)]
    monkeypatch.setattr(token_orc, "CACHE", 60)
    path = str(tmp_path / "ids")
    token_orc.write_tokens(
        spark.createDataFrame(rows, "doc_id long, text string"), path, vocabulary(), files=1)
    assert read(spark, path) == digests(rows, tokenizer)


def test_python_gets_bounded_batches_of_long_rows(spark, tokenizer, tmp_path, monkeypatch):
    rows = [(i, f"{i} seven words of a text " * 800) for i in range(400)]  # 8 MB in one partition
    sizes, path = str(tmp_path / "sizes"), str(tmp_path / "ids")
    tokens, crc = token_orc._tokens, token_orc._crc

    def noted(run, what):
        def noting(batches):
            for b in batches:
                with open(f"{sizes}-{what}", "a") as f:
                    f.write(f"{b.nbytes}\n")
                yield b

        return lambda batches: run(noting(batches))

    monkeypatch.setattr(token_orc, "_tokens", lambda *a: noted(tokens(*a), "texts"))
    monkeypatch.setattr(token_orc, "_crc", noted(crc, "ids"))
    before = dict(spark.conf.getAll)
    token_orc.write_tokens(
        spark.createDataFrame(rows, "doc_id long, text string").repartition(1), path, vocabulary(),
        files=1)
    assert read(spark, path) == digests(rows, tokenizer)
    for what in ("texts", "ids"):
        seen = [int(x) for x in open(f"{sizes}-{what}")]
        assert len(seen) > 1 and max(seen) < 3 << 20
    assert dict(spark.conf.getAll) == before


def test_odd_texts_round_trip(spark, tokenizer, tmp_path):
    rng = random.Random(1)
    glyphs = ["a", "Bc", "é", " ", "  ", "\n", "\t", "'s", "12", ".", " ", " ", "\x85",
              "\x1c", "😀", "<|endoftext|>", "ß", "　", "x" * 50]
    rows = [(i, "".join(rng.choices(glyphs, k=rng.randrange(12)))) for i in range(400)]
    rows += [(1000, None), (1001, ""), (1002, "word " * 100_000), (None, "no id")]
    path = str(tmp_path / "ids")
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    token_orc.write_tokens(docs, path, vocabulary(), files=5)
    assert read(spark, path) == digests(rows, tokenizer)
    one = token_orc.read_tokens(spark, path).where("doc_id = 17").collect()
    assert [list(r.ids) for r in one] == [
        [*tokenizer.encode(rows[17][1], add_special_tokens=False).ids, END]]


def test_queries_give_the_ids_of_the_library(spark, tmp_path):
    import corpus_pipeline

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(1, "one two <|endoftext|> three"), (2, "<|endoftext|>"), (3, "a<|endoftext|>b c d"),
            (4, "one two three"), (5, "<|endoftext |> <|endoftext|><|endoftext|>\u00a0x"), (6, " <|end"),
            (7, None)]
    folder = str(tmp_path / "in")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{folder}/documents.parquet")
    wanted = digests(rows, plain)
    for got in (QUERIES["op10_token_orc"](spark, folder), corpus_pipeline.write_ids(spark, docs, folder)):
        assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == wanted


def test_repeated_ids_and_empty_table(spark, tokenizer, tmp_path):
    rows = [(3, "same text")] * 50 + [(2, "x")]
    path = str(tmp_path / "again")
    token_orc.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path,
                           vocabulary(), files=4)
    assert read(spark, path) == digests(rows, tokenizer)
    path = str(tmp_path / "none")
    token_orc.write_tokens(spark.createDataFrame([], "doc_id long, text string"), path, vocabulary())
    assert read(spark, path) == []


def test_bloom_filters_and_row_indexes_are_written(spark, tmp_path):
    import pyarrow.orc as orc

    path = tmp_path / "ids"
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(3000)], "doc_id long, text string")
    token_orc.write_tokens(docs, str(path), vocabulary(), files=1)
    file = orc.ORCFile(next(path.glob("part-*.orc")))
    assert file.nrows == 3000 and file.row_index_stride == 1000


def test_supplied_table(spark, sf_dir, tokenizer):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = QUERIES["op10_token_orc"](spark, sf_dir).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == digests(docs, tokenizer)
