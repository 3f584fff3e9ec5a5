import collections

import plain
import pytest

import corpus_pipeline
from test_text_rewrites import plain_hits
from test_tokens import digests, tokenizer  # noqa: F401

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """The rows after each stage, each written and read again."""
    at = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == COLUMNS
        out.append(docs.collect())
    return out


def test_toxic_documents_go_and_others_stay(spark, sf_dir, stages):
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = {r.doc_id for r in stages[1]}
    assert all(tuple(r) in set(map(tuple, stages[0])) for r in stages[1])
    clean = [r.doc_id for r in stages[0] if toxic.get(r.doc_id) == 0]
    assert sum(i in kept for i in clean) >= 0.95 * len(clean)


def test_labelled_toxic_documents_go(spark, sf_dir, stages):
    toxic = [r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1").collect()]
    kept, given = ({r.doc_id for r in stages[k]} for k in (1, 0))
    toxic = [i for i in toxic if i in given]
    assert toxic and sum(i in kept for i in toxic) <= 0.2 * len(toxic)


def test_one_document_of_each_group_stays(stages):
    rows = [(r.doc_id, r.text) for r in stages[1]]
    want = {i for i, n, c in plain.similar(rows) if i == c or n == 0}
    assert {r.doc_id for r in stages[2]} == want and len(stages[2]) == len(want)


def test_contaminated_documents_go(spark, sf_dir, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    bad = {i for i, *_ in plain_hits([(r.doc_id, r.text) for r in stages[2]], items)}
    assert {r.doc_id for r in stages[3]} == {r.doc_id for r in stages[2]} - bad


def test_sources_meet_their_targets(stages):
    from test_exact_and_mix import plain_targets

    size = lambda rows: sum((collections.Counter({r.source: len(plain.words(r.text))})
                             for r in rows), collections.Counter())
    before, after = size(stages[3]), size(stages[4])
    for source, want in plain_targets(dict(before)).items():
        longest = max(len(plain.words(r.text)) for r in stages[3] if r.source == source)
        assert abs(after[source] - want) <= longest / 2 + 1e-6
    assert max(collections.Counter(r.doc_id for r in stages[4]).values()) <= 3


def test_token_files_hold_all_rows(stages, tokenizer):  # noqa: F811
    want = digests([(r.doc_id, r.text) for r in stages[4]], tokenizer)
    assert sorted(map(tuple, stages[5]), key=lambda r: r[1]) == want
