import duckdb
import pytest

import corpus_pipeline
from test_operators import brute_components, brute_hits, brute_line_dedup

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage gets and gives."""
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return [{r.doc_id: r for r in df.collect()} for df in out], [df.columns for df in out]


def test_columns(stages):
    assert all(c == stages[1][0] for c in stages[1][:-1]) and stages[1][-1] == ["doc_id", "lang", "source", "text", "ids", "n_tokens"]


def test_toxic_documents_go(stages):
    labels = dict(duckdb.sql(f"select doc_id, toxic from '{SF}/labels.parquet'").fetchall())
    before, after = stages[0][0], stages[0][1]
    assert all(after[i].text == before[i].text for i in after)
    gone = set(before) - set(after)
    assert all(labels.get(i) != 0 for i in gone) and sum(labels.get(i) == 1 for i in gone) >= 0.7 * sum(labels[i] == 1 for i in before if i in labels)


def test_lines_go(stages):
    before, after = stages[0][1], stages[0][2]
    want = {i: t for i, (t, _, n) in brute_line_dedup([(i, r.text) for i, r in before.items()]).items() if n == 0 or t.strip(" ")}
    assert {i: r.text for i, r in after.items()} == want and all(r.n_chars == len(r.text) for r in after.values())


def test_one_near_duplicate_stays(stages):
    before, after = stages[0][2], stages[0][3]
    assert set(after) == {i for i, (_, c) in brute_components([(i, r.text) for i, r in before.items()]).items() if c == i}


def test_benchmark_passages_go(stages):
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    before, after = stages[0][3], stages[0][4]
    for i, r in before.items():
        n, hit, _ = brute_hits(r.text, items)
        assert (i in after) == (2 * hit <= n)
        if i in after:
            assert after[i].text == r.text if not hit else len(after[i].text) < len(r.text)


def test_tokens(stages):
    before, after = stages[0][4], stages[0][5]
    assert all(after[i].text == r.text and after[i].n_tokens == len(after[i].ids) for i, r in before.items())


def test_stages_take_odd_rows(spark):
    rows = [(1, "One two Three four five six"), (2, "one two three four five six"), (3, None), (4, ""), (None, "one two three four five six"), (5, "x " * 50_000), (6, "alone here"), (6, "alone here"), (6, "another text under one id")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "k", 1, "r") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, key string, body int, row string")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        kept[name] = sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect())
        assert stage(spark, docs.limit(0), SF).count() == 0
        assert out.columns == docs.columns or name.startswith("SentencePiece")
    everything = sorted((i is None, i or 0) for i, _ in rows)
    assert kept["n-gram Jaccard join"] == [(False, i) for i in (1, 3, 4, 5, 6, 6)]
    assert all(x == everything for name, x in kept.items() if name != "n-gram Jaccard join")


def test_run_is_all_stages(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == len(stages[0][5])
