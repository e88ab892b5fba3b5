"""The pipeline stage by stage, and this subpackage's queries against SQL."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))

import check_queries  # noqa: E402
import corpus_pipeline  # noqa: E402
from llm_fixtures import documents, nothing, texts  # noqa: E402, F401
from pyspark.sql import functions as F  # noqa: E402
from tabscope.llm import queries  # noqa: E402
from test_llm_texts import listed, plain_components, plain_fingerprint, plain_line_dedup, plain_scan  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
STAGE = {name: stage for name, stage in corpus_pipeline.STAGES}


@pytest.fixture(scope="module")
def folder(tmp_path_factory, spark, documents, texts):
    path = tmp_path_factory.mktemp("tables")
    documents.write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(texts[8].split()[5:30])), (2, None)], "item_id bigint, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path)


def key(r):
    return r["doc_id"], r["text"]


def test_stages_by_their_contracts(spark, folder, documents):
    from collections import Counter
    rows = listed(documents)
    good = STAGE["quality rules"](spark, documents, folder)
    assert Counter(map(key, listed(good))) == Counter((r["doc_id"], r["text"]) for r in listed(queries.quality_rules.judge(documents)) if r["kept"])
    lines = STAGE["line dedup"](spark, documents, folder)
    assert Counter(map(key, listed(lines))) == plain_line_dedup(rows, 10) and lines.columns == documents.columns
    single = listed(STAGE["SimHash near-dedup"](spark, documents, folder))
    roots = plain_components([plain_fingerprint(r["text"] or "") for r in rows], 4)
    assert sorted(roots[plain_fingerprint(r["text"] or "")] for r in single) == sorted(set(roots.values()))
    items = [("1", spark.read.parquet(f"{folder}/benchmark.parquet").where("item_id = 1").first()["text"])]
    clean = STAGE["benchmark decontamination"](spark, documents, folder)
    assert Counter(map(key, listed(clean))) == Counter(key(r) for r in rows if not plain_scan(r["text"] or "", items)[1])
    encoded = STAGE["SentencePiece encoding and decoding"](spark, documents, folder)
    assert Counter(map(key, listed(encoded))) == Counter(map(key, rows)) and encoded.where("size(ids) != n_pieces").count() == 0


def test_run_applies_the_stages_in_order(spark, folder, documents):
    docs = documents
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    got, want = corpus_pipeline.run(spark, folder), docs
    assert sorted(map(str, listed(got.select("doc_id", "text", "ids")))) == sorted(map(str, listed(want.select("doc_id", "text", "ids"))))
    assert 0 < got.count() < documents.count()


def test_stages_on_empty_tables_and_more_columns(spark, folder, documents, nothing):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, nothing, folder).count() == 0
        more = documents.withColumn("score", F.lit(1)).withColumn("kept", F.lit(True)).withColumn("ids", F.lit(3))
        assert stage(spark, more, folder).columns == more.columns, name
    assert STAGE["SentencePiece encoding and decoding"](spark, nothing, folder).count() == 0


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="benchmark tables are not here")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries(spark, name):
    ok, message, n = check_queries.compare(spark, check_queries.connect(FOLDER), FOLDER, name, queries.QUERIES[name], queries.ORACLES.get(name))
    assert ok and n, message
