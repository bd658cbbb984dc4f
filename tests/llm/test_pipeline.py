"""Every stage of the pipeline against brute force on a small table."""

import public_tokenizers
import pytest
import sentencepiece
from test_dedup import brute_components
from test_operators import independent_spans

import corpus_pipeline
from stemma.llm import decontaminate, queries, secret_scan

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """The rows that go into and come out of each stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, SF)
        rows = found.collect()
        out[name] = (docs.collect(), rows, found.columns)
        docs = spark.createDataFrame(rows, found.schema)
    return out


def test_stages(spark, stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "minhash_dedup", "decontaminate", "secret_scan", "sentencepiece"]
    assert all(columns == COLUMNS for n, (_, _, columns) in stages.items() if n != "sentencepiece")
    before, after, _ = stages["quality_rules"]
    verdicts = {r.doc_id: r.kept for r in queries.op1_quality_rules(spark, SF).collect()}  # equal to DuckDB's
    assert sorted(after) == sorted(r for r in before if verdicts[r.doc_id])
    before, after, _ = stages["minhash_dedup"]
    groups = brute_components([(r.doc_id, r.text) for r in before], 5)
    assert sorted(after) == sorted(r for r in before if groups[r.doc_id][1] == r.doc_id)
    before, after, _ = stages["decontaminate"]
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    found = {r.doc_id for r in decontaminate.contamination(spark.createDataFrame(before), bench).collect()}
    items = [r.text for r in bench.collect()]
    assert {r.doc_id for r in before if any(t in r.text for t in items)} <= found  # whole items are always found
    assert sorted(after) == sorted(r for r in before if r.doc_id not in found)


def test_secrets_are_replaced(stages):
    before, after, _ = stages["secret_scan"]
    new = {r.doc_id: r for r in after}
    assert len(new) == len(before)
    for r in before:
        spans = secret_scan.scan(r.text)[1]
        want, at = "", 0
        for a, k, b in sorted(spans, key=lambda x: (x[0], -x[2])):
            if a >= at:
                want += r.text[at:a] + f"[{secret_scan.KINDS[k]}]"
            at = max(at, b)
        assert new[r.doc_id].text == want + r.text[at:] and new[r.doc_id].n_chars == (len(new[r.doc_id].text) if spans else r.n_chars)
        assert not independent_spans(new[r.doc_id].text)


def test_ids(stages):
    before, after, columns = stages["sentencepiece"]
    peer = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert columns[:5] == COLUMNS and sorted(r[:5] for r in after) == sorted(tuple(r) for r in before)
    assert all(list(r.ids) == peer.encode(r.text) and r.parity and r.round_trip for r in after)


def test_run_and_empty_tables(spark, stages, tmp_path):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in stages["sentencepiece"][1])
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
