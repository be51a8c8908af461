"""The pipeline's stages on a small corpus, each judged on its own input."""

from __future__ import annotations

import re
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from emberlog.llm import mixing, secrets_crf, simhash, toxicity
from emberlog.llm.common import count_words

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Name to (input, output), each stored."""
    folder, found = tmp_path_factory.mktemp("stages"), {}
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({"target": F.lit("x"), "copies": F.lit(3)})
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        found[name] = docs, spark.read.parquet(f"{folder}/{name}")
        docs = found[name][1]
    return found


def test_columns_stay(stages):
    names = list(stages)
    for name in names[:-1]:
        assert stages[name][0].dtypes == stages[name][1].dtypes


def test_toxicity_stage(spark, stages):
    docs, out = stages["toxicity"]
    scored = {r.doc_id: r.predicted for r in toxicity.judge(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert sorted(r.doc_id for r in out.select("doc_id").collect()) == sorted(d for d, p in scored.items() if not p)


def test_dedup_stage(stages):
    docs, out = stages["near_dedup"]
    rows = [(r.doc_id, simhash.fingerprint(r.text)) for r in docs.select("doc_id", "text").collect()]
    kept = Counter(r.doc_id for r in out.select("doc_id").collect())
    groups: list[set[int]] = []
    for doc, fp in rows:
        near = [g for g in groups if any((fp ^ f).bit_count() <= 3 for _, f in g)]
        for g in near:
            groups.remove(g)
        groups.append({(doc, fp)}.union(*near))
    assert kept == Counter(min(d for d, _ in g) for g in groups)


def test_secret_stage(stages):
    docs, out = stages["secrets"]
    before = {r.doc_id: r.text for r in docs.collect()}
    field = secrets_crf.train(docs)
    tokens, masked = secrets_crf.Tokens(), 0
    for r in out.collect():
        expected = secrets_crf.mask(before[r.doc_id], secrets_crf.all_spans(before[r.doc_id], tokens, field)[1])
        assert r.text == expected and (r.text == before[r.doc_id] or r.n_chars == len(r.text))
        assert not secrets_crf.base_spans(r.text)
        masked += r.text != before[r.doc_id]
    assert masked and out.count() == docs.count()


def test_mixing_stage(stages):
    docs, out = stages["mixing"]
    expected = Counter()
    for r in mixing.mix(docs.select("doc_id", "source", count_words(F.col("text")).alias("size"))).collect():
        expected[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in out.select("doc_id").collect()) == +expected


def test_packing_stage(stages):
    docs, out = stages["packing"]
    rows = out.collect()
    assert Counter(r.doc_id for r in rows if r.piece == 0) == Counter(r.doc_id for r in docs.select("doc_id").collect())
    fill = Counter()
    for r in rows:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048 and len(fill) <= 1.03 * sum(fill.values()) / 2048 + 1


def test_stages_take_awkward_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, size long, __word string"
    rows = [(None, None, None, None, None, 1, "w"), (1, "", "en", "a", 0, 1, "w"), (2, "password=abcdefgh12 x", None, None, None, 1, "w"), (2, "password=abcdefgh12 x", None, None, None, 1, "w"), (3, "y " * 9000, "en", "a", 18_000, 1, "w")]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            out.count()
            if name != "packing":
                assert out.columns == docs.columns


def test_run_matches_stages(spark, stages):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() == stages["packing"][1].count() and re.fullmatch("[a-z_]+", STAGE_NAMES[0])


STAGE_NAMES = [n for n, _ in corpus_pipeline.STAGES]
