import hashlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer as Library

import corpus_pipeline
from test_resemblance import plain_groups
from lexforge.llm import mixing, quality, toxicity
from lexforge.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


def test_stages_take_effect_and_match_plain_python(spark):
    """Each stage on its predecessor's rows, against a plain version of it."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    now = docs
    frames = {}
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, now, SF)
        now = spark.createDataFrame(made.collect(), made.schema)
        frames[name] = now
    assert all(frames[n].columns == corpus_pipeline.COLUMNS for n in ("toxicity", "quality", "near_duplicates", "mixing"))

    rows = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    model = toxicity.train(docs, labels)
    assert set(rows(frames["toxicity"])) == {d for d, t in rows(docs).items() if model.score(toxicity.buckets(t)) < 0.3}

    kept = quality.resampled(frames["toxicity"], labels).filter("kept")
    assert set(rows(frames["quality"])) == {r["doc_id"] for r in kept.collect()}

    left = sorted(rows(frames["quality"]).items())
    assert set(rows(frames["near_duplicates"])) == {d for d, c in plain_groups(left).items() if c == d}

    want = mixing.mixed(frames["near_duplicates"]).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in frames["mixing"].groupBy("doc_id").count().collect()} == {r["doc_id"]: r["count"] for r in want}

    library = Library.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    texts = rows(frames["mixing"])
    last = frames["tokens"].collect()
    assert len(last) == frames["mixing"].count()
    for r in last:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["token_ids"] == ids and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_run_equals_the_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids"] and out.count() > 50
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_take_odd_rows_and_empty_tables(spark, odd_docs, no_docs):
    """Nulls in any column, empty and long texts, repeated rows, clashing columns."""
    for docs in (odd_docs, no_docs):
        now = docs
        for name, stage in corpus_pipeline.STAGES:
            made = stage(spark, now, SF)
            now = spark.createDataFrame(made.collect(), made.schema)
            assert name == "tokens" or now.columns == corpus_pipeline.COLUMNS
    assert now.count() == 0


def test_every_operator_has_one_query():
    names = list(queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13 and "pipeline" in names
    assert set(oracle_sql()) <= set(names)
