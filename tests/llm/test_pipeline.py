"""The pipeline on rows of every kind: each stage against what it should keep."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from flightmart.llm.queries import tokenizer_path
from flightmart.llm.tokens import TextEncoder
from tests.conftest import SF_SMALL
from tests.llm.test_similarity import plain_components, plain_hits

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_in_turn(spark, docs, texts, tmp_path):
    data, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, data, SF_SMALL)
        if name != "pack":
            assert out.columns == COLUMNS
        out.write.parquet(f"{tmp_path}/{name}")
        data = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = data
    ids = lambda df: {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}
    language = ids(kept["language"])
    assert len(language) >= 0.99 * len(texts)
    unique = ids(kept["near_duplicates"])
    assert set(unique) == {i for i, (_, c) in plain_components(language, 5, 80, 100).items() if c == i}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    clean = ids(kept["decontaminate"])
    assert set(clean) == {i for i, t in unique.items() if not plain_hits(t, items)[1]}
    private = ids(kept["personal_data"])
    assert set(private) == set(clean) and not any("@example.com" in t for t in private.values())
    assert kept["personal_data"].where(F.col("n_chars") != F.char_length("text")).isEmpty()
    encoder = TextEncoder(tokenizer_path())
    pieces = {}
    for r in sorted(kept["pack"].collect(), key=lambda r: r["start"]):
        pieces.setdefault(r["doc_id"], []).append(np.frombuffer(r["ids"], "<u4"))
    for doc_id, text in private.items():
        assert np.concatenate(pieces[doc_id]).tolist() == [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 1]


def test_edges(spark, edge, none):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, edge, SF_SMALL)
        assert out.columns == edge.columns
        out.collect()
        assert stage(spark, none, SF_SMALL).collect() == []


def test_registered():
    queries = entry.queries()
    names = sorted(int(q[2:].split("_")[0]) for q in queries if q.startswith("op"))
    assert names == list(range(1, 14)) and queries["pipeline"] is corpus_pipeline.run
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
