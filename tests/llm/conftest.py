from __future__ import annotations

import random

import pytest

from tests.conftest import SF_SMALL

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use inside.
EXTRA = ["k1", "k2", "node", "start", "end", "kind", "spans", "words", "text_hash", "set_key", "pii_k1", "nd_id", "dc_id", "sequence_id"]


def edge_rows() -> list[tuple]:
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    base = [rnd.choice(words) for _ in range(300)]
    near = base[:150] + ["changed"] + base[151:]
    long = " ".join(rnd.choice(words) for _ in range(40_000))
    rows = [(None, "a text without an id, mail me@example.org", "en"), (None, None, None), (1, None, "en"), (2, "", "en"), (3, " \n\t ", None), (4, "x", "en"),
            (5, " ".join(base), "en"), (6, " ".join(base), "en"), (7, " ".join(near), "de"), (8, long, "en"), (9, "same row", "en"), (9, "same row", "en"), (9, "same id", "fr"),
            (10, "123 456 !!", "en"), (11, "日本語のテキスト 😀 ünï", None), (12, "a" * 30_000, "en"), (13, "token=" + "1" * 5_000 + " +" + "(" * 3_000, "en"), (14, "1 2 3 " * 3_000, None)]
    return [(i, t, g, "s", len(t) if t is not None else None) for i, t, g in rows]


@pytest.fixture(scope="session")
def edge(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(edge_rows(), DOCS)
    return df.withColumns({c: F.lit("clash") for c in EXTRA}).repartition(3)


@pytest.fixture(scope="session")
def none(edge):
    return edge.where("false")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
