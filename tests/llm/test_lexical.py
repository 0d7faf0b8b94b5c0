"""Spelling variants, ranked search and repeated passages against plain versions."""

from __future__ import annotations

import glob
import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flightmart.llm import induce, ranked, repeats, variants
from flightmart.llm.queries import op11_spelling_variants, op12_ranked_search, op13_repeated_passages
from tests.conftest import SF_SMALL
from tests.llm.conftest import DOCS

_ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---------------------------------------------------------------- spelling variants

def plain_counts(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(_ASCII)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def plain_near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def plain_variants(counts, factor=10):
    near = {w: [x for x in counts if plain_near(w, x)] for w in counts}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= factor * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None)
    return out


def rows_of(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_variants_of_documents(spark, texts):
    counts = plain_counts(texts.items())
    found = op11_spelling_variants(spark, SF_SMALL)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = rows_of(found)
    assert {w: (r[2]) for w, r in got.items()} == counts
    some = sorted(counts)[::max(1, len(counts) // 1500)]
    for w in some:
        near = [x for x in counts if abs(len(x) - len(w)) <= 1 and plain_near(w, x)]
        assert got[w][3] == len(near), w
    for w, (form, root, n, _, form_n) in got.items():
        assert form is None and root == w and form_n is None or form_n == counts[form] >= 10 * n and got[form][1] == root and plain_near(w, form)


@pytest.mark.parametrize("node_words", [3, 40, 20_000])
def test_variants_of_close_words(spark, node_words):
    """Small subtries, anagrams, runs of one letter, accents and long words; chains of forms."""
    rnd = random.Random(node_words)
    words = {"".join(rnd.choice("abc") for _ in range(rnd.randint(7, 9))) for _ in range(250)}
    words |= {"".join(rnd.sample("abcdefgh", 8)) for _ in range(60)} | {"a" * k for k in range(7, 60)} | {"é" * k + "bcdefgh" for k in range(5)}
    words |= {"x" * 60 + c for c in "abc"} | {"x" * 61, "x" * 59 + "bxx"}
    counts = {w: rnd.choice([2, 3, 25, 300, 4000, 50_000]) for w in words}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert rows_of(variants.grouped(df, node_words=node_words)) == plain_variants(counts)


def test_variants_of_edge_rows(spark, edge, none):
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    got = rows_of(variants.variants(edge, min_length=7))
    assert {w: r[2] for w, r in got.items()} == plain_counts(rows)
    assert rows_of(variants.variants(none)) == {}
    accents = spark.createDataFrame([(1, "ÀÉÎõü× ÀÉÎõü× Wörter× WÖRTER×", None, None, None), (2, "ÀÉÎõü×k", None, None, None)], DOCS)
    rows = [(r["doc_id"], r["text"]) for r in accents.collect()]
    assert {w: r[2] for w, r in rows_of(variants.variants(accents)).items()} == plain_counts(rows)


@settings(max_examples=200, deadline=None)
@given(st.text("ab", min_size=1, max_size=6), st.text("ab", min_size=1, max_size=6))
def test_near(a, b):
    assert variants.near(a.encode(), b.encode()) == plain_near(a, b)


# ---------------------------------------------------------------- ranked search

def plain_search(docs, items, k=10):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    words = [(i, Counter(term.findall((t or "").translate(_ASCII)))) for i, t in docs]
    words = [(i, c) for i, c in words if c]
    n, total = len(words), sum(c.total() for _, c in words)
    df = Counter(t for _, c in words for t in c)
    out = []
    for item, text in items:
        asked = Counter(term.findall((text or "").translate(_ASCII)))
        scores = []
        for i, c in words:
            m = 100 - 75 + 75 * c.total() * n // total
            score = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, q in asked.items() if c[t])
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, rank + 1, None if null else i, -s) for rank, (s, null, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def found_rows(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=repr)


def test_search_of_documents(spark, texts):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    found = op12_ranked_search(spark, SF_SMALL)
    assert dict(found.dtypes)["rank"] == "int"
    assert found_rows(found) == plain_search(texts.items(), items)


def test_search_of_edge_rows(spark, edge, none, monkeypatch):
    """Nulls, repeats, ties, clashing names; small shards, few splits at a time and several blocks of items."""
    monkeypatch.setattr(ranked, "SPLITS", 2)
    monkeypatch.setattr(ranked, "SHARD_DOCS", 4)
    items = spark.createDataFrame([(1, "Same row W1 w2 same", "x"), (2, "", "x"), (3, None, "x"), (None, "w3 w4 w5", "x"), (1, "Same row W1 w2 same", "x"), (5, "nowhere", "x")], "item_id long, text string, rank string")
    docs = [(r["doc_id"], r["text"]) for r in edge.collect()] + [(70 + i, f"w1 w{i % 3} filler") for i in range(40)]
    more = edge.select("doc_id", "text", F.lit("clash").alias("rank"), F.lit("clash").alias("item_id")).unionByName(
        spark.createDataFrame([(i, t, "clash", "clash") for i, t in docs[-40:]], "doc_id long, text string, rank string, item_id string"))
    plain = plain_search(docs, [(r["item_id"], r["text"]) for r in items.collect()])
    for block in (1, 200_000):
        assert found_rows(ranked.search(more, items, block_terms=block)) == plain
    assert found_rows(ranked.search(none, items)) == []
    assert found_rows(ranked.search(more, items.where("false"))) == []


def test_range_maxima():
    rnd = np.random.default_rng(4)
    lengths = rnd.integers(1, 40, 12)
    starts = np.concatenate(([0], np.cumsum(lengths)))
    values = rnd.integers(0, 9, starts[-1])
    table = ranked.RangeMaxima(values, starts)
    asked = [(k, lo, hi) for k in range(12) for lo in range(starts[k], starts[k + 1]) for hi in range(lo + 1, starts[k + 1] + 1)]
    lists, lo, hi = (np.array(x) for x in zip(*asked, strict=True))
    assert table.argmax(lists, lo, hi).tolist() == [a + int(values[a:b].argmax()) for _, a, b in asked]


# ---------------------------------------------------------------- repeated passages

def plain_repeats(docs, length=50):
    """(doc_id, bytes, spans, bytes that stay) of each row."""
    rows = [(float("inf") if i is None else i, i, (t or "").encode()) for i, t in docs]
    least: dict[bytes, float] = {}
    for order, _, data in rows:
        for at in range(len(data) - length + 1):
            s = data[at:at + length]
            least[s] = min(order, least.get(s, order))
    out = []
    for order, doc_id, data in rows:
        gone = bytearray(len(data))
        for at in range(len(data) - length + 1):
            if least[data[at:at + length]] < order:
                gone[at:at + length] = b"\1" * length
        spans = [[m.start(), m.end()] for m in re.finditer(b"\1+", bytes(gone))]
        out.append((doc_id, len(data), spans, bytes(b for b, g in zip(data, gone) if not g)))
    return sorted(out, key=repr)


def repeat_rows(df):
    return sorted(((r["doc_id"], r["n_bytes"], [[s["start"], s["end"]] for s in r["spans"]], bytes(r["kept"])) for r in df.collect()), key=repr)


def test_repeats_of_documents(spark, texts):
    plain = {r[0]: r for r in plain_repeats(texts.items())}
    got = {r["doc_id"]: r for r in op13_repeated_passages(spark, SF_SMALL).collect()}
    assert got.keys() == plain.keys()
    for i, n, spans, kept in plain.values():
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (n, n - len(kept), len(spans), hashlib.sha256(kept).hexdigest())


def test_repeats_of_edge_rows(spark, edge, none):
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    assert repeat_rows(repeats.without_repeats(edge)) == plain_repeats(rows)
    assert repeat_rows(repeats.without_repeats(none)) == []


@pytest.mark.parametrize("memory", [40, 3000])
def test_repeats_larger_than_memory(spark, memory, monkeypatch):
    """Shards, queues and arrays far above what a task may hold; runs of one byte, texts in pieces, hot passages."""
    monkeypatch.setattr(repeats, "PIECE", 100)
    monkeypatch.setattr(repeats, "PACK", 250)
    rnd = random.Random(memory)
    line = "".join(rnd.choice("abcdefg ") for _ in range(70))
    docs = [(rnd.randint(0, 30), "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 60))) + line[:rnd.randint(40, 70)] + rnd.choice(["-" * 90, "é" * 40, "", "q" * 55]) + str(i)) for i in range(40)]
    docs += [(None, line), (3, line * 3), (50, line * 2)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    assert repeat_rows(repeats.without_repeats(df, shard_bytes=4000, memory=memory, part_bytes=3000)) == plain_repeats(docs)
    left = glob.glob(f"{spark.sparkContext.getCheckpointDir().removeprefix('file:')}/**/llm-repeats-*/*", recursive=True)
    assert not left  # a queue's files go with its task


@pytest.mark.parametrize("rows", [2, 5, 60, 100_000])
def test_induced_order_and_common_prefixes(tmp_path, rows):
    rnd = random.Random(rows)
    for turn in range(12 if rows < 10 else 60):
        text = bytes(rnd.randint(1, rnd.choice([1, 2, 3, 20])) for _ in range(rnd.randint(1, 90)))
        text += text[:len(text) // 2] + text[:1] * rnd.choice([0, 0, 12])
        cap = rnd.choice([3, 8, 50])
        with induce.Store(str(tmp_path), rows) as store:
            spool = induce.Spool(store, np.uint8)
            spool.append(np.frombuffer(text, np.uint8))
            order, common = induce.sort(spool.close(), 254, cap, store)
            order, common = (np.concatenate(list(x.blocks())).tolist() for x in (order, common))
            assert len(text) <= 2 * rows or store.spilled
        assert sorted(order) == list(range(len(text)))
        suffixes = [text[i:i + cap] for i in order]
        assert suffixes == sorted(suffixes, reverse=True)
        for k in range(1, len(order)):
            same = 0
            while text[order[k - 1] + same:order[k - 1] + same + 1] == text[order[k] + same:order[k] + same + 1] != b"" and same < cap:
                same += 1
            assert common[k] == same
    assert not list(tmp_path.iterdir())


def test_anchors_of_equal_windows_are_equal():
    rnd = np.random.default_rng(1)
    data = rnd.integers(97, 100, 4000).astype(np.uint8)
    data[2500:2700] = data[100:300]
    hashes = repeats.gram_hashes(data, repeats.ANCHOR)
    place = repeats.anchors(hashes, 50 - repeats.ANCHOR + 1)
    assert len(place) == len(data) - 49
    at = np.arange(151)
    assert ((place[100 + at] - 100) == (place[2500 + at] - 2500)).all()
    assert all(hashes[p] == hashes[s:s + 35][(hashes[s:s + 35] >> np.uint64(27)).argmin()] for s, p in enumerate(place.tolist()))


def test_packing_of_segments_holds_little_more_than_their_texts():
    """A task's peak follows the bytes of its texts, however few shards there are: places of bytes are not held for all of them."""
    rnd = np.random.default_rng(3)
    size = 2_000_000
    texts = [bytes(rnd.integers(97, 123, size // 20).astype(np.uint8)) for _ in range(20)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(20), pa.int64()), pa.array(range(20), pa.int64()), pa.array(texts, pa.binary())], names=["ord", "key", "text"])
    tracemalloc.start()
    try:
        found = list(repeats._segments(1, 50)(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 40 * size  # it was 70 times with all places held
    payload = repeats._Segments.unpacked(found[0].column("payload")[0].as_buffer())
    sizes = payload.windows.astype(np.int64) + 49
    begin = np.cumsum(sizes) - sizes
    for k in rnd.integers(0, len(payload.doc), 50):
        at, n = int(payload.start[k]), int(payload.windows[k]) + 49
        assert payload.text[int(begin[k]):int(begin[k]) + n].tobytes() == texts[payload.key[payload.doc[k]]][at:at + n]
