"""Fingerprints, near duplicates and decontamination against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from flightmart.llm import decontam, fingerprint, neardup
from flightmart.llm.queries import ORACLES, op1_order_minhash, op3_benchmark_windows, op9_near_duplicates
from tests.conftest import SF_SMALL

LOWER = {i: i + 32 for i in range(65, 91)}


def plain_next(rows):
    """rows: distinct (doc_id, text) in the order of the operator."""
    out = []
    for i, (doc_id, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1] or ""
        text = text or ""
        m = len(text) // 3
        out.append((doc_id, len(text), hashlib.sha256((text[:len(text) - m] + following[:m]).encode()).hexdigest()))
    return out


def test_fingerprint_query(spark, texts):
    rows = op1_order_minhash(spark, SF_SMALL).collect()
    want = plain_next(sorted(texts.items(), reverse=True))
    assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows) == sorted(want)
    by_text = defaultdict(set)
    for r in rows:
        by_text[texts[r["doc_id"]]].add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert all(len(p) == 1 for p in by_text.values())
    assert np.mean([r["near_edited"] for r in rows]) > np.mean([r["near_next"] for r in rows]) + 0.1


def test_fingerprint_edges(edge, none):
    rows = fingerprint.with_next(edge).collect()
    assert len(rows) == edge.count()
    digests = Counter((r["doc_id"], r["edited_sha256"]) for r in rows)
    assert digests[9, rows[0]["edited_sha256"]] <= 2 and sum(r["doc_id"] == 9 for r in rows) == 3
    twice = [r for r in rows if r["doc_id"] == 9 and r["n_chars"] == 8]
    assert len(twice) == 2 and twice[0] == twice[1]
    last = next(r for r in rows if r["doc_id"] == 14)  # the highest id
    text = "1 2 3 " * 3_000
    following = "token=" + "1" * 5_000 + " +" + "(" * 3_000
    m = len(text) // 3
    assert last["edited_sha256"] == hashlib.sha256((text[:len(text) - m] + following[:m]).encode()).hexdigest()
    assert fingerprint.with_next(none).collect() == []
    one = fingerprint.with_next(edge.where("doc_id = 5")).first()
    assert one["near_next"] == 1.0


def test_fingerprints_follow_order_and_repeats(spark):
    rnd = random.Random(1)
    base = [f"w{rnd.randint(0, 5000)}" for _ in range(600)]
    half = base[300:] + base[:300]
    rows = {"base": base, "near": base[:300] + ["x"] + base[301:], "moved": half, "other": [f"v{i}" for i in range(600)], "twice": base * 2}
    df = spark.createDataFrame([(k, " ".join(v)) for k, v in rows.items()], "name string, text string").select("name", fingerprint.order_minhash(F.col("text")).alias("f"))
    f = {r["name"]: r["f"] for r in df.collect()}
    near = lambda a, b: sum(f[a][i:i + 4] == f[b][i:i + 4] for i in range(0, 256, 4)) / 64
    assert near("base", "near") > 0.85
    assert 0.2 < near("base", "moved") < 0.85  # the same runs of words in another order
    assert near("base", "other") < 0.1 and near("base", "twice") < 0.8


def sets(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def plain_components(texts, k, numerator, denominator):
    """texts: {doc_id: text}."""
    shingles = {i: sets(t, k) for i, t in texts.items()}
    holders = defaultdict(list)
    for i, s in shingles.items():
        for x in s:
            holders[x].append(i)
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    both = Counter((a, b) for ids in holders.values() for n, b in enumerate(ids) for a in ids[:n])
    for (a, b), c in both.items():
        if denominator * c >= numerator * (len(shingles[a]) + len(shingles[b]) - c):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(shingles[i]), find(i)) for i in texts}


def test_near_duplicate_query(spark, texts):
    want = plain_components(texts, 3, 85, 100)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op9_near_duplicates(spark, SF_SMALL).collect()}
    assert got == want


@pytest.mark.parametrize("block", [2048, 16])
def test_near_duplicate_family(spark, monkeypatch, block):
    """A family of edits, many around the threshold; with small blocks large buckets meet part by part."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    rnd = random.Random(7)
    base = [f"w{rnd.randint(0, 2000)}" for _ in range(120)]
    family = {}
    for i in range(130):
        words = list(base)
        for _ in range(rnd.choice([0, 1, 2, 3, 4, 6])):
            words[rnd.randrange(len(words))] = f"n{rnd.randint(0, 10**6)}"
        family[1000 - i] = " ".join(words)
    df = spark.createDataFrame(list(family.items()), "doc_id long, text string").repartition(4)
    want = {i: c for i, (_, c) in plain_components(family, 3, 85, 100).items()}
    got = {r["doc_id"]: r["component_id"] for r in neardup.components(df, 3, 85, 100).collect()}
    assert got == want


def roots(nodes, links):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in nodes}


def test_block_links_join_whole_components(spark):
    """Two stars joined through satellites, and chains of stars joined end to end in no order."""
    rnd = random.Random(11)
    first, second = [(0, 1), (2, 3), (2, 4)], [(1, 3)]
    ids = rnd.sample(range(5, 1000), 160)
    for hub in range(0, 160, 4):
        first += [(ids[hub], ids[hub + i]) for i in (1, 2, 3)]
        if hub:
            second.append((ids[hub - 1], ids[hub + 1]))
    nodes = sorted({x for pair in first for x in pair})
    labels = spark.createDataFrame(list(roots(nodes, first).items()), "node long, label long")
    got = {r["node"]: r["label"] for r in neardup._merge(labels, spark.createDataFrame(second, "a long, b long")).collect()}
    assert got == roots(nodes, first + second)


def test_near_duplicate_edges(edge, none):
    rows = neardup.components(edge, 5, 80, 100).collect()
    assert len(rows) == edge.count()
    of = {r["doc_id"]: r["component_id"] for r in rows if r["doc_id"] not in (None, 9)}
    assert of[5] == of[6] == of[7] == 5 and of[1] == 1 and of[2] == 2 and of[3] == 3 and of[4] == 4 and of[8] == 8
    assert all(r["n_shingles"] == 0 for r in rows if r["doc_id"] in (1, 2, 3))
    kept = neardup.first_of_components(edge)
    assert kept.columns == edge.columns
    ids = Counter(r["doc_id"] for r in kept.select("doc_id").collect())
    assert ids[5] == 1 and not ids[6] and not ids[7] and ids[1] == ids[2] == ids[3] == 1 and ids[None] == 2 and ids[9] == 2  # "same row" once, "same id"
    assert neardup.components(none).collect() == [] and neardup.first_of_components(none).collect() == []


def test_estimate_is_unbiased():
    rnd = np.random.default_rng(3)
    for share in (0.5, 0.8, 0.95):
        common = rnd.integers(0, 2**63, 4000, dtype=np.uint64)
        n = int(4000 * (1 - share) / share / 2)
        a, b = (np.unique(np.concatenate([common, rnd.integers(0, 2**63, n, dtype=np.uint64)])) for _ in range(2))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        equal = int(neardup._equal(neardup._words([neardup.sketch(a)[0]]), neardup._words([neardup.sketch(b)[0]]))[0])
        chance = 2.0 ** -neardup.BITS
        assert abs((equal / neardup.HASHES - chance) / (1 - chance) - true) < 0.16


def doc_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain_hits(text, items, window=10):
    words = doc_words(text)
    hit, found = set(), set()
    for item_id, item in items:
        w = doc_words(item)
        n = min(window, len(w))
        if not n:
            continue
        wanted = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}
        for i in range(len(words) - n + 1):
            if tuple(words[i:i + n]) in wanted:
                hit.update(range(i, i + n))
                found.add(str(item_id))
    return len(words), len(hit), sorted(found)


ITEMS = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "One Two, three"), (3, "ÉCOLE école"), (4, None), (5, "!!"), (6, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (7, "w1"), (None, "two three")]


@pytest.mark.parametrize("broadcast_rows", [1_000_000, 0])
def test_decontamination_edges(spark, edge, none, broadcast_rows):
    item = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("words", F.lit("clash"))
    extra = spark.createDataFrame([(50, "x alpha beta gamma delta epsilon zeta eta theta iota kappa y"), (51, "ALPHA beta-gamma delta epsilon zeta eta theta iota kappa lambda mu alpha beta"), (52, "one two three one two three"), (53, "École ÉCOLE école")], "doc_id long, text string")
    table = edge.unionByName(extra, allowMissingColumns=True)
    got = decontam.contamination(table, item, broadcast_rows=broadcast_rows)
    wanted = Counter()
    for r in table.select("doc_id", "text").collect():
        n, hit, found = plain_hits(r["text"], ITEMS)
        wanted[r["doc_id"], n, hit, tuple(x for x in found if x != "None")] += 1
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got.collect()) == wanted
    clean = decontam.clean_rows(table, item, broadcast_rows=broadcast_rows)
    assert clean.columns == table.columns
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(d) for (d, _, hit, _), k in wanted.items() for _ in range(k) if not hit)
    assert decontam.contamination(none, item).collect() == []
    nothing = decontam.contamination(table, item.where("false")).collect()
    assert len(nothing) == table.count() and not any(r["n_hit"] for r in nothing)


def test_partial_containment(spark):
    item = spark.createDataFrame([(1, " ".join(f"t{i}" for i in range(10)))], "item_id long, text string")
    words = [f"t{i}" for i in range(10)]
    rows = [(1, " ".join(["a", *words, "b"])), (2, " ".join(["a", *words[:9], "x"])), (3, " ".join(["a", *words[:7], "x", "y", "z"])), (4, "a b c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    # six shingles of five words: the second row holds five of them, the third three
    got = lambda t: {r["doc_id"] for r in decontam.contamination(df, item, threshold=t).where("n_hit > 0").collect()}
    assert got(1.0) == {1} and got(0.8) == {1, 2} and got(0.5) == {1, 2, 3}


def test_decontamination_query_and_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    rel = con.sql(ORACLES["op3_benchmark_windows"])
    df = op3_benchmark_windows(spark, SF_SMALL).select(*rel.columns)
    assert sorted(map(tuple, df.collect())) == sorted(rel.fetchall())
