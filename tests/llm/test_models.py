"""Language id by held-out accuracy; class scores and URL scores against plain versions."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from flightmart.llm import brown, langid, url_filter
from flightmart.llm.queries import URL_RULES, op6_class_scores, op8_url_verdicts, op10_language_id
from tests.conftest import SF_SMALL

SF = "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = op10_language_id(spark, SF).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.98 * len(held)
    assert sum(r["accepted"] for r in rows) >= 0.99 * len(rows) and all(0 <= r["score"] <= 1 for r in rows)


def test_language_edges(edge, none):
    model = langid.fit(edge, F.lit(True))
    rows = langid.predict(edge, model).collect()
    assert len(rows) == edge.count()
    und = {r["doc_id"] for r in rows if r["lang_pred"] == "und"}
    assert {1, 2, 3, 10, 14} <= und and not und & {4, 5, 8, 11}
    kept = langid.accepted_rows(edge, model)
    assert kept.columns == edge.columns and kept.where("text IS NULL OR text = ''").isEmpty()
    empty = langid.fit(none, F.lit(True))
    assert {r["lang_pred"] for r in langid.predict(edge, empty).collect()} == {"und"}
    assert langid.predict(none, model).collect() == []


def test_language_rejects_what_was_not_learned(spark):
    """Unlearned scripts and languages and random letters go; held-out texts stay, with numbers and signs between too."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(docs, F.col("doc_id") % 2 == 0)
    rnd = np.random.default_rng(3)
    unknown = ["Все люди рождаются свободными и равными в своем достоинстве и правах.", "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι.",
               "すべての人間は、生れながらにして自由であり、かつ、尊厳と権利とについて平等である。", "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw."]
    unknown += ["".join(rnd.choice(list("abcdefghijklmnopqrstuvwxyz     "), n)) for n in (60, 100, 300, 1000) for _ in range(25)]
    rows = langid.predict(spark.createDataFrame(list(enumerate(unknown)), "doc_id long, text string"), model).collect()
    assert len(rows) == len(unknown) and not any(r["accepted"] for r in rows)
    held = docs.where("doc_id % 2 = 1")
    kept = langid.predict(held, model)
    assert kept.where("accepted").count() >= 0.99 * held.count()
    signs = held.withColumn("text", F.concat(F.lit("41.244.73.125 4439606983854503 &&& "), "text", F.lit(" +1 (807) 555-5623 %%%")))
    assert langid.predict(signs, model).where("accepted").count() == kept.where("accepted").count()


def test_features_do_not_depend_on_pieces(monkeypatch):
    text = "The quick brown fox, über alles. " * 40
    whole = langid.features(text)
    monkeypatch.setattr(langid, "_PIECE", 7)
    assert (langid.features(text) == whole).all()


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)})), None]


def test_class_scores(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    counts = Counter(w for i, t in texts.items() if not held[i] for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    base = score = 0.0
    for r in op6_class_scores(spark, SF).collect():
        words = tokens(texts[r["doc_id"]])
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(words), sum(w in counts for w in words), n)
        want = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        assert math.isclose(r["base_score"], want, rel_tol=1e-9)
        if r["held_out"]:
            base, score = base + r["base_score"], score + r["score"]
    assert score > base  # the classes predict unseen text better than single words


def test_class_score_edges(edge, none):
    rows = brown.scores(edge, F.coalesce(F.col("doc_id") == 4, F.lit(True))).collect()
    assert len(rows) == edge.count() and all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in rows)
    assert all(r["n_tokens"] == 1 for r in rows if r["doc_id"] in (1, 2, 3))
    nothing = brown.scores(edge, F.lit(True)).collect()  # no training texts
    assert {r["train_tokens"] for r in nothing} == {0} and {r["n_known"] for r in nothing} == {0}
    assert brown.scores(none, F.lit(False)).collect() == []


def test_class_scores_by_plain_model(docs):
    """Every word seen twice has a class; rarer words stand where their neighbours' classes put them; scores follow from the classes."""
    k, add, mix = 6, brown.ADD, brown.CLASS_MIX
    held = F.col("doc_id") % 4 == 0
    found = brown.cluster(docs, held, head_size=400, core=40, classes=k)
    texts = [(r["doc_id"], [w.encode() if w is not None else b"" for w in tokens(r["text"])]) for r in docs.select("doc_id", "text").collect()]
    train = [t for i, t in texts if i % 4]
    counts = Counter(w for t in train for w in t)
    head = dict(zip(found.head.words, found.of.tolist(), strict=False))
    rarer = {bytes(r["word"]): r["class"] for r in found.rarer.collect()}
    assert 300 < len(head) <= 401 and not head.keys() & rarer.keys() and all(counts[w] == n for w, n in zip(found.head.words, found.head.counts, strict=True))
    assert head.keys() | rarer.keys() == {w for w, n in counts.items() if n > 1} and max(*head.values(), *rarer.values()) < k

    def table_of(of):
        table = np.zeros((k + 1, k + 1))
        for t in train:
            for a, b in zip([b"", *t], t, strict=False):
                table[of(a), of(b)] += 1
        return table

    by_head = table_of(lambda w: head.get(w, k))
    gain = np.log(by_head + add) - np.log(by_head.sum(1) + add)[:, None] - np.log(by_head.sum(0) + add)[None, :]
    worth = {w: np.zeros(k) for w in rarer}
    for t in train:
        for a, w, b in zip([b"", *t], t, [*t[1:], None], strict=False):
            if w in rarer:
                worth[w] += gain[head.get(a, k), :k] + gain[:k, head.get(b, k)]
    assert all(worth[w][c] >= worth[w].max() - 1e-9 for w, c in rarer.items())

    def of(w):
        return head.get(w, rarer.get(w, k))

    table = table_of(of)
    count, different = table.sum(0), np.bincount([of(w) for w in counts], minlength=k + 1)
    share = (count + add) / (count.sum() + add * (k + 1))
    plain = {}
    for i, t in texts:
        total = 0.0
        for a, w in zip([b"", *t], t, strict=False):
            c = of(w)
            total += math.log10((table[of(a), c] + mix * share[c]) / (table[of(a)].sum() + mix)) + math.log10((counts[w] + add) / (count[c] + add * (different[c] + 1)))
        plain[i] = total
    for r in brown.scores(docs, held, head_size=400, core=40, classes=k).collect():
        assert math.isclose(r["score"], plain[r["doc_id"]], rel_tol=1e-9)


def test_batches_raise_the_likelihood(docs):
    found = brown.cluster(docs, F.lit(False), head_size=400, core=40, classes=6)
    symbols = np.minimum(np.arange(len(found.of)), 40)
    start = np.full(len(found.of), 6)
    start[:40] = brown.exchange(brown._pair_table(found.coded, symbols, 41), 40, 6)[:40]
    first, last = (brown.likelihood(brown._pair_table(found.coded, of, 7)) for of in (start, found.of))
    assert last > first
    with pytest.raises(ValueError):
        brown.cluster(docs, F.lit(False), classes=128)


def test_rare_words_are_joined_alike(docs):
    """With a tiny head nearly all words go the shuffled way; known counts and base scores stay the same."""
    held = F.col("doc_id") % 5 == 0
    want = {r["doc_id"]: r for r in brown.scores(docs, held).collect()}
    for r in brown.scores(docs, held, head_size=64, core=16, classes=4).collect():
        assert r["n_known"] == want[r["doc_id"]]["n_known"] and math.isclose(r["base_score"], want[r["doc_id"]]["base_score"], rel_tol=1e-9)


def test_exchange_finds_classes():
    # two kinds of words that always alternate
    rnd = np.random.default_rng(0)
    table = np.zeros((13, 13))
    for _ in range(4000):
        a, b = rnd.integers(0, 6), rnd.integers(6, 12)
        table[a, b] += 1
        table[b, a] += 1
    of = brown.exchange(table, 12, 2)
    assert len(set(of[:6])) == 1 and len(set(of[6:12])) == 1 and of[0] != of[6] and of[12] == 2

    def likelihood(of):
        k = of.max() + 1
        t = np.zeros((k, k))
        np.add.at(t, (of[:, None], of[None, :]), table)
        weight = np.bincount(of, weights=table.sum(0) + table.sum(1), minlength=k)
        return brown._xlogx(t).sum() - brown._xlogx(weight).sum()

    start = np.concatenate([np.arange(12) % 2, [2]])
    assert likelihood(of) > likelihood(start)


def test_exchange_goes_on_until_no_move_helps():
    rnd = np.random.default_rng(4)
    core, classes = 300, 12
    table = np.floor(rnd.pareto(1.0, (core + 2, core + 2))).clip(0, 500)

    def likelihood(of):
        t = np.zeros((classes + 2, classes + 2))
        np.add.at(t, (of[:, None], of[None, :]), table)
        return brown._xlogx(t).sum() - brown._xlogx(np.bincount(of, weights=table.sum(0) + table.sum(1), minlength=classes + 2)).sum()

    of = brown.exchange(table, core, classes)
    best = likelihood(of)
    for w in range(core):
        for c in range(classes):
            moved = of.copy()
            moved[w] = c
            assert likelihood(moved) <= best + 1e-6


def host_path(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest).group()
    return host.translate({i: i + 32 for i in range(65, 91)}), re.match("[^?#]*", rest[len(host):]).group()


def plain_rule(host, path):
    best = None
    for action, h, p in URL_RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, action)
    return best or (None, None)


def plain_ratio(train, texts):
    """train: list of (text, accepted); mean log ratio by text, by the same model in plain Python."""
    grams = lambda t: [(url_filter._PAD * url_filter.ORDER + t + url_filter._END)[i:i + url_filter.ORDER + 1] for i in range(len(t) + 1)]
    chars = {g[-1] for t in texts for g in grams(t)}
    counts = {True: Counter(), False: Counter()}
    contexts = {True: Counter(), False: Counter()}
    for t, label in train:
        for g in grams(t):
            for k in range(url_filter.ORDER + 1):
                counts[label][g[-k - 1:]] += 1
                contexts[label][k, g[-k - 1:-1]] += 1

    def p(label, g):
        out = 1 / max(2, len(chars))
        for k in range(url_filter.ORDER + 1):
            out = (counts[label][g[-k - 1:]] + url_filter.MIX * out) / (contexts[label][k, g[-k - 1:-1]] + url_filter.MIX)
        return out

    return {t: np.mean([math.log(p(True, g)) - math.log(p(False, g)) for g in grams(t)]) for t in texts}


def test_url_verdicts(spark):
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()}
    rows = op8_url_verdicts(spark, SF).collect()
    assert len(rows) == len(pages)
    texts = {"".join(host_path(u)) for u in pages.values()} - {""}
    folds = {r["text"]: r["held"] for r in spark.createDataFrame([(t,) for t in texts], "text string").select("text", (F.pmod(F.xxhash64("text"), F.lit(5)) == 0).alias("held")).collect()}
    label = {"".join(host_path(u)): plain_rule(*host_path(u))[1] for u in pages.values()}
    want = plain_ratio([(t, label[t] == "allow") for t in texts if label[t] and not folds[t]], texts)
    for r in rows:
        host, path = host_path(pages[r["page_id"]])
        rule, action = plain_rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] in ("allow", "block") and (action is None or r["verdict"] == action)
        assert math.isclose(r["score"], want[host + path], rel_tol=1e-9, abs_tol=1e-9)
    # on labelled URLs that the models have not seen, the ratio with its cut is right
    free = [r for r in rows if r["rule"] is None]
    assert free and {r["verdict"] for r in free} == {"allow", "block"}


def test_url_edges(spark, monkeypatch):
    urls = [None, "", "no-scheme", "HTTPS://WWW.Example.COM/en/A?x#y", "x://", "x://host?q/", "x://net/es/1", "x://a.net/fr/", "x://b.com", "x://b.com/", "x://" + "l" * 20_000 + ".org/z", "x://ü.com/é", "x://b.com/", "x://a\nb.com/"]
    df = spark.createDataFrame([(i if i % 5 else None, u, "clash", "clash", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, text string, gram int")
    monkeypatch.setattr(url_filter, "HOT", 3)  # the shuffled way
    rows = url_filter.judge(df, URL_RULES).collect()
    assert sorted((r["host"], r["path"]) for r in rows) == sorted(host_path(u) for u in urls)
    assert all(r["verdict"] == "block" for r in rows if not r["host"] and not r["path"])
    assert url_filter.judge(df.where("false"), URL_RULES).collect() == []
