"""URL filter: allow and block rules, and a character language-model ratio for URLs that no rule fits.

Two smoothed variable-order Markov models are learnt, one from the URLs that a
rule allows, one from those that a rule blocks.  The probability of a
character after the ``ORDER`` characters before it is the count ratio mixed
with that of the next shorter context, down to the uniform one.  A URL's score
is its log-likelihood under the accepted model less that under the rejected
one, by character.  The cut between allow and block is calibrated on the fifth
of the labelled URLs that the models have not seen: it makes the sum of both
error rates least.

DataFrame operations only.  Character contexts are summed before they are
shuffled; the commonest ones (``HOT`` rows, a fixed bound) are broadcast and
the others joined by shuffle, so no context is hot.  Equal URLs are scored
once.  Tables that are used again are written to the shared folder.

Defined results.  Null URL, or one without ``://``: empty host and path, no
rule, blocked (there is nothing to fetch).  Null page_id, repeated rows: judged
like any other.  Very long URLs: read whole.  A score equal to the cut: allow.
If the rules label no URL on one side, the cut is 0 and the models are uniform
where they have seen nothing.  Empty table: no rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightmart.llm.common import ascii_lower, written

ORDER = 4
MIX = 1.0  # weight of the shorter context, in characters
HOT = 4096
_PAD, _END = "\x02", "\x03"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): the host with A-Z lower-cased; both empty without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.expr("substring(url_, instr(url_, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits; rules are (action, host, path)."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1:]))

    def fits(r):
        return ((host == r[1]) | host.endswith(f".{r[1]}")) & path.startswith(r[2])

    def first(value):
        return F.coalesce(*[F.when(fits(r), F.lit(value(r))) for r in ordered], F.lit(None).cast("string"))

    return first(lambda r: r[1] + r[2]), first(lambda r: r[0])


def _grams(text: Column) -> Column:
    """Each character with the ORDER characters before it, and the end."""
    chars = F.split(F.concat(F.lit(_PAD * ORDER), text, F.lit(_END)), "")

    def windows(c: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(c) - ORDER), lambda i: F.concat(*[F.get(c, i - 1 + k) for k in range(ORDER + 1)]))

    return F.get(F.transform(F.array(chars), windows), F.lit(0))  # chars is worked out once


def _ratios(grams: DataFrame) -> DataFrame:
    """grams: (gram, n, yes, no), counts in all URLs and in accepted and rejected ones; adds ``llr`` of the last character."""
    totals = grams.agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"), F.countDistinct(F.substring("gram", ORDER + 1, 1)).alias("chars")).first()
    p = {s: F.lit(1.0 / max(2, totals["chars"] or 0)) for s in ("yes", "no")}
    df = grams
    for k in range(ORDER + 1):
        seen = F.substring("gram", ORDER + 1 - k, k + 1)
        now = grams.groupBy(seen.alias("seen")).agg(F.sum("yes").alias(f"yes{k}"), F.sum("no").alias(f"no{k}"))
        df = df.withColumn("seen", seen).join(now, "seen").drop("seen")
        if k:
            context = F.substring("gram", ORDER + 1 - k, k)
            before = grams.groupBy(context.alias("context")).agg(F.sum("yes").alias(f"yes_c{k}"), F.sum("no").alias(f"no_c{k}"))
            df = df.withColumn("context", context).join(before, "context").drop("context")
        else:
            df = df.withColumns({"yes_c0": F.lit(totals["yes"] or 0), "no_c0": F.lit(totals["no"] or 0)})
    for k in range(ORDER + 1):
        p = {s: (F.col(f"{s}{k}") + MIX * p[s]) / (F.col(f"{s}_c{k}") + MIX) for s in p}
    return df.select("gram", "n", (F.log(p["yes"]) - F.log(p["no"])).alias("llr"))


def _scores(rows: DataFrame, ratios: DataFrame) -> DataFrame:
    """rows: (text, gram, times); the mean ratio by text."""
    hot = ratios.orderBy(F.desc("n"), "gram").limit(HOT).select("gram", F.col("llr").alias("hot_llr"))
    joined = rows.join(F.broadcast(hot), "gram", "left")  # HOT rows of five characters
    rare = joined.where("hot_llr IS NULL").drop("hot_llr").join(ratios.select("gram", "llr"), "gram")
    parts = joined.where("hot_llr IS NOT NULL").select("text", "times", F.col("hot_llr").alias("llr")).unionByName(rare.select("text", "times", "llr"))
    return parts.groupBy("text").agg((F.sum(F.col("llr") * F.col("times")) / F.sum("times")).alias("score"))


def _cut(scored: DataFrame) -> float:
    """The score from which URLs are allowed; scored: (label, score).  Scores are compared by hundredths."""
    bins = (scored.groupBy((F.floor(F.greatest(F.lit(-50), F.least(F.lit(50), F.col("score"))) * 100)).alias("bin"))
            .agg(F.count(F.when(F.col("label") == "allow", 1)).alias("yes"), F.count(F.when(F.col("label") == "block", 1)).alias("no")).orderBy("bin").collect())
    all_yes, all_no = sum(b["yes"] for b in bins), sum(b["no"] for b in bins)
    if not all_yes or not all_no:
        return 0.0
    best, cuts, yes_below, no_below = None, [], 0, 0
    for b in [*bins, None]:
        cost = yes_below / all_yes + (all_no - no_below) / all_no
        at = b["bin"] / 100 if b else bins[-1]["bin"] / 100 + 0.01
        if best is None or cost < best:
            best, cuts = cost, [at]
        elif cost == best:
            cuts.append(at)
        if b:
            yes_below, no_below = yes_below + b["yes"], no_below + b["no"]
    return cuts[len(cuts) // 2]


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every page; score is null without a host and path."""
    urls = pages.select("page_id", F.col("url").cast("string").alias("url_"))
    host, path = url_parts(F.col("url_"))
    urls = urls.withColumns({"host": host, "path": path})
    rule, action = rule_for(F.col("host"), F.col("path"), rules)
    urls = urls.withColumns({"rule": rule, "action": action, "text": F.when((F.col("host") != "") | (F.col("path") != ""), F.concat("host", "path"))})
    # a host holds no slash and a path begins with one, so equal texts have equal hosts, paths and labels
    texts = written(urls.where("text IS NOT NULL").groupBy("text").agg(F.count(F.lit(1)).alias("pages"), F.max("action").alias("label"))
                    .withColumn("held", F.pmod(F.xxhash64("text"), F.lit(5)) == 0), "url-texts")
    learn = (F.col("label").isNotNull() & ~F.col("held")).alias("learn")
    rows = texts.select("text", "label", learn, F.explode(_grams(F.col("text"))).alias("gram"))
    grams = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("learn") & (F.col("label") == "allow"), 1)).alias("yes"),
                                     F.count(F.when(F.col("learn") & (F.col("label") == "block"), 1)).alias("no"))
    ratios = written(_ratios(written(grams, "url-grams")), "url-ratios")
    scores = written(_scores(rows.select("text", "gram", F.lit(1).alias("times")), ratios).join(texts.select("text", "label", "held"), "text"), "url-scores")
    cut = _cut(scores.where("held AND label IS NOT NULL").select("label", "score"))
    verdict = F.coalesce("action", F.when(F.col("score") >= cut, F.lit("allow")), F.lit("block"))
    return urls.join(scores.select("text", "score"), "text", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
