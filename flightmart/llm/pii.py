"""Personal data: labelers vote, their reliabilities are estimated, and a classifier of spans is trained.

Base kinds (email, ip, card, phone) are found by pattern and check; they are
reported always.  Besides, candidates of further kinds, and matches of base
patterns that fail the check, are judged by weak supervision: regex, gazetteer
and context labelers vote yes or no or abstain on each candidate; expectation-
maximisation (Dawid and Skene) over all candidates estimates how reliable each
labeler is and how common true spans are in each kind; a logistic classifier is
trained on the resulting probabilities, with the votes and the kind as
features, and reports the spans that reach ``LEAST``.

DataFrame operations only.  Texts are matched in place; only matches, with a
few characters around them, are shuffled, and a match's place is a running sum
over its document's matches.  What reaches the driver are counts by kind and
pattern of votes, of which there is a fixed number (kinds x 3^labelers).

Defined results.  Null or empty text: no spans.  Null doc_id: a document like
any other.  Repeated rows: each has the same spans, and counts once in the
training.  Very long texts: read whole; the patterns never backtrack over a run
of characters twice.  Equal starts: in the order of KINDS.  No candidates: no
classifier.  Empty table: no rows.  Columns besides doc_id and text are ignored
(``redact`` keeps them).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flightmart.llm.common import keyed, packed, written

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "ssn", "tel", "iban", "person", "likely")
LEAST = 0.9

# Common given names.
_NAMES = """James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Barbara Richard Susan Joseph
Jessica Thomas Sarah Charles Karen Daniel Lisa Matthew Nancy Anthony Sandra Mark Ashley Steven Emily Paul Donna Andrew
Michelle Joshua Carol Kenneth Amanda Kevin Melissa Brian Deborah George Stephanie Edward Laura Hans Peter Klaus Anna
Maria Jean Pierre Marie Sophie Luc Camille Jose Carmen Juan Pilar Antonio Lucia Miguel Elena""".split()
# Country codes of IBANs, and the commonest top-level domains.
_IBAN = "AT BE CH CZ DE DK ES FI FR GB IE IT LU NL NO PL PT SE".split()
_DOMAINS = "com org net edu gov io de fr es it uk nl ch at eu info".split()

# Patterns as given, but that a run of characters is entered once (possessive quantifiers do not
# change what matches, since what follows a run is never part of it).
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "ssn": r"(?<![0-9+.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "tel": r"(?<![0-9+.(-])(?<!\+[0-9] )(?<!\+[0-9]{2} )(?<!\+[0-9]{3} )(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])",
    "iban": rf"\b(?:{'|'.join(_IBAN)})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{3,7}}(?: ?[A-Z0-9]{{1,3}})?\b",
    "person": rf"\b(?:{'|'.join(_NAMES)}) [A-Z][a-z]++(?: [A-Z][a-z]++)?",
}
#: A text without this cannot hold a match; a quick test.
_NEEDS = {"email": "@", "phone": "+"}

_LABELERS = ("shape", "check", "gazetteer", "cue", "anticue")
_AROUND = 32
# Words that announce personal data, and words that announce other numbers and names.
_CUES = {
    "email": r"mail|contact|write|reach", "ip": r"\bip\b|address|host|client|visitor|login", "card": r"card|visa|master|credit|debit|payment|karte|tarjeta|carte",
    "phone": r"phone|tel|call|mobile|cell|fax|whatsapp|contact", "ssn": r"ssn|social|security", "tel": r"phone|tel|call|mobile|cell|fax|contact|reach",
    "iban": r"iban|account|bank|konto|cuenta|compte", "person": r"name|mr|mrs|ms|dr|dear|contact|patient|customer|signed|born",
}
_ANTICUES = r"version|v\.|release|isbn|issn|order|invoice|ticket|serial|model|part|figure|table|total|page|chapter|row|number of|[$%=#/]\s*$"


def matches(text: Column, kind: str) -> Column:
    """Array of (kind, nth, gap, match, before, after): gap is the length of what lies between the match before and this one."""
    pattern = F.lit(PATTERNS[kind])

    def rows(both: Column) -> Column:
        found, gaps = both["found"], both["gaps"]
        return F.transform(found, lambda m, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("nth"), F.length(F.get(gaps, i)).alias("gap"), m.alias("match"),
            F.substring(F.get(gaps, i), -_AROUND, _AROUND).alias("before"), F.substring(F.get(gaps, i + 1), 1, 4).alias("after")))

    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    out = F.get(F.transform(F.array(F.struct(hits.alias("found"), F.split(text, PATTERNS[kind], -1).alias("gaps"))), rows), F.lit(0))
    return F.when(text.contains(_NEEDS[kind]), out) if kind in _NEEDS else F.when(text.rlike("[0-9]"), out) if kind != "person" else out


def _digits() -> Column:
    return F.regexp_replace("match", "[^0-9]", "")


def _passes() -> Column:
    """Whether a match of a base pattern stands the check; true for the other kinds."""
    parts = F.split("match", r"\.")
    n = F.length(_digits())
    small = F.forall(parts, lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.regexp_replace(p, "^0+(?=.)", "").substr(-3, 3).cast("int") <= 255))
    return (F.when(F.col("kind") == "ip", small).when(F.col("kind") == "card", n.between(12, 19) & F.call_function("luhn_check", _digits()))
            .when(F.col("kind") == "phone", n.between(9, 15)).otherwise(F.lit(True)))


def candidates(keyed: DataFrame) -> DataFrame:
    """(k1, k2, kind, start, end, match, before, after, passes): all matches of all patterns."""
    # "outer", as the filter that Spark adds below an inner explode would match everything twice
    every = F.flatten(F.array(*[F.coalesce(matches(F.col("text"), k), F.array().cast(_MATCH)) for k in PATTERNS]))
    found = keyed.select("k1", "k2", F.inline_outer(every)).where("kind IS NOT NULL").dropDuplicates(["k1", "k2", "kind", "nth"])
    before = Window.partitionBy("k1", "k2", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.length("match")).over(before).cast("long")
    return found.withColumn("end", end).select("k1", "k2", "kind", (F.col("end") - F.length("match")).alias("start"), "end", "match", "before", "after", _passes().alias("passes"))


_MATCH = "array<struct<kind: string, nth: int, gap: int, match: string, before: string, after: string>>"


def _votes(found: DataFrame) -> DataFrame:
    """Adds a column for each labeler: 1 yes, 0 no, -1 abstains."""
    yes, no, silent = F.lit(1), F.lit(0), F.lit(-1)
    kind, match, n = F.col("kind"), F.col("match"), F.length(_digits())
    grouped = match.rlike(r"[0-9][ .()-]+[0-9]")
    joined = F.col("after").rlike(r"^[A-Za-z0-9_]") | F.col("before").rlike(r"[A-Za-z0-9_]$")  # part of something longer
    shape = (F.when(joined, no).when(kind.isin("card", "phone", "tel") & grouped, yes).when((kind == "card") & n.between(13, 16), yes)
             .when(kind == "card", no).when(kind.isin("email", "ssn", "iban"), yes).otherwise(silent))
    check = F.when(kind.isin(*BASE), F.when(F.col("passes"), yes).otherwise(no)).when((kind == "ssn") & match.rlike("^(?:000|666|9)|-00-|-0000$"), no).otherwise(silent)
    gazetteer = (F.when(kind == "email", F.when(match.rlike(rf"\.(?:{'|'.join(_DOMAINS)})$"), yes).otherwise(silent))
                 .when(kind == "card", F.when(match.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)"), yes).otherwise(no))
                 .when(kind == "ip", F.when(match.rlike(r"^(?:10|127|0)\.|^192\.168\."), no).otherwise(silent))
                 .when(kind.isin("person", "iban"), yes).otherwise(silent))
    cue = F.coalesce(*[F.when((kind == k) & F.lower("before").rlike(c), yes) for k, c in _CUES.items()], silent)
    anticue = F.when(F.lower("before").rlike(_ANTICUES), no).otherwise(silent)
    return found.withColumns(dict(zip(_LABELERS, (shape, check, gazetteer, cue, anticue), strict=True)))


def estimate(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = 40) -> list[float]:
    """Probability that each pattern's candidates are true spans; patterns: (kind, votes, how often).

    Starts from the majority of votes; each round estimates from the present
    probabilities how often each labeler casts each vote on true and on other
    spans, and each kind's share of true spans, and then the probabilities anew.
    """
    p = [0.5 + 0.4 * (v.count(1) - v.count(0)) / max(1, len(v) - v.count(-1)) for _, v, _ in patterns]
    for _ in range(rounds):
        cast = {}
        share = {}
        for (kind, votes, n), q in zip(patterns, p, strict=True):
            for truth, w in ((1, q * n), (0, (1 - q) * n)):
                share[kind, truth] = share.get((kind, truth), 1.0) + w
                for j, v in enumerate(votes):
                    cast[j, truth, v] = cast.get((j, truth, v), 0.0) + w
        total = {(j, t): 3.0 + sum(cast.get((j, t, v), 0.0) for v in (-1, 0, 1)) for j in range(len(_LABELERS)) for t in (0, 1)}
        p = []
        for kind, votes, _ in patterns:
            logs = [math.log(share[kind, t]) + sum(math.log((1.0 + cast.get((j, t, v), 0.0)) / total[j, t]) for j, v in enumerate(votes)) for t in (0, 1)]
            p.append(1 / (1 + math.exp(min(700, logs[0] - logs[1]))))
    return p


def train(patterns: list[tuple[str, tuple[int, ...], int]], truth: list[float], rounds: int = 300, rate: float = 1.0) -> dict[str, float]:
    """Weights of a logistic classifier by feature name: ``bias``, ``kind=...`` and ``labeler=vote``."""
    names = [["bias", f"kind={kind}", *[f"{name}={v}" for name, v in zip(_LABELERS, votes, strict=True)]] for kind, votes, _ in patterns]
    weights = {name: 0.0 for row in names for name in row}
    total = sum(n for _, _, n in patterns)
    for _ in range(rounds):
        slope = {name: 1e-4 * w for name, w in weights.items()}
        for row, (_, _, n), q in zip(names, patterns, truth, strict=True):
            error = (1 / (1 + math.exp(-max(-700.0, min(700.0, sum(weights[x] for x in row))))) - q) * n / total
            for name in row:
                slope[name] += error
        weights = {name: w - rate * slope[name] for name, w in weights.items()}
    return weights


def _probability(weights: dict[str, float]) -> Column:
    def weight(column: str, value, name: str) -> Column:
        return F.when(F.col(column) == value, F.lit(weights[name])).otherwise(F.lit(0.0))

    terms = [F.lit(weights.get("bias", 0.0))]
    for name in sorted(weights):
        column, _, value = name.partition("=")
        if value:
            terms.append(weight(column, value if column == "kind" else int(value), name))
    return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, terms)))


def spans(docs: DataFrame) -> DataFrame:
    """(k1, k2, kind, start, end): all spans of all different (doc_id, text), base ones and those the classifier adds."""
    found = written(_votes(candidates(keyed(docs))), "pii-candidates")
    counted = found.groupBy("kind", *_LABELERS).agg(F.count(F.lit(1)).alias("n")).orderBy("kind", *_LABELERS).collect()  # kinds x 3^labelers rows at most
    patterns = [(r["kind"], tuple(r[x] for x in _LABELERS), r["n"]) for r in counted]
    weights = train(patterns, estimate(patterns)) if patterns else {}
    base = F.col("kind").isin(*BASE)
    kept = found.where((base & F.col("passes")) | (_probability(weights) >= LEAST))
    return kept.select("k1", "k2", F.when(base & ~F.col("passes"), F.lit("likely")).otherwise(F.col("kind")).alias("kind"), "start", "end")


def spans_by_row(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): every row's spans as an array of structs (kind, start, end)."""
    by_text = spans(docs).groupBy("k1", "k2").agg(F.collect_list(F.struct("kind", "start", "end")).alias("spans"))
    return (keyed(docs).select("doc_id", "k1", "k2").join(by_text, ["k1", "k2"], "left")
            .select("doc_id", F.coalesce("spans", F.array().cast("array<struct<kind: string, start: long, end: long>>")).alias("spans")))


def redact(docs: DataFrame, label: str = "[{}]") -> DataFrame:
    """The rows with spans replaced by their kinds; n_chars, where there is such a column, follows the text.

    Of spans that overlap, the one that begins first (the longer of two that
    begin together) gives the name, and all that they cover is replaced.
    """
    by_text = spans(docs)
    order = Window.partitionBy("k1", "k2").orderBy("start", F.desc("end"), "kind")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    group = F.sum(F.when(F.col("start") < F.col("reach"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    merged = (by_text.withColumn("reach", reach).withColumn("group", group).groupBy("k1", "k2", "group")
              .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", -F.col("end"), "kind")).alias("kind")))
    cuts = merged.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias("cuts"))
    text = F.col("row.text").cast("string")

    def before(i: Column) -> Column:
        return F.when(i == 0, F.lit(0)).otherwise(F.get("cuts", i - 1)["end"])

    head, tail = label.split("{}")
    pieces = F.transform("cuts", lambda c, i: F.concat(text.substr((before(i) + 1).cast("int"), (c["start"] - before(i)).cast("int")), F.lit(head), c["kind"], F.lit(tail)))
    rest = text.substr((F.element_at("cuts", -1)["end"] + 1).cast("int"), F.char_length(text))
    # cuts grow with the rows: the same join at every size, also where they would be few enough to broadcast
    joined = packed(docs).join(cuts.hint("merge"), ["k1", "k2"], "left").withColumn("new", F.when(F.col("cuts").isNotNull(), F.concat(F.array_join(pieces, ""), rest)))
    changed = {"text": F.coalesce("new", text)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.coalesce(F.char_length("new").cast(docs.schema["n_chars"].dataType), F.col("row.n_chars"))
    return joined.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
