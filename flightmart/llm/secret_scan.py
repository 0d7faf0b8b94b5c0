"""Secret scan: patterns, and the guess cost of values in credential contexts.

Base kinds are found by pattern.  Besides, each value that stands in a
credential context (after ``password:``, ``token=``, ``Authorization: Bearer``,
in ``user:value@host``) is cut into words, dates, repeats, keyboard walks and
brute-force spans so that the product of their guesses is least (dynamic
programming over all segmentations); values that take ``min_log10`` powers of
ten of guesses or more are reported as kind ``guess``, so placeholders such as
``password=changeme123`` are not.

Words are the commonest of passwords and, after those, the words of the table
itself, ranked by the number of documents that hold them: counted in Spark, one
shuffle of counts summed before; ``MOST_WORDS`` at most (a fixed bound) are known to
every task.  The scan itself is one pass; a task holds a few hundred texts at a time.

Defined results.  Null or empty text: no spans.  Null doc_id, repeated rows:
scanned like any other.  Empty table: no rows.  Very long texts: scanned whole.
Equal starts: in the order of KINDS.  Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightmart.llm.common import python_batches, text_of, written

KINDS = ("assign", "access", "hex", "guess")
BASE = KINDS[:3]

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
# with the least lengths in the pattern: a run that is too short can hide no other one
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|(?:api|access|auth|private|signing)[_-]?key|authorization["']?:?\x20*(?:bearer|basic))"""
    r"""(?:["']?[\x20\t]*(?:[:=]>?|is\b)[\x20\t]*|(?<=bearer)\x20+|(?<=basic)\x20+)["']?([^\s"'<>,;]+)"""
    r"""|://[^\s/:@"'<>]+:([^\s/@"'<>]+)@""", re.I | re.A)

#: In lower case, one of these is in every match of the two patterns above; a quick test.
_CUES = ("pass", "pwd", "secret", "token", "credential", "api", "key", "authorization", "://")

# The commonest words of passwords, the commonest first.
_WORDS = """password pass word admin login welcome qwerty abc letmein monkey dragon master secret test default
change changeme me user root guest server access love sunshine princess football baseball shadow superman
batman trustno hello freedom whatever hunter pepper summer winter spring autumn monday friday january
december money computer internet service system database manager office company example sample dummy
placeholder your my the not set token key api none null true false value insert here enter replace
michael jordan jennifer thomas daniel robert charlie george andrew matthew joshua jessica ashley michelle
cheese coffee banana orange apple cookie flower angel soccer hockey killer ranger tiger eagle lion
london paris berlin madrid new york texas canada germany france spain green blue red black white silver golden
private public super hyper mega ultra star magic power happy lucky blessed""".split()
#: Bounds of the words taken from the table: how many, and the documents that must hold one, so that no secret becomes a word.
MOST_WORDS, LEAST_DOCS = 1 << 16, 5
_LETTERS = re.compile(r"[^\W\d_]{3,}")
# Neighbouring keys of the usual keyboard, and the alphabet.
_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz")
_NEXT = {(a, b) for row in _ROWS for a, b in zip(row, row[1:], strict=False)} | {(b, a) for row in _ROWS for a, b in zip(row, row[1:], strict=False)}
_PLAIN = str.maketrans("4@301!5$7", "aaeoiisst")
_DATE = re.compile(r"(?:19|20)[0-9]{2}(?:([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12][0-9]|3[01]))?|(?:0[1-9]|[12][0-9]|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)[0-9]{2}")
#: Each span after the first makes a guesser try this many times more (log10).
_JOIN = math.log10(2)


def _brute(ch: str) -> float:
    return math.log10(10 if ch.isdigit() else 26 if ch.isalpha() else 33)


def _repeats(value: str) -> list[list[tuple[int, float, int]]]:
    """By start: (length of the unit, its brute-force cost, most times), for each unit that stands twice in a row at least.

    A unit that repeats a shorter one is never the cheaper way and is left out.
    """
    n = len(value)
    found: list[list[tuple[int, float, int]]] = [[] for _ in range(n)]
    # without two equal runs of 16 characters, no unit of 16 stands twice
    longest = n // 2 if len({value[i:i + 16] for i in range(max(n - 15, 0))}) < n - 15 else min(n // 2, 15)
    points = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), "<u4")
    for u in range(1, longest + 1):
        unlike = np.flatnonzero(points[u:] != points[:-u])
        starts = np.arange(n - u)
        run = np.append(unlike, n - u)[np.searchsorted(unlike, starts)] - starts  # characters equal to those u before
        for i in np.flatnonzero(run >= u).tolist():
            if not any(u % v == 0 and times * v >= 2 * u for v, _, times in found[i]):
                found[i].append((u, sum(map(_brute, value[i:i + u])), 1 + int(run[i]) // u))
    return found


class Guesser:
    """Guess costs with words ranked by their place: those of ``_WORDS``, then ``words``."""

    def __init__(self, words: list[str] = ()):
        self.rank: Mapping[str, int] = {w: k + 1 for k, w in reversed(list(enumerate([*_WORDS, *words])))}
        self.longest = max(map(len, self.rank))
        self.known: dict[str, float] = {}

    def log10(self, value: str) -> float:
        """Least log10 of the guesses over all segmentations of ``value``."""
        if len(value) > 64:
            return self._least(value)
        if (cost := self.known.get(value)) is None:
            if len(self.known) >= 50_000:
                self.known.clear()
            cost = self.known[value] = self._least(value)
        return cost

    def _spans(self, value: str) -> list[list[tuple[int, float]]]:
        """Words, dates and keyboard walks by start: (end, cost)."""
        n = len(value)
        low = value.lower()
        low = low if len(low) == n else value  # a letter's lower case may be longer
        plain = low.translate(_PLAIN)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for i in range(n):
            for j in range(i + 3, min(n, i + self.longest) + 1):
                for spelt, extra in ((low[i:j], 0.0), (plain[i:j], math.log10(2))):
                    if rank := self.rank.get(spelt):
                        case = 0.0 if value[i:j] == low[i:j] else math.log10(2)
                        ends[i].append((j, math.log10(rank + 1) + extra + case))
            for m in (_DATE.match(value, i), _DATE.match(value, i, i + 4)):
                if m:
                    ends[i].append((m.end(), math.log10(120 * (1 if m.end() - i == 4 else 365))))
        reach = n
        for i in range(n - 1, -1, -1):  # any part of a walk is one
            reach = reach if i + 1 < n and (low[i], low[i + 1]) in _NEXT else i + 1
            ends[i].extend((j, math.log10(47 * 4 * (j - i))) for j in range(i + 3, reach + 1))
        return ends

    def _least(self, value: str) -> float:
        n = len(value)
        ends, repeats = self._spans(value), _repeats(value)
        logs = np.log10(np.arange(1, n + 2))
        best = np.full(n + 1, np.inf)  # least cost up to here
        best[0], open_ = 0.0, math.inf  # the same, within a brute-force span
        for i in range(n):
            start = best[i] + (_JOIN if i else 0.0)
            open_ = min(open_, start) + _brute(value[i])
            best[i + 1] = min(best[i + 1], open_)
            for j, cost in ends[i]:
                best[j] = min(best[j], start + cost)
            for u, unit, times in repeats[i]:
                if u * times >= 3:
                    least = 2 if u > 1 else 3
                    upto = slice(i + least * u, i + times * u + 1, u)
                    best[upto] = np.minimum(best[upto], start + unit + logs[least - 1:times])
        return float(best[n])


_PLAIN_GUESSER = Guesser()


def log10_guesses(value: str) -> float:
    """Least log10 of the guesses, with the commonest words of passwords alone."""
    return _PLAIN_GUESSER.log10(value)


def find(text: str, min_log10: float = 10.0, guesser: Guesser = _PLAIN_GUESSER) -> list[tuple[str, int, int]]:
    """All spans of a text: (kind, start, end)."""
    spans = [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    spans += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    low = text.lower()
    if not any(cue in low for cue in _CUES):
        return spans
    spans += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    for m in _CONTEXT.finditer(text):
        group = m.lastindex
        # no character takes more than the 33 signs: shorter values need no segmentation
        if len(m.group(group)) * math.log10(33) >= min_log10 and guesser.log10(m.group(group)) >= min_log10:
            spans.append(("guess", *m.span(group)))
    return spans


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()

    def rows() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "docs"])
        seen.clear()
        return batch

    for batch in python_batches(batches):
        for text in batch.column("text").to_pylist():
            seen.update(set(_LETTERS.findall(text.lower())))
        if len(seen) > 300_000:
            yield rows()
    if seen:
        yield rows()


def common_words(docs: DataFrame, most: int = MOST_WORDS, least_docs: int = LEAST_DOCS) -> list[str]:
    """Words of three letters or more that ``least_docs`` rows hold, the commonest first.

    As many frequencies as ``most`` words allow: words of equal frequency are all in or all out.
    """
    counts = written(text_of(docs).select("text").mapInArrow(_count_words, "word string, docs long").groupBy("word").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs), "words")
    steps = counts.groupBy("docs").agg(F.count(F.lit(1)).alias("n")).toArrow().sort_by([("docs", "descending")])  # a row per frequency
    fits = np.cumsum(steps.column("n").to_numpy()) <= most
    if not fits.any():
        return []
    found = counts.where(F.col("docs") >= int(steps.column("docs").to_numpy()[fits][-1])).toArrow()  # ``most`` rows at most
    return found.sort_by([("docs", "descending"), ("word", "ascending")]).column("word").to_pylist()


def _scan(min_log10: float, words):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        guesser = Guesser(words.value)
        for batch in python_batches(batches):
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in find(t, min_log10, guesser)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], names=["doc_id", "spans"])

    return run


def scan(docs: DataFrame, min_log10: float = 10.0) -> DataFrame:
    """(doc_id, spans): per document all spans as structs (kind, start, end), in code points, end exclusive."""
    words = docs.sparkSession.sparkContext.broadcast(common_words(docs))
    return text_of(docs).mapInArrow(_scan(min_log10, words), "doc_id long, spans array<struct<kind: string, start: long, end: long>>")
