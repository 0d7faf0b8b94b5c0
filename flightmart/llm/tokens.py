"""Token ids of whole texts by the ``tokenizers`` library, inside Arrow tasks.

Byte-level BPE never merges across the boundary before a space that stands
between two non-space characters, nor across one between a letter or digit and
a following full stop or comma.  So a text is encoded unit by unit, and the
ids of units seen before are looked up.  The memo is bounded: when it is full,
units seen once are forgotten and encoded again when they return.  Ids are
exactly those of encoding the whole text at once (tested).
"""

from __future__ import annotations

import os
import re
from codecs import charmap_decode

import numpy as np

# characters that some regex engines count as white space and others don't
_DOUBTFUL = "\x1c-\x1f\x85\u180e\u200b\ufeff"
_SPACE = re.compile(f"[\\s{_DOUBTFUL}]")
_CUT = re.compile(f"(?<![\\s{_DOUBTFUL}]) (?=[^\\s{_DOUBTFUL}])")
#: marks that stand for a full stop or comma at the start of a unit
_STOP, _COMMA = "\x02", "\x01"
#: what a unit may be: begins with white space, so that the cut before it is not safe; begins with
#: a mark; ends with neither letter nor digit, so that a cut before a following mark is not safe
_UNSAFE, _MARK, _OPEN = 1, 2, 4
# The character that byte-level BPE has for each byte: printable ones stand for themselves, the others are numbered from 256.
_PRINTED = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_OTHERS = [b for b in range(256) if b not in _PRINTED]
_BYTE_CHARS = "".join(chr(b) if b in _PRINTED else chr(0x100 + _OTHERS.index(b)) for b in range(256))
_FEED = _BYTE_CHARS[0x0A]
#: words that are encoded as one string
_LINES = 2_000


class _Units(dict):
    """unit -> its number; a new unit gets the next number and waits in ``new``."""

    def __init__(self, known=()) -> None:
        super().__init__(known)
        self.new: list[str] = []

    def __missing__(self, unit: str) -> int:
        n = self[unit] = len(self)
        self.new.append(unit)
        return n


class TextEncoder:
    """Encodes lists of texts; keeps about ``max_units`` units and ``max_ids`` ids between calls at most."""

    def __init__(self, path: str, max_units: int = 400_000, max_ids: int = 4_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.vocab_size = self.tokenizer.get_vocab_size()
        self.max_units, self.max_ids = max_units, max_ids
        # the same model over many words at once, told apart by line feeds; they are put into
        # byte-level characters before, which is cheaper than to have them mapped one by one
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = pre_tokenizers.Split(_FEED, "isolated")
        feed = self.words.encode(_FEED, add_special_tokens=False).ids
        self.feed = feed[0] if len(feed) == 1 else None
        self._keep(np.zeros(0, bool))

    def _keep(self, keep: np.ndarray) -> None:
        """Renumber the kept units; forget the others."""
        if not keep.any():
            self.units = _Units()
            self.first, self.count, self.hits, self.kind = (np.zeros(0, np.int64) for _ in range(4))
            self.ids = np.zeros(0, np.uint32)
            return
        number = np.cumsum(keep) - 1
        self.units = _Units((u, int(number[n])) for u, n in self.units.items() if keep[n])
        self.ids, upto = self._gather(np.flatnonzero(keep))
        self.first, self.count, self.hits = upto[:-1], np.diff(upto), np.zeros(len(upto) - 1, np.int64)
        self.kind = self.kind[keep]

    def _shrink(self) -> None:
        if len(self.units) <= self.max_units and self.ids.size <= self.max_ids:
            return
        least = 2
        keep = self.hits >= least
        while keep.sum() > self.max_units // 2 or self.count[keep].sum() > self.max_ids // 2:
            least *= 2
            keep = self.hits >= least
        self._keep(keep)

    @staticmethod
    def _text(unit: str) -> str:
        """The first unit of a text is kept with a leading space and stands for itself; another follows a space."""
        head = unit[:1]
        if head == " ":
            return unit[1:]
        return f".{unit[1:]}" if head == _STOP else f",{unit[1:]}" if head == _COMMA else f" {unit}"

    @staticmethod
    def _kind(unit: str) -> int:
        if unit.isalnum():
            return 0
        last, head = unit[-1:], unit[:1]
        unsafe = not unit or head != " " and bool(_SPACE.match(unit))
        return _UNSAFE * unsafe | _MARK * (head in (_STOP, _COMMA)) | _OPEN * (not last.isalnum())

    def _learn(self) -> None:
        new = self.units.new
        if not new:
            return
        single = np.fromiter(map(str.isalpha, new), bool, len(new)) & (self.feed is not None)
        first, count, at = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64), self.ids.size
        found = [self.ids]
        if single.any():
            words = [u for u in new if u.isalpha()]
            lines = [charmap_decode("".join(f" {u}\n" for u in words[i:i + _LINES]).encode(), "strict", _BYTE_CHARS)[0] for i in range(0, len(words), _LINES)]
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.words.encode_batch_fast(lines, add_special_tokens=False)])
            feeds = np.flatnonzero(ids == self.feed)  # one after each word
            begin = np.concatenate([[0], feeds[:-1] + 1])
            count[single] = feeds - begin
            first[single] = at + begin
            found.append(ids)
            at += len(ids)
        rest = np.flatnonzero(~single)
        coded = [e.ids for e in self.tokenizer.encode_batch_fast([self._text(new[i]) for i in rest], add_special_tokens=False)]
        count[rest] = np.fromiter(map(len, coded), np.int64, len(coded))
        first[rest] = at + np.cumsum(count[rest]) - count[rest]
        found.append(np.fromiter((i for c in coded for i in c), np.uint32, int(count[rest].sum())))
        self.first = np.concatenate([self.first, first])
        self.count = np.concatenate([self.count, count])
        self.ids = np.concatenate(found)
        self.hits = np.concatenate([self.hits, np.zeros(len(new), np.int64)])
        self.kind = np.concatenate([self.kind, np.fromiter(map(self._kind, new), np.int64, len(new))])
        self.units.new = []

    def _gather(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these units in order, and where each unit's begin and the last's end."""
        count = self.count[unit]
        upto = np.concatenate([[0], np.cumsum(count)])
        return self.ids[np.repeat(self.first[unit] - upto[:-1], count) + np.arange(upto[-1])], upto

    def _numbers(self, parts: list[str]) -> np.ndarray:
        if parts:
            parts[0] = f" {parts[0]}"
        return np.fromiter(map(self.units.__getitem__, parts), np.int64, len(parts))

    def _units_of(self, texts: list[str | None]) -> list[np.ndarray]:
        found = []
        for text in texts:
            if not text:
                parts = []
            elif _STOP in text or _COMMA in text:
                parts = [text]
            else:
                parts = text.replace(".", f" {_STOP}").replace(",", f" {_COMMA}").split(" ")
            found.append(self._numbers(parts))
        self._learn()
        # texts with a cut that is not safe are cut again, at surely safe places only
        kind = self.kind[np.concatenate(found)] if found else np.zeros(0, np.int64)
        unsafe = (kind & _UNSAFE) > 0
        unsafe[1:] |= ((kind[1:] & _MARK) > 0) & ((kind[:-1] & _OPEN) > 0)
        edge = np.cumsum([len(x) for x in found])
        for i in set(np.searchsorted(edge, np.flatnonzero(unsafe), "right").tolist()):
            found[i] = self._numbers(_CUT.split(texts[i]))
        self._learn()
        return found

    def encode(self, texts: list[str | None], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and each text's number of ids; ``end`` is put after each text.  None counts as empty."""
        self._shrink()
        numbers = self._units_of(texts)
        sizes = [len(x) for x in numbers]
        unit = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
        self.hits += np.bincount(unit, minlength=len(self.hits))
        ids, upto = self._gather(unit)
        lengths = np.diff(upto[np.cumsum([0, *sizes])])
        if end is not None:
            ids = np.insert(ids, np.cumsum(lengths), end) if len(lengths) else ids
            lengths = lengths + 1
        return ids.astype(np.uint32, copy=False), lengths


_ENCODERS: dict[tuple[str, int], TextEncoder] = {}


def encoder(path: str, max_units: int = 400_000) -> TextEncoder:
    """One encoder per Python worker, vocabulary file and size of the memo."""
    if (path, max_units) not in _ENCODERS:
        _ENCODERS[path, max_units] = TextEncoder(path, max_units, 10 * max_units)
    return _ENCODERS[path, max_units]


def slices(texts: list[str | None], max_chars: int = 1_000_000):
    """(first, last) positions of runs of texts of about ``max_chars`` together; a longer text is a run of its own."""
    first, chars = 0, 0
    for i, text in enumerate(texts):
        chars += len(text or "")
        if chars >= max_chars:
            yield first, i + 1
            first, chars = i + 1, 0
    if first < len(texts):
        yield first, len(texts)
