"""Ids against whole-text encoding; packing and files by exact round trips."""

from __future__ import annotations

import random
import tempfile
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flightmart.llm import idfiles, packing
from flightmart.llm.queries import op4_pack_sequences, op7_id_files, tokenizer_path
from flightmart.llm.tokens import TextEncoder
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def encoder():
    return TextEncoder(tokenizer_path(), max_units=500)


def plain(encoder, text, end):
    return encoder.tokenizer.encode(text or "", add_special_tokens=False).ids + [end]


def test_units_give_the_ids_of_whole_texts(encoder):
    rnd = random.Random(5)
    parts = [" ", "  ", "\n", "\t", ".", ",", "a", "the", "É", "ß", "'s", "1", "23", "_", "-", "\xa0", "\u200b", "\x01", "\x02", "x.y", "..", "😀", "日本", "<|endoftext|>", "½", "\u0301", "\x1c", "\x85"]
    for _ in range(150):
        batch = ["".join(rnd.choices(parts, k=rnd.randint(0, 25))) for _ in range(20)] + [None]
        ids, sizes = encoder.encode(batch, 1)
        for text, got in zip(batch, np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
            assert got.tolist() == plain(encoder, text, 1), text


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=50))
def test_variable_length_code_round_trip(values):
    control, data = idfiles.encode_values(np.array(values, np.uint32))
    assert len(control) == -(-len(values) // 4)
    assert idfiles.decode_values(control, data, len(values)).tolist() == values


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 90), max_size=40))
def test_packer_places_every_id_once(sizes):
    packer = packing._Packer((4, 8, 16), 64)
    windows, rest = packer.pack(sizes, True)
    assert not rest
    seen = defaultdict(list)
    for window in windows:
        total = sum(n for _, _, n in window)
        assert total <= 16 and total & (total - 1) == 0  # no padding
        for doc, start, n in window:
            seen[doc].append((start, n))
    for doc, size in enumerate(sizes):
        at = 0
        for start, n in sorted(seen[doc]):
            assert start == at
            at += n
        assert at == size
    loads = defaultdict(int)
    for window, group in zip(windows, packer.groups(windows), strict=True):
        loads[group] += sum(n for _, _, n in window)
    assert not loads or max(loads.values()) - min(loads.values()) <= 16


def check_pieces(rows, expected):
    """expected: list of ids per document; rows of equal documents are told apart by their pieces alone."""
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append(r)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0
    assert sum(r["length"] for r in rows) == sum(map(len, expected))
    return pieces


def test_packing_query(spark, texts, encoder):
    rows = op4_pack_sequences(spark, SF_SMALL).collect()
    pieces = check_pieces(rows, [plain(encoder, t, 1) for t in texts.values()])
    for doc_id, text in texts.items():
        ids, at = np.array(plain(encoder, text, 1), "<u4"), 0
        for r in sorted(pieces[doc_id], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            assert r["ids_crc32"] == zlib.crc32(ids[at:at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)


def test_packing_edges(edge, none, encoder):
    rows = packing.pack(edge, tokenizer_path()).collect()
    check_pieces(rows, [plain(encoder, r["text"], 1) for r in edge.select("text").collect()])
    assert packing.pack(none, tokenizer_path()).collect() == []
    with pytest.raises(ValueError):
        packing.pack(none, tokenizer_path(), tiers=(100,))


def test_file_query(spark, texts, encoder):
    got = {r["doc_id"]: r for r in op7_id_files(spark, SF_SMALL).collect()}
    start = 0
    for doc_id in sorted(texts):
        ids = np.array(plain(encoder, texts[doc_id], 2), "<u4")
        assert (got[doc_id]["start"], got[doc_id]["n_tokens"], got[doc_id]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_file_edges(spark, edge, none, encoder):
    path = tempfile.mkdtemp(prefix="flightmart-ids-")
    idfiles.write_ids(edge, f"{path}/a", tokenizer_path(), block_ids=1000)
    rows = sorted(idfiles.read_ids(spark, f"{path}/a").collect(), key=lambda r: r["start"])
    key = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "")
    start = 0
    for r, e in zip(rows, sorted(edge.select("doc_id", "text").collect(), key=key), strict=True):
        ids = plain(encoder, e["text"], 2)
        assert (r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4").tolist()) == (e["doc_id"], start, ids)
        start += len(ids)
    idfiles.write_ids(none, f"{path}/b", tokenizer_path())
    assert idfiles.read_ids(spark, f"{path}/b").collect() == []
