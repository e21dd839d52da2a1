from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings, strategies as st

from demandpanel.llm import packing as pk


def check(rows, out):
    """Every id in one piece, sequences gapless and within capacity, digests of the slower library's ids."""
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(pk.vocabulary()[0])
    whole.encode_special_tokens = True
    want = defaultdict(list)
    for i, t in rows:
        want[i].append(np.array([*whole.encode(t or "", add_special_tokens=False).ids, 0], "<u4"))
    got, at = defaultdict(list), defaultdict(list)
    for r in out:
        got[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    pieces = lambda ids: [(s, n, zlib.crc32(ids[s:s + n].tobytes()), len(ids)) for s, n in
                          zip(np.cumsum([0, *pk.cuts(len(ids))[:-1]]).tolist(), pk.cuts(len(ids)), strict=True)]
    assert {i: sorted(p) for i, p in got.items()} == {i: sorted(x for ids in many for x in pieces(ids)) for i, many in want.items()}
    for held in at.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= pk.CAPACITY
    return at


def test_round_trip_with_nulls_empty_special_and_long(docs, prose):
    rows = [(1, None), (2, ""), (3, "<|endoftext|> it's  \n\n  done "), (4, "a" * 9000), (5, "ß日本 🙂 " * 3000), (6, "x"), (6, "x"), (None, "null id"),
            (7, " ".join(prose(9000, "l")))] + [(100 + i, " ".join(prose(i * 7 % 500, i))) for i in range(120)]
    check(rows, pk.pack(docs(*rows)).collect())
    assert pk.pack(docs()).collect() == []


def test_little_padding_over_several_workers(docs, prose, monkeypatch):
    monkeypatch.setattr(pk, "PER_WORKER", 300)
    rows = [(i, " ".join(prose(i * 37 % 900 + 1, i))) for i in range(300)]
    at = check(rows, pk.pack(docs(*rows)).collect())
    lengths = [sum(n for _, n in held) for held in at.values()]
    padding = sum(0 if n & (n - 1) == 0 else pk.CAPACITY - n for n in lengths)
    assert padding < 0.04 * sum(lengths)


def test_sequences_hold_the_ids(docs, prose):
    rows = [(i, " ".join(prose(i * 11 % 300 + 1, i))) for i in range(40)]
    pieces = pk.pack(docs(*rows), with_ids=True)
    encode = pk.encoder(*pk.vocabulary())
    flat = sorted(x for r in pk.sequences(pieces).collect() for x in r["ids"])
    assert flat == sorted(int(x) for _, t in rows for x in [*encode(t), 0])


@given(st.lists(st.integers(1, pk.CAPACITY), max_size=400))
@settings(max_examples=80, deadline=None)
def test_fill_never_overflows(lengths):
    sequence, offset = pk.fill(np.array(lengths, np.int64))
    held = defaultdict(list)
    for s, o, n in zip(sequence.tolist(), offset.tolist(), lengths, strict=True):
        held[s].append((o, n))
    for parts in held.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        assert end <= pk.CAPACITY


def test_cuts_cover_every_length():
    for n in range(1, 5000):
        parts = pk.cuts(n)
        assert sum(parts) == n and max(parts) <= pk.CAPACITY and min(parts) >= 1
