import random
import zlib

import numpy as np
from corpus import AWKWARD, awkward, none
from hypothesis import given, settings
from hypothesis import strategies as st

from tallybook.llm import packing

ENCODERS: dict = {}


def filled(runs):
    out = {}
    for size, lo, hi, seq, offset in runs:
        for k in range(hi - lo):
            out.setdefault(seq + k, []).append((offset, size))
    return out


def test_plan_places_every_piece_without_gaps():
    for seed in range(20):
        rng = random.Random(seed)
        capacity = rng.choice([10, 64, 1024])
        histogram = {}
        for _ in range(rng.choice([1, 40, 3000])):
            size = min(capacity, 1 + int(rng.expovariate(3 / capacity)))
            histogram[size] = histogram.get(size, 0) + 1
        found = filled(packing.plan(dict(histogram), capacity))
        placed = {}
        for pieces in found.values():
            end = 0
            for offset, size in sorted(pieces):
                assert offset == end
                end += size
                placed[size] = placed.get(size, 0) + 1
            assert end <= capacity
        assert placed == histogram
    assert packing.plan({}) == []


def test_large_pieces_are_paired_best():
    assert len(filled(packing.plan({600: 3, 424: 2, 400: 2}))) == 4
    assert len(filled(packing.plan({512: 4}))) == 2
    assert len(filled(packing.plan({600: 2, 200: 4}))) == 2


def test_pieces_hold_the_tokenizers_ids(spark):
    from tokenizers import Tokenizer

    rows = packing.pieces(awkward(spark)).collect()
    tokenizer = Tokenizer.from_file(packing.vocabulary() + ".json")
    for key, text, *_ in AWKWARD:
        want = tokenizer.encode(text or "", add_special_tokens=False).ids + [packing.END]
        own = sorted((r for r in rows if r.doc_id == key), key=lambda r: r.piece)
        if sum(1 for r in AWKWARD if r[0] == key) > 1:
            continue
        assert [t for r in own for t in np.frombuffer(bytes(r.ids), "<u4").tolist()] == want
        assert all(r.length == 1024 for r in own[1:]) and own[0].length <= 1024
        assert [r.start for r in own] == np.cumsum([0] + [r.length for r in own[:-1]]).tolist()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=8), st.sampled_from(
    [" ", "  ", "\n", "\t\n ", "don't", "WE'LL", "\xa0", "é1²", "$$$", "<|endoftext|>", "<|end", "ǅ", "a\r\n\r\n b"])),
    max_size=8).map("".join))
def test_encoder_equals_the_tokenizers_file(text):
    encode = ENCODERS.setdefault("own", packing.Encoder(packing.vocabulary())) if not ENCODERS else ENCODERS["own"]
    text = text.encode("utf-8", "ignore").decode()
    assert encode(text) == encode.whole.encode(text, add_special_tokens=False).ids


def test_packed_rows(spark):
    cut_up = packing.digests(packing.pieces(awkward(spark)))
    got = packing.pack(cut_up).collect()
    assert len(got) == cut_up.count()
    at = {}
    for r in got:
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in at.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 1024
    empty = next(r for r in got if r.doc_id == 1)
    assert (empty.length, empty.ids_crc32) == (1, zlib.crc32(np.array([2], "<u4").tobytes()))
    assert packing.pack(packing.digests(packing.pieces(none(spark)))).count() == 0
