import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from corpus import AWKWARD, awkward, none, prose

from tallybook.llm import tokenalign as ta
from tallybook.llm.packing import vocabulary

ODD = ["", " ", "▁", "a▁b", "  a  b ", "<|endoftext|> <s> <unk> <0x41>", "\U0001F600\U0001F600 中文字", "\x00x", " " * 700, "=-" * 300,
       "ab" * 900, "naïve façade\r\n\t x", "ﬁ Å Å", "1234567890" * 20]


def brute(texts):
    """Groups by comparing all ends; links and counts one by one."""
    tokens = ta.Tokens(vocabulary(), ta.pieces_file())
    rows, seen = [], Counter()
    for a, b in tokens.encode(texts):
        ends = [np.cumsum([len(side[i]) for i in ids]).astype(int).tolist()
                for side, ids in ((tokens.bytes_a, a), (tokens.bytes_b, b))]
        groups, i, j = [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            i2, j2 = ends[0].index(end, i) + 1, ends[1].index(end, j) + 1
            groups.append((a[i:i2], b[j:j2]))
            i, j = i2, j2
        links = Counter((p, q) for m, n in groups for p in m for q in n)
        seen.update(links.keys())
        spelled = ";".join(",".join(map(str, m)) + "|" + ",".join(map(str, n)) for m, n in groups)
        rows.append((len(a), len(b), len(groups), links, hashlib.sha256(spelled.encode()).hexdigest() if groups else ""))
    best = Counter()
    for (p, _), n in seen.items():
        best[p] = max(best[p], n)
    return [(na, nb, ng, sum(links.values()), sum(m for k, m in links.items() if seen[k] == best[k[0]]),
             sum(m * seen[k] for k, m in links.items()), digest) for na, nb, ng, links, digest in rows]


@pytest.mark.parametrize("many, block, piece", [(ta.MANY, ta.BLOCK_BYTES, ta.SLICE_BYTES), (2, 4000, 700)])
def test_equals_brute_force(spark, monkeypatch, many, block, piece):
    monkeypatch.setattr(ta, "MANY", many)
    monkeypatch.setattr(ta, "BLOCK_BYTES", block)
    monkeypatch.setattr(ta, "SLICE_BYTES", piece)
    extra = [(100 + k, t) for k, t in enumerate(ODD + [prose(4, 40), prose(4, 40), prose(5, 300)])]
    docs = awkward(spark).select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    rows = [r[:2] for r in AWKWARD] + extra
    want = [(key, *r) for (key, _), r in zip(rows, brute([t for _, t in rows]))]
    assert sorted(map(tuple, ta.align(docs).collect()), key=repr) == sorted(want, key=repr)


def test_empty_and_clashing(spark):
    assert ta.align(none(spark)).count() == 0
    assert ta.align(awkward(spark)).columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_special_strings_are_plain_text():
    tokens = ta.Tokens(vocabulary(), ta.pieces_file())
    (a, b), = tokens.encode(["<|endoftext|> <s>"])
    assert 50256 not in a and 1 not in b


def test_common_ends_in_any_shape():
    rng = random.Random(1)
    for _ in range(300):
        spans, first, ends_a, ends_b, base = [], 0, [], [], 0
        for _ in range(rng.randrange(1, 6)):
            stop = base + rng.randrange(1, 60)
            a = sorted(set(rng.sample(range(base + 1, stop + 1), rng.randrange(0, stop - base))) | {stop})
            b = sorted(set(rng.sample(range(base + 1, stop + 1), rng.randrange(0, stop - base))) | {stop})
            spans.append((first, first + len(a)))
            ends_a, ends_b, first, base = ends_a + a, ends_b + b, first + len(a), stop
        got = ta.common_ends(np.array(ends_a), np.array(ends_b), *map(np.array, zip(*spans)))
        whole = {stop - 1 for _, stop in spans}
        assert sorted(got.tolist()) == [k for k, e in enumerate(ends_a) if e in set(ends_b) and k not in whole]
