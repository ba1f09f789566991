from __future__ import annotations

import hashlib
from collections import Counter
from functools import cache

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from faultline.llm import token_alignment as T

A_JSON = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
B_MODEL = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def pair():
    return T.Pair.of(A_JSON, B_MODEL)


@cache
def tokenizers():
    a = Tokenizer.from_str(A_JSON)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_proto=B_MODEL)


def plain(text):
    """Groups by sets of byte offsets, from the whole text at once."""
    a, b = tokenizers()
    sign = T.byte_of_sign()
    want = b" " + text.encode()
    both = []
    ids = a.encode(" " + text, add_special_tokens=False).ids
    both.append([(n, bytes(sign[c] for c in a.id_to_token(n))) for n in ids])
    pieces = [(n, b.id_to_piece(n)) for n in b.encode(text)]
    both.append([(n, bytes([int(p[3:5], 16)]) if b.is_byte(n) else p.replace("▁", " ").encode()) for n, p in pieces])
    if not text or any(b"".join(x for _, x in side) != want for side in both):
        return None
    ends = []
    for side in both:
        at, out = 0, {}
        for n, x in side:
            at += len(x)
            out[at] = n
        ends.append(out)
    groups, last = [], 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        groups.append([[n for at, n in side.items() if last < at <= end] for side in ends])
        last = end
    return len(both[0]), len(both[1]), groups


def brute(rows):
    found = [(i, plain(text or "")) for i, text in rows]
    counts = Counter((g[0][-1], g[1][-1]) for _, f in found if f for g in f[2])
    highest = {}
    for (_, b), n in counts.items():
        highest[b] = max(n, highest.get(b, 0))
    out = []
    for i, f in found:
        if f is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(g[0][-1], g[1][-1]) for g in f[2]]
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in f[2])
        best = sum(counts[x] == highest[x[1]] for x in links)
        out.append((i, f[0], f[1], len(links), len(links), best, sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def answers(df):
    return sorted((tuple(r[n] for n in NAMES) for r in df.collect()), key=repr)


ODD = [
    "", None, " ", "  two  spaces ", "tab\tand\nlines\r\n", "<|endoftext|> is <s> text </s> <unk> <0x41>", "a▁b", "naïve café ﬁ ① ½", "日本語のテキスト",
    "\x00\x01 zero", "🙂🙃 emoji", "a" * 3000, "ab " * 500, "x", "don't we'll I'M", "1234567890 12 3.14", "é combining", "​﻿ zero width",
]


def test_odd_texts(spark):
    rows = [(n, text) for n, text in enumerate(ODD)] + [(3, ODD[3]), (None, "no id"), (100, "the same words"), (101, "the same words")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, id string, links int").repartition(5)
    assert answers(T.statistics(df, A_JSON, B_MODEL)) == brute(rows)
    assert answers(T.statistics(df.limit(0), A_JSON, B_MODEL)) == []


def test_cuts_and_ranks_change_nothing(pair, monkeypatch):
    texts = [t for t in ODD if t] + ["word " * 200 + "naïve  café\n " * 30 + "1 2 3 ", "a _ b c_ d ½ 3 é e", "x" * 100 + " y " + "日本 語 x"]
    assert pair.ranked and pair.cuttable
    got = [pair.tokens(text, 10) for text in texts]
    monkeypatch.setattr(pair, "ranked", None)
    assert got == [pair.tokens(text, 1 << 30) for text in texts]
    assert all(" ".join(T.cut(text, 10)) == text for text in texts)


@given(st.text(st.characters(max_codepoint=0x2030, exclude_categories=["Cs"]), max_size=60))
def test_ranks_give_the_same_tokens(text):
    pair = T.Pair.of(A_JSON, B_MODEL)
    assert pair.a_tokens(text) == pair.a.encode(text, add_special_tokens=False).ids


def common_ends(a, b):
    """How many tokens of each lie before every common end."""
    out = []
    for i, j, run, x, y in T.runs(a, b):
        out += [(i + n, j + n) for n in range(1, run + 1)] + [(x, y)] * (x > i + run)
    return tuple([list(side) for side in zip(*out)] or [[], []])


@given(st.lists(st.integers(1, 3), max_size=80), st.lists(st.integers(1, 3), max_size=80))
def test_common_ends(a, b):
    ends = []
    for steps in (a, b):
        at, out = 0, []
        for step in steps:
            at += step
            out.append(at)
        ends.append(out)
    total = max([0, *ends[0], *ends[1]])
    ends = [out if out and out[-1] == total else [*out, total] if total else [] for out in ends]
    shared = sorted(set(ends[0]) & set(ends[1]))
    assert common_ends(*ends) == tuple([side.index(x) + 1 for x in shared] for side in ends)


def test_long_runs_and_late_shift():
    a = list(range(1, 5001))
    b = [x for x in a if x not in (2, 3, 1777)]
    shared = b
    assert common_ends(a, b) == ([a.index(x) + 1 for x in shared], list(range(1, len(b) + 1)))


def test_every_link_is_a_listed_pair(pair):
    keys = set(T.pair_keys(pair.a_bytes, pair.b_bytes).tolist())
    assert len(keys) <= sum(map(len, pair.a_bytes)) * 3 + sum(map(len, pair.b_bytes)) * 3
    for text in ODD:
        f = plain(text or "")
        assert not f or all(g[0][-1] << 32 | g[1][-1] in keys for g in f[2])


def test_query(spark, sf_dir):
    from faultline.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert answers(QUERIES["op13_token_alignment"](spark, sf_dir)) == brute(rows)


def test_places_are_those_of_the_search(pair):
    import numpy as np

    keys = T.pair_keys(pair.a_bytes, pair.b_bytes)
    places = T.Places(keys)
    shared = len(keys) - len(np.unique(places.slots(keys)))
    assert shared > 0  # some keys share a slot, and are found all the same
    rnd = np.random.default_rng(1)
    asked = keys[rnd.integers(0, len(keys), 50_000)]
    for numbers in (keys, asked, asked[:0]):
        assert (places.of(numbers) == np.searchsorted(keys, numbers)).all()


def test_lists_of_groups_are_made_by_arrays(pair):
    """Groups and last tokens as one walk over the stretches gives them; the walk made an object a token."""
    import numpy as np

    for text in [*filter(None, ODD), "plain words, then 日本語 and ﬁ ½ again " * 40]:
        a_ids, b_ids, last_a, last_b = T.align(pair, text, T.CHUNK)
        assert all(isinstance(x, np.ndarray) for x in (a_ids, b_ids, last_a, last_b))
        want = plain(text)
        groups = want[2] if want else []
        assert T.listed(pair, a_ids, b_ids, last_a, last_b) == ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        assert [*zip(a_ids[last_a].tolist(), b_ids[last_b].tolist())] == [(g[0][-1], g[1][-1]) for g in groups]
    a = pair.entries[0]
    long = np.asarray(pair.a_tokens(" some words here" * 40_000), np.int64)  # more than one slice
    assert len(long) > a.SLICE and a.spell(long, b" some words here" * 40_000)
    assert not a.spell(long, b" some words here" * 40_001) and not a.spell(long[:-1], b" some words here" * 40_000)
