from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from faultline.llm import substring_dedup as S


def brute(texts, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    counts = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - window + 1) if counts[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{n}" for n in range(400)]
    passages = [rng.choices(vocabulary, k=k) for k in (9, 12, 15, 30, 60)]
    texts = []
    for _ in range(60):
        words = rng.choices(vocabulary, k=rng.randint(0, 80))
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(words))
            words[at:at] = rng.choice(passages)
        texts.append("\n ".join(words))
    texts += texts[:9] + [None, "", " ", "a " * 30, "a b " * 20, "a b c " * 3, "Zz " + " ".join(passages[4]), "é\x1cx y " * 7]
    return texts


@pytest.mark.parametrize("shard_segments", [1000, 3])
def test_like_brute_force(spark, shard_segments):
    texts = corpus()
    docs = spark.createDataFrame(
        [(n if n % 7 else None, t, n) for n, t in enumerate(texts)], "doc_id bigint, text string, name1 int"
    )
    got = S.dedup(docs, window=10, anchor=4, shard_segments=shard_segments).collect()
    want = sorted((str(n if n % 7 else None), *row) for n, row in enumerate(brute(texts, 10)))
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in got) == want
    assert S.dedup(docs.limit(0)).count() == 0


def test_automaton_counts_windows():
    rng = random.Random(1)
    for _ in range(200):
        lists = [rng.choices("abc", k=rng.randint(3, 14)) for _ in range(rng.randint(1, 5))]
        times = [rng.randint(1, 2) for _ in lists]
        automaton = S.Automaton()
        for words, n in zip(lists, times):
            automaton.add(words, n)
        automaton.close()
        counts = Counter()
        for words, n in zip(lists, times):
            for i in range(len(words) - 2):
                counts[tuple(words[i : i + 3])] += n
        for words in lists:
            assert automaton.repeated(words, 3) == [i for i in range(len(words) - 2) if counts[tuple(words[i : i + 3])] > 1]


def test_query(spark, sf_dir):
    from faultline.llm.queries import QUERIES
    import hashlib

    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = {r.doc_id: r for r in QUERIES["op10_substring_dedup"](spark, sf_dir).collect()}
    for row, (n, gone, kept) in zip(rows, brute([r.text for r in rows], 35)):
        one = got[row.doc_id]
        assert (one.n_words, one.n_removed) == (n, gone)
        assert one.kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()
