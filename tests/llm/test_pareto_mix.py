"""The mix against ranking every source in one list."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import pytest

from faultline.llm import pareto_mix as P

SCHEMA = "doc_id bigint, text string, source string, target string, `need` int, copies int"


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(words):
    order = sorted(words, key=lambda s: (s is None, s or ""))
    weight = {s: P.WEIGHTS[n % 3] for n, s in enumerate(order)}
    total, capped = sum(words.values()), set()
    while True:
        left = total - sum(3 * words[s] for s in capped)
        weights = sum(weight[s] for s in order if s not in capped)
        share = {s: left * weight[s] / weights if weights else 0 for s in order}
        more = {s for s in order if s not in capped and share[s] > 3 * words[s]}
        if not more:
            return {s: 3.0 * words[s] if s in capped else share[s] for s in order}
        capped |= more


def plain(rows):
    words = defaultdict(int)
    for _, text, source in rows:
        words[source] += size(text)
    goal = targets(words)
    out = []
    for source in words:
        ratio = goal[source] / words[source] if words[source] else 0.0
        whole, chance = int(ratio), ratio - int(ratio)
        need, ranked = goal[source] - whole * words[source], []
        for id_, text, s in rows:
            if s == source:
                key = f"{'' if id_ is None else id_}:{text or ''}"
                u = (int(hashlib.md5(key.encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
                ranked.append((u / (1 - u) / (chance / (1 - chance)) if chance else 0, id_ or 0, size(text)))
        before = 0
        for _, id_, n in sorted(ranked):
            out.append((id_, n, words[source], round(goal[source], 6), n * (whole + (chance > 0 and before + n / 2 <= need))))
            before += n
    return sorted(out)


def documents():
    rows = []
    for n in range(900):
        source = None if n % 50 == 0 else "hot" if n % 3 == 0 else f"s{n % 7}"
        rows.append((n + 1, f"w{n} " * (1 + n * 7 % 40), source))
    rows += [(2001, None, "hot"), (2002, "", "s1"), (2003, " \n\t ", "only empty"), (2004, "long " * 20_000, "s2"), (2005, "é e x", "ä"), (2006, "tiny", "~")]
    return rows


@pytest.mark.parametrize("broadcast", [0, 100_000])
def test_mix_equals_the_ranked_lists(spark, monkeypatch, broadcast):
    monkeypatch.setattr(P, "BROADCAST_SOURCES", broadcast)
    rows = documents()
    df = spark.createDataFrame([(i, t, s, "x", 1, 2) for i, t, s in rows], SCHEMA)
    got = P.mix(df).collect()
    assert sorted((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in got) == plain(rows)
    assert P.mix(df).collect() is not None and all(r.taken <= 3 * r.size for r in got)
    taken, goal, longest = Counter(), {}, Counter()
    source_of = {i: s for i, _, s in rows}
    for r in got:
        s = source_of[r.doc_id]
        taken[s] += r.taken
        goal[s] = r.target
        longest[s] = max(longest[s], r.size)
    assert all(abs(taken[s] - goal[s]) <= longest[s] for s in goal)


def test_taken_documents_keep_their_columns(spark):
    rows = documents()
    df = spark.createDataFrame([(i, t, s, "x", 1, 2) for i, t, s in rows], SCHEMA)
    got = P.mixed(df)
    assert got.schema == df.schema
    copies = Counter(r.doc_id for r in got.collect())
    want = {i: taken // n for i, n, _, _, taken in plain(rows) if taken}
    assert copies == want


def test_repeated_rows_and_nulls(spark):
    rows = [(1, "a b", "s", "x", 1, 2)] * 6 + [(None, "c d e", "s", "x", 1, 2), (None, None, None, None, None, None), (2, "f", None, "x", 1, 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    first, second = (sorted(map(repr, P.mix(df).collect())) for _ in range(2))
    assert len(first) == len(rows) and first == second
    P.mixed(df).collect()


def test_empty_table_and_no_words(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert P.mix(df).count() == 0 and P.mixed(df).count() == 0
    empty = spark.createDataFrame([(1, " ", "s", "x", 1, 2), (2, None, "t", "x", 1, 2)], SCHEMA)
    assert [r.taken for r in P.mix(empty).collect()] == [0, 0] and P.mixed(empty).count() == 0
