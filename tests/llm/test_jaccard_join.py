from __future__ import annotations

import random
import re

import numpy as np
import pytest

from faultline.llm import jaccard_join as J


def brute(rows):
    """doc_id -> (size, component) by comparing all pairs."""
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        width = min(5, len(words))
        sets.append({tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set())
    forest = J.Forest(len(rows))
    index = {}
    for n, one in enumerate(sets):
        seen = {}
        for shingle in one:
            for m in index.setdefault(shingle, []):
                seen[m] = seen.get(m, 0) + 1
            index[shingle].append(n)
        for m, both in seen.items():
            if 100 * both >= 80 * (len(one) + len(sets[m]) - both):
                forest.join(n, m)
    least = {}
    for n, (id_, _) in enumerate(rows):
        if id_ is not None:
            root = forest.root(n)
            least[root] = min(least.get(root, id_), id_)
    return sorted((str(id_), len(sets[n]), str(least.get(forest.root(n)))) for n, (id_, _) in enumerate(rows))


def found(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in df.collect())


def near_copies(seed=5, families=25, members=12):
    rng = random.Random(seed)
    vocabulary = [f"w{n}" for n in range(300)]
    passage = rng.choices(vocabulary, k=60)
    rows = []
    for _ in range(families):
        base = rng.choices(vocabulary, k=rng.randint(3, 160))
        for _ in range(rng.randint(1, members)):
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                words += passage
            rows.append(" ".join(words).title() if rng.random() < 0.2 else "  ".join(words))
    return rows


@pytest.fixture(scope="module")
def rows():
    texts = near_copies() + [None, "", " \n ", "one two", "One  TWO", "one two three", "a b c d e", "a b c d e", "Éa é"]
    out = list(enumerate(texts, 100))
    return out + [(None, out[0][1]), (None, "no one else has this text at all"), (100, out[0][1])]


@pytest.mark.parametrize("limits", [{}, {"most_runs": 600, "most_docs": 6}, {"most_runs": 600, "most_docs": 6, "rounds": 0}])
def test_like_brute_force(spark, rows, limits):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, k string, runs int")
    want = brute(rows)
    got = found(J.join(docs, **limits))
    # a document of null id has no name of its own
    assert got == want
    assert J.join(docs.limit(0)).count() == 0


def test_query(spark, sf_dir):
    from faultline.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert found(QUERIES["op7_jaccard_join"](spark, sf_dir)) == brute(rows)


def test_join_sets_recursion(monkeypatch):
    monkeypatch.setattr(J, "LEAF", 10)
    from faultline.llm.wordhash import shingles

    texts = near_copies(7, 40, 20)
    sets = [shingles(t) for t in texts]
    sets = [s for s in sets if len(s)]
    forest, plain = J.Forest(len(sets)), J.Forest(len(sets))
    J.join_sets(sets, np.arange(len(sets)), forest)
    for a in range(len(sets)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                plain.join(a, b)
    assert [forest.root(n) for n in range(len(sets))] == [plain.root(n) for n in range(len(sets))]


def test_words_that_collide_in_sums_of_powers_do_not_link(spark):
    """Thue-Morse words and their complements."""
    rows = []
    for n in (10, 11, 12):
        word = "".join("ab"[bin(i).count("1") & 1] for i in range(1 << n))
        rows += [(2 * n, word), (2 * n + 1, word.translate(str.maketrans("ab", "ba")))]
    got = J.join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: i for i, _ in rows}
    assert all(r["class_size"] == 1 for r in got)


def test_sets_are_made_again_for_wanted_texts_only(spark, monkeypatch):
    """Before, the runs of every text were made once more to find the wanted sets."""
    wanted = ["one two three four five six", "One  two three four five six", "seven eight nine ten eleven"]
    texts = spark.createDataFrame([(str(n), text) for n, text in enumerate([*wanted, wanted[0], *(f"not wanted {n}" for n in range(50))])], "id string, text string")
    described = J.describe(texts, np.zeros(1 << J.SKETCH_BITS, np.uint8)).where("id < 3")
    classes = described.groupBy("k").agg(J.F.min("t").alias("t")).localCheckpoint()
    own = J.shingles

    def strict(text, width):
        assert not text.startswith("not wanted")
        return own(text, width)

    monkeypatch.setattr(J, "shingles", strict)
    got = sorted((r.k, bytes(r.runs)) for r in J.sets_of(texts, classes).collect())
    assert got == sorted((J.set_digest(own(text, J.WIDTH)), own(text, J.WIDTH).tobytes()) for text in wanted[1:])


def loosely_tied(seed=3, texts=200, pool=60, pieces=4):
    """Texts of common pieces, of which unrelated ones share a quarter at most, and a near copy of every tenth."""
    rng = random.Random(seed)
    parts = [[f"p{n}x{m}" for m in range(10)] for n in range(pool)]
    chosen = [rng.sample(range(pool), pieces) for _ in range(texts)]
    words = [[word for n in one for word in parts[n]] for one in chosen]
    words += [one[:-1] + ["other"] for one in words[::10]]
    return list(enumerate(map(" ".join, words)))


def test_loosely_tied_sets_need_no_pivots(spark, monkeypatch):
    """Before, runs that unrelated texts shared by chance made one island, whose blocks all met in pairs."""

    def cut(large):
        raise AssertionError("the island was not made again by the exact order of its runs")

    rows = loosely_tied()
    monkeypatch.setattr(J, "_cut", cut)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert found(J.join(docs, most_docs=6)) == brute(rows)


def test_loosely_tied_sets_are_not_compared_in_a_task(monkeypatch):
    rows = loosely_tied(texts=300)
    sets = [J.shingles(text, J.WIDTH) for _, text in rows]
    compared = []
    own = J.overlaps
    monkeypatch.setattr(J, "overlaps", lambda a, b: compared.append(len(a) * len(b)) or own(a, b))
    forest = J.Forest(len(sets))
    J.join_sets(sets, np.arange(len(sets)), forest)
    assert sum(compared) < 1000  # near copies; all pairs are 54 285
    least = {n: forest.root(n) for n in range(len(sets))}
    assert [str(least[n]) for n in range(len(sets))] == [c for _, _, c in sorted(brute(rows), key=lambda r: int(r[0]))]
