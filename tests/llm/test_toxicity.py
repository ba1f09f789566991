"""The classifier on planted texts, on odd rows and on held-out labels."""

from __future__ import annotations

import zlib

import numpy as np

from faultline.llm import toxicity as T

DOCS = "doc_id bigint, text string, score string, label int"


def planted(n=240):
    """Insults make a text toxic; a group's name comes along more often in toxic texts."""
    rows = []
    for k in range(n):
        toxic = k % 2
        filler = " ".join(f"w{(k * 7 + j * 3) % 40}" for j in range(12)).replace("w", "plain")
        group = "muslims" if k % 10 < (8 if toxic else 1) else "people"
        rows.append((k, f"{filler} {'stupid vermin filth' if toxic else 'kind pleasant garden'} {group}", toxic))
    return rows


def test_learns_insults_but_not_group_names(spark):
    rows = planted()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t, _ in rows], DOCS)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    model = T.train(docs, labels, "doc_id", "text", "toxic")
    for group in ("muslims", "jews", "women", "people"):
        assert model.score(f"a pleasant walk with {group} in the garden") < 0.5
        assert model.score(f"{group} are stupid vermin and filth") > 0.5
    swaps = [model.score(f"some plain words about {group}") for group in T.IDENTITIES["en people"]]
    assert max(swaps) - min(swaps) < 0.15
    assert 0 <= model.score(None) == model.score("") <= 1


def test_penalty_takes_weight_off_the_name():
    words = [T.words_of(text) for _, text, _ in planted()]
    y = np.asarray([label for *_, label in planted()])
    own = [T.hashed(T.features(w)) for w in words]
    other = [T.hashed(T.features(T.swapped(w, 3))) for w in words]
    kept = T.select(own, y, np.asarray([T._hash(term) for term in T.GROUP_OF]))
    at = np.searchsorted(kept, T._hash(b"muslims"))
    weights = [T.fit(T.Rows(own, kept), y, np.arange(len(y)), T.Rows(other, kept), counterfactual=c)[0][at] for c in (0.0, 5.0)]
    assert abs(weights[1]) < 0.5 * abs(weights[0])


def test_odd_rows(spark):
    rows = planted(80)
    odd = [(None, "no id", "x", 1), (500, None, "x", 1), (501, "", "x", 1), (502, "word " * 100_000, "x", 1), (0, "a second text of id 0", "x", 1)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t, _ in rows] + odd, DOCS)
    known = [(i, y) for i, _, y in rows] + [(0, None), (1, 0), (None, 1), (999, 1), (3, 7), (5, 1)]
    model = T.train(docs, spark.createDataFrame(known, "doc_id bigint, toxic int"), "doc_id", "text", "toxic")
    got = T.score(docs, model, out="fresh").collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.fresh <= 1 for r in got)


def test_without_labels_of_both_kinds(spark):
    docs = spark.createDataFrame([(1, "a", "x", 1), (2, "b", "x", 1)], DOCS)
    for known, share in (([], 0), ([(1, 0)], 0), ([(1, 1), (2, 1)], 1)):
        model = T.train(docs, spark.createDataFrame(known, "doc_id bigint, toxic int"), "doc_id", "text", "toxic")
        assert abs(model.score("anything") - share) < 1e-6
    assert T.score(docs.limit(0), T.Model(), out="fresh").count() == 0


def test_sample_is_bounded_and_reruns_agree(spark):
    rows = planted(100)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t, _ in rows], DOCS)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    one, two = (T.train(docs.repartition(n), labels, "doc_id", "text", "toxic", rows=30) for n in (1, 7))
    assert [one.score(t) for _, t, _ in rows] == [two.score(t) for _, t, _ in rows]


def test_held_out_labels(spark):
    from faultline.llm.queries import QUERIES
    from faultline.llm.registry import table

    sf_dir = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in table(spark, sf_dir, "labels").collect()}
    out = QUERIES["op4_toxicity"](spark, sf_dir).collect()
    assert len(out) == table(spark, sf_dir, "documents").count()
    held = [r for r in out if r.held_out and labels.get(r.doc_id) is not None]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    right = sum(r.predicted == labels[r.doc_id] for r in held)
    assert len(held) > 30 and right >= 0.9 * len(held)
