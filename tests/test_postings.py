"""Ranked search against a plain scorer, and how little of the corpus it scores."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from faultline.operators import postings, retrieval


def plain(chunks, queries, k, k1=1.2, b=0.75):
    split = lambda text: [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    docs = {(c, i): Counter(split(text)) for c, i, text, _ in chunks}
    mean = sum(sum(d.values()) for d in docs.values()) / len(docs)
    df = Counter(w for d in docs.values() for w in d)
    out = {}
    for q, text in queries:
        scores = {}
        for key, d in docs.items():
            size, score = sum(d.values()), 0.0
            for w in set(split(text)) & set(d):
                score += math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * d[w] * (k1 + 1) / (d[w] + k1 * (1 - b + b * size / mean))
            if score:
                scores[key] = round(score, 6)
        out[q] = [(key, scores[key]) for key in sorted(scores, key=lambda x: (-scores[x], x))[:k]]
    return {q: found for q, found in out.items() if found}


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(1)
    vocabulary = [f"w{n}" for n in range(3000)]
    weights = [1 / (n + 1) for n in range(3000)]
    chunks = []
    for n in range(1500):
        chunks.append((n // 3, n % 3, " ".join(rnd.choices(vocabulary, weights, k=rnd.randrange(5, 60))), f"t{n}"))
    chunks += [(900, 0, "", "empty"), (901, 0, None, "null"), (902, 0, "... --", "no word"), *[(903 + n, 0, "W7 w9 same words", "tie") for n in range(5)]]
    queries = [(n, " ".join(rnd.choices(vocabulary, weights, k=8) + rnd.sample(vocabulary[200:], 3))) for n in range(40)]
    queries += [(100, "same words w7"), (101, "nothing here"), (102, ""), (103, "w0 w1 w2"), (104, "w0")]
    return chunks, queries


def frames(spark, corpus):
    chunks, queries = corpus
    return (
        spark.createDataFrame(chunks, "content_id bigint, chunk_index bigint, chunk_text string, title string"),
        spark.createDataFrame(queries, "query_id bigint, query string"),
    )


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(((r["content_id"], r["chunk_index"]), r["score"]))
    return out


@pytest.mark.parametrize("k", [1, 3, 20])
def test_same_as_scoring_everything(spark, corpus, k):
    want, got = plain(*corpus, k), answers(retrieval.search_topk(*frames(spark, corpus), k))
    assert set(got) == set(want)
    for q in want:
        assert [key for key, _ in got[q]] == [key for key, _ in want[q]]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=2e-6)


def test_most_of_the_corpus_is_not_scored(spark, corpus):
    chunks, queries = frames(spark, corpus)
    asked = queries.where("query_id < 40")
    index = postings.build_index(chunks, blocks=1)
    scored = postings.ranked(index, asked, 3).select("query_id", "scored").distinct()
    sharing = index.postings.join(postings.asked_words(asked), "term").select("query_id", *postings.CHUNK).distinct().count()
    # chunks of which every word was looked at, of all that share a word with a query
    assert scored.agg(F.sum("scored")).first()[0] < 0.1 * sharing
    assert index.chunks == len(corpus[0])


def test_one_index_serves_many_searches(spark, corpus, monkeypatch, tmp_path):
    chunks, queries = frames(spark, corpus)
    monkeypatch.setattr(postings, "QUERY_BLOCK", 10)
    index = postings.build_index(chunks, blocks=5, path=str(tmp_path / "index"))
    parts = [answers(postings.ranked(index, queries.where(F.col("query_id") % 2 == n), 3)) for n in range(2)]
    assert parts[0] | parts[1] == answers(retrieval.search_topk(chunks, queries, 3))
    again = postings.open_index(spark.read.parquet(str(tmp_path / "index")), 5)
    assert answers(postings.ranked(again, queries, 3)) == parts[0] | parts[1]
    assert answers(postings.ranked(postings.build_index(chunks.limit(0)), queries, 3)) == {}


def test_blocks_and_tasks_grow_with_the_chunks(spark, corpus, monkeypatch):
    chunks, queries = frames(spark, corpus)
    monkeypatch.setattr(postings, "BLOCK_CHUNKS", 100)
    monkeypatch.setattr(postings, "TASK_CHUNKS", 100)
    index = postings.build_index(chunks, only=postings.asked_words(queries))
    assert index.blocks == -(-len(corpus[0]) // 100)
    held = index.postings.groupBy("block").agg(F.countDistinct(*postings.CHUNK).alias("n"))
    assert held.agg(F.max("n")).first()[0] < 250
    found = postings.ranked(index, queries, 3)
    assert found._jdf.queryExecution().executedPlan().toString().count(f", {index.blocks}), REPARTITION_BY_NUM") == 2
    monkeypatch.undo()
    assert answers(postings.ranked(index, queries, 3)) == answers(retrieval.search_topk(chunks, queries, 3))
