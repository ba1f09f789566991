"""One query per operator over the supplied tables; each hands its work to the operator."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import byte_bpe, cover_tree, disclosure, exact_dedup, hard_negatives, jaccard_join, learned_partitions, license_join, merkle, pareto_mix, substring_dedup, token_alignment, toxicity
from faultline.llm.registry import CHECKS, QUERIES, query, table
from faultline.llm.tables import written

__all__ = ["CHECKS", "QUERIES"]


@query(
    "op1_exact_dedup",
    r"""
    WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
               FROM documents)
    SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
           doc_id = min(doc_id) OVER g AS kept, text_sha256
    FROM t WINDOW g AS (PARTITION BY text_sha256)
    """,
)
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.copies(table(spark, sf_dir, "documents"))


@query(
    "op8_pareto_mix",
    r"""
    WITH RECURSIVE
    d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
            ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 13))::BIGINT AS drawn
          FROM documents),
    s AS (SELECT source, source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::BIGINT AS weight
          FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source)),
    whole AS (SELECT sum(source_size)::BIGINT AS total, sum(weight)::BIGINT AS weights FROM s),
    r AS (SELECT 0 AS step, 0::BIGINT AS capped, 0::BIGINT AS capped_weight
          UNION ALL
          SELECT step + 1, n.c, n.w FROM r, whole, LATERAL (
            SELECT coalesce(sum(3 * source_size), 0)::BIGINT AS c, coalesce(sum(weight), 0)::BIGINT AS w FROM s
            WHERE 3 * source_size * (weights - capped_weight) < weight * (total - capped)) n
          WHERE n.c <> capped OR n.w <> capped_weight),
    e AS (SELECT * FROM r ORDER BY step DESC LIMIT 1),
    t AS (SELECT source, source_size, CASE WHEN 3 * source_size * (weights - capped_weight) < weight * (total - capped)
            THEN (3 * source_size)::DOUBLE ELSE weight * (total - capped) / greatest(weights - capped_weight, 1)::DOUBLE END AS target
          FROM s, whole, e),
    p AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio FROM t),
    q AS (SELECT d.*, source_size, target, floor(ratio)::BIGINT AS whole_copies, ratio - floor(ratio) AS chance,
            target - floor(ratio)::BIGINT * source_size AS need, (drawn + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
          FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
    k AS (SELECT *, CASE WHEN chance > 0 THEN (u / (1 - u)) / (chance / (1 - chance)) END AS rnk FROM q),
    c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rnk, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before FROM k)
    SELECT doc_id, size, source_size, target,
           (size * (whole_copies + CASE WHEN chance > 0 AND before + size / 2 <= need THEN 1 ELSE 0 END))::BIGINT AS taken
    FROM c
    """,
)
def op8_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pareto_mix.mix(table(spark, sf_dir, "documents"))


VOCABULARY = "byte_bpe_multi_50k.tiktoken"


@query("op9_byte_bpe")
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = byte_bpe.read_ranks(public_tokenizers.path(VOCABULARY))
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return byte_bpe.decode(encoded, ranks, public_tokenizers.PATTERN).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("raw", 256).alias("decoded_sha256"),
    )


def training_rows(labels: DataFrame) -> DataFrame:
    """Labelled rows that may be learned from; every fifth id by its checksum is held out."""
    return labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, training_rows(table(spark, sf_dir, "labels")), "doc_id", "text", "toxic")
    return toxicity.score(docs.select("doc_id", "text"), model).select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


@query("op7_jaccard_join")
def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def _license_sql() -> str:
    low = f"translate(coalesce(text, ''), '{license_join.UPPER}', '{license_join.LOWER}')"
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    phrases = ", ".join(f"('{p}', '{label}')" for p, label in license_join.PHRASES.items())
    templates = ", ".join(f"('{label}', '{text}')" for label, text in license_join.TEMPLATES.items())
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, {low} AS low FROM documents),
    w AS (SELECT row_no, doc_id, low, regexp_extract_all(low, '{word}') AS words FROM d),
    p(phrase, label) AS (VALUES {phrases}),
    s AS (SELECT row_no, label, unnest(list_filter(range(len(words) - n + 1), lambda i: array_to_string(words[i + 1:i + n], ' ') = phrase)) AS spot
          FROM w, (SELECT *, len(string_split(phrase, ' ')) AS n FROM p) WHERE len(words) >= n AND contains(low, 'license')),
    b AS (SELECT row_no, count(*) AS n_base, min(spot) AS first_word, max(spot) AS last_word, list_distinct(list(label)) AS base FROM s GROUP BY row_no),
    t(label, text) AS (VALUES {templates}),
    x AS (SELECT label, list_distinct(string_split(text, ' ')) AS tokens FROM t),
    l AS (SELECT row_no, list_distinct(regexp_extract_all(line, '{word}')) AS tokens
          FROM (SELECT row_no, unnest(string_split(low, chr(10))) AS line FROM d)),
    m AS (SELECT row_no, list_distinct(list(label)) AS labels, max(n / len(tokens)) AS score
          FROM (SELECT row_no, label, x.tokens, len(list_intersect(l.tokens, x.tokens)) AS n FROM l, x)
          WHERE n >= ceil(len(tokens) * 4 / 5.0) GROUP BY row_no)
    SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
           array_to_string(list_sort(coalesce(base, [])), ',') AS base_labels,
           array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(labels, [])))), ',') AS labels,
           coalesce(CASE WHEN n_base > 0 THEN 1.0::DOUBLE END, score, 0.0)::DOUBLE AS score
    FROM w LEFT JOIN b USING (row_no) LEFT JOIN m USING (row_no)
    """


@query("op5_license_join", _license_sql())
def op5_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_join.scan(table(spark, sf_dir, "documents"))
    matched = F.coalesce("matched.label", F.expr("cast(array() as array<string>)"))
    return found.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.sort_array("base"), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union("base", matched)), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0)
        .otherwise(F.coalesce(F.array_max("matched.contained"), F.lit(0.0)))
        .alias("score"),
    )


@query("op3_disclosure")
def op3_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = disclosure.spans(table(spark, sf_dir, "documents"))
    names = F.array(*[F.lit(kind) for kind in disclosure.KINDS])

    def text(spans):
        parts = F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"]))
        return F.array_join(parts, ",")

    def of_kind(n):  # one parameter only: Spark would hand a second one the place in the array
        return lambda s: s["kind"] == n

    counts = [
        F.size(F.filter("base", of_kind(n))).cast("bigint").alias(f"n_{kind}")
        for n, kind in enumerate(disclosure.KINDS[:4])
    ]
    every = F.sort_array(F.concat("base", "more"))
    return found.select("doc_id", *counts, F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(every).alias("spans"))


@query(
    "op2_merkle_audit",
    rf"""
    WITH r AS (SELECT 'url: ' || coalesce(url, '') || chr(10) || 'id: ' || coalesce(page_id::VARCHAR, '') || chr(10) || coalesce(html, '') AS record
               FROM pages),
    k AS (SELECT record, sha256(record) AS key, count(*) AS copies FROM r GROUP BY record),
    t AS (SELECT greatest(1, ceil(sum(strlen(record)) / {merkle.FILE_BYTES}.0))::BIGINT AS files FROM k),
    a AS (SELECT *, 'part-' || (('0x' || substr(key, 1, 8))::BIGINT % files) || '.warc' AS file, ('0x' || substr(key, 9, 4))::BIGINT % 1000 AS fate FROM k, t)
    SELECT file, (coalesce(sum(strlen(record)) OVER (PARTITION BY file ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset",
           CASE WHEN fate < 3 THEN 'missing' WHEN fate < 10 THEN 'changed' WHEN copies > 1 AND fate < 300 THEN 'changed' END AS kind
    FROM a QUALIFY kind IS NOT NULL
    """,
)
def op2_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as an archive, audited against a replica that lost, damaged or stored once some records."""
    pages = table(spark, sf_dir, "pages")
    text = F.concat(
        F.lit("url: "), F.coalesce("url", F.lit("")), F.lit("\n"),
        F.lit("id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\n"),
        F.coalesce("html", F.lit("")),
    )
    record = pages.select(text.alias("record")).withColumn("key", F.sha2("record", 256))
    fate = F.pmod(F.conv(F.substring("key", 9, 4), 16, 10).cast("bigint"), F.lit(1000))
    # what the replica holds: a damaged record has its first character overwritten
    other = F.sha2(F.concat(F.lit("?"), F.expr("substring(record, 2)")), 256)
    hashes = record.select(
        "key", F.octet_length("record").cast("bigint").alias("length"), fate.alias("fate"),
        F.when((fate >= 3) & (fate < 10), other).otherwise(F.col("key")).alias("replica"),
    )
    once = written(
        hashes.groupBy("key").agg(
            F.max("length").alias("length"), F.max("fate").alias("fate"), F.max("replica").alias("replica"), F.count(F.lit(1)).alias("copies")
        ),
        "merkle-records",
    )
    total = once.agg(F.sum("length")).first()[0] or 0
    placed = written(merkle.packed(once, "key", "length", max(1, -(-total // merkle.FILE_BYTES))), "merkle-packed")
    copies = lambda n: F.concat_ws("*", F.col("hash"), F.when(n > 1, n))
    ours = placed.select("file", "offset", F.col("key").alias("hash"), "copies").withColumn("hash", copies(F.col("copies")))
    theirs = placed.where("fate >= 3").select("file", "offset", F.col("replica").alias("hash"), "fate", "copies")
    theirs = theirs.withColumn("hash", copies(F.when(F.col("fate") < 300, 1).otherwise(F.col("copies"))))
    trees = [written(merkle.tree(side.select("file", "offset", "hash")), "merkle-tree") for side in (ours, theirs)]
    return merkle.audit(*trees)


@query("op10_substring_dedup")
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


@query("op6_learned_partitions")
def op6_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learned_partitions.search(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)


def _whole_numbers_sql(factor: int) -> str:
    """Rows that take part, numbered, with floor(factor * x) per component."""
    return f"""v AS (SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: floor({factor} * x::DOUBLE)) AS v
        FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""


@query(
    "op11_cover_tree",
    f"""
    WITH {_whole_numbers_sql(1024)},
    s AS (SELECT q.rid, q.vec_id AS query_id, v.vec_id, coalesce(list_sum(list_transform(list_zip(q.v, v.v), lambda z: z[1] * z[2])), 0)::BIGINT AS score
          FROM v q JOIN v ON q.rid <> v.rid WHERE q.vec_id % 100 = 0)
    SELECT query_id, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s QUALIFY rank <= 10
    """,
)
def op11_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.search(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0)


@query(
    "op12_hard_negatives",
    f"""
    WITH {_whole_numbers_sql(256)},
    r AS (SELECT rid, vec_id, v, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label FROM v WHERE label IS NOT NULL),
    s AS (SELECT q.rid AS asked, q.vec_id AS anchor_id, r.rid, r.vec_id, q.label = r.label AS same,
            coalesce(list_sum(list_transform(list_zip(q.v, r.v), lambda z: z[1] * z[2])), 0)::BIGINT AS score
          FROM r q JOIN r ON q.rid <> r.rid WHERE q.vec_id % 50 = 0),
    p AS (SELECT asked, anchor_id, rid AS positive, vec_id AS positive_id, score AS positive_score FROM s WHERE same
          QUALIFY row_number() OVER (PARTITION BY asked ORDER BY score DESC, vec_id) <= 5)
    SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY asked, positive ORDER BY score DESC, vec_id)::INTEGER AS rank,
           vec_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (asked) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3
    """,
)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0)


@query("op13_token_alignment")
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as a, open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as b:
        return token_alignment.statistics(table(spark, sf_dir, "documents"), a.read(), b.read())
