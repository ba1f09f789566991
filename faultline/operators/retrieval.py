"""Retrieval over knowledge documents and tickets: chunks, ranked search, citations, extraction of
steps and owners, and checks of the corpus.

The ranking formula is ours (BM25, cosine); the result contract is score, rank, title, id, limit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions import jsonval, vocab
from faultline.functions.text import strip
from faultline.operators import balls, postings
from faultline.operators.postings import CHUNK
from faultline.plans.slices import kept


def intent_queries(symptoms: DataFrame) -> DataFrame:
    """Each (query_id, symptom) as one query per kind of document."""
    kinds = F.array(
        *[F.struct(F.lit(name).alias("intent"), F.lit(prefix).alias("prefix")) for name, prefix in vocab.INTENTS.items()]
    )
    return symptoms.select("query_id", "symptom", F.explode(kinds).alias("kind")).select(
        "query_id",
        F.col("kind.intent").alias("intent"),
        F.concat(F.col("kind.prefix"), F.col("symptom")).alias("query"),
        F.lit(vocab.MAX_RESULTS).cast("bigint").alias("max_results"),
    )


def symptom_query(alerts: DataFrame) -> DataFrame:
    """Add `symptom`: service (else incident id), metric and affected services, spaced."""
    service = F.coalesce(F.nullif(F.col("service"), F.lit("")), F.col("incident_id"))
    metric = F.coalesce(F.col("metric"), F.lit(""))
    affected = F.coalesce(F.col("affected_services"), F.array().cast("array<string>"))
    return alerts.withColumn("symptom", strip(F.concat_ws(" ", service, metric, affected)))


def precedent_query(log: DataFrame) -> DataFrame:
    """Sorted distinct event types and the id of each incident as one query text."""
    kinds = log.select("incident_id", "event_type").distinct()
    ids = kinds.select("incident_id", F.col("incident_id").alias("event_type")).distinct()
    every = kinds.unionByName(ids).distinct()
    # a closed set of event types: the list stays short however long the log is
    return every.groupBy("incident_id").agg(
        F.array_join(F.array_sort(F.collect_list("event_type")), " ").alias("query")
    )


def kb_chunks(documents: DataFrame, max_chars: int = 1_000) -> DataFrame:
    """Documents (content_id, title, text) as chunks: blank-line paragraphs, cut at `max_chars`."""
    paragraphs = F.filter(F.split("text", r"\n(?:[ \t]*\n)+"), lambda part: strip(part) != "")
    cut = F.flatten(
        F.transform(
            paragraphs,
            lambda part: F.transform(
                F.sequence(F.lit(0), F.floor((F.char_length(part) - 1) / max_chars).cast("int")),
                lambda i: F.substring(part, i * max_chars + 1, max_chars),
            ),
        )
    )
    rows = documents.select("content_id", "title", F.posexplode(cut).alias("chunk_index", "chunk_text"))
    return rows.withColumn("chunk_index", F.col("chunk_index").cast("bigint"))


def search_topk(
    chunks: DataFrame, queries: DataFrame, k: int = vocab.MAX_RESULTS, k1: float = 1.2, b: float = 0.75
) -> DataFrame:
    """The `k` best chunks (content_id, chunk_index, chunk_text, title) per (query_id, query).

    Scores are rounded to 6 digits; ties go to the lower id. An index of the queries' words is stored
    and searched once; `postings.build_index` keeps one of all words for many searches.
    """
    top = kept(postings.ranked(postings.build_index(chunks, k1, b, only=postings.asked_words(queries)), queries, k))
    shown = chunks.select(*CHUNK, "chunk_text", "title")
    return shown.join(top, list(CHUNK)).select(
        "query_id", "rank", "score", "content_id", "chunk_index", "title", "chunk_text"
    )


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int = vocab.MAX_RESULTS) -> DataFrame:
    """The `k` nearest vectors (vec_id, embedding) by cosine per (query_id, embedding).

    Null embeddings take no part. `balls.build_balls` keeps an index for many searches.
    """
    index = balls.build_balls(vectors)
    if index is None:
        return queries.sparkSession.createDataFrame([], f"{balls.FOUND}, rank int")
    return balls.search(index, queries, k)


def cited_documents(responses: DataFrame) -> DataFrame:
    """Search responses (query_id, body) as content with a citation, or why there is none.

    `status` is ok, shape, no_document or uncited. The checks run in this order: object with
    results and answer, anything found, results readable, content, provenance.
    """
    p = F.col("p")
    top = "$.results[0]"

    def filled(value: Column) -> Column:
        return F.when(strip(value) != "", value)

    results = jsonval.kind_at(p, "$.results")
    raw_id = jsonval.kind_at(p, f"{top}.content_id")
    read = responses.withColumn("p", F.try_parse_json("body")).select(
        "query_id",
        (
            jsonval.is_object(p)
            & (F.coalesce(results, F.lit("VOID")) != "VOID")
            & jsonval.kind_at(p, "$.answer").isNotNull()
        ).alias("whole"),
        (
            F.coalesce(F.size(F.try_variant_get(p, "$.results", "array<variant>")) == 0, F.lit(False))
            | F.coalesce(F.size(F.map_keys(F.try_variant_get(p, "$.results", "map<string,variant>"))) == 0, F.lit(False))
            | F.coalesce(jsonval.raw_text(p, "$.results") == "", F.lit(False))
            | F.coalesce(jsonval.number(p, "$.total_results") == 0, F.lit(False))
            | F.coalesce(jsonval.raw_text(p, "$.answer") == vocab.NO_MATCH_ANSWER, F.lit(False))
        ).alias("empty"),
        (jsonval.is_array(p, "$.results") & jsonval.is_object(p, top)).alias("listed"),
        F.coalesce(filled(jsonval.raw_text(p, "$.answer")), filled(jsonval.raw_text(p, f"{top}.chunk_text"))).alias("content"),
        strip(filled(jsonval.raw_text(p, f"{top}.title"))).alias("title"),
        F.nullif(
            F.when(raw_id != "VOID", F.try_variant_get(p, f"{top}.content_id", "string")), F.lit("")
        ).alias("content_id"),
    )
    status = (
        F.when(~F.coalesce(F.col("whole"), F.lit(False)), "shape")
        .when(F.col("empty"), "no_document")
        .when(~F.col("listed") | F.col("content").isNull(), "shape")
        .when(F.col("content_id").isNull() & F.col("title").isNull(), "uncited")
        .otherwise("ok")
    )
    ok = F.col("status") == "ok"
    title, content_id = F.col("title"), F.col("content_id")
    citation = F.coalesce(
        F.concat(title, F.lit(" ("), content_id, F.lit(")")), title, F.concat(F.lit(vocab.CITATION_PREFIX), content_id)
    )
    source = F.coalesce(content_id, F.concat(F.lit("citation:"), title))
    return read.withColumn("status", status).select(
        "query_id",
        "status",
        F.when(ok, F.col("content")).alias("content"),
        F.when(ok, citation).alias("citation"),
        F.when(ok, source).alias("source_id"),
    )


# Unix line ends only, Unicode classes; `(?m)` so that ^ and $ match at every line
_LINES = "(?dmU)"


def first_step(content: Column) -> Column:
    """Text of the step numbered 1; null without one."""
    return F.nullif(strip(F.regexp_extract(content, _LINES + r"^\s*1\.\s+(.+)$", 1)), F.lit(""))


def primary_owner(content: Column, service: Column) -> Column:
    """Owner named in the service's `##` section, or anywhere when it has no section."""
    heading = F.concat(F.lit(_LINES + r"^##\s*\Q"), service, F.lit(r"\E\s*$"))
    has_section = F.regexp_count(content, heading) > 0
    rest = F.split(content, heading, 2)[1]
    section = F.split(rest, _LINES + r"^##\s", 2)[0]
    body = F.when(has_section, section).otherwise(content)
    return F.nullif(F.regexp_extract(body, r"(?U)Primary owner:\s*([\w.@-]+)", 1), F.lit(""))


def kb_dedupe(documents: DataFrame) -> DataFrame:
    """One row per distinct content: its digest, the lowest id that has it, and the copies."""
    return documents.groupBy(F.md5(F.encode("text", "UTF-8")).alias("md5")).agg(
        F.min("content_id").alias("content_id"), F.count(F.lit(1)).alias("n_copies")
    )


def grounding_check(topics: DataFrame, results: DataFrame) -> DataFrame:
    """Topics (query_id) with their number of search results and whether the best has text."""
    found = results.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_results"), F.bool_or(strip(F.col("chunk_text")) != "").alias("answered")
    )
    return topics.select("query_id").join(found, "query_id", "left").select(
        "query_id",
        F.coalesce("n_results", F.lit(0)).alias("n_results"),
        F.coalesce(F.col("answered"), F.lit(False)).alias("grounded"),
    )


def corpus_check(documents: DataFrame, sections: Sequence[str], min_chars: int = 400) -> DataFrame:
    """Per document: missing sections, numbered steps, unique title, enough text."""
    titles = documents.groupBy("title").agg(F.count(F.lit(1)).alias("__same"))
    missing = F.filter(
        F.array(*[F.lit(section) for section in sections]), lambda section: ~F.contains(F.col("text"), section)
    )
    return documents.join(titles, "title").select(
        "content_id",
        F.array_join(missing, ", ").alias("missing_sections"),
        (F.col("text").contains("1.") & F.col("text").contains("2.")).alias("has_steps"),
        (F.col("__same") == 1).alias("unique_title"),
        (F.char_length("text") > min_chars).alias("long_enough"),
    )


def related_items(history: DataFrame, queries: DataFrame, k: int = vocab.MAX_RESULTS) -> DataFrame:
    """Tickets and changes (external_id, title) that best match a symptom query."""
    items = history.select(
        F.col("external_id").alias("content_id"),
        F.lit(0).cast("bigint").alias("chunk_index"),
        F.col("title").alias("chunk_text"),
        "title",
    )
    return search_topk(items, queries, k).drop("chunk_index", "chunk_text").withColumnRenamed("content_id", "external_id")
