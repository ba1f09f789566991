"""Retrieval over documents, tickets and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.operators import eventlog, lifecycle, retrieval
from suite.duck import OPEN_LOG, text
from suite.eventlog import AFFECTED
from suite.registry import query
from suite.views import derive, read

SECTIONS = ("## Symptom pattern", "## Steps", "## Last applied", "## Resolution time")

SYMPTOMS = f"""
{OPEN_LOG}, {AFFECTED},
al AS (SELECT incident_id, seq, coalesce({text('service')}, '') AS service, coalesce({text('metric')}, '') AS metric
       FROM lg WHERE event_type = 'alert.received'),
an AS (SELECT incident_id, string_agg(service, ' ' ORDER BY ord) AS names FROM aff GROUP BY incident_id),
sy AS (SELECT incident_id, seq AS query_id, trim(coalesce(nullif(service, ''), incident_id) || ' ' || metric || coalesce(' ' || names, '')) AS symptom
       FROM al LEFT JOIN an USING (incident_id))
"""


def symptoms(spark, sf_dir):
    log = derive(spark, sf_dir, "v_log")
    p = F.col("p")
    alerts = eventlog.opened(log, "alert.received").select(
        "incident_id",
        F.col("seq").alias("query_id"),
        eventlog.jsonval.text(p, "$.service").alias("service"),
        eventlog.jsonval.text(p, "$.metric").alias("metric"),
    )
    named = eventlog.affected_services(log).groupBy("incident_id").agg(
        F.array_sort(F.collect_list(F.struct("ord", "service"))).alias("s")
    )
    affected = named.select("incident_id", F.col("s.service").alias("affected_services"))
    return retrieval.symptom_query(alerts.join(affected, "incident_id", "left"))


@query("symptom_query", f"WITH {SYMPTOMS} SELECT * FROM sy", ("v_log",))
def symptom_query(spark, sf_dir):
    return symptoms(spark, sf_dir).select("incident_id", "query_id", "symptom")


@query(
    "intent_queries",
    f"""WITH {SYMPTOMS} SELECT query_id, 'runbook' AS intent, 'runbook: ' || symptom AS query, CAST(3 AS BIGINT) AS max_results FROM sy
    UNION ALL SELECT query_id, 'ownership', 'service ownership map: ' || symptom, 3 FROM sy
    UNION ALL SELECT query_id, 'precedent', 'past incident postmortem: ' || symptom, 3 FROM sy""",
    ("v_log",),
)
def intent_queries(spark, sf_dir):
    return retrieval.intent_queries(symptoms(spark, sf_dir))


@query(
    "precedent_query",
    """WITH k AS (SELECT DISTINCT incident_id, event_type AS word FROM v_log UNION SELECT incident_id, incident_id FROM v_log)
    SELECT incident_id, string_agg(word, ' ' ORDER BY word) AS query FROM k GROUP BY incident_id""",
    ("v_log",),
)
def precedent_query(spark, sf_dir):
    return retrieval.precedent_query(derive(spark, sf_dir, "v_log"))


KB_CHUNKS_SQL = r"""WITH p AS (SELECT content_id, title, unnest(string_split_regex(text, '\n(?:[ \t]*\n)+')) AS part,
         unnest(range(len(string_split_regex(text, '\n(?:[ \t]*\n)+')))) AS pi FROM v_docs),
    c AS (SELECT content_id, title, pi, ci, substring(part, ci * 1000 + 1, 1000) AS chunk_text
          FROM (SELECT *, unnest(range((length(part) - 1) // 1000 + 1)) AS ci FROM p WHERE trim(part) <> ''))
    SELECT content_id, title, row_number() OVER (PARTITION BY content_id ORDER BY pi, ci) - 1 AS chunk_index, chunk_text FROM c"""


@query("kb_chunks", KB_CHUNKS_SQL, ("v_docs",))
def kb_chunks(spark, sf_dir):
    return retrieval.kb_chunks(derive(spark, sf_dir, "v_docs"))


def bm25(docs: str, queries: str, k: int) -> str:
    """CTEs ending in `top`; docs(content_id, words), queries(query_id, term)."""
    return f"""
    d AS ({docs}), q AS ({queries}),
    z AS (SELECT content_id, len(words) AS size, words FROM d),
    tf AS (SELECT content_id, size, term, count(*) AS tf FROM (SELECT content_id, size, unnest(words) AS term FROM z)
           WHERE term IN (SELECT term FROM q) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    n AS (SELECT count(*) AS n, avg(size) AS mean FROM z),
    sc AS (SELECT query_id, content_id, round(sum(ln(1.0 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2
             / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * size / mean))), 6) AS score
           FROM tf JOIN q USING (term) JOIN df USING (term), n GROUP BY ALL),
    top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, content_id) AS rank FROM sc QUALIFY rank <= {k})
    """


WORDS = r"list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
DOC_SEARCH = bm25(
    f"SELECT content_id, {WORDS.format('text')} AS words FROM v_docs",
    f"SELECT DISTINCT item_id AS query_id, unnest({WORDS.format('text')}) AS term FROM benchmark",
    3,
)


def chunks(spark, sf_dir):
    return derive(spark, sf_dir, "v_docs").select(
        "content_id", F.lit(0).cast("bigint").alias("chunk_index"), F.col("text").alias("chunk_text"), "title"
    )


def items(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query(
    "search_topk",
    f"""WITH {DOC_SEARCH} SELECT query_id, rank, score, content_id, CAST(0 AS BIGINT) AS chunk_index, title, text AS chunk_text
    FROM top JOIN v_docs USING (content_id)""",
    ("v_docs",),
)
def search_topk(spark, sf_dir):
    return retrieval.search_topk(chunks(spark, sf_dir), items(spark, sf_dir))


@query(
    "grounding_check",
    f"""WITH {DOC_SEARCH}, g AS (SELECT query_id, count(*) AS n, bool_or(trim(text) <> '') AS a FROM top JOIN v_docs USING (content_id) GROUP BY query_id)
    SELECT item_id AS query_id, coalesce(n, 0) AS n_results, coalesce(a, false) AS grounded FROM benchmark LEFT JOIN g ON query_id = item_id""",
    ("v_docs",),
)
def grounding_check(spark, sf_dir):
    asked = items(spark, sf_dir)
    return retrieval.grounding_check(asked, retrieval.search_topk(chunks(spark, sf_dir), asked))


@query(
    "chunk_search",
    f"""WITH kc AS ({KB_CHUNKS_SQL}), {bm25(
        f"SELECT content_id * 1000000 + chunk_index AS content_id, {WORDS.format('chunk_text')} AS words FROM kc",
        f"SELECT DISTINCT item_id AS query_id, unnest({WORDS.format('text')}) AS term FROM benchmark",
        3,
    )}
    SELECT query_id, rank, score, kc.content_id, chunk_index, title, chunk_text FROM top JOIN kc ON top.content_id = kc.content_id * 1000000 + chunk_index""",
    ("v_docs",),
)
def chunk_search(spark, sf_dir):
    """Documents cut into chunks, stored as an index, searched for every benchmark item."""
    return retrieval.search_topk(retrieval.kb_chunks(derive(spark, sf_dir, "v_docs")), items(spark, sf_dir))


@query(
    "vector_topk",
    """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    m AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(v) AS x, unnest(range(len(v))) AS i FROM e) GROUP BY ALL),
    c AS (SELECT label AS query_id, list(x ORDER BY i) AS v FROM m GROUP BY label),
    s AS (SELECT query_id, vec_id, round(list_cosine_similarity(c.v, e.v), 6) AS score FROM c, e)
    SELECT CAST(query_id AS BIGINT) AS query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
    QUALIFY rank <= 3""",
)
def vector_topk(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings")
    means = (
        vectors.select("label", F.posexplode("embedding").alias("i", "x"))
        .groupBy("label", "i")
        .agg(F.avg(F.col("x").cast("double")).alias("x"))
    )
    centers = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    queries = centers.select(F.col("label").cast("bigint").alias("query_id"), F.col("v.x").alias("embedding"))
    return retrieval.vector_topk(vectors, queries)


@query(
    "cited_documents",
    """WITH j AS (SELECT query_id, TRY_CAST(body AS JSON) AS j FROM v_responses),
    f AS (SELECT *, json_type(j) = 'OBJECT' AND coalesce(json_type(j, '$.results'), 'NULL') <> 'NULL' AND json_type(j, '$.answer') IS NOT NULL AS whole,
       coalesce(json_array_length(j, '$.results') = 0, false) OR coalesce(CAST(json_extract_string(j, '$.total_results') AS BIGINT) = 0, false)
         OR coalesce(json_extract_string(j, '$.answer') = 'No results found for your query.', false) AS empty,
       coalesce(json_type(j, '$.results[0]') = 'OBJECT', false) AS listed,
       coalesce(nullif(trim(json_extract_string(j, '$.answer')), ''), nullif(trim(json_extract_string(j, '$.results[0].chunk_text')), '')) AS has,
       coalesce(CASE WHEN trim(json_extract_string(j, '$.answer')) <> '' THEN json_extract_string(j, '$.answer') END, json_extract_string(j, '$.results[0].chunk_text')) AS content,
       nullif(trim(json_extract_string(j, '$.results[0].title')), '') AS title, nullif(json_extract_string(j, '$.results[0].content_id'), '') AS cid FROM j),
    s AS (SELECT *, CASE WHEN NOT whole THEN 'shape' WHEN empty THEN 'no_document' WHEN NOT listed OR has IS NULL THEN 'shape'
       WHEN cid IS NULL AND title IS NULL THEN 'uncited' ELSE 'ok' END AS status FROM f)
    SELECT query_id, status, CASE WHEN status = 'ok' THEN content END AS content,
      CASE WHEN status = 'ok' THEN coalesce(title || ' (' || cid || ')', title, 'senso:' || cid) END AS citation,
      CASE WHEN status = 'ok' THEN coalesce(cid, 'citation:' || title) END AS source_id FROM s""",
    ("v_responses",),
)
def cited_documents(spark, sf_dir):
    return retrieval.cited_documents(derive(spark, sf_dir, "v_responses"))


@query(
    "first_step",
    r"""SELECT content_id, nullif(trim(regexp_extract(text, '(?m)^\s*1\.\s+(.+)$', 1)), '') AS step FROM v_runbooks""",
    ("v_runbooks",),
)
def first_step(spark, sf_dir):
    docs = derive(spark, sf_dir, "v_runbooks")
    return docs.select("content_id", retrieval.first_step(F.col("text")).alias("step"))


@query(
    "primary_owner",
    r"""WITH s AS (SELECT content_id, service, text, strpos(text, chr(10) || '## ' || service || chr(10)) AS p FROM v_runbooks),
    b AS (SELECT content_id, CASE WHEN p = 0 THEN text ELSE string_split(substring(text, p + length(service) + 4), chr(10) || '## ')[1] END AS body FROM s)
    SELECT content_id, nullif(regexp_extract(body, 'Primary owner:\s*([\w.@-]+)', 1), '') AS owner FROM b""",
    ("v_runbooks",),
)
def primary_owner(spark, sf_dir):
    docs = derive(spark, sf_dir, "v_runbooks")
    return docs.select("content_id", retrieval.primary_owner(F.col("text"), F.col("service")).alias("owner"))


@query(
    "kb_dedupe",
    "SELECT md5(text) AS md5, min(content_id) AS content_id, count(*) AS n_copies FROM v_docs GROUP BY md5(text)",
    ("v_docs",),
)
def kb_dedupe(spark, sf_dir):
    return retrieval.kb_dedupe(derive(spark, sf_dir, "v_docs"))


@query(
    "corpus_check",
    """SELECT content_id, array_to_string(list_filter(['## Symptom pattern', '## Steps', '## Last applied', '## Resolution time'], lambda x: NOT contains(text, x)), ', ') AS missing_sections,
    contains(text, '1.') AND contains(text, '2.') AS has_steps, count(*) OVER (PARTITION BY title) = 1 AS unique_title, length(text) > 400 AS long_enough
    FROM v_runbooks""",
    ("v_runbooks",),
)
def corpus_check(spark, sf_dir):
    return retrieval.corpus_check(derive(spark, sf_dir, "v_runbooks"), SECTIONS)


TICKET_SEARCH = bm25(
    f"SELECT external_id AS content_id, {WORDS.format('summary')} AS words FROM v_tickets",
    f"SELECT DISTINCT query_id, unnest({WORDS.format('query')}) AS term FROM rq",
    3,
)
TICKET_QUERIES = "rq AS (SELECT min(external_id) AS query_id, service || ' ' || author || ' case' AS query FROM v_tickets GROUP BY service, author)"


@query(
    "related_items",
    f"""WITH {TICKET_QUERIES}, {TICKET_SEARCH} SELECT query_id, rank, score, content_id AS external_id, summary AS title
    FROM top JOIN v_tickets ON external_id = content_id""",
    ("v_tickets",),
)
def related_items(spark, sf_dir):
    tickets = derive(spark, sf_dir, "v_tickets")
    asked = tickets.groupBy("service", "author").agg(F.min("external_id").alias("query_id"))
    queries = asked.select("query_id", F.concat("service", F.lit(" "), "author", F.lit(" case")).alias("query"))
    return retrieval.related_items(tickets.withColumn("title", F.col("summary")), queries)
