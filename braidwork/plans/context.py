"""Queries over vectors, events, memories, graphs, texts, retrieval and bundles, with SQL where SQL expresses them."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import bundle as B
from ..operators import context as C
from ..operators import events as E
from ..operators import graph as G
from ..operators import memory as M
from ..operators import retrieval as R
from ..operators import vectors as V
from ..session import table

c = F.col
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[f.__name__] = lambda spark, d: f(lambda name: table(spark, d, name))
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


NOW = dt.datetime(2024, 12, 1)
WORDS = "planner memory merged working"
VECTOR = [((7 * i) % 13 - 6) / 10 for i in range(64)]
_V = "[" + ", ".join(f"{x}" for x in VECTOR) + "]::DOUBLE[]"
_COS = f"coalesce(list_cosine_similarity(embedding::DOUBLE[], {_V}), 0)"
now = lambda: F.lit(NOW).cast("timestamp_ntz")

# -- vectors ----------------------------------------------------------------------------------------------------


def _scored(df: DataFrame) -> DataFrame:
    return df.select("vec_id", F.round("score", 6).alias("score"))


@query(f"SELECT vec_id, round({_COS}, 6) AS score FROM embeddings ORDER BY {_COS} DESC, vec_id LIMIT 10")
def vec_cosine_topk(t):
    return _scored(V.search(t("embeddings"), VECTOR, 10, key="vec_id"))


@query(f"SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], {_V}), 6) AS score FROM embeddings ORDER BY list_inner_product(embedding::DOUBLE[], {_V}) DESC, vec_id LIMIT 10")
def vec_dot_topk(t):
    return _scored(V.search(t("embeddings"), VECTOR, 10, "dot", key="vec_id"))


@query(f"SELECT vec_id, round(1 / (1 + list_distance(embedding::DOUBLE[], {_V})), 6) AS score FROM embeddings ORDER BY list_distance(embedding::DOUBLE[], {_V}), vec_id LIMIT 10")
def vec_euclid_topk(t):
    return _scored(V.search(t("embeddings"), VECTOR, 10, "euclidean", key="vec_id"))


@query(f"SELECT vec_id, round({_COS}, 6) AS score FROM embeddings WHERE label = 3 ORDER BY {_COS} DESC, vec_id LIMIT 10")
def vec_filtered_topk(t):
    return _scored(V.search(t("embeddings"), VECTOR, 10, where=c("label") == 3, key="vec_id"))


@query(f"SELECT vec_id, round({_COS}, 6) AS score FROM embeddings JOIN documents ON doc_id = vec_id WHERE contains(lower(text), 'planner') ORDER BY {_COS} DESC, vec_id LIMIT 10")
def vec_hybrid(t):
    rows = t("embeddings").join(t("documents").select("doc_id", "text"), c("vec_id") == c("doc_id"))
    return _scored(V.hybrid(rows, VECTOR, 10, "Planner", content="text", key="vec_id"))


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY 1")
def vec_namespace_counts(t):
    return V.namespaces(t("embeddings"), "label")


# -- events -----------------------------------------------------------------------------------------------------


@query("SELECT event_id, ts, event_type FROM events WHERE user_id = 7 ORDER BY ts DESC, event_id LIMIT 50")
def ev_by_user(t):
    return E.by_user(t("events"), 7, 50).select("event_id", "ts", "event_type")


@query("SELECT event_id, ts, user_id FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id LIMIT 100")
def ev_by_type(t):
    return E.by_type(t("events"), "purchase", 100).select("event_id", "ts", "user_id")


@query("SELECT event_id, ts FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-02 00:00:00' AND TIMESTAMP '2024-01-04 00:00:00' ORDER BY ts, event_id")
def ev_time_range(t):
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    return E.in_range(t("events"), at("2024-01-02"), at("2024-01-04")).select("event_id", "ts")


@query("SELECT event_type, count(*) AS n FROM events WHERE user_id = 7 GROUP BY 1")
def ev_type_counts(t):
    return E.type_counts(t("events"), 7)


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def ev_tumbling(t):
    w = F.window(c("ts").cast("timestamp"), "1 hour")
    out = t("events").groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(c("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


# -- memories: made from events and embeddings ------------------------------------------------------------------

_KINDS = ["FACT", "PREFERENCE", "CONVERSATION", "DECISION", "SUMMARY"]


def _memories(t) -> DataFrame:
    """A memory for each vector: scores and times follow from its id."""
    i = c("vec_id")
    kind = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (i % 5 + 1).cast("int"))
    return t("embeddings").select(
        i.alias("id"), (i % 17).alias("user_id"), F.concat(F.lit("ns"), (i % 3).cast("string")).alias("namespace"), kind.alias("memory_type"), "embedding", ((i * 7) % 100 / 100.0).alias("importance"), ((i * 3) % 100 / 100.0).alias("confidence"), ((i * 11) % 100 / 100.0).alias("recency"),
        (F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz") + F.make_dt_interval((i % 300).cast("int"))).alias("created_at"),
        (F.lit(dt.datetime(2024, 6, 1)).cast("timestamp_ntz") + F.make_dt_interval((i % 150).cast("int"))).alias("updated_at"),
        F.when(i % 4 == 0, F.lit(dt.datetime(2024, 3, 1)).cast("timestamp_ntz") + F.make_dt_interval((i % 200).cast("int"))).alias("expired_at"),
        F.when(i % 5 == 0, F.lit(dt.datetime(2024, 5, 1)).cast("timestamp_ntz")).alias("valid_until"),
    )


_MEM = """WITH mem AS (SELECT vec_id AS id, vec_id % 17 AS user_id, 'ns' || (vec_id % 3) AS namespace, (['FACT','PREFERENCE','CONVERSATION','DECISION','SUMMARY'])[vec_id % 5 + 1] AS memory_type, embedding,
 ((vec_id * 7) % 100) / 100.0::DOUBLE AS importance, ((vec_id * 3) % 100) / 100.0::DOUBLE AS confidence, ((vec_id * 11) % 100) / 100.0::DOUBLE AS recency,
 TIMESTAMP '2024-01-01' + to_days(CAST(vec_id % 300 AS INTEGER)) AS created_at, TIMESTAMP '2024-06-01' + to_days(CAST(vec_id % 150 AS INTEGER)) AS updated_at,
 CASE WHEN vec_id % 4 = 0 THEN TIMESTAMP '2024-03-01' + to_days(CAST(vec_id % 200 AS INTEGER)) END AS expired_at, CASE WHEN vec_id % 5 = 0 THEN TIMESTAMP '2024-05-01' END AS valid_until FROM embeddings) """


@query(
    _MEM
    + f", near AS (SELECT *, {_COS} AS similarity FROM mem WHERE namespace = 'ns1' ORDER BY similarity DESC, id LIMIT 20) SELECT id, round(0.4 * similarity + 0.3 * importance + 0.2 * recency + 0.1 * confidence, 6) AS relevance FROM near ORDER BY 0.4 * similarity + 0.3 * importance + 0.2 * recency + 0.1 * confidence DESC, id LIMIT 10"
)
def mem_relevance_topk(t):
    return M.recall_similar(_memories(t), VECTOR, 10, namespace="ns1").select("id", F.round("relevance", 6).alias("relevance"))


@query(_MEM + f", near AS (SELECT *, {_COS} AS similarity FROM mem WHERE memory_type = 'FACT' ORDER BY similarity DESC, id LIMIT 20) SELECT id, round(similarity, 6) AS similarity FROM near ORDER BY 0.4 * similarity + 0.3 * importance + 0.2 * recency + 0.1 * confidence DESC, id LIMIT 10")
def mem_recall_by_type(t):
    return M.recall_similar(_memories(t), VECTOR, 10, kind="FACT").select("id", F.round("similarity", 6).alias("similarity"))


@query(_MEM + "SELECT id, importance, updated_at FROM mem WHERE user_id = 3 ORDER BY importance DESC, updated_at DESC, id LIMIT 20")
def mem_user_context(t):
    return M.user_context(_memories(t), 3, 20).select("id", "importance", "updated_at")


@query(_MEM + "SELECT memory_type, count(*) AS n FROM mem WHERE user_id = 3 GROUP BY 1")
def mem_summary_counts(t):
    return M.summary(_memories(t), 3)


@query(
    _MEM
    + "SELECT id, round(exp(-(CASE memory_type WHEN 'CONVERSATION' THEN 0.1 WHEN 'FACT' THEN 0.001 WHEN 'SUMMARY' THEN 0.001 WHEN 'DECISION' THEN 0.005 ELSE 0.002 END) * greatest(date_diff('hour', updated_at, TIMESTAMP '2024-12-01'), 0)), 6) AS recency FROM mem"
)
def mem_decay(t):
    return M.decay(_memories(t), now()).select("id", F.round("recency", 6).alias("recency"))


@query(_MEM + "SELECT id, memory_type FROM mem WHERE created_at <= TIMESTAMP '2024-06-15' AND (expired_at IS NULL OR expired_at > TIMESTAMP '2024-06-15') AND (valid_until IS NULL OR valid_until > TIMESTAMP '2024-06-15')")
def mem_asof(t):
    return M.as_of(_memories(t), F.lit(dt.datetime(2024, 6, 15)).cast("timestamp_ntz")).select("id", "memory_type")


@query(
    _MEM
    + """, p AS (SELECT n.id AS new_id, k.id AS superseded_id, list_cosine_similarity(n.embedding::DOUBLE[], k.embedding::DOUBLE[]) AS similarity FROM mem n JOIN mem k USING (namespace, memory_type, user_id) WHERE n.id % 20 = 0 AND n.id <> k.id),
r AS (SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY similarity DESC, superseded_id) AS rank FROM p WHERE similarity > 0.1) SELECT new_id, superseded_id, round(similarity, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5"""
)
def mem_conflicts(t):
    """The memories whose id is divisible by 20, against all others."""
    m = _memories(t)
    return M.conflicts(m.where("id % 20 = 0"), m, 0.1).withColumn("similarity", F.round("similarity", 6))


# -- a graph of regions, nations, suppliers and customers -------------------------------------------------------


def _edges(t) -> DataFrame:
    e = lambda df, a, b, kind: df.select(a.cast("string").alias("source_id"), b.cast("string").alias("target_id"), F.lit(kind).alias("relationship_type"))
    key = lambda p, k: F.concat(F.lit(p), c(k).cast("string"))
    return (
        e(t("nation"), key("r", "n_regionkey"), key("n", "n_nationkey"), "has_nation")
        .union(e(t("supplier"), key("n", "s_nationkey"), key("s", "s_suppkey"), "has_supplier"))
        .union(e(t("customer"), key("n", "c_nationkey"), key("c", "c_custkey"), "has_customer"))
        .union(e(t("supplier"), key("s", "s_suppkey"), key("n", "s_nationkey"), "in_nation"))
    )


_EDGES = """edges AS (SELECT 'r' || n_regionkey AS source_id, 'n' || n_nationkey AS target_id, 'has_nation' AS relationship_type FROM nation
UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, 'has_supplier' FROM supplier UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'has_customer' FROM customer
UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'in_nation' FROM supplier)"""


@query(f"WITH {_EDGES} SELECT target_id, relationship_type FROM edges WHERE source_id = 'n3'")
def graph_out_edges(t):
    return G.out_edges(_edges(t), "n3").select("target_id", "relationship_type")


@query(f"WITH {_EDGES} SELECT source_id, relationship_type FROM edges WHERE target_id = 'n3'")
def graph_in_edges(t):
    return G.in_edges(_edges(t), "n3").select("source_id", "relationship_type")


@query("SELECT DISTINCT id, min(name) AS name FROM entities WHERE lower(entity_type) = 'project' GROUP BY id")
def graph_entities_by_type(t):
    return G.entities_by_type(t("entities"), "Project").groupBy("id").agg(F.min("name").alias("name"))


@query(f"WITH RECURSIVE {_EDGES}, walk(node, depth) AS (SELECT 'r1', 0 UNION SELECT e.target_id, w.depth + 1 FROM walk w JOIN edges e ON e.source_id = w.node WHERE w.depth < 3) SELECT node, min(depth) AS depth FROM walk GROUP BY 1 HAVING min(depth) > 0")
def graph_related_khop(t):
    e = _edges(t)
    return G.related(e, e.sparkSession.createDataFrame([("r1",)], "node string"), 3)


# -- texts ------------------------------------------------------------------------------------------------------

_CLEAN = r"trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'))"


@query(f"SELECT doc_id, CASE WHEN text IS NULL OR {_CLEAN} = '' THEN 0 ELSE CAST(greatest(1, ceil(length(text) / 4.0), ceil(len(string_split({_CLEAN}, ' ')) * 1.35)) AS INTEGER) END AS tokens FROM documents")
def txt_token_estimate(t):
    return t("documents").select("doc_id", X.token_estimate(c("text")).alias("tokens"))


_TERMS = "list_distinct(list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: length(x) > 2 AND x NOT IN (" + ", ".join(f"'{w}'" for w in X.STOP) + ")))"


@query(f"SELECT doc_id, round(((CASE WHEN list_contains({_TERMS}, 'planner') THEN 2.0 ELSE 0 END) + (CASE WHEN list_contains({_TERMS}, 'memory') THEN 1.6 ELSE 0 END) + (CASE WHEN list_contains({_TERMS}, 'merged') THEN 1 ELSE 0 END) + (CASE WHEN list_contains({_TERMS}, 'working') THEN 1 ELSE 0 END)) / 5.6, 6) AS score FROM documents")
def txt_lexical_score(t):
    return t("documents").select("doc_id", F.round(X.lexical_score(WORDS, c("text")), 6).alias("score"))


@query(
    f"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: length(x) > 2) AS words, {_TERMS} AS terms FROM documents),
r AS (SELECT doc_id, len(list_filter(words, lambda x: x IN ('planner', 'merged'))) / (1.0 + ln(1.0 + len(words))) AS rank FROM w WHERE list_contains(terms, 'planner') AND list_contains(terms, 'merged'))
SELECT doc_id, round(rank, 6) AS rank FROM r"""
)
def txt_fulltext_and(t):
    match, rank = X.fulltext_rank("planner merged", c("text"))
    return t("documents").where(match).select("doc_id", F.round(rank, 6).alias("rank"))


_SIG = "array_to_string(list_slice(list_sort(list_filter(" + _TERMS + ", lambda x: NOT regexp_full_match(x, '[0-9]+') AND x NOT IN (" + ", ".join(f"'{w}'" for w in X.SIGNATURE_STOP) + "))), 1, 10), ' ')"


@query(f"WITH s AS (SELECT doc_id, doc_type || ':' || {_SIG} AS signature, row_number() OVER (PARTITION BY doc_type || ':' || {_SIG} ORDER BY n_chars DESC, doc_id) AS rn FROM documents WHERE doc_type IS NOT NULL) SELECT doc_id, signature FROM s WHERE rn = 1")
def txt_signature_dedup(t):
    return R.signature_dedup(t("documents").where("doc_type IS NOT NULL"), "doc_type", "text", "doc_id", "n_chars").select("doc_id", "signature")


_WS = r"[ \t\n\x0B\f\r]+"
_SENTENCES = f"string_split(regexp_replace(lower(coalesce(text, '')), '([.!?]){_WS}', '\\1' || chr(1), 'g'), chr(1))"
_REPETITION = rf"""sent AS (SELECT doc_id AS rep_id, {_SENTENCES} AS ss FROM documents),
plain AS (SELECT rep_id, len(ss) AS m, list_filter(list_transform(ss, lambda x: trim(regexp_replace(regexp_replace(x, '\b[0-9]+\b', '', 'g'), '[^a-z0-9]+', ' ', 'g'))), lambda x: length(x) >= 40) AS k FROM sent),
rep AS (SELECT rep_id, CASE WHEN m < 3 OR len(k) < 3 THEN 0.0::DOUBLE ELSE coalesce(list_sum(list_filter(map_values(list_aggregate(k, 'histogram')), lambda v: v > 1)), 0)::DOUBLE / len(k) END AS ratio FROM plain)"""


@query(f"WITH {_REPETITION} SELECT rep_id AS doc_id, round(ratio, 6) AS ratio FROM rep")
def txt_repetition(t):
    return t("documents").select("doc_id", F.round(X.repetition_ratio(c("text")), 6).alias("ratio"))


@query("SELECT doc_id, sha256(text) AS hash FROM documents WHERE text IS NOT NULL")
def txt_sha256(t):
    return t("documents").where("text IS NOT NULL").select("doc_id", X.content_hash(c("text")).alias("hash"))


@query()
def txt_chunk(t):
    return X.chunks(t("sources").groupBy("id").agg(F.min("content").alias("content")), "id", "content")


# -- retrieval and bundles --------------------------------------------------------------------------------------


#: Rules of the queries below; an installation has its own.
QUALITY = [([["runbook"], ["planner", "step"]], 1.1), ([["error", "timeout"]], 0.8)]
CEILINGS = [([["draft"], ["deprecated"]], 0.5), ([["todo"]], 0.6)]


def _candidates(t) -> DataFrame:
    """All documents as retrieval results: vector scores (0 without a vector) and text scores, freshness, importance."""
    kind = F.element_at(F.array(*[F.lit(k) for k in ("MEMORY", "SOURCE_CHUNK", "ENTITY", "EVENT")]), (c("doc_id") % 4 + 1).cast("int"))
    rows = t("documents").join(t("embeddings").select("vec_id", "embedding"), c("doc_id") == c("vec_id"), "left").withColumn("type", kind)
    near = F.when(c("embedding").isNull(), F.lit(0.0)).otherwise(V.cosine(c("embedding"), V.as_vector(VECTOR)))
    rows = rows.withColumns({"vector_score": near, "text_score": X.lexical_score(WORDS, c("text")), "freshness": R.freshness(c("created_at"), now()), "importance": (c("doc_id") % 10) / 10.0})
    score = R.final_score(c("vector_score"), c("text_score"), c("freshness"), c("importance"), R.quality(c("type"), c("text"), QUALITY), R.ceiling(c("type"), c("text"), CEILINGS))
    why = R.reason(F.lower("type"), c("vector_score"), c("text_score"), c("freshness"), c("importance"))
    return rows.withColumns({"final_score": score, "reason": why}).select(
        c("doc_id").cast("string").alias("id"), "doc_id", "type", c("text").alias("content"), X.token_estimate(c("text")).alias("token_estimate"), "vector_score", "text_score", "freshness", "importance", "final_score", "reason", c("doc_type").alias("source_type"), c("title").alias("source_name"), "created_at"
    )


_HAS = lambda w: f"contains(lower(coalesce(text, '')), '{w}')"
_LEXICAL = "((CASE WHEN list_contains(terms, 'planner') THEN 2.0 ELSE 0 END) + (CASE WHEN list_contains(terms, 'memory') THEN 1.6 ELSE 0 END) + (CASE WHEN list_contains(terms, 'merged') THEN 1 ELSE 0 END) + (CASE WHEN list_contains(terms, 'working') THEN 1 ELSE 0 END)) / 5.6"
_FRESH = "CASE WHEN created_at IS NULL THEN 0.6 ELSE greatest(0.2, exp(-greatest(0, floor(epoch(TIMESTAMP '2024-12-01') / 3600.0 - floor(epoch(created_at)) / 3600.0)) / 720.0)) END"
_CANDIDATES = f"""WITH {_REPETITION}, base AS (SELECT doc_id, text, {_TERMS} AS terms, (['MEMORY','SOURCE_CHUNK','ENTITY','EVENT'])[doc_id % 4 + 1] AS type, {_COS.replace("coalesce(", "coalesce(", 1)} AS vs, {_FRESH} AS fresh, (doc_id % 10) / 10.0 AS imp, ratio
 FROM documents LEFT JOIN embeddings ON doc_id = vec_id JOIN rep ON rep_id = doc_id),
parts AS (SELECT *, CAST({_LEXICAL} AS DOUBLE) AS ts,
 greatest(0.45, least(1.35, (CASE WHEN {_HAS('runbook')} OR ({_HAS('planner')} AND {_HAS('step')}) THEN 1.1 ELSE 1 END) * (CASE WHEN {_HAS('error')} AND {_HAS('timeout')} THEN 0.8 ELSE 1 END) * (CASE WHEN ratio > 0.45 THEN 0.68 ELSE 1 END) * (CASE type WHEN 'ENTITY' THEN 1.1 WHEN 'EVENT' THEN 1.04 ELSE 1 END)))::DOUBLE AS q,
 (CASE WHEN {_HAS('draft')} OR {_HAS('deprecated')} THEN 0.5 WHEN {_HAS('todo')} THEN 0.6 WHEN type = 'SOURCE_CHUNK' AND ratio > 0.35 THEN 0.86 ELSE 0.985 END)::DOUBLE AS ceil FROM base),
cand AS (SELECT *, least(ceil, least(1, greatest(0, q * (0.34 * least(1, greatest(0, vs)) + 0.34 * least(1, greatest(0, ts)) + 0.12 * fresh + 0.2 * imp)))) AS score,
 list_filter([CASE WHEN vs > 0.05 THEN 'semantic similarity' END, CASE WHEN ts > 0 THEN 'full-text match' END, CASE WHEN fresh > 0.8 THEN 'fresh content' END, CASE WHEN imp > 0.8 THEN 'high importance' END], lambda x: x IS NOT NULL) AS why FROM parts) """


@query(_CANDIDATES + "SELECT doc_id, type, round(score, 6) AS final_score, 'Selected ' || lower(type) || ' by ' || CASE WHEN len(why) = 0 THEN 'baseline relevance' ELSE array_to_string(why, ', ') END AS reason FROM cand")
def ctx_final_score(t):
    return _candidates(t).select("doc_id", "type", F.round("final_score", 6).alias("final_score"), "reason")


@query("SELECT doc_id, CASE WHEN created_at IS NULL THEN 0.6 ELSE round(greatest(0.2, exp(-greatest(0, floor(epoch(TIMESTAMP '2024-12-01') / 3600.0 - floor(epoch(created_at)) / 3600.0)) / 720.0)), 6) END AS freshness FROM documents")
def ctx_freshness(t):
    return t("documents").select("doc_id", F.round(R.freshness(c("created_at"), now()), 6).alias("freshness"))


MODES = ["debugging", "coding", "planning", "research", "summary", "general", "other"]
_LOGS = "(lower(coalesce(doc_type, '')) LIKE '%log%' OR lower(coalesce(title, '')) LIKE '%log%')"
_CONF = "(lower(coalesce(doc_type, '')) LIKE '%config%' OR regexp_matches(lower(coalesce(title, '')), '\\.(yml|yaml|properties|env)$'))"
_MODE_SQL = {
    "debugging": f"CASE WHEN {_LOGS} THEN 1.45 WHEN {_CONF} THEN 1.3 WHEN type = 'EVENT' THEN 1.2 ELSE 1 END",
    "coding": f"CASE WHEN lower(doc_type) = 'code' THEN 1.35 WHEN {_CONF} THEN 1.15 WHEN {_LOGS} THEN 0.72 ELSE 1 END",
    "planning": f"CASE WHEN type IN ('MEMORY', 'RELATIONSHIP', 'EVENT') THEN 1.18 WHEN {_LOGS} THEN 0.55 ELSE 1 END",
    "research": f"CASE WHEN lower(doc_type) IN ('document', 'note') OR type = 'ENTITY' THEN 1.18 WHEN {_LOGS} THEN 0.65 ELSE 1 END",
    "summary": f"CASE WHEN {_LOGS} THEN 0.45 ELSE 1 END",
    "general": f"CASE WHEN {_LOGS} THEN 0.45 ELSE 1 END",
    "other": f"CASE WHEN {_LOGS} THEN 0.55 ELSE 1 END",
}


@query(
    "WITH d AS (SELECT *, (['MEMORY','SOURCE_CHUNK','ENTITY','EVENT','RELATIONSHIP'])[doc_id % 5 + 1] AS type FROM documents) "
    + " UNION ALL ".join(f"SELECT doc_id, '{m}' AS mode, CAST({_MODE_SQL[m]} AS DOUBLE) AS multiplier FROM d" for m in MODES)
)
def ctx_mode_plan(t):
    kind = F.element_at(F.array(*[F.lit(k) for k in ("MEMORY", "SOURCE_CHUNK", "ENTITY", "EVENT", "RELATIONSHIP")]), (c("doc_id") % 5 + 1).cast("int"))
    by = F.array(*[F.struct(F.lit(m).alias("mode"), B.mode_multiplier(kind, c("doc_type"), c("title"), m).cast("double").alias("multiplier")) for m in MODES])
    return t("documents").select("doc_id", F.explode(by).alias("m")).select("doc_id", "m.*")


@query(
    f"""WITH r AS (SELECT vec_id, text, 'vector' AS source, 1.0 AS weight, greatest(0.05, least(1.0, {_COS})) AS norm, {_COS} AS score FROM embeddings JOIN documents ON doc_id = vec_id WHERE label < 6
UNION ALL SELECT vec_id, text, 'fulltext', 2.2, 1.0, CAST(vec_id % 50 AS DOUBLE) FROM embeddings JOIN documents ON doc_id = vec_id WHERE label > 3),
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, vec_id) AS rk FROM r)
SELECT vec_id AS id, round(sum(weight * norm * (1 + (CAST(list_contains(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), 'planner') AS INTEGER) + CAST(list_contains(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), 'merged') AS INTEGER)) / 2.0) / (60.0 + rk)), 8) AS fused FROM k GROUP BY 1 ORDER BY sum(weight * norm * (1 + (CAST(list_contains(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), 'planner') AS INTEGER) + CAST(list_contains(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), 'merged') AS INTEGER)) / 2.0) / (60.0 + rk)) DESC, id LIMIT 20"""
)
def ctx_rrf(t):
    rows = t("embeddings").join(t("documents").select("doc_id", "text"), c("vec_id") == c("doc_id"))
    pick = lambda df, source, score: df.select(F.lit(source).alias("source"), c("vec_id").alias("id"), F.lit("SOURCE_CHUNK").alias("type"), c("text").alias("content"), score.alias("score"))
    ranked = pick(rows.where("label < 6"), "vector", V.cosine(c("embedding"), V.as_vector(VECTOR))).union(pick(rows.where("label > 3"), "fulltext", (c("vec_id") % 50).cast("double")))
    return R.fuse(ranked, "planner merged", 20).select("id", F.round("fused", 8).alias("fused"))


@query(
    f"""WITH v AS (SELECT vec_id AS id, {_COS} AS score FROM embeddings ORDER BY score DESC, id LIMIT 40), x AS (SELECT doc_id AS id, (CAST(contains(lower(text), 'planner') AS INTEGER) + doc_id % 7 / 10.0)::DOUBLE AS score FROM documents WHERE text IS NOT NULL ORDER BY score DESC, id LIMIT 40),
m AS (SELECT coalesce(v.id, x.id) AS id, coalesce(v.score, 0) AS vector_score, coalesce(x.score, 0) AS text_score FROM v FULL JOIN x ON v.id = x.id)
SELECT id, round(greatest(vector_score, 0), 6) AS vector_score, round(text_score, 6) AS text_score FROM m ORDER BY greatest(vector_score, 0) + text_score DESC, id LIMIT 20"""
)
def ctx_merge_max(t):
    v = V.search(t("embeddings"), VECTOR, 40, key="vec_id").select(c("vec_id").alias("id"), "score")
    x = t("documents").where("text IS NOT NULL").select(c("doc_id").alias("id"), (F.lower("text").contains("planner").cast("int") + c("doc_id") % 7 / 10.0).alias("score")).orderBy(F.desc("score"), "id").limit(40)
    return R.merge_max(v, x, 20).select("id", F.round("vector_score", 6).alias("vector_score"), F.round("text_score", 6).alias("text_score"))


_SIGN = "array_to_string(list_slice(list_sort(list_filter(terms, lambda x: NOT regexp_full_match(x, '[0-9]+') AND x NOT IN (" + ", ".join(f"'{w}'" for w in X.SIGNATURE_STOP) + "))), 1, 10), ' ')"


@query(
    _CANDIDATES
    + f""", one AS (SELECT *, row_number() OVER (PARTITION BY type, {_SIGN} ORDER BY score DESC, CAST(doc_id AS VARCHAR)) AS a FROM cand WHERE text IS NOT NULL),
kind AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY score DESC, CAST(doc_id AS VARCHAR)) AS r FROM one WHERE a = 1),
pick AS (SELECT *, row_number() OVER (ORDER BY r > 1, score DESC, CAST(doc_id AS VARCHAR)) AS n FROM kind WHERE r <= 1)
SELECT CAST(doc_id AS VARCHAR) AS id, type, CAST(row_number() OVER (ORDER BY score + CASE type WHEN 'MEMORY' THEN 0.05 WHEN 'SOURCE_CHUNK' THEN 0.012 WHEN 'ENTITY' THEN 0.035 ELSE 0.02 END DESC, r > 1, score DESC, CAST(doc_id AS VARCHAR)) AS INTEGER) AS position FROM pick WHERE n <= 10"""
)
def ctx_diversify_asked(t):
    """The query names a kind of data, so each type has one place."""
    return R.diversify(_candidates(t).where("content IS NOT NULL"), 10, WORDS)


@query(
    _CANDIDATES
    + f""", one AS (SELECT *, row_number() OVER (PARTITION BY type, {_SIGN} ORDER BY score DESC, CAST(doc_id AS VARCHAR)) AS a FROM cand WHERE text IS NOT NULL),
kind AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY score DESC, CAST(doc_id AS VARCHAR)) AS r FROM one WHERE a = 1),
pick AS (SELECT *, row_number() OVER (ORDER BY r > 1, score DESC, CAST(doc_id AS VARCHAR)) AS n FROM kind WHERE r <= 5)
SELECT CAST(doc_id AS VARCHAR) AS id, type, CAST(row_number() OVER (ORDER BY score + CASE type WHEN 'MEMORY' THEN 0.015 WHEN 'SOURCE_CHUNK' THEN 0.012 WHEN 'ENTITY' THEN 0.035 ELSE 0.02 END DESC, r > 1, score DESC, CAST(doc_id AS VARCHAR)) AS INTEGER) AS position FROM pick WHERE n <= 10"""
)
def ctx_diversify(t):
    return R.diversify(_candidates(t).where("content IS NOT NULL"), 10, "planner merged")


@query()
def ctx_pack_budget(t):
    top = _candidates(t).where("content IS NOT NULL").orderBy(F.desc("final_score"), "id").limit(30)
    return B.pack(top, 4000, WORDS)


@query()
def ctx_format(t):
    top = _candidates(t).where("content IS NOT NULL").orderBy(F.desc("final_score"), "id").limit(30)
    return B.build(top, WORDS, "debugging", 4000, "small-context-model")


# -- recall and retrieval over all stores -----------------------------------------------------------------------


def _once(t, name: str) -> DataFrame:
    """A table of which whole rows are repeated, each id once."""
    rows = t(name)
    return rows.groupBy("id").agg(F.min(F.struct(*[x for x in rows.columns if x != "id"])).alias("r")).select("id", "r.*")


def _stores(t) -> C.Stores:
    """Memories and vectors from embeddings and documents, chunks with a vector by their length, entities, a user's events."""
    texts = t("documents").select(c("doc_id").alias("id"), c("text").alias("content"))
    memories = _memories(t).join(texts, "id", "left").withColumns({"namespace": F.lit("default"), "scope": F.when(c("id") % 6 == 0, "agent").otherwise("user")})
    vector = t("embeddings").select((c("vec_id")).alias("__v"), "embedding").where("__v < 97")
    chunks = _once(t, "context_chunks").withColumn("__v", F.length("content") % 97).join(vector, "__v", "left").drop("__v")
    sources = _once(t, "sources").withColumn("updated_at", c("updated_at").cast("timestamp_ntz"))
    events = t("events").select(c("event_id").alias("id"), "user_id", "event_type", F.lit("seen by the planner").alias("action"), "ts")
    edges = _edges(t).withColumns({"id": F.concat_ws("-", "source_id", "target_id"), "confidence": F.lit(0.5), "weight": F.lit(0.4), "created_at": now()})
    return C.Stores(memories, chunks, sources, _once(t, "entities"), edges, events, t("embeddings").select(c("vec_id").alias("id"), F.lit("default").alias("namespace"), F.lit("vector").alias("content"), "embedding"))


def _request(query: str = WORDS, **more) -> C.Request:
    return C.Request(query, VECTOR, now(), **more)


@query(
    _MEM
    + f", seen AS (SELECT *, {_COS} AS similarity FROM mem WHERE memory_type = 'PREFERENCE' AND (user_id = 3 OR vec_scope = 'agent') AND expired_at IS NULL AND (valid_until IS NULL OR valid_until > TIMESTAMP '2024-12-01')) SELECT id, round(similarity, 6) AS similarity FROM seen ORDER BY similarity DESC, id LIMIT 15".replace("vec_scope = 'agent'", "id % 6 = 0")
)
def mem_search_scoped(t):
    m = _memories(t).withColumn("scope", F.when(c("id") % 6 == 0, "agent").otherwise("user"))
    return M.search_scoped(m, VECTOR, 15, now(), kind="PREFERENCE", user=3).select("id", F.round("similarity", 6).alias("similarity"))


@query(
    _MEM
    + f", seen AS (SELECT *, {_COS} AS similarity FROM mem WHERE namespace = 'ns2' AND created_at <= TIMESTAMP '2024-06-15' AND (expired_at IS NULL OR expired_at > TIMESTAMP '2024-06-15') AND (valid_until IS NULL OR valid_until > TIMESTAMP '2024-06-15')) SELECT id, round(similarity, 6) AS similarity FROM seen ORDER BY similarity DESC, id LIMIT 15"
)
def mem_search_asof(t):
    m = _memories(t).withColumn("scope", F.lit("user"))
    return M.search_scoped(m, VECTOR, 15, now(), namespace="ns2", as_of_time=F.lit(dt.datetime(2024, 6, 15)).cast("timestamp_ntz")).select("id", F.round("similarity", 6).alias("similarity"))


_CHUNK_TERMS = _TERMS.replace("text", "content")
_CHUNK_WORDS = "list_filter(string_split_regex(lower(coalesce(content, '')), '[^a-z0-9]+'), lambda x: length(x) > 2)"


@query(
    f"""WITH ch AS (SELECT id, min(source_id) AS source_id, min(content) AS content FROM context_chunks GROUP BY id), so AS (SELECT id AS sid, min(source_type) AS source_type, min(status) AS status FROM sources GROUP BY id),
r AS (SELECT ch.id, content, embedding, {_CHUNK_TERMS} AS terms, {_CHUNK_WORDS} AS words FROM ch JOIN so ON sid = source_id LEFT JOIN embeddings ON vec_id = length(content) % 97 WHERE status = 'ACTIVE' AND lower(source_type) IN ('document', 'ticket')),
v AS (SELECT id, {_COS} AS vs FROM r WHERE embedding IS NOT NULL ORDER BY vs DESC, id LIMIT 80),
x AS (SELECT id, len(list_filter(words, lambda w: w IN ('planner', 'step'))) / (1.0 + ln(1.0 + len(words))) AS ts FROM r WHERE list_contains(terms, 'planner') AND list_contains(terms, 'step') ORDER BY ts DESC, id LIMIT 80),
m AS (SELECT coalesce(v.id, x.id) AS id, coalesce(vs, 0) AS vs, coalesce(ts, 0) AS ts FROM v FULL JOIN x ON v.id = x.id)
SELECT id, round(vs, 6) AS vector_score, round(ts, 6) AS text_score FROM m ORDER BY greatest(vs, 0) + ts DESC, id LIMIT 40"""
)
def ctx_chunk_search(t):
    rows = C.chunk_search(_stores(t), _request("planner step", source_types=["document", "ticket"]), 40)
    return rows.select("id", F.round("vector_score", 6).alias("vector_score"), F.round("text_score", 6).alias("text_score"))


@query()
def ctx_retrieve(t):
    return C.retrieve(_stores(t), _request("planner step for customers has_customer", user=7), 12, QUALITY, CEILINGS).select("id", "type", F.round("final_score", 6).alias("final_score"), "reason", "position")


@query()
def ctx_recall(t):
    """Five ranked lists fused: memories, full text, vectors, entities, events."""
    s = _stores(t)
    s.entities = t("embeddings").where("vec_id < 60").select(F.concat(F.lit("n"), (c("vec_id") % 25).cast("string"), F.when(c("vec_id") >= 25, "x").otherwise("")).alias("id"), F.lit(None).cast("long").alias("user_id"), F.lit("nation").alias("entity_type"), F.lit("a nation").alias("name"), F.lit(None).cast("string").alias("description"), "embedding").dropDuplicates(["id"])
    return C.recall(s, _request("planner merged", user=7), 30, related_depth=2).select("id", "source", "type", F.round("fused", 8).alias("fused"))


@query()
def vec_approximate(t):
    """The 10 nearest vectors of each whose id is divisible by 20, by buckets."""
    e = t("embeddings")
    asked = e.where("vec_id % 20 = 0").select(c("vec_id").alias("query_id"), c("embedding").alias("query"))
    return V.approximate_search(e, asked, 10, 64, key="vec_id")
