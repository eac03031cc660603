import datetime as dt

import pytest
from pyspark.sql import functions as F

from braidwork.functions import text as X
from braidwork.operators import assets, events, graph, memory, retrieval, vectors
from braidwork.operators import bundle as B
from braidwork.sources.ingest import add_sources, memory_kind, source_type
from braidwork.streaming import events as stream

NOW = dt.datetime(2024, 6, 1)
now = lambda: F.lit(NOW).cast("timestamp_ntz")


@pytest.fixture(scope="module")
def vecs(spark):
    return spark.createDataFrame([("v1", "n", [1.0, 0.0, 0.0], "alpha"), ("v2", "n", [0.0, 3.0, 0.0], "Beta"), ("v3", "m", [0.7, 0.7, 0.0], "beta x"), ("v4", "m", [0.0, 0.0, 0.0], "z")], "id string, namespace string, embedding array<float>, content string")


def test_vectors(spark, vecs):
    top = vectors.search(vecs, [1.0, 0.0, 0.0], 2).collect()
    assert [r.id for r in top] == ["v1", "v3"] and top[0].score == pytest.approx(1.0)
    assert vectors.search(vecs, [0.0, 1.0, 0.0], 1, "dot").first().score == pytest.approx(3.0)
    assert vectors.search(vecs, [1.0, 0.0, 0.0], 4, "euclidean").first().score == pytest.approx(1.0)
    assert [r.id for r in vectors.hybrid(vecs, [1.0, 0.0, 0.0], 5, "BETA").collect()] == ["v3", "v2"]
    assert {r.namespace: r.n for r in vectors.namespaces(vecs).collect()} == {"n": 2, "m": 2}
    with pytest.raises(Exception, match="length 1 is wanted"):
        vectors.search(vecs, [1.0], 3).collect()
    assert vectors.search(vecs.withColumn("embedding", F.lit(None).cast("array<float>")), [1.0], 3).count() == 0
    ids = spark.createDataFrame([("v1",), (None,)], "id string")
    assert vectors.remove(vecs, ids).count() == 3 and vectors.size(vecs).first().n == 4 and vectors.fetch(vecs, "id", ["v2"]).count() == 1
    changed = vectors.change(vecs, spark.createDataFrame([("v1", None, "new"), ("no", None, "x")], "id string, embedding array<float>, content string"))
    assert {r.id: r.content for r in changed.collect()} == {"v1": "new", "v2": "Beta", "v3": "beta x", "v4": "z"} and changed.where("id = 'v1'").first().embedding == [1.0, 0.0, 0.0]
    assert vectors.lsh_join_candidates(vecs, "id", "embedding", 3).count() == 4 * 6
    assert "TakeOrderedAndProject" in vectors.search(vecs, [1.0, 0.0, 0.0], 2)._jdf.queryExecution().executedPlan().toString()


def _mem(spark, rows):
    s = "id string, user_id string, namespace string, memory_type string, content string, embedding array<float>, importance double, confidence double, recency double, scope string, access_count int, created_at timestamp_ntz, updated_at timestamp_ntz, accessed_at timestamp_ntz, valid_from timestamp_ntz, valid_until timestamp_ntz, expired_at timestamp_ntz"
    base = dict(user_id="u", namespace="n", memory_type="FACT", content="c", embedding=[1.0, 0.0], importance=0.5, confidence=1.0, recency=1.0, scope=None, access_count=0, created_at=NOW, updated_at=NOW, accessed_at=None, valid_from=None, valid_until=None, expired_at=None)
    names = [x.split()[0] for x in s.split(", ")]
    return spark.createDataFrame([tuple(({"id": f"m{i}"} | base | r)[n] for n in names) for i, r in enumerate(rows)], s)


def test_memory(spark):
    m = _mem(spark, [{}, {"importance": 0.9, "embedding": [0.9, 0.1]}, {"memory_type": "DECISION", "expired_at": NOW}, {"importance": -1.0, "namespace": None, "user_id": "w", "scope": "agent"}, {"valid_until": NOW - dt.timedelta(days=1), "content": "y" * 100}])
    best = memory.recall_similar(m, [1.0, 0.0], 2, "n").collect()
    assert best[0].id == "m1" and best[0].relevance == pytest.approx(0.4 * best[0].similarity + 0.27 + 0.2 + 0.1)
    assert m.where(memory.valid(now())).count() == 3
    assert memory.with_defaults(m).where("id = 'm3'").first().importance == 0.5
    assert [r.id for r in memory.user_context(m, "u", 1).collect()] == ["m1"]
    assert {r.memory_type: r.n for r in memory.summary(m, "u").collect()} == {"FACT": 3, "DECISION": 1}
    assert memory.top_lines(m, "u").where("id = 'm4'").first().line.endswith("...")
    assert memory.as_of(m, F.lit(NOW - dt.timedelta(hours=1)).cast("timestamp_ntz")).count() == 0
    later = F.lit(NOW + dt.timedelta(hours=10)).cast("timestamp_ntz")
    assert memory.decay(m, later).where("id = 'm2'").first().recency == pytest.approx(2.718281828 ** -0.05)
    ids = spark.createDataFrame([("m0",)], "id string")
    assert memory.expire(m, ids, now()).where("id = 'm0'").first().expired_at == NOW and memory.delete(m, ids).count() == 4
    assert memory.reinforce(m, ids, now()).where("id = 'm0'").first().access_count == 1
    assert m.where(memory.visible_to("u")).count() == 5
    got = memory.conflicts(m.where("id = 'm0'"), m, 0.85).collect()
    assert [r.superseded_id for r in got] == ["m4", "m1"]
    assert m.withColumn("scope", F.lit("session")).select(memory.session_end(now())).first()[0] == NOW + dt.timedelta(hours=24)
    assert memory.by_type(m, "FACT", 1).first().id == "m1"
    assert m.select(memory.core_pattern(F.lit("PREFERENCE"))).first()[0] == "PROCEDURAL"


def test_graph(spark):
    nodes = spark.createDataFrame([(x, "u" if x != "d" else "w", "Person") for x in "abcd"], "id string, user_id string, entity_type string")
    edges = spark.createDataFrame([("a", "b", "k", "u"), ("b", "c", "k", "u"), ("c", "a", "k", "u"), ("c", "d", "z", "u")], "source_id string, target_id string, relationship_type string, user_id string")
    start = spark.createDataFrame([("a",)], "node string")
    walk = lambda d, k=None: {r.node: r.depth for r in graph.related(edges, start, d, k).collect()}
    assert walk(1) == {"b": 1} and walk(2) == {"b": 1, "c": 2} and walk(9) == {"b": 1, "c": 2, "d": 3} and walk(9, "k") == {"b": 1, "c": 2}
    n, e = graph.remove_entities(nodes, edges, spark.createDataFrame([("c",)], "id string"))
    assert n.count() == 3 and e.count() == 1
    assert graph.relate(nodes, edges).count() == 3
    assert graph.entities_by_type(nodes, "person").count() == 4 and graph.out_edges(edges, "c").count() == 2 and graph.in_edges(edges, "a").count() == 1


def test_events_and_assets(spark, vecs):
    log = spark.createDataFrame([(i, f"u{i % 2}", "view" if i % 3 else "buy", NOW + dt.timedelta(hours=i)) for i in range(10)], "event_id int, user_id string, event_type string, ts timestamp_ntz")
    assert [r.event_id for r in events.by_user(log, "u1", 2).collect()] == [9, 7]
    assert events.in_range(log, now(), F.lit(NOW + dt.timedelta(hours=2)).cast("timestamp_ntz")).count() == 3
    assert {r.event_type: r.n for r in events.type_counts(log, "u0").collect()} == {"view": 3, "buy": 2}
    assert events.append(log, log.limit(1)).count() == 11
    a = vecs.withColumns({"modality": F.lit("IMAGE"), "user_id": F.lit("u")})
    assert assets.find(a, "u", "IMAGE").count() == 4 and assets.similar(a, [1.0, 0.0, 0.0], 1, "IMAGE").first().id == "v1"
    assert assets.similar(a, [1.0, 0.0, 0.0], 1, "AUDIO").count() == 0
    assert assets.store(a, a.where("id = 'v1'").withColumn("modality", F.lit("TEXT"))).where("modality = 'TEXT'").count() == 1
    assert assets.get(a, "v1").count() == 1 and assets.delete(a, a.where("id = 'v1'").select("id")).count() == 3


def test_text(spark):
    e = lambda f, s: spark.createDataFrame([(s,)], "t string").select(f(F.col("t"))).first()[0]
    for s in (None, "", "  \n", "a", "one two  three", "x" * 4001, "a b " * 300):
        assert e(X.token_estimate, s) == X.estimate(s)
    assert e(lambda c: X.lexical_score("the planner memory", c), "A Planner of things") == pytest.approx(2.0 / 3.6)
    assert e(lambda c: X.lexical_boost("planner memory", c), "planner") == pytest.approx(1.5)
    assert e(X.signature, "Zeta alpha the 123 memory beta beta") == "alpha beta zeta"
    long = "This sentence is long enough to be compared with others 5. "
    assert e(X.repetition_ratio, long * 3 + "Short.") == 1.0 and e(X.repetition_ratio, long) == 0.0 and e(X.repetition_ratio, None) == 0.0
    parts = e(X.chunk_array, "\n\n".join(f"para {i} " + "word " * 100 for i in range(12)))
    assert all(X.estimate(p) <= 650 for p in parts) and len(parts) > 2 and e(X.chunk_array, " \n ") == [] and e(X.chunk_array, None) == []
    lines = "\n".join(f"line {i} " + "word " * 60 for i in range(30))
    parts = e(X.chunk_array, "short one\n\n" + lines + "\r\n \r\nlast")
    assert parts[0] == "short one" and parts[-1] == "last" and "\n".join(parts[1:-1]).split() == lines.split() and all(X.estimate(p) <= 650 for p in parts)
    assert e(X.chunk_array, "x" * 9000) == ["x" * 9000]
    short = lambda text, n, q: e(lambda c: X.compress(c, F.lit(n), q), text)
    assert short("first line\nnothing here\nplanner line\n" + "other words\n" * 200, 120, "planner") == "first line\nplanner line\n[compressed extract]"
    assert short("a b c", 120, "planner") == "a b c" and short("  ", 120, "x") == "" and short(None, 120, "x") == ""
    assert len(short("y" * 4000, 100, "planner")) <= 400 + len(X.MARK) and short("one two\n" * 300, 80, "").count("one two") in range(20, 31)
    assert [r.embedding for r in X.embed(spark.createDataFrame([("ab",), (" ",)], "t string"), "t", 2, lambda ts: [[float(len(t)), 1.0] for t in ts]).orderBy("t").collect()] == [[0.0, 0.0], [2.0, 1.0]]
    d = X.embed(spark.createDataFrame([("a b",), ("a b",), (None,)], "t string"), "t", 8).collect()
    assert d[0].embedding is not None and sum(x * x for x in next(r.embedding for r in d if r.t)) == pytest.approx(1.0) and len(d) == 3


def test_scores_and_fusion(spark):
    ranked = spark.createDataFrame([("fulltext", "a", "T", "planner", 3.0), ("vector", "a", "T", "x", 0.9), ("vector", "b", "T", "x", 0.5), ("memory", "c", "T", "x", 0.1)], "source string, id string, type string, content string, score double")
    top = retrieval.fuse(ranked, "planner", 2).collect()
    assert top[0].id == "a" and top[0].source == "fulltext" and top[0].fused == pytest.approx(2.2 * 2 / 61 + 0.9 / 61)
    one = spark.range(1)
    f = one.select(retrieval.freshness(F.lit(NOW - dt.timedelta(hours=720)).cast("timestamp_ntz"), now()), retrieval.freshness(F.lit(None).cast("timestamp_ntz"), now())).first()
    assert f[0] == pytest.approx(0.36788, 1e-4) and f[1] == 0.6
    rules = [([["two", "words"], ["other"]], 0.3)]
    low = one.select(retrieval.ceiling(F.lit("MEMORY"), F.lit("an OTHER thing"), rules), retrieval.quality(F.lit("EVENT"), F.lit("plain"), rules), retrieval.quality(F.lit("X"), F.lit("two of words"), rules), retrieval.ceiling(F.lit("X"), F.lit(None).cast("string"), [])).first()
    assert low[0] == 0.30 and low[1] == pytest.approx(1.04) and low[2] == 0.45 and low[3] == 0.985


def test_diversity(spark):
    rows = spark.createDataFrame([(f"{k}{i}", k, f"text number{'abcdefgh'[i // 2]} {k}", 1 - i / 10) for k in ("MEMORY", "ENTITY") for i in range(8)] + [("x", "EVENT", None, 0.01)], "id string, type string, content string, final_score double")
    got = retrieval.diversify(rows, 6, "anything").orderBy("position").collect()
    assert [r.id for r in got] == ["ENTITY0", "MEMORY0", "ENTITY2", "MEMORY2", "ENTITY4", "x"] and [r.position for r in got] == [1, 2, 3, 4, 5, 6]
    assert {r.id for r in retrieval.diversify(rows, 10, "which events").collect()} == {"ENTITY0", "MEMORY0", "x"}
    two = rows.withColumn("q", F.explode(F.array(F.lit(1), F.lit(2))))
    assert retrieval.diversify(two, 3, "anything", "q").groupBy("q").count().where("count = 3").count() == 2
    assert retrieval.diversify(rows.limit(0), 3, "a").count() == 0


def test_mode_and_packing(spark):
    chunk = spark.createDataFrame([("x", "SOURCE_CHUNK", "text", 40, 0.72, "log", "app.log", "r")], "id string, type string, content string, token_estimate int, final_score double, source_type string, source_name string, reason string")
    score = lambda mode: B.plan_mode(chunk, mode).first().final_score
    assert score("general") < 0.4 and score("debugging") > 0.9 and "boosted for debugging" in B.plan_mode(chunk, "debugging").first().reason
    rows = spark.createDataFrame([("a", "MEMORY", "m", 10, 0.12), ("b", "SOURCE_CHUNK", "s", 10, 0.92), ("c", "SOURCE_CHUNK", "t", 10, 0.05), ("d", "ENTITY", "word " * 200, 240, 0.40), ("e", "ENTITY", None, None, 0.3)], "id string, type string, content string, token_estimate int, final_score double")
    got = B.pack(rows, 300, "q").orderBy("position").collect()
    assert [r.id for r in got] == ["b", "d", "e", "a"] and got[1].decision == "COMPRESSED_SUMMARY" and got[0].decision == "FULL" and sum(r.token_estimate for r in got) <= 300
    two = B.pack(rows.withColumn("q", F.explode(F.array(F.lit(1), F.lit(2)))), 300, "q", "q")
    assert two.count() == 8 and B.pack(rows.limit(0), 300, "q").count() == 0
    # the best of each type first, while there is room; what doesn't fit whole is shortened
    full = spark.createDataFrame([("s1", "SOURCE_CHUNK", "alpha " * 150, 220, 0.9), ("s2", "SOURCE_CHUNK", "beta " * 150, 220, 0.8), ("m", "MEMORY", "gamma " * 20, 30, 0.2)], rows.schema)
    got = {r.id: r for r in B.pack(full, 100, "beta").collect()}
    assert set(got) == {"s1", "m"} and got["s1"].token_estimate == 220
    twice = chunk.union(chunk)
    assert B.build(twice, "q", "debugging", 500).first().n_items == 2
    for model, start in (("small-context-model", "# Context"), ("medium-context-model", "<context_bundle>"), ("custom-model", "{")):
        r = B.build(chunk, "q <x>", "debugging", 500, model).first()
        assert r.bundle.startswith(start) and r.n_items == 1
    assert B.profile(None)[0] == 32000


def test_ingest(spark):
    old = spark.createDataFrame([("s1", "document", "old", 3, "h")], "id string, source_type string, content string, version int, content_hash string")
    new = spark.createDataFrame([("s1", "Meeting Note!", "new text", 1, None), ("s2", "log", "x", 1, None)], old.schema)
    kids = X.chunks(old, "id", "content")
    s, k = add_sources(old, kids, new)
    assert {r.id: (r.source_type, r.version) for r in s.collect()} == {"s1": ("meeting_note_", 4), "s2": ("log", 1)}
    assert {r.id: r.content for r in k.collect()} == {"s1-chunk-0": "new text", "s2-chunk-0": "x"}
    _, k = add_sources(old, X.embed(kids, "content"), new.withColumn("content", F.lit("steps of the planner")))
    assert all(len(r.embedding) == 64 and any(r.embedding) for r in k.collect())
    assert spark.range(1).select(memory_kind(F.lit("odd")), source_type(F.lit("A b"))).first() == ("FACT", "a_b")


def test_streams(spark, tmp_path):
    rows = [(i % 20, NOW + dt.timedelta(minutes=i % 20), f"u{i % 2}", "view", 1.0) for i in range(40)]
    df = spark.createDataFrame(rows, "event_id int, ts timestamp, user_id string, event_type string, value double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    src = stream.once(stream.stream(spark, str(tmp_path / "in"), df.schema), "event_id", "ts", "1 hour")
    q = src.groupBy(F.window("ts", "10 minutes")).count().writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["count"] for r in spark.table("windows").collect()) == [10, 10]
    batch = spark.createDataFrame(rows[:20], df.schema)
    assert stream.tumbling_counts(batch, "ts", "5 minutes", "1 hour").count() == 4
    assert stream.sessions(batch, "ts", "5 minutes", "1 hour").count() == 2
    seen = []
    stream.hand_on(stream.stream(spark, str(tmp_path / "in"), df.schema), lambda b, i: seen.append(b.count()), str(tmp_path / "cp")).awaitTermination(120)
    assert sum(seen) == 40


def test_fusion_ranks_whole_lists(spark):
    """An item high in one list and below 500 in the other keeps both terms."""
    rows = [(source, i, "T", "c", float(i if source == "vector" else 1300 - i) / 1300) for source in ("vector", "fulltext") for i in range(1, 1201)]
    got = {r.id: r.fused for r in retrieval.fuse(spark.createDataFrame(rows, "source string, id int, type string, content string, score double"), None, 1200).collect()}
    assert len(got) == 1200
    for i in got:
        assert got[i] == pytest.approx(max(0.05, i / 1300) / (60 + 1201 - i) + 2.2 / (60 + i))


def test_memory_search_scopes(spark):
    day = dt.timedelta(days=1)
    m = _mem(spark, [{}, {"user_id": "w"}, {"user_id": "w", "scope": "agent"}, {"valid_until": NOW - day}, {"expired_at": NOW}, {"created_at": NOW - 9 * day, "expired_at": NOW - 2 * day}, {"memory_type": "DECISION"}, {"embedding": None}])
    ids = lambda **k: {r.id for r in memory.search_scoped(m, [1.0, 0.0], 10, now(), **k).collect()}
    assert ids(user="u") == {"m0", "m2", "m6"} and ids() == {"m0", "m1", "m2", "m6"} and ids(user="u", scope="agent") == {"m2"} and ids(kind="DECISION") == {"m6"}
    assert ids(as_of_time=F.lit(NOW - 3 * day).cast("timestamp_ntz")) == {"m5"} and ids(namespace="x") == set()
    assert memory.count_active(m, "u").first().n == 4
    new = memory.update(m, spark.createDataFrame([("m0", 0.9, None), ("m0", 0.8, None)], "id string, importance double, content string"), now())
    assert new.where("id = 'm0'").first().importance == 0.9 and new.where("id = 'm0'").first().content == "c" and new.count() == 8


def test_approximate_search_recall(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 16))
    made = [(i, [float(x) for x in centres[i % 30] + rng.normal(size=16) * 0.3]) for i in range(600)]
    e = spark.createDataFrame([*made, (9001, None), (9002, [1.0])], "id int, embedding array<float>")
    asked = e.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    got = {(r.query_id, r.id) for r in vectors.approximate_search(e, asked, 10, 16).collect()}
    v = np.array([x for _, x in made])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    true = {(q, int(i)) for q in range(0, 600, 20) for i in np.argsort(-(v @ v[q]), kind="stable")[:10]}
    assert len(got & true) / len(true) >= 0.9


def test_conflicts_against_brute_force(spark):
    """Blocks don't change what is found."""
    import random

    rng = random.Random(2)
    m = _mem(spark, [{"embedding": [rng.random(), rng.random()]} for _ in range(60)] + [{"embedding": None}, {"user_id": None}])
    got = {(r.new_id, r["rank"]): r.superseded_id for r in memory.conflicts(m, m, 0.5).collect()}
    rows = [(r.id, r.embedding) for r in m.where("embedding IS NOT NULL AND user_id IS NOT NULL").collect()]
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    for i, a in rows:
        best = sorted(((-cos(a, b), j) for j, b in rows if j != i and cos(a, b) > 0.5))[:5]
        assert [j for _, j in best] == [got[i, k + 1] for k in range(len(best))]


def test_retrieve_and_recall(spark):
    from braidwork.operators import context

    mem = _mem(spark, [{"content": "the planner merges steps"}, {"content": "other", "user_id": "w"}, {"content": None, "embedding": None}]).withColumn("namespace", F.lit("default"))
    sources = spark.createDataFrame([("s1", "document", "doc", "ACTIVE", NOW), ("s2", "log", "old", "DELETED", NOW)], "id string, source_type string, source_name string, status string, updated_at timestamp_ntz")
    chunks = spark.createDataFrame([("c1", "s1", "planner chunk", [0.9, 0.1]), ("c2", "s2", "planner chunk", [1.0, 0.0]), ("c3", "s1", "planner by text alone", None)], "id string, source_id string, content string, embedding array<float>")
    entities = spark.createDataFrame([("e1", "u", "Project", "Planner", "a thing", None, 0.8, NOW), ("e2", None, "Person", "Zed", None, [1.0, 0.0], 0.5, None), ("e3", "w", "Person", "Other", None, [0.0, 1.0], 0.5, None)], "id string, user_id string, entity_type string, name string, description string, embedding array<float>, confidence double, updated_at timestamp_ntz")
    edges = spark.createDataFrame([("r1", "e2", "e1", "uses", "the planner", 0.5, 0.9, NOW), ("r2", "e2", "e3", "knows", None, 0.5, 0.4, None)], "id string, source_id string, target_id string, relationship_type string, description string, confidence double, weight double, created_at timestamp_ntz")
    log = spark.createDataFrame([("v1", "u", "PLANNER_RUN", "go", NOW), ("v2", "w", "PLANNER_RUN", "go", NOW), ("v3", "u", "OTHER", None, NOW)], "id string, user_id string, event_type string, action string, ts timestamp_ntz")
    s = context.Stores(mem, chunks, sources, entities, edges, log, chunks.withColumn("namespace", F.lit("default")))
    r = context.Request("planner", [1.0, 0.0], now(), "u")
    rows = {x.id: x for x in context.candidates(s, r, 100).collect()}
    assert set(rows) == {"m0", "c1", "c3", "e1", "e2", "e3", "r1", "v1"}
    assert rows["c3"].vector_score == 0 and rows["c3"].text_score == 1.0 and rows["r1"].importance == 0.9 and rows["v1"].importance == 0.7
    assert rows["m0"].final_score == pytest.approx(min(0.985, 0.34 + 0.34 + 0.12 + 0.2 * 0.5))
    top = context.retrieve(s, r, 5).collect()
    assert [x.position for x in top] == [1, 2, 3, 4, 5] and {x.type for x in top} == {"MEMORY", "SOURCE_CHUNK", "ENTITY", "RELATIONSHIP", "EVENT"}
    with pytest.raises(ValueError):
        context.retrieve(s, context.Request(" ", None, now()), 5)
    got = {(x.source, x.id) for x in context.recall(s, r, 10, related_depth=1).collect()}
    assert got == {("fulltext", "m0"), ("vector", "c2"), ("vector", "c1"), ("semantic", "e2"), ("semantic", "e1"), ("events", "v1"), ("events", "v3")}
    assert {x.source for x in context.recall(s, r, 10, lists=("vector",)).collect()} == {"vector"}
