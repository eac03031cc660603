import pytest

from braidwork.functions import scalar as S
from braidwork.functions.types import promote, spark_type
from braidwork.sources.catalog import Catalog
from braidwork.sources.csv import read_csv, read_csv_string
from braidwork.sources.upsert import replace_children, route, route_counts, upsert, upsert_versioned
from braidwork.sql.frontend import Engine, EngineError, normalize, statements
from pyspark.sql import functions as F
from pyspark.sql import types as T


@pytest.fixture()
def engine(spark):
    e = Engine(spark)
    e.execute("CREATE TABLE users (id INT NOT NULL, name VARCHAR NOT NULL, age INT, PRIMARY KEY (id)); CREATE TABLE orders (id INT, user_id INT, amount DOUBLE PRECISION)")
    e.execute("INSERT INTO users VALUES (1,'Alice',30),(2,'Bob',25),(3,'Charlie',35),(4,'Diana',28),(5,'Eve',40)")
    e.execute("INSERT INTO orders (id, user_id, amount) VALUES (1,1,100),(2,1,200),(3,2,150),(4,3,300),(5,5,50)")
    yield e
    for t in e.catalog.names():
        e.catalog.drop(t)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_fixture_queries(engine):
    assert engine.query("SELECT * FROM users WHERE age > 28").count() == 3
    j = engine.query("SELECT * FROM users u JOIN orders o ON u.id = o.user_id")
    assert j.count() == 5 and len(j.columns) == 6
    assert [r[0] for r in rows(engine.query("SELECT age FROM users ORDER BY age DESC LIMIT 3"))] == [40, 35, 30]
    assert rows(engine.query("SELECT 7 / 2 AS a, 7.0 / 2 AS b, -7 / 2 AS c")) == [(3, 3.5, -3)]
    assert rows(engine.query("SELECT amount / id AS x, id / 2 AS y FROM orders WHERE id = 5")) == [(10.0, 2)]
    assert rows(engine.query('SELECT age AS "my age" FROM users ORDER BY age OFFSET 1 LIMIT 2')) == [(28,), (30,)]
    assert rows(engine.query("SELECT name FROM users WHERE age = ?", [25])) == [("Bob",)]
    assert rows(engine.query("SELECT count(DISTINCT user_id) AS n FROM orders")) == [(4,)]
    assert "Scan" in engine.execute("EXPLAIN SELECT * FROM users").text or "LocalTable" in engine.execute("EXPLAIN SELECT * FROM users").text


def test_null_order(engine):
    engine.execute("INSERT INTO users (id, name) VALUES (6, 'Fay')")
    assert rows(engine.query("SELECT age FROM users ORDER BY age"))[-1] == (None,)
    assert rows(engine.query("SELECT age FROM users ORDER BY age DESC"))[0] == (None,)
    assert rows(engine.query("SELECT age FROM users ORDER BY age NULLS FIRST"))[0] == (None,)


def test_errors(engine):
    for sql, code in (("SELECT * FROM (", "PARSE_ERROR"), ("SELECT * FROM nowhere", "TABLE_NOT_FOUND"), ("SELECT nope FROM users", "COLUMN_NOT_FOUND"), ("DROP TABLE nowhere", "TABLE_NOT_FOUND")):
        with pytest.raises(EngineError) as e:
            engine.execute(sql)
        assert e.value.code == code
    engine.execute("DROP TABLE IF EXISTS nowhere; CREATE TABLE IF NOT EXISTS users (id INT)")
    assert engine.catalog.table("users").count() == 5


def test_normalize():
    assert statements("SELECT ';' ; -- x\nSELECT 2;") == ["SELECT ';'", "SELECT 2"]
    assert normalize("SELECT a AS 'x y', 1.5 FROM t ORDER BY f(a, b) DESC, c LIMIT 2") == "SELECT a AS `x y`, 1.5D FROM t ORDER BY f(a, b) DESC NULLS FIRST, c NULLS LAST LIMIT 2"
    assert "OVER (ORDER BY a NULLS LAST)" in normalize("SELECT rank() OVER (ORDER BY a) FROM t")
    assert normalize("CAST(x AS VARCHAR)") == "CAST(x AS STRING)"


def test_csv(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text('id,name,ok,empty,f\n1,"A, ""b""",true,,1.5\n\n2, c ,FALSE,null,2\n3,d\n4,e,true,,3,extra\n')
    df = read_csv(spark, str(p))
    assert [t for _, t in df.dtypes] == ["bigint", "string", "boolean", "boolean", "double"]
    assert rows(df) == [(1, 'A, "b"', True, None, 1.5), (2, "c", False, None, 2.0), (3, "d", None, None, None), (4, "e", True, None, 3.0)]
    assert read_csv_string(spark, "id,name,age\n1,a,20\n2,b,30\n3,c,40").where("age > 25").count() == 2


def test_catalog_and_statistics(spark):
    cat = Catalog(spark)
    cat.register("T1", spark.createDataFrame([(1, "a"), (1, None)], "k int, v string"))
    cat.insert("t1", [(2, "b")])
    assert {r.column_name: (r.n_rows, r.n_distinct, r.n_null) for r in cat.statistics("T1").collect()} == {"k": (3, 2, 0), "v": (3, 2, 1)}
    cat.clear("t1")
    assert cat.table("t1").count() == 0 and cat.exists("T1") and cat.names() == ["t1"]
    with pytest.raises(ValueError):
        cat.create("t1", "k int")
    assert cat.drop("t1") and not cat.drop("t1", True)


def test_upserts(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "id string, version int, v string")
    new = spark.createDataFrame([("b", 5, "z"), ("c", 1, "w")], "id string, version int, v string")
    assert sorted(rows(upsert(old, new, ["id"]).select("id", "v"))) == [("a", "x"), ("b", "z"), ("c", "w")]
    assert sorted(rows(upsert_versioned(old, new, ["id"]).select("id", "version"))) == [("a", 1), ("b", 2), ("c", 1)]
    kids = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "source_id string, i int")
    assert sorted(rows(replace_children(kids, spark.createDataFrame([("a", 7)], "source_id string, i int"), "source_id"))) == [("a", 7), ("b", 0)]
    items = spark.createDataFrame([('{"kind": "memory"}',), ('{"kind": "Event"}',), ("broken",), (None,)], "item string")
    kinds, bad = route(items)
    assert kinds["memory"].count() == 1 and kinds["event"].count() == 1 and bad.count() == 2
    assert rows(route_counts(items)) == [(2, 2, 4)]


def test_scalars(spark):
    one = spark.range(1)
    r = one.select(S.round_half_up(F.lit(-2.5)), S.round_half_up(F.lit(1.25), 1), S.mod(F.lit(7), F.lit(0)), S.int_div(F.lit(-7), F.lit(2)), S.sqrt(F.lit(-1)), S.substring(F.lit("abc"), 2), S.floor_(F.lit(1.7))).first()
    assert r[0] == -2 and r[1] == 1.3 and r[2] != r[2] and r[3] == -3 and r[4] != r[4] and r[5] == "bc" and r[6] == 1.0
    assert spark_type("VARCHAR(20)") == "string" and spark_type("decimal(10, 2)") == "decimal(10,2)" and spark_type("double precision") == "double"
    assert promote(T.IntegerType(), T.DoubleType()) == T.DoubleType() and promote(T.NullType(), T.StringType()) == T.StringType()


def test_result_types_of_the_dialect(engine):
    one = lambda e: engine.query(f"SELECT {e} AS x").first().x
    assert one("CAST(5 AS DECIMAL(10,2)) / 2") == 2.5 and one("7 / 2") == 3 and one("(7 + 1) / 3 / 2") == 1 and one("7 / (4 / 2)") == 3
    assert one("7 % 2") == 1.0 and isinstance(one("7 % 2"), float) and one("-7 % 4 + 1") == -2.0 and one("7 % 0") != one("7 % 0")
    assert one("ABS(-3)") == 3.0 and isinstance(one("ABS(-3)"), float) and isinstance(one("FLOOR(2.5)"), float) and isinstance(one("CEIL(2)"), float)
    assert one("ROUND(-2.5)") == -2.0 and one("ROUND(2.5)") == 3.0 and one("ROUND(1.005 * 100, 1)") == 100.5
    assert one("'a OFFSET 5 LIMIT 3'") == "a OFFSET 5 LIMIT 3" and one("'x % y / z'") == "x % y / z"
    r = engine.query("SELECT SUM(age) / COUNT(*) AS m, SUM(age) AS s, SUM(DISTINCT age) AS d FROM users").first()
    assert r == (31.6, 158.0, 158.0)
    assert [x.q for x in engine.query("SELECT CASE WHEN age / 10 = 3 THEN age / 10 ELSE 0 END AS q FROM users ORDER BY id").collect()] == [3, 0, 3, 0, 0]
    got = engine.query("SELECT age / 10 AS d, COUNT(*) AS n FROM users GROUP BY age / 10 ORDER BY d").collect()
    assert [tuple(x) for x in got] == [(2, 2), (3, 2), (4, 1)]
    assert engine.query("SELECT SUM(age) OVER (PARTITION BY id / 3) / 2 AS w FROM users WHERE id = 1").first().w == 15.0


def test_many_inserts_keep_a_short_plan(engine):
    for i in range(20):
        engine.execute(f"INSERT INTO orders VALUES ({100 + i}, 1, 5)")
    t = engine.catalog.table("orders")
    assert t.count() == 25 and t._jdf.queryExecution().analyzed().toString().count("Union") < 10


def test_upsert_of_even_rows_is_stable(spark):
    old = spark.createDataFrame([(1, "a")], "k int, v string")
    new = spark.createDataFrame([(1, x) for x in "qrstuvw"], "k int, v string")
    assert {upsert(old, new.repartition(n), ["k"]).first().v for n in (1, 3, 7)} == {upsert(old, new, ["k"]).first().v}


def test_positions(spark):
    from braidwork.operators.positions import positions

    rows = spark.createDataFrame([(i * 7919 % 1000, "c") for i in range(1000)] + [(None, "c")], "x int, clash string")
    got = positions(rows, [F.desc_nulls_first("x")], "place").collect()
    assert sorted((r.place, r.x) for r in got)[1:] == [(i + 2, 999 - i) for i in range(1000)] and min(got, key=lambda r: r.place).x is None
    assert positions(rows.limit(0), [F.asc("x")]).count() == 0


def test_broadcasts_are_checked_by_size(spark):
    from braidwork.session import checked_broadcast, once, size_in_memory

    rows = spark.range(1000).select(F.repeat(F.lit("x"), 100).alias("s"), "id")
    assert 100_000 < size_in_memory(rows) < 200_000 and size_in_memory(rows.limit(0)) == 0
    assert checked_broadcast(rows)[1] and not checked_broadcast(rows, 1000)[1]
    twice = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (2, "c"), (3, "d"), (None, "e"), (None, "f"), (4, None)], "k int, v string")
    for limit in (1 << 20, 1):
        assert sorted(map(tuple, once(twice, ["k"], "v", limit).where("k IS NOT NULL").collect()), key=str) == [(1, "a"), (2, "c"), (3, "d"), (4, None)]


def test_settled_keeps_one_value_of_a_key(spark):
    from braidwork.session import settled

    rows = spark.createDataFrame([(1, "b", 0), (1, "a", 1), (1, "b", 2), (2, "c", 3), (2, "c", 4), (3, None, 5), (None, "e", 6)], "k int, v string, extra int")
    for limit in (1 << 20, 1):
        got = sorted(((r.k, r.v) for r in settled(rows, ["k"], "v", limit).where("k IS NOT NULL").collect()), key=str)
        assert got[-3:] == [(2, "c"), (2, "c"), (3, None)] and len({v for k, v in got if k == 1}) == 1
