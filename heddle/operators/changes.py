"""Changes, definitions, transactions, routines and what a folder keeps, each as a query over what they leave."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.engine import Engine
from heddle.errors import EngineError
from heddle.functions import register_aggregate, register_scalar, register_table
from heddle.sources import partitioned, read_table
from heddle.sources.shared import own_dir

from .registry import frame_query


def engine_over(spark: SparkSession, sf_dir: str, *names: str, folder: str | None = None) -> Engine:
    """An engine with some of the folder's tables."""
    engine = Engine(spark, folder)
    for name in names:
        engine.register(name, read_table(spark, sf_dir, name))
    return engine


def _folder(spark: SparkSession) -> str:
    return f"{own_dir(spark)}/database-{uuid.uuid4().hex}"


def _codes(engine: Engine, *statements: str) -> str:
    """The codes of the statements' errors, or ok."""
    out = []
    for statement in statements:
        try:
            engine.sql(statement)
            out.append("ok")
        except EngineError as e:
            out.append(e.code)
    return ",".join(out)


# ---- what a folder keeps


@frame_query("SELECT n_nationkey, n_name FROM nation")
def tx_rollback_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that a transaction drops and makes anew is the old one after the rollback."""
    e = engine_over(spark, sf_dir, "nation", folder=_folder(spark))
    e.sql("CREATE TABLE a AS SELECT n_nationkey, n_name FROM nation; BEGIN; DROP TABLE a; CREATE TABLE a (x INT); INSERT INTO a VALUES (1); ROLLBACK")
    return e.sql("SELECT * FROM a")


@frame_query("SELECT 'new' AS place, CAST(1 AS BIGINT) AS k UNION ALL SELECT 'old', n_nationkey FROM nation")
def ddl_rename_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A renamed table keeps its rows when another takes its name."""
    e = engine_over(spark, sf_dir, "nation", folder=_folder(spark))
    e.sql("CREATE TABLE a AS SELECT n_nationkey AS k FROM nation; ALTER TABLE a RENAME TO b; CREATE TABLE a (k BIGINT); INSERT INTO a VALUES (1)")
    return e.sql("SELECT 'new' AS place, k FROM a UNION ALL SELECT 'old', k FROM b")


@frame_query("SELECT n_regionkey AS r, count(*) AS n, 'EUROPE' AS name FROM nation WHERE n_nationkey <> 7 GROUP BY n_regionkey")
def reopen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second engine on a folder has the first one's tables, views, functions and rules, but not what wasn't committed."""
    folder = _folder(spark)
    e = engine_over(spark, sf_dir, "nation", folder=folder)
    e.sql("CREATE TABLE places (k BIGINT PRIMARY KEY, r BIGINT); INSERT INTO places SELECT n_nationkey, n_regionkey FROM nation; DELETE FROM places WHERE k = 7")
    e.sql("CREATE VIEW by_region AS SELECT r, count(*) AS n FROM places GROUP BY r; CREATE FUNCTION shout(s STRING) RETURNS STRING RETURN upper(s); BEGIN; DELETE FROM places")
    again = Engine(spark, folder)
    if _codes(again, "INSERT INTO places VALUES (1, 1)") != "23505":
        raise AssertionError("the key isn't enforced after reopening")
    return again.sql("SELECT r, n, shout('europe') AS name FROM by_region")


@frame_query("SELECT n_nationkey FROM nation WHERE n_name = 'x' OR n_nationkey = 3")
def vacuumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a folder keeps is still whole when all that isn't named any more is deleted."""
    folder = _folder(spark)
    e = engine_over(spark, sf_dir, "nation", folder=folder)
    e.sql("CREATE TABLE a AS SELECT n_nationkey FROM nation; DELETE FROM a WHERE n_nationkey > 5; DELETE FROM a WHERE n_nationkey <> 3")
    if not e.vacuum():
        raise AssertionError("nothing was deleted")
    return Engine(spark, folder).sql("SELECT * FROM a")


# ---- changes


@frame_query("SELECT c_custkey FROM customer WHERE c_acctbal >= (SELECT avg(c_acctbal) FROM customer) AND NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey AND n_regionkey = 1)")
def dml_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes whose conditions hold subqueries, of the table itself and correlated ones."""
    e = engine_over(spark, sf_dir, "customer", "nation")
    e.sql("DELETE FROM customer WHERE c_acctbal < (SELECT avg(c_acctbal) FROM customer)")
    e.sql("DELETE FROM customer WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey = customer.c_nationkey AND n_regionkey = 1)")
    return e.sql("SELECT c_custkey FROM customer")


@frame_query("SELECT s_suppkey, CASE WHEN s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) THEN (SELECT max(n_nationkey) FROM nation) ELSE s_nationkey END AS s_nationkey FROM supplier")
def dml_update_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine_over(spark, sf_dir, "supplier", "nation")
    e.sql("UPDATE supplier SET s_nationkey = (SELECT max(n_nationkey) FROM nation) WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
    return e.sql("SELECT s_suppkey, s_nationkey FROM supplier")


@frame_query("SELECT CAST(0 AS BIGINT) AS n")
def dml_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine_over(spark, sf_dir, "region")
    e.sql("TRUNCATE TABLE region")
    return e.sql("SELECT count(*) AS n FROM region")


@frame_query(
    """SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN 'two' ELSE n_name END AS n_name FROM nation WHERE n_regionkey <> 1
       UNION ALL SELECT 100 + r_regionkey, r_name FROM region"""
)
def dml_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletion, update and insertion by one full join."""
    e = engine_over(spark, sf_dir, "nation", "region")
    e.sql("CREATE TABLE t AS SELECT n_nationkey, n_name FROM nation; CREATE VIEW s AS SELECT n_nationkey AS k, n_regionkey AS r, '' AS name FROM nation WHERE n_regionkey IN (1, 2) UNION ALL SELECT 100 + r_regionkey, 0, r_name FROM region")
    e.sql("MERGE INTO t USING s ON t.n_nationkey = s.k WHEN MATCHED AND s.r = 1 THEN DELETE WHEN MATCHED THEN UPDATE SET n_name = 'two' WHEN NOT MATCHED THEN INSERT VALUES (s.k, s.name)")
    return e.sql("SELECT * FROM t")


@frame_query("SELECT 'INSERT' AS message, count(*) AS affected FROM nation UNION ALL SELECT 'UPDATE', count(*) FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'DELETE', count(*) FROM nation WHERE n_regionkey > 2")
def affected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine_over(spark, sf_dir, "nation")
    e.sql("CREATE TABLE t (k BIGINT, r BIGINT)")
    done = [e.sql("INSERT INTO t SELECT n_nationkey, n_regionkey FROM nation"), e.sql("UPDATE t SET k = 0 WHERE r = 1"), e.sql("DELETE FROM t WHERE r > 2")]
    return done[0].union(done[1]).union(done[2])


@frame_query("SELECT count(*) AS n, count(*) AS different, CAST(1 AS INT) AS least, CAST(count(*) AS INT) AS most FROM customer")
def dml_serial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers without a gap, given in parts."""
    e = engine_over(spark, sf_dir, "customer")
    e.sql("CREATE TABLE t (id SERIAL PRIMARY KEY, k BIGINT); INSERT INTO t (k) SELECT c_custkey FROM customer")
    return e.sql("SELECT count(*) AS n, count(DISTINCT id) AS different, min(id) AS least, max(id) AS most FROM t")


@frame_query("SELECT CAST(1 AS BIGINT) AS times")
def dml_stored_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A default that differs from moment to moment is the same whenever it is read."""
    e = Engine(spark)
    e.sql("CREATE TABLE t (a INT, at TIMESTAMP DEFAULT CURRENT_TIMESTAMP); INSERT INTO t (a) VALUES (1); UPDATE t SET at = CURRENT_TIMESTAMP")
    return e.sql("SELECT at FROM t").union(e.sql("SELECT at FROM t")).agg(F.count_distinct("at").alias("times"))


# ---- rules


@frame_query("SELECT '23502,23502,ok' AS codes, CAST(2 AS BIGINT) AS n")
def constraint_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark)
    e.sql("CREATE TABLE t (a INT NOT NULL, b INT); INSERT INTO t VALUES (1, NULL)")
    codes = _codes(e, "INSERT INTO t VALUES (2, 2), (NULL, 3)", "UPDATE t SET a = NULL", "INSERT INTO t VALUES (4, NULL)")
    return e.sql(f"SELECT '{codes}' AS codes, count(*) AS n FROM t")


@frame_query("SELECT '23505,23505,23505,ok,23505' AS codes, count(*) + 2 AS n FROM nation")
def constraint_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys are unique among new rows and with old ones; NULLs differ from each other."""
    e = engine_over(spark, sf_dir, "nation")
    e.sql("CREATE TABLE t (a BIGINT PRIMARY KEY, b VARCHAR(40) UNIQUE); INSERT INTO t SELECT n_nationkey, n_name FROM nation")
    name = e.sql("SELECT b FROM t WHERE a = 3").first().b
    codes = _codes(e, "INSERT INTO t VALUES (3, 'new')", f"INSERT INTO t VALUES (100, '{name}')", "INSERT INTO t VALUES (100, 'x'), (100, 'y')", "INSERT INTO t VALUES (100, NULL), (101, NULL)", "UPDATE t SET a = 1")
    return e.sql(f"SELECT '{codes}' AS codes, count(*) AS n FROM t")


@frame_query("SELECT '23514,23514,ok,23514,ok,ok' AS codes, CAST(2 AS BIGINT) AS n")
def constraint_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules hold for inserts and updates, follow a column's new name, and go with a column that they alone name."""
    e = Engine(spark)
    e.sql("CREATE TABLE t (a INT CHECK (a > 0), b TEXT, CONSTRAINT word CHECK (b <> 'a'))")
    codes = _codes(e, "INSERT INTO t VALUES (1, 'x'), (0, 'y')", "INSERT INTO t VALUES (1, 'a')", "INSERT INTO t VALUES (1, NULL)")
    e.sql("ALTER TABLE t RENAME COLUMN a TO c")
    codes += "," + _codes(e, "UPDATE t SET c = 0 - c", "ALTER TABLE t DROP COLUMN c", "INSERT INTO t VALUES ('z')")
    return e.sql(f"SELECT '{codes}' AS codes, count(*) AS n FROM t")


@frame_query("SELECT '23503,ok,23503,23503,23503,ok,2BP01' AS codes, count(*) + 2 AS n FROM nation")
def constraint_foreign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows refer to rows that are there, in their own table too, whatever its columns are called since."""
    e = engine_over(spark, sf_dir, "nation", "region")
    e.sql("CREATE TABLE r (k BIGINT PRIMARY KEY, up BIGINT REFERENCES r(k)); INSERT INTO r SELECT r_regionkey, NULL FROM region")
    e.sql("CREATE TABLE n (k BIGINT, r BIGINT REFERENCES r(k)); INSERT INTO n SELECT n_nationkey, n_regionkey FROM nation; ALTER TABLE r RENAME COLUMN k TO key")
    codes = _codes(e, "INSERT INTO n VALUES (100, 77)", "INSERT INTO n VALUES (100, NULL), (101, 1)", "DELETE FROM r WHERE key = 1", "UPDATE n SET r = 50 WHERE k = 0", "INSERT INTO r VALUES (9, 10)", "INSERT INTO r VALUES (9, 9)", "DROP TABLE r")
    return e.sql(f"SELECT '{codes}' AS codes, count(*) AS n FROM n")


@frame_query("SELECT '23505,ok,42P07' AS codes, count(*) + 1 AS n FROM region")
def index_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine_over(spark, sf_dir, "region")
    e.sql("CREATE UNIQUE INDEX names ON region (r_name); CREATE INDEX IF NOT EXISTS keys ON region (r_regionkey)")
    first = e.sql("SELECT r_name FROM region WHERE r_regionkey = 0").first().r_name
    row = f"INSERT INTO region VALUES (90, '{first}')"
    codes = _codes(e, row)
    e.sql("DROP INDEX names")
    return e.sql(f"SELECT '{codes},{_codes(e, row, 'CREATE INDEX keys ON region (r_name)')}' AS codes, count(*) AS n FROM region")


@frame_query("SELECT '2BP01,ok,ok,42P01,ok,ok' AS codes")
def ddl_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What others use stays; a name in a string is no use."""
    e = Engine(spark)
    e.sql("CREATE TABLE t (a INT); CREATE TABLE u (a INT); CREATE VIEW v AS SELECT a, 'u' AS s FROM t")
    return e.sql(f"SELECT '{_codes(e, 'DROP TABLE t', 'DROP TABLE u', 'DROP VIEW v', 'DROP TABLE u', 'DROP TABLE IF EXISTS u', 'DROP TABLE t')}' AS codes")


@frame_query("SELECT '23514,ok,23514,ok' AS codes, count(*) AS n FROM region")
def ddl_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that are added hold for rows that are there, and end when they are dropped."""
    e = engine_over(spark, sf_dir, "region")
    codes = _codes(e, "ALTER TABLE region ADD CONSTRAINT few CHECK (r_regionkey > 3)", "ALTER TABLE region ADD CONSTRAINT few CHECK (r_regionkey < 30)", "UPDATE region SET r_regionkey = r_regionkey + 100", "ALTER TABLE region DROP CONSTRAINT few")
    return e.sql(f"SELECT '{codes}' AS codes, count(*) AS n FROM region")


@frame_query("SELECT r_regionkey AS a, CAST(NULL AS INT) AS b FROM region")
def ddl_column_anew(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column that is added under the name of one that was dropped has nothing of the old one's."""
    e = engine_over(spark, sf_dir, "region")
    e.sql("CREATE TABLE t (a BIGINT, b INT); INSERT INTO t SELECT r_regionkey, 7 FROM region; ALTER TABLE t DROP COLUMN b; ALTER TABLE t ADD COLUMN b INT")
    return e.sql("SELECT a, b FROM t")


@frame_query("SELECT count(*) AS n, 'own' AS held, '42P01,2BP01,ok' AS codes FROM region")
def ddl_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of one name in two schemas."""
    e = engine_over(spark, sf_dir, "region")
    e.sql("CREATE SCHEMA own; CREATE TABLE own.region (k BIGINT); INSERT INTO own.region SELECT r_regionkey FROM public.region; DELETE FROM public.region")
    n = e.sql("SELECT count(*) AS n, max(schema_name) AS held FROM own.region, pg_table WHERE table_name = 'region' AND schema_name <> 'public'").first()
    codes = _codes(e, "CREATE TABLE nowhere__t (a INT)", "DROP SCHEMA own", "DROP SCHEMA own CASCADE")
    return spark.sql(f"SELECT CAST({n.n} AS BIGINT) AS n, '{n.held}' AS held, '{codes}' AS codes")


@frame_query("SELECT 'UniqueError' AS name, '23505' AS code UNION ALL SELECT 'MissingError', '42P01' UNION ALL SELECT 'DuplicateError', '42P07' UNION ALL SELECT 'StatementError', '42601' UNION ALL SELECT 'TransactionError', '25000'")
def ddl_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark)
    e.sql("CREATE TABLE t (a INT PRIMARY KEY)")
    rows = []
    for sql in ("INSERT INTO t VALUES (1), (1)", "INSERT INTO nope VALUES (1)", "CREATE TABLE t (a INT)", "GRANT ALL", "COMMIT"):
        try:
            e.sql(sql)
        except EngineError as error:
            rows.append((type(error).__name__, error.code))
    return spark.createDataFrame(rows, "name string, code string")


# ---- materialized views


@frame_query("SELECT n_name, upper(n_name) AS u FROM nation WHERE n_name = 'a'")
def matview_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query isn't answered from a view whose query differs in a string's case alone."""
    e = engine_over(spark, sf_dir, "nation")
    e.sql("CREATE MATERIALIZED VIEW m AS SELECT n_name, upper(n_name) AS u FROM nation WHERE n_name <> 'a'")
    e.sql("CREATE MATERIALIZED VIEW m2 AS SELECT n_name, upper(n_name) AS u FROM nation WHERE n_name = 'A' OR 1 = 1")
    return e.sql("SELECT n_name, upper(n_name) AS u FROM nation WHERE n_name = 'a'")


@frame_query("SELECT count(*) AS before, count(*) - 3 AS after, TRUE AS was_stale, FALSE AS is_stale, 'DELETE' AS kind, CAST(3 AS BIGINT) AS n_rows FROM nation WHERE n_nationkey >= 0")
def matview_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view tells that its table was changed, how, and has the new rows when it is refreshed."""
    e = engine_over(spark, sf_dir, "nation")
    e.sql("CREATE MATERIALIZED VIEW m AS SELECT count(*) AS n FROM nation")
    before = e.sql("SELECT n FROM m").first().n
    e.sql("DELETE FROM nation WHERE n_nationkey < 3")
    was, (change,) = e.stale("m"), e.recent_changes("m")
    e.sql("REFRESH MATERIALIZED VIEW m")
    return e.sql(f"SELECT CAST({before} AS BIGINT) AS before, n AS after, {was} AS was_stale, is_stale, '{change[2]}' AS kind, CAST({change[3]} AS BIGINT) AS n_rows FROM m, pg_matview")


@frame_query("SELECT count(*) AS n, 'a,b,c' AS done FROM region WHERE r_regionkey <> 0")
def matview_dag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views of views are refreshed after those that they read; one that would read itself is refused."""
    e = engine_over(spark, sf_dir, "region")
    e.sql("CREATE MATERIALIZED VIEW a AS SELECT r_regionkey FROM region; CREATE VIEW plain AS SELECT * FROM a; CREATE MATERIALIZED VIEW b AS SELECT * FROM plain; CREATE MATERIALIZED VIEW c AS SELECT count(*) AS n FROM a JOIN b USING (r_regionkey)")
    e.sql("DELETE FROM region WHERE r_regionkey = 0")
    done = ",".join(e.refresh_stale())
    if _codes(e, "CREATE OR REPLACE VIEW plain AS SELECT * FROM b") != "2BP01":
        raise AssertionError("a view may read itself")
    return e.sql(f"SELECT n, '{done}' AS done FROM c")


@frame_query("SELECT '' AS early, 'm' AS due, '' AS again")
def matview_scheduled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view is refreshed when its time has come and its table was changed."""
    e = engine_over(spark, sf_dir, "region")
    e.sql("CREATE MATERIALIZED VIEW m AS SELECT count(*) AS n FROM region; DELETE FROM region")
    e.schedule("m", 60)
    made = e.catalog.views["m"].made_at
    early, due, again = (",".join(e.refresh_due(made + s)) for s in (10, 61, 1000))
    return spark.sql(f"SELECT '{early}' AS early, '{due}' AS due, '{again}' AS again")


# ---- routines and functions


@frame_query("SELECT 16 AS odd, 321 AS down, 60 AS from_rows, 'big' AS size, 'caught bad 7' AS said, CAST(4 AS BIGINT) AS n")
def proc_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branches, loops over numbers and rows, exits, exceptions that undo their block, and changes in all of them."""
    e = Engine(spark)
    e.sql("CREATE TABLE log (i INT)")
    e.sql("""
        CREATE PROCEDURE p(IN n INTEGER, OUT odd INTEGER, OUT down INTEGER, OUT from_rows INTEGER, OUT size TEXT) LANGUAGE PLPGSQL AS $$
        DECLARE k INTEGER := 0;
        BEGIN
          odd := 0; down := 0; from_rows := 0;
          FOR i IN 1..n LOOP
            IF i % 2 = 0 THEN CONTINUE; ELSIF i > 7 THEN EXIT; ELSE INSERT INTO log VALUES (i); END IF;
            odd := odd + i;
          END LOOP;
          FOR j IN REVERSE 3..1 LOOP down := down * 10 + j; END LOOP;
          FOR r IN SELECT i * 4 AS x FROM log WHERE i > 1 LOOP from_rows := from_rows + r.x; END LOOP;
          <<outer>> LOOP WHILE TRUE LOOP k := k + 1; EXIT outer WHEN k = 7; END LOOP; END LOOP;
          CASE WHEN k > 100 THEN size := 'huge'; WHEN k > 5 THEN size := 'big'; ELSE size := 'small'; END CASE;
          BEGIN INSERT INTO log VALUES (99); RAISE EXCEPTION 'bad %', k; EXCEPTION WHEN OTHERS THEN RAISE NOTICE 'caught %', sqlerrm; END;
        END $$""")
    row = e.sql("CALL p(20)").first()
    said = e.notices[0].partition(": ")[2]
    return e.sql(f"SELECT {row.odd} AS odd, {row.down} AS down, {row.from_rows} AS from_rows, '{row.size}' AS size, '{said}' AS said, count(*) AS n FROM log")


@frame_query("SELECT 'unique' AS handled, count(*) AS n FROM region")
def proc_exception(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An error is handled by its name, and nested calls hand theirs on."""
    e = engine_over(spark, sf_dir, "region")
    e.sql("CREATE UNIQUE INDEX k ON region (r_regionkey)")
    e.sql("CREATE PROCEDURE twice() LANGUAGE SQL AS BEGIN INSERT INTO region VALUES (70, 'x'); INSERT INTO region VALUES (70, 'y'); END")
    e.sql("CREATE PROCEDURE safe(OUT handled TEXT) LANGUAGE SQL AS BEGIN CALL twice(); SET handled = 'none'; EXCEPTION WHEN check_violation THEN SET handled = 'check'; WHEN unique_violation OR not_null_violation THEN SET handled = 'unique'; END")
    handled = e.sql("CALL safe()").first().handled
    return e.sql(f"SELECT '{handled}' AS handled, count(*) AS n FROM region")


@frame_query("SELECT n_nationkey, n_nationkey * 3 AS y FROM nation")
def udf_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_scalar(spark, "heddle_threefold", lambda s: s * 3, "long")
    return engine_over(spark, sf_dir, "nation").sql("SELECT n_nationkey, heddle_threefold(n_nationkey) AS y FROM nation")


@frame_query("SELECT n_regionkey, CAST(max(n_nationkey) - min(n_nationkey) AS DOUBLE) AS spread FROM nation GROUP BY n_regionkey")
def udf_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_aggregate(spark, "heddle_spread", lambda s: float(s.max() - s.min()), "double")
    return engine_over(spark, sf_dir, "nation").sql("SELECT n_regionkey, heddle_spread(n_nationkey) AS spread FROM nation GROUP BY n_regionkey")


class _Steps:
    def eval(self, n: int):
        for i in range(n):
            yield (i, i * i)


@frame_query("SELECT r_regionkey, CAST(i AS INT) AS i, CAST(i * i AS INT) AS sq FROM region, range(3) t(i)")
def udf_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_table(spark, "heddle_steps", _Steps, "i: int, sq: int")
    return engine_over(spark, sf_dir, "region").sql("SELECT r_regionkey, s.i, s.sq FROM region, LATERAL heddle_steps(3) s")


@frame_query("SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders WHERE o_totalprice > 100000")
def map_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows through a function over Arrow batches."""
    orders = read_table(spark, sf_dir, "orders").where("o_totalprice > 100000").select("o_orderkey", "o_totalprice")
    return orders.mapInPandas(lambda parts: (pd.DataFrame({"o_orderkey": p.o_orderkey, "twice": p.o_totalprice * 2}) for p in parts), "o_orderkey long, twice double")


@frame_query("SELECT o_orderkey FROM orders WHERE o_totalprice > 250000 AND o_orderstatus = 'O'")
def parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine_over(spark, sf_dir, "orders").sql("SELECT o_orderkey FROM orders WHERE o_totalprice > :least AND o_orderstatus = :status", {"least": 250000, "status": "O"})


@frame_query("""SELECT 'it''s' AS a, 'b\\c' AS b, 1 AS "Mixed Case", 1.5e1 AS d""", name="lexical")
def lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments, quotes of all kinds, numbers and keywords in any case."""
    return Engine(spark).sql("""sElEcT 'it''s' AS a, /* a ; comment */ $$b\\c$$ AS b, 1 AS "Mixed Case", 1.5e1 AS d -- the end;""")


# ---- scans


def _dealt(how: str) -> None:
    @frame_query("SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity > 10 GROUP BY l_returnflag", name=f"scan_{how}")
    def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = read_table(spark, sf_dir, "lineitem").where("l_quantity > 10").select("l_returnflag")
        return partitioned(rows, how, 8, *(["l_returnflag"] if how != "round_robin" else [])).groupBy("l_returnflag").agg(F.count("*").alias("n"))


for _how in ("range", "round_robin", "adaptive"):
    _dealt(_how)


# ---- correlation over levels


def _engine_query(name: str, sql: str, *tables: str) -> None:
    @frame_query(sql, name=name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return engine_over(spark, sf_dir, *tables).sql(sql)


_engine_query(
    "sub_two_level",
    "SELECT n.n_name FROM nation n WHERE EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = n.n_nationkey AND s.s_acctbal > (SELECT avg(x.s_acctbal) FROM supplier x WHERE x.s_nationkey = n.n_nationkey))",
    "nation", "supplier",
)
_engine_query(
    "sub_two_level_theta",
    "SELECT n.n_nationkey FROM nation n WHERE EXISTS (SELECT 1 FROM nation m WHERE m.n_nationkey >= n.n_nationkey AND m.n_regionkey > (SELECT min(x.n_regionkey) FROM nation x WHERE x.n_nationkey <= n.n_nationkey))",
    "nation",
)
_engine_query(
    "sub_two_level_count",
    "SELECT r.r_regionkey, (SELECT count(*) FROM nation n WHERE n.n_regionkey <> r.r_regionkey AND n.n_nationkey < (SELECT max(m.n_nationkey) FROM nation m WHERE m.n_regionkey < r.r_regionkey)) AS n FROM region r",
    "region", "nation",
)
_engine_query(
    "sub_three_level",
    "SELECT a.n_nationkey FROM nation a WHERE EXISTS (SELECT 1 FROM nation b WHERE b.n_regionkey = a.n_regionkey AND EXISTS (SELECT 1 FROM nation c WHERE c.n_nationkey > b.n_nationkey AND NOT EXISTS (SELECT 1 FROM nation d WHERE d.n_nationkey > c.n_nationkey AND d.n_regionkey <> a.n_regionkey)))",
    "nation",
)
_engine_query(
    "cte_graph",
    "WITH a AS (SELECT n_regionkey AS r, count(*) AS n FROM nation GROUP BY n_regionkey), b AS (SELECT r FROM a WHERE n >= 5), c AS (SELECT max(r) AS most FROM b), d AS (SELECT a.r, a.n FROM a JOIN b ON a.r = b.r) SELECT d.r, d.n FROM d, c WHERE d.r <= c.most",
    "nation",
)
