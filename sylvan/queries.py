"""Registered queries of the core and the SQL they must agree with.

Queries in the engine's dialect are their own SQL, but for the plain form of paths.
"""
from __future__ import annotations

import io
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine, second_pass
from .functions import plain_path
from .operators.analysis import call_sets, count_callees, mark_tested, normalize_implements
from .operators.attach import attach_comments, attach_following
from .operators.packed import explode_packed
from .operators.similarity import FEATURES, cosine, jaccard, min_max_scaled, top_similar
from .plans import parse_query, plan_text
from .runtime import store, table
from .sinks import csv_lines, json_lines, rows_of, table_lines
from .sources.made import ROWS, made_sources, made_sql
from .sources.trees import extract_texts, language_column, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Code tables of the data folder and their path columns.
PATHS = {"functions": ["file"], "structs": ["file"], "comments": ["file"], "fn_fingerprints": ["file"], "fn_callsets": ["file"], "similarities": ["file_a", "file_b"]}
OTHERS = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "eval_items")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with its SQL if there is one."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def code(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A code table with paths in plain form."""
    df = table(spark, sf_dir, name)
    return df.withColumns({c: plain_path(c) for c in PATHS[name]})


def plain_sql(column: str) -> str:
    return rf"regexp_replace(replace({column}, '\', '/'), '^(\./+)+', '')"


def code_sql(name: str) -> str:
    """SQL of a code table with paths in plain form, as something to select from."""
    return f"(SELECT * REPLACE ({', '.join(f'{plain_sql(c)} AS {c}' for c in PATHS[name])}) FROM {name})"


class _Lazy(dict):
    """Tables of a data folder, opened when a query names them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def get(self, name: str, default: DataFrame | None = None) -> DataFrame | None:
        if name not in self and name in PATHS:
            self[name] = code(self.spark, self.sf_dir, name)
        elif name not in self and name in OTHERS:
            self[name] = table(self.spark, self.sf_dir, name)
        return super().get(name, default)


def engine(spark: SparkSession, sf_dir: str, extended: bool = False) -> Engine:
    """An engine over all tables of a data folder."""
    e = Engine(spark, {}, extended)
    e._tables = _Lazy(spark, sf_dir)
    return e


#: Queries in the dialect, by the operators they show.
DIALECT = {
    "project_alias": "SELECT n_name AS nation, n_regionkey FROM nation",
    "wildcard": "SELECT * FROM orders",
    "wildcard_code": "SELECT * FROM functions",
    "distinct": "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer",
    "distinct_code": "SELECT DISTINCT file, visibility FROM functions",
    "filter_eq": "SELECT p_partkey, p_name FROM part WHERE p_size = 15",
    "filter_ne": "SELECT o_orderkey FROM orders WHERE o_orderstatus != 'O'",
    "filter_ne_angle": "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'",
    "filter_gt": "SELECT p_partkey FROM part WHERE p_size > 40",
    "filter_lt": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 20000",
    "filter_gte": "SELECT p_partkey FROM part WHERE p_size >= 49",
    "filter_lte": "SELECT file, line, name, complexity FROM fn_fingerprints WHERE complexity <= 2",
    "complex_untested": "SELECT name, file, line FROM functions WHERE complexity > 10 AND has_test = false",
    "and_or_precedence": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' OR l_linestatus = 'F' AND l_quantity > 45",
    "not_prefix": "SELECT p_partkey FROM part WHERE NOT p_size = 10 AND p_size < 12",
    "nested_parens": "SELECT o_orderkey FROM orders WHERE ((o_orderstatus = 'F' OR (o_orderstatus = 'P')) AND (o_totalprice > 300000))",
    "chained_comparison": "SELECT file, line, name FROM functions WHERE complexity > 20 = has_test",
    "like": "SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%A%'",
    "like_underscore": "SELECT file, line, callee FROM fn_callsets WHERE callee LIKE 'self._____%'",
    "not_like_prefix": "SELECT file, line FROM comments WHERE NOT text LIKE '//%'",
    "like_backslash": r"SELECT file, line, text FROM comments WHERE text LIKE '%\u00e%'",
    "like_quote": "SELECT file, line FROM comments WHERE text LIKE '%l''%'",
    "like_accent": "SELECT file, line FROM comments WHERE text LIKE '%für%'",
    "in_list": "SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 7, 49)",
    "in_columns": "SELECT n_nationkey FROM nation WHERE n_nationkey IN (n_regionkey, 7)",
    "in_text": "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')",
    "not_in": "SELECT p_partkey FROM part WHERE p_size NOT IN (1, 2, 3, 4, 5)",
    "not_in_null": "SELECT p_partkey FROM part WHERE p_size NOT IN (1, NULL)",
    "between": "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 100000 AND 120000",
    "not_between": "SELECT p_partkey FROM part WHERE p_size NOT BETWEEN 5 AND 45",
    "is_null": "SELECT file, line FROM functions WHERE return_type IS NULL",
    "is_not_null": "SELECT file, line, attached_to FROM comments WHERE attached_to IS NOT NULL AND is_doc = true",
    "bare_column": "SELECT file, line, name FROM functions WHERE has_test",
    "bare_integer": "SELECT file, line, name FROM fn_fingerprints WHERE loop_count AND return_count",
    "bool_literal": "SELECT r_regionkey FROM region WHERE TRUE AND NOT FALSE",
    "null_literal": "SELECT r_regionkey FROM region WHERE NULL OR r_regionkey = 1",
    "bool_as_integer": "SELECT file, line, name FROM functions WHERE has_test = 0",
    "bool_as_two": "SELECT file, line, name FROM functions WHERE has_test = 2",
    "text_as_integer": "SELECT file, line, name FROM functions WHERE complexity = '5'",
    "where_alias": "SELECT name AS n, complexity AS c FROM functions WHERE c > 25",
    "join_equi": "SELECT nation.n_name, region.r_name FROM nation JOIN region ON nation.n_regionkey = region.r_regionkey",
    "join_aliases": "SELECT f.name, f.file, c.callee FROM functions AS f JOIN fn_callsets AS c ON f.file = c.file AND f.line = c.line AND f.name = c.name",
    "join_three_way": "SELECT s.s_suppkey, n.n_name, r.r_name FROM supplier AS s JOIN nation AS n ON s.s_nationkey = n.n_nationkey JOIN region AS r ON n.n_regionkey = r.r_regionkey WHERE r.r_name != 'ASIA'",
    "join_theta": "SELECT a.n_nationkey AS low, b.n_nationkey AS high FROM nation AS a JOIN nation AS b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "join_range": "SELECT s.file AS file, s.line AS struct_line, f.line AS function_line FROM structs AS s JOIN functions AS f ON s.file = f.file AND f.line > s.line AND f.name IS NOT NULL WHERE s.field_count > 10",
    "self_join": "SELECT a.r_name AS one, b.r_name AS two FROM region AS a JOIN region AS b ON a.r_regionkey != b.r_regionkey",
    "join_on_true": "SELECT r.r_name, n.n_name FROM region AS r JOIN nation AS n ON TRUE",
    "join_large": "SELECT o.o_orderkey, l.l_linenumber, l.l_quantity FROM orders AS o JOIN lineitem AS l ON o.o_orderkey = l.l_orderkey WHERE o.o_orderstatus = 'P' AND l.l_quantity > 48",
    "group_by_keys": "SELECT o_orderstatus, o_orderpriority FROM orders GROUP BY o_orderstatus, o_orderpriority",
    "group_by_having": "SELECT p_size FROM part GROUP BY p_size HAVING p_size > 45 OR p_size = 1",
    "group_by_all": "SELECT visibility, has_test FROM functions GROUP BY all",
    "group_by_alias": "SELECT c_mktsegment AS segment FROM customer GROUP BY segment HAVING segment LIKE 'B%'",
    "order_multi": "SELECT c_mktsegment, c_custkey FROM customer ORDER BY c_mktsegment DESC, c_custkey ASC",
    "order_hidden": "SELECT c_custkey FROM customer ORDER BY c_acctbal, c_custkey;",
    "order_nulls": "SELECT return_type, file, line FROM functions ORDER BY return_type DESC, file, line",
    "order_alias_wins": "SELECT p_partkey AS p_size FROM part ORDER BY p_size LIMIT 20",
    "order_all": "SELECT n_regionkey, n_nationkey FROM nation ORDER BY ALL",
    "top_k": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "limit_zero": "SELECT o_orderkey FROM orders LIMIT 0",
    "select_functions": "SELECT file, line, name, visibility, param_count, return_type, complexity, has_test FROM functions ORDER BY file, line, name",
}
#: Queries that need the two extensions of the dialect: numbers with a fraction, and aliases without AS.
EXTENDED = {"extended_clones": "SELECT s.name_a, s.name_b, s.combined_score FROM similarities s WHERE s.combined_score > 0.8 AND s.combined_score <= 1 AND s.file_a != s.file_b"}


def dialect_sql(text: str) -> str:
    """SQL of a dialect query, with the plain form of paths."""

    def source(m: re.Match) -> str:
        word, name, rest = m[1], m[2], text[m.end() :]
        aliased = rest.startswith(" AS ")
        return f"{word} {code_sql(name)}" + ("" if aliased else f" AS {name}")

    text = plan_text(parse_query(text, extended=True))  # every operator in parentheses
    return re.sub(rf"\b(FROM|JOIN) ({'|'.join(PATHS)})\b", source, text)


def _dialect(text: str, extended: bool = False) -> Query:
    return lambda spark, sf_dir: engine(spark, sf_dir, extended).sql(text)


for _name, _text in DIALECT.items():
    query(_name, dialect_sql(_text))(_dialect(_text))
for _name, _text in EXTENDED.items():
    query(_name, dialect_sql(_text))(_dialect(_text, True))


# --- whole-corpus analyses ---


@query("has_test", f"""
WITH f AS (SELECT *, regexp_extract(file, '^(.*)/[^/]*$', 1) AS pkg, lower(name) AS low FROM {code_sql('functions')}),
k AS (SELECT DISTINCT pkg, lower(CASE WHEN starts_with(name, 'test_') THEN substr(name, 6) WHEN ends_with(name, '_test') THEN name[:-6] WHEN starts_with(name, 'Test') AND len(name) > 4 THEN substr(name, 5) END) AS low FROM f)
SELECT f.file, f.line, f.name, f.visibility, f.param_count, f.return_type, f.complexity, coalesce(f.has_test, false) OR k.low IS NOT NULL AS has_test, f.scanned_at
FROM f LEFT JOIN k ON f.pkg = k.pkg AND f.low = k.low""")
def has_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_tested(code(spark, sf_dir, "functions"))


@query("implements_list", f"""
SELECT file, line, name, field_count, visibility, array_to_string(list_filter(p, lambda x, i: list_position(p, x) = i), ',') AS implements
FROM (SELECT *, list_filter(list_transform(string_split(implements, ','), lambda x: trim(x, E' \\t\\n\\r')), lambda x: x <> '') AS p FROM {code_sql('structs')})""")
def implements_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_implements(code(spark, sf_dir, "structs"))


@query("attach_comments", f"""
WITH d AS (SELECT file, line, min({{'k': k, 'n': coalesce(name, '')}}).n AS name FROM (SELECT file, line, 0 AS k, name FROM {code_sql('functions')} WHERE name IS NOT NULL UNION ALL SELECT file, line, 1, name FROM {code_sql('structs')}) GROUP BY file, line)
SELECT c.file, c.line, c.text, coalesce(d.name, '') AS attached_to, c.is_doc FROM {code_sql('comments')} c ASOF LEFT JOIN d ON c.file = d.file AND c.line < d.line""")
def comments_attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = code(spark, sf_dir, "functions").where("name is not null")
    return attach_comments(code(spark, sf_dir, "comments"), named, code(spark, sf_dir, "structs"))


@query("attach_events", """
WITH b AS (SELECT user_id, epoch_us(ts) AS at, min(event_id) AS id FROM events WHERE event_type <> 'click' GROUP BY ALL)
SELECT a.event_id, b.id AS next_id FROM (SELECT event_id, user_id, epoch_us(ts) AS at FROM events WHERE event_type = 'click') a ASOF LEFT JOIN b ON a.user_id = b.user_id AND a.at < b.at""")
def attach_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every click with the next event of the same user that is none."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    got = attach_following(e.where("event_type = 'click'"), e.where("event_type <> 'click'"), ["user_id"], "at", ["event_id"], width=86_400_000_000)
    return got.select("event_id", F.col("following.event_id").alias("next_id"))


_CALLS = f"(SELECT DISTINCT file, name AS caller, callee FROM {code_sql('fn_callsets')} WHERE name <> '')"
_SETS = f"""SELECT c.file, coalesce(f.line, 0) AS line, c.caller AS name, c.callee FROM {_CALLS} c
LEFT JOIN (SELECT file, name, min(line) AS line FROM {code_sql('functions')} GROUP BY file, name) f ON c.file = f.file AND c.caller = f.name"""


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = code(spark, sf_dir, "fn_callsets").withColumnRenamed("name", "caller")
    return call_sets(calls, code(spark, sf_dir, "functions"))


@query("call_sets", _SETS)
def sets_of_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sets(spark, sf_dir)


@query("unique_callees", f"""
SELECT p.* REPLACE (coalesce(n.n, p.unique_callee_count) AS unique_callee_count) FROM {code_sql('fn_fingerprints')} p
LEFT JOIN (SELECT file, name, count(*) AS n FROM ({_SETS}) GROUP BY file, name) n ON p.file = n.file AND p.name = n.name""")
def unique_callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_callees(code(spark, sf_dir, "fn_fingerprints"), _sets(spark, sf_dir))


def _scaled_sql(source: str) -> str:
    f = ", ".join(f"CASE WHEN max(x.{c}::DOUBLE) OVER () = min(x.{c}::DOUBLE) OVER () THEN 0.5::DOUBLE ELSE (x.{c}::DOUBLE - min(x.{c}::DOUBLE) OVER ()) / (max(x.{c}::DOUBLE) OVER () - min(x.{c}::DOUBLE) OVER ()) END AS {c}" for c in FEATURES)
    return f"SELECT x.file, x.line, x.name, {f} FROM {source} x"


_USABLE = " AND ".join(f"{c} >= 0" for c in FEATURES if c != "has_error_handling") + " AND has_error_handling IS NOT NULL"
_PRINTS = f"(SELECT DISTINCT file, line, name, {', '.join(FEATURES[:-1])}, has_error_handling::INT AS has_error_handling FROM {code_sql('fn_fingerprints')} WHERE {_USABLE})"


def _prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = code(spark, sf_dir, "fn_fingerprints").where(_USABLE)
    return p.select("file", "line", "name", *FEATURES[:-1], F.col("has_error_handling").cast("int").alias("has_error_handling")).distinct()


@query("scaled_features", _scaled_sql(_PRINTS))
def scaled_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return min_max_scaled(_prints(spark, sf_dir), FEATURES)


def _sum(a: str, b: str) -> str:
    return " + ".join(f"{a}.{c} * {b}.{c}" for c in FEATURES)


def _top_similar_sql(prints: str, sets: str) -> str:
    return f"""
WITH s AS MATERIALIZED ({_scaled_sql(prints)}),
v AS MATERIALIZED (SELECT file, line, name, {', '.join(FEATURES)}, sqrt({_sum('s', 's')}) AS norm FROM s),
t AS (SELECT DISTINCT file, line, name, callee FROM {sets} WHERE name IS NOT NULL AND callee <> ''),
n AS (SELECT file, line, name, count(*) AS n FROM t GROUP BY ALL),
w AS MATERIALIZED (SELECT v.*, coalesce(n.n, 0) AS n, row_number() OVER (ORDER BY v.file, v.line, v.name) AS id FROM v LEFT JOIN n USING (file, line, name)),
u AS (SELECT w.id, t.callee FROM t JOIN w USING (file, line, name)),
o AS (SELECT a.id AS a, b.id AS b, count(*) AS o FROM u a JOIN u b USING (callee) GROUP BY ALL),
p AS (SELECT a.id AS ia, b.id AS ib, CASE WHEN a.norm * b.norm = 0 THEN 0 ELSE ({_sum('a', 'b')}) / (a.norm * b.norm) END AS cos,
    CASE WHEN a.n + b.n = 0 THEN 1 ELSE coalesce(o.o, 0) / (a.n + b.n - coalesce(o.o, 0)) END AS jac FROM w a JOIN w b ON a.id <> b.id LEFT JOIN o ON o.a = a.id AND o.b = b.id),
r AS (SELECT ia, ib, cos, jac, 0.6::DOUBLE * cos + 0.4::DOUBLE * jac AS score FROM p WHERE 0.6::DOUBLE * cos + 0.4::DOUBLE * jac >= 0.6::DOUBLE QUALIFY row_number() OVER (PARTITION BY ia ORDER BY 0.6::DOUBLE * cos + 0.4::DOUBLE * jac DESC, ib) <= 10)
SELECT a.file AS file_a, a.line AS line_a, a.name AS name_a, b.file AS file_b, b.line AS line_b, b.name AS name_b, round(cos, 9) AS structural_score, round(jac, 9) AS behavioral_score, round(score, 9) AS combined_score
FROM r JOIN w a ON a.id = r.ia JOIN w b ON b.id = r.ib"""


@query("top_similar", _top_similar_sql(_PRINTS, code_sql("fn_callsets")))
def similar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar functions of every function."""
    calls = code(spark, sf_dir, "fn_callsets").where("name is not null and callee <> ''")
    got = top_similar(_prints(spark, sf_dir), calls, ["file", "line", "name"], FEATURES, "callee")
    return got.withColumns({c: F.round(c, 9) for c in got.columns if c.endswith("_score")})


@query("cosine_neighbours", """
SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of every vector and the next one."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(cosine(F.col("v"), F.col("w")), 6).alias("score"))


@query("jaccard_neighbours", f"""
WITH s AS (SELECT file, line, name, list(DISTINCT callee) AS c FROM {code_sql('fn_callsets')} WHERE name IS NOT NULL AND callee <> '' GROUP BY ALL),
n AS (SELECT *, lead(c) OVER w AS d, lead(line) OVER w AS next_line FROM s WINDOW w AS (PARTITION BY file ORDER BY line, name))
SELECT file, line, name, next_line, round(len(list_intersect(c, d)) / (len(c) + len(d) - len(list_intersect(c, d))), 9) AS score FROM n WHERE d IS NOT NULL""")
def jaccard_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jaccard of the call sets of every function and the next one in its file."""
    from pyspark.sql.window import Window as W

    s = code(spark, sf_dir, "fn_callsets").where("name is not null and callee <> ''").groupBy("file", "line", "name").agg(F.collect_set("callee").alias("c"))
    w = W.partitionBy("file").orderBy("line", "name")
    n = s.withColumns({"d": F.lead("c").over(w), "next_line": F.lead("line").over(w)}).where("d is not null")
    return n.select("file", "line", "name", "next_line", F.round(jaccard(F.col("c"), F.col("d")), 9).alias("score"))


# --- sources and sinks ---


@query("languages", """
SELECT CASE regexp_extract(file, '(\\.[^./]+)$', 1) WHEN '.go' THEN 'go' WHEN '.rs' THEN 'rust' WHEN '.ts' THEN 'typescript' WHEN '.tsx' THEN 'typescript' WHEN '.py' THEN 'python' END AS language, count(*) AS files
FROM documents WHERE file IS NOT NULL GROUP BY ALL""")
def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of every language, by extension."""
    return table(spark, sf_dir, "documents").where("file is not null").groupBy(language_column("file").alias("language")).agg(F.count("*").alias("files"))


def _extracted(name: str) -> Query:
    """One table extracted from the source files among the documents, whole table and whole texts."""
    return lambda spark, sf_dir: tables(extract_texts(table(spark, sf_dir, "documents"), wanted=[name]))[name]


for _t in ("functions", "calls", "imports", "variables", "comments", "fn_fingerprints"):
    query(f"extract_{_t}")(_extracted(_t))


@query("engine_over_texts")
def engine_over_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dialect query over tables extracted from the documents: complex functions without a test."""
    wide = store(extract_texts(table(spark, sf_dir, "documents"), wanted=["functions", "structs", "comments"]))  # once, for the three tables the query needs
    return Engine(spark, second_pass(tables(wide))).sql("SELECT f.file, f.line, f.name, f.complexity, c.text FROM functions AS f JOIN comments AS c ON f.file = c.file AND f.name = c.attached_to WHERE f.complexity > 3 AND f.has_test = false AND c.is_doc = true")


_PARTS = "SELECT p_partkey AS k, p_size AS s, p_size % 4 AS n FROM part"


def _made(name: str) -> Query:
    """One table extracted from source files made from every part, in four languages."""
    return lambda spark, sf_dir: tables(extract_texts(made_sources(table(spark, sf_dir, "part"), "p_partkey", "p_size", F.col("p_size") % 4), wanted=[name]))[name]


for _t in ROWS:
    query(f"source_{_t}", made_sql(_t, _PARTS))(_made(_t))

_NATIONS = "SELECT n_nationkey AS k, n_regionkey AS s, n_nationkey % 5 AS n FROM nation"
_MADE_SETS = f"""SELECT DISTINCT c.file, f.line, c.caller AS name, c.callee FROM ({made_sql('calls', _NATIONS)}) c
JOIN (SELECT file, name, min(line) AS line FROM ({made_sql('functions', _NATIONS)}) GROUP BY ALL) f ON c.file = f.file AND c.caller = f.name"""
_MADE_PRINTS = f"""(SELECT p.* REPLACE (coalesce(u.n, p.unique_callee_count) AS unique_callee_count, p.has_error_handling::INT AS has_error_handling) FROM ({made_sql('fn_fingerprints', _NATIONS)}) p
LEFT JOIN (SELECT file, name, count(*) AS n FROM ({_MADE_SETS}) GROUP BY ALL) u USING (file, name))"""


def _made_engine(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine over the source files made from every nation, with all tables of the second pass."""
    texts = made_sources(table(spark, sf_dir, "nation"), "n_nationkey", "n_regionkey", F.col("n_nationkey") % 5)
    return Engine(spark, second_pass(tables(store(extract_texts(texts)))))


@query("source_similar", _top_similar_sql(_MADE_PRINTS, f"({_MADE_SETS})"))
def source_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The similarities of extracted functions, as the engine computes them over the second pass."""
    got = _made_engine(spark, sf_dir).table("similarities")
    return got.withColumns({c: F.round(c, 9) for c in got.columns if c.endswith("_score")})


@query("source_described", f"""
WITH f AS ({made_sql('functions', _NATIONS)}), s AS ({made_sql('structs', _NATIONS)}), c AS ({made_sql('comments', _NATIONS)}),
d AS (SELECT file, line, min({{'k': k, 'n': name}}).n AS name FROM (SELECT file, line, 0 AS k, name FROM f UNION ALL SELECT file, line, 1, name FROM s) GROUP BY ALL)
SELECT s.file, s.name, s.implements, a.text FROM s JOIN (SELECT c.file, c.text, c.is_doc, d.name FROM c ASOF LEFT JOIN d ON c.file = d.file AND c.line < d.line) a ON s.file = a.file AND s.name = a.name WHERE a.is_doc AND s.field_count > 3""")
def source_described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dialect query over extracted and attached rows: documented types with more than three fields."""
    return _made_engine(spark, sf_dir).sql("SELECT s.file, s.name, s.implements, c.text FROM structs AS s JOIN comments AS c ON s.file = c.file AND s.name = c.attached_to WHERE c.is_doc = true AND s.field_count > 3")


def _lines(make) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = engine(spark, sf_dir).sql("SELECT n_name AS name, n_nationkey AS key FROM nation ORDER BY n_nationkey")
        text = io.StringIO()
        text.writelines(make(df.columns, rows_of(df)))
        return spark.createDataFrame([(i, x) for i, x in enumerate(text.getvalue().splitlines())], "n long, line string")

    return run


query("sink_csv", "SELECT 0::BIGINT AS n, 'name,key' AS line UNION ALL SELECT n_nationkey + 1, n_name || ',' || n_nationkey FROM nation")(_lines(csv_lines))
query("sink_json", "SELECT 0::BIGINT AS n, '[' || string_agg('{\"key\":' || n_nationkey || ',\"name\":\"' || n_name || '\"}', ',' ORDER BY n_nationkey) || ']' AS line FROM nation")(_lines(json_lines))
query("sink_table", """
WITH w AS (SELECT max(len(n_name))::INT AS w FROM nation)
SELECT 0::BIGINT AS n, rpad('name', w, ' ') || '  key' AS line FROM w UNION ALL SELECT 1, repeat('-', w) || '  ---' FROM w
UNION ALL SELECT n_nationkey + 2, rpad(n_name, w, ' ') || '  ' || lpad(n_nationkey::VARCHAR, 3, ' ') FROM nation, w""")(_lines(table_lines))


# --- several values packed in one field ---


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = code(spark, sf_dir, "structs").select("file", "line", "implements").distinct()
    return explode_packed(src, "implements", ["file", "line"])


@query("p2_found")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every implemented type with its place; a struct row given more than once counts once."""
    return _packed(spark, sf_dir).select("file", "line", "pos", "item").distinct()


@query("p2_flags")
def p2_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values and malformed fields each file packs."""
    return _packed(spark, sf_dir).groupBy("file").agg(F.count("*").alias("n_items"), F.countDistinct("item").alias("n_types"), F.sum((F.col("flags") != "").cast("long")).alias("n_flagged"))
