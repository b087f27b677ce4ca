"""Registered queries of the training-data operators and the SQL they must agree with."""
from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import plain_path
from ..runtime import cut, table
from .components import consolidate_pairs
from .density import DensityPeaks
from .docpairs import paired_functions
from .hidden_language import hidden_text, running_text
from .leaks import leaked_items
from .packing import Capacity, pack, token_counts
from .repetition import repetition
from .setjoin import linked_records, similar_set_pairs
from .topn import top_n

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with its SQL if there is one."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _plain(c: str) -> str:
    """SQL of a path in plain form."""
    return rf"regexp_replace(replace({c}, '\', '/'), '^(\./+)+', '')"


# --- 1: consolidating pairwise matches into groups ---

_P1 = f"""
WITH RECURSIVE e AS (SELECT DISTINCT {_plain('file_a')} AS fa, name_a AS na, {_plain('file_b')} AS fb, name_b AS nb FROM similarities
    WHERE file_a IS NOT NULL AND name_a IS NOT NULL AND file_b IS NOT NULL AND name_b IS NOT NULL),
both_ways AS (SELECT fa, na, fb, nb FROM e UNION SELECT fb, nb, fa, na FROM e),
label(file, name, g) USING KEY (file, name) AS (
    SELECT fa, na, min({{'f': fa, 'n': na}}) FROM both_ways GROUP BY fa, na
  UNION
    SELECT b.fb, b.nb, min(l.g) FROM label l JOIN both_ways b ON l.file = b.fa AND l.name = b.na
    JOIN recurring.label r ON r.file = b.fb AND r.name = b.nb WHERE l.g < r.g GROUP BY b.fb, b.nb)
SELECT file, name, g.f AS group_file, g.n AS group_name FROM label"""


@query("p1_found", _P1)
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "similarities")
    pairs = s.select(plain_path("file_a").alias("file_a"), "name_a", plain_path("file_b").alias("file_b"), "name_b")
    return consolidate_pairs(pairs, ["file_a", "name_a"], ["file_b", "name_b"], ["file", "name"], ["group_file", "group_name"])


@query("p1_group_sizes", f"SELECT group_file, group_name, count(*) AS n FROM ({_P1}) GROUP BY group_file, group_name")
def p1_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_found(spark, sf_dir).groupBy("group_file", "group_name").agg(F.count("*").alias("n"))


# --- 3: grouping records into similarity clusters ---

_MEASURES = ["complexity", "nesting_depth", "branch_count", "stmt_count"]
_NEAR = " AND ".join(f"(abs(a.{m} - b.{m}) <= 1 OR abs(a.{m} - b.{m}) * 100 <= greatest(a.{m}, b.{m}) * 12)" for m in _MEASURES)
_P3_POINTS = f"""WITH f AS (SELECT DISTINCT {_plain('file')} AS file, line, name, {', '.join(_MEASURES)} FROM fn_fingerprints
    WHERE {' AND '.join(f'{m} >= 0' for m in _MEASURES)}),
p AS (SELECT {', '.join(_MEASURES)}, count(*) AS n FROM f GROUP BY ALL),
t AS (SELECT {', '.join(f'a.{m}' for m in _MEASURES)}, a.n AS density, sum(b.n) AS mass FROM p a JOIN p b ON {_NEAR}
    GROUP BY ALL HAVING count(*) FILTER (b.n >= a.n) = 1 AND sum(b.n) * 100 >= 2 * (SELECT count(*) FROM f))"""


def _peaks(spark: SparkSession, sf_dir: str) -> DensityPeaks:
    f = table(spark, sf_dir, "fn_fingerprints").withColumn("file", plain_path("file"))
    return DensityPeaks(f, ["file", "line", "name"], _MEASURES)


@query("p3_found", f"{_P3_POINTS} SELECT a.file, a.line, a.name, {', '.join(f'b.{m}' for m in _MEASURES)} FROM f a JOIN t b ON {_NEAR}")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _peaks(spark, sf_dir).near_peaks()


@query("p3_peaks", f"{_P3_POINTS} SELECT {', '.join(_MEASURES)}, density, mass::BIGINT AS mass FROM t")
def p3_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _peaks(spark, sf_dir).peaks()


def _bent(c: str) -> str:
    """SQL of the bent scale: whole steps up to 8, from there logarithmic in ratios of 0.88."""
    return f"(CASE WHEN {c} <= 8 THEN {c}::DOUBLE ELSE 8 + ln({c} / 8.0::DOUBLE) / {-math.log(0.88)!r}::DOUBLE END)"


_GAP = f"round(sqrt({' + '.join(f'pow({_bent(f"a.{m}")} - {_bent(f"b.{m}")}, 2)' for m in _MEASURES)}), 9)"
_P3_LABELS = f"""WITH RECURSIVE{_P3_POINTS.removeprefix('WITH')},
q AS (SELECT {{{', '.join(f"'{m}': {m}" for m in _MEASURES)}}} AS pt, * FROM p),
k AS (SELECT {{{', '.join(f"'{m}': {m}" for m in _MEASURES)}}} AS pt, * FROM t),
u AS (SELECT a.pt, min({{'gap': {_GAP}, 'd': -b.n, 'pt': b.pt}}).pt AS up FROM q a JOIN q b ON {_NEAR} AND (b.n > a.n OR (b.n = a.n AND b.pt < a.pt)) WHERE a.pt NOT IN (SELECT pt FROM k) GROUP BY a.pt),
v AS (SELECT a.pt, min({{'gap': {_GAP}, 'd': -b.density, 'pt': b.pt}}).pt AS up FROM q a CROSS JOIN k b WHERE a.pt NOT IN (SELECT pt FROM u) AND a.pt NOT IN (SELECT pt FROM k) GROUP BY a.pt),
w AS (SELECT pt, up FROM u UNION ALL SELECT pt, up FROM v),
l(pt, label) AS (SELECT pt, pt FROM q WHERE pt NOT IN (SELECT pt FROM w) UNION ALL SELECT w.pt, l.label FROM w JOIN l ON w.up = l.pt),
c AS (SELECT f.*, {', '.join(f'l.label.{m} AS centre_{m}' for m in _MEASURES)} FROM f JOIN l ON l.pt = {{{', '.join(f"'{m}': f.{m}" for m in _MEASURES)}}})"""
_CENTRE = [f"centre_{m}" for m in _MEASURES]


@query("p3_clusters", f"{_P3_LABELS} SELECT *, count(*) OVER (PARTITION BY {', '.join(_CENTRE)}) AS cluster_size FROM c")
def p3_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable function with its cluster's centre, and the cluster's size."""
    c = cut(_peaks(spark, sf_dir).clusters())
    return c.join(c.groupBy(*_CENTRE).agg(F.count("*").alias("cluster_size")), _CENTRE)


@query("p3_described", f"""{_P3_LABELS}, g AS (SELECT {', '.join(_CENTRE)}, {', '.join(_MEASURES)}, count(*) AS held FROM c GROUP BY ALL),
r AS (SELECT *, sum(held) OVER (PARTITION BY {', '.join(_CENTRE)})::BIGINT AS cluster_size, row_number() OVER (PARTITION BY {', '.join(_CENTRE)} ORDER BY held DESC, {', '.join(_MEASURES)}) AS place FROM g)
SELECT * FROM r WHERE place <= 3""")
def p3_described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cluster with its size and its three most typical combinations."""
    return _peaks(spark, sf_dir).described()


# --- 4: top N items within every group ---

_P4_IDS = ["name_b", "file_b", "line_b", "file_a", "line_a"]


@query("p4_found", f"""
WITH s AS (SELECT name_a, name_b, {_plain('file_b')} AS file_b, line_b, {_plain('file_a')} AS file_a, line_a, max(combined_score) AS score FROM similarities
    WHERE combined_score BETWEEN 0 AND 1 AND NOT isnan(combined_score) AND name_a IS NOT NULL AND name_b IS NOT NULL AND file_a IS NOT NULL AND file_b IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY name_a ORDER BY score DESC, name_b, file_b, line_b, file_a, line_a) AS place FROM s
    WHERE NOT (file_a = file_b AND line_a = line_b AND name_a = name_b))
SELECT name_a, place, file_a, line_a, file_b, line_b, name_b FROM r WHERE place <= 3""")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "similarities").withColumns({"file_a": plain_path("file_a"), "file_b": plain_path("file_b")})
    same = (F.col("file_a") == F.col("file_b")) & F.col("line_a").eqNullSafe(F.col("line_b")) & (F.col("name_a") == F.col("name_b"))
    best = top_n(s.where(F.col("combined_score").between(0, 1) & ~same), "name_a", "combined_score", _P4_IDS, 3)
    return best.select("name_a", "place", "file_a", "line_a", "file_b", "line_b", "name_b")


# --- 7: all similar pairs between set-valued records ---


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callees of the records, cleaned."""
    white = F.lit(" \t\n\r")
    callee = F.btrim(F.regexp_replace(F.btrim("callee", white), r"(\(\))+$", ""), white)
    return table(spark, sf_dir, "fn_callsets").select(plain_path("file").alias("file"), "name", callee.alias("callee"))


_P7_ITEMS = f"""SELECT * FROM (SELECT DISTINCT {_plain('file')} AS file, name, trim(regexp_replace(trim(callee, E' \\t\\n\\r'), '(\\(\\))+$', ''), E' \\t\\n\\r') AS w
    FROM fn_callsets WHERE name IS NOT NULL AND file IS NOT NULL) WHERE w <> ''"""
_P7 = f"""
WITH v AS ({_P7_ITEMS}),
n AS (SELECT file, name, count(*) AS n FROM v GROUP BY ALL HAVING count(*) >= 4),
u AS (SELECT v.*, n.n FROM v JOIN n USING (file, name)),
o AS (SELECT a.file AS file_a, a.name AS name_a, b.file AS file_b, b.name AS name_b, a.n AS na, b.n AS nb, count(*) AS o FROM u a JOIN u b
    ON a.w = b.w AND (a.file < b.file OR (a.file = b.file AND a.name < b.name)) AND a.n * 7 <= b.n * 10 AND b.n * 7 <= a.n * 10 GROUP BY ALL)
SELECT file_a, name_a, file_b, name_b FROM o WHERE o * 10 >= (na + nb - o) * 7"""


@query("p7_found", _P7)
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_set_pairs(_calls(spark, sf_dir), ["file", "name"], "callee")


@query("p7_links", f"""
WITH p AS ({_P7}), e AS (SELECT file_a AS file, name_a AS name, 1 AS k FROM p UNION ALL SELECT file_b, name_b, 1 FROM p),
k AS (SELECT file, name, count(*) AS links FROM e GROUP BY ALL),
c AS (SELECT file, name, list_sort(list(DISTINCT w)) AS s FROM ({_P7_ITEMS}) GROUP BY ALL HAVING count(DISTINCT w) >= 4),
h AS (SELECT *, first_value(file) OVER w AS class_file, first_value(name) OVER w AS class_name FROM c WINDOW w AS (PARTITION BY s ORDER BY file, name))
SELECT h.file, h.name, class_file, class_name, coalesce(links, 0) AS links FROM h LEFT JOIN k USING (file, name)""")
def p7_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with the first record of equal callees and the number of records similar to it."""
    return linked_records(_calls(spark, sf_dir), ["file", "name"], "callee")


# --- 8: filling fixed-capacity containers ---


@query("p8_containers")
def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every text, or of its parts if it alone exceeds one."""
    return pack(token_counts(table(spark, sf_dir, "documents")))


#: Containers that are bounded by each of the three constraints: 2,048 tokens, 12 texts, and half the attention cost of one full-length text.
TIGHT = Capacity(tokens=2048, docs=12, attention=2048 * 1024)


@query("p8_tight")
def p8_tight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every text under a count of texts and an attention cost that bind before the tokens do."""
    return pack(token_counts(table(spark, sf_dir, "documents")), TIGHT)


@query("p8_fill")
def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are: containers, tokens, documents, least containers that could do, share of unused space."""
    c = p8_containers(spark, sf_dir).where("container is not null")
    box = c.groupBy("container").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    return box.agg(
        F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"), F.max("docs").alias("most_docs"),
        F.ceil(F.sum("tokens") / 2048).alias("least_containers"), (1 - F.sum("tokens") / (F.count("*") * 2048)).alias("unused_share"),
    )


# --- 9: evaluation texts leaking into training text ---

_P9_WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"
_P9 = f"""
WITH d AS (SELECT doc_id AS id, {_P9_WORDS} AS w FROM documents), i AS (SELECT item_id AS id, {_P9_WORDS} AS w FROM eval_items),
dp AS (SELECT id, array_to_string(w[k:k + 14], ' ') AS p FROM d, unnest(range(1, len(w) - 13)) AS t(k)),
ip AS (SELECT id, array_to_string(w[k:k + 14], ' ') AS p FROM i, unnest(range(1, len(w) - 13)) AS t(k))"""


@query("p9_found", _P9 + " SELECT DISTINCT dp.id AS doc_id, ip.id AS item_id FROM dp JOIN ip USING (p)")
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


@query("p9_containment", _P9 + """, n AS (SELECT id, count(DISTINCT p) AS held FROM ip GROUP BY id)
SELECT dp.id AS doc_id, ip.id AS item_id, count(DISTINCT p) AS passages, count(DISTINCT p) / any_value(n.held) AS containment FROM dp JOIN ip USING (p) JOIN n ON n.id = ip.id GROUP BY ALL""")
def p9_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of an item each affected document holds."""
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


# --- 10: repetition inside a single document ---

_P10 = """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '\\p{L}+') AS w FROM documents),
g AS (SELECT doc_id, k, array_to_string(w[k:k + 7], ' ') AS p FROM d, unnest(range(1, len(w) - 6)) AS t(k)),
a AS (SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY doc_id, p ORDER BY k) AS r FROM g) WHERE r > 1),
c AS (SELECT DISTINCT doc_id, k + j AS at FROM a, unnest(range(0, 8)) AS t(j)),
s AS (SELECT doc_id, count(*) AS repeated FROM c GROUP BY doc_id)"""


@query("p10_found", _P10 + " SELECT d.doc_id FROM d JOIN s USING (doc_id) WHERE s.repeated * 10 >= len(d.w) * 4")
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition(table(spark, sf_dir, "documents")).where("repeated > 0 and repeated * 10 >= n_words * 4").select("doc_id")


@query("p10_shares", _P10 + " SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(s.repeated, 0)::BIGINT AS repeated FROM d LEFT JOIN s USING (doc_id) WHERE d.w IS NOT NULL")
def p10_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated words of every document, counted exactly for all of them: no count lies below a share of 0, so none is left out."""
    return repetition(table(spark, sf_dir, "documents").where("text is not null"), share=0.0).select("doc_id", "n_words", "repeated")


# --- 6: functions paired with their documentation ---


def _code(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name).withColumn("file", plain_path("file"))


@query("p6_found")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions with a description of their own that is not trivial."""
    return p6_pairs(spark, sf_dir).where("depth = 0").select("file", "line", "name", "doc_line")


@query("p6_pairs")
def p6_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions with their description, inherited ones included."""
    return paired_functions(_code(spark, sf_dir, "comments"), _code(spark, sf_dir, "functions"), _code(spark, sf_dir, "structs"))


# A hierarchy made of the parts: part k is a type T<k> that implements T<k / 5>, four types a file, each with two methods
# of which every seventh type documents one.
_TYPE = "'made/d' || k // 40 || '/f' || k // 4 || '.rs' AS file, k % 4 * 50 + 10 AS line"


@query("p6_inherited", f"""
WITH RECURSIVE p AS (SELECT p_partkey AS k FROM part),
up(k, a, depth) AS (SELECT k, k, 0 FROM p UNION ALL SELECT k, a // 5, depth + 1 FROM up WHERE a % 7 <> 0),
t AS (SELECT k, {_TYPE} FROM p), d AS (SELECT * FROM up WHERE a % 7 = 0)
SELECT o.file, o.line + 4 AS line, 'draw' AS name, h.line + 3 AS doc_line, 'Draws shape number ' || d.a || ' as its children do.' AS description, h.file AS from_file, h.line + 4 AS from_line, d.depth
FROM d JOIN t o ON o.k = d.k JOIN t h ON h.k = d.a""")
def p6_inherited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions with their own or inherited description, over a hierarchy of types that is made of the parts."""
    k = F.col("p_partkey")
    t = table(spark, sf_dir, "part").select(k.alias("k"), F.format_string("made/d%d/f%d.rs", F.floor(k / 40), F.floor(k / 4)).alias("file"), (k % 4 * 50 + 10).alias("line"))
    shift = lambda of, by: of.withColumn("line", F.col("line") + by)
    structs = t.select("file", "line", F.format_string("T%d", "k").alias("name"), F.when(F.col("k") > 0, F.format_string("shapes::T%d<u8>, `Clone`", F.floor(F.col("k") / 5))).alias("implements"))
    functions = shift(t, 4).select("file", "line", F.lit("draw").alias("name")).unionByName(shift(t, 9).select("file", "line", F.lit("erase").alias("name")))
    doc = F.format_string("/// Draws shape number %d as its children do.", "k")
    comments = shift(t.where("k % 7 = 0"), 3).select("file", "line", doc.alias("text"), F.lit("Shape::draw()").alias("attached_to"), F.lit(True).alias("is_doc"))
    todo = shift(t.where("k % 7 = 1"), 3).select("file", "line", F.lit("/// TODO {@inheritDoc}").alias("text"), F.lit(None).cast("string").alias("attached_to"), F.lit(True).alias("is_doc"))
    return paired_functions(comments.unionByName(todo), functions, structs).drop("tags")


# --- 5: natural language hidden inside code ---


@query("p5_found")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments that hold running text of a language."""
    return hidden_text(_code(spark, sf_dir, "comments"), ["file", "line"]).where(running_text()).select("file", "line", "nl_lang").distinct()


@query("p5_shares")
def p5_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's share of the characters of a file's comments; a span is never longer than its text, so shares add up to 1 at most."""
    c = _code(spark, sf_dir, "comments")
    spans = hidden_text(c, ["file", "line"]).groupBy("file", "nl_lang").agg(F.sum("span").alias("span"))
    total = c.where("text is not null").select("file", "line", "text").distinct().groupBy("file").agg(F.sum(F.length("text")).alias("chars"))
    return spans.join(total, "file").select("file", "nl_lang", "span", "chars", (F.col("span") / F.col("chars")).alias("share"))
