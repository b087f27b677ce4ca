"""Functions paired with their documentation, inherited documentation included."""
from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import count
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import blank_to_null, dirname
from ..operators.attach import attach_following, following
from ..operators.packed import explode_packed
from ..runtime import cut, ensure_importable, store

#: Words that only say that documentation is missing.
PLACEHOLDERS = frozenset("todo tbd fixme xxx wip hack na n/a undocumented".split())
#: Least words, and least Chinese or Japanese characters, of a description that says something.
LEAST_WORDS, LEAST_CHARS = 4, 8

_MARKER = re.compile(r"^\s*(?:(?:/\*[*!]?|\*/|\*(?!\*)|//[/!]?|#[:.!]?|\"\"\"|''')\s*)*|(?:\*+/|\"\"\"|''')\s*$")
_TAG = re.compile(r"\{?@[^\W\d_][\w-]*\}?|(?<!\S):[^\W\d_]\w*(?:\s+[\w*.,\[\]]+)?:(?=\s|$)|</?[a-zA-Z][^<>]*>")
_RULER = re.compile(r"([=\-~*_#+.<>|])\1{2,}")
_WORD = re.compile(r"\bn/a\b|[^\W\d_][\w'’]*(?:-[^\W\d_][\w'’]*)*", re.IGNORECASE)
_CJK = re.compile(r"[ぁ-ゟァ-ヿ㐀-䶿一-鿿豈-﫿々〆ー]")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_A-Za-z]+")
_INHERIT = frozenset(("inheritdoc", "inherit_doc", "inherit"))


class Doc(NamedTuple):
    """A parsed comment: its text without markers, tags and rulers, its tags with what follows each, and whether it asks for inherited documentation."""

    text: str
    tags: list[tuple[str, str]]
    inherits: bool


def parse_doc(text: str) -> Doc:
    """Tags are ``@name``, ``{@name}``, ``:name:``, ``:name argument:`` and markup in angle brackets, which has no value.

    A tag's value runs to the next tag; an argument between colons goes in front of it.
    """
    flat = " ".join(_MARKER.sub("", x) for x in re.split(r"\r\n|\r|\n", text))
    plain = lambda x: " ".join(_RULER.sub(" ", x).split())
    tags, left, at = [], [], 0
    for m in _TAG.finditer(flat):
        piece, at = flat[at : m.start()], m.end()
        if tags and tags[-1][1] is None:
            tags[-1] = (tags[-1][0], plain(tags[-1][2] + " " + piece))
        left.append(piece)
        word = m[0].strip("{}@:<>/ ")
        if not m[0].startswith("<"):
            name, _, argument = word.partition(" ")
            tags.append((name.lower(), None, argument))
    piece = flat[at:]
    if tags and tags[-1][1] is None:
        tags[-1] = (tags[-1][0], plain(tags[-1][2] + " " + piece))
    left.append(piece)
    tags = [(t[0], (t[1] or "").strip("} ")) for t in tags]
    # a ruler may run over what stood round a tag, so it goes last
    return Doc(plain(" ".join(left)), tags, any(n in _INHERIT for n, _ in tags))


def bare(text: str) -> str:
    """A comment without markers, tags and rulers, on one line."""
    return parse_doc(text).text


def counted(left: str, name: str | None) -> tuple[int, int]:
    """How many words, and Chinese or Japanese characters, of a text say something about ``name``."""
    own = {x.lower() for x in _PART.findall(name or "")} | {(name or "").lower()}
    words = [w.lower() for w in _WORD.findall(_CJK.sub(" ", left))]
    return sum(w not in own and w not in PLACEHOLDERS for w in words), len(_CJK.findall(left))


def content(text: str | None, name: str | None) -> tuple[str, int, int]:
    """What is left of a comment, and how many words and Chinese or Japanese characters of it say something about ``name``."""
    if not text:
        return "", 0, 0
    left = bare(text)
    return left, *counted(left, name)


def clean_target(c: str) -> Column:
    """Name in attached_to: without padding, quotes, a trailing () and the owner; null if nothing is left."""
    t = F.regexp_replace(blank_to_null(c), r"^[`'\"\s]+|[`'\"\s]+$", "")
    t = F.regexp_replace(t, r"\s*\(\s*\)$", "")
    return blank_to_null(F.regexp_extract(t, r"([^.:#>\s]*)[`'\"]*$", 1))


_DESCRIPTION = "file string, line long, name string, doc_line long, text string, tags array<struct<tag string, value string>>, words long, chars long, inherits boolean"


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.struct([("tag", pa.string()), ("value", pa.string())])), pa.int64(), pa.int64(), pa.bool_()]
    names = ["file", "line", "name", "doc_line", "text", "tags", "words", "chars", "inherits"]
    for b in batches:
        out: list[list] = [[] for _ in range(5)]
        for name, texts in zip(b.column("name").to_pylist(), b.column("texts").to_pylist(), strict=True):
            docs = [parse_doc(t) for t in texts if t]
            n = [counted(d.text, name) for d in docs]
            row = ("\n".join(d.text for d in docs), [{"tag": t, "value": v} for d in docs for t, v in d.tags], sum(x for x, _ in n), sum(x for _, x in n), any(d.inherits for d in docs))
            for col, v in zip(out, row, strict=True):
                col.append(v)
        cols = [b.column(c) for c in names[:4]] + [pa.array(c, k) for c, k in zip(out, kinds[4:], strict=True)]
        yield pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(cols, kinds, strict=True)], names=names)


def _line_ends(c: str | Column) -> Column:
    """Line ends of a text but those at its end."""
    return F.length(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[\r\n]+$", ""), "\r\n?", "\n"), "[^\n]", ""))


def descriptions(comments: DataFrame, functions: DataFrame, structs: DataFrame) -> DataFrame:
    """Every description of a function: (file, line, name, doc_line, text, tags, words, chars, inherits).

    A row with is_doc true documents the nearest function below it, in its file, that has the name in attached_to
    or, if that is null or empty, the nearest function below unless a struct comes first (a function wins a tie). Rows of
    one function on consecutive lines form one description; a row takes as many lines as its text has. Repeated rows count
    once. Functions without a name, rows without a file or line, and rows that find no function give nothing. Null and
    blank texts have no words but keep their line.

    Places are sought without the texts, which are shuffled twice: to their function, repeated ones dropped before, and to
    their description. One description must fit a row.
    """
    ensure_importable(comments.sparkSession)
    docs = comments.where("is_doc and file is not null and line is not null").select("file", "line", F.coalesce(clean_target("attached_to"), F.lit("")).alias("target"), "text")
    fn = functions.where("name is not null and file is not null and line is not null").select("file", "line", "name", F.lit(0).alias("kind"))
    st = structs.where("file is not null and line is not null").select("file", "line", F.lit("").alias("name"), F.lit(1).alias("kind"))
    # by name, and under the empty name whatever comes next
    stops = fn.withColumn("target", F.explode(F.array("name", F.lit("")))).unionByName(st.withColumn("target", F.lit("")))
    places = following(docs.select("file", "line", "target"), stops, ["file", "target"], "line", ["kind", "name"], None).where("following.kind = 0")
    texts = docs.groupBy("file", "line", "target").agg(F.collect_set("text").alias("texts"))
    rows = texts.join(places, ["file", "line", "target"]).select(
        "file", F.col("following.line").alias("line"), F.col("following.name").alias("name"), F.col("line").alias("doc_line"), F.array_sort("texts").alias("texts"),
        (F.col("line") + F.coalesce(F.array_max(F.transform("texts", _line_ends)), F.lit(0))).alias("end"),
    )
    order = W.partitionBy("file", "line", "name").orderBy("doc_line")
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("new", F.coalesce((F.col("doc_line") > reach + 1).cast("int"), F.lit(1)))
    rows = rows.withColumn("block", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("doc_line", "texts"))), lambda x: x["texts"])
    whole = rows.groupBy("file", "line", "name", "block").agg(F.min("doc_line").alias("doc_line"), F.flatten(in_order).alias("texts"))
    return whole.select("file", "line", "name", "doc_line", "texts").mapInArrow(_describe, _DESCRIPTION)


def says_something() -> Column:
    return (F.col("words") >= LEAST_WORDS) | (F.col("chars") >= LEAST_CHARS)


def _simple(c: str) -> Column:
    """Last name of a type: without path, arguments and keyword."""
    return F.regexp_extract(F.regexp_replace(c, r"[<(\[].*$", ""), r"([^.:=&\s]*)\s*$", 1)


def parent_types(structs: DataFrame) -> DataFrame:
    """(file, line, parent, scope, pfile, pline): the types that each struct implements, and where they are defined.

    A name means the struct of that name in the same file (scope 'file', the first one), else in the same folder ('folder'), else in the whole
    corpus ('corpus'). Where several files of the nearest such scope define it, it is 'ambiguous' and nothing is guessed; a name that is
    defined nowhere is 'unknown'; pfile and pline are null for both. A struct is no parent of its own. Every table that is joined has one row a key.
    """
    st = structs.where("file is not null and line is not null and name is not null").select("file", "line", "name", "implements").distinct()
    names = explode_packed(st, "implements", ["file", "line"]).select("file", "line", _simple("item").alias("parent")).where("parent <> ''").distinct()
    here = st.groupBy("file", "name").agg(F.min("line").alias("line"))
    place = F.struct("file", "line")
    near = here.groupBy(dirname("file").alias("dir"), "name").agg(F.min(place).alias("near"), F.count("*").alias("near_files"))
    far = here.groupBy("name").agg(F.min(place).alias("far"), F.count("*").alias("far_files"))
    got = names.withColumn("dir", dirname("file")).join(here.select("file", F.col("name").alias("parent"), F.col("line").alias("own_line")), ["file", "parent"], "left")
    got = got.join(near.withColumnRenamed("name", "parent"), ["dir", "parent"], "left").join(far.withColumnRenamed("name", "parent"), "parent", "left")
    scope = F.when(F.col("own_line").isNotNull(), "file").when(F.col("near_files") == 1, "folder").when(F.col("near_files") > 1, "ambiguous")
    scope = scope.when(F.col("far_files") == 1, "corpus").when(F.col("far_files") > 1, "ambiguous").otherwise("unknown")
    got = got.withColumn("scope", scope).withColumn("at", F.when(F.col("scope") == "file", F.struct("file", F.col("own_line").alias("line"))).when(F.col("scope") == "folder", F.col("near")).when(F.col("scope") == "corpus", F.col("far")))
    got = got.select("file", "line", "parent", "scope", F.col("at.file").alias("pfile"), F.col("at.line").alias("pline"))
    return got.where("pfile is null or not (pfile = file and pline = line)")


def paired_functions(comments: DataFrame, functions: DataFrame, structs: DataFrame) -> DataFrame:
    """Code-description pairs: (file, line, name, doc_line, description, tags, from_file, from_line, depth).

    A function's own descriptions that say something come with depth 0 (from_* is the function itself), one row each. A
    function without one inherits, and so does one whose description asks for it by a tag such as ``@inheritDoc``, beside its own: its
    owner is the nearest struct above it in the file, and the types that the owner implements (see ``parent_types``) are searched
    for a function of the same name with a description, the nearest generation first, smallest (file, line) of a
    generation first. Then doc_line is the line in from_file. What finds nothing is dropped. Every generation is searched,
    and a hierarchy with cycles ends, since no type is visited twice for one function. Nulls, repeated rows and empty tables as for
    ``descriptions``; other columns are ignored, whatever their names.
    """
    desc = store(descriptions(comments, functions, structs).where(says_something() | F.col("inherits")))
    own = desc.where(says_something()).select("file", "line", "name", "doc_line", F.col("text").alias("description"), "tags")
    out = own.select("file", "line", "name", "doc_line", "description", "tags", F.col("file").alias("from_file"), F.col("line").alias("from_line"), F.lit(0).alias("depth"))
    parents = cut(parent_types(structs).where("pfile is not null").select(F.col("file").alias("tfile"), F.col("line").alias("tline"), "pfile", "pline").distinct())
    if parents.isEmpty():  # no struct implements a known type, so there is nothing to inherit
        return out
    key = ["file", "line", "name"]
    fn = functions.where("name is not null and file is not null and line is not null").select(*key).distinct()
    # the owner: nearest struct above, so nearest following on lines counted backwards
    st = structs.where("file is not null and line is not null and name is not null")
    up = attach_following(fn.withColumn("line", -F.col("line")), st.select("file", (-F.col("line")).alias("line")), ["file"], "line", [], None)
    methods = cut(up.where("following is not null").select("file", (-F.col("line")).alias("line"), "name", F.col("file").alias("tfile"), (-F.col("following.line")).alias("tline")))
    first = own.groupBy(*key).agg(F.min("doc_line").alias("doc_line"))
    offers = methods.join(first, key).groupBy("tfile", "tline", "name").agg(F.min(F.struct("line", "doc_line")).alias("o"))
    offers = cut(offers.select(F.col("tfile").alias("pfile"), F.col("tline").alias("pline"), "name", "o"))
    asks = desc.where("inherits").select(*key).distinct()
    has = own.select(*key).distinct().join(asks, key, "left_anti")
    waiting = cut(methods.join(has, key, "left_anti"))
    visited, hits = waiting, None
    for depth in count(1):
        step = cut(waiting.join(parents, ["tfile", "tline"]).select(*key, F.col("pfile").alias("tfile"), F.col("pline").alias("tline")).distinct().join(visited, [*key, "tfile", "tline"], "left_anti"))
        if step.isEmpty():
            break
        met = step.withColumnsRenamed({"tfile": "pfile", "tline": "pline"}).join(offers, ["pfile", "pline", "name"])
        hit = cut(met.groupBy(*key).agg(F.min(F.struct("pfile", "o")).alias("m")).select(*key, F.col("m.pfile").alias("from_file"), F.col("m.o.line").alias("from_line"), F.col("m.o.doc_line").alias("doc_line"), F.lit(depth).alias("depth")))
        hits = hit if hits is None else hits.unionByName(hit)
        waiting = step.join(hit, key, "left_anti")
        visited = cut(visited.unionByName(step))
    if hits is None:
        return out
    texts = own.select(F.col("file").alias("from_file"), F.col("line").alias("from_line"), "name", "doc_line", "description", "tags")
    return out.unionByName(hits.join(texts, ["from_file", "from_line", "name", "doc_line"]).select(out.columns))
