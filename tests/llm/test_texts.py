"""Text operators against brute force, round trips and held-out sentences."""
import random
import re

import numpy as np
import pytest

from conftest import rows
from sylvan.llm.docpairs import bare, content, paired_functions, parent_types, parse_doc
from sylvan.llm.hidden_language import COST_BOUNDS, LANGS, STATES, Model, fit, hidden_text, labelled_lines, observed, pieces, plain_lines, repair, running_text, sample_of, spans, unescape, viterbi
from sylvan.llm.leaks import leaked_items
from sylvan.llm.packing import TOKENIZER, Capacity, best_fit, pack, token_counts
from sylvan.llm.queries import QUERIES
from sylvan.llm.repetition import measure, repeated_words, repetition
from sylvan.llm.words import NONE, shingle_hashes, window_min

# --- leaks ---

DOC, EVAL = "doc_id long, text string, item_id string, sketch string", "item_id long, text string, task string"


def words_of(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def brute_leaks(docs, items, p):
    out = set()
    for d, t in docs:
        w = words_of(t)
        grams = {tuple(w[k : k + p]) for k in range(len(w) - p + 1)}
        for i, s in items:
            v = words_of(s)
            if any(tuple(v[k : k + p]) in grams for k in range(len(v) - p + 1)):
                out.add((d, i))
    return sorted(out)


@pytest.mark.parametrize("limit", [10**9, -1])
def test_leaks(spark, limit):
    rng = random.Random(6)
    vocab = [f"w{k}" for k in range(40)] + ["Über", "x9", "日本"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(k, text(rng.choice([3, 14, 15, 16, 40]))) for k in range(12)] + [(50, None), (51, " ")]
    items.append((99, items[5][1]))
    docs = []
    for k in range(40):
        part = words_of(rng.choice(items[:12])[1])
        cut = part[rng.randrange(3) : len(part) - rng.randrange(3)]
        docs.append((k, text(rng.randrange(60)) + " zz " + rng.choice([" ", "\n* ", "__", "-"]).join(cut).upper() + " zz " + text(9)))
    docs += [(100, None), (101, ""), (102, "..."), (7, docs[7][1])]
    d = spark.createDataFrame([(*x, "clash", "clash") for x in docs], DOC)
    i = spark.createDataFrame([(*x, None) for x in items], EVAL)
    got = leaked_items(d, i, index_bytes=limit)
    grams = lambda t: {tuple(w[k : k + 15]) for w in [words_of(t)] for k in range(len(w) - 14)}
    for r in got.collect():
        item, there = grams(dict(items)[r.item_id]), grams(dict(docs)[r.doc_id])
        assert (r.passages, r.containment) == (len(item & there), len(item & there) / len(item))
    assert rows(got.select("doc_id", "item_id")) == brute_leaks(docs, items, 15) != []
    assert leaked_items(d.limit(0), i, index_bytes=limit).collect() == [] == leaked_items(d, i.limit(0), index_bytes=limit).collect()


def test_leak_at_the_end_of_a_very_long_text(spark):
    item = " ".join(f"k{n}" for n in range(20))
    d = spark.createDataFrame([(1, "a b " * 700_000 + item)], "doc_id long, text string")
    assert rows(leaked_items(d, spark.createDataFrame([(3, item)], "item_id long, text string"))) == [(1, 3, 6, 1.0)]


def test_size_classes():
    from sylvan.llm.leaks import class_threshold, size_class

    for n in range(1, 300):
        assert 0.5 / n < class_threshold(size_class(n)) <= 1 / n


def test_window_min():
    a = np.array(random.Random(1).sample(range(1000), 50), np.uint64)
    for w in (1, 2, 3, 8, 11, 50):
        assert window_min(a, w).tolist() == [min(a[k : k + w]) for k in range(50 - w + 1)]
    assert len(window_min(a, 51)) == 0 and (shingle_hashes(np.array([1, 0, 2], np.uint64), 2) == NONE).all()


# --- repetition ---


def brute_repeated(text, k=8):
    w = [x for x in re.findall(r"[^\W\d_]+", (text or "").lower())]
    seen, hit = set(), set()
    for i in range(len(w) - k + 1):
        g = tuple(w[i : i + k])
        if g in seen:
            hit.update(range(i, i + k))
        seen.add(g)
    return len(w), len(hit)


def texts(seed, count):
    rng = random.Random(seed)
    out = []
    for _ in range(count):
        vocab = [f"{rng.choice('abcdefgh')}{'xyzuvw'[k % 6]}{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(rng.choice([30, 300, 3000]) % 600 + 20)]
        w = [rng.choice(vocab) for _ in range(rng.choice([5, 20, 200, 1500]))]
        for _ in range(rng.randrange(4)):
            a = rng.randrange(len(w))
            w[a:a] = w[max(0, a - rng.choice([4, 10, 200])) : a] * rng.randrange(1, 4)
        out.append(rng.choice([" ", "\n", ", ", " 1 "]).join(w))
    return out


def test_repetition(spark):
    data = list(enumerate(texts(8, 120))) + [(500, None), (501, ""), (502, "a " * 5), (503, "1 2 3"), (504, "Aa bB " * 40)]
    data.append((3, data[3][1]))
    got = repetition(spark.createDataFrame([(*d, 1, "x") for d in data], "doc_id long, text string, ratio int, band string")).collect()
    assert len(got) == len(data)
    want = {i: brute_repeated(t) for i, t in data}
    for r in got:
        n, hit = want[r.doc_id]
        assert r.n_words == n
        assert r.repeated == hit if r.repeated is not None else hit * 10 < n * 4
    assert any(r.band == "clean" for r in got) and any(r.band == "repetitive" for r in got)
    assert repetition(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_bands_never_hide_a_repetitive_text():
    import zstandard

    z = zstandard.ZstdCompressor(level=9)
    rng, tested = random.Random(11), 0
    for n in (16, 20, 40, 100, 300, 1000):
        for unit in (8, 9, 20, 100):
            w = [f"q{''.join(rng.choice('abcdefghij') for _ in range(6))}" for _ in range(n)]
            for _ in range(-(-7 * n // (10 * unit))):  # scattered runs, down to the shortest length that counts
                a, b = rng.randrange(max(1, len(w) - unit)), rng.randrange(len(w) + 1)
                w[b:b] = w[a : a + unit]
            total, hit = brute_repeated(" ".join(w))
            if hit * 10 >= total * 4:
                tested += 1
                assert measure(" ".join(w), 0.4, 8, z)[5] == hit, (n, unit)
    assert tested >= 8


@pytest.mark.parametrize("fresh, runs", [(20_000, 2046), (30_000, 3_000), (1_200_000, 0), (2_500_000, 0)])
def test_long_repetitive_texts_are_counted(fresh, runs):
    import zstandard

    rng = np.random.default_rng(7)
    if runs:  # runs of 8 words of the first half, scattered over the second
        old, new = np.split(np.arange(fresh), [fresh // 2])
        pieces = np.array_split(new, runs)
        ids = np.concatenate([old, *(np.concatenate([p, old[a : a + 8]]) for p, a in zip(pieces, rng.integers(0, len(old) - 8, runs)))])
    else:  # a second half that copies the first, beyond the compressor's window
        ids = np.tile(rng.integers(0, 200_000 if fresh < 2_000_000 else 60_000, fresh), 2)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    words = np.array(["".join(w) for w in letters[np.arange(200_000)[:, None] // 26 ** np.arange(4) % 26]])[ids]
    n, ratio, _, _, band, repeated = measure(" ".join(words), 0.4, 8, zstandard.ZstdCompressor(level=9))
    assert n == len(ids) and band == "repetitive"
    first, hit = {}, np.zeros(n, bool)
    raw = ids.astype(np.uint32).tobytes()
    if runs:
        for p in range(n - 7):
            if first.setdefault(raw[4 * p : 4 * p + 32], p) < p:
                hit[p : p + 8] = True
        assert repeated == hit.sum() >= 0.4 * n
    else:
        assert repeated >= n // 2


def test_shares_of_long_texts(spark, tmp_path):
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    words = np.array(["".join(w) for w in letters[np.arange(400_000)[:, None] // 26 ** np.arange(4) % 26]])
    words[np.arange(300_000, 400_000, 1000)[:, None] + np.arange(8)] = words[np.arange(0, 100_000, 1000)[:, None] + np.arange(8)]
    data = [(1, " ".join(words)), (2, " ".join(words[:300_000])), (3, ""), (4, None)]
    spark.createDataFrame(data, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert rows(QUERIES["p10_shares"](spark, str(tmp_path))) == [(1, 400_000, 800), (2, 300_000, 0), (3, 0, 0)]


@pytest.mark.parametrize("k", [1, 3, 5, 8, 11])
def test_sorted_runs_equal_looked_up_ones(k):
    rng = np.random.default_rng(k)
    a = rng.integers(0, 40, 6000).astype(np.uint16)
    a[3000:3300] = a[100:400]
    w = [chr(97 + x // 26) + chr(97 + x % 26) for x in a]
    assert repeated_words(a, k) == brute_repeated(" ".join(w), k)[1]


def test_four_byte_words():
    a = np.concatenate([np.arange(70_000), np.arange(30_000)]).astype(np.uint32)
    assert repeated_words(a, 8) == 30_000


# --- packing ---


def check_packing(parts, sizes, cap):
    boxes = {}
    for d, p, n, box in parts:
        if box is not None:
            boxes.setdefault(box, []).append(n)
    assert all(sum(v) <= cap.tokens and len(v) <= cap.docs and sum(x * x for x in v) <= cap.attention for v in boxes.values())
    whole = {}
    for d, p, n, box in parts:
        whole.setdefault(d, []).append((p, n))
    for d, n in sizes.items():
        got = sorted(whole[d])
        assert sum(x for _, x in got) == (n or 0)
        assert len(got) == max(1, -(-(n or 0) // cap.tokens)) and [p for p, _ in got] == list(range(len(got)))
    return boxes


@pytest.mark.parametrize("choose", ["norm", "dot"])
@pytest.mark.parametrize("shard", [8192, 50])
def test_packing(spark, choose, shard):
    rng = random.Random(9)
    sizes = {k: rng.choice([0, 1, 7, 100, 600, 1200, 2047, 2048, 2049, 5000, rng.randrange(1, 2048)]) for k in range(400)} | {900: None}
    cap = Capacity(docs=12)
    df = spark.createDataFrame([(k, n) for k, n in sizes.items()], "doc_id long, n_tokens long")
    got = [tuple(r) for r in pack(df, cap, shard, choose).collect()]
    boxes = check_packing(got, sizes, cap)
    used = sum(n or 0 for n in sizes.values())
    if shard == 8192:
        assert len(boxes) <= 1.03 * used / cap.tokens + 2
    assert pack(df.limit(0), cap).collect() == []


def test_attention_capacity_is_kept():
    sizes = np.array([500] * 20)
    assert max(np.bincount(best_fit(sizes, Capacity(tokens=2000, attention=600_000)))) == 2
    with pytest.raises(ValueError):
        pack(None, Capacity(attention=0))


def test_every_constraint_binds_and_changes_the_packing(spark):
    rng = random.Random(13)
    sizes = {k: rng.choice([3, 5, 9, 60, 200, 700, 900, 1500, 2000, 3000]) for k in range(500)}
    df = spark.createDataFrame(list(sizes.items()), "doc_id long, n_tokens long")
    got, boxes = {}, {}
    for name, cap in {"tokens": Capacity(), "docs": Capacity(docs=6), "attention": Capacity(attention=1024 * 1024), "all": Capacity(docs=6, attention=1024 * 1024)}.items():
        got[name] = [tuple(r) for r in pack(df, cap).collect()]
        parts = {}
        for _, _, n, box in got[name]:
            parts.setdefault(box, []).append(n)
        assert all(sum(v) <= cap.tokens and len(v) <= cap.docs and sum(x * x for x in v) <= cap.attention for v in parts.values())
        assert all(sum(n for d, _, n, _ in got[name] if d == k) == s for k, s in sizes.items())
        assert all(n <= cap.longest for _, _, n, _ in got[name])
        boxes[name] = parts
    assert max(map(len, boxes["docs"].values())) == 6 < max(map(len, boxes["tokens"].values()))
    cost = lambda v: sum(x * x for x in v)
    assert max(map(cost, boxes["tokens"].values())) > 1024 * 1024 >= max(map(cost, boxes["attention"].values())) > 0.9 * 1024 * 1024
    together = {name: frozenset(frozenset((d, p) for d, p, _, b in rows_ if b == box) for box in boxes[name]) for name, rows_ in got.items()}
    assert len(set(together.values())) == 4


def test_token_counts(spark):
    import os

    if not os.path.exists(TOKENIZER):
        pytest.skip("no tokenizer files")
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "<|endoftext|>"), (5, "x y " * 100_000)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts(df).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1 and got[5] > 100_000


# --- documentation ---


def test_content():
    assert bare("/**\n * Adds `x`.\n * @param a first\n * :returns:\n * ------\n */") == "Adds `x`. a first"
    assert content("/// Adds two numbers up", "add")[1:] == (4, 0)
    assert content("/// add two numbers", "addTwo")[1:] == (1, 0)
    assert content("// TODO: n/a tbd", "f")[1:] == (0, 0)
    assert content("/* 保存最后一次已知的位置 */", "f")[1:] == (0, 11)
    assert content(None, None) == ("", 0, 0)
    assert content("//! ==== #", "f") == ("#", 0, 0)


C, F_, S = "file string, line long, text string, attached_to string, is_doc boolean", "file string, line long, name string", "file string, line long, name string, implements string"


def test_pairs(spark):
    long = "/// Says what it does here"
    comments = [
        ("a", 1, long, " `Own::run()` ", True), ("a", 2, "/// more", "run", True),  # one description of run at 5
        ("a", 3, long, "nowhere", True), ("a", 4, long, "run", False), ("a", 4, long, "run", None),
        ("a", 7, "/** two\n lines */", None, True), ("a", 9, "/// of words more", "", True),  # next lines: one description of next at 12
        ("a", 20, long, None, True),  # a struct comes first
        ("a", 30, "// TODO: write docs now", "half", True),
        ("a", 40, None, "gone", True), ("a", 41, long, "gone", True),
        ("b", 1, "/// @inheritDoc", "draw", True), ("b", 50, "/// Draws every shape of it", "draw", True),
    ]
    functions = [("a", 5, "run"), ("a", 5, "run"), ("a", 12, "next"), ("a", 25, "late"), ("a", 32, "half"), ("a", 44, "gone"), ("a", 60, None), ("b", 4, "draw"), ("b", 24, "draw"), ("b", 52, "draw"), ("b", 70, "draw")]
    structs = [("a", 22, "Stop", None), ("b", 3, "Child", "Mid, Other"), ("b", 23, "Mid", "ns::Base<T>"), ("b", 51, "Base", "Child"), ("b", 69, "Loop", "Loop")]
    got = paired_functions(spark.createDataFrame(comments * 2, C), spark.createDataFrame(functions, F_), spark.createDataFrame(structs, S))
    assert rows(got.where("depth = 0").select("file", "line", "name", "doc_line")) == [("a", 5, "run", 1), ("a", 12, "next", 7), ("a", 44, "gone", 40), ("b", 52, "draw", 50)]
    assert rows(got.where("depth > 0").select("line", "doc_line", "from_line", "depth")) == [(4, 50, 52, 2), (24, 50, 52, 1)]


def test_documentation_many_generations_up(spark):
    structs = [("a", 10 * k + 1, f"T{k}", f"T{k + 1}") for k in range(34)] + [("a", 341, "T34", None)]
    got = paired_functions(spark.createDataFrame([("a", 342, "/// Draws the whole thing at once", None, True)], C), spark.createDataFrame([("a", 3, "draw"), ("a", 343, "draw")], F_), spark.createDataFrame(structs, S))
    assert rows(got.select("line", "doc_line", "from_line", "depth")) == [(3, 342, 343, 34), (343, 342, 343, 0)]


def test_tags():
    d = parse_doc("/**\n * Adds `x` up.\n * @param a the first  ----\n * :param b: second one\n * <b>bold</b>\n * {@inheritDoc}\n */")
    assert d.text == "Adds `x` up. a the first second one bold" and d.inherits
    assert d.tags == [("param", "a the first"), ("param", "b second one"), ("inheritdoc", "")]
    assert parse_doc("// plain: words, e.g. this").tags == [] and not parse_doc("// inherit").inherits


def test_parent_types(spark):
    structs = [
        ("p/a.rs", 1, "Own", "Base, Near<T>, Far, Two, Nobody, Own, Both"), ("p/a.rs", 9, "Base", ""), ("q/a.rs", 2, "Base", ""), ("p/b.rs", 3, "Near", None), ("q/c.rs", 4, "Near", None),
        ("r/d.rs", 5, "Far", None), ("r/e.rs", 6, "Two", None), ("s/e.rs", 7, "Two", None), ("p/x.rs", 1, "Both", None), ("p/y.rs", 1, "Both", None), (None, 1, "Base", None), ("p/a.rs", None, "Far", None),
    ]
    got = rows(parent_types(spark.createDataFrame(structs * 2, S)).select("parent", "scope", "pfile", "pline"))
    assert got == sorted([("Base", "file", "p/a.rs", 9), ("Near", "folder", "p/b.rs", 3), ("Far", "corpus", "r/d.rs", 5), ("Two", "ambiguous", None, None), ("Nobody", "unknown", None, None), ("Both", "ambiguous", None, None)], key=str)


def test_documentation_that_asks_for_more(spark):
    """A tag asks for the inherited text beside one's own; without a tag, one's own is all."""
    structs = [("a", 1, "One", "Base"), ("a", 11, "Two", "Base"), ("a", 21, "Base", None), ("b", 1, "Three", "Base"), ("z", 1, "Base", None)]
    functions = [("a", 3, "draw"), ("a", 13, "draw"), ("a", 23, "draw"), ("b", 3, "draw"), ("z", 3, "draw")]
    comments = [("a", 2, "/// Draws in red and blue {@inheritDoc}", None, True), ("a", 12, "/// Draws in black and white", None, True), ("a", 22, "/// Draws every shape of it", None, True), ("z", 2, "/// Draws of an unrelated file", None, True)]
    got = paired_functions(spark.createDataFrame(comments, C), spark.createDataFrame(functions, F_), spark.createDataFrame(structs, S))
    want = [("a", 3, 2, "a", 3, 0), ("a", 3, 22, "a", 23, 1), ("a", 13, 12, "a", 13, 0), ("a", 23, 22, "a", 23, 0), ("z", 3, 2, "z", 3, 0)]  # Base is ambiguous for b
    assert rows(got.select("file", "line", "doc_line", "from_file", "from_line", "depth")) == sorted(want)
    assert {r.description for r in got.where("depth = 1").collect()} == {"Draws every shape of it"}


def test_tie_between_struct_and_function(spark):
    got = paired_functions(spark.createDataFrame([("a", 1, "/// a b c d e", None, True)], C), spark.createDataFrame([("a", 3, "f")], F_), spark.createDataFrame([("a", 3, "S", None)], S))
    assert rows(got.select("name")) == [("f",)]


def test_pairs_of_nothing(spark):
    e = lambda s: spark.createDataFrame([], s)
    assert paired_functions(e(C), e(F_), e(S)).collect() == []


# --- hidden language ---

SENTENCES = {
    "en": ["The buffer is flushed when the reader has finished all of its work", "Returns the number of rows that were written to the file"],
    "de": ["Der Puffer wird geleert, wenn der Leser mit der Arbeit fertig ist", "Gibt die Anzahl der Zeilen zurück, die in die Datei geschrieben wurden"],
    "fr": ["Le tampon est vidé quand le lecteur a fini tout le travail de la file", "Renvoie le nombre de lignes qui sont écrites dans le fichier par la tâche"],
    "es": ["El búfer se vacía cuando el lector ha terminado con todo el trabajo", "Devuelve el número de las filas que se escriben en el archivo para la tarea"],
    "pt": ["O buffer é esvaziado quando o leitor não tem mais trabalho para as tarefas", "Devolve o número de linhas que são escritas no arquivo em uma tarefa"],
    "it": ["Il buffer è svuotato quando il lettore ha finito con tutto il lavoro della coda", "Restituisce il numero delle righe che sono scritte nel file per ogni lavoro"],
    "ru": ["Буфер очищается когда читатель закончил всю свою работу над файлом"],
    "zh": ["读取器完成所有工作以后，缓冲区会被清空。"],
    "ja": ["読み込みがすべて終わったときにバッファを空にする。"],
}
CODE = ["x := y.Run(ctx)", "for (const a of b) { c.push(d); }", "if err != nil { return err }", "SELECT a, b FROM functions;", "let mut v = Vec::<Plan>::new();", "return [x for x in packet if x.snapshot]", "self.merge(left, right)", "def run(a, b):"]


@pytest.fixture(scope="module")
def table():
    return fit([f"// {s}." for v in SENTENCES.values() for s in v] * 3 + [f"// {c}" for c in CODE] * 3)


@pytest.mark.parametrize("end", [" (see above)", ":", ";", " [sic]"])
def test_prose_may_end_like_code(table, end):
    assert spans([f"// {SENTENCES['en'][0]}{end}"], table)[0].get("en", (0,))[0] >= 8


def found(texts, table):
    return [{k for k, (w, c, _) in g.items() if w >= 5 or c >= 8} for g in spans(texts, table)]


def test_languages(table):
    assert found([f"/// {s}." for v in SENTENCES.values() for s in v], table) == [{k} for k, v in SENTENCES.items() for _ in v]
    assert found([f"// {c}" for c in CODE], table) == [set()] * len(CODE)


def test_literals_and_trailing_comments(table):
    s, g = SENTENCES["en"][0], SENTENCES["de"][1]
    esc = g.encode("unicode_escape").decode().replace("\\xfc", "\\u00fc")
    got = found([f'// log.Printf("{s}", x)', f"# del a[0]  # {s}", f'// return f("{esc}");  // {s}', f"/**\n * {s}\n * {g}\n * @param x\n */", f"// fixme(run): {s}", f"// {g}".encode().decode("latin-1"), "// `a_b` run x", '// f("ok")', None, "", "//"], table)
    assert got == [{"en"}, {"en"}, {"de", "en"}, {"en", "de"}, {"en"}, {"de"}, set(), set(), set(), set(), set()]


def test_repair_and_escapes():
    assert repair("fÃ¼r Ã\xa0 naïve été") == "für à naïve été"
    assert repair("Ð¡Ð¾Ñ€Ñ‚") == "Сорт"
    assert unescape(r"aé\x41\n&eacute;&#233; \U0001F600") == "aéA éé 😀"
    assert [code for _, code in labelled_lines("// a_b foo() x\n# plain words")] == [True, False]
    assert plain_lines("/**\r\n * One\r\n */") == "\nOne\n" and plain_lines("x = 1  // why") == "x = 1 \nwhy"
    assert observed("Uses `a b` and fooBar, f(x) at a/b.c İ") == "uses \x01 and \x01, \x02x) at \x01 i"
    assert STATES == ("code", *LANGS, "other")


def test_code_full_of_words(table):
    """Held-out lines of queries and code whose words are those of prose."""
    lines = [
        "-- insert into table values select distinct city from people", "# select name from users left join orders", "// select id, name from users where id in (select id from t) order by name desc",
        "-- update users set name = null where id is not null", "// export default function render(props)", "# from os import path as join_path", "// if value is not none and key in names: continue", "# while true: break", "-- create table people (name text not null, city text)",
    ]
    assert found(lines, table) == [set()] * len(lines)
    assert found(["// Повертає кількість рядків, що були записані до файлу, якщо сталася помилка"], table) == [set()]  # none of the nine


def test_a_comment_is_one_sequence(table):
    s, g = SENTENCES["en"], SENTENCES["fr"]
    text = f"/*\n * {s[0]}\n * x := y.Run(ctx)\n * {g[0]},\n * {s[1]}. */"
    (got,) = spans([text], table)
    assert {k: v[0] for k, v in got.items()} == {"en": sum(len(re.findall(r"\w+", x)) for x in s), "fr": len(re.findall(r"\w+", g[0]))}


def test_costs_are_fitted_within_their_bounds(table):
    assert isinstance(table, Model) and all(lo <= c <= hi for c, (lo, hi) in zip(table.cost, COST_BOUNDS))
    assert np.isfinite(table.table).all() and (table.table[-1] == 0).all()


def test_viterbi_equals_brute_force():
    from itertools import product

    rng = np.random.default_rng(5)
    table = np.vstack([rng.normal(size=(9, 3)), np.zeros(3)]).astype(np.float32)
    codes, cost = rng.integers(0, 9, (6, 6)), rng.uniform(0, 2, (6, 6)).astype(np.float32)
    codes[5, 4:] = 9
    path = viterbi(codes, cost, table)
    for r in range(6):
        worth = lambda p: sum(table[codes[r, t], p[t]] - (cost[r, t] if t and p[t] != p[t - 1] else 0) for t in range(6))
        assert abs(worth(path[r]) - max(map(worth, product(range(3), repeat=6)))) < 1e-4


def test_pieces():
    text = "ab cd\n" * 700 + "x" * 5000
    got = pieces(text)
    assert "".join(got) == text and max(map(len, got)) <= 2000 and got[0].endswith("cd")


def test_spans_are_no_longer_than_their_texts(table):
    texts_ = [f"// {s} &eacute;\\u00e9 `a_b` İİİ" for v in SENTENCES.values() for s in v]
    assert all(sum(v[2] for v in g.values()) <= len(t) for t, g in zip(texts_, spans(texts_, table)))


def test_very_long_text(table):
    text = "// " + (SENTENCES["en"][0] + " ") * 3000
    (g,) = spans([text], table)
    assert g["en"][0] >= 12 * 3000


def test_sample_is_bounded(spark):
    """Equal texts come once, very long ones not at all, and what comes does not grow with the rows."""
    df = spark.range(30_000).selectExpr("if(id % 3 = 0, 'the same text', concat('text ', id)) AS t").unionAll(spark.createDataFrame([("x" * 100_000,), (None,)], "t string"))
    got = sample_of(df, "t", 300, 1_000_000)
    assert 150 < len(got) < 400 and got == sorted(set(got)) and max(map(len, got)) < 20
    assert 30 < len(sample_of(df, "t", 20_000, 1000)) < 150 and sample_of(df.limit(0), "t") == [] and len(sample_of(df, "t", 40_000, 10**9)) == 20_002


def test_hidden_table(spark):
    data = [("f", n, f"// {s}.", n) for n, (k, v) in enumerate(SENTENCES.items()) for s in v] * 2 + [("f", 90, None, 1), ("f", 91, " ", 1), (None, 92, f"// {SENTENCES['en'][0]}", 1)]
    df = spark.createDataFrame(data, "file string, line long, text string, words long")
    got = hidden_text(df, ["file", "line"]).where(running_text())
    want = sorted({("f", n, k) for n, k in enumerate(SENTENCES)} | {(None, 92, "en")}, key=str)
    assert sorted({tuple(r) for r in got.select("file", "line", "nl_lang").collect()}, key=str) == want
    assert hidden_text(df.limit(0), ["file", "line"]).collect() == []
