import io
import json
import os

import pytest

from conftest import rows
from sylvan.cli import main, parse_args
from sylvan.engine import Engine
from sylvan.schema import SCHEMAS, function_columns
from sylvan.sinks import csv_lines, json_lines, plain, table_lines
from sylvan.sources.cache import RowCache
from sylvan.sources.extract import extract
from sylvan.sources.made import TEXTS, made_sql
from sylvan.sources.walk import detect_languages, snapshot, source_files, supported_languages, walk
from sylvan.streaming.watch import watch


def put(root, files):
    for name, text in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return root


def test_ignore_rules(tmp_path):
    names = ["src/lib.rs", "target/a.rs", "node_modules/b.ts", "vendor/c.go", ".venv/d.py", ".hidden/e.py", "gen/f.py", "skip.py", "own.py", "keep/x.log.py", "deep/a/b/tmp.py", "deep/a/keep.py", "build"]
    root = put(tmp_path, dict.fromkeys(names, "x") | {".gitignore": "skip.py\n/gen/\n*.log.py\n!keep/x.log.py\n", ".qlignore": "own.py\n", "deep/.ignore": "**/tmp.py\n"})
    assert [f.file for f in walk(root)] == ["deep/a/keep.py", "keep/x.log.py", "src/lib.rs"]


def test_every_folder_is_walked(tmp_path):
    put(tmp_path, {f"{a}/{b}/{c}.go": "" for a in range(6) for b in range(14) for c in "xyz"} | {"/".join("deep" * 9) + "/end.rs": ""})
    found = [f.file for f in source_files(tmp_path)]
    assert len(found) == 6 * 14 * 3 + 1 and found == sorted(found)


def test_languages(tmp_path, capsys):
    put(tmp_path, {"a.go": "", "b.rs": "", "c.ts": "", "d.tsx": "", "e.py": "", "f.txt": "", "g.PY": "", "Makefile": ""})
    assert detect_languages(tmp_path) == ["go", "python", "rust", "typescript"]
    assert supported_languages() == ["go (.go)", "rust (.rs)", "typescript (.ts, .tsx)", "python (.py)"]
    source_files(tmp_path, warn=True)
    told = capsys.readouterr().err
    assert told.count("warning: no adapter for .txt, skipping") == 1 and "files without an extension" in told
    assert [f.file for f in walk(tmp_path / "a.go")] == ["a.go"]


def test_snapshot(tmp_path):
    put(tmp_path, {"a.py": "x", "b.txt": "y"})
    one = snapshot(tmp_path)
    assert list(one) == ["a.py"] and one == snapshot(tmp_path)
    os.utime(tmp_path / "a.py", ns=(1, 1))
    assert snapshot(tmp_path) != one


def made(end, k=7, s=5, n=2):
    """One of the files that the source queries read, and the rows it must give by their SQL."""
    parts = TEXTS[end].replace(">>", "<<").split("<<")
    return "".join(x * n if i % 2 else x for i, x in enumerate(parts)).replace("$k", str(k)).replace("$s", str(s))


@pytest.mark.parametrize("end, language", [("go", "go"), ("rs", "rust"), ("ts", "typescript"), ("py", "python")])
@pytest.mark.parametrize("n", [0, 1, 5])
def test_made_files(end, language, n):
    duckdb = pytest.importorskip("duckdb")
    got = extract(language, "f", made(end, n=n)).tables
    for t, rows_ in got.items():
        want = [r[1:] for r in duckdb.sql(made_sql(t, f"SELECT 7 AS k, 5 AS s, {n} AS n")).fetchall() if r[0].endswith("." + end)]
        assert sorted(map(tuple, rows_), key=str) == sorted(want, key=str), t


def test_go_rules():
    t = extract("go", "g.go", "package orchard\n\nimport \"sort\"\n\n/* Pear is ripe. */\nfunc pick(rows ...int) bool {\n\tswitch rows[0] {\n\tcase 1:\n\t\treturn true\n\t}\n\tgo sort.Ints(rows)\n\tselect {}\n}\n\ntype Weight float64\n\ntype Crate struct {\n\tPears, Plums int\n}\n// tail\nconst max = 3\n").tables
    assert t["functions"] == [[6, "pick", "private", 0, "bool", 3, False]]  # variadics are no parameters; go and select count
    assert t["structs"] == [[17, "Crate", 1, "public", ""]] and t["variables"] == []
    assert t["comments"] == [[5, "/* Pear is ripe. */", "", True], [20, "// tail", "", False]]
    assert t["calls"] == [[11, "pick", "sort.Ints", True]] and t["imports"] == [[3, "sort", "", True]]


def test_rust_rules():
    t = extract("rust", "r.rs", "use alloc::vec as list;\npub use self::tree::Leaf;\n\nimpl Prune for Hedge {}\nstruct Hedge;\nimpl<'a> Grow<Leaf> for &Hedge {}\n\npub(crate) fn trim(&mut self, by: f32) -> Option<f32> {\n    let (a, b) = self.sides();\n    match by { x if x > 1.0 => None, _ => Some(b) }\n}\n//! inner\nconst EDGE: f32 = 0.5;\n").tables
    assert t["imports"] == [[1, "alloc::vec", "list", True], [2, "pub use self::tree::Leaf", "", False]]
    assert t["structs"] == [[5, "Hedge", 0, "private", "Grow"]]  # an impl above its struct is lost
    assert t["functions"] == [[8, "trim", "private", 1, "Option<f32>", 4, False]]
    assert sorted(t["variables"]) == [[9, "(a, b)", "", "function", False], [13, "EDGE", "f32", "module", False]]
    assert t["comments"] == [[12, "//! inner", "", True]]


def test_rust_strings_and_comments_hide_code():
    t = extract("rust", "r.rs", 'fn sow(bed: &\'static str) -> u8 {\n  let t = r##"fn weed() { if "x"# }"##; /* while /* loop */ for */\n  match bed { "} else {" | "fn" => dig(), _ => { rake()?; } }\n}\n').tables
    assert [r[1] for r in t["functions"]] == ["sow"] and t["functions"][0][3:6] == [1, "u8", 4]
    assert [r[2] for r in t["calls"]] == ["dig", "rake"] and t["fn_fingerprints"][0][-1] is True
    assert [r[1] for r in t["comments"]] == ["/* while /* loop */ for */"]


def test_typescript_rules():
    t = extract("typescript", "t.ts", "import basket from 'basket';\nimport { weigh as scale } from \"node:util\";\n/*! kept */\nabstract class Stall extends Shop {\n  protected open(hour: number): boolean { return hour > 8 ? this.ring() : false; }\n  _close() {}\n  name!: string;\n}\nvar a: number = 1, b = (x) => scale(x);\nfunction sell(...all: string[]) { do { a++; } while (a || b); }\n").tables
    assert t["imports"] == [[1, "'basket'", "", False], [2, "node:util", 'scale } from "node:util"', True]]
    assert t["structs"] == [[4, "Stall", 3, "public", ""]]
    assert [r[1:4] for r in t["functions"]] == [["open", "internal", 1], ["_close", "private", 0], ["sell", "public", 1]]
    assert [(r[1], r[2], r[4]) for r in t["variables"]] == [("a", ": number", True), ("b", "", True)]
    assert [r[1:] for r in t["calls"]] == [["open", "this.ring", True], ["", "scale", False]]
    assert t["comments"] == [[3, "/*! kept */", "", True]]


def test_python_rules():
    t = extract("python", "p.py", "import a.b, c as d\nfrom . import e\n#. doc\nclass Tree(Plant, metaclass=Meta):\n    height = 3\n    @property\n    def tall(self): return self.height > 3 or self.old()\n    def __init__(self, a: int, b: int = 1, **more): pass\nrows = [r for r in open(p) if r]\nasync def grow(*, by):\n    async with lock:\n        x = y = await water(by)\n").tables
    assert t["imports"][0] == [1, "a.b, c as d", "d", False] and len(t["imports"]) == 2
    assert t["structs"] == [[4, "Tree", 1, "public", "Plant,metaclass=Meta"]]  # a decorated method and an assignment are no direct children
    assert [r[1:4] for r in t["functions"]] == [["tall", "public", 1], ["__init__", "private", 3], ["grow", "public", 1]]  # b has a type and a default
    assert t["functions"][0][5] == 2 and [r[2] for r in t["calls"]] == ["self.old", "open", "water"]
    assert t["comments"] == [[3, "#. doc", "", True]]


def test_python_without_indents():
    t = extract("python", "p.py", "class Row(Bed):\ndef dig(self):\n    pass\ndef fill(self):\nreturn 1\nseed = 2\n").tables
    assert [r[1] for r in t["functions"]] == ["dig", "fill"] and t["structs"][0][4] == "Bed" and [r[1] for r in t["variables"]] == ["seed"]


def test_python_matches_ast():
    import ast
    import inspect

    import sylvan.sources.extract.python as module

    text = inspect.getsource(module)
    tree = ast.parse(text)
    t = extract("python", "m.py", text).tables
    defs = [n for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
    assert sorted((r[0], r[1]) for r in t["functions"]) == sorted((n.lineno, n.name) for n in defs)
    assert sorted(r[2] for r in t["calls"]) == sorted(ast.get_source_segment(text, n.func) for n in ast.walk(tree) if isinstance(n, ast.Call))
    assert sorted(r[0] for r in t["structs"]) == sorted(n.lineno for n in ast.walk(tree) if isinstance(n, ast.ClassDef))
    returns = {n.name: sum(isinstance(x, ast.Return) for x in ast.walk(n)) for n in defs}
    assert {r[1]: r[9] for r in t["fn_fingerprints"]} == returns


def test_broken_text_is_survived():
    for lang in ("go", "rust", "typescript", "python"):
        for text in ("", "}}}}", "((((", '"', "`${", "func (", "fn f(", "def f(", "class", "/*", "import", "match x {", "\x00", "é" * 10):
            extract(lang, "x", text)


def test_engine_from_path(spark, tmp_path):
    put(tmp_path, {"p/m.py": "#: Doc\ndef plant(a, b):\n    if a:\n        return log(a)\n    return b\n\ndef test_plant():\n    plant(1, 2)\n", "m.go": made("go"), "m.rs": made("rs"), "m.ts": made("ts"), "n.txt": "x", "pkg/__init__.py": "x = 1\n"})
    e = Engine.from_path(spark, tmp_path)
    assert rows(e.sql("SELECT name, file, line FROM functions WHERE has_test = true")) == [("plant", "p/m.py", 2)]
    assert rows(e.sql("SELECT attached_to FROM comments WHERE file = 'p/m.py'")) == [("plant",)]
    assert rows(e.sql("SELECT file FROM variables WHERE file LIKE 'pkg%'")) == [("pkg/__init__.py",)]
    assert all(e.table(t).columns == s.names for t, s in SCHEMAS.items())
    assert e.select_functions().columns == function_columns()
    e.close()


def test_bad_encoding(spark, tmp_path):
    (tmp_path / "a.py").write_bytes(b"x = '\xff'\n")
    put(tmp_path, {"b.py": "y = 1\n"})
    with pytest.raises(Exception, match="failed to read"):
        Engine.from_path(spark, tmp_path, persist=False).table("variables").collect()
    assert rows(Engine.from_path(spark, tmp_path, on_error="skip", persist=False).sql("SELECT name FROM variables")) == [("y",)]


def test_cache(spark, tmp_path):
    root, folder = put(tmp_path / "src", {"a.py": "x = 1\n", "b.py": "y = 1\n"}), tmp_path / "cache"
    names = lambda: sorted(r.s1 for r in RowCache(spark, folder).rows(source_files(root)).where("kind = 'variables'").collect())
    assert names() == ["x", "y"]
    (root / "b.py").unlink()
    put(root, {"a.py": "x = 1\nz = 2\n", "c.py": "w = 1\n"})
    assert names() == ["w", "x", "z"]
    for p in folder.rglob("*.parquet"):
        p.unlink()
    assert names() == ["w", "x", "z"]


def test_sinks():
    cols, data = ["name", "n"], [["main", 4], ["add", 12]]
    assert "".join(table_lines(cols, data)) == "name  n \n----  --\nmain   4\nadd   12\n"
    assert "".join(table_lines(["t"], [["x" * 70], [None]])).splitlines()[2] == "x" * 57 + "..."
    assert "".join(table_lines([], [])) == ""
    assert "".join(json_lines(["b", "a", "a"], [[1, "x", True]])) == '[{"a":true,"b":1}]\n'
    assert "".join(json_lines(["a"], [])) == "[]\n"
    assert "".join(csv_lines(["a", "b"], [['q"u', None], ["x,y", False], ["ü", 1.5]])) == 'a,b\n"q""u",null\n"x,y",false\nü,1.5\n'


def test_plain_values():
    import datetime as dt
    import decimal

    assert plain(decimal.Decimal("1.50")) == "1.50" and plain({"a": 1}) == [["a", 1]] and plain([1, None]) == [1, None]
    assert plain(dt.datetime(1970, 1, 1, 0, 0, 1)) == 1_000_000 and plain(dt.date(1970, 1, 3)) == 2


def test_cli(spark, tmp_path, capsys):
    root = put(tmp_path, {"a.py": "def f():\n    pass\n"})
    out = io.StringIO()
    assert main(["--format", "json", "SELECT name, line FROM functions", str(root)], spark, out) == 0
    assert json.loads(out.getvalue()) == [{"name": "f", "line": 1}]
    for argv, said in [(["--nope"], "unknown flag --nope"), ([], "query is required"), (["a", "b", "c"], "expected <query> [path]"), (["--format"], "--format requires a value"), (["--format", "xml", "q"], 'unsupported format "xml"'), (["q", "/nowhere"], "does not exist")]:
        assert main(argv, spark) == 1
        assert said in capsys.readouterr().err
    assert main(["SELECT x FROM", str(root)], spark) == 1
    assert "Error[E001]" in capsys.readouterr().err
    assert main(["SELECT nope FROM functions", str(root)], spark) == 1
    assert "internal error" in capsys.readouterr().err
    assert main(["--langs"], spark, out) == 0
    assert parse_args(["--watch", "q", str(root)])["watch"] is True


def test_watch(spark, tmp_path):
    root, out, turns = put(tmp_path, {"a.py": "x = 1\n"}), io.StringIO(), iter([True, True, False])

    def go_on():
        go = next(turns)
        if go:
            put(root, {f"b{len(list(root.iterdir()))}.py": "y = 1\n"})
        return go

    watch(spark, "SELECT name FROM variables ORDER BY name", root, "csv", out, interval=0.0, go_on=go_on)
    assert out.getvalue().split("\x1b[H\x1b[2J")[1:] == ["name\nx\n", "name\nx\ny\n", "name\nx\ny\ny\n"]


def test_long_stretches_before_a_construct():
    def calls(t):
        return [r[2] for r in t["calls"]]

    variants = "".join(f"    V{k}(Box<T{k}>),\n" for k in range(300))
    t = extract("rust", "m.rs", f"enum E {{\n{variants}}}\nfn f() {{ g(); }}\n").tables
    assert calls(t) == ["g"]
    bounds = ", ".join(f"T{k}: Show<[u8; 4]>" for k in range(60))
    t = extract("rust", "m.rs", f"fn f() {{\n    impl<{bounds}> Greet<[u8; 4]> for User {{\n        fn g(&self) {{ for x in y {{ }} }}\n    }}\n}}\n").tables
    assert {r[1]: r[6] for r in t["fn_fingerprints"]} == {"f": 1, "g": 1}
    params = ", ".join(f"p{k} map[string]int" for k in range(40))
    t = extract("go", "m.go", f"package m\n\nfunc f() {{\n\tfunc({params}, q interface{{}}) {{\n\t\tg()\n\t}}(1)\n\tfunc(a int) func(b int) {{\n\t\treturn nil\n\t}}(2)\n}}\n").tables
    assert len(calls(t)) == 3 and calls(t)[0] == "g" and calls(t)[1].startswith("func(p0") and calls(t)[2].startswith("func(a int)")
    entries = "".join(f"\t\tc{k} = T{{{k}}}\n" for k in range(200))
    t = extract("go", "m.go", f"package m\n\nfunc f() {{\n\tvar (\n{entries}\t)\n\tx = 1\n}}\n").tables
    assert t["fn_fingerprints"][0][-2] == 1
    types = ", ".join(f"T{k} extends Map<string, number[]>" for k in range(90))
    t = extract("typescript", "m.ts", f"function f<{types}>(a: T1): void {{\n  g();\n}}\n").tables
    assert [r[1] for r in t["functions"]] == ["f"] and calls(t) == ["g"]
    names = ", ".join(f"I{k}" for k in range(60))
    t = extract("typescript", "m.ts", f"function f() {{\n  class A implements {names} {{\n    x;\n    y;\n  }}\n}}\n").tables
    u = extract("typescript", "m.ts", "function f() {\n  class A implements I {\n    x;\n    y;\n  }\n}\n").tables
    assert t["fn_fingerprints"][0][1:] == u["fn_fingerprints"][0][1:]
