from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions.lexer import code_facts, code_spans
from quarry.functions.names import is_definition_line, is_test_symbol, kind_named, language_of
from quarry.operators import content, filters, graph, notes, structure, symbols
from quarry.sources import annotations as A
from quarry.sources.files import load_files, read_index, scan_files, write_index
from quarry.streaming import changes as ch


def files(spark, rows):
    return load_files(spark.createDataFrame([("p", path, body) for path, body in rows], "project string, path string, content string"))


def test_lines(spark):
    cases = {"": 0, "a": 1, "a\n": 1, "a\r\nb\n\n": 3, "\n": 1, "a\r": 1}
    f = files(spark, [(f"f{k}", body) for k, body in enumerate(cases)])
    got = {r["path"]: r["n"] for r in f.select("path", F.size(T.line_array(F.col("content"))).alias("n")).collect()}
    assert [got[f"f{k}"] for k in range(len(cases))] == list(cases.values())
    rows = content.lines(files(spark, [("x", "é\r\nb\n")])).orderBy("line_no").collect()
    assert [(r["text"], r["start_byte"]) for r in rows] == [("é", 0), ("b", 4)]


def test_lines_against_plain_splitting(spark):
    """Ends of all kinds, and a file of many lines, whose time must not grow with their square."""
    texts = ["", "\n", "\r\n", "\r", "a", "a\r", "a\n\n", "\r\r\nb", "é\r\n€😀\nz\r\n", "a\rb\n", "".join(f"ü line {k}{chr(13) if k % 3 else ''}\n" for k in range(20_000))]
    f = files(spark, [(str(k), t) for k, t in enumerate(texts)])
    got = {k: [] for k in range(len(texts))}
    for r in content.lines(f).orderBy("line_no").collect():
        got[int(r["path"])].append((r["line_no"], r["text"], r["start_byte"]))
    for k, t in enumerate(texts):
        want, at = [], 0
        for n, raw in enumerate(t.encode().split(b"\n")):
            ended = at + len(raw) < len(t.encode())
            if raw or ended:
                want.append((n + 1, (raw[:-1] if ended and raw.endswith(b"\r") else raw).decode(), at))
            at += len(raw) + 1
        assert got[k] == want
    found = content.matches(f, "line 1999[0-9]$").collect()
    assert sorted(r["line"] for r in found) == list(range(19991, 20001))


def test_languages_and_filters(spark):
    rows = [(".bashrc", "other"), ("a.tar.gz", "other"), ("x.", "other"), ("a.d/x", "other"), ("B.RS", "rust"), ("a.pyi", "python")]
    df = spark.createDataFrame(rows, "path string, want string").withColumn("got", language_of(F.col("path")))
    assert all(r["want"] == r["got"] for r in df.collect())
    f = files(spark, [("build/a.py", ""), ("Build/a.py", ""), ("a.MIN.JS", ""), (".x/a.py", ""), ("ok.py", "")])
    assert {r["path"] for r in filters.filter_ignored_dirs(f).collect()} == {"Build/a.py", "a.MIN.JS", ".x/a.py", "ok.py"}
    assert "a.MIN.JS" not in {r["path"] for r in filters.filter_ignored_extensions(f).collect()}
    assert ".x/a.py" not in {r["path"] for r in filters.filter_hidden(f).collect()}


def test_gitignore(spark):
    f = files(spark, [(".gitignore", "*.log\nout/\n/top.txt\n!keep.log\n"), ("sub/.gitignore", "!b.log\n"), ("a.log", ""), ("keep.log", ""), ("sub/b.log", ""), ("out/keep.log", ""), ("top.txt", ""), ("sub/top.txt", "")])
    left = {r["path"] for r in filters.filter_gitignore(f, filters.gitignore_rules(f)).collect()}
    assert left == {".gitignore", "sub/.gitignore", "keep.log", "sub/b.log", "sub/top.txt"}


def test_readable_and_scan(spark, tmp_path):
    for name, body in {"__init__.py": b"x", "__tests__/a.test.js": b"y", ".hidden/x.py": b"z", "bad.bin": b"\xff\xfe"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    got = {r["path"]: r["readable"] for r in scan_files(spark, str(tmp_path), "p").collect()}
    assert got == {"__init__.py": True, "__tests__/a.test.js": True, ".hidden/x.py": True, "bad.bin": False}


def test_peek_grep_chunks(spark):
    f = files(spark, [("a.py", "one\ntwo\nthree\n"), ("b.py", "")])
    rows = {r["path"]: r for r in content.peek(f, 1, 99).collect()}
    assert rows["a.py"]["content"] == "     2 │ two\n     3 │ three" and rows["a.py"]["end_line"] == 3
    assert content.peek(f, 5, 2).where("path = 'a.py'").first()["content"] == ""
    g = content.grep(f, "t", context_lines=1).collect()
    assert [(r["line"], r["context_before"], r["context_after"]) for r in g] == [(2, ["one"], ["three"]), (3, ["two"], [])]
    with pytest.raises(ValueError):
        content.grep(f, "(")
    with pytest.raises(ValueError):
        content.chunk_indices(f, 10, 10)
    for n in (0, 10, 11, 25):
        c = content.chunk_indices(files(spark, [("x", "a" * n)]), 10, 3).orderBy("index").collect()
        assert (c[-1]["end"] == n and all(b["start"] == a["end"] - 3 for a, b in zip(c, c[1:], strict=False))) if n else not c
    t = content.chunk_text(files(spark, [("x", "aé漢😀" * 7)]), 9, 0).orderBy("index").collect()
    assert "".join(r["text"] for r in t) == "aé漢😀" * 7


def test_code_scope(spark):
    f = files(spark, [("a.py", "# foo\r\nx = 1\r\nfoo()\r\ny = 'foo'\r\n"), ("a.md", "# foo\n")])
    got = {(r["path"], r["line"]) for r in content.grep(f, "foo", scope="code").collect()}
    assert got == {("a.py", 3), ("a.md", 1)}


def names(body, language):
    return [(s["name"], s["kind"], s["start_line"], s["end_line"], s["parent"]) for s in code_facts(body, language)["symbols"]]


def test_lexer_symbols():
    assert names("class A:\n    def f(self):\n        def g(): pass\n        return 1\n\ndef h(x):\n    return x\n", "python") == [("A", "class", 1, 4, None), ("f", "method", 2, 4, "A"), ("g", "function", 3, 3, "A"), ("h", "function", 6, 7, None)]
    rust = "struct S { a: i32 }\nimpl S {\n    pub fn new() -> S { S { a: 1 } }\n}\nenum E { A }\ntrait T {}\nmod m {}\nconst N: i32 = 1;\nfn main<'a>() { let c = '{'; }\n"
    assert [(n, k, p) for n, k, _, _, p in names(rust, "rust")] == [("S", "struct", None), ("new", "method", "S"), ("E", "enum", None), ("T", "trait", None), ("m", "module", None), ("N", "constant", None), ("main", "function", None)]
    assert [(n, k) for n, k, *_ in names("type S struct {\n}\nfunc (s S) M() {}\nfunc F(x int) {\n}\nconst C = 1\n", "go")] == [("S", "struct"), ("M", "method"), ("F", "function"), ("C", "constant")]
    assert [(n, k) for n, k, *_ in names("export class A {\n  m(x) { return x }\n}\nconst f = (a) => a\ninterface I { }\ntype T = string\nenum E { A }\nfunction g() {}\n", "typescript")] == [("A", "class"), ("m", "method"), ("f", "constant"), ("I", "interface"), ("T", "type"), ("E", "enum"), ("g", "function")]
    assert [(n, k) for n, k, *_ in names("public class A {\n  public int f(int x) { return g(x); }\n}\ninterface I {}\nenum E { X }\n", "java")] == [("A", "class"), ("f", "method"), ("I", "interface"), ("E", "enum")]
    assert [(n, k) for n, k, *_ in names("object O {\n  def f(x: Int) = { x }\n}\ntrait T\nclass C(a: Int)\ntype X = Int\n", "scala")] == [("f", "function"), ("T", "trait"), ("C", "class"), ("X", "type")]


def test_lexer_spans_and_bytes():
    assert [("/* a /* b */ c */ x"[s:e]) for s, e in code_spans("/* a /* b */ c */ x", "rust")] == ["/* a /* b */ c */"]
    assert [r for r in code_spans('r#"a"b"# x', "rust")] == [(0, 8)]
    f = code_facts("s = 'é'\nfoo(s)\n", "python")
    assert [(c["callee"], c["line"], c["start_byte"]) for c in f["calls"]] == [("foo", 2, 9)]
    assert [v["name"] for v in code_facts("def f(a, *b, c=1):\n    d, e = a, 2\n    for i in b: pass\n", "python")["variables"]] == ["a", "b", "c", "d", "e", "i"]
    assert code_facts("x", "markdown")["spans"] is None


def called(body, language):
    return [c["callee"] for c in code_facts(body, language)["calls"]]


def bound(body, language):
    return [v["name"] for v in code_facts(body, language)["variables"]]


def test_lexer_calls_named_like_keywords():
    assert called("fn f() { Foo::new(); String::from(x); c.try_into(); d.match(1); if (a) {} vec![1]; Vec::<u8>::with(3) }", "rust") == ["new", "from", "try_into", "match", "vec", "with"]
    assert called("x = re.match(a)\ntype(x)\nm.new()\ns.switch(1)\nif (a): pass\n", "python") == ["match", "type", "new", "switch"]
    assert called("p.catch(e); Array.from(x); s?.match(y); new Foo(1); new a.B(2); if (x) {} [...new Set(y)]", "javascript") == ["catch", "from", "match"]
    java = "class A { public A(int x) { this(1); } A() { f(); } int m(int q) throws E { return new B(q); } } class Z { void x(){} void y(){} }"
    assert called(java, "java") == ["f", "B"] and [s["name"] for s in code_facts(java, "java")["symbols"]] == ["A", "m", "Z", "x", "y"]


def test_lexer_bindings():
    assert bound("def f(x):\n    g(k=2)\n    (a, b) = 1, 2\n    [c, d] = x\n    e = h = 3\n    foo(\n        z=1,\n    )\n    i, *j = x\n    q: int = 4\n    w['a'] = 1\n    if (n := 10) == 3: pass\n", "python") == list("xabcdehijqn")
    assert bound("function f({b, c}, [d, e], g = 1) { const x = 1, y = 2; let z, w; for (const q of r) {} }", "javascript") == list("bcdegxyzwq")
    assert bound("class A { void f(int p) { int x = 1, y = 2; for (String s : t) {} } }", "java") == list("pxys")
    assert bound("fn f(p: i32) { let Point { x, y } = p; if let Some(z) = q {} let (a, mut b) = r; for k in l {} }", "rust") == list("pxyzabk")


def test_lexer_groups_and_nesting():
    go = "const (\n\tD = 1\n\tE, F = 2, 3\n)\nvar (\n\tG int\n\tH = map[string]int{\n\t\t\"a\": 1,\n\t}\n)\ntype (\n\tS struct {\n\t\tx int\n\t}\n\tI interface{ M() }\n\tT = int\n)\nconst K, L = 1, 2\nfunc main() {}\n"
    assert [(n, k) for n, k, *_ in names(go, "go")] == [(x, "constant") for x in "DEFGH"] + [("S", "struct"), ("I", "interface"), ("T", "type"), ("K", "constant"), ("L", "constant"), ("main", "function")]
    assert [(n, p) for n, _, _, _, p in names("class W { m() {} n(x) { return 1 } }", "javascript")] == [("W", None), ("m", "W"), ("n", "W")]
    assert [(n, k, p) for n, k, _, _, p in names("impl S { fn a() { fn b() {} } } #[test] fn t() {}", "rust")] == [("a", "method", "S"), ("b", "function", "S"), ("t", "function", None)]
    many = "".join(f"class C{k}:\n    def f{k}(self):\n        return g(k=1)\n" for k in range(3000))
    assert len(names(many, "python")) == 6000


def test_lexer_runs_once(spark, tmp_path):
    files(spark, [("a.py", "def f(x):\n    g(x)\n")]).write.parquet(str(tmp_path / "f"))
    own = spark.read.parquet(str(tmp_path / "f"))
    for out in (symbols.extract_symbols(own), symbols.extract_calls(own), symbols.code_spans(own)):
        assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_index_keeps_what_a_lost_batch_left(spark, tmp_path):
    """Batches touch their own projects only; a commit that was cut off does not count, and its batch is applied again."""
    at = datetime(2024, 1, 1)
    row = lambda p, path, s, body: (p, path, at.replace(second=s), "change", 9, at.replace(second=s), body)
    index = ch.Index(spark, str(tmp_path / "index"))
    index.apply(spark.createDataFrame([row("p", "a.py", 1, "def f(): pass"), row("q", "b.py", 1, "def g(): pass")], ch.SCHEMA), 0)
    before = index.current()
    (tmp_path / "index" / "commits" / "1").mkdir()
    assert index.current() == before and {r["path"] for r in index.files().collect()} == {"a.py", "b.py"}
    index.apply(spark.createDataFrame([row("q", "b.py", 2, "def h(): pass")], ch.SCHEMA), 1)
    last, versions = index.current()
    assert last == 1 and versions["p"] == before[1]["p"] and versions["q"] != before[1]["q"]
    assert {r["name"] for r in index.symbols().collect()} == {"f", "h"}


def test_rules(spark):
    rows = [("python", "x", "latest_x.py", True), ("rust", "x", "tests/a.rs", False), ("rust", "x", "x/tests/a.rs", True), ("typescript", "x", "a.spec.ts", True), ("java", "x", "FooTest.java", True), ("go", "x", "b_test.go", True)]
    df = spark.createDataFrame(rows, "l string, n string, p string, want boolean").withColumn("got", is_test_symbol(F.col("l"), F.col("n"), F.col("p")))
    assert all(r["want"] == r["got"] for r in df.collect())
    assert spark.range(1).select(is_definition_line(F.lit("public int a = foo();"), F.lit("foo"), F.lit("java"))).first()[0]
    with pytest.raises(ValueError):
        kind_named("nope")


def test_coverage_equals_naive(spark):
    f = files(spark, [("test_a.py", "def test_a():\n    target()\n    get_it(1)\n"), ("lib.py", "def get():\n    pass\n\ndef it():\n    pass\n\ndef lost():\n    pass\n")])
    s = symbols.extract_symbols(f)
    got = {(r["test"], r["name"]) for r in graph.test_coverage(s, f).collect()}
    naive = {(t["name"], n["name"]) for t in graph.tests_of(s, f).collect() for n in s.collect() if n["name"] in t["body"]}
    assert got == naive and ("test_a", "get") in got
    assert {r["name"] for r in graph.untested_symbols(s, f).collect()} == {"lost"}


def test_coverage_of_names_in_other_scripts(spark):
    f = files(spark, [("test_a.py", "def test_a():\n    naïve_größe(1)\n"), ("lib.py", "def naïve_größe(x):\n    pass\n\ndef größe(x):\n    pass\n\ndef größer(x):\n    pass\n")])
    s = symbols.extract_symbols(f)
    assert ("test_a", "naïve_größe") in {(r["test"], r["name"]) for r in graph.test_coverage(s, f).collect()}
    assert {r["name"] for r in graph.untested_symbols(s, f).collect()} <= {"größe", "größer"}


def test_trace_ends_cycles(spark):
    pairs = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c")], "caller string, callee string")
    assert {(r["symbol"], r["depth"]) for r in graph.trace_callers(pairs, "a").collect()} == {("b", 1), ("c", 2)}


def test_tree(spark):
    f = spark.createDataFrame([("p", x, 1) for x in ("src/main.rs", "src/lib.rs", "Cargo.toml", "src-x/a")], "project string, path string, size long")
    lines = [r["line"] for r in structure.tree_lines(f).orderBy("parts").collect()]
    assert lines == ["├── Cargo.toml", "├── src/", "│   ├── lib.rs", "│   └── main.rs", "└── src-x/", "    └── a"]
    assert [r["line"] for r in structure.tree_lines(f, 1).orderBy("parts").collect()] == ["├── Cargo.toml", "├── src/", "└── src-x/"]


def test_annotations_round_trip(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"project": "p", "file_definitions": {"a.py": "one"}, "symbol_definitions": {"x::y.rs::f": "two"}}')
    a = A.read_annotations(spark, str(tmp_path / "a.json"))
    assert {(r["target"], r["path"], r["name"], r["value"]) for r in a.collect()} == {("file_definition", "a.py", None, "one"), ("symbol_definition", "x::y.rs", "f", "two")}
    A.write_annotations(a, str(tmp_path / "out"))
    assert sorted(map(str, A.read_annotations(spark, str(tmp_path / "out")).collect())) == sorted(map(str, a.collect()))


def test_folding(spark):
    log = spark.createDataFrame([("p", "a", None, 1, 1, "define", "x"), ("p", "a", None, 2, 2, "define", "y"), ("p", "b", None, 1, 1, "redefine", "u"), ("p", "b", None, 2, 2, "redefine", "z")], "project string, path string, name string, ts int, seq int, op string, value string")
    assert {(r["path"], r["value"]) for r in notes.fold_definitions(log).collect()} == {("a", "x"), ("b", "z")}
    marks = spark.createDataFrame([("p", "a", 2, 1, "doc"), ("p", "a", 1, 2, "tests"), ("p", "a", 3, 3, "docs"), ("p", "a", 4, 4, "nope")], "project string, path string, ts int, seq int, mark string")
    assert notes.fold_marks(marks).first()["marks"] == ["test", "documentation"]
    assert notes.rejected_marks(marks).count() == 1


def test_preview(spark):
    row = spark.createDataFrame([("é" * 101,), ("a" * 200,), ("a" + "é" * 120,)], "t string").select(T.preview(F.col("t")).alias("p")).collect()
    assert [r["p"] for r in row] == ["é" * 100 + "...", "a" * 200, "a" + "é" * 99 + "..."]


def test_index_tables(spark, tmp_path):
    f = files(spark, [("a.py", "def f():\n    pass\n")])
    write_index({"symbols": symbols.extract_symbols(f)}, str(tmp_path / "index"))
    assert [r["name"] for r in read_index(spark, str(tmp_path / "index"), "symbols").collect()] == ["f"]


def test_streams(spark, tmp_path):
    at = lambda s: datetime(2024, 1, 1, 0, 0, s)
    rows = [("p", "a.py", at(1), "change", 9, at(1), "def f(): pass"), ("p", "b.py", at(2), "change", 9, at(2), "def g(): pass"), ("p", "b.py", at(3), "delete", 0, at(3), None), ("p", "node_modules/x.js", at(3), "change", 1, at(3), "x"), ("p", "a.py", at(0), "change", 9, at(0), "def old(): pass")]
    spark.createDataFrame(rows, ch.SCHEMA).write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        ch.maintain_index(ch.read_changes(spark, str(tmp_path / "in")), str(tmp_path / "index"), str(tmp_path / "chk")).awaitTermination()
    index = ch.Index(spark, str(tmp_path / "index"))
    assert [r["path"] for r in index.files().collect()] == ["a.py"] and [r["name"] for r in index.symbols().collect()] == ["f"]
    index.apply(spark.createDataFrame(rows[1:2], ch.SCHEMA), 0)  # an applied batch is skipped
    assert index.files().count() == 1
    flush = [("p", "zz", datetime(2030, 1, 1), "change", 1, datetime(2030, 1, 1), "")]
    spark.createDataFrame(rows + flush, ch.SCHEMA).write.parquet(str(tmp_path / "in2"))
    q = ch.debounce(ch.read_changes(spark, str(tmp_path / "in2")), "5 seconds").writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "chk2")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["path"], r["op"], r["n_events"]) for r in spark.table("bursts").collect()}
    want = {(r["path"], r["op"], r["n_events"]) for r in ch.debounce(spark.createDataFrame(rows, ch.SCHEMA), "5 seconds", None).collect()}
    assert got == want
