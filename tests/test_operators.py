"""Operators on small inputs."""

import pytest
from pyspark.sql import functions as F

from quarrylens.operators import accuracy, graph, imports, lines, scopes, snapshot
from quarrylens.operators.symbols import CodeMap
from quarrylens.sources import scan as S


@pytest.mark.parametrize(("spec", "want"), [("42", (42, 42)), ("10:20", (10, 20)), (":50", (1, 50)), ("100:", (100, None))])
def test_ranges(spec, want):
    assert lines.parse_range(spec) == want


@pytest.mark.parametrize("spec", ["", ":", "0", "5:2", "a", "0:3", "-1"])
def test_bad_ranges(spec):
    with pytest.raises(ValueError):
        lines.parse_range(spec)


def ignored(spark, rules, paths, **how):
    d = spark.createDataFrame([(p, d) for p, d in paths], "path string, d boolean")
    return [r.x for r in d.select(S.is_ignored(F.col("path"), S.ignore_patterns(rules, **how), F.col("d")).alias("x")).collect()]


def test_ignore_rules(spark):
    rules = "# note\n*.log\nbuild/\nvendor\n"
    paths = [("a.log", False), ("x/a.log", False), ("build/x.go", False), ("build", True), ("build", False), ("vendor/a.go", False), ("main.go", False)]
    assert ignored(spark, rules, paths) == [True, True, True, True, False, True, False]
    assert ignored(spark, "!keep.log\n*.log", [("keep.log", False)]) == [True]
    assert ignored(spark, "*.log\n!keep.log", [("keep.log", False), ("a.log", False)], strict=True) == [False, True]


def test_scan(spark, tmp_path):
    for name, text in {"a.go": "func A() {\n}\n", "sub/b.py": "def b():\n    pass\n", ".hid/c.go": "", "sub/d.txt": "x", "n.log": "", ".gitignore": "n.log\n"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    rows = {r.path: r.lang for r in S.scan(spark, str(tmp_path)).collect()}
    assert rows == {"a.go": "go", "sub/b.py": "py"}
    assert [r.path for r in S.scan(spark, str(tmp_path), recursive=False).collect()] == ["a.go"]
    m = CodeMap.scan(spark, str(tmp_path), "functions")
    assert sorted((r.path, r.name) for r in m.functions.collect()) == [("a.go", "A"), ("sub/b.py", "b")]
    with pytest.raises(ValueError):
        CodeMap.scan(spark, str(tmp_path), "nothing")


def test_scan_of_odd_trees(spark, tmp_path):
    files = {"pkg/__init__.py": b"def a():\n    pass\n", "latin.go": b"// caf\xe9\nfunc B() {\n}\n", ".git/objects/x.go": b"func G() {\n}\n", "build/out.go": b"func O() {\n}\n", "bin.dat": b"\x00\xff", ".gitignore": b"build/\n"}
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    rows = {r.path: (r.content, r.error) for r in S.scan(spark, str(tmp_path)).collect()}
    assert set(rows) == {"pkg/__init__.py", "latin.go"}
    assert rows["latin.go"][0].startswith("// caf\ufffd") and "UTF-8" in rows["latin.go"][1] and rows["pkg/__init__.py"][1] is None
    assert [p for p, _ in S.list_files(str(tmp_path), rules=S.ignore_patterns("build/"))] == [".gitignore", "bin.dat", "latin.go", "pkg/__init__.py"]
    assert {r.path for r in S.scan(spark, str(tmp_path), known_only=False).collect()} >= {"bin.dat", "latin.go"}
    assert {r.path for r in S.scan(spark, str(tmp_path), lang="py", use_ignore=False).collect()} == {"pkg/__init__.py"}
    (tmp_path / "none").mkdir()
    assert S.scan(spark, str(tmp_path / "none")).count() == 0


def test_parse_of_lines_profiles_and_errors(spark):
    from quarrylens.languages import PROFILES
    from quarrylens.operators.parse import errors, parse, relation

    text = "func A() {\n\tx()\n}\nfunc B() {\n\ty()\n}\n"
    files = spark.createDataFrame([("a.go", "go", text), ("b.go", "go", f"{text}// {'x' * 70_000}\n"), ("c.zz", "zz", text)], "path string, lang string, content string")
    part = relation(parse(files.where("path = 'a.go'"), lines=(4, -1)), "functions")
    assert [(r.name, r.start, r.end) for r in part.collect()] == [("B", 4, 6)]
    assert relation(parse(files.where("path = 'a.go'"), lines=(2, 3)), "functions").count() == 0
    parsed = parse(files, profiles={"zz": PROFILES["go"]._replace(lang="zz") if hasattr(PROFILES["go"], "_replace") else PROFILES["go"]})
    assert {(r.path, r.name) for r in relation(parsed, "functions").collect()} == {("a.go", "A"), ("a.go", "B"), ("c.zz", "A"), ("c.zz", "B")}
    assert [(r.path, r.error) for r in errors(parsed).collect()] == [("b.go", "line 7 is too long")]
    assert relation(parse(files, strict=True), "functions").where("path = 'b.go'").count() == 2


def test_manifest_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 2, 0, "x"), ("b", 2, 0, 1, "y")], "shard string, files bigint, total_functions bigint, total_classes bigint, checksum string")
    S.write_manifest(rows, str(tmp_path / "m"), "/r")
    assert [(r.shard, r.files, r.checksum) for r in S.read_manifest(spark, str(tmp_path / "m")).orderBy("shard").collect()] == [("a", 1, "x"), ("b", 2, "y")]
    with pytest.raises(Exception, match="(?i)path"):
        S.read_manifest(spark, str(tmp_path / "none")).collect()


def test_ts_aliases():
    assert S.parse_ts_paths('{"compilerOptions": {"paths": {"@app/*": ["./src/app/*", "x"], "lib": ["lib"]}}}') == {"@app/": "src/app/", "lib/": "lib/"}


def test_tsconfig_above(spark, tmp_path):
    (tmp_path / "a/b/c").mkdir(parents=True)
    (tmp_path / "a/tsconfig.json").write_text("{}")
    assert S.tsconfig_above(spark, str(tmp_path / "a/b/c")) == str(tmp_path / "a")
    assert S.tsconfig_above(spark, str(tmp_path / "a")) is None


def test_edges(spark):
    f = spark.createDataFrame([("p", "A", 1, 9), ("p", "in", 3, 5), ("p", "B", 11, 12)], "path string, name string, start bigint, end bigint")
    c = spark.createDataFrame([("p", 4, "", "B"), ("p", 6, "obj", "M"), ("p", 7, "", "A"), ("p", 8, "", "none"), ("p", 10, "", "B"), ("p", 11, "foo", "H")], "path string, line bigint, receiver string, name string")
    names = spark.createDataFrame([("p", "foo", "pkg/foo")], "path string, alias string, target string")
    got = {(r.caller, r.callee, r.line) for r in graph.call_edges(c, f, names).collect()}
    assert got == {("A", "B", 4), ("A", "obj.M", 6), ("B", "pkg/foo.H", 11)}


def test_reachable_with_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")], "caller string, callee string")
    roots = spark.createDataFrame([("a",)], "node string")
    assert {(r.node, r.hops) for r in graph.reachable(e, roots).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    assert {r.node for r in graph.reachable(e, roots, 1).collect()} == {"a", "b"}


def test_partial(spark):
    f = spark.createDataFrame([("p", n, a, b) for n, a, b in (("s", 1, 5), ("e", 8, 20), ("in", 6, 7))], "path string, name string, start bigint, end bigint")
    t = spark.createDataFrame([("p", 30)], "path string, total_lines bigint")
    assert {(r.name, r.cut) for r in lines.partial_functions(f, "3:10", t).collect()} == {("s", "start"), ("e", "end")}
    assert {(r.name, r.cut) for r in lines.partial_functions(f, "9:12", t).collect()} == {("e", "spans")}
    assert lines.partial_functions(f, "21:", t).count() == 0


def test_snap(spark):
    s = spark.createDataFrame([("p", "A", "class", 1, 10), ("p", "f", "function", 2, 5), ("p", "g", "function", 6, 10), ("p", "h", "function", 20, 25)], "path string, name string, kind string, start bigint, end bigint")
    at = lambda a, b: tuple(scopes.snap_ranges(s, a, b).first())[1:]
    assert at(15, 16) == (20, 25, "next scope")
    assert at(3, 4) == (2, 5, "whole function")
    assert at(2, 9) == (2, 5, "clipped")
    assert at(1, 7) == (1, 10, "class end")
    assert at(30, 31) == (30, 31, "")


def test_resolve(spark):
    files = spark.createDataFrame([("src/a.ts",), ("src/lib/b.ts",), ("pkg/sub/x.go",), ("pkg/y.go",)], "path string")
    imps = lambda rows: spark.createDataFrame(rows, "path string, value string")
    got = imports.resolve(imps([("src/a.ts", "@/lib/b"), ("src/a.ts", "./lib/b"), ("src/a.ts", "react")]), files, "", {"@/": "src/"})
    assert {(r.value, r.target) for r in got.collect()} == {("@/lib/b", "src/lib"), ("./lib/b", "src/lib")}
    both = imports.resolve(imps([("m/main.go", "mod/pkg"), ("m/main.go", "mod/pkg/sub")]), files, "mod")
    assert {(r.value, r.target) for r in both.collect()} == {("mod/pkg", "pkg"), ("mod/pkg/sub", "pkg/sub")}
    lost = imports.resolution(imports.resolve(imps([("src/a.ts", f"@/none{i}") for i in range(4)]), files, "", {"@/": "wrong/"})).first()
    assert tuple(lost) == (4, 0, True)
    few = imports.resolution(imports.resolve(imps([("src/a.ts", f"@/none{i}") for i in range(2)]), files, "", {"@/": "wrong/"})).first()
    assert tuple(few) == (2, 0, False)


def test_incremental(spark):
    a = spark.createDataFrame([("d/a.go", "x"), ("d/b.go", "y"), ("e/c.go", "z")], "path string, content string")
    old = snapshot.shard_checksums(a)
    assert snapshot.incremental(a, old).count() == 0
    b = a.withColumn("content", F.when(F.col("path") == "e/c.go", "new").otherwise(F.col("content")))
    assert [r.path for r in snapshot.incremental(b, old).collect()] == ["e/c.go"]
    assert {tuple(r) for r in snapshot.changed_shards(old, snapshot.shard_checksums(b)).collect()} == {("e", "changed")}
    merged = snapshot.merge_manifest(old, snapshot.shard_checksums(b).where("shard = 'e'"), spark.createDataFrame([("e",)], "shard string"))
    assert [r.shard for r in merged.collect()] == ["e"]


def test_greedy_pairs(spark):
    assert accuracy.paired([1, 2], [2, 3], 2) == 2 and accuracy.paired([1, 1], [1], 2) == 1 and accuracy.paired([5], [9], 2) == 0
    t = spark.createDataFrame([("p", "f", "x", 1), ("p", "f", "x", 10), ("p", "f", "y", 5)], "path string, kind string, name string, line bigint")
    f = spark.createDataFrame([("p", "f", "x", 2), ("p", "f", "x", 11), ("p", "f", "z", 5)], "path string, kind string, name string, line bigint")
    s = accuracy.score(accuracy.match_counts(t, f)).first()
    assert (s.truth, s.found, s.matched) == (3, 3, 2)


def test_percentiles(spark):
    v = spark.createDataFrame([(float(i % 97),) for i in range(1000)], "value double")
    s = sorted(float(i % 97) for i in range(1000))
    assert tuple(accuracy.latency_percentiles(v).first()) == (1000, s[500], s[990], s[-1])
    assert accuracy.latency_percentiles(v.where("value < 0")).first().n == 0


def test_empty_inputs(spark):
    from quarrylens.operators.parse import parse, relation

    none = spark.createDataFrame([], "path string, content string, lang string")
    assert relation(parse(none, ("functions", "types")), "functions").count() == 0
    nulls = spark.createDataFrame([("a.go", None, "go"), ("b.go", "", "go"), ("c.zz", "x", None)], "path string, content string, lang string")
    assert parse(nulls, ("functions",)).count() == 2
    assert lines.lines(nulls).count() == 1


def test_stream(spark, tmp_path):
    from quarrylens.streaming import incremental as I

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    put = lambda rows: spark.createDataFrame(rows, "path string, content string").coalesce(1).write.mode("append").parquet(src)
    put([("a.go", "func A() {\n}\n"), ("b.go", "func B() {\n}\n")])
    I.keep_map(I.file_stream(spark, src), out, str(tmp_path / "ck")).awaitTermination()
    put([("a.go", "func C() {\n}\n")])
    I.keep_map(I.file_stream(spark, src), out, str(tmp_path / "ck")).awaitTermination()
    assert sorted(r.name for r in I.latest(spark, out).collect()) == ["B", "C"]
