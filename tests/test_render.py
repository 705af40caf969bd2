"""Text forms."""

from quarrylens.functions import render
from quarrylens.operators.parse import parse, relation
from quarrylens.operators.lines import lines
from quarrylens.operators.symbols import bodies, file_maps


def test_maps(spark):
    files = spark.createDataFrame([("a.go", "func A() {\n}\n\nfunc B() {\n}\nfunc A() {\n}\ntype T struct {\n\tX int\n\tY int\n}\n", "go")], "path string, content string, lang string")
    p = parse(files, ("functions", "types", "fields", "classes"))
    f, t, d, c = (relation(p, r) for r in ("functions", "types", "fields", "classes"))
    text = lambda df: df.first().text
    assert text(render.grep_map(f)) == "A: 1-2; B: 4-5; A: 6-7;"
    assert text(render.json_map(f)) == '{"A":{"start":6,"end":7},"B":{"start":4,"end":5}}'
    assert text(render.extract(bodies(f, lines(files)))).startswith("// A: 1-2\nfunc A() {\n}\n\n// B: 4-5\n")
    assert text(render.struct_map(t, d)) == "T: 8-11; fields: X, Y"
    assert [r.text for r in render.dir_grep(f).orderBy("start").collect()][0] == "a.go:1: A"
    assert [r.text for r in render.plain_lines(lines(files)).orderBy("line_no").limit(1).collect()] == ["1: func A() {"]
    whole = '{"name":"T","kind":"struct","start":8,"end":11,"fields":[{"name":"X","type":"int","line":9},{"name":"Y","type":"int","line":10}]}'
    assert text(render.struct_json(t, d)) == '{"filename":"a.go","types":[' + whole + "]}"
    assert text(render.combined_json(f, t, d)).endswith('{"name":"A","start":6,"end":7}],"types":[' + whole + "]}")
    assert text(render.combined_json(f, t.limit(0), d)).endswith('"types":[]}')
    assert '"classes":[{"name":"T"' in file_maps(f, c).toJSON().first()
    assert render.type_tree(t.collect(), d.collect()) == "T [struct] (8-11)\n├── X int\n└── Y int"


def test_trees():
    row = lambda n, a, b, c="": {"name": n, "start": a, "end": b, "class_name": c, "signature": ""}
    assert render.tree([row("a", 1, 9), row("b", 2, 4, "K"), row("c", 5, 8), row("d", 10, 11)]) == "├── a (1-9)\n│   ├── method b (2-4)\n│   └── c (5-8)\n└── d (10-11)"
    members = [row("m", 2, 4, "K"), row("n", 5, 7, "K"), row("i", 6, 6, "K"), row("z", 9, 9)]
    assert render.tree(members, classes=[{"name": "K", "start": 1, "end": 8}]) == "├── class K (1-8)\n│   ├── method m (2-4)\n│   └── method n (5-7)\n│       └── method i (6-6)\n└── z (9-9)"
    edges = [{"caller": "a", "callee": "b"}, {"caller": "b", "callee": "a"}, {"caller": "a", "callee": "c"}]
    assert render.call_tree(edges, "a") == "a\n  b\n    a (↑ recursive)\n  c"
    assert render.dir_tree(["x/a", "x/b", "y"]) == "├── x\n│   ├── a\n│   └── b\n└── y"
    assert render.level_bars({"SIMPLE": 3, "HIGH": 1}).split("\n")[0].count("█") == 15
    assert "50.0%" in render.stat_text({"total_lines": 4, "code_lines": 2, "comment_lines": 1, "blank_lines": 1})
    assert render.adjustment_report("p", (1, 2), {"reason": "", "start": 1, "end": 2}) == ""
    assert "used:  3-9" in render.adjustment_report("p", (1, 2), {"reason": "next scope", "start": 3, "end": 9})
