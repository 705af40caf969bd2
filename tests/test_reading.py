"""Each file is read once, whatever is asked of it, and what one reading gives is what the relations give."""

import random

import pytest
from pyspark.sql import functions as F

from quarrylens.functions import fold
from quarrylens.languages import PROFILES, compiled, needs
from quarrylens.operators import accuracy, graph, symbols
from quarrylens.operators.parse import parse, relation
from quarrylens.plans import corpus
from quarrylens.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
ONCE = [f"symbols_{k}" for k in corpus.FORMS] + "types_by_language top_calls call_freq_dir call_edges call_edges_dir call_edges_aliased callers_of graph_totals accuracy_counts complexity_filter complexity_levels".split()


@pytest.mark.parametrize("name", ONCE)
def test_one_reading(spark, name):
    assert QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_whole_file_is_blanked_like_its_lines():
    rng = random.Random(3)
    parts = ['"', "'", "`", "//", "/*", "*/", "\\", '"""', 'r#"', '@"', "{", "}", "x(", "\n", "\n", '"a\\"b"', "/* c\nd */", "`r\ns`", "é"]
    for lang, p in PROFILES.items():
        for _ in range(200):
            raw = fold.split_lines("".join(rng.choice(parts) for _ in range(12)))
            s = fold.Sanitizer(p)
            want = list(s.lines(raw))
            clean, states = s.whole(raw)
            assert clean == [c for c, _ in want] == s.whole(raw, False)[0], (lang, raw)
            assert (states or [fold.NORMAL] * len(raw)) == [x for _, x in want], (lang, raw)


def test_whole_file_takes_one_substitution():
    s = fold.Sanitizer(PROFILES["go"])
    s.lines = None  # not asked line by line
    assert s.whole(['a := "(" // b(', "/* c(", "d */ e(`f(", "`)"], False)[0] == ["a :=" + 10 * " ", "     ", "     e(   ", " )"]


def test_literals_that_a_match_needs():
    for p in PROFILES.values():
        assert needs(p.func), p.lang
    assert needs(PROFILES["kotlin"].func) == ("fun",) and needs(PROFILES["c"].func) == ("(",) or needs(PROFILES["c"].func) == (")",)
    assert needs("^a?b*") == () and needs("(?i)func") == () and set(needs("(?:class|enum)x?")) == {"class", "enum"}
    assert compiled(PROFILES["go"].func).search("func f(")


TEXTS = {
    "a.go": "func A() {\n\tB()\n\tx.B()\n\tx.B()\n\tgone()\n\tA()\n\ty.A()\n}\nfunc B() {\n\tfunc C() {\n\t\tA()\n\t}\n}\nA()\n",
    "b.go": "func D() {\n\tA()\n\tlong(1)\n}\n",
    "c.go": "A()\n",
    "d.go": "",
}


@pytest.mark.parametrize("scope", ["file", "dir"])
@pytest.mark.parametrize("aliased", [False, True])
def test_edges_of_files(spark, scope, aliased):
    files = spark.createDataFrame([(p, "go", t) for p, t in TEXTS.items()], "path string, lang string, content string")
    aliases = spark.createDataFrame([("a.go", "x", "pkg/y"), ("a.go", "y", "pkg/y"), ("b.go", "x", "no")], "path string, alias string, target string") if aliased else None
    parsed = parse(files, ("functions", "calls"))
    want = graph.call_edges(relation(parsed, "calls"), relation(parsed, "functions"), aliases, scope)
    got = graph.file_edges(files, aliases, scope)
    rows = lambda d: sorted((r.path, r.caller, r.callee, r.line) for r in d.collect())
    assert rows(got) == rows(want) and len(rows(got)) > 3
    own = graph.file_edges(files, aliases, scope, keep=lambda c: c == "A")
    assert rows(own) == rows(want.where("callee = 'A'"))
    t = graph.totals(graph.file_marks(files, aliases, scope)).first()
    assert (t.functions, t.calls, t.files) == (4, want.count(), want.select("path").distinct().count())


def test_many_ways_are_walked_once(spark):
    """Two functions in each of thirty layers call both of the next: 2^30 ways."""
    e = spark.createDataFrame([(f"{a}{i}", f"{b}{i + 1}") for i in range(30) for a in "xy" for b in "xy"], "caller string, callee string")
    got = {r.node: r.hops for r in graph.reachable_within(e, "x0", 25).collect()}
    assert got == {"x0": 0} | {f"{a}{i}": i for i in range(1, 26) for a in "xy"}


@pytest.mark.parametrize(("few", "many"), [(0, 0), (100_000, 0), (100_000, 2_000_000)])
def test_walk_by_exchange_and_by_broadcast(spark, monkeypatch, few, many):
    monkeypatch.setattr(graph, "FEW", few)
    monkeypatch.setattr(graph, "MANY", many)
    rng = random.Random(1)
    pairs = {(rng.randrange(60), rng.randrange(60)) for _ in range(90)}
    want, now, hop = {0: 0, 7: 0}, {0, 7}, 0
    while now:
        hop += 1
        now = {b for a, b in pairs if a in now} - want.keys()
        want |= dict.fromkeys(now, hop)
    e = graph.steps(spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "caller string, callee string"))
    start = spark.createDataFrame([("0",), ("7",)], "node string")
    assert {r.node: r.hops for r in graph.walk(e, start).collect()} == {str(k): v for k, v in want.items()}
    assert {r.node: r.hops for r in graph.walk(e, start, 2).collect()} == {str(k): v for k, v in want.items() if v <= 2}


def test_pairing_is_the_greedy_rule(spark):
    rng = random.Random(5)
    sides = {n: ([rng.randrange(12) for _ in range(rng.randrange(5))], [rng.randrange(12) for _ in range(rng.randrange(5))]) for n in range(300)}
    rows = [("p", "function", str(n), i == 0, x) for n, both in sides.items() for i, side in enumerate(both) for x in side]
    got = accuracy.match_sides(spark.createDataFrame(rows, "path string, kind string, name string, is_truth boolean, line bigint"))
    want = {(str(n), len(t), len(f), accuracy.paired(sorted(t), sorted(f), 2)) for n, (t, f) in sides.items() if t or f}
    assert {(r.name, r.truth, r.found, r.matched) for r in got.collect()} == want


def test_symbols_of_files(spark):
    files = corpus.all_language_files(spark, SF).limit(300).cache()
    parsed = parse(files, ("functions", "classes", "types"))
    want = symbols.symbols(*[relation(parsed, w) for w in ("functions", "classes", "types")])
    assert sorted(symbols.file_symbols(files).collect()) == sorted(want.collect())
    assert {r.lang for r in files.select(F.col("lang")).distinct().collect()} <= set(corpus.FORMS)
