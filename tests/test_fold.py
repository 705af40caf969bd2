"""The per-file fold: inputs of known outcome."""

import pytest

from quarrylens.functions import fold
from quarrylens.languages import PROFILES, by_extension, profile, supported
from quarrylens.operators.parse import parse_file


def spans(lang, text, **how):
    return [(f[0], f[1], f[2]) for f in parse_file(lang, text, ("functions",), **how)["functions"]]


def clean(lang, text, state=fold.NORMAL, **how):
    return fold.Sanitizer(PROFILES[lang], **how).line(text, state)


def test_two_functions():
    assert spans("go", "package p\n\nfunc A() {\n\tx()\n}\n\nfunc B() {\n}\n") == [("A", 3, 5), ("B", 7, 8)]


def test_closure_is_not_a_function():
    assert spans("go", "func A() {\n\tf := func() {\n\t}\n\tf()\n}\n") == [("A", 1, 5)]


def test_parameters_over_lines():
    assert spans("go", "func Long(\n\ta int,\n\tb int,\n) error {\n\treturn nil\n}\n") == [("Long", 1, 6)]


def test_one_line_function_between_others():
    assert spans("go", "func A() {\n}\nfunc B() { return }\nfunc C() {\n}\n") == [("A", 1, 2), ("B", 3, 3), ("C", 4, 5)]


def test_generics_and_methods():
    text = "func Map[T any](x []T) {\n}\nfunc (s *Set[T]) Add(x T) {\n}\n"
    assert [s[0] for s in spans("go", text)] == ["Map", "Add"]


def test_rust_where_clause():
    text = "use x;\n\n\n\nfn load<T>(\n  p: P) -> R\nwhere\n  T: D,\n{\n}\n"
    assert spans("rust", text) == [("load", 5, 10)]


def test_rust_one_line_body():
    assert spans("rust", "fn helper() -> i32 { 42 }\nfn main() {\n  helper();\n\n}\n") == [("helper", 1, 1), ("main", 2, 5)]


def test_c_body_on_the_brace_line():
    assert spans("c", "int helper(void)\n{ return 42; }\nint main(void)\n{\n  return 0;\n}\n") == [("helper", 1, 2), ("main", 3, 6)]


@pytest.mark.parametrize("lang", ["go", "cs", "java", "d", "kotlin"])
def test_brace_in_a_character(lang):
    assert fold.delta(clean(lang, "if c == '{' {")[0]) == 1


def test_python_ends_reach_over_blanks():
    text = "def a():\n    x = 1\n\ndef b():\n    y = 2\n    z = 3\n\ndef c():\n    if z:\n        y()\n    return 1\n\n"
    assert spans("py", text) == [("a", 1, 3), ("b", 4, 7), ("c", 8, 13)]


def test_python_decorators():
    text = "@one\n@two(1, 2)\ndef a():\n    pass\n"
    f = parse_file("py", text, ("functions",))["functions"][0]
    assert (f[1], f[4]) == (1, ["@one", "@two(1, 2)"])


def test_names_decide_what_opens():
    text = "fn a() {\n  fn_b();\n}\nfn b() {\n}\n"
    assert spans("rust", text, names=frozenset(["b"])) == [("b", 4, 5)]


def test_indent_levels():
    assert [fold.indent_level(x) for x in ("\tx", "\t  x", "    ", "x")] == [4, 6, 4, 0]


@pytest.mark.parametrize(
    ("lang", "text", "want", "state"),
    [
        ("go", 'x := "a{b" // {', "x :=             ", fold.NORMAL),
        ("go", "a /* b /* c */ d */ e", "a                   e", fold.NORMAL),
        ("go", "a /* open", "a        ", fold.BLOCK),
        ("go", "x := `raw {", "x :=       ", fold.RAW),
        ("py", 'x = """doc', "x =       ", fold.DOC),
        ("py", '"""one line"""', "              ", fold.NORMAL),
        ("js", "\"it's\" + x", "    s", fold.STRING),
        ("go", "", "", fold.NORMAL),
    ],
)
def test_sanitizer(lang, text, want, state):
    got = clean(lang, text)
    assert (got[0].rstrip(), got[1], len(got[0])) == (want.rstrip(), state, len(text))


def test_sanitizer_goes_on():
    assert clean("go", "still */ x", fold.BLOCK) == ("         x", fold.NORMAL)
    assert clean("go", "end` {", fold.RAW) == ("     {", fold.NORMAL)
    assert clean("py", 'end" x', fold.DOC) == ("      ", fold.NORMAL)


def test_sanitizer_strict():
    assert clean("js", "\"it's\" + x", strict=True) == ("       + x", fold.NORMAL)
    assert clean("go", 'x = "open', strict=True)[1] == fold.NORMAL
    assert clean("d", 'r"a" {', strict=True) == ("     {", fold.NORMAL)


def test_verbatim_marker():
    from dataclasses import replace

    p = replace(PROFILES["cs"], docs=('@"',))
    assert fold.Sanitizer(p).line('x = @"a ""q"" b"; y', fold.NORMAL) == ("x =             ; y", fold.NORMAL)


def test_columns_are_characters():
    got, _ = clean("go", 'имя := "строка" {')
    assert got == "имя :=          {"


def test_types_of_go():
    text = "package p\n\ntype A int\ntype B = string\ntype C func(x int) error\ntype D map[string]int\n\ntype E struct {\n\tX int\n}\n\ntype F []int\n"
    got = parse_file("go", text, ("types",))["types"]
    assert [(t[0], t[2], t[3]) for t in got] == [("A", 3, 3), ("B", 4, 4), ("C", 5, 5), ("D", 6, 6), ("E", 8, 10), ("F", 12, 12)]


def test_inline_struct_swallows_nothing():
    got = parse_file("go", "type A struct{}\n\ntype B interface{}\ntype C struct {\n\tX int\n}\n", ("types",))["types"]
    assert [(t[0], t[2], t[3]) for t in got] == [("A", 1, 1), ("B", 3, 3), ("C", 4, 6)]


def test_fields():
    text = "type User struct {\n\tID int\n\tName string\n\tBase\n\t// none\n\tTags []string\n\tAge int\n\tRun() error\n}\n"
    got = {f[1] for f in parse_file("go", text, ("fields",))["fields"]}
    assert {"ID", "Name", "Age"} <= got and "Run" not in got and "Base" not in got


def test_typescript():
    text = "export class A {\n  x() {\n    if (a) {\n    }\n  }\n}\ninterface B {\n}\ntype C = string\nenum D {\n}\n"
    assert [(t[0], t[1], t[2], t[3]) for t in parse_file("ts", text, ("types",))["types"]] == [("A", "class", 1, 6), ("B", "interface", 7, 8), ("C", "type_alias", 9, 9), ("D", "enum", 10, 11)]
    assert parse_file("ts", "interface B {\n  name: string\n}\n", ("fields",))["fields"] == []


def test_ruby_types_end_at_end():
    assert parse_file("ruby", "class A\n  def x\n  end\nend\nmodule B\nend\n", ("types",))["types"] == [("A", "class", 1, 4), ("B", "module", 5, 6)]


def test_specific_kinds_first():
    got = parse_file("kotlin", "data class A(val x: Int) {\n}\nsealed class B {\n}\n", ("types",))["types"]
    assert [t[1] for t in got] == ["data_class", "sealed_class"]


def test_calls():
    assert fold.call_sites(["a.b.c(x) foo (y) 12("]) == [(1, "b", "c"), (1, "", "foo")]
    assert fold.call_sites(["имя.вызов()"]) == [(1, "имя", "вызов")]


def test_scopes():
    text = ["class A(Base):", "    def f(self):", "        pass", "    @deco", "    def g(self):", "        pass", "x = 1"]
    got = fold.python_scopes(text)
    assert [(s[0], s[1], s[2], s[5]) for s in got] == [("A(Base)", "class", 1, ""), ("f", "function", 2, "A(Base)"), ("g", "function", 4, "A(Base)")]


def test_nesting_rules():
    nest, flat = fold.nesting_patterns("go")
    assert fold.nesting(["func f() {", "if a {", "}", "}"], nest, flat) == (2, [1, 2, 1, 0])
    assert fold.nesting(["if a {", "} else {", "}"], nest, flat)[1] == [1, 0, 0]


def test_signatures():
    assert fold.signature(["func (a A) F(x int) error {"]) == "(a A) F(x int) error "
    assert fold.signature(["@d", "def f(a,", "      b):", "  pass"]) == "def f(a, b)"
    assert fold.signature(["int main(", "  void)", "{"]) == "int main( void)"


def test_long_lines_are_told():
    assert fold.too_long(["x" * 65536]) == 1 and fold.too_long(["x" * 65535]) == 0


def test_profiles():
    assert len(supported()) == 15 and by_extension(".h") == "c" and by_extension(".zzz") is None
    with pytest.raises(KeyError):
        profile("cobol")
