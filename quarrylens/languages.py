"""Language profiles: the dimension table that drives scanning and parsing."""

from __future__ import annotations

from dataclasses import dataclass, field
from re import _parser
from typing import Any

import regex

#: Fixed value: what {IDENT} stands for in header, field and call patterns.
IDENT = r"[\p{L}\p{Nd}_]"
#: Fixed value: a call, when counting calls.
CALL = r"({IDENT}+)\s*\("


@dataclass(frozen=True)
class Profile:
    """One language. Patterns are kept as text; ``compiled`` gives them as regular expressions."""

    lang: str
    name: str
    extensions: tuple[str, ...]
    func: str
    cls: str
    types: dict[str, str]  # kind -> pattern, the most specific first
    field_pattern: str
    imports: str
    exclude: tuple[str, ...]
    decorator: str = ""
    line_comment: str = "//"
    block: tuple[str, str] = ("/*", "*/")
    strings: tuple[str, ...] = ('"',)
    raw: tuple[str, ...] = ()
    chars: tuple[str, ...] = ()
    docs: tuple[str, ...] = ()
    nested: bool = False
    indent_based: bool = False
    block_end: str = ""
    call: str = CALL
    escape: str = "\\"
    extra: dict[str, Any] = field(default_factory=dict)


# Patterns, markers and word lists of the languages. They decide what is found, so they are
# stated as they are; kinds are in the order in which they are tried.
_SAME = ("if", "else", "while", "for", "switch", "case", "return")
_JS_WORDS = (*_SAME, "typeof", "instanceof", "new", "delete", "void", "await", "async", "export", "import", "default")
PROFILES = {
    p.lang: p
    for p in (
        Profile(
            "go", "Go", (".go",),
            r"^\s*func\s+(\([^)]*\)\s+)?({IDENT}+)(?:\[[^\]]*\])?\s*\(",
            r"^\s*type\s+({IDENT}+)\s+(struct|interface)\s*\{",
            {"struct": r"^\s*type\s+({IDENT}+)\s+struct\s*\{", "interface": r"^\s*type\s+({IDENT}+)\s+interface\s*\{", "type_alias": r"^\s*type\s+({IDENT}+)\s*=\s*", "named": r"^\s*type\s+({IDENT}+)\s+[^={\s](?:.*[^{])?\s*$"},
            r"^\s*([a-zA-Z_][a-zA-Z0-9_]*)\s+([a-zA-Z_][\w\[\]*\s]*)\s*$",
            r'^\s*(?:import\s+"([^"]+)"|"([^"]+)"$)',
            ("func", "type", "import", "const", "var", "package"),
            raw=("`",), chars=("'",), nested=True,
        ),
        Profile(
            "c", "C", (".c", ".h"),
            r"^\s*[\w\s\*]+\s+({IDENT}+)\s*\([^)]*\)\s*$",
            r"^\s*(?:typedef\s+)?struct\s+(?:\w+\s*)?\{",
            {"typedef_struct": r"^\s*typedef\s+struct(?:\s+\w+)?\s*\{\s*({IDENT}+)\s*\}", "struct": r"^\s*(?:typedef\s+)?(?:struct|union)\s+(?:({IDENT}+)\s*)?\{"},
            r"^\s*([a-zA-Z_][a-zA-Z0-9_]*)\s*\s*([a-zA-Z_][\w\s\*\[\]]*)\s*;",
            r'^\s*#\s*include\s*[<"]([^>"]+)[>"]',
            (*_SAME, "sizeof", "define", "include", "ifdef", "ifndef", "endif"),
            strings=('"', "'"),
        ),
        Profile(
            "cpp", "C++", (".cpp", ".cc", ".cxx", ".hpp", ".h"),
            r"^\s*[\w\s\*:<>,]+\s+({IDENT}+)\s*\([^)]*\)\s*(const)?\s*$",
            r"^\s*(?:[\w\s]+\s+)?(?:class|struct)\s+({IDENT}+)",
            {"interface": r"^\s*(?:\w+\s+)?class\s+({IDENT}+)\s*:", "enum": r"^\s*(?:\w+\s+)?enum\s+(?:class\s+)?({IDENT}+)", "class": r"^\s*(?:\w+\s+)?class\s+({IDENT}+)", "struct": r"^\s*(?:\w+\s+)?struct\s+({IDENT}+)", "union": r"^\s*(?:\w+\s+)?union\s+({IDENT}+)"},
            r"^\s*(?:const\s+)?(?:\w+(?:<[^>]*>)?\s+)+([a-zA-Z_][a-zA-Z0-9_]*)\s*(?:\[\s*\]\s*)?(?:=|;|,)",
            r'^\s*#\s*include\s*[<"]([^>"]+)[>"]',
            (*_SAME, "sizeof", "define", "include", "typedef", "namespace", "using"),
            strings=('"', "'"),
        ),
        Profile(
            "cs", "C#", (".cs", ".csx"),
            r"^\s*[\w\s\*<>,\[\]]+\s+({IDENT}+)\s*\([^)]*\)\s*$",
            r"^\s*(?:[\w\s]+\s+)?(?:class|interface|struct|enum)\s+({IDENT}+)",
            {"record": r"^\s*(?:(?:public|private|protected|internal|sealed)\s+)?record\s+(?:struct\s+)?({IDENT}+)", "class": r"^\s*(?:(?:public|private|protected|internal|static|abstract|sealed|partial)\s+)*(?:class|record)\s+({IDENT}+)", "struct": r"^\s*(?:(?:public|private|protected|internal)\s+)?struct\s+({IDENT}+)", "interface": r"^\s*(?:(?:public|private|protected|internal)\s+)?interface\s+({IDENT}+)", "enum": r"^\s*(?:(?:public|private|protected|internal)\s+)?enum\s+({IDENT}+)"},
            r"^\s*(?:public|private|protected|internal|static|readonly|const|volatile)?\s*(?:readonly\s+)?(?:[a-zA-Z_][\w<>\.\[\]]*)\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*(?:\{|=|;)",
            r"^\s*using\s+([\w.]+)",
            ("if", "else", "while", "foreach", "for", "switch", "case", "return", "using", "namespace", "class", "interface", "struct", "enum"),
            r"^\s*\[(\w+)", raw=('@"',), chars=("'",),
        ),
        Profile(
            "java", "Java", (".java",),
            r"^\s*[\w\s\*<>,\[\]]+\s+({IDENT}+)\s*\([^)]*\)\s*(throws\s+[\w,\s]+)?\s*\{?\s*$",
            r"^\s*(?:[\w\s]+\s+)?(?:class|interface|enum)\s+({IDENT}+)",
            {"record": r"^\s*(?:(?:public|private|protected|static)\s+)?record\s+({IDENT}+)", "abstract": r"^\s*(?:(?:public|private|protected|static|abstract)\s+)*abstract\s+class\s+({IDENT}+)", "interface": r"^\s*(?:(?:public|private|protected|static)\s+)?interface\s+({IDENT}+)", "enum": r"^\s*(?:(?:public|private|protected|static)\s+)?enum\s+({IDENT}+)", "class": r"^\s*(?:(?:public|private|protected|static|abstract|final|sealed|non-sealed)\s+)*(?:class|record)\s+({IDENT}+)"},
            r"^\s*(?:public|private|protected|static|final|abstract|synchronized|native|strictfp)?\s*(?:final\s+)?(?:[a-zA-Z_][\w<>\[\]]*)\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*(?:=|;)",
            r"^\s*import\s+(?:static\s+)?([\w.]+)",
            (*_SAME, "import", "package", "class", "interface", "enum"),
            r"^\s*@(\w+)", chars=("'",),
        ),
        Profile(
            "d", "D", (".d",),
            r"^\s*[\w\s\*\[\]]+\s+({IDENT}+)\s*\([^)]*\)\s*$",
            r"^\s*(?:[\w\s]+\s+)?(?:class|struct|interface|enum)\s+({IDENT}+)",
            {"class": r"^\s*(?:(?:public|private|protected|static|const|immutable|shared)\s+)*class\s+({IDENT}+)", "struct": r"^\s*(?:(?:public|private|protected|static|const|immutable|shared)\s+)*struct\s+({IDENT}+)", "interface": r"^\s*(?:(?:public|private|protected)\s+)?interface\s+({IDENT}+)", "enum": r"^\s*(?:(?:public|private|protected|static|const)\s+)?enum\s+({IDENT}+)", "union": r"^\s*(?:(?:public|private|protected|static|const)\s+)?union\s+({IDENT}+)"},
            r"^\s*(?:public|private|protected|package|static|const|immutable|shared|enum)\s*(?:[a-zA-Z_][\w\[\]]*)\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*;",
            r"^\s*import\s+([\w.]+)",
            ("if", "else", "while", "foreach", "for", "switch", "case", "return", "import", "module", "class", "struct", "interface", "enum", "union"),
            raw=("`", 'r"'), chars=("'",),
        ),
        Profile(
            "js", "JavaScript", (".js", ".jsx", ".mjs"),
            r"^\s*(?:(export\s+)?(async\s+)?function\s*\*?\s+({IDENT}+)\s*\(|(?:export\s+)?(const|let|var)\s+({IDENT}+)\s*=\s*(async\s+)?\()",
            r"^\s*(?:export\s+)?class\s+({IDENT}+)",
            {"class": r"^\s*(?:export\s+)?(?:abstract\s+)?class\s+({IDENT}+)", "interface": r"^\s*(?:export\s+)?interface\s+({IDENT}+)", "enum": r"^\s*(?:export\s+)?const\s+({IDENT}+)\s*=\s*\{", "type_alias": r"^\s*(?:export\s+)?type\s+({IDENT}+)\s*="},
            r"(?:(?:public|private|protected|readonly|static|abstract)\s+)*(?:[a-zA-Z_][\w\[\]]*)\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*(?:=|;|,)",
            r"""^\s*(?:import\s+.*?from\s+["']([^"']+)["']|require\s*\(\s*["']([^"']+)["'])""",
            _JS_WORDS, strings=('"', "'"), raw=("`",), nested=True,
        ),
        Profile(
            "ts", "TypeScript", (".ts", ".tsx"),
            r"^\s*(?:(export\s+)?(async\s+)?function\s*\*?\s+({IDENT}+)\s*[<(]|(?:export\s+)?(const|let|var)\s+({IDENT}+)\s*=\s*(async\s+)?[<(])",
            r"^\s*(?:export\s+)?class\s+({IDENT}+)",
            {"class": r"^\s*(?:export\s+)?(?:abstract\s+)?class\s+({IDENT}+)", "interface": r"^\s*(?:export\s+)?interface\s+({IDENT}+)", "enum": r"^\s*(?:export\s+)?(?:const\s+)?enum\s+({IDENT}+)", "type_alias": r"^\s*(?:export\s+)?type\s+({IDENT}+)\s*="},
            r"(?:(?:public|private|protected|readonly|static|abstract)\s+)*(?:[a-zA-Z_][\w\[\]]*)\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*(?:\?|=|;|,)",
            r"""^\s*(?:import\s+.*?from\s+["']([^"']+)["']|require\s*\(\s*["']([^"']+)["'])""",
            _JS_WORDS, strings=('"', "'"), raw=("`",), nested=True,
        ),
        Profile(
            "py", "Python", (".py", ".pyw"),
            r"^\s*(async\s+)?def\s+({IDENT}+)\s*\(",
            r"^\s*class\s+({IDENT}+)",
            {"class": r"^\s*class\s+({IDENT}+)"},
            r"^\s*(\w+)\s*:\s*([\w\[\],\.\s\*]*?)\s*(?:=|$)",
            r"^\s*(?:from\s+(\S+)\s+import|import\s+(\S+))",
            ("def", "class", "if", "else", "elif", "while", "for", "try", "except", "finally", "with", "return", "yield", "import", "from", "pass", "break", "continue"),
            r"^\s*@(\w+)", line_comment="#", block=("", ""), strings=('"', "'"), raw=('r"', "r'"), docs=('"""', "'''"), nested=True, indent_based=True,
        ),
        Profile(
            "rust", "Rust", (".rs",),
            r'^\s*(?:pub\s+)?(?:pub\(crate\)\s+)?(?:async\s+)?(?:unsafe\s+)?(?:const\s+)?(?:extern\s+(?:"C"\s+)?)?fn\s+({IDENT}+)\s*(?:<[^>]*>)?\s*\(',
            r"^\s*(?:pub\s+)?(?:pub\(crate\)\s+)?(?:struct|trait|enum|impl)(?:\s+<[^>]*>)?\s+({IDENT}+)",
            {"struct": r"^\s*(?:pub\s+)?(?:pub\(crate\)\s+)?struct\s+({IDENT}+)", "enum": r"^\s*(?:pub\s+)?(?:pub\(crate\)\s+)?enum\s+({IDENT}+)", "trait": r"^\s*(?:pub\s+)?(?:pub\(crate\)\s+)?trait\s+({IDENT}+)", "union": r"^\s*(?:pub\s+)?(?:pub\(crate\)\s+)?union\s+({IDENT}+)"},
            r"^\s*(?:pub\s+)?(?:pub\(crate\)\s+)?(?:const\s+)?(?:static\s+)?(?:mut\s+)?([a-zA-Z_][a-zA-Z0-9_]*)\s*:(?:\s*<[^>]*>\s*)?\s*[a-zA-Z_][\w<>,\[\]\s]*",
            r"^\s*use\s+([^;]+)",
            ("if", "else", "while", "for", "loop", "match", "return", "break", "continue", "unsafe", "fn", "struct", "enum", "trait", "impl", "pub", "mod", "use"),
            raw=('r#"',),
        ),
        Profile(
            "swift", "Swift", (".swift",),
            r"^\s*(?:public\s+)?(?:static\s+)?func\s+({IDENT}+)\s*\(",
            r"^\s*(?:public\s+)?(?:class|struct|enum|protocol)\s+({IDENT}+)",
            {"class": r"^\s*(?:public\s+)?(?:open\s+)?(?:public\s+)?(?:final\s+)?class\s+({IDENT}+)", "struct": r"^\s*(?:public\s+)?struct\s+({IDENT}+)", "enum": r"^\s*(?:public\s+)?enum\s+({IDENT}+)", "protocol": r"^\s*(?:public\s+)?protocol\s+({IDENT}+)"},
            r"(?:var|let|public|private|internal|fileprivate|static)\s+(?:\w+(?:<[^>]*>)?\s+)+([a-zA-Z_][a-zA-Z0-9_]*)\s*(?::\s*[\w\[\]<>?,=\s]*)?(?:\{|=|;)",
            r"^\s*import\s+(\S+)",
            ("func", "class", "struct", "enum", "protocol", "if", "else", "while", "for", "guard", "switch", "catch", "return", "throw", "import", "public", "private", "internal", "static", "var", "let"),
            nested=True,
        ),
        Profile(
            "kotlin", "Kotlin", (".kt", ".kts"),
            r"^\s*(?:(?:public|private|protected|internal)\s+)?(?:suspend\s+)?fun\s+(?:<[^>]+>\s+)?({IDENT}+)\s*\(",
            r"^\s*(?:(?:public|private|protected|internal)\s+)?(?:data\s+|sealed\s+|enum\s+|abstract\s+)?(?:class|interface|object)\s+({IDENT}+)",
            {"data_class": r"^\s*(?:(?:public|private|protected|internal)\s+)?data\s+class\s+({IDENT}+)", "sealed_class": r"^\s*(?:(?:public|private|protected|internal)\s+)?sealed\s+class\s+({IDENT}+)", "enum_class": r"^\s*(?:(?:public|private|protected|internal)\s+)?enum\s+class\s+({IDENT}+)", "interface": r"^\s*(?:(?:public|private|protected|internal)\s+)?interface\s+({IDENT}+)", "object": r"^\s*(?:(?:public|private|protected|internal)\s+)?object\s+({IDENT}+)", "class": r"^\s*(?:(?:public|private|protected|internal)\s+)?(?:open\s+)?(?:abstract\s+)?(?:data\s+)?(?:sealed\s+)?class\s+({IDENT}+)"},
            r"(?:var|val|public|private|protected|internal|static|lateinit)\s+(?:\w+(?:<[^>]*>)?\s+)+([a-zA-Z_][a-zA-Z0-9_]*)\s*(?::\s*[\w\[\]<>?,=\s]*)?(?:\{|=|;)",
            r"^\s*import\s+([\w.]+)",
            ("if", "else", "while", "for", "when", "switch", "return", "fun", "class", "interface", "object", "data", "sealed", "enum", "val", "var", "import", "package"),
            r"^\s*@(\w+)", raw=('"""',), chars=("'",),
        ),
        Profile(
            "php", "PHP", (".php",),
            r"^\s*(?:(?:public|private|protected)\s+)?(?:static\s+)?function\s+({IDENT}+)\s*\(",
            r"^\s*(?:(?:abstract|final)\s+)?(?:class|interface|trait)\s+({IDENT}+)",
            {"abstract": r"^\s*abstract\s+class\s+({IDENT}+)", "class": r"^\s*(?:abstract\s+|final\s+)*(?:public\s+|private\s+|protected\s+)*class\s+({IDENT}+)", "interface": r"^\s*(?:public\s+|private\s+|protected\s+)*interface\s+({IDENT}+)", "trait": r"^\s*(?:public\s+|private\s+|protected\s+)*trait\s+({IDENT}+)"},
            r"(?:public|private|protected|var|static)\s+(?:\$\w+(?:<[^>]*>)?\s*,?\s*)+",
            r"""^\s*(?:use\s+([\w\\]+)|require(?:_once)?\s*["']([^"']+)["']|include(?:_once)?\s*["']([^"']+)["'])""",
            ("if", "else", "while", "foreach", "for", "switch", "case", "return", "echo", "print", "class", "interface", "trait", "function", "public", "private", "protected", "static"),
            strings=('"', "'"),
        ),
        Profile(
            "ruby", "Ruby", (".rb", ".rake"),
            r"^\s*def\s+({IDENT}+[?!]?)\s*[\(\n]?",
            r"^\s*(?:class|module)\s+({IDENT}+)",
            {"class": r"^\s*class\s+({IDENT}+)", "module": r"^\s*module\s+({IDENT}+)", "struct": r'^\s*Struct\.new\s*\(\s*"({IDENT}+)"', "data": r'^\s*Data\.define\s*\(\s*"({IDENT}+)"'},
            r"^\s*(?:attr_reader|attr_writer|attr_accessor)?\s*(?:\w+)\s*[,|\s]",
            r"""^\s*require(?:_relative)?\s*["']([^"']+)["']""",
            ("if", "elsif", "else", "unless", "while", "until", "for", "case", "when", "return", "yield", "class", "module", "def", "end"),
            line_comment="#", block=("=begin", "=end"), strings=('"', "'"), raw=("%q{", "%Q{"), nested=True, block_end="end",
        ),
        Profile(
            "scala", "Scala", (".scala",),
            r"^\s*(?:(?:private|protected|public)\s+)?def\s+({IDENT}+)\s*[\[\(]",
            r"^\s*(?:(?:private|protected|public)\s+)?(?:case\s+)?(?:class|object|trait)\s+({IDENT}+)",
            {"case_class": r"^\s*(?:(?:private|protected|public)\s+)?case\s+class\s+({IDENT}+)", "class": r"^\s*(?:(?:private|protected|public)\s+)?(?:final\s+)?(?:sealed\s+)?(?:abstract\s+)?class\s+({IDENT}+)", "trait": r"^\s*(?:(?:private|protected|public)\s+)?trait\s+({IDENT}+)", "object": r"^\s*(?:(?:private|protected|public)\s+)?object\s+({IDENT}+)", "enum": r"^\s*(?:(?:private|protected|public)\s+)?enum\s+({IDENT}+)"},
            r"(?:val|var|private|protected|public)\s+(?:\w+(?:<[^>]*>)?\s+)+([a-zA-Z_][a-zA-Z0-9_]*)\s*(?::\s*[\w\[\]<>?,=\s]*)?(?:=|;)",
            r"^\s*import\s+([\w.]+)",
            ("if", "else", "while", "for", "match", "case", "return", "yield", "def", "class", "trait", "object", "val", "var", "import", "package"),
            raw=('"""',), nested=True,
        ),
    )
}


_COMPILED: dict[str, regex.Pattern] = {}


def compiled(pattern: str):
    """A pattern with {IDENT} expanded; classes other than \\p are ASCII. Compiled once; the library's own lookup is slow."""
    if not pattern:
        return None
    if pattern not in _COMPILED:
        _COMPILED[pattern] = regex.compile(pattern.replace("{IDENT}", IDENT), regex.ASCII)
    return _COMPILED[pattern]


_NEEDS: dict[str, tuple[str, ...]] = {}


def needs(pattern: str) -> tuple[str, ...]:
    """Literals of which any match of ``pattern`` holds one; none if that is not known. To look for them is much cheaper."""
    if pattern not in _NEEDS:
        _NEEDS[pattern] = _needs(pattern)
    return _NEEDS[pattern]


def _needs(pattern: str) -> tuple[str, ...]:
    try:
        tree = _parser.parse(pattern.replace("{IDENT}", r"\w"))
    except Exception:  # a form that only the other library reads: every line is tried
        return ()
    words = None if tree.state.flags & _parser.SRE_FLAG_IGNORECASE else _literals(tree)
    return tuple(sorted(words or ()))


def _literals(tree) -> frozenset[str] | None:
    """Strings of which every match of a parsed pattern holds at least one; None if there are none. The longest are taken."""
    found, run = [], ""
    for op, arg in [*tree, (None, None)]:
        if op is _parser.LITERAL:
            run += chr(arg)
            continue
        if run:
            found.append(frozenset([run]))
            run = ""
        if op is _parser.SUBPATTERN:
            found.append(None if arg[1] & _parser.SRE_FLAG_IGNORECASE else _literals(arg[3]))
        elif op in (_parser.MAX_REPEAT, _parser.MIN_REPEAT, _parser.POSSESSIVE_REPEAT) and arg[0] > 0:
            found.append(_literals(arg[2]))
        elif op is _parser.BRANCH:
            of = [_literals(x) for x in arg[1]]
            found.append(None if None in of else frozenset().union(*of))
        elif op is _parser.IN and all(kind is _parser.LITERAL for kind, _ in arg):
            found.append(frozenset(chr(c) for _, c in arg))
    return max((x for x in found if x), key=lambda x: min(map(len, x)), default=None)


def supported() -> list[str]:
    """Sorted language keys."""
    return sorted(PROFILES)


def profile(lang: str) -> Profile:
    if lang not in PROFILES:
        raise KeyError(f"unsupported language: {lang}; supported: {', '.join(supported())}")
    return PROFILES[lang]


def by_extension(ext: str) -> str | None:
    """The language of an extension, exact case; .h is C."""
    return next((k for k, p in PROFILES.items() if ext in p.extensions), None)


def languages(spark):
    """The profiles as a DataFrame (15 rows)."""
    rows = [(p.lang, p.name, list(p.extensions), list(p.types), p.func, p.imports, p.decorator, p.line_comment, p.nested, p.indent_based, list(p.exclude)) for p in PROFILES.values()]
    return spark.createDataFrame(rows, "lang string, name string, extensions array<string>, kinds array<string>, func_pattern string, import_pattern string, decorator_pattern string, line_comment string, nested boolean, indent_based boolean, exclude_words array<string>")
