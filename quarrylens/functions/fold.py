"""The per-file fold: what has to be read line by line, in order.

Everything here is plain Python over one file; ``operators.parse`` runs it on executors. A file is
sanitised once (comments and literals blanked, columns kept), and headers, brace deltas and running
depths are arrays over its lines, from which intervals follow.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate, islice
from typing import NamedTuple

import regex

from ..languages import CALL, IDENT, Profile, compiled, needs

NORMAL, LINE_COMMENT, BLOCK, STRING, RAW, CHAR, DOC = "Normal", "LineComment", "BlockComment", "String", "RawString", "CharLiteral", "MultiLineString"
STATES = (NORMAL, LINE_COMMENT, BLOCK, STRING, RAW, CHAR, DOC)
LITERALS = (STRING, RAW, CHAR, DOC)
LONGEST_LINE = 65535


class Function(NamedTuple):
    name: str
    start: int
    end: int
    decorators: list[str]
    class_name: str


class Type(NamedTuple):
    name: str
    kind: str
    start: int
    end: int
    indent: int


def spaces(n: int) -> str:
    return " " * n


class Sanitizer:
    """Blanks comments and literals of one language, keeping every column.

    ``strict`` closes a literal only with the delimiter that opened it and ends plain strings at the end of
    the line; otherwise any string delimiter closes any string, a raw string needs its opening marker again,
    and open strings run on to the next line.
    """

    def __init__(self, p: Profile, use_raw: bool = False, strict: bool = False):
        self.p, self.use_raw, self.strict = p, use_raw, strict
        raw = () if use_raw else p.raw
        # in the order in which they are tried at a position
        self.openers = [(CHAR, d) for d in p.chars if d] + [(DOC, d) for d in p.docs if d]
        self.openers += [(BLOCK, p.block[0])] if p.block[0] else []
        self.openers += [(LINE_COMMENT, p.line_comment)] if p.line_comment else []
        self.openers += [(RAW, d) for d in raw] + [(STRING, d) for d in p.strings]
        self.next_opener = regex.compile("|".join(regex.escape(d) for _, d in self.openers)) if self.openers else None
        self.state_of: dict[str, str] = {}
        for state, d in self.openers:
            self.state_of.setdefault(d, state)
        ends = lambda ds: regex.compile("|".join([regex.escape(p.escape) + "(?s:.)", *map(regex.escape, ds)]))
        self.ends = {STRING: ends(p.strings), CHAR: ends(p.chars)}
        self.raw_ends = regex.compile("|".join(map(regex.escape, p.raw))) if p.raw else None
        self.token = None if strict or not self.openers else re.compile("|".join(x for o in self.openers for x in self._tokens(*o)))

    def _tokens(self, state: str, mark: str) -> list[str]:
        """Patterns of what ``mark`` opens: whole, block comments and raw literals also over lines, and (with an empty group) anything else."""
        opened, (a, b), esc = re.escape(mark), self.p.block, re.escape(self.p.escape)
        rest = [opened + "()"]
        if state == LINE_COMMENT:
            return [opened + r"[^\n]*"]
        if state == BLOCK and b:
            a, b = re.escape(a), re.escape(b)
            return [rf"{opened}(?:(?!{a}|{b})[^\n])*+(?:\n(?s:.)*?)?{b}", *rest]
        closes = {STRING: self.p.strings, CHAR: self.p.chars}.get(state)
        if closes and all(closes) and self.p.escape:
            close = "|".join(map(re.escape, closes))
            return [rf"{opened}(?:{esc}[^\n]|(?!{close}|{esc})[^\n])*+(?:{close})", *rest]
        if state == RAW and all(len(x) == 1 for x in self.p.raw):
            close = "".join(map(re.escape, self.p.raw))
            return [rf"{opened}[^{close}]*+[{close}]", *rest]
        return rest

    def whole(self, raw: list[str], with_states: bool = True) -> tuple[list[str], list[str] | None]:
        """The blanked lines of a file and the states after them; None if all are normal, or not asked for.

        Where everything that opens also ends in a plain way, which holds for most files, one substitution over the text does what
        ``line`` does step by step.
        """
        text = "\n".join(raw)
        if not raw or not any(d in text for _, d in self.openers):
            return raw, None
        if self.token is not None and text.count("\n") == len(raw) - 1:
            runs_on = False

            def blank(m) -> str:
                nonlocal runs_on
                if m.lastindex:
                    runs_on = True
                if "\n" not in m[0]:
                    return spaces(m.end() - m.start())
                runs_on = runs_on or with_states
                return "\n".join(spaces(len(x)) for x in m[0].split("\n"))

            clean = self.token.sub(blank, text)
            if not runs_on:
                return clean.split("\n"), None
        done = list(self.lines(raw))
        return [c for c, _ in done], [s for _, s in done]

    def line(self, text: str, state: str) -> tuple[str, str]:
        """The blanked line and the state after it."""
        if not text:
            return text, state
        at, n, out, opened = 0, len(text), [], ""
        while at < n:
            if state == NORMAL:
                m = self.next_opener.search(text, at) if self.next_opener else None
                if m is None:
                    out.append(text[at:])
                    break
                out.append(text[at : m.start()])
                at, opened = m.start(), m[0]
                state, upto = self._open(text, at, opened)
            else:
                state, upto = self._inside(text, at, state, opened)
            out.append(spaces(upto - at))
            at = upto
        if self.strict and state in (STRING, CHAR):
            state = NORMAL
        return "".join(out), state

    def _open(self, text: str, at: int, mark: str) -> tuple[str, int]:
        """State and place after what opens at ``at``."""
        kind, n = self.state_of[mark], len(text)
        if kind == LINE_COMMENT:
            return NORMAL, n
        if kind == BLOCK:
            return self._block(text, at)
        if kind == DOC:
            end = self._verbatim_end(text, at + 2) if mark == '@"' else text.find(mark, at + len(mark))
            if end < 0:
                return DOC, n
            return NORMAL, end + (1 if mark == '@"' else len(mark))
        if kind == RAW:
            return RAW, at + (len(mark) if self.strict else 1)
        return kind, at + len(mark)

    @staticmethod
    def _verbatim_end(text: str, at: int) -> int:
        m = regex.compile('(?:[^"]|"")*+"(?!")').match(text, at)
        return m.end() - 1 if m else -1

    def _block(self, text: str, at: int) -> tuple[str, int]:
        """A block comment that opens here; nested ones count on this line only."""
        a, b = self.p.block
        depth, p = 1, at + len(a)
        for m in regex.compile(f"{regex.escape(a)}|{regex.escape(b)}").finditer(text, p):
            depth += 1 if m[0] == a else -1
            if not depth:
                return NORMAL, m.end()
        return BLOCK, len(text)

    def _inside(self, text: str, at: int, state: str, opened: str) -> tuple[str, int]:
        n = len(text)
        if state == BLOCK:
            end = text.find(self.p.block[1], at)
            return (BLOCK, n) if end < 0 else (NORMAL, end + len(self.p.block[1]))
        if state == DOC:
            return self._doc(text, at), n
        if state == RAW:
            if self.strict and opened:
                close = {"`": "`", '"""': '"""', 'r#"': '"#', "%q{": "}", "%Q{": "}"}.get(opened, opened[-1])
                end = text.find(close, at)
                return (RAW, n) if end < 0 else (NORMAL, end + len(close))
            m = self.raw_ends.search(text, at) if self.raw_ends else None
            return (RAW, n) if m is None else (NORMAL, m.start() + 1)
        closes = self.ends[state]
        while True:
            m = closes.search(text, at)
            if m is None:
                return state, n
            if m[0][0] == self.p.escape and len(m[0]) == 2 or self.strict and opened and m[0] != opened:
                at = m.end()
                continue
            return NORMAL, m.end()

    def _doc(self, text: str, at: int) -> str:
        """Whether a doc string goes on after this line; the rest of the line is blank either way."""
        quote = text.find('"', at)
        if not self.strict and quote >= 0 and text[quote + 1 : quote + 2] != '"':
            return NORMAL
        return NORMAL if any(text.find(d, at) >= 0 for d in self.p.docs) else DOC

    def lines(self, raw: list[str], state: str = NORMAL) -> Iterator[tuple[str, str]]:
        for text in raw:
            clean, state = self.line(text, state)
            yield clean, state


def delta(clean: str) -> int:
    return clean.count("{") - clean.count("}")


def split_lines(content: str) -> list[str]:
    """Lines without their ends; no last empty line."""
    lines = content.split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    return lines if "\r" not in content else [x[:-1] if x.endswith("\r") else x for x in lines]


def too_long(lines: list[str]) -> int:
    """Number of the first line of over 64 KiB, or 0."""
    return next((i for i, x in enumerate(lines, 1) if len(x) > LONGEST_LINE // 4 and len(x.encode()) > LONGEST_LINE), 0)


def indent_level(line: str, tab: int = 4) -> int:
    head = line[: len(line) - len(line.lstrip(" \t"))]
    return len(head) + (tab - 1) * head.count("\t")


def header_name(m, strict: bool) -> str:
    """The name a header match gives: with six groups the third or fifth, else the last that took part."""
    groups = [g or "" for g in m.groups()]
    if len(groups) >= 5 and (groups[2] or groups[4]):
        return groups[2] or groups[4]
    named = [g for g in groups if g]
    if strict and len(named) > 1 and (named[-1] == "const" or named[-1].startswith("throws")):
        named.pop()
    return named[-1] if named else ""


def may_match(pattern: str, lines: list[str]) -> list[int]:
    """Places of the lines on which a pattern has to be tried."""
    words = needs(pattern)
    if not words:
        return list(range(len(lines)))
    text = "\n".join(lines)
    words = [w for w in words if w in text]
    return sorted({i for w in words for i, c in enumerate(lines) if w in c})


def depths(clean: list[str]) -> list[int]:
    """Brace deltas of all lines."""
    return [c.count("{") - c.count("}") if "{" in c or "}" in c else 0 for c in clean]


def functions(p: Profile, clean: list[str], classes: list[Type] | None = None, names: frozenset[str] | None = None, strict: bool = False, first: int = 1, deltas: list[int] | None = None) -> list[Function]:
    """Functions of a brace language by (start, end). ``names`` keeps others from opening an interval."""
    pattern = compiled(p.func)
    deltas = depths(clean) if deltas is None else deltas
    headers: dict[int, str] = {}
    for i in may_match(p.func, clean):
        m = pattern.search(clean[i])
        if m:
            name = header_name(m, strict)
            if not names or name in names:
                headers[i] = name
    spans = _nested(headers, deltas, clean) if p.nested else _single(headers, deltas, clean)
    classes = classes or []
    starts = [k.start for k in classes]  # classes follow each other, none holds another

    def owner(line: int) -> str:
        at = bisect_right(starts, line) - 1
        return classes[at].name if at >= 0 and line <= classes[at].end else ""

    return [Function(headers[s], s + first, e + first, [], owner(s + first)) for s, e in sorted(spans)]


def _nested(headers: dict[int, str], deltas: list[int], clean: list[str]) -> list[tuple[int, int]]:
    """Every header opens an interval; it closes where the running depth falls back to what it was before the header."""
    out, waiting, depth = [], {}, 0
    for i, d in enumerate(deltas):
        if not d and i not in headers:
            continue
        before, depth = depth, depth + d
        if d < 0 and depth in waiting:
            out += [(s, i) for s in waiting.pop(depth)]
        if i in headers:
            if d == 0 and "{" in clean[i]:
                out.append((i, i))
            else:
                waiting.setdefault(before, []).append(i)
    return out


def _single(headers: dict[int, str], deltas: list[int], clean: list[str]) -> list[tuple[int, int]]:
    """One interval at a time: the next header counts once the last one's body has closed."""
    out, i, n = [], 0, len(clean)
    for h in sorted(headers):
        if h < i:
            continue
        depth = deltas[h]
        end = h if depth == 0 and "{" in clean[h] else None
        j = h + 1
        while end is None and j < n:
            before, depth = depth, depth + deltas[j]
            if depth == 0 and (before > 0 or "{" in clean[j]):
                end = j
            j += 1
        if end is None:
            break
        out.append((h, end))
        i = end + 1
    return out


def classes(p: Profile, clean: list[str], strict: bool = False, first: int = 1, deltas: list[int] | None = None) -> list[Type]:
    """Classes, one open at a time; one still open at the end of the file ends there."""
    pattern, out, i = compiled(p.cls), [], 0
    if pattern is None or not pattern.groups:
        return out
    deltas = depths(clean) if deltas is None else deltas
    braces = [k for k, d in enumerate(deltas) if d]
    for start in may_match(p.cls, clean):
        m = pattern.search(clean[start]) if start >= i else None
        if not m:
            continue
        i, depth = start, deltas[start] if strict else clean[start].count("{")
        end = start if strict and depth <= 0 and "{" in clean[start] else None
        i += 1
        if end is None and i < len(clean) and depth + deltas[i] <= 0:
            end = i
        elif end is None:  # the depth is above 0 from the next line on, and changes at braces only
            for k in islice(braces, bisect_left(braces, i), None):
                depth += deltas[k]
                if depth <= 0:
                    end = k
                    break
        i = len(clean) if end is None else max(i, end + 1)
        out.append(Type(m[1] or "", "class", start + first, (len(clean) - 1 if end is None else end) + first, 0))
        if end is None:
            break
    return out


def python_functions(p: Profile, raw: list[str], names: frozenset[str] | None = None) -> list[Function]:
    """Functions by indentation, on raw lines; starts include decorators, ends reach to the next line that is not deeper."""
    pattern, mark = compiled(p.func), compiled(p.decorator)
    out = []
    for i, line in enumerate(raw):
        m = pattern.search(line)
        if not m:
            continue
        name = header_name(m, False)
        if names and name not in names:
            continue
        above, top = _decorators(raw, i, mark)
        sig = next((j for j in range(i, len(raw)) if raw[j].strip().endswith(":")), i)
        level = indent_level(raw[sig])
        stop = next((j for j in range(sig + 1, len(raw)) if not _idle(raw[j]) and indent_level(raw[j]) <= level), len(raw))
        out.append(Function(name, (top if above else i) + 1, stop, above, ""))
    return out


def _idle(line: str) -> bool:
    t = line.strip()
    return not t or t.startswith("#")


def _decorators(raw: list[str], at: int, mark, window: int = 15) -> tuple[list[str], int]:
    """Decorators right above a line, in source order, and the first one's index; the window holds the line itself too."""
    found, top = [], -1
    for j in range(at - 1, max(-1, at - window), -1):
        t = raw[j].strip()
        if not t or t.startswith(("#", "//")):
            continue
        if mark is None or not mark.search(t):
            break
        found.append(t)
        top = j
    return found[::-1], top


def types(p: Profile, raw: list[str], clean: list[str], names: frozenset[str] | None = None, first: int = 1, deltas: list[int] | None = None) -> list[Type]:
    """Type declarations: one open at a time, kinds tried in the profile's order."""
    if p.indent_based:
        return python_types(raw, names)
    hybrid = p.lang in ("js", "ts")
    patterns = [(k, compiled(x)) for k, x in p.types.items()]
    out, i, n = [], 0, len(clean)
    deltas = depths(clean) if deltas is None else deltas
    braces = [k for k, d in enumerate(deltas) if d]
    for start in may_match("|".join(f"(?:{x})" for x in p.types.values()), clean) if p.types else ():
        if start < i:
            continue
        hit = next(((k, m) for k, x in patterns if (m := x.search(clean[start]))), None)
        name = next((g for g in reversed(hit[1].groups()) if g), "") if hit else ""
        if not name or names and name not in names:
            continue
        i, kind, depth = start, hit[0], deltas[start]
        level = indent_level(raw[i])
        at_once = depth <= 0 and (hybrid or not p.block_end and (kind in ("named", "type_alias") or "{" in clean[i]))
        end = start if at_once else None
        depth = max(depth, 0)
        i += 1
        if end is None and p.block_end:
            end = next((k for k in range(i, n) if p.block_end in raw[k] and raw[k].strip() == p.block_end and indent_level(raw[k]) == level), None)
        elif end is None:
            for k in islice(braces, bisect_left(braces, i), None):
                before, depth = depth, depth + deltas[k]
                if depth == 0 and before > 0:
                    end = k
                    break
        i = n if end is None else max(i, end + 1)
        out.append(Type(name, kind, start + first, (n - 1 if end is None else end) + first, level))
    return out


#: What a base class's name has to contain, and the kind it gives, in order.
PY_KINDS = (("NamedTuple", "NamedTuple"), ("TypedDict", "TypedDict"), ("Enum", "enum"), ("ABC", "abstract"), ("Protocol", "Protocol"))
PY_CLASS = regex.compile(r"^class\s+([\p{L}\p{Nd}_]+)\s*(?:\(([^)]*)\))?", regex.ASCII)


def python_types(raw: list[str], names: frozenset[str] | None = None) -> list[Type]:
    """Classes by indentation: a class ends on the line before the next one that is not deeper."""
    out = []
    for i, line in enumerate(raw):
        m = PY_CLASS.search(line.strip())
        if not m or names and m[1] not in names:
            continue
        kind = next((k for part, k in PY_KINDS if part in (m[2] or "")), "class")
        level = indent_level(line)
        stop = next((j for j in range(i + 1, len(raw)) if not _idle(raw[j]) and indent_level(raw[j]) <= level), len(raw))
        out.append(Type(m[1], kind, i + 1, stop, level))
    return out


def fields(p: Profile, raw: list[str], t: Type, first: int = 1) -> list[tuple[str, str, int]]:
    """(name, type, line) of a type's fields: its own lines sanitised anew, without methods, comments and keywords."""
    body = range(t.start - first, t.end - first)
    pattern = compiled(p.field_pattern)
    if p.indent_based:
        texts = [(i, raw[i]) for i in range(t.start - first + 1, min(t.end - first + 1, len(raw)))]
    else:
        texts = list(zip(body, (c for c, _ in Sanitizer(p).lines([raw[i] for i in body])), strict=True))
    out = []
    for i, text in texts:
        bare = text.strip()
        if not bare or p.line_comment and bare.startswith(p.line_comment) or p.indent_based and bare.startswith(("@", "def ", "async def ", "class ")):
            continue
        m = pattern.search(text)
        if not m or not m.groups():
            continue
        name, kind = m[1] or "", (m[2] or "").strip() if m.re.groups > 1 else ""
        if not name or name in p.exclude or not p.indent_based and ("(" in text or ")" in text):
            continue
        out.append((name, kind, i + first))
    return out


#: What begins a scope: its kind by the keyword, and what ends its name.
SCOPE = regex.compile(r"(?:async )?(?P<function>def )(?P<def_name>[^(]*)|(?P<class>class )(?P<class_name>[^:]*)", regex.DOTALL)


def python_scopes(raw: list[str]) -> list[tuple[str, str, int, int, int, str]]:
    """(name, kind, start, end, indent, parent) of defs and classes; tabs count eight.

    A header ends every scope that is not less indented than itself, as does another line of code that is no deeper than
    the line of code before it and begins no doc string. Read backwards, the lines that may end a scope form a
    staircase: a nearer one hides those behind it that are not less indented.
    """
    code = [(n, indent_level(x, 8), x.strip()) for n, x in enumerate(raw, 1) if x.strip() and x.strip()[0] != "#"]
    marks = [n for n, _, t in code if t[0] == "@"]
    code = [c for c in code if c[2][0] != "@"]
    heads = {n: m for n, _, t in code if (m := SCOPE.match(t))}
    levels, lines, ends = [], [], {}
    for at in range(len(code) - 1, -1, -1):
        n, level, text = code[at]
        if n in heads:
            step = bisect_right(levels, level)
            ends[n] = lines[step - 1] - 1 if step else len(raw)
        if n in heads or level <= (code[at - 1][1] if at else 0) and not text.startswith('"""'):
            keep = bisect_left(levels, level)
            levels[keep:], lines[keep:] = [level], [n]
    out, around, last = [], [], 0
    for n, level, _ in (c for c in code if c[0] in heads):
        while around and around[-1][0] < n:
            around.pop()
        kind = "function" if heads[n]["function"] else "class"
        name = heads[n]["def_name"] if kind == "function" else heads[n]["class_name"]
        above = bisect_left(marks, n) - bisect_left(marks, last)  # decorators since the last header
        out.append((name, kind, n - above, ends[n], level, around[-1][1] if around else ""))
        around.append((ends[n], name))
        last = n
    # a scope reaches up to the next one
    starts = [s[2] for s in out[1:]] + [0] * bool(out)
    return [(name, kind, start, max(end, after - 1), level, parent) for (name, kind, start, end, level, parent), after in zip(out, starts, strict=True)]


#: Fixed value: a call site, with or without a receiver.
CALL_SITE = regex.compile(r"([\p{L}_][\p{L}\p{Nd}_]*)\.([\p{L}_][\p{L}\p{Nd}_]*)\s*\(|([\p{L}_][\p{L}\p{Nd}_]*)\s*\(")


#: The same in ASCII text.
ASCII_CALL_SITE = re.compile(r"([A-Za-z_]\w*+)(?:\.([A-Za-z_]\w*+))?+[ \t\x0b\x0c\r]*+\(", re.ASCII)


#: A call when counting calls; keywords are found too.
NAME = regex.compile(CALL.replace("{IDENT}", IDENT), regex.ASCII)
ASCII_NAME = re.compile(r"(\w++)\s*\(", re.ASCII)


def call_sites(clean: list[str], first: int = 1) -> list[tuple[int, str, str]]:
    """(line, receiver, name) of calls; the receiver is empty for bare calls."""
    out = []
    for i, c in enumerate(clean, first):
        if "(" not in c:
            continue
        if c.isascii():
            out += [(i, a, b) if b else (i, "", a) for a, b in ASCII_CALL_SITE.findall(c)]
        else:
            out += [(i, m[1] or "", m[2] or m[3]) for m in CALL_SITE.finditer(c)]
    return out


def call_names(p: Profile, clean: list[str]) -> list[tuple[str, int]]:
    """(name, count): every ``name(`` of a file's sanitised lines, the profile's words left out."""
    counts = Counter()
    for c in clean:
        if "(" in c:
            counts.update((ASCII_NAME if c.isascii() else NAME).findall(c))
    return [x for x in counts.items() if x[0] not in p.exclude]


def file_edges(found: list[Function], sites: list[tuple[int, str, str]]) -> list[tuple[str | None, str, str, int, bool]]:
    """(caller, receiver, callee, line, own): each call of a file once, by its first line, with the outermost function around it.

    ``own`` says that a function of the callee's name is in the file. The file's functions come first, once by name, without a
    caller. Calls outside functions and bare calls of a function to itself are left out.
    """
    outer, last = [], 0
    for f in sorted(found, key=lambda f: (f.start, -f.end)):
        if not outer or f.start > last:
            outer.append(f)
        last = max(last, f.end)
    names = {f.name: f.start for f in reversed(found)}
    at, seen = -1, {}
    for line, receiver, name in sites:
        while at + 1 < len(outer) and outer[at + 1].start <= line:
            at += 1
        if at >= 0 and line <= outer[at].end and (receiver or name != outer[at].name):
            seen.setdefault((outer[at].name, receiver, name), line)
    return [(None, "", n, line, True) for n, line in names.items()] + [(*k, line, k[2] in names) for k, line in seen.items()]


#: The header in a function's trimmed lines, by family; a header in brackets may go on for four lines more.
SIGNATURE = regex.compile(
    r"^(?!@)(?:func (?P<go>[^{\n]*)|(?P<py>(?:async )?def [^:]*)|(?P<js>(?=[^\n]*function )(?:[^{\n]+|\{[^\n]*))"
    r"|(?P<call>(?=[^\n]*\()(?:(?=[^\n]*\{)(?:[^{\n]+|\{[^\n]*)|(?=[^\n]*\n)[^{\n]*(?:\n[^{\n]*){0,4})))",
    regex.MULTILINE,
)


def signature(body: list[str]) -> str:
    """The header text of a function, without its body."""
    m = SIGNATURE.search("\n".join(x.strip() for x in body))
    if m is None:
        return ""
    if m["go"] is not None:
        return m["go"]
    return " ".join(m["call"].split()) if m["call"] is not None else (m["py"] or m["js"]).replace("\n", " ").strip()


def is_code(line: str) -> bool:
    """Neither blank nor a comment."""
    bare = line.strip()
    return bool(bare) and not bare.startswith(COMMENT_MARKS)


#: What lines told, by patterns and line; many lines are alike.
_TOLD: dict[tuple[str, str], dict[str, tuple[int, int, bool, int]]] = {}
MOST_TOLD = 1 << 16


def nesting_facts(line: str, nest, flat) -> tuple[int, int, bool, int]:
    """(opening braces, closing braces, whether there is a keyword, by how much that goes deeper) of a line."""
    bare = line.strip()
    code = "" if bare.startswith(COMMENT_MARKS) else bare.split("//", 1)[0].split("#", 1)[0]
    up, word = code.count("{"), bool(code and nest.search(code))
    return up, code.count("}"), word, (up or 1) if word and not flat.search(code) else 0


def nesting(body: list[str], nest, flat) -> tuple[int, list[int]]:
    """(greatest depth, depth after each line) of a function's raw lines.

    A line with a keyword that is not flat goes deeper by its opening braces, or by one; closing braces come off, not below
    zero; surplus braces of other lines count unless a keyword without a brace still waits for its block.
    """
    if not body:
        return 0, []
    known = _TOLD.setdefault((nest.pattern, flat.pattern), {})
    if len(known) > MOST_TOLD:
        known.clear()
    told = [known.get(x) or known.setdefault(x, nesting_facts(x, nest, flat)) for x in body]
    up, down, word, gain = zip(*told, strict=True)
    last = lambda seen: list(accumulate((i if x else -1 for i, x in enumerate(seen)), max))
    waits = [k > c for k, c in zip(last([g and not u for g, u in zip(gain, up, strict=True)]), last(down), strict=True)]
    surplus = [u - d if u > d and not w and not wait else 0 for u, d, w, wait in zip(up, down, word, waits, strict=True)]
    seen = list(accumulate(zip(gain, down, surplus, strict=True), lambda depth, x: max(0, depth + x[0] - x[1]) + x[2], initial=0))[1:]
    return min(max(seen, default=0), 15), seen


#: Beginnings of lines that count as comments in every language, and nesting keywords.
COMMENT_MARKS = ("//", "#", "/*", "'", '"""', "'''")
NEST = {
    "py": r"^\s*(if|elif|for|while|except|with)\s*[(a-zA-Z]",
    "go": r"^\s*(if|for|switch)\s*[(a-zA-Z]",
    "js": r"^\s*(if|else|for|while|do|switch|catch|finally)\s*[(a-zA-Z_]",
    "ts": r"^\s*(if|else|for|while|do|switch|catch|finally)\s*[(a-zA-Z_]",
    "c": r"^\s*(if|else|for|while|do|switch|case|default)\s*[(a-zA-Z_]",
    "java": r"^\s*(if|else|for|while|do|switch|catch|finally)\s*[(a-zA-Z_]",
    "d": r"^\s*(if|else|for|foreach|while|do|switch|catch|finally)\s*[(a-zA-Z_]",
    "cs": r"^\s*(if|else|for|foreach|while|do|switch|catch|finally)\s*[(a-zA-Z_]",
}
FLAT = {
    "py": r"^\s*elif\s+|^\s*else\s*:|^\s*except\s+",
    "go": r"^\s*else\s*\{?\s*$|^\s*case\s+",
    "js": r"^\s*else\s*\{|^\s*case\s+:|^\s*default\s*:",
    "ts": r"^\s*else\s*\{|^\s*case\s+:|^\s*default\s*:",
    "c": r"^\s*else\s*\{|^\s*case\s+:|^\s*default\s*:",
    "java": r"^\s*else\s*\{|^\s*case\s+:|^\s*default\s*:",
    "d": r"^\s*else\s*\{|^\s*case\s+:|^\s*default\s*:",
    "cs": r"^\s*else\s*\{|^\s*case\s+:|^\s*default\s*:",
}
NEST_OTHER, FLAT_OTHER = r"\b(if|for|while|switch)\b", r"\b(else|elif|case|default)\b"


def nesting_patterns(lang: str):
    return regex.compile(NEST.get(lang, NEST_OTHER), regex.ASCII), regex.compile(FLAT.get(lang, FLAT_OTHER), regex.ASCII)
