"""Expected rows of the catalogue's queries in DuckDB SQL, from the generating relations, never from parsed text."""

from __future__ import annotations

# documents as files
DOCS = """
docs as (select (case when doc_id % 10 = 7 then '.cache/' else '' end) || source || '/' || lang || '/d' || doc_id
    || (['.go', '.py', '.js', '.h', '.txt', '.log'])[(doc_id % 6 + 1)::int] as path, text as content, doc_id from documents)"""
EXT = "regexp_extract(path, '(\\.[^./]*)$', 1)"
DIR = "regexp_replace(path, '/?[^/]*$', '')"
VISIBLE = "not regexp_matches(path, '(^|/)\\.[^/]')"


def split(source: str, key: str = "path", text: str = "content") -> str:
    """Lines of a text: a last empty line does not count."""
    return f"""
parts as (select {key} as path, string_split(coalesce({text}, ''), chr(10)) as p from {source}),
lines as (select path, unnest(range(1, len(p) + 1)) as line_no, unnest(p) as raw, len(p) as n from parts),
kept as (select path, line_no::bigint as line_no, case when right(raw, 1) = chr(13) then left(raw, length(raw) - 1) else raw end as raw
    from lines where not (line_no = n and raw = ''))"""


# orders as functions, one file per customer; L is the number of lines of a function with the blank after it
ORDERS = """
items as (select l_orderkey as ok, count(*) as n_items from lineitem group by 1),
fns as (select o_orderkey as ok, o_custkey as ck, coalesce(n_items, 0) as n_items, lead(o_orderkey) over w as next_ok,
    row_number() over w as nth, count(*) over (partition by o_custkey) as n_fns
    from orders left join items on ok = o_orderkey window w as (partition by o_custkey order by o_orderkey))"""


def spans(ext: str, head: str, length: str, end: str = "start + len - 1") -> str:
    """(path, name, start, end_) by running lengths: ``head`` lines come first, a function has ``length`` lines."""
    return f"""{ORDERS},
sized as (select *, {length} as len, 'p' || (ck % 25) || '/c' || ck || '{ext}' as path, 'f' || ok as name from fns),
placed as (select *, ({head} + coalesce(sum(len) over (partition by ck order by nth rows between unbounded preceding and 1 preceding), 0) + 1)::bigint as start from sized),
f as (select *, ({end})::bigint as end_ from placed)"""


GO_LEN = "4 + n_items + (next_ok is not null)::int"
GO = spans(".go", "2", GO_LEN, "start + len - 2")
PY = spans(".py", "0", "4 + n_items", "start + len - 1 + (nth = n_fns)::int")
SWIFT = spans(".swift", "1", "3")
JS = spans(".js", "1", "3")
NESTED = spans(".go", "0", "2 + 2 * n_items")
GO_LINES = f"""{GO},
base as (select distinct path, ck from f),
golines as (
    select path, 1 as line_no, 'package p' || (ck % 25) as raw, 'code' as kind from base
    union all select path, 2, '', 'blank' from base
    union all select path, start, 'func f' || ok || '() {{', 'code' from f
    union all select path, start + 1, chr(9) || '// order ' || ok, 'comment' from f
    union all select path, start + 1 + row_number() over (partition by l_orderkey order by l_linenumber, l_partkey),
        chr(9) || 'lib' || (l_partkey % 5) || '.g' || l_linenumber || '(' || l_partkey || ')', 'code' from f join lineitem on l_orderkey = ok
    union all select path, end_ - 1, chr(9) || 'f' || next_ok || '()', 'code' from f where next_ok is not null
    union all select path, end_, '}}', 'code' from f
    union all select path, end_ + 1, '', 'blank' from f)"""
GO_LINES = GO_LINES.replace("{{", "{").replace("}}", "}")
EDGES = f"""{GO_LINES},
sites as (select path, name as caller, 'lib' || (l_partkey % 5) || '.g' || l_linenumber as callee,
    start + 1 + row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) as line from f join lineitem on l_orderkey = ok
    union all select path, name, 'f' || next_ok, end_ - 1 from f where next_ok is not null),
edges as (select path, caller, callee, min(line)::bigint as line from sites where caller <> callee group by all)"""
CALLS = """
o as (select o_orderkey as ok, 'p' || (o_custkey % 25) || '/c' || o_custkey || '.go' as path from orders),
calls as (select path, 'f' || ok as name from o union all select path, 'if' from o union all select path, 'g' || l_linenumber from lineitem join o on l_orderkey = ok)"""
COMPLEX = f"""{NESTED},
c as (select path, name, start, end_, (2 + 2 * n_items)::bigint as lines_of_code, least(n_items + 1, 15)::bigint as depth from f),
scored as (select *, (case when depth <= 1 then 1 else 2 ** (depth - 1) end)::bigint as complexity,
    case when depth <= 2 then 'SIMPLE' when depth = 3 then 'MODERATE' when depth = 4 then 'HIGH' when depth = 5 then 'VERY_HIGH' else 'CRITICAL' end as level from c)"""
TYPES = """
p as (select p_partkey as pk, p_partkey // 50 as g, (6 + (p_partkey % 3 = 0)::int) as len from part),
t as (select 't/g' || g || '.go' as path, pk, (coalesce(sum(len) over (partition by g order by pk rows between unbounded preceding and 1 preceding), 0) + 1)::bigint as start from p),
types as (select path, 'P' || pk as name, 'struct' as kind, start, start + 5 as "end" from t
    union all select path, 'K' || pk, 'named', start + 6, start + 6 from t where pk % 3 = 0)"""
SUPPLIERS = """
s as (select s_suppkey as sk, s_suppkey // 50 as g, ((row_number() over (partition by s_suppkey // 50 order by s_suppkey) - 1) * 4 + 1)::bigint as start,
    lead(s_suppkey) over (partition by s_suppkey // 50 order by s_suppkey) as more from supplier)"""
PY_IMPORTS = """
imported as (select 'r' || n.n_regionkey || '/n' || n.n_nationkey || '.py' as path, n.n_regionkey as r, 'n' || m.n_nationkey as value, m.n_nationkey + 10 as place
    from nation n join nation m on m.n_regionkey = n.n_regionkey and m.n_nationkey <> n.n_nationkey
    union all select 'r' || n_regionkey || '/n' || n_nationkey || '.py', n_regionkey, unnest(['os', 'numpy']), unnest([1, 2]) from nation)"""
RESOLVED = """
files as (select 'r' || n_regionkey || '/n' || n_nationkey || '.go' as path, 'r' || n_regionkey as shard, n_regionkey as r from nation),
edges as (select distinct a.shard as src, b.shard as dst from files a join files b on b.r = (a.r + 1) % 5)"""
CHECKSUM = f"""
sums as (select {DIR} as shard, count(*) as files, sha256(string_agg(line, chr(10) order by line)) as checksum
    from (select path, path || ':' || coalesce(sha256(content), '') as line from {{0}}) group by 1)"""
EDITED = """
edited as (select regexp_replace(path, '^src4/', 'src99/') as path,
    case when doc_id % 7 = 0 then coalesce(content, '') || chr(10) || 'more' else content end as content from docs where not starts_with(path, 'src3/'))"""
TWO = f"""{DOCS}, {EDITED},
old as ({{0}}), new as ({{1}})"""
_SUM = f"select {DIR} as shard, count(*) as files, sha256(string_agg(line, chr(10) order by line)) as checksum from (select path, path || ':' || coalesce(sha256(content), '') as line from %s) group by 1"
TWO = TWO.replace("{0}", _SUM % "docs").replace("{1}", _SUM % "edited")
TRUTH = f"""{GO},
pairs as (select path, 'function' as kind, name, 1::bigint as truth, 1::bigint as found, (ok % 4 <= 2)::int::bigint as matched from f)"""


def language(lang: str, ext: str, opened: int, head: int, closed: int, kind: str, length: int, qualifier: str = "") -> str:
    """Places in the files of another language: f functions, k (start, end_) of the class, t those of the type after it.

    A class has ``opened`` lines before its functions and ``closed`` after them, a function ``head`` lines before its statements, the
    type has ``length`` lines. Every third function is named by its qualifier, if there is one.
    """
    return f"""{spans(ext, str(1 + opened), f"{head} + 1 + n_items")},
named as (select *, case when ok % 3 = 0 and '{qualifier}' <> '' then '{qualifier}' else name end as told from f),
k as (select path, ck, 2::bigint as start, (1 + {opened + closed} + sum(len))::bigint as end_ from f group by path, ck),
t as (select path, ck, end_ + 1 as start, end_ + {length} as end_, '{kind}' as kind from k)"""


LANGUAGES = {
    "c": (".c", 0, 2, 0, "struct", 3),
    "cpp": (".cpp", 2, 2, 1, "enum", 3, "const"),
    "cs": (".cs", 2, 2, 1, "interface", 2),
    "java": (".java", 1, 1, 1, "abstract", 2, "throws Fault "),
    "d": (".d", 1, 2, 1, "struct", 3),
    "kotlin": (".kt", 1, 1, 1, "data_class", 2),
    "php": (".php", 1, 1, 1, "trait", 2),
    "ruby": (".rb", 1, 1, 1, "module", 2),
    "scala": (".scala", 1, 1, 1, "case_class", 2),
}


def language_symbols(lang: str) -> str:
    at = f"with {language(lang, *LANGUAGES[lang])}"
    functions = "select path, 'function' as kind, told as name, start, end_ as \"end\" from named"
    if lang == "c":  # C types are no classes
        return f"{at} {functions} union all select path, kind, 'T' || ck, start, end_ from t"
    if lang == "ruby":  # no braces: functions stay open, and a class ends on the line after its header
        return f"{at} select path, 'class' as kind, 'C' || ck as name, start, start + 1 as \"end\" from k union all select path, 'class', 'T' || ck, start, start + 1 from t"
    other = "kind" if lang == "cpp" else "'class'"  # a C++ enum is no class
    return f"{at} {functions} union all select path, 'class', 'C' || ck, start, end_ from k union all select path, {other}, 'T' || ck, start, end_ from t"


def _language_types(lang: str) -> str:
    own = "" if lang == "c" else f"select path, '{lang}' as lang, 'C' || ck as name, 'class' as kind, start, end_ as \"end\" from k union all "
    return f"(with {language(lang, *LANGUAGES[lang])} {own}select path, '{lang}' as lang, 'T' || ck as name, kind, start, end_ as \"end\" from t)"


def _strict(lang: str) -> str:
    return f"(with {language(lang, *LANGUAGES[lang])} select path, name, start, end_ as \"end\", 'C' || ck as class_name from f)"


def _struct(kind: str, name: str, a: str, b: str, fields: str) -> str:
    """A type as JSON."""
    return f"""'{{"name":"' || {name} || '","kind":"{kind}","start":' || {a} || ',"end":' || {b} || '{fields}}}'"""


P_JSON = _struct("struct", "'P' || pk", "start", "(start + 5)", ""","fields":[{"name":"Size","type":"int","line":' || (start + 1) || '},{"name":"Name","type":"string","line":' || (start + 3) || '}]""")
K_JSON = _struct("named", "'K' || pk", "(start + 6)", "(start + 6)", "")
D_TYPES = f"""{_struct("class", "'C' || ck", "k.start", "k.end_", ',"fields":[]')} || ',' || {_struct("struct", "'T' || ck", "t.start", "t.end_", ',"fields":[]')}"""

ORACLES = {
    "scan_files": f"with {DOCS} select path, case {EXT} when '.go' then 'go' when '.py' then 'py' when '.js' then 'js' when '.h' then 'c' end as lang from docs where {VISIBLE} and {EXT} in ('.go', '.py', '.js', '.h')",
    "scan_by_ext": f"with {DOCS} select {EXT} as ext, count(*) as files from docs where {VISIBLE} group by 1",
    "scan_ignore": f"with {DOCS} select path from docs where {VISIBLE} and not regexp_matches(path, '\\.log($|/)') and not regexp_matches({DIR}, '(^|/)src1($|/)')",
    "scan_one_language": f"with {DOCS} select path, 'cpp' as lang from docs where {VISIBLE} and {EXT} = '.h'",
    "lines_explode": f"with {DOCS}, {split('docs')} select path, line_no, raw from kept",
    "lines_range": f"with {DOCS}, {split('docs')} select path, line_no, raw from kept where line_no between 2 and 5",
    "lines_open_end": f"with {DOCS}, {split('docs')} select path, line_no, raw from kept where line_no >= 10",
    "file_stats": f"with {GO_LINES} select path, count(*) as total_lines, count(*) filter (kind = 'blank') as blank_lines, count(*) filter (kind = 'comment') as comment_lines, count(*) filter (kind = 'code') as code_lines from golines group by 1",
    "dir_stats": f"with {GO_LINES} select {DIR} as dir, count(*) as total_lines, count(*) filter (kind = 'blank') as blank_lines, count(*) filter (kind = 'comment') as comment_lines, count(*) filter (kind = 'code') as code_lines, count(distinct path) as files, round(100 * count(*) filter (kind = 'code') / count(*), 6) as code_percent from golines group by 1",
    "file_size_kb": f"with {DOCS} select path, round(strlen(coalesce(content, '')) / 1024, 6) as kb from docs",
    "brace_depth": f"with pg as (select 'p' || page_id || '.js' as path, html as content from pages), {split('pg')}, d as (select path, line_no, (length(replace(raw, '}}', '')) - length(replace(raw, '{{', '')))::bigint as delta from kept), r as (select *, sum(delta) over (partition by path order by line_no)::bigint as depth from d) select path, line_no, delta, depth, coalesce(lag(depth) over (partition by path order by line_no), 0)::bigint as before from r",
    "indent_levels": f"""with {PY}, l as (
        select path, start as line_no, 0 as indent, 0 as leading_spaces, false as idle from f union all select path, start + 1, 0, 0, false from f
        union all select path, start + 2, 4, 4, false from f union all select path, start + 3 + i, 4, 8, false from f, (select unnest(range(0, 100)) as i) where i < n_items
        union all select path, start + len - 1, 0, 0, true from f)
        select path, line_no::bigint as line_no, indent::bigint as indent, leading_spaces::bigint as leading_spaces, idle from l""",
    "sanitize_lines": f"with {GO_LINES} select path, line_no::bigint as line_no, case when kind = 'comment' then chr(9) || repeat(' ', length(raw) - 1) else raw end as clean, 'Normal' as state from golines",
    "function_map": f'with {GO} select path, name, start, end_ as "end" from f',
    "function_map_window": f'with {GO} select path, name, start, end_ as "end" from f',
    "function_map_rust": f'with {GO} select path, name, start, end_ as "end" from f',
    "function_filter": f"with {GO} select path, name, start, end_ as \"end\" from f where name in ('f1', 'f2', 'f3', 'f7', 'f32')",
    "python_functions": f"with {PY} select path, name, start, end_ as \"end\", '@deco' || (ok % 3) as decorators from f",
    "python_scopes": f"with {PY} select path, name, 'function' as kind, start, case when nth = n_fns then start + len - 1 else start + len end as \"end\" from f",
    "scope_snap": f"""with {PY}, sc as (select *, case when nth = n_fns then start + len - 1 else start + len end as e from f),
        hit as (select path, max_by(struct_pack(s := start, e := e), start) as a from sc where start <= 3 and e >= 3 group by path)
        select path, case when a.s = 3 and a.e >= 9 then 3 when a.s = 3 then 3 else a.s end::bigint as start, case when a.s = 3 and a.e >= 9 then 9 else a.e end::bigint as "end",
        case when a.s = 3 and a.e >= 9 then '' when a.s = 3 then 'clipped' else 'whole function' end as reason from hit""",
    "range_filter_python": f"""with {PY}, sc as (select *, case when nth = n_fns then start + len - 1 else start + len end as e from f),
        hit as (select path, max_by(struct_pack(s := start, e := e), start) as a from sc where start <= 3 and e >= 3 group by path)
        select f.path, name, start, end_ as "end" from f join hit using (path) where start >= a.s and end_ <= a.e""",
    "decorators": f"with {PY}, v as (select path, 'deco' || (ok % 3) as value, min(start) as first_at from f group by all) select path, value, row_number() over (partition by path order by first_at) as nth from v",
    "class_map": f'with {SWIFT} select path, \'C\' || ck as name, 1::bigint as start, (count(*) * 3 + 2)::bigint as "end" from f group by path, ck',
    "class_methods": f"with {SWIFT} select path, 'C' || ck as class_name, 1::bigint as class_start, name, start from f",
    "methods_orphan": f'with {SWIFT} select path, \'main\' || ck as name, (count(*) * 3 + 3)::bigint as start, (count(*) * 3 + 4)::bigint as "end" from f group by path, ck',
    "types": f"with {TYPES} select * from types",
    "type_fields": f"with {TYPES} select path, 'P' || pk as type_name, unnest(['Size', 'Name']) as name, unnest(['int', 'string']) as type, start + unnest([1, 3]) as line from t",
    "type_filter": f"with {TYPES} select * from types where name in ('P1', 'P2', 'K3')",
    "python_types": f"with {SUPPLIERS} select 's/g' || g || '.py' as path, 'S' || sk as name, (['enum', 'abstract', 'NamedTuple', 'class'])[(sk % 4 + 1)::int] as kind, start, start + 3 + (more is null)::int as \"end\" from s",
    "python_fields": f"with {SUPPLIERS} select 's/g' || g || '.py' as path, 'S' || sk as type_name, unnest(['acct', 'name']) as name, unnest(['float', 'str']) as type, start + unnest([1, 2]) as line from s",
    "ts_types": f"with {SUPPLIERS} select 's/g' || g || '.ts' as path, 'I' || sk as name, 'interface' as kind, start, start + 2 as \"end\" from s union all select 's/g' || g || '.ts', 'A' || sk, 'type_alias', start + 3, start + 3 from s",
    "symbols_all": f"with {TYPES} select path, case when kind = 'struct' then 'class' else kind end as kind, name, start, \"end\" from types",
    "extract_bodies": f"with {GO_LINES} select f.path, name, start, end_ as \"end\", string_agg(raw, chr(10) order by line_no) as body from f join golines g on g.path = f.path and line_no between start and end_ group by all",
    "signatures": f"with {SWIFT} select path, name, start, name || '() ' as signature from f union all select path, 'main' || ck, (count(*) * 3 + 3)::bigint, 'main' || ck || '() ' from f group by path, ck",
    "partial_functions": f"with {GO}, c as (select *, case when start < 5 and end_ between 5 and 12 then 'start' when start between 5 and 12 and end_ > 12 then 'end' when start < 5 and end_ > 12 then 'spans' end as cut from f) select path, name, start, end_ as \"end\", cut from c where cut is not null",
    "nesting_tree": f"with {JS} select path, name, start, end_ as \"end\", 'c' || ck as parent, 1::bigint as depth from f union all select path, 'c' || ck, 1, count(*) * 3 + 2, null, 0 from f group by path, ck",
    "tree_summary": f"with {JS} select (count(*) + count(distinct ck))::bigint as functions, (count(*) * 3 + count(*) * 3 + 2 * count(distinct ck))::bigint as total_lines, 2::bigint as max_depth from f",
    "map_json": f"""with {GO} select path, '[' || string_agg('{{"name":"' || name || '","line":' || start || '}}', ',' order by start) || ']' as functions, 0::bigint as n_classes from f group by path""",
    "map_by_name": f'with {GO}, r as (select *, row_number() over (partition by substr(name, 1, 2) order by path desc, start desc) as k from f) select substr(name, 1, 2) as prefix, name, start, end_ as "end" from r where k = 1',
    "map_totals": f"with {GO} select count(distinct path) as total_files, count(*) as total_functions, 0::bigint as total_classes from f",
    "call_freq": f"with {CALLS} select path, name, count(*) as count from calls group by all",
    "call_freq_dir": f"with {CALLS} select name, count(*) as count from calls group by all",
    "top_calls": f"with {CALLS} select name, count(*) as count from calls group by all order by count desc, name limit 10",
    "top_calls_per_file": f"with {CALLS}, c as (select path, name, count(*) as count from calls group by all), r as (select *, row_number() over (partition by path order by count desc, name) as rank from c) select * from r where rank <= 3",
    "unique_calls": f"with {CALLS} select path, count(distinct name) as unique_calls, count(*) as total_calls from calls group by path",
    "call_edges": f"with {EDGES} select * from edges",
    "call_edges_dir": f"with {EDGES} select * from edges",
    "call_edges_aliased": f"with {EDGES} select path, caller, 'pkg/' || callee as callee, line from edges where starts_with(callee, 'lib1.') or starts_with(callee, 'lib2.')",
    "reverse_graph": f"with {EDGES} select callee, count(distinct caller) as n, min(caller) as first from edges group by callee",
    "callers_of": f"with {EDGES} select distinct caller from edges where callee = 'lib1.g1'",
    "graph_totals": f"with {EDGES} select (select count(distinct name) from f) as functions, count(*) as calls, count(distinct path) as files from edges",
    "reachable_n": f"with {ORDERS} select 'f' || ok as node, nth - 1 as hops from fns where nth <= 3 and n_fns > 1",
    "reachable_all": f"with {ORDERS} select 'f' || ok as node, nth - 1 as hops from fns where n_fns > 1",
    "reachable_within": f"with recursive {EDGES}, r(node, hops) as (select 'f1', 0::bigint union select e.callee, r.hops + 1 from r join edges e on e.caller = r.node where r.hops < 5) select node, min(hops) as hops from r group by node",
    "reachable_edges": f"with recursive {EDGES}, r(node, hops) as (select 'f1', 0::bigint union select e.callee, r.hops + 1 from r join edges e on e.caller = r.node where r.hops < 5) select distinct e.caller, e.callee from edges e join r on e.caller = r.node",
    "complexity": f'with {COMPLEX} select path, name, start, end_ as "end", lines_of_code, depth, complexity, level from scored',
    "complexity_top": f"with {COMPLEX} select row_number() over (order by complexity desc, path, start) as rank, path, name, complexity from scored order by complexity desc, path, start limit 10",
    "complexity_filter": f"with {COMPLEX} select path, name, depth from scored where depth >= 4",
    "complexity_levels": f"with {COMPLEX} select level, count(*) as n from scored group by 1",
    "complexity_by_file": f"with {COMPLEX} select path, count(*) as functions, round(avg(complexity), 6) as average, max(complexity) as most from scored group by 1",
    "complexity_project": f"with {COMPLEX}, b as (select path, count(*) as n, max(complexity) as most from scored group by 1) select count(*) as files, sum(n)::bigint as functions, round(avg(most), 6) as average from b",
    "import_list": f"with {PY_IMPORTS} select path, value, row_number() over (partition by path order by place) as nth from imported",
    "import_counts": f"with {PY_IMPORTS} select value as module, case value when 'os' then 'stdlib' when 'numpy' then 'external' else 'internal' end as class, count(*) as count from imported group by all",
    "dependency_classes": f"with {PY_IMPORTS} select case value when 'os' then 'stdlib' when 'numpy' then 'external' else 'internal' end as class, count(*) as imports, count(distinct value) as modules from imported group by 1",
    "import_aliases": f"with {RESOLVED} select path, alias, alias as target from (select path, unnest(['fmt', 'r' || (r + 1) % 5, 'none']) as alias from files)",
    "shard_graph": f"with {RESOLVED} select src, dst from edges",
    "shard_graph_list": f"with {RESOLVED}, n as (select distinct shard from files) select shard, coalesce((select string_agg(dst, ',' order by dst) from edges where src = shard), '') as depends_on, coalesce((select string_agg(src, ',' order by src) from edges where dst = shard), '') as depended_by from n",
    "resolution_stats": "select (2 * count(*))::bigint as resolvable, count(*) as resolved, (2 * count(*) >= 3 and count(*) < 0.4 * count(*)) as warn from nation",
    "shard_names": f"with {DOCS}, k as (select distinct {DIR} as shard from docs) select shard, coalesce(nullif(regexp_replace(regexp_replace(shard, '[/.]', '_', 'g'), '^_+', ''), ''), 'root') || '.json' as file from k",
    "shard_checksum": f"with {DOCS} {_SUM % 'docs'}",
    "shard_changed": f"with {TWO} select shard, case when o.shard is null then 'added' when n.shard is null then 'removed' else 'changed' end as change from old o full join new n using (shard) where o.checksum is distinct from n.checksum",
    "shard_incremental": f"with {TWO} select path from edited where {DIR} in (select n.shard from new n left join old o using (shard) where o.checksum is distinct from n.checksum)",
    "shard_merge": f"with {TWO}, up as (select n.* from new n left join old o using (shard) where o.checksum is distinct from n.checksum) select * from up union all select * from old where shard not in (select shard from up)",
    "shard_manifest": f"with {SWIFT} select {DIR} as shard, count(distinct path) as files, (count(*) + count(distinct path))::bigint as total_functions, count(distinct path)::bigint as total_classes from f group by 1",
    "manifest_depends": f"with {RESOLVED} select shard, count(*) as files, 'r' || ((r + 1) % 5) as depends_on from files group by shard, r",
    "accuracy_counts": f"with {TRUTH} select * from pairs",
    "accuracy_score": f"with {TRUTH} select count(*)::bigint as truth, count(*)::bigint as found, sum(matched)::bigint as matched, round(sum(matched) / count(*), 6) as recall, round(sum(matched) / count(*), 6) as precision from pairs",
    "file_overlap": f"with {GO} select distinct path, case when starts_with(path, 'p1/') then 'found' when starts_with(path, 'p2/') then 'truth' else 'both' end as side from f",
    "token_savings": f"""with {GO_LINES}, raw as (select path, greatest(1, sum(length(raw) + 1)::bigint // 4) as t from golines group by path),
        m as (select path, greatest(1, length(string_agg(name || ': ' || start || '-' || end_, '; ')) // 4) as t from f group by path)
        select (select sum(t) from raw)::bigint as raw_tokens, (select sum(t) from m)::bigint as map_tokens, round(1 - (select sum(t) from m) / (select sum(t) from raw), 6) as saving""",
    "search_term": "select doc_id from documents where list_contains(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), 'the') order by doc_id limit 20",
    "token_index_top": "with t as (select doc_id, unnest(list_distinct(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'))) as term from documents) select term, count(*) as docs from t where term <> '' group by 1 order by docs desc, term limit 20",
    "latency_percentiles": "with v as (select value, row_number() over (order by value) - 1 as k, count(*) over () as n from events where value is not null) select max(n) as n, max(value) filter (k = n * 50 // 100) as p50, max(value) filter (k = n * 99 // 100) as p99, max(value) as most from v",
    "event_lines": f"with {split('events', 'event_id', 'props')} select count(*) as lines, count(*) filter (trim(raw) = '') as blank from kept",
    "conversation_lines": f"with c as (select conv_id || '/' || turn as path, text as content from conversations), {split('c')} select path, count(*) as lines, sum(length(raw))::bigint as chars from kept group by path",
    **{f"symbols_{k}": language_symbols(k) for k in LANGUAGES},
    "types_by_language": " union all ".join(map(_language_types, LANGUAGES)),
    "functions_strict": f"{_strict('java')} union all {_strict('cpp')}",
    "imports_by_language": " union all ".join(f"(select 'p' || (ck % 25) || '/c' || ck || '{v[0]}' as path, '{k}' as lang, 'lib' || (ck % 7) || '{'.h' if k == 'c' else ''}' as value from (select distinct o_custkey as ck from orders))" for k, v in LANGUAGES.items()),
    "scan_union": f"with {DOCS} select path, unnest(case {EXT} when '.go' then ['go'] else ['c', 'cpp'] end) as lang from docs where {VISIBLE} and {EXT} in ('.go', '.h')",
    "text_grep_map": f"with {GO} select path, string_agg(name || ': ' || start || '-' || end_ || ';', ' ' order by start) as text from f group by path",
    "text_json_map": f"""with {PY} select path, '{{' || string_agg('"' || name || '":{{"start":' || start || ',"end":' || end_ || ',"decorators":["@deco' || (ok % 3) || '"]}}', ',' order by name) || '}}' as text from f group by path""",
    "text_extract": f"with {GO_LINES}, b as (select f.path, name, start, '// ' || name || ': ' || start || '-' || end_ || chr(10) || string_agg(raw, chr(10) order by line_no) as body from f join golines g on g.path = f.path and line_no between start and end_ group by f.path, name, start, end_) select path, string_agg(body, chr(10) || chr(10) order by start) as text from b group by path",
    "text_dir_grep": f"with {GO} select path, start, path || ':' || start || ': ' || name as text from f",
    "text_lines": f"""with {PY}, l as (select path, start as line_no, '@deco' || (ok % 3) as raw from f union all select path, start + 1, 'def f' || ok || '(a):' from f union all select path, start + 2, '    y = 0' from f
        union all select path, start + 2 + row_number() over (partition by l_orderkey order by l_linenumber, l_partkey), chr(9) || 'x = ' || l_partkey from f join lineitem on l_orderkey = ok union all select path, start + len - 1, '' from f)
        select path, line_no::bigint as line_no, line_no || ': ' || raw as text, '{{"line":' || line_no || ',"text":"' || replace(raw, chr(9), '\\t') || '"}}' as json from l where line_no between 2 and 5""",
    "text_call_lines": f"with {EDGES} select path, line, caller || ' → ' || callee as text from edges",
    "text_struct_map": f"with {TYPES} select path, string_agg(name || ': ' || start || '-' || \"end\" || ';' || case kind when 'struct' then ' fields: Size, Name' else '' end, chr(10) order by start) as text from types group by path",
    "text_struct_json": f"""with {TYPES} select path, '{{"filename":"' || path || '","types":[' || string_agg({P_JSON} || case when pk % 3 = 0 then ',' || {K_JSON} else '' end, ',' order by start) || ']}}' as text from t group by path""",
    "text_combined_json": f"""with {language('d', *LANGUAGES['d'])}, j as (select path, string_agg('{{"name":"' || name || '","start":' || start || ',"end":' || end_ || '}}', ',' order by start) as fs from f group by path)
        select path, '{{"filename":"' || path || '","functions":[' || fs || '],"types":[' || {D_TYPES} || ']}}' as text from j join k using (path) join t using (path, ck)""",
    "accuracy_repeated": f"with {GO} select path, 'function' as kind, name, 2::bigint as truth, 2::bigint as found, (case when ok % 6 = 0 then 1 else 2 end)::bigint as matched from f",
}
