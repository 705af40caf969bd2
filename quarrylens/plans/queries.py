"""The query catalogue: name -> callable of (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import render
from ..functions import text as T
from ..operators import accuracy, graph, imports, lines, scopes, search, snapshot, stats, symbols
from ..operators.parse import parse, relation
from ..sources.scan import select_files
from . import corpus as C

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
IGNORE = "*.log\nsrc1/\nbuild\n!keep.txt"


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _functions(files: DataFrame, **how) -> DataFrame:
    return relation(parse(files, ("functions",), **how), "functions")


def _go(spark, sf, *want):
    parsed = parse(C.go_files(spark, sf), want)
    return [relation(parsed, w) for w in want]


# --- scans ---------------------------------------------------------------------------------------


@query
def scan_files(spark, sf):
    """Files of known languages, hidden folders left out."""
    return select_files(C.document_files(spark, sf)).select("path", "lang")


@query
def scan_by_ext(spark, sf):
    return select_files(C.document_files(spark, sf), known_only=False).groupBy("ext").agg(F.count("*").alias("files"))


@query
def scan_ignore(spark, sf):
    return select_files(C.document_files(spark, sf), ignore=IGNORE, known_only=False).select("path")


@query
def scan_one_language(spark, sf):
    return select_files(C.document_files(spark, sf), lang="cpp").select("path", "lang")


# --- lines ---------------------------------------------------------------------------------------


@query
def lines_explode(spark, sf):
    return lines.lines(C.document_files(spark, sf))


@query
def lines_range(spark, sf):
    return lines.line_range(lines.lines(C.document_files(spark, sf)), "2:5")


@query
def lines_open_end(spark, sf):
    return lines.line_range(lines.lines(C.document_files(spark, sf)), "10:")


@query
def file_stats(spark, sf):
    """Line classes of each Go file."""
    return lines.line_classes(_go(spark, sf, "clean_lines")[0])


@query
def dir_stats(spark, sf):
    s = lines.line_classes(_go(spark, sf, "clean_lines")[0])
    cols = ("total_lines", "blank_lines", "comment_lines", "code_lines")
    total = s.groupBy(T.dir_name(F.col("path")).alias("dir")).agg(*[F.sum(c).alias(c) for c in cols], F.count("*").alias("files"))
    return total.withColumn("code_percent", F.round(100 * F.col("code_lines") / F.col("total_lines"), 6))


@query
def file_size_kb(spark, sf):
    return C.document_files(spark, sf).select("path", F.round(F.octet_length(F.coalesce("content", F.lit(""))) / 1024, 6).alias("kb"))


@query
def brace_depth(spark, sf):
    return lines.running_depth(lines.lines(C.page_files(spark, sf))).select("path", "line_no", "delta", "depth", "before")


@query
def indent_levels(spark, sf):
    of = lines.lines(C.python_files(spark, sf))
    return of.select("path", "line_no", T.indent_level(F.col("raw")).alias("indent"), T.indent_level(F.col("raw"), 8).alias("leading_spaces"), lines.is_empty_or_comment(F.col("raw"), "#").alias("idle"))


@query
def sanitize_lines(spark, sf):
    return _go(spark, sf, "clean_lines")[0].select("path", "line_no", "clean", "state")


# --- functions, classes, types ----------------------------------------------------------------------


@query
def function_map(spark, sf):
    return _functions(C.go_files(spark, sf)).select("path", "name", "start", "end")


@query
def function_map_window(spark, sf):
    """Go functions without Python: headers by pattern, ends by the running depth, one window a file."""
    return symbols.functions_by_window(lines.lines(C.go_files(spark, sf).withColumn("content", F.regexp_replace("content", r"//[^\n]*", "")))).select("path", "name", "start", "end")


@query
def function_map_rust(spark, sf):
    """One open function at a time: the same text as Rust, headers rewritten."""
    files = C.go_files(spark, sf).withColumns({"content": F.regexp_replace("content", r"(?m)^func ", "fn "), "lang": F.lit("rust")})
    return _functions(files).select("path", "name", "start", "end")


@query
def function_filter(spark, sf):
    """Selected names open intervals, others do not."""
    return _functions(C.go_files(spark, sf), names=["f1", "f2", "f3", "f7", "f32"]).select("path", "name", "start", "end")


@query
def python_functions(spark, sf):
    return _functions(C.python_files(spark, sf)).select("path", "name", "start", "end", F.array_join("decorators", ",").alias("decorators"))


@query
def python_scopes(spark, sf):
    return relation(parse(C.python_files(spark, sf), ("scopes",)), "scopes").select("path", "name", "kind", "start", "end")


@query
def scope_snap(spark, sf):
    return scopes.snap_ranges(relation(parse(C.python_files(spark, sf), ("scopes",)), "scopes"), 3, 9)


@query
def range_filter_python(spark, sf):
    parsed = parse(C.python_files(spark, sf), ("scopes", "functions"))
    return scopes.functions_in_range(relation(parsed, "functions"), relation(parsed, "scopes"), "3:9").select("path", "name", "start", "end")


@query
def decorators(spark, sf):
    return stats.distinct_matches(lines.lines(C.python_files(spark, sf)), "py", "decorators")


@query
def class_map(spark, sf):
    return relation(parse(C.swift_files(spark, sf), ("classes",)), "classes").select("path", "name", "start", "end")


@query
def class_methods(spark, sf):
    parsed = parse(C.swift_files(spark, sf), ("functions", "classes"))
    return symbols.methods(relation(parsed, "functions"), relation(parsed, "classes"))


@query
def methods_orphan(spark, sf):
    return symbols.orphans(_functions(C.swift_files(spark, sf))).select("path", "name", "start", "end")


@query
def types(spark, sf):
    return relation(parse(C.type_files(spark, sf), ("types",)), "types").select("path", "name", "kind", "start", "end")


@query
def type_fields(spark, sf):
    return relation(parse(C.type_files(spark, sf), ("fields",)), "fields").select("path", "type_name", "name", "type", "line")


@query
def type_filter(spark, sf):
    return relation(parse(C.type_files(spark, sf), ("types",), names=["P1", "P2", "K3"]), "types").select("path", "name", "kind", "start", "end")


@query
def python_types(spark, sf):
    return relation(parse(C.supplier_files(spark, sf, ".py"), ("types",)), "types").select("path", "name", "kind", "start", "end")


@query
def python_fields(spark, sf):
    return relation(parse(C.supplier_files(spark, sf, ".py"), ("fields",)), "fields").select("path", "type_name", "name", "type", "line")


@query
def ts_types(spark, sf):
    return relation(parse(C.supplier_files(spark, sf, ".ts"), ("types",)), "types").select("path", "name", "kind", "start", "end")


@query
def symbols_all(spark, sf):
    """Functions, classes, and types that are not among the classes."""
    return symbols.file_symbols(C.type_files(spark, sf))


@query
def extract_bodies(spark, sf):
    files = C.go_files(spark, sf)
    return symbols.bodies(_functions(files), lines.lines(files))


@query
def signatures(spark, sf):
    return relation(parse(C.swift_files(spark, sf), ("signatures",)), "signatures").select("path", "name", "start", "signature")


@query
def partial_functions(spark, sf):
    parsed = parse(C.go_files(spark, sf), ("functions", "clean_lines"))
    return lines.partial_functions(relation(parsed, "functions"), "5:12", relation(parsed, "clean_lines").groupBy("path").agg(F.count("*").alias("total_lines")))


@query
def nesting_tree(spark, sf):
    return graph.nesting(_functions(C.js_files(spark, sf)))


@query
def tree_summary(spark, sf):
    f = _functions(C.js_files(spark, sf))
    return symbols.tree_summary(f, graph.nesting(f))


@query
def map_json(spark, sf):
    f, c = _go(spark, sf, "functions", "classes")
    return symbols.file_maps(f, c).select("path", F.to_json("functions").alias("functions"), F.size("classes").cast("bigint").alias("n_classes"))


@query
def map_by_name(spark, sf):
    """The last function of each name, over all files in path order."""
    f = _functions(C.go_files(spark, sf))
    return f.groupBy(F.substring("name", 1, 2).alias("prefix")).agg(F.max_by(F.struct("name", "start", "end"), F.struct("path", "start")).alias("x")).select("prefix", "x.name", "x.start", "x.end")


@query
def map_totals(spark, sf):
    f, c = _go(spark, sf, "functions", "classes")
    m = symbols.file_maps(f, c)
    return m.agg(F.count("*").alias("total_files"), F.sum(F.size("functions")).alias("total_functions"), F.sum(F.size("classes")).alias("total_classes"))


# --- the other languages ----------------------------------------------------------------------------


def _language_symbols(lang: str) -> Query:
    def run(spark, sf):
        return symbols.file_symbols(C.language_files(spark, sf, lang))

    run.__name__ = f"symbols_{lang}"
    run.__doc__ = f"Functions, classes and types of {lang} files; functions have the name that the last group of their header gives."
    return run


for _lang in C.FORMS:
    query(_language_symbols(_lang))


@query
def types_by_language(spark, sf):
    return relation(parse(C.all_language_files(spark, sf), ("types",)), "types").select("path", "lang", "name", "kind", "start", "end")


@query
def functions_strict(spark, sf):
    """Java and C++ functions by their bare names, with the class that holds them."""
    files = C.language_files(spark, sf, "java").union(C.language_files(spark, sf, "cpp"))
    return _functions(files, strict=True).select("path", "name", "start", "end", "class_name")


@query
def imports_by_language(spark, sf):
    found = [stats.distinct_matches(lines.lines(C.language_files(spark, sf, k)), k).select("path", F.lit(k).alias("lang"), "value") for k in C.FORMS]
    return reduce(DataFrame.union, found)


@query
def scan_union(spark, sf):
    """Scans of one language each, together; a header file counts as C and as C++."""
    files = C.document_files(spark, sf)
    return reduce(DataFrame.unionByName, [select_files(files, lang=k).select("path", "lang") for k in ("c", "cpp", "go")]).distinct()


# --- text forms -----------------------------------------------------------------------------------


@query
def text_grep_map(spark, sf):
    return render.grep_map(_functions(C.go_files(spark, sf)))


@query
def text_json_map(spark, sf):
    return render.json_map(_functions(C.python_files(spark, sf)))


@query
def text_extract(spark, sf):
    return render.extract(extract_bodies(spark, sf))


@query
def text_dir_grep(spark, sf):
    return render.dir_grep(_functions(C.go_files(spark, sf)))


@query
def text_lines(spark, sf):
    """Lines two to five in plain form and as JSON."""
    own = lines.line_range(lines.lines(C.python_files(spark, sf)), "2:5")
    return render.plain_lines(own).join(render.json_lines(own).withColumnRenamed("text", "json"), ["path", "line_no"])


@query
def text_call_lines(spark, sf):
    return render.call_lines(_edges(spark, sf))


def _typed(spark, sf):
    parsed = parse(C.type_files(spark, sf), ("types", "fields", "functions"))
    return [relation(parsed, w) for w in ("types", "fields", "functions")]


@query
def text_struct_map(spark, sf):
    return render.struct_map(*_typed(spark, sf)[:2])


@query
def text_struct_json(spark, sf):
    return render.struct_json(*_typed(spark, sf)[:2])


@query
def text_combined_json(spark, sf):
    parsed = parse(C.language_files(spark, sf, "d"), ("functions", "types", "fields"))
    return render.combined_json(*[relation(parsed, w) for w in ("functions", "types", "fields")])


# --- calls and graphs ---------------------------------------------------------------------------------


def _calls(spark, sf):
    """(path, name, count)"""
    return relation(parse(C.call_files(spark, sf), ("call_names",)), "call_names").select("path", "name", "count")


@query
def call_freq(spark, sf):
    return _calls(spark, sf)


@query
def call_freq_dir(spark, sf):
    return _calls(spark, sf).groupBy("name").agg(F.sum("count").alias("count"))


@query
def top_calls(spark, sf):
    return stats.top_calls(call_freq_dir(spark, sf), 10)


@query
def top_calls_per_file(spark, sf):
    return stats.top_calls(call_freq(spark, sf), 3, "path")


@query
def unique_calls(spark, sf):
    return call_freq(spark, sf).groupBy("path").agg(F.count("*").alias("unique_calls"), F.sum("count").alias("total_calls"))


def _js():
    from ..languages import PROFILES

    return PROFILES["js"].exclude


def _edges(spark, sf, scope="dir", keep=None):
    return graph.file_edges(C.go_files(spark, sf), scope=scope, keep=keep)


@query
def call_edges(spark, sf):
    return _edges(spark, sf, "file")


@query
def call_edges_dir(spark, sf):
    return _edges(spark, sf)


@query
def call_edges_aliased(spark, sf):
    """Receivers by the packages they stand for."""
    names = C.go_files(spark, sf).select("path", F.explode(F.array(F.lit("lib1"), F.lit("lib2"))).alias("alias")).withColumn("target", F.concat(F.lit("pkg/"), "alias"))
    return graph.file_edges(C.go_files(spark, sf), names, keep=lambda callee: callee.startswith("pkg/"))


@query
def reverse_graph(spark, sf):
    return graph.reverse(_edges(spark, sf)).select("callee", F.size("callers").cast("bigint").alias("n"), F.get("callers", F.lit(0)).alias("first"))


@query
def callers_of(spark, sf):
    return graph.callers_of(_edges(spark, sf, keep=lambda callee: callee == "lib1.g1"), "lib1.g1")


@query
def graph_totals(spark, sf):
    return graph.totals(graph.file_marks(C.go_files(spark, sf)))


def _bare(spark, sf):
    """The edges without those to receivers."""
    return _edges(spark, sf, keep=lambda callee: ~callee.contains("."))


@query
def reachable_n(spark, sf):
    """All that functions without callers reach in two hops."""
    e = graph.steps(_bare(spark, sf))
    return graph.walk(e, graph.roots(e), 2)


@query
def reachable_all(spark, sf):
    e = graph.steps(_bare(spark, sf))
    return graph.walk(e, graph.roots(e))


@query
def reachable_within(spark, sf):
    """What one function reaches in five hops."""
    return graph.reachable_within(_edges(spark, sf), "f1", 5)


# --- complexity -----------------------------------------------------------------------------------


def _complexity(spark, sf):
    return stats.complexity(relation(parse(C.nested_files(spark, sf), ("complexity",)), "complexity"))


@query
def complexity(spark, sf):
    return _complexity(spark, sf).select("path", "name", "start", "end", "lines_of_code", "depth", "complexity", "level")


@query
def complexity_top(spark, sf):
    return stats.complexity_top(_complexity(spark, sf)).select("rank", "path", "name", "complexity")


@query
def complexity_filter(spark, sf):
    return stats.complexity_filter(_complexity(spark, sf), 4, True).select("path", "name", "depth")


@query
def complexity_levels(spark, sf):
    return stats.complexity_levels(_complexity(spark, sf))


@query
def complexity_by_file(spark, sf):
    return stats.complexity_by_file(_complexity(spark, sf)).withColumn("average", F.round("average", 6))


@query
def complexity_project(spark, sf):
    return stats.complexity_project(_complexity(spark, sf)).withColumn("average", F.round("average", 6))


# --- imports and shards --------------------------------------------------------------------------------


@query
def import_list(spark, sf):
    return stats.distinct_matches(lines.lines(C.import_files(spark, sf, "py")), "py")


@query
def import_counts(spark, sf):
    files = C.import_files(spark, sf, "py")
    return imports.import_counts(stats.distinct_matches(lines.lines(files), "py"), files, "py")


@query
def dependency_classes(spark, sf):
    return import_counts(spark, sf).groupBy("class").agg(F.sum("count").alias("imports"), F.count("*").alias("modules"))


@query
def import_aliases(spark, sf):
    return imports.aliases(stats.distinct_matches(lines.lines(C.import_files(spark, sf, "go")), "go"))


def _resolved(spark, sf):
    files = C.import_files(spark, sf, "go")
    return imports.resolve(stats.distinct_matches(lines.lines(files), "go"), files, "mod"), files


@query
def shard_graph(spark, sf):
    return imports.shard_edges(_resolved(spark, sf)[0])


@query
def shard_graph_list(spark, sf):
    r, files = _resolved(spark, sf)
    return imports.shard_listing(imports.shard_edges(r), files).select("shard", F.array_join("depends_on", ",").alias("depends_on"), F.array_join("depended_by", ",").alias("depended_by"))


@query
def resolution_stats(spark, sf):
    return imports.resolution(_resolved(spark, sf)[0])


@query
def shard_names(spark, sf):
    key = T.shard_key(F.col("path"))
    return C.document_files(spark, sf).select(key.alias("shard")).distinct().select("shard", T.shard_name(F.col("shard")).alias("file"))


@query
def shard_checksum(spark, sf):
    return snapshot.shard_checksums(C.document_files(spark, sf))


def _edited(files: DataFrame) -> DataFrame:
    """The tree later on: a file in seven has another line, one source is gone, another is new."""
    n = F.regexp_extract("path", r"/d(\d+)\.", 1).cast("bigint")
    edited = files.withColumn("content", F.when(n % 7 == 0, F.concat(F.coalesce("content", F.lit("")), F.lit("\nmore"))).otherwise(F.col("content")))
    path = F.regexp_replace("path", "^src4/", "src99/")
    return edited.where(~F.col("path").startswith("src3/")).withColumn("path", path)


@query
def shard_changed(spark, sf):
    old = C.document_files(spark, sf)
    return snapshot.changed_shards(snapshot.shard_checksums(old), snapshot.shard_checksums(_edited(old)))


@query
def shard_incremental(spark, sf):
    """Files that have to be parsed again."""
    old = C.document_files(spark, sf)
    return snapshot.incremental(_edited(old), snapshot.shard_checksums(old)).select("path")


@query
def shard_merge(spark, sf):
    """The old manifest with changed shards replaced; gone shards stay, as the tool it follows has it."""
    old = C.document_files(spark, sf)
    before, now = snapshot.shard_checksums(old), snapshot.shard_checksums(_edited(old))
    updated = now.join(before.select("shard", "checksum"), ["shard", "checksum"], "left_anti").select("shard", "files", "checksum")
    return snapshot.merge_manifest(before, updated)


@query
def shard_manifest(spark, sf):
    files = C.swift_files(spark, sf)
    parsed = parse(files, ("functions", "classes"))
    return snapshot.manifest(files, relation(parsed, "functions"), relation(parsed, "classes")).select("shard", "files", "total_functions", "total_classes")


@query
def manifest_depends(spark, sf):
    r, files = _resolved(spark, sf)
    rows = snapshot.shard_checksums(files)
    return snapshot.with_depends_on(rows, imports.shard_edges(r)).select("shard", "files", F.array_join("depends_on", ",").alias("depends_on"))


@query
def reachable_edges(spark, sf):
    """The calls of what one function reaches in five hops."""
    e = graph.steps(_edges(spark, sf))
    return graph.edges_of(e, graph.walk(e, spark.createDataFrame([("f1",)], "node string"), 5))


# --- accuracy, tokens, search ------------------------------------------------------------------------


def _sides(spark, sf):
    """Truth and found as rows of one table, from one reading."""
    f = _functions(C.go_files(spark, sf))
    shift = F.substring("name", 2, 20).cast("bigint") % 4
    both = F.array(F.struct(F.lit(True).alias("is_truth"), F.col("start").alias("line")), F.struct(F.lit(False).alias("is_truth"), (F.col("start") + shift).alias("line")))
    return f.select("path", F.lit("function").alias("kind"), "name", F.inline(both))


def _scored(spark, sf):
    truth = _functions(C.go_files(spark, sf)).select("path", F.lit("function").alias("kind"), "name", F.col("start").alias("line"))
    key = F.substring("name", 2, 20).cast("bigint")
    found = truth.withColumn("line", F.col("line") + key % 4)
    return truth, found


@query
def accuracy_counts(spark, sf):
    return accuracy.match_sides(_sides(spark, sf))


@query
def accuracy_score(spark, sf):
    s = accuracy.score(accuracy.match_sides(_sides(spark, sf)))
    return s.withColumns({c: F.round(c, 6) for c in ("recall", "precision")})


@query
def accuracy_repeated(spark, sf):
    """Two lines of a name on either side, so that a pairing may take what another line needed."""
    f = _functions(C.go_files(spark, sf))
    key = F.substring("name", 2, 20).cast("bigint")
    row = lambda truth, a: F.struct(F.lit(truth).alias("is_truth"), (F.col("start") + a).alias("line"))
    lines_ = F.array(row(True, 0), row(True, 2), row(False, 1), row(False, key % 6 - 2))
    return accuracy.match_sides(f.select("path", F.lit("function").alias("kind"), "name", F.inline(lines_)))


@query
def file_overlap(spark, sf):
    truth, found = _scored(spark, sf)
    return accuracy.file_overlap(truth.where(~F.col("path").startswith("p1/")), found.where(~F.col("path").startswith("p2/")))


@query
def token_savings(spark, sf):
    files = C.go_files(spark, sf)
    f = _functions(files)
    maps = f.groupBy("path").agg(F.array_join(F.array_sort(F.collect_list(F.concat("name", F.lit(": "), "start", F.lit("-"), "end"))), "; ").alias("map"))
    return accuracy.token_savings(files, maps).withColumn("saving", F.round("saving", 6))


@query
def search_term(spark, sf):
    return search.search(C.table(spark, sf, "documents"), "the", "doc_id", "text")


@query
def token_index_top(spark, sf):
    """Documents by term, the twenty most frequent."""
    i = search.token_index(C.table(spark, sf, "documents"), "doc_id", "text")
    return i.groupBy("term").agg(F.count("*").alias("docs")).orderBy(F.col("docs").desc(), "term").limit(20)


@query
def latency_percentiles(spark, sf):
    return accuracy.latency_percentiles(C.table(spark, sf, "events"))


@query
def event_lines(spark, sf):
    of = C.table(spark, sf, "events").select(F.col("event_id").cast("string").alias("path"), F.col("props").alias("content"))
    return lines.lines(of).agg(F.count("*").alias("lines"), F.count_if(lines.is_blank(F.col("raw"))).alias("blank"))


@query
def conversation_lines(spark, sf):
    of = C.table(spark, sf, "conversations").select(F.concat("conv_id", F.lit("/"), "turn").alias("path"), F.col("text").alias("content"))
    return lines.lines(of).groupBy("path").agg(F.count("*").alias("lines"), F.sum(F.length("raw")).alias("chars"))
