"""Text and JSON forms of results: a string per file as a column, and trees and reports from a file's or a report's few rows."""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _joined(df: DataFrame, line: Column, sep: str, out: str = "text") -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("start", "name", line.alias("line"))))
    return df.groupBy("path").agg(F.array_join(F.transform(rows, lambda r: r["line"]), sep).alias(out))


def grep_map(functions: DataFrame) -> DataFrame:
    """(path, text): ``Name: s-e; Name: s-e;``"""
    return _joined(functions, F.format_string("%s: %d-%d;", "name", "start", "end"), " ")


def json_map(functions: DataFrame) -> DataFrame:
    """(path, text): an object by name, sorted; of several functions of a name the last counts."""
    value = F.struct("start", "end", F.when(F.size("decorators") > 0, F.col("decorators")).alias("decorators"))
    last = functions.groupBy("path", "name").agg(F.max_by(value, "start").alias("v"))
    pairs = F.array_sort(F.collect_list(F.struct("name", "v")))
    return last.groupBy("path").agg(F.to_json(F.map_from_entries(pairs)).alias("text"))


def extract(bodies: DataFrame) -> DataFrame:
    """(path, text): ``// Name: s-e`` and the body of each function, a blank line between."""
    return _joined(bodies, F.concat(F.format_string("// %s: %d-%d\n", "name", "start", "end"), F.col("body")), "\n\n")


def struct_map(types: DataFrame, fields: DataFrame) -> DataFrame:
    """(path, text): ``Name: s-e; fields: a, b`` a line each."""
    names = fields.groupBy("path", F.col("type_name").alias("name")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", F.col("name").alias("f")))), lambda x: x["f"]), ", ").alias("fields"))
    both = types.join(names, ["path", "name"], "left")
    return _joined(both, F.concat(F.format_string("%s: %d-%d;", "name", "start", "end"), F.coalesce(F.concat(F.lit(" fields: "), "fields"), F.lit(""))), "\n")


def struct_extract(types: DataFrame) -> DataFrame:
    """(path, text) of types with a ``body`` column: ``=== Name (kind) ===`` and the body."""
    return _joined(types, F.concat(F.format_string("=== %s (%s) ===\n", "name", "kind"), F.col("body")), "\n\n")


def dir_grep(functions: DataFrame) -> DataFrame:
    """(path, start, text): ``path:line: name``"""
    return functions.select("path", "start", F.format_string("%s:%d: %s", "path", "start", "name").alias("text"))


def plain_lines(lines: DataFrame) -> DataFrame:
    return lines.select("path", "line_no", F.format_string("%d: %s", "line_no", "raw").alias("text"))


def json_lines(lines: DataFrame) -> DataFrame:
    return lines.select("path", "line_no", F.to_json(F.struct(F.col("line_no").alias("line"), F.col("raw").alias("text"))).alias("text"))


def _types_with_fields(types: DataFrame, fields: DataFrame, bare: Column | None) -> DataFrame:
    """(path, types): a file's types by start, each with the fields on its own lines; without any, ``bare`` stands for them."""
    own = fields.groupBy("path", F.col("type_name").alias("name")).agg(F.array_sort(F.collect_list(F.struct("line", F.col("name").alias("field"), "type"))).alias("all"))
    inside = F.filter("all", lambda x: x["line"].between(F.col("start"), F.col("end")))
    told = F.transform(inside, lambda x: F.struct(x["field"].alias("name"), x["type"].alias("type"), x["line"].alias("line")))
    one = types.join(own, ["path", "name"], "left").withColumn("fields", F.when(F.size("all") > 0, told))
    one = one.withColumn("fields", F.when(F.size("fields") > 0, F.col("fields")).otherwise(bare) if bare is not None else F.when(F.size("fields") > 0, F.col("fields")))
    rows = F.array_sort(F.collect_list(F.struct("start", "end", "name", "kind", "fields")))
    return one.groupBy("path").agg(F.transform(rows, lambda t: F.struct(t["name"].alias("name"), t["kind"].alias("kind"), t["start"].alias("start"), t["end"].alias("end"), t["fields"].alias("fields"))).alias("types"))


def struct_json(types: DataFrame, fields: DataFrame) -> DataFrame:
    """(path, text): file name and types with their fields as one object; types without fields have no such key."""
    return _types_with_fields(types, fields, None).select("path", F.to_json(F.struct(F.col("path").alias("filename"), "types")).alias("text"))


def combined_json(functions: DataFrame, types: DataFrame, fields: DataFrame) -> DataFrame:
    """(path, text): file name, functions and types with their fields as one object; what is missing is an empty list."""
    none = F.array().cast("array<struct<name:string,type:string,line:bigint>>")
    f = functions.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("start", "end", "name"))), lambda x: F.struct(x["name"].alias("name"), x["start"].alias("start"), x["end"].alias("end"))).alias("functions"))
    both = f.join(_types_with_fields(types, fields, none), "path", "full_outer")
    return both.select("path", F.to_json(F.struct(F.col("path").alias("filename"), *[F.coalesce(c, F.array().cast(dict(both.dtypes)[c])).alias(c) for c in ("functions", "types")])).alias("text"))


def call_lines(edges: DataFrame) -> DataFrame:
    return edges.select("path", "line", F.concat("caller", F.lit(" → "), "callee").alias("text"))


# Below: from rows that the caller has collected, one file's or one report's.


def _levels(rows: Iterable) -> list[tuple]:
    """Rows in order, each with how many others hold it."""
    out, above = [], []
    for r in sorted(rows, key=lambda r: (r["start"], -r["end"])):
        while above and above[-1] < r["end"]:
            above.pop()
        out.append((r, len(above)))
        above.append(r["end"])
    return out


def tree(rows: Iterable, full: bool = False, classes: Iterable = ()) -> str:
    """Functions of a file, each under the innermost one that holds it. Rows have name, start, end, class_name and, for ``full``, signature.

    ``classes`` (name, start, end) come first, each above its methods; functions without a class follow.
    """
    rows = list(rows)
    classes = sorted(classes, key=lambda c: c["start"])
    items = []
    for c in classes:
        items.append(("class ", c["name"], c, 0))
        items += [("method ", full and r["signature"] or r["name"], r, level + 1) for r, level in _levels(r for r in rows if r["class_name"] == c["name"])]
    rest = [r for r in rows if not r["class_name"]] if classes else rows
    items += [("method " if r["class_name"] else "", full and r["signature"] or r["name"], r, level) for r, level in _levels(rest)]
    # whether a sibling follows, from the end: a shallower row closes the levels below it
    out, follows = [], set()
    for kind, label, r, level in reversed(items):
        bars = "".join("│   " if k in follows else "    " for k in range(level))
        out.append(f"{bars}{'├── ' if level in follows else '└── '}{kind}{label} ({r['start']}-{r['end']})")
        follows = {k for k in follows if k < level} | {level}
    return "\n".join(out[::-1])


def type_tree(types: Iterable, fields: Iterable) -> str:
    own = defaultdict(list)
    for f in fields:
        own[f["type_name"]].append(f)
    out = []
    for t in sorted(types, key=lambda t: t["start"]):
        out.append(f"{t['name']} [{t['kind']}] ({t['start']}-{t['end']})")
        mine = own[t["name"]]
        out += [f"{'└── ' if f is mine[-1] else '├── '}{f['name']} {f['type']}".rstrip() for f in mine]
    return "\n".join(out)


def call_tree(edges: Iterable, root: str, depth: int = 0) -> str:
    """What ``root`` calls, indented; a function that is already above is marked and not followed."""
    calls = defaultdict(list)
    for e in sorted(edges, key=lambda e: (e["caller"], e["callee"])):
        calls[e["caller"]].append(e["callee"])
    out, todo = [], [(root, ())]
    while todo:
        name, above = todo.pop()
        again = name in above
        out.append("  " * len(above) + name + (" (↑ recursive)" if again else ""))
        if not again and (not depth or len(above) < depth):
            todo += [(c, (*above, name)) for c in reversed(calls[name])]
    return "\n".join(out)


def stat_text(stat: dict, top: Iterable = ()) -> str:
    total = max(1, stat["total_lines"])
    out = [f"Lines: {stat['total_lines']}"]
    out += [f"  {k}: {stat[f'{k}_lines']} ({100 * stat[f'{k}_lines'] / total:.1f}%)" for k in ("code", "comment", "blank")]
    return "\n".join([*out, *(f"{r['name']}: {r['count']}" for r in top)])


def level_bars(levels: dict[str, int]) -> str:
    """A bar of up to twenty marks for each complexity level."""
    total = max(1, sum(levels.values()))
    return "\n".join(f"{k:<10} {'█' * (n * 20 // total)} {n}" for k, n in levels.items())


def complexity_text(rows: Iterable) -> str:
    return "\n".join(f"#{i} {r['name']} {r['path']}:{r['start']} complexity {r['complexity']} ({r['level']})" for i, r in enumerate(rows, 1))


def adjustment_report(path: str, asked: tuple[int, int], row) -> str:
    """A box that says how a line range was changed, empty if it was not."""
    if not row["reason"]:
        return ""
    lines = [path, f"asked: {asked[0]}-{asked[1]}", f"used:  {row['start']}-{row['end']}", row["reason"]]
    width = max(map(len, lines))
    return "\n".join(["+" + "-" * (width + 2) + "+", *(f"| {x:<{width}} |" for x in lines), "+" + "-" * (width + 2) + "+"])


def dir_tree(paths: Iterable[str]) -> str:
    """Folders and files, children indented under their folder, sorted."""
    root: dict = {}
    for p in sorted(paths):
        at = root
        for part in p.split("/"):
            at = at.setdefault(part, {})

    def walk(node: dict, pad: str) -> list[str]:
        out = []
        for i, (name, kids) in enumerate(node.items()):
            last = i == len(node) - 1
            out.append(f"{pad}{'└── ' if last else '├── '}{name}")
            out += walk(kids, pad + ("    " if last else "│   "))
        return out

    return "\n".join(walk(root, ""))


def manifest_json(rows: Iterable, root: str, split_by: str = "dir") -> str:
    shards = sorted((dict(r.asDict()) for r in rows), key=lambda r: r["shard"])
    return json.dumps({"version": "1.0", "root_dir": root, "split_by": split_by, "shards": shards}, indent=2)
