"""Source text derived from the relational tables, with spans known from the rows.

Files are per customer, part group or supplier, so their number grows with the data and their size does not.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scan import language_of

PARTS_PER_FILE = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_lang(files: DataFrame) -> DataFrame:
    return files.withColumn("lang", language_of(F.col("path")))


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): documents as files of several kinds, one in ten of them in a hidden folder."""
    ext = F.element_at(F.array(*[F.lit(e) for e in (".go", ".py", ".js", ".h", ".txt", ".log")]), (F.col("doc_id") % 6 + 1).cast("int"))
    path = F.concat(F.when(F.col("doc_id") % 10 == 7, ".cache/").otherwise(""), "source", F.lit("/"), "lang", F.lit("/d"), "doc_id", ext)
    return table(spark, sf_dir, "documents").select(path.alias("path"), F.col("text").alias("content"))


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), "page_id", F.lit(".js")).alias("path"), F.col("html").alias("content"))


def orders_with_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ok, ck, items): orders with their lines' (number, part) in order."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("items"))
    empty = F.array().cast("array<struct<l_linenumber:int,l_partkey:bigint>>")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ok"), F.col("o_custkey").alias("ck"))
    return o.join(items, F.col("ok") == F.col("l_orderkey"), "left").select("ok", "ck", F.coalesce("items", empty).alias("items"))


def by_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ck, orders): a customer's orders (ok, items) by key."""
    return orders_with_items(spark, sf_dir).groupBy("ck").agg(F.array_sort(F.collect_list(F.struct("ok", "items"))).alias("orders"))


def _path(ext: str):
    return F.concat(F.lit("p"), F.col("ck") % 25, F.lit("/c"), "ck", F.lit(ext))


def go_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function per order: a comment, a call on a receiver per line item, and a call of the customer's next order."""
    item = lambda x: F.concat(F.lit("\tlib"), x["l_partkey"] % 5, F.lit(".g"), x["l_linenumber"], F.lit("("), x["l_partkey"], F.lit(")\n"))

    def one(x, i):
        follow = F.get("orders", i + 1)["ok"]
        call = F.when(follow.isNotNull(), F.concat(F.lit("\tf"), follow, F.lit("()\n"))).otherwise("")
        return F.concat(F.lit("func f"), x["ok"], F.lit("() {\n\t// order "), x["ok"], F.lit("\n"), F.array_join(F.transform(x["items"], item), ""), call, F.lit("}\n\n"))

    text = F.concat(F.lit("package p"), F.col("ck") % 25, F.lit("\n\n"), F.array_join(F.transform("orders", one), ""))
    return with_lang(by_customer(spark, sf_dir).select(_path(".go").alias("path"), text.alias("content")))


def call_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function per order with a call per line item, and what only looks like calls in a comment, a string and a condition."""
    item = lambda x: F.concat(F.lit("\tlib"), x["l_partkey"] % 5, F.lit(".g"), x["l_linenumber"], F.lit("("), x["l_partkey"], F.lit(") // not done(1)\n"))
    head = F.lit('() {\n\t// see note(2)\n\ts := "text(3) of it"\n\t/* gone(4)\n\tlong(5) */\n\tif (s) {\n\t}\n')
    one = lambda x: F.concat(F.lit("func f"), x["ok"], head, F.array_join(F.transform(x["items"], item), ""), F.lit("}\n\n"))
    return with_lang(by_customer(spark, sf_dir).select(_path(".go").alias("path"), F.array_join(F.transform("orders", one), "").alias("content")))


def python_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decorated function per order with a statement per line item."""
    one = lambda x: F.concat(F.lit("@deco"), x["ok"] % 3, F.lit("\ndef f"), x["ok"], F.lit("(a):\n    y = 0\n"), F.array_join(F.transform(x["items"], lambda i: F.concat(F.lit("\tx = "), i["l_partkey"], F.lit("\n"))), ""), F.lit("\n"))
    return with_lang(by_customer(spark, sf_dir).select(_path(".py").alias("path"), F.array_join(F.transform("orders", one), "").alias("content")))


def swift_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A class per customer with a method per order, and a function beside it."""
    one = lambda x: F.concat(F.lit("    func f"), x["ok"], F.lit("() {\n        run()\n    }\n"))
    text = F.concat(F.lit("class C"), "ck", F.lit(" {\n"), F.array_join(F.transform("orders", one), ""), F.lit("}\nfunc main"), "ck", F.lit("() {\n}\n"))
    return with_lang(by_customer(spark, sf_dir).select(_path(".swift").alias("path"), text.alias("content")))


def js_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function per customer that holds one per order."""
    one = lambda x: F.concat(F.lit("  function f"), x["ok"], F.lit("() {\n    return 1;\n  }\n"))
    text = F.concat(F.lit("function c"), "ck", F.lit("() {\n"), F.array_join(F.transform("orders", one), ""), F.lit("}\n"))
    return with_lang(by_customer(spark, sf_dir).select(_path(".js").alias("path"), text.alias("content")))


def nested_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function per order, with as many nested ifs as the order has lines."""
    one = lambda x: F.concat(F.lit("func f"), x["ok"], F.lit("() {\n"), F.array_join(F.transform(x["items"], lambda i: F.lit("if a {\n")), ""), F.array_join(F.transform(x["items"], lambda i: F.lit("}\n")), ""), F.lit("}\n"))
    return with_lang(by_customer(spark, sf_dir).select(_path(".go").alias("path"), F.array_join(F.transform("orders", one), "").alias("content")))


def type_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Go struct per part, with two fields and a method that is no field; every third part also has a named type."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pk"))
    one = F.concat(F.lit("type P"), "pk", F.lit(" struct {\n\tSize int\n\t// none\n\tName string\n\tRun(x int) string\n}\n"), F.when(F.col("pk") % 3 == 0, F.concat(F.lit("type K"), "pk", F.lit(" int\n"))).otherwise(""))
    per = part.select(F.floor(F.col("pk") / PARTS_PER_FILE).alias("g"), "pk", one.alias("t")).groupBy("g").agg(F.array_sort(F.collect_list(F.struct("pk", "t"))).alias("all"))
    return with_lang(per.select(F.concat(F.lit("t/g"), "g", F.lit(".go")).alias("path"), F.array_join(F.transform("all", lambda x: x["t"]), "").alias("content")))


def supplier_files(spark: SparkSession, sf_dir: str, ext: str) -> DataFrame:
    """A Python class or a pair of TypeScript types per supplier, fifty to a file."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sk"))
    base = F.element_at(F.array(*[F.lit(b) for b in ("(Enum)", "(ABC)", "(NamedTuple)", "")]), (F.col("sk") % 4 + 1).cast("int"))
    py = F.concat(F.lit("class S"), "sk", base, F.lit(":\n    acct: float = 1\n    name: str\n\n"))
    ts = F.concat(F.lit("export interface I"), "sk", F.lit(" {\n  a: string\n}\nexport type A"), "sk", F.lit(" = string\n"))
    per = s.select(F.floor(F.col("sk") / PARTS_PER_FILE).alias("g"), "sk", (py if ext == ".py" else ts).alias("t")).groupBy("g").agg(F.array_sort(F.collect_list(F.struct("sk", "t"))).alias("all"))
    return with_lang(per.select(F.concat(F.lit("s/g"), "g", F.lit(ext)).alias("path"), F.array_join(F.transform("all", lambda x: x["t"]), "").alias("content")))


#: Forms of the other languages' files: extension, import, opening and end of a class around the functions, head and
#: end of a function, a statement's beginning, and a type after the class. {c} is the customer, {o} the order.
FORMS = {
    "c": (".c", '#include "lib{m}.h"\n', "", "", "int f{o}(int a)\n{\n", "}\n", "\tx = ", "struct T{c} {\n\tint a;\n};\n"),
    "cpp": (".cpp", "#include <lib{m}>\n", "class C{c}\n{\n", "};\n", "    int f{o}(int a){q}\n    {\n", "    }\n", "\tx = ", "enum T{c} {\n\tA\n};\n"),
    "cs": (".cs", "using lib{m};\n", "public class C{c}\n{\n", "}\n", "    public int f{o}(int a)\n    {\n", "    }\n", "\tx = ", "public interface T{c} {\n}\n"),
    "java": (".java", "import lib{m};\n", "public class C{c} {\n", "}\n", "    public int f{o}(int a){q} {\n", "    }\n", "\tx = ", "abstract class T{c} {\n}\n"),
    "d": (".d", "import lib{m};\n", "class C{c} {\n", "}\n", "    int f{o}(int a)\n    {\n", "    }\n", "\tx = ", "struct T{c} {\n\tint a;\n}\n"),
    "kotlin": (".kt", "import lib{m}\n", "class C{c} {\n", "}\n", "    fun f{o}(a: Int) {\n", "    }\n", "\tx = ", "data class T{c} {\n}\n"),
    "php": (".php", "use lib{m};\n", "class C{c} {\n", "}\n", "    public function f{o}($a) {\n", "    }\n", "\t$x = ", "trait T{c} {\n}\n"),
    "ruby": (".rb", 'require "lib{m}"\n', "class C{c}\n", "end\n", "  def f{o}(a)\n", "  end\n", "\tx = ", "module T{c}\nend\n"),
    "scala": (".scala", "import lib{m}\n", "class C{c} {\n", "}\n", "  def f{o}(a: Int) = {\n", "  }\n", "\tx = ", "case class T{c} {\n}\n"),
}
#: What follows the parameters of every third function.
QUALIFIERS = {"cpp": " const", "java": " throws Fault"}


def _language_file(lang: str):
    """(path, content, lang) of a customer's file: a class with a function per order and a statement per line item, and another type after it."""
    ext, use, opened, closed, head, tail, statement, other = FORMS[lang]

    def fill(text: str, **values):
        parts = re.split(r"\{([a-z])\}", text)
        return F.concat(*[values[x].cast("string") if i % 2 else F.lit(x) for i, x in enumerate(parts)])

    def one(x):
        qualifier = F.when(x["ok"] % 3 == 0, QUALIFIERS.get(lang, "")).otherwise("")
        return F.concat(fill(head, o=x["ok"], q=qualifier), x[_body(statement)], F.lit(tail))

    ck = F.col("ck")
    text = F.concat(fill(use, m=ck % 7), fill(opened, c=ck), F.array_join(F.transform("orders", one), ""), F.lit(closed), fill(other, c=ck))
    return F.struct(_path(ext).alias("path"), text.alias("content"), F.lit(lang).alias("lang"))


def _body(statement: str) -> str:
    return "body" + "".join(re.findall(r"\w|\$", statement))


def _bodies(spark: SparkSession, sf_dir: str, langs) -> DataFrame:
    """(ck, orders): orders (ok, a text of their statements in each form of ``langs``), which languages share."""

    def text(x, statement):
        return F.array_join(F.transform(x["items"], lambda i: F.concat(F.lit(statement), i["l_partkey"], F.lit(";\n"))), "").alias(_body(statement))

    forms = sorted({FORMS[k][6] for k in langs})
    return by_customer(spark, sf_dir).select("ck", F.transform("orders", lambda x: F.struct(x["ok"].alias("ok"), *[text(x, s) for s in forms])).alias("orders"))


def language_files(spark: SparkSession, sf_dir: str, lang: str) -> DataFrame:
    """A file per customer in the form of ``lang``."""
    return _bodies(spark, sf_dir, [lang]).select(_language_file(lang).alias("x")).select("x.*")


def all_language_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those of all forms, from one pass over the customers."""
    return _bodies(spark, sf_dir, FORMS).select(F.inline(F.array(*[_language_file(k) for k in FORMS])))


def import_files(spark: SparkSession, sf_dir: str, lang: str) -> DataFrame:
    """A file per nation. Go: imports of the next region's folder, of the library and of a folder that is not there.
    Python: imports of the region's nations, of the library and of an unknown module."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("r"))
    if lang == "go":
        text = F.concat(F.lit('package r\nimport "fmt"\nimport "mod/r'), (F.col("r") + 1) % 5, F.lit('"\nimport "mod/none"\n'))
        return with_lang(n.select(F.concat(F.lit("r"), "r", F.lit("/n"), "k", F.lit(".go")).alias("path"), text.alias("content")))
    kin = n.groupBy("r").agg(F.array_sort(F.collect_list("k")).alias("kin"))
    lines_ = F.array_join(F.transform(F.filter("kin", lambda x: x != F.col("k")), lambda x: F.concat(F.lit("import n"), x, F.lit("\n"))), "")
    text = F.concat(F.lit("import os\nimport numpy\n"), lines_)
    return with_lang(n.join(kin, "r").select(F.concat(F.lit("r"), "r", F.lit("/n"), "k", F.lit(".py")).alias("path"), text.alias("content")))


