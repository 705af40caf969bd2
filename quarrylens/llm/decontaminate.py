"""Benchmark decontamination by template canonicalisation, with DataFrame functions only.

Texts become templates: numbers, names and units after a number turn into typed placeholders,
everything else into lower-case words. A name is a capitalised word inside a sentence, or a run of them
anywhere; a single capitalised word where a sentence may start is marked and counts as a word or as a
name, whichever fits. Windows of ``width`` template words are hashed and joined with those of the
benchmark; a document leaks an item if it holds a share ``threshold`` of the item's windows. Items are
also looked for in lower case, for copies that have lost their capitals.

Where windows that fit hold slots, the slots have to agree: along one alignment, equal values of the
item answer to equal values of the document. So a question with other numbers is caught, also where two
numbers became the same one, while text that fits the template by chance is not. This check works on
rows of (pair, alignment, place), one for each window that fits, and is linear in them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_of

#: Units of measure that may follow a number.
UNITS = "kg|g|mg|km|m|cm|mm|miles|mile|feet|ft|inches|inch|hours|hour|hrs|minutes|minute|min|seconds|second|sec|days|day|weeks|week|months|month|years|year|dollars|dollar|euros|euro|cents|cent|percent|litres|liters|litre|liter|ml|l|mph|kmh|meters|metres|meter|metre|pounds|pound|lbs|lb|degrees|degree"
#: Private characters: the three placeholders, the end of a value, and the mark of a word that may be a name.
NUM, NAME, UNIT, END, MAYBE = "", "", "", "", ""
OWN = f"[{NUM}{NAME}{UNIT}{END}{MAYBE}]"
#: A word's capital with a small letter after it, the rest of such a word, and the beginning of the next one of a run.
CAPITAL = rf"\p{{Lu}}(?<![\p{{L}}\p{{M}}\p{{N}}{MAYBE}]\p{{Lu}})(?=['’-]?\p{{Ll}})"
REST = r"[\p{L}\p{M}'’-]*+"
NEXT = r"(?<=\p{Ll})\x20\p{Lu}(?=['’-]?\p{Ll})"
#: The capital of a single name that does not follow a small letter, digit, comma or semicolon and a blank.
MAYBE_NAMES = rf"{CAPITAL}(?<![\p{{Ll}}\p{{Nd}},;]\x20\p{{Lu}})(?!{REST}{NEXT})"
NAMES = rf"{CAPITAL}{REST}(?:{NEXT}{REST})*+"
UNITS_AFTER = rf"(?<=[0-9])\x20?(?:{UNITS})\b"
NUMBERS = r"[0-9](?<![\p{L}\p{M}\p{N}][0-9])[0-9]*+(?:[.,][0-9]++)*+(?![\p{L}\p{M}])"
BETWEEN = rf"[^\p{{L}}\p{{M}}\p{{N}}{NUM}{NAME}{UNIT}{MAYBE}]+"
TOKEN = rf"[{NUM}{NAME}{UNIT}][^{END}]*+{END}|[\p{{L}}\p{{M}}\p{{N}}{MAYBE}]++"
#: Windows of the benchmark that are broadcast at most; with more, documents' windows are exchanged.
BROADCAST_WINDOWS = 2_000_000
#: Then each window of the benchmark has so many copies, and a window that many documents hold as many keys.
SALTS = 32


def _replaced(text: Column, value: str) -> Column:
    """``text`` with each placeholder and then ``value``, where $0 is what it stands for, in place of names, units and numbers."""
    own = F.when(text.rlike(OWN), F.regexp_replace(text, OWN, " ")).otherwise(text)
    named = F.regexp_replace(F.regexp_replace(own, MAYBE_NAMES, f"{MAYBE}$0"), NAMES, f" {NAME}{value} ")
    units = F.regexp_replace(named, UNITS_AFTER, f" {UNIT}{value} ")
    return F.when(text.rlike("[0-9]"), F.regexp_replace(units, NUMBERS, f" {NUM}{value} ")).otherwise(named)


def template(text: Column) -> Column:
    """The template's words, as an array of strings; a word that may be a name begins with MAYBE."""
    return F.array_remove(F.split(F.lower(_replaced(text, "")), BETWEEN, -1), "")


def tokens(text: Column) -> Column:
    """The template's words in the same order, placeholders followed by what they stand for and END."""
    return F.regexp_extract_all(F.lower(_replaced(text, f"$0{END}")), F.lit(TOKEN), F.lit(0))


def _value(token: Column) -> Column:
    return F.trim(F.translate(token, f"{NUM}{NAME}{UNIT}{END}{MAYBE}", ""))


def _word(token: Column) -> Column:
    """The word of ``template`` for a token of ``tokens``."""
    return F.when(token.endswith(END), F.substring(token, 1, 1)).otherwise(token)


def slot_values(text: Column) -> Column:
    """What the placeholders stand for, in the template's order."""
    return F.transform(F.filter(tokens(text), lambda t: t.endswith(END)), _value)


def as_words(words: Column) -> Column:
    """Hashes of a template's words. Windows are made of these, so that a word's letters are read once."""
    return F.transform(words, lambda w: F.when(w.startswith(MAYBE), F.xxhash64(F.substring(w, 2, 1 << 30))).otherwise(F.xxhash64(w)))


def as_names(words: Column) -> Column:
    """The same with marked words as names."""
    return F.transform(words, lambda w: F.xxhash64(F.when(w.startswith(MAYBE), F.lit(NAME)).otherwise(w)))


def window(hashes: Column, i: Column, width: int) -> Column:
    """The hash of ``width`` hashes from place ``i`` on."""
    return F.xxhash64(*[F.get(hashes, i + k) for k in range(width)])


def rows_of(df: DataFrame, array: str, name: str) -> DataFrame:
    """A row for each member of ``array``. ``explode`` would have the whole array made a second time, by the filter on its size that it adds below."""
    return df.withColumn(name, F.explode_outer(array)).drop(*[array] if array != name else []).where(F.col(name).isNotNull())


NO_PLACES = "array<int>"


def starts(words: Column, width: int) -> Column:
    """Places, from 0, of the windows of ``width`` words."""
    return F.when(F.size(words) >= width, F.sequence(F.lit(0), F.size(words) - width)).otherwise(F.array().cast(NO_PLACES))


def marked_starts(words: Column, width: int) -> Column:
    """Places of those windows that hold a marked word."""
    marks = F.filter(F.transform(words, lambda w, i: F.when(w.startswith(MAYBE), i)), lambda i: i.isNotNull())
    near = F.transform(marks, lambda i: F.sequence(F.greatest(F.least(i, F.size(words) - width) - (width - 1), F.lit(0)), F.least(i, F.size(words) - width)))
    return F.when(F.size(words) >= width, F.array_distinct(F.flatten(near))).otherwise(F.array().cast(NO_PLACES))


def benchmark_windows(benchmark: DataFrame, item_id: str, text: str, width: int, threshold: float) -> DataFrame:
    """One row for each window of an item and each hash it is known by: item_id, n_slots, key, w, i, h, pos, slotted, kinds, values, places, strict, total, need.

    ``key`` stands for (item_id, text, form), so that one id may have several texts. Form 0 is the template,
    form 1 that of the text in lower case where it differs. Windows have ``width`` words or, for shorter items,
    all of them. Marked words are names too in items with other words for a whole window and no more slots and
    marks than those; the windows of others would fit by chance. An item that is placeholders only
    (``strict``) has to be met with its own values.
    """
    items = benchmark.select(F.col(f"`{item_id}`").alias("item_id"), text_of(f"`{text}`").alias("text")).distinct()
    items = items.select("item_id", F.xxhash64("text").alias("item"), tokens(F.col("text")).alias("t0"), tokens(F.lower("text")).alias("t1"))
    bare = lambda t: F.transform(t, lambda x: F.translate(_word(x), MAYBE, ""))
    forms = [F.struct(F.lit(k).alias("form"), F.col(f"t{k}").alias("tokens")) for k in (0, 1)]
    items = rows_of(items.select("item_id", "item", F.when(bare("t0") == bare("t1"), F.array(forms[0])).otherwise(F.array(*forms)).alias("x")), "x", "x").select("item_id", "item", "x.*")
    items = items.where(F.size("tokens") > 0).withColumn("key", F.xxhash64(F.col("item_id"), F.col("item"), F.col("form")))
    items = items.withColumn("words", F.transform("tokens", _word))
    kinds = F.transform("words", lambda w: F.when(w.isin(NUM, NAME, UNIT), F.lit(2)).when(w.startswith(MAYBE), F.lit(1)).otherwise(F.lit(0)))
    items = items.withColumns({"kinds": kinds, "values": F.transform("tokens", lambda t: F.xxhash64(_value(t))), "a": as_words(F.col("words")), "b": as_names(F.col("words"))})
    items = items.withColumns({"n": F.size("words"), "w": F.least(F.size("words"), F.lit(width))})
    of_kind = lambda k: F.size(F.filter("kinds", lambda x: x == k))
    named = (F.col("form") == 0) & (of_kind(0) >= width) & (of_kind(1) + of_kind(2) <= of_kind(0))
    items = items.withColumns({"n_slots": of_kind(2), "named": named, "strict": of_kind(2) == F.col("n"), "places": F.col("n") - F.col("w") + 1})
    part = lambda c: F.slice(c, F.col("i") + 1, F.col("w"))
    # the hash of an array is that of its members in turn, as in ``window``
    rows = rows_of(items.withColumn("all", F.sequence(F.lit(0), F.col("n") - F.col("w"))), "all", "i")
    rows = rows.select("item_id", "n_slots", "key", "w", "i", "places", "strict", "named", part("kinds").alias("kinds"), part("values").alias("values"), F.xxhash64(part("a")).alias("pos"), F.xxhash64(part("b")).alias("other"))
    known_by = F.when(F.col("named"), F.array_distinct(F.array("pos", "other"))).otherwise(F.array("pos"))
    rows = rows_of(rows.withColumn("hashes", known_by), "hashes", "h").drop("other", "named")
    rows = rows.withColumn("slotted", F.array_contains("kinds", 2) | (F.col("h") != F.col("pos")))
    totals = rows.groupBy("key").agg(F.count_distinct("pos").alias("total"))
    return rows.join(totals, "key").withColumn("need", F.col("total") * F.lit(threshold))


def _dealt(rows: DataFrame, side: DataFrame, on: list[str], small: bool) -> DataFrame:
    """``rows`` joined with windows of the benchmark: by a broadcast, or by an exchange with each key salted."""
    if small:
        return rows.join(F.broadcast(side), on)
    salted = side.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.col("text_hash"), F.lit(SALTS)).cast("int")).join(salted, [*on, "salt"]).drop("salt")


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row per leaked pair: id, ``text_hash`` (of the document), item_id, coverage, n_slots.

    Coverage is the share of the item's distinct windows that the document holds. Null and empty texts and
    items without words leak nothing; items shorter than a window are looked for as one window. Repeated
    documents and null ids are told apart by text only and give one row per pair of id, text and item; an
    item id with several texts is leaked with any of them. Whole texts are read, however long, and time is linear in
    their words and in the windows that fit. Empty tables give no rows; further columns are ignored.
    """
    bench = cut(benchmark_windows(benchmark, item_id, item_text, width, threshold))
    small = bench.count() <= BROADCAST_WINDOWS
    lengths = sorted(r.w for r in bench.select("w").distinct().collect())  # at most ``width`` values
    src = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(f"`{text}`").alias("text"))
    words = src.select("id", F.xxhash64("text").alias("text_hash"), template(F.col("text")).alias("words")).withColumns({"a": as_words(F.col("words")), "b": as_names(F.col("words"))})
    one = lambda c, w: lambda i: window(F.col(c), i, w)
    made = [F.transform(of(F.col("words"), w), one(c, w)) for w in lengths for c, of in (("a", starts), ("b", marked_starts))]
    win = F.array_distinct(F.concat(*made)) if made else F.array().cast("array<bigint>")
    rows = rows_of(words.select("id", "text_hash", win.alias("win")), "win", "h")
    hits = _dealt(rows, bench.select("h", "pos", "slotted", "key", "total", "need"), ["h"], small)
    # an item's windows bound these sets
    held = F.size(F.collect_set("pos"))
    sure = F.size(F.collect_set(F.when(~F.col("slotted"), F.col("pos"))))
    pairs = hits.groupBy("id", "text_hash", "key", "total", "need").agg(held.alias("held"), sure.alias("sure")).where("held >= need - 1e-9")
    pairs = cut(pairs.select("id", "text_hash", "key", (F.col("held") / F.col("total")).alias("coverage"), (F.col("sure") >= F.col("need") - 1e-9).alias("sure")))
    found = pairs.where("sure").drop("sure")
    open_pairs = pairs.where("not sure").drop("sure")
    if open_pairs.limit(1).count():
        found = found.union(_consistent(src, bench, open_pairs, lengths, threshold, small))
    of = bench.groupBy("key", "item_id").agg(F.max("n_slots").alias("n_slots"))
    found = found.join(F.broadcast(of) if small else of, "key")
    found = found.groupBy("id", "text_hash", "item_id").agg(F.max("coverage").alias("coverage"), F.max("n_slots").alias("n_slots"))
    return found.select(F.col("id").alias(id_col), "text_hash", "item_id", "coverage", "n_slots")


def _kept(rows: DataFrame, side: DataFrame, on: list[str], small: bool) -> DataFrame:
    """The rows whose columns ``on``, null or not, are in ``side``."""
    named = side.select(*[F.col(c).alias(f"__{c}") for c in on])
    same = F.lit(True)
    for c in on:
        same &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    return rows.join(F.broadcast(named) if small else named, same, "left_semi")


def _consistent(src: DataFrame, bench: DataFrame, pairs: DataFrame, lengths: list[int], threshold: float, small: bool) -> DataFrame:
    """The pairs whose slots agree. Only the texts of their documents are read again, each once.

    An alignment is a difference of places. If the windows that fit along one are a share ``threshold`` of the item's, the
    slots of one such alignment have to agree; if there is none (words were put in or left out), each window follows the
    alignment that most windows lie on, and all their slots together have to agree.
    """
    want = pairs.select("id", "text_hash").distinct()
    few = pairs.count() <= BROADCAST_WINDOWS
    keyed = _kept(src.withColumn("text_hash", F.xxhash64("text")), want, ["id", "text_hash"], few).dropDuplicates(["id", "text_hash"])
    words = keyed.select("id", "text_hash", tokens(F.col("text")).alias("tokens")).withColumn("words", F.transform("tokens", _word))
    words = words.withColumns({"values": F.transform("tokens", lambda t: F.xxhash64(_value(t))), "a": as_words(F.col("words")), "b": as_names(F.col("words"))})
    one = lambda c, w: lambda j: F.struct(F.lit(w).alias("w"), j.alias("j"), window(F.col(c), j, w).alias("h"), F.slice("values", j + 1, w).alias("theirs"))
    made = [F.transform(of(F.col("words"), w), one(c, w)) for w in lengths for c, of in (("a", starts), ("b", marked_starts))]
    rows = rows_of(words.select("id", "text_hash", F.concat(*made).alias("x")), "x", "x").select("id", "text_hash", "x.*")
    side = bench.select("h", "w", "key", "i", "kinds", "values", "places", "strict")
    met = _dealt(rows, side, ["h", "w"], small)
    pair = ["id", "text_hash", "key"]
    met = _kept(met, pairs, pair, few)
    slots = F.filter(F.transform("kinds", lambda k, n: F.struct(k.alias("k"), F.get("values", n).alias("a"), F.get("theirs", n).alias("b"))), lambda s: s["k"] > 0)
    met = cut(met.select("id", "text_hash", "key", "i", (F.col("j") - F.col("i")).alias("d"), "places", "strict", F.transform(slots, lambda s: F.struct(s["a"], s["b"])).alias("slots")))
    # along one alignment each place of the item has one window, so an item's length bounds these sets
    along = met.groupBy(*pair, "d", "places", "strict").agg(F.size(F.collect_set("i")).alias("n"), _joined(F.collect_set("slots")).alias("slots"))
    along = cut(along.withColumns({"straight": F.col("n") >= F.col("places") * F.lit(threshold) - 1e-9, "agrees": _agrees("slots", "strict")}).drop("slots"))
    told = along.groupBy(*pair).agg(F.max("straight").alias("straight"), F.max(F.col("straight") & F.col("agrees")).alias("ok"))
    bent = told.where("not straight").select(*pair)
    weight = along.select(*[F.col(c).alias(f"__{c}") for c in (*pair, "d")], "n")
    lies_on = F.col("id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__text_hash")) & (F.col("key") == F.col("__key")) & (F.col("d") == F.col("__d"))
    best = _kept(met, bent, pair, False).join(weight, lies_on)
    best = best.groupBy(*pair, "strict", "i").agg(F.max_by("slots", F.struct("n", -F.col("d"))).alias("slots"))
    best = best.groupBy(*pair, "strict").agg(_joined(F.collect_set("slots")).alias("slots")).where(_agrees("slots", "strict"))
    return _kept(pairs, told.where("ok").select(*pair).union(best.select(*pair)), pair, False)


def _joined(sets: Column) -> Column:
    return F.array_distinct(F.flatten(sets))


def _agrees(slots: str, strict: str) -> Column:
    """Whether distinct (item's value, document's value) give each value of the item one of the document; its own where ``strict``."""
    firsts = F.array_distinct(F.transform(slots, lambda s: s["a"]))
    return (F.size(firsts) == F.size(slots)) & (~F.col(strict) | F.forall(slots, lambda s: s["a"] == s["b"]))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` without the rows that leak an item, by ``find_leaks``; columns and other rows stay as they are, null and empty texts too."""
    leaks = find_leaks(docs, benchmark, id_col, text, **how)
    keys = cut(leaks.select(F.col(f"`{id_col}`").alias("__id"), F.col("text_hash").alias("__hash")).distinct())
    few = keys.count() <= BROADCAST_WINDOWS
    side = F.broadcast(keys) if few else keys
    return docs.join(side, docs[id_col].eqNullSafe(side["__id"]) & (F.xxhash64(text_of(docs[text])) == side["__hash"]), "left_anti")
