"""Personal data by patterns, checksums and context, with DataFrame functions only.

Regular expressions propose spans, validators confirm them (Luhn for cards, mod-97 for account numbers,
ranges for addresses), and words near a span raise or lower its score. A pattern runs only over texts
that hold a character it needs. Positions are code points: the pieces between the matches are as many
as the matches plus one, so running lengths of both give every start, in blocks.

The patterns use possessive repeats and start only where a run starts or the last match ended, which
finds the same matches as the plain patterns without their quadratic time or deep recursion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: Kinds in the order of ties, with pattern, what a text must contain, and base score.
KINDS = [
    ("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.8),
    ("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "[0-9]\\.[0-9]", 0.5),
    ("card", r"[0-9](?:[\x20-]?[0-9])++", "[0-9][\\x20-]?[0-9]", 0.7),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.6),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?|[A-Z0-9]{11,30})(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2}", 0.9),
]
BASE = ("email", "ip", "card", "phone")
#: Words that make a kind likelier, and words that make it less likely, in lower case.
NEAR = {
    "email": (["mail", "contact", "write to", "kontakt", "correo"], ["example"]),
    "ip": (["ip", "host", "server", "address", "login"], ["version", "release"]),
    "card": (["card", "visa", "credit", "payment", "karte", "tarjeta", "carte"], ["order", "isbn", "serial", "invoice"]),
    "phone": (["phone", "tel", "call", "mobile", "fax", "telefon"], ["order", "part"]),
    "iban": (["iban", "account", "bank", "konto", "cuenta", "compte"], ["serial"]),
}
REACH = 40


def luhn_ok(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)
    digit = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int")
    twice = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + F.when(i % 2 == 1, twice(digit(i))).otherwise(digit(i)))
    return total % 10 == 0


def mod97_ok(iban: Column) -> Column:
    """Whether an account number (capital letters and digits, no blanks) leaves 1 modulo 97."""
    s = F.concat(F.substring(iban, 5, 40), F.substring(iban, 1, 4))
    c = lambda i: F.ascii(F.substring(s, i, F.lit(1)))
    step = lambda a, i: F.when(c(i) < 58, (a * 10 + c(i) - 48) % 97).otherwise((a * 100 + c(i) - 55) % 97)
    return F.aggregate(F.sequence(F.lit(1), F.length(s)), F.lit(0), step) == 1


def valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(m, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(digits).between(14, 19) & luhn_ok(digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "iban":
        bare = F.regexp_replace(m, "\x20", "")
        return F.length(bare).between(15, 34) & mod97_ok(bare)
    return F.lit(True)


#: Matches are counted through in blocks of so many, so that no array grows by one member at a time over a whole text.
BLOCK = 256
SPAN = "struct<start:bigint,rank:int,end:bigint,kind:string,score:double,match:string>"


def pieces(text: Column, pattern: str, needs: str) -> Column:
    """array<struct<p, m, next>>: the text before each match, the match, the text after it; a last one without a match."""
    has = F.contains(text, F.lit(needs)) if len(needs) == 1 else text.rlike(needs)
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.arrays_zip(between.alias("p"), found.alias("m"), F.slice(between, 2, F.greatest(F.size(between), F.lit(1))).alias("next"))
    return F.when(has, pairs).otherwise(F.array().cast("array<struct<p:string,m:string,next:string>>"))


def offsets(found: Column) -> Column:
    """Code points before each block of pieces."""
    length = lambda s, x: s + F.length(x["p"]) + F.coalesce(F.length(x["m"]), F.lit(0))
    sums = F.transform(blocks(found), lambda b: F.aggregate(F.slice(found, b * BLOCK + 1, BLOCK), F.lit(0).cast("bigint"), length))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(sums, start, lambda s, n: F.struct((s["at"] + n).alias("at"), F.array_append(s["out"], s["at"]).alias("out")), lambda s: s["out"])


def blocks(found: Column) -> Column:
    return F.when(F.size(found) > 0, F.sequence(F.lit(0), F.floor((F.size(found) - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))


def scored(kind: str, base: float, x: Column) -> Column:
    """The score of a confirmed span: up by 0.2 beside a word that fits, down by 0.3 beside one that speaks against it.

    Beside means within REACH characters, up to the next match of its kind.
    """
    around = F.lower(F.concat_ws(" ", F.right(x["p"], F.lit(REACH)), F.left(F.coalesce(x["next"], F.lit("")), F.lit(REACH))))
    good, bad = (r"\b(?:" + "|".join(w) + r")\b" for w in NEAR[kind])
    raw = F.lit(base) + F.when(around.rlike(good), 0.2).otherwise(0.0) - F.when(around.rlike(bad), 0.3).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def confirmed(rank: int, kind: str, base: float, found: Column, before: Column) -> Column:
    """The kind's matches that its validator confirms, as (start, rank, end, kind, score, match), in code points."""

    def step(s: Column, x: Column) -> Column:
        # a match that fails its check is passed over; the last piece has none
        at = s["at"] + F.length(x["p"])
        end = at + F.coalesce(F.length(x["m"]), F.lit(0))
        one = F.struct(at.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), scored(kind, base, x).alias("score"), x["m"].alias("match"))
        ok = x["m"].isNotNull() & valid(kind, x["m"])
        return F.struct(end.alias("at"), F.when(ok, F.array_append(s["out"], one)).otherwise(s["out"]).alias("out"))

    start = lambda b: F.struct(F.get(before, b).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
    return F.flatten(F.transform(blocks(found), lambda b: F.aggregate(F.slice(found, b * BLOCK + 1, BLOCK), start(b), step, lambda s: s["out"])))


def find_personal_data(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: id, ``text`` and ``found``, an array of (start, rank, end, kind, score, match) by start, then kind.

    Null texts are empty and have no spans. Rows are independent of one another, so ties, repeated rows and
    null ids keep a row each; an empty table gives no rows; further columns, whatever their names, are ignored.
    Very long texts are read as a whole; time grows with a text's length and matches.
    """
    src = df.select(F.col(f"`{id_col}`").alias(id_col), text_of(f"`{text}`").alias("text"))
    # each step is a projection of its own: its columns are used many times over
    src = src.withColumns({f"__m_{k}": pieces(F.col("text"), p, needs) for k, p, needs, _ in KINDS})
    src = src.withColumns({f"__at_{k}": offsets(F.col(f"__m_{k}")) for k, *_ in KINDS})
    spans = [confirmed(rank, k, base, F.col(f"__m_{k}"), F.col(f"__at_{k}")) for rank, (k, _, _, base) in enumerate(KINDS)]
    return src.select(id_col, "text", F.array_sort(F.concat(*spans)).alias("found"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of ``find_personal_data``'s rows, without the texts."""
    told = lambda a: F.concat_ws(",", F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    counts = [count(k) for k, *_ in KINDS]
    return found.select(
        id_col, *counts[:4], F.sha2(told(base), 256).alias("base_sha256"), told(F.col("found")).alias("spans"), counts[4],
        F.concat_ws(",", F.transform("found", lambda s: F.format_number(s["score"], 2))).alias("scores"),
    )


def redact(found: DataFrame, least_score: float = 0.5) -> DataFrame:
    """The texts with confirmed spans replaced by their kind in angle brackets; of overlapping spans the first counts."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        take = (x["start"] >= s["at"]) & (x["score"] >= least_score)
        between = F.substring(F.col("text"), s["at"].cast("int") + 1, (x["start"] - s["at"]).cast("int"))
        return F.when(take, F.struct(x["end"].alias("at"), F.concat(s["out"], between, F.lit("<"), x["kind"], F.lit(">")).alias("out"))).otherwise(s)

    clean = F.aggregate("found", start, step, lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"].cast("int") + 1, F.length("text"))))
    return found.withColumn("text", clean)
