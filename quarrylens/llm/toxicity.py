"""Toxicity by a counterfactual-regularised linear classifier.

Features of a text are the words in it and their beginnings, each counted once. The loss is the
logistic loss on labelled texts plus L2, plus ``counterfactual`` times the mean squared change of the
logit between a labelled text and copies of it in which identity terms are swapped for others of their
kind or for a neutral word. A term that merely occurs beside toxic text thus gets no weight of its own,
and neutral mentions of a group score as any other neutral sentence does.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, scratch, text_of

WORD = re.compile(r"\w+")
#: Identity terms by kind; a swap stays inside its kind.
IDENTITY = {
    "religion": ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "sikh", "muslims", "christians", "jews", "hindus"],
    "origin": ["african", "asian", "european", "american", "mexican", "arab", "turkish", "german", "french", "spanish", "chinese", "indian", "immigrant", "immigrants", "foreigner", "foreigners", "refugee", "refugees"],
    "gender": ["woman", "man", "women", "men", "girl", "boy", "female", "male", "transgender", "nonbinary"],
    "orientation": ["gay", "lesbian", "straight", "bisexual", "queer", "homosexual", "heterosexual"],
    "colour": ["black", "white", "brown"],
    "ability": ["disabled", "deaf", "blind", "autistic"],
    "age": ["old", "young", "elderly"],
    "de": ["muslime", "christen", "juden", "frauen", "männer", "ausländer", "türken", "deutsche", "schwule", "lesben"],
    "fr": ["musulmans", "chrétiens", "juifs", "femmes", "hommes", "étrangers", "arabes", "français"],
    "es": ["musulmanes", "cristianos", "judíos", "mujeres", "hombres", "extranjeros", "árabes", "españoles"],
}
NEUTRAL = "person"
KIND_OF = {t: k for k, terms in IDENTITY.items() for t in terms}
#: Words whose features a worker remembers.
MEMO_WORDS = 400_000


def words(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


#: Lengths of the beginnings of words that are features.
PREFIXES = (4, 5, 6)


def features(word: str) -> tuple[int, ...]:
    """Hashes of the word itself and of its beginnings of PREFIXES characters, as signed 64-bit integers."""
    names = (f"={word}", *(f"^{word[:n]}" for n in PREFIXES if len(word) > n))
    return tuple(h - (1 << 64) if (h := xxhash.xxh64_intdigest(x)) >> 63 else h for x in names)


class Model(NamedTuple):
    weights: dict[int, float]
    bias: float

    def score(self, text: str | None, memo: dict[str, tuple] | None = None) -> float:
        """Probability of the toxic label, of the whole text."""
        memo = {} if memo is None else memo
        seen: set[int] = set()
        for w in words(text):
            f = memo.get(w)
            if f is None:
                if len(memo) >= MEMO_WORDS:
                    memo.clear()
                f = memo[w] = tuple(x for x in features(w) if x in self.weights)
            if f:
                seen.update(f)
        z = self.bias + sum(self.weights[x] for x in sorted(seen))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def swaps(term: str, most: int = 4) -> list[str]:
    """What an identity term is swapped for: others of its kind, and a neutral word."""
    kin = [t for t in IDENTITY[KIND_OF[term]] if t != term]
    at = sum(map(ord, term)) % max(1, len(kin))
    return [*(kin[at:] + kin[:at])[:most], NEUTRAL]


class Example(NamedTuple):
    """A labelled text: its distinct features, and for each swap the features that go and those that come."""

    features: np.ndarray
    changes: list[tuple[np.ndarray, np.ndarray]]


def example(ws: set[str]) -> Example:
    own = {x for w in ws for x in features(w)}
    changes = []
    for term in sorted(ws & KIND_OF.keys()):
        rest = {x for w in ws - {term} for x in features(w)}
        gone = own - rest
        for other in swaps(term):
            now = set(features(other))
            changes.append((np.array(sorted(gone - now), np.int64), np.array(sorted(now - own), np.int64)))
    return Example(np.array(sorted(own), np.int64), changes)


def telling(n0, n1, total0, total1, log, sqrt):
    """How far a feature's share differs between the labels, in standard errors, from its counts and those of the labels."""
    odds = log((n1 + 0.5) / (total1 - n1 + 0.5)) - log((n0 + 0.5) / (total0 - n0 + 0.5))
    return odds / sqrt(1 / (n1 + 0.5) + 1 / (n0 + 0.5))


#: A feature is used if it is in at least two texts and ``telling`` is beyond this.
LEAST_Z = 2.6


def chosen(examples: list[Example], labels: list[int]) -> np.ndarray:
    """The hashes of all features that tell the labels apart, sorted."""
    y = np.array(labels) > 0.5
    size = np.array([len(e.features) for e in examples], np.int64)
    known, at = np.unique(np.concatenate([np.empty(0, np.int64), *[e.features for e in examples]]), return_inverse=True)
    toxic = np.repeat(y, size)
    n = [np.bincount(at[toxic == c], minlength=len(known)).astype(float) for c in (False, True)]
    z = telling(n[0], n[1], float((~y).sum()), float(y.sum()), np.log, np.sqrt)
    return known[(n[0] + n[1] >= 2) & (np.abs(z) > LEAST_Z)]


class Sparse:
    """A matrix of few entries a row, by (row, column, value)."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, shape: tuple[int, int]):
        self.rows, self.columns, self.values, self.shape = rows, columns, values, shape

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, self.values * w[self.columns], minlength=self.shape[0])

    def transposed_times(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, self.values * v[self.rows], minlength=self.shape[1])


def fit(examples: list[Example], labels: list[int], known: np.ndarray | None = None, l2: float = 2e-4, counterfactual: float = 1.0, rounds: int = 600) -> Model:
    """Fits the weights of ``known`` features (all that ``chosen`` finds). With one label only, a constant score."""
    y = np.array(labels, np.float64)
    if not len(y) or y.min() == y.max():
        return Model({}, 0.0 if not len(y) else (-4.0 if y[0] < 0.5 else 4.0))
    known = chosen(examples, labels) if known is None else known

    def matrix(rows: list[list[tuple[np.ndarray, float]]]) -> Sparse:
        at, col, val = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        for r, parts in enumerate(rows):
            for hashes, value in parts:
                c = np.searchsorted(known, hashes)
                c = c[np.take(known, c, mode="clip") == hashes] if len(known) else c[:0]
                at.append(np.full(len(c), r))
                col.append(c)
                val.append(np.full(len(c), value))
        return Sparse(np.concatenate(at), np.concatenate(col), np.concatenate(val), (len(rows), len(known)))

    x = matrix([[(e.features, 1.0)] for e in examples])
    pairs = [c for e in examples for c in e.changes]
    change = matrix([[(gone, 1.0), (come, -1.0)] for gone, come in pairs])
    # rarer labels weigh more, so that 0.5 means as likely as not in a balanced set
    weight = len(y) / (2 * np.where(y > 0.5, (y > 0.5).sum(), (y <= 0.5).sum()))
    w, b = np.zeros(len(known)), 0.0
    m1 = m2 = np.zeros(len(known) + 1)
    for t in range(1, rounds + 1):
        off = weight * (1 / (1 + np.exp(-np.clip(x.times(w) + b, -30, 30))) - y)
        g = x.transposed_times(off) / len(y) + l2 * w
        if len(pairs):
            g = g + 2 * counterfactual * change.transposed_times(change.times(w)) / len(pairs)
        step = np.append(g, off.mean())
        m1, m2 = 0.9 * m1 + 0.1 * step, 0.999 * m2 + 0.001 * step**2
        move = 0.05 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return Model({int(k): float(v) for k, v in zip(known, w, strict=True)}, float(b))


HASHES = pa.list_(pa.int64())
EXAMPLE = "features array<bigint>, changes array<struct<gone:array<bigint>,come:array<bigint>>>"
CHANGES = pa.list_(pa.struct([("gone", HASHES), ("come", HASHES)]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", sample_per_class: int = 4000, **how) -> Model:
    """Fits on labelled rows outside the held-out third, at most ``sample_per_class`` of each label, by hash of the id.

    A document with several labels has their rounded mean; null labels and ids do not count; of equal texts with equal
    labels one is used. Features are counted and chosen on executors. What reaches the driver is the chosen features, and
    which of them each text of the sample has: it does not grow with the words of a text that tell nothing.
    """
    own = labels.where(f"`{label}` is not null and `{id_col}` is not null").groupBy(F.col(f"`{id_col}`").alias("__id")).agg(F.round(F.avg(f"`{label}`")).cast("int").alias("__label"))
    own = own.where(~held_out("__id"))
    parts = [own.where(F.col("__label") == c).orderBy(F.xxhash64("__id"), "__id").limit(sample_per_class) for c in (0, 1)]
    sample = F.broadcast(parts[0].union(parts[1]))  # 2 * sample_per_class rows at most
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(f"`{text}`").alias("text"))
    got = rows.join(sample, F.col("id") == F.col("__id")).select(F.xxhash64("text").alias("th"), "__label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 100):
                some = b.slice(s, 100)
                es = [example(words(t.as_py())) for t in some.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array([e.features for e in es], HASHES), pa.array([[{"gone": g, "come": c} for g, c in e.changes] for e in es], CHANGES)],
                    names=["th", "label", "features", "changes"],
                )

    made = cut(got.mapInArrow(run, f"th bigint, label int, {EXAMPLE}").dropDuplicates(["th", "label"]))
    totals = {r.label: r.n for r in made.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not (totals.get(0) and totals.get(1)):
        return fit([Example(np.empty(0, np.int64), [])] * sum(totals.values()), [k for k, n in totals.items() for _ in range(n)], **how)
    n = [F.count_if(F.col("label") == c).cast("double") for c in (0, 1)]
    counts = made.select("label", F.explode("features").alias("f")).groupBy("f").agg(n[0].alias("n0"), n[1].alias("n1")).where("n0 + n1 >= 2")
    z = telling(F.col("n0"), F.col("n1"), F.lit(float(totals[0])), F.lit(float(totals[1])), F.log, F.sqrt)
    known = np.sort(counts.where(F.abs(z) > LEAST_Z).select("f").toArrow()["f"].to_numpy())

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lambda h: np.intersect1d(np.array(h, np.int64), known)
        for b in batches:
            for s in range(0, b.num_rows, 100):
                some = b.slice(s, 100)
                features = [of(f) for f in some.column(2).to_pylist()]
                changes = [[{"gone": of(c["gone"]), "come": of(c["come"])} for c in cs] for cs in some.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(features, HASHES), pa.array(changes, CHANGES)], names=some.schema.names)

    rows = made.mapInArrow(told, f"th bigint, label int, {EXAMPLE}").toArrow().sort_by([("th", "ascending"), ("label", "ascending")])
    examples = [Example(np.array(f, np.int64), [(np.array(c["gone"], np.int64), np.array(c["come"], np.int64)) for c in cs]) for f, cs in zip(rows["features"].to_pylist(), rows["changes"].to_pylist(), strict=True)]
    return fit(examples, rows["label"].to_pylist(), known, **how)


def held_out(id_col: str = "doc_id"):
    """Whether a row is held out of training: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 3 == 1, F.lit(False))


def score_texts(docs: DataFrame, model: Model, keep: list[str], text: str = "text", out: str = "score") -> DataFrame:
    """Columns ``keep`` and the score of each whole text."""
    src = docs.select(*[F.col(f"`{c}`") for c in keep], text_of(f"`{text}`").alias(scratch(docs, "__text")))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]] + [f"`{out}` double"])
    weights, bias = model.weights, model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, memo = Model(weights, bias), {}
        for b in batches:
            s = [own.score(t.as_py(), memo) for t in b.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s, pa.float64())], names=[*keep, out])

    return src.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = 0.7, **how) -> DataFrame:
    """One row per row: id, held_out, score, predicted.

    Null and empty texts have the score of a text without words. Null ids keep their row and are not
    held out; repeated rows score alike; very long texts are read as a whole; without usable labels of both
    kinds all scores are equal. An empty table gives no rows; further columns are ignored.
    """
    model = train(docs, labels, id_col, text, **how)
    return score_texts(docs, model, [id_col], text).select(
        F.col(f"`{id_col}`"), held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = 0.7, **how) -> DataFrame:
    """``docs`` without the rows whose text scores ``threshold`` or more; columns stay as they are."""
    model = train(docs, labels, id_col, text, **how)
    name = scratch(docs, "__score")
    return score_texts(docs, model, docs.columns, text, name).where(F.col(name) < threshold).drop(name)
