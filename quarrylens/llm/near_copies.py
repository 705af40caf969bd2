"""Near copies by the Jaccard similarity of their word shingles, found by SimHash tries.

Each text is the set of its hashed five-word shingles; two texts are linked when their sets have a
Jaccard similarity of at least ``threshold``. Candidates come from the method of ``simhash``, with fingerprints
wide enough for that similarity: a bit of the SimHash differs between such sets with a chance of ``disagreement``
(0.16 at 0.8), so each set has ``BITS`` of them. Every trie is built over ``OWN`` bits drawn for it. Sets with equal
top levels are dealt to one unit, which walks pairs of nodes, adds up the bits in which their paths differ and drops
a pair beyond ``LEVELS``; whole drawn fingerprints within ``CAP`` bits are candidates. ``n_tries`` tries make the chance
that a link at exactly the threshold meets in none of them at most ``MISS``, higher similarities with less.
Candidates, directly or through others, make a group. In each group all pairs are compared by their whole sets, so no
link is false. A group with more than ``leaf_rows`` texts is dealt out as pairs of chunks, as a large unit of a trie is.
Links are reduced to spanning edges inside each task.
"""

from __future__ import annotations

from functools import cache
from math import ceil, comb, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, cut, parts_for, text_of, with_keep
from .simhash import BROADCAST_KEYS, FOLD, SEED, _split, drop_by_class, spanning

BITS, OWN, CAP = 1024, 192, 47
#: Bits in which two paths may differ so many levels below the top nodes, and in the 64 levels of a trie.
FIRST = 18
LEVELS = [2 + d // 4 for d in range(17)] + [FIRST] * 48
MISS = 5e-6
#: Node pairs with fewer rows on each side are compared row by row.
NODE = 128
#: Bits are counted over so many shingles at a time, which bounds memory for any text and cannot overflow a byte.
SHINGLE_BLOCK = 255
_STEPS = np.arange(1, BITS // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of one whole text.

    Words are those of the fingerprint; a text with fewer words than ``width`` is one shingle, one
    without words has none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()
    if not words:
        return np.empty(0, np.uint64)
    h = xxhash.xxh64_intdigest
    n = max(1, len(words) - width + 1)
    return np.unique(np.fromiter((h(b" ".join(words[i : i + width]), SEED) for i in range(n)), np.uint64, n))


def fingerprint(shingles: np.ndarray) -> np.ndarray:
    """SimHash of a shingle set, ``BITS`` bits as bytes: a bit is set if it is set in over half of the shingles' hashes."""
    ones = np.zeros(BITS, np.int64)
    for s in range(0, len(shingles), SHINGLE_BLOCK):
        z = shingles[s : s + SHINGLE_BLOCK, None] + _STEPS
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        ones += np.unpackbits(z.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(shingles))


@cache
def disagreement(threshold: float, least: int, most: int) -> float:
    """The largest chance that a bit differs between sets that share a part of ``threshold`` or more, the larger one
    of ``least`` to ``most`` shingles. All cases of up to 64 shared shingles; more of them do not exceed the largest of these."""
    worst = 0.0
    for both in range(1, min(most, 64) + 1):
        shared = np.array([comb(both, i) / 2**both for i in range(both + 1)])
        for x in range(both):
            for y in range(max(x, 1), both):
                if not least <= both + y <= most or both / (both + x + y) < threshold:
                    continue
                a, b = (np.array([sum(comb(e, i) for i in range(e + 1) if 2 * (v + i) > both + e) / 2**e for v in range(both + 1)]) for e in (x, y))
                worst = max(worst, float((shared * (a * (1 - b) + b * (1 - a))).sum()))
    return worst


@cache
def n_tries(top: int, p: float) -> int:
    """Tries with ``top`` bits in their top nodes, so that two fingerprints whose bits differ with chance ``p`` meet in
    none with a chance of at most ``MISS``. Tries draw from the same bits, so the number of those that differ is fixed first."""
    d = np.arange(BITS + 1)
    met = np.zeros((BITS + 1, CAP + 1))  # by the number of bits that differ in all: chance of so many in the path, not yet dropped
    met[:, 0] = 1
    for drawn in range(OWN):
        one = np.clip((d[:, None] - np.arange(CAP + 1)) / (BITS - drawn), 0, 1)
        nxt = met * (1 - one)
        nxt[:, 1:] += (met * one)[:, :-1]
        allowed = CAP if drawn >= 64 else LEVELS[drawn + 1 - top] if drawn >= top else 0
        nxt[:, allowed + 1 :] = 0
        met = nxt
    missed = 1 - np.clip(met.sum(axis=1), 0, 1)
    chance = np.array([float(comb(BITS, int(k)) * (p**int(k)) * ((1 - p) ** (BITS - int(k)))) if k < BITS // 2 else 0.0 for k in d])
    high = 1
    while (chance * missed**high).sum() > MISS:
        high *= 2
    low = high // 2
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if (chance * missed**mid).sum() > MISS else (low, mid)
    return high


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def similar(sets: list[np.ndarray], sides: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of positions (i < j) with a Jaccard similarity of at least ``threshold``. ``sides`` 0: pairs
    inside count; 1 and 2: only pairs between the two sides."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    _, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), size)[np.argsort(at, kind="stable")]
    first = np.r_[0, np.cumsum(np.bincount(at))]
    ends = np.cumsum(size)
    found_i, found_j = [], []
    for i in range(n - 1):
        own = at[ends[i] - size[i] : ends[i]]
        count = first[own + 1] - first[own]
        places = np.arange(count.sum()) + np.repeat(first[own] - np.cumsum(count) + count, count)
        both = np.bincount(owner[places], minlength=n)[i + 1 :]
        j = np.flatnonzero((both > 0) & (both / np.maximum(1, size[i] + size[i + 1 :] - both) >= threshold)) + i + 1
        j = j[(sides[j] == 0) | (sides[j] != sides[i])]
        found_i.append(np.full(len(j), i))
        found_j.append(j)
    empty = np.empty(0, np.int64)
    return np.concatenate([empty, *found_i]), np.concatenate([empty, *found_j])


def with_fingerprint(df: DataFrame, width: int = 5) -> DataFrame:
    """(id, th, fp, n, bits) of (id, th, text), ``fp`` a hash of the shingle set, ``n`` its size. No shuffle; texts do not come back from Python."""

    def run(batches):
        for b in batches:
            sets = [shingle_set(t.as_py(), width) for t in b.column(2)]
            fps = pa.array([_signed(xxhash.xxh64_intdigest(s.tobytes(), SEED)) for s in sets], pa.int64())
            bits = pa.array([fingerprint(s).tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), fps, pa.array([len(s) for s in sets], pa.int64()), bits], names=["id", "th", "fp", "n", "bits"])

    return df.mapInArrow(run, f"id {dict(df.dtypes)['id']}, th bigint, fp bigint, n bigint, bits binary")


def may_link(n: np.ndarray, m: np.ndarray, threshold: float) -> np.ndarray:
    """Whether distinct sets of these sizes can have a similarity of at least ``threshold``."""
    both = np.minimum(n, m) - (n == m)
    return both / np.maximum(1, n + m - both) >= threshold


def walk(words: np.ndarray, n: np.ndarray, sides: np.ndarray, top: int, threshold: float) -> np.ndarray:
    """For each row of one unit the least position that candidates connect it with.

    ``words`` is (rows, OWN / 64), the trie over the bits of the first, below its ``top`` bits. ``sides`` as in ``similar``.
    Nodes that are connected already are not walked again, so that a dense group costs about its rows.
    """
    order = np.argsort(words[:, 0], kind="stable")
    f, size, side = words[order], n[order], sides[order]
    rows = len(f)
    label = np.arange(rows)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    seen: list[tuple[np.ndarray, np.ndarray]] = []
    waiting = unchecked = 0

    def merge():
        nonlocal label, changes, waiting
        i, j = (np.concatenate([e[k] for e in found] + [np.flatnonzero(label != np.arange(rows)) if k == 0 else label[label != np.arange(rows)]]) for k in (0, 1))
        who, root = spanning(i, j, rows)
        label = np.arange(rows)
        label[who] = root
        changes = np.r_[0, np.cumsum(label[1:] != label[:-1])]
        found.clear()
        waiting = 0

    def check(i, j):
        nonlocal waiting
        ok = (label[i] != label[j]) & ((side[i] == 0) | (side[i] != side[j])) & may_link(size[i], size[j], threshold)
        i, j = i[ok], j[ok]
        ok = np.bitwise_count(f[i] ^ f[j]).sum(axis=1, dtype=np.int64) <= CAP
        found.append((i[ok], j[ok]))
        waiting += int(ok.sum())

    def flush():
        nonlocal unchecked
        if seen:
            i, j = (np.concatenate(e) for e in zip(*seen, strict=True))
            check(i[i < j], j[i < j])
            seen.clear()
            unchecked = 0
            if waiting > 100_000:
                merge()

    changes = np.zeros(rows, np.int64)
    for step in range(1, 9):
        check(np.arange(rows - step), np.arange(step, rows))
    merge()
    first = np.ascontiguousarray(f[:, 0])
    whole, none = np.array([0]), np.array([0])
    frontier = [(63 - top, whole, np.array([rows]), whole, np.array([rows]), none)]
    while frontier:
        bit, a0, a1, b0, b1, err = frontier.pop()
        if len(a0) > 50_000:  # bounded work space: the rest waits
            frontier.append((bit, a0[50_000:], a1[50_000:], b0[50_000:], b1[50_000:], err[50_000:]))
            a0, a1, b0, b1, err = (x[:50_000] for x in (a0, a1, b0, b1, err))
        open_ = ~((changes[a0] == changes[a1 - 1]) & (changes[b0] == changes[b1 - 1]) & (label[a0] == label[b0]))
        a0, a1, b0, b1, err = (x[open_] for x in (a0, a1, b0, b1, err))
        small = (np.maximum(a1 - a0, b1 - b0) <= NODE) | (bit < 0)
        for p0, p1, q0, q1 in zip(a0[small].tolist(), a1[small].tolist(), b0[small].tolist(), b1[small].tolist(), strict=True):
            for s in range(p0, p1, 1024):
                for t in range(max(s, q0) if p0 == q0 else q0, q1, 1024):  # below the last level a node has any number of rows
                    near = np.bitwise_count(first[s : min(p1, s + 1024), None] ^ first[None, t : min(q1, t + 1024)]) <= FIRST
                    i, j = np.nonzero(near)
                    if len(i):
                        seen.append((i + s, j + t))
                        unchecked += len(i)
                    if unchecked > 20_000:
                        flush()
        flush()
        go = ~small
        if not go.any():
            continue
        a0, a1, b0, b1, err = (x[go] for x in (a0, a1, b0, b1, err))
        am, bm = _split(first, a0, a1, bit), _split(first, b0, b1, bit)
        other = a0 != b0
        kids = [
            (a0, am, b0, bm, err),
            (am, a1, bm, b1, err),
            (a0, am, bm, b1, err + 1),
            (am[other], a1[other], b0[other], bm[other], err[other] + 1),
        ]
        cols = [np.concatenate(x) for x in zip(*kids, strict=True)]
        live = (cols[0] < cols[1]) & (cols[2] < cols[3]) & (cols[4] <= LEVELS[64 - top - bit])
        if live.any():
            frontier.append((bit - 1, *(x[live] for x in cols)))
    merge()
    out = np.empty(rows, np.int64)
    out[order] = order[label]
    return out


def chunk_pairs(chunks: Column, mine: Column) -> Column:
    """Chunk pairs (lo, hi): a row goes to every pair that holds its own chunk, as side 0 where both are its own; one pair without chunks."""
    return F.when(chunks.isNull(), F.array(F.struct(F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(0).cast("tinyint").alias("side")))).otherwise(
        F.transform(
            F.sequence(F.lit(0), chunks - 1),
            lambda c: F.struct(
                F.least(c, mine).alias("lo"), F.greatest(c, mine).alias("hi"),
                F.when(c == mine, F.lit(0)).when(mine < c, F.lit(1)).otherwise(F.lit(2)).cast("tinyint").alias("side"),
            ),
        )
    )


def candidates(sets: DataFrame, threshold: float, unit_rows: int) -> DataFrame:
    """Edges (a, b) that connect the candidates among ``sets`` (fp, n, bits), each shingle set once.

    Top nodes have ``unit_rows`` rows on average at most; one with over four times as many is dealt out as pairs of chunks.
    """
    smallest = next(c for c in range(1, 1 << 20) if c / (c + 1) >= threshold)  # smaller sets equal whatever they are linked with
    few = smallest + 1
    sets = sets.where(F.col("n") >= smallest).select("fp", "n", "bits")
    rows = sets.count()
    top = min(40, max(0, ceil(log2(max(1, rows) / unit_rows))))
    many = n_tries(top, disagreement(threshold, few + 1, 1 << 20))
    tries = max(many, n_tries(top, disagreement(threshold, few, few)))
    draws = [np.random.default_rng([SEED, t]).permutation(BITS)[:OWN] for t in range(tries)]

    def deal(batches, slim):
        for b in batches:
            if not b.num_rows:
                continue
            fps, n = b.column(0).to_numpy(), b.column(1).to_numpy()
            bits = np.ascontiguousarray(np.unpackbits(np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(len(n), -1), axis=1).T)
            small = np.flatnonzero(n <= few)
            for t, drawn in enumerate(draws):  # the last tries are for the smallest sets, whose bits differ more
                at = np.arange(len(n)) if t < many else small
                if not len(at):
                    continue
                own = bits[drawn] if t < many else bits[drawn][:, at]
                words = np.ascontiguousarray(np.packbits(own, axis=0).T).view(">u8").astype(np.uint64)
                key = (words[:, 0] >> np.uint64(64 - top) if top else np.zeros(len(at), np.uint64)).astype(np.int64) + (t << 40)
                if slim:
                    keys, count = np.unique(key, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(count)], names=["key", "rows"])
                else:
                    cols = [fps[at], key, n[at], *words.view(np.int64).T]
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], names=["fp", "key", "n", "w0", "w1", "w2"])

    large = sets.mapInArrow(lambda batches: deal(batches, True), "key bigint, rows bigint").groupBy("key").agg(F.sum("rows").alias("rows"))
    large = cut(large.where(F.col("rows") > 4 * unit_rows).select("key", F.ceil(F.col("rows") / F.lit(2 * unit_rows)).cast("int").alias("chunks")))
    keyed = sets.mapInArrow(lambda batches: deal(batches, False), "fp bigint, key bigint, n bigint, w0 bigint, w1 bigint, w2 bigint")
    known = large.count()
    if known:
        keyed = keyed.join(F.broadcast(large) if known <= 50_000 else large, "key", "left")
        pair = F.explode(chunk_pairs(F.col("chunks"), F.pmod(F.xxhash64("fp", F.lit(7)), F.col("chunks")).cast("int")))
        keyed = keyed.withColumn("p", pair).select("fp", F.xxhash64("key", "p.lo", "p.hi").alias("unit"), "p.side", "n", "w0", "w1", "w2")
    else:
        keyed = keyed.select("fp", F.xxhash64("key", F.lit(0), F.lit(0)).alias("unit"), F.lit(0).cast("tinyint").alias("side"), "n", "w0", "w1", "w2")
    n_parts = parts_for(rows * tries, 200_000, int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches):
        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        t = pa.Table.from_batches(tables)
        fps, units, n, sides = (t[c].to_numpy() for c in ("fp", "unit", "n", "side"))
        words = np.stack([t[c].to_numpy().view(np.uint64) for c in ("w0", "w1", "w2")], axis=1)
        order = np.lexsort((fps, units))  # the least position of a unit is its least set
        heads = np.flatnonzero(np.r_[True, np.diff(units[order]) != 0, True])
        for s, e in zip(heads[:-1].tolist(), heads[1:].tolist(), strict=True):
            at = order[s:e]
            if e - s > 1:
                root = least_of(walk(words[at], n[at], sides[at], top, threshold))
                who = np.flatnonzero(root != np.arange(e - s))
                if len(who):
                    yield pa.RecordBatch.from_arrays([pa.array(fps[at[who]]), pa.array(fps[at[root[who]]])], names=["a", "b"])

    return keyed.repartition(n_parts, "unit").mapInArrow(run, "a bigint, b bigint")


def least_of(label: np.ndarray) -> np.ndarray:
    """For each position the least one of its label."""
    least = np.full(len(label), len(label))
    np.minimum.at(least, label, np.arange(len(label)))
    return least[label]


def links(src: DataFrame, sets: DataFrame, width: int, threshold: float, leaf_rows: int) -> DataFrame:
    """Edges (a, b) of distinct shingle sets that connect exactly what similar pairs inside the candidate groups connect.

    ``src`` is (id, th, text); ``sets`` is (fp, least, n, bits), each shingle set once with the row that stands for it.
    """
    # a set's tries lead to the least sets of their units; the least of these stands for all, so that a
    # dense group has about one edge for each member
    led = candidates(sets, threshold, 16 * leaf_rows).groupBy("a").agg(F.collect_set("b").alias("lows"))
    led = cut(led.select(F.col("a").alias("fp"), "lows", F.array_min("lows").alias("b")))
    near = led.select(F.col("fp").alias("a"), "b").union(led.select(F.explode("lows").alias("a"), "b"))
    near = cut(near.where("a <> b").distinct())
    groups = components(near)
    large = cut(groups.groupBy("root").count().where(F.col("count") > leaf_rows).select("root", F.ceil(F.col("count") / F.lit(leaf_rows)).cast("int").alias("chunks")))
    members = groups.join(F.broadcast(large) if large.count() <= 50_000 else large, "root", "left")
    members = members.join(sets.select("fp", "least"), members.node == F.col("fp"))
    members = cut(members.select("fp", "root", "chunks", F.col("least.id").alias("mid"), F.col("least.th").alias("mth")))
    known = members.count()
    rows = src.join(F.broadcast(members) if known <= BROADCAST_KEYS else members, src.id.eqNullSafe(F.col("mid")) & (src.th == F.col("mth")))
    mine = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("chunks")).cast("int")
    dealt = rows.withColumn("p", F.explode(chunk_pairs(F.col("chunks"), mine))).select("fp", F.xxhash64("root", "p.lo", "p.hi").alias("unit"), "p.side", "text")
    n_parts = parts_for(known, 4_000, int(src.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches):
        units: dict[int, dict[int, tuple[int, np.ndarray]]] = {}
        for b in batches:
            for fp, unit, at, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                units.setdefault(unit, {}).setdefault(fp, (at, shingle_set(text, width)))
        for of in units.values():
            fps = np.fromiter(of, np.int64, len(of))
            i, j = similar([s for _, s in of.values()], np.array([a for a, _ in of.values()]), threshold)
            w, r = spanning(i, j, len(fps))
            if len(w):
                yield pa.RecordBatch.from_arrays([pa.array(fps[w]), pa.array(fps[r])], names=["a", "b"])

    return dealt.repartition(n_parts, "unit").mapInArrow(run, "a bigint, b bigint")


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 5, threshold: float = 0.8, leaf_rows: int = 512) -> DataFrame:
    """``df`` with one row of each component of similar texts: the one whose id is the smallest.

    Null, empty and blank texts are equal. Rows that share that id, repeated rows and null ids are treated
    as ``drop_near_duplicates`` treats them. An empty table gives no rows.
    """
    src = df.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text_of(f"`{text}`")).alias("th"), text_of(f"`{text}`").alias("text"))
    rows = cut(with_fingerprint(src, width))
    sets = cut(rows.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("least"), F.first("n").alias("n"), F.first("bits").alias("bits")))
    roots = components(cut(links(src, sets, width, threshold, leaf_rows)))
    named = sets.join(roots, sets.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    classes = with_keep(named)
    return drop_by_class(df, rows.select("id", "th", "fp"), classes, id_col, text)
