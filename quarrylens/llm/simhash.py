"""SimHash near-duplicates by a binary trie self-join.

Fingerprints: 64 bits over word shingles; two texts are linked when their fingerprints differ in at
most ``budget`` bits. The join walks a binary trie over the distinct fingerprints: a pair of nodes is
expanded to the pairs of their children, the bits in which the two paths differ are added up, and a
pair is dropped as soon as they exceed the budget.

On a cluster the walk is dealt out by its top levels. The 64 bits are cut into ``blocks`` segments;
two fingerprints within the budget agree in at least ``blocks - budget`` whole segments. For each
choice of so many segments the trie is built with their bits first, so that only pairs of equal top
nodes can survive there without a difference, and the subtree below a top node is one unit of work.
A subtree with more than ``leaf_rows`` fingerprints is dealt out further as pairs of chunks. Links are
reduced to spanning edges inside each task, so a dense group yields as many edges as members.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, parts_for, scratch, text_of, with_keep

FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Bits of the counters are summed over so many hashes at a time, which bounds memory for any text.
HASH_BLOCK = 65536
SEED = 42
#: Keys of dropped rows that are broadcast at most; with more, texts are exchanged.
BROADCAST_KEYS = 500_000


def fingerprint(text: str | None, width: int = 4) -> int:
    """SimHash of one whole text, as an unsigned 64-bit integer.

    A-Z are lower-cased, words are runs without ASCII white space, shingles have ``width`` words and
    count as often as they occur. A bit is set if it is set in over half of the hashes. Texts with
    fewer words are one shingle; null and texts without words have fingerprint zero.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        spans = [(0, len(joined))]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = ends[: len(words) - width + 1].copy()
        starts[1:] = ends[: len(words) - width]
        starts[0] = 0
        spans = zip(starts.tolist(), (ends[width - 1 :] - 1).tolist(), strict=True)
    h = xxhash.xxh64_intdigest
    total, ones = 0, np.zeros(64, np.int64)
    hashes: list[int] = []
    for s, e in spans:
        hashes.append(h(joined[s:e], SEED))
        if len(hashes) == HASH_BLOCK:
            ones += _ones(hashes)
            total += len(hashes)
            hashes = []
    if hashes:
        ones += _ones(hashes)
        total += len(hashes)
    return int.from_bytes(np.packbits(ones * 2 > total).tobytes(), "big")


def _ones(hashes: list[int]) -> np.ndarray:
    bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
    out = np.zeros(64, np.int64)
    for i in range(0, len(bits), 255):  # sums of bytes that cannot overflow a byte
        out += bits[i : i + 255].sum(axis=0, dtype=np.uint8)
    return out


def with_fingerprint(df: DataFrame, text: str = "text", keep: list[str] | None = None, out: str = "fp", width: int = 4) -> DataFrame:
    """Columns ``keep`` and the fingerprint as a signed long. No shuffle; texts do not come back from Python."""
    keep = keep or []
    src = df.select(*[F.col(f"`{c}`") for c in keep], text_of(text).alias("__text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]] + [f"`{out}` bigint"])

    def run(batches):
        for b in batches:
            fps = np.fromiter((fingerprint(t, width) for t in b.column(len(keep)).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fps.view(np.int64))], names=[*keep, out])

    return src.mapInArrow(run, schema)


def scheme(rows: int, budget: int, leaf_rows: int) -> int:
    """Number of segments: the fewest whose top nodes hold less than ``leaf_rows`` of ``rows`` evenly spread
    fingerprints. All schemes find the same pairs; they differ in how finely the work is dealt out."""
    blocks = budget + 1
    while blocks < 2 * budget and rows / 2.0 ** (64 * (blocks - budget) // blocks) > leaf_rows:
        blocks += 1
    return blocks


def segments(blocks: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each segment."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def top_keys(blocks: int, budget: int) -> list[tuple[int, int]]:
    """For each trie: its number and the mask of the bits that come first."""
    seg = segments(blocks)
    full = (1 << 64) - 1
    masks = []
    for chosen in combinations(range(blocks), blocks - budget):
        m = 0
        for i in chosen:
            lo, w = seg[i]
            m |= ((1 << w) - 1) << lo
        masks.append(m & full)
    return list(enumerate(masks))


def walk(fps: np.ndarray, groups: np.ndarray, sides: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of positions (i < j) in the same group, whose fingerprints differ in at most ``budget``
    bits, found by walking node pairs of the groups' tries. ``sides`` 0: pairs inside the group count;
    1 and 2: only pairs between the two sides."""
    order = np.lexsort((fps, groups))
    f, g, s = fps[order], groups[order], sides[order]
    n = len(f)
    if n < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    heads = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    tails = np.r_[heads[1:], n]
    big = tails - heads > 1
    lo1 = hi_lo = heads[big]
    hi1 = tails[big]
    frontier = [(63, lo1, hi1, hi_lo, hi1, np.zeros(len(lo1), np.int64))]
    found_i, found_j = [], []
    while frontier:
        bit, a0, a1, b0, b1, err = frontier.pop()
        if len(a0) > 200_000:  # bounded work space: the rest waits
            half = len(a0) // 2
            frontier.append((bit, a0[half:], a1[half:], b0[half:], b1[half:], err[half:]))
            a0, a1, b0, b1, err = (x[:half] for x in (a0, a1, b0, b1, err))
        small = (a1 - a0) * (b1 - b0) <= 16
        if bit < 0:
            small[:] = True
        if small.any():
            i, j = _pairs(a0[small], a1[small], b0[small], b1[small])
            ok = np.bitwise_count(f[i] ^ f[j]) <= budget
            i, j = i[ok], j[ok]
            ok = (i < j) & ((s[i] == 0) | (s[i] != s[j]))
            found_i.append(i[ok])
            found_j.append(j[ok])
        go = ~small
        if not go.any():
            continue
        a0, a1, b0, b1, err = a0[go], a1[go], b0[go], b1[go], err[go]
        am, bm = _split(f, a0, a1, bit), _split(f, b0, b1, bit)
        same = a0 == b0
        kids = [
            (a0, am, b0, bm, err),
            (am, a1, bm, b1, err),
            (a0, am, bm, b1, err + 1),
            (am[~same], a1[~same], b0[~same], bm[~same], err[~same] + 1),
        ]
        cols = [np.concatenate(x) for x in zip(*kids, strict=True)]
        live = (cols[0] < cols[1]) & (cols[2] < cols[3]) & (cols[4] <= budget)
        live &= ~((cols[0] == cols[2]) & (cols[1] - cols[0] == 1))
        if live.any():
            frontier.append((bit - 1, *(x[live] for x in cols)))
    if not found_i:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    i, j = order[np.concatenate(found_i)], order[np.concatenate(found_j)]
    return np.minimum(i, j), np.maximum(i, j)


def _pairs(a0, a1, b0, b1):
    """The product of the ranges, one after another."""
    na, nb = a1 - a0, b1 - b0
    size = na * nb
    at = np.repeat(np.cumsum(size) - size, size)
    k = np.arange(size.sum()) - at
    nbr = np.repeat(nb, size)
    return np.repeat(a0, size) + k // nbr, np.repeat(b0, size) + k % nbr


def _split(f: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """First position in each sorted range whose ``bit`` is set; all members agree in the bits above it."""
    lo, hi, mask = lo.copy(), hi.copy(), np.uint64(1 << bit)
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) >> 1
        one = open_.copy()
        one[open_] = (f[mid[open_]] & mask) != 0
        hi = np.where(one, mid, hi)
        lo = np.where(open_ & ~one, mid + 1, lo)


def spanning(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, least member) for the components of the links i-j among n positions."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    who = np.flatnonzero(root != np.arange(n))
    return who, root[who]


def links(distinct: DataFrame, budget: int = 4, leaf_rows: int = 1024, out: str = "fp") -> DataFrame:
    """Edges (a, b) of distinct fingerprints that connect exactly what links within ``budget`` bits connect.

    ``distinct`` has one long column of distinct values. Rows in: each value once per trie, in a large
    subtree once per pair of its chunks. No pair leaves a task but spanning edges.
    """
    rows = distinct.count()
    blocks = scheme(rows, budget, leaf_rows)
    tops = top_keys(blocks, budget)
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keyed = distinct.select(
        F.col(out).alias("fp"),
        F.explode(F.array(*[F.struct(F.lit(t).alias("trie"), F.col(out).bitwiseAND(F.lit(signed(m))).alias("top")) for t, m in tops])).alias("k"),
    ).select("fp", "k.trie", "k.top")
    large = keyed.groupBy("trie", "top").count().where(F.col("count") > leaf_rows)
    large = large.select("trie", "top", F.ceil(F.col("count") / F.lit(leaf_rows)).cast("int").alias("chunks"))
    # each large subtree has over leaf_rows rows, so there are at most rows * tries / leaf_rows of them
    large = cut(large)
    known = large.count()
    if known:
        side = F.broadcast(large) if known <= 50_000 else large
        keyed = keyed.join(side, ["trie", "top"], "left")
    else:
        keyed = keyed.withColumn("chunks", F.lit(None).cast("int"))
    mine = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("chunks")).cast("int")
    # chunk pair (lo, hi): a row goes to every pair that holds its own chunk, as side 0 where both are its own
    others = F.when(F.col("chunks").isNull(), F.array(F.struct(F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(0).cast("tinyint").alias("side")))).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.col("chunks") - 1),
            lambda c: F.struct(
                F.least(c, mine).alias("lo"), F.greatest(c, mine).alias("hi"),
                F.when(c == mine, F.lit(0)).when(mine < c, F.lit(1)).otherwise(F.lit(2)).cast("tinyint").alias("side"),
            ),
        )
    )
    dealt = keyed.withColumn("p", F.explode(others)).select("fp", F.xxhash64("trie", "top", "p.lo", "p.hi").alias("unit"), "trie", "p.side")
    want = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_parts = parts_for(rows * len(tops), 400_000, want)
    masks = {t: m for t, m in tops}

    def run(batches):
        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        t = pa.Table.from_batches(tables)
        fp = t["fp"].to_numpy().view(np.uint64)
        unit, trie, side = t["unit"].to_numpy(), t["trie"].to_numpy(), t["side"].to_numpy()
        who, root = [], []
        for k in np.unique(trie).tolist():
            at = np.flatnonzero(trie == k)
            sub = fp[at]
            i, j = walk(_top_first(sub, masks[k]), unit[at], side[at], budget)
            # equal units of different subtrees (a hash collision) cannot link falsely: distance is exact
            uniq, inv = np.unique(sub, return_inverse=True)
            w, r = spanning(inv[i], inv[j], len(uniq))
            who.append(uniq[w])
            root.append(uniq[r])
        a, b = np.concatenate(who).view(np.int64), np.concatenate(root).view(np.int64)
        for s in range(0, len(a), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(a[s : s + 100_000]), pa.array(b[s : s + 100_000])], names=["a", "b"])

    return dealt.repartition(n_parts, "unit").mapInArrow(run, "a bigint, b bigint")


def _top_first(fps: np.ndarray, mask: int) -> np.ndarray:
    """The fingerprints with the bits of ``mask`` moved to the top, order kept inside and outside it."""
    out = np.zeros_like(fps)
    bits = [b for b in range(63, -1, -1) if mask >> b & 1] + [b for b in range(63, -1, -1) if not mask >> b & 1]
    for to, b in enumerate(bits):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)) << np.uint64(63 - to)
    return out


def _classes(df: DataFrame, id_col: str, text: str, width: int, budget: int, leaf_rows: int) -> tuple[DataFrame, DataFrame]:
    """(id, th, fp) of every row, and (fp, root, keep) of every fingerprint, keep the component's least (no id, id, th)."""
    src = df.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text_of(text)).alias("th"), F.col(f"`{text}`").alias("text"))
    ids = cut(with_fingerprint(src, "text", ["id", "th"], "fp", width))
    small = cut(ids.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("least")))
    edges = cut(links(small.select("fp"), budget, leaf_rows))
    roots = components(edges)
    named = small.join(roots, small.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    return ids, with_keep(named)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 4, budget: int = 4, leaf_rows: int = 1024) -> DataFrame:
    """One row per row of ``df``: id, fingerprint (16 hex digits) and component_id.

    component_id is the smallest id reachable over links, itself included. Null and empty texts have
    fingerprint zero and are linked like any other; equal texts and repeated rows have equal
    fingerprints and one component. A null id takes part and stays null; a component of null ids only
    has a null component_id. An empty table gives no rows; further columns are ignored.
    """
    ids, classes = _classes(df, id_col, text, width, budget, leaf_rows)
    return ids.join(classes, "fp").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("keep.id").alias("component_id")
    )


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 4, budget: int = 4, leaf_rows: int = 1024) -> DataFrame:
    """``df`` with one row of each component: the one whose id is the smallest.

    Where rows share that id, the one whose text has the least hash stays, and one of repeated rows.
    A row with a null id stays only if its component has no other id.
    """
    return drop_by_class(df, *_classes(df, id_col, text, width, budget, leaf_rows), id_col, text)


def drop_by_class(df: DataFrame, ids: DataFrame, classes: DataFrame, id_col: str, text: str) -> DataFrame:
    """``df`` with the row that each class keeps, by (id, th, fp) of every row and (fp, root, keep) of every fp."""
    # what goes is less than what stays, and is known by slim keys; only those meet the texts
    stays = F.col("id").eqNullSafe(F.col("keep.id")) & (F.col("th") == F.col("keep.th"))
    gone = cut(ids.join(classes, "fp").where(~stays).select(F.col("id").alias("__id"), F.col("th").alias("__th")).distinct())
    side = F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone
    th = scratch(df, "__text_hash")
    rows = df.withColumn(th, F.xxhash64(text_of(f"`{text}`")))
    kept = rows.join(side, rows[id_col].eqNullSafe(side["__id"]) & (rows[th] == side["__th"]), "left_anti")
    if ids.groupBy("id", "th").count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates([id_col, th])
    return kept.drop(th)
