"""Embedding near-duplicates over an inverted multi-index.

Unit vectors are cut into halves; each half has a codebook of its own, so k centroids a half make a
grid of k x k cells. A vector lives in the cell of its two nearest centroids. As a query it visits
cells in the order of the multi-sequence traversal (increasing sum of the two squared distances) until
the target recall; the number of cells for it is calibrated on the sample that the codebooks are fitted
on, for neighbours at exactly the threshold, the hardest that count. Every candidate pair is verified
with the exact cosine in double precision, so nothing below the threshold is linked.

Equal vectors are one class from the start. All vectors are indexed and all are queries; a cell with
many members or visitors is dealt out as pairs of chunks, and a task returns counts and spanning edges
instead of pairs.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, parts_for


def multi_sequence(d1: np.ndarray, d2: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cells (i, j) by increasing ``d1[i] + d2[j]``, without looking at more than the frontier."""
    r1, r2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    heap, seen = [(d1[r1[0]] + d2[r2[0]], 0, 0)], {(0, 0)}
    while heap:
        _, a, b = heapq.heappop(heap)
        yield int(r1[a]), int(r2[b])
        for x, y in ((a + 1, b), (a, b + 1)):
            if x < len(r1) and y < len(r2) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (d1[r1[x]] + d2[r2[y]], x, y))


def first_cells(d1: np.ndarray, d2: np.ndarray, cells: int) -> np.ndarray:
    """The first ``cells`` cells of the traversal for many queries at once, as i * k + j, nearest first.

    The cell at ranks (a, b) comes after (a + 1)(b + 1) - 1 others at least, so only ranks with
    (a + 1)(b + 1) <= cells can be among them; these are scored and sorted.
    """
    k = d1.shape[1]
    m = min(k, cells)
    r1, r2 = (np.argsort(d, axis=1, kind="stable")[:, :m] for d in (d1, d2))
    a, b = np.divmod(np.arange(m * m), m)
    near = (a + 1) * (b + 1) <= cells
    a, b = a[near], b[near]
    s1, s2 = np.take_along_axis(d1, r1, 1), np.take_along_axis(d2, r2, 1)
    best = np.argsort(s1[:, a] + s2[:, b], axis=1, kind="stable")[:, :cells]
    return np.take_along_axis(r1, a[best], 1) * k + np.take_along_axis(r2, b[best], 1)


def square_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * x @ c.T, 0)


#: Rows whose distances to all centroids are held at a time.
SLICE = 1024


def codebook(x: np.ndarray, k: int, rounds: int = 12, seed: int = 11) -> np.ndarray:
    """k-means of the rows of ``x``; an empty cluster takes the row farthest from its centroid."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        parts = (square_distances(x[s : s + SLICE], c) for s in range(0, len(x), SLICE))
        own, least = (np.concatenate(z) for z in zip(*((d.argmin(1), d.min(1)) for d in parts), strict=True))
        far = np.argsort(-least)
        for j in range(k):
            mine = own == j
            c[j] = x[mine].mean(0) if mine.any() else x[far[j % len(far)]]
    return c


class MultiIndex:
    """The two codebooks and the number of cells a query visits."""

    def __init__(self, sample: np.ndarray, k: int, threshold: float, recall: float):
        self.dim = sample.shape[1]
        self.half = self.dim // 2
        self.k = k
        self.books = [codebook(sample[:, : self.half], k), codebook(sample[:, self.half :], k)]
        self.cells = self.calibrated(sample, threshold, recall)

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return square_distances(x[:, : self.half], self.books[0]), square_distances(x[:, self.half :], self.books[1])

    def visits(self, x: np.ndarray, cells: int | None = None) -> np.ndarray:
        return np.concatenate([first_cells(*self.distances(x[s : s + SLICE]), cells or self.cells) for s in range(0, max(1, len(x)), SLICE)])

    def calibrated(self, sample: np.ndarray, threshold: float, recall: float) -> int:
        """Cells to visit so that a share ``recall`` of neighbours at exactly ``threshold`` lies in one of them."""
        rng = np.random.default_rng(5)
        x = sample[rng.choice(len(sample), min(len(sample), 1000), replace=False)]
        n = rng.normal(size=x.shape)
        n -= (n * x).sum(1)[:, None] * x
        y = threshold * x + np.sqrt(1 - threshold**2) * n / np.maximum(np.linalg.norm(n, axis=1)[:, None], 1e-12)
        home = self.visits(y, 1)[:, 0]
        d1, d2 = self.distances(x)
        at = (np.take_along_axis(d1, (home // self.k)[:, None], 1) + np.take_along_axis(d2, (home % self.k)[:, None], 1))[:, 0]
        sums = np.sort(d1, 1)
        other = np.sort(d2, 1)
        rank = np.array([(np.searchsorted(o, a - s, side="right")).sum() for s, o, a in zip(sums, other, at, strict=True)])
        return int(np.clip(np.quantile(rank, recall), 1, self.k * self.k))


def unit_rows(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    return x / np.linalg.norm(x, axis=1)[:, None]


def as_raw(df: DataFrame, id_col: str, vector: str, label: str) -> DataFrame:
    """(id, label, raw): the vector as little-endian doubles, null where it can link with nothing."""
    src = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = []
            for v, lab in zip(b.column(2), b.column(1), strict=True):
                ok = v.is_valid and lab.is_valid and len(v) and v.values.null_count == 0
                x = v.values.to_numpy(zero_copy_only=False) + 0.0 if ok else None
                raw.append(x.tobytes() if ok and np.isfinite(x).all() and (x != 0).any() else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(raw, pa.binary())], names=["id", "label", "raw"])

    kinds = dict(src.dtypes)
    return src.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, raw binary")


def cosine_links(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.93, recall: float = 0.97, sample_rows: int = 65536, leaf_rows: int = 1024, per_cell: int = 64) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Vectors are compared where labels (and lengths) are equal. Null, empty and zero vectors, vectors with
    a null or non-finite component and null labels link with nothing: n_links 0, component_id their own
    id, kept. Repeated rows and equal vectors link with one another. A null id takes part; component_id
    is the least id that is not null, and kept is false for a null id. Each half's codebook has as many centroids as
    leave about ``per_cell`` distinct vectors in a cell of the grid, and is fitted on 16 vectors a centroid, those with the least hash, 4,096
    at least and ``sample_rows`` at most; every vector is indexed and is a query. Further columns are
    ignored. An empty table gives no rows.
    """
    spark = df.sparkSession
    rows = cut(as_raw(df, id_col, vector, label).withColumn("md", F.unhex(F.md5("raw"))))
    classes = rows.where("raw is not null").groupBy("label", "md").agg(F.count("*").alias("size"), F.min("id").alias("least"), F.min("raw").alias("raw"))
    classes = cut(classes.withColumn("rep", F.monotonically_increasing_id()))
    alone = rows.where("raw is null").select(
        F.col("id").alias(id_col), F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept")
    )
    dims = [r[0] for r in classes.select(F.length("raw").alias("d")).distinct().collect()]  # lengths of vectors in one column: a few
    found = None
    for d in sorted(dims):
        part = _found(classes.where(F.length("raw") == d), d // 8, threshold, recall, sample_rows, leaf_rows, per_cell)
        found = part if found is None else found.union(part)
    if found is None:
        return alone
    found = cut(found.groupBy("rep", "root").agg(F.sum("n").alias("n")))
    roots = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    more = found.groupBy("rep").agg(F.sum("n").alias("n"))
    of = classes.join(more, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    of = of.select("label", "md", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "least", F.coalesce("root", "rep").alias("root"))
    of_root = of.groupBy("root").agg(F.min("least").alias("component_id"))
    of = of.join(of_root, "root").drop("root", "least")
    linked = rows.where("raw is not null").join(of, ["label", "md"]).select(
        F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept")
    )
    return linked.union(alone)


def _found(classes: DataFrame, dim: int, threshold: float, recall: float, sample_rows: int, leaf_rows: int, per_cell: int) -> DataFrame:
    """(rep, root, n): for each task and class with links in it, its links and the least class it is connected to there."""
    spark = classes.sparkSession
    total = classes.count()
    # the sample: a documented bound, by hash, so that it does not depend on how rows are dealt
    k = round((total / per_cell) ** 0.5)
    got = classes.select("raw").orderBy(F.xxhash64("raw"), "raw").limit(min(sample_rows, max(4096, 16 * k))).collect()
    sample = unit_rows([bytes(r.raw) for r in got])
    k = int(np.clip(k, 1, max(1, len(sample) // 16)))
    index = MultiIndex(sample, k, threshold, recall) if dim > 1 else None
    cells = index.cells if index else 1

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = index.visits(unit_rows(b.column(2).to_pylist())) if index else np.zeros((b.num_rows, 1), np.int64)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(v.astype(np.int32)), pa.list_(pa.int32()))], names=[*b.schema.names, "visits"])

    kind = dict(classes.dtypes)["label"]
    placed = classes.select("rep", "label", "raw", "size")
    placed = cut(placed.mapInArrow(place, f"rep bigint, label {kind}, raw binary, size bigint, visits array<int>"))
    seen = placed.select("label", F.posexplode("visits").alias("nth", "cell"))
    load = seen.groupBy("label", "cell").agg(F.count("*").alias("visitors"), F.count_if(F.col("nth") == 0).alias("members")).where("members > 0")
    chunk = lambda c: F.ceil(F.col(c) / F.lit(leaf_rows)).cast("int")
    load = cut(load.select("label", "cell", chunk("visitors").alias("cv"), chunk("members").alias("cm")))
    small = load.count() <= 50_000
    side = F.broadcast(load) if small else load
    mine = lambda n, seed: F.pmod(F.xxhash64("rep", F.lit(seed)), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    as_visitor = (
        placed.select("rep", "label", "raw", "size", F.explode("visits").alias("cell"), F.col("visits")[0].alias("home"))
        .join(side, ["label", "cell"]).withColumn("cj", mine("cv", 3)).withColumn("ci", spread("cm"))
        .select("rep", "label", "raw", "size", "cell", "home", "ci", "cj", F.lit(None).cast("array<int>").alias("visits"))
    )
    as_member = (
        placed.select("rep", "label", "raw", "size", F.col("visits")[0].alias("cell"), F.col("visits")[0].alias("home"), "visits")
        .join(side, ["label", "cell"]).withColumn("ci", mine("cm", 3)).withColumn("cj", spread("cv"))
        .select("rep", "label", "raw", "size", "cell", "home", "ci", "cj", "visits")
    )
    dealt = as_visitor.union(as_member).select("rep", "raw", "size", "home", "visits", F.xxhash64("label", "cell", "ci", "cj").alias("unit"))
    n_parts = parts_for(total * (cells + 1), 100_000, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        t = pa.Table.from_batches(tables).combine_chunks()
        unit = t["unit"].to_numpy()
        member = t["visits"].is_valid().to_numpy()
        rep, size, home = (t[c].to_numpy() for c in ("rep", "size", "home"))
        raw, visits = t["raw"].chunk(0), t["visits"].chunk(0)
        order = np.lexsort((rep, unit))
        edges = np.flatnonzero(np.r_[True, np.diff(unit[order]) != 0, True])
        for s, e in zip(edges, edges[1:], strict=False):
            at = order[s:e]
            q, m = at[~member[at]], at[member[at]]
            if not len(q) or not len(m):
                continue
            x = unit_rows(raw.take(pa.array(q)).to_pylist())
            y = unit_rows(raw.take(pa.array(m)).to_pylist())
            i, j = np.nonzero(x @ y.T >= threshold)
            apart = rep[q[i]] != rep[m[j]]
            i, j = i[apart], j[apart]
            if not len(i):
                continue
            # a pair that both sides find counts where the visitor is the smaller
            seen = np.array(visits.take(pa.array(m)).to_pylist())
            both = np.zeros(len(i), bool)
            for c in range(seen.shape[1]):
                both |= seen[j, c] == home[q[i]]
            count = ~both | (rep[q[i]] < rep[m[j]])
            i, j = q[i[count]], m[j[count]]
            if not len(i):
                continue
            who, inv = np.unique(np.r_[rep[i], rep[j]], return_inverse=True)
            n = np.zeros(len(who), np.int64)
            np.add.at(n, inv[: len(i)], size[j])
            np.add.at(n, inv[len(i) :], size[i])
            root = _least(inv[: len(i)], inv[len(i) :], len(who))
            yield pa.RecordBatch.from_pydict({"rep": who, "root": who[root], "n": n})

    return dealt.repartition(n_parts, "unit").mapInArrow(verify, "rep bigint, root bigint, n bigint")


def _least(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the least it is connected to."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        for at in (i, j, root[i], root[j]):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new
