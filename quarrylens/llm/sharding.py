"""Shards of near-equal bytes by histogram sort.

Rows are ordered by (hash of the text, hash of the id), so equal texts lie together. Splitters are
found before any row moves: exact bytes and rows are counted below candidate boundaries of the key
space, partition by partition with partial sums, and only the bins in which a splitter still falls are
probed again with finer boundaries, until every splitter is within tolerance. Then rows are exchanged
once, straight to the partition that the splitters name; counts of the histogram give each partition's
first slot, so no further exchange numbers the rows.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, scratch, text_of

FIRST_BITS = 16
STEP_BITS = 8
LEAST = -(1 << 63)


def text_size(text: str = "text") -> Column:
    """UTF-8 bytes of the text (null: none) plus 16."""
    return (F.octet_length(text_of(f"`{text}`")) + 16).cast("bigint")


def _bins(keys: DataFrame, level: int, active: list[tuple]) -> list[tuple]:
    """(prefixes of both keys, bytes, rows, whether no finer boundary can divide it) at a level, for the bins named in ``active``.

    Levels: 0 is the first FIRST_BITS of the first key, later ones STEP_BITS more each; after 64 bits the
    second key goes on. What reaches the driver is bounded: 2^FIRST_BITS rows at first, then
    2^STEP_BITS for each bin that a splitter falls in.
    """
    unsigned = lambda c: F.col(c).bitwiseXOR(F.lit(LEAST))
    top = lambda c, bits: F.shiftrightunsigned(unsigned(c), 64 - bits) if bits else F.lit(0).cast("bigint")
    b1, b2 = bits_at(level)
    if level == 0:
        got = keys.groupBy(top("k1", b1).alias("v1"), F.lit(0).cast("bigint").alias("v2"))
    else:
        p1, p2 = bits_at(level - 1)
        spark = keys.sparkSession
        names = spark.createDataFrame([(a[0], a[1]) for a in active], "p1 bigint, p2 bigint")
        mine = keys.withColumns({"p1": top("k1", p1), "p2": top("k2", p2)}).join(F.broadcast(names), ["p1", "p2"])
        got = mine.groupBy(top("k1", b1).alias("v1"), top("k2", b2).alias("v2"))
    alike = (F.min("k1") == F.max("k1")) & (F.min("k2") == F.max("k2"))
    rows = got.agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), alike.alias("alike")).collect()
    return sorted((_u(r.v1), _u(r.v2), r.bytes, r.rows, r.alike) for r in rows)


def _u(v: int) -> int:
    return v & ((1 << 64) - 1)


def _s(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def bits_at(level: int) -> tuple[int, int]:
    """Bits of the two keys that a level tells apart."""
    n = FIRST_BITS + level * STEP_BITS
    return min(n, 64), max(0, n - 64)


LAST_LEVEL = (128 - FIRST_BITS) // STEP_BITS


def splitters(keys: DataFrame, shards: int, tolerance: float, part_bytes: int, max_parts: int) -> tuple[list[tuple[int, int]], list[int], list[int]]:
    """Boundaries (k1, k2) in key order, and for each part its shard and the rows before it.

    A shard boundary is within ``tolerance`` of a shard's bytes of its ideal place, or is the nearest place
    between two rows. Parts cut shards further for the exchange, by bytes and rows alike.
    """
    bins = _bins(keys, 0, [])
    total, count = sum(b[2] for b in bins), sum(b[3] for b in bins)
    if not count:
        return [], [0], [0]
    parts = int(min(max_parts, max(4 * shards, -(-total // part_bytes))))
    by_bytes = lambda b, r: b
    by_both = lambda b, r: b * count + r * total
    # (measure, ideal value, slack, is a shard boundary, number)
    wanted = [(by_bytes, total * i // shards, tolerance * total / shards, i) for i in range(1, shards)]
    wanted += [(by_both, 2 * total * count * i // parts, total * count / (2 * parts), 0) for i in range(1, parts)]
    found: list[tuple[int, int, int, int]] = []  # (k1, k2, rows before, shard number or 0), keys unsigned
    level, open_bins = 0, {None: ((0, 0), bins, wanted)}
    while open_bins:
        b1, b2 = bits_at(level)
        nxt: dict[tuple, tuple] = {}
        for (before_b, before_r), own, want in open_bins.values():
            cum, edges = (before_b, before_r), []
            for v1, v2, b, r, alike in own:
                edges.append((v1, v2, *cum, b, r, alike))
                cum = (cum[0] + b, cum[1] + r)
            for measure in (by_bytes, by_both):
                starts = [measure(e[2], e[3]) for e in edges]
                for w in (w for w in want if w[0] is measure):
                    at = max(0, bisect_right(starts, w[1]) - 1)
                    v1, v2, cb, cr, b, r, alike = edges[at]
                    low, high = w[1] - starts[at], measure(cb + b, cr + r) - w[1]
                    if min(low, high) > w[2] and not alike and level < LAST_LEVEL:
                        nxt.setdefault((v1, v2), ((cb, cr), [], []))[2].append(w)
                    elif low <= high:
                        found.append((v1 << (64 - b1), v2 << (64 - b2) if b2 else 0, cr, w[3]))
                    else:
                        v1, v2 = _after(v1, v2, b1, b2)
                        found.append((v1 << (64 - b1), v2 << (64 - b2) if b2 else 0, cr + r, w[3]))
        level += 1
        if nxt:
            b1, b2 = bits_at(level - 1)
            c1, c2 = bits_at(level)
            for found_bin in _bins(keys, level, [(_s(v1), _s(v2)) for v1, v2 in nxt]):
                nxt[found_bin[0] >> (c1 - b1), found_bin[1] >> (c2 - b2)][1].append(found_bin)
        open_bins = nxt
    found.sort(key=lambda f: (f[0], f[1], f[2], f[3]))
    edges, shard_of, first = [], [0], [0]
    shard = 0
    for k1, k2, before, number in found:
        shard = max(shard, number)
        edge = (k1, k2)
        if edges and edges[-1] == edge:
            shard_of[-1] = shard
        else:
            edges.append(edge)
            shard_of.append(shard)
            first.append(before)
    return [(_s(a ^ (1 << 63)) if a < 1 << 64 else None, _s(b ^ (1 << 63))) for a, b in edges], shard_of, first


def equal_rows(keys: DataFrame, shards: int, tolerance: float) -> DataFrame | None:
    """(k1, k2) of the rows with equal keys that outweigh the tolerance together, at most shards / tolerance of them; None if there are none."""
    bins = _bins(keys, 0, [])
    slack = tolerance * sum(b[2] for b in bins) / shards
    heavy = [(_s(b[0]),) for b in bins if b[2] > slack and b[3] > 1]
    if not heavy:
        return None
    top = F.shiftrightunsigned(F.col("k1").bitwiseXOR(F.lit(LEAST)), 64 - FIRST_BITS)
    side = keys.sparkSession.createDataFrame(heavy, "__top bigint")
    groups = keys.join(F.broadcast(side), top == F.col("__top"), "left_semi").groupBy("k1", "k2").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    found = cut(groups.where((F.col("bytes") > slack) & (F.col("n") > 1)).select("k1", "k2"))
    return found if found.limit(1).count() else None


def _after(v1: int, v2: int, b1: int, b2: int) -> tuple[int, int]:
    """The bin after (v1, v2)."""
    if b2 and v2 + 1 < 1 << b2:
        return v1, v2 + 1
    return v1 + 1, 0


def shard_by_bytes(df: DataFrame, shards: int = 40, id_col: str = "doc_id", text: str = "text", tolerance: float = 0.002, part_bytes: int = 256 << 20, max_parts: int = 32768) -> DataFrame:
    """``df`` with ``size`` (bytes plus 16), ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard).

    Shards have near-equal bytes: each boundary is within ``tolerance`` of a shard's bytes of its ideal
    place, or lies between the two rows nearest to it. Equal texts stay together unless a boundary has to
    cut their group. Rows with equal text and id, or equal text and null ids, are interchangeable: where they
    outweigh the tolerance they are cut like other rows, in an order of their own. Null ids and null or empty
    texts, however long, are rows like any other;
    with fewer rows than shards some shards are empty; an empty table gives no rows. Columns of ``df``
    named size, shard or slot are replaced.
    """
    k1, k2, v = scratch(df, "__k1"), scratch(df, "__k2"), scratch(df, "__v")
    rows = df.drop("size", "shard", "slot")
    before, cuts, part, nth, offset = (scratch(df, f"__{c}") for c in ("before", "cuts", "part", "nth", "offset"))
    keyed = rows.withColumns({k1: F.xxhash64(text_of(f"`{text}`")), k2: F.xxhash64(F.col(f"`{id_col}`"), F.lit(1)), "size": text_size(text)})
    slim = [F.col(k1).alias("k1"), F.col(k2).alias("k2"), "size"]
    keys = cut(keyed.select(*slim))
    alike = equal_rows(keys, shards, tolerance)
    if alike is not None:
        # rows of one text and id that outweigh the tolerance are told apart by a number; only they are written
        same = F.broadcast(alike.select(F.col("k1").alias("__k1a"), F.col("k2").alias("__k2a")))
        of = (F.col(k1) == F.col("__k1a")) & (F.col(k2) == F.col("__k2a"))
        hot = cut(keyed.join(same, of, "left_semi")).withColumn(k2, F.xxhash64(k2, F.monotonically_increasing_id()))
        keyed = keyed.join(same, of, "left_anti").union(hot)
        keys = cut(keyed.select(*slim))
    edges, shard_of, first = splitters(keys, shards, tolerance, part_bytes, max_parts)
    edges = [e for e in edges if e[0] is not None]
    spark = df.sparkSession
    # splitters by the first bits of the key: at most 2^FIRST_BITS rows, so a broadcast of bounded size
    by_top: dict[int, list[tuple[int, int]]] = {}
    for a, b in edges:
        by_top.setdefault(((a ^ LEAST) & ((1 << 64) - 1)) >> (64 - FIRST_BITS), []).append((a, b))
    told, below = [], 0
    for t in range(1 << FIRST_BITS):
        own = by_top.get(t, [])
        told.append((t, below, own))
        below += len(own)
    told = spark.createDataFrame(told, f"`{v}` bigint, `{before}` int, `{cuts}` array<struct<a: bigint, b: bigint>>")
    starts = {s: first[shard_of.index(s)] for s in set(shard_of)}
    offsets = spark.createDataFrame([(p, s, first[p] - starts[s]) for p, s in enumerate(shard_of)], f"`{part}` int, shard int, `{offset}` bigint")
    place = F.col(before) + F.size(F.filter(cuts, lambda c: (c["a"] < F.col(k1)) | ((c["a"] == F.col(k1)) & (c["b"] <= F.col(k2)))))
    placed = (
        keyed.withColumn(v, F.shiftrightunsigned(F.col(k1).bitwiseXOR(F.lit(LEAST)), 64 - FIRST_BITS))
        .join(F.broadcast(told), v)
        .withColumn(part, place)
        .drop(before, cuts, v)
    )
    dealt = placed.repartitionById(len(shard_of), F.col(part)).sortWithinPartitions(k1, k2)
    # partition p holds exactly part p, so a row's number in its partition is its number in its part
    dealt = dealt.withColumn(nth, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    out = dealt.join(F.broadcast(offsets), part).withColumn("slot", F.col(nth) + F.col(offset))
    return out.select(*[f"`{c}`" for c in rows.columns], "size", "shard", "slot")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard; files inside follow the slots."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
