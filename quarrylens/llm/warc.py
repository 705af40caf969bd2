"""WARC archives with an externally merged capture index.

Each partition writes its captures to gzip'd WARC files, a member per record, and beside them a run: an
Arrow IPC file of (url key, timestamp, page id, file, offset, length) sorted by the first three. Runs are
merged by key ranges: a task takes its range of every run by bisection over their blocks and merges
them with a loser tree, block by block, so memory is a block per run; beyond ``FAN_IN`` runs groups are
merged first. The index parts together are one globally ordered history of captures, and
archives are read back through them.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import ipc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import attempt_name, cut, file_system, parts_for, work_dir

NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the name space for URLs
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value: of the format
BLOCK_ROWS = 1024
FAN_IN = 512
#: Digests with several captures that are broadcast at most; with more, pages are joined by an exchange.
BROADCAST_DIGESTS = 200_000
RUN = pa.schema([("urlkey", pa.string()), ("ts", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

KEY = pa.schema(list(RUN)[:3])
#: Where a range begins or ends: a key as ``order_key`` has it.
BOUND = "struct<a:string,b:string,c:boolean,d:bigint>"


class LoserTree:
    """Merges sorted iterators: the winner goes out, and its successor is played against the losers on its way up."""

    def __init__(self, sources: Iterable[Iterator], key):
        self.sources, self.key = [iter(s) for s in sources], key
        self.heads = [next(s, None) for s in self.sources]
        k = self.k = len(self.heads)
        self.loser = [-1] * max(k, 1)
        self.winner = self._build(1) if k else -1

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        kx, ky = self.key(x), self.key(y)
        return kx < ky or (kx == ky and a < b)

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        won, lost = (a, b) if self._beats(a, b) else (b, a)
        self.loser[node] = lost
        return won

    def __iter__(self):
        while self.k and self.heads[self.winner] is not None:
            w = self.winner
            yield self.heads[w]
            self.heads[w] = next(self.sources[w], None)
            node = (w + self.k) // 2
            while node:
                if self._beats(self.loser[node], w):
                    self.loser[node], w = w, self.loser[node]
                node //= 2
            self.winner = w


def url_key(url: Column) -> Column:
    """Host labels in reverse and the rest of the URL, lower case, without fragment: captures of a site lie together."""
    url = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))
    rest = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^#]*)", 1))
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest == "", "/").otherwise(rest))


def capture_time(page_id: Column) -> Column:
    """Fourteen digits. The table has no capture times; page n counts as taken n seconds after the start of 2020."""
    at = F.pmod(F.coalesce(page_id, F.lit(0)), F.lit(1_000_000_000)) + F.lit(1_577_836_800)
    return F.date_format(F.timestamp_seconds(at), "yyyyMMddHHmmss")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, ts: str, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record. A revisit keeps the HTTP header, whose length is that of the full payload, and no body."""
    digest = base32_sha1(payload)
    name = lambda p: uuid.uuid5(NAMES, f"{digest}:{p}").urn
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{name(page_id)}>",
            f"WARC-Date: {ts[:4]}-{ts[4:6]}-{ts[6:8]}T{ts[8:10]}:{ts[10:12]}:{ts[12:14]}Z",
            "WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or ""),
            f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{name(refers_to)}>", f"X-Refers-To-Page-Id: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """A record's fields; the payload of a response is checked against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    field = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(field["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    digest = field["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = field["WARC-Type"]
    if not lines[0].startswith("WARC/") or kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"a record is damaged: {field.get('WARC-Record-ID')}")
    number = lambda k: int(field[k]) if k in field else None
    return {"page_id": number("X-Page-Id"), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number("X-Refers-To-Page-Id"), "url": field["WARC-Target-URI"]}


class RunWriter:
    """Writes index rows to an Arrow file in blocks, whole or not at all."""

    def __init__(self, uri: str):
        self.fs, self.path = file_system(uri)
        self.tmp = attempt_name(self.path)
        self.sink = self.fs.open_output_stream(self.tmp)
        self.out, self.rows, self.total, self.firsts = ipc.new_file(self.sink, RUN), [], 0, []

    def add(self, row: tuple) -> None:
        if not self.rows:
            self.firsts.append(row[:3])
        self.rows.append(row)
        self.total += 1
        if len(self.rows) == BLOCK_ROWS:
            self.flush()

    def flush(self) -> None:
        if self.rows:
            self.out.write_batch(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.rows, strict=True), RUN, strict=True)], schema=RUN))
            self.rows = []

    def close(self) -> None:
        self.flush()
        self.out.close()
        self.sink.close()
        self.fs.move(self.tmp, self.path)


def order_key(row: tuple) -> tuple:
    """Url key, timestamp, page id (a missing one first)."""
    return (row[0], row[1], row[2] is not None, row[2] or 0)


def run_rows(uri: str, low: tuple | None = None, high: tuple | None = None) -> Iterator[tuple]:
    """A run's rows with low <= key < high, reading only the blocks that can hold them, one at a time."""
    fs, path = file_system(uri)
    with pa.memory_map(path) if fs.type_name == "local" else fs.open_input_file(path) as source:
        f = ipc.open_file(source)

        class Firsts:
            def __len__(self):
                return f.num_record_batches

            def __getitem__(self, i):
                return order_key(tuple(c[0].as_py() for c in f.get_batch(i).columns[:3]))

        at = max(0, bisect_left(Firsts(), low) - 1) if low is not None else 0
        for i in range(at, f.num_record_batches):
            for row in zip(*(c.to_pylist() for c in f.get_batch(i).columns), strict=True):
                k = order_key(row)
                if high is not None and k >= high:
                    return
                if low is None or k >= low:
                    yield row


def write_archives(df: DataFrame, folder: str, id_col: str = "page_id", url: str = "url", html: str = "html", max_bytes: int = 1 << 30, level: int = 2) -> DataFrame:
    """Writes a record per row below ``folder``; returns one row per run: part, run, rows, and a few of its keys.

    Of rows with equal payloads (told by SHA-256) the one with the largest id is the response and the others revisit
    it; rows that share the largest id are all responses. Payloads move only if more than
    ``BROADCAST_DIGESTS`` payloads have several captures; then the skew-join rule may split a payload that many pages share.
    """
    spark = df.sparkSession
    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("page_id"), F.col(f"`{url}`").alias("url"), F.encode(F.coalesce(F.col(f"`{html}`"), F.lit("")), "utf-8").alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha2("payload", 256)))
    several = cut(rows.groupBy("sha").agg(F.max("page_id").alias("keep"), F.count("*").alias("n")).where("n > 1").select("sha", "keep"))
    side = F.broadcast(several) if several.count() <= BROADCAST_DIGESTS else several
    told = rows.join(side, "sha", "left").withColumn("revisit", F.coalesce(F.col("keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep")), F.lit(False)))
    told = told.select(url_key(F.col("url")).alias("urlkey"), capture_time(F.col("page_id")).alias("ts"), "page_id", "url", "payload", "keep", "revisit")
    told = told.sortWithinPartitions("urlkey", "ts", F.col("page_id").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        index = out = None
        at, nth = 0, 0

        def roll():
            nonlocal out, at, nth
            if out is not None:
                out[1].close()
                fs.move(out[2], out[3])
            name = f"run-{part:05d}-{nth:04d}.warc.gz"
            tmp = attempt_name(f"{root}/{name}")
            out, at, nth = (f"{folder}/{name}", fs.open_output_stream(tmp), tmp, f"{root}/{name}"), 0, nth + 1

        for b in batches:
            for urlkey, ts, page_id, url, payload, keep, revisit in zip(*(c for c in b.columns), strict=True):
                if index is None:
                    index = RunWriter(f"{folder}/run-{part:05d}.idx.arrow")
                if out is None or at >= max_bytes:
                    roll()
                z = zlib.compressobj(level, zlib.DEFLATED, 31)
                raw = record(page_id.as_py(), url.as_py(), ts.as_py(), payload.as_py(), keep.as_py(), revisit.as_py())
                member = z.compress(raw) + z.flush()
                out[1].write(member)
                index.add((urlkey.as_py(), ts.as_py(), page_id.as_py(), out[0], at, len(member)))
                at += len(member)
        if index is None:
            return
        out[1].close()
        fs.move(out[2], out[3])
        index.close()
        step = -(-len(index.firsts) // 64)  # at most 64 keys of a run are told
        few = index.firsts[::step]
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "run": [f"{folder}/run-{part:05d}.idx.arrow"], "rows": pa.array([index.total], pa.int64()), "keys": pa.array([[dict(zip(KEY.names, k, strict=True)) for k in few]], pa.list_(pa.struct(list(KEY))))})

    return cut(told.mapInArrow(run, "part int, run string, rows bigint, keys array<struct<urlkey:string,ts:string,page_id:bigint>>"))


def merge_runs(runs: DataFrame, folder: str, part_rows: int = 500_000, fan_in: int = FAN_IN) -> DataFrame:
    """Merges the runs to index parts in one global order; returns (part, file, rows).

    Jobs are rows of DataFrames, so the driver holds ``fan_in`` file names at most, however many runs and parts there are.
    """
    file_at = lambda name: F.concat(F.lit(f"{folder}/"), F.format_string(name, "part"))
    n = parts_for(runs.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0], part_rows)
    files, left, level = runs.select("part", F.col("run").alias("file")), runs.count(), 0
    while left > fan_in:  # groups of runs to longer runs, until one merge can hold a block of each
        group = F.floor(F.col("part") / fan_in).cast("int")  # a run per part, so none has more than fan_in
        n_groups = files.agg(F.max("part")).first()[0] // fan_in + 1
        jobs = files.groupBy(group.alias("part")).agg(F.array_sort(F.collect_list("file")).alias("files"))
        jobs = jobs.select("part", "files", F.lit(None).cast(BOUND).alias("low"), F.lit(None).cast(BOUND).alias("high"), file_at(f"level-{level}-%05d.idx.arrow").alias("file"))
        files = _merged(jobs, min(left, n_groups)).select("part", "file")
        left, level = files.count(), level + 1
    names = sorted(r.file for r in files.select("file").collect())  # fan_in at most
    bounds = _ranges(runs.select(F.explode("keys").alias("k")).select("k.*"), n)
    jobs = bounds.select("part", F.lit(None).cast("array<string>").alias("files"), "low", "high", file_at("index-%05d.arrow").alias("file"))
    return _merged(jobs.where(F.lit(bool(names))), n, names)


def _ranges(keys: DataFrame, n: int, per_part: int = 100_000) -> DataFrame:
    """(part, low, high): ``n`` ranges of about as many of ``keys`` each, fewer if there are fewer keys; the outer ends are open."""
    spark = keys.sparkSession
    if n > 1:
        # a missing id comes first, as in the runs
        bound = F.struct(F.col("urlkey").alias("a"), F.col("ts").alias("b"), F.col("page_id").isNotNull().alias("c"), F.coalesce("page_id", F.lit(0)).alias("d"))
        keys = keys.select(bound.cast(BOUND).alias("k")).distinct()
        keys = cut(keys.repartitionByRange(parts_for(keys.count(), per_part), "k").select("k", F.spark_partition_id().alias("p")))
        sizes = {r.p: r["count"] for r in keys.groupBy("p").count().collect()}  # a row per partition
        before, total = [], 0
        for p in sorted(sizes):
            before.append((p, total))
            total += sizes[p]
        n = min(n, total)
    if n <= 1:
        return spark.range(1).select(F.lit(0).alias("part"), F.lit(None).cast(BOUND).alias("low"), F.lit(None).cast(BOUND).alias("high"))
    offset = F.broadcast(spark.createDataFrame(before, "p int, before bigint"))
    rank = F.row_number().over(Window.partitionBy("p").orderBy("k")) - 1 + F.col("before")
    # the i-th cut is the first key whose share of the ranks reaches i / n
    share = lambda r: F.floor(r * n / F.lit(total))
    cuts = keys.join(offset, "p").select("k", rank.alias("r")).where((F.col("r") > 0) & (share(F.col("r")) > share(F.col("r") - 1)))
    cuts = cuts.select(share(F.col("r")).cast("int").alias("i"), "k")
    none = F.lit(None).cast(BOUND)
    ends = cuts.select(F.col("i").alias("part"), F.col("k").alias("low"), none.alias("high")).union(cuts.select(F.col("i") - 1, none, F.col("k")))
    return ends.groupBy("part").agg(F.max("low").alias("low"), F.max("high").alias("high"))


def _merged(jobs: DataFrame, n: int, names: list[str] | None = None) -> DataFrame:
    """Does ``n`` jobs (part, files, low, high, file), one a task; ``names`` are the files of all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, files, low, high, file in zip(*(c.to_pylist() for c in b.columns), strict=True):
                low, high = (tuple(x.values()) if x else None for x in (low, high))
                out = RunWriter(file)
                for row in LoserTree((run_rows(f, low, high) for f in names or files), order_key):
                    out.add(row)
                out.close()
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [file], "rows": pa.array([out.total], pa.int64())})

    return cut(jobs.repartitionByRange(max(1, n), "part").mapInArrow(run, "part int, file string, rows bigint"))


def read_archives(index: DataFrame, block: int = 4096) -> DataFrame:
    """Per capture, from the archives through the merged index: page_id, url, payload_bytes, payload_digest, record_type, refers_to."""
    fields = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def read(rows: list[tuple]) -> pa.RecordBatch:
        found: list = [None] * len(rows)
        source, name = None, None
        for i in sorted(range(len(rows)), key=lambda i: rows[i][3:5]):  # each archive in one direction
            _, _, page_id, file, offset, length = rows[i]
            if file != name:
                if source is not None:
                    source.close()
                fs, path = file_system(file)
                source, name = fs.open_input_file(path), file
            found[i] = parse(zlib.decompress(source.read_at(length, offset), 31))
            if found[i]["page_id"] != page_id:
                raise ValueError(f"{file} at {offset}: page {found[i]['page_id']} instead of {page_id}")
        if source is not None:
            source.close()
        return pa.RecordBatch.from_arrays([pa.array([x[f] for x in found], k) for f, k in zip(fields, kinds, strict=True)], names=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, first, upto in zip(*(c.to_pylist() for c in b.columns), strict=True):
                fs, path = file_system(file)
                with fs.open_input_file(path) as source:
                    f = ipc.open_file(source)
                    rows: list[tuple] = []
                    for i in range(first, min(upto, f.num_record_batches)):
                        rows += zip(*(c.to_pylist() for c in f.get_batch(i).columns), strict=True)
                        if len(rows) >= block:
                            yield read(rows)
                            rows = []
                    if rows:
                        yield read(rows)

    # an index part is read in pieces of a few blocks, so that reading is dealt out more finely than merging
    step = 4
    blocks = F.ceil(F.col("rows") / BLOCK_ROWS).cast("int")
    pieces = index.where("rows > 0").select("file", F.explode(F.sequence(F.lit(0), blocks - 1, F.lit(step))).alias("first"))
    pieces = pieces.select("file", "first", (F.col("first") + step).alias("upto"))
    n = pieces.count()
    tasks = max(1, min(n, max(4096, n // 64)))
    return pieces.repartition(tasks).mapInArrow(run, "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def archive_round_trip(df: DataFrame, folder: str | None = None, **how) -> DataFrame:
    """Writes archives of ``df``'s pages, merges their index and reads everything back, in capture order within a piece.

    Null payloads are empty; equal empty payloads are deduplicated like others. Null ids keep their
    records; a payload that only rows without an id have is a response each time. Null URLs are empty.
    An empty table writes nothing and gives no rows. Further columns are ignored.
    """
    folder = folder or work_dir(df.sparkSession, "warc")
    return read_archives(merge_runs(write_archives(df, folder, **how), folder))
