"""Token ids in Arrow IPC files of fixed-size lists.

Each partition of the ordered corpus becomes one ``part-NNNNN.arrow``: record batches with three
fixed-size-list columns of ``length`` items, ``ids``, ``mask`` and ``last``. Documents follow one
another without a gap, each closed by the end id, and are cut into sequences of equal length; only a
file's last sequence is padded. ``mask`` is true for tokens and ``last`` for a document's last token (a
bit each), so lengths and boundaries are read from the file itself. ``part-NNNNN.docs.arrow`` has the ids of the
documents in the same order, with where each starts in its file. Any sequence is reached by a batch
number and an offset, without copying, when the file is memory-mapped.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attempt_name, cut, file_system, text_of, work_dir, worker_cache

#: Words whose ids a worker remembers; a full cache starts anew.
CACHE_WORDS = 1_000_000
#: Fixed value: the vocabulary's own way to cut a piece into words.
WORDS = r"('s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+)"
#: Pieces with these are encoded as they are: characters that normalising may change, and special tokens.
OTHER = r"[^\x21-\x{24f}]|[\x{85}\x{a0}\x{130}]|<\|"


def gather(pool: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``pool[first : first + count]`` of all entries one after another, and where each ends in the result."""
    stop = np.cumsum(count)
    if not len(stop):
        return pool[:0], stop
    return pool[np.repeat(first - (stop - count), count) + np.arange(stop[-1])], stop


class Encoder:
    """Ids of whole texts for a vocabulary that drops white space and lower-cases.

    No token spans white space, so the distinct pieces between it are cut into words as the vocabulary does,
    and only distinct unknown words are encoded; a piece of other than plain characters is encoded as it
    is. The result is that of encoding the whole text at once. Work is per distinct word in Python, per
    piece and id in Arrow and numpy.
    """

    def __init__(self, path: str, wide: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.code = "I" if wide else "H"
        self.words: dict[str, bytes] = {}

    def word_ids(self, words: list[str]) -> list[bytes]:
        known = self.words
        new = [w for w in words if w not in known]
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            for w, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                known[w] = array(self.code, e.ids).tobytes()
        out = [known[w] for w in words]
        if len(known) > CACHE_WORDS:
            known.clear()
        return out

    def encode(self, texts: pa.StringArray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, each closed by the end id, and where each text ends among them."""
        lists = pc.ascii_split_whitespace(texts)
        bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        pieces = coded.dictionary
        plain = pc.invert(pc.match_substring_regex(pieces, OTHER))
        cut = pc.utf8_rtrim_whitespace(pc.replace_substring_regex(pc.utf8_lower(pieces), WORDS, r"\1 "))
        cut = pc.ascii_split_whitespace(pc.if_else(plain, cut, pieces))
        words = cut.flatten().dictionary_encode()
        ids = self.word_ids(words.dictionary.to_pylist())
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // array(self.code).itemsize
        pool = np.frombuffer(b"".join(ids), self.code)
        # ids of each distinct piece, and of the end, then of each text
        word = words.indices.to_numpy()
        pool, stop = gather(pool, (np.cumsum(size) - size)[word], size[word])
        at = np.r_[0, stop, 0][(cut.offsets.to_numpy() - cut.offsets[0].as_py())] if len(word) else np.zeros(len(pieces) + 1, np.int64)
        first, count = np.append(at[:-1], len(pool)), np.append(np.diff(at), 1)
        pool = np.append(pool, np.array([end_id], self.code))
        which = np.insert(coded.indices.to_numpy(), bounds[1:], len(pieces))
        out, stop = gather(pool, first[which], count[which])
        return out, stop[bounds[1:] + np.arange(len(texts))]


class Packer:
    """Collects ids into sequences of equal length and writes full batches; holds at most one batch and what was added last."""

    def __init__(self, writer: ipc.RecordBatchFileWriter, schema: pa.Schema, length: int, rows: int):
        self.writer, self.schema, self.length, self.room = writer, schema, length, length * rows
        self.ids, self.marks, self.have, self.total = [], [], 0, 0

    def add(self, ids: np.ndarray, ends: np.ndarray) -> None:
        marks = np.ones(len(ids), np.uint8)  # 0 padding, 1 token, 2 last token of its document
        marks[ends - 1] = 2
        self.ids.append(ids)
        self.marks.append(marks)
        self.have += len(ids)
        self.total += len(ids)
        if self.have >= self.room:
            self.flush(self.have // self.room * self.room)

    def flush(self, upto: int) -> None:
        ids, marks = np.concatenate(self.ids), np.concatenate(self.marks)
        for s in range(0, upto, self.room):
            self.put(ids[s : min(s + self.room, upto)], marks[s : min(s + self.room, upto)])
        self.ids, self.marks, self.have = [ids[upto:].copy()], [marks[upto:].copy()], self.have - upto

    def put(self, ids: np.ndarray, marks: np.ndarray) -> None:
        pad = -len(ids) % self.length
        if pad:
            ids, marks = np.pad(ids, (0, pad)), np.pad(marks, (0, pad))
        cols = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, marks > 0, marks == 2)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(cols, schema=self.schema))

    def close(self) -> None:
        if self.have:
            self.flush(self.have)


def write_tokens(df: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text: str = "text", end_id: int = 1, length: int = 2048, rows_per_batch: int = 64, wide: bool = False) -> DataFrame:
    """Writes ``df``'s texts in ascending id order to files below ``folder``.

    Returns the manifest: one row per file with ``part``, ``file``, ``docs``, ``n_tokens`` and ``base``,
    the ids in all files before it. Texts are exchanged once, by ranges of (id, text hash), so neither a
    repeated id nor many null ids (which come first) end in one task. Files appear under their name only
    when whole; a task that runs again replaces its file with an equal one. ``wide`` uses 32-bit ids,
    for vocabularies of over 65,536.
    """
    schema = pa.schema([("ids", pa.list_(pa.uint32() if wide else pa.uint16(), length)), ("mask", pa.list_(pa.bool_(), length)), ("last", pa.list_(pa.bool_(), length))], metadata={"end_id": str(end_id), "tokenizer": os.path.basename(tokenizer)})
    src = df.select(F.col(f"`{id_col}`").alias("id"), text_of(f"`{text}`").alias("text")).withColumn("th", F.xxhash64("text"))
    ordered = src.repartitionByRange("id", "th").sortWithinPartitions("id", "th").select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        coder = worker_cache(f"tokens:{tokenizer}:{wide}", lambda: Encoder(tokenizer, wide))
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        file = f"{root}/part-{part:05d}.arrow"
        index = f"{root}/part-{part:05d}.docs.arrow"
        tmp, tmp_index = attempt_name(file), attempt_name(index)
        docs = 0
        sink = index_sink = None
        for b in batches:
            if not b.num_rows:
                continue
            if sink is None:
                sink, index_sink = fs.open_output_stream(tmp), fs.open_output_stream(tmp_index)
                packer = Packer(ipc.new_file(sink, schema), schema, length, rows_per_batch)
                index_schema = pa.schema([("doc_id", b.schema.field(0).type), ("start", pa.int64())])
                index_writer = ipc.new_file(index_sink, index_schema)
            for some in _slices(b):
                before = packer.total
                ids, ends = coder.encode(some.column(1), end_id)
                starts = np.r_[0, ends[:-1]] + before
                packer.add(ids, ends)
                index_writer.write_batch(pa.RecordBatch.from_arrays([some.column(0), pa.array(starts, pa.int64())], schema=index_schema))
            docs += b.num_rows
        if sink is None:
            return
        packer.close()
        for w, s, a, to in ((packer.writer, sink, tmp, file), (index_writer, index_sink, tmp_index, index)):
            w.close()
            s.close()
            fs.move(a, to)
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [f"{folder}/part-{part:05d}"], "docs": pa.array([docs], pa.int64()), "n_tokens": pa.array([packer.total], pa.int64())})

    made = cut(ordered.mapInArrow(run, "part int, file string, docs bigint, n_tokens bigint"))
    spark, base, rows = df.sparkSession, 0, []
    for r in sorted(made.collect()):  # one row per file
        rows.append((r.part, r.file, r.docs, r.n_tokens, base))
        base += r.n_tokens
    return spark.createDataFrame(rows, "part int, file string, docs bigint, n_tokens bigint, base bigint")


def _slices(batch: pa.RecordBatch, most: int = 32 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` bytes of text, at least one row each, so that work space is bounded."""
    size = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most)))
        yield batch.slice(at, upto - at)
        at = upto


class TokenFile:
    """Random access to one file's sequences and documents, memory-mapped where the file is local."""

    def __init__(self, stem: str):
        self.open = [self._source(f"{stem}{x}") for x in (".arrow", ".docs.arrow")]
        self.data, self.docs = (ipc.open_file(s) for s in self.open)
        field = self.data.schema.field("ids").type
        self.length = field.list_size
        self.per_batch = self.data.get_batch(0).num_rows if self.data.num_record_batches else 0

    @staticmethod
    def _source(uri: str):
        fs, path = file_system(uri)
        return pa.memory_map(path) if fs.type_name == "local" else fs.open_input_file(path)

    def sequence(self, i: int) -> tuple[pa.Array, pa.Array]:
        """Ids and mask of sequence ``i``: slices of the file's buffers, not copies."""
        b = self.data.get_batch(i // self.per_batch)
        return tuple(b.column(k).values.slice(i % self.per_batch * self.length, self.length) for k in (0, 1))

    def documents(self) -> Iterator[tuple[object, int, int, int]]:
        """(doc id, start in this file, ids, crc32 of the ids as little-endian 32 bits) in file order."""
        names = (x for k in range(self.docs.num_record_batches) for x in zip(*(c.to_pylist() for c in self.docs.get_batch(k).columns), strict=True))
        n, crc, start = 0, 0, 0
        for k in range(self.data.num_record_batches):
            b = self.data.get_batch(k)
            ids = b.column(0).values.to_numpy(zero_copy_only=True)
            mask, last = (b.column(c).values.to_numpy(zero_copy_only=False) for c in (1, 2))
            at = 0
            for e in (np.flatnonzero(last) + 1).tolist():
                crc = zlib.crc32(ids[at:e].astype("<u4").tobytes(), crc)
                n += e - at
                name, said = next(names)
                if said != start:
                    raise ValueError(f"document {name}: starts at {start}, its index says {said}")
                yield name, start, n, crc
                start, n, crc, at = start + n, 0, 0, e
            rest = ids[at:][mask[at:]]
            crc, n = zlib.crc32(rest.astype("<u4").tobytes(), crc), n + len(rest)

    def close(self) -> None:
        for s in self.open:
            s.close()


def read_documents(manifest: DataFrame, id_type: str = "bigint") -> DataFrame:
    """Per document, from the files: doc_id, start (ids before it in the whole corpus), n_tokens, ids_crc32."""
    files = manifest.select("file", "base").repartition(max(1, manifest.count()), "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                f = TokenFile(file)
                block, kind = [], f.docs.schema.field(0).type
                for row in f.documents():
                    block.append(row)
                    if len(block) == 10_000:
                        yield out(block, base, kind)
                        block = []
                if block:
                    yield out(block, base, kind)
                f.close()

    def out(block, base, kind):
        ids, start, n, crc = zip(*block, strict=True)
        return pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, kind), "start": pa.array([s + base for s in start], pa.int64()), "n_tokens": pa.array(n, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    return files.mapInArrow(run, f"doc_id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_round_trip(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", folder: str | None = None, **how) -> DataFrame:
    """Writes the corpus as token files and returns per document what the files say.

    Null and empty texts have the end id only. Rows are in (id, text hash) order, null ids first; repeated
    ids keep a row each. An empty table writes nothing and gives no rows. Other columns are ignored.
    """
    folder = folder or work_dir(df.sparkSession, "tokens")
    manifest = write_tokens(df, folder, tokenizer, id_col, text, **how)
    kind = dict(df.dtypes)[id_col]
    return read_documents(manifest, kind).withColumnRenamed("doc_id", id_col)
