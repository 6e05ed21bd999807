"""Token ids in Arrow IPC files of fixed-size-list batches.

Texts become ids by the tokenizers library; an end id follows each document. Documents go in
ascending doc_id order (then by a hash of the text), null doc_id first, dealt by ranges to one
file a partition, as many as the input's planned bytes ask for. A file holds `ids` fixed_size_list<uint16 or uint32>[LENGTH] (the narrower
where the vocabulary fits) and `mask` fixed_size_list<bool>[LENGTH] in record batches of ROWS rows: sequence i is row i % ROWS of
batch i // ROWS, a slice of the mapped file without a copy. Only the last row of a file is
padded (mask false). Beside it lies an index file with each document's doc_id, first position in
the file and number of ids. A file is written under another name and moved when whole, so a
task that runs again, or twice, leaves one right file.

Nulls: a null text counts as empty and yields only the end id. Repeated rows are encoded each.
An empty table writes no sequences. A text of any length is encoded in segments of bounded size. Columns other than doc_id and
text are ignored.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs, ipc
from pyspark.sql import DataFrame, Window, functions as F

from weir.llm.chunks import check_vocabulary, segments
from weir.llm.shared import bounded_batches, planned_bytes, scratch_path, settle
from weir.session import ship

LENGTH, ROWS, END_ID = 1024, 256, 0
#: Parts kept, the longest one kept, and parts that the library encodes at once.
KEPT, LONGEST, BLOCK = 900_000, 48, 10_000
#: Bytes of input a file is for, at most, and at least where that gives fewer files than shuffle partitions.
FILE_BYTES, LEAST_BYTES = 256 << 20, 8 << 20
_ENCODERS: dict[str, "Encoder"] = {}


class Encoder:
    """Ids of texts; the library encodes each distinct part of a segment once, and parts met before not again."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        self.special = check_vocabulary(path)
        self.own = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.own.get_vocab_size() <= 1 << 16 else "<u4")
        self.kept: dict[bytes, bytes] = {}

    def words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as bytes."""
        kept = self.kept
        out = [kept.get(w) for w in words]
        new = [k for k, x in enumerate(out) if x is None]
        if len(kept) + len(new) > KEPT:
            kept.clear()
        for at in range(0, len(new), BLOCK):
            own = new[at : at + BLOCK]
            got = self.own.encode_batch_fast([words[k].decode() for k in own], add_special_tokens=False)
            for k, x in zip(own, got):
                out[k] = ids = np.array(x.ids, self.kind).tobytes()
                if len(words[k]) <= LONGEST:
                    kept[words[k]] = ids
        return out

    def column(self, column: pa.Array, end: bytes = b"") -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(ids, counts, over) of each segment: counts are the ids that each text of the column has in it, over how many texts are over.

        The end id, where given, follows each text and is counted.
        """
        done, n = 0, len(column)
        for part in segments(column, self.special):
            flat = pa.array(self.words(part.words), pa.binary()).take(pa.array(part.place))
            offsets = np.frombuffer(flat.buffers()[1], np.int32)[: len(flat) + 1]
            ids = np.frombuffer(flat.buffers()[2] or b"", self.kind)[: (offsets[-1] if len(flat) else 0) // self.kind.itemsize]
            counts = np.bincount(part.text, np.diff(offsets) // self.kind.itemsize, n).astype(np.int64)
            if end:
                ids = np.insert(ids, np.cumsum(counts)[done : part.over], np.frombuffer(end, self.kind))
                counts[done : part.over] += 1
            yield ids, counts, part.over
            done = part.over

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if not texts:
            return []
        got = [*self.column(pa.array(texts, pa.string()))]
        flat, counts = np.concatenate([x[0] for x in got]), sum(x[1] for x in got)
        return np.split(flat, np.cumsum(counts)[:-1])


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class SequenceFile:
    """Writes ids into rows of LENGTH, a batch at a time."""

    def __init__(self, sink, length: int, rows: int, kind: np.dtype):
        self.length, self.rows, self.kind, self.held, self.size = length, rows, kind, [], 0
        self.schema = pa.schema(
            [("ids", pa.list_(pa.from_numpy_dtype(kind), length)), ("mask", pa.list_(pa.bool_(), length))]
        )
        self.writer = ipc.new_file(sink, self.schema)

    def add(self, ids: bytes) -> None:
        self.held.append(ids)
        self.size += len(ids)
        full = self.kind.itemsize * self.length * self.rows
        if self.size >= full:
            data = b"".join(self.held)
            cut = len(data) - len(data) % full
            for at in range(0, cut, full):
                self._write(np.frombuffer(data, self.kind, self.length * self.rows, at), self.length * self.rows)
            self.held, self.size = [data[cut:]], len(data) - cut

    def _write(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.writer.write_batch(pa.record_batch(columns, schema=self.schema))

    def close(self) -> None:
        ids = np.frombuffer(b"".join(self.held), self.kind)
        if len(ids):
            self._write(np.concatenate([ids, np.zeros(-len(ids) % self.length, self.kind)]), len(ids))
        self.writer.close()


class SequenceReader:
    """Random access to the sequences of one file; views, not copies, where the store can be mapped."""

    def __init__(self, store, path: str):
        local = isinstance(store, fs.LocalFileSystem)
        self.file = ipc.open_file(pa.memory_map(path) if local else store.open_input_file(path))
        self.length = self.file.schema.field("ids").type.list_size
        self.rows = self.file.get_batch(0).num_rows if self.file.num_record_batches else 1
        self.at, self.batch = -1, None

    def _batch(self, k: int):
        if k != self.at:
            self.at, self.batch = k, self.file.get_batch(k)
        return self.batch

    def sequence(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids as a view of the file, and the mask as a slice of its bits."""
        b, r = self._batch(i // self.rows), i % self.rows * self.length
        return b.column(0).flatten().to_numpy()[r : r + self.length], b.column(1).flatten().slice(r, self.length)

    def span(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The ids at positions start to start + n, as views of one batch each."""
        full = self.rows * self.length
        while n > 0:
            b, r = self._batch(start // full), start % full
            got = b.column(0).flatten().to_numpy()[r : r + min(n, full - r)]
            yield got
            start, n = start + len(got), n - len(got)


def _store(uri: str):
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, length: int = LENGTH, rows: int = ROWS
) -> DataFrame:
    """Write the files; the manifest (part, file, n_docs, n_ids), a row a file, as Parquet in folder/manifest."""

    def write(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        name, temp = f"{root}/part-{part:06d}", f"{root}/_{uuid.uuid4().hex}"
        settle("token ids", _ENCODERS.clear)
        own, at, n = encoder(tokenizer), 0, 0
        kind = own.kind
        end = np.array([end_id], kind).tobytes()
        index = pa.schema([("doc_id", pa.int64()), ("at", pa.int64()), ("n", pa.int64())])
        out, seq, head = None, None, None
        for batch in batches:
            if seq is None:
                out, lists = store.open_output_stream(f"{temp}.arrow"), store.open_output_stream(f"{temp}.index")
                seq, head = SequenceFile(out, length, rows, kind), ipc.new_file(lists, index)
            sizes = np.zeros(batch.num_rows, np.int64)
            for ids, counts, _ in own.column(batch.column(1), end):
                seq.add(ids.tobytes())
                sizes += counts
            starts = at + np.cumsum(sizes) - sizes
            head.write_batch(pa.record_batch([batch.column(0), pa.array(starts), pa.array(sizes)], schema=index))
            n, at = n + len(sizes), at + int(sizes.sum())
        if seq is not None:
            seq.close()
            head.close()
            out.close()
            lists.close()
            for kind in ("arrow", "index"):
                store.move(f"{temp}.{kind}", f"{name}.{kind}")
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [name], "n_docs": [n], "n_ids": [at]})

    spark = docs.sparkSession
    ship(spark)
    bounded_batches(spark)
    own = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if size := planned_bytes(docs):
        parts = max(1, -(-size // FILE_BYTES), min(parts, -(-size // LEAST_BYTES)))
    ordered = own.repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    made = ordered.mapInArrow(write, "part long, file string, n_docs long, n_ids long")
    made.write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.schema("part long, file string, n_docs long, n_ids long").parquet(f"{folder}/manifest")


def read_token_files(spark, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files."""
    ship(spark)
    manifest = spark.read.schema("part long, file string, n_docs long, n_ids long").parquet(f"{folder}/manifest")
    # One row a file, so a single task suffices for the running sum.
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("file", F.coalesce(F.sum("n_ids").over(w), F.lit(0)).alias("before"))
    count = max(1, manifest.count())

    def read(batches):
        store, _ = _store(folder)
        for batch in batches:
            for file, before in zip(*(c.to_pylist() for c in batch.columns)):
                seqs = SequenceReader(store, f"{file}.arrow")
                with store.open_input_file(f"{file}.index") as raw:
                    head = ipc.open_file(raw)
                    for k in range(head.num_record_batches):
                        b = head.get_batch(k)
                        sums = []
                        for at, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                            crc = 0
                            for view in seqs.span(at, n):
                                crc = zlib.crc32(view.astype("<u4"), crc)
                            sums.append(crc)
                        starts = pa.array(np.asarray(b.column(1)) + before)
                        yield pa.RecordBatch.from_arrays([b.column(0), starts, b.column(2), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.repartition(count, "file").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = END_ID, length: int = LENGTH) -> DataFrame:
    spark = docs.sparkSession
    folder = scratch_path(spark, "tokens")
    write_token_files(docs, folder, tokenizer, end_id, length)
    return read_token_files(spark, folder)
