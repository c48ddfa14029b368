"""Token ids in Arrow stream files of equal-length sequences.

`write_token_files` sorts documents by id over the cluster and writes, for each partition, one
pair of Arrow stream files: `*.arrow` holds record batches with two columns of fixed-size lists
(`ids`: unsigned 16 or 32 bit, `mask`: a byte for each id, 1 where there is one, 0 where the last
sequence is filled up), `*.index.arrow` holds doc_id, start (in the shard) and n_tokens. Almost all
masks are the same, so the column is dictionary-encoded: a batch has each of its masks once, and
an index for each sequence. All batches but the last have the same number of sequences, and nothing
is compressed, so `Shard`, which maps a file, gives any sequence and mask by number as views of the
mapped bytes, without a copy.

A shard counts only if the manifest lists it. Its name is new for each attempt of a task, and the
manifest is a reliable checkpoint, so a lost executor or a second attempt leaves at most an
unlisted file and never a doubled or missing shard.

Defined results: null or empty text is a document of its end id only; null ids sort first;
repeated ids are kept, each with its own span, in the order of a hash of their texts; an empty table gives no shard. Only the id and
text columns are read, so other columns may have any names.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm._common import cut_lineage, map_batches, scratch_dir, slices, texts_of
from quire.llm.bpe import BATCH, Vocabulary, encoder

INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
MANIFEST = "shard long, path string, n_docs long, n_tokens long"


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}" if uri.startswith("/") else uri.replace("file:/", "file:///", 1))


class ShardWriter:
    """Streams the ids of documents into sequences of `length`, `rows` of them in a batch."""

    def __init__(self, uri: str, length: int, kind: pa.DataType, rows: int = 512):
        self.fs, self.path = file_system(uri)
        self.length, self.rows, self.kind = length, rows, kind
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.dictionary(pa.int8(), pa.list_(pa.uint8(), length)))])
        self.out = self.fs.open_output_stream(f"{self.path}.arrow")
        self.file = pa.ipc.new_stream(self.out, self.schema)
        self.buffer: list[np.ndarray] = []
        self.held = self.total = 0
        self.index_out = self.fs.open_output_stream(f"{self.path}.index.arrow")
        self.index = pa.ipc.new_stream(self.index_out, INDEX)

    def add(self, doc_ids: pa.Array, rows: list[np.ndarray]) -> None:
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        starts = self.total + np.cumsum(sizes) - sizes
        self.index.write_batch(pa.RecordBatch.from_arrays([doc_ids, pa.array(starts), pa.array(sizes)], schema=INDEX))
        self.total += int(sizes.sum())
        self.held += int(sizes.sum())
        self.buffer += rows
        step = self.length * self.rows
        if self.held >= step:
            flat = np.concatenate(self.buffer)
            whole = len(flat) // step * step
            for i in range(0, whole, step):
                self.put(flat[i : i + step], step)
            self.buffer, self.held = [flat[whole:]], len(flat) - whole

    def put(self, flat: np.ndarray, used: int) -> None:
        """A batch of whole sequences, of which the first `used` ids are some."""
        masks = np.ones((1 if used == len(flat) else 2, self.length), np.uint8)
        masks[1:, used % self.length :] = 0
        which = np.zeros(len(flat) // self.length, np.int8)
        which[-1] = len(masks) - 1
        mask = pa.DictionaryArray.from_arrays(pa.array(which), pa.FixedSizeListArray.from_arrays(pa.array(masks.ravel()), self.length))
        ids = pa.FixedSizeListArray.from_arrays(pa.array(flat, self.kind), self.length)
        self.file.write_batch(pa.RecordBatch.from_arrays([ids, mask], schema=self.schema))

    def close(self) -> None:
        flat = np.concatenate(self.buffer) if self.buffer else np.zeros(0, np.uint16)
        if used := len(flat):
            self.put(np.concatenate([flat, np.zeros(-used % self.length, flat.dtype)]), used)
        for x in (self.file, self.out, self.index, self.index_out):
            x.close()


def write_token_files(docs: DataFrame, path: str, end_id: int | None = None, length: int = 2048, folder: str | None = None, engine: str = "library") -> DataFrame:
    """Writes the files and returns the manifest: shard, path, n_docs, n_tokens, in doc_id order.

    end_id is appended to each document; length is the number of ids of a sequence."""
    folder = folder or scratch_dir(docs.sparkSession, "token-files")
    where, top = file_system(folder)
    where.create_dir(top, recursive=True)
    small = Vocabulary(path).size <= 1 << 16

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, writer, n = encoder(path, engine), None, 0
        dtype = np.uint16 if small else np.uint32
        name = f"{folder}/shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        tail = np.array([] if end_id is None else [end_id], dtype)
        for batch in slices(batches, limit=BATCH):
            writer = writer or ShardWriter(name, length, pa.uint16() if small else pa.uint32())
            rows = [np.concatenate([np.frombuffer(r, "<u4").astype(dtype), tail]) for r in enc.encode(texts_of(batch))]
            writer.add(batch.column("doc_id"), rows)
            n += len(rows)
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({"shard": [TaskContext.get().partitionId()], "path": [name], "n_docs": [n], "n_tokens": [writer.total]})

    # ids that many rows share, or null ones, are ranges of their own by the second key
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("second"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("second")]
    dealt = cols.repartitionByRange(*order).sortWithinPartitions(*order).drop("second")
    return cut_lineage(map_batches(dealt, write, MANIFEST))


def with_bases(manifest: DataFrame) -> DataFrame:
    """Adds base: ids in all shards before. One row a shard, so the one-task window stays small."""
    w = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(w), F.lit(0)))


def masks_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The masks of a batch (rows of bytes) and which of them each sequence has; views both."""
    column = batch.column("mask")
    masks = column.dictionary.values.to_numpy(zero_copy_only=True).reshape(-1, column.type.value_type.list_size)
    return masks, column.indices.to_numpy(zero_copy_only=True)


def read_shard(uri: str) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """doc_id, start in the shard and ids of each document, from a shard's two files."""
    where, path = file_system(uri)
    with where.open_input_stream(f"{path}.arrow") as a, where.open_input_stream(f"{path}.index.arrow") as b:
        sequences, flat, at = iter(pa.ipc.open_stream(a)), np.zeros(0, np.uint16), 0
        for part in pa.ipc.open_stream(b):
            for doc, start, n in zip(*(c.to_pylist() for c in part.columns), strict=True):
                while at + len(flat) < start + n:
                    batch = next(sequences)
                    ids, (masks, which) = batch.column("ids").flatten().to_numpy(zero_copy_only=True), masks_of(batch)
                    if len(masks) > 1:
                        ids = ids[masks[which].ravel() == 1]
                    flat, at = np.concatenate([flat[start - at :], ids]), start
                yield doc, start, flat[start - at : start - at + n]


class Shard:
    """A shard on a local or mounted disk, mapped: sequence(k) gives ids and mask of any sequence
    as views of the file."""

    def __init__(self, uri: str):
        _, path = file_system(uri)
        self.source = pa.memory_map(f"{path}.arrow")
        self.batches = list(pa.ipc.open_stream(self.source))  # views too: only their heads are read here
        self.rows = self.batches[0].num_rows if self.batches else 1

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if not 0 <= k < len(self):
            raise IndexError(k)
        batch, i = self.batches[k // self.rows], k % self.rows
        ids = batch.column("ids")
        length = ids.type.list_size
        masks, which = masks_of(batch)
        return ids.values.to_numpy(zero_copy_only=True)[i * length : (i + 1) * length], masks[which[i]]


def read_digests(manifest: DataFrame) -> DataFrame:
    """Reads the listed files: doc_id, start (ids of all documents before), n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                cols: tuple[list, ...] = ([], [], [], [])
                for doc, start, ids in read_shard(row["path"]):
                    for c, x in zip(cols, (doc, row["base"] + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())), strict=True):
                        c.append(x)
                    if len(cols[0]) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                        cols = ([], [], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    spark = manifest.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    return map_batches(with_bases(manifest).repartition(n, "shard"), run, "doc_id long, start long, n_tokens long, ids_crc32 long")
