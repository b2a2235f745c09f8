"""Token ids as Arrow files of equal-length sequences.

A file holds record batches of fixed-size lists: `input_ids` (unsigned 16 or 32 bits), `mask` (true for a token, false for padding at the end of the
file) and `ends` (true for the last token of a document), and `docs`, the keys of the documents that end in a sequence. The buffers of a batch
lie flat in the file, so a memory map gives every sequence and mask without copying.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskfabric.llm import pieces

#: Ids in a sequence, and sequences in a record batch.
LENGTH, BATCH = 2048, 128


def _encoded(batch: pa.RecordBatch, coder: pieces.Coder) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Every key of a batch with the ids of its text, in parts where the text is long."""
    keys, row, parts = batch.column(0).to_pylist(), 0, []
    for rows, data, offsets in pieces.blocks(batch.column(1)):
        ids, bounds = coder.encode(data, offsets)
        for r, low, high in zip(rows.tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
            if r != row:
                yield keys[row], parts
                row, parts = r, []
            parts.append(ids[low:high])
    if keys:
        yield keys[row], parts


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else re.sub("^file:", "", uri))


class _Writer:
    """Packs documents into sequences and writes a record batch whenever enough of them are full."""

    def __init__(self, sink, dtype: np.dtype, length: int):
        self.dtype, self.length, self.sink = dtype, length, sink
        self.kinds = (pa.list_(pa.from_numpy_dtype(dtype), length), pa.list_(pa.bool_(), length), pa.list_(pa.bool_(), length), pa.list_(pa.int64()))
        self.schema = pa.schema(list(zip(("input_ids", "mask", "ends", "docs"), self.kinds)))
        self.file = pa.ipc.new_file(sink, self.schema)
        self.parts, self.stops, self.keys, self.held, self.total = [], [], [], 0, 0

    def add(self, key, parts: list[np.ndarray]) -> None:
        size = sum(map(len, parts))
        self.parts += parts
        self.held += size
        self.total += size
        self.stops.append(self.held - 1)
        self.keys.append(key)
        if self.held >= BATCH * self.length:
            self.flush(self.held // self.length)

    def flush(self, rows: int) -> None:
        flat, size = np.concatenate(self.parts), rows * self.length
        rest = flat[size:]
        ids = np.zeros(size, self.dtype)
        ids[: min(size, len(flat))] = flat[:size]
        mask, ends, stops = np.arange(size) < len(flat), np.zeros(size, bool), np.array(self.stops, np.int64)
        done = int(np.searchsorted(stops, size))
        ends[stops[:done]] = True
        cuts = np.searchsorted(stops[:done], np.arange(0, size + 1, self.length)).astype(np.int32)
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), type=k) for x, k in zip((ids, mask, ends), self.kinds)]
        docs = pa.ListArray.from_arrays(pa.array(cuts), pa.array(self.keys[:done], pa.int64()))
        self.file.write_batch(pa.record_batch([*lists, docs], schema=self.schema))
        self.parts, self.stops, self.keys, self.held = [rest] if len(rest) else [], (stops[done:] - size).tolist(), self.keys[done:], len(rest)

    def close(self) -> None:
        if self.held:
            self.flush(-(-self.held // self.length))
        self.file.close()
        self.sink.close()


def write(documents: DataFrame, folder: str, tokenizer: str, end: int = 2, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Encodes whole texts as the library's plain call does (strings of added tokens become these tokens), ends each with `end`, and writes them in ascending
    order of the key; returns a row per file: number, file, documents, ids.

    Each task writes one range of keys under a name of its own attempt and renames the finished file, so a repeated or speculative task replaces a file
    by the same content. Missing keys come first; rows of equal keys are ordered by text. A missing text is empty: its document is the end id
    alone. Other columns are not read. An empty table has no files. The key is an integer. `folder` must be reachable by all executors.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, task, writer = pieces.coder(tokenizer), TaskContext.get(), None
        store, root = _filesystem(folder)
        name = f"part-{task.partitionId():06d}.arrow"
        draft, count, tail = f"{root}/_{name}.{task.taskAttemptId()}", 0, np.array([end], coder.dtype)
        for batch in batches:
            for k, parts in _encoded(batch, coder):
                if writer is None:
                    store.create_dir(root, recursive=True)
                    writer = _Writer(store.open_output_stream(draft), coder.dtype, length)
                writer.add(k, [*parts, tail])
                count += 1
        if writer is not None:
            writer.close()
            store.move(draft, f"{root}/{name}")
            yield pa.RecordBatch.from_pydict({"number": [task.partitionId()], "file": [f"{folder}/{name}"], "documents": [count], "ids": [writer.total]})

    rows = documents.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    files = rows.repartitionByRange("key").sortWithinPartitions("key", "text").mapInArrow(run, "number long, file string, documents long, ids long")
    files.write.parquet(f"{folder}/manifest")
    return documents.sparkSession.read.schema("number long, file string, documents long, ids long").parquet(f"{folder}/manifest")


def sequences(uri: str) -> Iterator[pa.RecordBatch]:
    """The record batches of a file, mapped into memory where it is local."""
    store, path = _filesystem(uri)
    with (pa.memory_map(path) if store.type_name == "local" else store.open_input_file(path)) as source:
        reader = pa.ipc.open_file(source)
        for i in range(reader.num_record_batches):
            yield reader.get_batch(i)


def read_documents(files: DataFrame) -> DataFrame:
    """One row per document of the files that `write` returned: key, place (in its file), start (ids of all documents before it), n_tokens, ids_crc32."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, uri in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                open_ids, at, place = np.zeros(0, np.uint32), 0, 0
                for piece in sequences(uri):
                    real = piece.column(1).flatten().to_numpy(zero_copy_only=False)
                    ids = piece.column(0).flatten().to_numpy()[real].astype(np.uint32)
                    stops = np.flatnonzero(piece.column(2).flatten().to_numpy(zero_copy_only=False)) + 1
                    out, low = [], 0
                    for stop, key in zip(stops.tolist(), piece.column(3).flatten().to_pylist()):
                        whole = np.concatenate([open_ids, ids[low:stop]])
                        out.append((number, key, place, at, len(whole), zlib.crc32(whole.astype("<u4").tobytes())))
                        open_ids, low, at, place = open_ids[:0], stop, at + len(whole), place + 1
                    open_ids = np.concatenate([open_ids, ids[low:]])
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["number", "key", "place", "inside", "n_tokens", "ids_crc32"])

    before = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    # A row per file: as many as the write had tasks.
    bases = files.select("number", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    count = max(1, files.count())
    rows = files.select("number", "file").repartition(count).mapInArrow(run, "number long, key long, place long, inside long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(bases), "number").select("key", "number", "place", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
