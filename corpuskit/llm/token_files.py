"""Token ids as binary files: ids end to end, document boundaries and document ids as Elias-Fano sequences.

A folder holds ``data`` and the Parquet table ``manifest``. ``data`` holds pairs of files: ``NAME.ids`` are the ids of
consecutive documents as little-endian integers of 2 bytes, or of 4 for vocabularies beyond 65,536 ids. ``NAME.bounds``
is a header, the place behind every document's ids, and the documents' ids less the smallest, the latter two as
Elias-Fano sequences. A row of the manifest names a pair and says how many documents and ids it holds; pairs that it does
not name are left by attempts that failed and are no part of the data. Documents lie in ascending order of their ids.
"""

from __future__ import annotations

import math
import os
import struct
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpuskit.llm.chunks import WORD_LEVEL, Cuts, Memory, encoded, kept
from corpuskit.llm.elias_fano import EliasFano
from corpuskit.llm.words import slices
from corpuskit.session import scratch_path

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2
# Ids after which a file is closed, bytes of text dealt to one writing task, and ids read at once.
FILE_IDS = 1 << 23
TASK_BYTES = 64 << 20
READ_IDS = 1 << 20
_GROUP = 1024

_MAGIC = b"TOKBNDS1"
_HEADER = "<8sIIQQq"
_MANIFEST = "part int, file int, name string, docs bigint, ids bigint"
_DOCUMENTS = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


class TokenWriter:
    """Writes documents, given in ascending order of their ids, to pairs of files of bounded size.

    Ids go to the file as they come; what is held of a file is two integers a document.
    """

    def __init__(self, folder: str, prefix: str, width: int, file_ids: int = FILE_IDS):
        self._fs, self._root = file_system(folder)
        self._fs.create_dir(self._root, recursive=True)
        self._prefix, self._kind, self._file_ids = prefix, np.dtype(f"<u{width}"), file_ids
        self._out, self._doc_ids, self._ends, self._number, self._nulls = None, [], [], 0, 0
        self.closed: list[tuple[int, str, int, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if self._out is None:
            self._out = self._fs.open_output_stream(f"{self._root}/{self._prefix}-{self._number}.ids")
        self._out.write(ids.astype(self._kind).tobytes())
        if doc_id is None:
            self._nulls += 1
        else:
            self._doc_ids.append(doc_id)
        self._ends.append((self._ends[-1] if self._ends else 0) + len(ids))
        if self._ends[-1] >= self._file_ids:
            self.close()

    def close(self) -> None:
        if self._out is None:
            return
        self._out.close()
        name = f"{self._prefix}-{self._number}"
        base = self._doc_ids[0] if self._doc_ids else 0
        offsets = np.array(self._doc_ids, np.int64).view(np.uint64) - np.array([base], np.int64).view(np.uint64)
        header = struct.pack(_HEADER, _MAGIC, self._kind.itemsize, 0, len(self._ends), self._nulls, base)
        with self._fs.open_output_stream(f"{self._root}/{name}.bounds") as out:
            out.write(header)
            out.write(EliasFano.build(np.array(self._ends, np.uint64)).to_bytes())
            out.write(EliasFano.build(offsets).to_bytes())
        self.closed.append((self._number, name, len(self._ends), self._ends[-1]))
        self._out, self._doc_ids, self._ends, self._nulls = None, [], [], 0
        self._number += 1


@dataclass(frozen=True)
class TokenReader:
    """A pair of files; documents are found by their place without reading the ids of others."""

    ends: EliasFano
    ids_after: EliasFano
    docs: int
    nulls: int
    base: int
    kind: np.dtype
    source: pa.NativeFile

    @classmethod
    def open(cls, folder: str, name: str) -> TokenReader:
        files, root = file_system(folder)
        with files.open_input_file(f"{root}/{name}.bounds") as file:
            data = file.read()
        magic, width, _, docs, nulls, base = struct.unpack_from(_HEADER, data)
        if magic != _MAGIC:
            raise ValueError(f"{name}.bounds is no boundary file")
        ends, at = EliasFano.from_bytes(data, struct.calcsize(_HEADER))
        ids_after, _ = EliasFano.from_bytes(data, at)
        return cls(ends, ids_after, docs, nulls, base, np.dtype(f"<u{width}"), files.open_input_file(f"{root}/{name}.ids"))

    def offsets(self, first: int, last: int) -> np.ndarray:
        """Where the documents ``first`` to ``last - 1`` begin, and where the last of them ends."""
        begin = np.array([0], np.uint64) if first == 0 else self.ends.select(np.array([first - 1]))
        return np.concatenate([begin, self.ends.select(np.arange(first, last))]).astype(np.int64)

    def doc_ids(self, first: int, last: int) -> list[int | None]:
        at = np.arange(max(first, self.nulls), max(last, self.nulls)) - self.nulls
        after = self.ids_after.select(at) + np.array([self.base], np.int64).view(np.uint64)
        return [None] * (last - first - len(at)) + after.view(np.int64).tolist()

    def ids(self, begin: int, end: int) -> np.ndarray:
        """The ids from place ``begin`` to ``end`` as unsigned 32-bit integers."""
        raw = self.source.read_at((end - begin) * self.kind.itemsize, begin * self.kind.itemsize)
        return np.frombuffer(raw, self.kind).astype("<u4")

    def document(self, place: int) -> tuple[int | None, np.ndarray]:
        begin, end = self.offsets(place, place + 1).tolist()
        return self.doc_ids(place, place + 1)[0], self.ids(begin, end)

    def runs(self, most: int = READ_IDS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``(first document, offsets, ids)`` of runs of documents with about ``most`` ids, or one document."""
        first = 0
        while first < self.docs:
            step = min(self.docs - first, 1 << 16)
            offsets = self.offsets(first, first + step)
            keep = max(1, int(np.searchsorted(offsets, offsets[0] + most, side="right")) - 1)
            offsets = offsets[: keep + 1]
            yield first, offsets, self.ids(int(offsets[0]), int(offsets[-1]))
            first += keep


def _tokenizer(vocabulary: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(vocabulary)


def chunk_memory(vocabulary: str) -> Memory:
    """Ids of chunks, by ``tokenizers`` without special tokens, as little-endian 32-bit integers."""
    tokenizer = _tokenizer(vocabulary)

    def make(chunks: Sequence[str]) -> list[bytes]:
        made = tokenizer.encode_batch_fast(chunks, add_special_tokens=False)
        return [np.array(one.ids, "<u4").tobytes() for one in made]

    return Memory(make)


def write_tokens(
    docs: DataFrame,
    path: str,
    vocabulary: str = VOCABULARY,
    end_id: int = END_ID,
    file_ids: int = FILE_IDS,
    task_bytes: int = TASK_BYTES,
    cuts: Cuts | None = WORD_LEVEL,
) -> None:
    """Encode every whole text, add ``end_id`` and write the files in ascending order of ``doc_id`` to a new folder.

    Documents are dealt by ranges of their id to tasks of about ``task_bytes`` of text, and a task closes a file after
    ``file_ids`` ids; a document is never split. Rows that repeat an id are documents of their own, in order of a hash of
    their text, and may lie in several files. Null ids come first, a null text is empty, and no rows give an empty
    manifest. Strings of special tokens in a text are encoded as the tokenizer does by default. ``path`` is on a file
    system shared by all executors. ``cuts`` says where the vocabulary's pre-tokenizer surely splits (see ``chunks``);
    None stands for blanks alone.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(2 * spark.sparkContext.defaultParallelism, math.ceil(size / task_bytes))
    width = 2 if Tokenizer.from_file(vocabulary).get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
    # The row's number spreads rows that are equal in all else.
    order = ["id", "mark", "row"]
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("id"),
        F.xxhash64("text").alias("mark"),
        F.monotonically_increasing_id().alias("row"),
        F.col("text").alias("text"),
    )
    sorted_rows = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).select("id", "text")
    folder = f"{path}/data"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = kept("token_files", (vocabulary, cuts is None), lambda: chunk_memory(vocabulary))
        task = TaskContext.get()
        part = task.partitionId()
        writer = TokenWriter(folder, f"part-{part:06d}-{task.taskAttemptId()}", width, file_ids)
        end = np.array([end_id], "<u4")
        for batch in (x for b in batches for x in slices(b)):
            ids, bounds = encoded(batch.column(1), memory, cuts)
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                writer.add(doc_id, np.concatenate([ids[bounds[i] : bounds[i + 1]], end]))
        writer.close()
        rows = [(part, *row) for row in writer.closed]
        columns = list(zip(*rows)) if rows else [()] * 5
        types = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
        names = ["part", "file", "name", "docs", "ids"]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names)

    sorted_rows.mapInArrow(write, _MANIFEST).write.parquet(f"{path}/manifest")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The pairs of files in order, with the documents and ids of all pairs before (``first_doc, start``)."""
    files = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")
    files = files.withColumn("block", F.floor(F.col("part") / _GROUP))
    sums = files.groupBy("block").agg(F.sum("docs").alias("docs"), F.sum("ids").alias("ids"))
    # One row per 1,024 tasks here, and the files of 1,024 tasks below.
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("block").orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sums.select("block", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_{c}") for c in ("docs", "ids")])
    return files.join(blocks, "block").select(
        "part",
        "file",
        "name",
        "docs",
        "ids",
        (F.col("_docs") + F.coalesce(F.sum("docs").over(before), F.lit(0))).alias("first_doc"),
        (F.col("_ids") + F.coalesce(F.sum("ids").over(before), F.lit(0))).alias("start"),
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, from the files.

    ``start`` counts the ids of all documents before; ``ids_crc32`` is the checksum of the document's ids, its end id
    included, as little-endian unsigned 32-bit integers.
    """
    files, folder = manifest(spark, path), f"{path}/data"
    tasks = max(1, min(files.count(), 8 * spark.sparkContext.defaultParallelism))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                reader = TokenReader.open(folder, name)
                with reader.source:
                    for first, offsets, ids in reader.runs():
                        docs, cuts = len(offsets) - 1, offsets - offsets[0]
                        sums = [zlib.crc32(ids[a:b]) for a, b in zip(cuts.tolist(), cuts[1:].tolist())]
                        yield pa.record_batch(
                            [
                                pa.array(reader.doc_ids(first, first + docs), pa.int64()),
                                pa.array(offsets[:-1] + start),
                                pa.array(np.diff(offsets)),
                                pa.array(sums, pa.int64()),
                            ],
                            ["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    return files.select("name", "start").repartition(tasks).mapInArrow(read, _DOCUMENTS)


def token_report(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID, **options) -> DataFrame:
    """Write all documents to a new folder among the scratch tables and read them back; see both functions."""
    path = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, vocabulary, end_id, **options)
    return read_tokens(docs.sparkSession, path)
