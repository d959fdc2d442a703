"""Token-ID files with fixed-width bit packing: each id takes the minimum number of bits for the vocabulary.

64 ids of w bits fill exactly w 64-bit words (a group), so a whole range of ids is packed or unpacked by 64 numpy
operations on columns of groups. A file holds blocks of ``BLOCK`` ids, then a footer:

    "QTOK1\\0\\0\\0" | blocks, each of groups of w little-endian 64-bit words | block offsets, int64 each |
    document ids, int64 each | null marks, uint8 each | document starts, int64 each, one more than documents |
    tail: width, blocks, documents, ids, begin of the footer, int64 each | "QTOK1\\0\\0\\0"

Any range of ids is read with the footer and the blocks that hold it alone.

Writing: documents are dealt out by ranges of (doc_id, text's hash, row number), so that rows of one id can go to several
files, and sorted; each task tokenises its texts and writes one file under a name of its own, then moves it to its place,
so a task that is run again gives the same file. (Ids take as many bytes as the text, so nothing is saved by tokenising
before the shuffle.) The manifest (path, first id and counts of each file) has one row for each task; sums over it give
each file's place in the whole.

Stores: the driver resolves the folder by Spark's own rules (default store, mount points) to a full address; tasks open
it with Arrow's file systems (file, hdfs, s3, gs, abfs).

Defined cases: a null text is an empty text: only its end id; null document ids come first and are kept; repeated rows
are written each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import fresh_path
from quillon.llm.text_arrays import releasing
from quillon.llm.word_ids import encoder, text_rows

MAGIC = b"QTOK1\0\0\0"
BLOCK = 1 << 16
MANIFEST = "part int, path string, n_docs long, n_ids long"


def width_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids in groups of 64; the last group is filled up with zeros."""
    groups = np.zeros((-(-len(ids) // 64), 64), np.uint64)
    groups.reshape(-1)[: len(ids)] = ids
    words = np.zeros((len(groups), width), np.uint64)
    for j in range(64):
        at, shift = divmod(j * width, 64)
        words[:, at] |= groups[:, j] << np.uint64(shift)
        if shift + width > 64:
            words[:, at + 1] |= groups[:, j] >> np.uint64(64 - shift)
    return words.astype("<u8").tobytes()


def unpack(data: bytes, width: int, n: int) -> np.ndarray:
    words = np.frombuffer(data, "<u8").reshape(-1, width)
    groups, mask = np.empty((len(words), 64), np.uint32), np.uint64((1 << width) - 1)
    for j in range(64):
        at, shift = divmod(j * width, 64)
        got = words[:, at] >> np.uint64(shift)
        if shift + width > 64:
            got = got | (words[:, at + 1] << np.uint64(64 - shift))
        groups[:, j] = got & mask
    return groups.reshape(-1)[:n]


#: Names of stores that differ between Spark and Arrow.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "gs": "gs", "abfss": "abfs", "abfs": "abfs", "wasbs": "abfs"}


def full_address(spark: SparkSession, path: str) -> str:
    """The path with the store that Spark takes it to lie in, mount points resolved."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    given = jvm.org.apache.hadoop.fs.Path(path)
    return given.getFileSystem(conf).resolvePath(given).toString()


def _store(path: str):
    scheme, mark, rest = path.partition(":")
    if not mark:
        return pafs.LocalFileSystem(), path
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pafs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}:{rest}")


class TokenFileWriter:
    """Takes documents in order; nothing but one open block is held."""

    def __init__(self, path: str, width: int):
        self.width, self.path = width, path
        self.fs, self.at = _store(path)
        self.temporary = f"{self.at}.{uuid.uuid4().hex}.tmp"
        self.fs.create_dir(os.path.dirname(self.at), recursive=True)
        self.out = self.fs.open_output_stream(self.temporary)
        self.out.write(MAGIC)
        self.place, self.offsets, self.docs, self.nulls, self.starts, self.open, self.held = 8, [], [], [], [0], [], 0

    def _write(self, ids: np.ndarray) -> None:
        self.offsets.append(self.place)
        self.out.write(data := pack(ids, self.width))
        self.place += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.starts.append(self.starts[-1] + len(ids))
        self.open.append(ids)
        self.held += len(ids)
        if self.held >= 16 * BLOCK:
            self._flush(False)

    def _flush(self, rest: bool) -> None:
        ids = np.concatenate(self.open) if self.open else np.empty(0, np.uint32)
        whole = len(ids) if rest else len(ids) // BLOCK * BLOCK
        for a in range(0, whole, BLOCK):
            self._write(ids[a : min(a + BLOCK, whole)])
        self.open, self.held = [ids[whole:]], len(ids) - whole

    def close(self) -> tuple[int, int]:
        self._flush(True)
        footer = self.place
        self.out.write(np.asarray(self.offsets, "<i8").tobytes() + np.asarray(self.docs, "<i8").tobytes() + np.asarray(self.nulls, "u1").tobytes() + np.asarray(self.starts, "<i8").tobytes())
        self.out.write(np.asarray([self.width, len(self.offsets), len(self.docs), self.starts[-1], footer], "<i8").tobytes() + MAGIC)
        self.out.close()
        self.fs.move(self.temporary, self.at)
        return len(self.docs), self.starts[-1]


class TokenFile:
    """Random access to one file."""

    def __init__(self, path: str):
        fs, at = _store(path)
        self.file = fs.open_input_file(at)
        size = self.file.size()
        tail = self.file.read_at(48, size - 48)
        if tail[40:] != MAGIC:
            raise ValueError(f"{path} is no token file")
        self.width, blocks, docs, self.n_ids, begin = map(int, np.frombuffer(tail[:40], "<i8"))
        footer = self.file.read_at(size - 48 - begin, begin)
        cut = np.cumsum([0, 8 * blocks, 8 * docs, docs, 8 * docs + 8])
        self.offsets, self.docs, self.nulls, self.starts = (np.frombuffer(footer[cut[i] : cut[i + 1]], kind) for i, kind in enumerate(("<i8", "<i8", "u1", "<i8")))
        self.ends = np.append(self.offsets[1:], begin)

    def ids(self, a: int, b: int) -> np.ndarray:
        """Ids a up to b of the file."""
        if a >= b:
            return np.empty(0, np.uint32)
        first, last = a // BLOCK, (b - 1) // BLOCK
        data = self.file.read_at(int(self.ends[last] - self.offsets[first]), int(self.offsets[first]))
        return unpack(data, self.width, b - first * BLOCK)[a - first * BLOCK :]

    def close(self) -> None:
        self.file.close()


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, vocabulary: int, doc_id: str = "doc_id", text: str = "text") -> list[tuple[int, str, int, int]]:
    """Writes the files and returns their manifest in order."""
    spark, width = docs.sparkSession, width_for(vocabulary)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
    path = full_address(spark, path)

    def write(batches):
        part, out, end = TaskContext.get().partitionId(), None, np.asarray([end_id], "<u4")
        for batch in batches:
            for rows, texts in text_rows(batch, "text"):
                out = out or TokenFileWriter(f"{path}/part-{part:06d}.qtok", width)
                for doc, data in zip(rows.column("doc").to_pylist(), encoder(tokenizer).encode(texts), strict=True):
                    out.add(doc, np.append(np.frombuffer(data, "<u4"), end))
        if out:
            n_docs, n_ids = out.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [f"{path}/part-{part:06d}.qtok"], "n_docs": [n_docs], "n_ids": [n_ids]}, pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    order = [F.col("doc").asc_nulls_first(), F.col("key"), F.col("row")]
    given = docs.select(F.col(doc_id).cast("long").alias("doc"), F.xxhash64(text).alias("key"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"))
    ordered = given.repartitionByRange(*order).sortWithinPartitions(*order).select("doc", "text")
    return sorted(tuple(r) for r in ordered.mapInArrow(releasing(write), MANIFEST).collect())  # a row for each task


def read_tokens(spark: SparkSession, manifest: list[tuple[int, str, int, int]], doc_id: str = "doc_id") -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files."""
    if not manifest:
        return spark.createDataFrame([], f"{doc_id} long, start long, n_tokens long, ids_crc32 long")
    begins = np.cumsum([0, *[n for *_, n in manifest]])
    rows = [(path, int(begin)) for (_, path, _, _), begin in zip(manifest, begins[:-1], strict=True)]
    files = spark.createDataFrame(rows, "path string, begin long").repartition(len(rows), "path")

    def read(batches):
        for batch in batches:
            for path, begin in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                f = TokenFile(path)
                for a in range(0, len(f.docs), 2000):
                    yield _digest(f, begin, a, min(a + 2000, len(f.docs)))
                f.close()

    def _digest(f, begin, a, b):
        crcs, at = [], int(f.starts[a])
        while a + len(crcs) < b:  # about a million ids at a time
            i = a + len(crcs)
            j = max(i + 1, min(b, int(np.searchsorted(f.starts, f.starts[i] + (1 << 20)))))
            at, ids = int(f.starts[i]), f.ids(int(f.starts[i]), int(f.starts[j])).astype("<u4")
            crcs += [zlib.crc32(ids[f.starts[k] - at : f.starts[k + 1] - at].tobytes()) for k in range(i, j)]
        starts = f.starts[a : b + 1]
        docs = pa.array(f.docs[a:b], mask=f.nulls[a:b].astype(bool))
        return pa.RecordBatch.from_arrays([docs, pa.array(starts[:-1] + begin), pa.array(np.diff(starts)), pa.array(crcs, pa.int64())], [doc_id, "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(releasing(read), f"{doc_id} long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int, vocabulary: int) -> DataFrame:
    spark = docs.sparkSession
    return read_tokens(spark, write_tokens(docs, fresh_path(spark, "tokens"), tokenizer, end_id, vocabulary))
