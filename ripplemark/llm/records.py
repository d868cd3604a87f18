"""Token ids in length-delimited binary records, with a separate offset index.

A record is, little-endian: length of the payload (8 bytes), masked checksum of those 8 bytes (4), the payload,
masked checksum of the payload (4). The payload is doc_id (8 bytes, signed), a flag byte (1: no doc_id), the width
of an id in bytes (1), and the ids. The index is a Parquet table with a row for each record. Spark's committer
writes it, so it names only files of tasks that ended well; what a lost executor has left behind is never read.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import parts_for, remember, scratch, slices

INDEX = "doc_id long, shard int, path string, offset long, bytes long, n_tokens long"
#: Chunks of text whose ids a Python worker remembers at least, twice as many at most; and the longest that it does. Most
#: take 160 bytes, so a worker holds 100 MB of them at most, for as long as its tasks encode.
REMEMBERED, LONG_CHUNK = 300_000, 64
#: Bytes of a record file that a task reads at a time.
READ_BYTES = 4 << 20
HEAD, BODY = "<QI", "<qBB"
HEAD_BYTES, BODY_BYTES = struct.calcsize(HEAD), struct.calcsize(BODY)


def masked(data: bytes) -> int:
    """CRC-32, rotated and offset, so that a checksum of data that holds checksums stays a good one."""
    x = zlib.crc32(data)
    return ((x >> 15 | x << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def payload(doc_id: int | None, ids: bytes, width: int) -> bytes:
    return struct.pack(BODY, doc_id or 0, doc_id is None, width) + ids


def complete(data: bytes, at: int) -> bool:
    return len(data) - at >= HEAD_BYTES and len(data) - at >= struct.unpack_from(HEAD, data, at)[0] + HEAD_BYTES + 4


def unframe(data: bytes | memoryview, at: int = 0) -> tuple[int | None, np.ndarray, int]:
    """doc_id and ids of the record at an offset, and where the next begins. Damage raises ValueError."""
    if len(data) < at + HEAD_BYTES:
        raise ValueError(f"record at {at}: it ends within its header")
    size, check = struct.unpack_from(HEAD, data, at)
    if masked(bytes(data[at : at + 8])) != check:
        raise ValueError(f"record at {at}: its length is damaged")
    begin, end = at + HEAD_BYTES, at + HEAD_BYTES + size
    if len(data) < end + 4:
        raise ValueError(f"record at {at}: it ends within its payload")
    if masked(bytes(data[begin:end])) != struct.unpack_from("<I", data, end)[0]:
        raise ValueError(f"record at {at}: its payload is damaged")
    doc_id, null, width = struct.unpack_from(BODY, data, begin)
    return (None if null else doc_id), np.frombuffer(data, f"<u{width}", (size - BODY_BYTES) // width, begin + BODY_BYTES), end + 4


# The word_bpe vocabulary's own description of how it cuts a text, as its file has it.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": PIECES}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


class _Chunks(dict):
    """ids of white-space-separated chunks. Two generations: when REMEMBERED chunks are new, those before are let go."""

    def __init__(self, make: Callable[[str], bytes], old: dict[str, bytes]) -> None:
        super().__init__()
        self.make, self.old = make, old

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            # a mark after letters is a piece of its own
            ids = self[chunk[:-1]] + self[chunk[-1]] if chunk[-1] in ".,;:!?" and chunk[:-1].isalpha() else self.make(chunk)
        if len(chunk) <= LONG_CHUNK:
            self[chunk] = ids
        return ids


class Encoder:
    """Bytes of ids (of a width) for texts, by the tokenizers library.

    A vocabulary whose file describes the normalizer and the splitter above splits at white space before anything else
    and never looks beyond a piece, so a text's ids are those of its pieces in a row. For such a file, pieces of texts
    of Latin letters and ASCII are given to the library's model one by one, and chunks are remembered. Every other
    text (other scripts, control characters, texts that spell a special token), and every text for any other file, is
    encoded as a whole.
    """

    def __init__(self, path: str, width: int) -> None:
        from tokenizers import Tokenizer

        self.tok, self.kind = Tokenizer.from_file(path), f"<u{width}"
        described = json.loads(self.tok.to_str())
        self.by_piece = described["normalizer"] == NORMALIZER and described["pre_tokenizer"] == SPLITTER and described["model"]["type"] == "BPE"
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.plain = re.compile(r"[\t\n\r\x20-\x7e\xa1-ɏ]*")
        self.pieces, self.model, self.packed = regex.compile(PIECES), self.tok.model, {2: "<%dH", 4: "<%dI"}[width]
        # byte-level spelling: bytes without a visible character of their own are written as those from 256 on
        hidden = [i for i in range(256) if not (0x21 <= i <= 0x7E or 0xA1 <= i <= 0xFF and i != 0xAD)]
        self.spelling = {i: 256 + n for n, i in enumerate(hidden)}
        self.chunks = _Chunks(self.chunk, {})

    def chunk(self, chunk: str) -> bytes:
        ids = []
        for piece in [chunk] if chunk.isalpha() else self.pieces.findall(chunk):
            spelled = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.spelling)
            ids += [t.id for t in self.model.tokenize(spelled)]
        return struct.pack(self.packed % len(ids), *ids)

    def __call__(self, text: str) -> bytes:
        if not (self.by_piece and self.plain.fullmatch(text)) or any(t in text for t in self.special):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype=self.kind).tobytes()
        if len(self.chunks) > REMEMBERED:
            self.chunks.old = {}
            self.chunks = _Chunks(self.chunk, self.chunks)
        return b"".join(map(self.chunks.__getitem__, text.lower().split()))

    def forget(self) -> None:
        self.chunks = _Chunks(self.chunk, {})


@cache
def _encoder(path: str, width: int) -> Encoder:
    return Encoder(path, width)


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, parts: int | None = None) -> DataFrame:
    """Encode docs, end each with end_id, write record files in ascending doc_id order; return the index.

    The order is global: shard files are ranges of doc_id and sorted within. A null text has no ids but the end;
    rows with a null doc_id come first; repeated ids are ordered by their texts' hash. tokenizer is a path that every
    worker can open, or the name of a file of the installed public tokenizers. folder must be one that executors share.
    """
    spark = docs.sparkSession
    path = tokenizer_path(tokenizer)
    width = 2 if vocabulary_size(path) <= 1 << 16 and end_id < 1 << 16 else 4
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt = rows.repartitionByRange(parts or parts_for(rows), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    end = np.array([end_id], dtype=f"<u{width}").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        store, base = pafs.FileSystem.from_uri(f"{folder}/records")
        name, out, offset = f"{shard:06d}-{uuid.uuid4().hex}.bin", None, 0
        encode = _encoder(tokenizer_path(tokenizer), width)
        remember("records", encode.forget)
        try:
            for batch in slices(batches, 1, kind="records"):
                if out is None:
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                doc_ids, sizes, counts, framed = batch.column(0).to_pylist(), [], [], []
                for doc_id, ids in zip(doc_ids, (encode(t.as_py()) for t in batch.column(1))):
                    framed.append(frame(payload(doc_id, ids + end, width)))
                    sizes.append(len(framed[-1]))
                    counts.append(len(ids) // width + 1)
                out.write(b"".join(framed))
                starts = offset + np.cumsum([0, *sizes])
                offset = int(starts[-1])
                n = len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([shard] * n, pa.int32()), pa.array([f"{folder}/records/{name}"] * n), pa.array(starts[:-1], pa.int64()), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())],
                    names=["doc_id", "shard", "path", "offset", "bytes", "n_tokens"],
                )
        finally:
            if out is not None:
                out.close()

    dealt.mapInArrow(run, INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def tokenizer_path(name: str) -> str:
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def shards(index: DataFrame) -> DataFrame:
    """A row for each record file, with the number of ids in the files before it."""
    files = index.groupBy("shard", "path").agg(F.sum("n_tokens").alias("n"), F.sum("bytes").alias("bytes"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return files.select("shard", "path", "bytes", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))


DECODED = "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"


def read_in_order(index: DataFrame, with_ids: bool = True) -> DataFrame:
    """Read the files from end to end: doc_id, start (ids before it in the whole collection), n_tokens, ids_crc32 and,
    if asked for, ids (little-endian unsigned 32-bit). Checksums are verified; damage fails the task."""
    files = shards(index)
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = pafs.FileSystem.from_uri(row["path"])
                start, at, base, data = row["start"], 0, 0, b""
                with store.open_input_stream(path, compression=None) as source:
                    while base + at < row["bytes"]:
                        data = data[at:] + source.read(READ_BYTES)
                        base, at, out = base + at, 0, []
                        while complete(data, at):
                            doc_id, ids, at = unframe(data, at)
                            raw = ids.astype("<u4").tobytes()
                            out.append((doc_id, start, len(ids), zlib.crc32(raw), raw if with_ids else None))
                            start += len(ids)
                        if not out and source.tell() >= row["bytes"]:
                            raise ValueError(f"{path} is cut short or damaged at {base}")
                        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return files.repartition(parts, "path").mapInArrow(run, DECODED)


def read_shuffled(index: DataFrame, seed: int = 0) -> DataFrame:
    """(epoch_order, doc_id, ids) of single records fetched by offset, in a random order that the seed fixes.

    A record of a null text has no ids but the end; records without an id have a null doc_id; repeated rows are records
    of their own; an empty index gives an empty table."""
    spark = index.sparkSession
    order = F.xxhash64(F.lit(seed), "doc_id", "shard", "offset")
    dealt = index.select(order.alias("epoch_order"), "path", "offset", "bytes").repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "epoch_order").sortWithinPartitions("epoch_order")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: dict = {}
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["path"] not in files:
                    if len(files) >= 256:
                        files.pop(next(iter(files))).close()
                    store, path = pafs.FileSystem.from_uri(row["path"])
                    files[row["path"]] = store.open_input_file(path)
                source = files[row["path"]]
                source.seek(row["offset"])
                doc_id, ids, _ = unframe(source.read(row["bytes"]))
                out.append((row["epoch_order"], doc_id, ids.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["epoch_order", "doc_id", "ids"])

    return dealt.mapInArrow(run, "epoch_order long, doc_id long, ids binary")


def query(docs: DataFrame) -> DataFrame:
    """Write docs as records in the shared folder and read them back: doc_id, start, n_tokens, ids_crc32."""
    spark: SparkSession = docs.sparkSession
    index = write_records(docs, scratch(spark, "records"), "word_bpe_49k.json")
    return read_in_order(index, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")
