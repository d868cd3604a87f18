"""Packing by power-of-two decomposition: a document's ids are cut into binary-length pieces, equal lengths make a bucket.

A document of n ids has n // most pieces of most ids and, after them, one piece for every binary digit of the rest,
longest first. A piece is a sequence of its own, so no sequence crosses documents and none needs padding. Sequences are
numbered bucket by bucket, shorter lengths first, without gaps, so a bucket is a range of sequence ids.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, remember, slices
from .records import tokenizer_path, vocabulary_size

MOST = 1024
#: Rows of (length, task) counts that are broadcast, some 30 bytes each; more are joined by a shuffle.
BROADCAST_COUNTS = 500_000
#: Chunks a worker remembers at least, twice as many at most, each of LONG_CHUNK characters at most (130 MB in all).
REMEMBERED, LONG_CHUNK = 400_000, 64
#: Characters that are encoded at a time where the text can be cut, and bytes of ids in a batch.
STRETCH, BATCH_BYTES = 1 << 18, 4 << 20
PIECE = "doc_id long, start long, length long, doc_tokens long, ids_crc32 long, part int, nth long, ids binary"

# How a byte-level vocabulary of this kind cuts texts, as its file and the library describe it.
SPLITTER = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space other than blank, tab and line ends, as Unicode or as Python has it.
ODD_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
CHUNK = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
#: Texts of ASCII and Latin letters, whose chunks are finer: letters with a blank before them, or what lies between.
LETTERS, PLAIN = r"A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f", re.compile(r"[\t\n\r\x20-\x7e\xa1-\xa9\xab-\xb4\xb6-\xb9\xbb-\u024f]*")
FINE = re.compile(rf" ?[{LETTERS}]++|[ \t\n\r]+(?= [{LETTERS}])|[ \t\n\r]*(?:[^ \t\n\r{LETTERS}]++(?:(?<=')[{LETTERS}]++)?|(?<=[\t\n\r])[{LETTERS}]++)|[ \t\n\r]+")
WORD = re.compile(rf"[{LETTERS}]++")
#: White space other than single blanks and up to two line ends between words.
UNEVEN = ("  ", " \n", "\n ", "\n\n\n", "\t", "\r")
#: Where a text may be cut without a change to its ids: before white space after anything else, between a mark and a letter.
SEAM = re.compile("(?<=[!-~\u4e00-\u9fff])(?=[ \\n])|(?<=[\u3002\uff0c\uff01\uff1f\uff1b\uff1a\u3001])(?=[\u3041-\u3094\u30a1-\u30fa\u4e00-\u9fff])")


class _Known(dict):
    """ids of chunks in two generations: when REMEMBERED chunks are new, those before are let go."""

    def __init__(self, make: Callable[[str], bytes], old: dict[str, bytes]) -> None:
        super().__init__()
        self.make, self.old = make, old

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            ids = self.make(chunk)
        if len(chunk) <= LONG_CHUNK:
            self[chunk] = ids
        return ids

    def next(self) -> _Known:
        """This generation, or once it is full the next, which remembers this one alone."""
        if len(self) <= REMEMBERED:
            return self
        self.old = {}
        return _Known(self.make, self)


class Encoder:
    """Bytes of ids (of a width) for texts, by the tokenizers library.

    A vocabulary whose file has no normalizer and the splitter above never lets a piece reach from other characters into
    white space. So the ids of a text are those of its chunks (white space and what follows it) in a row, and in texts of Latin letters
    those of words and what lies between. Chunks are remembered; those of Latin letters go to the library's model piece by
    piece, others to the library. Texts
    that hold other white space or spell a special token, and all texts for any other file, go to the library whole, in
    stretches if a seam allows it.
    """

    def __init__(self, path: str, width: int) -> None:
        from tokenizers import Tokenizer

        self.tok, self.kind = Tokenizer.from_file(path), f"<u{width}"
        described = json.loads(self.tok.to_str())
        self.by_chunk = described["normalizer"] is None and described["pre_tokenizer"] == SPLITTER and described["model"]["type"] == "BPE" and not described["model"]["ignore_merges"]
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.seams = self.by_chunk and not any(re.search(r"\s", t) for t in self.special)
        self.pieces, self.model = regex.compile(PIECES), self.tok.model
        self.packed = [struct.Struct({2: "<%dH", 4: "<%dI"}[width] % n).pack for n in range(LONG_CHUNK)]
        # bytes without a visible character of their own are spelled as those from 256 on
        hidden = [i for i in range(256) if not (0x21 <= i <= 0x7E or 0xA1 <= i <= 0xFF and i != 0xAD)]
        self.spelling = {i: 256 + n for n, i in enumerate(hidden)}
        self.blank = chr(self.spelling[0x20])
        self.forget()

    def chunk(self, chunk: str) -> bytes:
        if not PLAIN.fullmatch(chunk):
            return self.whole(chunk)
        bare = chunk[1:] if chunk[0] == " " else chunk
        if bare.isascii() and bare.isalpha():
            ids = [t.id for t in self.model.tokenize(bare if bare is chunk else self.blank + bare)]
        else:
            pieces = [chunk] if bare.isalpha() else self.pieces.findall(chunk)
            ids = [t.id for piece in pieces for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.spelling))]
        return self.packed[len(ids)](*ids) if len(ids) < LONG_CHUNK else np.array(ids, self.kind).tobytes()

    def whole(self, text: str) -> bytes:
        return b"".join(np.array(self.tok.encode(s, add_special_tokens=False).ids, dtype=self.kind).tobytes() for s in self.stretches(text))

    def stretches(self, text: str) -> Iterator[str]:
        at = 0
        while at < len(text):
            seam = SEAM.search(text, at + STRETCH) if self.seams and len(text) - at > STRETCH else None
            end = seam.start() if seam else len(text)
            yield text[at:end]
            at = end

    def __call__(self, text: str) -> bytes:
        plain = PLAIN.fullmatch(text)
        if not self.by_chunk or (not plain and ODD_SPACE.search(text)) or any(t in text for t in self.special):
            return self.whole(text)
        if plain and 0 < len(text) <= STRETCH and text[0] not in " \n" and text[-1] not in " \n" and not any(x in text for x in UNEVEN):
            # every word but the first has one blank or line end before it
            first, *words = text.replace("\n", " \n").split(" ")
            self.words, self.known = self.words.next(), self.known.next()
            return self.fine(first) + b"".join(map(self.words.__getitem__, words))
        made, found = [], FINE.findall if plain else CHUNK.findall
        for stretch in self.stretches(text):
            self.known = self.known.next()
            made.append(b"".join(map(self.known.__getitem__, found(stretch))))
        return b"".join(made)

    def fine(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, FINE.findall(text)))

    def word(self, word: str) -> bytes:
        """ids of a word and the blank before it; or, if it begins with one, of a line end and a word."""
        if word[0] == "\n":
            return self.known["\n"] + self.fine(word[1:])
        if word.isalpha():
            return self.chunk(" " + word)
        letters = WORD.match(word)  # letters are a piece, whatever follows them begins another
        return self.words[letters.group()] + self.fine(word[letters.end() :]) if letters else self.fine(" " + word)

    def forget(self) -> None:
        self.known, self.words = _Known(self.chunk, {}), _Known(self.word, {})


@cache
def _encoder(path: str, width: int) -> Encoder:
    return Encoder(path, width)


def lengths(n: int, most: int = MOST) -> list[int]:
    """The binary lengths of n ids: as often most as it fits, then the digits of what is left, from the highest."""
    rest = n % most
    return [most] * (n // most) + [1 << i for i in range(rest.bit_length() - 1, -1, -1) if rest >> i & 1]


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, most: int = MOST) -> DataFrame:
    """Pieces of docs' texts, each a sequence: doc_id, start (the document's ids before it), length, doc_tokens,
    sequence_id, offset (always 0), ids (binary, little-endian, of 2 bytes where the vocabulary allows, else 4), ids_crc32
    (of the ids as unsigned 32-bit).

    docs: doc_id, text; more columns, whatever their names, are ignored. most is a power of two. A null text is an empty
    one: its document is end_id alone, a sequence of length 1. Null or repeated ids and repeated rows are documents each.
    No documents give no sequences. Texts are encoded in one pass where they are read and written once; what numbers the
    sequences is a count for each length and task. So ids follow the splits of the scan, and what is written stays as it is
    if executors are lost.
    """
    if most < 1 or most & (most - 1):
        raise ValueError(f"{most} is no power of two")
    path = tokenizer_path(tokenizer)
    width = 2 if vocabulary_size(path) <= 1 << 16 and end_id < 1 << 16 else 4
    end = np.array([end_id], dtype=f"<u{width}").tobytes()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encode = _encoder(tokenizer_path(tokenizer), width)
        remember("packing", encode.forget)
        counts: dict[int, int] = {}
        made, held = [], 0
        for batch in slices(batches, 1, kind="packing"):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py()) + end
                wide = memoryview(np.frombuffer(ids, f"<u{width}").astype("<u4")).cast("B")
                n, start = len(ids) // width, 0
                for length in lengths(n, most):
                    nth = counts.get(length, 0)
                    counts[length] = nth + 1
                    made.append((doc_id, start, length, n, zlib.crc32(wide[4 * start : 4 * (start + length)]), part, nth, ids[width * start : width * (start + length)]))
                    start += length
                    held += width * length
                    if held >= BATCH_BYTES:
                        yield _batch(made)
                        made, held = [], 0
        if made:
            yield _batch(made)

    pieces = cut(rows.mapInArrow(run, PIECE), "pieces")
    # tasks number their own pieces of a length; what is before a task's follows from the tasks' counts
    counts = cut(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-counts")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = counts.groupBy("length").agg(F.sum("n").alias("n"))  # a row for each power of two up to most
    lower = F.coalesce(F.sum("n").over(Window.orderBy("length").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = counts.withColumn("base", before).join(F.broadcast(sizes.select("length", lower.alias("lower"))), "length")
    bases = bases.select("length", "part", (F.col("base") + F.col("lower")).alias("base"))
    numbered = pieces.join(F.broadcast(bases) if counts.count() <= BROADCAST_COUNTS else bases, ["length", "part"])
    return numbered.select("doc_id", "start", "length", "doc_tokens", (F.col("base") + F.col("nth")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "ids", "ids_crc32")


def _batch(made: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in made], kind) for i, kind in enumerate(kinds)], names=[c.split()[0] for c in PIECE.split(", ")])


def batches(packed: DataFrame, tokens: int, seed: int = 0) -> DataFrame:
    """Training batches of pack()'s sequences, each of one bucket and of `tokens` ids: adds batch (of the bucket, from 0)
    and slot (in it). Shorter sequences come in larger batches; a bucket's last batch may hold fewer. The order within a
    bucket is a permutation that the seed fixes. Sequences longer than tokens are batches of one; no rows give none."""
    spans = packed.groupBy("length").agg(F.min("sequence_id").alias("__first"), F.count("*").alias("__n"))
    each = F.greatest(F.lit(1), F.floor(F.lit(tokens) / F.col("length")))
    # x -> (a x + b) mod n is a permutation of a bucket's n sequences if a is a prime that doesn't divide n
    step = F.lit(2_147_483_647).cast("decimal(38,0)")
    place = ((F.col("sequence_id") - F.col("__first")).cast("decimal(38,0)") * step + F.lit(seed)) % F.col("__n")
    moved = packed.join(F.broadcast(spans), "length").withColumn("__place", F.when(F.col("__n") % 2_147_483_647 == 0, F.col("sequence_id") - F.col("__first")).otherwise(place).cast("long"))
    return moved.withColumn("batch", F.floor(F.col("__place") / each)).withColumn("slot", F.col("__place") % each).drop("__first", "__n", "__place")


def query(docs: DataFrame) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece."""
    return pack(docs, "byte_bpe_50k.json").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
