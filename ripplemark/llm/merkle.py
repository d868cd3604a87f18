"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces of a text.

Sections are parted by a blank line, paragraphs by a line break, pieces are runs of PIECE space-separated parts of a
paragraph; joined again they give the very text. A node's digest covers its children's digests and its kind, so equal
roots mean equal texts, and walking down differing branches locates an edit.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from hashlib import blake2b

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, parts_for, slices

PIECE = 4
BYTES = 16


@dataclass(frozen=True)
class Tree:
    """root: hex digest; pieces: digest -> bytes of all pieces that have it; size: bytes of all pieces."""

    root: str
    pieces: Counter
    size: int


def tree(text: str) -> Tree:
    pieces: Counter = Counter()
    size, sections = 0, []
    for section in text.split("\n\n"):
        paragraphs = []
        for paragraph in section.split("\n"):
            words, digests = paragraph.split(" "), []
            for i in range(0, len(words), PIECE):
                data = " ".join(words[i : i + PIECE]).encode("utf-8", "surrogatepass")
                digest = blake2b(data, digest_size=BYTES, person=b"piece").digest()
                digests.append(digest)
                pieces[digest] += len(data) + 1
                size += len(data) + 1
            paragraphs.append(blake2b(b"".join(digests), digest_size=BYTES, person=b"paragraph").digest())
        sections.append(blake2b(b"".join(paragraphs), digest_size=BYTES, person=b"section").digest())
    return Tree(blake2b(b"".join(sections), digest_size=BYTES, person=b"document").hexdigest(), pieces, size)


def likeness(a: Tree, b: Tree) -> float:
    """Share of both texts' bytes that lie in pieces of equal digest; 1 if the roots agree."""
    if a.root == b.root:
        return 1.0
    few, many = (a, b) if len(a.pieces) <= len(b.pieces) else (b, a)
    return 2 * sum(min(n, many.pieces[d]) for d, n in few.pieces.items() if d in many.pieces) / (a.size + b.size)


def edited(text: str, following: str) -> str:
    """text with its last half replaced by as many code points of the following text, or all it has."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare(text: str, own: Tree, following: str, after: Tree) -> tuple:
    changed = edited(text, following)
    changed_tree = tree(changed)
    return len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), own.root, changed_tree.root, likeness(own, changed_tree), likeness(own, after)


#: Rows of a partition: results, and the first and the last document, whose neighbours are in other partitions.
STAGED = f"part int, kind string, doc_id long, text string, {RESULT}"


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_id and RESULT for every row, each compared with the next row in doc_id order (the last with the first).

    Null texts are empty; null ids come first; rows of one id are ordered by their texts' hash. A single row is its
    own next. Texts are shuffled once, into ranges of doc_id; a partition's first and last text go on to a second,
    small step that pairs the ends of neighbouring partitions.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt = rows.repartitionByRange(parts or parts_for(rows), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    types = [pa.int32(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [x.split()[0] for x in STAGED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId(), None
        blank = (None,) * 6

        def packed(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate(types)], names=names)

        for batch in slices(batches, 1):
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = tree(text)
                if last is None:
                    out.append((part, "first", doc_id, text, *blank))
                else:
                    out.append((part, "done", last[0], None, *compare(last[1], last[2], text, own)))
                last = (doc_id, text, own)
            yield packed(out)
        if last is not None:
            yield packed([(part, "last", last[0], last[1], *blank)])

    staged = cut(dealt.mapInArrow(run, STAGED), "merkle")
    ends = staged.where("kind = 'last'").select("part", "doc_id", "text")
    line = Window.orderBy("part")
    order = ends.select(F.col("part").alias("p"), F.coalesce(F.lead("part").over(line), F.min("part").over(Window.partitionBy())).alias("next_part"))
    heads = staged.where("kind = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("following"))
    pairs = ends.join(order, F.col("part") == F.col("p")).join(heads, "next_part").select("doc_id", "text", "following")

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            out = [(i, *compare(t, tree(t), f, tree(f))) for i, t, f in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate([pa.int64(), *types[4:]])], names=["doc_id", *names[4:]])

    done = staged.where("kind = 'done'").select("doc_id", *names[4:])
    return done.unionByName(pairs.mapInArrow(ended, f"doc_id long, {RESULT}"))


NODES = "level int, section int, paragraph int, piece int, digest string, chars int"


def nodes(docs: DataFrame) -> DataFrame:
    """doc_id and the nodes of every text's tree: level 0 document, 1 section, 2 paragraph, 3 piece; positions from 0,
    null above their level; chars: code points of a piece."""
    kinds = [pa.int32()] * 4 + [pa.string(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 1 << 20):
            ids, out = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = list(_nodes(text or ""))
                ids += [doc_id] * len(found)
                out += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds))], names=["doc_id", *(x.split()[0] for x in NODES.split(", "))])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"doc_id long, {NODES}")


def _nodes(text: str) -> Iterator[tuple]:
    sections = []
    for s, section in enumerate(text.split("\n\n")):
        paragraphs = []
        for p, paragraph in enumerate(section.split("\n")):
            words, digests = paragraph.split(" "), []
            for i in range(0, len(words), PIECE):
                data = " ".join(words[i : i + PIECE])
                digests.append(blake2b(data.encode("utf-8", "surrogatepass"), digest_size=BYTES, person=b"piece").digest())
                yield 3, s, p, i // PIECE, digests[-1].hex(), len(data)
            paragraphs.append(blake2b(b"".join(digests), digest_size=BYTES, person=b"paragraph").digest())
            yield 2, s, p, None, paragraphs[-1].hex(), None
        sections.append(blake2b(b"".join(paragraphs), digest_size=BYTES, person=b"section").digest())
        yield 1, s, None, None, sections[-1].hex(), None
    yield 0, None, None, None, blake2b(b"".join(sections), digest_size=BYTES, person=b"document").hexdigest(), None


def locate_edits(old: DataFrame, new: DataFrame) -> DataFrame:
    """Paragraphs that differ between two versions of documents: doc_id, section, paragraph, change (added, deleted,
    modified). Only documents whose roots differ, and of those only sections that differ, are compared further.
    A document that only one version has is all added or all deleted; a null id is an id like any other, and a null text is
    an empty one. Ids must be unique in each version; an empty version has no documents; other columns are ignored."""
    a, b = nodes(old), nodes(new)
    at = ["doc_id", "section", "paragraph"]

    def differing(level: int, x: DataFrame, y: DataFrame, keys: list[str]) -> DataFrame:
        one = x.where(F.col("level") == level).select(*keys, F.col("digest").alias("was"))
        two = y.where(F.col("level") == level).select(*keys, F.col("digest").alias("now"))
        two = two.select(*[F.col(k).alias(f"_{k}") for k in keys], "now")
        same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
        found = one.join(two, same, "full").where("not (was <=> now)")
        own = F.col("was").isNotNull()
        return found.select(*[F.when(own, F.col(k)).otherwise(F.col(f"_{k}")).alias(k) for k in keys], "was", "now")

    def within(x: DataFrame, some: DataFrame, keys: list[str]) -> DataFrame:
        some = some.select(*[F.col(k).alias(f"_{k}") for k in keys])
        return x.join(some, reduce(lambda p, q: p & q, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]), "left_semi")

    docs = differing(0, a, b, at[:1]).select("doc_id")
    a, b = within(a, docs, at[:1]), within(b, docs, at[:1])
    sections = differing(1, a, b, at[:2]).select(*at[:2])
    a, b = within(a, sections, at[:2]), within(b, sections, at[:2])
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").otherwise("modified")
    return differing(2, a, b, at).select(*at, change.alias("change"))


def query(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    return with_next(docs)
