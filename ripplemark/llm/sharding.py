"""Shards of nearly equal bytes by histogram sort.

Rows are ordered by a hash of their text (so equal texts are neighbours), then by a hash of their id; where rows that agree
in both weigh too much for that, by a number among them. Splitters are
found on (hash, size) rows alone: each round counts the exact bytes below evenly spaced probes of every interval that
may hold a splitter, and narrows the interval to the gap that holds the target, until a boundary meets the tolerance
or nothing is left to narrow. Only then are whole rows exchanged, once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, scratch

LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
#: A splitter may miss its target by this share of a shard's bytes.
TOLERANCE = 0.01
#: Gaps into which a round divides an interval.
PROBES = 256


@dataclass(frozen=True)
class Splitter:
    """Rows with (text_key, row_key, number) below (text, row, copy) are below the splitter; bytes: how many bytes those have."""

    text: int
    row: int
    bytes: int
    target: float
    copy: int = 0


@dataclass(frozen=True)
class Copies:
    """Rows of one text_key and row_key that together pass the tolerance."""

    text: int
    row: int
    n: int
    bytes: int


def size_of(text: str = "text") -> Column:
    return (F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)) + 1).cast("long")


def text_key(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def row_key(doc_id: str = "doc_id") -> Column:
    return F.xxhash64(F.lit(1), F.col(doc_id).cast("long"))


def _search(rows: DataFrame, key: str, wanted: list[tuple[float, int]], slack: float) -> list[tuple[int, int, int, int]]:
    """For each (target, bytes below the rows) the nearest boundary of key: (key, bytes below it, and the last gap:
    first key of the next boundary at or above the target, bytes below that).

    All targets narrow their intervals in the same rounds, one small aggregation each; PROBES sums a target come back.
    """
    state = [{"low": LOWEST, "high": HIGHEST + 1, "below": base, "upto": None, "target": t, "base": base, "done": False} for t, base in wanted]
    while not all(s["done"] for s in state):
        live = [s for s in state if not s["done"]]
        spots = {}
        cases = []
        for s in live:
            spots.setdefault((s["low"], s["high"]), []).append(s)
        for n, (low, high) in enumerate(spots):
            step = max(1, -(-(high - low) // PROBES))
            # key - low may pass 2^63, so the offset is taken in two halves
            offset = F.col(key).cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")
            gap = F.floor(offset / F.lit(step).cast("decimal(20,0)")).cast("int")
            inside = (F.col(key) >= F.lit(low)) & (F.col(key) <= F.lit(high - 1))
            cases.append(F.when(inside, F.struct(F.lit(n).alias("n"), gap.alias("gap"))))
        counts = rows.select("size", F.explode(F.array_compact(F.array(*cases))).alias("at")).groupBy("at.n", "at.gap").agg(F.sum("size").alias("bytes")).collect()
        for n, (low, high) in enumerate(spots):
            step = max(1, -(-(high - low) // PROBES))
            gaps = sorted((r.gap, r.bytes) for r in counts if r.n == n)
            for s in spots[low, high]:
                below, found = s["below"], None
                for gap, size in gaps:
                    if below + size >= s["target"]:
                        found = (gap, size)
                        break
                    below += size
                if found is None:  # all rows are below the target
                    s.update(low=high, high=high, below=below, upto=below, done=True)
                    continue
                gap, size = found
                s.update(low=low + gap * step, high=min(high, low + (gap + 1) * step), below=below, upto=below + size)
                s["done"] = s["high"] - s["low"] <= 1 or min(s["target"] - s["below"], s["upto"] - s["target"]) <= slack
    return [(s["low"], s["below"], s["high"], s["upto"]) for s in state]


def heavy_copies(rows: DataFrame, limit: float) -> list[Copies]:
    """Rows (text_key, row_key, size) that agree in both keys and weigh over limit bytes together. As all bytes are shared
    out among such groups, there are fewer than total / limit of them."""
    sums = rows.groupBy("text_key", "row_key").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    found = sums.where((F.col("bytes") > F.lit(limit)) & (F.col("n") > 1)).collect()
    return sorted((Copies(r.text_key, r.row_key, r.n, r.bytes) for r in found), key=lambda c: (c.text, c.row))


def splitters(rows: DataFrame, shards: int, tolerance: float = TOLERANCE, heavy: list[Copies] = ()) -> list[Splitter]:
    """shards - 1 splitters of rows (text_key, row_key, size).

    A boundary between different texts is taken if it meets the tolerance. Where a single text with many copies
    straddles the target by more than that, its copies are split by row_key, and only then; where heavy copies of one
    row_key do, by their number.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    known = {(c.text, c.row): c for c in heavy}
    share = total / shards
    aims = [share * (i + 1) for i in range(shards - 1)]
    out: list[Splitter | None] = []
    refine = []
    for aim, (low, below, high, upto) in zip(aims, _search(rows, "text_key", [(a, 0) for a in aims], tolerance * share)):
        near = (low, below) if aim - below <= upto - aim else (high, upto)
        if abs(near[1] - aim) <= tolerance * share or high - low > 1 or not total:
            out.append(Splitter(near[0], LOWEST, near[1], aim))
        else:
            out.append(None)
            refine.append((len(out) - 1, aim, low, below, near))
    by_text: dict[tuple[int, int], list] = {}
    for x in refine:
        by_text.setdefault((x[2], x[3]), []).append(x)
    for (text, base), some in by_text.items():
        own = rows.where(F.col("text_key") == F.lit(text))
        for (i, aim, _, _, near), (low, below, high, upto) in zip(some, _search(own, "row_key", [(x[1], base) for x in some], tolerance * share)):
            row = (low, below) if aim - below <= upto - aim else (high, upto)
            closer = abs(row[1] - aim) < abs(near[1] - aim)
            copies = known.get((text, low)) if high - low <= 1 else None
            if copies and min(abs(row[1] - aim), abs(near[1] - aim)) > tolerance * share:
                each = copies.bytes / copies.n
                k = min(copies.n, max(0, round((aim - below) / each)))
                out[i] = Splitter(text, low, below + round(k * each), aim, k)
                continue
            out[i] = Splitter(text, row[0], row[1], aim) if closer and row[0] <= HIGHEST else Splitter(near[0], LOWEST, near[1], aim)
    return [s for s in out if s]


def assign(text: Column, row: Column, cuts: list[Splitter], copy: Column | None = None) -> Column:
    """Number of splitters at or below a row's key."""
    shard, number = F.lit(0), F.lit(0) if copy is None else copy
    for s in cuts:
        if s.text > HIGHEST:
            continue
        after = (row > F.lit(s.row)) | ((row == F.lit(s.row)) & (number >= F.lit(s.copy)))
        shard = shard + ((text > F.lit(s.text)) | ((text == F.lit(s.text)) & after)).cast("int")
    return shard


def spans(copies: Copies, cuts: list[Splitter]) -> list[tuple[int, int, int]]:
    """(shard, from, to): which numbers of heavy copies fall into which shards."""
    shard = sum((s.text, s.row, s.copy) <= (copies.text, copies.row, 0) for s in cuts)
    out, at = [], 0
    for k in sorted(s.copy for s in cuts if (s.text, s.row) == (copies.text, copies.row) and s.copy > 0):
        if k > at:
            out.append((shard, at, k))
        shard, at = shard + 1, max(at, k)
    return out + [(shard, at, copies.n)] * (copies.n > at)


def shard(docs: DataFrame, shards: int = 8, tolerance: float = TOLERANCE, carry: list[str] | None = None) -> DataFrame:
    """carry (docs' own columns by default) as a struct named row, with size, shard and slot.

    Shards have nearly equal bytes; slot counts from 0 without a gap in each. Equal texts share a shard unless one
    text has too many bytes for that. Null texts count as empty (size 1). Repeated rows are rows of their own; rows
    that agree in text and id are interchangeable and share a shard unless they alone pass the tolerance. An empty table
    has no shards.

    Rows are exchanged once, to chunks of a shard (by row_key, so that copies of one text part); a chunk's first slot
    is the number of rows in the chunks before it, known from a count of the keys. Heavy copies aren't exchanged: they are
    written once and numbered by their place in those files, and take the last slots of their shards.
    """
    names = carry or docs.columns
    spark = docs.sparkSession
    keyed = docs.select(F.struct(*names).alias("row"), text_key().alias("text_key"), row_key().alias("row_key"), size_of().alias("size"))
    slim = cut(docs.select(text_key().alias("text_key"), row_key().alias("row_key"), size_of().alias("size")), "shard-keys")
    stats = slim.agg(F.count("*").alias("n"), F.sum("size").alias("b")).first()
    heavy = heavy_copies(slim, tolerance * (stats.b or 0) / shards)
    cuts = splitters(slim, shards, tolerance, heavy)
    if heavy:
        listed = F.broadcast(spark.createDataFrame([(c.text, c.row, i) for i, c in enumerate(heavy)], "text_key long, row_key long, no int"))
        copies = keyed.join(listed, ["text_key", "row_key"])
        keyed, slim = (x.join(listed, ["text_key", "row_key"], "left_anti") for x in (keyed, slim))
    # chunks small enough that a task sorts a bounded number of rows, whatever the shard's size
    chunks = max(1, stats.n // 20_000, (stats.b or 0) >> 26)
    place = [assign(F.col("text_key"), F.col("row_key"), cuts).alias("shard"), F.pmod(F.xxhash64("row_key", F.lit(2)), F.lit(chunks)).cast("int").alias("chunk")]
    counts = slim.select(*place).groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(F.col("shard").alias("s"), F.col("chunk").alias("c"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard", "chunk").orderBy("text_key", "row_key", "size")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (stats.b or 0) >> 27)
    placed = keyed.select("*", *place).repartition(parts, "shard", "chunk").withColumn("nth", F.row_number().over(within))
    found = placed.join(bases, (F.col("shard") == F.col("s")) & (F.col("chunk") == F.col("c")))
    done = found.select("row", "size", F.col("shard").cast("int").alias("shard"), (F.col("base") + F.col("nth") - 1).cast("long").alias("slot"))
    if not heavy:
        return done
    upto = {r.shard: r.n for r in counts.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # a row for each shard
    return done.unionByName(_copies(copies, heavy, cuts, upto))


def _copies(copies: DataFrame, heavy: list[Copies], cuts: list[Splitter], upto: dict[int, int]) -> DataFrame:
    """row, size, shard and slot of heavy copies (row, size, no). upto: the first free slot of each shard."""
    spark, path, table = copies.sparkSession, scratch(copies.sparkSession, "shard-copies"), []
    for no, c in enumerate(heavy):
        for shard_no, first, end in spans(c, cuts):
            table.append((no, shard_no, first, end, upto.get(shard_no, 0)))
            upto[shard_no] = upto.get(shard_no, 0) + end - first
    # a file holds copies of one kind, so a copy's number is its place in the file after those of the files before
    copies.select("row", "size", "no").write.partitionBy("no").parquet(path)
    read = spark.read.schema(copies.select("row", "size", "no").schema).parquet(path).select("row", "size", "no", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    before = Window.partitionBy("no").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = read.groupBy("no", "file").agg(F.count("*").alias("n")).select("no", "file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = read.join(files, ["no", "file"]).withColumn("number", F.col("base") + F.col("at"))
    ranges = spark.createDataFrame(table, "no int, shard int, first long, end long, start long")  # a row for each group and splitter within it
    placed = numbered.join(F.broadcast(ranges), "no").where("number >= first and number < end")
    return placed.select("row", "size", "shard", (F.col("start") + F.col("number") - F.col("first")).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 8) -> None:
    """One folder for each shard, shard_no=0 and on, with docs' columns and slot_no, a row's place in the shard. Names that docs
    has itself get a _ more. Null texts, repeated rows and no rows: as shard(); of no rows there is no folder."""
    names = ["shard_no", "slot_no"]
    for i, name in enumerate(names):
        while name in docs.columns:
            name += "_"
        names[i] = name
    shard(docs, shards).select(*[F.col("row")[c].alias(c) for c in docs.columns], F.col("shard").alias(names[0]), F.col("slot").alias(names[1])).write.partitionBy(names[0]).parquet(path)


def query(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    made = shard(docs.select("doc_id", "text"))
    crc = F.crc32(F.coalesce(F.col("row.text").cast("string"), F.lit("")).cast("binary"))
    return made.select(
        F.col("row.doc_id").alias("doc_id"), "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
