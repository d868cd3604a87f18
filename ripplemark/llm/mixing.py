"""Mixing sources to target weights by a low-discrepancy schedule. DataFrame functions only.

Every source is laid out as a line of words, its documents shuffled by a hash, and cut into blocks of equal words. A
schedule of slots, as many as the targets need blocks, is made of van der Corput points: a slot's point falls into
one source's share of the unit interval, and the slot's rank within that source names the block it takes; a source
that is wanted more than once starts again. So any stretch of the schedule holds the sources in nearly their shares.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, running_total

WORD = r"[^\x20\x09-\x0D]+"
#: A source is taken this often at most.
MOST = 3
#: Cells of the unit interval by which slots find their source.
CELLS = 4096


@dataclass(frozen=True)
class Mix:
    """plan: a row for each document: the columns below; schedule: slot, source_no, block; sources: a row for each."""

    plan: DataFrame
    schedule: DataFrame
    sources: DataFrame


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """Targets of sources (source, source_size; more columns are carried): weights 1, 2, 3, repeating in code-point order, null last.

    The sources share all words by weight; none gets over MOST times its own, and what is over goes to the others by
    weight. That is a common level: a source gets the lesser of its cap and level x weight. Sources ordered by
    cap / weight fill up first, so the level follows from running totals over the sources.
    """
    one = Window.orderBy(F.col("source").isNull(), "source")
    weighed = sizes.withColumn("source_no", F.row_number().over(one)).withColumn("weight", ((F.col("source_no") - 1) % 3 + 1).cast("double"))
    weighed = weighed.withColumn("cap", MOST * F.col("source_size").cast("double"))
    before = Window.orderBy(F.col("cap") / F.col("weight"), "source_no").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    free = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = weighed.withColumn("level", left / free).withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    # the first source that doesn't fill up has the level that holds for all after it
    final = level.withColumn("final", F.min(F.struct(F.col("full"), F.col("cap") / F.col("weight"), "source_no", "level")).over(everything))
    return final.select(
        "source", "source_no", "source_size", *[c for c in sizes.columns if c not in ("source", "source_size")], F.when(F.col("full") | F.col("final.full"), F.col("cap")).otherwise(F.col("final.level") * F.col("weight")).alias("target")
    )


def van_der_corput(i: Column) -> Column:
    """Bits of i (under 2^53), mirrored at the binary point: exact in a double."""
    x = i
    for step, mask in ((1, 0x5555555555555555), (2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF)):
        x = F.shiftleft(x.bitwiseAND(F.lit(mask)), step).bitwiseOR(F.shiftrightunsigned(x, step).bitwiseAND(F.lit(mask)))
    x = F.shiftleft(x, 32).bitwiseOR(F.shiftrightunsigned(x, 32))
    return F.shiftrightunsigned(x, 11).cast("double") / float(1 << 53)


def mix(docs: DataFrame, block_words: int | None = None, seed: int = 0) -> Mix:
    """Plan which words of which documents a mix takes.

    docs: doc_id, text, source; more columns are ignored. Rows equal in id, source and size are one stretch of words
    and share what it gets evenly (rounded down), so repeated rows agree. A null or wordless text has size 0 and gets
    nothing; a null source is a source. An empty table gives empty results. block_words: by default so many that
    there are about a million blocks, but 256 at most, so a large corpus has a slot for every 256 words.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words().alias("size"))
    rows = cut(slim.groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies")), "mix-rows")
    sources = cut(targets(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count("*").alias("source_rows"))), "mix-sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    words = block_words or max(1, min(256, total >> 20))

    shuffle = F.md5(F.concat_ws("/", F.lit(str(seed)), F.col("doc_id").cast("string")).cast("binary"))
    laid = rows.join(F.broadcast(sources) if sources.count() <= 100_000 else sources, rows["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    # as many chunks of a source as each has rows, so that neither sorting one nor adding up their sums is a large task
    place = F.conv(F.substring("mixed", 1, 8), 16, 10).cast("long") * F.ceil(F.sqrt("source_rows")).cast("long")
    laid = laid.withColumn("length", F.col("size") * F.col("copies")).withColumn("mixed", shuffle).withColumn("chunk", F.shiftright(place, 32)).drop("source_rows")
    laid = cut(running_total(laid, ["source_no"], "chunk", [F.col("mixed"), F.col("doc_id"), F.col("size")], "length", "at"), "mix-laid")

    blocks = F.ceil(F.col("source_size") / F.lit(words)).cast("long")
    share = sources.withColumn("blocks", blocks).withColumn("slots", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size") * F.col("blocks")).otherwise(0.0))
    line = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, 0)
    share = share.withColumn("upto", F.sum("slots").over(line)).withColumn("wanted", F.sum("slots").over(Window.partitionBy()))
    share = share.where("slots > 0").select(
        "source_no", "blocks", ((F.col("upto") - F.col("slots")) / F.col("wanted")).alias("low"), (F.col("upto") / F.col("wanted")).alias("high"), "wanted",
        F.lead("source_no").over(Window.orderBy("source_no")).isNull().alias("last"),
    )
    share = cut(share, "mix-shares")
    wanted = int(round(share.agg(F.max("wanted")).first()[0] or 0))
    cells = share.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * CELLS), F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1)))))
    points = spark.range(wanted).select(F.col("id").alias("slot"), van_der_corput(F.col("id")).alias("u")).withColumn("cell", F.floor(F.col("u") * CELLS))
    placed = points.join(cells, "cell").where((F.col("u") >= F.col("low")) & ((F.col("u") < F.col("high")) | F.col("last")))
    placed = placed.select("slot", "source_no", "blocks", F.shiftrightunsigned("slot", 16).alias("chunk"), F.lit(1).cast("long").alias("one"))
    ranked = running_total(placed, ["source_no"], "chunk", [F.col("slot")], "one", "rank").where(F.col("rank") < MOST * F.col("blocks"))
    schedule = cut(ranked.select("slot", "source_no", (F.col("rank") % F.col("blocks")).alias("block")), "mix-schedule")

    taken_blocks = schedule.groupBy("source_no", "block").agg(F.count("*").alias("times"))
    first, last = F.col("at"), F.col("at") + F.col("length")
    piece = laid.where("length > 0").select("source_no", "at", "length", F.explode(F.sequence(F.floor(first / words), F.floor((last - 1) / words))).alias("block"))
    overlap = F.least(first + F.col("length"), (F.col("block") + 1) * words) - F.greatest(first, F.col("block") * words)
    taken = piece.join(taken_blocks, ["source_no", "block"]).groupBy("source_no", "at").agg(F.sum(overlap * F.col("times")).alias("words"))
    taken = taken.withColumnRenamed("source_no", "no").withColumnRenamed("at", "begin")
    plan = laid.join(taken, (F.col("source_no") == F.col("no")) & (F.col("at") == F.col("begin")) & (F.col("length") > 0), "left")
    each = F.floor(F.coalesce("words", F.lit(0)) / F.col("copies")).cast("long")
    plan = plan.select("doc_id", "source", "source_no", "size", "copies", "source_size", "target", each.alias("taken"))
    return Mix(plan, schedule, sources)


def query(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    plan = mix(docs).plan
    rows = plan.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


def resample(docs: DataFrame, seed: int = 0) -> DataFrame:
    """docs as the mix takes them: each row as often as its words are taken, to the nearest whole number.

    A source's words are taken the same number of times but for its last, partial round, so only the document at
    that round's end is rounded. A document without a word isn't taken; rows that agree in doc_id (which may be null),
    source and size are taken alike. No docs give no rows; columns may have any names.
    """
    plan = mix(docs, seed=seed).plan
    times = plan.where("taken > 0").select(
        F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"), F.round(F.col("taken") / F.col("size")).cast("int").alias("__times")
    )
    # the row goes as one column, so that its columns may have any names
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("source").cast("string").alias("of"), n_words().alias("words"))
    same = F.col("id").eqNullSafe(F.col("__id")) & F.col("of").eqNullSafe(F.col("__source")) & (F.col("words") == F.col("__size"))
    found = rows.join(times, same).where("__times > 0")
    each = found.select("row", F.explode(F.sequence(F.lit(1), F.col("__times"))).alias("nth"))
    return each.select(*[F.col("row")[c].alias(c) for c in docs.columns])


ORACLE = r"""
WITH w AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
r AS (SELECT doc_id, source, size, count(*) AS copies FROM w GROUP BY ALL),
s AS (SELECT source, CAST(sum(size * copies) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) AS no FROM r GROUP BY source),
c AS (SELECT *, (no - 1) % 3 + 1.0::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
      FROM c WINDOW b AS (ORDER BY cap / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, no, source_size, CASE WHEN cap <= level * weight OR (SELECT bool_and(cap <= level * weight) FROM l) THEN cap
             ELSE (SELECT arg_min(level, cap / weight) FROM l WHERE cap > level * weight) * weight END AS target FROM l),
b AS (SELECT greatest(1, least(256, CAST(sum(source_size) AS BIGINT) >> 20)) AS words FROM s),
laid AS (SELECT r.*, no, source_size, target, size * copies AS length,
                coalesce(sum(size * copies) OVER (PARTITION BY no ORDER BY md5(concat_ws('/', '0', CAST(doc_id AS VARCHAR))), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
         FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source),
sh AS (SELECT no, ceil(source_size / words) AS blocks, target / source_size * ceil(source_size / words) AS slots FROM t, b WHERE source_size > 0),
iv AS (SELECT no, blocks, (sum(slots) OVER (ORDER BY no) - slots) / sum(slots) OVER () AS low, sum(slots) OVER (ORDER BY no) / sum(slots) OVER () AS high,
              no = max(no) OVER () AS last, CAST(round(sum(slots) OVER ()) AS BIGINT) AS wanted FROM sh),
pts AS (SELECT i, list_sum(list_transform(range(0, 40), lambda k: ((i >> k) & 1) * pow(2.0, -(k + 1)))) AS u FROM (SELECT unnest(range(0, (SELECT max(wanted) FROM iv))) AS i)),
rk AS (SELECT no, blocks, row_number() OVER (PARTITION BY no ORDER BY i) - 1 AS rank FROM pts JOIN iv ON u >= low AND (u < high OR last)),
cnt AS (SELECT no, CAST(rank % CAST(blocks AS BIGINT) AS BIGINT) AS block, count(*) AS times FROM rk WHERE rank < 3 * blocks GROUP BY ALL),
pc AS (SELECT no, pos, length, unnest(range(CAST(pos // words AS BIGINT), CAST((pos + length - 1) // words + 1 AS BIGINT))) AS block, words FROM laid, b WHERE length > 0),
tk AS (SELECT pc.no, pos, CAST(sum((least(pos + length, (pc.block + 1) * words) - greatest(pos, pc.block * words)) * times) AS BIGINT) AS words FROM pc JOIN cnt USING (no, block) GROUP BY ALL)
SELECT doc_id, size, source_size, target, taken FROM (
  SELECT doc_id, size, source_size, target, coalesce(tk.words, 0) // copies AS taken, unnest(range(copies)) AS nth
  FROM laid LEFT JOIN tk ON laid.no = tk.no AND laid.pos = tk.pos AND length > 0)
"""
