"""Fuzzy line dedup: SimHash of normalised lines, pigeonhole blocks, edit similarity, one occurrence a group.

DataFrame functions only. A line's fingerprint has GROUPS blocks. Each word falls to one block, and a block is the SimHash
of its words: a bit is set if more than half of them have it. A changed word so reaches two blocks at most (the old one's
and the new one's) and often no bit of them. Lines are linked if their fingerprints agree in AGREE blocks at least, that
hold AGREE words together, and their edit similarity (counted in words) is SIMILARITY at least. A sketch of their words,
which an edit changes in two bits at most, tells most other pairs of a block before they are made. Every choice of AGREE
blocks is a table, so no such pair is missed. Against edit similarity alone one changed word is always found; what more
of them cost is in the README.
Line texts are never shuffled for the search; one more pass over the documents fetches the lines of candidate pairs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import components, cut, join_counted

SIMILARITY = 0.8
#: Blocks of a fingerprint, and how many of them linked lines have in common.
GROUPS, AGREE = 5, 2
#: Bytes from which on a word counts in fingerprints.
LONG = 4
#: Words of a block that 16-bit counters sum; 32-bit counters sum more of them, to the same bits.
NARROW = 0x3FFF
#: Lines of a block up to which pairs are made at once; a larger block links its lines to one of them before.
SMALL_BLOCK = 16
#: Lines of a chunk of a block; a task's group holds two chunks.
CHUNK = 2000
#: Candidate lines whose places are broadcast to the pass that fetches them (some 30 bytes each); more are joined by shuffle.
BROADCAST_KEYS = 1_000_000
#: A word's stand-in in the edit distance of two lines: its number among their distinct words, from this code point on.
FIRST_SIGN, SIGNS = 0x10000, 0x100000
#: Edits over the number of different words that a pair is tried with before all that are allowed.
FEW = 2


def normal(line: Column) -> Column:
    """A line's normalised words, parted by single blanks: lower case, digits as 0; the characters of a line that has two
    bytes a character and more, as scripts without blanks do. Patterns that replace run only on lines that have other
    digits or more than single blanks between words. These are told from the line as it is, so that it is put in lower
    case once."""
    low = F.lower(line)
    odd = F.rlike(line, F.lit("[123456789\t\r\f\x0B]")) | F.contains(line, F.lit("  "))
    clean = F.btrim(F.regexp_replace(F.regexp_replace(low, "[1-9]", "0"), r"\s+", " "))
    plain = F.when(odd | F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" ")), clean).otherwise(low)
    dense = F.octet_length(line) >= 2 * F.char_length(line)
    return F.when(dense, F.array_join(F.split(F.regexp_replace(plain, " ", ""), ""), " ")).otherwise(plain)


def words(line: Column) -> Column:
    """A line's normalised words."""
    return F.split(normal(line), " ")


def worded(line: Column) -> Column:
    """Whether a line has a word, told from its ends alone."""
    return F.btrim(line, F.lit(" \t\n\x0B\f\r")) != ""


def identity() -> Column:
    """With doc_id, what tells a row from others: ids may be null or repeat. Rows that agree in both are copies."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, t, line_no, line (normal()), and the key (h, c) of the normalised line, for every line that has a word.
    (doc_id, t) is the row's identity."""
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), identity().alias("t"), F.posexplode(F.split(F.col("text").cast("string"), "\n")).alias("line_no", "line"))
    made = split.where(worded(F.col("line"))).select("doc_id", "t", "line_no", normal(F.col("line")).alias("line"))
    return made.select("*", F.xxhash64("line").alias("h"), F.hash("line").alias("c"))


def featured(found: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n and all: hashes of a line's distinct words of LONG bytes and more; of its pairs of neighbours if it has less
    than two of these, which long tells. Words are split off where they are hashed, so that no row carries them on."""
    every = F.split("line", " ")
    hashes = F.transform(every, lambda w: F.when(F.octet_length(w) >= LONG, F.xxhash64(w)))
    made = found.select(*keys, "line", hashes.alias("hashes"))
    made = made.select(*keys, "line", F.size("hashes").alias("n"), F.array_except("hashes", F.array(F.lit(None).cast("long"))).alias("told"))
    pairs = F.zip_with(F.slice(every, 1, F.col("n") - 1), F.slice(every, 2, F.col("n") - 1), lambda v, w: F.xxhash64(v, w))
    return made.select(*keys, "n", (F.size("told") >= 2).alias("long"), F.when(F.size("told") >= 2, F.col("told")).otherwise(F.array_distinct(pairs)).alias("all"))


def block(hashes: Column, bits: int) -> Column:
    """SimHash of hashes in 16 bits of a long: those at 0 to 3 of each of its four parts. Counters of so many bits lie side
    by side in a long; one is over half of all if adding the rest to a power of two carries."""
    lanes = 64 // bits
    unit = sum(1 << (bits * i) for i in range(lanes))
    rest = (F.lit((1 << (bits - 2)) - 1) - F.shiftright(F.size(hashes), 1)).cast("long") * F.lit(unit)
    made = []
    for at in [16 * part + i for part in range(4 // lanes) for i in range(4)]:
        total = F.aggregate(hashes, F.lit(0).cast("long"), lambda s, w: s + F.shiftrightunsigned(w, at).bitwiseAND(F.lit(unit)))  # noqa: B023
        over = F.shiftrightunsigned(total + rest, bits - 2).bitwiseAND(F.lit(unit))
        made.append(F.shiftleft(over, at))
    return reduce(lambda a, b: a.bitwiseOR(b), made)


def fingerprinted(found: DataFrame) -> DataFrame:
    """found (lines(), or words in place of line) with n, the number of words, in place of the line, the fingerprint in x (its
    first four blocks) and y (the fifth), load, two bits for each block that tell whether it has none, one or more words, and
    z: a bit of 64 for each different word of LONG bytes and more, null for lines that are told by pairs."""
    if "words" in found.columns:
        found = found.withColumn("line", F.array_join("words", " ")).drop("words")
    keys = [c for c in found.columns if c != "line"]
    one = F.lit(1).cast("long")
    sketch = F.when(F.col("long"), F.aggregate("all", F.lit(0).cast("long"), lambda z, w: z.bitwiseOR(F.call_function("shiftleft", one, w.bitwiseAND(F.lit(63)).cast("int")))))
    hashed = featured(found, keys)
    # a hash's group over the bits that blocks and sketches look at; sorted with a mark before each group, groups are slices
    grouped = F.transform("all", lambda w: F.call_function("shiftleft", F.pmod(F.shiftrightunsigned(w, 52), F.lit(GROUPS)), F.lit(60)).bitwiseOR(w.bitwiseAND(F.lit((1 << 52) - 1))))
    marks = [F.lit((g << 60) - 1).cast("long") for g in range(1, GROUPS)]
    ordered = hashed.select(*keys, "n", sketch.alias("z"), F.sort_array(F.concat(grouped, F.array(*marks))).alias("all"))
    ends = [F.lit(0), *[F.array_position("all", m).cast("int") for m in marks], F.size("all") + 1]
    dealt = ordered.select(*keys, "n", "z", *[F.slice("all", ends[g] + 1, ends[g + 1] - ends[g] - 1).alias(f"g{g}") for g in range(GROUPS)])
    blocks = [F.when(F.size(f"g{g}") <= NARROW, block(F.col(f"g{g}"), 16)).otherwise(block(F.col(f"g{g}"), 32)) for g in range(GROUPS)]
    load = reduce(lambda a, b: a + b, [F.least(F.size(f"g{g}"), F.lit(AGREE)) * F.lit(4**g) for g in range(GROUPS)])
    made = dealt.select(*keys, "n", "z", *[b.alias(f"b{g}") for g, b in enumerate(blocks)], load.alias("load"))
    x = reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(f"b{g}", 4 * g) for g in range(4)])
    return made.select(*keys, "n", x.alias("x"), F.col("b4").alias("y"), "load", "z")


def block_keys() -> Column:
    """A key for each choice of AGREE blocks, from x, y and load; null unless the blocks have AGREE words together."""
    bits = [F.shiftrightunsigned("x", 4 * g).bitwiseAND(F.lit(0x000F000F000F000F)) for g in range(4)] + [F.col("y")]
    held = [F.shiftright("load", 2 * g).bitwiseAND(F.lit(3)) for g in range(GROUPS)]
    chosen = list(enumerate(combinations(range(GROUPS), AGREE)))
    keys = [F.when(reduce(lambda a, b: a + b, [held[g] for g in gs]) >= AGREE, F.xxhash64(F.lit(t), *[bits[g] for g in gs])) for t, gs in chosen]
    return F.array(*keys)


def allowed(x: str, y: str) -> Column:
    """Edits that lines of x and y words may be apart."""
    return F.floor((1 - SIMILARITY) * F.greatest(x, y) + 1e-9).cast("int")


def may_be_similar(a: str, b: str) -> Column:
    """Whether word counts and sketches of two lines leave room for SIMILARITY: an edit takes a word and brings one at most,
    and each of them is a bit at most."""
    edits = allowed(f"{a}n", f"{b}n")
    apart = F.bit_count(F.col(f"{a}z").bitwiseXOR(F.col(f"{b}z")))
    return (F.abs(F.col(f"{a}n") - F.col(f"{b}n")) <= edits) & (apart.isNull() | (apart <= 2 * edits))


def filed(distinct: DataFrame) -> DataFrame:
    """key, h, c, n, z, m and lead for every distinct line and each block key that other lines have as well; m is the number of
    lines under the key, lead the smallest (h). Lines of less than five words have no room for an edit."""
    keyed = distinct.where(allowed("n", "n") > 0).select("h", "c", "n", "z", F.explode(block_keys()).alias("key")).where("key is not null")
    whole = Window.partitionBy("key")
    return keyed.withColumns({"m": F.count("*").over(whole), "lead": F.min("h").over(whole)}).where("m > 1")


def chunked(keyed: DataFrame) -> DataFrame:
    """keyed with the chunk pairs (p, q) of its block that a row belongs to; m is the block's number of rows."""
    chunks = F.ceil(F.col("m") / CHUNK).cast("int")
    own = keyed.withColumn("chunks", chunks).withColumn("i", F.pmod(F.col("h"), F.col("chunks")).cast("int"))
    each = own.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return each.withColumn("p", F.least("i", "j")).withColumn("q", F.greatest("i", "j")).drop("chunks", "i", "j")


def named(rows: DataFrame, x: str, *more: str | Column) -> DataFrame:
    return rows.select(*more, *[F.col(c).alias(f"{x}{c}") for c in ("h", "c", "n", "z")])


def links(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """Pairs of keys (ah, ac, bh, bc) of lines that share a block key and whose edit similarity, counted in words, is
    SIMILARITY at least; enough of them to connect whatever is linked. distinct: (h, c, first, times, n, x, y, load, z) of
    distinct lines.

    Large blocks first link their members to one of them. Pairs are then made only between lines that this didn't
    connect, so a block of N near copies has N links and no pair.
    """
    blocks = cut(filed(distinct), "line-blocks")
    large = blocks.where(F.col("m") > SMALL_BLOCK)
    leads = large.where("h = lead").groupBy("key").agg(F.min(F.struct("h", "c", "n", "z")).alias("lead")).select("key", *[F.col(f"lead.{x}").alias(f"a{x}") for x in ("h", "c", "n", "z")])
    stars = named(large, "b", "key").join(leads, "key").where(((F.col("ah") != F.col("bh")) | (F.col("ac") != F.col("bc"))) & may_be_similar("a", "b"))
    near = cut(verified(docs, distinct, stars.select("ah", "ac", "bh", "bc").distinct()), "line-links")

    key = lambda x: F.struct(F.col(f"{x}h").alias("h"), F.col(f"{x}c").alias("c"))
    roots = cut(components(near.select(key("a").alias("a"), key("b").alias("b"))).select("node.h", "node.c", F.xxhash64("root.h", "root.c").alias("root")), "line-roots")
    roots = F.broadcast(roots) if roots.count() <= BROADCAST_KEYS else roots
    rooted = blocks.join(roots, ["h", "c"], "left").withColumn("root", F.coalesce("root", F.xxhash64("h", "c")))
    split = rooted.where(F.col("m") > SMALL_BLOCK).groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    ordered = (F.col("ah") < F.col("bh")) | ((F.col("ah") == F.col("bh")) & (F.col("ac") < F.col("bc")))
    made = []
    for left in (rooted.where(F.col("m") <= SMALL_BLOCK).withColumns({"p": F.lit(0), "q": F.lit(0)}), chunked(rooted.where(F.col("m") > SMALL_BLOCK).join(split, "key", "left_semi"))):
        a, b = named(left, "a", "key", "p", "q", F.col("root").alias("ar")), named(left, "b", "key", "p", "q", F.col("root").alias("br"))
        made.append(a.join(b, ["key", "p", "q"]).where(ordered & (F.col("ar") != F.col("br")) & may_be_similar("a", "b")).select("ah", "ac", "bh", "bc"))
    return near.unionByName(verified(docs, distinct, made[0].unionByName(made[1]).distinct()))


def verified(docs: DataFrame, distinct: DataFrame, made: DataFrame) -> DataFrame:
    """The pairs (ah, ac, bh, bc) whose edit similarity, counted in words, is SIMILARITY at least. Words are told apart
    by their 64-bit hashes."""
    pairs = cut(made, "line-pairs")
    keys = pairs.select(F.col("ah").alias("h"), F.col("ac").alias("c")).union(pairs.select("bh", "bc")).distinct()
    places = cut(distinct.join(keys, ["h", "c"], "left_semi").select("h", "c", F.col("first.t").alias("at"), F.col("first.line_no").alias("line_no")), "line-places")
    # documents without a wanted line aren't split, and of the others only these lines are looked at
    wanted = places.groupBy("at").agg(F.collect_list(F.struct("line_no", "h", "c")).alias("spots"))
    wanted = F.broadcast(wanted) if places.count() <= BROADCAST_KEYS else wanted
    rows = docs.select(identity().alias("at"), F.col("text").cast("string").alias("text")).join(wanted, "at")
    spots = rows.select(F.split("text", "\n").alias("split"), "spots").select("split", F.explode("spots").alias("spot"))
    found = spots.select("spot.h", "spot.c", F.get("split", F.col("spot.line_no")).alias("line")).where("line is not null").select("h", "c", words(F.col("line")).alias("words"))
    line = F.array_join("words", " ")
    # rows that share a hash may differ, so the line is looked at again; after cut(), lest the join is made by these hashes
    again = found.select("h", "c", F.xxhash64(line).alias("is_h"), F.hash(line).alias("is_c"), F.transform("words", lambda w: F.xxhash64(w)).alias("s"))
    # words by numbers from their hashes, once a line and not once a pair
    signed = again.withColumn("g", signs("s", hashed))
    texts = cut(signed, "line-texts").where("h = is_h and c = is_c").groupBy("h", "c").agg(F.first("s").alias("s"), F.first("g").alias("g"))
    a, b = (texts.select(F.col("h").alias(f"{x}h"), F.col("c").alias(f"{x}c"), F.col("s").alias(f"{x}s"), F.col("g").alias(f"{x}g")) for x in "ab")
    both = pairs.join(a, ["ah", "ac"]).join(b, ["bh", "bc"])
    edits = F.floor((1 - SIMILARITY) * F.greatest(F.size("as"), F.size("bs")) + 1e-9).cast("int")
    apart = F.greatest(F.size(F.array_except("as", "bs")), F.size(F.array_except("bs", "as")))
    close = both.select("*", edits.alias("edits"), apart.alias("apart")).where("apart <= edits")
    # the cost of a distance goes with its limit, and most pairs are hardly further apart than their different words say
    within = lambda x, y, most: F.call_function("levenshtein", x, y, most) >= 0
    ag, bg, first = F.col("ag"), F.col("bg"), F.least(F.col("edits"), F.col("apart") + FEW)
    near = close.where(within(ag, bg, first) | within(ag, bg, F.col("edits"))).withColumn("known", F.array_union("as", "bs"))
    # numbers from hashes tell the pair's words apart nearly always; where they don't, words get their place among known
    placed = lambda w: F.pmod(F.array_position("known", w), F.lit(SIGNS))
    clear = F.size(F.array_distinct(F.transform("known", hashed))) == F.size("known")
    return near.where(clear | within(signs("as", placed), signs("bs", placed), F.col("edits"))).select("ah", "ac", "bh", "bc")


def hashed(w: Column) -> Column:
    """A word's number under SIGNS, from its hash."""
    return F.pmod(w, F.lit(SIGNS))


def signs(line: str, number: Callable[[Column], Column]) -> Column:
    """One character for each word, by its number under SIGNS, so that the edit distance of two such strings counts
    words. Equal numbers can only make lines look closer. SIGNS places suffice for pairs of lines with a million
    different words."""
    code = F.transform(line, lambda w: F.lpad(F.hex(number(w) + FIRST_SIGN), 8, "0"))
    return F.decode(F.unhex(F.array_join(code, "")), "UTF-32")


def dropped(docs: DataFrame) -> DataFrame:
    """doc_id, t and gone, the numbers (from 0) of lines of which another occurrence stays.

    Of each connected group of lines the first occurrence stays: smallest doc_id (null first), then t, then line
    number. Lines without a word are never dropped. Copies of a row count as one here.
    """
    own = cut(fingerprinted(lines(docs)), "lines")
    first = F.min(F.struct("doc_id", "t", "line_no")).alias("first")
    distinct = cut(own.groupBy("h", "c").agg(first, *[F.first(x).alias(x) for x in ("n", "x", "y", "load", "z")], F.count("*").alias("times")), "distinct-lines")
    total = own.count()
    key = lambda x: F.struct(F.col(f"{x}h").alias("h"), F.col(f"{x}c").alias("c"))
    roots = components(links(docs, distinct).select(key("a").alias("a"), key("b").alias("b"))).select("node.h", "node.c", "root")
    linked = distinct.join(roots, ["h", "c"])
    kept = linked.groupBy("root").agg(F.min("first").alias("kept"))
    grouped = linked.join(kept, "root").select("h", "c", "times", "kept")
    alone = distinct.where("times > 1").join(roots.select("h", "c"), ["h", "c"], "left_anti").select("h", "c", "times", F.col("first").alias("kept"))
    repeated = join_counted(own.select("doc_id", "t", "line_no", "h", "c"), cut(grouped.unionByName(alone), "line-groups"), ["h", "c"], "times", total)
    stays = F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("t") == F.col("kept.t")) & (F.col("line_no") == F.col("kept.line_no"))
    return repeated.where(~stays).groupBy("doc_id", "t").agg(F.collect_set("line_no").alias("gone"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs (all columns) with repeated lines cut out of text, plus n_lines and n_dropped as a struct named cut, which
    takes the place of a column of that name.

    A null text stays null and has no lines; an empty one has one line. Of rows with the same doc_id and text one is
    treated as such, the others lose every line that has a word. Texts are shuffled once, by identity.
    """
    docs = docs.drop("cut")
    gone = dropped(docs).select(F.coalesce("doc_id", F.lit(-1)).alias("__id"), F.col("t").alias("__t"), F.col("gone").alias("__gone"))
    others = [F.col(f"row.{c}") for c, kind in docs.dtypes if c not in ("doc_id", "text") and "map<" not in kind]
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("__id"), identity().alias("__t"))
    copy = F.row_number().over(Window.partitionBy("__id", "__t").orderBy(F.xxhash64(F.lit(0), *others)))
    joined = rows.join(gone, ["__id", "__t"], "left").withColumn("__copy", copy)
    split = F.split(F.col("row.text").cast("string"), "\n")
    every = F.filter(F.transform(split, lambda line, i: F.when(worded(line), i)), lambda i: i.isNotNull())
    drop = F.when(F.col("__copy") > 1, every).otherwise(F.coalesce("__gone", F.array().cast("array<int>")))
    made = joined.select("row", split.alias("split"), drop.alias("drop"))
    left = F.array_except(F.sequence(F.lit(0), F.size("split") - 1), "drop")
    text = F.when(F.size("drop") == 0, F.col("row.text").cast("string")).otherwise(F.array_join(F.transform(left, lambda i: F.get("split", i)), "\n"))
    none = F.lit(0).cast("long")
    counts = F.when(F.col("row.text").isNull(), F.struct(none.alias("n_lines"), none.alias("n_dropped"))).otherwise(F.struct(F.size("split").cast("long").alias("n_lines"), F.size("drop").cast("long").alias("n_dropped")))
    return made.select(*[text.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns], counts.alias("cut"))


def query(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, text_sha256 (of what is left of the text; null for a null text)."""
    made = dedup_lines(docs.select("doc_id", "text"))
    return made.select("doc_id", "cut.n_lines", "cut.n_dropped", F.sha2("text", 256).alias("text_sha256"))
