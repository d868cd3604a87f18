"""Rule packs as tables: which rules a change falls under, found through an index of what each rule can't do without.

A rule is a row: rule_id, applies_as, kinds, globs, requires (RULE). A glob of at most one * has a shape, the places of its
wildcards, and is filed under its shape and all its other characters; a path has one such key for each shape. Of a rule
that has other globs each is filed under the piece of its literal runs, as long as possible, that the fewest changes' paths
hold; a rule without globs under its rarest required attribute, else under its kinds. A change fetches the rules filed
under what it holds, and only those are compared with it.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import NO_STRINGS, glob_pattern, glob_runs
from ..shared import cut

RULE = "rule_id string, applies_as string, kinds array<string>, globs array<string>, requires map<string,string>"
APPLIES = ("retrieved", "checklist")
#: Rules (or filed keys) up to which a table of them is broadcast, some 300 bytes each.
BROADCAST_RULES = 50_000
#: Lengths of grams: a glob is filed under grams of the greatest length that its longest literal run has. And rules that a
#: block holds when every rule's reason is asked for.
GRAMS, BLOCK = (1, 2, 3, 4, 6, 8, 12, 16, 24), 100
#: Shapes of globs that rules are filed under, those of most globs; rules with a glob of another shape are filed by grams.
SHAPES = 100
#: What stands for a path's begin and end in grams.
BEGIN, END = "\x02", "\x03"


def load(rows: DataFrame) -> DataFrame:
    """Rules from a table with the columns of RULE, any of which but rule_id may be missing or null: defaults filled in.
    ValueError names a rule whose id is missing or repeats or whose applies_as is unknown."""
    kinds = dict(f.split(" ", 1) for f in RULE.split(", "))
    given = rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()])
    filled = given.select(
        "rule_id", F.coalesce(F.when(F.col("applies_as") != "", F.col("applies_as")), F.lit(APPLIES[0])).alias("applies_as"),
        *[F.coalesce(F.array_compact(c), F.array().cast(NO_STRINGS)).alias(c) for c in ("kinds", "globs")],
        F.coalesce(F.transform(F.map_entries("requires"), lambda e: _pair(e["key"], e["value"])), F.array().cast(NO_STRINGS)).alias("pairs"),
    )
    missing = (F.col("rule_id").isNull() | (F.col("rule_id") == "")).alias("missing")
    counted = filled.groupBy("rule_id").agg(F.count("*").alias("n"), F.min(F.when(~F.col("applies_as").isin(*APPLIES), F.col("applies_as"))).alias("odd"))
    for bad in counted.withColumn("missing", missing).where("missing or n > 1 or odd is not null").limit(1).collect():
        raise ValueError(f"{bad.rule_id}: applies_as {bad.odd!r}" if bad.odd is not None else f"rule id {bad.rule_id!r} is missing or repeats")
    return filled


def _pair(key: Column, value: Column) -> Column:
    return F.concat(key, F.lit("="), value)


def _held(changed: DataFrame, attributes: tuple[str, ...]) -> DataFrame:
    """changed with pairs: 'attribute=value' for each attribute that isn't null; and slashed, the path with slashes."""
    pairs = [_pair(F.lit(a), F.col(a).cast("string")) for a in attributes]
    every = F.array_compact(F.array(*pairs)) if pairs else F.array().cast(NO_STRINGS)
    return changed.withColumn("__pairs", every).withColumn("__path", F.translate(F.coalesce("path", F.lit("")), "\\", "/"))


def _grams(text: Column, size: Column) -> Column:
    """The different substrings of a size."""
    n = F.length(text) - size + 1
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(text, i, size)))).otherwise(F.array().cast(NO_STRINGS))


def _keys_of_rules(rules: DataFrame) -> DataFrame:
    """(rule_id, of, key): what a rule may be filed under. of: the glob that the key is of; else the place of the pair, or a
    name for all kinds. A rule needs one key of each glob, one pair, or all its kinds; '' is in every change."""
    run = F.explode(glob_runs(F.col("glob"), BEGIN, END))
    runs = rules.select("rule_id", F.explode("globs").alias("glob")).distinct().select("rule_id", "glob", run.alias("run"))
    longest = F.max(F.length("run"))
    size = F.greatest(*[F.when(longest >= n, F.lit(n)).otherwise(0) for n in GRAMS])
    sized = runs.groupBy("rule_id", "glob").agg(size.alias("size"), F.collect_list("run").alias("runs"))  # runs of one glob
    globs = sized.select("rule_id", F.col("glob").alias("of"), F.explode(F.when(F.col("size") == 0, F.array(F.lit(""))).otherwise(F.flatten(F.transform("runs", lambda r: _grams(r, F.col("size")))))).alias("key"))
    globs = globs.select("rule_id", F.concat(F.lit("glob "), "of").alias("of"), F.when(F.col("key") == "", F.lit("")).otherwise(F.concat(F.lit("g:"), "key")).alias("key")).distinct()
    bare = rules.where(F.size("globs") == 0)
    pairs = bare.where(F.size("pairs") > 0).select("rule_id", F.lit("pair").alias("of"), F.explode(F.transform("pairs", lambda p: F.concat(F.lit("a:"), p))).alias("key"))
    kinds = bare.where((F.size("pairs") == 0) & (F.size("kinds") > 0)).select("rule_id", F.explode(F.array_distinct("kinds")).alias("kind")).select("rule_id", F.concat(F.lit("kind "), "kind").alias("of"), F.concat(F.lit("k:"), "kind").alias("key"))
    free = bare.where((F.size("pairs") == 0) & (F.size("kinds") == 0)).select("rule_id", F.lit("any").alias("of"), F.lit("").alias("key"))
    return globs.unionByName(pairs).unionByName(kinds).unionByName(free)


def _keys_of_changes(profiles: DataFrame, sizes: list[int]) -> DataFrame:
    """(profile, key) of everything that a change holds and a rule may be filed under."""
    marked = F.concat(F.lit(BEGIN), F.col("__path"), F.lit(END))
    grams = [F.transform(_grams(marked, F.lit(n)), lambda g: F.concat(F.lit("g:"), g)) for n in sizes]
    own = [F.array(F.lit("")), F.transform("__pairs", lambda p: F.concat(F.lit("a:"), p)), F.array_compact(F.array(F.concat(F.lit("k:"), F.col("kind"))))]
    return profiles.select("profile", F.explode(F.concat(*own, *grams)).alias("key"))


def _masked(glob: Column) -> Column:
    """A glob with ? for each class and one * for several in a row."""
    plain = F.when(F.contains(glob, F.lit("[")), F.regexp_replace(glob, r"\[!?+\]?+[^\]]*\]", "?")).otherwise(glob)
    return F.when(F.contains(plain, F.lit("**")), F.regexp_replace(plain, r"\*+", "*")).otherwise(plain)


def _shape(mask: Column) -> Column:
    """A mask with x for every character that isn't a wildcard; null if it has several *."""
    shape = F.when(F.translate(mask, "*?", "") == mask, F.repeat(F.lit("x"), F.length(mask))).otherwise(F.regexp_replace(mask, "[^*?]", "x"))
    return F.when(F.substring_index(mask, "*", 2) == mask, shape)


def _letters(mask: Column) -> Column:
    return F.translate(mask, "*?", "")


def _shaped(globs: DataFrame) -> dict[str, tuple[int, str]]:
    """Shapes of most masks, at most SHAPES: their number, and what the letters of all globs of that shape begin with."""
    letters = _letters(F.col("mask"))
    found = globs.groupBy("shape").agg(F.count("*").alias("n"), F.min(letters).alias("low"), F.max(letters).alias("high")).where("shape is not null").orderBy(F.desc("n"), "shape").limit(SHAPES).collect()
    return {r["shape"]: (i, os.path.commonprefix([r.low, r.high])) for i, r in enumerate(found)}


def _keys_of_paths(shapes: dict[str, tuple[int, str]]) -> Column:
    """For every shape that a path (__path, of __length) can have, its number and the path's letters where globs of that
    shape have theirs."""
    keys = []
    for shape, (number, begin) in shapes.items():
        head, star, tail = shape.partition("*")
        runs = [F.substring("__path", m.start() + 1, len(m[0])) for m in re.finditer("x+", head)]
        runs += [F.substring(F.col("__path"), F.col("__length") - (len(tail) - m.start() - 1), F.lit(len(m[0]))) for m in re.finditer("x+", tail)]
        letters = F.concat(*runs) if runs else F.lit("")
        long = F.col("__length") >= len(head) + len(tail) if star else F.col("__length") == len(head)
        keys.append(F.when(long & F.startswith(letters, F.lit(begin)), F.concat(F.lit(f"{number}:"), letters)))
    return F.array_compact(F.array(*keys))


def eligible(changed: DataFrame, rules: DataFrame, attributes: tuple[str, ...] = (), applies_as: str = APPLIES[0]) -> DataFrame:
    """changed's columns and rule_id: for every change the rules of load() that admit it, by their kinds, globs (* crosses
    slashes) and required attributes, which are compared as text; null is no value.

    changed: path, kind, attributes, and more. Nothing is collected but shapes of globs, up to SHAPES, and the sizes of grams.
    """
    wanted = rules.where(F.col("applies_as") == applies_as).select("rule_id", "kinds", F.array_distinct("globs").alias("globs"), "pairs")
    masks = F.transform("globs", _masked)
    parsed = cut(wanted.withColumn("masks", masks).withColumn("shapes", F.transform("masks", _shape)), "rule-globs")
    shapes = _shaped(parsed.select(F.explode(F.arrays_zip("masks", "shapes")).alias("z")).select(F.col("z.masks").alias("mask"), F.col("z.shapes").alias("shape")))
    known = F.create_map(*[F.lit(x) for shape, (number, _) in shapes.items() for x in (shape, number)]) if shapes else F.create_map().cast("map<string,int>")
    whole = F.coalesce(F.forall("shapes", lambda s: s.isNotNull() & F.map_contains_key(known, F.coalesce(s, F.lit("-")))), F.lit(False)) & (F.size("globs") > 0)
    held = _held(changed, attributes)
    made = [_by_grams(held, changed.columns, parsed.where(~whole).select(*wanted.columns))]
    if shapes:
        made.append(_by_shapes(held, changed.columns, parsed.where(whole), shapes, known))
    return made[0].unionByName(made[-1]) if shapes else made[0]


def _by_shapes(held: DataFrame, columns: list[str], rules: DataFrame, shapes: dict[str, tuple[int, str]], known: Column) -> DataFrame:
    """What eligible() returns, of rules whose globs all have one of these shapes. A rule is found through the first of its globs
    that fits; only classes, and globs before that one, need patterns."""
    each = rules.select("rule_id", "kinds", "pairs", "globs", "shapes", F.posexplode("masks").alias("place", "mask"))
    glob = F.get("globs", F.col("place"))
    index = each.select(
        F.col("rule_id").alias("__rule"), F.col("kinds").alias("__kinds"), F.col("pairs").alias("__needed"),
        F.concat(known[F.get("shapes", F.col("place"))].cast("string"), F.lit(":"), _letters(F.col("mask"))).alias("__key"),
        F.when(F.contains(glob, F.lit("[")), glob_pattern(glob)).alias("__pattern"),
        F.when(F.col("place") > 0, F.transform(F.slice("globs", F.lit(1), F.col("place")), glob_pattern)).alias("__before"),
    )
    keyed = held.withColumn("__length", F.length("__path")).withColumn("__key", F.explode(_keys_of_paths(shapes))).drop("__length")
    fits = (F.size("__kinds") == 0) | F.array_contains("__kinds", F.coalesce("kind", F.lit("")))
    fits &= (F.size("__needed") == 0) | (F.size(F.array_except("__needed", "__pairs")) == 0)
    fits &= F.col("__pattern").isNull() | F.regexp_like("__path", F.col("__pattern"))
    fits &= F.col("__before").isNull() | ~F.exists("__before", lambda p: F.regexp_like("__path", p))
    return keyed.join(_small(index), "__key").where(fits).select(*columns, F.col("__rule").alias("rule_id"))


def _by_grams(held: DataFrame, columns: list[str], wanted: DataFrame) -> DataFrame:
    """What eligible() returns, of any rules. Changes that agree in kind, attributes and, where rules have globs, path are looked up
    once. A rule whose key no change holds is dropped before anything is joined."""
    filed = cut(_keys_of_rules(wanted), "rule-keys")
    sizes = sorted(r[0] for r in filed.where("startswith(key, 'g:')").select((F.length("key") - 2).alias("n")).distinct().collect())
    paths = filed.where("startswith(of, 'glob ')").limit(1).count() > 0
    held = held if paths else held.withColumn("__path", F.lit(""))
    profiles = held.select("__path", "kind", "__pairs").distinct().withColumn("profile", F.xxhash64("__path", "kind", F.array_join("__pairs", "\n"))).withColumn("kind", F.coalesce("kind", F.lit("")))
    # of what changes hold, what some rule is filed under
    keys = cut(_keys_of_changes(profiles, sizes).join(_small(filed.select("key").distinct()), "key", "left_semi"), "change-keys")
    counted = cut(keys.groupBy("key").agg(F.count("*").alias("n")), "key-counts")
    # of a glob's grams, or of a rule's pairs, the one that the fewest changes hold; a key of none can't be met
    rarest = filed.join(_small(counted), "key", "left").groupBy("rule_id", "of").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")).alias("least"))
    index = rarest.where("least.n > 0").select("rule_id", F.col("least.key").alias("key"), F.when(F.startswith("of", F.lit("glob ")), F.substring("of", 6, 1 << 30)).alias("glob")).join(wanted, "rule_id")
    index = index.select("rule_id", "key", "kinds", "pairs", F.when(F.col("glob").isNotNull(), glob_pattern(F.col("glob"))).alias("pattern")).withColumnRenamed("pairs", "needed")
    met = keys.join(_small(cut(index, "rule-index")), "key").join(profiles.withColumnRenamed("kind", "own_kind"), "profile")
    fits = ((F.size("kinds") == 0) | F.array_contains("kinds", F.col("own_kind"))) & (F.size(F.array_except("needed", "__pairs")) == 0) & (F.col("pattern").isNull() | F.regexp_like("__path", F.col("pattern")))
    found = cut(met.where(fits).select(F.col("rule_id").alias("__rule"), F.col("__path").alias("__own_path"), F.col("own_kind").alias("__own_kind"), F.col("__pairs").alias("__own_pairs")).distinct(), "rules-found")
    same = (F.col("__path") == F.col("__own_path")) & (F.coalesce("kind", F.lit("")) == F.col("__own_kind")) & (F.col("__pairs") == F.col("__own_pairs"))
    # changes that no rule admits are gone before the others meet theirs
    own = found.select("__own_path", "__own_kind", "__own_pairs").distinct()
    return held.join(_small(own), same, "left_semi").join(_small(found), same).select(*columns, F.col("__rule").alias("rule_id"))


def reasons(changed: DataFrame, rules: DataFrame, attributes: tuple[str, ...] = (), applies_as: str = APPLIES[0]) -> DataFrame:
    """Every change with every rule: changed's columns, rule_id and reason, which is null if the rule admits the change, else
    says what failed first, kind, then globs, then required attributes in their order.

    That is a row for each pair by nature; eligible() is for what doesn't need it. Rules come in blocks of BLOCK."""
    wanted = rules.where(F.col("applies_as") == applies_as)
    rule = F.struct("rule_id", "kinds", "pairs", F.transform("globs", glob_pattern).alias("patterns")).alias("rule")
    numbered = wanted.select(F.pmod(F.xxhash64("rule_id"), F.lit(max(1, -(-wanted.count() // BLOCK)))).alias("block"), rule)
    blocks = numbered.groupBy("block").agg(F.collect_list("rule").alias("rules"))
    n = numbered.agg(F.max("block")).first()[0]
    dealt = _held(changed, attributes).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(-1 if n is None else n))) if n is not None else F.lit(None).cast("long"))
    each = dealt.join(_small(blocks, BROADCAST_RULES // BLOCK), "block").withColumn("rule", F.explode("rules"))
    lacking = F.get(F.array_except("rule.pairs", "__pairs"), F.lit(0))
    reason = (
        F.when((F.size("rule.kinds") > 0) & ~F.coalesce(F.array_contains("rule.kinds", F.col("kind")), F.lit(False)), F.concat(F.lit("kind "), F.coalesce("kind", F.lit("")), F.lit(" is not covered")))
        .when((F.size("rule.patterns") > 0) & ~F.exists("rule.patterns", lambda p: F.regexp_like("__path", p)), F.lit("path matches no glob"))
        .when(lacking.isNotNull(), F.concat(F.lit("requires "), lacking))
    )
    return each.select(*changed.columns, F.col("rule.rule_id").alias("rule_id"), reason.alias("reason"))


def _small(df: DataFrame, most: int = BROADCAST_RULES) -> DataFrame:
    return F.broadcast(df) if df.count() <= most else df
