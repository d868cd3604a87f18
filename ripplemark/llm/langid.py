"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies cover every training row. The weights are fitted on a bounded sample of labelled rows by
follow-the-regularised-leader with elastic-net penalties: shards of the sample are passed over in parallel, their
accumulators are averaged after each pass (parameter mixing). A temperature, fitted on sample rows that training
hasn't seen, calibrates the scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import cut, slices

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """sample_rows bounds the fitting sample: about so many rows for each language, whatever the input's size."""

    orders: tuple[int, ...] = (1, 2, 3)
    buckets: int = 1 << 16
    sample_rows: int = 1500
    passes: int = 8
    shards: int = 6
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.02
    calibration_share: float = 0.2


@dataclass(frozen=True)
class Model:
    """weights: buckets x languages, IDF folded in; no languages: nothing could be learned."""

    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    settings: Settings


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def grams(text: str, orders: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the text's n-grams and their counts. Lower case; whatever is no letter counts as one space."""
    at = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    letter = _letters()[at]
    at = np.where(letter, at, np.uint64(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of a run of others stays as a space
    at = np.concatenate(([np.uint64(32)], at[keep], [np.uint64(32)]))
    hashes = []
    shift = np.uint64(64 - buckets.bit_length() + 1)
    for n in orders:
        if len(at) < n:
            continue
        h = np.full(len(at) - n + 1, n, dtype=np.uint64)
        for i in range(n):
            h = (h ^ at[i : len(at) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        hashes.append(((h * np.uint64(0xBF58476D1CE4E5B9)) >> shift).astype(np.int64))
    found = np.bincount(np.concatenate(hashes), minlength=buckets) if hashes else np.zeros(buckets, np.int64)
    which = np.flatnonzero(found)
    return which, found[which]


def tfidf(which: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf[which]
    return x / max(np.sqrt(x @ x), 1e-12)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def leader(z: np.ndarray, n: np.ndarray, s: Settings) -> np.ndarray:
    """Weights from the accumulators: the minimiser of the regularised sum of past losses."""
    return np.where(np.abs(z) <= s.l1, 0.0, (np.sign(z) * s.l1 - z) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))


def rows_of(table: pa.Table, column: str) -> list[np.ndarray]:
    """The lists of a column as arrays."""
    return [x.values.to_numpy() for x in table.column(column)]


def _training(docs: DataFrame) -> DataFrame:
    """Labelled rows that may be learned from."""
    return docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id"))


def held_out(doc_id: str) -> Column:
    """True for a third of the ids, by crc32 of the id as text; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def document_frequencies(rows: DataFrame, s: Settings) -> tuple[np.ndarray, int]:
    """For each bucket the number of training rows that have it, and the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows = np.zeros(s.buckets, np.int64), 0
        for batch in slices(batches, 0):
            for text in batch.column(0):
                df[grams(text.as_py(), s.orders, s.buckets)[0]] += 1
                rows += 1
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *some], pa.int32()), pa.array([rows, *df[some]], pa.int64())], names=["bucket", "n"])

    got = rows.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    buckets, n = got["bucket"].to_numpy(), got["n"].to_numpy()
    df = np.zeros(s.buckets, np.int64)
    df[buckets[buckets >= 0]] = n[buckets >= 0]
    return df, int(n[buckets < 0].sum())


def sample(rows: DataFrame, langs: dict[str, int], s: Settings) -> DataFrame:
    """About sample_rows rows of each language, chosen by a hash of id and text; fold in [0, 1) for the calibration."""
    rate = F.lit(0.0)
    for lang, n in langs.items():
        rate = F.when(F.col("lang") == lang, F.lit(min(1.0, s.sample_rows / n))).otherwise(rate)
    unit = lambda seed: F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    return rows.where(unit(1) < rate).select("text", "lang", unit(2).alias("fold"))


def fit(docs: DataFrame, s: Settings = Settings()) -> Model:
    """Learn from text and lang of rows of docs that aren't held out."""
    rows = _training(docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros(s.buckets), np.zeros((s.buckets, 0)), np.zeros(0), 1.0, s)
    df, total = document_frequencies(rows, s)
    idf = np.where(df > 0, np.log((1 + total) / (1 + df)) + 1, 0.0)
    index = {x: i for i, x in enumerate(langs)}

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0, 1 << 20):
            made = [grams(t.as_py(), s.orders, s.buckets) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([index[x.as_py()] for x in batch.column(1)], pa.int32()), batch.column(2), pa.array([m[0] for m in made], pa.list_(pa.int32())), pa.array([tfidf(*m, idf) for m in made], pa.list_(pa.float32()))],
                names=["y", "fold", "which", "x"],
            )

    order = F.xxhash64("which", "x")
    made = cut(sample(rows, counts, s).mapInArrow(features, "y int, fold double, which array<int>, x array<float>").withColumn("shard", F.pmod(order, F.lit(s.shards)).cast("int")), "langid-sample")
    learn, check = made.where(F.col("fold") >= s.calibration_share), made.where(F.col("fold") < s.calibration_share)
    spark, k = docs.sparkSession, len(langs)
    z, n = np.zeros((s.buckets + 1, k), np.float32), np.zeros((s.buckets + 1, k), np.float32)
    for _ in range(s.passes):
        state = spark.sparkContext.broadcast((z, n))

        def one_pass(key, table):  # noqa: ANN001, B023
            z, n = (a.copy() for a in state.value)
            which, xs, ys = rows_of(table, "which"), rows_of(table, "x"), table.column("y").to_numpy()
            for i in np.random.default_rng(0).permutation(len(ys)):
                at, x = np.append(which[i], s.buckets), np.append(xs[i], np.float32(1))
                w = leader(z[at], n[at], s)
                p = softmax(x @ w)
                p[ys[i]] -= 1
                g = x[:, None] * p[None, :]
                z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / s.alpha * w
                n[at] += g * g
            some = np.flatnonzero((n != 0).any(axis=1))
            return pa.table({"bucket": pa.array(some, pa.int32()), "z": pa.array(list(z[some]), pa.list_(pa.float32())), "n": pa.array(list(n[some]), pa.list_(pa.float32()))})

        each = learn.groupBy("shard").applyInArrow(one_pass, "bucket int, z array<float>, n array<float>")
        parts = each.select("bucket", *[F.col(c)[i].cast("double").alias(f"{c}{i}") for c in "zn" for i in range(k)])
        mixed = parts.groupBy("bucket").agg(F.count("*").alias("m"), *[F.sum(f"{c}{i}").alias(f"{c}{i}") for c in "zn" for i in range(k)]).toArrow()
        shards = learn.select("shard").distinct().count()
        at, m = mixed["bucket"].to_numpy(), mixed["m"].to_numpy()
        new_z, new_n = z.copy(), n.copy()
        for c, old, new in (("z", z, new_z), ("n", n, new_n)):
            for i in range(k):
                new[at, i] = (mixed[f"{c}{i}"].to_numpy() + (shards - m) * old[at, i]) / max(shards, 1)
        z, n = new_z, new_n
        state.unpersist()
    w = leader(z, n, s).astype(np.float32)
    weights, bias = w[:-1], w[-1]
    seen = check.select("y", "which", "x").toArrow()
    if seen.num_rows:
        logits = np.array([x @ weights[i] for i, x in zip(rows_of(seen, "which"), rows_of(seen, "x"))]).reshape(-1, k) + bias
        temperature = calibrate(logits, seen["y"].to_numpy())
    else:
        temperature = 1.0
    return Model(langs, idf, weights, bias, temperature, s)


def calibrate(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least cross-entropy, by golden-section search over its logarithm.

    Labels count as right with (rows + 1) / (rows + 2), as if one more row had been wrong: a sample without a mistake
    doesn't prove that there are none.
    """
    k, rows = logits.shape[1], np.arange(len(y))
    wrong = 1 / (len(y) + 2)

    def loss(log_t: float) -> float:
        z = logits / np.exp(log_t)
        z = z - z.max(axis=1, keepdims=True)
        p = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        own = p[rows, y]
        return -float(((1 - wrong) * own + wrong * (p.sum(axis=1) - own) / max(k - 1, 1)).mean())

    low, high, ratio = -5.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def predict(docs: DataFrame, model: Model, *carry: Column) -> DataFrame:
    """carry columns (as they are named) plus lang_pred and score for every row, and the text that was read.

    Only the text decides. A null text or one without a letter is `und`, score 0; so is every text if no labelled row
    was there to learn from. Equal scores go to the language that sorts first.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(F.struct(*carry).alias("row"), F.col("text").cast("string").alias("text"))
    schema = StructType([*kept.schema.fields, *StructType.fromDDL("lang_pred string, score double").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in slices(batches, 1):
            langs, scores = [], []
            for text in batch.column(1):
                text = text.as_py()
                if not m.langs or not has_letter(text):
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                which, counts = grams(text, m.settings.orders, m.settings.buckets)
                p = softmax((tfidf(which, counts, m.idf) @ m.weights[which] + m.bias) / m.temperature)
                langs.append(m.langs[int(p.argmax())])
                scores.append(float(p.max()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["row", "text", "lang_pred", "score"])

    return kept.mapInArrow(run, schema)


def query(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    told = predict(docs, fit(docs), F.col("doc_id"), held_out("doc_id").alias("held_out"))
    return told.select("row.doc_id", "row.held_out", "lang_pred", "score")


def keep_known(docs: DataFrame, min_score: float = 0.3) -> DataFrame:
    """docs without those whose language can't be told: no letter, or a calibrated score under min_score.

    If docs holds no labelled row nothing is learned, and only texts without a letter go.
    """
    model = fit(docs)
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    told = predict(docs, model, *[F.col(c) for c in docs.columns if c != "text"])
    kept = told.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score))
    return kept.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
