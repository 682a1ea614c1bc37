"""Toxicity by a factorization machine over hashed terms.

A document's terms are its distinct words and their beginnings of 4, 5 and 6 bytes, hashed to 40 bits; a beginning stands for all
words of a stem. The machine scores a document by a bias, a weight for each term and a vector for each term, the inner
products of two terms' vectors being the weights of the pair: it learns which terms count for more, or only, together.

Training takes labelled rows whose crc32(doc_id as text) mod 5 is not 0, at most TRAIN_ROWS of them (those of the least hashes of
their ids; this bound holds at any size of the corpus). Terms are counted by class in a grouped aggregation over these rows, and those
whose share of toxic rows departs from the whole's by LEAST_Z standard deviations are known to the machine, at most KEPT_TERMS of them
(the farthest); only their numbers come to the driver. Terms and pairs have a scale of their own, one, whatever the document's
length: neither drowns in the other or in long texts. All weights begin at zero and all vectors near it, so that pairs take what single
terms don't explain; an absolute penalty on weights keeps those at zero that pairs make needless. Steps are Adam's over all rows. The
fit is the same for the same rows.

Null and empty texts have no terms and get the bias' score. Without labelled rows of both classes, every score is the share of
toxic rows among them (0 if there are none). A null doc_id is not held out and not trained on; an id's repeated labels count as
toxic if one of them is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, written
from .wordhash import ALNUM_SPLIT, chunks, prefix_hashes, text_buffers, word_spans, words

U = np.uint64
TERM_BITS = 40
PREFIXES = (4, 5, 6)
#: Labelled rows to train on at most, and terms to know at most.
TRAIN_ROWS = 16_000
KEPT_TERMS = 8_192
#: Training rows a term must be in, and standard deviations that it must depart by.
LEAST_ROWS = 3
LEAST_Z = 4.0
FACTORS = 4
STEPS = 200
RATE = 0.1
PENALTY = 3e-4
SHRINKAGE = 1e-3
#: Bits of the bitmap that terms are looked up in first.
SCREEN_BITS = 20


def document_terms(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct terms of each document, flat, and where each document's begin (and the last end)."""
    whole, at = words(data, off, ALNUM_SPLIT)
    low, starts, length, _ = word_spans(data, off, ALNUM_SPLIT)
    doc = np.repeat(np.arange(len(off) - 1, dtype=U), np.diff(at))
    found = [doc << U(TERM_BITS) | whole >> U(64 - TERM_BITS)]
    for size in PREFIXES:
        some, h = prefix_hashes(low, starts, length, size)
        found.append(doc[some] << U(TERM_BITS) | h >> U(64 - TERM_BITS))
    term = np.unique(np.concatenate(found))
    return (term & U((1 << TERM_BITS) - 1)).astype(np.int64), np.searchsorted(term, np.arange(len(off), dtype=U) << U(TERM_BITS))


def crc_remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def held_out(doc_id: Column) -> Column:
    return F.coalesce(crc_remainder(doc_id) == 0, F.lit(False))


def training_labels(labels: DataFrame, label: str, rows: int) -> DataFrame:
    """At most rows labels (doc_id, y), none of them held out."""
    own = labels.where(crc_remainder(F.col("doc_id")) != 0).where(F.col(f"`{label}`").isNotNull())
    own = own.groupBy("doc_id").agg(F.max(F.col(f"`{label}`")).cast("int").alias("y"))
    return own.orderBy(F.xxhash64("doc_id", F.lit(4)), "doc_id").limit(rows)


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = text_buffers(batch.column(2))
        for lo, hi in chunks(data, off):
            term, at = document_terms(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).cast(pa.int64()), batch.column(1).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(term))], names=["doc_id", "y", "terms"])


class Machine:
    """bias; the known terms in order; their weights and vectors."""

    def __init__(self, bias: float, terms: np.ndarray, weight: np.ndarray, vector: np.ndarray):
        self.bias, self.terms, self.weight, self.vector = bias, terms, weight, vector
        self.screen = np.zeros(1 << SCREEN_BITS, dtype=bool)
        self.screen[terms & ((1 << SCREEN_BITS) - 1)] = True

    def places(self, term: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of flat terms of documents: the known ones' places among them, and where each document's begin (and the last end)."""
        some = np.flatnonzero(self.screen[term & ((1 << SCREEN_BITS) - 1)])
        place = np.searchsorted(self.terms, term[some])
        known = self.terms[np.minimum(place, len(self.terms) - 1)] == term[some] if len(self.terms) else np.zeros(0, bool)
        return place[known], np.searchsorted(some[known], at)

    def logits(self, term: np.ndarray, at: np.ndarray) -> np.ndarray:
        place, at = self.places(term, at)
        total, _, squares = _sums(self.vector[place], at)
        return self.bias + _by(self.weight[place], at) + 0.5 * ((total**2).sum(1) - squares)


def _by(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the rows x[at[i]:at[i + 1]]."""
    whole = np.concatenate((x, np.zeros((1, *x.shape[1:]))))
    out = np.add.reduceat(whole, np.minimum(at[:-1], len(x)), axis=0) if len(at) > 1 else np.zeros((0, *x.shape[1:]))
    out[at[1:] == at[:-1]] = 0
    return out


def _sums(v: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _by(v, at), v, _by((v * v).sum(1), at)


def constant(share: float) -> Machine:
    bias = float(np.log(share / (1 - share))) if 0 < share < 1 else (40.0 if share else -40.0)
    return Machine(bias, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, FACTORS)))


def fit(y: np.ndarray, place: np.ndarray, at: np.ndarray, terms: np.ndarray, seed: int = 4) -> Machine:
    """y: 0 or 1 of each row; place[at[i]:at[i+1]]: the distinct known terms of row i, as places in terms."""
    rows, good = len(y), int(y.sum())
    if not 0 < good < rows:
        return constant(good / rows if rows else 0.0)
    k = len(terms)
    doc = np.repeat(np.arange(rows), np.diff(at))
    by_term = np.argsort(place, kind="stable")
    term_at = np.searchsorted(place[by_term], np.arange(k + 1))
    rng = np.random.default_rng(seed)
    bias = float(np.log(good / (rows - good)))
    value = [np.array([bias]), np.zeros(k), rng.normal(0, 0.05, (k, FACTORS))]
    mean, square = ([np.zeros_like(x) for x in value] for _ in range(2))
    for step in range(1, STEPS + 1):
        (b,), w, v = value
        vx = v[place]
        total, _, squares = _sums(vx, at)
        z = b + _by(w[place], at) + 0.5 * ((total**2).sum(1) - squares)
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / rows
        gx = g[doc]
        slope = [
            np.array([g.sum()]),
            _by(gx[by_term], term_at) + PENALTY * np.sign(w),
            _by((gx[:, None] * (total[doc] - vx))[by_term], term_at) + SHRINKAGE * v,
        ]
        rate = RATE / (1 + 2 * step / STEPS)
        for x, s, m, q in zip(value, slope, mean, square, strict=True):
            m += 0.1 * (s - m)
            q += 0.01 * (s * s - q)
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.99**step)) + 1e-8)
    return Machine(float(value[0][0]), terms, value[1], value[2])


def known_terms(rows: DataFrame, n: int, good: int) -> np.ndarray:
    """Of training rows (y, terms): the terms that depart the most from the share of toxic rows, in order."""
    p = good / n
    counts = rows.select("y", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("every"), F.sum("y").alias("toxic")).where(F.col("every") >= LEAST_ROWS)
    z = F.abs(F.col("toxic") - F.col("every") * p) / F.sqrt(F.col("every") * (p * (1 - p)))
    kept = counts.select("term", z.alias("z")).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "term").limit(KEPT_TERMS)
    return np.sort(kept.select("term").toArrow()["term"].to_numpy())


def _place_rows(terms: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Machine(0.0, terms, np.zeros(len(terms)), np.zeros((len(terms), FACTORS)))
        for batch in batches:
            col = batch.column(2)
            off = col.offsets.to_numpy().astype(np.int64)
            place, at = own.places(col.values.to_numpy()[off[0] : off[-1]], off - off[0])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(place.astype(np.int32))), batch.column(3)], names=["doc_id", "y", "places", "h"])

    return run


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAIN_ROWS) -> Machine:
    """The machine fitted on documents' texts and labels (doc_id and a 0/1 column)."""
    own = F.broadcast(training_labels(labels, label, rows))  # bounded by rows
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(own, "doc_id").select("doc_id", "y", "text")
    table = written(found.mapInArrow(_term_rows, "doc_id long, y int, terms array<long>"), "terms")
    n, good = table.agg(F.count("*"), F.sum("y")).first()
    if not n or not 0 < good < n:
        return constant(good / n if n else 0.0)
    terms = known_terms(table, n, good)
    # at most KEPT_TERMS numbers a row come to the driver
    back = table.select("doc_id", "y", "terms", F.xxhash64("terms").alias("h")).mapInArrow(_place_rows(terms), "doc_id long, y int, places array<int>, h long")
    back = back.toArrow().sort_by([("doc_id", "ascending"), ("h", "ascending")]).combine_chunks()
    discard(table)
    places = back["places"].chunk(0)
    off = places.offsets.to_numpy().astype(np.int64)
    return fit(back["y"].to_numpy().astype(np.int64), places.values.to_numpy()[off[0] : off[-1]].astype(np.int64), off - off[0], terms)


def toxicity(spark, machine: Machine):
    """A function from a text column to its score, a double from 0 to 1."""
    model = spark.sparkContext.broadcast((machine.bias, machine.terms, machine.weight, machine.vector))

    def run(col: pa.Array) -> pa.Array:
        own = Machine(*model.value)
        data, off = text_buffers(col)
        out = [own.logits(*document_terms(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])) for lo, hi in chunks(data, off)]
        z = np.concatenate(out) if out else np.zeros(0)
        return pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))), pa.float64())

    return F.arrow_udf(run, "double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    machine = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), toxicity(spark, machine)(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that score 0.5 or more; all columns stay."""
    score = toxicity(docs.sparkSession, train(docs, labels))
    return docs.withColumn("__toxicity", score(F.col("text").cast("string"))).where("__toxicity < 0.5").drop("__toxicity")
