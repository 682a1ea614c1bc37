"""Quality by hierarchical empirical Bayes: a document's own evidence, and what its path and host are like.

Evidence is the logit of a logistic regression on figures of style (shares of capitals, digits, signs, repeated words, pairs and
lines, word lengths), fitted on a bounded sample of labelled rows, and computed once for each document. Rates of good documents by host
and by path are grouped sums of the documents' probabilities. A path's rate is shrunk toward its host's, a host's toward the global one, each
as if it had kappa more documents of that rate. Kappa is the variance of documents within groups over the variance between groups,
by the usual moments of a one-way layout (groups of all sizes): sites with few documents follow the prior, and so do all if sites
don't differ. A document is left out of its own path's rate.

The score of a document is its evidence, moved by the log-odds of its path's rate against the global one: the posterior of a
document whose prior is its site's instead of the corpus'.

Hosts and paths are columns. Of a table without URLs, site() takes what is before the first slash of a source (after a scheme) as the host, and
the first folder after it, or else the language, as the path.

A null or empty text has figures of 0 and is scored from them. Null hosts and paths form a group of their own. Without labelled
rows of both classes, all evidence is 0 and all documents are kept. A null doc_id isn't trained on. Repeated rows count each time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .op4_toxicity import held_out, training_labels
from .shared import small, written
from .wordhash import LOWER, SPACE_SPLIT, byte_class, chunks, ngrams, text_buffers, word_spans, words

#: Labelled rows to train on at most.
TRAIN_ROWS = 16_000
#: Least and largest kappa; the latter also where groups don't differ or there is one only.
KAPPA = (2.0, 1e6)
_LINES = byte_class(b"\n")
_SIGNS = np.zeros(256, dtype=bool)
_SIGNS[list(b"#$%&*+<=>@^_{|}~[]\\/")] = True


def _repeated(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each document, the share of its values that aren't the first of their kind."""
    n = np.diff(at)
    doc = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((h, doc))
    same = np.zeros(len(h), dtype=bool)
    same[1:] = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    return np.bincount(doc[order], same, len(n)) / np.maximum(1, n)


def figures(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of figures for each document."""
    docs = len(off) - 1
    size = np.maximum(1, np.diff(off))
    doc = np.repeat(np.arange(docs), np.diff(off))
    per = lambda mask: np.bincount(doc, mask, docs)
    upper, lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
    h, at = words(data, off, SPACE_SPLIT)
    _, _, length, _ = word_spans(data, off, SPACE_SPLIT)
    n = np.diff(at)
    many = np.maximum(1, n)
    of = np.repeat(np.arange(docs), n)
    pair = ngrams(h, 2)
    inside = of[1:] == of[:-1] if len(of) > 1 else np.zeros(0, bool)
    line, line_at = words(data, off, _LINES)
    shares = [
        per(upper) / np.maximum(1, per(upper | lower)),
        per((data >= 48) & (data <= 57)) / size,
        per(_SIGNS[data]) / size,
        per(data == 0x7C) / many,
        per(data == 0x21) / many,
        per(np.isin(data, list(b".,;:?"))) / many,
        _repeated(h, at),
        _repeated(pair[inside], np.append(0, np.cumsum(np.bincount(of[1:][inside], minlength=docs)))),
        _repeated(line, line_at),
        np.bincount(of, length <= 3, docs) / many,
        np.bincount(of, length > 12, docs) / many,
        np.bincount(of, length, docs) / many / 10,
    ]
    return np.stack([*shares, *map(np.sqrt, shares), np.log1p(n) / 10, np.log1p(size) / 10, n == 0], axis=1).astype(np.float64)


def _figure_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = text_buffers(batch.column(2))
        for lo, hi in chunks(data, off):
            x = figures(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).cast(pa.int64()), batch.column(1).slice(lo, hi - lo), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "y", "x"])


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, scales and weights (bias last) of a logistic regression, by Newton steps."""
    if not len(y) or not 0 < y.sum() < len(y):
        width = x.shape[1] if x.ndim == 2 else 0
        return np.zeros(width), np.ones(width), np.zeros(width + 1)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.column_stack(((x - mean) / scale, np.ones(len(x))))
    w = np.zeros(z.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hessian = (z * (p * (1 - p))[:, None]).T @ z / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, z.T @ (p - y) / len(y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS):
    own = F.broadcast(training_labels(labels, label, rows))  # bounded by rows
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(own, "doc_id").select("doc_id", "y", "text")
    table = found.mapInArrow(_figure_rows, "doc_id long, y int, x array<double>").toArrow().sort_by("doc_id")
    x = np.array(table["x"].to_pylist(), dtype=np.float64)
    return fit(x if len(x) else np.zeros((0, 0)), table["y"].to_numpy().astype(np.float64))


def evidence(spark, model):
    """A function from a text column to the logit of being good."""
    held = spark.sparkContext.broadcast(model)

    def run(col: pa.Array) -> pa.Array:
        mean, scale, w = held.value
        data, off = text_buffers(col)
        out = []
        for lo, hi in chunks(data, off):
            if not len(mean):
                out.append(np.zeros(hi - lo))
                continue
            x = figures(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            out.append(np.clip((x - mean) / scale @ w[:-1] + w[-1], -30, 30))
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return F.arrow_udf(run, "double")


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))


def _kappa(groups: DataFrame) -> float:
    """Documents that a prior counts for, from the groups' sums s, sums of squares q and counts n."""
    of = F.sum("n"), F.sum(F.col("n") * F.col("n")), F.count("*"), F.sum("s"), F.sum(F.col("s") * F.col("s") / F.col("n")), F.sum("q")
    n, n2, k, s, by_group, q = groups.agg(*of).first()
    if not n or k < 2 or n <= k:
        return KAPPA[1]
    within = max(0.0, q - by_group) / (n - k)
    between = (by_group - s * s / n - (k - 1) * within) / (n - n2 / n)
    return float(min(max(within / between, KAPPA[0]), KAPPA[1])) if between > 0 else KAPPA[1]


def site_rates(docs: DataFrame, p: Column, host: Column, path: Column) -> tuple[DataFrame, float, float]:
    """A row per path: its host, path, s and n (sum and count), the host's shrunk rate; the global rate and the paths' kappa."""
    own = docs.select(host.cast("string").alias("host"), path.cast("string").alias("path"), p.alias("p"))
    paths = written(own.groupBy("host", "path").agg(F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q"), F.count("*").alias("n")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("n").alias("n"))
    s, n = hosts.agg(F.sum("s"), F.sum("n")).first()
    rate = s / n if n else 0.5
    kh, kp = _kappa(hosts), _kappa(paths)
    hosts = hosts.select(F.col("host").alias("h"), ((F.col("s") + kh * rate) / (F.col("n") + kh)).alias("host_rate"))
    return paths.join(small(hosts), F.col("host").eqNullSafe(F.col("h"))).drop("h", "q"), rate, kp


def site(source: Column, lang: Column) -> tuple[Column, Column]:
    """Host and path of a source, a URL or a name."""
    bare = F.regexp_replace(F.lower(source.cast("string")), "^[a-z][a-z0-9+.-]*://", "")
    folder = F.regexp_extract(bare, "^[^/]*/([^/?#]+)/", 1)
    return F.regexp_extract(bare, "^[^/?#]*", 0), F.when(folder != "", folder).otherwise(lang.cast("string"))


def with_evidence(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with a column __e, the logit of being good by the text alone."""
    return docs.withColumn("__e", evidence(docs.sparkSession, train(docs, labels))(F.col("text").cast("string")))


def scored(docs: DataFrame, host: Column, path: Column) -> DataFrame:
    """docs (with __e) with a struct column quality: evidence (logit), host_rate, path_rate, score; the other columns stay. docs is written once, so that evidence isn't computed for the rates and again for the scores."""
    docs = written(docs, "evidence")
    p = 1 / (1 + F.exp(-F.col("__e")))
    rates, rate, kappa = site_rates(docs, p, host, path)
    rates = rates.select(F.col("host").alias("__host"), F.col("path").alias("__path"), F.col("s").alias("__s"), F.col("n").alias("__n"), F.col("host_rate").alias("__hr"))
    on = host.cast("string").eqNullSafe(F.col("__host")) & path.cast("string").eqNullSafe(F.col("__path"))
    both = docs.join(small(rates), on)
    path_rate = (F.col("__s") - p + kappa * F.col("__hr")) / (F.col("__n") - 1 + kappa)
    score = 1 / (1 + F.exp(-(F.col("__e") + _logit(path_rate) - _logit(F.lit(rate)))))
    return both.withColumn("quality", F.struct(F.col("__e").alias("evidence"), F.col("__hr").alias("host_rate"), path_rate.alias("path_rate"), score.alias("score"))).drop("__e", "__host", "__path", "__s", "__n", "__hr")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    own = with_evidence(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("text")
    out = scored(own, *site(F.col("source"), F.col("lang")))
    q = F.col("quality")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), q["evidence"].alias("evidence"), q["host_rate"].alias("host_rate"), q["path_rate"].alias("path_rate"), q["score"].alias("score"), (q["score"] >= 0.5).cast("int").alias("predicted"))


def good_only(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that score under 0.5; all columns stay, whatever their names."""
    columns = docs.columns
    kept = docs if "quality" not in columns else docs.withColumnRenamed("quality", "__quality")
    out = scored(with_evidence(kept, labels), *site(F.col("source"), F.col("lang"))).where("quality.score >= 0.5").drop("quality")
    return (out.withColumnRenamed("__quality", "quality") if "quality" in columns else out).select(columns)
