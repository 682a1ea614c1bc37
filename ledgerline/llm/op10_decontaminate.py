"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are its runs of ten words (a shorter item is one window). A window can only be contained in a document that
holds all of its shingles, so one shingle is enough for a prefix: the rarest, as counted over all windows of the benchmark.
Documents look their shingles up among the prefix tokens; a match is kept if the window fits between the document's ends with
the prefix at its place (length and positional bounds), and then verified by all the window's words.

Up to BLOCK_WINDOWS windows go to every task as one sorted table that documents are searched in, in one pass and without a shuffle.
Of more, only a bitmap of the prefix tokens is sent: documents' shingles that it has, with the words around them, are joined with
the windows by token in a shuffle, verified, and the hits grouped by document. Both give the same.

Words are hashed to 64 bits, a shingle and a window to 64 bits of their words' hashes, and equal hashes count as equal: text that is no
window's counts as hit only if both a shingle's and the whole window's hash collide, with a probability of 2^-64 and less for each
candidate.

Nulls and texts without words have no words and no hits. Null item texts have no windows; a null item_id counts as no item,
but its windows still hit. Repeated documents give repeated rows, repeated items count once. An empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import small, written
from .wordhash import ALNUM_SPLIT, chunks, ngrams, text_buffers, words

U = np.uint64
WINDOW = 10
#: Words of a prefix token; windows of fewer words have tokens of one or two.
GRAM = 3
#: Windows of the broadcast, about 40 bytes each: 20 MB. More are joined.
BLOCK_WINDOWS = 500_000
#: Bits of the bitmap for each window of a join, and at most (32 MB).
JOIN_BITS = 16
MOST_BITS = 1 << 28
#: Bits of the bitmap that a document's shingles are looked up in first.
SCREEN_BITS = 1 << 22

_WINDOW_SCHEMA = "item_id string, token long, place int, length int, window long"
_HIT_SCHEMA = "n_words long, hit binary, items array<string>"


def _window_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_buffers(batch.column(1))
            item = batch.column(0)
            for lo, hi in chunks(data, off):
                h, at = words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], ALNUM_SPLIT)
                rows: list[list[np.ndarray]] = []
                for i in range(hi - lo):
                    own = h[at[i] : at[i + 1]]
                    if not len(own):
                        continue
                    m = min(window, len(own))
                    g = min(GRAM, m)
                    grams, whole = ngrams(own, g), ngrams(own, m)
                    place = np.tile(np.arange(m - g + 1), len(whole))
                    start = np.repeat(np.arange(len(whole)), m - g + 1)
                    rows.append([np.full(len(place), lo + i), grams[start + place].view(np.int64), place, np.full(len(place), m), whole[start].view(np.int64)])
                if rows:
                    of, token, place, length, whole = (np.concatenate(x) for x in zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([item.take(pa.array(of)), pa.array(token), pa.array(place, pa.int32()), pa.array(length, pa.int32()), pa.array(whole)], names=["item_id", "token", "place", "length", "window"])

    return run


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per distinct window and item, with its rarest shingle as its prefix token, and the token's place in the window."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(_window_rows(window), _WINDOW_SCHEMA)
    often = rows.groupBy("token").agg(F.count("*").alias("often"))
    best = rows.join(often, "token").groupBy("item_id", "window", "length").agg(F.min(F.struct("often", "token", "place")).alias("p"))
    return best.select("item_id", "window", "length", "p.token", "p.place")


class _Block:
    """The windows of one block: sorted by token, apart for each length of a token."""

    def __init__(self, table: pa.Table):
        order = np.argsort(table["token"].to_numpy().view(U), kind="stable")
        self.items = table["item_id"].combine_chunks().take(pa.array(order))
        self.token = table["token"].to_numpy().view(U)[order]
        self.place, self.length = table["place"].to_numpy()[order].astype(np.int64), table["length"].to_numpy()[order].astype(np.int64)
        self.window = table["window"].to_numpy().view(U)[order]
        self.grams = sorted({min(GRAM, int(m)) for m in np.unique(self.length)})
        self.screen = np.zeros(SCREEN_BITS, dtype=bool)
        self.screen[(self.token & U(SCREEN_BITS - 1)).astype(np.int64)] = True

    def hits(self, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, first word (among all documents') and window of each verified occurrence."""
        doc, start, win = [], [], []
        for g in self.grams:
            t = ngrams(h, g)
            pos = np.flatnonzero(self.screen[(t & U(SCREEN_BITS - 1)).astype(np.int64)])
            left = np.searchsorted(self.token, t[pos], side="left")
            many = np.searchsorted(self.token, t[pos], side="right") - left
            w = np.repeat(left - np.cumsum(many) + many, many) + np.arange(many.sum())
            p = np.repeat(pos, many)
            s = p - self.place[w]
            d = np.searchsorted(at, p, side="right") - 1
            ok = (s >= at[d]) & (s + self.length[w] <= at[d + 1]) & (np.minimum(GRAM, self.length[w]) == g)
            d, s, w = d[ok], s[ok], w[ok]
            for m in np.unique(self.length[w]):
                own = np.flatnonzero(self.length[w] == m)
                for i in range(0, len(own), 1 << 16):
                    some = own[i : i + (1 << 16)]
                    around = h[s[some][:, None] + np.arange(m)]
                    same = np.flatnonzero(_row_hash(around) == self.window[w[some]])
                    doc.append(d[some][same])
                    start.append(s[some][same])
                    win.append(w[some][same])
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (doc, start, win))


def _row_hash(rows: np.ndarray) -> np.ndarray:
    """ngrams() of each row."""
    flat = ngrams(rows.ravel(), rows.shape[1])
    return flat[:: rows.shape[1]]


def _searcher(block):
    opened: list[_Block] = []  # once in a task

    def run(col: pa.Array) -> pa.Array:
        if not opened:
            opened.append(_Block(pa.ipc.open_stream(block.value).read_all()))
        own = opened[0]
        data, off = text_buffers(col)
        n_words, hit, items = [], [], []
        for lo, hi in chunks(data, off):
            h, at = words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], ALNUM_SPLIT)
            n_words.append(np.diff(at))
            doc, start, win = own.hits(h, at)
            depth = np.zeros(len(h) + 1, dtype=np.int64)
            np.add.at(depth, start, 1)
            np.add.at(depth, start + own.length[win], -1)
            inside = np.cumsum(depth[:-1]) > 0
            pair = np.unique(doc * len(own.token) + win) if len(doc) else np.zeros(0, np.int64)
            cut = np.searchsorted(pair, np.arange(hi - lo + 1) * max(1, len(own.token)))
            for i in range(hi - lo):
                if cut[i] == cut[i + 1]:
                    hit.append(b"")
                    items.append([])
                else:
                    hit.append(np.packbits(inside[at[i] : at[i + 1]]).tobytes())
                    items.append(sorted({x for x in own.items.take(pa.array(pair[cut[i] : cut[i + 1]] % len(own.token))).to_pylist() if x is not None}))
        n = np.concatenate(n_words) if n_words else np.zeros(0, np.int64)
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(hit, pa.binary()), pa.array(items, pa.list_(pa.string()))], names=["n_words", "hit", "items"])

    return run


def _summary(hit: pa.Array, items: pa.Array) -> pa.Array:
    n = [int(np.bitwise_count(np.frombuffer(b or b"", dtype=np.uint8)).sum()) for b in hit.to_pylist()]
    found = [sorted(set(x or [])) for x in items.to_pylist()]
    sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in found]
    return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array([len(x) for x in found], pa.int64()), pa.array(sha, pa.string())], names=["n_hit", "n_items", "items_sha256"])


def _searched(docs: DataFrame, windows: DataFrame, name: str, text: str) -> DataFrame:
    """By a broadcast of all windows: n_words, hit and items of each document."""
    sink = pa.BufferOutputStream()
    table = windows.toArrow()  # at most BLOCK_WINDOWS rows
    with pa.ipc.new_stream(sink, table.schema) as s:
        s.write_table(table)
    search = F.arrow_udf(_searcher(docs.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())), _HIT_SCHEMA)
    return docs.withColumn(name, search(F.col(f"`{text}`").cast("string")))


def _bitmap(windows: DataFrame, n: int) -> np.ndarray:
    """True for the low bits of every token."""
    bits = min(MOST_BITS, max(SCREEN_BITS, 1 << (JOIN_BITS * n - 1).bit_length()))
    low = F.col("token").bitwiseAND(F.lit(bits - 1))
    cells = windows.groupBy(F.shiftright(low, 6).alias("cell")).agg(F.expr("bit_or(shiftleft(1L, cast(token & 63 as int)))").alias("set")).toArrow()
    out = np.zeros(bits // 64, dtype=U)
    out[cells["cell"].to_numpy()] = cells["set"].to_numpy().view(U)
    return out


_CANDIDATE = "uid long, token long, place_in int, before int, around array<long>"


def _candidates(bitmap, window: int, grams: list[int]):
    """Over uid and text: the shingles that may be a window's prefix, with the words around that such a window could have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        screen = bitmap.value
        mask = U(len(screen) * 64 - 1)
        for batch in batches:
            data, off = text_buffers(batch.column(1))
            uid = batch.column(0).to_numpy()
            for lo, hi in chunks(data, off):
                h, at = words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], ALNUM_SPLIT)
                for g in grams:
                    t = ngrams(h, g)
                    low = t & mask
                    pos = np.flatnonzero(screen[(low >> U(6)).astype(np.int64)] >> (low & U(63)) & U(1))
                    d = np.searchsorted(at, pos, side="right") - 1
                    inside = pos + g <= at[d + 1]
                    for i in range(0, int(inside.sum()), 1 << 15):
                        p, own = pos[inside][i : i + (1 << 15)], d[inside][i : i + (1 << 15)]
                        first, last = np.maximum(at[own], p + g - window), np.minimum(at[own + 1], p + window)
                        n = last - first
                        flat = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
                        around = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(h[flat].view(np.int64)))
                        yield pa.RecordBatch.from_arrays([pa.array(uid[lo + own]), pa.array(t[p].view(np.int64)), pa.array((p - at[own]).astype(np.int32)), pa.array((p - first).astype(np.int32)), around], names=["uid", "token", "place_in", "before", "around"])

    return run


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over joined candidates: those that have the window's words around them (length and positional bounds, then all words)."""
    for batch in batches:
        uid, place_in, before, place, length = (batch.column(c).to_numpy().astype(np.int64) for c in ("uid", "place_in", "before", "place", "length"))
        around = batch.column("around")
        off = around.offsets.to_numpy().astype(np.int64)
        h = around.values.to_numpy().view(U)
        begin = off[:-1] + before - place
        ok = (before >= place) & (begin + length <= off[1:])
        same = np.zeros(len(uid), dtype=bool)
        window = batch.column("window").to_numpy().view(U)
        for m in np.unique(length[ok]):
            own = np.flatnonzero(ok & (length == m))
            same[own] = _row_hash(h[begin[own][:, None] + np.arange(m)]) == window[own]
        yield pa.RecordBatch.from_arrays([pa.array(uid[same]), pa.array((place_in - place)[same]), pa.array(length[same]), batch.column("item_id").filter(pa.array(same))], names=["uid", "start", "length", "item_id"])


def _marked(text: pa.Array, spans: pa.Array) -> pa.Array:
    """n_words, and a bit for each word that is in a span."""
    data, off = text_buffers(text)
    n, hit = [], []
    spans = spans.to_pylist()
    for lo, hi in chunks(data, off):
        at = words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], ALNUM_SPLIT)[1]
        for i, many in enumerate(np.diff(at).tolist()):
            n.append(many)
            inside = np.zeros(many, dtype=bool)
            for s in spans[lo + i] or ():
                inside[s["start"] : s["start"] + s["length"]] = True
            hit.append(np.packbits(inside).tobytes() if inside.any() else b"")
    return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(hit, pa.binary())], names=["n_words", "hit"])


def _joined(docs: DataFrame, windows: DataFrame, n: int, name: str, text: str, window: int) -> DataFrame:
    """By a shuffled join on prefix tokens: n_words, hit and items of each document."""
    spark = docs.sparkSession
    own = written(docs.withColumn("__uid", F.monotonically_increasing_id()), "documents")
    grams = sorted(min(GRAM, r[0]) for r in windows.select("length").distinct().collect())
    bitmap = spark.sparkContext.broadcast(_bitmap(windows, n))
    found = own.select(F.col("__uid").alias("uid"), F.col(f"`{text}`").cast("string").alias("t")).mapInArrow(_candidates(bitmap, window, sorted(set(grams))), _CANDIDATE)
    hits = found.join(windows, "token").mapInArrow(_verified, "uid long, start long, length long, item_id string")
    hits = written(hits, "hits").groupBy("uid").agg(F.collect_set(F.struct("start", "length")).alias("__spans"), F.collect_set("item_id").alias("__items"))  # one document's own
    out = own.join(small(hits), F.col("__uid") == F.col("uid"), "left").drop("uid", "__uid")
    marked = F.arrow_udf(_marked, "n_words long, hit binary")(F.col(f"`{text}`").cast("string"), F.col("__spans"))
    out = out.withColumn("__marked", marked).withColumn("__items", F.coalesce("__items", F.array().cast("array<string>")))
    both = F.struct(F.col("__marked.n_words").alias("n_words"), F.col("__marked.hit").alias("hit"), F.col("__items").alias("items"))
    return out.withColumn(name, both).drop("__marked", "__items", "__spans")


def with_hits(docs: DataFrame, benchmark: DataFrame, name: str = "leak", text: str = "text", window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """docs with a struct column called name: n_words, hit (a bit for each word, high bits first; empty if none), items, n_hit, n_items, items_sha256."""
    windows = written(benchmark_windows(benchmark, window), "windows")
    n = windows.count()
    out = _searched(docs, windows, name, text) if n <= block_windows else _joined(docs, windows, n, name, text, window)
    found = F.col(f"`{name}`")
    total = F.arrow_udf(_summary, "n_hit long, n_items long, items_sha256 string")(found["hit"], found["items"])
    out = out.withColumn("__total", total)
    total = F.col("`__total`")
    return out.withColumn(name, F.struct(found["n_words"].alias("n_words"), found["hit"].alias("hit"), found["items"].alias("items"), total["n_hit"].alias("n_hit"), total["n_items"].alias("n_items"), total["items_sha256"].alias("items_sha256"))).drop("__total")


def contaminated(name: str = "leak") -> Column:
    return F.col(f"`{name}`")["n_hit"] > 0


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold a window of a benchmark item; all columns stay."""
    return with_hits(docs, benchmark, "__leak").where(~contaminated("__leak")).drop("__leak")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = with_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "leak.n_words", "leak.n_hit", "leak.n_items", "leak.items_sha256", contaminated().alias("contaminated"))
