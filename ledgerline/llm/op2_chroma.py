"""Chroma audio fingerprints of media columns, and their alignment.

A recording is a float PCM column (or WAV bytes, see pcm_of_wav). Its spectrum is folded to twelve pitch classes per frame,
smoothed and normalised; an integral image over (frame, pitch class) gives every rectangle's sum in four look-ups, and FILTERS
compare such sums in a window that slides over the frames. Each filter's value is quantised to two bits (Gray code), and the
bits of all sixteen are packed to one 32-bit integer per frame.

Alignment. A place of a recording is one where its code differs from the one before: silence and held tones have none after their
first. A key is two codes of places 1 to GAPS apart. A recording and a query vote for an offset with each key that both have there;
the votes by offset are the pair's histogram. At each offset with a vote and LEAST_OVERLAP codes in common, the bits that differ
over the whole overlap are counted, and a pair is a match if one has a bit error of MAX_ERROR or less; the offset with the least is
its own (of several the least offset). All recordings and all votes are gone through: what such a definition calls a match is found.

Recordings of one fingerprint are one class, named by its smallest id, and matched once. A null or empty recording, and one shorter
than the filters' window, has no codes and no matches; those are one class too. A recording without an id is left out. Different
recordings of one id are classes of their own. Codes of long recordings are large rows: set
spark.sql.execution.arrow.maxRecordsPerBatch to as many as a task's memory holds.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import small, written
from .wordhash import chunks, mix

RATE = 4000
FRAME = 512
HOP = 256
PITCH_RANGE = (110.0, 1760.0)
SMOOTH = np.array([0.25, 0.75, 1.0, 0.75, 0.25])
WINDOW = 16
#: Kind, first pitch class, height and width of the filters, by rule.
FILTERS = [(k % 6, (5 * k) % (13 - high), high, 3 + (9 * k) % (WINDOW - 2)) for k in range(16) for high in [(3, 4, 6, 12)[k % 4]]]
#: Values of a filter at which its code changes.
LEVELS = (-0.12, 0.0, 0.12)
#: Codes of a key stand up to this many places apart.
GAPS = 8
MAX_ERROR = 0.1
#: Codes that aligned recordings must have in common at least.
LEAST_OVERLAP = 32
#: Keys of all queries that are sent to every task, at 20 bytes each; of more, keys are joined by a shuffle.
BROADCAST_KEYS = 2_000_000
#: Codes whose keys are made at once.
CHUNK_CODES = 1 << 17
#: Of the query below: tones, and how long each sounds.
TONES = 24
TONE_SAMPLES = FRAME


def pcm_of_wav(data: bytes) -> tuple[np.ndarray, int]:
    """Mono samples from -1 to 1 of 16-bit WAV bytes, and their rate."""
    with wave.open(io.BytesIO(data)) as w:
        raw = np.frombuffer(w.readframes(w.getnframes()), dtype="<i2").reshape(-1, w.getnchannels())
        return raw.mean(axis=1) / 32768, w.getframerate()


def _pitch_classes(rate: int) -> np.ndarray:
    """Which pitch class each bin of a frame's spectrum counts for: a (bins, 12) matrix of 0 and 1."""
    f = np.fft.rfftfreq(FRAME, 1 / rate)
    out = np.zeros((len(f), 12))
    ok = np.flatnonzero((f >= PITCH_RANGE[0]) & (f <= PITCH_RANGE[1]))
    out[ok, np.round(12 * np.log2(f[ok] / 440)).astype(int) % 12] = 1
    return out


def chroma(samples: np.ndarray, rate: int = RATE) -> np.ndarray:
    """(recordings, frames, 12): smoothed pitch-class shares of the rows of samples, all of one length."""
    n = (samples.shape[1] - FRAME) // HOP + 1
    if n < 1:
        return np.zeros((len(samples), 0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME, axis=1)[:, :: HOP][:, :n]
    power = np.abs(np.fft.rfft(frames * np.hanning(FRAME).astype(samples.dtype), axis=2)) ** 2
    out = power @ _pitch_classes(rate)
    if n >= len(SMOOTH):
        out = sum(w * out[:, i : n - len(SMOOTH) + 1 + i] for i, w in enumerate(SMOOTH))
    size = np.sqrt((out**2).sum(axis=2, keepdims=True))
    return np.where(size > 1e-9, out / np.maximum(size, 1e-9), 0)


def _filter(integral: np.ndarray, kind: int, y: int, high: int, wide: int) -> np.ndarray:
    """Of each window, log of one part's sum against the rest's; kinds: whole, upper/lower, left/right, quarters, three bands, three spans."""
    n = integral.shape[1] - 1 - WINDOW + 1
    at = np.arange(n)

    def area(x0: int, y0: int, x1: int, y1: int) -> np.ndarray:
        return integral[:, at + x1, y1] - integral[:, at + x0, y1] - integral[:, at + x1, y0] + integral[:, at + x0, y0]

    y1, ym, xm = min(12, y + high), min(12, y + high // 2), wide // 2
    if kind == 0:
        a, b = area(0, y, wide, y1), area(0, 0, wide, 12) / 12 * (y1 - y)
    elif kind == 1:
        a, b = area(0, y, wide, ym), area(0, ym, wide, y1)
    elif kind == 2:
        a, b = area(0, y, xm, y1), area(xm, y, wide, y1)
    elif kind == 3:
        a, b = area(0, y, xm, ym) + area(xm, ym, wide, y1), area(0, ym, xm, y1) + area(xm, y, wide, ym)
    elif kind == 4:
        t = max(1, high // 3)
        a, b = area(0, y + t, wide, min(12, y + 2 * t)), area(0, y, wide, y + t) + area(0, min(12, y + 2 * t), wide, y1)
    else:
        t = max(1, wide // 3)
        a, b = area(t, y, 2 * t, y1), area(0, y, t, y1) + area(2 * t, y, wide, y1)
    return np.log((1 + np.maximum(a, 0)) / (1 + np.maximum(b, 0)))


def fingerprints(samples: np.ndarray, rate: int = RATE) -> np.ndarray:
    """(recordings, codes) 32-bit integers."""
    image = chroma(samples, rate)
    if image.shape[1] < WINDOW:
        return np.zeros((len(samples), 0), dtype=np.int32)
    integral = np.zeros((len(image), image.shape[1] + 1, 13))
    integral[:, 1:, 1:] = image.cumsum(1).cumsum(2)
    gray = np.array([0, 1, 3, 2], dtype=np.uint32)
    out = np.zeros((len(image), image.shape[1] - WINDOW + 1), dtype=np.uint32)
    for kind, y, high, wide in FILTERS:
        out = out << np.uint32(2) | gray[np.searchsorted(LEVELS, _filter(integral, kind, y, high, wide), side="right")]
    return out.view(np.int32)


def with_codes(recordings: DataFrame, samples: str = "samples", name: str = "codes", render=None, rate: int = RATE) -> DataFrame:
    """recordings with an array<int> of codes of an array<float> column; render turns a row's values to samples first."""

    def run(col: pa.Array) -> pa.Array:
        out: list[np.ndarray | None] = [None] * len(col)
        rows = [np.zeros(0, np.float32) if x is None else np.nan_to_num(np.asarray(x, dtype=np.float32)) for x in col.to_numpy(zero_copy_only=False)]
        by_size: dict[int, list[int]] = {}
        for i, x in enumerate(rows):
            by_size.setdefault(len(x), []).append(i)
        for own in by_size.values():
            for k in range(0, len(own), 32):
                some = own[k : k + 32]
                block = np.stack([rows[i] for i in some])
                for i, codes in zip(some, fingerprints(render(block) if render else block, rate), strict=True):
                    out[i] = codes
        return pa.array(out, pa.list_(pa.int32()))

    return recordings.withColumn(name, F.arrow_udf(run, "array<int>")(F.col(f"`{samples}`")))


def _flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    off = col.offsets.to_numpy().astype(np.int64)
    return col.values.to_numpy()[off[0] : off[-1]].view(np.uint32), off - off[0]


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of recordings (id, codes): a row for each key, with its first place."""
    for batch in batches:
        codes, off = _flat(batch.column(1))
        ids = batch.column(0).to_numpy()
        for lo, hi in chunks(codes, off, CHUNK_CODES):
            x, at = codes[off[lo] : off[hi]].astype(np.uint64), off[lo : hi + 1] - off[lo]
            of = np.repeat(np.arange(lo, hi), np.diff(at))
            place = np.arange(len(x)) - at[of - lo]
            changes = np.append(False, x[1:] != x[:-1]) & (place > 0) if len(x) else np.zeros(0, bool)
            for gap in range(1, GAPS + 1):
                own = np.flatnonzero(changes[:-gap] & changes[gap:] & (of[:-gap] == of[gap:]))
                key = mix(mix(x[own] << np.uint64(32) | x[own + gap]) + np.uint64(gap))
                yield pa.RecordBatch.from_arrays([pa.array(ids[of[own]]), pa.array(key.view(np.int64)), pa.array(place[own].astype(np.int32))], names=["id", "key", "place"])


def _bit_errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs at an offset (q, r, off, votes, codes of both): the share of bits that differ where they overlap; null if that is too short."""
    for batch in batches:
        off = batch.column(2).to_pylist()
        (a, a_at), (b, b_at) = _flat(batch.column(4)), _flat(batch.column(5))
        out = []
        for i, d in enumerate(off):
            x, y = a[a_at[i] : a_at[i + 1]], b[b_at[i] : b_at[i + 1]]
            lo, hi = max(0, -d), min(len(x), len(y) - d)
            out.append(float(np.bitwise_count(x[lo:hi] ^ y[lo + d : hi + d]).sum()) / (32 * (hi - lo)) if hi - lo >= LEAST_OVERLAP else None)
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, pa.float64())], names=["q", "r", "off", "votes", "bit_error"])


def align(classes: DataFrame, asked: DataFrame, max_error: float = MAX_ERROR) -> DataFrame:
    """Matches (q, r, off, votes, bit_error) of the classes in asked (column class_id) with all other classes (class_id, codes): a place i of q is place i + off of r."""
    classes = classes.select(F.col("class_id").cast("long").alias("class_id"), "codes").where(F.col("class_id").isNotNull() & (F.size("codes") >= LEAST_OVERLAP))
    keys = "id long, key long, place int"
    q = classes.join(small(asked.select("class_id").distinct()), "class_id", "left_semi").mapInArrow(_key_rows, keys)
    q = small(written(q.select(F.col("id").alias("q"), "key", F.col("place").alias("p")), "keys"), BROADCAST_KEYS)
    votes = classes.mapInArrow(_key_rows, keys).join(q, "key").where("q != id").groupBy("q", F.col("id").alias("r"), (F.col("place") - F.col("p")).alias("off")).agg(F.count("*").alias("votes"))
    votes = small(written(votes, "votes"))
    of_q, of_r = classes.select(F.col("class_id").alias("q"), F.col("codes").alias("a")), classes.select(F.col("class_id").alias("r"), F.col("codes").alias("b"))
    both = of_r.join(votes, "r")
    both = both.join(of_q.join(small(asked.select(F.col("class_id").alias("q")).distinct()), "q", "left_semi"), "q").select("q", "r", "off", "votes", "a", "b")
    found = both.mapInArrow(_bit_errors, "q long, r long, off int, votes long, bit_error double").where(F.col("bit_error") <= max_error)
    best = found.groupBy("q", "r").agg(F.min(F.struct("bit_error", "off", "votes")).alias("b"))
    return best.select("q", "r", "b.off", "b.votes", "b.bit_error")


def tones(rows: np.ndarray) -> np.ndarray:
    """Sounds for vectors: each component a tone, the higher the larger it is within its vector."""
    if not rows.shape[1]:
        return np.zeros((len(rows), 0), np.float32)
    lo, hi = rows.min(1, keepdims=True), rows.max(1, keepdims=True)
    step = np.clip((rows - lo) / np.maximum(hi - lo, 1e-9) * TONES, 0, TONES - 1).astype(int)
    wave_of = np.sin(2 * np.pi * (220 * 2 ** (np.arange(TONES) / 12))[:, None] * np.arange(TONE_SAMPLES) / RATE).astype(np.float32)
    return wave_of[step].reshape(len(rows), -1)


def search(recordings: DataFrame, asked: Column, max_error: float = MAX_ERROR) -> DataFrame:
    """Of recordings (id, codes): a row for each asked one (a condition on id) and class that it matches, one with nulls if it matches none."""
    own = recordings.where(F.col("id").isNotNull()).select("id", "codes", F.monotonically_increasing_id().alias("n"))
    own = written(own, "codes")
    prints = written(own.select("n", "id", F.xxhash64("codes").alias("h1"), F.md5(F.to_json(F.struct("codes"))).alias("h2")), "prints")
    classes = written(prints.groupBy("h1", "h2").agg(F.min("n").alias("class"), F.min("id").alias("class_id"), F.count("*").alias("copies")), "classes")
    queries = prints.where(asked).join(classes, ["h1", "h2"]).select("id", "class", "class_id", "copies")
    codes = own.join(classes.select(F.col("class").alias("n")), "n", "left_semi").select(F.col("n").alias("class_id"), "codes")
    found = align(codes, queries.select(F.col("class").alias("class_id")), max_error)
    of = classes.select(F.col("class").alias("r"), F.col("class_id").alias("match_class"), F.col("copies").alias("match_copies"))
    found = found.join(of, "r").select(F.col("q").alias("class"), "match_class", "match_copies", F.col("off").alias("offset"), "votes", "bit_error")
    return queries.join(found, "class", "left").select("id", "class_id", "copies", "match_class", "match_copies", "offset", "votes", "bit_error")


def query(spark, sf_dir: str) -> DataFrame:
    """Vectors sounded as tone rows stand for media: a row per vec_id divisible by 50 and class that it matches; copies are matched as the class of the smallest vec_id."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("id"), "embedding")
    return search(with_codes(vectors, "embedding", "codes", tones), F.col("id") % 50 == 0).withColumnRenamed("id", "vec_id")
