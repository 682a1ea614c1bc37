"""Chat formatting by columnar byte assembly.

The turns of a batch of conversations are one UTF-8 byte array. Texts are escaped, headers and ends chosen by role, and segment
lengths, running offsets and scatter indices computed in numpy; headers, texts and ends are then copied into one buffer that was
allocated for the whole batch, and that Arrow takes as its string column as it is.

Template: a conversation is "<s>" and its turns, each a header, the text and an end by its role (TEMPLATE). Inside texts, and in
the names of other roles, each "\\", "<", ">" and "[" gets a "\\" after it, so no control string, all of which begin with "<" or "[" and
something else, is found in a text; escaped bytes come in pairs, so reading back takes the second of each away. The loss mask
covers the texts of assistant turns, as spans of bytes.

Turns go in order of turn, then role and text (nulls first); repeated rows are turns of their own. A null text is empty, a null
role has a header of its own and reads back as null. Rows with a null conv_id are one conversation. A conversation is one string
of at most 2 GiB, as a Spark value is; others are laid out CHUNK_BYTES at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import parts
from .wordhash import text_buffers

BEGIN = b"<s>"
#: Header and end of a turn.
TEMPLATE = {
    "system": (b"<<SYS>> ", b" <</SYS>>"),
    "user": (b"[INST] ", b" [/INST]"),
    "assistant": (b"[OUT] ", b" </s>"),
    None: (b"<<NONE>> ", b" <</NONE>>"),
}
#: Of a turn in another role, whose escaped name stands between.
OTHER = (b"<<ROLE ", b">> ", b" <</ROLE>>")
LEARNED = "assistant"
#: Bytes of turns that are laid out at once, and bytes that one scatter copies; longer segments are copied as slices.
CHUNK_BYTES = 16 << 20
SCATTER_BYTES = 1 << 20
_ESCAPED = np.zeros(256, dtype=bool)
_ESCAPED[list(b"\\<[>")] = True
_PAIR = re.compile(rb"([\\<\[>])\\")


def escape(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Escaped bytes and offsets of texts."""
    special = np.flatnonzero(_ESCAPED[data])
    out = np.full(len(data) + len(special), ord("\\"), dtype=np.uint8)
    for i in range(0, len(data), SCATTER_BYTES):
        j = min(len(data), i + SCATTER_BYTES)
        lo, hi = np.searchsorted(special, (i, j))
        before = np.zeros(j - i, dtype=np.int64)
        before[special[lo:hi][special[lo:hi] + 1 < j] + 1 - i] = 1
        out[np.arange(i, j) + lo + np.cumsum(before)] = data[i:j]
    return out, off + np.searchsorted(special, off)


def unescape(data: bytes) -> bytes:
    return _PAIR.sub(rb"\1", data)


def _scatter(out: np.ndarray, at: np.ndarray, source: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
    """Copies source[start:start + length] to out[at:] for every segment at once, some megabytes of them at a time."""
    for i in np.flatnonzero(length > SCATTER_BYTES):
        out[at[i] : at[i] + length[i]] = source[start[i] : start[i] + length[i]]
    some = np.flatnonzero((length > 0) & (length <= SCATTER_BYTES))
    ends = np.cumsum(length[some])
    i = 0
    while i < len(some):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + SCATTER_BYTES, side="right")))
        own = some[i:j]
        n = length[own]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(at[own], n) + step] = source[np.repeat(start[own], n) + step]
        i = j


def assemble(conv: np.ndarray, roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of turns in order: the bytes of all conversations, their offsets, the turns' conversations, and each text's span in its conversation."""
    body, body_at = escape(*text_buffers(texts))
    kinds = roles.dictionary_encode()
    heads, ends = [], []
    for r in kinds.dictionary.to_pylist():
        if r in TEMPLATE:
            heads.append(TEMPLATE[r][0])
            ends.append(TEMPLATE[r][1])
        else:
            name = np.frombuffer(r.encode(), dtype=np.uint8)
            heads.append(OTHER[0] + escape(name, np.array([0, len(name)]))[0].tobytes() + OTHER[1])
            ends.append(OTHER[2])
    heads.append(TEMPLATE[None][0])
    ends.append(TEMPLATE[None][1])
    kind = kinds.indices.fill_null(len(heads) - 1).to_numpy()
    first = np.append(True, conv[1:] != conv[:-1]) if len(conv) else np.zeros(0, bool)
    head_size, end_size = np.array([len(x) for x in heads]), np.array([len(x) for x in ends])
    begin, head, end = np.where(first, len(BEGIN), 0), head_size[kind], end_size[kind]
    size = np.diff(body_at)
    total = begin + head + size + end
    at = np.cumsum(total) - total
    out = np.empty(int(total.sum()), dtype=np.uint8)
    opening = np.frombuffer(BEGIN, dtype=np.uint8)
    _scatter(out, at, opening, np.zeros(len(at), np.int64), begin)
    _scatter(out, at + begin, np.frombuffer(b"".join(heads), dtype=np.uint8), (np.cumsum(head_size) - head_size)[kind], head)
    _scatter(out, at + begin + head, body, body_at[:-1], size)
    _scatter(out, at + begin + head + size, np.frombuffer(b"".join(ends), dtype=np.uint8), (np.cumsum(end_size) - end_size)[kind], end)
    number = np.cumsum(first) - 1
    offsets = np.append(at[first], len(out))
    inner = at + begin + head - offsets[number]
    return out, offsets, number, inner, inner + size


def _formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush(table: pa.Table) -> pa.RecordBatch:
        ids = table["conv_id"].combine_chunks()
        plain = ids.fill_null(0).to_numpy()
        conv = plain.astype(object) if ids.null_count else plain
        if ids.null_count:
            conv = np.where(ids.is_null().to_numpy(zero_copy_only=False), None, conv)
        roles = table["role"].combine_chunks()
        out, off, number, lo, hi = assemble(conv, roles, table["text"].combine_chunks())
        n = len(off) - 1
        first = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
        learned = np.flatnonzero(np.array(roles.to_pylist(), dtype=object) == LEARNED)
        cut = np.searchsorted(number[learned], np.arange(n + 1)).astype(np.int32)
        spans = [pa.ListArray.from_arrays(pa.array(cut), pa.array(x[learned], pa.int64())) for x in (lo, hi)]
        text = pa.LargeStringArray.from_buffers(n, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(out)).cast(pa.string())
        return pa.RecordBatch.from_arrays([ids.take(pa.array(first)), text, *spans], names=["conv_id", "formatted", "loss_from", "loss_to"])

    def flushed(batches_: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole conversations, about CHUNK_BYTES of them at a time."""
        t = pa.Table.from_batches(batches_)
        ids = t["conv_id"].to_numpy() if not t["conv_id"].null_count else t["conv_id"].to_pandas(integer_object_nulls=True).to_numpy()
        first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        if t["conv_id"].null_count:  # nulls come first, and are one conversation
            first = np.append(0, first[first >= t["conv_id"].null_count])
        size = np.cumsum(pc.binary_length(t["text"]).fill_null(0).to_numpy())
        ends = np.append(first[1:], t.num_rows)
        i = 0
        while i < len(first):
            before = size[first[i] - 1] if first[i] else 0
            j = max(i + 1, int(np.searchsorted(size[ends - 1], before + CHUNK_BYTES, side="right")))
            yield flush(t.slice(first[i], ends[j - 1] - first[i]))
            i = j

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0)
        last, i = ids[-1].as_py(), batch.num_rows - 1
        while i and ids[i - 1].as_py() == last:
            i -= 1
        if held and (i or held[-1].column(0)[-1].as_py() != last):
            yield from flushed([*held, batch.slice(0, i)])
            held = []
        elif i:
            yield from flushed([batch.slice(0, i)])
        held.append(batch.slice(i))
    if held:
        yield from flushed(held)


def format_conversations(turns: DataFrame) -> DataFrame:
    """A row per conversation: conv_id, formatted, and the byte spans of its loss mask, loss_from and loss_to."""
    own = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    dealt = own.repartition(parts(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(_formatted, "conv_id long, formatted string, loss_from array<long>, loss_to array<long>")


def parse(formatted: bytes) -> list[tuple[str | None, str]]:
    """Roles and texts of a formatted conversation."""
    if not formatted.startswith(BEGIN):
        raise ValueError("no conversation begins here")
    at, out = len(BEGIN), []
    while at < len(formatted):
        for role, (head, end) in TEMPLATE.items():
            if formatted.startswith(head, at):
                at += len(head)
                break
        else:
            if not formatted.startswith(OTHER[0], at):
                raise ValueError(f"no turn begins at byte {at}")
            stop = formatted.index(OTHER[1], at)
            name = formatted[at + len(OTHER[0]) : stop]
            role, end, at = unescape(name).decode(), OTHER[2], stop + len(OTHER[1])
        stop = formatted.index(end, at)
        out.append((role, unescape(formatted[at:stop]).decode()))
        at = stop + len(end)
    return out


def _read_back(formatted: pa.Array, lo: pa.Array, hi: pa.Array) -> pa.Array:
    cols: list[list] = [[], [], [], [], []]
    for text, a, b in zip(formatted.to_pylist(), lo.to_pylist(), hi.to_pylist(), strict=True):
        raw = text.encode()
        turns = parse(raw)
        learned = unescape(b"".join(raw[x:y] for x, y in zip(a, b, strict=True)))
        sha = hashlib.sha256()
        for role, said in turns:
            sha.update(f"{role or ''}\n{said}\n".encode())
        for c, x in zip(cols, (len(turns), sha.hexdigest(), len(learned.decode()), hashlib.sha256(learned).hexdigest(), len(text)), strict=True):
            c.append(x)
    types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def digests(formatted: DataFrame) -> DataFrame:
    """What reading the formatted conversations back gives, digested."""
    back = F.arrow_udf(_read_back, "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    out = formatted.withColumn("r", back("formatted", "loss_from", "loss_to"))
    return out.select("conv_id", "r.n_turns", "r.turns_sha256", "r.loss_chars", "r.loss_sha256", "r.formatted_chars")


#: The control strings of a common template, as texts.
PROBE = "</s>[INST] ok [/INST]"


def query(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return digests(format_conversations(turns.unionByName(probe)))
