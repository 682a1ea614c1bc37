"""Token ids in length-delimited binary records, with masked checksums and an offset index beside each file.

A record file begins with MAGIC and the width of an id in bytes; each record is

    length of the data (8 bytes) | masked CRC-32 of those 8 bytes | data | masked CRC-32 of the data

little-endian throughout, the data being the ids of one document. The mask rotates a checksum by 15 bits and adds a constant, so
that checksums of data that holds checksums stay sound. The index is an Arrow file with doc_id, offset (of the record) and
n_tokens, for reads in any order. Files follow each other in ascending doc_id order (nulls first, equal ids by text).

Tasks write under a name of their own attempt; only names that successful tasks return get into the manifest, so a lost
executor leaves no half-written file in it, and files of a folder that aren't in the manifest are deleted at the end.

Rows are dealt by ranges of the id and the text's beginning, so that rows of one id needn't be in one file. Workers write and read through
Arrow's file systems (file, hdfs, s3 and s3a, gs, abfs); another scheme is refused before a job runs.

A null text is an empty one; its record holds the end id alone. An empty table gives no files and no rows.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import filesystem, parts, temporary, written
from .units import Remembered

MAGIC = b"LTOKREC1"
END_ID = 2
_MASK = 0xA282EAD8
READ_BYTES = 8 << 20
#: Of a text, what its range goes by, beside its id.
RANGE_CHARS = 64


def masked_crc(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + _MASK) & 0xFFFFFFFF


def framed(data: bytes) -> bytes:
    length = struct.pack("<Q", len(data))
    return b"".join((length, struct.pack("<I", masked_crc(length)), data, struct.pack("<I", masked_crc(data))))


def _byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else the next one from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Encoder:
    """encode() of the tokenizers library for many texts, as bytes of ids.

    The byte-level pattern never joins what stands on the two sides of a single space between two characters that aren't white
    space, so each such piece is encoded once by the library and remembered. A text with other white space around a space goes
    to the library whole. Pieces of Latin letters with at most some ASCII marks after them are cut here, as the pattern does,
    and go to the library's BPE model directly; all others go through its whole encode().
    """

    PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-&(-/:-@]*)")

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.spelling = {b: c for b, c in enumerate(_byte_letters())}
        self.rest, self.pieces = Remembered(self._after_space, 1_000_000), {"": b""}

    def _ids(self, texts: list[str]) -> Iterator[bytes]:
        for e in self.library.encode_batch(texts, add_special_tokens=False):
            yield np.array(e.ids, dtype=self.dtype).tobytes()

    def _piece(self, piece: str) -> bytes:
        """Of one run of the pattern, by the library's model."""
        if (ids := self.pieces.get(piece)) is None:
            shown = piece if piece.isascii() and piece != "\n" else piece.encode().decode("latin-1").translate(self.spelling)
            if len(self.pieces) > self.rest.limit:
                self.pieces.clear()
            ids = self.pieces[piece] = array(self.code, [t.id for t in self.library.model.tokenize(shown.replace(" ", "\u0120"))]).tobytes()
        return ids

    def _after_space(self, units: list[str]) -> list[bytes | None]:
        """None for what can't be encoded apart."""
        out: list[bytes | None] = []
        odd: list[int] = []
        for u in units:
            if found := self.PLAIN.fullmatch(u):
                word, marks = found.groups()
                out.append(self._piece(" " + word) + self._piece(marks) if marks else self._piece(" " + word))
            elif "\n" in u and all(lines := [self.PLAIN.fullmatch(x) for x in u.split("\n")]):
                # single line ends between words are runs of their own
                ids = [self._piece(" " + lines[0][1]), self._piece(lines[0][2])]
                for line in lines[1:]:
                    ids += (self._piece("\n"), self._piece(line[1]), self._piece(line[2]))
                out.append(b"".join(ids))
            else:
                if u and not u[0].isspace() and not u[-1].isspace():
                    odd.append(len(out))
                out.append(None)
        for i, ids in zip(odd, self._ids([" " + units[i] for i in odd]), strict=True):
            out[i] = ids
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [t.split(" ") for t in texts]
        self.rest.learn(cut)
        known, out, odd = self.rest.values.__getitem__, [], []
        for i, c in enumerate(cut):
            first = c[0]
            try:
                if not first or first[0].isspace() or first[-1].isspace():
                    raise TypeError
                out.append(b"".join(map(known, c[1:])))
            except TypeError:  # a None
                odd.append(i)
                out.append(b"")
        for i, ids in zip(odd, self._ids([texts[i] for i in odd]), strict=True):
            out[i] = ids
        plain = sorted(set(range(len(texts))).difference(odd))
        for i, ids in zip(plain, self._ids([cut[i][0] for i in plain]), strict=True):
            out[i] = ids + out[i]
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


_FILES = "part int, records string, index string, n_docs long, n_tokens long"


def _writer(path: str, folder: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        part = TaskContext.get().partitionId()
        store, base = filesystem(folder)
        store.create_dir(base, recursive=True)
        name = f"{base}/part-{part:06d}-{uuid.uuid4().hex}"
        ids, offsets, counts, at = [], [], [], len(MAGIC) + 4
        out = None
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for i in range(0, len(texts), 256):
                if out is None:
                    out = store.open_output_stream(f"{name}.rec", buffer_size=1 << 20)
                    out.write(MAGIC + struct.pack("<I", enc.dtype.itemsize))
                for data in enc.encode(texts[i : i + 256]):
                    record = framed(data + end)
                    out.write(record)
                    offsets.append(at)
                    counts.append(len(data) // enc.dtype.itemsize + 1)
                    at += len(record)
            ids.append(batch.column(0).cast(pa.int64()))
        if out is None:
            return
        out.close()
        table = pa.table({"doc_id": pa.chunked_array(ids, pa.int64()), "offset": pa.array(offsets, pa.int64()), "n_tokens": pa.array(counts, pa.int64())})
        with store.open_output_stream(f"{name}.idx") as f, pa.ipc.new_file(f, table.schema) as w:
            w.write_table(table)
        yield pa.RecordBatch.from_pylist([{"part": part, "records": f"{name}.rec", "index": f"{name}.idx", "n_docs": len(counts), "n_tokens": int(sum(counts))}], schema=pa.schema([("part", pa.int32()), ("records", pa.string()), ("index", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    return run


def _sweep(store, base: str, kept: set[str]) -> None:
    """Deletes what attempts that didn't succeed have left in a folder that this call writes alone."""
    from pyarrow import fs

    names = {k.rsplit("/", 1)[-1] for k in kept}
    for f in store.get_file_info(fs.FileSelector(base, allow_not_found=True)):
        if f.base_name.startswith("part-") and f.base_name not in names:
            store.delete_file(f.path)


def write_records(docs: DataFrame, path: str, folder: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Writes the files; returns the manifest: a row per file, with the ids before it as start. path: the tokenizer's file. Without a folder, the files go when the process ends."""
    spark = docs.sparkSession
    folder = folder or temporary(spark, "records")
    store, base = filesystem(folder)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = own.repartitionByRange(parts(spark), F.col("doc_id"), F.substring("text", 1, RANGE_CHARS)).sortWithinPartitions("doc_id", "text")
    files = written(dealt.mapInArrow(_writer(path, folder, end_id), _FILES), "manifest").orderBy("part").collect()  # a row per file
    _sweep(store, base, {f[c] for f in files for c in ("records", "index")})
    start, rows = 0, []
    for f in files:
        rows.append((folder, f["part"], f["records"], f["index"], f["n_docs"], f["n_tokens"], start))
        start += f["n_tokens"]
    return spark.createDataFrame(rows, "folder string, part int, records string, index string, n_docs long, n_tokens long, start long")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for f in batch.to_pylist():
            store, _ = filesystem(f["folder"])
            with store.open_input_file(f["index"]) as src:
                index = pa.ipc.open_file(src).read_all()
            offset, count = index["offset"].to_numpy(), index["n_tokens"].to_numpy()
            with store.open_input_file(f["records"]) as src:
                head = src.read(len(MAGIC) + 4)
                if head[: len(MAGIC)] != MAGIC:
                    raise ValueError(f"{f['records']} is no record file")
                width = struct.unpack("<I", head[len(MAGIC) :])[0]
                size = count * width + 16
                start = f["start"] + np.cumsum(count) - count
                i = 0
                while i < len(offset):
                    j = max(i + 1, int(np.searchsorted(offset, offset[i] + READ_BYTES)))
                    src.seek(int(offset[i]))
                    block = src.read(int(offset[j - 1] + size[j - 1] - offset[i]))
                    crc = []
                    for k in range(i, j):
                        a = int(offset[k] - offset[i])
                        length, check = struct.unpack_from("<QI", block, a)
                        data = block[a + 12 : a + 12 + length]
                        if check != masked_crc(block[a : a + 8]) or length != count[k] * width or struct.unpack_from("<I", block, a + 12 + length)[0] != masked_crc(data):
                            raise ValueError(f"{f['records']}: damaged record at {offset[k]}")
                        crc.append(zlib.crc32(np.frombuffer(data, dtype=f"<u{width}").astype("<u4").tobytes()))
                    own = index.slice(i, j - i).combine_chunks()
                    yield pa.RecordBatch.from_arrays([own["doc_id"].combine_chunks(), pa.array(start[i:j], pa.int64()), pa.array(count[i:j], pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                    i = j


def read_records(manifest: DataFrame) -> DataFrame:
    """A row per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    files = max(1, manifest.count())
    return manifest.repartition(files).mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_records(write_records(docs, public_tokenizers.path("byte_bpe_50k.json")))
