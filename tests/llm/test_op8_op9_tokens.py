import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from ledgerline.llm import op8_records as rec
from ledgerline.llm import op9_sentencepiece as piece

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  a", " a  b ", "a\n b", "q ab.\nCd, é!\nf g", "q ab\n\nCd", "x  \n\n y", "<|endoftext|> hi<|endoftext|>", "▁a ▁ b", "日本語 テスト", "\x00 a", "é" * 300, "a" * 500 + " b", "\t\tq  z", "1234 56 7", "don't I'll  we", "🎉🎉 x", "<s> </s> <unk> <0x41>", "²½ Ⅷ x", "  y \x1c z", "a\r\n", "ab" * 200, "x! ?y (z) a.b. c"]
ODD += ["".join(random.Random(i).choice("ab éñ▁\n  .,1x🎉日'") for _ in range(i % 60)) for i in range(600)]


def test_encoder_equals_the_library():
    enc = rec.encoder(BYTES)
    for text, ids in zip(ODD, enc.encode(ODD), strict=True):
        assert np.frombuffer(ids, enc.dtype).tolist() == enc.library.encode(text, add_special_tokens=False).ids, text


def test_pieces_equal_the_library_and_decode():
    enc = piece.piece_encoder(PIECES)
    for text, ids in zip(ODD, enc.encode(ODD), strict=True):
        want = enc.library.encode(text)
        assert ids == want, text
        assert enc.digits(ids).decode() == ",".join(map(str, want))
        assert enc.decode(ids) == (enc.library.decode(want) if want else "")


@pytest.mark.parametrize("letters", ["abcdeés", "日本語のテスト中文字符", "ab日é本▁", "01.,", "a"])
def test_texts_without_spaces(letters, monkeypatch):
    enc = piece.PieceEncoder(PIECES)
    text = "".join(random.Random(3).choice(letters) for _ in range(20_000))
    want = enc.library.encode(text)
    assert enc.encode([text])[0] == want
    monkeypatch.setattr(piece, "LONG", 40_000)  # rounds to the end
    short = text[:3000]
    assert piece.PieceEncoder(PIECES).encode([short])[0] == enc.library.encode(short)
    enc.encode(["next"])
    assert max(map(len, enc.ids.values)) < 1000  # long units are forgotten


def test_long_runs_are_rare(monkeypatch):
    """Writing without spaces is cut where no piece joins two characters, so whole texts don't leave the rounds."""
    enc = piece.PieceEncoder(PIECES)
    monkeypatch.setattr(enc, "_queue", lambda sym: pytest.fail("a queue"))
    text = "".join(chr(random.Random(4).randrange(0x4E00, 0x9FFF)) for _ in range(5000)) + "".join(chr(0x3041 + i * 7 % 80) for i in range(5000))
    assert enc.encode([text])[0] == enc.library.encode(text)


def real_texts():
    import os

    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data here")
    import pyarrow.parquet as pq

    return [t or "" for t in pq.read_table(path, columns=["text"])["text"].to_pylist()]


def test_whole_documents_in_all_languages():
    texts = real_texts()
    pieces, tokens = piece.piece_encoder(PIECES), rec.encoder(BYTES)
    assert pieces.encode(texts) == [pieces.library.encode(t) if t else [] for t in texts]
    want = tokens.library.encode_batch(texts, add_special_tokens=False)
    assert all(np.frombuffer(ids, tokens.dtype).tolist() == w.ids for ids, w in zip(tokens.encode(texts), want, strict=True))


def test_letters_of_many_scripts():
    rng = random.Random(6)
    ranges = [(0x20, 0x7F), (0xA0, 0x250), (0x250, 0x700), (0x900, 0xA00), (0xE00, 0xE60), (0x1E00, 0x2100), (0x2000, 0x2070), (0x3000, 0x3100), (0x4E00, 0x4F00), (0xAC00, 0xAD00), (0x1F300, 0x1F650)]
    texts = ["".join(chr(rng.randrange(*rng.choice(ranges[: rng.randint(1, len(ranges))]))) if rng.random() < 0.8 else rng.choice("  \n\t") for _ in range(rng.randrange(120))) for _ in range(3000)]
    pieces, tokens = piece.piece_encoder(PIECES), rec.encoder(BYTES)
    for t, ids, data in zip(texts, pieces.encode(texts), tokens.encode(texts), strict=True):
        assert ids == pieces.library.encode(t), t
        assert np.frombuffer(data, tokens.dtype).tolist() == tokens.library.encode(t, add_special_tokens=False).ids, t


def test_memory_of_units_is_bounded():
    enc = rec.Encoder(BYTES)
    enc.rest.limit = 5
    texts = [f"a w{i} b{i}" for i in range(50)]
    for t in texts:
        assert np.frombuffer(enc.encode([t])[0], enc.dtype).tolist() == enc.library.encode(t, add_special_tokens=False).ids
        assert len(enc.rest.values) <= 5 + 3


def test_records_round_trip(spark, docs):
    rows = [(i * 7 % 50, t) for i, t in enumerate(ODD[:50])] + [(None, "null id"), (3, ODD[5]), (4, None)]
    library = rec.encoder(BYTES).library
    got = rec.read_records(rec.write_records(docs(rows), BYTES)).collect()
    want, start = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_record_files_are_checked(spark, docs, tmp_path):
    manifest = rec.write_records(docs(["some text here"]), BYTES, f"file://{tmp_path}/r")
    path = next(p for p in (tmp_path / "r").iterdir() if p.suffix == ".rec")
    data = bytearray(path.read_bytes())
    data[-6] ^= 1
    path.write_bytes(data)
    with pytest.raises(Exception, match="damaged record"):
        rec.read_records(manifest).collect()


def test_one_id_needs_no_single_file(spark, docs):
    rows = [(7, f"text {i % 50} of {i}") for i in range(400)] + [(i, "x") for i in range(5)]
    manifest = rec.write_records(docs(rows), BYTES)
    assert manifest.where("n_docs < 300").count() == manifest.count() > 1
    got = sorted(rec.read_records(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(d for d, _ in rows) and got[-1].start + got[-1].n_tokens == manifest.selectExpr("sum(n_tokens)").first()[0]


def test_files_of_failed_attempts_go(spark, docs, tmp_path):
    (tmp_path / "part-000000-dead.rec").write_bytes(b"half")
    (tmp_path / "notes.txt").write_bytes(b"mine")
    rec.write_records(docs(["a b"]), BYTES, f"file://{tmp_path}")
    assert sorted(p.name[:5] for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["notes", "part-", "part-"]


def test_schemes_that_workers_cannot_open_are_refused_first(docs):
    with pytest.raises(ValueError, match="no file system for wasbs://"):
        rec.write_records(docs(["a"]), BYTES, "wasbs://x@y/z")


def test_empty_tables(docs):
    assert rec.read_records(rec.write_records(docs([]), BYTES)).count() == 0
    assert piece.with_digests(docs([]), PIECES).count() == 0


def test_digests_and_ids(docs):
    enc = piece.piece_encoder(PIECES).library
    rows = [(1, "Hello  wörld"), (2, None), (None, ""), (1, "Hello  wörld")]
    out = piece.decoded(piece.with_ids(piece.with_digests(docs(rows), PIECES), PIECES), PIECES).collect()
    for r, (d, t) in zip(sorted(out, key=lambda r: str(r.doc_id)), sorted(rows, key=lambda r: str(r[0])), strict=True):
        ids = enc.encode(t or "")
        assert (r.doc_id, r.piece_ids, r.decoded) == (d, ids, enc.decode(ids) if ids else "")
        assert r.pieces.n_tokens == len(ids) and r.pieces.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.pieces.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_idle_workers_keep_no_encoder(spark):
    """A Python worker outlives its task; the next stages' workers stand beside it."""
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(400)], "doc_id long, text string").repartition(16)
    out = piece.with_digests(docs, PIECES, "p", ids=True).select("text", "p.ids").collect()
    enc = piece.PieceEncoder(PIECES)
    assert len(out) == 400 and all(r["ids"] == enc.library.encode(r["text"]) for r in out)

    def kept(batches):
        import pyarrow as pa

        from ledgerline.llm import op9_sentencepiece as own

        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [len(own._encoders)] * b.num_rows})

    assert {r["n"] for r in docs.select("doc_id").mapInArrow(kept, "n long").collect()} == {0}
