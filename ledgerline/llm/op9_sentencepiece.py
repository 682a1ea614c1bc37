"""SentencePiece BPE encoding by vectorised merge rounds, and decoding.

A text is normalised as the model's identity normaliser does: a space stands for U+2581, and one is set before the text. No piece
holds U+2581 after another character, so no merge crosses from a word into the next one's mark: each word with its marks is
encoded apart, and once for all its occurrences.

A word is cut further wherever its two neighbouring characters stand side by side in no piece, as no merge crosses there: what is
left are runs, most of one character in writing without spaces that the model hardly knows.

New words' symbols lie in one flat array. In each round, every run's least pair rank is found, the leftmost pair of that rank in
each run is merged, for all runs at once, and the array is compacted; runs without a pair of the vocabulary leave it. One
merge of a run per round keeps the order of the library's queue, where a merge can make a better pair than the next occurrence
of the same one. A run of over LONG symbols, each two of them side by side in some piece, would set the number of rounds by itself: its
merges go through a queue.

A null text is an empty one: no ids, empty decoded text.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .units import Remembered
from .workers import giving_back

MARK = "▁"
#: Symbols of a run that is merged in rounds.
LONG = 1024
#: Symbol of a character that is no piece: this and its code point.
_OTHER = 1 << 20
#: Words remembered by one Python worker.
REMEMBERED_WORDS = 250_000
_NONE = np.iinfo(np.int64).max


class PieceEncoder:
    """encode() and decode() of one model file (BPE, identity normaliser, dummy prefix, byte fallback)."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        pieces = {sp.id_to_piece(i): i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        self.symbol_of = np.arange(0x110000, dtype=np.int64) + _OTHER
        for p, i in pieces.items():
            if len(p) == 1:
                self.symbol_of[ord(p)] = i
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("pieces with a mark after another character aren't supported")

        def symbol(p: str) -> int | None:
            return int(self.symbol_of[ord(p)]) if len(p) == 1 else pieces.get(p)

        rank = {i: r for r, i in enumerate(sorted(pieces.values(), key=lambda i: -sp.get_score(i)))}
        found = sorted({(a << 32 | b, rank[i], i) for p, i in pieces.items() for k in range(1, len(p)) if (a := symbol(p[:k])) is not None and (b := symbol(p[k:])) is not None})
        self.pairs, self.ranks, self.merged = (np.array(x, dtype=np.int64) for x in zip(*found, strict=True))
        self.lookup = {k: (r, i) for k, r, i in found}
        beside = {ord(x) << 32 | ord(y) for p in pieces for x, y in zip(p, p[1:])}
        self.beside = np.array(sorted(beside), dtype=np.int64)
        self.ids = Remembered(self._encode_words, REMEMBERED_WORDS)
        self.written = [b"%d," % i for i in range(size)]

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index of each pair in pairs, or -1."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, at, -1)

    def _queue(self, sym: list[int]) -> list[int]:
        """The merges of one long word, by a queue of (rank, place)."""
        n = len(sym)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        queue: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (x := self.lookup.get(sym[i] << 32 | sym[j])):
                heapq.heappush(queue, (x[0], i, sym[i], sym[j]))

        for i in range(n):
            offer(i)
        while queue:
            _, i, a, b = heapq.heappop(queue)
            if not alive[i] or sym[i] != a or (j := after[i]) >= n or sym[j] != b:
                continue
            sym[i] = self.lookup[a << 32 | b][1]
            alive[j] = False
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [s for s, ok in zip(sym, alive, strict=True) if ok]

    def _symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols of all words in order, and how many each has."""
        length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        sym, of = self.symbol_of[chars], np.repeat(np.arange(len(words)), length)
        key = chars[:-1] << 32 | chars[1:]
        at = np.minimum(np.searchsorted(self.beside, key), len(self.beside) - 1)
        begin = np.flatnonzero(np.append(True, (self.beside[at] != key) | (of[1:] != of[:-1])))
        length, word_of = np.diff(np.append(begin, len(chars))), of[begin]  # of runs
        word = np.repeat(np.arange(len(begin)), length)
        done_word, done_sym = [], []
        if (length > LONG).any():
            for w in np.flatnonzero(length > LONG):
                out = self._queue(sym[begin[w] : begin[w] + length[w]].tolist())
                done_sym.append(np.array(out, dtype=np.int64))
                done_word.append(np.full(len(out), w))
            short = length[word] <= LONG
            sym, word = sym[short], word[short]
        pair = self._pair(sym[:-1], sym[1:])
        while len(sym) > 1:
            score = np.where((pair >= 0) & (word[:-1] == word[1:]), self.ranks[pair], _NONE)
            begin = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            place = np.append(np.where(score == _NONE, _NONE, score << 32 | np.arange(len(score))), _NONE)
            least = np.minimum.reduceat(place, begin)  # a word's last place has no pair in the word: none
            active = least != _NONE
            at = (least[active] & 0xFFFFFFFF).astype(np.int64)
            if not len(at):
                break
            sym[at] = self.merged[pair[at]]
            keep = np.ones(len(sym), dtype=bool)
            keep[at + 1] = False
            ended = np.repeat(~active, np.diff(np.append(begin, len(sym))))
            if ended.any():
                done_sym.append(sym[ended])
                done_word.append(word[ended])
                keep &= ~ended
            moved = np.cumsum(keep) - 1
            changed = moved[at]
            pair = np.append(pair, -1)[keep][:-1]
            sym, word = sym[keep], word[keep]
            if not len(sym):
                break
            near = np.unique(np.concatenate((changed, changed - 1)))
            near = near[(near >= 0) & (near < len(sym) - 1)]
            pair[near] = self._pair(sym[near], sym[near + 1])
            if ended.any():  # neighbours are new wherever words between have gone
                pair[word[:-1] != word[1:]] = -1
        done_sym.append(sym)
        done_word.append(word)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word_of[word], minlength=len(words))

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word, its first mark left out, as 32-bit numbers."""
        sym, count = self._symbols([MARK + w for w in words])
        out, end = [], np.cumsum(count)
        other = np.flatnonzero(sym >= _OTHER)
        if len(other):  # bytes instead
            spelt = [self.byte_ids[list(chr(int(c) - _OTHER).encode("utf-8", "surrogatepass"))] for c in sym[other]]
            many = np.ones(len(sym), dtype=np.int64)
            many[other] = [len(x) for x in spelt]
            flat = np.repeat(sym, many)
            first = np.cumsum(many) - many
            for o, x in zip(first[other], spelt, strict=True):
                flat[o : o + len(x)] = x
            end, sym = np.cumsum(many)[end - 1], flat
        data, at = sym.astype("<u4").tobytes(), 0
        for e in (end * 4).tolist():
            out.append(data[at:e])
            at = e
        return out

    def _words(self, text: str) -> list[str]:
        if not text:
            return []
        cut = text.split(" ")
        if "" in cut or MARK in text:
            return [w[1:] for w in re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK))]
        return cut

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text."""
        cut = [self._words(t) for t in texts]
        self.ids.learn(cut)
        known = self.ids.values.__getitem__
        return [np.frombuffer(b"".join(map(known, c)), dtype="<u4").tolist() for c in cut]

    def digits(self, ids: list[int]) -> bytes:
        """The ids in decimal, with commas between."""
        return b"".join([self.written[i] for i in ids])[:-1]

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids) if ids else ""


_encoders: dict[str, PieceEncoder] = {}


def piece_encoder(path: str) -> PieceEncoder:
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def forget_encoders() -> None:
    """Encoders, and the words that they remember, go; a function of the module, so that workers clear their own table."""
    _encoders.clear()


def _over_task(run: Callable[[pa.Array], pa.Array]) -> Callable[[Iterator], Iterator]:
    """run for each batch of a task; the encoders go at its end."""
    return giving_back(lambda cols: map(run, cols), forget_encoders)


_DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digests(path: str, with_ids: bool):
    def run(col: pa.Array) -> pa.Array:
        enc = piece_encoder(path)
        n, ids_sha, text_sha, kept = [], [], [], []
        for i in range(0, len(col), 256):
            for ids in enc.encode([t or "" for t in col.slice(i, 256).to_pylist()]):
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(enc.digits(ids)).hexdigest())
                text_sha.append(hashlib.sha256(enc.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
                if with_ids:
                    kept.append(np.array(ids, dtype=np.int32))
        columns = {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())}
        if with_ids:
            columns["ids"] = pa.array(kept, pa.list_(pa.int32()))
        return pa.StructArray.from_arrays(list(columns.values()), names=list(columns))

    return run


def with_ids(docs: DataFrame, path: str, name: str = "piece_ids", text: str = "text") -> DataFrame:
    """docs with an array<int> column of ids."""

    def run(col: pa.Array) -> pa.Array:
        enc, out = piece_encoder(path), []
        for i in range(0, len(col), 256):
            out += [np.array(ids, dtype=np.int32) for ids in enc.encode([t or "" for t in col.slice(i, 256).to_pylist()])]
        return pa.array(out, pa.list_(pa.int32()))

    return docs.withColumn(name, F.arrow_udf(_over_task(run), "array<int>")(F.col(f"`{text}`")))


def decoded(docs: DataFrame, path: str, ids: str = "piece_ids", name: str = "decoded") -> DataFrame:
    """docs with the text of an array<int> column of ids; a null array is an empty one."""

    def run(col: pa.Array) -> pa.Array:
        enc = piece_encoder(path)
        return pa.array([enc.library.decode(x) if x else "" for x in col.to_pylist()], pa.string())

    return docs.withColumn(name, F.arrow_udf(_over_task(run), "string")(F.col(f"`{ids}`")))


def with_digests(docs: DataFrame, path: str, name: str = "pieces", text: str = "text", ids: bool = False) -> DataFrame:
    """docs with a struct column called name: n_tokens, ids_sha256 and decoded_sha256 of the ids and of what they decode to, and the ids if asked for."""
    return docs.withColumn(name, F.arrow_udf(_over_task(_digests(path, ids)), _DIGEST + ", ids array<int>" * ids)(F.col(f"`{text}`")))


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return with_digests(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "pieces.n_tokens", "pieces.ids_sha256", "pieces.decoded_sha256")
