"""N-gram Jaccard join by parity sketches.

A document's set of word shingles is hashed to 64-bit tokens. Each token flips one bit of a sketch; a token in both of two sets
cancels itself, so the Hamming distance of two sketches is at most the size of the sets' symmetric difference. A pair of a
Jaccard similarity of t differs in at most d = (1 - t) / (1 + t) * (|A| + |B|) tokens.

Candidates. Sizes fall in bands; a document is in its own band, and in each larger one that a similar set may be in. With d taken at the
band's upper end, tokens are dealt over d + 1 + e chunks by their hash; at least 1 + e chunks of a similar pair hold the same
tokens (pigeonhole), so the XOR of a chunk's tokens is a join key. Chunks of few tokens are common values and never keys: a document
with no more than e of them leaves those out, and then chunks from the end, until e are left out, and has d + 1 keys. Of the 1 + e, a
similar pair's documents leave out the same short ones and others from the same end, so that one is in both. A document with more than e
short chunks deals its tokens anew by another
hash, and so on until it has no more than e; if all chunks that a pair shares have few tokens, both documents go on, so no
pair of similar sets is lost. Sets that only their equals are similar to have no keys at all.

Copies. Equal sets are one class, joined once. Of keys that several classes share, a group's sketches are compared in blocks of
bounded size, and only a forest of the pairs within reach is passed on, not all pairs. Passed pairs are verified exactly on the
documents' token sets, and links are contracted to components. Where a tree of the forests holds several components, its members
are compared once more in blocks, each with its token set, and verified on the spot: only links that join two components are
passed on, so a family of near misses gives no rows. The components are then those of all links.

Rows with the same doc_id are documents of their own. Null and empty texts have empty sets and are linked with nothing; the
component of such a row, and of a document without links, is its own doc_id. A null doc_id counts as no id: its row gets the
smallest id of its component, or null. Tokens are 64-bit hashes of words' hashes; sets are compared as sets of tokens, so two
shingles of one hash count as equal: among n different shingles, with a probability of about n^2 / 2^65.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import count
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import BROADCAST_ROWS, discard, parts, small, written
from .wordhash import SPACE_SPLIT, chunks, mix, shingle_set, text_buffers, words
from .workers import giving_back

U = np.uint64
SHINGLE = 3
#: Similarity in hundredths.
SIMILARITY = 90
#: A band's sizes reach to this times the last band's.
BAND = 1.6
#: Bits of a sketch for each token that similar sets may differ in, and its words of 64 bits at most. A coarser sketch passes on more pairs to be verified, and loses none.
SKETCH_BITS = 8
SKETCH_WORDS = 64
#: Documents of a group that are compared with each other in one go, and their tokens where those are held; larger groups are dealt over pairs of blocks.
BLOCK = 1024
BLOCK_TOKENS = 1 << 20
#: Deals after which chunks of one token are keys too: a bound on the time that a very small set may take.
STRICT_DEALS = 8
#: Far more than any set needs: of the smallest sets of a band, one in about 40 needs another deal.
MOST_DEALS = 200
#: Of Arrow batches that hold token sets.
BATCH_BYTES = 64 << 20


@lru_cache
def bands(similarity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Of each band: its largest size, the chunks, how many of them may be left out, the sketch words (of 64 bits), and whether its least sets have too few tokens for chunks; the tokens up to which a chunk is weak."""
    t = similarity / 100
    weak = 1 if t >= 0.85 else 0
    hi = [1]
    while hi[-1] < 1 << 40:
        hi.append(max(hi[-1] + 1, ceil(hi[-1] * BAND)))
    size = np.array(hi)
    d = (100 - similarity) * 2 * size // (100 + similarity)
    least = np.ceil(t * (np.append(0, size[:-1]) + 1))  # of the sets in a band, those of the band below among them
    spare = np.full(len(size), 2)
    for _ in range(16):  # short chunks of the smallest sets, and two standard deviations more, with as many chunks as that makes
        k = d + 1 + spare
        mean = least / k
        short = np.exp(-mean) * (1 + mean * weak) * k
        spare = np.minimum(2 + np.ceil(short + 2 * np.sqrt(short)), 2 + d * (1 if t >= 0.75 else 3)).astype(np.int64)
    width = np.clip(d * SKETCH_BITS // 64, 2, SKETCH_WORDS)
    width = 1 << np.ceil(np.log2(width)).astype(np.int64)
    return size, d + 1 + spare, spare, width, least <= d, weak


def sketch(tokens: np.ndarray, width: int) -> np.ndarray:
    """width words of 64 bits: the parity of the tokens that hash to each bit. A wider one folds to a narrower one by XOR."""
    bit = (tokens & U(width * 64 - 1)).astype(np.int64)
    odd = np.bincount(bit, minlength=width * 64).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(U)


def keys(tokens: np.ndarray, similarity: int) -> np.ndarray:
    """Join keys of a set, over its bands."""
    size, n_chunks, spare, _, few, weak = bands(similarity)
    n = len(tokens)
    if n * 100 < similarity * (n + 1):  # one token less or more is too many
        return np.zeros(0, dtype=U)
    own = int(np.searchsorted(size, n))
    out = []
    for band in count(own):
        if band > own and n * 100 < similarity * (int(size[band - 1]) + 1):
            break  # no similar set is as large as this band's
        if few[band]:  # at a similarity of a half, say, sets of one and two tokens: similar ones share one
            out.append(mix(tokens ^ mix(np.full(n, band + 1, dtype=U))))
            continue
        k, deal = int(n_chunks[band]), 0
        while True:
            chunk = (((mix(tokens + U(deal)) if deal else tokens) >> U(32)) % U(k)).astype(np.int64)
            order = np.argsort(chunk, kind="stable")
            begin = np.flatnonzero(np.diff(chunk[order], prepend=-1))
            strong = np.diff(np.append(begin, n)) > (weak if deal < STRICT_DEALS else 0)
            number, value = chunk[order][begin][strong].astype(U), np.bitwise_xor.reduceat(tokens[order], begin)[strong]
            last = k - len(number) <= spare[band]
            some = slice(k - int(spare[band]) if last else None)  # the first d + 1
            out.append(mix(value[some] ^ mix(number[some] * U(0x10000) + U(deal % 256 * 256) + U(band) + U(1))))
            if last:
                break
            deal += 1
            if deal == MOST_DEALS:
                raise RuntimeError(f"{n} tokens in {k} chunks: too few in most, {deal} times")
    return np.concatenate(out)


def signature(tokens: np.ndarray) -> bytes:
    """16 bytes that stand for a set."""
    a = mix(tokens)
    return int(np.add.reduce(a) + U(len(a))).to_bytes(8, "big") + int(np.bitwise_xor.reduce(mix(a ^ U(0x5851F42D4C957F2D)))).to_bytes(8, "big")


def token_sets(col: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    data, off = text_buffers(col)
    for lo, hi in chunks(data, off):
        h, at = words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], SPACE_SPLIT)
        for i in range(hi - lo):
            yield shingle_set(h[at[i] : at[i + 1]], shingle)


def signatures(shingle: int):
    def run(col: pa.Array) -> pa.Array:
        return pa.array([signature(s) if len(s) else None for s in token_sets(col, shingle)], pa.binary())

    return F.arrow_udf(run, "binary")


_SKETCHED = "n long, sig binary, keys array<long>, bits binary"


def _sketched(shingle: int, similarity: int):
    def run(col: pa.Array) -> pa.Array:
        n, sig, key, ends, bits = [], [], [], [0], []
        width = bands(similarity)[3]
        size = bands(similarity)[0]
        for s in token_sets(col, shingle):
            n.append(len(s))
            if len(s):
                sig.append(signature(s))
                key.append(keys(s, similarity).view(np.int64))
                ends.append(ends[-1] + len(key[-1]))
                bits.append(sketch(s, int(width[np.searchsorted(size, len(s))])).tobytes())
            else:
                sig.append(None)
                ends.append(ends[-1])
                bits.append(None)
        flat = pa.array(np.concatenate(key) if key else np.zeros(0, np.int64), pa.int64())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat), pa.array(bits, pa.binary())], names=["n", "sig", "keys", "bits"])

    return F.arrow_udf(giving_back(lambda cols: map(run, cols)), _SKETCHED)


def _within(n1: np.ndarray, n2: np.ndarray, distance: np.ndarray, similarity: int) -> np.ndarray:
    """True where a symmetric difference of that distance still lets sets of these sizes be similar."""
    return distance * (100 + similarity) <= (100 - similarity) * (n1 + n2)


def _matrix(bits: list[bytes]) -> np.ndarray:
    """Sketches of one group, folded to the narrowest."""
    rows = [np.frombuffer(b, dtype=U) for b in bits]
    width = min(map(len, rows))
    out = np.empty((len(rows), width), dtype=U)
    for i, r in enumerate(rows):
        out[i] = np.bitwise_xor.reduce(r.reshape(-1, width), axis=0) if len(r) > width else r
    return out


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by their first column, a number, as tables that end where a group does."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        g = batch.column(0).to_numpy()
        changes = np.flatnonzero(g[1:] != g[:-1])
        cut = int(changes[-1]) + 1 if len(changes) else 0
        if cut or (held and held[-1].column(0)[0].as_py() != g[-1]):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _spans(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    begin = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
    return begin, np.diff(np.append(begin, len(g)))


def _forest(uid: np.ndarray, n: np.ndarray, bits: list[bytes], side: np.ndarray, similarity: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of a group's pairs within reach; side: 0 to pair with all, else 1 with 2."""
    m = _matrix(bits)
    label = np.arange(len(uid))
    for i in range(1, len(uid)):
        other = label[:i] != label[i]
        if side[i]:
            other &= side[:i] != side[i]
        at = np.flatnonzero(other)
        near = at[_within(n[at], n[i], np.bitwise_count(m[at] ^ m[i]).sum(axis=1, dtype=np.int64), similarity)]
        if len(near):
            lab, first = np.unique(label[near], return_index=True)
            near = near[first]
            label[np.isin(label, lab)] = label[i]
            yield np.minimum(uid[near], uid[i]), np.maximum(uid[near], uid[i])


def _pairs(similarity: int):
    """Over rows sorted by group: g, uid, n, bits, side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches):
            g, uid, n, side = (t[c].to_numpy() for c in ("g", "uid", "n", "side"))
            bits = t["bits"]
            begin, size = _spans(g)
            left, right = [], []
            two = begin[size == 2]
            for i in two[(side[two] == 0) | (side[two] != side[two + 1])].tolist():
                m = _matrix([bits[i].as_py(), bits[i + 1].as_py()])
                if int(np.bitwise_count(m[0] ^ m[1]).sum()) * (100 + similarity) <= (100 - similarity) * int(n[i] + n[i + 1]):
                    left.append(np.sort(uid[i : i + 2])[:1])
                    right.append(np.sort(uid[i : i + 2])[1:])
            for a, s in zip(begin[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                own = slice(a, a + s)
                for x, y in _forest(uid[own], n[own], bits[own].to_pylist(), side[own], similarity):
                    left.append(x)
                    right.append(y)
            if left:
                a, b = np.unique(np.stack((np.concatenate(left), np.concatenate(right))), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def _dealt(rows: DataFrame, group: str, blocks: Column) -> DataFrame:
    """rows with g and side: a row stands in every pair of blocks of its group that has its own block."""
    own = F.pmod(F.xxhash64("uid"), blocks)
    # all pairs of blocks that hold the row's own: (own, own) pairs within the block, (i, j) pairs across
    other = F.explode(F.when(blocks == 1, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    rows = rows.withColumn("blocks", blocks).withColumn("own", own).withColumn("other", other)
    g = F.when(F.col("blocks") == 1, F.col(group)).otherwise(F.xxhash64(group, F.least("own", "other"), F.greatest("own", "other")))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    return rows.withColumn("g", g).withColumn("side", side.cast("int"))


def near_pairs(members: DataFrame, classes: DataFrame, similarity: int) -> DataFrame:
    """Distinct pairs (a, b) of classes that span, key by key, those that share the key and whose sketches are within reach."""
    rows = _dealt(members, "key", F.ceil(F.col("many") / BLOCK).cast("long")).select("g", "uid", "side")
    rows = rows.join(classes.select("uid", "n", "bits"), "uid").select("g", "uid", "n", "bits", "side")
    dealt = rows.repartition(parts(members.sparkSession), "g").sortWithinPartitions("g", "uid")
    return dealt.mapInArrow(giving_back(_pairs(similarity)), "a long, b long").distinct()


def _sets_of(shingle: int):
    """Token sets of the documents that stand for classes; of several rows with a class's doc_id, only those with its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = batch.column(1).to_pylist()
            keep, out = [], []
            for i, s in enumerate(token_sets(batch.column(2), shingle)):
                if len(s) and signature(s) == sig[i]:
                    keep.append(i)
                    out.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(out, pa.binary())], names=["uid", "tokens"])

    return run


def _alike(a: np.ndarray, b: np.ndarray, similarity: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= similarity * (len(a) + len(b) - both)


def _similar(similarity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_alike(np.frombuffer(x.as_buffer(), dtype=U), np.frombuffer(y.as_buffer(), dtype=U), similarity) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def token_table(ends: DataFrame, classes: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """uid and tokens of the classes in ends (distinct uid), from the texts of the documents that stand for them."""
    wanted = written(classes.join(ends, "uid").select("uid", "sig", F.col("doc_id").alias("d")), "wanted")
    rows = docs.select("doc_id", "text").join(small(wanted), F.col("doc_id").eqNullSafe(F.col("d"))).select("uid", "sig", "text")
    out = written(rows.mapInArrow(giving_back(_sets_of(shingle)), "uid long, tokens binary").groupBy("uid").agg(F.first("tokens").alias("tokens")), "sets", "lz4")
    discard(wanted)
    return out


def _batch_rows(sets: DataFrame, of_a_row: int) -> int:
    """Rows of a batch of bounded size, by the largest set."""
    most = sets.agg(F.max(F.length("tokens"))).first()[0] or 1
    return int(min(1000, max(1, BATCH_BYTES // (most * of_a_row))))


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, shingle: int, similarity: int) -> DataFrame:
    """The pairs whose token sets are similar, compared exactly."""
    ends = pairs.select(F.col("a").alias("uid")).union(pairs.select(F.col("b").alias("uid"))).distinct()
    sets = token_table(ends, classes, docs, shingle)
    x, y = sets.select(F.col("uid").alias("a"), F.col("tokens").alias("x")), sets.select(F.col("uid").alias("b"), F.col("tokens").alias("y"))
    both = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")
    out = written(both.mapInArrow(giving_back(_similar(similarity)), "a long, b long"), "links", batch_rows=_batch_rows(sets, 2))
    discard(sets)
    return out


def _joining(similarity: int):
    """Over rows sorted by group (g, uid, root, side, n, bits, tokens): similar pairs that join two roots, until none is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches):
            left, right = [], []
            for a, s in zip(*(x.tolist() for x in _spans(t["g"].to_numpy())), strict=True):
                own = t.slice(a, s)
                root = own["root"].to_numpy()
                label = np.unique(root, return_inverse=True)[1]
                many = np.bincount(label)
                order = np.argsort(label != many.argmax(), kind="stable")  # members of the largest aren't compared with each other
                label, uid, n, side = (x[order] for x in (label, own["uid"].to_numpy(), own["n"].to_numpy(), own["side"].to_numpy()))
                m = _matrix(own["bits"].to_pylist())[order]
                tokens = [np.frombuffer(own["tokens"][int(i)].as_buffer(), dtype=U) for i in order]
                for i in range(int(many.max()), s):
                    other = label[:i] != label[i]
                    if side[i]:
                        other &= side[:i] != side[i]
                    at = np.flatnonzero(other)
                    near = at[_within(n[at], n[i], np.bitwise_count(m[at] ^ m[i]).sum(axis=1, dtype=np.int64), similarity)]
                    for j in near.tolist():
                        if label[j] != label[i] and _alike(tokens[j], tokens[i], similarity):
                            label[label == label[j]] = label[i]
                            left.append(min(uid[i], uid[j]))
                            right.append(max(uid[i], uid[j]))
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return run


def joining_links(pairs: DataFrame, roots: DataFrame, classes: DataFrame, docs: DataFrame, shingle: int, similarity: int) -> DataFrame:
    """Similar pairs between the components of roots, enough to join all that are similar. Similar sets are in one tree of pairs, whatever came of its pairs."""
    trees = written(components(pairs).select(F.col("node").alias("uid"), F.col("root").alias("tree")), "trees")
    own = trees.join(roots.withColumnRenamed("node", "uid"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    own = own.join(classes.select("uid", "n"), "uid")
    mixed = own.groupBy("tree").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("many"), F.sum("n").alias("tokens")).where("lo != hi")
    own = written(own.join(mixed.drop("lo", "hi"), "tree"), "mixed")
    sets = token_table(own.select("uid"), classes, docs, shingle)
    blocks = F.greatest(F.ceil(F.col("many") / BLOCK), F.ceil(F.col("tokens") / BLOCK_TOKENS)).cast("long")
    rows = _dealt(own, "tree", blocks).select("g", "uid", "root", "side").join(classes.select("uid", "n", "bits"), "uid").join(sets, "uid")
    rows = rows.select("g", "uid", "root", "side", "n", "bits", "tokens").repartition(parts(docs.sparkSession), "g").sortWithinPartitions("g", "uid")
    out = written(rows.mapInArrow(giving_back(_joining(similarity)), "a long, b long"), "links", batch_rows=_batch_rows(sets, 1))
    discard(trees, own, sets)
    return out


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE, similarity: int = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """A row per document: doc_id, sig (of its set; null if empty), n_shingles, component_id, root (a number of the component, null if the set is empty). And the verified links of classes."""
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    s = F.col("s")
    rows = written(own.withColumn("s", _sketched(shingle, similarity)(F.col("text"))).select("doc_id", s["n"].alias("n"), s["sig"].alias("sig"), s["keys"].alias("keys"), s["bits"].alias("bits"), F.monotonically_increasing_id().alias("uid")), "sketched")
    copies = written(rows.where("sig is not null").groupBy("sig").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("first")).select("sig", "first.uid", F.col("first.doc_id").alias("least")), "copies")
    again = written(rows.select("uid", "sig").join(copies.select("sig", F.col("uid").alias("first")), "sig").where("uid != first").select("uid"), "again")
    classes = rows.where("sig is not null").join(small(again), "uid", "left_anti")
    if again.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:  # else a filter of the scan
        classes = written(classes, "classes")
    each = classes.select("uid", F.explode("keys").alias("key"))
    shared = each.groupBy("key").agg(F.count("*").alias("many")).where("many > 1")
    members = written(each.join(shared, "key"), "members")
    pairs = written(near_pairs(members, classes, similarity), "pairs")
    links = verified(pairs, classes, own, shingle, similarity)
    roots = written(components(links), "roots")
    links = links.union(joining_links(pairs, roots, classes, own, shingle, similarity))
    discard(roots)
    roots = written(components(links), "roots")
    of = copies.join(roots.withColumnRenamed("node", "uid"), "uid", "left").select("sig", "least", F.coalesce("root", "uid").alias("root"))
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    of = written(of.join(least, "root").select("sig", "component_id", "root"), "components")
    out = rows.select("doc_id", "sig", F.col("n").alias("n_shingles")).join(of, "sig", "left")
    discard(classes, members, pairs)
    component = F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "sig", "n_shingles", component.alias("component_id"), "root"), links


def query(spark, sf_dir: str) -> DataFrame:
    out, _ = jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_shingles", "component_id")


#: Similarity and shingle length of the pipeline's near-duplicate stage.
STAGE_SHINGLE, STAGE_SIMILARITY = 5, 80


def one_of_each(docs: DataFrame, shingle: int = STAGE_SHINGLE, similarity: int = STAGE_SIMILARITY) -> DataFrame:
    """docs without the documents that have a near duplicate of a smaller doc_id; all columns stay.

    Of each component the row of the smallest doc_id stays (rows without an id go if the component has one); equal doc_ids in
    a component keep the row that is least as JSON. Documents without words are no copies of each other and all stay.
    """
    found, _ = jaccard_components(docs, shingle, similarity)
    found = written(found.where("sig is not null").select("doc_id", "sig", "component_id", "root"), "found")
    # component_id is the smallest doc_id of a component: rows of other ids go; repeated and missing ids need a look at the texts
    id_ = F.col("doc_id")
    gone = found.where("doc_id != component_id").select(id_.alias("__gone")).distinct()
    twice = written(found.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1 or doc_id is null").select(id_.alias("__twice")), "twice")
    out = docs.join(small(gone), id_ == F.col("__gone"), "left_anti")
    if twice.limit(1).count():
        again = docs.join(small(twice), id_.eqNullSafe(F.col("__twice")), "left_semi").withColumn("__sig", signatures(shingle)(F.col("text").cast("string")))
        of = found.select(F.col("sig").alias("__s"), F.col("component_id").alias("__component"), F.col("root").alias("__root")).distinct()
        again = again.join(of, F.col("__sig") == F.col("__s"), "left")
        whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        stays = again.where(F.col("__sig").isNotNull() & id_.eqNullSafe(F.col("__component"))).groupBy("__root").agg(F.min_by(whole, F.to_json(whole)).alias("row")).select("row.*")
        stays = stays.unionByName(again.where(F.col("__sig").isNull()).select(docs.columns))
        out = out.join(small(twice), id_.eqNullSafe(F.col("__twice")), "left_anti").unionByName(stays)
    return out
