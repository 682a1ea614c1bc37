import random

import pytest

from ledgerline.llm import op1_jaccard_join as op


def shingles(text, m):
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w)] if 0 < len(w) < m else (tuple(w[i : i + m]) for i in range(len(w) - m + 1)))


def brute(rows, m, similarity):
    """component_id of each row, by comparing all pairs."""
    sets = [shingles(t, m) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= similarity * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids.setdefault(find(i), []).append(d)
    return [(d, len(s), min(ids.get(find(i), [None])) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def family(base, copies, changes, rng):
    out = []
    for _ in range(copies):
        w = list(base)
        for _ in range(rng.randint(0, changes)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(50)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("m", "similarity"), [(3, 90), (5, 80)])
def test_components_equal_all_pairs(docs, words, m, similarity):
    rng = random.Random(m)
    texts = [t for k, n in enumerate((4, 12, 40, 90, 300)) for t in family(words(n, k), 14, max(1, n // 12), rng)]
    texts += ["", None, "one", "ONE", "one two", "\x85 a", "a\x0bb\tc", "ÀB c d", "Àb c d", " ".join(words(6000, 9))]
    texts += [texts[20], texts[20], " ".join(words(6000, 9)[:-1])]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    rows += [rows[0], (rows[3][0], "other text"), (None, texts[2]), (None, None)]
    got, links = op.jaccard_components(docs(rows), m, similarity)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in got.collect()]
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(brute(rows, m, similarity), key=key)
    assert links.count() > 0


def test_large_group_is_dealt_over_blocks(docs, words, monkeypatch):
    monkeypatch.setattr(op, "BLOCK", 8)
    rng = random.Random(5)
    rows = list(enumerate(family(words(120, 3), 60, 12, rng)))
    got, _ = op.jaccard_components(docs(rows), 3, 80)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == sorted(brute(rows, 3, 80))


def test_short_texts_and_near_misses_give_few_pairs(spark, docs, words):
    """Texts of one to three words and sets that only equals match have no keys; a family of near misses passes on no pairs between its components."""
    rng = random.Random(2)
    rows = list(enumerate(" ".join(words(rng.randint(1, 3), 1000 + i, 5000)) for i in range(2000)))
    base = words(110, 7)
    near = [" ".join([f"n{i}" if j % 40 == i % 40 else w for j, w in enumerate(base)]) for i in range(80)]  # each three words off the base, six of one another
    rows += [(3000 + i, t) for i, t in enumerate([*near, *near[:9]])]
    frame = docs(rows)
    sketched = frame.withColumn("s", op._sketched(3, 90)("text")).selectExpr("doc_id", "s.n", "s.keys")
    assert sketched.where("doc_id < 2000 and size(keys) > 0").count() == 0
    assert op.keys(__import__("numpy").arange(8, dtype="uint64"), 90).size == 0
    got, links = op.jaccard_components(frame, 3, 90)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == sorted(brute(rows, 3, 90))
    assert links.count() < len(rows)


def test_components_by_the_second_comparison(docs, words, monkeypatch):
    """Links that the first forests miss: a bridge from one family to another by one member each; tiny blocks."""
    rng = random.Random(11)
    monkeypatch.setattr(op, "BLOCK", 4)
    monkeypatch.setattr(op, "BLOCK_TOKENS", 200)
    texts = []
    for k in range(6):
        base = words(rng.randint(30, 80), 50 + k)
        texts += family(base, 12, 5, rng)
    rows = list(enumerate(texts))
    got, _ = op.jaccard_components(docs(rows), 3, 80)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == sorted(brute(rows, 3, 80))


def test_shuffled_tables_give_the_same(docs, words, monkeypatch):
    rng = random.Random(12)
    rows = list(enumerate([t for k in range(4) for t in family(words(60, k), 8, 6, rng)] + ["", None]))
    want = sorted((d, c) for d, _, c in brute(rows, 3, 80))
    monkeypatch.setattr(op, "small", lambda df, limit=0: df)
    monkeypatch.setattr(op, "BROADCAST_ROWS", 0)
    got, _ = op.jaccard_components(docs(rows), 3, 80)
    assert sorted((r.doc_id, r.component_id) for r in got.collect()) == want


def test_keys_are_few_at_every_size():
    import numpy as np

    rng = np.random.default_rng(2)
    for similarity in (50, 70, 80, 90, 95):
        for n in [*range(1, 80), *map(int, 80 * 1.13 ** np.arange(45))]:
            for _ in range(20 if n < 80 else 1):
                keys = op.keys(np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)), similarity)
                assert len(keys) <= (4 if similarity < 60 else 2.5) * (n + 10)


def test_similar_sets_share_a_key(words):
    import numpy as np

    rng = np.random.default_rng(1)
    for similarity in (50, 80, 90):
        for n in (*range(1, 34), 45, 100, 333, 520, 840, 1000, 1340):
            for _ in range(20):
                a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
                d = (100 - similarity) * 2 * n // (100 + similarity)
                b = a.copy()
                b[: d // 2] = rng.integers(0, 1 << 63, d // 2, dtype=np.uint64)
                a, b = np.unique(a), np.unique(b)
                both = len(np.intersect1d(a, b))
                if 100 * both >= similarity * (len(a) + len(b) - both):
                    assert both == len(a) == len(b) or set(op.keys(a, similarity).tolist()) & set(op.keys(b, similarity).tolist())
                    x, y = op.sketch(a, 4), op.sketch(b, 4)
                    assert np.bitwise_count(x ^ y).sum() <= len(a) + len(b) - 2 * both


def test_similar_sets_of_other_sizes_share_a_key():
    import numpy as np

    rng, pairs = np.random.default_rng(5), 0
    for similarity in (50, 70, 80, 90):
        for t in range(700):
            a = np.unique(rng.integers(0, 1 << 63, int(rng.integers(2, 400 if t % 2 else 40)), dtype=np.uint64))
            d = (100 - similarity) * 2 * len(a) // (100 + similarity)
            gone = int(rng.integers(0, d + 1))
            b = np.unique(np.concatenate((rng.permutation(a)[gone:], rng.integers(0, 1 << 63, int(rng.integers(0, d + 1 - gone)), dtype=np.uint64))))
            both = len(np.intersect1d(a, b))
            if 100 * both >= similarity * (len(a) + len(b) - both) and not both == len(a) == len(b):
                pairs += 1
                assert set(op.keys(a, similarity).tolist()) & set(op.keys(b, similarity).tolist()), (similarity, len(a), len(b), both)
    assert pairs > 1500


def test_empty_table(docs):
    got, links = op.jaccard_components(docs([]))
    assert got.count() == 0 and links.count() == 0
    assert op.one_of_each(docs([])).count() == 0


def test_one_of_each_keeps_columns_and_one_row(docs, words):
    base = words(100, 1)
    near = " ".join([*base[:-1], "zz"])
    rows = [(5, " ".join(base)), (3, near), (3, near), (8, "other words here now then"), (9, None), (10, ""), (None, " ".join(base)), (None, "lonely text of five words"), (None, "lonely text of five words"), (3, "a different text for the id")]
    out = op.one_of_each(docs(rows))
    assert out.columns == ["doc_id", "text", "lang", "source", "key", "n"]
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    want = [(3, near), (8, "other words here now then"), (9, None), (10, ""), (None, "lonely text of five words"), (3, "a different text for the id")]
    assert got == sorted(want, key=str)
