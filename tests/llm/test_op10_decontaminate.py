import hashlib
import random
import re

from ledgerline.llm import op10_decontaminate as op

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items):
    windows = {}
    for item, text in items:
        w = split(text)
        m = min(10, len(w))
        for i in range(len(w) - m + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + m]), set()).add(item)
    out = []
    for d, text in rows:
        w, hit, found = split(text), set(), set()
        for m in {len(k) for k in windows}:
            for i in range(len(w) - m + 1):
                if own := windows.get(tuple(w[i : i + m])):
                    hit.update(range(i, i + m))
                    found |= own
        found = sorted(str(x) for x in found if x is not None)
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest()))
    return out


def cases(words):
    rng = random.Random(7)
    items = [(i, " ".join(words(n, i, 60))) for i, n in enumerate((10, 11, 25, 40, 3, 2, 1, 9))]
    items += [(90, None), (91, "..."), (None, "null item words one two three four five six seven eight"), (2, items[2][1]), (92, "É à côté de l'été ÉTÉ 1 2 3 4 5 6")]
    texts = [None, "", "- - -", items[4][1], items[6][1] + " x " + items[6][1]]
    for _ in range(60):
        w = words(rng.randint(1, 200), rng.random(), 60)
        for _ in range(rng.randint(0, 3)):
            piece = split(rng.choice(items)[1])
            a = rng.randint(0, max(0, len(piece) - 8))
            w[rng.randint(0, len(w)) :] = piece[a : a + rng.randint(5, 40)]
        texts.append(rng.choice([" ", ", ", "\n"]).join(w).title())
    texts.append(" ".join(words(30_000, 5, 60) + split(items[1][1]) + words(9, 6, 60)))  # very long
    return list(enumerate(texts)) + [(3, texts[3]), (None, items[0][1])], items


def check(spark, docs, words, **kwargs):
    rows, items = cases(words)
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, token string")
    out = op.with_hits(docs(rows), bench, **kwargs)
    got = [(r.doc_id, r.leak.n_words, r.leak.n_hit, r.leak.n_items, r.leak.items_sha256) for r in out.collect()]
    assert sorted(got, key=str) == sorted(brute(rows, items), key=str)
    assert out.columns == ["doc_id", "text", "lang", "source", "key", "n", "leak"]


def test_equals_brute_force(spark, docs, words):
    check(spark, docs, words)


def test_blocks_of_windows_give_the_same(spark, docs, words):
    check(spark, docs, words, block_windows=20)


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert op.without_leaks(docs(["a b c", None]), none).count() == 2
    assert op.without_leaks(docs([]), none).count() == 0


def test_leaks_go_and_columns_stay(spark, docs):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id long, text string")
    out = op.without_leaks(docs(["zero One two three four five six, seven eight nine ten", "one two three four five six seven eight nine", None]), bench)
    assert sorted(r.doc_id for r in out.collect()) == [1, 2] and out.columns == ["doc_id", "text", "lang", "source", "key", "n"]
