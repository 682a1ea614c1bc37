"""The pipeline against a version of it in plain Python: the models are the fitted ones, all else is done by brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from test_op1_jaccard_join import brute as brute_components
from test_op1_jaccard_join import family
from test_op4_op6_models import plain_scores
from test_op10_decontaminate import brute as brute_hits

import corpus_pipeline as pipeline
from ledgerline.llm import op4_toxicity as tox
from ledgerline.llm import op6_quality as qual
from ledgerline.llm.wordhash import text_buffers

DOCS = "doc_id long, text string, lang string, source string, n_chars long, quality string, p string, sig string, root long, ids string, leak string"
LABELS = "doc_id long, quality int, toxic int"


def corpus(words):
    rng = random.Random(21)
    items = [(i, " ".join(words(14, 900 + i))) for i in range(4)] + [(9, None)]
    texts, labels = [], []
    for i in range(260):
        w, junk, bad = words(rng.randint(20, 70), i), i % 4 == 1, i % 5 == 0
        if bad:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["grumpfer", "grumpfen"])
        if i % 13 == 2:
            w += items[i % 4][1].split()[1:13]
        texts.append((i, " ".join(f"{x.upper()}!! |" if junk else x for x in w)))
        labels.append((i, None if i % 31 == 3 else int(not junk), int(bad)))
    texts += [(300 + i, t) for i, t in enumerate(family(words(60, 5000), 9, 4, rng))]
    odd = [(None, None), (400, ""), (401, "  \n"), (402, " ".join(words(20_000, 77, 5000))), (300, texts[3][1]), (300, texts[3][1]), (3, texts[3][1]), (None, texts[7][1]), (403, "x")]
    rows = [(d, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "https://c.x/d/e", None]), None if t is None else len(t), "q", "p", None, i, "i", "l") for i, (d, t) in enumerate([*texts, *odd])]
    return rows, labels, items


def save(spark, at, rows, labels, items):
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_run_equals_the_plain_version(spark, words, tmp_path):
    import sentencepiece

    rows, labels, items = corpus(words)
    d = save(spark, tmp_path, rows, labels, items)
    table = spark.read.parquet(f"{d}/labels.parquet")
    frame = lambda r: spark.createDataFrame(r, DOCS)

    mean, scale, w = qual.train(frame(rows), table)
    x = qual.figures(*text_buffers(pa.array([r[1] for r in rows], pa.string())))
    evidence = np.clip((x - mean) / scale @ w[:-1] + w[-1], -30, 30)
    sites = [(None, r[2]) if r[3] is None else ("c.x", "d") if "c.x" in r[3] else (r[3], r[2]) for r in rows]
    scores = [s for _, _, s in plain_scores([(h, q, e) for (h, q), e in zip(sites, evidence)])]
    good = [r for r, s in zip(rows, scores) if s >= 0.5]
    assert 0.6 < len(good) / len(rows) < 0.9

    m = tox.train(frame(good), table)
    clean = [r for r, z in zip(good, m.logits(*tox.document_terms(*text_buffers(pa.array([r[1] for r in good], pa.string()))))) if z < 0]
    assert 0.6 < len(clean) / len(good) < 0.95

    component = brute_components([(r[0], r[1]) for r in clean], 5, 80)
    kept, seen = [], set()
    for r, (doc, n, c) in zip(clean, component):
        if n == 0:
            kept.append(r)
        elif doc == c and (key := c if c is not None else r[1]) not in seen:  # rows of one id and component are equal but for root here
            seen.add(key)
            kept.append(r)
    clear = [r for r, hit in zip(kept, brute_hits([(r[0], r[1]) for r in kept], items)) if not hit[2]]
    assert len(clear) < len(kept) < len(clean)

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = []
    for r in clear:
        ids = library.encode(r[1] or "")
        want.append((r[0], ids, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((library.decode(ids) if ids else "").encode()).hexdigest()))
    got = [tuple(r) for r in pipeline.run(spark, d).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_columns_and_empty_tables(spark, words, tmp_path, stage):
    rows, labels, items = corpus(words)
    d = save(spark, tmp_path, rows[:40] + rows[-9:], [], [])
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = pipeline.STAGES[stage][1](spark, docs, d)
    assert out.schema.names == docs.schema.names
    if stage != 2:  # no labels, no benchmark: nothing goes
        assert sorted(map(tuple, out.collect()), key=repr) == sorted(map(tuple, docs.collect()), key=repr)
    assert pipeline.STAGES[stage][1](spark, docs.limit(0), d).count() == 0
