import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import op4_toxicity as tox
from ledgerline.llm import op6_quality as qual


def corpus(words, n=500):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        w, bad, junk = words(rng.randint(20, 80), i, 300), i % 5 == 0, i % 4 == 1
        if bad:
            for _ in range(4):
                w[rng.randrange(len(w))] = "grumpf" + rng.choice(["er", "en", "est", "ish"])
        rows.append((i, " ".join(f"{x.upper()}!!" if junk else x for x in w)))
        labels.append((i, int(not junk), int(bad)))
    return rows, labels


def test_toxic_rows_are_found_on_held_out_ids(spark, docs, words):
    rows, labels = corpus(words)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    odd = [(None, "grumpfer grumpfen"), (900, None), (901, ""), (902, "x" * 100_000), (0, rows[0][1])]
    frame = docs(rows + odd)
    machine = tox.train(frame, table)
    out = frame.select("doc_id", tox.held_out(F.col("doc_id")).alias("held"), tox.toxicity(spark, machine)("text").alias("score")).collect()
    assert len(out) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in out)
    truth = {i: t for i, _, t in labels}
    held = [r for r in out if r.doc_id in truth and r.held]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([(r.score >= 0.5) == truth[r.doc_id] for r in held]) > 0.95
    clean = tox.without_toxic(frame, table)
    assert clean.columns == frame.columns and {900, 901, 902} <= {r.doc_id for r in clean.collect()}


def rough_terms(text):
    """Words and their beginnings, plainly."""
    found = [w for w in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))]
    return {("word", w) for w in found} | {(n, w[:n]) for w in found for n in tox.PREFIXES if len(w) >= n}


def test_terms_are_words_and_their_beginnings(words):
    texts = ["Moron morons, MORON!", "", "été étés naïve_x 12345678", "a" * 50_000 + " b", " ".join(words(300)), "\u00a0x y\tz"]
    data, off = tox.text_buffers(pa.array(texts))
    term, at = tox.document_terms(data, off)
    got = [set(term[at[i] : at[i + 1]].tolist()) for i in range(len(texts))]
    plain = [rough_terms(t) for t in texts]
    assert [len(x) for x in got] == [len(x) for x in plain]
    for i, x in enumerate(plain):  # a term has one number wherever it stands
        for j in range(i):
            assert len(x & plain[j]) == len(got[i] & got[j])


def test_logits_equal_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    terms = np.sort(rng.choice(1 << 40, 30, replace=False))
    m = tox.Machine(-0.3, terms, rng.normal(size=30), rng.normal(size=(30, tox.FACTORS)))
    rows = [np.sort(np.concatenate((rng.choice(terms, n, replace=False), rng.integers(0, 1 << 40, 5)))) for n in (0, 1, 2, 7, 30)] + [np.zeros(0, np.int64)]
    got = m.logits(np.concatenate(rows), np.append(0, np.cumsum([len(r) for r in rows])))
    for g, r in zip(got, rows):
        at = [int(np.searchsorted(terms, t)) for t in r if t in terms]
        want = m.bias + sum(m.weight[i] for i in at) + sum(m.vector[i] @ m.vector[j] for k, i in enumerate(at) for j in at[:k])
        assert g == pytest.approx(want)


def test_insults_with_group_mentions_are_toxic_only_together(spark, docs, words):
    """Planted: an insult alone and a group alone are harmless. Pairs find them through the query's steps; without them, the best cut of the linear part fails."""
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(3000):
        w = words(rng.randint(10, 120), 5000 + i, 600)
        insult, group = i % 3 == 0, i % 4 < 2
        w += ["blistering"] * insult + ["martians"] * group
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(insult and group)))
    frame, table = docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    machine = tox.train(frame, table)
    scored = frame.select("doc_id", "text", tox.toxicity(spark, machine)("text").alias("s")).collect()
    held = [r for r in scored if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    truth = np.array([labels[r.doc_id][2] for r in held])
    assert np.mean((np.array([r.s for r in held]) >= 0.5) == truth) > 0.98
    linear = tox.Machine(machine.bias, machine.terms, machine.weight, np.zeros_like(machine.vector))
    data, off = tox.text_buffers(pa.array([r.text for r in held]))
    z = linear.logits(*tox.document_terms(data, off))
    assert np.mean((z >= 0) == truth) < 0.9


def test_training_without_both_classes(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    frame = docs(["a b", None])
    assert [r.s for r in frame.select(tox.toxicity(spark, tox.train(frame, none))("text").alias("s")).collect()] == [0.0 + 1 / (1 + np.exp(40.0))] * 2
    assert tox.without_toxic(frame, none).count() == 2
    assert qual.good_only(frame, none).count() == 2
    assert tox.without_toxic(docs([]), none).count() == 0 and qual.good_only(docs([]), none).count() == 0


def test_quality(spark, docs, words):
    rows, labels = corpus(words)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    frame = docs(rows + [(None, "a few plain words of text"), (900, None), (0, rows[0][1])]).withColumn("quality", F.lit(3)).withColumn("source", F.when(F.col("doc_id") % 7 == 0, None).otherwise(F.col("source")))
    kept = qual.good_only(frame, table)
    assert kept.columns == frame.columns
    truth = {i: q for i, q, _ in labels}
    got = {r.doc_id for r in kept.collect()}
    assert np.mean([(i in got) == truth[i] for i in truth]) > 0.95


def plain_scores(rows):
    """Scores by the formulas, of rows (host, path, evidence), in plain Python."""
    logit = lambda p: np.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    p = [1 / (1 + np.exp(-e)) for _, _, e in rows]
    rate = np.mean(p)

    def kappa(names):
        groups = {}
        for g, x in zip(names, p):
            groups.setdefault(g, []).append(x)
        k, n = len(groups), len(p)
        if k < 2 or n <= k:
            return groups, qual.KAPPA[1]
        within = sum(((np.array(x) - np.mean(x)) ** 2).sum() for x in groups.values()) / (n - k)
        between = sum(len(x) * (np.mean(x) - rate) ** 2 for x in groups.values()) - (k - 1) * within
        between /= n - sum(len(x) ** 2 for x in groups.values()) / n
        return groups, min(max(within / between, qual.KAPPA[0]), qual.KAPPA[1]) if between > 0 else qual.KAPPA[1]

    hosts, kh = kappa([h for h, _, _ in rows])
    paths, kp = kappa([r[:2] for r in rows])
    out = []
    for (h, q, e), x in zip(rows, p):
        host = (sum(hosts[h]) + kh * rate) / (len(hosts[h]) + kh)
        path = (sum(paths[h, q]) - x + kp * host) / (len(paths[h, q]) - 1 + kp)
        out.append((host, path, 1 / (1 + np.exp(-(e + logit(path) - logit(rate))))))
    return out


def test_scores_equal_the_formulas(spark):
    """Hosts of all sizes, two of them much worse than the rest, null hosts and paths, one document alone; and sites that don't differ."""
    rng = np.random.default_rng(3)
    for worse in (4.0, 0.0):
        rows = []
        for h in [*range(12), None]:
            for _ in range(200 if h in (3, 5) else int(rng.choice([1, 2, 30, 200]))):
                q = rng.choice(["a", "b", ""])
                rows.append((None if h is None else f"h{h}", str(q) or None, float(rng.normal(1.5 - worse * (h in (3, 5)) - (worse > 0) * (q == "b"), 1.5))))
        made = spark.createDataFrame([(i, *r, "x") for i, r in enumerate(rows)], "doc_id long, host string, path string, __e double, n string").repartition(3)
        got = sorted(qual.scored(made, F.col("host"), F.col("path")).collect(), key=lambda r: r.doc_id)
        assert [r.n for r in got] == ["x"] * len(rows)
        for r, (host, path, score) in zip(got, plain_scores(rows)):
            assert (r.quality.host_rate, r.quality.path_rate, r.quality.score) == pytest.approx((host, path, score), rel=1e-6)
        rates = {r.host: r.quality.host_rate for r in got}
        spread = max(rates.values()) - min(rates.values())
        assert spread > 0.2 if worse else spread < 0.1


def test_a_bad_site_turns_doubtful_documents_down(spark):
    """Planted: of two documents with the same evidence, that of the site of junk goes and that of the good site stays; a site seen once follows the prior."""
    rows = [("good", "a", 3.0)] * 60 + [("junk", "a", -3.0)] * 60 + [("good", "a", 0.2), ("junk", "a", 0.2), ("rare", "a", 0.2)]
    made = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, host string, path string, __e double")
    got = {r.doc_id: r.quality for r in qual.scored(made, F.col("host"), F.col("path")).collect()}
    assert got[120].score > 0.6 and got[121].score < 0.2 and 0.4 < got[122].score < 0.65
    assert got[120].host_rate > got[122].host_rate > got[121].host_rate


def test_hosts_and_paths_of_sources(spark):
    made = spark.createDataFrame([("https://A.x/b/c?d", "en"), ("a.x", "de"), ("src1", None), (None, "fr"), ("a.x/only", "es")], "source string, lang string")
    got = [tuple(r) for r in made.select(*qual.site(F.col("source"), F.col("lang"))).collect()]
    assert got == [("a.x", "b"), ("a.x", "de"), ("src1", None), (None, "fr"), ("a.x", "es")]


def test_figures_are_plain_shares(words):
    texts = ["ABC abc! a, a", "", "x\n x\ny | z", " ".join(words(500)), "\u00e9t\u00e9 1234567890123", "  "]
    data, off = qual.text_buffers(pa.array(texts))
    got = qual.figures(data, off)
    for row, t in zip(got, texts):
        raw = t.encode()
        w = [x for x in re.split(rb"[\x20\x09-\x0d]+", raw) if x]
        low = [x.lower() for x in w]
        n, size, letters = max(1, len(w)), max(1, len(raw)), max(1, len(re.findall(rb"[A-Za-z]", raw)))
        pairs = list(zip(low, low[1:]))
        lines = [x for x in raw.lower().split(b"\n") if x]
        repeated = lambda x: (len(x) - len(set(x))) / max(1, len(x))
        want = [len(re.findall(rb"[A-Z]", raw)) / letters, len(re.findall(rb"[0-9]", raw)) / size, len(re.findall(rb"[#$%&*+<=>@^_{|}~\[\]\\/]", raw)) / size]
        want += [raw.count(b"|") / n, raw.count(b"!") / n, len(re.findall(rb"[.,;:?]", raw)) / n, repeated(low), repeated(pairs), repeated(lines)]
        want += [sum(len(x) <= 3 for x in w) / n, sum(len(x) > 12 for x in w) / n, sum(map(len, w)) / n / 10]
        assert row == pytest.approx([*want, *np.sqrt(want), np.log1p(len(w)) / 10, np.log1p(size) / 10, float(not w)])
