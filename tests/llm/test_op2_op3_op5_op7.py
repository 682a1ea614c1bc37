import hashlib
import io
import random
import wave

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import op2_chroma as chroma
from ledgerline.llm import op3_licenses as lic
from ledgerline.llm import op5_main_text as page
from ledgerline.llm import op7_chat as chat


# --- media -----------------------------------------------------------------------------------------------------------------
def test_shifted_recording_is_aligned(spark):
    rng = np.random.default_rng(1)
    notes = rng.normal(size=(6, 90)).astype(np.float32)
    sound = chroma.tones(notes)
    cut = sound[0][20 * chroma.FRAME :]
    noisy = sound[1] + rng.normal(size=sound.shape[1]).astype(np.float32) * 0.01
    rows = [(i, s.tolist()) for i, s in enumerate([*sound, cut, noisy])] + [(20, None), (21, []), (22, [0.0] * 30_000)]
    coded = chroma.with_codes(spark.createDataFrame(rows, "class_id long, samples array<float>"))
    found = {(r.q, r.r): r for r in chroma.align(coded, spark.createDataFrame([(0,), (1,), (20,)], "class_id long")).collect()}
    assert set(found) == {(0, 6), (1, 7)}
    assert found[0, 6].off == -20 * chroma.FRAME // chroma.HOP and found[0, 6].bit_error < 0.02
    assert found[1, 7].off == 0 and found[1, 7].bit_error < 0.15


def brute_matches(codes, asked, max_error):
    """By the definition: all pairs, all offsets."""
    out = {}
    for q in asked:
        for r in codes:
            if q == r:
                continue
            a, b = codes[q], codes[r]
            changes = [{i for i in range(1, len(x)) if x[i] != x[i - 1]} for x in (a, b)]
            for off in range(chroma.LEAST_OVERLAP - len(a), len(b) - chroma.LEAST_OVERLAP + 1):
                lo, hi = max(0, -off), min(len(a), len(b) - off)
                at = [i for i in changes[0] if i + off in changes[1] and a[i] == b[i + off]]
                votes = sum(j in at for i in at for j in range(i + 1, i + chroma.GAPS + 1))
                if votes and hi - lo >= chroma.LEAST_OVERLAP:
                    error = sum(bin((x ^ y) & 0xFFFFFFFF).count("1") for x, y in zip(a[lo:hi], b[lo + off : hi + off])) / (32 * (hi - lo))
                    if error <= max_error:
                        out[q, r] = min(out.get((q, r), (9, 0, 0)), (error, off, votes))
    return out


def test_matches_equal_brute_force(spark):
    """Noisy, cut, held and silent recordings, ones of a few codes, and ones that share a jingle."""
    rng = np.random.default_rng(3)
    base = [rng.integers(0, 2**31, rng.integers(30, 90)) for _ in range(12)]
    few = [rng.integers(0, 3, 60) for _ in range(4)]
    held = [np.repeat(rng.integers(0, 2**31, 6), 10), np.zeros(70, int), np.zeros(70, int), np.repeat(rng.integers(0, 2**31, 6), 10)]
    jingle = rng.integers(0, 2**31, 40)
    shared = [np.concatenate((rng.integers(0, 2**31, 15), jingle, rng.integers(0, 2**31, k))) for k in (0, 3, 40)]
    flips = np.packbits(rng.random((12, 90, 32)) < rng.choice([0.01, 0.05, 0.1], (12, 1, 1)), axis=2).view(np.uint32)[..., 0].astype(int)
    noisy = [b ^ f[: len(b)] for b, f in zip(base, flips)] + [base[0][7:], np.concatenate((rng.integers(0, 2**31, 9), base[1]))]
    codes = {i: [int(np.int32(np.uint32(x))) for x in c] for i, c in enumerate([*base, *few, *held, *shared, *noisy])}
    made = spark.createDataFrame([(i, c, "x") for i, c in codes.items()], "class_id long, codes array<int>, q string")
    asked = made.where("class_id % 2 = 0")
    for broadcast in (chroma.BROADCAST_KEYS, 0):
        kept, chroma.BROADCAST_KEYS = chroma.BROADCAST_KEYS, broadcast
        try:
            got = {(r.q, r.r): (r.bit_error, r.off, r.votes) for r in chroma.align(made, asked, 0.2).collect()}
        finally:
            chroma.BROADCAST_KEYS = kept
        want = brute_matches(codes, [i for i in codes if i % 2 == 0], 0.2)
        assert got.keys() == want.keys() and len(got) > 20
        assert all(got[k] == pytest.approx(want[k]) for k in got)


def test_recall_of_noisy_copies():
    """Of copies within the bit error at their offset, nine tenths and more have a vote there."""
    rng = np.random.default_rng(5)
    sound = chroma.tones(rng.normal(size=(60, 64)).astype(np.float32))
    power, within, voted = (sound**2).mean(), 0, 0
    for copy in [sound + rng.normal(0, np.sqrt(power / 10 ** (db / 10)), sound.shape) for db in (20, 10, 5, 1)] + [np.roll(sound, 100, axis=1), sound * 0.2]:
        a, b = chroma.fingerprints(sound), chroma.fingerprints(copy.astype(np.float32))
        error = np.bitwise_count(a.view(np.uint32) ^ b.view(np.uint32)).mean(1) / 32
        same = (a == b) & np.append(np.zeros((60, 1), bool), (a[:, 1:] != a[:, :-1]) & (b[:, 1:] != b[:, :-1]), axis=1)
        votes = sum((same[:, :-g] & same[:, g:]).sum(1) for g in range(1, chroma.GAPS + 1))
        within, voted = within + (error <= chroma.MAX_ERROR).sum(), voted + ((error <= chroma.MAX_ERROR) & (votes > 0)).sum()
    assert within > 250 and voted >= 0.9 * within


def test_search_gives_a_row_for_each_query_and_class(spark):
    rng = np.random.default_rng(6)
    x, y = (rng.integers(0, 2**31, 70).astype(np.int32).tolist() for _ in range(2))
    long = rng.integers(0, 2**31, 300_000).astype(np.int32).tolist()
    rows = [(50, x), (7, x), (3, y), (100, [c ^ (i % 2) for i, c in enumerate(y)]), (150, None), (200, []), (None, x), (250, x[:20]), (50, y), (300, long), (8, long[150_000:150_500])]
    made = spark.createDataFrame([(i, c, 1) for i, c in rows], "id long, codes array<int>, votes int")
    got = sorted(map(tuple, chroma.search(made, F.col("id") % 50 == 0).collect()), key=repr)
    flipped = 1 / 64
    want = [(50, 7, 2, None, None, None, None, None), (50, 3, 2, 100, 1, 0, 126, flipped), (100, 100, 1, 3, 2, 0, 126, flipped), (150, 150, 1, None, None, None, None, None), (200, 200, 1, None, None, None, None, None), (250, 250, 1, None, None, None, None, None), (300, 300, 1, 8, 1, -150_000, 8 * 499 - 36, 0.0)]
    assert got == sorted(want, key=repr)
    assert chroma.search(made.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("kind", range(6))
def test_filters_equal_sums_over_the_image(kind):
    rng = np.random.default_rng(2)
    image = rng.random((1, 40, 12))
    integral = np.zeros((1, 41, 13))
    integral[:, 1:, 1:] = image.cumsum(1).cumsum(2)
    y, high, wide = 2, 6, 9
    got = chroma._filter(integral, kind, y, high, wide)[0]
    for i, g in enumerate(got):
        part = lambda x0, y0, x1, y1: image[0, i + x0 : i + x1, y0:y1].sum()
        a, b = {
            0: lambda: (part(0, 2, 9, 8), part(0, 0, 9, 12) / 12 * 6),
            1: lambda: (part(0, 2, 9, 5), part(0, 5, 9, 8)),
            2: lambda: (part(0, 2, 4, 8), part(4, 2, 9, 8)),
            3: lambda: (part(0, 2, 4, 5) + part(4, 5, 9, 8), part(0, 5, 4, 8) + part(4, 2, 9, 5)),
            4: lambda: (part(0, 4, 9, 6), part(0, 2, 9, 4) + part(0, 6, 9, 8)),
            5: lambda: (part(3, 2, 6, 8), part(0, 2, 3, 8) + part(6, 2, 9, 8)),
        }[kind]()
        assert g == pytest.approx(np.log((1 + a) / (1 + b)))


def test_wav_bytes():
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(np.array([[16384, 0], [-32768, -32768]], dtype="<i2").tobytes())
    samples, rate = chroma.pcm_of_wav(out.getvalue())
    assert samples.tolist() == [0.25, -1.0] and rate == 8000


# --- licences --------------------------------------------------------------------------------------------------------------
def test_licenses_match_whatever_their_dress(docs):
    mit = lic.LICENSES["MIT"]
    texts = [mit, "Copyright (c) 2020 A. Nother\n\n" + mit.upper().replace(" ", "\n  "), mit + " And more.", None, "", "Licensed under the Apache Licence, Version 2.0.", mit.replace("sublicense", "sub-license")]
    got = {r.doc_id: r.license_id for r in lic.with_license(docs(texts)).collect()}
    assert got == {0: "MIT", 1: "MIT", 2: None, 3: None, 4: None, 5: "Apache-2.0-line", 6: "MIT"}
    assert lic.with_license(docs([])).count() == 0


def test_common_licenses_are_known(docs):
    names = ["Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "Unlicense", "BSL-1.0", "AGPL-3.0-or-later-notice", "CC-BY-4.0-notice"]
    texts = [lic.LICENSES[n].upper().replace("\n", "\r\n ") for n in names]
    texts += ["This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0."]
    texts += [lic.LICENSES["Apache-2.0"].replace("[yyyy] [name of copyright owner]", "2020 A. Nother")]
    got = {r.doc_id: r.license_id for r in lic.with_license(docs(texts)).collect()}
    assert got == dict(enumerate([*names, "GPL-3.0-line", "CC-BY-NC-4.0-line", "Apache-2.0-filled"]))


def test_whole_licenses_among_documents_through_the_query(spark, docs, tmp_path):
    """Planted: every known text in another dress, among long, repeated, null and clashing rows; the query's rows equal its SQL's."""
    import duckdb

    known = sorted(lic.LICENSES)
    rows = [(i, "Copyright 2021 A. Nother\n" + lic.LICENSES[n].replace("license", "LICENCE").replace(" ", "  ")) for i, n in enumerate(known)]
    rows += [(500, "word " * 200_000 + lic.LICENSES["MIT"]), (501, None), (501, None), (502, lic.LICENSES["MIT"]), (502, lic.LICENSES["MIT"]), (None, lic.LICENSES["ISC"]), (503, "")]
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, lic.query(spark, str(tmp_path)).collect()), key=repr)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    cursor = con.execute(lic.oracle())
    at = [[c[0] for c in cursor.description].index(n) for n in ("doc_id", "license_digest", "license_id")]
    assert got == sorted((tuple(r[i] for i in at) for r in cursor.fetchall()), key=repr)
    by = {r[0]: r[2] for r in got}
    assert [n for i, n in enumerate(known) if by[i] is None] == [] and [r[2] for r in got if r[0] == 502] == ["MIT", "MIT"]
    assert by[500] is None and by[501] is None and by[None] == "ISC"


def test_license_columns_of_the_input_are_replaced(docs):
    frame = docs([lic.LICENSES["MIT"], "x"]).withColumn("license_id", F.lit("mine")).withColumn("license_digest", F.lit(1))
    out = lic.with_license(frame)
    assert sorted(out.columns) == sorted(frame.columns) and [r.license_id for r in out.orderBy("doc_id").collect()] == ["MIT", None]


# --- pages -----------------------------------------------------------------------------------------------------------------
def lcs(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


def test_shared_lines_is_a_longest_common_subsequence():
    rng = random.Random(2)
    for _ in range(500):
        a, b = (["abcd"[rng.randrange(4)] for _ in range(rng.randint(0, 12))] for _ in range(2))
        got = sorted(page.shared_lines(a, b))
        assert len(got) == lcs(a, b)
        it = iter(b)
        assert all(a[i] in it for i in got)


def test_shared_lines_are_longest_beyond_any_number_of_matches(monkeypatch):
    monkeypatch.setattr(page, "MATCHES", 3)
    test_shared_lines_is_a_longest_common_subsequence()
    monkeypatch.setattr(page, "MASK_BYTES", 0, raising=False)
    test_shared_lines_is_a_longest_common_subsequence()


def test_frames_go_and_articles_stay():
    html = """<html><head><title>x</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav>a<li>b</nav><div class="cookie-notice">ok?</div>
    <article><h1>T &amp; t</h1><p><b>One  two<br>x &nbsp;y<p>three<div class='ad-slot'>BUY</div><p>four <i>five</i> s<b>i</b>x<form>sub</form><script>var a="</p>";</script>
    <section id="comments"><p>c1</p></section></article><!-- no --><footer>f"""
    assert page.main_text(page.lines(html), []) == "T & t\nOne two\nx y\nthree\nfour five six"


def test_marks_of_elements():
    html = '<div class="page-header">Site</div><div class="layout has-sidebar no-ads"><div itemprop="articleBody"><div class="article-header">Title</div><p>Body</p></div><div id="rightSidebar">x</div></div>'
    assert page.main_text(page.lines(html), []) == "Title\nBody"


def test_words_that_an_article_may_be_about_need_evidence():
    def lines(n):
        return page.lines(f'<article><h1>T{n}</h1><p class="search-results">Found {n}</p><section class="tags-and-types">Types {n}</section><div class="related">See also</div><div class="share-bar">Share</div><p class="ad">Buy</p><p>Body {n}</p></article>')

    assert page.main_text(lines(1), []) == "T1\nFound 1\nTypes 1\nSee also\nBody 1"
    assert page.main_text(lines(1), [lines(2)]) == "T1\nFound 1\nTypes 1\nBody 1"


def test_pages_without_an_article_lose_shared_lines(spark):
    def html(body):
        return f"<html><body><div>Site name</div><div>Menu one</div>{body}<div>All rights</div></body></html>"

    rows = [(1, "http://h.x/a/1", html("<p>first text")), (2, "https://H.x/a/2?x=1", html("<p>second text")), (3, "http://h.x/a/3", html("<p>second text")), (4, "http://other/a/1", html("<p>alone")), (5, None, None), (5, None, ""), (6, "x", "plain &lt;text")]
    frame = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, g string")
    got = sorted((r.page_id, r.text) for r in page.extract(frame).collect())
    assert got == [(1, "first text"), (2, "second text"), (3, "second text"), (4, "Site name\nMenu one\nalone\nAll rights"), (5, ""), (5, ""), (6, "plain <text")]
    assert page.extract(frame.limit(0)).count() == 0


def test_short_pages_in_a_long_frame_lose_it():
    def lines(n):
        return [(f"frame {i}", False, False, False) for i in range(30)] + [(f"own {n}", False, False, False)]

    assert page.main_text(lines(1), [lines(2), lines(1), lines(3)]) == "own 1"
    assert page.main_text(lines(1), [lines(2), lines(1)]).startswith("frame 0")


def test_differencing_decides_on_pages_with_an_article():
    def lines(title, body):
        return page.lines(f"<div>Site name</div><h1>{title}</h1><article><p>{body}<p>Quoted</article><div>All rights</div>")

    assert page.main_text(lines("Title", "text"), [lines("Other", "else")]) == "Title\ntext\nQuoted"


def brute_texts(rows):
    """Texts by page of whole hosts in memory, with plain neighbours and a plain alignment of greatest length."""

    def key(r):
        url = r[1] or ""
        bare = url.split("://", 1)[1] if "://" in url else url
        whole = bare.split("?")[0].split("#")[0]
        host, _, rest = whole.partition("/")
        return host.lower(), whole[len(host) :], r[0], r[1] or "", r[2] or ""

    order = sorted(rows, key=key)
    read = [page.lines(r[2] or "") for r in order]
    out = []
    for i, own in enumerate(read):
        near = sorted((abs(j - i), j) for j in range(max(0, i - page.LOOK), min(len(read), i + page.LOOK + 1)) if j != i and key(order[j])[0] == key(order[i])[0])
        names, copies, gone = [x[0] for x in own], [], None
        for _, j in near:
            other = [x[0] for x in read[j]]
            if other != names and gone is None:
                common = page.shared_lines(names, other)
                assert len(common) == lcs(names, other)
                if len(common) < page.COPY * len(names):
                    gone = common
                copies.append(common)
        gone = gone if gone is not None else copies[0] & copies[1] if len(copies) > 1 else set()
        out.append((order[i][0], "\n".join(x[0] for k, x in enumerate(own) if not x[2] and not (k in gone and (x[3] or not x[1])))))
    return sorted(out)


def test_texts_equal_brute_force_whatever_the_ranges(spark, monkeypatch):
    """Copies, near copies, long frames, folders of one page, repeated ids and URLs, null URLs, over ranges of about three pages."""
    rng = random.Random(9)
    rows = []
    for i in range(160):
        host, frame = rng.choice(["A.x", "b.x", "c.x:80"]), [f"<div>f{k % rng.choice([3, 40])}</div>" for k in range(rng.choice([2, 30]))]
        body = [f"<p>t{rng.randrange(60)}</p>" for _ in range(rng.randint(0, 5))]
        if rng.random() < 0.5:
            body = ["<article>", *body, '<div class="related">See also</div>', "</article>"]
        html = "".join(frame[: len(frame) // 2] + body + frame[len(frame) // 2 :])
        url = rng.choice([f"http://{host}/a/{rng.randrange(50)}", f"https://{host}/{i}/index.html?q={i}", None])
        rows += [(i, url, html)] * rng.choice([1, 1, 1, 2, 7]) if rng.random() < 0.9 else [(i, url, None)]
    want = brute_texts(rows)
    for size in (3, 1000):
        monkeypatch.setattr(page, "GROUP_PAGES", size)
        made = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
        assert sorted((r.page_id, r.text) for r in page.extract(made).collect()) == want


def test_small_ranges_lend_across_each_other():
    keys = [("h", f"{i:02}", i, "") for i in range(20)]
    ends = {0: keys[:1], 1: keys[1:3], 3: keys[3:4], 4: [*keys[4:8], *keys[16:20]]}
    lent = {}
    for k, b in page._lendings(ends):
        lent.setdefault(b, set()).add(k[2])
    assert lent == {0: {1, 2, 3, 4}, 1: {0, 3, 4, 5, 6}, 2: {0, 1, 2, 4, 5, 6, 7}, 3: {0, 1, 2, 3}}


@pytest.mark.parametrize("part", ["<a '", '<a ="', "<a b='>'", "<div></x>", "<b><p>", "<b>", "<!--", "<title>", "</b>", "&amp;", "<p><b><div></b>", "<", "<![CDATA[", "<a b=c>d", "<li>x", "<script>x"])
def test_a_megabyte_of_anything_is_read_in_proportion(part):
    import time

    took = []
    for size in (1 << 17, 1 << 20):
        began = time.perf_counter()
        page.lines("<b><div>" + part * (size // len(part)) + "</x>" * 9)
        took.append(time.perf_counter() - began)
    assert took[1] < 30 * took[0] + 1


# --- chat ------------------------------------------------------------------------------------------------------------------
TURNS = "conv_id long, turn long, role string, text string, kind string"


def test_chat_round_trip(spark):
    rng = random.Random(4)
    parts = ["</s>", "[INST]", " [/INST]", "\\", "<", "[", ">", "<<SYS>> ", "é", "日本", "x y", "\n", "<s>", "[OUT] ", "<<ROLE a>> "]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", "we>> ird\\<", None]), "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))) for c in range(40) for t in range(rng.randint(1, 12))]
    rows += [(None, 0, None, None), (None, 0, "assistant", None), (7, 0, "user", "tie"), (7, 0, "user", "tie")]
    made = chat.format_conversations(spark.createDataFrame([(*r, "k") for r in rows], TURNS))
    digests = {r.conv_id: r for r in chat.digests(made).collect()}
    formatted = {r.conv_id: r.formatted for r in made.collect()}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1], r[2] is not None, (r[2] or "").encode(), r[3] is not None, (r[3] or "").encode()))
        assert chat.parse(formatted[c].encode()) == [(r[2], r[3] or "") for r in own]
        said, learned = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own), "".join(r[3] or "" for r in own if r[2] == "assistant")
        want = (len(own), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(formatted[c]))
        assert tuple(digests[c])[1:] == want


def test_conversations_run_over_batches(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        test_chat_round_trip(spark)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_small_chunks_and_long_texts(spark, monkeypatch):
    """Chunks of single conversations, scatters of some bytes, segments that are copied as slices."""
    rng = np.random.default_rng(1)
    text = rng.choice(np.frombuffer(b"ab<[>\\ ", np.uint8), 5000)
    want = bytes(b for x in text.tolist() for b in ([x, 92] if x in b"<[>\\" else [x]))
    for size in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(chat, "SCATTER_BYTES", size)
        out, off = chat.escape(text, np.array([0, 10, 10, 5000]))
        assert out.tobytes() == want and chat.unescape(out[off[0] : off[1]].tobytes()) == text[:10].tobytes() and off[1] == off[2]
        rows = [(c, t, r, s) for c in (3, None) for t, (r, s) in enumerate([("user", "a<" * 50), ("assistant", "x" * 2000 + "]é"), ("assistant", None), ("tool", "[" * 99)])]
        table = {k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])}
        batch = pa.RecordBatch.from_arrays([table["conv_id"].take(pa.array([4, 5, 6, 7, 0, 1, 2, 3])), table["role"].take(pa.array([4, 5, 6, 7, 0, 1, 2, 3])), table["text"].take(pa.array([4, 5, 6, 7, 0, 1, 2, 3]))], names=["conv_id", "role", "text"])
        for chunk in (1, 1 << 20):
            monkeypatch.setattr(chat, "CHUNK_BYTES", chunk)
            got = [r for b in chat._formatted(iter([batch.slice(0, 3), batch.slice(3, 3), batch.slice(6)])) for r in b.to_pylist()]
            assert [r["conv_id"] for r in got] == [None, 3]
            for r in got:
                assert chat.parse(r["formatted"].encode()) == [("user", "a<" * 50), ("assistant", "x" * 2000 + "]é"), ("assistant", ""), ("tool", "[" * 99)]
                assert [r["formatted"].encode()[a:b].decode() for a, b in zip(r["loss_from"], r["loss_to"])] == ["x" * 2000 + "]é", ""]


def test_no_conversations(spark):
    assert chat.digests(chat.format_conversations(spark.createDataFrame([], TURNS))).count() == 0
