import hashlib
import html as entities
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import regex
from faultspark.llm import common, decontam, html_main, near_dedup, packing, pii, quality, substring_dedup, tokens, topk, toxicity
from faultspark.llm.common import table
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(SF).is_dir(), reason="no test tables")
WORDS = [f"w{k}" for k in range(200)]


def text(seed, n=120):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


@pytest.fixture(scope="session")
def docs(spark):
    same = text(1)
    rows = [(0, text(0)), (1, same), (2, same), (3, same.replace("w7 ", "x7 ", 1)), (4, None), (5, ""), (6, "one"), (None, "lost row"), (7, text(7, 3000)), (8, "Of. " + text(8) + ".")]
    return spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, score string")


def test_encoder_equals_whole_texts():
    e = tokens.Encoder(tokens.vocabulary_path(), most=5)
    odd = ["Ünïcode—ﬁ x", "don't I'LL 's", "A.B, c.. d,,", "<|endoftext|> x", "tab\tsep\x0b\x1cq z", "ΣΑΣ ς.", "", None, text(3)]
    got = e.encode(pa.array(odd))
    assert all(np.frombuffer(g, e.dtype).tolist() == e.tokenizer.encode(o or "", add_special_tokens=False).ids + [1] for g, o in zip(got, odd))


def test_token_files(spark, docs):
    got = tokens.token_file_digest(docs).orderBy("start").collect()
    assert len(got) == 10 and got[0].doc_id is None
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
    assert next(r for r in got if r.doc_id == 4).ids_crc32 == zlib.crc32(np.array([1], "<u4").tobytes())
    assert tokens.token_file_digest(docs.limit(0)).count() == 0


@pytest.fixture(scope="session")
def whole(spark):
    """Rows of the small documents table and their ids by the tokenizer itself."""
    df = table(spark, SF, "documents")
    rows = df.select("doc_id", "text").orderBy("doc_id").collect()
    coded = tokens.Encoder(tokens.vocabulary_path()).tokenizer.encode_batch_fast([r.text or "" for r in rows], add_special_tokens=False)
    return df, {r.doc_id: np.array([*e.ids, 1], "<u4") for r, e in zip(rows, coded)}


@needs_tables
def test_token_files_equal_the_tokenizer(whole):
    df, ids = whole
    start, want = 0, []
    for d, x in ids.items():
        want.append((d, start, len(x), zlib.crc32(x.tobytes())))
        start += len(x)
    assert [tuple(r) for r in tokens.token_file_digest(df).orderBy("doc_id").collect()] == want


@needs_tables
def test_pieces_equal_the_tokenizer(whole):
    df, ids = whole
    got = packing.pack_documents(df).toPandas()
    want = {(d, p): (s, len(x[s : s + 4096]), zlib.crc32(x[s : s + 4096].tobytes())) for d, x in ids.items() for p, s in enumerate(range(0, len(x), 4096))}
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got.itertuples()} == want and len(got) == len(want)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.length.sum() <= 4096 and g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]]
    assert got.sequence_id.nunique() <= 1.01 * got.length.sum() / 4096 + 2


def test_token_files_odd_ids(spark):
    rows = [(None, "a"), (-(1 << 63), "b"), (5, "x y"), (5, "x"), (5, None), (None, "c c")]
    frame = lambda parts: spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = [sorted(map(tuple, tokens.token_file_digest(frame(n)).select("start", "n_tokens", "ids_crc32", F.coalesce("doc_id", F.lit(-1))).collect())) for n in (1, 3)]
    assert got[0] == got[1] and [r[3] for r in got[0]] == [-1, -1, -(1 << 63), 5, 5, 5]


def test_packing(docs):
    got = packing.pack_documents(docs).toPandas()
    assert got.length.max() <= 4096 and len(got) >= 10
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g.offset.to_numpy() == np.concatenate([[0], g.length.cumsum()[:-1]])).all() and g.length.sum() <= 4096
    runs, n = packing.plan_runs({4096: 3, 2048: 4, 100: 81})
    assert n == 3 + 2 + 3 and runs[:, 2].sum() == 88  # 40 pieces of 100 fit a sequence
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_near_duplicates(docs):
    got = {r.doc_id: r for r in near_dedup.near_duplicates(docs, shingle=2).collect()}
    assert got[3].component_id == got[2].component_id == 1 and got[1].kept and not got[2].kept
    assert got[4].n_shingles == 0 and got[4].kept and got[None].component_id is None and got[6].n_shingles == 1
    assert near_dedup.near_duplicates(docs.limit(0), shingle=2).count() == 0


def test_pii_base_spans(spark):
    odd = ["a@b.c.d_x@y.z a@b.c@d.e", "1.2.3.4.5.6.7.8 256.1.1.1", "4111 1111-1111 1111, 4111  111", "+1 (017) 555-7713 +1+12125551234", "9" * 5000, None, "", "é😀 x@y.z"]
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def ok(kind, m):
        d = re.sub("[^0-9]", "", m)
        luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0 if kind == "card" else 0
        return {"email": True, "ip": all(int(x) <= 255 for x in m.split(".")) if kind == "ip" else 0, "card": 14 <= len(d) <= 19 and luhn, "phone": 10 <= len(d) <= 15}[kind]

    df = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    for r in pii.find(df).collect():
        want = sorted((m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(plain.items()) for m in re.finditer(p, odd[r.doc_id] or "") if ok(kind, m[0]))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in want).encode()).hexdigest()


def test_pii_learns_contexts(spark):
    rows = [f"please mail me {c}@x.org, now" for c in "abcdef"] + ["please mail me 77442-x, now"]
    got = pii.find(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).where("n_added > 0").collect()
    assert [(r.doc_id, r.spans) for r in got] == [(6, "email:15:22")]


def test_decontamination(spark, docs):
    item = "A train leaves Paris at 5 km from the old gate and meets Anna who carries 12 apples to the market before noon"
    moved = "so here it is: " + item.replace("5 km", "70 km").replace("12", "31") + " and more words follow"
    both = spark.createDataFrame([(100, moved, ""), (101, item, "")], docs.schema).union(docs)
    got = {r.doc_id: r.same_slots for r in decontam.contaminated(both, spark.createDataFrame([(1, item), (2, None)], "item_id long, text string")).collect()}
    assert got == {100: False, 101: True}


def test_decontamination_literal_windows(spark):
    items = [
        "3 5 7 11 13 17 19 23 29 31 37 41 43 47",
        "Paris Rome Anna Smith Berlin Tokyo Lima Cairo Oslo Bern Riga Quito Delhi Accra",
        "Which gas do plants take from the air around them",
        "Name the red planet",
        "Why not",
        "Find all sides of it. Then add them up. Now divide by the first one. Say what is left over",
    ]
    rows = [(k, f"he said, {t} and so on went the talk") for k, t in enumerate(items)]
    rows += [(10, items[5].replace(".", "")), (11, items[2].title()), (12, "Well. Why not? Because"), (13, "we talk of the planets and the red ones 3 5 7 11 13")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(d, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    assert got == {(0, 0), (1, 1), (2, 2), (3, 3), (5, 5), (10, 5), (11, 2), (12, 4)}


def test_decontamination_slots(spark):
    item = "a farmer has 5 hens and keeps them near the barn with 5 ducks that like to swim when Anna brings 7 buckets of fresh water from the old well down by the mill"
    rows = [(0, item.replace("5 ducks", "8 ducks")), (1, item.replace("5", "6").replace("7", "6")), (2, item.replace("Anna", "Mary Ann")), (3, item.replace("and keeps", "and always keeps"))]
    rows += [(4, "a farmer has 5 hens and nothing else, while the old well down by the mill is dry"), (5, "inside: A" + item[1:].replace("7", "9"))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_windows, r.same_slots) for r in decontam.contaminated(d, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert set(got) == {0, 1, 2, 3, 5} and not got[0][1] and not got[1][1]
    assert got[2][0] == got[1][0]  # a longer name is one slot


def test_repeated_spans(docs):
    got = substring_dedup.repeated_spans(docs, min_words=substring_dedup.PASSAGE).collect()
    assert {r.doc_id for r in got} == {2, 3} and {r.kept_doc_id for r in got} == {1}  # 3 repeats words 1-73 and 75-120 of 1
    left = substring_dedup.remove_spans(docs.where("doc_id < 4"), substring_dedup.repeated_spans(docs))
    assert {r.doc_id: len(r.text) for r in left.collect()}[2] == 0


def test_repeated_lines(spark):
    """Lines against plain Python: every whole line that an earlier one equals is inside a span."""
    rng = np.random.default_rng(9)
    stock = [" ".join(rng.choice(WORDS, n)) for n in (1, 2, 3, 7, 7, 9, 20, 60)]
    rows = [(d, "\n".join(rng.choice(stock, 3).tolist() + [text(100 + d, 6)])) for d in range(12)] + [(12, "  W1  w2\n\n\tw1 W2 "), (13, None), (14, " \n "), (15, text(3, 4000))]
    seen, want = set(), set()
    for d, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            key = tuple(line.lower().split())
            if key and key in seen:
                want.add((d, k))
            seen.add(key)
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, start int, kept int").repartition(3, "doc_id")
    got, of = set(), dict(rows)
    for r in substring_dedup.repeated_spans(df).collect():
        assert len(of[r.doc_id][r.start : r.end].split()) == r.n_words
        at = 0
        for k, line in enumerate(of[r.doc_id].split("\n")):
            if line.strip() and r.start <= at + len(line) - len(line.lstrip()) and at + len(line.rstrip()) <= r.end:
                got.add((r.doc_id, k))
            at += len(line) + 1
    assert got == want
    assert substring_dedup.repeated_spans(df.limit(0)).count() == 0


def test_remove_repeats_by_row(spark):
    """Null and repeated ids: each row loses its own spans, one copy of each line stays."""
    line, other = text(1, 30), text(2, 30)
    rows = [(1, line, "a"), (1, f"{other}\n{line}", "b"), (None, other, "c"), (None, f"only here\n{line}", "d"), (2, None, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string")
    got = {r.row: r.text for r in substring_dedup.remove_repeats(df.repartition(1)).collect()}
    kept = "\n".join(t or "" for t in got.values())
    assert kept.count(line) == 1 and kept.count(other) == 1 and "only here" in got["d"] and got["e"] is None and len(got) == 5


def test_repeated_spans_equal_shared_windows(spark):
    rng = np.random.default_rng(5)
    word = lambda lo, hi: f"w{rng.integers(lo, hi)}"
    low, names, greek = ([w(k) for k in rng.integers(0, 3000, 80)] for w in (lambda k: f"p{k}", lambda k: f"Na{'abcdefgh'[k % 8]}{'xyz'[k % 3]}{'ijklmnop'[k // 400]}", lambda k: "αβγδεζηθ"[k % 8] * 2 + "κλμνξοπρ"[k // 400] + "στυφχψω"[k % 7]))
    rows = []
    for k, passage in enumerate((low, names, greek)):
        for c in range(6):  # other surroundings, other lengths before it
            rows.append((k * 6 + c, " ".join([*(word(0, 9999) for _ in range(20 + c)), *passage, *(word(0, 9999) for _ in range(25))])))
    rows += [(50, " ".join(word(0, 9999) for _ in range(300))), (51, "ha " * 90), (52, None), (53, " \n "), (54, "Mixed:\u00a0" + "ha " * 70)]
    seen, want = {}, set()
    for d, t in rows:  # brute force: windows of 50 words seen in an earlier document
        w = (t or "").lower().split()
        for k in range(len(w) - 49):
            if seen.setdefault(tuple(w[k : k + 50]), d) != d:
                want.add(d)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring_dedup.repeated_spans(df).collect()
    assert want == {*range(1, 6), *range(7, 12), *range(13, 18), 54} and {r.doc_id for r in got} == want | {51}  # 51 repeats itself
    text_of = dict(rows)
    for r in got:
        cut = text_of[r.doc_id][r.start : r.end]
        assert len(cut.split()) == r.n_words and (r.doc_id > 50 or set(cut.split()) <= {*low, *names, *greek} and r.n_words >= 50)


def test_html():
    page = "<html><head><title>t</title></head><body><nav><a href=x>Menu</a></nav><article><h1>A &amp; B</h1><p>So.<p>More <b>te</b>xt</article><div class='comments'><p>I like it a lot</div><footer>f"
    assert html_main.main_text(page) == "A & B So. More text" and html_main.main_text(None) == ""


LONG = "It is the way of the world that what was said in the house was not for us to know, and so we went."


@pytest.mark.parametrize(
    "page,want",
    [
        (f"<body><div class=top><a href=1>Home</a> <a href=2>News</a></div><div><h2>Title</h2><p>{LONG}</p><p>Short.</p></div><div><a href=3>More</a></div>", f"Title {LONG} Short."),
        (f"<p>{LONG}</p><!-- <script> --><p>Second part</p><!-- <style> -->", f"{LONG} Second part"),
        (f"<article><h1 class='header'>T</h1><p class='notice'>{LONG}</p><div class='comment-body'><p>{LONG}</p></div><div class='side-bar'>x</div></article>", f"T {LONG}"),
        (f"<div class='has-sidebar'><p>{LONG}</p></div><div class='cookie-banner'><p>{LONG}</p></div>", LONG),
        (f"<p>{LONG}</p><p>{'xyzzy plugh ' * 30}</p>", f"{LONG} {('xyzzy plugh ' * 30).strip()}"),
        ("<article>one<p>two</article><footer>three</footer>", "one two"),
        ("<p>only this</p>", "only this"),
        ("<script>if (a < b) { '<p>' }</script>", ""),
        ("<p>a &amp;lt; b &#233;&nbsp;\n c<p>unclosed <b", "a &lt; b é c unclosed"),
    ],
)
def test_html_by_density(page, want):
    assert html_main.main_text(page) == want


def test_html_deep_pages_and_tables(spark):
    assert len(html_main.main_text("<div><b>" * 20000 + f"<p>{LONG}" * 2000 + "</i></div>" * 20000)) == 2000 * (len(LONG) + 1) - 1
    rows = [(1, "u", f"<p>{LONG}", 7), (1, "u", f"<p>{LONG}", 7), (None, None, None, 8), (2, "v", "", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = sorted(map(tuple, html_main.extract(pages).select(F.coalesce("page_id", F.lit(-1)), "text", "n_chars").collect()))
    assert got == [(-1, "", 0), (1, LONG, len(LONG)), (1, LONG, len(LONG)), (2, "", 0)]
    assert html_main.extract(pages.limit(0)).count() == 0


@needs_tables
def test_html_equals_the_articles(spark):
    """A plain reading of the markup; without the article tags the density rules find the same."""
    pages = table(spark, SF, "pages")
    got = {r.page_id: r.text for r in html_main.extract(pages).collect()}
    bare = {r.page_id: r.text for r in html_main.extract(pages.withColumn("html", F.regexp_replace("html", r"(?i)<(/?)article\b[^>]*>", "<$1div>"))).collect()}
    for r in pages.collect():
        inner = re.search(r"<article[^>]*>(.*?)(?:</article>|\Z)", r.html, re.S)[1]
        want = " ".join(entities.unescape(re.sub(r"<[^>]*>", " ", inner)).split())
        assert got[r.page_id].split() == want.split() and bare[r.page_id] == got[r.page_id]


def test_classifiers(spark):
    rows = [(i, ("rotten " if i % 3 == 0 else "lovely ") + text(i, 20)) for i in range(300)] + [(900, None), (901, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    y = spark.createDataFrame([(i, int(i % 3 != 0), int(i % 3 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    for got, label in ((quality.quality(d, y), lambda i: i % 3 != 0), (toxicity.toxicity(d, y), lambda i: i % 3 == 0)):
        held = [r for r in got.collect() if r.held_out and r.doc_id < 300]
        assert np.mean([(r.score >= 0.5) == label(r.doc_id) for r in held]) > 0.8
    assert quality.quality(d, y.limit(0)).where("score = 0.5").count() == 302


def test_top_k(spark):
    v = np.random.default_rng(2).normal(0, 1, (300, 8)).round(1)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)] + [(1000, None), (1001, [float("nan")] * 8)], "vec_id long, embedding array<double>")
    got = topk.top_k(topk.scaled(df), F.col("vec_id") % 20 == 0).toPandas()
    m = np.floor(64 * v).astype(int)
    for q, g in got.groupby("query_id"):
        s = m @ m[q]
        want = [k for k in np.lexsort((np.arange(300), -s)) if k != q][:20]
        assert g.sort_values("rank").vec_id.tolist() == want


def best(rows, k):
    """Brute force: rows of (vec_id, vector) and their k best for every 20th id."""
    out = set()
    for q, x in rows:
        if q % 20 == 0:
            all_ = sorted((-sum(a * b for a, b in zip(x, y)), v) for v, y in rows if v != q and len(y) == len(x))
            out |= {(q, r + 1, v, -s) for r, (s, v) in enumerate(all_[:k])}
    return out


def test_top_k_cases(spark):
    """Ties, vectors of several lengths, empty ones, repeated vectors, few candidates, an empty table, other columns."""
    rng = np.random.default_rng(8)
    rows = [(i, rng.integers(-2, 3, 3).tolist()) for i in range(200)] + [(i, rng.integers(-9, 9, 5).tolist()) for i in range(200, 206)] + [(i, []) for i in range(218, 224)] + [(300, [1 << 40, 5, 1 << 40, 0])] + [(301, [-3, 1 << 40, 7, 2])]
    df = spark.createDataFrame([(i, x, 1) for i, x in rows], "vec_id long, q array<long>, score int")
    assert {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, 4).collect()} == best(rows, 4)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@needs_tables
def test_top_k_equals_brute_force(spark):
    vectors = topk.scaled(table(spark, SF, "embeddings"))
    rows = [(r.vec_id, np.array(r.q)) for r in vectors.collect()]
    m, ids, want = np.array([x for _, x in rows]), np.array([i for i, _ in rows]), set()
    for q, x in rows:
        if q % 20 == 0:
            s = m @ x
            order = [k for k in np.lexsort((ids, -s)) if ids[k] != q][:20]
            want |= {(q, r + 1, int(ids[k]), int(s[k])) for r, k in enumerate(order)}
    assert {tuple(r) for r in topk.top_k(vectors, F.col("vec_id") % 20 == 0).collect()} == want


def test_top_k_stops(spark):
    """Where one dimension carries the scores, the bound stops the reading early."""
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.integers(0, 100_000, (4000, 1)), rng.integers(-1, 2, (4000, 3))], 1)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id long, q array<long>")
    r = topk.effort(df, F.col("vec_id") == 0, 10).first()
    assert r.n_rows == 4000 and r.depth < 500 and r.n_scored < 2000


def test_pii_learns_by_rounds_and_redacts_by_row(spark):
    """A second context is known only by values that the first one taught; null and repeated ids keep their own spans."""
    rows = [(-2, f"please mail me a{k}@x.org, now") for k in range(40)]
    rows += [(10, f"please mail me q{k}-x, now") for k in range(8)] + [(20, f"the staff code q{k}-x is his") for k in range(8)]
    rows += [(30, "the staff code z9 is his"), (None, "the staff code z9 is his"), (30, "nothing here 5"), (31, None), (31, "w" * 70 + " z9")]
    df = spark.createDataFrame([(d, t, 0, "r") for d, t in rows], "doc_id long, text string, row int, found string")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.text or "", r.row, r.found) for r in pii.redact(df).collect() if r.doc_id is None or r.doc_id >= 30)
    assert got == sorted([(30, "the staff code [EMAIL] is his", 0, "r"), (-1, "the staff code [EMAIL] is his", 0, "r"), (30, "nothing here 5", 0, "r"), (31, "", 0, "r"), (31, "w" * 70 + " [EMAIL]", 0, "r")])
    assert pii.redact(df.limit(0)).count() == 0 and pii.find(df.limit(0)).count() == 0


def test_shared_folder_on_a_cluster():
    class Session:
        class sparkContext:
            master = "spark://h:7077"

            class _jsc:
                sc = staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))}))

        class conf:
            get = staticmethod(lambda k, d: d)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)


@needs_tables
def test_decontamination_equals_shared_windows(spark):
    """Over the whole small tables: the pairs of a document and an item that share eight words in a row."""
    d, b = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    windows = lambda t: (lambda w: {tuple(w[k : k + 8]) for k in range(len(w) - 7)})(re.findall(r"\w+", (t or "").lower()))
    of = {}
    for r in b.collect():
        for w in windows(r.text):
            of.setdefault(w, set()).add(r.item_id)
    want = {(r.doc_id, i) for r in d.collect() for w in windows(r.text) for i in of.get(w, ())}
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(d, b).collect()} == want


@needs_tables
@pytest.mark.parametrize("gap", [5, 9])
def test_decontamination_finds_new_parameters(spark, gap):
    """Items get a number or a name about every gap words; the documents have them with other numbers and names."""
    rng = np.random.default_rng(gap)
    items = table(spark, SF, "benchmark").orderBy("item_id").collect()
    around = [r.text.split() for r in table(spark, SF, "documents").orderBy("doc_id").limit(60).collect() if r.text]
    number = lambda: str(rng.integers(2, 900))
    name = lambda: rng.choice(list("BCDFGKLMN")) + "".join(rng.choice(list("aeioulmnr"), 5))
    asked, rows = [], []
    for r in items:
        w = r.text.split()
        v = list(w)
        for k in range(int(rng.integers(2, gap)), len(w), gap):
            if not w[k - 1].endswith((".", "?", "!", ":")):
                new = number if rng.random() < 0.5 else name
                w[k], v[k] = new(), new()
        f = around[rng.integers(len(around))]
        k = rng.integers(len(f) + 1)
        asked.append((r.item_id, " ".join(w)))
        rows.append((r.item_id, " ".join([*f[:k], "so.", *v, *f[k:]])))
    got = decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(asked, "item_id long, text string")).collect()
    assert len({r.doc_id for r in got if r.doc_id == r.item_id}) >= 0.9 * len(items)


def test_decontamination_cases(spark):
    """Null and repeated ids, repeated items of other texts, empty tables, long texts, other columns."""
    item = "which gas do the plants of the wood take from the air around them by day"
    docs = [(None, item), (1, item), (1, "nothing"), (1, item), (2, None), (3, ""), (4, text(4, 20000) + " " + item)]
    d = spark.createDataFrame([(i, t, 7, 1) for i, t in docs], "doc_id long, text string, item_id int, pos int")
    b = spark.createDataFrame([(5, item, 0), (5, text(77, 30), 0), (6, item, 0), (7, None, 0)], "item_id long, text string, hash int")
    assert sorted((r.doc_id or -1, r.item_id) for r in decontam.contaminated(d, b).collect()) == [(-1, 5), (-1, 6), (1, 5), (1, 6), (4, 5), (4, 6)]
    assert decontam.contaminated(d.limit(0), b).count() == 0 and decontam.contaminated(d, b.limit(0)).count() == 0


ODD = [None, "", " ", "one", "ha ha ha", "Ünïcode — x_y", "a\tb\x0bc d", "!!! ??", "W1 w1 " * 3000]


@needs_tables
def test_quality_scores_equal_plain_python(spark):
    """Every small document's score from its hashed tokens and pairs, one by one."""
    docs = table(spark, SF, "documents")
    model = quality.fit(docs, table(spark, SF, "labels"))
    texts = [r.text for r in docs.collect()] + ODD
    for t, got in zip(texts, model.scores(pa.array([x or "" for x in texts]))):
        low = re.sub(r"[\t\n\f\r ]+", " ", pc.utf8_lower(pa.scalar(t or "")).as_py())
        h = [zlib.crc32(w.encode()) for w in regex.findall(r"[\p{L}\p{N}]+|[^\p{L}\p{N} ]+", low)]
        keys = [*h, *(quality.REPEATED if a == b else a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F for a, b in zip(h, h[1:]))]
        n = Counter((k * 0xFF51AFD7ED558CCD % 2**64) >> (64 - quality.BITS) for k in keys)
        z = model.bias + sum(np.sqrt(c) * float(model.weights[k]) for k, c in n.items()) / np.sqrt(max(1, sum(n.values())))
        assert got == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6)


@needs_tables
def test_toxicity_scores_equal_plain_python(spark):
    """Every small document's score as the softmax of the mean over its words' n-grams, one by one."""
    docs = table(spark, SF, "documents")
    model = toxicity.fit(docs, table(spark, SF, "labels"), "toxic")
    texts = [r.text for r in docs.collect()] + ODD
    for t, got in zip(texts, model.scores(pa.array([x or "" for x in texts]))):
        grams = [g for w in regex.findall(r"[\p{L}\p{N}]+", pc.utf8_lower(pa.scalar(t or "")).as_py()) for g in toxicity.buckets_of(w)]
        z = model.bias + (float(np.mean(model.logits[grams], dtype=np.float64)) if grams else 0.0)
        assert got == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6)


def test_classifier_cases(spark):
    """Ties, repeated and null ids, null labels, one class, empty tables, other columns."""
    rows = [(1, "good old words", 5), (1, "good old words", 6), (2, None, 7), (None, "bad new marks", 8), (3, text(3, 20000), 9)]
    d = spark.createDataFrame(rows, "doc_id long, text string, score int")
    y = spark.createDataFrame([(1, 1, 0), (3, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    for run in (quality.quality, toxicity.toxicity):
        got = run(d, y).collect()
        assert len(got) == 5 and set(got[0].asDict()) == {"doc_id", "held_out", "score", "predicted"} and all(0 < r.score < 1 and r.predicted == int(r.score >= 0.7) for r in got)
        assert len({r.score for r in got if r.doc_id == 1}) == 1
        assert run(d.limit(0), y).count() == 0 and {r.score for r in run(d, y.limit(0)).collect()} == {0.5}


def test_near_duplicate_cases(spark):
    """Null and repeated ids, empty and one-word texts, a chain, a large group of copies, other columns."""
    base = [f"v{k}" for k in range(60)]
    chain = [" ".join([*base[k:], *(f"z{j}" for j in range(k))]) for k in range(0, 21, 3)]
    rows = [(100 + k, t) for k, t in enumerate(chain)] + [(200 + k, "the same text of a few words") for k in range(300)] + [(5, "one"), (6, "ONE"), (7, None), (8, " \t"), (None, "one"), (9, "x y"), (9, "x y"), (10, text(10, 20000)), (11, text(10, 20000) + " end")]
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, rep int, component int")
    got = near_dedup.near_duplicates(d, shingle=2).collect()
    of = {r.doc_id: r.component_id for r in got}
    assert len(got) == len(rows) and {of[100 + k] for k in range(len(chain))} == {100} and {of[200 + k] for k in range(300)} == {200}
    assert (of[5], of[6], of[7], of[8], of[None], of[9], of[10], of[11]) == (5, 5, 7, 8, None, 9, 10, 10)
    assert sum(r.kept for r in got if r.doc_id == 9) == 2 and [r.kept for r in got if r.doc_id is None] == [True]


def test_packing_cases(spark):
    """Null and repeated ids, equal lengths, empty and very long texts, an empty table, other columns."""
    rows = [(None, None, 1), (None, None, 2), (4, "", 3), (4, "a b", 4), (4, "a b", 5), (-(1 << 63), text(5, 9000), 6)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string, piece int")).toPandas()
    assert got.doc_id.isna().sum() == 2 and (got[got.doc_id == -(1 << 63)].sort_values("piece").length.to_numpy()[:-1] == 4096).all()
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.length.sum() <= 4096 and g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]]
