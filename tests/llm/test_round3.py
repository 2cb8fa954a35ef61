"""Resampling, collocations and near-duplicate vectors against plain Python, and on odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from faultspark.llm import collocations, embedding_dedup, resampling, substring_dedup
from pyspark.sql import functions as F

DOC = "doc_id long, text string, lang string, score string"


def crowd(seed, n, vocabulary=25):
    return " ".join(f"W{k}" for k in np.random.default_rng(seed).zipf(1.5, n) % vocabulary)


@pytest.fixture(scope="module")
def rows():
    base = [(k, crowd(k, 60) + (". " if k % 3 else "\t") + crowd(k // 4, 40), "en" if k % 5 else None, "clash") for k in range(60)]
    long = " ".join(crowd(900 + k, 400) + ("," if k % 7 else "") for k in range(40))
    odd = [(60, None, "en", ""), (61, "", "en", ""), (62, "ÄB Äb äb; naïve_x 7\x00\x01a", "fr", ""), (None, crowd(5, 30), "en", ""), (63, long, "de", ""), (64, "... ,,", None, ""), (3, base[3][1], "en", "")]
    return base + odd + [(100 + k, crowd(1, 50), "en", "copy") for k in range(30)]


def brute_resample(rows, target, n, buckets=10_000, percent=10, least=20):
    def of(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    docs, s, t = [(r[0], *of(r[1])) for r in rows], Counter(), Counter()
    for _, _, f in docs:
        s.update(f)
    for text in target:
        t.update(of(text)[1])
    total = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total[0] + buckets) / ((s[b] + 1) * (total[1] + buckets))))
    out = []
    for doc, words, f in docs:
        weight = sum(map(gain, f))
        score = None if doc is None else weight + math.floor(-1000 * math.log(-math.log((int(hashlib.sha256(f"2024:{doc}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296)))
        out.append([doc, len(f), weight, score, None, words])
    able = sorted((r for r in out if r[0] is not None and r[5] >= least), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in out)


@pytest.mark.parametrize("n,percent", [(1, 10), (3, 40)])
def test_resampling_equals_plain_python(spark, rows, n, percent):
    docs = spark.createDataFrame(rows, DOC)
    target = [crowd(3, 30), None, "w1 w2 W3 other", ""]
    got = resampling.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), n=n, percent=percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {f.dataType.typeName() for f in got.schema} == {"long"}
    assert Counter(map(tuple, got.collect())) == brute_resample(rows, target, n, percent=percent)


def test_resampling_of_nothing(spark, rows):
    docs, none = spark.createDataFrame(rows, DOC), spark.createDataFrame([], "text string")
    assert resampling.resample(docs.limit(0), none).count() == 0
    assert Counter(map(tuple, resampling.resample(docs, none).collect())) == brute_resample(rows, [], 1)
    few = resampling.resample(docs.where("doc_id < 5"), none, percent=10).collect()
    assert len(few) == 6 and all(r["rank"] is None for r in few)  # a tenth of six documents is none


def brute_collocations(rows, least, cover=80, top=2000):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f[lang].update(tuple(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        candidates = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = {p[i:j] for p, a in candidates.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * a >= cover * c[p[i:j]]}
        scored = []
        for p, a in candidates.items():
            if p not in inside:
                score, k = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, k + 1, p.decode(), -a, left, right, n[lang], -score) for k, (score, a, p, left, right) in enumerate(sorted(scored)[:top])]
    return sorted(out)


@pytest.mark.parametrize("run,part,step,least,top", [(1 << 20, 1 << 20, 1 << 10, 5, 2000), (3000, 700, 150, 4, 2000), (3000, 700, 150, 12, 7)])
def test_collocations_equal_plain_python(spark, rows, monkeypatch, run, part, step, least, top):
    """Also with runs and ranges so short that phrases and their parts stand in other ranges."""
    for name, value in (("RUN", run), ("PART", part), ("STEP", step)):
        monkeypatch.setattr(collocations, name, value)
    got = collocations.collocations(spark.createDataFrame(rows, DOC), least=least, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute_collocations(rows, least, top=top)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 20
    assert collocations.collocations(spark.createDataFrame(rows, DOC).limit(0)).count() == 0


def test_runs_cut_where_ranges_begin():
    texts = pa.array(["b a b a. a a", "c", "", "a b"])
    cols, words = collocations.windows(texts)
    assert words.to_pylist() == [b"a", b"b", b"c"] and len(cols[0]) == 9
    cols, amount = collocations.tally(cols, np.ones(9, np.int64))
    shown = [tuple(words[int(x) - 1].as_py().decode() for x in w if x) for w in zip(*cols)]
    assert shown == sorted(shown) and dict(zip(shown, amount.tolist()))[("a",)] == 2
    for cut in ((b"a", b"b"), (b"aa",), (b"b", b"a", b"b", b"a"), (b"",), (b"zz", b"a"), (b"b", b"c")):
        assert collocations._cut(cols, words, cut) == sum(s < tuple(w.decode() for w in cut) for s in shown)
    long, names = collocations.windows(pa.array([" ".join(f"v{k}" for k in range(70000))]))
    long, codec = collocations.tally(long, np.ones(70000, np.int64))[0], pa.Codec("zstd")
    packed = collocations._packed(long, np.ones(70000, np.int64), names, codec)
    back, ones = collocations._unpacked(*packed[1:], codec)
    assert packed[1] == "<u4" and all((a == b).all() for a, b in zip(back, long)) and ones.sum() == 70000


def brute_vectors(rows, threshold=0.95):
    good = {k: np.array(v, float) for k, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    links = {(a, b) for a in good for b in good if a != b and len(good[a]) == len(good[b]) and good[a] @ good[b] / math.sqrt(good[a] @ good[a]) / math.sqrt(good[b] @ good[b]) >= threshold}
    of = {k: rows[k][0] for k in range(len(rows))}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(of[a], of[b])
            changed |= low != of[a] or low != of[b]
            of[a] = of[b] = low
    return {(rows[k][0], sum(a == k for a, _ in links), of[k], rows[k][0] is None or of[k] == rows[k][0]) for k in range(len(rows))}


def test_near_duplicate_vectors(spark, monkeypatch):
    """Copies, tight groups, chains whose ends are no pair, odd vectors; blocks of a few rows."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 5)
    rng = np.random.default_rng(4)
    base = rng.standard_normal((6, 16))
    vectors = [*rng.standard_normal((60, 16)), *(base[0] + 0.02 * rng.standard_normal((30, 16))), *(base[1] + 0.25 * rng.standard_normal((40, 16)))]
    a, b = base[2] / np.linalg.norm(base[2]), base[3] - base[3] @ base[2] * base[2] / (base[2] @ base[2])
    b /= np.linalg.norm(b)
    vectors += [math.cos(0.2 * k) * a + math.sin(0.2 * k) * b for k in range(12)] + [base[4]] * 9 + [3 * base[4]]
    rows = [(1000 - k, [float(np.float32(x)) for x in v]) for k, v in enumerate(vectors)]
    rows += [(1, None), (2, []), (3, [0.0] * 16), (4, [math.nan] + [1.0] * 15), (5, [math.inf] + [1.0] * 15), (6, [None] + [1.0] * 15), (None, rows[60][1]), (7, [1.0, 2.0]), (8, [-2.0, 4.0]), (9, [1.1, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("kept", F.lit("clash"))
    got = embedding_dedup.near_duplicate_vectors(df).collect()
    assert len(got) == len(rows) and {tuple(r) for r in got} == brute_vectors(rows)
    assert embedding_dedup.near_duplicate_vectors(df.limit(0)).count() == 0


def test_passes_and_sketches():
    assert embedding_dedup.n_passes(10, 0.95) == 4 and embedding_dedup.n_passes(10**5, 0.95) < embedding_dedup.n_passes(10**7, 0.95) < 100
    most, p = embedding_dedup.most_differing(0.95), math.acos(0.95) / math.pi
    tail = sum(math.comb(256, k) * p**k * (1 - p) ** (256 - k) for k in range(most + 1, 257))
    assert tail <= embedding_dedup.MISS < tail + math.comb(256, most) * p**most * (1 - p) ** (256 - most)


def test_repeated_lines_of_any_length(spark):
    """Whole lines of one word, of seven, of sixteen with a cut inside and of many whose words stand in two documents; the earliest stays."""
    words = [f"u{k}" for k in range(400)]
    seven, sixteen, long = " ".join(words[:7]), " ".join(words[20:36]), " ".join(words[40:80])
    rows = [
        (5, f"{seven}\n{' '.join(words[300:330])}"), (2, f"own words here\n  {seven.upper()} \r\n\nEn."), (7, f"En.\n{sixteen}\n{long}"), (1, f"{long}\nand {sixteen} again"), (9, f"{sixteen}\n\n{long}\nlast"),
        (None, "En."), (None, "\tEN. "), (3, None), (4, ""), (8, f"alone\n{seven}"), (8, f"alone\n{seven}"),
    ]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, row string")
    seen, want = {}, Counter()
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        at = 0
        for k, line in enumerate((t or "").split("\n")):
            key = tuple(line.lower().split())
            if key and key in seen:
                left = at + len(line) - len(line.lstrip())
                want[i, k, left, left + len(line.strip()), len(key), *seen[key]] += 1
            elif key:
                seen[key] = i, k
            at += len(line) + 1
    got = substring_dedup.repeated_lines(df).drop("row").collect()
    assert Counter(map(tuple, got)) == want and sum(want.values()) >= 9
    spans = substring_dedup.repeated_spans(df, passage=substring_dedup.PASSAGE).collect()
    inside = lambda i, a, b: any(s.doc_id == i and s.start <= a and b <= s.end for s in spans)
    assert all(inside(i, a, b) for i, _, a, b, *_ in want)
    assert {(s.doc_id, s.is_passage) for s in spans if s.n_words == 7} >= {(5, 0)} and all(s.is_passage == (s.longest >= 17) for s in spans)
    assert substring_dedup.repeated_lines(df.limit(0)).count() == 0 and all(r.n_words > 6 for r in substring_dedup.repeated_lines(df, min_words=7).collect())


def test_pii_in_long_texts(spark):
    """Spans and labels across pieces of text and blocks of matches, with characters of four bytes and spans that overlap, against plain Python."""
    from faultspark.llm import pii

    rng = np.random.default_rng(3)
    parts = ["a.b@x.org", "1.2.3.4", "+1 (212) 555-7713", "4111 1111 1111 1111", "+4111 1111 1111 11", "😀", "é" * 40, "no. 5", "w" * 300, "x@y.zz" + "q" * 270]
    texts = [" ".join(parts[k] for k in rng.integers(0, len(parts), n)) for n in (1, 30, 900)] + [" ".join(f"{k}@x.org" for k in range(700)), "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r.doc_id: [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)] for r in pii.find(df).collect()}
    assert len(spans[3]) == 700 and sum(map(len, spans.values())) > 1000
    for r in pii.redact(df).collect():
        at, want, text = 0, "", texts[r.doc_id] or ""
        for kind, a, b in spans[r.doc_id]:
            if a >= at:
                want, at = f"{want}{text[at:a]}[{kind.upper()}]", b
        assert (r.text or "") == want + text[at:]
        for kind, a, b in spans[r.doc_id]:
            assert ("@" in text[a:b]) == (kind == "email") and text[a:b].strip() == text[a:b]
