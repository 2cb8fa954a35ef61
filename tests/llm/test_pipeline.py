"""Every stage of the pipeline against plain Python on the small test tables."""

import re
from collections import defaultdict
from pathlib import Path

import pyarrow as pa
import pytest
from faultspark.llm import quality, tokens
from faultspark.llm.common import crc_mod, staged, table
from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def shingles(text, n=5):
    w = [x.lower() for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def smallest_of_groups(sets):
    lowest = {d: d for d in sets}
    links = defaultdict(set)
    for a, x in sets.items():
        for b, y in sets.items():
            if a < b and x and y and 100 * min(len(x), len(y)) >= 80 * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= 80 * (len(x) + len(y) - both):
                    links[a].add(b)
                    links[b].add(a)
    for d in sorted(sets):
        todo = [d]
        while todo:
            for other in links[todo.pop()]:
                if lowest[other] > lowest[d]:
                    lowest[other] = lowest[d]
                    todo.append(other)
    return sorted(d for d, low in lowest.items() if d == low)


def windows(text, n):
    w = re.findall(r"\w+", (text or "").lower())
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}


@pytest.mark.skipif(not Path(SF).is_dir(), reason="no test tables")
def test_stages_equal_plain_python(spark):
    stage = dict(corpus_pipeline.STAGES)
    run = lambda name, d: staged(stage[name](spark, d, SF), name)
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    docs = table(spark, SF, "documents")
    rows = docs.collect()

    good = run("quality", docs)
    model = quality.fit(docs, table(spark, SF, "labels").where(crc_mod(F.col("doc_id"), 4) != 2))
    scores = list(model.scores(pa.array([r.text or "" for r in rows])))
    assert ids(good) == sorted(r.doc_id for r, s in zip(rows, scores) if s >= corpus_pipeline.REJECT_BELOW)
    assert good.columns == docs.columns

    single = run("near_dedup", good)
    assert ids(single) == smallest_of_groups({r.doc_id: shingles(r.text) for r in good.collect()})

    clean = run("decontamination", single)
    asked = set().union(*(windows(r.text, 13) for r in table(spark, SF, "benchmark").collect()))
    leaked = {r.doc_id for r in single.collect() if windows(r.text, 13) & asked}
    assert leaked <= set(ids(single)) - set(ids(clean))

    private = run("pii", clean)
    assert ids(private) == ids(clean) and private.columns == docs.columns
    assert all(r.text is None or (not EMAIL.search(r.text) and r.n_chars == len(r.text)) for r in private.collect())

    packed = run("packing", private).toPandas()
    encoder = tokens.Encoder(tokens.vocabulary_path(), most=1000).tokenizer
    want = {r.doc_id: len(encoder.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in private.collect()}
    assert packed.groupby("doc_id").length.sum().to_dict() == want
    for _, g in packed.sort_values("offset").groupby("sequence_id"):
        assert g.length.sum() <= 4096 and g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]]
    assert packed.sequence_id.nunique() <= sum(want.values()) / 4096 * 1.05 + 2


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows and ids, an empty table; every stage keeps the columns and loses only what it should."""
    good = "It was the best of the times that we had in the old town, and so it was for all of them who came with us to see it."
    item = "which gas do the plants of the wood take from the air around them by day"
    rows = [(1, good), (1, good), (2, good + " " + item), (None, "see " + item), (None, None), (3, ""), (4, None), (5, "mail a@b.org " + good), (6, (good + " ") * 400), (None, "mail c@d.org please")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(d, t, "en", None, len(t or "")) for d, t in rows], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, item) for k in range(2)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    stage, sf = dict(corpus_pipeline.STAGES), str(tmp_path)
    docs = table(spark, sf, "documents")
    n = lambda df: df.count()
    scored = staged(stage["quality"](spark, docs, sf), "q")
    assert scored.columns == docs.columns and n(scored) == 10  # no labels: every score is 0.5
    single = staged(stage["near_dedup"](spark, docs, sf), "n")
    assert single.columns == docs.columns and n(single) == 8 and n(single.where("doc_id = 1")) == 2  # 5 and 6 are near 1
    clean = staged(stage["decontamination"](spark, docs, sf), "d")
    assert clean.columns == docs.columns and n(clean) == 8 and n(clean.where(F.col("text").contains("plants"))) == 0
    private = staged(stage["pii"](spark, docs, sf), "p")
    assert private.columns == docs.columns and n(private) == 10 and n(private.where(F.col("text").contains("@"))) == 0 and n(private.where("text is null")) == 2
    assert n(private.where("text is not null and n_chars != length(text)")) == 0
    packed = stage["packing"](spark, docs, sf)
    assert n(packed.select("doc_id", "piece")) >= 10
    for name in stage:
        assert n(stage[name](spark, docs.limit(0), sf)) == 0, name
