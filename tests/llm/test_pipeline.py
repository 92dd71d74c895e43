"""The pipeline's stages on a small table, each against a plain version of its decision."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandweave.llm import simhash
from tests.llm.test_operators import WORDS, groups, lowered, removed


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    path = str(tmp_path_factory.mktemp("tables"))
    line = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(500)) for _ in range(n))
    passage, item = line(60), line(30)
    rows = []
    for i in range(300):
        t = line(rng.randrange(30, 90))
        if i % 6 == 0:
            t = " ".join(x.upper() + "!!" for x in t.split())
        if i % 7 == 1:
            t += "\n" + passage
        if i % 11 == 2:
            t = t + " " + item + " " + line(20)
        if i % 13 == 3 and rows:
            t = rows[-1][1]
        rows.append((i, t, "en", "s", len(t)))
    rows += [(1000, None, "en", "s", 0), (1001, "", "en", "s", 0), rows[20]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 > 0), 0) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, "nothing like it " * 5)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, passage, item


def test_stages(spark, folder):
    path, passage, item = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [n.split()[0] for n in stages] == ["quality", "SimHash", "suffix-array", "benchmark", "packing"]
    good = stages["quality classifier"](spark, docs, path).persist()
    kept = {r.doc_id: r.text for r in good.collect()}
    assert good.columns == docs.columns
    clean = {i for i in range(300) if not (kept.get(i) or "x!!").endswith("!!")}
    assert len(clean) >= 235
    once = stages["SimHash near-dedup"](spark, good, path).persist()
    prints = {i: simhash.wide_fingerprints(pa.array([t]), 5)[0] for i, t in kept.items()}
    want = groups(sorted(kept), lambda a, b: int(np.bitwise_count(prints[a] ^ prints[b]).sum()) <= 45)
    assert sorted(r.doc_id for r in once.collect()) == sorted(set(want.values()))
    cut = stages["suffix-array dedup"](spark, once, path).persist()
    rows = once.orderBy("doc_id").collect()
    texts = {r.doc_id: (r.text if not spans else keep.decode(errors="ignore")) for r, (keep, spans) in zip(rows, removed([r.text for r in rows]), strict=True)}
    got = {r.doc_id: r for r in cut.collect()}
    assert {i: r.text for i, r in got.items()} == {i: t for i, t in texts.items() if t is None or t.strip(" ") or not dict((r.doc_id, r.text) for r in rows)[i]}
    assert all(r.n_chars == len(r.text or "") for r in got.values())
    assert sum(passage in (r.text or "") for r in got.values()) <= 1
    last = stages["benchmark decontamination"](spark, cut, path).persist()
    window = " ".join(lowered(item)[:8])
    assert last.columns == docs.columns and not any(window in " ".join(lowered(r.text)) for r in last.collect())
    untouched = {i: r.text for i, r in got.items() if not re.search("|".join(re.escape(" ".join(lowered(item)[k : k + 8])) for k in range(20)), " ".join(lowered(r.text)))}
    assert {r.doc_id: r.text for r in last.collect() if r.doc_id in untouched} == untouched
    pieces = stages["packing"](spark, last, path)
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in last.collect()}


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder[0])
    assert out.agg(F.sum("length")).first()[0] > 0
    assert corpus_pipeline.ORACLE_SQL is None


CLASHING = "quality_score string, repeats string, hits int, stays int, w0 string, id string, label int, n string"


def test_empty_tables_and_clashing_columns(spark, folder, tmp_path):
    path = str(tmp_path)
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, " + CLASHING)
    for name, rows in (("documents", empty), ("labels", spark.createDataFrame([], "doc_id long, quality int, toxic int")), ("benchmark", spark.createDataFrame([], "item_id long, text string"))):
        rows.write.parquet(f"{path}/{name}.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    more = docs.select("*", *[F.lit(k).cast(x.split()[1]).alias(x.split()[0]) for k, x in enumerate(CLASHING.split(", "))])
    more = more.union(more.where("doc_id = 1").withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.lit("words of a text without an id")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain = stage(spark, docs, folder[0]).persist()
        got = stage(spark, more, folder[0]).persist()
        assert got.columns == more.columns, name
        assert sorted(got.where("doc_id is not null").select("doc_id", "text").collect(), key=str) == sorted(plain.select("doc_id", "text").collect(), key=str), name
        assert got.where("w0 = '4' and label = 6").count() == got.count()


def test_all_texts_null(spark, folder):
    docs = spark.createDataFrame([(i, None, None, None, None) for i in range(5)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [stage(spark, docs, folder[0]).count() for _, stage in corpus_pipeline.STAGES[1:4]]
    assert kept == [1, 5, 5]
