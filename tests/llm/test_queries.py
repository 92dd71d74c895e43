"""The registered queries op1 to op10 themselves, columns and values, against plain versions of their contracts.

The tables hold nulls, empty and long texts, repeated texts, and extra columns whose names clash with those that the operators add.
"""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandweave.llm import media, pagediff, queries
from tests.llm.test_operators import fingerprint, groups, lowered, removed, texts

Q = {int(n[2:].split("_")[0]): f for n, f in queries.QUERIES.items()}
CLASH = "label int, score double, repeats string, contamination string, tokens string, fp long, part long, v string, host string, c0 string, added string"
BIG = "<p>" + "payload of many bytes, é " * 60 + "</p>"


def clashing(df):
    return df.select("*", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in CLASH.split(", ")])


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    some = texts(3, 80) + ["long tail " * 60_000, "MiXed Case the river", "two", "春眠不覚暁 naïve", "<|endoftext|> in a text"]
    return [(i, t) for i, t in enumerate(rng.sample(some, len(some)))]


@pytest.fixture(scope="module")
def items(rows):
    words = [lowered(t) for _, t in rows if len(lowered(t)) > 60]
    return [(k, " ".join(w[10 : 10 + 6 * (k % 5)])) for k, w in enumerate(words[:12])] + [(50, None), (51, ""), (52, "Nothing of the kind occurs here at all, ever")]


@pytest.fixture(scope="module")
def pages():
    article = lambda i: f"<html><body><nav>menu</nav><article><h1>T{i}</h1><p>own &amp; {i}</p></article><footer>f</footer></body></html>"
    out = [(i, f"http://h{i % 3}.example/a/{i}", article(i)) for i in range(20)]
    return out + [(30, "http://a/x", BIG), (31, "http://a/y", BIG), (32, None, BIG), (33, "u", None), (34, "u", ""), (35, "u", "short"), (36, "u", "short")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, rows, items, pages):
    path = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else None, "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    clashing(docs).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 4 and 1, int(i % 5 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    clashing(spark.createDataFrame(pages, "page_id long, url string, html string")).write.parquet(f"{path}/pages.parquet")
    return path


@pytest.fixture(scope="module")
def empty(spark, folder, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels", "benchmark", "pages"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.mark.parametrize("n", range(1, 11))
def test_empty_tables(spark, empty, n):
    assert Q[n](spark, empty).count() == 0


def got(spark, folder, n, columns):
    df = Q[n](spark, folder)
    assert dict(df.dtypes).items() >= columns.items()
    return df.collect()


@pytest.mark.parametrize(("n", "folds", "fold", "least"), [(1, 3, 1, 0.7), (9, 5, 0, 0.3)])
def test_scores(spark, folder, rows, n, folds, fold, least):
    out = got(spark, folder, n, {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"})
    assert sorted(r.doc_id for r in out) == [i for i, _ in rows]
    text = dict(rows)
    by_text = collections.defaultdict(set)
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == fold)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= least)
        by_text[text[r.doc_id] or ""].add(r.score)
    assert max(max(s) - min(s) for s in by_text.values()) < 1e-5


def test_held_out_labels_are_never_read(spark, folder, tmp_path, rows):
    for n, folds, fold in ((1, 3, 1), (9, 5, 0)):
        other = f"{tmp_path}/{n}"
        spark.read.parquet(f"{folder}/documents.parquet").write.parquet(f"{other}/documents.parquet")
        held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == fold
        labels = spark.read.parquet(f"{folder}/labels.parquet")
        labels.select("doc_id", *[F.when(held, 1 - F.col(c)).otherwise(F.col(c)).alias(c) for c in ("quality", "toxic")]).write.parquet(f"{other}/labels.parquet")
        scores = [sorted((r.doc_id, r.score) for r in Q[n](spark, f).collect()) for f in (folder, other)]
        assert scores[0] == scores[1]


def test_null_ids_are_in_no_fold(spark, folder, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").withColumn("doc_id", F.expr("if(doc_id % 9 = 0, null, doc_id)")).write.parquet(f"{tmp_path}/{name}.parquet")
    for n in (1, 9):
        out = Q[n](spark, str(tmp_path))
        assert out.where("doc_id is null").count() == out.where("doc_id is null and not held_out and score between 0 and 1").count() > 0


def test_op2(spark, folder, rows):
    out = {r.doc_id: r for r in got(spark, folder, 2, {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"})}
    for (i, t), (kept, spans) in zip(rows, removed([t for _, t in rows]), strict=True):
        size = len((t or "").encode())
        assert tuple(out[i])[1:5] == (size, size - len(kept), len(spans), hashlib.sha256(kept).hexdigest())


def test_op3(spark, folder, rows):
    kinds = {"n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"}
    out = {r.doc_id: r for r in got(spark, folder, 3, kinds)}
    features = collections.defaultdict(set)
    for i, t in rows:
        raw = (t or "").encode()
        data = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        stored = media.encode(data)
        want = (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(stored), hashlib.sha256(stored).hexdigest())
        assert tuple(out[i][c] for c in list(kinds)[:6]) == want and media.decode(stored) == data
        features[t or ""].add(out[i].feature)
    assert all(len(f) == 1 and None not in f for f in features.values())


def test_op4(spark, folder, pages):
    out = {r.page_id: tuple(r) for r in got(spark, folder, 4, {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"})}
    last = {}
    for i, _, h in pages:
        last[h or ""] = max(i, last.get(h or "", i))
    for i, _, h in pages:
        raw = (h or "").encode()
        again = len(raw) >= 1000 and last[h] != i
        assert out[i] == (i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", last[h] if again else None)


def test_op5(spark, folder, rows, items):
    out = {r.doc_id: r for r in got(spark, folder, 5, {"n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"})}
    windows = collections.defaultdict(set)
    for k, t in items:
        w = lowered(t)
        for a in range(max(1, len(w) - 7) if w else 0):
            windows[tuple(w[a : a + 8])].add(str(k))
    for i, t in rows:
        w, hit, found = lowered(t), set(), set()
        for size in {len(x) for x in windows}:
            for a in range(len(w) - size + 1):
                if (some := windows.get(tuple(w[a : a + size]))) is not None:
                    found |= some
                    hit |= set(range(a, a + size))
        r = out[i]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2)


def test_op6(spark, folder, rows):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = {r.doc_id: r for r in got(spark, folder, 6, {"n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"})}
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (out[i].n_bytes, out[i].n_tokens, out[i].over_limit) == (len((t or "").encode()), n, n > 2048)
    assert any(r.over_limit for r in out.values())


def test_op7(spark, folder, pages):
    out = {r.page_id: r for r in got(spark, folder, 7, {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"})}
    assert sorted(out) == [p[0] for p in pages]
    for i, url, h in pages:
        want = f"T{i}\nown & {i}" if i < 20 else "\n".join(pagediff.lines(h)[0])
        assert (out[i].url, out[i].text, out[i].n_chars) == (url, want, len(want))


def test_op8(spark, folder, rows):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    kinds = dict.fromkeys(("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"), "bigint")
    pieces = got(spark, folder, 8, kinds)
    of = collections.defaultdict(list)
    sequences = collections.defaultdict(list)
    for r in pieces:
        of[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(of[i], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    padding = sum(4096 - n for p in sequences.values() if (n := sum(r.length for r in p)) & (n - 1))
    assert padding <= 0.02 * sum(r.length for r in pieces)


def test_op10(spark, folder, rows):
    out = {r.doc_id: r for r in got(spark, folder, 10, {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"})}
    prints = {i: fingerprint(t) for i, t in rows}
    want = groups([i for i, _ in rows], lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    assert {i: (r.fingerprint, r.component_id) for i, r in out.items()} == {i: (f"{prints[i]:016x}", want[i]) for i in prints}
