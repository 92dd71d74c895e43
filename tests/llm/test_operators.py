"""Each operator against a plain version, on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import html
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from strandweave.llm import components, decontam, labelled, media, packing, pagediff, quality, simhash, suffixdedup, toxicity, transducer, warc
from strandweave.llm.textops import HashIndex, Rolling, flat, same_bytes, tuned

WORDS = "the of and stone river quick cloud naïve größe été mañana it's we're 42 x1 !!! —".split()


def texts(seed=0, n=60):
    rng = random.Random(seed)
    out = [None, "", "   ", "\n", "a", "é", "x" * 150, "ab" * 700, "a" * 2000, "word " * 400]
    for _ in range(n):
        out.append(" ".join(rng.choice(WORDS) + rng.choice(["", "", str(rng.randrange(300))]) for _ in range(rng.randrange(1, 200))))
    for k in range(10):  # copies, near copies, shared passages
        base = out[10 + k]
        out += [base, base.replace("river", "ocean", 1), base[: len(base) // 2] + " between " + out[12 + k][len(out[12 + k]) // 3 :]]
    return out


@pytest.fixture
def docs(spark):
    rows = [(i, t, "en", "s0", len(t or "")) for i, t in enumerate(texts())]
    rows += [rows[15], rows[15], (None, rows[16][1], None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


# -- helpers -----------------------------------------------------------------------------------------------------------------------


def test_rolling_hashes_and_index():
    raw = np.frombuffer(b"abcabcabd" * 3, np.uint8)
    g = Rolling(raw).grams(3)
    assert g[0] == g[3] == g[9] and g[0] != g[6]
    index = HashIndex(2)
    keys = np.random.default_rng(0).integers(0, 2**63, 500, dtype=np.int64).astype(np.uint64)
    for part in np.array_split(np.unique(keys), 7):
        index.add(part)
    assert index.find(np.unique(keys)).tolist() == list(range(len(np.unique(keys)))) and index.find(np.array([5], np.uint64))[0] == -1


def test_same_bytes():
    rng = np.random.default_rng(4)
    a, b = (rng.integers(0, 2, 3000).astype(np.uint8) for _ in range(2))
    b[1000:2000] = a[500:1500]
    size = np.concatenate((rng.integers(0, 90, 900), rng.integers(0, 6, 2000), [0, 0, 1, 1]))
    at, to = (rng.integers(0, 3000 - size) if len(size) else size for _ in range(2))
    at[:400], to[:400] = 500 + np.arange(400), 1000 + np.arange(400)
    at[-4:], to[-4:] = [3000, 0, 2999, 0], [3000, 3000, 2999, 2999]
    want = [bytes(a[i : i + n]) == bytes(b[j : j + n]) for i, j, n in zip(at, to, size, strict=True)]
    assert same_bytes(a, at, b, to, size).tolist() == want
    assert 400 < sum(want) < len(want)


def test_components(spark):
    links = [(1, 2), (2, 3), (5, 5), (9, 8), (8, 7), (7, 9), *[(100 + i, 101 + i) for i in range(40)], *[(0, 200 + i) for i in range(50)]]
    got = {r.v: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7} | {100 + i: 100 for i in range(41)} | {0: 0} | {200 + i: 0 for i in range(50)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- SimHash ---------------------------------------------------------------------------------------------------------------------------


def fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(ids, linked):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(ids, 2):
        if linked(a, b):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_simhash(spark, docs, none):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    text = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    prints = {i: fingerprint(t) for i, t in text.items()}
    want = groups(sorted(text), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    for r in got:
        if r.doc_id is not None:
            assert (r.fp & (2**64 - 1), r.component_id) == (prints[r.doc_id], want[r.doc_id])
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("split", [4, 4096])
def test_hot_fingerprints_and_crowded_blocks(spark, monkeypatch, split):
    """A third of all rows in one fingerprint, and blocks that are split again."""
    monkeypatch.setattr(simhash, "SPLIT", split)
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 6, dtype=np.int64).astype(np.uint64)
    fp = base[rng.integers(0, 6, 400)]
    for _ in range(3):
        fp = fp ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64))
    fp = np.unique(np.concatenate((fp, base)))
    prints = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    got = {r.v: r.root for r in components.components(simhash.linked(prints)).collect()}
    want = groups(range(len(fp)), lambda a, b: int(fp[a] ^ fp[b]).bit_count() <= 2)
    value = fp.view(np.int64).tolist()
    parts = lambda pairs: sorted(sorted(a for a, r in pairs if r == root) for root in {r for _, r in pairs})
    assert parts([(v, got.get(v, v)) for v in value]) == parts([(value[i], value[r]) for i, r in want.items()])
    rows = [(i, "one hot text of many rows", "x") for i in range(400)] + [(1000 + i, f"text {i} has words {i * 7} of its own {i * 31}", "y") for i in range(800)]
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, n string")).collect()}
    assert len(found) == 1200 and {found[i] for i in range(400)} == {0}


def similarity(a, b):
    sets = [{" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (lowered_words(a), lowered_words(b))]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def lowered_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_representatives_of_near_copies(spark, none):
    rng = random.Random(6)
    line = lambda n: [f"{rng.choice(WORDS)}{rng.randrange(400)}" for _ in range(n)]
    rows = [(i, " ".join(line(rng.randrange(60, 400)))) for i in range(150)]
    for k in range(300):
        words = rows[k % 60][1].split()
        for _ in range(rng.randrange(0, 1 + len(words) // 60)):
            words[rng.randrange(len(words))] = f"changed{rng.randrange(10**6)}"
        rows.append((1000 + k, " ".join(words)))
    rows += [(3000, ""), (3001, None), (3002, "  "), (3003, "two words"), (3004, "Two  words"), (None, rows[0][1]), rows[5], (3005, "long " * 200_000), (3006, "long " * 200_000)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, v string, w0 string")
    got = [r.doc_id for r in simhash.representatives(docs.repartition(5)).collect()]
    assert len(got) == len(set(got)) and {3000, 3003, 3005} <= set(got) and not {3001, 3002, 3004, 3006, None} & set(got)
    assert set(range(150)) <= set(got)  # texts of their own stay
    near = [k for k in range(300) if similarity(rows[150 + k][1], rows[k % 60][1]) >= 0.8]
    assert len(near) > 200 and sum(1000 + k not in got for k in near) >= 0.95 * len(near)
    assert simhash.representatives(none).count() == 0


def test_samples_meet():
    share = simhash.distance_of(0.8)
    for n in (10, 10**6, 10**10):
        masks = simhash.samples_of(n, share)
        bits = {sum(x.bit_count() for x in m) for m in masks}
        assert len(bits) == 1 and 1 - (1 - (1 - share) ** bits.copy().pop()) ** len(masks) >= 0.95


def test_long_texts_count_in_parts():
    h = np.random.default_rng(1).integers(0, 2**63, 150_001, dtype=np.int64).astype(np.uint64)
    bits = ((h[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(bool)
    want = sum(1 << b for b in range(64) if 2 * int(bits[:, b].sum()) > len(h))
    assert int(simhash._majority(h, np.array([0, 0, len(h)]))[1]) == want


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 300])
def test_bit_sliced_links(n):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 2**63, max(1, n // 8), dtype=np.int64).astype(np.uint64)
    fp = base[rng.integers(0, len(base), n)]
    for _ in range(3):
        fp = fp ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    run = np.sort(rng.integers(0, 3, n))
    for radius in (0, 1, 2):
        i, j = simhash._links(fp, run, radius)
        want = {(a, b) for a, b in itertools.combinations(range(n), 2) if run[a] == run[b] and int(fp[a] ^ fp[b]).bit_count() <= radius}
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == want


# -- suffixes --------------------------------------------------------------------------------------------------------------------------


def removed(rows):
    """(kept, spans) of texts in order."""
    seen, out = set(), []
    for t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(w)
        out.append((bytes(c for c, g in zip(b, gone, strict=True) if not g), [[m.start(), m.end()] for m in re.finditer(b"\1+", gone)]))
    return out


@pytest.mark.parametrize(("block", "hot"), [(1 << 21, 512), (9_000, 512), (9_000, 2), (3_000, 3)])
def test_suffixes(spark, docs, none, monkeypatch, block, hot):
    monkeypatch.setattr(suffixdedup, "BLOCK_BYTES", block)
    monkeypatch.setattr(suffixdedup, "HOT_BLOCKS", hot)
    rows = docs.where("doc_id is not null").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    df = spark.createDataFrame([(r.text, r.doc_id, r.lang, "x") for r in rows], "text string, doc_id long, c0 string, added string")
    got = {r.doc_id: r for r in suffixdedup.without_repeats(df).collect()}
    for r, (kept, spans) in zip(rows, removed([r.text for r in rows]), strict=True):
        g = got[r.doc_id]
        assert (bytes(g.repeats.kept), g.repeats.spans, g.repeats.n_removed, g.repeats.n_bytes) == (kept, spans, len((r.text or "").encode()) - len(kept), len((r.text or "").encode()))
        assert (g.text, g.c0, g.added) == (r.text, r.lang, "x")
    assert suffixdedup.without_repeats(none).count() == 0
    with pytest.raises(ValueError, match="already"):
        suffixdedup.without_repeats(df, into="c0")


def test_suffixes_with_equal_and_null_ids(spark):
    rng = random.Random(3)
    t = "".join(rng.choice("abcdefgh ") for _ in range(400))
    df = spark.createDataFrame([(7, t), (7, t), (None, t), (1, None)], "doc_id long, text string").coalesce(1)
    got = suffixdedup.without_repeats(df).collect()
    assert sorted((str(r.doc_id), r.repeats.n_removed) for r in got) == [("1", 0), ("7", 400), ("7", 400), ("None", 0)]


def test_multikey_quicksort():
    words = np.random.default_rng(0).integers(0, 3, (400, 6)).astype(np.uint64)
    order = suffixdedup.multikey_order(words)
    assert [tuple(w) for w in words[order]] == sorted(tuple(w) for w in words)


# -- benchmark phrases -----------------------------------------------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


@pytest.mark.parametrize("item_bytes", [16 << 20, 400])
def test_contamination(spark, docs, none, monkeypatch, item_bytes):
    monkeypatch.setattr(decontam, "ITEM_BYTES", item_bytes)
    source = [r.text for r in docs.collect() if r.text and len(r.text) > 300]
    items = [("a", " ".join(lowered(source[0])[5:25])), ("b", " ".join(lowered(source[1])[:8])), ("10", "STONE42 river"), ("9", " ".join(lowered(source[0])[10:40])), ("a", "again " * 9), ("c", None), ("d", "..."), (None, source[2]), ("e", "nowhere to be found in any of the texts here")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    windows = collections.defaultdict(set)
    for i, t in items:
        w = lowered(t)
        for k in range(max(1, len(w) - 7) if w and i else 0):
            windows[tuple(w[k : k + 8])].add(i)
    got = decontam.contamination(docs, bench).collect()
    assert len(got) == docs.count()
    for r in got:
        w, hit, found = lowered(r.text), set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                if (own := windows.get(tuple(w[i : i + size]))) is not None:
                    hit |= set(range(i, i + size))
                    found |= own
        c = r.contamination
        assert (c.n_words, c.n_hit, c["items"]) == (len(w), len(hit), sorted(found))
        inside = sum(len(lowered((r.text or "").encode()[x:y].decode())) for x, y in c.spans)
        assert inside == len(hit)
    cut = {r.doc_id: r for r in decontam.contamination(docs, bench, cut=True).collect()}
    for r in got:
        if r.doc_id is not None:
            b, keep, at = (r.text or "").encode(), b"", 0
            for x, y in r.contamination.spans:
                keep, at = keep + b[at:x], y
            assert cut[r.doc_id].text == (None if r.text is None else (keep + b[at:]).decode())
    assert decontam.contamination(none, bench).count() == 0
    assert decontam.contamination(docs, bench.limit(0)).where("contamination.n_hit > 0").count() == 0


@pytest.mark.parametrize("bits", [64, 6, 0])
def test_words_with_equal_hashes(monkeypatch, bits):
    """Hits don't rest on hashes: the same with hashes of 64 bits, of six, and of none."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.choice([1, 2, 3, 9, 40, 80]))) for _ in range(300)]
    some = [" ".join(rng.choice(words[:200]) for _ in range(60)) for _ in range(30)]
    items = [" ".join(some[k].split()[5:25]) for k in range(6)] + [words[0], words[5], "nowhere else"]
    some = [t if k % 2 else t.replace(words[5], words[250]).upper() for k, t in enumerate(some)] + ["", None, " ".join(words[200:])]
    of = Rolling.of
    monkeypatch.setattr(Rolling, "of", lambda self, a, b: of(self, a, b) & np.uint64((1 << bits) - 1))
    phrases = decontam.Phrases([str(k) for k in range(len(items))], items, 8)
    assert bits == 64 or len(phrases.others) > 30
    known = HashIndex()
    known.add(phrases.vocabulary)
    part = pa.record_batch({"c0": pa.array(some, pa.string()), "found": pa.nulls(len(some))})
    windows = [(str(k), tuple(w[a : a + 8])) for k, t in enumerate(items) if (w := lowered(t)) for a in range(max(1, len(w) - 7))]
    for t, found in zip(some, decontam._searched(part, part.column(0), phrases, known).column(1).to_pylist(), strict=True):
        w, hit, ids = lowered(t), set(), set()
        for k, window in windows:
            for i in range(len(w) - len(window) + 1):
                if tuple(w[i : i + len(window)]) == window:
                    hit |= set(range(i, i + len(window)))
                    ids.add(k)
        assert (found["n_words"], found["n_hit"], found["items"]) == (len(w), len(hit), sorted(ids))


def test_fm_index():
    rng = np.random.default_rng(5)
    for n, high in ((1, 2), (40, 3), (300, 5), (500, 40)):
        s = rng.integers(0, high + 1, n)
        s[rng.random(n) < 0.3] = 1
        index = decontam.FMIndex(s, high)
        rows = np.array([rng.integers(1, high + 1, 4) for _ in range(50)] + [s[k : k + 4] for k in range(0, n - 4, 7) if (s[k : k + 4] > 0).all()])
        size = rng.integers(1, 5, len(rows))
        who, low, high_ = index.search(rows, size)
        found = collections.defaultdict(set)
        for w, a, b in zip(who, low, high_, strict=True):
            found[int(w)] = set(index.locate(np.arange(a, b)).tolist())
        for k, (row, m) in enumerate(zip(rows, size, strict=True)):
            assert found[k] == {p for p in range(n - m + 1) if (s[p : p + m] == row[:m]).all()}


# -- tokens ----------------------------------------------------------------------------------------------------------------------------

ODD = ["it's we're I'll 'sto --'s 's'' '' ''s 'l 'r 've12's", "İstanbul ΣΑΣ", "a<|endoftext|>b", "<|startoftext|>", "é x̧", "漢字 kana かな", " tabs\t\nx\x1cy\x85z\xa0w", "12ab34!!??##'d", "½²x ³ª º", "'S 'RE don'T", "x\x00y", "ﬁ K Å Ω", "٣٤ abc", "हिन्दी", "—dash…ok “q” ‘s’ ’s", "x" * 3000]


def test_token_counts(spark, none):
    rng = random.Random(2)
    odd = ODD + ["".join(rng.choice(["'", "s", "t", "re", "ll", "e", " ", "é", "7", "-", "v", "É", "ß", "\n", "d", "m", "²"]) for _ in range(rng.randint(1, 40))) for _ in range(400)]
    every = [*texts(), *odd]
    df = spark.createDataFrame(list(enumerate(every)), "counted int, text string")
    library = transducer.Compiled.of("word_bpe_49k.json").library
    want = [len(e.ids) for e in library.encode_batch([t or "" for t in every], add_special_tokens=False)]
    got = transducer.token_counts(df).orderBy("counted").collect()
    assert [r.tokens.n_tokens for r in got] == want
    assert [r.tokens.n_bytes for r in got] == [len((t or "").encode()) for t in every]
    assert transducer.token_counts(none).count() == 0


def test_cache_reset(monkeypatch):
    monkeypatch.setattr(transducer, "MOST_PIECES", 150)
    machine = transducer.Encoded("word_bpe_49k.json")
    for part in (texts(4, 20), texts(5, 20)):
        ids, cut, _, _ = machine.encode(pa.array(part))
        for i, e in enumerate(machine.library.encode_batch([t or "" for t in part], add_special_tokens=False)):
            assert ids[cut[i] : cut[i + 1]].tolist() == e.ids


@pytest.mark.parametrize("bits", [64, 8, 0])
def test_pieces_with_equal_hashes(monkeypatch, bits):
    """Ids don't rest on hashes: the same with hashes of 64 bits, of eight, and of none."""
    mix = transducer.mix
    machine = transducer.Encoded("word_bpe_49k.json")
    monkeypatch.setattr(transducer, "mix", lambda h: mix(h) & np.uint64((1 << bits) - 1))
    for part in (texts(4, 20), [*ODD, None, "", *texts(5, 20)]):
        ids, cut, _, _ = machine.encode(pa.array(part))
        for i, e in enumerate(machine.library.encode_batch([t or "" for t in part], add_special_tokens=False)):
            assert ids[cut[i] : cut[i + 1]].tolist() == e.ids


def test_transducer(monkeypatch):
    """Emitted tokens along transitions are the library's, of all kinds of characters, and after states were dropped."""
    monkeypatch.setattr(transducer, "MOST_STATES", 3000)
    machine = transducer.Compiled("word_bpe_49k.json")
    rng = random.Random(9)
    kinds = ["abcdefgh", "étéÉß", "кириллица", "漢字かな", "हिन्दी", "한국어", "🙂👍🏽", "e\u0301\u0323", "'s're", "  \n\u3000", "0123", "...!?", "\u1100\u1161\u11a8"]
    for _ in range(4):
        part = ["".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randint(0, 80))) for _ in range(500)]
        part += ["x" * 64, "y" * 65, "ab" * 500, "a" * 63 + "é", "Σ", "e\u0323\u0301" * 30, "\u0ece\u0323"]
        want = [len(e.ids) for e in machine.library.encode_batch(part, add_special_tokens=False)]
        assert machine.count(pa.array(part)).tolist() == want
    # a path's transitions add up to its tokens, and only the start has none before it
    total = np.array(machine.total)
    assert (machine.emits[: len(total) - 1] == total[1:] - total[np.array(machine.parent)[1:]]).all()
    everyone = [chr(c) for c in range(0xD800)] + [chr(c) for c in range(0xE000, 0x20000)]
    part = [f"a{c}B1{c}{c} {c}'s" for c in everyone[:: 7]]
    assert machine.count(pa.array(part)).tolist() == [len(e.ids) for e in machine.library.encode_batch(part, add_special_tokens=False)]


def test_state_maps_compose():
    kinds = np.random.default_rng(0).integers(0, 6, 1000).astype(np.uint8)
    entry, _ = transducer.state_maps(kinds)
    state = transducer.OUT
    for i, c in enumerate(kinds):
        if i % transducer.CHUNK == 0:
            assert entry[i // transducer.CHUNK] == state
        state = transducer.GO[(state << 3) | c]


# -- packing ---------------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("range_bytes", [8 << 20, 3_000])
def test_packing(spark, docs, none, monkeypatch, range_bytes):
    monkeypatch.setattr(packing, "RANGE_BYTES", range_bytes)
    monkeypatch.setattr(packing, "RANGES", 8)
    df = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    library = transducer.Compiled.of("word_bpe_49k.json").library
    want = {r.doc_id: np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4") for r in df.collect()}
    rows = packing.packed(df, length=256).collect()
    by, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(by) == set(want)
    for i, parts in by.items():
        parts.sort(key=lambda r: r.start)
        assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in parts]).tolist() == want[i].tolist()
        assert [r.start for r in parts] == [0, *np.cumsum([r.length for r in parts])[:-1].tolist()]
        assert all(r.ids_crc32 == zlib.crc32(r.ids) and r.doc_tokens == len(want[i]) for r in parts)
    for parts in sequences.values():
        parts.sort(key=lambda r: r.offset)
        assert [r.offset for r in parts] == [0, *np.cumsum([r.length for r in parts])[:-1].tolist()]
        total = sum(r.length for r in parts)
        assert total <= 256 and total & (total - 1) == 0
    assert packing.packed(none).count() == 0
    assert packing.packed(docs, with_ids=False).agg(F.sum("length")).first()[0] > sum(map(len, want.values()))


def test_hilbert_curve():
    for n, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.array(np.meshgrid(*[np.arange(1 << bits)] * n)).reshape(n, -1).T
        key = packing.hilbert(cells, bits)
        assert sorted(key) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1) == 1).all()
    assert packing.cuts(4096 * 2 + 1000, 4096).tolist() == [0, 4096, 8192, 8704, 8960, 9088, 9152, 9184, 9192]


# -- classifiers -----------------------------------------------------------------------------------------------------------------------


@pytest.fixture
def marked(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(600):
        bad, toxic = i % 5 == 0, i % 4 == 0
        w = [rng.choice(WORDS) for _ in range(rng.randrange(20, 80))]
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(["villain", "villains", "crookish", "crooks"]))
        rows.append((i, " ".join(x.upper() + "!!" for x in w) if bad else " ".join(w), rng.choice(["en", "fr"])))
        labels.append((i, int(not bad), int(toxic)))
    labels += [(0, 0, 1), (1, None, None), (None, 1, 1), (2, 7, 7)]
    rows += [(1000, None, "en"), (1001, "", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def accuracy(got, truth):
    return np.mean([truth[r.doc_id] == (r.score >= 0.5) for r in got if r.doc_id in truth])


def test_quality(spark, marked, none):
    docs, labels = marked
    model = quality.fit(docs, labels)
    got = quality.scored(docs.withColumn("label", F.lit(1)), model, into="score").collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert accuracy(held, {i: i % 5 > 0 for i in range(600)}) > 0.95
    assert quality.scored(none, model).count() == 0
    flat_model = quality.fit(docs, labels.where("quality = 1"))
    assert len({r.quality for r in quality.scored(docs, flat_model).collect()}) == 1
    # labels of the held-out fold change nothing
    other = labels.where(~labelled.held_out("doc_id", 5, 0))
    assert [r.score for r in quality.scored(docs, quality.fit(docs, other), into="score").orderBy("doc_id").collect()] == [r.score for r in sorted(got, key=lambda r: r.doc_id)]


def test_toxicity(spark, marked, none):
    docs, labels = marked
    c = toxicity.fit(docs, labels, lang="lang")
    got = toxicity.scored(docs, c, into="score").collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert accuracy(held, {i: i % 4 == 0 for i in range(600)}) > 0.9
    assert set(c.by_language) <= {"en", "fr"}
    assert toxicity.decisions(toxicity.scored(docs, c), c).where("toxic is null").count() == 0
    assert toxicity.scored(none, c).count() == 0
    flat_model = toxicity.fit(docs, labels.where("toxic = 0"))
    assert len({r.toxicity for r in toxicity.scored(docs, flat_model).collect()}) == 1


def test_features_of_empty_texts():
    x = quality.features(pa.array([None, "", "A B", "\n\n"]))
    assert not x[:2].any() and x[2].any() and np.isfinite(x).all()


# -- pages -----------------------------------------------------------------------------------------------------------------------------

PAGES = {
    "<body><header><h1>Site</h1></header><nav>x</nav><div class='cookie-notice'>c</div><main><h1>T &amp; t</h1><p>a<b>b</b>c <i>d</i><br>e<p>f</p><aside>s</aside><form>z</form><div id='comments'><p>bad</p></div></main><footer>y</footer>": "T & t\na" "bc d e\nf",
    "<p>one&nbsp;two</p>\n<div>three<p>four</div>": "one two\nthree\nfour",
    "": "",
    "plain &lt;text&gt;": "plain <text>",
    "<article><header><h1>H</h1><span>by me</span></header><p>x</p></article>": "H\nx",
    "<article><h2>a</h2><ul><li>x<li>y</ul><script>if(a<b){}</script>t<!-- c --></article><div>out</div>": "a\nx\ny\nt",
    "<article><p>bad 'quote <a href=\"x>y\">l</a> 1 < 2</p></article>": "bad 'quote l 1 < 2",
    "<article><p>cut off <b": "cut off",
    "<head><title>t</title><style>p{}</style></head><body><div role='navigation'>n</div><div hidden>h</div>b": "b",
}


@pytest.mark.parametrize("page", list(PAGES))
def test_lines(page):
    assert "\n".join(pagediff.lines(page)[0]) == PAGES[page]


def test_alignment():
    rng = random.Random(0)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        got = pagediff.common(a, b)
        assert len(got) == best[-1][-1] and got == sorted(set(got))
        rest = iter(b)
        assert all(a[i] in rest for i in got)


@pytest.mark.parametrize("bits", [1, 64, 1 << 28])
def test_alignment_in_halves(monkeypatch, bits):
    monkeypatch.setattr(pagediff, "TABLE_BITS", bits)
    test_alignment()


def test_alignment_of_many_equal_lines():
    """Ten thousand equal lines between different ends, and long pages of few different lines."""
    a, b = [1, *[5] * 10_000, 2], [3, *[5] * 9_000, 4]
    assert len(pagediff.common(a, b)) == 9_000
    rng = random.Random(2)
    a, b = ([rng.randrange(3) for _ in range(4_000)] for _ in range(2))
    got = pagediff.common(a, b)
    rest = iter(b)
    assert len(got) > 2_400 and all(a[i] in rest for i in got)


def test_pages_with_clashing_columns_and_long_html(spark):
    rows = [(i, f"http://h.example/{i}", f"<p>own {i}</p><p>same</p>", "x", 1) for i in range(6)] + [(9, "http://h.example/9", "<p>" + "long word " * 150_000 + "</p>" + "<p>tied</p>" * 3_000, "y", 2)]
    got = {r.page_id: r for r in pagediff.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, host string, range int")).collect()}
    assert {i: r.text for i, r in got.items() if i < 6} == {i: f"own {i}" for i in range(6)}
    assert got[9].n_chars == len("long word " * 150_000) - 1 + 5 * 3_000


def test_differencing(spark):
    template = lambda i: f"<div>Menu of the site</div><p>story {i} is long and its own</p><p>more of {i}</p><p>and {i} ends</p><div>All rights kept</div>"
    rows = [(i, f"http://h.example/a/{i:02}", template(i)) for i in range(20)]
    rows += [(100, "http://other.example/", "<div>Menu of the site</div><p>alone</p>"), (101, None, None), (102, "http://h.example/a/00", template(0)), (103, "http://m.example/1", "<article>shared</article>"), (104, "http://m.example/2", "<article>shared</article>")]
    got = {r.page_id: r for r in pagediff.extracted(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    for i in [*range(20), 102]:
        k = i % 102
        assert got[i].text == f"story {k} is long and its own\nmore of {k}\nand {k} ends"
    assert got[100].text == "Menu of the site\nalone" and got[101].text == "" and got[103].text == got[104].text == "shared"
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert pagediff.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_interleaved_media(spark):
    assert media.items('<p>a<figure><img src="x.png" alt="q"><figcaption>cap <b>1</b></figcaption></figure><p>b<img src=y alt="&amp;z">c') == [(0, "text", "a", None, None), (1, "media", None, "x.png", "cap 1"), (2, "text", "b", None, None), (3, "media", None, "y", "&z"), (4, "text", "c", None, None)]
    payloads = [b"", None, b"abc", b"abc", bytes(range(256)) * 9]
    rows = spark.createDataFrame([(p,) for p in payloads], "payload binary")
    store = media.described(media.stored(F.col("payload"), rows)).collect()
    padded = {hashlib.sha256(media.pad(p or b"")).hexdigest(): media.pad(p or b"") for p in payloads}
    assert {r.digest for r in store} == set(padded) and len(store) == 3
    for r in store:
        data = padded[r.digest]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), r.digest, zlib.crc32(data[-16:]))
        assert r.media_sha256 == hashlib.sha256(media.encode(data)).hexdigest() and media.decode(media.encode(data)) == data
    one = hashlib.sha256(media.pad(b"abc")).hexdigest()
    pages = [(1, f'<p>t<img src="sha256:{one}"><p>u<img src="sha256:{"0" * 64}" alt="gone"><img src="sha256:{one}">', "x"), (1, f'<img src="sha256:{one}">', "y"), (2, None, "z")]
    seqs = media.sequences(spark.createDataFrame(pages, "id int, html string, row string"))
    got = sorted(media.resolved(seqs, spark.createDataFrame(store)).collect(), key=lambda r: r.row)
    assert [[m and m.digest for m in r.media] for r in got] == [[None, one, None, None, one], [one], []]
    assert [i.caption for i in got[0]["items"]] == [None, None, None, "gone", None]
    with pytest.raises(ValueError, match="checksum"):
        media.decode(media.encode(media.pad(b"x"))[:-1] + b"\0")


def test_warc(spark, tmp_path):
    big, other = "é" * 600, "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 40
    rows = [(1, "http://a/ b", big), (3, "http://a/2", big), (3, "http://a/2", big), (2, None, other), (5, "u", other), (9, "v", "small"), (8, "w", "small"), (7, "x", None), (None, "y", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = str(tmp_path / "warc")
    warc.write(pages.repartition(3), folder)
    got = warc.read(spark, folder).collect()
    assert len(got) == len(rows)
    kinds = sorted((str(r.page_id), r.type, r.refers_to) for r in got)
    assert kinds == sorted([("1", "revisit", "<urn:page:3>"), ("3", "response", None), ("3", "response", None), ("2", "revisit", "<urn:page:5>"), ("5", "response", None), ("9", "response", None), ("8", "response", None), ("7", "response", None), ("None", "revisit", "<urn:page:3>")])
    html_of = {r.page_id: bytes(r.payload) for r in got if r.type == "response"}
    assert html_of == {3: big.encode(), 5: other.encode(), 9: b"small", 8: b"small", 7: b""}
    only = warc.read(spark, folder, "none").where("type = 'revisit' and refers_to is not null")
    assert only.count() == 3 and all(r.payload is None for r in only.collect())
    assert "http://a/%20b" in {r.target_uri for r in got}
    empty = str(tmp_path / "none")
    warc.write(pages.limit(0), empty)
    assert warc.read(spark, empty).count() == 0
    with pytest.raises(ValueError, match="no record"):
        list(warc.records(__import__("io").BytesIO(b"junk\n")))


def test_headers_decide_what_is_read():
    body = b"HTTP/1.1 200 OK\r\n\r\nhello"
    record = lambda kind: b"WARC/1.1\r\nWARC-Type: " + kind + b"\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"

    class Counting(__import__("io").BytesIO):
        asked = 0

        def read(self, n=-1):
            Counting.asked += n
            return super().read(n)

    file = Counting(record(b"response") + record(b"request") * 5)
    reader = warc.WarcReader("", "bytes")
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("type",), "response"), GreaterThan(("page_id",), 3)]))
    assert len(left) == 1
    got = list(warc.records(file, reader._wanted))
    assert [g[1] for g in got] == [b"hello"] and Counting.asked == len(body)


def test_workers_get_the_settings(spark):
    assert tuned(spark) is spark and flat(pa.array([None, "a"]))[1].tolist() == [0, 1, 3]
    assert html.unescape("&amp;") == "&"
