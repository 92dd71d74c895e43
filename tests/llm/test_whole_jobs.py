"""Operators over all of their rows, against plain versions: page pairs, markup, and ranges along the curve."""

import random

import numpy as np
import pyarrow as pa
import pytest

from strandweave.llm import packing, pagediff, transducer

PAGE = "page_id long, url string, html string"


def page_texts(spark, rows, parts=3):
    return {r.page_id: r.text for r in pagediff.extracted(spark.createDataFrame(rows, PAGE).repartition(parts)).collect()}


def page(i, n_template=8):
    return "".join(f"<div>Template {k}</div>" for k in range(n_template)) + f"<p>story {i}</p><p>more of {i}</p><p>end of {i}</p>"


def story(i):
    return f"story {i}\nmore of {i}\nend of {i}"


def test_template_that_outweighs_its_article(spark):
    got = page_texts(spark, [(i, f"http://h.example/a/{i:02}", page(i)) for i in range(12)])
    assert got == {i: story(i) for i in range(12)}


def test_page_whose_lines_another_has_keeps_them(spark):
    rows = [(0, "http://h.example/a/0", "<p>one</p><p>two</p>"), (1, "http://h.example/a/1", "<p>one</p><p>two</p><p>three</p>")]
    assert page_texts(spark, rows) == {0: "one\ntwo", 1: "three"}


@pytest.fixture(params=[1, 7])
def ranges(spark, request):
    """Sorted ranges, so that runs of copies end within one, or fill some."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    spark.conf.unset("spark.sql.adaptive.enabled")


def test_different_page_behind_many_copies(spark, ranges):
    rows = [(k, f"http://h.example/a/{k:03}", page(0, 2)) for k in range(60)] + [(60, "http://h.example/b", page(60, 2))]
    # one path with many query strings
    rows += [(100 + k, f"http://q.example/p?{k}", page(1 + k // 30, 2)) for k in range(60)]
    got = page_texts(spark, rows)
    assert [got[k] for k in (*range(61), *range(100, 160))] == [story(0)] * 60 + [story(60)] + [story(1)] * 30 + [story(2)] * 30


def test_pairs_against_a_plain_version(spark, ranges):
    rng = random.Random(3)
    rows = [(k, f"http://{rng.choice('ab')}.example/{rng.randrange(30):02}", "".join(f"<p>{rng.randrange(6)}</p>" for _ in range(3)) if rng.random() < 0.3 else page(rng.randrange(3), 2)) for k in range(150)]
    of = {k: pagediff.lines(h)[0] for k, _, h in rows}
    order = sorted(rows, key=lambda r: (*pagediff.split_url(r[1]), r[0]))
    want = {}
    for at, (k, url, _) in enumerate(order):
        host, path = pagediff.split_url(url)
        near = []
        for step in (-1, 1):
            i, n, last = at + step, 0, of[k]
            while 0 <= i < len(order) and pagediff.split_url(order[i][1])[0] == host and n <= pagediff.REACH:
                if of[order[i][0]] != last:
                    n, last = n + 1, of[order[i][0]]
                    if n <= pagediff.REACH and last != of[k]:
                        near.append((-pagediff._prefix(path, pagediff.split_url(order[i][1])[1]), n, step, last))
                i += step
        want[k] = of[k]
        for *_, other in sorted(near):
            got = set(pagediff.common(of[k], other))
            if len(got) < len(of[k]):
                want[k] = [x for i, x in enumerate(of[k]) if i not in got]
                break
    assert page_texts(spark, rows) == {k: "\n".join(x) for k, x in want.items()}


def test_differencing_beside_the_body(spark, ranges):
    """Pages with article or main elements: differencing decides on lines that structure leaves open, and on no line of a body."""
    body = lambda i: f"<article><h1>T{i}</h1><p>story {i} goes on for many words, more than all else</p><p>passage of two articles</p></article>"
    text = lambda i: f"T{i}\nstory {i} goes on for many words, more than all else\npassage of two articles"
    card = lambda i: f"<article><h2>Card {i}</h2><p>read it</p></article>"
    rows, want = [], {}

    def add(host, path, html, expected):
        want[len(rows)] = expected
        rows.append((len(rows), f"http://{host}.example/{path}", html))

    for i in range(4):
        add("main", i, f"<main><div>Start</div><h1>Section</h1>{body(i)}<div>More stories</div><p>beside {i}</p></main><footer>f {i}</footer>", f"Section\n{text(i)}\nbeside {i}")
        # an article that pages share goes as a whole; one that differs in a line stays as a whole
        add("cards", i, body(i) + card("of all") + card(i), f"{text(i)}\nCard {i}\nread it")
        # an article element in a script, a comment or a sidebar is no main element
        add("script", i, f"<script>x = '<article>'</script><div>Template</div><p>own {i}</p>", f"own {i}")
        add("remark", i, f"<!-- <main> --><div>Template</div><p>own {i}</p>", f"own {i}")
        add("aside", i, f"<div>Template</div><p>own {i}</p><aside><article>teaser {i}</article></aside>", f"own {i}")
        # the main element's own lines are its body where they are longer
        add("own", i, f"<main><p>own lines of {i}, longer than any article in it</p><p>passage</p>{card('of all')}</main>", f"own lines of {i}, longer than any article in it\npassage")
    # one article with different cards, and a page of three articles beside one of them
    for i in range(3):
        add("same", i, body(0) + card(i), f"{text(0)}\nCard {i}\nread it")
    add("home", "", body(10) + body(11) + body(12), f"{text(10)}\n{text(11)}\n{text(12)}")
    add("home", "11", body(11), text(11))
    plain = lambda i: body(i).replace("h1", "h2")
    add("blog", "", plain(10) + plain(11) + plain(12) + body(13), f"{text(10)}\n{text(11)}\n{text(12)}\n{text(13)}")
    add("blog", "11", plain(11), text(11))
    # a short first post that pages of a thread repeat
    for i in range(3):
        add("thread", i, f"<article><h1>Question</h1><p>short</p></article>{plain(i)}", f"Question\nshort\n{text(i)}")
    assert page_texts(spark, rows) == want


def test_what_differencing_and_the_check_deleted(spark):
    rows = [(i, f"http://h.example/{i}", f"<nav>menu</nav><main><p>Start</p><article>story of {i}, and more of it</article></main><footer>footer {i}</footer>") for i in range(3)]
    got = pagediff.extracted(spark.createDataFrame(rows, PAGE)).collect()
    assert {tuple(r)[2:] for r in got} == {(f"story of {i}, and more of it", 26, 3, 2, 2, 1) for i in range(3)}


def test_curve_keys_of_texts_for_the_library():
    machine = transducer.Encoded.of("word_bpe_49k.json")
    special = machine.special[0].decode()
    texts = ["春眠不覚暁", "国破山河在", "हिन्दी में", "বাংলা ভাষা", "🙂", "🚀🚀", f"one {special} word", f"other {special} text", "e\u0301t\u00e9 chaud", "plain words", "", None]
    ids, cut, h, bounds = machine.encode(pa.array([*texts, *texts]))
    keys = packing.curve_keys(h, bounds).tolist()
    assert keys[: len(texts)] == keys[len(texts) :]
    assert len(set(keys[: len(texts) - 2])) == len(texts) - 2 and keys[-1] == keys[-2] not in keys[: len(texts) - 2]
    for i, x in enumerate(texts):
        assert ids[cut[i] : cut[i + 1]].tolist() == machine.library.encode(x or "", add_special_tokens=False).ids
    # what surrounds an emoji still counts: near the same text without it
    vectors = lambda a: np.bincount((h[bounds[a] : bounds[a + 1]] % np.uint64(packing.BUCKETS)).astype(int), minlength=packing.BUCKETS)
    _, _, h, bounds = machine.encode(pa.array(["a b c d e f g", "a b c d e f g 🙂"]))
    assert np.abs(vectors(0) - vectors(1)).sum() == 1


MARKUP = {
    "<div class='content has-sidebar'><p>a</p><p>b</p></div><div class='sidebar'>s</div>": "a\nb",
    "<div class='no-comments'><article><h1>t</h1><p>a</p></article></div>": "t\na",
    "<article><div class='article-header'><h1>t</h1></div><p>a</p><div class='comment-12'>c</div></article>": "t\na",
    "<div class='sidebar content'><main><p>a</p><div id=comments>c</div></main></div><article>teaser</article>": "a",
    "<article><p>a</p></article><div id='comments'><article>reader</article></div>": "a",
    "<article><p>a</p><div class='comments'>many words of readers, more than the article has</div></article>": "a",
    "<div class='widget'><p>most of the page is here</p></div><div class='ad'>x</div><p>y</p>": "most of the page is here\ny",
    "<article><div class='social'><p>body</p></div></article><nav>n</nav>": "body",
    "<html><head><title>t</title><meta charset=x><style>p{}</style><p>a<div>b</div>": "a\nb",
    "<p>a</p><svg><path d='x'/><p>b</p>": "a\nb",
    "<p>a</p><select><p>b</p>": "a\nb",
    "<p>a</p><object data=x><p>b</p>": "a\nb",
    "<p>a</p><script>if (1) {} <p>no text</p>": "a",
}


@pytest.mark.parametrize("html", list(MARKUP))
def test_markup(html):
    assert "\n".join(pagediff.lines(html)[0]) == MARKUP[html]


def test_ranges_follow_the_curve(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANGE_BYTES", 500)
    monkeypatch.setattr(packing, "RANGES", 4)
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["sun", "moon", "river", "stone", "cloud", "tree"]) for _ in range(12)) for _ in range(100)] * 2
    rows = packing.packed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), length=64, with_ids=False).collect()
    part = {r.doc_id: r.sequence_id >> 32 for r in rows}
    _, _, h, bounds = transducer.Encoded.of("word_bpe_49k.json").encode(pa.array(texts))
    keys = packing.curve_keys(h, bounds).tolist()
    along = [part[i] for i in sorted(part, key=lambda i: (keys[i], i))]
    assert len(part) == 200 and len(set(along)) > 4 and along == sorted(along)
