"""Main text of web pages by structure and by differencing with the page of the nearest URL.

A page is read into lines, one for each block element.  Menus, headers, footers, sidebars, notices, adverts, forms and
reader comments are known by element, role or whole class name and marked; a class name marks no element that holds the only
main or article element, or most of the text of a page without one.  Then pages are range-sorted by host and URL path; each
is paired with its nearest neighbour on the host (the longest common path prefix, then the shortest way along the order)
that isn't a copy of it, their lines are aligned by longest common subsequence, and shared lines are deleted; then a check
deletes the marked lines that are left.  A page without a main or article element keeps its unmarked, unshared lines.  On a
page with one, its longest article (or the main element's own lines, if longer) and articles with an h1 are the body, and
aren't aligned: a passage that two bodies share is no template.  The check deletes what lies outside the main or article
elements; in them, differencing decides on the lines beside the body: the main element's own ones go singly, but its h1, and
other articles as a whole.

Rows of a host with equal text (equal bodies, where there are some) that follow each other count as one neighbour, so the
nearest different page is found behind any number of copies.  A neighbour may lie in another sorted partition, so the first and last of these runs (URLs and line
hashes only) are handed on: a few rows for each partition.  Edge cases: null and empty html gives an empty text; a null
URL has the empty host and path; copies of a page never delete its lines, nor do pages that have every line of one without a body; repeated rows keep a row each; the rest of an
element that is never closed belongs to it, but a head ends where its elements do, and markup such as an unclosed svg is read on.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .textops import checkpointed, slices, tidied, tuned

# Elements that end a line where they begin and end.
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
# Elements whose content is no text.
SILENT = set("script style noscript template iframe object svg canvas audio video math head title textarea select datalist".split())
# Elements, roles, and class names and ids that mark what isn't the article.
MARKED = set("nav footer aside form button menu dialog search".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
NAMES = set("ad ads advert adverts advertisement advertising sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead header topbar cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments disqus respond reply replies pagination pager toolbar widget skip".split())
VOID = set("area base br col embed hr img input link meta source track wbr".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: What structure says of a line: it goes; it stays; it goes if the neighbour has it. From SIDE on, the number of an article that goes if the neighbour has all of it.
CHROME, BODY, OPENED, SIDE = range(4)

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+|[^<>]*+)/?>""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
#: Elements without an end tag whose rest of the page is read on, as markup (the others hold raw text up to its end).
OPEN = set("noscript template object svg canvas audio video math select datalist head".split())
#: Neighbours of different content looked at on each side.
REACH = 3
#: URLs in the sample for each range.
SAMPLED = 10


def _marked(tag: str, attributes: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element's tag, role or hiding marks it, and whether a class name or id does."""
    if tag in MARKED or tag == "header" and not inside:
        return True, False
    named = False
    if attributes:
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            value, name = (a or b or c).lower(), name.lower()
            if name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
                return True, False
            if name in ("class", "id") and any(_chrome(x) for x in value.split()):
                # a page's root and its main element are never chrome, whatever a theme calls them
                named = tag not in ("html", "body", "main")
    return False, named


def _chrome(token: str) -> bool:
    """Whether a whole class name or id is a name, or made of names and numbers alone (cookie-notice, comment-12)."""
    words = [x for x in re.split(r"[-_0-9]+", token) if x]
    return bool(words) and NAMES.issuperset(words)


def lines(page: str | None) -> tuple[list[str], list[str]]:
    """(lines of the main element, or else of the body; lines outside it).  Marked lines are in the latter."""
    found = classed(page)
    return [x for x, kind in found if kind], [x for x, kind in found if not kind]


def classed(page: str | None) -> list[tuple[str, int]]:
    """Lines of a page with what structure says of each; those of a page without a main or article element are CHROME or OPENED."""
    found: list[tuple[str, bool, int, tuple, int, bool]] = []  # line, marked, 1: in an article, 2: in the main element, elements around it that a name marks, article, in an h1
    parts: list[str] = []
    stack: list[tuple] = []  # tag, marked, place, in a header of the article, elements that a name marks, outermost article
    outside = (False, 0, False, (), 0)
    state = outside
    at, page = 0, page or ""
    heading = ""
    n_named = n_articles = 0
    holds: dict[int, int] = {}  # the most of place in each of those

    def flush() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text:
                found.append((text, state[0] or state[2] and not heading, state[1], state[3], state[4], heading == "h1"))

    match = TOKEN.search(page)
    while match:
        if match.start() > at:
            parts.append(page[at : match.start()])
        at = match.end()
        tag = match[2].lower() if match[2] else ""
        if not tag:
            if page.startswith("<![CDATA[", match.start()):
                parts.append(entities.escape(page[match.start() + 9 : at - 3]))
        elif match[1]:
            if tag in BLOCKS:
                flush()
            if tag in HEADINGS:
                heading = ""
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    state = stack[-1][1:] if stack else outside
                    break
        elif tag in SILENT:
            if not page[match.start() : at].endswith("/>"):
                end = re.compile(rf"</{tag}\b[^>]*>" if tag != "head" else r"</head\s*>|(?=<body\b)", re.I).search(page, at)
                at = end.end() if end else at if tag in OPEN else len(page)
            parts.append(" ")
        elif tag == "br":
            parts.append(" ")
        else:
            block = tag in BLOCKS
            if block:
                flush()
                if stack and stack[-1][0] == "p":
                    stack.pop()
                    state = stack[-1][1:] if stack else outside
            if tag in HEADINGS:
                heading = tag
            if tag not in VOID:
                marked, named = _marked(tag, match[3], state[1] > 0)
                place = 2 if tag == "main" or "role" in match[3] and re.search(r"role\s*=\s*[\"']?main\b", match[3]) else max(state[1], 1 if tag == "article" else 0)
                names = state[3]
                if named:
                    names, n_named = (*names, n_named), n_named + 1
                article = state[4]
                if tag == "article" and not article:
                    article = n_articles = n_articles + 1
                if place > state[1]:
                    holds |= {k: max(place, holds.get(k, 0)) for k in names}
                if block or marked or named:
                    state = (state[0] or marked, place, state[2] or tag == "header" and state[1] > 0, names, article)
                    stack.append((tag, *state))
        match = TOKEN.search(page, at)
    parts.append(re.sub(r"<[/!a-zA-Z][^>]*\Z", "", page[at:]))  # a page may end within a tag
    flush()
    # a name marks no element that holds the only main or article element, or, where that leaves no text of one, most of the text
    best = max((place for _, marked, place, names, *_ in found if not marked and not names), default=0)
    free = {k for k, place in holds.items() if place > best}
    if not any(place and not marked and free.issuperset(names) for _, marked, place, names, *_ in found):
        within: dict[int, int] = {}
        for x, marked, _, names, *_ in found:
            for k in names if not marked else ():
                within[k] = within.get(k, 0) + len(x)
        whole = sum(len(x) for x, marked, *_ in found if not marked)
        free |= {k for k, n in within.items() if 2 * n > whole}
    known = [(x, marked or not free.issuperset(names), place, article, title) for x, marked, place, names, article, title in found]
    best = max((place for _, marked, place, *_ in known if not marked), default=0)
    if not best:
        return [(x, CHROME if marked else OPENED) for x, marked, *_ in known]
    sizes: dict[int, int] = {}
    for x, marked, place, article, _ in known:
        if not marked and place == best:
            sizes[article] = sizes.get(article, 0) + len(x)
    stays = {max(sizes, key=lambda k: sizes[k]), *(article for _, marked, place, article, title in known if title and article and not marked and place == best)}

    def kind(marked: bool, place: int, article: int, title: bool) -> int:
        if marked or place < best:
            return CHROME
        if article in stays or not article and title:
            return BODY
        return SIDE + article if article else OPENED

    return [(x, kind(*rest)) for x, *rest in known]


#: Bits of the table that an alignment is traced back in; larger ones are halved.
TABLE_BITS = 1 << 28


def common(a: list[int], b: list[int]) -> list[int]:
    """Positions in a of a longest common subsequence of a and b, by bit-parallel rows: time as a 64th of the product of lengths, memory bounded."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    # a line that the other doesn't have is in no common subsequence
    both = set(a[head : len(a) - tail]) & set(b[head : len(b) - tail])
    place = [i for i in range(head, len(a) - tail) if a[i] in both]
    found = _aligned([a[i] for i in place], [x for x in b[head : len(b) - tail] if x in both])
    return [*range(head), *(place[i] for i in found), *range(len(a) - tail, len(a))]


def _rows(a: list[int], b: list[int], every: bool) -> list[int]:
    """Row i says in its zero bits where the longest common length of a[:i + 1] and prefixes of b grows; all rows, or the last."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row, out = full, []
    for x in a:
        match = row & where.get(x, 0)
        row = (row + match | row - match) & full
        if every:
            out.append(row)
    return out if every else [row]


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Longest common length of a and each prefix of b."""
    row = _rows(a, b, False)[0]
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def _aligned(a: list[int], b: list[int]) -> list[int]:
    if not a or not b:
        return []
    if len(a) * len(b) > TABLE_BITS and len(a) > 1:
        # the place in b where a's halves meet
        half = len(a) // 2
        sums = _lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]
        cut = int(sums.argmax())
        return [*_aligned(a[:half], b[:cut]), *(half + i for i in _aligned(a[half:], b[cut:]))]
    rows = [x.to_bytes(len(b) // 8 + 1, "little") for x in _rows(a, b, True)]
    grows = lambda i, j: not rows[i][j >> 3] >> (j & 7) & 1
    i, j, out = len(a) - 1, len(b) - 1, []
    while i >= 0 and j >= 0:
        if not grows(i, j):
            j -= 1
        elif i and grows(i - 1, j):
            i -= 1
        else:
            out.append(i)
            i, j = i - 1, j - 1
    return out[::-1]


def _prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def _hashes(texts: list[str]) -> bytes:
    return np.array([xxhash.xxh64_intdigest(x.encode()) for x in texts], np.uint64).tobytes()


def _same(a: tuple, b: tuple) -> bool:
    """Whether two rows (host, path, line hashes, hash of the text) have one host and one text."""
    return a[0] == b[0] and a[3] == b[3]


def _known(page_id: int | None) -> int:
    """Null ids sort first."""
    return -(1 << 63) if page_id is None else page_id


def split_url(url: str | None) -> tuple[str, str]:
    """(host in lower case, path without query and fragment)."""
    match = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)([^?#]*)", url or "")
    return (match[1].lower(), match[2]) if match else ("", re.split(r"[?#]", url or "")[0])


def extracted(pages: DataFrame, html: str = "html", url: str = "url", id_: str = "page_id") -> DataFrame:
    """page_id, url, text, and what differencing did: aligned lines, shared lines, lines that it deleted, and lines that the check did afterwards."""
    tuned(pages.sparkSession)
    pages = pages.select(pages[id_].cast("long").alias("page_id"), pages[url].cast("string").alias("url"), pages[html].cast("string").alias("html"))
    # ranges of (host, path, id) come from a sample of URLs alone, so that pages are read once
    n_ranges = max(1, pages.rdd.getNumPartitions())
    some = pages.select("url", "page_id").sample(min(1.0, SAMPLED * n_ranges / max(1, pages.count())), 5) if n_ranges > 1 else pages.limit(0)
    points = sorted((*split_url(r.url), _known(r.page_id)) for r in some.select("url", "page_id").toLocalIterator())
    splitters = [points[len(points) * k // n_ranges] for k in range(1, n_ranges)] if points else []

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=7)
        for batch in batches:
            for part in slices(batch, "html"):
                out: dict[str, list] = {n: [] for n in ("range", "host", "path", "lines", "main", "hashes", "whole")}
                for i, u, h in zip(*(part.column(n).to_pylist() for n in ("page_id", "url", "html")), strict=True):
                    found = classed(h)
                    kinds = np.array([k for _, k in found], np.int32)
                    main = BODY in kinds
                    host, path = split_url(u)
                    text = "\n".join(x for x, k in found if k)
                    body = "\n".join(x for x, k in found if k == BODY) if main else text
                    out["range"].append(bisect_right(splitters, (host, path, _known(i))))
                    out["host"].append(host)
                    out["path"].append(path)
                    out["lines"].append(pack.compress(len(kinds).to_bytes(4, "little") + kinds.tobytes() + text.encode()))
                    out["main"].append(main)
                    out["hashes"].append(_hashes([x for x, k in found if k != (BODY if main else CHROME)]))
                    out["whole"].append(xxhash.xxh64_intdigest(body.encode()) - (1 << 63))
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), *(pa.array(out[n], k) for n, k in (("range", pa.int32()), ("host", pa.string()), ("path", pa.string()), ("lines", pa.binary()), ("main", pa.bool_()), ("hashes", pa.binary()), ("whole", pa.int64())))], ["page_id", "url", *out])

    rows = pages.mapInArrow(tidied(read), "page_id long, url string, range int, host string, path string, lines binary, main boolean, hashes binary, whole long")
    keys = ["host", "path", "page_id", "whole"]
    rows = checkpointed(rows.repartitionById(n_ranges, "range").drop("range").sortWithinPartitions(*keys))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one run more than REACH, as the nearest may go on with the neighbour's own
        first: list[tuple] = []
        last: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in ("host", "path", "hashes", "whole")), strict=True):
                again = bool(last) and _same(last[-1], row)
                if again:
                    last[-1] = row
                else:
                    if len(first) <= REACH:
                        first.append(row)
                    last = [*last[-REACH:], row]
        own = TaskContext.get().partitionId()
        for at, some in ((0, first), (1, last)):
            if some:
                n = len(some)
                columns = zip(*some, strict=True)
                kinds = (pa.string(), pa.string(), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([own] * n, pa.int32()), pa.array([at] * n, pa.int32()), pa.array(range(n), pa.int32()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["part", "at", "i", "host", "path", "hashes", "whole"])

    edges = sorted(tuple(r) for r in rows.mapInArrow(tidied(ends), "part int, at int, i int, host string, path string, hashes binary, whole long").collect())
    heads: dict[int, list] = {}
    tails: dict[int, list] = {}
    for part, at, _, *row in edges:
        (tails if at else heads).setdefault(part, []).append(tuple(row))
    parts = sorted(heads)
    place = {p: i for i, p in enumerate(parts)}

    def near(part: int, step: int) -> list[tuple]:
        """Runs beside a partition, nearest first, REACH of them at least besides one that its own goes on in; small partitions are passed through."""
        out: list[tuple] = []
        i = place[part] + step
        while 0 <= i < len(parts) and len(out) <= REACH:
            for row in heads[parts[i]] if step > 0 else tails[parts[i]][::-1]:
                if not out or not _same(out[-1], row):
                    out.append(row)
            i += step
        return out

    beside = {p: (near(p, -1), near(p, 1)) for p in parts}

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, after = beside.get(TaskContext.get().partitionId(), ([], []))
        unpack = zstandard.ZstdDecompressor()
        # runs of rows with equal text: first and last row; rows wait until REACH runs after theirs are known
        known: list[list[tuple]] = [[row, row] for row in reversed(before)]
        waiting: list[tuple] = []

        def meet(row: tuple) -> None:
            if known and _same(known[-1][1], row):
                known[-1][1] = row
            else:
                known.append([row, row])

        def emit(i: int, row: tuple) -> tuple:
            page_id, url, packed, main, host, path, hashes, whole = row
            mine = np.frombuffer(hashes, np.uint64).tolist()
            content = unpack.decompress(packed)
            at = 4 + 4 * int.from_bytes(content[:4], "little")
            kinds = np.frombuffer(content[4:at], np.int32).tolist()
            text = iter(content[at:].decode().split("\n"))
            others = []
            for j in range(max(0, i - REACH), min(len(known), i + REACH + 1)):
                other = known[j][1 if j < i else 0]
                if j != i and other[0] == host and other[3] != whole:
                    others.append((-_prefix(path, other[1]), abs(i - j), j, other[2]))
            shared: list[int] = []
            for *_, theirs in sorted(others):
                got = common(mine, np.frombuffer(theirs, np.uint64).tolist())
                # a page that has every line is a copy, too; one whose template outweighs its article is none
                if len(got) < len(mine) or main:
                    shared = got
                    break
            aligned = [k for k, kind in enumerate(kinds) if kind != (BODY if main else CHROME)]
            deleted = {aligned[k] for k in shared}
            whole_sides = {kind for kind in kinds if kind > SIDE} - {kinds[k] for k in aligned if k not in deleted}
            deleted = {k for k in deleted if kinds[k] < SIDE or kinds[k] in whole_sides}
            # lines of the text stand for all kinds but CHROME, which is checked last
            left = [(kind, next(text) if kind else "") for kind in kinds]
            left = [x for k, x in enumerate(left) if k not in deleted]
            joined = "\n".join(x for kind, x in left if kind != CHROME)
            return page_id, url, joined, len(joined), len(mine), len(shared), len(deleted), sum(kind == CHROME for kind, _ in left)

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 5)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "url", "text", "n_chars", "n_aligned", "n_shared", "n_deleted", "n_checked"])

        for batch in batches:
            for part in slices(batch, "url", 1 << 16):
                for r in zip(*(part.column(n).to_pylist() for n in ("page_id", "url", "lines", "main", "host", "path", "hashes", "whole")), strict=True):
                    meet(r[4:])
                    if waiting and waiting[-1][0] == len(known) - 1 and waiting[-1][1][2] == r[2]:
                        r = (*r[:2], waiting[-1][1][2], *r[3:])  # a long run of copies holds their text once
                    waiting.append((len(known) - 1, r))
                ready = [w for w in waiting if w[0] + REACH < len(known)]
                waiting = waiting[len(ready) :]
                for k in range(0, len(ready), 256):
                    yield out([emit(i, row) for i, row in ready[k : k + 256]])
                drop = max(0, (waiting[0][0] if waiting else len(known) - 1) - REACH)
                known = known[drop:]
                waiting = [(i - drop, row) for i, row in waiting]
        for row in after:
            meet(row)
        for k in range(0, len(waiting), 256):
            yield out([emit(i, row) for i, row in waiting[k : k + 256]])

    return rows.mapInArrow(tidied(compare), "page_id long, url string, text string, n_chars long, n_aligned long, n_shared long, n_deleted long, n_checked long")


def op7(spark, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
