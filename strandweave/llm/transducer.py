"""Token counts and ids by compiled finite-state transducers.

The tokenizer file's pre-tokenizer becomes a deterministic lexer over seven character classes (three of them look one or
two characters ahead, for contractions).  Text is cut into chunks; each chunk's map from states to states is found for all
states at once, the maps are composed by a parallel prefix scan, and with its entry state known each chunk marks where
pieces start.

The merge rules become a second deterministic transducer, over the bytes of a piece: a transition carries the number of tokens that its
byte adds to what the merges leave of the prefix (or takes back), and a piece's end the number that the end adds.  All pieces of a slice walk it
together, and what they emit is added up.  Transitions are compiled from the merge ranks when a piece first takes them: the tokens of a prefix
are those of a shorter one and a last token, which is found by looking whether any merge would reach across the border of two tokens.
Transitions are looked up by state and byte, so no result rests on a hash.  Pieces of more than MOST_BYTES bytes are merged directly.

Texts are normalised first.  Those with a character of no sure class (unassigned or private, one-to-many lower case, a capital sigma) or
with a special token's string are given to the library itself.  Edge cases: null and empty texts have no tokens; a very long piece costs n log n.
"""

from __future__ import annotations

import gc
import heapq
import json
import os
import unicodedata
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textops import U64, HashIndex, Rolling, flat, mix, ranges, same_bytes, slices, tidied, tuned

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

TOP = 0x40000
CHUNK = 64
#: States are dropped beyond this number, pieces without states beyond these bytes, and pieces' ids beyond this number of pieces; that costs time, and changes no result.
MOST_STATES, MOST_LONG, MOST_PIECES = 2_000_000, 1 << 24, 800_000
#: Bytes of a piece that has states.
MOST_BYTES = 64
UNKNOWN = np.iinfo(np.int32).min
# Classes: space, letter, number, other, apostrophe with a contraction of one letter, of two, and unsafe characters.
SPACE, LETTER, NUMBER, OTHER, SHORT, LONG, UNSAFE = range(7)
# Unicode white space below TOP.
WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# The pre-tokenizer's contractions.
CONTRACTIONS = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d"]


def _tables() -> tuple[np.ndarray, np.ndarray]:
    kind, lower = np.full(TOP + 1, UNSAFE, np.uint8), np.arange(TOP + 1, dtype=np.uint32)
    for c in range(TOP):
        x = chr(c)
        low = x.lower()
        if len(low) != 1 or x == "Σ" or unicodedata.category(x) in ("Cn", "Cs", "Co"):
            continue
        # the library's order of marks may be that of an older standard
        if unicodedata.combining(x) and unicodedata.ucd_3_2_0.category(x) == "Cn":
            continue
        lower[c] = ord(low)
        family = unicodedata.category(low)
        kind[c] = SPACE if c in WHITE else LETTER if family[0] == "L" else NUMBER if family[0] == "N" else OTHER
    return kind, lower


KIND, LOWERED = _tables()
# States: outside, in letters, in others, after a number, one contraction letter to go, two to go.
OUT, LETTERS, OTHERS, DIGIT, ONE, TWO = range(6)
STATES = 6


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a piece starts, by state * 8 + class."""
    go, starts = np.zeros((STATES, 8), np.uint8), np.zeros((STATES, 8), bool)
    for s in range(STATES):
        go[s, LETTER] = {ONE: DIGIT, TWO: ONE}.get(s, LETTERS)  # a finished contraction is like a number: nothing joins it
        starts[s, LETTER] = s not in (LETTERS, ONE, TWO)
        go[s, NUMBER], starts[s, NUMBER] = DIGIT, True
        for c, to in ((OTHER, OTHERS), (SHORT, ONE), (LONG, TWO)):
            go[s, c] = OTHERS if s == OTHERS else to
            starts[s, c] = s != OTHERS
    return go.ravel(), starts.ravel()


GO, STARTS = _machine()


def state_maps(kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry state of each chunk, classes by place in the chunk): kinds is padded to whole chunks."""
    n = -(-len(kinds) // CHUNK)
    by_place = np.zeros(n * CHUNK, np.uint8)
    by_place[: len(kinds)] = kinds
    by_place = np.ascontiguousarray(by_place.reshape(n, CHUNK).T)
    maps = np.repeat(np.arange(STATES, dtype=np.uint8)[:, None], n, 1)
    for c in by_place:
        maps = GO[(maps << 3) | c]
    # inclusive scan: after it, maps[:, i] composes chunks 0 to i
    step = 1
    while step < n:
        maps[:, step:] = maps[maps[:, :-step], np.arange(step, n)]
        step *= 2
    return np.concatenate((np.zeros(1, np.uint8), maps[OUT, :-1])), by_place


def pieces(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, code points in lower case, whether a code point is unsafe) of an array of code points."""
    small = np.minimum(text, TOP)
    kinds, low = KIND[small], LOWERED[small]
    unsafe = kinds == UNSAFE
    kinds[unsafe] = SPACE
    quote = np.flatnonzero(small == 0x27)
    if len(quote):
        padded = np.concatenate((low, [0, 0]))
        one, two = padded[quote + 1], padded[quote + 2]
        for c in CONTRACTIONS:
            hit = one == ord(c[1])
            if len(c) == 3:
                hit &= two == ord(c[2])
            kinds[quote[hit]] = SHORT if len(c) == 2 else LONG
    state, by_place = state_maps(kinds)
    begins = np.empty(by_place.shape, bool)
    for i, c in enumerate(by_place):
        at = (state << 3) | c
        begins[i], state = STARTS[at], GO[at]
    begins = np.ascontiguousarray(begins.T).ravel()[: len(text)]
    solid = kinds != SPACE
    after = np.concatenate((begins[1:] | ~solid[1:], [True]))
    return np.flatnonzero(begins), np.flatnonzero(solid & after) + 1, low, unsafe


@dataclass
class Parsed:
    """Bytes in lower case, pieces in them, bounds of the pieces by text, hashes of pieces if asked for, content and its bounds by text, texts for the library."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    hashes: np.ndarray
    content: tuple[np.ndarray, np.ndarray]
    odd: list[int]


class Compiled:
    """A tokenizer file of the word BPE kind, compiled; kept by a worker for all of its tasks.

    State 0 is a piece's start, and state k + 1 is where transition k leads: a prefix of pieces.  The merges leave of a prefix the tokens
    of a shorter one, and one more: its last token, the one that stays apart from the last of what is before it.
    """

    _held: dict[str, Compiled] = {}

    @classmethod
    def of(cls, name: str) -> Compiled:
        if name not in cls._held:
            cls._held[name] = cls(name)
        return cls._held[name]

    def __init__(self, name: str) -> None:
        import public_tokenizers
        from tokenizers import Tokenizer

        path = name if os.path.isabs(name) else public_tokenizers.path(name)
        self.library = Tokenizer.from_file(str(path))
        with open(path) as file:
            spec = json.load(file)
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocabulary: dict[str, int] = model["vocab"]
        #: a merge's place among the merges, by its pair; a token's place and parts; single symbols have neither
        self.rank: dict[tuple[str, str], int] = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.parts: dict[str, tuple[int, str, str]] = {a + b: (i, a, b) for (a, b), i in self.rank.items()}
        self.longest = max(len(t.removesuffix(self.suffix)) for t in self.vocabulary)
        self.byte = _byte_symbols()
        self.sound: dict[str, bool] = {}
        self.values = mix(np.arange(TOP + 1, dtype=U64) + U64(977)) | U64(1)
        self.reset()

    def reset(self) -> None:
        """Drops all states but the start."""
        self.index = HashIndex(18)
        self.emits = np.zeros(1 << 12, np.int32)  # tokens that a transition adds (or takes back)
        self.closes = np.full(1 << 12, UNKNOWN, np.int32)  # by state: tokens that a piece's end adds
        self.parent, self.symbol = array("i", [-1]), array("B", [0])
        self.total, self.back, self.last = array("i", [0]), array("i", [0]), [""]  # by state: tokens of the prefix, the state before its last token, that token
        self.long: dict[bytes, int] = {}
        self.long_bytes = 0

    def apart(self, a: str, b: str, own: bool = False) -> bool:
        """Whether no merge joins what is left of the border of tokens a and b with what is right of it, at any time; own: but their own."""
        rank, parts = self.rank, self.parts
        limit, strict = 1 << 60, True
        while True:
            got = rank.get((a, b))
            if got is not None and not own and (got < limit or not strict and got == limit):
                return False
            own = False
            x, y = parts.get(a), parts.get(b)
            if x is None and y is None:
                return True
            # back to before the later of the two was merged; of one merge's places the right one is later
            if y is None or x is not None and x[0] > y[0]:
                limit, a, strict = x[0], x[2], True
            else:
                limit, b, strict = y[0], y[1], False

    def whole(self, token: str) -> bool:
        """Whether the merges make this token of its own symbols."""
        got = self.sound.get(token)
        if got is None:
            part = self.parts.get(token)
            got = part is None or self.whole(part[1]) and self.whole(part[2]) and self.apart(part[1], part[2], own=True)
            self.sound[token] = got
        return got

    def _path(self, state: int) -> tuple[str, list[int]]:
        """(symbols of a state's prefix, states on the way to it from the start)."""
        line, symbols = [state], []
        while state:
            symbols.append(self.byte[self.symbol[state]])
            state = self.parent[state]
            line.append(state)
        return "".join(reversed(symbols)), line[::-1]

    def _last(self, text: str, line: list[int]) -> tuple[int, str]:
        """(state before the last token, last token) of the symbols of a path of states, or of them and the suffix."""
        n = len(line) - 1
        for at in range(max(0, n - self.longest), n):
            token = text[at:]
            if token in self.vocabulary and self.whole(token):
                before = line[at]
                if not before or self.apart(self.last[before], token):
                    return before, token
        raise ValueError("a symbol isn't in the vocabulary")

    def _end(self, state: int) -> tuple[int, str]:
        text, line = self._path(state)
        return self._last(text + self.suffix, line)

    def close(self, states: list[int]) -> None:
        """Compiles pieces' ends."""
        for s in states:
            before, _ = self._end(s)
            self.closes[s] = self.total[before] + 1 - self.total[s]

    def walk(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state, tokens emitted on the way) of each piece of data[start:end], MOST_BYTES of it at most; missing transitions are compiled."""
        size = np.minimum(ends - starts, MOST_BYTES).astype(np.uint8)
        order = np.argsort(size, kind="stable")[::-1]
        count = len(size) - np.cumsum(np.bincount(size, minlength=MOST_BYTES + 1))  # pieces longer than a size
        at = starts[order]
        state, emitted = np.zeros(len(at), np.int64), np.zeros(len(at), np.int32)
        step, near = 0, {}
        while step <= MOST_BYTES and count[step]:
            m = int(count[step])
            key = mix((state[:m] << 8 | data[at[:m] + step]).astype(U64))
            go = self.index.find(key)
            new = np.flatnonzero(go < 0)
            if len(new):
                fresh, first = np.unique(key[new], return_index=True)
                first = new[first]
                gc.disable()  # the lists of a step hold no cycles, and there are many
                near = self._compile(state[:m][first].tolist(), data[at[first] + step].tolist(), near)
                gc.enable()
                self.index.add(fresh)
                go[new] = self.index.find(key[new])
            emitted[:m] += self.emits[go]
            state[:m] = go + 1
            step += 1
        out, sums = np.empty_like(state), np.empty_like(emitted)
        out[order], sums[order] = state, emitted
        return out, sums

    def _compile(self, states: list[int], symbols: list[int], near: dict[int, tuple[str, list[int]]]) -> dict[int, tuple[str, list[int]]]:
        """Adds transitions from states by symbols; near: paths of the states of the step before.  Returns those of the new states."""
        n = len(self.parent)
        while n + len(states) >= len(self.emits):
            self.emits = np.concatenate((self.emits, np.zeros_like(self.emits)))
            self.closes = np.concatenate((self.closes, np.full_like(self.closes, UNKNOWN)))
        paths, emits = {}, []
        for k, (s, b) in enumerate(zip(states, symbols, strict=True), n):
            text, line = near.get(s) or self._path(s)
            text += self.byte[b]
            line = [*line, k]
            before, token = self._last(text, line)
            total = self.total[before] + 1
            emits.append(total - self.total[s])
            self.parent.append(s)
            self.symbol.append(b)
            self.total.append(total)
            self.back.append(before)
            self.last.append(token)
            paths[k] = text, line
        self.emits[n - 1 : n - 1 + len(emits)] = emits
        return paths

    def parsed(self, texts: pa.Array, hashes: bool = False) -> Parsed:
        """Pieces of some texts, and which texts are for the library."""
        raw, offsets = flat(texts)
        whole = raw.tobytes()
        odd = set()
        for s in self.special:
            at = whole.find(s)
            while at >= 0:
                odd.add(int(np.searchsorted(offsets, at, "right")) - 1)
                at = whole.find(s, at + 1)
        string = whole.decode()
        if not unicodedata.is_normalized("NFC", string):
            raw, offsets = flat(pa.array([unicodedata.normalize("NFC", t or "") for t in texts.to_pylist()], pa.string()))
            string = raw.tobytes().decode()
        text = np.frombuffer(string.encode("utf-32-le"), np.uint32)
        starts, ends, low, unsafe = pieces(text)
        # code points before each byte offset
        if len(text) == len(raw):
            ends_at = offsets
        else:
            ends_at = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))[offsets]
        if unsafe.any():
            odd |= set((np.searchsorted(ends_at, np.flatnonzero(unsafe), "right") - 1).tolist())
        h, content = np.zeros(0, U64), (np.zeros(0, U64), np.zeros(0, np.int64))
        if hashes:
            n = len(low)
            power, inverse = Rolling.tables(n + 1)
            sums = np.zeros(n + 1, U64)
            np.cumsum(self.values[np.minimum(low, TOP)] * power[:n], out=sums[1:])
            h = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U64))
            content = h, np.searchsorted(starts, ends_at)
            loose = np.flatnonzero(unsafe)
            if len(loose):
                at = np.concatenate((starts, loose))
                order = np.argsort(at, kind="stable")
                content = np.concatenate((h, mix(text[loose].astype(U64) + U64(1 << 32))))[order], np.searchsorted(at[order], ends_at)
        bounds = np.searchsorted(starts, ends_at)
        if odd:
            keep = np.ones(len(starts), bool)
            for d in odd:
                keep[bounds[d] : bounds[d + 1]] = False
            starts, ends, h = starts[keep], ends[keep], h[keep[: len(h)]]
            bounds = np.searchsorted(starts, ends_at)
        # pieces as bytes
        if len(text) and int(low.max()) >= 0x80:
            width = 1 + (low >= 0x80).astype(np.int64) + (low >= 0x800) + (low >= 0x10000)
            to = np.concatenate(([0], np.cumsum(width)))
            data = np.frombuffer(low.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
            starts, ends = to[starts], to[ends]
        else:
            data = low.astype(np.uint8)
        return Parsed(data, starts, ends, bounds, h, content, sorted(odd))

    def emitted(self, p: Parsed) -> np.ndarray:
        """Tokens of each piece."""
        if len(self.parent) > MOST_STATES:
            self.reset()
        short = p.ends - p.starts <= MOST_BYTES
        out = np.zeros(len(p.starts), np.int64)
        state, out[short] = self.walk(p.data, p.starts[short], p.ends[short])
        self.close(np.unique(state[self.closes[state] == UNKNOWN]).tolist())
        out[short] += self.closes[state]
        for i in np.flatnonzero(~short).tolist():
            out[i] = self.emitted_long(p.data[p.starts[i] : p.ends[i]].tobytes())
        return out

    def emitted_long(self, piece: bytes) -> int:
        """Tokens of a piece that has no state, by merges in the order of their ranks."""
        got = self.long.get(piece)
        if got is None:
            if self.long_bytes > MOST_LONG:
                self.long, self.long_bytes = {}, 0
            symbols = [self.byte[b] for b in piece]
            symbols[-1] += self.suffix
            got = self.long[piece] = self._merged(symbols)
            self.long_bytes += len(piece)
        return got

    def _merged(self, symbols: list[str]) -> int:
        n = left = len(symbols)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(self.rank[p], i, p) for i in range(n - 1) if (p := (symbols[i], symbols[i + 1])) in self.rank]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if j < 0 or (symbols[i], symbols[j]) != pair:
                continue
            symbols[i] += symbols[j]
            symbols[j] = ""
            left -= 1
            after[i] = k = after[j]
            after[j] = -1
            if k >= 0:
                before[k] = i
                if (p := (symbols[i], symbols[k])) in self.rank:
                    heapq.heappush(heap, (self.rank[p], i, p))
            if (h := before[i]) >= 0 and (p := (symbols[h], symbols[i])) in self.rank:
                heapq.heappush(heap, (self.rank[p], h, p))
        return left

    def count(self, texts: pa.Array) -> np.ndarray:
        p = self.parsed(texts)
        sums = np.concatenate(([0], np.cumsum(self.emitted(p))))
        out = sums[p.bounds[1:]] - sums[p.bounds[:-1]]
        for d in p.odd:
            out[d] = len(self.library.encode(texts[d].as_py(), add_special_tokens=False).ids)
        return out


class Encoded(Compiled):
    """The same lexer with token ids: the library's, kept for each distinct piece.

    Pieces are found by 64-bit hashes and compared byte by byte; a text with a piece whose hash is another's goes to the library.
    """

    _held: dict[str, Encoded] = {}

    def reset(self) -> None:
        self.index = HashIndex(18)
        self.ids, self.bounds = np.zeros(0, np.int32), np.zeros(1, np.int64)
        # the pieces themselves: bytes, and where each begins
        self.data, self.begins = np.zeros(0, np.uint8), np.zeros(1, np.int64)

    def _encoded(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids by piece) of pieces on end, by the library's model; it takes a character for each byte."""
        characters = np.array([ord(c) for c in self.byte], "<u4")[data].tobytes().decode("utf-32-le")
        tokenize, ids, counts, at = self.library.model.tokenize, [], [], 0
        for to in ends.tolist():
            got = tokenize(characters[at:to])
            ids += [t.id for t in got]
            counts.append(len(got))
            at = to
        return np.array(ids, np.int32), np.array(counts, np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, bounds by text, hashes of the content, bounds of those by text).

        The content is pieces and, of texts for the library, each unsafe character, too.
        """
        p = self.parsed(texts, hashes=True)
        h = p.hashes
        number = self.index.find(h)
        new = np.flatnonzero(number < 0)
        if len(new):
            if self.index.count + len(new) > MOST_PIECES or len(self.data) > MOST_LONG:
                self.reset()
                new = np.arange(len(h))
            fresh, first = np.unique(h[new], return_index=True)
            first = new[first]
            size = (p.ends - p.starts)[first]
            own = p.data[ranges(p.starts[first], size)]
            ends = np.cumsum(size)
            self.begins = np.concatenate((self.begins, self.begins[-1] + ends))
            self.data = np.concatenate((self.data, own))
            got, counts = self._encoded(own, ends)
            self.ids = np.concatenate((self.ids, got))
            self.bounds = np.concatenate((self.bounds, self.bounds[-1] + np.cumsum(counts)))
            self.index.add(fresh)
            number = self.index.find(h)
        size = (self.bounds[1:] - self.bounds[:-1])[number]
        ids = self.ids[ranges(self.bounds[number], size)]
        cut = np.concatenate(([0], np.cumsum(size)))[p.bounds]
        length = p.ends - p.starts
        same = self.begins[number + 1] - self.begins[number] == length
        same[same] = same_bytes(p.data, p.starts[same], self.data, self.begins[number[same]], length[same])
        odd = sorted({*p.odd, *(np.searchsorted(p.bounds, np.flatnonzero(~same), "right") - 1).tolist()})
        if odd:
            parts, at = [], 0
            extra = np.zeros(len(p.bounds), np.int64)
            for d in odd:
                got = np.array(self.library.encode(texts[d].as_py(), add_special_tokens=False).ids, np.int32)
                parts += [ids[at : cut[d]], got]
                at = cut[d + 1]
                extra[d + 1 :] += len(got) - (cut[d + 1] - cut[d])
            ids = np.concatenate([*parts, ids[at:]])
            cut = cut + extra
        return ids, cut, *p.content


def _byte_symbols() -> list[str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on, in order."""
    out, spare = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


COUNTED = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])


def token_counts(docs: DataFrame, text: str = "text", tokenizer: str = "word_bpe_49k.json", into: str = "tokens") -> DataFrame:
    """docs with a struct added: n_bytes and n_tokens.  tokenizer: a file's path, or a name that public_tokenizers knows."""
    tuned(docs.sparkSession)
    if into in docs.columns:
        raise ValueError(f"there is a column {into} already")
    at, names = docs.columns.index(text), docs.columns
    docs = docs.withColumn(text, F.col(text).cast("string"))
    schema = T.StructType([*(T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)), T.StructField("counted", COUNTED)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Compiled.of(tokenizer)
        for batch in batches:
            for part in slices(batch.rename_columns([f"c{i}" for i in range(batch.num_columns)]), f"c{at}", 1 << 21):
                texts = part.column(at)
                n = machine.count(texts)
                _, offsets = flat(texts)
                counted = pa.StructArray.from_arrays([pa.array(np.diff(offsets) - 1, pa.int64()), pa.array(n, pa.int64())], ["n_bytes", "n_tokens"])
                yield pa.RecordBatch.from_arrays([*part.columns, counted], schema.names)

    return docs.mapInArrow(tidied(count), schema).toDF(*names, into)


def op6(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    t = F.col("tokens")
    out = token_counts(docs).select("doc_id", t.n_bytes.alias("n_bytes"), t.n_tokens.alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > 2048)
