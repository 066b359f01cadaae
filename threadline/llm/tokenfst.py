"""Token counts by finite-state transducers that are compiled from a byte-level BPE file.

Two deterministic transducers give the number of tokens without making any:

* `Splitter` reads classes of characters and says where the pre-tokeniser's
  pieces begin. It has nine states. A run of texts is one stream, cut into
  chunks of one length; a chunk becomes a map from every state it may be
  entered in to the state it is left in, the maps are composed by a parallel
  prefix scan, and with the entry states known all chunks advance together once
  more and mark the beginnings.
* `Counter` reads the bytes of a piece; every transition carries the number of
  tokens by which the piece's prefix has more (or fewer) than before. It rests
  on a property of merges: the encoding of a prefix is the encoding of a
  shorter prefix and one more token, and a token may follow another if no merge
  across them comes before the merges that made them. So a state is the set of
  token beginnings that the prefix ends in, each with the last token before it
  and the count there relative to now: finitely many, compiled when they are
  first met and kept in a table of bounded size. Each distinct
  piece of a run is read once, all in step; long pieces are cut into chunks that
  start in a guessed state and are read again where their map is not defined for
  the state that the chunk before is left in.

What counts as letter, digit or white space is asked of the library, character
by character, once on the driver: its tables are of another Unicode version
than Python's.

Defined results: a null text is an empty one and has no tokens; added tokens'
strings in a text count as one token and part what is around them, as the
library does by default; very long texts and words are read whole; repeated
rows stay; rows keep their columns in `token_counts`, where clashing names are
overwritten; an empty table gives an empty one.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import distinct_parts, give_back, runs
from .common import table

#: Bytes of texts, and of distinct pieces, that are worked on together.
RUN, PIECES = 1 << 22, 1 << 16
#: Characters of a chunk of the stream, and bytes of a chunk of a long piece with what is read before it for a guess.
CHUNK, PART, WARM = 256, 128, 32
#: Transitions that are remembered before the table starts anew, and its slots.
TRANSITIONS, SLOTS = 1 << 19, 1 << 21

# --- classes of characters -------------------------------------------------------------------------------------

#: The blank, other white space, letters, digits, all else, the apostrophe, letters of contractions, and the end of a text.
BLANK, WHITE, LETTER, DIGIT, OTHER, QUOTE, SINGLE, R_OR_V, L, E, END = range(11)
CLASSES = 11
_kinds: dict[str, list[tuple[int, int]]] = {}


def char_kinds(path: str) -> list[tuple[int, int]]:
    """(first character, class) of the stretches of characters of one class, as the file's pre-tokeniser sees them."""
    if path not in _kinds:
        from tokenizers import Tokenizer

        begins = lambda text, pre=Tokenizer.from_file(path).pre_tokenizer: {s for _, (s, _) in pre.pre_tokenize_str(text)}
        kind = np.full(0x110000, OTHER, np.uint8)
        for at in range(0, 0x110000, 256):
            if 0xD800 <= at < 0xE000:
                continue
            block = [chr(c) for c in range(at, at + 256)]
            alike = len(begins("".join(block))) == 1  # most blocks are of one class, and one character tells it
            some = block[:1] if alike else block
            beside, doubled = begins("".join(f"a{c}1" for c in some)), begins("".join(f"{c}{c}!1" for c in some))
            for i, _ in enumerate(some):
                own, after = 3 * i + 1 in beside, 3 * i + 2 in beside
                found = (DIGIT if own else LETTER) if not own or not after else WHITE if 4 * i + 1 in doubled else OTHER
                kind[at + i : at + (256 if alike else i + 1)] = found
        for c, k in ((" ", BLANK), ("'", QUOTE), ("s", SINGLE), ("t", SINGLE), ("m", SINGLE), ("d", SINGLE), ("r", R_OR_V), ("v", R_OR_V), ("l", L), ("e", E)):
            kind[ord(c)] = k
        cut = np.flatnonzero(np.append(True, kind[1:] != kind[:-1]))
        _kinds[path] = list(zip(cut.tolist(), kind[cut].tolist(), strict=True))
    return _kinds[path]


# --- the splitting transducer ----------------------------------------------------------------------------------

#: Nothing before (or a contraction is complete); in letters, digits, others; after white space that ends in a blank, in something else;
#: after an apostrophe that begins a piece, then r or v, then l.
FRESH, IN_LETTERS, IN_DIGITS, IN_OTHERS, AFTER_BLANK, AFTER_WHITE, AFTER_QUOTE, NEEDS_E, NEEDS_L = range(9)
STATES = 9
#: Marks of a transition: a piece begins at the character read, at the one before it.
HERE, BEFORE = 1, 2


def splitting_table() -> tuple[np.ndarray, np.ndarray]:
    """Next state and marks of every (state, class), flat."""
    letters = (LETTER, SINGLE, R_OR_V, L, E)
    into = {BLANK: AFTER_BLANK, WHITE: AFTER_WHITE, DIGIT: IN_DIGITS, OTHER: IN_OTHERS, QUOTE: AFTER_QUOTE, END: FRESH} | dict.fromkeys(letters, IN_LETTERS)
    to, mark = np.zeros((STATES, CLASSES), np.uint8), np.zeros((STATES, CLASSES), np.uint8)
    for c, state in into.items():
        to[:, c], mark[:, c] = state, HERE
        white = c in (BLANK, WHITE)
        if c == END:
            mark[[NEEDS_E, NEEDS_L], c] = HERE | BEFORE
            continue
        for s, same in ((IN_LETTERS, letters), (IN_DIGITS, (DIGIT,)), (IN_OTHERS, (OTHER, QUOTE))):
            if c in same:
                to[s, c], mark[s, c] = s, 0
        for s in (AFTER_BLANK, AFTER_WHITE):  # of a run of white space the last character stands apart, or goes along if it is a blank
            mark[s, c] = 0 if white else BEFORE if s == AFTER_BLANK else BEFORE | HERE
        if c == QUOTE:
            to[AFTER_BLANK, c] = IN_OTHERS
        if c in (OTHER, QUOTE):
            to[AFTER_QUOTE, c], mark[AFTER_QUOTE, c] = IN_OTHERS, 0
        for s in (NEEDS_E, NEEDS_L):  # not a contraction: the letter after the apostrophe begins a piece
            to[s, c], mark[s, c] = to[IN_LETTERS, c], mark[IN_LETTERS, c] | BEFORE
    for s, c, state in ((AFTER_QUOTE, SINGLE, FRESH), (AFTER_QUOTE, R_OR_V, NEEDS_E), (AFTER_QUOTE, L, NEEDS_L), (NEEDS_E, E, FRESH), (NEEDS_L, L, FRESH)):
        to[s, c], mark[s, c] = state, 0
    return to.reshape(-1), mark.reshape(-1)


def composed(maps: np.ndarray) -> np.ndarray:
    """For maps of states (rows), the composition of each with all before it: a parallel prefix scan in log2(rows) steps."""
    step = 1
    while step < len(maps):
        maps = np.concatenate((maps[:step], np.take_along_axis(maps[step:], maps[:-step], axis=1)))
        step *= 2
    return maps


class Splitter:
    def __init__(self, kinds: list[tuple[int, int]]):
        first, kind = np.array(kinds).T
        self.kind = np.repeat(kind, np.diff(np.append(first, 0x110000))).astype(np.uint8)
        self.to, self.mark = splitting_table()

    def beginnings(self, chars: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether a piece begins at each character of texts that stand end to end and have these sizes."""
        ends = np.cumsum(size) + np.arange(len(size))  # each text is followed by an END
        n = len(chars) + len(size)
        stream = np.full(-(-n // CHUNK) * CHUNK, END, np.uint8)
        is_char = np.zeros(n, bool)
        is_char[:] = True
        is_char[ends] = False
        stream[:n][is_char] = self.kind[chars]
        steps = np.ascontiguousarray(stream.reshape(-1, CHUNK).T).astype(np.intp)
        maps = np.repeat(np.arange(STATES, dtype=np.intp)[None], steps.shape[1], axis=0)
        for c in steps:
            maps = self.to[maps * CLASSES + c[:, None]].astype(np.intp)
        left = composed(maps)[:, FRESH]
        state = np.concatenate(([FRESH], left[:-1])).astype(np.intp)
        marks = np.zeros((CHUNK, steps.shape[1]), np.uint8)
        for k, c in enumerate(steps):
            at = state * CLASSES + c
            marks[k], state = self.mark[at], self.to[at].astype(np.intp)
        marks = marks.T.reshape(-1)[:n]
        begins = (marks & HERE).astype(bool)
        begins[:-1] |= (marks[1:] & BEFORE).astype(bool)
        return begins[is_char]


# --- the counting transducer -----------------------------------------------------------------------------------


def byte_letters() -> dict[str, int]:
    """The characters by which a byte-level file writes bytes: printable Latin-1 ones for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """A file's tokens as bytes, with the merges that make them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = byte_letters()
        self.id = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if all(c in letters for c in t)}
        self.bytes = {i: t for t, i in self.id.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}  # token -> rank, left, right
        for r, m in enumerate(model["merges"]):
            a, b = (bytes(letters[c] for c in t) for t in (m.split(" ") if isinstance(m, str) else m))
            pair, new = (self.id[a], self.id[b]), self.id[a + b]
            self.rank[pair] = r
            if new in self.made:
                raise ValueError("a token is made by two merges; encodings would not follow from neighbours")
            if any(x in self.made and self.made[x][0] >= r or x not in self.made and len(self.bytes[x]) > 1 for x in pair):
                raise ValueError("a merge comes before those that make its sides")
            self.made[new] = (r, *pair)
        if any(bytes([b]) not in self.id for b in range(256)):
            raise ValueError("a byte has no token")
        self.edges: dict[tuple[int, int], list[tuple[int, float]]] = {}
        self.apart: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}

    def edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """Tokens that stand at this edge (0 left, 1 right) while the token is made, and the rank of the merge that takes each up."""
        if (token, side) not in self.edges:
            found, taken, t = [(token, float("inf"))], 0.0, token
            while t in self.made:
                taken, t = self.made[t][0], self.made[t][1 + side]
                found.append((t, taken))
            self.edges[token, side] = found
        return self.edges[token, side]

    def stay_apart(self, a: int, b: int, until: float = float("inf")) -> bool:
        """Whether no merge across comes, below the rank `until`, before the merges that made both sides; of equal ranks the left one goes first."""
        for x, taken_x in self.edge(a, 1):
            for y, taken_y in self.edge(b, 0):
                r = self.rank.get((x, y))
                if r is not None and r < taken_x and r <= taken_y and r < until:
                    return False
        return True

    def follows(self, a: int, b: int) -> bool:
        if len(self.apart) > TRANSITIONS:
            self.apart.clear()
        if (a, b) not in self.apart:
            self.apart[a, b] = self.stay_apart(a, b)
        return self.apart[a, b]

    def is_whole(self, token: int) -> bool:
        """Whether the token's own bytes are encoded as it."""
        if token not in self.whole:
            r, a, b = self.made.get(token, (0, 0, 0))
            self.whole[token] = token not in self.made or (self.is_whole(a) and self.is_whole(b) and self.stay_apart(a, b, r))
        return self.whole[token]


class Counter:
    """The counting transducer, compiled as it is used.

    A state lists the token beginnings that the prefix read so far may be in the
    middle of (nodes of a trie of the tokens), each with the last token before it
    and the tokens up to there less those of the whole prefix; the root is last.
    """

    def __init__(self, path: str):
        self.merges = Merges(path)
        self.child: dict[int, int] = {}
        self.token, self.grows = [-1], [True]
        for text, i in self.merges.id.items():
            node = 0
            for byte in text:
                key = node << 8 | byte
                self.grows[node] = True
                if key not in self.child:
                    self.child[key] = len(self.token)
                    self.token.append(-1)
                    self.grows.append(False)
                node = self.child[key]
            self.token[node] = i
        self.renew()

    def renew(self) -> None:
        self.keys, self.next, self.emits = np.full(SLOTS, -1, np.int64), np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.int8)
        self.states = [((0, -1, 0),)]
        self.number = {self.states[0]: 0}
        self.known = 0

    def compiled(self, key: int) -> tuple[int, int]:
        """Next state and emitted tokens for state << 8 | byte."""
        byte, emit, token, inside = key & 255, None, -1, []
        for node, last, count in self.states[key >> 8]:
            n = self.child.get(node << 8 | byte)
            if n is None:
                continue
            t = self.token[n]
            if emit is None and t >= 0 and self.merges.is_whole(t) and (last < 0 or self.merges.follows(last, t)):
                emit, token = count + 1, t
            if self.grows[n]:
                inside.append((n, last, count))
        state = (*[(n, last, count - emit) for n, last, count in inside], (0, token, 0))
        found = self.number.get(state)
        if found is None:
            found = self.number[state] = len(self.states)
            self.states.append(state)
        return found, emit

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The keys' places in the table, or the free ones where they belong."""
        at = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(43)).astype(np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            there = self.keys[at[todo]]
            todo = todo[(there != keys[todo]) & (there != -1)]
            at[todo] = (at[todo] + 1) & (SLOTS - 1)
        return at

    def step(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = state << 8 | byte
        at = self.slots(keys)
        missing = np.unique(keys[self.keys[at] != keys])
        if len(missing):
            to, emit = np.array([self.compiled(key) for key in missing.tolist()]).T
            new = np.arange(len(missing))
            while len(new):  # of those that want one slot, the first gets it
                s, first = np.unique(self.slots(missing[new]), return_index=True)
                got = new[first]
                self.keys[s], self.next[s], self.emits[s] = missing[got], to[got], emit[got]
                new = np.delete(new, first)
            self.known += len(missing)
            at = self.slots(keys)
        return self.next[at].astype(np.int64), self.emits[at]

    def advance(self, raw: np.ndarray, begin: np.ndarray, size: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States and emitted tokens after stretches of bytes that are entered in these states; all advance together."""
        order = np.argsort(-size, kind="stable")
        begin, size, state, count = begin[order], size[order], state[order].astype(np.int64), np.zeros(len(size), np.int64)
        left = len(size)
        for k in range(int(size[0]) if left else 0):
            left = int(np.searchsorted(-size[:left], -k, side="left"))  # those longer than k
            state[:left], emit = self.step(state[:left], raw[begin[:left] + k])
            count[:left] += emit
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return state[back], count[back]

    def counts(self, raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Tokens of pieces of bytes."""
        if self.known > TRANSITIONS:
            self.renew()
        chunks = np.maximum(-(-size // PART), 1)
        of = np.repeat(np.arange(len(size)), chunks)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        start, later = begin[of] + nth * PART, nth > 0
        length = np.minimum(size[of] - nth * PART, PART)
        entry = np.zeros(len(of), np.int64)
        if later.any():  # guesses: what the bytes just before lead to
            entry[later], _ = self.advance(raw, start[later] - WARM, np.full(int(later.sum()), WARM), np.zeros(int(later.sum()), np.int64))
        left, count = self.advance(raw, start, length, entry)
        while True:  # a chunk's map is known for the state it was entered in; others are read again, first ones first
            wrong = np.flatnonzero(later[1:] & (left[:-1] != entry[1:])) + 1
            if not len(wrong):
                return np.bincount(of, weights=count, minlength=len(size)).astype(np.int64)
            entry[wrong] = left[wrong - 1]
            left[wrong], count[wrong] = self.advance(raw, start[wrong], length[wrong], entry[wrong])


# --- counts of texts -------------------------------------------------------------------------------------------


class TokenCounter:
    """Both transducers and the added tokens of a file."""

    def __init__(self, path: str, kinds: list[tuple[int, int]]):
        self.splitter, self.counter = Splitter(kinds), Counter(path)
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        pre, model = d["pre_tokenizer"] or {}, d["model"]
        plain = d["normalizer"] is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        if not plain or model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges") or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in d["added_tokens"]):
            raise ValueError("not a plain byte-level BPE file")
        self.added = [t["content"] for t in d["added_tokens"]]
        self.split = re.compile("|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None

    def counts(self, texts: list[str]) -> np.ndarray:
        segments, of = texts, np.arange(len(texts))
        extra = np.zeros(len(texts), np.int64)
        if any(t in text for text in texts for t in self.added):  # rare: segments around the added tokens are texts of their own
            parts = [self.split.split(text) for text in texts]
            extra = np.array([len(p) - 1 for p in parts], np.int64)
            segments, of = [s for p in parts for s in p], np.repeat(np.arange(len(texts)), extra + 1)
        whole = "".join(segments)
        if not whole:
            return extra
        chars = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        size = np.array([len(s) for s in segments], np.int64)
        first = np.flatnonzero(self.splitter.beginnings(chars, size))
        width = 1 + (chars >= 0x80).astype(np.int64) + (chars >= 0x800) + (chars >= 0x10000)
        which, kinds = distinct_parts(whole.encode(), (np.cumsum(width) - width)[first])
        raw = np.frombuffer(kinds.buffers()[2], np.uint8)
        at = np.frombuffer(kinds.buffers()[1], np.int64)[kinds.offset : kinds.offset + len(kinds) + 1]
        sizes = np.diff(at)
        tokens = np.concatenate([self.counter.counts(raw, at[s:e], sizes[s:e]) for s, e in runs(sizes.tolist(), PIECES)])
        segment = np.searchsorted(np.cumsum(size), first, side="right")
        return extra + np.bincount(of[segment], weights=tokens[which], minlength=len(texts)).astype(np.int64)


_workers: dict[str, TokenCounter] = {}


def token_counts(docs: DataFrame, path: str, text_col: str = "text", limit: int = 1024) -> DataFrame:
    """Every row without its text, with n_bytes, n_tokens and over_limit."""
    kinds = char_kinds(path)
    added = ["n_bytes", "n_tokens", "over_limit"]
    keep = [c for c in docs.columns if c not in (text_col, *added)]
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    kind = d.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path not in _workers:
            _workers[path] = TokenCounter(path, kinds)
        for b in batches:
            size = pc.binary_length(b.column("text")).cast(pa.int64())
            for s, e in runs(size.to_pylist(), RUN):
                n = _workers[path].counts(b.column("text")[s:e].to_pylist())
                yield pa.RecordBatch.from_arrays([b.column("row")[s:e], size[s:e], pa.array(n), pa.array(n > limit)], names=["row", *added])
        give_back()

    return d.mapInArrow(run, f"row {kind}, n_bytes long, n_tokens long, over_limit boolean").select("row.*", *added)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
