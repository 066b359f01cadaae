"""SentencePiece encoding by batched Viterbi, and decoding.

The pieces and their scores come from a SentencePiece model file. A text's
spaces become U+2581, one more is put in front, and the segmentation with the
largest total score is taken; of equal ones, that whose last piece is longest,
then that of the piece before, and so on. Characters that no piece covers are
spelled with the file's byte pieces.

Texts are taken in runs of two megabytes. A run falls into parts wherever no
piece joins two neighbouring characters (so before every word), and each
distinct part of the run is solved once: parts of one length form a matrix and
advance together, hashes of all substrings of one length are looked up in the
sorted piece keys at once, and vectorised maxima keep the length of the last
piece. What a worker holds follows from the size of a run, not from what it
has seen.

This is the unigram rule. A file that was made for merges (BPE) gives other
ids under the library's merge rule; decoding is the same for both.

Defined results: null texts are empty ones and give no ids; U+2581 in a text
decodes as a space; ids outside the file, nulls and control pieces decode to
nothing; an empty table gives an empty one; repeated rows and further columns
stay as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import checksums, distinct_parts, give_back, joined, lists, runs, spread
from .common import table

SPACE = "▁"
#: The odd base of the rolling hash, modulo 2**64.
BASE = 0x9E3779B97F4A7C15
#: Characters of parts that are solved together.
SOLVE_CHARS = 1 << 18
#: Parts up to EVEN characters form matrices of one length; longer ones up to LONG share matrices a little longer than they are.
EVEN, LONG, STRETCH = 40, 2048, 1.2
#: Bytes of texts that are encoded together, and ids that are decoded together: a worker holds about 30 bytes for each.
ENCODE_RUN = 1 << 21
_workers: dict = {}


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def widths(cp: np.ndarray) -> np.ndarray:
    """Bytes of characters in UTF-8."""
    return 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)


class Viterbi:
    """A model file's pieces, with spaces for U+2581."""

    def __init__(self, model_path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = sp.get_piece_size()
        self.unk_id = sp.unk_id()
        usable = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.pieces = {i: sp.id_to_piece(i).replace(SPACE, " ") for i in usable}
        self.byte_ids = np.full(256, self.unk_id, np.int32)
        raw = [b""] * n
        for i, piece in self.pieces.items():
            raw[i] = piece.encode()
        for i in range(n):
            if sp.is_byte(i):
                b = int(sp.id_to_piece(i)[1:-1], 16)
                self.byte_ids[b], raw[i] = i, bytes([b])
        # bytes of pieces end to end; a last one without bytes stands for ids that are not in the file
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_size = np.array([*map(len, raw), 0], np.int64)
        self.raw_begin = np.cumsum(self.raw_size) - self.raw_size
        if any(" " in piece.lstrip(" ") for piece in self.pieces.values()):
            raise ValueError("a piece has U+2581 after another character; words would not be independent")
        self.longest = max(map(len, self.pieces.values()))
        keys = np.array([self._hash(self.pieces[i]) for i in usable], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(usable, np.int32)[order]
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two pieces share a key")
        self.scores = np.array([sp.get_score(i) for i in usable], np.float64)[order]
        self.unk_score = float(self.scores.min()) - 10.0
        self.maybe = np.zeros(1 << 20, bool)  # whether some key has these leading bits; most substrings end here
        self.maybe[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        # characters next to each other in some piece: their numbers, and a table of pairs
        joined = {a + b for piece in self.pieces.values() for a, b in zip(piece, piece[1:], strict=False)}
        self.number = np.zeros(0x110000, np.uint16)
        chars = sorted(set("".join(joined)))
        self.number[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.kinds = len(chars) + 1
        self.pair = np.zeros(self.kinds * self.kinds, bool)
        for a, b in joined:
            self.pair[int(self.number[ord(a)]) * self.kinds + int(self.number[ord(b)])] = True

    @staticmethod
    def _hash(s: str) -> int:
        h = 0
        for c in s:
            h = (h * BASE + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def look(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the keys that are pieces, and the pieces' places in the sorted keys."""
        at = np.flatnonzero(self.maybe[(keys >> np.uint64(44)).astype(np.int64)])
        key = keys[at]
        found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[found] == key
        return at[hit], found[hit]

    def best_lengths(self, cp: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For parts (characters cp[begin : begin + size], about one size) the ends of their pieces in cp and the pieces' lengths, part by part.

        Lanes of characters in step: row e of `score` holds, for pieces that end
        after e characters, the longest first, their scores in every part.
        """
        n, most, deep = len(begin), int(size.max()), min(self.longest, int(size.max()))
        chars = np.zeros((most, n), np.uint64)
        inside = np.arange(most)[:, None]
        real = inside < size
        chars[real] = cp[(begin + inside)[real]].astype(np.uint64) + np.uint64(1)
        prefix = np.zeros((most + 1, n), np.uint64)
        for e in range(most):
            np.multiply(prefix[e], np.uint64(BASE), out=prefix[e + 1])
            prefix[e + 1] += chars[e]
        score = np.full((most, deep, n), -np.inf)
        score[:, deep - 1] = self.unk_score
        for k in range(1, deep + 1):
            key = prefix[k:] - prefix[: most + 1 - k] * np.uint64(pow(BASE, k, 1 << 64))
            at, found = self.look(key.ravel())
            score[k - 1 :, deep - k].reshape(-1, n)[at // n, at % n] = self.scores[found]
        best = np.full((most + deep, n), -np.inf)
        best[deep - 1] = 0.0
        back = np.empty((most, n), np.int16)
        lanes = np.arange(n)
        for e in range(most):
            total = best[e : e + deep] + score[e]
            top = total.argmax(axis=0)
            best[e + deep] = total[top, lanes]
            back[e] = deep - top
        # all parts walk back at once, a piece a step
        part, end, parts, ends, lens = lanes, size.copy(), [], [], []
        while len(part):
            k = back[end - 1, part].astype(np.int64)
            parts.append(part)
            ends.append(end)
            lens.append(k)
            end = end - k
            part, end = part[end > 0], end[end > 0]
        part, end, k = np.concatenate(parts), np.concatenate(ends), np.concatenate(lens)
        order = np.lexsort((end, part))
        return (begin[part] + end)[order], k[order]

    def long_lengths(self, cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for one long part, whose substrings are looked up at once and whose maxima are taken one by one."""
        n = len(cp)
        inverse, base = np.uint64(pow(BASE, -1, 1 << 64)), np.uint64(BASE)
        power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, base))))
        falling = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, inverse))))
        prefix = np.concatenate(([np.uint64(0)], np.cumsum((cp.astype(np.uint64) + np.uint64(1)) * falling[1:]) * power[1:]))
        ends, lens, worth = [np.arange(1, n + 1)], [np.ones(n, np.int64)], [np.full(n, self.unk_score)]
        for k in range(1, min(self.longest, n) + 1):
            at, found = self.look(prefix[k:] - prefix[: n + 1 - k] * power[k])
            ends.append(at + k)
            lens.append(np.full(len(at), k))
            worth.append(self.scores[found])
        end, size, score = np.concatenate(ends), np.concatenate(lens), np.concatenate(worth)
        order = np.lexsort((-size, end))
        best, back = [0.0] + [-np.inf] * n, [0] * (n + 1)
        for e, k, s in zip(end[order].tolist(), size[order].tolist(), score[order].tolist(), strict=True):
            if best[e - k] + s > best[e]:
                best[e], back[e] = best[e - k] + s, k
        out = []
        while n:
            out.append((n, back[n]))
            n -= back[n]
        found = np.array(out[::-1], np.int64)
        return found[:, 0], found[:, 1]

    def solve(self, text: str, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts that stand end to end in the text, and how many each has."""
        cp = points(text)
        begin = np.cumsum(size) - size
        order = np.argsort(size, kind="stable")
        wide = size[order].astype(np.float64)
        wide = np.where(wide > EVEN, np.ceil(np.log(np.maximum(wide, 1) / EVEN) / np.log(STRETCH)) + EVEN, wide)
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(wide)) + 1, [len(order)]))
        ends, lens, whose = [], [], []
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            step = max(1, SOLVE_CHARS // int(size[order[e - 1]]))
            for at in range(s, e, step):
                part = order[at : min(e, at + step)]
                if size[part[-1]] <= LONG:
                    end, k = self.best_lengths(cp, begin[part], size[part])
                    ends.append(end)
                    lens.append(k)
                else:
                    for p in part.tolist():
                        end, k = self.long_lengths(cp[begin[p] : begin[p] + size[p]])
                        ends.append(begin[p] + end)
                        lens.append(k)
        end, k = np.concatenate(ends), np.concatenate(lens)
        back = np.argsort(end, kind="stable")  # in the order of the text again
        end, k = end[back], k[back]
        # the pieces' keys once more, now only those of the best segmentation
        key = np.zeros(len(end), np.uint64)
        for i in range(int(k.max())):
            on = np.flatnonzero(k > i)
            key[on] = key[on] * np.uint64(BASE) + cp[end[on] - k[on] + i].astype(np.uint64) + np.uint64(1)
        found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        ids = np.where(self.keys[found] == key, self.ids[found], -1)
        whose = np.searchsorted(begin + size, end)
        bare = np.flatnonzero(ids < 0)
        if len(bare):  # characters that no piece has become the pieces of their bytes
            n = np.ones(len(ids), np.int64)
            n[bare] = widths(cp[end[bare] - 1])
            at = np.cumsum(n) - n
            spelled = np.frombuffer("".join(map(chr, cp[end[bare] - 1].tolist())).encode("utf-8", "surrogatepass"), np.uint8)
            ids, whose = np.repeat(ids, n), np.repeat(whose, n)
            ids[spread(at[bare], n[bare])] = self.byte_ids[spelled]
        return ids.astype(np.int32), np.bincount(whose, minlength=len(size))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts end to end, and how many each has."""
        body = "".join([" " + t if t else "" for t in texts]).replace(SPACE, " ")
        size = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        if not body:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        cp, raw = points(body), body.encode("utf-8", "surrogatepass")
        kind = self.number[cp]
        cut = np.ones(len(cp), bool)
        cut[1:] = ~self.pair[kind[:-1].astype(np.int32) * self.kinds + kind[1:]]
        start = (np.cumsum(size) - size)[size > 0]
        cut[start] = True
        first = np.flatnonzero(cut)
        place = first if len(raw) == len(cp) else (np.cumsum(widths(cp)) - widths(cp))[first]
        which, kinds = distinct_parts(raw, place)
        ids, count = self.solve(joined(kinds), pc.utf8_length(kinds).to_numpy().astype(np.int64))
        begin = np.cumsum(count) - count
        n = count[which]
        out = np.zeros(len(texts), np.int64)
        out[size > 0] = np.add.reduceat(n, np.searchsorted(first, start))
        return ids[spread(begin[which], n)], out

    def decode(self, ids: np.ndarray, count: np.ndarray) -> list[str]:
        """Texts of ids that stand end to end."""
        known = np.where((ids >= 0) & (ids < len(self.raw_size) - 1), ids, len(self.raw_size) - 1)
        size = self.raw_size[known]
        raw = self.raw[spread(self.raw_begin[known], size)].tobytes()
        end = np.concatenate(([0], np.cumsum(size)))[np.cumsum(count)].tolist()
        return [raw[s:e].removeprefix(b" ").decode("utf-8", "replace") for s, e in zip([0, *end[:-1]], end, strict=True)]


def model(path: str) -> Viterbi:
    if path not in _workers:
        _workers[path] = Viterbi(path)
    return _workers[path]


def encoded_runs(v: Viterbi, texts: pa.Array) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """Texts (null: empty), their ids end to end and how many each has, a run at a time."""
    for s, e in runs(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), ENCODE_RUN):
        part = [t or "" for t in texts[s:e].to_pylist()]
        yield (part, *v.encode(part))
    give_back()


def encode_column(text: Column, model_path: str) -> Column:
    """Text to array<int> of piece ids."""

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        found = [(ids, n) for _, ids, n in encoded_runs(model(model_path), texts)]
        return lists(np.concatenate([f[0] for f in found] or [np.zeros(0, np.int32)]), np.concatenate([f[1] for f in found] or [np.zeros(0, int)]))

    return encode(text)


def decode_column(ids: Column, model_path: str) -> Column:
    """array<int> of piece ids to text; a null array is an empty text."""

    @F.arrow_udf("string")
    def decode(rows: pa.Array) -> pa.Array:
        count = pc.fill_null(pc.list_value_length(rows), 0).to_numpy().astype(np.int64)
        flat, out = pc.fill_null(rows.flatten(), -1).to_numpy(), []
        at = np.concatenate(([0], np.cumsum(count)))
        for s, e in runs(count.tolist(), ENCODE_RUN):
            out += model(model_path).decode(flat[at[s] : at[e]], count[s:e])
        return pa.array(out, pa.string())

    return decode(ids)


CHECKED = {"n_pieces": pa.int64(), "ids_crc32": pa.int64(), "decoded_sha256": pa.string(), "exact": pa.bool_()}


def encode_and_check(text: Column, model_path: str, with_ids: bool = True) -> Column:
    """A struct of the ids (if wanted), their number and CRC-32, the SHA-256 of what they decode to, and whether that is the text: one pass, so that nothing is encoded twice."""

    @F.arrow_udf(("ids array<int>, " if with_ids else "") + "n_pieces long, ids_crc32 long, decoded_sha256 string, exact boolean")
    def check(texts: pa.Array) -> pa.Array:
        v = model(model_path)
        columns: tuple[list, ...] = ([], [], [], [])
        found: list[np.ndarray] = [np.zeros(0, np.int32)]
        for part, ids, count in encoded_runs(v, texts):
            again = v.decode(ids, count)
            for c, x in zip(columns, (count.tolist(), checksums(ids, count), [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in again], [a == b for a, b in zip(part, again, strict=True)]), strict=True):
                c.extend(x)
            if with_ids:
                found.append(ids)
        arrays = [pa.array(c, k) for c, k in zip(columns, CHECKED.values(), strict=True)]
        if not with_ids:
            return pa.StructArray.from_arrays(arrays, list(CHECKED))
        return pa.StructArray.from_arrays([lists(np.concatenate(found), np.array(columns[0], np.int64)), *arrays], ["ids", *CHECKED])

    return check(text)


def encode_documents(docs: DataFrame, model_path: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    return docs.withColumn(out, encode_column(F.col(text_col), model_path))


def decode_documents(docs: DataFrame, model_path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    return docs.withColumn(out, decode_column(F.col(ids_col), model_path))


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encoded_and_back(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, decoded_sha256, and whether decoding gives the text again."""
    return docs.select("doc_id", encode_and_check(F.col("text"), model_path, with_ids=False).alias("_c")).select("doc_id", *[f"_c.{c}" for c in CHECKED])


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document encoded and decoded."""
    return encoded_and_back(table(spark, sf_dir, "documents"), default_model())
