"""SentencePiece encoding and decoding by a batched Viterbi search in numpy.

Words of equal length advance together; the hash of every substring is looked up among the sorted hashes
of all pieces, and each position keeps the largest sum of scores of a way to reach it and a backpointer to that way.

The model files at hand are of the merging kind (BPE), whose ids are not those of the largest sum of
scores over all ways. Every beginning of a merged text is itself merged, so ways are ruled out by pairs: a piece
may follow another only if merging their joint text gives just these two. Other steps count as minus infinity in
the maxima, and what is left is the library's way.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections import defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.llm.common import lean
from reelspark.llm.encode import WordTable
from reelspark.llm.shingles import mix

SPACE = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Substrings looked up at a time.
CELLS = 1 << 20


#: Stands between words when many texts are cut at once; texts that hold it are cut one by one.
LINE = "\0"
#: Substrings whose hash marks no bit here are no pieces.
MARKS = 1 << 21


class Codec(WordTable):
    """Reads pieces, scores and byte pieces from a BPE model file that keeps white space as it is (identity normalizer); refuses others."""

    def __init__(self, path: str, cache_words: int = 500_000):
        import sentencepiece

        super().__init__(cache_words)
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        text = [sp.id_to_piece(i) for i in ids]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in ids]
        plain = [i for i in ids if not special[i]]
        self.byte_ids = {int(text[i][3:5], 16): i for i in ids if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.score = {text[i]: sp.get_score(i) for i in plain}
        self.id_of = {text[i]: i for i in plain}
        # Numbers in the order of creation: characters, then merged pieces by falling score. Pieces that merging never makes are left out.
        self.parts: list[tuple[int, int]] = []
        id_of: list[int] = []
        number: dict[str, int] = {}
        for i in sorted(plain, key=lambda i: (len(text[i]) > 1, -self.score[text[i]], len(text[i]), i)):
            made = self.merge(text[i])
            if len(made) == 1:
                number[text[i]] = len(id_of)
                id_of.append(i)
                self.parts.append(tuple(number[p] for p in made[0][1]) if len(text[i]) > 1 else (number[text[i]],) * 2)
        # Pieces of equal scores, such as runs of spaces, are merged by place alone: they have one rank.
        self.rank = np.unique([-self.score[t] if len(t) > 1 else -np.inf for t in number], return_inverse=True)[1].tolist()
        self.number, self.piece_ids = number, np.array(id_of, dtype=np.uint32)
        self.piece_scores = np.array([self.score[t] for t in number])
        self.text_of = list(number)
        self.longest = max(map(len, number))
        keys = np.array([self._key(t) for t in number], dtype=np.uint64)
        order = np.argsort(keys)
        self.keys, self.of_key = keys[order], order
        if len(np.unique(self.keys)) != len(keys):
            raise ValueError("two pieces have one hash")
        self.bytes = [b"" if special[i] else text[i].encode() for i in ids]
        for b, i in self.byte_ids.items():
            self.bytes[i] = bytes([b])
        self.marks = np.zeros(MARKS, dtype=bool)
        self.marks[(self.keys & np.uint64(MARKS - 1)).astype(np.int64)] = True
        #: Pairs of pieces that were asked for, in order, and whether the second may follow the first.
        self.pairs, self.fits = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
        self.words = regex.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        names = [t.replace(SPACE, " ") for t in self.text_of]
        probes = ["".join(names[i : i + 3]) for i in range(0, len(names), max(1, len(names) // 300))] + ["  a  b ", "\uff21 \t\u00e9"]
        if any(ids.tolist() != sp.encode(t) for ids, t in zip(self.encode(probes), probes, strict=True)):
            raise ValueError("not a BPE model that keeps white space and characters as they are")

    @staticmethod
    def _key(s: str) -> np.uint64:
        h = 0
        for c in s:
            h = (h * int(_BASE) + ord(c) + 1) % (1 << 64)
        return mix(np.array([h], dtype=np.uint64) + np.uint64(len(s)))[0]

    def merge(self, word: str) -> list[tuple[str, tuple[str, str]]]:
        """Pieces of one word by merging the best neighbours, leftmost first, each with the two that it was made of."""
        piece, parts = list(word), [("", "")] * len(word)
        after, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
        heap: list[tuple[float, int, str, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if i >= 0 and j < len(piece) and (s := self.score.get(piece[i] + piece[j])) is not None:
                heapq.heappush(heap, (-s, i, piece[i], piece[j]))

        for i in range(len(word) - 1):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            if piece[i] != a or (j := after[i]) >= len(piece) or piece[j] != b:
                continue
            piece[i], parts[i], piece[j], after[i] = a + b, (a, b), "", after[j]
            if after[j] < len(piece):
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [(p, q) for p, q in zip(piece, parts, strict=True) if p]

    def may_follow(self, a: int, b: int) -> bool:
        """Whether merging the joint text of pieces a and b gives these two: no merge across them comes before those that made them."""
        ca, cb = [a], [b]
        # the pieces that stand at the seam, from the whole ones down to characters
        while self.parts[ca[-1]][1] != ca[-1]:
            ca.append(self.parts[ca[-1]][1])
        while self.parts[cb[-1]][0] != cb[-1]:
            cb.append(self.parts[cb[-1]][0])
        i, j = len(ca) - 1, len(cb) - 1
        while True:
            across = self.number.get(self.text_of[ca[i]] + self.text_of[cb[j]])
            across = None if across is None else self.rank[across]
            next_a, next_b = self.rank[ca[i - 1]] if i else None, self.rank[cb[j - 1]] if j else None
            # a merge across the seam wins a tie against one on its right, as it stands further left
            if across is not None and (next_a is None or across < next_a) and (next_b is None or across <= next_b):
                return False
            if next_a is None and next_b is None:
                return True
            if next_b is None or (next_a is not None and next_a <= next_b):
                i -= 1
            else:
                j -= 1

    def _fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        pair, back = np.unique(a * np.int64(len(self.piece_ids)) + b, return_inverse=True)
        at = np.searchsorted(self.pairs, pair)
        new = pair[self.pairs[np.minimum(at, len(self.pairs) - 1)] != pair] if len(self.pairs) else pair
        if len(new):
            fits = np.array([self.may_follow(*divmod(p, len(self.piece_ids))) for p in new.tolist()])
            order = np.argsort(np.concatenate((self.pairs, new)), kind="stable")
            self.pairs, self.fits = np.concatenate((self.pairs, new))[order], np.concatenate((self.fits, fits))[order]
            at = np.searchsorted(self.pairs, pair)
        return self.fits[at][back]

    def _numbers(self, code: np.ndarray, begin: int, end: int, most: int) -> np.ndarray:
        """[word, character from `begin` to `end`, size - 1]: the number of the piece of that size that ends with the character, or -1."""
        low = max(0, begin - most + 1)
        out = np.full((len(code), end - low, most), -1, dtype=np.int32)
        part, h = code[:, low:end], np.zeros((len(code), end - low), dtype=np.uint64)
        for size in range(1, min(most, end - low) + 1):
            # of the substrings of this size by their first character
            h = h[:, : end - low - size + 1] * _BASE + part[:, size - 1 :]
            key = mix(h + np.uint64(size))
            row, col = np.nonzero(self.marks[(key & np.uint64(MARKS - 1)).astype(np.int64)])
            key = key[row, col]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out[row, col + size - 1, size - 1] = np.where(self.keys[at] == key, self.of_key[at], -1)
        return out[:, begin - low :]

    def viterbi(self, words: list[str]) -> None:
        """Learn words of one length. Pieces are looked up for some characters at a time, so that one very long word needs no more memory than its backpointers."""
        m, n = len(words), len(words[0])
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(m, n).astype(np.uint64) + np.uint64(1)
        most, row = min(n, self.longest), np.arange(m)
        step = max(1, CELLS // (m * most))
        # -2: nothing before, -1: a character that is no piece; neither ever merges with what follows
        last = np.full((m, n + 1), -2, dtype=np.int32)
        back = np.ones((m, n + 1), dtype=np.int8 if most < 128 else np.int32)
        best = np.zeros((m, n + 1))
        for end in range(1, n + 1):
            if (end - 1) % step == 0:
                piece, first = self._numbers(code, end - 1, min(n, end - 1 + step), most), end - 1
            few = min(end, most)
            now = piece[:, end - 1 - first, :few]
            i, size = np.nonzero(now >= 0)
            of, prior = now[i, size].astype(np.int64), last[i, end - 1 - size].astype(np.int64)
            ask = prior >= 0
            ok = np.ones(len(i), dtype=bool)
            ok[ask] = self._fit(prior[ask], of[ask])
            value = np.full((m, few), -np.inf)
            value[i[ok], size[ok]] = best[i[ok], end - 1 - size[ok]] + self.piece_scores[of[ok]]
            size = value.argmax(axis=1)
            top = value[row, size]
            some = top > -np.inf
            best[:, end] = np.where(some, top, best[:, end - 1])
            back[:, end] = np.where(some, size + 1, 1)
            last[:, end] = np.where(some, now[row, size], -1)
        ends, steps = np.full(m, n), []
        while (ends > 0).any():
            steps.append(np.where(ends > 0, last[row, ends], -2))
            ends = np.maximum(0, ends - back[row, ends])
        path = np.stack(steps[::-1], axis=1)
        plain = (path != -1).all(axis=1)
        made = path[plain]
        self.add([words[i] for i in np.flatnonzero(plain).tolist()], self.piece_ids[made[made >= 0]], np.cumsum((made >= 0).sum(axis=1)))
        for i in np.flatnonzero(~plain).tolist():
            ids, end = [], n
            while end:
                p = int(last[i, end])
                ids.append([int(self.piece_ids[p])] if p >= 0 else [self.byte_ids.get(b, self.unknown) for b in words[i][end - 1].encode("utf-8", "replace")])
                end -= int(back[i, end])
            flat = np.fromiter(chain.from_iterable(reversed(ids)), dtype=np.uint32)
            self.add([words[i]], flat, np.array([len(flat)]))

    def learn(self, words: list[str]) -> None:
        by_length: dict[int, list[str]] = defaultdict(list)
        for w in words:
            if w:
                by_length[len(w)].append(w)
            else:
                self.add([w], np.zeros(0, dtype=np.uint32), np.zeros(1, dtype=np.int64))
        if len(self.pairs) > 4 * self.most:
            self.pairs, self.fits = self.pairs[:0], self.fits[:0]
        for n, some in by_length.items():
            step = max(1, CELLS // (n * min(n, self.longest)))
            for at in range(0, len(some), step):
                self.viterbi(some[at : at + step])

    def cut(self, texts: list[str]) -> pa.ListArray:
        """The words of texts; a text begins with a space of its own unless it is empty."""
        marked = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        plain = [SPACE * 2 not in t and t[-1:] != SPACE and LINE not in t for t in marked]
        words = pc.split_pattern(pa.array([t.replace(SPACE, LINE + SPACE)[1:] if ok else "" for t, ok in zip(marked, plain, strict=True)], pa.string()), LINE)
        if all(plain):
            return words
        return pa.array([w if ok else self.words(t) for w, t, ok in zip(words.to_pylist(), marked, plain, strict=True)], pa.list_(pa.string()))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; a text begins with a space of its own unless it is empty."""
        return self.looked_up(self.cut(texts))

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; control ids and unknown ones give nothing."""
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace").replace(SPACE, " ")[1:]


_kept: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _kept:
        _kept[path] = Codec(path)
    return _kept[path]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) per row; null texts are empty and have no ids. One pass, no shuffle."""

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for at in range(0, len(texts), 256):
                yield pa.RecordBatch.from_arrays([ids.slice(at, 256), pa.array(codec(path).encode(texts[at : at + 256]), pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), "doc_id long, ids array<int>")


def decode_documents(coded: DataFrame, path: str) -> DataFrame:
    """doc_id and text per row of (doc_id, ids); null ids count as none."""

    def run(batches):
        for batch in batches:
            texts = [codec(path).decode(np.array(x or [], dtype=np.int32)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(lean(run), "doc_id long, text string")


def round_trips(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_ids, ids_crc32 (little-endian unsigned 32-bit), decoded_sha256 and same per row, encoded and decoded again in one pass.

    same tells whether decoding gives back the text (null: empty) exactly; a text that holds the space
    mark itself gives a space for it. Rows that repeat, null ids and other columns change nothing.
    """

    def run(batches):
        for batch in batches:
            c = codec(path)
            keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for at in range(0, len(texts), 1024):
                part = texts[at : at + 1024]
                ids = c.encode(part)
                back = [c.decode(x) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys[at : at + 1024], pa.int64()),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back]),
                        pa.array([a == b for a, b in zip(part, back, strict=True)]),
                    ],
                    names=["doc_id", "n_ids", "ids_crc32", "decoded_sha256", "same"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, same boolean")
