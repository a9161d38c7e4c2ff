"""Token ids by a public tokenizer file, with a cache of the words that texts share.

Both tokenizers cut a text into pieces before they merge bytes, and never merge across pieces. So the words
(byte level: the pieces) of many texts are told apart at once, each distinct one is encoded once by the
tokenizers library, and ids are gathered by numpy. Texts that hold a special token's string, or characters
for which Python's rules and the library's may differ, go whole through the library. The ids are the library's.
"""

from __future__ import annotations

import os
import re
import unicodedata
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: The piece pattern of byte-level tokenizers as the library states it (a fixed value).
BYTE_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Any character but Latin letters, signs and the usual quotes; such texts go to the library. NEL and the file separators are left out as well.
OTHER = re.compile("[^\t\n\r\x20-\x7e\xa0-\xac\xae-ɏ‐-‧‰-⁞₠-₿]")
#: Stands between pieces that are encoded together; no text that is cut into pieces holds this character.
BETWEEN = "\0"
#: Kinds of characters of which pieces are made; ODD: those of OTHER.
WHITE, SPACE, LETTER, NUMBER, SIGN, ODD = range(6)
#: Characters of texts that are cut into words together.
GROUP_CHARS = 4 << 20


def kinds() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kinds of characters of one, two and three bytes in UTF-8, by the lower 7, 11 and 16 bits of their code points."""

    def kind(c: str) -> int:
        if OTHER.match(c) or "\ud800" <= c <= "\udfff":
            return ODD
        return SPACE if c == " " else next(k for k, p in ((WHITE, r"\s"), (LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SIGN, "")) if regex.match(p, c))

    one, two, three = np.full(256, ODD, np.uint8), np.full(1 << 11, ODD, np.uint8), np.full(1 << 16, ODD, np.uint8)
    for table, codes in ((one, range(128)), (two, range(128, 1 << 11)), (three, range(0x2000, 0x2100))):
        table[codes] = [kind(chr(c)) for c in codes]
    return one, two, three


ONE, TWO, THREE = kinds()


def kinds_of(x: np.ndarray) -> np.ndarray:
    """For each byte of UTF-8 the kind of its character."""
    out = ONE[x]
    if (x & 0x80).any():
        at = np.flatnonzero((x >= 0xC2) & (x < 0xE0))
        out[at] = out[at + 1] = TWO[(x[at].astype(np.int64) & 0x1F) << 6 | x[at + 1] & 0x3F]
        at = np.flatnonzero((x & 0xF0) == 0xE0)
        out[at] = out[at + 1] = out[at + 2] = THREE[(x[at].astype(np.int64) & 0xF) << 12 | (x[at + 1].astype(np.int64) & 0x3F) << 6 | x[at + 2] & 0x3F]
    return out


def piece_starts(x: np.ndarray, kind: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pieces of BYTE_PIECES begin in texts that stand side by side and hold no odd characters."""
    first = np.zeros(len(x) + 3, dtype=bool)
    first[offsets] = True
    white = kind <= SPACE
    # a space goes with what follows it, and white space before something else is a piece without its last character
    start = np.zeros(len(x) + 3, dtype=bool)
    start[1 : len(x)] = (kind[1:] != kind[:-1]) & (kind[:-1] != SPACE) & ~(white[1:] & white[:-1])
    last = np.flatnonzero(white[:-1] & ~white[1:] & ~first[1 : len(x)])
    start[last - (x[last] == 0xA0)] = True
    start |= first
    at = np.flatnonzero((x == ord("'")) & start[: len(x)])
    if len(at):
        after = np.concatenate((x, np.zeros(2, np.uint8)))
        a, b = after[at + 1], after[at + 2]
        two = np.isin(a, np.frombuffer(b"stmd", np.uint8)) & ~first[at + 1]
        three = ((b == ord("e")) & ((a == ord("r")) | (a == ord("v"))) | (a == ord("l")) & (b == ord("l"))) & ~first[at + 1] & ~first[at + 2]
        start[at[two | three] + 1] = False
        start[at[two] + 2] = start[at[three] + 3] = True
    return np.flatnonzero(start[: len(x)])


def byte_names() -> dict[int, int]:
    """The character that stands for each byte in names of byte-level pieces: printable ones for themselves, others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + k for k, b in enumerate(others)}


class WordTable:
    """Ids of words, one after the other in one array."""

    def __init__(self, most: int):
        self.most = most
        #: Place of each known word among the three arrays: where its ids start, how many they are, how often texts had it.
        self.known: dict[str, int] = {}
        self.start, self.size, self.seen = (np.zeros(1024, dtype=np.int64) for _ in range(3))
        self.ids, self.used = np.zeros(4096, dtype=np.uint32), 0

    def learn(self, words: list[str]) -> None:
        raise NotImplementedError

    def add(self, words: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        """Remember words, each with its part of `ids` up to its end."""
        n, at = len(self.known), self.used
        while len(self.start) < n + len(words):
            self.start, self.size, self.seen = (np.concatenate((x, np.zeros_like(x))) for x in (self.start, self.size, self.seen))
        while len(self.ids) < at + len(ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.known.update(zip(words, range(n, n + len(words)), strict=True))
        begins = np.concatenate(([0], ends[:-1])).astype(np.int64)
        self.start[n : n + len(words)], self.size[n : n + len(words)], self.seen[n : n + len(words)] = at + begins, ends - begins, 0
        self.ids[at : at + len(ids)] = ids
        self.used += len(ids)

    def forget(self) -> None:
        """Keep only words that texts have had more than once."""
        keep = np.flatnonzero(self.seen[: len(self.known)] > 1)
        words = np.array(list(self.known), dtype=object)[keep].tolist()
        if 2 * len(words) > self.most:
            words, keep = [], keep[:0]
        ids, ends = self.gather(keep)
        self.known, self.used = {}, 0
        self.add(words, ids, ends)

    def gather(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words at `places` one after the other, and where each ends."""
        size = self.size[places]
        ends = np.cumsum(size)
        return self.ids[np.repeat(self.start[places] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)], ends

    def flat(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words one after the other, and where each word's end; those that are new are learned first."""
        coded = words.dictionary_encode()
        index, distinct = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) + len(distinct) > self.most:
            self.forget()
        places = np.fromiter(map(self.known.get, distinct, repeat(-1)), dtype=np.int64, count=len(distinct))
        lost = np.flatnonzero(places < 0)
        if len(lost):
            new = [distinct[i] for i in lost.tolist()]
            self.learn(new)
            places[lost] = np.fromiter(map(self.known.__getitem__, new), dtype=np.int64, count=len(new))
        self.seen[places] += np.bincount(index, minlength=len(distinct))
        return self.gather(places[index])

    def looked_up(self, words: pa.ListArray) -> list[np.ndarray]:
        """The ids of each text from its words."""
        ids, ends = self.flat(words.flatten())
        cuts = np.concatenate(([0], ends))[words.offsets.to_numpy() - words.offsets[0].as_py()]
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


class Encoder(WordTable):
    """kind: "byte" (byte-level pieces as they are) or "word" (NFC, lower case, white space dropped)."""

    def __init__(self, path: str, kind: str, cache_words: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        super().__init__(cache_words)
        self.kind = kind
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        vocabulary = self.library.get_vocab()
        #: Bytes of text that each id stands for: one for each character of its byte-level name.
        self.width = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for name, i in vocabulary.items():
            self.width[i] = len(name.removesuffix("</w>") if kind == "word" else name)
        if kind == "byte":
            #: The library on pieces that are cut already and stand between spaces.
            self.merges = Tokenizer.from_file(path)
            self.merges.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
            self.names = byte_names()

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32)

    def split(self, ids: np.ndarray, widths: np.ndarray) -> np.ndarray | None:
        """Where the ids of parts of so many bytes end; None if they don't end between ids."""
        place, ends = np.concatenate(([0], np.cumsum(self.width[ids]))), np.cumsum(widths)
        cut = np.minimum(np.searchsorted(place, ends), len(place) - 1)
        return cut if place[-1] == (ends[-1] if len(ends) else 0) and (place[cut] == ends).all() else None

    def one_by_one(self, words: list[str]) -> None:
        got = [np.array(e.ids, dtype=np.uint32) for e in self.library.encode_batch_fast(words, add_special_tokens=False)]
        self.add(words, np.concatenate(got), np.cumsum([len(x) for x in got]))

    def learn_words(self, words: list[str]) -> None:
        """Kind "word": many new words in one text, told apart again by their bytes."""
        for at in range(0, len(words), 2000):
            part = words[at : at + 2000]
            ids = self.whole(" ".join(part))
            ends = self.split(ids, np.array([len(w.encode()) for w in part]))
            self.add(part, ids, ends) if ends is not None else self.one_by_one(part)

    def learn_pieces(self, pieces: list[str]) -> None:
        """Kind "byte": new pieces, each between spaces in one text of byte names."""
        for at in range(0, len(pieces), 5000):
            part = pieces[at : at + 5000]
            coded = [p.encode() for p in part]
            text = BETWEEN.encode().join(coded).decode("latin-1").translate(self.names).replace(chr(self.names[0]), " ")
            ids = np.array(self.merges.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32)
            ends = self.split(ids, np.array([len(p) for p in coded]))
            self.add(part, ids, ends) if ends is not None else self.one_by_one(part)

    def learn(self, words: list[str]) -> None:
        return self.learn_words(words) if self.kind == "word" else self.learn_pieces(words)

    def cut(self, texts: list[str]) -> pa.ListArray:
        """Kind "word": the words of texts."""
        return pc.utf8_split_whitespace(pa.array([unicodedata.normalize("NFC", t).lower() for t in texts], pa.string()))

    def encode_pieces(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Kind "byte": the ids of texts (no nulls) one after the other, and where each text's end."""
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
        begin, offsets = int(offsets[0]), offsets - offsets[0]
        if not offsets[-1]:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        data = data.slice(begin, int(offsets[-1]))
        x = np.frombuffer(data, np.uint8)
        kind = kinds_of(x)
        odd = np.zeros(len(texts), dtype=bool)
        odd[np.searchsorted(offsets, np.flatnonzero(kind == ODD), "right") - 1] = True
        for s in self.special:
            odd |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        if odd.any():
            plain = iter(np.split(*self.encode_pieces(texts.filter(pa.array(~odd))))[:-1])
            parts = [self.whole(t.as_py()) if o else next(plain) for t, o in zip(texts, odd.tolist(), strict=True)]
            return np.concatenate(parts), np.cumsum([len(p) for p in parts])
        starts = piece_starts(x, kind, offsets)
        ids, ends = self.flat(pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(x)).astype(np.int32)), data))
        return ids, np.concatenate(([0], ends))[np.searchsorted(starts, offsets[1:])]

    def encode_array(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Kind "byte": as `encode_pieces`, of texts of any number; a null is empty."""
        texts = texts.fill_null("")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        out, at = [], 0
        while at < len(texts):
            # so many texts as begin within the group
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + GROUP_CHARS, "right")))
            out.append(self.encode_pieces(texts.slice(at, end - at)))
            at = end
        counts = [np.diff(e, prepend=0) for _, e in out]
        return (np.concatenate([i for i, _ in out]), np.cumsum(np.concatenate(counts))) if out else (np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as unsigned 32-bit integers, without special tokens of its own."""
        if self.kind == "byte":
            return np.split(*self.encode_array(pa.array(texts, pa.string())))[:-1]
        out: list[np.ndarray | None] = [None] * len(texts)
        some, chars = [], 0
        for i, t in enumerate(texts):
            if OTHER.search(t) or any(s in t for s in self.special):
                out[i] = self.whole(t)
            else:
                some.append(i)
                chars += len(t)
            if some and (chars >= GROUP_CHARS or i + 1 == len(texts)):
                for k, ids in zip(some, self.looked_up(self.cut([texts[k] for k in some])), strict=True):
                    out[k] = ids
                some, chars = [], 0
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]


_kept: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, kind: str, cache_words: int = 500_000) -> Encoder:
    """One encoder for each worker process and file; the path must exist on every executor. It remembers so many words at most."""
    if (path, kind) not in _kept:
        _kept[path, kind] = Encoder(path, kind, cache_words)
    return _kept[path, kind]
