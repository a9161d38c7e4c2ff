"""Tokens: encoding, files, packing and the SentencePiece codec."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from reelspark.llm import encode, packing, sentencepiece_codec, token_files

TEXTS = [None, "", "Hello, World!  It's 2024.\n\n", "<|endoftext|> a <|startoftext|>", "ÉCOLE naïve Straße ΑΣ ΣΑΣ.", "漢字 😀 ́é", "x" * 3000, "a\tb\r\n  c   ", "word " * 9000, "it'S we'LL 'tis"]
BYTE, WORD, SP = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, 1, 2, "z") for i, t in zip(ids or range(len(texts)), texts, strict=True)], "doc_id long, text string, part int, row int, ids string")


@pytest.mark.parametrize("kind,path", [("byte", BYTE), ("word", WORD)])
def test_encoder_is_the_library(kind, path):
    lib, enc = Tokenizer.from_file(path), encode.Encoder(path, kind, cache_words=50)
    latin = ["".join(map(chr, range(a, a + 16))) for a in range(32, 0x250, 16)] + [f"a{chr(c)}b {chr(c)}" for c in range(9, 0x250)]
    r = random.Random(1)
    mixed = ["".join(r.choice("abcXYZ 0123'\n\t.,!éÜßñçÅ’“€—́ΣЖ") for _ in range(40)) for _ in range(500)]
    for t in [x or "" for x in TEXTS] + latin + mixed:
        assert enc.encode(t).tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.sampled_from("abÉßªɏ 09²½.,!''<×–€ \t\n\r\xa0 strevldm"), max_size=30), min_size=1, max_size=6))
def test_pieces_are_those_of_the_pattern(texts):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    if len(data):
        starts = encode.piece_starts(data, encode.kinds_of(data), offsets).tolist()
        cut = [data[a:b].tobytes().decode() for a, b in zip(starts, [*starts[1:], len(data)], strict=True)]
        assert cut == [p for t in texts for p in regex.findall(encode.BYTE_PIECES, t)]


def test_each_piece_is_encoded_once():
    """Words that differ in the signs beside them are no new words; null is empty, and odd texts keep their places."""
    enc = encode.Encoder(BYTE, "byte")
    texts = ["one, one. one\n(one)\n\n  one's", None, "漢字 one", "one! one?", "", "<|endoftext|>one"]
    ids, ends = enc.encode_array(pa.array(["-", *texts, "-"]).slice(1, len(texts)))
    assert set(enc.known) == {"one", " one", ",", ".", "\n", "\n\n ", ")", "(", "'s", "!", "?"}
    lib = Tokenizer.from_file(BYTE)
    assert [x.tolist() for x in np.split(ids, ends)[:-1]] == [lib.encode(t or "", add_special_tokens=False).ids for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=50))
def test_code_round_trip(values):
    control, data = token_files.code(np.array(values, dtype=np.uint32))
    assert token_files.decode(control, data, len(values)).tolist() == values
    assert len(control) == -(-len(values) // 4)


def test_pages_refuse_other_bytes():
    with pytest.raises(ValueError):
        token_files.open_page(b"nope" + bytes(16))


def test_token_files(spark):
    lib = Tokenizer.from_file(BYTE)
    ids = [9, 3, 5, 7, 1, 0, 2, 4, 6, 8]
    rows = {r.doc_id: r for r in token_files.token_files(docs(spark, TEXTS, ids), BYTE, "byte", end_id=0, page_tokens=64).collect()}
    start = 0
    for i, t in sorted(zip(ids, TEXTS, strict=True)):
        want = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32, rows[i].ids) == (start, len(want), zlib.crc32(want.tobytes()), want.tobytes())
        start += len(want)
    assert token_files.token_files(docs(spark, []), BYTE).count() == 0
    twice = token_files.token_files(docs(spark, ["a", "a", "b"], [1, 1, None]), BYTE).collect()
    assert sorted((x.doc_id or 0, x.start) for x in twice) == [(0, 0), (1, 2), (1, 4)]


def tightest(lengths, size):
    rooms, out = [], 0
    for n in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= n]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - n)
        else:
            rooms.append(size - n)
            out += 1
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 37), max_size=80), st.integers(37, 60))
def test_best_fit_is_best_fit(lengths, size):
    bins, offsets = packing.best_fit(np.array(lengths, dtype=np.int64), size)
    assert len(set(bins.tolist())) == tightest(lengths, size)
    for b in set(bins.tolist()):
        at = 0
        for o, n in sorted((offsets[i], lengths[i]) for i in range(len(lengths)) if bins[i] == b):
            assert o == at
            at += n
        assert at <= size


def test_packing(spark):
    lib = Tokenizer.from_file(WORD)
    rows = packing.pack_documents(docs(spark, TEXTS), WORD, "word", end_id=1, size=4096).collect()
    want = {}
    for i, t in enumerate(TEXTS):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want |= {(i, k): (a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for k, a in enumerate(range(0, len(ids), 4096))}
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    assert len({r.sequence_id for r in rows}) == tightest([r.length for r in rows], 4096)
    assert packing.pack_documents(docs(spark, []), WORD).count() == 0
    assert packing.pack_documents(docs(spark, ["a", "a"], [1, 1]), WORD).count() == 2
    assert packing.pack_documents(docs(spark, [None], [None]), WORD).first().doc_id is None


def test_packing_in_groups(spark):
    rows = packing.pack_documents(docs(spark, ["w " * (i % 90) for i in range(400)]), WORD, size=128, group_rows=100).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in by.values():
        x.sort()
        assert [o for o, _ in x] == [sum(n for _, n in x[:i]) for i in range(len(x))] and sum(n for _, n in x) <= 128
    # four groups leave no more over than one
    assert len(rows) == 400 and len(by) <= tightest([r.length for r in rows], 128) + 1


def test_sentencepiece_one_long_word(monkeypatch):
    """A word longer than what is looked up at a time, against the library; ids do not hang on where it is cut."""
    import sentencepiece

    lib, r = sentencepiece.SentencePieceProcessor(model_file=SP), random.Random(3)
    texts = ["".join(r.choice("abcdeinstrhoé漢9") for _ in range(3000)), "a" * 5000]
    whole = [x.tolist() for x in sentencepiece_codec.Codec(SP).encode(texts)]
    monkeypatch.setattr(sentencepiece_codec, "CELLS", 900)
    assert whole == [x.tolist() for x in sentencepiece_codec.Codec(SP).encode(texts)] == [lib.encode(t) for t in texts]


def test_sentencepiece_searches_runs_of_spaces():
    """Pieces of equal scores are merged from the left; words with such runs go through the search like others."""
    import sentencepiece

    lib, r, codec = sentencepiece.SentencePieceProcessor(model_file=SP), random.Random(8), sentencepiece_codec.Codec(SP)
    texts = ["".join(r.choice([" " * r.randint(1, 45), "the", "a", "ing", "x", "é", "漢", "un", " "]) for _ in range(r.randint(1, 8))) for _ in range(1500)]
    texts += [" " * n + x for n in range(60) for x in ("", "a", "the end")] + [" " * 5000]
    assert [x.tolist() for x in codec.encode(texts)] == [lib.encode(t) for t in texts]


def test_sentencepiece_refuses_other_models(monkeypatch):
    import sentencepiece

    class Other(sentencepiece.SentencePieceProcessor):
        """Gives ids that merging does not give."""

        def encode(self, text):
            return list(reversed(super().encode(text)))

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Other)
    with pytest.raises(ValueError):
        sentencepiece_codec.Codec(SP)


def test_sentencepiece_is_the_library(spark):
    import sentencepiece

    lib, codec = sentencepiece.SentencePieceProcessor(model_file=SP), sentencepiece_codec.Codec(SP, cache_words=200)
    r = random.Random(5)
    texts = [t or "" for t in TEXTS] + ["".join(r.choice("abcdethe  inst\n\t.,*$éüß漢😀0123ABT") for _ in range(r.randint(0, 70))) for _ in range(800)] + [" " * n + "x" + " " * n for n in range(20)]
    for t, ids in zip(texts, codec.encode(texts), strict=True):
        assert ids.tolist() == lib.encode(t), repr(t)
        assert codec.decode(ids) == t
    rows = {x.doc_id: x for x in sentencepiece_codec.round_trips(docs(spark, TEXTS), SP).collect()}
    assert all(x.same for x in rows.values()) and rows[0].n_ids == rows[1].n_ids == 0
    coded = sentencepiece_codec.encode_documents(docs(spark, TEXTS), SP)
    assert {x.doc_id: x.text for x in sentencepiece_codec.decode_documents(coded, SP).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert sentencepiece_codec.round_trips(docs(spark, []), SP).count() == 0
    assert not sentencepiece_codec.round_trips(docs(spark, ["a▁b"]), SP).first().same
