"""Tokenizer operators against the libraries, and the coding of token files."""

import base64
import hashlib
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

from panelspark.llm import bpe, memo, piece_count, queries, token_files
from panelspark.llm.common import table

os.environ["TOKENIZERS_PARALLELISM"] = "false"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
PARTS = [
    " ", "  ", "\n", " \n", "\t", "\r\n", "'s", "'ll", "'T", "a", "the", "ing", "é", "ß", "中", "文", "👍🏽", "1", "23", "½", "²", " ", " ", "　",
    "\x1c", "\x85", "​", "▁", "_", "--", "...", "<|endoftext|>", "<s>", "</s>", "\x00", "İ", "ǅ", "가", "é", "ﬁ", "Ⅷ", "᠎", "!!",
]


@pytest.fixture(scope="module")
def texts(spark, sf):
    rnd = random.Random(3)
    made = ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 40))) for _ in range(1500)]
    runs = ["a" * 5000, "ab" * 2000, "=-" * 2000, " " * 3000, "\n" * 2000, "é" * 2000, "1" * 3000, "aaaaaaab" * 200, "thethe" * 400, ""]
    return [r.text for r in table(spark, sf, "documents").select("text").collect()] + made + runs


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_gives_the_library_ids(texts, reference):
    own, tokens = bpe.load(RANKS, public_tokenizers.PATTERN), bpe.load_tokens(RANKS)
    for text in texts:
        want = reference.encode_ordinary(text)
        assert np.frombuffer(own.encode(text), "<i4").tolist() == want, text[:80]
        assert bpe.decode_ids(tokens, want) == text.encode()


def test_bpe_query(spark, sf, reference, odd, empty):
    docs = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    for r in queries.op10_bpe(spark, sf).collect():
        ids = reference.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
    got = {r.doc_id: r.ids for r in bpe.encode(odd, RANKS, public_tokenizers.PATTERN).collect()}
    assert got[1] == got[2] == [] and len(got) == 7
    assert bpe.encode(empty, RANKS, public_tokenizers.PATTERN).count() == 0
    both = bpe.round_trip(odd, RANKS, public_tokenizers.PATTERN).collect()
    apart = {r.doc_id: r.decoded for r in bpe.decode(bpe.encode(odd, RANKS, public_tokenizers.PATTERN), RANKS).collect()}
    assert {r.doc_id: r.ids for r in both} == got and {r.doc_id: r.decoded for r in both} == apart
    checked = bpe.round_trip(odd, RANKS, public_tokenizers.PATTERN, whole=False)
    assert checked.columns == ["doc_id", "ids", "round_trip"] and all(r.round_trip for r in checked.collect())
    assert bpe.round_trip(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_piece_counts_are_the_library_s(texts):
    library, own = sentencepiece.SentencePieceProcessor(model_file=PIECES), piece_count.load(PIECES)
    for text in texts:
        assert own.count(text) == len(library.encode(text)), text[:80]


def test_piece_count_query(spark, sf, odd, empty):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    for r in queries.op8_token_counts(spark, sf).collect():
        n = len(library.encode(docs[r.doc_id]))
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(docs[r.doc_id].encode()), n > 4096)
    got = {r.doc_id: r.n_tokens for r in piece_count.count_tokens(odd, PIECES).collect()}
    assert got[1] == got[2] == 0 and got[6] == len(library.encode("a" * 5000))
    assert piece_count.count_tokens(empty, PIECES).count() == 0


def test_simple8b_round_trip():
    rng = np.random.default_rng(0)
    for _ in range(200):
        parts = [np.array([(1 << 60) - 1, (15 << 60) | ((1 << 60) - 1), 1 << 60, (1 << 64) - 1, 0], np.uint64)][: rng.integers(0, 2)]
        for _ in range(rng.integers(0, 8)):
            width = int(rng.integers(0, 64))
            parts.append(rng.integers(0, 1 << width, int(rng.integers(0, 300)), dtype=np.uint64, endpoint=False))
        values = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        words = token_files.pack(values)
        assert (token_files.unpack(words, len(values)) == values).all()
    assert len(token_files.pack(np.zeros(2400, np.uint64))) == 10
    assert len(token_files.pack(np.full(40, 1000, np.uint64))) == 7  # six to a word of ten bits each


def test_encoder_gives_the_library_ids(texts):
    library, own = Tokenizer.from_file(JSON), token_files.load(JSON)
    for at in range(0, len(texts), 100):
        some = texts[at : at + 100]
        for text, got in zip(some, own.encode(some), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text[:80]


def test_words_forgotten_between_texts(monkeypatch):
    monkeypatch.setattr(token_files, "ENTRIES", 3)
    own, library = token_files.Encoder(JSON), Tokenizer.from_file(JSON)
    some = ["one two three four five", "four one six", "seven"] * 3
    for text, got in zip(some, own.encode(some), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_token_files_query(spark, sf, odd, empty):
    library = Tokenizer.from_file(JSON)
    docs = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    start = 0
    for r in sorted(queries.op6_token_files(spark, sf).collect()):
        ids = np.array([*library.encode(docs[r.doc_id], add_special_tokens=False).ids, queries.END_ID], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    rows = sorted(token_files.round_trip(odd, JSON, 2).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 4, 4, 5, 6]
    assert [bytes(r.ids) for r in rows[1:3]] == [b"\x02\0\0\0"] * 2
    assert token_files.round_trip(empty, JSON, 2).count() == 0


def test_spaced_pieces_make_the_text():
    for text in ["", " ", "a b", " a  b ", "a \n b", "a　 b", "x \t y"]:
        pieces = memo.spaced(text)
        assert " ".join(pieces) == text and all(p and not p[0].isspace() for p in pieces[1:])


def test_words_of_letters_and_marks_give_the_library_ids():
    own, library = token_files.Encoder(JSON), Tokenizer.from_file(JSON)
    words = ["gone.\nThen", "a,b", "x.\n\ny", "don't.", "end...\nÜber!!", "l'été,", "c%%%\nd", "²b.", "中文。", "word.\n", "a.'s", "rock'n'roll.\nOn"]
    some = [" ".join(["first", *words]), " ".join(words), *(f"of {w} {w.upper()} end" for w in words)]
    for text, got in zip(some, own.encode(some), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_bpe_gives_the_library_ids_for_every_code_point(reference):
    own = bpe.load(RANKS, public_tokenizers.PATTERN)
    assert bpe.unlike("a࢏") and not bpe.unlike("é ß 中 ½") and not bpe.unlike("plain")
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x33500 or c % 64 == 0 or 0xE0000 <= c < 0xE0200)]
    for at in range(0, len(codes), 48):
        text = "".join(f"a{chr(c)}'s {chr(c)}1 {chr(c)}\n" for c in codes[at : at + 48])
        assert np.frombuffer(own.encode(text), "<i4").tolist() == reference.encode_ordinary(text), hex(codes[at])


def test_bpe_tables_take_little_memory():
    import tracemalloc

    bpe._unlike.cache_clear(), bpe.library_classes.cache_clear()
    tracemalloc.start()
    assert not bpe.unlike("aé1²Ⅷ一")
    kept, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert kept < 5 << 20 and peak < 16 << 20
    assert bpe.library_classes()["N"][ord("²")] and not bpe.library_classes()["N"][ord("a")]
