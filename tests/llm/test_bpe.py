"""Token counts, encoding and decoding equal the library's on every text."""
import hashlib
import random
import struct
import sys

import pytest
import regex
from tokenizers import Tokenizer

from eventide.llm import bpe_codec, token_count
from eventide.llm.bpe_core import normalised, read_vocabulary
from eventide.llm.queries import vocab_file

from conftest import ODD


@pytest.fixture(scope="module")
def raw():
    return read_vocabulary(vocab_file())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocab_file())


def texts():
    r = random.Random(3)
    out = [t or "" for t in ODD if len(t or "") < 50_000]
    out += ["Hello  wörld's 'Still ''s I'LL 123 ½ X<|ENDOFTEXT|>y İ ΑΣ ÇÇ", "'''s're 'rest 've' ''ll 'D 'T", "ǅ ﬁ ẞ ß",
            "a<|endoftext|><|startoftext|>b", "-----=====***" * 20, "ⅧⅣ ²³ Ⓐ ａ 𝒳 \U0001F600", "Ᲊ Ɤ \U00010D50"]
    out += ["".join(r.choice("abcdefgh'sTLV 12é漢Σσς!.-\n<|>endoftext") for _ in range(300)) for _ in range(150)]
    return out


def test_counts_and_codes_equal_library(raw, library):
    t = token_count.transducer(raw)
    ours = list(bpe_codec.encode_texts(raw, texts()))
    for text, enc, got in zip(texts(), library.encode_batch(texts(), add_special_tokens=False), ours):
        assert t.count(text) == len(enc.ids), text
        assert got[1] == struct.pack(f"<{len(enc.ids)}I", *enc.ids), text
        assert got[3] == library.decode(enc.ids, skip_special_tokens=False), text


def test_every_sign_is_normalised_as_by_the_library(library):
    signs = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    marks = regex.compile(r"\p{M}")
    # every mark beside two others, every other sign before a mark and among plain letters
    probes = [p for x in signs if marks.match(x) for p in (f"a{x}\u0301", f"a\u0323{x}\u0301", f"\u0301{x}\u0316", f"a{x}\u0316{x}")]
    probes += [p for x in signs if not marks.match(x) for p in (f"{x}\u0301\u0323", f"a{x}b")]
    expected = library.normalizer.normalize_str  # also turns blanks into spaces, which our cut does
    assert [p for p in probes if not any(map(str.isspace, p)) and normalised(p) != expected(p)] == []


@pytest.mark.parametrize("size", [1, 7, 50])
def test_chunk_maps_compose_to_the_whole(raw, size):
    t = token_count.transducer(raw)
    for text in texts()[:40]:
        maps = [token_count.chunk_map(t, text[i:i + size]) for i in range(0, max(1, len(text)), size)]
        assert token_count.scan(t, maps) == t.count(text)
        if len(maps) > 2:  # associative
            a, b, c = maps[:3]
            left = token_count.compose(t, token_count.compose(t, a, b), c)
            assert left == token_count.compose(t, a, token_count.compose(t, b, c))


def test_pieces_of_long_texts(raw, monkeypatch):
    whole = list(bpe_codec.encode_texts(raw, texts()))
    monkeypatch.setattr(bpe_codec, "PIECE_CHARS", 40)
    assert list(bpe_codec.encode_texts(raw, texts())) == whole


def test_counting_in_small_chunks_equals_library(spark, sample, library):
    got = {r["doc_id"]: r["n_tokens"] for r in
           token_count.count_tokens(sample, vocab_file(), chunk_chars=97).collect()}
    want = {r["doc_id"]: len(library.encode(r["text"] or "", add_special_tokens=False).ids) for r in sample.collect()}
    assert got == want


def test_odd_tables(odd_docs, no_docs, library):
    out = token_count.count_tokens(odd_docs, vocab_file())
    assert "key" in out.columns and out.count() == odd_docs.count()
    assert token_count.count_tokens(no_docs, vocab_file()).count() == 0
    enc = bpe_codec.encode(odd_docs, vocab_file())
    rows = enc.collect()
    assert len(rows) == odd_docs.count()
    assert all(len(r["token_ids"]) == r["n_tokens"] for r in rows)
    empty = [r for r in rows if r["n_tokens"] == 0]
    assert empty and all(r["ids_sha256"] == hashlib.sha256(b"").hexdigest() for r in empty)
    assert bpe_codec.encode(no_docs, vocab_file()).count() == 0


def unbroken():
    """Texts without ASCII blanks: prose of ideographs, base64, digits, marks, and signs beside every border."""
    r = random.Random(8)
    prose = "".join(r.choice("漢字文章東京語学かなカナ한국어") * r.randrange(1, 3) + r.choice(["", "", "。", "、", "，", "！", "…。", "　"])
                    for _ in range(400))
    code = "".join(r.choice("ABCDEFGHabcdefgh0123456789+/") for _ in range(1200))
    mixed = "".join(r.choice("がが́1漢。、'sS!aー…！　²٣é") for _ in range(800))
    return [prose, code, mixed, "1́20é。", "'1's2'll3", "漢<|endoftext|>。1<|startoftext|>", "7" * 300]


@pytest.mark.parametrize("size", [1, 7, 50, 5000])
def test_borders_hold_without_blanks(raw, library, size):
    t = token_count.transducer(raw)
    for text in unbroken():
        maps = [token_count.chunk_map(t, text[i:i + size]) for i in range(0, len(text), size)]
        assert token_count.scan(t, maps) == len(library.encode(text, add_special_tokens=False).ids), text


def test_long_texts_without_blanks_are_counted_in_their_chunks(raw):
    t = token_count.transducer(raw)
    for text in unbroken()[:2]:
        has, head, tokens, tail = token_count.chunk_map(t, text * 20)
        assert has and tokens > 1000 and len(head) < 200 and len(tail) < 200
    has, head, tokens, tail = token_count.chunk_map(t, "one two" + "x" * 9000)
    assert (has, head, len(tail)) == (True, "one", 9004)


def test_signs_of_special_strings_are_no_borders():
    border = token_count._border(("<5 end>",))
    assert not border.search("5 ") and border.search("4") and border.search("漢。")
