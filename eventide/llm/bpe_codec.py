"""BPE encoding over a trie of distinct words, and decoding.

The distinct words of a slice of texts, sorted, are their trie in depth-first
order: what a word shares with the one before it is the path from the root to
the branch. Along the path stands, for every prefix, its last token and where
that token begins; the last token of a longer prefix follows from those alone
(the one token that ends there and may follow the last token of the prefix
before it). So the encoding of a shared prefix is worked out once, and a word's
tokens are read back from its last byte. Encoded words stay in a bounded memo.

A text is encoded piece by piece, cut before blanks, so that a very long text
needs memory for one piece and its digests only.

Defined cases: a null or empty text has no tokens and decodes to the empty
text; repeated rows are encoded each; an empty table gives no rows; other
columns pass through. Special strings inside a text are one token each.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_core import Vocabulary, normalised, read_vocabulary, vocabulary, word_symbols

PIECE_CHARS = 1 << 20
MEMO_WORDS = 200_000

Encoded = tuple[bytes, str]  # ids as little-endian 32-bit integers, decoded text


class TrieEncoder:
    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.memo: dict[str, Encoded] = {}

    def learn(self, words: set[str]) -> None:
        """Encode the words that the memo lacks."""
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        new = words.difference(self.memo)
        path = ""
        last, begin = [-1], [0]  # per prefix of the path: its last token, where that begins
        for symbols, word in sorted((word_symbols(w), w) for w in new):
            inner = symbols[:-1]
            shared = 0
            for a, b in zip(path, inner):
                if a != b:
                    break
                shared += 1
            del last[shared + 1:], begin[shared + 1:]
            for n in range(shared, len(inner)):
                token, start = self._last(inner[:n + 1], last)
                last.append(token)
                begin.append(start)
            path = inner
            token, at = self._last(symbols, last)
            ids = [token]
            while at:
                ids.append(last[at])
                at = begin[at]
            ids.reverse()
            self.memo[word] = (struct.pack(f"<{len(ids)}I", *ids), " ".join([self.vocab.shown[i] for i in ids]))

    def _last(self, prefix: str, last: list[int]) -> tuple[int, int]:
        """The last token of a prefix and where it begins, from the last tokens
        of the shorter prefixes."""
        id_of, fits = self.vocab.id_of, self.vocab.fits
        for start in range(max(0, len(prefix) - self.vocab.longest), len(prefix)):
            token = id_of.get(prefix[start:])
            if token is not None and fits(last[start], token):
                return token, start
        raise ValueError(f"no token ends at byte {ord(prefix[-1]) % 256}")

    def encode(self, texts: list[str]) -> Iterator[list[Encoded]]:
        """The encoded words of each text, in order."""
        cut = [[(special, self.vocab.cut_words(normalised(piece)) if special is None else [piece])
                for piece, special in self.vocab.pieces(text)] for text in texts]
        self.learn({w for text in cut for special, ws in text if special is None for w in ws})
        of = self.memo.__getitem__
        for text in cut:
            got: list[Encoded] = []
            for special, ws in text:
                if special is None:
                    got += map(of, ws)
                else:
                    got.append((struct.pack("<I", special), ws[0]))
            yield got


_built: dict[int, TrieEncoder] = {}


def encoder(raw: str) -> TrieEncoder:
    vocab = vocabulary(raw)
    if id(vocab) not in _built:
        _built.clear()
        _built[id(vocab)] = TrieEncoder(vocab)
    return _built[id(vocab)]


_CUT = re.compile(r"[ \t\n\r]")


def pieces(text: str, limit: int = PIECE_CHARS) -> Iterator[str]:
    """The text in pieces of about ``limit`` characters, each but the first
    beginning with a blank."""
    at = 0
    while len(text) - at > limit:
        cut = _CUT.search(text, at + limit)
        if cut is None:
            break
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:]


def encode_texts(raw: str, texts: list[str | None], full: bool = True) -> Iterator[tuple[int, bytes, str, str, str]]:
    """(n_tokens, ids, ids_sha256, decoded, decoded_sha256) per text; without
    ``full`` ids and decoded text stay empty, the digests are whole."""
    enc = encoder(raw)
    batch: list[str] = []
    held = 0

    def flush(batch: list[str]) -> Iterator[tuple[int, bytes, str, str, str]]:
        for got in enc.encode(batch):
            ids, shown = b"".join([g[0] for g in got]), " ".join([g[1] for g in got])
            yield (len(ids) // 4, ids if full else b"", hashlib.sha256(ids).hexdigest(), shown if full else "",
                   hashlib.sha256(shown.encode("utf-8", "surrogatepass")).hexdigest())

    for text in texts:
        text = text or ""
        if len(text) > PIECE_CHARS:
            yield from flush(batch)
            batch, held = [], 0
            n, ids_sha, shown_sha, all_ids, all_shown = 0, hashlib.sha256(), hashlib.sha256(), [], []
            for piece in pieces(text):
                for _, ids, _, shown, _ in flush_one(enc, piece):
                    if not ids:
                        continue
                    raw_shown = shown if n == 0 else " " + shown
                    n += len(ids) // 4
                    ids_sha.update(ids)
                    shown_sha.update(raw_shown.encode("utf-8", "surrogatepass"))
                    if full:
                        all_ids.append(ids)
                        all_shown.append(raw_shown)
            yield n, b"".join(all_ids), ids_sha.hexdigest(), "".join(all_shown), shown_sha.hexdigest()
            continue
        batch.append(text)
        held += len(text)
        if held > PIECE_CHARS:
            yield from flush(batch)
            batch, held = [], 0
    yield from flush(batch)


def flush_one(enc: TrieEncoder, piece: str) -> Iterator[tuple[int, bytes, str, str, str]]:
    for got in enc.encode([piece]):
        ids = b"".join([g[0] for g in got])
        yield len(ids) // 4, ids, "", " ".join([g[1] for g in got]), ""


def encode(docs: DataFrame, vocab_file: str, text: str = "text", full: bool = True, decoded: bool = True) -> DataFrame:
    """The documents' columns but the text, with n_tokens, ids_sha256,
    decoded_sha256 and, if ``full``, token_ids (array of int) and, unless
    ``decoded`` is off, the decoded text. The vocabulary file is read on the driver (a file of fixed size) and broadcast."""
    raw = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocab_file))
    new = ["n_tokens", "ids_sha256", "decoded_sha256", *(["token_ids"] if full else []),
           *(["decoded"] if full and decoded else [])]
    others = [c for c in docs.columns if c.lower() not in (text.lower(), *new)]
    given = docs.select(*[docs[f"`{c}`"].alias(f"p{i}") for i, c in enumerate(others)],
                        docs[f"`{text}`"].cast("string").alias("body"))

    names = [*given.columns[:-1], *new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body = batch.column(len(others))
            for lo in range(0, batch.num_rows, 256):
                part = body.slice(lo, 256)
                rows = list(encode_texts(raw.value, part.to_pylist(), full))
                n, ids, ids_sha, shown, shown_sha = zip(*rows)
                cols = [pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(shown_sha)]
                if full:
                    flat = pa.array(np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int32))
                    cuts = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                    cols.append(pa.ListArray.from_arrays(cuts, flat))
                    if decoded:
                        cols.append(pa.array(shown, pa.string()))
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(lo, 256) for i in range(len(others))], *cols],
                                                 names=names)

    kinds = ["long", "string", "string", "array<int>", "string"]
    schema = ", ".join([f"`p{i}` {given.schema[f'p{i}'].dataType.simpleString()}" for i in range(len(others))]
                       + [f"{n} {k}" for n, k in zip(new, kinds)])
    out = given.mapInArrow(run, schema)
    return out.select(*[out[f"p{i}"].alias(c) for i, c in enumerate(others)], *new)
