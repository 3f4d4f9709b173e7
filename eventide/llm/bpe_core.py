"""Shared parts of the two BPE operators: the vocabulary file, the cut of a text
into words, and the test whether two tokens may stand next to each other.

The file is a public ``tokenizers`` JSON of a BPE model with an end-of-word
suffix (``word_bpe_49k.json``): the text is brought to NFC, blanks become
spaces, letters lower case; a fixed pattern cuts out words; the bytes of a word
are symbols, the last one marked as final; merges apply by rank. Special
strings are split off before anything else and are one token each.

Two facts make words cheap: the tokens of a word's prefix are found from the
last token of shorter prefixes alone, and a sequence of tokens is the model's
output exactly if each token encodes to itself and each adjacent pair does.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import regex
from tokenizers import Tokenizer
from tokenizers.normalizers import NFC

# The pattern of the vocabulary file, for texts in Latin-1 and for all others.
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
_BLANKS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Capitals newer than Python's tables, (first, last, distance to the small letter).
_NEW_CAPITALS = (
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1),
    (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC),
    (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B),
)
_lower_new = {c: c + d for lo, hi, d in _NEW_CAPITALS for c in range(lo, hi + 1)}
_has_new = re.compile("[" + "".join(f"{chr(lo)}-{chr(hi)}" for lo, hi, _ in _NEW_CAPITALS) + "]")
_marks = regex.compile(r"\p{M}")
_library_nfc = NFC().normalize_str


def _ranges(points: list[int]) -> list[list[int]]:
    out: list[list[int]] = []
    for c in points:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return out


@lru_cache(maxsize=4)
def read_vocabulary(path: str) -> str:
    """The text of a vocabulary file with the letters and numbers, as code
    point ranges, that the library's own Unicode tables know. Runs on the driver; the text is of fixed
    size and goes to the tasks as a broadcast."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    signs = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    points = [ord(c) for c in regex.findall(r"[\p{L}\p{N}]", signs)]  # the newest tables: none is missing here
    cut = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    kinds = []
    for lo in range(0, len(points), 1 << 16):
        some = points[lo:lo + (1 << 16)]
        # between two a's a doubled letter makes one piece, a doubled number four, any other sign three
        probe = "\n".join(f"a{chr(c)}{chr(c)}a" for c in some)
        pieces = [0] * len(some)
        for _, (begin, _end) in cut(probe):
            pieces[begin // 5] += 1
        kinds += [{1: "L", 4: "N"}.get(n, "") for n in pieces]
    spec["classes"] = {k: _ranges([c for c, kind in zip(points, kinds) if kind == k]) for k in "LN"}
    return json.dumps(spec)


def _pattern(classes: dict[str, list[list[int]]], limit: int) -> re.Pattern:
    """The word pattern for code points below ``limit``."""
    letters, numbers = ("".join(f"{chr(a)}-{chr(min(b, limit - 1))}" for a, b in classes[k] if a < limit) for k in "LN")
    return re.compile(f"{_CONTRACTIONS}|[{letters}]+|[{numbers}]|[^{_BLANKS}{letters}{numbers}]+")


def normalised(text: str) -> str:
    """NFC and lower case, letter by letter (a sigma at a word's end included).
    Marks are put in the order of the library's own Unicode version."""
    if text.isascii():
        return text.lower()
    if _marks.search(text) or not unicodedata.is_normalized("NFC", text):
        text = _library_nfc(text)
    if _has_new.search(text):
        text = text.translate(_lower_new)
    return text.replace("Σ", "σ").lower()


class Vocabulary:
    """Tokens and merges of a text from :func:`read_vocabulary`. Symbols are characters: byte b
    inside a word is ``chr(b)``, as a word's last byte ``chr(256 + b)``."""

    def __init__(self, raw: str):
        spec = json.loads(raw)
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        if model["type"] != "BPE" or not suffix:
            raise ValueError("not a BPE vocabulary with an end-of-word suffix")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True))
                                        + ")") if self.special else None
        byte_of = _byte_of()

        def symbols(token: str) -> str | None:
            final = token.endswith(suffix)
            plain = token[:-len(suffix)] if final else token
            if not plain or any(c not in byte_of for c in plain):
                return None
            own = [chr(byte_of[c]) for c in plain]
            if final:
                own[-1] = chr(256 + ord(own[-1]))
            return "".join(own)

        self.shown = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.id_of: dict[str, int] = {}
        for token, i in model["vocab"].items():
            if (s := symbols(token)) is not None:
                self.id_of[s] = i
        self.text_of = {i: s for s, i in self.id_of.items()}
        self.rank = {}
        for n, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            a, b = symbols(a), symbols(b)
            if a is not None and b is not None:
                self.rank.setdefault((a, b), n)
        self.longest = max(map(len, self.id_of))
        self._latin, self._any = _pattern(spec["classes"], 256), _pattern(spec["classes"], 0x110000)
        self._fits: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}

    def merged(self, word: str) -> list[str]:
        """The symbols of a short word after all merges, by rank."""
        parts = list(word)
        while len(parts) > 1:
            best = min(zip(parts, parts[1:]), key=lambda p: self.rank.get(p, 1 << 60))
            if best not in self.rank:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == best:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def whole(self, token: int) -> bool:
        """Whether the model ever gives this token: its own text encodes to it."""
        got = self._whole.get(token)
        if got is None:
            got = self._whole[token] = len(self.merged(self.text_of[token])) == 1
        return got

    def fits(self, left: int, right: int) -> bool:
        """Whether ``right`` may follow ``left`` within a word. ``left`` is -1 at
        the word's start."""
        if left < 0:
            return self.whole(right)
        key = left << 20 | right
        got = self._fits.get(key)
        if got is None:
            if len(self._fits) > 300_000:
                self._fits.clear()
            a, b = self.text_of[left], self.text_of[right]
            got = self._fits[key] = self.whole(right) and self.merged(a + b) == [a, b]
        return got

    def cut_words(self, text: str) -> list[str]:
        """The words of a normalised text."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self._any.findall(text)
        return self._latin.findall(text)

    def pieces(self, text: str) -> Iterator[tuple[str, int | None]]:
        """(ordinary text, None) and (special string, its id) in order."""
        if self.special_split is None or "<" not in text:
            yield text, None
            return
        for n, piece in enumerate(self.special_split.split(text)):
            if n % 2:
                yield piece, self.special[piece]
            elif piece:
                yield piece, None


def word_symbols(word: str) -> str:
    """A word's symbols: its UTF-8 bytes, the last one final."""
    raw = word.encode("utf-8", "surrogatepass").decode("latin-1")
    return raw[:-1] + chr(256 + ord(raw[-1]))


def _byte_of() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1
    stands for itself, the other bytes for the code points from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out = {chr(b): b for b in own}
    rest = [b for b in range(256) if b not in set(own)]
    return out | {chr(256 + n): b for n, b in enumerate(rest)}


_loaded: dict[int, Vocabulary] = {}


def vocabulary(raw: str) -> Vocabulary:
    """The vocabulary of a file's text, built once in a process."""
    key = hash(raw)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Vocabulary(raw)
    return _loaded[key]


class Bounded(dict):
    """A memo of bounded size: emptied when full, so its memory stays bounded
    on any input and frequent words come back at once."""

    def __init__(self, find, limit: int):
        super().__init__()
        self.find, self.limit = find, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        got = self[key] = self.find(key)
        return got
