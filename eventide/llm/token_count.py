"""Token counts by a compiled finite-state tokenizer.

The BPE model is compiled, as far as the texts ask for it, into a deterministic
transducer over a word's bytes. A state is all that the rest of a word can
depend on: the longest suffix of the bytes read that begins some token, the last
token of each prefix that ends inside that suffix, and how many tokens those
prefixes have. A transition is annotated with the change of the token count it
makes; the sum along a word's path is the word's token count. Transitions are
found once per process and kept; distinct words are run once while they stay in
a bounded memo.

Texts are read in chunks. The transducer is back in its start state at every
blank, before every digit (a word of its own) and between an ideograph, syllable
or kana and the stop after it, whatever stands before. The map of a chunk from
incoming to outgoing state so has three parts: what is read before its first
such border (its effect depends on the incoming state), the tokens emitted
between its first and last border, and the pending rest. Maps compose
associatively; the chunks of a text are counted as separate rows, their maps
meet by row and are composed pairwise in a scan. Only a run of chunks without
any border (one word of over 65,536 characters, or Thai without blanks) is its
own map and counted by one task.

Defined cases: a null or empty text has 0 tokens; repeated rows are counted
each; an empty table gives no rows; other columns pass through, but for one that
has the name of the new column. Special strings
inside a text are one token each, as the library does by default.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_core import Bounded, Vocabulary, normalised, read_vocabulary, vocabulary, word_symbols

CHUNK_CHARS = 1 << 16
MEMO_WORDS = 300_000
MEMO_STATES = 400_000


class Transducer:
    """Deterministic transducer of a vocabulary; ``count`` runs a word."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.openings = {s[:i] for s in vocab.id_of for i in range(len(s))}
        self.memo = Bounded(self.run, MEMO_WORDS)
        self._reset()

    def _reset(self) -> None:
        # a state: (window, last token and token count at each of the window's borders)
        self.states: list[tuple[str, tuple[int, ...], tuple[int, ...]]] = [("", (-1,), (0,))]
        self.number = {self.states[0]: 0}
        self.moves: list[dict[str, tuple[int, int]]] = [{}]

    def _compile(self, state: int, symbol: str) -> tuple[int, int]:
        """(next state, emitted tokens) of a transition. After a final symbol
        the next state is the start."""
        window, last, counts = self.states[state]
        read = window + symbol
        for i in range(len(read)):
            token = self.vocab.id_of.get(read[i:])
            if token is not None and self.vocab.fits(last[i], token):
                break
        else:
            raise ValueError(f"no token ends at byte {ord(symbol) % 256}")
        emitted = counts[i] + 1
        if ord(symbol) > 255:
            return 0, emitted
        for j in range(len(read) + 1):
            if read[j:] in self.openings:
                break
        after = (read[j:], (*last, token)[j:], tuple(c - emitted for c in (*counts, emitted))[j:])
        nxt = self.number.get(after)
        if nxt is None:
            nxt = self.number[after] = len(self.states)
            self.states.append(after)
            self.moves.append({})
        return nxt, emitted

    def run(self, word: str) -> int:
        """Token count of one word."""
        if len(self.states) > MEMO_STATES:
            self._reset()
        state, total = 0, 0
        for symbol in word_symbols(word):
            move = self.moves[state].get(symbol)
            if move is None:
                move = self.moves[state][symbol] = self._compile(state, symbol)
            state, emitted = move
            total += emitted
        return total

    def count(self, text: str) -> int:
        """Token count of a text that begins and ends at the start state."""
        total, of = 0, self.memo.__getitem__
        for piece, special in self.vocab.pieces(text):
            total += 1 if special is not None else sum(map(of, self.vocab.cut_words(normalised(piece))))
        return total


_built: dict[int, Transducer] = {}


def transducer(raw: str) -> Transducer:
    vocab = vocabulary(raw)
    if id(vocab) not in _built:
        _built.clear()
        _built[id(vocab)] = Transducer(vocab)
    return _built[id(vocab)]


# A chunk's map: (has a border, what precedes the first, tokens between, pending rest)
ChunkMap = tuple[bool, str, int, str]

# Borders that hold in any context: blanks and digits, and stops after signs that are letters of one piece.
_BORDER_SIGNS = " \t\n\r\x0b\x0c\u30000123456789"
_STOPS = "\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f"
_BEFORE_STOPS = "\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff\uac00-\ud7a3"


@lru_cache(maxsize=4)
def _border(special: tuple[str, ...]) -> re.Pattern:
    """Border signs but those of special strings, which must not be cut."""
    inside = set("".join(special))
    signs, stops = ("".join(c for c in cs if c not in inside) for cs in (_BORDER_SIGNS, _STOPS))
    return re.compile(f"[{signs}]" + (f"|(?<=[{_BEFORE_STOPS}])[{stops}]" if stops else ""))


def _last(border: re.Pattern, text: str) -> int:
    """Start of the last border of a text that has one; looks further back
    in steps that grow."""
    step = 64
    while True:
        at = -1
        for m in border.finditer(text, max(0, len(text) - step)):
            at = m.start()
        if at >= 0:
            return at
        step *= 8


def chunk_map(t: Transducer, text: str) -> ChunkMap:
    border = _border(tuple(t.vocab.special))
    found = border.search(text)
    if not found:
        return False, text, 0, ""
    first, last = found.start(), _last(border, text)
    return True, text[:first], t.count(text[first:last]), text[last:]


def compose(t: Transducer, a: ChunkMap, b: ChunkMap) -> ChunkMap:
    """The map of two chunks one after the other; associative."""
    if not a[0]:
        return b[0], a[1] + b[1], b[2], b[3]
    if not b[0]:
        return True, a[1], a[2], a[3] + b[1]
    return True, a[1], a[2] + t.count(a[3] + b[1]) + b[2], b[3]


def scan(t: Transducer, maps: list[ChunkMap]) -> int:
    """Tokens of a text from its chunks' maps, neighbours first, so that no
    pending text is copied more than log(n) times."""
    while len(maps) > 1:
        maps = [compose(t, *maps[i:i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    return t.count(maps[0][1]) + maps[0][2] + t.count(maps[0][3]) if maps else 0


def count_tokens(docs: DataFrame, vocab_file: str, text: str = "text", out: str = "n_tokens",
                 chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """The documents' columns but the text, and the token count. The
    vocabulary file is read on the driver (a file of fixed size) and broadcast."""
    spark = docs.sparkSession
    raw = spark.sparkContext.broadcast(read_vocabulary(vocab_file))
    others = [c for c in docs.columns if c.lower() not in (text.lower(), out.lower())]
    body = F.coalesce(docs[f"`{text}`"].cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"),
                       F.struct(*[docs[f"`{c}`"].alias(f"p{i}") for i, c in enumerate(others)], F.lit(0).alias("z"))
                       .alias("kept"), body.alias("body"))
    cuts = F.sequence(F.lit(1), F.greatest(F.length("body"), F.lit(1)), F.lit(chunk_chars))
    chunks = rows.select("row", "kept", "body", F.posexplode(cuts).alias("nth", "at")).select(
        "row", F.when(F.col("nth") == 0, F.col("kept")).alias("kept"), "nth",
        F.substring("body", F.col("at"), F.lit(chunk_chars)).alias("chunk"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(raw.value)
        for batch in batches:
            maps = [chunk_map(t, c.as_py()) for c in batch.column(3)]
            cols = [pa.array(c, kind) for c, kind in zip(zip(*maps), (pa.bool_(), pa.string(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *cols] if maps else
                                             [*batch.columns[:3], *[pa.array([], k) for k in (
                                                 pa.bool_(), pa.string(), pa.int64(), pa.string())]],
                                             names=["row", "kept", "nth", "blank", "head", "tokens", "tail"])

    kept_type = rows.schema["kept"].dataType.simpleString()
    maps = chunks.mapInArrow(count, f"row long, kept {kept_type}, nth int, blank boolean, head string, tokens long, "
                                    "tail string")
    whole = maps.groupBy("row").agg(
        F.first("kept", ignorenulls=True).alias("kept"),
        F.sort_array(F.collect_list(F.struct("nth", "blank", "head", "tokens", "tail"))).alias("maps"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(raw.value)
        for batch in batches:
            totals = [scan(t, [(m["blank"], m["head"], m["tokens"], m["tail"]) for m in ms.as_py()])
                      for ms in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals, pa.int64())], names=["kept", "total"])

    done = whole.select("kept", "maps").mapInArrow(finish, f"kept {kept_type}, total long")
    return done.select(*[F.col(f"kept.p{i}").alias(c) for i, c in enumerate(others)], F.col("total").alias(out))
