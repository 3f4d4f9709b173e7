"""Line-first quality rules.

Every line of a text is judged on its own, the lines that fail are removed, and
a document is rejected if too much of it went, or if it fails the base rules on
the text as given. A line (between ``\\n``; lines without a word are ignored)
fails by the first of these rules:

* ``punctuation``: no word of it ends in a sentence end, closing quote or
  bracket;
* ``navigation``: it holds ``nav_bars`` or more of the bars and angles that
  separate menu entries, and they make up more than ``nav_pct`` per cent of it;
* ``boilerplate``: it holds a known page phrase for every ``phrase_words`` words
  or fewer, or symbols make up more than ``symbol_pct`` per cent of it, or it
  equals an earlier line of the text.

Bars and phrases are measured by the line's length: a paragraph, or a document
on a single line, does not fail for two bars or one phrase.

A text is one task's work, in numpy arrays over bounded slices; nothing is
shuffled.

Defined cases: a null text has no words and is rejected by the base rules, its
clean text is null; an empty text keeps its empty text; a repeated row is judged
like its copy; an empty table gives no rows; other columns pass through
:func:`clean` untouched, and an input column that has a result's name is
replaced by the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import words as WD

PHRASES = (
    "all rights reserved", "cookie policy", "use cookies", "privacy policy", "terms of use", "terms of service",
    "enable javascript", "lorem ipsum", "sign up for our newsletter", "subscribe to our newsletter", "click here",
    "read more", "skip to content", "powered by wordpress",
)
# What ends a sentence or a clause of prose.
ENDS = ".!?\"')]:;…”’»。！？"
SYMBOLS = "#*$%&|<>"
BARS = "|<>"


@dataclass(frozen=True)
class Rules:
    min_words: int = 20
    window: int = 8
    repeat_pct: int = 30
    nav_bars: int = 2
    nav_pct: int = 3
    phrase_words: int = 20
    symbol_pct: int = 10
    lost_pct: int = 50


RESULT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("word_chars", T.LongType()),
    T.StructField("n_symbols", T.LongType()), T.StructField("n_dup_lines", T.LongType()),
    T.StructField("n_repeat_words", T.LongType()), T.StructField("base_failed", T.BooleanType()),
    T.StructField("n_lines", T.LongType()), T.StructField("n_lines_removed", T.LongType()),
    T.StructField("chars_removed", T.LongType()), T.StructField("kept", T.BooleanType()),
])


def _table(chars: str) -> np.ndarray:
    flags = np.zeros(256, dtype=bool)
    flags[list(chars.encode())] = True
    return flags


_SYMBOL, _BAR = _table(SYMBOLS), _table(BARS)
_END1 = _table("".join(c for c in ENDS if c.isascii()))
_ENDS_WIDE = [c.encode() for c in ENDS if not c.isascii()]
_CHAR = np.ones(256, dtype=bool)
_CHAR[0x80:0xC0] = False  # continuation bytes
_WORD_CHAR = _CHAR & ~WD.BLANK


def _ends_in_stop(data: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether the character that ends before each position is one of ENDS."""
    stop = _END1[data[last - 1]]
    for code in _ENDS_WIDE:
        hit = last >= len(code)
        for i, byte in enumerate(reversed(code), 1):
            hit &= data[np.maximum(last - i, 0)] == byte
        stop |= hit
    return stop


def repeated_words(grams: np.ndarray, text_of: np.ndarray, starts: np.ndarray, window: int, n_words: int) -> np.ndarray:
    """Flags of the words in windows that stand twice or more in their text.
    ``grams`` are hashes of the windows that begin at word ``starts``."""
    covered = np.zeros(n_words + 1, dtype=np.int64)
    keyed = grams ^ WD.mix(text_of.astype(np.uint64) + np.uint64(1))
    ordered = np.sort(keyed)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if len(twice):
        at = starts[np.isin(keyed, twice)]
        np.add.at(covered, at, 1)
        np.add.at(covered, at + window, -1)
    return np.cumsum(covered[:-1]) > 0


def judge(data: np.ndarray, offsets: np.ndarray, rules: Rules) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Result columns for a slice of texts; and per line: its text, its start
    and whether it stays."""
    n = len(offsets) - 1
    starts, ends, first = WD.word_bounds(data, offsets)
    n_words = np.diff(first)
    word_chars = _WORD_CHAR[data]
    out = {"n_words": n_words, "word_chars": WD.per_text(word_chars, offsets),
           "n_symbols": WD.per_text(_SYMBOL[data], offsets)}

    grams = WD.gram_hashes(WD.span_hashes(data, starts, ends), rules.window)
    text_of_word = np.repeat(np.arange(n), n_words)
    at = np.flatnonzero(np.arange(len(grams)) + rules.window <= first[text_of_word[:len(grams)] + 1])
    again = repeated_words(grams[at], text_of_word[at], at, rules.window, len(starts))
    out["n_repeat_words"] = WD.per_text(again, first)

    breaks = np.flatnonzero(data == 10)
    line_start = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    line_end = np.sort(np.concatenate([breaks, offsets[1:]]))
    per = np.searchsorted(breaks, offsets[1:]) - np.searchsorted(breaks, offsets[:-1]) + 1
    text_of = np.repeat(np.arange(n), per)
    word_lo, word_hi = np.searchsorted(starts, line_start), np.searchsorted(starts, line_end)
    full = word_hi > word_lo
    fs, fe, ft, wl, wh = (x[full] for x in (line_start, line_end, text_of, word_lo, word_hi))

    keyed = WD.span_hashes(data, fs, fe) ^ WD.mix(ft.astype(np.uint64) + np.uint64(1))
    dup = np.ones(len(keyed), dtype=bool)
    dup[np.unique(keyed, return_index=True)[1]] = False  # the first of each stays
    out["n_dup_lines"] = np.bincount(ft[dup], minlength=n)

    total = np.zeros((3, len(data) + 1), dtype=np.int64)
    for row, flags in zip(total, (word_chars, _SYMBOL[data], _BAR[data])):
        np.cumsum(flags, out=row[1:])
    chars, symbols, bars = total[:, fe] - total[:, fs]
    stops = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(_ends_in_stop(data, ends), out=stops[1:])
    bad = ((stops[wh] == stops[wl]) | ((bars >= rules.nav_bars) & (100 * bars > rules.nav_pct * chars)) | dup
           | (100 * symbols > rules.symbol_pct * chars))
    phrases = np.zeros(len(fs), dtype=np.int64)
    low = WD.lowered(data).tobytes()
    for phrase in PHRASES:
        code, found = phrase.encode(), low.find(phrase.encode())
        while found >= 0:
            line = np.searchsorted(fs, found, side="right") - 1
            if line >= 0 and found + len(code) <= fe[line]:
                phrases[line] += 1
            found = low.find(code, found + 1)
    bad |= (phrases > 0) & (phrases * rules.phrase_words >= wh - wl)

    lost = np.bincount(ft[bad], weights=chars[bad], minlength=n).astype(np.int64)
    out["n_lines"] = np.bincount(ft, minlength=n)
    out["n_lines_removed"] = np.bincount(ft[bad], minlength=n)
    out["chars_removed"] = lost
    out["base_failed"] = (n_words < rules.min_words) | (100 * out["n_repeat_words"] > rules.repeat_pct * n_words)
    out["kept"] = ~out["base_failed"] & (100 * lost <= rules.lost_pct * out["word_chars"])
    stays = np.ones(len(text_of), dtype=bool)
    stays[np.flatnonzero(full)[bad]] = False
    return out, text_of, line_start, stays


def _cleaned(data: np.ndarray, offsets: np.ndarray, text_of: np.ndarray, line_start: np.ndarray,
             stays: np.ndarray) -> list[str]:
    raw, texts = data.tobytes(), []
    first = np.searchsorted(text_of, np.arange(len(offsets)))
    for t in range(len(offsets) - 1):
        lo, hi = first[t], first[t + 1]
        text = raw[offsets[t]:offsets[t + 1]]
        if not stays[lo:hi].all():
            text = b"\n".join(line for line, keep in zip(text.split(b"\n"), stays[lo:hi]) if keep)
        texts.append(text.decode("utf-8", "replace"))
    return texts


def clean(docs: DataFrame, text: str = "text", rules: Rules = Rules(), clean_text: str | None = "clean_text") -> DataFrame:
    """The documents with the result columns and, unless ``clean_text`` is
    None, the text without its failed lines. No row is dropped: ``kept`` says
    which documents the rules accept."""
    new = {f.name.lower() for f in RESULT} | ({clean_text.lower()} if clean_text else set())
    passed = [c for c in docs.columns if c.lower() not in new or c == text]
    given = docs.select(*[docs[f"`{c}`"].alias(f"p{i}") for i, c in enumerate(passed)],
                        docs[f"`{text}`"].cast("string").alias("judged"))
    fields = [T.StructField(f"p{i}", docs.schema[c].dataType) for i, c in enumerate(passed)]
    fields += [T.StructField(f"r{i}", f.dataType) for i, f in enumerate(RESULT)]
    fields += [T.StructField("cleaned", T.StringType())] if clean_text else []
    arrow = {"bigint": pa.int64(), "boolean": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            for lo, data, offsets in WD.text_slices(column):
                got, text_of, line_start, stays = judge(data, offsets, rules)
                size = len(offsets) - 1
                cols = [batch.column(i).slice(lo, size) for i in range(len(passed))]
                cols += [pa.array(got[f.name], arrow[f.dataType.simpleString()]) for f in RESULT]
                if clean_text:
                    null = column.slice(lo, size).is_null().to_pylist()
                    texts = _cleaned(data, offsets, text_of, line_start, stays)
                    cols.append(pa.array([None if x else t for x, t in zip(null, texts)], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    out = given.mapInArrow(run, T.StructType(fields))
    names = [n for n in passed if n.lower() not in new]
    keep = [out[f"p{i}"].alias(c) for i, c in enumerate(passed) if c in names]
    keep += [out[f"r{i}"].alias(f.name) for i, f in enumerate(RESULT)]
    return out.select(*keep, *([out["cleaned"].alias(clean_text)] if clean_text else []))
