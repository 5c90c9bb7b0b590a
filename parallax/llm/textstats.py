"""Document statistics by numpy over code points and words (``mapInArrow``).

One row in, one row out; a null text counts as empty. Statistics of an empty
text are all zero. The whole text is read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from parallax.session import free_arrow

# The statistics, in order.
STATS = [
    "n_words",          # words (runs without white space)
    "n_lines",          # non-blank lines
    "mean_word",        # mean word length
    "max_word",         # longest word
    "upper_share",      # upper-case letters / letters
    "digit_share",      # digits / characters
    "symbol_share",     # symbols (# $ % & * + < = > @ ^ _ ` | ~ and the like) / characters
    "punct_share",      # other punctuation / characters
    "bang_share",       # ! / characters
    "pipe_share",       # | / characters
    "letter_share",     # letters / characters
    "distinct_words",   # distinct words / words
    "repeat_next",      # words equal to the one before / words
    "distinct_lines",   # distinct non-blank lines / non-blank lines
    "end_share",        # lines that end in . ! ? : or ; / lines
    "word_symbol",      # words with a symbol / words
]

_SYMBOLS = "#$%&*+<=>@^_`|~\\/{}[]"


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of each code point below 0x3000: 0 other, 1 lower or caseless letter, 2 upper, 3 digit, 4 space, 5 punctuation, 6 symbol."""
    out = np.zeros(0x3001, np.uint8)
    for cp in range(0x3000):
        c = chr(cp)
        cat = unicodedata.category(c)
        if c in _SYMBOLS or cat[0] == "S":
            out[cp] = 6
        elif cat == "Lu":
            out[cp] = 2
        elif cat[0] == "L":
            out[cp] = 1
        elif cat[0] == "N":
            out[cp] = 3
        elif c.isspace():
            out[cp] = 4
        elif cat[0] == "P":
            out[cp] = 5
    out[0x3000] = 1  # stands for every code point above
    return out


def stats_of(text: str | None) -> list[float]:
    """The statistics of one text, in the order of STATS."""
    t = text or ""
    words = t.split()
    if not words:
        return [0.0] * len(STATS)
    cp = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
    cls = _classes()[np.minimum(cp, 0x3000)]
    n = len(cp)
    k = np.bincount(cls, minlength=7)
    letters = int(k[1] + k[2])
    nw = len(words)
    lens = [len(w) for w in words]
    lines = [x for x in (y.strip() for y in t.split("\n")) if x]
    # a word has a symbol: count symbol runs' words by splitting positions at white space
    sym = cls == 6
    if sym.any():
        word_no = np.cumsum(cls == 4)
        with_sym = len(np.unique(word_no[sym]))
    else:
        with_sym = 0
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return [
        float(nw), float(len(lines)), sum(lens) / nw, float(max(lens)),
        k[2] / letters if letters else 0.0, k[3] / n, k[6] / n, k[5] / n,
        t.count("!") / n, t.count("|") / n, letters / n,
        len(set(words)) / nw, repeats / nw, len(set(lines)) / len(lines),
        sum(x[-1] in ".!?:;" for x in lines) / len(lines), with_sym / nw,
    ]


def stats_batches(batches: Iterator, text_at: int, keep: int) -> Iterator:
    """For ``mapInArrow``: the first ``keep`` columns as they came, then the statistics of column ``text_at``."""
    import pyarrow as pa

    for batch in batches:
        m = np.array([stats_of(t.as_py()) for t in batch.column(text_at)], float).reshape(-1, len(STATS))
        yield pa.RecordBatch.from_arrays([*batch.columns[:keep], *(pa.array(np.ascontiguousarray(c)) for c in m.T)],
                                         names=[*batch.schema.names[:keep], *STATS])
        free_arrow()
