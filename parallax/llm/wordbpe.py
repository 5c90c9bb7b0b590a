"""Token ids of whole texts, by word.

A tokenizer that splits a text into words before its merges gives each word the
same ids wherever it stands. So a batch's different words are encoded once by
``tokenizers`` and the texts' ids are put together from them; words seen before
by the worker are not encoded again (a bounded cache). Arrow splits the texts
and tells their different words, numpy gathers the ids. Texts outside the plain
alphabet for which this is exact go through ``tokenizers`` whole, and so does
every text if the file's rules are not of that kind.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Characters for which the file's normaliser and word pattern mean the same to Python and Arrow: printable
# ASCII, tab, line ends, Latin letters and marks below U+0250 (but for the superscripts and fractions, which
# are numbers, and the capital dotted I, which lower-cases to two characters), general punctuation, the euro sign.
_PLAIN = re.compile("[\t\n\r -~ -±´-¸º»¿-įı-ɏ‐-‧€]*")
# The word pattern of the file but for the words of letters alone: set between spaces, these matches leave those words.
_OTHER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{N}]|[^\s\p{L}\p{N}]+"
# The rules in the tokenizer file for which word-by-word encoding holds.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALISERS = ["NFC", "Replace", "Lowercase"]

MAX_CACHED = 400_000


def _by_word(rules: dict) -> bool:
    """Whether the tokenizer's rules are those that ``_PLAIN`` and ``_OTHER`` stand for."""
    norm, pre, model = rules.get("normalizer") or {}, rules.get("pre_tokenizer") or {}, rules.get("model") or {}
    parts = pre.get("pretokenizers") or [{}]
    return ([x.get("type") for x in norm.get("normalizers") or []] == _NORMALISERS
            and parts[0].get("type") == "Split" and (parts[0].get("pattern") or {}).get("Regex") == _PATTERN
            and parts[0].get("behavior") == "Removed" and parts[0].get("invert") is True
            and model.get("type") == "BPE" and not model.get("dropout"))


def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others, in order, for 256 and up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: b for b in plain} | {b: 256 + k for k, b in enumerate(rest)}


class WordEncoder:
    """``encode(texts)``: an array of ids for each text, as ``tokenizers`` gives them without special tokens added.

    The unit of the cache is a word; what it holds is one flat list of ids and
    each word's place in it, so that the texts' ids are gathered by numpy."""

    def __init__(self, tokenizer_file: str, max_cached: int = MAX_CACHED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker per core
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(tokenizer_file)
        self._model = self._tokenizer.model
        with open(tokenizer_file, encoding="utf-8") as f:
            rules = json.load(f)
        self._words = _by_word(rules)
        special = [x["content"] for x in rules.get("added_tokens") or []]
        self._special = re.compile("|".join(map(re.escape, special))) if special else None
        self._letters = _byte_letters()
        self._max = max_cached
        self._clear()

    def _clear(self) -> None:
        # the empty word, which stands at the ends of a split text, has no ids
        self._place: dict[str, int] = {"": 0}
        self._flat, self._starts, self._lengths = array("I"), array("q", [0]), array("q", [0])

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain(self, text: str) -> bool:
        return bool(_PLAIN.fullmatch(text)) and not (self._special and self._special.search(text))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self._words:
            return self._whole(texts)
        plain = [self._plain(t) for t in texts]
        whole = iter(self._whole([t for t, ok in zip(texts, plain, strict=True) if not ok]) if not all(plain) else [])
        by_word = iter(self._gathered([t for t, ok in zip(texts, plain, strict=True) if ok]))
        return [next(by_word if ok else whole) for ok in plain]

    def _gathered(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of plain texts, put together from their words' ids."""
        if not texts:
            return []
        lower = pa.array([t.lower().replace("\xa0", " ") for t in texts], pa.large_string())
        split = pc.ascii_split_whitespace(pc.replace_substring_regex(lower, _OTHER, r" \0 "))
        words = split.flatten().dictionary_encode()
        different = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        k = self._places(different)[words.indices.to_numpy()]
        flat, starts, lengths = (np.frombuffer(x, kind) for x, kind in
                                 ((self._flat, np.uint32), (self._starts, np.int64), (self._lengths, np.int64)))
        n = lengths[k]
        ends = np.concatenate(([0], np.cumsum(n)))
        ids = flat[np.repeat(starts[k] - ends[:-1], n) + np.arange(ends[-1])]
        # a text's words stand from offset to offset; flatten() starts at the first one
        offsets = split.offsets.to_numpy()
        return np.split(ids, ends[offsets - offsets[0]][1:-1])

    def _places(self, words: list[str]) -> np.ndarray:
        """Where the cache holds each of the words, all different; puts those it lacks into it."""
        places = self._found(words)
        missing = np.flatnonzero(places < 0)
        if len(self._place) + len(missing) > self._max:
            self._clear()
            places = self._found(words)
            missing = np.flatnonzero(places < 0)
        at = len(self._starts)
        self._learn([words[k] for k in missing.tolist()])
        places[missing] = np.arange(at, at + len(missing))
        return places

    def _found(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self._place.get, words, repeat(-1)), np.int64, len(words))

    def _learn(self, new: list[str]) -> None:
        """Adds words that the cache lacks, in their order."""
        tokenize, letters = self._model.tokenize, self._letters
        at = len(self._flat)
        for place, w in enumerate(new, len(self._starts)):
            spelt = w if w.isascii() else w.encode().decode("latin-1").translate(letters)
            ids = [t.id for t in tokenize(spelt)]
            self._flat.extend(ids)
            self._place[w] = place
            self._starts.append(at)
            self._lengths.append(len(ids))
            at += len(ids)


@lru_cache(maxsize=2)
def worker_encoder(tokenizer_file: str) -> WordEncoder:
    """The worker's encoder of a file: its cache lasts over tasks, and is bounded."""
    return WordEncoder(tokenizer_file)
