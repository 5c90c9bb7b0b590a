"""SentencePiece encoding and decoding: a batched numpy Viterbi over words.

A model file (protocol buffer) is read into its pieces, scores, kinds and
normaliser settings. A text is normalised, cut into words (a word starts at a
``▁`` that follows another character; no piece crosses that border), and the
different words are encoded in batches of equal length that advance together,
one character per step (a run of more than ``LONG_WORD`` characters without a space is
first cut between characters that stand side by side in no piece, which no piece can cross either):

* hashes of all substrings that end at the step come from running prefix
  hashes and probe the sorted hashes of the pieces;
* every (start, piece) that fits is a candidate; candidates of every word are
  ranked in one array, and the vectorised maximum over the starts is stored as
  score and backpointer.

Unigram models: a candidate's score is the best score of its start plus the
piece's, unknown characters get the lowest score less 10, as the format defines.

BPE models: the plain sum of their scores (minus the merge rank) is not what
their encoder maximises, so the candidate's rank is 1 if the piece may follow
the start's last piece in an encoding and -inf if not. A sequence of pieces is
the BPE encoding of its text if and only if each neighbouring pair is the
encoding of the pair's own text, and every prefix has exactly one such last
piece, so the maximum is the encoder's result, not an approximation. The pairs
are decided by merging their characters once, and kept.

Characters that no piece covers become their UTF-8 byte pieces (byte fallback)
or the unknown piece. Decoding looks pieces up, joins bytes (a byte that is part
of no character becomes U+FFFD) and turns ``▁`` back into spaces; texts of only
known characters or with byte fallback come back as they were normalised.

Defined cases: a null or empty text has no ids and decodes to an empty text; an empty table gives no rows; very
long texts are encoded whole; repeated rows and null ids are kept as they are;
further columns are ignored; a model with a normaliser table other than identity
is refused.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
UNIGRAM, BPE = 1, 2
# Kinds of pieces in the file format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
LONG_WORD = 64
MAX_CACHED_WORDS = 200_000
PAIR_SLOTS = 1 << 21  # a pair's slot is its key's hash; a later pair takes the slot over
SLICE_CHARS = 6_000_000  # characters whose words are learned together
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORDS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


def _fields(data: bytes) -> Iterator[tuple[int, int, object]]:
    """(field, wire type, value) of a protocol-buffer message."""
    at, n = 0, len(data)

    def varint() -> int:
        nonlocal at
        shift = value = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < n:
        key = varint()
        field, wire = key >> 3, key & 7
        if wire == 0:
            yield field, wire, varint()
        elif wire == 1:
            yield field, wire, data[at:at + 8]
            at += 8
        elif wire == 2:
            size = varint()
            yield field, wire, data[at:at + size]
            at += size
        elif wire == 5:
            yield field, wire, data[at:at + 4]
            at += 4
        else:
            raise ValueError("not a SentencePiece model")


class PieceModel:
    """Pieces, scores, kinds and settings of a model file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.pieces: list[str] = []
        scores, self.kinds = [], []
        self.kind = UNIGRAM
        # defaults of the format
        self.dummy_prefix = self.squeeze = self.escape = True
        table = b""
        for field, _, value in _fields(data):
            if field == 1:
                piece, score, kind = "", 0.0, NORMAL
                for f, _, v in _fields(value):
                    if f == 1:
                        piece = v.decode("utf-8")
                    elif f == 2:
                        score = float(np.frombuffer(v, "<f4")[0])
                    elif f == 3:
                        kind = v
                self.pieces.append(piece)
                scores.append(score)
                self.kinds.append(kind)
            elif field == 2:
                for f, _, v in _fields(value):
                    if f == 3:
                        self.kind = v
            elif field == 3:
                for f, _, v in _fields(value):
                    if f == 2:
                        table = v
                    elif f == 3:
                        self.dummy_prefix = bool(v)
                    elif f == 4:
                        self.squeeze = bool(v)
                    elif f == 5:
                        self.escape = bool(v)
        if table:
            raise ValueError("only models whose normaliser is the identity are read")
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are read")
        self.scores = np.array(scores)
        self.unknown = self.kinds.index(UNKNOWN)
        self.bytes = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        # pieces that decode to the same text wherever they stand (an ASCII byte is no part of a longer
        # character), and the others
        self.plain = [chr(int(p[1:-1], 16)) if k == BYTE and int(p[1:-1], 16) < 128 else "" if k == CONTROL else p
                      for p, k in zip(self.pieces, self.kinds, strict=True)]
        self.hard = np.array([k == UNKNOWN or k == BYTE and int(p[1:-1], 16) > 127 for p, k in zip(self.pieces, self.kinds, strict=True)])
        usable = [i for i, k in enumerate(self.kinds) if k in (NORMAL, USER_DEFINED)]
        self.ids = {self.pieces[i]: i for i in usable}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece crosses a word border")
        self.longest = max((len(p) for p in self.ids), default=1)
        h = np.array([self._hash(p) for p in self.ids], np.uint64)
        if len(np.unique(h)) != len(h):
            raise ValueError("two pieces share a hash")
        values, sizes = np.array(list(self.ids.values()), np.int64), np.array([len(p) for p in self.ids])
        order = np.argsort(h)
        h, values, sizes = h[order], values[order], sizes[order]
        # neighbouring characters in pieces, as sorted numbers
        self.pairs = np.unique(np.array([ord(a) << 21 | ord(b) for p in self.ids for a, b in zip(p, p[1:], strict=False)], np.int64))
        # the sorted keys and ids of the pieces of each length
        self.keys = {k: (h[sizes == k], values[sizes == k]) for k in np.unique(sizes).tolist()}

    def probe(self, hashes: np.ndarray, size: int) -> np.ndarray:
        """The piece of ``size`` characters with each hash, -1 if none."""
        if size not in self.keys:
            return np.full(len(hashes), -1, np.int64)
        keys, ids = self.keys[size]
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return np.where(keys[at] == hashes, ids[at], -1)

    def segments(self, word: str) -> list[str]:
        """The word cut where no piece can cross, so that its encoding is the segments' one after the other."""
        codes = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        pair = codes[:-1] << 21 | codes[1:]
        at = np.searchsorted(self.pairs, pair)
        known = self.pairs[np.minimum(at, len(self.pairs) - 1)] == pair if len(self.pairs) else np.zeros(len(pair), bool)
        ends = [*(np.flatnonzero(~known) + 1).tolist(), len(word)]
        return [word[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    @staticmethod
    def _hash(piece: str) -> np.uint64:
        h = np.uint64(0)
        with np.errstate(over="ignore"):
            for c in piece:
                h = h * _BASE + np.uint64(ord(c) + 1)
        return h

    def normalise(self, text: str | None) -> str:
        """The text as the pieces spell it."""
        t = text or ""
        if self.squeeze:
            t = re.sub(" +", " ", t.strip(" "))
        if not t:
            return ""
        if self.dummy_prefix:
            t = " " + t
        return t.replace(" ", SPACE) if self.escape else t


class PieceEncoder:
    """Encodes and decodes texts; the worker's words and pairs are kept (bounded caches)."""

    def __init__(self, path: str):
        self.model = PieceModel(path)
        self._pair_keys = np.full(PAIR_SLOTS, -1, np.int64)
        self._pair_ok = np.zeros(PAIR_SLOTS, bool)
        self._clear()

    def _clear(self) -> None:
        self._place: dict[str, int] = {}
        self._flat, self._starts, self._lengths = array("i"), array("q"), array("q")

    # ---- encoding

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        cut = [self._words(self.model.normalise(t)) for t in texts]
        wanted = {w for words in cut for w in words}
        if len(self._place) + len(wanted.difference(self._place)) > MAX_CACHED_WORDS:
            self._clear()
        self._learn(list(wanted.difference(self._place)))
        flat, starts, lengths = (np.array(x, dtype=kind) for x, kind in
                                 ((self._flat, np.int32), (self._starts, np.int64), (self._lengths, np.int64)))
        out = []
        for words in cut:
            k = np.fromiter(map(self._place.__getitem__, words), np.int64, len(words))
            n = lengths[k]
            ends = np.cumsum(n)
            out.append(flat[np.repeat(starts[k] - ends + n, n) + np.arange(ends[-1] if len(k) else 0)])
        return out

    def _words(self, text: str) -> list[str]:
        words = _WORDS.findall(text)
        if any(len(w) > LONG_WORD for w in words):
            words = [s for w in words for s in (self.model.segments(w) if len(w) > LONG_WORD else (w,))]
        return words

    def _learn(self, words: list[str]) -> None:
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        for n, group in by_length.items():
            step = max(1, 2_000_000 // n)
            for s in range(0, len(group), step):
                part = group[s:s + step]
                ids, counts = self.viterbi(part, n)
                base, at = len(self._starts), len(self._flat)
                self._place.update(zip(part, range(base, base + len(part)), strict=True))
                self._starts.frombytes((at + np.cumsum(counts) - counts).astype(np.int64).tobytes())
                self._lengths.frombytes(counts.astype(np.int64).tobytes())
                self._flat.frombytes(ids.astype(np.int32).tobytes())

    def viterbi(self, words: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that all have ``n`` characters, one word after the other, and the number of each word's ids."""
        m = self.model
        count = len(words)
        # position first, so that a step reads and writes whole rows of memory
        chars = np.ascontiguousarray(np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(count, n).T)
        prefix = np.zeros((n + 1, count), np.uint64)
        power = np.ones(n + 1, np.uint64)
        for k in range(n):  # wraps round at 2^64
            prefix[k + 1] = prefix[k] * _BASE + chars[k] + np.uint64(1)
            power[k + 1:k + 2] = power[k:k + 1] * _BASE
        back = np.zeros((n + 1, count), np.int32)          # start of the last piece
        last = np.full((n + 1, count), -1, np.int64)       # the last piece, -1 none
        best = np.full((n + 1, count), -np.inf) if m.kind == UNIGRAM else None
        if best is not None:
            best[0] = 0
        lowest = float(m.scores.min()) - 10
        for end in range(1, n + 1):
            rows = None  # words whose last piece is still open; None: all
            for size in range(min(m.longest, end), 0, -1):
                if size not in m.keys and size > 1:
                    continue
                start = end - size
                if best is not None:
                    piece = m.probe(prefix[end] - prefix[start] * power[size], size)
                    rank = best[start] + np.where(piece >= 0, m.scores[piece], lowest if size == 1 else -np.inf)
                    better = np.flatnonzero(rank > best[end])
                    best[end, better], back[end, better] = rank[better], start
                    last[end, better] = np.where(piece[better] < 0, m.unknown, piece[better])
                    continue
                a, b = (prefix[end], prefix[start]) if rows is None else (prefix[end][rows], prefix[start][rows])
                piece = m.probe(a - b * power[size], size)
                fits = np.flatnonzero(piece >= 0)
                at = fits if rows is None else rows[fits]
                ok = self._follow(last[start][at], piece[fits])  # rank 1; the other candidates are -inf
                back[end, at[ok]], last[end, at[ok]] = start, piece[fits[ok]]
                if size == 1:  # a character that is no piece is unknown (its bytes, in the output)
                    lone = np.flatnonzero(piece < 0)
                    lone = lone if rows is None else rows[lone]
                    back[end, lone], last[end, lone] = start, m.unknown
                done = np.zeros(len(piece), bool)
                done[fits[ok]] = True
                rows = np.flatnonzero(~done) if rows is None else rows[~done]
                if not len(rows):
                    break
        # back to the start, all words at once
        steps, at = [], np.full(count, n)
        live = np.arange(count)
        while len(live):
            start = back[at[live], live]
            steps.append((live, start, last[at[live], live]))
            at[live] = start
            live = live[start > 0]
        row, start, piece = (np.concatenate(x) for x in zip(*steps, strict=True))
        order = np.lexsort((start, row))
        row, start, piece = row[order], start[order], piece[order]
        if m.bytes and (lone := np.flatnonzero(piece == m.unknown)).size:
            code = chars[start[lone], row[lone]]
            size = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
            times = np.ones(len(piece), np.int64)
            times[lone] = size
            first = np.cumsum(times) - times
            row, piece = np.repeat(row, times), np.repeat(piece, times)
            for k, c in zip(first[lone].tolist(), code.tolist(), strict=True):
                for d, byte in enumerate(chr(c).encode("utf-8", "surrogatepass")):
                    piece[k + d] = m.bytes[byte]
        return piece, np.bincount(row, minlength=count)

    def _follow(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether ``right`` may stand after ``left`` in a BPE encoding; -1 and unknown go with all. A first
        piece must be the encoding of its own text."""
        m = self.model
        size = len(m.pieces)
        key = (left + 1) * size + right
        slot = ((key.astype(np.uint64) * _BASE) >> np.uint64(64 - 21)).astype(np.int64)
        ok = self._pair_ok[slot]
        unseen = np.flatnonzero(self._pair_keys[slot] != key)
        if len(unseen):
            new, inverse = np.unique(key[unseen], return_inverse=True)
            fits = np.empty(len(new), bool)
            for i, k in enumerate(new.tolist()):
                a, b = k // size - 1, k % size
                pair = [b] if a < 0 or a == m.unknown else [a, b]
                fits[i] = self._merge("".join(m.pieces[p] for p in pair)) == pair
            ok[unseen] = fits[inverse]
            at = ((new.astype(np.uint64) * _BASE) >> np.uint64(64 - 21)).astype(np.int64)
            self._pair_keys[at] = new
            # of two new pairs with one slot the last one written stands in both arrays
            self._pair_ok[at] = fits
        return ok

    def _merge(self, text: str) -> list[int]:
        """BPE by its definition: the best-scored neighbouring pair merges first, the leftmost of equals."""
        m = self.model
        parts = list(text)
        while len(parts) > 1:
            best, where = -np.inf, -1
            for i in range(len(parts) - 1):
                p = m.ids.get(parts[i] + parts[i + 1])
                if p is not None and m.scores[p] > best:
                    best, where = m.scores[p], i
            if where < 0:
                break
            parts[where:where + 2] = [parts[where] + parts[where + 1]]
        return [m.ids.get(p, m.unknown) for p in parts]

    # ---- decoding

    def decode(self, ids: np.ndarray | list[int]) -> str:
        m = self.model
        out: list[str] = []
        held = bytearray()

        def flush() -> None:
            # a byte that is part of no character becomes one U+FFFD
            at = 0
            while at < len(held):
                for size in (1, 2, 3, 4):
                    try:
                        out.append(bytes(held[at:at + size]).decode("utf-8"))
                        at += size
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    at += 1
            held.clear()

        ids = np.asarray(ids, np.int64)
        if not m.hard[ids].any():
            return self._spaces("".join(map(m.plain.__getitem__, ids.tolist())))
        values = {i: b for b, i in m.bytes.items()}
        for i in ids.tolist():
            kind = m.kinds[i]
            if kind == BYTE:
                held.append(values[i])
                continue
            flush()
            if kind == UNKNOWN:
                out.append(" ⁇ ")
            elif kind != CONTROL:
                out.append(m.pieces[i])
        flush()
        return self._spaces("".join(out))

    def _spaces(self, text: str) -> str:
        if self.model.escape:
            text = text.replace(SPACE, " ")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


@lru_cache(maxsize=2)
def worker_encoder(path: str) -> PieceEncoder:
    """The worker's encoder of a model file: its caches last over tasks, and are bounded."""
    return PieceEncoder(path)


def encode_documents(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, round_trip): the ids of every text, and whether they decode to the text as the model normalises it."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        enc = worker_encoder(model_file)
        plain = lambda t: enc.model.normalise(t).replace(SPACE, " ")[int(enc.model.dummy_prefix):]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to] or "") <= SLICE_CHARS):
                    size += len(texts[to] or "")
                    to += 1
                part = texts[at:to]
                ids = enc.encode(part)
                same = [enc.decode(x) == plain(t) for x, t in zip(ids, part, strict=True)]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                values = np.concatenate(ids) if ids else np.empty(0, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, to - at), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32())),
                     pa.array(same)], names=["doc_id", "ids", "round_trip"])
                at = to

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, ids array<int>, round_trip boolean")


def decode_documents(encoded: DataFrame, model_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) from the ids; null ids give an empty text."""
    src = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        enc = worker_encoder(model_file)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([enc.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())],
                                             names=["doc_id", "text"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, text string")
