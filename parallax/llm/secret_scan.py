"""Secret scan: a keyword automaton, anchored expressions near its hits, then embedded checksums.

1. One Aho-Corasick automaton of all kinds' keywords runs over the text (its
   UTF-8 bytes, A-Z lower-cased). Hex runs have no keyword: a run of 32 digits
   covers four of every eighth byte, so only places where four such bytes in a
   row are hex digits are hits.
2. Where a keyword hits, its kind's expression is matched from that very byte
   on and nowhere else. Per kind the matches are the leftmost ones that do not
   overlap, as if the expression had searched the whole text.
3. Kinds whose secrets carry a checksum keep a match only if it holds: CRC-32
   in base 62 (``github``, ``npm``) and Bech32 (``age``). The kinds without one
   (``assign``, ``access``, ``hex``) are tested by length alone.

The scan is a map over the rows: nothing is shuffled, and a lost executor
repeats its tasks.

Defined cases: a null text counts as empty, and neither has spans; every input
row gives one output row, repeated rows and null ids too; an empty table gives
no rows; very long texts are scanned whole; spans of different kinds may
overlap; further columns are left alone (``mask_secrets``) or not carried
(``find_secrets``). Positions are code points, the end exclusive.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The kinds in order, their keywords (lower case), expressions and least lengths.
BASE_KINDS = ["assign", "access", "hex"]
CHECKED_KINDS = ["github", "npm", "age"]
KINDS = BASE_KINDS + CHECKED_KINDS
KEYWORDS = {
    "assign": ["password", "passwd", "secret", "token", "api_key", "apikey"],
    "access": ["akia"],
    "github": ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"],
    "npm": ["npm_"],
    "age": ["age-secret-key-1"],
}
EXPRESSIONS = {
    "assign": rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": rb"AKIA[A-Z0-9]+",
    "hex": rb"[0-9a-f]+",
    "github": rb"gh[pousr]_([0-9A-Za-z]+)",
    "npm": rb"npm_([0-9A-Za-z]+)",
    "age": rb"AGE-SECRET-KEY-1([0-9A-Z]+)",
}
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 8, 16, 32  # characters
TOKEN_BODY, TOKEN_CHECK = 30, 6                   # characters of a token's random part and of its CRC-32
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
BECH32_GENERATOR = [0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3]
AGE_PREFIX, AGE_LENGTH = "age-secret-key-", 58    # characters after the separator 1

_STRIDE = 8  # of the hex probe: LEAST_HEX digits cover four such places
_HEX_DIGITS = b"0123456789abcdef"
_IS_HEX = bytes(120 if bytes([i]) in _HEX_DIGITS else 46 for i in range(256))
_SECRET = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def base62_crc(body: str) -> str:
    """The CRC-32 of a token's random part, in six digits of base 62."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(TOKEN_CHECK):
        n, d = divmod(n, 62)
        out = BASE62[d] + out
    return out


def bech32_state(prefix: str, values: list[int]) -> int:
    """The checksum state after a prefix and its data values; 1 if they end in their checksum."""
    state = 1
    for v in [ord(c) >> 5 for c in prefix] + [0] + [ord(c) & 31 for c in prefix] + values:
        top = state >> 25
        state = (state & 0x1FFFFFF) << 5 ^ v
        for i, g in enumerate(BECH32_GENERATOR):
            if top >> i & 1:
                state ^= g
    return state


def _token_holds(m: re.Match) -> bool:
    body = m.group(1).decode()
    return len(body) == TOKEN_BODY + TOKEN_CHECK and base62_crc(body[:TOKEN_BODY]) == body[TOKEN_BODY:]


def _age_holds(m: re.Match) -> bool:
    data = m.group(1).decode().lower()
    return len(data) == AGE_LENGTH and not set(data) - set(BECH32) and bech32_state(AGE_PREFIX, [BECH32.index(c) for c in data]) == 1


HOLDS = {
    "assign": lambda m: len(m.group(1)) >= LEAST_VALUE,
    "access": lambda m: len(m.group()) >= LEAST_ACCESS,
    "hex": lambda m: len(m.group()) >= LEAST_HEX,
    "github": _token_holds,
    "npm": _token_holds,
    "age": _age_holds,
}


@lru_cache(1)
def _machine():
    """The keyword automaton (values: kind, keyword length) and the compiled expressions, once a worker."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for w in words:
            automaton.add_word(w, (kind, len(w)))
    automaton.make_automaton()
    return automaton, {k: re.compile(x) for k, x in EXPRESSIONS.items()}


def _hex_spans(data: bytes, expression: re.Pattern) -> Iterator[tuple[int, int]]:
    probe = data[::_STRIDE].translate(_IS_HEX)
    need = b"x" * (LEAST_HEX // _STRIDE)
    k = probe.find(need)
    while k >= 0:
        at = k * _STRIDE
        before = data[max(0, at - _STRIDE):at]  # the run starts after the probe's last place that is no digit, or here
        m = expression.match(data, at - (len(before) - len(before.rstrip(_HEX_DIGITS))))
        if HOLDS["hex"](m):
            yield m.span()
        k = probe.find(need, max(k + 1, -(-m.end() // _STRIDE)))


def scan_bytes(data: bytes) -> list[tuple[int, str, int]]:
    """(start, kind, end) in bytes, by start, then kind in order."""
    automaton, expressions = _machine()
    found = [(a, "hex", b) for a, b in _hex_spans(data, expressions["hex"])]
    over: dict[str, int] = {}  # kind -> end of its last match, whether it held or not
    for last, (kind, n) in automaton.iter(data.lower().decode("latin-1")):
        start = last + 1 - n
        if start >= over.get(kind, 0) and (m := expressions[kind].match(data, start)):
            over[kind] = m.end()
            if HOLDS[kind](m):
                found.append((start, kind, m.end()))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[1])))


def scan_text(text: str | bytes | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of a text's secrets, in code points, by start, then kind in order."""
    data = text.encode() if isinstance(text, str) else text or b""
    spans = scan_bytes(data)
    if not spans or data.isascii():
        return [(k, a, b) for a, k, b in spans]
    places, points, at = sorted({x for a, _, b in spans for x in (a, b)}), {}, (0, 0)
    for p in places:  # spans are ASCII, so every border is one between characters
        at = (p, at[1] + len(data[at[0]:p].decode()))
        points[p] = at[1]
    return [(k, points[a], points[b]) for a, k, b in spans]


def _as_bytes(column) -> Iterator[bytes]:
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return (v.as_py() or b"" for v in column.cast(kind))


def _scan_batches(batches: Iterator) -> Iterator:
    """For ``mapInArrow``: the text (last column) becomes its secrets, the other columns pass as they are."""
    import pyarrow as pa

    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        rows = [[{"kind": k, "start": a, "end": b} for k, a, b in scan_text(x)] for x in _as_bytes(batch.column(batch.num_columns - 1))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, kind)], names=[*batch.schema.names[:-1], "secrets"])


def _masked(data: bytes) -> str:
    out, at = [], 0
    for a, k, b in scan_bytes(data):
        if b > at:  # of spans that overlap, the first names the mask, and the rest of the next gets its own
            out += [data[at:max(a, at)], f"[{k}]".encode()]
            at = b
    return b"".join([*out, data[at:]]).decode()


def _mask_batches(batches: Iterator, at: int) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        column = batch.column(at)
        texts = [None if null else _masked(x) for x, null in zip(_as_bytes(column), column.is_null().to_pylist(), strict=True)]
        columns = list(batch.columns)
        columns[at] = pa.array(texts, column.type)
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, secrets array<struct<kind, start, end>> by start, then kind in order."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([src.schema["doc_id"], T.StructField("secrets", T.ArrayType(_SECRET))])
    return src.mapInArrow(_scan_batches, schema)


def mask_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The input rows, all columns kept, with each secret in the text replaced by its kind in square brackets; null texts stay null."""
    return docs.mapInArrow(partial(_mask_batches, at=docs.columns.index(text_col)), docs.schema)


def spans_text(secrets: Column) -> Column:
    """``kind:start:end``, comma-joined; the empty string if there are none."""
    return F.array_join(F.transform(secrets, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_digests(found: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, SHA-256 of their spans, and all spans, of ``find_secrets`` rows."""
    s = F.col("secrets")
    count = lambda kind: F.size(F.filter(s, lambda x: x["kind"] == kind)).cast("long")
    base = F.filter(s, lambda x: x["kind"].isin(BASE_KINDS))
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in BASE_KINDS),
                        F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(s).alias("spans"))


def _sql_list(expression: str, group: int, kind: str, rank: int, holds: str) -> str:
    """Spans of one kind in DuckDB: matches and the gaps between them, in order, give the places."""
    return f"""
SELECT row_no, '{kind}' AS kind, {rank} AS rank, start, start + length(whole) AS stop FROM (
  SELECT row_no, whole, value, (sum(length(gap) + length(whole)) OVER w - length(whole))::BIGINT AS start FROM (
    SELECT row_no, unnest(string_split_regex(body, '{expression}')) AS gap,
           unnest(regexp_extract_all(body, '{expression}') || ['']) AS whole,
           unnest(regexp_extract_all(body, '{expression}', {group}) || ['']) AS value,
           unnest(range(len(regexp_extract_all(body, '{expression}')) + 1)) AS k
    FROM d WHERE regexp_matches(body, '{expression}'))
  WINDOW w AS (PARTITION BY row_no ORDER BY k))
WHERE whole <> '' AND ({holds})"""


def _either_case(pattern: str) -> str:
    return re.sub(r"[a-z]", lambda m: f"[{m.group().upper()}{m.group()}]", pattern)


_ASSIGN_SQL = _either_case("(?:password|passwd|secret|token|api_?key)") + r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_CRC_SQL = """list_reduce(list_prepend(4294967295, list_transform(string_split(value[:30], ''), lambda c: ascii(c)::BIGINT)),
  lambda s, b: xor(s >> 8, crc.list_value[(xor(s, b) & 255) + 1]))"""
_TOKEN_SQL = f"""len(value) = 36 AND value[31:] = (SELECT string_agg(('{BASE62}')[(xor({_CRC_SQL}, 4294967295) // p.place) % 62 + 1], '' ORDER BY p.place DESC)
  FROM crc, (SELECT (62 ** e)::BIGINT AS place FROM range(6) x(e)) p)"""
_AGE_HEAD = [ord(c) >> 5 for c in AGE_PREFIX] + [0] + [ord(c) & 31 for c in AGE_PREFIX]
_AGE_STEP = "xor(((s & 33554431) << 5), v)"
for _i, _g in enumerate(BECH32_GENERATOR):
    _AGE_STEP = f"xor({_AGE_STEP}, ((s >> {25 + _i}) & 1) * {_g})"
_AGE_SQL = f"""len(value) = 58 AND regexp_full_match(value, '[{BECH32.upper()}]+') AND
  list_reduce([1::BIGINT] || {_AGE_HEAD}::BIGINT[] || list_transform(string_split(lower(value), ''), lambda c: (strpos('{BECH32}', c) - 1)::BIGINT),
              lambda s, v: {_AGE_STEP}) = 1"""

ORACLE = f"""
WITH RECURSIVE steps(i, k, v) AS (
  SELECT range::BIGINT, 0, range::BIGINT FROM range(256)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM steps WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS list_value FROM steps WHERE k = 8),
d AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS body FROM documents),
s AS (
  {" UNION ALL ".join(_sql_list(*x) for x in [
      (_ASSIGN_SQL, 1, "assign", 0, f"length(value) >= {LEAST_VALUE}"),
      ("AKIA[A-Z0-9]+", 0, "access", 1, f"length(whole) >= {LEAST_ACCESS}"),
      ("[0-9a-f]+", 0, "hex", 2, f"length(whole) >= {LEAST_HEX}"),
      ("gh[pousr]_([0-9A-Za-z]+)", 1, "github", 3, _TOKEN_SQL),
      ("npm_([0-9A-Za-z]+)", 1, "npm", 4, _TOKEN_SQL),
      ("AGE-SECRET-KEY-1([0-9A-Z]+)", 1, "age", 5, _AGE_SQL)])}),
g AS (
  SELECT row_no, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (WHERE rank < 3) AS base,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans
  FROM s GROUP BY row_no)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (row_no)
"""
