"""Secret scan, Merkle manifest and lexical search against brute force, SQL and their defined cases."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parallax.llm import lexical_search as S
from parallax.llm import merkle as M
from parallax.llm import secret_scan as X
from parallax.llm.queries import ORACLES, QUERIES

BODY = "abcdefghijklmnopqrstuvwxyz0123"
TOKEN = BODY + X.base62_crc(BODY)


def age_key(seed=0):
    data = [(7 * i + seed) % 32 for i in range(52)]
    rest = X.bech32_state(X.AGE_PREFIX, data + [0] * 6) ^ 1
    return (X.AGE_PREFIX + "1" + "".join(X.BECH32[v] for v in data + [rest >> 5 * (5 - i) & 31 for i in range(6)])).upper()


def test_queries_equal_their_sql(spark):
    for name in ("op11_secret_scan", "op12_merkle", "op13_lexical_search"):
        con = duckdb.connect()
        for t in ("documents", "benchmark"):
            con.sql(f"CREATE VIEW {t} AS FROM '/root/testdata/sf0.001/{t}.parquet'")
        got = QUERIES[name](spark, "/root/testdata/sf0.001")
        want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({ORACLES[name]})").fetchall()
        assert sorted(map(tuple, got.collect())) == sorted(want) and want, name


# secrets

def brute_spans(text):
    found = []
    for rank, kind in enumerate(X.KINDS):
        for m in re.finditer(X.EXPRESSIONS[kind].decode(), text or "", re.A):
            if X.HOLDS[kind](re.match(X.EXPRESSIONS[kind], m.group().encode())):
                found.append((m.start(), rank, kind, m.end()))
    return [(k, a, b) for a, _, k, b in sorted(found)]


HARD = [
    None, "", "ghp_" + TOKEN, "é ghu_" + TOKEN + " ü npm_" + TOKEN + " " + age_key(), "ghp_" + BODY + "000000", "ghp_" + TOKEN + "a", "npm_" + TOKEN[:-1],
    age_key()[:-1] + ("Q" if age_key()[-1] != "Q" else "P"), age_key(3).lower(), 'Password = "é', "API_KEY : 'abcdefgh1 token=secret=abc secret=short",
    "secret token=abcdefgh password   =   12345678", "AKIAAKIAAKIAAKIAZ akiaakiaakiaakia1", "paſſword=abcdefghij toKen=abcdefghij",
    "é" * 7 + "0123456789abcdef" * 2 + "g" + "f" * 31 + "z" + "a" * 33, "x" * 9 + "abcdef" * 9 + "-" + "0" * 32 + "\n" + "1" * 32, "password" + " " * 5000 + "=abcdefgh",
]


def test_secret_spans_equal_a_search_of_the_whole_text():
    for t in HARD:
        assert X.scan_text(t) == brute_spans(t)
    assert [k for k, _, _ in X.scan_text(HARD[3])] == ["github", "npm", "age"]
    assert X.scan_text(HARD[4]) == X.scan_text(HARD[5]) == X.scan_text(HARD[6]) == X.scan_text(HARD[7]) == []


PIECES = ["password", "token", "=", ":", " ", '"', "AKIA", "A1", "0123456789abcdef", "deadbeef", "g", "é", "\n", "abcdefgh", "ghp_" + TOKEN, "npm_", TOKEN, "secret", "z", "api_key"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14))
def test_secret_spans_of_random_texts(parts):
    t = "".join(parts)
    assert X.scan_text(t) == brute_spans(t)


def test_secret_rows_and_sql(spark, make_docs):
    rows = [*enumerate(HARD), (None, HARD[2]), (2, HARD[2]), (99, "pad " * 200_000 + HARD[3])]
    docs = make_docs(rows, extra=True)
    found = X.find_secrets(docs)
    assert found.columns == ["doc_id", "secrets"]
    got = X.secret_digests(found)
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas().astype({"text": object}).where(lambda d: d.notna(), None))
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({X.ORACLE})").fetchall()
    key = lambda r: (r[0] is None, r[0] or 0, r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    for r in found.collect():
        if r["doc_id"] is not None:
            assert [tuple(s) for s in r["secrets"]] == brute_spans(dict(rows)[r["doc_id"]])
    assert X.secret_digests(X.find_secrets(make_docs([]))).collect() == []


def test_secrets_masked(spark, make_docs):
    docs = make_docs([(1, "a " + HARD[2] + " b"), (2, None), (3, 'token = "' + "0123456789abcdef" * 3 + '"')], extra=True)
    out = X.mask_secrets(docs)
    assert out.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: "a [github] b", 2: None, 3: '[assign]"'}


# manifest

def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(r, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))


def brute_tree(leaves):
    """The root, and for each leaf its siblings as (left, right) by level."""
    ways, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for k, p in enumerate(at):
            run = p // 3 * 3
            ways[k].append((level[run:p], level[p + 1:run + 3]))
        level, at = [h(*level[i:i + 3]) for i in range(0, len(level), 3)], [p // 3 for p in at]
    return level[0], ways


def brute_manifest(rows):
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in names:
        own = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, brute_leaf(r, r["text"]), r) for r in by[s]), key=lambda x: x[:3])
        trees.append((own, *brute_tree([x[2] for x in own])))
    root, over = brute_tree([t[1] for t in trees])
    out = []
    for (own, subroot, ways), above in zip(trees, over, strict=True):
        for (_, _, leaf, r), way in zip(own, ways, strict=True):
            text = r["text"]
            if r["doc_id"] is not None and text is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            node = brute_leaf(r, text)
            for left, right in way + above:
                node = h(*left, node, *right)
            out.append((r["doc_id"], leaf, subroot, root, h(*(x for left, right in way + above for x in left + right)), node, node == root))
    return out


def manifest_rows(spark, docs):
    text = F.col("text")
    cut = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)
    out = M.verify(M.prove(spark, M.build_manifest(docs, cut)))
    return [tuple(r) for r in out.select("doc_id", "leaf", "subroot", "root", M.proof_hash(F.col("proof")), "folded_root", "verified").collect()]


@pytest.mark.parametrize("band", [1, 2, 4])
def test_manifest_equals_brute_force(spark, monkeypatch, band):
    monkeypatch.setattr(M, "BAND", band)
    rng = random.Random(band)
    sizes = {"hot": 100, None: 4, "": 1, "=x": 2, "ä": 9, "z": 28, "a": 3, "-": 10}
    rows = [(i, f"line {rng.random()}\nend" if i % 7 else None, rng.choice(["en", None]), s, rng.choice([None, i]))
            for i, s in enumerate([s for s, n in sizes.items() for _ in range(n)])]
    rows += [(None, "no id", "en", "hot", 1), (5, "a second text", "en", "hot", 1), rows[7], rows[7], (10 ** 12, "", "en", "z", 0), (-3, "x" * 300_000, "", "z", 0)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    for c in ("_tree", "_at", "_n", "_row", "_part", "node", "tampered", "leaf", "proof"):
        docs = docs.withColumn(c, F.lit(c))
    want = brute_manifest([r.asDict() for r in docs.collect()])
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(manifest_rows(spark, docs), key=key) == sorted(want, key=key)
    assert 0 < sum(r[-1] for r in want) < len(want)


def test_manifest_of_few_rows(spark, make_docs):
    assert manifest_rows(spark, make_docs([])) == []
    one = manifest_rows(spark, make_docs([(4, "a\nb")]))
    assert one == brute_manifest([{"doc_id": 4, "text": "a\nb", "lang": "en", "source": "s", "n_chars": 3}])
    assert one[0][1] == one[0][2] == one[0][3] and one[0][4] == hashlib.sha256(b"").hexdigest()


def test_interior_levels_are_not_written(spark, make_docs):
    m = M.build_manifest(make_docs([(i, str(i)) for i in range(3 ** 4 + 1)]))
    assert len(m.levels) == 2 and [spark.read.parquet(p).count() for p in m.levels] == [2, 1]


# search

def words(t):
    return re.findall(S.TERM, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute_rank(docs, items, top=S.TOP):
    counted = [(i, words(t)) for i, t in docs]
    n_docs, length = sum(1 for _, w in counted if w), sum(len(w) for _, w in counted)
    out = []
    merged = {}
    for i, t in items:
        merged[i] = merged.get(i, []) + words(t)
    for i, terms in merged.items():
        scores = []
        for d, w in counted:
            score = 0
            for t in terms:
                if t in w:
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in x for _, x in counted) + 1)))
                    tf = w.count(t)
                    score += weight * (1_000_000_000 * tf // (1000 * tf + 12 * (75 + 25 * len(w) * n_docs // length)))
            if score > 0:
                scores.append((-score, d is not None, d or 0, d))
        out += [(i, k + 1, d, -s) for k, (s, _, _, d) in enumerate(sorted(scores)[:top])]
    return out


SHORT = ["the", "The", "cat", "naïve", "NAÏVE", "a1", "don't", "東京", "東", "x_y", "catalog", "İ", "é"]


@pytest.mark.parametrize("block", [2, 1000])
def test_search_equals_brute_force(spark, make_docs, block):
    rng = random.Random(block)
    text = lambda n: rng.choice([" ", "\n", ", "]).join(rng.choice(SHORT) for _ in range(n))
    docs = [(i, text(rng.randrange(0, 12))) for i in range(70)] + [(None, "the cat"), (500, None), (501, ""), (502, "..."), (7, "cat cat"), (7, "cat cat"), (600, "cat " * 400_000 + "x" * 3_000_000)]
    docs += [(700 + i, "catalog 東京") for i in range(30)]  # ties
    items = [(i, text(rng.randrange(0, 6))) for i in range(9)] + [(9, None), (10, "nowhere"), (11, "cat"), (11, "the the"), (None, "catalog")]
    schema = "item_id long, text string, doc_id string, score string, rank string, term string"
    table = spark.createDataFrame([(i, t, "d", "s", "r", "t") for i, t in items], schema)
    got = S.rank_documents(make_docs(docs, extra=True).repartition(7), table, block_pairs=block)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute_rank(docs, items), key=key)


def test_search_of_empty_tables(spark, make_docs):
    empty = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "cat")], "item_id long, text string")
    assert S.rank_documents(make_docs([(1, "cat")]), empty).collect() == []
    assert S.rank_documents(make_docs([]), some).collect() == []
    assert S.rank_documents(make_docs([(1, None), (2, "")]), some).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*SHORT, "!", "  ", "catcat"]), max_size=9).map(" ".join), max_size=5), st.integers(1, 40))
def test_slices_change_no_count(texts, size):
    terms = ["cat", "the", "東", "naïve", "a1"]
    doc, term, tf, total = S.term_counts([t.encode() for t in texts], S.build_automaton(terms), len(terms), size)
    assert total.tolist() == [len(words(t)) for t in texts]
    got = dict(zip(zip(doc.tolist(), term.tolist(), strict=True), tf.tolist(), strict=True))
    assert got == {(d, k): n for d, t in enumerate(texts) for k, w in enumerate(terms) if (n := words(t).count(w))}
