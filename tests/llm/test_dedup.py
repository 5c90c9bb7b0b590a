"""Exact dedup, line dedup, n-gram join and embedding dedup against brute force and SQL on small fixtures."""

import hashlib
import random
import re
import string
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from parallax.llm import embedding_dedup as E
from parallax.llm import exact_dedup as X
from parallax.llm import line_dedup as L
from parallax.llm import ngram_join as J
from parallax.llm import components as K
from parallax.llm.components import connected_components, forest
from parallax.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def oracle(sql, **tables):
    con = duckdb.connect()
    for name, pdf in tables.items():
        con.register(name, pdf)
    return con.sql(sql).df()


# ---- components

def test_forest_spans_components():
    i, j = np.array([4, 1, 7, 2]), np.array([3, 0, 3, 1])
    got = forest(8, i, j)
    assert sorted(got) == [(1, 0), (2, 0), (4, 3), (7, 3)]
    assert forest(3, np.empty(0, int), np.empty(0, int)) == []


def test_connected_components_of_a_path_a_star_and_a_cycle(spark):
    path = [(k, k + 1) for k in range(100, 116)]
    random.Random(1).shuffle(path)
    edges = path + [(1, k) for k in range(2, 30)] + [(50, 51), (51, 52), (52, 50), (60, 60)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(got[k] == 100 for k in range(100, 117))
    assert all(got[k] == 1 for k in range(1, 30))
    assert got[50] == got[51] == got[52] == 50
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("most", [1 << 20, 2])
def test_sieve_loses_no_member_at_any_size(spark, monkeypatch, most):
    monkeypatch.setattr(K, "MAX_SIEVE_WORDS", most)
    rows = spark.range(20000).select(F.when(F.col("id") > 5, F.col("id")).alias("id"))
    ids = spark.range(0, 20000, 40).select(F.when(F.col("id") > 0, F.col("id")).alias("i"))
    got = {r.id for r in K.sieve(rows, "id", ids, "i").collect()}
    assert {r.i for r in ids.collect()} <= got
    assert most == 2 or len(got) < 2500  # few others; a sieve that is too small lets more through
    assert K.mark_possible(rows, "id", ids.limit(0), "i").filter("_maybe").count() == 0


# ---- exact dedup

def brute_exact(rows):
    norm = {k: (t or "").translate(LOWER) for k, (_, t) in enumerate(rows)}
    size = Counter(norm.values())
    top = {}
    for k, (i, _) in enumerate(rows):
        a = top.get(norm[k])
        top[norm[k]] = i if a is None else a if i is None else max(a, i)
    return sorted(((i, top[norm[k]], size[norm[k]], i == top[norm[k]], hashlib.sha256(norm[k].encode()).hexdigest())
                   for k, (i, _) in enumerate(rows)), key=repr)


EXACT = [(1, "Abc"), (5, "aBC"), (3, None), (4, ""), (9, "É x"), (8, "é x"), (7, "É X"), (11, "z" * 200_000), (12, "Z" * 200_000),
         (2, "abc "), (5, "abc"), (None, "solo"), (None, None)]


@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups_equal_brute_force_even_when_hashes_collide(make_docs, weak):
    fn = (lambda sha: F.lit("x")) if weak else X.content_hash
    assert rows_of(X.exact_groups(make_docs(EXACT, extra=True), hash_fn=fn)) == brute_exact(EXACT)


def test_exact_dedup_of_an_empty_table_and_kept_rows(make_docs):
    assert X.exact_groups(make_docs([])).count() == 0
    kept = X.exact_dedup(make_docs(EXACT))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [2, 4, 5, 5, 8, 9, 12]


def test_exact_query_equals_its_sql(spark):
    got = QUERIES["op4_exact_dedup"](spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)
    want = oracle(ORACLES["op4_exact_dedup"], documents=pd.read_parquet(f"{SF}/documents.parquet"))
    pd.testing.assert_frame_equal(got, want[got.columns].sort_values("doc_id").reset_index(drop=True), check_dtype=False)


def test_exact_main_path_is_native(make_docs):
    plan = X.exact_groups(make_docs(EXACT))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---- line dedup

def line_docs():
    prose = [" ".join(chr(97 + k) + w for w in ("one", "two", "three", "four")) for k in range(12)]
    footer = "all rights are reserved by us"
    return [(k, f"{prose[k]}\norder {1000 + k} was sent to user{k}\n\nshort\n{footer}") for k in range(12)]


def test_recurring_templates_go_and_one_document_keeps_them(make_docs):
    rows = line_docs() + [(50, None), (51, ""), (52, "w " * 30_000), (3, line_docs()[3][1])]
    got = {r.doc_id: r for r in L.drop_recurring_lines(make_docs(rows, extra=True)).collect()}
    assert got[0].text == rows[0][1] and got[0]._n_dropped == 0
    for k in range(1, 12):
        assert got[k].text == f"{rows[k][1].split(chr(10))[0]}\n\nshort"
        assert (got[k]._n_lines, got[k]._n_dropped) == (5, 2)
    assert got[50].text == "" and got[50]._n_lines == 0
    assert got[51].text == "" and got[52].text == "w " * 30_000
    assert got[3].rep == "rep"


def test_few_documents_or_few_constant_words_are_no_template(make_docs):
    rows = [(k, "these four words recur\nab cd ef " + " ".join(f"{chr(97 + k)}{chr(97 + j)}x" for j in range(9))) for k in range(L.MIN_DOCS)]
    few = L.drop_recurring_lines(make_docs(rows[:-1]))
    assert few.filter("_n_dropped > 0").count() == 0
    enough = L.drop_recurring_lines(make_docs(rows))
    assert enough.filter("_n_dropped > 0").count() == L.MIN_DOCS - 1
    assert all("ab cd ef" in r.text for r in enough.collect())
    assert L.drop_recurring_lines(make_docs([])).count() == 0


@pytest.mark.parametrize("n", [60, 600])
def test_a_field_of_letters_is_variable_at_any_size(make_docs, n):
    word = lambda k: "".join(chr(97 + k // 26 ** j % 26) for j in range(3))
    rows = [(k, f"this page was written by {word(k % 60)} from {word(k // 60)}") for k in range(n)]
    got = L.drop_recurring_lines(make_docs(rows))
    assert got.filter("_n_dropped = 1 and text = ''").count() == n - 1
    assert got.filter("_n_dropped = 0").first().text == rows[0][1]
    assert L.line_templates(make_docs(rows)).filter(f"n_docs = {n}").count() == n


def test_a_rare_template_in_a_large_leaf_recurs_too(make_docs):
    rows = [(k, f"this page was {'seen by all of us' if k % 50 else 'last changed on that day'}") for k in range(500)]
    got = L.drop_recurring_lines(make_docs(rows))
    assert {r.text for r in got.filter("_n_dropped = 0").collect()} == {rows[0][1], rows[1][1]}
    assert got.filter("_n_dropped = 1").count() == 498


def test_unique_lines_with_the_same_first_words_stay(make_docs):
    word = lambda k, c: chr(97 + k) + c
    rows = [(k, "\n".join(["it was a " + " ".join(word(k, c) for c in "xyz"[:m]) for m in (1, 2, 3)] + ["it was a day like this one"]))
            for k in range(12)]
    got = {r.doc_id: r for r in L.drop_recurring_lines(make_docs(rows)).collect()}
    assert got[0].text == rows[0][1]
    assert all(got[k].text == rows[k][1].rsplit("\n", 1)[0] for k in range(1, 12))


def line_sql(docs):
    want = oracle(L.ORACLE, documents=docs.select("doc_id", "text").toPandas())
    got = L.drop_recurring_lines(docs, long_lines=True).select("doc_id", "text", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"))
    key = ["doc_id", "text", "n_lines", "n_dropped"]
    return sorted(map(tuple, got.toPandas()[key].to_numpy().tolist())), sorted(map(tuple, want[key].to_numpy().tolist()))


def test_the_whole_line_rule_equals_its_sql(make_docs):
    """Fields of letters with frequent values, leaves whose lines share their first words alone, long lines in two documents,
    long texts: what one threshold and no long lines would tell otherwise."""
    rng = random.Random(8)
    names = [f"{a}{b}" for a in "abcdefgh" for b in "ijklm"]
    rows = []
    for k in range(160):
        lines = [f"this page was written by {names[rng.randrange(5 if k % 2 else 40)]} from {'xyz'[k % 3]} in {k}",
                 f"it was a {rng.choice(names)} {rng.choice(names)}", f"copyright {k} by the very same owner {rng.choice('pq')}", f"own line number {rng.random()} {k} words"]
        rng.shuffle(lines)
        rows.append((k, "\n".join(lines)))
    passage = " ".join(rng.choice(names) for _ in range(60))
    rows += [(200, "before\n" + passage + "\nafter"), (201, "other\n  " + passage), (202, passage + "\n" + passage),
             (203, "\n".join(f"long text line {'abcdefghij'[k % 10]} of {'klmno'[k // 10 % 5]} kinds" for k in range(6000)))]
    got, want = line_sql(make_docs(rows))
    assert got == want
    by = {r[0]: r for r in got}
    assert by[200][3] == 0 and by[201][1] == "other" and by[202][1] == ""
    assert sum("this page was written by" in r[1] for r in got) < 16 and sum("it was a" in r[1] for r in got) == 160


def test_line_query_equals_its_sql(spark):
    got = QUERIES["op10_line_dedup"](spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)
    want = oracle(ORACLES["op10_line_dedup"], documents=pd.read_parquet(f"{SF}/documents.parquet"))
    pd.testing.assert_frame_equal(got, want[got.columns].sort_values("doc_id").reset_index(drop=True), check_dtype=False)
    assert got.n_dropped.sum() > 0


def test_line_main_path_is_native(make_docs):
    assert not re.search("Python|Pandas|Arrow", L.drop_recurring_lines(make_docs(line_docs()))._jdf.queryExecution().toString())


# ---- n-gram join

def brute_ngrams(rows, n=5, threshold=0.8):
    words = [[x for x in (re.sub(r"\W+", "", w) for w in (t or "").lower().split()) if x] for _, t in rows]
    sets = [{tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set() for w in words]
    par, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if words[i] == words[j] or both and both >= threshold * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)), key=lambda k: rows[k][0])
                par[b] = a
    return sorted(((rows[i][0], rows[find(i)][0], links[i], rows[i][0] == rows[find(i)][0]) for i in range(len(rows))), key=repr)


def near_copies(seed=0, families=6, size=9, words=80):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices(string.ascii_lowercase, k=5)) for _ in range(600)]
    rows, k = [], 1
    for _ in range(families):
        base = rng.choices(vocab, k=words)
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(words)] = rng.choice(vocab)
            rows.append((k, " ".join(w)))
            k += 1
    rng.shuffle(rows)
    return rows


def test_banding_meets_its_recall():
    bands, rows = J.choose_bands(0.8, 0.999, 96)
    assert bands * rows <= 96 and 1 - (1 - 0.8 ** rows) ** bands >= 0.999
    with pytest.raises(ValueError):
        J.choose_bands(0.1, 0.999999, 8)


@pytest.mark.parametrize("chunks", [False, True])
def test_links_equal_brute_force(make_docs, monkeypatch, chunks):
    if chunks:  # every bucket and family is cut into blocks
        monkeypatch.setattr(J, "BUCKET_CHUNK", 2)
        monkeypatch.setattr(J, "FAMILY_CHUNK", 3)
    rows = near_copies() + [(900, "Two words"), (901, "two, WORDS!"), (902, None), (903, "  "), (904, "..."), (905, "x " * 30_000)]
    assert rows_of(J.near_duplicates(make_docs(rows, extra=True))) == brute_ngrams(rows)


def test_near_duplicates_edge_cases(make_docs):
    assert J.near_duplicates(make_docs([])).count() == 0
    got = {tuple(r) for r in J.near_duplicates(make_docs([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (2, "g h i")])).collect()}
    assert got == {(None, None, 0, True), (3, 3, 1, True), (2, 2, 0, True)}
    kept = J.drop_near_duplicates(make_docs(near_copies()))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in brute_ngrams(near_copies()) if r[3])


def test_repeated_ids_keep_each_text_and_its_links(make_docs):
    """Id 1 has two texts and each of 2 and 3 is a near copy of one of them; id 9 has many texts."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices(string.ascii_lowercase, k=6))
    a, b = [word() for _ in range(120)], [word() for _ in range(120)]
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join([*a[:-1], "x"])), (3, " ".join([*b[:-1], "y"])), (1, " ".join(a))]
    rows += [(9, " ".join(word() for _ in range(30))) for _ in range(12)] + [(8, " ".join(word() for _ in range(30)))]
    got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in J.near_duplicates(make_docs(rows)).collect())
    assert got[:5] == [(1, 1, 1), (1, 1, 2), (1, 1, 2), (2, 1, 2), (3, 1, 1)]
    assert got[5:] == [(8, 8, 0)] + [(9, 9, 0)] * 12
    # a text of its own is not dropped because another text of its id is a copy
    kept = J.drop_near_duplicates(make_docs([*rows, (2, "a text that no other document has at all")]))
    assert sorted((r["doc_id"], len(r["text"].split())) for r in kept.collect()) == sorted(
        [(1, 120), (1, 120), (1, 120), (2, 9), (8, 30)] + [(9, 30)] * 12)


def test_columns_with_inside_names_pass_unchanged(make_docs):
    names = ["_id", "_h", "_w", "_pos", "_d", "_th", "_maybe", "_lines", "_key", "_m", "gone_id", "gone_th", "th", "rep", "cls"]
    docs = make_docs([*((k, f"same long line of words here {'z' * k}\nbuilt for you by the team today\nown {k}") for k in range(1, 9)), *near_copies(families=1)])
    for c in names:
        docs = docs.withColumn(c, F.lit(f"mine {c}"))
    for out in (J.drop_near_duplicates(docs), L.drop_recurring_lines(docs, long_lines=True), L.drop_repeated_passages(docs)):
        assert out.columns[:len(docs.columns)] == docs.columns
        assert {tuple(r) for r in out.select(*names).collect()} == {tuple(f"mine {c}" for c in names)}


def test_ngram_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(QUERIES["op8_ngram_join"](spark, SF)) == brute_ngrams(rows)


def test_intersections_by_slices():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 3000, 900).astype(np.uint64)) for _ in range(7)]
    got = J.intersections(sets, np.arange(7), np.arange(7))
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(7) for j in range(7) if i != j)


# ---- embeddings

def brute_vectors(rows, threshold=0.98):
    unit = [None if v is None or lab is None or any(x is None for x in v) else E.normalised(np.array(v)) for _, v, lab in rows]
    links, par = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)), key=lambda k: rows[k][0])
                par[b] = a
    return sorted(((rows[i][0], links[i], rows[find(i)][0], rows[i][0] == rows[find(i)][0]) for i in range(len(rows))), key=repr)


def vectors(seed=0, groups=12, size=12, dim=16):
    rng = np.random.default_rng(seed)
    rows, k = [], 1
    for g in range(groups):
        base = rng.normal(size=dim)
        for _ in range(size):
            v = base + rng.normal(size=dim) * rng.choice([0, 0.05, 0.2]) * np.linalg.norm(base) / 4
            rows.append((k, [float(x) for x in v * rng.choice([0.5, 2.0])], g % 3))
            k += 1
    return rows + [(800, None, 1), (801, [0.0] * dim, 1), (802, [float("nan")] * dim, 1), (803, rows[0][1], None),
                   (804, [None] + rows[0][1][1:], 0), (805, [float("inf")] + [0.0] * (dim - 1), 0)]


@pytest.mark.parametrize("chunk", [512, 2])
def test_vectors_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(E, "BUCKET_ROWS", chunk)  # with 2 every block is cut
    df = spark.createDataFrame(vectors(), "vec_id long, embedding array<double>, label int").withColumn("rep", F.lit("x")).withColumn("m", F.lit(1))
    assert rows_of(E.near_vectors(df)) == brute_vectors(vectors())


def test_vectors_edge_cases(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert E.near_vectors(spark.createDataFrame([], kind)).count() == 0
    assert rows_of(E.near_vectors(spark.createDataFrame([(1, None, 1), (2, [0.0], None)], kind))) == [(1, 0, 1, True), (2, 0, 2, True)]
    twice = spark.createDataFrame([(1, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [2.0, 4.0], 1), (3, [1.0, 2.0, 3.0], 1)], kind)
    assert rows_of(E.near_vectors(twice)) == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True)]


@pytest.mark.parametrize("chunk", [4096, 5])
def test_vectors_of_mixed_lengths_and_repeated_ids_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(E, "BUCKET_ROWS", chunk)
    kind = "vec_id long, embedding array<float>, label int"
    rows = [(i, [1.0, 2.0], 1) for i in range(3)] + [(10 + i, [1.0, 2.0, 3.0], 1) for i in range(5)] + [(20, [7.0], 1), (21, [8.0], 1), (22, [-8.0], 1)]
    rows += [(100 + i, v, lab) for i, v, lab in vectors(1, groups=4, size=6, dim=7)] + [(200 + i, v, lab) for i, v, lab in vectors(2, groups=3, size=6, dim=16)]
    # an id with vectors of two clusters, each with links of its own
    rows += [(5, [9.0, 0.1], 1), (5, [0.1, 9.0], 1), (6, [9.0, 0.2], 1), (7, [0.2, 9.0], 1)]
    got = rows_of(E.near_vectors(spark.createDataFrame(rows, kind), target_recall=1.0))
    assert got == brute_vectors([(i, None if v is None else [float(np.float32(x)) if x is not None else None for x in v], lab) for i, v, lab in rows])


def test_a_link_that_one_side_visits_counts_for_both(spark, monkeypatch):
    plain = E.fit_index

    def short(*a, **k):
        index = plain(*a, **k)
        index.reach *= 0.15
        return index

    monkeypatch.setattr(E, "fit_index", short)
    rng = np.random.default_rng(11)
    base = rng.normal(size=(300, 8))
    pairs = np.concatenate([base, base + rng.normal(size=base.shape) * 0.12])
    rows = [(k, v.tolist(), 1) for k, v in enumerate(pairs)]
    got = {r["vec_id"]: r for r in E.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), centroids=12).collect()}
    links = [r["n_links"] for r in got.values()]
    assert 0 < sum(links) < sum(r[1] for r in brute_vectors(rows))  # the short reach does miss some
    size = Counter(r["component_id"] for r in got.values())
    for r in got.values():  # pairs: linked on both sides or on neither
        if size[r["component_id"]] == 2:
            assert r["n_links"] == 1
        elif size[r["component_id"]] == 1:
            assert r["n_links"] == 0


def test_sampling_takes_rows_at_any_size(spark):
    from parallax.llm import training as T

    labels = spark.range(4000).selectExpr("id AS doc_id", "1 AS toxic")
    got = T.training_labels(labels, "toxic", bound=100).count()
    assert 50 < got < 160


def test_traversal_visits_in_order_and_misses_nothing():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 12))
    x = np.concatenate([base, base + rng.normal(size=(40, 12)) * 0.03])
    x /= np.linalg.norm(x, axis=1)[:, None]
    index = E.fit_index(x, 0.98, target_recall=1.0, centroids=8)
    cells = index.cells(x)
    visits = list(index.visits(x))
    one, two = index.bounds(x)
    for k, v in enumerate(visits):
        assert v[0] == cells[k] and len(set(v.tolist())) == len(v)
        bound = one[k, v // len(index.books[1])] + two[k, v % len(index.books[1])]
        assert (np.diff(bound) >= -1e-12).all()
        assert set(cells[x @ x[k] >= 0.98]) <= set(v)
    # a lower target shortens the reach, and is met
    lower = E.fit_index(x, 0.98, target_recall=0.9, centroids=8)
    near = [(i, j) for i in range(len(x)) for j in range(len(x)) if i != j and x[i] @ x[j] >= 0.98]
    found = list(lower.visits(x))
    assert lower.reach <= index.reach
    assert sum(cells[j] in found[i] for i, j in near) >= 0.9 * len(near)
