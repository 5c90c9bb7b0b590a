"""Classifiers, extraction, packing, chat formatting, SentencePiece and the pipeline."""

import json
import random
import re
import zlib
from collections import Counter
from html import unescape

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from parallax.llm import chat as C
from parallax.llm import components as K
from parallax.llm import html_extract as H
from parallax.llm import packing as P
from parallax.llm import quality as Q
from parallax.llm import spiece as S
from parallax.llm import toxicity as X
from parallax.llm.queries import ORACLES, QUERIES
from parallax.llm.textstats import STATS, stats_of
from parallax.llm.training import held_out, training_labels
from parallax.llm.wordbpe import WordEncoder

SF, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def fold(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


# ---- folds

def test_fold_and_bounded_sample(spark, make_labels):
    df = spark.range(400).select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("h"))
    assert all(r.h == fold(r.doc_id) for r in df.collect())
    labels = make_labels([(k, k % 2, 0) for k in range(3000)] + [(1, 0, 0), (None, 1, 1)])
    rows = training_labels(labels, "quality").collect()
    assert not any(fold(r.doc_id) for r in rows) and len({r.doc_id for r in rows}) == len(rows)
    assert {r.doc_id: r.label for r in rows}[1] == 1
    few = training_labels(labels, "quality", bound=500).count()
    assert 350 < few < 650


def test_a_repeated_document_is_one_training_row(make_docs, make_labels):
    from parallax.llm.training import training_texts

    ids = [i for i in range(40) if not fold(i)][:3]
    rows = [(ids[0], "again")] * 500 + [(ids[1], t) for t in ("b", "a", "c")] + [(ids[2], None)]
    labels = make_labels([(i, 1, 0) for i in ids])
    got = [sorted(map(tuple, training_texts(make_docs(d), labels, "quality").collect())) for d in (rows, rows[::-1])]
    assert got[0] == got[1] and [(r[0], r[2]) for r in got[0]] == [(i, 1) for i in ids]
    assert got[0][0][1] == "again" and got[0][2][1] is None


def junk_and_prose(n=300, seed=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 9)))
    docs, labels = [], []
    for k in range(n):
        words = [word() for _ in range(rng.randint(20, 120))]
        good = k % 3 > 0
        toxic = k % 7 == 0
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["zzbad", "zzbadly", "zzbadder"]))
        text = " ".join(words) + "."
        if not good:
            text = rng.choice([text.upper().replace(" ", "!! "), " ".join(w + "$$$" for w in words), " ".join([w for w in words for _ in range(5)])])
        docs.append((k, text))
        labels.append((k, int(good), int(toxic)))
    return docs, labels


# ---- quality

def test_column_form_equals_numpy_form(spark, make_docs, make_labels):
    docs, labels = junk_and_prose()
    docs = docs + [(900, None), (901, ""), (902, "w " * 40_000), (5, docs[5][1])]
    df = make_docs(docs, extra=True)
    model = Q.train_quality(df, make_labels(labels))
    assert model.rules and json.loads(model.to_json())["rules"]
    got = {r.doc_id: r for r in Q.score_quality(df, model).collect()}
    for i, t in docs:
        want = model.score_numpy(np.array([stats_of(t)]))[0]
        assert got[i].score == pytest.approx(want, abs=1e-9)
        assert got[i].predicted == int(want >= 0.3) and got[i].held_out == fold(i)
    labelled = {i: q for i, q, _ in labels}
    right = [got[i].predicted == labelled[i] for i in labelled if fold(i)]
    assert sum(right) >= 0.95 * len(right)
    kept = Q.quality_filter(df, model)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {i for i in got if got[i].predicted}


def test_quality_without_labels_or_with_one_class(spark, make_docs, make_labels):
    df = make_docs([(1, "a b c"), (2, None)])
    none = Q.score_quality(df, Q.train_quality(df, make_labels([]))).collect()
    assert all(r.predicted == 1 and r.score > 0.99 for r in none)
    ids = [k for k in range(50) if not fold(k)][:8]
    df = make_docs([(k, "a b") for k in ids])
    one = Q.score_quality(df, Q.train_quality(df, make_labels([(k, 0, 0) for k in ids]))).collect()
    assert {round(r.score, 6) for r in one} == {0.1}
    assert Q.score_quality(make_docs([]), Q.RuleModel()).count() == 0


def test_large_and_null_ids_pass_unchanged(spark, make_docs):
    big = (1 << 62) + 1
    df = make_docs([(big, "a b"), (None, "you idiot"), (3, None)], extra=True)
    for out in (Q.score_quality(df, Q.RuleModel()), X.score_toxicity(df, X.ToxicGrammar())):
        assert {r.doc_id for r in out.collect()} == {big, None, 3}
    assert {r.doc_id for r in X.toxicity_filter(df, X.ToxicGrammar()).collect()} <= {big, None, 3}


def test_statistics_of_small_texts():
    assert stats_of(None) == stats_of("  \n ") == [0.0] * len(STATS)
    s = dict(zip(STATS, stats_of("AB cd!! x$\nAB x$ x$"), strict=True))
    assert (s["n_words"], s["n_lines"], s["max_word"], s["distinct_lines"]) == (6, 2, 4, 1.0)
    assert s["upper_share"] == pytest.approx(4 / 9) and s["word_symbol"] == pytest.approx(0.5) and s["repeat_next"] == pytest.approx(1 / 6)


@pytest.mark.parametrize("name,label", [("op9_quality", "quality"), ("op1_toxicity", "toxic")])
def test_held_out_accuracy_of_the_queries(spark, name, label):
    got = QUERIES[name](spark, SF01)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and got.count() == 1000
    df = got.join(spark.read.parquet(f"{SF01}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert ((df.score >= 0) & (df.score <= 1)).all()
    assert (df.predicted == df[label]).mean() >= 0.95


# ---- toxicity

def grammar():
    return X.ToxicGrammar(prefixes={"zzb": 2.0, "zzbad": 5.0})


@pytest.mark.parametrize("clause,want", [
    ("you are an idiot", [("targeted", "idiot")]),
    ("such an idiot was never here", [("plain", "idiot")]),
    ("he is not an idiot", [("negated", "idiot")]),
    ("not one of them was an idiot", [("plain", "idiot")]),
    ("she said that was stupid", [("reported", "stupid")]),
    ('"what an idiot"', [("reported", "idiot")]),
    ("i will kill you", [("threat", "kill")]),
    ("they kill time", []),
    ("a zzbadly zzbig thing", [("plain", "zzbadly"), ("plain", "zzbig")]),
    ("idiotic", []),
])
def test_clause_grammar(clause, want):
    g = grammar()
    found = [(k, w) for _, _, m in X.matches(g, clause) for k, _, w in m]
    assert found == want


def test_longest_entry_gives_the_weight_and_clauses_are_apart():
    g = grammar()
    assert (g.insult("zzbadly"), g.insult("zzbit"), g.insult("xzzbad")) == (5.0, 2.0, 0.0)
    found = list(X.matches(g, "Not here. An idiot!\nShe said no; trash"))
    assert [[k for k, _, _ in m] for _, _, m in found] == [["plain"], ["plain"]]
    assert X.features(g, None) == X.features(g, "") == [0.0] * len(X.FEATURES)
    assert [m for m in X.matches(g, "idiot " * 20_000)][0][2][-1][0] == "plain"


def test_learns_stems_and_rejects(spark, make_docs, make_labels):
    docs, labels = junk_and_prose(400, seed=3)
    docs = docs + [(9000, None), (9001, ""), (9002, "fresh zzbadderer words")]
    df = make_docs(docs, extra=True)
    g = X.train_toxicity(df, make_labels(labels))
    assert any("zzbad".startswith(p) or p.startswith("zzbad") for p in g.prefixes)
    got = {r.doc_id: r for r in X.score_toxicity(df, g).collect()}
    assert all(got[i].predicted == t for i, _, t in labels if fold(i))
    assert got[9000].predicted == got[9001].predicted == 0 and got[9002].predicted == 1
    kept = X.toxicity_filter(df, g)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i in got if not got[i].predicted}
    spans = X.clause_matches(make_docs([(1, "Hello there. You zzbadly one.")]), g).collect()
    assert [(r.start, r.end) for r in spans] == [(12, 28)] and spans[0].symbols == ["targeted"]


def test_toxicity_without_labels(spark, make_docs, make_labels):
    df = make_docs([(1, "you are a pathetic idiot and a worthless clown"), (2, "fine day")])
    got = {r.doc_id: r.predicted for r in X.score_toxicity(df, X.train_toxicity(df, make_labels([]))).collect()}
    assert got == {1: 1, 2: 0}


SAID = [
    ('"Great day" she said, you idiot', ["targeted"]), ("idiot, he said", ["reported"]), ("she is no idiot", ["negated"]), ("he is hardly an idiot", ["negated"]),
    ("i hope you die", ["threat"]), ("he said you are an idiot", ["reported"]), ("no you idiot", ["targeted"]), ("not an idiot", ["negated"]),
    ('he wrote "you idiot" and you are a moron', ["reported", "targeted"]), ("«idiot» dijo", ["reported"]), ("i will kill you", ["threat"]),
    ("they didn't kill", []), ("you said it, idiot", ["reported"]), ("“idiot” you moron", ["reported", "targeted"]), ("idiot", ["plain"]),
]


@pytest.mark.parametrize("clause,want", SAID)
def test_scopes_of_speech_and_negation(clause, want):
    assert [k for _, _, found in X.matches(X.ToxicGrammar(), clause) for k, _, _ in found] == want


def brute_outputs(words, symbols):
    """Each word's output by the scopes' definitions, one scope after the other, without tables or states in common."""
    n, out = len(words), []
    quoted, said, after = [False] * n, [False] * n, 0
    inside = verb = False
    for k, x in enumerate(symbols):
        quoted[k], said[k] = inside, verb
        if inside:
            if x in 'q)':
                inside, after = False, X.SPAN + 1
        elif x in 'q(':
            inside, verb, after = True, False, 0
        elif x == "r":
            verb, after = verb or not after, 0
        after = max(0, after - 1)
    for k, x in enumerate(symbols):
        if x not in "hi":
            continue
        intent = [j for j in range(max(0, k - X.SPAN), k) if symbols[j] == "n"]
        near = [j for j in range(max(0, k - X.SPAN), min(n, k + X.SPAN + 1)) if j != k and symbols[j] == "t"]
        neg = [j for j in range(k) if symbols[j] in "gw"]
        negated = bool(neg) and (k - neg[-1] <= X.NEG_SPAN if symbols[neg[-1]] == "g" else k - neg[-1] <= X.WEAK_SPAN and "t" not in symbols[neg[-1]:k])
        verbs = [j for j in range(max(k + 1, n - 1 - X.TRAIL), n) if symbols[j] == "r" and not set(symbols[k + 1:]) & set("q()")]
        kind = "threat" if x == "h" and intent else "plain" if x == "i" else None
        if kind:
            out.append("reported" if quoted[k] or said[k] or verbs else "negated" if negated else "targeted" if kind == "plain" and near else kind)
    return out


@settings(max_examples=800, deadline=None)
@given(st.lists(st.sampled_from(["not", "no", "said", "will", "kill", "you", '"', "“", "”", "idiot", "day", "tree"]), max_size=14))
def test_composed_machine_equals_the_scopes_one_by_one(words):
    symbols = [X._CLASS.get(w) or ("i" if w == "idiot" else "o") for w in words]
    got = [k for k, _, _ in X.match_clause(X.ToxicGrammar(), words)]
    assert got == brute_outputs(words, "".join(symbols))


def test_long_clauses_and_texts_take_linear_time():
    import time

    g = X.ToxicGrammar()
    for make in (lambda n: "you idiot " * n, lambda n: "you idiot. " * n, lambda n: '"idiot ' * n):
        took = []
        for n in (4000, 16_000):
            t = time.process_time()
            X.features(g, make(n))
            took.append(time.process_time() - t)
        assert took[1] < 10 * took[0] + 0.2


def test_quality_of_an_empty_table(make_docs, make_labels):
    m = Q.train_quality(make_docs([]), make_labels([]))
    assert Q.score_quality(make_docs([]), m).collect() == [] and Q.quality_filter(make_docs([]), m).collect() == []


def test_toxicity_of_an_empty_table(make_docs, make_labels):
    g = X.train_toxicity(make_docs([]), make_labels([]))
    assert X.score_toxicity(make_docs([]), g).collect() == [] and X.toxicity_filter(make_docs([]), g).collect() == []


# ---- html

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><p>Site</p><nav><a href=/>Home</a></nav></header>
<div class="cookie-notice">We use cookies on this site to make it better for you.</div>
<main><article><header><h1>Head &amp; line</h1></header><p>First&nbsp;<a href=x>para</a>\n  graph<p>Second <b>bold<br>text &#233;</b></p>
<div id="ad-3">Buy now, today only, great savings for everyone</div><ul><li>one<li>two</ul><script>var x="<p>no</p>"</script>
<form><label>Mail</label><input></form><section class="comments"><h2>Comments</h2><p>I liked this article a lot, thank you</p></section>
<p hidden>unseen</p><!-- <p>not here</p> --></article></main><aside><p>A long sidebar text that could look like a paragraph</p></aside><footer>&copy; 1</footer>"""


def test_main_text_of_a_page_with_everything():
    assert H.main_text(PAGE) == "Head & line First para graph Second bold text é one two"


@pytest.mark.parametrize("page,want", [
    (None, ""), ("", ""), ("plain words", "plain words"), ("<p>cut off <b", "cut off"), ("<p>a < b & c</p>", "a < b & c"),
    ("<div class=menu>x</div>", ""), ("<p>x" * 3, "x x x"), ("<p title='a>b'>t</p>", "t"), ("<p>one<!-- two", "one"),
    ("<script>lost", ""), ("<p>&lt;b&gt; &am &amp", "<b> &am &"),
])
def test_broken_and_small_pages(page, want):
    assert H.main_text(page) == want


@pytest.mark.parametrize("page,want", [
    ("<body class='single has-sidebar'><nav><a href=/>Home</a></nav>{0}<footer>c 1</footer></body>", "{1}"),
    ("<body><div class='layout with-sidebar'><nav><a href=/>Home</a></nav>{0}<div class='sidebar'>{2}</div></div></body>", "{1}"),
    ("<body><section id='discussion'><article>{0}</article></section><div class='comments'>{2}</div></body>", "{1}"),
    ("<body><nav><a href=/>Home</a></nav><div class='text'>Small box</div><div>{0}</div></body>", "Small box {1}"),
    ("<div class='has-sidebar'><p>" + "one block alone " * 9 + "</p></div>", ("one block alone " * 9).strip()),
    ("<body data-id='nav'><div data-class='menu' title='class=nav'>{0}</div></body>", "{1}"),
    ("<body><article>{0}<div class='comments'>{2}{2}{2}{2}</div></article></body>", "{1}"),
    ("<body><article>{0}</article><div class='comments'>{2}{2}{2}{2}</div></body>", "{1}"),
])
def test_layout_wrappers_with_frame_names_hold_the_article(page, want):
    text = ["The head", " ".join(["the river rose slowly over several days"] * 4), "and fell again", " ".join(["nobody had seen it so high"] * 6)]
    article = f"<h1>{text[0]}</h1>" + "".join(f"<p>{t}</p>" for t in text[1:])
    assert H.main_text(page.format(article, "", "<p>I liked this page a lot and thank you for it</p>")) == want.format("", " ".join(text))


ARTICLE = "<h1>The head</h1>" + "".join(f"<p>{t}</p>" for t in ("A paragraph of the article with words enough to be prose for its readers here. " * 3,
                                                                        "Another one, of the same kind, that goes on for as long as it has to. " * 3))
ARTICLE_TEXT = " ".join(re.sub(r"<[^>]*>", " ", ARTICLE).split())


@pytest.mark.parametrize("page", [
    "<html><body><nav><a>Home</a></nav><main><div class='layout with-sidebar'>{0}<div class='sidebar'>side box text</div></div></main><footer>foot</footer></body></html>",
    "<body><article><div class='content long-form'>{0}</div></article></body>",
    "<body><div class='post-content'><div id='legal-news'>{0}</div></div></body>",
    "<body><article><div class='with-sidebar'><div class='long-form'>{0}<div class='ad'>Buy now</div></div></div></article><div class='comments'><p>so true, thank you all</p></div></body>",
    "<body><article>{0}<div class='comments'>" + "<p>A reader's comment that is as long as any paragraph of the article could be, or more.</p>" * 12 + "</div></article></body>",
    "<body><main><article>{0}</article><section class='comments'>" + "<p>A reader's comment that is as long as any paragraph of the article could be, or more.</p>" * 12 + "</section></main></body>",
])
def test_named_wrappers_inside_an_article(page):
    assert H.main_text(page.format(ARTICLE)) == ARTICLE_TEXT


def test_a_named_paragraph_belongs_to_its_article():
    page = f"<body><article>{ARTICLE}<p class='discussion'>What this means is discussed here.</p><p class='ad'>Buy it now</p></article></body>"
    assert H.main_text(page) == ARTICLE_TEXT + " What this means is discussed here."


@pytest.mark.parametrize("make", [
    lambda n: "<span>" * n + "<p>x y</p>" * n, lambda n: "<a b'" * n, lambda n: '<p title="x' * n, lambda n: "<ul><li>x" * n, lambda n: "<div class='with-sidebar'>a b c" * n,
    lambda n: "<div>" * n + "text</b>" * n, lambda n: "<a href=#>x" * n, lambda n: "<article>" + "<div class='long-form'>a b c" * n, lambda n: "<!-- x" * n, lambda n: "<p '\">" * n,
])
def test_broken_pages_take_linear_time(make):
    import time

    def took(n):
        page = make(n)
        best = []
        for _ in range(2):
            t = time.process_time()
            H.main_text(page)
            best.append(time.process_time() - t)
        return min(best)

    H.default_tree()
    assert took(12_000) < 8 * took(3000) + 0.2  # four times the tags


REGEX = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|</?[a-zA-Z][^<>]*>", re.S)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["<p", "<a", "</p>", ">", " x='", ' y="', "'", '"', "<!--", "-->", "<!", "<?", "<![CDATA[", "]]>", "t", " ", "<", "=", "/"]), max_size=24).map("".join))
def test_tags_are_those_of_one_expression(page):
    tags, at, got = H._Tags(page), 0, []
    while (found := tags.after(at)) is not None:
        got.append(page[found[0]:found[1]])
        at = found[1]
    assert got == [m[0] for m in REGEX.finditer(page)]


def test_tree_learns_its_table_and_other_pages():
    x, y = H.labelled_table()
    assert len(x) < 4000 and (H.accept(H.default_tree(), x) == (y > 0)).mean() > 0.98
    x, y = H.labelled_table(60, seed=99)
    assert (H.accept(H.default_tree(), x) == (y > 0)).mean() > 0.97


def test_extract_equals_the_articles(spark):
    pages = spark.read.parquet(f"{SF01}/pages.parquet").collect()
    got = {r.page_id: r for r in QUERIES["op2_html_extract"](spark, SF01).collect()}
    assert len(got) == len(pages)
    for p in pages:
        inner = p.html.split("<article>")[1].split("</article>")[0]
        want = " ".join(unescape(re.sub(r"<[^>]*>", " ", inner)).split())
        assert got[p.page_id].text == want and got[p.page_id].n_chars == len(want) and got[p.page_id].url == p.url


def test_extract_edge_rows(spark):
    df = spark.createDataFrame([(None, None, None, "x"), (1, "u", "<p>" + "w " * 50_000, "y"), (1, "u", "<p>a", "z")],
                               "page_id long, url string, html string, text string")
    got = sorted(H.extract(df).collect(), key=lambda r: r.n_chars)
    assert [r.n_chars for r in got] == [0, 1, 99_999] and got[0].page_id is None
    assert H.extract(df.limit(0)).count() == 0


# ---- packing

@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=200))
def test_plan_places_every_piece_once(lengths):
    counts = Counter(lengths)
    runs, bins = P.plan_bins(counts, 40)
    seen, content = Counter(), {}
    for n, first, m, b, at in runs:
        for k in range(m):
            seen[(n, first + k)] += 1
            content.setdefault(b + k, []).append((at, n))
    assert set(seen.values()) <= {1} and Counter(n for n, _ in seen) == counts
    assert set(content) == set(range(bins))
    for x in content.values():
        end = 0
        for at, n in sorted(x):
            assert at == end
            end += n
        assert end <= 40 and sum(3 * n > 40 for _, n in x) <= 2
    # no worse than best-fit decreasing, the plain way
    gaps = []
    for n in sorted(lengths, reverse=True):
        k = min((g, i) for i, g in enumerate(gaps) if g >= n)[1] if any(g >= n for g in gaps) else None
        if k is None:
            gaps.append(40 - n)
        else:
            gaps[k] -= n
    assert bins <= len(gaps) * 1.2 + 1


def check_packing(got, docs):
    t = Tokenizer.from_file(WORD_BPE)
    by_doc, bins = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append(r)
    for i, text in docs:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in pieces] == [
            (k, s, len(ids[s:s + 2048]), zlib.crc32(ids[s:s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
    for rows in bins.values():
        end = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end <= 2048
    return len(bins)


def test_packing_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op3_packing"](spark, SF).collect()
    n = check_packing(got, docs)
    assert n <= -(-sum(r.length for r in got) // 2048) * 1.01 + 1


def test_packing_edge_rows(spark, make_docs):
    docs = [(1, None), (2, ""), (3, "word " * 9000), (4, "Σ İ <|endoftext|> 中文 it's"), (5, "x")]
    got = P.pack(P.token_pieces(make_docs(docs, extra=True), WORD_BPE)).collect()
    check_packing(got, docs)
    twice = P.pack(P.token_pieces(make_docs([(1, "a b"), (1, "a b"), (None, "c")]), WORD_BPE)).collect()
    assert sorted((r.doc_id is None, r.length) for r in twice) == [(False, 3), (False, 3), (True, 2)]
    assert len({(r.sequence_id, r.offset) for r in twice}) == 3
    assert P.pack(P.token_pieces(make_docs([]), WORD_BPE)).count() == 0


def test_salted_ranks_have_no_gaps(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"),
                                  F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50 + 1).cast("long").alias("length"),
                                  F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("ids_crc32"), F.col("id").alias("_row"))
    df = df.withColumn("doc_id", F.when(F.col("doc_id") % 3 == 0, 7).otherwise(F.col("doc_id")))  # a third of the rows are one
    got = P.rank_in_length(df, rows_per_salt=100).groupBy("length").agg(F.count("*").alias("n"), F.countDistinct("_rank").alias("d"), F.max("_rank").alias("m"))
    assert all(r.n == r.d == r.m + 1 for r in got.collect())


ODD = ["", "It's WE'LL don't", "<|endoftext|> x", "ﬁ İstanbul ΣΑΣ", "a²b ½ \x1c z", "é é 中文 ١٢", "ÀÉ_a__b--c…“q” 12345 x\x85y\xa0z", "'s 'tis ' s"]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(ODD), st.text(max_size=40), st.text("abAB 'é.1²İß_\n\t", max_size=40)), max_size=6))
def test_word_encoding_equals_the_library(texts):
    enc = ENCODERS.setdefault("w", WordEncoder(WORD_BPE, max_cached=50))
    lib = ENCODERS.setdefault("t", Tokenizer.from_file(WORD_BPE))
    assert [x.tolist() for x in enc.encode(texts)] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


ENCODERS: dict = {}


def test_every_plain_character_is_split_as_the_library_does():
    enc, lib = WordEncoder(WORD_BPE), Tokenizer.from_file(WORD_BPE)
    texts = [t for c in map(chr, range(0x2500)) if enc._plain(c)
             for t in (c, f" {c}{c} ", f"a{c}b {c}{c}1{c} 'S{c}'s {c}'ll,{c}\n{c}")]
    assert len(texts) > 1500
    assert [x.tolist() for x in enc.encode(texts)] == [lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in WordEncoder(WORD_BPE).encode(["", " \n\xa0"])] == [[], []] and enc.encode([]) == []


def test_a_word_is_encoded_once_whatever_stands_beside_it():
    """The unit of the cache is a word: punctuation, digits and contractions beside it make no new entry, nor does a later batch."""
    enc, lib, seen = WordEncoder(WORD_BPE), Tokenizer.from_file(WORD_BPE), []

    class Counted:
        def __init__(self, model):
            self.model = model

        def tokenize(self, word):
            seen.append(word)
            return self.model.tokenize(word)

    enc._model = Counted(enc._model)
    texts = ["alpha beta, (alpha) beta. alpha's", "'alpha' beta7 7alpha alpha,beta", "(beta) alpha. BETA's"]
    for t in texts:
        assert enc.encode([t])[0].tolist() == lib.encode(t, add_special_tokens=False).ids
    assert len(seen) == len(set(seen)) and {"alpha", "beta", "'s", "7"} <= set(seen)


# ---- SentencePiece

@settings(max_examples=50, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(ODD), st.text(max_size=30), st.text("abt he▁ \n.", max_size=40)), max_size=5))
def test_pieces_equal_the_library(texts):
    enc = ENCODERS.setdefault("p", S.PieceEncoder(PIECES))
    lib = ENCODERS.setdefault("s", sentencepiece.SentencePieceProcessor(model_file=PIECES))
    texts = [t.replace("\x00", "") for t in texts]
    ids = enc.encode(texts)
    assert [x.tolist() for x in ids] == lib.encode(texts)
    assert [enc.decode(x) for x in ids] == [lib.decode(x.tolist()) for x in ids]


def test_long_runs_without_spaces_equal_the_library_and_take_linear_time():
    import time

    enc = S.PieceEncoder(PIECES)
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(1)
    run = lambda n, alphabet: "".join(rng.choices(alphabet, k=n))
    texts = [run(300, "abcdefgh漢字日本語中文ABC123"), run(2000, "thequickbrownfox"), run(500, "漢字日本語中文"), "a" * 500, run(400, "ab▁c"),
             run(900, "é-_/.:aeiounrst0123456789"), "see http://" + run(400, "abcdefghijklmnop/._-") + " there"]
    assert [x.tolist() for x in enc.encode(texts)] == lib.encode(texts)
    text = run(60_000, "abcdefgh漢字日本語中文ABC")
    start = time.process_time()
    ids = enc.encode([text])[0]
    assert time.process_time() - start < 5 and enc.decode(ids) == text


def test_broken_bytes_decode_as_the_library_does():
    enc = S.PieceEncoder(PIECES)
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    b = enc.model.bytes
    for seq in ([b[0xE4], b[0xB8]], [b[0xFF], b[0x41]], [b[0xC3], b[0xA9], b[0x80]], [1, 5, 0, 300]):
        assert enc.decode(seq) == lib.decode(seq)


def unigram_file(tmp_path):
    """A small unigram model in the file format, written by hand."""
    def varint(n):
        out = b""
        while True:
            out += bytes([n & 127 | (128 if n > 127 else 0)])
            n >>= 7
            if not n:
                return out

    def msg(field, data):
        return varint(field << 3 | 2) + varint(len(data)) + data

    rng = random.Random(5)
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    words = {"▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "ca", "cab", "aa", "▁▁"}
    pieces += [(w, -1 - 5 * rng.random(), 1) for w in sorted(words)]
    out = b"".join(msg(1, msg(1, p.encode()) + varint(2 << 3 | 5) + np.float32(s).tobytes() + varint(3 << 3) + varint(k)) for p, s, k in pieces)
    out += msg(2, varint(3 << 3) + varint(1)) + msg(3, msg(1, b"identity") + varint(4 << 3) + varint(0))
    path = tmp_path / "u.model"
    path.write_bytes(out)
    return str(path), {p: s for p, s, k in pieces if k == 1}


def test_unigram_viterbi_is_the_best_segmentation(tmp_path):
    path, scores = unigram_file(tmp_path)
    enc = S.PieceEncoder(path)
    lowest = min(0.0, *scores.values()) - 10

    def brute(w):
        if not w:
            return 0.0
        best = max((scores[w[:k]] + brute(w[k:]) for k in range(1, len(w) + 1) if w[:k] in scores), default=-np.inf)
        return best if w[0] in scores else max(best, lowest + brute(w[1:]))

    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choices("abc d", k=rng.randint(1, 9)))
        ids = enc.encode([text])[0].tolist()
        got = sum(lowest if i == 0 else scores[enc.model.pieces[i]] for i in ids)
        # scores are single precision in the file
        assert got == pytest.approx(sum(brute(w) for w in S._WORDS.findall(enc.model.normalise(text))), abs=1e-5)


def test_piece_query_round_trips(spark, make_docs):
    got = QUERIES["op7_sentencepiece"](spark, SF)
    assert got.filter("not round_trip").count() == 0
    back = S.decode_documents(got, PIECES)
    want = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id: r.text for r in back.collect()} == want
    odd = S.encode_documents(make_docs([(1, None), (2, ""), (None, "a  b"), (3, "w " * 50_000)], extra=True), PIECES)
    assert odd.filter("round_trip").count() == 4 and odd.filter("size(ids) = 0").count() == 2
    assert S.encode_documents(make_docs([]), PIECES).count() == 0


# ---- chat

def test_chat_query_equals_its_sql(spark):
    got = QUERIES["op6_chat"](spark, SF).toPandas()
    con = duckdb.connect()
    con.register("conversations", pd.read_parquet(f"{SF}/conversations.parquet"))
    want = con.sql(ORACLES["op6_chat"]).df()[got.columns]
    keys = ["conv_id", "assistant", "part"]
    pd.testing.assert_frame_equal(got.sort_values(keys).reset_index(drop=True), want.sort_values(keys).reset_index(drop=True), check_dtype=False)


TURNS = [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi <|im_end|>"), (1, 2, "Bo b", "Hello"), (1, 3, "ann", None), (1, 3, "ann", None),
         (2, 0, "system", "alone"), (None, None, None, "x"), (3, 5, "", "y" * 30_000)]


def test_rotation_masks_and_names(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumn("part", F.lit(1)).withColumn("place", F.lit(2))
    rows = {(r.conv_id, r.assistant): r for r in C.rotate(df).collect()}
    assert set(rows) == {(1, "ann"), (1, "Bo_b"), (None, "unknown"), (3, "unknown")}
    ann = rows[(1, "ann")]
    assert ann.text.startswith("<|im_start|>system\nBe kind.<|im_end|>\n<|im_start|>assistant\nHi <‍|im_end|><|im_end|>\n<|im_start|>user name=Bo_b\nHello")
    assert [ann.text[m.start:m.end] for m in ann.mask] == ["Hi <‍|im_end|><|im_end|>", "<|im_end|>", "<|im_end|>"]
    bo = rows[(1, "Bo_b")]
    assert [bo.text[m.start:m.end] for m in bo.mask] == ["Hello<|im_end|>"] and "user name=ann" in bo.text
    assert C.rotate(df.limit(0)).count() == 0


def chat_sql(df):
    got = C.rotate(df).withColumn("mask", C.mask_text(F.col("mask")))
    con = duckdb.connect()
    con.register("conversations", df.toPandas().astype(object).where(lambda d: d.notna(), None))
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({C.ORACLE})").fetchall()
    return sorted(map(tuple, got.collect()), key=repr), sorted(want, key=repr)


def test_every_role_is_a_participant_of_its_own(spark):
    names = ["Ann B", "Ann.B", "Ann_B", None, "unknown", "Ann_B_2", "कवि", "कव", "system", "System"]
    rows = [(7, k, r, f"turn {k}") for k, r in enumerate(names * 2)] + [(8, 0, "Ann.B", "alone")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got, want = chat_sql(df)
    assert got == want
    seven = {r[1]: r for r in got if r[0] == 7}
    assert set(seven) == {"Ann_B", "Ann_B#2", "Ann_B#3", "unknown", "unknown#2", "Ann_B_2", "कवि", "कव", "System"}
    # each has the loss on its own two turns alone
    assert all(len(r[-1].split(",")) == 2 and r[5].count("<|im_start|>assistant") == 2 for r in seven.values())
    assert [r[1] for r in got if r[0] == 8] == ["Ann_B"]


def test_many_turns_of_one_number_spread_over_tasks(spark):
    df = spark.range(4000).selectExpr("1 AS conv_id", "IF(id % 3 = 0, id, NULL) AS turn", "concat('s', id % 3) AS role", "'same text' AS text")
    df = df.selectExpr("CAST(conv_id AS LONG) conv_id", "turn", "role", "text")
    got, want = chat_sql(df)
    assert got == want
    parts = K.places(df.withColumn("one", F.lit(1)), "one", "turn", "role", "text")
    assert sorted(r["_at"] for r in parts.select("_at").collect()) == list(range(4000))


def test_long_conversations_come_in_parts(spark):
    df = spark.createDataFrame([(1, k * 2, f"s{k % 3}", f"t{k}") for k in range(200)], "conv_id long, turn long, role string, text string")
    whole = {r.assistant: r.text for r in C.rotate(df, part_turns=1000).collect()}
    parts = C.rotate(df, part_turns=16).collect()
    assert {r.n_parts for r in parts} == {13} and max(r.n_turns for r in parts) == 16
    for s in whole:
        assert "".join(r.text for r in sorted((r for r in parts if r.assistant == s), key=lambda r: r.part)) == whole[s]


# ---- pipeline

def test_a_long_line_of_two_documents_stays_once(spark, make_docs):
    prose = lambda k, n: " ".join(f"{chr(97 + k)}{j}" for j in range(n))
    passage, almost = prose(20, 50), prose(21, 19)
    rows = [(k, f"{prose(k, 80)}\n{passage}\n{almost}") for k in range(2)] + [(2, f"{prose(0, 80)}\n{passage}\n{almost}"), (3, None)]
    got = {r.doc_id: r for r in corpus_pipeline.drop_near_copies(spark, make_docs(rows), SF01).collect()}
    assert sorted(got) == [0, 1, 3] and got[0].text == rows[0][1]
    assert got[1].text == f"{prose(1, 80)}\n{almost}" and got[1].n_chars == len(got[1].text)


def test_pipeline_of_nulls_repeats_and_no_rows(spark, make_docs, tmp_path):
    """Against a plain run of the stages' rules on rows that every rule can be read off."""
    vocab = [f"{a}{b}{c}" for a in ("ri", "to", "wa", "len", "mor", "shi") for b in ("ver", "wn", "ter", "d") for c in ("", "s", "ed", "ing", "er", "ly")]
    prose = lambda k: " ".join(random.Random(k).choices(vocab, k=45)).capitalize() + "."
    boiler = [f"Posted by the staff of our little paper on page {k}" for k in range(40)]
    rows = [(k, "\n".join([prose(k), boiler[k], prose(k + 50)])) for k in range(30)]
    rows += [(100, None), (101, ""), (None, rows[3][1]), (5, rows[5][1]), (5, rows[5][1]), (200, rows[6][1])]
    out = {}
    for name, data in (("full", rows), ("empty", [])):
        d = tmp_path / name
        make_docs(data, extra=True).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(r[0], 1, 0) for r in data if r[0] is not None and r[0] < 100], "doc_id long, quality int, toxic int").dropDuplicates(["doc_id"]).write.parquet(f"{d}/labels.parquet")
        docs = spark.read.parquet(f"{d}/documents.parquet")
        for stage, f in corpus_pipeline.STAGES[:-1]:
            docs = f(spark, docs, str(d))
            assert docs.columns == spark.read.parquet(f"{d}/documents.parquet").columns, stage
        out[name] = corpus_pipeline.run(spark, str(d)).collect()
    assert out["empty"] == []
    got = Counter(r["doc_id"] for r in out["full"])
    # all different documents stay, the empty ones as one, 6 without its copy 200; the rows of 5 and the one without an id as they are
    assert got == Counter({**dict.fromkeys(range(30), 1), 5: 3, 100: 1, None: 1})
    lines = corpus_pipeline.drop_lines(spark, spark.read.parquet(f"{tmp_path}/full/documents.parquet"), str(tmp_path / "full")).collect()
    assert sum("Posted by" in r["text"] for r in lines) == 1  # the template's first, the row without an id, has it alone
    ends = {}
    for r in out["full"]:
        ends.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in ends.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048


def test_stages_and_run(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "line_dedup", "near_duplicates", "packing"]
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    kept = corpus_pipeline.keep_good(spark, docs, SF01)
    assert kept.columns == docs.columns
    seen = kept.join(labels, "doc_id").toPandas()
    good = labels.toPandas()
    assert (seen.quality == 1).sum() >= 0.99 * (good.quality == 1).sum() and (seen.quality == 0).mean() < 0.02
    civil = corpus_pipeline.keep_civil(spark, docs, SF01)
    assert civil.columns == docs.columns
    seen = civil.join(labels, "doc_id").toPandas()
    assert (seen.toxic == 0).sum() >= 0.97 * (good.toxic == 0).sum() and (seen.toxic == 1).sum() <= 0.3 * (good.toxic == 1).sum()
    lines = corpus_pipeline.drop_lines(spark, docs, SF01)
    assert lines.columns == docs.columns and lines.count() == docs.count()
    assert lines.filter("n_chars <> length(text)").count() == 0
    out = corpus_pipeline.run(spark, SF01)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    ids = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    assert 500 < len(ids) < 1000 and "pipeline" not in ORACLES


def test_packing_bounds_what_a_worker_holds(monkeypatch):
    """The tokenizer sees a batch in slices, and Arrow's memory goes back after each batch; the pieces are those of one text at a time."""
    import pandas as pd

    from parallax.llm import packing
    from parallax.llm.queries import tokenizer_file
    from parallax.llm.wordbpe import WordEncoder

    file = tokenizer_file("word_bpe_49k.json")
    texts = [f"word{k} and more " * 5000 for k in range(16)]  # 1.2 million characters
    want = [len(x) + 1 for x in WordEncoder(file).encode(texts)]
    sizes, freed, plain = [], [], WordEncoder.encode
    monkeypatch.setattr(WordEncoder, "encode", lambda self, t: sizes.append(sum(map(len, t))) or plain(self, t))
    monkeypatch.setattr(packing, "free_arrow", lambda: freed.append(1))
    out = pd.concat(packing.piece_batches(file, 2048, 0)([pd.DataFrame({"doc_id": [str(k) for k in range(16)], "text": texts})]))
    assert max(sizes) <= 500_000 and sum(sizes) == sum(map(len, texts)) and freed == [1]
    assert out.groupby("doc_id", sort=False)["length"].sum().tolist() == want
