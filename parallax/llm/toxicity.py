"""Toxicity: a weighted finite-state pattern grammar over clauses.

A lexicon turns a clause's words into input symbols (``CLASSES``); a word that a weighted
trie of stems and whole words knows is an insult, with its weight. The trie is learned from the labelled
documents (log odds of a toxic document), with a small fixed seed list. Five finite
transducers read the symbols, each a table of states and arcs:

* negation, from the left: a negation opens a scope of ``NEG_SPAN`` words; a weak one (``no``,
  ``hardly``) a scope of ``WEAK_SPAN``, which a word that addresses someone closes;
* threat, from the left: a word of intent opens a window of ``SPAN`` words for a word of harm;
* target, from the left and from the right: words that address or point at someone mark ``SPAN``
  words on either side;
* reported speech, from the left: a verb of saying opens a scope up to the clause's end, a quotation mark one up to
  its closing mark; a verb within ``SPAN`` words after a closed quotation belongs to that and opens nothing;
* trailing reported speech, from the right: a verb of saying with at most ``TRAIL`` words after it reports
  what stands before it (``idiot, he said``), up to a quotation mark.

``compose`` builds their product once: one machine that reads from the left, one that reads from
the right, and the output of a word by its symbol and both states (a bimachine): each insult or threat becomes
reported, negated, threat, targeted or plain, in this order. A clause's matches
are summed by output; a document's features are sums, maxima and counts over
its matched clauses, and a small logistic model fitted on the labelled sample turns
them into a score. Words outside a matching clause count for nothing.

The learned trie: a stem is a prefix of 3 to 8 characters, or a whole word.
Spark counts, over the bounded labelled sample (``training.MAX_LABELLED``
documents), in how many toxic and other documents' words each occurs; the
entries that pass the odds and support tests are collected (at most
``MAX_STEMS``).

Defined cases: a null or empty text has no clause and gets the score of no
match; without labels the seed list and fixed weights are used; an empty table gives no rows; the whole text
is read, clause by clause, in time linear in it, so a very long text needs no more memory than its
longest clause; repeated rows get equal scores; further columns pass unchanged.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parallax.llm.training import held_out, training_texts
from parallax.session import free_arrow

THRESHOLD = 0.5  # fixed by the query's contract
SPAN = 3
NEG_SPAN = 3
WEAK_SPAN = 2
TRAIL = 2
THREAT_WEIGHT = 4.0
MIN_PREFIX, MAX_PREFIX = 3, 8
MAX_STEMS = 5000
MIN_TOTAL = 5            # words of documents that an entry must occur as
MIN_PRECISION = 0.8      # share of toxic among the documents' words with the stem, classes weighted equally
MIN_SURPRISE = 14.0      # nats above the base share: about one chance in a million

# Seed insults (whole words), lower case.
SEED_INSULTS = ["idiot", "idiots", "moron", "morons", "loser", "losers", "scum", "stupid", "pathetic", "worthless",
                "disgusting", "trash", "clown", "dumb", "imbecile", "dummkopf", "trottel", "abschaum", "crétin",
                "imbécile", "idiota", "estúpido", "basura", "imbécil"]
# Words of intent and words of harm.
INTENT = ["hope", "hopes", "wish", "wishes", "will", "gonna", "going", "shall", "should", "must", "i'll", "we'll", "werde", "werden", "vais", "allons",
          "voy", "vamos", "deserve", "deserves"]
HARM = ["kill", "hurt", "beat", "destroy", "die", "shoot", "stab", "burn", "töten", "umbringen", "verletzen", "tuer",
        "frapper", "mourir", "matar", "golpear", "morir"]
# Words that address or point at someone.
TARGET = ["you", "your", "you're", "ya", "u", "he's", "she's", "they're", "du", "dich", "dir", "dein", "ihr", "tu", "toi",
          "vous", "votre", "tú", "usted", "ustedes"]
# Negations, and weak ones.
NEGATION = ["not", "never", "isn't", "aren't", "wasn't", "weren't", "don't", "doesn't", "didn't", "won't", "can't", "cannot", "nobody", "nicht",
            "kein", "keine", "niemals", "pas", "jamais", "nunca", "tampoco"]
WEAK_NEGATION = ["no", "hardly", "barely", "scarcely", "kaum", "aucun", "aucune", "ningún", "ninguna"]
# Verbs of saying.
REPORTED = ["said", "says", "wrote", "claimed", "quoted", "quote", "according", "called", "sagte", "schrieb", "dit",
            "écrit", "dijo", "escribió"]
# Quotation marks (as words of their own) that open or close, only open, only close.
QUOTES, OPENING, CLOSING = ['"'], ["“", "„", "«"], ["”", "»"]

_CLAUSE = re.compile(r"[^.!?;\n]+")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[\"“„«”»]")

# Features of a document, in order.
FEATURES = ["plain_sum", "targeted_sum", "negated_sum", "reported_sum", "threat_sum", "clause_max", "n_clauses", "clause_mean",
            "second_max"]


@dataclass
class ToxicGrammar:
    """Weighted stems and words, and the logistic model over the document features."""

    prefixes: dict[str, float] = field(default_factory=dict)
    words: dict[str, float] = field(default_factory=lambda: dict.fromkeys(SEED_INSULTS, 3.0))
    weights: list[float] = field(default_factory=lambda: [0.4, 0.8, -0.1, 0.0, 1.2, 1.0, 0.6, 0.8, 0.2])
    bias: float = -3.0

    def pattern(self) -> re.Pattern:
        """Finds the places where a clause may hold an insult or a harm word, so that other clauses cost one scan."""
        stems = sorted(self.prefixes, key=len)
        short: list[str] = []
        for s in stems:  # a stem below another stem needs no branch of its own
            if not any(s.startswith(x) for x in short):
                short.append(s)
        whole = sorted({*self.words, *HARM})
        return re.compile(r"(?<![^\W_])(?:(?:" + _branches(whole) + r")(?![^\W_])" + (f"|(?:{_branches(short)})" if short else "") + ")")

    def insult(self, word: str) -> float:
        """Weight of the longest matching entry, 0 if none."""
        w = self.words.get(word, 0.0)
        if w:
            return w
        for n in range(min(MAX_PREFIX, len(word)), MIN_PREFIX - 1, -1):
            w = self.prefixes.get(word[:n], 0.0)
            if w:
                return w
        return 0.0


def _branches(words: list[str]) -> str:
    """The words as one alternation in the shape of a trie, so that a miss is found at its first characters."""
    root: dict = {}
    for w in words:
        node = root
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    def emit(node: dict) -> str:
        parts = [re.escape(c) + emit(sub) for c, sub in sorted(node.items()) if c]
        if not parts:
            return ""
        body = parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"
        return f"(?:{body})?" if "" in node else body

    return emit(root)


# The input symbols: negation, weak negation, reporting verb, intent, harm, target, quotation marks, insult, any other word.
CLASSES = {"g": NEGATION, "w": WEAK_NEGATION, "r": REPORTED, "n": INTENT, "h": HARM, "t": TARGET, "q": QUOTES, "(": OPENING, ")": CLOSING}
INSULT, OTHER = "i", "o"
SYMBOLS = [*CLASSES, INSULT, OTHER]
_CLASS = {word: symbol for symbol, words in reversed(CLASSES.items()) for word in words}
Arcs = dict[tuple[object, str], object]  # (state, symbol) -> next state; a machine starts in state 0


def _countdown(opens: dict[str, object], spans: dict[object, int], closes: dict[object, str] | None = None) -> Arcs:
    """A scope of so many words: ``opens`` names the scope that a symbol opens, ``spans`` its length; state (scope, words left)."""
    states = [0, *((scope, k) for scope, n in spans.items() for k in range(1, n + 1))]
    arcs: Arcs = {}
    for state in states:
        for x in SYMBOLS:
            if x in opens:
                arcs[state, x] = (opens[x], spans[opens[x]])
            elif state == 0 or state[1] == 1 or x in (closes or {}).get(state[0], ""):
                arcs[state, x] = 0
            else:
                arcs[state, x] = (state[0], state[1] - 1)
    return arcs


def negation_arcs() -> Arcs:
    return _countdown({"g": "strong", "w": "weak"}, {"strong": NEG_SPAN, "weak": WEAK_SPAN}, {"weak": "t"})


def threat_arcs() -> Arcs:
    return _countdown({"n": "intent"}, {"intent": SPAN})


def target_arcs() -> Arcs:
    return _countdown({"t": "near"}, {"near": SPAN})


def report_arcs() -> Arcs:
    """States: 0, ``said`` (after a verb), ``quoted``, and ("after", k): k more words in which a verb belongs to the quotation before."""
    arcs: Arcs = {}
    after = [("after", k) for k in range(1, SPAN + 1)]
    for state in (0, "said", "quoted", *after):
        for x in SYMBOLS:
            if state == "quoted":
                arcs[state, x] = after[-1] if x in "q)" else "quoted"
            elif x in "q(":
                arcs[state, x] = "quoted"
            elif state in after:
                arcs[state, x] = 0 if x == "r" or state[1] == 1 else ("after", state[1] - 1)
            else:
                arcs[state, x] = "said" if x == "r" else state
    return arcs


def trailing_arcs() -> Arcs:
    """From the right. States: 0, ("end", k): k words read and a verb may still trail; ``past``; ``said``: left of such a verb."""
    end = [("end", k) for k in range(1, TRAIL + 1)]
    arcs: Arcs = {}
    for state in (0, *end, "past", "said"):
        for x in SYMBOLS:
            if x in "q()":
                arcs[state, x] = "past"
            elif state == "said" or state == "past":
                arcs[state, x] = state
            elif x == "r":
                arcs[state, x] = "said"
            else:
                k = state[1] if state else 0
                arcs[state, x] = end[k] if k < TRAIL else "past"
    return arcs


def _product(machines: list[Arcs]) -> tuple[list[tuple], dict[str, list[int]]]:
    """The states of the machines' product that can be reached, the start first, and for each symbol the table of next states."""
    start = tuple(0 for _ in machines)
    number, states, arcs = {start: 0}, [start], {x: [] for x in SYMBOLS}
    for state in states:  # grows
        for x in SYMBOLS:
            nxt = tuple(m[part, x] for m, part in zip(machines, state, strict=True))
            if nxt not in number:
                number[nxt] = len(states)
                states.append(nxt)
            arcs[x].append(number[nxt])
    return states, arcs


@lru_cache(1)
def compose() -> tuple[dict[str, list[int]], dict[str, list[int]], list[list[tuple[str, str]]]]:
    """The composed grammar: the next-state tables from the left and from the right, and for each pair of states the outputs
    of a word of harm with an intent and of an insult; both states are those before the word."""
    left_states, left = _product([negation_arcs(), threat_arcs(), target_arcs(), report_arcs()])
    right_states, right = _product([target_arcs(), trailing_arcs()])

    def output(a: tuple, b: tuple, kind: str) -> str:
        negated, _, near_left, said = a
        near_right, trailing = b
        if said in ("said", "quoted") or trailing == "said":
            return "reported"
        if negated:
            return "negated"
        return "targeted" if kind == "plain" and (near_left or near_right) else kind

    out = [[(output(a, b, "threat") if a[1] else "", output(a, b, "plain")) for b in right_states] for a in left_states]
    return left, right, out


def match_clause(g: ToxicGrammar, words: list[str]) -> list[tuple[str, float, str]]:
    """(output, weight, word) of every insult and threat of a clause, by one pass from either side of the composed machine."""
    left, right, out = compose()
    weights = [0.0 if w in _CLASS and _CLASS[w] != "h" else g.insult(w) for w in words]
    symbols = [_CLASS.get(w) or (INSULT if weights[k] else OTHER) for k, w in enumerate(words)]
    after, state = [0] * len(words), 0
    for k in range(len(words) - 1, -1, -1):
        after[k] = state
        state = right[symbols[k]][state]
    found, state = [], 0
    for k, x in enumerate(symbols):
        if x == "h" or x == INSULT:
            threat, plain = out[state][after[k]]
            if x == "h" and threat:
                found.append((threat, THREAT_WEIGHT, words[k]))
            elif weights[k]:
                found.append((plain, weights[k], words[k]))
        state = left[x][state]
    return found


def matches(g: ToxicGrammar, text: str | None, pattern: re.Pattern | None = None) -> Iterator[tuple[int, int, list]]:
    """(start, end, matches) of every clause that matches, in order."""
    t = (text or "").lower()
    pattern = pattern or g.pattern()
    done = -1
    for hit in pattern.finditer(t):
        if hit.start() < done:
            continue
        # the clause around the hit; the last one's end is where this one starts at the earliest
        start = max(t.rfind(c, max(done, 0), hit.start()) for c in ".!?;\n") + 1
        clause = _CLAUSE.match(t, start)
        done = clause.end()
        found = match_clause(g, _WORD.findall(t, start, done))
        if found:
            yield start, done, found


def features(g: ToxicGrammar, text: str | None, pattern: re.Pattern | None = None) -> list[float]:
    """The document's features, in the order of FEATURES; sums are damped by log(1 + x)."""
    sums = dict.fromkeys(("plain", "targeted", "negated", "reported", "threat"), 0.0)
    clauses: list[float] = []
    for _, _, found in matches(g, text, pattern):
        clause = 0.0
        for kind, w, _ in found:
            sums[kind] += w
            clause += w if kind in ("plain", "targeted", "threat") else 0.0
        clauses.append(clause)
    best = sorted(clauses, reverse=True)[:2] + [0.0, 0.0]
    return [*(math.log1p(sums[k]) for k in ("plain", "targeted", "negated", "reported", "threat")), math.log1p(best[0]),
            math.log1p(len(clauses)), sum(clauses) / max(1, len(clauses)), math.log1p(best[1])]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.002, steps: int = 50) -> tuple[list[float], float]:
    """Ridge logistic regression by Newton steps."""
    a = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.full(len(y), 1 / len(y))
    reg = np.append(np.full(x.shape[1], ridge), 1e-6)
    b = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        grad = a.T @ (w * (p - y)) + reg * b
        hess = (a * (w * p * (1 - p))[:, None]).T @ a + np.diag(reg + 1e-9)
        step = np.linalg.solve(hess, grad)
        b -= step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-7:
            break
    return [float(v) for v in b[:-1]], float(b[-1])


def learn_stems(sample: DataFrame) -> ToxicGrammar:
    """The weighted trie, from (text, label): counted by Spark, at most MAX_STEMS entries collected."""
    n = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    g = ToxicGrammar()
    if not n1 or not n0:
        return g
    token = F.explode(F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+"))).alias("word")
    words = (sample.select("label", token).filter(F.length("word").between(1, 64))
             .groupBy("word").agg(F.sum("label").alias("tox"), F.sum(1 - F.col("label")).alias("clean")))
    stems = F.transform(F.sequence(F.lit(MIN_PREFIX), F.least(F.length("word"), F.lit(MAX_PREFIX))),
                        lambda k: F.substring("word", F.lit(1), k))
    entries = F.when(F.length("word") >= MIN_PREFIX, F.concat(F.array(F.concat("word", F.lit("$"))), stems)).otherwise(
        F.array(F.concat("word", F.lit("$"))))
    tox, clean = F.col("tox"), F.col("clean")
    # classes weighted equally, smoothed by half a document
    a, b = (tox + 0.5) / (n1 + 1.0), (clean + 0.5) / (n0 + 1.0)
    # how far the entry's toxic share lies above the base share: n * KL divergence, in nats
    base, share = n1 / (n1 + n0), tox / (tox + clean)
    surprise = tox * F.log(share / base) + F.when(clean > 0, clean * F.log((1 - share) / (1 - base))).otherwise(0.0)
    counted = (words.select(F.explode(entries).alias("entry"), "tox", "clean")
               .groupBy("entry").agg(F.sum("tox").alias("tox"), F.sum("clean").alias("clean"))
               .filter(tox + clean >= MIN_TOTAL)
               .select("entry", "tox", "clean", (a / (a + b)).alias("precision"), surprise.alias("surprise")))
    sure = (F.col("precision") >= MIN_PRECISION) & (F.col("surprise") >= MIN_SURPRISE) & (share > base)
    stems_found = counted.filter(sure).orderBy(F.desc("surprise"), "entry").limit(MAX_STEMS).collect()
    accepted: dict[str, tuple] = {}
    for r in sorted(stems_found, key=lambda r: (len(r["entry"]), r["entry"])):
        accepted[r["entry"]] = (r["tox"], r["clean"])
    # a stem is dropped where a longer one holds nearly all of its toxic words and fewer clean ones
    looser = {e[:k] for e, (t, c) in accepted.items() for k in range(MIN_PREFIX, len(e))
              if e[:k] in accepted and accepted[e[:k]][1] > c and t >= 0.9 * accepted[e[:k]][0]}
    accepted = {e: v for e, v in accepted.items() if e not in looser}
    if not accepted:
        return g
    # longer entries below an accepted stem get weights of their own, shrunk towards the stem's
    roots = [e for e in accepted if e[-1] != "$" and not any(e[:k] in accepted for k in range(MIN_PREFIX, len(e)))]
    below = []
    if roots:
        under = F.lit(False)
        for k in sorted({len(r) for r in roots}):
            under = under | F.substring("entry", 1, k).isin([r for r in roots if len(r) == k])
        below = counted.filter(under).orderBy(F.desc(tox + clean), "entry").limit(MAX_STEMS).collect()
    counts = {r["entry"]: (r["tox"], r["clean"]) for r in below} | accepted

    def odds(entry: str) -> float:
        t, c = counts[entry]
        parent = max((entry[:k] for k in range(MIN_PREFIX, len(entry)) if entry[:k] in counts and entry[:k] not in looser), key=len, default="")
        prior = 2 * math.tanh(odds(parent) / 2) if parent else 0.0
        return math.log((t + 1 + max(0.0, prior)) / (n1 + 1)) - math.log((c + 1 - min(0.9, max(0.0, prior) / 2.5)) / (n0 + 1))

    for e in counts:
        if e not in looser:
            (g.words if e[-1] == "$" else g.prefixes)[e.rstrip("$")] = max(0.05, odds(e))
    return g


def _feature_batches(batches: Iterator, g: ToxicGrammar, text_at: int, keep: int) -> Iterator:
    """For ``mapInArrow``: the first ``keep`` columns as they came, then the features of column ``text_at``."""
    import pyarrow as pa

    pattern = g.pattern()
    for batch in batches:
        x = np.array([features(g, t.as_py(), pattern) for t in batch.column(text_at)], float).reshape(-1, len(FEATURES))
        yield pa.RecordBatch.from_arrays([*batch.columns[:keep], *(pa.array(np.ascontiguousarray(c)) for c in x.T)],
                                         names=[*batch.schema.names[:keep], *FEATURES])
        free_arrow()


def with_features(docs: DataFrame, g: ToxicGrammar, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (by position while in Python, so any names are safe; the text goes once) and the features as ``_tox_*``."""
    keep = keep or []
    at = keep.index(text_col) if text_col in keep else len(keep)
    src = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate([*keep, *([] if text_col in keep else [text_col])])])
    schema = T.StructType([T.StructField(f"_k{i}", docs.schema[c].dataType) for i, c in enumerate(keep)]
                          + [T.StructField(f, T.DoubleType()) for f in FEATURES])
    out = src.mapInArrow(partial(_feature_batches, g=g, text_at=at, keep=len(keep)), schema)
    return out.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], *[F.col(f).alias(f"_tox_{f}") for f in FEATURES])


def score_column(g: ToxicGrammar):
    z = F.lit(g.bias)
    for f, w in zip(FEATURES, g.weights, strict=True):
        z = z + F.col(f"_tox_{f}") * F.lit(float(w))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def train_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> ToxicGrammar:
    """Learns the trie and the model from the labelled documents outside the held-out fold (a bounded sample)."""
    sample = training_texts(docs, labels, label).persist()
    try:
        g = learn_stems(sample)
        rows = with_features(sample, g, "text", ["label"]).toPandas()  # bounded by training.MAX_LABELLED
    finally:
        sample.unpersist()
    y = rows["label"].to_numpy(int)
    if len(np.unique(y)) == 2:
        x = rows[[f"_tox_{f}" for f in FEATURES]].to_numpy(float)
        order = np.lexsort((*x.T, y))
        g.weights, g.bias = fit_logistic(x[order], y[order].astype(float))
    return g


def score_toxicity(docs: DataFrame, g: ToxicGrammar, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    f = with_features(docs, g, text_col, [id_col])
    return (f.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), score_column(g).alias("score"))
            .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")))


def toxicity_filter(docs: DataFrame, g: ToxicGrammar, text_col: str = "text") -> DataFrame:
    """The documents that are not rejected, all columns kept."""
    names = docs.columns
    f = with_features(docs, g, text_col, names)
    return f.filter(score_column(g) < THRESHOLD).select(*names)


def clause_matches(docs: DataFrame, g: ToxicGrammar, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per matched clause: doc_id, start, end (code points of the lower-cased text), outputs, weight."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        pattern = g.pattern()
        for pdf in batches:
            rows = [(i, a, b, [k for k, _, _ in m], float(sum(w for k, w, _ in m if k not in ("negated", "reported"))))
                    for i, t in zip(pdf["_i"], pdf["_t"], strict=True) for a, b, m in matches(g, t, pattern)]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "end", "symbols", "weight"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("_i"), F.col(text_col).alias("_t")).mapInPandas(
        run, f"doc_id {kind}, start long, end long, symbols array<string>, weight double")
