"""Line dedup: a log-template tree over lines; recurring templates are dropped.

DataFrame functions only.

1. Each text is cut into lines at ``\\n``; a line, less the spaces around it, into
   words at each space. A word with a digit is a variable field, ``<*>``.
2. Fixed-depth tree: the leaf of a line is its word count and its first
   ``DEPTH`` words (masked). Lines in leaves seen in fewer than ``MIN_DOCS``
   documents cannot recur and go no further.
3. In a leaf, a word that is in its place in fewer than T documents' lines is a
   variable field too. What is left is the line's template. T is ``MIN_DOCS``
   times each power of four, so the values of a field may be as frequent as the
   corpus makes them: a template whose fields' values are each in less than a
   quarter of its documents has a T between those values and its constant words,
   and one of few documents in a large leaf has its own.
4. A template recurs if lines of T documents or more have it and at least
   ``MIN_CONSTANT`` of its words are constant, and as much of those after the
   leaf's leading words, which all its lines share. Its lines are dropped from every document but the one with the smallest id, which keeps its first line
   of the template: a passage stays in the corpus once, and of a group of
   copies one document stays whole. Of a line's templates the most general
   counts; the others' lines are all among its own.

Beside the templates there is an exact route: a line of ``LONG_WORDS`` words or more
that ``LONG_DOCS`` documents or more have word for word stays in the one with the
smallest id. ``drop_recurring_lines`` takes it with ``long_lines``; ``drop_repeated_passages``
is that route alone. The pipeline runs it after its near-duplicate join: before, a whole copy would be left
over as its short lines, and no longer be a copy.

Blank lines and lines of fewer than ``MIN_WORDS`` words are never dropped: such
lines recur in ordinary prose by chance.

Scale: lines are counted by hash, with partial aggregation, so a line that a
third of all documents share is one row per task; only words of lines in
recurring leaves are counted, once per different line. Lines travel as hashes;
the lines that move are one of each kind in a recurring leaf, the texts that move those
that lose lines (a bounded sieve keeps the others out of the shuffles). The sides of a join by template
are written first, so that a hot template's can be split. All work on a text is linear in its lines.

Defined cases: a null text counts as empty and comes out empty, with no
lines; a text that loses all its lines comes out empty; an empty table gives
an empty result; equal rows (same id, same text) are one document for
counting, and each comes out with the same lines; a null id ranks before all
others; very long texts are read whole; further columns are not read by ``line_templates`` and pass
``drop_recurring_lines`` unchanged, whatever their names (but for ``_n_lines`` and ``_n_dropped``, which it sets).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parallax.llm.components import free_names, mark_possible, sieve
from parallax.session import scratch_path

DEPTH = 3
MIN_DOCS = 5
MIN_CONSTANT = 0.6
MIN_WORDS = 3
LONG_WORDS = 20
LONG_DOCS = 2
FIELD = "<*>"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _mask(line: Column) -> Column:
    """The trimmed line, every word with a digit a field."""
    t = F.trim(line)
    return F.when(t.rlike("[0-9]"), F.regexp_replace(t, "[^ ]*[0-9][^ ]*", FIELD)).otherwise(t)


def _located(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, th, t): ``th`` tells texts of one id apart."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(t).alias("th"), t.alias("t"))


def _line_keys(docs: DataFrame, id_col: str, text_col: str, depth: int, min_words: int) -> DataFrame:
    """(doc_id, th, pos, leaf, lh) of the lines long enough to be templates: (leaf, lh) is the line's 128-bit hash."""
    lines = _located(docs, id_col, text_col).select("doc_id", "th", F.posexplode(_lines(F.col("t"))).alias("pos", "line"))
    lines = lines.withColumn("m", _mask(F.col("line"))).withColumn("words", F.split("m", " "))
    return (lines.filter(F.size("words") >= min_words)
            .select("doc_id", "th", "pos", F.xxhash64(F.size("words"), F.slice("words", 1, depth)).alias("leaf"),
                    F.xxhash64(F.lit(1), "m").alias("lh")))


def line_templates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH,
                   min_docs: int = MIN_DOCS, min_constant: float = MIN_CONSTANT, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, th, pos, template, n_docs, dropped): every line of a recurring template."""
    spark = docs.sparkSession

    def settle(df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, f"line-dedup-{name}")
        df.write.parquet(path)
        return spark.read.parquet(path)

    keys = settle(_line_keys(docs, id_col, text_col, depth, min_words), "keys")
    # leaves of at least min_docs documents: distinct (leaf, document) first, so a hot leaf is spread
    leaves = (keys.groupBy("leaf", "doc_id", "th").agg(F.count(F.lit(1)).alias("c"))
              .groupBy("leaf").agg(F.count(F.lit(1)).alias("nd")).filter(F.col("nd") >= min_docs).select("leaf"))
    # written first: the join's sides are then plain scans, of which a hot leaf's can be split
    known = settle(keys.join(settle(leaves, "leaves"), "leaf", "left_semi"), "known")
    # different lines, with the number of documents that have them and one place each
    variants = (known.groupBy("leaf", "lh", "doc_id", "th").agg(F.min("pos").alias("pos"))
                .groupBy("leaf", "lh").agg(F.count(F.lit(1)).alias("nd"), F.min(F.struct("doc_id", "th", "pos")).alias("at")))
    # one line of each kind, found again by its place
    places = settle(variants.select(F.col("at.doc_id").alias("d"), F.col("at.th").alias("h"), F.col("at.pos").alias("p"), "leaf", "lh", "nd")
                    .withColumn("key", F.xxhash64("d", "h", "p")), "places")
    lines = (sieve(_located(docs, id_col, text_col), "doc_id", places.select("d").distinct(), "d")
             .select("doc_id", "th", F.posexplode(_lines(F.col("t"))).alias("pos", "line")))
    lines = sieve(lines.withColumn("at", F.xxhash64("doc_id", "th", "pos")), "at", places, "key")
    distinct_lines = (lines.join(places, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h")) & (F.col("pos") == F.col("p")))
                      .select("leaf", "lh", "nd", F.split(_mask(F.col("line")), " ").alias("words"))
                      .dropDuplicates(["leaf", "lh"]).withColumn("n", F.size("words")))  # equal rows give a line twice
    distinct_lines = settle(distinct_lines, "lines")
    by_word = distinct_lines.select("leaf", "lh", "nd", "n", F.posexplode("words").alias("p", "word"))
    support = by_word.distinct().groupBy("leaf", "p", "word").agg(F.sum("nd").alias("support"))
    # a word's level: the largest v with min_docs * 4^v <= support; below min_docs, or masked, it is -1
    level = F.when((F.col("support") >= min_docs) & (F.col("word") != FIELD),
                   F.floor((F.length(F.bin(F.floor(F.col("support") / min_docs).cast("long"))) - 1) / 2).cast("int")).otherwise(-1)
    placed = by_word.join(support, ["leaf", "p", "word"]).withColumn("v", level)
    # a line's templates, one for each level of its words: the words of that level or above in their places;
    # ``low`` is the lowest level that gives the same words. Collected per line, so bounded by the line
    constant = F.filter("at", lambda x: x["v"] >= F.col("v"))
    templates = (placed.groupBy("leaf", "lh").agg(
        F.max("n").alias("n"), F.array_sort(F.collect_set("v")).alias("vs"),
        F.array_sort(F.collect_list(F.when(F.col("v") >= 0, F.struct("p", "word", "v")))).alias("at"))
        .select("leaf", "lh", "n", "vs", "at", F.explode(F.filter("vs", lambda v: v >= 0)).alias("v"))
        .withColumn("fixed", F.transform(constant, lambda x: F.struct(x["p"].alias("p"), x["word"].alias("word"))))
        .filter(F.size("fixed") >= min_constant * F.col("n"))
        # the leaf's own words are the same in all its lines and tell nothing
        .filter(F.size(F.filter("fixed", lambda x: x["p"] >= depth)) >= min_constant * F.greatest(F.col("n") - depth, F.lit(0)))
        .select("leaf", "lh", "v", (F.coalesce(F.array_max(F.filter("vs", lambda v: v < F.col("v"))), F.lit(-1)) + 1).alias("low"),
                F.md5(F.concat_ws("\x1f", F.col("leaf"), F.col("n"), F.to_json("fixed"))).alias("template")))
    templates = settle(templates, "templates")
    lines = settle(known.distinct().join(templates, ["leaf", "lh"]).select("doc_id", "th", "pos", "template", "v", "low"), "candidates")
    counted = settle(lines.groupBy("template", "doc_id", "th").agg(F.min("pos").alias("pos"), F.min("low").alias("low"))
               .groupBy("template").agg(F.count(F.lit(1)).alias("n_docs"), F.min("low").alias("low"),
                                        F.min(F.struct("doc_id", "th", "pos")).alias("first"))
               .filter(F.col("n_docs") >= min_docs * F.call_function("shiftleft", F.lit(1).cast("long"), 2 * F.col("low"))), "counted")
    first = (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th"))
             & (F.col("pos") == F.col("first.pos")))
    # a line's most general recurring template; the first line of that is the first of the line's others too
    found = lines.drop("low").join(counted.drop("low"), "template").withColumn("dropped", ~first)
    return (found.groupBy("doc_id", "th", "pos").agg(F.max_by(F.struct("template", "n_docs", "dropped"), "v").alias("m"))
            .select("doc_id", "th", "pos", "m.template", "m.n_docs", "m.dropped"))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = LONG_WORDS,
                      min_docs: int = LONG_DOCS) -> DataFrame:
    """(doc_id, th, pos, n_docs, dropped): every long line that several documents have word for word."""
    spark = docs.sparkSession
    path = scratch_path(spark, "line-dedup-passages")
    lines = _located(docs, id_col, text_col).select("doc_id", "th", F.posexplode(_lines(F.col("t"))).alias("pos", "line"))
    (lines.withColumn("m", F.trim("line")).filter(F.size(F.array_remove(F.split("m", " "), "")) >= min_words)
     .select("doc_id", "th", "pos", F.xxhash64("m").alias("h"), F.xxhash64(F.lit(1), "m").alias("h2")).write.parquet(path))
    keys = spark.read.parquet(path)
    counted = (keys.groupBy("h", "h2", "doc_id", "th").agg(F.min("pos").alias("pos"))
               .groupBy("h", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.min(F.struct("doc_id", "th", "pos")).alias("first"))
               .filter(F.col("n_docs") >= min_docs))
    first = (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th"))
             & (F.col("pos") == F.col("first.pos")))
    return keys.join(counted, ["h", "h2"]).select("doc_id", "th", "pos", "n_docs", (~first).alias("dropped")).distinct()


def drop_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", long_lines: bool = False, **settings) -> DataFrame:
    """Every input row with its text less the lines of recurring templates (and, with ``long_lines``, of repeated
    passages), ``_n_lines`` and ``_n_dropped`` added."""
    found = line_templates(docs, id_col, text_col, **settings).select("doc_id", "th", "pos", "dropped")
    if long_lines:
        found = found.unionAll(repeated_passages(docs, id_col, text_col).select("doc_id", "th", "pos", "dropped"))
    return _without(docs, found, id_col, text_col)


def drop_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """Every input row with its text less the long lines that an earlier id has, ``_n_lines`` and ``_n_dropped`` added."""
    return _without(docs, repeated_passages(docs, id_col, text_col, **settings), id_col, text_col)


def _without(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every input row with its text less the lines dropped in ``found``, ``_n_lines`` and ``_n_dropped`` added."""
    spark = docs.sparkSession
    path = scratch_path(spark, "line-dedup-drops")
    number, text_hash, d, th, gone, mark, split = free_names(docs, "_id", "_h", "_d", "_th", "_pos", "_maybe", "_lines")
    (found.filter("dropped")
     .groupBy(F.col("doc_id").alias(d), F.col("th").alias(th)).agg(F.collect_set("pos").alias(gone)).write.parquet(path))
    drops = spark.read.parquet(path)
    # documents that surely lose no line pass without a shuffle
    t = F.coalesce(F.col(text_col), F.lit(""))
    marked = mark_possible(docs.withColumns({number: F.col(id_col), text_hash: F.xxhash64(t)}), number, drops, d, mark)
    stay = marked.filter(~F.col(mark)).withColumn(gone, F.lit(None).cast("array<int>"))
    asked = marked.filter(F.col(mark))
    asked = asked.join(drops, F.col(number).eqNullSafe(F.col(d)) & (F.col(text_hash) == F.col(th)), "left")
    out = stay.select(*docs.columns, gone).unionAll(asked.select(*docs.columns, gone)).withColumn(split, F.split(t, "\n", -1))
    # the places that go are taken from all places by a set, so the work is linear in the lines
    places = F.sequence(F.lit(0), F.size(split) - 1)
    stays = F.array_sort(F.array_except(places, F.col(gone)))
    kept = F.array_join(F.transform(stays, lambda i: F.get(F.col(split), i)), "\n")
    own = [c for c in docs.columns if c not in ("_n_lines", "_n_dropped")]
    return out.select(*[F.when(F.col(gone).isNull(), t).otherwise(kept).alias(c) if c == text_col else F.col(c) for c in own],
                      F.when(t == "", 0).otherwise(F.size(split)).cast("long").alias("_n_lines"),
                      F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("_n_dropped"))


# The whole rule in DuckDB SQL, long lines included; the numbers are the module's settings.
_KEY = "doc_id, text, pos"
ORACLE = f"""
WITH t AS (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM t),
m AS (SELECT {_KEY}, string_split(regexp_replace(trim(line, ' '), '[^ ]*[0-9][^ ]*', '{FIELD}', 'g'), ' ') AS words FROM l),
k AS (SELECT {_KEY}, words, [len(words)::VARCHAR] || words[1:{DEPTH}] AS leaf FROM m WHERE len(words) >= {MIN_WORDS}),
lf AS (SELECT leaf FROM (SELECT DISTINCT leaf, doc_id, text FROM k) GROUP BY leaf HAVING count(*) >= {MIN_DOCS}),
r AS (SELECT k.* FROM k SEMI JOIN lf USING (leaf)),
kind AS (SELECT row_number() OVER () AS line_no, leaf, words, count(*) AS nd FROM (SELECT DISTINCT leaf, words, doc_id, text FROM r) GROUP BY leaf, words),
w AS (SELECT line_no, leaf, nd, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM kind),
s AS (SELECT leaf, p, word, sum(nd)::BIGINT AS support FROM w GROUP BY leaf, p, word),
placed AS (SELECT line_no, leaf, word, p, CASE WHEN support >= {MIN_DOCS} AND word <> '{FIELD}' THEN (length(bin(support // {MIN_DOCS})) - 1) // 2 ELSE -1 END AS v
           FROM w JOIN s USING (leaf, p, word)),
vs AS (SELECT DISTINCT line_no, v FROM placed),
level AS (SELECT a.line_no, a.v, coalesce(max(b.v), -1) + 1 AS low FROM vs a LEFT JOIN vs b ON a.line_no = b.line_no AND b.v < a.v
          WHERE a.v >= 0 GROUP BY a.line_no, a.v),
tp AS (SELECT line_no, leaf, level.v, low, list(CASE WHEN placed.v >= level.v THEN word END ORDER BY p) AS template
       FROM placed JOIN level USING (line_no) GROUP BY line_no, leaf, level.v, low
       HAVING count(*) FILTER (WHERE placed.v >= level.v) >= {MIN_CONSTANT}::DOUBLE * count(*)
          AND count(*) FILTER (WHERE placed.v >= level.v AND p > {DEPTH}) >= {MIN_CONSTANT}::DOUBLE * greatest(count(*) - {DEPTH}, 0)),
q AS (SELECT {_KEY}, tp.leaf, template, v, low FROM r JOIN kind ON r.leaf = kind.leaf AND r.words = kind.words JOIN tp USING (line_no)),
c AS (SELECT leaf, template, min(doc_id) AS first_doc FROM (SELECT leaf, template, doc_id, text, min(low) AS low FROM q GROUP BY ALL)
      GROUP BY leaf, template HAVING count(*) >= {MIN_DOCS} * (4 ** min(low))::BIGINT),
f AS (SELECT leaf, template, first_doc, min(pos) AS first_pos FROM q JOIN c USING (leaf, template) WHERE doc_id = first_doc GROUP BY ALL),
x AS (SELECT {_KEY}, max_by(NOT (doc_id = first_doc AND pos = first_pos), v) AS dropped FROM q JOIN f USING (leaf, template) GROUP BY {_KEY}),
long AS (SELECT {_KEY}, trim(line, ' ') AS body FROM l WHERE len(list_filter(string_split(trim(line, ' '), ' '), lambda y: y <> '')) >= {LONG_WORDS}),
lc AS (SELECT body, min(doc_id) AS first_doc FROM (SELECT DISTINCT body, doc_id, text FROM long) GROUP BY body HAVING count(*) >= {LONG_DOCS}),
ln AS (SELECT body, first_doc, min(pos) AS first_pos FROM long JOIN lc USING (body) WHERE doc_id = first_doc GROUP BY ALL),
gone AS (SELECT {_KEY} FROM x WHERE dropped UNION SELECT {_KEY} FROM long JOIN ln USING (body) WHERE NOT (doc_id = first_doc AND pos = first_pos)),
o AS (SELECT l.doc_id, l.text, string_agg(CASE WHEN gone.pos IS NULL THEN l.line END, chr(10) ORDER BY l.pos) AS kept,
             count(*) AS n_lines, count(gone.pos) AS n_dropped
      FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.text = gone.text AND l.pos = gone.pos GROUP BY l.doc_id, l.text)
SELECT d.doc_id, coalesce(o.kept, '') AS text, CASE WHEN o.text = '' THEN 0 ELSE n_lines END AS n_lines, n_dropped
FROM documents d JOIN o ON d.doc_id = o.doc_id AND coalesce(d.text, '') = o.text
"""
