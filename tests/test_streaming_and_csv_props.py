import csv
import io
import os

from hypothesis import given, settings
from hypothesis import strategies as st

from data_dirs import SF001
from parallax.fixtures import net_price_records, read_table, relu_2_3_1
from parallax.operators.examples import key_examples, to_examples
from parallax.operators.score import score_batched, score_expr
from parallax.sources.csv import parse_lines


def test_scoring_applies_unchanged_to_a_stream(spark, tmp_dir):
    """The scoring projection is stateless: the same function scores a
    streaming DataFrame (file source -> memory sink) with batch results."""
    li = read_table(spark, SF001, "lineitem")
    src = os.path.join(tmp_dir, "src")
    li.write.parquet(src)  # a file source streams a directory
    stream = spark.readStream.schema(li.schema).parquet(src)

    def pipeline(df):
        return score_expr(key_examples(to_examples(net_price_records(df), ["x1", "x2"], ["y"], id_cols=["x1", "x2", "y"])), relu_2_3_1())

    q = (pipeline(stream).writeStream.format("memory").queryName("scored_stream")
         .option("checkpointLocation", os.path.join(tmp_dir, "ckpt")).start())
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = sorted((r.row_id, r.prediction[0]) for r in spark.sql("SELECT * FROM scored_stream").collect())
    want = sorted((r.row_id, r.prediction[0]) for r in pipeline(li).collect())
    assert got == want

    # the Arrow-batched form too (a pandas UDF in a micro-batch)
    batched = score_batched(key_examples(to_examples(net_price_records(stream), ["x1", "x2"], ["y"])),
                            relu_2_3_1(), 512)
    q = (batched.writeStream.format("memory").queryName("scored_stream_b")
         .option("checkpointLocation", os.path.join(tmp_dir, "ckpt_b")).start())
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got_b = sorted((r.row_id, r.prediction[0]) for r in spark.sql("SELECT * FROM scored_stream_b").collect())
    assert got_b == want


_cell = st.one_of(
    st.floats(allow_nan=False, allow_infinity=False, width=32).map(repr),
    st.integers(-10**6, 10**6).map(str),
    st.sampled_from(["x", "", "1e", "--1", "a b"]),
)


def _expected(line, width):
    cells = next(csv.reader(io.StringIO(line)))
    if len(cells) != width:
        return None
    try:
        return tuple(float(c) for c in cells)
    except ValueError:
        return None


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(_cell, min_size=1, max_size=5), min_size=1, max_size=30))
def test_good_bad_split_matches_a_plain_csv_reading(spark, rows):
    lines = [",".join(r) for r in rows]
    lines = [l for l in lines if l.strip()]
    if not lines:
        return
    got = parse_lines(spark.createDataFrame([(l,) for l in lines], "value string"), 3).collect()
    want_good = sorted(e for e in (_expected(l, 3) for l in lines) if e is not None)
    got_good = sorted((r.c0, r.c1, r.c2) for r in got if r._bad is None)
    assert got_good == want_good
    assert len(got) == len(lines)


def test_non_finite_and_non_decimal_fields_are_bad_records(spark):
    bad = ["NaN,1,2", "1,Infinity,2", "1,2,-Infinity", "1d,2,3", "1,2F,3", "1e400,2,3", "0x1p3,1,2", "1,,2", "inf,1,2"]
    good = ["1,2,3", "1e2,-2.5,+3", "1E-3,0.5,.5", " 1,2,3"]
    df = parse_lines(spark.createDataFrame([(x,) for x in bad + good], "value string"), 3)
    rows = df.collect()
    assert [r._bad for r in rows] == bad + [None] * len(good)
    assert all((r.c0 is None) == (r._bad is not None) for r in rows)
