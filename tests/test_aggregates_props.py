import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from parallax.operators.train import average_parameters
from parallax.plans.bench import summarise_runs

_run = st.tuples(st.sampled_from(["a", "b", "c"]), st.integers(0, 10**6), st.integers(0, 10**12))


@settings(max_examples=20, deadline=None)
@given(st.lists(_run, min_size=1, max_size=30))
def test_summarise_runs_matches_python(spark, runs):
    rows = [(name, i, n, ns) for i, (name, n, ns) in enumerate(runs)]
    df = spark.createDataFrame(rows, "name string, iteration int, n_records bigint, ns bigint")
    got = {r.name: r for r in summarise_runs(df).collect()}
    for name in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == name]
        n, ns = sum(r[2] for r in mine), sum(r[3] for r in mine)
        g = got[name]
        assert g.runs == len(mine) and g.n_records == n and g.total_ms == ns // 1_000_000
        assert g.mean_ns_per_record == (ns // n if n else None)


@settings(max_examples=20, deadline=None)
@given(st.integers(1, 6), st.integers(1, 12), st.randoms(use_true_random=False))
def test_average_parameters_matches_numpy(spark, workers, width, rnd):
    params = [[rnd.uniform(-5, 5) for _ in range(width)] for _ in range(workers)]
    weights = [rnd.randint(1, 1000) for _ in range(workers)]
    df = spark.createDataFrame(list(zip(params, weights)), "params array<double>, n bigint")
    got = np.array([r.value for r in average_parameters(df).orderBy("pos").collect()])
    want = (np.array(params) * np.array(weights)[:, None]).sum(axis=0) / sum(weights)
    assert got.shape == (width,) and np.allclose(got, want, rtol=1e-12, atol=1e-12)
