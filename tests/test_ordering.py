"""The distributed ordering path must equal brute force on skewed groups with heavy ties."""

import numpy as np
import pandas as pd
import pytest

from panelspark.operators.ordering import average_rank_pcts, exact_quantiles, ordinal, running_sum
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(3)
    n = 900
    g = np.where(rng.random(n) < 0.6, "hot", rng.choice(["a", "b", "c"], n))
    v = np.where(rng.random(n) < 0.35, 1.5, rng.normal(size=n).round(2))
    v[::37] = np.nan
    return pd.DataFrame({"g": g, "t": [f"T{i:04d}" for i in rng.permutation(n)], "v": v})


def load(spark, frame):
    return spark.createDataFrame(frame.astype(object).where(frame.notna(), None), "g STRING, t STRING, v DOUBLE")


def test_ordinal(spark, frame):
    df = load(spark, frame).filter("v is not null")
    got = ordinal(df, ["g"], [F.col("v").desc(), F.col("t")], "rn", "n").toPandas().set_index("t")
    want = frame.dropna().sort_values(["v", "t"], ascending=[False, True])
    want["rn"], want["n"] = want.groupby("g").cumcount() + 1, want.groupby("g").t.transform("size")
    want = want.set_index("t").loc[got.index]
    assert (got.rn == want.rn).all() and (got.n == want.n).all()


def test_running_sum_with_weights(spark, frame):
    df = load(spark, frame).withColumn("w", F.length("g").cast("bigint"))
    got = running_sum(df, ["g"], [F.col("t")], F.col("w"), "before", "total").toPandas().set_index("t")
    want = frame.sort_values("t").assign(w=lambda d: d.g.str.len())
    want["before"] = want.groupby("g").w.cumsum() - want.w
    want = want.set_index("t").loc[got.index]
    assert (got.before == want.before).all()
    assert (got.total == want.groupby("g").w.transform("sum")).all()


def test_average_rank(spark, frame):
    got = average_rank_pcts(load(spark, frame), ["g"], ["v"]).toPandas().set_index("t")
    want = (frame.groupby("g").v.rank(pct=True, method="average") * 100).set_axis(frame.t).loc[got.index]
    np.testing.assert_allclose(got.pct_v.astype(float), want, rtol=1e-12)
    assert (got.n_v == frame.groupby("g").v.transform("count").set_axis(frame.t).loc[got.index]).all()


def test_quantiles(spark, frame):
    got = exact_quantiles(load(spark, frame), ["g"], "v", {"p05": 0.05, "mid": 0.5, "p95": 0.95}).toPandas().set_index("g")
    for g, part in frame.dropna().groupby("g"):
        np.testing.assert_allclose(got.loc[g, ["p05", "mid", "p95"]].astype(float), np.percentile(part.v, [5, 50, 95]), rtol=1e-12)


def test_quantiles_have_the_bits_of_percentile(spark, frame):
    df = load(spark, frame)
    probs = {f"p{i}": i / 17 for i in range(18)}
    got = exact_quantiles(df, ["g"], "v", probs).toPandas().set_index("g")
    want = df.filter("v is not null").groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, probs.values()))).alias("q")).toPandas().set_index("g")
    for g in want.index:
        assert got.loc[g, list(probs)].tolist() == list(want.q[g])
