"""Piecewise ranks and sums on data where one group holds most rows."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from boxlake.functions.text import draw_key
from boxlake.operators import ranking as rk


@pytest.fixture(scope="module")
def hot(spark):
    rnd = random.Random(5)
    rows = [("hot" if i % 3 else f"g{i % 40}", i, rnd.choice([0.0, 0.0, 0.25, rnd.random()])) for i in range(3000)]
    rows += [(None, 5000 + i, 0.5) for i in range(20)]
    return spark.createDataFrame(rows, "g string, id long, s double"), pd.DataFrame(rows, columns=["g", "id", "s"])


def test_exact_rank(hot):
    df, pdf = hot
    got = rk.exact_rank(df, ["g"], [F.desc("s"), F.asc("id")], pieces=7).toPandas().set_index("id")["rank"]
    want = pdf.sort_values(["s", "id"], ascending=[False, True]).groupby("g", dropna=False).cumcount() + 1
    assert got.sort_index().tolist() == want.set_axis(pdf["id"].loc[want.index]).sort_index().tolist()


def test_exact_rank_without_group(hot):
    df, pdf = hot
    got = rk.exact_rank(df, [], [F.asc("id")], pieces=5).orderBy("id").toPandas()["rank"].tolist()
    assert got == list(range(1, len(pdf) + 1))


def test_hash_rank(hot):
    df, _ = hot
    keyed = df.where("g IS NOT NULL").withColumn("k", draw_key(0, F.col("id")))
    got = rk.hash_rank(keyed, ["g"], "k").toPandas()
    want = got.sort_values("k").groupby("g").cumcount() + 1
    assert (got["rank"] == want.reindex(got.index)).all()


@pytest.mark.parametrize("n", [3, 1500])
def test_top_n(hot, n):
    df, pdf = hot
    got = {r.id for r in rk.top_n(df, ["g"], [F.desc("s"), F.asc("id")], n).collect()}
    want = pdf.sort_values(["s", "id"], ascending=[False, True]).groupby("g", dropna=False).head(n)
    assert got == set(want["id"])


def test_prefix_sums(hot):
    df, pdf = hot
    got = rk.prefix_sums(df, ["g"], [F.asc("id")], {"id": "cum"}, pieces=6).toPandas().set_index("id")["cum"]
    p = pdf.sort_values("id")
    want = p.groupby("g", dropna=False)["id"].cumsum()
    assert got.sort_index().tolist() == want.tolist()
