"""Rank correlations of several groupings at once."""

import numpy as np
import pandas as pd
import pytest

from tapeloom.functions import paired_ranks
from tapeloom.operators import evaluate

SCHEMA = "run string, up int, mode int, y_cls double, next_ret_1 double, pred_cls_score double, pred_reg double"


def rows(n=900):
    """Ties, a frequent value, both zeros, groups and values that are NULL, a key that is NULL."""
    rng = np.random.default_rng(5)
    f = pd.DataFrame({"run": rng.choice(["a", "b", "c", None], n), "up": rng.choice([0, 1, None], n), "mode": rng.choice([-3, 7, 9], n),
                      "next_ret_1": np.round(rng.normal(0, 1, n), 2), "pred_cls_score": rng.random(n)})
    f["pred_reg"] = np.round(f.next_ret_1 + rng.normal(0, 1, n), 2)
    f.loc[::3, "next_ret_1"], f.loc[1::3, "pred_reg"], f.loc[::30, "next_ret_1"] = 0.0, 0.5, -0.0
    f.loc[f.run == "c", "pred_reg"] = 1.0
    f["y_cls"] = (f.next_ret_1 > 0).astype(float)
    f.loc[::11, "pred_reg"], f.loc[::13, "next_ret_1"] = None, None
    return f[["run", "up", "mode", "y_cls", "next_ret_1", "pred_cls_score", "pred_reg"]]


@pytest.mark.parametrize("size", [paired_ranks.ROWS, 20])
def test_ranks_of_groups(spark, monkeypatch, size):
    """every prediction was ranked once per group column; now with one bucket and with many, frequent values apart."""
    monkeypatch.setattr(paired_ranks, "ROWS", size)
    f = rows()
    table = [tuple(None if pd.isna(v) else v for v in r) for r in f.itertuples(index=False)]
    df = spark.createDataFrame(table, SCHEMA)
    got = {(r.run, r.group_column, r.group_value): r for r in evaluate.evaluate_groups(df, ["up", "mode"], ["run"]).collect()}
    assert len(got) == 4 * 2 + 4 * 3
    for column in ("up", "mode"):
        for (run, value), g in f[f[column].notna()].groupby(["run", column], dropna=False):
            r = got[None if pd.isna(run) else run, column, int(value)]
            g = g.dropna(subset=["next_ret_1", "pred_reg"])
            if run == "c":
                assert r.reg_rank_ic is None
            else:
                assert r.reg_rank_ic == pytest.approx(g.next_ret_1.rank().corr(g.pred_reg.rank()))


def test_frequent_values_are_buckets_of_their_own(spark):
    df = spark.createDataFrame([(0.0,)] * 60 + [(float(i),) for i in range(40)], "x double")
    splits, alone = paired_ranks._splits(df, "x", 10)
    placed = paired_ranks._placed(df, "x", splits, alone).collect()
    assert {r.x for r in placed if r._alone} == {0.0} and len({r._part for r in placed if r._alone}) > 8
    assert all(r._part == 0 for r in placed if not r._alone)


def test_no_rows(spark):
    df = spark.createDataFrame([("a", 1, 0, 1.0, None, 0.5, None)], SCHEMA)
    assert [r.reg_rank_ic for r in evaluate.evaluate_groups(df, ["up", "mode"], ["run"]).collect()] == [None, None]
