"""What the round's findings asked for: neighbours without copies of queries, few pairs in full, values counted unmelted."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fathom.operators import neighbours, prep
from fathom.operators.neighbours import Donors, Search, Space, nearest_rows
from fathom.operators.power import POWER_HIGH, POWER_LOW, best_powers, transformed
from fathom.operators.prep import NeighbourImpute, near_zero_variance, value_frequencies

NUMBERS = ["a", "b", "c", "d", "e", "f"]
TEXTS = ["s", "t"]


def mixed(n: int, seed: int, keys: str) -> pd.DataFrame:
    """Numbers, mostly zeros, and texts, with missing ones and rows that come twice."""
    rng = np.random.default_rng(seed)
    rows = pd.DataFrame({c: np.round(rng.normal(1000.0, 3.0, n), 2) for c in "abc"})
    for c in "def":
        rows[c] = np.where(rng.random(n) < 0.9, 0.0, np.round(rng.random(n), 1))
    for c in "abd":
        rows.loc[rng.random(n) < 0.15, c] = np.nan
    for c, levels in zip(TEXTS, (7, 4)):
        rows[c] = np.where(rng.random(n) < 0.1, None, np.array([f"{c}{i}" for i in rng.integers(0, levels, n)], dtype=object))
    rows.iloc[n // 2 : n // 2 + n // 10] = rows.iloc[: n // 10].to_numpy()
    rows["_key"] = [f"{keys}{i * 7919 % n}" for i in range(n)]
    rows["_group"] = ""
    return rows.astype({c: float for c in NUMBERS})


def all_pairs(queries: pd.DataFrame, donors: pd.DataFrame, space: Space, k: int) -> dict:
    far = space.distances(space.ready(queries), space.ready(donors))
    found = {}
    for i, key in enumerate(queries["_key"]):
        for t in [c for c in NUMBERS if np.isnan(queries[c].iloc[i])]:
            have = np.flatnonzero(donors[t].notna())
            best = sorted((round(far[i, j], 12), donors["_key"].iloc[j], donors[t].iloc[j]) for j in have)[:k]
            found[key, t] = best
    return found


def space_of(rows: pd.DataFrame) -> Space:
    return Space(NUMBERS, TEXTS, {c: float(rows[c].max() - rows[c].min()) for c in NUMBERS})


def test_few_pairs_are_compared_in_full(monkeypatch):
    """bounds leave few pairs, and the neighbours are those of all pairs."""
    donors, queries = mixed(3000, 1, "d").sort_values("_key"), mixed(200, 2, "q")
    queries = queries[queries[NUMBERS].isna().any(axis=1)]
    space = space_of(donors)
    bounding = neighbours._bounding(donors, space)
    compared, compare = [], Search._compare
    monkeypatch.setattr(Search, "_compare", lambda self, there, i, j: (compared.append(len(i)), compare(self, there, i, j)))
    search = Search(neighbours._rows(queries, space, NUMBERS), bounding, space, 5, True)
    search.open = np.arange(len(queries))
    for part in np.array_split(np.arange(len(donors)), 4):
        search.meet(Donors(neighbours._rows(donors.iloc[part], space, NUMBERS), bounding, space))
    got: dict = {}
    result = search.result(NUMBERS)
    for row in sorted(zip(result["_key"], result["target"], result["rank"], result["distance"], result["donor"], result["value"])):
        got.setdefault(row[:2], []).append(row[3:])
    assert got == all_pairs(queries, donors, space, 5)
    assert sum(compared) < 0.1 * len(queries) * len(donors)


@pytest.mark.parametrize("cell_rows", [4000, 60])
def test_neighbours_equal_all_pairs(spark, monkeypatch, cell_rows):
    """in one cell and in many, with cells in several files; no table holds a query once per cell."""
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 50)
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 20)
    written, materialise = {}, neighbours.materialise

    def counted(df, label, *more):
        written[label] = materialise(df, label, *more)
        return written[label]

    monkeypatch.setattr(neighbours, "materialise", counted)
    donors, queries = mixed(700, 3, "d"), mixed(150, 4, "q")
    space = space_of(donors)
    tables = [spark.createDataFrame(x.drop(columns="_group").astype(object).where(x.drop(columns="_group").notna(), None), ", ".join(
        [*[f"{c} double" for c in NUMBERS], *[f"{c} string" for c in TEXTS], "_key string"])).withColumnRenamed("_key", "id") for x in (queries, donors)]
    near = nearest_rows(*tables, "id", space, 5, NUMBERS, cell_rows=cell_rows, distinct_keys=True)
    got: dict = {}
    for r in sorted(near.collect(), key=lambda r: r["rank"]):
        got.setdefault((r.id, r.target), []).append((r.distance, r.donor, r.value))
    assert got == all_pairs(queries, donors, space, 5)
    assert sorted(written) == ["donors", "queries"] and written["queries"].count() == len(queries)


def test_rows_without_anything_known_and_nothing_to_fill(spark):
    rows = [(1, 1.0, None), (2, 2.0, 8.0), (3, None, None), (4, 4.0, 2.0)]
    df = spark.createDataFrame(rows, "id long, u double, v double")
    filled = {r.id: (r.u, r.v) for r in NeighbourImpute(key="id", exclude=["id"]).fit(df).transform(df).collect()}
    assert filled == {1: (1.0, 5.0), 2: (2.0, 8.0), 3: (pytest.approx(7 / 3), 5.0), 4: (4.0, 2.0)}
    whole = df.where("v IS NOT NULL").withColumn("v", F.col("v").cast("int"))
    done = NeighbourImpute(key="id", exclude=["id"]).fit(df).transform(whole)
    assert dict(done.dtypes)["v"] == "double" and sorted(r.v for r in done.collect()) == [2.0, 8.0]
    # A target that no donor has stays missing.
    bare = spark.createDataFrame([(1, 1.0, None), (2, 2.0, None)], "id long, u double, v double")
    assert NeighbourImpute(key="id", exclude=["id"]).fit(bare).transform(bare).where("v IS NOT NULL").count() == 0


def test_numbers_are_counted_unmelted(spark, monkeypatch):
    """numbers are counted by column; told apart as by their text."""
    melted = []
    cells = prep.long_cells
    monkeypatch.setattr(prep, "long_cells", lambda df, columns, **more: (melted.extend(columns), cells(df, columns, **more))[1])
    monkeypatch.setattr(prep, "HELD_CELLS", 6)
    df = spark.createDataFrame(
        [(0.0, 1, None, "a", 2.5), (-0.0, 1, None, "a", 2.5), (float("nan"), 2, None, None, 2.5), (float("nan"), None, None, "b", 1.0),
         (None, None, None, "b", None)], "x double, i int, none double, t string, y float",
    )
    found = {r.feature: (r.n_rows, r.n_distinct, r.most, r.second_most) for r in value_frequencies(df, df.columns).collect()}
    assert found == {"x": (4, 3, 2, 1), "i": (3, 2, 2, 1), "t": (4, 2, 2, 2), "y": (4, 2, 3, 1)}
    assert melted == ["t"]
    assert [r.feature for r in near_zero_variance(df, df.columns).collect()] == ["none"]
    assert sorted(r.feature for r in near_zero_variance(df, df.columns, ratio=2.5, distinct_percent=50).collect()) == ["none", "y"]


def test_powers_of_columns_of_zeros(spark):
    rng = np.random.default_rng(3)
    x = np.where(rng.random(900) < 0.8, 0.0, rng.gamma(2.0, 1.0, 900))
    found = best_powers(spark.createDataFrame([(float(v),) for v in x], "x double"), ["x"])["x"]

    def likelihood(power):
        return -len(x) / 2 * np.log(transformed(x, power)[0].var()) + (power - 1) * np.log1p(x).sum()

    assert likelihood(found) >= max(likelihood(p) for p in np.linspace(POWER_LOW, POWER_HIGH, 2001)) - 1e-9
