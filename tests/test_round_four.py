"""What the round's findings asked for: bounded tasks, few shuffles, few cells searched."""

import glob

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from fathom.catalog.workspace import Workspace, workspace
from fathom.operators.neighbours import Space, _assigned, _boxes, _routed, _trees
from fathom.plans.views import map_points
from fathom.session import SPLIT_BYTES, TASK_BYTES, new_path
from fathom.sources.tables import read_csv, write_csv

from .conftest import FOLDER


def test_queries_search_few_cells(spark):
    """Donors of other texts cannot be near enough, and a tree finds that out for whole cells."""
    n = 4000
    made = spark.range(n).select(
        F.col("id").cast("string").alias("_key"), (F.col("id") * 37 % 181).cast("double").alias("a"),
        (F.col("id") * 73 % 361).cast("double").alias("b"), F.concat(F.lit("t"), F.col("id") % 20).alias("t"), F.lit("").alias("_group"),
    )
    space = Space(["a", "b"], ["t"], {"a": 180.0, "b": 360.0})
    trees, split = _trees(made, {"": n}, space, 100)
    donors = _assigned(made, trees, space)
    boxes = _boxes(donors, space, split)
    assert boxes.rows.sum() == n and 20 <= len(boxes.cells) <= 160 and boxes.single.mean() == 1
    asked = donors.withColumns({"_reach": F.lit(0.1), "_found": F.lit(1)})
    routed = _routed(asked, boxes, space, []).selectExpr("sum(size(_cells)) AS n").first().n
    assert routed < 4 * n  # all other cells of a text at most, not the cells of all texts


def test_mostly_zero_features_add_up():
    """Features that are mostly zero take a shorter way to the same distances."""
    rng = np.random.default_rng(5)
    a, b = (np.where(rng.random((60, 12)) < 0.05, rng.random((60, 12)), 0.0) for _ in range(2))
    a[3, 2] = b[7, 4] = np.nan
    names = [f"f{i}" for i in range(12)]
    space = Space(names, [], {c: 0.5 + i / 10 for i, c in enumerate(names)})
    found = space.distances(*(space.ready(pd.DataFrame(x, columns=names)) for x in (a, b)))
    widths = np.array([space.ranges[c] for c in names])
    gaps = np.abs(a[:, None] - b[None]) / widths
    assert np.allclose(found, np.nanmean(gaps, axis=2), atol=1e-11)


def test_tasks_are_bounded_by_their_input(spark):
    Workspace(spark, FOLDER)
    size = lambda name: int(spark.conf.get(name).rstrip("b"))
    assert size("spark.sql.adaptive.advisoryPartitionSizeInBytes") <= TASK_BYTES
    assert size("spark.sql.files.maxPartitionBytes") <= SPLIT_BYTES
    assert int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum")) >= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_map_points_shuffle_once(spark):
    rows = spark.createDataFrame(
        [(None, "x", 0.5), (None, "y", 0.5), ("s", "z", None), ("q", "x", 0.2), ("q", "y", 0.4), ("q", "y", 0.4)],
        "biosample_id string, taxon_name string, fraction_total_reads double",
    ).withColumns({c: F.lit("r") for c in ("run_accession", "top1_family_name")}).withColumns(
        {"family_number": F.lit(1), "species_number": F.lit(2), "top1_family_fraction_total_reads": F.lit(0.5)}
    )
    points = map_points(rows.repartition(3), 2)
    plan = points._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1
    found = sorted((r.biosample_id or "", r.taxon_name, r.col2string) for r in points.collect())
    assert found == [("", "x", "x: 50%\ny: 50%\n"), ("", "y", "x: 50%\ny: 50%\n"), ("q", "y", "y: 40%\ny: 40%\n")]


def test_csv_files_are_compressed(spark):
    path = new_path(spark, "csv").replace("file:", "")
    rows = spark.createDataFrame([("a,b", 1.5), ('"', None), ("lineé", 2.0)], "t string, x double")
    write_csv(rows, path)
    assert glob.glob(f"{path}/*.csv.gz") and not glob.glob(f"{path}/*.csv")
    assert sorted(map(tuple, read_csv(spark, path, rows.schema).collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)


def test_wide_rows_of_the_collation_are_joined_last(spark):
    """F7, F8: all other joins come before that to the taxa, so no wide row is shuffled again; the rows are those of ``enrich``."""
    ws = workspace(spark, FOLDER)
    early = ws.collate(climatology=ws.climate_province())
    late = ws.enriched()
    assert early.schema == late.schema
    assert early.exceptAll(late).isEmpty() and late.exceptAll(early).isEmpty()
    for df in (early, ws.collate(), ws.collate("species", strict=True)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Union" in plan[: plan.index("Join ")]
