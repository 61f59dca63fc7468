"""Preprocessing steps."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from ..functions.numbers import round_half_up
from ..operators.prep import (
    CategoryCodes, DropColumns, Dummies, LumpRare, ModeImpute, NearZeroVariance, NeighbourImpute, Normalise, NovelLevel,
    PowerTransform, PowerTransformModel, TargetImpute, UnknownLevel, ZeroVariance, best_powers, smote,
)
from ..operators.reshape import lengthen
from ..plans.features import classification_table, fit_features, regression_table
from ..session import materialise, new_path
from .composites import SPECIES, TAXA
from .registry import query, rounded
from .standins import TARGET_FAMILY

ROWS_SQL = (
    "(SELECT m.library_id, m.latitude_decimal_deg_n AS lat, m.longitude_decimal_deg_w AS lon, m.depth_m AS depth, m.section_id, "
    "m.temperature_deg_c AS temperature, m.phosphate_bottle_umol_l AS phosphate, m.nitrate_nitrite_bottle_umol_l AS nitrate, "
    "m.sample_method, l.code, w.DOP_darwin_clim AS dop, CASE WHEN m.ctd_station_no = 7 THEN 1.0 ELSE 0.0 END::DOUBLE AS rare_flag, "
    "5.0::DOUBLE AS constant FROM experiment_metadata m LEFT JOIN longhurst l ON m.library_id = l.library_id "
    "LEFT JOIN climate_wide w ON m.library_id = w.library_id)"
)


def rows(ws):
    """One row per sample with missing numbers, missing categories, a rare flag and a constant."""
    def build():
        wide = ws.samples.select(
            "library_id", "lat", "lon", "depth", "section_id", "temperature", "phosphate", "nitrate", "sample_method", "code",
            F.col("DOP_darwin_clim").alias("dop"),
            F.when(F.col("ctd_station") == 7, 1.0).otherwise(0.0).alias("rare_flag"), F.lit(5.0).alias("constant"),
        ).distinct()

        return materialise(wide, "prep-rows")

    return ws.keep("prep_rows", build)


@query(
    "m1_recipe",
    f"SELECT library_id, lat, section_id_P18, {rounded('(depth - (SELECT AVG(depth) FROM ' + ROWS_SQL + ' a)) / (SELECT STDDEV_SAMP(depth) FROM ' + ROWS_SQL + ' b)', 6)} AS depth "
    f"FROM (SELECT *, CASE WHEN section_id = 'P18' THEN 1.0 ELSE 0.0 END::DOUBLE AS section_id_P18 FROM {ROWS_SQL} t) u",
)
def _(ws):
    df = rows(ws).select("library_id", "lat", "depth", "section_id", "constant")
    recipe = Pipeline(stages=[
        ZeroVariance(exclude=["library_id", "lat"]),
        Normalise(columns=["depth"]),
        Dummies(columns=["section_id"], one_hot=True),
    ])
    path = new_path(ws.spark, "recipe")
    recipe.fit(df).write().overwrite().save(path)
    baked = PipelineModel.load(path).transform(df)
    return baked.select("library_id", "lat", "section_id_P18", round_half_up("depth", 6).alias("depth"))


@query("m2_roles", f"SELECT library_id, temperature, COALESCE(code, (SELECT code FROM (SELECT code, COUNT(*) AS n FROM {ROWS_SQL} a WHERE code IS NOT NULL GROUP BY code ORDER BY n DESC, code LIMIT 1) b)) AS code FROM {ROWS_SQL} t")
def _(ws):
    df = rows(ws).select("library_id", "temperature", "code")
    return ModeImpute(exclude=["library_id", "temperature"]).fit(df).transform(df)


@query("m3_remove", f"SELECT * EXCLUDE (phosphate, constant) FROM {ROWS_SQL} t")
def _(ws):
    return DropColumns(columns=["phosphate", "constant"]).transform(rows(ws))


@query("m4_impute_target")
def _(ws):
    df = rows(ws)
    return TargetImpute(target="temperature", exclude=["library_id"]).fit(df).transform(df)


NUMBERS = ("lat", "lon", "depth", "phosphate", "nitrate", "dop", "rare_flag")
TEXTS = ("section_id", "sample_method", "code")


def _nearest_sql() -> str:
    """Every pair of rows compared: mean scaled difference or mismatch over what both have, five nearest with a value."""
    known = lambda c: f"(q.{c} IS NOT NULL AND d.{c} IS NOT NULL)"
    apart = [f"CASE WHEN {known(c)} AND w_{c} > 0 THEN ABS(CAST(q.{c} AS DOUBLE) - d.{c}) / w_{c} ELSE 0 END" for c in NUMBERS]
    apart += [f"CASE WHEN {known(c)} AND q.{c} <> d.{c} THEN 1.0::DOUBLE ELSE 0 END" for c in TEXTS]
    both = " + ".join(f"CAST({known(c)} AS INTEGER)" for c in (*NUMBERS, *TEXTS))
    distance = f"CASE WHEN {both} > 0 THEN ROUND(({' + '.join(apart)}) / ({both}), 12) ELSE 1 END"
    lacking = " OR ".join(f"{c} IS NULL" for c in NUMBERS)
    fills = ", ".join(
        f"f_{c} AS (SELECT k, AVG(v) AS v FROM (SELECT k, d_{c} AS v, ROW_NUMBER() OVER (PARTITION BY k ORDER BY distance, donor) AS r FROM p "
        f"WHERE q_{c} IS NULL AND d_{c} IS NOT NULL) x WHERE r <= 5 GROUP BY k)"
        for c in NUMBERS
    )
    return (
        f"WITH n AS (SELECT * FROM {ROWS_SQL} t), w AS (SELECT {', '.join(f'CAST(MAX({c}) - MIN({c}) AS DOUBLE) AS w_{c}' for c in NUMBERS)} FROM n), "
        f"p AS (SELECT q.library_id AS k, d.library_id AS donor, {distance} AS distance, {', '.join(f'q.{c} AS q_{c}, CAST(d.{c} AS DOUBLE) AS d_{c}' for c in NUMBERS)} "
        f"FROM (SELECT * FROM n WHERE {lacking}) q, n d, w), {fills} "
        f"SELECT n.* EXCLUDE ({', '.join(NUMBERS)}, constant), {', '.join(rounded(f'COALESCE(CAST(n.{c} AS DOUBLE), f_{c}.v)', 6) + f' AS {c}' for c in NUMBERS)} FROM n "
        + " ".join(f"LEFT JOIN f_{c} ON n.library_id = f_{c}.k" for c in NUMBERS)
    )


@query("m5_impute_neighbours", _nearest_sql())
def _(ws):
    df = rows(ws).drop("constant")
    filled = NeighbourImpute(key="library_id", exclude=["library_id", "temperature"]).fit(df).transform(df)
    return filled.withColumns({c: round_half_up(c, 6) for c in NUMBERS})


@query(
    "m6_impute_mode",
    f"SELECT library_id, COALESCE(code, (SELECT code FROM (SELECT code, COUNT(*) AS n FROM {ROWS_SQL} a WHERE code IS NOT NULL GROUP BY code ORDER BY n DESC, code LIMIT 1) b)) AS code, "
    f"COALESCE(sample_method, (SELECT sample_method FROM (SELECT sample_method, COUNT(*) AS n FROM {ROWS_SQL} a GROUP BY sample_method ORDER BY n DESC, sample_method LIMIT 1) b)) AS sample_method FROM {ROWS_SQL} t",
)
def _(ws):
    df = rows(ws).select("library_id", "code", "sample_method")
    return ModeImpute(columns=["code", "sample_method"]).fit(df).transform(df)


@query(
    "m7_power_fixed",
    f"SELECT library_id, {rounded('CASE WHEN temperature >= 0 THEN (POWER(temperature + 1, 0.4) - 1) / 0.4 ELSE -(POWER(1 - temperature, 1.6) - 1) / 1.6 END', 6)} AS temperature, "
    f"{rounded('CASE WHEN lat >= 0 THEN LN(1 + lat) ELSE -(POWER(1 - lat, 2.0) - 1) / 2.0 END', 6)} AS lat FROM {ROWS_SQL} t",
)
def _(ws):
    df = PowerTransformModel(powers={"temperature": 0.4, "lat": 0.0}).transform(rows(ws).select("library_id", "temperature", "lat"))
    return df.withColumns({c: round_half_up(c, 6) for c in ("temperature", "lat")})


@query("m7_power_fit")
def _(ws):
    df = ws["lineitem"].select("l_extendedprice", "l_quantity", "l_discount")
    powers = best_powers(df, ["l_extendedprice", "l_quantity", "l_discount"])
    return ws.spark.createDataFrame(sorted(powers.items()), "feature string, power double")


@query(
    "m8_normalise",
    "SELECT library_id, "
    + ", ".join(
        f"{rounded(f'(t.{c} - s.m_{c}) / s.s_{c}', 6)} AS {c}" for c in ("lat", "lon", "depth", "temperature", "nitrate")
    )
    + f" FROM {ROWS_SQL} t CROSS JOIN (SELECT "
    + ", ".join(f"AVG({c}) AS m_{c}, STDDEV_SAMP({c}) AS s_{c}" for c in ("lat", "lon", "depth", "temperature", "nitrate"))
    + f" FROM {ROWS_SQL} a) s",
)
def _(ws):
    columns = ["lat", "lon", "depth", "temperature", "nitrate"]
    df = rows(ws).select("library_id", *columns)
    return Normalise(columns=columns).fit(df).transform(df).withColumns({c: round_half_up(c, 6) for c in columns})


SECTIONS = ("AE1319", "AMT28", "BVAL46", "C13.5/A13.5", "I07N", "I09N", "NH1418", "P18")


@query(
    "m9_dummies",
    "SELECT library_id, "
    + ", ".join(f"CASE WHEN section_id = '{s}' THEN 1.0 ELSE 0.0 END::DOUBLE AS section_id_{s.replace('.', '_').replace('/', '_')}" for s in SECTIONS)
    + f", CASE WHEN sample_method = 'underway' THEN 1.0 ELSE 0.0 END::DOUBLE AS sample_method_underway FROM {ROWS_SQL} t",
)
def _(ws):
    df = rows(ws).select("library_id", "section_id", "sample_method")
    full = Dummies(columns=["section_id"], one_hot=True).fit(df).transform(df)
    return Dummies(columns=["sample_method"], one_hot=False).fit(full).transform(full)


@query("m10_near_zero_variance", f"SELECT * EXCLUDE (rare_flag, constant) FROM {ROWS_SQL} t")
def _(ws):
    return NearZeroVariance(exclude=["library_id"]).fit(rows(ws)).transform(rows(ws))


@query("m11_zero_variance", f"SELECT * EXCLUDE (constant) FROM {ROWS_SQL} t")
def _(ws):
    return ZeroVariance(exclude=["library_id"]).fit(rows(ws)).transform(rows(ws))


@query(
    "m12_lump_rare",
    f"SELECT library_id, CASE WHEN code IS NULL OR code IN (SELECT code FROM (SELECT code, COUNT(*) * 1.0 / SUM(COUNT(*)) OVER () AS share FROM {ROWS_SQL} a WHERE code IS NOT NULL GROUP BY code) s WHERE share >= 0.042) "
    f"THEN code ELSE 'other' END AS code FROM {ROWS_SQL} t",
)
def _(ws):
    df = rows(ws).select("library_id", "code")
    return LumpRare(columns=["code"], threshold=0.042).fit(df).transform(df)


@query(
    "m13_novel",
    f"SELECT library_id, CASE WHEN section_id IN (SELECT section_id FROM {ROWS_SQL} a WHERE depth < 100 AND section_id <> 'P18') THEN section_id ELSE 'new' END AS section_id FROM {ROWS_SQL} t",
)
def _(ws):
    df = rows(ws).select("library_id", "section_id", "depth")
    train = df.filter((F.col("depth") < 100) & (F.col("section_id") != "P18"))
    return NovelLevel(columns=["section_id"]).fit(train).transform(df).drop("depth")


@query("m14_unknown", f"SELECT library_id, COALESCE(code, 'unknown') AS code FROM {ROWS_SQL} t")
def _(ws):
    return UnknownLevel(columns=["code"]).transform(rows(ws).select("library_id", "code"))


@query(
    "m15_text_to_category",
    f"SELECT library_id, CASE WHEN code IS NOT NULL THEN DENSE_RANK() OVER (ORDER BY code NULLS LAST) END AS code FROM {ROWS_SQL} t",
)
def _(ws):
    df = rows(ws).select("library_id", "code")
    return CategoryCodes(columns=["code"]).fit(df).transform(df)


@query("m16_oversample")
def _(ws):
    scored = ws["labels"].join(ws["documents"].select("doc_id", "n_chars"), "doc_id")
    df = scored.select("doc_id", F.col("toxic").cast("string").alias("toxic"), F.col("n_chars").cast("double").alias("n_chars"),
                       F.col("quality").cast("double").alias("quality"))
    return smote(df, "toxic", "doc_id", over_ratio=1.0)


def model_table(ws):
    return ws.keep(
        "model_table", lambda: materialise(regression_table(ws.samples, TAXA, SPECIES, keep_id=True), "model-table")
    )


@query("k10_features")
def _(ws):
    return fit_features(model_table(ws), "temperature", "biosample_id", correlation=0.03).training


def class_table(ws):
    return ws.keep(
        "class_table", lambda: materialise(classification_table(ws.samples, TAXA, SPECIES, TARGET_FAMILY, keep_id=True), "class-table")
    )


@query("k10_class")
def _(ws):
    return fit_features(class_table(ws), "target", "biosample_id", correlation=0.03).training
