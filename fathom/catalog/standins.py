"""Source tables of the sample model, derived from the given tables.

Each statement runs unchanged in Spark SQL and as a ``WITH`` part of the checking SQL.
"""

from __future__ import annotations

import re

from ..plans.collate import CLIMATOLOGY_VARIABLES

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()

# What stands in for the names the engine has as defaults.
CONTAMINANT_FAMILY = "Brand#13"
CONTAMINANT_SPECIES = "cold widget"
TARGET_FAMILY = "Brand#1"
SPECIES_TOTAL = 64

STAND_INS: dict[str, str] = {
    "experiment_metadata": """
SELECT CONCAT('L', c.c_custkey) AS library_id,
       CAST((c.c_custkey * 37) % 181 - 90 AS DOUBLE) AS latitude_decimal_deg_n,
       CAST((c.c_custkey * 73) % 361 - 180 AS DOUBLE) AS longitude_decimal_deg_w,
       CAST(CAST(o.d AS DATE) AS STRING) || 'T12:00:00Z' AS iso_datetime_utc,
       CAST((c.c_custkey % 50) * 4 AS DOUBLE) AS depth_m,
       CASE c.c_custkey % 8 WHEN 0 THEN 'AE1319' WHEN 1 THEN 'AMT28' WHEN 2 THEN 'BVAL46'
            WHEN 3 THEN 'C13.5/A13.5' WHEN 4 THEN 'I07N' WHEN 5 THEN 'I09N'
            WHEN 6 THEN 'NH1418' ELSE 'P18' END AS section_id,
       CASE WHEN c.c_custkey % 11 <> 0 THEN c.c_acctbal / 500 END AS temperature_deg_c,
       CASE WHEN c.c_custkey % 3 <> 0 THEN CAST(c.c_custkey % 29 AS DOUBLE) END AS phosphate_bottle_umol_l,
       CASE WHEN c.c_custkey % 13 <> 0 THEN CAST(c.c_custkey % 31 AS DOUBLE) END AS nitrate_nitrite_bottle_umol_l,
       CAST(c.c_custkey % 40 AS BIGINT) AS ctd_station_no,
       CASE c.c_custkey % 2 WHEN 0 THEN 'CTD' ELSE 'underway' END AS sample_method,
       c.c_mktsegment AS platform_strategy,
       CONCAT('SAMN', c.c_custkey) AS sra_accession_number
FROM customer c LEFT JOIN (SELECT o_custkey, MIN(o_orderdate) AS d FROM orders GROUP BY o_custkey) o
  ON c.c_custkey = o.o_custkey""",
    "id_mapping": """
SELECT CONCAT('SRX', c_custkey) AS experiment_accession, CONCAT('SRR', c_custkey) AS run_accession,
       CONCAT('SAMN', c_custkey) AS sample_accession, c_name AS description
FROM customer WHERE c_custkey % 17 <> 0
UNION ALL
SELECT CONCAT('SRX', c_custkey), CONCAT('SRR', c_custkey, 'b'), CONCAT('SAMN', c_custkey), c_name
FROM customer WHERE c_custkey % 17 <> 0 AND c_custkey % 19 = 0""",
    "family_reads": """
SELECT o.o_custkey AS k, p.p_brand AS name, SUM(l.l_quantity) AS reads
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey
GROUP BY o.o_custkey, p.p_brand""",
    "species_reads": """
SELECT o.o_custkey AS k, p.p_name AS name, SUM(l.l_quantity) AS reads
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey
GROUP BY o.o_custkey, p.p_name""",
    "family_bracken_summary": """
SELECT q.name, q.reads / t.total AS fraction_total_reads, CONCAT('SRX', q.k) AS experiment_id,
       CONCAT('SRR', q.k) AS sample_id
FROM family_reads q JOIN (SELECT k, SUM(reads) AS total FROM family_reads GROUP BY k) t ON q.k = t.k""",
    "species_bracken_summary": """
SELECT q.name, q.reads / t.total AS fraction_total_reads, CONCAT('SRX', q.k) AS experiment_id,
       CONCAT('SRR', q.k) AS sample_id
FROM species_reads q JOIN (SELECT k, SUM(reads) AS total FROM species_reads GROUP BY k) t ON q.k = t.k""",
    "samplesheet": """
SELECT CONCAT('SRX', c_custkey) AS experiment_accession, CONCAT('ERS', c_custkey) AS accession,
       CONCAT('SRR', c_custkey) AS run_accession, CONCAT('PRJ', c_nationkey) AS study_accession,
       'Illumina' AS instrument_model, CAST(c_custkey * 1000 AS BIGINT) AS read_count,
       CONCAT(c_custkey * 10, ';', c_custkey * 20) AS fastq_bytes
FROM customer""",
    "climatology": "UNION ALL".join(
        f"""
SELECT CONCAT('L', c_custkey) AS library_id, '{variable}' AS variable,
       CASE WHEN (c_custkey + {k}) % 23 <> 0 THEN CAST((c_custkey * {k}) % 97 - 3 AS DOUBLE) / 8 END AS value
FROM customer WHERE (c_custkey + {k}) % 41 <> 0
"""
        for k, variable in enumerate(CLIMATOLOGY_VARIABLES, 1)
    ),
    "longhurst": """
SELECT CONCAT('L', c.c_custkey) AS library_id, CAST((c.c_custkey * 37) % 181 - 90 AS DOUBLE) AS lat,
       CAST((c.c_custkey * 73) % 361 - 180 AS DOUBLE) AS lon, n.n_name AS code,
       CONCAT('Province ', n.n_name) AS description
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE c.c_custkey % 29 <> 0""",
    "scored": "UNION ALL".join(
        f"""
SELECT '{model}' AS model_id, b.doc_id AS id, b.toxic AS truth,
       CAST((d.n_chars * {k} + b.doc_id) % 100 AS DOUBLE) / 100 AS score
FROM labels b JOIN documents d ON b.doc_id = d.doc_id
"""
        for model, k in (("GBM_1", 1), ("GLM_1", 7), ("DRF_1", 13))
    ),
}

# The same results in SQL, for the checks of what is built on top of the sources.
CHECK_VIEWS: dict[str, str] = {
    "climate_wide": "SELECT library_id, "
    + ", ".join(f"MAX(CASE WHEN variable = '{v}' THEN value END) AS {v}" for v in CLIMATOLOGY_VARIABLES)
    + " FROM climatology GROUP BY library_id",
    "climate_province": "SELECT w.*, p.lat AS lat, p.lon AS lon, p.code AS code, p.description AS description "
    "FROM climate_wide w LEFT JOIN longhurst p ON w.library_id = p.library_id",
    "collated": f"""
SELECT m.library_id AS library_id, m.latitude_decimal_deg_n AS lat, m.longitude_decimal_deg_w AS lon,
       m.iso_datetime_utc AS col_date, m.depth_m AS depth, m.section_id AS section_id,
       m.temperature_deg_c AS temperature, m.phosphate_bottle_umol_l AS phosphate,
       m.nitrate_nitrite_bottle_umol_l AS nitrate, m.ctd_station_no AS ctd_station,
       m.sample_method AS sample_method, m.platform_strategy AS platform_strategy,
       m.sra_accession_number AS biosample_id, r.experiment_accession AS experiment_accession,
       r.run_accession AS run_accession, r.description AS experiment_description,
       fn.n AS family_number, sn.n AS species_number, ft.name AS top1_family_name,
       ft.fraction_total_reads AS top1_family_fraction_total_reads, st.name AS top1_species_name,
       st.fraction_total_reads AS top1_species_fraction_total_reads, t.name AS taxon_name,
       t.fraction_total_reads AS fraction_total_reads, t.sample_id AS sample_id,
       s.study_accession AS study_accession, s.instrument_model AS instrument_model,
       s.read_count AS read_count, s.fastq_bytes AS fastq_bytes
FROM experiment_metadata m
LEFT JOIN id_mapping r ON m.sra_accession_number = r.sample_accession
LEFT JOIN (SELECT experiment_id, COUNT(*) AS n FROM family_bracken_summary GROUP BY experiment_id) fn
  ON r.experiment_accession = fn.experiment_id
LEFT JOIN (SELECT experiment_id, COUNT(*) AS n FROM species_bracken_summary GROUP BY experiment_id) sn
  ON r.experiment_accession = sn.experiment_id
LEFT JOIN (SELECT * FROM (SELECT experiment_id, name, fraction_total_reads,
             MAX(fraction_total_reads) OVER (PARTITION BY experiment_id) AS top
           FROM family_bracken_summary WHERE name <> '{CONTAMINANT_FAMILY}') x
           WHERE fraction_total_reads = top) ft ON r.experiment_accession = ft.experiment_id
LEFT JOIN (SELECT * FROM (SELECT experiment_id, name, fraction_total_reads,
             MAX(fraction_total_reads) OVER (PARTITION BY experiment_id) AS top
           FROM species_bracken_summary WHERE name <> '{CONTAMINANT_SPECIES}') x
           WHERE fraction_total_reads = top) st ON r.experiment_accession = st.experiment_id
LEFT JOIN (SELECT * FROM family_bracken_summary WHERE name <> '{CONTAMINANT_FAMILY}') t
  ON r.experiment_accession = t.experiment_id
LEFT JOIN samplesheet s ON r.experiment_accession = s.experiment_accession""",
    "sample_taxa": """
SELECT c.* EXCLUDE (col_date), TRY_CAST(SPLIT_PART(c.col_date, 'T', 1) AS DATE) AS col_date, """
    + ", ".join(f"w.{v} AS {v}" for v in CLIMATOLOGY_VARIABLES)
    + """, w.lat AS lat_longhurst, w.lon AS lon_longhurst, w.code AS code, w.description AS longhurst_description
FROM collated c LEFT JOIN climate_province w ON c.library_id = w.library_id""",
    "working": """
SELECT * EXCLUDE (taxon_name, temperature, working_rank),
       CASE WHEN LENGTH(taxon_name) > 16 THEN LEFT(taxon_name, 13) || '...' ELSE taxon_name END AS taxon_name,
       COALESCE(temperature, 25.73) AS temperature
FROM (SELECT *, RANK() OVER (PARTITION BY biosample_id ORDER BY fraction_total_reads DESC NULLS LAST) AS working_rank
      FROM sample_taxa) x WHERE working_rank <= 100000""",
}


def with_views(sql: str) -> str:
    """The statement with every view it uses, directly or not, as a ``WITH`` part."""
    views = {**STAND_INS, **CHECK_VIEWS}
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in views.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(body)
                needed.append(name)

    visit(sql)
    sql = sql.strip()
    parts = ", ".join(f"{n} AS ({views[n].strip()})" for n in needed)
    if not parts:
        return sql
    if re.match(r"with\b", sql, re.IGNORECASE):
        return f"WITH {parts}, {sql[4:].strip()}"
    return f"WITH {parts} {sql}"
