"""Fathom: sample-by-taxon abundance analytics as Spark DataFrame jobs."""
