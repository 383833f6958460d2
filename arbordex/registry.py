"""What the entry point offers of the catalogue engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .catalogue_queries import BY_TEST, QUERIES, SQL
from .operators import search
from .plans.compiler import Options
from .sources import tables

__all__ = ["BY_TEST", "QUERIES", "SQL", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest PDF files, a page of them, with their paths."""
    catalogue = tables.catalogue(spark, sf_dir)
    return search.projected(search.top(catalogue, "ext:pdf size:>1mb", 64, Options(sort="size", desc=True)), catalogue.paths)
