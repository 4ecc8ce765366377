"""Registry of queries: one name, one DataFrame builder, one SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moodloom.plans.pipeline import Analysis
from moodloom.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_ANALYSES: dict[tuple[str, str], Analysis] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(stages) -> DataFrame`` under ``name``."""

    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(stages(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql.replace(", 6)", f" + {OFFSET}, 6)")
        return fn

    return add


class Stages(Analysis):
    """The analysis of the bundled tables with the planted assignment."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        super().__init__(
            tables.playlists(spark, sf_dir),
            tables.items(spark, sf_dir),
            tables.tracks(spark, sf_dir),
            assign=tables.planted,
            reads=tables.PLANTED,
            rows=lambda: tables.raw_items(spark, sf_dir).count(),
        )

    def read(self, name: str) -> DataFrame:
        return tables.read(self.spark, self.sf_dir, name)


def stages(spark: SparkSession, sf_dir: str) -> Stages:
    """One analysis per session and folder, so queries share settled tables."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _ANALYSES:
        _ANALYSES[key] = Stages(spark, sf_dir)
    return _ANALYSES[key]


# Both engines compare doubles after rounding to six digits. Means of short
# decimals often end in an exact five, where the last bit of a sum decides; the
# offset moves such values off the border in both engines alike.
OFFSET = 1e-9


def r6(c: Column | str) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c) + OFFSET, 6)
