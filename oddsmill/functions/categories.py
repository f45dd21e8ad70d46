"""Category taxonomy as column expressions and as a small table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Category:
    name: str
    labels: tuple[str, ...]
    exclusions: tuple[str, ...] = ()
    min_edge: float = 0.05
    window_s: int = 48 * 3600
    mispricing_skip: bool = False


# Nine categories in order of priority, with the tag labels (lower case) that make and rule out each.
TAXONOMY = (
    Category("sports", ("sports",), min_edge=0.10, window_s=6 * 3600, mispricing_skip=True),
    Category("esports", ("esports",), window_s=24 * 3600, mispricing_skip=True),
    Category("macro", ("fed rates", "fed", "fomc", "jerome powell", "economic policy")),
    Category("crypto", ("crypto", "bitcoin", "ethereum", "solana", "xrp", "ripple", "dogecoin", "bnb", "$trump"), ("crypto prices", "recurring", "up or down", "hide from new")),
    Category("elections", ("global elections", "world elections", "us election", "mayoral elections", "elections")),
    Category("geopolitics", ("geopolitics", "foreign policy", "middle east")),
    Category("tech", ("ai", "big tech", "tech")),
    Category("culture", ("culture", "movies", "celebrities")),
    Category("thesis", ()),
)
FALLBACK = "thesis"
NAMES = tuple(c.name for c in TAXONOMY)


def _lower(tags: Column) -> Column:
    return F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.lower(t))


def _matches(tags: Column, c: Category) -> Column:
    hit = F.arrays_overlap(tags, F.array(*map(F.lit, c.labels)))
    return F.coalesce(hit & ~F.arrays_overlap(tags, F.array(*map(F.lit, c.exclusions))) if c.exclusions else hit, F.lit(False))


def categorize_tags(tags: Column) -> Column:
    """All categories that the tags match, in order of priority; ``thesis`` if none."""
    low = _lower(tags)
    found = F.array_compact(F.array(*[F.when(_matches(low, c), c.name) for c in TAXONOMY if c.labels]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(FALLBACK)))


def primary_category(tags: Column) -> Column:
    """The first category by priority that the tags match."""
    low = _lower(tags)
    return F.coalesce(*[F.when(_matches(low, c), c.name) for c in TAXONOMY if c.labels], F.lit(FALLBACK))


def taxonomy_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c.name, k, c.min_edge, c.window_s, c.mispricing_skip, list(c.labels), list(c.exclusions)) for k, c in enumerate(TAXONOMY)], "category string, priority int, min_edge double, window_s long, mispricing_skip boolean, labels array<string>, exclusions array<string>")


def with_settings(df: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """``df`` (category) with its settings; ``overrides`` (category and any setting) come first. Nine rows are broadcast."""
    settings = taxonomy_table(df.sparkSession).select("category", "min_edge", "window_s", "mispricing_skip")
    if overrides is not None:
        own = [c for c in overrides.columns if c != "category"]
        settings = settings.join(overrides.select("category", *[F.col(c).alias(f"_{c}") for c in own]), "category", "left").withColumns({c: F.coalesce(f"_{c}", c) for c in own}).drop(*[f"_{c}" for c in own])
    return df.join(F.broadcast(settings), "category", "left")
