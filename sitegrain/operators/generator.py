"""Which generator made a site, from its signals and its paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import GENERATOR_PATHS, GENERATORS


def from_paths(rows: DataFrame, path: Column | None = None) -> DataFrame:
    """One row: generator and confidence from path pieces; null and 0 where nothing tells.

    The highest score wins, ties in the order of ``GENERATORS``. It is one global aggregate.
    """
    path = F.lower(F.coalesce("version_free_path", "path") if path is None else path)
    counts = rows.select(path.alias("_p")).agg(*(F.count_if(F.col("_p").contains(piece)).alias(f"c{i}") for i, (_, piece, _, _) in enumerate(GENERATOR_PATHS)))
    score = {g: F.greatest(F.lit(0.0), F.lit(0.0), *(F.when(F.col(f"c{i}") > more, value).otherwise(0.0) for i, (name, _, more, value) in enumerate(GENERATOR_PATHS) if name == g)) for g in GENERATORS}
    top = F.greatest(*score.values())
    name = F.lit(None).cast("string")
    for g in reversed(GENERATORS):
        name = F.when(score[g] == top, g).otherwise(name)
    return counts.select(F.when(top >= 0.3, name).alias("generator"), F.when(top >= 0.3, top).otherwise(0.0).alias("confidence"))


def detect(rows: DataFrame, signals: dict[str, object] | None, accept_search_index: bool = False) -> tuple[str | None, float]:
    """(generator, confidence) of a crawl; its own signals come before what the paths say.

    ``accept_search_index`` also heeds the name under which the crawl itself stores that signal.
    """
    signals = signals or {}
    true = lambda k: str(signals.get(k)).lower() == "true"
    if true("has_objects_inv"):
        return "sphinx", 0.95
    if true("search_index_json") or (accept_search_index and true("has_search_index")):
        return "mkdocs", 0.95
    if (tool := signals.get("detected_tool")) in GENERATORS:
        return str(tool), 0.90
    row = from_paths(rows).first()
    return row.generator, row.confidence
