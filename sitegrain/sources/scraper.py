"""Extractors of records from pages, behind one interface.

A hosted extractor is made for a template and healed between rounds; here it is a set of
selectors, and healing puts other selectors in their place. No command is ever run.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import with_fields
from ..functions.urls import frontier_key

#: Selectors that find a documentation page's fields.
FIELDS = (
    {"name": "page_title", "field_type": "TEXT", "css_selector": "title", "fallback_selectors": ["h1"]},
    {"name": "function_signature", "field_type": "TEXT", "css_selector": "dt.sig", "fallback_selectors": ["pre", "h1"]},
    {"name": "description", "field_type": "TEXT", "css_selector": "dd p", "fallback_selectors": ["p"]},
    {"name": "parameters", "field_type": "LIST", "css_selector": "ul", "fallback_selectors": []},
)


def parse_output(stdout: Column) -> Column:
    """The JSON in a tool's output: the first object or array to the last bracket, or the raw text under raw_output."""
    found = F.regexp_extract(stdout, r"(?s)(\{.*\}|\[.*\])", 1)
    raw = F.to_json(F.struct(F.trim(stdout).alias("raw_output")))
    return F.when((found != "") & F.try_parse_json(found).isNotNull(), found).otherwise(raw)


@dataclass
class SelectorExtractor:
    """Extracts by selectors; each healing of a template goes on to the next set of them.

    A template has its own sets in ``by_template``, or those of ``rounds``. URLs come again only
    while they fail, so a template that comes in a round has been healed as often as there were
    rounds before. Templates of ``uncreatable`` get no scraper and are passed over.
    """

    pages: DataFrame
    rounds: list[list[dict]] = field(default_factory=lambda: [list(FIELDS)])
    by_template: dict[str, list[list[dict]]] = field(default_factory=dict)
    uncreatable: frozenset[str] = frozenset()

    def create(self, urls: DataFrame) -> DataFrame:
        """The rows of ``urls`` whose template gets a scraper."""
        return urls.where(~F.col("template_id").isin(*self.uncreatable)) if self.uncreatable else urls

    def __call__(self, urls: DataFrame, turn: int) -> DataFrame:
        """``urls`` (template_id, url) and ``data``: JSON of the fields, null without a page.

        A page is found by its frontier key; of pages with one key the first counts, by
        page_id where there is one, so each URL keeps one row.
        """
        key = frontier_key(F.col("url"))
        order = "page_id" if "page_id" in self.pages.columns else "url"
        first = self.pages.groupBy(key.alias("_key")).agg(F.min(order).alias("_first"))
        kept = self.pages.withColumn("_key", key).join(first, "_key").where(F.col(order) == F.col("_first")).dropDuplicates(["_key"]).select("_key", "html")
        own = urls.withColumn("_key", key).join(kept, "_key", "left").drop("_key")
        version = lambda rounds: rounds[min(turn, len(rounds) - 1)]
        return with_fields(own, version(self.rounds), {t: version(r) for t, r in self.by_template.items()}).drop("html")
