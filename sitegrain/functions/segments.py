"""Lexical types of path segments, and whether a segment fits a template's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import FILE_EXTENSIONS, PAGE_EXTENSIONS


def classify(s: Column) -> Column:
    """The lexical type of a segment: the first of these that it fits.

    A number with dots is a version, never a float; underscores make no slug.
    """
    dotted = s.rlike(r"^[a-zA-Z_][a-zA-Z0-9_]*(?:\.[a-zA-Z_][a-zA-Z0-9_]*)+$")
    known = F.lower(F.regexp_extract(s, r"([^.]*)$", 1)).isin(*FILE_EXTENSIONS)
    return (
        F.when(s.rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), "uuid")
        .when(s.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), "date")
        .when(s.rlike(r"^(?:v[0-9]+(?:\.[0-9]+)*|[0-9]+(?:\.[0-9]+)+)$"), "version")
        .when(s.rlike("^[0-9]+$"), "integer")
        .when(s.rlike("(?i)^[0-9a-f]{8,}$"), "hash")
        .when(dotted & ~known, "dotted_path")
        .when(s.rlike(rf"(?i)^.+\.(?:{'|'.join(PAGE_EXTENSIONS)})$"), "filename")
        .when(s.rlike("^[A-Z][a-zA-Z0-9]*$"), "camel_case")
        .when(s.rlike("^[a-z][a-z0-9]*(?:-[a-z0-9]+)+$"), "slug")
        .when(s.isNotNull(), "literal")
    )


def is_literal_like(s: Column) -> Column:
    """The trie's own notion of a literal: lower case, no dot."""
    return s.rlike(r"^[a-z][a-z0-9_-]*\z")


def fits(segment: Column, template: Column) -> Column:
    """Whether a URL's segment fits a template's: the same text but for case, or the type."""
    kind, inner = classify(segment), F.lower(F.regexp_extract(template, "^<(.*)>$", 1))
    loose = (
        (kind == inner)
        | (inner.isin("filename", "dotted_path") & segment.contains("."))
        | inner.isin("literal", "unknown")
        | ((inner == "slug") & kind.isin("literal", "slug"))
        | ((inner == "camel_case") & kind.isin("camel_case", "literal"))
        | ((inner == "version") & kind.isin("version", "integer"))
        | ((inner == "integer") & (kind == "version"))
    )
    return F.when(template.rlike("^<.*>$"), loose).otherwise(F.lower(segment) == F.lower(template))
