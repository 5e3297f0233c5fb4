"""Schemas of the documents that crawls, classifications and extractions exchange."""

from pyspark.sql import types as T

LINK = T.StructType([
    T.StructField("url", T.StringType()), T.StructField("source_url", T.StringType()), T.StructField("depth", T.IntegerType()),
    T.StructField("link_text", T.StringType()), T.StructField("http_status", T.IntegerType()),
])
#: Signals are booleans, texts and numbers, kept as text.
CRAWL = T.StructType([
    T.StructField("crawl_id", T.StringType()), T.StructField("root_domain", T.StringType()), T.StructField("root_urls", T.ArrayType(T.StringType())),
    T.StructField("signals", T.MapType(T.StringType(), T.StringType())), T.StructField("internal_urls", T.ArrayType(LINK)), T.StructField("external_urls", T.ArrayType(LINK)),
])
SUMMARY = T.StructType([
    T.StructField("total_internal_urls", T.LongType()), T.StructField("covered_urls", T.LongType()), T.StructField("uncovered_urls", T.LongType()),
    T.StructField("coverage_percent", T.DoubleType()), T.StructField("template_count", T.IntegerType()), T.StructField("avg_urls_per_template", T.DoubleType()),
])
TEMPLATE = T.StructType([
    T.StructField("template_id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("pattern", T.StringType()), T.StructField("fingerprint", T.StringType()),
    T.StructField("member_count", T.LongType()), T.StructField("versions_covered", T.ArrayType(T.StringType())), T.StructField("scope", T.StringType()),
    T.StructField("example_urls", T.ArrayType(T.StringType())), T.StructField("confidence", T.DoubleType()),
])
UNCOVERED = T.StructType([T.StructField("url", T.StringType()), T.StructField("reason", T.StringType()), T.StructField("recommendation", T.StringType())])
DOMAIN = T.StructType([
    T.StructField("domain", T.StringType()), T.StructField("url_count", T.LongType()), T.StructField("classification", T.StringType()),
    T.StructField("observed_paths", T.ArrayType(T.StringType())), T.StructField("note", T.StringType()),
])
CLASSIFICATION = T.StructType([
    T.StructField("crawl_id", T.StringType()), T.StructField("root_domain", T.StringType()), T.StructField("generator_detected", T.StringType()),
    T.StructField("generator_confidence", T.DoubleType()), T.StructField("summary", SUMMARY), T.StructField("templates", T.ArrayType(TEMPLATE)),
    T.StructField("uncovered_urls", T.ArrayType(UNCOVERED)), T.StructField("external_domains", T.ArrayType(DOMAIN)),
    T.StructField("template_map", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
])
