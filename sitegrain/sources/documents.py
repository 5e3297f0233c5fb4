"""Reading and writing crawl, classification and extraction documents.

A document is one JSON text. It is written as a folder of sections, each with its lines in the
order of the document, a list's elements one a line: all files in the order of their names are
the document. So no task holds a list, and lists are read again line by line. Documents
of others, in one file, are read as a whole.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import CLASSIFICATION, CRAWL, LINK
from ..tables import delete_folder, materialize

Sections = list[tuple[str, DataFrame]]


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One JSON document over several lines; a missing file or bad JSON is an error."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_crawl(spark: SparkSession, path: str) -> DataFrame:
    """A crawl document: crawl_id, root_domain, root_urls, signals, internal_urls, external_urls."""
    return read_json(spark, path, CRAWL)


def read_classification(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, CLASSIFICATION)


def links_of(document: DataFrame, column: str) -> DataFrame:
    """Link records of a document's array, with their place in it as ``seq``."""
    rows = document.select(F.posexplode(column).alias("seq", "_l"))
    fields = document.schema[column].dataType.elementType.names
    return rows.select(F.col("seq").cast("long"), *(F.col(f"_l.{c}").alias(c) for c in fields)).withColumn("link_text", F.coalesce("link_text", F.lit("")))


def template_urls(document: DataFrame) -> DataFrame:
    """template_id, seq and url of a classification's template map, in its order."""
    rows = document.select(F.posexplode(F.map_entries("template_map")).alias("_m", "_e"))
    rows = rows.select("_m", F.col("_e.key").alias("template_id"), F.posexplode("_e.value").alias("_p", "url"))
    return rows.select("template_id", (F.col("_m").cast("long") * (1 << 32) + F.col("_p")).alias("seq"), "url")


def write_json(document: DataFrame, path: str) -> None:
    """Write a document's one row as JSON; fields that are null are left out."""
    document.select(F.to_json(F.struct(*document.columns), {"pretty": "true"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def crawl_document(crawl_id: str, root_domain: str, root_urls: list[str], signals: dict[str, str], internal: DataFrame, external: DataFrame) -> DataFrame:
    """The crawl document of two link tables (seq, url, source_url, depth, link_text, http_status).

    It holds all links in one row, as the format asks; the crawl's own limits bound them.
    """
    def listed(rows: DataFrame, name: str) -> DataFrame:
        for c, kind in (("link_text", "string"), ("http_status", "int")):
            if c not in rows.columns:
                rows = rows.withColumn(c, F.lit(None).cast(kind))
        entry = F.struct("seq", F.struct("url", "source_url", F.col("depth").cast("int").alias("depth"), F.coalesce("link_text", F.lit("")).alias("link_text"), "http_status").alias("l"))
        return rows.agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["l"]).alias(name))

    both = listed(internal, "internal_urls").crossJoin(listed(external, "external_urls"))  # one row each
    return both.select(F.lit(crawl_id).alias("crawl_id"), F.lit(root_domain).alias("root_domain"), F.array(*map(F.lit, root_urls)).alias("root_urls"), F.create_map(*(F.lit(x) for kv in signals.items() for x in kv)).cast("map<string,string>").alias("signals"), "internal_urls", "external_urls")


def quoted(text: Column) -> Column:
    """Text as JSON; null is null."""
    return F.when(text.isNull(), "null").otherwise(F.regexp_extract(F.to_json(F.struct(text.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1))


def fixed(spark: SparkSession, text: str) -> DataFrame:
    """A section of one line."""
    return spark.range(1).select(F.lit(0).alias("key"), F.lit(text).alias("line"))


def elements(rows: DataFrame, key: Column, value: Column) -> DataFrame:
    """A list's elements as lines (key, line), each but the first with a comma before it; keys differ."""
    keyed = rows.select(key.alias("key"), value.alias("_value"))
    first = F.broadcast(keyed.agg(F.min("key").alias("_first")))  # one row
    return keyed.crossJoin(first).select("key", F.concat(F.when(F.col("key") == F.col("_first"), "").otherwise(","), "_value").alias("line"))


def grouped_elements(rows: DataFrame, groups: DataFrame, group: str, order: str, key: Column, value: Column) -> DataFrame:
    """Lists of a map as lines: each group's name and bracket, its elements, and the bracket that ends it.

    ``groups`` has each group once, also those without elements, in the order of column ``order``.
    """
    keyed = rows.join(groups.select(group, order), group).select(order, group, key.alias("at"), value.alias("_value"))
    firsts = keyed.groupBy(group).agg(F.min("at").alias("_first"))  # a row a group
    place = lambda part, at: F.struct(F.col(order).alias("order"), F.col(group).alias("name"), F.lit(part).alias("part"), at.alias("at")).alias("key")
    none = F.lit(None).cast(keyed.schema["at"].dataType)
    first = F.broadcast(groups.agg(F.min(F.struct(order, group)).alias("_first")))  # one row
    comma = lambda own: F.when(own == F.col("_first"), "").otherwise(",")
    begin = groups.crossJoin(first).select(place(0, none), F.concat(comma(F.struct(order, group)), quoted(F.col(group)), F.lit(":[")).alias("line"))
    inner = keyed.join(firsts, group).select(place(1, F.col("at")), F.concat(comma(F.col("at")), "_value").alias("line"))
    return begin.unionByName(inner).unionByName(groups.select(place(2, none), F.lit("]").alias("line")))


def write_sections(sections: Sections, path: str) -> None:
    """Write a document; each section (name, lines by key) is a folder, whose files are in the order of its lines."""
    delete_folder(sections[0][1].sparkSession, path)
    for i, (name, rows) in enumerate(sections):
        rows.repartitionByRange("key").sortWithinPartitions("key").select("line").write.text(f"{path}/{i:02d}-{name}")


def _sections_of(spark: SparkSession, path: str) -> list[str]:
    """The sections of a document in their order; none where it is no folder of sections."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not store.exists(place) or not store.getFileStatus(place).isDirectory():
        return []
    names = [f.getPath().getName() for f in store.listStatus(place) if f.isDirectory()]
    return [n for n in sorted(names) if n[:2].isdigit() and n[2:3] == "-"]


def _folders(spark: SparkSession, path: str) -> dict[str, str]:
    """The folders of a document's sections by their names."""
    return {n[3:]: f"{path}/{n}" for n in _sections_of(spark, path)}


def section_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of a section in their order: seq from 0, and line.

    Rows of a piece of a file follow each other, so a line's place is the piece's, from the
    sizes of the pieces before it, and its own within it; no window holds the lines.
    """
    rows = spark.read.text(folder).select(F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start")).alias("piece"), F.monotonically_increasing_id().alias("row"), F.col("value").alias("line"))
    rows = materialize(rows, "lines")
    pieces = rows.groupBy("piece").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    before = pieces.withColumn("before", F.sum("n").over(Window.orderBy("piece")) - F.col("n"))  # a row a piece of a file
    return rows.join(F.broadcast(before), "piece").select((F.col("before") + F.col("row") - F.col("first")).alias("seq"), "line")


def document_lines(spark: SparkSession, path: str) -> DataFrame:
    """All lines of a document in sections: section (its folder), seq from 0, and line."""
    out = None
    for name in _sections_of(spark, path):
        own = section_lines(spark, f"{path}/{name}").select(F.lit(name).alias("section"), "seq", "line")
        out = own if out is None else out.unionByName(own)
    return out


def _parsed(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """Elements of a list of objects; a line that is none is an error."""
    value = F.from_json(F.regexp_replace("line", "^,", ""), schema, {"mode": "FAILFAST"})
    return lines.select("seq", value.alias("v")).select("seq", "v.*")


def read_head(spark: SparkSession, path: str, schema: T.StructType, rest: str) -> DataFrame:
    """What a document says before its first list ``rest``, as one row; null where it says nothing."""
    folders = _folders(spark, path)
    if not folders:
        return read_json(spark, path, schema)
    line = F.regexp_replace("value", rf',"{rest}":\[$', "}")
    return spark.read.text(folders["head"]).select(F.from_json(line, schema).alias("v")).select("v.*")


def read_crawl_head(spark: SparkSession, path: str) -> DataFrame:
    return read_head(spark, path, CRAWL, "internal_urls")


def read_links(spark: SparkSession, path: str, column: str) -> DataFrame:
    """Link records of a crawl document's list, with their place in it as ``seq``."""
    folders = _folders(spark, path)
    if not folders:
        return links_of(read_crawl(spark, path), column)
    return _parsed(section_lines(spark, folders[column]), LINK).withColumn("link_text", F.coalesce("link_text", F.lit("")))


def read_template_urls(spark: SparkSession, path: str) -> DataFrame:
    """template_id, seq and url of a classification document's template map, in its order."""
    folders = _folders(spark, path)
    if not folders:
        return template_urls(read_classification(spark, path))
    lines = section_lines(spark, folders["template_map"])
    name = r'^,?("(?:[^"\\]|\\.)*"):\[$'
    heads = sorted((r.seq, json.loads(r.name)) for r in lines.where(F.col("line").rlike(name)).select("seq", F.regexp_extract("line", name, 1).alias("name")).collect())  # a row a template
    places, names = np.array([s for s, _ in heads], np.int64), [n for _, n in heads]

    def owner(seq: pa.Array) -> pa.Array:
        return pa.array([names[i] for i in np.searchsorted(places, seq.to_numpy(), "right") - 1], pa.string())

    urls = lines.where(~F.col("line").rlike(name) & (F.col("line") != "]"))
    url = F.from_json(F.concat(F.lit('{"x":'), F.regexp_replace("line", "^,", ""), F.lit("}")), "x string", {"mode": "FAILFAST"})["x"]
    return urls.select(F.arrow_udf(owner, T.StringType())("seq").alias("template_id"), "seq", url.alias("url"))


def write_one_file(spark: SparkSession, folder: str, path: str) -> None:
    """Copy a folder of sections into one file, byte by byte, in the order of the document."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    place, target = jvm.org.apache.hadoop.fs.Path(folder), jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(conf)
    out = target.getFileSystem(conf).create(target, True)
    try:
        for own in _sections_of(spark, folder):
            for f in sorted((f.getPath() for f in store.listStatus(jvm.org.apache.hadoop.fs.Path(place, own)) if f.getPath().getName().startswith("part-")), key=lambda p: p.getName()):
                source = store.open(f)
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, conf, False)
                finally:
                    source.close()
    finally:
        out.close()


def crawl_sections(crawl_id: str, root_domain: str, root_urls: list[str], signals: dict[str, str], internal: DataFrame, external: DataFrame) -> Sections:
    """The crawl document of two link tables (seq, url, source_url, depth, link_text, http_status), as sections.

    ``seq`` orders a table and differs between its rows; a null http_status is left out.
    """
    spark = internal.sparkSession

    def listed(rows: DataFrame) -> DataFrame:
        for c, kind in (("link_text", "string"), ("http_status", "int")):
            if c not in rows.columns:
                rows = rows.withColumn(c, F.lit(None).cast(kind))
        value = F.to_json(F.struct("url", "source_url", F.col("depth").cast("int").alias("depth"), F.coalesce("link_text", F.lit("")).alias("link_text"), "http_status"))
        return elements(rows, F.col("seq"), value)

    head = json.dumps({"crawl_id": crawl_id, "root_domain": root_domain, "root_urls": root_urls, "signals": signals}, ensure_ascii=False, separators=(",", ":"))
    return [
        ("head", fixed(spark, head[:-1] + ',"internal_urls":[')), ("internal_urls", listed(internal)),
        ("then", fixed(spark, '],"external_urls":[')), ("external_urls", listed(external)), ("end", fixed(spark, "]}")),
    ]


def url_sample(urls: DataFrame, most: int = 50) -> DataFrame:
    """The first ``most`` URLs of a classification's template map, as a column ``url``."""
    return urls.orderBy("seq").limit(most).select("url")


def write_url_lists(urls: DataFrame, text_path: str, csv_path: str, most: int = 50) -> None:
    """A sample of URLs as lines of text, and as CSV with a header."""
    sample = url_sample(urls, most).coalesce(1)
    sample.write.mode("overwrite").text(text_path)
    sample.write.mode("overwrite").option("header", True).csv(csv_path)


def summary_lines(crawl_id: str, root_domain: str, generator: tuple[str | None, float], report: DataFrame, templates: DataFrame, uncovered: DataFrame, domains: DataFrame, most_uncovered: int = 5, most_domains: int = 8) -> DataFrame:
    """A classification as a short report: part, at and text; lines are in the order of the first two."""
    spark, name = report.sparkSession, generator[0] or "unknown"
    row = lambda df, part, at, text: df.select(F.lit(part).alias("part"), at.cast("bigint").alias("at"), text.alias("text"))
    zero, lit = F.lit(0), F.lit
    head = spark.range(1).select(F.posexplode(F.array(lit(f"Crawl {crawl_id} of {root_domain}"), lit(f"Generator: {name} ({generator[1]:.2f})"))).alias("at", "line"))
    told = F.format_string("Covered: %d of %d URLs (%.2f %%), %d templates, %.1f URLs each", "covered_urls", "total_internal_urls", "coverage_percent", "template_count", "avg_urls_per_template")
    parts = [
        row(head, 0, F.col("at"), F.col("line")),
        row(report, 1, zero, told),
        row(templates, 2, F.col("rank"), F.format_string("  %s %s %s: %d (%.2f)", "template_id", "pattern", "name", "member_count", "confidence")),
        row(uncovered.orderBy("seq").limit(most_uncovered), 3, F.col("seq"), F.concat(lit("  not covered: "), "url")),
        row(domains.orderBy("first_seq").limit(most_domains), 4, F.col("first_seq"), F.format_string("  %s: %d %s", "domain", "url_count", "classification")),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out
