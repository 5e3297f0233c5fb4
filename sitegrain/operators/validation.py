"""Rules that extracted records are held against, and the rounds of healing those that fail."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import GARBAGE, RECORD_FIELDS


def score_field(value: Column, least: int) -> Column:
    """ok, empty, garbage or too_short for a field's value as text.

    A null is empty, even where the field may be; an empty text, list or object is ok where
    nothing is asked (``least`` 0).
    """
    text = F.regexp_replace(value, r"(?U)^\s+|\s+$", "")
    text = F.when(text.isin("[]", "{}"), "").otherwise(text)
    return (
        F.when(value.isNull(), "empty")
        .when(text == "", "ok" if least == 0 else "empty")
        .when(F.lower(text).isin(*GARBAGE), "garbage")
        .when(F.length(text) < least, "too_short")
        .otherwise("ok")
    )


def verdict(fields: dict[str, Column], rules: dict[str, int] | None = None) -> Column:
    """PASS, BORDERLINE or FAIL of a record: half its fields bad is FAIL, none is PASS."""
    rules = RECORD_FIELDS if rules is None else rules
    scores = {name: score_field(fields[name], least) for name, least in rules.items()}
    count = lambda *kinds: sum((F.when(s.isin(*kinds), 1).otherwise(0) for s in scores.values()), F.lit(0))
    bad = count("empty", "garbage")
    return F.when(bad >= len(rules) // 2, "FAIL").when((bad == 0) & (count("too_short") == 0), "PASS").otherwise("BORDERLINE")


def validate_json(record: Column, rules: dict[str, int] | None = None) -> Column:
    """The verdict on a record as JSON text: an object, or an array whose first object counts.

    What cannot be parsed, an empty array, a first element that is no object, and raw output
    of a tool all FAIL.
    """
    rules = RECORD_FIELDS if rules is None else rules
    text = F.trim(record)
    parsed = F.try_parse_json(text)
    is_list = text.startswith("[")
    target = F.when(is_list, F.get_json_object(text, "$[0]")).otherwise(text)
    is_object = F.try_parse_json(target).isNotNull() & F.trim(target).startswith("{")
    raw = ~is_list & F.array_contains(F.json_object_keys(F.when(is_object, target)), "raw_output")
    fields = {name: F.get_json_object(target, f"$.{name}") for name in rules}
    return F.when(parsed.isNull() | ~is_object | F.coalesce(raw, F.lit(False)), "FAIL").otherwise(verdict(fields, rules))


def validate_schema(data: Column, required: list[str], optional: list[str] = ()) -> Column:
    """struct<passed, missing_required, empty_required, missing_optional, score> of a map of fields.

    The score is the share of required fields that are there and not empty.
    """
    names = F.array(*map(F.lit, required)) if required else F.expr("cast(array() as array<string>)")
    more = F.array(*map(F.lit, optional)) if optional else F.expr("cast(array() as array<string>)")
    missing = F.filter(names, lambda n: F.try_element_at(data, n).isNull())
    empty = F.filter(names, lambda n: F.coalesce(F.try_element_at(data, n).isin("", "[]"), F.lit(False)))
    gone = F.filter(more, lambda n: F.try_element_at(data, n).isNull())
    bad = F.size(missing) + F.size(empty)
    score = F.lit(1.0) if not required else (len(required) - bad) / F.lit(len(required))
    return F.struct((bad == 0).alias("passed"), missing.alias("missing_required"), empty.alias("empty_required"), gone.alias("missing_optional"), score.alias("score"))


def template_stats(records: DataFrame) -> DataFrame:
    """Per template_id: records, passed, borderline, failed (by column ``verdict``)."""
    is_one = lambda v: F.count_if(F.col("verdict") == v)
    return records.groupBy("template_id").agg(F.count("*").alias("total"), is_one("PASS").alias("passed"), is_one("BORDERLINE").alias("borderline"), is_one("FAIL").alias("failed"))


def limit_per_template(found: DataFrame, most: int) -> DataFrame:
    """The first ``most`` rows (by seq) of each template_id; all for 0.

    They are picked per salt first, so that a template with most of the rows is spread out.
    """
    if most <= 0:
        return found
    salted = found.withColumn("_salt", F.pmod(F.xxhash64("seq"), F.lit(64)))
    early = salted.withColumn("_k", F.row_number().over(Window.partitionBy("template_id", "_salt").orderBy("seq"))).where(F.col("_k") <= most)
    return early.withColumn("_k", F.row_number().over(Window.partitionBy("template_id").orderBy("seq"))).where(F.col("_k") <= most).drop("_salt", "_k")


def heal_rounds(urls: DataFrame, extract: Callable[[DataFrame, int], DataFrame], attempts: int = 2, accept: Callable[[DataFrame], DataFrame] | None = None, keep: Callable[[DataFrame, str], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Extract records, and again those that fail, ``attempts`` times at most.

    ``extract(urls, round)`` returns ``urls`` with a JSON column ``data``; it may heal its
    extractor between rounds, of which it is told the number. Records that PASS are done;
    of those that are BORDERLINE, ``accept`` may add a boolean column ``accepted`` (without
    it none is). ``keep`` may write a round's table to a shared store and read it back.
    Returns the records with their round, and the URLs that failed in all rounds.
    """
    done, left = None, urls
    for turn in range(attempts + 1):
        tried = extract(left, turn).withColumn("verdict", validate_json(F.col("data")))
        tried = tried.withColumn("accepted", F.lit(False)) if accept is None else accept(tried)
        good = (F.col("verdict") == "PASS") | ((F.col("verdict") == "BORDERLINE") & F.coalesce("accepted", F.lit(False)))
        tried = tried.withColumn("_good", good).withColumn("round", F.lit(turn))
        tried = tried if keep is None else keep(tried, f"round-{turn}")
        passed = tried.where("_good").drop("_good")
        done = passed if done is None else done.unionByName(passed)
        left = tried.where("not _good").select(*urls.columns)
    return done, left


def run_counts(total: DataFrame, done: DataFrame, failed: DataFrame) -> DataFrame:
    """One row: total_urls, processed (whether they failed or not), healed (after the first round) and failed."""
    good = done.agg(F.count("*").alias("_good"), F.count_if(F.col("round") > 0).alias("healed"))
    bad = failed.agg(F.count("*").alias("failed"))
    one = total.agg(F.count("*").alias("total_urls")).crossJoin(good).crossJoin(bad)  # one row each
    return one.select("total_urls", (F.col("_good") + F.col("failed")).alias("processed"), "healed", "failed")
