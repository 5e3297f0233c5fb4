"""Path templates of groups: derivation, merging of like ones, ranking."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import segments, urls
from ..functions.values import TEMPLATE_NAMES
from ..tables import materialize
from .grouping import SITE_PART

TEMPLATES = "template_id string, name string, pattern string, fingerprint string, member_count bigint, versions_covered array<string>, scope string, example_urls array<string>, confidence double, rank int"


def name_of(prefix: Column, pattern: Column) -> Column:
    """A template's name from its group's prefix; the first piece that is known counts."""
    prefix = F.lower(prefix)
    known = F.lit(None).cast("string")
    for piece, name in reversed(TEMPLATE_NAMES):
        known = F.when(prefix.contains(piece), name).otherwise(known)
    parts = F.filter(F.split(prefix, "/"), lambda x: (x != "") & ~x.startswith("<") & ~x.startswith("depth_"))
    return F.coalesce(known, F.when(F.lower(pattern).contains("generated"), "api_reference"), F.get(parts, F.lit(0)), F.lit("catch_all"))


def derive(rows: DataFrame, groups: DataFrame, path: Column | None = None, examples: int = 5) -> DataFrame:
    """A template for each group: group_prefix, group_order, pattern, fingerprint and the rest.

    ``rows`` has seq, canonical_url, path, version and version_free_path. A position with one
    value is a literal; with two or three, the commonest is one if it has three quarters; all
    others become their commonest type. Ties go to what was seen first. All of it comes from
    aggregates per (group, position, value), so no group is gathered.
    """
    path = F.coalesce("version_free_path", "path") if path is None else path
    own = materialize(rows.join(groups, "seq").select("seq", "canonical_url", "version", "group_prefix", "group_order", urls.segments(path).alias("_s")).withColumn("_n", F.size("_s")), "members")
    firsts = F.slice(F.array_sort(F.collect_list(F.when(F.col("_k") <= examples, F.struct("seq", "canonical_url")))), 1, examples)
    salted = own.withColumn("_k", F.row_number().over(Window.partitionBy("group_prefix", F.pmod(F.xxhash64("seq"), F.lit(64))).orderBy("seq")))  # so few of each salt can be examples
    whole = salted.groupBy("group_prefix").agg(
        F.min("group_order").alias("group_order"), F.count("*").alias("member_count"), F.min("_n").alias("_min"), F.max("_n").alias("_max"), firsts.alias("_first"),
        F.array_sort(F.collect_set(F.nullif("version", F.lit("")))).alias("versions_covered"),
    )
    placed = own.join(whole.select("group_prefix", "_min", "_max"), "group_prefix")
    values = placed.select("group_prefix", "seq", F.posexplode(F.slice("_s", F.lit(1), F.col("_min"))).alias("pos", "raw"))
    counts = values.groupBy("group_prefix", "pos", "raw").agg(F.count("*").alias("n"), F.min("seq").alias("seen"))
    typed = counts.withColumn("kind", segments.classify(F.col("raw"))).groupBy("group_prefix", "pos", "kind").agg(
        F.sum("n").alias("k"), F.min("seen").alias("kind_seen"), F.max(F.struct("n", -F.col("seen"), "raw")).alias("top"), F.count("*").alias("distinct")
    )
    at = typed.groupBy("group_prefix", "pos").agg(F.sum("distinct").alias("distinct"), F.sum("k").alias("total"), F.max("top").alias("top"), F.max(F.struct("k", -F.col("kind_seen"), "kind")).alias("kind"))
    literal = (F.col("distinct") == 1) | ((F.col("distinct") <= 3) & (F.col("top.n") / F.col("total") >= 0.75))
    at = at.select(
        "group_prefix", "pos", (F.col("distinct") == 1).cast("int").alias("_static"),
        F.when(literal, F.col("top.raw")).otherwise(F.concat(F.lit("<"), F.col("kind.kind"), F.lit(">"))).alias("part"),
        F.when(literal, F.upper("top.raw")).otherwise(F.col("kind.kind")).alias("print"),
    )
    parts = at.groupBy("group_prefix").agg(F.array_sort(F.collect_list(F.struct("pos", "part", "print"))).alias("_parts"), F.sum("_static").alias("_statics"))  # a row for each position
    tails = placed.where("_n > _min").withColumn("_tail", F.array_join(F.slice("_s", F.col("_min") + 1, F.col("_n")), "/"))
    tails = tails.groupBy("group_prefix").agg(F.min("_tail").alias("_lo"), F.max("_tail").alias("_hi"))
    joined = whole.join(parts, "group_prefix", "left").join(tails, "group_prefix", "left")
    same = F.col("_lo") == F.col("_hi")
    more = lambda one, many: F.when(F.col("_lo").isNull(), F.expr("cast(array() as array<string>)")).when(same, F.array(one)).otherwise(F.array(F.lit(many)))
    none = F.expr("cast(array() as array<string>)")
    pattern = F.concat(F.lit("/"), F.array_join(F.concat(F.coalesce(F.col("_parts.part"), none), more(F.col("_lo"), "...")), "/"))
    fingerprint = F.array_join(F.concat(F.coalesce(F.col("_parts.print"), none), more(F.lit("STATIC_DEEP"), "DEEPER")), "/")
    prefix = F.regexp_replace("group_prefix", SITE_PART, "")
    plain = prefix.isin("", "/") | prefix.startswith("/<")
    uniform = F.coalesce("_statics", F.lit(0)) / F.greatest("_min", F.lit(1))
    score = F.least(F.col("member_count") / 50.0, F.lit(1.0)) * 0.25 + uniform * 0.5 + F.when(plain, 0.0).otherwise(0.15) + 0.15
    out = joined.select("group_prefix", "group_order", "member_count", "versions_covered", F.col("_first.canonical_url").alias("example_urls"), pattern.alias("pattern"), fingerprint.alias("fingerprint"), F.greatest(F.least(score, F.lit(1.0)), F.lit(0.1)).alias("confidence"))
    return out.withColumn("name", name_of(prefix, F.col("pattern")))


@dataclass(frozen=True)
class Template:
    name: str
    pattern: str
    fingerprint: str
    member_count: int
    versions_covered: tuple[str, ...] = ()
    example_urls: tuple[str, ...] = ()
    confidence: float = 0.0
    scope: str = field(default="internal")

    def specificity(self) -> tuple[int, int, int]:
        parts = self.pattern.strip("/").split("/")
        return -sum(not p.startswith("<") and p != "..." for p in parts), -len(parts), -self.member_count


def specificity_of(pattern: Column, member_count: Column) -> Column:
    """struct<literals, parts, members>, all negative: templates are tried in this order."""
    parts = F.split(F.regexp_replace(pattern, "^/+|/+$", ""), "/", -1)
    literals = F.size(F.filter(parts, lambda p: ~p.startswith("<") & (p != "...")))
    return F.struct((-literals).alias("literals"), (-F.size(parts)).alias("parts"), (-member_count).alias("members"))


def merge_distance(a: Template, b: Template, strict: bool = False) -> int | None:
    """At how many positions two fingerprints differ; None if they cannot be one template.

    A literal that differs forbids it. By default only words of letters count as literals, so
    names with digits, dots or underscores do not; ``strict`` takes every upper-case part.
    """
    x, y = a.fingerprint.split("/"), b.fingerprint.split("/")
    if len(x) != len(y):
        return None
    unlike = [(p, q) for p, q in zip(x, y) if p != q]
    return None if any(_is_literal(p, strict) or _is_literal(q, strict) for p, q in unlike) else len(unlike)


def merge_pair(a: Template, b: Template, examples: int = 5) -> Template:
    """One template for two: the larger one's form, both members and versions."""
    first, other = (a, b) if a.member_count >= b.member_count else (b, a)
    return replace(
        first, member_count=a.member_count + b.member_count, versions_covered=tuple(sorted({*a.versions_covered, *b.versions_covered})),
        example_urls=tuple(dict.fromkeys(first.example_urls + other.example_urls))[:examples], confidence=min(a.confidence, b.confidence),
    )


def _is_literal(part: str, strict: bool) -> bool:
    return part == part.upper() and (part != part.lower() if strict else part.isalpha())


def _neighbourhood(fingerprint: str, distance: int, strict: bool) -> list[tuple]:
    """Keys by which a fingerprint meets those at most so far from it, the nearest first.

    A key is the fingerprint with some positions left out, none of which may hold a literal. Two
    fingerprints share one of k positions just if they can be one template and differ at no others.
    """
    parts = fingerprint.split("/")
    free = [i for i, p in enumerate(parts) if not _is_literal(p, strict)]
    out = []
    for k in range(min(distance, len(free)) + 1):
        for gone in combinations(free, k):
            out.append((gone, tuple(p for i, p in enumerate(parts) if i not in gone)) if k else (len(parts), fingerprint))
    return out


def merge(templates: list[Template], distance: int = 1, strict: bool = False) -> list[Template]:
    """Templates merged in pairs, each with its nearest later one, until no pair is near enough.

    A round goes through the templates in order. Each finds its partner under its own keys: the
    first that is left under its nearest one with any. Keys are read from the front and what is
    taken is dropped there, so a round costs as much as there are keys.
    """
    while True:
        keys = [_neighbourhood(t.fingerprint, distance, strict) for t in templates]
        lists: dict[tuple, deque[int]] = {}
        for i, own in enumerate(keys):
            for key in own:
                lists.setdefault(key, deque()).append(i)
        taken, out = [False] * len(templates), []
        for i, a in enumerate(templates):
            if taken[i]:
                continue
            taken[i] = True
            near: tuple[int, int] | None = None
            for key in keys[i]:
                apart = len(key[0]) if isinstance(key[0], tuple) else 0
                if near is not None and apart > near[0]:
                    break
                line = lists[key]
                while line and taken[line[0]]:
                    line.popleft()
                if line and (near is None or line[0] < near[1]):
                    near = apart, line[0]
            if near is None:
                out.append(a)
            else:
                taken[near[1]] = True
                out.append(merge_pair(a, templates[near[1]]))
        if len(out) == len(templates):
            return out
        templates = out


def _listed(rows: Iterable) -> list[Template]:
    return [Template(r.name, r.pattern, r.fingerprint, r.member_count, tuple(r.versions_covered), tuple(r.example_urls), round(r.confidence, 2)) for r in rows]


def finalise(derived: DataFrame, strict: bool = False, most: int = 100_000) -> list[tuple[str, Template]]:
    """(template_id, template) of derived templates, merged and ranked by how specific they are.

    ``derived`` has a row for each group of one site; more than ``most`` is an error.
    """
    rows = derived.orderBy("group_order").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} groups: this is no single site")
    return _ranked(_listed(rows), strict)


def _ranked(listed: list[Template], strict: bool) -> list[tuple[str, Template]]:
    ranked = sorted(merge(listed, strict=strict), key=Template.specificity)
    return [(f"tpl_{i:03d}", t) for i, t in enumerate(ranked, 1)]


def finalise_sites(derived: DataFrame, strict: bool = False) -> DataFrame:
    """Templates of many sites at once: site, template_id within it, and the rest; see :func:`finalise`.

    ``derived`` has a column ``site`` and a row for each group. A task takes the groups of
    whole sites, so what bounds it is the number of groups of one site, not that of its URLs.
    """

    def one(group: pd.DataFrame) -> pd.DataFrame:
        order = [tuple(o) for o in group["_order"]]
        rows = group.iloc[sorted(range(len(group)), key=order.__getitem__)]
        site = rows["site"].iloc[0]
        made = _ranked(_listed(rows.itertuples()), strict)
        return pd.DataFrame(
            [(site, i, t.name, t.pattern, t.fingerprint, t.member_count, list(t.versions_covered), t.scope, list(t.example_urls), t.confidence, k) for k, (i, t) in enumerate(made)],
            columns=["site", *(c.split()[0] for c in TEMPLATES.split(", "))],
        )

    o = F.col("group_order")
    order = F.concat(F.array(o["late"].cast("bigint")), o["firsts"], F.when(o["late"] == 1, F.array(o["depth"].cast("bigint"))).otherwise(F.expr("cast(array() as array<bigint>)")))
    columns = ["site", order.alias("_order"), "name", "pattern", "fingerprint", "member_count", "versions_covered", "example_urls", "confidence"]
    return derived.select(*columns).groupBy("site").applyInPandas(one, f"site string, {TEMPLATES}")


def as_table(spark: SparkSession, templates: list[tuple[str, Template]]) -> DataFrame:
    """Templates as a table; ``rank`` is the order in which they are tried."""
    rows = [(i, t.name, t.pattern, t.fingerprint, t.member_count, list(t.versions_covered), t.scope, list(t.example_urls), t.confidence, k) for k, (i, t) in enumerate(templates)]
    return spark.createDataFrame(rows, TEMPLATES)
