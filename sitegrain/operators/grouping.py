"""Structural groups of URLs from their path prefixes.

No tree is built. Every prefix of every path is a row, told by 128 bits of hashes; whether a
prefix splits its URLs into sections depends on its children alone, so one aggregation over
prefixes and one over parents decide all of them, and a URL belongs to its shallowest prefix
that does not split. Texts of prefixes are made for the groups alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import segments, urls
from ..tables import hot_keys, join_hot, materialize, release

SEP = "/"
#: Where rows are of many sites, a prefix begins with its site and this, which no segment holds.
SITE_END = "\n"
SITE_PART = "^[^\n]*\n"


def prefixes(rows: DataFrame, path: Column, site: Column | None = None) -> DataFrame:
    """A row for each prefix of each path: seq, n_segments, depth and prefix (segments joined).

    The root is the empty prefix of depth 0, or a site's own. Segments hold no slash, so joining is exact.
    """
    lead = F.lit("") if site is None else F.concat(F.coalesce(site, F.lit("")), F.lit(SITE_END))
    own = rows.select("seq", urls.segments(path).alias("_s"), lead.alias("_lead"))
    deep = own.select("seq", F.size("_s").alias("n_segments"), "_s", "_lead", F.explode(F.sequence(F.lit(0), F.size("_s"))).alias("depth"))
    return deep.select("seq", "n_segments", "depth", F.concat("_lead", F.array_join(F.slice("_s", F.lit(1), F.col("depth")), SEP)).alias("prefix"))


def _parent(prefix: Column) -> Column:
    return F.regexp_replace(prefix, "/?[^/\n]*$", "")


def _last(prefix: Column) -> Column:
    return F.regexp_extract(prefix, "([^/\n]*)$", 1)


def trie_metrics(rows: DataFrame, path: Column) -> DataFrame:
    """Each prefix with its depth, first_seq, descendant_count, own_urls, child_count and child_literal_ratio."""
    return _metrics(prefixes(rows, path))


def _metrics(spread: DataFrame) -> DataFrame:
    nodes = spread.groupBy("prefix", "depth").agg(
        F.min("seq").alias("first_seq"), F.count("*").alias("descendant_count"), F.count_if(F.col("n_segments") == F.col("depth")).alias("own_urls")
    )
    name = _last(F.col("prefix"))
    children = nodes.where("depth > 0").select(_parent(F.col("prefix")).alias("prefix"), segments.is_literal_like(name).cast("int").alias("_literal"))
    children = children.groupBy("prefix").agg(F.count("*").alias("child_count"), F.sum("_literal").alias("_literals"))
    joined = nodes.join(children, "prefix", "left")
    n = F.coalesce("child_count", F.lit(0)).cast("long")
    return joined.select("prefix", "depth", "first_seq", "descendant_count", "own_urls", n.alias("child_count"), F.when(n > 0, F.col("_literals") / n).otherwise(0.0).alias("child_literal_ratio"))


#: Ranges of the order that running sums are taken in, and positions of leaves in a block of a range join.
RANGES, BLOCK = 1024, 1 << 14


def _running(rows: DataFrame, group: str, order: str, size: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``size`` over the group's rows that come before in ``order``.

    The order is cut into ``RANGES``; a window holds a group's rows of one range, or the sums of
    its ranges, so that a group with most of the rows is no single task's.
    """
    lo, hi = rows.agg(F.min(order), F.max(order)).first()
    if lo is None:
        return rows.withColumn(name, F.lit(0).cast("bigint"))
    width = max(1, -(-(hi - lo + 1) // RANGES))
    cut = rows.withColumn("_size", size.cast("bigint")).withColumn("_range", F.floor((F.col(order) - F.lit(lo)) / F.lit(width)).cast("int"))
    sums = cut.groupBy(group, "_range").agg(F.sum("_size").alias("_sum"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(group, "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    own = Window.partitionBy(group, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    joined = cut.withColumn("_in", F.coalesce(F.sum("_size").over(own), F.lit(0))).join(starts, [group, "_range"])
    return joined.withColumn(name, (F.col("_start") + F.col("_in")).cast("bigint")).drop("_size", "_range", "_start", "_in")


def intervals(rows: DataFrame, path: Column) -> tuple[DataFrame, DataFrame]:
    """The prefix tree in pre-order: nodes (prefix, depth, enter, leave) and leaves (seq, prefix, place).

    A node's own URLs come first, in their order, then its children's, in the order of their first
    URL. So the leaves below a node are those whose place is from ``enter`` to before
    ``leave``, and none of them is written more than once. Labels go down level by level; the
    depth of paths bounds the loop, and children of a node with very many are dealt out.
    """
    spread = prefixes(rows, path)
    metrics = materialize(_metrics(spread).withColumn("parent", _parent(F.col("prefix"))), "metrics")
    children = _running(metrics.where("depth > 0"), "parent", "first_seq", F.col("descendant_count"), "_before")
    children = materialize(children, "children")
    hot = hot_keys(metrics.where("child_count > 0").select(F.col("prefix").alias("parent"), F.col("child_count").alias("_n")), metrics.count())
    deepest = metrics.agg(F.max("depth")).first()[0] or 0
    zero = F.lit(0).cast("bigint")
    level = metrics.where("depth = 0").select("prefix", "depth", zero.alias("enter"), "descendant_count", "own_urls")
    levels = [level]
    for depth in range(1, deepest + 1):
        above = level.select(F.col("prefix").alias("parent"), (F.col("enter") + F.col("own_urls")).alias("_base"))
        below = children.where(F.col("depth") == depth)
        level = join_hot(below, above, ["parent"], hot, F.col("first_seq")).select("prefix", "depth", (F.col("_base") + F.col("_before")).alias("enter"), "descendant_count", "own_urls")
        level = materialize(level, "level")
        levels.append(level)
    nodes = levels[0]
    for more in levels[1:]:
        nodes = nodes.unionByName(more)
    own = rows.select("seq", F.array_join(urls.segments(path), SEP).alias("prefix"))
    ranked = _running(own, "prefix", "seq", F.lit(1), "_k")
    own_hot = hot_keys(metrics.select("prefix", F.col("own_urls").alias("_n")), spread.count())
    leaves = join_hot(ranked, nodes.where("own_urls > 0").select("prefix", "enter"), ["prefix"], own_hot, F.col("seq"))
    return nodes.select("prefix", "depth", "enter", (F.col("enter") + F.col("descendant_count")).alias("leave")), leaves.select("seq", "prefix", (F.col("enter") + F.col("_k")).alias("place"))


def leaves_below(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """Leaves of any of :func:`intervals`' nodes, in order: prefix, seq, and pos from 0.

    A range join by blocks of places: a node gives a row for each block that it reaches into.
    """
    block = F.floor(F.col("place") / BLOCK)
    asked = nodes.where("leave > enter").select("prefix", "enter", "leave", F.explode(F.sequence(F.floor(F.col("enter") / BLOCK), F.floor((F.col("leave") - 1) / BLOCK))).alias("_block"))
    joined = asked.join(leaves.select("seq", "place", block.alias("_block")), "_block").where("place >= enter and place < leave")
    return joined.select("prefix", "seq", (F.col("place") - F.col("enter")).alias("pos"))


def _firsts(rows: DataFrame, group: str, order: str, most: int, name: str) -> DataFrame:
    """The first ``most`` rows of each group by ``order``, with their number from 0; picked per salt before they meet."""
    salt = F.pmod(F.xxhash64(order), F.lit(64))
    early = rows.withColumn("_salt", salt).withColumn("_early", F.row_number().over(Window.partitionBy(group, "_salt").orderBy(order))).where(F.col("_early") <= most)
    return early.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1).where(F.col(name) < most).drop("_salt", "_early")


def printed_lines(rows: DataFrame, path: Column, children: int = 5, urls_each: int = 3, deepest: int = 12) -> DataFrame:
    """The tree of prefixes as text, for looking at: place (array, which orders the lines) and text.

    Of each node the first children and own URLs are shown alone, level by level down to
    ``deepest``. A place is the numbers of the children on the way, then 1 for what follows a
    node's children, and its place there.
    """
    spread = prefixes(rows, path)
    metrics = _metrics(spread).withColumn("parent", _parent(F.col("prefix")))
    metrics = materialize(metrics, "metrics")
    shown = materialize(_firsts(metrics.where((F.col("depth") > 0) & (F.col("depth") <= deepest)), "parent", "first_seq", children, "_number"), "shown")
    # Places have the kind before each number: children are 0, lines after them 1.
    level = metrics.where("depth = 0").withColumn("place", F.expr("cast(array() as array<bigint>)"))
    levels = [level]
    for depth in range(1, deepest + 1):
        above = level.select(F.col("prefix").alias("parent"), F.col("place").alias("_place"))
        place = F.concat("_place", F.array(F.lit(0).cast("bigint"), F.col("_number").cast("bigint")))
        level = materialize(shown.where(F.col("depth") == depth).join(above, "parent").withColumn("place", place).select(*metrics.columns, "place"), "level")
        if level.isEmpty():
            break
        levels.append(level)
    nodes = levels[0]
    for more in levels[1:]:
        nodes = nodes.unionByName(more)
    indent = lambda more: F.repeat(F.lit("  "), F.col("depth") + more)
    after = lambda *at: F.concat("place", F.array(F.lit(1).cast("bigint"), *(F.lit(x).cast("bigint") if isinstance(x, int) else x.cast("bigint") for x in at)))
    name = F.when(F.col("depth") == 0, "root").otherwise(_last(F.col("prefix")))
    lines = [nodes.select("place", F.concat(indent(0), name, F.format_string(" [descendants=%d, child_ratio=%.1f]", "descendant_count", "child_literal_ratio")).alias("text"))]
    kept = F.when(F.col("depth") < deepest, F.least(F.col("child_count"), F.lit(children))).otherwise(0)
    lines.append(nodes.where(F.col("child_count") > kept).select(after(0).alias("place"), F.concat(indent(1), F.format_string("... (%d more children)", F.col("child_count") - kept)).alias("text")))
    own = rows.select("seq", "canonical_url", F.array_join(urls.segments(path), SEP).alias("prefix")).join(nodes.where("own_urls > 0").select("prefix", "place", "depth"), "prefix")
    firsts = _firsts(own, "prefix", "seq", urls_each, "_k")
    lines.append(firsts.select(after(1, F.col("_k")).alias("place"), F.concat(indent(1), F.lit("→ "), "canonical_url").alias("text")))
    lines.append(nodes.where(F.col("own_urls") > urls_each).select(after(2).alias("place"), F.concat(indent(1), F.format_string("→ ... (%d more)", F.col("own_urls") - urls_each)).alias("text")))
    out = lines[0]
    for more in lines[1:]:
        out = out.unionByName(more)
    return out


def printed(rows: DataFrame, path: Column, **how: int) -> str:
    """The lines of :func:`printed_lines` as one text."""
    return "\n".join(r.text for r in printed_lines(rows, path, **how).orderBy("place").collect())


def junctions(metrics: DataFrame, ratio: float = 0.7) -> DataFrame:
    """Prefixes with two children or more, most of them literals."""
    return metrics.where((F.col("child_literal_ratio") >= ratio) & (F.col("child_count") >= 2))


def anchors(metrics: DataFrame, ratio: float = 0.3, least: int = 3) -> DataFrame:
    """Prefixes below which segments turn variable, unless a direct child is an anchor itself.

    Whether a prefix is one depends on its children's answer, not on their qualification: along
    a line of prefixes that qualify, every other one counts from below. That is decided by the
    length of the longest qualifying line that ends in an anchor, level by level from the
    deepest; the depth of paths bounds the loop.
    """
    fit = materialize(metrics.where((F.col("child_literal_ratio") < ratio) & (F.col("descendant_count") >= least) & (F.col("child_count") > 0)), "fit")
    deepest = fit.agg(F.max("depth")).first()[0]
    found = None
    for depth in range(deepest if deepest is not None else -1, -1, -1):
        level = fit.where(F.col("depth") == depth)
        if found is not None:
            level = level.join(found.where(F.col("depth") == depth + 1).select(_parent(F.col("prefix")).alias("prefix")), "prefix", "left_anti")
        found = level if found is None else found.unionByName(level)
    return fit.limit(0) if found is None else found


def discover(rows: DataFrame, path: Column | None = None, least: int = 3, site: Column | None = None) -> DataFrame:
    """Groups of ``rows`` (seq, path, version_free_path): seq, group_prefix and group_order.

    With ``site``, each site has groups of its own, all found at once; their prefixes begin with
    the site and a line's end.

    Rows in no group are left out. ``group_prefix`` is the group's path prefix with a slash
    before it, or ``depth_k`` for URLs that only share their number of segments. Groups in
    their order have rising ``group_order`` (struct<late, firsts, depth>).
    """
    path = F.coalesce("version_free_path", "path") if path is None else path
    lead = F.lit("") if site is None else F.concat(F.coalesce(site, F.lit("")), F.lit(SITE_END))
    own = rows.select("seq", urls.segments(path).alias("_s"), lead.alias("_lead"))
    spread = materialize(_told_prefixes(own), "prefixes")
    nodes = spread.groupBy("key", "depth").agg(
        F.min("seq").alias("first_seq"), F.count("*").alias("descendant_count"), F.any_value("parent").alias("parent"), F.any_value("name").alias("name")
    )
    children = nodes.where("depth > 0").groupBy("parent").agg(F.count("*").alias("child_count"), F.avg(segments.is_literal_like(F.col("name")).cast("int")).alias("ratio"))
    nodes = nodes.join(children.withColumnRenamed("parent", "key"), "key", "left")
    nodes = materialize(nodes.withColumns({"child_count": F.coalesce("child_count", F.lit(0)), "ratio": F.coalesce("ratio", F.lit(0.0))}), "nodes")
    section = (F.col("depth") > 0) & segments.classify(F.col("name")).isin("literal", "slug") & (F.col("descendant_count") >= 3)
    below = nodes.where("depth > 0").withColumn("_section", section).groupBy(F.col("parent").alias("key")).agg(
        F.count_if("_section").alias("_sections"),
        F.max(F.when(F.col("_section"), F.col("ratio"))).alias("_most"),
        F.min(F.when(F.col("_section"), (F.col("child_count") > 0).cast("int"))).alias("_lo"),
        F.max(F.when(F.col("_section"), (F.col("child_count") > 0).cast("int"))).alias("_hi"),
    )
    variants = (F.col("_most") < 0.5) & (F.col("_lo") == F.col("_hi"))
    splits = ((F.col("_sections") >= 2) & ~variants) | ((F.col("_sections") == 1) & (F.col("child_count") > 1))
    told = nodes.join(below, "key", "left").select("key", "first_seq", "child_count", F.coalesce(splits, F.lit(False)).alias("_splits"))
    hot = hot_keys(nodes.select("key", F.col("descendant_count").alias("_n")), spread.count())  # the root has all URLs
    held = join_hot(spread.select("seq", "depth", "key"), told, ["key"], hot, F.col("seq"))
    owner = F.min(F.when(~F.col("_splits"), F.struct("depth", "key", "child_count"))).alias("_owner")
    firsts = F.array_sort(F.collect_list(F.struct("depth", "first_seq"))).alias("_firsts")  # as many as a path has prefixes
    placed = held.groupBy("seq").agg(owner, firsts)
    placed = materialize(placed.withColumn("_key", F.when(F.col("_owner.child_count") > 0, F.col("_owner.key"))).join(own, "seq"), "placed")
    release(spread, nodes)
    sizes = placed.where("_key is not null").groupBy("_key").agg(F.count("*").alias("_size")).where(F.col("_size") >= least)
    placed = placed.join(sizes, "_key", "left")
    trail = F.transform(F.filter("_firsts", lambda x: x["depth"] <= F.col("_owner.depth")), lambda x: x["first_seq"])
    prefix = F.concat("_lead", F.lit("/"), F.array_join(F.slice("_s", F.lit(1), F.col("_owner.depth")), SEP))
    grouped = placed.where("_size is not null").select("seq", prefix.alias("group_prefix"), F.struct(F.lit(0).alias("late"), trail.alias("firsts"), F.lit(0).alias("depth")).alias("group_order"))
    rest = placed.where("_size is null").select("seq", F.size("_s").alias("_n"), "_lead")
    enough = rest.groupBy("_lead", "_n").agg(F.count("*").alias("_size")).where(F.col("_size") >= least)
    order = "struct<late:int,firsts:array<bigint>,depth:int>"
    late = F.struct(F.lit(1).alias("late"), F.expr("cast(array() as array<bigint>)").alias("firsts"), F.col("_n").alias("depth")).cast(order)
    enough = F.broadcast(enough) if site is None else enough  # a row for each path length, of each site
    by_depth = rest.join(enough, ["_lead", "_n"]).select("seq", F.concat("_lead", F.format_string("depth_%d", "_n")).alias("group_prefix"), late.alias("group_order"))
    return grouped.withColumn("group_order", F.col("group_order").cast(order)).unionByName(by_depth)


def _told_prefixes(own: DataFrame) -> DataFrame:
    """A row for each prefix of each of ``own`` (seq, _s, _lead): seq, depth, and the prefix as a key of 128 bits, with its parent's and its last segment."""

    def key(depth: Column) -> Column:
        text = F.concat("_lead", F.array_join(F.slice("_s", F.lit(1), depth), SEP))
        return F.struct(depth.alias("d"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit("#"), text).alias("b"))

    deep = own.select("seq", "_s", "_lead", F.explode(F.sequence(F.lit(0), F.size("_s"))).alias("depth"))
    name = F.when(F.col("depth") > 0, F.element_at("_s", F.greatest("depth", F.lit(1)))).otherwise("")
    return deep.select("seq", "depth", key(F.col("depth")).alias("key"), F.when(F.col("depth") > 0, key(F.col("depth") - 1)).alias("parent"), name.alias("name"))


def position_frequencies(rows: DataFrame, path: Column) -> DataFrame:
    """pos, raw, n and freq of every segment at the positions that all paths have."""
    own = rows.select(urls.segments(path).alias("_s"))
    bounds = own.agg(F.min(F.size("_s")).alias("_least"), F.count("*").alias("_total"))
    counts = own.select(F.posexplode("_s").alias("pos", "raw")).groupBy("pos", "raw").agg(F.count("*").alias("n"))
    joined = counts.crossJoin(F.broadcast(bounds)).where("pos < _least")  # with one row
    return joined.select("pos", "raw", "n", (F.col("n") / F.col("_total")).alias("freq"))


def position_classes(frequencies: DataFrame, static: float = 0.8, variable: float = 0.1) -> DataFrame:
    """pos and whether its segments are static, variable or semi_variable."""
    top = frequencies.groupBy("pos").agg(F.max("freq").alias("top"))
    return top.select("pos", F.when(F.col("top") >= static, "static").when(F.col("top") < variable, "variable").otherwise("semi_variable").alias("kind"))


def fingerprints(rows: DataFrame, classes: DataFrame, path: Column) -> DataFrame:
    """seq and fingerprint: static segments as they are, others by their type in upper case."""
    own = rows.select("seq", F.posexplode_outer(urls.segments(path)).alias("pos", "raw"))
    joined = own.join(F.broadcast(classes), "pos", "left")  # a row for each position
    piece = F.when(F.col("kind") == "static", F.col("raw")).otherwise(F.upper(segments.classify(F.col("raw"))))
    listed = F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", piece.alias("piece")))))
    return joined.groupBy("seq").agg(F.array_join(F.transform(listed, lambda x: x["piece"]), "/").alias("fingerprint"))
