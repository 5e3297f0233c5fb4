"""Operator 9: personal data, by DataFrame functions alone.

Regular expressions propose spans, validators confirm them (Luhn for cards, mod-97 for
bank accounts, ranges and digit counts for the rest), and words nearby adjust the score.
A regular expression's matches get their places without Python: each match is wrapped in
a mark that texts are freed of, the text is split at the marks, and the lengths of the
parts add up to code-point offsets. Sums run over blocks of parts, so that time grows with
a text's length alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import materialize, spare

MARK, STAND_IN = "\x01", "\x02"

#: What is proposed, by kind. A match of email, ip or card can only begin where
#: a run of its characters begins or where the last match ended, which the look-behind says;
#: possessive repeats hold as what follows is never in the repeated class. So long runs cost
#: time in proportion to their length.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Kinds that the method adds: bank accounts (IBAN), and numbers written as 3-2-4 digits.
ADDED = {
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: Words that raise a kind's score when they stand in the ``CONTEXT`` characters before or after.
NEARBY = {
    "email": "mail|contact|write",
    "ip": "ip|host|server|address",
    "card": "card|visa|credit|payment",
    "phone": "phone|call|tel|mobile",
    "iban": "iban|account|bank",
    "ssn": "ssn|social security|tax id",
}
#: Score of a validated match without context; context adds 0.3, and a span needs ``LEAST``.
PRIOR = {"email": 0.7, "ip": 0.7, "card": 0.7, "phone": 0.7, "iban": 0.7, "ssn": 0.3}
CONTEXT, LEAST = 32, 0.5


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _mod97(account: Column) -> Column:
    c = F.replace(account, F.lit(" "), F.lit(""))
    moved = F.concat(F.substr(c, F.lit(5)), F.substr(c, F.lit(1), F.lit(4)))

    def add(rest: Column, x: Column) -> Column:
        return F.when(x.rlike("[0-9]"), (rest * 10 + F.ascii(x) - 48) % 97).otherwise((rest * 100 + F.ascii(x) - 55) % 97)

    return F.aggregate(F.filter(F.split(moved, ""), lambda x: x != ""), F.lit(0), add) == 1


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        return F.when(n.between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    if kind == "iban":
        return F.when(F.length(F.replace(m, F.lit(" "), F.lit(""))).between(15, 34), _mod97(m)).otherwise(False)
    return F.lit(True)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value made once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _before(numbers: Column, fold: Callable[[Column, Column], Column], block: int = 256) -> Column:
    """For each number the fold of all before it, from 0 on: sums or maxima.

    Arrays grow by copying, so none grows longer than a block or the number of blocks.
    """
    zero = F.lit(0).cast("long")

    def run(values: Column, start: Column) -> Column:
        state = F.struct(start.alias("at"), F.expr("cast(array() as array<bigint>)").alias("out"))
        return F.aggregate(values, state, lambda s, x: F.struct(fold(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])

    def folded(blocks: Column) -> Column:
        whole = F.transform(blocks, lambda values: F.aggregate(values, zero, fold))
        return F.flatten(F.zip_with(blocks, run(whole, zero), run))

    def blocked(values: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / block).cast("int")), lambda k: F.slice(values, k * block + 1, F.lit(block)))

    return _let(numbers, lambda values: F.when(F.size(values) > 0, _let(blocked(values), folded)).otherwise(values))


#: So many parts hold ``CONTEXT`` characters at least: two parts have three of them or more.
_PARTS = 24


def _near(kind: str, parts: Column, i: Column) -> Column:
    """Whether a word of the kind stands in the ``CONTEXT`` characters before or after part ``i``."""
    words = rf"(?:^|[^a-z])(?:{NEARBY[kind]})"
    first = F.greatest(F.lit(1), i - _PARTS)
    ahead = F.right(F.array_join(F.transform(F.slice(parts, first, i - first), lambda p: F.right(p, F.lit(CONTEXT))), ""), F.lit(CONTEXT))
    behind = F.left(F.array_join(F.transform(F.slice(parts, i + 1, F.lit(_PARTS)), lambda p: F.left(p, F.lit(CONTEXT))), ""), F.lit(CONTEXT))
    return F.lower(ahead).rlike(words) | F.lower(behind).rlike(words)


_NONE = "cast(array() as array<struct<kind:string,start:bigint,end:bigint,score:double>>)"


def _spans(kind: str, pattern: str, text: Column) -> Column:
    """Array of struct<kind, start, end, score> of the valid matches, starts rising."""

    def listed(parts: Column, starts: Column) -> Column:
        valid = F.filter(F.sequence(F.lit(2), F.size(parts), F.lit(2)), lambda i: _valid(kind, F.element_at(parts, i)))

        def span(i: Column) -> Column:
            start = F.element_at(starts, i)
            score = F.lit(PRIOR[kind]) + F.when(_near(kind, parts, i), 0.3).otherwise(0.0)
            return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(F.element_at(parts, i))).alias("end"), score.alias("score"))

        return F.filter(F.transform(valid, span), lambda s: s["score"] >= LEAST)

    def found(parts: Column) -> Column:
        sizes = F.transform(parts, lambda p: F.length(p).cast("long"))
        return F.when(F.size(parts) > 1, _let(_before(sizes, lambda a, x: a + x), lambda starts: listed(parts, starts))).otherwise(F.expr(_NONE))

    return _let(F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1), found)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs`` and ``spans``: array of struct<kind, start, end, score>.

    Spans come by kind (email, ip, card, phone, iban, ssn), then start; places are code
    points, ends exclusive. Matches of a kind are leftmost and do not overlap; those that
    fail its validator are dropped and not tried again. A null or empty text has none; a very
    long one takes time in proportion to its length. Repeated rows each get their own; an own
    column ``spans`` is replaced. An empty table gives an empty table.
    """
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), MARK, STAND_IN)
    docs = docs.drop("spans")
    safe, own = spare("_safe", docs.columns), {k: spare(f"_{k}", docs.columns) for k in BASE | ADDED}
    made = docs.withColumn(safe, text)
    made = made.withColumns({own[k]: _spans(k, p, F.col(safe)) for k, p in (BASE | ADDED).items()})
    return made.select(*docs.columns, F.concat(*map(F.col, own.values())).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Per row of :func:`find_personal_data`: counts by base kind, digest of base spans, all spans and their scores."""
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    scores = F.array_join(F.transform("spans", lambda s: F.format_number(s["score"], 1)), ",")
    return found.select("doc_id", *map(count, BASE), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), scores.alias("scores"))


def redact(docs: DataFrame, passes: int = 4) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind, as in ``[EMAIL]``.

    Spans that overlap are merged and get the kind of the first. Cutting a span can free
    another: digits that ran on into it were no card before and are one now. So texts that
    changed are looked through again until none does, ``passes`` times between two written
    tables; as a cut takes digits or an at sign away, that ends. Texts without spans
    stay as they are; where ``docs`` has ``n_chars`` it is the new text's length. Column
    order stays.
    """
    own = docs.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(docs.columns) if c != "text"), F.col("text").cast("string").alias("text"), F.lit(True).alias("_go"))
    done = None
    while True:
        for _ in range(passes):
            own = _redacted_once(own)
        own = materialize(own, "redacted")
        settled = own.where("not _go")
        done = settled if done is None else done.unionByName(settled)
        own = own.where("_go")
        if own.isEmpty():
            break
    names = {c: f"_{i}" for i, c in enumerate(docs.columns)}
    columns = []
    for c in docs.columns:
        if c == "n_chars":
            columns.append(F.when(F.col("_changed"), F.length("text").cast(docs.schema[c].dataType)).otherwise(F.col(names[c])).alias(c))
        else:
            columns.append(F.col("text" if c == "text" else names[c]).alias(c))
    return done.select(*columns)


def _redacted(text: Column, spans: Column, block: int = 4096) -> Column:
    """``text`` with spans replaced by their kinds; it is cut into blocks once and joined once."""
    by_place = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def cut(blocks: Column, a: Column, b: Column) -> Column:
        """Characters ``a`` to ``b`` - 1."""

        def part(k: Column) -> Column:
            first = F.greatest(a - k * block, F.lit(0))
            return F.substr(F.element_at(blocks, k + 1), (first + 1).cast("int"), (F.least(b - k * block, F.lit(block)) - first).cast("int"))

        whole = F.sequence(F.floor(a / block).cast("int"), F.floor((b - 1) / block).cast("int"))
        return F.when(b > a, F.array_join(F.transform(whole, part), "")).otherwise("")

    def rebuilt(x: Column) -> Column:
        blocks, own, reach = x["blocks"], x["own"], x["reach"]
        pieces = F.transform(own, lambda s, i: F.when(s["start"] >= F.get(reach, i), F.concat(cut(blocks, F.get(reach, i), s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))))
        tail = cut(blocks, F.array_max(F.transform(own, lambda s: s["end"])), F.length(text).cast("long"))
        return F.array_join(F.concat(pieces, F.array(tail)), "")

    def bound(own: Column) -> Column:
        reach = _before(F.transform(own, lambda s: s["end"]), lambda a, e: F.greatest(a, e))
        blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
        return _let(F.struct(blocks.alias("blocks"), own.alias("own"), reach.alias("reach")), rebuilt)

    return _let(by_place, bound)


def _redacted_once(own: DataFrame) -> DataFrame:
    """One pass over the rows where ``_go``; it stays so where something was replaced."""
    seen = find_personal_data(own.withColumn("_kept", F.col("text")).withColumn("text", F.when(F.col("_go"), F.col("text"))))
    text, found = F.col("_kept"), F.size("spans") > 0
    changed = (F.col("_changed") | found) if "_changed" in own.columns else found
    rest = [c for c in own.columns if c not in ("text", "_go", "_changed")]
    return seen.select(*rest, F.when(found, _redacted(text, F.col("spans"))).otherwise(text).alias("text"), found.alias("_go"), changed.alias("_changed"))
