"""URL functions as Column expressions: parsing, canonical forms, resolution, versions.

All stay in the JVM. URLs are taken apart by one regular expression after RFC 3986, which
never fails; malformed input gives odd parts, not errors. A null URL gives nulls. A URL is
taken apart once, however many of its parts are used.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import let
from .values import ASSET_EXTENSIONS, LANGUAGES, SKIP_EXTENSIONS, SKIP_PREFIXES, TRACKING_PARAMS

#: Groups: 1 scheme, 2 authority with its slashes, 3 authority, 4 path, 5 query, 6 fragment.
SPLIT = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(//([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_EMPTY = "cast(array() as array<string>)"


def part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, SPLIT, group)


#: Stands between the parts of a URL, which has no such character.
_SEP = "\ue000"


def parts(url: Column) -> Column:
    """All parts of a URL, by their groups from 0."""
    return F.split(F.regexp_replace(F.translate(url, _SEP, "\ufffd"), SPLIT, _SEP.join(f"${i}" for i in range(1, 7))), _SEP, -1)


def with_scheme(url: Column) -> Column:
    """https is assumed where no http, https or ftp stands before; the test heeds case."""
    return F.when((url == "") | url.rlike("^(?:http|https|ftp)://"), url).otherwise(F.concat(F.lit("https://"), url))


def _without_default_port(host: Column, scheme: Column) -> Column:
    return (
        F.when((scheme == "http") & host.endswith(":80"), F.regexp_replace(host, ":80$", ""))
        .when((scheme == "https") & host.endswith(":443"), F.regexp_replace(host, ":443$", ""))
        .otherwise(host)
    )


def _without_params(path: Column) -> Column:
    """A path without what follows a semicolon in its last segment."""
    return F.regexp_replace(path, ";[^/]*$", "")


def _scheme(p: Column) -> Column:
    return F.when(p[0] == "", "https").otherwise(F.lower(p[0]))


def _host(p: Column) -> Column:
    return _without_default_port(F.lower(p[2]), _scheme(p))


def _path(p: Column) -> Column:
    return let(_without_params(p[3]), lambda x: F.when(x == "", "/").otherwise(x))


def scheme_of(url: Column) -> Column:
    return let(parts(with_scheme(url)), _scheme)


def host_of(url: Column) -> Column:
    """Authority in lower case without a default port."""
    return let(parts(with_scheme(url)), _host)


def path_of(url: Column) -> Column:
    return let(parts(with_scheme(url)), _path)


def fragment_of(url: Column) -> Column:
    return F.nullif(part(with_scheme(url), 6), F.lit(""))


def segments(path: Column) -> Column:
    """Path segments; empty ones are dropped, dots are not touched."""
    return F.filter(F.split(path, "/"), lambda x: x != "")


def _decoded(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), F.replace(text, F.lit("+"), F.lit(" ")))


def _encoded(text: Column) -> Column:
    """Form encoding; the tilde stays, the star does not."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def query_pairs(query: Column) -> Column:
    """array<struct<k,v>> of a query, decoded; of a key that repeats, the first value alone."""
    pairs = F.transform(
        F.filter(F.split(query, "&"), lambda x: x != ""),
        lambda x: F.struct(_decoded(F.regexp_extract(x, "(?s)^([^=]*)", 1)).alias("k"), _decoded(F.regexp_extract(x, "(?s)^[^=]*=(.*)$", 1)).alias("v")),
    )

    def first(pairs: Column) -> Column:
        return let(F.transform(pairs, lambda y: y["k"]), lambda keys: F.filter(pairs, lambda x, i: F.array_position(keys, x["k"]) == i + 1))

    return let(pairs, first)


def sorted_query(query: Column, without: frozenset[str] | set[str] = frozenset()) -> Column:
    """A query with its pairs sorted and encoded anew, less the keys (in lower case) ``without``."""
    pairs = query_pairs(query)
    if without:
        pairs = F.filter(pairs, lambda x: ~F.lower(x["k"]).isin(*sorted(without)))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: F.concat(_encoded(x["k"]), F.lit("="), _encoded(x["v"]))), "&")


def _asked(base: Column, query: Column) -> Column:
    return let(query, lambda q: F.when(q == "", base).otherwise(F.concat(base, F.lit("?"), q)))


def parsed_key(url: Column) -> Column:
    """The key of the first deduplication: scheme, host, path and sorted query, no fragment."""
    return let(parts(with_scheme(url)), lambda p: _asked(F.concat(_scheme(p), F.lit("://"), _host(p), _path(p)), F.when(p[4] == "", "").otherwise(sorted_query(p[4]))))


def normal_path(path: Column, keep_two_slashes: bool = False) -> Column:
    """A path without empty, ``.`` and ``..`` segments and without a slash at its end.

    As in POSIX, exactly two slashes at the beginning can be kept. A relative path keeps
    the ``..`` that lead out of it, and is ``.`` if nothing is left.
    """
    rooted = path.startswith("/")

    def step(done: Column, x: Column) -> Column:
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        stuck = ~rooted & ((F.size(done) == 0) | (F.get(done, F.size(done) - 1) == ".."))
        return F.when((x != "..") | stuck, F.concat(done, F.array(x))).otherwise(up)

    kept = F.array_join(F.aggregate(F.filter(F.split(path, "/"), lambda x: ~x.isin("", ".")), F.expr(_EMPTY), step), "/")
    lead = F.when(path.rlike("^//(?!/)"), "//").otherwise("/") if keep_two_slashes else F.lit("/")
    return F.when(rooted, F.concat(lead, kept)).when(kept == "", ".").otherwise(kept)


def canonical(url: Column) -> Column:
    """The canonical form: lower scheme and host, no default port, fragment, path parameters
    or tracking parameters, sorted query, resolved dots, no slash at the end but the root's."""

    def whole(p: Column) -> Column:
        scheme = F.lower(p[0])
        path = let(_path(p), lambda x: let(normal_path(x), lambda y: F.when(y == ".", "/").otherwise(y)))
        base = F.concat(scheme, F.lit("://"), _without_default_port(F.lower(p[2]), scheme), path)
        return _asked(base, F.when(p[4] == "", "").otherwise(sorted_query(p[4], TRACKING_PARAMS)))

    return F.when(url == "", "").otherwise(let(parts(with_scheme(url)), whole))


def frontier_key(url: Column) -> Column:
    """The key of the crawl's visited set: the query stays as it is, an empty path stays empty."""

    def whole(p: Column) -> Column:
        path = let(_without_params(p[3]), lambda x: F.when(x == "", "").otherwise(normal_path(x, keep_two_slashes=True)))
        return _asked(F.concat(F.lower(p[0]), F.lit("://"), F.lower(p[2]), path), p[4])

    return let(parts(url), whole)


def is_asset(url: Column, extensions: tuple[str, ...] = ASSET_EXTENSIONS) -> Column:
    """Whether what follows the last slash of the whole URL ends in an asset's extension."""
    last = F.regexp_extract(F.regexp_extract(url, "(?s)^([^?#]*?)/*(?:[?#].*)?$", 1), "([^/]*)$", 1)
    return F.lower(F.regexp_extract(last, r"(\.[^.]*)$", 1)).isin(*extensions)


def should_skip(url: Column) -> Column:
    """Whether a link is no page: other schemes, listed extensions, feeds, machine interfaces."""

    def skipped(path: Column) -> Column:
        bare = F.regexp_replace(path, "/+$", "")
        extension = F.regexp_extract(F.regexp_extract(bare, "([^/]*)$", 1), r"(\.[^.]*)$", 1)
        return extension.isin(*SKIP_EXTENSIONS) | bare.isin("/feed", "/rss") | path.contains("/feed/") | path.contains("/rss/") | path.contains("/wp-json/")

    return let(parts(url), lambda p: ~F.lower(p[0]).isin("http", "https") | let(F.lower(_without_params(p[3])), skipped))


def bare_host(url: Column) -> Column:
    """Host in lower case without port and without www."""
    return F.regexp_replace(F.regexp_replace(F.lower(part(url, 3)), ":[^:]*$", ""), r"^www\.", "")


def is_internal(url: Column, root: str | Column) -> Column:
    """Whether a URL's host is the root domain or lies below it."""
    root = F.lit(root) if isinstance(root, str) else root
    root = F.regexp_replace(F.lower(root), r"^www\.", "")
    return let(bare_host(url), lambda host: (host == root) | host.endswith(F.concat(F.lit("."), root)))


def should_crawl_reason(url: Column, depth: Column, n_internal: Column, root: str, max_depth: int = 3, max_internal: int = 10_000) -> Column:
    """Why a URL is fetched or not. Here a port counts as part of the host."""
    host = F.regexp_replace(F.lower(part(url, 3)), r"^www\.", "")
    inside = (host == root) | host.endswith(f".{root}")
    return F.when(~inside, "external_not_crawled").when(depth > max_depth, "max_depth").when(n_internal >= max_internal, "max_internal_urls").otherwise("ok")


def link_is_navigation(href: Column) -> Column:
    """Whether a trimmed href leads to a page at all."""
    out = href != ""
    for prefix in SKIP_PREFIXES:
        out = out & ~href.startswith(prefix)
    return out


def resolve(base: Column, href: Column) -> Column:
    """A reference resolved against the page it stands on, after RFC 3986, section 5.

    Runs of one segment that repeats become one segment.
    """

    def step(done: Column, x: Column) -> Column:
        return F.when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(x == ".", done).otherwise(F.concat(done, F.array(x)))

    def walked(own: Column) -> Column:
        """A path's segments without dots; an empty path is the root."""
        end = F.when(F.get(own, F.size(own) - 1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.expr(_EMPTY))
        return let(F.array_join(F.concat(F.aggregate(own, F.expr(_EMPTY), step), end), "/"), lambda x: F.when(x == "", "/").otherwise(x))

    def joined(b: Column, h: Column) -> Column:
        """The reference's path, or the base's without its last segment and then the reference's."""
        below = lambda up: let(F.concat(F.slice(up, F.lit(1), F.greatest(F.size(up) - 1, F.lit(0))), F.split(h[3], "/")), lambda own: F.filter(own, lambda x, i: (x != "") | (i == 0) | (i == F.size(own) - 1)))
        return F.when(h[3].startswith("/"), F.split(h[3], "/")).otherwise(let(F.split(b[3], "/"), below))

    def made(b: Column, h: Column) -> Column:
        has_host = h[1] != ""
        same_page = (h[3] == "") & ~has_host
        path = F.when(has_host, h[3]).when(same_page, b[3]).otherwise(let(joined(b, h), walked))
        rooted = let(path, lambda x: F.when((x == "") | x.startswith("/"), x).otherwise(F.concat(F.lit("/"), x)))
        query = F.when(same_page & (h[4] == ""), b[4]).otherwise(h[4])
        tail = F.when(h[5] == "", "").otherwise(F.concat(F.lit("#"), h[5]))
        start = F.concat(F.lower(b[0]), F.lit("://"), F.when(has_host, h[2]).otherwise(b[2]), F.regexp_replace(rooted, r"(/[^/]+)\1+(?=/|$)", "$1"))
        foreign = (h[0] != "") & (F.lower(h[0]) != F.lower(b[0]))
        return F.when(foreign, href).otherwise(F.concat(_asked(start, query), tail))

    return F.when(href == "", base).otherwise(let(parts(base), lambda b: let(parts(href), lambda h: made(b, h))))


_VERSION = r"(?i)^(?:stable|dev|latest|master|main|v?[0-9]+(?:\.[0-9]+)*)$"


def version_of(path: Column) -> Column:
    """struct<version, version_free_path>: a version that leads the path, after a language.

    The language goes only where a version follows it; without one the path stays as it is.
    """
    own = segments(path)
    first = F.get(own, F.lit(0))
    skip = F.when(F.lower(first).isin(*LANGUAGES) & (F.size(own) > 1), 1).otherwise(0)
    found = F.get(own, skip)
    is_version = F.coalesce(found.rlike(_VERSION), F.lit(False))
    rest = F.concat(F.lit("/"), F.array_join(F.slice(own, skip + 2, F.greatest(F.size(own), F.lit(1))), "/"))
    return F.struct(F.when(is_version, found).alias("version"), F.when(is_version, rest).otherwise(path).alias("version_free_path"))
