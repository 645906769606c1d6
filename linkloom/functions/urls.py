"""URL parts and resolution as Column expressions; no UDF, and no error on hosts that Spark's own URL functions refuse."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ABSOLUTE = r"^[A-Za-z][A-Za-z0-9+.\-]*:"
HIERARCHICAL = r"^[A-Za-z][A-Za-z0-9+.\-]*://"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def scheme(uri: Column | str) -> Column:
    """Lower-case scheme, empty without one."""
    return F.lower(F.regexp_extract(_col(uri), r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def authority(uri: Column | str) -> Column:
    return F.lower(F.regexp_extract(_col(uri), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))


def host(uri: Column | str) -> Column:
    """Lower-case host without user and port; empty where the text isn't an absolute URL."""
    return F.regexp_replace(F.regexp_replace(authority(uri), r"^.*@", ""), r":\d*$", "")


def path(uri: Column | str) -> Column:
    return F.regexp_extract(_col(uri), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def query(uri: Column | str) -> Column:
    """The query with its question mark, or an empty string."""
    return F.regexp_extract(_col(uri), r"^[^?#]*(\?[^#]*)", 1)


def without_query(uri: Column | str) -> Column:
    """The URL with its query cut out; a fragment stays."""
    return F.regexp_replace(_col(uri), r"^([^?#]*)\?[^#]*", "$1")


def is_absolute(uri: Column | str) -> Column:
    """Whether the text is an absolute URL with a host."""
    return F.coalesce(_col(uri).rlike(HIERARCHICAL) & (host(uri) != ""), F.lit(False))


def domain_key(uri: Column | str) -> Column:
    """What decides whether two URLs are in one domain: the host in lower case, with every ``www.`` of the URL removed. Subdomains differ."""
    return host(F.replace(F.lower(_col(uri)), F.lit("www."), F.lit("")))


def file_name(uri: Column | str) -> Column:
    """The decoded last segment of the path: the name under which a download would be kept."""
    return F.try_url_decode(F.replace(F.element_at(F.split(path(uri), "/"), -1), F.lit("+"), F.lit("%2B")))


def encode_non_ascii(text: Column) -> Column:
    """Percent-encode what isn't ASCII, and spaces; everything else stays, escapes included."""
    pieces = F.regexp_extract_all(text, F.lit(r"[\x00-\x7F]+|[^\x00-\x7F]+"), F.lit(0))
    return F.replace(F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(r"^[\x00-\x7F]"), p).otherwise(F.url_encode(p))), ""), F.lit(" "), F.lit("%20"))


def _without_dots(p: Column) -> Column:
    """A path without its ``.`` and ``..`` segments."""
    segments = F.split(p, "/")
    start = F.array().cast("array<string>")

    def step(done, s):
        up = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))
        return F.when(s == ".", done).when(s == "..", F.when(F.size(done) > 0, up).otherwise(done)).otherwise(F.concat(done, F.array(s)))

    kept = F.aggregate(segments, start, step)
    ends = F.element_at(segments, -1).isin(".", "..")
    return F.when(F.concat(p, F.lit("/")).rlike(r"/\.\.?/"), F.concat(F.array_join(kept, "/"), F.when(ends, F.lit("/")).otherwise(F.lit("")))).otherwise(p)


def canonical(uri: Column) -> Column:
    """Scheme and host in lower case, default port off, dot segments gone, an empty path as ``/``, non-ASCII escaped; other kinds of URI as they are."""
    auth = F.when(scheme(uri) == "http", F.regexp_replace(authority(uri), r":80$", "")).when(scheme(uri) == "https", F.regexp_replace(authority(uri), r":443$", "")).otherwise(authority(uri))
    p = path(uri)
    tail = F.regexp_extract(uri, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^?#]*(.*)$", 1)
    whole = F.concat(scheme(uri), F.lit("://"), auth, F.when(p == "", F.lit("/")).otherwise(encode_non_ascii(_without_dots(p))), encode_non_ascii(tail))
    return F.when(uri.rlike(HIERARCHICAL), whole).otherwise(uri)


def resolve_uri(base: Column | str, target: Column | str) -> Column:
    """``target`` as an absolute, canonical URL: backslashes and double quotes are dropped, an absolute URL is kept, all else (also ``/x``) is taken
    relative to ``base``. Null when either is null or the base has no host."""
    given = F.struct(_col(base).alias("base"), F.trim(F.translate(_col(target), '\\"', "")).alias("target"))
    return _once(given, lambda g: _resolved(g["base"], g["target"]))


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _resolved(base: Column, target: Column) -> Column:
    origin = F.concat(scheme(base), F.lit("://"), authority(base))
    directory = F.regexp_replace(F.when(path(base) == "", F.lit("/")).otherwise(path(base)), r"[^/]*$", "")
    resolved = (
        F.when(target.rlike(ABSOLUTE), target)
        .when(target.startswith("//"), F.concat(scheme(base), F.lit(":"), target))
        .when(target.startswith("/"), F.concat(origin, target))
        .when(target == "", F.concat(origin, path(base), query(base)))
        .when(target.startswith("?"), F.concat(origin, path(base), target))
        .when(target.startswith("#"), F.concat(origin, path(base), query(base), target))
        .otherwise(F.concat(origin, directory, target))
    )
    return F.when(target.rlike(HIERARCHICAL) | (is_absolute(base) & target.isNotNull()), _once(resolved, canonical))
