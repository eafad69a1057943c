"""URL, host, path and slug normalisers as column expressions.

URLs are split with one lenient regex rather than a strict parser, so malformed
paths written by scanners still classify.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# scheme, authority, path
SPLIT = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)"
# origin and path of a URL that is canonical but for a query or fragment
PLAIN = r"\A(https?://[a-z0-9.\-]++(?<=[a-z0-9\-])(?=/)(?![^?#]*//)[^?#\s\x00]*+)(?:[?#][^\x00]*+)?+\z"


def authority(url: Column) -> Column:
    return F.regexp_extract(url, SPLIT, 2)


def host(url: Column) -> Column:
    """Lower-case host without user info, port or trailing dots; '' when there is none."""
    bare = F.regexp_replace(F.regexp_replace(authority(url), r"^.*@", ""), r":\d*$", "")
    return F.lower(F.regexp_replace(bare, r"\.+$", ""))


def host_without_www(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def path(url: Column) -> Column:
    """Path of an absolute URL or of a root-relative route, without query and fragment."""
    absolute = F.regexp_extract(url, SPLIT, 3)
    return F.when(url.rlike(SPLIT), absolute).otherwise(F.regexp_extract(url, r"^([^?#]*)", 1))


def route_path(route: Column) -> Column:
    """Query-free path with single slashes; '' when the input is blank."""
    trimmed = F.trim(F.coalesce(route, F.lit("")))
    collapsed = F.regexp_replace(F.concat(F.lit("/"), path(trimmed)), r"/+", "/")
    return F.when((trimmed == "") | trimmed.contains("\0"), "").otherwise(collapsed)


def canonical_url(url: Column) -> Column:
    """Origin plus path of an http(s) URL, or the path of a root-relative route; else ''.

    Most URLs are canonical up to their query, and one pattern tells them; the others are taken apart.
    """
    plain = F.regexp_extract(F.coalesce(url, F.lit("")), PLAIN, 1)
    trimmed = F.trim(F.coalesce(url, F.lit("")))
    scheme = F.lower(F.regexp_extract(trimmed, SPLIT, 1))
    name = host(trimmed)
    port = F.regexp_extract(authority(trimmed), r"(:\d+)$", 1)
    return (
        F.when(plain != "", plain)
        .when((trimmed == "") | trimmed.contains("\0"), "")
        .when(trimmed.startswith("/") & ~trimmed.startswith("//"), route_path(trimmed))
        .when(~scheme.isin("http", "https") | (name == "") | name.rlike(r"[\s@]"), "")
        .otherwise(F.concat(scheme, F.lit("://"), name, port, _rooted_path(trimmed)))
    )


def _rooted_path(url: Column) -> Column:
    raw = F.regexp_extract(url, SPLIT, 3)
    return F.regexp_replace(F.concat(F.lit("/"), raw), r"/+", "/")


def referrer_host(referrer: Column, own_host: Column) -> Column:
    """Host that sent the reader; NULL for direct, same-host and unreadable referrers."""
    name = host_without_www(F.trim(referrer))
    own = F.regexp_replace(F.lower(F.trim(F.coalesce(own_host, F.lit("")))), r"^www\.", "")
    return F.when((name != "") & (name != own), name)


def normal_hostname(value: Column) -> Column:
    """Host of a URL or of a bare host name: lower case, no port, trailing dot or www."""
    trimmed = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    bare = F.regexp_extract(F.regexp_replace(trimmed, r"^[a-z][a-z0-9+.\-]*://|^//", ""), r"^([^/?#]*)", 1)
    bare = F.regexp_replace(F.regexp_replace(bare, r"^.*@", ""), r":\d*$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"\.+$", ""), r"^www\.", "")


def slugify(text: Column) -> Column:
    kept = F.regexp_replace(F.lower(text), r"[^a-z0-9_\-\s]", "")
    return F.regexp_replace(F.regexp_replace(kept, r"[\s\-]+", "-"), r"^-+|-+$", "")


def slug_of_404(url: Column) -> Column:
    """Post slug a missing URL most likely meant."""
    bare = F.regexp_replace(F.regexp_extract(url, r"^([^?]*)", 1), r"(?i)\.html$", "")
    bare = F.regexp_replace(bare, r"^/\d{4}/\d{2}/", "/")
    return slugify(F.regexp_extract(bare, r"([^/]*)/*$", 1))


def url_hostname(url: Column) -> Column:
    """Normalised host of an absolute URL only; '' for paths and bare names."""
    text = F.coalesce(url, F.lit(""))
    return F.when(F.trim(text).rlike(r"^(?i)(?:https?:)?//"), normal_hostname(text)).otherwise("")


def frontend_path(value: Column) -> Column:
    """Root-relative path with slashes on both ends; NULL for anything else."""
    text = F.trim(F.coalesce(value, F.lit("")))
    bare = F.regexp_replace(path(text), "^/+|/+$", "")
    rooted = F.when(bare == "", "/").otherwise(F.concat(F.lit("/"), bare, F.lit("/")))
    return F.when(text.startswith("/") & ~text.startswith("//"), rooted)


def clean_number(value: Column) -> Column:
    """Number from text with currency signs and separators; 0 when nothing is left."""
    digits = F.regexp_replace(F.coalesce(value, F.lit("")), r"[^0-9.\-]", "")
    return F.coalesce(F.when(digits != "", digits.try_cast("double")), F.lit(0.0))


def slug_key(value: Column) -> Column:
    """Slug without query, fragment and outer slashes."""
    return F.regexp_replace(F.regexp_extract(F.trim(value), r"^([^?#]*)", 1), "^/+|/+$", "")
