"""Addresses as column expressions.

clean_url is our own contract: trimmed, scheme and host in lower case, fragment and tracking parameters gone, null unless
there is an http(s) host.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHOLE = r"^\s*([hH][tT][tT][pP][sS]?)://([^/?#\s]+)([^?#\s]*)(?:\?([^#\s]*))?(?:#\S*)?\s*$"
TRACKING = r"^(utm_[a-z]+|fbclid|gclid|mc_cid|mc_eid)(=|$)"
LOCAL = r"(?i)^https?://(localhost|0\.0\.0\.0|youtube.com)"
#: Words that make an address a page about the site, as a whole part of its path.
SECTIONS = "|".join(sorted(("tags", "links", "comic", "about", "archive", "contact", "categories")))
SECTION = rf"(?i)/({SECTIONS})(/|$)"
LISTING = r"(?i)/(?:category|author|tag)/[^/]"
BARE = r"(?i)/(?:category|tag)(/|$)"
VALID_HOST = r"^([a-z0-9]([a-z0-9-]*[a-z0-9])?\.)*[a-z0-9]([a-z0-9-]*[a-z0-9])?(:[0-9]+)?$"


def stripped(url: Column) -> Column:
    """Without scheme, www., query and trailing slashes; case and fragment stay."""
    bare = F.regexp_replace(url, r"^(?:https?://)?(?:www[.])?", "")
    return F.regexp_replace(F.split_part(bare, F.lit("?"), F.lit(1)), "/+$", "")


def clean(url: Column) -> Column:
    """The normal form, or null."""
    part = lambda i: F.regexp_extract(url, WHOLE, i)
    kept = F.array_join(F.filter(F.split(part(4), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)), "&")
    return F.when(url.rlike(WHOLE), F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), part(3), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def base(url: Column) -> Column:
    """Scheme and host in lower case, or null."""
    return F.when(url.rlike(WHOLE), F.concat(F.lower(F.regexp_extract(url, WHOLE, 1)), F.lit("://"), F.lower(F.regexp_extract(url, WHOLE, 2))))


def is_valid(url: Column) -> Column:
    """Whether there is an http(s) address with a well-formed host; false for null."""
    return F.coalesce(url.rlike(WHOLE) & F.lower(F.regexp_extract(url, WHOLE, 2)).rlike(VALID_HOST), F.lit(False))


def domain(url: Column) -> Column:
    """Host without www., with its port; empty where there is none."""
    return F.coalesce(F.regexp_replace(base(url), r"^https?://(?:www[.])?", ""), F.lit(""))


def display_domain(url: Column) -> Column:
    """What result pages show: up to the first slash once every scheme is taken out; www. stays."""
    return F.split_part(F.replace(F.replace(url, F.lit("https://"), F.lit("")), F.lit("http://"), F.lit("")), F.lit("/"), F.lit(1))


def is_post(url: Column) -> Column:
    """Whether an address looks like a post: no local host, no section, author or tag listing."""
    return ~(url.rlike(LOCAL) | url.rlike(SECTION) | url.rlike(LISTING) | url.rlike(BARE))


def without_slash(url: Column) -> Column:
    return F.regexp_replace(url, "/+$", "")
