"""Column functions on urls and domains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tracking suffixes, removed one after the other, and tracking parameters.
TRACKING_SUFFIXES = ("?utm_source=chatgpt.com", "&utm_source=chatgpt.com", "?utm_source=openai", "&utm_source=openai")
TRACKING_SOURCES = ("chatgpt.com", "openai")
IMAGE_SUFFIX = r"(?i)\.(jpg|jpeg|png|gif|webp|svg|bmp|ico|avif)$"
IMAGE_HOST = r"(?i)^tse[^.]*\.mm\.bing\.net$"


def netloc(url: Column) -> Column:
    """Authority of a url with user and port, as parse_url's host is not."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)


def without_suffixes(url: Column, suffixes=TRACKING_SUFFIXES) -> Column:
    for s in suffixes:
        url = F.when(url.endswith(s), F.substring(url, F.lit(1), F.length(url) - len(s))).otherwise(url)
    return url


def match_key(url: Column) -> Column:
    """Form under which cited and retrieved urls are compared."""
    return F.coalesce(F.regexp_replace(without_suffixes(F.trim(url)), "/+$", ""), F.lit(""))


def fold_domain(domain: Column, wikipedia: bool = True) -> Column:
    """Lower case, no trailing dots, no leading www., wikipedia's language hosts as one."""
    d = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(domain, F.lit("")))), r"\.+$", ""), r"^www\.", "")
    return F.when((d == "wikipedia.org") | d.endswith(".wikipedia.org"), "wikipedia.org").otherwise(d) if wikipedia else d


def domain_of(url: Column, wikipedia: bool = True) -> Column:
    return fold_domain(netloc(url), wikipedia)


def plain_domain(url: Column) -> Column:
    """Authority with every 'www.' removed, case kept."""
    return F.replace(netloc(url), F.lit("www."), F.lit(""))


def _requote(part: Column) -> Column:
    """Decodes and encodes again as a form field: space as plus, ~ bare, * escaped."""
    coded = F.url_encode(F.coalesce(F.try_url_decode(part), part))
    return F.replace(F.replace(coded, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def normalize_url(url: Column) -> Column:
    """One form for a page whether or not it is cited with tracking parameters or a trailing slash; null becomes empty."""
    u = F.trim(F.coalesce(url, F.lit("")))
    pattern = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
    part = lambda i: F.regexp_extract(u, pattern, i)
    pairs = F.transform(F.filter(F.split(part(4), "&"), lambda p: p != ""), lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, "(?s)^[^=]*=", "")).otherwise("").alias("v")))
    kept = F.filter(pairs, lambda p: ~((p["k"] == "utm_source") & p["v"].isin(*TRACKING_SOURCES)))
    query = F.array_join(F.transform(kept, lambda p: F.concat(_requote(p["k"]), F.lit("="), _requote(p["v"]))), "&")
    path = F.regexp_replace(part(3), "/+$", "")
    whole = F.concat(F.lower(part(1)), F.lit("://"), part(2), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""), F.when(part(5) != "", F.concat(F.lit("#"), part(5))).otherwise(""))
    return F.when(u == "", "").when(part(2) == "", F.regexp_replace(u, "/+$", "")).otherwise(whole)


def is_image(url: Column) -> Column:
    path = F.regexp_replace(F.coalesce(url, F.lit("")), r"[?#].*$", "")
    return path.rlike(IMAGE_SUFFIX) | netloc(url).rlike(IMAGE_HOST)


def is_wikipedia(url: Column) -> Column:
    host = F.regexp_replace(F.regexp_replace(F.lower(netloc(url)), r"^.*@", ""), r":\d+$", "")
    return (host == "wikipedia.org") | host.endswith(".wikipedia.org")


def wikipedia_history(url: Column) -> Column:
    """Address of the revision list of a wikipedia article; null for other urls."""
    title = F.regexp_extract(url, r"/wiki/([^?#]+)", 1)
    base = F.regexp_extract(url, r"^([a-zA-Z]+://[^/?#]+)", 1)
    return F.when(is_wikipedia(url) & (title != ""), F.concat(base, F.lit("/w/index.php?title="), title, F.lit("&action=history")))
