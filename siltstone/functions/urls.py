"""URL canonicalisation as column expressions. The variants differ on purpose; none stands for another."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Public suffixes of two labels, and parameters that only track.
TWO_LABEL_SUFFIXES = ["edu.cn", "ac.cn", "gov.cn", "org.cn", "com.cn", "net.cn", "edu.hk", "edu.tw", "edu.mo", "com.hk", "com.tw"]
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "ref", "from"]

_PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def part(url: Column, i: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query of an absolute URL; empty where there is none."""
    return F.coalesce(F.regexp_extract(F.trim(url), _PARTS, i), F.lit(""))


def host(url: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(part(url, 2), "^.*@", ""), r":\d*$", ""))


def has_port(url: Column) -> Column:
    return F.regexp_replace(part(url, 2), "^.*@", "").rlike(r"(?:^|[^:\]]|\])[:]\d*$")


def _web(url: Column) -> Column:
    return F.lower(part(url, 1)).isin("http", "https") & (host(url) != "")


def _with_query(base: Column, query: Column) -> Column:
    return F.when(query != "", F.concat(base, F.lit("?"), query)).otherwise(base)


def crawl_identity(url: Column) -> Column:
    """Absolute URL as the crawler names it: host in lower case, no port, no fragment, no slash at the end; query as it is."""
    path = part(url, 3)
    path = F.when(F.length(path) > 1, F.regexp_replace(path, "/+$", "")).otherwise(path)
    return F.when(_web(url) & ~has_port(url), _with_query(F.concat(F.lower(part(url, 1)), F.lit("://"), host(url), path), part(url, 4)))


def catalog_url(url: Column) -> Column:
    """Catalogue form: default ports dropped, path never empty, query pairs decoded, encoded again and sorted, no fragment."""
    scheme = F.lower(part(url, 1))
    port = F.regexp_extract(F.regexp_replace(part(url, 2), "^.*@", ""), r":(\d+)$", 1)
    kept = F.when((port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")), F.lit("")).otherwise(F.concat(F.lit(":"), port))
    path = F.when(part(url, 3) == "", F.lit("/")).otherwise(part(url, 3))
    path = F.when(F.length(path) > 1, F.coalesce(F.nullif(F.regexp_replace(path, "/+$", ""), F.lit("")), F.lit("/"))).otherwise(path)
    pairs = F.array_sort(F.transform(F.filter(F.split(part(url, 4), "&"), lambda x: x != ""), _rewritten))
    return F.when(_web(url), _with_query(F.concat(scheme, F.lit("://"), host(url), kept, path), F.array_join(pairs, "&")))


def _decoded(text: Column) -> Column:
    """Percent signs and plus read; what isn't well encoded stays."""
    return F.coalesce(F.try_url_decode(text), text)


def _rewritten(pair: Column) -> Column:
    """name=value with both encoded anew: the unreserved signs bare, a space as plus, a bare name with an equals sign."""
    encoded = lambda c: F.replace(F.replace(F.url_encode(_decoded(c)), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))
    value = F.when(F.contains(pair, F.lit("=")), F.regexp_replace(pair, "^[^=]*=", "")).otherwise("")
    return F.concat(encoded(F.substring_index(pair, "=", 1)), F.lit("="), encoded(value))


def fact_url(url: Column) -> Column:
    """Provenance form: tracking parameters and fragment dropped, order of the others kept, each decoded and encoded again."""
    pairs = F.transform(F.filter(F.split(part(url, 4), "&"), lambda x: (x != "") & ~F.lower(_decoded(F.substring_index(x, "=", 1))).isin(TRACKING)), _rewritten)
    base = F.concat(F.lower(part(url, 1)), F.lit("://"), F.lower(part(url, 2)), part(url, 3))
    return F.when(F.trim(url) != "", _with_query(base, F.array_join(pairs, "&")))


def registrable_domain(name: Column) -> Column:
    """Last two labels of a host, or three under a public suffix of two."""
    labels = F.split(name, "\\.")
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")
    return F.when(F.size(labels) <= 2, name).when(last(2).isin(TWO_LABEL_SUFFIXES), last(3)).otherwise(last(2))


def same_site(a: Column, b: Column, loose: bool = False) -> Column:
    x, y = host(a), host(b)
    equal = registrable_domain(x) == registrable_domain(y) if loose else x == y
    return ~has_port(a) & ~has_port(b) & (x != "") & (y != "") & equal


def without_scheme(url: Column) -> Column:
    return F.regexp_replace(url, "^https?://", "")


def page_index(url: Column) -> Column:
    """Number of a page in a list: /list3.htm, index_3.html, ?page=3; null if there is none."""
    found = F.regexp_extract(url, r"(?:[?&](?:page|p|pageindex|pn)=|(?:list|index|page)[_/\-]?)(\d{1,5})(?:\D|$)", 1)
    return F.when(found != "", found.cast("int"))


def facets(url: Column) -> Column:
    """Query parameters as a map, the last of equal names."""
    pairs = F.transform(F.filter(F.split(part(url, 4), "&"), lambda x: x != ""), lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.when(F.contains(x, F.lit("=")), F.substring(x, 1, 1 << 20)).otherwise(F.concat(x, F.lit("="))).alias("v")))
    value = lambda v: F.regexp_replace(v, "^[^=]*=", "")
    names = F.array_distinct(F.transform(pairs, lambda x: x["k"]))
    last = F.transform(names, lambda n: value(F.element_at(F.filter(pairs, lambda x: x["k"] == n), -1)["v"]))
    return F.map_from_arrays(names, last)


def changed_facets(a: Column, b: Column) -> Column:
    """Parameters that differ between two URLs: name -> (before, after)."""
    both = F.map_zip_with(facets(a), facets(b), lambda k, x, y: F.struct(x.alias("before"), y.alias("after")))
    return F.map_filter(both, lambda k, v: ~v["before"].eqNullSafe(v["after"]))


def external_identity(url: Column) -> Column:
    """orcid:… or google_scholar:… of a profile link, else null."""
    orcid = F.upper(F.regexp_extract(part(url, 3), r"^/*([^/]{4}-[^/]{4}-[^/]{4}-[^/]{4})/*$", 1))
    scholar = F.try_element_at(facets(url), F.lit("user"))
    return F.when(host(url).isin("orcid.org", "www.orcid.org") & (orcid != ""), F.concat(F.lit("orcid:"), orcid)).when(host(url).endswith("scholar.google.com") & (F.coalesce(scholar, F.lit("")) != ""), F.concat(F.lit("google_scholar:"), scholar))


def allowed_host(url: Column, suffixes: list[str]) -> Column:
    """Whether a web URL's host is one of the suffixes or below one, at a dot; other schemes pass."""
    name = host(url)
    under = F.lit(False)
    for s in suffixes:
        under = under | (name == s) | name.endswith(f".{s}")
    return ~F.lower(part(url, 1)).isin("http", "https") | under
