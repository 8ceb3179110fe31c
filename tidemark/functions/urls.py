"""URL functions as Column expressions. All parts come from the RFC 3986 grammar by regular expressions, so the
same rules run in any SQL engine; a null URL gives nulls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameters that only track where a visit came from.
TRACKING = [
    "utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term",
    "gclid", "fbclid", "msclkid", "mc_cid", "mc_eid", "_ga", "_gid", "_gac", "fbadid",
    "ref", "referrer", "source", "campaign_id", "ad_id", "adgroup_id",
]
# Session parameters that the live normaliser removes.
SESSION = ["jsessionid", "phpsessid", "asp.net_sessionid", "sid"]

_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def host(url: Column) -> Column:
    """With its port, as written."""
    return F.regexp_extract(url, _AUTHORITY + r"([^/?#]*)", 1)


def hostname(url: Column) -> Column:
    return F.lower(F.regexp_replace(host(url), r":\d+$", ""))


def port(url: Column) -> Column:
    return F.regexp_extract(host(url), r":(\d+)$", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, _AUTHORITY + r"[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def fragment(url: Column) -> Column:
    return F.regexp_extract(url, r"#(.*)$", 1)


def pairs(url: Column) -> Column:
    """The query's non-empty pieces, in order, as written."""
    return F.filter(F.split(query(url), "&"), lambda p: p != "")


def keys(url: Column) -> Column:
    return F.transform(pairs(url), lambda p: F.split_part(p, F.lit("="), F.lit(1)))


def sorted_keys(url: Column) -> Column:
    return F.array_sort(F.array_distinct(keys(url)))


def params(url: Column) -> Column:
    """array<struct<k, v>> in order, repeated names kept, values percent-decoded where that is possible."""
    def decode(x: Column) -> Column:
        return F.coalesce(F.try_url_decode(x), x)

    return F.transform(pairs(url), lambda p: F.struct(
        decode(F.split_part(p, F.lit("="), F.lit(1))).alias("k"),
        decode(F.regexp_replace(p, r"^[^=]*=?", "")).alias("v"),
    ))


def base(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), host(url), path(url))


def with_query(front: Column, names: Column, end: str, between: str) -> Column:
    return F.when(F.size(names) > 0, F.concat(front, F.lit("?"), F.array_join(names, between), F.lit(end))).otherwise(front)


def param_pattern(url: Column) -> Column:
    """``s://h/p?a=&b=``: names sorted, values and fragment dropped."""
    return with_query(base(url), sorted_keys(url), "=", "=&")


def method_pattern(url: Column, method: str = "GET") -> Column:
    """METHOD and the parameter pattern, the fragment kept."""
    frag = fragment(url)
    return F.concat(F.lit(f"{method}:"), param_pattern(url), F.when(frag != "", F.concat(F.lit("#"), frag)).otherwise(""))


def limiter_pattern(url: Column) -> Column:
    return with_query(base(url), sorted_keys(url), "=", "&")


def name_pattern(url: Column) -> Column:
    return with_query(base(url), sorted_keys(url), "", "&")


def exact_key(url: Column) -> Column:
    """MD5 of the URL with its query sorted, values included, and no fragment."""
    own = F.array_sort(pairs(url))
    return F.md5(with_query(base(url), own, "", "&"))


def canonical(url: Column) -> Column:
    """Lower-case scheme and host, no default port, no tracking parameters, sorted query, no fragment, no trailing slash."""
    h = F.regexp_replace(F.regexp_replace(F.lower(host(url)), r":80$", ""), r":443$", "")
    clean = F.regexp_replace(F.regexp_replace(path(url), r"/+", "/"), r"/$", "")
    kept = F.array_sort(F.filter(pairs(url), lambda p: ~F.split_part(p, F.lit("="), F.lit(1)).isin(TRACKING)))
    return with_query(F.concat(scheme(url), F.lit("://"), h, clean), kept, "", "&")


def clean_path(p: Column) -> Column:
    """``.`` and empty segments dropped, ``..`` with the segment before it; empty stays empty."""
    steps = F.aggregate(F.split(p, "/"), F.array().cast("array<string>"), lambda done, s: (
        F.when(s.isin("", "."), done).when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, s))
    ))
    return F.when(p == "", p).otherwise(F.concat(F.lit("/"), F.array_join(steps, "/")))


def canonical_form(url: Column) -> Column:
    """Scheme (``http`` if there is none), host in lower case and ASCII without user and default port, the decoded
    and cleaned path (``/`` if empty), and the parameters but for tracking ones, sorted by name and value and
    encoded anew. The fragment is dropped."""
    own = F.when(scheme(url) == "", "http").otherwise(scheme(url))
    where = F.regexp_replace(host(url), "^[^@]*@", "")
    number = F.regexp_extract(where, r":(\d*)$", 1)
    name = F.regexp_replace(where, r":\d*$", "")
    name = F.lower(F.when(name.rlike(r"[^\x00-\x7F]"), F.call_function("java_method", F.lit("java.net.IDN"), F.lit("toASCII"), name)).otherwise(name))
    usual = (number == "") | ((own == "http") & (number == "80")) | ((own == "https") & (number == "443"))

    def decoded(x: Column) -> Column:  # a plus sign in a path is one
        return F.coalesce(F.try_url_decode(F.regexp_replace(x, r"\+", "%2B")), x)

    way = clean_path(decoded(path(url)))
    way = F.when(way == "", "/").otherwise(decoded(way))

    def encoded(x: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(F.url_encode(x), r"\*", "%2A"), "%7E", "~")

    kept = F.array_sort(F.filter(params(url), lambda p: ~F.lower(p["k"]).isin(TRACKING)))
    asked = F.array_join(F.transform(kept, lambda p: F.concat(encoded(p["k"]), F.lit("="), encoded(p["v"]))), "&")
    front = F.concat(own, F.lit("://"), name, F.when(usual, "").otherwise(F.concat(F.lit(":"), number)), way)
    return F.when(asked == "", front).otherwise(F.concat(front, F.lit("?"), asked))


def without_session(url: Column) -> Column:
    kept = F.array_sort(F.filter(pairs(url), lambda p: ~F.split_part(p, F.lit("="), F.lit(1)).isin(SESSION)))
    return with_query(base(url), kept, "", "&")


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def structure_segment(s: Column) -> Column:
    low = F.lower(s)
    return (
        F.when(s.rlike(r"^\d+$"), "{num}")
        .when(low.rlike(r"^[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}$"), "{uuid}")
        .when(low.rlike(r"^[a-f0-9]{16,}$"), "{hash}")
        .when(s.rlike(r"^.+?[-_]\d+(\.\w+)?$"), F.regexp_replace(s, r"^(.+?)([-_])(\d+)(\.\w+)?$", "$1$2{num}$4"))
        .when(s.rlike(r"^[a-zA-Z]+\d+$"), F.regexp_replace(s, r"\d+$", "{num}"))
        .when(s.rlike(r"^\d+[a-zA-Z]+$"), F.regexp_replace(s, r"^\d+", "{num}"))
        .otherwise(s)
    )


def structure(url: Column) -> Column:
    """The URL with its variable path segments generalised and its query reduced to sorted names."""
    p = path(url)
    body = F.concat(F.lit("/"), F.array_join(F.transform(segments(url), structure_segment), "/"))
    body = F.when((p == "") | (p == "/"), p).when(p.endswith("/"), F.concat(body, F.lit("/"))).otherwise(body)
    return with_query(F.concat(scheme(url), F.lit("://"), host(url), body), sorted_keys(url), "=", "=&")


def similar_path(url: Column) -> Column:
    """The path with digit runs as ``{num}``; after ``-`` or ``_`` and as a whole segment before another, ``{id}``."""
    x = F.regexp_replace(path(url), r"\d+", "{num}")
    x = F.regexp_replace(F.regexp_replace(x, r"-\{num\}", "-{id}"), r"_\{num\}", "_{id}")
    return F.regexp_replace(x, r"/\{num\}/", "/{id}/")


def similar_structure(url: Column) -> Column:
    """struct(structure, hash, type): scheme, host, similar path and the sorted parameter names; MD5 of it; ``path`` if the
    path has variable parts, else ``param`` if there are parameters, else ``normal``."""
    p, names = similar_path(url), sorted_keys(url)
    whole = with_query(F.concat(scheme(url), F.lit("://"), host(url), p), names, "=", "=&")
    kind = F.when(p.rlike(r"\{(num|id)\}"), "path").when(F.size(names) > 0, "param").otherwise("normal")
    return F.struct(whole.alias("structure"), F.md5(whole).alias("hash"), kind.alias("type"))


def similar_pattern(url: Column) -> Column:
    return similar_structure(url)["structure"]


def joined_values(url: Column) -> Column:
    """The first value of each name, by sorted names, joined by ``|``; empty without parameters."""
    own = params(url)
    first = F.transform(sorted_keys(url), lambda n: F.get(F.filter(own, lambda p: p["k"] == n), F.lit(0))["v"])
    return F.array_join(F.transform(first, lambda v: F.coalesce(v, F.lit(""))), "|")


def both_schemes(url: Column) -> Column:
    rest = F.regexp_replace(url, r"^[A-Za-z]+://", "")
    return F.when(scheme(url).isin("http", "https"), F.array(F.concat(F.lit("http://"), rest), F.concat(F.lit("https://"), rest))).otherwise(F.array(url))


def resolve(base_url: Column, link: Column) -> Column:
    """array<string>: what a link means on a page; ``//host`` means either scheme, the page's own first."""
    own = scheme(base_url)
    other = F.when(own == "https", "http").otherwise("https")
    root = F.concat(own, F.lit("://"), host(base_url))
    folder = F.regexp_replace(path(base_url), r"[^/]*$", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.array(link))
        .when(link.startswith("//"), F.array(F.concat(own, F.lit(":"), link), F.concat(other, F.lit(":"), link)))
        .when(link.startswith("/"), F.array(F.concat(root, link)))
        .when(link.startswith("?"), F.array(F.concat(root, path(base_url), link)))
        .when(link.startswith("#") | (link == ""), F.array().cast("array<string>"))
        .otherwise(F.array(F.concat(root, folder, link)))
    )


def main_domain(url: Column) -> Column:
    return F.substring_index(hostname(url), ".", -2)


def base_domain(url: Column) -> Column:
    """The main domain, with one label more under second-level country suffixes."""
    h = hostname(url)
    return F.when(h.rlike(r"\.(com|net|org|gov|edu|co|ac|ne|or)\.(cn|jp)$"), F.substring_index(h, ".", -3)).otherwise(F.substring_index(h, ".", -2))


def is_ipv4(h: Column) -> Column:
    return h.rlike(r"^((25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(25[0-5]|2[0-4]\d|1?\d?\d)$")


def is_private_ipv4(h: Column) -> Column:
    return is_ipv4(h) & h.rlike(r"^(10\.|127\.|0\.|169\.254\.|192\.168\.|172\.(1[6-9]|2\d|3[01])\.)")


def in_domain(h: Column, domain: str) -> Column:
    return (h == domain) | h.endswith("." + domain)


def extension(url: Column) -> Column:
    return F.lower(F.regexp_extract(path(url), r"\.([A-Za-z0-9]+)$", 1))
