"""Addresses, parameters and requests in scripts, by patterns over their text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.validity import any_of, extracted

# Patterns and the group that has the find.
APIS = [
    r"""['"](/api/[^'"]*)['"]""", r"""['"](/v\d+/[^'"]*)['"]""", r"""['"](/AJAX/[^'"]*)['"]""", r"""['"](/hpp/[^'"]*)['"]""",
    r"""(https?://[^\s'"]*/api/[^\s'"]*)""", r"""(https?://[^\s'"]*/v\d+/[^\s'"]*)""", r"""(https?://[^\s'"]*/AJAX/[^\s'"]*)""",
    r"""(https?://[^\s'"]*/hpp/[^\s'"]*)""", r"""['"](api/[^\s'"]*)['"]""", r"""['"](AJAX/[^\s'"]*)['"]""", r"""['"](hpp/[^\s'"]*)['"]""",
]
PARAMS = [
    r"""['"]([^'"]*)['"]\s*:\s*['"][^'"]*['"]""", r"""var\s+(\w+)\s*=\s*['"][^'"]*['"]""", r"""let\s+(\w+)\s*=\s*['"][^'"]*['"]""",
    r"""const\s+(\w+)\s*=\s*['"][^'"]*['"]""",
]
LINKS = [r"""(https?://[^\s'"]*)""", r"""['"](/[^'"]*\.[^'"]*)['"]""", r"""['"](/[^'"]*)['"]"""]
COMMON = """function var let const if else for while return break continue true false null undefined this new typeof instanceof""".split()
PLACE = r"""['"](/[^'"\s?#]+)"""
PATHS = [
    r"fetch\s*\(\s*" + PLACE, r"axios\.(?:get|post|put|delete|patch)\s*\(\s*" + PLACE, r"\$\.ajax\s*\(\s*\{[^}]*url\s*:\s*" + PLACE,
    r"\$\.(?:get|post)\s*\(\s*" + PLACE, r"window\.location\s*=\s*" + PLACE, r"window\.location\.href\s*=\s*" + PLACE,
    r"location\.href\s*=\s*" + PLACE, r"href\s*:\s*" + PLACE, r"router\.(?:push|replace)\s*\(\s*" + PLACE, r"navigate\s*\(\s*" + PLACE,
    r"redirect\s*\(\s*" + PLACE, r"path\s*:\s*" + PLACE, r"""['"](/api/[^'"\s?#]+)['"]""", r"""['"](/v\d+/[^'"\s?#]+)['"]""",
    r"""['"](/admin/[^'"\s?#]+)['"]""", r"""['"](/user/[^'"\s?#]+)['"]""", r"""['"](/login[^'"\s?#]*)['"]""",
    r"""['"](/logout[^'"\s?#]*)['"]""", r"""['"](/register[^'"\s?#]*)['"]""", r"src\s*:\s*" + PLACE, r"url\s*:\s*" + PLACE,
    r"endpoint\s*:\s*" + PLACE, r"baseURL\s*:\s*" + PLACE, r"""['"](/[a-zA-Z0-9_\-/]{3,})['"]""",
]
FILES = (
    ".jpg .jpeg .png .gif .svg .ico .webp .bmp .css .less .sass .scss .woff .woff2 .ttf .eot .otf .mp4 .mp3 .avi .mov .wmv .pdf .doc"
    " .docx .xls .xlsx .zip .rar .tar .gz"
).split()
TEXT = r"""['"]([^'"]+)['"]"""
POSTS = [
    ("jquery-ajax-post", r"""\$\.ajax\s*\(\s*\{\s*[^}]*type\s*:\s*['"]POST['"][^}]*url\s*:\s*""" + TEXT),
    ("jquery-ajax-post-alt", r"\$\.ajax\s*\(\s*\{\s*[^}]*url\s*:\s*" + TEXT + r"""[^}]*type\s*:\s*['"]POST['"]"""),
    ("jquery-post", r"\$\.post\s*\(\s*" + TEXT),
    ("axios-post", r"axios\.post\s*\(\s*" + TEXT),
    ("axios-method", r"""axios\s*\(\s*\{\s*[^}]*method\s*:\s*['"]POST['"][^}]*url\s*:\s*""" + TEXT),
    ("axios-method-alt", r"axios\s*\(\s*\{\s*[^}]*url\s*:\s*" + TEXT + r"""[^}]*method\s*:\s*['"]POST['"]"""),
    ("fetch-post", r"fetch\s*\(\s*" + TEXT + r"""[^)]*method\s*:\s*['"]POST['"]"""),
    ("fetch-post-alt", r"fetch\s*\(\s*" + TEXT + r"""[^)]*\{\s*[^}]*method\s*:\s*['"]POST['"]"""),
    ("xhr-post", r"""(?:xhr|xmlhttp)\.open\s*\(\s*['"]POST['"],\s*""" + TEXT),
    ("form-action-post", r"""<form[^>]*method\s*=\s*['"]POST['"][^>]*action\s*=\s*""" + TEXT),
    ("form-action-post-alt", r"<form[^>]*action\s*=\s*" + TEXT + r"""[^>]*method\s*=\s*['"]POST['"]"""),
    ("form-submit", r"form\.action\s*=\s*" + TEXT + r"""[^;]*form\.method\s*=\s*['"]POST['"]"""),
    ("request-post", r"request\.post\s*\(\s*" + TEXT),
    ("http-post-method", r"(?:post|POST)\s*\(\s*" + TEXT),
]
SPECIAL = ["mailto", "tel", "ftp", "ws", "wss", "data"]


def _all(text: Column, patterns: list[str]) -> Column:
    """What the patterns find, pattern by pattern, each find once, where it came first."""
    return F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns])))


def apis(text: Column) -> Column:
    return F.transform(_all(text, APIS), lambda x: F.regexp_replace(x, r"""^['"]+|['"]+$""", ""))


def parameters(text: Column) -> Column:
    return F.filter(_all(text, PARAMS), lambda x: ~F.lower(x).isin(COMMON))


def links(text: Column) -> Column:
    """Of at least three bytes, without blanks, brackets or marks of code."""
    return F.filter(_all(text, LINKS), lambda x: (F.octet_length(x) >= 3) & ~x.rlike(r"[ \t\n:;{}()\[\]]"))


def paths(text: Column) -> Column:
    """Local paths that scripts ask for, go to or name, without query, static files and templates."""
    return F.filter(_all(text, PATHS), local_path)


def posts(text: Column, base: Column) -> Column:
    """array<struct(source, address)>: what is posted to, each address once, under the first pattern that finds it."""
    origin = F.regexp_extract(base, r"^([^:]+://[^/]*)", 1)

    def whole(x: Column) -> Column:
        return F.when(x.startswith("http"), x).when(x.startswith("/"), F.concat(origin, x)).otherwise(F.concat(F.regexp_replace(base, "/$", ""), F.lit("/"), x))

    def found(name: str, pattern: str) -> Column:
        hits = F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: ~x.isin("", "/", "#"))
        return F.transform(hits, lambda x: F.struct(F.lit(name).alias("source"), whole(x).alias("address")))

    every = F.flatten(F.array(*[found(*p) for p in POSTS]))
    places = F.transform(every, lambda e: e["address"])
    return F.filter(F.transform(every, lambda e, i: F.when(F.array_position(places, e["address"]) == i + 1, e)), lambda e: e.isNotNull())


def special_links(html: Column) -> Column:
    """array<struct(protocol, link)>: links that no page stands behind (mailto, tel, ftp, ws, data), each once."""
    hrefs = F.array_distinct(F.regexp_extract_all(html, F.lit(r"""(?i)(?:href|src)\s*=\s*["']\s*((?:mailto|tel|ftp|wss?|data):[^"']*)"""), F.lit(1)))
    return F.transform(hrefs, lambda x: F.struct(F.lower(F.split_part(x, F.lit(":"), F.lit(1))).alias("protocol"), x.alias("link")))


# Patterns of addresses in code, configuration objects, requests, routes and coded strings.
WHOLE = r"""(https?://[a-zA-Z0-9\-._~:/?#\[\]@!$&'()*+,;=%]+)"""
CONTEXTS = [
    r"fetch\s*\(\s*" + TEXT, r"\$\.ajax\s*\(\s*\{[^}]*url\s*:\s*" + TEXT, r"\$\.(?:get|post)\s*\(\s*" + TEXT,
    r"axios\.(?:get|post|put|delete|patch)\s*\(\s*" + TEXT, r"""xhr\.open\s*\(\s*['"](?:GET|POST)['"],\s*""" + TEXT,
    r"window\.location\s*=\s*" + TEXT, r"location\.href\s*=\s*" + TEXT, r"window\.open\s*\(\s*" + TEXT, r"navigate\s*\(\s*" + TEXT,
    r"redirect\s*\(\s*" + TEXT, r"apiUrl\s*[:=]\s*" + TEXT, r"baseURL\s*[:=]\s*" + TEXT, r"endpoint\s*[:=]\s*" + TEXT,
]
OBJECTS = [
    r"""config\s*[=:]\s*\{[^}]*["']url["']\s*:\s*["']([^"']+)["']""", r"""settings\s*[=:]\s*\{[^}]*["']endpoint["']\s*:\s*["']([^"']+)["']""",
    r"""API_BASE\s*[=:]\s*["']([^"']+)["']""", r"""BASE_URL\s*[=:]\s*["']([^"']+)["']""", r"""ENDPOINT\s*[=:]\s*["']([^"']+)["']""",
    r"routes\s*[=:]\s*\{([^}]+)\}", r"""path\s*:\s*["']([^"']+)["']""", r"`[^`]*(/[a-zA-Z0-9/_\-]+)[^`]*`", r"""['"](/\$\{[^}]+\}/[^'"]*)['"]""",
]
REQUESTS = [
    r"""xhr\.open\s*\(\s*["'](?:GET|POST)["']\s*,\s*["']([^"']+)["']""", r"""\.send\s*\(\s*["']([^"']+)["']""",
    r"""\$\.ajax\s*\(\s*\{[^}]*url\s*:\s*["']([^"']+)["']""", r"""\$\.getJSON\s*\(\s*["']([^"']+)["']""", r"""fetch\s*\(\s*["']([^"']+)["']""",
    r"""axios\s*\.\s*(?:get|post|put|delete|patch)\s*\(\s*["']([^"']+)["']""", r"""axios\s*\(\s*\{[^}]*url\s*:\s*["']([^"']+)["']""",
]
ROUTES = [
    r"""path\s*:\s*["']([^"']+)["']""", r"""route\s*:\s*["']([^"']+)["']""", r"""<Route\s+path\s*=\s*["']([^"']+)["']""",
    r"routes\s*[=:]\s*\[([\s\S]*?)\]",
]
CODED = r"""atob\s*\(\s*['"]([A-Za-z0-9+/=]{16,})['"]"""
ENDPOINTS = [
    r"""['"]([^'"]*(?:/api/|/API/|/rest/|/graphql/|/v\d+/)[^'"]*)['"]""",
    r"""['"]([^'"]*\.(?:php|asp|aspx|jsp|do|action|cfm|cgi|pl|py)[^'"]*)['"]""",
    r"""\.(?:get|post|put|delete|ajax)\s*\(\s*['"]([^'"]+)['"]""", r"""fetch\s*\(\s*['"]([^'"]+)['"]""",
    r"""\.open\s*\(\s*['"][^'"]*['"]\s*,\s*['"]([^'"]+)['"]""", r"""['"]([^'"]*(?:\?|&)[^'"]*)['"]""",
]
NO_ENDPOINT = [" ", "\t", "\n", "javascript:", "mailto:", "tel:", "#"]
ENDPOINT_PARTS = ["api", ".php", ".asp", "?", "="]
CONTEXT = 200


def local_path(x: Column) -> Column:
    """Whether a find is a path from the root that may be a page or an API: no static file, template or number."""
    return (
        x.startswith("/") & F.octet_length(x).between(2, 200) & ~any_of([F.lower(x).endswith(e) for e in FILES])
        & (F.regexp_count(x, F.lit(r"[{}\[\]<>]")) <= 2) & ~x.rlike(r"^/\d+$")
    )


def code_addresses(code: Column) -> Column:
    """Whole addresses, then those of requests, navigation and settings, as far as they are addresses at all; each once."""
    whole = F.transform(F.regexp_extract_all(code, F.lit(WHOLE), F.lit(1)), lambda x: F.regexp_replace(x, r"""^["'`]+|["'`]+$""", ""))
    return F.filter(F.array_distinct(F.concat(whole, _all(code, CONTEXTS))), extracted)


def object_addresses(text: Column, site: Column) -> Column:
    """Paths in configuration objects, routes and template strings, on the site (scheme and host)."""
    found = F.array_distinct(F.transform(_all(text, OBJECTS), lambda x: F.trim(x)))
    return F.transform(F.filter(found, local_path), lambda x: F.concat(site, x))


def request_addresses(text: Column, site: Column) -> Column:
    """What scripts request: paths on the site, other addresses as they are; finds without a slash are none."""
    found = F.filter(_all(text, REQUESTS), lambda x: F.contains(x, F.lit("/")) | F.contains(x, F.lit("http")))
    return F.transform(found, lambda x: F.when(x.startswith("/"), F.concat(site, x)).otherwise(x))


def route_addresses(text: Column, site: Column) -> Column:
    """Routes of a client-side router on the site, ``:name`` as 1 and without ``*``; a list of routes counts as a whole."""
    paths_ = F.transform(_all(text, ROUTES), lambda x: F.replace(F.regexp_replace(x, r":\w+", "1"), F.lit("*"), F.lit("")))
    return F.transform(F.filter(F.array_distinct(paths_), lambda x: x != ""), lambda x: F.concat(site, F.when(x.startswith("/"), x).otherwise(F.concat(F.lit("/"), x))))


def coded_addresses(text: Column) -> Column:
    """Addresses and paths from base64 strings that scripts decode, with or without padding; what is no base64 is none."""
    def plain(x: Column) -> Column:
        bare_ = F.rtrim(x, F.lit("="))
        return F.try_to_binary(F.rpad(bare_, (F.ceil(F.length(bare_) / 4) * 4).cast("int"), "="), F.lit("base64"))

    texts = F.transform(F.regexp_extract_all(text, F.lit(CODED), F.lit(1)), lambda x: F.try_validate_utf8(plain(x)))
    return F.array_distinct(F.filter(texts, lambda x: x.isNotNull() & (x.rlike(r"^https?://|^//") | (x.startswith("/") & (F.length(x) > 1) & ~F.contains(x, F.lit("\x00"))))))


def endpoints(text: Column) -> Column:
    """Likely endpoints in a script, each once: of 3 to 200 bytes, paths from the root or with a sign of a program."""
    def fine(x: Column) -> Column:
        return F.octet_length(x).between(3, 200) & ~any_of([F.contains(x, F.lit(w)) for w in NO_ENDPOINT]) & (x.startswith("/") | any_of([F.contains(x, F.lit(w)) for w in ENDPOINT_PARTS]))

    return F.filter(_all(text, ENDPOINTS), fine)


def nearby_parameters(text: Column, found: Column) -> Column:
    """array<struct(name, value)>: the members of the ``data`` object within CONTEXT characters of ``found``'s first place."""
    at = F.instr(text, found)
    start = F.greatest(at - CONTEXT, F.lit(1))
    around = F.substring(text, start, F.least(at, F.lit(CONTEXT + 1)) - 1 + F.length(found) + CONTEXT)
    inner = F.when(at > 0, F.regexp_extract(around, r"data\s*:\s*\{([^}]+)\}", 1)).otherwise("")
    pairs = F.regexp_extract_all(inner, F.lit(r"""['"]?\w+['"]?\s*:\s*['"]?[^'",}]+['"]?"""), F.lit(0))
    member = r"""['"]?(\w+)['"]?\s*:\s*['"]?([^'",}]+)['"]?"""
    return F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, member, 1).alias("name"), F.trim(F.regexp_extract(p, member, 2)).alias("value")))
