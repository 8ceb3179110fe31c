"""What an address or a parameter is worth or risks, by lists of words and patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import urls
from tidemark.functions.validity import any_of, contains_any

# Weights of path words and parameters, and patterns of little and of much value.
PATH_WEIGHTS = {
    "/admin": 50, "/manage": 45, "/backend": 45, "/console": 40, "/api": 35, "/upload": 35, "/login": 30, "/register": 30, "/user": 30,
    "/search": 25, "/list": 20, "/category": 20, "/product": 20, "/show": 10, "/display": 10, "/view": 10, "/image": 5, "/img": 5,
    "/pic": 5, "/photo": 5, "/thumb": 5,
}
PARAM_WEIGHTS = {
    "cmd": 30, "exec": 30, "eval": 30, "system": 30, "sql": 25, "query": 20, "action": 20, "upload": 25, "download": 20, "path": 20,
    "dir": 20, "id": 15, "user": 15, "page": 10, "limit": 10, "show": 5, "display": 5, "view": 5,
}
LITTLE = [
    r"(?i)/(show|display|view|get)(image|img|pic|photo|thumb)", r"(?i)/image\.(php|jsp|asp)", r"(?i)\?.*file=.*\.(jpg|jpeg|png|gif|bmp|webp|svg)",
    r"(?i)/proxy\.(php|jsp).*\.(css|js|jpg|png)", r"(?i)/static/", r"(?i)/assets/", r"(?i)/(thumb|thumbnail|resize)", r"(?i)\?(w|h|width|height|size)=\d+",
]
MUCH = [
    r"(?i)/(upload|uploader|file_upload)", r"(?i)/(delete|update|insert|modify)", r"(?i)/(user|account|profile)/(edit|delete|update)",
    r"(?i)/api/v\d+/", r"(?i)\.(json|xml)(\?|$)", r"(?i)/(search|query|find).*\?",
]
ENDINGS = {
    20: [".php", ".jsp", ".asp", ".aspx"], 15: [".do", ".action"], 25: [".json", ".xml"], 10: [".html", ".htm"],
    -20: [".jpg", ".jpeg", ".png", ".gif", ".css", ".js"],
}
IMAGE_PATHS = ["showimage", "displayimage", "getimage", "viewimage", "image.php", "img.php", "picture.php", "photo.php"]
IMAGE_VALUE = r"(?i)(\.(jpg|jpeg|png|gif|bmp|webp)$|/pictures/|/images/|/photos/)"

# The second scorer's words.
TYPE_SCORES = {"admin_panel": 40, "api_endpoint": 30, "user_related": 20, "search": 10, "detail_page": 5}
TELLING_WORDS = [
    "admin", "manage", "api", "config", "setting", "upload", "download", "delete", "edit", "update", "login", "register", "auth",
    "password", "token",
]
TELLING_PARAMS = ["id", "user", "admin", "key", "token"]
STATIC_WORDS = ["static", "assets", "img", "image", "css", "js", "font"]

# Words in parameters' names, by risk.
DANGEROUS = [
    "file", "path", "dir", "folder", "page", "url", "link", "src", "include", "require", "load", "read", "open", "download", "upload",
    "exec", "cmd", "command", "system", "shell", "eval", "code", "script", "function", "method", "class", "module", "plugin",
    "extension", "callback", "redirect", "return",
]
INCLUSION = [
    "file", "filename", "filepath", "path", "page", "template", "skin", "theme", "layout", "view", "inc", "include", "require", "load",
    "import", "read", "open", "get", "fetch", "pull", "download", "cat", "type", "show", "display",
]
SECURITY = [
    "debug", "test", "admin", "password", "token", "auth", "session", "key", "secret", "config", "settings", "backup", "tmp", "temp",
    "dev", "development", "prod", "production", "staging", "internal", "private", "hidden", "beta", "alpha", "demo", "example",
    "sample", "preview", "draft",
]
DATABASE = ["id", "user", "product", "category", "search", "query", "name", "email"]
MARKUP = ["message", "comment", "content", "text", "description", "title", "subject"]

# Words of addresses that scripts ask for.
ASKED_BY_SCRIPTS = [
    "/ajax/", "/api/", "/rest/", "/graphql/", ".json", ".xml", "showxml", "getxml", "/v1/", "/v2/", "/v3/", "comment", "product",
    "listproduct", "showimage", "artists", "categories", "titles", "?ajax=", "&ajax=",
]
PLAIN_FILES = [".jpg", ".jpeg", ".png", ".gif", ".css", ".js", ".ico", ".svg", ".woff", ".woff2", ".ttf", ".eot"]


def _within(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), x.cast("double")))


def _sum(parts: list[Column]) -> Column:
    return sum(parts[1:], parts[0])


def smart_score(url: Column) -> Column:
    """0 to 100: path words, ending, parameters; 15 where a pattern of little value fits."""
    path, names = F.lower(urls.path(url)), urls.sorted_keys(url)
    much = any_of([F.lower(url).rlike(p) for p in MUCH])
    ending = F.regexp_extract(path, r"(\.[^./]*)$", 1)
    by_ending = F.lit(0)
    for points, endings in ENDINGS.items():
        by_ending = F.when(ending.isin(endings), points).otherwise(by_ending)
    shown = contains_any(path, IMAGE_PATHS) | F.exists(urls.params(url), lambda p: F.lower(p["k"]).isin("file", "path", "src") & p["v"].rlike(IMAGE_VALUE))
    weights = F.create_map(*[F.lit(x) for kv in PARAM_WEIGHTS.items() for x in kv])
    one = lambda n: F.when(F.lower(n).isin("file", "filename", "path"), F.when(shown, 5).otherwise(20)).otherwise(F.coalesce(F.try_element_at(weights, F.lower(n)), F.lit(0)))
    total = (
        F.when(much, 30).otherwise(0) + _sum([F.when(F.contains(path, F.lit(w)), n).otherwise(0) for w, n in PATH_WEIGHTS.items()]) + by_ending
        + F.aggregate(names, F.lit(0), lambda a, n: a + one(n)) + F.when(F.size(names) > 3, 10).otherwise(0) + F.when(much & (F.size(names) > 0), 15).otherwise(0)
    )
    return F.when(any_of([F.lower(url).rlike(p) for p in LITTLE]), F.lit(15.0)).otherwise(_within(total))


def smart_class(score: Column) -> Column:
    """struct(category, cap) of a score: how many addresses of its kind to take."""
    of = lambda c, n: F.struct(F.lit(c).alias("category"), F.lit(n).alias("cap"))
    return F.when(score >= 70, of("high", 20)).when(score >= 40, of("medium", 10)).when(score >= 20, of("low", 5)).otherwise(of("very low", 2))


def second_type(path: Column, names: Column) -> Column:
    low, has = F.lower(path), lambda *w: F.exists(names, lambda n: F.lower(n).isin(*w))
    return (
        F.when(contains_any(low, ["admin", "manage"]), "admin_panel").when(contains_any(low, ["/api/", "/v1/", "/v2/"]), "api_endpoint")
        .when(contains_any(low, ["user", "account", "profile"]), "user_related").when(F.contains(low, F.lit("search")) | has("q", "query", "keyword"), "search")
        .when(has("id") | F.contains(low, F.lit("detail")), "detail_page").when(F.contains(low, F.lit("list")) | has("page"), "list_page").otherwise("general")
    )


def second_score(path: Column, names: Column) -> Column:
    low, kind = F.lower(path), second_type(path, names)
    by_type = F.lit(0)
    for k, n in TYPE_SCORES.items():
        by_type = F.when(kind == k, n).otherwise(by_type)
    telling = F.aggregate(names, F.lit(0), lambda a, n: a + _sum([F.when(F.contains(F.lower(n), F.lit(w)), 5).otherwise(0) for w in TELLING_PARAMS]))
    words = _sum([F.when(F.contains(low, F.lit(w)), 10).otherwise(0) for w in TELLING_WORDS])
    static = _sum([F.when(F.contains(low, F.lit(w)), 20).otherwise(0) for w in STATIC_WORDS])
    return _within(50 + by_type + words + F.size(names) * 2 + telling - static)


def bucket(url: Column) -> Column:
    """1 (two parameters or a telling path), 2 (a query), 3 (the rest): the order in which to take addresses."""
    first = (F.regexp_count(url, F.lit("=")) >= 2) | contains_any(F.lower(url), ["/admin", "/api/", "/login", "/user", "/account"])
    return F.when(first, 1).when(F.contains(url, F.lit("?")), 2).otherwise(3)


def parameter_risk(name: Column) -> Column:
    """struct(risk, level) of a parameter by its name; lists are tried in order, a word's place in its list counts."""
    low, out = F.lower(name), None
    of = lambda c, n: F.struct(F.lit(c).alias("risk"), F.lit(n).alias("level"))
    for risk, level, words in (("dangerous", 3, DANGEROUS), ("inclusion", 3, INCLUSION), ("security", 2, SECURITY), ("database", 2, DATABASE), ("markup", 2, MARKUP)):
        test = contains_any(low, words)
        out = F.when(test, of(risk, level)) if out is None else out.when(test, of(risk, level))
    return out.otherwise(of("plain", 1))


def value_type(value: Column) -> Column:
    return (
        F.when(value.rlike(r"^[+-]?\d{1,19}$"), "number").when(value.rlike(r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"), "email")
        .when(value.rlike("^https?://"), "url").otherwise("text")
    )


def asked_by_script(url: Column, method: Column, headers: Column) -> Column:
    """Whether a request looks like one that a script sends, by address, headers (map) or method."""
    low = F.lower(url)
    head = lambda k: F.coalesce(F.try_element_at(headers, F.lit(k)), F.lit(""))
    types = ["application/json", "text/xml", "application/xml"]
    return ~any_of([low.endswith(x) for x in PLAIN_FILES]) & (
        contains_any(low, ASKED_BY_SCRIPTS) | F.contains(low, F.lit(".php?")) | (head("X-Requested-With") == "XMLHttpRequest")
        | contains_any(F.lower(head("Accept")), [*types, "application/javascript"])
        | contains_any(F.lower(head("Content-Type")), [*types, "application/x-www-form-urlencoded"])
        | method.isin("POST", "PUT", "DELETE", "PATCH")
    )
