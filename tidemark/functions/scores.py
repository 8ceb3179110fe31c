"""Classes and scores of URLs and parameter values, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import urls

# Ordered keyword lists of business types.
BUSINESS_TYPES = [
    ("admin_panel", ["admin", "管理", "backend", "console", "dashboard"]),
    ("authentication", ["login", "登录", "auth", "signin", "signup", "register", "注册", "password", "密码"]),
    ("api_endpoint", ["api/", "/v1/", "/v2/", "/rest/", "/graphql", "/json"]),
    ("user_profile", ["user", "profile", "用户", "account", "账号", "member", "会员"]),
    ("payment", ["pay", "payment", "支付", "order", "订单", "checkout", "cart", "购物车"]),
    ("file_upload", ["upload", "上传", "file", "attachment", "附件"]),
    ("search", ["search", "搜索", "query", "find", "lookup"]),
    ("detail_page", ["detail", "详情", "show", "view", "item", "product"]),
    ("list_page", ["list", "列表", "index", "catalog", "category", "分类"]),
    ("form_page", ["form", "表单", "submit", "提交", "post"]),
    ("comment", ["comment", "评论", "reply", "回复", "feedback", "反馈"]),
    ("pagination", ["page", "页", "offset", "limit", "pagesize"]),
    ("filter", ["filter", "筛选", "sort", "排序", "category"]),
    ("language", ["lang", "language", "语言", "locale", "i18n"]),
    ("static_resource", ["static", "assets", "resource", "public", ".css", ".js", ".jpg", ".png", ".ico"]),
    ("analytics", ["track", "analytics", "统计", "beacon", "pixel", "ga"]),
]
# The score of each business type, and what parameter names add.
TYPE_SCORES = {
    "admin_panel": 95, "authentication": 90, "api_endpoint": 85, "payment": 90, "file_upload": 85, "user_profile": 80,
    "form_page": 75, "search": 70, "detail_page": 65, "list_page": 60, "comment": 60, "complex_query": 55, "filter": 45,
    "pagination": 40, "language": 35, "simple_page": 50, "analytics": 20, "static_resource": 10, "unknown": 50,
}
PARAM_SCORES = {
    "id": 5, "uid": 8, "user_id": 8, "userid": 8, "token": 10, "key": 10, "api_key": 10, "secret": 10, "password": 10,
    "email": 7, "username": 7, "phone": 7, "action": 6, "cmd": 8, "command": 8, "method": 6, "callback": 5, "redirect": 7,
    "url": 7, "path": 7, "file": 8, "upload": 9,
}
# Keywords that add to, or take from, a URL's value in the filter chain.
VALUE_WORDS = {
    "admin": 20, "api": 15, "login": 15, "auth": 15, "user": 10, "account": 10, "payment": 20, "order": 15,
    "config": 15, "setting": 12, "upload": 15, "edit": 10, "create": 10, "delete": 12,
}
LOW_VALUE_WORDS = ["track", "analytics", "beacon", "pixel", "ads", "advertisement"]
# Path keywords by tier.
PATH_TIERS = [
    (3.0, ["admin", "phpmyadmin", "cpanel", "login", "auth", "token", "key", "secret", ".env", "config", "backup", "database", "dump", "export", "phpinfo"]),
    (2.0, ["api", "graphql", "rest", "admin", "manage", "upload", "download", "file", "editor", "dashboard", "user", "account", "profile", "payment", "order"]),
    (1.0, ["search", "register", "signup", "contact", "message", "cart", "checkout", "product", "category", "post", "article", "comment", "setting", "preference"]),
]
# Static extensions by kind.
EXTENSIONS = {
    "javascript": ["js", "mjs", "jsx", "ts", "tsx"],
    "css": ["css", "scss", "sass", "less"],
    "image": ["jpg", "jpeg", "png", "gif", "svg", "ico", "webp", "bmp"],
    "video": ["mp4", "avi", "mov", "wmv", "flv", "webm"],
    "audio": ["mp3", "wav", "ogg"],
    "font": ["woff", "woff2", "ttf", "eot", "otf"],
    "document": ["pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx"],
    "archive": ["zip", "rar", "tar", "gz", "7z"],
}


def any_in(text: Column, words: list[str]) -> Column:
    """Whether the text contains one of the words: one alternation, which keeps expressions small."""
    return text.rlike("|".join(map(re.escape, words)))


def value_class(v: Column) -> Column:
    """The class of a parameter value; the order of the tests decides, as some classes include others."""
    low, n = F.lower(v), F.length(v)
    return (
        F.when(n == 0, "empty")
        .when(low.rlike(r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), "uuid")
        .when(low.rlike(r"^[a-f0-9]{32}$"), "md5").when(low.rlike(r"^[a-f0-9]{40}$"), "sha1").when(low.rlike(r"^[a-f0-9]{64}$"), "sha256")
        .when(v.contains("../") | v.contains("..\\") | v.contains("..%2F"), "path_traversal")
        .when(v.rlike(r"^[A-Za-z0-9+/]+=*$") & (n > 10), "base64")
        .when(v.rlike(r"^[0-9a-fA-F]+$") & (n > 6), "hex")
        .when(v.rlike(r"^\d+$"), F.when(n <= 5, "num_1_5").when(n <= 10, "num_6_10").when(n <= 20, "num_11_20").otherwise("num_20+"))
        .when(v.rlike(r"^[a-zA-Z]+$"), F.when(n <= 5, "alpha_1_5").when(n <= 10, "alpha_6_10").otherwise("alpha_11+"))
        .when(v.rlike(r"^[a-zA-Z0-9]+$"), "alphanum")
        .otherwise("special")
    )


def encoding_type(v: Column) -> Column:
    return F.when(v.contains("../") | v.contains("..\\"), "pathtraversal").when(v.rlike(r"%[0-9A-Fa-f]{2}"), "urlencoded").otherwise("normal")


def limiter_type(url: Column) -> Column:
    p = F.lower(urls.path(url))
    ext = F.regexp_extract(p, r"\.([a-z0-9]+)$", 1)
    static = [e for k in EXTENSIONS.values() for e in k if e not in ("mjs", "wav", "ogg")]
    return (
        F.when(ext.isin("jpg", "png", "gif", "svg"), "image").when(ext.isin(static), "static")
        .when(any_in(p, ["api", "ajax", "/v1/", "/v2/"]), "api")
        .when(any_in(p, ["login", "register", "signup", "form", "submit"]), "form").otherwise("normal")
    )


def resource_type(url: Column, domain: str) -> Column:
    p, ext = F.lower(urls.path(url)), urls.extension(url)
    out = F.when((urls.host(url) != "") & ~urls.in_domain(urls.hostname(url), domain), "external")
    for kind in ("javascript", "css"):
        out = out.when(ext.isin(EXTENSIONS[kind]), kind)
    out = out.when(any_in(p, ["/api/", "/rest/", "/graphql", "/v1/", "/v2/", "/v3/"]) | ext.isin("json", "xml"), "api")
    for kind in ("image", "video", "audio", "font", "document", "archive"):
        out = out.when(ext.isin(EXTENSIONS[kind]), kind)
    return out.otherwise("page")


def should_request(kind: Column) -> Column:
    return kind.isin("javascript", "css", "api", "page")


def _resource_name(s: Column) -> Column:
    return s.rlike(r"^[A-Za-z]") & (F.length(s) >= 2) & (F.length(F.regexp_replace(s, r"[^A-Za-z]", "")) / F.length(s) > 0.6)


def url_type(url: Column) -> Column:
    """StaticAsset, AJAX, FileParam, RESTful, MultiParam or Normal; the first that fits."""
    low, seg, names = F.lower(url), urls.segments(url), urls.sorted_keys(url)
    static = r"\.(" + "|".join(e for k in EXTENSIONS.values() for e in k) + r")(\?|$)"
    with_next = F.exists(
        F.when(F.size(seg) >= 2, F.transform(F.sequence(F.lit(1), F.size(seg) - 1), lambda i: F.struct(F.element_at(seg, i).alias("a"), F.element_at(seg, i + 1).alias("b"))))
        .otherwise(F.array().cast("array<struct<a:string,b:string>>")),
        lambda p: _resource_name(p["a"]) & p["b"].rlike(r"\d"),
    )
    return (
        F.when(low.rlike(static), "StaticAsset")
        .when(any_in(low, ["/ajax/", "/api/", "/rest/", "/graphql", "/v1/", "/v2/", "/v3/", ".json", ".xml", ".api"]), "AJAX")
        .when(F.exists(names, lambda k: any_in(F.lower(k), ["file", "path", "doc", "download", "upload"])), "FileParam")
        .when(with_next | F.exists(seg, lambda s: s.contains("-") & s.rlike(r"\d")), "RESTful")
        .when(F.size(names) >= 2, "MultiParam").otherwise("Normal")
    )


def business_pattern(url: Column) -> Column:
    """Path and sorted parameter names; the host does not count."""
    return F.concat(urls.path(url), F.lit("?"), F.array_join(urls.sorted_keys(url), "&"))


def business_type(url: Column) -> Column:
    seg, names = urls.segments(url), urls.sorted_keys(url)
    text = F.lower(F.concat(F.array_join(seg, "/"), F.lit(" "), F.array_join(names, " ")))
    out = None
    for name, words in BUSINESS_TYPES:
        hit = any_in(text, words)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.when((F.size(names) == 0) & (F.size(seg) <= 2), "simple_page").when(F.size(names) >= 3, "complex_query").otherwise("unknown")


def _lookup(key: Column, values: dict[str, float]) -> Column:
    known = F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, float(v))])
    return F.coalesce(F.try_element_at(known, key), F.lit(0.0))


def business_score(url: Column) -> Column:
    seg, names = urls.segments(url), urls.sorted_keys(url)
    text, n, depth = F.lower(F.array_join(seg, "/")), F.size(names), F.size(seg)
    bonus = F.aggregate(names, F.lit(0.0), lambda s, k: s + _lookup(F.lower(k), PARAM_SCORES) + F.when(any_in(F.lower(k), ["admin", "auth"]), 8.0).otherwise(0.0))
    rest = (depth >= 2) & (F.exists(seg, lambda s: any_in(F.lower(s), ["api", "v1", "v2", "v3", "rest"])) | F.element_at(seg, -1).rlike(r"^\d+$|^[0-9a-f]{8}-[0-9a-f]{4}"))
    score = (
        _lookup(business_type(url), TYPE_SCORES) + bonus
        + F.when((depth >= 3) & (depth <= 5), 5.0).when(depth > 6, -3.0).otherwise(0.0)
        + F.when(n == 1, 3.0).when((n >= 2) & (n <= 4), 5.0).when(n > 8, -5.0).otherwise(0.0)
        + F.when(F.coalesce(rest, F.lit(False)), 8.0).otherwise(0.0)
        + F.when(text.rlike("(create|update|delete|edit|modify|remove)"), 10.0).otherwise(0.0)
        + F.when(text.rlike("(config|setting|permission|role|privilege)"), 12.0).otherwise(0.0)
    )
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), score))


def chain_score(url: Column) -> Column:
    low = F.lower(url)
    out = F.lit(50.0)
    for w, s in VALUE_WORDS.items():
        out = out + F.when(low.contains(w), float(s)).otherwise(0.0)
    marks = F.length(url) - F.length(F.replace(url, F.lit("="), F.lit("")))
    out = out + F.when(url.contains("?"), F.when(marks == 1, 5.0).when((marks >= 2) & (marks <= 4), 10.0).otherwise(0.0)).otherwise(0.0)
    out = out + F.when(url.rlike(r"/\d+/?$"), 10.0).otherwise(0.0)
    for w in LOW_VALUE_WORDS:
        out = out - F.when(low.contains(w), 15.0).otherwise(0.0)
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), out))


def path_value(url: Column) -> Column:
    p = F.lower(urls.path(url))
    out = None
    for value, words in PATH_TIERS:
        out = F.when(any_in(p, words), value) if out is None else out.when(any_in(p, words), value)
    static = any_in(p, [".jpg", ".png", ".gif", ".css", ".woff", ".svg"])
    return out.when(static, 0.3).otherwise(0.5)


def priority(url: Column, depth: Column, domain: str) -> Column:
    n = F.size(urls.sorted_keys(url))
    return (
        F.when(depth > 0, 3.0 / depth).otherwise(3.0)
        + F.when(urls.in_domain(urls.hostname(url), domain), 2.0).otherwise(0.0)
        + F.when(urls.query(url) != "", F.when(n >= 3, 3.0).when(n >= 2, 2.25).otherwise(1.5)).otherwise(0.0)
        + 0.5 + 4.0 * path_value(url)
    )
