"""URL filter chain: each filter gives a verdict struct (allowed, action, reason, score) or null to pass on."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scores, urls

# Words that are code, not addresses.
JS_WORDS = ["function", "return", "var", "let", "const", "true", "false", "null", "undefined", "typeof", "instanceof", "arguments", "window", "document", "console"]
CSS_WORDS = ["margin", "padding", "border", "color", "width", "height", "display", "position", "rgba", "rgb", "flex", "grid"]
FORBIDDEN = [r"</?[a-zA-Z][^>]*>", r"#[0-9A-Fa-f]{3,8}$", r"^\d+$", r"^[#?&=\-_./:\\]+$", r"function\s*\(", r"=>", r"===|!=="]
# Schemes that are never fetched.
DENIED_SCHEMES = ["javascript", "data", "mailto", "tel", "about", "blob", "file"]


def verdict(action: str, reason: str, score: Column | float = 0.0) -> Column:
    return F.struct(F.lit(action != "reject").alias("allowed"), F.lit(action).alias("action"), F.lit(reason).alias("reason"), (score if isinstance(score, Column) else F.lit(float(score))).alias("score"))


@dataclass(frozen=True)
class Options:
    domain: str
    external: str = "degrade"
    static: str = "degrade"
    css: str = "degrade"
    min_score: float = 30.0
    api_only: bool = False


#: Presets: lowest business value, and what happens to links outside the scope.
PRESETS = {
    "strict": {"min_score": 40.0, "external": "reject", "static": "reject"},
    "balanced": {"min_score": 30.0},
    "loose": {"min_score": 20.0},
    "api_only": {"min_score": 20.0, "api_only": True},
    "deep": {"min_score": 15.0},
}


def preset(name: str, domain: str) -> Options:
    return Options(domain, **PRESETS[name])


def basic_format(url: Column, o: Options) -> Column:
    return (
        F.when(url.isNull() | (F.trim(url) == ""), verdict("reject", "empty"))
        .when(F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)).isin(DENIED_SCHEMES), verdict("reject", "scheme"))
        .when(F.octet_length(url) > 2048, verdict("reject", "too long"))
    )


def blacklist(url: Column, o: Options) -> Column:
    out = F.when(F.lower(url).isin(JS_WORDS), verdict("reject", "js word")).when(F.lower(url).isin(CSS_WORDS), verdict("reject", "css word"))
    for p in FORBIDDEN:
        out = out.when(url.rlike(p), verdict("reject", "pattern"))
    return out


def scope(url: Column, o: Options) -> Column:
    s, h = urls.scheme(url), urls.hostname(url)
    return F.when((s != "") & ~s.isin("http", "https"), verdict("reject", "scheme not in scope")).when((h != "") & ~urls.in_domain(h, o.domain), verdict(o.external, "outside scope"))


# Endings of pages that programs make.
DYNAMIC = ["php", "asp", "aspx", "jsp", "do", "action", "htm", "html"]


def by_type(url: Column, o: Options) -> Column:
    """By the ending of the path: whatever stands after its last point, a page without one."""
    ext = F.lower(F.regexp_extract(urls.path(url), r"\.([^.]+)$", 1))
    static = [e for k in ("image", "font", "video", "audio", "document", "archive") for e in scores.EXTENSIONS[k]]
    return (
        F.when(ext == "", verdict("allow", "page", 80)).when(ext.isin(scores.EXTENSIONS["javascript"]), verdict("allow", "js", 85))
        .when(ext.isin(scores.EXTENSIONS["css"]), verdict(o.css, "css", 50)).when(ext.isin(static), verdict(o.static, "static", 20))
        .when(ext.isin(DYNAMIC), verdict("allow", "dynamic", 90)).otherwise(verdict("allow", "unknown", 70))
    )


def api_only(url: Column, o: Options) -> Column:
    if not o.api_only:
        return F.lit(None).cast("struct<allowed:boolean,action:string,reason:string,score:double>")
    return F.when(~url.rlike(r"(?i)/api/|/rest/|/graphql|/v\d+/|\.json|\.xml"), verdict("reject", "not an api"))


def business_value(url: Column, o: Options) -> Column:
    s = scores.chain_score(url)
    return F.when(s < o.min_score, verdict("reject", "low value", s)).otherwise(verdict("allow", "value", s))


#: In ascending priority.
CHAIN: list[tuple[str, int, Callable[[Column, Options], Column]]] = [
    ("BasicFormat", 10, basic_format), ("Blacklist", 20, blacklist), ("Scope", 30, scope),
    ("TypeClassifier", 40, by_type), ("APIOnly", 45, api_only), ("BusinessValue", 50, business_value),
]


def judge(url: Column, o: Options, chain=CHAIN) -> Column:
    """The first verdict of the chain that isn't "allow", else the last one: filters that allow pass a URL on."""
    steps = [f(url, o) for _, _, f in sorted(chain, key=lambda x: x[1])]
    stops = [F.when(s["action"] != "allow", s) for s in steps]
    return F.coalesce(*stops, *reversed(steps))


def explain(url: Column, o: Options, chain=CHAIN) -> Column:
    """Every filter's verdict, with no early stop: array<struct<filter, action, reason, score>>."""
    rows = []
    for name, _, f in sorted(chain, key=lambda x: x[1]):
        s = f(url, o)
        rows.append(F.struct(F.lit(name).alias("filter"), F.coalesce(s["action"], F.lit("pass")).alias("action"), F.coalesce(s["reason"], F.lit("")).alias("reason"), F.coalesce(s["score"], F.lit(0.0)).alias("score")))
    return F.array(*rows)


def valid_url(url: Column) -> Column:
    n = F.octet_length(url)
    return url.isNotNull() & (n >= 2) & (n <= 2048) & ~F.lower(F.regexp_extract(url, r"^([A-Za-z]+):", 1)).isin(DENIED_SCHEMES) & ~url.rlike(r"\s") & ~url.rlike(r"^[^A-Za-z0-9]+$")


def login_url(url: Column) -> Column:
    # Parts of login addresses.
    words = ["/login", "/signin", "/auth/", "/account/login", "/user/login", "/sso/", "/oauth/", "login.php", "signin.php", "auth.php"]
    return scores.any_in(F.lower(url), words)


def scope_filter(df: DataFrame, url: str, include: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """Keep rows whose host, or a suffix of it, is in ``include`` (domain) and not in ``exclude``: hosts are
    exploded into their label suffixes, so long lists are joined by equality."""
    labels = F.split(urls.hostname(F.col(url)), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = df.select(urls.hostname(F.col(url)).alias("_host"), suffixes.alias("_all")).distinct().select("_host", F.explode("_all").alias("_suffix"))

    def hit(domains: DataFrame) -> DataFrame:
        return hosts.join(domains.select(F.lower("domain").alias("_suffix")).distinct(), "_suffix", "left_semi").select("_host").distinct()

    out = df.withColumn("_host", urls.hostname(F.col(url)))
    if include is not None:
        out = out.join(hit(include), "_host", "left_semi")
    if exclude is not None:
        out = out.join(hit(exclude), "_host", "left_anti")
    return out.drop("_host")
