"""Links and assets of every kind of element, and pages that ask for a login, from captured markup.

Patterns stay in the JVM and possessive, so no text makes them try again. Comments and the bodies of scripts are no
markup. A quote that is never closed ends at the next ``<`` or the tag's end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import urls
from tidemark.functions.validity import contains_any
from tidemark.operators import filters, scripts

LINK = "array<struct<kind:string,link:string>>"
# Schemes whose links are kept apart, and attributes that may hold addresses.
APART = ["mailto:", "tel:", "ftp://", "ws://", "wss://", "data:"]
DATA = ["data-url", "data-href", "data-src", "data-link", "data-ajax", "data-target"]
BUTTON_DATA = ["data-url", "data-href", "data-target", "data-action"]
EVENTS = ["onclick", "onmouseover", "onmousedown", "ondblclick"]
CALL = r"""\w+\s*\(\s*['"]([^'"]+)['"]"""
# Signs of a login page, of which so many must stand there.
LOGIN_SIGNS = [
    "登录", "登陆", "用户登录", "账号登录", "sign in", "log in", "user login", "account login", "authentication required",
    "please login", "login required", "password", "username",
]
LEAST_SIGNS = 3


def bare(html: Column) -> Column:
    """The markup without comments and the bodies of scripts and styles."""
    return F.regexp_replace(F.regexp_replace(html, r"(?s)<!--.*?-->", ""), r"(?is)(<(script|style)\b[^>]*+>).*?(</\2\s*>)", "$1$3")


def tags(html: Column, names: str) -> Column:
    """array<string>: the opening tags of the elements (a pattern of names), whole."""
    return F.regexp_extract_all(html, F.lit(rf"""(?is)<(?:{names})(?=[\s/>])(?:[^>"']++|"[^"<]*+"|'[^'<]*+'|["'])*+>"""), F.lit(0))


def attribute(tag: Column, name: str) -> Column:
    """The attribute's value, in either quotes or none, with the common character references resolved; empty if absent."""
    pattern = rf"""(?is)[\s"'/]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    out = F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)])
    for reference, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(reference), F.lit(sign))
    return F.trim(out)


def _kind(kind: str, found: Column) -> Column:
    return F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("link")))


def _plain(html: Column, names: str, name: str, scripts_too: bool = False) -> Column:
    values = F.transform(tags(html, names), lambda t: attribute(t, name))
    return F.filter(values, lambda x: (x != "") if scripts_too else (x != "") & ~F.lower(x).startswith("javascript:"))


def _held(found: Column, names: list[str]) -> Column:
    """Addresses in the tags' data attributes: whole ones and paths from the root."""
    values = F.flatten(F.transform(found, lambda t: F.array(*[attribute(t, n) for n in names])))
    return F.filter(values, lambda x: x.startswith("http") | x.startswith("/"))


def page_links(html: Column) -> Column:
    """array<struct(kind, link)>: anchors, calls in ``javascript:`` anchors, forms, frames, objects, refreshes (their address
    in lower case, as defined), areas, bases, data attributes, event code and buttons, kind by kind. Mail, telephone
    and such links are not among them (``scripts.special_links`` has those). Null without markup."""
    h = bare(html)
    anchors = F.filter(F.transform(tags(h, "a"), lambda t: attribute(t, "href")), lambda x: (x != "") & ~contains_start(x, APART))
    calls = F.flatten(F.transform(F.filter(anchors, lambda x: x.startswith("javascript:")), lambda x: F.regexp_extract_all(x, F.lit(CALL), F.lit(1))))
    refresh = F.filter(tags(h, "meta"), lambda t: F.lower(attribute(t, "http-equiv")) == "refresh")
    targets = F.transform(refresh, lambda t: F.regexp_extract(F.lower(attribute(t, "content")), r"(?:^|;)\s*url=([^;]*)", 1))
    every = tags(h, "[a-z][a-z0-9-]*+")
    events = F.filter(every, lambda t: t.rlike(rf"(?i)[\s\"'/](?:{'|'.join(EVENTS)})\s*="))
    code = F.flatten(F.transform(events, lambda t: F.flatten(F.array(*[scripts.code_addresses(attribute(t, e)) for e in EVENTS]))))
    buttons = F.filter(every, lambda t: t.rlike(r"(?i)^<button[\s/>]") | (F.lower(attribute(t, "role")) == "button"))
    return F.concat(
        _kind("a", F.filter(anchors, lambda x: ~x.startswith("javascript:") & ~x.startswith("#"))), _kind("call", calls),
        _kind("form", _plain(h, "form", "action")), _kind("iframe", _plain(h, "iframe", "src")), _kind("frame", _plain(h, "frame", "src")),
        _kind("embed", _plain(h, "embed", "src", True)), _kind("object", _plain(h, "object", "data", True)),
        _kind("refresh", F.filter(F.transform(targets, lambda x: F.regexp_replace(F.trim(x), r"""^['"]+|['"]+$""", "")), lambda x: x != "")),
        _kind("area", _plain(h, "area", "href")), _kind("base", _plain(h, "base", "href", True)),
        _kind("data", _held(F.filter(every, lambda t: F.contains(F.lower(t), F.lit("data-"))), DATA)), _kind("event", code),
        _kind("button", _held(buttons, BUTTON_DATA)),
    )


def contains_start(x: Column, starts: list[str]) -> Column:
    out = F.lit(False)
    for s in starts:
        out = out | F.lower(x).startswith(s)
    return out


def links(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(id, pos, kind, link, target): every link with the address that it means on its page. ``//host`` in an anchor means
    either scheme, elsewhere the page's own."""
    found = pages.select(id_col, F.col(url).alias("_u"), F.posexplode(page_links(F.col(html))).alias("pos", "_l")).select(id_col, "_u", "pos", "_l.*")
    meant = urls.resolve(F.col("_u"), F.col("link"))
    return found.select(id_col, "pos", "kind", "link", F.explode(F.when(F.col("kind") == "a", meant).otherwise(F.slice(meant, 1, 1))).alias("target"))


def page_assets(html: Column) -> Column:
    """array<struct(kind, link)>: style sheets and such, scripts, images, and every picture of a ``srcset``; an address once."""
    h = bare(html)
    sets = F.filter(F.transform(tags(h, "img|source"), lambda t: attribute(t, "srcset")), lambda x: x != "")
    pictures = F.flatten(F.transform(sets, lambda s: F.transform(F.split(s, ","), lambda p: F.regexp_extract(p, r"^\s*(\S+)", 1))))
    every = F.concat(
        _kind("link", _plain(h, "link", "href", True)), _kind("script", _plain(h, "script", "src", True)), _kind("img", _plain(h, "img", "src", True)),
        _kind("srcset", F.filter(pictures, lambda x: x != "")),
    )
    places = F.transform(every, lambda e: e["link"])
    return F.filter(F.transform(every, lambda e, i: F.when(F.array_position(places, e["link"]) == i + 1, e)), lambda e: e.isNotNull())


def login_page(html: Column) -> Column:
    """Whether at least LEAST_SIGNS signs of a login page stand in it, in any case; false without markup."""
    low = F.lower(html)
    signs = [F.when(F.contains(low, F.lit(s)), 1).otherwise(0) for s in LOGIN_SIGNS]
    total = signs[0]
    for s in signs[1:]:
        total = total + s
    return total >= LEAST_SIGNS


def without_login_repeats(df: DataFrame, url: str, order: list[str], most: int = 4) -> DataFrame:
    """All rows but login addresses whose scheme, host and path stood ``most`` times before, in the given order. Rows of
    other addresses are not ranked, so they are not shuffled."""
    u = F.col(url)
    login = F.coalesce(filters.login_url(u), F.lit(False))
    named = df.withColumn("_base", F.concat(urls.scheme(u), F.lit("://"), urls.host(u), urls.path(u)))
    ranked = named.where(login).withColumn("_n", F.row_number().over(Window.partitionBy("_base").orderBy(*order))).where(F.col("_n") <= most)
    return df.where(~login).unionByName(ranked.drop("_base", "_n"))


def foreign_scripts(assets: DataFrame, host: str, url: str = "url", cdn: Column | None = None) -> DataFrame:
    """The distinct script addresses of other hosts that share ``host``'s base domain or, by ``cdn``, stand on a network
    for content: those whose text is worth reading."""
    from tidemark.functions import hosts

    u = F.col(url)
    own = F.lit(f"http://{host}/")
    known = hosts.is_cdn(urls.hostname(u)) if cdn is None else cdn
    kin = urls.base_domain(u) == urls.base_domain(own)
    out = assets.where(F.lower(u).endswith(".js") & (urls.host(u) != "") & (urls.host(u) != host))
    return out.where(kin | known).select(u.alias("url"), F.when(known, "cdn").otherwise("kin").alias("reason")).distinct()
