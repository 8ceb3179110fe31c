"""What a site is built with: rules over a page's headers, cookies, markup, meta tags, scripts and address."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    name: str
    category: str
    headers: dict[str, str] = field(default_factory=dict)
    html: tuple[str, ...] = ()
    scripts: tuple[str, ...] = ()
    paths: tuple[str, ...] = ()
    metas: dict[str, str] = field(default_factory=dict)
    cookies: tuple[str, ...] = ()
    version: str = ""


# The rules, in their order, with the categories' own names.
RULES = [
    Rule("React", "前端框架", html=(r"""<div[^>]+id=["']root["']""", r"react\.js", r"react-dom\.js", "data-reactroot", "__REACT_DEVTOOLS_GLOBAL_HOOK__"),
         scripts=(r"React\.createElement", r"ReactDOM\.render"), version=r"react@([\d.]+)"),
    Rule("Vue.js", "前端框架", html=(r"vue\.js", "v-bind", "v-model", "v-if", "v-for", "@click"),
         scripts=(r"new Vue\(", r"Vue\.component", r"createApp\("), version=r"vue@([\d.]+)"),
    Rule("Angular", "前端框架", html=("ng-app", "ng-controller", "ng-model", r"angular\.js"), scripts=(r"angular\.module",), version=r"angular@([\d.]+)"),
    Rule("jQuery", "JavaScript库", html=(r"jquery\.js", r"jquery\.min\.js"), scripts=(r"\$\(document\)\.ready", r"jQuery\."), version=r"jquery[/-]([\d.]+)"),
    Rule("WordPress", "CMS", headers={"X-Powered-By": "WordPress"}, html=("/wp-content/", "/wp-includes/", "wp-json", "wordpress"),
         paths=("/wp-admin/", r"/wp-login\.php"), metas={"generator": r"WordPress ([\d.]+)"}, version=r"WordPress ([\d.]+)"),
    Rule("Laravel", "PHP框架", headers={"Set-Cookie": "laravel_session"}, html=("csrf-token", "laravel"), cookies=("laravel_session", "XSRF-TOKEN")),
    Rule("Django", "Python框架", headers={"Set-Cookie": "csrftoken"}, html=("csrfmiddlewaretoken",), cookies=("csrftoken", "sessionid")),
    Rule("Spring Boot", "Java框架", headers={"X-Application-Context": ".+"}, paths=("/actuator/",), cookies=("JSESSIONID",)),
    Rule("Nginx", "Web服务器", headers={"Server": "nginx"}, version=r"nginx/([\d.]+)"),
    Rule("Apache", "Web服务器", headers={"Server": "Apache"}, version=r"Apache/([\d.]+)"),
    Rule("Microsoft IIS", "Web服务器", headers={"Server": "Microsoft-IIS"}, version=r"Microsoft-IIS/([\d.]+)"),
    Rule("PHP", "编程语言", headers={"X-Powered-By": "PHP"}, paths=(r"\.php",), cookies=("PHPSESSID",), version=r"PHP/([\d.]+)"),
    Rule("ASP.NET", "编程语言", headers={"X-Powered-By": r"ASP\.NET", "X-AspNet-Version": ".+"}, html=("__VIEWSTATE",), cookies=("ASP.NET_SessionId",),
         version=r"ASP\.NET ([\d.]+)"),
    Rule("Node.js", "编程语言", headers={"X-Powered-By": "Express"}),
    Rule("Cloudflare", "CDN", headers={"Server": "cloudflare", "CF-RAY": ".+", "CF-Cache-Status": ".+"}, cookies=("__cfduid",)),
    Rule("阿里云CDN", "CDN", headers={"Ali-Swift-Global-Savetime": ".+", "Eagleid": ".+"}),
    Rule("腾讯云CDN", "CDN", headers={"X-NWS-LOG-UUID": ".+"}),
    Rule("WAF (Web应用防火墙)", "安全组件", headers={"X-WAF-Event": ".+"}, html=("您的请求被拦截", "Request blocked")),
    Rule("Bootstrap", "CSS框架", html=(r"bootstrap\.css", r"bootstrap\.min\.css", r'class="[^"]*\bcontainer\b[^"]*"', r'class="[^"]*\brow\b[^"]*"',
         r'class="[^"]*\bcol-\w+-\d+\b[^"]*"'), version=r"bootstrap[/-]v?([\d.]+)"),
    Rule("Tailwind CSS", "CSS框架", html=(r"tailwind\.css", r'class="[^"]*\b(flex|grid|hidden|block|inline)\b[^"]*"')),
    Rule("Next.js", "前端框架", html=("__NEXT_DATA__", "_next/static"), scripts=("__NEXT_DATA__",), paths=("/_next/",)),
    Rule("Nuxt.js", "前端框架", html=("__NUXT__", "_nuxt/"), paths=("/_nuxt/",)),
    Rule("Svelte", "前端框架", html=("svelte",), scripts=("SvelteComponent",)),
    Rule("Joomla", "CMS", html=("/components/com_", "Joomla!"), metas={"generator": r"Joomla! - ([\d.]+)"}, version=r"Joomla! - ([\d.]+)"),
    Rule("Drupal", "CMS", headers={"X-Drupal-Cache": ".+", "X-Generator": "Drupal"}, html=("Drupal", "/sites/default/files"),
         metas={"generator": r"Drupal ([\d.]+)"}, version=r"Drupal ([\d.]+)"),
    Rule("Magento", "电商平台", html=(r"Mage\.Cookies", "/skin/frontend/"), cookies=("frontend",)),
    Rule("Shopify", "电商平台", headers={"X-ShopId": ".+"}, html=(r"cdn\.shopify\.com", r"Shopify\.")),
    Rule("Express", "Node.js框架", headers={"X-Powered-By": "Express"}),
    Rule("Flask", "Python框架", headers={"Server": "Werkzeug"}, cookies=("session",)),
    Rule("Ruby on Rails", "Ruby框架", html=("csrf-token",), cookies=("_rails_session",)),
    Rule("Gin", "Go框架", headers={"X-Powered-By": "Gin"}),
    Rule("Koa", "Node.js框架", headers={"X-Powered-By": "Koa"}),
    Rule("ThinkPHP", "PHP框架", html=("ThinkPHP",), cookies=("thinkphp_show_page_trace",)),
    Rule("Yii", "PHP框架", html=("Yii Framework",), cookies=("YII_CSRF_TOKEN",)),
    Rule("CodeIgniter", "PHP框架", cookies=("ci_session",)),
    Rule("MySQL", "数据库", html=("MySQL",)),
    Rule("MongoDB", "数据库", html=("MongoDB",)),
    Rule("Redis", "缓存", html=("Redis",)),
    Rule("Axios", "JavaScript库", html=(r"axios\.js", r"axios\.min\.js"), scripts=(r"axios\.",)),
    Rule("Lodash", "JavaScript库", html=(r"lodash\.js", r"lodash\.min\.js"), scripts=(r"_\.",)),
    Rule("Moment.js", "JavaScript库", html=(r"moment\.js",), scripts=(r"moment\(",)),
    Rule("Chart.js", "JavaScript库", html=(r"chart\.js",), scripts=(r"new Chart\(",)),
    Rule("jsDelivr CDN", "CDN", html=(r"cdn\.jsdelivr\.net",)),
    Rule("unpkg CDN", "CDN", html=(r"unpkg\.com",)),
    Rule("cdnjs", "CDN", html=(r"cdnjs\.cloudflare\.com",)),
    Rule("Google Hosted Libraries", "CDN", html=(r"ajax\.googleapis\.com",)),
    Rule("Google Analytics", "分析工具", html=(r"google-analytics\.com/analytics\.js", r"googletagmanager\.com/gtag", r"ga\('create'"),
         scripts=(r"ga\(", r"gtag\(")),
    Rule("百度统计", "分析工具", html=(r"hm\.baidu\.com",)),
    Rule("腾讯分析", "分析工具", html=(r"tajs\.qq\.com",)),
    Rule("Docker", "容器技术", headers={"X-Powered-By": "Docker"}),
    Rule("Kubernetes", "容器编排", headers={"X-Kubernetes": ".+"}),
    Rule("Vercel", "部署平台", headers={"X-Vercel-Id": ".+", "Server": "Vercel"}),
    Rule("Netlify", "部署平台", headers={"X-NF-Request-ID": ".+", "Server": "Netlify"}),
]

# What a find of each kind adds, from which sum a technology counts, and the most it can have.
WEIGHTS = {"header": 30, "html": 20, "meta": 40, "cookie": 25, "script": 30, "path": 20}
LEAST, MOST = 30, 100


def _has(text: Column, pattern: str) -> Column:
    """Whether the pattern stands in the text: a search for a word where the pattern is one."""
    word = re.sub(r"\\([.()$])", r"\1", pattern)
    plain = not re.search(r"[\\^$.|?*+()\[\]{}]", re.sub(r"\\[.()$]", "", pattern))
    return F.contains(text, F.lit(word)) if plain else text.rlike(pattern)


def _first(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def _found(rule: Rule, html: Column, headers: Column, url: Column | None) -> Column:
    """struct(name, category, confidence, version): the sum of the weights of what is found, and the first version in
    the headers, the page and the meta tags that match."""
    weights, versions = [], []

    def add(hit: Column, kind: str, text: Column | None = None) -> None:
        weights.append(F.when(hit, WEIGHTS[kind]).otherwise(0))
        if rule.version and text is not None:
            versions.append(F.when(hit, _first(text, rule.version)))

    for name, pattern in rule.headers.items():
        value = F.try_element_at(headers, F.lit(name.lower()))
        add((value != "") & _has(value, pattern), "header", value)
    for pattern in rule.html:
        add(_has(html, pattern), "html", html)
    for name, pattern in rule.metas.items():
        content = F.regexp_extract(html, rf"""<meta[^>]+name=["']{name}["'][^>]+content=["']([^"']+)["']""", 1)
        add(_has(content, pattern), "meta", content)
    for cookie in rule.cookies:
        add(F.contains(F.lower(F.try_element_at(headers, F.lit("set-cookie"))), F.lit(cookie.lower())), "cookie")
    for pattern in rule.scripts:
        add(_has(html, pattern), "script")
    if url is not None:
        for pattern in rule.paths:
            add(_has(url, pattern), "path")
    total = weights[0]
    for w in weights[1:]:
        total = total + w
    version = F.coalesce(*versions, F.lit("")) if versions else F.lit("")
    return F.struct(F.lit(rule.name).alias("name"), F.lit(rule.category).alias("category"), F.least(total, F.lit(MOST)).alias("confidence"), version.alias("version"))


def detected(html: Column, headers: Column | None = None, url: Column | None = None, rules: list[Rule] = RULES) -> Column:
    """array<struct(name, category, confidence, version)> of the technologies of a response, in the rules' order.
    ``headers``: map<string,string>, names in any case; null or missing parts match nothing."""
    none = F.create_map().cast("map<string,string>")
    given = none if headers is None else F.coalesce(F.map_from_entries(
        # of names that differ in case only, the first by code point counts, as a map has no order
        F.transform(F.array_distinct(F.transform(F.map_keys(headers), F.lower)), lambda k: F.struct(
            k.alias("key"), F.array_min(F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == k))["value"].alias("value")))), none)
    text = F.coalesce(html, F.lit(""))
    rules = [r for r in rules if r.headers or r.html or r.metas or r.cookies or r.scripts or r.paths and url is not None]
    return F.filter(F.array(*[_found(r, text, given, url) for r in rules]), lambda t: t["confidence"] >= LEAST)


def technologies(pages: DataFrame, id_col: str = "page_id", html: str = "html", headers: str | None = None, url: str | None = None) -> DataFrame:
    """(id, name, category, confidence, version), a row for every technology of a page."""
    found = detected(F.col(html), F.col(headers) if headers else None, F.col(url) if url else None)
    return pages.select(id_col, F.inline(found))


def summary(found: Column) -> Column:
    """array<string>: "name version" of what ``detected`` gives, the name alone without a version."""
    return F.transform(found, lambda t: F.rtrim(F.concat(t["name"], F.lit(" "), t["version"])))


def by_category(found: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(category, name, version, pages) over all pages of ``technologies``."""
    return found.groupBy("category", "name", "version").agg(F.count_distinct(id_col).alias("pages"))
