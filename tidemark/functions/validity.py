"""Whether an address is one worth asking for, and why not: validators, static resources, scripts beyond the scope.

Each function returns a Column: a reason (empty where nothing speaks against the address), or a struct."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import urls

# What the deny-list validator knows.
SCRIPT_WORDS = [
    "get", "set", "post", "put", "delete", "patch", "function", "return", "var", "let", "const", "true", "false", "null",
    "undefined", "typeof", "instanceof", "arguments", "this", "super", "new", "class",
]
STYLE_WORDS = [
    "margin", "padding", "border", "color", "width", "height", "display", "position", "rgba", "rgb", "hsl", "flex", "grid",
    "font", "background", "text", "align", "auto", "none", "center", "left", "right",
]
SCRIPT_CODE = r"(?i)(\bfunction\s*\(|=>\s*\{|\bvar\s+\w+\s*=|\blet\s+\w+\s*=|\bconst\s+\w+\s*=|===|!==|\)\s*\{|/\*|\*/|console\.log|window\.|document\.|return\s+\w+)"
HTML_TAG = r"</?[a-zA-Z][^>]*>"
MIME_TOPS = ["application", "text", "image", "video", "audio", "font", "multipart"]
MIME_SUBTYPES = [
    "json", "xml", "html", "plain", "javascript", "css", "pdf", "octet-stream", "x-www-form-urlencoded", "jpeg", "png", "gif", "svg",
    "mpeg", "mp4",
]
MOST_BYTES, MOST_ENCODED = 500, 0.4
TEMPLATE_MARKS = ["{{", "}}", "[[", "]]", "<%", "%>", "<?", "?>"]

# What the quality filter refuses: words of scripts and styles, media types, code, symbols and encodings.
QUALITY_SCRIPT = """function return var let const if else for while do switch case break continue try catch finally throw new this super
class extends static async await yield window document console typeof instanceof undefined null true false NaN Infinity get post put
delete patch head options prototype constructor arguments length push pop shift unshift splice slice concat join split map filter
reduce forEach""".split()
QUALITY_STYLE = """margin padding border color background width height display position top left right bottom flex grid font text rgba rgb
hsl hsla auto none center inherit initial unset relative absolute fixed sticky hidden visible inline block""".split()
QUALITY_MIME = ["application/json", "application/xml", "text/html", "text/plain", "image/png", "image/jpeg", "video/mp4"]
QUALITY_CODE = [
    r"\bfunction\s*\(", r"=>\s*[{(]", r"\b(var|let|const)\s+\w+\s*=", r"===|!==", r"&&|\|\|", r"console\.(log|warn|error)",
    r"\.(push|pop|splice|concat|join|split)\(", r"\.(forEach|map|filter|reduce)\(", r"</?[a-zA-Z][a-zA-Z0-9]*[^>]*>", r"^\([^)]*\)$",
    r"^\{[^}]*\}$", r"^\[[^\]]*\]$", r"^/[^/]+/[gimuy]*$",
]
QUALITY_SYMBOLS = [r"^[#?&=\-_./:\\|~!@$%^*()+\[\]{}]+$", r"^\d+$", r"^#[0-9A-Fa-f]{3,8}$", r"^[a-zA-Z]$"]
QUALITY_ENCODED = [r"\\x[0-9A-Fa-f]{2}", r"\\u[0-9A-Fa-f]{4}", r"&#\d+;", r"&[a-z]+;", "%"]
QUALITY_MARKS = ["]}", "[{", "})", "({"]
QUALITY_QUOTES = ['""', "''", "``"]

# What the allow-list validator knows.
PATH_MIME = [
    "application/", "text/", "image/", "video/", "audio/", "font/", "multipart/", "vnd.ms-excel", "vnd.ms-office",
    "vnd.openxmlformats", "json", "xml", "html", "plain", "javascript", "x-www-form-urlencoded", "vnd.",
]
PATH_WORDS = """function var let const if else for while return break continue switch case default try catch finally throw new
this typeof instanceof void delete in with math date array object string number boolean regexp error json promise symbol console
window document navigator location each map filter reduce foreach some every find findindex includes indexof slice splice push
pop shift unshift concat join match replace search split substring trim jquery react vue angular lodash axios codemirror treenode
workbook book data item index key value result response request options config params args props state context callback handler
listener true false null undefined nan infinity div span a b i p h ul li table tr td th form input button select option block
inline none flex grid absolute relative fixed static sticky http https ftp mailto tel javascript blob base64 get set add remove
del update create init load save open close start stop show hide toggle enable disable path route url href src link can has is
will should must and or not but from to""".split()
CODE_MARKS = [
    r"function\s*\(", r"\)\s*\{", r"=\s*function", r"=>", r"var\s+\w+\s*=", r"let\s+\w+\s*=", r"const\s+\w+\s*=", "===", "!==", "==",
    "!=", r"//\s*\w+", r"/\*", r"\*/", r".concat\(", r".replace\(", r".slice\(",
]
SHORT_PATHS = ["ui", "id", "no", "en", "zh", "cn", "v1", "v2", "v3"]
BUSINESS_WORDS = [
    "api", "admin", "user", "login", "logout", "register", "account", "profile", "setting", "config", "management", "list", "detail",
    "edit", "create", "update", "delete", "search", "query", "export", "import", "download", "upload", "home", "index", "main",
    "dashboard", "workbench", "page", "view", "portal", "center",
]
PAGE_ENDINGS = [".php", ".asp", ".aspx", ".jsp", ".do", ".action", ".html", ".htm", ".shtml", ".json", ".xml"]

# What the check of extracted addresses knows.
EXTRACTED_API = r"^/(api|v\d+|admin|user|login|logout|auth|AJAX)/[a-zA-Z0-9_\-/]+"
EXTRACTED_FILE = r"^/[a-zA-Z0-9_\-/]+\.(php|jsp|asp|aspx|do|action|html|htm)"
EXTRACTED_CODE = r"(function\s*\(|=>\s*\{|\bvar\s+|\blet\s+|\bconst\s+|===|!==|console\.|\.concat\(|\.split\(|\.join\(|\.forEach\(|\.map\()"
EXTRACTED_STYLE = r"^(margin|padding|border|color|width|height|font|display|position|flex|grid|rgba|rgb|hsl)"
EXTRACTED_SYMBOLS = r"^[#?&=\-_./:+*%!@$^|~\\<>{}\[\]()]+$"

# Static resources by ending and the parameters that make an address a dynamic one.
DYNAMIC_KEYS = ["file", "filename", "path", "resource", "download", "view", "src", "url"]
SCRIPT_ENDINGS = ["js", "mjs", "jsx"]
RESOURCES = {
    "image": ["jpg", "jpeg", "png", "gif", "svg", "ico", "webp", "bmp"],
    "css": ["css", "scss", "sass", "less"],
    "font": ["woff", "woff2", "ttf", "eot", "otf"],
    "document": ["pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx"],
    "archive": ["zip", "rar", "tar", "gz", "7z"],
}
# Further endings of media, and the first bytes (hexadecimal) of files.
MEDIA = RESOURCES | {
    "image": [*RESOURCES["image"], "tiff", "tif", "psd", "raw", "heif", "heic"],
    "video": ["mp4", "avi", "mov", "wmv", "flv", "mkv", "webm", "m4v"],
    "audio": ["mp3", "wav", "ogg", "m4a", "flac", "aac", "wma"],
    "archive": [*RESOURCES["archive"], "bz2"],
    "other": ["map"],
}
FIRST_BYTES = [
    ("FFD8FF", "image"), ("89504E470D0A1A0A", "image"), ("474946383761", "image"), ("474946383961", "image"), ("424D", "image"),
    ("52494646", "image"), ("00000100", "image"), ("00000018667479706D703432", "video"), ("000000206674797069736F6D", "video"),
    ("464C56", "video"), ("25504446", "document"), ("504B0304", "archive"),
]
DYNAMIC_IMAGES = [r"(?i)/(show|display|get|view)(image|img|pic|photo|thumb)", r"(?i)/image\.(php|jsp|asp|aspx)", r"(?i)/(thumb|thumbnail|resize)\.(php|jsp|asp)"]
IMAGE_VALUE = r"(?i)(\.(jpg|jpeg|png|gif|webp)$|/pictures/|/images/)"

# What cannot be asked for again with another outcome, and what can.
RETRY_WORDS = [
    "timeout", "connection refused", "connection reset", "temporary failure", "network is unreachable", "no route to host",
    "i/o timeout", "TLS handshake timeout", "EOF",
]


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda x, y: x | y, tests)


def contains_any(text: Column, words: list[str]) -> Column:
    return any_of([F.contains(text, F.lit(w)) for w in words])


def first_reason(checks: list[tuple[Column, str]]) -> Column:
    """The reason of the first check that holds; empty if none does."""
    out = None
    for test, reason in checks:
        out = F.when(test, reason) if out is None else out.when(test, reason)
    return out.otherwise("")


def any_path(url: Column) -> Column:
    """The path of a whole or relative address; empty where a scheme is followed by no path (``mailto:x``)."""
    return (
        F.when(urls.scheme(url) != "", urls.path(url)).when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), "")
        .when(url.startswith("//"), F.regexp_extract(url, r"^//[^/?#]*([^?#]*)", 1)).otherwise(F.regexp_extract(url, r"^([^?#]*)", 1))
    )


def denied(url: Column) -> Column:
    """Why the deny-list refuses an address; empty if it is let through."""
    text = F.trim(url)
    low, path = F.lower(text), any_path(url)
    bare = (path == "") & (urls.query(url) == "") & (urls.fragment(url) == "")
    encoded = F.regexp_count(url, F.lit(r"%[0-9A-Fa-f]{2}")) * 3 / F.octet_length(url)
    after = F.regexp_replace(url, r"^.*?://", "")
    first = F.split(F.regexp_replace(path, r"^/+|/+$", ""), "/")
    return first_reason([
        (text == "", "empty"),
        (low.isin(SCRIPT_WORDS), "script word"),
        (low.isin(STYLE_WORDS) | low.rlike("^(" + "|".join(STYLE_WORDS) + ")-"), "style property"),
        (F.octet_length(text) == 1, "single character"),
        (text.rlike(r"^\d+$"), "digits only"),
        (text.rlike(r"^#[0-9A-Fa-f]{3,8}$"), "colour"),
        (F.octet_length(url) > MOST_BYTES, "too long"),
        (text.rlike(r"^[#?&=\-_./:\\]*$"), "symbols only"),
        (low.rlike(r"^(javascript|data|blob|about|vbscript|file):"), "scheme"),
        (bare & ((urls.host(url) != "") | url.rlike("^//[^/]")), ""),
        (bare, "no path"),
        (url.rlike(SCRIPT_CODE), "script code"),
        (contains_any(url, ["===", "!==", "&&", "||"]), "script operator"),
        (url.rlike(HTML_TAG), "html tag"),
        (encoded > MOST_ENCODED, "too much encoding"),
        (~url.rlike("^https?://") & F.contains(after, F.lit("//")), "comment mark"),
        (contains_any(url, TEMPLATE_MARKS), "template mark"),
        ((path != "") & path.rlike("^/*$"), "no characters in the path"),
        (F.get(first, F.lit(0)).isin(MIME_TOPS) & F.coalesce(F.get(first, F.lit(1)).isin(MIME_SUBTYPES), F.lit(False)), "mime type"),
    ])


def quality_reason(url: Column) -> Column:
    """Why a link is no address worth keeping; empty if nothing speaks against it."""
    t = F.trim(url)
    low = F.lower(t)
    encoded = reduce(lambda x, y: x + y, [F.regexp_count(url, F.lit(p)) for p in QUALITY_ENCODED]) * 3 / F.octet_length(url)
    control = F.regexp_count(url, F.lit(r"\p{Cc}"))
    return first_reason([
        (url.isNull() | (F.octet_length(t) < 2), "too short"), (F.octet_length(t) > MOST_BYTES, "too long"),
        (low.isin(QUALITY_SCRIPT), "script word"), (low.isin(QUALITY_STYLE) | low.rlike("^(" + "|".join(QUALITY_STYLE) + ")-"), "style property"),
        (low.isin(QUALITY_MIME), "mime type"), (any_of([url.rlike(p) for p in QUALITY_CODE]), "code"), (any_of([t.rlike(p) for p in QUALITY_SYMBOLS]), "symbols"),
        (encoded > MOST_ENCODED, "too much encoding"), (control / F.length(url) > 0.2, "control characters"), (F.length(url) - control < 2, "too few characters"),
        (contains_any(url, QUALITY_MARKS), "code structure"), (contains_any(url, QUALITY_QUOTES), "empty quotes"),
    ])


def allowed(url: Column) -> Column:
    """Whether the allow-list lets an address through: a telling word, a page's ending or two segments, and no code."""
    path = F.when(any_path(url) == "", "/").otherwise(any_path(url))
    inner = F.regexp_replace(path, r"^/+|/+$", "")
    low = F.lower(inner)
    words = [w.lower() for w in PATH_WORDS]
    return (
        (url != "") & (url != "/") & (F.regexp_count(url, F.lit(r"%[0-9A-Fa-f]{2}")) <= F.floor(F.octet_length(url) / 10))
        & ~url.rlike(r"</?\w+>") & ~contains_any(F.regexp_replace(path, "^/", ""), PATH_MIME)
        & ~low.isin(words) & ~F.element_at(F.split(low, "/"), -1).isin(words)
        & ~path.rlike(r"^/[a-zA-Z]{1,2}$") & ~(path.rlike(r"^/\d+$") & (F.length(path) < 4))
        & (F.regexp_count(path, F.lit(r"[{}\[\]<>()%]")) <= 3) & (F.octet_length(path) <= 200)
        & ~url.rlike("|".join(CODE_MARKS))  # "//" before a word counts as a comment, so whole addresses are refused: paths only
        & (
            (inner == "")
            | ((F.octet_length(inner) >= 3) | low.isin(SHORT_PATHS))
            & (contains_any(low, BUSINESS_WORDS) | any_of([low.endswith(x) for x in PAGE_ENDINGS]) | F.contains(inner, F.lit("/")))
        )
    )


def extracted(text: Column) -> Column:
    """Whether a piece of a page or script is an address at all."""
    t = F.trim(text)
    host = F.regexp_extract(t, r"^https?://([^/?#]*)", 1)
    garbage = (
        (F.octet_length(t) < 2) | (F.octet_length(t) > MOST_BYTES) | t.rlike(EXTRACTED_SYMBOLS) | t.rlike(EXTRACTED_CODE) | t.rlike(HTML_TAG)
        | F.lower(t).rlike(EXTRACTED_STYLE) | contains_any(t, ["===", "!==", "&&", "||", "\\u", "\\x", "&amp;", "&lt;", "&gt;", "&#"])
    )
    local = t.rlike(EXTRACTED_API) | t.rlike(EXTRACTED_FILE) | t.rlike(r"^/[^/]+/[^/]+")
    return F.coalesce(~garbage & (
        F.when(t.rlike("^https?://"), (host != "") & (F.contains(host, F.lit(".")) | (host == "localhost")))
        .when(t.startswith("//"), t.rlike("^//[^/?#]+")).when(t.startswith("/"), local).otherwise(False)
    ), F.lit(False))


def _kind(ending: Column, kinds: dict[str, list[str]]) -> Column:
    out = None
    for kind, endings in kinds.items():
        out = F.when(ending.isin(endings), kind) if out is None else out.when(ending.isin(endings), kind)
    return out


def static_resource(url: Column, excluded: list[str]) -> Column:
    """struct(filtered, kind): whether an address is only recorded as it ends in an ``excluded`` ending. One with a
    parameter of DYNAMIC_KEYS is not, nor is a script."""
    ending = F.lower(F.regexp_extract(urls.path(url), r"\.([^.]+)$", 1))
    out = [x.lower().lstrip(".") for x in excluded if x.lower().lstrip(".") not in SCRIPT_ENDINGS]
    dynamic = F.arrays_overlap(urls.sorted_keys(url), F.lit(DYNAMIC_KEYS))
    of = lambda filtered, kind: F.struct(F.lit(filtered).alias("filtered"), kind.alias("kind"))
    return (
        F.when(dynamic, of(False, F.lit("dynamic"))).when(ending == "", of(False, F.lit("")))
        .when(ending.isin(SCRIPT_ENDINGS), of(False, F.lit("javascript"))).when(~ending.isin(out), of(False, F.lit("")))
        .otherwise(of(True, F.coalesce(_kind(ending, RESOURCES), F.lit("other"))))
    )


def static_kind(url: Column, content_type: Column, first_bytes: Column) -> Column:
    """What kind of static file it is, by ending, content type, first bytes, or as an image that a script gives out; else null."""
    ending = F.lower(F.regexp_extract(urls.path(url), r"\.([^./]+)$", 1))
    mime = F.trim(F.split_part(F.lower(content_type), F.lit(";"), F.lit(1)))
    by_type = (
        F.when(mime.startswith("image/"), "image").when(mime.startswith("video/"), "video").when(mime.startswith("audio/"), "audio")
        .when(mime.startswith("font/"), "font").when(mime == "text/css", "css").when(mime == "application/pdf", "document")
        .when(F.contains(mime, F.lit("zip")) | F.contains(mime, F.lit("compressed")), "archive")
    )
    start = F.when(F.octet_length(first_bytes) >= 8, F.hex(first_bytes))
    by_bytes = None
    for mark, kind in FIRST_BYTES:
        by_bytes = F.when(start.startswith(mark), kind) if by_bytes is None else by_bytes.when(start.startswith(mark), kind)
    shown = F.exists(urls.params(url), lambda p: F.lower(p["k"]).isin("file", "path", "img", "image") & p["v"].rlike(IMAGE_VALUE))
    dynamic = F.when(any_of([url.rlike(p) for p in DYNAMIC_IMAGES]) | shown, "dynamic_image")
    return F.coalesce(_kind(ending, MEDIA), by_type, by_bytes, dynamic)


def script_beyond_scope(url: Column, base: str, blocked: list[str]) -> Column:
    """struct(taken, address): scripts are taken from any host that is not ``blocked`` (``*.x`` blocks x and all below
    it), with their whole address on the page ``base``."""
    low = F.lower(url)
    script = any_of([low.endswith(x) | F.contains(low, F.lit(x + "?")) for x in (".js", ".mjs", ".jsx")]) | F.contains(low, F.lit("javascript"))
    host = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))
    labels = F.split(host, r"\.")
    wild = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("*."), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    refused = (host != "") & (host.isin([b.lower() for b in blocked]) | F.arrays_overlap(wild, F.lit([b.lower() for b in blocked])))
    scheme, rest = base.split("://", 1)
    own, _, folder = rest.partition("/")
    folder = folder.rsplit("/", 1)[0] if "/" in folder else ""
    address = (
        F.when(url.startswith("//"), F.concat(F.lit(scheme + ":"), url)).when(url.startswith("/"), F.concat(F.lit(f"{scheme}://{own}"), url))
        .when(url.rlike("^https?://"), url).otherwise(F.concat(F.lit(f"{scheme}://{own}"), urls.clean_path(F.concat(F.lit(f"/{folder}/"), url))))
    )
    taken = script & ~refused
    return F.struct(taken.alias("taken"), F.when(taken, address).otherwise("").alias("address"))


def retryable(status: Column, error: Column) -> Column:
    """Whether to ask again: too many requests, a server's error, or an error text of RETRY_WORDS."""
    return F.coalesce((status == 429) | status.between(500, 599), F.lit(False)) | F.coalesce(contains_any(error, RETRY_WORDS), F.lit(False))


def same_place(a: Column, b: Column) -> Column:
    """Whether two addresses have the same scheme, host and path."""
    return (urls.scheme(a) == urls.scheme(b)) & (urls.host(a) == urls.host(b)) & (urls.path(a) == urls.path(b))
