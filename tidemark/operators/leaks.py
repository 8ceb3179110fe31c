"""Leak scan and technology detection: rules are a small table that joins with lines or pages."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.validity import any_of
from tidemark.operators.leak_rules import CATALOGUE

Rules = list[tuple[str, str, str, bool]]
#: A table of rules may have so many; each is a pass over every text.
MAX_RULES = 1_000

SCHEMA = "name string, pattern string, severity string, mask boolean"

#: The scan's own rules; ``rules_from_json`` reads others.
RULES = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "LOW", True),
    ("ipv4", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "LOW", False),
    ("phone", r"\+?\d{1,3}[ -]\d{3}[ -]\d{3,4}[ -]?\d{0,4}", "MEDIUM", True),
    ("credential_assignment", r"(?i)(?:token|secret|password|passwd|api_?key)\s*[=:]\s*[\"'][^\"']{6,}[\"']", "HIGH", True),
    ("bearer", r"(?i)bearer\s+[a-z0-9._-]{16,}", "HIGH", True),
    ("access_key_id", r"\bAKIA[0-9A-Z]{16}\b", "HIGH", True),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "HIGH", False),
    ("json_web_token", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*", "HIGH", True),
    ("hex_secret", r"\b[0-9a-fA-F]{40}\b", "MEDIUM", True),
    ("card_number", r"\b(?:\d{4}[ -]){3}\d{4}\b", "HIGH", True),
]

SEVERITY = {"HIGH": 3, "MEDIUM": 2, "LOW": 1}


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, SCHEMA)


def rules_from_json(spark: SparkSession, text: str, strict: bool = False, base: DataFrame | None = None) -> DataFrame:
    """Rules of a JSON object name -> {pattern, severity, mask}, itself or under "rules". Names that begin with an
    underscore, values that are no objects and empty patterns are skipped. A pattern's trailing line feed, which
    no line can match, is stripped unless ``strict``. ``base``: merge into these instead of replacing them."""
    spec = json.loads(text)
    spec = spec.get("rules", spec)
    rows = []
    for name, r in spec.items():
        if name.startswith("_") or not isinstance(r, dict) or not r.get("pattern"):
            continue
        pattern = r["pattern"] if strict else r["pattern"].rstrip("\n")
        if pattern:
            rows.append((name, pattern, str(r.get("severity", "MEDIUM")).upper(), bool(r.get("mask", False))))
    out = spark.createDataFrame(rows, SCHEMA)
    return out if base is None else base.join(out, "name", "left_anti").unionByName(out)


def rules_from_records(records: list[dict], strict: bool = False) -> Rules:
    """Rules of a rule repository, one record a pattern with ``category``, ``name`` and ``regex``: the severity and
    whether to mask follow from the category and the name."""
    out = []
    for r in records:
        name, category, pattern = str(r.get("name") or ""), str(r.get("category") or ""), r.get("regex") or r.get("pattern") or ""
        pattern = pattern if strict else pattern.rstrip("\n")
        if not pattern:
            continue
        words = f"{category} {name}".lower()
        severity = "HIGH" if any(w in words for w in ("key", "token", "secret", "password", "credential", "private")) else "LOW" if any(w in words for w in ("mail", "url", "phone", "misc", "ip")) else "MEDIUM"
        out.append((f"{category} - {name}" if category else name, pattern, severity, severity == "HIGH"))
    return out


def catalogue(strict: bool = False) -> Rules:
    """The whole list of rules. A trailing line feed, which no line has, is stripped unless ``strict``."""
    return [(n, p if strict else p.rstrip("\n"), s, m) for n, p, s, m in CATALOGUE]


def usable(spark: SparkSession, rules: Rules | DataFrame) -> Rules:
    """The rules whose patterns can be compiled; a table of rules is read to the driver, up to MAX_RULES."""
    if isinstance(rules, DataFrame):
        rules = [tuple(r) for r in rules.select("name", "pattern", "severity", "mask").limit(MAX_RULES + 1).collect()]
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    compiled, pattern = [], spark._jvm.java.util.regex.Pattern
    for rule in rules:
        try:
            pattern.compile(rule[1])
        except Exception:  # noqa: S112  (what cannot be a pattern finds nothing)
            continue
        compiled.append(rule)
    return compiled


def mask(value: Column) -> Column:
    n = F.length(value)
    return F.when(n <= 8, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.left(value, F.lit(4)), F.repeat(F.lit("*"), n - 8), F.right(value, F.lit(4))))


def _matches(hit: Column, line: Column, name: str, pattern: str, severity: str, masked: bool) -> Column:
    found = F.when(hit & line.rlike(pattern), F.regexp_extract_all(line, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    return F.transform(found, lambda v: F.struct(F.lit(name).alias("type"), F.lit(severity).alias("severity"), v.alias("full_value"), (mask(v) if masked else v).alias("value")))


def scan(df: DataFrame, id_col: str, text: str, rules: Rules | DataFrame = RULES) -> DataFrame:
    """(id, type, severity, line_no, full_value, value). Whole texts are tested first, and only those that a rule can
    match are cut into lines, on which only the rules are tried that hit their text. Rules that are no patterns
    are skipped; a null text has no lines."""
    rules = usable(df.sparkSession, rules)
    if not rules:
        return df.sparkSession.createDataFrame([], df.select(F.col(id_col).alias("id")).schema.simpleString()[7:-1] + ", type string, severity string, line_no int, full_value string, value string")
    whole = [F.col("_text").rlike("(?m)" + p) for _, p, _, _ in rules]
    texts = df.select(F.col(id_col).alias("id"), F.col(text).alias("_text")).where(any_of(whole)).withColumn("_hit", F.array(*whole))
    lines = texts.select("id", "_hit", F.posexplode(F.split("_text", "\n")).alias("pos", "line"))
    hits = F.flatten(F.array(*[_matches(F.get("_hit", F.lit(i)), F.col("line"), *rule) for i, rule in enumerate(rules)]))
    found = lines.select("id", (F.col("pos") + 1).alias("line_no"), F.explode(hits).alias("h"))
    return found.select("id", "h.type", "h.severity", "line_no", "h.full_value", "h.value")


def scan_headers(df: DataFrame, id_col: str, headers: str, rules=RULES) -> DataFrame:
    lines = df.select(F.concat(F.col(id_col).cast("string"), F.lit(" (Headers)")).alias("id"), F.array_join(F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n").alias("blob"))
    return scan(lines, "id", "blob", rules)


def at_least(found: DataFrame, severity: str) -> DataFrame:
    rank = F.when(F.lit(False), 0)
    for k, n in SEVERITY.items():
        rank = rank.when(F.col("severity") == k, n)
    return found.where(rank >= SEVERITY[severity])


def summary(found: DataFrame) -> DataFrame:
    """Counts by severity, by type and overall: (severity, type, n, sources), nulls where not grouped by."""
    return found.groupingSets([["severity"], ["type"], []], "severity", "type").agg(F.count("*").alias("n"), F.count_distinct("id").alias("sources"))


# Fixed values: (technology, category, where, pattern, confidence).
TECHNOLOGIES = [
    ("jQuery", "JavaScript Library", "html", r"(?i)jquery[.-]?(\d+\.\d+(?:\.\d+)?)?", 20),
    ("Bootstrap", "CSS Framework", "html", r"(?i)bootstrap(?:\.min)?\.(?:css|js)", 20),
    ("WordPress", "CMS", "html", r"(?i)wp-content|wp-includes", 20),
    ("WordPress", "CMS", "meta", r"(?i)<meta[^>]*generator[^>]*wordpress\s*([\d.]*)", 40),
    ("React", "JavaScript Framework", "html", r"(?i)data-reactroot|react(?:-dom)?(?:\.min)?\.js", 20),
    ("Vue.js", "JavaScript Framework", "html", r"(?i)vue(?:\.min)?\.js|data-v-[0-9a-f]{8}", 20),
    ("Inline script", "Page", "js", r"(?i)<script[^>]*>\s*var\s", 30),
    ("Inline style", "Page", "js", r"(?i)<style[^>]*>", 30),
    ("Navigation", "Page", "meta", r"(?i)<nav\b", 40),
]


def technologies(pages: DataFrame, html: str = "html", rules=TECHNOLOGIES, least: int = 30) -> DataFrame:
    """page_id, name, category, confidence: every matched pattern adds its weight, at most 100 in all."""
    hits = F.filter(F.array(*[F.when(F.col(html).rlike(p), F.struct(F.lit(n).alias("name"), F.lit(c).alias("category"), F.lit(w).alias("w"))) for n, c, _, p, w in rules]), lambda x: x.isNotNull())
    per = pages.select("page_id", F.explode(hits).alias("h")).groupBy("page_id", "h.name", "h.category").agg(F.least(F.sum("h.w"), F.lit(100)).alias("confidence"))
    return per.where(F.col("confidence") >= least)
