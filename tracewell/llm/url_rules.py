"""URL filters: host and path rules, and pattern rules found through their rarest literal token."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ALNUM = "a-z0-9"
_GAP = f"[^{_ALNUM}]"
_PARTS = re.compile(rf"\|\||[{_ALNUM}]+|.", re.DOTALL)


@dataclass(frozen=True)
class PatternRule:
    """A pattern over the URL (A-Z lower-cased): ^ is no letter or digit, or the start or end; * anything; || the start of a host or of one of its parts."""

    action: str
    text: str

    @cached_property
    def _parts(self) -> list[str]:
        return _PARTS.findall(self.text)

    @cached_property
    def pattern(self) -> str:
        """The regular expression."""
        out, last = [], len(self._parts) - 1
        for i, part in enumerate(self._parts):
            if part == "||":
                out.append(r"://(?:[^/?#]*[.])?")
            elif part == "^":
                out.append(f"(?:^|{_GAP})" if i == 0 else f"(?:{_GAP}|$)" if i == last else _GAP)
            else:
                out.append(".*" if part == "*" else re.escape(part))
        return "".join(out)

    @cached_property
    def literals(self) -> tuple[str, ...]:
        """Letters and digits of the pattern that are whole tokens of every URL it matches: what bounds them is no letter or digit."""
        bounds = lambda i: 0 <= i < len(self._parts) and self._parts[i] != "*" and not self._parts[i].isalnum()
        found = tuple(p for i, p in enumerate(self._parts) if re.fullmatch(f"[{_ALNUM}]+", p) and bounds(i - 1) and bounds(i + 1))
        if not found:
            raise ValueError(f"no part of {self.text!r} is a whole token")
        return found


def read_rules(path: Path) -> tuple[PatternRule, ...]:
    """The rules of a file: an action and a pattern a line."""
    lines = (line.strip() for line in path.read_text("utf-8").splitlines())
    return tuple(PatternRule(*line.split(None, 1)) for line in lines if line and not line.startswith("#"))


@dataclass(frozen=True)
class SiteRule:
    """A rule for a host with its subdomains, and paths with a prefix."""

    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The site rules in use.
SITE_RULES = (
    SiteRule("allow", "org", "/"),
    SiteRule("block", "example.org", "/es/"),
    SiteRule("block", "example.org", "/en/1"),
    SiteRule("allow", "com", "/fr/"),
    SiteRule("block", "com", "/de/"),
)

#: The pattern rules in use: an allowing pattern outweighs blocking ones.
PATTERN_RULES = read_rules(Path(__file__).with_name("url_patterns.txt"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) after the first ://, and the path up to ? or #; both empty for null or without ://."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(text, r"://([^/?#]*)", 1), upper, upper.lower()), F.regexp_extract(text, r"://[^/?#]*([^?#]*)", 1)


def site_rule(host: Column, path: Column, rules: tuple[SiteRule, ...]) -> tuple[Column, Column]:
    """Name and action of the longest rule that fits, the first of equally long ones; null where none does."""
    name = action = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name, action = F.when(fits, F.lit(rule.name)).otherwise(name), F.when(fits, F.lit(rule.action)).otherwise(action)
    return name, action


_TOKEN = re.compile("[a-z0-9]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def build_index(rules: tuple[PatternRule, ...], frequency: dict[str, int]) -> dict[str, list[int]]:
    """Rules by their literal token that occurs in the fewest URLs, the first of equals."""
    index: dict[str, list[int]] = {}
    for i, rule in enumerate(rules):
        index.setdefault(min(rule.literals, key=lambda t: frequency.get(t, 0)), []).append(i)
    return index


def literal_frequency(urls: DataFrame, url_col: str, rules: tuple[PatternRule, ...]) -> dict[str, int]:
    """In how many URLs each literal of the rules is a token; at most a row a literal comes to the driver."""
    literals = sorted({t for r in rules for t in r.literals})
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    tokens = F.array_intersect(F.split(F.translate(F.col(url_col).cast("string"), upper, upper.lower()), "[^a-z0-9]+"), F.array(*map(F.lit, literals)))
    return {r.token: r.n for r in urls.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}


def pattern_verdict(url: str | None, rules: tuple[PatternRule, ...], compiled: list[re.Pattern], index: dict[str, list[int]]) -> str:
    """allow or block, from the rules that the URL's tokens fetch."""
    text = (url or "").translate(_LOWER)
    verdict = "allow"
    for token in set(_TOKEN.findall(text)) & index.keys():
        for i in index[token]:
            if rules[i].action != "block" or verdict != "block":
                if compiled[i].search(text):
                    if rules[i].action == "allow":
                        return "allow"
                    verdict = "block"
    return verdict


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", sites: tuple[SiteRule, ...] = SITE_RULES, patterns: tuple[PatternRule, ...] = PATTERN_RULES) -> DataFrame:
    """A verdict on every row's URL: (id, host, path, rule, verdict).

    The longest site rule that fits decides; where none does, pattern rules decide: allow if an allowing
    one matches or none, else block. A null URL or one without :// has empty host and path, and no site
    rule. Repeated rows stay repeated; other columns are left out.
    """
    index = build_index(patterns, literal_frequency(pages, url_col, patterns))
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [re.compile(r.pattern) for r in patterns]
        for batch in batches:
            verdict = [pattern_verdict(u, patterns, compiled, index) for u in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(verdict, pa.string())], names=["_id", "_url", "_pattern"])

    judged = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url")).mapInArrow(run, f"_id {kind}, _url string, _pattern string")
    host, path = host_and_path(F.col("_url"))
    rows = judged.select("_id", "_pattern", host.alias("host"), path.alias("path"))
    name, action = site_rule(F.col("host"), F.col("path"), sites)
    return rows.select(F.col("_id").alias(id_col), "host", "path", name.alias("rule"), F.coalesce(action, "_pattern").alias("verdict"))


def judge_urls_sql(sites: tuple[SiteRule, ...] = SITE_RULES, patterns: tuple[PatternRule, ...] = PATTERN_RULES) -> str:
    """The same rows in SQL over the table pages, trying every pattern on every URL."""
    by_length = sorted(sites, key=lambda r: -len(r.name))
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    anyof = lambda action: " OR ".join(f"regexp_matches(low, '{p.pattern}')" for p in patterns if p.action == action)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, translate(coalesce(url, ''), '{upper}', '{upper.lower()}') AS low FROM pages),
h AS (SELECT page_id, low, translate(regexp_extract(url, '://([^/?#]*)', 1), '{upper}', '{upper.lower()}') AS host,
             regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM u)
SELECT page_id, host, path, CASE {' '.join(f"WHEN {fits(r)} THEN '{r.name}'" for r in by_length)} END AS rule,
       CASE {' '.join(f"WHEN {fits(r)} THEN '{r.action}'" for r in by_length)}
            WHEN {anyof('allow')} THEN 'allow' WHEN {anyof('block')} THEN 'block' ELSE 'allow' END AS verdict
FROM h
"""
