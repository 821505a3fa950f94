"""URL filters: pattern rules found by their rarest literal token."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+")
_UPPER = {c: c + 32 for c in range(65, 91)}


@dataclass(frozen=True)
class Rule:
    """name: what is reported. pattern: a regular expression searched in host + path. tokens: literal tokens
    that every url it fits has whole. verdict: block or allow. size: the longest fitting rule decides."""

    name: str
    pattern: str
    tokens: tuple[str, ...]
    verdict: str
    size: int
    listed: bool = True


def prefix_rule(host: str, path: str, verdict: str) -> Rule:
    """Fits the host and its subdomains where the path starts with `path`.

    Tokens that the path's end may cut are not whole in every url, so they don't count.
    """
    whole = [t.group() for t in _TOKEN.finditer(path) if t.end() < len(path)]
    pattern = rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape('/' + path)}"
    return Rule(f"{host}/{path}", pattern, tuple(dict.fromkeys([*_TOKEN.findall(host), *whole])), verdict, len(host) + 1 + len(path))


def host_word_rule(word: str) -> Rule:
    """The filter's own kind: blocks hosts that have `word` (parts joined by hyphens) as a label or part of one."""
    return Rule(word, rf"^(?:[^/]*[.-])?{re.escape(word)}(?:[.-][^/]*)?(?:/|$)", tuple(_TOKEN.findall(word)), "block", 0, listed=False)


#: Host, path and verdict of the listed rules.
LISTED = (
    prefix_rule("com", "en/", "block"),
    prefix_rule("example.com", "en/7", "allow"),
    prefix_rule("net", "de/", "allow"),
    prefix_rule("example.net", "de/8", "block"),
    prefix_rule("org", "es/", "block"),
)
def path_word_rule(word: str) -> Rule:
    """The filter's own kind: blocks paths that have `word` (parts joined by hyphens) as a segment or part of one."""
    return Rule(f"/{word}", rf"^[^/]*/(?:.*[/._-])?{re.escape(word)}(?:[/._-].*)?$", tuple(_TOKEN.findall(word)), "block", 0, listed=False)


#: Host and path words that mark spam, gambling, adult sites, trackers and machine pages; they only decide where no listed
#: rule fits. Fixed values, a parameter of filter_urls().
HOST_WORDS = "spam-farm cheap-pills casino free-money adult-cams link-exchange viagra payday-loans porn xxx torrents warez adserver tracker doubleclick".split()
PATH_WORDS = "wp-login cgi-bin porn casino viagra free-money cheap-pills adserver torrents".split()
SPAM_HOSTS = (*map(host_word_rule, HOST_WORDS), *map(path_word_rule, PATH_WORDS))


def split_url(url: str | None) -> tuple[str, str]:
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    stop = re.search(r"[/?#]", rest)
    host = rest[: stop.start()] if stop else rest
    path = rest[stop.start() :] if stop else ""
    if cut := re.search(r"[?#]", path):
        path = path[: cut.start()]
    return host.translate(_UPPER), path


def token_counts(pages: DataFrame, tokens: list[str]) -> dict[str, int]:
    """In how many urls each of the rules' tokens is; counted over the whole table, one row a token comes back."""
    found = F.array_distinct(F.filter(F.split(F.col("url"), r"[^0-9A-Za-z\x{80}-\x{10ffff}]+"), lambda t: t.isin(tokens)))
    counts = pages.select(F.explode(found).alias("token")).groupBy("token").count()
    return {r["token"]: r["count"] for r in counts.collect()}


class RuleIndex:
    def __init__(self, rules: tuple[Rule, ...], counts: dict[str, int]):
        self._by_token: dict[str, list[tuple[Rule, re.Pattern]]] = {}
        self._always: list[tuple[Rule, re.Pattern]] = []
        for rule in rules:
            entry = (rule, re.compile(rule.pattern))
            if rule.tokens:
                self._by_token.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), -len(t), t)), []).append(entry)
            else:
                self._always.append(entry)

    def fitting(self, place: str) -> list[Rule]:
        found = {r.name: (r, p) for t in set(_TOKEN.findall(place)) for r, p in self._by_token.get(t, ())}
        return [r for r, p in [*found.values(), *self._always] if p.search(place)]


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = LISTED, own: tuple[Rule, ...] = SPAM_HOSTS) -> DataFrame:
    """(page_id, url, host, path, rule, verdict, own_rule) of every page.

    The longest fitting listed rule decides; else a page is blocked if a spam rule fits, and allowed if none
    does. Null urls and urls without '://' have an empty host and path and are allowed. Repeated rows are
    judged each; an empty table gives none; other columns are ignored.
    """
    every = (*rules, *own)
    counts = token_counts(pages, sorted({t for r in every for t in r.tokens}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = RuleIndex(every, counts)
        for batch in batches:
            url = batch.column("url").to_pylist()
            places = [split_url(u) for u in url]
            fits = [index.fitting(h + p) for h, p in places]
            best = [max((r for r in f if r.listed), key=lambda r: (r.size, r.name), default=None) for f in fits]
            spam = [min((r.name for r in f if not r.listed), default=None) for f in fits]
            verdict = [b.verdict if b else "block" if s else "allow" for b, s in zip(best, spam, strict=True)]
            text = [batch.column("url"), *(pa.array(x, pa.string()) for x in ([p[0] for p in places], [p[1] for p in places], [b and b.name for b in best], verdict, spam))]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), *text], ["page_id", "url", "host", "path", "rule", "verdict", "own_rule"])

    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    return narrow.mapInArrow(run, "page_id long, url string, host string, path string, rule string, verdict string, own_rule string")
