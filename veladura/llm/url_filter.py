"""URL filter: pattern rules found through the rarest literal token of each.

A rule is a regular expression over ``host || path``.  Its literal tokens are runs of
ASCII letters and digits that every matching URL must hold as whole tokens.  Of these
the one that fewest URLs of the corpus hold becomes the rule's index entry.  A URL's
own tokens fetch the candidate rules, and only those run their expression, so the
cost per URL follows the few rules that share a rare token with it, not all rules.

Everything is one projection over the URLs and one small aggregation before it (token
counts, one row per token of the rules), both in generated code; nothing is shuffled
but these counts.

Edge cases: a null URL, or one without ``://``, has empty host and path; an empty path
fits no list rule; of rules with equally long names the first in order wins; equal
rows give equal results; an empty table gives an empty result; columns other than
``page_id`` and ``url`` are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The index is a literal of the plan, so its size is bounded by this many rules.
MAX_RULES = 5000


@dataclass(frozen=True)
class UrlRule:
    """``pattern`` is searched in host || path; ``tokens`` are lower-case literals in it."""

    name: str
    pattern: str
    verdict: str
    tokens: tuple[str, ...] = ()
    listed: bool = False


def list_rule(host: str, path: str, verdict: str) -> UrlRule:
    """A rule for a host with its subdomains and a path prefix."""
    # a token is whole only if something else delimits it on both sides
    literal = "." + host + path
    tokens = re.findall(r"(?<![A-Za-z0-9])[A-Za-z0-9]+(?![A-Za-z0-9]|$)", literal)
    pattern = "^(?:[^/]*\\.)?" + re.sub(r"([^A-Za-z0-9/])", r"\\\1", host + path)
    return UrlRule(host + path, pattern, verdict, tuple(t.lower() for t in tokens), True)


def word_rule(words: str, verdict: str = "block") -> UrlRule:
    """A rule for words joined by ``-`` that stand alone anywhere in host or path."""
    pattern = "(?:^|[^A-Za-z0-9])(?i:" + words.replace("-", "[-_.]") + ")(?:[^A-Za-z0-9]|$)"
    return UrlRule(words, pattern, verdict, tuple(words.split("-")))


#: The list rules of the registered query.
LIST_RULES = (
    list_rule("com", "/", "allow"),
    list_rule("example.com", "/en/", "block"),
    list_rule("www.example.com", "/en/", "allow"),
    list_rule("net", "/es/", "block"),
    list_rule("net", "/fr/", "block"),
)

#: Words that mark spam where no list rule fits.
WORD_RULES = tuple(
    word_rule(w)
    for w in (
        "spam-farm", "cheap-pills", "link-farm", "free-casino", "online-casino", "casino",
        "adult-cams", "porn", "xxx", "payday-loans", "replica-watches", "buy-followers",
        "warez", "keygen", "torrent-download", "phishing", "malware-download",
    )
)

DEFAULT_RULES = LIST_RULES + WORD_RULES


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    after = _after_scheme(url)
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, url.substr(at + F.lit(3), F.length(url))).otherwise(F.lit(""))


def _tokens(target: Column) -> Column:
    parts = F.split(target, "[^A-Za-z0-9]+")
    return F.array_distinct(F.transform(F.filter(parts, lambda t: t != ""), F.lower))


def rarest_tokens(targets: DataFrame, rules: tuple[UrlRule, ...]) -> dict[str, str]:
    """Each rule's index token: the one of its literals that fewest targets hold.

    ``targets`` has a column ``tokens``.  What reaches the driver is one row per
    literal token of the rules at most.
    """
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {}
    held = F.array_intersect("tokens", F.array(*[F.lit(t) for t in wanted]))
    rows = targets.select(F.explode(held).alias("token")).groupBy("token").count().collect()
    count = {r["token"]: r["count"] for r in rows}
    return {r.name: min(r.tokens, key=lambda t: (count.get(t, 0), t)) for r in rules if r.tokens}


def filter_urls(
    pages: DataFrame, rules: tuple[UrlRule, ...] = DEFAULT_RULES, default: str = "allow"
) -> DataFrame:
    """``page_id, host, path, rule, verdict, matched`` for every URL.

    ``rule`` is the longest list rule that fits.  The verdict is that rule's; without
    one it is that of the longest matching pattern rule, else ``default``.  ``matched``
    names all matching rules.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; the index is bounded by {MAX_RULES}")
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    target = F.concat("host", "path")
    tokens = parts.select("page_id", "host", "path", _tokens(target).alias("tokens"))
    rarest = rarest_tokens(tokens, rules)
    entry = {
        r.name: F.struct(
            F.lit(r.pattern).alias("pattern"),
            F.lit(len(r.name)).alias("size"),
            F.lit(-i).alias("place"),
            F.lit(r.name).alias("name"),
            F.lit(r.verdict).alias("verdict"),
            F.lit(r.listed).alias("listed"),
        )
        for i, r in enumerate(rules)
    }
    by_token: dict[str, list[Column]] = {}
    for r in rules:
        by_token.setdefault(rarest.get(r.name, ""), []).append(entry[r.name])
    by_token.setdefault("", [])  # rules without a literal token are always candidates
    index = F.create_map(
        *[c for t, es in by_token.items() if es for c in (F.lit(t), F.array(*es))]
    )
    keys = F.concat(
        F.array(F.lit("")) if by_token[""] else F.array().cast("array<string>"),
        F.array_intersect("tokens", F.array(*[F.lit(t) for t in by_token if t])),
    )
    candidates = F.flatten(F.transform(keys, lambda t: F.element_at(index, t)))
    matches = F.filter(candidates, lambda r: F.regexp_like(F.concat("host", "path"), r["pattern"]))
    found = tokens.withColumn("matches", matches)

    def best(listed: bool) -> Column:
        of_kind = F.filter("matches", lambda r: r["listed"] == F.lit(listed))
        return F.array_max(F.transform(of_kind, lambda r: F.struct(
            *[r[f].alias(f) for f in ("size", "place", "name", "verdict")]
        )))

    return found.select("page_id", "host", "path", "matches",
                        best(True).alias("l"), best(False).alias("p")).select(
        "page_id",
        "host",
        "path",
        F.col("l.name").alias("rule"),
        F.coalesce("l.verdict", "p.verdict", F.lit(default)).alias("verdict"),
        F.array_sort(F.transform("matches", lambda r: r["name"])).alias("matched"),
    )
