"""URL filters: a weighted vocabulary matched by Aho-Corasick, and host and path rules.

The vocabulary lists strict terms (one is enough to block) and soft terms (``SOFT_LIMIT``
different ones block).  A term counts only between boundaries: the characters before and
after it must not be letters or digits of ASCII.  Terms are searched in host and path,
A-Z lower-cased; query and fragment name the visitor's way, not the page, and do not count.

Rules name a host and a path prefix.  A rule fits its host and all subdomains; of the rules
that fit, the longest text wins, and it decides before the vocabulary does.

Input that is null or has no ``://`` has an empty host and path, matches nothing and is
allowed.  Repeated rows give repeated results; columns of the input other than the key and
the url are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weight of a strict term; soft terms weigh 1.
STRICT = 2
SOFT_LIMIT = 2

VOCABULARY: dict[str, int] = {
    # strict: adult content, gambling, spam, stolen goods
    **dict.fromkeys((
        "adult", "porn", "porno", "xxx", "sex", "hentai", "escort", "camgirls", "nsfw", "casino", "casinos", "poker",
        "roulette", "betting", "sportsbook", "jackpot", "viagra", "cialis", "spam", "phishing", "malware", "warez",
        "keygen", "torrent", "torrents",
    ), STRICT),
    # soft: harmless alone
    **dict.fromkeys((
        "free", "win", "winner", "bet", "bets", "bonus", "cash", "cheap", "click", "crack", "deal", "deals", "discount",
        "download", "downloads", "farm", "games", "hot", "live", "loan", "loans", "lottery", "money", "nude", "offer",
        "offers", "pills", "prize", "rich", "sexy", "slots", "spin", "stream", "streams", "teen", "traffic",
    ), 1),
}

# Host, path, verdict.
RULES: tuple[tuple[str, str, str], ...] = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)


def _automaton(vocabulary: Mapping[str, int]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for term, weight in vocabulary.items():
        if term:
            found.add_word(term, (term, weight))
    if len(found):
        found.make_automaton()
    return found


def _bounded(text: str, at: int) -> bool:
    return not (0 <= at < len(text)) or not (text[at].isascii() and text[at].isalnum())


def count_terms(text: str, automaton: ahocorasick.Automaton, strict: int = STRICT) -> tuple[int, int]:
    """Different strict and soft terms that stand between boundaries in ``text``."""
    hard, soft = set(), set()
    if len(automaton):
        for last, (term, weight) in automaton.iter(text):
            if _bounded(text, last + 1) and _bounded(text, last - len(term)):
                (hard if weight >= strict else soft).add(term)
    return len(hard), len(soft)


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else null.  Of equal texts the first counts."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, rule_verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(rule_verdict)).otherwise(verdict)
    return name, verdict


def filter_urls(df: DataFrame, key: str = "page_id", url: str = "url", vocabulary: Mapping[str, int] = VOCABULARY,
                rules: Sequence[tuple[str, str, str]] = RULES, soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """Verdict of every row: ``key``, ``host``, ``path``, ``rule``, ``verdict``, ``n_strict``, ``n_soft``."""
    vocabulary = dict(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(vocabulary)
        for batch in batches:
            found = [count_terms(text, automaton) for text in batch.column("_lowered").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(name) for name in ("_key", "host", "path")),
                 pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.int32())],
                names=["_key", "host", "path", "n_strict", "n_soft"])

    kind = df.schema[key].dataType.simpleString()
    parts = df.select(F.col(key).alias("_key"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    lowered = F.translate(F.concat("host", "path"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counted = parts.withColumn("_lowered", lowered).mapInArrow(
        count, f"_key {kind}, host string, path string, n_strict int, n_soft int")
    name, by_rule = rule_for(F.col("host"), F.col("path"), rules)
    by_terms = F.when((F.col("n_strict") >= 1) | (F.col("n_soft") >= soft_limit), "block").otherwise("allow")
    return counted.select(F.col("_key").alias(key), "host", "path", name.alias("rule"),
                          F.coalesce(by_rule, by_terms).alias("verdict"), "n_strict", "n_soft")


def oracle(vocabulary: Mapping[str, int] = VOCABULARY, rules: Sequence[tuple[str, str, str]] = RULES,
           soft_limit: int = SOFT_LIMIT) -> str:
    """The same result in DuckDB SQL, each term as a pattern of its own."""
    def hits(terms: list[str]) -> str:
        return " + ".join(f"CAST(regexp_matches(t, '(^|[^a-z0-9]){term}($|[^a-z0-9])') AS INT)" for term in terms) or "0"

    strict = hits([t for t, w in vocabulary.items() if w >= STRICT])
    soft = hits([t for t, w in vocabulary.items() if w < STRICT])
    ordered = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    fits = [(f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))", h + p, v) for h, p, v in ordered]
    name = " ".join(f"WHEN {when} THEN '{text}'" for when, text, _ in fits)
    verdict = " ".join(f"WHEN {when} THEN '{v}'" for when, _, v in fits)
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
    WITH parts AS (
      SELECT page_id, {low.format("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")} AS host,
             coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
    lowered AS (SELECT *, {low.format("host || path")} AS t FROM parts),
    counted AS (SELECT page_id, host, path, {strict} AS n_strict, {soft} AS n_soft FROM lowered)
    SELECT page_id, host, path, CASE {name} END AS rule,
           CASE {verdict} WHEN n_strict >= 1 OR n_soft >= {soft_limit} THEN 'block' ELSE 'allow' END AS verdict,
           n_strict, n_soft
    FROM counted"""
