"""URL filters: host and path rules, and a weighted vocabulary.

An Aho-Corasick automaton finds the terms of a vocabulary in a URL; a hit counts if
no letter or digit touches it. Weights of distinct terms add up, and a URL is blocked
at the limit: by one strict term, or by several soft ones. A rule that fits decides
before the vocabulary does.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillflow.llm.staging import small_batches, table

#: (verdict, host and path), fixed values.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: One strict term is enough to block, of soft ones it takes LIMIT: English, German, French, Spanish, Italian and Portuguese.
STRICT = tuple(
    "bitches blackjack bordell camgirls casino casinos cialis escort escorts gambling hentai kasino milf onlinecasino porn porno pornos pornografia pornographie putas roulette sexcam sexcams sexshop "
    "slotmachine tragaperras viagra xvideos xxx".split()
)
SOFT = tuple(
    "ads adult apostas apuestas azar backlinks barato bet bets bettings billig bonus bono cheap coupons crack dating deals discount erotica erotik farm flirt followers free gewinnspiel giochi gratis gratuit "
    "jackpot keygen kostenlos kredit levitra loan loans loteria loterie lotterie lotto nude nudes payday pills poker prestamo promo rabatt replica scommesse slots spam spielautomaten torrent track warez wetten win".split()
)
LIMIT = 2
_LOWER = {c: c + 32 for c in range(65, 91)}
_ALNUM = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
SCHEMA = "page_id long, host string, path string, rule string, verdict string, n_strict long, n_soft long"


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path, both empty without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    host, slash, path = rest[:end].partition("/")
    return host.translate(_LOWER), slash + path


class Rules:
    """Rules by host; the longest one that fits wins."""

    def __init__(self, rules):
        self.by_host: dict[str, list[tuple[int, str, str, str]]] = {}
        for verdict, rule in rules:
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host, []).append((len(rule), rule, slash + path, verdict))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        best, at = None, 0
        while host:
            for n, rule, prefix, verdict in self.by_host.get(host[at:], ()):
                if path.startswith(prefix) and (best is None or n > best[0]):
                    best = n, rule, verdict
            dot = host.find(".", at)
            if dot < 0:
                break
            at = dot + 1
        return best and best[1:]


class Vocabulary:
    """Weighted terms; hits() gives the distinct terms of a text."""

    def __init__(self, weights: dict[str, int]):
        import ahocorasick

        self.weights, self.auto = weights, ahocorasick.Automaton()
        for term in weights:
            self.auto.add_word(term, term)
        if weights:
            self.auto.make_automaton()

    def hits(self, text: str) -> set[str]:
        if not self.weights:
            return set()
        found = set()
        for end, term in self.auto.iter(text):
            start = end - len(term)
            if (start < 0 or text[start] not in _ALNUM) and (end + 1 == len(text) or text[end + 1] not in _ALNUM):
                found.add(term)
        return found


def judge(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules=RULES, strict=STRICT, soft=SOFT, limit: int = LIMIT) -> DataFrame:
    """Per row: page_id, host, path, rule (or null), verdict, and the numbers of distinct strict and soft terms.

    A null or empty url, or one without ``://``, has an empty host and path, fits no rule
    and is judged by its terms. Of rules of the same length the first in ``rules`` wins.
    Urls count whole, however long. Ids may repeat or be null; other columns, whatever
    their names, aren't read; an empty table gives an empty result.
    """
    small_batches(pages.sparkSession)
    weights = {t: 1 for t in soft} | {t: limit for t in strict}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, words = Rules(rules), Vocabulary(weights)
        for batch in batches:
            rows = []
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                rule = known.find(host, path)
                hits = words.hits((url or "").translate(_LOWER))
                verdict = rule[1] if rule else "block" if sum(weights[t] for t in hits) >= limit else "allow"
                strong = sum(weights[t] >= limit for t in hits)
                rows.append((host, path, rule and rule[0], verdict, strong, len(hits) - strong))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string() if i < 4 else pa.int64()) for i, c in enumerate(cols))], ["page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url")).mapInArrow(run, SCHEMA)


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on every url of ``pages``."""
    return judge(table(spark, sf_dir, "pages"))


def _terms(terms) -> str:
    return " + ".join(f"CAST(regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') AS BIGINT)" for t in terms)


def _fits(rule: str) -> str:
    host, _, path = rule.partition("/")
    return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')"


_LONGEST = sorted(RULES, key=lambda r: -len(r[1]))
ORACLE = f"""
WITH cut AS (
  SELECT page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, low, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), counted AS (
  SELECT *, {_terms(STRICT)} AS n_strict, {_terms(SOFT)} AS n_soft,
         CASE {' '.join(f"WHEN {_fits(r)} THEN '{r}'" for _, r in _LONGEST)} END AS rule FROM parts
)
SELECT page_id, host, path, rule,
       CASE rule {' '.join(f"WHEN '{r}' THEN '{v}'" for v, r in _LONGEST)}
            ELSE CASE WHEN n_strict >= 1 OR n_soft >= {LIMIT} THEN 'block' ELSE 'allow' END END AS verdict,
       n_strict, n_soft FROM counted
"""
