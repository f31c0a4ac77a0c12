"""URL filter: a weighted vocabulary found by Aho-Corasick with boundary checks, beneath allow and block rules."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache, partial

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path): the host and all its subdomains, where the path begins so.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Terms of which one rejects.
STRICT = (
    "1xbet", "bestiality", "bukkake", "camgirl", "camgirls", "carding", "casino", "casinos", "creampie", "darknetmarket", "deepthroat", "escorts", "fakeid", "fullz", "gangbang", "hardcore",
    "hentai", "keylogger", "livesex", "malware", "milf", "onlyfans", "phishing", "porn", "porno", "pornhub", "ransomware", "roulette", "sexcam", "sexshop", "slotmachine", "sportsbook",
    "swinger", "tramadol", "viagra", "warez", "webcamsex", "xhamster", "xnxx", "xvideos", "xxx",
)
#: Terms of which several distinct ones do, with their weights.
SOFT = {
    "adult": 2, "amateur": 1, "babes": 2, "bet": 1, "betting": 2, "bingo": 2, "bitcoin": 1, "bonus": 1, "buynow": 1, "cam": 1, "cheap": 1, "cheat": 1, "cialis": 2, "cracked": 2, "crack": 2,
    "dating": 1, "deal": 1, "diet": 1, "discount": 1, "download": 1, "erotic": 2, "escort": 2, "forex": 2, "free": 1, "fuck": 2, "gamble": 2, "gambling": 2, "girls": 1, "hack": 1, "hot": 1,
    "jackpot": 2, "keygen": 2, "kinky": 2, "lingerie": 2, "loan": 1, "loans": 2, "lottery": 2, "mature": 1, "naked": 2, "nude": 2, "nudes": 2, "payday": 2, "pharmacy": 1, "pills": 2, "pirate": 1,
    "poker": 2, "promo": 1, "replica": 2, "serial": 1, "sex": 2, "sexy": 2, "slots": 2, "spam": 1, "streaming": 1, "torrent": 1, "torrents": 2, "unlock": 1, "vip": 1, "weightloss": 2, "win": 1, "xrated": 2,
}
#: Distinct soft terms, and weight of them together, that reject; weight of a strict term in the score.
SOFT_HITS, SOFT_WEIGHT, STRICT_WEIGHT = 2, 3, 10
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@lru_cache(maxsize=4)
def _automaton(terms: tuple[str, ...]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for i, term in enumerate(terms):
        found.add_word(term, i)
    found.make_automaton()
    return found


def _bounded(text: str, begin: int, end: int) -> bool:
    """Neither neighbour is an ASCII letter or digit."""
    return not any(c.isascii() and c.isalnum() for c in text[max(0, begin - 1) : begin] + text[end : end + 1])


def _count(batches: Iterator[pa.RecordBatch], strict: tuple[str, ...], soft: tuple[tuple[str, int], ...]) -> Iterator[pa.RecordBatch]:
    terms = (*strict, *(term for term, _ in soft))
    automaton = _automaton(terms) if terms else None
    fold = str.maketrans(_UPPER, _LOWER)
    for batch in batches:
        n_strict, n_soft, score = [], [], []
        for url in batch.column(0).to_pylist():
            low = (url or "").translate(fold)
            hits = {i for end, i in automaton.iter(low) if _bounded(low, end + 1 - len(terms[i]), end + 1)} if automaton and low else set()
            hard = sum(i < len(strict) for i in hits)
            n_strict.append(hard)
            n_soft.append(len(hits) - hard)
            score.append(sum(STRICT_WEIGHT if i < len(strict) else soft[i - len(strict)][1] for i in hits))
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.int64()) for x in (n_strict, n_soft, score))], [*batch.schema.names, "strict_terms", "soft_terms", "score"])


def _first(rules: Sequence[tuple[str, str, str]], host: Column, path: Column, value) -> Column:
    """``value(rule)`` of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]))):
        fits = ((host == rule[1]) | host.endswith(f".{rule[1]}")) & path.startswith(rule[2])
        out = F.when(fits, F.lit(value(rule))).otherwise(out)
    return out


def vocabulary(terms: DataFrame) -> tuple[tuple[str, ...], dict[str, int]]:
    """(strict, soft) of a table of term and weight: from ``STRICT_WEIGHT`` on a term is strict.

    Such lists are short (a term is a word), so they come to the driver. Null and empty terms and null weights are
    left out; of a term that repeats the greatest weight counts; A-Z count as a-z.
    """
    rows = terms.where("term <> '' and weight is not null").groupBy(F.translate("term", _UPPER, _LOWER).alias("term")).agg(F.max(F.col("weight").cast("int")).alias("weight")).orderBy("term").collect()
    return tuple(r["term"] for r in rows if r["weight"] >= STRICT_WEIGHT), {r["term"]: r["weight"] for r in rows if r["weight"] < STRICT_WEIGHT}


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    strict: Sequence[str] = STRICT,
    soft: dict[str, int] = SOFT,
    soft_hits: int = SOFT_HITS,
    soft_weight: int = SOFT_WEIGHT,
    page_id: str = "page_id",
    url: str = "url",
) -> DataFrame:
    """Judge every url: page_id, host, path, rule (null: none fits), verdict, and the counts behind it.

    The longest fitting rule decides. Else a url is blocked for one strict term, or for ``soft_hits`` distinct
    soft ones that weigh ``soft_weight`` together; a term counts where no ASCII letter or digit touches it, A-Z
    counting as a-z, once a url. ``strict_terms``, ``soft_terms`` and ``score`` (sum of weights) are those of the
    whole url. ``strict`` and ``soft`` take another vocabulary; ``vocabulary`` reads one from a table.

    A null url, or one without ``://``, has an empty host and path and no rule; its terms count all the same.
    Null ids are passed on, repeated rows judged alike; other columns are ignored, whatever their names. An
    empty table gives an empty result. Urls of any length are read whole.
    """
    kept = pages.select(F.col(url).cast("string").alias("url"), F.col(page_id).cast("long").alias("page_id"))
    counted = kept.mapInArrow(partial(_count, strict=tuple(strict), soft=tuple(soft.items())), "url string, page_id long, strict_terms long, soft_terms long, score long")
    address = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    whole = F.coalesce("url", F.lit(""))
    parts = counted.withColumn("host", F.translate(F.regexp_extract(whole, address, 1), _UPPER, _LOWER)).withColumn("path", F.regexp_extract(whole, address, 2))
    several = (F.col("soft_terms") >= soft_hits) & (F.col("score") >= soft_weight)
    verdict = F.when((F.col("strict_terms") > 0) | several, "block").otherwise("allow")
    return parts.select(
        "page_id",
        "host",
        "path",
        _first(rules, F.col("host"), F.col("path"), lambda r: r[1] + r[2]).alias("rule"),
        F.coalesce(_first(rules, F.col("host"), F.col("path"), lambda r: r[0]), verdict).alias("verdict"),
        "strict_terms",
        "soft_terms",
        "score",
    )
