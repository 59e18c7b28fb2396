"""URL filter: a weighted vocabulary counted by an Aho-Corasick automaton, overruled by host and path rules.

A term counts only where it stands between characters that are no ASCII letters or digits. One strict term rejects a url, and
so do several distinct soft terms whose weights reach `soft_limit`. Rules of (host, path) come first: a rule fits its
host and all subdomains where the url's path starts with the rule's path, and the longest fitting rule decides.

Defined cases: a null url, or one without `://`, has an empty host and path, fits no rule and is judged by the
vocabulary alone (null: allowed); a url of any length is read whole. Of equally long rules that fit, the smaller rule
string decides, then the one named first. Repeated rows give repeated rows. Extra columns of the input are ignored, whatever
their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Terms that reject alone.
STRICT = ("casino", "porn", "porno", "xxx", "viagra", "cialis", "spam", "malware", "phishing", "warez", "escort", "hentai")
#: Terms with the weight that each distinct one adds; 3: rarely seen on other pages, 1: common there too.
SOFT = {
    "betting": 3, "jackpot": 3, "lottery": 3, "poker": 3, "slots": 3, "pharmacy": 3, "pills": 3, "replica": 3, "torrent": 3, "crack": 3, "sex": 3,
    "adult": 2, "ads": 2, "bet": 2, "bets": 2, "bonus": 2, "dating": 2, "loan": 2, "loans": 2, "pill": 2, "tracker": 2, "winner": 2, "cheap": 2, "discount": 2,
    "ad": 1, "click": 1, "deals": 1, "farm": 1, "free": 1, "sale": 1, "track": 1, "win": 1,
}
SOFT_LIMIT = 3
#: Terms of a vocabulary table, which is collected: more are refused.
MAX_TERMS = 1_000_000

OUT = "page_id long, host string, path string, rule string, verdict string, strict_hits long, soft_hits long, soft_weight long"
_LOWER = {i: i + 32 for i in range(65, 91)}
_TERM_CHARS = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url; both empty without `://`."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    ends = [i for i in map(rest.find, "?#") if i >= 0]
    rest = rest[: min(ends)] if ends else rest
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


def longest_rule(host: str, path: str, rules: list[tuple[str, str, str]]) -> tuple[str, str] | None:
    """(rule string, verdict) of the longest rule that fits; of equally long ones, the smaller string."""
    best = None
    for rule_host, rule_path, verdict in rules:
        if host and path.startswith(rule_path) and (host == rule_host or host.endswith("." + rule_host)):
            rank = (-len(rule_host + rule_path), rule_host + rule_path)
            if best is None or rank < best[0]:
                best = (rank, rule_host + rule_path, verdict)
    return best and best[1:]


def vocabulary(terms: DataFrame) -> tuple[tuple[str, ...], dict[str, int]]:
    """(strict terms, soft terms with weights) of a table (term, kind: strict or soft, weight); null terms are skipped.

    Terms are lower-cased; of a term's several weights the largest counts.
    """
    term = F.lower(F.trim("term"))
    rows = terms.where("term IS NOT NULL AND trim(term) <> ''").groupBy(term.alias("term"), "kind").agg(F.coalesce(F.max("weight"), F.lit(1)).cast("long").alias("weight")).limit(MAX_TERMS + 1).collect()
    if len(rows) > MAX_TERMS:
        raise ValueError(f"the vocabulary has over {MAX_TERMS} terms")
    return tuple(sorted(r["term"] for r in rows if r["kind"] == "strict")), {r["term"]: r["weight"] for r in sorted(rows) if r["kind"] == "soft"}


def automaton(strict: tuple[str, ...], soft: dict[str, int]):
    import ahocorasick

    made = ahocorasick.Automaton()
    for term in {*strict, *soft}:
        made.add_word(term, term)
    made.make_automaton()
    return made


def term_hits(url: str, made) -> set[str]:
    """The distinct terms that stand between boundaries in the lower-cased url."""
    low, found = url.translate(_LOWER), set()
    for end, term in made.iter(low):
        start = end - len(term) + 1
        if (start == 0 or low[start - 1] not in _TERM_CHARS) and (end + 1 == len(low) or low[end + 1] not in _TERM_CHARS):
            found.add(term)
    return found


def filter_urls(
    pages: DataFrame,
    rules: list[tuple[str, str, str]] = (),
    strict: tuple[str, ...] = STRICT,
    soft: dict[str, int] | None = None,
    soft_limit: int = SOFT_LIMIT,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """A verdict for each row: page_id, host, path, rule, verdict, and what the vocabulary counted."""
    weights = dict(SOFT if soft is None else soft)
    strict, rules = tuple(strict), list(rules)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = automaton(strict, weights)
        names = ["page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_hits", "soft_weight"]
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            for key, url in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                host, path = split_url(url)
                hits = term_hits(url or "", made)
                hard = sum(t in strict for t in hits)
                light = [t for t in hits if t not in strict]
                weight = sum(weights[t] for t in light)
                rejected = hard > 0 or (len(light) > 1 and weight >= soft_limit)
                rule, verdict = longest_rule(host, path, rules) or (None, "block" if rejected else "allow")
                for col, value in zip(cols, (key, host, path, rule, verdict, hard, len(light), weight), strict=True):
                    col.append(value)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url")).mapInArrow(judge, OUT)
