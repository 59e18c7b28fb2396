"""Text and name expressions: all built-in, but for the sequence ratio, which needs the exact block matching."""

from __future__ import annotations

import math
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from loomstone.functions import words


def strings(values: Iterable[str]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def name_tokens(name) -> Column:
    """camelCase and snake_case parts, lower-cased, without empty ones."""
    return F.filter(F.split(F.lower(F.regexp_replace(name, "([a-z])([A-Z])", "$1_$2")), "_"), lambda t: t != "")


def name_domain(tokens) -> Column:
    out = F.lit("unknown")
    for domain, keys in reversed(words.NAME_DOMAINS.items()):
        out = F.when(F.arrays_overlap(tokens, strings(keys.split())), domain).otherwise(out)
    return out


def name_intent(tokens) -> Column:
    return F.when(F.arrays_overlap(tokens, strings(words.BUSINESS_WORDS)), "business").when(F.arrays_overlap(tokens, strings(words.GENERIC_WORDS)), "generic").otherwise("unknown")


def semantic_conflict(a, b) -> Column:
    """Whether two names (their tokens) stand for different things: domains, then intents, then business terms."""
    da, db, ia, ib = name_domain(a), name_domain(b), name_intent(a), name_intent(b)
    business = strings(words.BUSINESS_WORDS)
    terms = lambda t: F.array_sort(F.array_distinct(F.array_intersect(t, business)))
    return (
        F.when((da != db) & (da != "unknown") & (db != "unknown"), True)
        .when((ia == "business") & (ib == "generic") | (ia == "generic") & (ib == "business"), True)
        .when((ia == "business") & (ib == "business"), terms(a) != terms(b))
        .otherwise(False)
    )


TYPE_WORDS = ("int", "float", "str", "list", "dict", "bool")


def type_conflict(a, b, kinds: tuple[str, ...] = TYPE_WORDS) -> Column:
    """Whether one lower-cased name contains a type word that the other lacks."""
    return F.exists(strings(kinds), lambda k: F.contains(F.lower(a), k) != F.contains(F.lower(b), k))


def word_tokens(text) -> Column:
    """Lower-cased words without punctuation or stop words; repeats stay."""
    plain = F.regexp_replace(F.lower(text), "[^a-z0-9_ ]", " ")
    return F.filter(F.split(F.regexp_replace(plain, "_", " "), " +"), lambda t: (t != "") & ~t.isin(*words.STOP_WORDS))


def synonym_edges() -> list[tuple[str, str]]:
    """word -> what it expands to, in both directions, one hop."""
    pairs = {(k, v) for k, vs in words.SYNONYMS.items() for v in vs.split()}
    return sorted(pairs | {(b, a) for a, b in pairs})


def expand_synonyms(tokens) -> Column:
    """The distinct tokens and what they expand to, sorted."""
    more: dict[str, list[str]] = {}
    for a, b in synonym_edges():
        more.setdefault(a, []).append(b)
    table = F.create_map(*(x for k, vs in more.items() for x in (F.lit(k), strings(vs))))
    return F.array_sort(F.array_distinct(F.concat(tokens, F.flatten(F.transform(tokens, lambda t: F.coalesce(F.element_at(table, t), F.array().cast("array<string>")))))))


def overlap(a, b) -> Column:
    """|A and B| / max(|A|, |B|) over distinct elements; 0 if one is empty. Not rounded."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b)))


def lexical_score(a, b) -> Column:
    """0.7 * keyword overlap + 0.3 * action overlap, over expanded tokens."""
    ea, eb, actions = expand_synonyms(a), expand_synonyms(b), strings(words.ACTION_WORDS)
    return overlap(ea, eb) * 0.7 + overlap(F.array_intersect(ea, actions), F.array_intersect(eb, actions)) * 0.3


def level(score, high: float, medium: float) -> Column:
    return F.when(score >= high, "HIGH").when(score >= medium, "MEDIUM").otherwise("LOW")


def cosine(a, b) -> Column:
    """Cosine of two numeric arrays; 0 where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def primary_action(tokens) -> Column:
    found = F.filter(tokens, lambda t: t.isin(*words.PURPOSE_ACTIONS))
    return F.coalesce(F.get(found, 0), F.lit("unknown"))


def business_domain(tokens) -> Column:
    """Most keyword hits (repeats counted), the first listed of equals; a recovery rule comes first."""
    has = lambda *ws: F.arrays_overlap(tokens, strings(ws))

    def hits_of(keys: str) -> Column:
        return F.size(F.filter(tokens, lambda t: t.isin(*keys.split())))

    hits = F.array(*(F.struct(hits_of(keys).alias("n"), F.lit(-i).alias("rank"), F.lit(d).alias("domain")) for i, (d, keys) in enumerate(words.PURPOSE_DOMAINS.items())))
    best = F.array_max(hits)
    return F.when(has("restore", "recover") & has("backup", "database"), "recovery_operations").when(best["n"] > 0, best["domain"]).otherwise("general")


def side_effects(code) -> Column:
    """Side effects told by substrings, repeats included; recovery and security only count where something is written."""
    low = F.lower(code)
    any_of = lambda *ws: F.lit(False) if not ws else F.coalesce(low.rlike("|".join(ws)), F.lit(False))
    one = lambda cond, name: F.when(cond, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    stored = any_of("write", "save")
    return F.concat(
        one(F.contains(code, F.lit(".restore(")) | F.contains(code, F.lit(".rollback(")), "system_recovery"),
        one(any_of("backup"), "system_recovery"),
        one(any_of("commit"), "database_commit"),
        one(any_of("send", "email"), "notification_dispatch"),
        one(stored, "persistent_storage"),
        one(stored & any_of("rollback", "restore", "recover"), "system_recovery"),
        one(stored & any_of("authenticate", "authorize", "verify"), "security_validation"),
    )


def purpose_confidence(action, domain, effects) -> Column:
    return F.lit(0.5) + F.when(action != "unknown", 0.2).otherwise(0.0) + F.when(domain != "general", 0.2).otherwise(0.0) + F.when(F.size(effects) > 0, 0.1).otherwise(0.0)


def strip_sql_comments(source) -> Column:
    return F.regexp_replace(F.regexp_replace(source, r"--[^\n]*", " "), r"(?s)/\*.*?\*/", " ")


def strip_block_comments(source) -> Column:
    """// and /* */ comments of Go, C and C#."""
    return F.regexp_replace(F.regexp_replace(source, r"(?s)/\*.*?\*/", " "), r"//[^\n]*", "")


def sql_name(name) -> Column:
    return F.element_at(F.split(F.lower(F.trim(name)), r"\."), -1)


def quality_points(code) -> Column:
    """The score of a function's text: short ones get 4 (3 lines) or 2 (6 lines) points, others 1; a loop costs 3 and
    an accumulation 2; at most one equals sign adds 2. Empty lines count, a last line break adds none."""
    body = F.regexp_replace(F.regexp_replace(code, "\r\n?", "\n"), "\n$", "")
    lines = F.when(F.length(code) == 0, 0).otherwise(F.size(F.split(body, "\n")))
    score = F.when(lines <= 3, 4).when(lines <= 6, 2).otherwise(1)
    score = score - F.when(F.contains(code, F.lit("for ")), 3).otherwise(0) - F.when(F.contains(code, F.lit("+=")), 2).otherwise(0)
    return score + F.when(F.length(code) - F.length(F.replace(code, F.lit("="), F.lit(""))) <= 1, 2).otherwise(0)


def rounded_cut(least: float, digits: int = 2) -> float:
    """The smallest number that Python rounds to `least` or more: a comparison with it is one with the rounded value."""
    x = least - 0.5 * 10**-digits
    while round(x, digits) >= least:
        x = math.nextafter(x, -math.inf)
    while round(x, digits) < least:
        x = math.nextafter(x, math.inf)
    return x


def lexical_level(score) -> Column:
    """The level of a lexical score that is not rounded yet."""
    return level(score, rounded_cut(0.75), rounded_cut(0.45))


def embedding_level(score) -> Column:
    """The level of a cosine that is not rounded yet."""
    return level(score, rounded_cut(0.8), rounded_cut(0.5))


def call_counts(text) -> Column:
    """All names directly before an opening bracket, for one pass over a text whatever the names asked for."""
    return F.regexp_extract_all(text, F.lit(r"\b(\w+)\("), 1)


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two texts, junk rule included; not symmetric."""
    from difflib import SequenceMatcher

    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def python_round(x: pd.Series, digits: pd.Series) -> pd.Series:
    """Rounds as binary floating point does: half to even on the exact value."""
    return pd.Series([None if pd.isna(v) else round(float(v), int(d)) for v, d in zip(x, digits, strict=True)], dtype="float64")
