"""Fuzzy search and tagging by rules, as columns.

A candidate text scores if the query's characters occur in it in order, the leftmost ones being taken: 10 for each,
6 more at a boundary (the start, or behind a dash, an underscore, a space or a digit), 4 more right behind the one
before. The start counts as both. (These are fixed values.)
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import PathError, resolve
from ..functions.values import fitting, java_regex, literal

MATCH, BOUNDARY, NEXT = 10, 6, 4
BEHIND = "-_ 0123456789"
#: Tags are bits of a long.
MOST_TAGS = 63


@dataclass(frozen=True)
class FuzzyField:
    path: str
    weight: float = 1


@dataclass(frozen=True)
class Fuzzy:
    fields: tuple[FuzzyField, ...]
    min_score: float = 0
    require_all: bool = True
    #: score, scoreThenOrder (the same) or existing.
    order: str = "score"
    normalize: Callable[[Column], Column] = field(default=F.lower, compare=False)

    @classmethod
    def of(cls, fields: Iterable, **options) -> Fuzzy:
        made = tuple(x if isinstance(x, FuzzyField) else FuzzyField(x) if isinstance(x, str) else FuzzyField(**x) for x in fields)
        if not made:
            raise ValueError("fuzzy search needs a field")
        out = cls(made, **options)
        if out.order not in ("score", "scoreThenOrder", "existing"):
            raise ValueError("order is score, scoreThenOrder or existing")
        return out


@dataclass(frozen=True)
class Rule:
    """One of the tests decides, the first that is given; any candidate may pass it."""

    tag: str
    path: str
    equals: object = None
    in_: tuple | None = None
    contains: str | None = None
    starts_with: str | None = None
    ends_with: str | None = None
    matches: str | re.Pattern | None = None
    flags: str = ""


@dataclass(frozen=True)
class Tagger:
    tags: tuple[str, ...]
    rules: tuple[Rule, ...]
    normalize: Callable[[Column], Column] = field(default=F.lower, compare=False)

    @classmethod
    def of(cls, tags: Iterable[str], rules: Iterable, **options) -> Tagger:
        out = cls(tuple(tags), tuple(r if isinstance(r, Rule) else Rule(**r) for r in rules), **options)
        if len(out.tags) > MOST_TAGS:
            raise ValueError(f"more than {MOST_TAGS} tags")
        return out

    def bits(self, names: Iterable[str]) -> int:
        """Unknown names have no bit."""
        return sum(1 << self.tags.index(n) for n in set(names) if n in self.tags)


@dataclass(frozen=True)
class Search:
    """What one call asks for; of several, the last one for each of the two kinds counts."""

    query: str | None = None
    min_score: float | None = None
    by_tags: bool = False
    has: int = 0
    has_any: int = 0
    none_of: int = 0


def tags_of(tagger: Tagger | None, has: Iterable[str] = (), has_any: Iterable[str] = (), not_: Iterable[str] = (), not_any: Iterable[str] = ()) -> Search:
    if tagger is None:
        raise ValueError("configure the tagger before asking for tags")
    return Search(by_tags=True, has=tagger.bits(has), has_any=tagger.bits(has_any), none_of=tagger.bits(not_) | tagger.bits(not_any))


def search_of(what: str | list | tuple | dict, fuzzy: Fuzzy | None, tagger: Tagger | None) -> Search:
    if fuzzy is None and tagger is None:
        raise ValueError("configure fuzzy search or the tagger before searching")
    if isinstance(what, str):
        if fuzzy is None:
            raise ValueError("configure fuzzy search before searching for a text")
        return Search(query=what or None)
    if isinstance(what, (list, tuple)):
        return tags_of(tagger, has_any=what)
    out = tags_of(tagger, **what["tags"]) if what.get("tags") else Search()
    if (asked := what.get("fuzzy")) is not None:
        if fuzzy is None:
            raise ValueError("configure fuzzy search before searching for a text")
        asked = {"query": asked} if isinstance(asked, str) else asked
        out = Search(asked.get("query", ""), asked.get("min_score"), out.by_tags, out.has, out.has_any, out.none_of)
    return out


def folded(searches: Iterable[Search]) -> Search:
    out = Search()
    for s in searches:
        if s.query is not None:
            out = Search(s.query, s.min_score, out.by_tags, out.has, out.has_any, out.none_of)
        if s.by_tags:
            out = Search(out.query, out.min_score, True, s.has, s.has_any, s.none_of)
    return out


def subsequence_pattern(query: str) -> str:
    """A pattern without backtracking for texts that hold the query's characters in order."""
    return "^" + "".join(f"[^\\x{{{ord(c):x}}}]*+\\x{{{ord(c):x}}}" for c in query)


def subsequence_score(text: Column, query: Column, characters: Column) -> Column:
    """The score of one normalised text."""
    start = F.struct(F.lit(0).alias("score"), F.lit(-1).alias("last"), F.lit(0).alias("used"), F.lit(0).alias("at"), F.lit("").alias("before"))

    def take(s: Column, c: Column) -> Column:
        hit = F.coalesce(c == F.get(characters, s["used"]), F.lit(False))
        boundary = (s["at"] == 0) | F.lit(BEHIND).contains(s["before"])
        gain = F.lit(MATCH) + F.when(boundary, BOUNDARY).otherwise(0) + F.when(s["last"] == s["at"] - 1, NEXT).otherwise(0)
        return F.struct(
            F.when(hit, s["score"] + gain).otherwise(s["score"]).alias("score"),
            F.when(hit, s["at"]).otherwise(s["last"]).alias("last"),
            F.when(hit, s["used"] + 1).otherwise(s["used"]).alias("used"),
            (s["at"] + 1).alias("at"),
            c.alias("before"),
        )

    done = F.size(characters)
    scored = F.aggregate(F.split(text, ""), start, take, lambda s: F.when(s["used"] == done, s["score"]).otherwise(0))
    # Most texts lack a character; they are told apart without a walk.
    return F.when(F.rlike(text, query), scored).otherwise(0)


def normalised(query: str, normalize: Callable[[Column], Column]) -> str:
    """The query as the texts are normalised, for which Spark is asked."""
    return SparkSession.active().range(1).select(normalize(F.lit(query)).alias("q")).first()["q"] or ""


def score(fuzzy: Fuzzy, query: str, schema: T.StructType) -> Column:
    """The best weighted score over fields and candidates; 0 where nothing matches."""
    if not query:
        return F.lit(0.0)
    asked = query.lower() if fuzzy.normalize is F.lower else normalised(query, fuzzy.normalize)
    if not asked:
        return F.lit(0.0)
    pattern, characters = F.lit(subsequence_pattern(asked)), F.array(*[F.lit(c) for c in asked])
    best = [F.lit(0.0)]
    for x in fuzzy.fields:
        v = resolve(schema, x.path)
        if v.kind != "string":
            raise PathError(f"{x.path}: fuzzy search needs text")

        def one(c: Column) -> Column:
            return subsequence_score(fuzzy.normalize(c), pattern, characters)

        top = F.array_max(F.transform(v.listed(), one)) if v.many else one(v.col)
        best.append(F.coalesce(top, F.lit(0)).cast("double") * float(x.weight))
    return F.greatest(*best)


def rule_column(rule: Rule, normalize: Callable[[Column], Column], schema: T.StructType) -> Column:
    v = resolve(schema, rule.path)
    kind = v.kind

    def normal(s: str) -> Column:
        return normalize(F.lit(s))

    def test(c: Column) -> Column:
        if rule.equals is not None:
            return c == literal(rule.equals, v.type) if fitting((rule.equals,), v.type) else F.lit(False)
        if rule.in_ is not None:
            able = fitting(tuple(rule.in_), v.type)
            return c.isin([literal(x, v.type) for x in able]) if able else F.lit(False)
        if kind != "string":
            return F.lit(False)
        if rule.contains is not None:
            return F.contains(normalize(c), normal(rule.contains))
        if rule.starts_with is not None:
            return F.startswith(normalize(c), normal(rule.starts_with))
        if rule.ends_with is not None:
            return F.endswith(normalize(c), normal(rule.ends_with))
        if rule.matches is not None:
            return c.rlike(java_regex(rule.matches, rule.flags))
        return F.lit(False)

    return F.coalesce(v.some(test), F.lit(False))


def tag_mask(tagger: Tagger, schema: T.StructType) -> Column:
    """The tags of a row as bits; rules for unknown tags are ignored."""
    by_tag: dict[str, Column] = {}
    for r in tagger.rules:
        if r.tag in tagger.tags:
            c = rule_column(r, tagger.normalize, schema)
            by_tag[r.tag] = by_tag[r.tag] | c if r.tag in by_tag else c
    out = F.lit(0).cast("long")
    for tag, c in by_tag.items():
        out = out.bitwiseOR(F.when(c, F.lit(1 << tagger.tags.index(tag)).cast("long")).otherwise(F.lit(0).cast("long")))
    return out
