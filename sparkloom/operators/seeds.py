"""Resolve typed titles onto works by fuzzy score."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.fuzzy import weighted_ratio
from sparkloom.functions.identity import author_key, title_key
from sparkloom.operators.store import search_titles

#: Share of the gap to 1 that a named author closes, shortest author token that counts.
AUTHOR_BONUS, AUTHOR_TOKEN = 0.15, 3
THRESHOLD, MARGIN, NEAR = 0.75, 0.05, 5
SEARCH_LIMIT = 200


@dataclass(frozen=True)
class SeedMatch:
    query: str
    work_id: str | None = None
    title: str | None = None
    authors: tuple[str, ...] = ()
    confidence: float = 0.0
    alternatives: tuple[tuple[str, str], ...] = ()

    @property
    def resolved(self) -> bool:
        return self.work_id is not None


def label(title: str, authors: Sequence[str]) -> str:
    return " — ".join([title, *authors[:1]])


def seed_score(query_key: str, title: str | None, authors: Sequence[str] | None) -> float:
    """Score of one candidate from 0 to 1. Words that name its author are not held against the title."""
    asked = query_key.split()
    names = {t for a in (authors if authors is not None else ()) for t in author_key(a).split() if len(t) >= AUTHOR_TOKEN}
    rest = " ".join(t for t in asked if t not in names)
    base = weighted_ratio(rest or query_key, title_key(title)) / 100
    return base + AUTHOR_BONUS * (1 - base) if names.intersection(asked) else base


def resolve_seed(query: str, candidates: Iterable[tuple[str, str, Sequence[str]]], limit: int = NEAR, threshold: float = THRESHOLD, margin: float = MARGIN) -> SeedMatch:
    """The best of ``candidates(work_id, title, authors)``; equal scores go by their order, and near
    ones among the first ``limit`` are told as alternatives."""
    key = title_key(query)
    ranked = sorted(((seed_score(key, t, a), -i, w, t, tuple(a or ())) for i, (w, t, a) in enumerate(candidates)), reverse=True)
    if not ranked:
        return SeedMatch(query)
    best = ranked[0]
    if best[0] < threshold:
        return SeedMatch(query, confidence=best[0])
    near = tuple((w, label(t, a)) for s, _, w, t, a in ranked[:limit] if best[0] - s <= margin)
    return SeedMatch(query, best[2], best[3], best[4], min(best[0], 1.0), near if len(near) > 1 else ())


def candidates_of(query: str, books: DataFrame) -> list[tuple[str, str, list[str]]]:
    """Candidates in order: titles with the query; else with its words, the longest first; else the
    best ``SEARCH_LIMIT`` of all titles by score, which are scored where they lie."""

    def found(text: str) -> list[tuple[str, str, list[str]]]:
        rows = search_titles(books, text, SEARCH_LIMIT).select("work_id", "title", "authors").collect()
        return [(r["work_id"], r["title"], list(r["authors"] or ())) for r in rows]

    out = found(query)
    if not out:
        words = sorted(query.split(), key=len, reverse=True)
        out = list({row[0]: row for word in reversed(words) for row in reversed(found(word))}.values())[::-1] if words else []
    if not out:
        key = title_key(query)
        @F.pandas_udf("double")
        def score(titles: pd.Series, authors: pd.Series) -> pd.Series:
            return pd.Series([seed_score(key, t, a) for t, a in zip(titles, authors, strict=True)], dtype="float64")

        best = books.select("work_id", "title", "authors", score("title", "authors").alias("s")).orderBy(F.desc("s"), "work_id").limit(SEARCH_LIMIT)
        out = [(r["work_id"], r["title"], list(r["authors"] or ())) for r in best.collect()]
    return out


def resolve_seeds(queries: Sequence[str], books: DataFrame, threshold: float = THRESHOLD) -> tuple[list[SeedMatch], list[str]]:
    """Matches, and the queries without one."""
    found = [resolve_seed(q, candidates_of(q, books), threshold=threshold) for q in queries]
    return [m for m in found if m.resolved], [m.query for m in found if not m.resolved]
