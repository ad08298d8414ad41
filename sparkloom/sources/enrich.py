"""Metadata enrichment over HTTP, and edges from shared subjects."""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import clean
from sparkloom.sources.dumps import WORK_PREFIX

#: Requests per second of all tasks together, and attempts of one request.
RATE, ATTEMPTS = 10.0, 3
YEAR = r"(1[0-9]{3}|20[0-9]{2})"

#: (status, body) of a GET.
Transport = Callable[[str], tuple[int, str]]


def http_get(url: str) -> tuple[int, str]:
    try:
        with urllib.request.urlopen(url, timeout=10) as answer:
            return answer.status, answer.read().decode()
    except urllib.error.HTTPError as error:
        return error.code, ""


def publish_year(text: object) -> int | None:
    found = re.search(YEAR, str(text)) if text is not None else None
    return int(found[1]) if found else None


def parse_edition(payload: object, isbn13: str | None = None) -> dict | None:
    """Fields of an edition document; without a title, nothing."""
    title = str(payload.get("title") or "").strip() if isinstance(payload, dict) else ""
    if not title:
        return None
    key = str(payload.get("key") or "").strip().rsplit("/", 1)[-1] or None
    isbns = [str(x).strip() for x in payload.get("isbn_13") or () if str(x).strip()]
    own = isbn13 or (isbns[0] if isbns else None)
    return {
        "work_id": WORK_PREFIX["openlibrary"] + (key or isbn13 or title), "title": title, "year": publish_year(payload.get("publish_date")), "isbn13": own,
        "openlibrary_id": key, "subjects": [str(s).strip() for s in payload.get("subjects") or () if str(s).strip()],
    }


def fetch(transport: Transport, base_url: str, isbn: str, pause: float) -> dict | None:
    """One edition: server errors are tried again, a missing or refused one is nothing."""
    for attempt in range(ATTEMPTS):
        time.sleep(pause)
        try:
            status, body = transport(f"{base_url}/isbn/{isbn}.json")
        except OSError:
            status, body = 599, ""
        if status == 200:
            return parse_edition(json.loads(body), isbn)
        if status < 500:
            return None
        pause = max(pause, 0.05) * 2
    return None


class EnrichmentSource:
    """Fills gaps of known books; it has no corpus of its own."""

    name = "openlibrary"

    def __init__(self, base_url: str = "https://openlibrary.org", transport: Transport = http_get, rate: float = RATE, tasks: int = 2):
        self.base_url, self.transport, self.rate, self.tasks = base_url.rstrip("/"), transport, rate, tasks

    def books(self, spark: SparkSession) -> DataFrame:
        raise NotImplementedError("there is no bulk corpus; use enrich()")

    def edges(self, spark: SparkSession) -> DataFrame:
        raise NotImplementedError("there are no edges; use subject_edges()")

    def fetch_many(self, isbns: DataFrame) -> DataFrame:
        """Editions of ``isbns(isbn13)``; ``tasks`` tasks share the request rate."""
        transport, base_url, pause = self.transport, self.base_url, self.tasks / self.rate if self.rate > 0 else 0.0
        schema = "work_id string, title string, year int, isbn13 string, openlibrary_id string, subjects array<string>"

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                found = [x for isbn in rows["isbn13"] if (x := fetch(transport, base_url, isbn, pause))]
                out = pd.DataFrame(found, columns=[c.split()[0] for c in schema.split(", ")])
                yield out.astype({"year": "Int32"})

        return isbns.select("isbn13").where("isbn13 is not null").distinct().repartition(self.tasks).mapInPandas(run, schema)

    def enrich(self, books: DataFrame, limit: int | None = None) -> DataFrame:
        """``books`` with year, subjects and openlibrary_id filled where they were missing."""
        gaps = books.where("isbn13 is not null and (year is null or subjects is null or size(subjects) = 0)")
        if limit is not None:
            gaps = gaps.orderBy(F.desc_nulls_last("ratings_count"), "work_id").limit(limit)
        got = self.fetch_many(gaps).select("isbn13", F.col("year").alias("_year"), F.col("subjects").alias("_subjects"), F.col("openlibrary_id").alias("_id"))
        joined = books.join(gaps.select("work_id", F.lit(True).alias("_gap")), "work_id", "left").join(got, "isbn13", "left")
        use = F.col("_gap").isNotNull()
        filled = {
            "year": F.coalesce("year", F.when(use, F.col("_year"))),
            "subjects": F.when(F.coalesce(F.size("subjects"), F.lit(0)) > 0, F.col("subjects")).otherwise(F.coalesce(F.when(use, F.col("_subjects")), "subjects")),
            "openlibrary_id": F.coalesce("openlibrary_id", F.when(use, F.col("_id"))),
        }
        return joined.withColumns(filled).select(books.columns)


def subject_edges(books: DataFrame, min_shared: int = 2, max_subject_size: int = 200) -> DataFrame:
    """Edges of rank 1 between ``books(work_id, subjects)`` that share so many subjects.

    Subjects of more than ``max_subject_size`` or fewer than two books say nothing; the bound also
    keeps the pairs of one subject bounded."""
    held = books.select("work_id", F.explode(F.array_distinct(clean.texts(F.col("subjects")))).alias("subject")).distinct()
    sizes = held.groupBy("subject").count().where(F.col("count").between(2, max_subject_size)).select("subject")
    kept = held.join(sizes, "subject")
    pairs = kept.alias("a").join(kept.alias("b"), "subject").where("a.work_id < b.work_id")
    shared = pairs.groupBy(F.col("a.work_id").alias("src"), F.col("b.work_id").alias("dst")).count().where(F.col("count") >= min_shared)
    return shared.select("src", "dst", F.lit("ol_subject").alias("kind"), F.lit(1).alias("rank"), F.lit("openlibrary").alias("source"))
