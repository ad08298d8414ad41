"""Identity keys: titles, authors, ISBN, ASIN and work ids.

Accent folding has no SQL built-in, so title and author keys are Arrow-batched UDFs; the ISBN and
ASIN rules are column expressions.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Leading articles, and the patterns that delimit a title's decoration.
ARTICLES = ("a", "an", "the")
BRACKETED = r"[(\[][^)\]]*[)\]]?"
SUBTITLE = r"\s*(?::|\s[-–—]\s|--)"
ELIDED = r"['’ʼ]"
OTHER = r"[^a-z0-9]+"

_BRACKETED, _SUBTITLE, _ELIDED, _OTHER = map(re.compile, (BRACKETED, SUBTITLE, ELIDED, OTHER))


def folded(text: str) -> str:
    """Lower case without combining marks."""
    return "".join(filter(lambda c: not unicodedata.combining(c), unicodedata.normalize("NFKD", text.lower())))


def title_key(title: str | None) -> str:
    """Key of a title: no brackets, no subtitle (unless nothing else is left), no leading article."""
    bare = _BRACKETED.sub(" ", folded(title or ""))
    head = _SUBTITLE.split(bare, maxsplit=1)[0]
    words = _OTHER.sub(" ", _ELIDED.sub("", head if head.strip() else bare)).split()
    return " ".join(words[1:] if words[:1] and words[0] in ARTICLES else words)


def author_key(author: str | None) -> str:
    """Key of a name: "Last, First" turned round, initials without dots."""
    name = folded(author or "")
    if "," in name:
        last, first = name.split(",", 1)
        name = f"{first} {last}"
    return " ".join(_OTHER.sub(" ", name.replace(".", "")).split())


def work_key(title: str | None, authors: list[str] | None) -> str:
    """Work id of a title and its first author, readable and deterministic."""
    title = title_key(title)
    name = author_key(authors[0]) if authors is not None and len(authors) else ""
    slug = title.replace(" ", "-")[:48].strip("-")
    digest = hashlib.blake2b(f"{title}|{name}".encode(), digest_size=8).hexdigest()
    return "-".join(x for x in ("w", slug, digest) if x)


@F.pandas_udf(T.StringType())
def normalize_title(titles: pd.Series) -> pd.Series:
    return titles.map(title_key)


@F.pandas_udf(T.StringType())
def normalize_author(authors: pd.Series) -> pd.Series:
    return authors.map(author_key)


@F.pandas_udf(T.ArrayType(T.StringType()))
def normalize_authors(authors: pd.Series) -> pd.Series:
    return authors.map(lambda names: [author_key(n) for n in (names if names is not None else ())])


@F.pandas_udf(T.StringType())
def make_work_id(titles: pd.Series, authors: pd.Series) -> pd.Series:
    return pd.Series([work_key(t, a) for t, a in zip(titles, authors, strict=True)], index=titles.index)


def bare_isbn(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, r"[\s-]", ""))


def _weighted(digits: Column, weights: list[int]) -> Column:
    """Sum of the leading digits, X as 10, by weights."""
    terms = [F.when(F.substring(digits, i + 1, 1) == "X", 10).otherwise(F.substring(digits, i + 1, 1).try_cast("int")) * w for i, w in enumerate(weights)]
    return sum(terms[1:], terms[0])


def isbn13_check_digit(first12: Column) -> Column:
    """Check digit of 12 digits; null for other texts."""
    digits = F.regexp_replace(first12, r"[\s-]", "")
    total = _weighted(digits, [1, 3] * 6)
    return F.when(digits.rlike("^[0-9]{12}$"), F.pmod(-total, F.lit(10)).cast("string"))


def valid_isbn13(c: Column) -> Column:
    digits = bare_isbn(c)
    shaped = digits.rlike("^[0-9]{13}$") & ~digits.rlike("^0{12}.$")
    return F.coalesce(shaped & (isbn13_check_digit(F.substring(digits, 1, 12)) == F.substring(digits, 13, 1)), F.lit(False))


def isbn10_to_13(c: Column) -> Column:
    """ISBN-13 of a valid ISBN-10, else null; all zeros is no ISBN."""
    digits = bare_isbn(c)
    shaped = digits.rlike("^[0-9]{9}[0-9X]$") & ~digits.rlike("^0{9}.$")
    first12 = F.concat(F.lit("978"), F.substring(digits, 1, 9))
    right = F.pmod(_weighted(digits, list(range(10, 0, -1))), F.lit(11)) == 0
    return F.when(shaped & right, F.concat(first12, isbn13_check_digit(first12)))


def canonical_isbn(c: Column) -> Column:
    """Either ISBN as ISBN-13; anything else is null."""
    digits = bare_isbn(c)
    return F.when(F.length(digits) == 13, F.when(valid_isbn13(c), digits)).when(F.length(digits) == 10, isbn10_to_13(c))


def looks_like_asin(c: Column) -> Column:
    """Ten letters or digits that are not shaped like an ISBN-10."""
    text = F.upper(F.trim(c))
    return F.coalesce(text.rlike(r"^[\p{L}\p{N}]{10}$") & ~text.rlike("^[0-9]{9}[0-9X]$"), F.lit(False))
