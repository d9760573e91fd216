"""Vocabularies of room names and watermarks as tables of terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A vocabulary is a setting that travels with the plan; more terms are an error.
MOST_TERMS = 50_000


def _listed(terms: DataFrame) -> list[tuple[str, str]]:
    rows = terms.filter("term is not null and trim(term) <> ''").select(F.coalesce("lang", F.lit("")).alias("lang"), F.trim("term").alias("term")).distinct()
    found = rows.orderBy("lang", "term").limit(MOST_TERMS + 1).collect()
    if len(found) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms")
    return [(r["lang"], r["term"]) for r in found]


def vocabulary(terms: DataFrame) -> dict[str, list[str]]:
    """``english`` and ``korean`` terms, as the room rules take them, from a table (lang, term); ``ko`` is Korean, any other language counts as English.

    Null and blank terms are left out, repeated ones count once.
    """
    found = _listed(terms)
    return {"english": [t for lang, t in found if lang != "ko"], "korean": [t for lang, t in found if lang == "ko"]}


def watermarks(terms: DataFrame) -> list[str]:
    """Watermark terms, in lower case, of a table (term)."""
    return sorted({t.lower() for _, t in _listed(terms.select(F.lit("").alias("lang"), "term"))})
