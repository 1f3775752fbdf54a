"""Search over entities: by name, ranked with typing errors, by prefix, by id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.functions.keys import fold_accents
from facetry.operators import terms
from facetry.operators.ordering import page, page_stats
from facetry.operators.records import project_metadata


def name_search(entities: DataFrame, query: str, columns: Sequence[str], seq_col: str, limit: int | None = 8) -> DataFrame:
    """Case- and accent-insensitive substring of any column; the first hits in table order.  A blank query has no hits."""
    if not query.strip():
        return entities.where(F.lit(False))
    needle = fold_accents(F.lower(F.lit(query.strip())))
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(fold_accents(F.lower(F.col(c).cast("string"))), needle), F.lit(False))
    found = entities.where(hit)
    return found if limit is None else found.orderBy(seq_col).limit(limit)


def ranked_search(entities: DataFrame, query: str | None, fields: Sequence[str], id_col: str = "id") -> DataFrame:
    """All matches with their score: best field, fuzzy words.  An empty query matches every row.

    Fields are texts, lists of texts or score maps (their keys are searched).  Words are
    compared with the distinct terms of the table, not with every row; ids are unique.
    ``terms.SearchIndex`` keeps the dictionary for further queries.
    """
    words = _words(query)
    if not words:
        return entities.withColumn("score", F.lit(1.0))
    rows = terms.postings(entities, fields, id_col)
    near = terms.close_terms(rows.select("term").distinct(), words)
    return entities.join(terms.scores(rows.join(near, "term"), fields, words, id_col), id_col)


def _words(query: str | None) -> list[str]:
    out, word = [], ""
    for letter in (query or "").lower():
        if letter.isalnum():
            word += letter
        elif word:
            out.append(word)
            word = ""
    return out + ([word] if word else [])


def search_page(entities: DataFrame, query: str | None, fields: Sequence[str], limit: int = 10, offset: int = 0,
                includes: Sequence[str] | None = None, sort: Sequence[str] | None = None,
                id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """One page of matches (score, then id, unless ``sort`` names columns, ``-`` for descending) and its totals."""
    found = ranked_search(entities, query, fields, id_col)
    order = [F.desc(s[1:]) if s.startswith("-") else F.asc(s) for s in sort or []]
    order += [] if order else [F.desc("score")]
    rows = page(found, limit, offset, *order, F.col(id_col))
    if includes:
        rows = project_metadata(rows, [id_col, *[c for c in includes if c != id_col]])
    return rows, page_stats(found, limit, offset)


def prefix_search(entities: DataFrame, prefix: str, fields: Sequence[str]) -> DataFrame:
    """Rows with a word that starts with the whole prefix."""
    start = prefix.lower()
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.coalesce(F.exists(terms.tokens(F.col(f).cast("string")), lambda t: t.startswith(start)), F.lit(False))
    return entities.where(hit)


def get_by_id(entities: DataFrame, key, id_col: str = "id") -> DataFrame:
    return entities.where(F.col(id_col) == key)
