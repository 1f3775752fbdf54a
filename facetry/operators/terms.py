"""Term dictionary: distinct terms once, the rows that hold them, and terms within a few edits of a word.

Two words within d edits (a letter more, less or another, or two neighbours swapped) agree
after at most d letters are left out of each.  This holds for their first letters as well,
so a dictionary keyed by the beginnings of its terms with up to two letters left out finds
every candidate by an equi-join; the edit distance then runs once for a candidate term.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters of a term's beginning that make its keys; a key count of 1 + 7 + 21 whatever the term's length.
BEGINNING = 7
MOST_EDITS = 2


def allowed_edits(word: str) -> int:
    """AUTO fuzziness: exact up to 2 letters, one edit up to 5, two above."""
    return 0 if len(word) <= 2 else 1 if len(word) <= 5 else 2


def tokens(text: Column) -> Column:
    """Lower-case words of a text or key."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def field_tokens(entities: DataFrame, field: str) -> Column:
    """Distinct words of a field: a text, a list of texts, or the keys of a score map."""
    kind, value = entities.schema[field].dataType, F.col(field)
    if isinstance(kind, T.MapType):
        value = F.map_keys(value)
    elif not isinstance(kind, T.ArrayType):
        return F.array_distinct(tokens(value.cast("string")))
    # one pattern over all keys: they are joined by a blank, which parts words anyway
    return F.array_distinct(tokens(F.array_join(value, " ")))


def postings(entities: DataFrame, fields: Sequence[str], id_col: str) -> DataFrame:
    """(id, field, term) for every distinct word of every field."""
    cells = [F.struct(F.lit(f).alias("field"), field_tokens(entities, f).alias("terms")) for f in fields]
    rows = entities.select(F.col(id_col), F.explode(F.array(*cells)).alias("_c"))
    return rows.select(id_col, F.col("_c.field").alias("field"), F.explode("_c.terms").alias("term"))


def _without_one(words: Column) -> Column:
    """All words with one letter left out."""
    each = lambda w: F.when(F.length(w) > 0, F.transform(
        F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1)))).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(words, each))


def with_keys(terms: DataFrame) -> DataFrame:
    """(key, term): the beginnings of the terms with up to two letters left out."""
    whole = F.array(F.substring("term", 1, BEGINNING))
    one = F.array_distinct(_without_one(whole))
    return terms.select("term", whole.alias("_a"), one.alias("_b")).select(
        F.explode(F.array_distinct(F.concat("_a", "_b", _without_one(F.col("_b"))))).alias("key"), "term")


def keys_of(word: str) -> list[str]:
    """The keys of a word for as many edits as it allows."""
    start = word[:BEGINNING]
    out = set()
    for n in range(allowed_edits(word) + 1):
        for left in itertools.combinations(range(len(start)), n):
            out.add("".join(c for i, c in enumerate(start) if i not in left))
    return sorted(out)


def _swapped(words: set[str]) -> set[str]:
    """All words after one swap of two neighbouring letters."""
    return {w[:i] + w[i + 1] + w[i] + w[i + 2:] for w in words for i in range(len(w) - 1) if w[i] != w[i + 1]}


def closeness(term: Column, word: str) -> Column:
    """1 - edits / length within the word's limit, else 0; a swap of neighbouring letters is one edit."""
    edits = allowed_edits(word)
    forms, known = {word: 0}, {word}
    for swaps in range(1, edits + 1):
        known = _swapped(known)
        for form in known:
            forms.setdefault(form, swaps)
    best = F.lit(0.0)
    for form, swaps in sorted(forms.items()):
        d = F.levenshtein(term, F.lit(form), edits - swaps)  # -1 beyond the limit
        best = F.greatest(best, F.when(d >= 0, 1 - (d + swaps) / F.lit(float(len(word)))).otherwise(F.lit(0.0)))
    return F.when(F.length(term).between(len(word) - edits, len(word) + edits), best).otherwise(F.lit(0.0))


def close_terms(terms: DataFrame, words: Sequence[str]) -> DataFrame:
    """(term, close): for each term that is near a word, its closeness to every word."""
    scored = terms.select("term", F.array(*[closeness(F.col("term"), w) for w in words]).alias("close"))
    return scored.where(F.exists("close", lambda c: c > 0))


def scores(hits: DataFrame, fields: Sequence[str], words: Sequence[str], id_col: str) -> DataFrame:
    """(id, score): per field the sum over words of the best closeness, then the best field.  One aggregate by id."""
    best = [[F.max(F.when(F.col("field") == f, F.get("close", F.lit(i)))) for i in range(len(words))] for f in fields]
    total = [sum((F.coalesce(b, F.lit(0.0)) for b in per_word[1:]), F.coalesce(per_word[0], F.lit(0.0))) for per_word in best]
    return hits.groupBy(id_col).agg((F.greatest(*total) if len(total) > 1 else total[0]).alias("score"))


class SearchIndex:
    """Dictionary and postings of a table, written once and read by many queries.

    ``terms`` holds (key, term) in the order of keys, ``postings`` (term, field, id) in the
    order of terms, so a query reads the row groups of its keys and of the terms found.
    """

    def __init__(self, spark: SparkSession, folder: str, fields: Sequence[str], id_col: str):
        self.spark, self.folder, self.fields, self.id_col = spark, folder, list(fields), id_col

    @classmethod
    def build(cls, entities: DataFrame, fields: Sequence[str], id_col: str, folder: str) -> SearchIndex:
        postings(entities, fields, id_col).orderBy("term", "field", id_col).write.mode("overwrite").parquet(f"{folder}/postings")
        made = cls(entities.sparkSession, folder, fields, id_col)
        with_keys(made.postings().select("term").distinct()).orderBy("key", "term").write.mode("overwrite").parquet(f"{folder}/terms")
        return made

    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/postings")

    def candidates(self, words: Sequence[str]) -> DataFrame:
        """Distinct terms that share a key with a word."""
        keys = sorted({k for w in words for k in keys_of(w)})
        return self.spark.read.parquet(f"{self.folder}/terms").where(F.col("key").isin(keys)).select("term").distinct()

    def scores(self, words: Sequence[str]) -> DataFrame:
        """(id, score) of all rows with a term near a word."""
        near = close_terms(self.candidates(words), words)
        return scores(self.postings().join(near, "term"), self.fields, words, self.id_col)
