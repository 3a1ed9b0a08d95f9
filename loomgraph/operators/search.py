"""Weighted keyword search, task context and grounding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import search_tokens

FIELD_WEIGHTS = {"function": 7, "file": 5, "basename": 5, "exports": 4, "calls": 3, "imports": 2, "workflow": 2, "exported": 1}


def query_tokens(query: str) -> list[str]:
    """A query's tokens, as :func:`search_tokens` splits a text."""
    import re

    spaced = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", query).lower()
    return [t for t in re.split(r"[^a-z0-9_#]+", spaced) if len(t) >= 2]


def _counts(tokens: F.Column, term: F.Column) -> tuple[F.Column, F.Column]:
    """Tokens equal to a term, and tokens that hold it or that it holds."""
    return F.size(F.filter(tokens, lambda t: t == term)), F.size(F.filter(tokens, lambda t: F.contains(t, term) | F.contains(term, t)))


def search(rows: DataFrame, query: str, weights: dict[str, int]) -> DataFrame:
    """rows with score > 0 and the fields that matched.

    A phrase of three characters or more counts four times the field's weight
    where it occurs; each term counts two for every equal token, or one for
    every token that holds it or that it holds, if none is equal. All built-in:
    a scan, no shuffle.
    """
    terms, phrase = query_tokens(query), query.lower().strip()
    if not terms:
        return rows.withColumns({"score": F.lit(0), "matches": F.array().cast("array<string>")}).where("false")
    scores = []
    for field, weight in weights.items():
        text = F.lower(F.coalesce(F.col(field).cast("string"), F.lit("")))
        tokens = search_tokens(text)
        points = F.when(F.contains(text, F.lit(phrase)), 4).otherwise(0) if len(phrase) >= 3 else F.lit(0)
        for term in map(F.lit, terms):
            exact, partial = _counts(tokens, term)
            points = points + F.when(exact > 0, exact * 2).otherwise(partial)
        scores.append(F.struct(F.lit(field).alias("field"), (points * weight).alias("points")))
    scored = rows.withColumn("_fields", F.array(*scores))
    return scored.withColumns({
        "score": F.aggregate("_fields", F.lit(0), lambda a, x: a + x["points"]),
        "matches": F.transform(F.filter("_fields", lambda x: x["points"] > 0), lambda x: x["field"]),
    }).drop("_fields").where("score > 0")


def task_context(hits: DataFrame, workflow_files: DataFrame, max_hits: int = 8) -> DataFrame:
    """Workflows that hold a file of the best hits, with those files."""
    best = hits.orderBy(F.col("score").desc(), "file", "function").limit(max_hits)
    return workflow_files.join(best.select("file").distinct(), "file").groupBy("workflow").agg(F.array_sort(F.collect_set("file")).alias("files"))


def ungrounded(claims: DataFrame, truth: DataFrame) -> DataFrame:
    """Claims that name nothing that exists. Both: claim."""
    return claims.where("claim is not null").distinct().join(truth.select("claim").distinct(), "claim", "left_anti")


def path_claims(text) -> F.Column:
    """Path-like tokens with a source extension in a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("([A-Za-z0-9_@./-]+\\.(?:js|ts|jsx|tsx|mjs|cjs|py|go|rs|rb|java|php|json|md|html))\\b"), F.lit(1)))


def id_claims(text) -> F.Column:
    """Eight-digit finding ids in a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("\\b([0-9a-f]{8})\\b"), F.lit(1)))


def workflow_claims(text) -> F.Column:
    """Workflow ids (``wf:kind:file``) in a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("\\b(wf:[a-z-]+:[A-Za-z0-9_@./-]*[A-Za-z0-9_])"), F.lit(1)))


def relation_claims(text) -> F.Column:
    """(from, to) of sentences that say a path imports, calls or reaches another."""
    path = "([A-Za-z0-9_@./-]+\\.[A-Za-z]{1,4})"
    said = f"{path}`?\\s+(?:imports|calls|reaches|depends on|uses)\\s+`?{path}"
    return F.arrays_zip(F.regexp_extract_all(text, F.lit(said), F.lit(1)).alias("from"), F.regexp_extract_all(text, F.lit(said), F.lit(2)).alias("to"))
