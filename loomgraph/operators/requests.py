"""What a request asks for, and about what.

A request's words name concepts; an operation is a set of concepts it needs and
some that speak for it. The operation with the most concepts in the request
wins, so words may stand anywhere and in any order. What the operation is about
is read from the text: files by their shape, findings and reasons by the word
before them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: concept: the words that name it, phrases of two words with a _
CONCEPTS: dict[str, str] = {
    "look": "show list print tell display give see what what's which how why explain describe",
    "act": "run start launch do perform execute begin",
    "write": "create make write generate save export take record produce",
    "redo": "map remap refresh rebuild",
    "project": "project repo repository codebase we",
    "baseline": "baseline snapshot",
    "compare": "check compare against",
    "docs": "docs documentation",
    "scan": "modernization modernisation modernize",
    "queue": "queue backlog", "review": "review approval approvals",
    "finding": "finding findings",
    "proof": "evidence proof flagged reported raised",
    "handoff": "handoff hand_off handover package prompt",
    "solutions": "solutions remedies",
    "doubt": "understanding uncertainty limits blind_spots unsure",
    "most": "ceiling maximum reach achievable high",
    "score": "score confidence",
    "moved": "change changed move moved drop dropped rise rose delta since fall fell",
    "take-apart": "explain break breakdown behind composed",
    "untested": "untested gaps uncovered missing",
    "test": "test tests",
    "fake": "padding fake name-only hollow",
    "credit": "credit credits cover covers covering",
    "plan": "plan improve raise next should priorities",
    "work": "work fix do improvement action cleanup score",
    "verify": "verify verification gate gates healthy green passing ok okay good",
    "record": "transcript chat conversation session",
    "unresolved": "unresolved dragging",
    "calls": "call calls resolution",
    "path": "trace chain path reachable unreachable used unused dead orphan orphaned imported loaded workflow",
    "mentions": "references usages mentions",
    "git": "git", "diff": "diff", "lint": "linter lint", "compile": "build compile typecheck",
    "install": "install", "packages": "dependencies packages", "server": "server", "dev": "dev development",
    "watch": "watching watch", "status": "status", "seek": "find where where's locate look_for search",
    "approve": "approve accept", "dismiss": "dismiss reject", "repair": "fix repair apply",
}
#: operation: concepts that it needs, a bar between alternatives, then those that speak for it
OPERATIONS: dict[str, tuple[str, str]] = {
    "approve": ("approve finding", ""), "dismiss": ("dismiss finding", ""), "fix": ("repair finding|repair", "finding"),
    "check": ("compare baseline", "project"), "baseline": ("write baseline", ""), "map": ("redo", "act write project"), "docs": ("docs", "write"),
    "modernize": ("scan", "act"), "review": ("queue review", "look act"), "evidence": ("proof", "look finding"), "findings": ("finding look", ""),
    "handoff": ("handoff", "finding"), "solutions": ("solutions", "look act"), "diagnose": ("doubt", "look"),
    "ceiling": ("most score|most", "look"), "score-delta": ("score moved", "look"), "explain": ("score take-apart", "look"), "test-gaps": ("untested", "test look"),
    "padding": ("fake", "test look"), "test-credit": ("credit", "test look"), "improve": ("plan work", "look"), "verify": ("verify project|verify act", "act"),
    "transcript": ("record write", ""), "resolution": ("unresolved calls", "look"), "trace": ("path", "look"), "references": ("mentions", "seek"), "diff": ("git diff", "look"),
    "test": ("act test", ""), "lint": ("lint", "act"), "build": ("compile project", ""), "install": ("install packages", ""), "serve": ("dev server", "act"),
    "watch": ("watch", "act"), "status": ("status", "look"), "find": ("seek", ""),
}
OTHER_COMMANDS = ("help", "clear", "end")
#: words of questions, and of prose, that a search isn't for
FILLER = "find where is are where's look for search code related to about all the a an references usages mentions of"


def words_of(text: Column) -> Column:
    """Lower-case words and pairs of neighbours joined by a _."""
    one = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^\\w./'#-]+|[.](?=\\s|$)", " "), " +"), lambda w: w != "")
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(one) - 1, F.lit(1))), lambda k: F.concat_ws("_", F.get(one, k - 1), F.get(one, k)))
    return F.concat(one, pairs)


def _scores(words: Column) -> Column:
    """The best (score, order) of all operations, by one array of concepts."""
    named = F.array_compact(F.array(*[F.when(F.arrays_overlap(words, F.array(*map(F.lit, said.split()))), concept) for concept, said in CONCEPTS.items()]))

    def best(concepts: Column) -> Column:
        out = []
        for order, (name, (needs, helps)) in enumerate(OPERATIONS.items()):
            points = []
            for way in needs.split("|"):
                have = reduce(lambda a, b: a & b, [F.array_contains(concepts, c) for c in way.split()])
                points.append(F.when(have, 2 * len(way.split())).otherwise(0))
            needed = F.greatest(*points) if len(points) > 1 else points[0]
            helped = reduce(lambda a, b: a + b, [F.array_contains(concepts, c).cast("int") for c in helps.split()], F.lit(0))
            out.append(F.when(needed > 0, F.struct((needed + helped).alias("points"), F.lit(-order).alias("order"), F.lit(name).alias("name"))))
        return F.array_max(F.array(*out))

    #: by way of an array, so that the concepts are made once
    return F.element_at(F.transform(F.array(named), best), 1)


def operation(text: Column) -> Column:
    """The operation that a request asks for, unknown if none; of equals the one
    named first. "/name" asks for that command."""
    found = F.element_at(F.transform(F.array(words_of(text)), lambda w: F.coalesce(_scores(w)["name"], F.lit("unknown"))), 1)
    called = F.lower(F.regexp_extract(F.trim(text), "^/([A-Za-z-]+)", 1))
    slash = F.coalesce(F.trim(text).startswith("/"), F.lit(False))
    return F.when(slash, F.when(called.isin(*OPERATIONS, *OTHER_COMMANDS), called).otherwise("unknown")).otherwise(found)


def request_of(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows with ``request``: operation, finding (its id), reason, files (names
    with a dot or slash in them, at most two), query (what a search is for),
    arguments (the words after a command). Fields that don't apply are null."""
    asked = rows.withColumn("_op", operation(F.col(text)))
    bare = F.regexp_replace(F.trim(F.coalesce(F.col(text), F.lit(""))), "[.?!]+$", "")
    slash = bare.startswith("/")
    finding = F.nullif(F.regexp_extract(bare, "(?i)\\bfindings?\\s+(?!because\\b)([0-9A-Za-z_-]*[0-9][0-9A-Za-z_-]*)", 1), F.lit(""))
    reason = F.nullif(F.regexp_extract(bare, "(?i)\\bbecause\\s+(.+)$", 1), F.lit(""))
    named = F.filter(F.split(bare, "[\\s,;]+"), lambda w: w.rlike("^[^/\\s].*[./].*[A-Za-z0-9]$") | w.rlike("^[A-Za-z0-9_-]+/"))
    query = F.trim(F.array_join(F.filter(F.split(bare, "\\s+"), lambda w: ~F.lower(w).isin(*FILLER.split())), " "))
    has = lambda *names: ~slash & F.col("_op").isin(*names)
    return asked.withColumn("request", F.struct(
        F.col("_op").alias("operation"), F.when(has("approve", "dismiss", "fix", "evidence"), finding).alias("finding"), F.when(has("dismiss"), reason).alias("reason"),
        F.when(has("trace"), F.slice(named, 1, 2)).alias("files"), F.when(has("find", "references"), F.nullif(query, F.lit(""))).alias("query"),
        F.when(slash & (F.col("_op") != "unknown"), F.slice(F.split(bare, "\\s+"), 2, 1 << 20)).alias("arguments"),
    )).drop("_op")
