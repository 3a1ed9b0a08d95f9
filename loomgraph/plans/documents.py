"""Documents of a scored project as a relation (file, text).

A page for each workflow with its diagram, as Markdown, HTML and JSON; lists of
its files, dealt into pages of about PAGE names. Everything is made by the
executors, from sorted lists, so that the same tables give the same bytes;
:class:`loomgraph.sources.changes.ChangeStore` writes them as files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bar, escape_html

NODES, PAGE = 30, 1000


def slug(workflow: Column) -> Column:
    """A file name for a workflow, of letters and digits, told apart by a hash."""
    plain = F.regexp_replace(F.regexp_replace(workflow, "[^A-Za-z0-9]+", "-"), "^-|-$", "")
    return F.concat(F.substring(plain, 1, 60), F.lit("-"), F.substring(F.sha1(workflow), 1, 8))


def mermaid_id(name: Column) -> Column:
    return F.concat(F.lit("n"), F.substring(F.sha1(name), 1, 10))


def mermaid_label(text: Column) -> Column:
    """A label within quotes: quotes and signs that end one are replaced."""
    return F.replace(F.replace(F.replace(text, F.lit('"'), F.lit("'")), F.lit("["), F.lit("(")), F.lit("]"), F.lit(")"))


def diagrams(workflow_files: DataFrame, edges: DataFrame, most: int = NODES) -> DataFrame:
    """(workflow, diagram): the edges within each workflow as a Mermaid graph; a
    workflow of more than ``most`` files says only how many there are."""
    member = workflow_files.select("workflow", "file").distinct()
    sizes = member.groupBy("workflow").agg(F.count("*").alias("n"))
    small = member.join(sizes.where(F.col("n") <= most).select("workflow"), "workflow", "left_semi")
    node = F.concat(F.lit("  "), mermaid_id(F.col("file")), F.lit('["'), mermaid_label(F.col("file")), F.lit('"]'))
    nodes = small.select("workflow", F.lit(0).alias("ord"), F.col("file").alias("by"), node.alias("line"))
    links = small.withColumnRenamed("file", "src").join(edges.select("src", "dst").distinct(), "src").join(small.withColumnRenamed("file", "dst"), ["workflow", "dst"])
    arrows = links.select("workflow", F.lit(1).alias("ord"), F.concat_ws(" ", "src", "dst").alias("by"), F.concat(F.lit("  "), mermaid_id(F.col("src")), F.lit(" --> "), mermaid_id(F.col("dst"))).alias("line"))
    drawn = nodes.unionByName(arrows).groupBy("workflow").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "by", "line"))), lambda x: x["line"]), "\n").alias("body"))
    body = F.coalesce("body", F.concat(F.lit('  big["'), F.col("n").cast("string"), F.lit(' files, listed below"]')))
    return sizes.join(drawn, "workflow", "left").select("workflow", F.concat(F.lit("```mermaid\ngraph LR\n"), body, F.lit("\n```")).alias("diagram"))


def _percent(x: Column) -> Column:
    return F.concat(F.format_number(x * 100, 1), F.lit("%"))


def file_lists(workflow_files: DataFrame, page: int = PAGE) -> DataFrame:
    """(workflow, file, text): the names of each workflow's files, sorted, in as
    many pages as about ``page`` names a page need."""
    member = workflow_files.select("workflow", F.col("file").alias("name")).distinct()
    sizes = member.groupBy("workflow").agg(F.ceil(F.count("*") / page).cast("int").alias("pages"))
    dealt = member.join(sizes, "workflow").withColumn("place", F.pmod(F.xxhash64("name"), F.col("pages")).cast("int"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list("name")), lambda n: F.concat(F.lit("- `"), n, F.lit("`"))), "\n")
    listed = dealt.groupBy("workflow", "place").agg(lines.alias("lines"))
    at = F.concat(F.lit("workflows/"), slug(F.col("workflow")), F.lit("/files-"), F.col("place").cast("string"), F.lit(".md"))
    return listed.select("workflow", at.alias("file"), F.concat(F.lit("# Files of "), F.col("workflow"), F.lit("\n\n"), F.col("lines"), F.lit("\n")).alias("text"))


def workflow_pages(workflows: DataFrame, signals: DataFrame, workflow_files: DataFrame, edges: DataFrame) -> DataFrame:
    """(file, text) of all documents of the workflows.

    workflows: workflow, n_files, n_functions, score, signal_coverage (may be
    null); signals: workflow, signal, value, weight; edges: src, dst.
    """
    number = lambda c: F.coalesce(F.format_number(c, 3), F.lit("unavailable"))
    row = F.concat(F.lit("| "), F.col("signal"), F.lit(" | "), number("value"), F.lit(" | "), F.format_number("weight", 2), F.lit(" |"))
    cell = F.concat(F.lit("<tr><td>"), escape_html(F.col("signal")), F.lit("</td><td>"), number("value"), F.lit("</td></tr>"))
    each = F.array_sort(F.collect_list(F.struct("signal", "value", "weight", row.alias("row"), cell.alias("cell"))))
    table = signals.groupBy("workflow").agg(each.alias("signals"))
    facts = workflows.select("workflow", "n_files", "n_functions", "score", "signal_coverage").join(table, "workflow", "left").join(diagrams(workflow_files, edges), "workflow", "left")
    facts = facts.withColumns({"signals": F.coalesce("signals", F.array().cast(table.schema["signals"].dataType)), "diagram": F.coalesce("diagram", F.lit(""))})
    shown = F.coalesce(F.concat(F.lit("`"), bar(F.col("score")), F.lit("` "), _percent(F.col("score"))), F.lit("unavailable"))
    join = lambda name: F.array_join(F.transform("signals", lambda s: s[name]), "\n")
    markdown = F.concat(
        F.lit("# "), F.col("workflow"), F.lit("\n\n- files: "), F.col("n_files").cast("string"), F.lit("\n- functions: "), F.col("n_functions").cast("string"), F.lit("\n- score: "), shown,
        F.lit("\n- signal coverage: "), F.coalesce(_percent(F.col("signal_coverage")), F.lit("unavailable")), F.lit("\n\n| signal | value | weight |\n|-|-|-|\n"), join("row"), F.lit("\n\n"), F.col("diagram"), F.lit("\n"),
    )
    title = escape_html(F.col("workflow"))
    page = F.concat(
        F.lit('<!DOCTYPE html>\n<html><head><meta charset="utf-8"><title>'), title, F.lit("</title></head>\n<body><h1>"), title, F.lit("</h1>\n<p>"), F.col("n_files").cast("string"), F.lit(" files, score "), number("score"),
        F.lit("</p>\n<table>\n"), join("cell"), F.lit("\n</table>\n<pre>"), escape_html(F.col("diagram")), F.lit("</pre>\n</body></html>\n"),
    )
    report = F.to_json(F.struct("workflow", "n_files", "n_functions", F.round("score", 6).alias("score"), F.transform("signals", lambda s: F.struct(s["signal"].alias("signal"), F.round(s["value"], 6).alias("value"), s["weight"].alias("weight"))).alias("signals")))
    kinds = F.array(F.struct(F.lit(".md").alias("end"), markdown.alias("text")), F.struct(F.lit(".html").alias("end"), page.alias("text")), F.struct(F.lit(".json").alias("end"), F.concat(report, F.lit("\n")).alias("text")))
    pages = facts.select("workflow", F.explode(kinds).alias("k")).select(F.concat(F.lit("workflows/"), slug(F.col("workflow")), F.col("k.end")).alias("file"), F.col("k.text").alias("text"))
    return pages.unionByName(file_lists(workflow_files).select("file", "text"))
