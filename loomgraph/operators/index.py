"""An inverted index for weighted search: many queries against one table.

The result is that of :func:`loomgraph.operators.search.search` for each query,
without a scan of all texts for each.

* postings: (token, field, key, n), the tokens of a row's field with their counts;
* tokens: (token, grams), the vocabulary with its pairs and triples of letters;
* texts: (key, field, text), the lower-case fields, read only for rows that can
  hold a query's phrase.

A term meets its own token by equality, the tokens inside it by equality with
its pieces, and the tokens around it by one of its grams, the rarest, before they
are compared. A phrase can only stand in rows whose tokens hold its longest word.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import search_tokens
from ..session import cut

#: parts of the hits of one text that meet its askers apart
PARTS = 64
#: askers of one row, and rows of one task as far as there are parts
BLOCK, ROWS = 4096, 1 << 20

def _pieces(text: Column, least: int, most: Column) -> Column:
    """Distinct substrings of ``least`` to ``most`` characters."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
    ends = lambda s: F.sequence(F.lit(least), F.greatest(F.lit(least), most))
    return F.array_distinct(F.filter(F.flatten(F.transform(starts, lambda s: F.transform(ends(s), lambda n: F.substring(text, s, n)))), lambda p: F.length(p) >= least))


@dataclass
class SearchIndex:
    postings: DataFrame
    tokens: DataFrame
    grams: DataFrame
    texts: DataFrame

    @classmethod
    def build(cls, rows: DataFrame, key: str, fields: tuple[str, ...]) -> SearchIndex:
        """Index ``fields`` of rows by ``key``, which must name one row."""
        pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.lower(F.coalesce(F.col(f).cast("string"), F.lit(""))).alias("text")) for f in fields])
        texts = cut(rows.select(F.col(key).alias("key"), F.explode(pairs).alias("p")).select("key", "p.field", "p.text").where("text <> ''"), "texts")
        postings = cut(texts.select("key", "field", F.explode(search_tokens(F.col("text"))).alias("token")).groupBy("token", "field", "key").agg(F.count("*").alias("n")), "postings")
        tokens = cut(postings.groupBy("token").agg(F.count("*").alias("df")), "tokens")
        grams = tokens.select("token", F.explode(_pieces(F.col("token"), 2, F.lit(3))).alias("gram"))
        return cls(postings, tokens, cut(grams, "grams"), texts)

    def _around(self, words: DataFrame) -> DataFrame:
        """(word, token) of tokens that hold a word or equal it. words: word."""
        df = self.grams.groupBy("gram").agg(F.count("*").alias("df"))
        own = words.select("word", F.explode(_pieces(F.col("word"), 2, F.lit(3))).alias("gram")).join(df, "gram", "left")
        #: a gram that no token has: the word is in none
        rarest = own.groupBy("word").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram")).alias("g")).select("word", "g.gram")
        return rarest.join(self.grams, "gram").where(F.contains("token", F.col("word"))).select("word", "token")

    def search(self, queries: DataFrame, weights: dict[str, int], k: int | None = None) -> DataFrame:
        """(query_id, key, score, matches) of all queries (query_id, query), the
        best ``k`` of each if given: by score, then key."""
        spaced = F.lower(F.regexp_replace(F.coalesce("query", F.lit("")), "([a-z0-9])([A-Z])", "$1 $2"))
        words = F.filter(F.split(F.regexp_replace(spaced, "[^a-z0-9_#]+", " "), " "), lambda t: F.length(t) >= 2)
        #: equal queries are searched once, under a number of their text
        said = cut(queries.select(F.col("query_id").alias("asker"), F.trim(F.lower(F.coalesce("query", F.lit("")))).alias("phrase"), words.alias("words")).where(F.size("words") > 0), "queries")
        text_id = F.sha2(F.concat_ws("\n", "phrase", F.array_join("words", " ")), 256)
        said = said.withColumn("query_id", text_id)
        asked = cut(said.groupBy("query_id").agg(F.first("phrase").alias("phrase"), F.first("words").alias("words")), "asked")
        askers = said.select("query_id", "asker")
        weighed = F.broadcast(asked.sparkSession.createDataFrame([(f, w, n) for n, (f, w) in enumerate(weights.items())], "field string, weight int, place int"))
        postings = self.postings.join(weighed, "field")
        terms = asked.select("query_id", F.explode("words").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
        vocabulary = terms.select(F.col("term").alias("word")).distinct()
        inner = vocabulary.select("word", F.explode(_pieces(F.col("word"), 2, F.length("word"))).alias("token")).join(self.tokens.select("token"), "token").select("word", "token")
        fits = cut(self._around(vocabulary).unionByName(inner).distinct(), "fits")
        met = terms.join(fits.withColumnRenamed("word", "term"), "term").join(postings, "token").groupBy("query_id", "term", "times", "key", "field", "weight", "place").agg(
            F.sum(F.when(F.col("token") == F.col("term"), F.col("n")).otherwise(0)).alias("exact"), F.sum("n").alias("partial"))
        points = F.when(F.col("exact") > 0, F.col("exact") * 2).otherwise(F.col("partial")) * F.col("times")
        by_term = met.select("query_id", "key", "field", "place", (points * F.col("weight")).alias("points"))
        #: the phrase's longest run of letters stands inside one token
        runs = F.filter(F.split(F.regexp_replace("phrase", "[^a-z0-9_#]+", " "), " "), lambda t: F.length(t) >= 2)
        longest = F.element_at(F.array_sort(F.transform(runs, lambda w: F.struct((-F.length(w)).alias("minus"), w.alias("word")))), 1)["word"]
        phrases = asked.where("length(phrase) >= 3").select("query_id", "phrase", longest.alias("word")).where("word is not null")
        held = self._around(phrases.select("word").distinct())
        #: fields whose text can hold it; each is read once
        may = phrases.join(held, "word").join(postings, "token").select("query_id", "phrase", "key", "field", "weight", "place").distinct()
        whole = may.join(self.texts, ["key", "field"]).where(F.contains("text", F.col("phrase"))).select("query_id", "key", "field", "place", (F.col("weight") * 4).cast("long").alias("points"))
        scored = by_term.unionByName(whole).groupBy("query_id", "key", "field", "place").agg(F.sum("points").alias("points")).groupBy("query_id", "key").agg(
            F.sum("points").alias("score"), F.transform(F.array_sort(F.collect_list(F.struct("place", "field"))), lambda x: x["field"]).alias("matches"))
        if k is None:
            return _for_all(cut(scored, "hits"), askers)
        #: ranked within blocks of keys first, so that no task has all hits of a query
        deal = F.pmod(F.xxhash64("key"), F.lit(1024))
        for block in (deal, F.lit(0)):
            best = Window.partitionBy("query_id", block).orderBy(F.col("score").desc(), "key")
            scored = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        return scored.join(askers, "query_id").select(F.col("asker").alias("query_id"), "key", "score", "matches", "rank")


def _for_all(hits: DataFrame, askers: DataFrame) -> DataFrame:
    """The hits of each text for each of its askers. hits: query_id, key, score,
    matches; askers: query_id (the text), asker.

    Both are small beside the result, so the tasks go by its counted rows, not
    by the bytes that are dealt. Hits are dealt out, so that no task has all of
    a text and all its askers, and meet its askers in blocks.
    """
    asking = askers.groupBy("query_id").agg(F.count("*").alias("n"))
    sizes = hits.groupBy("query_id").agg(F.count("*").alias("hits")).join(asking, "query_id").agg(F.sum("hits").alias("hits"), F.sum(F.col("hits") * F.col("n")).alias("rows")).first()
    tasks = 1 + max((sizes["hits"] or 0) // ROWS, min(1023, (sizes["rows"] or 0) // ROWS))
    block = F.pmod(F.xxhash64("asker"), F.ceil(F.col("n") / BLOCK))
    blocks = askers.join(asking, "query_id").groupBy("query_id", block.alias("block")).agg(F.transform(F.collect_list(F.struct("asker")), lambda a: a["asker"]).alias("askers"))
    copies = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))).select("query_id", "part", "askers")
    parted = hits.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(PARTS)).cast("int"))
    met = parted.repartition(tasks, "query_id", "part").join(copies.repartition(tasks, "query_id", "part").hint("merge"), ["query_id", "part"])
    return met.select(F.explode("askers").alias("query_id"), "key", "score", "matches")
