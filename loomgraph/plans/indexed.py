"""Queries over what is kept beside the tables: indexes, closures, automata."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import closure, globs, graph, search
from ..operators.index import SearchIndex
from .tables import entity_edges, node, query

_WORDS = "list_filter(string_split(regexp_replace(lower({}), '[^a-z0-9_#]+', ' ', 'g'), ' '), lambda t: len(t) >= 2)"
_FIELD = """{w} * (case when contains(lower({c}), q) then 4 else 0 end + list_sum(list_transform(""" + _WORDS.format("q") + """, lambda term:
 case when list_contains(""" + _WORDS.format("{c}") + """, term) then 2 * len(list_filter(""" + _WORDS.format("{c}") + """, lambda x: x = term))
 else len(list_filter(""" + _WORDS.format("{c}") + """, lambda x: contains(x, term) or contains(term, x))) end)))"""
_NAMES = "select s_suppkey as query_id, case s_nationkey % 4 when 0 then 'small ' || lower(n_name) when 1 then 'blue bolt' when 2 then 'brand' || s_nationkey else 'ring eco' end as q from supplier join nation on s_nationkey = n_nationkey"


def _queries(t):
    kind = F.col("s_nationkey") % 4
    said = F.when(kind == 0, F.concat(F.lit("small "), F.lower("n_name"))).when(kind == 1, "blue bolt").when(kind == 2, F.concat(F.lit("brand"), F.col("s_nationkey").cast("string"))).otherwise("ring eco")
    return t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("query_id"), said.alias("query"))


def _index(t) -> SearchIndex:
    rows = t("part").select("p_partkey", F.col("p_name").alias("function"), F.col("p_brand").alias("file"), F.col("p_type").alias("calls"))
    return SearchIndex.build(rows, "p_partkey", ("function", "file", "calls"))


WEIGHTS = {k: search.FIELD_WEIGHTS[k] for k in ("function", "file", "calls")}
_SCORED = f"""with q as ({_NAMES}), s as (select query_id, p_partkey as key, {_FIELD.format(w=7, c='p_name')} as a, {_FIELD.format(w=5, c='p_brand')} as b, {_FIELD.format(w=3, c='p_type')} as c from q, part)
select query_id, key, (a + b + c)::bigint as score, list_concat(list_concat(case when a > 0 then ['function'] else [] end, case when b > 0 then ['file'] else [] end), case when c > 0 then ['calls'] else [] end) as matches from s where a + b + c > 0"""


@query("q1_index", _SCORED)
def q1_index(t):
    """A search for each supplier, against one index of three fields."""
    return _index(t).search(_queries(t), WEIGHTS)


@query("q1_index_top", f"select query_id, key, score, rank from (select *, row_number() over (partition by query_id order by score desc, key) as rank from ({_SCORED})) where rank <= 8")
def q1_top(t):
    return _index(t).search(_queries(t), WEIGHTS, k=8).select("query_id", "key", "score", F.col("rank").cast("long").alias("rank"))


_NEW = """e as (select 'r:'||n_regionkey src, 'n:'||n_nationkey dst from nation
  union select 'n:'||c_nationkey, 'c:'||c_custkey from customer where c_acctbal >= 0
  union select 'n:'||((c_nationkey + 1) % 25), 'c:'||c_custkey from customer where c_acctbal < -500
  union select 'c:'||c_custkey, 'n:'||c_nationkey from customer where c_acctbal > 9000
  union select 'c:'||o_custkey, 'o:'||o_orderkey from orders)"""


@query("g1_reach_upkeep", f"""with recursive {_NEW}, walk as (select 'r:'||r_regionkey as start, 'r:'||r_regionkey as node, 0 as depth from region
  union select w.start, e.dst, w.depth + 1 from walk w join e on w.node = e.src where w.depth < 8)
select start, node, min(depth) as depth from walk group by 1, 2""")
def g1_upkeep(t):
    """Reachability after customers in debt left their nations, the deepest for
    the next nation, and rich ones gained an edge back."""
    edges = entity_edges(t)
    starts = t("region").select(node("r", "r_regionkey").alias("start"))
    customer = t("customer")
    of = node("n", "c_nationkey").alias("src"), node("c", "c_custkey").alias("dst")
    removed = customer.where("c_acctbal < 0").select(*of)
    next_nation = F.concat(F.lit("n:"), ((F.col("c_nationkey") + 1) % 25).cast("string")).alias("src")
    added = customer.where("c_acctbal < -500").select(next_nation, of[1]).unionByName(customer.where("c_acctbal > 9000").select(of[1].alias("src"), of[0].alias("dst")))
    return closure.maintain(graph.reach(edges, starts), edges, added, removed)


@query("p1_many_globs", """with p as (select page_id, regexp_replace(url, '^https?://', '') as path from pages),
g as (select c_custkey as glob_id, case c_custkey % 3 when 0 then '^(?:.*/)?en/'||c_custkey||'$' when 1 then '^[^/]*\\.example\\.com/[^/][^/]/'||c_custkey||'[^/]*$' else '^m\\.[^/]*/(?:.*/)?'||c_custkey||'(?:/.*)?$' end as rx from customer)
select path as file, glob_id from p join g on regexp_matches(path, rx)""")
def p1_many(t):
    """A glob for every customer against the addresses of all pages."""
    key = F.col("c_custkey").cast("string")
    glob = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("**/en/"), key)).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("*.example.com/??/"), key, F.lit("*"))).otherwise(F.concat(F.lit("m.*/**/"), key, F.lit("/**")))
    paths = t("pages").select(F.regexp_replace("url", "^https?://", "").alias("file"))
    return globs.match_globs(paths, t("customer").select(F.col("c_custkey").alias("glob_id"), glob.alias("glob")))
