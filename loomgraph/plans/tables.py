"""The engine's operators over the relational tables, each with its SQL.

The tables hold no source code, so entities stand in: nations are workflows,
suppliers and orders their files, and so on. Queries read whole tables; where a
relation is a part of one (lines of 50 pieces as imports), a row's own values say
so, because an operator needs files that nothing imports.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..operators import diagnose, diff, findings, graph, ordering, requests, resolve, score, search
from ..operators.components import connected_components
from ..session import cut, table
from ..sources.project import tag_attributes
from ..streaming import remap
from .project import has_generated_header, import_roots

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under its inventory row, with its DuckDB equivalent."""

    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(lambda t: table(spark, sf_dir, t))
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def node(prefix: str, column: str) -> F.Column:
    return F.concat(F.lit(f"{prefix}:"), F.col(column).cast("string"))


def entity_edges(t) -> DataFrame:
    """region -> nation -> customer -> order."""
    return (
        t("nation").select(node("r", "n_regionkey").alias("src"), node("n", "n_nationkey").alias("dst"))
        .union(t("customer").select(node("n", "c_nationkey"), node("c", "c_custkey")))
        .union(t("orders").select(node("c", "o_custkey"), node("o", "o_orderkey")))
    )


EDGES_SQL = """edges as (
  select 'r:'||n_regionkey src, 'n:'||n_nationkey dst from nation
  union all select 'n:'||c_nationkey, 'c:'||c_custkey from customer
  union all select 'c:'||o_custkey, 'o:'||o_orderkey from orders)"""


# ---- graph ---------------------------------------------------------------

@query("g1_reach", f"""with recursive {EDGES_SQL}, walk as (
  select 'r:'||r_regionkey start, 'r:'||r_regionkey node, 0 depth from region
  union all select w.start, e.dst, w.depth + 1 from walk w join edges e on w.node = e.src)
select start, depth, count(*) n from walk group by start, depth""")
def g1(t):
    starts = t("region").select(node("r", "r_regionkey").alias("start"))
    return graph.reach(entity_edges(t), starts).groupBy("start", "depth").agg(F.count("*").alias("n"))


@query("g2_uncovered", f"""with recursive {EDGES_SQL}, walk as (
  select 'r:'||r_regionkey node from region where r_regionkey < 3
  union select e.dst from walk w join edges e on w.node = e.src)
select node from (select src node from edges union select dst from edges) where node not in (select node from walk)""")
def g2(t):
    edges = entity_edges(t)
    reached = graph.reach(edges, t("region").where("r_regionkey < 3").select(node("r", "r_regionkey").alias("start")))
    return graph.uncovered(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct(), reached)


def transitions(t) -> DataFrame:
    """Event types that follow each other, in the steps of each user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = t("events").select("user_id", F.col("event_type").alias("src"), F.lead("event_type").over(w).alias("dst"), (F.col("user_id") % 3).cast("string").alias("via"))
    return steps.where("dst is not null")


TRANSITIONS_SQL = """tr as (select distinct src, dst from (
  select user_id, event_type src, lead(event_type) over (partition by user_id order by ts, event_id) dst from events)
  where dst is not null)"""


@query("g3_cycles", f"""with recursive {TRANSITIONS_SQL}, walk as (
  select src, dst from tr union select w.src, e.dst from walk w join tr e on w.dst = e.src),
pairs as (select a.src, a.dst from walk a join walk b on a.src = b.dst and a.dst = b.src)
select min(dst) as cycle, list_sort(list(distinct dst)) members from pairs group by src
qualify row_number() over (partition by list_sort(list(distinct dst)) order by src) = 1""")
def g3(t):
    return graph.cycles(transitions(t))


def ring_edges(t) -> DataFrame:
    """Customers in a ring by key: one cycle as long as the table."""
    keys = t("customer").select(F.col("c_custkey").alias("src"))
    ends = keys.agg(F.max("src").alias("src"), F.min("src").alias("dst"))
    return keys.join(keys.select((F.col("src") - 1).alias("src"), F.col("src").alias("dst")), "src").unionByName(ends)


@query("g3_ring", "select min(c_custkey) as cycle, list_sort(list(c_custkey)) as members from customer")
def g3_ring(t):
    return graph.cycles(ring_edges(t))


@query("g4_long_chain", """select cast(row_number() over (order by a.c_custkey) as int) as step, a.c_custkey as src, b.c_custkey as dst, 'next' as via
from customer a join customer b on b.c_custkey = a.c_custkey + 1""")
def g4_long(t):
    ends = t("customer").agg(F.min("c_custkey"), F.max("c_custkey")).first()
    return graph.shortest_path(ring_edges(t).where("src < dst").withColumn("via", F.lit("next")), *ends)


#: the same by rounds alone, as for graphs beyond one task
@query("g3_cycles_rounds", ORACLES["g3_cycles"])
def g3_rounds(t):
    return graph.cycles(transitions(t), small=0)


@query("g3_ring_rounds", ORACLES["g3_ring"])
def g3_ring_rounds(t):
    return graph.cycles(ring_edges(t), small=0)


@query("g4_long_chain_rounds", ORACLES["g4_long_chain"])
def g4_long_rounds(t):
    ends = t("customer").agg(F.min("c_custkey"), F.max("c_custkey")).first()
    return graph.shortest_path(ring_edges(t).where("src < dst").withColumn("via", F.lit("next")), *ends, small=0)


@query("g5_trace_files", """with wf as (select l_partkey file, list_sort(list(distinct l_suppkey % 5)) workflows from lineitem join part on l_partkey = p_partkey where p_size > 25 group by 1),
im as (select l_partkey file, list_sort(list(distinct l_suppkey)) importers from lineitem group by 1)
select p_partkey as file, workflows is not null as in_workflow, coalesce(workflows, []) as workflows, coalesce(importers, []) as importers,
 case when workflows is null then case when p_size < 10 then 'generated' when p_size < 20 then 'test' else 'uncovered' end end as classification
from part left join wf on wf.file = p_partkey left join im on im.file = p_partkey""")
def g5(t):
    """Suppliers import the parts of their lines; large parts are in workflows."""
    lines = t("lineitem")
    large = t("part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"))
    wf = lines.join(large, "l_partkey").select(F.col("l_partkey").alias("file"), (F.col("l_suppkey") % 5).alias("workflow"))
    edges = lines.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))
    files = t("part").select(F.col("p_partkey").alias("file"), F.when(F.col("p_size") < 10, "generated").when(F.col("p_size") < 20, "test").alias("bucket"))
    return graph.trace_files(files, wf, edges, files.where("bucket is not null"))


@query("g6_reverse_chain", """with x as (select c_custkey c, n_nationkey n, n_regionkey r from customer join nation on c_nationkey = n_nationkey where c_custkey = (select min(c_custkey) from customer))
select 'reverse' as direction, 1 as step, 'r:'||r as src, 'n:'||n as dst, 'holds' as via from x union all select 'reverse', 2, 'n:'||n, 'c:'||c, 'holds' from x""")
def g6_reverse(t):
    first = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).orderBy("c_custkey").select("c_custkey", "n_regionkey").first()
    return graph.trace_path(entity_edges(t).withColumn("via", F.lit("holds")), f"c:{first[0]}", f"r:{first[1]}")


@query("g4_shortest_chain", """with n as (select n_nationkey k, n_regionkey r from nation),
b as (select min(k) k from n where r = 0), e as (select max(k) k from n where r = 0)
select 1 as step, 'n:'||b.k src, 'r:0' dst, 'member' via from b union all select 2, 'r:0', 'n:'||e.k, 'holds' from e""")
def g4(t):
    nations = t("nation")
    up = nations.select(node("n", "n_nationkey").alias("src"), node("r", "n_regionkey").alias("dst"), F.lit("member").alias("via"))
    edges = up.union(up.select("dst", "src", F.lit("holds")))
    ends = nations.where("n_regionkey = 0").agg(F.min("n_nationkey"), F.max("n_nationkey")).first()
    return graph.shortest_path(edges, f"n:{ends[0]}", f"n:{ends[1]}")


@query("g6_no_chain", "select 1 as step, '' src, '' dst, '' via where false")
def g6(t):
    up = t("nation").select(node("n", "n_nationkey").alias("src"), node("r", "n_regionkey").alias("dst"), F.lit("member").alias("via"))
    return graph.shortest_path(up, "r:0", "n:0")


@query("g7_components", """with recursive k as (
  select s_suppkey id, 'n'||s_nationkey key from supplier where s_nationkey is not null union all
  select s_suppkey, 'b'||cast(floor(s_acctbal / 100) as bigint) from supplier where s_acctbal is not null),
e as (select distinct a.id x, b.id y from k a join k b on a.key = b.key),
walk as (select x, y from e union select w.x, e.y from walk w join e on w.y = e.x)
select x as node, min(y) as component from walk group by x""")
def g7(t):
    """Suppliers joined by nation or by balance, by a star for each key; one
    without either stands alone."""
    s = t("supplier")
    nation, balance = F.concat(F.lit("n"), F.col("s_nationkey").cast("string")), F.concat(F.lit("b"), F.floor(F.col("s_acctbal") / 100).cast("string"))
    own = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))
    keys = s.select("s_suppkey", F.explode(F.array_compact(F.array(own, nation, balance))).alias("key"))
    hub = keys.groupBy("key").agg(F.min("s_suppkey").alias("hub"))
    return connected_components(keys.join(hub, "key"), "s_suppkey", "hub")


@query("g8_in_degree", "select l_partkey as node, count(*) as n from (select distinct l_suppkey, l_partkey from lineitem) group by 1")
def g8(t):
    return graph.in_degree(t("lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct())


@query("g9_blast_radius", """with m as (select p_brand as cluster, p_partkey file from part),
wf as (select distinct s_nationkey workflow, l_partkey file from lineitem join supplier on l_suppkey = s_suppkey),
deg as (select l_partkey file, count(*) n from (select distinct l_suppkey, l_partkey from lineitem) group by 1),
w as (select greatest(1, count(distinct workflow)) n from wf), f as (select greatest(1, count(distinct p_partkey)) n from part)
select m.cluster, count(distinct wf.workflow) as workflows_touched, coalesce(max(deg.n), 0) as max_in_degree,
  round(least(1.0, count(distinct wf.workflow) / max(w.n) + coalesce(max(deg.n), 0) / max(f.n)), 3) as score
from m left join wf using (file) left join deg using (file), w, f group by 1""")
def g9(t):
    lines = t("lineitem")
    wf = lines.join(t("supplier"), lines.l_suppkey == F.col("s_suppkey")).select(F.col("s_nationkey").alias("workflow"), F.col("l_partkey").alias("file")).distinct()
    edges = lines.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()
    parts = t("part").select(F.col("p_brand").alias("cluster"), F.col("p_partkey").alias("file"))
    return graph.blast_radius(parts, wf, edges, parts.select("file"))


@query("g10_reverse_index", "select l_partkey as file, list_sort(list(distinct l_suppkey)) as workflows from lineitem group by 1")
def g10(t):
    return graph.reverse_index(t("lineitem").select(F.col("l_partkey").alias("file"), F.col("l_suppkey").alias("workflow")))


@query("g11_induced", """with n as (select p_partkey from part order by 1 limit 30)
select distinct l_suppkey as src, l_partkey as dst from lineitem where l_partkey in (from n) and l_suppkey in (from n)""")
def g11(t):
    edges = t("lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))
    return graph.induced(edges, t("part").select(F.col("p_partkey").alias("node")))


# ---- joins ---------------------------------------------------------------

@query("j1_inner", "select n_name, count(*) as n, sum(c_acctbal) > 0 as positive from customer join nation on c_nationkey = n_nationkey group by 1")
def j1(t):
    return t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"), (F.sum("c_acctbal") > 0).alias("positive"))


@query("j2_left", "select c_custkey, count(o_orderkey) as n from customer left join orders on c_custkey = o_custkey group by 1")
def j2(t):
    counts = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return t("customer").select("c_custkey").join(counts, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("j3_anti", "select c_custkey from customer where not exists (from orders where o_custkey = c_custkey and o_totalprice > 200000)")
def j3(t):
    return t("customer").join(t("orders").where("o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("j4_semi", "select p_partkey from part where exists (from lineitem where l_partkey = p_partkey and l_quantity > 49)")
def j4(t):
    return t("part").join(t("lineitem").where("l_quantity > 49"), F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey")


@query("j5_full_diff", """with a as (select o_custkey k, count(*) n from orders where o_orderdate < timestamp '1996-01-01' group by 1),
b as (select o_custkey k, count(*) n from orders where o_orderdate >= timestamp '1996-01-01' group by 1)
select coalesce(a.k, b.k) as k, case when a.k is null then 'added' when b.k is null then 'removed' when a.n = b.n then 'same' else 'changed' end as change
from a full join b on a.k = b.k""")
def j5(t):
    part = lambda cond, n: t("orders").where(cond).groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias(n))
    both = part("o_orderdate < timestamp '1996-01-01'", "was").join(part("o_orderdate >= timestamp '1996-01-01'", "now"), "k", "full")
    return both.select("k", F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") == F.col("now"), "same").otherwise("changed").alias("change"))


@query("j6_explode", "select w as word, count(*) as n from (select unnest(string_split(p_name, ' ')) w from part) group by 1")
def j6(t):
    return t("part").select(F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query("j7_lookup", """with l(o_orderpriority, rank) as (values ('1-URGENT', 1), ('2-HIGH', 2), ('5-LOW', 5))
select o_orderpriority, rank, count(*) as n from orders join l using (o_orderpriority) group by 1, 2""")
def j7(t):
    orders = t("orders")
    lookup = orders.sparkSession.createDataFrame([("1-URGENT", 1), ("2-HIGH", 2), ("5-LOW", 5)], "o_orderpriority string, rank int")
    return orders.join(F.broadcast(lookup), "o_orderpriority").groupBy("o_orderpriority", "rank").agg(F.count("*").alias("n"))


@query("j8_prefix", "select p.prefix, count(*) as n from (select distinct regexp_extract(url, '^(https?://[^/]+)', 1) prefix from pages) p join pages on starts_with(url, p.prefix||'/') group by 1")
def j8(t):
    host = F.regexp_extract("url", "^(https?://[^/]+)", 1)
    hosts = t("pages").select(host.alias("prefix")).distinct()
    #: every prefix of whole segments meets the hosts by equality
    parts = F.split("url", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    return t("pages").select(F.explode(above).alias("prefix")).join(hosts, "prefix").groupBy("prefix").agg(F.count("*").alias("n"))


@query("j9_suffix", """with s as (select distinct regexp_extract(split_part(split_part(url, '?', 1), '#', 1), '([^/]+)$', 1) suffix from pages)
select s.suffix, count(*) as n from s join pages p on ends_with(split_part(split_part(p.url, '?', 1), '#', 1), '/'||s.suffix) where s.suffix <> '' group by 1""")
def j9(t):
    path = F.split_part(F.split_part("url", F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))
    last = t("pages").select(F.regexp_extract(path, "([^/]+)$", 1).alias("suffix")).where("suffix <> ''")
    return last.groupBy("suffix").agg(F.count("*").alias("n"))


@query("j10_regex", """with p(ord, pattern, class) as (values (1, '^Licensed under', 'license'), (2, 'All rights reserved', 'rights'), (3, '@[a-z]+\\.', 'mail'))
select class, count(*) as n from (select doc_id, arg_min(class, ord) class from documents, p where regexp_matches(text, pattern) group by doc_id) group by 1""")
def j10(t):
    rules = ((1, "^Licensed under", "license"), (2, "All rights reserved", "rights"), (3, "@[a-z]+\\.", "mail"))
    first = F.coalesce(*[F.when(F.col("text").rlike(p), c) for _, p, c in rules])
    return t("documents").select(first.alias("class")).where("class is not null").groupBy("class").agg(F.count("*").alias("n"))


@query("j11_overlap", """with a as (select l_orderkey k, list(distinct l_partkey) p from lineitem group by 1),
h as (select p_partkey from part where p_size > 48)
select count(*) as n from a where list_has_any(p, (select list(p_partkey) from h))""")
def j11(t):
    hot = t("part").where("p_size > 48").select(F.col("p_partkey").alias("l_partkey"))
    return t("lineitem").join(hot, "l_partkey", "left_semi").agg(F.countDistinct("l_orderkey").alias("n"))


@query("j12_self_hash", "select sha256(text) as h, count(*) as n, min(doc_id) as first_id from documents group by 1 having count(*) > 1")
def j12(t):
    return t("documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("j13_nested_scoring", """select p_partkey as id, sum(case when tok = q then 2 when contains(tok, q) or contains(q, tok) then 1 else 0 end) as score
from (select p_partkey, unnest(string_split(lower(p_type), ' ')) tok from part), (values ('standard'), ('econ'), ('med')) v(q) group by 1 having score > 0""")
def j13(t):
    parts = t("part")
    terms = parts.sparkSession.createDataFrame([("standard",), ("econ",), ("med",)], "q string")
    tokens = parts.select(F.col("p_partkey").alias("id"), F.explode(F.split(F.lower("p_type"), " ")).alias("tok"))
    points = F.when(F.col("tok") == F.col("q"), 2).when(F.contains("tok", F.col("q")) | F.contains("q", F.col("tok")), 1).otherwise(0)
    return tokens.join(F.broadcast(terms)).groupBy("id").agg(F.sum(points).alias("score")).where("score > 0")


# ---- aggregates ----------------------------------------------------------

@query("a1_conditional", "select count(*) as n, count_if(l_discount > 0.05) as discounted, count_if(l_returnflag = 'R') as returned, sum(case when l_tax = 0 then 1 else 0 end) as untaxed from lineitem")
def a1(t):
    return t("lineitem").agg(F.count("*").alias("n"), F.count_if(F.col("l_discount") > 0.05).alias("discounted"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.sum(F.when(F.col("l_tax") == 0, 1).otherwise(0)).alias("untaxed"))


@query("a2_ratio", "select c_nationkey, round(case when count(o_orderkey) > 0 then count_if(o_orderstatus = 'F') / count(o_orderkey) else 1.0 end, 6) as rate from customer left join orders on c_custkey = o_custkey group by 1")
def a2(t):
    j = t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.groupBy("c_nationkey").agg(F.round(score.ratio(F.count_if(F.col("o_orderstatus") == "F"), F.count("o_orderkey")), 6).alias("rate"))


@query("a3_count_by_type", "select event_type, count(*) as n from events group by 1")
def a3(t):
    return t("events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("a4_pivot", """select l_suppkey as file, count_if(l_returnflag = 'A') as a, count_if(l_returnflag = 'R') as r,
list_sort(list(distinct l_linestatus))[:6] as receivers from lineitem group by 1""")
def a4(t):
    return t("lineitem").groupBy(F.col("l_suppkey").alias("file")).agg(F.count_if(F.col("l_returnflag") == "A").alias("a"), F.count_if(F.col("l_returnflag") == "R").alias("r"), F.slice(F.array_sort(F.collect_set("l_linestatus")), 1, 6).alias("receivers"))


@query("a5_hotspots", """with c as (select l_suppkey file, case l_returnflag when 'R' then 'unresolved' when 'A' then 'dynamic' else 'local' end resolution, l_linestatus receiver from lineitem),
w as (select l_suppkey file, count(distinct l_partkey % 7) workflows from lineitem group by 1)
select file, count_if(resolution = 'unresolved') as unresolved, count_if(resolution = 'dynamic') as "dynamic",
list_sort(list(distinct receiver))[:6] as receivers, max(workflows) as workflows, count(*) * greatest(1, max(workflows)) as score
from c join w using (file) where resolution <> 'local' group by 1""")
def a5(t):
    lines = t("lineitem")
    kind = F.when(F.col("l_returnflag") == "R", "unresolved").when(F.col("l_returnflag") == "A", "dynamic").otherwise("local")
    calls = lines.select(F.col("l_suppkey").alias("file"), kind.alias("resolution"), F.col("l_linestatus").alias("receiver"))
    return findings.hotspots(calls, lines.select(F.col("l_suppkey").alias("file"), (F.col("l_partkey") % 7).alias("workflow")))


@query("a6_anonymous", "select user_id as file, count_if(regexp_matches(event_type, '^(view|click)')) as n from events group by 1")
def a6(t):
    return t("events").groupBy(F.col("user_id").alias("file")).agg(F.count_if(F.col("event_type").rlike("^(view|click)")).alias("n"))


def nation_signals(t) -> DataFrame:
    """Nations as workflows: four signals, one of them null where thin."""
    j = t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey"))
    wide = j.groupBy(F.col("c_nationkey").alias("workflow")).agg(
        (F.count_if(F.col("o_orderstatus") == "F") / F.count("*")).alias("parseIntegrity"), (F.count_if(F.col("o_totalprice") > 100000) / F.count("*")).alias("resolutionRate"),
        (F.count_if(F.col("c_acctbal") > 0) / F.count("*")).alias("testPresence"), F.when(F.col("workflow") % 3 != 0, F.count_if(F.col("o_orderpriority") == "5-LOW") / F.count("*")).alias("stability"),
    )
    rows = F.array(*[F.struct(F.lit(k).alias("signal"), F.col(k).alias("value"), F.lit(w).alias("weight")) for k, w in score.WEIGHTS.items()])
    return wide.select("workflow", F.explode(rows).alias("s")).select("workflow", "s.*")


SIGNALS_SQL = """wide as (select c_nationkey workflow, count_if(o_orderstatus = 'F') / count(*) p, count_if(o_totalprice > 100000) / count(*) r, count_if(c_acctbal > 0) / count(*) te,
 case when c_nationkey % 3 <> 0 then count_if(o_orderpriority = '5-LOW') / count(*) end s from customer join orders on c_custkey = o_custkey group by 1),
sig as (select workflow, 'parseIntegrity' signal, p as value, 0.3::double weight from wide union all select workflow, 'resolutionRate', r, 0.25 from wide
 union all select workflow, 'testPresence', te, 0.25 from wide union all select workflow, 'stability', s, 0.1 from wide),
sc as (select workflow, sum(value * weight) / sum(case when value is not null then weight end) score, sum(case when value is not null then weight else 0 end) / sum(weight) cov from sig group by 1)"""


@query("a7_weighted_mean", f"with {SIGNALS_SQL} select workflow, round(score, 6) as score, round(cov, 6) as signal_coverage from sc")
def a7(t):
    return score.workflow_scores(nation_signals(t)).select("workflow", F.round("score", 6).alias("score"), F.round("signal_coverage", 6).alias("signal_coverage"))


@query("a8_explain", f"""with {SIGNALS_SQL}, e as (select *, case when value is not null then weight / sum(case when value is not null then weight end) over (partition by workflow) else 0 end eff from sig)
select workflow, signal, round(eff * coalesce(value, 0), 6) as contribution, round(eff * (1 - coalesce(value, 0)), 6) as cost, value is null as unavailable from e""")
def a8(t):
    return score.explain(nation_signals(t)).select("workflow", "signal", F.round("contribution", 6).alias("contribution"), F.round("cost", 6).alias("cost"), "unavailable")


@query("a9_repo_confidence", f"""with {SIGNALS_SQL}, n as (select c_nationkey workflow, count(*) n_files from customer group by 1)
select round(sum(score * n_files) / sum(n_files), 6) as mean, round(0.9 * (sum(score * n_files) / sum(n_files)) + 0.1 * ((select count(distinct o_custkey) from orders) / (select count(*) from customer)), 6) as repo_confidence from sc join n using (workflow)""")
def a9(t):
    sizes = t("customer").groupBy(F.col("c_nationkey").alias("workflow")).agg(F.count("*").alias("n_files"))
    covered, files = t("orders").select("o_custkey").distinct().count(), t("customer").count()
    return score.repo_confidence(score.workflow_scores(nation_signals(t)), sizes, covered, files).select(F.round("mean", 6).alias("mean"), F.round("repo_confidence", 6).alias("repo_confidence"))


@query("a10_signal_coverage", f"""with {SIGNALS_SQL}, n as (select c_nationkey workflow, count(*) n_files from customer group by 1)
select round(sum(cov * n_files) / sum(n_files), 6) as coverage from sc join n using (workflow)""")
def a10(t):
    sizes = t("customer").groupBy(F.col("c_nationkey").alias("workflow")).agg(F.count("*").alias("n_files"))
    return score.workflow_scores(nation_signals(t)).join(sizes, "workflow").agg(F.round(F.sum(F.col("signal_coverage") * F.col("n_files")) / F.sum("n_files"), 6).alias("coverage"))


NORMAL_SQL = "trim(regexp_replace(regexp_replace(lower(text), '[0-9]+', '#', 'g'), '\\s+', ' ', 'g'))"


@query("a11_duplicate_groups", f"select substr(sha1({NORMAL_SQL}), 1, 16) as shape_hash, count(*) as n, list_sort(list(distinct cast(doc_id as varchar))) as files from documents group by 1 having count(*) > 1")
def a11(t):
    shapes = t("documents").select(F.col("doc_id").cast("string").alias("file"), F.substring(F.sha1(T.normal_form(F.col("text"))), 1, 16).alias("shape_hash"))
    return findings.duplicate_groups(shapes)


RULES = {"license": "(?m)^Licensed under", "mail": "[a-z]+@[a-z]+\\.[a-z]+", "token": "token = \"[0-9a-f]+\"", "rights": "All rights reserved"}


@query("a12_pattern_rules", " union all ".join(
    f"select '{k}' as rule, sum(len(regexp_extract_all(text, '{v}'))) as occurrences, count(*) as n_files, min(doc_id) as first_file from documents where regexp_matches(text, '{v}') having count(*) > 0" for k, v in sorted(RULES.items())))
def a12(t):
    return findings.pattern_rules(t("documents"), RULES, "doc_id")


@query("a13_cluster_max", "select p_brand as cluster, max(p_retailprice) as priority, list_sort(list(distinct p_size)) as kinds from part group by 1")
def a13(t):
    return t("part").groupBy(F.col("p_brand").alias("cluster")).agg(F.max("p_retailprice").alias("priority"), F.array_sort(F.collect_set("p_size")).alias("kinds"))


@query("a14_severity_histogram", "select o_orderpriority as severity, count(*) as n from orders group by 1")
def a14(t):
    return t("orders").groupBy(F.col("o_orderpriority").alias("severity")).agg(F.count("*").alias("n"))


@query("a15_gate_conjunction", "select l_orderkey, bool_and(l_quantity > 2) as passed from lineitem group by 1")
def a15(t):
    return t("lineitem").groupBy("l_orderkey").agg(F.bool_and(F.col("l_quantity") > 2).alias("passed"))


@query("a16_verdict", "with c as (select max(case o_orderstatus when 'F' then 2 when 'P' then 1 else 0 end) as code from orders) select code, ['pass', 'warn', 'fail'][code + 1] as verdict from c")
def a16(t):
    gates = t("orders").select(F.when(F.col("o_orderstatus") == "F", "fail").when(F.col("o_orderstatus") == "P", "warn").otherwise("pass").alias("status"))
    return diff.verdict(gates)


@query("a17_env_keys", """select k as key, count(*) as n, count(distinct doc) as files from (
select conv_id doc, unnest(regexp_extract_all(lower(text), '[a-z]{9,}')) k from conversations) group by 1""")
def a17(t):
    keys = t("conversations").select(F.col("conv_id").alias("doc"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{9,}"), F.lit(0))).alias("key"))
    return keys.groupBy("key").agg(F.count("*").alias("n"), F.countDistinct("doc").alias("files"))


@query("a18_sets", "select c_mktsegment, list_sort(list(distinct c_nationkey)) as nations from customer group by 1")
def a18(t):
    return t("customer").groupBy("c_mktsegment").agg(F.array_sort(F.collect_set("c_nationkey")).alias("nations"))


# ---- windows -------------------------------------------------------------

@query("w1_first_match", "select l_orderkey, l_linenumber, l_partkey from lineitem qualify row_number() over (partition by l_orderkey order by l_linenumber) = 1")
def w1(t):
    """Among lines of one number the first in the table, as the SQL's engine has it."""
    place = F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")
    lines = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *place)
    return graph.first_per(lines, ["l_orderkey"], "l_linenumber", "_file", "_row").drop("_file", "_row")


@query("w2_share", "select n_name, round(count(*) / sum(count(*)) over (), 9) as share from customer join nation on c_nationkey = n_nationkey group by 1")
def w2(t):
    counts = t("customer").groupBy("c_nationkey").agg(F.count("*").alias("n")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("n_name", F.round(F.col("n") / F.col("total"), 9).alias("share"))


@query("w3_effective_weight", f"with {SIGNALS_SQL} select workflow, signal, round(case when value is not null then weight / sum(case when value is not null then weight end) over (partition by workflow) else 0 end, 9) as effective from sig")
def w3(t):
    return score.explain(nation_signals(t)).select("workflow", "signal", F.round("effective", 9).alias("effective"))


@query("w4_task_order", "select c_nationkey, c_custkey, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) as place from customer")
def w4(t):
    w = Window.partitionBy("c_nationkey").orderBy(F.col("c_acctbal").desc(), "c_custkey")
    return t("customer").select("c_nationkey", "c_custkey", F.row_number().over(w).alias("place"))


@query("w5_summarize_turns", "select conv_id, turn, row_number() over (partition by conv_id order by turn desc, text) <= 6 as kept, case when row_number() over (partition by conv_id order by turn desc, text) <= 6 then text else substr(text, 1, 80) end as summary from conversations")
def w5(t):
    return ordering.summarize_turns(t("conversations")).select("conv_id", "turn", "kept", "summary")


@query("w6_pack", """with one as (select conv_id, turn, text, length(text) n from conversations where length(trim(text)) > 0 qualify row_number() over (partition by conv_id, trim(text) order by turn desc, turn) = 1),
p as (select *, coalesce(sum(n) over (partition by conv_id order by turn desc rows between unbounded preceding and 1 preceding), 0) b from one)
select conv_id, turn, substr(text, 1, cast(500 - b as int)) as packed from p where b < 500""")
def w6(t):
    items = t("conversations").select("conv_id", F.col("turn").alias("ord"), "text", F.col("turn").alias("priority"))
    return ordering.pack(items, 500, ["conv_id"]).select("conv_id", F.col("ord").alias("turn"), "packed")


@query("w7_greedy_fill", """with recursive o as (select p_brand, p_partkey id, p_size::double effort, p_retailprice lift,
  row_number() over (partition by p_brand order by p_retailprice / p_size::double desc, p_retailprice desc, p_partkey) pos from part where p_size > 0),
f as (select distinct p_brand, 0::bigint pos, 120.0::double rest, false took, null::bigint id, null::double effort, null::double lift from o
  union all select o.p_brand, o.pos, case when o.effort <= f.rest then f.rest - o.effort else f.rest end, o.effort <= f.rest, o.id, o.effort, o.lift from f join o on o.p_brand = f.p_brand and o.pos = f.pos + 1)
select p_brand, id, effort, lift from f where took""")
def w7(t):
    tasks = t("part").select("p_brand", F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("effort"), F.col("p_retailprice").alias("lift"))
    return ordering.greedy_fill(tasks, 120.0, ["p_brand"])


@query("w8_candidate_index", "select n_regionkey, n_name, 3 + row_number() over (partition by n_regionkey order by n_name) as idx from nation")
def w8(t):
    return t("nation").select("n_regionkey", "n_name", (F.lit(3) + F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_name"))).alias("idx"))


@query("w9_repeated_failure", "select user_id as run, event_id as attempt, coalesce(event_type = lag(event_type) over (partition by user_id order by event_id), false) as repeated from events")
def w9(t):
    attempts = t("events").select(F.col("user_id").alias("run"), F.col("event_id").alias("attempt"), F.col("event_type").alias("signature"))
    return ordering.repeated_failures(attempts).select("run", "attempt", "repeated")


@query("w10_snapshot_delta", "with m as (select c_nationkey k, year(o_orderdate) y, count(*) n from orders join customer on o_custkey = c_custkey group by 1, 2) select k, y, n - lag(n) over (partition by k order by y) as delta from m")
def w10(t):
    yearly = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("k"), F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))
    return ordering.previous_delta(yearly, ["k"], "y", "n").select("k", "y", "delta")


# ---- order and sets ------------------------------------------------------

@query("o1_hotspots_top", "select l_partkey, count(*) as n from lineitem group by 1 order by n desc, l_partkey limit 10")
def o1(t):
    return ordering.top(t("lineitem").groupBy("l_partkey").agg(F.count("*").alias("n")), 10, F.col("n").desc(), "l_partkey")


@query("o3_weak_workflows", f"with {SIGNALS_SQL} select workflow, round(score, 6) as score from sc order by score, workflow limit 5")
def o3(t):
    return ordering.top(score.workflow_scores(nation_signals(t)), 5, "score", "workflow").select("workflow", F.round("score", 6).alias("score"))


@query("o6_lift_per_effort", "select p_partkey, round(p_retailprice / p_size, 6) as rate from part order by p_retailprice / p_size desc, p_retailprice desc, p_partkey limit 20")
def o6(t):
    rate = F.col("p_retailprice") / F.col("p_size")
    return ordering.top(t("part"), 20, rate.desc(), F.col("p_retailprice").desc(), "p_partkey").select("p_partkey", F.round(rate, 6).alias("rate"))


@query("o7_fix_target", """select o_orderkey as id, o_orderpriority as source, case o_orderpriority when '1-URGENT' then 'high' when '2-HIGH' then 'medium' else 'low' end as severity, o_totalprice / 1000000 as priority
from orders order by case o_orderpriority when '1-URGENT' then 3 when '2-HIGH' then 2 else 1 end * 1000 + o_totalprice / 1000000 desc, source, id limit 1""")
def o7(t):
    severity = F.when(F.col("o_orderpriority") == "1-URGENT", "high").when(F.col("o_orderpriority") == "2-HIGH", "medium").otherwise("low")
    return findings.fix_target(t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("source"), severity.alias("severity"), (F.col("o_totalprice") / 1000000).alias("priority")))


@query("o8_missing_priority", "select doc_id, coalesce(quality, -1) as priority from documents left join labels using (doc_id) order by coalesce(quality, -1) desc, doc_id limit 50")
def o8(t):
    return ordering.top(t("documents").select("doc_id").join(t("labels").select("doc_id", "quality"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("priority")), 50, F.col("priority").desc(), "doc_id")


@query("o9_scope", "select c_custkey from customer where c_nationkey in (select c_nationkey from customer group by 1 order by count(*) desc, 1 limit 3)")
def o9(t):
    largest = ordering.top(t("customer").groupBy("c_nationkey").agg(F.count("*").alias("n")), 3, F.col("n").desc(), "c_nationkey")
    return t("customer").join(largest, "c_nationkey", "left_semi").select("c_custkey")


@query("u1_union_all", "select 'c' as kind, c_nationkey as k from customer union all select 's', s_nationkey from supplier")
def u1(t):
    return t("customer").select(F.lit("c").alias("kind"), F.col("c_nationkey").alias("k")).unionByName(t("supplier").select(F.lit("s").alias("kind"), F.col("s_nationkey").alias("k")))


@query("u2_union_distinct", "select c_nationkey as k from customer union select s_nationkey from supplier")
def u2(t):
    return t("customer").select(F.col("c_nationkey").alias("k")).union(t("supplier").select("s_nationkey")).distinct()


@query("u3_except", "select p_partkey as k from part except select l_partkey from lineitem where l_quantity > 49")
def u3(t):
    return t("part").select(F.col("p_partkey").alias("k")).subtract(t("lineitem").where("l_quantity > 49").select("l_partkey"))


@query("u4_set_equality", "select l_orderkey, list_sort(list(distinct l_returnflag)) = ['N'] as same from lineitem group by 1")
def u4(t):
    return t("lineitem").groupBy("l_orderkey").agg((F.array_sort(F.collect_set("l_returnflag")) == F.array(F.lit("N"))).alias("same"))


@query("u5_superset", "select user_id, list_sort(list_filter(['click', 'purchase', 'view'], lambda x: not list_contains(list(distinct event_type), x))) as missing from events group by 1")
def u5(t):
    return t("events").groupBy("user_id").agg(F.array_sort(F.array_except(F.array(*map(F.lit, ("click", "purchase", "view"))), F.collect_set("event_type"))).alias("missing"))


@query("u6_ordered_dedup", "select user_id, event_type, min(event_id) as event_id from events group by 1, 2")
def u6(t):
    return graph.first_per(t("events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id")


# ---- diff, life cycle, clusters ------------------------------------------

CUT, LINE_CUT = "1996-01-01", "1998-06-01"


@query("d1_diff", f"""with a as (select o_custkey w, avg(case when o_orderstatus = 'F' then 1.0 else 0 end) s from orders where o_orderdate < timestamp '{CUT}' group by 1),
b as (select o_custkey w, avg(case when o_orderstatus = 'F' then 1.0 else 0 end) s from orders where o_orderdate >= timestamp '{CUT}' group by 1)
select 'workflow-removed' as kind, 'high' as severity, cast(w as varchar) as subject from a where w not in (select w from b)
union all select 'workflow-added', 'info', cast(w as varchar) from b where w not in (select w from a)
union all select 'confidence-regression', case when a.s - b.s >= 0.25 then 'high' else 'medium' end, cast(w as varchar) from a join b using (w) where a.s - b.s >= 0.1""")
def d1(t):
    part = lambda cond: t("orders").where(cond).groupBy(F.col("o_custkey").alias("workflow")).agg(F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)).alias("score"), F.lit(False).alias("degraded"))
    return diff.workflow_findings(part(f"o_orderdate < timestamp '{CUT}'"), part(f"o_orderdate >= timestamp '{CUT}'")).select("kind", "severity", "subject")


@query("d1_orphans", f"select 'new-orphans' as kind, 'low' as severity, cast(p_partkey as varchar) as subject from part where p_partkey not in (select l_partkey from lineitem where l_shipdate >= timestamp '{LINE_CUT}' and l_quantity > 49) and p_partkey in (select l_partkey from lineitem where l_shipdate < timestamp '{LINE_CUT}' and l_quantity > 49)")
def d1_orphans(t):
    unused = lambda cond: t("part").join(t("lineitem").where(cond), F.col("p_partkey") == F.col("l_partkey"), "left_anti").select(F.col("p_partkey").alias("file"))
    return diff.orphan_findings(unused(f"l_shipdate < timestamp '{LINE_CUT}' and l_quantity > 49"), unused(f"l_shipdate >= timestamp '{LINE_CUT}' and l_quantity > 49")).select("kind", "severity", "subject")


@query("d1_resolution", f"""with f as (select l_suppkey key, l_shipdate < timestamp '{LINE_CUT}' old, count_if(l_returnflag = 'R') u, 1 - count_if(l_returnflag = 'R') / count(*) r from lineitem group by 1, 2)
select 'resolution-degradation' as kind, 'medium' as severity, cast(b.key as varchar) as subject from f b join f a on a.key = b.key and b.old and not a.old where b.u - a.u > 5 and b.r - a.r < -0.03""")
def d1_resolution(t):
    part = lambda cond: t("lineitem").where(cond).groupBy(F.col("l_suppkey").alias("key")).agg(F.count_if(F.col("l_returnflag") == "R").alias("unresolved"), (1 - F.count_if(F.col("l_returnflag") == "R") / F.count("*")).alias("rate"))
    return diff.resolution_findings(part(f"l_shipdate >= timestamp '{LINE_CUT}'"), part(f"l_shipdate < timestamp '{LINE_CUT}'")).select("kind", "severity", "subject")


@query("l1_lifecycle", """with n as (select distinct o_custkey k from orders where o_orderstatus = 'F'),
p as (select c_custkey k, ['awaiting-approval','dismissed','resolved','approved','odd'][1 + c_custkey % 5] was from customer where c_custkey % 2 = 0)
select k, case when n.k is not null and was is not null and was <> 'awaiting-approval' then was when n.k is not null then 'awaiting-approval'
 when was in ('awaiting-approval','approved') then 'resolved' when was in ('dismissed','resolved') then was end as status
from n full join p using (k) where status is not null""")
def l1(t):
    new = t("orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"))
    names = F.array(*map(F.lit, ("awaiting-approval", "dismissed", "resolved", "approved", "odd")))
    old = t("customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.element_at(names, (F.col("c_custkey") % 5 + 1).cast("int")).alias("status"), F.lit(1).alias("ord"))
    return diff.lifecycle(new, old, ["k"])


@query("l2_state", "select o_orderkey, case when o_orderstatus = 'F' then 'resolved' when o_totalprice > 150000 then 'stale' else 'open' end as state from orders")
def l2(t):
    status = F.when(F.col("o_orderstatus") == "F", "resolved").otherwise("awaiting-approval")
    return t("orders").select("o_orderkey", diff.state_of(status, F.col("o_totalprice") > 150000).alias("state"))


@query("l3_freshness", "select o_orderkey, o_orderdate < (select max(o_orderdate) from orders) as stale from orders")
def l3(t):
    latest = t("orders").agg(F.max("o_orderdate").alias("latest"))
    return t("orders").crossJoin(F.broadcast(latest)).select("o_orderkey", diff.stale(F.col("o_orderdate"), F.col("latest")).alias("stale"))


@query("l4_transition", "select c_custkey as id, case when c_custkey in (1, 2, 3) and c_acctbal >= 0 then 'approved' when c_acctbal >= 0 then 'awaiting-approval' else 'dismissed' end as status from customer")
def l4(t):
    queue = t("customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") >= 0, "awaiting-approval").otherwise("dismissed").alias("status"))
    return diff.transition(queue, [1, 2, 3], "approve")


@query("l5_content_id", "select p_partkey, substr(sha256('check:'||p_brand||':'||p_name), 1, 8) as id from part")
def l5(t):
    return t("part").select("p_partkey", T.content_id(F.lit("check"), F.col("p_brand"), F.col("p_name")).alias("id"))


@query("c3_simulate", f"""with {SIGNALS_SQL}, a as (select workflow, signal, case when signal = 'testPresence' and workflow < 10 then 1.0 else value end v, weight from sig),
s2 as (select workflow, sum(v * weight) / sum(case when v is not null then weight end) s from a group by 1)
select workflow, round(score, 6) as before, round(s, 6) as after, round(s - score, 6) as delta from sc join s2 using (workflow) where s <> score""")
def c3(t):
    signals = nation_signals(t)
    overrides = signals.where("workflow < 10 and signal = 'testPresence'").select("workflow", "signal", F.lit(1.0).alias("new_value"))
    return score.simulate(signals, overrides).select("workflow", *[F.round(c, 6).alias(c) for c in ("before", "after", "delta")])


@query("c4_ceiling", f"""with {SIGNALS_SQL}, a as (select workflow, signal, case when value is null or signal = 'stability' then value else greatest(value, 1.0) end v, weight from sig),
s2 as (select workflow, sum(v * weight) / sum(case when v is not null then weight end) s from a group by 1) select workflow, round(score, 6) as score, round(s, 6) as ceiling from sc join s2 using (workflow)""")
def c4(t):
    return score.ceiling(nation_signals(t)).select("workflow", F.round("score", 6).alias("score"), F.round("ceiling", 6).alias("ceiling"))


@query("c5_delta", f"""with {SIGNALS_SQL}, e as (select *, case when value is not null then weight / sum(case when value is not null then weight end) over (partition by workflow) else 0 end * coalesce(value, 0) c from sig)
select workflow, signal, round(case when workflow >= 20 then 0 - c when workflow < 5 then c else 0 end, 6) as delta, case when workflow >= 20 then 'removed' when workflow < 5 then 'added' else 'kept' end as state from e""")
def c5(t):
    signals = nation_signals(t)
    return score.delta(signals.where("workflow >= 5"), signals.where("workflow < 20")).select("workflow", "signal", F.round("delta", 6).alias("delta"), "state")


@query("p8_weak_signals", f"with {SIGNALS_SQL} select workflow, signal from sig where value is null or value < 0.7")
def p8(t):
    return score.weak_signals(nation_signals(t)).select("workflow", "signal")


@query("m1_impact", """with f as (select l_suppkey id, list(distinct l_partkey % 40) f, count(*) occ from lineitem group by 1),
r as (select id, least(1.0, len(f) / 500.0 + occ / (500.0 * 5)) reach, list_sum(list_transform(f, lambda x: case when x % 2 = 0 then 1 else 0 end)) / len(f) safety from f)
select id, round(reach, 3) as reach, round(safety, 3) as safety, round(reach * 0.8, 3) as impact, round(reach * 0.8 * (0.5 + 0.5 * safety), 3) as priority from r""")
def m1(t):
    cell = F.col("l_partkey") % 40
    files = t("lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.collect_set(F.struct(F.concat(F.lit("src/"), cell.cast("string")).alias("file"), (cell % 2 == 0).alias("tested"))).alias("files"), F.count("*").alias("occurrences"))
    return findings.impact(files.withColumn("certainty", F.lit(0.8)), 500)


@query("k1_priority", "select o_orderkey, coalesce(case when o_orderkey % 4 = 0 then 0.77 end, case o_orderpriority when '1-URGENT' then 0.9 when '2-HIGH' then 0.6 when '3-MEDIUM' then 0.3 else 0.0 end) as priority from orders")
def k1(t):
    severity = F.when(F.col("o_orderpriority") == "1-URGENT", "high").when(F.col("o_orderpriority") == "2-HIGH", "medium").when(F.col("o_orderpriority") == "3-MEDIUM", "low")
    return t("orders").select("o_orderkey", findings.priority_of(severity, F.when(F.col("o_orderkey") % 4 == 0, 0.77)).alias("priority"))


@query("k2_solutions")
def k2(t):
    items = t("supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.when(F.col("s_suppkey") % 9 == 0, "architecture").otherwise("pattern").alias("tier"), F.lit(0.6).alias("priority"),
                                 F.array(F.col("s_nationkey").cast("string"), F.concat(F.lit("b"), F.floor(F.col("s_acctbal") / 50).cast("string"))).alias("files"), (F.col("s_suppkey") % 10 == 0).alias("stale"))
    wf = t("nation").select(F.col("n_regionkey").cast("string").alias("workflow"), F.col("n_nationkey").cast("string").alias("file"))
    edges = t("customer").select(F.col("c_custkey").cast("string").alias("src"), F.col("c_nationkey").cast("string").alias("dst"))
    return findings.solutions(items, wf, edges, t("nation").select(F.col("n_nationkey").cast("string").alias("file")))


@query("k4_candidates", f"""with {SIGNALS_SQL}, n as (select c_nationkey workflow, count(*) n_files from customer group by 1),
e as (select workflow, signal, case when value < 1 then (1 - value) * weight / sum(case when value is not null then weight end) over (partition by workflow) end g, value from sig)
select workflow, signal, round(case when value < 1 then g end * n_files / (select sum(n_files) from n) * 0.9, 9) as lift from e join n using (workflow) where g > 0""")
def k4(t):
    sizes = t("customer").groupBy(F.col("c_nationkey").alias("workflow")).agg(F.count("*").alias("n_files"))
    return findings.plan_candidates(nation_signals(t), sizes).select("workflow", "signal", F.round("lift", 9).alias("lift"))


# ---- search and text -----------------------------------------------------

@query("q1_search", """with r as (select p_partkey, 7 * len(list_filter(string_split(lower(p_name), ' '), lambda x: x = 'small')) * 2
 + 7 * case when not list_contains(string_split(lower(p_name), ' '), 'small') then len(list_filter(regexp_split_to_array(regexp_replace(lower(p_name), '[^a-z0-9_#]+', ' ', 'g'), ' '), lambda x: len(x) >= 2 and (contains(x, 'small') or contains('small', x)))) else 0 end
 + 28 * (contains(lower(p_name), 'small'))::int as score from part) select p_partkey, score from r where score > 0""")
def q1(t):
    return search.search(t("part").select("p_partkey", F.col("p_name").alias("function")), "small", {"function": 7}).select("p_partkey", "score")


@query("q1_fields")
def q1_fields(t):
    rows = t("part").select("p_partkey", F.col("p_name").alias("function"), F.col("p_brand").alias("file"), F.col("p_type").alias("calls"))
    return search.search(rows, "steel brand", {k: search.FIELD_WEIGHTS[k] for k in ("function", "file", "calls")})


@query("q3_grounding", "select distinct l_suppkey * 2 as claim from lineitem except select s_suppkey from supplier")
def q3(t):
    return search.ungrounded(t("lineitem").select((F.col("l_suppkey") * 2).alias("claim")), t("supplier").select(F.col("s_suppkey").alias("claim")))


@query("s9_links", "select href, count(*) as n from (select unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) href from pages) group by 1")
def s9(t):
    pages = t("pages").select(F.col("url").alias("file"), F.col("html").alias("text"))
    return tag_attributes(pages, "a").select(F.col("attributes")["href"].alias("href")).groupBy("href").agg(F.count("*").alias("n"))


@query("s7_json", "select cast(json_extract(props, '$.k') as int) as k, count(*) as n from events group by 1")
def s7(t):
    return t("events").select(F.from_json("props", "k int").getField("k").alias("k")).groupBy("k").agg(F.count("*").alias("n"))


@query("x11_claims", """select claim, count(*) as n from (select unnest(list_distinct(regexp_extract_all(url, '([A-Za-z0-9_@./-]+\\.(?:js|ts|jsx|tsx|mjs|cjs|py|go|rs|rb|java|php|json|md|html))\\b', 1))) claim from pages) group by 1""")
def x11(t):
    return t("pages").select(F.explode(search.path_claims(F.col("url"))).alias("claim")).groupBy("claim").agg(F.count("*").alias("n"))


@query("f_redact", """select doc_id, sha256(regexp_replace(text, '(?i)\\b([A-Z0-9_]*(?:KEY|TOKEN|SECRET|PASSWORD)\\s*=\\s*)"?[A-Za-z0-9_./+=-]{8,}"?', '\\1[REDACTED]', 'g')) as digest from documents""")
def f_redact(t):
    return t("documents").select("doc_id", F.sha2(T.redact(F.col("text")), 256).alias("digest"))


@query("f_clip", "select conv_id, turn, case when length(text) > 40 then substr(text, 1, 39)||'…' else text end as clipped from conversations")
def f_clip(t):
    return t("conversations").select("conv_id", "turn", T.clip(F.col("text"), 40).alias("clipped"))


@query("f_bar", "select p_partkey, repeat('█', cast(round(p_size / 50.0 * 10) as int))||repeat('░', 10 - cast(round(p_size / 50.0 * 10) as int)) as bar from part")
def f_bar(t):
    return t("part").select("p_partkey", T.bar(F.col("p_size") / 50.0).alias("bar"))


# ---- streams, as batches -------------------------------------------------

@query("t1_debounce", """with b as (select user_id, ts, coalesce(epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts)) >= 7200000000, true) new from events),
s as (select *, sum(new::int) over (partition by user_id order by ts range between unbounded preceding and current row) as burst from b)
select user_id, burst, min(ts) as first_at, max(ts) as last_at, count(*) as n from s group by 1, 2""")
def t1(t):
    return ordering.debounce(t("events"), "user_id", "ts", 7200)


@query("t2_sessions", """with b as (select user_id, ts, coalesce(epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts)) >= 21600000000, true) new from events),
s as (select *, sum(new::int) over (partition by user_id order by ts range between unbounded preceding and current row) as g from b)
select user_id, min(ts) as session_start, count(*) as n from s group by user_id, g""")
def t2(t):
    return remap.sessions(t("events"), "6 hours")


@query("t3_windows", "select event_type, date_trunc('day', ts) as day, count(*) as n from events group by 1, 2")
def t3(t):
    return remap.windowed_counts(t("events"), "1 day").withColumnRenamed("start", "day")


# ---- predicates, resolution and reports ----------------------------------

@query("p1_glob", "select page_id from pages where regexp_matches(regexp_replace(url, '^https?://', ''), '^[^/]*/en/[^/]*$')")
def p1(t):
    return t("pages").where(F.regexp_replace("url", "^https?://", "").rlike(P.glob_regex("*/en/*"))).select("page_id")


@query("p3_test_paths", "select page_id, regexp_matches(url, '(\\.test\\.|\\.spec\\.|__tests__/|(^|/)tests?/)') as anchored, regexp_matches(url, '(\\.test\\.|\\.spec\\.|__tests__/|tests?/)') as anywhere from pages")
def p3(t):
    return t("pages").select("page_id", P.is_test_file(F.col("url")).alias("anchored"), P.has_test_path(F.col("url")).alias("anywhere"))


@query("p5_header", "select doc_id, coalesce(regexp_matches(lower(substr(text, 1, 300)), '@generated|auto-?generated|generated by|do not edit'), false) as made from documents")
def p5(t):
    return t("documents").select("doc_id", has_generated_header(F.col("text")).alias("made"))


@query("p13_intents", "select conv_id, turn, 'unknown' as asked from conversations")
def p13(t):
    """Prose asks for nothing."""
    return t("conversations").select("conv_id", "turn", requests.operation(F.col("text")).alias("asked"))


#: requests about an order, and what each asks for, by the order's number
REQUESTS = (
    ("Why was finding f$ flagged?", "evidence", "'f$'", "null", "null", "null"),
    ("please dismiss finding f$ because customer @ said so", "dismiss", "'f$'", "'customer @ said so'", "null", "null"),
    ("Approve finding f$.", "approve", "'f$'", "null", "null", "null"),
    ("trace src/order/o$.ts to src/customer/c@.ts", "trace", "null", "null", "['src/order/o$.ts', 'src/customer/c@.ts']", "null"),
    ("is src/order/o$.ts reachable", "trace", "null", "null", "['src/order/o$.ts']", "null"),
    ("find code related to order $", "find", "null", "null", "null", "'order $'"),
    ("Run the tests", "test", "null", "null", "null", "null"),
    ("why did the confidence drop", "score-delta", "null", "null", "null", "null"),
    ("which files are untested", "test-gaps", "null", "null", "null", "null"),
    ("order $ was late", "unknown", "null", "null", "null", "null"),
)


def _requests_sql() -> str:
    put = lambda text: "replace(replace(" + text + ", '$', o_orderkey::varchar), '@', o_custkey::varchar)"
    one = lambda v: "null::varchar" if v == "null" else put(v)
    many = lambda v: "null::varchar[]" if v == "null" else "[" + ", ".join(put(x.strip()) for x in v[1:-1].split(",")) + "]"
    rows = [f"select o_orderkey, '{op}' as operation, {one(a)} as finding, {one(b)} as reason, {many(c)} as files, {one(d)} as query from orders where o_orderkey % {len(REQUESTS)} = {k}" for k, (_, op, a, b, c, d) in enumerate(REQUESTS)]
    return " union all ".join(rows)


@query("p13_requests", _requests_sql())
def p13_requests(t):
    """A request about every order, with what it names."""
    said = F.element_at(F.array(*[F.lit(r[0]) for r in REQUESTS]), (F.col("o_orderkey") % len(REQUESTS) + 1).cast("int"))
    text = F.replace(F.replace(said, F.lit("$"), F.col("o_orderkey").cast("string")), F.lit("@"), F.col("o_custkey").cast("string"))
    return requests.request_of(t("orders").withColumn("text", text)).select("o_orderkey", "request.operation", "request.finding", "request.reason", "request.files", "request.query")


@query("r1_first_existing", """with c as (select l_orderkey, l_linenumber, l_partkey, unnest([l_partkey + 100000, l_partkey * 2, l_partkey]) cand, unnest([0, 1, 2]) pos from lineitem)
select l_orderkey, l_linenumber, l_partkey, cast(arg_min(cand, pos) as varchar) as target from c where cand in (select p_partkey from part) group by 1, 2, 3""")
def r1(t):
    refs = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.transform(F.array(F.col("l_partkey") + 100000, F.col("l_partkey") * 2, F.col("l_partkey")), lambda x: x.cast("string")).alias("candidates"))
    return resolve.first_existing(refs, t("part").select(F.col("p_partkey").cast("string").alias("file")), ["l_orderkey", "l_linenumber", "l_partkey"])


@query("r15_unique_names", "select p_name||p_brand||p_size as name, min(p_partkey) as id from part group by 1 having count(distinct p_partkey) = 1")
def r15(t):
    return resolve.unique_names(t("part").select(F.concat("p_name", "p_brand", F.col("p_size").cast("string")).alias("name"), F.col("p_partkey").alias("id")))


@query("r14_calls", """with f as (select distinct 's'||l_suppkey file, 'p'||l_partkey name from lineitem),
c as (select file, name fn, unnest(['p'||(substr(name, 2)::bigint + 1), 'q.'||name]) as call, 's'||(substr(file, 2)::bigint + 1) to_file from f),
u as (select name, min(file) file from f group by 1 having count(*) = 1)
select c.file, fn, c.call, split_part(c.call, '.', 1) as receiver,
 case when l.name is not null then c.file||'#'||c.call when contains(c.call, '.') then null when d.name is not null then c.to_file||'#'||c.call when u.name is not null then u.file||'#'||c.call end as to_id,
 case when l.name is not null then 'local' when contains(c.call, '.') then 'dynamic' when d.name is not null or u.name is not null then 'cross-file' else 'unresolved' end as resolution
from c left join f l on l.file = c.file and l.name = c.call left join f d on d.file = c.to_file and d.name = c.call left join u on u.name = c.call""")
def r14(t):
    """Suppliers as files that define parts and import the next part from the
    next supplier."""
    file, after = F.concat(F.lit("s"), F.col("s").cast("string")), F.concat(F.lit("p"), (F.col("p") + 1).cast("string"))
    name = F.concat(F.lit("p"), F.col("p").cast("string"))
    lines = t("lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p"))
    #: written once, in order: what is dealt from it is half as large
    made = cut(lines.repartitionByRange("s", "p").distinct().sortWithinPartitions("s", "p"), "made")
    functions = made.select(file.alias("file"), name.alias("name"), F.lit(True).alias("exported"), F.lit(None).cast("string").alias("receiver"), F.array(after, F.concat(F.lit("q."), name)).alias("calls"))
    imports = made.select(file.alias("file"), F.col("p").alias("seq"), F.array(after).alias("names"))
    edges = made.select(file.alias("file"), F.col("p").alias("seq"), F.concat(F.lit("s"), (F.col("s") + 1).cast("string")).alias("to_file"))
    return resolve.resolve_calls(functions, imports, edges)


@query("e12_roots", "select p_partkey from part where p_partkey not in (select l_partkey from lineitem where l_quantity = 50)")
def e12(t):
    edges = t("lineitem").where("l_quantity = 50").select(F.col("l_partkey").alias("to_file"))
    return import_roots(t("part").select(F.col("p_partkey").alias("file")), edges).withColumnRenamed("file", "p_partkey")


@query("m2_architecture", f"""with {SIGNALS_SQL}, n as (select c_nationkey workflow, count(*) n_files from customer group by 1), t as (select count(*) c from customer)
select 'fragile' as rule, cast(workflow as varchar) as subject, 1.0 as certainty from sc where score < 0.4
union all select 'monolith', cast(workflow as varchar), 1.0 from n, t where c >= 12 and n_files > 0.7 * c
union all select 'orphan-cluster', count(*)||' files', 0.9 from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 300000) having count(*) >= 3""")
def m2(t):
    customers = t("customer")
    sizes = customers.groupBy(F.col("c_nationkey").alias("workflow")).agg(F.count("*").alias("n_files"))
    scored = score.workflow_scores(nation_signals(t)).join(sizes, "workflow").select(F.col("workflow").cast("string").alias("workflow"), "n_files", "score")
    orphans = customers.join(t("orders").where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(F.col("c_custkey").alias("file"))
    cycles = customers.sparkSession.createDataFrame([], "cycle string, members array<string>")
    return findings.architecture_rules(scored, orphans, customers.count(), 0.8, cycles)


@query("k3_handoff", """select o_orderkey as id, o_totalprice as priority from orders where o_orderstatus = 'O' and o_orderdate >= timestamp '1998-01-01' order by o_totalprice desc, o_orderkey limit 5""")
def k3(t):
    status = F.when(F.col("o_orderstatus") == "O", "awaiting-approval").otherwise("resolved")
    rows = t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("priority"), status.alias("status"), (F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp")).alias("stale"))
    return findings.handoff(rows).select("id", "priority")


@query("q2_context", """with h as (select p_partkey from part where contains(lower(p_name), 'small') order by p_partkey limit 8)
select l_suppkey as workflow, list_sort(list(distinct l_partkey)) as files from lineitem where l_partkey in (from h) group by 1""")
def q2(t):
    hits = t("part").where(F.contains(F.lower("p_name"), F.lit("small"))).select(F.col("p_partkey").alias("file"), F.lit("x").alias("function"), F.lit(1).alias("score"))
    return search.task_context(hits, t("lineitem").select(F.col("l_suppkey").alias("workflow"), F.col("l_partkey").alias("file")))


@query("f_budget_minutes", "select p_partkey, case when p_size % 2 = 0 then p_size * 60.0 else p_size * 1.0 end as minutes from part")
def f_budget(t):
    text = F.concat(F.col("p_size").cast("string"), F.when(F.col("p_size") % 2 == 0, "h").otherwise("m"))
    return t("part").select("p_partkey", T.budget_minutes(text).alias("minutes"))


@query("f_paths", "select page_id, regexp_replace(url, '/[^/]*$', '') as folder, list_last(string_split(url, '/')) as name from pages")
def f_paths(t):
    return t("pages").select("page_id", P.dirname(F.col("url")).alias("folder"), P.basename(F.col("url")).alias("name"))


# ---- scans, gates and plans ----------------------------------------------

CALLS = ("a.then", "b.catch", "url.parse", "fs.exists", "go", "util.inspect", "c.then")
CALLS_SQL = "[" + ", ".join(f"'{c}'" for c in CALLS) + "]"
NODES_SQL = f"""nodes as (select 'src/f'||l_suppkey||case when l_suppkey % 4 = 0 then '.cjs' else '.js' end file, count_if(l_linenumber = 1) vars, l_suppkey % 3 = 0 script,
 l_suppkey % 10 = 9 made, list({CALLS_SQL}[1 + l_partkey % 7]) calls from lineitem group by l_suppkey)"""


def code_nodes(t) -> DataFrame:
    """Suppliers as source files whose lines are calls."""
    key = F.col("l_suppkey")
    call = F.element_at(F.array(*map(F.lit, CALLS)), (F.col("l_partkey") % 7 + 1).cast("int"))
    grouped = t("lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_linenumber") == 1).alias("var_count"), F.collect_list(call).alias("calls"))
    return grouped.select(
        F.concat(F.lit("src/f"), key.cast("string"), F.when(key % 4 == 0, ".cjs").otherwise(".js")).alias("file"), "var_count",
        F.when(key % 3 == 0, "script").otherwise("module").alias("module_type"), F.array(F.struct(F.lit("f").alias("name"), "calls")).alias("functions"), (key % 10 == 9).alias("made"),
    )


PATTERN_SQL = {
    "var-declarations": "vars", "promise-then-chains": "len(list_filter(calls, lambda c: ends_with(c, '.then') or ends_with(c, '.catch')))",
    "deprecated-node-api": "len(list_filter(calls, lambda c: c in ('url.parse', 'fs.exists', 'util.isArray', 'querystring.parse')))",
    "cjs-in-esm-project": "(script and not ends_with(file, '.cjs'))::int",
}


def patterns_sql(where: str) -> str:
    return " union all ".join(f"select '{rule}' as rule, sum({n}) as occurrences, count(*) as n_files, min(file) as first_file from nodes where not made and {n} > 0 and {where} having count(*) > 0" for rule, n in PATTERN_SQL.items())


@query("p10_code_patterns", f"with {NODES_SQL} {patterns_sql('true')}")
def p10(t):
    nodes = code_nodes(t)
    return findings.code_patterns(nodes, generated=nodes.where("made"), package_type="module")


SCAN_SQL = f"""{NODES_SQL}, wf as (select 'wf'||(substr(regexp_extract(file, 'f[0-9]+'), 2)::bigint % 7) workflow, file from nodes),
big as (select workflow from wf group by 1 order by count(*) desc, 1 limit 3), scope as (select file from wf where workflow in (from big))"""


def scan(t, mode: str) -> DataFrame:
    nodes = code_nodes(t)
    wf = nodes.select(F.concat(F.lit("wf"), (F.regexp_extract("file", "f([0-9]+)", 1).cast("long") % 7).cast("string")).alias("workflow"), "file")
    named = F.element_at(F.array(*map(F.lit, ("moment", "request", "react", "q"))), (F.col("p_size") % 4 + 1).cast("int"))
    dependencies = t("part").select(named.alias("package")).distinct()
    lone = t("nation").where("n_nationkey < 0").select(F.col("n_name").alias("file"))
    doubles = findings.duplicate_rule(t("documents").select(F.col("doc_id").cast("string").alias("file"), F.substring(F.sha1(T.normal_form(F.col("text"))), 1, 16).alias("shape_hash")))
    return findings.modernization_scan(mode, dependencies, nodes, wf, lone, nodes.where("made"), "module", doubles)


DEPENDENCY_SQL = """select 'dependency' as tier, case n when 'moment' then 'legacy-maintenance-mode' when 'request' then 'legacy-deprecated' else 'legacy-native-replacement' end as rule, count(*) as occurrences
from (select distinct ['moment', 'request', 'react', 'q'][1 + p_size % 4] n from part) where n <> 'react' group by all"""


@query("m3_scan_light", DEPENDENCY_SQL)
def m3_light(t):
    return scan(t, "light")


@query("m3_scan_medium", f"with {SCAN_SQL} {DEPENDENCY_SQL} union all select 'pattern', rule, occurrences from ({patterns_sql('file in (from scope)')})")
def m3_medium(t):
    return scan(t, "medium")


@query("m3_scan_heavy", f"""with {SCAN_SQL} {DEPENDENCY_SQL} union all select 'pattern', rule, occurrences from ({patterns_sql('true')})
union all select 'architecture', 'duplicate-functions', count(*) from (select 1 from documents where text is not null group by {NORMAL_SQL} having count(*) > 1) having count(*) > 0""")
def m3_heavy(t):
    return scan(t, "heavy")


@query("m2_duplicates", f"""select 'duplicate-functions' as rule, n||' functions in '||array_to_string(files, ', ') as subject, 1.0::double as certainty
from (select count(*) n, list_sort(list(distinct cast(doc_id as varchar))) files from documents where text is not null group by {NORMAL_SQL} having count(*) > 1)""")
def m2_duplicates(t):
    return findings.duplicate_rule(t("documents").select(F.col("doc_id").cast("string").alias("file"), F.substring(F.sha1(T.normal_form(F.col("text"))), 1, 16).alias("shape_hash")))


def gate_rows(t) -> DataFrame:
    return diff.run_gates(
        errors=t("orders").where("o_totalprice < 0"), nodes=t("part"), checks=t("supplier").select((F.col("s_acctbal") > 0).alias("ok")),
        findings=d1(t), reports=t("orders").select((F.col("o_orderdate") < F.lit(CUT).cast("timestamp")).alias("stale")),
    )


GATES_SQL = f"""g as (select 'config' gate, case when count(*) > 0 then 'fail' else 'pass' end status, count(*) n from orders where o_totalprice < 0
union all select 'map', 'pass', 0 union all select 'doctor', case when count_if(s_acctbal <= 0) > 0 then 'warn' else 'pass' end, count_if(s_acctbal <= 0) from supplier
union all select 'regression', case when count_if(severity = 'high' and kind in ('workflow-removed', 'confidence-regression')) > 0 then 'fail' when count(*) > 0 then 'warn' else 'pass' end, count(*) from ({ORACLES['d1_diff']})
union all select 'freshness', case when count_if(o_orderdate < timestamp '{CUT}') > 0 then 'warn' else 'pass' end, count_if(o_orderdate < timestamp '{CUT}') from orders)"""


@query("k8_gates", f"with {GATES_SQL} select gate, status, n from g")
def k8_gates(t):
    return gate_rows(t)


@query("k8_verify", f"with {GATES_SQL} select case when bool_or(status = 'fail') then 'fail' when bool_or(status = 'warn') then 'warn' else 'pass' end as verdict, case when bool_or(status = 'fail') then 2 when bool_or(status = 'warn') then 1 else 0 end as exit_code from g")
def k8_verify(t):
    return diff.verify(gate_rows(t), strict=True)


@query("k4_plan", f"""with {SIGNALS_SQL}, n as (select c_nationkey workflow, count(*) n_files from customer group by 1),
e as (select workflow, signal, (1 - value) * weight / sum(case when value is not null then weight end) over (partition by workflow) g, value from sig),
lifted as (select workflow, signal, g * n_files / (select sum(n_files) from n) * 0.9 lift from e join n using (workflow) where value < 1 and g > 0 and signal <> 'stability'),
pick as (select workflow, signal from lifted qualify row_number() over (order by lift desc, workflow||':'||signal) <= 10),
a as (select workflow, signal, case when p.signal is not null then 1.0 else value end v, weight from sig left join pick p using (workflow, signal)),
s2 as (select workflow, sum(v * weight) / sum(case when v is not null then weight end) s from a group by 1)
select workflow, round(score, 6) as before, round(s, 6) as after, round(s - score, 6) as delta from sc join s2 using (workflow) where abs(s - score) > 1e-9""")
def k4_plan(t):
    """The best ten tasks of 20 minutes, none of them risky, simulated together."""
    signals = nation_signals(t)
    sizes = t("customer").groupBy(F.col("c_nationkey").alias("workflow")).agg(F.count("*").alias("n_files"))
    tasks = findings.plan_candidates(signals, sizes).select(
        F.concat_ws(":", F.col("workflow").cast("string"), "signal").alias("id"), F.lit("add-test").alias("kind"), "workflow", "signal", F.lit(1.0).alias("new_value"), F.lit(20.0).alias("effort"),
        F.when(F.col("signal") == "stability", "high").otherwise("low").alias("risk"), "lift",
    )
    _, after = findings.plan_improvements(tasks, signals, 200.0)
    return after.select("workflow", *[F.round(c, 6).alias(c) for c in ("before", "after", "delta")])


@query("o5_solutions_top", "select p_brand as cluster, max(p_retailprice) as priority from part group by 1 order by 2 desc, 1 limit 10")
def o5(t):
    return findings.top_solutions(t("part").groupBy(F.col("p_brand").alias("cluster")).agg(F.max("p_retailprice").alias("priority")), 10)


KINDS = ("parse-failure", "export-removed", "workflow-removed", "confidence-regression", "orphan", "monolith")


def part_findings(t) -> DataFrame:
    """Parts as findings about the suppliers that their lines name."""
    files = t("lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.collect_set(F.col("l_suppkey").cast("string")).alias("files"))
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n + 1).cast("int"))
    return t("part").join(files, "p_partkey", "left").select(
        F.col("p_partkey").alias("id"), pick(KINDS, F.col("p_size") % 6).alias("kind"), pick(("high", "medium", "low"), F.col("p_size") % 3).alias("severity"),
        "files", F.when(F.col("p_size") % 7 == 0, F.lit("3")).alias("workflow"),
    )


@query("k5_fix_impact", f"""with f as (select l_partkey, list(distinct l_suppkey) files from lineitem group by 1),
x as (select p_partkey id, {list(KINDS)}[1 + p_size % 6] kind, ['high', 'medium', 'low'][1 + p_size % 3] severity, files, case when p_size % 7 = 0 then ['3'] else [] end named from part left join f on l_partkey = p_partkey),
h as (select id, count(*) n, count_if(s_acctbal > 0) good, list(distinct s_nationkey::varchar) homes from (select id, unnest(files) s_suppkey from x) join supplier using (s_suppkey) where s_nationkey % 5 <> 0 group by 1),
w as (select x.*, coalesce(n, 0) n, coalesce(good, 0) good, list_sort(list_distinct(list_concat(named, coalesce(homes, [])))) wfs from x left join h using (id))
select id, case kind when 'parse-failure' then 'medium' when 'export-removed' then 'high' when 'workflow-removed' then 'high' when 'confidence-regression' then 'medium' else severity end as risk,
coalesce(len(files), 0) as n_files, n as in_workflow, good as tested, n - good as untested, array_to_string(wfs, ',') as workflows, len(wfs) as blast_radius from w""")
def k5(t):
    homes = t("supplier").where("s_nationkey % 5 <> 0").select(F.col("s_suppkey").cast("string").alias("file"), F.col("s_nationkey").cast("string").alias("workflow"))
    status = F.when(F.col("s_acctbal") > 5000, "tested-real").when(F.col("s_acctbal") > 0, "tested-shallow").otherwise("tested-nameonly")
    credit = t("supplier").select(F.col("s_suppkey").cast("string").alias("file"), status.alias("status"))
    impact = diagnose.fix_impact(part_findings(t), homes, credit)
    numbers = [F.col(c).cast("long").alias(c) for c in ("n_files", "in_workflow", "tested", "untested", "blast_radius")]
    return impact.select("id", "risk", *numbers, F.array_join("workflows", ",").alias("workflows"))


@query("k5_parse_gain", f"""with {SIGNALS_SQL}, share as (select c_nationkey workflow, count_if(c_acctbal < 0) / count(*) d from customer group by 1),
a as (select sig.workflow, signal, case when signal = 'parseIntegrity' then least(value + d, 1.0) else value end v, weight from sig join share using (workflow)),
s2 as (select workflow, sum(v * weight) / sum(case when v is not null then weight end) s from a group by 1)
select workflow, round(score, 6) as before, round(s, 6) as after, round(s - score, 6) as delta from sc join s2 using (workflow) where abs(s - score) > 1e-9""")
def k5_gain(t):
    homes = t("customer").select(F.col("c_custkey").alias("file"), F.col("c_nationkey").alias("workflow"))
    gain = diagnose.parse_gain(t("customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("file")), homes, nation_signals(t))
    return gain.select("workflow", *[F.round(c, 6).alias(c) for c in ("before", "after", "delta")])


@query("k13_health", """with b as (select distinct o_custkey k from orders where o_orderpriority <> '1-URGENT'), a as (select distinct o_custkey k from orders where o_orderpriority = '1-URGENT'),
c as (select (select count(*) from orders where o_orderpriority <> '1-URGENT') n, (select count(*) from orders where o_orderpriority = '1-URGENT') m, (select count(*) from b) p, (select count(*) from a) q)
select 'confidence-dropped' as issue, n||' -> '||m as subject from c where m < n union all select 'fewer-workflows', p||' -> '||q from c where q < p union all select 'workflow-gone', cast(k as varchar) from b anti join a using (k)""")
def k13(t):
    """Customers as workflows: those with plain orders before, with urgent ones after."""
    early = F.col("o_orderpriority") != "1-URGENT"
    orders = t("orders").select(F.col("o_custkey").alias("workflow"), early.alias("early"))
    confidence = orders.agg(F.count_if("early").alias("before"), F.count_if(~F.col("early")).alias("after"))
    return diagnose.post_apply_health(orders.where("early"), orders.where("not early"), confidence)


@query("k7_weak_workflows", f"""with {SIGNALS_SQL}, weak as (select workflow, list_sort(list(signal)) w from sig where value is null or value < 0.7 group by 1)
select workflow, round(score, 6) as score, array_to_string(coalesce(w, []), ',') as weak from sc left join weak using (workflow) where score < 0.5 or w is not null order by coalesce(sc.score, 1), workflow limit 8""")
def k7_weak(t):
    return diagnose.weak_workflows(nation_signals(t), 0.5, 8).select("workflow", F.round("score", 6).alias("score"), F.array_join("weak", ",").alias("weak"))


@query("k7_advice", """with f as (select avg(case when o_orderstatus = 'F' then 1.0 else 0 end) conf, count_if(o_orderpriority = '1-URGENT') low, count_if(o_orderpriority = '0') unresolved, count_if(o_totalprice < 0) bad from orders)
select unnest(list_filter([case when conf < 0.8 then 1 end, case when low > 0 then 2 end, case when unresolved > 0 then 3 end, case when bad > 0 then 4 end, 6], lambda x: x is not null)) as ord from f""")
def k7_advice(t):
    facts = t("orders").agg(
        F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("repo_confidence"), F.lit(0.8).alias("threshold"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("low_test_presence"),
        F.lit(1.0).alias("call_rate"), F.count_if(F.col("o_orderpriority") == "0").alias("unresolved_calls"), F.lit(0).alias("dynamic_calls"), F.count_if(F.col("o_totalprice") < 0).alias("unresolved_imports"),
        F.lit(None).cast("long").alias("unmapped_scripts"), F.count("*").alias("env_keys"), F.lit(False).alias("env_example"), F.lit(0).alias("unsupported_files"), F.lit(0).alias("heuristic_files"),
    )
    return diagnose.recommendations(facts).select("ord")


CONTEXT_KINDS = ("hit", "conversation", "workflows", "package", "findings", "changes", "task", "summary", "other")


@query("q4_context", f"""with k as (select conv_id, turn, text, {list(CONTEXT_KINDS)}[1 + turn % 9] kind, [5.0, 7.0, 8.0, 8.7, 8.8, 9.0, 9.5, 10.0, null][1 + turn % 9] pr from conversations),
one as (select *, length(text) n from k where pr is not null and length(trim(text)) > 0 qualify row_number() over (partition by conv_id, trim(text) order by pr desc, turn) = 1),
p as (select *, coalesce(sum(n) over (partition by conv_id order by pr desc, turn rows between unbounded preceding and 1 preceding), 0) b from one)
select conv_id, turn, kind, substr(text, 1, cast(700 - b as int)) as packed from p where b < 700""")
def q4(t):
    kind = F.element_at(F.array(*map(F.lit, CONTEXT_KINDS)), (F.col("turn") % 9 + 1).cast("int"))
    parts = t("conversations").select("conv_id", kind.alias("kind"), F.col("turn").alias("ord"), "text")
    return diagnose.assemble_context(parts, 700, ["conv_id"]).select("conv_id", F.col("ord").alias("turn"), "kind", "packed")
