"""Queries that analyse source code, over a tree whose files come from the tables.

Each order, customer, supplier, nation, region and part is a file, so the tree
grows with the tables:

* ``src/order/o<k>.ts`` imports its customer, reads the environment and calls
  it; filled orders (F) declare a route, urgent ones call what nobody defines;
* ``src/customer/c<k>.ts`` imports the next customer of its block of four, the
  last one the first again, so whole blocks are cycles;
* ``tests/customer/c<k>.test.ts`` uses its customer's export, only imports the
  file, or only bears its name, by the market segment;
* ``jobs/s<k>.py`` of suppliers start themselves where they have money, and odd
  ones import the next; ``packages/s<k>/package.json`` is their manifest;
* nations are declared dormant, regions bear the names of made files, parts are
  in a language that isn't read, or too large.

The SQL says from the tables alone what the analysis must find.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import graph
from ..operators.extract import env_reads, extract, functions_of
from ..operators.findings import architecture_rules, duplicate_groups, hotspots, legacy_dependencies
from ..operators.steps import StepLog
from ..sources.project import routed
from . import reports
from .project import Project, analyze
from .stored import scratch
from .tables import query

DORMANT = [("src/nation/*", "intentional-dormant")]
PACKAGES = ("bluebird", "underscore", "q", "react", "express")


def _lines(*parts: Column | str) -> Column:
    """Lines of a file; null ones are left out."""
    return F.concat(F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts]), F.lit("\n"))


def _fill(text: str, **columns: Column) -> Column:
    """A line with $name replaced by columns."""
    out, rest = [], text
    while "$" in rest:
        head, _, rest = rest.partition("$")
        name = next(n for n in sorted(columns, key=len, reverse=True) if rest.startswith(n))
        out += [F.lit(head), columns[name].cast("string")]
        rest = rest[len(name) :]
    return F.concat(*out, F.lit(rest))


def tree(t) -> DataFrame:
    """(file, text, size) of the whole tree."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    order = _lines(
        _fill('import { c$c } from "../customer/c$c";', c=c), 'import fs from "fs";', _fill("const key = process.env.CUST_$c;", c=c), _fill("export function o$k(app) {", k=k),
        F.when(F.col("o_orderstatus") == "F", _fill('  app.get("/o$k", key);', k=k)), _fill("  c$c(key);", c=c), "  fs.readFileSync(key);", "  console.log(key);",
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("  lost(key);")), "}",
    )
    own = F.col("c_custkey")
    after = F.when(own % 4 < 3, own + 1).otherwise(own - 3)
    customer = _lines(_fill('import { c$n } from "./c$n";', n=after), _fill("export function c$c(a) {", c=own), "  let t = 0;", _fill("  t += c$n(a);", n=after), "  return t;", "}")
    uses = F.when(F.col("c_mktsegment") == "BUILDING", _lines(_fill('import { c$c } from "../../src/customer/c$c";', c=own), _fill("test(c$c());", c=own))).when(
        F.col("c_mktsegment") == "MACHINERY", _lines(_fill('import "../../src/customer/c$c";', c=own), "test(1);")).when(F.col("c_mktsegment") == "AUTOMOBILE", F.lit("test(1);\n"))
    s = F.col("s_suppkey")
    job = _lines(F.when(s % 2 == 1, _fill("import jobs.s$n", n=s + 1)), "def work():", "    pass", F.when(F.col("s_acctbal") > 0, F.lit("if __name__ == '__main__':\n    work()")))
    package = F.concat(F.lit('{"dependencies": {"'), F.element_at(F.array(*map(F.lit, PACKAGES)), (F.col("s_nationkey") % 5 + 1).cast("int")), F.lit('": "1"}}'))
    name = lambda pattern, key: _fill(pattern, k=F.col(key))
    n, r = F.col("n_nationkey"), F.col("r_regionkey")
    large = F.col("p_size") == 50
    parts = [
        t("orders").select(name("src/order/o$k.ts", "o_orderkey").alias("file"), order.alias("text")),
        t("customer").select(name("src/customer/c$k.ts", "c_custkey").alias("file"), customer.alias("text")),
        t("customer").select(name("tests/customer/c$k.test.ts", "c_custkey").alias("file"), uses.alias("text")).where("text is not null"),
        t("supplier").select(name("jobs/s$k.py", "s_suppkey").alias("file"), job.alias("text")),
        t("supplier").select(name("packages/s$k/package.json", "s_suppkey").alias("file"), package.alias("text")),
        t("nation").select(_fill("src/nation/n$k.js", k=n).alias("file"), _fill("export const n$k = (a) => 1;\n", k=n).alias("text")),
        t("region").select(_fill("src/region/r$k.min.js", k=r).alias("file"), F.lit("var a=1").alias("text")),
    ]
    sized = reduce(DataFrame.unionByName, parts).withColumn("size", F.length("text").cast("long"))
    #: what isn't read needs no text, only a size
    unread = t("part").select(F.when(large, name("src/big/p$k.js", "p_partkey")).otherwise(name("native/p$k.c", "p_partkey")).alias("file"), F.lit("").alias("text"), F.when(large, 2_000_000).otherwise(10).cast("long").alias("size"))
    return sized.unionByName(unread)


def project_of(t) -> Project:
    return analyze(tree(t), DORMANT)


_NEXT = "case when c_custkey % 4 < 3 then c_custkey + 1 else c_custkey - 3 end"
#: customers, their successors, and which customers each one reaches
_TREE = f"""with cust as (select c_custkey c, {_NEXT} nxt, c_mktsegment seg, {_NEXT} in (select c_custkey from customer) linked from customer),
whole as (select c // 4 as blk from cust group by 1 having count(*) = 4),
span as (select a.c, b.c r from cust a join cust b on a.c // 4 = b.c // 4 and (b.c >= a.c or a.c // 4 in (select blk from whole))),
entry as (select o_orderkey k, o_custkey c, o_orderpriority = '1-URGENT' urgent from orders where o_orderstatus = 'F'),
jobs as (select s_suppkey k, s_acctbal > 0 own, s_suppkey % 2 = 1 and s_suppkey + 1 in (select s_suppkey from supplier) linked from supplier),
wf as (select 'wf:http-route-site:src/order/o'||k||'.ts' workflow, 'src/order/o'||k||'.ts' file from entry
  union all select 'wf:http-route-site:src/order/o'||k||'.ts', 'src/customer/c'||r||'.ts' from entry join span using (c)
  union all select 'wf:python-main-guard:jobs/s'||k||'.py', 'jobs/s'||k||'.py' from jobs where own
  union all select 'wf:python-main-guard:jobs/s'||k||'.py', 'jobs/s'||(k + 1)||'.py' from jobs where own and linked),
files as (select 'src/order/o'||o_orderkey||'.ts' file, 'orphan' otherwise, 1 fns, (o_orderpriority = '1-URGENT')::int unresolved, 'untested' credit from orders
  union all select 'src/customer/c'||c||'.ts', 'orphan', 1, 0, case seg when 'BUILDING' then 'tested-real' when 'MACHINERY' then 'tested-shallow' when 'AUTOMOBILE' then 'tested-nameonly' else 'untested' end from cust
  union all select 'tests/customer/c'||c||'.test.ts', 'test', 0, 0, 'test' from cust where seg in ('BUILDING', 'MACHINERY', 'AUTOMOBILE')
  union all select 'jobs/s'||k||'.py', 'heuristic-unverified', 1, 0, 'untested' from jobs
  union all select 'src/nation/n'||n_nationkey||'.js', 'intentional-dormant', 1, 0, 'untested' from nation
  union all select 'src/region/r'||r_regionkey||'.min.js', 'generated', 0, 0, 'untested' from region)"""


@query("s1_routed", f"""{_TREE} select file, case when file like '%.py' then 'python' else 'js' end as lang, null::varchar as skipped_reason from files
union all select case when p_size = 50 then 'src/big/p'||p_partkey||'.js' else 'native/p'||p_partkey||'.c' end, case when p_size = 50 then 'js' end, case when p_size = 50 then 'file-too-large' else 'unsupported-language' end from part""")
def s1(t):
    return routed(tree(t)).select("file", "lang", "skipped_reason")


def _functions(t) -> DataFrame:
    return functions_of(extract(routed(tree(t)).where("skipped_reason is null")))


@query("x1_functions", f"""select 'src/order/o'||o_orderkey||'.ts' as file, 'o'||o_orderkey as name, true as exported, false as is_async, 4 as line, 8 + (o_orderstatus = 'F')::int + (o_orderpriority = '1-URGENT')::int as end_line, 1 as params, null::varchar as receiver, true as shaped from orders
union all select 'src/customer/c'||c_custkey||'.ts', 'c'||c_custkey, true, false, 2, 6, 1, null, true from customer
union all select 'src/nation/n'||n_nationkey||'.js', 'n'||n_nationkey, true, false, 1, 1, 1, null, false from nation
union all select 'jobs/s'||s_suppkey||'.py', 'work', true, false, 1 + (s_suppkey % 2), null, 0, null, false from supplier""")
def x1(t):
    return _functions(t).select("file", "name", "exported", "is_async", "line", "end_line", "params", "receiver", F.col("shape_hash").isNotNull().alias("shaped"))


@query("x2_duplicate_shapes", """select count(*) as n, list_sort(list('src/order/o'||o_orderkey||'.ts')) as files from orders group by o_custkey, o_orderstatus = 'F', o_orderpriority = '1-URGENT' having count(*) > 1""")
def x2(t):
    """Orders of one customer have functions of one shape."""
    return duplicate_groups(_functions(t)).select("n", "files")


@query("x10_env_reads", "select 'CUST_'||o_custkey as key, count(*) as n, list_sort(list('src/order/o'||o_orderkey||'.ts')) as files from orders group by o_custkey")
def x10(t):
    return env_reads(tree(t))


@query("p11_legacy_dependencies", """select package, replacement, kind from supplier join (values (0, 'bluebird', 'native Promise', 'native-replacement'), (1, 'underscore', 'native array/object methods or lodash-es', 'superseded'),
(2, 'q', 'native Promise', 'native-replacement')) known(n, package, replacement, kind) on s_nationkey % 5 = n""")
def p11(t):
    manifests = tree(t).where(F.col("file").endswith("/package.json"))
    return legacy_dependencies(manifests.select(F.explode(F.map_keys(F.from_json(F.get_json_object("text", "$.dependencies"), "map<string,string>"))).alias("package")))


@query("r1_import_edges", f"""{_TREE} select 'src/order/o'||o_orderkey||'.ts' as file, 0 as seq, 'src/customer/c'||o_custkey||'.ts' as to_file, null::varchar as external, null::varchar as unresolved from orders
union all select 'src/order/o'||o_orderkey||'.ts', 1, null, 'fs', null from orders
union all select 'src/customer/c'||c||'.ts', 0, case when linked then 'src/customer/c'||nxt||'.ts' end, null, case when not linked then './c'||nxt end from cust
union all select 'tests/customer/c'||c||'.test.ts', 0, 'src/customer/c'||c||'.ts', null, null from cust where seg in ('BUILDING', 'MACHINERY')
union all select 'jobs/s'||k||'.py', 0, case when linked then 'jobs/s'||(k + 1)||'.py' end, case when not linked then 'jobs.s'||(k + 1) end, null from jobs where k % 2 = 1""")
def r1(t):
    return project_of(t).import_edges.select("file", "seq", "to_file", "external", "unresolved")


@query("r14_call_edges", f"""{_TREE} select 'src/order/o'||o_orderkey||'.ts' as file, 'o'||o_orderkey as fn, 'app.get' as call, 'app' as receiver, null::varchar as to_id, 'dynamic' as resolution from orders where o_orderstatus = 'F'
union all select 'src/order/o'||o_orderkey||'.ts', 'o'||o_orderkey, 'c'||o_custkey, 'c'||o_custkey, 'src/customer/c'||o_custkey||'.ts#c'||o_custkey, 'cross-file' from orders
union all select 'src/order/o'||o_orderkey||'.ts', 'o'||o_orderkey, 'fs.readFileSync', 'fs', null, 'external' from orders
union all select 'src/order/o'||o_orderkey||'.ts', 'o'||o_orderkey, 'console.log', 'console', null, 'global' from orders
union all select 'src/order/o'||o_orderkey||'.ts', 'o'||o_orderkey, 'lost', 'lost', null, 'unresolved' from orders where o_orderpriority = '1-URGENT'
union all select 'src/customer/c'||c||'.ts', 'c'||c, 'c'||nxt, 'c'||nxt, case when linked then 'src/customer/c'||nxt||'.ts#c'||nxt end, case when linked then 'cross-file' else 'external' end from cust""")
def r14(t):
    return project_of(t).call_edges.select("file", "fn", "call", "receiver", "to_id", "resolution")


@query("e13_entry_points", """select 'src/order/o'||o_orderkey||'.ts' as file, 'http-route-site' as kind, 'app.get' as detail, null::varchar as declared_as, 3 as ord from orders where o_orderstatus = 'F'
union all select 'jobs/s'||s_suppkey||'.py', 'python-main-guard', 'main guard at line '||(3 + s_suppkey % 2), null, 5 from supplier where s_acctbal > 0""")
def e13(t):
    return project_of(t).entry_points.select("file", "kind", "detail", "declared_as", "ord")


@query("g3_import_cycles", "select min('src/customer/c'||c_custkey||'.ts') as cycle, list_sort(list('src/customer/c'||c_custkey||'.ts')) as members from customer group by c_custkey // 4 having count(*) = 4")
def g3(t):
    edges = project_of(t).import_edges.where("to_file is not null")
    return graph.cycles(edges.select(F.col("file").alias("src"), F.col("to_file").alias("dst")))


@query("v1_reachability", f"""{_TREE} select file, case when file in (select file from wf) then 'reachable' else otherwise end as bucket, case when otherwise = 'generated' then 'name' end as evidence from files""")
def v1(t):
    return project_of(t).reachability.select("file", "bucket", "evidence")


@query("v2_file_view", f"""{_TREE}, held as (select file, list_sort(list(workflow)) workflows from wf group by 1)
select file, case when workflows is not null then 'reachable' else otherwise end as bucket, coalesce(workflows, []::varchar[]) as workflows, fns as functions, fns as exported, unresolved, credit from files left join held using (file)""")
def v2(t):
    return reports.file_view(project_of(t))


@query("c1_workflow_scores", f"""{_TREE}, size as (select workflow, count(*) n, avg((credit in ('tested-real', 'tested-shallow'))::int) tests, sum(unresolved) bad, sum((file like 'src/%')::int) js from wf join files using (file) group by 1)
select workflow, n as n_files, n as n_functions, round(case when js = 0 then (0.3 * 0.5 + 0.25 * tests) / 0.55 else (0.3 * 0.5 + 0.25 * (js + 2) / (js + 2 + bad) + 0.25 * tests) / 0.8 end, 9) as score, round(case when js = 0 then 0.55 else 0.8 end / 0.9, 9) as signal_coverage from size""")
def c1(t):
    return reports.workflow_view(project_of(t), digits=9)


@query("t1_test_credit", f"{_TREE} select file, credit as status from files where credit <> 'test'")
def t1(t):
    return project_of(t).test_credit.select("file", "status")


@query("k6_hotspots", """select 'src/order/o'||o_orderkey||'.ts' as file, (o_orderpriority = '1-URGENT')::bigint as unresolved, (o_orderstatus = 'F')::bigint as dynamic,
case when o_orderstatus = 'F' and o_orderpriority = '1-URGENT' then ['app', 'lost'] when o_orderstatus = 'F' then ['app'] else ['lost'] end as receivers, (o_orderstatus = 'F')::bigint as workflows,
(o_orderpriority = '1-URGENT')::bigint + (o_orderstatus = 'F')::bigint as score from orders where o_orderstatus = 'F' or o_orderpriority = '1-URGENT'""")
def k6(t):
    p = project_of(t)
    return hotspots(p.call_edges, p.workflow_files)


@query("k15_steps", f"""{_TREE} select 'files' as step, count(*) as rows from files union all select 'nodes', count(*) from files
union all select 'imports', 2 * (select count(*) from orders) + (select count(*) from cust) + (select count(*) from cust where seg in ('BUILDING', 'MACHINERY')) + (select count(*) from jobs where k % 2 = 1)
union all select 'calls', (select count(*) from orders where o_orderstatus = 'F') + 3 * (select count(*) from orders) + (select count(*) from orders where o_orderpriority = '1-URGENT') + (select count(*) from cust)
union all select 'entries', (select count(*) from entry) + (select count(*) from jobs where own) union all select 'workflows', count(*) from wf union all select 'credit', count(*) from files where credit <> 'test'""")
def k15(t):
    """Rows of every step of an analysis, as they passed."""
    rows = tree(t)
    log = StepLog(rows.sparkSession)
    analyze(rows, DORMANT, steps=log)
    return log.table().select("step", "rows")


@query("t2_coverage", f"{_TREE} select credit as status, count(*) as n from files where credit <> 'test' and file in (select file from wf) group by 1")
def t2_coverage(t):
    return reports.coverage_summary(project_of(t))


@query("t2_gaps", f"{_TREE} select file, credit as status from files where credit in ('untested', 'tested-nameonly') and file in (select file from wf)")
def t2_gaps(t):
    return reports.test_gaps(project_of(t)).select("file", "status")


@query("d2_snapshot", f"""{_TREE} select 'orphans' as part, count(*) as n, min(file) as first from files where otherwise = 'orphan' and file not in (select file from wf)
union all select 'workflows', count(distinct workflow), min(workflow) from wf
union all select 'exports', (select count(*) from orders) + (select count(*) from cust) + (select count(*) from nation) + (select count(*) from jobs), (select min('jobs/s'||k||'.py') from jobs)""")
def d2(t):
    """A snapshot as it is after it was saved and read again."""
    p = project_of(t)
    path = scratch(p.files, "snapshot")
    reports.save_snapshot(p, path)
    found = reports.load_snapshot(p.files.sparkSession, path)
    count = lambda part, key: found[part].agg(F.lit(part).alias("part"), F.count("*").alias("n"), F.min(key).alias("first"))
    return count("orphans", "file").unionByName(count("workflows", "workflow")).unionByName(count("exports", "file"))


@query("m2_cycles", "select 'cycle' as rule, string_agg('src/customer/c'||c_custkey||'.ts', ' -> ' order by 'src/customer/c'||c_custkey||'.ts') as subject, 1.0::double as certainty from customer group by c_custkey // 4 having count(*) = 4")
def m2_cycles(t):
    """The cycle rule over the cycles of the tree's imports."""
    none = t("customer").where("false")
    empty = none.select(F.lit("w").alias("workflow"), F.lit(0).alias("n_files"), F.lit(1.0).alias("score"))
    return architecture_rules(empty, none.select(F.lit("f").alias("file")), 10, 1.0, g3(t)).where("rule = 'cycle'").select("rule", "subject", "certainty")


@query("k10_evidence", f"""{_TREE}, f as (select 'f'||o_custkey as id, 'src/order/o'||o_orderkey||'.ts' as file from orders union select 'f'||o_custkey, 'src/customer/c'||o_custkey||'.ts' from orders)
select id, count(distinct file) as n_files, count(distinct workflow) as n_workflows, min(workflow) as first from f left join wf using (file) group by id""")
def k10(t):
    """A finding for every customer with orders, about its file and theirs."""
    name = lambda pattern, key: _fill(pattern, k=F.col(key))
    about = t("orders").groupBy("o_custkey").agg(F.collect_set(name("src/order/o$k.ts", "o_orderkey")).alias("files"))
    findings = about.select(name("f$k", "o_custkey").alias("id"), F.array_append("files", name("src/customer/c$k.ts", "o_custkey")).alias("files"))
    shown = reports.evidence(project_of(t), findings)
    return shown.select("id", F.size("files").cast("long").alias("n_files"), F.size("workflows").cast("long").alias("n_workflows"), F.array_min("workflows").alias("first"))
