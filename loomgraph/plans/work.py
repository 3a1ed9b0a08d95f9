"""Work plans over the relational tables: nations are workflows, customers with
orders their files, those without are orphans, orders are calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import planning
from . import project
from .tables import query

_BASE = """with files as (select 'c'||c_custkey file, c_nationkey wf, case when c_nationkey % 5 = 4 then 'heuristic' else 'ast' end parser_kind, (c_acctbal < 0)::int parse_errors,
  c_custkey % 7 n_exports, case c_mktsegment when 'BUILDING' then 'untested' when 'AUTOMOBILE' then 'tested-nameonly' else 'tested-real' end status, c_custkey in (select o_custkey from orders) used from customer),
calls as (select 'c'||o_custkey file, case o_orderpriority when '1-URGENT' then 'unresolved' when '5-LOW' then 'dynamic' else 'cross-file' end resolution from orders),
m as (select * from files where used),
raw as (select wf, count(*) n, avg(case when parse_errors > 0 then 0.0 when parser_kind = 'heuristic' then 0.5 else 1.0 end) parse, avg((status = 'tested-real')::int) tests from m group by 1),
res as (select wf, sum((resolution = 'cross-file')::int) / nullif(sum((resolution <> 'dynamic')::int), 0) rate from m join calls using (file) group by 1),
v as (select raw.*, rate, 0.3 + 0.25 + case when rate is not null then 0.25 else 0 end as there from raw left join res using (wf)),
tot as (select (select count(*) from m) memberships, (select count(*) from files) files, (select count(*) from m) covered,
  (select sum((resolution = 'unresolved')::int) from calls) unresolved, (select sum((resolution <> 'dynamic')::int) from calls) calls),
tasks as (
  select 'add-test:'||file id, 'add-test' kind, file, wf, 'testPresence' signal, 'low' risk, 15.0 + 5 * least(n_exports, 5) effort, 0.25 / there * 0.9 / memberships lift from m join v using (wf), tot where status = 'untested'
  union all select 'replace-padding:'||file, 'replace-padding', file, wf, 'testPresence', 'low', 20.0, 0.25 / there * 0.9 / memberships from m join v using (wf), tot where status = 'tested-nameonly'
  union all select 'fix-parse:'||file, 'fix-parse', file, wf, 'parseIntegrity', 'medium', 15.0, 0.3 / there * 0.9 / memberships from m join v using (wf), tot where parser_kind = 'ast' and parse_errors > 0
  union all select 'resolve-calls', 'resolve-calls', null, null, 'resolutionRate', 'medium', least(unresolved * 10, 240), (select sum(0.25 / there * (1 - rate) * n) from v where rate is not null) * 0.9 / memberships from tot where unresolved > calls * 0.001
  union all select 'wire-coverage:'||file, 'wire-coverage', file, null, 'coverageOfRepo', 'medium', 15.0, 0.1 * place / files from (select file, row_number() over (order by file) place from files where not used qualify place <= 5), tot)"""


def _relations(t):
    customers = t("customer").select(
        F.concat(F.lit("c"), "c_custkey").alias("file"), F.col("c_nationkey").alias("workflow"), F.when(F.col("c_nationkey") % 5 == 4, "heuristic").otherwise("ast").alias("parser_kind"), F.lit(True).alias("parsed"),
        (F.col("c_acctbal") < 0).cast("int").alias("parse_errors"), (F.col("c_custkey") % 7).alias("n_exports"),
        F.when(F.col("c_mktsegment") == "BUILDING", "untested").when(F.col("c_mktsegment") == "AUTOMOBILE", "tested-nameonly").otherwise("tested-real").alias("status"),
    )
    resolution = F.when(F.col("o_orderpriority") == "1-URGENT", "unresolved").when(F.col("o_orderpriority") == "5-LOW", "dynamic").otherwise("cross-file")
    calls = t("orders").select(F.concat(F.lit("c"), "o_custkey").alias("file"), resolution.alias("resolution"))
    used = calls.select("file").distinct()
    members = customers.join(used, "file", "left_semi").select("workflow", "file")
    orphans = customers.join(used, "file", "left_anti").select("file")
    credit = customers.select("file", "status")
    customers = customers.drop("workflow")
    signals = project.signals(customers, members, calls, credit)
    return customers, members, credit, calls, orphans, signals


@query("k4_tasks", f"{_BASE} select id, kind, file, signal, risk, round(effort::double, 6) as effort, round(lift, 8) as lift from tasks")
def k4_tasks(t):
    return planning.improvement_candidates(*_relations(t)).select("id", "kind", "file", "signal", "risk", "effort", F.round("lift", 8).alias("lift"))


@query("k4_work_plan", f"""{_BASE.replace("with files", "with recursive files")},
o as (select *, row_number() over (order by round(lift, 9) / effort desc, round(lift, 9) desc, id) pos from tasks where round(lift, 9) > 0),
f as (select 0::bigint pos, 1000.0::double rest, false took, null::varchar id, null::varchar kind, null::bigint wf, null::double effort
  union all select o.pos, case when o.effort <= f.rest then f.rest - o.effort else f.rest end, o.effort <= f.rest, o.id, o.kind, o.wf, o.effort from f join o on o.pos = f.pos + 1),
p as (select * from f where took),
done as (select wf, sum((kind in ('add-test', 'replace-padding'))::int) tests_done, sum((kind = 'fix-parse')::int) parse_done from p where wf is not null group by 1),
s as (select v.*, (0.3 * parse + 0.25 * tests + coalesce(0.25 * rate, 0)) / there before,
  (0.3 * least(1, parse + coalesce(parse_done, 0) / n) + 0.25 * least(1, tests + coalesce(tests_done, 0) / n) + coalesce(0.25 * case when (select count(*) from p where kind = 'resolve-calls') > 0 then 1 else rate end, 0)) / there after from v left join done using (wf))
select round(0.9 * sum(before * n) / sum(n) + 0.1 * any_value(covered) / any_value(files), 6) as before,
  round(0.9 * sum(after * n) / sum(n) + 0.1 * (any_value(covered) + (select count(*) from p where kind = 'wire-coverage')) / any_value(files), 6) as after, (select count(*) from p) as tasks, (select sum(effort) from p) as effort from s, tot""")
def k4_work_plan(t):
    """A plan of 1000 minutes at medium risk, and the score once it is done."""
    files, members, credit, calls, orphans, signals = _relations(t)
    tasks = planning.improvement_candidates(files, members, credit, calls, orphans, signals)
    plan = planning.improvement_plan(tasks, 1000.0, "medium")
    return planning.projection(plan, files, members, signals).select(F.round("before", 6).alias("before"), F.round("after", 6).alias("after"), "tasks", "effort")
