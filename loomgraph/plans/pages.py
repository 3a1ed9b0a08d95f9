"""Documents over the relational tables: customers are workflows, their orders files."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from . import documents
from .tables import query

_ID = "'n'||substr(sha1({}), 1, 10)"
_SLUG = "'workflows/wf-customer-'||c||'-'||substr(sha1('wf:customer:'||c), 1, 8)"


@query("v3_documents", f"""with o as (select o_custkey c, 'o'||o_orderkey f, lead('o'||o_orderkey) over (partition by o_custkey order by o_orderkey) nxt from orders),
w as (select c, count(*) n, string_agg('  '||{_ID.format('f')}||'["'||f||'"]', chr(10) order by f) nodes, string_agg('  '||{_ID.format('f')}||' --> '||{_ID.format('nxt')}, chr(10) order by f||' '||nxt) filter (nxt is not null) links,
  string_agg('- `'||f||'`', chr(10) order by f) names from o group by c),
d as (select *, '```mermaid' || chr(10) || 'graph LR' || chr(10) || case when n > 30 then '  big["'||n||' files, listed below"]' else nodes||coalesce(chr(10)||links, '') end || chr(10) || '```' as diagram,
  case when n > 10 then '0.750' else 'unavailable' end as tests, case when n > 10 then 0.75 end as t from w)
select {_SLUG}||'.md' as file, '# wf:customer:'||c||chr(10)||chr(10)||'- files: '||n||chr(10)||'- functions: '||(2 * n)||chr(10)||'- score: `██████░░░░` 62.5%'||chr(10)||'- signal coverage: 80.0%'||chr(10)||chr(10)
 ||'| signal | value | weight |'||chr(10)||'|-|-|-|'||chr(10)||'| <parse> | 0.500 | 0.30 |'||chr(10)||'| tests | '||tests||' | 0.25 |'||chr(10)||chr(10)||diagram||chr(10) as text from d
union all select {_SLUG}||'.html', '<!DOCTYPE html>'||chr(10)||'<html><head><meta charset="utf-8"><title>wf:customer:'||c||'</title></head>'||chr(10)||'<body><h1>wf:customer:'||c||'</h1>'||chr(10)||'<p>'||n||' files, score 0.625</p>'||chr(10)||'<table>'||chr(10)
 ||'<tr><td>&lt;parse&gt;</td><td>0.500</td></tr>'||chr(10)||'<tr><td>tests</td><td>'||tests||'</td></tr>'||chr(10)||'</table>'||chr(10)||'<pre>'||replace(replace(diagram, '>', '&gt;'), '"', '&quot;')||'</pre>'||chr(10)||'</body></html>'||chr(10) from d
union all select {_SLUG}||'.json', '{{"workflow":"wf:customer:'||c||'","n_files":'||n||',"n_functions":'||(2 * n)||',"score":0.625,"signals":[{{"signal":"<parse>","value":0.5,"weight":0.3}},{{"signal":"tests",'||case when n > 10 then '"value":0.75,' else '' end||'"weight":0.25}}]}}'||chr(10) from d
union all select {_SLUG}||'/files-0.md', '# Files of wf:customer:'||c||chr(10)||chr(10)||names||chr(10) from d""")
def v3(t):
    """Pages, reports and lists of the files of every customer."""
    orders = t("orders").select(F.concat(F.lit("wf:customer:"), "o_custkey").alias("workflow"), F.concat(F.lit("o"), "o_orderkey").alias("file"), "o_orderkey")
    after = F.lead("file").over(Window.partitionBy("workflow").orderBy("o_orderkey"))
    edges = orders.select(F.col("file").alias("src"), after.alias("dst")).where("dst is not null")
    workflows = orders.groupBy("workflow").agg(F.count("*").alias("n_files")).withColumns({"n_functions": F.col("n_files") * 2, "score": F.lit(0.625), "signal_coverage": F.lit(0.8)})
    tests = F.struct(F.lit("tests").alias("signal"), F.when(F.col("n_files") > 10, 0.75).alias("value"), F.lit(0.25).alias("weight"))
    parse = F.struct(F.lit("<parse>").alias("signal"), F.lit(0.5).alias("value"), F.lit(0.3).alias("weight"))
    signals = workflows.select("workflow", F.explode(F.array(tests, parse)).alias("s")).select("workflow", "s.*")
    return documents.workflow_pages(workflows, signals, orders.select("workflow", "file"), edges)
