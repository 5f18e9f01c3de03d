"""The whole analysis over files in twelve languages."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodemap.plans.analyze import analyze
from workload import extract_queries as XQ
from workload.enrich_queries import _SYM

FILE_TYPE = {0: "file", 1: "file", 2: "file", 3: "table", 4: "document", 5: "service", 6: "resource", 7: "schema", 8: "file", 9: "file", 10: "config", 11: "file"}


def q_analyze(spark, sf):
    g = analyze(XQ.files(spark, sf).select("repo_id", "path", "content"))
    nodes = g["nodes"].groupBy("repo_id", F.col("type").alias("key")).agg(F.count("*").alias("n")).withColumn("what", F.lit("node"))
    edges = g["edges"].filter("type in ('contains', 'exports')").groupBy("repo_id", F.col("type").alias("key")).agg(F.count("*").alias("n")).withColumn("what", F.lit("edge"))
    files = g["projects"].select("repo_id", F.col("complexity").alias("key"), F.col("total_files").alias("n"), F.lit("project").alias("what"))
    return nodes.unionByName(edges).unionByName(files)


_ROWS = ", ".join([f"({i}, '{t}', false, false)" for i, t in FILE_TYPE.items()]
                  + [f"({i}, '{t}', true, {str(g.startswith('exported')).lower()})" for i, t, _, g in _SYM])
S_ANALYZE = f"""with w(i, ty, inside, shown) as (values {_ROWS}), f as (select p_partkey % 7 as r, w.* from part join w on p_partkey % {XQ.M} = w.i)
 select r as repo_id, ty as key, count(*) as n, 'node' as what from f group by 1, 2
 union all select r, 'contains', count(*), 'edge' from f where inside group by 1 union all select r, 'exports', count(*), 'edge' from f where shown group by 1
 union all select p_partkey % 7, case when count(*) <= 30 then 'small' when count(*) <= 150 then 'moderate' when count(*) <= 500 then 'large' else 'very-large' end, count(*), 'project' from part group by 1"""

QUERIES = {"analyze": (q_analyze, S_ANALYZE)}
