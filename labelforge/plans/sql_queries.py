"""Queries written as SQL text over the registered functions."""
from __future__ import annotations

from ..sql import register
from .registry import ORACLES, lines, query, sql_key, table
from .text_queries import TITLE  # noqa: F401  (the title case as SQL)


@query("sql_text_functions", f"""
WITH n AS (SELECT p_partkey, p_name || '-' || lower(p_brand) || ' (' || lower(p_type) || ')/x' AS raw FROM part)
SELECT p_partkey, {sql_key('raw')} AS key, {TITLE} AS title FROM (SELECT *, lower(raw) AS s, string_split(lower(raw), '') AS c FROM n)""")
def _(spark, d):
    register(spark)
    return spark.sql("SELECT p_partkey, match_key(raw) AS key, title_case(raw) AS title FROM (SELECT p_partkey, p_name || '-' || lower(p_brand) || ' (' || lower(p_type) || ')/x' AS raw FROM {part})",
                     part=table(spark, d, "part"))


@query("sql_segment_label", ORACLES["g2_segment_documents"])
def _(spark, d):
    register(spark)
    return spark.sql("""SELECT doc_id, count(*) AS n_segments, md5(array_join(transform(array_sort(collect_list(struct(position, raw))), x -> x.raw), '|')) AS segments
        FROM (SELECT d.doc_id, s.position, s.raw FROM {documents} d, LATERAL segment_label(d.text) s) GROUP BY doc_id""", documents=table(spark, d, "documents"))


@query("sql_similarity_functions")
def _(spark, d):
    register(spark)
    return spark.sql("""SELECT printed, p_name, round(indel_ratio(match_key(printed), match_key(p_name)), 6) AS ratio, round(confusion_score(match_key(printed), match_key(p_name)), 6) AS score
        FROM (SELECT DISTINCT printed, p_name FROM {lines})""", lines=lines(spark, d))
