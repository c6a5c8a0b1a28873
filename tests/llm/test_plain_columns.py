"""Columns of operators that SQL can express, against DuckDB on a whole table."""

import os

import duckdb
import pytest

from glyphmill.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")

OP2 = r"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path FROM cut),
rules(rule, verdict) AS (VALUES ('net/', 'block'), ('example.net/en/', 'allow'), ('example.com/de/', 'block'), ('org/fr/', 'allow')),
fitting AS (SELECT page_id, rule FROM parts, rules WHERE (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, substr(rule, strpos(rule, '/'))))
SELECT page_id, host, path, (SELECT arg_max(rule, length(rule)) FROM fitting f WHERE f.page_id = p.page_id) AS rule FROM parts p"""

OP4 = """
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents),
next_ AS (SELECT *, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS after FROM texts)
SELECT doc_id, n AS n_chars, sha256(substr(t, 1, n - n // 4) || substr(after, 1, n // 4)) AS edited_sha256 FROM next_"""


@pytest.mark.parametrize(("query", "sql"), [("op2_url_filter", OP2), ("op4_document_fingerprints", OP4)])
def test_columns_equal_sql(spark, query, sql):
    con = duckdb.connect()
    for name in ("documents", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    want = con.sql(sql)
    got = getattr(queries, query)(spark, SF).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)
