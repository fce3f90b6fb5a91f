"""op9: verdicts for every page url."""

from .common import table
from .urlfilter import judge_urls

RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)


def op9_url_filter(spark, sf_dir):
    return judge_urls(table(spark, sf_dir, "pages"), RULES)


_VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)

SQL = f"""
WITH rules(rhost, rpath, rverdict) AS (VALUES {_VALUES}),
cut AS (
  SELECT page_id, row_number() OVER () AS rid,
         CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT page_id, rid,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut),
fits AS (
  SELECT rid, rhost || rpath AS rule, rverdict,
         row_number() OVER (PARTITION BY rid ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS k
  FROM parts JOIN rules
    ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.rverdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON f.rid = p.rid AND f.k = 1
"""
