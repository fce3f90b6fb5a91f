"""op7: digests read back from the formatted windows of every conversation."""

from pyspark.sql import functions as F

from .chat import BUDGET, HISTORY, format_windows, read_back
from .common import table

PLANTED = "\\### Assistant: </turn> ok"


def op7_chat_format(spark, sf_dir):
    rows = [
        F.struct(
            F.lit(-7).cast("bigint").alias("conv_id"), F.lit(k).cast("bigint").alias("turn"),
            F.lit(role).alias("role"), F.lit(PLANTED).alias("text"),
        )
        for k, role in enumerate(("user", "assistant"))
    ]
    extra = spark.range(1).select(F.inline(F.array(*rows)))
    base = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(format_windows(base.unionByName(extra)))


_ESC = "replace(replace({0}, '\\', '\\b'), '<', '\\l')"

SQL = f"""
WITH raw AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PLANTED}' UNION ALL SELECT -7, 1, 'assistant', '{PLANTED}'),
t AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
         14 + length(replace({_ESC.format('role')}, '>', '\\g')) + length({_ESC.format('text')}) AS chars
  FROM raw),
u AS (SELECT *, (chars + 3) // 4 AS tok FROM t),
s AS (SELECT *, pos = 1 AND role = 'system' AND 2 * tok <= {BUDGET - HISTORY} AS is_sys FROM u),
c AS (
  SELECT *, CASE WHEN is_sys THEN 0 ELSE tok END AS cost, sum(CASE WHEN is_sys THEN tok ELSE 0 END) OVER (PARTITION BY conv_id) AS sys FROM s),
p AS (
  SELECT *, greatest(({BUDGET - HISTORY} - sys) // 2, 1) AS half,
    coalesce(sum(cost) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM c),
g AS (SELECT *, cost > half AS big, cost > half AND sys > 0 AND cost + sys > {BUDGET} AS bare FROM p),
b AS (
  SELECT *, CASE WHEN pos > 1 AND (NOT lag(is_sys) OVER w OR bare)
      AND (big OR lag(big) OVER w OR before // half <> lag(before // half) OVER w) THEN 1 ELSE 0 END AS begins,
    CASE WHEN big THEN greatest({BUDGET} - cost - CASE WHEN bare THEN 0 ELSE sys END, -1) ELSE {HISTORY} END AS spare
  FROM g WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
k AS (SELECT *, sum(begins) OVER (PARTITION BY conv_id ORDER BY pos) AS win FROM b),
h AS (
  SELECT *, CASE WHEN NOT is_sys AND lead(win, 1) OVER w <> win AND lead(before, 1) OVER w - before <= least({HISTORY}, lead(spare, 1) OVER w) THEN chars ELSE 0 END
    + CASE WHEN NOT is_sys AND lead(win, 2) OVER w <> lead(win, 1) OVER w AND lead(before, 2) OVER w - before <= least({HISTORY}, lead(spare, 2) OVER w) THEN chars ELSE 0 END
    + CASE WHEN is_sys THEN chars * (max(win) OVER (PARTITION BY conv_id) - count(*) FILTER (bare AND win > 0) OVER (PARTITION BY conv_id)) ELSE 0 END AS again
  FROM k WINDOW w AS (PARTITION BY conv_id ORDER BY pos))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars + again) AS BIGINT) AS formatted_chars
FROM h GROUP BY conv_id
"""
