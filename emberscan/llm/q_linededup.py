"""op8: line counts and kept-text digests of every document."""

import hashlib

import pyarrow as pa

from .common import table
from .linededup import kept_text, line_bitmaps, with_bitmaps


def _digests(batches):
    for b in batches:
        row = b.column(0)
        ids, texts = row.field("doc_id"), row.field("text").to_pylist()
        lines, sha = [], []
        for text, keep in zip(texts, b.column(2).to_pylist()):
            text = text or ""
            lines.append(text.count("\n") + 1)
            sha.append(hashlib.sha256(kept_text(text, keep).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(lines, pa.int64()), b.column(1).fill_null(0), pa.array(sha)],
            ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
        )


def op8_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_bitmaps(docs, line_bitmaps(docs)).mapInArrow(
        _digests, "doc_id long, n_lines long, n_dropped long, kept_sha256 string"
    )


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT rid, doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM d),
k AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE doc_id IS NOT NULL AND length(key) >= 10 GROUP BY key),
m AS (SELECT rid, k.doc_id, pos, line, coalesce(o.owner <> k.doc_id, false) AS gone FROM k LEFT JOIN o USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid, doc_id
"""
