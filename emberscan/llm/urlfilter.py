"""URL filters by host and path rules, held in a sorted digest array.

Each rule (host, path prefix, verdict) is one key: host, a separator byte, path.
The driver writes index files, named by their contents, into the shared folder: the sorted 64-bit xxhash of
every key, then the key strings and verdicts.  ``SparkContext.addFile`` gives each
executor one copy; its Python workers memory-map it, so the pages are shared.  A
url is probed with every (host suffix, path prefix of a length that some rule
has) by vectorised binary search, and a hit counts only if the stored host and path
are equal, so digest collisions cannot decide.  More rules than
``SHARD_BYTES`` hold are split into files by digest, each probed for its range.

Defined results: a null url, or one without ``://``, has an empty host and
path and gets the default verdict.  Of several fitting rules the longest
``host + path`` wins, of equally long ones that with the longer host.  The same
rule given twice with both verdicts blocks.  Ports and user info stay part of
the host.  Repeated pages give repeated rows; an empty table gives no rows.
"""

from __future__ import annotations

import io
import os
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder

#: About how many bytes of keys one index file holds.
SHARD_BYTES = 256 << 20
#: Stands between host and path; no path prefix that can fit begins with it.
SEPARATOR = b"\0"
VERDICTS = ("allow", "block")
_AFTER = re.compile(r"[/?#]")
_END = re.compile(r"[?#]")
_open: dict[tuple, object] = {}


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path); A-Z of the host are lower-cased."""
    if url is None:
        return "", ""
    _, found, rest = url.partition("://")
    if not found:
        return "", ""
    m = _AFTER.search(rest)
    host, tail = (rest[: m.start()], rest[m.start() :]) if m else (rest, "")
    host = host.translate(_LOWER)
    return host, _END.split(tail, maxsplit=1)[0]


_LOWER = {c: c + 32 for c in range(65, 91)}


def index_files(rules, shard_bytes: int = SHARD_BYTES) -> list[bytes]:
    """Index files in the order of their digests: counts, digests, key offsets, host lengths, verdicts, path lengths, keys."""
    best: dict[bytes, tuple[int, int]] = {}
    for host, prefix, verdict in rules:
        host = (host or "").translate(_LOWER).encode()
        key, v = host + SEPARATOR + (prefix or "").encode(), VERDICTS.index(verdict)
        old = best.get(key)
        best[key] = (len(host), max(v, old[1] if old else 0))
    digests = {k: xxhash.xxh64_intdigest(k) for k in best}
    keys = sorted(best, key=lambda k: (digests[k], k))
    paths = np.unique([len(k[best[k][0] + 1 :].decode()) for k in keys]).astype(np.int64)
    files, first, size = [], 0, 0
    for i, k in enumerate(keys):
        size += len(k)
        # equal digests stay together
        if i + 1 < len(keys) and (size < shard_bytes or digests[keys[i + 1]] == digests[k]):
            continue
        part = keys[first : i + 1]
        offsets = np.zeros(len(part) + 1, np.int64)
        np.cumsum([len(x) for x in part], out=offsets[1:])
        out = io.BytesIO()
        for a in (
            np.array([len(part), len(paths)], np.int64), np.array([digests[x] for x in part], np.uint64), offsets,
            np.array([best[x][0] for x in part], np.int64), np.array([best[x][1] for x in part], np.int64), paths,
        ):
            out.write(a.tobytes())
        out.write(b"".join(part))
        files.append(out.getvalue())
        first, size = i + 1, 0
    return files


class Shard:
    """One memory-mapped index file."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        n, m = (int(x) for x in raw[:16].view(np.int64))
        at = 16

        def take(count: int, kind) -> np.ndarray:
            nonlocal at
            at += 8 * count
            return raw[at - 8 * count : at].view(kind)

        self.digest, self.offsets, self.hosts = take(n, np.uint64), take(n + 1, np.int64), take(n, np.int64)
        self.verdict, self.lengths = take(n, np.int64), take(m, np.int64).tolist()
        self.text = raw[at:]

    def key(self, i: int) -> bytes:
        return self.text[self.offsets[i] : self.offsets[i + 1]].tobytes()


class Index:
    def __init__(self, paths: list[str]):
        self.shards = [Shard(p) for p in paths]
        self.lengths = self.shards[0].lengths if self.shards else []
        self.first = np.array([s.digest[0] for s in self.shards], np.uint64)

    def judge(self, parts: list[tuple[str, str]]) -> list[tuple[str | None, str | None]]:
        """(rule, verdict) of each (host, path), or (None, None)."""
        owner, cand, rank = [], [], []
        for i, (host, path) in enumerate(parts):
            if not host:
                continue
            lengths = [n for n in self.lengths if n <= len(path)]
            at = 0
            while at >= 0:
                suffix = host[at:].encode()
                for n in lengths:
                    owner.append(i)
                    cand.append((suffix, path[:n].encode()))
                    rank.append((len(host) - at + n, len(host) - at))
                at = host.find(".", at) + 1 or -1
        out: list[tuple[str | None, str | None]] = [(None, None)] * len(parts)
        if not cand or not self.shards:
            return out
        keys = [h + SEPARATOR + p for h, p in cand]
        digest = np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))
        of = np.maximum(np.searchsorted(self.first, digest, "right") - 1, 0)
        best: dict[int, tuple] = {}
        for s, shard in enumerate(self.shards):
            mine = np.flatnonzero(of == s)
            left = np.searchsorted(shard.digest, digest[mine], "left")
            right = np.searchsorted(shard.digest, digest[mine], "right")
            for q in np.flatnonzero(right > left):
                k = mine[q]
                for j in range(left[q], right[q]):  # more than one only where digests collide
                    same = shard.hosts[j] == len(cand[k][0]) and shard.key(j) == keys[k]
                    if same and rank[k] > best.get(owner[k], ((-1, -1),))[0]:
                        best[owner[k]] = (rank[k], b"".join(cand[k]).decode(), VERDICTS[shard.verdict[j]])
        for i, (_, rule, verdict) in best.items():
            out[i] = (rule, verdict)
        return out


def share_index(spark: SparkSession, rules) -> list[str]:
    """Names of the index files, there once for each set of rules."""
    names, sc = [], spark.sparkContext
    have = {os.path.basename(f) for f in sc.listFiles}
    for content in index_files(rules):
        name = f"rules-{xxhash.xxh3_128_hexdigest(content)}.idx"
        names.append(name)
        if name in have:
            continue
        path = f"{shared_folder(spark)}/{name}"
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
        for i in range(0, len(content), 1 << 20):
            out.write(content[i : i + (1 << 20)])
        out.close()
        sc.addFile(path)
    return names


def judge_urls(pages: DataFrame, rules, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) of every row of ``pages``.

    ``rules``: (host, path prefix, "block" or "allow").  Only the two named
    columns are read.
    """
    names = tuple(share_index(pages.sparkSession, rules))

    def probe(batches):
        if names not in _open:
            _open.clear()
            _open[names] = Index([SparkFiles.get(name) for name in names])
        index = _open[names]
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            got = index.judge(parts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([p[0] for p in parts], pa.string()),
                    pa.array([p[1] for p in parts], pa.string()),
                    pa.array([g[0] for g in got], pa.string()),
                    pa.array([g[1] or default for g in got], pa.string()),
                ],
                ["id", "host", "path", "rule", "verdict"],
            )

    kind = dict(pages.dtypes)[id_col]
    out = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).mapInArrow(
        probe, f"id {kind}, host string, path string, rule string, verdict string"
    )
    return out.withColumnRenamed("id", id_col)
