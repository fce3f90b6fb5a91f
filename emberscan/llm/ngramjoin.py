"""N-gram Jaccard self-join: links between documents of similar word n-gram sets.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a document's set is its
distinct n-word shingles, or its whole word sequence as one if it has fewer
words, held as sorted 64-bit hashes.  Two documents link when
``100 * intersection >= percent * union``.

1. Documents with equal sets (128-bit fingerprint) become one class, kept by its
   smallest doc_id; from here on only one set per class is carried.
2. Candidate tiles.  Sets of sizes s <= t that link differ in at most
   H = (s + t)(100 - percent) / (100 + percent) shingles.  Sizes fall into
   bands with bounds a factor 100/percent apart, so linked sets lie in the same
   or neighbouring bands; a set is filed for its own band and the next larger
   one, with H taken for the band's largest size.  The hash space is cut into a
   few more than H parts, and a set's keys are hashes of (band, part, contents)
   of its parts that are not empty.  At most H parts differ, so if more than H
   parts of one of two linked sets are not empty, they have a key in common.  A
   set with fewer such parts is filed by a further level, cut otherwise, too
   (the last level takes empty parts in); two sets that both fail a level meet
   in the next, so no link can be missed.  The first level leaves out shingles
   that a bounded sample of texts shows to be frequent (leaving out the same
   shingles from both can only make sets differ less), so that a passage which
   many documents share makes no keys; the sample steers cost, never results.
3. Documents with a common key are chained to the smallest id in that key (never
   all pairs): smallest ids come from a partially aggregated minimum over the keys,
   written once, and only keys that two documents share are joined back.  Chains
   carry over to classes; connected chains are candidate groups.
4. Groups are gone through twice.  First with hashed bitmaps alone (a sixteenth
   of a set's bytes), whose bit counts bound overlap from above: only what they
   cannot rule out stays a candidate.  Then, in the much smaller groups that are
   left, what passes the bound and is not yet connected is decided by exact
   intersection of the sorted arrays.  A group larger than ``TILE`` is compared
   with one of its sets of middle size first, in parts of a tile's size; what links
   to it is connected and needs no test among itself.  All other pairs, those of
   a set that does not link to it with any set of the group, meet in tiles cut by size, of
   which only those whose sizes can link meet.  So a group of copies of one text costs
   in proportion to its size.
5. Links between classes, and members to their class, give components.

Result of ``link_components``: (doc_id, text_hash, n_shingles, component_id).

Defined results: without words (null, empty, blank text) the set is empty and
linked with nothing; rows with a null doc_id link with nothing and have a null
component; rows with the same doc_id are one document for links; an empty table
gives no rows.  For ``keep_one`` rows are one document only if doc_id and text are equal.
"""

from __future__ import annotations

import functools
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .common import checkpoint, connected_components, delete_path, drop_checkpoint, free_shuffles, hash_filter, in_filter, shared_folder, small_batches, text_hash

SHINGLE, PERCENT = 3, 90
#: Shingles per tile, small sets counting as SMALL; a pair of tiles is a task's largest unit.
TILE, SMALL = 1 << 20, 1 << 10
#: Tasks that the sets of a group above a tile's size are dealt to where they first meet the group's row.
SALTS = 64
#: Shares of the keys whose minima are found one after the other.
PASSES = 2
#: Ways of cutting sets into parts, each for the sets that all before fail.
LEVELS = 4
#: About how many texts frequent shingles are counted in, how many must hold one, and how many shingles are kept.
SAMPLE_TEXTS, FREQUENT_TEXTS, FREQUENT = 4000, 8, 100_000
#: Sets that a task remembers, so that copies are filed about once per task.
REMEMBERED = 100_000
#: Largest number of bits of a set's bitmap.
MAX_BITS = 1 << 17
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_ROWS = "doc_id long, text_hash long, n_shingles long, fp1 long, fp2 long, bits binary"


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    h, at = tv.words(data, offsets)
    out = []
    m = len(h)
    rolled = np.zeros(m, np.uint64)
    for k in range(n):
        part = h[k : m - n + 1 + k] if m >= n else h[:0]
        rolled[: len(part)] = tv.mix(rolled[: len(part)] * _C1 + part + _C2)
    for i in range(len(at) - 1):
        a, b = int(at[i]), int(at[i + 1])
        if b - a >= n:
            out.append(np.unique(rolled[a : b - n + 1]))
        elif b > a:
            x = np.full(1, b - a, np.uint64)
            for k in range(a, b):
                x = tv.mix(x * _C2 + h[k : k + 1])
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def frequent_shingles(docs: DataFrame, n: int) -> np.ndarray:
    """Sorted hashes of shingles that many texts of a sample hold.

    The sample is the share of texts, by hash, that makes about SAMPLE_TEXTS; copies count once.
    """
    share = min(1.0, SAMPLE_TEXTS / max(docs.count(), 1))
    texts = _texts(docs).filter("text is not null").filter(F.pmod("text_hash", F.lit(1_000_003)) < int(1_000_003 * share) + 1)

    def run(batches):
        for batch in tv.batches(batches):
            data, offsets = tv.buffers(batch.column(1))
            for _, _, d, o in tv.blocks(data, offsets):
                sets = shingle_sets(d, o, n)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).astype(np.int64))], ["h"])

    chosen = texts.select("text_hash", "text").dropDuplicates(["text_hash"])
    found = chosen.mapInArrow(run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= FREQUENT_TEXTS)
    got = found.orderBy(F.desc("c"), "h").limit(FREQUENT).select("h").toArrow()["h"].to_numpy()
    return np.sort(got.astype(np.uint64))


def _fingerprint(s: np.ndarray) -> tuple[int, int]:
    if not len(s):
        return 0, 0
    return int(np.bitwise_xor.reduce(tv.mix(s + _C1)).astype(np.int64)), int(np.add.reduce(tv.mix(s ^ _C2)).astype(np.int64))


def _rows(n: int):
    """Size, fingerprint and bitmap of each text's set."""

    def run(batches):
        for batch in tv.batches(batches):
            data, offsets = tv.buffers(batch.column(2))
            for i, j, d, o in tv.blocks(data, offsets):
                sets = shingle_sets(d, o, n)
                fp = [_fingerprint(s) for s in sets]
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([f[0] for f in fp], pa.int64()), pa.array([f[1] for f in fp], pa.int64()),
                        pa.array([bitmap(s).tobytes() for s in sets], pa.binary()),
                    ],
                    ["doc_id", "text_hash", "n_shingles", "fp1", "fp2", "bits"],
                )

    return run


def _keys(n: int, percent: int, frequent):
    """(key, doc_id) rows; a set that a task has just filed is not filed by it again."""

    def run(batches):
        filed: set[tuple[int, int]] = set()
        for batch in tv.batches(batches):
            data, offsets = tv.buffers(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, _, d, o in tv.blocks(data, offsets, 1 << 20):
                keys, owner = [], []
                for k, s in enumerate(shingle_sets(d, o, n)):
                    fp = _fingerprint(s)
                    if not len(s) or fp in filed:
                        continue
                    if len(filed) >= REMEMBERED:
                        filed.clear()
                    filed.add(fp)
                    band = band_of(len(s), percent)
                    for c in (band, band + 1):
                        got = part_keys(s, c, percent, frequent.value)
                        keys.append(got)
                        owner.append(np.full(len(got), ids[i + k]))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(owner))], ["key", "id"])

    return run


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_hash(F.coalesce("text", F.lit(""))).alias("text_hash"), "text"
    )


def _wanted_sets(docs: DataFrame, members: DataFrame, n: int) -> tuple[DataFrame, Broadcast]:
    """(id, shingles) of the members (doc_id, text_hash, id), from a second pass over the texts, and a broadcast.

    The broadcast bitmap of bounded size spares the shuffle of texts that are no
    member's; the join removes what passed it by chance.  It can be destroyed
    when the frame is read for the last time.
    """
    pair = F.xxhash64("doc_id", "text_hash")
    bits = docs.sparkSession.sparkContext.broadcast(hash_filter(members.select(pair), members.count()))

    def run(batches):
        for batch in tv.batches(batches):
            hit = np.flatnonzero(in_filter(bits.value, batch.column(3).to_numpy(zero_copy_only=False)))
            if not len(hit):
                continue
            batch = batch.take(pa.array(hit))
            data, offsets = tv.buffers(batch.column(2))
            for i, j, d, o in tv.blocks(data, offsets):
                sets = shingle_sets(d, o, n)
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([s.tobytes() for s in sets], pa.binary())],
                    ["doc_id", "text_hash", "shingles"],
                )

    sets = _texts(docs).filter("doc_id is not null").withColumn("_pair", pair).mapInArrow(run, "doc_id long, text_hash long, shingles binary")
    return sets.join(members.select("doc_id", "text_hash", "id"), ["doc_id", "text_hash"]).select("id", "shingles"), bits


def band_of(size: int, percent: int) -> int:
    """Largest b with (100 / percent) ** b <= size, guarded against rounding."""
    g = 100 / percent
    b = int(math.log(size) / math.log(g)) + 1
    while g**b > size:
        b -= 1
    return b


def most_differing(band: int, percent: int) -> int:
    """Shingles in which linked sets of sizes up to the band's largest can differ."""
    largest = math.ceil((100 / percent) ** (band + 1))
    return 2 * largest * (100 - percent) // (100 + percent)


def part_keys(s: np.ndarray, band: int, percent: int, frequent: np.ndarray) -> np.ndarray:
    """Keys of a sorted set filed under ``band``; see the module's text, step 2."""
    differ = most_differing(band, percent)
    if not differ:
        return np.zeros(0, np.int64)  # only equal sets could link
    k = differ + 2 + differ // 8
    bounds = (np.arange(1, k, dtype=np.uint64)) * np.uint64((1 << 64) // k)
    out = []
    for level in range(0 if len(frequent) else 1, LEVELS):
        if level == 0:
            x = s[frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] != s]
        else:
            x = s if level == 1 else np.sort(tv.mix(s + np.uint64(level)))
        cut = np.concatenate([[0], np.searchsorted(x, bounds, "left"), [len(x)]])
        count = np.diff(cut)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tv.mix(x + _C2))])
        label = np.arange(k, dtype=np.uint64) + np.uint64((band * LEVELS + level) << 32)
        keys = tv.mix(tv.mix(label * _C1) ^ ((total[cut[1:]] - total[cut[:-1]]) * _C2 + count.astype(np.uint64)))
        full = count > 0
        last = level == LEVELS - 1
        enough = int(full.sum()) > differ
        out.append(keys if last and not enough else keys[full])
        if enough:
            break
    return np.concatenate(out).astype(np.int64)


def bitmap_bits(n: int) -> int:
    """Bits of a bitmap of n shingles: four to eight for each, a power of two."""
    return min(MAX_BITS, max(64, 1 << (4 * n - 1).bit_length()))


def bitmap(s: np.ndarray, bits: int | None = None) -> np.ndarray:
    """Bitmap of a set as 64-bit words; each shingle sets one bit."""
    bits = bits or bitmap_bits(len(s))
    row = np.zeros(bits, bool)
    row[((s >> np.uint64(20)) % np.uint64(bits)).astype(np.int64)] = True
    return np.packbits(row, bitorder="little").view(np.uint64)


class Bitmaps:
    """Bitmaps of sets in ascending order of size, compared a row against rows before it.

    Lengths are powers of two that grow with the size; the longer of two is
    folded to the length of the shorter, which is what it would have had.
    """

    def __init__(self, rows: list[np.ndarray], sizes: np.ndarray):
        self.rows, self.sizes = rows, sizes
        words = np.array([len(r) for r in rows])
        self.starts = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]])).tolist() if len(rows) else []
        self.parts = [np.stack(rows[a:b]) for a, b in zip(self.starts, [*self.starts[1:], len(rows)])]
        self.ones = [np.bitwise_count(m).sum(axis=1).astype(np.int64) for m in self.parts]

    def most(self, i: int, js: np.ndarray) -> np.ndarray:
        """Upper bounds of the overlap of row i with rows js < i, ascending."""
        out = np.empty(len(js), np.int64)
        own, at = self.rows[i], len(js)
        for start, part, ones in zip(self.starts[::-1], self.parts[::-1], self.ones[::-1]):
            k = int(np.searchsorted(js, start))
            if k < at:
                own = own.reshape(-1, part.shape[1])
                own = np.bitwise_or.reduce(own, axis=0)
                local = js[k:at] - start
                both = np.bitwise_count(part[local] & own).sum(axis=1).astype(np.int64)
                mine = int(np.bitwise_count(own).sum())
                # a bit that the other lacks is at least one shingle that it lacks
                out[k:at] = np.minimum(self.sizes[js[k:at]] - (ones[local] - both), self.sizes[i] - (mine - both))
                at = k
        return out


def link_tile(ids, size: np.ndarray, bits: list[np.ndarray], sets, left: np.ndarray, tied: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """What the links of a tile (pair) connect: each id with another that it reaches here.

    ``left``: rows of the first tile of a pair; if there are others, only pairs
    across are looked at.  ``tied``: rows known to be connected.  Rows are visited by size, partners by nearness in
    size; a pair already connected needs no test.  Without ``sets`` a link
    is what the bitmaps cannot rule out.
    """
    order = np.argsort(size, kind="stable")
    size, ids, left, tied = size[order], [ids[i] for i in order], left[order], tied[order]
    sets = [sets[i] for i in order] if sets is not None else None
    maps = Bitmaps([bits[i] for i in order], size)
    across = not left.all()
    root = np.arange(len(ids))
    if tied.any():
        root[tied] = tied.argmax()
    for i in range(1, len(ids)):
        lo = int(np.searchsorted(size[:i], -(-percent * size[i] // 100), "left"))
        js = np.arange(lo, i)
        if across:
            js = js[left[js] != left[i]]
        js = js[root[js] != root[i]]
        if not len(js):
            continue
        need = -(-(percent * (size[js] + size[i])) // (100 + percent))
        for j in js[maps.most(i, js) >= need][::-1].tolist():
            if root[j] == root[i]:
                continue
            if sets is not None:
                inter = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * inter < percent * (size[i] + size[j] - inter):
                    continue
            a, b = root[i], root[j]
            root[root == max(a, b)] = min(a, b)
    least: dict[int, int] = {}
    for r, x, t in zip(root.tolist(), ids, tied.tolist()):
        if t:
            least[r] = x  # any of them, as they are connected already
    known = set(least)
    for r, x in zip(root.tolist(), ids):
        if r not in known:
            least[r] = min(x, least.get(r, x))
    return [(x, least[r]) for r, x, t in zip(root.tolist(), ids, tied.tolist()) if not t and x != least[r]]


def _arrays(column) -> list[np.ndarray]:
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return [np.frombuffer(x.as_buffer(), np.uint64) for c in chunks for x in c]


def _tiles(percent: int, exact: bool):
    def run(key, t):
        ids, data = t.column("id").to_pylist(), _arrays(t.column("data"))
        size = t.column("n").to_numpy()
        bits = [bitmap(s) for s in data] if exact else data
        links = link_tile(ids, size, bits, data if exact else None, t.column("left").to_numpy(), t.column("tied").to_numpy(), percent)
        return pa.table({"src": pa.array([a for a, _ in links], pa.int64()), "dst": pa.array([b for _, b in links], pa.int64())})

    return run


def _star(percent: int, exact: bool):
    """Batches (id, n, data, centre, cn, cdata) -> (src, dst): those that link to their centre."""

    def run(batches):
        for batch in batches:
            ids, n, centre, cn = (batch.column(k).to_pylist() for k in (0, 1, 3, 4))
            src, dst = [], []
            for i, (x, y) in enumerate(zip(_arrays(batch.column(2)), _arrays(batch.column(5)))):
                if ids[i] == centre[i]:
                    continue
                pair, sizes = ([x, y] if n[i] <= cn[i] else [y, x]), np.sort([n[i], cn[i]])
                both = np.ones(2, bool)
                if link_tile([0, 1], sizes, [bitmap(s) for s in pair] if exact else pair, pair if exact else None, both, ~both, percent):
                    src.append(ids[i])
                    dst.append(centre[i])
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    return run


def star_links(groups: DataFrame, data: DataFrame, percent: int, exact: bool, weight: Column, tile: int) -> DataFrame | None:
    """(src, dst): in each group above a tile's size, the sets that link to one of middle size; None without such groups."""
    large = groups.groupBy("grp").agg(F.sum(weight).alias("w"), F.percentile_approx("n", 0.5).alias("mid")).filter(F.col("w") > tile)
    large = checkpoint(large.withColumn("parts", F.ceil(F.col("w") / tile).cast("int")))
    if large.isEmpty():
        return None
    # each large group's row stands once for every salt, so that no task of the join holds a whole group
    spread = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64(F.lit("salt"), "id"), F.lit(SALTS)).cast("int")
    inside = groups.withColumn("salt", salt).join(spread, ["grp", "salt"]).drop("salt")
    centre = inside.groupBy("grp", "parts").agg(F.min_by(F.struct("id", "n"), F.struct(F.abs(F.col("n") - F.col("mid")), F.col("id"))).alias("c"))
    centre = centre.select("grp", "parts", F.col("c.id").alias("centre"), F.col("c.n").alias("cn")).join(
        data.select(F.col("id").alias("centre"), F.col("data").alias("cdata")), "centre"
    ).select("grp", "centre", "cn", "cdata", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    rows = inside.select("id", "grp", "n", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part")).join(data, "id")
    both = rows.join(centre, ["grp", "part"]).select("id", "n", "data", "centre", "cn", "cdata")
    return checkpoint(both.mapInArrow(_star(percent, exact), "src long, dst long"))


def links_of_groups(groups: DataFrame, data: DataFrame, percent: int, exact: bool) -> DataFrame:
    """(id, grp, n) and (id, data) -> (src, dst): what links connect inside the groups."""
    small = SMALL if exact else SMALL // 2
    star = star_links(groups, data, percent, exact, F.greatest(F.col("n"), F.lit(small)), TILE)
    if star is None:
        marked = groups.withColumn("tied", F.lit(False))
    else:
        tied = star.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("tied", F.lit(True))
        marked = groups.join(tied, "id", "left").withColumn("tied", F.coalesce("tied", F.lit(False)))
    placed, sides = tile_work(marked, percent, small, TILE)
    work = data.join(placed.select("id", "grp", "tile", "n", "tied"), "id").join(sides, ["grp", "tile"])
    links = work.select("grp", "ta", "tb", "left", "tied", "id", "n", "data").groupBy("grp", "ta", "tb").applyInArrow(
        _tiles(percent, exact), "src long, dst long"
    )
    return links if star is None else links.unionByName(star)


def chains(keys: DataFrame) -> DataFrame:
    """(key, id) -> (src, dst), checkpointed: each id with the smallest of each key that it shares; ``keys`` is read 1 + ``PASSES`` times.

    A key that many hold is one row per task before the shuffle of the minima, and
    many rows that meet one row in the join, which Spark can split.  The minima
    are found for one share of the keys after the other, so that only one share is on disk as shuffle files.
    """
    spark = keys.sparkSession
    shares = []
    for k in range(PASSES):
        mine = keys.filter(F.pmod("key", F.lit(PASSES)) == k)
        mine = mine.groupBy("key").agg(F.min("id").alias("dst"), F.max("id").alias("top")).filter("dst < top").select("key", "dst")
        shares.append(checkpoint(mine))
        del mine
        free_shuffles(spark)
    shared = functools.reduce(DataFrame.unionByName, shares)
    bits = spark.sparkContext.broadcast(hash_filter(shared.select("key"), shared.count()))

    def held(batches):
        for batch in batches:
            hit = in_filter(bits.value, batch.column(0).to_numpy(zero_copy_only=False))
            if hit.any():
                yield batch.filter(pa.array(hit))

    found = keys.mapInArrow(held, "key long, id long").join(shared, "key")
    found = checkpoint(found.filter("id <> dst").select(F.col("id").alias("src"), "dst").distinct())
    bits.destroy()
    return found


def tile_work(members: DataFrame, percent: int, small: int, tile: int) -> tuple[DataFrame, DataFrame]:
    """(id, grp, n, tied) -> (id, grp, tile, n, tied) and (grp, tile, ta, tb, left): who meets whom.

    Tied sets of a group are connected, so their tiles do not meet each other.  Ranks by size come from counts per
    (group, tied, size), so no group is sorted in one task; sets of one size are
    spread by hash over the tiles they span.
    """
    weight = F.greatest(F.col("n"), F.lit(small))
    sizes = members.groupBy("grp", "tied", "n").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("grp", "tied").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("grp", "tied", "n", "c", F.coalesce(F.sum(F.col("c") * weight).over(w), F.lit(0)).alias("c0"))
    placed = members.join(sizes, ["grp", "tied", "n"]).select(
        "grp", "id", "n", "tied",
        F.expr(f"cast(2 * ((c0 + pmod(xxhash64(id), c) * greatest(n, {small})) div {tile}) + cast(tied as int) as long)").alias("tile"),
    )
    placed = checkpoint(placed)
    spans = placed.groupBy("grp", "tile", "tied").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    can = f"100 * a.hi >= {percent} * b.lo and 100 * b.hi >= {percent} * a.lo"
    pairs = spans.alias("a").join(spans.alias("b"), F.expr(f"a.grp = b.grp and a.tile <= b.tile and not (a.tied and b.tied) and {can}")).select(
        F.col("a.grp").alias("grp"), F.col("a.tile").alias("ta"), F.col("b.tile").alias("tb")
    )
    sides = pairs.select("grp", F.col("ta").alias("tile"), "ta", "tb", F.lit(True).alias("left")).unionByName(
        pairs.filter("ta < tb").select("grp", F.col("tb").alias("tile"), "ta", "tb", F.lit(False).alias("left"))
    )
    return placed, sides


def _components(docs: DataFrame, n: int, percent: int, tie_ids: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, classes, components): (doc_id, text_hash, n_shingles, id, low_id), (id, low_id), (id, component).

    With ``tie_ids`` the classes that rows of one doc_id fall into are connected.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = checkpoint(_texts(docs).mapInArrow(_rows(n), _ROWS))
    fp = ["fp1", "fp2", "n_shingles"]
    low = rows.filter("n_shingles > 0 and doc_id is not null").groupBy(*fp).agg(
        F.min("doc_id").alias("low_id"), F.min_by("text_hash", "doc_id").alias("low_hash")
    )
    low = checkpoint(low.withColumn("id", F.monotonically_increasing_id()))
    rep = low.select(F.col("low_id").alias("doc_id"), F.col("low_hash").alias("text_hash"), "id", F.col("n_shingles").alias("n"))
    classed = checkpoint(
        rows.drop("bits").withColumn("_own", F.col("doc_id").isNotNull())
        .join(low.withColumn("_own", F.lit(True)), [*fp, "_own"], "left")
        .select("doc_id", "text_hash", "n_shingles", "id", "low_id")
    )

    frequent = spark.sparkContext.broadcast(frequent_shingles(docs, n))
    path = f"{shared_folder(spark)}/keys-{uuid.uuid4().hex}"
    filed = _texts(docs).filter("doc_id is not null").select("doc_id", "text").mapInArrow(_keys(n, percent, frequent), "key long, id long")
    filed.write.parquet(path)
    frequent.destroy()
    found = chains(spark.read.schema("key long, id long").parquet(path))
    delete_path(spark, path)
    free_shuffles(spark)
    name = classed.filter("id is not null").select("doc_id", "id").distinct()
    linked = found.join(name.select(F.col("doc_id").alias("src"), F.col("id").alias("a")), "src").join(
        name.select(F.col("doc_id").alias("dst"), F.col("id").alias("b")), "dst"
    ).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    groups = connected_components(linked).select("id", F.col("component").alias("grp"))
    drop_checkpoint(found)
    members = checkpoint(groups.join(rep, "id"))
    maps = rows.join(members.select("doc_id", "text_hash", "id"), ["doc_id", "text_hash"]).dropDuplicates(["id"])
    close = links_of_groups(members.select("id", "grp", "n"), maps.select("id", F.col("bits").alias("data")), percent, exact=False)
    groups = connected_components(close).select("id", F.col("component").alias("grp"))
    drop_checkpoint(members)
    drop_checkpoint(rows)
    members = checkpoint(groups.join(rep, "id"))
    sets, bits = _wanted_sets(docs, members, n)
    sets = sets.dropDuplicates(["id"])
    links = links_of_groups(members.select("id", "grp", "n"), sets.select("id", F.col("shingles").alias("data")), percent, exact=True)
    if tie_ids:
        several = classed.filter("id is not null").groupBy("doc_id").agg(F.min("id").alias("dst"), F.max("id").alias("top")).filter("dst < top")
        links = links.unionByName(classed.join(several, "doc_id").select(F.col("id").alias("src"), "dst"))
    found = connected_components(links)
    bits.destroy()
    return classed, low.select("id", "low_id"), found


def link_components(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id) of every row of ``docs``."""
    classed, low, found = _components(docs, n, percent, tie_ids=True)
    named = found.join(low, "id")
    least = named.groupBy("component").agg(F.min("low_id").alias("component_id"))
    found = named.join(least, "component").select("id", "component_id")
    return classed.join(found, "id", "left").select(
        "doc_id", "text_hash", "n_shingles",
        F.coalesce("component_id", "low_id", "doc_id").alias("component_id"),
    )


def keep_one(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each group: the smallest by doc_id, then by a hash of the text.

    Rows with a null doc_id and rows without words stay.  Rows of one doc_id with
    different texts are judged each by its own text.
    """
    classed, _, found = _components(docs, n, percent, tie_ids=False)
    own = classed.filter("id is not null").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    each = checkpoint(own.groupBy("doc_id", "text_hash").agg(F.min("component").alias("component"), F.count(F.lit(1)).alias("c")))
    first = each.groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("f"))
    judged = each.join(first, "component").withColumn("stays", F.struct("doc_id", "text_hash") == F.col("f"))
    gone = judged.filter("not stays or c > 1").select("doc_id", "text_hash", "stays")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_hash(F.coalesce("text", F.lit(""))).alias("text_hash"))
    key = ["doc_id", "text_hash"]
    rest = rows.join(gone.select(*key), key, "left_anti").select("row")
    repeated = rows.join(gone.filter("stays").select(*key), key, "left_semi").dropDuplicates(key).select("row")
    return rest.unionByName(repeated).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
