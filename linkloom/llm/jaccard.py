"""N-gram Jaccard join: MinHash banding, then exact similarity on full n-gram sets.

1. Every document gets the digest of its set of five-word shingles, the size of the set and the band hashes of
   its MinHash signature. Documents of one digest are one class (similarity 1).
2. Classes that share a band hash are tied to the least of them; components of those ties
   are coarse clusters that hold every candidate pair.
3. A cluster is cut by set size, in steps of the threshold, as sets of unlike sizes can't be similar: a class meets
   its own step and the next one. Steps are dealt to blocks of at most ``BLOCK`` classes and ``BLOCK_BYTES`` of sets, and
   a pair of blocks is one unit of work, so none gathers an unbounded group.
4. In a unit the candidates are the pairs that share a band; those are compared on their full sets. A unit
   gives counts of links and a spanning forest, never all pairs.
5. Components of the forest edges are the near-duplicate classes.

Bands and rows follow from the wanted recall: the fewest hashes whose chance to miss a
pair at the threshold is at most 1 - recall.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.common import Words, map_arrow, mix, ngram_hash, run_groups, table, text_id
from linkloom.operators.components import checkpoint, components

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.999
BLOCK = 256
BLOCK_BYTES = 4 << 20
_U = np.uint64


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = 256) -> tuple[int, int]:
    """(bands, rows): the most selective split of at most ``most`` hashes that reaches ``recall``.

    Of the splits whose chance to share a band at the threshold is at least ``recall``, the one with
    the most rows within half of ``most`` hashes, or within all of them.
    """
    for limit in (most // 2, most):
        for rows in range(limit, 0, -1):
            miss = np.log1p(-(threshold**rows)) if threshold < 1 else -np.inf  # log chance to miss one band
            if np.log(1 - recall) >= limit // rows * miss:
                return max(1, int(np.ceil(np.log(1 - recall) / miss))), rows
    return most, 1


def shingle_sets(words: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts, first of each text).

    A text of fewer than k words is one shingle; one without words has none.
    """
    n = np.diff(words.first)
    grams = ngram_hash(words.hash, k)
    count = np.maximum(n - k + 1, 0)
    owner = np.repeat(np.arange(len(n)), count)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    values = grams[words.first[owner] + inside] if len(owner) else np.zeros(0, _U)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        sums = np.array([mix(np.array([hash_short(words.hash[words.first[i] : words.first[i] + n[i]])], _U))[0] for i in short], _U)
        owner, values = np.r_[owner, short], np.r_[values, sums]
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    new = np.r_[True, (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])] if len(owner) else np.zeros(0, bool)
    owner, values = owner[new], values[new]
    return values, np.searchsorted(owner, np.arange(len(n) + 1))


def hash_short(h: np.ndarray) -> int:
    total = len(h)
    for x in h.tolist():
        total = (total * 0x100000001B3 ^ x) & 0xFFFFFFFFFFFFFFFF
    return total


def band_hashes(values: np.ndarray, first: np.ndarray, bands: int, rows: int, seed: int = 1) -> np.ndarray:
    """Band hashes of each set (all-ones for an empty set), shape (sets, bands)."""
    rng = np.random.default_rng(seed)
    factors = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * _U(2) + _U(1)
    shifts = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
    some = np.flatnonzero(np.diff(first) > 0)
    out = np.full((len(first) - 1, bands), ~_U(0))
    if not len(some):
        return out
    starts = first[some]
    x = mix(values)
    for b in range(bands):
        h = np.full(len(some), _U(b))
        for r in range(b * rows, (b + 1) * rows):
            h = mix(h ^ np.minimum.reduceat((x ^ shifts[r]) * factors[r], starts))
        out[some, b] = h
    return out


def _signatures(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> dict:
        values, first = shingle_sets(Words(batch.column(2)))
        hashes = band_hashes(values, first, bands, rows).view(np.int64)
        empty = np.diff(first) == 0
        # 128-bit digest of the set from sums of two mixings
        sums = [np.add.reduceat(np.r_[mix(values ^ _U(s)), _U(0)], np.minimum(first[:-1], len(values))) for s in (0x51, 0xA7)]
        digest = np.stack(sums, axis=1)
        digest[:, 0] += np.diff(first).astype(_U)
        data = np.ascontiguousarray(digest).tobytes()
        cls = [None if e else data[16 * i : 16 * i + 16] for i, e in enumerate(empty)]
        offsets = np.arange(0, hashes.size + 1, bands, dtype=np.int32)
        return {
            "doc_id": batch.column(0), "tid": batch.column(1), "cls": cls, "size": np.diff(first).astype(np.int32),
            "bands": pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes.ravel())),
        }

    return map_arrow(docs, run, "doc_id long, tid binary, cls binary, size int, bands array<long>")


def _compare(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Links within and between blocks. Rows out: (cls, links) and, as edges, (cls, other)."""
    names = ["cls", "other", "links"]
    for group in run_groups(batches, "unit"):
        side = group.column("side").to_numpy()
        within = group.column("within")[0].as_py()
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == (0 if within else 1))
        if len(side) < 2 or not len(a) or not len(b):  # alone, or the other block is empty
            continue
        bands = group.column("bands").combine_chunks().flatten().to_numpy().reshape(len(side), -1)
        candidate = np.zeros((len(a), len(b)), bool)
        for k in range(bands.shape[1]):
            candidate |= bands[a, k][:, None] == bands[b, k][None, :]
        if within:
            np.fill_diagonal(candidate, False)
        if not candidate.any():
            continue
        sets = [np.frombuffer(x, _U) for x in group.column("grams").to_pylist()]
        linked = _linked(sets, a, b, candidate, threshold)
        cls, weight = group.column("cls").to_pylist(), group.column("copies").to_numpy()
        links = np.zeros(len(cls), np.int64)
        links[a] += linked @ weight[b]
        full = np.zeros((len(cls), len(cls)), bool)
        full[np.ix_(a, b)] = linked
        if not within:
            links[b] += linked.T @ weight[a]
            full |= full.T
        parent = forest(full)
        keep = np.flatnonzero(links)
        other = [cls[parent[i]] if parent[i] != i else None for i in keep]
        yield pa.RecordBatch.from_arrays([pa.array([cls[i] for i in keep], pa.binary()), pa.array(other, pa.binary()), pa.array(links[keep])], names=names)


def _linked(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, candidate: np.ndarray, threshold: float, cells: int = 2_000_000) -> np.ndarray:
    """Which candidates of sets a and b have a Jaccard similarity of at least ``threshold``."""
    out = np.zeros(candidate.shape, bool)
    n = np.count_nonzero(candidate)
    if n <= 2 * len(sets):  # few: pair by pair, each once
        known: dict[tuple[int, int], bool] = {}
        for i, j in zip(*np.nonzero(candidate), strict=True):
            key = (min(a[i], b[j]), max(a[i], b[j]))
            if key not in known:
                known[key] = _jaccard_at_least(sets[a[i]], sets[b[j]], threshold)
            out[i, j] = known[key]
        return out
    size = np.array([len(s) for s in sets])
    used = np.unique(np.r_[a[candidate.any(1)], b[candidate.any(0)]])
    values = np.concatenate([sets[i] for i in used])
    owner = np.repeat(np.arange(len(used)), size[used])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.r_[True, values[1:] != values[:-1]]
    number = np.cumsum(new) - 1
    shared = np.bincount(number)[number] > 1  # a gram of one set alone is in no intersection
    owner, number = owner[shared], number[shared]
    number = np.cumsum(np.r_[True, number[1:] != number[:-1]])[: len(number)] - 1
    row = np.full(len(sets), -1)
    row[used] = np.arange(len(used))
    both = np.zeros((len(used), len(used)), np.float32)
    width = int(number[-1]) + 1 if len(number) else 0
    step = max(1, cells // len(used))
    for at in range(0, width, step):
        lo, hi = np.searchsorted(number, (at, at + step))
        m = np.zeros((len(used), min(step, width - at)), np.float32)
        m[owner[lo:hi], number[lo:hi] - at] = 1
        both += m @ m.T
    i, j = np.nonzero(candidate)
    x, y = a[i], b[j]
    common = both[row[x], row[y]]
    out[i, j] = common >= threshold * (size[x] + size[y] - common) - 1e-6
    return out


def _jaccard_at_least(x: np.ndarray, y: np.ndarray, threshold: float) -> bool:
    if min(len(x), len(y)) < threshold * max(len(x), len(y)) - 1e-6:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= threshold * (len(x) + len(y) - both) - 1e-6


def forest(linked: np.ndarray) -> np.ndarray:
    """For each row the first row of its component, by spreading over the matrix."""
    parent = np.arange(len(linked))
    seen = np.zeros(len(linked), bool)
    for i in range(len(linked)):
        if seen[i]:
            continue
        front = np.zeros(len(linked), bool)
        front[i] = True
        reached = front
        while front.any():
            front = linked[front].any(0) & ~reached
            reached = reached | front
        parent[reached & ~seen] = i
        seen |= reached
    return parent


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, kept.

    class_id is the least doc_id that links lead to, the document's own included; kept marks the
    row with doc_id = class_id. n_links counts the other documents of similarity ``threshold`` or
    more. Null and empty texts link with nothing and form a class each (a null doc_id keeps
    class_id null). Texts of any length are compared whole; a pair at the threshold is linked, and of equal texts the
    least doc_id names the class. Repeated rows link with each other like copies. An empty table gives no rows; other columns are ignored.
    """
    bands, rows = choose_bands(threshold, recall)
    base = docs.select("doc_id", text_id(F.col("text")).alias("tid"), F.coalesce("text", F.lit("")).alias("text"))
    signed = checkpoint(_signatures(base, bands, rows))
    classes = signed.where("cls is not null").groupBy("cls").agg(
        F.count("*").alias("copies"), F.min("doc_id").alias("least"), F.min("tid").alias("tid"), F.max("size").alias("size"), F.first("bands").alias("bands")
    )
    classes = checkpoint(classes)
    keyed = classes.select("cls", F.posexplode("bands")).select("cls", F.xxhash64("pos", "col").alias("band"))
    heads = keyed.groupBy("band").agg(F.min("cls").alias("head"), F.count("*").alias("n")).where("n > 1").select("band", "head")
    heads = checkpoint(heads)  # so that the join has plain shuffles on both sides, and a large group can be split
    ties = keyed.join(heads, "band").where("cls <> head").select(F.col("cls").alias("u"), F.col("head").alias("v"))
    coarse = components(ties)
    # sizes within the threshold of each other lie in one step or in neighbouring ones
    members = coarse.join(classes.select(F.col("cls").alias("u"), "tid", "copies", "size", "bands"), "u").withColumn(
        "step", F.floor(F.log("size") / math.log(1 / threshold) + 1e-9).cast("int") if threshold < 1 else F.col("size")
    )
    steps = members.groupBy("component", "step").agg(F.count("*").alias("m"), F.sum(F.col("size").cast("long")).alias("grams"))
    steps = checkpoint(steps.select("component", "step", F.ceil(F.greatest(F.col("m") / block, F.col("grams") * 8 / BLOCK_BYTES)).cast("int").alias("blocks")))
    below = steps.select("component", (F.col("step") + 1).alias("step"), F.col("blocks").alias("blocks_below"))
    above = steps.select("component", (F.col("step") - 1).alias("step"), F.col("blocks").alias("blocks_above"))
    steps = checkpoint(steps.join(below, ["component", "step"], "left").join(above, ["component", "step"], "left"))
    members = members.join(steps, ["component", "step"]).withColumn("own", F.pmod(F.xxhash64("u"), F.col("blocks")).cast("int"))

    def meets(n: str, unit: Callable) -> Column:
        n = F.coalesce(n, F.lit(0))
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), unit)).otherwise(F.array().cast("array<struct<unit:bigint,side:int,within:boolean>>"))

    def unit(step: Column, kind: int, i: Column, j: Column, side: Column, within: Column) -> Column:
        return F.struct(F.xxhash64("component", step, F.lit(kind), i, j).alias("unit"), side.cast("int").alias("side"), within.alias("within"))

    own, step = F.col("own"), F.col("step")
    units = F.concat(
        meets("blocks", lambda j: unit(step, 0, F.least(own, j), F.greatest(own, j), own > j, own == j)),
        meets("blocks_above", lambda j: unit(step, 1, own, j, F.lit(0), F.lit(False))),
        meets("blocks_below", lambda j: unit(step - 1, 1, j, own, F.lit(1), F.lit(False))),
    )
    # one text of each digest, combined before the shuffle: copies don't pile up on a key
    texts = base.groupBy("tid").agg(F.max("text").alias("text")).join(members.select("tid").distinct(), "tid")

    def grams(batch: pa.RecordBatch) -> dict:
        values, first = shingle_sets(Words(batch.column(1)))
        data = values.tobytes()
        return {"tid": batch.column(0), "grams": [data[8 * a : 8 * b] for a, b in zip(first[:-1], first[1:], strict=True)]}

    sets = map_arrow(texts, grams, "tid binary, grams binary")
    work = members.join(sets, "tid").select(F.col("u").alias("cls"), "copies", "grams", "bands", F.explode(units).alias("at"))
    work = work.select("at.unit", "cls", "copies", "grams", "bands", "at.side", "at.within")
    # blocks of one cluster lie in different partitions
    work = work.repartition("unit").sortWithinPartitions("unit")
    found = checkpoint(work.mapInArrow(lambda batches: _compare(batches, threshold), "cls binary, other binary, links long"))
    joined = components(found.where("other is not null").select(F.col("cls").alias("u"), F.col("other").alias("v")))
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    info = classes.select("cls", "copies", "least").join(links, "cls", "left").join(joined.withColumnRenamed("u", "cls"), "cls", "left")
    info = info.withColumn("component", F.coalesce("component", "cls"))
    info = checkpoint(info)
    roots = info.groupBy("component").agg(F.min("least").alias("class_id"))
    info = info.join(roots, "component").select("cls", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = signed.select("doc_id", "cls").join(info, "cls", "left").withColumn("class_id", F.coalesce("class_id", "doc_id"))
    return out.select(
        "doc_id", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.expr("doc_id <=> class_id").alias("kept")
    )


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Every pair that shares a shingle, without bands; the links are the same up to the recall of the bands.
OP3_SQL = r"""
WITH RECURSIVE
texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM texts),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS n FROM shingles a JOIN shingles b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS MATERIALIZED (
  SELECT u, v FROM shared s JOIN sizes a ON s.u = a.doc_id JOIN sizes b ON s.v = b.doc_id WHERE 5 * s.n >= 4 * (a.n + b.n - s.n)),
reach AS (SELECT DISTINCT u, u AS w FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.w = l.u),
least AS (SELECT u, min(w) AS least FROM reach GROUP BY u),
linked AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT doc_id, coalesce(least, doc_id) AS class_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(least, doc_id) = doc_id AS kept
FROM documents d LEFT JOIN least ON least.u = d.doc_id LEFT JOIN linked ON linked.u = d.doc_id
"""
