"""Vector code compression: product codes by integer k-means with Drake-Hamerly bounds.

A vector of integers is cut into equal parts; each part position has a codebook of its own,
and a part's code is the index of its nearest entry. Between the rounds every vector keeps, for each
part, its ``b`` closest entries with a lower bound on the distance to each, ordered when written, and one outer
bound for all other entries (Drake and Hamerly, 2012). When entries have moved, bounds shrink by what
they moved; a part whose distance to its own entry is below the next bound stays without a
comparison, one that is below a later bound is compared with the entries before it, and only
the rest is compared with the whole codebook. ``b`` adapts: a part keeps as many bounds as it
has just used, at least an eighth of the entries, and a quarter of them after a whole comparison.

Bounds and distances are double precision with room for rounding. Wherever two entries could be
equally near, the squared distances are compared as integers: in 64 bits where they fit, as
Python's otherwise. The state of each round is a table in the shared folder; only codebooks
(parts x entries x numbers) reach the driver.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.common import map_arrow, table
from linkloom.operators.components import remove, shared_folder

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
MAX_LONG = 2**63 - 1
#: Numbers below this have differences whose squares sum to less than 2**62 over 16 numbers.
SMALL = 1 << 28
#: Relative room for the rounding of a distance in double precision.
ROOM = 1e-12
STATE = "q binary, size binary, near binary, low binary, outer binary"


def _usable_vector():
    """Not null, and every component a finite number; without components there is nothing unusable."""
    return F.col("embedding").isNotNull() & F.coalesce(
        F.forall("embedding", lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False))), F.lit(False)
    )


def _numbers(column: pa.Array, scale: int) -> np.ndarray:
    """floor(scale * x) of vectors of one length, as doubles, which hold them exactly."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        q = np.floor(values * scale) + 0.0
    limit = np.finfo(float).max
    return np.clip(q, -limit, limit).reshape(len(column), -1)


class Codebook:
    """Entries of one part position: whole numbers of any size."""

    def __init__(self, rows: list[list[int]]):
        self.rows = rows
        self.x = np.array([[float(v) for v in r] for r in rows], np.float64).reshape(len(rows), -1)
        self.small = all(abs(v) < SMALL for r in rows for v in r) and self.x.shape[1] <= 16
        self.whole = np.array(rows, np.int64).reshape(self.x.shape) if self.small else None
        # what an entry that a double can't hold may be away from its double
        self.off = np.where(np.abs(self.x).max(1, initial=0) > 2.0**53, np.sqrt((self.x / 2.0**52) ** 2 @ np.ones(self.x.shape[1])), 0.0)

    def moved(self, other: Codebook) -> np.ndarray:
        """How far each entry is from that of another codebook, rounded up."""
        return np.sqrt(((self.x - other.x) ** 2).sum(1)) * (1 + ROOM) + self.off + other.off

    def distances(self, q: np.ndarray, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the distances to all entries, or to those at ``at`` (rows x some)."""
        x, off = (self.x[None], self.off[None]) if at is None else (self.x[at], self.off[at])
        with np.errstate(over="ignore", invalid="ignore"):
            d = np.sqrt(((q[:, None, :] - x) ** 2).sum(2))
        d = np.where(np.isfinite(d), d, np.inf)
        low = np.where(np.isfinite(d), d * (1 - ROOM) - off, 0.0)
        return np.maximum(low, 0.0), d * (1 + ROOM) + off

    def exact(self, q: np.ndarray, entry: int) -> int:
        return sum((int(a) - b) ** 2 for a, b in zip(q.tolist(), self.rows[entry], strict=True))

    def errors(self, q: np.ndarray, entry: np.ndarray) -> list[int]:
        """Squared distances to the given entries, exactly."""
        fits = np.abs(q).max(1, initial=0) < SMALL if self.small else np.zeros(len(q), bool)
        out: list[int] = [0] * len(q)
        at = np.flatnonzero(fits)
        if len(at):
            for i, e in zip(at.tolist(), ((q[at].astype(np.int64) - self.whole[entry[at]]) ** 2).sum(1).tolist(), strict=True):
                out[i] = e
        for i in np.flatnonzero(~fits):
            out[i] = self.exact(q[i], int(entry[i]))
        return out

    def nearest(self, q: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Column of ``at`` (rows x entries) with the nearest entry; of ties, that of the least entry.

        Rows whose bounds leave several entries are settled in whole numbers.
        """
        open_ = low <= high.min(1, keepdims=True)
        best = np.argmin(high, 1)
        rows, cols = np.nonzero(open_ & (open_.sum(1) > 1)[:, None])
        if len(rows):
            exact = np.array(self.errors(q[rows], at[rows, cols]), dtype=object)
            if max(exact) < 2**62:
                exact = exact.astype(np.int64)
            order = np.lexsort((at[rows, cols], exact, rows)) if exact.dtype != object else np.array(
                sorted(range(len(rows)), key=lambda i: (rows[i], exact[i], at[rows[i], cols[i]]))
            )
            first = order[np.r_[True, rows[order][1:] != rows[order][:-1]]]
            best[rows[first]] = cols[first]
        return best


def assign(q: np.ndarray, book: Codebook, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A whole comparison: (near, low, outer), the ``keep`` nearest entries in order, the own one first."""
    k = len(book.rows)
    low, high = book.distances(q)
    every = np.broadcast_to(np.arange(k), low.shape)
    own = book.nearest(q, every, low, high)
    rank = low.copy()
    rank[np.arange(len(q)), own] = -1.0
    order = np.argsort(rank, axis=1, kind="stable")
    keep = min(keep, k)
    near = order[:, :keep]
    outer = np.take_along_axis(low, order[:, keep : keep + 1], 1)[:, 0] if keep < k else np.full(len(q), np.inf)
    return near, np.take_along_axis(low, near, 1), outer


def reassign(
    q: np.ndarray, book: Codebook, moved: np.ndarray, size: np.ndarray, near: np.ndarray, low: np.ndarray, outer: np.ndarray, least: int, most: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The state after the entries have moved, and how many bounds each row used (0: a whole comparison).

    ``near`` and ``low`` (rows x ``most``) are valid in the first ``size`` columns.
    """
    n, width = near.shape
    valid = np.arange(width) < size[:, None]
    low = np.where(valid, np.maximum(low - moved[near], 0.0), np.inf)
    outer = np.maximum(outer - moved.max(initial=0.0), 0.0)
    # a bound for the entries from each place on, the outer ones included
    after = np.minimum(np.minimum.accumulate(low[:, ::-1], 1)[:, ::-1], outer[:, None])
    after = np.where(valid, after, outer[:, None])
    own_low, own = book.distances(q, near[:, :1])
    low[:, 0] = own_low[:, 0]
    safe = np.c_[after[:, 1:], outer] > own  # from place j + 1 on nothing can be as near as the own entry
    used = np.where(safe.any(1), np.argmax(safe, 1) + 1, 0)
    used = np.where(used > size, 0, used)
    some = np.flatnonzero(used > 1)
    if len(some):
        reach = int(used[some].max())
        inside = np.arange(reach) < used[some, None]
        a = near[some, :reach]
        lo, hi = book.distances(q[some], a)
        best = book.nearest(q[some], a, np.where(inside, lo, np.inf), np.where(inside, hi, np.inf))
        rank = np.where(inside, lo, np.inf)
        rank[np.arange(len(some)), best] = -1.0
        order = np.argsort(rank, 1, kind="stable")
        near[some, :reach] = np.take_along_axis(a, order, 1)
        low[some, :reach] = np.take_along_axis(np.where(inside, lo, low[some, :reach]), order, 1)
    # as many bounds as were used stay, and the first one given up joins the outer bound
    kept = np.minimum(size, np.maximum(used, least))
    lost = np.where(valid & (np.arange(width) >= kept[:, None]), low, np.inf)
    outer = np.minimum(outer, lost.min(1, initial=np.inf))
    size = kept
    whole = np.flatnonzero(used == 0)
    if len(whole):
        got, lo, far = assign(q[whole], book, most)
        near[whole, : got.shape[1]], low[whole, : got.shape[1]] = got, lo
        outer[whole], size[whole] = far, got.shape[1]
    # of the bounds that stay, the order is that of their values; the own entry is first
    rank = np.where(np.arange(width) < size[:, None], low, np.inf)
    rank[:, 0] = -1.0
    order = np.argsort(rank, 1, kind="stable")
    return size, np.take_along_axis(near, order, 1), np.take_along_axis(low, order, 1), outer, used


def _float_down(x: np.ndarray) -> np.ndarray:
    """Single precision, rounded down."""
    with np.errstate(over="ignore"):
        f = x.astype(np.float32)
    return np.where(f > x, np.nextafter(f, np.float32(0)), f)


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Binary values of the given numbers of bytes, out of one after the other."""
    off = np.r_[0, np.cumsum(sizes)].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(data.tobytes())])


def _bytes(column: pa.Array, kind: type | str) -> np.ndarray:
    """All numbers of a binary column, one value after the other."""
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data or b"", np.uint8)[off[0] : off[-1]].view(kind)


class State:
    """What a batch of vectors keeps between rounds, rows x parts x bounds; entries number at most 256."""

    def __init__(self, n: int, parts: int, width: int):
        self.size = np.zeros((n, parts), np.uint8)
        self.near = np.zeros((n, parts, width), np.int64)
        self.low = np.full((n, parts, width), np.inf)
        self.outer = np.zeros((n, parts))

    def valid(self) -> np.ndarray:
        return np.arange(self.near.shape[2]) < self.size[..., None]

    def columns(self) -> dict:
        n, parts = self.size.shape
        valid, total = self.valid(), self.size.sum(1, dtype=np.int64)
        return {
            "size": _binary(self.size, np.full(n, parts)), "near": _binary(self.near[valid].astype(np.uint8), total),
            "low": _binary(_float_down(self.low[valid]), total * 4), "outer": _binary(_float_down(self.outer), np.full(n, parts * 4)),
        }

    @classmethod
    def read(cls, batch: pa.RecordBatch, parts: int, width: int) -> State:
        out = cls(batch.num_rows, parts, width)
        out.size = _bytes(batch["size"], np.uint8).reshape(-1, parts).copy()
        valid = out.valid()
        out.near[valid] = _bytes(batch["near"], np.uint8)
        out.low[valid] = _bytes(batch["low"], np.float32)
        out.outer = _bytes(batch["outer"], np.float32).reshape(-1, parts).astype(float)
        return out


def _cut(q: np.ndarray, parts: int) -> list[np.ndarray]:
    return np.split(q, parts, axis=1)


def _sums(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """(part, entry, n, totals): counts and sums of the parts that each entry has got, as decimal texts."""
    count: dict[tuple[int, int], int] = {}
    total: dict[tuple[int, int], list[int]] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        q = _bytes(batch["q"], np.float64).reshape(batch.num_rows, -1)
        size = _bytes(batch["size"], np.uint8).reshape(-1, parts).astype(np.int64)
        first = np.r_[0, np.cumsum(size.ravel())[:-1]].reshape(size.shape)
        own = _bytes(batch["near"], np.uint8)[first].astype(np.int64)
        for p, x in enumerate(_cut(q, parts)):
            small = np.abs(x).max(1, initial=0) < 2.0**40  # a batch has fewer than 2**20 rows
            order = np.flatnonzero(small)[np.argsort(own[small, p], kind="stable")]
            cut = np.flatnonzero(np.r_[True, own[order, p][1:] != own[order, p][:-1]]) if len(order) else order
            sums = np.add.reduceat(x[order].astype(np.int64), cut, axis=0).tolist() if len(order) and x.shape[1] else [[]] * len(cut)
            for i, n, s in zip(order[cut], np.diff(np.r_[cut, len(order)]).tolist(), sums, strict=True):
                key = p, int(own[i, p])
                count[key] = count.get(key, 0) + n
                total[key] = [a + b for a, b in zip(total[key], s, strict=True)] if key in total else s
            for i in np.flatnonzero(~small):
                key, s = (p, int(own[i, p])), [int(v) for v in x[i].tolist()]
                count[key] = count.get(key, 0) + 1
                total[key] = [a + b for a, b in zip(total[key], s, strict=True)] if key in total else s
    yield _sum_rows(count, total)


def _sum_rows(count: dict, total: dict) -> pa.RecordBatch:
    columns = [pa.array([k[0] for k in count], pa.int32()), pa.array([k[1] for k in count], pa.int32()), pa.array(list(count.values()), pa.int64())]
    return pa.RecordBatch.from_arrays([*columns, pa.array([",".join(map(str, total[k])) for k in count], pa.string())], names=["part", "entry", "n", "totals"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count: dict[tuple[int, int], int] = {}
    total: dict[tuple[int, int], list[int]] = {}
    for batch in batches:
        for p, e, n, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            s = [int(v) for v in t.split(",")] if t else []
            count[p, e] = count.get((p, e), 0) + n
            total[p, e] = [a + b for a, b in zip(total[p, e], s, strict=True)] if (p, e) in total else s
    yield _sum_rows(count, total)


def _next_books(state: DataFrame, books: list[Codebook], parts: int) -> list[Codebook]:
    """Every entry becomes the floor of the mean of its parts; unused ones stay."""
    schema = "part int, entry int, n long, totals string"
    sums = state.select("q", "size", "near").mapInArrow(lambda b: _sums(b, parts), schema)
    rows = [[list(r) for r in book.rows] for book in books]
    for r in sums.repartition("part", "entry").mapInArrow(_merged, schema).collect():  # parts x entries at most
        if r["totals"]:
            rows[r["part"]][r["entry"]] = [int(v) // r["n"] for v in r["totals"].split(",")]
    return [Codebook(r) for r in rows]


class Model:
    """Codebooks of all parts after the last round, and how to make codes with them."""

    def __init__(self, books: list[Codebook], length: int):
        self.books, self.length = books, length

    def digest(self) -> str:
        text = ",".join(str(v) for book in self.books for row in book.rows for v in row)
        return hashlib.sha256(text.encode()).hexdigest()


def encode(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Model | None]:
    """(vec_id, label, code, error) of every usable row, and the codebooks.

    Rows whose vector is null or holds a null or non-finite component are dropped. The code's length is
    that of the vector of the smallest vec_id; vectors of another length, and all of them if
    that isn't a multiple of ``parts``, have a null code and error. Of equal vec_ids the shorter, then smaller vector
    comes first in the first codebooks; null ids come last. Fewer rows than ``entries`` make
    smaller codebooks; of equal entries the first gets all parts. Errors beyond 64 bits are the
    largest long. Repeated rows give repeated results, empty vectors empty parts; an empty table gives no rows and no
    model; labels of any type pass through, other columns are ignored. ``entries`` is at most 256.
    """
    if not 0 < entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    spark = rows.sparkSession
    usable = rows.where(_usable_vector()).select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    order = [F.col("vec_id").asc_nulls_last(), F.size("embedding"), "embedding"]
    first = usable.orderBy(*order).select("embedding").first()
    length = None if first is None else len(first[0])

    def without_code(df: DataFrame) -> DataFrame:
        return df.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))

    if length is None or length % parts:
        return without_code(usable), None
    fitting, rest = usable.where(F.size("embedding") == length), usable.where(F.size("embedding") != length)
    start = fitting.orderBy(*order).limit(entries).select("embedding").toArrow()["embedding"].combine_chunks()  # the codebooks' own rows
    q = _numbers(start, scale)
    books = [Codebook([[int(v) for v in r] for r in x.tolist()]) for x in _cut(q, parts)]
    most, least = -(-len(q) // 4), -(-len(q) // 8)
    folder = f"{shared_folder(spark)}/vector-code-{uuid.uuid4().hex}"
    keys = f"vec_id long, label {usable.schema['label'].dataType.simpleString()}, "

    def begin(batch: pa.RecordBatch, books: list[Codebook]) -> dict:
        x = _numbers(batch["embedding"], scale)
        state = State(len(x), parts, most)
        for p, part in enumerate(_cut(x, parts)):
            near, low, outer = assign(part, books[p], most)
            state.near[:, p, : near.shape[1]], state.low[:, p, : near.shape[1]] = near, low
            state.outer[:, p], state.size[:, p] = outer, near.shape[1]
        return {"vec_id": batch["vec_id"], "label": batch["label"], "q": _binary(x, np.full(len(x), x.shape[1] * 8)), **state.columns()}

    def again(batch: pa.RecordBatch, books: list[Codebook], moved: list[np.ndarray]) -> tuple[np.ndarray, State]:
        x = _bytes(batch["q"], np.float64).reshape(batch.num_rows, -1)
        state = State.read(batch, parts, most)
        for p, part in enumerate(_cut(x, parts)):
            size, near, low, outer, _ = reassign(part, books[p], moved[p], state.size[:, p].astype(np.int64), state.near[:, p].copy(), state.low[:, p].copy(), state.outer[:, p], least, most)
            state.size[:, p], state.near[:, p], state.low[:, p], state.outer[:, p] = size, near, low, outer
        return x, state

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    kept = stored(map_arrow(fitting, lambda batch, books=books: begin(batch, books), keys + STATE), "round-0")
    for r in range(1, rounds + 1):
        new = _next_books(kept, books, parts)
        moved = [b.moved(a) for a, b in zip(books, new, strict=True)]
        books = new
        if r < rounds:

            def step(batch: pa.RecordBatch, books: list[Codebook] = books, moved: list[np.ndarray] = moved) -> dict:
                return {"vec_id": batch["vec_id"], "label": batch["label"], "q": batch["q"], **again(batch, books, moved)[1].columns()}

            kept = stored(map_arrow(kept, step, keys + STATE), f"round-{r}")
            remove(spark, f"{folder}/round-{r - 1}")

    def finish(batch: pa.RecordBatch) -> dict:
        x, state = again(batch, books, moved)
        own, error = state.near[:, :, 0], [0] * len(x)
        for p, part in enumerate(_cut(x, parts)):
            error = [a + b for a, b in zip(error, books[p].errors(part, own[:, p]), strict=True)]
        return {"vec_id": batch["vec_id"], "label": batch["label"], "code": [bytes(r).hex() for r in own.astype(np.uint8)], "error": [min(e, MAX_LONG) for e in error]}

    out = stored(map_arrow(kept, finish, keys + "code string, error long"), "codes")
    remove(spark, f"{folder}/round-{rounds - 1}")
    return out.unionByName(without_code(rest)), Model(books, length)


def op12_vector_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, model = encode(table(spark, sf_dir, "embeddings"))
    total = F.least(F.sum(F.col("error").cast("decimal(20,0)")), F.lit(MAX_LONG).cast("decimal(20,0)")).cast("long")
    per = coded.groupBy(F.col("label").alias("of")).agg(total.alias("label_error"))
    out = coded.join(per, F.col("label").eqNullSafe(F.col("of")), "left")
    return out.select("vec_id", "code", "error", "label_error", F.lit(model.digest() if model else None).cast("string").alias("codebooks_sha256"))


def _op12_sql() -> str:
    rounds = []
    for r in range(ROUNDS + 1):
        rounds.append(f"""
distances{r} AS (
  SELECT q.row, q.part, b.entry, list_sum(list_transform(list_zip(q.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::HUGEINT AS d
  FROM parts q JOIN book{r} b ON q.part = b.part),
nearest{r} AS MATERIALIZED (SELECT row, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM distances{r} GROUP BY row, part)""")
        if r < ROUNDS:
            rounds.append(f"""
sums{r} AS (
  SELECT part, entry, place, sum(value)::HUGEINT AS s, count(*)::HUGEINT AS n
  FROM nearest{r} JOIN (SELECT row, part, unnest(v) AS value, generate_subscripts(v, 1) AS place FROM parts) USING (row, part) GROUP BY part, entry, place),
means{r} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY place) AS v FROM sums{r} GROUP BY part, entry),
book{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM book{r} b LEFT JOIN means{r} m USING (part, entry))""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::HUGEINT) AS v, row_number() OVER (ORDER BY vec_id) AS row
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT row, part, v[part * len(v) // {PARTS} + 1 : (part + 1) * len(v) // {PARTS}] AS v FROM kept, (SELECT unnest(range({PARTS})) AS part)),
book0 AS MATERIALIZED (SELECT part, row - 1 AS entry, v FROM parts WHERE row <= {ENTRIES}),{",".join(rounds)},
coded AS (
  SELECT row, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM nearest{ROUNDS} GROUP BY row),
digest AS (
  SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN coded USING (row), digest
"""


OP12_SQL = _op12_sql()
