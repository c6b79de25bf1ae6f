"""URL filters: sorted array of 64-bit xxhash digests, memory-mapped and probed in batches.

The blocked strings are hosts (``example.com``) or host and path (``example.com/a``). The
digest of every host suffix and of suffix + path is computed by Spark's ``xxhash64``;
workers binary-search the sorted digests and compare the stored string of each hit, so a
digest collision never blocks a url. Lists up to ``max_list_bytes`` are one array that is broadcast; longer
ones are arrays by ranges of digests, and the distinct candidates are dealt to them.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.common import map_arrow, table
from linkloom.operators.skew import hub_join

#: Names of blocked sites, each under three domains.
BLOCKED_NAMES = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
BLOCKED_DOMAINS = ("example.com", "example.net", "example.org")
#: Fixed values: (verdict, host, path).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
MAX_LIST_BYTES = 64 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): both empty for null or a url without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def candidates(host: Column, path: Column) -> Column:
    """Every suffix of the host at a dot, alone and with the path."""
    parts = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    suffixes = F.filter(suffixes, lambda s: s != "")
    return F.concat(suffixes, F.when(path == "", F.array().cast("array<string>")).otherwise(F.transform(suffixes, lambda s: F.concat(s, path))))


class Digests:
    """A sorted array of digests, memory-mapped, and the strings that they are of."""

    def __init__(self, keys: np.ndarray, strings: pa.Array):
        order = np.argsort(keys, kind="stable")
        self.strings = strings.take(pa.array(order))
        with tempfile.TemporaryFile() as f:  # without a name: gone when the worker ends
            f.write(keys[order].tobytes())
            f.flush()
            self.keys = np.memmap(f, np.int64, "r") if len(keys) else np.zeros(0, np.int64)

    def has(self, probe: np.ndarray, words: pa.Array) -> np.ndarray:
        """Whether each word is among the strings, given its digest: binary search, then the full strings of the hits."""
        lo, hi = np.searchsorted(self.keys, probe, "left"), np.searchsorted(self.keys, probe, "right")
        out = np.zeros(len(probe), bool)
        at = np.flatnonzero(hi > lo)
        while len(at):  # all hits at once; strings that share a digest one after the other
            same = pc.equal(self.strings.take(pa.array(lo[at])), words.take(pa.array(at))).to_numpy(zero_copy_only=False).astype(bool)
            out[at[same]] = True
            lo[at] += 1
            at = at[~same & (lo[at] < hi[at])]
        return out


def listed(urls: DataFrame, blocked: DataFrame, max_list_bytes: int = MAX_LIST_BYTES, digest: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """Add ``listed``, true if a candidate of (host, path) is among the strings ``entry``.

    Null or empty entries and repeated ones count for nothing. ``urls`` needs columns host and
    path, both not null, and a key ``row_id`` that is unique. A list of at most ``max_list_bytes`` is one array that every task has; a
    longer one is dealt by ranges of digests, one array per range. ``digest`` makes a long of a string.
    """
    entries = blocked.where("entry is not null and entry <> ''").select("entry").distinct()
    n, size = entries.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("entry")), F.lit(0))).first()
    urls = urls.withColumn("cands", candidates(F.col("host"), F.col("path")))
    if 16 * n + size > max_list_bytes:
        words = urls.select("row_id", F.explode("cands").alias("entry"))
        hits = _in_ranges(words.select("entry").distinct(), entries, -(-(16 * n + size) // max(max_list_bytes, 1)), digest)
        hits = hub_join(words, hits, "entry").select("row_id").distinct().withColumn("listed", F.lit(True))
        return urls.drop("cands").join(hits, "row_id", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    rows = entries.select(digest(F.col("entry")).alias("k"), "entry").toArrow()
    sent = urls.sparkSession.sparkContext.broadcast((rows["k"].to_numpy(), rows["entry"].combine_chunks()))
    opened: list[Digests] = []  # one per task

    others = [c for c in urls.columns if c not in ("cands", "hashes")]
    schema = ", ".join(f"`{c}` {urls.schema[c].dataType.simpleString()}" for c in others) + ", listed boolean"

    def run(batch: pa.RecordBatch) -> dict:
        if not opened:
            opened.append(Digests(*sent.value))
        col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        owner = np.repeat(np.arange(batch.num_rows), col["hashes"].value_lengths().to_numpy(zero_copy_only=False))
        found = opened[0].has(col["hashes"].flatten().to_numpy(zero_copy_only=False).astype(np.int64), col["cands"].flatten())
        hit = np.zeros(batch.num_rows, bool)
        hit[owner[found]] = True
        return {c: col[c] for c in others} | {"listed": hit}

    return map_arrow(urls.withColumn("hashes", F.transform("cands", lambda s: digest(s))), run, schema)


def _in_ranges(words: DataFrame, entries: DataFrame, ranges: int, digest: Callable[[Column], Column]) -> DataFrame:
    """The words (entry) that are among the entries. Both are dealt by ranges of their digests; in a task a range's entries come
    first and make its array, and its words are streamed past it."""
    bits = min(24, max(1, (ranges - 1).bit_length()))

    def dealt(df: DataFrame, word: bool) -> DataFrame:
        k = digest(F.col("entry")).cast("long")
        return df.select(F.shiftrightunsigned(k, 64 - bits).cast("int").alias("range"), F.lit(word).alias("word"), k.alias("k"), "entry")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept, array = None, [], None
        for batch in batches:
            at, word = batch["range"].to_numpy(), batch["word"].to_numpy(zero_copy_only=False)
            cut = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (word[1:] != word[:-1])]) if len(at) else []
            for a, b in zip(cut, np.r_[cut[1:], len(at)].astype(int), strict=True):
                part = batch.slice(a, b - a)
                if at[a] != now:
                    now, kept, array = at[a], [], None
                if not word[a]:
                    kept.append(part)
                elif kept:
                    if array is None:
                        table_ = pa.Table.from_batches(kept).combine_chunks()
                        array = Digests(table_["k"].to_numpy(), table_["entry"].combine_chunks())
                    found = array.has(part["k"].to_numpy(), part["entry"])
                    yield pa.RecordBatch.from_arrays([part["entry"].filter(pa.array(found))], names=["entry"])

    rows = dealt(entries, False).unionByName(dealt(words, True))
    return rows.repartition("range").sortWithinPartitions("range", "word").mapInArrow(run, "entry string")


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, else nulls; of equal lengths the first listed."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, blocked: DataFrame, rules=RULES, max_list_bytes: int = MAX_LIST_BYTES) -> DataFrame:
    """page_id, host, path, rule and verdict of every row; rules first, then the list.

    A null url has an empty host and path, no rule, and is allowed. Urls of any length are read whole; of rules of equal
    length the first listed counts. Repeated rows are judged each, an empty table gives no rows, an empty list blocks
    nothing; other columns are ignored, those named like a result too.
    """
    host, path = split_url(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    urls = urls.withColumn("row_id", F.monotonically_increasing_id())
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("listed"), "block").otherwise("allow")
    return listed(urls, blocked, max_list_bytes).select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict")
    )


def default_list(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"{n}.{d}",) for n in BLOCKED_NAMES for d in BLOCKED_DOMAINS], "entry string")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), default_list(spark))


def _sql_case(pick) -> str:
    longest = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    return "CASE " + " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{pick(v, h, p)}'" for v, h, p in longest
    ) + " END"


_SITES = " OR ".join(f"host = '{n}.{d}' OR ends_with(host, '.{n}.{d}')" for n in BLOCKED_NAMES for d in BLOCKED_DOMAINS)
OP6_SQL = f"""
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest)
SELECT page_id, host, path, {_sql_case(lambda v, h, p: h + p)} AS rule,
  COALESCE({_sql_case(lambda v, h, p: v)},
    CASE WHEN {_SITES} THEN 'block' ELSE 'allow' END) AS verdict
FROM parts
"""
