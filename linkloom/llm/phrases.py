"""Phrase collocation mining after Toivonen.

1. A sample of the documents is mined with a lowered threshold: its phrases are the *proposals*. The *negative
   border* are the phrases outside the proposals whose shorter parts are all proposals (every
   word, and every longer phrase whose first and last words but one are proposals).
2. One pass over all documents counts the occurrences of proposals and border, both exactly.
3. A border phrase that turns out frequent is a failure: phrases that hold it were not
   counted. Frequent phrases join the proposals and the next pass counts what the border gained,
   until no failure is left. Then every frequent phrase has been counted.
4. A pass gathers what the frequent phrases are made of: each is known by the phrase without its last word and
   the one without its first. Joins of these give the counts of all heads and tails, level by level.
5. A last pass finds the texts of the phrases that the result holds.

Tasks know the proposals by a bit table of fixed size; what it takes for a proposal by mistake
is counted in vain, never lost. Tasks add up their own occurrences before the shuffle, in bounded memory.
Phrases are told apart by 64-bit hashes of language and words until the last step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.llm.common import _BASE, _U, hash_spans, mix, pieces, table, utf8
from linkloom.operators.components import checkpoint

LEAST, LONGEST = 30, 4
TOP = 2000
CONTAINED = 80
SCALE = 2_000_000
#: Share of the documents in the sample, and the share of the expected count that makes a proposal.
SAMPLE, LOWERED = 0.125, 0.8
#: Bits of the table of proposals, at most: 16 MB.
MOST_BITS = 1 << 27
BITS_EACH = 16
#: Phrases of each number of words that a task holds before it hands its counts on.
HELD = 400_000
BUCKETS = 64

_LOW = np.arange(256, dtype=np.uint8)
_LOW[0x41:0x5B] += 0x20
_WORD, _CUT = np.ones(256, bool), np.zeros(256, bool)
_CUT[list(b".,;:!?\n\x0b\x0c\r")] = True
_WORD[list(b" \t")] = False
_WORD[_CUT] = False


class Phrases:
    """Words of a batch of texts and the hashes of its phrases; those of one text of one language are told apart by it."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        raw, off = utf8(texts)
        self.raw = raw = _LOW[raw]
        word, cut = _WORD[raw], np.zeros(len(raw) + 1, np.int64)
        cut[:-1] = _CUT[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[off] = True
        self.start = np.flatnonzero(word & (~np.r_[False, word[:-1]] | edge[:-1]))
        self.end = np.flatnonzero(word & (~np.r_[word[1:], False] | edge[1:])) + 1
        self.owner = np.searchsorted(off, self.start, "right") - 1
        self.piece = np.cumsum(cut)[self.start]
        codes = langs.fill_null("und").dictionary_encode()
        self.langs, self.lang = codes.dictionary.to_pylist(), codes.indices.to_numpy()
        name, at = utf8(codes.dictionary)
        self.seed = mix(hash_spans(name, at[:-1], at[1:]))
        self.of = self.seed[self.lang[self.owner]]
        self.rolled = [self.of * _BASE + hash_spans(raw, self.start, self.end)] if len(self.start) else []

    def together(self, k: int) -> np.ndarray:
        """Whether the k words from each place on stand in one piece of one text."""
        n = len(self.start) - k + 1
        return (self.piece[:n] == self.piece[k - 1 :]) & (self.owner[:n] == self.owner[k - 1 :])

    def hashes(self, k: int) -> np.ndarray:
        """Hashes of the phrases of k words that begin at each place."""
        while len(self.rolled) < k:
            last = self.rolled[-1]
            more = len(self.rolled)
            self.rolled.append(last[:-1] * _BASE + mix(self.rolled[0][more:] + _U(more)))
        return mix(self.rolled[k - 1] ^ _U(k))

    def text(self, at: int, k: int) -> str:
        return b" ".join(self.raw[a:b].tobytes() for a, b in zip(self.start[at : at + k], self.end[at : at + k], strict=True)).decode("utf-8", "replace")


class Bits:
    """A set of hashes by two bits each: no false negatives."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.mask = _U(len(words) * 64 - 1)

    def __contains__(self, h: int) -> bool:
        return bool(self.has(np.array([h], _U))[0])

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for shift in (0, 32):
            place = (h >> _U(shift)) & self.mask
            out &= (self.words[(place >> _U(6)).astype(np.int64)] >> (place & _U(63))) & _U(1) > 0
        return out


def bits_for(n: int, most: int = MOST_BITS) -> int:
    """Bits of a table for n hashes: a power of two, bounded."""
    return min(most, max(1 << 22, 1 << (BITS_EACH * max(n, 1) - 1).bit_length()))


def bit_table(hashes: DataFrame, bits: int) -> np.ndarray:
    """The table of the hashes ``h``; at most bits / 64 rows reach the driver."""
    places = F.array(*(F.shiftrightunsigned("h", s).bitwiseAND(F.lit(bits - 1)) for s in (0, 32)))
    rows = hashes.select(F.explode(places).alias("place")).select(
        F.shiftright("place", 6).alias("word"), F.expr("shiftleft(1L, cast(place & 63 as int))").alias("bit")
    )
    got = rows.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy()
    return out.view(_U)


def _reach(p: Phrases, known: Bits, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """(k, whether each phrase of k words is a proposal or in the border), for k from 1."""
    inside = np.zeros(0, bool)
    for k in range(1, longest + 1):
        if len(p.start) < k:
            return
        near = np.ones(len(p.start), bool) if k == 1 else inside[:-1] & inside[1:] & p.together(k)
        yield k, near
        inside = near.copy()
        inside[near] = known.has(p.hashes(k)[near])


class _Counter:
    """Occurrences per (hash, number of words), handed on when there are too many to hold."""

    def __init__(self, held: int):
        self.held, self.new, self.n = held, [], 0
        self.h, self.count = np.zeros(0, _U), np.zeros(0, np.int64)

    def add(self, h: np.ndarray) -> None:
        self.new.append(h)
        self.n += len(h)

    def merge(self) -> None:
        if self.new:
            h, count = np.unique(np.concatenate(self.new), return_counts=True)
            both, back = np.unique(np.r_[self.h, h], return_inverse=True)
            self.count = np.bincount(back, np.r_[self.count, count], len(both)).astype(np.int64)  # counts of one task stay below 2**53
            self.h, self.new, self.n = both, [], 0

    def full(self) -> bool:
        if self.n > self.held:
            self.merge()
        return len(self.h) > self.held

    def rows(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        self.merge()
        for at in range(0, len(self.h), 1 << 16):
            yield self.h[at : at + (1 << 16)], self.count[at : at + (1 << 16)]
        self.h, self.count = np.zeros(0, _U), np.zeros(0, np.int64)


def _counts(docs: DataFrame, longest: int, wanted, totals: bool = False, held: int = HELD) -> DataFrame:
    """(k, h, n) of the phrases that ``wanted(phrases)`` gives as (k, which places), summed over all documents.

    With ``totals`` also the words of each language, with k = 0 and the hash of its name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per = [_Counter(held) for _ in range(longest + 1)]

        def out() -> Iterator[pa.RecordBatch]:
            for k, counter in enumerate(per):
                for h, n in counter.rows():
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), k, np.int32)), pa.array(h.view(np.int64)), pa.array(n)], names=["k", "h", "n"])

        for batch in batches:
            for part in pieces(batch):
                p = Phrases(part.column(0), part.column(1))
                if totals:
                    per[0].add(p.of)
                for k, places in wanted(p):
                    per[k].add(p.hashes(k)[places])
                if any([c.full() for c in per]):
                    yield from out()
        yield from out()

    # dealt by hash at once: the tasks have added up what they hold, a second partial sum would only fill memory
    return docs.mapInArrow(run, "k int, h long, n long").repartition("h").groupBy("k", "h").agg(F.sum("n").alias("n"))


def _missing(frequent: DataFrame, known: Bits) -> DataFrame:
    """Frequent phrases that the table of proposals lacks."""
    sent = frequent.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~sent.value.has(batch["h"].to_numpy().view(_U))))

    return frequent.mapInArrow(run, frequent.schema)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("text", F.col("lang").cast("string").alias("lang"))


def _sample(docs: DataFrame, share: float) -> DataFrame:
    """A share of the documents, by a hash of id and text."""
    return docs.where(F.pmod(F.xxhash64(F.lit(23), "doc_id", "text"), F.lit(1 << 20)) < int(share * (1 << 20)))


def frequent_hashes(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, sample: float = SAMPLE, lowered: float = LOWERED, most_bits: int = MOST_BITS) -> tuple[DataFrame, int]:
    """(k, h, n) of every phrase of at most ``longest`` words that occurs ``least`` times, and the number of passes over all documents.

    With k = 0: all words of a language.
    """
    context = docs.sparkSession.sparkContext
    texts, part = _texts(docs), _texts(_sample(docs, sample))
    low = max(2, int(least * sample * lowered))

    def every(p: Phrases) -> Iterator[tuple[int, np.ndarray]]:
        for k in range(1, min(longest, len(p.start) + 1)):
            yield k, p.together(k)

    # proposals of fewer than ``longest`` words are all that a border is made from
    proposed = checkpoint(_counts(part, longest, every).where(F.col("n") >= low))
    bits = bits_for(2 * proposed.count(), most_bits)
    known = Bits(bit_table(proposed, bits))
    found, passes, before = None, 0, None
    while True:
        sent, old = context.broadcast(known), context.broadcast(before) if before is not None else None

        def wanted(p: Phrases, sent=sent, old=old) -> Iterator[tuple[int, np.ndarray]]:
            done = dict(_reach(p, old.value, longest)) if old is not None else {}
            for k, near in _reach(p, sent.value, longest):
                yield k, near & ~done[k] if k in done else near

        got = checkpoint(_counts(texts, longest, wanted, totals=old is None).where((F.col("n") >= least) | (F.col("k") == 0)))
        passes += 1
        found = got if found is None else checkpoint(found.unionByName(got))
        failed = checkpoint(_missing(got.where(F.col("k").between(1, longest - 1)), known))
        if not failed.count():
            return found, passes
        before, known = known, Bits(known.words | bit_table(failed, bits))


def _once(docs: DataFrame, known: Bits, longest: int, rows, schema: str) -> DataFrame:
    """``rows(phrases, k, places)`` of the phrases of two words and more that ``known`` holds, about once per task and phrase."""
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = [np.zeros(0, _U)] * (longest + 1)  # sorted hashes that this task has given
        for batch in batches:
            for part in pieces(batch):
                p = Phrases(part.column(0), part.column(1))
                for k in range(2, min(longest, len(p.start)) + 1):
                    at = np.flatnonzero(p.together(k))
                    at = at[sent.value.has(p.hashes(k)[at])]
                    h, first = np.unique(p.hashes(k)[at], return_index=True)
                    if len(met[k]):
                        new = met[k][np.searchsorted(met[k], h).clip(max=len(met[k]) - 1)] != h
                        h, first = h[new], first[new]
                    if len(h):
                        met[k] = np.union1d(met[k], h) if len(met[k]) < HELD else h
                        yield rows(p, k, at[first])

    return _texts(docs).mapInArrow(run, schema)


def _parts(p: Phrases, k: int, at: np.ndarray) -> pa.RecordBatch:
    columns = [np.full(len(at), k, np.int32), *(x.view(np.int64) for x in (p.hashes(k)[at], p.hashes(k - 1)[at], p.hashes(k - 1)[at + 1], p.of[at]))]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["k", "h", "head", "tail", "g"])


def _names(p: Phrases, k: int, at: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(p.hashes(k)[at].view(np.int64)), pa.array([p.langs[i] for i in p.lang[p.owner[at]].tolist()], pa.string()), pa.array([p.text(i, k) for i in at.tolist()], pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["h", "lang", "phrase"])


def _made_of(docs: DataFrame, phrases: DataFrame, longest: int, sample: float, most_bits: int) -> DataFrame:
    """(k, h, n, head, tail, g) of the phrases (k, h, n): the sample is asked first, all documents for the phrases it lacks.

    A frequent phrase stands in nearly every task's documents, and every task would give it.
    """
    out = None
    for part in (_sample(docs, sample), docs):
        got = _once(part, _bits_of(phrases, most_bits), longest, _parts, "k int, h long, head long, tail long, g long")
        got = got.repartition("h").groupBy("k", "h").agg(*(F.min(c).alias(c) for c in ("head", "tail", "g")))
        got = checkpoint(got.join(phrases, ["k", "h"]))
        out = got if out is None else out.unionByName(got)
        phrases = checkpoint(phrases.join(got, ["k", "h"], "left_anti"))
        if phrases.isEmpty():
            break
    return checkpoint(out)


def _bits_of(hashes: DataFrame, most_bits: int) -> Bits:
    return Bits(bit_table(hashes, bits_for(hashes.count(), most_bits)))


def collocations(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, contained: int = CONTAINED, most_bits: int = MOST_BITS, **how
) -> DataFrame:
    """The best ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Words are runs of characters other than space and tab inside pieces cut at ``.,;:!?`` and line breaks, A-Z in lower
    case. A null lang is ``und``, a null text has no words. A phrase never reaches beyond its text. Texts and
    words of any length are read whole; ties of score and a go by the bytes of the phrase. Repeated rows count each time; an
    empty table, or one without frequent phrases, gives no rows; other columns are ignored. Numbers
    may be as large as longs: products and sums of them are decimals.
    """
    found, _ = frequent_hashes(docs, least, longest, most_bits=most_bits, **how)
    phrases = checkpoint(found.where("k > 1").select("k", "h", "n"))
    made = _made_of(docs, phrases, longest, how.get("sample", SAMPLE), most_bits)

    wide = "decimal(20,0)"
    none = F.array().cast("array<long>")
    shorter = found.where("k = 1").select("h", "n", none.alias("heads"), none.alias("tails"))
    scored = []
    for k in range(2, longest + 1):
        # counts of all heads and tails, those of one word first
        level = made.where(F.col("k") == k).drop("k")
        level = level.join(shorter.select(F.col("h").alias("head"), F.concat("heads", F.array("n")).alias("heads")), "head")
        level = checkpoint(level.join(shorter.select(F.col("h").alias("tail"), F.concat("tails", F.array("n")).alias("tails")), "tail"))
        shorter = level.select("h", "n", "heads", "tails")
        cuts = ", ".join(
            f"named_struct('score', cast((cast(n as {wide}) * {SCALE}) div (cast(heads[{m - 1}] as {wide}) + cast(tails[{k - m - 1}] as {wide})) as long), "
            f"'cut', {m}, 'l', heads[{m - 1}], 'r', tails[{k - m - 1}])" for m in range(1, k)
        )
        level = level.withColumn("s", F.expr(f"array_min(array({cuts}))"))
        if k < longest:  # the longer phrase of the largest count is longer by one word
            longer = made.where(F.col("k") == k + 1)
            longer = longer.select(F.col("head").alias("h"), "n").unionByName(longer.select(F.col("tail").alias("h"), "n")).groupBy("h").agg(F.max("n").alias("longer"))
            level = level.join(longer, "h", "left").where(f"longer is null or 100 * cast(longer as {wide}) < {contained} * cast(n as {wide})")
        scored.append(level.select("g", "h", F.col("n").alias("a"), "s.l", "s.r", "s.score"))
    rows = scored[0]
    for level in scored[1:]:
        rows = rows.unionByName(level)

    # ties at the border stay until the texts are known; the best of each bucket first, so that no task ranks a whole language
    order = [F.desc("score"), F.desc("a")]
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(BUCKETS)))
    for by in (["g", "bucket"], ["g"]):
        rows = rows.withColumn("rank", F.rank().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top).drop("rank")
    best = checkpoint(rows.drop("bucket"))
    names = _once(docs, _bits_of(best.select("h"), most_bits), longest, _names, "h long, lang string, phrase string").dropDuplicates(["h"])
    best = best.join(names, "h").withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order, "phrase")).cast("long")).where(F.col("rank") <= top)
    total = found.where("k = 0").select(F.col("h").alias("g"), F.col("n"))
    return best.join(total, "g").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\n\\x0b\\f\\r]')) AS piece
  FROM documents WHERE text IS NOT NULL),
words AS MATERIALIZED (SELECT lang, w FROM (SELECT lang, regexp_extract_all(piece, '[^ \\t]+') AS w FROM pieces) WHERE len(w) > 0),
phrases AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase
  FROM words, (SELECT unnest(range(1, {LONGEST + 1})) AS k) WHERE len(w) >= k),
counts AS MATERIALIZED (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM phrases GROUP BY lang, k, phrase),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang),
candidates AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE k >= 2 AND f >= {LEAST}),
inner_ AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, array_to_string(w[s : s + m - 1], ' ') AS phrase
    FROM candidates, (SELECT unnest(range(2, {LONGEST})) AS m), (SELECT unnest(range(1, {LONGEST})) AS s) WHERE m < k AND s + m - 1 <= k)
  GROUP BY lang, phrase),
kept AS (
  SELECT c.* FROM candidates c LEFT JOIN inner_ i USING (lang, phrase) WHERE i.longer IS NULL OR 100 * i.longer < {CONTAINED} * c.a),
cuts AS (
  SELECT c.lang, c.phrase, c.a, cut, l.f AS l, r.f AS r, {SCALE}::HUGEINT * c.a // (l.f + r.f) AS score
  FROM kept c, (SELECT unnest(range(1, {LONGEST})) AS cut), counts l, counts r
  WHERE cut < c.k AND l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : cut], ' ') AND r.lang = c.lang AND r.phrase = array_to_string(c.w[cut + 1 : c.k], ' ')),
scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM scored)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM ranked JOIN total USING (lang) WHERE rank <= {TOP}
"""
