"""Mixing sources to target weights.

Each source's documents, in a fixed order, are one stream of words that is packed into blocks of `block_words` words
(the last block of a source may be shorter). Output shards of `shard_slots` slots draw how many slots each source gets.
The draws are multinomial with the totals over all shards pinned: a range of shards is halved again and again, and each
half's counts are drawn (multivariate hypergeometric, seeded by the range), so a shard finds its counts and the numbers
of its slots in each source in log2(shards) steps, without a pass over the other shards. Slot j of a source stands for
block perm(j mod blocks) of pass j div blocks, where perm is a pseudorandom permutation (a keyed Feistel network with
cycle walking) of that source's block numbers. So a pass takes each block once before any is taken again. The last slot
of a source takes only the words missing to its target.

Targets: sources by code point, null last, weigh `weights` in turn and share `share` of all words; a target stops at
`repeat` times its source's words, and the excess goes to the others by weight until none is above.

Defined cases: a null or empty text has no words and is taken 0 times; a null source is a source of its own; equal ids
are ordered by a hash of the text, and rows equal in id, source and text are interchangeable; null ids come first.
Empty tables give empty results. Extra columns are ignored, whatever their names. What is collected to the driver is one
row per source (at most MAX_SOURCES), never rows of documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.llm.common import WORD_CLASS, written

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
REPEAT = 2.0
BLOCK_WORDS = 512
SHARD_SLOTS = 1024
SEED = 42
#: The plan of the sources is collected and broadcast: more sources are refused, not cut.
MAX_SOURCES = 20_000


def word_count(text_col: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD_CLASS)), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share: float = SHARE, repeat: float = REPEAT) -> list[float]:
    """Target words of each source, for (source, words) already in order: filling up to the caps by weight."""
    weigh = [float(weights[i % len(weights)]) for i in range(len(sizes))]
    caps = [repeat * n for _, n in sizes]
    left, open_, got = share * sum(n for _, n in sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        total = sum(weigh[i] for i in open_)
        over = {i for i in open_ if left * weigh[i] / total >= caps[i]}
        if not over:
            for i in open_:
                got[i] = left * weigh[i] / total
            break
        for i in over:
            got[i] = caps[i]
        left -= sum(caps[i] for i in over)
        open_ -= over
    return got


def _mix(x: int) -> int:
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
    return x ^ (x >> 31)


def permuted(slots: np.ndarray, n: int, key: int) -> np.ndarray:
    """The images of `slots` under the pseudorandom permutation of 0..n-1 with that key."""
    out = np.asarray(slots, dtype=np.uint64).copy()
    if n <= 1:
        return out.astype(np.int64)
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> shift, x & mask
        for r in range(6):
            f = right * np.uint64(0x9E3779B97F4A7C15) + np.uint64(_mix(key * 8 + r))
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f >> np.uint64(32)) & mask)
        out[todo] = left << shift | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def slot_of(block: int, n: int, key: int) -> int:
    """The inverse of permuted() for one block."""
    if n <= 1:
        return block
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    mask, x = (1 << half) - 1, block
    while True:
        left, right = x >> half, x & mask
        for r in reversed(range(6)):
            f = (left * 0x9E3779B97F4A7C15 + _mix(key * 8 + r)) & 0xFFFFFFFFFFFFFFFF
            f = ((f ^ (f >> 29)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
            left, right = right ^ ((f >> 32) & mask), left
        x = left << half | right
        if x < n:
            return x


def slots_needed(target: float, size: int, block_words: int, key: int) -> tuple[int, int]:
    """How many slots reach the target, and the words that the last of them takes."""
    want = round(target)
    if want <= 0 or size <= 0:
        return 0, 0
    blocks = -(-size // block_words)
    full, rest = divmod(want, size)
    if not rest:
        last = int(permuted(np.array([blocks - 1]), blocks, key)[0])
        return full * blocks, block_words if last < blocks - 1 else size - (blocks - 1) * block_words
    tail, at = size - (blocks - 1) * block_words, slot_of(blocks - 1, blocks, key)
    if rest <= at * block_words:
        k = -(-rest // block_words)
        last = rest - (k - 1) * block_words
    elif rest <= at * block_words + tail:
        k, last = at + 1, rest - at * block_words
    else:
        k = 1 + -(-(rest - tail) // block_words)
        last = rest - tail - (k - 2) * block_words
    return full * blocks + k, last


@lru_cache(maxsize=4096)
def _first_half(counts: tuple[int, ...], need: int, lo: int, hi: int, seed: int) -> tuple[int, ...]:
    """Of the slots of shards lo..hi, by source, those of the first half: `need` in all, each source given what is left."""
    draw, rest, out = np.random.Generator(np.random.Philox(key=[seed, lo << 32 ^ hi])), sum(counts), []
    for c in counts:
        rest -= c
        out.append(_hyper(draw, c, rest, need) if need > 0 else 0)
        need -= out[-1]
    return tuple(out)


def _shard_counts(totals: np.ndarray, shards: int, shard: int, slots: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of each source in this shard, and in all shards before it."""
    lo, hi, counts, before = 0, shards, totals.copy(), np.zeros_like(totals)
    total = int(totals.sum())
    while hi - lo > 1:
        mid = (lo + hi) // 2
        need = min(mid * slots, total) - min(lo * slots, total)
        left = np.array(_first_half(tuple(counts.tolist()), need, lo, hi, seed), np.int64)
        if shard < mid:
            hi, counts = mid, left
        else:
            lo, counts, before = mid, counts - left, before + left
    return counts, before


def _hyper(draw: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """A hypergeometric draw by inversion, the same way at every size.

    The probabilities of neighbouring values have a simple ratio. They are summed over the values within 12 standard
    deviations of the mean; all others together have less than 1e-20, below the precision of a double.
    """
    least, most = max(0, sample - bad), min(good, sample)
    if least == most:
        return least
    n = good + bad
    mean = sample * (good / n)
    width = 12 * math.sqrt(mean * (bad / n) * ((n - sample) / max(1, n - 1))) + 12
    lo, hi = max(least, math.floor(mean - width)), min(most, math.ceil(mean + width))
    x = np.arange(lo, hi, dtype=np.float64)
    steps = np.log(good - x) + np.log(sample - x) - np.log(x + 1) - np.log(bad - sample + x + 1)
    log_p = np.concatenate([[0.0], np.cumsum(steps)])
    sums = np.cumsum(np.exp(log_p - log_p.max()))
    return lo + min(int(np.searchsorted(sums, draw.random() * sums[-1], side="right")), hi - lo)


def keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """doc_id, source, size and a hash of the text: rows equal in these are interchangeable."""
    return docs.select(*_unit(id_col, text_col, source_col))


def _unit(id_col: str, text_col: str, source_col: str) -> list[Column]:
    return [F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text_col).alias("size"), F.xxhash64(text_col).alias("text_hash")]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, text_hash, start): where each document's words begin in its source's stream.

    Interchangeable rows are one unit of several copies, one after the other. The running sums have two levels, so that
    no window holds a whole source: over the buckets of a source, and over the units of a bucket. With the square root
    of the row count as the number of buckets, neither is long.
    """
    unit = ["doc_id", "source", "size", "text_hash"]
    units = written(keyed(docs, id_col, text_col, source_col).groupBy(*unit).agg(F.count("*").alias("copies")), "sizes")
    buckets = max(1, math.isqrt(units.count()))
    units = units.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_hash", "size"), F.lit(buckets))).withColumn("total", F.col("size") * F.col("copies"))
    spans = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = units.groupBy("source", "bucket").agg(F.sum("total").alias("words"))
    sums = sums.select("source", "bucket", F.coalesce(F.sum("words").over(spans), F.lit(0)).alias("base"))
    within = Window.partitionBy("source", "bucket").orderBy("doc_id", "text_hash", "size").rowsBetween(Window.unboundedPreceding, -1)
    units = units.withColumn("inner", F.coalesce(F.sum("total").over(within), F.lit(0)))
    sums = sums.withColumnsRenamed({"source": "s_source", "bucket": "s_bucket"})
    joined = units.join(sums.hint("merge"), units.source.eqNullSafe(sums.s_source) & (units.bucket == sums.s_bucket))
    joined = joined.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return joined.select(*unit, (F.col("base") + F.col("inner") + F.col("copy") * F.col("size")).alias("start"))


def plan_slots(sources: list[dict], spark, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """(shard, slot, source_no, block, words_cap): which block each slot of each output shard takes.

    words_cap is null but for the last slot of a source, which takes only so many words of its block.
    """
    totals = np.array([s["slots"] for s in sources], dtype=np.int64)
    blocks, lasts = [s["blocks"] for s in sources], [s["last_words"] for s in sources]
    shards = -(-int(totals.sum()) // shard_slots) if len(totals) else 0

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                counts, before = _shard_counts(totals, shards, shard, shard_slots, seed)
                parts = []
                for no in np.flatnonzero(counts):
                    j = np.arange(before[no], before[no] + counts[no])
                    block = permuted(j % blocks[no], blocks[no], _mix(seed * 1_000_003 + int(no)))
                    cap = np.where(j == totals[no] - 1, lasts[no], -1)
                    parts.append((np.full(len(j), no), block, cap))
                if not parts:
                    continue
                no, block, cap = (np.concatenate(x) for x in zip(*parts, strict=True))
                order = np.random.Generator(np.random.Philox(key=[seed + 1, shard])).permutation(len(no))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(no), shard)), pa.array(np.arange(len(no))), pa.array(no[order]), pa.array(block[order]), pa.array(cap[order], mask=cap[order] < 0)],
                    names=["shard", "slot", "source_no", "block", "words_cap"],
                )

    per = max(1, min(shards, spark.sparkContext.defaultParallelism * 4))
    return spark.range(0, shards, 1, per).mapInArrow(draw, "shard long, slot long, source_no long, block long, words_cap long")


def source_plan(packed: DataFrame, weights=WEIGHTS, share=SHARE, repeat=REPEAT, block_words=BLOCK_WORDS, seed=SEED) -> list[dict]:
    """One entry per source, in code point order with null last: the only rows that reach the driver."""
    sizes = [(r["source"], int(r["n"])) for r in packed.groupBy("source").agg(F.sum("size").alias("n")).limit(MAX_SOURCES + 1).collect()]
    if len(sizes) > MAX_SOURCES:
        raise ValueError(f"there are over {MAX_SOURCES} sources: their plan would not fit the driver and each task; map them to fewer first")
    sizes.sort(key=lambda x: (x[0] is None, x[0] or ""))
    out = []
    for no, ((source, size), target) in enumerate(zip(sizes, targets(sizes, weights, share, repeat), strict=True)):
        slots, last = slots_needed(target, size, block_words, _mix(seed * 1_000_003 + no))
        out.append({"source_no": no, "source": source, "source_size": size, "target": float(target), "blocks": -(-size // block_words), "slots": slots, "last_words": last})
    return out


SOURCES = "source_no long, source string, source_size long, target double, blocks long, slots long, last_words long"


def mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, share=SHARE, repeat=REPEAT,
        block_words=BLOCK_WORDS, shard_slots=SHARD_SLOTS, seed=SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents placed in their source's stream, with source_no, source_size and target; the slots; the sources)."""
    spark = docs.sparkSession
    packed = written(pack(docs, id_col, text_col, source_col), "packed")
    plan = source_plan(packed, weights, share, repeat, block_words, seed)
    known = spark.createDataFrame([tuple(s.values()) for s in plan], SOURCES)
    facts = known.select("source_no", F.col("source").alias("k_source"), "source_size", "target")
    # One row per source, as the driver already holds them all.
    placed = packed.join(F.broadcast(facts), packed.source.eqNullSafe(facts.k_source)).drop("k_source")
    return placed, plan_slots(plan, spark, shard_slots, seed), known


def pieces(placed: DataFrame, slots: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mixed output as spans: which words of which document each slot of each shard takes, in the slot's order by `at`.

    (shard, slot, at, source_no, doc_id, start, first_word, words); blocks are joined to slots by their index.
    """
    taken = _spans(placed, block_words).join(slots.hint("merge"), ["source_no", "block"])
    end = F.least("to", F.coalesce("words_cap", F.lit(block_words)))
    first = F.col("block") * block_words + F.col("from") - F.col("start")
    return taken.where(end > F.col("from")).select("shard", "slot", F.col("from").alias("at"), "source_no", "doc_id", "start", first.alias("first_word"), (end - F.col("from")).alias("words"))


def _spans(placed: DataFrame, block_words: int) -> DataFrame:
    """A row per document and block that share words; from and to are positions in the block."""
    some = placed.where("size > 0")
    first, last = F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words)
    some = some.withColumn("block", F.explode(F.sequence(first, last)))
    base = F.col("block") * block_words
    return some.withColumns({"from": F.greatest(F.col("start") - base, F.lit(0)), "to": F.least(F.col("start") + F.col("size") - base, F.lit(block_words))})


def mixed_texts(docs: DataFrame, placed: DataFrame, slots: DataFrame, block_words: int = BLOCK_WORDS, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """The mixture itself: (shard, slot, source_no, n_words, text), the words of each slot joined by one space.

    Each document's words are cut where blocks end, once for all slots that take them; a text travels in parts of at
    most a block.
    """
    unit = ["doc_id", "source", "size", "text_hash"]
    texts = docs.select(F.struct(*_unit(id_col, text_col, source_col)).alias("unit"), F.col(text_col).cast("binary").alias("body")).dropDuplicates(["unit"])
    starts = placed.where("size > 0").select(F.struct(*unit).alias("unit"), "source_no", "start")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for no, start, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words, at = body.split(), 0
                while at < len(words):
                    block, offset = divmod(start + at, block_words)
                    part = words[at : at + block_words - offset]
                    rows.append((no, block, offset, len(part), b" ".join(part).decode()))
                    at += len(part)
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [*[pa.int64()] * 4, pa.string()], strict=True)], names=["source_no", "block", "at", "n", "part"])

    parts = starts.join(texts, "unit").select("source_no", "start", "body").mapInArrow(cut, "source_no long, block long, at long, n long, part string")
    taken = parts.join(slots.hint("merge"), ["source_no", "block"]).withColumn("left", F.least("n", F.coalesce("words_cap", F.lit(block_words)) - F.col("at"))).where("left > 0")
    part = F.when(F.col("left") < F.col("n"), F.array_join(F.slice(F.split("part", " "), F.lit(1), F.col("left").cast("int")), " ")).otherwise(F.col("part"))
    grouped = taken.groupBy("shard", "slot", "source_no").agg(F.sum("left").alias("n_words"), F.sort_array(F.collect_list(F.struct("at", part.alias("part")))).alias("parts"))
    return grouped.select("shard", "slot", "source_no", "n_words", F.array_join(F.transform("parts", lambda x: x["part"]), " ").alias("text"))


def taken_words(placed: DataFrame, slots: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (the words of its pieces, repeats counted)."""
    words = pieces(placed, slots, block_words).groupBy("doc_id", "source_no", "start").agg(F.sum("words").alias("taken"))
    words = words.select(F.col("doc_id").alias("t_id"), F.col("source_no").alias("t_no"), F.col("start").alias("t_start"), "taken")
    joined = placed.where("size > 0").join(words.hint("merge"), placed.doc_id.eqNullSafe(words.t_id) & (placed.source_no == words.t_no) & (placed.start == words.t_start), "left")
    none = placed.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    cols = ["doc_id", "size", "source_size", "target"]
    return joined.select(*cols, F.coalesce("taken", F.lit(0)).cast("long").alias("taken")).unionByName(none.select(*cols, "taken"))
