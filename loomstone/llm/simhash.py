"""SimHash near-dedup with pigeonring filtering.

A fingerprint bit is 1 where over half the shingle hashes have it. Two fingerprints link at `max_distance` or fewer
differing bits. With the 64 bits as a ring of 16 segments of 4 bits, any two fingerprints within distance 3 have a chain
of segments, from some start, whose differences over each prefix of k segments sum to at most 3k/16. So the first five
segments of the chain are equal and the first ten differ in at most one bit: of the second five, the first ten or the
last ten bits are equal too. Each fingerprint is therefore filed under 32 keys of 30 bits (16 starts, 2 halves); pairs
that share a key pass the whole chain condition before their Hamming distance is counted. Within distance 7 the prefixes sum
to at most 7k/16: the first two segments are equal, and so are two of the next four, one of them among the third and the
fourth, which gives 80 keys of 16 bits (16 starts, 5 choices).

A key's fingerprints are compared within blocks and between pairs of blocks of at most BLOCK distinct fingerprints, so
no task gets a large group, and a task passes on a spanning forest of the links that it finds, never all pairs.
Components come from rounds of hooking each root to its smallest neighbour and halving paths, each round a written table.

Defined cases: null text counts as empty; a text with no words has fingerprint zero, which links like any other; fewer
words than a shingle form one shingle. Equal fingerprints are compared once, so rows that repeat an id or a text link
like any others. Null ids never become a component's id unless all its ids are null. Empty tables give empty results.
Extra columns are ignored, or kept by `keep_one`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm.common import hot_join, removed, whole_text, with_row_key, written

SHINGLE = 3
DISTANCE = 3
SEGMENTS, SEGMENT_BITS = 16, 4
#: For each distance the bits of the turned ring that make up its keys.
RING_MASKS = {3: (0x3FFFFFFF, 0xFFC00FFFFF), 7: (0xFFFF, 0xF0FFF, 0xF00FFF, 0xFF0FF, 0xF0F0FF)}
BLOCK = 512
_BITS_OF = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


def shingle_hashes(words: list[bytes], k: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of k words joined by one space; of all words where there are fewer."""
    from xxhash import xxh64_intdigest

    if not words:
        return np.zeros(0, np.uint64)
    text = memoryview(b" ".join(words))
    n = len(words)
    if n <= k:
        return np.array([xxh64_intdigest(text, seed)], dtype=np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: n - k + 1].tolist()
    return np.array([xxh64_intdigest(text[s:e], seed) for s, e in zip(starts, ends[k - 1 :].tolist(), strict=True)], dtype=np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The 64-bit majority of the hashes."""
    n = len(hashes)
    if not n:
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        part = hashes[at : at + 65536].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(shingle_hashes(t.lower().split(), shingle)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("body")).mapInArrow(each, "doc_id long, fp long")


def ring_masks(max_distance: int) -> tuple[int, ...]:
    """The masks of the smallest distance that covers the one asked for."""
    if max_distance > max(RING_MASKS):
        raise ValueError(f"the ring keys hold for a distance of at most {max(RING_MASKS)}")
    return RING_MASKS[min(d for d in RING_MASKS if d >= max_distance)]


def ring_keys(fps: DataFrame, masks: tuple[int, ...]) -> DataFrame:
    """(slot, key, fp) for the 16 starts and each mask."""
    slots = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS * len(masks) - 1))).alias("slot"))
    turn = F.expr(f"CAST(slot DIV {len(masks)} AS INT) * {SEGMENT_BITS}")
    turned = slots.withColumn("turn", turn).withColumn("ring", F.expr("CASE WHEN turn = 0 THEN fp ELSE shiftrightunsigned(fp, turn) | shiftleft(fp, 64 - turn) END"))
    key = F.expr(f"ring & element_at(array({', '.join(f'{m}L' for m in masks)}), slot % {len(masks)} + 1)")
    return turned.select("slot", key.alias("key"), "fp")


def popcount(x: np.ndarray) -> np.ndarray:
    return _BITS_OF[np.ascontiguousarray(x).view(np.uint8).reshape(*x.shape, 8)].sum(axis=-1, dtype=np.uint8)


def chain_passes(diff: np.ndarray, start: int, budget: int) -> np.ndarray:
    """Whether each difference keeps the proportional budget over every prefix of the chain from segment `start`."""
    total, fine = np.zeros(len(diff), np.uint8), np.ones(len(diff), bool)
    for k in range(1, SEGMENTS + 1):
        at = (start + k - 1) % SEGMENTS
        total += _BITS_OF[(diff >> np.uint64(at * SEGMENT_BITS)).astype(np.uint8) & np.uint8(15)]
        fine &= total * SEGMENTS <= budget * k
    return fine


class Forest:
    """Union by the smaller label over a task's few nodes."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = up.get(p, p)
            x = p
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def group_links(fps: np.ndarray, side: np.ndarray, start: int, budget: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within one block (all sides 0) or between two blocks (sides 0 and 1)."""
    forest, out = Forest(), []
    a = np.flatnonzero(side == 0)
    b = np.flatnonzero(side == 1)
    across = len(b) > 0
    for n, i in enumerate(a):
        others = b if across else a[n + 1 :]
        if not len(others):
            continue
        diff = fps[others] ^ fps[i]
        near = np.flatnonzero(chain_passes(diff, start, budget))
        near = near[popcount(diff[near]) <= budget] if len(near) else near
        for j in near:
            x, y = int(fps[i]), int(fps[others[j]])
            if x != y and forest.join(x, y):
                out.append((x, y))
    return out


def links(fps: DataFrame, max_distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """(a, b): links among distinct fingerprints, enough to connect all that are connected."""
    masks = ring_masks(max_distance)
    keyed, by_key = ring_keys(fps, masks), ["slot", "key"]
    sizes = written(keyed.groupBy(*by_key).agg(F.count("*").alias("n")).where("n > 1"), "ring-sizes")
    if max_distance > DISTANCE:  # keys of 80 slots: far more in a broadcast's memory than in the file that Spark judges by
        sizes = sizes.hint("merge")
    # A hot key's members meet its size by broadcast, so they become blocks where they are.
    members = hot_join(keyed, sizes, by_key, "n", fps.count() * len(masks) * SEGMENTS)
    blocks = F.ceil(F.col("n") / block)
    members = members.withColumn("blocks", blocks).withColumn("own", F.expr("pmod(xxhash64(fp), blocks)"))
    # Each member goes to its own block and to each pair of blocks with its own: sides 0 and 1 by the smaller number.
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = members.select("slot", "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).cast("int").alias("side"), "fp")
    by = ["slot", "key", "lo", "hi"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            kept = now if kept is None else pa.concat_tables([kept, now])
            yield from emit(kept, False)
            kept = kept.slice(tail(kept))
        if kept is not None and kept.num_rows:
            yield from emit(kept, True)

    def bounds(t: pa.Table) -> np.ndarray:
        cols = [t.column(c).to_numpy() for c in by]
        new = np.zeros(t.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        return np.flatnonzero(new)

    def tail(t: pa.Table) -> int:
        cuts = bounds(t)
        return int(cuts[-1]) if len(cuts) else 0

    def emit(t: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
        cuts = bounds(t)
        edges = [0, *cuts.tolist(), *([t.num_rows] if last else [])]
        slot, side = t.column("slot").to_numpy(), t.column("side").to_numpy()
        fps_ = t.column("fp").to_numpy().view(np.uint64)
        out: list[tuple[int, int]] = []
        for s, e in zip(edges, edges[1:], strict=False):
            if e - s > 1:
                out += group_links(fps_[s:e], side[s:e], int(slot[s]) // len(masks), max_distance)
        if out:
            ab = np.array(out, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], names=["a", "b"])

    # A number given is kept: small rows, but much work for each, would else meet in few tasks.
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = dealt.repartition(parts, *by).sortWithinPartitions(*by, "fp")
    return ordered.mapInArrow(compare, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the nodes of `edges` (a, b) with the smallest node that each reaches.

    Each round hooks every root to its smallest neighbouring root if that is smaller, halves the paths until all nodes
    point to roots, and contracts the edges; rounds end when no edge is left. All tables are written, none is collected;
    those of a round are removed once the next has read them. A root that most nodes have is a hot key of these joins:
    adaptive execution splits its partition, as each join ends in a write or in a partial aggregation.
    """
    spark = edges.sparkSession
    both = edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select("b", "a")).toDF("u", "v").distinct()
    left = written(both, "cc-edges")
    label = None
    while not left.isEmpty():
        hook = written(left.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("up")), "cc-hooks")
        still = False
        while not still:  # paths halve: node -> up -> up
            above = hook.select(F.col("node").alias("n2"), F.col("up").alias("next"))
            halved = written(hook.join(above, F.col("up") == F.col("n2")).select("node", F.col("next").alias("up"), (F.col("next") != F.col("up")).alias("moved")), "cc-halved")
            removed(hook)
            still, hook = halved.where("moved").isEmpty(), halved
        tops = hook.select(F.col("node").alias("n2"), "up")
        if label is None:
            before, label = None, written(hook.select("node", F.col("up").alias("root")), "cc-labels")
        else:
            before, label = label, written(label.join(tops, F.col("root") == F.col("n2"), "left").select("node", F.coalesce("up", "root").alias("root")), "cc-labels")
        moved = left.join(tops, F.col("u") == F.col("n2")).select(F.col("up").alias("u"), "v")
        moved = moved.join(tops, F.col("v") == F.col("n2")).select("u", F.col("up").alias("v"))
        moved = written(moved.where("u <> v").distinct(), "cc-edges")
        removed(left, hook, before)
        left = moved
    removed(left)
    return label if label is not None else spark.createDataFrame([], "node long, root long")


def near_components(docs: DataFrame, shingle: int = SHINGLE, max_distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id that links reach) for every row."""
    rows = written(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    known = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "distinct-fingerprints")
    tops = components(links(known.select("fp"), max_distance))
    named = known.join(tops, known.fp == tops.node, "left").withColumn("root", F.coalesce("root", "fp"))
    # The smallest id of a component: partial aggregation first, then a join on the root that may be hot.
    named = written(named.select("fp", "n", "first_id", "root"), "fingerprint-roots")
    firsts = written(named.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("members")), "component-ids")
    groups = hot_join(named.select("fp", "n", "root"), firsts, "root", "members", named.count()).select("fp", "n", "component_id")
    joined = hot_join(rows, written(groups, "fingerprint-components"), "fp", "n", rows.count())
    return joined.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# --- similarity of 0.8 over five-word shingles
#
# SimHash proposes pairs, the shingle sets decide each of them, and an exact way finds those that the bits don't bring
# near: at a Jaccard similarity of 0.8 two fingerprints differ in up to 16 bits, where the ring's keys are too short.
#
# 1. A set of n shingles has s * n of them in common with any partner, so a text stays only if that many of its shingles
#    are in some other text too. One shuffle of shortened hashes counts them; few texts are left.
# 2. Fingerprints of two-word shingles, which a changed word moves less than wider ones, are linked by pigeonring at up
#    to NEAR bits. Every link, and every text that has the fingerprint of another, is checked on the whole sets, star by
#    star. What passes is a link, and texts that these connect, a part, aren't compared with each other again.
# 3. Pairs of different parts, by a prefix filter: in whatever order all shingles are, the first n - ceil(s * n) + 1 of
#    one set and of its partner's have one in common. The order is by the number of texts that have the shingle, the
#    rarest first. Shingles that a single part has need no look.
# 4. Texts that such a shingle connects, directly or through others, are a family. Within a family's blocks, and between
#    pairs of its blocks, all sets of different parts are compared, and a task passes on a spanning forest of the links
#    that it finds. A family of over FAMILY texts is compared shingle by shingle instead: texts that share one, in
#    blocks again.

WIDE_SHINGLE = 5
SIMILARITY = 0.8
#: The words of a shingle and the differing bits of the fingerprints that propose pairs.
NEAR_SHINGLE, NEAR = 2, 7
#: Shingles of one bucket of the first count, and the bytes that each is shortened to there beyond the bucket's own bits.
#: Equal short hashes of different shingles only leave a text in that could have gone.
BUCKET_SHINGLES, SHORT = 4_000_000, 5
#: Texts and shingles of one block, and the texts of a family that is compared as a whole.
BLOCK_SHINGLES, FAMILY = 1_000_000, 16_384
_TINY = 1e-9


def least_common(n: Column, similarity: float) -> Column:
    """How many shingles a set of n has in common with any set of that similarity, at least."""
    return F.ceil(n * similarity - _TINY)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is written within hands Python batches of at most `rows` rows: whole texts and sets are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shared_counts(source: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, n, m): the distinct shingles of each text of `source` (doc_id, body), and how many of them others have.

    m may be too large by shingles whose short hashes are equal, never too small.
    """
    size = source.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    bits = max(4, int(size // 6 // BUCKET_SHINGLES).bit_length())
    buckets, short = 1 << bits, np.uint64(64 - bits - 8 * SHORT)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per bucket the hashes that this batch has, and the text (number in the batch) of each that only one text has."""
        for batch in batches:
            sets = [np.unique(shingle_hashes(t.lower().split(), shingle)) for t in batch.column(1).to_pylist()]
            sizes = np.array([len(x) for x in sets], np.int64)
            hashes, text = np.concatenate([np.zeros(0, np.uint64), *sets]), np.repeat(np.arange(len(sets)), sizes)
            order = np.argsort(hashes, kind="stable")
            hashes, text = hashes[order] >> short, text[order]
            first = np.r_[True, hashes[1:] != hashes[:-1]] if len(hashes) else np.zeros(0, bool)
            alone = first & np.r_[first[1:], True] if len(hashes) else first
            here = np.bincount(text[~alone], minlength=len(sets))
            ids = np.array(batch.column(0).to_pylist(), np.int64)
            hashes, text, alone = hashes[first], text[first], alone[first]
            cuts = np.searchsorted(hashes, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(8 * SHORT))
            rows: list[tuple] = [(int(hashes[0] >> np.uint64(8 * SHORT)) if len(hashes) else 0, ids.tobytes(), np.stack([sizes, here], 1).tobytes(), b"", b"")]
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                part = slice(cuts[b], cuts[b + 1])
                of = np.where(alone[part], text[part], -1).astype(np.int32)
                known, of = np.unique(of, return_inverse=True)
                packed = hashes[part].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SHORT].tobytes()
                rows.append((b, np.where(known < 0, -1, ids[known]).tobytes(), b"", packed, of.astype(np.uint16).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int32(), *[pa.binary()] * 4], strict=True)], names=names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def shared() -> Iterator[pa.RecordBatch]:
            ids, n, m = [], [], []
            parts = [h for h in held if h[2]]
            for own, counts, _, _ in (h for h in held if h[1]):
                table = np.frombuffer(counts, np.int64).reshape(-1, 2)
                ids.append(np.frombuffer(own, np.int64))
                n.append(table[:, 0])
                m.append(table[:, 1])
            if parts:
                sizes = [len(h[2]) // SHORT for h in parts]
                wide = np.zeros((sum(sizes), 8), np.uint8)
                wide[:, :SHORT] = np.frombuffer(b"".join(h[2] for h in parts), np.uint8).reshape(-1, SHORT)
                hashes = wide.view("<u8").ravel()
                order = np.argsort(hashes, kind="stable")
                new = np.r_[True, hashes[order][1:] != hashes[order][:-1]]
                twice = np.empty(len(hashes), bool)
                twice[order] = ~(new & np.r_[new[1:], True])
                at = 0
                for (own, _, _, of), size in zip(parts, sizes, strict=True):
                    found = np.bincount(np.frombuffer(of, np.uint16)[twice[at : at + size]], minlength=len(own) // 8)
                    at += size
                    own = np.frombuffer(own, np.int64)
                    some = (own >= 0) & (found > 0)
                    ids.append(own[some])
                    n.append(np.zeros(some.sum(), np.int64))
                    m.append(found[some])
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in (ids, n, m)], names=["doc_id", "n", "m"])

        for batch in batches:
            for bucket, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now:
                    yield from shared()
                    now, held = bucket, []
                held.append(row)
        yield from shared()

    names = ["bucket", "ids", "counts", "hashes", "texts"]
    sent = source.mapInArrow(send, "bucket int, ids binary, counts binary, hashes binary, texts binary")
    dealt = sent.repartitionById(buckets, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(count, "doc_id long, n long, m long").groupBy("doc_id").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def block_links(ids: np.ndarray, sets: list[np.ndarray], side: np.ndarray, part: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the links within one block (all sides 0) or between two blocks (sides 0 and 1).

    Texts of the same part are connected already.
    """
    part, out = part.copy(), []
    sizes = np.array([len(x) for x in sets], np.int64)
    words, place = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    across = bool(side.any())
    mark = np.zeros(len(words), np.uint8)
    for i in np.flatnonzero(side == 0):
        others = np.flatnonzero((side == 1) if across else np.arange(len(ids)) > i)
        fine = np.minimum(sizes[others], sizes[i]) >= np.maximum(sizes[others], sizes[i]) * similarity - _TINY
        others = others[fine & (part[others] != part[i])]
        if not len(others):
            continue
        own = place[ends[i] - sizes[i] : ends[i]]
        mark[own] = 1
        if len(others) * 2 < len(ids):
            both = np.array([int(mark[place[ends[j] - sizes[j] : ends[j]]].sum(dtype=np.int64)) for j in others])
        else:
            both = np.add.reduceat(mark[place], ends - sizes, dtype=np.int64)[others]
        mark[own] = 0
        for j in others[both >= similarity * (sizes[others] + sizes[i] - both) - _TINY]:
            if part[i] != part[j]:
                part[part == part[j]] = part[i]
                out.append((int(ids[i]), int(ids[j])))
    return out


def near_pairs(texts: DataFrame, max_distance: int = NEAR) -> DataFrame:
    """(a, b, n): pairs of `texts` (doc_id, n, fp) that pigeonring links, or whose fingerprints are equal; n is b's.

    Of equal fingerprints the smallest id meets the others and stands for them in the links.
    """
    first = texts.groupBy("fp").agg(F.min("doc_id").alias("a"), F.min_by("n", "doc_id").alias("first_n"), F.count("*").alias("members"))
    first = written(first, "near-fingerprints")
    same = hot_join(texts, first, "fp", "members", texts.count()).where("doc_id <> a").select("a", F.col("doc_id").alias("b"), "n")
    linked = links(first.select("fp"), max_distance).select(F.least("a", "b").alias("fp"), F.greatest("a", "b").alias("other")).distinct()
    others = first.select(F.col("fp").alias("other"), F.col("a").alias("b"), F.col("first_n").alias("n"))
    pairs = written(same.unionByName(linked.join(first.select("fp", "a"), "fp").join(others, "other").select("a", "b", "n")), "near-pairs")
    removed(first)
    return pairs


def similar_links(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = WIDE_SHINGLE, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(a, b): pairs of ids whose shingle sets have the Jaccard similarity asked for, enough to connect all that such
    pairs connect. Ids tell the rows apart and aren't negative; empty texts have no links."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("body"))
    with small_batches(spark, 2048):
        counts = shared_counts(source, shingle).where((F.col("n") > 0) & (F.col("m") >= least_common(F.col("n"), similarity)))
        some = written(counts.select("doc_id", "n"), "similar-some")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [t.lower().split() for t in batch.column(1).to_pylist()]
            sets = pa.array([np.unique(shingle_hashes(w, shingle)).view(np.int64) for w in words], pa.list_(pa.int64()))
            fps = pa.array(np.array([fingerprint(shingle_hashes(w, NEAR_SHINGLE)) for w in words], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), sets, fps], names=["doc_id", "shingles", "fp"])

    with small_batches(spark, 512):
        sets = written(source.join(some.select("doc_id"), "doc_id").mapInArrow(spread, "doc_id long, shingles array<long>, fp long"), "similar-sets")
    close = checked_near(sets, similarity, block)
    rest = other_links(some, sets, components(close), similarity, block)
    links = written(close.unionByName(rest), "similar-links")
    removed(some, sets, close, rest)
    return links


def checked_near(sets: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """(a, b): the near pairs of `sets` (doc_id, shingles, fp) that have the similarity."""
    pairs = near_pairs(sets.select("doc_id", F.size("shingles").cast("long").alias("n"), "fp"))
    sizes = pairs.groupBy("a").agg(F.count("*").alias("members"), F.sum("n").alias("weight"))
    stars = written(sizes.withColumn("blocks", in_blocks(block)), "near-stars")
    star = [F.lit(2).alias("by"), F.col("a").alias("no"), "lo", F.col("lo").alias("hi")]
    # The texts of a star are dealt to its blocks, and its first text to each of them.
    leaves = hot_join(pairs, stars, "a", "members", pairs.count()).withColumn("lo", F.expr("pmod(xxhash64(b), blocks)"))
    heads = stars.withColumn("lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = leaves.select(*star, F.lit(1).alias("side"), F.col("b").alias("part"), F.col("b").alias("doc_id"))
    dealt = dealt.unionByName(heads.select(*star, F.lit(0).alias("side"), F.col("a").alias("part"), F.col("a").alias("doc_id")))
    with small_batches(sets.sparkSession, 512):
        links = written(compared(dealt, sets, similarity), "near-links")
    removed(pairs, stars)
    return links


def other_links(some: DataFrame, sets: DataFrame, parts: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """(a, b): links between the texts of `some` (doc_id, n) that have no common root in `parts` (node, root), enough to
    connect all that are similar."""
    some = written(some.join(parts.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left").select("doc_id", "n", F.coalesce("root", "doc_id").alias("part")), "similar-parts")
    rows = sets.select("doc_id", F.explode("shingles").alias("key"))
    known = written(rows.groupBy("key").agg(F.count("*").alias("df")).where("df > 1"), "similar-known")
    # A text's shingles that are left, the rarest first; its others come before them all and find nobody.
    ordered = hot_join(rows, known, "key", "df", rows.count()).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("order"))
    prefix = F.col("n") - least_common(F.col("n"), similarity) + 1 - (F.col("n") - F.size("order"))
    keyed = ordered.join(some, "doc_id").withColumn("prefix", prefix.cast("int")).where("prefix > 0")
    keyed = written(keyed.select("doc_id", "n", "part", F.explode(F.slice("order", F.lit(1), F.col("prefix"))).alias("one")).select("doc_id", "n", "part", F.col("one.key").alias("key")), "similar-keys")
    groups = keyed.groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("members"), F.sum("n").alias("weight"), (F.min("part") < F.max("part")).alias("open"))
    groups = written(groups.where("open").drop("open"), "similar-groups")
    members = written(hot_join(keyed, groups, "key", "members", keyed.count()), "similar-members")
    families = components(members.where("doc_id <> least").select(F.col("least").alias("a"), F.col("doc_id").alias("b")).distinct())
    of = written(families.withColumnRenamed("node", "doc_id").join(some, "doc_id"), "similar-families")
    sizes = of.groupBy("root").agg(F.count("*").alias("members"), F.sum("n").alias("weight"))
    units = written(hot_join(of, written(sizes, "similar-sizes"), "root", "members", of.count()), "similar-units")
    whole = units.where(F.col("members") <= FAMILY).select(F.struct(F.lit(0).alias("by"), F.col("root").alias("no")).alias("unit"), "part", "doc_id", "members", "weight")
    large = units.where(F.col("members") > FAMILY).select("doc_id")
    alone = members.join(large, "doc_id", "left_semi").select(F.struct(F.lit(1).alias("by"), F.col("key").alias("no")).alias("unit"), "part", "doc_id", "members", "weight")
    dealt = whole.unionByName(alone).withColumn("blocks", in_blocks(block)).withColumn("own", F.expr("pmod(xxhash64(doc_id), blocks)"))
    # Each member goes to its own block and to each pair of blocks with its own: sides 0 and 1 by the smaller number.
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("unit.by", "unit.no", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).cast("int").alias("side"), "part", "doc_id")
    with small_batches(sets.sparkSession, 512):
        links = written(compared(dealt, sets, similarity), "other-links")
    removed(some, known, keyed, groups, members, families, of, units)
    return links


def in_blocks(block: int) -> Column:
    """The number of blocks for `members` texts of `weight` shingles."""
    return F.greatest(F.ceil(F.col("members") / block), F.ceil(F.col("weight") / BLOCK_SHINGLES))


def compared(dealt: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b), the smaller id first: links within each block (by, no, lo, hi) of `dealt`, which has side, part and doc_id
    too, by the shingles that `sets` has."""
    parts = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["by", "no", "lo", "hi"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups() -> Iterator[list[tuple]]:
            now, held = None, []
            for batch in batches:
                shingles = batch.column(7)
                flat, ends = shingles.flatten().to_numpy().view(np.uint64), shingles.value_lengths().to_numpy().cumsum()
                for k, (*key, side, part, doc) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:7]), strict=True)):
                    if key != now:
                        yield held
                        now, held = key, []
                    held.append((doc, side, part, flat[ends[k - 1] if k else 0 : ends[k]]))
            yield held

        for held in groups():
            if len(held) > 1:
                ids, side, part, sets_ = zip(*held, strict=True)
                if found := block_links(np.array(ids, np.int64), list(sets_), np.array(side), np.array(part, np.int64), similarity):
                    ab = np.array(found, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(ab.min(axis=1)), pa.array(ab.max(axis=1))], names=["a", "b"])

    with_sets = dealt.join(sets.select("doc_id", "shingles"), "doc_id").select(*order, "side", "part", "doc_id", "shingles")
    ordered = with_sets.repartition(parts, *order).sortWithinPartitions(*order, "doc_id")
    return ordered.mapInArrow(compare, "a long, b long").distinct()


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = WIDE_SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, without those whose component has a row of a smaller id.

    Rows are told apart by keys of their own, so repeated and null ids are rows like others: a null id is larger than
    any other, and of rows that tie in id one stays.
    """
    keyed, row = with_row_key(docs, "near-rows")
    links = similar_links(keyed, similarity, shingle, row, text_col)
    roots = components(links)
    members = written(roots.join(keyed.select(F.col(row).alias("node"), F.col(id_col).cast("long").alias("doc_id")), "node"), "near-members")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "node"))
    stay = members.groupBy("root").agg(first.alias("first")).select(F.col("first.node").alias("node"))
    gone = written(members.select("node").join(stay, "node", "left_anti").withColumnRenamed("node", row), "near-copies")
    removed(roots, members)
    return keyed.join(gone, row, "left_anti").drop(row)
