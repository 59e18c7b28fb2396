"""Benchmark decontamination: size-partitioned MinHash containment search, then exact shingle containment.

Items are partitioned by their number n of distinct shingles (powers of two). An item's sketch is its k smallest shingle
hashes (bottom-k MinHash), a uniform sample of its shingles, so the share of the sketch that a document holds estimates
how much of the item it contains. k is set for each partition so that the estimate has a bound which no contained item
can fail: an item that may miss d of its n shingles is held in at least k - d of its sketch, and k is SPARE more than
the most that an item of the partition may miss. Items whose estimate (k - d) / k is met are verified by counting their
distinct shingles in the document, as words, not hashes. So unlike banded MinHash, whose recall falls with the ratio of
the document's size to the item's, the search misses nothing. Long documents have no sketch of their own: a bounded one
could not hold a short item's shingles.

Words are runs of bytes other than ASCII white space and punctuation, with A-Z lower-cased. An item of fewer than
`shingle` words is one shingle of all its words; an item without words is in no document.

The items of one block (at most `block_items` items and BLOCK_BYTES bytes, or one longer item) travel to the executors;
more items make more blocks, each searched against all documents. The documents aren't shuffled.

Defined cases: null texts count as empty; rows with equal ids are judged each on its own; null ids are kept as null.
Empty tables give empty results (no items: nothing is contaminated). `drop_contaminated` returns all columns of its
input, whatever their names; the search ignores extra columns.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import whole_text

SHINGLE = 5
CONTAINMENT = 0.8
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 32_000_000
#: Sketched shingles that a containing document is sure to hold, where the item has so many.
SPARE = 8
_PUNCT = bytes(i for i in range(33, 127) if not chr(i).isalnum())
_PLAIN = bytes.maketrans(_PUNCT, b" " * len(_PUNCT))
_BASE = np.uint64(0xD6E8FEB86659FD93)
_BITMAP = 20


def plain_words(text: bytes) -> list[bytes]:
    return text.lower().translate(_PLAIN).split()


def shingles(words: list[bytes], k: int) -> set[bytes]:
    return {b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)}


def item_shingles(words: list[bytes], k: int) -> set[bytes]:
    return shingles(words, min(k, len(words))) if words else set()


def word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def run_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * _BASE + hashes[i : i + n]
    return (out ^ (out >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25)


def may_miss(n: int, containment: float) -> int:
    """The most of n shingles that a document may lack which contains the item."""
    return n - math.ceil(containment * n - 1e-9)


def sketch_size(n: int, containment: float) -> int:
    """Of the partition of sizes that n is in: SPARE more than the most shingles that one of its items may miss."""
    return min(n, may_miss((1 << n.bit_length()) - 1, containment) + SPARE)


class Sketches:
    """The sketches of one block of items, by shingle length."""

    def __init__(self, items: list[tuple[int | None, bytes]], shingle: int, containment: float):
        self.need, self.of_item = containment, []
        found: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for item_id, text in items:
            words = plain_words(text)
            own = item_shingles(words, shingle)
            if not own:
                continue
            k = min(shingle, len(words))
            hashes = np.unique(np.concatenate([run_hashes(word_hashes(s.split(b" ")), k) for s in own]))
            sketch = hashes[: sketch_size(len(own), containment)].tolist()
            for h in sketch:
                found[k][h].append(len(self.of_item))
            self.of_item.append((item_id, len(sketch) - may_miss(len(own), containment), own))
        self.lookup = {k: dict(v) for k, v in found.items()}
        self.maps = {}
        for k, v in self.lookup.items():
            bits = np.zeros(1 << _BITMAP, bool)
            bits[np.fromiter(v, np.uint64, len(v)) >> np.uint64(64 - _BITMAP)] = True
            self.maps[k] = bits

    def search(self, text: bytes) -> list[tuple[int | None, int, int]]:
        """(item id, shingles of the item, how many of them the text holds) for each contained item."""
        words = plain_words(text)
        hashes, out = word_hashes(words), []
        for k, bits in self.maps.items():
            runs = run_hashes(hashes, k)
            maybe = runs[bits[runs >> np.uint64(64 - _BITMAP)]].tolist() if len(runs) else []
            lookup = self.lookup[k]
            hits = Counter(i for h in set(maybe) for i in lookup.get(h, ()))
            items = sorted(i for i, n in hits.items() if n >= self.of_item[i][1])
            if not items:
                continue
            held = shingles(words, k)
            for i in items:
                item_id, _, own = self.of_item[i]
                n = len(own & held)
                if n >= self.need * len(own) - 1e-9:
                    out.append((item_id, len(own), n))
        return out


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_items: int) -> Iterator[list[tuple[int | None, bytes]]]:
    """The items in blocks; the driver holds one block at a time."""
    block: list[tuple[int | None, bytes]] = []
    size = 0
    rows = benchmark.select(F.col(id_col).cast("long").alias("item_id"), whole_text(text_col).alias("body")).distinct()
    for row in rows.toLocalIterator():
        body = bytes(row["body"])
        if block and (len(block) == block_items or size + len(body) > BLOCK_BYTES):
            yield block
            block, size = [], 0
        block.append((row["item_id"], body))
        size += len(body)
    if block:
        yield block


def contaminated(
    docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, containment: float = CONTAINMENT, block_items: int = BLOCK_ITEMS,
    id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """A row per document and contained item: doc_id, item_id, n_item, n_found, containment."""
    spark, schema = docs.sparkSession, "doc_id long, item_id long, n_item long, n_found long, containment double"
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("body"))
    out = spark.createDataFrame([], schema)
    for block in item_blocks(benchmark, item_id_col, item_text_col, block_items):
        sent = spark.sparkContext.broadcast(block)

        def find(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            sketches = Sketches(sent.value, shingle, containment)
            for batch in batches:
                rows = [(d, *hit) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for hit in sketches.search(t)]
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
                share = [f / n for n, f in zip(cols[2], cols[3], strict=True)]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array(share, pa.float64())], names=["doc_id", "item_id", "n_item", "n_found", "containment"])

        out = out.unionByName(source.mapInArrow(find, schema))
    return out


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, containment: float = CONTAINMENT, block_items: int = BLOCK_ITEMS,
    text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """The rows that hold no item, with all their columns; one pass a block of items, no shuffle."""
    at = docs.columns.index(text_col)
    for block in item_blocks(benchmark, item_id_col, item_text_col, block_items):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def keep(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            sketches = Sketches(sent.value, shingle, containment)
            for batch in batches:
                clean = [t is None or not sketches.search(t.encode()) for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
