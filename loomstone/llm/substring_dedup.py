"""Substring dedup by recompression: removes words of long passages that a document with a smaller id has too.

Words become 64-bit names. A first round names each run of one word; each further round deals the symbols to a left and
a right side by their names and names every left-right pair, up to CAP words. A name depends on its content alone, so it
is the same wherever the content stands, in any document, without a shared dictionary. Within a window of words the
rounds can differ between two documents only at the window's ends, and how far is known from the window itself: the
leftmost symbol may pair with something outside only if it is of the right side, the rightmost only if of the left. What
remains, the core, has equal symbols in every document that holds the window. Each window is filed under the longest
symbol of its core (a window without a core under its own hash), so equal windows are filed under equal symbols.

1. One pass names the documents' windows: per document the distinct symbols under which its windows are filed.
2. Symbols of two or more different texts are found by partial aggregation and joined back; the documents that have
   some, one of each group of equal texts, are packed with them.
3. Only windows under shared symbols are hashed (128 bits); the smallest document of each hash is found the same way.
4. Windows with a smaller document mark words; the marked documents are cut. Equal texts follow without windows: all
   but the smallest lose every word.

Memory is bounded by pieces of PIECE words: as a window's core depends on the window alone, long texts are cut anywhere.

Defined cases: null text has no words; a document of fewer than `window` words loses none; equal ids are no smaller
document to each other; a null id counts as larger than all others. Windows are judged on the input. Empty tables give
empty results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import hot_join, removed, whole_text, written

WINDOW = 50
ROUNDS = 6
CAP = 24
PIECE = 1 << 17
LAST = (1 << 63) - 1
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the two bases and of their inverses, for rolling hashes of one piece."""

    def __init__(self, n: int):
        def run(b: int) -> np.ndarray:
            steps = np.full(n, b, np.uint64)
            steps[0] = 1
            return np.multiply.accumulate(steps)

        self.up = [run(b) for b in _BASES]
        self.down = [run(pow(b, -1, 1 << 64)) for b in _BASES]


def rolling(h: np.ndarray, window: int, powers: Powers, which: int) -> np.ndarray:
    """A hash of the `window` words from each start."""
    n = len(h)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(h * powers.up[which][:n], out=sums[1:])
    return _stir((sums[window:] - sums[:-window]) * powers.down[which][: n - window + 1])


def window_symbols(h: np.ndarray, starts: np.ndarray, own: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS) -> np.ndarray:
    """The symbol that each window is filed under; `own` are the windows' hashes for those without a core."""
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(h)))
    name = np.where(length > 1, _stir(h[first] + length.astype(np.uint64) * _M2), h[first])
    run = np.cumsum(new) - 1
    # A run at an end of the window may go on outside: the core lies between the end runs.
    lo, hi = run[starts] + 1, run[starts + window - 1]
    hi = np.maximum(hi, lo)
    for t in range(rounds):
        left = (_stir(name + np.uint64((t + 1) * int(_M1) & LAST)) & np.uint64(1)).astype(bool)
        pair = left[:-1] & ~left[1:] & (length[:-1] + length[1:] <= CAP)
        at = np.flatnonzero(pair)
        keep = np.ones(len(name), bool)
        keep[at + 1] = False
        name, length = name.copy(), length.copy()
        name[at] = _stir(name[at] * _M1 + _stir(name[at + 1]) + np.uint64(t))
        length[at] += length[at + 1]
        rank = np.zeros(len(keep) + 1, np.int64)
        np.cumsum(keep, out=rank[1:])
        edge = np.append(left, True)
        lo = lo + ~edge[lo]
        hi = np.maximum(hi - edge[hi - 1], lo)
        lo, hi = rank[lo], rank[hi]
        name, length = name[keep], length[keep]
    value = np.minimum(length, 255).astype(np.uint64) << np.uint64(56) | name >> np.uint64(8)
    out = np.uint64(window) << np.uint64(56) | own >> np.uint64(8)
    width, best, k = hi - lo, value, 0
    while (1 << k) <= window:  # the largest value in [lo, hi) from two stretches of 2**k symbols
        sel = np.flatnonzero((width >= (1 << k)) & (width < (2 << k)))
        if len(sel):
            out[sel] = np.maximum(best[lo[sel]], best[hi[sel] - (1 << k)])
        if len(best) <= (1 << k):
            break
        best = np.maximum(best[: -(1 << k)], best[1 << k :])
        k += 1
    return out


def word_names(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def filed(texts: list[np.ndarray], powers: Powers, window: int = WINDOW) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(text number, first start, symbols, hash 1, hash 2) for pieces of the texts, given as word names."""
    held: list[tuple[int, int, np.ndarray]] = []
    size = 0

    def run() -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        h = np.concatenate([x for _, _, x in held])
        one, two = rolling(h, window, powers, 0), rolling(h, window, powers, 1)
        base = np.cumsum([0, *(len(x) for _, _, x in held)])
        starts = np.concatenate([np.arange(b, b + len(x) - window + 1) for b, (_, _, x) in zip(base, held, strict=False)])
        symbols, at = window_symbols(h, starts, one[starts], window), 0
        for b, (no, first, x) in zip(base, held, strict=False):
            n = len(x) - window + 1
            yield no, first, symbols[at : at + n], one[b : b + n], two[b : b + n]
            at += n

    for no, h in enumerate(texts):
        for first in range(0, len(h) - window + 1, PIECE - window + 1):
            piece = h[first : first + PIECE]
            if size + len(piece) > PIECE:
                yield from run()
                held, size = [], 0
            held.append((no, first, piece))
            size += len(piece)
    if held:
        yield from run()


def _ids(col: pa.Array) -> pa.Array:
    return col.fill_null(LAST)


def _sequence(words: list[bytes]) -> tuple[int, int, bytes]:
    from xxhash import xxh3_128_digest

    joined = b" ".join(words)
    digest = xxh3_128_digest(joined)
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True), joined


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc_id"), whole_text(text_col).alias("body"))

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers(PIECE)
        for batch in batches:
            facts, names = [], []
            for text in batch.column(1).to_pylist():
                words = text.split()
                hi, lo, joined = _sequence(words)
                facts.append((hi, lo, len(words), hashlib.sha256(joined).hexdigest()))
                names.append(word_names(words))
            symbols: list[list[np.ndarray]] = [[] for _ in names]
            for no, _, found, _, _ in filed(names, powers, window):
                symbols[no].append(np.unique(found))
            lists = pa.array([np.unique(np.concatenate(s)).view(np.int64) if s else np.zeros(0, np.int64) for s in symbols], pa.list_(pa.int64()))
            hi, lo, n, sha = (list(c) for c in zip(*facts, strict=True)) if facts else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.string()), lists], names=["doc_id", "hi", "lo", "n_words", "sha", "symbols"])

    surveyed = written(source.mapInArrow(survey, "doc_id long, hi long, lo long, n_words long, sha string, symbols array<long>"), "substring-survey")
    rows = surveyed.withColumn("same", F.struct("hi", "lo"))
    groups = written(rows.groupBy("same").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")), "substring-copies")
    rows = written(hot_join(rows, groups, "same", "copies", rows.count()).drop("same", "copies"), "substring-rows")
    removed(surveyed, groups)
    firsts = rows.where("doc_id = first_id").select("doc_id", "hi", "lo", F.explode("symbols").alias("symbol"))
    shared = firsts.groupBy("symbol").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("uses")).where("least < most")
    shared = written(shared.select("symbol", "uses"), "substring-shared")
    # A passage that many documents share has hot symbols and windows: these meet their groups by broadcast.
    wanted = hot_join(firsts, shared, "symbol", "uses", rows.count()).groupBy("doc_id", "hi", "lo").agg(F.collect_set("symbol").alias("symbols"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zstandard import ZstdCompressor

        small = ZstdCompressor(level=3)
        for batch in batches:
            seqs, bodies = [], []
            for text in batch.column(1).to_pylist():
                words = text.split()
                seqs.append(_sequence(words))
                bodies.append(small.compress(seqs[-1][2]))
                seqs[-1] = seqs[-1][:2]
            hi, lo = (list(c) for c in zip(*seqs, strict=True)) if seqs else ([], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(bodies, pa.binary())], names=["doc_id", "hi", "lo", "packed"])

    bodies = source.mapInArrow(pack, "doc_id long, hi long, lo long, packed binary")
    texts = bodies.join(wanted.hint("merge"), ["doc_id", "hi", "lo"]).withColumn("row", F.monotonically_increasing_id())
    texts = written(texts, "substring-texts")

    def hash_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zstandard import ZstdDecompressor

        open_, powers = ZstdDecompressor(), Powers(PIECE)
        for batch in batches:
            ids, rows_, packed, symbols = (c.to_pylist() for c in batch.columns)
            names = [word_names(open_.decompress(p).split()) for p in packed]
            sets = [np.array(sorted(s), dtype=np.int64) for s in symbols]
            for no, first, found, one, two in filed(names, powers, window):
                place = np.searchsorted(sets[no], found.view(np.int64)).clip(max=len(sets[no]) - 1)
                sel = np.flatnonzero(sets[no][place] == found.view(np.int64))
                if len(sel):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(one[sel].view(np.int64)), pa.array(two[sel].view(np.int64)), pa.array(np.full(len(sel), ids[no])), pa.array(np.full(len(sel), rows_[no])), pa.array((sel + first).astype(np.int64))],
                        names=["h1", "h2", "doc_id", "row", "start"],
                    )

    windows = written(texts.select("doc_id", "row", "packed", "symbols").mapInArrow(hash_windows, "h1 long, h2 long, doc_id long, row long, start long"), "substring-windows")
    least = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("uses")).where("least < most")
    least = written(least.select("h1", "h2", "least", "uses"), "substring-first")
    marks = hot_join(windows, least, ["h1", "h2"], "uses", windows.count()).where("doc_id > least")
    marks = marks.groupBy("row").agg(F.collect_list("start").alias("starts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zstandard import ZstdDecompressor

        open_ = ZstdDecompressor()
        for batch in batches:
            out = []
            for packed, starts in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                words = open_.decompress(packed).split()
                at = np.unique(np.array(starts, dtype=np.int64))
                cover = np.zeros(len(words) + 1, np.int64)
                cover[at] += 1
                cover[at + window] -= 1
                kept = np.cumsum(cover[:-1]) == 0
                out.append((int(len(words) - kept.sum()), hashlib.sha256(b" ".join([w for w, k in zip(words, kept.tolist(), strict=True) if k])).hexdigest()))
            n, sha = (list(c) for c in zip(*out, strict=True)) if out else ([], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(n, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "hi", "lo", "cut_words", "cut_sha"])

    cuts = texts.join(marks.hint("merge"), "row").select("doc_id", "hi", "lo", "packed", "starts")
    cuts = cuts.mapInArrow(cut, "doc_id long, hi long, lo long, cut_words long, cut_sha string").dropDuplicates(["doc_id", "hi", "lo"])
    copy = (F.col("doc_id") > F.col("first_id")) & (F.col("n_words") >= window)
    return rows.drop("symbols").join(cuts, ["doc_id", "hi", "lo"], "left").select(
        F.when(F.col("doc_id") != LAST, F.col("doc_id")).alias("doc_id"),
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("cut_words", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(EMPTY_SHA)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
    )
