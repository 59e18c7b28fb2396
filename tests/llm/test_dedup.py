"""Exact, near and substring dedup against brute force."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from xxhash import xxh64_intdigest

import corpus_pipeline
from loomstone.llm import exact_dedup, simhash, substring_dedup

WS = re.compile(r"[\x20\x09-\x0D]+")
EDGE = [(1, None), (2, ""), (3, " \t"), (4, "a b"), (5, "a\n b"), (4, "a b"), (None, "a b"), (9, "x" * 100_000), (10, "wort " * 5000)]


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_exact_dedup_edge_cases(spark, docs):
    index = exact_dedup.DigestIndex(spark, "t_edge")
    index.drop()
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(docs(*EDGE), index).collect()}
    assert got == {(1, 1, 2, True), (2, 1, 2, False), (3, 3, 1, True), (4, 4, 4, True), (4, 4, 4, False), (5, 4, 4, False), (None, 4, 4, False), (9, 9, 1, True), (10, 10, 1, True)}
    assert index.read().count() == 5


def test_exact_dedup_second_batch_meets_the_index(spark, docs):
    index = exact_dedup.DigestIndex(spark, "t_batches", buckets=4)
    index.drop()
    exact_dedup.exact_dedup(docs((5, "one"), (6, "two")), index).collect()
    got = rows_of(exact_dedup.exact_dedup(docs((1, "one"), (7, "three"), (8, "three")), index), "doc_id", "keep_id", "kept")
    assert got == [(1, 5, False), (7, 7, True), (8, 7, False)]
    again = exact_dedup.exact_dedup(docs((7, "three")), index)
    assert rows_of(again, "keep_id", "kept") == [(7, False)]
    assert index.read().groupBy("digest").count().where("count > 1").count() == 0
    assert exact_dedup.exact_dedup(docs().limit(0), index).count() == 0


def test_exact_dedup_in_ranges_of_ids(spark, docs):
    """What the later ranges bring is anti-joined to what the earlier ones left in the index."""
    rnd = random.Random(6)
    rows = [(rnd.choice([None, *range(40)]), rnd.choice("abcdefgh") + rnd.choice(" \t") + rnd.choice("xy")) for _ in range(200)]
    index = exact_dedup.DigestIndex(spark, "t_ranges", buckets=4)
    index.drop()
    got = exact_dedup.exact_dedup(docs(*rows), index, batches=3).collect()
    first = {}
    for i, t in rows:
        key = " ".join(t.split())
        first[key] = min(first.get(key, 99), 99 if i is None else i)
    assert len(got) == len(rows) and sum(r["kept"] for r in got) == len(first) == index.read().count()
    assert {(r["text_sha256"], r["keep_id"]) for r in got} == {(hashlib.sha256(k.encode()).hexdigest(), i) for k, i in first.items()}
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_buckets_grow_with_the_index():
    assert [exact_dedup.buckets_for(n) for n in (0, 1, 10**6, 64 * 10**6, 65 * 10**6, 10**11)] == [16, 16, 16, 32, 32, 65536]


def test_exact_dedup_index_outlives_the_catalog(spark, docs, tmp_path):
    path = f"file://{tmp_path}/index"
    first = exact_dedup.DigestIndex(spark, "t_first", buckets=4, path=path)
    exact_dedup.exact_dedup(docs((5, "one"), (6, "two")), first).collect()
    first.drop()
    again = exact_dedup.DigestIndex(spark, "t_again", buckets=4, path=path)
    assert rows_of(exact_dedup.exact_dedup(docs((1, "one"), (2, "new")), again), "doc_id", "keep_id", "kept") == [(1, 5, False), (2, 2, True)]
    assert again.read().count() == 3


def test_exact_dedup_hot_group(spark, docs):
    index = exact_dedup.DigestIndex(spark, "t_hot")
    index.drop()
    got = exact_dedup.exact_dedup(docs(*[(i, "same") for i in range(300)], *[(1000 + i, f"t{i}") for i in range(50)]), index)
    assert got.where("kept").count() == 51 and got.where("group_size = 300").count() == 300


def brute_fingerprint(text, k=3):
    words = [w for w in WS.split(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    runs = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hs = [xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    """fps: {id: fingerprint}"""
    ids, root = list(fps), {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if bin(fps[a] ^ fps[b]).count("1") <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_components_equal_brute_force(spark, docs):
    rnd = random.Random(3)
    rows, base = [], [" ".join(rnd.choice("alpha beta gamma delta eps zeta eta".split()) + str(rnd.randint(0, 99)) for _ in range(120)) for _ in range(12)]
    for i in range(220):
        w = rnd.choice(base).split()
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(len(w))] = f"Neu{rnd.randint(0, 999)}"
        rows.append((i, " ".join(w)))
    rows += [(300, None), (301, ""), (302, "one"), (303, "ONE"), (304, "one two"), (305, "Ä ö ü ß")]
    got = {r["doc_id"]: r for r in simhash.near_components(docs(*rows)).collect()}
    fps = {i: brute_fingerprint(t) for i, t in rows}
    assert {i: int(r["fingerprint"], 16) for i, r in got.items()} == fps
    assert {i: r["component_id"] for i, r in got.items()} == brute_components(fps)
    assert got[300]["fingerprint"] == "0" * 16 and got[301]["component_id"] == 300


def test_fingerprint_of_a_very_long_text(spark, docs):
    words = ["lorem", "Ipsum", "dolor", "sit", "amet"] * 60_000
    rows = [(1, " ".join(words)), (2, " ".join(words[:-5])), (3, "x" * 2_000_000)]
    got = {r["doc_id"]: r for r in simhash.near_components(docs(*rows)).collect()}
    assert {i: int(got[i]["fingerprint"], 16) for i in (2, 3)} == {2: brute_fingerprint(rows[1][1]), 3: brute_fingerprint(rows[2][1])}
    assert got[2]["component_id"] == 1 and got[3]["component_id"] == 3


def test_simhash_links_are_complete_for_planted_fingerprints(spark):
    rnd = random.Random(5)
    fps = set()
    for _ in range(60):
        f = rnd.getrandbits(64)
        for _ in range(6):
            g = f
            for b in rnd.sample(range(64), rnd.randint(0, 4)):
                g ^= 1 << b
            fps.add(g)
            f = g
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    frame = spark.createDataFrame(signed, "fp long")
    for block in (2, 512):
        edges = [(r["a"], r["b"]) for r in simhash.links(frame, block=block).collect()]
        assert all(bin((a ^ b) & (1 << 64) - 1).count("1") <= 3 for a, b in edges)
        tops = {r["node"]: r["root"] for r in simhash.components(simhash.links(frame, block=block)).collect()}
        want = brute_components({s[0]: s[0] & (1 << 64) - 1 for s in signed})
        assert {i: tops.get(i, i) for i in want} == want


def test_simhash_links_within_seven_bits_are_complete(spark):
    """The keys of the wider ring lose no pair: chains of fingerprints 0 to 9 bits apart, and differences spread evenly."""
    rnd = random.Random(6)
    fps = set()
    for _ in range(80):
        f = rnd.getrandbits(64)
        for _ in range(5):
            fps.add(f)
            for b in rnd.sample(range(64), rnd.randint(0, 9)):
                f ^= 1 << b
    fps |= {sum(1 << 9 * i for i in range(7)), 0, sum(0x8 << 8 * i for i in range(7)), sum(1 << 4 * i for i in range(7))}
    signed = {f - (1 << 64) if f >> 63 else f for f in fps}
    root = {f: f for f in signed}
    for a, b in itertools.combinations(sorted(signed), 2):
        if bin((a ^ b) & (1 << 64) - 1).count("1") <= 7:
            x, y = root[a], root[b]
            root = {i: min(x, y) if r in (x, y) else r for i, r in root.items()}
    found = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), 7)
    assert all(bin((r["a"] ^ r["b"]) & (1 << 64) - 1).count("1") <= 7 for r in found.collect())
    tops = {r["node"]: r["root"] for r in simhash.components(found).collect()}
    assert {f: tops.get(f, f) for f in signed} == root
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([], "fp long"), 8)


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(70)] + [(500, 400 + i) for i in range(40)] + [(9999, 9999)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(71)) and all(got[400 + i] == 400 for i in range(40)) and got[500] == 400
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_one_keeps_the_smallest_of_similar_texts(spark, docs):
    rnd = random.Random(8)
    text = [f"w{rnd.randint(0, 10**6)}" for _ in range(400)]
    near, far = text.copy(), text.copy()
    near[50] = "changed"  # 5 of 396 shingles
    for i in range(0, 400, 10):
        far[i] = f"other{i}"  # half of the shingles
    got = simhash.keep_one(docs((5, " ".join(near)), (2, " ".join(text)), (3, " ".join(far)), (7, ""), (8, None), (None, "a b c"), (9, "a b c")))
    assert sorted((r["doc_id"] for r in got.collect()), key=str) == [2, 3, 7, 8, 9]
    assert got.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_keep_one_row_of_each_text_whatever_the_ids(spark, docs):
    rows = [(0, "A a"), (1, "A a"), (1, "B b"), (None, "A a"), (5, "same"), (5, "same"), (None, None), (3, ""), (None, "only null ids"), (None, "only null ids")]
    want = [("", 3), ("A a", 0), ("B b", 1), ("only null ids", None), ("same", 5)]
    got = corpus_pipeline.once_each(spark, docs(*rows), "")
    assert sorted((r["text"] or "", r["doc_id"]) for r in got.collect()) == want and got.columns == docs(*rows).columns
    near = simhash.keep_one(docs(*rows))
    assert sorted(((r["text"] or "", r["doc_id"]) for r in near.collect()), key=str) == sorted([*want, ("", None)], key=str)
    words = [f"w{i}" for i in range(100)]
    changed = [*words[:50], "else", *words[51:]]
    got = simhash.keep_one(docs((1, " ".join(words)), (1, " ".join(changed)), (1, "quite another text"), (None, " ".join(words)))).collect()
    assert sorted(r["text"][:5] for r in got) == ["quite", "w0 w1"] and {r["doc_id"] for r in got} == {1}
    for stage in (corpus_pipeline.once_each, corpus_pipeline.one_of_near_copies):
        assert stage(spark, docs().limit(0), "").count() == 0


def test_a_key_with_a_third_of_the_rows(spark, docs):
    """One group of near copies and one of exact copies, each a third of all rows."""
    rng, rows = random.Random(2), []
    base = [f"b{i}" for i in range(60)]
    for i in range(900):
        words = base.copy()
        words[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(base if i % 3 else words) if i % 3 < 2 else f"text of its own {i}"))
    got = {r["doc_id"] for r in simhash.keep_one(docs(*rows)).select("doc_id").collect()}
    assert got == {0, *range(2, 900, 3)}
    parts = {r["component_id"] for r in simhash.near_components(docs(*rows)).collect()}
    assert len(parts) > 290


def brute_substrings(rows, window):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("window", [50, 12])
def test_substring_dedup_equals_brute_force(spark, docs, window, monkeypatch):
    monkeypatch.setattr(substring_dedup, "PIECE", 1 << 9)  # texts are cut into pieces
    rnd = random.Random(window)
    pool = [[f"v{rnd.randint(0, 30)}" for _ in range(rnd.randint(20, 150))] for _ in range(12)]
    rows = []
    for i in range(60):
        parts = [rnd.choice(pool)[rnd.randint(0, 9) :] if rnd.random() < 0.6 else [f"u{rnd.randint(0, 5000)}" for _ in range(rnd.randint(1, 120))] for _ in range(rnd.randint(1, 6))]
        rows.append((i, " ".join(w for p in parts for w in p)))
    rows += [(100, rows[3][1]), (101, None), (102, ""), (103, "der " * 700), (104, "x der " + "der " * 300), (105, "ab cd " * 200), (106, "ab cd " * 90), (107, " ".join(pool[0][:49]))]
    got = substring_dedup.remove_repeats(docs(*rows), window)
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute_substrings(rows, window), key=str)


def test_substring_dedup_null_and_repeated_ids(spark, docs):
    text = " ".join(f"w{i}" for i in range(60))
    got = rows_of(substring_dedup.remove_repeats(docs((1, text), (1, text), (None, text + " end"))), "doc_id", "n_words", "n_removed")
    assert got == [(1, 60, 0), (1, 60, 0), (None, 61, 60)]
    assert substring_dedup.remove_repeats(docs().limit(0)).count() == 0


def test_window_symbols_depend_on_the_window_alone():
    rnd = np.random.default_rng(1)
    for _ in range(30):
        core = rnd.integers(0, 6, 50).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        seen = set()
        for _ in range(6):
            a, b = (rnd.integers(0, 6, rnd.integers(0, 90)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(2))
            h = np.concatenate([a, core, b])
            at = np.array([len(a)])
            seen.add(int(substring_dedup.window_symbols(h, at, np.array([7], np.uint64))[0]))
        assert len(seen) == 1


def _kept_by_force(rows, similarity=0.8):
    """The ids that are left when of texts connected by the exact Jaccard similarity the smallest id stays."""
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in ((i, t.split()) for i, t in rows)}
    root = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        if len(sets[a] & sets[b]) * 10 >= similarity * 10 * len(sets[a] | sets[b]):
            x, y = root[a], root[b]
            root = {i: min(x, y) if r in (x, y) else r for i, r in root.items()}
    return {i for i, r in root.items() if i == r}


@pytest.mark.parametrize("family,block", [(16_384, 512), (16_384, 3), (4, 3), (1, 512)])
def test_similar_links_in_blocks_and_by_shingles(spark, docs, monkeypatch, family, block):
    """Families in one block, in several, and those too large to be compared as a whole give the same components."""
    monkeypatch.setattr(simhash, "FAMILY", family)
    rng, rows = random.Random(9), []
    shared = [f"s{i}" for i in range(60)]
    for i in range(120):
        words = [*shared, *(f"t{i}w{k}" for k in range(rng.randrange(14)))] if i % 2 else [f"g{i // 20}w{k}" for k in range(80)]
        for at in rng.sample(range(len(words)), rng.randrange(4)):
            words[at] = f"x{rng.randrange(10**9)}"
        rows.append((i, " ".join(words)))
    links = simhash.similar_links(docs(*rows), block=block).collect()
    root = {i: i for i, _ in rows}
    for a, b in links:
        x, y = root[a], root[b]
        root = {i: min(x, y) if r in (x, y) else r for i, r in root.items()}
    kept = {i for i, r in root.items() if i == r}
    assert kept == _kept_by_force(rows) and len(kept) < 100


def test_shared_counts_are_exact_but_for_short_hashes(spark, docs):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(30)))) for i in range(80)] + [(90, None), (91, "")]
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in ((i, (t or "").split()) for i, t in rows)}
    uses = collections.Counter(x for s in sets.values() for x in s)
    source = docs(*rows).repartition(5).selectExpr("doc_id", "cast(coalesce(text, '') as binary) as body")
    got = {r["doc_id"]: (r["n"], r["m"]) for r in simhash.shared_counts(source, 5).collect()}
    assert got == {i: (len(s), sum(uses[x] > 1 for x in s)) for i, s in sets.items()}


def test_a_failed_pair_hides_no_similar_one(spark, docs):
    """Groups of copies near the threshold: all that passing pairs connect is one component."""
    rng, rows = random.Random(5), []
    for group in range(60):
        base = [f"g{group}w{i}" for i in range(104)]
        for _ in range(8):
            words = base.copy()
            for at in rng.sample(range(0, 100, 5), 1 + rng.randrange(2)):
                words[at] = f"x{rng.randrange(10**9)}"
            rows.append((len(rows), " ".join(words)))
    got = {r["doc_id"] for r in simhash.keep_one(docs(*rows)).select("doc_id").collect()}
    assert got == _kept_by_force(rows)


def test_short_texts_are_decided_by_their_shingles(spark, docs):
    """Pairs of 4 against 5 shingles are at 0.8 and go, pairs of 6 against 8 are at 0.75 and stay, whatever their bits."""
    rows = []
    for pair in range(300):
        short, long = [f"s{pair}w{i}" for i in range(9)], [f"l{pair}w{i}" for i in range(12)]
        rows += [(len(rows), " ".join(short)), (len(rows) + 1, " ".join(short[:8]))]
        rows += [(len(rows), " ".join(long)), (len(rows) + 1, " ".join(long[:10]))]
    got = {r["doc_id"] for r in simhash.keep_one(docs(*rows)).select("doc_id").collect()}
    assert got == {i for i, _ in rows if i % 4 != 1} == _kept_by_force(rows[:40]) | {i for i, _ in rows[40:] if i % 4 != 1}


def near_rows(rng):
    """Groups of copies with up to five changed words, texts that share a part with another, short and empty ones."""
    rows = []
    for group in range(30):
        base = [f"g{group}w{i}" for i in range(150)]
        for _ in range(6):
            words = base.copy()
            for at in rng.sample(range(150), rng.randrange(6)):
                words[at] = f"x{rng.randrange(10**9)}"
            rows.append((len(rows), " ".join(words)))
        rows.append((len(rows), " ".join([*base[:75], *(f"h{group}w{i}" for i in range(75))])))
    return [*rows, *((1000 + i, t) for i, t in enumerate([None, "", "one", "ONE", "one two", "one two"]))]


def test_near_dedup_finds_pairs_by_fingerprints(spark, docs, monkeypatch):
    """With the exact way for the rest taken out, what pigeonring proposes and the sets confirm still goes, and nothing else."""
    rows = near_rows(random.Random(4))
    monkeypatch.setattr(simhash, "other_links", lambda some, *_: some.selectExpr("doc_id as a", "doc_id as b").limit(0))
    got = {r["doc_id"] for r in corpus_pipeline.one_of_near_copies(spark, docs(*rows), "").select("doc_id").collect()}
    fps = {i: brute_fingerprint(t, 2) for i, t in rows}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in ((i, (t or "").lower().split()) for i, t in rows)}
    similar = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = {i: i for i in sets}
    for a, b in similar:
        if bin(fps[a] ^ fps[b]).count("1") <= 7:
            x, y = root[a], root[b]
            root = {i: min(x, y) if r in (x, y) else r for i, r in root.items()}
    near, gone = {i for i, r in root.items() if i != r}, set(fps) - got
    assert len(near) > 50 and {1003, 1005} <= gone and gone <= {i for pair in similar for i in pair}
    # the forest of a key may pass on another pair than a similar one; nearly all that are near go all the same
    assert gone <= near and len(near - gone) <= 0.1 * len(near)


def test_near_pairs_that_are_linked_are_not_compared_again(spark, docs, monkeypatch):
    """The exact way gets the parts that SimHash has made, links only across them, and both ways together find all."""
    rows, seen = near_rows(random.Random(5)), []
    other = simhash.other_links

    def spied(some, sets, parts, *rest):
        seen.append({r["node"]: r["root"] for r in parts.collect()})
        found = other(some, sets, parts, *rest)
        seen.append([(r["a"], r["b"]) for r in found.collect()])
        return found

    monkeypatch.setattr(simhash, "other_links", spied)
    rows = [(i, (t or "").lower()) for i, t in rows]
    got = {r["doc_id"] for r in simhash.keep_one(docs(*rows)).select("doc_id").collect()}
    assert got == _kept_by_force([r for r in rows if r[1]]) | {i for i, t in rows if not t}
    part, across = seen
    assert part and across and all(part.get(a, a) != part.get(b, b) for a, b in across)
