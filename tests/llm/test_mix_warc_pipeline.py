"""Mixing, WARC archives and the pipeline."""

import math
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from loomstone.llm import mixing, quality, warc
from loomstone.llm.common import written


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000])
def test_permutation_and_inverse(n):
    p = mixing.permuted(np.arange(n), n, 99)
    assert sorted(p) == list(range(n)) and [mixing.slot_of(int(b), n, 99) for b in p] == list(range(n))


def test_targets_fill_to_the_caps():
    sizes = [("a", 10), ("b", 1000), ("c", 1000), ("d", 5), (None, 0)]
    got = mixing.targets(sizes)
    assert sum(got) == pytest.approx(1.5 * 2015) and got[0] == 20 and got[3] == 10 and got[4] == 0
    assert got[1] / got[2] == pytest.approx(2.0) or got[1] == 2000
    assert mixing.targets([]) == []


def test_slots_reach_the_target_exactly():
    rnd = random.Random(1)
    for _ in range(500):
        size, length, key = rnd.randint(1, 3000), rnd.choice([8, 64, 512]), rnd.getrandbits(60)
        target = rnd.uniform(0, 2 * size)
        slots, last = mixing.slots_needed(target, size, length, key)
        blocks = -(-size // length)
        perm, words = mixing.permuted(np.arange(blocks), blocks, key), 0
        for j in range(slots):
            full = min(length, size - int(perm[j % blocks]) * length)
            words += min(full, last) if j == slots - 1 else full
        assert words == round(target)


def test_shard_counts_sum_to_the_totals():
    totals, shards = np.array([700, 0, 90, 13]), 9
    parts = [mixing._shard_counts(totals, shards, s, 100, 7) for s in range(shards)]
    assert sum(p[0] for p in parts).tolist() == totals.tolist()
    for s in range(1, shards):
        assert parts[s][1].tolist() == (parts[s - 1][1] + parts[s - 1][0]).tolist()
    assert all(p[0].sum() == 100 for p in parts[:8]) and parts[8][0].sum() == 3


def test_hypergeometric_draws_at_every_size():
    """By inversion: the exact probabilities for a small urn; mean and spread for one beyond a generator's usual range."""
    draw = np.random.Generator(np.random.Philox(key=[1, 2]))
    got = np.bincount([mixing._hyper(draw, 7, 5, 6) for _ in range(20_000)], minlength=7) / 20_000
    want = [math.comb(7, x) * math.comb(5, 6 - x) / math.comb(12, 6) for x in range(7)]
    assert np.abs(got - want).max() < 0.015
    good, bad, sample = 20_000_000_000, 10_000_000_000, 12_000_000_000
    some = np.array([mixing._hyper(draw, good, bad, sample) for _ in range(200)], float)
    sd = math.sqrt(sample * (good / (good + bad)) * (bad / (good + bad)) * (good + bad - sample) / (good + bad - 1))
    assert abs(some.mean() - sample * 2 / 3) < 5 * sd / math.sqrt(200) and 0.7 < some.std() / sd < 1.3
    assert mixing._hyper(draw, 0, 5, 3) == 0 and mixing._hyper(draw, 5, 0, 3) == 3


def test_mixture_of_texts_against_the_streams(spark, docs):
    """Each document's words, the blocks of the streams and the slots, put together in plain Python."""
    rnd = random.Random(12)
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(rnd.randint(0, 90))), rnd.choice(["a", "b", None])) for i in range(60)]
    rows += [(7, "twice the same", "a"), (7, "twice the same", "a"), (None, "no id here", "b"), (None, "nor here", "b"), (8, None, "b")]
    table = docs(*rows)
    placed, slots, sources = mixing.mix(table, block_words=16, shard_slots=20)
    streams: dict[int, dict[int, str]] = {}
    text_of: dict[tuple, list] = {}
    for i, text, source in rows:
        text_of.setdefault((i, source, len((text or "").split())), []).append((text or "").split())
    for r in placed.orderBy("start").collect():
        options = text_of[r["doc_id"], r["source"], r["size"]]
        words = options.pop()
        for k, w in enumerate(words):
            assert (r["start"] + k) not in streams.setdefault(r["source_no"], {})
            streams[r["source_no"]][r["start"] + k] = w
    for no, stream in streams.items():
        assert sorted(stream) == list(range(len(stream)))
    want, taken = {}, {}
    for r in slots.collect():
        stream = streams[r["source_no"]]
        words = [stream[p] for p in range(r["block"] * 16, min(len(stream), (r["block"] + 1) * 16))][: r["words_cap"]]
        want[r["shard"], r["slot"]] = " ".join(words)
        for w in words:
            taken[w] = taken.get(w, 0) + 1
    got = {(r["shard"], r["slot"]): r["text"] for r in mixing.mixed_texts(table, placed, slots, 16).collect()}
    assert got == want and len(got) > 100
    totals = {r["source_no"]: round(r["target"]) for r in sources.collect()}
    assert sum(len(t.split()) for t in got.values()) == sum(totals.values())
    for r in mixing.taken_words(placed, slots, 16).collect():
        if r["doc_id"] is not None and r["doc_id"] not in (7, 8):
            words = next(t for i, t, _ in rows if i == r["doc_id"]).split()
            assert r["taken"] == sum(taken.get(w, 0) for w in words) <= 2 * r["size"]
    shards = {}
    for r in slots.collect():
        shards.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in shards.values())


def test_too_many_sources_are_refused(spark, docs, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_SOURCES", 2)
    with pytest.raises(ValueError, match="sources"):
        mixing.mix(docs((1, "a", "x"), (2, "b", "y"), (3, "c", "z")))


def test_mix_whole_table(spark, docs):
    rnd = random.Random(4)
    rows = [(i, "wort " * rnd.randint(0, 400), rnd.choice(["a", "b", "b", "b", None])) for i in range(300)] + [(999, None, "z"), (1000, "", None), (5, "x y", "a"), (None, "q", "a")]
    placed, slots, sources = mixing.mix(docs(*rows), block_words=32, shard_slots=50)
    out = mixing.taken_words(placed, slots, 32).toPandas()
    assert len(out) == len(rows) and (out["taken"] <= 2 * out["size"]).all()
    known = {r["source"]: r for r in sources.collect()}
    assert known["z"]["source_size"] == 0
    sizes = out.groupby("target")["taken"].sum()
    assert all(abs(words - target) <= 1 for target, words in sizes.items())
    again = mixing.taken_words(*mixing.mix(docs(*rows), block_words=32, shard_slots=50)[:2], 32).toPandas()
    key = ["doc_id", "size"]
    assert out.sort_values(key)["taken"].tolist() == again.sort_values(key)["taken"].tolist()
    parts = mixing.pieces(placed, slots, 32).toPandas()
    assert parts["words"].sum() == out["taken"].sum() and (parts["first_word"] >= 0).all()
    assert not parts.duplicated(["shard", "slot", "at"]).any()
    empty = mixing.mix(docs().limit(0))
    assert mixing.taken_words(*empty[:2]).count() == 0


def test_chunked_framing():
    for n in (0, 1, 8192, 8193, 20000):
        body = bytes(random.Random(n).choices(b"ab\r\n0", k=n))
        assert warc.unchunked(warc.chunked(body)) == body
    for bad in (b"", b"5\r\nab", b"zz\r\nab\r\n0\r\n\r\n", b"2\r\nabX0\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.unchunked(bad)


def test_archives_round_trip(spark, tmp_path):
    big = "".join(random.Random(1).choices("ab<>\r\n é", k=5000))
    rows = [(1, "http://a", "x"), (2, "http://b", "x"), (3, None, None), (4, "u\r\nWARC/1.0", ""), (5, "http://c", big), (6, "http://d", big + "!"), (None, "http://e", "x"), (7, "http://f", "WARC/1.1\r\n\r\n\r\nxx"), (7, "http://f", "other")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    path = f"file://{tmp_path}/w"
    warc.write_archives(df, path, segment_bytes=300, file_records=10)
    got = warc.read_archives(spark, path).toPandas()
    assert len(got) == len(rows) and got["error"].isna().all()
    text = {r[0]: (r[2] or "").encode() for r in rows if r[0] is not None and r[0] != 7}
    for r in got.to_dict("records"):
        if r["page_id"] in text:
            assert r["payload_bytes"] == len(text[r["page_id"]]) and r["payload_digest"] == warc.base32_sha1(text[r["page_id"]])
            if r["record_type"] == "response":
                assert bytes(r["payload"]) == text[r["page_id"]]
    kinds = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in got.to_dict("records") if r["page_id"] in text}
    assert kinds[1] == ("revisit", 2) and kinds[2][0] == "response" and kinds[3] == ("revisit", 4) and kinds[4][0] == "response"
    warc.write_archives(df.limit(0), f"file://{tmp_path}/none")
    assert warc.read_archives(spark, f"file://{tmp_path}/none").count() == 0
    warc.write_archives(df.where("page_id < 3"), f"file://{tmp_path}/large", min_bytes=10)
    assert warc.read_archives(spark, f"file://{tmp_path}/large").where("record_type = 'response'").count() == 2


def test_repeated_and_null_ids_with_long_payloads(spark, tmp_path):
    """Rows that repeat id and payload, many equal payloads, and texts of over a megabyte in many segments."""
    rnd = random.Random(3)
    big, huge = "".join(rnd.choices("ab<>\r\n é", k=900)), "wörter \r\n\r\n" * 120_000
    rows = [(1, "u", big), (1, "u", big), (None, "u", big + "?"), (None, "u", big + "?"), (2, "u", huge), *((10 + i, "u", "the same page" * 40) for i in range(200))]
    path = f"file://{tmp_path}/w"
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as row_key", "2 as digest")
    warc.write_archives(df, path, segment_bytes=256, file_records=500)
    got = warc.read_archives(spark, path).toPandas()
    assert len(got) == len(rows) and got["error"].isna().all()
    by = {k: part for k, part in got.groupby("payload_digest")}
    for text in (big, big + "?", huge, "the same page" * 40):
        part = by[warc.base32_sha1(text.encode())]
        assert (part["record_type"] == "response").sum() == 1 and (part["payload_bytes"] == len(text.encode())).all()
        assert bytes(part[part["record_type"] == "response"]["payload"].iloc[0]) == text.encode()
    same = by[warc.base32_sha1(b"the same page" * 40)]
    assert same[same["record_type"] == "response"]["page_id"].tolist() == [209] and set(same[same["record_type"] == "revisit"]["refers_to"]) == {209}


def test_heads_that_cannot_be_read():
    good = b"".join(r + b"\r\n\r\n" for r in warc.page_records(1, 5, "u", b"text"))
    broken = [good.replace(b"WARC-Target-URI: u", b"WARC-Target-URI: \xff\xfe"), good.replace(b"Content-Length", b"Content-Size"), good.replace(b"X-Page-ID: 5", b"X-Page-ID: five"), good[:-40]]
    for bad in broken:
        got = [warc._row(*r) for r in warc.parse_records(good + bad + good)]
        assert [r[0] for r in got][0] == 5 and got[-1][4] == b"text" and any(r[7] and r[4] is None for r in got)
    assert [bool(warc._row(*r)[7]) for r in warc.parse_records(b"no archive")] == [True]


def test_reassembly_reports_what_is_broken():
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + warc.chunked(b"payload")
    head = {"WARC-Type": "response", "X-Page-ID": "1", "WARC-Target-URI": "u"}
    a, b = block[:20], block[20:]
    good = [("o", 1, None, head, a), ("o", 2, len(block), None, b)]
    assert next(warc.reassemble(iter(good)))[4] == b"payload"
    for bad in ([good[0]], [good[1]], [good[0], ("o", 3, len(block), None, b)], [good[0], ("o", 2, 7, None, b)], [good[0], good[1], good[1]]):
        row = next(warc.reassemble(iter(bad)))
        assert row[4] is None and row[7]


def test_pipeline_stages_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    now = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = now.columns, []
    for name, stage in corpus_pipeline.STAGES[:4]:
        nxt = written(stage(spark, now, sf), "stage")
        assert nxt.columns == columns
        kept.append((name, {r["doc_id"]: r["text"] for r in now.select("doc_id", "text").collect()}, {r["doc_id"] for r in nxt.select("doc_id").collect()}))
        now = nxt
    (_, before, good), (_, before2, once), (_, before3, apart), (_, before4, clean) = kept
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    known = [i for i in before if i in labels]
    assert sum((i in good) == (labels[i] == 1) for i in known) / len(known) > 0.97
    first: dict[str, int] = {}
    for i in sorted(before2):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", before2[i] or ""), i)
    assert once == set(first.values())
    sets = {i: shingle_set(t) for i, t in before3.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    by: dict[bytes, list[int]] = {}
    for i in ids:
        for s in sets[i]:
            by.setdefault(s, []).append(i)
    pairs = {(a, b) for members in by.values() if len(members) > 1 for a in members for b in members if a < b}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert apart == {i for i in ids if find(i) == i}
    hit = {r["doc_id"] for r in __import__("loomstone.llm.decontaminate", fromlist=["x"]).contaminated(spark.createDataFrame([(i, t) for i, t in before4.items()], "doc_id long, text string"), spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert clean == set(before4) - hit and hit
    assert corpus_pipeline.STAGES[4][1](spark, now, sf).count() == len(clean)


def test_pipeline_with_nulls_repeats_and_clashing_columns(spark, tmp_path):
    rng = random.Random(11)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    one, leak, long = text(60), text(30), text(150_000)
    rows = [(0, one), (1, one), (1, "B b " + text(20)), (None, one), (5, "same"), (5, "same"), (None, None), (7, None), (8, ""), (9, " ".join([*one.split()[:-1], "else"])), (10, "before " + leak + " after"), (11, long), (None, text(9)), (None, text(9))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row_key string, key string, n long, kept boolean"
    docs = [(i, t, None, rng.choice(["a", None]), None, "x", None, 3, False) for i, t in rows]
    folder = f"file://{tmp_path}/sf"
    for name, made in {
        "documents": spark.createDataFrame(docs, schema), "labels": spark.createDataFrame([(None, 1, 0), (1, None, 0), (0, 1, 0)], "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(1, leak), (2, None), (None, "")], "item_id long, text string"),
    }.items():
        made.write.parquet(f"{folder}/{name}.parquet")
    now = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        now = written(stage(spark, now, folder), "stage")
        assert now.columns == schema.replace(" ", ",").split(",")[0:1] + [c.split()[0] for c in schema.split(", ")][1:]
    # one of the three copies and the near copy; "same" once; one empty text; the leak is gone; null ids stay where they differ
    left = sorted(((r["doc_id"], (r["text"] or "")[:4]) for r in now.select("doc_id", "text").collect()), key=str)
    assert [x for x in left if x[0] is not None] == [(0, one[:4]), (1, "B b "), (11, long[:4]), (5, "same"), (7, "")]
    assert sum(x[0] is None for x in left) == 2
    out = corpus_pipeline.run(spark, folder).toPandas()
    assert len(out) == len(left) and (out["taken"] <= 2 * out["size"]).all() and out["size"].max() == 150_000
    spark.createDataFrame([], schema).write.parquet(f"{folder}2/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{folder}2/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{folder}2").count() == 0


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or ({b" ".join(w)} if w else set())


def test_model_is_the_same_on_reruns(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    a, b = (quality.train(docs, labels) for _ in range(2))
    assert np.array_equal(a.weight, b.weight) and (a.slope, a.offset) == (b.slope, b.offset)
