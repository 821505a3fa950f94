"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, against plain Python."""

import hashlib
import zlib

import brute
import pytest
from pyspark.sql import functions as F

from pageloom.llm import decontamination, language_id, licenses, packing, sharding, simhash, substrings, topk, toxicity, url_filter
from pageloom.llm.queries import tokeniser_path

A = " ".join(f"alpha{i}" for i in range(40))
B = " ".join(f"beta{i}" for i in range(40))
TEXTS = [
    (0, A),
    (1, "x y " + A + " z"),
    (2, B),
    (3, None),
    (4, ""),
    (5, " \n\t\x0b "),
    (6, "one two"),
    (7, "All rights reserved. CC BY cc by\ufb01 general PUBLIC license, all rights reserved all rights reserved"),
    (8, ("word " * 30000) + B.upper()),
    (9, A),
    (9, A),
    (10, "Èé ALPHA1 ıI K \u2028 naïve " + " ".join(f"beta{i}" for i in range(5, 20))),
    (11, "this software is Licensed under the Apache License Version 2.0 ok"),
    (12, "…!?"),
    (None, B),
]
#: Names of results and of helpers, which an operator must not mix up with its own.
HELPERS = ["_row", "_w", "_lic", "_t0", "_s", "_m", "_doc", "_fp", "doc", "row", "w", "lic", "fp", "win", "u"]
SCHEMA = "doc_id long, text string, score string, n_words string, covered int, lang string, shard string, " + ", ".join(f"{c} string" for c in HELPERS)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", "y", 1, "en", "z", *HELPERS) for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _named(rows):
    return [(i, t) for i, t in rows if i is not None]


def _sorted(rows):
    return sorted(map(tuple, rows), key=str)


def test_decontamination(spark, docs, none):
    bench = [(1, " ".join(f"Beta{i}" for i in range(5, 17))), (2, "two"), (3, None), (4, "?!"), (5, "ALPHA7, alpha8"), (5, "ALPHA7, alpha8"), (None, "one")]
    items = spark.createDataFrame(bench, "item_id long, text string")
    want = brute.decontamination(TEXTS, bench)
    for limit in (decontamination.SET_WINDOWS, 0):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(decontamination, "SET_WINDOWS", limit)
            found = decontamination.contamination(docs, items)
            got = found.select("doc_id", "n_words", F.size("covered"), F.size("items"), F.sha2(F.array_join("items", ","), 256), F.size("covered") > 0).collect()
            assert _sorted(got) == _sorted(want)
            assert found.columns.count("n_words") == 1 and "score" in found.columns
            kept = decontamination.without_hits(docs, items)
            cleaned = {r["doc_id"]: r["text"] for r in kept.collect()}
            assert kept.columns == docs.columns and all(r[c] == c for f in (found, kept) for r in f.collect() for c in HELPERS)
            # the item without an id hits "one", so document 6 loses both words
            assert cleaned[0] == A.replace("alpha7 alpha8 ", "") and 6 not in cleaned and cleaned[5] == " \n\t\x0b " and cleaned[3] is None
            assert decontamination.contamination(none, items).count() == 0
            nothing = decontamination.contamination(docs, items.limit(0))
            assert nothing.where(F.size("covered") > 0).count() == 0 and nothing.count() == len(TEXTS)


def test_licenses(docs, none):
    found = licenses.license_scan(docs)
    n = F.size("places")
    got = found.select("doc_id", "n_words", n.cast("long"), F.array_min("places"), F.array_max("places"), "base_labels").collect()
    assert _sorted(got) == _sorted(brute.license_base(TEXTS))
    labels = {r["doc_id"]: (r["labels"], r["score"]) for r in found.collect()}
    assert labels[11] == ("apache-2.0", 1.0) and labels[7][0] == "cc-by,gpl,reserved" and labels[3] == ("", 0.0)
    assert licenses.license_scan(none).count() == 0
    assert all(r[c] == c for r in found.collect() for c in HELPERS)


def test_substrings(docs, none):
    named = docs.where("doc_id is not null")
    got = substrings.repeated_words(named).collect()
    assert _sorted(got) == _sorted(brute.substring(_named(TEXTS)))
    with_null = {r["doc_id"]: r["n_removed"] for r in substrings.repeated_words(docs).collect()}
    assert with_null[None] == 40 and with_null[2] == 0  # no id: after every id
    assert substrings.repeated_words(none).count() == 0
    kept = substrings.without_repeats(named)
    rows = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert kept.columns == docs.columns and 9 not in rows and rows[1] == "x y z" and rows[3] is None and rows[5] == " \n\t\x0b "


def test_substring_shapes(spark):
    """Passages at the ends, overlaps, windows that repeat inside one document, and runs of one word."""
    p = [f"p{i}" for i in range(13)]
    rows = [
        (5, " ".join(p[:12])),
        (6, " ".join(["q", *p, "r"])),
        (7, " ".join([*p, *p])),
        (8, " ".join(["a"] * 40)),
        (9, " ".join(["b", *["a"] * 14, "c"])),
        (10, " ".join([*p[1:], "s", *p])),
        (11, " ".join(["a"] * 40)),
    ]
    got = substrings.repeated_words(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert _sorted(got) == _sorted(brute.substring(rows))


def test_wavelet_ranks():
    import numpy as np

    rng = np.random.default_rng(0)
    s = rng.integers(0, 19, 500)
    w = substrings.WaveletMatrix(s, 19)
    symbol, at = rng.integers(0, 19, 300), rng.integers(0, 501, 300)
    assert w.rank(symbol, at).tolist() == [int((s[:i] == c).sum()) for c, i in zip(symbol, at)]
    for share in (0.01, 0.5, 1.0, 0.0):
        bit = rng.random(700) < share
        bits, ones = substrings.Bits(bit), np.flatnonzero(bit)
        assert bits.rank(np.arange(701)).tolist() == np.concatenate([[0], np.cumsum(bit)]).tolist()
        assert bits.select(np.arange(len(ones) + 2)).tolist() == [*ones.tolist(), 700, 700]


def plain_statistics(text, streamed):
    """The length, at most 13, of the longest match that ends at each place of each streamed segment of 13 or more."""
    runs = {tuple(t[i:j]) for t in text for i in range(len(t)) for j in range(i + 1, min(len(t), i + 13) + 1)}
    out = []
    for s in streamed:
        for end in range(len(s)):
            longest = max((n for n in range(1, min(13, end + 1) + 1) if tuple(s[end + 1 - n : end + 1]) in runs), default=0)
            out.append(longest if len(s) > end >= 12 else None)
    return out


def test_matching_statistics_by_brute_force():
    """Streams that mostly do not match, with words the index doesn't have, against all runs of the text."""
    import numpy as np

    for seed in range(12):
        rng = np.random.default_rng(seed)
        sigma = int(rng.integers(2, 30))
        text = [rng.integers(1, sigma, int(rng.integers(13, 60))).tolist() for _ in range(int(rng.integers(1, 12)))]
        streamed = [rng.integers(1, sigma + 3, int(rng.integers(13, 50))).tolist() for _ in range(9)]
        for s in streamed[::2]:  # some with a passage of the text
            t = text[int(rng.integers(len(text)))]
            n = int(rng.integers(5, min(len(t), 30)))
            at = int(rng.integers(0, len(t) - n + 1))
            s[3:3] = t[at : at + n]
        flat = np.array([x for t in text for x in [*t, 0]])
        index = substrings.FMIndex(flat, sigma)
        codes = np.array([x if x < sigma else -1 for s in streamed for x in s])
        size = np.array(list(map(len, streamed)))
        got = index.matching_statistics(codes, np.cumsum(size) - size, size).tolist()
        want = plain_statistics(text, [[x if x < sigma else None for x in s] for s in streamed])
        assert sum(w is not None and w >= 13 for w in want) < 0.5 * len(want)
        # a place that no window of 13 can end at any more need not be looked at
        assert all(g == w or (g == 0 and w < 13) for g, w in zip(got, want) if w is not None)
        assert sum(g == w for g, w in zip(got, want) if w is not None) >= 0.9 * sum(w is not None for w in want)


def test_repeated_windows_by_brute_force():
    """Halving by owners against a dictionary of windows, with owners that hold several segments and few keys."""
    import numpy as np

    for seed in range(20):
        rng = np.random.default_rng(seed)
        pool = rng.integers(0, 4, 200)
        segments, owner = [], []
        for _ in range(int(rng.integers(1, 60))):
            n, at = int(rng.integers(13, 30)), int(rng.integers(0, 150))
            segments.append(pool[at : at + n] if rng.random() < 0.7 else rng.integers(0, 4, n))
            owner.append(int(rng.integers(0, 15)) if rng.random() < 0.9 else substrings._NOBODY)
        size = np.array(list(map(len, segments)))
        codes, begin = np.concatenate(segments), np.cumsum(size) - size
        got = substrings.repeated(codes, begin, size - 12, np.array(owner), np.zeros(len(size), np.uint32)).tolist()
        first = {}
        windows = [(tuple(s[i : i + 13].tolist()), o) for s, o in zip(segments, owner) for i in range(len(s) - 12)]
        for w, o in windows:
            first[w] = min(first.get(w, o), o)
        assert got == [first[w] < o for w, o in windows]


def test_equal_hashes_do_not_make_words_equal(monkeypatch):
    """With every hash the same, segments and words are still told apart."""
    import numpy as np

    monkeypatch.setattr(substrings, "_mix", lambda x: x & np.uint64(0))
    monkeypatch.setattr(substrings, "_spans", lambda values, begin, end, base: np.zeros(len(begin), np.uint64))
    texts = [(" ".join(f"{c}{i}" for i in range(20))).encode() for c in "abab"]
    chunk = substrings.Chunk(texts, np.array([4, 3, 2, 1]))
    firsts = [int(chunk.doc[chunk.like[i]]) for i in range(len(chunk.like))]
    assert all(texts[d] == texts[int(chunk.doc[i])] for i, d in enumerate(firsts))


def test_split_minimizers(spark, monkeypatch):
    """A passage in every document, in chunks of one document: its windows go through groups of chunks."""
    import random

    rng = random.Random(3)
    passage = [f"p{i}" for i in range(40)]
    rows = []
    for i in range(60):
        own = [rng.choice("abcdefgh") + str(rng.randrange(300)) for _ in range(30)]
        at = rng.randrange(20)
        rows.append((i * 7 % 61, " ".join([*own[:15], *passage[at : at + 20], *own[15:]])))
    rows += [(100 + i, t) for i, (_, t) in enumerate(rows[:5])]
    monkeypatch.setattr(substrings, "CHUNK_BYTES", 300)
    for heavy, group in ((2, 8), (2, 1024), (256, 1024)):
        monkeypatch.setattr(substrings, "HEAVY", heavy)
        monkeypatch.setattr(substrings, "GROUP", group)
        got = substrings.repeated_words(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
        assert _sorted(got) == _sorted(brute.substring(rows))


def test_simhash(docs, none):
    named = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = simhash.near_duplicates(named).collect()
    assert _sorted(got) == _sorted(brute.near([t for t in dict(_named(TEXTS)).items()]))
    every = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    assert every[None]["component_id"] == 2 and every[3]["fingerprint"] == "0" * 16 and every[5]["component_id"] == 3
    assert simhash.near_duplicates(none).count() == 0
    assert all(r[c] == c for r in simhash.one_each(docs).collect() for c in HELPERS) and simhash.one_each(none).count() == 0
    kept = [r["doc_id"] for r in simhash.one_each(docs).collect()]
    assert kept.count(0) == 1 and 9 not in kept and len(kept) == len(set(kept))


def test_one_each_judges_rows(spark):
    """Null ids and shared ids: only rows that resemble another row go."""
    text = {c: " ".join(f"{c}{i}" for i in range(40)) for c in "abcdefg"}
    rows = [(None, text["a"]), (None, text["b"]), (None, text["b"]), (3, text["c"]), (3, text["d"]), (3, text["d"])]
    rows += [(1, text["e"]), (5, text["e"]), (5, text["f"]), (None, text["f"]), (7, text["g"]), (2, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = simhash.one_each(docs)
    assert got.columns == docs.columns
    want = [(None, text["a"]), (None, text["b"]), (3, text["c"]), (3, text["d"]), (1, text["e"]), (5, text["f"]), (7, text["g"]), (2, "")]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_anchor_points_miss_nothing():
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.integers(0, 2**63, 3000, dtype=np.uint64) << np.uint64(1)
    y = x.copy()
    for _ in range(4):
        y ^= np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)
    for pairs in (False, True):
        rows, keys = simhash.anchors(np.concatenate([x, y]).view(np.int64), pairs)
        sets = [set() for _ in range(6000)]
        for r, k in zip(rows.tolist(), keys.tolist()):
            sets[r].add(k)
        assert all(sets[i] & sets[i + 3000] for i in range(3000)) and len(rows) == sum(map(len, sets))
        assert np.mean([len(s) for s in sets]) < (200 if pairs else 17)


def test_every_word_has_one_near_anchor():
    """Covering radius 3: each word of 23 bits lies within 3 bits of exactly one of the 4,096 anchors."""
    import numpy as np

    x = np.random.default_rng(1).integers(0, 1 << 23, 20000)
    near, _, n = simhash._within(x, 0)
    assert (n == 1).all() and (np.bitwise_count(near ^ x) <= 3).all()
    every, _, _ = simhash._within(np.arange(1 << 12), 0)
    assert len(np.unique(simhash._within(np.arange(1 << 23), 0)[0])) == 4096 and len(every) == 4096
    assert (np.bitwise_count(simhash._within(x, 2)[0] ^ np.repeat(x, simhash._within(x, 2)[2])) == 5).all()


@pytest.mark.parametrize("single", [1 << 20, 0])
def test_simhash_tiles(spark, monkeypatch, single):
    """A chain of fingerprints and a dense group, cut into tiles, by anchors and by pairs of them, against all pairs."""
    monkeypatch.setattr(simhash, "SINGLE", single)
    import random

    random.seed(4)
    prints = {random.getrandbits(64) for _ in range(300)}
    chain = random.getrandbits(64)
    for i in range(0, 60, 2):
        chain ^= 7 << i
        prints.add(chain)
    centre = random.getrandbits(64)
    prints |= {centre ^ (1 << i) ^ (1 << j) for i in range(20) for j in range(20)}
    prints = sorted(prints)
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    monkeypatch.setattr(simhash, "TILE", 32)
    nodes = spark.createDataFrame([(f, i) for i, f in enumerate(signed)], "fp long, node long")
    got = {r["u"]: r["v"] for r in simhash.components(simhash.links(nodes)).collect()}
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    assert {i: find(i) for i in range(len(prints)) if find(i) != i} == got


def test_top_k(spark):
    import random

    random.seed(5)
    rows = [(i, [random.gauss(0, 1) for _ in range(20)]) for i in range(0, 400, 2)]
    rows += [(1001, rows[0][1]), (1003, rows[0][1]), (401, None), (403, [1.0, None]), (405, [float("nan")] * 20), (407, [float("inf")] * 20), (50, rows[25][1]), (None, rows[0][1]), (409, [1e12] * 20), (411, [0.5] * 3), (450, [0.25] * 3)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = topk.top_k(topk.quantised(frame), F.col("vec_id") % 50 == 0, 5).collect()
    assert _sorted(got) == _sorted(brute.top_k(rows))
    assert topk.top_k(topk.quantised(frame.limit(0)), F.col("vec_id") % 50 == 0, 5).count() == 0


def test_top_k_of_repeated_ids(spark):
    """Every row but the query's own is a candidate, whatever its id."""
    rows = [(50, [1.0, 0.0]), (50, [2.0, 0.0]), (7, [1.0, 0.0]), (7, [3.0, 0.0]), (7, [3.0, 0.0]), (9, [-1.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = _sorted(topk.top_k(topk.quantised(frame), F.col("vec_id") % 50 == 0, 3).collect())
    one, u = [(7, 3 * 65536), (7, 3 * 65536), (50, 2 * 65536)], 65536
    two = [(7, 6 * u), (7, 6 * u), (7, 2 * u)]
    assert [(r[0], r[1], r[3]) for r in got] == sorted(((50, k + 1, s) for part in (one, two) for k, (_, s) in enumerate(part)), key=str)
    assert _sorted((r[2], r[3]) for r in got) == _sorted([*one, (7, 6 * u), (7, 6 * u), (7, 2 * u)]) or _sorted((r[2], r[3]) for r in got) == _sorted([*one, (7, 6 * u), (7, 6 * u), (50, 2 * u)])


def test_packing(docs, none):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokeniser_path())
    got = packing.best_fit_packing(docs, tokeniser_path(), capacity=64, with_ids=True).collect()
    want = []
    for i, t in TEXTS:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        want += [(i, k, s, len(ids[s : s + 64]), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[s : s + 64])), ids[s : s + 64]) for k, s in enumerate(range(0, len(ids), 64))]
    assert _sorted(tuple(r)[:6] for r in got) == _sorted(want)
    bins: dict = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.best_fit_packing(none, tokeniser_path()).count() == 0


@pytest.mark.parametrize("text", ["a<|endoftext|>b", "don't I'LL 're", "naïve ΣΑΣ İi ﬁ", "x\x1cy\x85z\u3000w", "e\u0301 \u0301a", "12 3a4\tb\r\nc", "日本語 テキスト", "😀!?…", "\x00\x7f"])
def test_word_tokeniser(text):
    import pyarrow as pa
    from tokenizers import Tokenizer

    ids, counts = packing.WordTokeniser(tokeniser_path()).batch(pa.array([text, "", text + " " + text]))
    whole = Tokenizer.from_file(tokeniser_path())
    want = [whole.encode(t, add_special_tokens=False).ids for t in (text, "", text + " " + text)]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_other_tokenisers_encode_whole_texts(tmp_path):
    """A tokenizer with another normaliser than the known one is not looked up word by word."""
    import json

    import pyarrow as pa
    from tokenizers import Tokenizer

    with open(tokeniser_path()) as file:
        spec = json.load(file)
    spec["normalizer"]["normalizers"].insert(2, {"type": "Replace", "pattern": {"String": "b c"}, "content": "q"})
    (tmp_path / "other.json").write_text(json.dumps(spec))
    whole, texts = Tokenizer.from_file(str(tmp_path / "other.json")), ["a b c d", "", "plain"]
    ids, counts = packing.WordTokeniser(str(tmp_path / "other.json")).batch(pa.array(texts))
    want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert packing.WordTokeniser(tokeniser_path())._by_word


def plain_best_two_fit(lengths, capacity):
    """Bins as lists of lengths, by looking at all unpacked lengths each time."""
    left, bins = sorted(lengths, reverse=True), []
    while left:
        bin_ = [left.pop(0)]
        while (fits := [x for x in left if x <= capacity - sum(bin_)]):
            bin_.append(max(fits))
            left.remove(max(fits))
        if sum(bin_) < capacity and len(bin_) > 1:
            room = capacity - sum(bin_) + bin_[-1]
            pairs = [left[i] + left[j] for i in range(len(left)) for j in range(i) if bin_[-1] < left[i] + left[j] <= room]
            if pairs:
                two = next((left[j], left[i]) for j in range(len(left)) for i in range(j + 1, len(left)) if left[i] + left[j] == max(pairs))
                left = sorted([*left, bin_.pop()], reverse=True)
                for x in two:
                    left.remove(x)
                    bin_.append(x)
        bins.append(sorted(bin_))
    return bins


def test_best_two_fit_by_brute_force():
    import numpy as np

    for seed in range(60):
        rng = np.random.default_rng(seed)
        lengths = rng.integers(1, 41, int(rng.integers(1, 40)))
        got, _ = packing.best_two_fit(lengths, 40)
        bins = [sorted(lengths[got == b].tolist()) for b in range(got.max() + 1)]
        assert bins == plain_best_two_fit(lengths.tolist(), 40)


def test_best_two_fit():
    import numpy as np

    # greedy gives 60 + 30, gap 10; 20 + 20 fill the gap of 40 that the 30 leaves
    bins, _ = packing.best_two_fit(np.array([60, 30, 20, 20]), 100)
    assert len(set(bins.tolist())) == 2 and bins[0] == bins[2] == bins[3]
    rng = np.random.default_rng(6)
    lengths = rng.integers(1, 2049, 3000)
    bins, offsets = packing.best_two_fit(lengths, 2048)
    assert np.bincount(bins, weights=lengths).max() <= 2048 and len(set(bins.tolist())) <= 1.02 * lengths.sum() / 2048 + 1


def test_sharding(spark, docs, none):
    got = sharding.histogram_sort(docs, shards=4).collect()
    assert _sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == _sorted((i, len((t or "").encode()) + 8, brute.crc(t)) for i, t in TEXTS)
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert sharding.histogram_sort(none).count() == 0
    # a third of all rows have one text: shards still have equal bytes
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same text here")).otherwise(F.repeat(F.md5(F.col("id").cast("string")), (F.col("id") % 5 + 1).cast("int"))).alias("text"))
    size = sharding.histogram_sort(rows, shards=24).groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.max("slot").alias("m")).collect()
    total = sum(r["b"] for r in size)
    assert len(size) == 24 and all(abs(r["b"] - total / 24) <= 200 and r["m"] == r["n"] - 1 for r in size)


def plain_sort(rows, shards, tolerance):
    """Shards by cutting the sorted rows where the bytes below are nearest to the target."""
    rows = sorted(rows, key=lambda r: (r["h"], r["d"], r["r"]))
    upto, total = 0, sum(r["size"] for r in rows)
    cuts = [0]
    for r in rows:
        cuts.append(cuts[-1] + r["size"])
    ideal = total / shards
    return [min(abs(c - ideal * (i + 1)) for c in cuts) + tolerance * ideal for i in range(shards - 1)], cuts


@pytest.mark.parametrize("heavy", [1 << 22, 50])
def test_sharding_by_brute_force(spark, monkeypatch, heavy):
    """Splitters against all cuts of the sorted rows; rows that repeat both id and text are split as well."""
    monkeypatch.setattr(sharding, "HEAVY_ROWS", heavy)
    rows = [(i % 7 if i % 3 else 5, "same" if i % 3 else "x" * (i % 90)) for i in range(900)] + [(None, "same")] * 300 + [(i, None) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sharding.histogram_sort(docs, shards=6).collect()
    assert _sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == _sorted((i, len((t or "").encode()) + 8, brute.crc(t)) for i, t in rows)
    sizes = [sum(r["size"] for r in got if r["shard"] == s) for s in range(6)]
    for s in range(6):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    allowed, cuts = plain_sort([r.asDict() for r in sharding.keyed(docs).collect()], 6, sharding.TOLERANCE)
    upto = [sum(sizes[: i + 1]) for i in range(5)]
    assert all(u in cuts and abs(u - cuts[-1] / 6 * (i + 1)) <= allowed[i] + 1e-6 for i, u in enumerate(upto))
    # equal texts are neighbours: no text but those at a boundary is in two shards
    assert sum(len({r["shard"] for r in got if r["text_crc32"] == c}) > 1 for c in {r["text_crc32"] for r in got}) <= 5


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.COM/en/x", "http://com/en/", "http://xcom/en/", "http://a.example.com/en/70?x", "http://a.example.com/en/7#f", "x://b.example.net/de/8", "x://b.net/de/9", "x://b.org/es/", "x://b.org/es", "x://spam-farm.example.org/en/1", "x://not-spam-farmer.org/", "x://a.com?en/", "x://Cheap-Pills.com/en/3", "x://é.net/de/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate([*urls, urls[4]])], "page_id long, url string, host string")
    got = {r["page_id"]: tuple(r)[2:] for r in url_filter.filter_urls(pages).collect()}
    assert got[0] == got[1] == got[2] == got[3] == ("", "", None, "allow", None)
    assert got[4] == ("a.com", "/en/x", "com/en/", "block", None) == got[18]
    assert [got[i][2] for i in range(5, 13)] == ["com/en/", None, "example.com/en/7", "example.com/en/7", "example.net/de/8", "net/de/", "org/es/", None]
    assert got[13][2:] == (None, "block", "spam-farm") and got[14][3] == "allow" and got[15][:2] == ("a.com", "") and got[16] == ("cheap-pills.com", "/en/3", "com/en/", "block", "cheap-pills") and got[17][2] == "net/de/"
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


def test_url_rules_by_brute_force(spark):
    """The index's answer is that of trying every rule on every url, whatever the counts that choose its tokens."""
    import random

    rng = random.Random(5)
    parts = ["spam-farm", "casino", "example", "com", "net", "org", "en", "de", "es", "7", "8", "wp-login", "x"]
    urls = ["http://" + ".".join(rng.choices(parts, k=rng.randrange(1, 4))) + "/" + "/".join(rng.choices(parts, k=rng.randrange(4))) for _ in range(400)]
    urls += ["http://a.com/" + "x/" * 50_000 + "casino", "http://casino.net/de/", "http://a.com/casino-x", "http://a.com/xcasino"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    every = (*url_filter.LISTED, *url_filter.SPAM_HOSTS)
    got = {r["page_id"]: (r["rule"], r["verdict"], r["own_rule"]) for r in url_filter.filter_urls(pages).collect()}
    for counts in ({}, {t: i for i, t in enumerate(parts)}, {t: -i for i, t in enumerate(parts)}):
        index = url_filter.RuleIndex(every, counts)
        for i, u in enumerate(urls):
            place = "".join(url_filter.split_url(u))
            fits = [r for r in every if __import__("re").search(r.pattern, place)]
            assert {r.name for r in index.fitting(place)} == {r.name for r in fits}
            listed, own = [r for r in fits if r.listed], sorted(r.name for r in fits if not r.listed)
            best = max(listed, key=lambda r: (r.size, r.name), default=None)
            assert got[i] == (best and best.name, best.verdict if best else "block" if own else "allow", own[0] if own else None)


def test_language_id(spark, docs, none):
    words = {"en": "the of and to in is", "fr": "le la les des et que", "de": "der die und das ist nicht"}
    rows = [(i, " ".join(words[lang].split()[(i * 7 + j * j) % 6] for j in range(12)), lang) for i, lang in enumerate([*words] * 40)]
    rows += [(1000, None, None), (1001, "123 !", "en"), (1002, "the and of", None)]
    known = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language_id.language_id(known, F.col("doc_id") % 5 != 0).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows[:120])
    assert got[1000]["lang_pred"] == got[1001]["lang_pred"] == "und" and got[1002]["lang_pred"] == "en" and 0 <= got[1002]["score"] <= 1
    assert {r["lang_pred"] for r in language_id.language_id(docs.withColumn("lang", F.lit(None).cast("string")), F.lit(True)).collect()} == {"und"}
    assert language_id.language_id(none, F.lit(True)).count() == 0
    one = language_id.language_id(docs, F.lit(True))
    assert {r["lang_pred"] for r in one.collect()} == {"en", "und"} and one.columns.count("score") == 1
    # from one language to another some mixture is ambiguous, a text in one language never; repeated rows are predicted each
    mixed = [(i, " ".join([words["en"]] * i + [words["fr"]] * (40 - i)), "x") for i in range(41)]
    mixed += [(i, t, s) for i, t, s in mixed if i == 20] + [(100, (words["fr"] + " ") * 3000, "x")]
    got = [(r["doc_id"], r["ambiguous"], r["score"]) for r in language_id.language_id(known, F.lit(True), spark.createDataFrame(mixed, "doc_id long, text string, score string")).collect()]
    unsure = {i for i, close, _ in got if close}
    assert len(got) == 43 and unsure and not unsure & {0, 40, 100} and all((s < 0.8 + 1e-9) == close for _, close, s in got)


def test_language_id_by_brute_force():
    """Decoding against a plain loop over codewords, ties to the first language; no language of equal codewords."""
    import numpy as np

    rng = np.random.default_rng(2)
    code = language_id.codewords(4)
    model = language_id.Model(("a", "b", "c", "d"), code, rng.normal(size=(30, code.shape[1])), rng.normal(size=code.shape[1]))
    x = np.vstack([rng.normal(size=(50, 30)), np.zeros((1, 30))])
    best, score, unsure = model.decode(x)
    for i, row in enumerate(x):
        margin = [sum(row[k] * model.weight[k, b] for k in range(30)) + model.bias[b] for b in range(code.shape[1])]
        loss = [sum(np.log1p(np.exp(-m * c)) for m, c in zip(margin, word)) for word in code]
        first, second = sorted(loss)[:2]
        assert best[i] == loss.index(min(loss)) and abs(score[i] - second / (first + second)) < 1e-9 and unsure[i] == (first > language_id.AMBIGUOUS * second)
    even = language_id.Model(("a", "b"), language_id.codewords(2), np.zeros((30, 1)), np.zeros(1))
    assert [v.tolist() for v in even.decode(np.zeros((1, 30)))] == [[0], [0.5], [True]]


def test_language_id_learns_as_plain_ecoc():
    """The learned bits against least-loss codewords found by a plain gradient descent on the same rows."""
    import numpy as np

    texts = {"en": "the of and to in is that", "fr": "le la les des et que dans", "de": "der die und das ist nicht mit"}
    lang = [k for k in texts for _ in range(20)]
    rows = [" ".join(np.random.default_rng(i).permutation(texts[k].split())[:5]) for i, k in enumerate(lang)]
    feats = np.stack([language_id.features(t) for t in rows])
    model = language_id.learned(lang, [np.rint(255 * np.sqrt(f / language_id.SCALE)).astype(np.uint8).tobytes() for f in feats])
    code, w = language_id.codewords(3), np.zeros((feats.shape[1], 3))
    y = np.stack([code[sorted(texts).index(k)] for k in lang])
    for _ in range(500):
        w += feats.T @ (y / (1 + np.exp(y * (feats @ w)))) / len(rows)
    plain = [int(np.argmin([np.log1p(np.exp(-m * c)).sum() for c in code])) for m in feats @ w]
    assert model.languages == tuple(sorted(texts)) and model.decode(feats)[0].tolist() == plain == [sorted(texts).index(k) for k in lang]


def test_codewords_differ():
    for n in (2, 3, 4, 5, 6, 12, 40):
        code = language_id.codewords(n)
        gaps = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert min(gaps) >= (2 ** (n - 2) if n <= 5 else 3)


def test_toxicity(spark, docs, none):
    rows = [(i, f"plain words number {i} of the {'idiot' if i % 4 == 0 else 'garden'} kind") for i in range(200)]
    texts = spark.createDataFrame([*rows, (500, None), (501, "")], "doc_id long, text string")
    labels = spark.createDataFrame([*((i, int(i % 4 == 0)) for i, _ in rows), (3, 1), (500, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(texts, labels, F.col("doc_id") % 5 != 0).collect()}
    assert all(got[i]["predicted"] == int(i % 4 == 0) for i, _ in rows) and got[500]["score"] == got[501]["score"]
    assert toxicity.toxicity(none, labels, F.lit(True)).count() == 0
    assert {r["predicted"] for r in toxicity.toxicity(texts, labels.limit(0), F.lit(True)).collect()} == {0}
    # repeated documents are scored each and alike, a very long text whole
    long = spark.createDataFrame([(1, "garden kind " * 40_000 + "idiot"), (1, "garden kind"), (1, "garden kind"), (2, None)], "doc_id long, text string")
    scores = [r["score"] for r in toxicity.toxicity(long, labels.limit(0), F.lit(True)).orderBy("doc_id", "score").collect()]
    assert len(scores) == 4 and len(set(scores)) == 1


def test_toxicity_by_brute_force():
    """Ratios against plain counts, the learned weights against plain gradient steps over every bucket."""
    import math

    import numpy as np

    rng = np.random.default_rng(4)
    docs = [np.unique(rng.integers(0, 40, 12)).astype(np.uint32) for _ in range(30)] + [np.empty(0, np.uint32)]
    y = [int(7 in d) for d in docs]
    r = toxicity.log_ratios(docs, np.array(y, float), 1 << toxicity.BITS)
    n = [y.count(0), y.count(1)]
    for b in (3, 7, 39, 77):
        rate = [(sum(b in d for d, k in zip(docs, y) if k == c) + toxicity.PRIOR * n[c] / len(y)) / (n[c] + toxicity.PRIOR * n[c] / len(y)) for c in (0, 1)]
        assert math.isclose(r[b], math.log(rate[1] / rate[0]), abs_tol=1e-9)
    model = toxicity.learned(docs, y)
    w, bias = np.zeros(40), 0.0
    m, v, mb, vb = np.zeros(40), np.zeros(40), 0.0, 0.0
    scaled = toxicity.SCALE * r[:40] * abs(r[:40])
    for step in range(1, toxicity.ROUNDS + 1):
        g, gb = toxicity.L2 * w, 0.0
        for d, k in zip(docs, y):
            value = np.zeros(40)
            value[d] = scaled[d] / math.sqrt(max(1, len(d)))
            share = toxicity.SHARE / n[1] if k else (1 - toxicity.SHARE) / n[0]
            err = (1 / (1 + math.exp(-(value @ w + bias))) - k) * share
            g, gb = g + err * value, gb + err
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        w = w - toxicity.RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        bias -= toxicity.RATE * (mb / (1 - 0.9**step)) / (math.sqrt(vb / (1 - 0.999**step)) + 1e-8)
    assert np.allclose(model.weight[:40], w * scaled, atol=1e-3) and abs(model.bias - bias) < 1e-3 and not model.weight[40:].any()
    assert [int(model.score(d) >= 0.5) for d in docs] == y


def test_hashes():
    text = "The quick Brown fox"
    assert simhash.fingerprint(text) == brute.fingerprint(text)
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
