"""SimHash near-duplicates by anchor points: a covering code says which fingerprints can meet."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.shared import dropped, written

SHINGLE, SEED, LIMIT = 4, 42, 4
#: Fingerprints of one anchor that are compared in one piece; anchors with more are cut in tiles that meet pairwise.
TILE = 2048
#: Up to so many fingerprints go to single anchors, about half a tile each; more go to pairs of anchors.
SINGLE = 1 << 20


def fingerprint(text: str | None) -> int:
    """64 bits, each set if more than half of the shingles' hashes have it; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # both are ASCII only on bytes
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[: len(words) - SHINGLE] + 1])
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)], "<u8")
    set_in = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_in += part.sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_in > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every whole text; fp is the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([fingerprint(t.as_py()) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(bits.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


# --- the covering code ---------------------------------------------------------------------------------------
# The 64 bits are three parts of 22, 21 and 21 bits, each a word of the perfect [23, 12] Golay code's space with the
# rest 0: 4,096 anchors a part, and every word lies within 3 bits (the covering radius) of exactly one of them.
#
# Single anchors. Of 4 differing bits some part has at most 1, so a fingerprint goes to all anchors within 3 + 1 bits
# of each part, about 16 in all; whichever anchor covers one of two linked fingerprints has the other as well.
#
# Anchor pairs. Of 4 differing bits some two parts have at most 2 together. A fingerprint goes to all pairs of
# anchors within 3 + i and 3 + j bits, i + j <= 2, about 61 for each two parts, of 16 million pairs. That keeps the
# groups small where single anchors would hold more than a tile each.

_PARTS = ((0, 22), (22, 21), (43, 21))
_GENERATOR = 0b110001110101


def _remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= _GENERATOR << (bit - 11)
    return word


@lru_cache(1)
def _golay() -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Syndromes of the low 12 and the high 11 bits; and for errors of up to 3, of 4 and of 5 bits the patterns by
    syndrome, where a syndrome's begin, and how many it has."""
    of_bit = [_remainder(1 << b) for b in range(23)]

    def table(bits: list[int]) -> np.ndarray:
        out = np.zeros(1 << len(bits), np.int64)
        for i, s in enumerate(bits):
            out[1 << i : 2 << i] = out[: 1 << i] ^ s
        return out

    low, high, errors = table(of_bit[:12]), table(of_bit[12:]), []
    for weights in (range(4), (4,), (5,)):
        words = np.array([sum(1 << b for b in chosen) for w in weights for chosen in combinations(range(23), w)], np.int64)
        syndrome = low[words & 4095] ^ high[words >> 12]
        order = np.argsort(syndrome, kind="stable")
        first = np.searchsorted(syndrome[order], np.arange(2049))
        errors.append((words[order], first[:-1], np.diff(first)))
    return low, high, errors


def _within(x: np.ndarray, excess: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The anchors at most 3 bits (excess 0), or 4 or 5 bits (1, 2), from each word: all of them, where each word's begin, how many."""
    low, high, errors = _golay()
    patterns, first, many = errors[excess]
    s = low[x & 4095] ^ high[x >> 12]
    n = many[s]
    begin = np.cumsum(n) - n
    row = np.repeat(np.arange(len(x)), n)
    return x[row] ^ patterns[first[s][row] + np.arange(len(row)) - begin[row]], begin, n


def anchors(fp: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) for every anchor, or pair of anchors, of every fingerprint; those of different parts are different numbers."""
    u = fp.view(np.uint64)
    near = []
    for shift, width in _PARTS:
        x = (u >> np.uint64(shift) & np.uint64((1 << width) - 1)).astype(np.int64)
        near.append([_within(x, e) for e in range(3 if pairs else 2)])
    rows, keys = [], []
    if not pairs:
        for part, found in enumerate(near):
            for anchor, _, n in found:
                rows.append(np.repeat(np.arange(len(fp)), n))
                keys.append(anchor | part << 23)
        return np.concatenate(rows), np.concatenate(keys)
    for number, (p, q) in enumerate(((0, 1), (0, 2), (1, 2))):
        for i in range(3):
            for j in range(3 - i):
                (a, a_begin, a_n), (b, b_begin, b_n) = near[p][i], near[q][j]
                n = a_n * b_n
                row = np.repeat(np.arange(len(fp)), n)
                step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                rows.append(row)
                keys.append(a[a_begin[row] + step // b_n[row]] | b[b_begin[row] + step % b_n[row]] << 23 | number << 46)
    return np.concatenate(rows), np.concatenate(keys)


def _replicated(prints: DataFrame, pairs: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = 5_000 if pairs else 20_000
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                fp = part.column("fp").to_numpy(zero_copy_only=False)
                row, key = anchors(np.ascontiguousarray(fp), pairs)
                node = part.column("node").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row]), pa.array(node[row])], ["anchor", "fp", "node"])

    return prints.select("fp", "node").mapInArrow(run, "anchor long, fp long, node long")


def _spanning(fp: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all that is linked among these fingerprints: every link if few, else a star a component."""
    n, us, vs, budget = len(fp), [], [], 8 * len(fp)
    for at in range(0, n, 512):
        near = np.bitwise_count(fp[at : at + 512, None] ^ fp[None, at:]) <= LIMIT
        i, j = np.nonzero(np.triu(near, 1))
        budget -= len(i)
        if budget < 0:
            break
        us.append(node[at + i])
        vs.append(node[at + j])
    else:
        return np.concatenate(us), np.concatenate(vs)
    us, vs, left = [], [], np.arange(n)
    while len(left):
        front, root, left = left[:1], left[0], left[1:]
        while len(front) and len(left):
            head, front = front[:64], front[64:]
            hit = (np.bitwise_count(fp[head, None] ^ fp[None, left]) <= LIMIT).any(0)
            new = left[hit]
            if len(new):
                left, front = left[~hit], np.concatenate([front, new])
                us.append(node[new])
                vs.append(np.full(len(new), node[root]))
    return (np.concatenate(us), np.concatenate(vs)) if us else (node[:0], node[:0])


def links(prints: DataFrame) -> DataFrame:
    """(u, v), u > v: links between nodes of (fp, node) that connect whatever lies within LIMIT bits.

    Compared anchor by anchor. Anchors that hold more than TILE fingerprints are cut into tiles by a hash,
    and every two tiles meet in a group of their own, so a group is bounded whatever is near to what.
    """
    pairs = prints.count() > SINGLE
    near = written(_replicated(prints, pairs), "simhash-anchors")
    tiles = near.groupBy("anchor").count().where(F.col("count") > TILE).select("anchor", F.ceil(F.col("count") / TILE).cast("int").alias("tiles"))
    # single anchors are 12,288; of the pairs any number may be crowded, so their table is not sent around unasked
    cut = near.join(tiles if pairs else F.broadcast(tiles), "anchor", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    cut = cut.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    keyed = cut.select("anchor", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp", "node")
    dealt = keyed.repartition("anchor", "lo", "hi").sortWithinPartitions("anchor", "lo", "hi", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            cols = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("anchor", "lo", "hi", "fp", "node")])
            held.append(cols)
            cols = np.concatenate(held, 1)
            last = int(np.flatnonzero((cols[:3] != cols[:3, -1:]).any(0)).max(initial=-1)) + 1
            if last:
                yield _grouped(cols[:, :last])
            held = [cols[:, last:]]
        if held and held[0].shape[1]:
            yield _grouped(np.concatenate(held, 1))

    found = dealt.mapInArrow(run, "u long, v long").where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    out = written(found, "simhash-links", narrow=True)
    dropped(near)
    return out


def _grouped(cols: np.ndarray) -> pa.RecordBatch:
    """The links of whole groups that stand one after the other."""
    fp, node = cols[3].view(np.uint64), cols[4]
    begin = np.flatnonzero(np.concatenate([[True], (cols[:3, 1:] != cols[:3, :-1]).any(0)]))
    size = np.diff(np.append(begin, cols.shape[1]))
    us, vs = [], []
    small = size <= 24
    # small groups all at once: each row against the next, the one after, ... of its group
    at = np.concatenate([np.arange(b, b + n) for b, n in zip(begin[small], size[small])]) if small.any() else np.empty(0, np.int64)
    group = np.repeat(np.flatnonzero(small), size[small])
    for step in range(1, 24):
        if len(at) <= step:
            break
        same = group[step:] == group[:-step]
        i, j = at[:-step][same], at[step:][same]
        if not len(i):
            break
        near = np.bitwise_count(fp[i] ^ fp[j]) <= LIMIT
        us.append(node[i[near]])
        vs.append(node[j[near]])
    for b, n in zip(begin[~small].tolist(), size[~small].tolist(), strict=True):
        u, v = _spanning(fp[b : b + n], node[b : b + n])
        us.append(u)
        vs.append(v)
    both = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (us, vs)]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in both], ["u", "v"])


def _smallest(edges: DataFrame) -> DataFrame:
    return written(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "simhash-min", narrow=True)


def components(edges: DataFrame) -> DataFrame:
    """(u, v): each node but the smallest of its component, and the smallest.

    Large-star and small-star steps until nothing changes. Minima are aggregated before they are shuffled, and
    a hub meets its minimum in a join that splits its rows, so no neighbourhood is gathered anywhere.
    """
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _smallest(both)
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "simhash-large", narrow=True)
        dropped(edges, least)
        least = _smallest(large)
        low = large.join(least, "u")
        small = low.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = written(small.where("u > v").distinct(), "simhash-small", narrow=True)
        dropped(large, least)
        # steps keep what is connected, so they are done when every node has one link and no link's end has any
        ends = edges.groupBy("u").agg(F.count("*").alias("n"))
        more = edges.select(F.col("v").alias("u")).distinct().join(ends, "u", "left_semi").select(F.lit(2).cast("long").alias("n"))
        if ends.select("n").unionByName(more).where("n > 1").isEmpty():
            return edges


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document of (doc_id, text).

    Fingerprints within 4 bits are linked, and component_id is the smallest doc_id that can be reached. Null,
    empty and wordless texts have fingerprint zero, which is linked like any other. Rows that repeat a doc_id
    are one document; a null doc_id joins its fingerprint's component, and is null if there is no other. An
    empty table gives an empty result; other columns are ignored.
    """
    prints = written(fingerprints(docs), "simhash-prints")
    nodes = written(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), "simhash-nodes", narrow=True)
    roots = components(links(nodes))
    # a document that several fingerprints share through a repeated id links them
    named = written(nodes.join(roots.select(F.col("u").alias("node"), "v"), "node", "left").select("fp", F.coalesce("v", "node").alias("component_id")), "simhash-named", narrow=True)
    dropped(nodes, roots)
    found = prints.join(named, "fp", "left")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_each(docs: DataFrame) -> DataFrame:
    """One row of each component of linked fingerprints: that with the smallest doc_id, a null one after every id.

    Each row is judged by its own text. Rows that share a doc_id but not a component are all kept, and a row with a
    null doc_id goes only if another row resembles it. Rows with equal ids in one component leave one, by a hash of
    the text and then by place. Null, empty and wordless texts are one component. An empty table gives an empty
    result; any other column may stand beside.
    """

    @F.arrow_udf("long")
    def of_text(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t.as_py()) for t in texts], np.uint64).view(np.int64))

    # the columns of a row as one, so that no name of theirs meets a helper's; rows are numbered once and written: a
    # second evaluation might deal the numbers anew
    text = F.col("text").cast("string")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), of_text(text).alias("fp"), F.monotonically_increasing_id().alias("row"))
    rows = written(rows, "simhash-rows")
    doc_id = F.col("doc.doc_id").cast("long")
    place = F.struct(doc_id.isNull().alias("last"), doc_id.alias("id"), F.xxhash64(F.col("doc.text").cast("string")).alias("text"), "row")
    first = written(rows.select("fp", place.alias("first")).groupBy("fp").agg(F.min("first").alias("first")), "simhash-first", narrow=True)
    # a fingerprint is its own node, so ids link nothing
    roots = components(links(first.select("fp", F.col("fp").alias("node"))))
    named = first.join(roots.select(F.col("u").alias("fp"), "v"), "fp", "left").select(F.coalesce("v", "fp").alias("root"), "first")
    keep = named.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias("row"))
    return rows.join(keep, "row", "left_semi").select(*[F.col(f"doc.`{c}`") for c in docs.columns])
