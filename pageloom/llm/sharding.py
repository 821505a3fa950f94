"""Histogram sort: documents into shards of near equal bytes, by splitters found with exact counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.shared import written

#: Bits that one round of probes adds to every open splitter: 4,096 candidate boundaries each.
STEP = 12
#: Cells with more rows than this, or than a 128th of all, are divided further, so that no key makes one large task.
HEAVY_ROWS, HEAVY_SHARE = 1 << 22, 1 / 128
#: How far a splitter may lie from its target, as a part of one shard's bytes. Rows are never cut.
TOLERANCE = 1e-4


@dataclass
class _Open:
    """A splitter still being refined: inside the keys with this prefix lie `before` bytes below and the target."""

    target: float
    prefix: tuple[int, ...] = ()
    before: int = 0
    found: tuple | None = None


#: The sort key's words: a hash of the text, the id, the row's number. All rows have different keys.
WORDS = ("h", "d", "r")


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, h, d, r).

    Equal texts are neighbours in this order, and a text with any number of copies can still be cut between
    two ids, and an id with any number of rows between two rows.
    """
    text = F.col("text").cast("string")
    raw = F.coalesce(text, F.lit("")).cast("binary")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.xxhash64(raw).alias("h"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("d"),
        F.monotonically_increasing_id().alias("r"),
    )


#: 64 bits are five groups of 12 and one of 4.
DIGITS = 6
LEVELS = DIGITS * len(WORDS)


def _digit(level: int) -> Column:
    """The level-th group of bits of the key, most significant first. Signed order is kept by the top bit."""
    word, low = F.col(WORDS[level // DIGITS]), (level % DIGITS) * STEP
    shift, width = max(0, 64 - low - STEP), min(STEP, 64 - low)
    flipped = word.bitwiseXOR(F.lit(-(2**63))) if low == 0 else word
    return F.shiftrightunsigned(flipped, shift).bitwiseAND(F.lit((1 << width) - 1))


def _prefix(level: int) -> Column:
    return F.array(*[_digit(i) for i in range(level)]) if level else F.array().cast("array<bigint>")


def _digits(key: tuple[int, ...]) -> list[int]:
    """A key's groups of bits, as _digit() has them."""
    out = []
    for word in key:
        u = word % 2**64 ^ 2**63
        out += [u >> max(0, 64 - at - STEP) & ((1 << min(STEP, 64 - at)) - 1) for at in range(0, 64, STEP)]
    return out


def _shared(lo: tuple[int, ...], hi: tuple[int, ...]) -> tuple[int, ...]:
    """The groups of bits that all keys from lo to hi have in common, but for the last group."""
    a, b = _digits(lo), _digits(hi)
    same = next((i for i in range(LEVELS) if a[i] != b[i]), LEVELS - 1)
    return tuple(a[:same])


def _inside(prefixes: set[tuple[int, ...]]) -> Column:
    """Whether a key has one of these prefixes, all of one length."""
    return _prefix(len(next(iter(prefixes)))).isin([F.array(*[F.lit(x).cast("bigint") for x in p]) for p in sorted(prefixes)])


def _counted(keys: DataFrame, prefixes: set[tuple[int, ...]]) -> DataFrame:
    """(p, g, b, n, lo, hi): the bytes, rows and ends of the cells under each prefix, by its next group of bits."""
    of = F.lit(None)
    for n in sorted({len(p) for p in prefixes}):
        own = F.struct(_prefix(n).alias("p"), _digit(n).alias("g"))
        of = F.when(_inside({p for p in prefixes if len(p) == n}), own).otherwise(of) if n else own
    ends = F.struct(*WORDS)
    return keys.select(of.alias("c"), "size", *WORDS).where("c is not null").groupBy("c.p", "c.g").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.min(ends).alias("lo"), F.max(ends).alias("hi"))


def splitters(keys: DataFrame, shards: int, total: tuple[int, int], tolerance: float = TOLERANCE) -> list[tuple[int, ...]]:
    """The first key of each shard but shard 0, for keys of (bytes, rows) in all.

    A round counts, over all partitions, the exact bytes under every candidate boundary inside the prefixes
    that hold an unsettled target: at most 4,096 counts a splitter come back. Bits that all keys of a prefix share
    need no round.
    """
    if not total[1]:
        return [(2**63 - 1,) * len(WORDS)] * (shards - 1)
    ideal = total[0] / shards
    state = [_Open(target=ideal * (i + 1)) for i in range(shards - 1)]
    while active := {s.prefix for s in state if s.found is None}:
        by_prefix: dict[tuple, list] = {}
        for r in _counted(keys, active).collect():
            by_prefix.setdefault(tuple(r["p"]), []).append(r)
        for inside in by_prefix.values():
            inside.sort(key=lambda r: r["g"])
        for s in (s for s in state if s.found is None):
            below = s.before
            for r in by_prefix[s.prefix]:
                if below + r["b"] >= s.target:
                    ends = {below: tuple(r["lo"]), below + r["b"]: None}
                    near = min(ends, key=lambda x: abs(x - s.target))
                    if r["n"] == 1 or abs(near - s.target) <= tolerance * ideal:
                        # a boundary after this cell is the next key there is: one past the last key here
                        s.found = ends[near] or _after(tuple(r["hi"]))
                    else:
                        s.prefix, s.before = _shared(tuple(r["lo"]), tuple(r["hi"])), below
                    break
                below += r["b"]
    return [s.found for s in state]


def _after(key: tuple[int, ...]) -> tuple[int, ...]:
    return (*key[:-1], key[-1] + 1)  # a row's number is far from the end of its range


def _at_or_above(key: tuple[int, ...]) -> Column:
    out = F.lit(True)
    for name, value in reversed(list(zip(WORDS, key, strict=True))):
        out = (F.col(name) > F.lit(value)) | ((F.col(name) == F.lit(value)) & out)
    return out


def cells(keys: DataFrame, n: int) -> Column:
    """The cell of each key: its first digits, as many as make cells of bounded size, and more inside crowded ones.

    Hashes spread evenly, so only keys with many copies crowd a cell. Crowded cells come to the driver: each holds at
    least a 128th of all rows, or HEAVY_ROWS.
    """
    depth = 1
    while n > HEAVY_ROWS / 4 * 4096**depth:
        depth += 1
    limit = max(1, min(HEAVY_ROWS, HEAVY_SHARE * n))
    cell, ends = _prefix(depth), F.struct(*WORDS)
    counted = keys.groupBy(_prefix(depth).alias("p")).agg(F.count("*").alias("n"), F.min(ends).alias("lo"), F.max(ends).alias("hi"))
    while True:
        crowded: dict[int, set] = {}
        for r in counted.where(F.col("n") > limit).collect():
            prefix = _shared(tuple(r["lo"]), tuple(r["hi"]))
            crowded.setdefault(len(prefix), set()).add(prefix)
        if not crowded:
            return cell
        for length, prefixes in sorted(crowded.items()):
            cell = F.when(_inside(prefixes), _prefix(length + 1)).otherwise(cell)
        counted = _counted(keys, set().union(*crowded.values()))


def histogram_sort(docs: DataFrame, shards: int = 24, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): shards of near equal bytes, in key order, slots gapless from 0.

    Size is the text's UTF-8 bytes (null: none) plus 8. Shards differ by the tolerance or one row, also where rows
    repeat id and text. An empty table gives an empty result, a null doc_id sorts first among its text's copies, other
    columns are ignored. Rows are exchanged once, by counted cells of the key space, so a shard is not one task and
    slots need no second pass.
    """
    # written once: a second evaluation might deal the rows' numbers anew
    keys = written(keyed(docs), "shard-keys")
    total = keys.agg(F.sum("size").alias("b"), F.count("*").alias("n")).first()
    shard = F.lit(0)
    for b in splitters(keys, shards, (total["b"] or 0, total["n"]), tolerance):
        shard = shard + _at_or_above(b).cast("int")
    placed = keys.withColumn("shard", shard).withColumn("cell", cells(keys, total["n"]))
    counts = placed.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("shard", "cell", F.coalesce(before, F.lit(0)).alias("before"))
    order = Window.partitionBy("shard", "cell").orderBy(*WORDS)
    ranked = placed.withColumn("i", F.row_number().over(order))
    slots = ranked.join(starts, ["shard", "cell"])
    return slots.select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("i") - 1).cast("long").alias("slot"))
