"""Substring dedup: an FM-index per shard gives matching statistics for streamed documents.

A window of 13 words is routed by its minimizer, the smallest hash of the 6-word runs in it, so equal windows meet
in one shard and a document goes only where its words can match. Consecutive windows with one minimizer travel as a
segment, with its words. A first exchange of 32-bit minimizer hashes leaves at home what stands in one document only;
a second brings the remaining segments to their shards, equal ones of a chunk of documents as one.

A shard halves its documents by id, again and again: the half with the smaller ids is the reference, the other half
is streamed. The reference is the text of an FM-index (suffixes sorted by 13 words, their Burrows-Wheeler transform
in a wavelet matrix, a bit a position for the 12-word intervals); every streamed segment is searched backwards for
its matching statistics, the longest match that ends at each word, and a window is repeated where that reaches 13.
Each two documents of a shard are on different sides exactly once. Hashes route and group; words decide.

A minimizer of many chunks is split: its windows travel one by one, by a hash of all their words, and first meet
within groups of chunks, which send on only what is new in the group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.shared import released, written

WINDOW, GRAM = 13, 6
#: UTF-8 bytes of a chunk of documents and, about, of the text behind a shard.
CHUNK_BYTES, SHARD_BYTES = 2 << 20, 16 << 20
#: A segment has at most so many windows. A minimizer in more than so many chunks is split, in groups of so many.
SEGMENT, HEAVY, GROUP = 64, 256, 1024
_NOBODY = np.iinfo(np.int64).max

_rng = np.random.default_rng(20)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_MULTIPLIERS = _rng.integers(1, 2**63, GRAM, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        steps = np.full(max(n, 1024), base, np.uint64)
        steps[0] = 1
        known = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return known[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _spans(values: np.ndarray, begin: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """A hash of each values[begin:end], the same wherever the span stands."""
    upto = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power(base, len(values)), out=upto[1:])
    return _mix((upto[end] - upto[begin]) * _power(pow(base, -1, 2**64), len(values) + 1)[begin] + (end - begin).astype(np.uint64))


def _flat(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (size[0] of them), begin[1], ..."""
    return np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)


def _words(size: np.ndarray, letters: np.ndarray) -> pa.Array:
    """The words that stand one after the other in `letters`, of these sizes."""
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(letters))])


def _letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, letters) of words."""
    ends = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, 8 * words.offset) if len(words) else np.zeros(1, np.int64)
    data = words.buffers()[2]
    return np.diff(ends), np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and len(words) else np.empty(0, np.uint8)


class Chunk:
    """Some documents: codes and hashes of their words, their windows, and the segments of windows with one minimizer."""

    def __init__(self, texts: list[bytes], doc_ids: np.ndarray):
        self.doc_ids = doc_ids
        raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        space = _SPACE[raw]
        edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
        begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        coded = _words(end - begin, raw[~space]).dictionary_encode()
        self.code, self.vocabulary = np.asarray(coded.indices), coded.dictionary
        size, letters = _letters(self.vocabulary)
        first = np.cumsum(size) - size
        within = np.arange(len(letters)) - np.repeat(first, size)
        value = _BYTE[letters] * _power(_BASE, int(size.max(initial=0)))[within]
        hashes = _mix(np.add.reduceat(value, first) + size.astype(np.uint64)) if len(first) else np.empty(0, np.uint64)
        self.word = hashes[self.code]
        upto = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        self.n_words = np.diff(np.searchsorted(begin, np.concatenate([[0], upto])))
        self.first_word = np.cumsum(self.n_words) - self.n_words
        self._segments()

    def _segments(self) -> None:
        h, n = self.word, len(self.word)
        many = np.maximum(self.n_words - WINDOW + 1, 0)
        doc = np.repeat(np.arange(len(many)), many)
        self.window = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many) + self.first_word[doc]
        if not len(doc):
            self.first = self.start = self.count = self.doc = self.like = np.empty(0, np.int64)
            self.minimizer = np.empty(0, np.uint64)
            return
        g = np.zeros(n - GRAM + 1, np.uint64)
        for j in range(GRAM):
            g += h[j : n - GRAM + 1 + j] * _MULTIPLIERS[j]
        low, have = _mix(g), 1
        while have < WINDOW - GRAM + 1:
            step = min(have, WINDOW - GRAM + 1 - have)
            low = np.minimum(low[:-step], low[step:])
            have += step
        low = low[self.window]
        begin = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])]))
        size = np.diff(np.append(begin, len(doc)))
        pieces = -(-size // SEGMENT)
        part = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        #: the first window of each segment, its first word, its number of windows, its document
        self.first = np.repeat(begin, pieces) + SEGMENT * part
        self.count = np.minimum(np.repeat(size, pieces) - SEGMENT * part, SEGMENT)
        self.start, self.doc, self.minimizer = self.window[self.first], doc[self.first], low[self.first]
        self.like = self._equal()

    def _equal(self) -> np.ndarray:
        """For each segment the one with the same words, first by document id and then by place, that stands for it."""
        size = self.count + WINDOW - 1
        content = _spans(self.word, self.start, self.start + size, _WORD_BASE)
        order = np.lexsort((np.arange(len(content)), self.doc_ids[self.doc], content))
        new = np.concatenate([[True], content[order][1:] != content[order][:-1]])
        like = np.empty(len(content), np.int64)
        like[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
        # the hash proposes, the words decide: what differs stands for itself
        other = np.flatnonzero(like != np.arange(len(like)))
        same = size[other] == size[like[other]]
        like[other[~same]] = other[~same]
        other = other[same]
        if len(other):
            differs = self.code[_flat(self.start[other], size[other])] != self.code[_flat(self.start[like[other]], size[other])]
            wrong = np.add.reduceat(differs.astype(np.int64), np.cumsum(size[other]) - size[other]) > 0
            like[other[wrong]] = other[wrong]
        return like


def _seal(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *(a.nbytes for a in arrays)], np.int64)
    return zstandard.ZstdCompressor(1).compress(b"".join([head.tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)]))


def _open(blob: bytes, *kinds) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    out, at = [], 8 * (n + 1)
    for size, kind in zip(np.frombuffer(raw, np.int64, n, 8).tolist(), kinds, strict=True):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def _bucket(minimizer: np.ndarray, buckets: int) -> np.ndarray:
    return ((minimizer >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


# --- chunks ---------------------------------------------------------------------------------------------------


def _chunks(docs: DataFrame, size: int) -> DataFrame:
    """(chunk, n_bytes, rows): docs in pieces of about `size` bytes of text; rows is a compressed Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            upto = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0), np.int64))
            at = 0
            while at < batch.num_rows:
                floor = int(upto[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(upto, floor + size, "right")))
                sink = pa.BufferOutputStream()
                part = pa.RecordBatch.from_arrays(batch.columns, names=batch.schema.names).slice(at, to - at)
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(part)
                rows = sink.getvalue().to_pybytes()
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([int(upto[to - 1]) - floor]), pa.array([rows], pa.binary())], ["chunk", "n_bytes", "rows"])
                number, at = number + 1, to

    return docs.mapInArrow(run, "chunk long, n_bytes long, rows binary")


def _unpacked(rows: bytes) -> tuple[pa.RecordBatch, list[bytes], np.ndarray]:
    batch = pa.ipc.open_stream(rows).read_next_batch()
    texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
    ids = np.array([_NOBODY if i is None else i for i in batch.column("doc_id").cast(pa.int64()).to_pylist()], np.int64)
    return batch, texts, ids


def _chunk(rows: bytes) -> Chunk:
    return Chunk(*_unpacked(rows)[1:])


# --- first exchange: which minimizers stand in more than one document ---------------------------------------


def _sent(chunk: Chunk, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different minimizers in order of (bucket, value), each one's bucket, and whether two documents have it."""
    order = np.lexsort((chunk.doc, chunk.minimizer, _bucket(chunk.minimizer, buckets)))
    m, d = chunk.minimizer[order], chunk.doc[order]
    begin = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]])) if len(m) else np.empty(0, np.int64)
    last = np.append(begin[1:], len(m)) - 1 if len(m) else begin
    return m[begin], _bucket(m[begin], buckets), d[begin] != d[last]


def _announce(buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, rows in zip(batch.column("chunk").to_pylist(), batch.column("rows"), strict=True):
                m, b, twice = _sent(_chunk(rows.as_py()), buckets)
                begin = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else np.empty(0, np.int64)
                end = np.append(begin[1:], len(b)) if len(b) else begin
                blobs = [_raw(m[x:y].astype(np.uint32), np.packbits(twice[x:y])) for x, y in zip(begin.tolist(), end.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(b[begin]), pa.array([number] * len(begin), pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "chunk", "blob"])

    return run


def _raw(values: np.ndarray, bits: np.ndarray) -> bytes:
    return len(values).to_bytes(8, "little") + values.tobytes() + bits.tobytes()


def _answer(limit: int) -> Callable:
    """For each chunk that sent minimizers to a bucket: a bit each, set if another document has it as well, and a bit
    each, set if more than `limit` chunks have it (null if none is)."""

    def run(group: pa.Table) -> pa.Table:
        blobs = group.column("blob").to_pylist()
        sizes = [int.from_bytes(x[:8], "little") for x in blobs]
        value = np.concatenate([np.frombuffer(x, np.uint32, n, 8) for x, n in zip(blobs, sizes, strict=True)])
        twice = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8, offset=8 + 4 * n), count=n) for x, n in zip(blobs, sizes, strict=True)]).astype(bool)
        order = np.argsort(value, kind="stable")
        s = value[order]
        begin = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.empty(0, np.int64)
        many = np.diff(np.append(begin, len(s)))
        chunks = np.empty(len(s), np.int64)
        chunks[order] = np.repeat(many, many)
        again, heavy = (chunks > 1) | twice, chunks > limit
        cut = np.cumsum([0, *sizes])
        bits = [np.packbits(again[a:b]).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
        split = [np.packbits(heavy[a:b]).tobytes() if heavy[a:b].any() else None for a, b in zip(cut[:-1], cut[1:], strict=True)]
        return pa.table({"chunk": group.column("chunk").cast(pa.int64()), "bucket": group.column("bucket").cast(pa.int64()), "bits": pa.array(bits, pa.binary()), "heavy": pa.array(split, pa.binary())})

    return run


# --- second exchange: segments to their shards ----------------------------------------------------------------


def _wanted(chunk: Chunk, answers: pa.Table, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The segments that travel, one of each content: those that travel whole, and those that are split."""
    m, b, _ = _sent(chunk, buckets)
    again, heavy = np.zeros(len(m), bool), np.zeros(len(m), bool)
    for bucket, bits, split in zip(*(answers.column(c).to_pylist() for c in ("bucket", "bits", "heavy")), strict=True):
        x, y = np.searchsorted(b, [bucket, bucket + 1])
        again[x:y] = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(y - x)).astype(bool)
        if split is not None:
            heavy[x:y] = np.unpackbits(np.frombuffer(split, np.uint8), count=int(y - x)).astype(bool)
    own = chunk.like == np.arange(len(chunk.like))
    split = np.isin(chunk.minimizer, m[heavy])
    return np.flatnonzero(own & np.isin(chunk.minimizer, m[again & ~heavy])), np.flatnonzero(own & split)


def _packed(code: np.ndarray, vocabulary: pa.Array, first: np.ndarray, owner: np.ndarray, key: np.ndarray, begin: np.ndarray, count: np.ndarray) -> bytes:
    """Segments as bytes: each one's first window, owner, group and number of windows; the different words; the words' codes."""
    used, codes = np.unique(code[_flat(begin, count + WINDOW - 1)], return_inverse=True)
    size, letters = _letters(vocabulary.take(pa.array(used)))
    codes = codes.astype(np.uint16 if len(used) <= 1 << 16 else np.uint32)
    return _seal(first.astype(np.uint32), owner, key.astype(np.uint32), count.astype(np.uint8), size.astype(np.uint32), letters, np.array([codes.itemsize], np.uint8), codes.view(np.uint8))


def _unpack(blob: bytes) -> tuple:
    first, owner, key, count, size, letters, width, codes = _open(blob, np.uint32, np.int64, np.uint32, np.uint8, np.uint32, np.uint8, np.uint8, np.uint8)
    return first, owner, key, count.astype(np.int64), size.astype(np.int64), letters, codes.view(np.uint16 if width[0] == 2 else np.uint32)


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(shard, kind="stable")
    begin = np.flatnonzero(np.concatenate([[True], np.diff(shard[order]) != 0])) if len(order) else order
    for x, y in zip(begin.tolist(), [*begin[1:].tolist(), len(order)], strict=False):
        yield int(shard[order[x]]), order[x:y]


def _segments(buckets: int, groups: int) -> Callable:
    """Shards 0 .. buckets - 1 are by minimizer, or by window for split ones; above lie their shards a group of chunks."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, bytes]] = []
        for number, rows in zip(left.column("chunk").to_pylist(), left.column("rows"), strict=True):
            chunk = _chunk(rows.as_py())
            whole, split = _wanted(chunk, right, buckets)
            alone = _flat(chunk.first[split], chunk.count[split])
            key = _spans(chunk.word, chunk.window[alone], chunk.window[alone] + WINDOW, _WORD_BASE)
            first, begin = np.concatenate([chunk.first[whole], alone]), np.concatenate([chunk.start[whole], chunk.window[alone]])
            owner = chunk.doc_ids[chunk.doc[np.concatenate([whole, np.repeat(split, chunk.count[split])])]]
            count = np.concatenate([chunk.count[whole], np.ones(len(alone), np.int64)])
            key = np.concatenate([chunk.minimizer[whole], key])
            shard = _bucket(key, buckets)
            if groups > 1:
                shard[len(whole) :] = buckets + shard[len(whole) :] * groups + (number * 0x9E3779B97F4A7C15 >> 32) % 2**32 % groups
            for to, mine in _by_shard(shard):
                out.append((to, number, _packed(chunk.code, chunk.vocabulary, first[mine], owner[mine], key[mine], begin[mine], count[mine])))
        released()
        shard, number, blob = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"shard": pa.array(shard, pa.int64()), "chunk": pa.array(number, pa.int64()), "blob": pa.array(blob, pa.binary())})

    return run


# --- the index ------------------------------------------------------------------------------------------------


class Bits:
    """A sequence of bits with the number of ones before every 64th."""

    def __init__(self, bit: np.ndarray):
        self.n = len(bit)
        padded = np.zeros((len(bit) // 64 + 1) * 64, bool)
        padded[: len(bit)] = bit
        self._bits = np.packbits(padded, bitorder="little").view("<u8")
        ones = np.cumsum(np.bitwise_count(self._bits), dtype=np.int64)
        self.ones = int(ones[-1])
        self._counts = np.concatenate([[0], ones]).astype(np.int32 if len(bit) < 2**31 else np.int64)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many ones stand before each position."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self._counts[word] + np.bitwise_count(self._bits[word] & mask)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Where the k-th one stands, from 0; the end if there are no more."""
        inside = np.minimum(k, max(self.ones - 1, 0))
        word = np.searchsorted(self._counts, inside, "right") - 1
        left, bits, at = inside - self._counts[word], self._bits[np.minimum(word, len(self._bits) - 1)], np.zeros(len(k), np.uint64)
        for step in (32, 16, 8, 4, 2, 1):
            low = np.bitwise_count(bits >> at & np.uint64((1 << step) - 1)).astype(np.int64)
            up = left >= low
            left, at = np.where(up, left - low, left), np.where(up, at + np.uint64(step), at)
        return np.where(k < self.ones, (word << 6) + at.astype(np.int64), self.n)


class WaveletMatrix:
    """Ranks of symbols in a sequence, a bit a level and symbol."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.n, current = len(symbols), symbols
        self._bits, self._zeros = [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (current >> level & 1).astype(bool)
            self._bits.append(Bits(bit))
            self._zeros.append(len(bit) - int(bit.sum()))
            current = np.concatenate([current[~bit], current[bit]])
        # where each symbol's block begins on the last level
        self._base = self._down(np.arange(sigma), np.zeros(sigma, np.int64)).astype(np.int32 if self.n < 2**31 else np.int64)

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            ones = self._bits[k].rank(at)
            at = np.where((symbol >> (self.levels - 1 - k) & 1).astype(bool), self._zeros[k] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its position."""
        return self._down(symbol, at) - self._base[symbol]


def _pairs(a: np.ndarray, step: int) -> np.ndarray:
    """Dense ranks of (a[i], a[i + step]); past the end stands the smallest rank."""
    after = np.zeros(len(a), np.uint64)
    after[: max(0, len(a) - step)] = a[step:].astype(np.uint64)
    return np.unique(a.astype(np.uint64) << np.uint64(32) | after, return_inverse=True)[1].astype(np.int64)


class FMIndex:
    """Backward search in a text of symbols: its transform in a wavelet matrix, and a bit where a new 12-symbol prefix begins."""

    def __init__(self, text: np.ndarray, sigma: int):
        """text: segments of symbols 1 .. sigma - 1, a 0 after each."""
        rank, have = text, 1
        while 2 * have < WINDOW - 1:
            rank, have = _pairs(rank, have), 2 * have
        short = _pairs(rank, WINDOW - 1 - have)
        order = np.argsort(_pairs(rank, WINDOW - have), kind="stable")
        self.n, self._bwt = len(text), WaveletMatrix(text[order - 1], sigma)
        self._before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])[:-1]
        short = short[order]
        self._short = Bits(np.concatenate([[True], short[1:] != short[:-1]]))

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the matches with a symbol put before them."""
        both = self._bwt.rank(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        base = self._before[symbol]
        return base + both[: len(lo)], base + both[len(lo) :]

    def shortened(self, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the first 12 symbols of matches of 13."""
        k = self._short.rank(lo + 1)
        return self._short.select(k - 1), self._short.select(k)

    def matching_statistics(self, codes: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """For each place of each streamed segment codes[begin:begin+size], one after the other: the length, at most
        13, of the longest match that ends there; 0 where no window can end. Symbols below 0 match nothing.

        All segments step together from their last symbols to their first. A match of 13 drops its last symbol and goes
        on; one that can't be extended gives its length, and the search starts over one place before its end.
        """
        out = np.zeros(int(size.sum()), np.int8)
        base = np.cumsum(size) - size - begin  # where a place's result stands
        lane = np.flatnonzero(size >= WINDOW)
        at = begin[lane] + size[lane] - 1  # the next symbol to put before the match
        length, lo, hi = np.zeros(len(lane), np.int64), np.zeros(len(lane), np.int64), np.full(len(lane), self.n)
        while len(lane):
            symbol = codes[at]
            known = symbol >= 0
            new_lo, new_hi = self.extend(np.where(known, symbol, 0), lo, hi)
            good = known & (new_hi > new_lo)
            end = at + length  # the last place of the match
            lo, hi, length = np.where(good, new_lo, 0), np.where(good, new_hi, self.n), np.where(good, length + 1, length)
            done = good & ((length == WINDOW) | (at == begin[lane]))
            out[base[lane[done]] + end[done]] = length[done]
            bad = ~good
            out[base[lane[bad]] + end[bad]] = length[bad]
            at = np.where(good, at - 1, np.where(length > 0, end - 1, at - 1))
            length = np.where(good, length, 0)
            full = np.flatnonzero(length == WINDOW)
            lo[full], hi[full] = self.shortened(lo[full])
            length[full] = WINDOW - 1
            # the match ends at `at + length`; a window that ends there needs 12 places before it
            live = (at >= begin[lane]) & (at + length - begin[lane] >= WINDOW - 1)
            lane, at, length, lo, hi = lane[live], at[live], length[live], lo[live], hi[live]
        return out


def repeated(codes: np.ndarray, begin: np.ndarray, count: np.ndarray, owner: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which windows of the segments (windows in order, segments one after the other) also start in a smaller owner's segment.

    Segments with a window in common have the same key. Owners are halved bit by bit of their rank: the smaller half of
    each node is indexed and the other streamed, where they share a key. A window that is found is done, for whoever
    has it on the streamed side, so only segments with other windows go on. Nodes of a level share one index, each
    with symbols of its own.
    """
    size = count + WINDOW - 1
    first = np.cumsum(count) - count
    found = np.zeros(int(count.sum()), bool)
    ranks = np.unique(owner, return_inverse=True)[1].astype(np.uint64)
    keys = np.unique(key, return_inverse=True)[1].astype(np.uint64)
    top = int(codes.max(initial=0)) + 1
    active = np.arange(len(count))
    for bit in range(int(ranks.max(initial=0)).bit_length() - 1, -1, -1):
        node = ranks[active] >> np.uint64(bit + 1)
        streamed = (ranks[active] >> np.uint64(bit) & np.uint64(1)).astype(bool)
        place = node << np.uint64(32) | keys[active]
        meets = np.empty(len(active), bool)
        meets[streamed] = np.isin(place[streamed], place[~streamed])
        meets[~streamed] = np.isin(place[~streamed], place[streamed])
        given, asked = active[meets & ~streamed], active[meets & streamed]
        if len(asked):
            symbols = codes[_flat(begin[given], size[given])].astype(np.int64) + np.repeat(node[meets & ~streamed].astype(np.int64) * top, size[given])
            known, dense = np.unique(symbols, return_inverse=True)
            text = np.zeros(int(size[given].sum()) + len(given), np.int64)
            text[_flat(np.cumsum(size[given] + 1) - (size[given] + 1), size[given])] = dense + 1
            index = FMIndex(text, len(known) + 1)
            symbols = codes[_flat(begin[asked], size[asked])].astype(np.int64) + np.repeat(node[meets & streamed].astype(np.int64) * top, size[asked])
            at = np.minimum(np.searchsorted(known, symbols), len(known) - 1)
            own = np.where(known[at] == symbols, at + 1, -1)
            starts = np.cumsum(size[asked]) - size[asked]
            statistics = index.matching_statistics(own, starts, size[asked])
            found[_flat(first[asked], count[asked])] |= statistics[_flat(starts + WINDOW - 1, count[asked])] >= WINDOW
        # go on where a node of the next level has the key in two documents
        open_ = np.add.reduceat((~found).astype(np.int64), first)[active] > 0
        active = active[open_]
        place = ranks[active] >> np.uint64(bit) << np.uint64(32) | keys[active]
        order = np.lexsort((ranks[active], place))
        p, r = place[order], ranks[active][order]
        begins = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]])) if len(p) else np.empty(0, np.int64)
        last = np.append(begins[1:], len(p)) - 1 if len(p) else begins
        shared = np.repeat(r[begins] != r[last], np.diff(np.append(begins, len(p)))) if len(p) else np.empty(0, bool)
        active = active[np.sort(order[shared])]
        if not len(active):
            break
    return found


def _shard(buckets: int, groups: int) -> Callable:
    """The replies to each chunk, and from a group's shard also what goes on to the shard of all groups."""

    def run(group: pa.Table) -> pa.Table:
        parts = [_unpack(x) for x in group.column("blob").to_pylist()]
        words = _words(np.concatenate([p[4] for p in parts]), np.concatenate([p[5] for p in parts])).dictionary_encode()
        code_of, upto = np.asarray(words.indices), np.cumsum([0, *(len(p[4]) for p in parts)])
        codes = np.concatenate([code_of[a:b][p[6]] for a, b, p in zip(upto[:-1], upto[1:], parts, strict=True)])
        first, owner, key, count = (np.concatenate([p[i] for p in parts]) for i in range(4))
        size = count + WINDOW - 1
        begin = np.cumsum(size) - size
        found = repeated(codes, begin, count, owner, key)
        cut, window = np.cumsum([0, *(len(p[0]) for p in parts)]), np.concatenate([[0], np.cumsum(count)])
        shard, onward = group.column("shard")[0].as_py(), []
        chunks, replies = group.column("chunk").to_pylist(), []
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            replies.append(_seal(first[a:b], count[a:b].astype(np.uint8), np.packbits(found[window[a] : window[b]])))
            new = a + np.flatnonzero(~found[window[a] : window[b]]) if shard >= buckets else np.empty(0, np.int64)  # one window a segment here
            onward.append(_packed(codes, words.dictionary, first[new], owner[new], key[new], begin[new], count[new]) if len(new) else None)
        to = pa.array([(shard - buckets) // groups] * len(chunks), pa.int64())
        out = pa.table({"chunk": pa.array(chunks, pa.int64()), "reply": pa.array(replies, pa.binary()), "shard": to, "blob": pa.array(onward, pa.binary())})
        del parts, codes, words, found
        released()
        return out

    return run


# --- judgement ------------------------------------------------------------------------------------------------


def _covered(chunk: Chunk, replies: list[bytes]) -> np.ndarray:
    """Which words of the chunk lie under a window that starts in a document with a smaller id."""
    found = np.zeros(len(chunk.window), bool)
    for x in replies:
        first, count, bits = _open(x, np.uint32, np.uint8, np.uint8)
        size = count.astype(np.int64)
        found[_flat(first.astype(np.int64), size)] |= np.unpackbits(bits, count=int(size.sum())).astype(bool)
    # equal segments of the chunk: all windows are repeated if the one that stands for them has a smaller id
    other = np.flatnonzero(chunk.like != np.arange(len(chunk.like)))
    if len(other):
        ids, size = chunk.doc_ids[chunk.doc], chunk.count[other]
        whole = np.repeat(ids[chunk.like[other]] < ids[other], size)
        found[_flat(chunk.first[other], size)] = whole | found[_flat(chunk.first[chunk.like[other]], size)]
    delta = np.zeros(len(chunk.code) + 1, np.int64)
    delta[chunk.window[found]] += 1  # every window starts at a word of its own
    np.subtract.at(delta, chunk.window[found] + WINDOW, 1)
    return np.cumsum(delta[:-1]) > 0


def _digest(batch: pa.RecordBatch, texts: list[bytes], chunk: Chunk, gone: np.ndarray) -> pa.Table:
    removed, sha = [], []
    for text, a, n in zip(texts, chunk.first_word.tolist(), chunk.n_words.tolist(), strict=True):
        mask, words = gone[a : a + n], text.split()
        removed.append(int(mask.sum()))
        if removed[-1]:
            words = [w for w, x in zip(words, mask.tolist(), strict=True) if not x]
        sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
    return pa.table({"doc_id": batch.column("doc_id").cast(pa.int64()), "n_words": pa.array(chunk.n_words), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})


def _rewritten(batch: pa.RecordBatch, texts: list[bytes], chunk: Chunk, gone: np.ndarray) -> pa.Table:
    out, keep = [], []
    for text, given, a, n in zip(texts, batch.column("text").to_pylist(), chunk.first_word.tolist(), chunk.n_words.tolist(), strict=True):
        mask = gone[a : a + n]
        if mask.any():
            given = b" ".join([w for w, x in zip(text.split(), mask.tolist(), strict=True) if not x]).decode()
        out.append(given)
        keep.append(not n or not mask.all())
    columns = [pa.array(out, pa.string()) if name == "text" else column for name, column in zip(batch.schema.names, batch.columns, strict=True)]
    return pa.Table.from_arrays(columns, names=batch.schema.names).filter(pa.array(keep, pa.bool_()))


def _judged(docs: DataFrame, make: Callable, schema) -> DataFrame:
    chunks = written(_chunks(docs, CHUNK_BYTES), "substring-chunks")
    total = chunks.agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n")).first()
    buckets, groups = max(8, int(total["b"] or 0) // SHARD_BYTES), -(-max(1, total["n"]) // GROUP)
    told = chunks.mapInArrow(_announce(buckets), "bucket long, chunk long, blob binary")
    answers = told.groupBy("bucket").applyInArrow(_answer(HEAVY), "chunk long, bucket long, bits binary, heavy binary")
    by_chunk = chunks.select("chunk", "rows")
    segments = by_chunk.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_segments(buckets, groups), "shard long, chunk long, blob binary")
    search, result = _shard(buckets, groups), "chunk long, reply binary, shard long, blob binary"
    if groups > 1:
        segments = written(segments, "substring-segments")
        near = written(segments.where(F.col("shard") >= buckets).groupBy("shard").applyInArrow(search, result), "substring-groups")
        segments = segments.where(F.col("shard") < buckets).unionByName(near.where("blob is not null").select("shard", "chunk", "blob"))
    replies = segments.groupBy("shard").applyInArrow(search, result).select("chunk", "reply")
    if groups > 1:
        replies = replies.unionByName(near.select("chunk", "reply"))

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for rows in left.column("rows"):
            batch, texts, ids = _unpacked(rows.as_py())
            chunk = Chunk(texts, ids)
            out.append(make(batch, texts, chunk, _covered(chunk, right.column("reply").to_pylist())))
        released()
        return pa.concat_tables(out)

    return by_chunk.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(judge, schema)


def repeated_words(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document of (doc_id, text).

    A word goes if a window of 13 words over it also starts in a document with a smaller doc_id; windows are
    judged on the input. Null texts have no words. A null doc_id counts as larger than any. Rows that repeat an
    id do not remove each other. An empty table gives an empty result; other columns are ignored.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _judged(narrow, _digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeated words cut out, the kept ones joined by blanks.

    Texts that lose nothing stay as they are; documents that lose every word go. Other columns are kept, whatever
    their names; null ids and texts, repeated rows and empty tables are as above.
    """
    rows = docs.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text", F.col("text").cast("string"))
    return _judged(rows, _rewritten, rows.schema)
