"""Best-two-fit packing of tokenised documents into fixed-length sequences."""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.shared import released

CAPACITY = 2048
#: Documents that are packed together. A group leaves one or two sequences unfilled, of about a thousand.
GROUP_DOCS = 4096

_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The normaliser and splitter of tokenizers that can be looked up word by word; any other encodes whole texts.
_KNOWN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "truncation": None,
    "padding": None,
}
_BATCH_CHARS = 4_000_000


class WordTokeniser:
    """The ids of a word-level BPE tokenizer, found word by word with a bounded memory.

    No piece of the tokenizer's own splitting spans a blank or a line end, so a text's ids are those of
    its blank-separated chunks in order. Each different chunk of a batch is looked up once. A tokenizer file with
    another normaliser or splitter than the known one encodes whole texts instead.
    """

    def __init__(self, path: str, remembered: int = 200_000):
        import regex
        from tokenizers import Tokenizer

        self._whole = Tokenizer.from_file(path)
        spec = json.loads(self._whole.to_str())
        # special tokens are searched before normalisation, so one that is normalised or takes blanks along is not known
        self._by_word = all(spec.get(k) == v for k, v in _KNOWN.items()) and spec["model"]["type"] == "BPE" and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] for t in spec["added_tokens"])
        self._model = self._whole.model
        self._specials = [t.content for t in self._whole.get_added_tokens_decoder().values()]
        self._marks = os.path.commonprefix(self._specials)  # what every special token begins with, to look for first
        self._pieces = regex.compile(_SPLIT).findall
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        moved = [b for b in range(256) if b not in kept]
        self._byte = {b: chr(b) for b in kept} | {b: chr(256 + n) for n, b in enumerate(moved)}
        self._remembered = remembered
        self._chunk: dict[str, tuple[int, ...]] = {}
        self._word: dict[str, tuple[int, ...]] = {}

    def _of_word(self, word: str) -> tuple[int, ...]:
        ids = self._word.get(word)
        if ids is None:
            plain = word.isascii() and word.isprintable()
            ids = tuple([t.id for t in self._model.tokenize(word if plain else "".join(map(self._byte.__getitem__, word.encode())))])
            if len(self._word) >= self._remembered:
                self._word.clear()
            self._word[word] = ids
        return ids

    def _of_chunk(self, chunk: str) -> tuple[int, ...]:
        if self._marks in chunk and any(s in chunk for s in self._specials):
            return tuple(self._whole.encode(chunk, add_special_tokens=False).ids)
        if chunk.isascii():
            low = chunk.lower()
            ids = self._word.get(low)  # a word that was split off before is its own only piece
            if ids is not None:
                return ids
            if low.isalpha():
                return self._of_word(low)
            if low[-1] in ".,!?;:" and low[:-1].isalpha():
                return self._of_word(low[:-1]) + self._of_word(low[-1])
        else:
            chunk = unicodedata.normalize("NFC", chunk)
            low = "".join([c.lower() for c in chunk]) if "Σ" in chunk else chunk.lower()
        found = self._pieces(low)
        if len(found) == 1:
            return self._of_word(found[0])
        return tuple([i for w in found for i in self._of_word(w)])

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, the number of each text's ids)."""
        if not self._by_word:
            found = [np.array(self._whole.encode(t, add_special_tokens=False).ids, np.uint32) for t in texts.to_pylist()]
            return np.concatenate([np.empty(0, np.uint32), *found]), np.array([len(f) for f in found], np.int64)
        lines = pc.replace_substring(texts, "\n", " ")
        chunks = pc.split_pattern(lines, " ")
        coded = pc.dictionary_encode(chunks.values)
        per_text = np.diff(np.asarray(chunks.offsets))
        known, out = self._chunk, []
        for c in coded.dictionary.to_pylist():
            ids = known.get(c)
            if ids is None:
                ids = self._of_chunk(c) if c else ()
                if len(known) >= self._remembered:
                    known.clear()
                known[c] = ids
            out.append(ids)
        size = np.fromiter(map(len, out), np.int64, len(out))
        flat = np.fromiter(chain.from_iterable(out), np.uint32, int(size.sum()))
        code = np.asarray(coded.indices)
        if not len(code):
            return np.empty(0, np.uint32), np.zeros(len(per_text), np.int64)
        begin, n = (np.cumsum(size) - size)[code], size[code]
        ends = np.cumsum(n)
        ids = flat[np.repeat(begin - (ends - n), n) + np.arange(int(ends[-1]))]
        upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per_text)])]
        return ids, np.diff(upto)


_tokenisers: dict[str, WordTokeniser] = {}


def _tokeniser(path: str) -> WordTokeniser:
    if path not in _tokenisers:
        _tokenisers[path] = WordTokeniser(path)
    return _tokenisers[path]


def pieces(docs: DataFrame, tokeniser_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids as bytes]) of every document, an end id 0 after its tokens.

    Null and empty texts are the end id alone. Documents longer than `capacity` are cut into pieces of that
    length, the last one shorter. A null doc_id stays null. Columns beside doc_id and text are not read.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = _tokeniser(tokeniser_path)
        for batch in batches:
            text = pc.fill_null(batch.column("text"), "")
            ids_of = batch.column("doc_id").to_pylist()
            upto = np.cumsum(np.asarray(pc.binary_length(text), np.int64))
            at = 0
            while at < len(ids_of):
                floor = upto[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(upto, floor + _BATCH_CHARS, "right")))
                yield _cut(work, ids_of[at:to], text.slice(at, to - at), capacity, with_ids)
                at = to
        released()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def _cut(work: WordTokeniser, doc_ids: list, texts: pa.Array, capacity: int, with_ids: bool) -> pa.RecordBatch:
    flat, counts = work.batch(texts)
    raw, at = flat.astype("<u4", copy=False), 0
    rows: list[tuple] = []
    for doc_id, n in zip(doc_ids, counts.tolist(), strict=True):
        own = np.empty(n + 1, "<u4")
        own[:n], own[n] = raw[at : at + n], 0
        at += n
        for piece, start in enumerate(range(0, n + 1, capacity)):
            part = own[start : start + capacity]
            rows.append((doc_id, piece, start, len(part), zlib.crc32(part.tobytes()), part.tobytes() if with_ids else None))
    doc, piece, start, length, crc, ids = zip(*rows, strict=True) if rows else ((),) * 6
    columns = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    if with_ids:
        columns.append(pa.array(ids, pa.binary()))
        names.append("ids")
    return pa.RecordBatch.from_arrays(columns, names)


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length; lengths lie between 1 and capacity.

    A bin opens with the longest length left and takes the longest that still fits, until none does. Then its
    smallest member gives way to the two unpacked lengths that fill the gap it leaves most tightly, if they
    fill more than it did. Lengths that are equal are used in the order given.
    """
    order = np.argsort(lengths, kind="stable")
    sorted_lengths = lengths[order]
    first = np.searchsorted(sorted_lengths, np.arange(capacity + 2))
    left = np.diff(first).tolist()  # how many of each length are unpacked
    following = first[:-1].tolist()
    there = sum(1 << n for n, count in enumerate(left) if count)
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)

    def take(n: int) -> None:
        nonlocal there
        left[n] -= 1
        if not left[n]:
            there ^= 1 << n

    def give(n: int) -> None:
        nonlocal there
        if not left[n]:
            there |= 1 << n
        left[n] += 1

    def longest(upto: int) -> int:
        return (there & ((2 << upto) - 1)).bit_length() - 1 if upto > 0 else -1

    def pair(room: int, above: int) -> tuple[int, int] | None:
        """The two unpacked lengths with the largest sum over `above`, at most `room`."""
        best, found = above, None
        a = longest(room - 1)
        while a > 0 and 2 * a > best:
            b = longest(min(room - a, a))
            if b == a and left[a] < 2:
                b = longest(a - 1) if a > 1 else -1
            if b > 0 and a + b > best:
                best, found = a + b, (a, b)
                if best == room:
                    return found
            a = longest(a - 1) if a > 1 else -1
        return found

    number = 0
    while there:
        n = there.bit_length() - 1
        take(n)
        members, room = [n], capacity - n
        while room and (n := longest(room)) > 0:
            take(n)
            members.append(n)
            room -= n
        if room and len(members) > 1:
            smallest = members[-1]
            if found := pair(room + smallest, smallest):
                members.pop()
                give(smallest)
                for n in found:
                    take(n)
                    members.append(n)
        at = 0
        for n in members:
            row = order[following[n]]
            following[n] += 1
            bins[row], offsets[row] = number, at
            at += n
        number += 1
    return bins, offsets


def pack(parts: DataFrame, n_docs: int, capacity: int = CAPACITY, group_docs: int = GROUP_DOCS) -> DataFrame:
    """parts with (sequence_id, offset), ids as numbers: hashed groups of some thousand documents are packed apart.

    Sequences of different groups never mix, so groups are independent tasks of bounded size. A piece's group is a
    hash of its id, its number, its tokens and its place in the input, so no id, null or repeated, makes a large group.
    """
    groups = max(1, -(-n_docs // group_docs))
    names = [c for c in parts.columns if c != "ids"]
    kinds = dict(parts.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in names), *["ids array<int>"] * ("ids" in kinds), "sequence_id long", "offset long"])

    def one(group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending"), ("place", "ascending")]).combine_chunks()
        length = group.column("length").to_numpy()
        number, offset = best_two_fit(length, capacity)
        columns = [group.column(c) for c in names]
        if "ids" in kinds:
            flat = np.frombuffer(b"".join(group.column("ids").to_pylist()), "<i4")
            columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.array(flat)))
        sequence = number * groups + group.column("grp")[0].as_py()
        return pa.table([*columns, pa.array(sequence), pa.array(offset)], names=[*names, *["ids"] * ("ids" in kinds), "sequence_id", "offset"])

    keyed = parts.withColumn("place", F.monotonically_increasing_id())
    keyed = keyed.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "place"), F.lit(groups)))
    return keyed.groupBy("grp").applyInArrow(one, schema)


def best_fit_packing(docs: DataFrame, tokeniser_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """All documents of (doc_id, text) as pieces with a place in a sequence of at most `capacity` tokens.

    Every row counts, repeated ones too; null texts are empty; an empty table gives an empty result; other
    columns are ignored. with_ids adds the tokens themselves.
    """
    return pack(pieces(docs, tokeniser_path, capacity, with_ids), docs.count(), capacity)
