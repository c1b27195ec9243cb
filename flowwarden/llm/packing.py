"""Packing of tokenised documents into sequences of bounded length by linear grouping and best fit.

Only the histogram of piece lengths reaches the driver: as many rows as a sequence has tokens at most, however many
documents there are. The plan made of it is a short list of runs, each of which places equally long pieces into
consecutive sequences; tasks look up a piece by its length and its rank among pieces of that length.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces as small_batches
from .common import saved

CAPACITY = 4096
END_ID = 1
#: Plans tried: numbers of groups of large lengths, and the shares of a sequence over which a length is large.
GROUPS = (16, 64, 256, 1024)
LARGE_SHARES = (1 / 8, 1 / 4, 3 / 8)
#: The share of a sequence that a configuration has to fill.
LEAST_FILL = 0.99
#: Words whose ids a worker remembers.
CACHE_WORDS = 250_000
_SLICE = 1 << 20
_LETTERS = re.compile("[a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
#: Byte-level vocabularies spell bytes that don't print as letters from 256 on: 33 lie below the letters of 127 to 160.
_BYTE_LETTERS = {b: 256 + 33 + b - 127 for b in range(127, 161)} | {173: 256 + 33 + 34}
_RANK_BITS = 45

PIECE_SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


class WordEncoder:
    """Ids of whole texts, as little-endian 32-bit numbers, from a tokenizer whose tokens never cross white space.

    Words are encoded once and remembered, up to CACHE_WORDS of them; a word with a mark behind it is put together from
    both. The tokenizer lowers all letters and composes marks, so A-Z may be lowered first, and a word of letters of the
    Latin-1 range only goes straight to the merges, spelt in the printable letters that stand for bytes.

    With `added`, the names of added tokens, such as <|endoftext|>, are these tokens, as the tokenizer takes them by itself;
    words that hold one are left as they are for it. Without, they are text.
    """

    def __init__(self, path: str, added: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        names = [t.content.encode().lower() for t in self.tokenizer.get_added_tokens_decoder().values()] if added else []
        self.named = re.compile(b"|".join(map(re.escape, names))) if names else None
        self.merge = self.tokenizer.model.tokenize
        self.known: dict[bytes, bytes] = {}
        self.marks = {m: self._encode(m) for m in (b".", b",", b"!", b"?", b";", b":")}

    def _encode(self, word: bytes) -> bytes:
        text = word.decode()
        if _LETTERS.fullmatch(text):
            spelt = text.lower().encode().decode("latin-1").translate(_BYTE_LETTERS)
            return array("I", [t.id for t in self.merge(spelt)]).tobytes()
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learned(self, missing: set[bytes]) -> dict[bytes, bytes]:
        known, new = self.known, {}
        for w in missing:
            if w[-1:] in self.marks and w[-2:-1].isalnum():
                stem = w[:-1]
                ids = known.get(stem) or new.get(stem)
                if ids is None:
                    ids = new[stem] = self._encode(stem)
                new[w] = ids + self.marks[w[-1:]]
            elif w not in new:
                new[w] = self._encode(w)
        if len(known) < CACHE_WORDS:
            known.update(new)
        return new

    def __call__(self, text: bytes) -> bytes:
        out, at = [], 0
        while at < len(text):
            end = at + _SLICE
            while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
                end += 1
            part = text[at:end].lower()
            words = part.split()
            if self.named and self.named.search(part):
                words = [raw if self.named.search(w) else w for w, raw in zip(words, text[at:end].split())]
            ids = list(map(self.known.get, words))
            if None in ids:
                new = self._learned({w for w, x in zip(words, ids) if x is None})
                ids = [new[w] if x is None else x for w, x in zip(words, ids)]
            out.append(b"".join(ids))
            at = end
        return b"".join(out)


@functools.cache
def _encoder(path: str) -> WordEncoder:
    """One for all tasks of a worker, with the words it remembers."""
    return WordEncoder(path, added=True)


def _cut(path: str, capacity: int, end_id: int, with_ids: bool):
    last = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        for part, texts in small_batches(batches, "text"):
            rows = []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), texts):
                ids = (encode(text) if text else b"") + last
                for i in range(0, len(ids), 4 * capacity):
                    cut = ids[i : i + 4 * capacity]
                    rows.append((doc_id, i // (4 * capacity), i // 4, len(cut) // 4, zlib.crc32(cut), cut))
            columns = list(zip(*rows))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds)]
            if with_ids:
                arrays.append(pa.array(columns[5], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def tokenized_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The documents' pieces: ids of the whole text, then `end_id`, cut every `capacity` ids.

    with_ids adds the ids as little-endian unsigned 32-bit numbers.
    """
    schema = PIECE_SCHEMA + (", ids binary" if with_ids else "")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return docs.mapInArrow(_cut(tokenizer, capacity, end_id, with_ids), schema)


def equal_groups(histogram: dict[int, int], least: int, groups: int) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Lengths over `least`, longest first, in groups of equally many pieces: (longest, [(length, first rank, count)])."""
    large = sorted((n for n in histogram if n > least), reverse=True)
    total = sum(histogram[n] for n in large)
    out: list[tuple[int, list[tuple[int, int, int]]]] = []
    room = 0
    for n in large:
        rank, left = 0, histogram[n]
        while left:
            if room == 0:
                k = len(out)
                room = total * (k + 1) // groups - total * k // groups
                out.append((n, []))
                if room == 0:
                    out[-1] = (0, [])
                    continue
            take = min(left, room)
            out[-1][1].append((n, rank, take))
            rank, left, room = rank + take, left - take, room - take
    return [g for g in out if g[1]]


def best_fill(sizes: list[int], counts: list[int], first: int, capacity: int) -> list[int]:
    """How many of each size, `first` included, fill a sequence best."""
    room = capacity - sizes[first]
    reached = [1]  # bit n: n can be filled by the sizes so far
    for size, count in zip(sizes, [c - (i == first) for i, c in enumerate(counts)]):
        now, step = reached[-1], 1
        copies = min(count, room // size)
        while copies > 0:  # copies in powers of two
            take = min(step, copies)
            now |= now << (take * size)
            copies -= take
            step *= 2
        reached.append(now & ((1 << (room + 1)) - 1))
    fill = reached[-1].bit_length() - 1
    chosen = [0] * len(sizes)
    for i in range(len(sizes) - 1, -1, -1):
        while not (reached[i] >> fill) & 1:
            chosen[i] += 1
            fill -= sizes[i]
    chosen[first] += 1
    return chosen


def configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """(how many of each size, how many sequences alike), until no piece is left; fullest sequences first."""
    counts, out = list(counts), []
    while any(counts):
        first = next(i for i, c in enumerate(counts) if c)
        chosen = best_fill(sizes, counts, first, capacity)
        times = min(c // k for c, k in zip(counts, chosen) if k)
        counts = [c - k * times for c, k in zip(counts, chosen)]
        out.append((chosen, times))
    return out


class Plan:
    """Runs (length, first rank, sequences, copies in each, first sequence, offset) in growing order of length, rank.

    Configurations that fill less than `least_fill` of a sequence are not used: their pieces go, like small ones, to
    where the least room is left, also behind substituted pieces that are shorter than their group's longest.
    """

    def __init__(
        self, histogram: dict[int, int], capacity: int = CAPACITY, large_share: float = LARGE_SHARES[0],
        groups: int = GROUPS[0], least_fill: float = LEAST_FILL,
    ):
        self.capacity, self.sequences = capacity, 0
        self.runs: list[tuple[int, int, int, int, int, int]] = []
        self.rooms: list[int] = []
        self.by_room: dict[int, list[tuple[int, int]]] = {}
        if full := histogram.get(capacity, 0):
            self.runs.append((capacity, 0, full, 1, 0, 0))
            self.sequences = full
        least = int(capacity * large_share)
        rest = {n: c for n, c in histogram.items() if n < capacity}
        left = self._place_large(equal_groups(rest, least, groups), least_fill * capacity)
        self._place_rest(left + [(n, 0, c) for n, c in rest.items() if n <= least])
        self.runs.sort()

    def _open(self, room: int, first: int, count: int) -> None:
        if room and count:
            if room not in self.by_room:
                insort(self.rooms, room)
                self.by_room[room] = []
            self.by_room[room].append((first, count))

    def _place_large(self, groups: list[tuple[int, list[tuple[int, int, int]]]], least: float) -> list[tuple[int, int, int]]:
        """Places the pieces of configurations that fill `least` or more; returns the others."""
        queues = [list(reversed(members)) for _, members in groups]
        sizes = [size for size, _ in groups]
        counts = [sum(c for _, _, c in members) for _, members in groups]
        for chosen, times in configurations(sizes, counts, self.capacity):
            if sum(k * n for k, n in zip(chosen, sizes)) < least:
                continue
            slots = [g for g, k in enumerate(chosen) for _ in range(k)]
            taken = [self._take(queues[g], times) for g in slots]
            done, at = 0, [0] * len(slots)
            while done < times:  # as many sequences as have the same lengths in all slots
                alike = min(taken[s][at[s]][2] for s in range(len(slots)))
                offset = 0
                for s in range(len(slots)):
                    length, rank, count = taken[s][at[s]]
                    self.runs.append((length, rank, alike, 1, self.sequences + done, offset))
                    offset += length
                    if count == alike:
                        at[s] += 1
                    else:
                        taken[s][at[s]] = (length, rank + alike, count - alike)
                self._open(self.capacity - offset, self.sequences + done, alike)
                done += alike
            self.sequences += times
        return [run for queue in queues for run in queue]

    @staticmethod
    def _take(queue: list[tuple[int, int, int]], n: int) -> list[tuple[int, int, int]]:
        out = []
        while n:
            length, rank, count = queue.pop()
            if count > n:
                queue.append((length, rank + n, count - n))
                count = n
            out.append((length, rank, count))
            n -= count
        return out

    def _place_rest(self, pieces: list[tuple[int, int, int]]) -> None:
        for length, rank, left in sorted(pieces, key=lambda p: (-p[0], p[1])):
            while left:
                i = bisect_left(self.rooms, length)
                if i == len(self.rooms):
                    copies = self.capacity // length
                    new = -(-left // copies)
                    self._open(self.capacity, self.sequences, new)
                    self.sequences += new
                    continue
                room = self.rooms[i]
                first, count = self.by_room[room].pop()
                if not self.by_room[room]:
                    del self.by_room[room], self.rooms[i]
                copies = min(room // length, left)
                used = min(count, left // copies)
                self.runs.append((length, rank, used, copies, first, self.capacity - room))
                rank, left = rank + used * copies, left - used * copies
                self._open(room - copies * length, first, used)
                self._open(room, first + used, count - used)


def best_plan(
    histogram: dict[int, int], capacity: int = CAPACITY, large_shares: Sequence[float] = LARGE_SHARES,
    groups: Sequence[int] = GROUPS, least_fill: float = LEAST_FILL,
) -> Plan:
    """The plan of fewest sequences among these groupings; none is tried once there can be no fewer."""
    bound = -(-sum(n * c for n, c in histogram.items()) // capacity)
    best = None
    for k in groups:
        for share in large_shares:
            plan = Plan(histogram, capacity, share, k, least_fill)
            if best is None or plan.sequences < best.sequences:
                best = plan
            if best.sequences == bound:
                return best
    return best


def _ranked(pieces: DataFrame) -> DataFrame:
    """`rank` of each piece among those of its length, from 0. Groups are no larger than what one task wrote."""
    counts = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    inner = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32"))
    return pieces.withColumn("inner", inner).join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("inner") - 1).drop("inner", "before", "bucket")


def _assign(runs: np.ndarray):
    keys = (runs[:, 0] << _RANK_BITS) + runs[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            r = runs[np.searchsorted(keys, (length << _RANK_BITS) + rank, side="right") - 1]
            inside = rank - r[:, 1]
            sequence = r[:, 4] + inside % r[:, 2]
            offset = r[:, 5] + inside // r[:, 2] * length
            kept = [i for i, n in enumerate(batch.schema.names) if n != "rank"]
            columns = [batch.column(i) for i in kept] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, names=[batch.schema.names[i] for i in kept] + ["sequence_id", "offset"])

    return run


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID,
    large_shares: Sequence[float] = LARGE_SHARES, groups: Sequence[int] = GROUPS, with_ids: bool = False,
) -> DataFrame:
    """One row per piece of docs(doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Large lengths are rounded up to the longest of their group of equally many pieces; configurations of these few
    lengths are filled by dynamic programming and used as often as the pieces allow. Actual pieces take the places of
    rounded ones, and all others go, longest first, to where the least room is left. What is large, and how many groups
    there are, is tried out on the histogram of lengths: the plan of fewest sequences is used.

    A null or empty text has one id, `end_id`. Each row is a document of its own, repeated ids and texts, too; a null
    doc_id stays null. Other columns are ignored. An empty table gives no rows. A text of any length is encoded in
    slices; only its ids are in memory as a whole.
    """
    found = tokenized_pieces(docs, tokenizer, capacity, end_id, with_ids)
    found = saved(found.withColumn("bucket", F.spark_partition_id()), "pack_pieces")
    histogram = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}  # `capacity` rows at most
    plan = best_plan(histogram, capacity, large_shares, groups)
    runs = np.array(plan.runs, np.int64).reshape(-1, 6)
    schema = PIECE_SCHEMA + (", ids binary" if with_ids else "") + ", sequence_id bigint, offset bigint"
    names = [c for c in found.columns if c != "bucket"]
    return _ranked(found).select(*names, F.col("rank").cast("bigint").alias("rank")).mapInArrow(_assign(runs), schema)
