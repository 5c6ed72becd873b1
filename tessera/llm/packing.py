"""Best-fit packing of token pieces after Martello-Toth dominance reduction.

Documents are tokenised, closed by an end id and cut into pieces of at most ``capacity``. Pieces of one length are alike, so
the packing is decided on the histogram of lengths (at most ``capacity`` numbers, whatever the corpus): the
reduction fixes sets that dominate every other set with their largest piece, best fit decreasing packs the rest,
both for many pieces at a time. The plan says which ranks of a length go where; pieces get their rank from a
window over (length, salt) and take their place in parallel.

Defined results: a null text is empty and gives one piece that holds the end id only; repeated rows are packed as often as they
occur; an empty table gives an empty table; only documents longer than the capacity are cut; other columns are not looked at.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import materialise, slices

#: Fixed value: the pattern of pieces for which the way by words is proven by tests.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
Pattern = tuple[tuple[int, int], ...]  # (length, how often), ...


class WordTokenizer:
    """Ids of whole texts by way of their words: a vocabulary that lower-cases and whose pieces never cross white space gives the same ids word by word.

    Words meet the tokenizer once a batch; ASCII marks behind a Latin letter or digit are a piece of their own in such a vocabulary, so they are
    looked up apart. A table keeps what was met more than once. The tokenizer's file is asked whether its steps are of this kind (``by_words``); if they are not,
    and for texts that hold the string of an added token in any case, whole texts meet the tokenizer.
    """

    MARK = "\x01"  # parts words that are encoded together
    SPLIT = r"(?s)^(?P<core>.*[A-Za-z0-9À-ÖØ-öø-ÿ])(?P<tail>[.,!?;:*$%#&|]+)$"

    def __init__(self, path: str, keep: int = 250_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        steps = json.loads(self.model.to_str())
        self.by_words = by_words(steps)
        self.added = "|".join(re.escape(t["content"]) for t in steps["added_tokens"])
        self.stop = self.model.encode(self.MARK, add_special_tokens=False).ids
        self.keep, self.known, self.table, self.starts = keep, {}, np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of units."""
        odd = len(self.stop) != 1 or any(self.MARK in u for u in units)
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for at in range(0, len(units), 20_000):
            some = units[at : at + 20_000]
            if odd:
                made = [np.asarray(e.ids, np.uint32) for e in self.model.encode_batch_fast(some, add_special_tokens=False)]
                ids.extend(made)
                counts.append(np.asarray([len(x) for x in made]))
                continue
            joined = [f" {self.MARK} ".join(some[i : i + 400]) + f" {self.MARK}" for i in range(0, len(some), 400)]
            flat = np.concatenate([np.asarray(e.ids, np.uint32) for e in self.model.encode_batch_fast(joined, add_special_tokens=False)])
            ends = np.flatnonzero(flat == self.stop[0])
            counts.append(np.diff(np.append(-1, ends)) - 1)
            ids.append(flat[flat != self.stop[0]])
        return np.concatenate(ids), np.concatenate(counts)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, np.uint32) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        texts = pc.fill_null(texts, "")
        if not self.by_words:
            return self.whole(texts.to_pylist())
        if self.added:
            special = np.flatnonzero(pc.match_substring_regex(texts, self.added, ignore_case=True).to_numpy(zero_copy_only=False))
            if len(special):
                rest = pc.if_else(pa.array(np.isin(np.arange(len(texts)), special)), "", texts)
                out = self._by_words(rest)
                for i, ids in zip(special, self.whole(texts.take(pa.array(special)).to_pylist()), strict=True):
                    out[i] = ids
                return out
        return self._by_words(texts)

    def _by_words(self, texts: pa.Array) -> list[np.ndarray]:
        lists = pc.ascii_split_whitespace(texts)
        ends = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))
        words = pc.dictionary_encode(pc.ascii_lower(lists.flatten()))
        if isinstance(words, pa.ChunkedArray):
            words = words.combine_chunks()
        parts = pc.extract_regex(words.dictionary, self.SPLIT)
        units = pc.dictionary_encode(pa.concat_arrays([pc.coalesce(pc.struct_field(parts, "core"), words.dictionary), pc.coalesce(pc.struct_field(parts, "tail"), pa.scalar(""))]))
        names, unit = units.dictionary.to_pylist(), units.indices.to_numpy(zero_copy_only=False)
        place = np.asarray([self.known.get(u, -1) for u in names], np.int64)
        new = np.flatnonzero(place < 0)
        ids, counts = self._encode([names[i] for i in new])
        place[new] = len(self.starts) - 1 + np.arange(len(new))
        table = np.concatenate([self.table, ids])
        starts = np.append(self.starts, self.starts[-1] + np.cumsum(counts))
        at = place[unit]
        size = starts[at + 1] - starts[at]
        core, tail = np.split(np.arange(len(at)), 2)
        # ids of each word of the batch, one behind the other
        order = np.stack([core, tail], 1).ravel()
        word_ids = table[_spans(starts[at[order]], size[order])]
        word_ends = np.append(0, np.cumsum(size[core] + size[tail]))
        which = words.indices.to_numpy(zero_copy_only=False)
        out = [word_ids[_spans(word_ends[w], word_ends[w + 1] - word_ends[w])] for w in (which[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True))]
        self._remember(names, place, table, starts, np.bincount(unit, np.append(np.bincount(which, minlength=len(core)), np.bincount(which, minlength=len(core))), minlength=len(names)))
        return out

    def _remember(self, names: list[str], place: np.ndarray, table: np.ndarray, starts: np.ndarray, met: np.ndarray) -> None:
        """Adds the batch's repeated units; starts anew from them when the table is full."""
        again = np.flatnonzero((met > 1) & (place >= len(self.starts) - 1))
        if len(self.known) + len(again) > self.keep:
            self.known, self.table, self.starts = {}, np.zeros(0, np.uint32), np.zeros(1, np.int64)
            again = np.flatnonzero(met > 1)[: self.keep]
        size = starts[place[again] + 1] - starts[place[again]]
        base = len(self.starts) - 1
        self.known.update((names[i], base + k) for k, i in enumerate(again))
        self.table = np.concatenate([self.table, table[_spans(starts[place[again]], size)]])
        self.starts = np.append(self.starts, self.starts[-1] + np.cumsum(size))


def by_words(steps: dict) -> bool:
    """Whether a tokenizer's steps are known to work inside words: lower-casing, pieces cut out by a pattern that leaves white space out, end-of-word merges."""
    flat = lambda step, name: [] if step is None else sum((flat(x, name) for x in step[name]), []) if step["type"] == "Sequence" else [step]
    first, second = flat(steps["normalizer"], "normalizers"), flat(steps["pre_tokenizer"], "pretokenizers")
    blanks = all(x["type"] in ("NFC", "Lowercase") or x["type"] == "Replace" and x["pattern"] == {"Regex": r"\s+"} and x["content"] == " " for x in first)
    cut = bool(second) and second[0]["type"] == "Split" and second[0]["behavior"] == "Removed" and second[0]["invert"] and second[0]["pattern"] == {"Regex": _PIECES}
    rest = all(x["type"] == "ByteLevel" and not x["add_prefix_space"] and not x["use_regex"] for x in second[1:])
    plain = all(not t["single_word"] and not t["lstrip"] and not t["rstrip"] for t in steps["added_tokens"])
    model = steps["model"]["type"] == "BPE" and steps["model"].get("end_of_word_suffix") == "</w>" and not steps["model"].get("dropout")
    return blanks and any(x["type"] == "Lowercase" for x in first) and cut and rest and plain and model and steps["post_processor"] is None


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all spans, one behind the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row for each piece; with_ids adds the ids themselves, as little-endian 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenize = None
        for part in slices(batches, 16 << 20):
            tokenize = tokenize or WordTokenizer(tokenizer_path)
            cells: list[list] = [[] for _ in range(5 + with_ids)]
            for doc_id, ids in zip(part.column(0).to_pylist(), tokenize(part.column(1)), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    raw = ids[start : start + capacity].tobytes()
                    for cell, value in zip(cells, (doc_id, piece, start, len(raw) // 4, zlib.crc32(raw), raw), strict=False):
                        cell.append(value)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types, strict=False)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(cells)])

    schema = PIECES + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[list[tuple[Pattern, int]], dict[int, int]]:
    """Fixes dominating sets for the lengths from the largest down; gives them and the histogram that is left.

    With a piece of length a and the room b = capacity - a beside it, these sets are never worse than another with that piece:
    it alone if the least other does not fit; it and a piece of exactly b; it and the largest that fits if two of the least do not
    fit, or if no two that fit together are longer than it and three do not fit.
    """
    left = {k: v for k, v in counts.items() if v > 0}
    order, fixed = sorted(left), []

    def take(pattern: list[int], times: int) -> None:
        runs: dict[int, int] = defaultdict(int)
        for length in pattern:
            runs[length] += 1
        fixed.append((tuple(sorted(runs.items(), reverse=True)), times))
        for length, n in runs.items():
            left[length] -= n * times
            if not left[length]:
                del left[length]
                order.pop(bisect_left(order, length))

    def smallest(n: int, without: int) -> list[int]:
        out = []
        for length in order:
            have = left[length] - (length == without)
            out += [length] * min(have, n - len(out))
            if len(out) == n:
                break
        return out

    def largest(most: int, used: dict[int, int]) -> int:
        i = bisect_left(order, most + 1) - 1
        while i >= 0 and left[order[i]] - used.get(order[i], 0) <= 0:
            i -= 1
        return order[i] if i >= 0 else 0

    def best_two(room: int, a: int) -> int:
        free = {x: left[x] - (x == a) for x in order if x < room and left[x] > (x == a)}
        names, best = list(free), 0
        i, j = 0, len(names) - 1
        while i <= j:
            both = names[i] + names[j]
            if both > room:
                j -= 1
                continue
            if i < j or free[names[i]] > 1:
                best = max(best, both)
            i += 1
        return best

    for a in sorted(left, reverse=True):
        while left.get(a, 0):
            room = capacity - a
            few = smallest(3, a)
            if not few or few[0] > room:
                take([a], left[a])
                continue
            partner = largest(room, {a: 1})
            if partner == room or len(few) < 2 or few[0] + few[1] > room or (len(few) < 3 or sum(few) > room) and partner >= best_two(room, a):
                take([a, partner], left[a] // 2 if partner == a else min(left[a], left[partner]))
                continue
            break
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best fit decreasing for whole groups of like bins."""
    bins: dict[int, list[list]] = defaultdict(list)  # room -> [pattern, times]
    rooms: list[int] = []

    def put(room: int, pattern: Pattern, times: int) -> None:
        if times:
            if not bins[room]:
                insort(rooms, room)
            bins[room].append([pattern, times])

    for length in sorted((k for k, v in counts.items() if v > 0), reverse=True):
        n = counts[length]
        while n:
            i = bisect_left(rooms, length)
            if i == len(rooms):
                room, pattern, times = capacity, (), n
            else:
                room = rooms[i]
                pattern, times = bins[room].pop()
                if not bins[room]:
                    rooms.pop(i)
            each = room // length
            full = min(times, n // each)
            put(room - each * length, (*pattern, (length, each)), full)
            n -= full * each
            if full < times:
                some = min(n, each - 1) if n < each else 0
                if some:
                    put(room - some * length, (*pattern, (length, some)), 1)
                    n -= some
                    full += 1
                if room < capacity or pattern:
                    put(room, pattern, times - full)
    return [(p, t) for groups in bins.values() for p, t in groups]


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """(pattern, number of sequences like it) for a histogram of lengths."""
    fixed, rest = reduce_dominated(counts, capacity)
    return fixed + best_fit(rest, capacity)


def places(plan: list[tuple[Pattern, int]]) -> np.ndarray:
    """Rows (length, first rank, times a sequence, first sequence, offset) ordered by length and rank."""
    used: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for pattern, times in plan:
        offset = 0
        for length, each in pattern:
            rows.append((length, used[length], each, sequence, offset))
            used[length] += each * times
            offset += each * length
        sequence += times
    return np.asarray(sorted(rows), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = 2048, rows_per_salt: int = 500_000) -> DataFrame:
    """pieces (stored: it is read twice) with sequence_id and offset.

    A piece as long as a sequence is one by itself and needs no rank: its sequence is a negative number of its own. Each document has at most one
    other piece, so what meets in a window is bounded by documents of one length and by the salts, whose number is bounded as the driver holds a count
    for each length and salt.
    """
    whole = pieces.filter(F.col("length") == capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    pieces = pieces.filter(F.col("length") < capacity)
    total = pieces.count()
    salts = min(2048, 16 + total // rows_per_salt)
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    groups = salted.groupBy("length", "_salt").count().toArrow()  # at most capacity x 2048 numbers
    first = np.zeros((capacity + 1, salts), np.int64)
    first[groups["length"].to_numpy(), groups["_salt"].to_numpy()] = groups["count"].to_numpy()
    counts = {n: int(k) for n, k in enumerate(first.sum(axis=1)) if k}
    first = np.cumsum(first, axis=1) - first
    table = places(plan_bins(counts, capacity))
    shift = 1 << 44
    keys = table[:, 0] * shift + table[:, 1]
    sent = pieces.sparkSession.sparkContext.broadcast((first, table, keys))  # bounded by capacity and salts
    ranked = salted.withColumn("_nth", F.row_number().over(W.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")).cast("long") - 1)
    names = pieces.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, table, keys = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            by = dict(zip(batch.schema.names, batch.columns, strict=True))
            length, salt, nth = (by[n].to_numpy(zero_copy_only=False) for n in ("length", "_salt", "_nth"))
            rank = first[length, salt] + nth
            row = table[np.searchsorted(keys, length * shift + rank, "right") - 1]
            copy, slot = np.divmod(rank - row[:, 1], row[:, 2])
            yield pa.RecordBatch.from_arrays([*(by[n] for n in names), pa.array(row[:, 3] + copy), pa.array(row[:, 4] + slot * length)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes)
    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long").unionByName(whole)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    return pack(materialise(cut_pieces(docs, tokenizer_path, capacity, end_id, with_ids), "pack-pieces"), capacity)
