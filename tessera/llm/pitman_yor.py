"""Language-model scoring with a hierarchical Pitman-Yor process.

A word is a dish, the word before it names its restaurant: every distinct word before has one of its own, whatever the corpus. All context restaurants share one
parent, whose base is uniform over the training words and one unseen word. Seats follow the Chinese restaurant: the customer after n at t tables of a
dish opens a new one with odds (strength + discount * tables of the restaurant) * parent's probability to n - discount * t.

A Gibbs sweep takes all customers of a dish in a restaurant away, with the tables they held there and the customers these were at the parent, and draws the number of
their tables anew given all others: up to ``EXACT`` customers exactly from its distribution (generalised Stirling numbers), larger parties by seating one after another.
The tables opened are the parent's customers, who are seated alike. What tasks know of each other's seats is one sweep old. Probabilities are averaged over the
sweeps after ``burn_in``; a document's perplexity is the inverse of their mean by token.

How it runs: blocks of documents send each slot of words the counts of (word, context, document) as packed arrays, one shuffle; a slot sums them and is stored in a table
bucketed by slot, which no later step shuffles. The tables of a context are summed by bucket of contexts: slots send what their pairs hold, and ask for the sums, as packed arrays.
Pairs of one customer never move, so sweeps ask for the contexts of the others only. The last pass asks for all contexts and returns each document's sums to its block.
A word that alone outgrows a slot has several, by context. A pair that would is counted in its blocks and scored there; a sample tells such words and pairs, which only routes.

Context keys have as many bytes of the word's hash as keep shared keys below one in a thousand contexts at any size of the corpus.

Defined results: a null or empty text has the end token only; rows that repeat an id are scored and learned each; a null id counts
as the empty text in the fold rule; an empty table, or one without training rows, gives uniform probabilities; other columns are not looked at.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import discard, fold, materialise, release, slices, work_dir

EXACT = 32
#: Buckets of the stored table at most (Spark allows 100,000 by default); beyond, a bucket has more slots, which its task still meets one by one.
MOST_FILES = 1 << 16
END, START = xxhash.xxh3_64_intdigest(b"\0end"), xxhash.xxh3_64_intdigest(b"\0start")
_BLOCK = "slot int, block long, words binary, counts binary, ctx binary, doc binary, times binary, docs binary, lengths binary, pins binary, pin_doc binary, pin_times binary"
_PAIRS = "slot int, word_counts binary, hot binary, pair_words binary, pair_ctx binary, pair_counts binary"
_TABLE = f"{_PAIRS}, block long, entry_runs binary, entry_docs binary, entry_times binary, docs binary, lengths binary, pins binary, pin_doc binary, pin_times binary"
_MESSAGE = "kind int, bucket int, slot int, sweep int, keys binary, a binary, b binary"
_TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
# kinds of messages: what contexts hold, questions for sums, their answers, states of slots, totals
_HOLDS, _ASK, _TOLD, _STATE, _TOTAL = range(5)


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, t in zip(columns, types, strict=True)], list(names))


def _ids(values: list[int | None]) -> bytes:
    """Document ids with a leading null mask."""
    return bytes(v is None for v in values) + np.asarray([v or 0 for v in values], "<i8").tobytes()


def _named(data: bytes) -> list[int | None]:
    n = len(data) // 9
    return [None if gone else int(v) for gone, v in zip(data[:n], np.frombuffer(data, "<i8", n, n), strict=True)]


def key_width(size: int) -> int:
    """Bytes of a context key: the contexts, at most one for each four bytes of text, meet 1,024 times as many keys."""
    return min(8, -(-((max(1, size) // 4 + 1).bit_length() + 10) // 8))


def _z(values: np.ndarray) -> bytes:
    """Numbers as compressed byte planes: high bytes, which hardly differ, are neighbours."""
    raw = np.ascontiguousarray(values)
    return zstandard.ZstdCompressor(level=1).compress(raw.view(np.uint8).reshape(len(raw), raw.itemsize).T.tobytes()) if len(raw) else b""


def _u(data: bytes, kind: str) -> np.ndarray:
    if not data:
        return np.zeros(0, kind)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _packed(keys: np.ndarray, width: int) -> bytes:
    planes = np.ascontiguousarray(keys.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width].T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes()) if len(keys) else b""


def _unpacked(data: bytes, width: int) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def _spread(keys: np.ndarray) -> np.ndarray:
    """A number from a key that differs from how keys are made."""
    x = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) >> np.uint64(8)


class Plan:
    """Where words go: usual slots by hash, words that outgrow one to several of their own, pairs of these that would outgrow one to their blocks."""

    def __init__(self, size: int, slot_bytes: int, hot: dict[int, int], pins: list[tuple[int, int]]) -> None:
        self.width = key_width(size)
        self.usual = 1 + size // slot_bytes
        self.words = np.asarray(sorted(hot), np.uint64)
        self.parts = np.asarray([hot[int(w)] for w in self.words], np.int64)
        self.first = self.usual + np.cumsum(self.parts) - self.parts
        self.pin_slot = int(self.usual + self.parts.sum())  # a slot of the pinned pairs, without entries
        at = {int(w): i for i, w in enumerate(self.words)}
        self.pins = np.asarray(sorted(at[w] * len(at) + at[c] for w, c in pins), np.int64)
        self.buckets = 1 + self.pin_slot // 4
        self.files = min(MOST_FILES, max(1, self.pin_slot // 8))

    def key(self, hashes: np.ndarray) -> np.ndarray:
        return hashes >> np.uint64(64 - 8 * self.width)

    def bucket(self, keys: np.ndarray) -> np.ndarray:
        return (_spread(keys) % np.uint64(self.buckets)).astype(np.int64)

    def dealt(self, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(bucket, places of its keys) of each bucket that has keys; the order hangs on the keys only."""
        bucket = self.bucket(keys)
        order = np.argsort(bucket, kind="stable")
        for places in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            if len(places):
                yield int(bucket[places[0]]), places


def frequent(docs: DataFrame, size: int, part_bytes: int, sample_bytes: int = 32 << 20) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """Words whose share of the texts is more than ``part_bytes``, with the slots of each, and pairs (word, word before) of which the same holds. Shares below 1 in 10,000 are never split, so there are at most 10,000."""
    if size <= part_bytes:
        return {}, []
    every = 1 + size // sample_bytes
    sample = docs.filter(F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.substring("text", 1, 64)), F.lit(every)) == 0) if every > 1 else docs

    def count(known: dict[bytes | None, int] | None) -> dict[tuple[int, int], int]:
        def told(seen: Counter) -> pa.RecordBatch:
            rows = [(END if w is None else xxhash.xxh3_64_intdigest(w), 0, n) for w, n in seen.items()] if known is None else [(*k, n) for k, n in seen.items()]
            return _batch("word long, before long, n long", [tuple(x - (1 << 64) if x >= 1 << 63 else x for x in r) for r in rows])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: Counter = Counter()
            for batch in slices(batches):
                for text in batch.column(0):
                    words = [*(text.as_py() or "").encode("utf-8", "replace").lower().split(), None]
                    if known is None:
                        seen.update(words)
                    else:
                        ids = [START, *(known.get(xxhash.xxh3_64_intdigest(w) if w is not None else END, 0) for w in words)]
                        seen.update(p for p in zip(ids[1:], ids, strict=False) if p[0] and p[1])
                if len(seen) > 200_000:
                    yield told(seen)
                    seen.clear()
            yield told(seen)

        made = sample.select("text").mapInArrow(run, "word long, before long, n long").groupBy("word", "before").agg(F.sum("n").alias("n"))
        made = materialise(made, "pitman-yor-sample")
        if known is None:
            total.append(made.agg(F.sum("n")).first()[0] or 1)
        least = max(part_bytes / size, 1e-4) * total[0]
        return {(r.word % (1 << 64), r.before % (1 << 64)): r.n for r in made.filter(F.col("n") > least).collect()}

    total: list[int] = []
    hot = {w: 1 + int(n / total[0] * size / part_bytes) for (w, _), n in count(None).items()}
    pins = [p for p in count({w: w for w in hot}) if p[1] in hot] if hot else []
    return hot, pins


def encode_blocks(docs: DataFrame, plan: Plan, block_tokens: int = 1 << 19) -> DataFrame:
    """For each block of documents one row a slot with its words' entries, and one with the documents and the entries of pinned pairs (slot below 0)."""

    def packed(block: int, ids: list, lengths: list[int], hashes: list[np.ndarray]) -> Iterator[tuple]:
        word = np.concatenate(hashes)
        words, inverse = np.unique(np.append(word, np.uint64(START)), return_inverse=True)
        start, local = inverse[-1], inverse[:-1].astype(np.uint64)
        before = np.empty_like(local)
        before[1:] = local[:-1]
        before[np.cumsum(lengths) - lengths] = start
        doc = np.repeat(np.arange(len(lengths), dtype=np.uint64), lengths)
        entry, times = np.unique(local << np.uint64(40) | before << np.uint64(16) | doc, return_counts=True)
        word, ctx, doc = (entry >> np.uint64(40)).astype(np.int64), (entry >> np.uint64(16) & np.uint64(0xFFFFFF)).astype(np.int64), (entry & np.uint64(0xFFFF)).astype("<u2")
        flags = np.asarray([fold(i) % 10 != 0 for i in ids])
        times = np.where(flags[doc], times, -times).astype("<i4")  # held-out entries are negative
        hot = np.full(len(words), -1)
        _, own, at = np.intersect1d(words, plan.words, assume_unique=True, return_indices=True)
        hot[own] = at
        slot = ((words >> np.uint64(20)) % np.uint64(plan.usual)).astype(np.int64)[word]
        split = np.flatnonzero(hot[word] >= 0)
        which = hot[word[split]]
        slot[split] = plan.first[which] + (_spread(plan.key(words[ctx[split]])) >> np.uint64(20)).astype(np.int64) % plan.parts[which] if len(split) else slot[split]
        pinned, at = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(plan.pins) and len(split):
            code = np.where(hot[ctx[split]] >= 0, which * len(plan.words) + hot[ctx[split]], -1)
            at = np.searchsorted(plan.pins, code)
            held = plan.pins[np.minimum(at, len(plan.pins) - 1)] == code
            pinned, at = split[held], at[held]
        yield (-1 - block % 64, block, *[b""] * 5, _ids(ids), _z(np.asarray(lengths, "<u4")), _z(at.astype("<u4")), _z(doc[pinned]), _z(times[pinned]))
        slot[pinned] = -1
        order = np.argsort(slot, kind="stable")[len(pinned) :]
        for some in np.split(order, np.flatnonzero(np.diff(slot[order])) + 1):
            if len(some):
                first = np.flatnonzero(np.append(True, np.diff(word[some]) != 0))
                each = np.diff(np.append(first, len(some)))
                yield (int(slot[some[0]]), block, _z(words[word[some[first]]]), _z(each.astype("<u4")), _packed(plan.key(words[ctx[some]]), plan.width), _z(doc[some]), _z(times[some]), *[b""] * 5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        part, n = TaskContext.get().partitionId(), 0
        ids, lengths, hashes, held = [], [], [], 0
        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = (text.as_py() or "").encode("utf-8", "replace").lower().split()
                if len(known) > 200_000:
                    known.clear()
                for w in set(words).difference(known):
                    known[w] = xxhash.xxh3_64_intdigest(w)
                h = np.empty(len(words) + 1, np.uint64)
                h[:-1] = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
                h[-1] = END
                # a block's numbers have 16 bits for documents and 24 for distinct words
                ids.append(doc_id)
                lengths.append(len(h))
                hashes.append(h)
                held += len(h)
                if held >= block_tokens or len(ids) == 1 << 16:
                    yield _batch(_BLOCK, list(packed(part << 24 | n, ids, lengths, hashes)))
                    ids, lengths, hashes, held, n = [], [], [], 0, n + 1
                    release()
        if ids:
            yield _batch(_BLOCK, list(packed(part << 24 | n, ids, lengths, hashes)))
        known.clear()
        release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _BLOCK)


def build_tables(blocks: DataFrame, plan: Plan) -> DataFrame:
    """One row a slot: counts of its words, of its (word, context) pairs, and the entries of each pair; block rows pass."""

    def run(key, group):
        slot, rows = key[0].as_py(), group.to_pylist()
        if slot < 0:
            cells = [(slot, *[b""] * 5, r["block"], *[b""] * 3, r["docs"], r["lengths"], r["pins"], r["pin_doc"], r["pin_times"]) for r in rows]
        else:
            rows.sort(key=lambda r: r["block"])
            words, word = np.unique(np.concatenate([_u(r["words"], "<u8") for r in rows]), return_inverse=True)
            word = np.repeat(word, np.concatenate([_u(r["counts"], "<u4") for r in rows]))
            ctx = np.concatenate([_unpacked(r["ctx"], plan.width) for r in rows])
            where = np.concatenate([_u(r["doc"], "<u2").astype(np.uint64) + np.uint64(r["block"] << 16) for r in rows])
            times = np.concatenate([_u(r["times"], "<i4") for r in rows])
            order = np.lexsort((ctx, word))
            word, ctx, where, times = word[order], ctx[order], where[order], times[order]
            first = np.flatnonzero(np.append(True, (np.diff(word) != 0) | (ctx[1:] != ctx[:-1])))
            learned = np.add.reduceat(np.maximum(times, 0).astype(np.int64), first)
            of, runs = word[first], np.diff(np.append(first, len(word)))
            count = np.bincount(of, learned, minlength=len(words)).astype("<i8")
            hot = np.full(len(words), -1 if slot < plan.usual else int(np.searchsorted(plan.first, slot, "right")) - 1, "<i4")
            cells = [(slot, _z(count), _z(hot), _z(of.astype("<u4")), _packed(ctx[first], plan.width), _z(learned.astype("<u4")), -1, _z(runs.astype("<u4")), _z(where.astype("<u8")), _z(np.abs(times).astype("<u4")), *[b""] * 5)]
        del rows
        out = pa.Table.from_batches([_batch(_TABLE, cells)])
        release()
        return out

    return blocks.groupBy("slot").applyInArrow(run, _TABLE)


class Pairs:
    """The pairs of one slot; ``live`` are those of several customers, the only ones whose tables can change."""

    def __init__(self, row: dict, plan: Plan) -> None:
        self.slot = row["slot"]
        self.words = _u(row["word_counts"], "<i8")
        self.hot = _u(row["hot"], "<i4")
        self.of = _u(row["pair_words"], "<u4").astype(np.int64)
        self.ctx = _unpacked(row["pair_ctx"], plan.width)
        self.n = _u(row["pair_counts"], "<u4").astype(np.int64)
        self.live = np.flatnonzero(self.n > 1)

    def tables(self, live: np.ndarray) -> np.ndarray:
        out = np.minimum(self.n, 1)
        out[self.live] = live
        return out

    def customers(self, tables: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, tables, minlength=len(self.words)).astype(np.int64)


@lru_cache(8)
def stirling(discount: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers of up to EXACT customers: S(n + 1, t) = S(n, t - 1) + (n - discount t) S(n, t)."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[1, 1] = 0.0
    for n in range(1, EXACT):
        for t in range(1, n + 2):
            stay = out[n, t] + np.log(n - discount * t) if t <= n and n > discount * t else -np.inf
            out[n + 1, t] = np.logaddexp(out[n, t - 1], stay)
    return out


def draw_tables(parties: np.ndarray, others: np.ndarray, prior: np.ndarray, strength: float, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of parties of the given sizes, given the tables of others in their restaurants and the parent's probability of their dishes."""
    out = np.minimum(parties, 1)
    numbers = stirling(discount)
    for n in range(2, EXACT + 1):
        at = np.flatnonzero(parties == n)
        if len(at):
            grow = np.cumsum(np.log(strength + discount * (others[at, None] + np.arange(n))), axis=1)
            chance = numbers[n, 1 : n + 1] + grow + np.log(prior[at])[:, None] * np.arange(1, n + 1)
            out[at] = 1 + np.argmax(chance + rng.gumbel(size=chance.shape), axis=1)
    live, n = np.flatnonzero(parties > EXACT), 1
    while len(live):
        step = 1 if n < 64 else n // 8  # one by one, then in groups of an eighth of those seated
        some = np.minimum(step, parties[live] - n)
        opening = (strength + discount * (others[live] + out[live])) * prior[live]
        chance = opening / (opening + np.maximum(n - discount * out[live], 1e-9))
        out[live] += rng.binomial(some, np.minimum(chance, 1.0))
        n += step
        live = live[parties[live] > n]
    return out


class Model:
    """What all tasks know: totals and discounts, and for each sweep the parent's totals and its customers and tables of the words with slots of their own."""

    def __init__(self, n: int, v: int, discount: float, root_discount: float, strength: float, seed: int) -> None:
        self.n, self.v, self.discount, self.root_discount, self.strength, self.seed = n, v, discount, root_discount, strength, seed
        self.sweeps: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        self.hot_counts = np.zeros(0, np.int64)

    def parent(self, customers: np.ndarray, tables: np.ndarray, sweep: int, without: np.ndarray | int = 0) -> np.ndarray:
        """The parent's probability of words, without some of their customers."""
        m, s = self.sweeps[sweep][:2]
        fresh = (self.strength + self.root_discount * s) / (self.v + 1)
        left = customers - without
        return (left - self.root_discount * np.minimum(tables, left) + fresh) / (self.strength + m - without)

    def seats(self, own: Pairs, customers: np.ndarray, tables: np.ndarray, sweep: int) -> tuple[np.ndarray, np.ndarray]:
        """Customers and tables of the slot's words at the parent; those of words with slots of their own are known to all."""
        _, _, m, s = self.sweeps[sweep]
        known = own.hot >= 0
        if not known.any():
            return customers, tables
        return np.where(known, m[own.hot] if len(m) else 0, customers), np.where(known, s[own.hot] if len(s) else 0, tables)


def _ask(own: Pairs, plan: Plan, sweep: int, tables: np.ndarray) -> list[tuple]:
    """Questions for the tables of the live pairs' contexts, with how many more than one table each these pairs hold themselves."""
    keys, inverse = np.unique(own.ctx[own.live], return_inverse=True)
    more = np.bincount(inverse, tables - 1, minlength=len(keys)).astype("<u4")
    return [(_ASK, b, own.slot, sweep, _packed(keys[at], plan.width), _z(more[at]), b"") for b, at in plan.dealt(keys)]


def _answered(rows: list[dict], keys: np.ndarray, plan: Plan, name: str, kind: str, width: int = 1) -> np.ndarray:
    by = {r["bucket"]: r for r in rows if r["kind"] == _TOLD}
    out = np.zeros((len(keys), width), np.int64)
    for b, at in plan.dealt(keys):
        out[at] = _u(by[b][name], kind).reshape(-1, width)
    return out


def first_messages(tables: DataFrame, plan: Plan) -> DataFrame:
    """What each slot's contexts hold at the start, its questions for the first sweep, and its totals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            for row in part.to_pylist():
                own = Pairs(row, plan)
                keys, inverse = np.unique(own.ctx, return_inverse=True)
                n, t = (np.bincount(inverse, x, minlength=len(keys)) for x in (own.n, np.minimum(own.n, 1)))
                rows = [(_HOLDS, b, -1, 0, _packed(keys[at], plan.width), _z(n[at].astype("<u4")), _z(t[at].astype("<u4"))) for b, at in plan.dealt(keys)]
                rows += _ask(own, plan, 0, np.ones(len(own.live), np.int64))
                usual = own.hot < 0
                customers = own.customers(np.minimum(own.n, 1))
                hot = np.bincount(own.hot[~usual], customers[~usual], minlength=len(plan.words))
                counts = np.bincount(own.hot[~usual], own.words[~usual], minlength=len(plan.words))
                totals = [own.words.sum(), (own.words[usual] > 0).sum(), (own.n == 1).sum(), (own.n == 2).sum(), (own.words[usual] == 1).sum(), (own.words[usual] == 2).sum(), customers.sum(), np.minimum(customers[usual], 1).sum()]
                rows.append((_TOTAL, -1, own.slot, 0, b"", _z(np.asarray(totals, "<i8")), _z(np.concatenate([hot, counts]).astype("<i8"))))
                yield _batch(_MESSAGE, rows)
                release()

    return tables.filter("slot >= 0").select(*(x.split()[0] for x in _PAIRS.split(", "))).mapInArrow(run, _MESSAGE)


def sum_contexts(messages: DataFrame, plan: Plan) -> DataFrame:
    """One row a bucket: its contexts with their customers and tables at the start."""

    def run(key, group):
        rows = group.to_pylist()
        keys, at = np.unique(np.concatenate([_unpacked(r["keys"], plan.width) for r in rows]), return_inverse=True)
        n, t = (np.bincount(at, np.concatenate([_u(r[c], "<u4") for r in rows]), minlength=len(keys)) for c in ("a", "b"))
        return pa.Table.from_batches([_batch(_MESSAGE, [(_HOLDS, key[0].as_py(), -1, 0, _packed(keys, plan.width), _z(n.astype("<u8")), _z(t.astype("<u8")))])])

    return messages.filter(F.col("kind") == _HOLDS).groupBy("bucket").applyInArrow(run, _MESSAGE)


def answer(questions: DataFrame, contexts: DataFrame, plan: Plan, sweeps: list[int], whole: bool = False) -> DataFrame:
    """Tables of the contexts asked for: at the start and what slots hold more, for each of the sweeps; whole: also their customers, for questions of sweep -1."""

    def run(a, b):
        rows, held = a.to_pylist(), b.to_pylist()
        if not held or not rows:
            return pa.Table.from_batches([_batch(_MESSAGE, [])])
        keys, n, t = _unpacked(held[0]["keys"], plan.width), _u(held[0]["a"], "<u8"), _u(held[0]["b"], "<u8").astype(np.int64)
        tables = np.repeat(t[:, None], len(sweeps), axis=1)
        places = {}
        for r in rows:
            at = np.searchsorted(keys, _unpacked(r["keys"], plan.width))
            if r["sweep"] in sweeps:
                np.add.at(tables[:, sweeps.index(r["sweep"])], at, _u(r["a"], "<u4"))
            if r["sweep"] == (-1 if whole else sweeps[0]):
                places[r["slot"]] = at
        out = [(_TOLD, rows[0]["bucket"], slot, 0, b"", _z(tables[at].astype("<u8").ravel()), _z(n[at].astype("<u8")) if whole else b"") for slot, at in sorted(places.items())]
        del rows, held, keys, n, t, tables, places
        release()
        return pa.Table.from_batches([_batch(_MESSAGE, out)])

    return questions.groupBy("bucket").cogroup(contexts.groupBy("bucket")).applyInArrow(run, _MESSAGE)


def sweep_slots(tables: DataFrame, messages: DataFrame, plan: Plan, model: Model, sweep: int) -> DataFrame:
    """One sweep: each slot meets the answers to its questions and its state, draws its tables anew and tells its new state, questions and totals."""

    def run(a, b):
        if not a.num_rows:
            return pa.Table.from_batches([_batch(_MESSAGE, [])])
        own, rows = Pairs(a.to_pylist()[0], plan), b.to_pylist()
        state = next((r for r in rows if r["kind"] == _STATE), None)
        live = _u(state["a"], "<u4").astype(np.int64) if state else np.ones(len(own.live), np.int64)
        tables = own.tables(live)
        customers = own.customers(tables)
        seats = _u(state["b"], "<u4").astype(np.int64) if state else np.minimum(customers, 1)
        m, s = model.seats(own, customers, seats, sweep)
        rng = np.random.default_rng((model.seed, sweep, own.slot))
        keys, inverse = np.unique(own.ctx[own.live], return_inverse=True)
        others = _answered(rows, keys, plan, "a", "<u8")[inverse, 0] - live
        of = own.of[own.live]
        prior = model.parent(m[of], s[of], sweep, live)
        live = draw_tables(own.n[own.live], others, prior, model.strength, model.discount, rng)
        tables = own.tables(live)
        customers = own.customers(tables)
        usual = own.hot < 0
        base = np.full(len(customers), 1 / (model.v + 1))
        seats = np.where(usual, draw_tables(np.where(usual, customers, 0), np.maximum(model.sweeps[sweep][1] - seats, 0), base, model.strength, model.root_discount, rng), 0)
        hot = np.bincount(own.hot[~usual], customers[~usual], minlength=len(plan.words))
        out = [(_STATE, -1, own.slot, sweep + 1, b"", _z(live.astype("<u4")), _z(seats.astype("<u4"))), *_ask(own, plan, sweep + 1, live)]
        out.append((_TOTAL, -1, own.slot, sweep + 1, b"", _z(np.asarray([customers.sum(), seats.sum()], "<i8")), _z(hot.astype("<i8"))))
        del own, rows, tables, others, prior, inverse, keys, of, live
        release()
        return pa.Table.from_batches([_batch(_MESSAGE, out)])

    pairs = tables.filter("slot >= 0").select(*(x.split()[0] for x in _PAIRS.split(", ")))
    return pairs.groupBy("slot").cogroup(messages.groupBy("slot")).applyInArrow(run, _MESSAGE)


def _totals(messages: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums over slots; summed in tasks first, so that a row a task comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = _u(x, "<i8"), _u(y, "<i8")
                a, b = (x.copy(), y.copy()) if not len(a) else (a + x, b + y)
        if len(a):
            yield _batch("a binary, b binary", [(_z(a), _z(b))])

    rows = messages.filter(F.col("kind") == _TOTAL).select("a", "b").coalesce(64).mapInArrow(run, "a binary, b binary").collect()
    if not rows:
        return np.zeros(width, np.int64), np.zeros(0, np.int64)
    return sum(_u(r.a, "<i8") for r in rows), sum(_u(r.b, "<i8") for r in rows)


_PART = "block long, docs binary, lengths binary, pins binary, pin_doc binary, pin_times binary, at binary, base binary, score binary, known binary"


def _log_probabilities(own: Pairs, rows: list[dict], plan: Plan, model: Model, kept: list[int]) -> np.ndarray:
    """log10 of each pair's probability, averaged over the kept sweeps."""
    keys, inverse = np.unique(own.ctx, return_inverse=True)
    opened = _answered(rows, keys, plan, "a", "<u8", len(kept))[inverse]
    guests = _answered(rows, keys, plan, "b", "<u8")[inverse, 0]
    states = {r["sweep"]: r for r in rows if r["kind"] == _STATE}
    chance = np.zeros(len(own.n))
    for i, sweep in enumerate(kept):
        live = _u(states[sweep]["a"], "<u4").astype(np.int64) if sweep in states else np.ones(len(own.live), np.int64)
        tables = own.tables(live)
        customers = own.customers(tables)
        seats = _u(states[sweep]["b"], "<u4").astype(np.int64) if sweep in states else np.minimum(customers, 1)
        prior = model.parent(*model.seats(own, customers, seats, sweep), sweep)
        fresh = (model.strength + model.discount * opened[:, i]) * prior[own.of]
        chance += (own.n - model.discount * tables + fresh) / (model.strength + guests)
    return np.log10(chance / len(kept))


def score_slots(tables: DataFrame, messages: DataFrame, plan: Plan, model: Model, kept: list[int]) -> DataFrame:
    """Each block's sums of log probabilities by document, from the entries of all slots."""

    def run(a, b):
        if not a.num_rows:
            return pa.Table.from_batches([_batch("runs binary, docs binary, times binary, base binary, score binary, known binary", [])])
        row = a.to_pylist()[0]
        own = Pairs(row, plan)
        logs = _log_probabilities(own, b.to_pylist(), plan, model, kept)
        words = np.where(own.hot >= 0, model.hot_counts[own.hot] if len(model.hot_counts) else 0, own.words)
        base = np.log10((words + 0.1) / (model.n + 0.1 * (model.v + 1)))[own.of]
        cells = (row["entry_runs"], row["entry_docs"], row["entry_times"], _z(base), _z(logs), _z((words[own.of] > 0).astype("<u1")))
        del row, own, logs, base, words
        release()
        return pa.Table.from_batches([_batch("runs binary, docs binary, times binary, base binary, score binary, known binary", [cells])])

    def summed(where: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
        keys, at = np.unique(where, return_inverse=True)
        return keys, *(np.bincount(at, v, minlength=len(keys)) for v in values)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for part in slices(batches):
            for row in part.to_pylist():
                runs, times = _u(row["runs"], "<u4").astype(np.int64), _u(row["times"], "<u4").astype(float)
                each = [times * np.repeat(_u(row[n], k), runs) for n, k in (("base", "<f8"), ("score", "<f8"), ("known", "<u1"))]
                parts.append(summed(_u(row["docs"], "<u8"), *each))
                held += len(parts[-1][0])
                if held > 400_000:
                    parts = [summed(*map(np.concatenate, zip(*parts, strict=True)))]
                    held = 0
                    release()
        if not parts:
            return
        where, *sums = summed(*map(np.concatenate, zip(*parts, strict=True)))
        del parts
        release()
        block = where >> np.uint64(16)
        for some in np.split(np.arange(len(where)), np.flatnonzero(np.diff(block)) + 1):
            if len(some):
                yield _batch(_PART, [(int(block[some[0]]), *[b""] * 5, _z((where[some] & np.uint64(0xFFFF)).astype("<u2")), _z(sums[0][some]), _z(sums[1][some]), _z(sums[2][some].astype("<u4")))])

    names = [x.split()[0] for x in _PAIRS.split(", ")] + ["entry_runs", "entry_docs", "entry_times"]
    some = tables.filter((F.col("slot") >= 0) & (F.col("slot") < plan.pin_slot)).select(*names)
    scored = some.groupBy("slot").cogroup(messages.groupBy("slot")).applyInArrow(run, "runs binary, docs binary, times binary, base binary, score binary, known binary")
    return scored.mapInArrow(merge, _PART)


def gather(parts: DataFrame, blocks: DataFrame, plan: Plan, model: Model, pin_logs: np.ndarray) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every row, block by block."""
    pin_counts = model.hot_counts[plan.pins // max(1, len(plan.words))] if len(plan.pins) else np.zeros(0, np.int64)
    pin_base = np.log10((pin_counts + 0.1) / (model.n + 0.1 * (model.v + 1)))

    def run(key, group):
        rows = group.to_pylist()
        whole = next(r for r in rows if r["docs"])
        lengths = _u(whole["lengths"], "<u4").astype(np.int64)
        sums = np.zeros((3, len(lengths)))
        for r in sorted((r for r in rows if not r["docs"]), key=lambda r: (r["at"], r["base"])):
            at = _u(r["at"], "<u2")
            for k, (name, kind) in enumerate((("base", "<f8"), ("score", "<f8"), ("known", "<u4"))):
                sums[k, at] += _u(r[name], kind)
        pins, at, times = _u(whole["pins"], "<u4"), _u(whole["pin_doc"], "<u2"), np.abs(_u(whole["pin_times"], "<i4"))
        if len(pins):
            for k, each in enumerate((pin_base[pins], pin_logs[pins], pin_counts[pins] > 0)):
                np.add.at(sums[k], at, times * each)
        ids = _named(whole["docs"])
        cells = {"doc_id": pa.array(ids, pa.int64()), "held_out": pa.array([fold(i) % 10 == 0 for i in ids]), "n_tokens": pa.array(lengths), "n_known": pa.array(np.rint(sums[2]).astype(np.int64)), "train_tokens": pa.array(np.full(len(ids), model.n)), "base_score": pa.array(sums[0]), "score": pa.array(sums[1])}
        return pa.table(cells | {"perplexity": pa.array(10 ** (-sums[1] / lengths))})

    whole = blocks.select("block", "docs", "lengths", "pins", "pin_doc", "pin_times", *(F.lit(None).cast("binary").alias(n) for n in ("at", "base", "score", "known")))
    return whole.unionByName(parts).groupBy("block").applyInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def store(tables: DataFrame, plan: Plan, name: str, mode: str = "error") -> DataFrame:
    """Writes tables bucketed by slot, so that steps which meet them by slot don't shuffle them."""
    spark = tables.sparkSession
    # rows are large: sizes are looked at after each, and files can be cut between them
    writer = tables.write.option("parquet.page.size.row.check.min", "1").option("parquet.block.size.row.check.min", "1").option("parquet.block.size", str(16 << 20)).option("compression", "zstd")
    writer.mode(mode).bucketBy(plan.files, "slot").option("path", f"{work_dir(spark)}/tessera/{name}").format("parquet").saveAsTable(name)
    return spark.table(name)


def pin_row(blocks: DataFrame, plan: Plan) -> tuple:
    """The table row of the pinned pairs, counted in their blocks: at most one row a pair comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(plan.pins), np.int64)
        for batch in batches:
            for pins, times in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts += np.bincount(_u(pins, "<u4"), np.maximum(_u(times, "<i4"), 0), minlength=len(counts)).astype(np.int64)
        yield _batch("pin long, n long", list(enumerate(counts.tolist())))

    n = np.zeros(len(plan.pins), np.int64)
    for r in blocks.select("pins", "pin_times").mapInArrow(run, "pin long, n long").groupBy("pin").agg(F.sum("n").alias("n")).collect():
        n[r.pin] = r.n
    word, ctx = plan.pins // len(plan.words), plan.key(plan.words)[plan.pins % len(plan.words)]
    order = np.lexsort((ctx, word))
    words = np.unique(word)
    of = np.searchsorted(words, word[order])
    count = np.bincount(of, n[order], minlength=len(words)).astype("<i8")
    return plan.pin_slot, _z(count), _z(words.astype("<i4")), _z(of.astype("<u4")), _packed(ctx[order], plan.width), _z(n[order].astype("<u4")), -1, *[b""] * 8


def learn(tables: DataFrame, plan: Plan, sweeps: int, strength: float = 1.0, seed: int = 11) -> tuple[Model, DataFrame, list[DataFrame]]:
    """The model, the contexts by bucket, and the messages of each sweep."""
    first = materialise(first_messages(tables, plan), "pitman-yor-start")
    contexts = materialise(sum_contexts(first, plan), "pitman-yor-contexts")
    totals, hot = _totals(first, 8)
    hot = hot if len(hot) else np.zeros(2 * len(plan.words), np.int64)
    hot_customers, hot_counts = hot[: len(plan.words)], hot[len(plan.words) :]
    rate = lambda once, twice: float(min(0.97, max(0.05, once / max(1, once + 2 * twice))))
    model = Model(int(totals[0]), int(totals[1] + (hot_counts > 0).sum()), rate(totals[2], totals[3]), rate(totals[4] + (hot_counts == 1).sum(), totals[5] + (hot_counts == 2).sum()), strength, seed)
    model.hot_counts = hot_counts
    hot_seats = np.minimum(hot_customers, 1)
    model.sweeps.append((int(totals[6]), int(totals[7] + hot_seats.sum()), hot_customers, hot_seats))
    told = [first]
    for sweep in range(sweeps):
        replies = answer(told[-1].filter(F.col("kind") == _ASK), contexts, plan, [sweep])
        states = told[-1].filter(F.col("kind") == _STATE)
        told.append(materialise(sweep_slots(tables, replies.unionByName(states), plan, model, sweep), "pitman-yor-sweep"))
        (m, s), hot_customers = _totals(told[-1], 2)
        hot_customers = hot_customers if len(hot_customers) else np.zeros(len(plan.words), np.int64)
        rng = np.random.default_rng((seed, sweep))
        hot_seats = draw_tables(hot_customers, np.maximum(model.sweeps[-1][1] - hot_seats, 0), np.full(len(hot_customers), 1 / (model.v + 1)), strength, model.root_discount, rng)
        model.sweeps.append((int(m), int(s + hot_seats.sum()), hot_customers, hot_seats))
    return model, contexts, told


def score_documents(docs: DataFrame, sweeps: int = 3, burn_in: int = 1, slot_bytes: int = 4 << 20, block_tokens: int = 1 << 19, hot: tuple[dict[int, int], list[tuple[int, int]]] | None = None, strength: float = 1.0, seed: int = 11) -> DataFrame:
    """Learns from the rows outside the held-out fold and scores all rows. hot: words to split with their slots, and pairs to keep in their blocks; looked for if not given."""
    spark: SparkSession = docs.sparkSession
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    plan = Plan(size, slot_bytes, *(frequent(docs, size, 2 * slot_bytes) if hot is None else hot))
    name = f"pitman_yor_{uuid.uuid4().hex}"
    tables = store(build_tables(encode_blocks(docs, plan, block_tokens), plan), plan, name)
    blocks = tables.filter("slot < 0")
    if len(plan.pins):
        row = spark.createDataFrame([pin_row(blocks, plan)], _TABLE)
        tables = store(row, plan, name, "append")
        blocks = tables.filter("slot < 0")
    model, contexts, told = learn(tables, plan, sweeps, strength, seed)
    kept = list(range(min(burn_in, sweeps - 1) + 1, sweeps + 1)) if sweeps else [0]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            for row in part.to_pylist():
                own = Pairs(row, plan)
                keys = np.unique(own.ctx)
                yield _batch(_MESSAGE, [(_ASK, b, own.slot, -1, _packed(keys[at], plan.width), b"", b"") for b, at in plan.dealt(keys)])
                release()

    def messages(slots: DataFrame) -> DataFrame:
        pairs = slots.select(*(x.split()[0] for x in _PAIRS.split(", ")))
        more = [told[k].filter(F.col("kind") == _ASK) for k in kept]
        questions = pairs.mapInArrow(ask, _MESSAGE)
        for m in more:
            questions = questions.unionByName(m)
        replies = answer(questions, contexts, plan, kept, whole=True)
        for k in kept:
            replies = replies.unionByName(told[k].filter(F.col("kind") == _STATE))
        return replies

    pin_logs = np.zeros(len(plan.pins))
    if len(plan.pins):
        alone = tables.filter(F.col("slot") == plan.pin_slot)
        order = np.lexsort((plan.key(plan.words)[plan.pins % len(plan.words)], plan.pins // len(plan.words)))
        row = alone.select(*(x.split()[0] for x in _PAIRS.split(", "))).first().asDict()
        rows = [r.asDict() for r in messages(alone).filter(F.col("slot") == plan.pin_slot).collect()]  # one row a bucket and sweep
        pin_logs[order] = _log_probabilities(Pairs(row, plan), rows, plan, model, kept)
    slots = tables.filter((F.col("slot") >= 0) & (F.col("slot") < plan.pin_slot))
    # the scores are written, so that the bucketed table and the messages can go
    out = materialise(gather(score_slots(tables, messages(slots), plan, model, kept), blocks, plan, model, pin_logs), "pitman-yor-scores")
    discard(tables, contexts, *told)
    spark.sql(f"DROP TABLE {name}")
    return out
