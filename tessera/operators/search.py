"""Retrieval: keyword search by BM25, exact vector search, reciprocal-rank fusion."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.functions.text import FOLDED, raw_tokens
from tessera.operators import access as acl
from tessera.plans import store

K1, B = 1.2, 0.75


#: Bytes of distinct words that are sent to all tasks at once, and of passages whose automaton a task holds (some fifty times as large).
WORD_BYTES, PASSAGE_BYTES = 32 << 20, 8 << 20
_LETTERS = FOLDED | {"\u017f": "s"}


def tokens_of(text: str) -> list[str]:
    """The words of one text, as ``raw_tokens`` gives them."""
    if not text.isascii():
        for letter, by in _LETTERS.items():  # most are in no text, which costs less to see than a translation letter by letter
            if letter in text:
                text = text.replace(letter, by)
    return _TOKEN(text.lower())


_TOKEN = re.compile("[a-z0-9]+").findall

#: What Python holds of a batch at once: bytes of texts or counts (a single row may be larger), and (document, term, question) entries.
PIECE_BYTES, ENTRIES = 2 << 20, 1 << 18


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts batches, so that what is made of one is bounded by bytes, whatever number of rows Spark sends."""
    for batch in batches:
        rows = max(1, int(batch.num_rows * PIECE_BYTES / max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def gain(tf: np.ndarray, length: np.ndarray, mean: float) -> np.ndarray:
    """What a term adds to a document's score, before its weight."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def weight(n: int, df: np.ndarray) -> np.ndarray:
    return np.log(1 + (n - df + 0.5) / (df + 0.5))


def term_counts(words: DataFrame, terms: list[str]) -> DataFrame:
    """(id, length, terms, times, allowed) of the rows (id, said, allowed) that hold one of the terms, told by their number; rows with ``n`` sum up the documents and words of a task's batches."""
    sent = words.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})
    kind = words.schema["id"].dataType

    def run(batches):
        known = sent.value
        for batch in pieces(batches):
            ids, sizes, which, times, total, at = [], [], [], [], 0, []
            for i, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                found = tokens_of(text.as_py())
                total += len(found)
                held = Counter(w for w in map(known.get, found) if w is not None)
                if held:
                    at.append(i)
                    ids.append(doc)
                    sizes.append(len(found))
                    which.append(sorted(held))
                    times.append([held[t] for t in which[-1]])
            none = [None]
            columns = (ids + none, sizes + none, which + none, times + none, [None] * len(ids) + [batch.num_rows], [None] * len(ids) + [total])
            types = (to_arrow_type(kind), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.int64())
            groups = batch.column(2).take(pa.array([*at, None], pa.int64()))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, types, strict=True)), groups], ["id", "length", "terms", "times", "n", "total", "allowed"])

    return words.mapInArrow(run, f"id {kind.simpleString()}, length int, terms array<int>, times array<int>, n long, total long, allowed array<string>")


def _best(who: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best of each question, ties to the smaller id."""
    order = np.lexsort((np.unique(ids, return_inverse=True)[1], -scores, who))
    who, ids, scores = who[order], ids[order], scores[order]
    keep = np.arange(len(who)) - np.searchsorted(who, who) < k
    return who[keep], ids[keep], scores[keep]


def bm25_top_k(docs: DataFrame, questions: DataFrame, k: int = 20, id_col: str = "doc_id", qid: str = "qid", columns: tuple[str, ...] = ("text",), block: int = 4096, access: bool = False) -> DataFrame:
    """(qid, doc_id, score, rank) for the texts of ``columns`` of the documents and column ``text`` of the questions; scores to six digits, ties to the smaller id.

    The documents are read once for all questions: a task folds and splits each text and keeps how often it holds the asked words, and how long it is. From these counts, stored, come the documents of each word, then the
    scores; a task keeps its k best for each question and only these meet. What is sent to all tasks is bounded: the asked words (beyond ``WORD_BYTES`` the questions are asked in several passes) and blocks of questions.

    access: a question finds only documents whose ``allowed_groups`` hold one of its ``groups`` (see ``access``), its k best among these; the words' weights are those of the whole table.
    """
    none = F.array().cast("array<string>")
    words = docs.select(F.col(id_col).alias("id"), F.concat_ws("\n", *(F.coalesce(c, F.lit("")) for c in columns)).alias("said"), (acl.folded(F.col("allowed_groups")) if access else none).alias("allowed"))
    asked = store.materialise(questions.select(F.col(qid).alias("qid"), F.explode(F.array_distinct(raw_tokens(F.col("text")))).alias("term"), (acl.folded(F.col("groups")) if access else none).alias("groups")), "asked")
    size = asked.select(F.sum(F.octet_length("term") + 16)).first()[0] or 0
    passes = 1
    if size > WORD_BYTES:  # words that many questions share count once
        passes = 1 + (asked.select("term").distinct().select(F.sum(F.octet_length("term") + 16)).first()[0] or 0) // WORD_BYTES
    parts = [_scored(words, asked.filter(F.pmod(F.xxhash64("qid"), F.lit(passes)) == p) if passes > 1 else asked, k, block, access) for p in range(passes)]
    hits = reduce(DataFrame.unionByName, parts)
    ranked = hits.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)
    return ranked.select(F.col("qid").alias(qid), F.col("id").alias(id_col), F.round("score", 6).alias("score"), "rank")


def _scored(words: DataFrame, asked: DataFrame, k: int, block: int, access: bool) -> DataFrame:
    """(qid, id, score) of each task's k best."""
    session, kind = words.sparkSession, words.schema["id"].dataType
    terms = sorted(r.term for r in asked.select("term").distinct().collect())
    counts = store.materialise(term_counts(words, terms), "term-counts")
    n, total = counts.filter("n is not null").select(F.sum("n"), F.sum("total")).first()
    held = np.zeros(len(terms), np.int64)
    for r in counts.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect():  # no more than the words that were sent
        held[r.t] = r.df
    mean, weights = (total or 0) / max(1, n or 0) or 1.0, weight(n or 0, held)
    blocks = -(-asked.select("qid").distinct().count() // block) or 1
    number, rows = {t: i for i, t in enumerate(terms)}, counts.filter("n is null").select("id", "length", "terms", "times", "allowed")

    def part(p: int) -> DataFrame:
        own = asked.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == p)
        told = sorted((number[r.term], r.qid) for r in own.select("qid", "term").collect())  # the words of a block of questions
        names = sorted({q for _, q in told})
        at = {q: i for i, q in enumerate(names)}
        starts = np.searchsorted([t for t, _ in told], np.arange(len(terms) + 1))
        groups = {r.qid: r.groups for r in own.groupBy("qid").agg(F.min("groups").alias("groups")).collect()} if access else {}  # as many rows as the block has questions
        callers = pa.array([groups.get(q, []) for q in names], pa.list_(pa.string()))
        sent = session.sparkContext.broadcast((starts, np.asarray([at[q] for _, q in told], np.int64), weights, mean, acl.numbered(callers), acl.bit_sets(callers, acl.numbered(callers))))

        def run(batches):
            starts, askers, weights, mean, known, may = sent.value
            held, count = [], 0
            for batch in pieces(batches):
                lengths = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
                doc, term, tf = np.repeat(np.arange(batch.num_rows), lengths), batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy()
                value = gain(tf, batch.column(1).to_numpy()[doc], mean) * weights[term]
                ids = np.asarray(batch.column(0).to_pylist(), object if pa.types.is_string(batch.column(0).type) else None)
                open_to = acl.bit_sets(batch.column(4), known) if access else None
                fan = starts[term + 1] - starts[term]
                ends = np.cumsum(fan)
                for low in range(0, int(ends[-1]) if len(ends) else 0, ENTRIES):  # so many (document, term, question) at once; a document's stand together
                    first, last = np.searchsorted(ends, (low, low + ENTRIES), "right")
                    first = np.searchsorted(doc, doc[first]) if first < len(doc) else len(doc)
                    last = np.searchsorted(doc, doc[last]) if last < len(doc) else len(doc)
                    some = np.arange(first, last)
                    if not fan[some].sum():
                        continue
                    entry = np.repeat(some, fan[some])
                    who = askers[np.arange(len(entry)) - np.repeat(np.cumsum(fan[some]) - fan[some], fan[some]) + starts[term[entry]]]
                    pairs, place = np.unique(doc[entry] * len(names) + who, return_inverse=True)
                    scores = np.floor(np.bincount(place, value[entry]) * 1e6 + 0.5) / 1e6
                    if access:
                        seen = acl.share(open_to[pairs // len(names)], may[pairs % len(names)])
                        pairs, scores = pairs[seen], scores[seen]
                    held.append((pairs % len(names), ids[pairs // len(names)], scores))
                    count += len(pairs)
                    if count > 200_000 + 2 * k * len(names):
                        held = [_best(*(np.concatenate(x) for x in zip(*held, strict=True)), k)]
                        count = len(held[0][0])
            if held:
                who, ids, scores = _best(*(np.concatenate(x) for x in zip(*held, strict=True)), k)
                yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(ids.tolist(), to_arrow_type(kind)), pa.array(scores)], ["number", "id", "score"])

        asked_by = session.createDataFrame(list(enumerate(names)), f"number long, qid {asked.schema['qid'].dataType.simpleString()}")
        return rows.mapInArrow(run, f"number long, id {kind.simpleString()}, score double").join(F.broadcast(asked_by), "number").select("qid", "id", "score")  # as many rows as the block has questions

    return reduce(DataFrame.unionByName, map(part, range(blocks)))


def feedback_vectors(hits: DataFrame, vectors: DataFrame) -> DataFrame:
    """(qid, vec): the mean vector of what a question's keyword search has found; hits: (qid, id), vectors: (id, vec). None where no hit has a vector."""
    each = hits.select("qid", "id").join(vectors.filter("vec is not null"), "id").select("qid", F.posexplode(F.col("vec").cast("array<double>")).alias("at", "x"))
    means = each.groupBy("qid", "at").agg(F.avg("x").alias("x"))
    return means.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("at", "x")))["x"].alias("vec"))  # one number a dimension


def vector_top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, block: int = 8192, query_block: int = 2048, own: bool = True, access: bool = False) -> DataFrame:
    """(qid, id, score, rank) by cosine for (id, vec) and (qid, vec); own: questions are rows of the same table and never find their own id; scores to six digits, ties to the smaller id.

    Queries and vectors meet block by block; a block pair gives its k best, so no pair table is made. A query meets vectors of its own length only; null and zero vectors take no part. Ids may be of any type that can be ordered.
    access: a query finds only vectors whose ``allowed_groups`` hold one of its ``groups`` (see ``access``).
    """
    vectors, queries = vectors.filter(usable("vec")), queries.filter(usable("vec"))
    n, m = max(1, -(-vectors.count() // block)), max(1, -(-queries.count() // query_block))
    right = vectors.select(F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("v"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("q"), F.size("vec").alias("d"), "id", F.col("vec").cast("array<double>").alias("vec"), *([acl.folded(F.col("allowed_groups")).alias("allowed")] if access else []))
    left = queries.select(F.pmod(F.xxhash64("qid"), F.lit(m)).cast("int").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("v"), F.size("vec").alias("d"), "qid", F.col("vec").cast("array<double>").alias("vec"), *([acl.folded(F.col("groups")).alias("groups")] if access else []))
    near = meet_in_blocks(left, right, ["q", "v", "d"], k, own, access)
    return near.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)


def usable(c: str) -> Column:
    """Whether a vector has a direction."""
    return F.col(c).isNotNull() & F.exists(F.col(c).cast("array<double>"), lambda x: x != 0)


def matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The rows of vectors of one length."""
    flat = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(flat), -1)


#: Scores, and hits of a block pair, that a task holds at once.
SCORES, HITS = 1 << 19, 1 << 20


def meet_in_blocks(left: DataFrame, right: DataFrame, on: list[str], k: int, own: bool, access: bool = False, cells: bool = False) -> DataFrame:
    """(qid, id, score): the k best by cosine of right (id, vec) for each of left (qid, vec), in each block told by ``on``; vectors of a block have one length. access: of those whose ``allowed`` meet the query's ``groups``.

    cells: of those whose ``cell`` is one of the query's ``cells``. Scores are made for a few queries at a time, so that a task's memory does not grow with its block pair.
    """
    kinds = {"qid": left.schema["qid"].dataType, "id": right.schema["id"].dataType}
    types = {c: to_arrow_type(t) for c, t in kinds.items()}

    def run(a, b):
        if not a.num_rows or not b.num_rows:
            return pa.table({"qid": pa.array([], types["qid"]), "id": pa.array([], types["id"]), "score": pa.array([], pa.float64())})
        b = b.sort_by("id")  # places tell the smaller id
        x, y = matrix(a["vec"]), matrix(b["vec"])
        x_size, y_size = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
        same: dict = {}
        if own:
            ids = set(a["qid"].to_pylist())
            for i, v in enumerate(b["id"].to_pylist()):
                if v in ids:
                    same.setdefault(v, []).append(i)
            same = {i: same[v] for i, v in enumerate(a["qid"].to_pylist()) if v in same}
        if access:
            known = acl.numbered(a["groups"])
            callers, open_to = acl.bit_sets(a["groups"], known), acl.bit_sets(b["allowed"], known)
        meetings = [(np.arange(len(x)), np.arange(len(y)))]
        if cells:
            lists = a["cells"].combine_chunks()
            asked, who = lists.flatten().to_numpy(), np.repeat(np.arange(len(x)), lists.value_lengths().to_numpy())
            cell = b["cell"].to_numpy()
            meetings = ((who[asked == c], np.flatnonzero(cell == c)) for c in np.intersect1d(asked, cell))
        held, count = [], 0
        for queries, places in meetings:
            step = max(1, SCORES // len(places))
            for some in (queries[at : at + step] for at in range(0, len(queries), step)):
                score = np.round(x[some] @ y[places].T / (x_size[some][:, None] * y_size[places]), 6)
                score[np.isnan(score)] = -np.inf
                for i, q in enumerate(some):
                    if q in same:
                        score[i, np.isin(places, same[q])] = -np.inf
                    if access:
                        score[i, ~acl.share(open_to[places], callers[q])] = -np.inf
                least = np.partition(score, -k, axis=1)[:, -k, None] if k < len(places) else -np.inf
                row, col = np.nonzero((score >= least) & (score > -np.inf))
                held.append(_best(some[row], places[col], score[row, col], k))
                count += len(held[-1][0])
                if count > HITS:
                    held = [_best(*(np.concatenate(z) for z in zip(*held, strict=True)), k)]
                    count = len(held[0][0])
        row, col, found = _best(*(np.concatenate(z) for z in zip(*held, strict=True)), k) if held else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        return pa.table({"qid": a["qid"].combine_chunks().take(pa.array(row)), "id": b["id"].combine_chunks().take(pa.array(col)), "score": found})

    return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(run, ", ".join(f"{c} {t.simpleString()}" for c, t in kinds.items()) + ", score double")


def reciprocal_rank_fusion(*lists: DataFrame, k: int = 20, constant: int = 60) -> DataFrame:
    """(qid, id, score, rank) from ranked lists (qid, id, rank)."""
    united = lists[0].select("qid", "id", "rank")
    for other in lists[1:]:
        united = united.unionByName(other.select("qid", "id", "rank"))
    fused = united.groupBy("qid", "id").agg(F.round(F.sum(1 / (F.lit(float(constant)) + F.col("rank"))), 6).alias("score"))
    return fused.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)


def containing(docs: DataFrame, passages: DataFrame, block_bytes: int = PASSAGE_BYTES) -> DataFrame:
    """The rows of docs (column ``text``) with the qid of each passage (qid, text) that they hold whole; a null text holds and is held by none, an empty passage is in every text.

    Passages are looked for inside the scan, all of a block at once; blocks are bounded in bytes, each is sent to all tasks.
    """
    passages = passages.filter("text is not null").select("qid", "text")
    total = passages.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts, names = 1 + total // block_bytes, docs.columns
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes) + f", qid {passages.schema['qid'].dataType.simpleString()}"
    session, told = docs.sparkSession, to_arrow_type(passages.schema["qid"].dataType)

    def held(part: int) -> DataFrame:
        wanted: dict[str, list] = {}
        for r in passages.filter(F.pmod(F.xxhash64("text"), F.lit(parts)) == part).collect():
            wanted.setdefault(r.text, []).append(r.qid)
        sent = session.sparkContext.broadcast(wanted)

        def run(batches):
            import ahocorasick

            machine = ahocorasick.Automaton()
            for text, qids in sent.value.items():
                if text:
                    machine.add_word(text, text)
            if len(machine):
                machine.make_automaton()
            for batch in batches:
                at, found = [], []
                for i, text in enumerate(batch.column(names.index("text")).to_pylist()):
                    if text is not None:
                        hits = {p for _, p in machine.iter(text)} if len(machine) else set()
                        for passage in sorted(hits | ({""} & sent.value.keys())):
                            at += [i] * len(sent.value[passage])
                            found += sent.value[passage]
                rows = batch.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(found, told)], [*names, "qid"])

        return docs.mapInArrow(run, schema)

    return reduce(DataFrame.unionByName, map(held, range(parts)))
