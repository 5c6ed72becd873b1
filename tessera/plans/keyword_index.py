"""A stored inverted index for keyword search: the rows of ``search.bm25_top_k`` without reading the corpus.

The index has the corpus' buckets, and a bucket's documents are dealt to shards of some megabytes of text. A shard is inverted by one task, which splits each text once; its documents are numbered by their ids, and a row of the
empty term holds what the numbers stand for. In a shard a term's postings are dealt by number into blocks, as many as keep a block short, so that the block of a document is known without a look. A block tells the greatest
count and the least length of its postings, from which its greatest score follows whatever the mean length has become. Files are sorted by term, in small row groups with Bloom filters, so a batch of questions
reads the row groups of its terms.

A search is MaxScore in each shard, as all terms of a document are in one: its k best of each question are all that leaves it. The term of a question that can add most is read whole; the best documents found by it are scored
exactly, which gives a score that the shard's k-th best document reaches. Terms that all together stay below that bring no document of their own: their blocks are read only where a document of the other terms, with a score
that can still reach it, may be in them.

``refresh`` follows the versions of a corpus: only buckets that have changed since are indexed anew.
"""

from __future__ import annotations

from array import array
from collections import Counter, defaultdict
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.functions.text import raw_tokens
from tessera.operators.search import K1, WORD_BYTES, B, gain, tokens_of, weight
from tessera.plans import ingest, store, versions

#: Postings of a block on average at most, bytes of a row group, terms that are put into the scan's filter one by one.
BLOCK, GROUP_BYTES, FILTERED = 128, 1 << 20, 512
#: Documents and bytes of text of a shard on average at most, questions that are asked in one pass.
SHARD_ROWS, SHARD_BYTES, QUESTIONS = 1 << 14, 16 << 20, 4096
_NEAR = 2e-6  # scores have six digits


def _gain(tf: Column, length: Column, mean: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def _postings(rows: DataFrame) -> DataFrame:
    """(bucket, part, shard, term, blocks, blk, n, most, least, total, source, ids, lengths, docs, times) for (bucket, source, id, said); a row of the empty term sums up each shard and has its ids and lengths by number."""
    kind, block = rows.schema["id"].dataType, BLOCK
    told = to_arrow_type(kind)
    sizes = rows.groupBy("bucket").agg(F.greatest(F.ceil(F.count(F.lit(1)) / SHARD_ROWS), F.ceil(F.sum(F.octet_length("said")) / SHARD_BYTES), F.lit(1)).cast("int").alias("shards"))
    dealt = rows.join(F.broadcast(sizes), "bucket")  # a row a bucket
    dealt = dealt.select("bucket", F.pmod(F.hash("id"), F.col("shards")).alias("shard"), "source", "id", "said")

    def invert(shard: pa.Table) -> pa.Table:
        shard = shard.take(pc.sort_indices(shard["id"]))
        number: dict[str, int] = defaultdict(count().__next__)
        which, times, held, lengths = array("i"), array("i"), array("i"), array("i")
        for text in shard["said"]:
            found = tokens_of(text.as_py())
            counts = Counter(found)
            which.extend(map(number.__getitem__, counts))
            times.extend(counts.values())
            held.append(len(counts))
            lengths.append(len(found))
        names, lengths = pa.array(list(number), pa.string()), np.asarray(lengths)
        order = pc.sort_indices(names).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        term, doc = place[np.asarray(which)], np.repeat(np.arange(len(held), dtype=np.int32), np.asarray(held))
        blocks = -(-np.bincount(term, minlength=len(order)) // block)
        at = (np.cumsum(blocks) - blocks)[term] + doc % blocks[term]
        by_block = np.argsort(at, kind="stable")  # a block's documents stay in order
        at, term, doc, tf = at[by_block], term[by_block], doc[by_block], np.asarray(times)[by_block]
        first = np.flatnonzero(np.diff(at, prepend=-1))
        n, word = np.diff(first, append=len(at)), term[first]
        most, least = (np.maximum.reduceat(tf, first), np.minimum.reduceat(lengths[doc], first)) if len(at) else (first, first)
        whole = lambda x, y: pa.array(np.concatenate(([x], y)), pa.int32())
        ends = pa.array(np.concatenate(([0, 0], np.cumsum(n))), pa.int32())
        rest = len(first)
        same = lambda c: pa.repeat(shard[c][0], rest + 1)
        own = lambda x, t: pa.concat_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x), pa.nulls(rest, pa.list_(t))])
        ids = shard["id"].combine_chunks()
        columns = {
            "bucket": same("bucket"), "part": same("bucket"), "shard": same("shard"), "term": pa.concat_arrays([pa.array([""]), names.take(pa.array(order[word]))]), "blocks": whole(1, blocks[word]),
            "blk": whole(0, doc[first] % blocks[word]), "n": whole(len(ids), n), "most": whole(0, most), "least": whole(0, least), "total": pa.array([int(lengths.sum())] + [0] * rest, pa.int64()), "source": same("source"),
            "ids": own(ids, told), "lengths": own(pa.array(lengths, pa.int32()), pa.int32()), "docs": pa.ListArray.from_arrays(ends, pa.array(doc, pa.int32())), "times": pa.ListArray.from_arrays(ends, pa.array(tf, pa.int32())),
        }
        return pa.table(columns)

    shape = f"bucket int, part int, shard int, term string, blocks int, blk int, n int, most int, least int, total long, source string, ids array<{kind.simpleString()}>, lengths array<int>, docs array<int>, times array<int>"
    return dealt.groupBy("bucket", "shard").applyInArrow(invert, shape)


def _write(rows: DataFrame, index: str) -> str:
    options = {"parquet.block.size": str(GROUP_BYTES), "parquet.bloom.filter.enabled#term": "true", "parquet.block.size.row.check.min": "16"}
    return versions.write(_postings(rows), index, ["term", "shard", "blk"], options, dealt=True)


def _said(columns: tuple[str, ...]) -> Column:
    return F.concat_ws("\n", *(F.coalesce(c, F.lit("")) for c in columns))


def build(spark: SparkSession, docs: DataFrame, index: str, columns: tuple[str, ...] = ("text",), id_col: str = "doc_id", rows_a_bucket: int = versions.BUCKET_ROWS) -> versions.Version:
    """Indexes a table of documents, in place of what the index held."""
    base = versions.version(spark, index)
    buckets = 1 + docs.count() // rows_a_bucket
    rows = docs.select(F.pmod(F.xxhash64(F.col(id_col)), F.lit(buckets)).cast("int").alias("bucket"), F.lit("").alias("source"), F.col(id_col).alias("id"), _said(columns).alias("said"))
    changed = set(range(buckets)) | versions.folders(spark, index, base).keys()
    return versions.commit(spark, index, base, buckets, changed, _write(rows, index))


def _index(spark: SparkSession, index: str) -> DataFrame | None:
    at = versions.version(spark, index)
    held = versions.folders(spark, index, at)
    if not held:
        return None
    paths = [f"{index.rstrip('/')}/{f}" for f, _, _ in held.values()]
    return spark.read.schema(spark.read.parquet(paths[0]).schema).parquet(*paths)


def refresh(spark: SparkSession, corpus: str, index: str, columns: tuple[str, ...] = ("title", "content")) -> set[int]:
    """Brings the index of a stored corpus up to its newest version and gives the buckets that were indexed anew."""
    source, base, held = versions.version(spark, corpus), versions.version(spark, index), _index(spark, index)
    now = {b: f for b, (f, _, _) in versions.folders(spark, corpus, source).items()}
    former = held is not None and "shard" not in held.columns  # an index without shards is made anew
    known = {r.part: r.source for r in held.filter("term = ''").select("part", "source").distinct().collect()} if held is not None and not former else {}  # a row a bucket
    buckets = source.buckets if source else versions.BUCKETS
    if base and base.buckets != buckets:
        known = {}
    stale = {b for b, f in now.items() if known.get(b) != f}
    gone = (versions.folders(spark, index, base).keys() if former else known.keys()) - now.keys()
    if not stale and not gone and base and base.buckets == buckets:
        return set()
    folders = spark.createDataFrame([(b, now[b]) for b in sorted(stale)], "bucket int, source string")
    rows = versions.read(spark, corpus, ingest.SHAPE, source, stale).withColumn("bucket", ingest.bucket_of(buckets)).join(F.broadcast(folders), "bucket")  # a row a bucket
    data = _write(rows.select("bucket", "source", "id", _said(columns).alias("said")), index)
    versions.commit(spark, index, base, buckets, stale | gone, data, set() if base and base.buckets == buckets else None)
    return stale | gone


def _having(rows: DataFrame, terms: list[str]) -> DataFrame:
    """Rows of these terms. A few are asked for one by one, so that the scan's Bloom filters see them."""
    if not terms:
        return rows.limit(0)
    if len(terms) > FILTERED:
        return rows.filter(F.col("term").isin(terms))
    some = [F.col("term") == t for t in terms]
    while len(some) > 1:
        some = [reduce(Column.__or__, some[i : i + 2]) for i in range(0, len(some), 2)]
    return rows.filter(some[0])


def search(spark: SparkSession, index: str, questions: DataFrame, k: int = 20, qid: str = "qid") -> DataFrame:
    """(qid, id, score, rank) for column ``text`` of the questions: the rows that ``search.bm25_top_k`` gives for the indexed documents."""
    hits, _ = scored(spark, index, questions, k, qid)
    ranked = hits.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)
    return ranked.select(F.col("qid").alias(qid), "id", "score", "rank")


def scored(spark: SparkSession, index: str, questions: DataFrame, k: int, qid: str = "qid") -> tuple[DataFrame, DataFrame]:
    """(qid, id, score) of the k best documents of each shard, and the blocks that were read for them: (term, part, shard, blk, n)."""
    rows = _index(spark, index)
    asked = store.materialise(questions.select(F.col(qid).alias("qid"), F.explode(F.array_distinct(raw_tokens(F.col("text")))).alias("term")), "asked")
    if rows is None:
        none, zero = asked.limit(0), F.lit(0)
        return none.select("qid", F.lit("").alias("id"), F.lit(0.0).alias("score")), none.select("term", zero.alias("part"), zero.alias("shard"), zero.alias("blk"), zero.alias("n"))
    if "shard" not in rows.columns:
        raise ValueError(f"{index} is of a form without shards: build or refresh it")
    size, many = asked.agg(F.coalesce(F.sum(F.octet_length("term") + 16), F.lit(0)), F.count_distinct("qid")).first()
    passes = max(1, -(-many // QUESTIONS), -(-size // WORD_BYTES))  # what a pass sends to all tasks is bounded
    met = [_met(spark, rows, asked.filter(F.pmod(F.xxhash64("qid"), F.lit(passes)) == p) if passes > 1 else asked, k) for p in range(passes)]
    return reduce(DataFrame.unionByName, [hits for hits, _ in met]), reduce(DataFrame.unionByName, [read for _, read in met]).distinct()


def _met(spark: SparkSession, rows: DataFrame, asked: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """``scored`` for questions (qid, term) whose words can be sent to all tasks."""
    kind = rows.schema["ids"].dataType.elementType
    told = asked.collect()
    terms, names = sorted({r.term for r in told}), sorted({r.qid for r in told})
    if len(terms) <= FILTERED:
        own = _having(rows, ["", *terms])
    else:
        own = rows.join(F.broadcast(asked.select("term").distinct().union(spark.range(1).select(F.lit("")))), "term", "left_semi")
    whole = rows.filter("term = ''").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("docs"), F.coalesce(F.sum("total"), F.lit(0)).alias("words")).first()
    mean = float(whole.words / max(1, whole.docs)) or 1.0
    # of the blocks only what they tell is read here, a row a term
    number, df, top = {t: i for i, t in enumerate(terms)}, np.zeros(len(terms), np.int64), np.zeros(len(terms))
    for r in own.filter("term <> ''").groupBy("term").agg(F.sum("n").alias("df"), F.max(_gain(F.col("most"), F.col("least"), F.lit(mean))).alias("top")).collect():
        df[number[r.term]], top[number[r.term]] = r.df, r.top
    weights = weight(whole.docs, df)
    wanted, at = [array("i") for _ in names], {q: i for i, q in enumerate(names)}
    for r in told:
        wanted[at[r.qid]].append(number[r.term])
    sent = spark.sparkContext.broadcast((number, [np.sort(x) for x in wanted], weights, weights * top))

    def meet(shard: pa.Table, blocks_read: bool) -> pa.Table:
        number, wanted, weights, highest = sent.value
        told = shard.filter(pc.equal(shard["term"], ""))
        ids, lengths = told["ids"].combine_chunks().flatten(), told["lengths"].combine_chunks().flatten().to_numpy()
        rows = shard.filter(pc.not_equal(shard["term"], ""))
        rows = rows.take(pc.sort_indices(rows, [("term", "ascending"), ("blk", "ascending")])).combine_chunks()
        word = np.asarray([number[t] for t in rows["term"].to_pylist()], np.int64)
        low = np.searchsorted(word, np.arange(len(number) + 1))  # a term's rows
        blk, blocks = rows["blk"].to_numpy(), rows["blocks"].to_numpy()
        docs, times = (rows[c].combine_chunks().flatten().to_numpy() for c in ("docs", "times"))
        n = rows["n"].to_numpy()
        ends = np.concatenate(([0], np.cumsum(n)))
        value = gain(times, lengths[docs], mean) * np.repeat(weights[word], n)
        keys = np.repeat(np.arange(len(n), dtype=np.int64), n) * len(ids) + docs  # in order, as a block's documents are
        read = np.zeros(len(n), bool)

        def all_of(t: int) -> slice:
            read[low[t] : low[t + 1]] = True
            return slice(ends[low[t]], ends[low[t + 1]])

        def looked_up(t: int, some: np.ndarray) -> np.ndarray:
            """What a term adds to these documents, from the blocks that may hold them."""
            place = some % blocks[low[t]]
            row = np.minimum(low[t] + np.searchsorted(blk[low[t] : low[t + 1]], place), low[t + 1] - 1)
            there = blk[row] == place
            read[row[there]] = True
            key = row * len(ids) + some
            found = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            return np.where(there & (keys[found] == key), value[found], 0.0)

        out: list[tuple] = []
        for q, asked in enumerate(wanted):
            some = asked[low[asked] < low[asked + 1]]
            if not len(some):
                continue
            some = some[np.argsort(highest[some], kind="stable")]
            span = all_of(some[-1])
            best = np.arange(span.start, span.stop)
            if len(best) > 2 * k:
                best = best[np.argpartition(-value[span], 2 * k)[: 2 * k]]
            floor = -np.inf
            if len(best) >= k:
                exact = value[best] + sum(looked_up(t, docs[best]) for t in some[:-1])
                floor = np.partition(exact, -k)[-k]
            below = np.cumsum(highest[some])
            minors = int(np.searchsorted(below, floor - _NEAR))  # the last is not among them: it alone or with the others reaches the floor
            score = np.zeros(len(ids))
            for t in some[minors:]:
                span = all_of(t)
                score[docs[span]] += value[span]
            found = np.flatnonzero((score > 0) & (score + (below[minors - 1] if minors else 0.0) >= floor - _NEAR))
            score = np.floor((score[found] + sum(looked_up(t, found) for t in some[:minors])) * 1e6 + 0.5) / 1e6
            if len(found) > k:
                keep = score >= np.partition(score, -k)[-k]
                found, score = found[keep], score[keep]
            first = np.lexsort((found, -score))[:k]  # documents are numbered by their ids
            out.append((np.full(len(first), q), found[first], score[first]))
        if blocks_read:
            return rows.select(["term", "part", "shard", "blk", "n"]).filter(pa.array(read))
        who, found, score = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"number": pa.array(who, pa.int64()), "id": ids.take(pa.array(found)), "score": score})

    shards = own.select("part", "shard", "term", "blk", "blocks", "n", "ids", "lengths", "docs", "times").groupBy("part", "shard")
    asked_by = spark.createDataFrame(list(enumerate(names)), f"number long, qid {asked.schema['qid'].dataType.simpleString()}")
    hits = shards.applyInArrow(lambda x: meet(x, False), f"number long, id {kind.simpleString()}, score double").join(F.broadcast(asked_by), "number")  # as many rows as the pass has questions
    return hits.select("qid", "id", "score"), shards.applyInArrow(lambda x: meet(x, True), "term string, part int, shard int, blk int, n int")
