"""Continuous ingestion of document versions (an extension).

An event is one version of one document: (document_id, sequence, deleted, chunks). The stream keeps each document's greatest sequence as state, so what comes late, twice or out of order is told from what is new,
across batches and restarts; of one batch at most the newest version of a document goes on. The stored corpus then replaces these documents whole.

Defined results: of versions with one sequence the one with the greater hash of what it holds counts, whichever comes first; a deleted version or one without chunks removes its document, and a version older than
that stays out; events without a document or a sequence are left out; a batch that runs again after a failure commits nothing new.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.plans.ingest import CHUNK, replace_documents
from tessera.plans.plugins import Embedder

EVENT = T.StructType([T.StructField("document_id", T.StringType()), T.StructField("sequence", T.LongType()), T.StructField("deleted", T.BooleanType()), T.StructField("chunks", T.ArrayType(CHUNK))])


def events(chunks: DataFrame, sequence: int) -> DataFrame:
    """One event for each document of a table of chunks (not a stream); a document's chunks fit a row, as its file did."""
    rows = F.sort_array(F.collect_list(F.struct(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in CHUNK.fields))))
    return chunks.groupBy("document_id").agg(F.lit(sequence).cast("long").alias("sequence"), F.lit(False).alias("deleted"), rows.alias("chunks"))


def removals(documents: DataFrame, sequence: int) -> DataFrame:
    """One event for each document that goes."""
    return documents.select("document_id", F.lit(sequence).cast("long").alias("sequence"), F.lit(True).alias("deleted"), F.lit(None).cast(T.ArrayType(CHUNK)).alias("chunks"))


def newest(changes: DataFrame) -> DataFrame:
    """The stream of versions (document_id, sequence, payload) that are newer than all before; at most one of a document in a batch. changes: a stream of the same columns."""

    def pick(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = tuple(state.get) if state.exists else None
        best, row = held, None
        for part in parts:
            for place, seq, digest in zip(range(len(part)), part["sequence"].tolist(), part["digest"].tolist(), strict=True):
                if best is None or (seq, digest) > best:
                    best, row = (seq, digest), part.iloc[place]["payload"]
        if best != held:
            state.update(best)
            yield pd.DataFrame({"document_id": [key[0]], "sequence": [best[0]], "payload": [row]})

    told = changes.filter("document_id is not null and sequence is not null").select("document_id", "sequence", "payload", F.sha2(F.coalesce("payload", F.lit("")), 256).alias("digest"))
    shape = f"document_id {changes.schema['document_id'].dataType.simpleString()}, sequence long, payload string"
    return told.groupBy("document_id").applyInPandasWithState(pick, shape, "sequence long, digest string", "update", GroupStateTimeout.NoTimeout)


def run(changes: DataFrame, location: str, embedder: Embedder, checkpoint: str) -> StreamingQuery:
    """changes: a stream of events. Each micro-batch's new versions replace their documents in the corpus; only the buckets these touch are read and written."""
    payload = F.when(~F.coalesce("deleted", F.lit(False)), F.to_json("chunks"))
    newer = newest(changes.select("document_id", "sequence", payload.alias("payload")))

    def merge(batch: DataFrame, _: int) -> None:
        rows = batch.select("document_id", F.inline(F.from_json("payload", T.ArrayType(CHUNK)))).toDF("_of", *CHUNK.fieldNames())
        # a chunk belongs to the document of its event
        rows = rows.withColumn("document_id", F.col("_of")).drop("_of")
        replace_documents(batch.sparkSession, rows, location, embedder, batch.select("document_id"))

    return newer.writeStream.foreachBatch(merge).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
