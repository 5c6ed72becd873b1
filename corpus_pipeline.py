"""A training-data pipeline over ``documents``: each stage takes all rows its predecessor kept; all but the last return the columns of documents.

toxicity: rows the model calls toxic go. line dedup: repeated lines leave the texts. n-gram Jaccard join: of each group of near
copies the row of the least id stays. mixing: each row stands as often as the mix takes it. packing: token pieces in sequences.
Decisions are made by row, not by id: rows without an id and rows that share one are told apart by a hash of what they hold, and of rows equal
in id and text one stays where one of a group must. Columns of any name pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import jaccard, lines, mixing, packing, toxicity
from tessera.llm.common import marked, materialise, maybe_in, private, table


def split_by(docs: DataFrame, key: Column, told: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose key surely is not told, and the others joined (left) with what is told of their key; told: (key, ...), unique keys, private names.

    A bitmap spares the first the shuffle.
    """
    (name,) = private([*docs.columns, *told.columns], "_key")
    keyed, bitmap = docs.withColumn(name, key), marked(told, told.columns[0])
    maybe = maybe_in(keyed, name, bitmap)
    return maybe_in(keyed, name, bitmap, keep=False).drop(name), maybe.join(told, maybe[name] == told[told.columns[0]], "left").drop(told.columns[0], name)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Equal texts score alike, so rows go by the hash of their text."""
    model = materialise(toxicity.train(docs, table(spark, sf_dir, "labels")), "toxicity-model")
    scored = toxicity.score(docs.select(F.xxhash64("text").alias("doc_id"), "text"), model)
    gone, toxic = private(docs.columns, "_gone", "_toxic")
    told = materialise(scored.filter("predicted = 1").select(F.col("doc_id").alias(gone), F.lit(True).alias(toxic)).distinct(), "pipeline-toxic")
    clean, maybe = split_by(docs, F.xxhash64("text"), told)
    return clean.unionByName(maybe.filter(F.col(toxic).isNull()).drop(toxic))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept, lines_before, dropped = private(docs.columns, "_kept", "_lines", "_dropped")
    out = lines.dedup_lines(docs, names=(kept, lines_before, dropped))
    changed = F.col(dropped) > 0
    found = {"text": F.when(changed, F.col(kept)).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        found["n_chars"] = F.when(changed, F.length(kept).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumns(found).select(*(F.col(f"`{c}`") for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the row of the least id stays, ids before none; equal rows of it are one."""
    rows = materialise(jaccard.join(docs).filter("class_key is not null"), "pipeline-rows")
    rows = rows.groupBy("class_key", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("times"))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    best = rows.groupBy("class_key").agg(F.min(place).alias("best"))
    told = rows.join(best, "class_key").withColumn("stays", place == F.col("best")).filter("not stays or times > 1")
    row, stays = private(docs.columns, "_row", "_stays")
    key = F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64("text"))
    told = materialise(told.select(F.xxhash64("doc_id", "text_hash").alias(row), F.col("stays").alias(stays)), "pipeline-copies")
    others, maybe = split_by(docs, key, told)
    one = maybe.filter(F.col(stays)).drop(stays)
    alone = maybe.filter(F.col(stays).isNull()).drop(stays)
    if told.filter(F.col(stays)).isEmpty():
        return others.unionByName(alone)
    return others.unionByName(alone).unionByName(one.dropDuplicates(["doc_id", "text"]))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; rows equal in id, source and text share what all of them take."""
    key = F.xxhash64(F.col("doc_id").cast("long"), "source", F.xxhash64("text"))
    row, copies, rows, copy = private(docs.columns, "_row", "_copies", "_rows", "_copy")
    mixed = mixing.mix_documents(docs.select(key.alias("doc_id"), "source", "text")).groupBy(F.col("doc_id").alias(row)).agg(F.sum("copies").alias(copies), F.count(F.lit(1)).alias(rows))
    taken = materialise(mixed.filter(F.col(copies) > 0), "pipeline-mix")
    maybe = split_by(docs, key, taken)[1].filter(F.col(copies).isNotNull())
    once = maybe.filter(F.col(rows) == 1)
    if not taken.filter(F.col(rows) > 1).isEmpty():
        once = once.unionByName(maybe.filter(F.col(rows) > 1).dropDuplicates(["doc_id", "source", "text"]))
    return once.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).drop(copies, rows, copy)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name.split()[0]}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Trained scores, hashed draws and the packing can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None
