"""Chunk, question and event tables that the registered queries derive from the given tables.

The chunk columns are written once, in SQL that Spark and the oracle share, as they are input and not an operator; case folding, hashes and ids are
written apart on each side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import identity



def fold(x: str) -> str:
    """The oracle's case folding, letter by letter."""
    for letter in ("ß", "ẞ"):
        x = f"replace({x}, '{letter}', 'ss')"
    for code, by in ((0x17F, "s"), (0x149, "\u02bcn"), (0x1F0, "j\u030c"), (0x1E96, "h\u0331"), (0x1E97, "t\u0308"), (0x1E98, "w\u030a"), (0x1E99, "y\u030a"), (0x1E9A, "a\u02be")):
        x = f"replace({x}, chr({code}), '{by}')"
    for n, by in enumerate(("ff", "fi", "fl", "ffi", "ffl", "st", "st")):
        x = f"replace({x}, chr({0xFB00 + n}), '{by}')"
    return f"lower({x})"


CHUNKS = """
SELECT *, concat('title of ', coalesce(lang, '')) AS title
FROM (
  SELECT doc_id, lang, source AS department, coalesce(text, '') AS content, file_type,
    concat(CASE WHEN doc_id % 5 = 0 THEN upper(source) ELSE source END, CASE WHEN doc_id % 7 = 0 THEN chr(92) ELSE '/' END, lang, '-', CAST(doc_id % 40 AS {str}),
           CASE WHEN doc_id % 4 = 0 THEN '-2025' ELSE '' END, '.', file_type) AS source_path,
    CASE doc_id % 4 WHEN 1 THEN 'rate_card' WHEN 2 THEN 'policy' WHEN 3 THEN 'guide' END AS document_type,
    CASE WHEN doc_id % 11 > 0 THEN CAST(2024 + doc_id % 3 AS {str}) END AS version,
    CASE WHEN doc_id % 3 > 0 THEN doc_id % 3 = 2 END AS is_current,
    CASE WHEN file_type = 'xlsx' AND doc_id % 2 = 0 THEN 'Grouped rows: Sheet' ELSE concat('Section ', CAST(doc_id % 5 AS {str})) END AS section,
    CASE WHEN file_type = 'xlsx' THEN CASE doc_id % 4 WHEN 0 THEN 'Volume' WHEN 1 THEN 'Term' WHEN 2 THEN 'Approval' ELSE 'Special' END END AS sheet_name,
    CASE WHEN file_type = 'xlsx' AND doc_id % 9 > 0 THEN doc_id % 2 + 1 END AS table_number,
    CASE WHEN file_type = 'xlsx' THEN doc_id % 12 + 1 END AS row_number,
    CASE WHEN file_type = 'pdf' THEN doc_id % 8 + 1 END AS page_number,
    CAST('2024-01-01' AS DATE) + CAST(doc_id % 300 AS INT) AS effective_from,
    CASE WHEN doc_id % 6 > 0 THEN CAST('2024-01-01' AS DATE) + CAST(doc_id % 300 + 365 AS INT) END AS effective_to
  FROM (SELECT *, CASE doc_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' ELSE 'xlsx' END AS file_type FROM documents) d
) c
"""
QUESTIONS = """
SELECT item_id AS qid, text, concat(text, CASE item_id % 8 WHEN 0 THEN ' rate card price?' WHEN 1 THEN ' section requirements' WHEN 2 THEN ' seat volume, annual term and approver' WHEN 3 THEN ' compare 2024 versus 2025'
  WHEN 4 THEN ' maximum limit 2' WHEN 5 THEN ' are facts conflicting' WHEN 6 THEN ' policy in 2024' ELSE ' title section' END) AS question FROM benchmark
"""


CHUNKS_SQL = f"SELECT *, sha256(content) AS content_hash, substr(sha256({fold('source_path')}), 1, 24) AS document_id FROM ({CHUNKS.format(str='VARCHAR')}) base"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(CHUNKS.format(str="STRING").replace("FROM documents", "FROM {documents}"), documents=read(spark, sf_dir, "documents"))
    return rows.withColumn("content_hash", F.sha2("content", 256)).withColumn("document_id", identity.document_id(F.col("source_path")))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(QUESTIONS.replace("FROM benchmark", "FROM {benchmark}"), benchmark=read(spark, sf_dir, "benchmark"))
