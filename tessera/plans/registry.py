"""The registered queries of the retrieval engine, with the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import identity, text
from tessera.operators import analysis, corpus, evidence, fusion, hashtree, search, selection, structure
from tessera.plans import store
from tessera.plans.catalog import CHUNKS_SQL, QUESTIONS, chunks, fold, questions, read
from tessera.sources import listing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def wide(df: DataFrame) -> DataFrame:
    """All whole numbers as BIGINT, as in the SQL."""
    return df.select(*(F.col(f"`{n}`").cast("bigint").alias(n) if t in ("int", "smallint", "tinyint") else F.col(f"`{n}`") for n, t in df.dtypes))


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: wide(f(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# Parts of the SQL.
def squeezed(x: str) -> str:
    return f"trim(regexp_replace({x}, '[\\s\\x0b\\x1c-\\x1f\\x85\\xa0]+', ' ', 'g'))"


def split_words(x: str) -> str:
    return f"list_filter(string_split({squeezed(x)}, ' '), lambda w: w <> '')"


def tokens(x: str) -> str:
    return f"regexp_extract_all({fold(x)}, '[a-z0-9]+')"


def count_windows(n: str, size: int, overlap: int) -> str:
    step = size - overlap
    return f"CASE WHEN {n} = 0 THEN 0 WHEN {n} <= {size} THEN 1 ELSE CAST(ceil(({n} - {size}) / {step}.0) AS BIGINT) + 1 END"


def windows_sql(source: str, keys: str, size: int, overlap: int) -> str:
    step = size - overlap
    return f"""ws AS (SELECT {keys}, {split_words('t')} AS w FROM {source}),
wk AS (SELECT *, unnest(range({count_windows('len(w)', size, overlap)})) AS i FROM ws),
windows AS (SELECT {keys}, i + 1 AS chunk_number, i * {step} AS word_start, least(i * {step} + {size}, len(w)) AS word_end, array_to_string(w[i * {step} + 1 : i * {step} + {size}], ' ') AS content FROM wk)"""


IDENTITY = f"sha256({fold('path')})"

# Structure


@query(f"""WITH src AS (SELECT doc_id, concat(source, '/', CAST(doc_id AS VARCHAR), '.pdf') AS path, coalesce(text, '') AS t FROM documents), {windows_sql('src', 'doc_id, path', 120, 20)}
SELECT doc_id, chunk_number, word_start, word_end, substr({IDENTITY}, 1, 24) AS document_id, sha256(content) AS content_hash,
  substr(sha256(concat(substr({IDENTITY}, 1, 24), '|pdf:1:', CAST(chunk_number AS VARCHAR), '|', sha256(content))), 1, 24) AS id FROM windows""")
def word_window_chunks(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"), F.coalesce("text", F.lit("")).alias("t"))
    made = structure.word_windows(docs, "t")
    return structure.identified(made, "path", F.concat(F.lit("pdf:1:"), F.col("chunk_number").cast("string"))).select("doc_id", "chunk_number", "word_start", "word_end", "document_id", "content_hash", "id")


LINES = """lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS t, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS line FROM documents)"""


def document_lines(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line", "t")).withColumn("line", F.col("line") + 1)


@query(f"""WITH {LINES}, {windows_sql('lines', 'doc_id, line', 160, 30)}
SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY line, chunk_number) AS chunk_number, word_start, word_end, sha256(content) AS content_hash FROM windows""")
def block_window_chunks(spark, sf_dir):
    made = structure.word_windows(document_lines(spark, sf_dir), "t", 160, 30)
    number = F.row_number().over(W.partitionBy("doc_id").orderBy("line", "chunk_number"))
    return made.select("doc_id", "line", number.alias("chunk_number"), "word_start", "word_end", F.sha2("content", 256).alias("content_hash"))


BASELINE = f"""src AS (SELECT doc_id, source AS path, coalesce(text, '') AS t FROM documents), {windows_sql('src', 'doc_id, path', 120, 20)},
baseline AS (SELECT doc_id, path, word_start, content, concat('baseline-', substr(sha256(concat('baseline|', path, '|', CAST(word_start AS VARCHAR), '|', content)), 1, 24)) AS id FROM windows)"""


def baseline_table(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("path"), F.coalesce("text", F.lit("")).alias("t"))
    key = F.concat_ws("|", F.lit("baseline"), "path", F.col("word_start").cast("string"), "content")
    return structure.word_windows(docs, "t").withColumn("id", F.concat(F.lit("baseline-"), identity.short_hash(key)))


@query(f"WITH {BASELINE} SELECT doc_id, word_start, id FROM baseline")
def baseline_chunks(spark, sf_dir):
    return baseline_table(spark, sf_dir).select("doc_id", "word_start", "id")


@query(f"""WITH {BASELINE}, hashed AS (SELECT path, sha256(concat(path, '|', CAST(doc_id AS VARCHAR), '|', CAST(word_start AS VARCHAR), '|', id, '|', content)) AS h FROM baseline)
SELECT path, count(*) AS n_chunks, sha256(concat_ws('-', {", ".join(f"CAST(sum(CAST(('0x' || substr(h, {1 + 15 * i}, 15)) AS UBIGINT)) AS VARCHAR)" for i in range(4))})) AS fingerprint FROM hashed GROUP BY path""")
def corpus_fingerprint(spark, sf_dir):
    """One hash for each source over the hashes of its chunks, which hold their document and place; from partial sums."""
    parts = ["path", F.col("doc_id").cast("string"), F.col("word_start").cast("string"), "id", "content"]
    each = baseline_table(spark, sf_dir).select("path", F.sha2(F.concat_ws("|", *parts), 256).alias("h"))
    return corpus.fingerprints(each, "path").withColumnRenamed("n", "n_chunks")


ENTRIES = f"""{BASELINE}, entries AS (SELECT path, concat(CAST(doc_id AS VARCHAR), '-', id, '-', CAST(word_start AS VARCHAR)) AS id, doc_id, word_start, content FROM baseline)"""
TREE = f"""{ENTRIES}, l2 AS (SELECT substr(sha256(concat(path, '|', id)), 1, 2) AS name, count(*) AS n, sha256(string_agg(concat(path, '|', id, '|', content), chr(10) ORDER BY path, doc_id, word_start, id)) AS hash FROM entries GROUP BY 1),
l1 AS (SELECT substr(name, 1, 1) AS name, sum(n)::BIGINT AS n, sha256(string_agg(concat(name, ':', hash), chr(10) ORDER BY name)) AS hash FROM l2 GROUP BY 1), l0 AS (SELECT '' AS name, sum(n)::BIGINT AS n, sha256(string_agg(concat(name, ':', hash), chr(10) ORDER BY name)) AS hash FROM l1)"""


def tree_entries(spark, sf_dir):
    """Baseline chunks under ids that name a row, and the depth of a tree over them."""
    rows = baseline_table(spark, sf_dir).select("path", F.concat_ws("-", F.col("doc_id").cast("string"), "id", F.col("word_start").cast("string")).alias("id"), "doc_id", "word_start", "content")
    return rows, hashtree.depth_for(read(spark, sf_dir, "documents").agg(F.sum(F.octet_length("text"))).first()[0] or 0)


@query(f"WITH {TREE} SELECT 2 AS level, * FROM l2 UNION ALL SELECT 1, * FROM l1 UNION ALL SELECT 0, * FROM l0")
def fingerprint_tree(spark, sf_dir):
    """The corpus fingerprint by leaves: the lines path, id, content in order, hashed; nodes up to the root."""
    rows, depth = tree_entries(spark, sf_dir)
    return hashtree.tree(rows, ["doc_id", "word_start"], depth)


@query(f"""WITH {ENTRIES}, other AS (SELECT path, id, CASE WHEN doc_id % 97 = 3 THEN concat(content, '!') ELSE content END AS content FROM entries WHERE doc_id % 101 <> 5 UNION ALL SELECT path, concat(id, '-new'), content FROM entries WHERE doc_id % 103 = 7)
SELECT coalesce(e.path, o.path) AS path, coalesce(e.id, o.id) AS id, CASE WHEN o.id IS NULL THEN 'left' WHEN e.id IS NULL THEN 'right' ELSE 'changed' END AS difference FROM entries e FULL JOIN other o ON e.path = o.path AND e.id = o.id WHERE e.content IS DISTINCT FROM o.content""")
def corpus_differences(spark, sf_dir):
    """Two corpora compared by their trees: some documents gone, some changed, some new."""
    rows, depth = tree_entries(spark, sf_dir)
    rows = store.materialise(rows, "entries")  # for two trees and both sides of the comparison
    n = F.col("doc_id")
    other = rows.filter(n % 101 != 5).withColumn("content", F.when(n % 97 == 3, F.concat("content", F.lit("!"))).otherwise(F.col("content"))).unionByName(rows.filter(n % 103 == 7).withColumn("id", F.concat("id", F.lit("-new"))))
    trees = [store.materialise(hashtree.tree(r, ["doc_id", "word_start"], depth), "tree") for r in (rows, other)]
    return hashtree.differences(rows, other, *trees, depth)


@query(f"""WITH src AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), {windows_sql('src', 'doc_id', 120, 20)}, hurt AS (SELECT doc_id, word_start, string_split(CASE WHEN (doc_id + chunk_number) % 5 = 0 THEN concat('x', content) ELSE content END, ' ') AS w FROM windows),
pairs AS (SELECT doc_id, w, lead(w) OVER o AS later, lead(word_start) OVER o - word_start AS step FROM hurt WINDOW o AS (PARTITION BY doc_id ORDER BY word_start))
SELECT doc_id, count(*) AS n_windows, count(*) FILTER (WHERE later IS NOT NULL AND array_to_string(w[step + 1 : step + 20], ' ') <> array_to_string(later[1 : 20], ' ')) AS n_violations FROM pairs GROUP BY doc_id""")
def overlap_check(spark, sf_dir):
    """Each fifth window is damaged at its first word, which the check must find."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    hurt = F.when((F.col("doc_id") + F.col("chunk_number")) % 5 == 0, F.concat(F.lit("x"), "content")).otherwise(F.col("content"))
    return structure.overlap_violations(structure.word_windows(docs, "t").withColumn("content", hurt), ["doc_id"])


SHEET = """sheet AS (SELECT l_suppkey AS sheet, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate) AS n,
  concat('order ', CAST(l_orderkey AS VARCHAR), ' line ', CAST(l_linenumber AS VARCHAR)) AS t FROM lineitem)"""


@query(f"""WITH {SHEET}, tot AS (SELECT *, max(n) OVER (PARTITION BY sheet) AS total FROM sheet), k AS (SELECT *, {count_windows('total', 20, 2)} AS k FROM tot),
spread AS (SELECT sheet, n, t, unnest(range(greatest(0, CAST(ceil((n - 20) / 18.0) AS BIGINT)), least(k - 1, CAST(floor((n - 1) / 18.0) AS BIGINT)) + 1)) + 1 AS group_number FROM k)
SELECT sheet, group_number, min(n) AS first_row, max(n) AS last_row, sha256(string_agg(t, chr(10) || chr(10) ORDER BY n)) AS text_hash FROM spread GROUP BY sheet, group_number""")
def row_group_windows(spark, sf_dir):
    order = W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate")
    words = F.concat(F.lit("order "), F.col("l_orderkey").cast("string"), F.lit(" line "), F.col("l_linenumber").cast("string"))
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("sheet"), F.row_number().over(order).alias("n"), words.alias("t"))
    return structure.row_windows(rows, ["sheet"], "n", "t").select("sheet", "group_number", "first_row", "last_row", F.sha2("text", 256).alias("text_hash"))


@query("""SELECT a.l_orderkey AS sheet, a.l_linenumber + 0 AS line, CAST(count(*) AS BIGINT) AS n_near FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND abs(a.l_linenumber - b.l_linenumber) = 1 GROUP BY 1, 2""".replace("a.l_linenumber + 0 AS line", "CAST(a.l_linenumber AS BIGINT) AS line"))
def adjacent_rows(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.struct("l_orderkey", "l_linenumber").alias("id"))
    near = structure.adjacent_rows(rows, ["l_orderkey"], "l_linenumber", "id")
    return near.groupBy(F.col("id.l_orderkey").alias("sheet"), F.col("id.l_linenumber").alias("line")).agg(F.count(F.lit(1)).alias("n_near"))


KIND = "CASE WHEN length(t) < 30 THEN CASE WHEN line = 1 THEN 'Title' ELSE 'Heading 1' END WHEN contains(t, '|') THEN 'List Bullet' ELSE 'Normal' END"


@query(f"""WITH {LINES}, k AS (SELECT *, {KIND} AS style FROM lines WHERE trim(t) <> ''),
m AS (SELECT *, CASE WHEN style = 'Title' THEN 'title' WHEN style = 'Heading 1' THEN 'heading' WHEN style = 'List Bullet' THEN 'list' ELSE 'paragraph' END AS kind FROM k)
SELECT doc_id, line, kind, last_value(CASE WHEN kind IN ('title', 'heading') THEN t END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS section FROM m""")
def section_ffill(spark, sf_dir):
    lines = document_lines(spark, sf_dir).filter(F.trim("t") != "").withColumn("kind", structure.paragraph_kind(F.expr(KIND))).withColumnRenamed("t", "text")
    return structure.carry_sections(lines, ["doc_id"], "line").select("doc_id", "line", "kind", "section")


CELLS = "list_transform(string_split(t, '|'), lambda c: nullif(trim(c), ''))"
ROWS_SQL = f"""{LINES}, cells AS (SELECT doc_id, line, {CELLS} AS cells, length(t) % 3 = 0 AS bold, length(t) % 7 = 0 AS merged FROM lines),
f AS (SELECT *, list_filter(list_transform(cells, lambda c, i: CASE WHEN c IS NOT NULL THEN i END), lambda i: i IS NOT NULL) AS pos FROM cells),
k0 AS (SELECT *, CASE WHEN len(pos) = 0 THEN 'blank' WHEN len(pos) >= 2 AND pos[-1] - pos[1] = len(pos) - 1 AND bold THEN 'header'
  WHEN merged THEN CASE WHEN line = 1 THEN 'title' WHEN contains(cells[pos[1]], 'Effective:') OR contains(cells[pos[1]], 'Version') THEN 'metadata' WHEN bold THEN 'section' ELSE 'note' END END AS k0 FROM f),
st AS (SELECT *, count(*) FILTER (WHERE k0 = 'blank') OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS stretch, count(*) FILTER (WHERE k0 = 'header') OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS tables FROM k0),
hd AS (SELECT *, last_value(CASE WHEN k0 = 'header' THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id, stretch ORDER BY line ROWS UNBOUNDED PRECEDING) AS head_line FROM st),
kinds AS (SELECT *, coalesce(k0, CASE WHEN head_line IS NOT NULL THEN 'data' ELSE 'key_value' END) AS kind FROM hd)"""


def sheet_rows(spark, sf_dir):
    lines = document_lines(spark, sf_dir)
    cells = F.transform(F.split("t", r"\|", -1), lambda c: F.nullif(F.trim(c), F.lit("")))
    rows = lines.select("doc_id", "line", cells.alias("cells"), (F.length("t") % 3 == 0).alias("bold"), (F.length("t") % 7 == 0).alias("merged"))
    return structure.classify_rows(rows, ["doc_id"], "line")


@query(f"WITH {ROWS_SQL} SELECT doc_id, line, kind, CASE WHEN kind IN ('header', 'data') THEN tables END AS table_number FROM kinds")
def sheet_row_kinds(spark, sf_dir):
    return sheet_rows(spark, sf_dir).select("doc_id", "line", "kind", "table_number")


#: All events as the rows of long sheets, one for each type: blanks, headers and merged notes by the user's number.
LONG = """SELECT event_type AS sheet, event_id AS place, CASE WHEN user_id % 17 > 0 THEN {array}(event_type, CASE WHEN value >= 20 THEN CAST(user_id AS {str}) END) ELSE {array}(CAST(NULL AS {str}), CAST(NULL AS {str})) END AS cells,
  user_id % 5 = 1 AS bold, user_id % 7 = 3 AS merged, user_id FROM {events}"""


@query(f"""WITH r AS ({LONG.format(array='list_value', str='VARCHAR', events='events')}), k0 AS (SELECT *, CASE WHEN cells[1] IS NULL THEN 'blank' WHEN cells[2] IS NOT NULL AND bold THEN 'header' WHEN merged THEN CASE WHEN bold THEN 'section' ELSE 'note' END END AS k0 FROM r),
st AS (SELECT *, count(*) FILTER (WHERE k0 = 'blank') OVER o AS stretch, count(*) FILTER (WHERE k0 = 'header') OVER o AS tables, last_value(CASE WHEN k0 = 'note' THEN CAST(user_id AS VARCHAR) END IGNORE NULLS) OVER o AS section FROM k0 WINDOW o AS (PARTITION BY sheet ORDER BY place ROWS UNBOUNDED PRECEDING)),
hd AS (SELECT *, last_value(CASE WHEN k0 = 'header' THEN cells END IGNORE NULLS) OVER (PARTITION BY sheet, stretch ORDER BY place ROWS UNBOUNDED PRECEDING) AS heads FROM st), kinds AS (SELECT *, coalesce(k0, CASE WHEN heads IS NOT NULL THEN 'data' ELSE 'key_value' END) AS kind FROM hd)
SELECT sheet, place, kind, CASE WHEN kind IN ('header', 'data') THEN array_to_string(heads, '|') END AS headers, CASE WHEN kind IN ('header', 'data') THEN tables END AS table_number, section FROM kinds""")
def long_sheet_kinds(spark, sf_dir):
    """Kinds, headers, table numbers and sections of sheets that no task holds."""
    rows = spark.sql(LONG.format(array="array", str="STRING", events="{events}"), events=read(spark, sf_dir, "events"))
    told = structure.classify_rows(rows, ["sheet"], "place", ranged=True)
    titles = told.withColumnsRenamed({"kind": "row_kind", "user_id": "text"}).withColumns({"kind": F.when(F.col("row_kind") == "note", "heading"), "text": F.col("text").cast("string")})
    return structure.carry_sections(titles, ["sheet"], "place", ranged=True).select("sheet", "place", F.col("row_kind").alias("kind"), F.array_join("headers", "|").alias("headers"), "table_number", "section")


LETTERS = "concat(CASE WHEN i > 702 THEN chr(CAST(65 + (i - 703) // 676 AS INT)) ELSE '' END, CASE WHEN i > 26 THEN chr(CAST(65 + ((i - 27) // 26) % 26 AS INT)) ELSE '' END, chr(CAST(65 + (i - 1) % 26 AS INT)))"


@query(f"""WITH {ROWS_SQL}, j AS (SELECT a.*, b.cells AS headers FROM kinds a LEFT JOIN cells b ON a.doc_id = b.doc_id AND b.line = CASE WHEN a.kind IN ('header', 'data') THEN a.head_line END),
v AS (SELECT *, CASE WHEN kind = 'header' THEN concat('Headers: ', array_to_string(list_transform(headers, lambda h: coalesce(h, '[blank header]')), ' | '))
  WHEN kind = 'data' THEN concat('Values: ', array_to_string(list_transform(range(1, greatest(len(headers), len(cells)) + 1), lambda i: CASE WHEN i <= len(headers) AND i <= len(cells) OR i <= len(headers) THEN concat(coalesce(headers[i], concat('Column ', {LETTERS})), '=', coalesce(cells[i], '[blank]')) END), '; '))
  ELSE concat('Values: ', array_to_string(list_filter(list_transform(range(1, len(cells) + 1), lambda i: CASE WHEN cells[i] IS NOT NULL THEN concat({LETTERS}, '=', cells[i]) END), lambda x: x IS NOT NULL), '; ')) END AS body FROM j)
SELECT doc_id, line, sha256(concat('Workbook: w', chr(10), 'Sheet: ', CAST(doc_id AS VARCHAR), chr(10), 'Row: ', CAST(line AS VARCHAR), chr(10), 'Kind: ', kind, CASE WHEN kind IN ('header', 'data') THEN concat(chr(10), 'Table: ', CAST(tables AS VARCHAR)) ELSE '' END, chr(10), body)) AS text_hash FROM v WHERE kind <> 'blank'""")
def sheet_row_texts(spark, sf_dir):
    rows = sheet_rows(spark, sf_dir).filter("kind <> 'blank'")
    return rows.select("doc_id", "line", F.sha2(structure.render_row(F.lit("w"), F.col("doc_id").cast("string"), F.col("line")), 256).alias("text_hash"))


@query("""WITH o AS (SELECT o_orderkey, o_custkey, o_orderkey % 4 + 1 AS n, [NULLIF(concat('h', CAST(o_custkey % 3 AS VARCHAR)), 'h0'), 'price', ''] AS h, [o_orderstatus, CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR), NULLIF(CAST(o_custkey % 2 AS VARCHAR), '0')] AS v FROM orders)
SELECT o_orderkey, CASE WHEN n = 1 THEN concat('Table headers: ', coalesce(h[1], '[blank]'), ' | price | [blank]')
  ELSE concat(coalesce(h[1], 'Column 1'), ': ', v[1], ' | price: ', v[2], ' | Column 3: ', coalesce(v[3], '[blank]')) END AS t FROM o""")
def table_row_texts(spark, sf_dir):
    head = F.array(F.nullif(F.concat(F.lit("h"), (F.col("o_custkey") % 3).cast("string")), F.lit("h0")), F.lit("price"), F.lit(""))
    # rounded half up like the SQL's cast
    cells = F.array("o_orderstatus", F.rint("o_totalprice").cast("bigint").cast("string"), F.nullif((F.col("o_custkey") % 2).cast("string"), F.lit("0")))
    return read(spark, sf_dir, "orders").select("o_orderkey", structure.table_row_text(head, cells, F.col("o_orderkey") % 4 + 1).alias("t"))


@query("""WITH f AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN '=qty*price' ELSE CAST(l_partkey AS VARCHAR) END AS value, CAST(l_suppkey AS VARCHAR) AS cached FROM lineitem)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, count(*) AS n, min(CASE WHEN value LIKE '=%' THEN cached ELSE value END) AS low, max(CASE WHEN value LIKE '=%' THEN value END) AS formula FROM f GROUP BY 1, 2""")
def formula_values(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").withColumn("at", F.row_number().over(W.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_extendedprice")))
    keys = ["l_orderkey", "l_linenumber", "at"]
    formulas = rows.select(*keys, F.when(F.col("l_linenumber") % 2 == 0, "=qty*price").otherwise(F.col("l_partkey").cast("string")).alias("value"))
    cached = rows.select(*keys, F.col("l_suppkey").cast("string").alias("value"))
    return structure.formula_values(formulas, cached, keys).groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("formula").alias("formula"))


@query(f"""SELECT doc_id, sha256(array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'), chr(10)), lambda x: trim(regexp_replace(x, '[ \\t]+', ' ', 'g'), ' ' || chr(9))), lambda x: x <> ''), chr(10))) AS page_hash,
  sha256({squeezed("coalesce(text, '')")}) AS block_hash, substr({squeezed("coalesce(text, '')")}, 1, 180) AS preview FROM documents""")
def normal_texts(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(text.page_text(t), 256).alias("page_hash"), F.sha2(text.block_text(t), 256).alias("block_hash"), F.substring(text.squeeze(t), 1, 180).alias("preview"))


# Sources

NAMES = """names AS (SELECT page_id, concat(regexp_replace(url, '^https?://', ''), CASE page_id % 5 WHEN 0 THEN '.pdf' WHEN 1 THEN '.docx' WHEN 2 THEN '.XLSX' WHEN 3 THEN '.txt' ELSE '' END) AS name, CASE WHEN page_id % 10 = 0 THEN 0 ELSE length(html) END AS size FROM pages)"""


@query(f"""WITH {NAMES},
p AS (SELECT *, len(list_filter(string_split(name, '/'), lambda c: c IN ('', '.', '..') OR regexp_matches(c, '[ .]$') OR regexp_matches(c, '[<>:"|?*\\x00-\\x1f]') OR regexp_matches(upper(string_split(c, '.')[1]), '^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$'))) > 0 OR name = '' OR contains(name, chr(92)) AS unsafe FROM names),
c AS (SELECT *, concat('KB/', name) AS logical, NOT unsafe AND NOT regexp_matches(lower(name), '[^/]\\.(pdf|docx|xlsx)$') AS unsupported FROM p),
d AS (SELECT *, row_number() OVER (PARTITION BY lower(logical), unsafe OR unsupported OR size = 0 ORDER BY lower(name), page_id) AS n, min(CASE WHEN NOT unsafe AND NOT unsupported AND size > 0 THEN concat(lower(name), chr(1), lpad(CAST(page_id AS VARCHAR), 20, '0')) END) OVER (PARTITION BY lower(logical)) AS first FROM c)
SELECT page_id, CASE WHEN unsafe THEN 'unsafe_path' WHEN unsupported THEN 'unsupported' WHEN first < concat(lower(name), chr(1), lpad(CAST(page_id AS VARCHAR), 20, '0')) THEN 'unsafe_path' WHEN size = 0 THEN 'empty' END AS code FROM d""")
def source_listing(spark, sf_dir):
    suffix = F.when(F.col("page_id") % 5 == 0, ".pdf").when(F.col("page_id") % 5 == 1, ".docx").when(F.col("page_id") % 5 == 2, ".XLSX").when(F.col("page_id") % 5 == 3, ".txt").otherwise("")
    pages = read(spark, sf_dir, "pages")
    names = pages.select("page_id", F.concat(F.regexp_replace("url", "^https?://", ""), suffix).alias("name"), F.when(F.col("page_id") % 10 == 0, 0).otherwise(F.length("html")).alias("size"))
    return listing.classify(names, "KB", "page_id").select("page_id", "code")


@query(f"""WITH {NAMES} SELECT page_id, concat('kb', CASE WHEN name = '' THEN '' ELSE concat('/', name) END) AS logical_path, CASE WHEN page_id % 2 = 0 THEN concat('Library/', rtrim(name, '/')) END AS rooted FROM names""")
def logical_paths(spark, sf_dir):
    suffix = F.when(F.col("page_id") % 5 == 0, ".pdf").when(F.col("page_id") % 5 == 1, ".docx").when(F.col("page_id") % 5 == 2, ".XLSX").when(F.col("page_id") % 5 == 3, ".txt").otherwise("")
    names = read(spark, sf_dir, "pages").select("page_id", F.concat(F.regexp_replace("url", "^https?://", ""), suffix).alias("name"))
    mixed = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("KB/"), F.col("name"))).otherwise(F.col("name"))
    deep = F.concat(F.lit("c:\\data\\"), F.when(F.col("page_id") % 2 == 0, "Library\\").otherwise("other\\"), F.col("name"))
    return names.select("page_id", listing.logical_path(mixed, "kb").alias("logical_path"), listing.rooted_path(deep, "Library").alias("rooted"))


# Search

BM25 = f"""spread AS (SELECT doc_id, {tokens("concat('title of ', coalesce(lang, ''), chr(10), coalesce(text, ''))")} AS t FROM documents), tot AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM spread),
asked AS (SELECT item_id AS qid, unnest(list_distinct({tokens('text')})) AS term FROM benchmark),
each_t AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM spread), post AS (SELECT doc_id, dl, term, count(*) AS tf FROM each_t WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
hits AS (SELECT qid, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM post JOIN asked USING (term) JOIN dfs USING (term), tot GROUP BY qid, doc_id),
bm25 AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM hits QUALIFY rank <= 20)"""


def keyword(spark, sf_dir, asked):
    """BM25 over titles and texts for (qid, text)."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("title of "), F.coalesce("lang", F.lit(""))).alias("title"), "text")
    return search.bm25_top_k(docs, asked, columns=("title", "text"))


def bm25(spark, sf_dir):
    return keyword(spark, sf_dir, read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text"))


@query(f"WITH {BM25} SELECT qid, doc_id, score, rank FROM bm25")
def bm25_topk(spark, sf_dir):
    return bm25(spark, sf_dir).select("qid", "doc_id", "score", "rank")


@query(f"WITH {BM25} SELECT qid, doc_id, score, rank FROM bm25")
def indexed_bm25(spark, sf_dir):
    """The same from a stored inverted index of all documents."""
    from tessera.plans import keyword_index

    docs = read(spark, sf_dir, "documents").withColumn("title", F.concat(F.lit("title of "), F.coalesce("lang", F.lit(""))))
    index = f"{store.work_dir(spark)}/tessera-index-{uuid.uuid4().hex}"
    keyword_index.build(spark, docs, index, ("title", "text"))
    found = keyword_index.search(spark, index, read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text"))
    return found.select("qid", F.col("id").alias("doc_id"), "score", "rank")


KNN = """v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
sims AS (SELECT q.vec_id AS qid, c.vec_id AS id, round(list_cosine_similarity(q.e, c.e), 6) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
knn AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM sims QUALIFY rank <= {k})"""


def knn(spark, sf_dir, k=20):
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return search.vector_top_k(vectors, vectors.filter(F.col("id") % 20 == 0).withColumnRenamed("id", "qid"), k)


@query(f"WITH {KNN.format(k=20)} SELECT qid, id, score, rank FROM knn")
def knn_topk(spark, sf_dir):
    return knn(spark, sf_dir)


@query(f"WITH {KNN.format(k=20)} SELECT qid, id, score, rank FROM knn")
def knn_indexed(spark, sf_dir):
    """The same from stored cells, by the exact way."""
    from tessera.plans import vector_index

    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    index = f"{store.work_dir(spark)}/tessera-cells-{uuid.uuid4().hex}"
    vector_index.build(spark, vectors, index)
    return vector_index.search(spark, index, vectors.filter(F.col("id") % 20 == 0).withColumnRenamed("id", "qid"), exact=True)


@query(f"WITH {KNN.format(k=5)} SELECT qid, id, score, rank FROM knn")
def knn_baseline_top5(spark, sf_dir):
    return knn(spark, sf_dir, 5)


#: A question's vector is the mean vector of what its keyword search found.
FEEDBACK = """fb0 AS (SELECT b.qid, unnest(range(1, len(e.embedding) + 1)) AS i, unnest(CAST(e.embedding AS DOUBLE[])) AS x FROM bm25 b JOIN embeddings e ON e.vec_id = b.doc_id), fb1 AS (SELECT qid, i, avg(x) AS x FROM fb0 GROUP BY qid, i), fb AS (SELECT qid, list(x ORDER BY i) AS e FROM fb1 GROUP BY qid),
fbs AS (SELECT f.qid, v.vec_id AS id, round(list_cosine_similarity(f.e, CAST(v.embedding AS DOUBLE[])), 6) AS score FROM fb f CROSS JOIN embeddings v), knn AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM fbs QUALIFY rank <= 20)"""
RRF = f"""{FEEDBACK}, both_lists AS (SELECT qid, doc_id AS id, rank FROM bm25 UNION ALL SELECT qid, id, rank FROM knn), fused AS (SELECT qid, id, round(sum(1 / (60.0 + rank)), 6) AS score FROM both_lists GROUP BY qid, id),
rrf AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM fused QUALIFY rank <= 20)"""


def hybrid(spark, sf_dir, asked):
    """Keyword and vector search of (qid, text), fused by rank."""
    hits = store.materialise(keyword(spark, sf_dir, asked).withColumnRenamed("doc_id", "id"), "hybrid-hits")
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    near = search.vector_top_k(vectors, search.feedback_vectors(hits, vectors), own=False)
    return search.reciprocal_rank_fusion(hits, near)


@query(f"WITH {BM25}, {RRF} SELECT qid, id, score, rank FROM rrf")
def rrf_hybrid(spark, sf_dir):
    return hybrid(spark, sf_dir, read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text"))


# Candidates: BM25 hits of a question as chunks with metadata


def listed(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def ranked_tokens(x: str) -> str:
    return f"list_distinct(list_transform({tokens(x)}, lambda t: CASE WHEN t IN ({listed(text.APPROVAL)[1:-1]}) THEN 'approval' ELSE t END))"


YEARS = "'\\b(?:19|20)\\d{2}\\b'"


def historical(x: str) -> str:
    return f"(len(list_intersect({ranked_tokens(x)}, {listed(text.HISTORICAL)})) > 0 OR regexp_matches({x}, {YEARS}))"


def stem_sql(t: str) -> str:
    out = t
    for suffix in reversed(("ies", "ing", "ed", "es", "s")):
        cut = f"left({t}, length({t}) - {len(suffix)})"
        out = f"CASE WHEN length({t}) > {len(suffix) + 3} AND ends_with({t}, '{suffix}') THEN {f'concat({cut}, chr(121))' if suffix == 'ies' else cut} ELSE {out} END"
    return out


def stemmed(x: str) -> str:
    return f"list_transform({tokens(x)}, lambda t: {stem_sql('t')})"


SKEY = fold("replace(source_path, chr(92), '/')")
CANDIDATES = f"""{BM25}, chunks AS ({CHUNKS_SQL}), qs AS ({QUESTIONS}),
cands AS (SELECT b.qid, q.question, {historical('q.question')} AS historical, b.rank, b.score, substr(sha256(concat(c.document_id, '|doc:', CAST(c.doc_id AS VARCHAR), '|', c.content_hash)), 1, 24) AS id, c.*
  FROM bm25 b JOIN qs q USING (qid) JOIN chunks c USING (doc_id))"""


def with_ids(df: DataFrame) -> DataFrame:
    return df.withColumn("id", identity.chunk_id(F.col("document_id"), F.concat(F.lit("doc:"), F.col("doc_id").cast("string")), F.col("content_hash")))


def candidates(spark, sf_dir):
    asked = questions(spark, sf_dir).select("qid", "question", text.historical_intent(F.col("question")).alias("historical"))
    return with_ids(bm25(spark, sf_dir).join(asked, "qid").join(chunks(spark, sf_dir), "doc_id"))


DEDUP = f"d1 AS (SELECT * FROM cands QUALIFY row_number() OVER (PARTITION BY qid, concat({SKEY}, '|', content_hash) ORDER BY rank, id) = 1)"


@query(f"WITH {CANDIDATES}, {DEDUP} SELECT qid, rank, id FROM d1")
def dedup_keep_first(spark, sf_dir):
    return selection.dedup_keep_first(candidates(spark, sf_dir)).select("qid", "rank", "id")


CARD = "coalesce(ends_with(document_type, 'rate_card'), FALSE)"
NARROW = f"d2 AS (SELECT * FROM (SELECT *, bool_or({CARD}) OVER (PARTITION BY qid) AS any_card FROM d1) WHERE NOT regexp_matches(question, '(?i)\\brate\\s+cards?\\b') OR NOT any_card OR {CARD})"


@query(f"WITH {CANDIDATES}, {DEDUP}, {NARROW} SELECT qid, rank, id FROM d2")
def rate_card_narrowing(spark, sf_dir):
    return selection.narrow_rate_cards(selection.dedup_keep_first(candidates(spark, sf_dir))).select("qid", "rank", "id")


STEM = "regexp_replace(list_extract(string_split(replace(source_path, chr(92), '/'), '/'), -1), '(.)\\.[^.]+$', '\\1')"
BARE = f"regexp_replace({fold(STEM)}, {YEARS}, '', 'g')"
FAMILY = f"CASE WHEN coalesce(document_type, '') <> '' THEN concat({fold('department')}, '|', {fold('document_type')}) ELSE regexp_replace(CASE WHEN {BARE} = '' THEN {fold(STEM)} ELSE {BARE} END, '[^a-z0-9]+', '', 'g') END"
FRESH = f"""d3 AS (SELECT * FROM (SELECT *, bool_or(is_current IS NOT DISTINCT FROM TRUE) OVER (PARTITION BY qid, family) AS fresh FROM (SELECT *, {FAMILY} AS family FROM d2)) WHERE NOT (is_current IS NOT DISTINCT FROM FALSE AND fresh AND NOT historical))"""


@query(f"WITH {CANDIDATES}, {DEDUP}, {NARROW}, {FRESH} SELECT qid, rank, id FROM d3")
def current_suppression(spark, sf_dir):
    rows = selection.narrow_rate_cards(selection.dedup_keep_first(candidates(spark, sf_dir)))
    return selection.suppress_stale(rows).select("qid", "rank", "id")


MONEY = "regexp_matches(content, '(?i)([$€£]\\s?\\d|\\b(usd|eur|gbp)\\b)')"
PRICED = f"len(list_intersect(q, {listed(text.PRICE)})) > 0 AND {MONEY}"
RANKED = f"""d4 AS (SELECT *, list_filter({ranked_tokens('question')}, lambda t: NOT list_contains({listed(text.RANK_STOP)}, t)) AS q, {ranked_tokens("concat_ws(' ', title, source_path, section, sheet_name, content)")} AS c,
  row_number() OVER (PARTITION BY qid ORDER BY rank, id) - 1 AS r, count(*) OVER (PARTITION BY qid) AS n FROM d3),
d5 AS (SELECT *, len(list_intersect(q, c)) AS hits, len(list_filter(list_intersect(q, c), lambda t: regexp_matches(t, '^[0-9]+$'))) AS numbers, {SKEY} AS skey FROM d4),
near AS (SELECT DISTINCT a.qid, a.id FROM d5 a JOIN d5 b ON a.qid = b.qid AND a.skey = b.skey AND a.sheet_name IS NOT DISTINCT FROM b.sheet_name AND a.table_number IS NOT DISTINCT FROM b.table_number
  AND abs(a.row_number - b.row_number) = 1 AND a.id <> b.id AND a.file_type = 'xlsx' AND b.file_type = 'xlsx' AND b.hits > 0),
d6 AS (SELECT d5.*, round((n - r) / CAST(greatest(n, 1) AS DOUBLE) + hits + 2.0 * numbers + CASE WHEN NOT historical AND is_current IS NOT DISTINCT FROM TRUE THEN 1.5 ELSE 0 END
  + CASE WHEN file_type = 'xlsx' AND hits > 0 THEN 0.75 ELSE 0 END + CASE WHEN {PRICED} THEN 1.5 ELSE 0 END + CASE WHEN {PRICED} AND {CARD} THEN 1 ELSE 0 END
  + CASE WHEN len(list_intersect(q, {listed(text.NUMERIC)})) > 0 AND regexp_matches(content, '[0-9]') THEN 2 ELSE 0 END + CASE WHEN near.id IS NOT NULL THEN 0.5 ELSE 0 END, 6) AS rank_score FROM d5 LEFT JOIN near ON d5.qid = near.qid AND d5.id = near.id),
d7 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank_score DESC, r) AS place FROM d6)"""


def prepared(spark, sf_dir):
    rows = selection.narrow_rate_cards(selection.dedup_keep_first(candidates(spark, sf_dir)))
    return selection.rank_scores(selection.suppress_stale(rows))


@query(f"WITH {CANDIDATES}, {DEDUP}, {NARROW}, {FRESH}, {RANKED} SELECT qid, id, rank_score, place FROM d7")
def rank_score(spark, sf_dir):
    return prepared(spark, sf_dir).select("qid", "id", "rank_score", "place")


SUBJECT = "list_filter(q, lambda t: t NOT IN ('company', 'requirement', 'requirements'))"
REQUIRED = f"""d8 AS (SELECT *, len(list_intersect(q, ['requirement', 'requirements'])) > 0 AND len(list_intersect({SUBJECT}, {ranked_tokens("concat_ws(' ', title, section)")})) > 0 AND table_number IS NOT NULL AND row_number IS NOT NULL AND NOT starts_with({fold('content')}, 'table headers:') AS req FROM d7)"""


@query(f"WITH {CANDIDATES}, {DEDUP}, {NARROW}, {FRESH}, {RANKED}, {REQUIRED} SELECT qid, id, place FROM d8 WHERE req")
def requirement_rows(spark, sf_dir):
    return prepared(spark, sf_dir).filter(selection.requirement_rows()).select("qid", "id", "place")


def _facet(name: str) -> str:
    where = f"contains({fold('section')}, 'calculation')" if name == "calculation" else f"contains(coalesce({fold('sheet_name')}, ''), '{dict(volume='volume', term='term', approval='approval', program='special')[name]}')"
    return f"(len(list_intersect(c, {listed(selection.FACETS[name])})) > 0 OR {where})"


_GROUPED = f"file_type = 'xlsx' AND contains({fold('section')}, 'grouped rows')"
_FLAGS = ", ".join(f"{_GROUPED} AND {_facet(f)}" for f in selection.FACETS)
_ASKED = ", ".join(f"len(list_intersect(q, {listed(v)})) > 0" for v in selection.FACETS.values())
FACETED = f"""e0 AS (SELECT qid, any_value(question) AS question, list({{'place': place, 'm': [{_FLAGS}]}} ORDER BY place) AS l, any_value([{_ASKED}]) AS asked FROM d8 GROUP BY qid), f0 AS (SELECT *, CAST([] AS BIGINT[]) AS h0 FROM e0), """ + ", ".join(
    f"g{i} AS (SELECT *, list_filter(l, lambda x: x.m[{i}] AND NOT list_contains(h{i - 1}, x.place)) AS c{i} FROM f{i - 1}), f{i} AS (SELECT *, CASE WHEN asked[{i}] AND len(h{i - 1}) < 3 AND len(c{i}) > 0 THEN list_append(h{i - 1}, c{i}[1].place) ELSE h{i - 1} END AS h{i} FROM g{i})" for i in range(1, 6)
) + f""", held AS (SELECT qid, CASE WHEN len(list_filter(asked, lambda a: a)) >= 2 AND NOT {historical('question')} THEN h5 ELSE [] END AS h FROM f5),
d9 AS (SELECT d8.*, nullif(coalesce(list_position(h, place), 0), 0) AS reserved, bool_or(req) OVER (PARTITION BY d8.qid) AS any_req FROM d8 JOIN held USING (qid))"""


@query(f"WITH {CANDIDATES}, {DEDUP}, {NARROW}, {FRESH}, {RANKED}, {REQUIRED}, {FACETED} SELECT qid, id, CAST(reserved AS BIGINT) AS reserved FROM d9 WHERE reserved IS NOT NULL")
def facet_reservation(spark, sf_dir):
    return selection.facet_reservations(prepared(spark, sf_dir), 6).filter("reserved is not null").select("qid", "id", "reserved")


PACKED = f"{DEDUP}, {NARROW}, {FRESH}, {RANKED}, {REQUIRED}, {FACETED}, pack AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN any_req THEN CASE WHEN req THEN place END ELSE reserved END NULLS LAST, place) AS position FROM d9 QUALIFY position <= 6)"
PACK = f"{CANDIDATES}, {PACKED}"


def context(spark, sf_dir):
    """The evidence packs: a few rows a question, stored once for all that read them."""
    return store.materialise(selection.select_context(candidates(spark, sf_dir)), "packs")


@query(f"WITH {PACK} SELECT qid, position, id, source_path, rank_score FROM pack")
def selection_context(spark, sf_dir):
    return context(spark, sf_dir).select("qid", "position", "id", "source_path", "rank_score")


@query(f"WITH {PACK} SELECT qid, sha256(string_agg(concat('[', id, '] ', title, chr(10), content), chr(10) || chr(10) ORDER BY position)) AS prompt_hash FROM pack GROUP BY qid")
def prompt_assembly(spark, sf_dir):
    return evidence.prompt(context(spark, sf_dir)).select("qid", F.sha2("prompt", 256).alias("prompt_hash"))


@query(f"""WITH {PACK}, o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY position) AS k FROM pack)
SELECT qid, count(*) AS n, string_agg(concat(CAST(k AS VARCHAR), ':', id), ',' ORDER BY k) AS ids FROM o GROUP BY qid""")
def json_trace(spark, sf_dir):
    """The trace as JSON, read back."""
    shape = "array<struct<rank:int,id:string,source_path:string,rank_score:double>>"
    rows = evidence.trace(context(spark, sf_dir)).select("qid", F.from_json("trace", shape).alias("t"))
    return rows.select("qid", F.size("t").cast("bigint").alias("n"), F.array_join(F.transform("t", lambda x: F.concat_ws(":", x["rank"].cast("string"), x["id"])), ",").alias("ids"))


# Fusion of three searches: the whole passage and its halves

PARTS = "list_filter(string_split(text, ' '), lambda w: w <> '')"
SUBS = f"""subs AS (SELECT item_id * 3 AS item_id, text FROM benchmark UNION ALL SELECT item_id * 3 + 1, array_to_string({PARTS}[1 : len({PARTS}) // 2], ' ') FROM benchmark UNION ALL SELECT item_id * 3 + 2, array_to_string({PARTS}[len({PARTS}) // 2 + 1 :], ' ') FROM benchmark)"""
HITS = f"""{SUBS}, {BM25.replace('FROM benchmark', 'FROM subs')}, chunks AS ({CHUNKS_SQL}),
hits3 AS (SELECT b.qid // 3 AS qid, b.qid % 3 AS subquery, b.rank - 1 AS rank, b.score, c.*, substr(sha256(concat(c.document_id, '|doc:', CAST(c.doc_id AS VARCHAR), '|', c.content_hash)), 1, 24) AS id, concat({fold('source_path')}, '|', content_hash) AS same,
  CASE WHEN coalesce(document_type, '') <> '' THEN concat({fold('department')}, '|', document_type, '|', coalesce(version, nullif(regexp_extract(source_path, '(?:19|20)\\d{{2}}'), ''), 'unspecified')) ELSE regexp_replace({fold(STEM)}, '[^a-z0-9]+', '', 'g') END AS family
  FROM bm25 b JOIN chunks c USING (doc_id)),
one AS (SELECT * FROM hits3 QUALIFY row_number() OVER (PARTITION BY qid, same, subquery ORDER BY rank, id) = 1),
nth AS (SELECT *, row_number() OVER (PARTITION BY qid, same ORDER BY subquery) AS k FROM one),
groups AS (SELECT qid, same, count(*) AS coverage, min(rank) AS best_rank, max(score) AS best_score, min(subquery) AS first_subquery, arg_min(rank, k) AS came,
  max(CASE WHEN k = 1 THEN {{'r': rank, 's': score, 'id': id, 'f': family}} END) AS a, max(CASE WHEN k = 2 THEN {{'r': rank, 's': score, 'id': id, 'f': family}} END) AS b, max(CASE WHEN k = 3 THEN {{'r': rank, 's': score, 'id': id, 'f': family}} END) AS c FROM nth GROUP BY qid, same),
w2 AS (SELECT *, CASE WHEN b IS NOT NULL AND (b.s > a.s OR b.s = a.s AND b.r < a.r) THEN b ELSE a END AS p, least(a.r, coalesce(b.r, a.r)) AS lr, greatest(a.s, coalesce(b.s, a.s)) AS ls FROM groups),
w3 AS (SELECT *, CASE WHEN c IS NOT NULL AND (c.s > ls OR c.s = ls AND c.r < lr) THEN c ELSE p END AS won FROM w2),
flat AS (SELECT qid, coverage, best_rank, best_score, first_subquery, came, won.id AS id, won.f AS family, row_number() OVER (PARTITION BY qid ORDER BY coverage DESC, best_score DESC, best_rank, first_subquery, came, won.id) AS usual FROM w3)"""


def sub_hits(spark, sf_dir):
    item, parts = F.col("item_id"), F.filter(F.split("text", " "), lambda w: w != "")
    half = F.floor(F.size(parts) / 2).cast("int")
    sides = F.array(F.struct((item * 3).alias("qid"), F.col("text")), F.struct((item * 3 + 1).alias("qid"), F.array_join(F.slice(parts, F.lit(1), half), " ").alias("text")), F.struct((item * 3 + 2).alias("qid"), F.array_join(F.slice(parts, half + 1, F.size(parts)), " ").alias("text")))
    asked = read(spark, sf_dir, "benchmark").select(F.inline(sides))
    found = keyword(spark, sf_dir, asked)
    split = found.select(F.floor(F.col("qid") / 3).alias("qid"), (F.col("qid") % 3).alias("subquery"), (F.col("rank") - 1).alias("rank"), "score", "doc_id")
    return with_ids(split.join(chunks(spark, sf_dir), "doc_id"))


@query(f"WITH {HITS} SELECT qid, usual AS rank, id, coverage, best_rank, best_score, first_subquery FROM flat WHERE usual <= 20")
def subquery_fusion(spark, sf_dir):
    return fusion.fuse(sub_hits(spark, sf_dir))


@query(f"""WITH {HITS}, lead_ AS (SELECT *, row_number() OVER (PARTITION BY qid, family ORDER BY CASE WHEN coverage = 1 THEN 0 ELSE 1 END, best_score DESC, best_rank, first_subquery, usual) = 1 AS lead FROM flat),
o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY lead DESC, CASE WHEN lead THEN CASE WHEN coverage = 1 THEN 0 ELSE 1 END END, CASE WHEN lead THEN -best_score END, CASE WHEN lead THEN best_rank END, CASE WHEN lead THEN first_subquery END, usual) AS rank FROM lead_)
SELECT qid, rank, id, coverage, best_rank, best_score, first_subquery FROM o WHERE rank <= 20""")
def comparison_fusion(spark, sf_dir):
    return fusion.fuse(sub_hits(spark, sf_dir), comparison=True)


# Questions


TURNS = """turns AS (SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN concat(CASE (conv_id + turn) % 8 WHEN 0 THEN 'What about ' WHEN 1 THEN 'compare 2024 and 2025 for ' WHEN 2 THEN 'and in 2023 ' WHEN 3 THEN 'how many documents are in ' ELSE '' END,
  coalesce(text, '')) ELSE text END AS text FROM conversations WHERE role IN ('user', 'assistant')
  UNION ALL SELECT DISTINCT conv_id, -1, 'user', CASE conv_id % 8 WHEN 5 THEN 'Tell me about the policy' ELSE 'Hello there!' END FROM conversations WHERE conv_id % 8 IN (5, 7))"""
PRIOR = f"""{TURNS}, prior AS (SELECT *, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS prior FROM turns)"""


def turns(spark, sf_dir):
    n = F.col("conv_id") + F.col("turn")
    lead = F.when(n % 8 == 0, "What about ").when(n % 8 == 1, "compare 2024 and 2025 for ").when(n % 8 == 2, "and in 2023 ").when(n % 8 == 3, "how many documents are in ").otherwise("")
    said = read(spark, sf_dir, "conversations")
    rows = said.filter(F.col("role").isin("user", "assistant")).withColumn("text", F.when(F.col("role") == "user", F.concat(lead, F.coalesce("text", F.lit("")))).otherwise(F.col("text")))
    # some conversations open with a question without a subject or a greeting
    first = said.filter(F.col("conv_id") % 8 % 2 == 1).filter(F.col("conv_id") % 8 > 4).select("conv_id").distinct()
    opening = F.when(F.col("conv_id") % 8 == 5, "Tell me about the policy").otherwise("Hello there!")
    return rows.unionByName(first.select("conv_id", F.lit(-1).cast(rows.schema["turn"].dataType).alias("turn"), F.lit("user").alias("role"), opening.alias("text")))


@query(f"WITH {PRIOR} SELECT conv_id, turn, prior FROM prior")
def last_user_turn(spark, sf_dir):
    return analysis.last_user_turn(turns(spark, sf_dir)).select("conv_id", "turn", "prior")


def _re(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def subject_sql(x: str) -> str:
    out = f"regexp_replace({x}, {YEARS}, ' ', 'g')"
    for pattern, by in ((r"\b(?:difference\s+between|compare(?:d)?|comparison|versus|vs\.?)\b", " "), (r"\b(?:and|or)\b", " "), (r"\b(?:in|for|from|between|to)\s*([,.!?;:]|$)", r" \1"), (r"\s+([,.!?;:])", r"\1")):
        out = f"regexp_replace({out}, {_re(pattern)}, '{by}', 'gi')"
    return f"regexp_replace(trim({squeezed(out)}, ' ,.!?;:'), '^(?:the|a|an)\\s+', '', 'i')"


def same_key(x: str) -> str:
    return fold(x)


ANALYSIS = f"""a1 AS (SELECT conv_id, turn, text AS question, {squeezed('text')} AS q, {squeezed('prior')} AS p FROM prior WHERE role = 'user'),
a2 AS (SELECT *, coalesce(p <> '' AND regexp_matches(q, {_re(analysis.FOLLOW_UP)}), FALSE) AS resolved FROM a1),
a3 AS (SELECT *, CASE WHEN resolved THEN concat(p, ' ', q) ELSE q END AS s, regexp_matches(q, {_re(analysis.GENERIC)}) AND NOT resolved AS ambiguous FROM a2),
a4 AS (SELECT *, CASE WHEN ambiguous THEN 'unspecified' WHEN regexp_matches(s, {_re(analysis.COMPARISON)}) THEN 'comparison' WHEN {historical('s')} THEN 'historical' ELSE 'unspecified' END AS intent,
  list_concat(regexp_extract_all(s, {YEARS}), regexp_extract_all(question, {YEARS})) AS ys FROM a3),
a5 AS (SELECT *, list_filter(ys, lambda y, i: list_position(ys, y) = i) AS years, {subject_sql('s')} AS subject FROM a4),
a6 AS (SELECT *, CASE WHEN intent = 'comparison' AND len(years) >= 2 THEN list_concat([s], list_transform(years[1:2], lambda y: CASE WHEN regexp_extract_all(s, {YEARS}) = [y] THEN s WHEN subject <> '' THEN concat(subject, ' in ', y) ELSE y END)) ELSE [s] END AS subs0 FROM a5),
a7 AS (SELECT *, list_filter(subs0, lambda x, i: list_position(list_transform(subs0, lambda z: {same_key('z')}), {same_key('x')}) = i)[1:3] AS subs FROM a6)"""
ANALYZED = f"{PRIOR}, {ANALYSIS}"


def analyzed(spark, sf_dir):
    asked = analysis.last_user_turn(turns(spark, sf_dir)).filter("role = 'user'").withColumnRenamed("text", "question")
    return analysis.analyze(asked)


@query(f"WITH {ANALYZED} SELECT conv_id, turn, s AS standalone_query, ambiguous, intent AS temporal_intent, array_to_string(subs, ' || ') AS subqueries, resolved AS resolved_from_context FROM a7")
def question_analysis(spark, sf_dir):
    return analyzed(spark, sf_dir).select("conv_id", "turn", "standalone_query", "ambiguous", "temporal_intent", F.array_join("subqueries", " || ").alias("subqueries"), "resolved_from_context")


@query(f"WITH {ANALYZED}, r AS (SELECT conv_id, turn, CASE WHEN len(subs) > 1 AND subs[1] = s THEN subs[2:] ELSE subs END AS run FROM a7) SELECT conv_id, turn, unnest(range(len(run))) AS subquery, unnest(run) AS query FROM r")
def execution_list(spark, sf_dir):
    keyed = analyzed(spark, sf_dir).withColumn("qid", F.struct("conv_id", "turn"))
    return analysis.searches(keyed).select("qid.conv_id", "qid.turn", "subquery", "query")


@query(f"""WITH {ANALYZED} SELECT conv_id, turn, CASE WHEN ambiguous THEN 'clarify' WHEN regexp_matches(trim(question), {_re(analysis.GREETING)}) THEN 'greeting' WHEN regexp_matches(question, {_re(analysis.DOCUMENTS)}) AND regexp_matches(question, {_re(analysis.INVENTORY)}) THEN 'inventory' ELSE 'retrieve' END AS route FROM a7""")
def question_route(spark, sf_dir):
    return analyzed(spark, sf_dir).select("conv_id", "turn", analysis.route(F.col("question"), F.col("ambiguous")).alias("route"))


@query("""SELECT conv_id, turn, CASE WHEN text IS NULL OR length(trim(text)) = 0 THEN 'empty_question' WHEN length(trim(text)) > 2000 THEN 'question_too_long' WHEN NOT conv_id % 23 BETWEEN 1 AND 20 THEN 'top_k_out_of_range' WHEN turn > 6 THEN 'too_many_turns' END AS problem FROM conversations""")
def request_validation(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", analysis.rejected(F.col("text"), F.col("conv_id") % 23, F.col("turn")).alias("problem"))


# Evidence and citations

TERMS = f"list_sort(list_distinct(list_filter({stemmed('question')}, lambda t: NOT list_contains({listed(text.GATE_STOP)}, t))))"
FACTS = f"list_distinct(list_transform(regexp_extract_all(content, {_re(evidence.FACT)}, 1), lambda m: array_to_string(({stemmed('m')})[1:8], ' ')))"
GATED = f"""asked_q AS (SELECT qid, question, {TERMS} AS terms FROM qs), own AS (SELECT qid, {stemmed("concat_ws(' ', content, title, section, sheet_name)")} AS own, {FACTS} AS facts FROM pack),
met AS (SELECT a.qid, a.question, a.terms, o.own, list_intersect(a.terms, o.own) AS hit, CASE WHEN len(list_intersect(a.terms, o.own)) > 0 THEN o.facts END AS facts FROM asked_q a LEFT JOIN own o USING (qid)),
gate AS (SELECT qid, any_value(question) AS question, any_value(terms) AS terms, count(own) AS n, list_sort(list_distinct(flatten(list(hit)))) AS matched, len(list_distinct(flatten(list(facts)))) AS said FROM met GROUP BY qid)"""
GATE = f"{PACK}, {GATED}"


@query(f"""WITH {GATE}, r AS (SELECT *, CASE WHEN n = 0 THEN 'no_retrieved_evidence' WHEN regexp_matches(question, {_re(evidence.CONFLICT)}) AND said > 1 THEN 'conflicting_evidence' WHEN len(matched) < CASE WHEN len(terms) <= 2 THEN 1 ELSE 2 END THEN 'insufficient_query_overlap' ELSE 'supported_evidence' END AS reason FROM gate)
SELECT qid, reason = 'supported_evidence' AS sufficient, reason, array_to_string(terms, ' ') AS query_terms, array_to_string(matched, ' ') AS matched_terms FROM r""")
def evidence_gate(spark, sf_dir):
    gate = evidence.evidence_gate(questions(spark, sf_dir), context(spark, sf_dir))
    return gate.select("qid", "sufficient", "reason", F.array_join("query_terms", " ").alias("query_terms"), F.array_join("matched_terms", " ").alias("matched_terms"))


@query(f"WITH chunks AS ({CHUNKS_SQL}) SELECT doc_id, {FACTS.replace('list_distinct', 'list_sort(list_distinct', 1)}) AS x FROM chunks".replace("AS x FROM", "AS sigs FROM").replace(f"SELECT doc_id, {FACTS.replace('list_distinct', 'list_sort(list_distinct', 1)}) AS sigs", f"SELECT doc_id, array_to_string(list_sort({FACTS}), ';') AS sigs"))
def conflict_signatures(spark, sf_dir):
    return chunks(spark, sf_dir).select("doc_id", F.array_join(F.array_sort(evidence.signatures(F.col("content"))), ";").alias("sigs"))


# Answers cite the pack's chunks in ways that differ by question: plain, doubled, grouped, with pages, and one invented
_SPARK_ANSWER = "CASE qid % 6 WHEN 0 THEN concat('First [', a, '] then [', coalesce(b, a), '] and [', a, '].') WHEN 1 THEN concat('Nested [[', a, ']].') WHEN 2 THEN concat('Both [', a, ', ', coalesce(b, a), ']') WHEN 3 THEN concat('See [', a, ', page 3]') WHEN 4 THEN concat('Known [', a, '] and [feedfeed].') ELSE 'No mark.' END"
ANSWERS = f"{PACK}, firsts AS (SELECT qid, max(CASE WHEN position = 1 THEN id END) AS a, max(CASE WHEN position = 2 THEN id END) AS b FROM pack GROUP BY qid), answers AS (SELECT qid, a, b, {_SPARK_ANSWER} AS answer FROM firsts)"


def answers(pack):
    firsts = pack.groupBy("qid").agg(F.max(F.when(F.col("position") == 1, F.col("id"))).alias("a"), F.max(F.when(F.col("position") == 2, F.col("id"))).alias("b"))
    return firsts.withColumn("answer", F.expr(_SPARK_ANSWER))


@query(f"""WITH {ANSWERS}, p AS (SELECT w.qid, max(CASE WHEN position = 1 THEN page_number END) AS page FROM pack w GROUP BY w.qid)
SELECT qid, ok, CASE WHEN ok THEN CASE WHEN qid % 6 IN (0, 2) AND b IS NOT NULL THEN concat(a, ',', b) ELSE a END END AS cited FROM (SELECT qid, a, b, coalesce(CASE qid % 6 WHEN 0 THEN TRUE WHEN 1 THEN TRUE WHEN 2 THEN TRUE WHEN 3 THEN page = 3 ELSE FALSE END, FALSE) AS ok FROM answers JOIN p USING (qid))""")
def citation_verify(spark, sf_dir):
    pack = context(spark, sf_dir)
    found = evidence.verify_citations(answers(pack).select("qid", "answer"), pack)
    return found.select("qid", "ok", F.array_join(F.col("citations.chunk_id"), ",").alias("cited"))


@query(f"""WITH {ANSWERS}, p AS (SELECT w.qid, max(CASE WHEN position = 1 THEN page_number END) AS page FROM pack w GROUP BY w.qid)
SELECT qid, CASE qid % 6 WHEN 0 THEN answer WHEN 1 THEN concat('Nested [', a, '].') WHEN 2 THEN concat('Both [', a, '] [', coalesce(b, a), ']') WHEN 3 THEN CASE WHEN page = 3 THEN concat('See [', a, ']') END END AS normalized FROM answers JOIN p USING (qid)""")
def citation_marks(spark, sf_dir):
    """Answers with their citations written as plain marks."""
    pack = context(spark, sf_dir)
    return evidence.verify_citations(answers(pack).select("qid", "answer"), pack).select("qid", "normalized")


@query(f"""WITH {ANSWERS}, shown AS (SELECT qid, CASE qid % 6 WHEN 0 THEN CASE WHEN b IS NULL THEN 'First [1] then [1] and [1].' ELSE 'First [1] then [2] and [1].' END WHEN 1 THEN 'Nested [[1]].' WHEN 2 THEN concat('Both [', a, ', ', coalesce(b, a), ']') WHEN 3 THEN concat('See [', a, ', page 3]') WHEN 4 THEN 'Known [1] and [feedfeed].' ELSE 'No mark.' END AS shown FROM answers)
SELECT qid, CASE WHEN qid % 6 = 1 THEN 'Nested [ [1]].' ELSE shown END AS shown FROM shown""")
def display_numbers(spark, sf_dir):
    ids = F.filter(F.array("a", "b"), lambda x: x.isNotNull())
    return answers(context(spark, sf_dir)).select("qid", evidence.display_answer(F.col("answer"), ids).alias("shown"))


# The corpus table


def _desired(c: str) -> str:
    return f"SELECT * REPLACE (CASE WHEN doc_id % 9 = 0 THEN concat(section, '!') ELSE section END AS section) FROM {c} WHERE doc_id % 7 > 0"


RECONCILE = f"chunks AS ({CHUNKS_SQL}), ids AS (SELECT *, substr(sha256(concat(document_id, '|doc:', CAST(doc_id AS VARCHAR), '|', content_hash)), 1, 24) AS id FROM chunks), existing AS (SELECT * FROM ids WHERE doc_id % 5 > 0), desired AS ({_desired('ids')}), " + """acts AS (SELECT coalesce(d.id, e.id) AS id, CASE WHEN e.id IS NULL THEN 'insert' WHEN d.id IS NULL THEN 'delete' WHEN d.section IS NOT DISTINCT FROM e.section THEN 'unchanged' ELSE 'update' END AS action FROM desired d FULL JOIN existing e ON d.id = e.id)"""


def both_states(spark, sf_dir):
    """The stored corpus lacks each fifth document, the wanted one each seventh, and each ninth has changed."""
    rows = with_ids(chunks(spark, sf_dir)).withColumn("allowed_groups", F.array(F.lower("department")))
    desired = rows.filter("doc_id % 7 > 0").withColumn("section", F.when(F.col("doc_id") % 9 == 0, F.concat("section", F.lit("!"))).otherwise(F.col("section")))
    return desired, rows.filter("doc_id % 5 > 0")


@query(f"WITH {RECONCILE} SELECT id, action FROM acts")
def reconcile_actions(spark, sf_dir):
    return corpus.reconcile(*both_states(spark, sf_dir))


@query(f"WITH {RECONCILE} SELECT count(*) FILTER (WHERE action <> 'delete') AS desired, count(*) FILTER (WHERE action IN ('insert', 'update')) AS uploaded, count(*) FILTER (WHERE action = 'unchanged') AS unchanged, count(*) FILTER (WHERE action = 'delete') AS deleted FROM acts")
def reconcile_report(spark, sf_dir):
    return corpus.reconcile_report(corpus.reconcile(*both_states(spark, sf_dir)))


@query(f"WITH {RECONCILE} SELECT id FROM existing WHERE id NOT IN (SELECT id FROM desired)")
def stale_ids(spark, sf_dir):
    return corpus.stale_ids(*both_states(spark, sf_dir))


@query(f"""WITH s AS (SELECT DISTINCT concat(source, '/', lang) AS p FROM documents), m AS (SELECT DISTINCT concat(upper(source), '/', lang) AS p FROM documents WHERE doc_id % 4 = 0 UNION SELECT DISTINCT concat('absent/', source) FROM documents)
SELECT coalesce(s.p, m.p) AS source_path, CASE WHEN m.p IS NULL THEN 'metadata is missing' WHEN s.p IS NULL THEN 'declared source is missing' ELSE 'prepared' END AS outcome FROM s FULL JOIN m ON {fold('s.p')} = {fold('m.p')}""")
def manifest_outer(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    sources = docs.select(F.concat_ws("/", "source", "lang").alias("source_path")).distinct()
    declared = docs.filter("doc_id % 4 = 0").select(F.concat_ws("/", F.upper("source"), "lang").alias("source_path")).union(docs.select(F.concat(F.lit("absent/"), "source"))).distinct()
    return corpus.match_manifest(sources, declared)


@query(f"""WITH l AS (SELECT DISTINCT {fold("concat(source, '/', lang)")} AS source_path FROM documents), r AS (SELECT DISTINCT {fold("concat(upper(source), '/', lang)")} AS source_path FROM documents WHERE doc_id % 4 = 0 UNION SELECT DISTINCT {fold("concat('absent/', source)")} FROM documents)
SELECT coalesce(l.source_path, r.source_path) AS source_path, CASE WHEN r.source_path IS NULL THEN 'left' ELSE 'right' END AS side FROM l FULL JOIN r ON l.source_path = r.source_path WHERE l.source_path IS NULL OR r.source_path IS NULL""")
def key_differences(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    declared = docs.filter("doc_id % 4 = 0").select(F.concat_ws("/", F.upper("source"), "lang").alias("source_path")).union(docs.select(F.concat(F.lit("absent/"), "source")))
    return corpus.key_differences(docs.select(F.concat_ws("/", "source", "lang").alias("source_path")), declared, "source_path")


SOURCES = f"chunks AS ({CHUNKS_SQL}), sources AS (SELECT replace(source_path, chr(92), '/') AS source_path, title FROM chunks QUALIFY row_number() OVER (PARTITION BY {SKEY} ORDER BY doc_id) = 1)"
PARENT = f"{fold('list_extract(string_split(source_path, chr(47)), -2)')}"


@query(f"WITH {SOURCES} SELECT source_path, title FROM sources")
def distinct_inventory(spark, sf_dir):
    return corpus.distinct_sources(chunks(spark, sf_dir), "doc_id")


@query(f"WITH {SOURCES} SELECT {PARENT} AS department, count(*) AS n_documents, concat(CAST(count(*) AS VARCHAR), ' ', {PARENT}, CASE WHEN count(*) = 1 THEN ' document is indexed' ELSE ' documents are indexed' END) AS summary FROM sources GROUP BY {PARENT}")
def inventory_counts(spark, sf_dir):
    return corpus.inventory_counts(corpus.distinct_sources(chunks(spark, sf_dir), "doc_id"))


@query(f"""WITH {SOURCES}, asked AS (SELECT conv_id * 1000 + turn AS qid, {fold("concat(text, ' in src', CAST(conv_id % 23 AS VARCHAR), ' please')")} AS q FROM conversations), dep AS (SELECT DISTINCT {PARENT} AS department FROM sources)
SELECT qid, department FROM asked JOIN dep ON regexp_matches(q, concat('(^|[^A-Za-z0-9_])', department, '($|[^A-Za-z0-9_])')) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY length(department) DESC, department) = 1""")
def department_filter(spark, sf_dir):
    asked = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), F.concat(F.coalesce("text", F.lit("")), F.lit(" in src"), (F.col("conv_id") % 23).cast("string"), F.lit(" please")).alias("question"))
    return corpus.department_in_question(asked, corpus.distinct_sources(chunks(spark, sf_dir), "doc_id"))


USED = "texts AS (SELECT 'embedding' AS category, text FROM documents UNION ALL SELECT CASE WHEN role = 'assistant' THEN 'chat_output' ELSE 'chat_input' END, text FROM conversations), used AS (SELECT category, CAST(sum((strlen(coalesce(text, '')) + 3) // 4) AS BIGINT) AS tokens FROM texts GROUP BY category)"


def used_texts(spark, sf_dir):
    said = read(spark, sf_dir, "conversations").select(F.when(F.col("role") == "assistant", "chat_output").otherwise("chat_input").alias("category"), "text")
    return read(spark, sf_dir, "documents").select(F.lit("embedding").alias("category"), "text").unionByName(said)


@query(f"WITH {USED} SELECT category, tokens FROM used")
def token_estimate(spark, sf_dir):
    return corpus.usage(used_texts(spark, sf_dir))


@query(f"""WITH {USED} SELECT category AS model, tokens, CAST(CAST(tokens AS DECIMAL(18,0)) * CASE category WHEN 'embedding' THEN 0.02 WHEN 'chat_input' THEN 0.40 ELSE 1.60 END::DECIMAL(9,6) * 0.000001::DECIMAL(7,6) AS VARCHAR) AS cost FROM used""")
def cost_decimal(spark, sf_dir):
    prices = corpus.usage(used_texts(spark, sf_dir)).select(F.col("category").alias("model"), F.when(F.col("category") == "embedding", "0.02").when(F.col("category") == "chat_input", "0.40").otherwise("1.60").cast("decimal(9,6)").alias("usd_per_million"))
    return corpus.cost(corpus.usage(used_texts(spark, sf_dir)).withColumnRenamed("category", "model"), prices)


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS worst FROM events GROUP BY event_type")
def latency_summary(spark, sf_dir):
    return corpus.latency_summary(read(spark, sf_dir, "events"), "event_type", "value")


@query(f"""WITH {BM25}, exp AS (SELECT DISTINCT b.item_id AS qid, d.source FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
ret AS (SELECT qid, d.source, rank FROM bm25 JOIN documents d USING (doc_id) WHERE rank <= 5), m AS (SELECT r.*, e.source IS NOT NULL AS good FROM ret r LEFT JOIN exp e ON r.qid = e.qid AND r.source = e.source),
g AS (SELECT qid, count(*) AS n, count(*) FILTER (WHERE good) AS fit, count(DISTINCT CASE WHEN good THEN source END) AS found FROM m GROUP BY qid), need AS (SELECT qid, count(*) AS k FROM exp GROUP BY qid)
SELECT qid, CASE WHEN coalesce(found, 0) > 0 THEN 1 ELSE 0 END::BIGINT AS hit, round(coalesce(found, 0) / CAST(k AS DOUBLE), 6) AS recall, round(coalesce(fit / CAST(n AS DOUBLE), 0.0), 6) AS precision FROM need LEFT JOIN g USING (qid)""")
def retrieval_metrics(spark, sf_dir):
    """Expected sources hold the whole passage, which is looked for inside the scan."""
    docs, found = read(spark, sf_dir, "documents"), bm25(spark, sf_dir)
    passages = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    expected = search.containing(docs.select("source", "text"), passages).select("qid", "source").distinct()
    retrieved = found.join(docs.select("doc_id", "source"), "doc_id").select("qid", "source", "rank")
    return corpus.retrieval_metrics(expected, retrieved)


@query("""WITH j AS (SELECT o_orderpriority AS run, CAST(o_orderkey % 5 AS BIGINT) AS correctness, CAST(o_custkey % 5 AS BIGINT) AS completeness, CAST((o_orderkey + o_custkey) % 5 AS BIGINT) AS grounding, CAST(o_orderkey // 5 % 5 AS BIGINT) AS citation_quality FROM orders)
SELECT run, count(*) AS n, CAST(sum(correctness + completeness + grounding + citation_quality) AS BIGINT) AS total, round(100 * sum(correctness + completeness + grounding + citation_quality) / (count(*) * 16.0), 6) AS percent,
  round(avg(correctness), 6) AS mean_correctness, round(avg(completeness), 6) AS mean_completeness, round(avg(grounding), 6) AS mean_grounding, round(avg(citation_quality), 6) AS mean_citation_quality FROM j GROUP BY run""")
def judgment_totals(spark, sf_dir):
    names = ["correctness", "completeness", "grounding", "citation_quality"]
    rows = read(spark, sf_dir, "orders").selectExpr("o_orderpriority as run", "o_orderkey % 5 as correctness", "o_custkey % 5 as completeness", "(o_orderkey + o_custkey) % 5 as grounding", "o_orderkey div 5 % 5 as citation_quality")
    return corpus.judgment_totals(rows, "run", names)


@query("""WITH m AS (SELECT concat(source, '-', CAST(doc_id % 13 AS VARCHAR)) AS document_type, doc_id % 4 = 0 AS is_current FROM documents) SELECT lower(document_type) AS family, count(*) AS n, count(*) FILTER (WHERE is_current) AS n_current, count(*) FILTER (WHERE is_current) = 1 AS valid FROM m GROUP BY 1 HAVING count(*) > 1""")
def family_invariant(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").selectExpr("concat(source, '-', cast(doc_id % 13 as string)) as document_type", "doc_id % 4 = 0 as is_current")
    return corpus.family_violations(rows)


@query(f"""WITH chunks AS ({CHUNKS_SQL}), m AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN ' ' ELSE title END AS title, CASE WHEN doc_id % 8 = 0 THEN 'pdf' ELSE file_type END AS file_type, source_path, effective_from, CASE WHEN doc_id % 12 = 5 THEN effective_from - 1 ELSE effective_to END AS effective_to, doc_id % 6 = 1 AS twice FROM chunks)
SELECT doc_id, concat_ws('; ', CASE WHEN trim(title) = '' THEN 'title is empty' END, CASE WHEN lower(regexp_extract(source_path, '[.]([^./]+)$', 1)) <> file_type THEN 'suffix differs from file type' END, CASE WHEN effective_from > effective_to THEN 'dates are out of order' END, CASE WHEN twice THEN 'groups repeat' END) AS problems FROM m""")
def manifest_validation(spark, sf_dir):
    n = F.col("doc_id")
    rows = chunks(spark, sf_dir).withColumn("title", F.when(n % 10 == 0, " ").otherwise(F.col("title"))).withColumn("file_type", F.when(n % 8 == 0, "pdf").otherwise(F.col("file_type")))
    rows = rows.withColumn("effective_to", F.when(n % 12 == 5, F.date_sub("effective_from", 1)).otherwise(F.col("effective_to"))).withColumn("allowed_groups", F.when(n % 6 == 1, F.array(F.lit("Staff"), F.lit("staff"))).otherwise(F.array(F.lit("staff"))))
    return rows.select("doc_id", F.array_join(corpus.manifest_problems(F.col("source_path")), "; ").alias("problems"))


@query(f"WITH chunks AS ({CHUNKS_SQL}) SELECT doc_id, effective_from, effective_to, CASE WHEN effective_to IS NOT NULL THEN concat(CAST(effective_to AS VARCHAR), 'T00:00:00Z') END AS stored FROM chunks")
def codec_roundtrip(spark, sf_dir):
    rows = corpus.to_index_row(chunks(spark, sf_dir).withColumn("allowed_groups", F.lit(None).cast("array<string>")))
    return corpus.from_index_row(rows.withColumn("stored", F.col("effective_to")), ["effective_from", "effective_to"]).select("doc_id", "effective_from", "effective_to", "stored")


@query("SELECT doc_id FROM documents WHERE lower(source) IN ('src1', 'src7')")
def acl_filter(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", F.array("source").alias("allowed_groups"))
    return corpus.allowed(rows, ["SRC1", "src7"]).select("doc_id")


#: Who may read a document (by its source, some also the staff, some nobody), and the groups of a question's caller (some have none).
ALLOWED = "CASE WHEN doc_id % 13 > 0 THEN CASE WHEN doc_id % 10 = 0 THEN array(source, 'Staff') ELSE array(source) END END"
CALLERS = "CASE WHEN {q} % 7 > 0 THEN array(concat('SRC', CAST({q} % 20 AS STRING)), concat('src', CAST(({q} * 3 + 1) % 20 AS STRING)), CASE WHEN {q} % 3 = 0 THEN 'staff' ELSE 'guests' END) END"
ALLOWED_SQL = "SELECT doc_id, list_transform(CASE WHEN doc_id % 13 > 0 THEN CASE WHEN doc_id % 10 = 0 THEN [source, 'Staff'] ELSE [source] END END, lambda g: lower(g)) AS allowed FROM documents"
CALLERS_SQL = "list_transform(CASE WHEN {q} % 7 > 0 THEN [concat('SRC', CAST({q} % 20 AS VARCHAR)), concat('src', CAST(({q} * 3 + 1) % 20 AS VARCHAR)), CASE WHEN {q} % 3 = 0 THEN 'staff' ELSE 'guests' END] END, lambda g: lower(g))"


@query(f"""WITH {BM25}, opened AS ({ALLOWED_SQL})
SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM hits JOIN opened USING (doc_id) WHERE list_has_any(allowed, {CALLERS_SQL.format(q='qid')}) QUALIFY rank <= 20""")
def acl_bm25_topk(spark, sf_dir):
    """Keyword search in which each question sees what its caller may read."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("title of "), F.coalesce("lang", F.lit(""))).alias("title"), "text", F.expr(ALLOWED).alias("allowed_groups"))
    asked = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text", F.expr(CALLERS.format(q="item_id")).alias("groups"))
    return search.bm25_top_k(docs, asked, columns=("title", "text"), access=True)


@query(f"""WITH {KNN.format(k=20)}, opened AS ({ALLOWED_SQL.replace('doc_id', 'vec_id').replace('source', "concat('src', CAST(label AS VARCHAR))").replace('documents', 'embeddings')})
SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM sims JOIN opened ON id = vec_id WHERE list_has_any(allowed, {CALLERS_SQL.format(q='qid')}) QUALIFY rank <= 20""")
def acl_knn_indexed(spark, sf_dir):
    """Vector search over stored cells in which each query sees what its caller may read."""
    from tessera.plans import vector_index

    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.expr(ALLOWED.replace("doc_id", "vec_id").replace("source", "concat('src', CAST(label AS STRING))")).alias("allowed_groups"))
    index = f"{store.work_dir(spark)}/tessera-cells-{uuid.uuid4().hex}"
    vector_index.build(spark, vectors, index)
    asked = vectors.filter(F.col("id") % 20 == 0).select(F.col("id").alias("qid"), "vec", F.expr(CALLERS.format(q="id")).alias("groups"))
    return vector_index.search(spark, index, asked, access=True)


@query(f"""WITH {SOURCES}, who AS (SELECT item_id AS qid, {CALLERS_SQL.format(q='item_id')} AS groups FROM benchmark),
entries AS (SELECT source_path, {fold('source_path')} AS k, {PARENT} AS department, concat('- ', title, ' - ', source_path) AS line FROM sources),
met AS (SELECT w.qid, count(*) AS n, string_agg(e.line, chr(10) ORDER BY e.k, e.source_path) AS lines FROM who w JOIN entries e ON list_has_any([e.department], w.groups) GROUP BY w.qid)
SELECT qid, CASE WHEN n IS NULL THEN 'No documents are currently indexed.' ELSE concat(CAST(n AS VARCHAR), CASE WHEN n = 1 THEN ' document is indexed' ELSE ' documents are indexed' END, CASE WHEN qid % 2 = 0 THEN '.' ELSE concat(':', chr(10), lines) END) END AS answer FROM who LEFT JOIN met USING (qid)""")
def acl_inventory(spark, sf_dir):
    """How many documents, or which, the caller of each question may read."""
    from tessera.plans import answers

    sources = corpus.distinct_sources(chunks(spark, sf_dir), "doc_id").withColumn("allowed_groups", F.array(identity.parent_of(F.col("source_path"))))
    asked = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.when(F.col("item_id") % 2 == 0, "How many documents are there?").otherwise("Which documents are available?").alias("question"), F.expr(CALLERS.format(q="item_id")).alias("groups"))
    return answers.inventory(asked, sources, access=True)


# Whole questions: retrieve, select, gate, answer from the first chunk, verify


@query(f"""WITH {GATE}, shut AS (SELECT *, CASE WHEN n = 0 THEN FALSE WHEN regexp_matches(question, {_re(evidence.CONFLICT)}) AND said > 1 THEN FALSE ELSE len(matched) >= CASE WHEN len(terms) <= 2 THEN 1 ELSE 2 END END AS sufficient FROM gate),
said AS (SELECT s.qid, s.sufficient, p.id, CASE WHEN s.sufficient THEN concat(substr(regexp_replace(p.content, '[\\[\\]]', '', 'g'), 1, 120), ' [', p.id, ']') ELSE '{analysis.REFUSAL}' END AS answer FROM shut s LEFT JOIN pack p ON s.qid = p.qid AND p.position = 1)
SELECT qid, CASE WHEN sufficient THEN 'answered' ELSE 'insufficient_evidence' END AS status, sha256(answer) AS answer_hash, CASE WHEN sufficient THEN id END AS cited FROM said""")
def question_answers(spark, sf_dir):
    from tessera.plans import plugins

    pack = context(spark, sf_dir)
    gate = evidence.evidence_gate(questions(spark, sf_dir), pack)
    made = plugins.extractive_answers(pack, gate, analysis.REFUSAL)
    checked = evidence.verify_citations(made, pack)
    joined = made.join(checked, "qid")
    return joined.select("qid", F.when(F.col("ok"), "answered").otherwise("insufficient_evidence").alias("status"), F.sha2(F.when(F.col("ok"), F.col("answer")).otherwise(analysis.REFUSAL), 256).alias("answer_hash"), F.element_at("citations", 1)["chunk_id"].alias("cited"))


# The whole path with all its branches: benchmark questions, how many documents each source has and which, the same of all, a greeting and a question without a subject

PATH_QUESTIONS = """SELECT qid, question FROM (SELECT qid, question FROM qs0 UNION ALL SELECT -1 - row_number() OVER (ORDER BY source), concat('how many documents are in ', source, '?') FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)
  UNION ALL SELECT -2000 - row_number() OVER (ORDER BY source), concat('List the files of ', upper(source), ', please.') FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)
  UNION ALL SELECT -1000004, 'Which documents are available?' UNION ALL SELECT -1000001, 'Hello there!' UNION ALL SELECT -1000002, 'Tell me about the policy' UNION ALL SELECT -1000003, 'How many files are indexed?')"""
PATH = f"""qs0 AS ({QUESTIONS}), prior AS (SELECT qid AS conv_id, CAST(0 AS BIGINT) AS turn, 'user' AS role, question AS text, CAST(NULL AS VARCHAR) AS prior FROM ({PATH_QUESTIONS})), {ANALYSIS},
routed AS (SELECT conv_id AS qid, s, intent, question AS asked, CASE WHEN len(subs) > 1 AND subs[1] = s THEN subs[2:] ELSE subs END AS run,
  CASE WHEN ambiguous THEN 'clarify' WHEN regexp_matches(trim(question), {_re(analysis.GREETING)}) THEN 'greeting' WHEN regexp_matches(question, {_re(analysis.DOCUMENTS)}) AND regexp_matches(question, {_re(analysis.INVENTORY)}) THEN 'inventory' ELSE 'retrieve' END AS route FROM a7),
subs AS (SELECT qid * 3 + i AS item_id, run[i + 1] AS text FROM (SELECT qid, run, unnest(range(len(run))) AS i FROM routed WHERE route = 'retrieve')), {BM25.replace('FROM benchmark', 'FROM subs')}, {RRF}, chunks AS ({CHUNKS_SQL}),
{HITS[HITS.index('hits3 AS'):].replace('b.qid // 3 AS qid, b.qid % 3 AS subquery', 'CAST(floor(b.qid / 3.0) AS BIGINT) AS qid, b.qid - 3 * CAST(floor(b.qid / 3.0) AS BIGINT) AS subquery').replace('FROM bm25 b JOIN chunks c USING (doc_id)', 'FROM rrf b JOIN chunks c ON b.id = c.doc_id')},
lead_ AS (SELECT f.*, r.s, r.intent, row_number() OVER (PARTITION BY qid, family ORDER BY CASE WHEN coverage = 1 THEN 0 ELSE 1 END, best_score DESC, best_rank, first_subquery, usual) = 1 AS lead FROM flat f JOIN routed r USING (qid)),
best20 AS (SELECT *, CASE WHEN intent = 'comparison' THEN row_number() OVER (PARTITION BY qid ORDER BY lead DESC, CASE WHEN lead THEN CASE WHEN coverage = 1 THEN 0 ELSE 1 END END, CASE WHEN lead THEN -best_score END, CASE WHEN lead THEN best_rank END, CASE WHEN lead THEN first_subquery END, usual) ELSE usual END AS rank FROM lead_ QUALIFY rank <= 20),
kept AS (SELECT * FROM hits3 QUALIFY row_number() OVER (PARTITION BY qid, id ORDER BY subquery, rank) = 1), qs AS (SELECT qid, s AS question FROM routed WHERE route = 'retrieve'),
cands AS (SELECT k.* EXCLUDE (family, same, subquery) REPLACE (b.rank AS rank), b.s AS question, b.intent IN ('historical', 'comparison') AS historical FROM best20 b JOIN kept k ON b.qid = k.qid AND b.id = k.id)"""


@query(f"""WITH {PATH}, {PACKED}, {GATED}, shut AS (SELECT *, CASE WHEN n = 0 THEN FALSE WHEN regexp_matches(question, {_re(evidence.CONFLICT)}) AND said > 1 THEN FALSE ELSE len(matched) >= CASE WHEN len(terms) <= 2 THEN 1 ELSE 2 END END AS sufficient FROM gate),
{SOURCES[SOURCES.index('sources AS'):]}, listed AS (SELECT {PARENT} AS department, list_extract(string_split(source_path, chr(47)), -2) AS spelled, {fold('source_path')} AS k, source_path, concat('- ', title, ' - ', source_path) AS line FROM sources),
dep AS (SELECT department, min(spelled) AS spelled, count(*) AS k, string_agg(line, chr(10) ORDER BY k, source_path) AS lines FROM listed GROUP BY 1), every AS (SELECT count(*) AS k, string_agg(line, chr(10) ORDER BY k, source_path) AS lines FROM listed),
inv AS (SELECT r.qid, d.spelled, coalesce(d.k, (SELECT k FROM every)) AS k, coalesce(d.lines, (SELECT lines FROM every)) AS lines FROM routed r LEFT JOIN dep d ON regexp_matches({fold('r.asked')}, concat('(^|[^A-Za-z0-9_])', d.department, '($|[^A-Za-z0-9_])')) WHERE r.route = 'inventory' QUALIFY row_number() OVER (PARTITION BY r.qid ORDER BY length(d.department) DESC, d.department) = 1),
told AS (SELECT r.qid, r.route, r.intent, s.sufficient, p.id, CASE r.route WHEN 'clarify' THEN '{analysis.CLARIFICATION}' WHEN 'greeting' THEN '{analysis.GREETING_ANSWER}'
  WHEN 'inventory' THEN concat(CAST(i.k AS VARCHAR), coalesce(' ' || i.spelled, ''), CASE WHEN i.k = 1 THEN ' document is indexed' ELSE ' documents are indexed' END, CASE WHEN regexp_matches(r.asked, {_re(analysis.COUNTING)}) THEN '.' ELSE concat(':', chr(10), i.lines) END)
  ELSE CASE WHEN s.sufficient THEN concat(substr(regexp_replace(p.content, '[\\[\\]]', '', 'g'), 1, 120), ' [', p.id, ']') ELSE '{analysis.REFUSAL}' END END AS answer, coalesce(c.k, 0) AS retrieved_chunks
  FROM routed r LEFT JOIN shut s ON r.qid = s.qid LEFT JOIN pack p ON r.qid = p.qid AND p.position = 1 LEFT JOIN inv i ON r.qid = i.qid LEFT JOIN (SELECT qid, count(*) AS k FROM pack GROUP BY qid) c ON r.qid = c.qid)
SELECT qid, route, CASE WHEN route = 'clarify' THEN 'clarification' WHEN route <> 'retrieve' OR sufficient THEN 'answered' ELSE 'insufficient_evidence' END AS status, sha256(answer) AS answer_hash, CASE WHEN sufficient THEN id END AS cited, retrieved_chunks, intent AS temporal_intent FROM told""")
def answer_path(spark, sf_dir):
    """All branches: analysis, routes, hybrid search of each sub-question, fusion, selection, gate, answer, verified citations."""
    return answered(spark, sf_dir).select("qid", "route", "status", F.sha2("answer", 256).alias("answer_hash"), F.element_at("citations", 1)["chunk_id"].alias("cited"), "retrieved_chunks", "temporal_intent")


SHUT = f"shut AS (SELECT *, CASE WHEN n = 0 THEN FALSE WHEN regexp_matches(question, {_re(evidence.CONFLICT)}) AND said > 1 THEN FALSE ELSE len(matched) >= CASE WHEN len(terms) <= 2 THEN 1 ELSE 2 END END AS sufficient FROM gate)"


@query(f"""WITH {PATH}, {PACKED}, {GATED}, {SHUT}, given AS (SELECT p.qid, CAST(sum((strlen(p.content) + 3) // 4) AS BIGINT) AS k FROM pack p GROUP BY p.qid),
used AS (SELECT r.qid, r.route, CASE WHEN r.route = 'clarify' THEN 'clarification' WHEN r.route <> 'retrieve' OR s.sufficient THEN 'answered' ELSE 'insufficient_evidence' END AS status, CASE WHEN r.route = 'retrieve' THEN CAST(list_sum(list_transform(r.run, lambda x: (strlen(x) + 3) // 4)) AS BIGINT) ELSE 0 END AS e,
  CASE WHEN s.sufficient THEN (strlen(r.s) + 3) // 4 + coalesce(g.k, 0) ELSE 0 END AS i, CASE WHEN s.sufficient THEN (strlen(concat(substr(regexp_replace(p.content, '[\\[\\]]', '', 'g'), 1, 120), ' [', p.id, ']')) + 3) // 4 ELSE 0 END AS o
  FROM routed r LEFT JOIN shut s ON r.qid = s.qid LEFT JOIN given g ON r.qid = g.qid LEFT JOIN pack p ON r.qid = p.qid AND p.position = 1)
SELECT route, status, count(*) AS n, CAST(sum(e) AS BIGINT) AS embedding_tokens, CAST(sum(i) AS BIGINT) AS chat_input_tokens, CAST(sum(o) AS BIGINT) AS chat_output_tokens FROM used GROUP BY route, status""")
def answer_usage(spark, sf_dir):
    """Tokens of the calls that were made, by route and status: refused questions cost their search only."""
    from tessera.plans import answers as path

    made = store.materialise(answered(spark, sf_dir), "answered")
    kinds = ["embedding_tokens", "chat_input_tokens", "chat_output_tokens"]
    return made.select("qid", "route", "status").join(path.usage(made), "qid").groupBy("route", "status").agg(F.count(F.lit(1)).alias("n"), *(F.sum(k).alias(k) for k in kinds))


@query(f"""WITH {KNN.format(k=5)}, chunks AS ({CHUNKS_SQL}), hits AS (SELECT k.qid, substr(sha256(concat(c.document_id, '|doc:', CAST(c.doc_id AS VARCHAR), '|', c.content_hash)), 1, 24) AS id, c.content, row_number() OVER (PARTITION BY k.qid ORDER BY k.rank) AS position, count(*) OVER (PARTITION BY k.qid) AS n FROM knn k JOIN chunks c ON k.id = c.doc_id)
SELECT q.qid, CASE WHEN id IS NULL THEN 'insufficient_evidence' ELSE 'answered' END AS status, sha256(CASE WHEN id IS NULL THEN '{analysis.REFUSAL}' ELSE concat(substr(regexp_replace(content, '[\\[\\]]', '', 'g'), 1, 120), ' [', id, ']') END) AS answer_hash, id AS cited, coalesce(n, 0) AS retrieved_chunks
FROM (SELECT DISTINCT qid FROM knn) q LEFT JOIN hits h ON q.qid = h.qid AND h.position = 1""")
def baseline_path(spark, sf_dir):
    """The plain path with its answer: vector search for five, generation, citations by plain marks only."""
    from tessera.plans import answers as path

    known = with_ids(chunks(spark, sf_dir)).withColumn("key", F.col("doc_id"))
    hits = knn(spark, sf_dir, 5)
    made = path.baseline(hits.select("qid", F.lit("").alias("question")).distinct(), hits, known)
    return made.select("qid", "status", F.sha2("answer", 256).alias("answer_hash"), F.element_at("citations", 1)["chunk_id"].alias("cited"), "retrieved_chunks")


def answered(spark, sf_dir):
    from tessera.plans import answers as path

    rows = spark.sql(f"WITH qs0 AS ({QUESTIONS.replace('FROM benchmark', 'FROM {benchmark}')}) {PATH_QUESTIONS.replace('FROM documents', 'FROM {documents}')}", benchmark=read(spark, sf_dir, "benchmark"), documents=read(spark, sf_dir, "documents"))
    asked = rows.select("qid", "question", F.lit(None).cast("string").alias("prior"))
    known = with_ids(chunks(spark, sf_dir)).withColumn("key", F.col("doc_id"))
    return path.answer(asked, lambda q: hybrid(spark, sf_dir, q), known, "doc_id")


@query(f"WITH {KNN.format(k=5)} SELECT k.qid, count(*) AS n_context, string_agg(CAST(k.id AS VARCHAR), ',' ORDER BY k.rank) AS ids, sum(length(coalesce(d.text, '')))::BIGINT AS n_chars FROM knn k JOIN documents d ON k.id = d.doc_id GROUP BY k.qid")
def baseline_answers(spark, sf_dir):
    """The plain path: vector search for five, no selection or gate."""
    hits = knn(spark, sf_dir, 5).join(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), "id")
    ids = F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"].cast("string"))
    return hits.groupBy("qid").agg(F.count(F.lit(1)).alias("n_context"), F.array_join(ids, ",").alias("ids"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("n_chars"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions by all routes, with hybrid retrieval, fusion, selection, gate and verified citations."""
    return answer_path(spark, sf_dir)
