"""Document structure: word and row windows, sections, table rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.identity import chunk_id, document_id
from tessera.functions.names import private
from tessera.functions.text import words
from tessera.operators import carry


def check_window(size: int, overlap: int, least: int = 1) -> None:
    if size < least or not 0 <= overlap < size:
        raise ValueError(f"windows need size >= {least} and 0 <= overlap < size")


def window_count(n: Column, size: int, overlap: int) -> Column:
    """How many windows cover n items, the last one ending with them."""
    return F.when(n == 0, 0).when(n <= size, 1).otherwise(F.ceil((n - size) / F.lit(float(size - overlap))) + 1).cast("int")


def word_windows(df: DataFrame, text: str, size: int = 120, overlap: int = 20) -> DataFrame:
    """Explodes a text into overlapping word windows: chunk_number from 1, word_start, word_end (exclusive), content."""
    check_window(size, overlap)
    step = size - overlap
    held, k, i = private(df.columns, "words", "k", "i")
    spread = df.withColumn(held, words(F.col(text)))
    counted = spread.withColumn(k, window_count(F.size(held), size, overlap))
    # texts without words are left out by the explode: a filter would be moved below the words and split each text again
    each = counted.withColumn(i, F.explode(F.when(F.col(k) > 0, F.sequence(F.lit(0), F.col(k) - 1))))
    start = F.col(i) * step
    part = F.slice(held, start + 1, F.lit(size))
    made = {"chunk_number": F.col(i) + 1, "word_start": start, "word_end": F.least(start + size, F.size(held)), "content": F.array_join(part, " ")}
    # columns of these names are replaced, as they are what is made
    return each.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in made), *(v.alias(n) for n, v in made.items()))


def identified(chunks: DataFrame, path: str, locator: Column) -> DataFrame:
    """Adds document_id, content_hash and the canonical chunk id."""
    out = chunks.withColumn("document_id", document_id(F.col(path))).withColumn("content_hash", F.sha2("content", 256))
    return out.withColumn("id", chunk_id(F.col("document_id"), locator, F.col("content_hash")))


def row_windows(rows: DataFrame, keys: list[str], number: str, text: str, size: int = 20, overlap: int = 2) -> DataFrame:
    """Groups numbered rows of each key into overlapping windows; a row goes to every window that covers it."""
    check_window(size, overlap, 2)
    step = size - overlap
    total = F.max(number).over(W.partitionBy(*keys))
    k = window_count(total, size, overlap)
    n = F.col(number)
    first = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(float(step))).cast("int"))
    last = F.least(k - 1, F.floor((n - 1) / F.lit(float(step))).cast("int"))
    group, held = private([*rows.columns, "first_row", "last_row", "text"], "group_number", "rows")
    # the windows of a row, from 1: two columns first, as the total is over a window
    low, high = private([*rows.columns, group, held], "low", "high")
    spread = rows.withColumns({low: first + 1, high: last + 1}).withColumn(group, F.explode(F.sequence(low, high)))
    grouped = spread.groupBy(*keys, group).agg(F.min(number).alias("first_row"), F.max(number).alias("last_row"), F.sort_array(F.collect_list(F.struct(n.alias("n"), F.col(text).alias("t")))).alias(held))
    return grouped.select(*keys, F.col(group).alias("group_number"), "first_row", "last_row", F.array_join(F.col(held)["t"], "\n\n").alias("text"))


def overlap_violations(chunks: DataFrame, keys: list[str], overlap: int = 20) -> DataFrame:
    """For each key: windows and pairs of neighbours whose shared words differ."""
    order = W.partitionBy(*keys).orderBy("word_start")
    later, start = private(chunks.columns, "later", "start")
    ahead = chunks.withColumns({later: F.lead("content").over(order), start: F.lead("word_start").over(order)})
    tail = F.slice(F.split("content", " "), F.col(start) - F.col("word_start") + 1, F.lit(overlap))
    bad = F.col(later).isNotNull() & (tail != F.slice(F.split(later, " "), 1, overlap))
    return ahead.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_windows"), F.count_if(bad).alias("n_violations"))


def carry_sections(blocks: DataFrame, keys: list[str], order: str, ranged: bool = False) -> DataFrame:
    """section: the last title or heading up to and with each block. ranged: for documents that no task should hold (see ``carry``; order must be whole numbers)."""
    if ranged:
        return carry.carry(blocks, keys, order, {"section": F.when(F.col("kind").isin("title", "heading"), F.col("text"))})
    so_far = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return blocks.withColumn("section", F.last(F.when(F.col("kind").isin("title", "heading"), F.col("text")), ignorenulls=True).over(so_far))


def paragraph_kind(style: Column) -> Column:
    name = F.lower(style)
    return F.when(name == "title", "title").when(name.startswith("heading"), "heading").when(F.contains(name, F.lit("list")), "list").otherwise("paragraph")


def table_row_text(headers: Column, values: Column, row_number: Column) -> Column:
    """Row 1 names the headers; others pair each header with its value."""
    named = F.zip_with(F.transform(headers, lambda h, i: F.when(F.coalesce(h, F.lit("")) != "", h).otherwise(F.concat(F.lit("Column "), (i + 1).cast("string")))), values, lambda h, v: F.concat(h, F.lit(": "), F.when(F.coalesce(v, F.lit("")) != "", v).otherwise("[blank]")))
    heads = F.transform(headers, lambda h: F.when(F.coalesce(h, F.lit("")) != "", h).otherwise("[blank]"))
    return F.when(row_number == 1, F.concat(F.lit("Table headers: "), F.array_join(heads, " | "))).otherwise(F.array_join(named, " | "))


def classify_rows(rows: DataFrame, keys: list[str], order: str, ranged: bool = False) -> DataFrame:
    """kind, headers and table_number of sheet rows (cells array<string>, bold and merged booleans, row_number).

    A blank row ends the active headers, so a row is data if a header came after the last blank. ranged: for tables that no task should hold (see ``carry``).
    """
    filled = F.filter(F.transform("cells", lambda c, i: F.when(c.isNotNull(), i)), lambda i: i.isNotNull())
    count = F.size(filled)
    dense = (count >= 2) & (F.element_at(filled, -1) - F.element_at(filled, 1) == count - 1)
    first = F.try_element_at(F.filter("cells", lambda c: c.isNotNull()), F.lit(1))
    merged_kind = F.when(F.col(order) == 1, "title").when(F.contains(first, F.lit("Effective:")) | F.contains(first, F.lit("Version")), "metadata").when(F.col("bold"), "section").otherwise("note")
    fixed = F.when(count == 0, "blank").when(dense & F.col("bold"), "header").when(F.col("merged"), merged_kind)
    so_far = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    own, stretch, heads = private([*rows.columns, "kind", "headers", "table_number"], "own", "stretch", "heads")
    marked = rows.withColumn(own, fixed)
    if ranged:
        # headers and blanks are events of one kind: the last of them tells the active headers
        event = F.when(F.col(own) == "header", F.struct(F.col("cells").alias("c"))).when(F.col(own) == "blank", F.struct(F.lit(None).cast(rows.schema["cells"].dataType).alias("c")))
        carried = carry.carry(marked, keys, order, {heads: event}, {stretch: F.col(own) == "header"}).withColumn(heads, F.col(heads)["c"])
        tables = F.col(stretch)
    else:
        marked = marked.withColumn(stretch, F.count_if(F.col(own) == "blank").over(so_far))
        within = W.partitionBy(*keys, stretch).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
        carried = marked.withColumn(heads, F.last(F.when(F.col(own) == "header", F.col("cells")), ignorenulls=True).over(within))
        tables = F.count_if(F.col(own) == "header").over(so_far)
    kind = F.coalesce(own, F.when(F.col(heads).isNotNull(), "data").otherwise("key_value"))
    named = carried.withColumn("kind", kind).withColumn("headers", F.when(F.col("kind").isin("header", "data"), F.col(heads)))
    numbered = named.withColumn("table_number", F.when(F.col("kind").isin("header", "data"), tables).cast("int"))
    return numbered.drop(own, stretch, heads)


def column_letter(i: Column) -> Column:
    """A, B, ... Z, AA, ... of a column number from 1 to 18,278."""
    letter = lambda n: F.char(F.lit(65) + n)
    low, mid, high = (i - 1) % 26, F.floor((i - 27) / 26) % 26, F.floor((i - 703) / 676)
    return F.concat(F.when(i > 702, letter(high)).otherwise(""), F.when(i > 26, letter(mid)).otherwise(""), letter(low))


def render_row(workbook: Column, sheet: Column, number: Column) -> Column:
    """The text of a classified sheet row with its context (cells, headers, kind, table_number)."""
    values = F.zip_with(F.transform("headers", lambda h, i: F.when(F.coalesce(h, F.lit("")) != "", h).otherwise(F.concat(F.lit("Column "), column_letter(i + 1)))), F.col("cells"), lambda h, v: F.concat(h, F.lit("="), F.coalesce(v, F.lit("[blank]"))))
    plain = F.filter(F.transform("cells", lambda v, i: F.when(v.isNotNull(), F.concat(column_letter(i + 1), F.lit("="), F.when(v != "", v).otherwise("[no cached value]")))), lambda x: x.isNotNull())
    heads = F.array_join(F.transform("headers", lambda h: F.when(F.coalesce(h, F.lit("")) != "", h).otherwise("[blank header]")), " | ")
    body = F.when(F.col("kind") == "header", F.concat(F.lit("Headers: "), heads)).when(F.col("kind") == "data", F.concat(F.lit("Values: "), F.array_join(values, "; "))).otherwise(F.concat(F.lit("Values: "), F.array_join(plain, "; ")))
    table = F.when(F.col("table_number").isNotNull(), F.concat(F.lit("Table: "), F.col("table_number").cast("string")))
    return F.concat_ws("\n", F.concat(F.lit("Workbook: "), workbook), F.concat(F.lit("Sheet: "), sheet), F.concat(F.lit("Row: "), number.cast("string")), F.concat(F.lit("Kind: "), F.col("kind")), table, body)


def adjacent_rows(rows: DataFrame, keys: list[str], number: str, id_col: str) -> DataFrame:
    """Pairs (id, other_id) of rows whose numbers differ by one; null keys are equal."""
    left, right = rows.alias("l"), rows.alias("r")
    # the neighbour's number is an equi key, so the range needs no nested loop
    other, at, *twins = private([*rows.columns, "id"], "other_id", "at", *keys)
    up = right.select(*[F.col(k).alias(t) for k, t in zip(keys, twins, strict=True)], F.col(id_col).alias(other), F.explode(F.array(F.col(number) - 1, F.col(number) + 1)).alias(at))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(t)) for k, t in zip(keys, twins, strict=True)]
    cond = F.col(f"l.{number}") == F.col(at)
    for s in same:
        cond = cond & s
    return left.join(up, cond).select(F.col(f"l.{id_col}").alias("id"), F.col(other).alias("other_id"))


def formula_values(formulas: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """Cells whose formula is text starting with = take the cached value, others their literal."""
    joined = formulas.join(values.select(*keys, F.col("value").alias("_cached")), keys)
    is_formula = F.col("value").startswith("=")
    return joined.select(*keys, F.when(is_formula, F.col("_cached")).otherwise(F.col("value")).alias("value"), F.when(is_formula, F.col("value")).alias("formula"))
