"""The corpus as a table: manifest, reconcile, inventory, costs, quality measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.identity import parent_of, source_key
from tessera.functions.text import fold, token_estimate
from tessera.sources.listing import SUFFIXES, unsafe

#: Fixed value: the columns by which a chunk counts as unchanged.
STATE = ["content_hash", "document_id", "title", "source_path", "file_type", "department", "document_type", "version", "effective_from", "effective_to", "is_current", "page_number", "section", "sheet_name", "table_number", "row_number", "allowed_groups"]


def match_manifest(sources: DataFrame, manifest: DataFrame) -> DataFrame:
    """(source_path, outcome): every source and every declared document, matched without case."""
    left = sources.select(fold(F.col("source_path")).alias("_k"), F.col("source_path").alias("_s"))
    right = manifest.select(fold(F.col("source_path")).alias("_k"), F.col("source_path").alias("_m"))
    outcome = F.when(F.col("_m").isNull(), "metadata is missing").when(F.col("_s").isNull(), "declared source is missing").otherwise("prepared")
    return left.join(right, "_k", "full_outer").select(F.coalesce("_s", "_m").alias("source_path"), outcome.alias("outcome"))


def reconcile(desired: DataFrame, existing: DataFrame, state: list[str] = STATE) -> DataFrame:
    """(id, action): insert, update, unchanged or delete. States are compared null-safely; a repeated desired id is an error."""
    once = desired.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("id")))
    checked = once.select("id", F.struct(*state).alias("_d"), F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("repeated chunk id "), F.col("id"))).cast("boolean")).otherwise(True).alias("_here"))
    held = existing.select("id", F.struct(*state).alias("_e"), F.lit(True).alias("_there"))
    action = F.when(F.col("_there").isNull(), "insert").when(F.col("_here").isNull(), "delete").when(F.col("_d").eqNullSafe(F.col("_e")), "unchanged").otherwise("update")
    # the error column takes part, so that it is evaluated
    return checked.join(held, "id", "full_outer").select("id", F.when(F.coalesce("_here", F.lit(True)), action).alias("action"))


def reconcile_report(actions: DataFrame) -> DataFrame:
    of = lambda *names: F.count_if(F.col("action").isin(*names))
    return actions.agg(of("insert", "update", "unchanged").alias("desired"), of("insert", "update").alias("uploaded"), of("unchanged").alias("unchanged"), of("delete").alias("deleted"))


def stale_ids(desired: DataFrame, existing: DataFrame) -> DataFrame:
    return existing.select("id").join(desired.select("id"), "id", "left_anti")


def distinct_sources(chunks: DataFrame, arrival: str) -> DataFrame:
    """(source_path, title): one row for each path, compared without case and slash direction; the first title wins."""
    key = source_key(F.col("source_path"))
    first = chunks.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(arrival))).filter("_n = 1")
    return first.select(F.replace(F.col("source_path"), F.lit("\\"), F.lit("/")).alias("source_path"), "title")


def inventory_counts(sources: DataFrame) -> DataFrame:
    """(department, n_documents, summary) with the sentence for each department."""
    counted = sources.groupBy(fold(parent_of(F.col("source_path"))).alias("department")).agg(F.count(F.lit(1)).alias("n_documents"))
    one = F.col("n_documents") == 1
    return counted.withColumn("summary", F.concat_ws(" ", F.col("n_documents").cast("string"), F.nullif("department", F.lit("")), F.when(one, "document is indexed").otherwise("documents are indexed")))


def department_in_question(questions: DataFrame, sources: DataFrame) -> DataFrame:
    """(qid, department): the longest department that stands as a word in the question, ties by name.

    Departments meet the questions' words by their first word, an equi join, and are then looked for as a whole in the texts, which are joined for those questions only: no text is repeated for its words. Spark would take
    the words for as few as the questions, so it is told to merge rather than to send them whole to all tasks.
    """
    names = sources.select(fold(parent_of(F.col("source_path"))).alias("department")).filter("department <> ''").distinct()
    lead = lambda c: F.regexp_extract(c, "[a-z0-9_]+", 0)
    asked = questions.select("qid", fold(F.col("question")).alias("_text"))
    tokens = asked.select("qid", F.explode(F.array_distinct(F.regexp_extract_all("_text", F.lit("[a-z0-9_]+"), F.lit(0)))).alias("_lead"))
    near = tokens.hint("merge").join(names.withColumn("_lead", lead(F.col("department"))), "_lead").select("qid", "department").distinct()
    hits = asked.hint("merge").join(near, "qid")
    there = F.expr(r"_text rlike concat('(?<![A-Za-z0-9_])\\Q', department, '\\E(?![A-Za-z0-9_])')")
    order = W.partitionBy("qid").orderBy(F.desc(F.length("department")), "department")
    return hits.filter(there).withColumn("_n", F.row_number().over(order)).filter("_n = 1").select("qid", "department")


def usage(texts: DataFrame) -> DataFrame:
    """Tokens by category."""
    return texts.groupBy("category").agg(F.sum(token_estimate(F.coalesce("text", F.lit("")))).alias("tokens"))


def cost(tokens: DataFrame, prices: DataFrame) -> DataFrame:
    """(model, tokens, cost): exact to twelve digits; a model without a price is an error."""
    joined = tokens.join(prices, "model", "left")
    price = F.coalesce("usd_per_million", F.raise_error(F.concat(F.lit("no price for "), F.col("model"))).cast("decimal(9,6)"))
    exact = F.col("tokens").cast("decimal(18,0)") * price * F.lit("0.000001").cast("decimal(7,6)")
    return joined.select("model", "tokens", exact.cast("decimal(36,12)").cast("string").alias("cost"))


def retrieval_metrics(expected: DataFrame, retrieved: DataFrame, k: int = 5) -> DataFrame:
    """(qid, hit, recall, precision) over the k first; expected: distinct (qid, source); retrieved: (qid, source, rank)."""
    top = retrieved.filter(F.col("rank") <= k)
    wanted = expected.select("qid", "source").distinct().withColumn("_want", F.lit(True))
    marked = top.join(wanted, ["qid", "source"], "left")
    got = marked.groupBy("qid").agg(F.count(F.lit(1)).alias("_n"), F.count("_want").alias("_right"), F.count_distinct(F.when(F.col("_want"), F.col("source"))).alias("_found"))
    need = wanted.groupBy("qid").agg(F.count(F.lit(1)).alias("_need"))
    joined = need.join(got, "qid", "left")
    return joined.select("qid", (F.coalesce("_found", F.lit(0)) > 0).cast("int").alias("hit"), F.round(F.coalesce("_found", F.lit(0)) / F.col("_need"), 6).alias("recall"), F.round(F.coalesce(F.col("_right") / F.col("_n"), F.lit(0.0)), 6).alias("precision"))


def percentiles(df: DataFrame, by: str, value: str, shares: dict[str, float], cuts: int = 255) -> DataFrame:
    """(by, one column a share): exact percentiles, linear between neighbours, without a group ever meeting in one task.

    Values fall into buckets between approximate quantiles. The counts of a group's buckets tell in which buckets its wanted ranks lie; only these buckets' rows are counted value by value.
    """
    rows = df.filter(F.col(value).isNotNull()).select(by, F.col(value).cast("double").alias("v"))
    edges = sorted(set(rows.approxQuantile("v", [i / (cuts + 1) for i in range(1, cuts + 1)], 1 / (4 * cuts))))

    def halves(low: int, high: int) -> str:
        """How many edges lie below v, by halving."""
        mid = (low + high) // 2
        return str(low) if low == high else f"CASE WHEN v <= {edges[mid]!r}D THEN {halves(low, mid)} ELSE {halves(mid + 1, high)} END"

    edges = [e for e in edges if abs(e) < float("inf")]  # of the infinite ones the ends take care
    named = rows.withColumn("bucket", F.expr(halves(0, len(edges))))
    counts = named.groupBy(by, "bucket").agg(F.count(F.lit(1)).alias("n"))  # at most 256 rows a group
    group = W.partitionBy(by)
    counts = counts.withColumn("all", F.sum("n").over(group)).withColumn("before", F.sum("n").over(group.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("n"))
    spots = [F.struct(F.lit(name).alias("name"), (F.lit(share) * (F.col("all") - 1)).alias("spot")) for name, share in shares.items()]
    wanted = counts.select(by, "bucket", "n", "before", F.explode(F.array(*spots)).alias("s")).select(by, "bucket", "n", "before", "s.name", "s.spot")
    wanted = wanted.withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("spot"), F.ceil("spot"))))).filter((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n")))
    here = wanted.select(F.col(by).alias("_by"), F.col("bucket").alias("_bucket"), "before").distinct()
    values = named.join(here, F.col(by).eqNullSafe(F.col("_by")) & (F.col("bucket") == F.col("_bucket"))).groupBy(by, "bucket", "before", "v").agg(F.count(F.lit(1)).alias("times"))
    inner = W.partitionBy(by, "bucket").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    values = values.withColumn("last", F.col("before") + F.sum("times").over(inner)).withColumn("first", F.col("last") - F.col("times"))
    met = wanted.alias("w").join(values.alias("x"), F.col(f"w.{by}").eqNullSafe(F.col(f"x.{by}")) & (F.col("w.bucket") == F.col("x.bucket")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")))
    share = F.when(F.floor("spot") == F.ceil("spot"), F.lit(1.0)).when(F.col("rank") == F.floor("spot"), F.ceil("spot") - F.col("spot")).otherwise(F.col("spot") - F.floor("spot"))
    found = met.select(F.col(f"w.{by}").alias(by), "name", (share * F.col("v")).alias("part"))
    return found.groupBy(by).agg(*(F.sum(F.when(F.col("name") == name, F.col("part"))).alias(name) for name in shares))


def latency_summary(df: DataFrame, by: str, value: str) -> DataFrame:
    """Mean, exact p50 and p95 (linear between neighbours) and maximum."""
    told = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.max(value).alias("worst"))
    ranks = percentiles(df, by, value, {"p50": 0.5, "p95": 0.95}).withColumnRenamed(by, "_by")
    return told.join(ranks, F.col(by).eqNullSafe(F.col("_by")), "left").select(by, "n", "mean", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"), "worst")


def judgment_totals(judgments: DataFrame, by: str, dimensions: list[str], best: int = 4) -> DataFrame:
    """Total, share of the best total, and means by dimension."""
    total = sum((F.col(d) for d in dimensions[1:]), F.col(dimensions[0]))
    return judgments.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum(total).alias("total"), F.round(100 * F.sum(total) / (F.count(F.lit(1)) * (best * len(dimensions))), 6).alias("percent"), *(F.round(F.avg(d), 6).alias(f"mean_{d}") for d in dimensions))


def family_violations(manifest: DataFrame) -> DataFrame:
    """Families of several documents and how many are current; exactly one must be."""
    grouped = manifest.groupBy(F.lower("document_type").alias("family")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("is_current")).alias("n_current"))
    return grouped.filter("n > 1").withColumn("valid", F.col("n_current") == 1)


def manifest_problems(row_path: Column) -> Column:
    """Why a manifest row is not valid: empty names, a suffix that is not the type, dates in the wrong order, repeated groups."""
    empty = F.coalesce(F.btrim("title"), F.lit("")) == ""
    suffix = F.lower(F.regexp_extract(row_path, r"\.([^./\\]+)$", 1)) != F.col("file_type")
    dates = F.coalesce(F.col("effective_from") > F.col("effective_to"), F.lit(False))
    groups = F.size(F.array_distinct(F.transform("allowed_groups", fold))) != F.size("allowed_groups")
    return F.filter(F.array(F.when(empty, "title is empty"), F.when(suffix, "suffix differs from file type"), F.when(dates, "dates are out of order"), F.when(groups, "groups repeat")), lambda x: x.isNotNull())


def manifest_field_problems(row_path: Column) -> Column:
    """What else a declared row must not be: without department, type or version, of a kind that is not read, at an unsafe path, or without groups."""
    blank = [F.when(F.coalesce(F.btrim(n), F.lit("")) == "", f"{n} is empty") for n in ("department", "document_type", "version")]
    none = F.coalesce(F.size("allowed_groups") < 1, F.lit(True)) | F.exists("allowed_groups", lambda g: F.btrim(g) == "")
    unread = F.when(~F.coalesce(F.col("file_type").isin(*SUFFIXES), F.lit(False)), "no reader for the file type")
    return F.filter(F.array(*blank, unread, F.when(unsafe(row_path), "unsafe path"), F.when(none, "groups are missing or empty")), lambda x: x.isNotNull())


def key_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): the keys, compared without case, that only the left or only the right has; two sets of keys are equal if there is none."""
    sides = left.select(fold(F.col(key)).alias(key), F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(fold(F.col(key)).alias(key), F.lit(0).alias("l"), F.lit(1).alias("r")))
    met = sides.groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r")).filter("l <> r")
    return met.select(key, F.when(F.col("l") == 1, "left").otherwise("right").alias("side"))


def allowed(rows: DataFrame, groups: list[str]) -> DataFrame:
    """Extension: rows that one of the groups may read; to be applied before any ranking."""
    return rows.filter(F.arrays_overlap(F.transform("allowed_groups", fold), F.transform(F.array(*map(F.lit, groups)), fold)))


def to_index_row(chunks: DataFrame) -> DataFrame:
    """Chunks as stored by an index without a date type: dates become midnight in UTC, missing groups an empty list."""
    days = [n for n, t in chunks.dtypes if t == "date"]
    return chunks.withColumns({n: F.concat(F.date_format(n, "yyyy-MM-dd"), F.lit("T00:00:00Z")) for n in days}).withColumn("allowed_groups", F.coalesce("allowed_groups", F.array().cast("array<string>")))


def from_index_row(rows: DataFrame, days: list[str]) -> DataFrame:
    """Back to chunks; a text that is no date or instant fails."""
    return rows.withColumns({n: F.to_date(F.substring(n, 1, 10), "yyyy-MM-dd") for n in days})


def fingerprints(hashes: DataFrame, key: str) -> DataFrame:
    """(key, n, fingerprint): one hash over all SHA-256 texts (column h) of a key, whatever their order.

    Four pieces of 60 bits of each hash are summed apart, and the sums hashed: partial sums meet, so no task or row ever holds a key. What order matters must be part of each hash.
    """
    pieces = [F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)").cast("decimal(38,0)")).cast("string") for i in range(4)]
    return hashes.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.concat_ws("-", *pieces), 256).alias("fingerprint"))
