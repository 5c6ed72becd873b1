"""Files to chunks to the stored corpus: parse, chunk, describe, reconcile, write in one step."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text
from tessera.functions.identity import chunk_id, document_id, short_hash
from tessera.functions.names import private
from tessera.operators import corpus, structure
from tessera.plans import store, versions
from tessera.plans.plugins import Embedder, embed
from tessera.sources import listing, parsers

#: The stored chunk; the vector is added on writing.
CHUNK = T.StructType(
    [T.StructField(n, t, n not in ("id", "content", "title", "source_path", "allowed_groups")) for n, t in (
        ("id", T.StringType()), ("content", T.StringType()), ("title", T.StringType()), ("source_path", T.StringType()), ("page_number", T.IntegerType()), ("section", T.StringType()), ("score", T.DoubleType()),
        ("document_id", T.StringType()), ("content_hash", T.StringType()), ("file_type", T.StringType()), ("department", T.StringType()), ("document_type", T.StringType()), ("version", T.StringType()),
        ("effective_from", T.DateType()), ("effective_to", T.DateType()), ("is_current", T.BooleanType()), ("sheet_name", T.StringType()), ("table_number", T.IntegerType()), ("row_number", T.IntegerType()), ("allowed_groups", T.ArrayType(T.StringType())),
    )]
)
MANIFEST = "source_path string, title string, file_type string, department string, document_type string, version string, effective_from date, effective_to date, is_current boolean, allowed_groups array<string>"


PRICES = ["pricing_id", "currency", "source_note"]
#: Fixed value: the one known way to estimate tokens.
TOKEN_METHOD = "utf8-bytes-divided-by-4-v1"


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("wholetext", True).text(path).select(F.col("value").alias("j"), F.try_parse_json("value").alias("v"))


def _kind(v: Column, path: str) -> Column:
    """The JSON type at a path: STRING, BIGINT, BOOLEAN, VOID, ARRAY<...>, OBJECT<...>; null where there is none."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _refuse(checks: DataFrame, what: str) -> None:
    """Raises what a frame of problems says; a handful comes to the driver."""
    found = [r.problem for r in checks.filter("problem is not null").limit(20).collect()]
    if found:
        raise ValueError(f"{what}: " + "; ".join(sorted(found)))


def manifest_checks(spark: SparkSession, path: str, version: int = 1) -> tuple[DataFrame, DataFrame]:
    """(documents, problems) of a manifest file: problems name each breach of fields, types, values, single paths and version families."""
    raw = _whole(spark, path)
    keys = F.array_sort(F.json_object_keys("j"))
    top = raw.select(
        F.when(F.col("v").isNull() | keys.isNull(), "the manifest is no JSON object").when(keys != F.array(F.lit("documents"), F.lit("schema_version")), "the manifest must hold schema_version and documents only")
        .when((_kind(F.col("v"), "$.schema_version") != "BIGINT") | (F.try_variant_get("v", "$.schema_version", "int") != version), "another manifest version").when(~_kind(F.col("v"), "$.documents").startswith("ARRAY"), "documents must be a list").alias("problem")
    )
    each = raw.select(F.posexplode(F.try_variant_get("v", "$.documents", "array<variant>")).alias("nth", "d")).withColumn("e", F.to_json("d"))
    names = [f.split()[0] for f in MANIFEST.split(", ")]
    kinds = {n: _kind(F.col("d"), f"$.{n}") for n in names}
    wrong = F.filter(F.array(*(F.when(~F.coalesce(kinds[n] == ("BOOLEAN" if n == "is_current" else "STRING"), F.lit(False)), n) for n in names if n not in ("allowed_groups", "effective_from", "effective_to"))), lambda x: x.isNotNull())
    days = F.filter(F.array(*(F.when((kinds[n] != "VOID") & F.try_to_date(F.try_variant_get("d", f"$.{n}", "string"), "yyyy-MM-dd").isNull(), n) for n in ("effective_from", "effective_to"))), lambda x: x.isNotNull())
    fields = F.array_sort(F.json_object_keys("e"))
    shape = F.when(fields.isNull() | (fields != F.array_sort(F.array(*map(F.lit, names)))), "fields are missing or unknown").when(F.size(wrong) > 0, F.concat(F.lit("wrong type of "), F.array_join(wrong, ", "))).when(
        F.size(days) > 0, F.concat(F.lit("no ISO date in "), F.array_join(days, ", "))
    ).when(kinds["allowed_groups"] != "ARRAY<STRING>", "allowed_groups must be a list of texts")
    typed = each.select("nth", shape.alias("shape"), F.from_json("e", MANIFEST).alias("m")).select("nth", "shape", "m.*")
    tidy = {n: F.btrim(n) for n in ("title", "department", "document_type", "version")}
    documents = typed.withColumns(tidy | {"file_type": text.fold(F.col("file_type")), "allowed_groups": F.array_sort(F.transform("allowed_groups", lambda g: text.fold(F.btrim(g))))})
    said = F.concat(corpus.manifest_problems(F.col("source_path")), corpus.manifest_field_problems(F.col("source_path")))
    rows = documents.select(F.concat(F.lit("document "), (F.col("nth") + 1).cast("string"), F.lit(": "), F.coalesce(F.col("shape"), F.when(F.size(said) > 0, F.array_join(said, ", ")))).alias("problem"))
    twice = documents.groupBy(text.fold(F.col("source_path")).alias("k")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.concat(F.lit("source_path stands twice: "), F.col("k")).alias("problem"))
    families = corpus.family_violations(documents).filter("not valid").select(F.concat(F.lit("a version family needs one current document: "), F.col("family")).alias("problem"))
    return documents.select(*names), top.unionByName(rows).unionByName(twice).unionByName(families)


def load_manifest(spark: SparkSession, path: str, version: int = 1) -> DataFrame:
    """The declared documents. Another version, missing or unknown fields, wrong types or values, repeated paths and families without exactly one current document are refused here."""
    documents, problems = manifest_checks(spark, path, version)
    _refuse(problems, "the manifest is not valid")
    return documents


def load_prices(spark: SparkSession, path: str, version: int = 1) -> DataFrame:
    """(model, input_usd_per_million_tokens, output_usd_per_million_tokens, effective_date); decimals are read as texts, so none is rounded. Another version, method or date form and missing texts or prices are refused."""
    raw = _whole(spark, path)
    text_of = lambda name: F.btrim(F.try_variant_get("v", f"$.{name}", "string"))
    absent = F.filter(F.array(*(F.when(F.coalesce(text_of(n), F.lit("")) == "", n) for n in [*PRICES, "token_estimation.description"])), lambda x: x.isNotNull())
    top = raw.select(
        F.when(~F.coalesce(F.try_variant_get("v", "$.schema_version", "int") == version, F.lit(False)), "another version of the prices").when(F.coalesce(text_of("token_estimation.method_id"), F.lit("")) != TOKEN_METHOD, "another method of token estimation")
        .when(F.try_to_date(text_of("effective_date"), "yyyy-MM-dd").isNull(), "effective_date must be an ISO date").when(F.size(absent) > 0, F.concat(F.lit("missing: "), F.array_join(absent, ", ")))
        .when(F.coalesce(F.size(F.json_object_keys(F.get_json_object("j", "$.models"))), F.lit(0)) < 1, "models must be a non-empty object").alias("problem")
    )
    names = ["input_usd_per_million_tokens", "output_usd_per_million_tokens"]
    each = raw.select(text_of("effective_date").cast("date").alias("effective_date"), F.explode(F.from_json(F.get_json_object("j", "$.models"), "map<string,struct<" + ",".join(f"{n}:string" for n in names) + ">>")).alias("model", "p"))
    each = each.select("model", *(F.expr(f"try_cast(p.{n} as decimal(18,9))").alias(n) for n in names), "effective_date")
    bad = each.filter(" or ".join(f"{n} is null or {n} < 0" for n in names)).select(F.concat(F.lit("no price of zero or more for "), F.col("model")).alias("problem"))
    _refuse(top.unionByName(bad), "the prices are not valid")
    return each


def load_frozen(spark: SparkSession, path: str, sha256: str, ids: list[str] | None = None) -> DataFrame:
    """Evaluation cases of a file whose bytes have this hash, which is marked frozen and, if ids are given, has these in this order."""
    data = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("h"), F.col("content").cast("string").alias("j"))
    case = "array<struct<id:string,category:string,answerability:string,question:string,expected_sources:array<string>,expected_facts:array<string>,expected_keyword_groups:array<array<string>>,source_check_mode:string,citation_requirement:string>>"
    read = data.select("h", F.get_json_object("j", "$.frozen").alias("frozen"), F.from_json(F.get_json_object("j", "$.cases"), case).alias("cases"))
    same_ids = F.coalesce(F.col("cases.id") == F.array(*map(F.lit, ids)), F.lit(False)) if ids is not None else F.lit(True)
    problem = F.when(F.col("h") != sha256, "the bytes have changed").when(~F.coalesce(F.col("frozen") == "true", F.lit(False)), "it is not marked frozen").when(~same_ids, "ids or their order have changed")
    _refuse(read.select(problem.alias("problem")), "the frozen dataset is not valid")
    return read.select(F.inline("cases"))


def _canonical(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """Attaches the manifest and the ids to (source_path, locator, content, ...)."""
    for name, kind in (("page_number", "int"), ("section", "string"), ("sheet_name", "string"), ("table_number", "int"), ("row_number", "int")):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    meta = manifest.withColumnRenamed("source_path", "_path")
    joined = rows.join(meta, text.fold(F.col("source_path")) == text.fold(F.col("_path"))).drop("source_path").withColumnRenamed("_path", "source_path")
    out = joined.withColumn("document_id", document_id(F.col("source_path"))).withColumn("content_hash", F.sha2("content", 256)).withColumn("score", F.lit(None).cast("double"))
    out = out.withColumn("id", chunk_id(F.col("document_id"), F.col("locator"), F.col("content_hash"))).withColumn("allowed_groups", F.coalesce("allowed_groups", F.array().cast("array<string>")))
    return out.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in CHUNK.fields))


def pdf_chunks(pages: DataFrame) -> DataFrame:
    made = structure.word_windows(pages.withColumn("text", text.page_text(F.col("text"))), "text", 120, 20)
    return made.withColumn("locator", F.concat_ws(":", F.lit("pdf"), F.col("page_number").cast("string"), F.col("chunk_number").cast("string")))


def docx_chunks(blocks: DataFrame) -> DataFrame:
    from pyspark.sql import Window as W

    heads = F.first("cells").over(W.partitionBy("source_path", "table_number").orderBy("row_number"))
    row_text = structure.table_row_text(F.transform(heads, text.block_text), F.transform("cells", text.block_text), F.col("row_number"))
    named = blocks.withColumn("_row", F.when(F.col("table_number").isNotNull(), row_text))
    named = named.withColumn("kind", F.when(F.col("table_number").isNotNull(), "table_row").otherwise(structure.paragraph_kind(F.col("style")))).withColumn("text", F.coalesce("_row", text.block_text(F.col("text")))).filter("text <> ''")
    named = named.withColumn("block_number", F.row_number().over(W.partitionBy("source_path").orderBy("block_number")))
    made = structure.word_windows(structure.carry_sections(named, ["source_path"], "block_number").select("source_path", "block_number", "text", "section", "table_number", "row_number"), "text", 160, 30)
    made = made.withColumn("chunk_number", F.row_number().over(W.partitionBy("source_path").orderBy("block_number", "chunk_number")))
    return made.withColumn("locator", F.concat_ws(":", F.lit("docx"), F.col("block_number").cast("string"), F.col("chunk_number").cast("string")))


def xlsx_chunks(rows: DataFrame) -> DataFrame:
    """A chunk for each row that is not blank and one for each window of rows of a sheet."""
    from pyspark.sql import Window as W

    kinds = structure.classify_rows(rows, ["source_path", "sheet_number"], "row_number").filter("kind <> 'blank'")
    # cells show their formula behind the value
    shown = F.zip_with("cells", "formulas", lambda v, f: F.when(f.isNull(), v).otherwise(F.concat(F.coalesce(v, F.when(F.col("kind") == "data", "[blank]").otherwise("[no cached value]")), F.lit(" [formula: "), f, F.lit("]"))))
    said = kinds.withColumn("cells", shown).withColumn("content", structure.render_row(F.element_at(F.split("source_path", "/"), -1), F.col("sheet_name"), F.col("row_number")))
    single = said.withColumn("section", F.concat_ws(" / ", "sheet_name", "kind")).withColumn("locator", F.concat_ws(":", F.lit("xlsx"), F.col("sheet_number").cast("string"), F.col("row_number").cast("string")))
    nth = said.withColumn("_n", F.row_number().over(W.partitionBy("source_path", "sheet_number").orderBy("row_number")))
    groups = structure.row_windows(nth, ["source_path", "sheet_number", "sheet_name"], "_n", "content")
    edges = nth.select("source_path", "sheet_number", "_n", F.col("row_number").alias("_row"))
    groups = groups.join(edges.withColumnsRenamed({"_n": "first_row", "_row": "_first"}), ["source_path", "sheet_number", "first_row"]).join(edges.withColumnsRenamed({"_n": "last_row", "_row": "_last"}), ["source_path", "sheet_number", "last_row"])
    locator = F.concat_ws(":", F.lit("xlsx-group"), *(F.col(c).cast("string") for c in ("sheet_number", "group_number", "_first", "_last")))
    grouped = groups.select("source_path", "sheet_name", F.col("text").alias("content"), F.concat(F.lit("Grouped rows: "), F.col("sheet_name")).alias("section"), F.col("_first").alias("row_number"), locator.alias("locator"))
    wanted = ["source_path", "sheet_name", "content", "section", "row_number", "locator"]
    return single.select(*wanted, "table_number").unionByName(grouped, allowMissingColumns=True)


def flatten(files: DataFrame, pdf_reader: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """(source_path, text): each file as one stream of words without its structure: pages, paragraphs and cells, values or formulas, in order."""
    blocks, rows = parsers.good(parsers.read_docx(files)), parsers.good(parsers.read_xlsx(files))
    cells = lambda values: F.array_join(F.filter(F.transform(values, text.squeeze), lambda x: x != ""), " ")
    parts = blocks.select("source_path", F.struct(F.lit(1).alias("a"), F.col("block_number").alias("b")).alias("at"), F.when(F.col("table_number").isNotNull(), cells("cells")).otherwise(text.squeeze(F.col("text"))).alias("t"))
    values = F.zip_with("cells", "formulas", lambda v, f: F.coalesce(F.nullif(v, F.lit("")), f))
    parts = parts.unionByName(rows.select("source_path", F.struct(F.col("sheet_number").alias("a"), F.col("row_number").alias("b")).alias("at"), cells(values).alias("t")))
    if pdf_reader:
        pages = parsers.good(parsers.read_pdf(files, pdf_reader))
        parts = parts.unionByName(pages.select("source_path", F.struct(F.lit(1).alias("a"), F.col("page_number").alias("b")).alias("at"), text.squeeze(text.page_text(F.col("text"))).alias("t")))
    # one document's words fit a row, as its file did
    return parts.filter("t <> ''").groupBy("source_path").agg(F.array_join(F.sort_array(F.collect_list(F.struct("at", "t")))["t"], " ").alias("text"))


def baseline_chunks(flat: DataFrame, size: int = 120, overlap: int = 20) -> DataFrame:
    """(source_path, word_start, content, id): plain word windows, named by source, place and content."""
    key = F.concat_ws("|", F.lit("baseline"), "source_path", F.col("word_start").cast("string"), "content")
    return structure.word_windows(flat, "text", size, overlap).select("source_path", "word_start", "content", F.concat(F.lit("baseline-"), short_hash(key)).alias("id"))


def prepare(spark: SparkSession, path: str, root: str, manifest: DataFrame, pdf_reader: Callable[[bytes], list[str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(chunks, problems) of a folder. Every file and every declared document ends as chunks or as a problem, none is dropped without a word.

    problems: (logical_path, problem): a listing code, a missing partner in the manifest, why a file could not be read (also: no reader for its kind), or that it gave no chunks.
    One file that can't be read never ends the job. Files are parsed once and what they hold is stored; chunks and problems are read from that.
    """
    files = listing.scan(spark, path, root)
    listed = store.materialise(files.select("logical_path", "code"), "listed")
    matched = store.materialise(corpus.match_manifest(listed.filter("code is null").select(F.col("logical_path").alias("source_path")), manifest), "matched")
    names = matched.filter("outcome = 'prepared'").select(F.col("source_path").alias("logical_path"))
    good = files.filter("code is null").select("logical_path", "content").join(names, "logical_path", "left_semi")
    docx, xlsx = store.materialise(parsers.read_docx(good), "docx"), store.materialise(parsers.read_xlsx(good), "xlsx")
    parsed, parts = [docx, xlsx], [docx_chunks(parsers.good(docx)), xlsx_chunks(parsers.good(xlsx))]
    if pdf_reader:
        parsed.append(store.materialise(parsers.read_pdf(good, pdf_reader), "pdf"))
        parts.append(pdf_chunks(parsers.good(parsed[-1])))
    made = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    bad = reduce(DataFrame.unionByName, (p.filter("error is not null").select(F.col("source_path").alias("logical_path"), F.concat(F.lit("unreadable: "), F.col("error")).alias("problem")) for p in parsed))
    if not pdf_reader:
        bad = bad.unionByName(names.filter(F.lower("logical_path").endswith(".pdf")).select("logical_path", F.lit("unreadable: no reader for PDF files").alias("problem")))
    told = made.select(F.col("source_path").alias("logical_path")).unionByName(bad.select("logical_path")).distinct()
    empty = names.join(told, "logical_path", "left_anti").withColumn("problem", F.lit("no searchable chunks"))
    unmatched = matched.filter("outcome <> 'prepared'").select(F.col("source_path").alias("logical_path"), F.col("outcome").alias("problem"))
    problems = listed.filter("code is not null").select("logical_path", F.col("code").alias("problem")).unionByName(unmatched).unionByName(bad).unionByName(empty)
    return _canonical(made, manifest), problems


#: Times a writer starts again from the newest version when another one has changed what it had read.
ATTEMPTS = 8
SHAPE = T.StructType([*CHUNK.fields, T.StructField("content_vector", T.ArrayType(T.FloatType()))])


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("document_id"), F.lit(buckets)).cast("int")


def _again(change: Callable[[versions.Version | None], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Runs a change against the newest version, and again after a conflict."""

    def run(spark: SparkSession, location: str) -> DataFrame:
        for attempt in range(ATTEMPTS):
            try:
                return change(versions.version(spark, location))
            except versions.Conflict:
                if attempt + 1 == ATTEMPTS:
                    raise
        raise AssertionError

    return run


def upsert(spark: SparkSession, desired: DataFrame, location: str, embedder: Embedder) -> DataFrame:
    """Makes the stored corpus equal to ``desired`` and gives the counts. Only chunks whose content is new are embedded, only buckets with a change are written. Of writers at one time each takes its turn (see ``versions``)."""
    return _again(lambda base: _write(spark, desired, versions.read(spark, location, SHAPE, base), location, embedder, base, None))(spark, location)


def replace_documents(spark: SparkSession, rows: DataFrame, location: str, embedder: Embedder, documents: DataFrame | None = None) -> DataFrame:
    """Makes the documents named in ``rows`` (or by ``documents``: document_id) equal to their rows there, leaves all others, and gives the counts; documents without rows go.

    Only the buckets of these documents are read, and only writers of the same buckets make it start again.
    """
    named = store.materialise((rows if documents is None else documents).select("document_id").distinct(), "replaced")

    def change(base: versions.Version | None) -> DataFrame:
        touched = {r.b for r in named.select(bucket_of(base.buckets if base else versions.BUCKETS).alias("b")).distinct().collect()}
        existing = versions.read(spark, location, SHAPE, base, touched)
        others = existing.drop("content_vector").join(named, "document_id", "left_anti")
        own = rows.join(named, "document_id", "left_semi")
        return _write(spark, own.select(*others.columns).unionByName(others), existing, location, embedder, base, touched)

    return _again(change)(spark, location)


def _write(spark: SparkSession, desired: DataFrame, existing: DataFrame, location: str, embedder: Embedder, base: versions.Version | None, touched: set[int] | None) -> DataFrame:
    """Writes the changed buckets beside the old ones and commits them; nothing if nothing has changed."""
    state = existing.drop("content_vector")
    actions = store.materialise(corpus.reconcile(desired, state), "actions")
    report = corpus.reconcile_report(actions)
    counts = report.first()
    if base and not counts.uploaded and not counts.deleted:
        return report
    fresh = _with_vectors(desired.join(actions.filter("action in ('insert', 'update')").select("id"), "id", "left_semi"), existing, embedder)
    kept = existing.join(actions.filter("action = 'unchanged'").select("id"), "id", "left_semi")
    before = base.buckets if base else versions.BUCKETS
    buckets, total = before, (counts.desired if touched is None else counts.uploaded - counts.deleted + base.rows if base else counts.desired)
    while total > versions.BUCKET_ROWS * buckets:
        buckets *= 4
    if buckets > before and touched is not None:  # all buckets are dealt anew, so all rows are read
        kept = versions.read(spark, location, SHAPE, base).join(desired.select("document_id").unionByName(state.select("document_id")).distinct(), "document_id", "left_anti").unionByName(kept)
        touched = None
    if buckets > before:
        changed = set(range(buckets))
    else:
        moved = actions.filter("action <> 'unchanged'").select("id")
        homes = desired.select("id", "document_id").unionByName(state.select("id", "document_id"))
        changed = {r.b for r in homes.join(moved, "id", "left_semi").select(bucket_of(buckets).alias("b")).distinct().collect()}
        kept = kept.filter(bucket_of(buckets).isin(changed))
    data = versions.write(fresh.unionByName(kept.select(*fresh.columns)).withColumn("bucket", bucket_of(buckets)), location)
    versions.commit(spark, location, base, buckets, changed, data, touched)
    return report


def _with_vectors(rows: DataFrame, existing: DataFrame, embedder: Embedder) -> DataFrame:
    """rows with content_vector: the vector that a chunk of the same content had among the existing ones, else a new one. So a chunk that was moved, renamed or described anew costs no call."""
    h, held = private([*rows.columns, *existing.columns], "content_key", "held_vector")
    keyed = rows.withColumn(h, F.sha2("content", 256))
    usable = existing.filter(F.size("content_vector") == embedder.dimension).withColumn(h, F.sha2("content", 256))
    known = usable.join(keyed.select(h).distinct(), h, "left_semi").groupBy(h).agg(F.min("content_vector").alias(held))
    met = store.materialise(keyed.join(known, h, "left").drop(h), "fresh")
    old = met.filter(F.col(held).isNotNull()).withColumnRenamed(held, "content_vector")
    return embed(met.filter(F.col(held).isNull()).drop(held), "content", embedder).unionByName(old)


def current(spark: SparkSession, location: str, number: int | None = None) -> DataFrame:
    """The newest version of the corpus, or an older one that is still there; empty if there is none. A later commit does not change what is read."""
    return versions.read(spark, location, SHAPE, versions.version(spark, location, number))
