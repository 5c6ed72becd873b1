import hashlib
import json
import zipfile

import pytest
from pyspark.errors import PySparkException

from tessera.plans import ingest, plugins, versions
from tessera.sources import listing, parsers
from tessera.streaming import ingest as stream

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def write_docx(path):
    def p(text, style=""):
        return f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>' if style else f"<w:p><w:r><w:t>{text}</w:t></w:r></w:p>"

    table = "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in (["Item", ""], ["Laptop", "yes"])) + "</w:tbl>"
    styles = f'<w:styles {W}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{p('Devices', 'H1')}{p('All staff.')}{table}</w:body></w:document>")
        z.writestr("word/styles.xml", styles)


def write_xlsx(path):
    def c(ref, v, kind="inlineStr", s=0, f=""):
        inner = f"<is><t>{v}</t></is>" if kind == "inlineStr" else (f"<f>{f}</f>" if f else "") + f"<v>{v}</v>"
        return f'<c r="{ref}" t="{kind}" s="{s}">{inner}</c>'

    rows = f'<row r="1">{c("A1", "plan", s=1)}{c("B1", "price", s=1)}</row><row r="2">{c("A2", "basic")}{c("B2", "30", "n", f="A9*2")}</row><row r="4">{c("A4", "note")}</row>'
    styles = f'<styleSheet {S}><fonts><font/><font><b/></font></fonts><cellXfs><xf fontId="0" numFmtId="0"/><xf fontId="1" numFmtId="0"/></cellXfs></styleSheet>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {S}><sheets><sheet name="Prices" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {S}><sheetData>{rows}</sheetData></worksheet>")
        z.writestr("xl/styles.xml", styles)


@pytest.fixture()
def folder(tmp_path):
    base = tmp_path / "files"
    (base / "it").mkdir(parents=True)
    write_docx(base / "it/devices.docx")
    write_xlsx(base / "it/prices.xlsx")
    (base / "it/notes.txt").write_text("x")
    (base / "it/empty.pdf").write_text("")
    rows = [dict(source_path=f"KB/it/{n}", title=n, file_type=n.split(".")[1], department="it", document_type=f"kind of {n}", version="1", effective_from="2024-01-01", effective_to=None, is_current=True, allowed_groups=["staff"]) for n in ("devices.docx", "Prices.xlsx", "gone.docx")]
    (tmp_path / "manifest.json").write_text(json.dumps({"schema_version": 1, "documents": rows}))
    return tmp_path


def test_listing_rules(spark):
    rows = [("a/x.pdf", 1), ("a/x.PDF", 1), ("/a.pdf", 1), ("a/../b.pdf", 1), ("a\\b.pdf", 1), ("con/a.pdf", 1), ("a. /b.pdf", 1), ("a/b.txt", 1), ("a/z.docx", 0), ("", 1)]
    got = listing.classify(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "k int, name string, size long"), "KB", "k").orderBy("k").collect()
    assert [r.code for r in got] == [None, "unsafe_path", "unsafe_path", "unsafe_path", "unsafe_path", "unsafe_path", "unsafe_path", "unsupported", "empty", "unsafe_path"]
    assert got[0].logical_path == "KB/a/x.pdf"


def test_files_to_corpus(spark, folder):
    manifest = ingest.load_manifest(spark, str(folder / "manifest.json"))
    chunks, problems = ingest.prepare(spark, f"file:{folder}/files", "KB", manifest)
    rows = {r.content: r for r in chunks.collect()}
    assert rows["Item: Laptop | Column 2: yes"].section == "Devices" and rows["All staff."].file_type == "docx"
    data = next(r for t, r in rows.items() if "Kind: data" in t and "\n\n" not in t)
    assert "plan=basic; price=30 [formula: =A9*2]" in data.content and data.source_path == "KB/it/Prices.xlsx"
    assert sum("Kind: header" in t and "\n\n" in t for t in rows) == 1
    assert {(r.logical_path, r.problem) for r in problems.collect()} == {("KB/it/notes.txt", "unsupported"), ("KB/it/empty.pdf", "empty"), ("KB/it/gone.docx", "declared source is missing")}
    store = f"file:{folder}/store"
    embedder = plugins.HashEmbedder(8)
    first = ingest.upsert(spark, chunks, store, embedder).first()
    again = ingest.upsert(spark, chunks, store, embedder).first()
    assert first.uploaded == len(rows) and (again.uploaded, again.unchanged, again.deleted) == (0, len(rows), 0)
    less = ingest.upsert(spark, chunks.filter("file_type = 'docx'"), store, embedder).first()
    assert less.deleted == sum(r.file_type == "xlsx" for r in rows.values())
    now = ingest.current(spark, store)
    assert plugins.vector_problems(now, 8).count() == 0 and now.count() == less.desired


def test_only_changed_buckets_are_written(spark, folder):
    manifest = ingest.load_manifest(spark, str(folder / "manifest.json"))
    chunks = ingest.prepare(spark, f"file:{folder}/files", "KB", manifest)[0].cache()
    store, embedder = f"file:{folder}/store4", plugins.HashEmbedder(8)
    ingest.upsert(spark, chunks, store, embedder)
    held = lambda: versions.folders(spark, store, versions.version(spark, store))
    before = held()
    assert len(before) == 2
    docx = chunks.filter("file_type = 'docx'")
    report = ingest.replace_documents(spark, docx.filter("content <> 'All staff.'"), store, embedder).first()
    after = held()
    assert report.deleted == 1 and report.uploaded == 0 and len(set(before.items()) & set(after.items())) == 1
    assert ingest.current(spark, store).count() == chunks.count() - 1
    ingest.upsert(spark, chunks.filter("file_type = 'xlsx'"), store, embedder)
    assert {r.file_type for r in ingest.current(spark, store).collect()} == {"xlsx"} and len(held()) == 1
    known = versions.numbers(spark, store)
    assert ingest.upsert(spark, chunks.filter("file_type = 'xlsx'"), store, embedder).first().uploaded == 0 and versions.numbers(spark, store) == known == [1, 2, 3]


def test_failed_write_changes_nothing(spark, folder):
    manifest = ingest.load_manifest(spark, str(folder / "manifest.json"))
    chunks, _ = ingest.prepare(spark, f"file:{folder}/files", "KB", manifest)
    store = f"file:{folder}/store2"
    ingest.upsert(spark, chunks.filter("file_type = 'docx'"), store, plugins.HashEmbedder(8))

    class Broken:
        dimension = 8

        def __call__(self, texts):
            return [[0.0] * 7 for _ in texts]

    before = ingest.current(spark, store).count()
    with pytest.raises(PySparkException):
        ingest.upsert(spark, chunks, store, Broken())
    assert ingest.current(spark, store).count() == before


def test_retries():
    calls, counted = [], []

    class Status(Exception):
        def __init__(self, code):
            self.status_code = code

    def fails(times, error):
        def call():
            calls.append(1)
            if len(calls) <= times:
                raise error
            return "done"

        calls.clear()
        counted.clear()
        return plugins.with_retries(call, pause=0, retried=lambda: counted.append(1))

    for error in (plugins.Transient(), Status(408), Status(409), Status(429), Status(503), TimeoutError()):
        assert fails(2, error) == "done" and len(counted) == 2
        with pytest.raises(type(error)):
            fails(3, error)
    for error in (RuntimeError(), Status(400), Status(404)):
        with pytest.raises(type(error)):
            fails(1, error)
        assert len(calls) == 1 and not counted
    with pytest.raises(ValueError):
        plugins.with_retries(lambda: 1, attempts=0)


def test_rerank_falls_back(spark):
    hits = spark.createDataFrame([(1, 0.5)], "id int, score double")

    def away(_):
        raise plugins.Unavailable

    def late(error):
        def run(batches):
            raise error
            yield from batches

        return lambda h: h.mapInArrow(run, h.schema)

    assert plugins.rerank(hits, None) is hits and plugins.rerank(hits, away) is hits
    assert plugins.rerank(hits, late(plugins.Unavailable("404"))).collect() == hits.collect()
    with pytest.raises(PySparkException):
        plugins.rerank(hits, late(RuntimeError("500")))
    assert plugins.rerank(hits, lambda h: h.selectExpr("id", "score * 2 as score")).first().score == 1.0


def test_pdf_needs_a_reader(spark):
    files = spark.createDataFrame([("KB/a.pdf", bytearray(b"one\x0ctwo"))], "logical_path string, content binary")
    with pytest.raises(ValueError):
        parsers.read_pdf(files, None)
    pages = parsers.read_pdf(files, lambda b: b.decode().split("\x0c")).collect()
    assert [(p.page_number, p.text) for p in pages] == [(1, "one"), (2, "two")]


def test_stream(spark, folder):
    manifest = ingest.load_manifest(spark, str(folder / "manifest.json"))
    chunks, _ = ingest.prepare(spark, f"file:{folder}/files", "KB", manifest)
    stream.events(chunks, 1).coalesce(1).write.parquet(f"{folder}/inbox")
    store, embedder = f"file:{folder}/store3", plugins.HashEmbedder(8)
    for _ in range(2):
        changes = spark.readStream.schema(stream.EVENT).parquet(f"{folder}/inbox")
        stream.run(changes, store, embedder, f"{folder}/marks").awaitTermination(120)
    assert ingest.current(spark, store).count() == chunks.count() and versions.numbers(spark, store) == [1]


ENTRY = dict(source_path="KB/it/a.pdf", title="A", file_type="pdf", department="it", document_type="policy", version="1", effective_from="2024-01-01", effective_to=None, is_current=True, allowed_groups=["staff"])


@pytest.mark.parametrize(
    ("change", "said"),
    [
        ({"more": 1}, "missing or unknown"), ({"title": None}, "wrong type of title"), ({"version": 1}, "wrong type of version"), ({"is_current": "yes"}, "wrong type of is_current"), ({"title": " "}, "title is empty"),
        ({"effective_from": "May"}, "no ISO date in effective_from"), ({"effective_to": "2023-01-01"}, "out of order"), ({"allowed_groups": []}, "groups"), ({"allowed_groups": ["a", "A "]}, "groups repeat"), ({"allowed_groups": "a"}, "list of texts"),
        ({"file_type": "docx"}, "suffix differs"), ({"source_path": "KB/it/a.txt", "file_type": "txt"}, "no reader"), ({"source_path": "KB/../a.pdf"}, "unsafe path"), ({"department": ""}, "department is empty"),
    ],
)
def test_manifest_entries_are_checked(spark, tmp_path, change, said):
    (tmp_path / "m.json").write_text(json.dumps({"schema_version": 1, "documents": [ENTRY | change]}))
    with pytest.raises(ValueError, match=said):
        ingest.load_manifest(spark, str(tmp_path / "m.json"))


def test_manifest_as_a_whole_is_checked(spark, tmp_path):
    def load(whole):
        (tmp_path / "m.json").write_text(whole if isinstance(whole, str) else json.dumps(whole))
        return ingest.load_manifest(spark, str(tmp_path / "m.json")).collect()

    second = ENTRY | {"source_path": "KB/it/b.pdf", "version": "2"}
    for whole, said in (
        ("[]", "JSON object"), ("{", "JSON object"), ({"schema_version": 2, "documents": []}, "another manifest version"), ({"schema_version": "1", "documents": []}, "another manifest version"), ({"schema_version": 1}, "schema_version and documents"),
        ({"schema_version": 1, "documents": [ENTRY], "x": 1}, "schema_version and documents"), ({"schema_version": 1, "documents": [ENTRY, ENTRY | {"source_path": "kb/IT/a.pdf"}]}, "twice"), ({"schema_version": 1, "documents": [ENTRY, second]}, "one current document"),
    ):
        with pytest.raises(ValueError, match=said):
            load(whole)
    rows = load({"schema_version": 1, "documents": [ENTRY, second | {"is_current": False}]})
    assert {(r.source_path, r.version, r.is_current, str(r.effective_from)) for r in rows} == {("KB/it/a.pdf", "1", True, "2024-01-01"), ("KB/it/b.pdf", "2", False, "2024-01-01")}


PRICES = {"schema_version": 1, "pricing_id": "p", "currency": "USD", "source_note": "n", "effective_date": "2026-08-21", "token_estimation": {"method_id": ingest.TOKEN_METHOD, "description": "d"}, "models": {"m": {"input_usd_per_million_tokens": "0.02", "output_usd_per_million_tokens": 1.6}}}


def test_prices_are_exact_and_checked(spark, tmp_path):
    def load(whole):
        (tmp_path / "p.json").write_text(json.dumps(whole))
        return ingest.load_prices(spark, str(tmp_path / "p.json")).collect()

    r = load(PRICES)[0]
    assert (str(r.input_usd_per_million_tokens), str(r.output_usd_per_million_tokens), str(r.effective_date)) == ("0.020000000", "1.600000000", "2026-08-21")
    for change, said in (({"schema_version": 2}, "version"), ({"effective_date": "soon"}, "ISO date"), ({"currency": " "}, "currency"), ({"models": {}}, "non-empty"), ({"models": {"m": {"input_usd_per_million_tokens": "-1", "output_usd_per_million_tokens": "1"}}}, "no price"), ({"token_estimation": {"method_id": "x", "description": "d"}}, "method")):
        with pytest.raises(ValueError, match=said):
            load(PRICES | change)


def test_frozen_cases(spark, tmp_path):
    data = json.dumps({"frozen": True, "cases": [{"id": "C-1", "question": "q1"}, {"id": "C-2", "question": "q2"}]}).encode()
    (tmp_path / "c.json").write_bytes(data)
    digest = hashlib.sha256(data).hexdigest()
    assert [r.question for r in ingest.load_frozen(spark, str(tmp_path / "c.json"), digest, ["C-1", "C-2"]).collect()] == ["q1", "q2"]
    for h, ids in (("0" * 64, None), (digest, ["C-2", "C-1"]), (digest, ["C-1"])):
        with pytest.raises(ValueError):
            ingest.load_frozen(spark, str(tmp_path / "c.json"), h, ids)


def test_every_file_ends_as_chunks_or_as_a_problem(spark, folder):
    base = folder / "files/it"
    (base / "broken.docx").write_bytes(b"no zip")
    (base / "guide.pdf").write_bytes(b"%PDF")
    (base / "blank.pdf").write_bytes(b"%PDF")
    with zipfile.ZipFile(base / "void.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body/></w:document>")
    names = ["broken.docx", "guide.pdf", "blank.pdf", "void.docx", "devices.docx"]
    rows = [ENTRY | {"source_path": f"KB/it/{n}", "file_type": n.split(".")[1], "document_type": n} for n in names]
    (folder / "m3.json").write_text(json.dumps({"schema_version": 1, "documents": rows}))
    manifest = ingest.load_manifest(spark, str(folder / "m3.json"))
    chunks, problems = ingest.prepare(spark, f"file:{folder}/files", "KB", manifest)
    told = {r.logical_path.removeprefix("KB/it/"): r.problem for r in problems.collect()}
    assert told["broken.docx"].startswith("unreadable: BadZipFile") and told["guide.pdf"] == told["blank.pdf"] == "unreadable: no reader for PDF files" and told["void.docx"] == "no searchable chunks" and told["prices.xlsx"] == "metadata is missing"
    assert {r.source_path for r in chunks.collect()} == {"KB/it/devices.docx"}

    def reader(content):
        return ["", "page two"]

    chunks, problems = ingest.prepare(spark, f"file:{folder}/files", "KB", manifest, reader)
    assert {(r.source_path, r.page_number) for r in chunks.filter("file_type = 'pdf'").collect()} == {("KB/it/guide.pdf", 2), ("KB/it/blank.pdf", 2)}
    assert "guide.pdf" not in {r.logical_path.removeprefix("KB/it/") for r in problems.collect()}


def test_baseline_flattens_files(spark, folder):
    files = listing.scan(spark, f"file:{folder}/files", "KB").filter("code is null").select("logical_path", "content")
    flat = {r.source_path: r.text for r in ingest.flatten(files).collect()}
    assert flat == {"KB/it/devices.docx": "Devices All staff. Item Laptop yes", "KB/it/prices.xlsx": "plan price basic 30 note"}
    made = ingest.baseline_chunks(ingest.flatten(files), 4, 1).collect()
    assert {r.content for r in made} == {"Devices All staff. Item", "Item Laptop yes", "plan price basic 30", "30 note"} and all(r.id.startswith("baseline-") for r in made)


def test_dates_and_times_of_cells():
    assert [parsers._moment(*x) for x in ((45000.0, 14, ""), (45000.5, 14, ""), (0.5, 20, ""), (45000.5, 22, ""), (45000.0, 200, "yyyy-mm-dd"), (0.25, 200, "hh:mm"), (45000.25, 200, "yyyy hh"))] == ["2023-03-15", "2023-03-15T12:00:00", "12:00:00", "2023-03-15T12:00:00", "2023-03-15", "06:00:00", "2023-03-15T06:00:00"]


def test_extractive_answers(spark):
    context = spark.createDataFrame([(1, 1, "c1", "Some [x] text")], "qid int, position int, id string, content string")
    gate = spark.createDataFrame([(1, True), (2, False)], "qid int, sufficient boolean")
    got = {r.qid: r.answer for r in plugins.extractive_answers(context, gate, "no").collect()}
    assert got == {1: "Some x text [c1]", 2: "no"}
