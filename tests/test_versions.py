"""The corpus as versions: writers at one time, crashes, snapshots, growing buckets, and streams of document versions."""

import random
import threading

import pytest

from tessera.plans import ingest, plugins, versions
from tessera.streaming import ingest as stream

EMBEDDER = plugins.HashEmbedder(4)


def chunk(document, content):
    return {"id": f"{document}-{content}", "content": content, "title": "t", "source_path": f"KB/{document}", "document_id": document, "content_hash": content, "allowed_groups": ["staff"]}


def rows(spark, *pairs):
    return spark.createDataFrame([chunk(*p) for p in pairs], ingest.CHUNK)


def held(spark, store, number=None):
    return sorted((r.document_id, r.content) for r in ingest.current(spark, store, number).collect())


@pytest.fixture
def store(tmp_path):
    return f"file:{tmp_path}/store"


@pytest.fixture
def between(monkeypatch):
    """Runs something once, just before the next commit."""

    def arrange(what):
        real = versions.commit

        def commit(*a, **k):
            monkeypatch.setattr(versions, "commit", real)
            what()
            return real(*a, **k)

        monkeypatch.setattr(versions, "commit", commit)

    return arrange


def test_only_one_of_a_name(spark, tmp_path):
    for rename in (False, True):
        path = f"file:{tmp_path}/log-{rename}"
        assert versions.put_if_absent(spark, path, "first", rename) and not versions.put_if_absent(spark, path, "second", rename)
        assert (tmp_path / f"log-{rename}").read_text() == "first"
    assert len(list(tmp_path.glob(".draft*"))) == 0


@pytest.mark.parametrize("buckets", [1, 64])
def test_a_writer_inside_another(spark, store, between, monkeypatch, buckets):
    """Both changes stay, in one bucket (the outer one starts again) and in several (it is merged)."""
    monkeypatch.setattr(versions, "BUCKETS", buckets)
    ingest.upsert(spark, rows(spark, ("d0", "base")), store, EMBEDDER)
    between(lambda: ingest.replace_documents(spark, rows(spark, ("d2", "second")), store, EMBEDDER))
    report = ingest.replace_documents(spark, rows(spark, ("d1", "first"), ("d0", "newer")), store, EMBEDDER).first()
    assert held(spark, store) == [("d0", "newer"), ("d1", "first"), ("d2", "second")]
    assert report.uploaded == 2 and report.deleted == 1 and versions.numbers(spark, store) == [1, 2, 3]


def test_the_first_writers(spark, store, between):
    between(lambda: ingest.upsert(spark, rows(spark, ("d2", "second")), store, EMBEDDER))
    ingest.replace_documents(spark, rows(spark, ("d1", "first")), store, EMBEDDER)
    assert held(spark, store) == [("d1", "first"), ("d2", "second")]


def test_upsert_sees_what_came_between(spark, store, between):
    ingest.upsert(spark, rows(spark, ("d0", "base")), store, EMBEDDER)
    between(lambda: ingest.replace_documents(spark, rows(spark, ("d2", "second")), store, EMBEDDER))
    report = ingest.upsert(spark, rows(spark, ("d0", "base"), ("d1", "x")), store, EMBEDDER).first()
    assert held(spark, store) == [("d0", "base"), ("d1", "x")] and report.deleted == 1


def test_a_bucket_emptied_between_is_a_conflict(spark, store, between, monkeypatch):
    monkeypatch.setattr(versions, "BUCKETS", 1)
    ingest.upsert(spark, rows(spark, ("d0", "base")), store, EMBEDDER)
    between(lambda: ingest.replace_documents(spark, rows(spark), store, EMBEDDER, rows(spark, ("d0", "")).select("document_id")))
    ingest.replace_documents(spark, rows(spark, ("d1", "first")), store, EMBEDDER)
    assert held(spark, store) == [("d1", "first")]


def test_without_end_it_is_an_error(spark, store, monkeypatch):
    monkeypatch.setattr(ingest, "ATTEMPTS", 2)

    def never(*a, **k):
        raise versions.Conflict("busy")

    monkeypatch.setattr(versions, "commit", never)
    with pytest.raises(versions.Conflict):
        ingest.upsert(spark, rows(spark, ("d0", "base")), store, EMBEDDER)


def test_threads(spark, store):
    ingest.upsert(spark, rows(spark, ("d0", "base")), store, EMBEDDER)
    failed = []

    def work(n):
        try:
            for k in range(2):
                ingest.replace_documents(spark, rows(spark, (f"d{n}", f"v{k}")), store, EMBEDDER)
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=work, args=(n,)) for n in range(1, 4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(240)
    assert not failed and held(spark, store) == [("d0", "base"), ("d1", "v1"), ("d2", "v1"), ("d3", "v1")]
    assert versions.numbers(spark, store) == list(range(1, 8))


def test_a_crash_before_the_log_changes_nothing(spark, store, monkeypatch):
    ingest.upsert(spark, rows(spark, ("d0", "base")), store, EMBEDDER)
    old = ingest.current(spark, store)
    with monkeypatch.context() as m:
        m.setattr(versions, "put_if_absent", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            ingest.replace_documents(spark, rows(spark, ("d0", "new")), store, EMBEDDER)
    assert held(spark, store) == [("d0", "base")] and versions.clean(spark, store) == []
    assert len(versions.clean(spark, store, grace=-60)) == 2  # rows and buckets that no version names
    ingest.replace_documents(spark, rows(spark, ("d0", "new"), ("d1", "x")), store, EMBEDDER)
    assert held(spark, store, 1) == [("d0", "base")] == sorted((r.document_id, r.content) for r in old.collect())
    assert held(spark, store) == [("d0", "new"), ("d1", "x")]
    versions.clean(spark, store, keep=2, grace=-60)
    assert held(spark, store, 1) == [("d0", "base")]
    gone = versions.clean(spark, store, keep=1, grace=-60)
    assert gone and versions.numbers(spark, store) == [2] and held(spark, store) == [("d0", "new"), ("d1", "x")] and held(spark, store, 1) == []


def test_buckets_grow(spark, store, monkeypatch):
    monkeypatch.setattr(versions, "BUCKETS", 1)
    monkeypatch.setattr(versions, "BUCKET_ROWS", 3)
    wanted = []
    for n in range(8):
        part = [(f"d{n}", f"c{k}") for k in range(2)]
        wanted += part
        ingest.replace_documents(spark, rows(spark, *part), store, EMBEDDER)
        assert held(spark, store) == wanted
    now = versions.version(spark, store)
    assert now.buckets == 16 and now.rows == 16 == sum(n for _, n, _ in versions.folders(spark, store, now).values())
    ingest.upsert(spark, rows(spark, *wanted, *((f"e{n}", "c") for n in range(60))), store, EMBEDDER)
    assert versions.version(spark, store).buckets == 64 and len(held(spark, store)) == 76


def test_vectors_follow_their_content(spark, store):
    """Moved, renamed and re-described chunks keep their vectors; only new contents are embedded."""
    calls = spark.sparkContext.accumulator(0)

    class Counting(plugins.HashEmbedder):
        def __call__(self, texts):
            calls.add(len(texts))
            return super().__call__(texts)

    embedder = Counting(4)
    ingest.upsert(spark, rows(spark, ("d0", "one two"), ("d1", "three"), ("d2", "three")), store, embedder)
    assert calls.value == 3
    moved = [chunk("d9", "one two"), {**chunk("d1", "three"), "title": "new title"}, chunk("d2", "four")]
    ingest.upsert(spark, spark.createDataFrame(moved, ingest.CHUNK), store, embedder)
    assert calls.value == 4
    got = {r.document_id: [round(x, 5) for x in r.content_vector] for r in ingest.current(spark, store).collect()}
    assert got == {d: [round(x, 5) for x in plugins.HashEmbedder(4)([t])[0]] for d, t in (("d9", "one two"), ("d1", "three"), ("d2", "four"))}
    ingest.upsert(spark, spark.createDataFrame([{**r, "title": "x"} for r in moved], ingest.CHUNK), store, plugins.HashEmbedder(2))  # another length: all anew
    assert {len(r.content_vector) for r in ingest.current(spark, store).collect()} == {2}


@pytest.mark.parametrize("seed", [1])
def test_stream_of_versions(spark, store, tmp_path, seed):
    """Versions in one batch, out of order, twice and deleted: the newest stays."""
    draw = random.Random(seed)
    told, plan = {}, []
    for sequence in range(1, 25):
        document, gone = f"d{draw.randrange(5)}", draw.random() < 0.3
        pairs = [] if gone else [(document, f"s{sequence}-{k}") for k in range(draw.randrange(3))]
        plan.append((document, sequence, gone, pairs))
        told[document] = pairs
    late = plan + draw.sample(plan, 8)
    draw.shuffle(late)
    for at in range(0, len(late), 8):  # one file a batch
        made = [(d, s, gone, [tuple(chunk(*p).get(f) for f in ingest.CHUNK.fieldNames()) for p in pairs]) for d, s, gone, pairs in late[at : at + 8]]
        spark.createDataFrame([*made, (None, 99, False, []), ("d0", None, True, None)], stream.EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/inbox")
    read = lambda: spark.readStream.schema(stream.EVENT).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/inbox")
    stream.run(read(), store, EMBEDDER, f"{tmp_path}/marks").awaitTermination(240)
    wanted = sorted(p for pairs in told.values() for p in pairs)
    assert held(spark, store) == wanted
    known = versions.numbers(spark, store)
    stream.run(read(), store, EMBEDDER, f"{tmp_path}/marks").awaitTermination(240)
    assert versions.numbers(spark, store) == known
    # all events once more: older ones change nothing, equal ones neither
    spark.read.schema(stream.EVENT).parquet(f"{tmp_path}/inbox").coalesce(1).write.parquet(f"{tmp_path}/again")
    spark.read.parquet(f"{tmp_path}/again").coalesce(1).write.mode("append").parquet(f"{tmp_path}/inbox")
    stream.run(read(), store, EMBEDDER, f"{tmp_path}/marks").awaitTermination(240)
    assert held(spark, store) == wanted and versions.numbers(spark, store) == known


def test_events_of_chunks(spark, store, tmp_path):
    table = rows(spark, ("d0", "a"), ("d0", "b"), ("d1", "c"))
    stream.events(table, 5).write.parquet(f"{tmp_path}/inbox")
    stream.removals(table.filter("document_id = 'd1'").select("document_id"), 6).write.mode("append").parquet(f"{tmp_path}/inbox")
    stream.run(spark.readStream.schema(stream.EVENT).parquet(f"{tmp_path}/inbox"), store, EMBEDDER, f"{tmp_path}/marks").awaitTermination(120)
    assert held(spark, store) == [("d0", "a"), ("d0", "b")]
