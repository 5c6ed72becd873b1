"""What a caller may plug in: embedder, generator, analyzer, re-ranker; with deterministic local forms."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.accumulators import Accumulator
from pyspark.errors import PythonException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import analysis, evidence
from tessera.plans import store


class Embedder(Protocol):
    dimension: int

    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class Analyzer(Protocol):
    """A model that analyses questions: for each (question, conversation) one JSON text, see ``analyse_with``."""

    def __call__(self, questions: list[str], conversations: list[str]) -> list[str]: ...


class Generator(Protocol):
    """A model that answers from evidence: for each (question, evidence blocks) one text that cites chunk ids in brackets."""

    def __call__(self, questions: list[str], prompts: list[str]) -> list[str]: ...


class Unavailable(Exception):
    """A re-ranker that can't serve this request: plain order is used."""


class Transient(Exception):
    """A failure worth another attempt."""


def is_transient(error: BaseException) -> bool:
    """Whether another attempt may help: lost connections, time-outs, and answers 408, 409, 429 and 5xx of a service."""
    if isinstance(error, (Transient, TimeoutError, ConnectionError)):
        return True
    code = getattr(error, "status_code", None)
    if code is None:
        code = getattr(getattr(error, "response", None), "status_code", None)
    return isinstance(code, int) and (code in (408, 409, 429) or 500 <= code < 600)


class HashEmbedder:
    """Signed hashed word counts, normed: needs no model."""

    def __init__(self, dimension: int = 64) -> None:
        self.dimension = dimension

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimension))
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                h = xxhash.xxh3_64_intdigest(word.encode())
                row[h % self.dimension] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm == 0, 1, norm)).tolist()


def with_retries(call: Callable, attempts: int = 3, pause: float = 0.25, retried: Callable[[], None] = lambda: None):
    """Calls again after a transient failure, waiting twice as long each time; retried is called before each further attempt. Other errors pass at once."""
    if attempts < 1:
        raise ValueError("at least one attempt is needed")
    for attempt in range(attempts):
        try:
            return call()
        except Exception as e:
            if attempt + 1 == attempts or not is_transient(e):
                raise
            retried()
            time.sleep(pause * 2**attempt)


def embed(df: DataFrame, text: str, embedder: Embedder, batch: int = 64, retries: Accumulator | None = None) -> DataFrame:
    """Adds content_vector; the vector stays in its row, so nothing is matched by position across rows. Wrong counts or dimensions fail. retries counts further attempts."""
    names = df.columns
    count = (lambda: retries.add(1)) if retries is not None else (lambda: None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                texts = [x or "" for x in part.column(names.index(text)).to_pylist()]
                vectors = with_retries(lambda: embedder(texts), retried=count)  # noqa: B023
                if len(vectors) != len(texts) or any(len(v) != embedder.dimension for v in vectors):
                    raise ValueError("the embedder gave other vectors than asked for")
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(vectors, pa.list_(pa.float32()))], [*names, "content_vector"])

    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    return df.mapInArrow(run, f"{schema}, content_vector array<float>")


def vector_problems(df: DataFrame, dimension: int) -> DataFrame:
    """Rows without a vector of this dimension."""
    return df.filter(F.col("content_vector").isNull() | (F.size("content_vector") != dimension))


def rerank(hits: DataFrame, reranker: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """The re-ranker's hits, or the plain ones if there is none or it is unavailable, be it when it is called or when its rows are made; other errors pass."""
    if reranker is None:
        return hits
    try:
        return store.materialise(reranker(hits), "reranked")
    except Unavailable:
        return hits
    except PythonException as e:
        if f"{Unavailable.__name__}" in str(e).strip().rsplit("\n", 1)[-1] or f"plugins.{Unavailable.__name__}" in str(e):
            return hits
        raise


ANALYSIS = "standalone_query string, ambiguous boolean, clarification string, temporal_intent string, subqueries array<string>, resolved_from_context boolean"
INTENTS = ["current", "historical", "comparison", "unspecified"]


def analyse_with(model: Analyzer, questions: DataFrame, conversation: str | None = None) -> DataFrame:
    """``analysis.analyze`` by a model: (qid, question, prior, ...) with its columns.

    The model's JSON counts only if it has exactly the known fields, of their types, a known intent, a query that is not blank and at most three sub-queries, none blank; any
    other text and any error of the model gives that question the analysis without a model.
    """
    plain = analysis.analyze(questions)
    told = questions.select("qid", "question", (F.col(conversation) if conversation else F.col("prior")).alias("said"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked, said = ([x or "" for x in batch.column(i).to_pylist()] for i in (1, 2))
            try:
                made = list(model(asked, said))
                if len(made) != len(asked):
                    made = [None] * len(asked)
            except Exception:  # noqa: BLE001 - whatever the model's failure is, the questions are analysed without it
                made = [None] * len(asked)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x if isinstance(x, str) else None for x in made], pa.string())], ["qid", "raw"])

    raw = told.mapInArrow(run, f"qid {questions.schema['qid'].dataType.simpleString()}, raw string")
    v, names = F.try_parse_json("raw"), [x.split()[0] for x in ANALYSIS.split(", ")]
    kind = lambda n: F.schema_of_variant(F.try_variant_get(v, f"$.{n}", "variant"))
    m = F.from_json("raw", ANALYSIS)
    ok = (F.array_sort(F.json_object_keys("raw")) == F.array_sort(F.array(*map(F.lit, names)))) & (kind("standalone_query") == "STRING") & (kind("ambiguous") == "BOOLEAN") & (kind("resolved_from_context") == "BOOLEAN")
    ok = ok & kind("clarification").isin("STRING", "VOID") & (kind("subqueries") == "ARRAY<STRING>") & m["temporal_intent"].isin(*INTENTS) & (F.btrim(m["standalone_query"]) != "") & F.size(m["subqueries"]).between(1, analysis.MAX_SUBQUERIES)
    ok = ok & ~F.exists(m["subqueries"], lambda q: F.btrim(q) == "") & (~m["ambiguous"] | m["clarification"].isNotNull())
    good = raw.filter(F.coalesce(ok, F.lit(False))).select(F.col("qid").alias("_qid"), m.alias("_m"))
    met = plain.join(good, F.col("qid") == F.col("_qid"), "left")
    return met.withColumns({n: F.when(F.col("_m").isNotNull(), F.col(f"_m.{n}")).otherwise(F.col(n)) for n in names}).drop("_qid", "_m")


def generate_with(model: Generator, questions: DataFrame, context: DataFrame, batch: int = 16) -> DataFrame:
    """(qid, answer) by a model for the questions that have evidence; failing calls are tried again, then fail the job."""
    asked = questions.join(evidence.prompt(context), "qid").select("qid", "question", "prompt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                said = with_retries(lambda: model(part.column(1).to_pylist(), part.column(2).to_pylist()))  # noqa: B023
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(said, pa.string())], ["qid", "answer"])

    return asked.mapInArrow(run, f"qid {questions.schema['qid'].dataType.simpleString()}, answer string")


def first_words(questions: DataFrame, context: DataFrame) -> DataFrame:
    """A generator without a model: the first chunk's opening words with its mark."""
    return context.filter("position = 1").select("qid", F.concat(F.substring(F.regexp_replace("content", r"[\[\]]", ""), 1, 120), F.lit(" ["), F.col("id"), F.lit("]")).alias("answer"))


def extractive_answers(context: DataFrame, gate: DataFrame, refusal: str) -> DataFrame:
    """(qid, answer): the first chunk's opening words with its mark, or the refusal where the gate is shut."""
    first = context.filter("position = 1").select("qid", F.concat(F.substring(F.regexp_replace("content", r"[\[\]]", ""), 1, 120), F.lit(" ["), F.col("id"), F.lit("]")).alias("said"))
    joined = gate.select("qid", "sufficient").join(first, "qid", "left")
    return joined.select("qid", F.when(F.col("sufficient") & F.col("said").isNotNull(), F.col("said")).otherwise(refusal).alias("answer"))
