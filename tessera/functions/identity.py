"""Content-derived identifiers and path keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import YEAR, fold


def short_hash(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 24)


def document_id(path: Column) -> Column:
    return short_hash(fold(path))


def chunk_id(document: Column, locator: Column, content_hash: Column) -> Column:
    return short_hash(F.concat_ws("|", document, locator, content_hash))


def source_key(path: Column) -> Column:
    """Paths are compared without case, with forward slashes."""
    return fold(F.replace(path, F.lit("\\"), F.lit("/")))


def stem_of(path: Column) -> Column:
    """The file name without its last suffix."""
    name = F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def parent_of(path: Column) -> Column:
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    return F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise("")


def selection_family(department: Column, document_type: Column, path: Column) -> Column:
    """Versions of a document share this key."""
    name = fold(stem_of(path))
    bare = F.regexp_replace(name, YEAR, "")
    plain = F.regexp_replace(F.when(bare == "", name).otherwise(bare), "[^a-z0-9]+", "")
    return F.when(F.coalesce(document_type, F.lit("")) != "", F.concat_ws("|", fold(F.coalesce(department, F.lit(""))), fold(document_type))).otherwise(plain)


def fusion_family(department: Column, document_type: Column, version: Column, path: Column) -> Column:
    """Each version of a document has its own key."""
    year = F.nullif(F.regexp_extract(path, r"(?:19|20)\d{2}", 0), F.lit(""))
    named = F.concat_ws("|", fold(F.coalesce(department, F.lit(""))), fold(document_type), fold(F.coalesce(F.nullif(version, F.lit("")), year, F.lit("unspecified"))))
    return F.when(F.coalesce(document_type, F.lit("")) != "", named).otherwise(F.regexp_replace(fold(stem_of(path)), "[^a-z0-9]+", ""))
