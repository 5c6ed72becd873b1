"""Text columns: folding, tokens, stems, white space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words of ranking and of the evidence gate, and the words that mean approval or history.
RANK_STOP = ["a", "an", "and", "are", "at", "be", "does", "for", "how", "in", "is", "it", "of", "on", "or", "the", "to", "what", "when", "which", "who", "with"]
GATE_STOP = ["a", "an", "and", "are", "at", "be", "can", "does", "for", "from", "how", "in", "is", "it", "of", "on", "or", "the", "this", "to", "what", "when", "which", "who", "with", "would", "should", "tell", "me", "please"]
APPROVAL = ["approve", "approves", "approved", "approver", "approvers", "approval", "approvals", "authorize", "authorizes", "authorized", "authorization"]
HISTORICAL = ["compare", "compared", "difference", "historical", "history", "old", "older", "previous", "prior", "versus", "vs"]
PRICE = ["cost", "costs", "price", "prices", "pricing", "rate", "rates"]
NUMERIC = ["length", "limit", "maximum", "minimum", "threshold"]
YEAR = r"\b(?:19|20)\d{2}\b"
CURRENCY = r"(?i)(?:[$€£]\s?\d|\b(?:usd|eur|gbp)\b)"


# What case folding writes otherwise than lower case does, as far as it touches Latin letters.
FOLDED = {
    "\u00df": "ss", "\u1e9e": "ss", "\u0149": "\u02bcn", "\u01f0": "j\u030c", "\u1e96": "h\u0331", "\u1e97": "t\u0308", "\u1e98": "w\u030a", "\u1e99": "y\u030a", "\u1e9a": "a\u02be",
    "\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl", "\ufb05": "st", "\ufb06": "st",
}


def fold(c: Column) -> Column:
    """Case folding for search: lower case; sharp and long s, ligatures and letters with fixed marks as what they stand for.

    Most texts need little: those in ASCII only lower case, those without rare letters one replacement more.
    """
    sharp = F.replace(c, F.lit("\u00df"), F.lit("ss"))
    out = F.translate(sharp, "\u017f", "s")
    for letter, by in FOLDED.items():
        out = F.replace(out, F.lit(letter), F.lit(by))
    rare = "[\u017f" + "".join(x for x in FOLDED if x != "\u00df") + "]"
    return F.lower(F.when(F.octet_length(c) == F.length(c), c).when(~c.rlike(rare), sharp).otherwise(out))


def squeeze(c: Column) -> Column:
    """Each run of white space becomes one blank; none at the ends."""
    return F.btrim(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " "))


def words(c: Column) -> Column:
    return F.filter(F.split(squeeze(c), " "), lambda w: w != "")


def raw_tokens(c: Column) -> Column:
    return F.regexp_extract_all(fold(c), F.lit("[a-z0-9]+"), F.lit(0))


def rank_tokens(c: Column) -> Column:
    """Distinct tokens for ranking: all words of approval are one."""
    return F.array_distinct(F.transform(raw_tokens(c), lambda t: F.when(t.isin(*APPROVAL), "approval").otherwise(t)))


def stem(t: Column) -> Column:
    """Takes off the first of ies, ing, ed, es, s that leaves more than three letters; ies leaves a y."""
    out = t
    for suffix in reversed(("ies", "ing", "ed", "es", "s")):
        cut = F.substring(t, F.lit(1), F.length(t) - len(suffix))
        out = F.when((F.length(t) > len(suffix) + 3) & t.endswith(suffix), F.concat(cut, F.lit("y")) if suffix == "ies" else cut).otherwise(out)
    return out


def stems(c: Column) -> Column:
    return F.transform(raw_tokens(c), stem)


def join_present(*cols: Column) -> Column:
    """Texts that are neither null nor empty, with blanks between."""
    return F.concat_ws(" ", *(F.when(c != "", c) for c in cols))


def literals(values: list[str]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def has_any(tokens: Column, values: list[str]) -> Column:
    return F.arrays_overlap(tokens, literals(values))


def year_matches(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(YEAR), F.lit(0))


def historical_intent(question: Column) -> Column:
    return has_any(rank_tokens(question), HISTORICAL) | question.rlike(YEAR)


def page_text(c: Column) -> Column:
    """Normal form of extracted pages: unified line ends, DEL as a broken hyphen, no controls, lines trimmed and none empty."""
    unified = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "\r\n?", "\n"), "\x7f", "- "), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x80-\x9F]", "")
    lines = F.transform(F.split(unified, "[\\n\\u2028\\u2029]"), lambda x: F.btrim(F.regexp_replace(x, "[ \t]+", " "), F.lit(" \t")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def block_text(c: Column) -> Column:
    """Normal form of paragraphs: no controls, white space squeezed."""
    return squeeze(F.regexp_replace(F.regexp_replace(c, "\x7f", "- "), r"[\x00-\x08\x0E-\x1F\x80-\x9F]", ""))


def token_estimate(c: Column) -> Column:
    """A token for each four UTF-8 bytes, rounded up."""
    return F.floor((F.octet_length(c) + 3) / 4).cast("long")
