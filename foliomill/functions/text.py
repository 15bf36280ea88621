"""Text functions shared by the operators, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.split and str.strip know it.
SPACE = r"(?U)[\s\x1c-\x1f]+"

# Fixed values.
NEGATIVE_TOKENS = ("not", "never", "no", "without", "decline", "decrease", "drop", "loss")
POSITIVE_TOKENS = ("increase", "growth", "up", "gain", "profit", "improve")
MULTI_DOC_CUES = ("compare", "vs", "versus", "difference between")
GRAPH_CUES = ("refer", "references", "cite", "what cites", "connected")
FOLLOW_UPS = ("what about", "how about", "and ", "it ", "that ")
CONTEXT = " Context from previous turn: "
QUERY_STOPWORDS = ("what", "which", "where", "when", "who", "why", "how", "this", "that", "these", "those")


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def tokens(text: Column) -> Column:
    """FN-1: runs of ASCII letters and digits of the lower-case text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def words(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(text, SPACE), lambda x: x != "")


def word_budget(text: Column) -> Column:
    """AGG-3: words of a section, one at least."""
    return F.greatest(F.lit(1), F.size(words(text)))


def overlap(query: Column, node: Column) -> Column:
    """FN-2: shared tokens over the query's tokens (both as sets)."""
    return F.size(F.array_intersect(query, node)) / F.greatest(F.lit(1), F.size(query))


def jaccard(a: Column, b: Column) -> Column:
    """Token-set Jaccard: 1 if both sets are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def cosine(a: Column, b: Column) -> Column:
    """FN-5: inner product of unit vectors; 0 for different lengths."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(a) == F.size(b), product).otherwise(0.0)


def entities(text: Column) -> Column:
    """FN-6: runs of capitalised words of three letters and more, and numbers; distinct. Words end as Unicode has it."""
    names = F.regexp_extract_all(text, F.lit(r"(?U)\b[A-Z][a-zA-Z]{2,}(?:\s+[A-Z][a-zA-Z]{2,})*\b"), F.lit(0))
    numbers = F.regexp_extract_all(text, F.lit(r"(?U)\b\d+(?:\.\d+)?\b"), F.lit(0))
    return F.array_union(names, numbers)


def cross_references(text: Column) -> Column:
    """FN-7: mentions of tables, sections, appendices and figures, white space collapsed; sorted distinct (DST-5)."""
    found = F.regexp_extract_all(text, F.lit(r"(?i)\b(?:table|section|appendix|figure)\s+[A-Z0-9][A-Za-z0-9.\-]*\b"), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.rtrim(F.regexp_replace(x, r"\s+", " "), F.lit(".")))))


def query_entities(query: Column) -> Column:
    """FN-8: references or capitalised runs of a query, without question words; sorted distinct. A final dot is dropped."""
    found = F.regexp_extract_all(query, F.lit(r"(?U)\b(?:(?:Table|Section)\s+[A-Za-z0-9.\-]+|[A-Z][a-zA-Z]{2,}(?:\s+[A-Z][a-zA-Z]{2,})*)"), F.lit(0))
    kept = F.filter(F.transform(found, lambda x: F.rtrim(x, F.lit("."))), lambda x: ~F.lower(x).isin(*QUERY_STOPWORDS))
    return F.array_sort(F.array_distinct(kept))


def _any(text: Column, cues: tuple[str, ...]) -> Column:
    test = F.lit(False)
    for cue in cues:
        test = test | F.contains(text, F.lit(cue))
    return test


def intent(query: Column) -> Column:
    """FN-9: multi_doc, graph or single_doc by substrings, in this order."""
    low = F.lower(query)
    return F.when(_any(low, MULTI_DOC_CUES), "multi_doc").when(_any(low, GRAPH_CUES), "graph").otherwise("single_doc")


def follows(query: Column) -> Column:
    """FN-10: whether a query begins like a follow-up."""
    low = F.lower(query)
    test = F.lit(False)
    for cue in FOLLOW_UPS:
        test = test | F.startswith(low, F.lit(cue))
    return test


def edge_types(query: Column) -> Column:
    """FLT-8: the types of edge a query asks to follow."""
    low = F.lower(query)
    of = lambda *names: F.array(*map(F.lit, names))
    return (
        F.when(_any(low, ("cite", "reference")), of("REFERENCES", "CROSS_DOC_REFERENCES"))
        .when(_any(low, ("compare", "similar")), of("CROSS_DOC_SIMILAR", "ELABORATES", "REFERENCES"))
        .otherwise(of("ELABORATES", "REFERENCES", "TEMPORALLY_FOLLOWS", "CONTRADICTS", "CROSS_DOC_SIMILAR"))
    )


def latest_year(text: Column) -> Column:
    """FN-29: the largest year 19xx or 20xx, or null."""
    return F.array_max(F.transform(F.regexp_extract_all(text, F.lit(r"\b(?:19|20)\d{2}\b"), F.lit(0)), lambda x: x.cast("int")))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def embedding(text: Column, dims: int = 32) -> Column:
    """FN-3: hashed bag of words: three bytes of each token's sha1 give a place, a sign and a size; unit length."""
    byte = lambda h, i: F.conv(F.substring(h, 2 * i + 1, 2), 16, 10).cast("int")
    parts = F.transform(
        F.transform(tokens(text), lambda t: F.sha1(t)),
        lambda h: F.struct((byte(h, 0) % dims).alias("at"), (F.when(byte(h, 1) % 2 == 0, 1.0).otherwise(-1.0) * (1 + byte(h, 2) / 255.0)).alias("v")),
    )
    raw = lambda p: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.aggregate(F.filter(p, lambda x: x["at"] == d), F.lit(0.0), lambda s, x: s + x["v"]))
    norm = lambda r: F.sqrt(F.aggregate(r, F.lit(0.0), lambda s, v: s + v * v))
    return bind(bind(parts, raw), lambda r: bind(norm(r), lambda n: F.transform(r, lambda v: F.when(n > 0, v / n).otherwise(v))))


def summary(label: Column, start: Column, end: Column, keywords: Column, text: Column) -> Column:
    """FN-15: the heuristic summary of a page range."""
    listed = F.when(F.size(keywords) > 0, F.concat(F.lit("; keywords: "), F.array_join(keywords, ", "))).otherwise("")
    body = F.when(F.length(text) > 0, F.substring(text, 1, 220)).otherwise("No content")
    return F.concat(label, F.lit(": covers pages "), start.cast("string"), F.lit("-"), end.cast("string"), listed, F.lit(". Summary: "), body)
