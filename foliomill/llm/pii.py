"""Operator 3: personal data, with DataFrame functions only.

Patterns propose spans, checksums and ranges confirm them, and words near a
span raise or lower its score. The places of matches follow from the pieces
between them: splitting by the pattern and extracting it walk the text alike.
No shuffle: a row's spans come from that row alone.

Patterns are written so that they match the same text as their plain forms
without backtracking over long runs: a match can only begin where a run does,
or where the last match ended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.llm.common import whole_text

#: Kinds in output order: pattern, a substring or pattern that any match needs, score, words nearby that speak for it.
KINDS: dict[str, tuple[str, str, float, tuple[str, ...]]] = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, ("mail", "contact", "address")),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]", 0.6, ("ip", "host", "server", "address")),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", r"[0-9][\x20-]?[0-9]", 0.8, ("card", "visa", "credit", "payment")),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.6, ("phone", "tel", "call", "mobile")),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2}", 0.9, ("iban", "bank", "account")),
}
BASE = ("email", "ip", "card", "phone")
#: Words nearby that speak against any span.
AGAINST = ("version", "serial", "order")
NEAR = 40


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    places = F.sequence(F.lit(1), F.length(digits))

    def add(total: Column, place: Column) -> Column:
        digit = F.ascii(F.substr(F.reverse(digits), place, F.lit(1))) - 48
        doubled = F.when(place % 2 == 0, digit * 2).otherwise(digit)
        return total + doubled - F.when(doubled > 9, 9).otherwise(0)

    return F.aggregate(places, F.lit(0), add) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an IBAN (blanks allowed) leaves 1 when divided by 97."""
    plain = F.replace(value, F.lit(" "))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))

    def add(rest: Column, char: Column) -> Column:
        code = F.ascii(char)
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda r, c: F.when(c == "", r).otherwise(add(r, c))) == 1


def valid(kind: str, value: Column) -> Column:
    """The check that a match of a kind has to pass."""
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        digits = _digits(value)
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    if kind == "iban":
        return mod97(value)
    return F.lit(True)


def _none(kind: str) -> Column:
    return F.expr("cast(array() as array<struct<kind:string,start:bigint,end:bigint,score:double>>)")


def proposed(text: Column, kind: str) -> Column:
    """All matches of a kind as array<struct<start, end, value>>, offsets in code points."""
    pattern, needs = KINDS[kind][:2]
    empty = F.expr("cast(array() as array<struct<start:bigint,end:bigint,value:string>>)")
    pieces = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def add(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["piece"])
        end = start + F.length(pair["value"])
        return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(start.alias("start"), end.alias("end"), pair["value"].alias("value"))).alias("out"))

    pairs = F.zip_with(F.slice(pieces, 1, F.size(pieces) - 1), matches, lambda a, b: F.struct(a.alias("piece"), b.alias("value")))
    begin = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out"))
    holds = F.contains(text, F.lit(needs)) if needs == "@" else text.rlike(needs)
    return F.when(holds, F.aggregate(pairs, begin, add, lambda acc: acc["out"])).otherwise(empty)


def confirmed(text: Column, found: Column, kind: str) -> Column:
    """Those of ``found`` that pass their check, as array<struct<kind, start, end, score>>."""
    score, words = KINDS[kind][2:]

    def rated(x: Column) -> Column:
        begin = F.greatest(x["start"] - NEAR, F.lit(0).cast("long"))
        near = F.lower(F.concat(F.substr(text, (begin + 1).cast("int"), (x["start"] - begin).cast("int")), F.lit(" "), F.substr(text, (x["end"] + 1).cast("int"), F.lit(NEAR))))
        return F.struct(
            F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"),
            F.round(F.lit(score) + F.when(near.rlike(rf"(?<![a-z])(?:{'|'.join(words)})"), 0.1).otherwise(0.0) - F.when(near.rlike(rf"(?<![a-z])(?:{'|'.join(AGAINST)})"), 0.2).otherwise(0.0), 2).alias("score"),
        )

    return F.when(F.size(found) > 0, F.transform(F.filter(found, lambda x: valid(kind, x["value"])), rated)).otherwise(_none(kind))


def with_spans(docs: DataFrame, column: str = "pii_spans") -> DataFrame:
    """``docs`` with array<struct<kind, start, end, score>> by kind as listed, then start.

    Null and empty texts have none. Null ids, repeated rows and further
    columns pass unchanged; a column named ``column`` is replaced.
    """
    plain, names = docs.drop(column), {}
    for kind in KINDS:
        name = f"_{kind}"
        while name in plain.columns:
            name += "_"
        names[kind] = name
    text = whole_text()
    # Two projections, so that each pattern runs once.
    found = plain.select("*", *[proposed(text, k).alias(n) for k, n in names.items()])
    return found.withColumn(column, F.concat(*[confirmed(text, F.col(n), k) for k, n in names.items()])).drop(*names.values())


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """Per document: counts by kind, the digest of the base kinds, all spans with scores and the highest score."""
    rows = with_spans(docs.select("doc_id", "text"), "spans_")
    spans = F.col("spans_")
    of = lambda *kinds: F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return rows.select(
        "doc_id",
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(listed(of(*BASE)), 256).alias("base_sha256"),
        listed(spans).alias("spans"),
        F.array_join(F.transform(spans, lambda s: s["score"].cast("string")), ",").alias("scores"),
        F.coalesce(F.array_max(F.transform(spans, lambda s: s["score"])), F.lit(0.0)).alias("score"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span replaced by its kind in brackets; overlapping spans become one. Null texts stay null."""
    name = "pii_spans_"
    while name in docs.columns:
        name += "_"
    text = F.col("text")
    ordered = F.array_sort(F.transform(F.col(name), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def add(acc: Column, s: Column) -> Column:
        within = s["start"] < acc["at"]
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(within, acc["out"]).otherwise(F.concat(acc["out"], F.substr(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit("["), F.upper(s["kind"]), F.lit("]"))).alias("out"),
        )

    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    clean = F.aggregate(ordered, begin, add, lambda acc: F.concat(acc["out"], F.substr(text, (acc["at"] + 1).cast("int"))))
    columns = docs.columns
    return with_spans(docs, name).select(*[F.when(F.size(name) > 0, clean).otherwise(text).alias("text") if c == "text" else F.col(c) for c in columns])
