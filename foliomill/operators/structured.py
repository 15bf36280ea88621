"""Extraction with a language model: prompts, replies, spans in sections; without one, the examples' own texts."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.operators import extract
from foliomill.operators.llm_hooks import Client, completed, extract_json

#: One example: a text and what it holds, as objects with extraction_class, extraction_text and, if need be, attributes.
Example = tuple[str, list[dict[str, Any]]]

SYSTEM = 'You extract spans of a text word for word. Reply with JSON only: {"extractions": [{"extraction_class": "", "extraction_text": "", "attributes": {}}]}'
FOUND = "doc_id long, section_id string, page_number int, extraction_class string, extraction_text string, attributes string, char_start long, char_end long, alignment string, pass_index int, arrival string"


def prompt(description: str, examples: list[Example], text: Column) -> Column:
    """EXT-3: the task, each example with its output, then the text to work on."""
    shots = ""
    for given, holds in examples:
        told = [{"extraction_class": x["extraction_class"], "extraction_text": x["extraction_text"], "attributes": x.get("attributes", {})} for x in holds]
        shots += f"\n\nInput:\n{given}\nOutput:\n" + json.dumps({"extractions": told}, ensure_ascii=False)
    return F.concat(F.lit(f"Task: {description}{shots}\n\nInput:\n"), text, F.lit("\nOutput:"))


def items(reply: str) -> list[tuple[str, str, dict[str, str]]]:
    """EXT-2: (class, text, attributes) of a reply, a list or an object that holds one; what is malformed or blank goes."""
    try:
        value = extract_json(reply)
    except (ValueError, RecursionError):
        return []
    listed = value.get("extractions") if isinstance(value, dict) else value
    out = []
    for x in listed if isinstance(listed, list) else []:
        if isinstance(x, dict):
            kind, text, more = (x.get(k, "") for k in ("extraction_class", "extraction_text", "attributes"))
            kind, text = str(kind).strip(), str(text).strip()
            if kind and text:
                out.append((kind, text, {str(k): str(v) for k, v in more.items()} if isinstance(more, dict) else {}))
    return out


def locate(pieces: list[dict[str, Any]], at: int) -> dict[str, Any] | None:
    """FN-25: the piece that holds a position of its chunk; none between pieces."""
    return next((p for p in pieces if 0 <= at - p["chunk_offset"] < p["length"]), None)


def ground(pieces: list[dict[str, Any]], text: str, phrase: str) -> tuple[str | None, int | None, int | None, int | None, str]:
    """FN-26: (section_id, page_number, char_start, char_end, alignment) of a phrase of a chunk, cut at its section's piece."""
    span = extract.align(phrase, text)
    piece = locate(pieces, span[0]) if span else None
    if piece is None:
        return None, None, None, None, "unaligned"
    shift = piece["section_offset"] - piece["chunk_offset"]
    last = min(span[1], piece["chunk_offset"] + piece["length"])
    return piece["section_id"], piece["page_number"], span[0] + shift, last + shift, span[2]


def chunk_texts(sections: DataFrame, most: int = 4000) -> DataFrame:
    """FN-24: (doc_id, chunk, text, pieces), the pieces as JSON, from sections (doc_id, section_id, page_number, content)."""
    own = sections.select("doc_id", "section_id", F.col("page_number").cast("int").alias("page_number"), "content")
    placed = extract.chunks(own, most).join(own, ["doc_id", "section_id", "page_number"])
    part = F.col("content").substr(F.col("section_offset") + 1, F.col("length"))
    rows = placed.groupBy("doc_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("chunk_offset", "section_id", "page_number", "section_offset", "length", part.alias("part")))).alias("p"))
    return rows.select("doc_id", "chunk", F.array_join(F.transform("p", lambda x: x["part"]), "\n\n").alias("text"), F.to_json(F.transform("p", lambda x: x.dropFields("part"))).alias("pieces"))


def structured(sections: DataFrame, make_client: Callable[[], Client] | None, description: str, examples: list[Example], passes: int = 1, most: int = 4000) -> DataFrame:
    """EXT-1: what a model finds in chunks of all documents in each pass, with spans in sections and without repeats.

    A chunk whose call or reply fails gives nothing. Without a client, the
    examples' texts are looked up (EXT-4) in one pass. Null content is no section.
    """
    held = sections.where(F.col("content").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "section_id", F.col("page_number").cast("int").alias("page_number"), "content")
    if make_client is None:
        return extract.dedupe(_looked_up(held, examples))
    rows = chunk_texts(held, most).withColumn("pass_index", F.explode(F.sequence(F.lit(0), F.lit(max(1, passes) - 1))))
    replies = completed(rows.withColumn("prompt", prompt(description, examples, F.col("text"))), make_client, SYSTEM)
    names = [c.split()[0] for c in FOUND.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                pieces = json.loads(r.pieces)
                for n, (kind, phrase, more) in enumerate(items(r.reply)):
                    section, page, start, end, how = ground(pieces, r.text, phrase)
                    out.append((r.doc_id, section, page, kind, phrase, json.dumps(more, sort_keys=True), start, end, how, r.pass_index, f"{r.pass_index:06d}:{r.chunk:012d}:{n:09d}"))
            frame = pd.DataFrame(out, columns=names)
            yield frame.astype({"page_number": "Int32", "char_start": "Int64", "char_end": "Int64", "doc_id": "int64", "pass_index": "int32"})

    return extract.dedupe(replies.mapInPandas(run, FOUND))


def _looked_up(sections: DataFrame, examples: list[Example]) -> DataFrame:
    """EXT-4 with classes and attributes; an example given twice counts once."""
    given = {(x["extraction_class"], x["extraction_text"]): json.dumps(x.get("attributes", {}), sort_keys=True) for _, holds in examples for x in holds if x["extraction_text"]}
    listed = [(n, kind, text, more) for n, ((kind, text), more) in enumerate(given.items())]
    wanted = sections.sparkSession.createDataFrame(listed, "item_id int, extraction_class string, text string, attributes string")
    found = extract.literal(sections, wanted).join(wanted.withColumnRenamed("text", "extraction_text"), "item_id").join(sections.select("doc_id", "section_id", "page_number"), ["doc_id", "section_id"])
    arrival = F.format_string("%09d:%s:%012d:%09d", "page_number", "section_id", "char_start", "item_id")
    return found.select("doc_id", "section_id", "page_number", "extraction_class", "extraction_text", "attributes", F.col("char_start").cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end"), "alignment", F.lit(0).alias("pass_index"), arrival.alias("arrival"))


def counts(found: DataFrame) -> DataFrame:
    """AGG-10: extractions by document and alignment."""
    return found.groupBy("doc_id").agg(*[F.count_if(F.col("alignment") == how).alias(f"{how}_count") for how in ("exact", "fuzzy", "unaligned")])
