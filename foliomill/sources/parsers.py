"""File parsers: whole files to rows of (page_number, content, heading, source_format, metadata as JSON)."""

from __future__ import annotations

import ast
import io
import json
import re
import sqlite3
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Section = tuple[int, str, str, str, str]
SECTIONS = "doc_id string, section_id string, page_number int, content string, heading string, source_format string, metadata string"

# The elements that become sections.
HTML_BLOCKS = ("h1", "h2", "h3", "h4", "p", "li")
HIDDEN = ("script", "style", "noscript")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
_JS = re.compile(r"\b(function|class)\s+([A-Za-z_$][\w$]*)")
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _numbered(rows: list[tuple[str, str, dict]], kind: str) -> list[Section]:
    return [(i, content, heading, kind, json.dumps(meta)) for i, (content, heading, meta) in enumerate(rows, 1)]


def text(data: bytes) -> list[Section]:
    """SRC-1."""
    parts = [p.strip() for p in data.decode("utf-8", "replace").split("\n\n")]
    return _numbered([(p, "", {"chunk_type": "paragraph"}) for p in parts if p], "text")


def markdown(data: bytes) -> list[Section]:
    """SRC-2: the text under each heading, which stays with it; text before the first is the introduction."""
    heading, held, rows, fenced = "Introduction", [], [], False
    lines = data.decode("utf-8", "replace").splitlines()

    def flush() -> None:
        if body := "\n".join(held).strip():
            rows.append((body, heading, {"heading": heading}))
        held.clear()

    for i, line in enumerate(lines):
        if line.lstrip().startswith(("```", "~~~")):
            fenced = not fenced
        found = None if fenced else re.match(r" {0,3}#{1,6}\s+(.*?)\s*#*\s*$", line)
        if found:
            flush()
            heading = found[1]
        elif not fenced and re.fullmatch(r" {0,3}(=+|-{2,})\s*", line) and i and held and held[-1].strip():
            title = held.pop()
            flush()
            heading = title.strip()
        else:
            held.append(line)
    flush()
    whole = "\n".join(lines).strip()
    return _numbered(rows or ([(whole, heading, {"heading": heading})] if whole else []), "markdown")


class _Blocks(HTMLParser):
    def __init__(self, hidden: tuple[str, ...]):
        super().__init__(convert_charrefs=True)
        self.hidden, self.hiding, self.open, self.blocks, self.all = hidden, 0, [], [], []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.hidden:
            self.hiding += 1
        if tag in VOID:
            return
        if tag in HTML_BLOCKS:
            if tag in ("p", *HTML_BLOCKS[:4]) and self.open and self.open[-1]["tag"] == "p":
                self.open.pop()  # a paragraph ends where the next block begins
            block = {"tag": tag, "text": [], "links": []}
            self.blocks.append(block)
            self.open.append(block)
        if tag == "a" and (link := dict(attrs).get("href")):
            for block in self.open:
                block["links"].append(link)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.hidden:
            self.hiding = max(0, self.hiding - 1)
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i]["tag"] == tag:
                del self.open[i:]
                break

    def handle_data(self, data: str) -> None:
        if not self.hiding and data.strip():
            self.all.append(data.strip())
            for block in self.open:
                block["text"].append(data.strip())


def html(data: bytes | str, hidden: tuple[str, ...] = ()) -> list[Section]:
    """SRC-3 (and SRC-11 with ``HIDDEN``): headings, paragraphs and list items in document order, nested ones again."""
    parser = _Blocks(hidden)
    parser.feed(data if isinstance(data, str) else data.decode("utf-8", "replace"))
    parser.close()
    rows = [(" ".join(b["text"]).strip(), "", {"tag": b["tag"], "links": b["links"]}) for b in parser.blocks]
    rows = [r for r in rows if r[0]]
    whole = " ".join(parser.all)
    return _numbered(rows or ([(whole, "", {"tag": "document", "links": []})] if hidden and whole else []), "html")


def docx(data: bytes) -> list[Section]:
    """SRC-4: paragraphs under their headings, then tables row by row."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{_WORD}body")
    said = lambda e: "".join(t.text or "" for t in e.iter(f"{_WORD}t")).strip()
    heading, rows = "", []
    for p in body.findall(f"{_WORD}p"):
        style = p.find(f"{_WORD}pPr/{_WORD}pStyle")
        name = style.get(f"{_WORD}val", "") if style is not None else "Normal"
        if not said(p):
            continue
        if name.startswith("Heading"):
            heading = said(p)
        else:
            rows.append((said(p), heading, {"heading": heading, "style": name}))
    for i, t in enumerate(body.findall(f"{_WORD}tbl"), 1):
        lines = [" | ".join(said(c) for c in r.findall(f"{_WORD}tc")) for r in t.findall(f"{_WORD}tr")]
        rows.append(("\n".join(lines), heading, {"type": "table", "table_index": i}))
    return _numbered(rows, "docx")


def python_code(data: bytes) -> list[Section]:
    """SRC-6: functions and classes, breadth first, at their first line; a module without any as a whole."""
    source = data.decode("utf-8", "replace")
    rows: list[Section] = []
    try:
        for node in ast.walk(ast.parse(source)):
            if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                kind = "class" if isinstance(node, ast.ClassDef) else "function"
                meta = {"kind": kind, "name": node.name, "line_start": node.lineno, "line_end": node.end_lineno, "docstring": ast.get_docstring(node) or ""}
                rows.append((node.lineno, ast.get_source_segment(source, node) or "", node.name, "code_py", json.dumps(meta)))
    except SyntaxError:
        rows = []
    return rows or ([(1, source, "", "code_py", json.dumps({"kind": "module"}))] if source.strip() else [])


def script_code(data: bytes) -> list[Section]:
    """SRC-7: one line before to twelve after each function or class; a module without any as a whole."""
    source = data.decode("utf-8", "replace")
    lines, rows = source.splitlines(), []
    for m in _JS.finditer(source):
        line = source.count("\n", 0, m.start())
        rows.append((line + 1, "\n".join(lines[max(0, line - 1) : line + 13]), m[2], "code_js", json.dumps({"kind": m[1], "name": m[2], "line_start": line + 1})))
    return rows or ([(1, source, "", "code_js", json.dumps({"kind": "module"}))] if source.strip() else [])


def csv_table(data: bytes, rows: int = 25) -> list[Section]:
    """SRC-8: the columns, the first rows as ``column=value``, and the columns' counts over all rows."""
    table = pd.read_csv(io.BytesIO(data), dtype=str, keep_default_na=False)
    names = list(table.columns)
    out = [(1, "Columns: " + ", ".join(names), "", "csv", json.dumps({"type": "schema", "column_count": len(names)}))]
    for i, values in enumerate(table.head(rows).itertuples(index=False), 1):
        out.append((i + 1, "; ".join(f"{n}={v}" for n, v in zip(names, values, strict=True)), "", "csv", json.dumps({"type": "row", "row_index": i})))
    counts = [(n, [v.strip() for v in table[n] if v.strip()]) for n in names]
    stats = "; ".join(f"{n}: non_empty={len(v)}, unique={len(set(v))}" for n, v in counts)
    return [*out, (len(out) + 1, stats, "", "csv", json.dumps({"type": "stats"}))]


def sqlite_tables(data: bytes, rows: int = 25) -> list[Section]:
    """SRC-9: by table in order of name its columns and first rows."""
    db = sqlite3.connect(":memory:")
    db.deserialize(data)
    out: list[Section] = []
    for (name,) in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name").fetchall():
        quoted = '"' + name.replace('"', '""') + '"'
        columns = [(c[1], c[2]) for c in db.execute(f"PRAGMA table_info({quoted})")]
        out.append((len(out) + 1, f"Table {name}: " + ", ".join(f"{c} {t}".strip() for c, t in columns), name, "sqlite", json.dumps({"type": "schema", "table": name, "column_count": len(columns)})))
        for i, values in enumerate(db.execute(f"SELECT * FROM {quoted} LIMIT {int(rows)}"), 1):
            out.append((len(out) + 1, "; ".join(f"{c}={'' if v is None else v}" for (c, _), v in zip(columns, values, strict=True)), name, "sqlite", json.dumps({"type": "row", "table": name, "row_index": i})))
    return out


def transcript(data: bytes) -> list[Section]:
    """SRC-10: one section a line."""
    lines = [x.strip() for x in data.decode("utf-8", "replace").splitlines()]
    return _numbered([(x, "", {"type": "transcript_line"}) for x in lines if x], "transcript")


def pdf(data: bytes, tables: int = 3, images: int = 5, ocr: Callable[[bytes, int], str | None] | None = None) -> list[Section]:
    """SRC-5: a page's text (by ``ocr`` where it has none); needs the optional package pypdf."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise ValueError("PDF files need the package pypdf") from e
    out = []
    for i, page in enumerate(PdfReader(io.BytesIO(data)).pages, 1):
        said = (page.extract_text() or "").strip() or (ocr(data, i) if ocr else "") or ""
        if said:
            out.append((i, said, "", "pdf", json.dumps({"page": i, "type": "text", "image_count": len(page.images)})))
    return out


#: SRC-0: parsers by extension; ``register`` adds to them.
PARSERS: dict[str, Callable[[bytes], list[Section]]] = {
    ".txt": text, ".md": markdown, ".markdown": markdown, ".html": html, ".htm": html, ".docx": docx, ".pdf": pdf, ".py": python_code,
    ".js": script_code, ".jsx": script_code, ".ts": script_code, ".tsx": script_code, ".csv": csv_table, ".db": sqlite_tables, ".sqlite": sqlite_tables, ".sqlite3": sqlite_tables,
}
MEDIA = (".mp3", ".wav", ".m4a", ".mp4", ".mov")


def register(extension: str, parser: Callable[[bytes], list[Section]]) -> None:
    """SRC-0b."""
    PARSERS[extension.lower()] = parser


def parse_files(files: DataFrame) -> DataFrame:
    """SRC-0 over rows (doc_id, path, content as bytes): sections of every file, in parallel by file.

    An unknown extension, or a file without sections, is an error that names the path.
    """
    parsers = dict(PARSERS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, path, data in zip(batch.doc_id, batch.path, batch.content, strict=True):
                extension = path[path.rfind(".") :].lower() if "." in path else ""
                if extension not in parsers:
                    raise ValueError(f"no parser for {path}")
                found = parsers[extension](bytes(data))
                if not found:
                    raise ValueError(f"no content in {path}")
                out += [(doc, f"sec_{i:04d}", *s) for i, s in enumerate(found, 1)]
            yield pd.DataFrame(out, columns=["doc_id", "section_id", "page_number", "content", "heading", "source_format", "metadata"])

    return files.select("doc_id", "path", "content").mapInPandas(run, SECTIONS)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """SRC-0: all files under a path; a media file is read through its transcript (SRC-10, JN-14): ``name.ext.txt``, else ``name.txt``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    media = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*MEDIA)
    stem = F.regexp_replace("path", r"\.[^./]+$", "")
    asked = files.where(media).select("path", F.concat("path", F.lit(".txt")).alias("first"), F.concat(stem, F.lit(".txt")).alias("second"))
    texts = files.where(F.lower("path").endswith(".txt"))
    said = asked.join(texts.select(F.col("path").alias("first"), F.col("content").alias("a")), "first", "left").join(texts.select(F.col("path").alias("second"), F.col("content").alias("b")), "second", "left")
    lines = said.select(F.col("path"), F.coalesce("a", "b").cast("string").alias("t")).where(F.col("t").isNotNull())
    name = F.concat(F.lit("doc_"), F.substring(F.sha1("path"), 1, 12)).alias("doc_id")
    pieces = F.filter(F.transform(F.split("t", r"\R"), lambda x: F.trim(x)), lambda x: x != "")
    page = (F.col("at") + 1).cast("int")
    spoken = lines.select(name, F.posexplode_outer(pieces).alias("at", "content")).where(F.col("content").isNotNull())
    spoken = spoken.select("doc_id", F.format_string("sec_%04d", page).alias("section_id"), page.alias("page_number"), "content", F.lit("").alias("heading"), F.lit("transcript").alias("source_format"), F.lit('{"type": "transcript_line"}').alias("metadata"))
    used = said.select(F.explode(F.array("first", "second")).alias("path"))
    return parse_files(files.where(~media).join(used, "path", "left_anti").select(name, "path", "content")).unionByName(spoken)


def html_sections(pages: DataFrame) -> DataFrame:
    """SRC-11 over rows (page_id, html), in Arrow batches: sections of what readers see."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(page, n, json.loads(meta)["tag"], content, len(json.loads(meta)["links"])) for page, data in zip(batch.page_id, batch.html, strict=True) for n, content, _, _, meta in html(data or "", HIDDEN)]
            yield pd.DataFrame(out, columns=["page_id", "page_number", "tag", "content", "n_links"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, page_number int, tag string, content string, n_links int")
