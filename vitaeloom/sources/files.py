"""Resumes and postings from files: sniffing, plain text, DOCX and a contract for other readers."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
LEAST_POSTING, LEAST_RESUME = 100, 200
MOST_BYTES = 5 * 1024 * 1024
# Contact data in a header or footer, and the characters from which any text there counts.
CONTACT_DATA, LEAST_MARGIN = re.compile(r"@|\(?\+?\d[\d\s().-]{7,}\d"), 20
# Domains of the form fields.
TRACKS = ("mle", "applied_scientist", "data_scientist", "ml_research", "data_engineer")
PLATFORMS = ("workday", "greenhouse", "lever", "ashby")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of the files below a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def sniff_format(path: Column, content: Column) -> Column:
    """pdf, docx or text by the first bytes, else by the extension; null if unsupported."""
    head = F.substring(content, 1, 4096)
    word = F.instr(F.hex(head), F.hex(F.lit("word/"))) > 0
    ending = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    by_name = F.when(ending == "pdf", "pdf").when(ending == "docx", "docx").when(ending.isin("txt", "md", "text"), "text")
    return F.when(F.startswith(F.hex(head), F.hex(F.lit("%PDF-"))), "pdf").when(F.startswith(F.hex(head), F.lit("504B0304")) & word, "docx").otherwise(by_name)


def split_accepted(files: DataFrame, most: int = MOST_BYTES) -> tuple[DataFrame, DataFrame]:
    """(accepted with `file_format`, rejected with `reason`): too large or unsupported files are rows, not errors."""
    seen = files.withColumn("file_format", sniff_format(F.col("path"), F.col("content")))
    reason = F.when(F.col("length") > most, "too_large").when(F.col("file_format").isNull(), "unsupported")
    return seen.where(reason.isNull()), seen.where(reason.isNotNull()).select("path", reason.alias("reason"))


def read_text(files: DataFrame) -> DataFrame:
    """(path, text) of text files, as UTF-8 with replacement of what isn't."""
    return files.where("file_format = 'text'").select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def _words(node: ElementTree.Element) -> str:
    signs = {f"{W}tab": "\t", f"{W}br": "\n"}
    return "".join(t.text or "" if t.tag == f"{W}t" else signs[t.tag] for t in node.iter() if t.tag == f"{W}t" or t.tag in signs)


def _margin(archive: zipfile.ZipFile) -> tuple[str, str]:
    """(zone, text) of the first header or footer with contact data or more than LEAST_MARGIN characters."""
    parts = [(m[2], m[1], n) for n in archive.namelist() if (m := re.fullmatch(r"word/(header|footer)(\d*)\.xml", n))]
    for number, zone, name in sorted(parts, key=lambda x: (int(x[0] or 1), x[1] != "header")):
        try:
            text = "\n".join(_words(p) for p in ElementTree.fromstring(archive.read(name)).iter(f"{W}p")).strip()
        except ElementTree.ParseError:
            continue
        if text and (CONTACT_DATA.search(text) or len(text) > LEAST_MARGIN):
            return f"{zone} (section {number or 1})", text
    return "", ""


def _table(table: ElementTree.Element, after: str) -> tuple[list[str], str]:
    """Lines and a note of a table: a row becomes "head: a, b" if its first cell is a head, else a line for each cell."""
    lines, rows = [], list(table.iter(f"{W}tr"))
    width = 0
    for row in rows:
        cells = [" ".join(_words(p) for p in c.iter(f"{W}p")).strip() for c in row.iter(f"{W}tc")]
        width = max(width, len(cells))
        headed = len(cells) > 1 and cells[0] and not cells[0].endswith(":")
        lines += [f"{cells[0]}: {', '.join(filter(None, cells[1:]))}"] if headed else list(filter(None, cells))
    return lines, f"{len(rows)}x{width} table after '{after or 'start'}'"


def docx_parts(data: bytes) -> dict:
    """Text in document order and layout of one DOCX file: text boxes first, then a telling header or footer, then the body."""
    out = {"text": "", "body_text": "", "table_notes": [], "box_texts": [], "n_tables": 0, "n_columns": 1, "n_images": 0, "fonts": [], "margin_zone": "", "margin_text": "", "error": None}
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{W}body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        return out | {"error": type(e).__name__}
    lines: list[str] = []
    heading = ""
    for node in body:
        if node.tag == f"{W}p":
            text = "".join(_words(r) for r in node if r.tag in (f"{W}r", f"{W}hyperlink") and not list(r.iter(f"{W}txbxContent"))).strip()
            style = next((x.get(f"{W}val", "") for x in node.iter(f"{W}pStyle")), "").lower()
            if text and len(text) <= 40 and (text.isupper() or style.startswith("heading")):
                heading = text
            lines.append(text)
        elif node.tag == f"{W}tbl":
            rows, note = _table(node, heading)
            lines += rows
            out["table_notes"].append(note)
    boxes = [t for b in body.iter(f"{W}txbxContent") for p in b.iter(f"{W}p") if (t := "".join(x.text or "" for x in p.iter(f"{W}t"))).strip()]
    zone, margin = _margin(archive)
    columns = [int(c.get(f"{W}num", "1")) for c in body.iter(f"{W}cols")]
    fonts = sorted({f.get(f"{W}ascii") for f in body.iter(f"{W}rFonts")} - {None})
    images = sum(1 for n in archive.namelist() if n.startswith("word/media/"))
    whole = "\n".join([*boxes, *filter(None, [margin]), *lines])
    return out | {"text": whole, "body_text": "\n".join(lines), "n_tables": len(out["table_notes"]), "box_texts": boxes, "n_columns": max(columns, default=1), "n_images": images, "fonts": fonts, "margin_zone": zone, "margin_text": margin}


DOCX = "text string, body_text string, table_notes array<string>, box_texts array<string>, n_tables int, n_columns int, n_images int, fonts array<string>, margin_zone string, margin_text string, error string"


def read_docx(files: DataFrame) -> DataFrame:
    """(doc_id, text and layout counts) of DOCX files, with the standard library only; a broken file has its error and no text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame([{"doc_id": p} | docx_parts(c) for p, c in zip(b["path"], b["content"])])

    return files.where("file_format = 'docx'").select("path", "content").mapInPandas(run, f"doc_id string, {DOCX}")


def read_layout(files: DataFrame, reader: Callable[[bytes], dict[str, list[dict]]], name: str, schema: str) -> DataFrame:
    """One layout table (words, fonts, lines or pages) of the files, from a pluggable reader of their bytes, such as one for PDF."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [{"doc_id": p} | r for p, c in zip(b["path"], b["content"]) for r in reader(c).get(name, [])]
            if rows:
                yield pd.DataFrame(rows)

    return files.select("path", "content").mapInPandas(run, schema)


def check_submissions(submissions: DataFrame) -> DataFrame:
    """Adds `reason`, null for what is accepted: posting_too_short, resume_missing, resume_too_short or too_large."""
    posting, resume = F.length(F.trim(F.coalesce("posting_text", F.lit("")))), F.length(F.trim(F.coalesce("resume_text", F.lit(""))))
    size = F.coalesce("n_bytes", F.lit(0))
    reason = F.when(size > MOST_BYTES, "too_large").when(posting < LEAST_POSTING, "posting_too_short").when(resume == 0, "resume_missing").when(resume < LEAST_RESUME, "resume_too_short")
    return submissions.withColumn("reason", reason)


def lenient(value: Column, domain: tuple[str, ...]) -> Column:
    """A form value of a domain; anything else is null."""
    v = F.lower(F.trim(value))
    return F.when(v.isin(*domain), v)
