"""Scans, format dispatch and extraction of tables from documents.

All formats are handled by one ``mapInArrow`` pass, so every document is read and shipped to
Python once; documents that cannot hold a table are not shipped at all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_extension, file_stem
from .grids import GRID_SCHEMA
from .html_tables import ParsedTable, page_to_markdown, parse_html
from .workbook import parse_workbook, sheet_names

Parser = Callable[[bytes], Iterable[ParsedTable]]


def _unreadable_xls(content: bytes) -> Iterable[ParsedTable]:
    raise ValueError("binary .xls workbooks are not supported; save the file as .xlsx")


@dataclass(frozen=True)
class Format:
    name: str
    extensions: tuple[str, ...]
    parse: Parser


@dataclass(frozen=True)
class Formats:
    """The document formats known to a run. Immutable: every change gives a new set, so it
    ships to tasks as it is."""

    items: tuple[Format, ...] = field(default_factory=tuple)

    def register(self, name: str, extensions: Iterable[str], parse: Parser) -> Formats:
        """Add a format, or replace the one of that name."""
        extensions = tuple(e.lower() for e in extensions)
        if not callable(parse):
            raise TypeError(f"the parser of format {name!r} is not callable")
        if not extensions or not all(e.startswith(".") for e in extensions):
            raise ValueError(f"format {name!r} needs extensions like '.html'")
        others = tuple(f for f in self.items if f.name != name)
        return Formats((*others, Format(name, extensions, parse)))

    def unregister(self, name: str) -> tuple[Formats, bool]:
        """The set without a format, and whether it was there."""
        kept = tuple(f for f in self.items if f.name != name)
        return Formats(kept), len(kept) < len(self.items)

    def subset(self, names: Iterable[str]) -> Formats:
        known = {f.name: f for f in self.items}
        names = list(names)
        unknown = [n for n in names if n not in known]
        if unknown:
            raise ValueError(f"Unknown formats: {unknown}. Available: {list(known)}")
        return replace(self, items=tuple(known[n] for n in names))

    def names(self) -> list[str]:
        return [f.name for f in self.items]

    def extensions(self) -> list[str]:
        return sorted(self.by_extension())

    def by_extension(self) -> dict[str, Format]:
        """Extension to format; a later registration wins."""
        return {e: f for f in self.items for e in f.extensions}

    def parsers(self) -> dict[str, Parser]:
        return {f.name: f.parse for f in self.items}


DEFAULT_FORMATS = (
    Formats()
    .register("html", [".html", ".htm"], parse_html)
    .register("excel", [".xlsx"], parse_workbook)
    .register("excel_binary", [".xls"], _unreadable_xls)
)


def file_glob(formats: Formats) -> str:
    """A glob for file names of known formats in any letter case, so that a scan does not read
    the content of other files."""
    def any_case(extension: str) -> str:
        return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in extension)

    return "*{" + ",".join(any_case(e) for e in formats.extensions()) + "}"


def scan_directory(spark: SparkSession, directory: str, recursive: bool = False,
                   formats: Formats = DEFAULT_FORMATS) -> DataFrame:
    """All supported files of a directory; a path which is missing or no directory is an error."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(directory)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        raise FileNotFoundError(f"Directory not found: {directory}")
    if not fs.getFileStatus(path).isDirectory():
        raise NotADirectoryError(f"Path is not a directory: {directory}")
    reader = spark.read.format("binaryFile").option("pathGlobFilter", file_glob(formats))
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    files = reader.load(directory)
    return files.filter(file_extension(F.col("path")).isin(formats.extensions()))


def file_documents(files: DataFrame) -> DataFrame:
    """Documents of a file scan; the id is a hash of the path."""
    return files.select(
        F.sha2("path", 256).alias("doc_id"), F.col("path").alias("source_file"), "content"
    )


def page_documents(pages: DataFrame, url: str = "url", html: str = "html",
                   doc_id: Column | None = None) -> DataFrame:
    """Documents of a table of pages. A page without an extension counts as HTML."""
    return pages.select(
        (doc_id if doc_id is not None else F.sha2(F.col(url), 256)).cast("string").alias("doc_id"),
        F.col(url).alias("source_file"),
        F.col(html).alias("html"),
    )


def route(documents: DataFrame, formats: Formats = DEFAULT_FORMATS,
          path: str = "source_file") -> DataFrame:
    """Add the format of each document by its extension, or the reason why there is none."""
    extension = file_extension(F.col(path))
    known = formats.by_extension()
    chosen = F.lit(None).cast("string")
    for e, f in known.items():
        chosen = F.when(extension == e, f.name).otherwise(chosen)
    listed = ", ".join(formats.extensions())
    return documents.withColumn("extension", extension).withColumn("format", chosen).withColumn(
        "error",
        F.when(
            F.col("format").isNull(),
            F.concat(
                F.lit("No extractor found for file: "), F.col(path),
                F.lit(" (extension: "), extension,
                F.lit(f"). Supported extensions: {listed}"),
            ),
        ),
    )


def missing_files(manifest: DataFrame, scanned: DataFrame, path: str = "path") -> DataFrame:
    """Paths of a manifest which the scan did not see."""
    return manifest.join(scanned.select(path), path, "left_anti").withColumn(
        "error", F.concat(F.lit("File not found: "), F.col(path))
    )


_ARROW_SCHEMA = pa.schema([
    ("doc_id", pa.string()), ("source_file", pa.string()), ("ordinal", pa.int32()),
    ("tables_found", pa.int32()), ("table_id", pa.string()), ("html", pa.string()),
    ("header", pa.list_(pa.list_(pa.string()))), ("body", pa.list_(pa.list_(pa.string()))),
    ("ok", pa.bool_()), ("error", pa.string()),
])
_FLUSH_CELLS, _FLUSH_CHARS = 200_000, 32_000_000
_MARKDOWN_CHARS = 1_000_000


def _parse_batches(parsers: dict[str, Parser]):
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            held = chars = 0
            columns = [batch.column(n) for n in ("doc_id", "source_file", "stem", "format", "content", "error")]
            for i in range(batch.num_rows):
                doc_id, source, stem, format_, content, error = (c[i].as_py() for c in columns)
                found: list[ParsedTable] = []
                if error is None and content is not None:
                    try:
                        found = list(parsers[format_](content))
                    except Exception as failure:  # a bad document is a rejected row
                        found, error = [], f"Extraction failed: {failure}"
                if not found:
                    out.append((doc_id, source, 0, 0, None, None, None, None, error is None, error))
                for ordinal, t in enumerate(found, 1):
                    held += 1 + sum(map(len, t.body))
                    chars += len(t.html or "") + sum(len(c or "") for r in t.body for c in r)
                    out.append((doc_id, source, ordinal, len(found), f"{stem}_{t.name}", t.html,
                                t.header, t.body, t.error is None, t.error))
                if held > _FLUSH_CELLS or chars > _FLUSH_CHARS:
                    yield _to_batch(out)
                    out, held, chars = [], 0, 0
            if out:
                yield _to_batch(out)

    return parse


def _to_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(values, type=f.type) for values, f in zip(zip(*rows), _ARROW_SCHEMA)],
        schema=_ARROW_SCHEMA,
    )


def extract_pages(documents: DataFrame) -> DataFrame:
    """Tables of HTML documents held as text. The text of a page without any table stays in
    the JVM: only its id goes through Python, for its record of zero tables."""
    has_table = F.contains(F.lower(F.col("html")), F.lit("<table"))
    prepared = documents.select(
        "doc_id",
        "source_file",
        file_stem(F.col("source_file")).alias("stem"),
        F.lit("html").alias("format"),
        F.when(has_table, F.col("html")).alias("content"),
        F.lit(None).cast("string").alias("error"),
    )
    return prepared.mapInArrow(_parse_batches({"html": parse_html}), GRID_SCHEMA)


def extract_files(documents: DataFrame, formats: Formats = DEFAULT_FORMATS) -> DataFrame:
    """Tables of file documents (bytes), each parsed by the format of its extension; files of
    no known format become failed records."""
    prepared = route(documents, formats).select(
        "doc_id",
        "source_file",
        file_stem(F.col("source_file")).alias("stem"),
        "format",
        F.when(F.col("error").isNull(), F.col("content")).alias("content"),
        "error",
    )
    return prepared.mapInArrow(_parse_batches(formats.parsers()), GRID_SCHEMA)


def extract_sheet(documents: DataFrame, sheet: str) -> DataFrame:
    """One named sheet of every workbook; a workbook without it gives a record of no tables."""
    one = Formats().register(
        "excel", [".xlsx"], lambda content: parse_workbook(content, sheet)
    )
    return extract_files(documents, one)


def list_sheets(documents: DataFrame) -> DataFrame:
    """Sheet names of every workbook, without reading the sheets."""
    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (source, i, name)
                for source, content in zip(batch.column(0).to_pylist(), batch.column(1))
                for i, name in enumerate(sheet_names(content.as_py() or b""))
            ]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v) for v in zip(*rows)], names=["source_file", "sheet_pos", "sheet_name"]
                )

    return documents.select("source_file", "content").mapInArrow(
        names, "source_file string, sheet_pos bigint, sheet_name string"
    )


_MARKDOWN_SCHEMA = pa.schema([("doc_id", pa.string()), ("source_file", pa.string()),
                              ("text", pa.string()), ("error", pa.string())])


def _markdown_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages = batch.column(2)
        texts, errors = [], []
        start = chars = 0
        for i in range(batch.num_rows):
            try:
                texts.append(page_to_markdown(pages[i].as_py() or ""))
                errors.append(None)
            except Exception as failure:
                texts.append(None)
                errors.append(f"Conversion failed: {failure}")
            chars += len(texts[-1] or "")
            if chars > _MARKDOWN_CHARS or i + 1 == batch.num_rows:
                done = batch.slice(start, i + 1 - start)
                yield pa.RecordBatch.from_arrays(
                    [done.column(0), done.column(1), pa.array(texts, pa.string()),
                     pa.array(errors, pa.string())], schema=_MARKDOWN_SCHEMA,
                )
                texts, errors, start, chars = [], [], i + 1, 0


def pages_to_markdown(documents: DataFrame) -> DataFrame:
    """Every HTML document as markdown text; a page that fails keeps the reason. Of a batch, one page
    and about ``_MARKDOWN_CHARS`` of finished text are Python objects at a time."""
    return documents.select("doc_id", "source_file", "html").mapInArrow(
        _markdown_batches, "doc_id string, source_file string, text string, error string"
    )
