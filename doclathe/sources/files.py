"""Files of any known format as rows of one shape: one row for each file, errors included."""

from __future__ import annotations

import csv
import io
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as S
from ..resilience import HttpClient
from ..shipping import ship
from . import html, office

RESULT = "success boolean, file_path string, file_type string, file_size long, text string, paragraphs array<string>, tables array<array<array<string>>>, images array<struct<src:string,alt:string>>, metadata map<string,string>, error string"
#: Encodings in the order in which they are tried.
ENCODINGS = ("utf-8", "utf-8-sig", "gbk", "gb2312", "gb18030", "latin-1")


def decoded(data: bytes, first: str = "utf-8") -> tuple[str, str]:
    """(text, encoding): the first that fits; latin-1 always does. Line ends become single line feeds."""
    for e in dict.fromkeys((first, *ENCODINGS)):
        try:
            return data.decode(e).replace("\r\n", "\n").replace("\r", "\n"), e
        except (UnicodeDecodeError, LookupError):
            pass
    raise AssertionError


def parse_txt(data: bytes, path: str = "", encoding: str = "utf-8", separator: str = "\n\n", skip_empty: bool = True) -> dict:
    text, used = decoded(data, encoding)
    paragraphs = [p.strip() for p in text.split(separator)]
    paragraphs = [p for p in paragraphs if p] if skip_empty else paragraphs
    lines = text.split("\n")
    about = {"encoding": used, "total_lines": len(lines), "non_empty_lines": sum(bool(x.strip()) for x in lines), "paragraphs_count": len(paragraphs), "char_count": len(text)}
    return {"text": text, "paragraphs": paragraphs, "tables": [], "images": [], "metadata": {k: str(v) for k, v in about.items()}}


def parse_html(data: bytes, path: str = "", encoding: str = "utf-8", **options) -> dict:
    try:
        page = data.decode(encoding)
    except UnicodeDecodeError:
        page = data.decode("utf-8", "replace")
    return html.parse(page, path if path.startswith("http") else "", **options)


def parse_csv(data: bytes, path: str = "", encoding: str = "utf-8", delimiter: str | None = None) -> dict:
    """A list of rows, the first of which names the columns; records are in ``tables`` and metadata."""
    rows = list(csv.reader(io.StringIO(data.decode(encoding)), delimiter=delimiter or ("," if path.endswith(".csv") else "\t")))
    if not rows:
        return {"text": "", "paragraphs": [], "tables": [], "images": [], "metadata": {"rows": "0"}}
    lines = [",".join(r) for r in rows]
    return {"text": "\n".join(lines), "paragraphs": lines, "tables": [rows], "images": [], "metadata": {"headers": ",".join(rows[0]), "total_rows": str(len(rows)), "data_rows": str(len(rows) - 1)}}


@dataclass(frozen=True)
class Parser:
    name: str
    extensions: tuple[str, ...]
    parse: Callable[..., dict]


class ParserRegistry:
    """Parsers by extension; what is unknown is read as plain text."""

    def __init__(self):
        self.by: dict[str, Parser] = {}
        for p in (Parser("txt", ("txt", "md", "markdown", "json", "jsonl", "csv", "log"), parse_txt), Parser("html", ("html", "htm", "xhtml"), parse_html), Parser("pdf", ("pdf",), lambda d, p="", **o: office.parse_pdf(d, **o)), Parser("docx", ("docx",), lambda d, p="", **o: office.parse_docx(d, **o))):
            self.register(p)

    def register(self, parser: Parser) -> None:
        for e in parser.extensions:
            self.by[e.lower().lstrip(".")] = parser

    def unregister(self, extension: str) -> bool:
        return self.by.pop(extension.lower().lstrip("."), None) is not None

    def extensions(self) -> list[str]:
        return sorted(self.by)

    def parsers(self) -> list[dict]:
        return [{"name": p.name, "extensions": sorted(e for e, q in self.by.items() if q is p)} for p in dict.fromkeys(self.by.values())]

    def parser_for(self, path: str) -> Parser:
        if path.startswith(("http://", "https://")):
            return self.by["html"]
        return self.by.get(path.rpartition(".")[2].lower(), self.by["txt"])

    def can_parse(self, path: Column) -> Column:
        return S.file_extension(path).isin(self.extensions())


CSV_PLUGIN = Parser("csv_table", ("csv", "tsv"), parse_csv)


def row(parser: Parser, path: str, data: bytes | None, size: int | None, options: dict, http: HttpClient | None = None) -> dict:
    """One result; whatever goes wrong becomes its error. An address without bytes is fetched."""
    base = {"success": False, "file_path": path, "file_type": parser.name, "file_size": size or 0, "text": "", "paragraphs": [], "tables": [], "images": [], "metadata": {}, "error": None}
    try:
        if data is None and http and path.startswith(("http://", "https://")):
            data = http.get(path)
            base["file_size"] = len(data)
        if data is None:
            raise FileNotFoundError("no such file")
        return base | parser.parse(data, path, **options) | {"success": True}
    except Exception as e:
        return base | {"error": f"{type(e).__name__}: {e}"}


def parse_files(files: DataFrame, registry: ParserRegistry | None = None, options: dict[str, dict] | None = None, path: str = "path", content: str = "content", keep: tuple[str, ...] = (), http: Callable[[], HttpClient] | None = HttpClient) -> DataFrame:
    """Results for rows with a path and bytes, such as those of ``read_files``. ``options`` are by parser name. Addresses
    without bytes are fetched by a client that ``http`` makes once for each task (None: they are failures)."""
    ship(files.sparkSession)
    registry, options = registry or ParserRegistry(), options or {}
    src = files.select(*keep, F.col(path).alias("_path"), F.col(content).cast("binary").alias("_content"))
    schema = "".join(f"{c} {files.schema[c].dataType.simpleString()}, " for c in keep) + RESULT
    texts = pa.list_(pa.string())
    kinds = {"success": pa.bool_(), "file_size": pa.int64(), "paragraphs": texts, "tables": pa.list_(pa.list_(texts)), "images": pa.list_(pa.struct([("src", pa.string()), ("alt", pa.string())])), "metadata": pa.map_(pa.string(), pa.string())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = http() if http else None
        for b in batches:
            out = []
            for p, data in zip(b.column("_path").to_pylist(), b.column("_content").to_pylist()):
                parser = registry.parser_for(p or "")
                out.append(row(parser, p, data, None if data is None else len(data), options.get(parser.name, {}), client))
            names = [x.split()[0] for x in ("success file_path file_type file_size text paragraphs tables images metadata error").split()]
            cols = [pa.array([list(r[n].items()) if n == "metadata" else r[n] for r in out], kinds.get(n, pa.string())) for n in names]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), *cols], [*keep, *names])

    return src.mapInArrow(run, schema)


def read_files(spark: SparkSession, path: str | list[str], pattern: str | None = None, recursive: bool = False) -> DataFrame:
    """path, content, length of files of a folder (of its folders only if ``recursive``)."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path).select("path", "content", "length")


def read_file_list(spark: SparkSession, path: str) -> DataFrame:
    """One path for each line that isn't blank."""
    return spark.read.text(path).select(S.strip(F.col("value")).alias("path")).where("path <> ''")


def read_json_records(spark: SparkSession, path: str) -> DataFrame:
    """A whole file with one object or a list of objects."""
    return spark.read.option("multiLine", True).json(path)


def read_csv(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """All columns as text; names and values stripped."""
    df = spark.read.option("header", True).option("sep", separator).option("multiLine", True).option("escape", '"').csv(path)
    return df.select(*[S.strip(F.col(f"`{c}`")).alias(c.strip()) for c in df.columns])


def pdf_pages(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """One row for each page: file_path (with #pageN), file_type, page_number, total_pages, text, error."""
    ship(files.sparkSession)
    schema = "file_path string, file_type string, page_number int, total_pages int, text string, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for p, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    texts, _ = office.pdf_pages(data)
                    out += [(f"{p}#page{i + 1}", "pdf_page", i + 1, len(texts), t, None) for i, t in enumerate(texts)]
                except Exception as e:
                    out.append((p, "pdf_page", None, None, None, f"{type(e).__name__}: {e}"))
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], k) for j, k in enumerate(kinds)], [x.split()[0] for x in schema.split(", ")])

    return files.select(F.col(path), F.col(content).cast("binary")).mapInArrow(run, schema)


def full_text() -> Column:
    return F.when(F.col("text") != "", F.col("text")).otherwise(F.array_join("paragraphs", "\n"))


def summary(results: DataFrame) -> DataFrame:
    """Counts in place of the lists."""
    n = lambda c: F.size(c).cast("long").alias(f"{c}_count")
    return results.select("success", "file_path", "file_type", "file_size", "text", n("paragraphs"), n("tables"), n("images"), "metadata", "error")


def preview(results: DataFrame) -> DataFrame:
    return results.select("file_path", F.length("text").alias("text_length"), F.slice("paragraphs", 1, 5).alias("paragraphs"), F.substring("text", 1, 2000).alias("text"))
