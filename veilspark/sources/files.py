"""Loaders: binary files to documents, by extension; text and HTML here, office files by their readers, other formats through registered loaders."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.sources.office import read_docx, read_pptx, read_xlsx

DOCUMENT = "file_path string, file_name string, file_type string, ordinal int, text string"
#: Encodings in the order they are tried.
ENCODINGS = ["utf-8", "cp932", "euc-jp", "utf-16"]


def decode(raw: bytes, first: str | None = None) -> str:
    for encoding in ([first] if first else []) + ENCODINGS:
        try:
            return raw.decode(encoding)
        except (UnicodeDecodeError, LookupError):
            continue
    return raw.decode("utf-8", "replace")


class _Text(HTMLParser):
    SKIP = ("script", "style", "noscript", "template")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.skipped = [], 0

    def handle_starttag(self, tag, attrs):  # noqa: ARG002
        self.skipped += tag in self.SKIP

    def handle_endtag(self, tag):
        self.skipped -= tag in self.SKIP and self.skipped > 0

    def handle_data(self, data):
        if not self.skipped and data.strip():
            self.parts.append(" ".join(data.split()))


def html_text(page: str) -> str:
    """All text of a page, one line for each piece between tags."""
    parser = _Text()
    parser.feed(page)
    parser.close()
    return "\n".join(parser.parts)


def _plain(raw: bytes) -> list[str]:
    return [decode(raw)]


def _html(raw: bytes) -> list[str]:
    return [html_text(decode(raw))]


#: Extension to loader: bytes to the texts of its pages, sheets or sections.
LOADERS: dict[str, Callable[[bytes], list[str]]] = {"txt": _plain, "md": _plain, "html": _html, "htm": _html, "xml": _html, "docx": read_docx, "xlsx": read_xlsx, "pptx": read_pptx}


def load(spark: SparkSession, path: str | list[str], loaders: dict[str, Callable[[bytes], list[str]]] | None = None) -> DataFrame:
    """Documents of all files under ``path``. An extension without a loader is an error, as is a path without files; all text is NFKC."""
    known = LOADERS | {k.lower().lstrip("."): f for k, f in (loaders or {}).items()}
    try:
        files = spark.read.format("binaryFile").load(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(str(path)) from e
        raise
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))

    def run(batches):
        for batch in batches:
            out = []
            for place, ext, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if ext not in known:
                    raise ValueError(f"no loader for .{ext}: {place}")
                for k, text in enumerate(known[ext](raw)):
                    out.append((place, place.rsplit("/", 1)[-1], ext, k, unicodedata.normalize("NFKC", text)))
            columns = list(zip(*out)) if out else [[]] * 5
            types = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["file_path", "file_name", "file_type", "ordinal", "text"])

    return files.select("path", kind.alias("kind"), "content").mapInArrow(run, DOCUMENT)


def chunks(documents: DataFrame) -> DataFrame:
    """Split documents by their type's splitter; chunk_index runs over a file's documents in order."""
    from pyspark.sql import Window

    from veilspark.functions.prepare import split_text

    cut = documents.select("file_path", "ordinal", F.posexplode(split_text(F.col("file_type"), F.col("text"))).alias("k", "text"))
    w = Window.partitionBy("file_path").orderBy("ordinal", "k")
    return cut.select("file_path", (F.row_number().over(w) - 1).alias("chunk_index"), "text")


def joined(chunked: DataFrame) -> DataFrame:
    """One text for each file: its chunks in order, a blank line between them."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"])
    return chunked.groupBy("file_path").agg(F.concat_ws("\n\n", parts).alias("text"))


def clean_cells(cells: DataFrame) -> DataFrame:
    """Sheets of cells (sheet, row, col, value; row 0 the header) as compact Markdown tables: sheet, text.

    Unnamed headers become Col_n, numbers are shortened to eight digits, line ends become spaces, and rows and
    columns without any value go.
    """
    value = F.trim(F.regexp_replace(F.coalesce("value", F.lit("")), "[\r\n]+", " "))
    number = F.regexp_replace(F.format_string("%.8g", value.try_cast("double")), r"\.?0+$", "")
    value = F.when(value.rlike(r"^-?\d+\.\d+$"), number).otherwise(F.replace(value, F.lit("|"), F.lit("/")))
    c = cells.withColumn("value", F.when((F.col("row") == 0) & (value.startswith("Unnamed:") | (value == "")), F.concat(F.lit("Col_"), F.col("col") + 1)).otherwise(value))
    body = c.where("row > 0 and value <> ''")
    c = c.join(body.select("sheet", "col").distinct(), ["sheet", "col"], "left_semi")
    c = c.join(body.select("sheet", "row").distinct().unionByName(c.where("row = 0").select("sheet", "row").distinct()), ["sheet", "row"], "left_semi")
    line = F.concat(F.lit("| "), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "value"))), lambda x: x["value"]), " | "), F.lit(" |"))
    rows = c.groupBy("sheet", "row").agg(line.alias("line"), F.count(F.lit(1)).alias("n"))
    ruler = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.col("n")))
    rows = rows.withColumn("line", F.when(F.col("row") == 0, F.concat("line", F.lit("\n"), ruler)).otherwise(F.col("line")))
    return rows.groupBy("sheet").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\n").alias("text"))


def slide_text(shapes: DataFrame) -> DataFrame:
    """Slides from shapes (slide, top, left, width, text): read in bands of 8000 units from the top, then from the left."""
    band = F.round(F.col("top") / 8000) * 8000
    key = F.struct(band.alias("b"), (F.col("left") / F.greatest("width", F.lit(1))).alias("l"), "text")
    return shapes.groupBy("slide").agg(F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda x: x["text"]), "\n").alias("text"))


def kb_chunks(stored: DataFrame) -> DataFrame:
    """Chunks of a knowledge-base document: the stored ones that are not blank, else its whole content."""
    kept = F.filter(F.coalesce("chunks", F.array().cast("array<string>")), lambda c: F.trim(c) != "")
    return stored.withColumn("chunks", F.when(F.size(kept) > 0, kept).otherwise(F.array(F.coalesce("content", F.lit("")))))


def sample(spark: SparkSession) -> DataFrame:
    """A small text with variant spellings, for trying things out."""
    lines = ["株式会社アルファの佐伯です。", "ALPHA と Alpha は同じ会社です。", "連絡先は saeki@alpha.example.jp まで。"]
    return spark.createDataFrame([("sample", "\n".join(lines))], "part_id string, text string")


def one_line_cells(df: DataFrame) -> DataFrame:
    """White space runs in texts, line ends too, become one space."""
    return df.select(*[F.trim(F.regexp_replace(F.col(c), r"(?U)\s+", " ")).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def write_rows(df: DataFrame, path: str) -> None:
    """CSV or JSON by the extension of ``path``; every CSV file begins with a byte order mark, before its header."""
    flat = one_line_cells(df)
    if not path.endswith(".csv"):
        flat.write.mode("overwrite").json(path)
        return
    mark = [F.col(c).alias(("\ufeff" if k == 0 else "") + c) for k, c in enumerate(flat.columns)]
    flat.select(*mark).write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def with_colours(spans: DataFrame, colours: dict[str, str], default: str = "#dcdcdc") -> DataFrame:
    """Spans with the ``colour`` of their ``label``, whatever its case; labels without one have ``default``."""
    rows = [(k.upper(), v) for k, v in colours.items()]
    table = F.broadcast(spans.sparkSession.createDataFrame(rows, "_label string, colour string"))  # the caller's few colours
    out = spans.join(table, F.upper("label") == F.col("_label"), "left").drop("_label")
    return out.withColumn("colour", F.coalesce("colour", F.lit(default)))


def display_data(parts: DataFrame, spans: DataFrame) -> DataFrame:
    """A row for each part: text, ents (start, end, label in order of place, without those that overlap an earlier one)."""
    fields = "array<struct<start:int,end:int,label:string>>"
    ents = F.array_sort(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "label"))).cast(fields)
    step = lambda s, x: F.when(x["start"] >= s["at"], F.struct(x["end"].alias("at"), F.concat(s["out"], F.array(x)).alias("out"))).otherwise(s)
    kept = F.aggregate("e", F.struct(F.lit(0).alias("at"), F.array().cast(fields).alias("out")), step, lambda s: s["out"])
    each = spans.groupBy("part_id").agg(ents.alias("e")).select("part_id", kept.alias("ents"))
    return parts.select("part_id", "text").join(each, "part_id", "left").withColumn("ents", F.coalesce("ents", F.array().cast(fields)))
