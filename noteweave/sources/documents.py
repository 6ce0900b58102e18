"""Documents from files: format detection, decoding, page offsets and the need for text recognition.

Cases: an unknown format counts as text if its bytes are UTF-8, else as UNKNOWN; undecodable bytes fall back to a
single-byte encoding, which never fails; texts without a letter are EMPTY. Files without any byte aren't listed by the reader.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noteweave.functions.text import normalize_document

#: First bytes of formats, in hexadecimal.
MAGIC = {"PDF": "25504446", "PNG": "89504E47", "JPEG": "FFD8FF", "TIFF": "49492A00", "TIFF_BE": "4D4D002A", "GIF": "47494638", "ZIP": "504B0304", "BMP": "424D"}
#: Least characters of a document and of a page.
LEAST_DOCUMENT, LEAST_PAGE = 50, 20


def detect_format(content: Column, path: Column) -> Column:
    """By first bytes, then by suffix, then by whether the bytes are UTF-8."""
    head = F.hex(F.substring(content, 1, 12))
    out = F.when(F.length(content) == 0, "EMPTY").when(head.startswith("52494646") & (head.substr(17, 8) == "57454250"), "WEBP")
    for name, magic in MAGIC.items():
        out = out.when(head.startswith(magic), name.split("_")[0])
    low = F.lower(path)
    out = out.when(low.rlike(r"\.(txt|md|text)$"), "TEXT").when(low.rlike(r"\.(csv|tsv)$"), "TABLE").when(low.rlike(r"\.json$"), "JSON")
    return out.when(F.try_validate_utf8(content.cast("string")).isNotNull(), "TEXT").otherwise("UNKNOWN")


def decode_text(content: Column) -> Column:
    """UTF-8 if valid (without its byte-order mark), else a single-byte encoding."""
    utf8 = F.try_validate_utf8(content.cast("string"))
    return F.regexp_replace(F.coalesce(utf8, F.decode(content, "ISO-8859-1")), r"^\x{FEFF}", "")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, format, text, status) of files; only text formats are decoded."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").withColumn("format", detect_format(F.col("content"), F.col("path")))
    text = F.when(F.col("format").isin("TEXT", "TABLE", "JSON"), normalize_document(decode_text(F.col("content"))))
    return b.withColumn("text", text).select("path", "format", "text", F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, F.when(F.col("format").isin("PDF", "PNG", "JPEG", "TIFF", "GIF", "BMP", "WEBP"), "NEEDS_OCR").otherwise("EMPTY")).otherwise("READY").alias("status"))


def page_starts(pages: DataFrame) -> DataFrame:
    """Pages (document_id, page_no, text) with the place of their start in the joined text (two characters between pages)."""
    w = Window.partitionBy("document_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("start_char", F.coalesce(F.sum(F.length(F.coalesce("text", F.lit(""))) + 2).over(w), F.lit(0)))


def scan_status(pages: DataFrame) -> DataFrame:
    """(document_id, status): NEEDS_OCR if every page has an image and hardly any text, INSUFFICIENT_TEXT if short, else READY."""
    n = F.length(F.trim(F.coalesce("text", F.lit(""))))
    g = pages.groupBy("document_id").agg(F.sum(n).alias("chars"), F.min((F.coalesce("has_image", F.lit(False)) & (n < LEAST_PAGE)).cast("int")).alias("scanned"))
    return g.select("document_id", F.when((F.col("scanned") == 1) & (F.col("chars") < LEAST_DOCUMENT), "NEEDS_OCR").when(F.col("chars") < LEAST_DOCUMENT, "INSUFFICIENT_TEXT").otherwise("READY").alias("status"))


def reading_order(boxes: DataFrame) -> DataFrame:
    """(page_id, text, confidence) of recognised boxes (page_id, x, y, text, confidence): top to bottom, left to right.

    A page's boxes make one text; a page without confidences counts as 0.85.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "text"))), lambda b: b["text"])
    return boxes.groupBy("page_id").agg(F.array_join(ordered, "\n").alias("text"), F.round(F.coalesce(F.avg("confidence"), F.lit(0.85)), 4).alias("confidence"))
