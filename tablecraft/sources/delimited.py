"""Reading messy delimited files and writing results."""

from __future__ import annotations

import csv
import io
from collections import Counter
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tablecraft.functions.columns import col
from tablecraft.sources.typing import coerce_numbers, convert_dates, unique_names

# Texts read as missing, candidate delimiters, number syntax of delimited files.
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
DELIMITERS = (",", ";", "\t", "|", ":", " ")
CSV_NUMBER = r"^[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?$"
SNIFF_LINES = 100


def sniff_delimiter(lines: list[str]) -> str:
    """Comma if it splits the header; else the delimiter that splits all lines alike."""
    best, most = ",", 1
    for d in DELIMITERS:
        widths = Counter(len(r) for r in csv.reader(io.StringIO("\n".join(lines)), delimiter=d) if r)
        if not widths:
            continue
        width, agree = widths.most_common(1)[0]
        if d == "," and width > 1:
            return d
        if width > most and agree >= 0.9 * sum(widths.values()):
            best, most = d, width
    return best


def file_dialects(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """(file, encoding, delimiter, names) of every file below ``path`` that holds a line; no names without a header.

    Encodings are judged on all lines, delimiters on the first ``SNIFF_LINES`` of each file. These come from the file's
    first split, and each task passes on only so many lines of a file.
    """
    lines, place = spark.read.text(path), F.col("_metadata.file_path").alias("file")
    bad = lines.select(place, "value").groupBy("file").agg(F.count_if(~F.is_valid_utf8("value")).alias("bad"))
    first = lines.where(F.col("_metadata.file_block_start") == 0).select(place, F.col("value").cast("binary").alias("line"), F.monotonically_increasing_id().alias("at"))
    row = F.row_number().over(Window.partitionBy("file").orderBy("at"))
    heads = first.withColumn("row", row).where(F.col("row") <= SNIFF_LINES).groupBy("file").agg(F.sort_array(F.collect_list(F.struct("row", "line"))).alias("head"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, head, invalid in zip(*(batch[c].to_pylist() for c in ("file", "head", "bad"))):
                encoding = "ISO-8859-1" if invalid else "UTF-8"
                decoded = [x["line"].decode(encoding) for x in head]
                decoded[0] = decoded[0].lstrip("﻿")
                delimiter = sniff_delimiter(decoded)
                rows.append((unquote(file), encoding, delimiter, next(csv.reader(io.StringIO(decoded[0]), delimiter=delimiter), []) if header else []))
            kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["file", "encoding", "delimiter", "names"])

    return heads.join(bad, "file").mapInArrow(judge, "file string, encoding string, delimiter string, names array<string>")


def read_delimited(
    spark: SparkSession, path: str, header: bool = True, typed: bool = True, multiline: bool = False,
) -> DataFrame:
    """Read delimited text of unknown encoding, delimiter and types.

    Every file has its own dialect: bytes that are not UTF-8 make it be read as Latin-1, and its own header names its columns.
    Files of one dialect are one scan; the scans are joined by column names, missing columns are NULL and the
    columns of the file that comes first by path lead. Types are then judged on the whole. The driver holds one path per file,
    as Spark's own listing does. Files stay splittable unless ``multiline`` is set for quoted line breaks.
    """
    dialects = file_dialects(spark, path, header).groupBy("encoding", "delimiter", "names").agg(F.sort_array(F.collect_list("file")).alias("files")).collect()
    if not dialects:
        raise ValueError(f"{path} holds no lines")
    tables = []
    for dialect in sorted(dialects, key=lambda d: d["files"]):
        files = path if len(dialects) == 1 else [_literal(f) for f in dialect["files"]]
        tables.append(_read_alike(spark, files, dialect["delimiter"], dialect["encoding"], dialect["names"] if header else None, multiline))
    table = tables[0]
    for other in tables[1:]:
        table = table.unionByName(other, allowMissingColumns=True)
    table = table.select(*[F.when(~F.trim(col(c)).isin(*MISSING_TEXTS), col(c)).alias(c) for c in table.columns])
    return convert_dates(coerce_numbers(table, pattern=CSV_NUMBER)) if typed else table


def _literal(file: str) -> str:
    """A path whose letters are not read as a pattern."""
    return "".join(f"\\{x}" if x in "{}[]*?\\" else x for x in file)


def _read_alike(spark: SparkSession, files: str | list[str], delimiter: str, encoding: str, head: list[str] | None, multiline: bool) -> DataFrame:
    """Text columns of files that have the same delimiter, encoding and header."""
    reader = spark.read.options(sep=delimiter, encoding=encoding, header=head is not None, multiLine=multiline, quote='"', escape='"')
    table = reader.csv(files, inferSchema=False)
    if head is None:
        parts = [str(i) for i in range(len(table.columns))]
    else:
        parts = [p or f"Unnamed: {i}" for i, p in enumerate(head)]
    names = unique_names(parts[: len(table.columns)])
    names += [f"Unnamed: {i}" for i in range(len(names), len(table.columns))]
    return table.toDF(*names)


def write_delimited(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.mode("errorifexists").csv(path, header=header, quote='"', escape='"')


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path)
