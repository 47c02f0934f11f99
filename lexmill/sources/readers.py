"""Sources: JSON, dumps, directories, texts, HTML, registries.

Schemas are declared, never inferred; dirty fields are coalesced after the read."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import first_given
from .json_arrays import json_arrays

CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"


def table(spark: SparkSession, sf_dir: str, name: str, columns: Sequence[str] = ()) -> DataFrame:
    """A Parquet table; only named columns are read."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def json_document(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """S3: a JSON document or array per file; unreadable files give null rows, which drop out."""
    df = spark.read.schema(schema).json(path, multiLine=True, mode="PERMISSIVE")
    return df.dropna(how="all")


def files_of(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(path, first character that isn't blank) of the files at a path or pattern; none if there is nothing."""
    jvm = spark.sparkContext._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    fs = there.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    out = []
    for top in fs.globStatus(there) or ():
        for f in fs.listStatus(top.getPath()) if top.isDirectory() else (top,):
            if f.isFile() and not f.getPath().getName().startswith(("_", ".")):
                stream = fs.open(f.getPath())
                head = ""
                while not head.strip() and (c := stream.read()) >= 0:
                    head = chr(c)
                stream.close()
                out.append((f.getPath().toString(), head.strip()))
    return out


def json_first(spark: SparkSession, paths: Sequence[str], schema: StructType | str) -> DataFrame:
    """S3: the documents of the first path that has any, the local one before the object store's; none gives no rows."""
    for path in paths:
        if files_of(spark, path):
            return json_document(spark, path, schema)
    return spark.createDataFrame([], schema)


def bulk_dump(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """.json (arrays, each read by many tasks; a file that isn't one is read by lines), .ndjson/.jsonl (bad lines skipped) or .csv with a header."""
    if path.endswith(".csv"):
        return spark.read.schema(schema).csv(path, header=True)
    lines = lambda paths: spark.read.schema(schema).json(paths, mode="DROPMALFORMED")
    if path.endswith((".ndjson", ".jsonl")):
        return lines(path)
    if not path.endswith(".json"):
        raise ValueError(f"neither JSON nor CSV: {path}")
    return json_arrays(spark, path, schema)


def batch_directory(spark: SparkSession, pattern: str, record_schema: StructType) -> DataFrame:
    """Batch files, each an array or an object with ``records``; ordered by file name in column ``source_file``."""
    arr = spark.read.text(pattern, wholetext=True).withColumn("source_file", F.input_file_name())
    kind = f"array<{record_schema.simpleString()}>"
    listed = F.when(F.startswith(F.ltrim("value"), F.lit("[")), F.col("value")).otherwise(F.get_json_object("value", "$.records"))
    items = F.from_json(listed, kind)
    return arr.select("source_file", F.inline(items))


def state_metadata(spark: SparkSession, pattern: str, law_schema: StructType) -> DataFrame:
    """One file per state: {state, laws: [..]}."""
    schema = f"state string, laws array<{law_schema.simpleString()}>"
    return spark.read.schema(schema).json(pattern, multiLine=True).select("state", F.inline("laws"))


def text_files(spark: SparkSession, pattern: str, least: int = 100, separator: str | None = None) -> DataFrame:
    """(path, text): invalid UTF-8 and control characters dropped, short texts left out. A file is one text, or with a ``separator`` a pack of texts parted by it, which many
    tasks read: millions of texts needn't be millions of files."""
    if separator is None:
        rows = spark.read.format("binaryFile").load(pattern).select("path", F.col("content").alias("raw"))
    else:
        rows = spark.read.text(pattern, lineSep=separator).select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("raw"))
    return clean_texts(rows.select("path", drop_invalid(F.col("raw")).alias("text")), "text", least)


def drop_invalid(raw: Column) -> Column:
    """Bytes as text without those that aren't UTF-8. Replacement characters that stand in the bytes are kept: they are written otherwise while invalid bytes become such."""
    text, lit = raw.cast("string"), F.lit
    aside = F.replace(F.replace(text, lit("\ufdd0"), lit("\ufdd0a")), lit("\ufffd"), lit("\ufdd0b"))
    valid = F.replace(F.make_valid_utf8(aside), lit("\ufffd"), lit(""))
    back = F.replace(F.replace(valid, lit("\ufdd0b"), lit("\ufffd")), lit("\ufdd0a"), lit("\ufdd0"))
    return F.when(F.is_valid_utf8(text), text).otherwise(back)


def clean_texts(rows: DataFrame, text: str, least: int = 100) -> DataFrame:
    return rows.withColumn(text, F.regexp_replace(text, CONTROL, "")).where(F.length(F.trim(text)) >= least)


class _Links(HTMLParser):
    def __init__(self):
        super().__init__()
        self.links, self.headings, self._in, self._heading = [], [], None, ""

    def handle_starttag(self, tag, attrs):
        if tag == "a" and dict(attrs).get("href"):
            self._in = [dict(attrs)["href"], ""]
        elif tag in ("h1", "h2", "h3"):
            self._heading = None

    def handle_data(self, data):
        if self._in:
            self._in[1] += data
        elif self._heading is None:
            self._heading = data.strip()

    def handle_endtag(self, tag):
        if tag == "a" and self._in:
            self.links.append((self._heading or "", *self._in))
            self._in = None


def html_links(pages: DataFrame, id_: str, html: str) -> DataFrame:
    """(id, position, heading, href, label) of links, each under the heading above it."""
    kind = pages.schema[id_].dataType.simpleString()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, text in zip(batch[id_], batch[html], strict=True):
                parser = _Links()
                parser.feed(text or "")
                rows += [(i, n, h, href, " ".join(label.split())) for n, (h, href, label) in enumerate(parser.links)]
            yield pd.DataFrame(rows, columns=[id_, "position", "heading", "href", "label"])

    return pages.select(id_, html).mapInPandas(read, f"{id_} {kind}, position int, heading string, href string, label string")


def hrefs(pages: DataFrame, id_: str, html: str) -> DataFrame:
    """S10 by pattern: (id, href), quoted values only; stays in the JVM."""
    return pages.select(F.col(id_), F.explode(F.regexp_extract_all(html, F.lit(r'<a href="([^"]*)"'), 1)).alias("href"))


def page_text(pages: DataFrame, id_: str, html: str) -> DataFrame:
    """Text of a page without scripts, styles, comments and tags."""
    bare = F.regexp_replace(html, r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    return pages.select(F.col(id_), F.trim(F.regexp_replace(F.regexp_replace(bare, "<[^>]*>", " "), r"\s+", " ")).alias("text"))


def canonical(rows: DataFrame, fields: Mapping[str, Sequence[str]], required: str = "name") -> DataFrame:
    """The first spelling of each field that is given; rows without ``required`` drop out."""
    there = set(rows.columns)
    made = {k: [F.col(c).cast("string") for c in cs if c in there] for k, cs in fields.items()}
    return rows.select(*[(first_given(*cs) if cs else F.lit(None).cast("string")).alias(k) for k, cs in made.items()]).where(F.col(required).isNotNull())


def registry(rows: DataFrame, **wanted) -> DataFrame:
    """Registry rows by priority, tier, category, status or id."""
    for k, v in wanted.items():
        rows = rows.where(F.col(k) == v)
    return rows
