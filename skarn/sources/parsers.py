"""Readers of text formats as DataFrame expressions."""

from __future__ import annotations

import re
from itertools import islice

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.scalars import clean_xml


def html_title(html: Column) -> Column:
    return F.regexp_extract(html, "<title>(.*?)</title>", 1)


def html_links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit('<li><a href="([^"]*)"'), F.lit(1))


def html_table(pages: DataFrame, html: str) -> DataFrame:
    """The rows of the first table of each page, as arrays of cell texts (row 0: the header)."""
    first = F.regexp_extract(html, "(?is)<table[^>]*>(.*?)</table>", 1)
    rows = F.regexp_extract_all(first, F.lit("(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cells = lambda r: F.transform(F.regexp_extract_all(r, F.lit("(?is)<t[hd][^>]*>(.*?)</t[hd]>"), F.lit(1)), lambda c: F.trim(F.regexp_replace(c, "<[^>]+>", "")))
    return pages.select("*", F.posexplode(F.transform(rows, cells)).alias("row", "cells")).drop(html)


def parse_news(editions: DataFrame, text: str) -> DataFrame:
    """``## category`` / ``### title`` / URL, Summary (optional), Tags of markdown editions."""
    category = lambda part: F.trim(F.regexp_extract(part, "^([^\\n]*)", 1))
    found = F.split("__part", "(?m)^### ")
    entries = F.slice(found, F.lit(2), F.greatest(F.size(found) - 1, F.lit(0)))
    parts = editions.select("*", F.explode(F.split(text, "(?m)^## ")).alias("__part")).filter(F.trim("__part") != "")
    items = parts.select(category(F.col("__part")).alias("category"), F.explode(entries).alias("__item"))
    value = lambda name: F.regexp_extract("__item", f"(?m)^{name}: *(.*)$", 1)
    some = lambda c: F.when(c != "", c)
    return items.select("category", category(F.col("__item")).alias("title"), some(value("URL")).alias("url"), some(value("Summary")).alias("summary"), some(value("Tags")).alias("tags"))


def date_columns(columns: list[str]) -> list[str]:
    """The columns whose names are dates; their first and last are min and max."""
    found = [c for c in columns if re.fullmatch(r"\d{4}-\d{2}-\d{2}", c)]
    if not found:
        raise ValueError("no date columns")
    return found


def unpivot_dates(wide: DataFrame, key: str) -> DataFrame:
    return wide.unpivot([key], date_columns(wide.columns), "date", "value").filter(F.col("value").isNotNull())


def read_rdf(spark, path: str, tag: str = "rdf:Description") -> DataFrame:
    """Records (about, types[], arity, label, genls[]) of an RDF/XML file."""
    schema = (
        "`_rdf:about` string, `rdf:type` array<struct<`_rdf:resource`:string>>, arity int, label string, genls array<struct<`_rdf:resource`:string>>"
    )
    rows = spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    names = lambda c: F.coalesce(F.transform(c, lambda x: F.element_at(F.split(x["_rdf:resource"], "[#/]"), -1)), F.array().cast("array<string>"))
    return rows.select(
        F.element_at(F.split("`_rdf:about`", "[#/]"), -1).alias("about"), names(F.col("`rdf:type`")).alias("types"), "arity", clean_xml(F.col("label")).alias("label"), names(F.col("genls")).alias("genls")
    )


def read_rdf_zip(spark, path: str, limit: int | None = None, tag: str = "Description") -> DataFrame:
    """Records (about, types[], arity, label, genls[]) of RDF/XML files in ZIP archives.

    Elements are streamed in the task that unpacks the archive; ``limit`` stops
    after so many records of an archive.
    """
    import zipfile
    from io import BytesIO
    from xml.etree.ElementTree import iterparse

    names = ["about", "types", "arity", "label", "genls"]
    local = lambda name: re.split("[}#/]", name)[-1]

    def records(content: bytes):
        with zipfile.ZipFile(BytesIO(content)) as archive:
            for member in archive.namelist():
                with archive.open(member) as stream:
                    for _, element in iterparse(stream):
                        if local(element.tag) != tag:
                            continue
                        about = next((v for k, v in element.attrib.items() if local(k) == "about"), "")
                        linked = {"type": [], "genls": []}
                        texts = {}
                        for child in element:
                            resource = next((v for k, v in child.attrib.items() if local(k) == "resource"), None)
                            if local(child.tag) in linked and resource is not None:
                                linked[local(child.tag)].append(local(resource))
                            else:
                                texts[local(child.tag)] = (child.text or "").strip()
                        arity = texts.get("arity", "")
                        yield local(about), linked["type"], int(arity) if arity.isdigit() else None, texts.get("label"), linked["genls"]
                        element.clear()

    def run(batches):
        for batch in batches:
            for content in batch.column(0).to_pylist():
                rows = list(islice(records(content), limit))
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], arrow)

    schema = "about string, types array<string>, arity int, label string, genls array<string>"
    arrow = to_arrow_schema(T._parse_datatype_string(schema))
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def csv_text_rows(texts: DataFrame, text: str) -> DataFrame:
    """One row per data line of CSV texts, as a map from the text's own header.

    Lines are cut at commas and values trimmed; missing values are empty.
    """
    lines = F.split(F.regexp_replace(text, r"^\s+|\s+$|\r", ""), "\n")
    cells = lambda line: F.transform(F.split(line, ","), lambda c: F.trim(c))
    rows = texts.withColumn("__h", cells(F.element_at(lines, 1))).withColumn("__l", lines)
    rows = rows.select("*", F.posexplode(F.slice("__l", F.lit(2), F.greatest(F.size("__l") - 1, F.lit(0)))).alias("line", "__v"))
    value = lambda name, i: F.struct(name.alias("k"), F.coalesce(F.get(cells(F.col("__v")), i), F.lit("")).alias("v"))
    return rows.withColumn("row", F.map_from_entries(F.transform("__h", value))).drop("__h", "__l", "__v", text)


def read_ontology(spark, path: str):
    """predicates, genls, types of a JSON index; empty ones where there is no file."""
    from ..plans.logic import Ontology

    schema = "predicates map<string,struct<arity:int,label:string>>, genls map<string,array<string>>, types map<string,array<string>>"
    try:
        row = spark.read.schema(schema).option("multiLine", True).json(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        row = spark.createDataFrame([], schema)
    predicates = row.select(F.explode("predicates").alias("name", "p")).select("name", "p.arity", "p.label")
    pairs = lambda c, a, b: row.select(F.explode(c).alias(a, "l")).select(a, F.explode("l").alias(b))
    return Ontology(predicates, pairs("genls", "sub", "sup"), pairs("types", "ind", "coll"))


def write_ontology(index, path: str) -> None:
    """The JSON index again: one row of three maps."""
    entries = lambda df, k, v: df.groupBy(k).agg(F.array_sort(F.collect_set(v)).alias("l")).agg(F.map_from_entries(F.collect_list(F.struct(k, "l"))).alias("m"))
    p = index.predicates.agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct("arity", "label")))).alias("predicates"))
    out = p.crossJoin(entries(index.genls, "sub", "sup").withColumnRenamed("m", "genls")).crossJoin(entries(index.types, "ind", "coll").withColumnRenamed("m", "types"))
    out.coalesce(1).write.mode("overwrite").json(path)
