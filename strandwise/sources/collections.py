"""Collections of JSON arrays and landed feeds in, index documents and appended tables out."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strandwise.session import cut


def read_collection(spark: SparkSession, folder: str, schema: StructType | str, strict: bool = True) -> DataFrame:
    """All `*.json` arrays of a folder, with `_file` to order by; a malformed file fails unless `strict` is off.

    Only a list of records or one record per file is accepted. An empty folder gives no rows.
    """
    reader = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST" if strict else "DROPMALFORMED").option("pathGlobFilter", "*.json")
    return reader.json(folder).select("*", F.col("_metadata.file_path").alias("_file"))


def read_atom_entries(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Entries of landed Atom feeds."""
    return spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files: `(path, text)`."""
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def form_sections(body: Column) -> Column:
    """Map of heading to text of a form body with `### heading` sections; the last of equal headings counts."""
    parts = F.filter(F.split(F.concat(F.lit("\n"), F.coalesce(body, F.lit(""))), r"\n###[ \t]+"), lambda p, i: i > 0)
    entry = F.transform(parts, lambda p: F.struct(F.trim(F.split(p, "\n", 2)[0]).alias("k"), F.trim(F.coalesce(F.try_element_at(F.split(p, "\n", 2), F.lit(2)), F.lit("")), F.lit(" \n\r\t")).alias("v")))
    # maps refuse repeated keys: keep the last entry of each
    last = F.filter(entry, lambda e, i: ~F.exists(F.slice(entry, i + 2, F.size(entry)), lambda x: x["k"] == e["k"]))
    return F.map_from_entries(last)


def _place(spark: SparkSession, path: str):
    """The folder or file on whatever file system its address names, and that file system."""
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(sc._jsc.hadoopConfiguration())


def write_index(parts: dict[str, DataFrame], path: str, order: Sequence[str] = ("id",)) -> None:
    """One JSON document with a sorted list per part, ASCII, indented; records are written as they arrive, so none of it is held."""
    spark = next(iter(parts.values())).sparkSession
    where, system = _place(spark, path)
    out = system.create(where, True)
    try:
        out.write(b"{")
        for i, (name, df) in enumerate(parts.items()):
            out.write(f"{',' if i else ''}\n  {json.dumps(name)}: [".encode())
            n = 0
            for r in df.orderBy(*[c for c in order if c in df.columns]).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator():
                body = json.dumps(json.loads(r.j), indent=2, ensure_ascii=True).replace("\n", "\n    ")
                out.write(f"{',' if n else ''}\n    {body}".encode())
                n += 1
            out.write(b"\n  ]" if n else b"]")
        out.write(b"\n}\n")
    finally:
        out.close()


def append_unique(spark: SparkSession, new: DataFrame, path: str, key: Column, order: Sequence[str] = ()) -> int:
    """Append the rows of `new` whose key is not stored yet, the first of equal keys by `order`; returns how many.

    Rows without a key are all kept. Nothing is written for none. Any file system will do.
    """
    keyed = new.withColumn("_key", key)
    names = list(new.columns)
    by = F.struct(*order, *names) if order else F.struct(*names)
    first = keyed.where(F.col("_key").isNotNull()).groupBy("_key").agg(F.min_by(F.struct(*names), by).alias("r"))
    where, system = _place(spark, path)
    if system.exists(where):
        stored = spark.read.parquet(path).select(key.alias("_key")).distinct()
        first = first.join(stored, "_key", "left_anti")
    # the table it is compared with is the one it is appended to
    fresh = cut(first.select("r.*").unionByName(keyed.where(F.col("_key").isNull()).drop("_key")))
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    return n
