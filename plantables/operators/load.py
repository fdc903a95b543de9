"""Sources and loads: merges, upserts, quarantine, packing, verified files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plantables.sources.scratch import written

#: The two page marks.
PAGE_MARKS = (r"<!-- PDF_PAGE ([0-9]+) -->", r"--- Page ([0-9]+) ---")


def split_pages(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, text) -> doc_id, part, page_no, text, by the first kind of mark that the text has.

    What stands before the first mark is a part without a number, if it isn't
    empty. Without marks, parts are cut at lines of "---" and have no number.
    """
    t = F.col(text)
    kind = F.when(t.rlike(PAGE_MARKS[0]), PAGE_MARKS[0]).when(t.rlike(PAGE_MARKS[1]), PAGE_MARKS[1])
    cut = F.split(t, F.coalesce(kind, F.lit(r"(?m)^---$\n?")))
    numbers = F.when(kind.isNotNull(), F.regexp_extract_all(t, kind, F.lit(1)))
    each = docs.select("doc_id", kind.alias("kind"), numbers.alias("numbers"), F.posexplode(cut).alias("part", "text"))
    page = F.when(F.col("part") > 0, F.get("numbers", F.col("part") - 1).cast("int"))
    return each.select("doc_id", "part", page.alias("page_no"), F.btrim("text", F.lit("\n")).alias("text")).filter("page_no is not null or text <> ''")


def read_page_text(spark: SparkSession, path: str) -> DataFrame:
    """A folder of marked text files -> pages; the file's path is the document."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("text"))
    return split_pages(files)


TRUTH_ROW = "struct<code:string,name_th:string,name_en:string,credits:string,year:int,semester:int,category:string,type:string,prerequisite:string,flexible_year_semester:string,note:string>"


def read_truth(files: DataFrame) -> DataFrame:
    """(path, text) of JSON: a list of rows, an object that holds one, or a map from code to row -> rows with their path."""
    listed = F.from_json("text", f"array<{TRUTH_ROW}>")
    held = F.from_json("text", ", ".join(f"{k}:array<{TRUTH_ROW}>" for k in ("courses", "data", "items", "records", "rows")).join(("struct<", ">")))
    mapped = F.map_entries(F.from_json("text", f"map<string,{TRUTH_ROW}>"))
    first = F.when(F.ltrim("text").startswith("["), listed).otherwise(
        F.coalesce(held["courses"], held["data"], held["items"], held["records"], held["rows"], F.transform(mapped, lambda e: e["value"].withField("code", F.coalesce(e["value"]["code"], e["key"]))))
    )
    return files.select("path", F.posexplode(first).alias("ordinal", "row")).select("path", "ordinal", "row.*")


def merge_first(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of the rows of a key the first in order."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("__n", n).filter("__n = 1").drop("__n")


def upsert(rows: DataFrame, key: list[str], ordinal: str) -> DataFrame:
    """The last row of each key wins."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(ordinal)))
    return rows.withColumn("__n", n).filter("__n = 1").drop("__n")


def merge_sources(rows: DataFrame, key: list[str], order: list[str], source: str) -> DataFrame:
    """S3: merge_first() with `sources`, those of all rows of the key in their own order."""
    listed = rows.groupBy(*key).agg(F.array_sort(F.collect_set(source)).alias("sources"))
    return merge_first(rows, key, order).join(listed, key)


def replace_programs(old: DataFrame, new: DataFrame, program: list[str], key: list[str], ordinal: str) -> DataFrame:
    """Plan or slot rows after a load: a program that is loaded again has only its new rows, the last of each key."""
    return old.join(new.select(*program).distinct(), program, "left_anti").unionByName(upsert(new, key, ordinal))


def insert_if_absent(old: DataFrame, new: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """What is added, and the new rows whose key is there already."""
    held = old.select(*key).distinct()
    return new.join(held, key, "left_anti"), new.join(held, key, "left_semi")


def quarantine(rows: DataFrame, rules: dict[str, Column], key: list[str], parent: DataFrame | None = None, on: str = "code", allow_orphan: bool = False) -> tuple[DataFrame, DataFrame]:
    """Good rows, and bad ones with the names of the rules they break; "unique" and "foreign key" are among them.

    A rule holds unless it is false; null passes, as in SQL.
    """
    n = F.count("*").over(Window.partitionBy(*key))
    checked = rows.withColumn("__n", n)
    if parent is not None:
        known = parent.select(on).distinct().withColumn("__known", F.lit(True))
        checked = checked.join(known, on, "left")
    else:
        checked = checked.withColumn("__known", F.lit(True))
    broken = [F.when(~c, name) for name, c in rules.items()] + [F.when(F.col("__n") > 1, "unique")]
    if not allow_orphan:
        broken.append(F.when(F.col("__known").isNull(), "foreign key"))
    marked = checked.withColumn("reasons", F.array_compact(F.array(*broken))).drop("__n", "__known")
    return marked.filter(F.size("reasons") == 0).drop("reasons"), marked.filter(F.size("reasons") > 0)


def verified(files: DataFrame, registry: DataFrame) -> DataFrame:
    """files(path, content) whose SHA-256 is the registered one; back slashes in registered paths are slashes."""
    wanted = registry.select(F.replace("path", F.lit("\\"), F.lit("/")).alias("path"), F.lower("sha256").alias("sha256"))
    return files.withColumn("sha256", F.sha2(F.col("content").cast("binary"), 256)).join(wanted, ["path", "sha256"])


def read_files(spark: SparkSession, path: str, root: str = "") -> DataFrame:
    """Files below a folder, each read whole -> (path, content, sha256); path is relative to root, or else to the folder."""
    scheme = r"^[a-z0-9]+:(//[^/]*)?(?=/)"
    base = re.sub(scheme, "", (root or path).rstrip("/") + "/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    short = F.substring_index(F.regexp_replace("path", scheme, ""), base, -1)
    return files.select(short.alias("path"), "content", F.sha2("content", 256).alias("sha256"))


def verified_files(files: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """read_files() against a registry (path, sha256): files with the registered hash and their text, and (path, reason) of the registered ones that differ or are missing.

    Hashes are taken in the executors, which read the files; no content
    passes the driver. Back slashes in registered paths are slashes.
    """
    wanted = registry.select(F.replace("path", F.lit("\\"), F.lit("/")).alias("path"), F.lower("sha256").alias("wanted"))
    good = files.join(wanted, "path").filter("sha256 = wanted").select("path", "sha256", F.decode("content", "utf-8").alias("text"))
    joined = wanted.join(files.select("path", "sha256"), "path", "left")
    bad = joined.filter("sha256 is null or sha256 <> wanted").select("path", F.when(F.col("sha256").isNull(), "missing").otherwise("differs").alias("reason"))
    return good, bad


def load_programs(new: DataFrame, path: str, program: list[str], key: list[str], ordinal: str) -> None:
    """Plan or slot rows into a table on files that is partitioned by program: a program that is loaded has only its new rows, the last of each key.

    Files of other programs aren't touched: only partitions with new rows are
    put in place, by the commit of one job, when all rows are written. The
    same load again gives the same rows.
    """
    upsert(new, key, ordinal).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*program).parquet(path)


def load_upsert(new: DataFrame, path: str, program: list[str], key: list[str], ordinal: str) -> None:
    """Rows into a table on files by key: the last row of each key wins, new ones over those in place.

    Only partitions that the new rows have are read, and written anew from a
    scratch table, as a job can't read what it replaces.
    """
    spark = new.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    rows = new.withColumn("__new", F.lit(1))
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        old = spark.read.schema(new.schema).parquet(path)
        rows = rows.unionByName(old.join(F.broadcast(new.select(*program).distinct()), program, "left_semi").withColumn("__new", F.lit(0)))
    n = F.row_number().over(Window.partitionBy(*program, *key).orderBy(F.desc("__new"), F.desc(ordinal)))
    kept = written(rows.withColumn("__n", n).filter("__n = 1").drop("__n", "__new"), "load")
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*program).parquet(path)


def nested_report(parts: dict[str, DataFrame], by: list[str]) -> DataFrame:
    """Tables of checks, scores and samples -> one row for each program (by), with each table's rows of it as a list of structs, sorted.

    What is put in is summaries and limited samples, so a program's lists are
    short. A program that a table lacks has an empty list.
    """
    out = None
    for name, df in parts.items():
        fields = [c for c in df.columns if c not in by]
        each = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
        out = each if out is None else out.join(each, by, "full_outer")
    return out.select(*by, *(F.coalesce(name, F.array().cast(out.schema[name].dataType)).alias(name) for name in parts))


def manifest(inputs: dict[str, DataFrame], by: list[str]) -> DataFrame:
    """(by, input, n_rows, mark) of the tables that a conversion read: mark is the sum of 32 bits of each row's SHA-256, so it doesn't depend on the order."""
    out = None
    for name, df in inputs.items():
        text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in df.columns))
        part = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
        each = df.groupBy(*by).agg(F.count("*").alias("n_rows"), F.sum(part).alias("mark")).withColumn("input", F.lit(name))
        out = each if out is None else out.unionByName(each)
    return out.select(*by, "input", "n_rows", "mark")


def write_reports(report: DataFrame, listed: DataFrame, path: str, by: list[str]) -> None:
    """Reports as JSON under path/report, one file for each program, then the manifest under path/manifest. Programs that aren't in the report keep theirs."""
    report.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).json(f"{path}/report")
    listed.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).json(f"{path}/manifest")


def read_reports(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """What write_reports() wrote under path/report or path/manifest, with the columns of `like`."""
    return spark.read.schema(like.schema).json(path).select(*like.columns)


def pack_records(rows: DataFrame, by: list[str], fields: list[str], order: list[str]) -> DataFrame:
    """All rows of a group as one JSON array, in order; groups are single answers, so small."""
    records = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.struct(*fields).alias("__record")))), lambda x: x["__record"])
    return rows.groupBy(*by).agg(F.to_json(records, {"ignoreNullFields": "false"}).alias("records"), F.count("*").alias("n"))
