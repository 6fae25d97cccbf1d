"""Folder normalise job (S-1 .. S-3, S-14, F-6, L-5, K-2, A-9).

List every object below a root (``binaryFile``, recursive), skip folder
markers and the output folder itself, infer each file's format from its
extension (fallback: the declared format, else JSON), parse it with the
parser of that format, and write the canonical JSON documents with their
output keys. Files are spread over tasks; there is no shuffle except the
optional ``limit`` (first n paths, a top-n) and the summary.

Differences kept on purpose: the output key keeps the relative path
(``a/x.csv`` -> ``a/x.json``), so ``a/x.csv`` and ``b/x.xml`` no longer
overwrite each other; a file that does not parse is quarantined instead of
aborting the folder. Parquet files are read by the native reader (one
summary row per file) rather than through the per-document path.

Formats are told apart by the listing alone (``_metadata``), so a parser opens its own files only. Text files beyond
``WHOLE_BYTES`` are never held whole: they are read line by line, and their document is given in pieces, one row a line,
which make the document when joined in the order of (``block``, ``line``). JSON files of that size that hold a value a line
are not one document, and are rejected by their lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fablake.sources import parsers as prs
from fablake.sources.formats import format_from_key, resolve_format


def list_objects(spark: SparkSession, root: str, with_content: bool = True) -> DataFrame:
    """S-1 / S-2: recursive listing; ``content`` is pruned when not selected."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return df if with_content else df.select("path", "length", "modificationTime")


def existing(listing: DataFrame, keys: DataFrame, key_col: str = "path") -> tuple[DataFrame, DataFrame]:
    """S-3 for many keys: (present, missing) via semi / anti join on the listing."""
    paths = listing.select(F.col("path").alias(key_col))
    return keys.join(paths, key_col, "left_semi"), keys.join(paths, key_col, "left_anti")


def exists_flag(listing: DataFrame, keys: DataFrame, key_col: str = "path") -> DataFrame:
    """S-3 as a column: every requested key with ``exists``."""
    paths = listing.select(F.col("path").alias(key_col)).withColumn("_hit", F.lit(True))
    return keys.join(paths, key_col, "left").withColumn("exists", F.coalesce("_hit", F.lit(False))).drop("_hit")


#: Text and JSON files larger than this are read line by line.
WHOLE_BYTES = 16 << 20
_BREAK = "\\n"  # a line break inside JSON text


def _lines(spark: SparkSession, root: str, wanted: Column) -> DataFrame:
    """(path, size, block, line, value) of the files that ``wanted``, over ``path`` and ``size``, takes; line breaks are \\n alone."""
    df = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(root)
    df = df.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"),
                   F.col("_metadata.file_block_start").alias("block"))
    return df.filter(wanted).withColumn("line", F.monotonically_increasing_id())


def _of_lines(lines: DataFrame) -> DataFrame:
    """Per file: valid UTF-8, bytes of its lines with a break each, where its last line is, whether its first line that is not
    blank is a JSON value by itself, and how many are not blank."""
    at = F.struct("block", "line")
    full = F.trim(F.col("value"), F.lit(" \t\r")) != ""
    return lines.groupBy("path").agg(
        F.bool_and(F.is_valid_utf8("value")).alias("valid"), F.sum(F.octet_length("value") + F.lit(1).cast("long")).alias("bytes"),
        F.max(at).alias("last"), F.min(at).alias("first"), F.count_if(full).alias("n_full"),
        F.min_by(F.when(full, F.substring("value", 1, WHOLE_BYTES)), F.when(full, at)).alias("head"))


def _large_texts(lines: DataFrame) -> DataFrame:
    """The documents of large text files, one row a line; a file that is not UTF-8 gives one row with its reject."""
    at = F.struct("block", "line")
    each = lines.join(F.broadcast(_of_lines(lines).drop("head", "n_full")), "path")
    text = F.to_json(F.struct(F.col("value").alias("text")))  # {"text":"..."}
    ends = (at == F.col("last")) & (F.col("bytes") != F.col("size")) & (F.col("bytes") != F.col("size") - 3)  # no break at the end
    doc = F.concat(
        F.when(at == F.col("first"), F.concat(F.lit('{"text":"'), F.when(F.col("size") - F.col("bytes") >= 2, "\ufeff").otherwise(""))).otherwise(""),
        F.substring(text, F.lit(10), F.length(text) - 11), F.when(ends, "").otherwise(_BREAK), F.when(at == F.col("last"), '"}').otherwise(""))
    return each.filter(F.col("valid") | (at == F.col("first"))).select(
        "path", F.when(F.col("valid"), doc).alias("doc"), F.when(~F.col("valid"), F.lit("not valid UTF-8 text")).alias("reject"), "block", "line")


def normalise_folder(spark: SparkSession, root: str, out_prefix: str, declared: str | None = None,
                     limit: int | None = None) -> DataFrame:
    """Returns (path, rel_path, format, output_key, doc, reject, block, line) for every listed file; large text files
    have a row for each piece of their document, all others one row with block and line 0."""
    root_path = root.rstrip("/").split("://")[-1].replace("'", "")
    out_rel = out_prefix.strip("/")
    fallback = F.lit(declared) if declared else None

    def described(df: DataFrame) -> DataFrame:
        # key relative to the root: the listing holds full URIs (file:/..., s3a://...)
        df = df.withColumn("rel_path", F.expr(f"substring(path, instr(path, '{root_path}') + {len(root_path) + 1})"))
        fmt = resolve_format(F.lit(None).cast("string"), format_from_key(F.col("rel_path"), fallback))
        return df.withColumn("format", fmt).filter(~F.col("rel_path").endswith("/") & ~F.col("rel_path").startswith(out_rel + "/"))

    # of the listing, not of the files: a filter on these columns keeps files from being opened
    files = described(list_objects(spark, root).select(
        "content", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")))
    if limit is not None:
        files = files.join(F.broadcast(files.orderBy("rel_path").limit(limit).select("path")), "path", "left_semi")
    # file names only: the large files
    large = {f: [r.path for r in files.filter((F.col("format") == f) & (F.col("size") > WHOLE_BYTES)).select("path").collect()]
             for f in ("TEXT", "JSON")}
    by_line = None
    if large["TEXT"]:
        by_line = _large_texts(_lines(spark, root, F.col("path").isin(large["TEXT"])))
    if large["JSON"]:
        seen = _of_lines(_lines(spark, root, F.col("path").isin(large["JSON"])))
        # a first line that is a whole value, and more behind it: several documents; other files are parsed whole
        verdict = prs.parse_json(seen.withColumn("content", F.col("head").cast("binary"))).filter(
            ~F.col("valid") | ((F.col("n_full") > 1) & F.col("reject").isNull()))
        refused = verdict.select("path", F.when(~F.col("valid"), "not valid UTF-8").otherwise("not valid JSON").alias("reject")).collect()
        large["JSON"] = [r.path for r in refused]
        rows = spark.createDataFrame([(r.path, None, r.reject, 0, 0) for r in refused], "path string, doc string, reject string, block long, line long")
        by_line = rows if by_line is None else by_line.unionByName(rows)
    apart = large["TEXT"] + large["JSON"]
    if apart:
        files = files.filter(~F.col("path").isin(apart))
    parquet = files.filter(F.col("format") == "PARQUET").select("path", "rel_path", "format")
    others = prs.parse_by_format(files.filter(F.col("format") != "PARQUET"), "format")
    docs = others.select("path", "rel_path", "format", "doc", "reject")
    if parquet.limit(1).count():
        paths = [r.path for r in parquet.select("path").collect()]  # file names only
        stats = prs.read_parquet_files(spark, paths)
        pq = parquet.join(stats.withColumnRenamed("file_path", "path"), "path", "left").select(
            "path", "rel_path", "format",
            F.when(F.col("row_count").isNotNull(), F.to_json(F.struct(
                F.split("columns", ",").alias("columns"), F.col("row_count").alias("row_count")))).alias("doc"),
            F.when(F.col("row_count").isNull(), F.lit("Request body is not valid Parquet")).alias("reject"),
        )
        docs = docs.unionByName(pq)
    docs = docs.withColumns({"block": F.lit(0).cast("long"), "line": F.lit(0).cast("long")})
    if by_line is not None:
        docs = docs.unionByName(described(by_line).select(*docs.columns))
    stem = F.regexp_replace("rel_path", r"\.[^./]*$", "")
    return docs.withColumn("output_key", F.concat(F.lit(out_rel + "/"), stem, F.lit(".json")))


def write_normalised(docs: DataFrame, out_root: str) -> None:
    """K-2: canonical documents as JSON lines, one row per input file, or per piece of a large one."""
    docs.filter(F.col("doc").isNotNull()).select("output_key", "doc", "block", "line").write.mode("overwrite").json(out_root)


def summary(docs: DataFrame) -> DataFrame:
    """A-9: count of written keys (the keys themselves stay a DataFrame)."""
    return docs.agg(
        F.count_distinct(F.when(F.col("doc").isNotNull(), F.col("path"))).alias("written"),
        F.count_distinct(F.when(F.col("doc").isNull(), F.col("path"))).alias("rejected"),
    )
