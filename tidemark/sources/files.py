"""Data files as Spark sees them: which can be read, and which schemas they have.

A file without a readable footer must not end an audit, and files of one dataset may differ in their
columns and types. Files are listed without their contents, footers are read by Spark's own jobs, and
files whose schemas cannot be merged are read as groups, each with its own schema.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CANNOT_MERGE = ("CANNOT_MERGE_SCHEMAS", "CANNOT_MERGE_INCOMPATIBLE_DATA_TYPE")


def list_files(spark: SparkSession, where: str) -> DataFrame:
    """file, bytes of every file that ``where`` (a glob) names; contents are not read. No such folder: no rows."""
    try:
        found = spark.read.format("binaryFile").load(where)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "file string, bytes long")
    return found.select(F.col("_metadata.file_path").alias("file"), F.col("length").alias("bytes"))


def _reader(spark: SparkSession):
    return spark.read.option("ignoreCorruptFiles", True)


def footer_rows(spark: SparkSession, where: str) -> DataFrame:
    """file, rows of every file with a readable footer and at least one row; no data page is read."""
    return _reader(spark).schema("episode_index long").parquet(where).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("rows"))


def _merged(spark: SparkSession, *where: str) -> StructType | None:
    """The schema of all footers together; None if they cannot be merged. Broken footers are passed over."""
    try:
        return _reader(spark).option("mergeSchema", True).parquet(*where).schema
    except AnalysisException as error:
        if error.getCondition() == "UNABLE_TO_INFER_SCHEMA":  # no file has a footer
            return StructType()
        raise
    except PySparkException as error:
        if any(c in str(error) for c in CANNOT_MERGE):
            return None
        raise
    except Exception as error:  # the gateway's own error class where the condition has no Python class
        if any(c in str(error) for c in CANNOT_MERGE):
            return None
        raise


def _together(one: StructType, two: StructType) -> StructType | None:
    """Both schemas' columns, or None if a column has two types."""
    types = {f.name: f.dataType for f in one}
    if any(types.get(f.name, f.dataType) != f.dataType for f in two):
        return None
    return StructType([*one, *(f for f in two if f.name not in types)])


def schema_groups(spark: SparkSession, where: str) -> list[tuple[StructType, list[str]]]:
    """(schema, paths) of the fewest groups found in which every column has one type.

    The usual dataset is one group, read by its glob after one job over the footers. Where footers do
    not merge, the sorted list of files is halved until they do, and parts that agree are put together
    again: as many jobs as there are changes of schema along the list, times the logarithm of the files.
    """
    whole = _merged(spark, where)
    if whole is not None:
        return [(whole, [where])] if len(whole) else []
    files = [r.file for r in list_files(spark, where).select("file").orderBy("file").collect()]  # names, only for such a dataset
    open_parts, found = [files], []
    while open_parts:
        part = open_parts.pop()
        schema = _merged(spark, *part)
        if schema is None:
            half = len(part) // 2
            open_parts += [part[half:], part[:half]]
        elif len(schema):
            found.append((schema, part))
    groups: list[tuple[StructType, list[str]]] = []
    for schema, part in found:
        for i, (own, paths) in enumerate(groups):
            if (both := _together(own, schema)) is not None:
                groups[i] = (both, paths + part)
                break
        else:
            groups.append((schema, part))
    return groups


def read_group(spark: SparkSession, schema: StructType, paths: list[str]) -> DataFrame:
    return _reader(spark).schema(schema).parquet(*paths)


def broken_files(spark: SparkSession, where: str, rows: DataFrame | None = None) -> DataFrame:
    """file, reason of the files that are not read or not to the end.

    'unreadable': no readable footer. With ``rows`` (a scan of the columns that are used, with the
    column ``file``) also 'incomplete': pages are broken, so the scan has fewer rows than the footer
    says; this reads all of these columns once. A file without rows is in neither.
    """
    listed, good = list_files(spark, where).filter("bytes > 0"), footer_rows(spark, where)
    bad = _without_footer(spark, listed.join(good, "file", "left_anti")).select("file", F.lit("unreadable").alias("reason"))
    if rows is None:
        return bad
    seen = F.max(F.xxhash64(*[c for c in rows.columns if c != "file"]))  # so that no column is pruned
    read = rows.groupBy("file").agg(F.count("*").alias("read"), seen.alias("seen"))
    short = good.join(read, "file", "left").filter(F.col("seen").isNull() | (F.col("read") < F.col("rows")))
    return bad.unionByName(short.select("file", F.lit("incomplete").alias("reason")))


def _without_footer(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Of files that gave no rows those that are broken and not just empty: their footers are tried one by one, as few are left."""
    bad = []
    for r in files.select("file").toLocalIterator():
        try:
            spark.read.parquet(r.file).schema
        except AnalysisException:
            bad.append((r.file,))
        except Exception as error:
            if "FAILED_READ_FILE" not in str(error) and "CANNOT_READ_FILE_FOOTER" not in str(error):
                raise
            bad.append((r.file,))
    return spark.createDataFrame(bad, "file string")
