"""What landed files are: a census of their footers, and an account of what was read.

One Spark job hands the bytes of each file to a task that decodes the Parquet footer, so the number
of jobs does not grow with the number of files. It is run where files of one folder disagree on types, or
where skips have to be counted. Files above ``LARGE`` bytes are not sent to
Python; Spark infers their schemas one at a time, of which there are few.
"""

from __future__ import annotations

import urllib.parse
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.session import materialize

LARGE = 256 << 20
CENSUS = "path string, length bigint, rows bigint, signature string, problem string"


def _footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows: dict[str, list] = {"rows": [], "signature": [], "problem": []}
        for content in b.column("content"):
            try:
                found = pq.read_metadata(pa.BufferReader(content.as_buffer()))
                columns = sorted(f"{c.path}:{c.physical_type}:{c.logical_type}" for c in map(found.schema.column, range(found.num_columns)))
                rows["rows"].append(found.num_rows)
                rows["signature"].append("\n".join(columns))
                rows["problem"].append(None)
            except (pa.ArrowException, OSError) as err:
                rows["rows"].append(None)
                rows["signature"].append(None)
                rows["problem"].append(str(err).split("\n")[0][:200] or type(err).__name__)
        yield pa.RecordBatch.from_arrays([
            b.column("path"), b.column("length"), pa.array(rows["rows"], pa.int64()),
            pa.array(rows["signature"], pa.string()), pa.array(rows["problem"], pa.string()),
        ], ["path", "length", "rows", "signature", "problem"])


def file_census(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """Each file below ``path``: length, rows, physical schema (name and types, sorted) or the problem with it.

    Stored, so later steps do not read the files again. A file too large for the census has neither.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    small = files.where(F.col("length") <= LARGE).select("path", "length", "content").mapInArrow(_footers, CENSUS)
    large = files.where(F.col("length") > LARGE).select(
        "path", "length", *[F.lit(None).cast(t).alias(c) for c, t in (("rows", "bigint"), ("signature", "string"), ("problem", "string"))]
    )
    found = materialize(small.unionByName(large), "census")
    listed = [(urllib.parse.unquote(p),) for p in files.inputFiles()]
    if len(listed) == found.count():
        return found
    # scans leave out files without any bytes; the listing has them
    empty = spark.createDataFrame(listed, "path string").select(same_path("path").alias("path")).join(
        found.select(same_path("path").alias("path")), "path", "left_anti"
    )
    return found.unionByName(empty.select("path", F.lit(0).cast("bigint").alias("length"), *[
        F.lit(v).cast(t).alias(c) for c, t, v in (("rows", "bigint", None), ("signature", "string", None), ("problem", "string", "no bytes"))
    ]))


def _fits(a: T.StructType, b: T.StructType) -> bool:
    types = {f.name: f.dataType for f in a.fields}
    return all(types.get(f.name, f.dataType) == f.dataType for f in b.fields)


def groups_by_schema(census: DataFrame, reader: DataFrameReader) -> list[tuple[T.StructType, list[str]]]:
    """Readable files as few (schema, files) groups, each without a conflict of types.

    Schemas that differ only in which columns are there share a group. One file of each physical
    schema is looked at by Spark, which knows its own types best.
    """
    kinds = census.where("problem IS NULL").groupBy(F.coalesce("signature", "path").alias("kind")).agg(
        F.sort_array(F.collect_list("path")).alias("files")
    ).orderBy("kind").collect()
    groups: list[tuple[T.StructType, list[str]]] = []
    for kind in kinds:
        try:
            schema = reader.parquet(kind.files[0]).schema
        except AnalysisException as err:
            if err.getCondition() != "UNABLE_TO_INFER_SCHEMA":
                raise
            continue  # too large for the census, and unreadable
        for k, (known, files) in enumerate(groups):
            if _fits(known, schema):
                names = set(known.names)
                groups[k] = (T.StructType(known.fields + [f for f in schema.fields if f.name not in names]), files + kind.files)
                break
        else:
            groups.append((schema, list(kind.files)))
    return groups


def same_path(column: str | Column) -> Column:
    """A file's path in one spelling, whether Spark gave it encoded as a URI or plain."""
    c = F.col(column) if isinstance(column, str) else column
    return F.regexp_replace(c, "^([A-Za-z0-9+.-]+:)/+", "$1/")


def source_file() -> Column:
    """The file a scanned row comes from, spelled as in the census."""
    encoded = F.col("_metadata.file_path")
    return same_path(F.url_decode(F.replace(encoded, F.lit("+"), F.lit("%2B"))))


def file_accounts(census: DataFrame, rows: DataFrame, file: str = "source_file") -> DataFrame:
    """Per file: rows its footer promises, rows that were read, and what became of it.

    ``read`` all rows came; ``partial`` some are missing, as tolerant scans leave a file
    at the first page they cannot decode; ``skipped`` no footer could be read. A file
    too large for the census is ``read`` if any row came. ``rows`` must be a stored copy: counted straight from
    the scan, no other column would be decoded and no damage found.
    """
    counted = rows.groupBy(F.col(file).alias("path")).agg(F.count("*").alias("rows_read"))
    listed = census.select(same_path("path").alias("path"), "length", F.col("rows").alias("rows_expected"), "problem")
    read = F.coalesce("rows_read", F.lit(0))
    whole = F.coalesce(read == F.col("rows_expected"), read > 0)
    status = F.when(F.col("problem").isNotNull(), "skipped").when(whole, "read").otherwise("partial")
    return listed.join(counted, "path", "left").select(
        "path", "length", "rows_expected", read.alias("rows_read"), status.alias("status"), "problem"
    )


def account_totals(accounts: DataFrame) -> DataFrame:
    """Files found, read, partly read and skipped, and rows read and lost, as one row."""
    lost = F.coalesce(F.col("rows_expected") - F.col("rows_read"), F.lit(0))
    return accounts.agg(
        F.count("*").alias("files_found"),
        *[F.count_if(F.col("status") == s).alias(f"files_{s}") for s in ("read", "partial", "skipped")],
        F.coalesce(F.sum("rows_read"), F.lit(0)).alias("rows_read"), F.coalesce(F.sum(lost), F.lit(0)).alias("rows_lost"),
    )
