"""Source files: manifest, checksums, typed CSV and Parquet tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import closing

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions.session import stage

#: Files of more bytes are hashed by parts, so that no task holds or reads more of a file than one part.
PART_BYTES = 128 << 20
#: What a task holds of a part at a time
_READ_BYTES = 4 << 20
# Problems named in an error text, which also says how many there are
LISTED = 50


def _listed(named: Sequence[str], found: DataFrame) -> str:
    rest = found.count() - len(named) if len(named) == LISTED else 0
    return "; ".join(named) + (f"; and {rest} more" if rest else "")


def _below(spark: SparkSession, folder: str) -> int:
    """Where the path below ``folder`` begins in the path of a file that Spark lists there."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    store = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return len(store.getFileStatus(root).getPath().toString().rstrip("/")) + 2


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(file, stem, bytes) of what lies in the folder itself; a table that is a folder of part files is one file of all their bytes.

    ``pattern`` is for the names in the folder, not for those of part files. Contents are not read: the column is pruned
    from the scan.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.substring_index(F.substring("path", _below(spark, folder), 1 << 20), "/", 1)
    wanted = spark.sparkContext._jvm.org.apache.hadoop.fs.GlobPattern(pattern).compiled().pattern()
    whole = files.groupBy(name.alias("file")).agg(F.sum("length").alias("bytes")).where(F.col("file").rlike(f"^(?:{wanted})$"))
    return whole.select("file", F.lower(F.regexp_extract("file", r"^([^.]+)", 1)).alias("stem"), "bytes")


def manifest_check(files: DataFrame, expected: Mapping[str, str]) -> DataFrame:
    """One row per problem: unknown file, missing concept, several files for one concept.

    ``expected`` maps lower-case file stems to concept names. Empty when the folder is complete.
    """
    spark = files.sparkSession
    known = spark.createDataFrame(list(expected.items()), "stem string, concept string")
    concepts = known.select("concept").distinct()
    unknown = files.join(F.broadcast(known), "stem", "left_anti").select(
        F.lit("unknown file").alias("problem"), F.col("file").alias("name")
    )
    found = files.join(F.broadcast(known), "stem").groupBy("concept").agg(F.count(F.lit(1)).alias("n"))
    missing = concepts.join(found, "concept", "left_anti").select(
        F.lit("missing concept").alias("problem"), F.col("concept").alias("name")
    )
    twice = found.where("n > 1").select(
        F.lit("several files for concept").alias("problem"), F.col("concept").alias("name")
    )
    return unknown.unionByName(missing).unionByName(twice)


def require_manifest(files: DataFrame, expected: Mapping[str, str]) -> None:
    """Error listing the problems of an incomplete folder."""
    wrong = manifest_check(files, expected)
    bad = wrong.limit(LISTED).collect()
    if bad:
        raise ValueError(_listed([f"{r['problem']}: {r['name']}" for r in bad], wrong))


def open_path(path: str):
    """Seekable input of a URI on any file system that pyarrow knows; the default opener of :func:`checksums`."""
    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    store, inside = fs.FileSystem.from_uri(f"file://{'/' + rest.lstrip('/')}" if scheme == "file" else path)
    return store.open_input_file(inside)


def _part_digests(opener: Callable) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def digest(path: str, start: int, size: int) -> str:
        state, left = hashlib.sha256(), size
        with closing(opener(path)) as source:
            source.seek(start)
            while left:
                block = source.read(min(left, _READ_BYTES))
                if not block:
                    raise OSError(f"{path} ends {left} bytes before its listed size")
                state.update(block)
                left -= len(block)
        return state.hexdigest()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [digest(*at) for at in zip(b["path"], b["start"], b["size"])]
            yield b.assign(digest=found)[["path", "file", "bytes", "part", "digest"]]

    return run


def checksums(
    spark: SparkSession, folder: str, pattern: str = "*", part_bytes: int = PART_BYTES, opener: Callable = open_path
) -> DataFrame:
    """(file, bytes, sha256) of every file of a folder and the folders in it; the tasks read and hash.

    ``file`` is the path below ``folder``, so equal names in two of its folders stay apart. Parts of ``part_bytes`` are
    dealt over the tasks, and a task streams through a part, so files of any size need the same memory. A file of one
    part has its plain SHA-256. A longer one has ``tree-<part_bytes>:`` and the SHA-256 of the lines of its part digests
    in order, which depends on the bytes and the part size alone, not on the tasks. Spark's scan
    leaves empty files out, so a recorded file that is emptied is ``gone``. A file shorter than listed is an error.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    below = _below(spark, folder)
    listed = stage(files.load(folder).select("path", F.col("length").alias("bytes")), "listing")
    name = F.substring("path", below, 1 << 20).alias("file")
    last = F.greatest(F.ceil(F.col("bytes") / F.lit(part_bytes)).cast("long") - 1, F.lit(0).cast("long"))
    parts = listed.select("path", name, "bytes", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("part"))
    start = F.col("part") * F.lit(part_bytes).cast("long")
    ranges = parts.withColumn("start", start).withColumn("size", F.least(F.lit(part_bytes).cast("long"), F.col("bytes") - start))
    # Round robin: the parts of one large file go to all tasks.
    dealt = ranges.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    hashed = dealt.mapInPandas(_part_digests(opener), "path string, file string, bytes long, part long, digest string")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("part", "digest"))), lambda t: t["digest"])
    whole = F.concat(F.lit(f"tree-{part_bytes}:"), F.sha2(F.array_join(in_order, "\n"), 256))
    grouped = hashed.groupBy("path", "file", "bytes").agg(in_order.alias("_d"), whole.alias("_tree"))
    return grouped.select("file", "bytes", F.when(F.size("_d") == 1, F.col("_d")[0]).otherwise(F.col("_tree")).alias("sha256"))


def row_checksums(df: DataFrame) -> DataFrame:
    """Order-free digest per source file for files of any size: row count and sum of row hashes."""
    row = F.xxhash64(*df.columns)
    return (
        df.select(F.input_file_name().alias("_f"), row.cast("decimal(38,0)").alias("_h"))
        .groupBy("_f")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.sum("_h").cast("string").alias("row_digest"))
        .select(F.element_at(F.split("_f", "/"), -1).alias("file"), F.col("_f").alias("path"), "n_rows", "row_digest")
    )


def verify_checksums(current: DataFrame, recorded: DataFrame) -> DataFrame:
    """Current files against a recorded manifest: ok, changed, not recorded, gone or not verified (no digest recorded).

    Tree digests of other part sizes are not comparable: record and check with the same ``part_bytes``.
    """
    now = current.select("file", "bytes", "sha256", F.lit(True).alias("here"))
    old = recorded.select(
        "file", F.col("bytes").alias("old_bytes"), F.col("sha256").alias("old_sha256"), F.lit(True).alias("known")
    )
    same = (F.col("bytes") == F.col("old_bytes")) & (F.col("sha256") == F.col("old_sha256"))
    status = (
        F.when(F.col("known").isNull(), "not recorded")
        .when(F.col("here").isNull(), "gone")
        .when(F.col("sha256").isNull() | F.col("old_sha256").isNull(), "not verified")
        .when(same, "ok")
        .otherwise("changed")
    )
    return now.join(old, "file", "full").select("file", "bytes", "sha256", status.alias("status"))


def check_or_record(current: DataFrame, path: str) -> DataFrame:
    """First run writes the manifest at ``path``; later runs compare with it and fail on a difference.

    The digests are written out first, so every file is read once per run.
    """
    spark = current.sparkSession
    current = stage(current, "digests")
    schema = "file string, bytes bigint, sha256 string"
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path):
        current.write.json(path)
    checked = stage(verify_checksums(current, spark.read.schema(schema).json(path)), "checked")
    wrong = checked.where(F.col("status") != "ok")
    bad = wrong.limit(LISTED).collect()
    if bad:
        raise ValueError(_listed([f"{r['file']}: {r['status']}" for r in bad], wrong))
    return checked


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with header and declared types; a row that does not fit the schema is an error."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def overwrite_table(df: DataFrame, path: str, partition: Sequence[str] = ()) -> DataFrame:
    """Replace a stored table and return it as read back."""
    writer = df.write.mode("overwrite")
    if partition:
        writer = writer.partitionBy(*partition)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_predictions(scored: DataFrame, path: str) -> None:
    """Scored rows, one folder per cutoff so that a reader of one cutoff opens only its files."""
    scored.write.mode("overwrite").partitionBy("cutoff").parquet(path)


def read_predictions(spark: SparkSession, path: str, cutoff: int) -> DataFrame:
    return spark.read.parquet(path).where(F.col("cutoff") == cutoff)


POLICY_SCHEMA = "cutoff int, rung string, threshold double, validate_cost double, params map<string,double>"


def write_policy(policy: DataFrame, path: str) -> None:
    policy.write.mode("overwrite").json(path)


def read_policy(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(POLICY_SCHEMA).json(path)


def sample_rows(df: DataFrame, key: Sequence[str], n: int, seed: int) -> DataFrame:
    """Exactly ``n`` rows in digest order of their key: the same sample on every run."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))
    return df.orderBy(digest, *key).limit(n)
