"""Published versions of a dataset (S3, S4): readers see a whole version or the one before, never a mixture.

``splits.write_splits`` replaces partitions in place, so a reader may meet old and new splits side by
side, and a publication that dies half-way leaves both.  Here a publication writes its splits into a
folder of its own and then a manifest, one small file that names the folder of every split:

    data/v=<token>/split=<name>/...      written once, never changed
    manifests/<version>.json             version -> splits and their folders, schema, rows

The manifest is written under another name and renamed without overwriting, which is the moment of
publication; of two publishers that race for a version, one sees the rename fail.  It then takes the next
version if the two wrote different splits, and is refused with ``PublishConflict`` if they wrote the same.
Splits that a publication does not hold keep their folder, as with dynamic partition overwrite.  A reader
resolves the manifest once and reads fixed folders, so later publications do not change its result.
``vacuum`` removes what the kept versions do not name.

The rename is atomic on HDFS and on a local or shared POSIX folder.  On an object store without such a rename,
let one job publish at a time.  The driver holds one entry per split.
"""

from __future__ import annotations

import json
import re
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_NULL_SPLIT = "__HIVE_DEFAULT_PARTITION__"      # fixed value: Spark's folder name of a null partition


class PublishConflict(RuntimeError):
    """Another publication wrote the same splits first."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    """Published versions, oldest first."""
    return [int(n[:-5]) for n in _names(spark, f"{path}/manifests") if re.fullmatch(r"[0-9]{12}\.json", n)]


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """The manifest of a version (default: the latest)."""
    known = versions(spark, path)
    if version is None and not known:
        raise FileNotFoundError(f"nothing is published in {path}")
    version = known[-1] if version is None else version
    if version not in known:
        raise FileNotFoundError(f"{path} has no version {version}")
    fs, p = _fs(spark, f"{path}/manifests/{version:012d}.json")
    stream = fs.open(p)
    try:
        return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()


def _commit(spark: SparkSession, path: str, body: dict) -> bool:
    """Make ``body`` its version; False if that version is there already."""
    fs, tmp = _fs(spark, f"{path}/manifests/_{uuid.uuid4().hex}")
    out = fs.create(tmp, False)
    try:
        out.write(bytearray(json.dumps(body).encode()))
    finally:
        out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(f"{path}/manifests/{body['version']:012d}.json")
    context = hadoop.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    plain = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)       # without overwriting
    try:
        context.rename(fs.makeQualified(tmp), fs.makeQualified(target), plain)
        return True
    except Exception as e:  # noqa: BLE001 - the JVM's exception class is in its text
        fs.delete(tmp, False)
        if fs.exists(target):
            return False
        raise e


def publish(df: DataFrame, path: str, split_col: str = "split", replace_all: bool = False,
            base: int | None = None, max_records_per_file: int = 1_000_000) -> int:
    """Publish the splits of ``df`` as a new version and return its number.  Other splits stay as they
    are, or go with ``replace_all``.  ``base``: the version that ``df`` was made from (default: the latest
    when writing starts); a split that someone published after it is a conflict.  An empty ``df`` publishes
    a version without new splits.  All publications have the same columns."""
    spark = df.sparkSession
    before = versions(spark, path)
    base = base if base is not None else (before[-1] if before else 0)
    schema = StructType([f for f in df.schema.fields if f.name != split_col])
    token = uuid.uuid4().hex
    folder = f"data/v={token}"
    data = df.withColumn(split_col, F.col(split_col).cast("string"))
    (data.hint("rebalance", F.col(split_col)).write.option("maxRecordsPerFile", max_records_per_file)
     .partitionBy(split_col).parquet(f"{path}/{folder}"))
    made = {n.split("=", 1)[1]: f"{folder}/{n}" for n in _names(spark, f"{path}/{folder}") if "=" in n}
    while True:
        latest = versions(spark, path)
        last = manifest(spark, path, latest[-1]) if latest else {"version": 0, "splits": {}, "schema": None}
        if last["schema"] and _columns(last["schema"]) != _columns(schema.jsonValue()):
            raise ValueError(f"columns differ from those published: {_columns(schema.jsonValue())}")
        since = [manifest(spark, path, v) for v in latest if v > base]
        clash = sorted({s for m in since for s in m["written"] if replace_all or m["replaced_all"] or s in made})
        if clash:
            raise PublishConflict(f"published since version {base}: {clash}")
        body = {"version": last["version"] + 1, "written": sorted(made), "replaced_all": replace_all, "split_col": split_col,
                "schema": schema.jsonValue(), "splits": made if replace_all else {**last["splits"], **made}}
        if _commit(spark, path, body):
            return body["version"]


def _columns(schema: dict) -> list:
    return sorted((f["name"], json.dumps(f["type"], sort_keys=True)) for f in schema["fields"])


def read(spark: SparkSession, path: str, split: str | None = None, version: int | None = None) -> DataFrame:
    """One version (default: the latest), or one split of it; a split that it does not have gives no rows."""
    m = manifest(spark, path, version)
    schema = StructType.fromJson(m["schema"])
    whole = StructType(schema.fields).add(m["split_col"], "string")
    folders = [f for name, f in m["splits"].items() if split is None or _split_name(name) == split]
    if not folders:
        return spark.createDataFrame([], whole)
    # the folder of the publication is a partition column too, and is dropped
    rows = spark.read.schema(StructType(whole.fields).add("v", "string")).option("basePath", f"{path}/data")
    return rows.parquet(*[f"{path}/{f}" for f in folders]).drop("v")


def _split_name(folder: str) -> str | None:
    return None if folder == _NULL_SPLIT else unquote(folder)


def changed_splits(spark: SparkSession, path: str, after: int, upto: int | None = None) -> list[str | None]:
    """Splits whose rows differ between two versions (written again, added or removed)."""
    a, b = manifest(spark, path, after)["splits"], manifest(spark, path, upto)["splits"]
    return sorted({_split_name(s) for s in a.keys() | b.keys() if a.get(s) != b.get(s)}, key=lambda s: (s is not None, s))


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Remove all but the last ``keep`` versions and the data that only they or dead publications hold;
    returns the removed data folders.  Not while a publication is being written, nor while a reader uses an older version."""
    if keep < 1:
        raise ValueError("keep at least one version")
    known = versions(spark, path)
    used = {f for v in known[-keep:] for f in manifest(spark, path, v)["splits"].values()}
    for v in known[:-keep]:
        fs, p = _fs(spark, f"{path}/manifests/{v:012d}.json")
        fs.delete(p, False)
    removed = []
    for v in _names(spark, f"{path}/data"):
        for s in _names(spark, f"{path}/data/{v}"):
            if "=" in s and f"data/{v}/{s}" not in used:
                removed.append(f"data/{v}/{s}")
        if not any(u.startswith(f"data/{v}/") for u in used):
            removed.append(f"data/{v}")
    for r in removed:
        fs, p = _fs(spark, f"{path}/{r}")
        fs.delete(p, True)
    return removed
