"""Tables of whole versions: files are written first, and one rename of a small manifest makes them visible.

    root/rows/date=2024-01-05/version=3f…/part-….parquet    never changed once written
    root/manifests/000000000012.json                        schema, live folders, tag

Readers take the folders of the newest manifest (or an older one), so they never see half of a write, and
a writer that is lost anywhere leaves the last version as it was.  Two writers that start from the same version
cannot both publish: the second one gets ``Conflict`` and starts again.  ``vacuum`` removes superseded files
after a grace period.  A manifest holds one name per folder, not per row or file.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.operators import dedupe
from tickloom.session import pin

#: Digits of a manifest's number.
DIGITS = 12


class Conflict(RuntimeError):
    """Another writer has published this version."""


def _files(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(root).getFileSystem(spark._jsc.hadoopConfiguration()), path


def versions(spark: SparkSession, root: str) -> list[int]:
    fs, path = _files(spark, root)
    folder = path(f"{root}/manifests")
    names = [st.getPath().getName() for st in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict | None:
    """Schema, live folders and tag of a version (the newest one by default), or nothing where there is none."""
    known = versions(spark, root)
    if not known:
        return None
    version = known[-1] if version is None else version
    row = spark.read.text(f"{root}/manifests/{version:0{DIGITS}d}.json", wholetext=True).first()
    return json.loads(row.value) | {"version": version}


def read(spark: SparkSession, root: str, version: int | None = None, parts: list[str] | None = None) -> DataFrame:
    """The rows of a version; ``parts`` names the only partition folders that are wanted ("date=2024-01-05")."""
    m = manifest(spark, root, version)
    if m is None:
        raise FileNotFoundError(f"nothing is published below {root}")
    schema = T.StructType.fromJson(m["schema"])
    live = [f for f in m["folders"] if parts is None or f.split("/")[0] in parts]
    if not live:
        return spark.createDataFrame([], schema)
    whole = T.StructType([*schema.fields, T.StructField("version", T.StringType())])
    return spark.read.schema(whole).option("basePath", f"{root}/rows").parquet(*[f"{root}/rows/{f}" for f in live]).select(*schema.names)


def publish(df: DataFrame, root: str, by: str | None = None, order: list[str] = (), tag: int | None = None) -> int:
    """Replace the partitions of ``by`` that ``df`` holds (all rows without ``by``); returns the new version's number.

    Nothing that readers see changes before the last step.  Rows with a null ``by`` are a partition of their own.
    An empty ``df`` replaces no partition (without ``by``: leaves no row).  ``tag`` is kept in the manifest, such as
    the number of a stream's batch.
    """
    spark = df.sparkSession
    base = manifest(spark, root) or {"version": 0, "folders": []}
    name = uuid.uuid4().hex
    out = df.withColumn("version", F.lit(name))
    if order:
        out = out.repartitionByRange(*order).sortWithinPartitions(*order)
    out.write.mode("append").partitionBy(*([by] if by else []), "version").parquet(f"{root}/rows")
    fs, path = _files(spark, root)
    found = fs.globStatus(path(f"{root}/rows/{'*/' if by else ''}version={name}")) or []
    new = ["/".join(x for x in (st.getPath().getParent().getName() if by else "", st.getPath().getName()) if x) for st in found]
    replaced = {f.split("/")[0] for f in new}
    kept = [f for f in base["folders"] if by and f.split("/")[0] not in replaced]
    _announce(spark, root, base["version"] + 1, {"schema": json.loads(df.schema.json()), "folders": sorted(kept + new), "tag": tag})
    return base["version"] + 1


def _announce(spark: SparkSession, root: str, version: int, content: dict) -> None:
    """Write the manifest aside and rename it to its number; fails if that number is taken."""
    fs, path = _files(spark, root)
    fs.mkdirs(path(f"{root}/manifests"))
    aside, final = path(f"{root}/manifests/.{uuid.uuid4().hex}"), path(f"{root}/manifests/{version:0{DIGITS}d}.json")
    stream = fs.create(aside)
    stream.write(bytearray(json.dumps(content).encode()))
    stream.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    context = hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    if fs.exists(final):
        fs.delete(aside, False)
        raise Conflict(f"version {version} of {root} is taken")
    try:
        context.rename(fs.makeQualified(aside), fs.makeQualified(final), spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0))
    except Exception as e:
        if fs.exists(final) and fs.exists(aside):
            fs.delete(aside, False)
            raise Conflict(f"version {version} of {root} is taken") from e
        raise


def merge(new: DataFrame, root: str, by: str, keys: list[str], order: list[str], tag: int | None = None) -> int:
    """Upsert: of rows with equal ``keys`` the last in ``order`` stays.  Only partitions that ``new`` touches are read and written.

    ``by`` must follow from ``keys`` (a day from a time).  ``new`` is pinned, so that its touched partitions and its rows agree.
    """
    spark = new.sparkSession
    new = pin(new)
    if manifest(spark, root):
        name = F.concat(F.lit(f"{by}="), F.coalesce(F.col(by).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")))
        parts = [r[0] for r in new.select(name).distinct().collect()]
        new = read(spark, root, parts=parts).select(*new.columns).unionByName(new)
    return publish(dedupe.keep(new, keys, order, last=True), root, by, [by, *keys], tag)


def last_tag(spark: SparkSession, root: str) -> int | None:
    return (manifest(spark, root) or {}).get("tag")


def vacuum(spark: SparkSession, root: str, keep: int = 2, grace: float = 3600) -> list[str]:
    """Remove manifests but the newest ``keep``, and folders that no manifest left names, if older than ``grace`` seconds.

    The grace period covers readers of an old version and writers that have not published yet.
    """
    fs, path = _files(spark, root)
    before = (time.time() - grace) * 1000
    for v in versions(spark, root)[:-keep]:
        old = path(f"{root}/manifests/{v:0{DIGITS}d}.json")
        if fs.getFileStatus(old).getModificationTime() <= before:
            fs.delete(old, False)
    live = {f for v in versions(spark, root) for f in manifest(spark, root, v)["folders"]}
    gone = []
    for pattern in ("version=*", "*/version=*"):
        for st in fs.globStatus(path(f"{root}/rows/{pattern}")) or []:
            p = st.getPath()
            name = f"{p.getParent().getName()}/{p.getName()}" if pattern[0] == "*" else p.getName()
            if name not in live and st.getModificationTime() <= before:
                fs.delete(p, True)
                gone.append(name)
    return sorted(gone)
