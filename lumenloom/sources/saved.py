"""Saved documents by the day of saving, their removal by age, and copied logo files.

A document is never changed in place: each save appends a version, which readers see when the whole write has been committed, so a write
that fails leaves the old one. The newest version of an id is the document. Days are partitions: reading what is recent opens no older
file, and whole old days are removed as folders.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenloom.functions import labels
from lumenloom.sources.scratch import written

DAY, AT = "saved_on", "saved_at"
#: A copy of this size or more isn't put into a document; a bigger file than MOST_BYTES is no logo.
MAX_EMBEDDED_BYTES, MOST_BYTES = 100 * 1024, 2_000_000
# Names of copied logos in addresses and files.
COPIED = r"^/api/v1/guides/([A-Za-z0-9_-]+)/logos/([1-5])\.(svg|png)$"
LOGO_FILE = r"([A-Za-z0-9_-]+)-([1-5])\.(svg|png)$"


def save(docs: DataFrame, path: str, now: datetime) -> None:
    """Appends documents (id and more columns) as saved at `now` (UTC). Of one id in docs twice either row counts, so ids must be unique."""
    docs.withColumns({AT: F.lit(now.isoformat(sep=" ")).cast("timestamp"), DAY: F.lit(now.date().isoformat()).cast("date")}).write.mode("append").partitionBy(DAY).parquet(path)


def _versions(spark: SparkSession, path: str) -> DataFrame | None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not there.exists(folder) or not any(f.isDirectory() for f in there.listStatus(folder)):
        return None
    return spark.read.parquet(path)


def newest(versions: DataFrame) -> DataFrame:
    """The last version of each id: a grouped maximum of the time, combined before the shuffle, that meets its rows."""
    rest = [c for c in versions.columns if c not in ("id", AT, DAY)]
    return versions.groupBy("id").agg(F.max_by(F.struct(AT, *rest), AT).alias("d")).select("id", "d.*")


def load(spark: SparkSession, path: str) -> DataFrame | None:
    """id, saved_at and the documents' columns; None where nothing was saved yet."""
    found = _versions(spark, path)
    return None if found is None else newest(found)


def saved_since(spark: SparkSession, path: str, hours: float, now: datetime) -> DataFrame | None:
    """Documents last saved within `hours` before now; days before aren't opened."""
    found, cut = _versions(spark, path), now - timedelta(hours=hours)
    if found is None:
        return None
    return newest(found.where((F.col(DAY) >= F.lit(cut.date().isoformat()).cast("date")) & (F.col(AT) >= F.lit(cut.isoformat(sep=" ")).cast("timestamp"))))


def remove_older_than(spark: SparkSession, path: str, days: float, now: datetime) -> int:
    """Removes versions saved more than `days` before now; returns how many documents are gone with them.

    Days wholly before that are removed as folders. Of the day in which the time falls what stays is written aside and put in its place by
    overwriting that partition alone. A removal that was cut short goes on where it was called again. The driver sees days, not documents.
    """
    found, cut = _versions(spark, path), now - timedelta(days=days)
    if found is None:
        return 0
    at = F.lit(cut.isoformat(sep=" ")).cast("timestamp")
    gone = found.groupBy("id").agg(F.max(AT).alias("last")).where(F.col("last") < at).count()
    day = cut.date()
    old = sorted(r[0] for r in found.select(DAY).where(F.col(DAY) <= F.lit(day.isoformat()).cast("date")).distinct().collect())
    edge = found.where(F.col(DAY) == F.lit(day.isoformat()).cast("date"))
    if day in old and edge.where(F.col(AT) < at).limit(1).count():
        stays = written(edge.where(F.col(AT) >= at), "stays")
        if stays.limit(1).count():
            stays.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(path)
            old.remove(day)
    elif day in old:
        old.remove(day)
    conf, Path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    for d in old:
        folder = Path(f"{path}/{DAY}={d.isoformat()}")
        folder.getFileSystem(conf).delete(folder, True)
    spark.catalog.refreshByPath(path)
    return gone


def logo_files(spark: SparkSession, path: str, most: int = MOST_BYTES) -> DataFrame:
    """job_id, number, extension, length, modified and content of the copied logos under a folder.

    Files of other names aren't listed, and of those above `most` bytes only the size is looked at. Content is read only if it is asked for.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*-[1-5].{svg,png}").option("recursiveFileLookup", "true").load(path)
    part = lambda i: F.regexp_extract("path", LOGO_FILE, i)
    return files.where(F.col("length") <= most).select(part(1).alias("job_id"), part(2).cast("int").alias("number"), part(3).alias("extension"), "length", F.col("modificationTime").alias("modified"), "content")


def is_logo(content: Column, extension: Column) -> Column:
    """Whether bytes are what their name says: a PNG starts with its signature, a drawing is text."""
    return F.when(extension == "png", F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A").otherwise(F.is_valid_utf8(content))


def portable_logos(guides: DataFrame, files: DataFrame, most: int = MAX_EMBEDDED_BYTES) -> DataFrame:
    """guides with logo_url: an address of the main logo that works anywhere, or null.

    guides: primary (address), alternates (array of structs method, url), favicon. files: job_id, number, extension, length, content.
    An address that is no copy of ours stays as it is. A copy below `most` bytes becomes a data address; one that is larger, or whose file is
    gone or not what its name says, gives way to the first other logo with a web address that is no preview picture, then to the icon.
    """
    part = lambda i: F.regexp_extract("primary", COPIED, i)
    asked = guides.withColumns({"__job": part(1), "__number": part(2).try_cast("int"), "__ext": part(3)})
    small = files.where((F.col("length") < most) & is_logo(F.col("content"), F.col("extension")))
    small = small.select(F.col("job_id").alias("__job"), F.col("number").alias("__number"), F.col("extension").alias("__ext"), labels.data_address(F.col("content"), F.col("extension")).alias("__data"))
    other = F.transform(F.filter("alternates", lambda a: ~F.coalesce(a["method"] == "og-image", F.lit(False))), lambda a: labels.web_address(a["url"]))
    next_ = F.coalesce(F.get(F.array_compact(other), F.lit(0)), labels.web_address(F.col("favicon")))
    both = asked.join(small, ["__job", "__number", "__ext"], "left")
    url = F.when(F.col("__job") == "", F.col("primary")).when(F.col("primary").isNotNull(), F.coalesce("__data", next_))
    return both.select(*guides.columns, url.alias("logo_url"))
