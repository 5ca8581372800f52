"""Readers of landed data: captures with quarantine, guides, files by age."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ELEMENT = "struct<kind:string,region:string,x:double,y:double,w:double,h:double,chars:int,color:string,back:string,bg:string,border:string,font:string,weight:int,size:double,promo:boolean,on_image:boolean>"
CAPTURE = f"site_id string, url string, viewport struct<width:int,height:int>, page_background string, elements array<string>, fonts array<struct<family:string>>, text string"


def captures(spark: SparkSession, path: str) -> DataFrame:
    """JSON captures, one a line; elements stay text until they are checked one by one."""
    return spark.read.schema(CAPTURE + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def _valid(e: Column) -> Column:
    code = lambda c: c.isNull() | c.rlike("^#[0-9A-Fa-f]{6}$")
    return e["kind"].isNotNull() & (e["w"] >= 0) & (e["h"] >= 0) & code(e["color"]) & code(e["bg"]) & code(e["border"])


def checked_elements(landed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good elements (site_id, pos, fields) and rejects counted by site: a bad element goes, the rest stays."""
    each = landed.where("_corrupt_record is null").select("site_id", "page_background", F.posexplode("elements").alias("pos", "raw"))
    parsed = each.withColumn("e", F.from_json("raw", ELEMENT)).withColumn("ok", F.coalesce(_valid(F.col("e")), F.lit(False)))
    return parsed.where("ok").select("site_id", "pos", "page_background", "e.*"), parsed.where("not ok").groupBy("site_id").agg(F.count("*").alias("left_out"), F.slice(F.array_sort(F.collect_list(F.struct("pos", "raw"))), 1, 3).alias("first"))


def files_since(spark: SparkSession, path: str, since: str) -> DataFrame:
    """Documents whose file changed after a time; older files aren't opened."""
    return spark.read.option("modifiedAfter", since).option("mode", "PERMISSIVE").json(path)


def search_results(landed: DataFrame, allow: list[str] | None = None, deny: list[str] | None = None) -> DataFrame:
    """Landed search results within the allowed domains and outside the denied ones, by position."""
    from lumenloom.functions import urls

    suffixes = urls.host_suffixes(urls.host(F.col("url")))
    lit = lambda names: F.array(*[F.lit(n) for n in names])
    kept = landed
    if allow:
        kept = kept.where(F.arrays_overlap(suffixes, lit(allow)))
    if deny:
        kept = kept.where(~F.arrays_overlap(suffixes, lit(deny)))
    return kept.orderBy("position")


def image_kind(content: Column) -> Column:
    """png or svg by content, null for others and over 2 MB."""
    png = F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A"
    svg = content.cast("string").rlike(r"(?s)\A\s*(<\?xml[^>]*>\s*)?<svg\b")
    return F.when(F.octet_length(content) <= 2_000_000, F.when(png, F.lit("png")).when(svg, F.lit("svg")))
