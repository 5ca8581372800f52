import base64
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lumenloom.sources import saved

NOW = datetime(2024, 5, 20, 12, 0)


def _save(spark, path, at, *rows):
    saved.save(spark.createDataFrame(list(rows), "id string, body string"), path, at)


def _bodies(df):
    return {r["id"]: r["body"] for r in df.collect()}


def test_saved_loaded_and_removed_by_age(spark, tmp_path):
    path = str(tmp_path / "docs")
    assert saved.load(spark, path) is None and saved.remove_older_than(spark, path, 3, NOW) == 0
    _save(spark, path, NOW - timedelta(days=9), ("a", "old"), ("b", "old"))
    _save(spark, path, NOW - timedelta(days=3, hours=2), ("c", "just too old"), ("d", None))
    _save(spark, path, NOW - timedelta(days=3, hours=-2), ("d", "stays"), ("e", "stays"))
    _save(spark, path, NOW - timedelta(hours=1), ("a", "new"))
    assert _bodies(saved.load(spark, path)) == {"a": "new", "b": "old", "c": "just too old", "d": "stays", "e": "stays"}
    assert _bodies(saved.saved_since(spark, path, 24, NOW)) == {"a": "new"}
    assert saved.remove_older_than(spark, path, 3, NOW) == 2
    assert _bodies(saved.load(spark, path)) == {"a": "new", "d": "stays", "e": "stays"}
    assert spark.read.parquet(path).count() == 3
    assert saved.remove_older_than(spark, path, 3, NOW) == 0
    assert sorted(d for d in os.listdir(path) if "=" in d) == ["saved_on=2024-05-17", "saved_on=2024-05-20"]
    assert saved.remove_older_than(spark, path, 0, NOW + timedelta(days=1)) == 3


def test_a_failed_write_leaves_the_old_document(spark, tmp_path):
    path = str(tmp_path / "docs")
    _save(spark, path, NOW, ("a", "old"))
    rows = spark.range(100).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") == 90, F.raise_error(F.lit("torn"))).otherwise("new").alias("body"))
    with pytest.raises(Exception, match="torn"):
        saved.save(rows, path, NOW + timedelta(hours=1))
    assert _bodies(saved.load(spark, path)) == {"a": "old"}


def test_only_recent_days_are_read(spark, tmp_path):
    path = str(tmp_path / "docs")
    _save(spark, path, NOW - timedelta(days=9), ("a", "old"))
    _save(spark, path, NOW, ("a", "new"))
    plan = saved.saved_since(spark, path, 24, NOW)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(saved_on" in plan


def test_logo_files_and_portable_logos(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + bytes(range(200))
    files = {"bg_a-1.png": png, "bg_b-2.svg": "<svg>é</svg>".encode(), "bg_c-1.png": b"GIF89a", "bg_d-1.svg": b"x" * saved.MAX_EMBEDDED_BYTES, "bg_e-9.svg": b"no", "notes.txt": b"no", "bg_f-1.svg": b"y" * 3_000_000}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    found = saved.logo_files(spark, str(tmp_path))
    assert {(r["job_id"], r["number"], r["extension"]) for r in found.collect()} == {("bg_a", 1, "png"), ("bg_b", 2, "svg"), ("bg_c", 1, "png"), ("bg_d", 1, "svg")}
    plan = found.select("job_id")._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length" in plan and "content" not in plan.split("ReadSchema")[1]
    at = lambda job, rest: f"/api/v1/guides/{job}/logos/{rest}"
    alternates = [("og-image", "https://a/og.png"), ("header", at("bg_z", "1.svg")), ("header", "https://a/h.png")]
    asked = [
        (1, at("bg_a", "1.png"), [], None), (2, at("bg_b", "2.svg"), [], None), (3, at("bg_c", "1.png"), alternates, "https://a/i.ico"), (4, at("bg_d", "1.svg"), alternates[:2], "https://a/i.ico"),
        (5, at("bg_gone", "1.svg"), None, None), (6, "https://a/own.svg", alternates, None), (7, None, alternates, "https://a/i.ico"),
    ]
    guides = spark.createDataFrame(asked, "id int, primary string, alternates array<struct<method:string,url:string>>, favicon string")
    got = {r["id"]: r["logo_url"] for r in saved.portable_logos(guides, found).collect()}
    data = lambda kind, content: f"data:image/{kind};base64,{base64.b64encode(content).decode()}"
    assert got == {1: data("png", png), 2: data("svg+xml", files["bg_b-2.svg"]), 3: "https://a/h.png", 4: "https://a/i.ico", 5: None, 6: "https://a/own.svg", 7: None}
