import hashlib
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lacewing.operators import publish
from lacewing.sources import captures


def test_captures(spark, tmp_path):
    page = '<li id="list_card_7"><b>1,200 원</b></li>'.encode("euc-kr")
    (tmp_path / "html").mkdir()
    (tmp_path / "meta").mkdir()
    cases = {
        "good": {}, "no_type": {"content_type": None}, "size": {"bytes": 1}, "late": {"observed_at": "2030-01-01T00:00:00Z"}, "naive": {"observed_at": "2026-01-01T00:00:00"}, "hash": {"sha256": "0" * 64},
        "image": {"content_type": "image/png"}, "status": {"status_code": 404}, "text": {"bytes": str(len(page))}, "absent": {"url": None}, "charset": {"content_type": "text/html; charset=EUC-KR"},
    }
    for name, change in cases.items():
        (tmp_path / "html" / f"{name}.html").write_bytes(page)
        meta = {"url": name, "observed_at": "2026-01-01T00:00:00+09:00", "status_code": 200, "sha256": hashlib.sha256(page).hexdigest(), "bytes": len(page), "content_type": "text/html"} | change
        (tmp_path / "meta" / f"{name}.json").write_text(json.dumps({k: v for k, v in meta.items() if v is not None}, indent=1))
    (tmp_path / "meta" / "torn.json").write_text('{"url": ')
    (tmp_path / "meta" / "lone.json").write_text((tmp_path / "meta" / "good.json").read_text())
    files = spark.read.format("binaryFile").load(f"{tmp_path}/html")
    rows = captures.verified(files, captures.metadata(spark, f"{tmp_path}/meta"), F.lit(datetime(2027, 1, 1)))
    assert {r.capture: r.problem for r in rows.collect()} == {
        "good": None, "no_type": None, "charset": None, "size": "size", "late": "future", "naive": "time zone", "hash": "sha256", "image": "content type", "status": "status",
        "text": "field bytes", "absent": "field url", "torn": "not JSON", "lone": "missing file",
    }
    assert {r.text for r in captures.decoded(rows.where("problem is null")).collect()} == {page.decode("euc-kr")}
    torn = spark.createDataFrame([("u", bytearray(b"\xff\xff"))], "url string, content binary")
    assert captures.decoded(torn).first().text is None


def test_publication_is_all_or_nothing(spark, tmp_path):
    folder, one, two = f"file://{tmp_path}/db", spark.range(3), spark.range(5)
    publish.publish({"cards": one}, {"orphans": one.where("id > 9")}, folder)
    with pytest.raises(ValueError):
        publish.publish({"cards": two}, {"orphans": two.where("id > 3")}, folder)
    assert publish.current(spark, folder, "cards").count() == 3
    publish.publish({"cards": two}, {}, folder)
    assert publish.current(spark, folder, "cards").count() == 5


def test_snapshots_append_once(spark, tmp_path):
    folder = f"file://{tmp_path}/snap"
    df = spark.createDataFrame([("u", 1, "x"), ("v", 1, "y")], "url string, at int, sha string")
    assert publish.append_snapshots(df, folder, ["url", "at"], "sha") == {"inserted": 2, "unchanged": 0}
    assert publish.append_snapshots(df, folder, ["url", "at"], "sha") == {"inserted": 0, "unchanged": 2}
    with pytest.raises(ValueError):
        publish.append_snapshots(df.withColumn("sha", F.lit("z")), folder, ["url", "at"], "sha")


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", 2), (None, None), ("é", 3)], "name string, n int").coalesce(1)
    publish.write_csv(df, f"{tmp_path}/csv")
    raw = next((tmp_path / "csv").glob("part-*")).read_bytes().decode()
    assert raw.startswith("﻿name,n\n") and "'=1+1,2" in raw and "é,3" in raw
