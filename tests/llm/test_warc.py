import pathlib

from lacewing.llm import warc as w


def test_round_trip(spark, tmp_path):
    html = ["<p>é</p>" * 50, "", "x" * 3000, "a\r\n\r\nb", "<b>"]
    rows = [(i, f"http://h{i % 3}/{i}?q= é\n", html[i % 5] + ("" if i % 2 else str(i % 7)), "clash") for i in range(120)]
    rows += [(500, None, None, ""), (501, "http://z", None, ""), (None, "http://n", "only here", ""), (7, rows[7][1], rows[7][2], "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string")
    best = {}
    for i, _, h, _ in rows:
        if i is not None:
            best[h or ""] = max(best.get(h or "", -1), i)
    want = sorted((i, len((h or "").encode()), w.base32_sha1((h or "").encode()), "response" if best.get(h or "", i) == i else "revisit", None if best.get(h or "", i) == i else best[h or ""]) for i, _, h, _ in rows if i is not None)
    names = []
    for part, shuffled in enumerate((df, df.repartition(7))):
        folder = f"file://{tmp_path}/out{part}"
        manifest = w.write_archives(shuffled, folder, shard_bytes=40_000, file_bytes=2_000)
        got = w.read_archives(spark, folder).collect()
        assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got if r.page_id is not None) == want
        assert [r.record_type for r in got if r.page_id is None] == ["response"]
        text = {i: h or "" for i, _, h, _ in rows}
        assert all(r.html == text[r.page_id] for r in got if r.record_type == "response" and r.page_id is not None)
        files = {p.name: p.read_bytes() for p in pathlib.Path(f"{tmp_path}/out{part}").glob("*.warc.gz")}
        assert {r.file: r.bytes for r in manifest.collect()} == {n: len(b) for n, b in files.items()} and len(files) > 3
        assert not list(pathlib.Path(f"{tmp_path}/out{part}").glob("_temporary*"))
        names.append(files)
    assert names[0] == names[1]
    stray = pathlib.Path(f"{tmp_path}/out0/other.warc.gz")
    stray.write_bytes(b"not in the manifest")
    assert w.read_archives(spark, f"file://{tmp_path}/out0").count() == len(rows)
    empty = f"file://{tmp_path}/empty"
    assert w.write_archives(df.limit(0), empty).count() == 0


def test_shards_are_even_and_a_page_may_exceed_a_file(spark, tmp_path):
    rows = [(i, f"http://h/{i:05d}", "y" * (900 if i % 9 else 9_000) + str(i)) for i in range(2_000)] + [(9_999, "http://h/00500x", "z" * 400_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    manifest = w.write_archives(df, f"file://{tmp_path}/even", shard_bytes=500_000, file_bytes=30_000).collect()
    held = {}
    for r in manifest:
        held[r.shard] = held.get(r.shard, 0) + r.records
    assert sorted(held) == list(range(len(held))) and len(held) > 5 and sum(held.values()) == len(rows)
    whole = sorted(v for k, v in held.items() if 0 < k < len(held) - 1)
    assert whole[-1] <= 2 * whole[len(whole) // 2]
    got = {r.page_id: r.html for r in w.read_archives(spark, f"file://{tmp_path}/even").collect()}
    assert got == {i: h for i, _, h in rows}
