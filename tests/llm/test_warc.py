import base64
import hashlib
import os
import shutil

import pytest

from querywright.llm import warc
from querywright.llm.common import fresh_dir


def pages(spark):
    rows = [(i, f"http://h/{i}", f"<p>{i % 7}</p>" if i % 3 else f"<b>{i} é</b>" * 20) for i in range(300)]
    rows += [(1000, None, None), (1001, "http://x/ y\r\n", ""), (1002, "u", "<p>1</p>\r\n\r\nWARC/1.1\r\n"), (1003, "u", "long " * 50_000), (None, "u", "<p>1</p>"), (5, "again", "<p>5</p>")]
    return rows, spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, record_type string").repartition(5)


def test_archives_round_trip(spark):
    rows, df = pages(spark)
    first: dict = {}
    for i, _, h in rows:
        first[h or ""] = min(x for x in (first.get(h or ""), i) if x is not None)
    got = warc.archive(df, shard_rows=40, file_bytes=1500).collect()
    wanted = []
    for i, _, h in rows:
        raw = (h or "").encode()
        main = i == first[h or ""]
        wanted.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if main else "revisit", None if main else first[h or ""]))
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(wanted, key=key)
    assert all((r["html"] is None) == (r["record_type"] == "revisit") for r in got)


def test_same_bytes_at_any_partitioning(spark):
    _, df = pages(spark)
    made = []
    for n in (1, 7):
        path = fresh_dir(spark, "warc-test")
        files = warc.write(df.repartition(n), path, shard_rows=40, file_bytes=1500).orderBy("file").collect()
        made.append([tuple(r) for r in files])
        folder = path.removeprefix("file://")
        assert sorted(f for f in os.listdir(folder) if f.endswith(".gz")) == [r["file"] for r in files]
        assert all(hashlib.sha256(open(f"{folder}/{r['file']}", "rb").read()).hexdigest() == r["sha256"] for r in files)
        assert not [f for f in os.listdir(folder) if f.startswith(".records") and not f.endswith(".crc")]
    assert made[0] == made[1] and len(made[0]) > 8


def test_unlisted_files_are_not_read(spark):
    _, df = pages(spark)
    path = fresh_dir(spark, "warc-test")
    warc.write(df, path)
    with open(path.removeprefix("file://") + "/records-999999-00000.warc.gz", "wb") as f:
        f.write(b"left over")
    assert warc.read(spark, path).count() == 306


def test_a_folder_is_written_once(spark):
    _, df = pages(spark)
    path = fresh_dir(spark, "warc-test")
    warc.write(df, path)
    with pytest.raises(FileExistsError):
        warc.write(df.limit(3), path)
    assert warc.read(spark, path).count() == 306


def test_left_over_files_of_other_records_are_an_error(spark):
    """Files of an attempt without a manifest are taken where their bytes are the same, and never passed off as others."""
    _, df = pages(spark)
    path = fresh_dir(spark, "warc-test")
    folder = path.removeprefix("file://")
    warc.write(df, path)
    shutil.rmtree(f"{folder}/manifest")
    assert warc.write(df, path).count() and warc.read(spark, path).count() == 306
    shutil.rmtree(f"{folder}/manifest")
    with pytest.raises(Exception, match="holds other records"):
        warc.write(df.filter("page_id > 3"), path)


def test_one_id_with_a_third_of_all_records(spark):
    """A hot id and the null id are dealt over parts; the records stay the same."""
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"http://h/{i}", f"<p>{i}</p>") for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    path = fresh_dir(spark, "warc-test")
    files = [r["file"] for r in warc.write(df, path, shard_rows=20).collect()]
    assert len({f.split("-")[2] for f in files}) >= 5
    got = warc.read(spark, path).collect()
    assert sorted((r["page_id"] or -1, r["url"], r["html"]) for r in got) == sorted((i or -1, u, h) for i, u, h in rows)


def test_empty_table(spark):
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
