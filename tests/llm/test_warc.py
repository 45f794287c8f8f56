import gzip
import hashlib
import io
import random

import pytest

from fernlode.llm import warc
from fernlode.llm.warc import _record, plan_records, read_archives, round_trip, scan_range, write_archives
from fernlode.storage import new_path

PAGES = "page_id long, url string, html string, size long, path string, payload_digest string"


def pages(spark):
    rng = random.Random(3)
    rows = [(k, f"http://h/{k}", "".join(rng.choice("abcdé<>\x1f") for _ in range(rng.randint(0, 4000)))) for k in range(60)]
    rows += [(100, None, None), (101, "http://x\r\nEvil: 1", ""), (102, "u", "q" * 999), (103, "u", "q" * 999), (104, "u", "q" * 1000), (105, "u", "q" * 1000), (106, "u", "q" * 1000), (None, "n", "z"), (107, "big", "k" * 300_000)]
    return rows, spark.createDataFrame([(*r, 1, "p", "d") for r in rows], PAGES).repartition(3)


@pytest.mark.parametrize("split", [97, 5000, 4 << 20])
def test_round_trip(spark, split):
    rows, frame = pages(spark)
    got = {r.record_id: r for r in round_trip(frame, split_bytes=split).collect()}
    assert len(got) == len(rows)
    for page, url, html in rows:
        r = got["" if page is None else str(page)]
        data = (html or "").encode()
        twin = {104: "106", 105: "106"}.get(page)
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", twin) if twin else ("response", None))
        assert r.payload is None if twin else bytes(r.payload) == data


def test_archives_are_plain_gzip_members(spark):
    _, frame = pages(spark)
    folder = new_path(spark, "warc-test")
    manifest = write_archives(plan_records(frame), folder)
    total = 0
    for r in manifest.collect():
        total += gzip.decompress(open(r.path, "rb").read()).count(b"WARC/1.1\r\n")
    assert total == frame.count()
    assert read_archives(manifest, folder, 333).count() == frame.count()


def test_each_record_is_owned_once():
    data = b"".join(_record("response", str(k), "u", hashlib.sha1(b"p%d" % k * k).hexdigest(), len(b"p%d" % k * k), None, b"p%d" % k * k) for k in range(30))
    for step in (1, 7, 64, 1000):
        found = [row[3] for start in range(0, len(data), step) for row in scan_range(io.BytesIO(data), "f", start, start + step, len(data))]
        assert found == [str(k) for k in range(30)]


def test_empty(spark):
    assert round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_digest_is_checked():
    data = _record("response", "1", "u", "0" * 40, 1, None, b"p")
    with pytest.raises(ValueError):
        list(scan_range(io.BytesIO(data), "f", 0, 10**6, len(data)))
