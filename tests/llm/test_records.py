"""WARC archives: round trip, salvage of damaged files, odd rows."""

import pytest

from shelfmark.llm import warc


def _members(n=20):
    out = []
    for i in range(n):
        body = b"<p>" + str(i).encode() * 50 + (b"\r\nWARC/1.1\r\n" if i % 7 == 0 else b"")
        out.append(warc._record(str(i), f"http://x/{i}", body, "0" if i % 5 == 4 else None, warc.digest(body), "2024-01-01T00:00:00Z"))
    return out


@pytest.mark.parametrize("packed", [False, True])
def test_damage_costs_only_the_records_it_hits(packed):
    parts = [warc._gzip(r) + warc._EMPTY_MEMBER for r in _members()] if packed else _members()
    data = b"".join(parts)
    assert [k for k, *_ in warc.salvage(data)] == ["record"] * 20
    for hit in (0, 5, 19):
        bad = bytearray(data)
        # in the compressed data, or in the block
        at = len(b"".join(parts[:hit])) + (len(parts[hit]) // 2 if packed else len(parts[hit]) - 10)
        bad[at : at + 3] = bytes(255 - x for x in bad[at : at + 3])
        found = list(warc.salvage(bytes(bad)))
        gaps = [f for f in found if f[0] == "gap"]
        assert len(gaps) == 1 and gaps[0][1] <= at < gaps[0][1] + gaps[0][2] and gaps[0][3]
        ids = [f[3]["fields"]["warc-page-key"] for f in found if f[0] == "record"]
        assert ids == [str(i) for i in range(20) if i != hit]
    cut = list(warc.salvage(data[: -len(parts[-1]) // 2]))
    assert sum(k == "record" for k, *_ in cut) == 19 and cut[-1][0] == "gap"
    front = list(warc.salvage(b"junk before it" + data))
    assert front[0][:3] == ("gap", 0, 14) and sum(k == "record" for k, *_ in front) == 20
    assert list(warc.salvage(b"")) == []


def test_odd_pages(spark):
    rows = [
        (3, "u", "same"), (1, "u\r\nX: y", "same"), (2, None, None), (4, "", ""), (5, "v", "é 漢 😀" * 30_000),
        (7, "w", "twice"), (7, "w", "twice"), (None, "x", "same"), (None, "x", "alone"),
    ]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload int")
    got = warc.round_trip(pages).collect()
    assert all(r["kind"] == "record" for r in got) and len(got) == len(rows)
    kinds = [
        (r["fields"].get("warc-page-key"), r["record_type"], r["fields"].get("warc-refers-to-page-key"), r["payload_bytes"])
        for r in got
    ]
    want = [
        ("3", "revisit", "1", 4), ("1", "response", None, 4), ("2", "response", None, 0), ("4", "revisit", "2", 0),
        ("5", "response", None, len("é 漢 😀".encode()) * 30_000), ("7", "response", None, 5),
        ("7", "response", None, 5), (None, "revisit", "1", 4), (None, "response", None, 5),
    ]
    assert sorted(kinds, key=repr) == sorted(want, key=repr)
    payloads = {r["fields"].get("warc-page-key"): r["payload"] for r in got if r["record_type"] == "response"}
    assert bytes(payloads["5"]).decode() == "é 漢 😀" * 30_000
    assert warc.round_trip(pages.filter("false")).count() == 0
