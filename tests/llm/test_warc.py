import hashlib

from tallyglass.llm import warc as W


def test_archives_give_back_all_pages(spark):
    big = "<p>" + "same text " * 30
    pages = [(5, "u5", big), (3, "u3", big), (3, "u3", big), (9, None, big), (4, "http://a/%41\n b", "short"), (6, "u6", "short"), (7, "u7", None), (8, "u8", ""), (None, "n", big), (10, "u10", "é\r\n\r\n" * 40)]
    frame = spark.createDataFrame([(*p, 1, "x") for p in pages], "page_id long, url string, html string, payload long, record_type string").repartition(3)
    index, folder = W.archive(frame)
    rows = W.read_records(index, folder, range_bytes=300, gap=10).collect()
    got = sorted(((r["page_id"], r["url"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows), key=str)
    want = []
    for i, url, text in pages:
        raw = (text or "").encode()
        again = text == big and i is not None and i > 3
        want.append((i, url, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", 3 if again else None))
    assert got == sorted(want, key=str)
    assert all((r["payload"] is None) == (r["record_type"] == "revisit") for r in rows)
    some = W.read_records(index.where("page_id = 10"), folder).collect()
    assert [bytes(r["payload"]).decode() for r in some] == ["é\r\n\r\n" * 40]
    assert W.read_records(*W.archive(frame.limit(0))).count() == 0
