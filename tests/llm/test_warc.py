import hashlib

from postflock.llm import files, warc


def test_round_trip(spark):
    long = "é" * 300_000
    rows = [(5, "http://a/b c", "x" * 200, 1), (3, None, "x" * 200, 1), (9, "u", "x" * 200, 1), (None, "u", "x" * 200, 1), (1, "u", "short", 1), (2, "u", "short", 1), (4, "u", None, 1), (6, "u", "", 1), (7, "u", long, 1), (8, "u", long, 1), (8, "u", long, 1), (None, "u", "y" * 150, 1), (None, "u", "y" * 150, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, HTML long")
    manifest = warc.write_archive(pages, file_bytes=400)
    out = warc.read_archive(manifest).collect()
    low = -1
    got = sorted((low if r.page_id is None else r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to if r.refers_to is not None else low) for r in out)
    h = lambda t: (len((t or "").encode()), hashlib.sha256((t or "").encode()).hexdigest())
    want = [(5, *h("x" * 200), "revisit", 3), (3, *h("x" * 200), "response", low), (9, *h("x" * 200), "revisit", 3), (low, *h("x" * 200), "revisit", 3), (1, *h("short"), "response", low), (2, *h("short"), "response", low), (4, *h(""), "response", low), (6, *h(""), "response", low), (7, *h(long), "response", low), (8, *h(long), "revisit", 7), (8, *h(long), "revisit", 7), (low, *h("y" * 150), "response", low), (low, *h("y" * 150), "revisit", low)]
    assert got == sorted(want)
    for row in manifest.collect():
        assert hashlib.sha256(files.read(row.path)).hexdigest() == row.sha256
    again = warc.write_archive(pages, file_bytes=400)
    assert sorted(r.sha256 for r in again.collect()) == sorted(r.sha256 for r in manifest.collect())
    assert manifest.count() > 2


def test_revisits_name_the_record_that_they_refer_to(spark):
    rows = [(5, "http://a/b c", "x" * 200), (3, "http://z/", "x" * 200), (3, "http://first/", "x" * 200), (None, "u", "x" * 200), (None, "v", "y" * 150), (None, "u", "y" * 150), (7, None, "short"), (7, None, "short")]
    manifest = warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"))
    found = []
    for row in manifest.collect():
        store, place = files.place(row.path)
        with store.open_input_stream(place, compression=None) as source:
            found += [fields for fields, _ in warc.records(source)]
    pages = [x for x in found if x["WARC-Type"] != "warcinfo"]
    responses = {x["WARC-Record-ID"]: x for x in pages if x["WARC-Type"] == "response"}
    assert len({x["WARC-Record-ID"] for x in found}) == len(found) and len(pages) == len(rows)
    revisits = [x for x in pages if x["WARC-Type"] == "revisit"]
    for x in revisits:
        to = responses[x["WARC-Refers-To"]]
        assert (to["WARC-Payload-Digest"], to["WARC-Target-URI"], to["WARC-Date"]) == (x["WARC-Payload-Digest"], x["WARC-Refers-To-Target-URI"], x["WARC-Refers-To-Date"])
    assert sorted(x["WARC-Refers-To-Target-URI"] for x in revisits) == ["http://first/"] * 3 + ["u"]


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archive(warc.write_archive(pages)).count() == 0
