"""Ids above 2**53, where doubles lose digits, with nulls beside them."""

from linkspan.llm import chat, warc

BIG = 2**53


def test_pages(spark, tmp_path):
    body = "p" * 2000
    rows = [(BIG + 1, body), (BIG + 3, body), (None, "x"), (BIG + 5, "y")]
    pages = spark.createDataFrame([(i, "u", h, "a", 1) for i, h in rows], "page_id long, url string, html string, file string, payload int")
    files = warc.write(warc.plan(pages), str(tmp_path / "a"))
    got = warc.read_archives(spark, str(tmp_path / "a"), files).collect()
    assert sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in got), key=str) == sorted([
        (BIG + 1, "revisit", BIG + 3), (BIG + 3, "response", None), (None, "response", None), (BIG + 5, "response", None),
    ], key=str)


def test_records_have_a_date_and_their_own_id(spark, tmp_path):
    import glob
    import gzip

    rows = [(1, "u", "same")] * 3
    warc.write(warc.plan(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)), str(tmp_path / "a"))
    data = b"".join(gzip.open(f).read() for f in glob.glob(str(tmp_path / "a" / "*.warc.gz")))
    lines = data.split(b"\r\n")
    assert sum(x.startswith(b"WARC-Date: 20") and x.endswith(b"Z") for x in lines) == 3
    assert len({x for x in lines if x.startswith(b"WARC-Record-ID")}) == 3


def test_conversations(spark):
    rows = [(BIG + 1, 0, "user", "a"), (BIG + 3, 0, "user", "b"), (None, 0, "assistant", "c")]
    df = spark.createDataFrame([(*r, "x", [1]) for r in rows], "conv_id long, turn int, role string, text string, key string, loss array<int>")
    got = chat.read_back(chat.windows(chat.numbered(df))).collect()
    assert sorted((r["conv_id"] for r in got), key=str) == sorted([BIG + 1, BIG + 3, None], key=str)
