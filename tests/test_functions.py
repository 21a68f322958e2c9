"""Edge rows of the column functions."""

import pytest
from pyspark.sql import functions as F

from threadloom.functions import dates, ids, numbers, quality, text


def values(spark, rows, expr):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string").repartition(1)
    return [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]


def test_dates(spark):
    rows = ["", None, "2023-01-15", "2023-01-15T10:30:00Z", "2023-01-15T10:30:00+02:00",
            "Sun, 09 Oct 2011 20:30:18 +0200", "Sun, 09 Oct 2011 20:30:18", "03/04/2020", "12/31/2020",
            "junk", "2023-13-45", " 2023-01-15 10:30:00 ", "2023-01-15 10:30:00+01:30", "9 Oct 2011", "Oct 9, 2011",
            "2023-01-15T10:30:00.250", "31-12-2020", "Tue, 11 Oct 2011 20:30:18 +0200", "9 Oct 2011 10:00:00"]
    assert values(spark, rows, dates.epoch_from_date) == [
        0.0, 0.0, 1673740800.0, 1673778600.0, 1673778600.0, 1318185018.0, 1318192218.0, 1585872000.0,
        1609372800.0, 0.0, 0.0, 1673778600.0, 1673773200.0, 1318118400.0, 1318118400.0, 1673778600.25,
        1609372800.0, 1318365018.0, 0.0]
    assert values(spark, ["2023-01-15", "", "x"], dates.date_to_iso) == [
        "2023-01-15T00:00:00", "", "1970-01-01T00:00:00"]
    assert values(spark, ["D:20210101120000", "D:191020819214908", None, "20210101"], dates.epoch_from_pdf) == [
        1609459200.0, 0.0, 0.0, 0.0]
    assert values(spark, ["a/site.com_2007_01_24_02.json", "2010_09_27.json", "2007-13-24.md", "x"],
                  dates.epoch_from_filename) == [1169596800.0, 1285545600.0, 0.0, 0.0]
    assert values(spark, ["[2024, 1, 5, 10]", "[2024, 1]", "2024-01-05", None], dates.epoch_from_published) == [
        1704412800.0, 0.0, 1704412800.0, 0.0]


def test_clock(spark):
    assert values(spark, ["00:01:30.500", "01:23:45.123", "00:00:05", "00:00:01.5", "1:2", "x:y:z"],
                  dates.clock_to_seconds) == [90.5, 5025.123, 5.0, 1.005, 0.0, 0.0]
    assert values(spark, ["90.7", "3661", "-5", "400000"], lambda c: dates.seconds_to_clock(c.cast("double"))) == [
        "00:01:30", "01:01:01", "00:00:00", "111:06:40"]
    assert values(spark, ["PT1H2M10S", "PT", "", "PT45S", "P1D"], dates.iso_duration_seconds) == [3730, 0, 0, 45, 0]
    assert values(spark, ["3723", "0", "3600"], lambda c: dates.human_duration(c.cast("double"))) == [
        "1h 2m 3s", "0s", "1h"]


def test_recency(spark):
    got = values(spark, ["2024-01-31", "1990-01-01", "junk", "Thu, 01 Feb 2024 00:00:00 +0900", "03/04/2020"],
                 lambda c: dates.recency_bonus(c, "2024-02-01 00:00:00", 1500.0))
    assert got == pytest.approx([0.99933, 0.1, 0.0, 1.0, 0.0], abs=1e-4)


def test_numbers(spark):
    assert values(spark, ["1,234", "1.5K", "2M", "abc", "", None, "12.5", "-7", "xK"], numbers.safe_int) == [
        1234, 1500, 2000000, 0, 0, 0, 0, -7, 0]
    assert values(spark, ["1.5", "x", None, " 2 "], numbers.safe_float) == [1.5, 0.0, 0.0, 2.0]
    assert values(spark, [" a ", None, "12"], numbers.meta_text) == ["a", "", "12"]
    assert values(spark, [" -3 ", None, "1x"], numbers.meta_int) == [-3, None, None]


def test_text(spark):
    assert values(spark, ["  Hello   world  ", "Text\n\n\nMore", "a\r\n b\rc", "x­y​z", None, " q　"],
                  text.clean_text) == ["Hello world", "Text\n\nMore", "a\nb\nc", "xyz", "", "q"]
    assert values(spark, ["ok sure", "Hi there, can you help?", "one two three", "one two three four", ""],
                  text.filter_sentence) == ["", "there, can u help?", "", "one two three four", ""]
    assert values(spark, ["hi this is what you want"], lambda c: text.filter_sentence(c, word_boundary=True)) == [
        "this is what you want"]
    assert values(spark, ["<@U1> see <#C2|dev> <https://a.b|link> <x> :+1: ok"], text.clean_chat) == ["see #dev link x ok"]
    assert values(spark, ["<p>a &amp;lt; b</p>&nbsp;", None], text.strip_html) == ["a < b", ""]
    assert values(spark, ["see (http://a.b/c), www.x.y", "go www.x.y!", "none"], text.first_url) == [
        "http://a.b/c", "www.x.y", None]
    assert values(spark, ["abcdef", "ab"], lambda c: text.truncate(c, 5)) == ["ab...", "ab"]
    assert values(spark, ["a<b>:c", " .. ", None, "x" * 300], text.safe_path) == ["a_b__c", "unknown", "unknown", "x" * 200]
    assert values(spark, ["a/VAM.en.vtt", "VAM.json", "x"], text.video_id) == ["VAM", "VAM", "x"]


def test_paper_text(spark):
    rows = ["1. Abstract\nfoo-\n  bar\nrest", "a--\n\nb", "end-", "", "Related Work\nx"]
    assert values(spark, rows, text.normalize_paper) == [
        "### Abstract\nfoobar\nrest", "ab", "end-", "", "### Related Work\nx"]


def test_quality(spark):
    rows = ["| --- | --- |", "too short", "one two three four", "!!! ??? *** ((", "", None, "größe über maß hier"]
    assert values(spark, rows, quality.is_valid_chunk) == [False, False, True, False, False, False, False]
    assert values(spark, rows[:2], quality.reject_reason) == [
        "Table separator", "Text too short (length: 9, minimum: 10)"]


def test_ids(spark):
    assert values(spark, ["http://x/list/dev@l/email/ABC/", "", None], ids.id_from_url) == ["dev@l/message/ABC", "", ""]
    assert values(spark, ["http://x/list/l/thread/T1/", "http://x/list/l/email/M/", "z"], ids.typed_id_from_url) == [
        "thread/T1", "message/M", None]
    assert values(spark, ["/a/en/asio/x", "/a/en", "/a"], ids.library_from_path) == ["asio", "unknown", "unknown"]
    assert values(spark, ["Document number: P0843R10", "N1234: x", "paper p2000r1", "none"], ids.paper_number) == [
        "P0843R10", "N1234", "p2000r1", None]
    assert values(spark, ["u"], lambda c: ids.local_chunk_id(c, F.lit(7))) == ["7b774effe4a349c6dd82ad4f4f21d34c-007"]
