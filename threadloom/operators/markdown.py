"""Rendering of threads, posts and videos as markdown, one row per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom import fixed_values as fv
from threadloom.functions import dates, numbers, text
from threadloom.functions.text import empty_if_null, null_if_empty, strip
from threadloom.operators.ordering import row_number

RULE = "---"
GLUE = "  \n"


def thread_sections(mail: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One section per message, numbered along the thread.

    With ``known`` (``thread_id, msg_id`` already rendered) only new messages get a
    section, and numbers go on from what is there.
    """
    fresh = mail
    if known is not None:
        fresh = mail.join(known.select("thread_id", "msg_id"), ["thread_id", "msg_id"], "left_anti")
    # The date text orders a thread; its days are the buckets.
    bucket = F.coalesce(F.unix_date(F.substring("sent_at", 1, 10).try_cast("date")), F.lit(0))
    numbered = row_number(fresh, ["thread_id"], [F.col("sent_at"), F.col("msg_id")], bucket, "no")
    if known is not None:
        have = known.groupBy("thread_id").agg(F.count(F.lit(1)).alias("have"))
        numbered = numbered.join(have, "thread_id", "left").withColumn(
            "no", F.col("no") + F.coalesce("have", F.lit(0))).drop("have")
    optional = lambda label, c: F.when(empty_if_null(c) != "", F.concat(F.lit(label), c, F.lit("\n")))
    section = F.concat_ws(
        GLUE,
        F.concat(F.lit("## Message "), F.col("no").cast("string"), F.lit("\n\n")),
        F.concat(F.lit("**From:** "), F.coalesce("sender_address", F.lit("Unknown")), F.lit("\n")),
        optional("**Date:** ", F.col("sent_at")),
        optional("**TYPE_ID:** message/", F.col("msg_id")),
        optional("**In Reply To:** message/", F.col("parent_id")),
        F.lit("\n"), F.concat(empty_if_null(F.col("content")), F.lit("\n\n")), F.lit("---\n\n"))
    return numbered.select("thread_id", "msg_id", "no", section.alias("section"))


def thread_files(info: DataFrame, sections: DataFrame) -> DataFrame:
    """Folder, name and content of a thread's file: header, then all sections."""
    header = F.concat_ws(
        GLUE,
        F.concat(F.lit("# LIST_NAME: "), "list_name", F.lit("\n")),
        F.concat(F.lit("# SUBJECT: "), "subject", F.lit("\n")),
        F.concat(F.lit("**TYPE_ID:** thread/"), "thread_id", F.lit("\n")),
        F.when(empty_if_null(F.col("sent_at")) != "", F.concat(F.lit("**DATE:** "), "sent_at", F.lit("\n"))),
        F.lit("\n---\n\n"))
    bodies = sections.groupBy("thread_id").agg(
        F.array_sort(F.collect_list(F.struct("no", "section"))).alias("s"))
    return info.join(bodies, "thread_id").select(
        F.concat(F.lit("emails_"), F.translate("list_name", "@.-", "___")).alias("folder"),
        F.concat(F.lit("thread_"), "thread_id", F.lit(".md")).alias("file"),
        F.concat(header, F.array_join(F.transform("s", lambda x: x["section"]), "")).alias("content"))


def blog_files(posts: DataFrame) -> DataFrame:
    """One file per post ``url, title, author, timestamp, type, text``."""
    day = F.date_format(F.timestamp_seconds(F.floor("timestamp")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    published = F.when(F.col("timestamp").isNotNull(), day).otherwise("")
    title = F.when(strip(empty_if_null(F.col("title"))) == "", "untitled").otherwise(strip(F.col("title")))
    body = F.when(F.col("type") == "blog-pdf", text.normalize_paper(F.col("text"))).otherwise(F.col("text"))
    meta = F.concat_ws(
        GLUE, F.concat(F.lit("author: "), empty_if_null(F.col("author"))),
        F.concat(F.lit("url: "), strip(empty_if_null(F.col("url")))),
        F.concat(F.lit("published: "), published), F.concat(F.lit("type: "), F.col("type")))
    return posts.select(
        text.safe_path(F.coalesce(null_if_empty(strip(empty_if_null(F.col("author")))), F.lit("unknown"))).alias("folder"),
        F.concat(F.substring(published, 1, 10), F.lit("_"), text.safe_path(title, 80), F.lit(".md")).alias("file"),
        F.concat_ws("\n\n", F.concat(F.lit("# "), title), F.lit(RULE), meta, F.lit(RULE), body).alias("content"))


def topic_folder(channel: Column, search_term: Column, tags: Column, content: Column) -> Column:
    """Where a video belongs: a known channel, its search term, its first matching tag, the
    first search term its text holds, or a general discussion; null drops it."""
    own = F.array(*[F.lit(c) for c in dict.fromkeys(
        [*fv.VIDEO_CHANNELS, *fv.VIDEO_CREATORS, *fv.VIDEO_PLAYLISTS])])
    terms = F.array(*[F.lit(t) for t in dict.fromkeys(fv.SEARCH_TERMS)])
    by_tag = F.filter(tags, lambda t: F.array_contains(terms, t))
    by_text = F.filter(terms, lambda t: F.contains(content, t))
    found = F.coalesce(
        F.try_element_at(by_tag, F.lit(1)), F.try_element_at(by_text, F.lit(1)),
        F.when(F.contains(content, F.lit("c++")) | F.contains(content, F.lit("C++")), "C++ discussion"))
    # A text with the capitalised name is moved, whatever was found before.
    moved = F.when(
        (found.isNull() & F.contains(content, F.lit("boost"))) | F.contains(content, F.lit("Boost")),
        "Boost discussion").otherwise(found)
    return (F.when(F.array_contains(own, channel), channel)
            .when(empty_if_null(search_term) != "", search_term).otherwise(moved))


def video_files(meta: DataFrame, blocks: DataFrame, min_chars: int = 500) -> DataFrame:
    """One file per video of a minute or more with enough text.

    blocks: ``video_id, i, start_time, text``.
    """
    line = F.concat(F.lit("["), dates.seconds_to_clock(F.col("start_time")), F.lit("] "), F.col("text"))
    bodies = blocks.groupBy("video_id").agg(
        F.array_sort(F.collect_list(F.struct("i", line.alias("line")))).alias("b")).select(
        "video_id", F.array_join(F.transform("b", lambda x: x["line"]), "\n\n").alias("body"))
    n = lambda c: numbers.safe_int(F.col(c).cast("string"))
    title = F.when(strip(empty_if_null(F.col("title"))) == "", "untitled").otherwise(strip(F.col("title")))
    when = dates.epoch_from_date(F.col("published_at"))
    iso = F.when(when != 0, F.date_format(F.timestamp_seconds(F.floor(when)), "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("")
    label = lambda name, c: F.concat(F.lit(name + ": "), c)
    meta_lines = F.concat_ws(
        GLUE, label("channel_title", numbers.meta_text(F.col("channel_title"))),
        label("url", F.concat(F.lit(fv.VIDEO_ADDRESS), "video_id")),
        label("published_at", iso), label("duration_seconds", n("duration_seconds").cast("string")),
        label("view_count", n("view_count").cast("string")), label("like_count", n("like_count").cast("string")),
        label("description", F.replace(strip(empty_if_null(F.col("description"))), F.lit("\n"), F.lit(" "))),
        label("speakers", strip(empty_if_null(F.col("speakers")))))
    channel = text.safe_path(F.coalesce(null_if_empty(numbers.meta_text(F.col("channel_title"))), F.lit("unknown")))
    folder = topic_folder(channel, F.col("search_term"),
                          F.coalesce("tags", F.array().cast("array<string>")), F.col("body"))
    return (
        meta.filter(n("duration_seconds") >= fv.MIN_VIDEO_SECONDS).join(bodies, "video_id")
        .filter(F.length("body") >= min_chars)
        .select(folder.alias("folder"),
                text.safe_path(F.concat(text.safe_path(title, 120), F.lit(".md"))).alias("file"),
                F.concat_ws("\n\n", F.concat(F.lit("# "), title), F.lit(RULE), meta_lines, F.lit(RULE), "body").alias("content"))
        .filter(F.col("folder").isNotNull()))
