"""From source rows to documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom import fixed_values as fv
from threadloom.functions import dates, ids, numbers, text
from threadloom.functions.quality import long_enough
from threadloom.functions.text import empty_if_null, null_if_empty, strip
from threadloom.operators.joins import paper_metadata
from threadloom.session import sent


def either(df: DataFrame, *names: str) -> Column:
    """First of the named columns that exists and is not null."""
    present = [F.col(n) for n in names if n in df.columns]
    return F.coalesce(*present) if present else F.lit(None).cast("string")


def mail_documents(mail: DataFrame, min_chars: int = 20) -> DataFrame:
    content = text.clean_text(either(mail, "content", "body"))
    address = null_if_empty(empty_if_null(either(mail, "message_url", "url")))
    address = F.coalesce(address, F.concat(
        empty_if_null(either(mail, "list_name")), F.lit("/message/"),
        empty_if_null(either(mail, "msg_id"))))
    return mail.select(
        ids.id_from_url(address).alias("doc_id"), F.lit("mailing").alias("type"),
        ids.id_from_url(either(mail, "thread_url", "thread_id")).alias("thread_id"),
        F.coalesce(either(mail, "subject"), F.lit("No Subject")).alias("subject"),
        empty_if_null(either(mail, "sender_address")).alias("author"),
        dates.epoch_from_date(either(mail, "date", "sent_at")).alias("timestamp"),
        ids.id_from_url(either(mail, "parent", "parent_id")).alias("parent_id"),
        content.alias("text"),
    ).filter(F.length("text") >= min_chars)


def mail_documents_local(mail: DataFrame, file_key: str, position: str) -> DataFrame:
    """Local variant: the first message of a file names thread and subject for all."""
    heads = mail.groupBy(file_key).agg(
        F.min_by(F.struct(F.coalesce(either(mail, "thread_url"), F.lit("unknown")).alias("thread_id"),
                          F.coalesce(either(mail, "subject"), F.lit("No Subject")).alias("subject")),
                 position).alias("head"))
    number = F.coalesce(either(mail, "message_id"), F.lit("Unknown"))
    url = F.coalesce(either(mail, "message_url", "url"), F.lit("Unknown"))
    rows = mail.select(
        file_key, F.md5(url).alias("doc_id"),
        F.when(F.contains(number, F.lit("@@")), number)
        .otherwise(F.concat(F.lit("@@MailingList@@"), number)).alias("source"),
        F.lit("mail").alias("type"),
        F.coalesce(either(mail, "sender_address"), F.lit("Unknown")).alias("author"),
        F.coalesce(either(mail, "date"), F.lit("Unknown")).alias("date"),
        url.alias("url"), text.squeeze(either(mail, "content", "body")).alias("text"),
    ).filter(F.length("text") > 20)
    return rows.join(heads, file_key).select(
        "doc_id", "source", "type", F.col("head.thread_id").alias("thread_id"),
        F.col("head.subject").alias("subject"), "author", "date", "url", "text")


def thread_info(mail: DataFrame) -> DataFrame:
    """Per thread: its list, and subject and date of its root, else of its first message."""
    order = F.struct("sent_at", "msg_id")
    what = F.struct("subject", "sent_at")
    root = F.col("msg_id") == F.col("thread_id")
    return (
        mail.groupBy("thread_id")
        .agg(F.min_by("list_name", order).alias("list_name"),
             F.max_by(F.when(root, what), F.when(root, order)).alias("root"),
             F.min_by(what, order).alias("first"))
        .select("thread_id", "list_name",
                F.coalesce("root.subject", "first.subject").alias("subject"),
                F.coalesce("root.sent_at", "first.sent_at").alias("sent_at"))
    )


def chat_documents(groups: DataFrame, min_chars: int = 10) -> DataFrame:
    body = strip(F.col("text"))
    return groups.filter(F.length(body) >= min_chars).select(
        F.col("ts").alias("doc_id"), "team_id", F.lit("slack").alias("type"), "channel_id",
        F.when(empty_if_null(F.col("user_name")) == "", "unknown").otherwise(F.col("user_name"))
        .alias("user_name"),
        F.col("ts").alias("timestamp"), empty_if_null(F.col("thread_ts")).alias("thread_ts"),
        F.size("message_ids").cast("long").alias("group_size"), body.alias("text"))


def paper_documents(papers: DataFrame, index: DataFrame, kind: str = "wg21",
                    min_chars: int = 50) -> DataFrame:
    """Papers ``relative, filename, text`` with their metadata."""
    author = strip(empty_if_null(F.col("author")))
    title = strip(empty_if_null(F.col("title")))
    stem = text.file_stem(F.col("filename"))
    return (
        paper_metadata(papers.filter(long_enough(F.col("text"), min_chars)), index)
        .select(
            stem.alias("document_number"), F.lit(kind).alias("type"),
            F.when(title == "", stem).otherwise(title).alias("title"),
            F.when(author == "", F.array(F.lit("unknown"))).otherwise(F.split(author, ","))
            .alias("author"),
            dates.epoch_from_date(F.col("date")).alias("timestamp"),
            empty_if_null(F.col("url")).alias("url"), "text")
    )


def blog_documents(posts: DataFrame, min_chars: int = 50) -> DataFrame:
    """Blog posts; the date comes from the post, else from the file name."""
    published = F.col("published_parsed")
    body = strip(empty_if_null(F.col("content")))
    return posts.filter(empty_if_null(F.col("url")) != "").filter(F.length(body) >= min_chars).select(
        F.replace(F.col("url"), F.lit(".html.html"), F.lit(".html")).alias("url"),
        strip(empty_if_null(F.col("title"))).alias("title"),
        strip(empty_if_null(F.col("author"))).alias("author"),
        F.when(empty_if_null(published) == "", dates.epoch_from_filename(F.col("path")))
        .otherwise(dates.epoch_from_published(published)).alias("timestamp"),
        F.lit("blog-html").alias("type"), body.alias("text"))


def video_segments(chunks: DataFrame, meta: DataFrame, min_chars: int = 50) -> DataFrame:
    """Transcript chunks ``video_id, i, start_time, end_time, text`` with video metadata."""
    def line(name: str, label: str) -> Column:
        value = F.col(name)
        shown = text.truncate(value, 500) if name == "description" else value
        return F.when(empty_if_null(value) != "", F.concat(F.lit(f"{label}: "), shown))

    content = F.concat_ws(
        "\n\n", line("title", "Title"), line("channel_title", "Channel Title"),
        line("speakers", "Speakers"), line("search_term", "Search Term"),
        line("csv_date", "Meeting Date"), line("description", "Description"),
        F.concat(F.lit("\nTranscript:\n"), F.col("text")))
    return (
        chunks.join(meta, "video_id")
        .select(
            F.concat("video_id", F.lit("_"), F.col("i").cast("string")).alias("doc_id"),
            F.lit("youtube_video").alias("type"), "video_id",
            F.concat(F.lit(fv.VIDEO_ADDRESS), "video_id", F.lit("&t="),
                     F.col("start_time").cast("long").cast("string")).alias("url"),
            numbers.meta_text(F.col("channel_title")).alias("channel_title"),
            dates.epoch_from_date(F.col("published_at")).alias("published_at"),
            numbers.safe_int(F.col("duration_seconds").cast("string")).alias("duration_seconds"),
            numbers.safe_int(F.col("view_count").cast("string")).alias("view_count"),
            numbers.safe_int(F.col("like_count").cast("string")).alias("like_count"),
            numbers.meta_text(F.col("search_term")).alias("search_term"),
            "start_time", "end_time", content.alias("text"))
        .filter(long_enough(F.col("text"), min_chars))
    )


def tool_entries(files: DataFrame, categories: DataFrame, build_time: str) -> DataFrame:
    """Tool documentation ``tool_name, category, file_path, text`` under its namespace. Categories are few and go to the
    files; joined by a shuffle, each would gather its files with their texts in one task."""
    return (
        files.join(sent(categories), "category", "left")
        .select("tool_name", "file_path", "namespace", F.sha2("text", 256).alias("hash"),
                F.lit(build_time).alias("build_time"), "text")
    )


def index_records(chunks: DataFrame) -> DataFrame:
    """Chunks ``base, start_index, title, text`` to index records: valid ones only,
    titled, hashed. ``base`` is the document id, or the hash of the text without one."""
    from threadloom.functions.quality import is_valid_chunk

    body = strip(empty_if_null(F.col("text")))
    titled = ids.title_prefix(F.col("title"), F.col("text"))
    return (
        chunks.withColumn("text", body).filter(is_valid_chunk(F.col("text")))
        .withColumn("text", titled)
        .withColumn("id", ids.chunk_record_id(
            F.coalesce("base", F.md5("text")), F.col("start_index"), F.col("text")))
    )
