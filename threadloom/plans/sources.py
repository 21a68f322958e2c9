"""Sources: parsers over whole tables, and round trips through files."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions import ids, text
from threadloom.operators import documents, joins
from threadloom.plans import duck, fixtures
from threadloom.plans.registry import query
from threadloom.session import scratch_path
from threadloom.sources import chat, fetched_pages, files, parsers
from threadloom.tables import table


def mail_files(spark, sf):
    """One file per thread; the lists differ in shape: array, or object with messages."""
    m = fixtures.mail(spark, sf)
    msg = F.struct("msg_id", "parent_id", "thread_id", "subject", "content", "list_name",
                   "sent_at", "sender_address", "message_url", "thread_url")
    grouped = m.groupBy("conv_id", "list_name").agg(F.transform(
        F.array_sort(F.collect_list(F.struct(F.col("turn"), msg.alias("m")))), lambda x: x["m"]).alias("ms"))
    return grouped.select(
        F.concat(F.lit("/mail/"), "list_name", F.lit("/"), "conv_id", F.lit(".json")).alias("path"),
        F.when(F.startswith("list_name", F.lit("dev")), F.to_json("ms"))
        .otherwise(F.to_json(F.struct(F.col("ms").alias("messages")))).alias("value"))


@query("src_mail_json", f"""WITH {fixtures.SQL_MAIL}
SELECT '/mail/' || list_name || '/' || conv_id || '.json' AS path, turn::INTEGER AS pos, msg_id, parent_id,
  thread_id, subject, content, sent_at, sender_address FROM mail""")
def src_mail_json(spark, sf):
    return parsers.mail_messages(mail_files(spark, sf)).select(
        "path", "pos", "msg_id", "parent_id", "thread_id", "subject", "content", "sent_at",
        "sender_address")


@query("src_doc_files", f"""
WITH f AS (SELECT '/docs/en/lib' || source || '/' || doc_id AS stem, doc_id, lang, text FROM documents),
b AS (SELECT *, {duck.strip(f"regexp_replace(CASE WHEN lang = 'en' THEN 'Source URL:  http://docs.example.org/' || doc_id || chr(10) || text ELSE text END, {duck.lit(chr(92) + 'n' + duck.WS + '*' + chr(92) + 'n+')}, chr(10) || chr(10), 'g')")} AS body FROM f),
c AS (SELECT *, string_split(body, chr(10))[1] AS first FROM b WHERE length(body) > 50)
SELECT md5(CASE WHEN lang = 'en' THEN 'http://docs.example.org/' || doc_id ELSE substring(stem, 7) || '.txt' END) AS doc_id,
  replace(body, first, '') AS text, CASE WHEN lang = 'en' THEN 'official' ELSE 'repository' END AS source,
  regexp_extract(stem, 'en/([^/]+)/', 1) AS library, '.txt' AS file_type,
  CASE WHEN lang = 'en' THEN 'http://docs.example.org/' || doc_id ELSE substring(stem, 7) || '.txt' END AS url FROM c""")
def src_doc_files(spark, sf):
    rows = table(spark, sf, "documents").select(
        F.concat(F.lit("/docs/en/lib"), "source", F.lit("/"), "doc_id", F.lit(".txt")).alias("path"),
        F.when(F.col("lang") == "en", F.concat(
            F.lit("Source URL:  http://docs.example.org/"), "doc_id", F.lit("\n"), "text"))
        .otherwise(F.col("text")).alias("value"))
    return parsers.documentation(rows, files.relative_path(F.col("path"), "/docs")).drop("type")


@query("src_slack_jdbc", f"""
WITH {fixtures.SQL_CHAT}
SELECT id, ts, message, thread_ts, channel_id, 'T-' || e.event_type AS team_id,
  c_name AS display_name, c_mktsegment AS user_name
FROM chat JOIN (SELECT event_id, event_type FROM events) e USING (event_id) LEFT JOIN customer ON c_custkey = user_id
WHERE ts::DOUBLE >= 1704067300 AND ts >= '1704067300' ORDER BY ts""")
def src_slack_jdbc(spark, sf):
    return chat_joined(spark, sf, "1704067300").orderBy("ts")


def chat_joined(spark, sf, start=None):
    base = fixtures.chat(spark, sf).select(
        "ts", "message", "thread_ts", F.expr("substring(channel_id, 3)").alias("channel_id"), "user_id")
    kinds = table(spark, sf, "events").select("event_type").distinct()
    channel = kinds.select(F.col("event_type").alias("id"), F.concat(F.lit("C-"), "event_type")
                           .alias("channel_id"), F.upper("event_type").alias("team_id"))
    team = kinds.select(F.upper("event_type").alias("id"), F.concat(F.lit("T-"), "event_type").alias("team_id"))
    user = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("email_id"), F.col("c_name").alias("display_name"),
        F.col("c_mktsegment").alias("username"))
    return chat.chat_messages(base, channel, team, user, start=start)


@query("join_slack_dims", """
SELECT o_orderkey, c_name, n_name, r_name FROM orders
LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN region ON n_regionkey = r_regionkey""")
def join_slack_dims(spark, sf):
    t = lambda n: table(spark, sf, n)
    out = joins.small_left_join(
        t("orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")),
        t("customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("n_nationkey")), "c_custkey")
    out = joins.small_left_join(out, t("nation").select(
        "n_nationkey", "n_name", F.col("n_regionkey").alias("r_regionkey")), "n_nationkey")
    out = joins.small_left_join(out, t("region").select("r_regionkey", "r_name"), "r_regionkey")
    return out.select("o_orderkey", "c_name", "n_name", "r_name")


# Paper metadata: a part is a row of the list; brands share file names, the last wins.
def paper_meta(spark, sf):
    return table(spark, sf, "part").select(
        F.when(F.col("p_type") != "SMALL", F.concat(F.lit("papers/"), "p_name", F.lit(".md"))).alias("local_path"),
        F.concat("p_brand", F.lit(".md")).alias("filename"),
        F.concat(F.lit("http://papers.example.org/"), "p_partkey").alias("url"),
        F.when(F.col("p_size") > 10, F.concat("p_name", F.lit(","), "p_brand")).otherwise("").alias("author"),
        F.when(F.col("p_size") > 5, F.col("p_type")).otherwise("").alias("title"),
        F.lit("2024-01-15").alias("date"), F.col("p_partkey").alias("row_order"))


SQL_PAPER_INDEX = """meta AS (
  SELECT CASE WHEN p_type <> 'SMALL' THEN 'papers/' || p_name || '.md' ELSE '' END AS local_path, p_brand || '.md' AS filename,
    'http://papers.example.org/' || p_partkey AS url, CASE WHEN p_size > 10 THEN p_name || ',' || p_brand ELSE '' END AS author,
    CASE WHEN p_size > 5 THEN p_type ELSE '' END AS title, p_partkey AS ord FROM part),
keyed AS (SELECT local_path AS key, * FROM meta WHERE local_path <> '' UNION ALL
  SELECT filename, * FROM meta WHERE filename <> local_path),
paper_index AS (SELECT key, url, author, title FROM keyed QUALIFY row_number() OVER (PARTITION BY key ORDER BY ord DESC) = 1)"""


@query("src_wg21_csv", f"WITH {SQL_PAPER_INDEX} SELECT key, url, coalesce(author, '') AS author, title FROM paper_index")
def src_wg21_csv(spark, sf):
    path = scratch_path(spark, "papers")
    rows = paper_meta(spark, sf).withColumn("row_order", F.format_string("%012d", "row_order"))
    # The list is written in order of its rows and read back with that order kept.
    rows.sort("row_order").write.option("header", True).csv(path)
    read = spark.read.option("header", True).csv(path).withColumn("row_order", F.col("row_order").cast("long"))
    return parsers.paper_index(read).select(
        "key", "url", F.coalesce("author", F.lit("")).alias("author"),
        F.coalesce("title", F.lit("")).alias("title"))


def papers(spark, sf):
    """Texts placed under a path that is listed, under a listed name only, or nowhere."""
    return table(spark, sf, "documents").select(
        "doc_id",
        F.expr("CASE lang WHEN 'en' THEN 'papers/red widget.md' WHEN 'de' THEN concat('x/', source, '/Brand#', doc_id, '.md') "
               "ELSE concat('y/', doc_id, '.md') END").alias("relative"), "text")


SQL_PAPERS = """papers AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'papers/red widget.md'
    WHEN 'de' THEN 'x/' || source || '/Brand#' || doc_id || '.md' ELSE 'y/' || doc_id || '.md' END AS relative, text FROM documents),
named AS (SELECT *, string_split(relative, '/')[-1] AS filename FROM papers)"""


def named_papers(spark, sf):
    return papers(spark, sf).withColumn("filename", F.element_at(F.split("relative", "/"), -1))


@query("join_paper_meta", f"""WITH {SQL_PAPER_INDEX}, {SQL_PAPERS}
SELECT doc_id, coalesce(a.url, b.url) AS url FROM named LEFT JOIN paper_index a ON a.key = relative
LEFT JOIN paper_index b ON b.key = filename WHERE a.key IS NOT NULL OR b.key IS NOT NULL""")
def join_paper_meta(spark, sf):
    index = parsers.paper_index(paper_meta(spark, sf))
    return joins.paper_metadata(named_papers(spark, sf), index).select("doc_id", "url")


@query("wg21_documents", f"""WITH {SQL_PAPER_INDEX}, {SQL_PAPERS},
m AS (SELECT named.*, coalesce(a.url, b.url) AS url, CASE WHEN a.key IS NOT NULL THEN a.author ELSE b.author END AS author,
  CASE WHEN a.key IS NOT NULL THEN a.title ELSE b.title END AS title
  FROM named LEFT JOIN paper_index a ON a.key = relative
  LEFT JOIN paper_index b ON b.key = filename WHERE (a.key IS NOT NULL OR b.key IS NOT NULL) AND length({duck.strip('text')}) >= 50)
SELECT regexp_replace(filename, '[.]md$', '') AS document_number, 'wg21' AS type,
  CASE WHEN title = '' THEN regexp_replace(filename, '[.]md$', '') ELSE title END AS title,
  CASE WHEN author = '' THEN ['unknown'] ELSE string_split(author, ',') END AS author,
  1705276800.0::DOUBLE AS timestamp, url, text FROM m""")
def wg21_documents(spark, sf):
    index = parsers.paper_index(paper_meta(spark, sf))
    return documents.paper_documents(named_papers(spark, sf), index)


@query("src_paper_text", "SELECT text || chr(10) AS value FROM benchmark")
def src_paper_text(spark, sf):
    """Round trip: every text becomes a file of its own, the files are read back whole."""
    path = scratch_path(spark, "texts")
    table(spark, sf, "benchmark").select("text").write.option("maxRecordsPerFile", 1).text(path)
    return files.read_files(spark, path, ".md", ".asc", ".txt").select("value")


def blog_files(spark, sf):
    """Texts as blog records; address, date and body sit under changing keys."""
    record = F.expr(
        "to_json(named_struct('link', CASE lang WHEN 'en' THEN concat('http://b.example.org/', doc_id, '.html.html') WHEN 'fr' THEN '' END,"
        " 'url', CASE lang WHEN 'de' THEN concat('http://b.example.org/', doc_id) END,"
        " 'title', concat('  Post ', doc_id), 'author', CASE source WHEN 'src1' THEN NULL ELSE source END,"
        " 'published_parsed', CASE lang WHEN 'en' THEN '2024-01-05' ELSE '' END,"
        " 'content', CASE lang WHEN 'en' THEN text END, 'summary', text))")
    return table(spark, sf, "documents").select(
        F.concat(F.lit("/blog/site_2023_07_"), F.lpad((F.col("n_chars") % 28 + 1).cast("string"), 2, "0"),
                 F.lit("_"), "doc_id", F.lit(".json")).alias("path"), record.alias("value"))


@query("src_blog_json", """
SELECT CASE lang WHEN 'en' THEN 'http://b.example.org/' || doc_id || '.html.html' WHEN 'de' THEN 'http://b.example.org/' || doc_id END AS url,
  '  Post ' || doc_id AS title, CASE source WHEN 'src1' THEN NULL ELSE source END AS author,
  CASE lang WHEN 'en' THEN '2024-01-05' ELSE '' END AS published_parsed, nullif(text, '') AS content FROM documents""")
def src_blog_json(spark, sf):
    return parsers.blog_posts(blog_files(spark, sf)).drop("path")


@query("blog_documents", f"""
SELECT 'http://b.example.org/' || doc_id || CASE lang WHEN 'en' THEN '.html' ELSE '' END AS url, 'Post ' || doc_id AS title,
  CASE source WHEN 'src1' THEN '' ELSE source END AS author,
  (CASE lang WHEN 'en' THEN 1704412800 ELSE epoch(make_date(2023, 7, (n_chars % 28 + 1)::INTEGER)) END)::DOUBLE AS timestamp,
  'blog-html' AS type, {duck.strip('text')} AS text FROM documents
WHERE lang IN ('en', 'de') AND length({duck.strip('text')}) >= 50""")
def blog_documents(spark, sf):
    return documents.blog_documents(parsers.blog_posts(blog_files(spark, sf)))


def video_files(spark, sf):
    record = F.expr(
        "to_json(named_struct('title', concat('Talk ', doc_id), 'description', text, 'channel_title', source,"
        " 'published_at', '2024-01-05T10:00:00Z', 'duration_seconds', n_chars, 'view_count', concat(n_chars, 'K'),"
        " 'like_count', doc_id, 'tags', array(lang, 'C++ lambda'), 'search_term', CASE lang WHEN 'en' THEN 'C++17' ELSE '' END))")
    return table(spark, sf, "documents").select(
        F.concat(F.lit("/meta/"), "doc_id", F.lit(".json")).alias("path"), record.alias("value"))


@query("src_video_json", """
SELECT doc_id::VARCHAR AS video_id, 'Talk ' || doc_id AS title, source AS channel_title, n_chars::VARCHAR AS duration_seconds,
  n_chars || 'K' AS view_count, [lang, 'C++ lambda'] AS tags, CASE lang WHEN 'en' THEN 'C++17' ELSE '' END AS search_term FROM documents""")
def src_video_json(spark, sf):
    return parsers.video_metadata(video_files(spark, sf)).select(
        "video_id", "title", "channel_title", "duration_seconds", "view_count", "tags", "search_term")


def transcripts(spark, sf):
    """One subtitle text per conversation, one cue per turn; system turns roll."""
    clock = lambda c: F.concat(
        F.lpad(F.floor(c / 3600).cast("string"), 2, "0"), F.lit(":"),
        F.lpad(F.floor(c % 3600 / 60).cast("string"), 2, "0"), F.lit(":"),
        F.lpad((c % 60).cast("string"), 2, "0"), F.lit(".250"))
    start = F.col("turn") * 7
    cue = F.concat(
        clock(start), F.lit(" --> "), clock(start + 7),
        F.when(F.col("role") == "system", " align:start position:0%\n").otherwise("\n"),
        text.squeeze(F.col("text")), F.lit("\n"),
        F.when(F.col("role") == "system", "rolling\n").otherwise(F.lit("\n")), F.lit("\n"))
    return (
        table(spark, sf, "conversations").groupBy(F.concat(F.lit("v"), "conv_id").alias("video_id"))
        .agg(F.array_sort(F.collect_list(F.struct("turn", cue.alias("cue")))).alias("c"))
        .select("video_id", F.concat(F.lit("WEBVTT\n\n"), F.array_join(
            F.transform("c", lambda x: x["cue"]), "")).alias("value")))


SQL_CUES = f"""cues AS (
  SELECT 'v' || conv_id AS video_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS pos,
    turn * 7 + 0.25::DOUBLE AS start_time, turn * 7 + 7.25::DOUBLE AS end_time, {duck.squeeze('text')} AS text
  FROM conversations WHERE role <> 'system' AND {duck.squeeze('text')} <> '')"""


@query("src_vtt", f"WITH {SQL_CUES} SELECT * FROM cues")
def src_vtt(spark, sf):
    return parsers.transcript_cues(transcripts(spark, sf))


@query("src_pdf_pages", f"""
SELECT 'https://papers.example.org/c' || conv_id || '.pdf#p' || count(*) AS doc_id, 'blog-pdf' AS type, 'ann' AS author,
  'Title ' || conv_id AS title, 'https://papers.example.org/c' || conv_id || '.pdf' AS url, count(*) AS total_pages,
  1704067200.0::DOUBLE AS timestamp, chr(10) || string_agg(text, chr(10) ORDER BY turn) AS text
FROM conversations GROUP BY conv_id HAVING length({duck.strip("string_agg(text, chr(10) ORDER BY turn)")}) >= 30""")
def src_pdf_pages(spark, sf):
    pages = table(spark, sf, "conversations").select(
        F.concat(F.lit("/pdf/c"), "conv_id", F.lit("&&Title "), "conv_id", F.lit(".pdf")).alias("file"),
        F.col("turn").alias("page"), "text", F.lit("D:20240101120000").alias("created"))
    return parsers.paged_documents(pages, "https://papers.example.org", "ann")


SQL_API_PAGES = """
WITH e AS (SELECT event_id, event_type AS feed, 100000000 - event_id AS pos,
  CASE WHEN value >= 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS date FROM events),
s AS (SELECT feed, min(pos) AS stop FROM e WHERE date < '2024-01-08' GROUP BY feed)
SELECT event_id, feed, date FROM e LEFT JOIN s USING (feed)
WHERE (stop IS NULL OR pos < stop) AND (date IS NULL OR date <= '2024-01-20T12:00:00')"""


@query("src_api_pages", SQL_API_PAGES)
def src_api_pages(spark, sf):
    items = table(spark, sf, "events").select(
        "event_id", F.col("event_type").alias("feed"), (F.lit(100000000) - F.col("event_id")).alias("pos"),
        F.when(F.col("value") >= 1, F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")).alias("date"))
    return parsers.api_window(items, "2024-01-08", "2024-01-20T12:00:00").select("event_id", "feed", "date")


@query("src_fetched_pages", SQL_API_PAGES)
def src_fetched_pages(spark, sf):
    """The same listing from pages of 500 items that lie in a folder, read by the data source for fetched pages."""
    folder = scratch_path(spark, "fetched")
    pos = F.lit(100000000) - F.col("event_id")
    listing = table(spark, sf, "events").select(
        F.col("event_type").alias("feed"), F.floor(F.col("event_id") / 500).alias("page"), F.to_json(F.struct(
            "event_id", pos.alias("pos"), F.when(F.col("value") >= 1, F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")).alias("date")
        )).alias("value"))
    # each task puts its own files in place: there is one for every page, too many for the driver to move one by one
    listing.repartition("feed", "page").write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy(
        "feed", "page").text(folder)
    items = fetched_pages.read_pages(spark, folder).select(
        "feed", F.from_json("item", "event_id long, pos long, date string").alias("i")).select("feed", "i.*")
    return parsers.api_window(items, "2024-01-08", "2024-01-20T12:00:00").select("event_id", "feed", "date")


@query("src_format_email", f"""WITH {fixtures.SQL_MAIL}
SELECT msg_id, parent_id, thread_id, subject, content, list_name, sent_at,
  CASE WHEN conv_id % 5 = 0 THEN '' ELSE sender_address END AS sender_address,
  CASE WHEN conv_id % 5 = 0 THEN '' ELSE 'mm' || turn END AS sender_mailman_id, 'N' || turn AS sender_name FROM mail""")
def src_format_email(spark, sf):
    base = F.concat(F.lit("https://x.example.org/archives/api/list/"), "list_name")
    raw = fixtures.mail(spark, sf).select(
        F.col("msg_id").alias("message_id_hash"),
        F.when(F.col("parent_id") != "", F.concat(base, F.lit("/email/"), "parent_id", F.lit("/"))).alias("parent"),
        F.concat(base, F.lit("/thread/"), "thread_id", F.lit("/")).alias("thread"), "subject", "content",
        F.col("sent_at").alias("date"),
        F.when(F.col("conv_id") % 5 != 0, F.struct(
            F.replace("sender_address", F.lit("@"), F.lit(" (a) ")).alias("address"),
            F.concat(F.lit("mm"), "turn").alias("mailman_id"))).alias("sender"),
        F.concat(F.lit("N"), "turn").alias("sender_name"), F.concat(base, F.lit("/emails/")).alias("source_url"))
    return parsers.api_mail(raw, F.col("source_url"))


@query("src_format_video", """
SELECT 'v' || doc_id AS video_id, 'Talk ' || doc_id AS title, text AS description, source AS channel_id, '' AS channel_title,
  '2024-01-05T10:00:00Z' AS published_at, 'PT' || n_chars || 'S' AS duration_iso, n_chars AS duration_seconds,
  n_chars AS view_count, 0::BIGINT AS like_count, 0::BIGINT AS comment_count, CASE lang WHEN 'en' THEN [lang, source] ELSE []::VARCHAR[] END AS tags,
  'https://www.youtube.com/watch?v=v' || doc_id AS url FROM documents""")
def src_format_video(spark, sf):
    raw = table(spark, sf, "documents").select(
        F.concat(F.lit("v"), "doc_id").alias("id"),
        F.struct(F.concat(F.lit("Talk "), "doc_id").alias("title"), F.col("text").alias("description"),
                 F.col("source").alias("channelId"), F.lit(None).cast("string").alias("channelTitle"),
                 F.lit("2024-01-05T10:00:00Z").alias("publishedAt"),
                 F.when(F.col("lang") == "en", F.array("lang", "source")).alias("tags")).alias("snippet"),
        F.struct(F.col("n_chars").cast("string").alias("viewCount"), F.lit(None).cast("string").alias("likeCount"),
                 F.lit("x").alias("commentCount")).alias("statistics"),
        F.struct(F.concat(F.lit("PT"), "n_chars", F.lit("S")).alias("duration")).alias("contentDetails"))
    return parsers.api_video(raw)


@query("src_file_stats", """SELECT CASE lang WHEN 'en' THEN '.txt' WHEN 'de' THEN '.md' WHEN 'fr' THEN '' ELSE '.' || lang END AS extension,
  count(*) AS files, sum(n_chars)::BIGINT AS bytes FROM documents GROUP BY 1""")
def src_file_stats(spark, sf):
    """Over a listing derived from the documents, one path each."""
    end = (F.when(F.col("lang") == "en", ".TXT").when(F.col("lang") == "de", ".tar.md").when(F.col("lang") == "fr", "")
           .otherwise(F.concat(F.lit("."), "lang")))
    return files.file_stats(table(spark, sf, "documents").select(
        F.concat(F.lit("/data/v1.2/"), "source", F.lit("/"), "doc_id", end).alias("path"), F.col("n_chars").alias("length")))


# --- ids and documents -----------------------------------------------------------
@query("mail_documents", f"""WITH {fixtures.SQL_MAIL}
SELECT list_name || '/message/' || msg_id AS doc_id, 'mailing' AS type, list_name || '/thread/' || thread_id AS thread_id,
  subject, sender_address AS author, epoch(sent_at::TIMESTAMP) AS timestamp, parent_id, {duck.clean_text('content')} AS text
FROM mail WHERE length({duck.clean_text('content')}) >= 20""")
def mail_documents(spark, sf):
    return documents.mail_documents(fixtures.mail(spark, sf))


@query("mail_documents_local", f"""WITH {fixtures.SQL_MAIL},
h AS (SELECT conv_id, arg_min(thread_url, turn) AS thread_id, arg_min(subject, turn) AS subject FROM mail GROUP BY conv_id)
SELECT md5(message_url) AS doc_id, CASE WHEN turn = 0 THEN '@@X' ELSE '@@MailingList@@' || msg_id END AS source, 'mail' AS type,
  h.thread_id, h.subject, sender_address AS author, 'Unknown' AS date, message_url AS url, {duck.squeeze('content')} AS text
FROM mail JOIN h USING (conv_id) WHERE length({duck.squeeze('content')}) > 20""")
def mail_documents_local(spark, sf):
    m = fixtures.mail(spark, sf).withColumn(
        "message_id", F.when(F.col("turn") == 0, "@@X").otherwise(F.col("msg_id"))).withColumn(
        "subject", F.when(F.col("turn") == 0, F.col("subject")).otherwise("Re"))
    return documents.mail_documents_local(m, "conv_id", "turn")


@query("id_from_url", f"""WITH {fixtures.SQL_MAIL}
SELECT msg_id, list_name || '/message/' || msg_id AS message, list_name || '/thread/' || thread_id AS thread FROM mail""")
def id_from_url(spark, sf):
    return fixtures.mail(spark, sf).select(
        "msg_id", ids.id_from_url(F.col("message_url")).alias("message"),
        ids.id_from_url(F.col("thread_url")).alias("thread"))


@query("typed_id_from_url", f"""WITH {fixtures.SQL_MAIL}
SELECT msg_id, 'message/' || msg_id AS message, 'thread/' || thread_id AS thread, list_name AS list FROM mail
UNION ALL SELECT url, NULL, NULL, string_split(url, '/')[1] FROM pages""")
def typed_id_from_url(spark, sf):
    a = fixtures.mail(spark, sf).select(
        "msg_id", ids.typed_id_from_url(F.col("message_url")).alias("message"),
        ids.typed_id_from_url(F.col("thread_url")).alias("thread"),
        ids.list_name_from_url(F.col("message_url")).alias("list"))
    url = F.col("url")
    b = table(spark, sf, "pages").select(
        url.alias("msg_id"), ids.typed_id_from_url(url).alias("message"),
        ids.typed_id_from_url(url).alias("thread"), ids.list_name_from_url(url).alias("list"))
    return a.unionByName(b)


@query("thread_info", f"""WITH {fixtures.SQL_MAIL}
SELECT thread_id, min(list_name) AS list_name, min(subject) AS subject, min(sent_at) AS sent_at FROM mail GROUP BY thread_id""")
def thread_info(spark, sf):
    return documents.thread_info(fixtures.mail(spark, sf))


@query("wg21_doc_number", """
WITH t AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'Document number: P' || (1000 + page_id) || 'R1' WHEN page_id % 5 = 1 THEN 'see n4' || lpad(page_id::VARCHAR, 3, '0') || ' : x'
  WHEN page_id % 5 = 2 THEN 'Paper P9' || lpad(page_id::VARCHAR, 3, '0') WHEN page_id % 5 = 3 THEN 'the PROPOSAL  n8' || lpad(page_id::VARCHAR, 3, '0') ELSE 'none' END AS c, url FROM pages)
SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'P' || (1000 + page_id) || 'R1' WHEN page_id % 5 = 1 THEN 'n4' || lpad(page_id::VARCHAR, 3, '0')
  WHEN page_id % 5 = 2 THEN 'P9' || lpad(page_id::VARCHAR, 3, '0') WHEN page_id % 5 = 3 THEN 'n8' || lpad(page_id::VARCHAR, 3, '0') END AS number,
  CASE WHEN page_id % 5 = 4 THEN url ELSE 'wg21/' || CASE WHEN page_id % 5 = 0 THEN 'P' || (1000 + page_id) || 'R1' WHEN page_id % 5 = 1 THEN 'n4' || lpad(page_id::VARCHAR, 3, '0')
  WHEN page_id % 5 = 2 THEN 'P9' || lpad(page_id::VARCHAR, 3, '0') ELSE 'n8' || lpad(page_id::VARCHAR, 3, '0') END END AS paper_id FROM t""")
def wg21_doc_number(spark, sf):
    content = F.expr(
        "CASE page_id % 5 WHEN 0 THEN concat('Document number: P', 1000 + page_id, 'R1') "
        "WHEN 1 THEN concat('see n4', lpad(page_id, 3, '0'), ' : x') WHEN 2 THEN concat('Paper P9', lpad(page_id, 3, '0')) "
        "WHEN 3 THEN concat('the PROPOSAL  n8', lpad(page_id, 3, '0')) ELSE 'none' END")
    number = ids.paper_number(content)
    return table(spark, sf, "pages").select(
        "page_id", number.alias("number"), ids.paper_id(F.col("url"), F.lit("x.md"), number).alias("paper_id"))


@query("blog_pdf_normalize")
def blog_pdf_normalize(spark, sf):
    broken = F.concat(F.lit("1. Abstract\n"), F.regexp_replace("text", "ing ", "in- \n  g "),
                      F.lit("\n  Related Work \nend-"))
    return table(spark, sf, "documents").select("doc_id", text.normalize_paper(broken).alias("text"))


@query("author_source_url", """
WITH c AS (SELECT c_custkey, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'Bjarne Stroustrup' WHEN 'MACHINERY' THEN 'SUTTER'
  WHEN 'FURNITURE' THEN 'j boccara' WHEN 'BUILDING' THEN 'Grimm, R' ELSE c_mktsegment END AS a FROM customer)
SELECT c_custkey, CASE WHEN a ILIKE '%stroustrup%' THEN 'https://stroustrup.com' WHEN a ILIKE '%sutter%' THEN 'https://herbsutter.com'
  WHEN a ILIKE '%boccara%' THEN 'https://www.fluentcpp.com' WHEN a ILIKE '%grimm%' THEN 'https://www.modernescpp.com'
  WHEN a ILIKE '%niebler%' THEN 'https://ericniebler.com' ELSE 'https://example.com' END AS site FROM c""")
def author_source_url(spark, sf):
    name = F.expr("CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'Bjarne Stroustrup' WHEN 'MACHINERY' THEN 'SUTTER' "
                  "WHEN 'FURNITURE' THEN 'j boccara' WHEN 'BUILDING' THEN 'Grimm, R' ELSE c_mktsegment END")
    return table(spark, sf, "customer").select("c_custkey", ids.author_site(name).alias("site"))


@query("library_from_path", """SELECT page_id, CASE WHEN regexp_matches(url, '/en/') THEN regexp_extract(url, '/en/([^/]*)', 1)
  ELSE 'unknown' END AS library FROM pages""")
def library_from_path(spark, sf):
    return table(spark, sf, "pages").select("page_id", ids.library_from_path(F.col("url")).alias("library"))


@query("chunk_record_id", f"""
SELECT doc_id, md5(doc_id || '_' || 0) AS by_place, md5(source || '_' || substring(t, 1, 50) || '_' || length(t)) AS by_text
FROM (SELECT doc_id, source, 'Title: ' || lang || chr(10) || chr(10) || {duck.strip('text')} AS t FROM documents)""")
def chunk_record_id(spark, sf):
    titled = ids.title_prefix(F.col("lang"), text.strip(F.col("text")))
    return table(spark, sf, "documents").select(
        "doc_id", ids.chunk_record_id(F.col("doc_id").cast("string"), F.lit(0), titled).alias("by_place"),
        ids.chunk_record_id(F.col("source"), F.lit(None).cast("int"), titled).alias("by_text"))


@query("title_prefix", """SELECT doc_id, CASE WHEN lang = 'en' THEN text ELSE 'Title: ' || lang || chr(10) || chr(10) || text END AS titled
FROM documents""")
def title_prefix(spark, sf):
    title = F.when(F.col("lang") != "en", F.col("lang")).otherwise("")
    return table(spark, sf, "documents").select(
        "doc_id", ids.title_prefix(title, F.col("text")).alias("titled"))


@query("tool_doc_entry", f"""
SELECT source AS tool_name, 'docs/' || doc_id || '.md' AS file_path,
  CASE lang WHEN 'en' THEN 'ns-1-ide' WHEN 'de' THEN 'ns-2-build' WHEN 'fr' THEN 'ns-3-package' END AS namespace,
  sha256(text) AS hash, '{fixtures.AS_OF}' AS build_time FROM documents""")
def tool_doc_entry(spark, sf):
    rows = table(spark, sf, "documents").select(
        F.col("source").alias("tool_name"), F.col("lang").alias("category"),
        F.concat(F.lit("docs/"), "doc_id", F.lit(".md")).alias("file_path"), "text")
    categories = spark.createDataFrame(
        [("en", "ns-1-ide"), ("de", "ns-2-build"), ("fr", "ns-3-package")], "category string, namespace string")
    return documents.tool_entries(rows, categories, fixtures.AS_OF).drop("text")


@query("reference_url", """
SELECT event_id, CASE event_type WHEN 'click' THEN 'https://lists.boost.org/archives/list/' || event_id || '.5/'
  WHEN 'view' THEN 'https://app.slack.com/T1/C' || user_id || '/p' || event_id || '5'
  WHEN 'error' THEN 'https://wg21.link/' || event_id || '.5' ELSE event_id || '.5' END AS url FROM events""")
def reference_url(spark, sf):
    ns = F.expr("CASE event_type WHEN 'click' THEN 'mailing' WHEN 'view' THEN 'slack' WHEN 'error' THEN 'wg21' "
                "ELSE 'documentation' END")
    return table(spark, sf, "events").select("event_id", ids.reference_url(
        ns, F.concat("event_id", F.lit(".5")), F.lit(""), F.lit("T1"), F.concat(F.lit("C"), "user_id")).alias("url"))


# --- joins and sets -----------------------------------------------------------------
@query("join_video_meta", """SELECT doc_id, n_chars, label FROM documents JOIN embeddings ON vec_id = doc_id""")
def join_video_meta(spark, sf):
    meta = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    return table(spark, sf, "documents").select("doc_id", "n_chars").join(meta, "doc_id")


@query("semi_requested_ids", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_requested_ids(spark, sf):
    return joins.only_ids(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels"), "doc_id")


@query("anti_missing_content", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def anti_missing_content(spark, sf):
    have = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return joins.without_ids(table(spark, sf, "documents").select("doc_id", "lang"), have, "doc_id")


@query("anti_visited", """SELECT DISTINCT c_custkey AS user_id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)""")
def anti_visited(spark, sf):
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id")).distinct()
    return joins.without_ids(users, table(spark, sf, "events"), "user_id")


@query("split_new_existing", """SELECT d.doc_id, md5(d.doc_id::VARCHAR) || '-000' AS first_chunk, l.doc_id IS NOT NULL AS "exists"
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def split_new_existing(spark, sf):
    flagged = joins.flag_existing(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")
    return flagged.select("doc_id", ids.local_chunk_id(F.col("doc_id").cast("string"), F.lit(0)).alias("first_chunk"), "exists")


@query("union_sources", """SELECT doc_id::VARCHAR AS id, text, lang, NULL AS role FROM documents
UNION ALL SELECT conv_id || '-' || turn, text, NULL, role FROM conversations""")
def union_sources(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", "lang")
    talk = table(spark, sf, "conversations").select(
        F.concat("conv_id", F.lit("-"), "turn").alias("id"), "text", "role")
    return joins.union_all(docs, talk)


@query("distinct_terms", f"""
WITH t AS (SELECT p_name AS term FROM part UNION SELECT p_brand FROM part UNION SELECT p_type FROM part UNION SELECT event_type FROM events)
SELECT term, CASE WHEN term IN ('red widget', 'small ring') THEN 'channel' WHEN term IN ('SMALL', 'click') THEN 'playlist' ELSE 'video' END AS kind FROM t""")
def distinct_terms(spark, sf):
    part, events = table(spark, sf, "part"), table(spark, sf, "events")
    terms = joins.union_all(*[part.select(F.col(c).alias("term")) for c in ("p_name", "p_brand", "p_type")],
                            events.select(F.col("event_type").alias("term"))).distinct()
    return terms.select("term", joins.search_kind(
        F.col("term"), ["red widget", "small ring"], ["SMALL", "click"]).alias("kind"))


@query("id_set_stats", """SELECT count(d.doc_id) AS left_ids, count(e.vec_id) AS right_ids,
  count(CASE WHEN d.doc_id IS NOT NULL AND e.vec_id IS NOT NULL THEN 1 END) AS both_ids, count(*) AS all_ids
FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT vec_id FROM embeddings) e ON d.doc_id = e.vec_id""")
def id_set_stats(spark, sf):
    return joins.id_set_stats(
        table(spark, sf, "documents").select("doc_id"),
        table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id")
