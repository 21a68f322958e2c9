"""Ordering, grouping, chunking, store and sources against plain references."""

import json
import random

import numpy as np
from pyspark.sql import functions as F

from threadloom.operators import chunking, grouping, incremental, ordering, store
from threadloom.session import scratch_path
from threadloom.sources import files, parsers


def test_quantiles_and_sums_under_skew(spark):
    rng = np.random.default_rng(42)
    rows = [("hot", float(v)) for v in rng.lognormal(0, 2, 3000)] + [("one", 5.0)] + [("flat", 1.0)] * 50
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r for r in ordering.exact_quantiles(df, ["k"], "v", [0.0, 0.5, 0.95, 1.0]).collect()}
    for k in ("hot", "one", "flat"):
        want = np.percentile([v for kk, v in rows if kk == k], [0, 50, 95, 100])
        assert np.allclose([got[k][f"q{i}"] for i in range(4)], want)
    seq = spark.range(500).withColumn("k", F.lit("a"))
    summed = ordering.running_sum(seq, ["k"], [F.col("id")], F.floor(F.col("id") / 7), F.col("id"), "s").collect()
    assert all(r["s"] == r["id"] * (r["id"] + 1) // 2 for r in summed)
    numbered = ordering.row_number(seq, ["k"], [F.col("id")], F.floor(F.col("id") / 7), "n").collect()
    assert all(r["n"] == r["id"] + 1 for r in numbered)
    prev = ordering.previous(seq, ["k"], F.col("id"), F.floor(F.col("id") / 7), {"p": "id"}).collect()
    assert all(r["p"] == (r["id"] - 1 if r["id"] else None) for r in prev)


def plain_groups(rows):
    """Both passes, message by message: rows are (t, id, user)."""
    first = []
    for t, i, user in sorted(rows):
        g = first[-1] if first else None
        if g and g["user"] == user and 0 < t - g["start"] <= 3600:
            g["ids"].append(i)
            g["last"] = t
        else:
            first.append({"user": user, "start": t, "last": t, "ids": [i]})
    second = []
    for g in first:
        cur = second[-1] if second else None
        if cur and 0 < g["last"] - cur["start"] <= 3600:
            cur["ids"] += g["ids"]
        else:
            second.append({**g, "ids": list(g["ids"])})
    return sorted(g["ids"] for g in first), sorted(g["ids"] for g in second)


def chat(spark, rows):
    return spark.createDataFrame(
        [(i, f"{t:.1f}", None, "T", c, "said a thing of note", float(t), u) for c, t, i, u in rows],
        "id string, ts string, thread_ts string, team_id string, channel_id string, msg string, t double, user string")


def test_groups_by_both_ways(spark):
    random.seed(42)
    rows = []
    for channel in ("a", "b"):
        t = 1_700_000_000
        for n in range(250):
            t += random.choice([0, 1, 600, 1799, 3600, 3601, 5000])
            rows.append((channel, t, f"{channel}{n:04d}", random.choice("xxxy")))
    rows += [("c", 1_700_000_000 + gap, f"c{n}", "x") for n, gap in enumerate([0, 0, 1, 3600, 3601, 7201])]
    messages = chat(spark, rows)
    want = [plain_groups([(t, i, u) for c, t, i, u in rows if c == channel]) for channel in "abc"]
    for limit in (100_000, 0):
        first = grouping.user_groups(messages, limit)
        second = grouping.consecutive_groups(first, limit)
        assert sorted(r["message_ids"] for r in first.collect()) == sorted(sum([w[0] for w in want], []))
        assert sorted(r["message_ids"] for r in second.collect()) == sorted(sum([w[1] for w in want], []))


def test_thread_named_by_dropped_message(spark):
    rows = spark.createDataFrame(
        [("1", "1.0", "9", "T", "C", "short", 1.0, "ann"), ("2", "2.0", "9", "T", "C", "long enough text", 2.0, "bob"),
         ("3", "3.0", "8", "T", "C", "", 3.0, "bob")],
        "id string, ts string, thread_ts string, team_id string, channel_id string, msg string, t double, user string")
    (got,) = grouping.thread_groups(rows).collect()
    assert (got["id"], got["user_name"], got["message_ids"], got["text"]) == ("1", "ann", ["2"], "long enough text")


def test_recursive_chunks():
    random.seed(1)
    for _ in range(50):
        # No two words are alike, so a chunk can only be found where it was cut.
        text = "".join(f"w{n}" + random.choice([" ", "x" * 30, "\n", "\n\n", "é, "]) for n in range(random.randint(0, 300)))
        for size, overlap in ((100, 20), (50, 0)):
            chunks = chunking.split_text(text, size, overlap)
            assert all(c == text[at:at + len(c)] and 0 < len(c) <= size for at, c in chunks)
            covered = set()
            for at, c in chunks:
                covered.update(range(at, at + len(c)))
            assert all(ch.isspace() for n, ch in enumerate(text) if n not in covered)
    assert chunking.split_text("aaa bbb\n\nccc", 7, 3) == [(0, "aaa bbb"), (9, "ccc")]


def test_cue_chunks(spark):
    cues = [("v", n, float(n), n + 1.0, "x" * 100) for n in range(25)] + [("w", 0, 0.0, 9.0, "y" * 1200), ("w", 1, 9.0, 10.0, "z")]
    df = spark.createDataFrame(cues, "video_id string, pos int, start_time double, end_time double, text string")
    got = {(r["video_id"], r["i"]): (r["start_time"], r["end_time"]) for r in chunking.cues(df).collect()}
    # a start once more than 700 characters lie before it, an end once a chunk exceeds 900
    assert got == {("v", 0): (0.0, 10.0), ("v", 1): (8.0, 18.0), ("v", 2): (16.0, 25.0),
                   ("w", 0): (0.0, 9.0), ("w", 1): (9.0, 10.0)}
    said = [("v", 0, 1.0, 2.0, "One is here. " + "a" * 300 + ". Tail"), ("v", 1, 5.0, 6.0, "b" * 200 + "."), ("v", 2, 8.0, 9.0, "End.")]
    blocks = chunking.sentences(spark.createDataFrame(said, df.schema)).orderBy("i").collect()
    assert [(r["start_time"], len(r["text"])) for r in blocks] == [(1.0, 13 + 301 + 5 + 1 + 201 + 5)]


def test_store_is_idempotent(spark):
    cols = "namespace string, id string, text string"
    chunks = store.ChunkStore(spark, scratch_path(spark, "t"), cols, buckets=2)
    chunks.create(spark.createDataFrame([("a", "1", "x"), ("b", "2", "y")], cols))
    batch = spark.createDataFrame([("a", "1", "old", 1), ("a", "1", "new", 2), ("c", "3", "z", 1)], cols + ", ord int")
    for _ in range(2):
        chunks.upsert(batch, "ord")
        assert sorted(map(tuple, chunks.read().collect())) == [("a", "1", "new"), ("b", "2", "y"), ("c", "3", "z")]
    chunks.upsert(batch.filter("false"), "ord")
    chunks.delete_ids(spark.createDataFrame([("a", "1"), ("a", "none")], "namespace string, id string"))
    chunks.delete_namespace("c")
    assert sorted(map(tuple, chunks.read().collect())) == [("b", "2", "y")]


def test_size_cap_keeps_newest(spark):
    rows = spark.createDataFrame([("k", n, 10) for n in range(20)], "k string, t long, size long")
    kept = incremental.newest_within(rows, ["k"], "size", -F.col("t"), F.floor(-F.col("t") / 3), 55)
    assert sorted(r["t"] for r in kept.collect()) == [15, 16, 17, 18, 19]


def test_file_sources(spark, tmp_path):
    (tmp_path / "mail" / "deep").mkdir(parents=True)
    (tmp_path / "mail" / "a.json").write_text(json.dumps([{"msg_id": "1", "content": "x"}]))
    (tmp_path / "mail" / "deep" / "b.json").write_text(json.dumps({"messages": [{"msg_id": "2"}, {"msg_id": "3"}]}))
    mail = parsers.mail_messages(files.read_files(spark, str(tmp_path / "mail"), ".json"))
    assert sorted((r["msg_id"], r["pos"]) for r in mail.collect()) == [("1", 0), ("2", 0), ("3", 1)]

    docs = tmp_path / "docs" / "en" / "asio"
    docs.mkdir(parents=True)
    (docs / "a.txt").write_text("Source URL: http://x/y \n" + "words of text " * 5)
    (docs / "b.html").write_text("<html><script>var a;</script><p>" + "words of text " * 5 + "</p></html>")
    (docs / "c.bin").write_text("no " * 50)
    read = files.read_files(spark, str(tmp_path / "docs"), ".txt", ".md", ".html")
    got = parsers.documentation(read, files.relative_path(F.col("path"), str(tmp_path / "docs"))).collect()
    assert sorted((r["url"], r["source"], r["library"], r["file_type"]) for r in got) == [
        ("en/asio/b.html", "repository", "asio", ".html"), ("http://x/y", "official", "asio", ".txt")]
    assert all("Source URL" not in r["text"] and "var a" not in r["text"] for r in got)

    vtt = tmp_path / "vtt"
    vtt.mkdir()
    cue = "00:00:01.000 --> 00:00:02.500{}\n{}\n{}\n\n"
    (vtt / "V1.vtt").write_text("WEBVTT\n\n" + cue.format("", "wrong", ""))
    (vtt / "V1.en.vtt").write_text(
        "WEBVTT\n\n" + cue.format("", "first&nbsp;line", "") + cue.format(" align:start position:0%", "rolls", "on")
        + cue.format("", "two", "lines") + "00:00:09.000 --> 00:00:10.000\n\n\n" + "00:00:11.000 --> 00:00:12.000\ncut off")
    cues = parsers.transcript_cues(parsers.preferred_transcripts(files.read_files(spark, str(vtt), ".vtt")))
    assert [(r["video_id"], r["start_time"], r["end_time"], r["text"]) for r in cues.orderBy("pos").collect()] == [
        ("V1", 1.0, 2.5, "firstline"), ("V1", 1.0, 2.5, "two lines")]

    (tmp_path / "papers.csv").write_text(
        "local_path,filename,url,author,title,date\np/a.md,a.md,u1,x,t,2024-01-01\n,a.md,u2,\"y,z\",t2,\n")
    index = parsers.paper_index(files.read_csv(spark, str(tmp_path / "papers.csv")))
    assert {r["key"]: r["url"] for r in index.collect()} == {"p/a.md": "u1", "a.md": "u2"}
    stats = files.file_stats(files.listing(spark, str(tmp_path))).collect()
    assert {r["extension"]: r["files"] for r in stats} == {".json": 2, ".txt": 1, ".html": 1, ".bin": 1, ".vtt": 2, ".csv": 1}
