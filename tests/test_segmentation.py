"""Chunks by links against a plain loop over the parts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.operators import segmentation


def loop(parts, most, least=0, breaks=None):
    chunks, size = [], 0
    for n, text in enumerate(parts):
        new = not chunks or size + 1 + len(text) > most or (breaks is not None and breaks[n] and size >= least)
        if new:
            chunks.append([])
            size = len(text)
        else:
            size += 1 + len(text)
        chunks[-1].append(n)
    return {n: k for k, chunk in enumerate(chunks) for n in chunk}


def sequences(rng, longest):
    sizes = [rng.integers(1, 30, longest), rng.integers(1, 300, 40), [120] * 5, [1], [99, 1, 100, 101, 98, 1, 1], [500, 3, 500, 4]]
    return {k: ["x" * int(s) for s in some] for k, some in enumerate(sizes)}


@pytest.mark.parametrize("bucket", [None, 150])
def test_packed(spark, monkeypatch, bucket):
    """Also where sequences go over many buckets and parts are longer than a chunk."""
    rng = np.random.default_rng(4)
    if bucket:
        monkeypatch.setattr(segmentation, "BUCKET_CHARS", bucket)
        monkeypatch.setattr(segmentation, "BUCKET_PARTS", 7)
    data = sequences(rng, 400)
    flags = {k: rng.random(len(parts)) < 0.4 for k, parts in data.items()}
    rows = [(k, n, t, bool(flags[k][n])) for k, parts in data.items() for n, t in enumerate(parts)]
    df = spark.createDataFrame(rows, "k long, n long, text string, flag boolean")
    for least, breaks in ((0, None), (40, F.col("flag"))):
        got = {(r.k, r.n): r.chunk_no for r in segmentation.packed(df, "k", 100, least, breaks).collect()}
        assert got == {(k, n): c for k, parts in data.items()
                       for n, c in loop(parts, 100, least, flags[k] if breaks is not None else None).items()}
    assert segmentation.packed(df.limit(0), "k", 100).count() == 0


def test_sentence_chunks_of_odd_cues(spark):
    cues = [("a", 0, 1.0, None), ("a", 1, 2.0, " One. Two!  Three? "), ("a", 2, 3.0, "x" * 600 + ". Four"), ("a", 3, 4.0, ""),
            ("b", 0, 5.0, "short"), ("c", 0, 6.0, "  ")]
    df = spark.createDataFrame(cues, "video_id string, pos int, start_time double, text string")
    got = sorted((r.video_id, r.i, r.start_time, r.text) for r in segmentation.sentence_chunks(df).collect())
    assert got == [("a", 0, 1.0, "One. Two! Three?"), ("a", 1, 3.0, "x" * 600 + ". Four"), ("b", 0, 5.0, "short")]


def test_semantic_chunks_cover_their_texts(spark):
    rows = [(1, "Alpha beta gamma. " * 30 + "Delta words now. " * 20), (2, None), (3, ""), (4, "y" * 2500), (5, "!!! ... ?"), (6, "One.\nTwo.")]
    got = segmentation.semantic_chunks(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id", "chunk_no").collect()
    for name, text in rows:
        mine = [r.chunk for r in got if r.doc_id == name]
        assert "".join(mine).replace(" ", "") == "".join((text or "").split())
        assert all(len(c) <= 1000 for c in mine) and all(len(c) >= 100 for c in mine[:-1])
    first = [r.chunk for r in got if r.doc_id == 1]
    assert any(c.startswith("Delta") for c in first)  # the topic changes there
