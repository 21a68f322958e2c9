"""Manifest, token files and vector codes against brute force, and on rows of every odd kind."""

import collections
import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from threadloom.llm import cover_codes, manifest, token_files
from threadloom.llm.catalog import QUERIES
from threadloom.session import scratch_path

SF = "/root/testdata/sf0.001"
CLASHES = ("key", "pos", "block", "bucket", "tree", "n", "h", "level", "steps", "ids", "mark", "turn", "start", "rows", "points")


def clashing(df):
    """With columns named as the operators' own."""
    return df.withColumns({name: F.lit("x") for name in CLASHES if name not in df.columns})


# manifest

def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, strip=False):
    out = ""
    for name in manifest.FIELDS:
        value = row[name]
        if name == "text" and strip and value is not None:
            value = value.replace("\n", "")
        out += "-" if value is None else f"{len(str(value).encode())}:{value}"
    return sha(out)


def tree_of(digests):
    """Root, and of each leaf the siblings before and after on its way."""
    ways, level = [[] for _ in digests], [(d, [k]) for k, d in enumerate(digests)]
    while len(level) > 1:
        above = []
        for at in range(0, len(level), 3):
            run = level[at : at + 3]
            for j, (_, leaves) in enumerate(run):
                for k in leaves:
                    ways[k].append(([d for d, _ in run[:j]], [d for d, _ in run[j + 1 :]]))
            above.append((sha("".join(d for d, _ in run)), [k for _, leaves in run for k in leaves]))
        level = above
    return level[0][0] if level else None, ways


def brute_manifest(rows):
    by = collections.defaultdict(list)
    for row in rows:
        by[row["source"]].append((row["doc_id"] is not None, row["doc_id"] or 0, leaf_of(row), row))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    members = [sorted(by[s], key=lambda x: x[:3]) for s in sources]
    trees = [tree_of([m[2] for m in some]) for some in members]
    root, tops = tree_of([subroot for subroot, _ in trees])
    out = collections.Counter()
    for some, (subroot, ways), top in zip(members, trees, tops):
        for (_, _, leaf, row), way in zip(some, ways):
            even = zlib.crc32(("" if row["doc_id"] is None else str(row["doc_id"])).encode()) % 2 == 0
            fold = leaf_of(row, True) if even else leaf
            for before, after in way + top:
                fold = sha("".join(before) + fold + "".join(after))
            proof = sha("".join(d for before, after in way + top for d in before + after))
            out[row["doc_id"], leaf, subroot, root, proof, fold, fold == root] += 1
    return out


def expect_manifest(docs):
    got = collections.Counter(map(tuple, manifest.verified(clashing(docs)).collect()))
    assert got == brute_manifest([row.asDict() for row in docs.collect()])


ROWS = "doc_id long, source string, lang string, n_chars long, text string"


def test_manifest_of_odd_rows(spark):
    odd = [(1, "a", None, 1, "x\ny"), (None, None, "en", None, None), (1, "a", None, 1, "x\ny"), (2, None, None, None, ""),
           (None, None, "en", None, None), (3, "", "de", 5, "ü\n"), (7, "b", "x", 1, "q" * 100_000), (1, "a", None, 1, "other")]
    odd += [(k // 2, "large", "en", 3, f"t\n{k}") for k in range(800)]
    expect_manifest(spark.createDataFrame(odd, ROWS).repartition(5))
    for few in (odd[:1], odd[:2], []):
        expect_manifest(spark.createDataFrame(few, ROWS))


def test_manifest_of_many_sources(spark):
    expect_manifest(spark.createDataFrame([(k, f"s{k % 250}", "en", k, f"text {k}") for k in range(260)], ROWS))


def test_steps_double(spark):
    """A tree of eight levels takes three joins; each leaf then has a step per level."""
    docs = spark.createDataFrame([(k, "a", "en", k, f"text {k}") for k in range(2200)], ROWS)
    rows = manifest.manifest(docs).select("doc_id", F.size("steps").alias("n")).collect()
    assert {r.n for r in rows} == {math.ceil(math.log(2200, 3))} and len(rows) == 2200


# token files

def test_encoder_on_random_characters():
    library, rng = Tokenizer.from_file(token_files.VOCABULARY), np.random.default_rng(3)
    signs = np.array([*"aAbé ñ \n\t\r\x0b\x1c\x1d\x85\xa0中文字한١٢½²Ⅷ_'s're!?.,…—😀\x00 　 ​", "<|endoftext|>", "  ", " \n "])
    some = ["".join(rng.choice(signs, rng.integers(0, 60))) for _ in range(1000)] + ["x" * 3000, "a " * 2000]
    encoder = token_files.Encoder()
    expected = [library.encode(t, add_special_tokens=False).ids for t in some]
    assert [np.frombuffer(b, encoder.type).tolist() for b in encoder.encode(some)] == expected
    assert [np.frombuffer(b"".join(encoder._pieces(t)), encoder.type).tolist() for t in some if "<|" not in t] == [
        ids for t, ids in zip(some, expected) if "<|" not in t]


def all_ids(docs):
    library = Tokenizer.from_file(token_files.VOCABULARY)
    return [(i, library.encode(t or "", add_special_tokens=False).ids + [token_files.END_ID]) for i, t in docs]


def test_token_files(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    expected = all_ids(sorted((r.doc_id, r.text) for r in docs.collect()))
    got, before = {r.doc_id: r for r in QUERIES["op13_token_files"](spark, SF).collect()}, 0
    for name, ids in expected:
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert (got[name].start, got[name].n_tokens, got[name].ids_crc32) == (before, len(ids), crc)
        before += len(ids)
    assert len(got) == len(expected)


def test_sequences_in_place(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(4)
    flat = np.concatenate([ids for _, ids in all_ids(sorted((r.doc_id, r.text) for r in docs.collect()))])
    folder = scratch_path(spark, "test-tokens")
    token_files.write_tokens(clashing(docs), folder, length="128", batch="4")
    rows = token_files.shards(folder)
    assert sum(r["ids"] for r in rows) == len(flat)
    for row in rows:
        shard = token_files.Shard(folder, row)
        for k in range(shard.sequences):
            ids, mask = shard[k]
            whole = shard.batch(k // 4).column(1).flatten()
            assert len(ids) == len(mask) == 128 and not ids.flags.owndata
            assert mask.buffers()[1].address == whole.buffers()[1].address or len(mask.buffers()[1]) <= 16
            mask = mask.to_numpy(zero_copy_only=False)
            start = row["before"] + 128 * k
            assert ids[mask].tolist() == flat[start : min(start + 128, row["before"] + row["ids"])].tolist()
        assert shard.ids(5, 700).tolist() == flat[row["before"] + 5 : row["before"] + 705].tolist()
    some = token_files.read_tokens(spark, folder, "sequences").orderBy("shard", "number").collect()
    assert [i for r in some for i, m in zip(r.ids, r.mask) if m] == flat.tolist()


def test_tokens_of_odd_rows(spark):
    odd = [(1, None), (None, "a"), (None, "a"), (3, ""), (2, "x" * 1_200_000), (2, "y z"), (4, "word " * 300_000)]
    docs = spark.createDataFrame(odd, "doc_id long, text string")
    folder = scratch_path(spark, "test-tokens")
    token_files.write_tokens(clashing(docs), folder)
    rows = token_files.read_tokens(spark, folder).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, None, 1, 2, 2, 3, 4]
    assert [r.start for r in rows] == [sum(r.n_tokens for r in rows[:k]) for k in range(len(rows))]
    assert collections.Counter((r.doc_id, bytes(r.ids)) for r in rows) == collections.Counter(
        (i, np.array(ids, "<u4").tobytes()) for i, ids in all_ids(odd))
    folder = scratch_path(spark, "test-tokens")
    token_files.write_tokens(docs.limit(0), folder)
    assert token_files.read_tokens(spark, folder).count() == 0 == token_files.read_tokens(spark, folder, "sequences").count()


# vector codes

@pytest.mark.parametrize("n, width, kind", [(0, 4, 0), (1, 4, 0), (2, 4, 0), (60, 3, 1), (700, 16, 0), (700, 16, 2), (50, 0, 0)])
def test_cover_trees(n, width, kind):
    rng = np.random.default_rng(1)
    points = np.floor(rng.normal(size=(n, width)) * 1000)
    if kind == 1:  # many ties and equal points
        points = rng.integers(0, 4, (n, width)).astype(float)
    if kind == 2:
        points = np.floor(rng.normal(size=(9, width))[np.arange(n) % 9] * 1000 + rng.normal(size=(n, width)))
    tree, entries = cover_codes.CoverTree.build(points), points[:9] if n else np.zeros((1, width))
    assert sorted(tree.order.tolist()) == list(range(n))
    for lo, hi, radius in zip(tree.lo, tree.hi, tree.radius):
        some = points[tree.order[lo:hi]]
        assert np.sqrt(((some - some[0]) ** 2).sum(1)).max() <= radius + 1e-9
    nodes, entry = tree.assign(points, entries)
    got = np.full(n, -1)
    for node, e in zip(nodes, entry):
        assert (got[tree.order[tree.lo[node] : tree.hi[node]]] == -1).all()
        got[tree.order[tree.lo[node] : tree.hi[node]]] = e
    assert (got == ((points[:, None] - entries[None]) ** 2).sum(2).argmin(1)).all()
    assert kind != 2 or len(nodes) < n / 2  # groups of near points go as one


def brute_codes(rows, entries=256):
    usable = [(i, label, [math.floor(1024 * float(x)) for x in v]) for i, label, v in rows
              if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out, totals = [], collections.Counter()
    for dims in {len(v) for _, _, v in usable}:
        some = sorted([r for r in usable if len(r[2]) == dims], key=lambda r: (r[0] is None, r[0] or 0, r[2]))
        code, error, text = [""] * len(some), [0] * len(some), []
        for part in range(4):
            points = [v[part * dims // 4 : (part + 1) * dims // 4] for _, _, v in some]
            book = [list(p) for p in points[:entries]]

            def nearest(p):
                return min((sum((a - b) ** 2 for a, b in zip(p, e)), k) for k, e in enumerate(book))

            for _ in range(4):
                groups = collections.defaultdict(list)
                for p in points:
                    groups[nearest(p)[1]].append(p)
                for k, group in groups.items():
                    book[k] = [sum(c) // len(group) for c in zip(*group)]
            for k, p in enumerate(points):
                away, entry = nearest(p)
                code[k], error[k] = code[k] + f"{entry:02x}", error[k] + away
            text += [str(x) for e in book for x in e]
        books = sha(",".join(text))
        out += [(i, c, e, books, label) for (i, label, _), c, e in zip(some, code, error)]
        for (_, label, _), e in zip(some, error):
            totals[label] += e
    short = lambda e: e if e < 2 ** 63 else None
    return collections.Counter((i, c, short(e), short(totals[label]), books) for i, c, e, books, label in out)


def test_codes_of_odd_rows(spark):
    rng, nan, inf = np.random.default_rng(2), float("nan"), float("inf")
    odd = [(k % 7 if k % 5 else None, None if k % 3 else 1, [float(x) for x in rng.integers(-3, 3, 6)]) for k in range(330)]
    odd += [(1, 2, None), (2, 2, [nan, 1.0]), (3, 2, [None, 1.0]), (4, 2, []), (5, None, []), (6, 3, [1.0]), (7, 3, [inf]),
            (8, 4, [1e6, 2e7, -3e5, 1.0, 2.0, 3.0, 5.0]), (9, 4, [1e15] * 7), (10, 4, [1e6] * 7)]
    df = spark.createDataFrame(odd, "vec_id long, label int, vector array<double>")
    got = cover_codes.codes(clashing(df).repartition(3)).collect()
    assert collections.Counter(map(tuple, got)) == brute_codes(odd)
    assert cover_codes.codes(df.limit(0)).count() == 0
