"""Token ids in Arrow stream files of equal-length sequences, as a Spark data source.

A folder holds shards, each the ids of consecutive documents as one stream cut into sequences of
LENGTH ids. A shard's ``.ids`` file is an Arrow stream whose batches have two columns, ``ids`` and
``mask``, both fixed-size lists: batches of as many sequences have as many bytes, so the place of any
sequence follows from its number, and it is read in place from a mapped file, without a copy. The mask, a
bit per id, is false only behind the last id of a shard. Ids take two bytes each where the vocabulary allows it.
The ``.docs`` file beside it has doc_id, start (in the shard) and n_tokens of its documents; the table
``_shards`` names the shards in order.

Shards are written by the tasks of one Spark write and named by its commit: a task that ran twice
leaves a file that no table names. ``write_tokens`` puts documents in the order of doc_id first, in
ranges, so no task holds more than its range. ``spark.read.format("token_stream")`` gives documents
(doc_id, start, n_tokens, ids) or, with option ``rows`` = ``sequences``, sequences (shard, number, ids,
mask). Folders are anything Arrow has a file system for.

Defined results: a null or empty text is the end id alone; a null doc_id stands before all others;
rows of the same doc_id are in the order of their texts' hashes; an empty table gives a folder without shards.
"""

from __future__ import annotations

import re
import uuid
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, islice, pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs, ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from threadloom.llm.common import byte_lengths, slices
from threadloom.llm.wordpieces import byte_letters, library, special_strings

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2
LENGTH = 2048
BATCH_SEQUENCES = 64
GROUP_BYTES = 1 << 21
READ_IDS = 1 << 20
LONG_TEXT = 1 << 20
LONG_RUN = 64
MARKS = ".,;:!?"
LATIN_END = "\u0250"  # letters up to here are letters in any version of Unicode
RUNS_KEPT = 600_000

# White space as Unicode defines it, which is what the vocabulary's pattern parts words by.
SPACE = "\t-\r \x85\xa0  -     　"
RUN = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
PARTED = re.compile(rf" (?:[{SPACE}]|\Z)")

DOCUMENTS = "doc_id long, start long, n_tokens long, ids binary"
SEQUENCES = "shard int, number long, ids array<int>, mask array<boolean>"
DOC_FIELDS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
SHARD_FIELDS = pa.schema([("name", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()), ("length", pa.int64()),
                          ("batch", pa.int64()), ("head", pa.int64()), ("stride", pa.int64()), ("width", pa.int64())])


class Seen:
    """Values of keys, computed for many at once. Most words of a corpus stand there once, so a key is ``kept`` from the
    second time on that it is asked for; ``new`` has those asked for once, and is emptied more often. Both are bounded."""

    def __init__(self, compute: Callable[[list[str]], list[bytes]], most: int):
        self.compute, self.most, self.kept, self.new = compute, most, {}, {}

    def learn(self, keys: set[str]) -> dict[str, bytes]:
        """Values of keys that are not kept yet."""
        again = {key: self.new.pop(key) for key in keys if key in self.new}
        ask = [key for key in keys if key not in again]
        fresh = dict(zip(ask, self.compute(ask))) if ask else {}
        values = again | fresh
        if fresh and max(map(len, fresh)) > LONG_RUN:
            fresh = {key: value for key, value in fresh.items() if len(key) <= LONG_RUN}
        for held, more in ((self.kept, again), (self.new, fresh)):
            if len(held) + len(more) > self.most:
                held.clear()
            held.update(more)
        return values


class Encoder:
    """Ids of texts by the tokenizers library. No pre-token of the vocabulary's pattern goes on from a
    character to white space after it, so a text is the sum of runs of white space with what follows; what the
    library said of a run is kept, for a bounded number of them. Nearly all runs are one space and a word."""

    def __init__(self, path: str = VOCABULARY):
        self.library, self.special = library(path), special_strings(path)
        self.type = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.runs = Seen(self._encode, RUNS_KEPT // 10)
        self.words = Seen(self._words, RUNS_KEPT)
        self.model, self.code = self.library.model, "H" if self.type.itemsize == 2 else "I"
        self.letters = {byte: letter for letter, byte in byte_letters().items()}
        self.marks = dict(zip(MARKS, self._encode(list(MARKS))))

    def _encode(self, texts: list[str]) -> list[bytes]:
        ids = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        raw = np.fromiter(chain.from_iterable(ids), self.type).tobytes()
        ends = np.cumsum([0, *map(len, ids)]) * self.type.itemsize
        return [raw[a:b] for a, b in pairwise(ends.tolist())]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words behind a space. One of Latin letters is one pre-token, and a mark behind it another, so such
        a word is given to the library's model as it is; others go through all of the library."""
        bare = [w if w.isalpha() else w[:-1] if w[-1:] in self.marks and w[:-1].isalpha() else "" for w in words]
        known = dict.fromkeys(b for b in bare if b and (b.isascii() or max(b) < LATIN_END))
        for b in known:
            ids = self.words.kept.get(b) or self.words.new.get(b)
            if ids is None:
                spelled = b if b.isascii() else b.encode().decode("latin-1").translate(self.letters)
                ids = array(self.code, [t.id for t in self.model.tokenize(self.letters[32] + spelled)]).tobytes()
            known[b] = ids
        other = [w for w, b in zip(words, bare) if b not in known]
        rest = iter(self._encode([f" {w}" for w in other]) if other else [])
        return [next(rest) if b not in known else known[b] if len(b) == len(w) else known[b] + self.marks[w[-1]]
                for b, w in zip(bare, words)]

    def _known(self, seen: Seen, parts: list[list[str]]) -> Iterator[bytes]:
        """Ids of each list of runs, none of which is empty."""
        found = [list(map(seen.kept.get, some)) for some in parts]
        open_ = [k for k, ids in enumerate(found) if not all(ids)]
        values = seen.learn({run for k in open_ for run, ids in zip(parts[k], found[k]) if ids is None})
        for k in open_:
            found[k] = [values[run] if ids is None else ids for run, ids in zip(parts[k], found[k])]
        return map(b"".join, found)

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        first, rest = [], []
        for text in texts:
            if len(text) > LONG_TEXT or any(s in text for s in self.special):
                runs, words = [], []
            elif PARTED.search(text):  # other white space after a space
                runs, words = RUN.findall(text), []
            else:
                words = text.split(" ")
                runs = [run for run in (words.pop(0),) if run]
            first.append(runs)
            rest.append(words)
        for text, runs, words in zip(texts, self._known(self.runs, first), self._known(self.words, rest)):
            if len(text) > LONG_TEXT or any(s in text for s in self.special):
                yield b"".join(self._pieces(text))
            else:
                yield runs + words

    def _pieces(self, text: str) -> Iterator[bytes]:
        """Ids of a very long text, some runs at a time; the library's own rules hold for special strings."""
        if any(s in text for s in self.special):
            yield self._encode([text])[0]
            return
        found = (m[0] for m in RUN.finditer(text))
        while runs := list(islice(found, 1 << 16)):
            yield from self._known(self.runs, [runs])

    def column(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text of a column, with the end id; null is empty."""
        end = np.array([END_ID], self.type).tobytes()
        for lo, hi in slices(byte_lengths(texts), GROUP_BYTES):
            for ids in self.encode([t or "" for t in texts.slice(lo, hi - lo).to_pylist()]):
                yield ids + end


@lru_cache(maxsize=1)
def encoder(path: str = VOCABULARY) -> Encoder:
    """One per worker process, for all its tasks."""
    return Encoder(path)


class Stream:
    """An ``.ids`` file being written."""

    def __init__(self, file, length: int, batch: int, type_: np.dtype):
        self.length, self.batch, self.type = length, batch, type_
        self.file = file
        kind = pa.uint16() if type_.itemsize == 2 else pa.uint32()
        self.schema = pa.schema([pa.field("ids", pa.list_(pa.field("item", kind, False), length), False),
                                 pa.field("mask", pa.list_(pa.field("item", pa.bool_(), False), length), False)])
        self.writer = ipc.new_stream(file, self.schema)
        self.held, self.count, self.total, self.batches = [], 0, 0, 0
        self.head = self.stride = 0

    def add(self, ids: bytes) -> None:
        self.held.append(ids)
        self.count += len(ids) // self.type.itemsize
        if self.count >= self.length * self.batch:
            self._flush(self.count - self.count % (self.length * self.batch))

    def _flush(self, count: int) -> None:
        raw = b"".join(self.held)
        ids = np.frombuffer(raw, self.type)
        self.held, self.count = [raw[count * self.type.itemsize :]], self.count - count
        self.total += count
        for at in range(0, count, self.length * self.batch):
            self._write(ids[at : min(count, at + self.length * self.batch)])

    def _write(self, ids: np.ndarray) -> None:
        rows = -(-len(ids) // self.length)
        full, mask = np.zeros(rows * self.length, self.type), np.zeros(rows * self.length, bool)
        full[: len(ids)], mask[: len(ids)] = ids, True
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), type=f.type) for x, f in zip((full, mask), self.schema)]
        before = self.file.tell()
        self.writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))
        if not self.batches:  # a stream's schema goes out with its first batch
            size = ipc.get_record_batch_size(pa.RecordBatch.from_arrays(columns, schema=self.schema))
            self.head, self.stride = self.file.tell() - size, size
        elif rows == self.batch and self.file.tell() - before != self.stride:
            raise ValueError("batches of one file differ in size")
        self.batches += 1

    def close(self) -> None:
        self._flush(self.count)
        self.writer.close()


def place(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


class Shard:
    """Random access to the sequences of an ``.ids`` file. Of a local file the arrays are views of the mapped file."""

    def __init__(self, folder: str, row: dict):
        system, path = place(folder)
        self.row, self.path = row, f"{path}/{row['name']}.ids"
        local = isinstance(system, fs.LocalFileSystem)
        self.file = pa.memory_map(self.path) if local else system.open_input_file(self.path)
        self.schema = ipc.read_schema(ipc.read_message(self._buffer(0, row["head"])))

    def _buffer(self, start: int, size: int) -> pa.Buffer:
        self.file.seek(start)
        return self.file.read_buffer(size)

    @property
    def sequences(self) -> int:
        return -(-self.row["ids"] // self.row["length"])

    def batch(self, number: int) -> pa.RecordBatch:
        rows = min(self.row["batch"], self.sequences - number * self.row["batch"])
        start = self.row["head"] + number * self.row["stride"]
        size = self.row["stride"] if rows == self.row["batch"] else self.file.size() - start
        return ipc.read_record_batch(ipc.read_message(self._buffer(start, size)), self.schema)

    def __getitem__(self, number: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of one sequence, in place; the mask has a bit per id."""
        batch, at = self.batch(number // self.row["batch"]), number % self.row["batch"]
        ids, mask = (batch.column(k).slice(at, 1).flatten() for k in range(2))
        return ids.to_numpy(), mask

    def ids(self, start: int, count: int) -> np.ndarray:
        """Ids at places of the shard's stream, over the borders of sequences and batches."""
        step = self.row["length"] * self.row["batch"]
        if not count:
            return np.zeros(0, np.uint32)
        parts = []
        for number in range(start // step, (start + count - 1) // step + 1):
            flat = self.batch(number).column(0).flatten().to_numpy()
            parts.append(flat[max(0, start - number * step) : start + count - number * step])
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def documents(self) -> pa.Table:
        system, path = place(self.path)
        with system.open_input_file(path.removesuffix(".ids") + ".docs") as file:
            return ipc.open_stream(file).read_all()


def shards(folder: str) -> list[dict]:
    """The shards of a folder in order, each with its ``number`` and the ids ``before`` it."""
    system, path = place(folder)
    with system.open_input_file(f"{path}/_shards") as file:
        rows, before = pq.read_table(file).to_pylist(), 0
    for number, row in enumerate(rows):
        row["number"], row["before"] = number, before
        before += row["ids"]
    return rows


@dataclass
class Written(WriterCommitMessage):
    partition: int
    row: dict | None


class TokenWriter(DataSourceArrowWriter):
    """Writes rows (doc_id, text), in the order they come in, as one shard per task."""

    def __init__(self, options: dict):
        self.folder, self.path = options["path"], options.get("vocabulary", VOCABULARY)
        self.length, self.batch = int(options.get("length", LENGTH)), int(options.get("batch", BATCH_SEQUENCES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        partition = TaskContext.get().partitionId()
        system, path = place(self.folder)
        name, ids_of = f"shard-{partition:06d}-{uuid.uuid4().hex}", encoder(self.path)
        batch = next((b for b in iterator if len(b)), None)
        if batch is None:
            return Written(partition, None)
        system.create_dir(path, recursive=True)
        with system.open_output_stream(f"{path}/{name}.ids") as file, system.open_output_stream(f"{path}/{name}.docs") as index:
            stream = Stream(file, self.length, self.batch, ids_of.type)
            with ipc.new_stream(index, DOC_FIELDS) as docs:
                total = count = 0
                while batch is not None:
                    sizes = []
                    for ids in ids_of.column(batch.column("text")):
                        stream.add(ids)
                        sizes.append(len(ids) // ids_of.type.itemsize)
                    starts = total + np.cumsum([0, *sizes[:-1]])
                    docs.write_batch(pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").cast(pa.int64()), pa.array(starts), pa.array(sizes, pa.int64())], schema=DOC_FIELDS))
                    total, count = total + sum(sizes), count + len(sizes)
                    batch = next((b for b in iterator if len(b)), None)
            stream.close()
        return Written(partition, {"name": name, "docs": count, "ids": total, "length": self.length, "batch": self.batch,
                                   "head": stream.head, "stride": stream.stride, "width": ids_of.type.itemsize})

    def commit(self, messages: list) -> None:
        system, path = place(self.folder)
        system.create_dir(path, recursive=True)
        rows = [m.row for m in sorted((m for m in messages if m is not None), key=lambda m: m.partition) if m.row]
        with system.open_output_stream(f"{path}/_shards") as file:
            pq.write_table(pa.Table.from_pylist(rows, schema=SHARD_FIELDS), file)

    def abort(self, messages: list) -> None:
        system, path = place(self.folder)
        for row in [m.row for m in messages if m is not None and m.row]:
            for kind in ("ids", "docs"):
                system.delete_file(f"{path}/{row['name']}.{kind}")


@dataclass
class Part(InputPartition):
    row: dict


class TokenReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.rows = options["path"], options.get("rows", "documents")

    def partitions(self) -> list[Part]:
        return [Part(row) for row in shards(self.folder)]

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a folder without shards
            return
        shard = Shard(self.folder, partition.row)
        yield from (self._documents if self.rows == "documents" else self._sequences)(shard, partition.row)

    def _documents(self, shard: Shard, row: dict) -> Iterator[pa.RecordBatch]:
        docs = shard.documents()
        starts, sizes = docs.column("start").to_numpy(), docs.column("n_tokens").to_numpy()
        for lo, hi in slices(sizes, READ_IDS):
            ids = shard.ids(int(starts[lo]), int(sizes[lo:hi].sum())).astype("<u4")
            ends = np.concatenate([[0], np.cumsum(sizes[lo:hi])]) * 4
            binary = pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(ends.astype("<i8")), pa.py_buffer(ids)])
            some = docs.slice(lo, hi - lo).combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [some.column("doc_id").combine_chunks(), pa.array(starts[lo:hi] + row["before"]), pa.array(sizes[lo:hi]),
                 binary.cast(pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    def _sequences(self, shard: Shard, row: dict) -> Iterator[pa.RecordBatch]:
        for number in range(-(-shard.sequences // row["batch"])):
            batch = shard.batch(number)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["number"]] * len(batch), pa.int32()),
                 pa.array(np.arange(len(batch)) + number * row["batch"]),
                 batch.column(0).cast(pa.list_(pa.int32())), batch.column(1).cast(pa.list_(pa.bool_()))],
                names=["shard", "number", "ids", "mask"])


class TokenStream(DataSource):
    @classmethod
    def name(cls) -> str:
        return "token_stream"

    def schema(self) -> str:
        return DOCUMENTS if self.options.get("rows", "documents") == "documents" else SEQUENCES

    def reader(self, schema) -> TokenReader:
        return TokenReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> TokenWriter:
        return TokenWriter(dict(self.options))


def write_tokens(docs: DataFrame, folder: str, **options: str) -> None:
    """Documents ``(doc_id, text)`` as token files in a new folder, in ascending doc_id order over all shards.

    Rows of one doc_id, also if there are many, stand in as many ranges as their texts, and where
    texts are equal, their places in the input, allow."""
    docs.sparkSession.dataSource.register(TokenStream)
    order = ["doc_id", "mark", "turn"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumns(
        {"mark": F.xxhash64("text"), "turn": F.monotonically_increasing_id()})
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").write.format(
        "token_stream").mode("append").options(**options).save(folder)


def read_tokens(spark: SparkSession, folder: str, rows: str = "documents") -> DataFrame:
    spark.dataSource.register(TokenStream)
    return spark.read.format("token_stream").option("rows", rows).load(folder)
