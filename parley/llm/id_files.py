"""Token-id files: one zstandard frame per document, a dictionary shared by all, an index for short access."""

from __future__ import annotations

import hashlib
import os
import re
import struct
import uuid
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import repeat
from typing import Any, NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.llm.common import text_of
from parley.llm.registry import query, table
from parley.session import shared_dir

#: A file is MAGIC, its dictionary's SHA-256, bytes per id, frames, an Arrow index, and FOOTER: where the index starts.
MAGIC, HEAD, FOOTER = b"PLYIDS1\n", struct.Struct("<8s32sB"), struct.Struct("<Q8s")
#: Marks that often end a chunk.
MARKS = ".,;:!?"
#: Words that a task remembers, in two halves, and the longest that it does.
REMEMBERED, LONGEST = 1_000_000, 64
#: Bytes that are read, or letters that are encoded, at a time.
STEP = 8 << 20
#: White space of Latin-1 beside the blank.
OTHER_SPACE = "\t\n\x0b\x0c\r\x85\xa0"


def _spans(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of every span, one span after another."""
    upto = np.cumsum(count)
    return np.repeat(start - (upto - count), count) + np.arange(upto[-1] if len(upto) else 0)


class IdEncoder:
    """Ids of texts by the tokenizers library, as little-endian 32-bit integers, asked once per chunk.

    In a text of Latin-1 without special tokens, single blanks part chunks that no token crosses,
    and so do single newlines, which stay at the start of their chunk.
    New chunks go to the library as one line, whose ids are told apart by their bytes. Any other
    text goes there whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))).search if special else lambda text: None
        vocab = self.tokenizer.get_vocab()
        self.size = np.zeros(1 + max(vocab.values()), np.int64)  # bytes of a token: a letter each
        self.size[list(vocab.values())] = list(map(len, vocab))
        # where a word's ids, each after a blank, are in the array beside, and how many: start << 32 | count
        self.new: dict[str, int] = {}
        self.old: dict[str, int] = {}
        self.new_ids = self.old_ids = np.zeros(0, "<u4")
        self.kept = 0  # ids of words that are remembered
        self.marks: dict[str, bytes] = {}

    def of_library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def of_line(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, each after a blank or its own newline, and how many each has: in the line of all, a word ends where the bytes of its tokens do."""
        if not words:
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        ids = np.frombuffer(self.of_library([(" " + " ".join(words)).replace(" \n", "\n")])[0], "<u4")
        each = pa.array(words, pa.string())
        sizes = pc.binary_length(each).to_numpy().astype(np.int64) + pc.invert(pc.starts_with(each, "\n")).to_numpy(zero_copy_only=False)
        return ids, np.diff(np.searchsorted(np.cumsum(self.size[ids]), np.cumsum(sizes)) + 1, prepend=0)

    def of_chunks(self, chunks: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all distinct chunks, and how many each has: those of the word, and those of the marks behind it, which no token joins to letters."""
        word = pc.utf8_rtrim(chunks, MARKS)
        word = pc.if_else(pc.utf8_is_alpha(pc.utf8_ltrim(word, "\n")), word, chunks)
        rest = pc.subtract(pc.binary_length(chunks), pc.binary_length(word)).to_numpy()
        coded = word.dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        at = np.fromiter(map(self.new.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0)
        at[missing] = self._learn([words[i] for i in missing.tolist()])
        marked = np.flatnonzero(rest)
        marks = pa.array([c[-k:] for c, k in zip(chunks.take(pa.array(marked)).to_pylist(), rest[marked].tolist(), strict=True)], pa.string()).dictionary_encode()
        of_marks = [self._mark(m) for m in marks.dictionary.to_pylist()]
        n_marks = np.fromiter(map(len, of_marks), np.int64, len(of_marks)) // 4
        start, count = np.zeros((len(chunks), 2), np.int64), np.zeros((len(chunks), 2), np.int64)
        place, which = at[coded.indices.to_numpy()], marks.indices.to_numpy()
        start[:, 0], count[:, 0] = place >> 32, place & 0xFFFFFFFF
        start[marked, 1], count[marked, 1] = len(self.new_ids) + (np.cumsum(n_marks) - n_marks)[which], n_marks[which]
        found = np.concatenate([self.new_ids, np.frombuffer(b"".join(of_marks), "<u4")])[_spans(start.ravel(), count.ravel())]
        self._forget()
        return found, count.sum(1)

    def _learn(self, missing: list[str]) -> np.ndarray:
        """Where the ids of words are that this half does not know; short ones come first in the array."""
        if not missing:
            return np.zeros(0, np.int64)
        at = np.fromiter(map(self.old.get, missing, repeat(-1)), np.int64, len(missing))
        size = np.fromiter(map(len, missing), np.int64, len(missing))
        kind = np.where(at >= 0, 0, np.where(size <= LONGEST, 1, 2))
        order = np.argsort(kind, kind="stable")
        words = [missing[i] for i in order.tolist()]
        old = at[at >= 0]
        fresh, count = self.of_line(words[len(old):])
        n = np.concatenate([old & 0xFFFFFFFF, count])
        start = len(self.new_ids) + np.cumsum(n) - n
        places = start << 32 | n
        self.new_ids = np.concatenate([self.new_ids, self.old_ids[_spans(old >> 32, n[:len(old)])], fresh])
        short = len(missing) - int((kind == 2).sum())
        self.kept = int(start[short]) if short < len(missing) else len(self.new_ids)
        self.new.update(zip(words[:short], places[:short].tolist(), strict=True))
        at[order] = places
        return at

    def _forget(self) -> None:
        """Let go of the ids of long words, and of the older half when the newer one is full."""
        if self.kept < len(self.new_ids):
            self.new_ids = self.new_ids[:self.kept].copy()
        if len(self.new) > REMEMBERED // 2:  # this half becomes the old one, and the one before goes
            self.old, self.old_ids, self.new, self.new_ids = self.new, self.new_ids, {}, np.zeros(0, "<u4")
            self.kept = 0

    def _mark(self, marks: str) -> bytes:
        if marks not in self.marks:
            if len(self.marks) > REMEMBERED // 100:
                self.marks = {}
            self.marks[marks] = self.of_library([marks])[0]
        return self.marks[marks]

    def plain(self, text: str) -> bool:
        """Latin-1, no special token, and no blank beside white space or at an end."""
        try:
            if not text.isascii():
                text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return not (self.special(text) or "  " in text or text[:1] == " " or text[-1:] == " "
                    or any(" " + c in text or c + " " in text for c in OTHER_SPACE if c in text))

    def spaced(self, text: str) -> str:
        """A plain text behind its first blank. Newlines get a blank before them if no other white space joins them: each is a token of its own."""
        tail = text[text.index(" ") + 1:]
        if "\n" not in tail or "\n\n" in tail or tail[-1] == "\n" or any(c in tail for c in OTHER_SPACE if c != "\n"):
            return tail
        return tail.replace("\n", " \n")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; texts are taken some at a time."""
        out: list[bytes] = []
        first = letters = 0
        for i, text in enumerate(texts):
            letters += len(text)
            if letters > STEP:
                out += self._encode(texts[first:i])
                first, letters = i, len(text)
        return out + self._encode(texts[first:])

    def _encode(self, texts: list[str]) -> list[bytes]:
        """Distinct chunks of all texts are looked up once; ids are gathered by their places."""
        plain = [" " in t and self.plain(t) for t in texts]
        heads = self.of_library([t[: t.index(" ")] if p else t for t, p in zip(texts, plain, strict=True)])
        tails = pa.array([self.spaced(t) if p else None for t, p in zip(texts, plain, strict=True)], pa.string())
        split = pc.split_pattern(tails, " ")
        coded = split.values.dictionary_encode()
        if not len(coded):
            return heads
        ids, size = self.of_chunks(coded.dictionary)
        place = coded.indices.to_numpy()
        n = size[place]
        upto = np.cumsum(n)
        flat = ids[_spans((np.cumsum(size) - size)[place], n)].tobytes()
        ends = (4 * np.concatenate([[0], upto]))[split.offsets.to_numpy()].tolist()
        return [head + flat[i:j] for head, i, j in zip(heads, ends[:-1], ends[1:], strict=True)]


@lru_cache(maxsize=2)
def encoder(path: str) -> IdEncoder:
    return IdEncoder(path)


class Layout(NamedTuple):
    """How ids are stored: dictionary, bytes per id, level, and when a new file starts."""

    dictionary: bytes = b""
    width: int = 4
    level: int = 3
    file_bytes: int = 256 << 20
    file_docs: int = 500_000

    @property
    def sha(self) -> bytes:
        return hashlib.sha256(self.dictionary).digest()

    def shared(self) -> zstandard.ZstdCompressionDict | None:
        return zstandard.ZstdCompressionDict(self.dictionary) if self.dictionary else None

    def pack(self, ids: bytes) -> bytes:
        return np.frombuffer(ids, "<u4").astype(f"<u{self.width}").tobytes() if self.width != 4 else ids


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder that all executors reach, and the folder's path there."""
    return fs.FileSystem.from_uri(folder if ":/" in folder else os.path.abspath(folder))


def _ids(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))


def train_dictionary(docs: DataFrame, path: str, width: int = 2, size: int = 112_640, sample_docs: int = 2_000,
                     piece_bytes: int = 8_192, sample_pieces: int = 4_000, id_col: str = "doc_id", text_col: str = "text") -> bytes:
    """A zstandard dictionary of ``size`` bytes, trained on serialized ids of a bounded sample.

    About ``sample_docs`` documents, chosen by a hash of the id, are encoded whole and cut into
    pieces; the ``sample_pieces`` pieces of the smallest hash are learned from, at most 32 MB by
    default. The dictionary decides about sizes of files only. Too little to learn from: empty.
    """
    pack = Layout(width=width).pack

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in map(pack, encoder(path).encode(b.column(0).to_pylist())):
                yield pa.RecordBatch.from_arrays([pa.array([data[i: i + piece_bytes] for i in range(0, len(data), piece_bytes)], pa.binary())], ["piece"])

    every = max(1, docs.count() // sample_docs)
    chosen = _ids(docs, id_col, text_col).where(F.pmod(F.xxhash64("_id"), F.lit(every)) == 0).select("_text")
    found = chosen.mapInArrow(pieces, "piece binary").where(F.length("piece") >= 8).orderBy(F.xxhash64("piece"), "piece").limit(sample_pieces)
    samples = [bytes(r[0]) for r in found.collect()]
    if len(samples) < 32 or sum(map(len, samples)) < 10 * 1024:
        return b""
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, samples)) // 4), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


class _Writer:
    """One file at a time; ``close`` ends it with its index and returns its row of the manifest."""

    def __init__(self, folder: str, layout: Layout, kind: pa.DataType) -> None:
        self.store, self.root = _store(folder)
        self.layout, self.kind, self.part, self.seq = layout, kind, TaskContext.get().partitionId(), 0
        self.packer = zstandard.ZstdCompressor(level=layout.level, dict_data=layout.shared())
        self.out: pa.NativeFile | None = None

    def add(self, doc: Any, ids: bytes) -> dict[str, Any] | None:
        """Append one document; the manifest's row if the file is now full."""
        if self.out is None:
            # the name is new for every attempt, so a repeated task never meets what a lost one left
            self.name = f"part-{self.part:06d}-{self.seq:04d}-{uuid.uuid4().hex}.ids"
            self.out = self.store.open_output_stream(f"{self.root}/{self.name}", compression=None)
            self.out.write(HEAD.pack(MAGIC, self.layout.sha, self.layout.width))
            self.docs, self.ends, self.tokens, self.at = [], array("q"), array("q"), HEAD.size
        frame = self.packer.compress(self.layout.pack(ids))
        self.out.write(frame)
        self.at += len(frame)
        self.docs.append(doc)
        self.ends.append(self.at)
        self.tokens.append(len(ids) // 4)
        return self.close() if self.at >= self.layout.file_bytes or len(self.docs) >= self.layout.file_docs else None

    def close(self) -> dict[str, Any] | None:
        if self.out is None:
            return None
        index = pa.table({"id": pa.array(self.docs, self.kind), "end": np.array(self.ends, "<i8"), "n": np.array(self.tokens, "<i8")})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, index.schema) as writer:
            writer.write_table(index)
        self.out.write(sink.getvalue())
        self.out.write(FOOTER.pack(self.at, MAGIC))
        self.out.close()
        self.out, self.seq = None, self.seq + 1
        return {"part": self.part, "seq": self.seq - 1, "file": self.name, "first_id": self.docs[0], "last_id": self.docs[-1],
                "n_docs": len(self.docs), "n_tokens": sum(self.tokens), "n_bytes": self.at}


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Batches of about STEP bytes together, so that a word that repeats is looked up once."""
    some: list[pa.RecordBatch] = []
    for b in batches:
        some.append(b)
        if sum(x.nbytes for x in some) > STEP:
            yield some
            some = []
    if some:
        yield some


def write_ids(docs: DataFrame, folder: str, path: str, end_id: int | None = None, layout: Layout = Layout(),
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of every document under ``folder`` in ascending id order; the manifest of the files.

    Texts are dealt by ranges of (id, hash of the text), sorted inside a range, encoded and
    written one document at a time: a task holds one batch of texts and one file's index. Every
    attempt of a task writes files of new names; only those of the attempt that Spark commits
    reach the manifest, a Parquet table beside them. The dictionary is a file of its own, named
    by its SHA-256, which every file repeats.

    Nulls: a null text is empty and has ``end_id`` alone (no id without one). A null id comes
    first. Rows that repeat an id are documents of their own, next to each other, in the order of
    the text's hash. Other columns are ignored, whatever their names. No rows give no files.
    """
    spark = docs.sparkSession
    store, root = _store(folder)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/{layout.sha.hex()}.dictionary", compression=None) as f:
        f.write(layout.dictionary)
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
    rows = _ids(docs, id_col, text_col).withColumn("_hash", F.xxhash64("_text"))
    rows = rows.repartitionByRange("_id", "_hash").sortWithinPartitions("_id", "_hash")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, writer, full = encoder(path), None, []
        for some in _gathered(batches):
            writer = writer or _Writer(folder, layout, some[0].column(0).type)
            kind = some[0].column(0).type
            texts = [t for b in some for t in b.column(1).to_pylist()]
            for doc, data in zip((d for b in some for d in b.column(0).to_pylist()), ids.encode(texts), strict=True):
                full.append(writer.add(doc, data + end))
        if writer:
            full = [row for row in [*full, writer.close()] if row]
            types = [pa.int32(), pa.int32(), pa.string(), kind, kind, pa.int64(), pa.int64(), pa.int64()]
            if full:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in full], t) for k, t in zip(full[0], types, strict=True)], list(full[0]))

    kind = docs.schema[id_col].dataType.simpleString()
    manifest = rows.mapInArrow(write, f"part int, seq int, file string, first_id {kind}, last_id {kind}, n_docs long, n_tokens long, n_bytes long")
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.schema(manifest.schema).parquet(f"{folder}/manifest")


class _Reader:
    """One file: its index, and frames by place."""

    def __init__(self, folder: str, name: str) -> None:
        store, root = _store(folder)
        self.file = store.open_input_file(f"{root}/{name}")
        magic, sha, self.width = HEAD.unpack(self.file.read_at(HEAD.size, 0))
        size = self.file.size()
        at, tail = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC or tail != MAGIC:
            raise ValueError(f"{name} is not a whole file of token ids")
        with store.open_input_stream(f"{root}/{sha.hex()}.dictionary", compression=None) as f:
            dictionary = f.read()
        if hashlib.sha256(dictionary).digest() != sha:
            raise ValueError(f"{name}: its dictionary has changed")
        self.frames = zstandard.ZstdDecompressor(dict_data=Layout(dictionary).shared())
        self.index = pa.ipc.open_stream(self.file.read_at(size - FOOTER.size - at, at)).read_all().combine_chunks()
        self.ends = np.concatenate([[HEAD.size], self.index["end"].to_numpy()])

    def ids(self, first: int, last: int) -> list[bytes]:
        """Ids of the documents first..last-1, as little-endian 32-bit integers."""
        begin = int(self.ends[first])
        data = memoryview(self.file.read_at(int(self.ends[last]) - begin, begin))
        out = [self.frames.decompress(data[int(i) - begin: int(j) - begin]) for i, j in zip(self.ends[first:last], self.ends[first + 1: last + 1], strict=True)]
        return out if self.width == 4 else [np.frombuffer(x, f"<u{self.width}").astype("<u4").tobytes() for x in out]

    def steps(self) -> Iterator[tuple[int, int]]:
        """Runs of documents of about STEP bytes."""
        first = 0
        while first < len(self.ends) - 1:
            last = max(first + 1, int(np.searchsorted(self.ends, self.ends[first] + STEP, "right")) - 1)
            last = min(last, first + 500)
            yield first, last
            first = last


def _opened(folder: str, files: DataFrame, id_col: str, kind: str, rows_of: Callable[[_Reader, int], Iterator[tuple]]) -> DataFrame:
    """Rows (id, start, n_tokens, ids) of ``files`` (file, start), a task per file."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for docs, starts, n, ids in rows_of(_Reader(folder, name), start):
                    yield pa.RecordBatch.from_arrays([docs, pa.array(starts, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())],
                                                     [id_col, "start", "n_tokens", "ids"])

    tasks = max(1, min(files.count(), 100_000))
    return files.select("file", "start").repartition(tasks).mapInArrow(read, f"`{id_col}` {kind}, start long, n_tokens long, ids binary")


def located(manifest: DataFrame) -> DataFrame:
    """The manifest with ``start``: ids in all files before. One row per file goes through one window."""
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long")))


def read_ids(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids binary) of every document, from the files alone.

    start counts the ids of all documents before, ids are little-endian 32-bit integers. A
    dictionary whose hash is not the one that a file names, and a file without its end, are errors.
    """
    manifest = spark.read.parquet(f"{folder}/manifest")

    def every(reader: _Reader, start: int) -> Iterator[tuple]:
        n = reader.index["n"].to_numpy()
        starts = start + np.concatenate([[0], np.cumsum(n)[:-1]])
        for i, j in reader.steps():
            yield reader.index["id"].chunk(0).slice(i, j - i), starts[i:j], n[i:j], reader.ids(i, j)

    return _opened(folder, located(manifest), id_col, manifest.schema["first_id"].dataType.simpleString(), every)


def fetch_ids(spark: SparkSession, folder: str, wanted: list, id_col: str = "doc_id") -> DataFrame:
    """The same rows for a short list of ids: only files whose range holds one are opened, only their frames read."""
    manifest = spark.read.parquet(f"{folder}/manifest")
    keys = sorted(set(wanted))

    def some(reader: _Reader, start: int) -> Iterator[tuple]:
        n, ids = reader.index["n"].to_numpy(), reader.index["id"].chunk(0)
        starts = start + np.concatenate([[0], np.cumsum(n)[:-1]])
        for i in np.flatnonzero(pc.is_in(ids, pa.array(keys, ids.type)).to_numpy(zero_copy_only=False)).tolist():
            yield ids.slice(i, 1), starts[i: i + 1], n[i: i + 1], reader.ids(i, i + 1)

    def holds(key: Any) -> Column:
        return F.lit(key).between(F.col("first_id"), F.col("last_id"))

    hit = F.lit(False)
    for key in keys:
        hit = hit | holds(key)
    files = located(manifest).where(F.coalesce(hit, F.col("last_id").isNotNull()))
    return _opened(folder, files, id_col, manifest.schema["first_id"].dataType.simpleString(), some)


@query("op11_id_files")
def op11_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, written with one shared dictionary and read back."""
    docs, path = table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")
    folder = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    write_ids(docs, folder, path, 2, Layout(train_dictionary(docs, path), width=2))
    return read_ids(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
