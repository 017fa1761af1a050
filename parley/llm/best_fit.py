"""Best-fit packing of documents into sequences, certified by dual-feasible-function bounds."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import count as count_from

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.byte_bpe import byte_letters
from parley.llm.common import hold_alone, text_of
from parley.llm.registry import query, table
from parley.session import cut

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", _row long, sequence_id long, offset long, _part long, _open boolean, _gap long"
#: Distinct white-space-free chunks a task remembers, about 150 MB.
REMEMBERED = 1_000_000
#: The exchange goes on while a round saves at least one in so many of the sequences that take part.
WORTH = 10_000
#: The tokenizer's own pattern of pre-tokens (fixed value), with the lower-case letters, numbers
#: and white space of Latin-1 spelled out.
_PRE_TOKENS = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]"
    r"|[^\t-\r \x85\xa0a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+")


class ChunkEncoder:
    """Token ids of texts by the tokenizers library, asked once per distinct pre-token.

    The tokenizer drops white space and no token crosses it, so ids of a text are the ids of
    its chunks between ASCII white space, in order. Ids are kept as little-endian bytes.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        self.remembered = remembered
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.letters = {b: c for c, b in byte_letters().items()}  # the vocabulary's letter of each byte
        self.id_bytes = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.known: dict[bytes, bytes] = {}

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        known = self.known
        for text in texts:
            plain = _is_plain(text)
            chunks = (text.lower() if plain else text).encode("utf-8", "replace").split()
            found = list(map(known.get, chunks))
            if None in found:
                self._learn({c for c, ids in zip(chunks, found, strict=True) if ids is None}, chunks, plain)
                found = list(map(known.__getitem__, chunks))
            yield b"".join(found)

    def _learn(self, missing: set[bytes], chunks: list[bytes], plain: bool) -> None:
        known = self.known
        if len(known) + len(missing) > self.remembered:
            known.clear()
            missing = set(chunks)
        if not plain:
            some = list(missing)
            encoded = self.tokenizer.encode_batch([c.decode() for c in some], add_special_tokens=False)
            known.update((c, np.array(e.ids, "<u4").tobytes()) for c, e in zip(some, encoded, strict=True))
            return
        parts = {c: [p.encode() for p in _PRE_TOKENS.findall(c.decode())] for c in missing}
        tokenize, letters, id_bytes = self.model.tokenize, self.letters, self.id_bytes
        for p in {p for ps in parts.values() for p in ps if p not in known}:
            # its normal form is the pre-token itself, so the model can be asked without the steps before it
            known[p] = b"".join([id_bytes[t.id] for t in tokenize(p.decode("latin-1").translate(letters))])
        known.update((c, b"".join(map(known.__getitem__, ps))) for c, ps in parts.items())


@lru_cache(maxsize=1)
def chunk_encoder(path: str, remembered: int = REMEMBERED) -> ChunkEncoder:
    return ChunkEncoder(path, remembered)


def _is_plain(text: str) -> bool:
    """Latin-1 alone and no special token: lower-casing first and cutting pre-tokens here is then exact."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return "<|" not in text


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, id_col: str = "doc_id",
                 text_col: str = "text", remembered: int = REMEMBERED) -> DataFrame:
    """The pieces of every document: its ids and ``end_id``, cut only where longer than ``capacity``.

    ``remembered`` chunks are known to a task at once, about 150 bytes each; fewer cost time alone.
    """
    end = np.array([end_id], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_alone("best_fit", chunk_encoder.cache_clear)
        encoder = chunk_encoder(tokenizer_path, remembered)
        for batch in batches:
            out: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist()), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at: at + 4 * capacity]
                    out.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            names, kinds = zip(*(c.rsplit(" ", 1) for c in PIECES.split(", ")), strict=True)
            columns = zip(*out, strict=True) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int32() if k == "int" else pa.int64()) for c, k in zip(columns, kinds, strict=True)], list(names))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(pieces, PIECES)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Sequences that any packing needs: the best of two families of dual feasible functions.

    f(l): lengths over capacity - l count as a whole sequence, those under l as nothing.
    u(k): a length counts as floor((k + 1) x) / k of a sequence, exact multiples as they are.
    """
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    below, tokens = np.cumsum(count), np.cumsum(count * size)
    cut_at = np.arange(0, capacity // 2 + 1)
    whole = below[-1] - below[capacity - cut_at]
    middle = tokens[capacity - cut_at] - np.where(cut_at > 0, tokens[np.maximum(cut_at - 1, 0)], 0)
    best = int((whole + -(-middle // capacity)).max())
    for k in range(1, 33):
        times, rest = np.divmod(size * (k + 1), capacity)
        scaled = np.where(rest == 0, size * k, times * capacity)  # in units of 1 / (k * capacity)
        best = max(best, int(-(-(count * scaled).sum() // (k * capacity))))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and what each bin has left."""
    order = np.argsort(-lengths, kind="stable")
    bin_of, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    left: list[int] = []
    by_left: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0  # bit r: there is a bin with r left
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = some >> n
        if n and fits:
            r = (fits & -fits).bit_length() - 1 + n
            b = by_left[r].pop()
            if not by_left[r]:
                some ^= 1 << r
        else:
            b, r = len(left), capacity
            left.append(capacity)
        bin_of[i], offset[i] = b, capacity - r
        r -= n
        left[b] = r
        if r:
            if not by_left[r]:
                some |= 1 << r
            by_left[r].append(b)
    return bin_of, offset, np.array(left, np.int64)


def _pack(rows: DataFrame, capacity: int, parts: int, turn: int) -> DataFrame:
    """Best-fit decreasing in each of ``parts`` partitions; bins to exchange are marked ``_open``."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_row", ignore_index=True)
        lengths = pdf["length"].to_numpy(np.int64)
        bin_of, offset, left = best_fit_decreasing(lengths, capacity)
        gap = len(left) - lower_bound(lengths, capacity)
        # without a gap only the emptiest sequence can gain, with one those that lack a 64th or more
        give = left * 64 >= capacity if gap else np.arange(len(left)) == left.argmax()
        base = (turn << 56) + (int(pdf["_part"].iloc[0]) << 32)
        return pdf.assign(sequence_id=base + bin_of, offset=offset, _open=give[bin_of] & (left[bin_of] > 0), _gap=np.int64(gap))

    part = F.pmod(F.xxhash64("_row", F.lit(turn)), F.lit(parts))
    return (rows.select(*[c.split()[0] for c in PIECES.split(", ")], "_row", part.alias("_part"))
            .groupBy("_part").applyInPandas(one, PACKED))


def best_fit_pack(pieces: DataFrame, capacity: int = 4096, bins_per_part: int = 4096, rows_per_part: int = 100_000) -> DataFrame:
    """``pieces`` with sequence_id, offset and gap: as few sequences of ``capacity`` tokens as found.

    Rows are dealt to partitions of bounded size by a hash of the row, so no key is hot. Each
    partition runs best-fit decreasing and compares its count with a lower bound that any
    packing must obey. A partition that meets it is certified and keeps its sequences but the
    emptiest one. The others give up all sequences that lack a 64th or more. What is given up is mixed
    over new partitions and packed again, until their tokens allow no fewer sequences or a round
    saves less than one in ``WORTH`` of those given up (of fewer than that: none). ``gap`` tells how
    many sequences the partition that a row was last packed in has beyond its bound; 0 is certified.

    Ties of length are taken in row order, so the result is the same for the same input files.
    No rows give no rows; lengths over ``capacity`` are an error.
    """
    rows = cut(pieces).withColumn("_row", F.monotonically_increasing_id())
    total, n, longest = rows.agg(F.sum("length"), F.count("*"), F.max("length")).first()
    if n == 0:
        return rows.select("*", F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("long").alias("offset"),
                           F.lit(None).cast("long").alias("gap")).drop("_row")
    if longest > capacity:
        raise ValueError(f"a piece of {longest} tokens is longer than {capacity}")

    def parts(tokens: int, count: int) -> int:
        return max(1, -(-tokens // (capacity * bins_per_part)), -(-count // rows_per_part))

    packed = cut(_pack(rows, capacity, parts(total, n), 0))
    done: list[DataFrame] = []
    for turn in count_from(1):
        given = packed.where("_open")
        tokens, count, bins = given.agg(F.sum("length"), F.count("*"), F.countDistinct("sequence_id")).first()
        if not count or bins <= -(-tokens // capacity):
            break
        again = cut(_pack(given, capacity, parts(tokens, count), turn))
        saved = bins - again.select("sequence_id").distinct().count()
        if saved <= 0:
            break
        done.append(packed.where("not _open"))
        packed = again
        if saved * WORTH < bins:
            break
    for kept in done:
        packed = packed.unionByName(kept)
    return packed.select(*[c.split()[0] for c in PIECES.split(", ")], "sequence_id", "offset", F.col("_gap").alias("gap"))


@query("op3_best_fit_packing")
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens of the word-level vocabulary."""
    docs = table(spark, sf_dir, "documents")
    return best_fit_pack(token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096))
