"""Byte-level BPE with forced boundaries: cuts at byte pairs that no vocabulary token holds."""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.common import text_of
from parley.llm.registry import query, table

#: White space as the tokenizers library sees it (fixed value: the Unicode property White_Space).
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The public pattern of pre-tokens (fixed value), with the white space above.
PATTERN = (rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+"
           rf"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: The same for texts of Latin-1 alone, with letters and numbers spelled out, for the faster engine.
_LETTER, _NUMBER, _SPACE = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
LATIN = (rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+"
         rf"|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: Distinct pre-tokens a task remembers, and the longest that it does.
REMEMBERED, LONGEST = 1_000_000, 64
#: Fragments of up to so many bytes are merged in a plain list. No rank reaches NEVER.
SHORT, NEVER = 48, 1 << 60


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file: printable ones as they are, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = [b""] * (1 + max([*vocab.values(), *self.specials.values()]))
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(letters[c] for c in token)
        for token, i in self.specials.items():
            self.bytes_of[i] = token.encode()
        self.first = [vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        merges = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        merged = [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]
        self.rank = {a << 20 | b: rank for rank, (a, b, _) in enumerate(merged)}  # of a pair of ids
        self.result = [new for _, _, new in merged]  # by rank
        # pairs of neighbouring bytes inside some token; every other pair is a certain cut
        self.inside = {pair for token, i in vocab.items() for pair in zip(self.bytes_of[i], self.bytes_of[i][1:], strict=False)}
        self.special_cut = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")") if self.specials else None
        self.any_text, self.latin_text = regex.compile(PATTERN).findall, re.compile(LATIN).findall
        self.known: dict[str, tuple[int, ...]] = {}
        self.both: dict[str, tuple[str, bytes]] = {}

    def fragments(self, data: bytes) -> Iterator[bytes]:
        """``data`` cut at every byte pair that occurs inside no token: no merge can cross it."""
        at = 0
        for i, pair in enumerate(zip(data, data[1:], strict=False), 1):
            if pair not in self.inside:
                yield data[at:i]
                at = i
        yield data[at:]

    def encode_fragment(self, data: bytes) -> list[int]:
        """Merges of the lowest rank first, the leftmost of equal ones."""
        ids = [self.first[b] for b in data]
        if len(ids) > SHORT:
            return self._encode_long(ids)
        get, result = self.rank.get, self.result
        ranks = [get(a << 20 | b, NEVER) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks and (rank := min(ranks)) < NEVER:
            i = ranks.index(rank)
            ids[i: i + 2] = [result[rank]]
            del ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 20 | ids[i], NEVER)
            if i < len(ranks):
                ranks[i] = get(ids[i] << 20 | ids[i + 1], NEVER)
        return ids

    def _encode_long(self, ids: list[int]) -> list[int]:
        """The same with a linked list and a heap, which keeps long fragments near linear."""
        n, rank, result = len(ids), self.rank.get, self.result
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # a neighbour has changed meanwhile
            new = ids[i] = result[r]
            ids[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank(new << 20 | ids[k])) is not None:
                    heapq.heappush(heap, (r, i, new, ids[k]))
            if (h := before[i]) >= 0 and (r := rank(ids[h] << 20 | new)) is not None:
                heapq.heappush(heap, (r, h, ids[h], new))
        return [i for i in ids if i >= 0]

    def encode_pre_token(self, pre: str) -> tuple[int, ...]:
        ids = tuple(chain.from_iterable(map(self.encode_fragment, self.fragments(pre.encode("utf-8", "replace")))))
        if len(pre) <= LONGEST:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[pre] = ids
        return ids

    def pre_tokens(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.any_text(text)
        return self.latin_text(text)

    def encode(self, text: str) -> list[int]:
        known, one = self.known.get, self.encode_pre_token
        out: list[int] = []
        for part in self.special_cut.split(text) if self.special_cut else [text]:
            if part in self.specials:
                out.append(self.specials[part])
            else:
                out.extend(chain.from_iterable([known(p) or one(p) for p in self.pre_tokens(part)]))
        return out

    def coded(self, text: str) -> tuple[int, str, str]:
        """How many ids a text has, the ids joined by commas, and what they decode to."""
        known, one = self.both.get, self.both_of
        found: list[tuple[str, bytes]] = []
        for part in self.special_cut.split(text) if self.special_cut else [text]:
            if part in self.specials:
                found.append((str(self.specials[part]), self.bytes_of[self.specials[part]]))
            else:
                found += [known(p) or one(p) for p in self.pre_tokens(part)]
        if not found:
            return 0, "", ""
        ids, data = zip(*found, strict=True)
        joined = ",".join(ids)
        return joined.count(",") + 1, joined, b"".join(data).decode("utf-8", "replace")

    def both_of(self, pre: str) -> tuple[str, bytes]:
        """A pre-token's ids joined by commas, and the bytes of those ids."""
        ids = list(chain.from_iterable(map(self.encode_fragment, self.fragments(pre.encode("utf-8", "replace")))))
        both = ",".join(map(str, ids)), b"".join(map(self.bytes_of.__getitem__, ids))
        if len(pre) <= LONGEST:
            if len(self.both) >= REMEMBERED:
                self.both.clear()
            self.both[pre] = both
        return both

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> ByteBpe:
    return ByteBpe(path)


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every whole text, as the vocabulary's own library encodes it.

    Special tokens in a text are matched; none is added. A null text is empty and has no ids.
    Ids may be null or repeated; other columns are ignored; no rows give no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for b in batches:
            for at in range(0, b.num_rows, 64):  # arrays of ids of a few texts at a time
                part = b.slice(at, 64)
                ids = pa.array([bpe.encode(t) for t in part.column(1).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], [id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), text_of(text_col).alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode_ids(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``: the text of its ids, special tokens included."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                column = part.column(part.schema.get_field_index(ids_col))
                ends = column.offsets.to_pylist()  # counted from the start of the whole batch, as the values are
                flat = column.values.slice(ends[0], ends[-1] - ends[0]).to_pylist()
                text = pa.array([bpe.decode(flat[i - ends[0]: j - ends[0]]) for i, j in zip(ends, ends[1:], strict=False)], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, text], [*part.schema.names, "decoded"])

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{names}, decoded string")


def coded_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids, decoded): ids of every whole text joined by commas, and the text those ids decode to.

    The same as ``encode_texts`` and ``decode_ids`` one after the other, in one pass that keeps
    both forms of a pre-token. Nulls, repeated rows and other columns are taken as there.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                n, ids, decoded = zip(*map(bpe.coded, part.column(1).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                    [id_col, "n_tokens", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), text_of(text_col).alias("_text")).mapInArrow(
        run, f"`{id_col}` {kind}, n_tokens long, ids string, decoded string")


@query("op6_byte_bpe")
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again, as digests."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return coded_texts(table(spark, sf_dir, "documents"), path).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
