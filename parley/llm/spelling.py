"""Spelling variants: generated edits probe length-sharded Bloom filters, positives meet the vocabulary exactly."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.common import stored, text_of
from parley.llm.registry import query, table
from parley.operators.ordered import chase

#: Letters are a-z and U+00C0..U+00FF; A-Z are lower-cased before. Words have so many code points and occurrences at least.
MIN_LENGTH, MIN_COUNT = 6, 5
#: One run in so many, by a hash of document and run, loses a letter.
TYPOS = 199
#: A form occurs so many times as often as its variant, at least.
RATIO = 5
#: Words longer than this share one shard. Bits a word takes in a filter, and bytes of filters that are broadcast at a time.
LONG, WORD_BITS, PASS_BYTES = 64, 20, 8 << 20
#: Distinct words a task counts before it passes them on, letters that are edited, and probes of a task.
COUNTED, LETTERS, TASK_PROBES = 200_000, 200_000, 20_000_000
#: Odd multiplier of the polynomial hash (any would do), and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def planted(run: str, prefix: int) -> str:
    """The run, or in one case of TYPOS the run without one letter; ``prefix`` is the crc32 of ``<id>:``."""
    h = zlib.crc32(run.encode(), prefix)
    if h % TYPOS:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of every word of whole texts, with at least MIN_LENGTH letters and MIN_COUNT occurrences.

    Runs are counted per text, then per task in a table of bounded size, before the shuffle.
    """
    runs = re.compile(rf"[a-z\u00C0-\u00FF]{{{MIN_LENGTH},}}").findall

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: defaultdict[str, int] = defaultdict(int)

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                prefix = zlib.crc32(f"{doc}:".encode())
                # lower-casing bytes leaves letters beyond ASCII as they are
                for run, n in Counter(runs(text.encode("utf-8", "replace").lower().decode())).items():
                    total[planted(run, prefix)] += n
                if len(total) >= COUNTED:
                    yield batch()
                    total.clear()
        yield batch()

    rows = docs.select(text_of(id_col).alias("doc"), text_of(text_col).alias("text"))
    return (rows.mapInArrow(count, "word string, n long").where(F.length("word") >= MIN_LENGTH)
            .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT))


class Shard(NamedTuple):
    """Words of one length (or longer ones) whose hash falls on ``part`` of ``parts``: blocks of four 64-bit words."""

    length: int
    part: int
    parts: int
    first: int
    blocks: int


def plan_passes(counts: dict[int, int], limit: int = PASS_BYTES) -> list[list[Shard]]:
    """Shards of all lengths in passes of at most ``limit`` bytes; a length too large for one is parted by hash."""
    passes: list[list[Shard]] = []
    used = 0
    most = max(1, limit // 32)  # blocks
    for length, n in sorted(counts.items()):
        blocks = -(-n * WORD_BITS // 256)
        parts = -(-blocks // most)
        for part in range(parts):
            size = -(-blocks // parts)
            if not passes or used + size > most:
                passes.append([])
                used = 0
            passes[-1].append(Shard(length, part, parts, used, size))
            used += size
    return passes


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _masks(mixed: np.ndarray, j: int) -> np.ndarray:
    """Two bits in the j-th word of a block."""
    one, six = np.uint64(1), np.uint64(63)
    return (one << ((mixed >> np.uint64(12 * j)) & six)) | (one << ((mixed >> np.uint64(12 * j + 6)) & six))


def _at(mixed: np.ndarray, shard: Shard) -> tuple[np.ndarray, np.ndarray]:
    """Whether a hash belongs to the shard's part, and the first word of its block."""
    again = _mixed(mixed ^ np.uint64(BASE))
    mine = again % np.uint64(shard.parts) == np.uint64(shard.part) if shard.parts > 1 else np.ones(len(mixed), bool)
    return mine, 4 * (shard.first + (again >> np.uint64(20)) % np.uint64(shard.blocks)).astype(np.int64)


def _powers(length: int) -> np.ndarray:
    """BASE^(length-1), ..., BASE, 1 modulo 2^64."""
    steps = np.full(length, BASE, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)[::-1]


def _letters(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.array(words).view(np.uint32).reshape(len(words), -1).astype(np.uint64)


def _same_length(words: list[str]) -> Iterator[tuple[int, list[int]]]:
    """Places of words of one length, about LETTERS letters at a time."""
    by: defaultdict[int, list[int]] = defaultdict(list)
    for i, w in enumerate(words):
        by[len(w)].append(i)
    for length, places in by.items():
        step = max(1, LETTERS // length)
        for at in range(0, len(places), step):
            yield length, places[at: at + step]


def _hash(contributions: np.ndarray, length: int) -> np.ndarray:
    """The hash of words from the sums of their letters' shares."""
    return _mixed(contributions + np.uint64(length))


def build(vocabulary: DataFrame, shards: list[Shard]) -> np.ndarray:
    """The filters of one pass, at most PASS_BYTES: tasks set bits, Spark joins them by OR."""
    lengths = {s.length for s in shards}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column(0).to_pylist()
            for length, places in _same_length(words):
                letters = _letters([words[i] for i in places])
                mixed = _hash((letters * _powers(length)).sum(axis=1, dtype=np.uint64), length)
                for shard in shards:
                    if shard.length == min(length, LONG + 1):
                        mine, at = _at(mixed, shard)
                        chosen, first = mixed[mine], at[mine]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.concatenate([first + j for j in range(4)])),
                             pa.array(np.concatenate([_masks(chosen, j) for j in range(4)]).view(np.int64))], ["at", "bits"])

    kept = vocabulary.where(F.least(F.length("word"), F.lit(LONG + 1)).isin(*lengths)).select("word")
    found = kept.mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()
    bits = np.zeros(4 * sum(s.blocks for s in shards), np.uint64)
    bits[found["at"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    return bits


def _hits(h: np.ndarray, length: int, shards: list[Shard], bits: np.ndarray) -> np.ndarray:
    """Places of ``h`` (sums of letters' shares of words of ``length``) that some shard may hold."""
    out = []
    mixed = _hash(h, length)
    for shard in shards:
        if shard.length == min(length, LONG + 1):
            mine, at = _at(mixed, shard)
            left = np.flatnonzero(mine)
            for j in range(4):
                mask = _masks(mixed[left], j)
                left = left[(bits[at[left] + j] & mask) == mask]
            out.append(left)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def edits(words: list[str], alphabet: np.ndarray, shards: list[Shard], bits: np.ndarray) -> Iterator[tuple[int, str]]:
    """(place of the word, edited word) for every edit that the filters may hold.

    A pair of near words is generated from one side: by deleting a letter of the longer word, or
    by replacing a letter with a greater one. Of equal neighbouring letters the last is deleted.
    """
    wanted = {s.length for s in shards}
    for length, places in _same_length(words):
        shorter, same = min(length - 1, LONG + 1) in wanted, min(length, LONG + 1) in wanted
        if not (shorter or same):
            continue
        letters = _letters([words[i] for i in places])
        shares = letters * _powers(length)
        total = shares.sum(axis=1, dtype=np.uint64)
        if shorter and length > 1:
            upto = np.cumsum(shares, axis=1, dtype=np.uint64)
            rest = (total[:, None] - upto) + (upto - shares) * np.uint64(INVERSE)
            row, at = np.nonzero(np.concatenate([letters[:, 1:] != letters[:, :-1], np.ones((len(places), 1), bool)], axis=1))
            for k in _hits(rest[row, at], length - 1, shards, bits).tolist():
                word = words[places[row[k]]]
                yield places[row[k]], word[:at[k]] + word[at[k] + 1:]
        if same:
            powers = _powers(length)
            for letter in alphabet:
                row, at = np.nonzero(letters < letter)
                h = total[row] + (letter - letters[row, at]) * powers[at]
                for k in _hits(h, length, shards, bits).tolist():
                    word = words[places[row[k]]]
                    yield places[row[k]], word[:at[k]] + chr(letter) + word[at[k] + 1:]


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, n, near, near_n) for every ordered pair of ``vocabulary`` (word, n) at one edit of one letter.

    Filters are built and broadcast in passes of at most PASS_BYTES, each for some lengths, so what
    is broadcast does not grow with the vocabulary, and the share of false positives stays. Only
    positives are shuffled; the join with the vocabulary takes the false ones out.
    """
    spark = vocabulary.sparkSession
    length = F.least(F.length("word"), F.lit(LONG + 1))
    sizes = vocabulary.groupBy(length.alias("l")).agg(F.count("*").alias("c"), F.sum(F.length("word")).alias("s")).collect()
    alphabet = np.array(sorted(ord(r[0]) for r in vocabulary.select(F.explode(F.split("word", "")).alias("c")).where("c != ''").distinct().collect()), np.uint64)
    tasks = max(1, -(-sum(r["s"] for r in sizes) * (len(alphabet) // 2 + 1) // TASK_PROBES))
    rows = vocabulary.select("word", "n").repartition(int(tasks), "word")
    found: DataFrame | None = None
    for shards in plan_passes({r["l"]: r["c"] for r in sizes}):
        filters = spark.sparkContext.broadcast(build(vocabulary, shards))

        def probe(batches: Iterator[pa.RecordBatch], shards=shards, filters=filters) -> Iterator[pa.RecordBatch]:
            for b in batches:
                words, n = b.column(0).to_pylist(), b.column(1)
                some: list[tuple[int, str]] = []
                for pair in edits(words, alphabet, shards, filters.value):
                    some.append(pair)
                    if len(some) == 500:
                        yield _pairs(words, n, some)
                        some = []
                yield _pairs(words, n, some)

        concerned = {s.length + more for s in shards for more in (0, 1)}  # replacing keeps a length, deleting comes from the next
        one = rows.where(length.isin(*concerned)).mapInArrow(probe, "word string, n long, near string")
        found = one if found is None else found.unionByName(one)
    if found is None:
        return vocabulary.select("word", "n", F.col("word").alias("near"), F.col("n").alias("near_n")).limit(0)
    # both directions read the same positives
    exact = stored(found).join(vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    there = exact.select("word", "n", "near", "near_n")
    back = exact.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return there.unionByName(back)


def _pairs(words: list[str], n: pa.Array, some: list[tuple[int, str]]) -> pa.RecordBatch:
    places = pa.array([i for i, _ in some], pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([words[i] for i, _ in some], pa.string()), n.take(places), pa.array([w for _, w in some], pa.string())],
                                      ["word", "n", "near"])


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    A word's form is its near word of largest n (ties: the first by code points) if that occurs at
    least RATIO times as often; root is the end of the chain of forms. Counts rise along a chain, so
    it ends after few steps, and pointers double.

    Nulls: a null text has no words; a null id counts as empty before the colon. Rows that repeat
    an id or a text count as they are. Other columns are ignored, whatever their names. No rows, or
    no word that is frequent enough, give no rows.
    """
    vocabulary = stored(count_words(docs, id_col, text_col))
    best = near_words(vocabulary).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w"))).alias("best"))
    frequent = -F.col("best.m") >= RATIO * F.col("n")
    known = stored(vocabulary.join(best, "word", "left").select(
        "word", F.when(frequent, F.col("best.w")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(frequent, -F.col("best.m")).alias("form_n")))
    roots = chase(known.where("form is not null").select(F.col("word").alias("node"), F.col("form").alias("next")))
    return known.join(roots.select(F.col("node").alias("word"), "root"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


SQL = r"""
WITH RECURSIVE crc_table AS (SELECT list(v ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
  FROM range(256) r(i))),
runs AS (SELECT doc_id, run, count(*) AS n FROM (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run
  FROM documents) WHERE length(run) >= 6 GROUP BY ALL),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + (unicode(c) >> 6)::BIGINT, 128 + (unicode(c) & 63)::BIGINT] END))),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM runs, crc_table),
v AS (SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
cuts AS (SELECT word, n, i, left(word, i) || '*' || substr(word, i + 2) AS wild, left(word, i) || substr(word, i + 2) AS less
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
shorter AS (SELECT DISTINCT c.word, c.n, v.word AS near, v.n AS near_n FROM cuts c JOIN v ON v.word = c.less),
near AS (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.wild = b.wild AND a.i = b.i AND a.word <> b.word
  UNION ALL SELECT * FROM shorter UNION ALL SELECT near, near_n, word, n FROM shorter),
best AS (SELECT word, count(*) AS n_near, min({'m': -near_n, 'w': near}) AS b FROM near GROUP BY 1),
forms AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.m >= 5 * v.n THEN b.w END AS form,
  CASE WHEN -b.m >= 5 * v.n THEN -b.m END AS form_n FROM v LEFT JOIN best ON best.word = v.word),
chain AS (SELECT word, word AS root, form FROM forms
  UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON f.word = c.form)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON c.word = f.word AND c.form IS NULL
"""


@query("op13_spelling_groups", SQL)
def op13_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, each with its more frequent neighbour and the end of that chain."""
    return spelling_groups(table(spark, sf_dir, "documents"))
