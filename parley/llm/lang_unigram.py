"""Language identification by piece probabilities, summed over all segmentations of the text."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from parley.llm.common import fold, hold_alone, text_of
from parley.llm.registry import query, table

#: Rows of each language that a fit looks at, in expectation.
ROWS_PER_LANG = 400
#: Languages that a model holds at most; the most frequent ones.
LANGUAGES = 512
#: Words of up to so many letters are scored many at a time; longer ones one by one, with rescaling.
BATCHED = 32
#: Numbers a task remembers: distinct words times languages.
REMEMBERED = 600_000
UNKNOWN = "und"

_LETTERS = regex.compile(r"\p{L}+")
_ALNUM = re.compile(r"[^\W\d_]+")  # letters and a few more, quickly


def words_of(text: str) -> list[str]:
    """Lower-case runs of letters, each marked as the start of a word like the vocabulary's pieces."""
    runs = _ALNUM.findall(unicodedata.normalize("NFC", text).lower())
    if not all(map(str.isalpha, runs)):  # signs such as roman numbers are no letters
        runs = [w for r in runs for w in ([r] if r.isalpha() else _LETTERS.findall(r))]
    return ["▁" + w for w in runs]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> dict[str, int]:
    """Pieces of a sentencepiece file that are made of letters, numbered from 1; 0 is any unknown letter."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (
        model.is_control(i) or model.is_byte(i) or model.is_unknown(i)))
    letters = [p for p in pieces if _LETTERS.fullmatch(p.removeprefix("▁")) or p == "▁"]
    return {p: i for i, p in enumerate(dict.fromkeys(letters), 1)}


class Lattice(NamedTuple):
    """All segmentations of some words as edges, in order of their ends: word, start, end, piece."""

    n_words: int
    length: np.ndarray
    word: np.ndarray
    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray

    @property
    def width(self) -> int:
        return int(self.length.max(initial=0)) + 1


class Trie(NamedTuple):
    """Pieces as a sorted transition table: (node, letter) -> node, and the piece that ends in a node."""

    key: np.ndarray
    target: np.ndarray
    piece: np.ndarray

    def step(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The next nodes; -1 where no piece goes on like that."""
        key = (node << 21) | letter
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.target[at], -1)


@lru_cache(maxsize=2)
def trie(path: str) -> Trie:
    vocab = vocabulary(path)
    nodes: dict[tuple[int, int], int] = {}
    piece = {}
    for text, p in vocab.items():
        node = 0
        for letter in map(ord, text):
            node = nodes.setdefault((node, letter), len(nodes) + 1)
        piece[node] = p
    key = np.array([(a << 21) | c for a, c in nodes], np.int64)
    order = np.argsort(key)
    ends = np.full(len(nodes) + 1, -1, np.int64)
    ends[list(piece)] = list(piece.values())
    return Trie(key[order], np.fromiter(nodes.values(), np.int64, len(nodes))[order], ends)


def lattice(words: list[str], pieces: Trie) -> Lattice:
    """Walk the trie from every letter of every word at once."""
    length = np.fromiter(map(len, words), np.int64, len(words))
    if not len(words):
        return Lattice(0, length, *[np.zeros(0, np.int64)] * 4)
    letters = np.array(words).view(np.uint32).reshape(len(words), -1).astype(np.int64)
    word, start = np.nonzero(np.arange(letters.shape[1]) < length[:, None])
    node, size, found = np.zeros(len(word), np.int64), 0, []
    while len(word):
        inside = start + size < length[word]
        word, start, node = word[inside], start[inside], node[inside]
        node = pieces.step(node, letters[word, start + size])
        size += 1
        ends = np.where(node >= 0, pieces.piece[node], -1)
        if size == 1:  # a single letter outside the vocabulary is an unknown piece
            ends = np.maximum(ends, 0)
        hit = ends >= 0
        found.append((word[hit], start[hit], start[hit] + size, ends[hit]))
        word, start, node = word[node >= 0], start[node >= 0], node[node >= 0]
    edges = [np.concatenate(x) for x in zip(*found, strict=True)]
    order = np.argsort(edges[2], kind="stable")
    return Lattice(len(words), length, *(x[order] for x in edges))


def forward(grid: Lattice, prob: np.ndarray) -> np.ndarray:
    """alpha[position, word, language]: probability of the first letters, all segmentations summed."""
    alpha = np.zeros((grid.width, grid.n_words, prob.shape[1]))
    alpha[0] = 1
    bounds = np.searchsorted(grid.end, np.arange(grid.width + 1))
    for j in range(1, grid.width):
        at = slice(bounds[j], bounds[j + 1])
        np.add.at(alpha[j], grid.word[at], alpha[grid.start[at], grid.word[at]] * prob[grid.piece[at]])
    return alpha


def backward(grid: Lattice, prob: np.ndarray) -> np.ndarray:
    """beta[position, word, language]: probability of the rest from a position on."""
    beta = np.zeros((grid.width, grid.n_words, prob.shape[1]))
    beta[grid.length, np.arange(grid.n_words)] = 1
    order = np.argsort(grid.start, kind="stable")
    word, start, end, piece = (x[order] for x in (grid.word, grid.start, grid.end, grid.piece))
    bounds = np.searchsorted(start, np.arange(grid.width + 1))
    for i in range(grid.width - 1, -1, -1):
        at = slice(bounds[i], bounds[i + 1])
        np.add.at(beta[i], word[at], beta[end[at], word[at]] * prob[piece[at]])
    return beta


def long_word(text: str, vocab: dict[str, int], longest: int, prob: np.ndarray) -> np.ndarray:
    """Log probabilities of one word of any length: the same sum, rescaled at every letter."""
    last = [np.ones(prob.shape[1])]
    scale = np.zeros(prob.shape[1])
    for j in range(1, len(text) + 1):
        here = np.zeros(prob.shape[1])
        for i in range(max(0, j - longest), j):
            p = vocab.get(text[i:j])
            if p is not None:
                here += last[i - j] * prob[p]
            elif i == j - 1:
                here += last[-1] * prob[0]
        last = [x / here for x in last[-longest + 1:]] + [np.ones(prob.shape[1])]
        scale += np.log(here)
    return scale


class LangModel(NamedTuple):
    langs: list[str]
    prob: np.ndarray  # [piece, language]
    path: str


def fit_pieces(counts: dict[str, dict[str, int]], path: str, rounds: int = 6, smooth: float = 0.05) -> LangModel:
    """Expectation maximisation of each language's piece probabilities over its word counts.

    A piece starts from its plain number of occurrences as a substring. Every round replaces it
    by its expected number over all segmentations, plus ``smooth`` for pieces never met.
    """
    vocab = vocabulary(path)
    langs = sorted(counts)
    prob = np.zeros((len(vocab) + 1, len(langs)))
    for k, lang in enumerate(langs):
        words = sorted(w for w in counts[lang] if len(w) <= BATCHED)
        n = np.array([counts[lang][w] for w in words], float)
        grid = lattice(words, trie(path))
        expected = np.bincount(grid.piece, n[grid.word], len(vocab) + 1)
        p = (expected + smooth) / (expected + smooth).sum()
        for _ in range(rounds):
            a, b = forward(grid, p[:, None])[:, :, 0], backward(grid, p[:, None])[:, :, 0]
            total = b[0]
            share = a[grid.start, grid.word] * p[grid.piece] * b[grid.end, grid.word] / total[grid.word]
            expected = np.bincount(grid.piece, n[grid.word] * share, len(vocab) + 1)
            p = (expected + smooth) / (expected + smooth).sum()
        prob[:, k] = p
    return LangModel(langs, prob, path)


class Scorer:
    """Log probabilities of words in all languages, remembered between rows of a task."""

    def __init__(self, model: LangModel) -> None:
        self.model, self.vocab = model, vocabulary(model.path)
        self.longest = max(map(len, self.vocab))
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.model.langs)))

    def learn(self, words: list[str]) -> None:
        n = len(self.row)
        while n + len(words) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        short = [w for w in words if len(w) <= BATCHED]
        for at in range(0, len(short), 8192):
            some = short[at: at + 8192]
            some.sort(key=len)
            grid = lattice(some, trie(self.model.path))
            whole = forward(grid, self.model.prob)[grid.length, np.arange(len(some))]
            self.table[n: n + len(some)] = np.log(whole)
            self.row.update(zip(some, range(n, n + len(some)), strict=True))
            n += len(some)
        for w in words:
            if len(w) > BATCHED:
                self.table[n] = long_word(w, self.vocab, self.longest, self.model.prob)
                self.row[w] = n
                n += 1

    def predict(self, texts: list[str]) -> Iterator[tuple[str, float, float]]:
        """Language, its share of the probability, and its log probability per letter."""
        for at in range(0, len(texts), 256):
            rows = [words_of(t) for t in texts[at: at + 256]]
            new = {w for ws in rows for w in ws if w not in self.row}
            if (len(self.row) + len(new)) * len(self.model.langs) > REMEMBERED:
                self.clear()
                new = {w for ws in rows for w in ws}
            self.learn(sorted(new))
            for ws in rows:
                if not ws or not self.model.langs:
                    yield UNKNOWN, 0.0, 0.0
                    continue
                logp = self.table[np.fromiter(map(self.row.__getitem__, ws), np.int64, len(ws))].sum(0)
                odds = np.exp(logp - logp.max())
                yield self.model.langs[int(logp.argmax())], float(odds.max() / odds.sum()), float(logp.max() / sum(map(len, ws)))


@lru_cache(maxsize=1)
def _scorer(digest: str, path: str) -> list[Scorer]:
    """A place for the scorer of the last model: words stay known from task to task."""
    return []


def _let_go() -> None:
    for held in (_scorer, trie, vocabulary):
        held.cache_clear()


def scorer(model: LangModel) -> Scorer:
    place = _scorer(hashlib.sha256(repr(model.langs).encode() + model.prob.tobytes()).hexdigest(), model.path)
    if not place:
        place.append(Scorer(model))
    return place[0]


def word_counts(texts: DataFrame, lang_col: str, text_col: str) -> dict[str, dict[str, int]]:
    """Word counts by language of a bounded set of rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = words_of(text)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(words, pa.string())], ["lang", "word"])

    words = texts.select(F.col(lang_col).alias("lang"), text_of(text_col).alias("text")).mapInArrow(run, "lang string, word string")
    out: dict[str, dict[str, int]] = {}
    for lang, word, n in words.groupBy("lang", "word").count().toPandas().itertuples(index=False):
        out.setdefault(lang, {})[word] = n
    return out


def train(docs: DataFrame, learn: Column, path: str, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang", rows_per_lang: int = ROWS_PER_LANG) -> LangModel:
    """Fit on about ``rows_per_lang`` rows of each of the most frequent languages where ``learn`` holds.

    Rows are thinned by a hash of the id, so the sample is spread over all sources and the same
    at each run. Rows without a language teach nothing.
    """
    usable = docs.where(learn & F.col(lang_col).isNotNull())
    sizes = usable.groupBy(F.col(lang_col).alias("_lang")).count().orderBy(F.desc("count"), "_lang").limit(LANGUAGES)
    at = F.pmod(F.xxhash64(F.col(id_col), F.lit(21)), F.lit(1 << 30)) / F.lit(1 << 30)
    sample = usable.select(F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text"), at.alias("_at")).join(
        F.broadcast(sizes), "_lang").where(F.col("_at") * F.col("count") < F.lit(rows_per_lang))
    return fit_pieces(word_counts(sample, "_lang", "_text"), path)


def identify(docs: DataFrame, model: LangModel, text_col: str = "text", lang_col: str = "lang_pred",
             score_col: str = "lang_score", fit_col: str = "lang_fit") -> DataFrame:
    """``docs`` with the likeliest language, its share of the probability of all languages, and its fit.

    The fit is the log probability per letter: far lower for text in no learned language. Only
    the whole text is read. Without a letter, or a null text, the language is ``und``, the others 0. All columns stay; ones of the new names are replaced.
    """
    kept = docs.drop(lang_col, score_col, fit_col)
    schema = StructType([*kept.schema.fields, StructField(lang_col, StringType()), StructField(score_col, DoubleType()), StructField(fit_col, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_alone("lang_unigram", _let_go)
        known = scorer(model)
        for b in batches:
            texts = [t or "" for t in b.column(b.schema.get_field_index(text_col)).to_pylist()]
            found = list(known.predict(texts))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([f[0] for f in found], pa.string()), *(pa.array([f[k] for f in found], pa.float64()) for k in (1, 2))],
                [*b.schema.names, lang_col, score_col, fit_col])

    return kept.mapInArrow(run, schema)


def lang_model(docs: DataFrame) -> LangModel:
    """The model of the given documents: rows whose fold of 4 is 2 stay out of the fit."""
    return train(docs, fold("doc_id", 4) != 2, public_tokenizers.path("piece_bpe_32k.model"))


@query("op2_language_id")
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of all documents."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), lang_model(docs), score_col="score")
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "lang_fit")
