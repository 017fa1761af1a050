"""Unigram token counts: one forward pass per shared prefix of the distinct pre-tokens."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.common import text_of
from parley.llm.registry import query, table

#: A letter outside the vocabulary costs the lowest score less this, and one token per byte.
UNKNOWN_PENALTY = 10.0
#: Distinct pre-tokens a task remembers, and the longest that it does.
REMEMBERED, LONGEST = 300_000, 64


class UnigramCounter:
    """Token counts of the best segmentation: highest sum of piece scores, then fewest tokens."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        score = {model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size()) if not (
            model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
        self.score = {p.replace("▁", " "): s for p, s in score.items()}
        self.unknown = min(self.score.values()) - UNKNOWN_PENALTY
        self.suffixes = {p[i:] for p in self.score for i in range(len(p))}
        # no piece goes on with a blank after anything else, and none holds a line feed
        held = {c for p in self.score for c in p}
        cuts = "".join(c for c in "\n\t\r" if c not in held)
        assert not any(" " in p.lstrip(" ") for p in self.score)
        self.pre_tokens = regex.compile(rf" *[^ {cuts}]+| +|[{cuts}]" if cuts else r" *[^ ]+| +").findall
        self.known: dict[str, int] = {}

    def walk(self, words: list[str]) -> Iterator[tuple[str, int]]:
        """Depth-first walk of the trie of ``words``, which is their sorted order.

        Only the path to the current node is held: best score and count of every prefix. A word
        goes on from the last node it shares with the word before, so a node is met once.
        """
        score, suffixes, unknown = self.score, self.suffixes, self.unknown
        best: list[tuple[float, int]] = [(0.0, 0)]  # by depth: score, minus tokens
        last = ""
        for word in sorted(words):
            shared = 0
            for a, b in zip(last, word, strict=False):
                if a != b:
                    break
                shared += 1
            del best[shared + 1:]
            for j in range(shared + 1, len(word) + 1):
                letter = word[j - 1]
                s, n = best[j - 1]
                top = (s + score[letter], n - 1) if letter in score else (s + unknown, n - len(letter.encode("utf-8", "replace")))
                i = j - 2
                while i >= 0 and (piece := word[i:j]) in suffixes:
                    if (gain := score.get(piece)) is not None:
                        s, n = best[i]
                        top = max(top, (s + gain, n - 1))
                    i -= 1
                best.append(top)
            last = word
            yield word, -best[-1][1]

    def count(self, texts: list[str]) -> Iterator[int]:
        for at in range(0, len(texts), 256):
            rows = [self.pre_tokens(" " + t) if t else [] for t in texts[at: at + 256]]
            new = {w for ws in rows for w in ws if w not in self.known}
            if len(self.known) + len(new) > REMEMBERED:
                self.known.clear()
                new = {w for ws in rows for w in ws}
            self.known.update(self.walk(list(new)))
            for ws in rows:
                yield sum(map(self.known.__getitem__, ws))
            for w in [w for w in new if len(w) > LONGEST]:
                del self.known[w]


@lru_cache(maxsize=2)
def counter(path: str) -> UnigramCounter:
    return UnigramCounter(path)


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens long) of every whole text under the vocabulary's scores.

    A blank is put before the text, as the vocabulary expects; line feeds and other unknown
    letters count one token per byte. A null or empty text has none. Ids may be null or
    repeated; other columns are ignored; no rows give no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(path)
        for b in batches:
            n = list(counts.count(b.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], [id_col, "n_tokens"])

    return docs.select(F.col(id_col), text_of(text_col).alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long")


@query("op5_token_counts")
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of all documents under the 32k vocabulary."""
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
