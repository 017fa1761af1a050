"""Every operator on nulls, empty and long texts, ties, repeated rows, no rows and clashing columns."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from parley.llm import best_fit, byte_bpe, exact_dedup, jaccard_join, lang_unigram, main_text, minhash, pu_quality, token_counts

#: Names that operators use inside.
CLASH = ["_id", "id", "node", "n", "_text", "_hit", "_key", "_bucket", "_len", "score", "token", "label", "kept", "_range"]
LONG = "langer text mit wörtern " * 4000
ROWS = [(1, "a b c d e f"), (1, "a b c d e f"), (2, None), (3, ""), (4, " \n\t"), (5, "a  b c\nd e f"), (None, "other words here"),
        (6, LONG), (7, "x" * 50_000), (8, "ok"), (9, "1 2 3 !!"), (10, "émigré naïve 漢字 🎉")]


def frame(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs.withColumns({c: F.lit("clash") for c in CLASH})


def model():
    x = np.array([pu_quality.features(t) for t in ("good words here", "fine words too", "BAD!! ###")])
    return pu_quality.fit_pu(x[:2], x, 0.7, steps=20)


def langs():
    return lang_unigram.fit_pieces({"aa": {"▁abc": 3, "▁text": 2}, "bb": {"▁wörter": 2}}, public_tokenizers.path("piece_bpe_32k.model"), rounds=2)


OPERATORS = {
    "score_quality": lambda d: pu_quality.score_quality(d, model()),
    "identify": lambda d: lang_unigram.identify(d, langs()),
    "best_fit": lambda d: best_fit.best_fit_pack(best_fit.token_pieces(d, public_tokenizers.path("word_bpe_49k.json"), 1, 512), 512),
    "near_duplicates": lambda d: jaccard_join.near_duplicates(d),
    "drop_near_copies": lambda d: jaccard_join.drop_near_copies(d),
    "count_tokens": lambda d: token_counts.count_tokens(d, public_tokenizers.path("piece_bpe_32k.model")),
    "byte_bpe_pass": lambda d: byte_bpe.coded_texts(d, public_tokenizers.path("byte_bpe_50k.json")),
    "byte_bpe": lambda d: byte_bpe.decode_ids(byte_bpe.encode_texts(d, public_tokenizers.path("byte_bpe_50k.json")), public_tokenizers.path("byte_bpe_50k.json")),
    "exact_dedup": lambda d: exact_dedup.exact_dedup(d),
    "drop_copies": lambda d: exact_dedup.drop_copies(d),
    "fingerprints": lambda d: minhash.fingerprints(d),
    "edited_neighbours": lambda d: minhash.edited_neighbours(d),
    "main_text": lambda d: main_text.extract_main_text(d, "text", "out", ("doc_id",)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_edge_rows(spark, name):
    got = OPERATORS[name](frame(spark, ROWS)).collect()
    if name == "drop_copies":
        assert sorted(r.doc_id or 0 for r in got) == [0, 4, 5, 6, 7, 8, 9, 10]
    elif name == "drop_near_copies":
        assert sorted(r.doc_id or 0 for r in got) == [0, 1, 1, 2, 3, 4, 6, 7, 8, 9, 10]
    elif name == "best_fit":
        assert {r.doc_id for r in got if r.length} == {r[0] for r in ROWS}
    else:
        assert len(got) == len(ROWS)


def test_near_copies_go_by_their_own_text(spark):
    text = " ".join(f"w{i}" for i in range(60))
    near, far = f"{text} end", " ".join(f"v{i}" for i in range(40))
    lone = " ".join(f"u{i}" for i in range(40))
    null = " ".join(f"n{i}" for i in range(60))
    rows = [(3, text), (5, near), (5, far), (None, f"{text} stop"), (None, lone), (7, lone + " x"), (None, null), (None, f"{null} end"),
            (8, "a b c d e f"), (8, "A b c d e f"), (9, "g h i j k l"), (9, "g h i j k l"), (10, ""), (10, None)]
    got = [tuple(r) for r in jaccard_join.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"), once=True).collect()]
    kept = {t: i for i, t in got}
    assert kept[text] == 3 and kept[far] == 5 and kept[lone + " x"] == 7 and kept[""] == kept[None] == 10
    assert not {near, f"{text} stop", lone} & set(kept)
    assert len({null, f"{null} end"} & set(kept)) == 1
    assert sorted(i or 0 for i, _ in got) == [0, 3, 5, 7, 8, 9, 10, 10]


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(spark, name):
    assert OPERATORS[name](frame(spark, ROWS).where("false")).count() == 0
