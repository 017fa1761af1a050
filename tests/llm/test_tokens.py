"""Encoders against the tokenizers library, counts against brute force, packing against its own contract."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from parley.llm.best_fit import ChunkEncoder, best_fit_decreasing, best_fit_pack, lower_bound, token_pieces
from parley.llm.byte_bpe import ByteBpe
from parley.llm.token_counts import UnigramCounter

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def texts(n=600):
    r = random.Random(5)
    pools = ["ab cde\n\t'séü ñ#$%🎉<|>\x85\xa012İ", "".join(map(chr, range(1, 256))), "the quick brown fox. It's We'LL "]
    return ["", "  a  b\n\n c\t\td ", "<|endoftext|>x<|endoftext|> <|endoftext|", "<|STARTOFTEXT|> a <|startoftext|>b", "İstanbul ΑΣ Σ don't 'S it's",
            "a\x1c b\x1f\x85c\xa0d e　f", "x" * 3000, "ab" * 2000, "H̱ ẖ éà ́x 한국어 𝒳𝒴 🎉‍🔥", "²Ⅷ½ १२३", "''s 's"] + [
        "".join(r.choice(pool) for _ in range(r.randrange(1, 60))) for pool in pools for _ in range(n // 3)]


def test_byte_bpe_is_the_library():
    library, own = Tokenizer.from_file(BYTES), ByteBpe(BYTES)
    for t in texts():
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)
        for _ in range(2):  # learned, and remembered
            assert own.coded(t) == (len(ids), ",".join(map(str, ids)), own.decode(ids))


def test_forced_cuts_lie_inside_no_token():
    own = ByteBpe(BYTES)
    for t in texts(60):
        assert b"".join(own.fragments(t.encode())) == t.encode()
    assert not any((a, b) not in own.inside for token in own.bytes_of if token not in map(str.encode, own.specials)
                   for a, b in zip(token, token[1:], strict=False))


def test_chunk_encoder_is_the_library():
    library, own = Tokenizer.from_file(WORDS), ChunkEncoder(WORDS)
    many = texts()
    for t, got in zip(many, own.encode(many), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_token_counts_are_the_best_segmentation():
    own = UnigramCounter(public_tokenizers.path("piece_bpe_32k.model"))

    def best(s):
        """All segmentations, by plain recursion."""
        if not s:
            return 0.0, 0
        ways = []
        for j in range(1, len(s) + 1):
            rest = best(s[j:])
            if s[:j] in own.score:
                ways.append((rest[0] + own.score[s[:j]], rest[1] - 1))
            elif j == 1:
                ways.append((rest[0] + own.unknown, rest[1] - len(s[0].encode())))
        return max(ways)

    words = [" thing", " things", " thin", " é漢a", " a", "  x", " in\t", " tion"]
    assert dict(own.walk(words)) == {w: -best(w)[1] for w in words}
    assert list(own.count(["", "thing things\nin", "a"])) == [0, -best(" thing")[1] - best(" things")[1] + 1 - best("in")[1], -best(" a")[1]]


def test_token_counts_are_the_library_in_unigram_mode():
    pb2 = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    spec = pb2.ModelProto()
    spec.ParseFromString(open(path, "rb").read())
    spec.trainer_spec.model_type = 1
    library = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())
    own = UnigramCounter(path)
    many = ["The quick brown fox", "thing\nand  more", "é漢字 ok", "INTERNATIONALISATION of things"]
    assert list(own.count(many)) == [len(library.encode(t)) for t in many]


@pytest.mark.parametrize("seed", range(4))
def test_best_fit_and_bound(seed):
    r = np.random.default_rng(seed)
    lengths = r.integers(1, [101, 30, 60, 101][seed], 400)
    bins, offset, left = best_fit_decreasing(lengths, 100)
    used = np.bincount(bins, lengths)
    assert (used == 100 - left).all() and used.max() <= 100
    for b in range(len(left)):
        at = np.flatnonzero(bins == b)
        at = at[np.argsort(offset[at])]
        assert offset[at].tolist() == np.r_[0, lengths[at].cumsum()[:-1]].tolist()
    assert -(-lengths.sum() // 100) <= lower_bound(lengths, 100) <= len(left)


def test_bound_sees_more_than_the_sum():
    assert lower_bound(np.array([51] * 10), 100) == 10
    assert lower_bound(np.array([34] * 9), 100) == 5


def test_packing(spark):
    r = random.Random(3)
    docs = [(i, " ".join(r.choice(("word", "thing", "longer")) for _ in range(r.choice((0, 3, 20, 90, 400))))) for i in range(300)] + [(-1, None)]
    pieces = token_pieces(spark.createDataFrame(docs, "doc_id long, text string"), WORDS, 1, 128)
    rows = best_fit_pack(pieces, 128, bins_per_part=20).toPandas()
    library = Tokenizer.from_file(WORDS)
    for doc, text in docs:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        own = rows[rows.doc_id == doc].sort_values("piece")
        assert own.start.tolist() == list(range(0, len(ids), 128)) and own.length.sum() == len(ids)
        assert own.ids_crc32.tolist() == [zlib.crc32(ids[s: s + 128].tobytes()) for s in range(0, len(ids), 128)]
    for _, one in rows.sort_values("offset").groupby("sequence_id"):
        assert one.offset.tolist() == [0, *one.length.cumsum()[:-1]] and one.length.sum() <= 128
    # dealt over several partitions and certified or exchanged, it needs no more than one best fit of all
    assert rows.sequence_id.nunique() <= best_fit_decreasing(rows.length.to_numpy(), 128)[2].size + 1


def test_exchange_goes_on_while_it_saves(spark):
    """Pieces of a quarter to two thirds of a sequence, over many small partitions."""
    r = np.random.default_rng(7)
    lengths = r.integers(1100, 2700, 3000).tolist()
    pieces = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    rows = best_fit_pack(pieces, 4096, bins_per_part=128).toPandas()
    assert rows.length.groupby(rows.sequence_id).sum().max() <= 4096 and len(rows) == 3000
    bound, whole = lower_bound(np.array(lengths), 4096), len(best_fit_decreasing(np.array(lengths), 4096)[2])
    assert bound <= rows.sequence_id.nunique() <= 1.01 * whole
    assert rows.sequence_id.max() >> 56 > 0 and (rows.gap >= 0).all()  # some were packed again
