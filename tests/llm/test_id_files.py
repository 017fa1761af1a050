"""Token-id files: ids of the library, whole round trips, access to single documents, edge rows."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from parley.llm.id_files import IdEncoder, Layout, fetch_ids, read_ids, train_dictionary, write_ids
from parley.llm.queries import QUERIES
from tests.llm.test_tokens import texts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def numbers(data):
    return np.frombuffer(data, "<u4").tolist()


def test_encoder_is_the_library(library):
    own = IdEncoder(PATH)
    r = random.Random(3)
    wide = ["".join(r.choice("ab \n\t\xa0'sé1.") for _ in range(r.randrange(40))) for _ in range(600)]
    many = [*texts(), *wide, " a", "a ", "a  b", "a \n b", "x" * 5000 + " y", "<|endoftext|> a", "a ªb ºc µ ß x's 't"]
    for t, ids in zip(many, own.encode(many), strict=True):
        assert numbers(ids) == library.encode(t, add_special_tokens=False).ids, t


def test_encoder_forgets_and_goes_on(library, monkeypatch):
    monkeypatch.setattr("parley.llm.id_files.REMEMBERED", 5)
    own = IdEncoder(PATH)
    for t in ["one two three four five six seven", "six seven eight nine ten, eleven " + "y" * 99 + " " + "y" * 99 + "!", "two  three four five six"] * 2:
        assert numbers(own.encode([t])[0]) == library.encode(t, add_special_tokens=False).ids
        assert not any(len(w) > 64 for w in [*own.new, *own.old])


def test_lines_do_not_join_words(library):
    """The last word of a line and the first of the next are looked up apart; other white space is left as it is."""
    own = IdEncoder(PATH)
    lines = ["a " + " ".join(f"w{i}.\nWas{j}, é{j}!\nÉ" for j in range(20)) for i in range(20)]
    odd = ["a b\n\nc d\ne", "a b\nc\n", "a b\nc\td", "a b.\n\n", "a\nb c\nd", "a b\n's c\n..d", "x y\xa0z\nW", "a 漢\nb"]
    for t, ids in zip([*lines, *odd], own.encode([*lines, *odd]), strict=True):
        assert numbers(ids) == library.encode(t, add_special_tokens=False).ids, t
    own = IdEncoder(PATH)
    own.encode(lines)
    assert "\nWas3" in own.new or "\nWas3," in own.new
    assert not any("\n" in w[1:] for w in own.new)


def test_query_is_the_library(spark, library):
    got = QUERIES["op11_id_files"](spark, "/root/testdata/sf0.001").orderBy("doc_id").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    start = 0
    for d, g in zip(docs, got, strict=True):
        ids = np.array([*library.encode(d.text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (d.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


@pytest.mark.parametrize("layout", [Layout(), Layout(width=2, file_docs=3), Layout(width=2, file_bytes=100)])
def test_round_trip_of_edge_rows(spark, tmp_path, library, layout):
    """Null ids first, repeated ids and rows kept, empty and long texts, clashing columns, several files."""
    rows = [(None, "no id", 1), (3, None, 2), (3, "same", 3), (3, "same", 4), (1, "", 5), (2, "long text " * 20_000, 6), (9, "İ 漢 🎉", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start long").withColumn("_hash", F.lit(0)).withColumn("_id", F.lit("x"))
    folder = str(tmp_path / "ids")
    manifest = write_ids(docs, folder, PATH, 2, layout)
    assert manifest.agg(F.sum("n_docs")).first()[0] == len(rows)
    got = read_ids(spark, folder).orderBy("start").collect()
    assert [g.doc_id for g in got] == [None, 1, 2, 3, 3, 3, 9]
    want = sorted(((d is not None, d or 0), [*library.encode(t or "", add_special_tokens=False).ids, 2]) for d, t, _ in rows)
    assert sorted(((g.doc_id is not None, g.doc_id or 0), numbers(g.ids)) for g in got) == want
    assert [g.start for g in got] == np.concatenate([[0], np.cumsum([g.n_tokens for g in got])[:-1]]).tolist()
    some = fetch_ids(spark, folder, [3, 9, 77]).collect()
    assert sorted(map(tuple, some)) == sorted(tuple(g) for g in got if g.doc_id in (3, 9))


def test_text_ids_and_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([("b", "two"), ("a", "one")], "doc_id string, text string")
    write_ids(docs, str(tmp_path / "t"), PATH)
    assert [r.doc_id for r in read_ids(spark, str(tmp_path / "t")).orderBy("start").collect()] == ["a", "b"]
    write_ids(docs.limit(0), str(tmp_path / "e"), PATH)
    assert read_ids(spark, str(tmp_path / "e")).count() == 0
    assert train_dictionary(docs.limit(0), PATH) == b""


def test_dictionary_is_shared_and_guarded(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    dictionary = train_dictionary(docs, PATH, sample_docs=100)
    assert dictionary
    small = write_ids(docs, str(tmp_path / "d"), PATH, 2, Layout(dictionary, 2)).agg(F.sum("n_bytes")).first()[0]
    plain = write_ids(docs, str(tmp_path / "p"), PATH, 2, Layout(b"", 2)).agg(F.sum("n_bytes")).first()[0]
    assert small < plain
    (named,) = (tmp_path / "d").glob("*.dictionary")
    named.write_bytes(dictionary[:-1] + b"?")
    with pytest.raises(Exception, match="dictionary has changed"):
        read_ids(spark, str(tmp_path / "d")).collect()
