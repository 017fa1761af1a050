"""Learned operators, fingerprints, pages and chats."""

import hashlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from parley.llm import lang_unigram, main_text, minhash, pu_quality
from parley.llm.chat_format import escape, format_chats, loss_text, read_turns, unescape
from parley.llm.dom import features, parse, texts_of
from parley.llm.jaccard_join import shingles
from parley.llm.queries import ORACLES, QUERIES
from tests.compare import compare, connect

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(spark, connect(SF), SF, name, QUERIES[name], ORACLES[name]) == ""


def test_quality_on_held_out_labels(spark):
    rows = QUERIES["op1_quality_pu"](spark, SF).toPandas()
    marks = duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").df()
    both = rows[rows.held_out].merge(marks, on="doc_id")
    good, bad = both[both.quality == 1].score.to_numpy(), both[both.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.97
    assert (both.predicted == both.quality).mean() > 0.93 and rows.score.between(0, 1).all() and len(rows) == 1000


def test_negative_risk_never_pays():
    r = np.random.default_rng(1)
    pos, neg = r.normal(2, 1, (60, 5)), r.normal(-2, 1, (300, 5))
    model = pu_quality.fit_pu(pos, np.concatenate([neg, r.normal(2, 1, (300, 5))]), 0.5, steps=800)
    assert model.score(r.normal(2, 1, (200, 5))).mean() > 0.8 > 0.3 > model.score(r.normal(-2, 1, (200, 5))).mean()
    none = pu_quality.fit_pu(pos[:0], neg, 0.4)
    assert np.allclose(none.score(neg), 0.4)


def test_language_on_held_out_rows(spark):
    rows = QUERIES["op2_language_id"](spark, SF).toPandas()
    lang = duckdb.sql(f"SELECT doc_id, lang FROM '{SF}/documents.parquet'").df()
    both = rows[rows.held_out].merge(lang, on="doc_id")
    assert (both.lang_pred == both.lang).mean() > 0.97 and rows.score.between(0, 1).all() and len(rows) == 1000


def test_language_sums_all_segmentations():
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = lang_unigram.fit_pieces({"aa": {"▁thing": 3, "▁in": 2}, "bb": {"▁ding": 2, "▁wörter": 1}}, path, rounds=3)
    vocab = lang_unigram.vocabulary(path)

    def brute(w, k):
        return 1.0 if not w else sum(
            model.prob[vocab.get(w[:j], 0), k] * brute(w[j:], k) for j in range(1, len(w) + 1) if j == 1 or w[:j] in vocab)

    scorer = lang_unigram.Scorer(model)
    for word in ("▁thing", "▁ding", "▁öäq", "▁漢a"):
        scorer.learn([word])
        want = [brute(word, k) for k in range(2)]
        assert np.allclose(np.exp(scorer.table[scorer.row[word]]), want)
        assert np.allclose(np.exp(lang_unigram.long_word(word, vocab, scorer.longest, model.prob)), want)
    assert [x[0] for x in scorer.predict(["", "12 !", "thing in thing", "Wörter"])] == ["und", "und", "aa", "bb"]


def test_likeness_is_near_the_true_one():
    r = np.random.default_rng(2)
    for n, m in ((2000, 1500), (400, 300), (60, 50)):
        words = [str(x) for x in r.integers(0, 10 ** 9, n)]
        a, b = " ".join(words), " ".join(words[:m] + [str(x) for x in r.integers(0, 10 ** 9, n - m)])
        sa, sb = shingles(a, 5), shingles(b, 5)
        true = len(np.intersect1d(sa, sb)) / len(np.union1d(sa, sb))
        got = minhash.likeness(minhash.signature(sa), minhash.unpack(minhash.pack(minhash.signature(sb))))
        assert abs(got - true) < 0.13
    assert minhash.fingerprint("") == "" and minhash.fingerprint("one two") != minhash.fingerprint("one three")
    assert minhash.likeness(*[minhash.unpack(minhash.fingerprint("one two"))] * 2) == 1.0


def test_neighbours_equal_brute_force(spark):
    rows = [(k * k % 977, " ".join(f"w{(k * j) % 89}" for j in range(k % 40))) for k in range(1, 120)] + [(5000, None)]
    rows = list(dict(rows).items())
    got = {r.doc_id: r for r in minhash.edited_neighbours(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    order = sorted(rows, reverse=True)
    assert len(got) == len(rows)
    for (doc, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        text, after = text or "", after or ""
        k = len(text) // 3
        edited = text[: len(text) - k] + after[:k]
        r = got[doc]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (minhash.fingerprint(text), minhash.fingerprint(edited))
        assert r.near_next == minhash.likeness(minhash.unpack(r.fingerprint), minhash.unpack(minhash.fingerprint(after)))


def test_pages_are_read_like_browsers_do():
    page = parse("<p>a<p>b <b>c<br>d</p><ul><li>e<li>f</ul><!-- x --><script>var a='<p>no</p>'</script>g &amp; h<td>i</div>")
    assert texts_of(page, np.ones(len(page.tag), bool)) == "a\nb c d\ne\nf\ng & h\ni"
    assert features(parse("")).shape[0] == 1
    deep = parse("<b>" * 3000 + "x" + '<a href="' * 50)
    assert texts_of(deep, np.ones(len(deep.tag), bool)).startswith("x")


def test_main_text_of_a_page():
    source = """<html><head><title>T</title><style>p{}</style></head><body><header><a href="/">Site</a></header>
    <div class="cookie-notice"><p>We use cookies on this site.</p></div><nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav>
    <div class="ad">Buy now and save a lot.</div><article><h1>The title</h1><p>First paragraph of the text, with a comma. And more of it.</p>
    <div class="advert">Another thing to buy.</div><p>Er.</p><p>Last &amp; long paragraph that says a little more than the others did.</p></article>
    <aside class="sidebar"><h3>Related</h3><ul><li><a href="/x">Other page</a></li></ul></aside>
    <section id="comments"><h3>Comments</h3><div class="comment"><p>I liked this page very much, thanks for it.</p></div></section>
    <form action="/s"><input name="q"><button>Search</button></form><footer>&copy; Site, all rights reserved.</footer></body></html>"""
    assert main_text.extract([source], main_text.train(300)) == [
        "The title\nFirst paragraph of the text, with a comma. And more of it.\nEr.\nLast & long paragraph that says a little more than the others did."]


def test_decoding_has_no_contradictions():
    layouts = main_text.Layouts(17)
    model = main_text.train(120)
    for _ in range(20):
        page = parse(layouts.page())
        kept = main_text.decode(page, model.logit(features(page)))
        assert all(kept[page.parent[i]] for i in np.flatnonzero(kept)[1:])


def test_chats_read_back(spark):
    rows = [(1, 0, "user", "hi <|im_end|>"), (1, 1, "user", r"<\| <| <\\|"), (1, 2, "assistant", "<|im_start|>user\nx"), (1, 3, "assistant", ""),
            (2, None, "a\nb<|", None), (2, 1, None, "x"), (2, 1, None, "x"), (None, 0, "assistant", "é🎉")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1))
    out = format_chats(turns).select("conv_id", "formatted", read_turns(F.col("formatted")).alias("t"), loss_text(F.col("segments")).alias("loss"),
                                     F.array_join(F.col("segments.text"), "").alias("joined"))
    got = {r.conv_id: r for r in out.collect()}
    assert [(t.role, t.text) for t in got[1].t] == [r[2:] for r in rows[:4]]
    assert [(t.role, t.text) for t in got[2].t] == [("a\nb<|", ""), ("", "x"), ("", "x")]
    assert got[1].loss == "<|im_start|>user\nx" and got[None].loss == "é🎉"
    assert got[1].formatted.count("<|im_start|>") == 2 and all(r.joined == r.formatted for r in got.values())
    assert format_chats(turns.where("false")).count() == 0


def test_escape_is_reversible(spark):
    texts = [r"<\|", "<|", r"<\\|", "<<|", r"\<", "<", r"<\n", "|<\\", "<||<\\\\"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escape(F.col("t")).alias("e"), unescape(escape(F.col("t"))).alias("u"))
    assert all(r.t == r.u and "<|" not in r.e for r in df.collect())
