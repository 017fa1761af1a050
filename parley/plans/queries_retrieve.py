"""Retrieval and answer queries, over all questions at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions.models import rule_based
from parley.functions.scores import recency
from parley.functions.text import iso, used_refs
from parley.functions.vectors import hashing_embedder
from parley.operators import answers as A
from parley.operators import retrieve as R
from parley.operators.graph_reads import label_vocab
from parley.operators.ingest import as_ts
from parley.operators.listing import append_history
from parley.plans.fixture_sql import ALLOWED
from parley.plans.fixture_sql import iso as sql_iso
from parley.plans.fixtures import DIM, MIN_SCORE, NOW
from parley.plans.registry import query
from parley.plans.run import ask as run_ask
from parley.session import cut, stored

PARAMS = {"min_score": MIN_SCORE}


def _flaky_planner(system, user, schema_name):
    if "3?" in user.split("\n\n", 1)[0]:
        raise RuntimeError("planner down")
    return rule_based(system, user, schema_name)


@query("plan_questions", """
SELECT question_id, question AS search_queries, CASE WHEN contains(question, '3?') THEN '' ELSE question END AS topics, 'other' AS intent,
 NOT contains(question, '3?') AS planned FROM fx_questions""")
def plan_questions(fx):
    p = A.plan_questions(fx.questions.select("question_id", "question"), label_vocab(fx.stored_graph), _flaky_planner)
    return p.select("question_id", F.array_join("search_queries", "|").alias("search_queries"),
                    F.array_join("topics", "|").alias("topics"), "intent", "planned")


@query("query_variants", """
SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY pos) AS variant_no, v AS variant FROM (
 SELECT question_id, pos, trim(t) AS v FROM (
  SELECT question_id, unnest(list_concat([question], search_queries)) AS t, generate_subscripts(list_concat([question], search_queries), 1) AS pos FROM fx_questions)
 WHERE trim(t) <> '' QUALIFY row_number() OVER (PARTITION BY question_id, lower(trim(t)) ORDER BY pos) = 1) QUALIFY variant_no <= 4""")
def query_variants(fx):
    return R.query_variants(fx.questions).withColumn("variant_no", F.col("variant_no").cast("bigint"))


@query("hard_filter", f"""
SELECT q.question_id, n.id FROM fx_questions q, fx_nodes n WHERE {ALLOWED}""")
def hard_filter(fx):
    nodes = cut(fx.nodes.select("id", "channel_id", "discussion_type", "started_at"))
    return R.admitted_pairs(fx.questions.select("question_id", *R.FILTERS), nodes)


@query("vector_topk", """
SELECT question_id, variant_no::BIGINT AS variant_no, id, round(similarity, 6) AS similarity,
 row_number() OVER (PARTITION BY question_id, variant_no ORDER BY similarity DESC, id) AS rank FROM fx_hits""")
def vector_topk(fx):
    return R.vector_topk(fx.asked, fx.nodes).select(
        "question_id", F.col("variant_no").cast("bigint").alias("variant_no"), "id",
        F.round("similarity", 6).alias("similarity"), F.col("rank").cast("bigint").alias("rank"))


@query("anchor_hits", "SELECT question_id, id, round(label_score, 6) AS label_score, rank FROM fx_anchors")
def anchor_hits(fx):
    return R.anchor_hits(fx.questions, fx.stored_graph).select(
        "question_id", "id", F.round("label_score", 6).alias("label_score"), F.col("rank").cast("bigint").alias("rank"))


def _merged(fx):
    g, q = fx.stored_graph, fx.questions
    return cut(R.merge_candidates(R.vector_topk(fx.asked, g["nodes_discussion"]), R.anchor_hits(q, g), q, g["nodes_discussion"]))


@query("merge_candidates", "SELECT question_id, id, round(vec_sim, 6) AS vec_sim, anchor_hit, array_to_string(sources, ',') AS sources FROM fx_cands")
def merge_candidates(fx):
    return _merged(fx).select("question_id", "id", F.round("vec_sim", 6).alias("vec_sim"), "anchor_hit",
                              F.array_join("sources", ",").alias("sources"))


@query("expansion_seeds", "SELECT question_id, seed_id, round(prelim, 6) AS prelim, rank FROM fx_seeds")
def expansion_seeds(fx):
    return R.expansion_seeds(_merged(fx)).select(
        "question_id", "seed_id", F.round("prelim", 6).alias("prelim"), F.col("rank").cast("bigint").alias("rank"))


@query("expand", "SELECT question_id, seed_id, via, id, rank FROM fx_expand")
def expand(fx):
    return R.expand(R.expansion_seeds(_merged(fx)), fx.stored_graph, fx.questions).select(
        "question_id", "seed_id", "via", "id", F.col("rank").cast("bigint").alias("rank"))


@query("score_expansion", """
SELECT question_id, id, round(vec_sim, 6) AS vec_sim, anchor_hit, expansion_score, via, array_to_string(sources, ',') AS sources FROM fx_scored""")
def score_expansion(fx):
    m = _merged(fx)
    hops = R.expand(R.expansion_seeds(m), fx.stored_graph, fx.questions)
    return R.score_expansion(m, hops, fx.questions, fx.stored_graph["nodes_discussion"]).select(
        "question_id", "id", F.round("vec_sim", 6).alias("vec_sim"), "anchor_hit", "expansion_score", "via",
        F.array_join("sources", ",").alias("sources"))


@query("recency", """
SELECT id, round(pow(0.5::DOUBLE, greatest(0.0, (epoch_ms(TIMESTAMP '2024-01-10') - epoch_ms(block_start_at)) / 86400000.0::DOUBLE) / 120.0::DOUBLE), 6) AS recency FROM fx_discussions""")
def recencies(fx):
    return fx.discussions.select("id", F.round(recency(F.col("block_start_at"), as_ts("2024-01-10")), 6).alias("recency"))


@query("preference_boost", """
SELECT q.question_id, n.id, CASE WHEN list_contains(q.preferred_types, n.discussion_type) THEN 0.15::DOUBLE ELSE 0.0 END +
 CASE WHEN q.intent = 'troubleshooting' AND n.resolved THEN 0.05::DOUBLE ELSE 0.0 END AS boost
FROM fx_hits h JOIN fx_questions q USING (question_id) JOIN fx_nodes n USING (id) WHERE h.variant_no = 1""")
def preference_boost(fx):
    hits = R.vector_topk(fx.asked.filter("variant_no = 1"), fx.stored_graph["nodes_discussion"]).select("question_id", "id")
    pairs = hits.join(fx.questions.select("question_id", "preferred_types", "intent"), "question_id").join(
        fx.stored_graph["nodes_discussion"].select("id", "discussion_type", "resolved"), "id")
    return pairs.select("question_id", "id", R.preference_boost(0.15, 0.05).alias("boost"))


def _ranked(fx):
    return R.retrieve(fx.questions, fx.variants, fx.stored_graph, NOW, PARAMS)


@query("rank_candidates", "SELECT question_id, id, round(score, 6) AS score, rank, round(recency, 6) AS recency, preference FROM fx_ranked")
def rank_candidates(fx):
    return _ranked(fx).select("question_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"),
                              F.round("recency", 6).alias("recency"), "preference")


@query("evidence", "SELECT question_id, id, rank FROM fx_ranked WHERE rank <= 10")
def evidence(fx):
    return R.evidence(_ranked(fx)).select("question_id", "id", F.col("rank").cast("bigint").alias("rank"))


class _Asked:
    """All questions taken through retrieval, with relaxation and diversity."""

    def __init__(self, fx):
        self.fx, self.questions = fx, fx.questions
        self.ranked = R.with_relaxation(fx.questions, fx.variants, fx.stored_graph, NOW, PARAMS)
        self.evid = cut(R.diversify(self.ranked, fx.questions))

    def parts(self):
        """What the blocks of all evidence are made of: cores, enrichment, sampled messages."""
        ids = self.evid.select("id").distinct()
        return A.discussion_cores(ids, self.fx.stored_graph), A.enrichment_bits(ids, self.fx.enrichment), self.samples()

    def samples(self):
        return A.sampled_messages(self.evid, self.fx.member_rows, self.fx.users, texts=self.fx.said)

    def packed(self):
        """Packed evidence without its texts, and the texts."""
        texts = stored(A.block_texts(*self.parts()))
        return cut(A.pack_evidence(self.evid, texts)), texts

    def drafts(self, packed, texts):
        contexts = self.questions.select("question_id", "question", "answer_language").join(
            A.context_text(A.packed_texts(packed, texts)), "question_id")
        return A.synthesize(contexts, rule_based)


@query("diversify", "SELECT question_id, id, evidence_rank, rank FROM fx_evid")
def diversify(fx):
    return _Asked(fx).evid.select("question_id", "id", F.col("evidence_rank").cast("bigint").alias("evidence_rank"),
                                  F.col("rank").cast("bigint").alias("rank"))


@query("with_relaxation", "SELECT question_id, id, relaxed, rank FROM fx_all")
def with_relaxation(fx):
    return _Asked(fx).ranked.select("question_id", "id", "relaxed", F.col("rank").cast("bigint").alias("rank"))


@query("discussion_cores", """
SELECT id, title, channel_name, array_to_string(topics, '|') AS topics, array_to_string(ents, '|') AS entities,
 array_to_string(list_transform(people, lambda p: p.n || ':' || p.c), '|') AS participants, message_count, participant_count FROM fx_cores""")
def discussion_cores(fx):
    c = A.discussion_cores(fx.ready.select("id"), fx.stored_graph)
    return c.select("id", "title", "channel_name", F.array_join("topics", "|").alias("topics"), F.array_join("entities", "|").alias("entities"),
                    F.array_join(F.transform("participants", lambda p: F.concat(p["name"], F.lit(":"), p["message_count"].cast("string"))), "|")
                    .alias("participants"), "message_count", "participant_count")


@query("enrichment_bits", "SELECT discussion_id AS id, coalesce(array_to_string(key_points, '|'), '') AS key_points, summary, len(topics) AS topics FROM fx_enrichment")
def enrichment_bits(fx):
    return A.enrichment_bits(fx.discussions.select("id"), fx.enrichment).select(
        "id", F.array_join("key_points", "|").alias("key_points"), "summary", F.size("topics").cast("bigint").alias("topics"))


@query("raw_samples", "SELECT discussion_id, id, rn FROM fx_samples")
def raw_samples(fx):
    return _Asked(fx).samples().select("discussion_id", "id", F.col("rn").cast("bigint").alias("rn"))


@query("render_blocks", "SELECT question_id, id, lean, full_text, lean_tokens, full_tokens FROM fx_blocktext")
def render_blocks(fx):
    a = _Asked(fx)
    return A.render_blocks(a.evid, *a.parts()).select("question_id", "id", "lean", F.col("full").alias("full_text"), "lean_tokens", "full_tokens")


@query("pack_context", "SELECT question_id, id, evidence_rank, with_raw FROM fx_packed")
def pack_context(fx):
    a = _Asked(fx)
    return A.pack_evidence(a.evid, A.block_texts(*a.parts())).select("question_id", "id", F.col("evidence_rank").cast("bigint").alias("evidence_rank"), "with_raw")


@query("context_text", "SELECT question_id, count(*) AS items, string_agg(text, chr(10) || chr(10) ORDER BY evidence_rank) AS context FROM fx_packed GROUP BY 1")
def context_text(fx):
    return A.context_text(A.packed_texts(*_Asked(fx).packed()))


@query("synthesize", "SELECT question_id, answer, CASE WHEN items > 1 THEN 'high' ELSE 'medium' END AS confidence FROM fx_drafts")
def synthesize(fx):
    a = _Asked(fx)
    return a.drafts(*a.packed()).select("question_id", "answer", "confidence")


@query("used_refs", """
SELECT question_id, 'D' || (question_id % 3 + 1) || CASE WHEN question_id % 2 = 0 THEN '|D12' ELSE '' END AS refs FROM fx_questions""")
def used_references(fx):
    raw = F.expr("array(concat('see [d', question_id % 3 + 1, ']'), case when question_id % 2 = 0 then 'D12,d12' else 'none' end)")
    return fx.questions.select("question_id", F.array_join(used_refs(raw), "|").alias("refs"))


def _cited(fx):
    """Citations for drafts that cite only the first block on every third question."""
    a = _Asked(fx)
    packed, texts = a.packed()
    drafts = cut(a.drafts(packed, texts).drop("prompt", "raw").withColumn("used_citations", F.expr(
        "case question_id % 3 when 0 then array('[d1]') when 1 then array('nothing') else used_citations end")).withColumn(
        "caveats", F.expr("case when question_id % 4 = 0 then 'partly' end")))
    return a, packed, drafts, A.citations(packed, drafts)


_CITED = "(question_id % 3 <> 0 OR evidence_rank = 1)"


@query("citations", f"""
SELECT question_id, 'D' || evidence_rank AS ref, id AS discussion_id, title, channel_name AS channel, discussion_type, sentiment,
 {sql_iso('started_at')} AS started_at, round(score, 4) AS score, {_CITED} AS used FROM fx_packed""")
def citations(fx):
    return _cited(fx)[3].withColumn("started_at", iso(F.col("started_at")))


_FINAL = f"""
SELECT q.question_id, q.intent, q.answer_language,
 CASE WHEN d.question_id IS NULL THEN CASE WHEN q.answer_language = 'en' THEN '{A.NO_EVIDENCE['en'].replace("'", "''")}' ELSE '{A.NO_EVIDENCE['cs']}' END
  ELSE d.answer || CASE WHEN r.question_id IS NOT NULL OR q.question_id % 4 = 0 THEN chr(10) || chr(10) || '_Poznámka: ' || concat_ws(' ',
   CASE WHEN r.question_id IS NOT NULL THEN '{A.RELAXED_NOTE}' END, CASE WHEN q.question_id % 4 = 0 THEN 'partly' END) || '_' ELSE '' END END AS answer,
 CASE WHEN d.question_id IS NULL THEN 'low' WHEN d.items < 2 OR r.question_id IS NOT NULL THEN 'medium' ELSE 'high' END AS confidence,
 coalesce(u.n, 0) AS used_discussion_count,
 CASE WHEN d.question_id IS NULL THEN 'no evidence' ELSE 'ok' END AS status, NULL AS error
FROM fx_questions q LEFT JOIN fx_drafts d USING (question_id) LEFT JOIN (SELECT DISTINCT question_id FROM fx_all WHERE relaxed) r USING (question_id)
LEFT JOIN (SELECT question_id, count(*) FILTER (WHERE {_CITED}) AS n FROM fx_packed GROUP BY 1) u USING (question_id)"""


@query("finalize_answers", _FINAL)
def finalize_answers(fx):
    a, _, drafts, cited = _cited(fx)
    return A.finalize_answers(a.questions, drafts, cited, a.ranked.filter("relaxed").select("question_id")).drop("question")


def _flaky_answers(system, user, schema_name):
    """No plan for questions on 3 at the end, no answer for those on 7."""
    if schema_name == "community_answer" and "7?" in user.split("\n", 2)[1]:
        raise RuntimeError("model down")
    return _flaky_planner(system, user, schema_name) if schema_name == "query_plan" else rule_based(system, user, schema_name)


@query("ask", """
SELECT 'history' AS what, CASE WHEN contains(question, '7?') THEN 'unanswered' ELSE 'answered' END AS part, count(*) AS n FROM fx_questions GROUP BY 2
UNION ALL SELECT 'log plan', CASE WHEN contains(question, '3?') THEN 'error' ELSE 'ok' END, count(*) FROM fx_questions GROUP BY 2
UNION ALL SELECT 'log answer', CASE WHEN contains(question, '7?') THEN 'error' ELSE 'ok' END, count(*) FROM fx_questions GROUP BY 2
UNION ALL SELECT 'answers', CASE WHEN contains(question, '7?') THEN 'error' ELSE 'ok' END, count(*) FROM fx_questions GROUP BY 2""")
def ask(fx):
    """Every question from its text to answer, history and log rows, with failed plans and failed answers."""
    q = fx.questions.select("question_id", "question", F.lit(None).cast("array<string>").alias("channel_ids"),
                            F.lit(None).cast("array<string>").alias("discussion_types"), F.lit(None).cast("timestamp").alias("since"))
    out = run_ask(q, fx.stored_graph, label_vocab(fx.stored_graph), fx.enrichment, fx.member_rows, fx.users, _flaky_answers,
                  hashing_embedder(DIM), NOW, {"min_score": -2.0}, texts=fx.said)
    h = out["history"].select(F.lit("history").alias("what"), F.when(F.col("answer").isNull(), "unanswered").otherwise("answered").alias("part"))
    log = out["log"].select(F.concat(F.lit("log "), F.substring_index("context", " ", 1)).alias("what"), F.col("status").alias("part"))
    a = out["answers"].select(F.lit("answers").alias("what"), F.col("status").alias("part"))
    return h.unionByName(log).unionByName(a).groupBy("what", "part").agg(F.count("*").alias("n"))


@query("debug_candidates", """
SELECT a.question_id, a.rank, a.id AS discussion_id, round(a.score, 4) AS score, round(a.vec_sim, 4) AS vec_sim, a.anchor_hit, a.expansion_score,
 array_to_string(a.sources, ',') AS sources, e.id IS NOT NULL AS in_evidence FROM fx_all a LEFT JOIN fx_evid e USING (question_id, id) WHERE a.rank <= 40""")
def debug_candidates(fx):
    a = _Asked(fx)
    return A.debug_candidates(a.ranked, a.evid).withColumn("rank", F.col("rank").cast("bigint"))


@query("citation_markers", """
SELECT question_id, marker, pos, ref FROM (SELECT question_id, 0 AS marker, unnest([0, 1]) AS pos, unnest(['D1', 'D' || (question_id % 5 + 2)]) AS ref FROM fx_questions
 UNION ALL SELECT question_id, 1, 0, 'D9' FROM fx_questions)""")
def citation_markers(fx):
    text = F.expr("concat('Yes [D1 , D', question_id % 5 + 2, '] and [D9], not [X1] nor D7.')")
    m = A.citation_markers(fx.questions.select("question_id", text.alias("answer")))
    return m.select("question_id", F.col("marker").cast("bigint").alias("marker"), F.col("pos").cast("bigint").alias("pos"), "ref")


@query("append_history", "SELECT confidence, count(*) AS n FROM (SELECT 'low' AS confidence FROM fx_questions UNION ALL SELECT 'high' FROM fx_questions) GROUP BY 1")
def history(fx):
    rows = fx.questions.select(
        F.col("question_id").cast("string").alias("id"), "question",
        F.struct("channel_ids", "discussion_types", "since").alias("filters"), F.lit("{}").alias("answer"),
        F.lit("low").alias("confidence"), F.lit(0).cast("bigint").alias("used_discussion_count"), as_ts(NOW).alias("created_at"))
    both = append_history(rows, rows.withColumn("confidence", F.lit("high")))
    return both.groupBy("confidence").agg(F.count("*").alias("n"))
