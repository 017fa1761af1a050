"""The fixture views of ``fixtures`` as DuckDB common table expressions."""

from __future__ import annotations

#: Unicode whitespace for RE2
WS = r"[\t-\r \x{85}\p{Z}]+"
EDGES = rf"^{WS}|{WS}$"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '{EDGES}', '', 'g')"


def one_line(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}', ' ', 'g'))"


def words(x: str) -> str:
    t = trim(f"coalesce({x}, '')")
    return f"CASE WHEN {t} = '' THEN 0 ELSE len(regexp_split_to_array({t}, '{WS}')) END"


def iso(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%dT%H:%M:%S.%gZ')"


def line(id_: str, author: str, at: str, content: str) -> str:
    body = trim(rf"regexp_replace({content}, '\r?\n', ' ', 'g')")
    return f"'[id=' || {id_} || '] ' || {author} || ' @ ' || {iso(at)} || chr(10) || {body}"


_ND = "(SELECT count(*) FROM documents)"
_NE = "(SELECT count(*) FROM embeddings)"
_NC = "(SELECT count(DISTINCT conv_id) FROM conversations)"
_SAID = "(e.event_id // 4 * 2 + e.event_id % 4 - 2)"
_TALK = "((vec_id // 10) * 7 + vec_id % 10 - 3)"
_TALKS = f"(SELECT least({_ND}, count(*)) FROM embeddings WHERE vec_id % 10 >= 3)"
GAP_MS = "(SELECT least(30, greatest(1, 300000 // count(*))) * 60000 FROM events)"
_CHANNELS = "['click', 'error', 'purchase', 'signup', 'view']"
_TYPES = "['question', 'help-request', 'discussion', 'announcement', 'off-topic', 'banter', 'other']"
_INTENTS = "['opinion', 'troubleshooting', 'factual', 'summary', 'person-activity', 'timeline', 'other']"
_SENTIMENTS = "['positive', 'neutral', 'negative', 'mixed']"

_MSG = f"""
 CAST(e.event_id AS VARCHAR) AS id, e.event_type AS channel_id, 'g0' AS guild_id,
 CAST(e.user_id AS VARCHAR) AS author_id, date_trunc('millisecond', e.ts) AS created_at,
 CASE WHEN e.event_id % 3 = 1 AND e.event_id >= 5 * (1 + e.event_id % 12)
   THEN CAST(e.event_id - 5 * (1 + e.event_id % 12) AS VARCHAR) END AS reply_to_message_id,
 CASE WHEN e.event_id % 17 = 0 THEN 't-' || e.event_type || '-' || (e.user_id % 7) END AS thread_id,
 CASE WHEN e.event_id % 5 = 0 THEN [CAST(e.user_id + 1 AS VARCHAR)] END AS mentions,
 CASE e.event_id % 20 WHEN 7 THEN 1 WHEN 13 THEN 3 ELSE 0 END AS processed,
 CASE WHEN e.event_id % 20 IN (7, 13) THEN 'd' || (e.event_id % {_NE}) END AS discussion_id,
 date_trunc('millisecond', e.ts) + INTERVAL 1 SECOND AS ingested_at"""

CTES: dict[str, str] = {
    "fx_slim": f"SELECT {_MSG} FROM events e",
    "fx_turns": "SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1",
    "fx_text": f"""
SELECT e.event_id, coalesce(d.text, c.text, e.props) AS content FROM events e
LEFT JOIN documents d ON e.event_id % 4 = 1 AND d.doc_id = (e.event_id // 4) % {_ND}
LEFT JOIN fx_turns t ON e.event_id % 4 > 1 AND t.conv_id = {_SAID} % {_NC}
LEFT JOIN conversations c ON c.conv_id = t.conv_id AND c.turn = ({_SAID} // {_NC}) % t.n""",
    "fx_talks": f"""
SELECT doc_id % {_TALKS} AS talk, arg_min(lang, doc_id) AS lang, arg_min(source, doc_id) AS source, string_agg(text, ' ' ORDER BY doc_id) AS text
FROM documents GROUP BY 1""",
    "fx_messages": f"SELECT {_MSG}, x.content, {words('x.content')} AS word_count FROM events e JOIN fx_text x USING (event_id)",
    "fx_vectors": f"SELECT CAST(event_id AS VARCHAR) AS id, b.embedding::DOUBLE[] AS vec FROM events JOIN embeddings b ON b.vec_id = event_id % {_NE}",
    "fx_users": """
SELECT CAST(user_id AS VARCHAR) AS id, CASE WHEN user_id % 4 <> 0 THEN 'user' || user_id END AS username,
 CASE WHEN user_id % 3 <> 0 THEN 'User ' || user_id END AS display_name,
 min(date_trunc('millisecond', ts)) AS first_seen_at, max(date_trunc('millisecond', ts)) AS last_seen_at,
 count(*) AS message_count FROM events GROUP BY user_id""",
    "fx_channels": """
SELECT DISTINCT event_type AS id, 'g0' AS guild_id, CASE WHEN event_type <> 'error' THEN 'ch-' || event_type END AS name,
 'text' AS type FROM events""",
    "fx_discussions": f"""
SELECT vec_id, 'd' || vec_id AS id, {_CHANNELS}[label % 5 + 1] AS channel_id,
 TIMESTAMP '2024-01-01' + to_hours(vec_id) AS block_start_at,
 TIMESTAMP '2024-01-01' + to_hours(vec_id) + INTERVAL 30 MINUTE AS block_end_at,
 CASE WHEN vec_id % 10 = 0 THEN 'split' WHEN vec_id % 10 = 1 THEN 'clustering' WHEN vec_id % 10 = 2 THEN 'needs_reenrichment'
  WHEN vec_id % 10 <= 6 THEN 'enriched' ELSE 'written' END AS status,
 vec_id % 41 AS message_count,
 CASE WHEN vec_id % 6 = 5 AND vec_id >= 7 THEN 'd' || (vec_id - 7) END AS continuation_of_discussion_id,
 CASE WHEN vec_id % 10 IN (3, 4) THEN 'd' || (vec_id - vec_id % 10) END AS parent_discussion_id
FROM embeddings""",
    "fx_enrichment": f"""
SELECT e.vec_id, 'd' || vec_id AS discussion_id, 'Talk ' || vec_id || ' ' || d.source AS title, d.text AS summary,
 ['topic ' || label, ' Topic  ' || label || ' ', 'lang ' || lang, ''] AS topics,
 [{{'name': source, 'type': 'product'}}, {{'name': upper(source), 'type': ' Product '}}, {{'name': lang, 'type': ''}}] AS entities,
 CASE WHEN vec_id % 8 <> 0 THEN ['kp ' || (vec_id % 3)] END AS key_points,
 {_SENTIMENTS}[vec_id % 4 + 1] AS sentiment, ((vec_id % 21)::DOUBLE - 10) / 10 AS sentiment_score, lang AS language,
 {_TYPES}[vec_id % 7 + 1] AS discussion_type, CASE vec_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS resolved,
 e.embedding::DOUBLE[] AS embedding
FROM embeddings e JOIN fx_talks d ON d.talk = {_TALK} % {_TALKS} WHERE vec_id % 10 >= 3""",
    "fx_members": f"""
SELECT 'd' || (event_id % {_NE}) AS discussion_id, CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS author_id,
 date_trunc('millisecond', ts) AS created_at FROM events WHERE (event_id % {_NE}) % 10 >= 3""",
    # graph
    "fx_topics": f"""
SELECT discussion_id, min(pos) AS pos, arg_min(topic, pos) AS topic FROM (
 SELECT discussion_id, pos, {one_line('raw')} AS topic FROM (
  SELECT discussion_id, unnest(topics) AS raw, generate_subscripts(topics, 1) - 1 AS pos FROM fx_enrichment))
WHERE topic <> '' GROUP BY discussion_id, lower(topic)""",
    "fx_entities": f"""
SELECT discussion_id, type || ':' || lower(name) AS key, min(pos) AS pos, arg_min(name, pos) AS name, min(type) AS type FROM (
 SELECT discussion_id, pos, {one_line('raw.name')} AS name,
  CASE WHEN {one_line('raw.type')} = '' THEN 'other' ELSE lower({one_line('raw.type')}) END AS type FROM (
  SELECT discussion_id, unnest(entities) AS raw, generate_subscripts(entities, 1) - 1 AS pos FROM fx_enrichment))
WHERE name <> '' GROUP BY 1, 2""",
    "fx_parts": """
SELECT m.discussion_id, m.author_id, any_value(u.username) AS username, any_value(u.display_name) AS display_name,
 any_value(u.first_seen_at) AS first_seen_at, any_value(u.last_seen_at) AS last_seen_at,
 any_value(u.message_count) AS user_message_count, count(*) AS message_count,
 min(m.created_at) AS first_message_at, max(m.created_at) AS last_message_at
FROM fx_members m LEFT JOIN fx_users u ON u.id = m.author_id GROUP BY 1, 2""",
    "fx_times": "SELECT id AS discussion_id, block_start_at AS started_at, block_end_at AS ended_at FROM fx_discussions JOIN fx_enrichment e ON e.discussion_id = id",
    "fx_nodes": """
SELECT d.id, d.channel_id, d.block_start_at AS started_at, d.block_end_at AS ended_at,
 coalesce(p.mc, 0)::BIGINT AS message_count, coalesce(p.pc, 0)::BIGINT AS participant_count, e.title, e.summary,
 t.topics, e.sentiment, e.sentiment_score, e.language, e.discussion_type, e.resolved, e.embedding
FROM fx_discussions d JOIN fx_enrichment e ON e.discussion_id = d.id
LEFT JOIN (SELECT discussion_id, sum(message_count) AS mc, count(*) AS pc FROM fx_parts GROUP BY 1) p ON p.discussion_id = d.id
LEFT JOIN (SELECT discussion_id, list(topic ORDER BY pos) AS topics FROM fx_topics GROUP BY 1) t ON t.discussion_id = d.id""",
    "fx_tpairs": """
SELECT a.discussion_id, a.topic AS a, b.topic AS b FROM fx_topics a JOIN fx_topics b ON a.discussion_id = b.discussion_id AND a.topic < b.topic""",
    "fx_epairs": """
SELECT a.discussion_id, a.key AS a, b.key AS b FROM fx_entities a JOIN fx_entities b ON a.discussion_id = b.discussion_id AND a.key < b.key""",
    "fx_cont": """
SELECT d.id AS src, d.continuation_of_discussion_id AS dst, (k.id IS NULL) AS stub
FROM fx_nodes n JOIN fx_discussions d ON d.id = n.id LEFT JOIN fx_nodes k ON k.id = d.continuation_of_discussion_id
WHERE d.continuation_of_discussion_id IS NOT NULL""",
    "fx_lvecs": """
SELECT kind, label, uses, list_transform(string_split('abcdefghijklmnopqrstuvwxyz0123456789', ''),
  lambda c: (length(lower(label)) - length(replace(lower(label), c, '')))::DOUBLE) AS vec FROM (
 SELECT 'topic' AS kind, topic AS label, count(*) AS uses FROM fx_topics GROUP BY topic
 UNION ALL SELECT 'entity:' || type, key, count(*) FROM fx_entities GROUP BY type, key)""",
    "fx_llinks": "SELECT a.kind, a.label AS a, b.label AS b FROM fx_lvecs a JOIN fx_lvecs b ON a.kind = b.kind AND a.label <> b.label AND list_cosine_similarity(a.vec, b.vec) >= 0.8",
    "fx_lreach": """
SELECT kind, label AS a, label AS b FROM fx_lvecs UNION SELECT r.kind, r.a, l.b FROM fx_lreach r JOIN fx_llinks l ON l.kind = r.kind AND l.a = r.b""",
    "fx_canon": """
SELECT kind, label, first_value(label) OVER (PARTITION BY kind, root ORDER BY uses DESC, label) AS canonical, count(*) OVER (PARTITION BY kind, root) AS members
FROM fx_lvecs JOIN (SELECT kind, a AS label, min(b) AS root FROM fx_lreach GROUP BY 1, 2) USING (kind, label)""",
    "fx_ctopics": """
SELECT t.discussion_id, c.canonical AS topic, min(t.pos) AS pos FROM fx_topics t JOIN fx_canon c ON c.kind = 'topic' AND c.label = t.topic GROUP BY 1, 2""",
    "fx_centities": """
SELECT e.discussion_id, c.canonical AS key, count(*) AS merged FROM fx_entities e JOIN fx_canon c ON c.kind = 'entity:' || e.type AND c.label = e.key GROUP BY 1, 2""",
    "fx_tnodes": "SELECT topic AS name, count(DISTINCT discussion_id) AS discussion_count, min(started_at) AS created_at FROM fx_topics JOIN fx_times USING (discussion_id) GROUP BY 1",
    "fx_enodes": """
SELECT key, arg_min(name, (started_at, discussion_id)) AS name, arg_min(type, (started_at, discussion_id)) AS type,
 count(*) AS mention_count, min(started_at) AS created_at FROM fx_entities JOIN fx_times USING (discussion_id) GROUP BY 1""",
    "fx_edges": """
SELECT 'OCCURRED_IN' AS type, 'Discussion:' || id AS src, 'Channel:' || channel_id AS dst FROM fx_nodes
UNION ALL SELECT 'IN_GUILD', 'Channel:' || id, 'Guild:' || guild_id FROM fx_channels WHERE id IN (SELECT channel_id FROM fx_nodes)
UNION ALL SELECT 'PARTICIPATED_IN', 'User:' || author_id, 'Discussion:' || discussion_id FROM fx_parts
UNION ALL SELECT 'DISCUSSES', 'Discussion:' || discussion_id, 'Topic:' || topic FROM fx_topics
UNION ALL SELECT 'MENTIONS', 'Discussion:' || discussion_id, 'Entity:' || key FROM fx_entities
UNION ALL SELECT DISTINCT 'COOCCURS_WITH', 'Topic:' || a, 'Topic:' || b FROM fx_tpairs
UNION ALL SELECT DISTINCT 'COOCCURS_WITH', 'Entity:' || a, 'Entity:' || b FROM fx_epairs
UNION ALL SELECT DISTINCT 'INTERESTED_IN', 'User:' || author_id, 'Topic:' || topic FROM fx_parts JOIN fx_topics USING (discussion_id)
UNION ALL SELECT 'CONTINUATION_OF', 'Discussion:' || src, 'Discussion:' || dst FROM fx_cont""",
    "fx_hops": """
SELECT src AS node, dst AS other, type, src, dst FROM fx_edges
UNION ALL SELECT dst, src, type, src, dst FROM fx_edges WHERE src <> dst""",
    "fx_allnodes": """
SELECT 'Discussion:' || id AS node, 'Discussion' AS label, id AS domain_id,
 coalesce(nullif(title, ''), nullif(summary, ''), '(diskuze bez názvu)') AS caption FROM fx_nodes
UNION ALL SELECT DISTINCT 'Discussion:' || dst, 'Discussion', dst, '(diskuze bez názvu)' FROM fx_cont WHERE stub
UNION ALL SELECT 'Topic:' || name, 'Topic', name, name FROM fx_tnodes
UNION ALL SELECT 'Entity:' || key, 'Entity', key, name FROM fx_enodes
UNION ALL SELECT DISTINCT 'User:' || author_id, 'User', author_id, coalesce(display_name, username, '(uživatel)') FROM fx_parts
UNION ALL SELECT 'Channel:' || id, 'Channel', id, coalesce(name, '(kanál)') FROM fx_channels WHERE id IN (SELECT channel_id FROM fx_nodes)
UNION ALL SELECT DISTINCT 'Guild:' || guild_id, 'Guild', guild_id, 'Guild 0' FROM fx_channels""",
    # questions
    "fx_questions": f"""
SELECT vec_id AS question_id, 'What about topic ' || label || ' in case ' || vec_id || '?' AS question,
 [' what about TOPIC ' || label || ' in case ' || vec_id || '? ', 'topic ' || label, 'Topic ' || label, '', d.source, 'latest news', 'more'] AS search_queries,
 e.embedding::DOUBLE[] AS vec, ['topic ' || label] AS topics, [d.source] AS entities,
 {_INTENTS}[vec_id % 7 + 1] AS intent, [{_TYPES}[vec_id % 7 + 1]] AS preferred_types,
 CASE WHEN vec_id % 4 = 1 THEN [{_CHANNELS}[label % 5 + 1]] END AS channel_ids,
 CASE WHEN vec_id % 4 = 2 THEN ['announcement'] END AS discussion_types,
 CASE WHEN vec_id % 10 = 3 THEN TIMESTAMP '2030-01-01' END AS since,
 CASE WHEN vec_id % 2 = 0 THEN 'cs' ELSE 'en' END AS answer_language
FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id % {_ND}""",
    "fx_variants": f"""
SELECT vec_id AS question_id, 1 AS variant_no, embedding::DOUBLE[] AS vec FROM embeddings
UNION ALL SELECT (vec_id + {_NE} - 20) % {_NE}, 2, embedding::DOUBLE[] FROM embeddings""",
    # logs and threads
    "fx_calls": f"""
SELECT CAST(event_id AS VARCHAR) AS id, 'p' || (event_id % 2) AS provider, event_type AS model, props AS context,
 event_type AS channel_id, 'j' || (event_id % 50) AS job_id, date_trunc('millisecond', ts) AS started_at,
 floor(value * 100)::BIGINT AS duration_ms, CASE WHEN event_id % 13 = 0 THEN 'error' ELSE 'ok' END AS status,
 CASE WHEN event_id % 10 <> 0 THEN event_id % 1000 END AS prompt_tokens, 'system' AS system_prompt,
 d.text AS user_prompt, props AS response
FROM events LEFT JOIN documents d ON d.doc_id = event_id % {_ND}""",
    "fx_threads": """
SELECT conv_id, 'v' || conv_id AS discussion_id, 'v' || conv_id || '-' || turn AS id, role AS author_label,
 TIMESTAMP '2024-01-01' + to_hours(conv_id) + to_minutes(turn) AS created_at, text AS content, turn,
 'c' || (conv_id % 5) AS channel_id FROM conversations""",
    "fx_lines": f"""
SELECT *, {line('id', 'author_label', 'created_at', 'content')} AS line,
 row_number() OVER (PARTITION BY discussion_id ORDER BY created_at, id) AS rn FROM fx_threads""",
    "fx_sized": """
SELECT discussion_id AS id, any_value(conv_id) AS conv_id, any_value(channel_id) AS channel_id,
 TIMESTAMP '2024-01-01' + to_hours(any_value(conv_id)) AS block_start_at,
 40 + ceil(sum(length(line) + 2) / 3.5)::BIGINT AS tokens, count(*) AS messages FROM fx_lines GROUP BY 1""",
    "fx_segments": """
SELECT 'k' || (conv_id // 10) AS call_id, conv_id * 2 + seg AS seg_no, conv_id,
 list(CASE WHEN turn % 5 <> 0 AND NOT (seg = 1 AND conv_id % 3 = 0) THEN 'v' || conv_id || '-' || turn END) AS message_ids,
 CASE WHEN (conv_id // 10) % 7 <> 0 THEN 'c' || (conv_id % 10 + 1) END AS source_cluster
FROM (SELECT *, turn % 2 AS seg FROM conversations) WHERE conv_id % 11 <> 5 GROUP BY conv_id, seg""",
    "fx_labels": "SELECT DISTINCT 'k' || (conv_id // 10) AS call_id, 'c' || (conv_id % 10 + 1) AS label, 'v' || conv_id AS discussion_id FROM conversations",
    "fx_mapped": """
SELECT call_id, seg_no, discussion_id, message_id FROM (
 SELECT s.call_id, s.seg_no, t.discussion_id, t.id AS message_id
 FROM (SELECT call_id, seg_no, unnest(message_ids) AS mid FROM fx_segments) s JOIN fx_threads t ON t.id = s.mid
 UNION ALL
 SELECT s.call_id, s.seg_no, l.discussion_id, NULL FROM fx_segments s
 JOIN fx_labels l ON l.call_id = s.call_id AND l.label = s.source_cluster
 WHERE len(list_filter(s.message_ids, lambda x: x IS NOT NULL)) = 0
 UNION ALL
 SELECT s.call_id, s.seg_no, l.d, NULL FROM fx_segments s
 JOIN (SELECT call_id, min(discussion_id) AS d FROM fx_labels GROUP BY 1 HAVING count(*) = 1) l ON l.call_id = s.call_id
 WHERE len(list_filter(s.message_ids, lambda x: x IS NOT NULL)) = 0 AND s.source_cluster IS NULL)""",
    "fx_partitioned": """
SELECT p.discussion_id, p.id, p.created_at, coalesce(p.seg, n.seg_no, c.seg_no) AS seg_no FROM (
 SELECT t.discussion_id, t.id, t.created_at, t.turn, m.seg,
  row_number() OVER (PARTITION BY t.discussion_id ORDER BY t.created_at, t.id) - 1 AS i,
  count(*) OVER (PARTITION BY t.discussion_id) AS n
 FROM fx_threads t LEFT JOIN (SELECT message_id, min(seg_no) AS seg FROM fx_mapped WHERE message_id IS NOT NULL GROUP BY 1) m ON m.message_id = t.id
 WHERE t.discussion_id IN (SELECT discussion_id FROM fx_mapped)) p
LEFT JOIN (
 SELECT t.id, arg_min(x.seg_no, (abs(epoch_ms(t.created_at) - epoch_ms(a.created_at)), a.created_at, a.id)) AS seg_no
 FROM fx_threads t JOIN fx_threads a ON a.discussion_id = t.discussion_id
 JOIN (SELECT message_id, min(seg_no) AS seg_no FROM fx_mapped WHERE message_id IS NOT NULL GROUP BY 1) x ON x.message_id = a.id
 GROUP BY 1) n ON n.id = p.id
LEFT JOIN (
 SELECT discussion_id, seg_no, row_number() OVER (PARTITION BY discussion_id ORDER BY seg_no) - 1 AS k,
  count(*) OVER (PARTITION BY discussion_id) AS ks FROM (SELECT DISTINCT discussion_id, seg_no FROM fx_mapped)) c
 ON c.discussion_id = p.discussion_id AND c.k = least(c.ks - 1, p.i // greatest(1, ceil(p.n / c.ks)::BIGINT))""",
    # dumps and payloads
    "fx_dump": """
SELECT CAST(event_id AS VARCHAR) AS id, event_type AS channel_id, CAST(user_id AS VARCHAR) AS author_id,
 CASE WHEN event_id % 29 = 0 THEN '' WHEN event_id % 58 = 1 THEN ' ' || chr(9) || ' ' ELSE props END AS content,
 strftime(date_trunc('millisecond', ts), '%Y-%m-%dT%H:%M:%S.%g') || '+00:00' AS created_at, date_trunc('millisecond', ts) AS at_ts,
 CASE WHEN event_id % 23 = 0 THEN '2024-03-01T00:00:00Z' END AS deleted_at, event_id * 2 + c.copy AS pos
FROM events, (VALUES (0), (1)) c(copy) WHERE c.copy = 0 OR event_id % 31 = 0""",
    "fx_assigned": "SELECT *, CASE WHEN channel_id IN ('click', 'view') THEN 'g1' ELSE 'g0' END AS guild_id FROM fx_dump",
    "fx_clean": f"""
SELECT * FROM fx_assigned WHERE deleted_at IS NULL AND {trim('content')} <> ''
QUALIFY row_number() OVER (PARTITION BY guild_id, channel_id, id ORDER BY pos) = 1""",
    "fx_payload": """
SELECT CASE WHEN user_id % 5 = 3 THEN 'x' || user_id ELSE CAST(user_id AS VARCHAR) END AS id,
 CASE user_id % 5 WHEN 0 THEN 'new' || user_id WHEN 3 THEN 'n' END AS username, user_id % 5 IN (0, 3) AS has_username,
 CASE user_id % 5 WHEN 3 THEN '' WHEN 4 THEN 'User ' || user_id END AS display_name, user_id % 5 IN (1, 3, 4) AS has_display_name
FROM (SELECT DISTINCT user_id FROM events)""",
    "fx_sync": """
SELECT coalesce(u.id, p.id) AS id, u.id IS NULL AS created, p.id IS NOT NULL AS received, u.username AS old_username,
 u.display_name AS old_display_name, p.username, p.display_name, p.has_username, p.has_display_name,
 u.message_count, (u.id IS NOT NULL AND p.id IS NOT NULL AND (
  (p.has_username AND p.username IS DISTINCT FROM u.username) OR
  (p.has_display_name AND p.display_name IS DISTINCT FROM u.display_name))) AS updated
FROM fx_users u FULL JOIN fx_payload p ON p.id = u.id""",
    "fx_stored": "SELECT id FROM fx_slim WHERE created_at < TIMESTAMP '2024-01-15'",
    "fx_batch": "SELECT *, 'b' || (author_id::BIGINT % 10) AS batch_id FROM fx_dump",
    "fx_new": "SELECT * FROM fx_batch WHERE id NOT IN (SELECT id FROM fx_stored) QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos) = 1",
    # clustering
    "fx_blocks": f"""
SELECT s.*, epoch_ms(x.mx) - epoch_ms(s.block_end_at) > {GAP_MS} AS closed FROM (
 SELECT *, min(created_at) OVER (PARTITION BY channel_id, block_no) AS block_start_at,
  max(created_at) OVER (PARTITION BY channel_id, block_no) AS block_end_at FROM (
  SELECT *, CAST(sum(nb) OVER (PARTITION BY channel_id ORDER BY created_at, id) AS BIGINT) AS block_no FROM (
   SELECT *, CASE WHEN epoch_ms(created_at) - epoch_ms(lag(created_at) OVER (PARTITION BY channel_id ORDER BY created_at, id)) > {GAP_MS}
    THEN 1 ELSE 0 END AS nb FROM fx_messages WHERE processed = 0 AND thread_id IS NULL))) s
JOIN (SELECT channel_id, max(created_at) AS mx FROM fx_slim GROUP BY 1) x USING (channel_id)""",
    "fx_sub": """
SELECT id, channel_id, block_no, created_at, arg_min(id, (created_at, id)) OVER (PARTITION BY channel_id, block_no, author_id::BIGINT % 4) AS root_id
FROM fx_blocks WHERE closed AND word_count >= 6""",
    "fx_replies": """
SELECT b.id, b.reply_to_message_id AS target_id, m.discussion_id AS target_discussion_id FROM fx_blocks b
LEFT JOIN fx_slim m ON m.id = b.reply_to_message_id AND m.processed = 1
LEFT JOIN fx_blocks t ON t.id = b.reply_to_message_id AND t.closed AND t.channel_id = b.channel_id AND t.block_no < b.block_no
WHERE b.closed AND b.reply_to_message_id IS NOT NULL AND (m.id IS NOT NULL OR t.id IS NOT NULL)""",
    "fx_subnodes": """
SELECT s.channel_id, s.block_no, s.root_id, count(*) AS members,
 arg_min(r.target_id, (s.created_at, s.id)) FILTER (WHERE r.id IS NOT NULL) AS target_id,
 (arg_min({'d': r.target_discussion_id}, (s.created_at, s.id)) FILTER (WHERE r.id IS NOT NULL)).d AS target_discussion_id
FROM fx_sub s LEFT JOIN fx_replies r ON r.id = s.id GROUP BY 1, 2, 3""",
    "fx_placed": """
SELECT id, channel_id, block_no, created_at, is_long, plain, target_id, target_discussion_id,
 CASE WHEN is_long THEN root_id WHEN NOT plain THEN id ELSE coalesce(prev_long, first_plain) END AS node FROM (
 SELECT b.id, b.channel_id, b.block_no, b.created_at, s.root_id, s.root_id IS NOT NULL AS is_long,
  s.root_id IS NULL AND r.id IS NULL AS plain, r.target_id, r.target_discussion_id,
  last_value(s.root_id IGNORE NULLS) OVER (PARTITION BY b.channel_id, b.block_no ORDER BY b.created_at, b.id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_long,
  first_value(CASE WHEN s.root_id IS NULL AND r.id IS NULL THEN b.id END IGNORE NULLS) OVER (PARTITION BY b.channel_id, b.block_no
    ORDER BY b.created_at, b.id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first_plain
 FROM fx_blocks b LEFT JOIN fx_sub s ON s.id = b.id LEFT JOIN fx_replies r ON r.id = b.id WHERE b.closed)""",
    "fx_links": """
SELECT root_id AS node, target_id, target_discussion_id FROM fx_subnodes WHERE members = 1 AND target_id IS NOT NULL
UNION ALL SELECT id, target_id, target_discussion_id FROM fx_placed WHERE NOT is_long AND NOT plain""",
    "fx_chase": """
SELECT node AS start, node AS cur, NULL::VARCHAR AS disc FROM (SELECT DISTINCT node FROM fx_placed)
UNION ALL
SELECT c.start, CASE WHEN l.target_discussion_id IS NULL THEN p.node END, l.target_discussion_id
FROM fx_chase c JOIN fx_links l ON l.node = c.cur LEFT JOIN fx_placed p ON p.id = l.target_id""",
    "fx_roots": "SELECT start AS node, cur, disc FROM fx_chase WHERE disc IS NOT NULL OR cur NOT IN (SELECT node FROM fx_links)",
    "fx_attached": """
SELECT p.id, p.channel_id, p.block_no, p.created_at, p.node, p.is_long, p.plain, coalesce(r.disc = r.disc, false) AS old, r.cur,
 coalesce(r.disc, md5(p.channel_id || '|' || r.cur)) AS discussion_id FROM fx_placed p JOIN fx_roots r ON r.node = p.node""",
}


def _allowed(q: str, n: str) -> str:
    return (f"({q}.channel_ids IS NULL OR list_contains({q}.channel_ids, {n}.channel_id)) AND "
            f"({q}.discussion_types IS NULL OR list_contains({q}.discussion_types, {n}.discussion_type)) AND "
            f"({q}.since IS NULL OR {n}.started_at >= {q}.since)")


ALLOWED = _allowed("q", "n")
_TOKENS = r"list_filter(string_split_regex(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"

CTES["fx_labeled"] = """
SELECT 'topic' AS kind, topic AS label, discussion_id AS id FROM fx_topics UNION ALL SELECT 'entity', key, discussion_id FROM fx_entities"""
CTES["fx_labelnames"] = f"""
SELECT kind, label, {_TOKENS.format('name')} AS toks FROM (
 SELECT 'topic' AS kind, name AS label, name FROM fx_tnodes UNION ALL SELECT 'entity', key, name FROM fx_enodes)"""
CTES["fx_paths"] = """
SELECT DISTINCT * FROM (
 SELECT src AS seed_id, dst AS id, 'continuation' AS via, 1.0::DOUBLE AS weight FROM fx_cont UNION ALL SELECT dst, src, 'continuation', 1.0 FROM fx_cont
 UNION ALL SELECT a.discussion_id, b.discussion_id, 'shared_entity', 0.8 FROM fx_entities a JOIN fx_entities b ON a.key = b.key
 UNION ALL SELECT a.discussion_id, b.discussion_id, 'shared_topic', 0.6 FROM fx_topics a JOIN fx_topics b ON a.topic = b.topic
 UNION ALL SELECT a.discussion_id, b.discussion_id, 'cooccurring_topic', 0.4 FROM fx_topics a
  JOIN (SELECT a AS x, b AS y FROM fx_tpairs UNION SELECT b, a FROM fx_tpairs) c ON c.x = a.topic JOIN fx_topics b ON b.topic = c.y)
WHERE seed_id <> id"""


def _retrieval(r: str, questions: str) -> dict[str, str]:
    """Views of one retrieval pass; ``r`` marks the pass."""
    phrases = _TOKENS.format("t")
    return {
        f"fx_hits{r}": f"""
SELECT v.question_id, v.variant_no, n.id, round(list_cosine_similarity(v.vec, n.embedding), 9) AS similarity
FROM fx_variants v JOIN {questions} q USING (question_id), fx_nodes n WHERE {ALLOWED}
QUALIFY row_number() OVER (PARTITION BY v.question_id, v.variant_no ORDER BY round(list_cosine_similarity(v.vec, n.embedding), 9) DESC, n.id) <= 40""",
        f"fx_anchorlabels{r}": f"""
SELECT question_id, kind, label, max(score) AS score FROM (
 SELECT p.question_id, l.kind, l.label, len(p.toks) / len(l.toks) AS score
 FROM (SELECT question_id, {phrases} AS toks FROM (SELECT question_id, unnest(list_concat(topics, entities)) AS t FROM {questions})) p
 JOIN fx_labelnames l ON len(p.toks) > 0 AND contains(' ' || array_to_string(l.toks, ' ') || ' ', ' ' || array_to_string(p.toks, ' ') || ' '))
GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY max(score) DESC, kind, label) <= 60""",
        f"fx_anchors{r}": f"""
SELECT a.question_id, n.id, max(a.score) AS label_score, row_number() OVER (PARTITION BY a.question_id ORDER BY max(a.score) DESC, n.started_at DESC, n.id) AS rank
FROM fx_anchorlabels{r} a JOIN fx_labeled USING (kind, label) JOIN fx_nodes n USING (id) JOIN {questions} q USING (question_id)
WHERE {ALLOWED} GROUP BY a.question_id, n.id, n.started_at QUALIFY rank <= 30""",
        f"fx_cands{r}": f"""
SELECT question_id, id, max(similarity) AS vec_sim, bool_or(source = 'anchor') AS anchor_hit, list_sort(list(DISTINCT source)) AS sources FROM (
 SELECT question_id, id, similarity, 'vector' AS source FROM fx_hits{r}
 UNION ALL SELECT a.question_id, a.id, round(list_cosine_similarity(q.vec, n.embedding), 9), 'anchor' FROM fx_anchors{r} a
 JOIN {questions} q USING (question_id) JOIN fx_nodes n USING (id)) GROUP BY 1, 2""",
        f"fx_seeds{r}": f"""
SELECT question_id, id AS seed_id, round(vec_sim + 0.6::DOUBLE * anchor_hit::INT, 9) AS prelim, row_number() OVER (PARTITION BY question_id
 ORDER BY round(vec_sim + 0.6::DOUBLE * anchor_hit::INT, 9) DESC, id) AS rank FROM fx_cands{r} QUALIFY rank <= 8""",
        f"fx_expand{r}": f"""
SELECT s.question_id, s.seed_id, p.via, n.id, p.weight, row_number() OVER (PARTITION BY s.question_id ORDER BY p.weight DESC, n.started_at DESC, n.id, s.seed_id) AS rank
FROM fx_seeds{r} s JOIN fx_paths p USING (seed_id) JOIN fx_nodes n ON n.id = p.id JOIN {questions} q USING (question_id)
WHERE {ALLOWED} QUALIFY row_number() OVER (PARTITION BY s.question_id ORDER BY p.weight DESC, n.started_at DESC, n.id, s.seed_id) <= 40""",
        f"fx_scored{r}": f"""
SELECT question_id, id, max(vec_sim) AS vec_sim, bool_or(anchor_hit) AS anchor_hit, max(expansion_score) AS expansion_score, max(via) AS via,
 list_sort(list_distinct(flatten(list(sources)))) AS sources FROM (
 SELECT question_id, id, vec_sim, anchor_hit, sources, 0.0::DOUBLE AS expansion_score, NULL::VARCHAR AS via FROM fx_cands{r}
 UNION ALL SELECT e.question_id, e.id, round(list_cosine_similarity(q.vec, n.embedding), 9), false, ['expansion'], e.w, e.via
 FROM (SELECT question_id, id, max(weight) AS w, arg_max(via, weight) AS via FROM fx_expand{r} GROUP BY 1, 2) e
 JOIN {questions} q USING (question_id) JOIN fx_nodes n USING (id)) GROUP BY 1, 2""",
        f"fx_ranked{r}": f"""
SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS rank FROM (
 SELECT c.*, n.title, n.summary, n.channel_id, n.discussion_type, n.sentiment, n.resolved, n.started_at, y.recency, y.preference,
  round(c.vec_sim + 0.6::DOUBLE * c.anchor_hit::INT + 0.4::DOUBLE * c.expansion_score + 0.15::DOUBLE * y.recency + y.preference, 9) AS score
 FROM fx_scored{r} c JOIN fx_nodes n USING (id) JOIN {questions} q USING (question_id),
 LATERAL (SELECT pow(0.5::DOUBLE, greatest(0.0, (epoch_ms(TIMESTAMP '2024-02-01') - epoch_ms(n.started_at)) / 86400000.0::DOUBLE) / 120.0::DOUBLE) AS recency,
  CASE WHEN list_contains(q.preferred_types, n.discussion_type) THEN 0.15::DOUBLE ELSE 0.0 END +
  CASE WHEN q.intent = 'troubleshooting' AND n.resolved THEN 0.05::DOUBLE ELSE 0.0 END AS preference) y)
WHERE score >= 0.15""",
    }


CTES |= _retrieval("", "fx_questions")
CTES["fx_rquestions"] = """
SELECT * REPLACE (NULL::VARCHAR[] AS discussion_types, NULL::TIMESTAMP AS since) FROM fx_questions
WHERE (discussion_types IS NOT NULL OR since IS NOT NULL) AND question_id NOT IN (SELECT question_id FROM fx_ranked)"""
CTES |= _retrieval("_r", "fx_rquestions")
CTES["fx_all"] = "SELECT *, false AS relaxed FROM fx_ranked UNION ALL SELECT *, true FROM fx_ranked_r"
CTES["fx_evid"] = """
SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS evidence_rank FROM (
 SELECT a.*, row_number() OVER (PARTITION BY a.question_id ORDER BY
  CASE WHEN q.intent = 'opinion' AND a.sentiment IN ('negative', 'positive') AND a.sr = 1 THEN 0 ELSE 1 END, a.rank) AS o
 FROM (SELECT *, row_number() OVER (PARTITION BY question_id, sentiment ORDER BY rank) AS sr FROM fx_all) a JOIN fx_questions q USING (question_id))
WHERE o <= 10"""
CTES["fx_people"] = """
SELECT discussion_id AS id, list({'n': name, 'c': message_count} ORDER BY rn) AS people FROM (
 SELECT *, row_number() OVER (PARTITION BY discussion_id ORDER BY message_count DESC, name) AS rn FROM (
  SELECT discussion_id, coalesce(display_name, username, author_id) AS name, message_count FROM fx_parts)) GROUP BY 1"""
CTES["fx_cores"] = """
SELECT n.id, n.title, c.name AS channel_name, n.topics, e.ents, p.people, n.message_count, n.participant_count FROM fx_nodes n
LEFT JOIN fx_channels c ON c.id = n.channel_id LEFT JOIN fx_people p ON p.id = n.id
LEFT JOIN (SELECT discussion_id, list_sort(list(DISTINCT k.name)) AS ents FROM fx_entities x JOIN fx_enodes k ON k.key = x.key GROUP BY 1) e ON e.discussion_id = n.id"""
CTES["fx_samples"] = f"""
SELECT m.discussion_id, m.id, row_number() OVER (PARTITION BY m.discussion_id ORDER BY m.created_at, m.id) AS rn,
 '  [' || {iso('m.created_at')} || '] ' || coalesce(u.display_name, u.username, m.author_id) || ': ' ||
 x.t AS line
FROM fx_members m JOIN (SELECT id, {one_line('content')} AS t FROM fx_messages) x ON x.id = m.id LEFT JOIN fx_users u ON u.id = m.author_id
WHERE m.discussion_id IN (SELECT id FROM fx_evid WHERE evidence_rank <= 4) QUALIFY rn <= 40"""
CTES["fx_blocktext"] = f"""
SELECT b.*, ceil(length(lean) / 3.4)::BIGINT AS lean_tokens, ceil(length(full_text) / 3.4)::BIGINT AS full_tokens FROM (
 SELECT z.*, CASE WHEN z.evidence_rank <= 4 AND s.raw IS NOT NULL THEN lean || chr(10) || 'some messages:' || chr(10) || s.raw ELSE lean END AS full_text FROM (
  SELECT v.question_id, v.id, v.evidence_rank, v.title, v.discussion_type, v.sentiment, v.started_at, v.score, c.channel_name, concat_ws(chr(10),
   '[D' || v.evidence_rank || '] "' || v.title || '"',
   'in ' || coalesce('#' || c.channel_name, '?') || ' · from ' || {iso('v.started_at')} || ' · kind ' || v.discussion_type || ' · mood ' || v.sentiment ||
   ' · solved ' || CASE WHEN v.resolved THEN 'yes' WHEN NOT v.resolved THEN 'no' ELSE '–' END,
   'people: ' || array_to_string(list_transform(c.people, lambda p: p.n || ' (' || p.c || ')'), ', '),
   CASE WHEN v.summary <> '' THEN 'in short: ' || v.summary END,
   'main points:' || chr(10) || array_to_string(list_transform(e.key_points, lambda k: '- ' || k), chr(10)),
   'topics: ' || array_to_string(c.topics, ', '), 'names: ' || array_to_string(c.ents, ', ')) AS lean
  FROM fx_evid v JOIN fx_cores c USING (id) JOIN fx_enrichment e ON e.discussion_id = v.id) z
 LEFT JOIN (SELECT discussion_id, string_agg(line, chr(10) ORDER BY rn) AS raw FROM fx_samples GROUP BY 1) s ON s.discussion_id = z.id) b"""
CTES["fx_fold"] = """
SELECT question_id, evidence_rank, full_tokens <= 12000 AS with_raw, CASE WHEN full_tokens <= 12000 THEN full_tokens ELSE lean_tokens END AS used
FROM fx_blocktext WHERE evidence_rank = 1
UNION ALL
SELECT b.question_id, b.evidence_rank, f.used + b.full_tokens <= 12000, f.used + CASE WHEN f.used + b.full_tokens <= 12000 THEN b.full_tokens ELSE b.lean_tokens END
FROM fx_fold f JOIN fx_blocktext b ON b.question_id = f.question_id AND b.evidence_rank = f.evidence_rank + 1 WHERE f.used + b.lean_tokens <= 12000"""
CTES["fx_packed"] = """
SELECT b.*, f.with_raw, CASE WHEN f.with_raw THEN b.full_text ELSE b.lean END AS text FROM fx_blocktext b JOIN fx_fold f USING (question_id, evidence_rank)"""
CTES["fx_drafts"] = """
SELECT question_id, string_agg('[D' || evidence_rank || ']', ' ' ORDER BY evidence_rank) AS answer, count(*) AS items FROM fx_packed GROUP BY 1"""
