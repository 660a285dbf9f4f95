"""Independent DuckDB SQL for every registered query.

``INPUTS`` re-derives each operator input from the base tables in DuckDB SQL
(written separately from the Spark code in ``memoria.sources.derived``);
``ORACLE`` holds, per query key, the body that runs on top of those CTEs.
"""
from __future__ import annotations

import re

INPUTS: dict[str, str] = {}
DEPS: dict[str, tuple[str, ...]] = {}
ORACLE: dict[str, str] = {}
USES: dict[str, tuple[str, ...]] = {}


def _input(name: str, sql: str, deps: tuple[str, ...] = ()) -> None:
    INPUTS[name] = sql
    DEPS[name] = deps


def oracle(key: str, uses: tuple[str, ...], body: str) -> None:
    USES[key] = uses
    ORACLE[key] = body


def _closure(names) -> list[str]:
    out: list[str] = []

    def visit(n):
        if n in out:
            return
        for d in DEPS.get(n, ()):
            visit(d)
        out.append(n)
    for n in names:
        visit(n)
    return out


def render(key: str) -> str:
    names = _closure(USES[key])
    if not names:
        return ORACLE[key].strip()
    ctes = ",\n".join(f"{n} AS (\n{INPUTS[n].strip()}\n)" for n in names)
    body = ORACLE[key].strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        # the body's own CTEs continue the input CTE list
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def all_sql() -> dict[str, str]:
    return {k: render(k) for k in ORACLE}


# ---------------------------------------------------------------- memory family
_input("memories_base", """
SELECT CAST(event_id AS VARCHAR) AS id, event_id AS seq,
       'agent_' || CAST(user_id % 5 AS VARCHAR) AS agent_id,
       's_' || CAST(user_id AS VARCHAR) AS session_id,
       CASE event_type WHEN 'click' THEN 'conversation' WHEN 'view' THEN 'scratch'
            WHEN 'purchase' THEN 'fact' WHEN 'signup' THEN 'user_preference'
            WHEN 'error' THEN 'observation' END AS memory_type,
       event_type || ' ' || props AS content,
       CAST(event_id % 10 AS DOUBLE) / 10 AS importance,
       CAST(event_id % 6 + 5 AS DOUBLE) / 10 AS confidence,
       CAST(event_id % 4 AS INTEGER) AS access_count,
       ts AS created_at, ts AS updated_at,
       ts + to_days(CAST(event_id % 20 AS INTEGER)) AS last_accessed,
       (event_id % 7 = 0) AS is_summarized
FROM events""")

_input("memories", """
SELECT b.*,
       CASE WHEN length(content) > 100 THEN substr(content, 1, 97) || '...' ELSE content END AS summary,
       memory_type IN ('fact','knowledge','reflection','goal','learned_skill','user_preference') AS is_persistent,
       CASE WHEN memory_type IN ('fact','knowledge','reflection','goal','learned_skill','user_preference') THEN NULL
            WHEN memory_type = 'scratch' THEN created_at + INTERVAL 1 HOUR
            WHEN memory_type = 'conversation' THEN created_at + INTERVAL 7 DAY
            WHEN memory_type = 'plan' THEN created_at + INTERVAL 3 DAY
            ELSE created_at + INTERVAL 30 DAY END AS expires_at
FROM memories_base b""", ("memories_base",))

_input("deleted_ids", """
SELECT CAST(event_id AS VARCHAR) AS id,
       'agent_' || CAST(CASE WHEN event_id % 46 = 0 THEN (user_id + 1) % 5 ELSE user_id % 5 END AS VARCHAR) AS agent_id
FROM events WHERE event_id % 23 = 0""")

_input("memory_change_batch", """
SELECT * REPLACE (
         CASE WHEN action = 'create' THEN CAST(seq + 1000000 AS VARCHAR) ELSE id END AS id,
         CASE WHEN action = 'create' THEN seq + 1000000 ELSE seq END AS seq,
         CASE WHEN action = 'update' THEN 0.9 ELSE importance END AS importance)
FROM (SELECT m.*, CASE WHEN seq % 31 = 0 THEN 'delete' WHEN seq % 29 = 0 THEN 'update'
                       WHEN seq % 37 = 0 THEN 'create' END AS action
      FROM memories m) x
WHERE action IS NOT NULL""", ("memories",))

_input("memory_requests", """
SELECT CAST(doc_id AS VARCHAR) AS id,
       CASE WHEN doc_id % 11 = 0 THEN NULL ELSE source END AS session_id,
       (['fact','conversation','scratch','plan','observation','reflection'])[CAST(doc_id % 6 AS INTEGER) + 1] AS memory_type,
       text AS content
FROM documents""")

_input("memory_vectors", """
SELECT CAST(e.vec_id AS VARCHAR) AS id, CAST(e.embedding AS DOUBLE[]) AS vector,
       m.agent_id, m.session_id, m.memory_type
FROM embeddings e JOIN memories m ON m.id = CAST(e.vec_id AS VARCHAR)""", ("memories",))

_input("query_vectors", """
SELECT vec_id AS query_id, 'agent_' || CAST(vec_id % 5 AS VARCHAR) AS agent_id,
       CAST(embedding AS DOUBLE[]) AS vector
FROM embeddings""")

_input("relationships", """
SELECT 'r_' || CAST(a.event_id AS VARCHAR) AS id, CAST(a.event_id AS VARCHAR) AS source_id,
       CAST(b.event_id AS VARCHAR) AS target_id, a.event_type AS relationship_type,
       CAST(a.event_id % 10 AS DOUBLE) / 10 AS strength
FROM events a JOIN events b ON b.event_id = a.event_id + 7""")

_input("reflections", """
SELECT 'rf_' || CAST(event_id AS VARCHAR) AS id, 'agent_' || CAST(user_id % 5 AS VARCHAR) AS agent_id, ts AS created_at
FROM events WHERE event_type = 'signup'""")

_input("tasks", """
SELECT 'tk_' || CAST(event_id AS VARCHAR) AS id, 'agent_' || CAST(user_id % 5 AS VARCHAR) AS agent_id, ts AS created_at
FROM events WHERE event_type = 'error'""")

_input("experiences", """
SELECT user_id AS thread_id, event_id AS seq,
       'episodes.' || CAST(user_id AS VARCHAR) AS prefix, CAST(event_id AS VARCHAR) AS key,
       CAST(event_id % 4 + 1 AS INTEGER) AS importance,
       CASE event_type WHEN 'signup' THEN 'preference' WHEN 'purchase' THEN 'fact'
            WHEN 'click' THEN 'interaction' WHEN 'view' THEN 'skill' WHEN 'error' THEN 'error' END AS memory_type,
       event_type || CAST(event_id AS VARCHAR) AS observation,
       'act_' || CAST(event_id AS VARCHAR) AS action,
       ts - to_days(CAST(event_id % 100 AS INTEGER)) AS created_at,
       least(ts - to_days(CAST(event_id % 100 AS INTEGER)) + to_days(CAST(event_id % 60 AS INTEGER)),
             TIMESTAMP '2024-02-01 00:00:00') AS last_accessed,
       CAST(event_id % 5 + 1 AS INTEGER) AS access_count, event_type AS tags
FROM events""")

_input("classified_conversations", """
SELECT conv_id, turn, role,
       text || ([' remember this', ' It FAILED', ' tutorial', ' unlikely', ''])[CAST(conv_id % 5 AS INTEGER) + 1] AS text
FROM conversations""")

_input("turn_pairs", """
SELECT u.conv_id, u.turn, u.text AS user_text, a.text AS assistant_text
FROM conversations u JOIN conversations a
  ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
WHERE u.role = 'user'""")

_input("reflection_requests", """
SELECT CAST(doc_id AS VARCHAR) AS id, source AS topic,
       ([lang, source, 'n_chars=' || CAST(n_chars AS VARCHAR)])[1:CAST(doc_id % 4 AS INTEGER)] AS insights,
       (['review ' || lang, 'recheck ' || source])[1:CAST(doc_id % 3 AS INTEGER)] AS action_items
FROM documents""")

AS_OF = "TIMESTAMP '2024-02-01 00:00:00'"

oracle("memory_distribution", ("memories",), """
SELECT agent_id, memory_type, COUNT(*) AS count,
       COUNT(*) FILTER (WHERE is_persistent) AS persistent,
       COUNT(*) FILTER (WHERE NOT is_persistent) AS temporary,
       ROUND(AVG(importance), 6) AS avg_importance,
       CAST(SUM(access_count) AS BIGINT) AS total_accesses,
       MAX(last_accessed) AS last_accessed
FROM memories GROUP BY agent_id, memory_type
ORDER BY agent_id, count DESC""")

_PERSIST = "('fact','knowledge','reflection','goal','learned_skill','user_preference')"


def _expiry(mt: str, persist: str, now: str) -> str:
    return (f"CASE WHEN {persist} THEN NULL WHEN {mt} = 'scratch' THEN {now} + INTERVAL 1 HOUR "
            f"WHEN {mt} = 'conversation' THEN {now} + INTERVAL 7 DAY WHEN {mt} = 'plan' THEN {now} + INTERVAL 3 DAY "
            f"ELSE {now} + INTERVAL 30 DAY END")


def _summary(content: str) -> str:
    return f"CASE WHEN length({content}) > 100 THEN substr({content}, 1, 97) || '...' ELSE {content} END"


oracle("memory_enrich", ("memory_requests",), f"""
SELECT id, session_id, 'default_agent' AS agent_id, memory_type, {_summary('content')} AS summary,
       CAST(0.5 AS DOUBLE) AS importance, CAST(1.0 AS DOUBLE) AS confidence, CAST(0 AS INTEGER) AS access_count,
       {AS_OF} AS created_at, memory_type IN {_PERSIST} AS is_persistent,
       {_expiry('memory_type', 'memory_type IN ' + _PERSIST, AS_OF)} AS expires_at,
       false AS is_summarized, CAST(0 AS INTEGER) AS n_tags, CAST(length(content) AS BIGINT) AS content_chars
FROM memory_requests
WHERE coalesce(session_id, '') <> '' AND coalesce(memory_type, '') <> '' AND coalesce(content, '') <> ''""")

oracle("memory_validate", ("memory_requests",), """
SELECT id, (coalesce(session_id, '') <> '' AND coalesce(memory_type, '') <> '' AND coalesce(content, '') <> '') AS is_valid
FROM memory_requests""")

_EXPIRED = f"(NOT is_persistent AND expires_at IS NOT NULL AND expires_at < {AS_OF})"
_LOW_VALUE = (f"(NOT is_persistent AND access_count = 0 AND created_at < {AS_OF} - INTERVAL 1 DAY "
              f"AND importance * confidence < CAST(0.3 AS DOUBLE))")

oracle("expired_memories", ("memories",), f"""
SELECT id, agent_id, memory_type, expires_at FROM memories WHERE {_EXPIRED}""")

oracle("low_value_memories", ("memories",), f"""
SELECT id, agent_id, importance, confidence FROM memories WHERE {_LOW_VALUE}""")

oracle("cleanup_expired", ("memories",), f"""
SELECT agent_id,
       COUNT(*) FILTER (WHERE expires_at IS NOT NULL AND expires_at < {AS_OF} AND is_persistent = false) AS deleted_count,
       COUNT(*) FILTER (WHERE NOT coalesce(expires_at IS NOT NULL AND expires_at < {AS_OF} AND is_persistent = false, false)) AS remaining_count
FROM memories GROUP BY agent_id""")

oracle("memory_statistics", ("memories",), """
SELECT agent_id, COUNT(*) AS total_memories,
       COUNT(*) FILTER (WHERE is_persistent) AS persistent_count,
       COUNT(*) FILTER (WHERE NOT is_persistent) AS temporary_count,
       ROUND(coalesce(AVG(importance), 0), 6) AS avg_importance,
       ROUND(coalesce(AVG(confidence), 0), 6) AS avg_confidence,
       CAST(coalesce(SUM(access_count), 0) AS BIGINT) AS total_accesses
FROM memories GROUP BY agent_id""")

oracle("memory_lifecycle", ("memories",), f"""
SELECT agent_id, CAST(created_at AS DATE) AS date, COUNT(*) AS created,
       COUNT(*) FILTER (WHERE is_persistent) AS persistent_created,
       COUNT(*) FILTER (WHERE expires_at < {AS_OF}) AS expired,
       COUNT(*) FILTER (WHERE is_summarized) AS summarized
FROM memories GROUP BY agent_id, CAST(created_at AS DATE) ORDER BY agent_id, date DESC""")

# The view's two one-to-many LEFT JOINs on whole tables would build billions of
# rows; the counts they produce are M*max(1,R)*max(1,T), M*R*max(1,T) and
# M*max(1,R)*T (a literal-join check on a small fixture is in tests/test_traps.py).
oracle("agent_activity", ("memories", "reflections", "tasks"), """
WITH m AS (SELECT agent_id, COUNT(DISTINCT session_id) AS unique_sessions, COUNT(id) AS m,
                  MAX(created_at) AS last_activity FROM memories GROUP BY agent_id),
r AS (SELECT agent_id, COUNT(id) AS r, COUNT(*) AS rr FROM reflections GROUP BY agent_id),
t AS (SELECT agent_id, COUNT(id) AS t, COUNT(*) AS tr FROM tasks GROUP BY agent_id)
SELECT m.agent_id, m.unique_sessions,
       m.m * greatest(coalesce(r.rr, 0), 1) * greatest(coalesce(t.tr, 0), 1) AS total_memories,
       m.m * coalesce(r.r, 0) * greatest(coalesce(t.tr, 0), 1) AS total_reflections,
       m.m * greatest(coalesce(r.rr, 0), 1) * coalesce(t.t, 0) AS total_tasks,
       m.last_activity
FROM m LEFT JOIN r USING (agent_id) LEFT JOIN t USING (agent_id)""")

oracle("forget_count", ("memories",), f"""
SELECT agent_id, COUNT(*) FILTER (WHERE coalesce({_EXPIRED} OR {_LOW_VALUE}, false)) AS forgotten
FROM memories GROUP BY agent_id""")

oracle("vector_count", ("memory_vectors",), """
SELECT agent_id, COUNT(*) AS vector_count FROM memory_vectors GROUP BY agent_id""")

oracle("scoped_candidates", ("memories",), """
SELECT id, session_id, memory_type FROM memories
WHERE agent_id = 'agent_1' AND memory_type IN ('conversation', 'fact')""")

oracle("delete_memory", ("memories", "deleted_ids"), """
SELECT m.id, m.agent_id FROM memories m
WHERE NOT EXISTS (SELECT 1 FROM deleted_ids x WHERE x.id = m.id AND x.agent_id = m.agent_id)""")

oracle("cascade_delete", ("memories", "deleted_ids", "relationships"), """
WITH gone AS (SELECT m.id FROM memories m JOIN deleted_ids x ON x.id = m.id AND x.agent_id = m.agent_id)
SELECT id, source_id, target_id FROM relationships
WHERE source_id NOT IN (SELECT id FROM gone) AND target_id NOT IN (SELECT id FROM gone)""")

oracle("memory_neighbors", ("memories", "relationships"), """
WITH valid AS (
  SELECT r.* FROM relationships r
  WHERE r.source_id IN (SELECT id FROM memories) AND r.target_id IN (SELECT id FROM memories)),
both_dirs AS (
  SELECT source_id AS memory_id, target_id AS neighbor_id, 'outgoing' AS direction, relationship_type, strength FROM valid
  UNION ALL
  SELECT target_id, source_id, 'incoming', relationship_type, strength FROM valid)
SELECT b.neighbor_id, b.memory_id, b.direction, b.relationship_type, b.strength, m.memory_type AS neighbor_type
FROM both_dirs b JOIN memories m ON m.id = b.neighbor_id""")

oracle("mark_summarized", ("memories", "deleted_ids"), """
SELECT id, CASE WHEN id IN (SELECT id FROM deleted_ids) THEN true ELSE is_summarized END AS is_summarized
FROM memories""")

oracle("access_update", ("memories", "relationships"), f"""
WITH n AS (SELECT target_id AS id, COUNT(*) AS n FROM relationships GROUP BY target_id)
SELECT m.id, CAST(m.access_count + coalesce(n.n, 0) AS INTEGER) AS access_count,
       CASE WHEN n.n IS NOT NULL THEN {AS_OF} ELSE m.last_accessed END AS last_accessed
FROM memories m LEFT JOIN n ON n.id = m.id""")

oracle("reflection_content", ("reflection_requests",), f"""
WITH c AS (
  SELECT id, 'Reflection on ' || topic
         || CASE WHEN len(insights) > 0 THEN chr(10) || 'Insights: ' || array_to_string(insights, ', ') ELSE '' END
         || CASE WHEN len(action_items) > 0 THEN chr(10) || 'Actions: ' || array_to_string(action_items, ', ') ELSE '' END
         AS content
  FROM reflection_requests)
SELECT id, 'current_session' AS session_id, 'reflection' AS memory_type, content, {_summary('content')} AS summary,
       CAST(0.8 AS DOUBLE) AS importance, true AS is_persistent, CAST(NULL AS TIMESTAMP) AS expires_at,
       CAST(2 AS INTEGER) AS n_tags
FROM c WHERE coalesce(content, '') <> ''""")

oracle("remember_fact", ("memory_requests",), f"""
WITH r AS (SELECT id, content, CAST(id AS BIGINT) % 2 = 0 AS is_persistent FROM memory_requests),
t AS (SELECT *, CASE WHEN is_persistent THEN 'fact' ELSE 'temporary' END AS memory_type FROM r)
SELECT id, 'current_session' AS session_id, memory_type, {_summary('content')} AS summary,
       CAST(0.5 AS DOUBLE) AS importance, is_persistent,
       {_expiry('memory_type', 'is_persistent', AS_OF)} AS expires_at
FROM t WHERE coalesce(content, '') <> ''""")

oracle("save_interaction", ("turn_pairs",), f"""
WITH p AS (SELECT 'conv_' || CAST(conv_id AS VARCHAR) AS session_id,
                  CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) AS pair_id, user_text, assistant_text
           FROM turn_pairs),
r AS (SELECT pair_id || '_0' AS id, session_id, 'Human: ' || user_text AS content, 'conversation,user_message' AS tags FROM p
      UNION ALL
      SELECT pair_id || '_1', session_id, 'Assistant: ' || assistant_text, 'conversation,ai_response' FROM p)
SELECT id, session_id, 'conversation' AS memory_type, content, {_summary('content')} AS summary,
       CAST(0.5 AS DOUBLE) AS importance, false AS is_persistent, {AS_OF} + INTERVAL 7 DAY AS expires_at, tags
FROM r WHERE coalesce(content, '') <> '' AND session_id <> ''""")

oracle("forgetting_policy", ("memories", "relationships", "memory_vectors"), f"""
WITH gone AS (SELECT id FROM memories WHERE coalesce({_EXPIRED} OR {_LOW_VALUE}, false))
SELECT 'memories' AS table_name, id FROM memories WHERE id NOT IN (SELECT id FROM gone)
UNION ALL
SELECT 'relationships', id FROM relationships
WHERE source_id NOT IN (SELECT id FROM gone) AND target_id NOT IN (SELECT id FROM gone)
UNION ALL
SELECT 'vectors', id FROM memory_vectors WHERE id NOT IN (SELECT id FROM gone)""")

_KNN = """
scored AS (
  SELECT q.query_id, v.id, list_cosine_similarity(q.vector, v.vector) AS similarity
  FROM query_vectors q JOIN memory_vectors v ON v.agent_id = q.agent_id),
top2k AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rn
                 FROM scored) WHERE rn <= {k})"""

_SEARCH = "WITH " + _KNN.format(k=10).strip() + """,
hits AS (
  SELECT t.query_id, t.id, t.similarity, m.content, m.memory_type, m.importance, m.confidence,
         m.access_count + 1 AS access_count, t.similarity * m.importance * m.confidence AS combined_score
  FROM top2k t JOIN memories m ON m.id = t.id WHERE t.similarity >= 0.3),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY combined_score DESC, similarity DESC, id) AS rank
  FROM hits),
res AS (SELECT * FROM ranked WHERE rank <= 5)
"""

oracle("semantic_search", ("memories", "memory_vectors", "query_vectors"), _SEARCH + """
SELECT query_id, rank, id, ROUND(similarity, 6) AS similarity, ROUND(combined_score, 6) AS combined_score,
       memory_type, importance, confidence, CAST(access_count AS INTEGER) AS access_count
FROM res""")

oracle("recall_format", ("memories", "memory_vectors", "query_vectors"), _SEARCH + """
SELECT query_id,
       string_agg(printf('[%s] %s... (Score: %.3f, Importance: %.2f)', upper(memory_type), substr(content, 1, 150),
                         similarity, importance), chr(10) || chr(10) ORDER BY rank) AS text,
       CAST(COUNT(*) AS INTEGER) AS n_hits
FROM res GROUP BY query_id""")

oracle("cosine_similarity", ("memory_vectors", "query_vectors"), "WITH " + _KNN.format(k=10).strip() + """
SELECT query_id, id, ROUND(similarity, 6) AS similarity FROM top2k""")

oracle("time_texts", ("memories",), """
SELECT id, strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f') AS created_iso,
       'summary_' || strftime(created_at, '%Y%m%d_%H%M%S') AS time_id FROM memories""")

oracle("search_access_update", ("memories", "memory_vectors", "query_vectors"), "WITH " + _KNN.format(k=10).strip() + f""",
n AS (SELECT id, COUNT(*) AS n FROM top2k WHERE similarity >= 0.3 GROUP BY id)
SELECT m.id, CAST(m.access_count + coalesce(n.n, 0) AS INTEGER) AS access_count,
       CASE WHEN n.n IS NOT NULL THEN {AS_OF} ELSE m.last_accessed END AS last_accessed
FROM memories m LEFT JOIN n ON n.id = m.id""")

# ------------------------------------------------------------ experience store
def _days(later: str, earlier: str) -> str:
    return f"CAST(floor((epoch_us({later}) - epoch_us({earlier})) / 86400000000) AS BIGINT)"


_input("ex_scored", f"""
SELECT e.*, {_days(AS_OF, 'created_at')} AS age_days, {_days(AS_OF, 'last_accessed')} AS recency_days
FROM experiences e""", ("experiences",))

_input("ex_score", """
SELECT s.*,
       CAST(age_days AS DOUBLE) * CAST(0.1 AS DOUBLE) + CAST(recency_days AS DOUBLE) * CAST(0.2 AS DOUBLE)
       + CAST(CASE importance WHEN 1 THEN 0 WHEN 2 THEN -10 WHEN 3 THEN -25 WHEN 4 THEN -1000 ELSE 0 END AS DOUBLE)
       - CAST(access_count * 2 AS DOUBLE)
       + CAST(CASE memory_type WHEN 'error' THEN 5 WHEN 'preference' THEN -10 ELSE 0 END AS DOUBLE) AS forget_score
FROM ex_scored s""", ("ex_scored",))

_input("ex_forgotten", """
SELECT * FROM (
  SELECT s.*, row_number() OVER (PARTITION BY thread_id ORDER BY forget_score DESC, seq) AS forget_rank,
         greatest(0, t.total - 50) AS quota
  FROM ex_score s JOIN (SELECT thread_id, COUNT(*) AS total FROM experiences GROUP BY thread_id) t USING (thread_id)
  WHERE importance <> 4) x
WHERE forget_rank <= quota""", ("ex_score",))

_input("ex_remaining", """
SELECT s.* FROM ex_scored s
WHERE NOT EXISTS (SELECT 1 FROM ex_forgotten f WHERE f.thread_id = s.thread_id AND f.seq = s.seq)""",
       ("ex_scored", "ex_forgotten"))

_input("ex_gate", """
SELECT thread_id, COUNT(*) FILTER (WHERE age_days > 14) AS old_count,
       COUNT(*) FILTER (WHERE age_days > 14 AND importance <> 4) AS summarizable_count,
       COUNT(*) FILTER (WHERE age_days > 14) > 10 AS should_summarize,
       COUNT(*) FILTER (WHERE age_days > 14) > 10
         AND COUNT(*) FILTER (WHERE age_days > 14 AND importance <> 4) > 5 AS will_summarize
FROM ex_remaining GROUP BY thread_id""", ("ex_remaining",))

_input("ex_summarizable", """
SELECT r.* FROM ex_remaining r JOIN ex_gate g USING (thread_id)
WHERE g.will_summarize AND r.age_days > 14 AND r.importance <> 4""", ("ex_remaining", "ex_gate"))

_input("ex_summary", """
SELECT thread_id,
       string_agg(part, chr(10) ORDER BY group_order) AS summary_content,
       SUM(cnt) AS original_memory_count,
       string_agg(memory_type, ',' ORDER BY group_order) AS memory_types_included
FROM (
  SELECT g.thread_id, g.memory_type, g.cnt, g.group_order,
         chr(10) || upper(substr(g.memory_type, 1, 1)) || substr(g.memory_type, 2) || ' Memories ('
         || CAST(g.cnt AS VARCHAR) || '):'
         || CASE g.memory_type
              WHEN 'preference' THEN chr(10) || 'Key preferences: ' ||
                   (SELECT string_agg(observation, ', ' ORDER BY seq) FROM (
                      SELECT observation, seq FROM ex_summarizable s
                      WHERE s.thread_id = g.thread_id AND s.memory_type = 'preference' ORDER BY seq LIMIT 5))
              WHEN 'interaction' THEN chr(10) || 'Recent interactions focused on: ' ||
                   (SELECT string_agg(action, ', ' ORDER BY created_at DESC, seq) FROM (
                      SELECT action, created_at, seq FROM ex_summarizable s
                      WHERE s.thread_id = g.thread_id AND s.memory_type = 'interaction'
                      ORDER BY created_at DESC, seq LIMIT 3))
              WHEN 'skill' THEN chr(10) || 'Demonstrated skills: ' ||
                   (SELECT string_agg(observation, ', ' ORDER BY seq) FROM ex_summarizable s
                    WHERE s.thread_id = g.thread_id AND s.memory_type = 'skill')
              ELSE '' END AS part
  FROM (SELECT thread_id, memory_type, COUNT(*) AS cnt,
               row_number() OVER (PARTITION BY thread_id ORDER BY MIN(seq)) AS group_order
        FROM ex_summarizable GROUP BY thread_id, memory_type) g) p
GROUP BY thread_id""", ("ex_summarizable",))

oracle("forget_predicate", ("ex_scored",), """
SELECT thread_id, seq, age_days, recency_days,
       CASE WHEN importance = 4 THEN false
            WHEN age_days > CASE importance WHEN 1 THEN 7 WHEN 2 THEN 30 WHEN 3 THEN 90 WHEN 4 THEN 365 ELSE 30 END THEN true
            WHEN recency_days > 30 AND access_count < 3 THEN true
            WHEN memory_type = 'error' AND age_days > 7 THEN true
            ELSE false END AS should_forget
FROM ex_scored""")

oracle("forget_score", ("ex_score",), """
SELECT thread_id, seq, ROUND(forget_score, 6) AS forget_score FROM ex_score""")

oracle("forget_ranking", ("ex_forgotten",), """
SELECT thread_id, seq, forget_rank, ROUND(forget_score, 6) AS forget_score, quota FROM ex_forgotten""")

oracle("forget_top_n", ("ex_score",), """
SELECT thread_id, seq, forget_rank, ROUND(forget_score, 6) AS forget_score FROM (
  SELECT thread_id, seq, forget_score, row_number() OVER (ORDER BY forget_score DESC, seq) AS forget_rank
  FROM ex_score WHERE importance <> 4) WHERE forget_rank <= 1500""")

oracle("old_memories", ("ex_scored",), """
SELECT thread_id, seq, age_days FROM ex_scored WHERE age_days > 14 AND importance <> 4""")

oracle("memory_search_filter", ("experiences",), f"""
SELECT thread_id, seq, importance, CAST(access_count + 1 AS INTEGER) AS access_count, {AS_OF} AS last_accessed
FROM experiences WHERE memory_type = 'skill' AND coalesce(importance, 1) >= 3""")

oracle("memory_groups", ("experiences",), """
SELECT thread_id, memory_type, COUNT(*) AS count, MIN(seq) AS first_seq,
       row_number() OVER (PARTITION BY thread_id ORDER BY MIN(seq)) AS group_order
FROM experiences GROUP BY thread_id, memory_type""")

oracle("summary_gate", ("ex_gate",), "SELECT * FROM ex_gate")

oracle("recent_interactions", ("experiences",), """
SELECT thread_id, pos, action FROM (
  SELECT thread_id, action, row_number() OVER (PARTITION BY thread_id ORDER BY created_at DESC, seq) AS pos
  FROM experiences WHERE memory_type = 'interaction') WHERE pos <= 3""")

oracle("key_preferences", ("experiences",), """
SELECT thread_id, pos, observation FROM (
  SELECT thread_id, observation, row_number() OVER (PARTITION BY thread_id ORDER BY seq) AS pos
  FROM experiences WHERE memory_type = 'preference') WHERE pos <= 5""")

oracle("memory_summary_text", ("ex_summary",), """
SELECT thread_id, summary_content, CAST(original_memory_count AS BIGINT) AS original_memory_count,
       memory_types_included FROM ex_summary""")

_input("ex_next", f"""
SELECT thread_id, seq, importance, memory_type, observation, action, created_at, last_accessed, access_count, tags,
       CAST(NULL AS VARCHAR) AS summary_content, CAST(NULL AS VARCHAR) AS original_memory_count,
       CAST(NULL AS VARCHAR) AS memory_types_included
FROM ex_remaining r
WHERE NOT EXISTS (SELECT 1 FROM ex_summarizable s WHERE s.thread_id = r.thread_id AND s.seq = r.seq)
UNION ALL
SELECT thread_id, epoch_us({AS_OF}), 3, 'fact', 'Summary of ' || CAST(original_memory_count AS VARCHAR) || ' memories',
       'memory_summarization', {AS_OF}, {AS_OF}, 1, 'summary', summary_content,
       CAST(original_memory_count AS VARCHAR), memory_types_included
FROM ex_summary""", ("ex_remaining", "ex_summarizable", "ex_summary"))

oracle("maintenance", ("ex_next",), """
SELECT thread_id, seq, memory_type, importance, observation, summary_content, tags FROM ex_next""")

oracle("maintenance_lineage", ("ex_summarizable",), f"""
SELECT thread_id, epoch_us({AS_OF}) AS seq, seq AS replaces FROM ex_summarizable""")

# two more cycles: the same steps on the store before, 20 and 40 days later; summaries keep their text until replaced
_STEPS = ("ex_scored", "ex_score", "ex_forgotten", "ex_remaining", "ex_gate", "ex_summarizable", "ex_summary", "ex_next")
for _c, _store in ((2, "ex_next"), (3, "ex2_next")):
    for _name in _STEPS:
        _sql = INPUTS[_name].replace(AS_OF, f"({AS_OF} + INTERVAL {20 * (_c - 1)} DAY)")
        for _kept in ("summary_content", "original_memory_count", "memory_types_included"):
            _sql = _sql.replace(f"CAST(NULL AS VARCHAR) AS {_kept}", f"r.{_kept}")
        _sql = re.sub(r"\bex_(?=[a-z])", f"ex{_c}_", _sql).replace("experiences", _store)
        _deps = [_store if d == "experiences" else d.replace("ex_", f"ex{_c}_") for d in DEPS[_name]]
        _input(_name.replace("ex_", f"ex{_c}_"), _sql, tuple(_deps))

oracle("maintenance_cycles", ("ex3_next",), """
SELECT thread_id, seq, memory_type, importance, observation, access_count, summary_content, original_memory_count,
       memory_types_included FROM ex3_next""")

_input("conv_candidates", f"""
SELECT * FROM (
  SELECT agent_id, session_id, COUNT(*) AS message_count, MIN(created_at) AS first_created,
         row_number() OVER (PARTITION BY agent_id ORDER BY MIN(created_at), session_id) AS session_rank
  FROM memories
  WHERE memory_type = 'conversation' AND NOT is_summarized AND created_at < {AS_OF} - INTERVAL 3 DAY
  GROUP BY agent_id, session_id HAVING COUNT(*) >= 10) WHERE session_rank <= 5""", ("memories",))

_input("conv_first50", f"""
SELECT * FROM (
  SELECT m.agent_id, m.session_id, m.id, m.content,
         row_number() OVER (PARTITION BY m.agent_id, m.session_id ORDER BY m.created_at, m.seq) AS pos
  FROM memories m JOIN conv_candidates c USING (agent_id, session_id)
  WHERE m.memory_type = 'conversation' AND NOT m.is_summarized AND m.created_at < {AS_OF} - INTERVAL 3 DAY)
WHERE pos <= 50""", ("memories", "conv_candidates"))

oracle("summarize_candidates", ("conv_candidates", "conv_first50"), """
SELECT c.agent_id, c.session_id, c.message_count, c.first_created,
       string_agg(f.id, ',' ORDER BY f.pos) AS memory_ids, CAST(COUNT(*) AS INTEGER) AS n_contents
FROM conv_candidates c JOIN conv_first50 f USING (agent_id, session_id)
GROUP BY c.agent_id, c.session_id, c.message_count, c.first_created""")

oracle("summarize_conversations", ("memories", "conv_candidates", "conv_first50"), """
SELECT c.agent_id, c.session_id, 'summary' AS kind, c.message_count AS n,
       CAST(length(string_agg(f.content, chr(10) ORDER BY f.pos)) AS BIGINT) AS chars
FROM conv_candidates c JOIN conv_first50 f USING (agent_id, session_id)
GROUP BY c.agent_id, c.session_id, c.message_count
UNION ALL
SELECT agent_id, NULL, 'summarized', COUNT(*) FILTER (WHERE is_summarized OR id IN (SELECT id FROM conv_first50)), NULL
FROM memories GROUP BY agent_id""")

# ------------------------------------------------------------ conversations
_input("conv_joined", """
SELECT conv_id, COUNT(*) AS message_count, CAST(SUM(length(text)) AS BIGINT) AS conversation_length,
       string_agg(lower(text), ' ' ORDER BY turn) AS content_lower, arg_min(text, turn) AS first_text
FROM classified_conversations GROUP BY conv_id""", ("classified_conversations",))

_input("conv_class", """
SELECT conv_id,
       CASE WHEN content_lower LIKE '%remember%' OR content_lower LIKE '%important%' OR content_lower LIKE '%preference%'
                 OR content_lower LIKE '%like%' OR content_lower LIKE '%dislike%' THEN 'preference'
            WHEN content_lower LIKE '%error%' OR content_lower LIKE '%mistake%' OR content_lower LIKE '%wrong%'
                 OR content_lower LIKE '%failed%' THEN 'error'
            WHEN content_lower LIKE '%learn%' OR content_lower LIKE '%skill%' OR content_lower LIKE '%how to%'
                 OR content_lower LIKE '%tutorial%' THEN 'skill'
            ELSE 'interaction' END AS memory_type
FROM conv_joined""", ("conv_joined",))

oracle("conversation_classify", ("conv_class",), """
SELECT conv_id, memory_type,
       CAST(CASE memory_type WHEN 'preference' THEN 3 WHEN 'skill' THEN 3 ELSE 2 END AS INTEGER) AS importance
FROM conv_class""")

oracle("conversation_stats", ("conv_joined",), """
SELECT conv_id, message_count, conversation_length, content_lower FROM conv_joined""")

oracle("store_conversation", ("conv_joined", "conv_class"), """
SELECT j.conv_id AS thread_id, 'Processed conversation about ' || substr(j.first_text, 1, 100) AS observation,
       c.memory_type, CAST(CASE c.memory_type WHEN 'preference' THEN 3 WHEN 'skill' THEN 3 ELSE 2 END AS INTEGER) AS importance,
       j.message_count, j.conversation_length, 'success' AS status
FROM conv_joined j JOIN conv_class c USING (conv_id)""")

# ------------------------------------------------------------ documents
_input("analysis_results", """
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE '2024-02-29-preview' END AS apiVersion,
       (['prebuilt-layout', 'prebuilt-read', 'prebuilt-invoice'])[CAST(doc_id % 3 AS INTEGER) + 1] AS model_id,
       text AS content, CAST(ceil(n_chars / 3000) AS INTEGER) AS n_pages, CAST(doc_id % 12 AS INTEGER) AS month,
       lang, source, n_chars, CAST(doc_id % 100 AS DOUBLE) / 100 AS confidence
FROM documents""")

oracle("doc_preview", ("analysis_results",), """
SELECT doc_id, replace(substr(content, 1, 400), chr(10), ' ') || CASE WHEN length(content) > 400 THEN '...' ELSE '' END AS preview
FROM analysis_results""")

oracle("doc_summary", ("analysis_results",), """
SELECT doc_id, coalesce(apiVersion, 'unknown') AS api_version, greatest(n_pages, 0) AS n_pages, model_id
FROM analysis_results""")

oracle("doc_cost", ("analysis_results",), """
WITH p AS (SELECT month, model_id, COUNT(*) AS docs, CAST(SUM(greatest(n_pages, 0)) AS BIGINT) AS pages
           FROM analysis_results GROUP BY month, model_id)
SELECT month, model_id, docs, pages,
       ROUND(CASE model_id
         WHEN 'prebuilt-read' THEN CAST(least(pages, 1000000) AS DOUBLE) * CAST(0.0015 AS DOUBLE)
                                   + CAST(greatest(pages - 1000000, 0) AS DOUBLE) * CAST(0.0006 AS DOUBLE)
         WHEN 'prebuilt-layout' THEN CAST(pages AS DOUBLE) * CAST(0.010 AS DOUBLE)
         WHEN 'prebuilt-invoice' THEN CAST(pages AS DOUBLE) * CAST(0.010 AS DOUBLE) END, 6) AS cost
FROM p""")

oracle("doc_reprocess_cache", ("analysis_results",), """
SELECT doc_id, sha256(coalesce(text, '')) AS content_hash FROM documents
WHERE sha256(coalesce(text, '')) NOT IN (SELECT sha256(coalesce(content, '')) FROM analysis_results WHERE doc_id % 4 = 0)""")

oracle("invoice_fields", ("analysis_results",), """
SELECT doc_id, 'lang' AS field_name, lang AS content, confidence FROM analysis_results WHERE model_id = 'prebuilt-invoice'
UNION ALL
SELECT doc_id, 'source', source, confidence FROM analysis_results WHERE model_id = 'prebuilt-invoice'
UNION ALL
SELECT doc_id, 'n_chars', CAST(n_chars AS VARCHAR), confidence FROM analysis_results WHERE model_id = 'prebuilt-invoice'""")

oracle("jsonb_compat", ("analysis_results",), """
SELECT doc_id,
       CAST(to_json(CASE WHEN n_pages > 0 THEN list_transform(range(1, n_pages + 1), lambda x: {'pageNumber': CAST(x AS INTEGER)})
                         ELSE [] END) AS VARCHAR) AS pages,
       CAST(to_json([{'fields': MAP {'lang': {'content': lang, 'confidence': confidence},
                                     'source': {'content': source, 'confidence': confidence},
                                     'n_chars': {'content': CAST(n_chars AS VARCHAR), 'confidence': confidence}}}]) AS VARCHAR) AS documents
FROM analysis_results""")

# ------------------------------------------------------------ endpoint migration
_input("endpoints", """
SELECT c_custkey AS seq, c_name AS name,
       ([NULL, '', 'None', 'null', ' ', '{"x":1}'])[CAST(c_custkey % 6 AS INTEGER) + 1] AS ai_gateway,
       '{"catalog_name":"main","schema_name":"' || lower(c_mktsegment) || '","table_name_prefix":'
         || CASE WHEN c_custkey % 11 = 0 THEN 'null' ELSE '"t' || CAST(c_custkey AS VARCHAR) || '"' END
         || CASE c_custkey % 4 WHEN 0 THEN ',"enabled":false' WHEN 1 THEN ',"enabled":null' ELSE '' END || '}'
         AS auto_capture_config,
       CASE WHEN c_custkey % 9 = 0 THEN '[]' ELSE
         '[{"entity_name":"model_' || CAST(c_custkey AS VARCHAR) || '","entity_version":"' || CAST(c_nationkey AS VARCHAR)
         || '","environment_vars":{"SEGMENT":"' || lower(c_mktsegment)
         || '","DEBUG":null},"workload_size":"Small","scale_to_zero_enabled":true}]' END AS served_entities,
       CASE WHEN c_custkey % 2 = 0 THEN c_name END AS description,
       CASE WHEN c_custkey % 3 = 0 THEN true END AS route_optimized,
       '[{"key":"segment","value":"' || lower(c_mktsegment) || '"}]' AS tags,
       c_custkey % 13 <> 0 AS exists_in_workspace, c_custkey % 7 <> 0 AS table_exists,
       CASE WHEN c_custkey % 17 = 0 THEN 400 ELSE 200 END AS create_status
FROM customer""")

_input("requested_endpoints", """
SELECT c_custkey * 2 AS request_seq, c_name AS endpoint_name FROM customer
UNION ALL
SELECT c_custkey * 2 + 1, 'ghost_' || CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey % 10 = 0""")

_input("ep_rules", """
SELECT e.*,
       (ai_gateway IS NULL OR trim(ai_gateway) IN ('', 'None', 'null')) AS gateway_blank,
       (auto_capture_config IS NULL OR trim(auto_capture_config) IN ('', 'None', 'null')) AS capture_blank,
       json_extract_string(auto_capture_config, '$.catalog_name') AS cat,
       json_extract_string(auto_capture_config, '$.schema_name') AS sch,
       json_extract_string(auto_capture_config, '$.table_name_prefix') AS pre
FROM endpoints e""", ("endpoints",))

_input("ep_steps_wide", """
SELECT r.request_seq, r.endpoint_name, e.seq IS NOT NULL AS config_found, e.seq,
       e.gateway_blank AND e.exists_in_workspace AS del_ok,
       CASE WHEN NOT e.gateway_blank THEN 'Skipped: AI Gateway already configured'
            WHEN NOT e.exists_in_workspace THEN 'Endpoint not found' ELSE 'Endpoint deleted successfully' END AS del_msg,
       CASE WHEN e.capture_blank OR coalesce(e.cat, '') = '' OR coalesce(e.sch, '') = '' OR coalesce(e.pre, '') = ''
            THEN NULL ELSE e.cat || '.' || e.sch || '.' || e.pre || '_payload' END AS table_name,
       NOT (e.capture_blank OR coalesce(e.cat, '') = '' OR coalesce(e.sch, '') = '' OR coalesce(e.pre, '') = '')
         AND e.table_exists AS ren_ok,
       CASE WHEN e.capture_blank THEN 'No inference table configuration found'
            WHEN coalesce(e.cat, '') = '' OR coalesce(e.sch, '') = '' OR coalesce(e.pre, '') = ''
              THEN 'Incomplete inference table configuration'
            WHEN NOT e.table_exists THEN 'Table does not exist' ELSE 'Table renamed successfully' END AS ren_msg,
       json_array_length(e.served_entities) > 0 AND e.create_status = 200 AS cr_ok,
       CASE WHEN json_array_length(e.served_entities) = 0 THEN 'No served entities found'
            WHEN e.create_status = 200 THEN 'Endpoint created successfully' ELSE 'HTTP 400: Bad request' END AS cr_msg
FROM requested_endpoints r LEFT JOIN ep_rules e ON e.name = r.endpoint_name""", ("requested_endpoints", "ep_rules"))

_input("ep_flat", """
SELECT request_seq, endpoint_name,
       CASE WHEN config_found THEN del_ok ELSE false END AS delete_success,
       CASE WHEN config_found THEN del_msg ELSE 'Not processed' END AS delete_message,
       CASE WHEN config_found AND del_ok THEN ren_ok ELSE false END AS rename_success,
       CASE WHEN config_found AND del_ok THEN ren_msg ELSE 'Not processed' END AS rename_message,
       CASE WHEN config_found AND del_ok THEN cr_ok ELSE false END AS create_success,
       CASE WHEN config_found AND del_ok THEN cr_msg ELSE 'Not processed' END AS create_message,
       CASE WHEN config_found AND del_ok AND cr_ok THEN 'SUCCESS' ELSE 'FAILED' END AS overall_status,
       '01-02-2024 11:00' AS date, 'dev' AS env
FROM ep_steps_wide""", ("ep_steps_wide",))

oracle("blank_config", ("ep_rules",), """
SELECT seq, name, gateway_blank, capture_blank FROM ep_rules""")

oracle("endpoint_lookup", ("ep_steps_wide",), """
SELECT request_seq, endpoint_name, config_found, seq FROM ep_steps_wide""")

oracle("inference_table_name", ("ep_rules",), """
SELECT seq,
       CASE WHEN capture_blank OR coalesce(cat, '') = '' OR coalesce(sch, '') = '' OR coalesce(pre, '') = '' THEN NULL
            ELSE cat || '.' || sch || '.' || pre || '_payload' END AS old_table,
       CASE WHEN capture_blank OR coalesce(cat, '') = '' OR coalesce(sch, '') = '' OR coalesce(pre, '') = '' THEN NULL
            ELSE cat || '.' || sch || '.' || pre || '_payload_legacy' END AS new_table,
       CASE WHEN capture_blank THEN 'No inference table configuration found'
            WHEN coalesce(cat, '') = '' OR coalesce(sch, '') = '' OR coalesce(pre, '') = ''
              THEN 'Incomplete inference table configuration' END AS message
FROM ep_rules""")

oracle("endpoint_payload", ("ep_rules",), """
WITH p AS (
  SELECT seq, description, route_optimized, tags, served_entities,
         json_extract(served_entities, '$[0].environment_vars') AS ev,
         to_json({'name': name,
                  'config': {'served_entities': [{
                      'entity_name': json_extract_string(served_entities, '$[0].entity_name'),
                      'entity_version': json_extract_string(served_entities, '$[0].entity_version'),
                      'environment_vars': [ {'key': k, 'value': json_extract_string(json_extract(served_entities, '$[0].environment_vars'), '$."' || k || '"')}
                                            for k in json_keys(json_extract(served_entities, '$[0].environment_vars'))
                                            if json_extract_string(json_extract(served_entities, '$[0].environment_vars'), '$."' || k || '"') IS NOT NULL ],
                      'min_provisioned_throughput': CAST(json_extract_string(served_entities, '$[0].min_provisioned_throughput') AS BIGINT),
                      'max_provisioned_throughput': CAST(json_extract_string(served_entities, '$[0].max_provisioned_throughput') AS BIGINT),
                      'scale_to_zero_enabled': CAST(json_extract_string(served_entities, '$[0].scale_to_zero_enabled') AS BOOLEAN),
                      'workload_size': json_extract_string(served_entities, '$[0].workload_size'),
                      'workload_type': json_extract_string(served_entities, '$[0].workload_type')}]},
                  'ai_gateway': {'inference_table_config': {
                      'catalog_name': cat, 'schema_name': sch, 'table_name_prefix': pre,
                      'enabled': CASE WHEN json_extract(auto_capture_config, '$.enabled') IS NULL THEN true
                                      ELSE CAST(json_extract_string(auto_capture_config, '$.enabled') AS BOOLEAN) END}}})::VARCHAR AS core
  FROM ep_rules)
SELECT seq,
       CASE WHEN json_array_length(served_entities) = 0 THEN 'No served entities found' END AS reject_reason,
       CASE WHEN json_array_length(served_entities) > 0 THEN
         substr(core, 1, length(core) - 1)
         || CASE WHEN trim(description) <> '' THEN ',"description":' || to_json(description)::VARCHAR ELSE '' END
         || CASE WHEN route_optimized IS NOT NULL THEN ',"route_optimized":' || CAST(route_optimized AS VARCHAR) ELSE '' END
         || CASE WHEN json_array_length(tags) > 0 THEN ',"tags":' || tags ELSE '' END
         || '}' END AS payload
FROM p""")

oracle("migration_steps", ("ep_steps_wide",), """
SELECT request_seq, endpoint_name, 1 AS step_no, 'delete' AS step, del_ok AS success, del_msg AS message,
       CAST(NULL AS VARCHAR) AS table_name
FROM ep_steps_wide WHERE config_found
UNION ALL
SELECT request_seq, endpoint_name, 2, 'rename', ren_ok, ren_msg, table_name FROM ep_steps_wide WHERE config_found AND del_ok
UNION ALL
SELECT request_seq, endpoint_name, 3, 'create', cr_ok, cr_msg, NULL FROM ep_steps_wide WHERE config_found AND del_ok""")

oracle("migration_status", ("ep_flat",), "SELECT request_seq, endpoint_name, overall_status FROM ep_flat")
oracle("migration_flatten", ("ep_flat",), "SELECT * FROM ep_flat")

oracle("migration_report", ("ep_flat",), """
SELECT COUNT(*) AS total_endpoints, COUNT(*) FILTER (WHERE overall_status = 'SUCCESS') AS successful_migrations,
       COUNT(*) - COUNT(*) FILTER (WHERE overall_status = 'SUCCESS') AS failed_migrations
FROM ep_flat""")

oracle("migration_run", ("ep_flat",), """
SELECT COUNT(*) AS total_endpoints, COUNT(*) FILTER (WHERE overall_status = 'SUCCESS') AS successful_migrations,
       COUNT(*) - COUNT(*) FILTER (WHERE overall_status = 'SUCCESS') AS failed_migrations,
       'dev' AS env, MAX(date) AS date
FROM ep_flat""")

# ------------------------------------------------------------ table migration
_input("migration_configs", """
SELECT s_suppkey AS config_id,
       CASE WHEN s_suppkey % 5 = 1 THEN NULL ELSE 'main.legacy.ot_' || CAST(s_suppkey AS VARCHAR) END AS legacy_online_table,
       CASE WHEN s_suppkey % 5 = 4 THEN '' ELSE 'store_' || CAST(s_suppkey AS VARCHAR) END AS online_store_name,
       CASE WHEN s_suppkey % 5 = 2 THEN 'main.t_' || CAST(s_suppkey AS VARCHAR)
            ELSE 'main.features.t_' || CAST(s_suppkey AS VARCHAR) END AS target_table,
       CASE WHEN s_suppkey % 5 = 3 THEN 'CU_3' WHEN s_suppkey % 2 = 0 THEN NULL ELSE 'CU_4' END AS capacity
FROM supplier""")

oracle("migration_config_check", ("migration_configs",), """
SELECT config_id, capacity, error, error IS NULL AS is_valid FROM (
  SELECT config_id, coalesce(capacity, 'CU_2') AS capacity,
         CASE WHEN coalesce(legacy_online_table, '') = '' THEN 'Missing required configuration field: legacy_online_table'
              WHEN coalesce(online_store_name, '') = '' THEN 'Missing required configuration field: online_store_name'
              WHEN coalesce(target_table, '') = '' THEN 'Missing required configuration field: target_table'
              WHEN len(string_split(legacy_online_table, '.')) <> 3 THEN 'legacy_online_table must be in format: catalog.schema.table'
              WHEN len(string_split(target_table, '.')) <> 3 THEN 'target_table must be in format: catalog.schema.table'
              WHEN coalesce(capacity, 'CU_2') NOT IN ('CU_1', 'CU_2', 'CU_4', 'CU_8')
                THEN 'Invalid capacity: ' || coalesce(capacity, 'CU_2') || '. Must be one of: [''CU_1'', ''CU_2'', ''CU_4'', ''CU_8'']'
         END AS error
  FROM migration_configs)""")

_input("catalog_dependencies", """
SELECT 'endpoint' AS kind, s_suppkey AS id, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_name END AS name,
       CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'READY' END AS state FROM supplier
UNION ALL
SELECT 'job', p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_name END,
       CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'ACTIVE' END FROM part""")

_input("dep_inventory", """
SELECT kind, id, name, coalesce(state, 'unknown') AS state FROM catalog_dependencies
WHERE name IS NOT NULL AND name <> ''""", ("catalog_dependencies",))

oracle("dependency_inventory", ("dep_inventory",), "SELECT * FROM dep_inventory")
oracle("dependency_summary", ("dep_inventory",), "SELECT kind, COUNT(*) AS count FROM dep_inventory GROUP BY kind")
oracle("dependency_report", ("dep_inventory",), """
SELECT kind, id, name, greatest((SELECT COUNT(*) FROM dep_inventory WHERE kind = 'job') - 10, 0) AS more
FROM dep_inventory WHERE kind = 'job' ORDER BY id LIMIT 10""")

_input("orders_old", "SELECT * FROM orders WHERE o_orderkey % 19 <> 0")
_input("orders_new", """
SELECT * REPLACE (CASE WHEN o_orderkey % 13 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice)
FROM orders WHERE o_orderkey % 17 <> 0""")
_input("orders_merged", """
SELECT * FROM orders_old WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders_new)
UNION ALL SELECT * FROM orders_new""", ("orders_old", "orders_new"))

oracle("row_count", ("orders_old", "orders_new"), """
SELECT table_name, row_count, format('{:,}', row_count) AS row_count_text, column_count FROM (
  SELECT 'orders_old' AS table_name, COUNT(*) AS row_count, 6 AS column_count FROM orders_old
  UNION ALL SELECT 'orders_new', COUNT(*), 6 FROM orders_new)""")

oracle("row_drift", ("orders_old", "orders_new"), """
SELECT (SELECT COUNT(*) FROM orders_old) AS rows_before, (SELECT COUNT(*) FROM orders_new) AS rows_after,
       (SELECT COUNT(*) FROM orders_old) <> (SELECT COUNT(*) FROM orders_new) AS changed""")

_ORDER_VALS = "o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"
oracle("change_feed", ("orders_old", "orders_new"), f"""
SELECT o_orderkey, {_ORDER_VALS}, 'insert' AS _change_type FROM orders_new
WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders_old)
UNION ALL
SELECT o_orderkey, {_ORDER_VALS}, 'delete' FROM orders_old WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders_new)
UNION ALL
SELECT o.o_orderkey, o.o_custkey, o.o_orderstatus, o.o_totalprice, o.o_orderdate, o.o_orderpriority, 'update_preimage'
FROM orders_old o JOIN orders_new n ON o.o_orderkey = n.o_orderkey
WHERE ROW(o.o_custkey, o.o_orderstatus, o.o_totalprice, o.o_orderdate, o.o_orderpriority)
      IS DISTINCT FROM ROW(n.o_custkey, n.o_orderstatus, n.o_totalprice, n.o_orderdate, n.o_orderpriority)
UNION ALL
SELECT n.o_orderkey, n.o_custkey, n.o_orderstatus, n.o_totalprice, n.o_orderdate, n.o_orderpriority, 'update_postimage'
FROM orders_old o JOIN orders_new n ON o.o_orderkey = n.o_orderkey
WHERE ROW(o.o_custkey, o.o_orderstatus, o.o_totalprice, o.o_orderdate, o.o_orderpriority)
      IS DISTINCT FROM ROW(n.o_custkey, n.o_orderstatus, n.o_totalprice, n.o_orderdate, n.o_orderpriority)""")

oracle("publish_merge", ("orders_merged",), "SELECT * FROM orders_merged")

oracle("publish_newest", (), """
WITH changes AS (
  SELECT o.* REPLACE (o_totalprice + v AS o_totalprice), v AS change_seq
  FROM orders o, unnest(range(0, o_orderkey % 3 + 1)) AS u(v) WHERE o_orderkey % 17 <> 0),
everything AS (SELECT * FROM changes UNION ALL SELECT *, 1 FROM orders WHERE o_orderkey % 19 <> 0)
SELECT * FROM everything
QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY change_seq DESC, o_totalprice DESC) = 1""")

oracle("legacy_vs_new", ("orders_old", "orders_new"), """
SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey,
       CASE WHEN n.o_orderkey IS NULL THEN 'missing' WHEN o.o_orderkey IS NULL THEN 'extra' ELSE 'changed' END AS status
FROM orders_old o FULL OUTER JOIN orders_new n ON o.o_orderkey = n.o_orderkey
WHERE n.o_orderkey IS NULL OR o.o_orderkey IS NULL
   OR ROW(o.o_custkey, o.o_orderstatus, o.o_totalprice, o.o_orderdate, o.o_orderpriority)
      IS DISTINCT FROM ROW(n.o_custkey, n.o_orderstatus, n.o_totalprice, n.o_orderdate, n.o_orderpriority)""")


def _order_checksum(tbl: str) -> str:
    texts = ("CAST(o_orderkey AS VARCHAR)", "CAST(o_custkey AS VARCHAR)", "o_orderstatus",
             "CAST(CAST(o_totalprice AS DECIMAL(38,6)) AS VARCHAR)",
             "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f')", "o_orderpriority")
    fields = ", ".join(f"coalesce(CAST(length({x}) AS VARCHAR) || ':' || {x}, 'null')" for x in texts)
    canon = f"concat_ws('|', {fields})"
    return (f"SELECT COUNT(*) AS row_count, CAST(SUM(CAST(('0x' || substr(md5({canon}), 1, 15)) AS BIGINT)) AS VARCHAR) "
            f"AS checksum FROM {tbl}")


oracle("table_checksum", ("orders_old", "orders_new"), f"""
SELECT 'orders_old' AS table_name, * FROM ({_order_checksum('orders_old')})
UNION ALL SELECT 'orders_new', * FROM ({_order_checksum('orders_new')})""")

oracle("primary_key_check", (), """
WITH l AS (SELECT l_orderkey, l_linenumber, COUNT(*) AS n FROM lineitem
           WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL GROUP BY 1, 2 HAVING COUNT(*) > 1),
o AS (SELECT o_orderkey, COUNT(*) AS n FROM orders WHERE o_orderkey IS NOT NULL GROUP BY 1 HAVING COUNT(*) > 1)
SELECT 'lineitem' AS table_name,
       (SELECT COUNT(*) FROM lineitem WHERE l_orderkey IS NULL OR l_linenumber IS NULL) AS null_keys,
       (SELECT COUNT(*) FROM l) AS duplicate_keys, (SELECT CAST(coalesce(SUM(n), 0) AS BIGINT) FROM l) AS duplicate_rows,
       (SELECT COUNT(*) FROM lineitem WHERE l_orderkey IS NULL OR l_linenumber IS NULL) = 0 AND (SELECT COUNT(*) FROM l) = 0 AS is_valid
UNION ALL
SELECT 'orders', (SELECT COUNT(*) FROM orders WHERE o_orderkey IS NULL), (SELECT COUNT(*) FROM o),
       (SELECT CAST(coalesce(SUM(n), 0) AS BIGINT) FROM o),
       (SELECT COUNT(*) FROM orders WHERE o_orderkey IS NULL) = 0 AND (SELECT COUNT(*) FROM o) = 0""")

oracle("table_migration_check", ("orders_old", "orders_merged"), f"""
WITH b AS ({_order_checksum('orders_old')}), m AS ({_order_checksum('orders_merged')})
SELECT 'orders_old' AS table_name, b.row_count, 6 AS column_count,
       'o_orderkey: bigint, o_custkey: bigint, o_orderstatus: string, o_totalprice: double, o_orderdate: timestamp_ntz' AS preview,
       1 AS more_columns, 'Table is not a Delta table. Migration may have limitations.' AS warning,
       CAST(NULL AS VARCHAR) AS error, 'team' AS steward, 'parquet' AS provider, b.row_count AS rows_before, b.row_count AS rows_after,
       false AS row_count_changed, m.row_count AS target_rows, m.checksum AS target_checksum, 'ok' AS verdict
FROM b, m""")

oracle("name_rows", (), """
WITH l AS (
  SELECT s_suppkey AS list_id, CASE s_suppkey % 6
           WHEN 0 THEN '["ep_' || CAST(s_suppkey AS VARCHAR) || '", "ep_' || CAST(s_suppkey + 1 AS VARCHAR) || '", null]'
           WHEN 1 THEN '[]' WHEN 2 THEN '{"name": "x"}' WHEN 3 THEN '[broken' WHEN 4 THEN '"x"' END AS value FROM supplier),
e AS (SELECT list_id, value, CASE WHEN value IS NULL OR NOT json_valid(value) THEN 'Invalid JSON format'
                                  WHEN json_type(value) <> 'ARRAY' THEN 'Input must be a JSON list'
                                  WHEN json_array_length(value) = 0 THEN 'Endpoint list is empty' END AS error FROM l)
SELECT list_id, CAST(NULL AS INTEGER) AS position, CAST(NULL AS VARCHAR) AS name, error FROM e WHERE error IS NOT NULL
UNION ALL
SELECT list_id, CAST(p AS INTEGER), json_extract_string(value, '$[' || CAST(p AS VARCHAR) || ']'), NULL
FROM (SELECT list_id, value, unnest(range(0, CAST(json_array_length(value) AS BIGINT))) AS p FROM e WHERE error IS NULL)""")

oracle("config_missing_keys", ("migration_configs",), """
SELECT config_id, concat_ws(',', CASE WHEN coalesce(legacy_online_table, '') = '' THEN 'legacy_online_table' END,
                            CASE WHEN coalesce(online_store_name, '') = '' THEN 'online_store_name' END,
                            CASE WHEN coalesce(target_table, '') = '' THEN 'target_table' END) AS missing_keys
FROM migration_configs""")

oracle("provider_warnings", (), """
SELECT p_partkey AS table_id, CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 4 >= 2
                              THEN 'Table is not a Delta table. Migration may have limitations.' END AS warning FROM part""")

oracle("row_map", (), """
SELECT c_custkey, 'c_custkey,c_mktsegment,c_name,c_nationkey' AS keys, 4 AS n_keys,
       CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS segment, CAST(c_nationkey AS VARCHAR) AS nation FROM customer""")

oracle("property_map", (), """
WITH e AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'no json' WHEN 1 THEN '[1]' WHEN 2 THEN NULL ELSE props END AS text FROM events),
m AS (SELECT event_id, CASE WHEN json_valid(text) AND json_type(text) = 'OBJECT' THEN text END AS obj FROM e)
SELECT event_id, coalesce(array_to_string(list_sort(json_keys(obj)), ','), '') AS keys,
       CASE WHEN obj IS NULL THEN 'none' ELSE json_extract_string(obj, '$.k') END AS k FROM m""")

_input("dependency_edges", """
SELECT p_partkey AS node, CASE WHEN p_partkey > 0 THEN CAST(floor(p_partkey / 2) AS BIGINT) END AS upstream FROM part""")

oracle("migration_order", ("dependency_edges",), """
WITH RECURSIVE nodes AS (
  SELECT node AS n FROM dependency_edges UNION SELECT upstream FROM dependency_edges WHERE upstream IS NOT NULL),
lv(n, level) AS (
  SELECT n, 0 FROM nodes
  UNION ALL
  SELECT e.node, lv.level + 1 FROM dependency_edges e JOIN lv ON e.upstream = lv.n)
SELECT n AS node, MAX(level) AS level FROM lv GROUP BY n""")

oracle("memory_changes", ("memories", "memory_change_batch"), """
SELECT id, importance, memory_type FROM memories WHERE id NOT IN (SELECT id FROM memory_change_batch)
UNION ALL
SELECT id, importance, memory_type FROM memory_change_batch WHERE action = 'update' AND id IN (SELECT id FROM memories)
UNION ALL
SELECT id, importance, memory_type FROM memory_change_batch WHERE action = 'create' AND id NOT IN (SELECT id FROM memories)""")

# ------------------------------------------------------------ checkpoints and store
_input("checkpoints_in", """
SELECT 'thread_' || CAST(conv_id AS VARCHAR) AS thread_id, '' AS checkpoint_ns,
       lpad(CAST(turn AS VARCHAR), 6, '0') AS checkpoint_id,
       CASE WHEN turn > 0 THEN lpad(CAST(turn - 1 AS VARCHAR), 6, '0') END AS parent_checkpoint_id,
       CASE WHEN role = 'user' THEN 'input' ELSE 'loop' END AS source, turn - 1 AS step,
       TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(conv_id AS BIGINT)) + to_seconds(CAST(turn * (conv_id % 5 + 7) AS BIGINT)) AS ts
FROM conversations""")

_input("checkpoint_writes", """
SELECT 'thread_' || CAST(conv_id AS VARCHAR) AS thread_id, '' AS checkpoint_ns,
       lpad(CAST(turn AS VARCHAR), 6, '0') AS checkpoint_id,
       'task_' || CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) AS task_id, CAST(idx AS INTEGER) AS idx,
       (['messages', 'branch:to:agent', '__start__'])[CAST(idx AS INTEGER) + 1] AS channel,
       lpad(CAST(turn AS VARCHAR), 8, '0') || '.' || CAST(idx AS VARCHAR) AS version
FROM (SELECT conv_id, turn, unnest(range(0, CAST(turn % 3 AS BIGINT) + 1)) AS idx FROM conversations)""")

oracle("checkpoint_parent", ("checkpoints_in",), """
SELECT c.thread_id, c.checkpoint_ns, c.checkpoint_id, c.parent_checkpoint_id, c.step, p.step AS parent_step, c.source,
       ROUND((epoch_us(c.ts) - epoch_us(p.ts)) / 1000000.0, 6) AS gap_seconds
FROM checkpoints_in c LEFT JOIN checkpoints_in p
  ON p.thread_id = c.thread_id AND p.checkpoint_ns = c.checkpoint_ns AND p.checkpoint_id = c.parent_checkpoint_id""")

oracle("step_gap", ("checkpoints_in",), """
SELECT thread_id, step, ROUND((epoch_us(ts) - epoch_us(prev_ts)) / 1000000.0, 6) AS gap_seconds FROM (
  SELECT thread_id, step, ts, lag(ts) OVER (PARTITION BY thread_id, checkpoint_ns ORDER BY step) AS prev_ts
  FROM checkpoints_in) WHERE prev_ts IS NOT NULL""")

oracle("latest_checkpoint", ("checkpoints_in",), """
SELECT thread_id, checkpoint_ns, checkpoint_id, step, ts FROM (
  SELECT *, row_number() OVER (PARTITION BY thread_id, checkpoint_ns ORDER BY checkpoint_id DESC) AS rn
  FROM checkpoints_in) WHERE rn = 1""")

oracle("checkpoint_writes_join", ("checkpoints_in", "checkpoint_writes"), """
SELECT c.thread_id, c.checkpoint_ns, c.checkpoint_id, c.step, c.source, w.task_id, w.idx, w.channel
FROM checkpoints_in c JOIN checkpoint_writes w
  ON w.thread_id = c.thread_id AND w.checkpoint_ns = c.checkpoint_ns AND w.checkpoint_id = c.checkpoint_id""")

oracle("thread_activity", ("checkpoints_in",), """
SELECT thread_id, COUNT(*) AS checkpoints, MIN(step) AS min_step, MAX(step) AS max_step, MIN(ts) AS first_ts,
       MAX(ts) AS last_ts, COUNT(*) FILTER (WHERE source = 'input') AS input_steps,
       COUNT(*) FILTER (WHERE source = 'loop') AS loop_steps,
       ROUND((epoch_us(MAX(ts)) - epoch_us(MIN(ts))) / 1000000.0, 6) AS duration_seconds
FROM checkpoints_in GROUP BY thread_id""")

oracle("channel_activity", ("checkpoint_writes",), """
SELECT thread_id, channel, COUNT(*) AS writes, COUNT(DISTINCT version) AS blobs, MAX(version) AS latest_version
FROM checkpoint_writes GROUP BY thread_id, channel""")

_input("store_entries", """
SELECT CASE WHEN event_id % 3 = 0 THEN 'profiles.' ELSE 'episodes.' END || CAST(user_id AS VARCHAR) AS prefix,
       CAST(event_id AS VARCHAR) AS key, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type AS kind,
       ts AS created_at, CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST((event_id % 1440) * 60 AS INTEGER) END AS ttl_minutes
FROM events""")

oracle("store_prefix_scan", ("store_entries",), """
SELECT prefix, COUNT(*) AS entries FROM store_entries WHERE starts_with(prefix, 'episodes.') GROUP BY prefix""")

oracle("store_ttl", ("store_entries",), f"""
SELECT prefix, key, expires_at FROM (
  SELECT prefix, key, CASE WHEN ttl_minutes IS NOT NULL THEN created_at + to_minutes(CAST(ttl_minutes AS BIGINT)) END AS expires_at
  FROM store_entries) WHERE expires_at IS NULL OR expires_at > {AS_OF}""")

oracle("store_values", ("store_entries",), """
SELECT prefix, key, k, kind, true AS note_is_null FROM store_entries""")

# ------------------------------------------------------------ observability
_input("agent_messages", """
SELECT event_id AS message_id, event_id AS orchestration_id,
       'agent_' || CAST(user_id % 7 AS VARCHAR) AS sender_agent_id,
       'agent_' || CAST((user_id + event_id) % 7 AS VARCHAR) AS receiver_agent_id,
       event_type AS message_type, ts AS sent_at,
       CASE WHEN event_id % 3 <> 0 THEN event_id % 500 END AS latency_ms,
       CASE WHEN event_id % 50 <> 0 THEN ts + to_milliseconds(CAST(event_id % 500 AS BIGINT)) END AS delivered_at,
       CAST(length(props) AS BIGINT) AS payload_bytes
FROM events""")

oracle("message_latency", ("agent_messages",), """
SELECT sender_agent_id, receiver_agent_id, message_type, COUNT(*) AS messages,
       ROUND(AVG(coalesce(CAST(latency_ms AS DOUBLE), (epoch_us(delivered_at) - epoch_us(sent_at)) / 1000.0)), 6) AS avg_latency_ms,
       ROUND(MAX(coalesce(CAST(latency_ms AS DOUBLE), (epoch_us(delivered_at) - epoch_us(sent_at)) / 1000.0)), 6) AS max_latency_ms,
       CAST(SUM(payload_bytes) AS BIGINT) AS total_bytes, COUNT(*) FILTER (WHERE delivered_at IS NULL) AS undelivered
FROM agent_messages GROUP BY 1, 2, 3""")

_input("agent_metrics", """
SELECT 'agent_' || CAST(l_suppkey AS VARCHAR) AS agent_id, l_orderkey AS orchestration_id,
       l_discount * 1000 AS cpu_ms, CAST(l_quantity AS BIGINT) AS tokens_in, CAST(l_linenumber * 10 AS BIGINT) AS tokens_out,
       CAST(l_extendedprice / 1000 AS DECIMAL(18, 6)) AS cost_usd, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS error_count
FROM lineitem""")

oracle("orchestration_cost", ("agent_metrics",), """
SELECT agent_id, ROUND(SUM(cpu_ms), 6) AS cpu_ms, CAST(SUM(tokens_in) AS BIGINT) AS tokens_in,
       CAST(SUM(tokens_out) AS BIGINT) AS tokens_out, ROUND(CAST(SUM(cost_usd) AS DOUBLE), 6) AS cost_usd,
       CAST(SUM(error_count) AS BIGINT) AS errors
FROM agent_metrics GROUP BY agent_id""")

oracle("memory_access_audit", (), """
SELECT CASE event_type WHEN 'click' THEN 'read' WHEN 'view' THEN 'read' WHEN 'purchase' THEN 'write'
                       WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' END AS access_type,
       COUNT(*) AS accesses, CAST(SUM(event_id % 50) AS BIGINT) AS lock_wait_ms, ROUND(AVG(value), 6) AS avg_duration_ms,
       COUNT(*) FILTER (WHERE event_id % 9 = 0) AS conflicts
FROM events GROUP BY 1""")

oracle("coordination_events", (), """
SELECT CASE event_type WHEN 'click' THEN 'consensus' WHEN 'view' THEN 'handoff' WHEN 'purchase' THEN 'vote'
                       WHEN 'signup' THEN 'election' WHEN 'error' THEN 'conflict' END AS event_type,
       COUNT(*) AS events, ROUND(AVG(CASE WHEN event_id % 4 <> 0 THEN 1.0 ELSE 0.0 END), 6) AS success_rate,
       ROUND(AVG(value), 6) AS avg_latency_ms, MAX(CAST(event_id % 100 AS DOUBLE) / 100) AS max_anomaly_score
FROM events GROUP BY 1""")

oracle("orchestration_join", ("agent_metrics", "agent_messages"), """
WITH n AS (SELECT l_orderkey AS orchestration_id, COUNT(*) AS nodes FROM lineitem GROUP BY 1),
m AS (SELECT orchestration_id, CAST(SUM(tokens_in) AS BIGINT) AS tokens_in, SUM(cost_usd) AS cost_usd FROM agent_metrics GROUP BY 1),
g AS (SELECT orchestration_id, COUNT(*) AS messages FROM agent_messages GROUP BY 1),
c AS (SELECT event_id AS orchestration_id, COUNT(*) AS coordination_events, COUNT(*) FILTER (WHERE event_id % 4 = 0) AS failed_events,
             MAX(CAST(event_id % 100 AS DOUBLE) / 100) AS max_anomaly_score FROM events GROUP BY 1)
SELECT o.o_orderkey AS orchestration_id, o.o_orderstatus AS status, o.o_orderpriority AS workflow_id,
       coalesce(n.nodes, 0) AS nodes, coalesce(m.tokens_in, 0) AS tokens_in, ROUND(CAST(m.cost_usd AS DOUBLE), 6) AS cost_usd,
       coalesce(g.messages, 0) AS messages, coalesce(c.coordination_events, 0) AS coordination_events,
       coalesce(c.failed_events, 0) AS failed_events, c.max_anomaly_score,
       'c' || CAST(o.o_orderkey AS VARCHAR) AS correlation_id, 't' || CAST(o.o_orderkey AS VARCHAR) AS root_trace_id
FROM orders o LEFT JOIN n ON n.orchestration_id = o.o_orderkey LEFT JOIN m ON m.orchestration_id = o.o_orderkey
LEFT JOIN g ON g.orchestration_id = o.o_orderkey LEFT JOIN c ON c.orchestration_id = o.o_orderkey""")

# what the three maps of an order reach: lines below each root and how far down they are
_input("trace_reach", """
SELECT m.letter || CAST(o_orderkey AS VARCHAR) AS correlation_id, 't' || CAST(o_orderkey AS VARCHAR) || m.root AS root_trace_id,
       't' || CAST(o_orderkey AS VARCHAR) || m.trace AS trace_id, CAST(m.depth AS BIGINT) AS depth
FROM orders, (VALUES ('c', '', '', 0), ('c', '', '_1', 1), ('c', '', '_2', 1), ('c', '', '_3', 1), ('c', '', '_4', 2),
  ('c', '', '_5', 2), ('c', '', '_6', 3), ('c', '', '_7', 3), ('d', '_3', '_3', 0), ('d', '_3', '_4', 1), ('d', '_3', '_5', 1),
  ('d', '_3', '_6', 2), ('d', '_3', '_7', 2), ('e', '_5', '_5', 0), ('e', '_5', '_6', 1), ('e', '_5', '_7', 1))
  AS m(letter, root, trace, depth)""")

oracle("trace_closure", ("trace_reach",), "SELECT root_trace_id, trace_id, depth FROM trace_reach")

oracle("trace_stitch", ("trace_reach",), """
WITH records AS (
  SELECT 't' || CAST(l_orderkey AS VARCHAR) AS trace_id, 'node' AS kind, CAST(l_linenumber AS DOUBLE) AS value FROM lineitem
  UNION ALL SELECT 't' || CAST(l_orderkey AS VARCHAR) || '_' || CAST(l_linenumber AS VARCHAR), 'span', l_quantity FROM lineitem
  UNION ALL SELECT 't' || CAST(event_id AS VARCHAR), 'message', length(props) FROM events
  UNION ALL SELECT 't' || CAST(event_id AS VARCHAR) || '_' || CAST(event_id % 7 + 1 AS VARCHAR), 'event',
                   CAST(event_id % 100 AS DOUBLE) / 100 FROM events)
SELECT correlation_id, root_trace_id, kind, COUNT(*) AS records, ROUND(SUM(value), 6) AS value, MAX(depth) AS max_depth
FROM trace_reach JOIN records USING (trace_id) GROUP BY ALL""")

oracle("point_in_time", (), """
WITH l AS (SELECT event_id AS label_id, user_id, ts AS label_ts FROM events WHERE event_type = 'purchase'),
f AS (SELECT user_id, ts AS feature_ts, value AS feature_value, event_id AS feature_id FROM events WHERE event_type = 'view')
SELECT label_id, user_id, label_ts, feature_ts, feature_value, feature_id FROM (
  SELECT l.*, f.feature_ts, f.feature_value, f.feature_id,
         row_number() OVER (PARTITION BY l.label_id ORDER BY f.feature_ts DESC NULLS LAST, f.feature_id DESC NULLS LAST) AS rn
  FROM l LEFT JOIN f ON f.user_id = l.user_id AND f.feature_ts <= l.label_ts) WHERE rn = 1""")

# ------------------------------------------------------------ streaming (stream result = batch result)
oracle("stream_messages", ("classified_conversations",), """
SELECT conv_id, COUNT(*) AS message_count, CAST(SUM(length(text)) AS BIGINT) AS conversation_length
FROM classified_conversations GROUP BY conv_id""")

# orders after their newest change: arrival order plays no part
_SYNCED = """
WITH changes AS (
  SELECT o.* REPLACE (o_totalprice + v AS o_totalprice), v, o_orderkey % 23 = 0 AND v = 1 AS gone
  FROM orders o, unnest(range(0, o_orderkey % 3 + 1)) AS u(v) WHERE o_orderkey % 17 <> 0),
everything AS (
  SELECT * FROM changes
  UNION ALL SELECT *, -1, false FROM orders WHERE o_orderkey % 19 <> 0)
SELECT * EXCLUDE (v, gone) FROM everything
QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY v DESC) = 1 AND NOT gone"""
for _k in ("sync_triggered", "sync_continuous", "sync_snapshot"):
    oracle(_k, (), _SYNCED)

oracle("maintenance_gate", ("experiences",), f"""
SELECT thread_id, COUNT(*) AS memory_count,
       ROUND((epoch_us({AS_OF}) - epoch_us(MAX(created_at))) / 1000000.0, 6) AS seconds_since,
       (epoch_us({AS_OF}) - epoch_us(MAX(created_at))) / 1000000.0 > 3600 OR COUNT(*) > 45 AS run_maintenance
FROM experiences GROUP BY thread_id""")

# stream TTL: alive once the watermark (latest event time, millisecond precision) has passed
oracle("store_ttl_stream", ("store_entries",), """
WITH e AS (
  SELECT prefix, key,
         CASE WHEN ttl_minutes IS NOT NULL THEN
           make_timestamp((epoch_us(created_at) // 1000) * 1000 + CAST(ttl_minutes AS BIGINT) * 60000000) END AS expires_at
  FROM store_entries),
wm AS (SELECT make_timestamp((epoch_us(MAX(ts)) // 1000) * 1000) AS w FROM events)
SELECT prefix, key, expires_at FROM e, wm WHERE expires_at IS NULL OR expires_at > wm.w""")
