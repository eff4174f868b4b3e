"""SQL that says what each query must return, written for DuckDB over the same tables.

Shared pieces are common table expressions; each query takes the ones it needs.
"""

from __future__ import annotations

from promptscore.functions.text import WHITE_SPACE_POINTS

_WS = " || ".join(f"chr({p})" for p in WHITE_SPACE_POINTS)


def _uuid(digest: str) -> str:
    return f"regexp_replace({digest}, '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')"


def _stable(*parts: str) -> str:
    return _uuid("md5(" + " || chr(31) || ".join(f"CAST({p} AS VARCHAR)" for p in parts) + ")")


# name -> (needed names, SQL)
_PARTS: dict[str, tuple[list[str], str]] = {
    "rows_in": (
        [],
        f"""SELECT source || '/' || lang AS batch_id, doc_id AS seq,
            trim(CASE WHEN doc_id % 97 = 0 THEN '  ' || chr(10)
                      WHEN doc_id % 7 = 0 THEN '  ' || chr(9) || text || chr(12288) || chr(10)
                      ELSE text END, {_WS}) AS prompt_text
            FROM documents""",
    ),
    "checked": (
        ["rows_in"],
        """SELECT *, CASE WHEN prompt_text = '' THEN 'empty_prompt'
                          WHEN strlen(prompt_text) > 8192 THEN 'prompt_too_long' END AS error_code FROM rows_in""",
    ),
    "small_verdicts": (
        ["checked"],
        """SELECT batch_id, count(*) AS total_count,
             CASE WHEN count(*) > 30 THEN 'batch_too_large'
                  ELSE arg_min(error_code, seq) FILTER (error_code IS NOT NULL) END AS error_code,
             CASE WHEN count(*) <= 30 THEN min(seq) FILTER (error_code IS NOT NULL) END AS error_seq
           FROM checked GROUP BY batch_id""",
    ),
    "blocks": (
        ["checked"],
        "SELECT batch_id || '/' || (seq // 1000) AS batch_id, seq, prompt_text, error_code FROM checked",
    ),
    "accepted": (
        ["blocks"],
        """SELECT batch_id, row_number() OVER (PARTITION BY batch_id ORDER BY seq) - 1 AS seq, prompt_text,
             count(*) OVER (PARTITION BY batch_id) AS total_count
           FROM blocks WHERE batch_id NOT IN (SELECT batch_id FROM blocks WHERE error_code IS NOT NULL)
             AND batch_id NOT IN (SELECT batch_id FROM blocks GROUP BY batch_id HAVING count(*) > 10000)""",
    ),
    "queue": (
        ["accepted"],
        f"""SELECT {_stable("batch_id", "seq")} AS prompt_id, batch_id, seq, prompt_text, 'pending' AS status,
              CAST(0 AS BIGINT) AS attempts, CAST(5 AS INTEGER) AS max_attempts,
              TIMESTAMP '2024-01-20 00:00:00' AS next_retry_at, TIMESTAMP '2024-01-20 00:00:00' AS created_at
            FROM accepted""",
    ),
    "bodies": (
        [],
        """SELECT 'e' || event_id AS request_id, ts AS received_at,
             CASE event_type
               WHEN 'view' THEN props
               WHEN 'signup' THEN '["sign up ' || event_id || '", " \\t' || user_id || '\\n"]'
               WHEN 'error' THEN '["error ' || event_id || '", null]'
               WHEN 'click' THEN '["click", ' || CAST(value AS VARCHAR) || ']'
               ELSE CASE event_id % 4 WHEN 0 THEN '[]' WHEN 1 THEN ' null'
                      WHEN 2 THEN '["cut off ' || event_id ELSE '["trailing ' || event_id || '"] and more' END
             END AS body FROM events
           UNION ALL
           SELECT 'd-' || (doc_id // 25) || '-' || lang, TIMESTAMP '2024-01-01 00:00:00',
             CAST(to_json(list(text ORDER BY doc_id)) AS VARCHAR)
           FROM documents GROUP BY doc_id // 25, lang""",
    ),
    # text after a complete array is ignored, so it is cut off before parsing
    "typed": (
        ["bodies"],
        """SELECT request_id, received_at, body, strlen(body) > 40000 AS too_large,
             CASE WHEN json_valid(body) THEN body
                  WHEN json_valid(regexp_extract(body, '^([^\\]]*\\])', 1)) THEN regexp_extract(body, '^([^\\]]*\\])', 1)
             END AS doc FROM bodies""",
    ),
    "listed": (
        ["typed"],
        f"""SELECT request_id, received_at, too_large,
             CASE WHEN too_large OR doc IS NULL THEN NULL
                  WHEN json_type(doc) = 'NULL' THEN []
                  WHEN json_type(doc) <> 'ARRAY' THEN NULL
                  WHEN len(list_filter(CAST(CAST(doc AS JSON) AS JSON[]), lambda x: coalesce(json_type(x), 'NULL') NOT IN ('VARCHAR', 'NULL'))) > 0 THEN NULL
                  ELSE list_transform(CAST(CAST(doc AS JSON) AS VARCHAR[]), lambda x: trim(coalesce(x, ''), {_WS})) END AS prompts
           FROM typed""",
    ),
    "coded": (
        ["listed"],
        """SELECT *, list_transform(prompts, lambda p: CASE WHEN p = '' THEN 'empty_prompt'
                 WHEN strlen(p) > 8192 THEN 'prompt_too_long' ELSE 'ok' END) AS codes FROM listed""",
    ),
    "judged": (
        ["coded"],
        """SELECT *, CASE WHEN too_large THEN 'body_too_large' WHEN prompts IS NULL THEN 'not_an_array'
             WHEN len(prompts) = 0 THEN 'empty_batch' WHEN len(prompts) > 12 THEN 'batch_too_large'
             ELSE list_filter(codes, lambda c: c <> 'ok')[1] END AS error_code FROM coded""",
    ),
    "messages": (
        [],
        """SELECT * FROM (VALUES
             ('body_too_large', 'request body too large', 413),
             ('not_an_array', 'request body must be a JSON array of prompts', 400),
             ('empty_batch', 'batch must contain at least one prompt', 400),
             ('batch_too_large', 'batch exceeds the maximum allowed size', 400),
             ('empty_prompt', 'prompt text must not be empty', 400),
             ('prompt_too_long', 'prompt exceeds the maximum allowed length', 400)) AS m(error_code, error, status_code)""",
    ),
    "reported": (
        ["judged", "messages"],
        """SELECT request_id, received_at, prompts, j.error_code, m.error, coalesce(m.status_code, 202) AS status_code,
             CASE WHEN j.error_code IN ('empty_prompt', 'prompt_too_long')
                  THEN CAST(list_position(codes, j.error_code) - 1 AS INTEGER) END AS error_seq
           FROM judged j LEFT JOIN messages m ON j.error_code = m.error_code""",
    ),
    "ingested": (
        ["reported"],
        f"""SELECT {_stable("batch_id", "seq")} AS prompt_id, * FROM (
              SELECT {_stable("request_id")} AS batch_id, CAST(unnest(range(len(prompts))) AS BIGINT) AS seq,
                unnest(prompts) AS prompt_text, received_at AS created_at FROM reported WHERE error_code IS NULL)""",
    ),
    "log": (
        [],
        """SELECT CAST(user_id * 10 + event_id % 10 AS VARCHAR) AS prompt_id, CAST(user_id AS VARCHAR) AS batch_id,
             event_id AS round, ts AS finished_at,
             CASE event_type WHEN 'view' THEN 200 WHEN 'signup' THEN 429 WHEN 'error' THEN 503
               WHEN 'purchase' THEN CASE WHEN event_id % 3 = 1 AND event_id % 11 = 1 THEN 400 ELSE 502 END END AS http_status,
             CASE WHEN event_type = 'signup' THEN CASE event_id % 3
               WHEN 0 THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR)
               WHEN 1 THEN strftime(ts + to_seconds(CAST(floor(value) AS BIGINT)), '%a, %d %b %Y %H:%M:%S GMT') END END AS retry_after,
             CASE WHEN event_type = 'click' THEN NULL ELSE CASE event_id % 7 WHEN 2 THEN 'not json'
               WHEN 3 THEN '{"completion":5}' WHEN 4 THEN props ELSE '{"completion":"c' || event_id || '"}' END END AS body,
             CASE WHEN event_type = 'click' AND event_id % 11 <> 0 THEN 'timeout' END AS transport_error
           FROM events""",
    ),
    "doc_answers": (
        [],
        """SELECT 'doc' || doc_id AS prompt_id, source AS batch_id, CAST(1 AS BIGINT) AS round,
             TIMESTAMP '2024-01-01 00:00:00' AS finished_at,
             CASE lang WHEN 'en' THEN 503 WHEN 'fr' THEN 400 WHEN 'de' THEN 429 ELSE 500 END AS http_status,
             CAST(n_chars AS VARCHAR) AS retry_after, text AS body, CAST(NULL AS VARCHAR) AS transport_error
           FROM documents""",
    ),
    "answers": (["log"], "SELECT * FROM log"),
    "classified": (
        ["answers"],
        """SELECT *,
             CASE WHEN transport_error IS NOT NULL THEN 'transient' WHEN http_status IS NULL THEN 'abandoned'
                  WHEN http_status = 200 THEN CASE WHEN decoded THEN 'success' ELSE 'permanent' END
                  WHEN http_status = 429 THEN 'rate_limited' WHEN http_status >= 500 THEN 'transient'
                  ELSE 'permanent' END AS outcome,
             CASE WHEN http_status = 200 AND decoded AND json_valid(body)
                  THEN coalesce(json_extract_string(CASE WHEN json_valid(body) THEN body END, '$.completion'), '') END AS response,
             CASE WHEN http_status <> 429 OR http_status IS NULL OR retry_after IS NULL THEN 0
                  WHEN regexp_full_match(retry_after, '[+-]?[0-9]+') THEN greatest(CAST(retry_after AS BIGINT), 0) * 1000
                  ELSE greatest(coalesce(date_diff('microsecond', finished_at,
                         try_strptime(retry_after, '%a, %d %b %Y %H:%M:%S GMT')) // 1000, 0), 0) END AS retry_after_ms
           FROM (SELECT *, CASE WHEN json_valid(body) THEN json_type(body) = 'OBJECT'
                   AND coalesce(json_type(body, '$.completion'), 'NULL') IN ('VARCHAR', 'NULL') ELSE false END AS decoded FROM answers)""",
    ),
    "counted": (
        ["classified"],
        """SELECT *, CAST(1 + coalesce(sum(CASE WHEN outcome IN ('transient', 'abandoned') THEN 1 ELSE 0 END)
             OVER (PARTITION BY prompt_id ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS attempt
           FROM classified""",
    ),
    "ruled": (
        ["counted"],
        """SELECT *, CASE outcome WHEN 'success' THEN 'succeed' WHEN 'abandoned' THEN 'recover' WHEN 'rate_limited' THEN 'requeue'
             WHEN 'transient' THEN CASE WHEN attempt < 5 THEN 'requeue' ELSE 'fail' END ELSE 'fail' END AS decision FROM counted""",
    ),
    "decided": (
        ["ruled"],
        """SELECT *, finished_at + to_milliseconds(delay_ms) AS next_retry_at FROM (
             SELECT *,
               NOT coalesce(bool_or(decision IN ('succeed', 'fail')) OVER (PARTITION BY prompt_id ORDER BY round
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS live,
               CASE WHEN decision <> 'requeue' THEN NULL
                    WHEN retry_after_ms > 0 THEN least(retry_after_ms, 30000)
                    WHEN ceiling = 250 THEN 250
                    ELSE 250 + CAST(('0x' || substr(md5(prompt_id || ':' || round), 1, 8)) AS BIGINT) % (ceiling - 250) END AS delay_ms,
               CASE WHEN http_status = 429 THEN 'retryable: rate limited (429): ' || body
                    || CASE WHEN retry_after_ms > 0 THEN ' (retry-after=' || took || ')' ELSE '' END
                 WHEN transport_error IS NOT NULL THEN 'retryable: inference request failed: ' || transport_error
                 WHEN http_status >= 500 THEN 'retryable: server error (' || http_status || '): ' || body
                 WHEN http_status = 200 AND outcome = 'permanent' THEN 'decode response: not a completion object'
                 WHEN outcome = 'permanent' THEN 'inference failed (' || http_status || '): ' || body END AS error
             FROM (SELECT *, least(250 * CAST(2 ** least(attempt - 1, 30) AS BIGINT), 30000) AS ceiling,
                     CASE WHEN retry_after_ms < 1000 THEN retry_after_ms || 'ms' ELSE
                       CASE WHEN retry_after_ms >= 3600000 THEN (retry_after_ms // 3600000) || 'h' ELSE '' END
                       || CASE WHEN retry_after_ms >= 60000 THEN (retry_after_ms // 60000 % 60) || 'm' ELSE '' END
                       || regexp_replace(printf('%d.%03d', retry_after_ms % 60000 // 1000, retry_after_ms % 1000), '\\.?0+$', '')
                     || 's' END AS took
                   FROM (SELECT * REPLACE (CASE WHEN strlen(body) > 200 THEN left(body, cut)
                           || CASE WHEN strlen(left(body, cut)) < 200 THEN chr(65533) ELSE '' END || '...' ELSE body END AS body)
                         FROM (SELECT *, len(list_filter(range(1, 201), lambda i: strlen(left(body, i)) <= 200)) AS cut FROM ruled))))""",
    ),
    "state": (
        ["decided"],
        """SELECT prompt_id, any_value(batch_id) AS batch_id,
             CASE arg_max(decision, round) WHEN 'succeed' THEN 'succeeded' WHEN 'fail' THEN 'failed' ELSE 'pending' END AS status,
             arg_max(CASE WHEN outcome = 'rate_limited' THEN attempt - 1 ELSE attempt END, round) AS attempts,
             max(response) AS response,
             CASE WHEN arg_max(decision, round) <> 'succeed' THEN arg_max(error, round) FILTER (error IS NOT NULL) END AS error,
             arg_max(next_retry_at, round) FILTER (next_retry_at IS NOT NULL) AS next_retry_at,
             max(round) AS last_round
           FROM decided WHERE live GROUP BY prompt_id""",
    ),
    "counts": (
        ["state"],
        """SELECT batch_id, count(*) AS total, count(*) FILTER (status = 'succeeded') AS succeeded,
             count(*) FILTER (status = 'failed') AS failed,
             count(*) FILTER (status = 'pending') AS remaining, count(*) FILTER (status = 'pending') = 0 AS done
           FROM state GROUP BY batch_id""",
    ),
    "log_prompts": (
        [],
        """SELECT CAST(user_id * 10 + event_id % 10 AS VARCHAR) AS prompt_id, CAST(user_id AS VARCHAR) AS batch_id,
             event_id % 10 AS seq, 'user ' || user_id || ' asks ' || (event_id % 10) AS prompt_text, min(ts) AS created_at
           FROM events GROUP BY user_id, event_id % 10""",
    ),
    "full_state": (
        ["state", "log_prompts"],
        """SELECT p.*, s.status, s.attempts, s.response, s.error, s.next_retry_at
           FROM log_prompts p JOIN state s USING (prompt_id)""",
    ),
    "completed": (
        [],
        """SELECT CAST(c_custkey AS VARCHAR) AS batch_id, TIMESTAMP '2024-02-01 00:00:00' AS completed_at
           FROM customer WHERE c_mktsegment = 'BUILDING'""",
    ),
    "newly_done": (
        ["counts", "completed"],
        "SELECT * FROM counts WHERE done AND batch_id NOT IN (SELECT batch_id FROM completed)",
    ),
    "result_items": (
        ["newly_done", "full_state"],
        """SELECT n.batch_id, n.total, n.succeeded, n.failed, f.seq, f.prompt_id, f.prompt_text, f.response
           FROM newly_done n LEFT JOIN (SELECT * FROM full_state WHERE status = 'succeeded') f USING (batch_id)""",
    ),
    "result_parts": (
        ["newly_done", "result_items"],
        """SELECT n.batch_id, p.part, n.total, n.succeeded, n.failed, count(i.prompt_id) AS n_results,
             md5(coalesce(string_agg(i.seq || ':' || md5(i.prompt_text) || ':' || md5(i.response), '|' ORDER BY i.seq), '')) AS digest
           FROM newly_done n
           JOIN (SELECT batch_id, CAST(0 AS BIGINT) AS part FROM newly_done UNION
                 SELECT batch_id, seq // 4 FROM result_items WHERE prompt_id IS NOT NULL) p USING (batch_id)
           LEFT JOIN result_items i ON i.batch_id = n.batch_id AND i.seq // 4 = p.part AND i.prompt_id IS NOT NULL
           GROUP BY n.batch_id, p.part, n.total, n.succeeded, n.failed""",
    ),
    "talk": (
        [],
        """SELECT u.conv_id, u.turn AS seq, u.text AS prompt_text, a.text AS response
           FROM conversations u LEFT JOIN conversations a
             ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'""",
    ),
    "run": (
        ["queue"],
        """SELECT prompt_id, prompt_text, CAST(0 AS BIGINT) AS round, next_retry_at AS clock, next_retry_at AS due,
             CAST(0 AS BIGINT) AS attempts, 'pending' AS status, CAST(NULL AS VARCHAR) AS outcome FROM queue
           UNION ALL
           SELECT prompt_id, prompt_text, r AS round, t AS clock,
             CASE WHEN outcome = 'rate_limited' THEN t + to_milliseconds(5000)
                  WHEN outcome = 'transient' THEN t + to_milliseconds(CASE WHEN attempts = 0 THEN 250 ELSE 250
                    + CAST(('0x' || substr(md5(prompt_id || ':' || r), 1, 8)) AS BIGINT) % (ceiling - 250) END)
                  ELSE due END AS due,
             CASE WHEN outcome IS NULL OR outcome = 'rate_limited' THEN attempts ELSE attempts + 1 END AS attempts,
             CASE WHEN outcome = 'success' THEN 'succeeded'
                  WHEN outcome = 'permanent' OR (outcome = 'transient' AND attempts >= 4) THEN 'failed' ELSE 'pending' END AS status,
             outcome
           FROM (SELECT *, greatest(251, least(250 * CAST(2 ** attempts AS BIGINT), 30000)) AS ceiling,
                   CASE WHEN due > t THEN NULL WHEN draw < 128 THEN 'success' WHEN draw < 176 THEN 'rate_limited'
                        WHEN draw < 240 THEN 'transient' ELSE 'permanent' END AS outcome
                 FROM (SELECT * EXCLUDE (outcome), ('0x' || substr(md5(prompt_text || ':' || r), 1, 2))::BIGINT AS draw
                       FROM (SELECT *, round + 1 AS r, greatest(CASE WHEN round = 0 THEN clock
                               ELSE clock + to_milliseconds(4000) END, min(due) OVER ()) AS t
                             FROM run WHERE status = 'pending')))""",
    ),
    "settled": (["run"], "SELECT * FROM run WHERE status <> 'pending'"),
    "arrivals": (
        [],
        """SELECT event_id AS id, ts, epoch_us(ts) AS us, row_number() OVER (ORDER BY ts,
             ('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8))::BIGINT % 64, event_id) - 1 AS position FROM events""",
    ),
    "paced": (
        ["arrivals"],
        """SELECT *, greatest(us, coalesce(position * step + max(us - position * step) OVER (ORDER BY position
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), us) - 2 * step) - us AS wait_us
           FROM (SELECT *, CAST(ceil(1000000.0 / 0.004) AS BIGINT) AS step FROM arrivals)""",
    ),
}

_STATE_COLUMNS = "prompt_id, batch_id, status, attempts, response, error, next_retry_at, last_round"

# query -> (needed names, final SELECT)
_QUERIES: dict[str, tuple[list[str], str]] = {
    "ingest_explode": (["ingested"], "SELECT prompt_id, batch_id, seq, prompt_text, created_at FROM ingested"),
    "request_triage": (
        ["reported"],
        f"""SELECT request_id, status_code, error_code, error, error_seq,
             CASE WHEN error_code IS NULL THEN {_stable("request_id")} END AS batch_id,
             CASE WHEN error_code IS NULL THEN CAST(len(prompts) AS BIGINT) END AS accepted,
             CASE WHEN error_code IS NULL THEN 'pending' END AS status FROM reported""",
    ),
    "request_rejects": (
        ["reported"],
        "SELECT request_id, error_code, error, error_seq AS seq FROM reported WHERE error_code IS NOT NULL",
    ),
    "trim_prompts": (["rows_in"], "SELECT batch_id, seq, prompt_text, strlen(prompt_text) AS n_bytes FROM rows_in"),
    "validate_prompts": (["checked"], "SELECT batch_id, seq, error_code FROM checked"),
    "validate_batches": (["small_verdicts"], "SELECT batch_id, total_count, error_code, error_seq FROM small_verdicts"),
    "validate_known_batches": (
        ["log_prompts"],
        """SELECT CAST(c_custkey AS VARCHAR) AS batch_id, count(p.prompt_id) AS total_count,
             CASE WHEN count(p.prompt_id) = 0 THEN 'empty_batch' END AS error_code, CAST(NULL AS BIGINT) AS error_seq
           FROM customer LEFT JOIN log_prompts p ON p.batch_id = CAST(c_custkey AS VARCHAR) GROUP BY c_custkey""",
    ),
    "accepted_prompts": (["accepted"], "SELECT batch_id, seq, prompt_text, total_count FROM accepted"),
    "accepted_by_source": (
        ["rows_in"],
        """SELECT batch_id, row_number() OVER (PARTITION BY batch_id ORDER BY seq) - 1 AS seq, prompt_text,
             count(*) OVER (PARTITION BY batch_id) AS total_count
           FROM rows_in WHERE batch_id NOT IN (SELECT batch_id FROM rows_in WHERE prompt_text = '')
             AND batch_id NOT IN (SELECT batch_id FROM rows_in GROUP BY batch_id HAVING count(*) > 10000)""",
    ),
    "reject_report": (
        ["small_verdicts", "messages"],
        """SELECT error_code, error, status_code, count(*) AS batches, CAST(sum(total_count) AS BIGINT) AS prompts
           FROM small_verdicts JOIN messages USING (error_code) GROUP BY ALL""",
    ),
    "enqueue_rows": (["queue"], "SELECT * FROM queue"),
    "score_length_echo": (
        [],
        """SELECT 'doc' || doc_id AS item, 'mock completion for prompt of ' || strlen(text) || ' chars' AS response FROM documents
           UNION ALL SELECT 'page' || page_id, 'mock completion for prompt of ' || strlen(html) || ' chars' FROM pages""",
    ),
    "score_model": (
        [],
        """SELECT vec_id, round(list_sum(list_transform(range(64),
             lambda i: CAST(embedding[i + 1] AS DOUBLE) * (i * 37 % 64 - 31.5) / 64)), 3) + 0.0 AS score FROM embeddings""",
    ),
    "rounds_end_to_end": (
        ["queue", "settled"],
        """SELECT q.prompt_id, q.batch_id, q.seq, l.status, l.attempts,
             CASE WHEN l.status = 'succeeded' THEN 'scored in round ' || l.round END AS response,
             CASE l.outcome WHEN 'transient' THEN 'retryable: server error (503): busy'
               WHEN 'permanent' THEN 'inference failed (400): refused' END AS error
           FROM queue q LEFT JOIN settled l USING (prompt_id)""",
    ),
    "classify_attempts": (
        ["classified"],
        """SELECT prompt_id, round, outcome, outcome IN ('rate_limited', 'transient') AS retryable,
             outcome = 'rate_limited' AS rate_limited FROM classified""",
    ),
    "decode_completion": (
        ["classified"],
        "SELECT prompt_id, round, response AS completion, decoded FROM classified WHERE http_status = 200",
    ),
    "retry_after": (
        ["classified"],
        "SELECT prompt_id, round, retry_after, retry_after_ms FROM classified WHERE http_status = 429",
    ),
    "error_messages": (["decided"], "SELECT prompt_id, round, error FROM decided"),
    "backoff_bounds": (
        ["decided"],
        """SELECT prompt_id, round, attempt,
             CASE WHEN retry_after_ms > 0 THEN least(retry_after_ms, 30000) ELSE 250 END AS low_ms,
             CASE WHEN retry_after_ms > 0 THEN least(retry_after_ms, 30000)
                  ELSE least(250 * CAST(2 ** least(attempt - 1, 30) AS BIGINT), 30000) END AS high_ms
           FROM decided WHERE decision = 'requeue'""",
    ),
    "retry_schedule": (
        ["decided"],
        "SELECT prompt_id, round, delay_ms, next_retry_at FROM decided WHERE decision = 'requeue'",
    ),
    "decide_attempts": (["decided"], "SELECT prompt_id, round, outcome, attempt, decision, live FROM decided"),
    "dedupe_attempts": (
        ["log"],
        "SELECT prompt_id, round, finished_at, http_status, body, transport_error FROM log",
    ),
    "prompt_state": (["state"], f"SELECT {_STATE_COLUMNS} FROM state"),
    "claim_due": (
        ["state"],
        """SELECT prompt_id, batch_id, 'processing' AS status, attempts + 1 AS attempts, next_retry_at FROM state
           WHERE status = 'pending' AND (next_retry_at IS NULL OR next_retry_at <= TIMESTAMP '2024-01-20 00:00:00')
           ORDER BY next_retry_at NULLS FIRST, batch_id, prompt_id LIMIT 16""",
    ),
    "due_prompts": (
        ["state"],
        """SELECT prompt_id, batch_id, 'processing' AS status, attempts + 1 AS attempts, next_retry_at FROM state
           WHERE status = 'pending' AND (next_retry_at IS NULL OR next_retry_at <= TIMESTAMP '2024-01-20 00:00:00')""",
    ),
    "recovery_counts": (
        ["decided"],
        """SELECT batch_id, count(*) AS recovered, max(attempt) AS max_attempt FROM decided
           WHERE live AND decision = 'recover' GROUP BY batch_id""",
    ),
    "unanswered_claims": (
        ["log"],
        """SELECT prompt_id, batch_id, round, TIMESTAMP '2024-01-20 00:00:00' AS finished_at, 'abandoned' AS outcome
           FROM log WHERE http_status IS NULL AND transport_error IS NULL""",
    ),
    "queue_with_state": (
        ["full_state"],
        f"""SELECT prompt_id, batch_id, seq, status, attempts, response, error,
              coalesce(next_retry_at, created_at) AS next_retry_at FROM full_state
            UNION ALL SELECT {_stable("'new' || c_custkey", "0")}, 'new' || c_custkey, 0, 'pending', 0, NULL, NULL,
              TIMESTAMP '2024-01-20 00:00:00' FROM customer""",
    ),
    "batch_counts": (["counts"], "SELECT * FROM counts"),
    "done_batches": (["counts"], "SELECT batch_id, total, succeeded, failed FROM counts WHERE done"),
    "succeeded_prompts": (
        ["full_state"],
        "SELECT prompt_id, batch_id, seq, prompt_text, response, attempts FROM full_state WHERE status = 'succeeded'",
    ),
    "finalize_once": (
        ["result_parts"],
        """SELECT batch_id, 'completed' AS status, part, total, succeeded, failed, n_results,
             TIMESTAMP '2024-01-20 00:00:00' AS completed_at FROM result_parts""",
    ),
    "result_rows": (
        ["result_items"],
        """SELECT batch_id, total, '2024-01-20T00:00:00Z' AS generated_at, seq, prompt_id, prompt_text AS prompt, response
           FROM result_items WHERE prompt_id IS NOT NULL""",
    ),
    "result_digest": (
        ["result_parts"],
        "SELECT batch_id, part, total, succeeded, failed, n_results, digest FROM result_parts",
    ),
    "conversation_results": (
        ["talk"],
        """SELECT CAST(conv_id AS VARCHAR) AS batch_id, CAST(0 AS BIGINT) AS part, count(*) AS total, count(response) AS succeeded,
             count(*) - count(response) AS failed, count(response) AS n_results,
             md5(coalesce(string_agg(seq || ':' || md5(prompt_text) || ':' || md5(response), '|' ORDER BY seq)
               FILTER (response IS NOT NULL), '')) AS digest
           FROM talk GROUP BY conv_id""",
    ),
    "batch_status": (
        ["counts", "completed"],
        """SELECT CAST(c_custkey AS VARCHAR) AS batch_id,
             CASE WHEN d.completed_at IS NULL THEN 'pending' ELSE 'completed' END AS status,
             TIMESTAMP '2024-01-01 00:00:00' AS created_at, coalesce(total, 0) AS total, coalesce(succeeded, 0) AS succeeded,
             coalesce(failed, 0) AS failed, d.completed_at
           FROM customer LEFT JOIN counts k ON k.batch_id = CAST(c_custkey AS VARCHAR)
             LEFT JOIN completed d ON d.batch_id = CAST(c_custkey AS VARCHAR)""",
    ),
    "status_with_result": (
        ["counts", "result_parts"],
        """SELECT CAST(c_custkey AS VARCHAR) AS batch_id,
             CASE WHEN d.batch_id IS NULL THEN 'pending' ELSE 'completed' END AS status, coalesce(k.total, 0) AS total,
             coalesce(k.succeeded, 0) AS succeeded, coalesce(k.failed, 0) AS failed,
             CASE WHEN d.batch_id IS NOT NULL THEN TIMESTAMP '2024-01-20 00:00:00' END AS completed_at,
             d.parts, d.n_results
           FROM customer LEFT JOIN counts k ON k.batch_id = CAST(c_custkey AS VARCHAR)
             LEFT JOIN (SELECT batch_id, count(*) AS parts, max(n_results) FILTER (part = 0) AS n_results FROM result_parts GROUP BY batch_id) d
               ON d.batch_id = CAST(c_custkey AS VARCHAR)""",
    ),
    "batch_lookup": (
        ["checked"],
        f"""SELECT id, i.batch_id, CASE WHEN i.batch_id IS NULL THEN 'malformed' WHEN v.batch_id IS NULL THEN 'not_found'
              ELSE 'found' END AS lookup_status, total_count, error_code
            FROM (SELECT CASE doc_id % 7 WHEN 0 THEN known WHEN 1 THEN upper(known) WHEN 2 THEN 'urn:uuid:' || known
                    WHEN 3 THEN '{{' || known || '}}' WHEN 4 THEN replace(known, '-', '') WHEN 5 THEN {_stable("doc_id")}
                    ELSE source || '/' || lang END AS id,
                    CASE doc_id % 7 WHEN 5 THEN {_stable("doc_id")} WHEN 6 THEN NULL ELSE known END AS batch_id
                  FROM (SELECT *, {_stable("source || '/' || lang")} AS known FROM documents)) i
            LEFT JOIN (SELECT {_stable("batch_id")} AS batch_id, count(*) AS total_count,
                         arg_min(error_code, seq) FILTER (error_code IS NOT NULL) AS error_code
                       FROM checked GROUP BY checked.batch_id) v ON v.batch_id = i.batch_id""",
    ),
    "orphan_prompts": (
        ["log_prompts"],
        """SELECT prompt_id, batch_id, seq FROM log_prompts
           WHERE batch_id NOT IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_mktsegment <> 'MACHINERY')""",
    ),
    "visible_prompts": (
        ["log_prompts"],
        """SELECT prompt_id, batch_id, seq FROM log_prompts
           WHERE batch_id IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_mktsegment <> 'MACHINERY')""",
    ),
    "purge_batches": (
        ["log_prompts"],
        """SELECT prompt_id, batch_id, seq FROM log_prompts
           WHERE batch_id NOT IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal < 0)""",
    ),
    "attempt_metrics": (
        ["decided"],
        """SELECT batch_id, count(*) AS attempts, count(*) FILTER (outcome = 'success') AS n_success,
             count(*) FILTER (outcome = 'rate_limited') AS n_rate_limited, count(*) FILTER (outcome = 'transient') AS n_transient,
             count(*) FILTER (outcome = 'permanent') AS n_permanent, count(*) FILTER (outcome = 'abandoned') AS n_abandoned,
             count(*) FILTER (decision = 'requeue') AS n_requeued,
             round(avg(delay_ms), 4) AS mean_delay_ms, max(delay_ms) AS max_delay_ms
           FROM decided WHERE live GROUP BY batch_id""",
    ),
    "attempt_gaps": (
        ["decided"],
        """SELECT batch_id, CAST(sum(n - 1) AS BIGINT) AS gaps, round(sum(spread) / nullif(sum(n - 1), 0), 4) AS mean_gap_ms
           FROM (SELECT batch_id, prompt_id, count(*) AS n,
                   date_diff('microsecond', min(finished_at), max(finished_at)) // 1000 AS spread
                 FROM decided WHERE live GROUP BY batch_id, prompt_id) GROUP BY batch_id""",
    ),
    "send_plan": (
        ["paced"],
        """SELECT id, position, ts AS arrived_at, ts + to_microseconds(wait_us) AS send_at, wait_us FROM paced""",
    ),
    "stream_ingest": (["ingested"], "SELECT prompt_id, batch_id, seq, prompt_text, created_at FROM ingested"),
    "stream_counts": (
        ["counts"],
        "SELECT batch_id, succeeded, failed FROM counts WHERE succeeded + failed > 0",
    ),
    "stream_completions": (["counts"], "SELECT batch_id, total, succeeded, failed FROM counts WHERE done"),
    "stream_redelivery": (["state"], f"SELECT {_STATE_COLUMNS} FROM state"),
    "stream_fold": (["state"], f"SELECT {_STATE_COLUMNS} FROM state"),
    "scored_batches": (
        ["accepted"],
        """SELECT batch_id, count(*) AS total, count(*) AS succeeded, CAST(0 AS BIGINT) AS failed, true AS done,
             CAST(sum(strlen('mock completion for prompt of ' || strlen(prompt_text) || ' chars')) AS BIGINT) AS response_bytes
           FROM accepted GROUP BY batch_id""",
    ),
}

# error_messages also looks at documents sent back as response bodies
_WITH_DOCUMENTS = "SELECT * FROM log UNION ALL SELECT * FROM doc_answers"


def _needed(names: list[str], seen: list[str]) -> list[str]:
    for name in names:
        if name not in seen:
            _needed(_PARTS[name][0], seen)
            seen.append(name)
    return seen


def _sql(name: str) -> str:
    names, final = _QUERIES[name]
    order = _needed(names, [])
    bodies = {n: _PARTS[n][1] for n in order}
    if name in ("ingest_explode", "stream_ingest"):  # the default limits instead of the small ones
        bodies["typed"] = bodies["typed"].replace("> 40000", "> 82968576")
        bodies["judged"] = bodies["judged"].replace("> 12 ", "> 10000 ")
    if name == "error_messages":
        order = ["doc_answers", *order]
        bodies |= {"doc_answers": _PARTS["doc_answers"][1], "answers": _WITH_DOCUMENTS}
    with_clause = ",\n".join(f"{n} AS ({bodies[n]})" for n in order)
    return f"WITH RECURSIVE {with_clause}\n{final}" if order else final


def all_oracles() -> dict[str, str]:
    return {name: _sql(name) for name in _QUERIES}
