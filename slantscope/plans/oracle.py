"""Oracle SQL (DuckDB dialect) for the registered queries.

The oracle sees only the raw generated tables, so each statement starts
with the same table mapping as ``sources.fixtures`` written as CTEs.
"""

from __future__ import annotations

DETECTIONS = """detections AS (
  SELECT event_id AS id, props AS text_content,
         CASE event_type WHEN 'click' THEN 'race' WHEN 'view' THEN 'region'
                         WHEN 'signup' THEN 'gender' ELSE 'false' END AS bias_type,
         event_type IN ('click','view','signup') AS is_biased,
         ts AS created_at,
         CAST(CASE WHEN event_type IN ('click','view','signup') THEN 0.8 ELSE 0.2 END AS DOUBLE) AS confidence,
         user_id
  FROM events)"""

FEEDBACK = """feedback AS (
  SELECT o_orderkey AS id, o_custkey AS record_id, o_orderstatus <> 'F' AS is_correct,
         o_orderpriority AS feedback_content, o_orderdate AS feedback_time, o_orderkey % 150 AS user_id
  FROM orders)"""

USERS = """users AS (
  SELECT c_custkey AS id, c_name AS username,
         CASE WHEN c_mktsegment = 'MACHINERY' THEN 'admin' ELSE 'user' END AS role
  FROM customer)"""

ACCOUNTS = """accounts AS (
  SELECT *, CASE WHEN id % 3 <> 0 THEN created_at + INTERVAL 1 DAY END AS last_login
  FROM (SELECT *, TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(id % 365 AS INTEGER)) AS created_at FROM users))"""

LABELLED = """labelled AS (
  SELECT d.doc_id, d.text AS "TEXT",
         CASE d.doc_id % 3 WHEN 0 THEN 'race' WHEN 1 THEN 'region' ELSE 'gender' END AS topic,
         l.toxic AS label,
         CASE d.doc_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'dev' ELSE 'train' END AS split
  FROM documents d JOIN labels l USING (doc_id))"""

INCOMING = """incoming AS (
  SELECT l_orderkey AS record_id, l_linenumber AS line, l_returnflag <> 'R' AS is_correct,
         l_linestatus AS feedback_content, l_shipdate AS feedback_time, l_suppkey % 150 AS user_id
  FROM lineitem)"""

REGISTRATIONS = """registrations AS (
  SELECT 0 AS src, c_custkey AS src_key,
         CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) ELSE c_name || ' ' END AS username
  FROM customer
  UNION ALL
  SELECT 1 AS src, s_suppkey AS src_key, s_name AS username FROM supplier)"""

# Exact half-even percentage of two integer columns, as DOUBLE.
def rate_sql(b: str, t: str) -> str:
    q = f"((({b}) * 10000) // ({t}))"
    r = f"((({b}) * 10000) % ({t}))"
    return (f"CASE WHEN ({t}) = 0 THEN CAST(0 AS DOUBLE) ELSE CAST({q} + CASE WHEN 2 * {r} > ({t}) THEN 1 "
            f"WHEN 2 * {r} = ({t}) AND {q} % 2 = 1 THEN 1 ELSE 0 END AS DOUBLE) / CAST(100 AS DOUBLE) END")


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


SQL: dict[str, str] = {}

SQL["bias_rate_trend"] = with_(DETECTIONS, """per_day AS (
  SELECT CAST(created_at AS DATE) AS day, COUNT(*) AS total,
         CAST(SUM(CASE WHEN is_biased THEN 1 ELSE 0 END) AS BIGINT) AS biased_count
  FROM detections GROUP BY 1)""") + f"""
SELECT strftime(day, '%Y-%m-%d') AS date, total, biased_count, {rate_sql('biased_count', 'total')} AS rate
FROM per_day ORDER BY date"""

SQL["bias_rate_trend_range"] = with_(DETECTIONS, """per_day AS (
  SELECT CAST(created_at AS DATE) AS day, COUNT(*) AS total,
         CAST(SUM(CASE WHEN is_biased THEN 1 ELSE 0 END) AS BIGINT) AS biased_count
  FROM detections
  WHERE created_at >= TIMESTAMP '2024-01-05 00:00:00' AND created_at <= TIMESTAMP '2024-01-20 00:00:00'
  GROUP BY 1)""") + f"""
SELECT strftime(day, '%Y-%m-%d') AS date, total, biased_count, {rate_sql('biased_count', 'total')} AS rate
FROM per_day ORDER BY date"""

SQL["bias_type_stats"] = with_(DETECTIONS) + """
SELECT bias_type, CAST(SUM(w) AS BIGINT) AS count FROM (
  SELECT bias_type, 1 AS w FROM detections
  UNION ALL
  SELECT * FROM (VALUES ('racial', 0), ('regional', 0), ('gender', 0), ('false', 0)) v(bias_type, w))
GROUP BY bias_type"""

SQL["bias_type_stats_range"] = with_(DETECTIONS) + """
SELECT bias_type, CAST(SUM(w) AS BIGINT) AS count FROM (
  SELECT bias_type, 1 AS w FROM detections
  WHERE created_at >= TIMESTAMP '2024-01-05 00:00:00' AND created_at <= TIMESTAMP '2024-01-20 00:00:00'
  UNION ALL
  SELECT * FROM (VALUES ('race', 0), ('region', 0), ('gender', 0), ('false', 0)) v(bias_type, w))
GROUP BY bias_type"""

SQL["chart_long"] = with_(DETECTIONS, """per_day AS (
  SELECT CAST(created_at AS DATE) AS day, COUNT(*) AS total,
         CAST(SUM(CASE WHEN is_biased THEN 1 ELSE 0 END) AS BIGINT) AS biased_count
  FROM detections GROUP BY 1)""") + f"""
SELECT 'type' AS kind, bias_type AS key, CAST(SUM(w) AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS rate FROM (
  SELECT bias_type, 1 AS w FROM detections
  UNION ALL
  SELECT * FROM (VALUES ('racial', 0), ('regional', 0), ('gender', 0), ('false', 0)) v(bias_type, w))
GROUP BY bias_type
UNION ALL
SELECT 'trend' AS kind, strftime(day, '%Y-%m-%d') AS key, total AS n, {rate_sql('biased_count', 'total')} AS rate
FROM per_day"""

SQL["rollup_chart_long"] = SQL["chart_long"]
SQL["rollup_trend_range"] = SQL["bias_rate_trend_range"]
SQL["rollup_types_hours"] = SQL["bias_type_stats_range"].replace("2024-01-05 00:00:00", "2024-01-05 07:30:00").replace(
    "2024-01-20 00:00:00", "2024-01-20 16:45:00")

SQL["detection_stats"] = with_(DETECTIONS) + """
SELECT COUNT(*) AS total_detections,
       CAST(SUM(CASE WHEN is_biased THEN 1 ELSE 0 END) AS BIGINT) AS biased_count,
       COUNT(DISTINCT bias_type) AS bias_types_count,
       ROUND(AVG(confidence), 6) AS avg_confidence
FROM detections"""

SQL["rollup_stats"] = SQL["detection_stats"]

HISTORY = """
SELECT r.*, f.is_correct, f.feedback_content, f.feedback_time{extra}
FROM detections r LEFT JOIN feedback f ON r.id = f.record_id
WHERE r.user_id = 7
ORDER BY r.created_at DESC, r.id DESC, f.id DESC NULLS LAST
LIMIT 10 OFFSET 10"""
SQL["detection_history"] = with_(DETECTIONS, FEEDBACK) + HISTORY.format(extra="")
SQL["history_next_page"] = with_(DETECTIONS, FEEDBACK) + HISTORY.format(extra=", f.id AS feedback_id")
SQL["history_total"] = with_(DETECTIONS) + "SELECT COUNT(*) AS total FROM detections WHERE user_id = 7"

SQL["feedback_list"] = with_(DETECTIONS, FEEDBACK) + """
SELECT f.*, r.text_content, r.bias_type, r.confidence
FROM feedback f JOIN detections r ON f.record_id = r.id
ORDER BY f.feedback_time DESC, f.id DESC
LIMIT 10 OFFSET 0"""

LIST_WHERE = """f.is_correct = true AND f.feedback_time >= TIMESTAMP '1995-01-01 00:00:00'
  AND f.feedback_time <= TIMESTAMP '1996-12-31 00:00:00'"""
SQL["feedback_list_filtered"] = with_(DETECTIONS, FEEDBACK) + f"""
SELECT f.*, r.text_content, r.bias_type, r.confidence
FROM feedback f JOIN detections r ON f.record_id = r.id
WHERE {LIST_WHERE}
ORDER BY f.feedback_time DESC, f.id DESC
LIMIT 10 OFFSET 10"""
SQL["history_clustered"] = SQL["detection_history"]
SQL["feedback_list_clustered"] = SQL["feedback_list_filtered"]
SQL["feedback_next_page"] = SQL["feedback_list"].replace("OFFSET 0", "OFFSET 10")
SQL["feedback_list_author"] = with_(DETECTIONS, FEEDBACK) + """
SELECT f.*, r.text_content, r.bias_type, r.confidence
FROM feedback f JOIN detections r ON f.record_id = r.id
WHERE NOT f.is_correct AND f.user_id = 7
ORDER BY f.feedback_time DESC, f.id DESC
LIMIT 25"""
SQL["feedback_total"] = with_(FEEDBACK) + f"SELECT COUNT(*) AS total FROM feedback f WHERE {LIST_WHERE}"

SQL["feedback_export"] = with_(DETECTIONS, FEEDBACK, USERS) + """
SELECT f.id, f.record_id, f.is_correct, f.feedback_content, f.feedback_time,
       r.text_content, r.bias_type, r.is_biased, r.confidence, u.username
FROM feedback f JOIN detections r ON f.record_id = r.id JOIN users u ON f.user_id = u.id
ORDER BY f.feedback_time DESC, f.id DESC"""

NAME_KEY = "rtrim(strip_accents(lower({0})))"
SQL["user_lookup"] = with_(USERS, ACCOUNTS) + f"""
SELECT * FROM accounts
WHERE {NAME_KEY.format('username')} = {NAME_KEY.format("'CÚSTOMER#000000007 '")}"""
SQL["user_by_id"] = with_(USERS, ACCOUNTS) + "SELECT * FROM accounts WHERE id = 7"
SQL["user_by_id_clustered"] = SQL["user_by_id"]

SQL["register_users"] = with_(USERS, REGISTRATIONS, f"""k AS (
  SELECT *, {NAME_KEY.format('username')} AS key,
         CASE WHEN username IS NULL OR username = '' THEN 'name_missing' END AS invalid
  FROM registrations)""", """r AS (
  SELECT src, src_key, row_number() OVER (PARTITION BY key ORDER BY src, src_key) AS rn
  FROM k WHERE invalid IS NULL)""", f"""taken AS (SELECT DISTINCT {NAME_KEY.format('username')} AS key FROM users)""",
  """s AS (
  SELECT k.src, k.src_key, k.username,
         CASE WHEN k.invalid IS NOT NULL THEN k.invalid WHEN r.rn > 1 THEN 'duplicate'
              WHEN t.key IS NOT NULL THEN 'exists' ELSE 'accepted' END AS status
  FROM k LEFT JOIN r ON k.src = r.src AND k.src_key = r.src_key
         LEFT JOIN taken t ON k.key = t.key)""") + """
SELECT src, src_key, username, status, CASE WHEN status = 'accepted' THEN 'user' END AS role FROM s"""

SQL["apply_logins"] = with_(USERS, "latest AS (SELECT user_id, max(ts) AS seen FROM events GROUP BY user_id)") + """
SELECT u.id, u.username, u.role, l.seen AS last_login FROM users u LEFT JOIN latest l ON u.id = l.user_id"""


def _rules(table: str, src: str, checks: list[tuple[str, str]]) -> list[str]:
    return [f"SELECT '{table}' AS table_name, '{rule}' AS rule, "
            f"CAST(COALESCE(SUM(CASE WHEN {cond} THEN 1 ELSE 0 END), 0) AS BIGINT) AS violations FROM {src}"
            for rule, cond in checks]


def _unique(table: str, src: str, key: str, rule: str) -> str:
    return (f"SELECT '{table}' AS table_name, '{rule}' AS rule, "
            f"CAST(COUNT({key}) - COUNT(DISTINCT {key}) AS BIGINT) AS violations FROM {src}")


def _fk(table: str, src: str, col: str, parent: str, pcol: str, rule: str) -> str:
    return (f"SELECT '{table}' AS table_name, '{rule}' AS rule, CAST(COUNT(*) AS BIGINT) AS violations "
            f"FROM {src} c WHERE c.{col} IS NOT NULL AND NOT EXISTS "
            f"(SELECT 1 FROM {parent} p WHERE p.{pcol} = c.{col})")


_AUDIT = (
    _rules("detections", "detections", [
        ("id_null", "id IS NULL"), ("text_null", "text_content IS NULL"),
        ("is_biased_null", "is_biased IS NULL"), ("bias_type_too_long", "length(bias_type) > 50"),
        ("text_too_long", "strlen(text_content) > 65535"), ("created_at_null", "created_at IS NULL")])
    + [_unique("detections", "detections", "id", "id_duplicate"),
       _fk("detections", "detections", "user_id", "users", "id", "user_unknown")]
    + _rules("feedback", "feedback", [
        ("id_null", "id IS NULL"), ("record_id_null", "record_id IS NULL"),
        ("is_correct_null", "is_correct IS NULL"), ("content_too_long", "strlen(feedback_content) > 65535"),
        ("feedback_time_null", "feedback_time IS NULL")])
    + [_unique("feedback", "feedback", "id", "id_duplicate"),
       _fk("feedback", "feedback", "record_id", "detections", "id", "record_unknown"),
       _fk("feedback", "feedback", "user_id", "users", "id", "user_unknown")]
    + _rules("users", "users", [
        ("id_null", "id IS NULL"), ("username_null", "username IS NULL"),
        ("username_too_long", "length(username) > 50"),
        ("role_invalid", "role IS NULL OR role NOT IN ('user', 'admin')")])
    + [_unique("users", "users", "id", "id_duplicate"),
       _unique("users", "users", NAME_KEY.format("username"), "username_duplicate")]
    + _rules("incoming_feedback", "incoming", [
        ("record_id_null", "record_id IS NULL"), ("is_correct_null", "is_correct IS NULL")])
    + [_fk("incoming_feedback", "incoming", "record_id", "detections", "id", "record_unknown"),
       _fk("incoming_feedback", "incoming", "user_id", "users", "id", "user_unknown")]
)
SQL["constraint_audit"] = with_(DETECTIONS, FEEDBACK, USERS, INCOMING) + "\nUNION ALL\n".join(_AUDIT)

ACCEPT = with_(DETECTIONS, USERS, INCOMING, """marked AS (
  SELECT i.*,
    CASE WHEN i.record_id IS NULL OR i.record_id = 0 THEN 'record_missing'
         WHEN i.is_correct IS NULL THEN 'verdict_missing'
         WHEN NOT EXISTS (SELECT 1 FROM detections r WHERE r.id = i.record_id) THEN 'unknown_record'
         WHEN i.user_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM users u WHERE u.id = i.user_id) THEN 'unknown_user'
    END AS reject_reason
  FROM incoming i)""")
SQL["feedback_accept"] = ACCEPT + "SELECT * EXCLUDE (reject_reason) FROM marked WHERE reject_reason IS NULL"
SQL["feedback_rejects"] = ACCEPT + """SELECT reject_reason, COUNT(*) AS n FROM marked
WHERE reject_reason IS NOT NULL GROUP BY reject_reason"""
SQL["assign_ids"] = ACCEPT + """, acc AS (SELECT * EXCLUDE (reject_reason) FROM marked WHERE reject_reason IS NULL)
SELECT acc.*, row_number() OVER (ORDER BY feedback_time NULLS FIRST, record_id NULLS FIRST, line NULLS FIRST,
         is_correct NULLS FIRST, feedback_content NULLS FIRST, user_id NULLS FIRST)
       + (SELECT max(o_orderkey) FROM orders) AS id
FROM acc"""

SQL["validate_texts"] = """
SELECT concat_ws(':', CAST(conv_id AS VARCHAR), CAST(turn AS VARCHAR)) AS request_id, conv_id AS user_id, text,
       CASE WHEN text IS NULL THEN 'text_missing' WHEN text = '' THEN 'text_empty' END AS reject_reason
FROM conversations"""

SCORES = """vecs AS (
  SELECT vec_id, embedding,
         list_sum(list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) * (CAST(((i - 1) * 37) % 19 - 9 AS DOUBLE) / 10.0))) AS c
  FROM embeddings)""", """topics AS (
  SELECT * FROM (VALUES (0, 'race', 0.3), (1, 'region', -0.2), (2, 'gender', 0.1), (3, 'false', 0.0)) t(position, topic, u))""", """scores AS (
  SELECT v.vec_id, t.position, t.topic, 1.0 / (1.0 + exp(-(v.c + CAST(t.u AS DOUBLE)))) AS p
  FROM vecs v CROSS JOIN topics t)"""
SQL["topic_scores"] = with_(*SCORES) + "SELECT vec_id, position, topic, round(p, 6) AS probability FROM scores"
SQL["classify"] = with_(*SCORES, """ranked AS (
  SELECT vec_id, topic, p, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, position) AS rn
  FROM scores WHERE p > 0 AND NOT isnan(p))""", """best AS (
  SELECT v.vec_id, coalesce(r.topic, 'false') AS topic, coalesce(r.p, 0.0) AS p,
         EXISTS (SELECT 1 FROM scores s WHERE s.vec_id = v.vec_id AND (s.p IS NULL OR isnan(s.p))) AS err
  FROM vecs v LEFT JOIN ranked r ON r.vec_id = v.vec_id AND r.rn = 1)""", """lab AS (
  SELECT vec_id, CASE WHEN p >= 0.5 THEN topic ELSE 'false' END AS bias_type, p, err FROM best)""") + """
SELECT vec_id, bias_type, bias_type <> 'false' AS is_biased,
       CASE WHEN bias_type <> 'false' THEN 0.8 ELSE 0.2 END::DOUBLE AS confidence,
       round(p, 6) AS best_probability, err AS score_error
FROM lab"""

TOKEN_RE = r"[\p{L}\p{M}\p{N}]+|[^\s\p{L}\p{M}\p{N}]"
VOCAB = f"""vocab AS (
  SELECT token, count, row_number() OVER (ORDER BY count DESC, token) + 3 AS token_id
  FROM (SELECT token, COUNT(*) AS count
        FROM (SELECT unnest(regexp_extract_all(lower(text), '{TOKEN_RE}')) AS token FROM documents)
        GROUP BY token)
  ORDER BY count DESC, token LIMIT 2000)"""
SQL["vocab_top"] = with_(VOCAB) + "SELECT token, count, token_id FROM vocab"
SQL["token_total"] = f"""SELECT CAST(SUM(len(regexp_extract_all(lower(text), '{TOKEN_RE}'))) AS BIGINT) AS tokens
FROM documents"""
SQL["encode_ids"] = with_(LABELLED, VOCAB, f"""toks AS (
  SELECT doc_id, regexp_extract_all(lower("TEXT"), '{TOKEN_RE}') AS t FROM labelled)""", """pos AS (
  SELECT doc_id, unnest(range(1, len(t[1:126]) + 1)) AS pos, unnest(t[1:126]) AS token FROM toks)""", """ids AS (
  SELECT p.doc_id, list(CAST(coalesce(v.token_id, 1) AS INTEGER) ORDER BY p.pos) AS ids
  FROM pos p LEFT JOIN vocab v ON p.token = v.token GROUP BY p.doc_id)""") + """
SELECT t.doc_id, CAST(len(t.t) AS INTEGER) AS n_tokens,
       list_concat([2], coalesce(i.ids, []), [3],
                   list_transform(range(128 - 2 - len(coalesce(i.ids, []))), lambda x: 0)) AS input_ids,
       list_concat(list_transform(range(len(coalesce(i.ids, [])) + 2), lambda x: 1),
                   list_transform(range(128 - 2 - len(coalesce(i.ids, []))), lambda x: 0)) AS attention_mask
FROM toks t LEFT JOIN ids i ON t.doc_id = i.doc_id"""

AUG = """aug AS (
  SELECT l.*, c.cand AS cand, c.slot AS topic_slot,
         CAST(CASE WHEN l.topic = c.cand THEN l.label ELSE 0 END AS INTEGER) AS aug_label
  FROM labelled l CROSS JOIN (VALUES (0, 'race'), (1, 'region'), (2, 'gender')) c(slot, cand))"""
SQL["augment"] = with_(LABELLED, AUG) + "SELECT doc_id, split, cand AS topic, topic_slot, aug_label AS label FROM aug"
SQL["split_sizes"] = with_(LABELLED, AUG) + """
SELECT split, COUNT(DISTINCT doc_id) AS texts, COUNT(*) AS rows,
       CAST(SUM(CASE WHEN aug_label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS positives,
       CAST(ceil(COUNT(DISTINCT doc_id) / 16.0) AS BIGINT) AS batches
FROM aug GROUP BY split"""

SQL["eval_metrics"] = with_(LABELLED, AUG, """rows AS (
  SELECT a.split, a.aug_label AS label,
         list_sum(list_transform(range(8), lambda i: (((length("TEXT") * (i + 3) + strlen("TEXT")) % (11 + i))::DOUBLE / 10.0)
                                                     * (((i * 37) % 19 - 9)::DOUBLE / 10.0)))
         + CASE a.cand WHEN 'race' THEN 0.3 WHEN 'region' THEN -0.2 WHEN 'gender' THEN 0.1 ELSE 0.0 END AS logit
  FROM aug a)""", """scored AS (
  SELECT split, label, CASE WHEN logit > 0 THEN 1 ELSE 0 END AS pred, 1.0 / (1.0 + exp(-logit)) AS p FROM rows)""",
  """m AS (
  SELECT split, COUNT(*) AS n,
         CAST(SUM(CASE WHEN label = 1 AND pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
         CAST(SUM(CASE WHEN label = 0 AND pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
         CAST(SUM(CASE WHEN label = 1 AND pred = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
         CAST(SUM(CASE WHEN label = 0 AND pred = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
         AVG(-ln(greatest(CASE WHEN label = 1 THEN p ELSE 1 - p END, 1e-12))) AS loss
  FROM scored GROUP BY split)""") + """
SELECT split, n, tp, fp, fn, tn, round((tp + tn) / n, 6) AS accuracy,
       round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 6) AS f1,
       round(loss, 6) AS loss
FROM m"""

SQL["csv_round_trip"] = with_(LABELLED) + 'SELECT "TEXT", topic, label, split FROM labelled'

SQL["score_stream"] = SQL["classify"]
SQL["feedback_stream"] = SQL["feedback_accept"]
SQL["trend_stream"] = with_(DETECTIONS, """per_day AS (
  SELECT CAST(created_at AS DATE) AS day, COUNT(*) AS total,
         CAST(SUM(CASE WHEN is_biased THEN 1 ELSE 0 END) AS BIGINT) AS biased_count
  FROM detections GROUP BY 1)""") + f"""
SELECT strftime(day, '%Y-%m-%d') AS date, total, biased_count, {rate_sql('biased_count', 'total')} AS rate
FROM per_day
WHERE CAST(day AS TIMESTAMP) + INTERVAL 1 DAY <= (SELECT max(created_at) - INTERVAL 1 DAY FROM detections)"""


SQL["trend_arrays"] = "SELECT CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS pos, date AS dates, rate AS rates FROM (" + SQL[
    "bias_rate_trend"] + ")"
SQL["chart_payload_rows"] = ("SELECT kind, coalesce(key, 'unknown') AS key, CASE WHEN kind = 'type' THEN n END AS n, rate FROM ("
                             + SQL["chart_long"] + ")")
SQL["encode_scoring"] = with_(LABELLED, VOCAB, f"""toks AS (
  SELECT doc_id, regexp_extract_all(lower("TEXT"), '{TOKEN_RE}') AS t FROM labelled)""", """pos AS (
  SELECT doc_id, unnest(range(1, len(t[1:510]) + 1)) AS pos, unnest(t[1:510]) AS token FROM toks)""", """ids AS (
  SELECT p.doc_id, list(CAST(coalesce(v.token_id, 1) AS INTEGER) ORDER BY p.pos) AS ids
  FROM pos p LEFT JOIN vocab v ON p.token = v.token GROUP BY p.doc_id)""") + """
SELECT t.doc_id, CAST(len(t.t) AS INTEGER) AS n_tokens, list_concat([2], coalesce(i.ids, []), [3]) AS input_ids,
       list_transform(range(len(coalesce(i.ids, [])) + 2), lambda x: 1) AS attention_mask
FROM toks t LEFT JOIN ids i ON t.doc_id = i.doc_id"""
SQL["head_input"] = """
SELECT vec_id, topic, CAST(len(embedding) + 5 AS INTEGER) AS width,
       list_transform(range(5), lambda i: CASE WHEN i = slot THEN 1.0 ELSE 0.0 END::DOUBLE) AS onehot,
       md5(array_to_string(list_transform(embedding, lambda x: floor(x::DOUBLE * 1000000)::BIGINT::VARCHAR), ',')) AS vector_md5
FROM embeddings CROSS JOIN (VALUES ('race', 0), ('region', 1), ('gender', 2), ('false', 4)) t(topic, slot)"""
SQL["train_split_rows"] = with_(LABELLED, AUG) + """
SELECT split, COUNT(*) AS rows, CAST(SUM(aug_label) AS BIGINT) AS positives, COUNT(*) AS same FROM aug GROUP BY split"""

SQL["append_detections"] = with_(DETECTIONS) + """
SELECT id, text_content, bias_type, is_biased, created_at, TIMESTAMP '2024-06-01 00:00:00' AS updated_at, user_id
FROM detections WHERE id % 2 = 0
UNION ALL
SELECT (SELECT max(id) FROM detections WHERE id % 2 = 0)
       + row_number() OVER (ORDER BY created_at, user_id, text_content, bias_type) AS id,
       text_content, bias_type, is_biased, created_at, TIMESTAMP '2024-06-01 00:00:00', user_id
FROM detections WHERE id % 2 = 1"""

AWKWARD_REGISTRATIONS = """registrations AS (
  SELECT src, src_key, CASE WHEN src_key % 19 = 0 THEN '' WHEN src_key % 23 = 0 THEN NULL
         WHEN src_key % 3 = 0 THEN 'Ünique Name' || CASE WHEN src_key % 2 = 0 THEN ' ' ELSE '' END ELSE username END AS username
  FROM registrations0)"""
_REG0 = REGISTRATIONS.replace("registrations AS", "registrations0 AS", 1)
SQL["register_awkward"] = SQL["register_users"].replace(REGISTRATIONS, _REG0 + ",\n" + AWKWARD_REGISTRATIONS)
SQL["append_users"] = SQL["register_awkward"].replace("WITH users AS", "WITH " + ACCOUNTS + ",\nusers AS", 1).replace(
    ACCOUNTS + ",\n" + USERS, USERS + ",\n" + ACCOUNTS).replace("""
SELECT src, src_key, username, status, CASE WHEN status = 'accepted' THEN 'user' END AS role FROM s""", """
SELECT id, username, role, created_at, last_login FROM accounts
UNION ALL
SELECT (SELECT max(id) FROM users) + row_number() OVER (ORDER BY src, src_key), username, 'user', TIMESTAMP '2024-06-01 00:00:00', NULL
FROM s WHERE status = 'accepted'""")

AWKWARD_INCOMING = """incoming AS (
  SELECT CASE WHEN record_id % 41 = 0 THEN NULL WHEN record_id % 43 = 0 THEN 0 ELSE record_id END AS record_id, line,
         CASE WHEN (record_id + line) % 37 = 0 THEN NULL ELSE is_correct END AS is_correct, feedback_content, feedback_time,
         CASE WHEN record_id % 5 = 0 THEN NULL WHEN record_id % 29 = 0 THEN record_id + 10000000 ELSE user_id END AS user_id
  FROM incoming0)"""
_IN0 = INCOMING.replace("incoming AS", "incoming0 AS", 1)
SQL["feedback_rejects_awkward"] = SQL["feedback_rejects"].replace(INCOMING, _IN0 + ",\n" + AWKWARD_INCOMING)
SQL["validate_awkward_texts"] = """
SELECT *, CASE WHEN text IS NULL THEN 'text_missing' WHEN text = '' THEN 'text_empty' END AS reject_reason FROM (
  SELECT request_id, user_id, CASE WHEN k % 11 = 0 THEN NULL WHEN k % 13 = 0 THEN '' WHEN k % 17 = 0 THEN '  ' ELSE text END AS text
  FROM (SELECT *, user_id * 7 + length(request_id) AS k FROM (
    SELECT concat_ws(':', CAST(conv_id AS VARCHAR), CAST(turn AS VARCHAR)) AS request_id, conv_id AS user_id, text FROM conversations)))"""

BROKEN = [DETECTIONS.replace("detections AS", "detections0 AS", 1), FEEDBACK.replace("feedback AS", "feedback0 AS", 1),
          USERS.replace("users AS", "users0 AS", 1), _IN0, AWKWARD_INCOMING, LABELLED, """detections AS (
  SELECT CASE WHEN id % 101 = 0 THEN NULL WHEN id % 103 = 0 THEN id - 1 ELSE id END AS id,
         CASE WHEN id % 89 = 0 THEN NULL WHEN id % 997 = 0 THEN repeat('x', 70000) ELSE text_content END AS text_content,
         CASE WHEN id % 83 = 0 THEN repeat('é', 60) ELSE bias_type END AS bias_type,
         CASE WHEN id % 79 = 0 THEN NULL ELSE is_biased END AS is_biased,
         CASE WHEN id % 73 = 0 THEN NULL ELSE created_at END AS created_at, confidence,
         CASE WHEN id % 71 = 0 THEN -id ELSE user_id END AS user_id FROM detections0)""", """feedback AS (
  SELECT CASE WHEN id % 101 = 0 THEN NULL WHEN id % 103 = 0 THEN id - id % 10 ELSE id END AS id,
         CASE WHEN id % 89 = 0 THEN NULL WHEN id % 61 = 0 THEN -id ELSE record_id END AS record_id,
         CASE WHEN id % 79 = 0 THEN NULL ELSE is_correct END AS is_correct,
         CASE WHEN id % 997 = 0 THEN repeat('x', 70000) ELSE feedback_content END AS feedback_content,
         CASE WHEN id % 73 = 0 THEN NULL ELSE feedback_time END AS feedback_time,
         CASE WHEN id % 71 = 0 THEN -id ELSE user_id END AS user_id FROM feedback0)""", """users AS (
  SELECT CASE WHEN id % 53 = 0 THEN NULL WHEN id % 59 = 0 THEN id - 1 ELSE id END AS id,
         CASE WHEN id % 47 = 0 THEN NULL WHEN id % 43 = 0 THEN repeat('n', 51) ELSE username END AS username,
         CASE WHEN id % 41 = 0 THEN 'root' ELSE role END AS role FROM users0)""", """training AS (
  SELECT CASE WHEN doc_id % 31 = 0 THEN NULL WHEN doc_id % 37 = 0 THEN doc_id - 1 ELSE doc_id END AS id,
         CASE WHEN doc_id % 29 = 0 THEN NULL ELSE "TEXT" END AS text_content,
         CASE WHEN doc_id % 23 = 0 THEN NULL WHEN doc_id % 19 = 0 THEN repeat('t', 51) ELSE topic END AS bias_type,
         CASE WHEN doc_id % 17 = 0 THEN NULL ELSE label = 1 END AS is_biased,
         CASE WHEN doc_id % 13 = 0 THEN repeat('s', 101) ELSE split END AS source FROM labelled)"""]
_AUDIT_TRAINING = _rules("training", "training", [
    ("id_null", "id IS NULL"), ("text_null", "text_content IS NULL"), ("bias_type_null", "bias_type IS NULL"),
    ("is_biased_null", "is_biased IS NULL"), ("bias_type_too_long", "length(bias_type) > 50"),
    ("text_too_long", "strlen(text_content) > 65535"), ("source_too_long", "length(source) > 100")]) + [
    _unique("training", "training", "id", "id_duplicate")]
SQL["constraint_audit_broken"] = with_(*BROKEN) + "\nUNION ALL\n".join(_AUDIT + _AUDIT_TRAINING)

_HAND = {"race": ("[0.3, -0.2, 0.1, 0.4, -0.5, 0.2, -0.1, 0.05]", -0.4), "region": ("[-0.4, 0.3, 0.2, -0.1, 0.1, -0.3, 0.4, 0.15]", 0.1),
         "gender": ("[0.2, 0.1, -0.6, 0.3, 0.2, 0.1, -0.2, -0.05]", -0.2), "false": ("[0.0, 0.05, 0.1, -0.05, 0.1, 0.0, 0.05, 0.0]", -0.3)}
SQL["model_scores"] = with_(LABELLED, """vec AS (
  SELECT doc_id, list_transform(range(8), lambda i: ((length("TEXT") * (i + 3) + strlen("TEXT")) % (11 + i))::DOUBLE / 10.0) AS v FROM labelled)""",
  "p AS (" + " UNION ALL ".join(
      f"SELECT doc_id, {k} AS position, '{t}' AS topic, 1.0 / (1.0 + exp(-(list_dot_product(v, {w}::DOUBLE[]) + {b}))) AS p FROM vec"
      for k, (t, (w, b)) in enumerate(_HAND.items())) + ")",
  "best AS (SELECT doc_id, arg_max(topic, (p, -position)) AS topic, max(p) AS p FROM p GROUP BY doc_id)",
  "named AS (SELECT doc_id, CASE WHEN p >= 0.5 THEN topic ELSE 'false' END AS bias_type, p FROM best)") + """
SELECT doc_id, bias_type, bias_type <> 'false' AS is_biased, CAST(CASE WHEN bias_type <> 'false' THEN 0.8 ELSE 0.2 END AS DOUBLE) AS confidence,
       round(p, 6) AS best_probability, false AS score_error
FROM named"""
SQL["train_rows"] = with_(LABELLED) + "SELECT doc_id, topic, label FROM labelled WHERE split = 'train'"
SQL["shuffled_rows"] = with_(LABELLED) + "SELECT doc_id, split, label FROM labelled"
SQL["load_training"] = with_(LABELLED) + """
SELECT doc_id, topic, label, md5("TEXT") AS text_md5, 'corpus' AS source, TIMESTAMP '2024-06-01 00:00:00' AS created_at,
       CASE WHEN doc_id % 2 = 0 THEN TIMESTAMP '2024-06-02 00:00:00' ELSE TIMESTAMP '2024-06-01 00:00:00' END AS updated_at
FROM labelled"""
SQL["texts_json"] = SQL["validate_awkward_texts"].replace(
    "*, CASE WHEN text IS NULL THEN 'text_missing' WHEN text = '' THEN 'text_empty' END AS reject_reason", "*")
SQL["feedback_json"] = with_(_IN0, AWKWARD_INCOMING) + "SELECT record_id, is_correct, feedback_content, user_id FROM incoming"
SQL["registrations_json"] = with_(_REG0, AWKWARD_REGISTRATIONS) + "SELECT username FROM registrations"

SQL["texts_intake"] = with_("r AS (" + SQL["texts_json"] + ")", """posted AS (
  SELECT *, CASE WHEN k % 19 = 0 THEN '{"request_id": "' || request_id || '", "text": "cut'
                 WHEN k % 23 = 0 THEN '[' || user_id || ']'
                 WHEN k % 29 = 0 THEN '{"request_id": "' || request_id || '", "user_id": "none", "text": "t"}' END AS raw
  FROM (SELECT *, user_id + length(request_id) AS k FROM r))""", """marked AS (
  SELECT *, CASE WHEN raw IS NOT NULL THEN 'malformed' WHEN text IS NULL THEN 'text_missing' WHEN text = '' THEN 'text_empty' END AS reason
  FROM posted)""") + """
SELECT CASE WHEN reason IS NULL THEN request_id END AS request_id, CASE WHEN reason IS NULL THEN user_id END AS user_id,
       CASE WHEN reason IS NULL THEN md5(text) END AS text_md5, reason, raw
FROM marked"""
SQL["texts_intake_stream"] = SQL["texts_intake"]

SQL["open_days_stream"] = SQL["bias_rate_trend"]

SQL["feedback_two_streams"] = """
SELECT event_id AS record_id, event_id % 2 = 0 AS is_correct, props AS feedback_content,
       ts + to_hours(CAST(event_id % 7 - 3 AS INTEGER)) AS feedback_time, user_id
FROM events WHERE event_id % 13 <> 0 AND event_id % 17 <> 0 AND event_id <> 0 AND abs(event_id % 7 - 3) <= 2"""

SQL["logins_in_buckets"] = with_(USERS, ACCOUNTS, "seen AS (SELECT user_id, max(ts) AS ts FROM events GROUP BY user_id)") + """
SELECT id, username, role, created_at, greatest(last_login, ts) AS last_login FROM accounts LEFT JOIN seen ON id = user_id"""

SQL["training_changes"] = with_(LABELLED) + """
SELECT doc_id AS id, md5("TEXT") AS text_md5, topic AS bias_type, label = 1 AND doc_id % 5 <> 0 AS is_biased, TIMESTAMP '2024-06-01 00:00:00' AS created_at,
       CASE WHEN label = 1 AND doc_id % 5 = 0 THEN TIMESTAMP '2024-06-02 00:00:00' ELSE TIMESTAMP '2024-06-01 00:00:00' END AS updated_at
FROM labelled"""

SQL["append_feedback"] = with_(USERS, DETECTIONS, _IN0, AWKWARD_INCOMING, """ok AS (
  SELECT i.*, row_number() OVER (ORDER BY CASE WHEN line <= 2 THEN 0 ELSE 1 END, feedback_time NULLS FIRST, record_id NULLS FIRST, line NULLS FIRST,
         is_correct NULLS FIRST, feedback_content NULLS FIRST, user_id NULLS FIRST) AS id
  FROM incoming i
  WHERE record_id IS NOT NULL AND record_id <> 0 AND is_correct IS NOT NULL AND record_id IN (SELECT id FROM detections)
    AND (user_id IS NULL OR user_id IN (SELECT id FROM users)))""") + """
SELECT id, record_id, is_correct, feedback_content, feedback_time, TIMESTAMP '2024-06-01 00:00:00' AS created_at, user_id FROM ok"""

# A posted text's way to its stored detection; float32 numbers of the encoder, the fixed head, ids of the first micro-batch.
SQL["posted_texts_stream"] = with_("lines AS (" + SQL["texts_intake"].replace("md5(text) END AS text_md5", "text END AS text") + ")", """vec AS (
  SELECT *, list_sum(list_transform(range(8), lambda i: (((length(text) * (i + 3) + strlen(text)) % (11 + i))::DOUBLE / 10.0)::FLOAT::DOUBLE
                                                        * (((i * 37) % 19 - 9)::DOUBLE / 10.0))) AS logit
  FROM lines WHERE reason IS NULL)""", """p AS (
  SELECT request_id, topic, position, 1.0 / (1.0 + exp(-(logit + u))) AS p
  FROM vec CROSS JOIN (VALUES (0, 'race', 0.3), (1, 'region', -0.2), (2, 'gender', 0.1), (3, 'false', 0.0)) t(position, topic, u))""",
  "best AS (SELECT request_id, arg_max(topic, (p, -position)) AS topic, max(p) AS p FROM p GROUP BY request_id)",
  "named AS (SELECT request_id, CASE WHEN p >= 0.5 THEN topic ELSE 'false' END AS bias_type FROM best)") + """
SELECT 1099511627776 + row_number() OVER (ORDER BY request_id) - 1 AS id, request_id, md5(text) AS text_md5, bias_type, bias_type <> 'false' AS is_biased,
       CAST(CASE WHEN bias_type <> 'false' THEN 0.8 ELSE 0.2 END AS FLOAT) AS confidence, user_id
FROM vec JOIN named USING (request_id)"""

SQL["epoch_batches"] = with_(LABELLED, "n AS (SELECT count(*) AS n, sum(doc_id) AS ids FROM labelled)") + """
SELECT epoch::INTEGER AS epoch, n AS rows, (n + 15) // 16 AS batches, CASE WHEN n % 16 = 0 THEN 16 ELSE n % 16 END AS least, 16::BIGINT AS most,
       ((n // 16) * 120 + (n % 16) * (n % 16 - 1) // 2)::BIGINT AS places, n AS different, ids::BIGINT AS ids, n AS docs
FROM n, range(3) e(epoch)"""

SQL["subword_counts"] = r"""
WITH tok AS (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+|[^\s\p{L}\p{M}\p{N}]')) AS token FROM documents),
w AS (SELECT token, count(*) AS c FROM tok GROUP BY token),
p AS (SELECT c, regexp_extract_all(token, '(?s).') AS l FROM w),
pr AS (SELECT c, unnest(list_transform(range(len(l) - 1), lambda i: {'a': CASE WHEN i = 0 THEN l[1] ELSE '##' || l[i + 1] END, 'b': '##' || l[i + 2]})) AS x FROM p WHERE len(l) > 1)
SELECT x.a AS a, x.b AS b, sum(c)::BIGINT AS n FROM pr GROUP BY x.a, x.b
"""
