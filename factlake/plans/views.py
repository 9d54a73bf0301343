"""Input tables of the operators as views over the driver tables.

Each text runs unchanged on Spark SQL and on DuckDB.
"""

VIEWS: dict[str, str] = {}

VIEWS["fx_messages"] = r"""
SELECT c.conv_id * 1000 + c.turn AS msg_id, 'org' || (c.conv_id % 4) AS org_id, 'C' || (c.conv_id % 8) AS channel_id,
  (c.conv_id % 8) % 2 = 1 AS channel_is_private,
  CASE c.role WHEN 'system' THEN 'B' || c.conv_id WHEN 'assistant' THEN 'UA' || (c.conv_id % 5) ELSE 'U' || (c.conv_id % 20) END AS user_id,
  CASE WHEN c.conv_id % 11 = 0 AND c.turn = 0 THEN 'channel_join' END AS subtype,
  (1700000000 + c.conv_id * 1000 + c.turn) || '.000100' AS ts, (1700000000 + c.conv_id * 1000) || '.000100' AS thread_ts,
  CASE (c.conv_id + c.turn) % 9 WHEN 0 THEN 'Thanks' WHEN 1 THEN ':tada: :party_popper: :white_check_mark:' WHEN 2 THEN c.text || ' *Sent using* ChatGPT.' WHEN 3 THEN '   ' WHEN 4 THEN 'sent via ChatGPT ' || c.text ELSE c.text END AS content
  FROM conversations c
"""

VIEWS["fx_sources"] = r"""
SELECT d.doc_id AS id, 'org' || (d.doc_id % 4) AS org_id,
  CASE d.doc_id % 4 WHEN 0 THEN 'slack_history' WHEN 1 THEN 'slack_daily' WHEN 2 THEN 'email' ELSE 'document' END AS source_type,
  d.text AS raw_content, e.ts AS created_at, CASE WHEN d.doc_id % 3 > 0 THEN e.ts END AS processed_at,
  CASE WHEN d.doc_id % 5 > 0 THEN 'C' || (d.doc_id % 8) END AS channel_id, (d.doc_id % 8) % 2 = 1 AS channel_is_private,
  'https://acme.slack.com/archives/C' || (d.doc_id % 8) || '/p' || d.doc_id AS permalink
  FROM documents d JOIN events e ON e.event_id = d.doc_id
"""

VIEWS["fx_entities"] = r"""
SELECT v.vec_id AS id, 'org' || (v.vec_id % 4) AS org_id,
  CASE v.label % 6 WHEN 0 THEN 'Client' WHEN 1 THEN 'Project' WHEN 2 THEN 'Decision' WHEN 3 THEN 'Person' WHEN 4 THEN 'Process' ELSE 'Belief' END AS entity_type,
  CASE WHEN v.vec_id % 13 > 0 THEN 'Entity ' || (v.vec_id % 60) END AS name, 'Fact ' || v.vec_id || ' about label ' || v.label AS content,
  CASE WHEN v.vec_id % 17 > 0 THEN v.vec_id END AS source_id,
  CASE WHEN v.vec_id % 7 = 0 THEN 'superseded' ELSE 'active' END AS status, CASE WHEN v.vec_id % 7 = 0 THEN e.ts END AS superseded_at,
  CASE WHEN v.vec_id % 19 > 0 THEN v.embedding END AS embedding, e.ts AS created_at
  FROM embeddings v JOIN events e ON e.event_id = v.vec_id
"""

VIEWS["fx_memberships"] = r"""
SELECT DISTINCT 'org' || (event_id % 4) AS org_id, 'C' || (event_id % 8) AS channel_id, 'U' || (user_id % 20) AS user_id FROM events WHERE (event_id % 8) % 2 = 1
"""

VIEWS["fx_candidates"] = r"""
SELECT d.doc_id AS seq, 'org' || ((d.doc_id - d.doc_id % 3) % 4) AS org_id, d.doc_id - d.doc_id % 3 AS source_id,
  CASE d.doc_id % 6 WHEN 0 THEN 'Client' WHEN 1 THEN 'Project' WHEN 2 THEN 'Decision' WHEN 3 THEN 'Person' WHEN 4 THEN 'Process' ELSE 'Belief' END AS entity_type,
  CASE WHEN d.doc_id % 13 > 0 THEN 'Entity ' || (d.doc_id % 60) END AS name, d.text AS content,
  COALESCE(l.quality = 1, d.doc_id % 2 = 0) AS approved, CAST((d.doc_id * 37) % 101 AS DOUBLE) / 100 AS confidence_score, 'reason ' || (d.doc_id % 5) AS critic_reason
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
"""

VIEWS["fx_usage"] = r"""
SELECT event_id, 'org' || (user_id % 4) AS org_id, substr(CAST(ts AS STRING), 1, 7) AS month, CAST(floor(value * 100) AS BIGINT) AS tokens FROM events
"""

VIEWS["fx_beats"] = r"""
SELECT event_id, CASE event_type WHEN 'click' THEN 'micro_batch' WHEN 'view' THEN 'backfill_processor' WHEN 'purchase' THEN 'daily_ingestion' WHEN 'signup' THEN 'slack_health' ELSE 'daily_briefings' END AS process_name,
  ts AS beat_at, CASE WHEN value > 100 THEN 'error' ELSE 'ok' END AS status, CASE WHEN value > 100 THEN 'value ' || event_id END AS error FROM events
"""

VIEWS["fx_edges"] = r"""
SELECT 2000000 + n_nationkey AS from_id, 1000000 + n_regionkey AS to_id, 'part_of' AS relationship_type FROM nation
  UNION ALL SELECT 3000000 + s_suppkey, 2000000 + s_nationkey, 'belongs_to' FROM supplier
  UNION ALL SELECT 4000000 + c_custkey, 2000000 + c_nationkey, 'works_on' FROM customer
  UNION ALL SELECT 4000000 + o_custkey, 3000000 + o_orderkey % 10, 'assigned_to' FROM orders
"""

VIEWS["fx_replies"] = r"""
SELECT doc_id AS source_id, CASE doc_id % 5 WHEN 0 THEN 'not json' WHEN 1 THEN '[1, 2]' WHEN 2 THEN '{"entities": "oops"}'
  WHEN 3 THEN '```json' || chr(10) || '{"entities": [{"entity_type": "Person", "name": "P' || doc_id || '", "content": "c' || doc_id || '"}], "relationships": []}' || chr(10) || '```'
  ELSE '{"entities": [{"entity_type": "Client", "name": "K' || doc_id || '", "content": "k"}, {"entity_type": "Person", "name": "Q' || doc_id || '", "content": "q"}], "relationships": [{"from_name": "Q' || doc_id || '", "from_type": "Person", "relationship_type": "owns", "to_name": "K' || doc_id || '", "to_type": "Client"}]}' END AS reply FROM documents
"""

VIEWS["fx_golden"] = r"""
SELECT l.doc_id AS id, 'org' || (l.doc_id % 4) AS org_id, 'Question ' || l.doc_id AS question, 'Answer ' || l.doc_id AS expected_answer, CASE WHEN l.quality = 1 THEN ' pass' ELSE 'FAIL' END AS verdict FROM labels l
"""

VIEWS["fx_contacts"] = r"""
SELECT c_custkey AS id, 'org' || (c_custkey % 4) AS org_id, split_part(c_name, '#', 1) AS firstName, split_part(c_name, '#', 2) AS lastName, lower(c_mktsegment) || '@example.com' AS email, c_mktsegment AS company FROM customer
"""

VIEWS["fx_deals"] = r"""
SELECT o_orderkey AS id, 'org' || (o_orderkey % 4) AS org_id, CASE WHEN o_orderkey % 9 > 0 THEN 'Order ' || o_orderkey END AS dealname, o_orderstatus AS dealstage, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS STRING) AS amount FROM orders
"""

VIEWS["fx_nodes"] = r"""
SELECT 1000000 + r_regionkey AS entity_id, 'org' || (r_regionkey % 4) AS org_id, 'Client' AS entity_type, r_name AS name, 'Region ' || r_name AS content FROM region
  UNION ALL SELECT 2000000 + n_nationkey, 'org' || (n_nationkey % 4), 'Project', n_name, 'Nation ' || n_name FROM nation
  UNION ALL SELECT 3000000 + s_suppkey, 'org' || (s_suppkey % 4), 'Process', s_name, 'Supplier ' || s_name FROM supplier
  UNION ALL SELECT 4000000 + c_custkey, 'org' || (c_custkey % 4), 'Person', c_name, 'Customer ' || c_name FROM customer
"""

VIEWS["fx_profiles"] = r"""
SELECT s_suppkey AS id, 'org' || s_suppkey AS org_id,
  substr(md5('org' || s_suppkey), 1, 8) || '-' || substr(md5('org' || s_suppkey), 9, 4) || '-4000-8000-' || substr(md5('org' || s_suppkey), 13, 12) AS org_uuid,
  s_name AS business_name, CASE WHEN s_suppkey % 5 > 0 THEN 'Industry ' || s_nationkey END AS industry, 'Services of ' || s_name AS core_services,
  CASE WHEN s_suppkey % 3 > 0 THEN 'Nothing in nation ' || s_nationkey END AS what_they_dont_do, s_nationkey AS team_size,
  CASE s_suppkey % 4 WHEN 0 THEN 'acme' || s_suppkey || '.slack.com' WHEN 1 THEN 'acme' || s_suppkey WHEN 2 THEN '' END AS slack_workspace_domain,
  CASE s_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'Focus on ' || s_name END AS briefing_focus
  FROM supplier
"""

VIEWS["fx_pending"] = r"""
SELECT c.seq AS id, c.org_id, c.source_id, c.entity_type, c.name, c.content, c.critic_reason, c.confidence_score,
  CASE WHEN c.seq % 4 = 0 THEN 'contradiction' ELSE 'standard' END AS review_type, e.ts AS created_at
  FROM fx_candidates c JOIN events e ON e.event_id = c.seq
  WHERE c.confidence_score >= 0.5 AND NOT (c.approved AND c.confidence_score >= 0.7)
"""

VIEWS["fx_logs"] = r"""
SELECT event_id AS id, 'org' || (user_id % 4) AS org_id,
  CASE event_type WHEN 'click' THEN 'daily_briefing' WHEN 'view' THEN 'rejected_entity' WHEN 'purchase' THEN 'pipeline_paused' WHEN 'signup' THEN 'eval_result' ELSE 'contradiction_flag' END AS log_type,
  'Log ' || event_id || ' ' || props AS content, ts AS created_at FROM events
"""

VIEWS["fx_questions"] = r"""
SELECT vec_id AS query_id, 'org' || (vec_id % 4) AS org_id, 'U' || (vec_id % 20) AS user_id,
  CASE vec_id % 3 WHEN 0 THEN 'Who OWNS Entity ' || vec_id || '?' WHEN 1 THEN 'Status of label ' || label ELSE 'Please tell me about Entity ' || vec_id END AS question,
  CASE vec_id % 3 WHEN 0 THEN 'draft' WHEN 1 THEN 'flag' ELSE 'other' END AS task_type, embedding AS vector FROM embeddings
"""

VIEWS["fx_critic"] = r"""
SELECT doc_id AS seq, CASE doc_id % 10 WHEN 0 THEN '{"approved": true, "confidence_score": 0.95, "reason": "clear ' || doc_id || '"}'
  WHEN 1 THEN '```json' || chr(10) || '{"approved": true, "confidence_score": 0.75, "reason": "fenced"}' || chr(10) || '```'
  WHEN 2 THEN '{"approved": true, "confidence_score": "0.8"}' WHEN 3 THEN '{"approved": "yes", "confidence_score": true, "reason": "r"}'
  WHEN 4 THEN ' {"confidence_score": 0.55} ' WHEN 5 THEN 'no json' WHEN 6 THEN '[0.9]' WHEN 7 THEN '{"approved": true}'
  WHEN 8 THEN '{"approved": 0, "confidence_score": 1}' ELSE '{"approved": false, "confidence_score": null}' END AS reply FROM documents
"""

VIEWS["fx_checks"] = r"""
SELECT vec_id AS id, CASE vec_id % 5 WHEN 0 THEN '{"contradiction": true, "reason": "clash ' || vec_id || '"}'
  WHEN 1 THEN '```json' || chr(10) || '{"contradiction": true, "reason": "fenced clash"}' || chr(10) || '```' WHEN 2 THEN 'maybe'
  WHEN 3 THEN '{"contradiction": false, "reason": "fine"}' ELSE '{"reason": "no flag"}' END AS reply,
  CASE vec_id % 6 WHEN 0 THEN '{"conflict": true, "belief": "Belief ' || vec_id || '", "reason": "x"}' WHEN 1 THEN '?' WHEN 2 THEN '{}' ELSE '{"conflict": false, "belief": "", "reason": "ok"}' END AS belief_reply,
  'Draft ' || vec_id AS draft FROM embeddings
"""

VIEWS["fx_batch_replies"] = r"""
SELECT doc_id AS batch_id, 1 + doc_id % 10 AS n, CASE doc_id % 4 WHEN 0 THEN 'broken' WHEN 1 THEN '{"message_index": 0}'
  ELSE '[{"message_index": 0, "entities": [{"entity_type": "Client", "name": "A' || doc_id || '", "content": "first"}], "relationships": []}, {"message_index": 3, "entities": [{"entity_type": "Client", "name": "B' || doc_id || '", "content": "old"}]}, {"message_index": 3, "entities": [{"entity_type": "Person", "name": "C' || doc_id || '", "content": "new"}, {"entity_type": "Person", "name": "D' || doc_id || '", "content": "new"}]}, {"message_index": 99, "entities": [{"entity_type": "Client", "name": "Z", "content": "z"}]}, {"entities": []}, {"message_index": -1}]' END AS reply FROM documents
"""

VIEWS["fx_inbound"] = r"""
SELECT d.doc_id AS id, CASE d.doc_id % 5 WHEN 0 THEN substr(md5('org' || (d.doc_id % 10)), 1, 8) || '@in.example.com'
  WHEN 1 THEN ' ' || upper(substr(md5('org' || (d.doc_id % 10)), 1, 8)) || '@in.example.com'
  WHEN 2 THEN substr(md5('org' || (d.doc_id % 10)), 1, 8) || '-' || substr(md5('org' || (d.doc_id % 10)), 9, 4) || '-4000-8000-' || substr(md5('org' || (d.doc_id % 10)), 13, 12) || '@in.example.com'
  WHEN 3 THEN 'nobody@in.example.com' ELSE substr(md5('org' || (d.doc_id % 10)), 1, 8) END AS recipient,
  d.source || '@example.com' AS sender, 'Subject ' || d.doc_id AS subject, CASE WHEN d.doc_id % 7 = 0 THEN '  ' ELSE ' ' || d.text || ' ' END AS body_plain,
  CASE d.doc_id % 3 WHEN 0 THEN ' ' WHEN 1 THEN '' ELSE CASE WHEN d.doc_id % 7 = 0 THEN chr(10) ELSE 'Stripped ' || d.lang END END AS stripped_text FROM documents d
"""

VIEWS["fx_export"] = r"""
SELECT c.conv_id * 1000 + c.turn AS msg_id, 'org' || (c.conv_id % 4) AS org_id, 'C' || (c.conv_id % 8) AS channel_id,
  CASE WHEN c.turn % 7 = 6 THEN 'file' ELSE 'message' END AS type, CASE WHEN c.turn % 5 = 4 THEN '' ELSE c.text END AS text,
  CASE c.role WHEN 'system' THEN NULL ELSE 'U' || (c.conv_id % 20) END AS user, CAST(NULL AS STRING) AS subtype,
  (1700000000 + c.conv_id * 40000 + c.turn) || '.000100' AS ts, (1700000000 + c.conv_id * 40000) || '.000100' AS thread_ts FROM conversations c
"""

VIEWS["fx_channels"] = r"""
SELECT 'org' || (c_custkey % 4) AS org_id, 'C' || c_custkey AS id, c_name AS name,
  CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS is_private FROM customer
"""

VIEWS["fx_channel_members"] = r"""
SELECT DISTINCT 'org' || (o_custkey % 4) AS org_id, 'C' || o_custkey AS channel_id, 'U' || (o_orderkey % 20) AS user_id FROM orders
"""

VIEWS["fx_supersede"] = r"""
SELECT v.vec_id AS seq, 'org' || (v.vec_id % 4) AS org_id, v.vec_id AS old_id, v.vec_id + 4 * (1 + v.label) AS new_id FROM embeddings v
"""
