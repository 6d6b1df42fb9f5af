"""Common table expressions of the SQL: the document model over the driver's tables."""

AUTHOR = "coalesce(regexp_replace(source, '[0-9]+$', '') || CASE WHEN regexp_extract(source, '([0-9]+)$', 1) = '' THEN '' ELSE lpad(regexp_extract(source, '([0-9]+)$', 1), greatest(length(regexp_extract(source, '([0-9]+)$', 1)), 2)::INT, '0') END, 'unknown')"
REC = f"""rec AS (
  SELECT doc_id, {AUTHOR} AS author_id, 'author:' || {AUTHOR} || ':doc-' || lpad(doc_id::VARCHAR, 7, '0') AS slug, lang,
    string_split(coalesce(text, ''), chr(10))[1] AS title, coalesce(source, '') AS guest, coalesce(lang, '') AS keywords,
    strftime(DATE '2024-01-01' + (doc_id % 365)::INT, '%Y-%m-%d') AS publish_date, coalesce(text, '') AS content,
    trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS transcript
  FROM documents)"""
BRIDGE = """bridge AS (
  SELECT slug, 'lang-' || lang AS category_slug FROM rec WHERE lang IS NOT NULL UNION
  SELECT slug, 'quality-' || quality FROM rec JOIN labels USING (doc_id) WHERE quality IS NOT NULL UNION
  SELECT slug, 'toxic-' || toxic FROM rec JOIN labels USING (doc_id) WHERE toxic IS NOT NULL)"""
EVENTS = """ev AS (
  SELECT event_id AS line, 'author:u' || lpad(user_id::VARCHAR, 5, '0') AS source_id,
    CASE event_type WHEN 'signup' THEN 'import' WHEN 'purchase' THEN 'refresh' WHEN 'error' THEN 'delete' ELSE event_type END AS action,
    strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS at_, coalesce(floor(value)::BIGINT, 0) AS document_count
  FROM events),
good AS (SELECT * FROM ev WHERE action IN ('import', 'refresh', 'delete') AND source_id IS NOT NULL AND at_ IS NOT NULL)"""
