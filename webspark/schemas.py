"""Schemas of the records the engine reads and makes, as DDL."""

FETCH_RESULT = "url string, final_url string, html string, status_code int, content_type string, fetch_time double, success boolean, error string, engine string"
EXTRACTED_LINK = "url string, text string, context string, is_internal boolean"
QUEUE_ITEM = "priority int, depth int, queued_at timestamp, url string, parent_url string, context map<string,string>"
SEED_URL = "url string, title string, snippet string, source string, seed_rank int, relevance_score double"
PRIORITIZED_URL = "url string, priority int, reason string, link_text string"
ANALYSIS_RESULT = (
    f"url string, relevance_score double, key_findings array<string>, extracted_data string, summary string, prioritized_urls array<struct<{PRIORITIZED_URL.replace(' ', ':').replace(',:', ', ')}>>,"
    " analysis_time double, model_used string, raw_response string, success boolean, error string"
)
STORED_FILE = "url string, filename string, content_hash string, size_bytes bigint, created_at timestamp, category string, stage string"
CHUNK = "chunk_id int, chunk string, chunk_start int, chunk_end int"
