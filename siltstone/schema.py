"""Schemas of the stored tables."""

from __future__ import annotations

METADATA = "map<string,string>"
CHUNKS = f"id string, namespace string, vector array<float>, content string, relative_path string, start_line int, end_line int, file_extension string, language string, metadata {METADATA}"
#: Metadata kept as columns too, so that filters on them reach the parquet scan (a map entry's doesn't).
PROMOTED = ("absolute_path", "domain_path", "experience_kind", "document_id", "section_id", "heading_path", "knowledge_kind", "node_kind", "version", "symbol_name", "symbol_kind", "chunk_kind", "role", "tool_name", "command", "status", "tags")
FILTERED = ("domain_path", "document_id", "section_id", "heading_path", "knowledge_kind", "node_kind", "version")
MEMORY = f"id string, content string, summary string, role string, conversation_id string, message_id string, tool_name string, relative_path string, line int, importance double, experience_kind string, domain_path string, tags array<string>, metadata {METADATA}, created_at string, updated_at string"
EXPECTATION = f"struct<result_id:string,content_hash:string,category:string,source_type:string,source_id:string,namespace:string,relative_path:string,start_line:int,end_line:int,document_id:string,section_id:string,heading_path:string,knowledge_kind:string,node_kind:string,version:string,domain_path:string,content_contains:string,metadata:{METADATA}>"
EVAL_CASE = f"id string, instance_id string, query string, problem_statement string, expected array<{EXPECTATION}>, expected_results array<{EXPECTATION}>, oracles array<{EXPECTATION}>, oracle_files array<string>, patch string, `limit` int, types string, search_types array<string>"
CATALOG = f"scope struct<scope_type:string,scope_id:string>, source struct<source_type:string,source_id:string,tool_name:string,metadata:{METADATA}>, version bigint, checksum string, indexed_at timestamp, status string, document_count int, memory_count int, knowledge_count int, metadata {METADATA}"
FILE_STATES = "namespace string, relative_path string, hash string, size bigint, mod_time_ns bigint"
SNAPSHOTS = "path string, namespace string, status string, indexed_files int, total_chunks int, error_message string, updated_at timestamp"
SESSION = "id string, returned_result_keys array<string>, returned_content_hashes array<string>, created_at timestamp, updated_at timestamp"
NODE = f"struct<kind:string,content:string,document_id:string,section_id:string,heading_path:array<string>,knowledge_kind:string,start_line:int,end_line:int,metadata:{METADATA}>"

SCOPE_TYPES = ("user", "workspace", "codebase", "tool")
SOURCE_TYPES = ("codebase", "document", "external_knowledge", "conversation", "experience", "preference", "tool_history", "fact")
STATUSES = ("indexed", "indexing", "failed")
