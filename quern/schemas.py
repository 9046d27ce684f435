"""Explicit schemas of the domain tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


SOURCE = "struct<source_uri:string,source_type:string,filename:string,mime_type:string,size_bytes:bigint>"
PLAN = (
    "struct<parser:struct<provider:string,mode:string>,"
    "chunking:struct<strategy:string,target_size:int,overlap:int>,"
    "embedding:struct<provider:string,model:string>,"
    "indexing:struct<backend:string,index_name:string>>"
)
SECTION = "struct<section_id:string,title:string,start_offset:int,end_offset:int>"
TRACE_EVENT = (
    "struct<stage:string,level:string,status:string,message:string,at:timestamp,metadata:map<string,string>>"
)

DDL = {
    "parsed_documents": f"document_id string, title string, language string, page_count int, text string, sections array<{SECTION}>, metadata map<string,string>",
    "chunks": "document_id string, chunk_id string, chunk_index int, text string, char_count int, section_path array<string>, start_offset int, end_offset int, page_number int",
    "artifacts": "chunk_id string, document_id string, vector array<float>, dimensions int, vector_ref string, model string",
    "index_records": "record_id string, knowledge_base_id string, document_id string, chunk_id string, chunk_index int, title string, content string, vector array<float>, tenant_id string, org_id string, index_name string, section_path array<string>, metadata map<string,string>",
    "index_metadata": "record_id string, knowledge_base_id string, document_id string, chunk_id string, chunk_index int, title string, tenant_id string, org_id string, metadata map<string,string>",
    "queries": "query_id string, query string, top_k int, tenant_id string, org_id string, knowledge_base_ids array<string>, filters map<string,string>",
    "tasks": f"task_id string, trace_id string, knowledge_base_id string, document_id string, tenant_id string, org_id string, status string, current_stage string, source {SOURCE}, plan {PLAN}, attempt_count int, max_attempts int, retryable boolean, next_run_at timestamp, lease_expires_at timestamp, idempotency_key string, failure_stage string, failure_reason string, error_source string, terminal_state string, terminal_reason string, dead_letter boolean, dead_lettered_at timestamp, created_at timestamp, updated_at timestamp, finished_at timestamp, trace array<{TRACE_EVENT}>",
    "trace_events": "trace_id string, run_id string, conversation_id string, stage string, node_id string, node_type string, parent_node_id string, status string, started_at timestamp, finished_at timestamp, duration_ms bigint, metadata map<string,string>",
    "conversations": "conversation_id string, user_id string, tenant_id string, org_id string, title string, created_at timestamp, updated_at timestamp",
    "messages": "message_id string, conversation_id string, position bigint, role string, content string, created_at timestamp, metadata string",
    "knowledge_bases": "knowledge_base_id string, name string, tenant_id string, org_id string, document_count bigint, updated_at timestamp",
    "mappings": "mapping_id string, source_term string, target_term string, enabled boolean",
    "intents": "intent_id string, parent_intent_id string, name string, priority int, route_expression string, knowledge_base_ids array<string>, enabled boolean",
    "settings": "key string, value string, description string, updated_at timestamp",
    "sample_questions": "sample_id string, question string, enabled boolean",
    "users": "user_id string, name string, role string, tenant_id string, org_id string, created_at timestamp",
    "eval_cases": "case_id string, question string, truths array<string>, knowledge_base_id string",
    "rate_requests": "client string, at_seconds double",
}


def schema(name: str) -> T.StructType:
    """The schema of a domain table; needs an active session."""
    return _struct(DDL[name])
