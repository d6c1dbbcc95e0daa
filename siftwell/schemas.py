"""Schemas of the data model, as DDL."""

ENTITIES = (
    "id string, type string, name string, qualified_name string, content string, summary string, metadata map<string,string>, "
    "file_path string, start_line int, end_line int, hash string, created_at timestamp, updated_at timestamp"
)
RELATIONSHIPS = "id string, source_id string, target_id string, relationship string, weight double, metadata map<string,string>, created_at timestamp"
VECTORS = "entity_id string, model_id string, chunk_index int, content_hash string, embedding array<float>, created_at timestamp"
SESSIONS = "id string, name string, status string, summary string, created_at timestamp, updated_at timestamp, archived_at timestamp"
MESSAGES = (
    "id string, session_id string, position int, role string, content string, "
    "metadata struct<model:string,tokens:struct<input:int,output:int>,latency:double>, created_at timestamp"
)
SUMMARIES = (
    "id string, session_id string, version int, summary string, topics array<string>, decisions array<string>, code_references array<string>, "
    "key_points array<string>, message_range_start string, message_range_end string, message_count int, model string, created_at timestamp"
)
DECISIONS = (
    "id string, session_id string, message_id string, description string, context string, alternatives array<string>, "
    "related_entity_ids array<string>, status string, superseded_by string, created_at timestamp"
)
FEEDBACK = "id string, query_id string, entity_id string, signal string, query_text string, metadata map<string,string>, created_at timestamp"
MEMORY = (
    "id string, session_id string, content string, type string, tier string, access_count int, last_accessed_at timestamp, created_at timestamp, "
    "relevance_score double, token_count int, metadata map<string,string>, embedding array<double>"
)
REFLECTIONS = (
    "id string, session_id string, task_description string, attempt_number int, outcome string, what_worked array<string>, "
    "what_did_not_work array<string>, next_strategy string, tags array<string>, related_entity_ids array<string>, embedding_json string, created_at timestamp"
)
SUBSCRIPTIONS = "id string, session_id string, patterns array<string>, min_relevance_score double, max_suggestions int, cooldown_ms long, last_triggered_at timestamp, enabled boolean"
SUGGESTIONS = "id string, session_id string, status string, used_item_index int, created_at timestamp"
CHECKPOINTS = "id string, session_id string, step_number int, state string, description string, trigger_type string, duration_ms long, token_usage int, created_at timestamp"
#: Types of entities and of relationships.
ENTITY_TYPES = (
    "file", "module", "class", "function", "method", "interface", "type", "enum", "variable", "constant", "property", "document", "section", "requirement",
    "feature", "user-story", "concept", "technology", "pattern", "component", "service", "task", "milestone", "person", "session", "message", "decision",
    "question", "summary", "instruction",
)


def invalid(df, ddl: str) -> list[str]:
    """Columns of the schema that a table lacks or has with another type."""
    from pyspark.sql.types import StructType

    want = {f.name: f.dataType.simpleString() for f in StructType.fromDDL(ddl).fields}
    have = dict(df.dtypes)
    return [c for c, t in want.items() if have.get(c) != t]
