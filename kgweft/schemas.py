"""Schemas of the stored and exchanged records, as DDL."""

DOCUMENT = "id string, title string, abstract string, authors array<string>, source string, url string, published_date string, citations bigint"
MENTION = "seq bigint, subject string, predicate string, obj string, confidence double, source_id string, subject_type string, obj_type string"
ENTITY = (
    "name string, type string, mention_count bigint, created bigint, updated bigint, url string, source string, "
    "citations bigint, text string, embedding array<float>, summary string"
)
RELATION = (
    "subject string, subject_type string, predicate string, obj string, obj_type string, sources array<string>, confidence double, first_seen bigint, last_seen bigint, mention_count bigint"
)
DOCUMENT_TYPES = ["Paper", "Document"]
UNKNOWN = "unknown"
