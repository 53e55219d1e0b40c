"""Canonical schemas of the tables, as DDL."""

ATTACHMENT = (
    "struct<type:string,storage_refs:array<struct<bucket:string,object:string>>,transcription:string,transcription_status:string,"
    "transcription_language:string,transcription_language_probability:double>"
)
CLASSIFICATION = "struct<classified:boolean,score_pos:double,error:string,processed_at:timestamp_ntz>"
MESSAGES = f"id string, chat_id string, date timestamp_ntz, language string, text string, caption string, attachment {ATTACHMENT}, classification {CLASSIFICATION}"
TEXT_VECTORS = "message_id string, chat_id string, language string, date timestamp_ntz, processed_at timestamp_ntz, source_field string, vector array<float>"
IMAGE_VECTORS = "message_id string, chat_id string, date timestamp_ntz, processed_at timestamp_ntz, attachment_type string, vector array<float>"
SEARCH_HITS = "id string, score double"
