"""Schemas of the stored tables, as DDL."""

BBOX = "struct<l:double,t:double,r:double,b:double,coord_origin:string>"
TABLES = {
    "papers": (
        "paper_id string, user_id string, filename string, title string, abstract string, authors array<string>, "
        "publication_year int, venue string, doi string, arxiv_id string, source_url string, storage_uri string, "
        "status string, parse_status string, page_count int, title_confidence string, artifacts map<string,string>, "
        "warnings array<string>, error string, created_at timestamp, updated_at timestamp"
    ),
    "paper_sections": (
        "paper_id string, section_id string, heading string, section_path array<string>, level int, page_start int, "
        "page_end int, order_index bigint"
    ),
    "paper_elements": (
        "paper_id string, element_id string, section_id string, type string, label string, page int, text string, "
        f"bbox {BBOX}, source_ref string, order_index bigint, section_path array<string>"
    ),
    "visual_elements": (
        "paper_id string, element_id string, type string, page int, caption string, image_uri string, "
        "structured_data_uri string, enrichment_status string, enrichment_json string, needs_enrichment boolean, "
        f"docling_text string, bbox {BBOX}, source_ref string"
    ),
    "paper_chunks": (
        "paper_id string, chunk_id string, parent_chunk_id string, section_path array<string>, page_start int, "
        "page_end int, content string, chunk_type string, token_count int, embedding array<float>, embedding_model string"
    ),
    "jobs": (
        "job_id string, paper_id string, job_type string, status string, progress double, error string, result string, "
        "created_at timestamp, updated_at timestamp"
    ),
    "agent_conversations": (
        "conversation_id string, user_id string, title string, selected_papers array<string>, created_at timestamp, "
        "updated_at timestamp"
    ),
    "guest_sessions": (
        "session_id string, user_id string, queries_used bigint, papers_used bigint, images_used bigint, "
        "expires_at timestamp"
    ),
    "agent_messages": (
        "conversation_id string, order_index bigint, role string, content string, tool_name string, tool_call_id string, "
        "tool_calls array<struct<name:string,args:string,id:string,type:string>>, artifact string, status string, "
        "message_metadata struct<has_image:boolean,image_mime:string,image_decoded_bytes:int>"
    ),
}
CLEANED = (
    "paper_id string, element_id string, order bigint, page int, section array<string>, element_type string, label string, "
    "bounding_box struct<l:double,t:double,r:double,b:double>, coordinate_origin string, source_ref string, text string"
)
_VISUAL = "array<struct<element_id:string,page:int,caption:string,docling_text:string>>"
DOCUMENT = (
    "paper_id string, part bigint, title string, sections array<struct<section_id:string,heading:string,level:int,page_start:int,page_end:int>>, "
    "text_elements array<struct<element_id:string,order:bigint,page:int,section_path:array<string>,text:string>>, "
    f"tables {_VISUAL}, figures {_VISUAL}, formulas {_VISUAL}, references array<string>"
)
