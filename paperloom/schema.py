"""Schemas of the library's tables."""

TABLES = {
    "knowledge_bases": "id string, name string, description string, color string, created_at bigint",
    "papers": "id string, knowledge_base_id string, title string, authors array<string>, abstract string, year int, tags array<string>, status string, file_name string, file_path string, added_at bigint",
    "conversations": "id string, title string, paper_ids array<string>, created_at bigint",
    "messages": "id string, conversation_id string, role string, content string, sources array<string>, timestamp bigint",
    "highlights": "id string, paper_id string, text string, page_num int, color string, note string, created_at bigint",
    "settings": "key string, value string",
    "paper_pages": "paper_id string, page_no int, text string",
    "section_roots": "paper_id string, title string, summary string, start_page int, end_page int, n_leaves int",
    "section_leaves": "paper_id string, leaf_no int, title string, summary string, start_page int, end_page int",
}
PROFILE = "struct<id:string,name:string,provider:string,model:string,apiKey:string,baseUrl:string,temperature:double,maxTokens:int,topK:int,systemPrompt:string>"
#: The collection that exists in every library.
DEFAULT_KB = {"id": "default", "name": "My Library", "description": "", "color": "#3db8a0"}
