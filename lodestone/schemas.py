"""Tables' schemas, as Spark DDL."""

CELL = "text string, row_span int, col_span int, start_row_offset_idx int, end_row_offset_idx int, start_col_offset_idx int, end_col_offset_idx int, column_header boolean, row_header boolean, row_section boolean"
CELL_FIELDS = tuple(f.split()[0] for f in CELL.split(", "))
BOX = "l double, t double, r double, b double, coord_origin string"
STRUCTURED = f"num_rows int, num_cols int, orientation string, cells array<struct<{CELL.replace(' ', ':').replace(',:', ',')},bbox:struct<{BOX.replace(' ', ':').replace(',:', ',')}>>>"
#: A stored record: one line of JSON.
ENVELOPE = (
    "schema_version string, record_id string, parent_id string, content_type string, "
    "source struct<document_id:string,source_filename:string,pages:array<int>,locators:struct<table_index:int,refs:array<string>>>, "
    "content struct<text:string,markdown:string>, "
    "metadata struct<token_count:int,tokenizer_name:string,headings:array<string>,chapter:string,caption:array<string>,table_index:int,num_rows:int,num_cols:int>"
)
RECORD = "record_id string, parent_id string, content_type string, document_id string, title string, pages array<int>, text string, token_count int"
PARENT = "record_id string, document_id string, title string, pages array<int>, text string, num_rows int, num_cols int"
QUESTION = "qid long, question string"
INDEX = "record_id string, parent_id string, content_type string, title string, start_page int, end_page int, text string, content_hash string, embedding array<float>"
INDEX_META = "embedding_model string, embedding_dimension int, embedding_fingerprint string"
#: Items of a parsed document, in order.
ITEM = "ordinal long, self_ref string, label string, text string, parent_ref string, pages array<int>"
SCHEMA_VERSION = "1.0.0"
CONTENT_TYPES = ("text", "table_parent", "table_child")
#: A parsed document: one JSON value. References are `$ref` in the file.
DOCUMENT = (
    "name string, origin struct<filename:string>, "
    "texts array<struct<self_ref:string,label:string,text:string,headings:array<string>,parent:struct<ref:string>,prov:array<struct<page_no:int>>>>, "
    f"tables array<struct<self_ref:string,captions:array<struct<ref:string,text:string>>,footnotes:array<struct<ref:string,text:string>>,prov:array<struct<page_no:int,bbox:struct<{BOX.replace(' ', ':').replace(',:', ',')}>>>,"
    f"data:struct<num_rows:int,num_cols:int,orientation:string,grid:array<array<struct<text:string>>>,table_cells:array<struct<{CELL.replace(' ', ':').replace(',:', ',')},bbox:struct<{BOX.replace(' ', ':').replace(',:', ',')}>>>>>>, "
    "pictures array<struct<self_ref:string,captions:array<struct<ref:string,text:string>>,footnotes:array<struct<ref:string,text:string>>>>"
)
