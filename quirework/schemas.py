"""The tables of a book, as Spark DDL. Every one is keyed by book_id."""

RECT = "struct<left:double,top:double,right:double,bottom:double>"
REGION = f"struct<page:int,rect:{RECT}>"
CELL = f"struct<text:string,chars:int,rect:{RECT}>"

TEXT_ITEMS = "book_id string, page int, item_idx int, text string, left double, right double, baseline double, font_size double, ascent double, descent double, bold boolean"
DOC_PAGES = "book_id string, page int, width double, height double, rotation int, columns int, has_text boolean, ink array<double>, ink_map struct<width:int,height:int,bits:binary>, dark struct<width:int,height:int,dark:binary>"
LINES = f"book_id string, page int, line_idx int, text string, rect {RECT}, font_size double, column int, chars int, bold boolean, header_footer boolean, parts array<struct<text:string,chars:int,rect:{RECT},cells:array<{CELL}>>>, cells array<{CELL}>"
OUTLINE = "book_id string, idx int, title string, page int, depth int, id string, label string, top double"
FRAMES = f"book_id string, id string, kind string, page int, rect {RECT}, unit string, continues array<{REGION}>, context array<{REGION}>, solution array<{REGION}>, authority string, label string, section string"
BOOKS = "book_id string, revision int, created_at string, updated_at string, modified_by string, pdf struct<path:string,sha256:string,bytes:bigint,page_count:int>, meta struct<title:string,folder:string,author:string,series:string,description:string,source_url:string,notice:string,license:struct<name:string,url:string>>, outline_source string, seq int, extra map<string,string>"
OPERATIONS = "book_id string, seq_no int, payload string"
REFERENCE = "book_id string, label string, title string, count int, chapter_label string, chapter_title string"
SURVEY = "book_id string, entry_idx int, from int, to int, kind string, note string"
VISUAL = "book_id string, entry_idx int, ref string, starts_with string, instruction boolean, answer_starts_with string, ok boolean, defect string"
NOTES = "book_id string, note_idx int, code string, ref string, page int, reason string, evidence struct<page:int,quote:string>, by string, count int, confirmed boolean, confirmed_by string, confirmed_at string"
CALL_LOG = "surface string, tool string, arguments string, ok boolean, error string, exit_code int"
