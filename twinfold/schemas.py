"""Types of the rows that pass between stages."""

LIST = "struct<ordered:boolean,depth:int,ordinal:int,checked:boolean>"
LINK = "struct<text:string,rawHref:string,resolved:string,masked:boolean>"
BLOCK = f"idx int, type string, text string, loose string, depth int, cells array<array<string>>, spanned boolean, code string, list {LIST}, links array<{LINK}>, numbers array<string>, line int, path string"
BLOCKS = f"pair_id string, side string, {BLOCK}"
ISSUE = "struct<code:string,severity:string,message:string,line:int,excerpt:string>"
EXTRACTIONS = f"pair_id string, side string, strategy string, confidence string, notes array<string>, issues array<{ISSUE}>, error string, error_value string"
SIDE = "struct<line:int,path:string,blockIndex:int,excerpt:string>"
FINDING = f"struct<code:string,severity:string,direction:string,message:string,html:{SIDE},markdown:{SIDE},before:string,after:string>"
COVERAGE = "struct<htmlBlocks:int,markdownBlocks:int,htmlMatched:int,markdownMatched:int,htmlRatio:double,markdownRatio:double>"
PAIR_RESULT = f"pair_id string, strategy string, confidence string, notes array<string>, findings array<{FINDING}>, coverage {COVERAGE}, error string, error_value string"
ALIGNED = "pair_id string, a int, b int, kind string, similarity double, reordered boolean"
#: Columns of pairs that may be missing, with what stands for them.
PAIR_DEFAULTS = {"html_base": "string", "md_base": "string", "kind": "string", "md_status": "int", "md_content_type": "string"}
