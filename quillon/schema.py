"""Tables of the corpus, as Spark DDL."""

PROVISION = "struct<law:string,gr:int,mgr:int,sfx:string>"
PARTY = "struct<name:string,lawyer:string>"
PAGE_OFFSET = "struct<char:int,pdf_page:int,printed:int>"

SOURCES = "source_id string, short_name string, name string, abbreviation string"
DOCUMENTS = (
    "doc_id string, source_short string, external_id string, court string, case_number string, document_date date, verdict_type string, instance_tier smallint, lang string, "
    f"summary string, body_text string, lower_body_text string, keywords array<string>, plaintiffs array<{PARTY}>, defendants array<{PARTY}>, "
    f"cited_provisions array<{PROVISION}>, page_offsets array<{PAGE_OFFSET}>, created_at timestamp_ntz, updated_at timestamp_ntz"
)
PASSAGES = (
    "doc_id string, ordinal int, layer string, section_path string, section_kind string, para_from int, para_to int, "
    "char_start int, char_end int, text string, word_count int, page_from int, page_to int"
)
CITATIONS = (
    "from_doc_id string, layer string, char_start int, char_end int, raw_text string, target_court string, "
    "target_case_number string, target_date date, target_verdict string, form string"
)
RESOLUTIONS = "status string, to_doc_id string, method string, confidence double"
LINKS = "from_doc_id string, to_doc_id string, relation string, confidence double, method string"
DOC_LEMMAS = "doc_id string, lemma string, tf int, positions array<int>"
SCOPE = "key string, parent string, sources array<string>, verdict_types array<string>"
