"""Explicit schemas of the engine's tables, as DDL, so that importing needs no session."""

from __future__ import annotations

MANIFEST_COLUMNS = (
    "document_id", "company_name", "company_short_name", "stock_code", "report_year", "publish_date", "report_type", "source_url",
    "local_path", "file_name", "file_hash", "file_size", "page_count", "is_text_pdf", "parse_status", "notes",
)
MANIFEST = ", ".join(f"{c} string" for c in MANIFEST_COLUMNS)
PAGE = (
    "document_id string, company string, stock_code string, report_year int, report_type string, pdf_page int, printed_page int, "
    "chapter string, text string, source_file string, source_url string, parse_method string, char_count int, quality_flags array<string>"
)
CHUNK = (
    "chunk_id string, document_id string, chunk_index int, strategy string, company string, stock_code string, report_year int, report_type string, "
    "chapter string, chapters array<string>, pdf_page_start int, pdf_page_end int, pdf_pages array<int>, printed_pages array<int>, "
    "text string, char_count int, source_file string, source_url string"
)
QUESTION_COLUMNS = ("question_id", "question", "question_type", "target_company", "target_stock_code", "target_year", "reference_answer", "evidence_pages", "evidence_text", "difficulty")
QUESTION = ", ".join(f"{c} string" for c in QUESTION_COLUMNS)
CITATION = (
    "citation_id int, chunk_id string, company string, stock_code string, report_year int, chapter string, pdf_pages array<int>, "
    "source_file string, source_url string, quote string, retrieval_score double, unit_context string"
)
#: parse_status -> statuses that may follow, and the gate of each stage.
TRANSITIONS = {"pending": "parsed", "parsed": "audited", "audited": "baseline_chunked", "baseline_chunked": "structured_chunked", "structured_chunked": "retrieval_quality_accepted"}
GATES = {
    "parse": ("pending",),
    "audit": ("parsed", "audited", "baseline_chunked"),
    "fixed_chunks": ("audited", "baseline_chunked"),
    "structured_chunks": ("baseline_chunked", "structured_chunked"),
}
