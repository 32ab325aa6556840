"""The registered queries of this package and their SQL."""

from __future__ import annotations

from tidemark.llm import byte_bpe, exact_dedup, filter_audit, html_extract, language_id, lexical_search, license_scan, line_dedup, minhash_dedup, mixing, packing, topk_search, warc

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_license_scan": license_scan.op4_license_scan,
    "op5_topk_search": topk_search.op5_topk_search,
    "op6_warc": warc.op6_warc,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op8_minhash_dedup": minhash_dedup.op8_minhash_dedup,
    "op9_mixing": mixing.op9_mixing,
    "op10_html_extract": html_extract.op10_html_extract,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_lexical_search": lexical_search.op12_lexical_search,
    "op13_byte_bpe": byte_bpe.op13_byte_bpe,
}
ORACLE = {
    "op2_line_dedup": line_dedup.ORACLE_SQL,
    "op3_exact_dedup": exact_dedup.ORACLE_SQL,
    "op5_topk_search": topk_search.ORACLE_SQL,
    "op6_warc": warc.ORACLE_SQL,
    "op11_filter_audit": filter_audit.ORACLE_SQL,
    "op12_lexical_search": lexical_search.ORACLE_SQL,
}
