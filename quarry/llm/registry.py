"""The queries of this subpackage and, where SQL can express one, the SQL for the same rows."""

from __future__ import annotations

from . import chat_format, collocations, decontaminate, html_extract, jaccard_join, license_scan, line_rules, packing, quality_model, ranked_search, secret_scan, toxic_passages, warc_bundles

QUERIES = {
    "op1_html_extract": html_extract.op1_html_extract,
    "op2_license_scan": license_scan.op2_license_scan,
    "op3_chat_format": chat_format.op3_chat_format,
    "op4_line_rules": line_rules.op4_line_rules,
    "op5_jaccard_join": jaccard_join.op5_jaccard_join,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_quality_model": quality_model.op7_quality_model,
    "op8_warc_bundles": warc_bundles.op8_warc_bundles,
    "op9_packing": packing.op9_packing,
    "op10_secret_scan": secret_scan.op10_secret_scan,
    "op11_ranked_search": ranked_search.op11_ranked_search,
    "op12_toxic_passages": toxic_passages.op12_toxic_passages,
    "op13_collocations": collocations.op13_collocations,
}
ORACLES = {"op4_line_rules": line_rules.ORACLE_SQL, "op8_warc_bundles": warc_bundles.ORACLE_SQL, "op11_ranked_search": ranked_search.ORACLE_SQL, "op13_collocations": collocations.ORACLE_SQL}
