from registry import lineage, scans, tables_views  # noqa: F401
from registry.base import ORACLES, QUERIES, give_types

# DuckDB counts in wider types than the engine's tables have; the values are the same.
_LINE, _PLACE = {"line": "INT"}, {"line": "INT", "column": "INT"}
_FOUND = {**_PLACE, "pos": "INT"}
_CONTEXT = {"line": "INT", "pos": "INT", "context_line": "INT"}
give_types({
    **{name: _FOUND for name in (
        "scan_documents", "scan_planted_files", "detect_prefix", "detect_key_value",
        "detect_contains", "detect_endpoint", "scan_rule_subset", "scan_custom_rules",
        "scan_planted_triggers")},
    **{name: _LINE for name in ("scan_unredacted", "split_into_lines")},
    **{name: _PLACE for name in ("scan_branch", "scan_current_tree", "scan_feature_tree", "stream_scan")},
    **{name: _CONTEXT for name in ("scan_context", "scan_context_all_hidden")},
    "scan_large_files": {"column": "INT", "pos": "INT", "line": "BIGINT"},
    **{name: _PLACE for name in ("scan_graph_tree", "scan_graph_topic_tree")},
    "scan_large_context": {"line": "BIGINT", "pos": "INT", "at": "INT"},
    "scan_crowded_context": {"line": "INT", "pos": "INT", "nr": "INT"},
    "sarif_clean_scans": {"results": "INT"},
    "scanner_text": {"column_number": "INT"},
    "rule_classes": {"specificity": "INT"},
    **{name: {**_PLACE, "context_lines": "INT"} for name in ("json_documents", "json_rows")},
    **{name: {"startLine": "INT", "startColumn": "INT"} for name in ("sarif_documents", "sarif_rows")},
    "report_document_findings": {"line": "INT", "column": "INT"},
    "report_documents": {"listed_rules": "INT", "listed": "INT"},
    "imported_scans": {"total_findings": "INT"},
    "security_stats": {"total_findings": "BIGINT", "total_findings_joined": "BIGINT"},
    "security_stats_of_imports": {"total_findings": "BIGINT", "total_findings_joined": "BIGINT"},
    "corpus_statistics": {"total_findings": "BIGINT"},
    "scan_durations": {"duration_ms": "BIGINT"},
    "feed_cursors": {"repos_fetched": "BIGINT"},
    "batch_summary": {"findings": "BIGINT"},
    "repos_by_platform": {"findings": "BIGINT"},
})

__all__ = ["ORACLES", "QUERIES"]
