"""Tables of a snapshot, as schema strings."""

from __future__ import annotations

FILES = "path string, sha256 string, size long, mtime_ns long, language string, parse_status string, warnings array<string>"
SYMBOLS = (
    "symbol_id string, path string, name string, qualified_name string, kind string, signature string, start_line int, end_line int, start_byte long, end_byte long,"
    " body_start long, body_end long, is_private boolean, roles array<string>, role_evidence map<string, string>"
)
EDGES = (
    "edge_id long, source_symbol_id string, target_symbol_id string, target_stub_id string, target_name string, edge_kind string, status string, backend string, confidence double, source_path string,"
    " source_line int, evidence array<string>"
)
IMPORTS = "path string, module string"
HIERARCHY = "class_symbol_id string, parent_name string, parent_symbol_id string"
RANKS = "symbol_id string, score double, basis array<string>"
CALLS = "path string, name string, receiver string, line int, start_byte long, arg_count int"
RUNS = "arm string, task_id string, seed long, total_tokens double, input_tokens double, output_tokens double, latency_seconds double, task_success boolean, mcp_errors long, mcp_health string"
