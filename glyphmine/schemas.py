"""Column types of the index tables. Flags are 0 or 1 integers; identifiers are 64-bit."""

from __future__ import annotations

TABLES: dict[str, str] = {
    "meta": "key string, value string",
    "sources": "id long, source_id string, source_kind string, version string, content_hash string, snapshot_id string",
    "files": "id long, source_id long, relative_path string, filename string, extension string, size long, sha256 string, line_count long, parse_status string, parse_error string, reference_status string, reference_error string",
    "types": "id long, source_id long, file_id long, namespace string, name string, full_name string, kind string, visibility string, is_abstract int, is_static int, is_sealed int, is_compiler_generated int, parent_type_id long, start_line int, end_line int",
    "methods": "id long, source_id long, type_id long, file_id long, name string, signature string, return_type string, visibility string, is_static int, is_virtual int, is_override int, is_abstract int, start_line int, end_line int",
    "fields": "id long, source_id long, type_id long, file_id long, name string, field_type string, visibility string, is_static int, is_readonly int, is_const int, start_line int",
    "properties": "id long, source_id long, type_id long, file_id long, name string, property_type string, visibility string, has_getter int, has_setter int, is_static int, start_line int, end_line int",
    "inheritance": "id long, source_id long, type_id long, relation string, target_name string, target_type_id long",
    "strings": "id long, source_id long, file_id long, type_id long, method_id long, value string, classification string, start_line int",
    "symbol_references": "id long, source_id long, from_file_id long, from_type_id long, from_method_id long, target_kind string, target_name string, target_logical_key string, target_id long, reference_kind string, start_line int, start_column int, end_line int, end_column int, resolution_status string, resolution_confidence double",
    "method_calls": "id long, source_id long, caller_method_id long, callee_method_id long, callee_name string, callee_signature_hint string, declaring_type_hint string, file_id long, line int, column int, resolution_status string",
    "type_references": "id long, source_id long, from_file_id long, from_type_id long, from_method_id long, target_type_id long, target_name string, reference_kind string, line int, resolution_status string",
}

STATUSES = ("resolved", "ambiguous", "unresolved", "external")
#: First parts of names that come from outside the indexed sources.
EXTERNAL_ROOTS = frozenset("AOT Apple Best C5 DG FMOD Facepunch Firebase Gameloop Google Harmony HarmonyLib Humanizer ICSharpCode Microsoft Mono NUnit Newtonsoft Sirenix Steamworks System TMPro Unity UnityEngine YamlDotNet".split())
