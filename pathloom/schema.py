"""Schemas of documents, paths and errors."""

from __future__ import annotations

DOCUMENTS = "doc_id long, uri string, language_id string, content string"
PATH = "value string, path_type string, line int, column int, context string"
PATHS = f"doc_id long, ordinal int, {PATH}"
PATH_ARRAY = "array<struct<value: string, path_type: string, line: int, column: int, context: string>>"
ERROR = "category string, severity string, message string, context string, recoverable boolean, recovery_action string, metadata map<string, string>"
FOLDERS = "folder_index int, name string, fs_path string, scheme string"
ENTRIES = "path string, real_path string, is_symlink boolean"
