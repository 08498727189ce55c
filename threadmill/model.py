"""Schemas of the normalized tables.  Order is data: every stream carries an explicit `seq` per session."""

from __future__ import annotations

MESSAGES = "session_id string, seq long, role string, content string, thinking string, tool_calls_summary array<string>, timestamp string, injected boolean"
SESSIONS = (
    "session_id string, title string, start_time string, end_time string, file_size long, line_count long, user_count long, assistant_count long, tool_count long, "
    "has_compaction boolean, directory string, parent_session_id string, child_sessions array<string>, aliases array<string>, backend_kind string, mtime timestamp, read_error string"
)
ENTRIES = "session_id string, idx long, entry_type string, timestamp string, record string"
DAMAGE = "path string, line long, error string"
TODOS = "session_id string, flush long, timestamp string, todos array<struct<content:string,status:string,priority:string>>"
LEDGER = "session_id string, from_id long, to_id long, from_ts string, to_ts string, user long, assistant long, tool long, thinking long, chars long, tokens_est long, part_file string"
EVENTS = "session_id string, line_number long, event_type string, summary string, gap_lines long"
