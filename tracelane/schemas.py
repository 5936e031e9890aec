"""Column layouts of the canonical tables. Times are BIGINT microseconds since the epoch."""

from __future__ import annotations

SOURCES = "array<struct<title:string,url:string>>"
DETAIL = f"struct<type:string,diff:string,content:string,moved_to:string,fs_change:string,sources:{SOURCES}>"

RAW_RECORDS = "harness string, project_dir string, file string, line_no bigint, rec variant"
CLASSIFIED = f"{RAW_RECORDS}, class string, at_us bigint, cwd string"
PARTICIPANTS = "who string, kind string, label string, session string, main string, parent string, ord bigint"
SESSIONS = (
    "session string, id string, title string, cwd string, start_us bigint, end_us bigint, last_seen_us bigint, main string"
)
FILE_EVENTS = (
    "event_id bigint, who string, scope string, root_id bigint, scope_session string, rel string, kind string, "
    f"source string, tool string, start_us bigint, end_us bigint, call_id string, detail {DETAIL}"
)
INTERVALS = "who string, start_us bigint, end_us bigint"
PROMPTS = "session string, at_us bigint"
WINDOWS = "who string, call_id string, start_us bigint, end_us bigint, ord bigint"
CALLS = "who string, call_id string, tool string, input string"
SNAPSHOTS = "scope_key string, rel string, at_us bigint, seq bigint, content string"
