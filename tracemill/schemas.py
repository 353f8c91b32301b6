"""Schemas and closed value sets of the published tables."""

# fixed values
CATEGORIES = ("Read", "Edit", "Write", "Browser", "MCP", "Ask User", "Subagent", "*Interpreter", "*Search", "*File Ops", "*Git/VCS", "*Network", "*Wait/Poll", "*Build/Test", "*Packages", "Other")
CAUSES = ("compaction", "tool_definitions", "system_prompt", "dropped_turns", "injection", "tool_result", "other")
TRANSITIONS = ("append", "mutation", "switch")
OUTCOMES = ("ok", "error", "denied", "timeout")
FAILED_OUTCOMES = ("error", "denied", "timeout")
BENCHMARK_HARNESS = "eval:swe-bench"
BLOCK_TOKENS = 16

_ROLE = "struct<system:bigint,user:bigint,assistant:bigint,tool:bigint,tool_definitions:bigint>"
SESSIONS = "session_id string, harness string, user_id string, parent_session_id string, spawned_by_step int, spawned_by_call_index int"
REQUESTS = (
    "session_id string, step int, link_reason string, start_ms bigint, end_ms bigint, ttft_ms bigint, model string, provider string, stream boolean, finish_reason string,"
    " step_trigger string, waited_for string, prompt_tokens bigint, completion_tokens bigint, cache_read_tokens bigint,"
    f" role_tokens {_ROLE}, n_messages int, tool_definition_names array<string>, transition string, cause string, block_ids array<bigint>"
)
TOOL_CALLS = "session_id string, step int, call_index int, name string, category string, programs array<string>, parse_status string, arguments_skeleton string, outcome string, result_tokens bigint, latency_ms bigint"
