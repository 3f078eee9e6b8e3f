"""Column types shared by the operators."""

from __future__ import annotations

USAGE = "struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint,reasoning_tokens:bigint>"
METRICS = "struct<queue_wait_s:double,service_time_s:double,end_to_end_s:double,backoff_s:double,deployment:string,retries:int>"
TOOL_CALLS = "array<struct<id:string,name:string,arguments:string>>"
# What a dispatch puts out for each row; response is the provider's answer as JSON text.
DISPATCHED = f"_index bigint, response string, error string, error_type string, call_id string, metrics {METRICS}"
LEDGER = "record_fingerprint binary, occurrence int, output_index bigint, status tinyint"
# Ledger states.
PENDING, SUCCESS, ERROR = 0, 1, 2
ENDPOINTS = ("chat_completion", "text_completion", "responses")
EMBEDDING, TRANSCRIPTION = "embedding", "transcription"
