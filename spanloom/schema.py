"""Schemas and value domains."""

from __future__ import annotations

#: Domains of the labels of a tagger record.
SPLITS = ["train", "validation", "sep_test", "nemo_test", "format_test", "p3_direct_test", "p3_strategy_test", "p3_clean_hard_negative_test"]
ATTACK_TYPES = ["Clean", "Naive", "Ignore", "Completion", "IndirectAgentic"]
POSITIONS = ["none", "prepend", "middle", "append"]
CUT_TYPES = ["none", "empty", "two_thirds", "half"]

#: The fields of a tagger record, of messages, events and traces, as the files have them.
SPAN = "struct<start:int,end:int>"
TEXT_FIELDS = ["id", "base_id", "split", "instruction", "original_data", "clean_data", "attacked_data", "injection", "inserted_text", "attack_type", "position", "cut_type"]
TAGGER_RECORD = (
    ", ".join(f"{f} string" for f in TEXT_FIELDS)
    + f", drop_spans array<{SPAN}>, augmentation struct<envelope_format:string,wrapper:boolean,hard_negative:boolean,p3_category:string>, p3_category string, p3_source_kind string"
)

_CALL = "struct<function:string,args:variant,id:string>"
_BLOCK = "struct<type:string,content:string>"
MESSAGE = f"struct<role:string,content:array<{_BLOCK}>,tool_calls:array<{_CALL}>,tool_call:{_CALL},tool_call_id:string,error:string>"
EVENT = (
    f"struct<defense:string,tool_name:string,tool_call_id:string,original_tool_output:string,filtered_tool_output:string,changed:boolean,sanitized:boolean,success:boolean,"
    f"predicted_drop_spans:array<{SPAN}>,removed_characters:int,input_characters:int,input_tokens:int,json_parse_ok:boolean,parse_ok:boolean,api_ok:boolean,latency_ms:bigint,error:string>"
)
TRACE = (
    "suite_name string, pipeline_name string, user_task_id string, injection_task_id string, attack_type string, error string, injections map<string,string>, "
    f"messages array<{MESSAGE}>, utility boolean, security boolean, duration double, evaluation_timestamp string, agentdojo_package_version string, "
    f"tagger_defense_events array<{EVENT}>, data_filter_events array<{EVENT}>, pi_sanitizer_events array<{EVENT}>"
)
#: Event lists of a trace; the first that is there counts.
EVENT_KEYS = ["tagger_defense_events", "data_filter_events", "pi_sanitizer_events"]
