"""Schemas of the inputs."""

TURN_REQUEST = """session_id string, turn_id long, project_id string, external_session_id string, message_id string, client_source string, role string,
text string, char_count long, provider string, model string, actual_input_tokens long, actual_output_tokens long, baseline_full_repo long,
baseline_naive_rag long, baseline_no_context long, tokens_estimated boolean, block_hash string, injected boolean, latency_ms_total long,
latency_ms_ttft long, cache_eligible boolean, cache_hit_estimated boolean, incomplete boolean, recorded_at timestamp"""
PRICE = "struct<prompt:string,completion:string,input_cache_read:string,input_cache_write:string>"
PRICE_FEED = f"array<struct<id:string,pricing:{PRICE}>>"
RATES = "struct<input_per_m:double,output_per_m:double,cache_write_per_m:double,cache_read_per_m:double>"
PRICE_MATRIX = f"struct<providers:map<string,map<string,{RATES}>>>"
FX = "struct<observations:array<struct<d:string,FXUSDCAD:struct<v:string>>>>"
HINTS = "struct<providers:map<string,struct<provider_id:string,url_session_pattern:string,path_filter:string,debounce_ms:int>>>"
FILE_EVENT = "project_id string, path string, kind string, dest_path string, ts timestamp"
