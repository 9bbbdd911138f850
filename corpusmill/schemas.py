"""Spark schemas of the record model's tables."""

PROBLEM = (
    "rid long, uid string, source string, provenance string, statement string, truth_strings array<string>, answer_value string, tier string, "
    "family string, params string, truth_policy string, label string, pass_at_k double, n_correct int, n_wrong int, n_degenerate int, "
    "modal_wrong string, top_wrong_share double, raw string"
)
VERDICT = "uid string, combo string, attempt int, status string, score double, source string"
ROLLOUT = "uid string, rollout_uid string, sample_idx int, output string, candidate string, verdict string"
JUDGE_SAMPLE = "uid string, sample_id int, verdict string, insufficient_context boolean, reason string, derived_answer string"
LEDGER = "uid string, stmt_key string, content_hash string, batch string, batch_label string, source_journal string, journal_line long, sliced_at string, warn_only boolean"
MANIFEST = "filename string, yymm string, seq_num int, first_item string, last_item string, num_items int, size_bytes long, md5sum string, content_md5sum string, timestamp string"
SPAN = "array<struct<start:int,end:int,env_name:string,body_raw:string,opt_arg:string>>"
MESSAGES = "array<struct<role:string,content:string>>"
