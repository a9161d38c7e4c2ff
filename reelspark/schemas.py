"""Schemas of the documents and tables, always given and never inferred."""

ATHLETE = "struct<track_id: int, box: array<double>, mask_area: bigint, keypoints: array<array<double>>>"
TRACKING = f"video string, model string, fps double, video_size array<int>, num_objects int, frames array<struct<frame: bigint, timestamp: double, athletes: array<{ATHLETE}>>>"
DETECTIONS = "video string, frame_idx int, video_size array<int>, persons array<struct<box: array<double>, confidence: double, track_id: int>>"
CLIP = "struct<start_frame: bigint, end_frame: bigint, category: string, specific_technique: string, role: string, reasoning: string, confidence: double>"
ANALYSIS = f"struct<current_context_summary: string, clips: array<{CLIP}>, error: string>"
RESPONSES = "video_id bigint, window_no int, is_final boolean, response string"
ENVELOPE = "Type string, MessageId string, TopicArn string, Message string, MessageAttributes map<string, struct<Type: string, Value: string>>, Timestamp timestamp"
EVENT_BODY = "id string, video_id string, start_time string, end_time string, event_candidates array<struct<id: string, role: string, skill_name: string, category: string, confidence: double>>"
COMPLETION_BODY = "video_id string, job_id string, total_event_count int, result_s3_uri string"
REQUIRED = ("video_id", "video_s3_bucket", "video_s3_key", "tracking_json_s3_bucket", "tracking_json_s3_key", "output_s3_bucket", "output_s3_key")
REQUEST_FIELDS = (*REQUIRED, "sns_topic_arn", "sampling_rate", "analyzer_mode", "method")
