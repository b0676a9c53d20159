"""Row types of the data model; every reader uses them, nothing is inferred."""

from __future__ import annotations

FEED_EPISODE = "title string, audio_url string"
EPISODE = "number int, slug string, title string, audio_url string, audio string, transcript string, text string, diarized_text string"
RAW_SEGMENT = "struct<start:double,end:double,text:string>"
SEGMENT = "struct<start:double,end:double,text:string,speaker:string>"
TRANSCRIPT = f"text string, language string, segments array<{RAW_SEGMENT}>"
STORED_TRANSCRIPT = f"text string, language string, backend string, speaker_mapping map<string,string>, segments array<{SEGMENT}>"
TURN = "struct<start:double,end:double,speaker:string>"
CHECKPOINT = f"i int, text string, segments array<{RAW_SEGMENT}>"
SPEAKERS = "name string, embedding array<double>"
PARAGRAPH = "doc_id long, para_idx int, text string"
UNKNOWN_SPEAKER = "UNKNOWN"
