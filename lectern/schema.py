"""Schemas of the tables that plans pass on. Order is always an explicit column."""

BLOCKS = "doc_id long, block_idx int, kind string, text string, level int, page int"
UTTERANCES = "doc_id long, chapter_idx int, chapter_title string, utt_idx int, text string"
SEGMENTS = "doc_id long, idx int, path string, duration_ms long, timings array<struct<start_ms: long, end_ms: long, text: string>>"
VOICES = "id string, engine string, name string, language string, locale string, gender string, tags string"
BOOKS = "id long, title string, authors array<string>, languages array<string>, download_count long, copyrighted boolean, formats array<struct<mime: string, url: string>>"
