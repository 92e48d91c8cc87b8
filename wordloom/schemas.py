"""Schemas of the inputs and tables, and the values that are part of the data model."""

from __future__ import annotations

# The grammar labels of a word entry.
GRAMMAR_TYPES = (
    "verb",
    "noun",
    "adjective",
    "adverb",
    "pronoun",
    "preposition",
    "conjunction",
    "article",
    "numeral",
    "modal_verb",
)

# The languages, numbered from 1 in this order.
LANGUAGES = (
    "English", "Mandarin", "Hindi", "Spanish", "French", "Arabic", "Bengali", "Portuguese",
    "Russian", "Urdu", "Indonesian", "German", "Japanese", "Nigerian", "Punjabi", "Turkish",
    "Vietnamese", "Korean", "Persian", "Thai", "Italian", "Polish", "Ukrainian", "Kurdish",
    "Romanian", "Dutch", "Greek", "Czech", "Hungarian", "Swedish", "Bulgarian", "Hebrew",
    "Serbian", "Danish", "Armenian", "Finnish", "Slovak", "Norwegian", "Georgian", "Croatian",
    "Latvian", "Macedonian", "Estonian", "Icelandic",
)

# The ids of the default language pair.
GERMAN = 12
ENGLISH = 1

# Limits of one request file.
MAX_REQUESTS = 50_000
MAX_FILE_BYTES = 100 * 1024 * 1024 - 256

# Request defaults.
DEFAULT_MODEL = "gpt-4o-mini"
DEFAULT_MAX_TOKENS = 1152
DEFAULT_USER_PREFIX = "Translate the following words: "
DEFAULT_WORDS_PER_REQUEST = 8

# Similarity defaults.
DEFAULT_DISTANCE = 3
DEFAULT_NEIGHBOURS = 50

# States of a remote batch that end it without a result, and the one with a result.
FAILED_STATES = ("failed", "error", "expired", "cancelled", "cancelling")
DONE_STATE = "completed"

# The states of a remote batch in the order in which they follow each other.
LIFECYCLE = (
    "validating", "in_progress", "finalizing", "cancelling", "completed", "cancelled", "expired", "failed", "error",
)

TRANSLATIONS = "MAP<STRING, ARRAY<STRING>>"
PAYLOAD = f"response ARRAY<STRUCT<word: STRING, translations: {TRANSLATIONS}>>"
PROCESSED_WORD = (
    f"source_batch STRING, pos BIGINT, word STRING, translations {TRANSLATIONS}, "
    "similar_words ARRAY<STRING>, grammar_categories ARRAY<STRING>"
)
REQUEST_COUNTS = "STRUCT<total: BIGINT, completed: BIGINT, failed: BIGINT>"
BATCH_RECORD = (
    "id STRING, object STRING, endpoint STRING, errors VARIANT, input_file_id STRING, "
    "completion_window STRING, status STRING, output_file_id STRING, error_file_id STRING, "
    "created_at BIGINT, in_progress_at BIGINT, expires_at BIGINT, finalizing_at BIGINT, "
    "completed_at BIGINT, failed_at BIGINT, expired_at BIGINT, cancelling_at BIGINT, "
    f"cancelled_at BIGINT, request_counts {REQUEST_COUNTS}, metadata VARIANT"
)
FILE_RECORD = (
    "object STRING, id STRING, purpose STRING, filename STRING, bytes BIGINT, "
    "created_at BIGINT, status STRING, status_details STRING"
)

# Table name -> schema. Partition columns come last, as Spark reads them back.
TABLES = {
    "language": "id INT, name STRING",
    "word": "id BIGINT, word STRING, primary_language INT",
    "translation": (
        "id BIGINT, word_id BIGINT, type STRING, translation STRING, "
        "primary_language INT, secondary_language INT, source_batch STRING"
    ),
    "similar_word": (
        "id BIGINT, word_id BIGINT, similar_word STRING, primary_language INT, source_batch STRING"
    ),
    "grammar_category": (
        "id BIGINT, word_id BIGINT, category STRING, "
        "primary_language INT, secondary_language INT, source_batch STRING"
    ),
    "error": "custom_id STRING, type STRING, error STRING, source_batch STRING, origin STRING",
    "quarantine": "stage STRING, reason STRING, line STRING, source_batch STRING, origin STRING",
    "id_counter": "table_name STRING, last_id BIGINT",
}

PARTITIONS = {
    "language": [],
    "word": ["primary_language"],
    "translation": ["primary_language", "secondary_language", "source_batch"],
    "similar_word": ["primary_language", "source_batch"],
    "grammar_category": ["primary_language", "secondary_language", "source_batch"],
    "error": ["source_batch", "origin"],
    "quarantine": ["source_batch", "origin"],
}

# A column that every real row fills. Rows without it mark that a batch was stored.
FILLED = {
    "translation": "id",
    "similar_word": "id",
    "grammar_category": "id",
    "error": "type",
    "quarantine": "stage",
}

# The foreign keys of the dictionary tables.
FOREIGN_KEYS = (
    ("word", "primary_language", "language", "id"),
    ("translation", "word_id", "word", "id"),
    ("translation", "primary_language", "language", "id"),
    ("translation", "secondary_language", "language", "id"),
    ("similar_word", "word_id", "word", "id"),
    ("similar_word", "primary_language", "language", "id"),
    ("grammar_category", "word_id", "word", "id"),
    ("grammar_category", "primary_language", "language", "id"),
    ("grammar_category", "secondary_language", "language", "id"),
)
