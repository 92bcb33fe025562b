"""The sentences with which the public API answers.

Fixed values: programs read these answers, so their wording is part of the API's contract."""

INITIALIZED = "Database Initialized."
INVALID_SOURCE = "Invalid source. Please use 'file' or 's3'."
INVALID_PATH = "Invalid path: {path}"
INVALID_TABLE_FILE = "Invalid file type. Please use 'csv' or 'parquet'."
INVALID_METADATA_FILE = "Invalid file type. Please use 'txt' or 'csv'."
TABLE_ADDED = "Table with ID: {id} has been added to the database."
TABLE_EXISTS = "This table already exists in the database with id {id}."
FILES_PROCESSED = "{n} files in folder {path} has been processed."
METADATA_ADDED = "{n} metadata entries has been added."
NOTHING_TO_SUMMARIZE = "No unsummarized tables found.\n"
SUMMARIZATION_FAILED = "Summarization failed"
SUMMARIES_ADDED = "Total of {n} summaries has been added with IDs: {ids}.\n"
NOTHING_TO_INDEX = "No context and summary entries found for the given table ids."
INDEX_EXISTS = "Index named {name} already exists."
INDEX_CREATED = (
    "A hybrid index named {name} with id {vector_id} (vector index) and {text_id} (full-text index) "
    "has been created with {n} tables."
)
INDEX_UNKNOWN = "Index with name {name} does not exist."
QUERIES_ANSWERED = "Queries successful for index {name}"
