"""Fixed schemas (as DDL) and enumerations of the crawl data model."""

from __future__ import annotations

from pyspark.sql import types as T

# The states of an execution, in their declared order.
EXECUTION_STATES = [
    "UNDEFINED", "CREATED", "FETCHING", "SLEEPING", "FINISHED",
    "ABORTED_TIMEOUT", "ABORTED_SIZE", "ABORTED_MANUAL", "FAILED", "DIED",
]
ACTIVE_STATES = ["CREATED", "FETCHING", "SLEEPING"]
RUNNING_STATES = ["UNDEFINED", "CREATED", "FETCHING", "SLEEPING"]
ABORT_STATES = ["ABORTED_TIMEOUT", "ABORTED_SIZE", "ABORTED_MANUAL"]
TERMINAL_STATES = ["FINISHED", "ABORTED_TIMEOUT", "ABORTED_SIZE", "ABORTED_MANUAL", "FAILED", "DIED"]
JOB_STATES = ["UNDEFINED", "CREATED", "RUNNING", "FINISHED", "ABORTED_MANUAL", "FAILED", "DIED"]

COUNTERS = [
    "documents_crawled", "bytes_crawled", "uris_crawled", "documents_failed",
    "documents_out_of_scope", "documents_retried", "documents_denied",
]

ERROR = "code int, msg string, detail string"
KEY_VALUE = "key string, value string"
CONFIG_REF = "kind string, id string"

CRAWL_LOG = (
    "warc_id string, execution_id string, job_execution_id string, collection_final_name string, "
    "status_code int, size bigint, fetch_time_ms bigint, retries int, requested_uri string, "
    "response_uri string, discovery_path string, referrer string, content_type string, "
    "block_digest string, payload_digest string, storage_ref string, record_type string, "
    "warc_refers_to string, ip_address string, method string, time_stamp bigint, "
    "fetch_time_stamp bigint, error_code int, error_msg string, error_detail string"
)

PAGE_LOG = (
    "warc_id string, execution_id string, job_execution_id string, collection_final_name string, "
    "uri string, referrer string, method string, outlinks string"
)

RESOURCE = (
    "page_id string, warc_id string, uri string, referrer string, resource_type string, "
    "content_type string, discovery_path string, method string, status_code int, "
    "from_cache boolean, renderable boolean, error_code int, error_msg string, error_detail string"
)

PARSED_URI_FIELDS = ["href", "scheme", "host", "port", "username", "password", "path", "query", "fragment", "error"]
PARSED_URI = T.StructType(
    [T.StructField(f, T.IntegerType() if f == "port" else T.StringType()) for f in PARSED_URI_FIELDS])
STRINGS = T.ArrayType(T.StringType())

SEED_IMPORT = (
    "entityId string, entityName string, entityDescription string, "
    "entityLabel array<struct<key:string,value:string>>, uri string, seedDescription string, "
    "seedLabel array<struct<key:string,value:string>>"
)

META = (
    "name string, description string, created timestamp_ntz, createdBy string, "
    "lastModified timestamp_ntz, lastModifiedBy string, "
    "label array<struct<key:string,value:string>>, annotation array<struct<key:string,value:string>>"
)
