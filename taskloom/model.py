"""Events, tasks and their constants."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the wire format and of stored tasks.
START, INFO, SUCCESS_EVENT, ERROR_EVENT, SPOT = "StartEvent", "InfoEvent", "SuccessEvent", "ErrorEvent", "SpotEvent"
UNTERMINATED, SUCCESS, ERROR, CORRUPTED = "UNTERMINATED", "SUCCESS", "ERROR", "CORRUPTED"
PARTIAL_SUCCESS, PARTIAL_ERROR, PARTIAL_INFO = "PARTIAL_SUCCESS", "PARTIAL_ERROR", "PARTIAL_INFO_ONLY"
PARTIALS = (PARTIAL_ERROR, PARTIAL_INFO, PARTIAL_SUCCESS)
STATUSES = (UNTERMINATED, SUCCESS, ERROR, PARTIAL_SUCCESS, PARTIAL_ERROR, PARTIAL_INFO, CORRUPTED)
REASON = "corruptedReason"
STARTED_TIME = "ALREADY_STARTED_DIFFERENT_START_TIME"
STARTED_NAME = "ALREADY_STARTED_DIFFERENT_NAME"
STARTED_PARENT = "ALREADY_STARTED_DIFFERENT_PARENT"
CLOSED_TIME = "ALREADY_CLOSED_DIFFERENT_CLOSE_TIME"
CLOSED_STATUS = "ALREADY_CLOSED_DIFFERENT_CLOSE_STATUS"
DIFFERENT_PARENT = "DIFFERENT_PARENT"
DIFFERENT_PRIMARY = "Different primaryIds"
DIFFERENT_PATH = "Different parentsPaths"
NO_CONTEXT = "LogWithoutContext"
#: Between a task's name and the rest of its id.
ID_DELIMITER = "___"
MAX_KEYWORD_CHARS, MAX_TEXT_CHARS = 8000, 900000
DEFAULT_ENV = "default"

#: Suffix that some clients add to ids, and the name of heartbeats; both can be set per call.
ID_SUFFIX = "_task2"
HEARTBEAT = "metadata_client_heartbeat"

_STRINGS = T.MapType(T.StringType(), T.StringType())
_NUMBERS = T.MapType(T.StringType(), T.DoubleType())

EVENT = T.StructType(
    [T.StructField("type", T.StringType()), T.StructField("task_id", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("time", T.TimestampType()), T.StructField("name", T.StringType()), T.StructField("parent_id", T.StringType()), T.StructField("status", T.StringType()), T.StructField("env", T.StringType()), T.StructField("primary_id", T.StringType()), T.StructField("parents_path", T.ArrayType(T.StringType())), T.StructField("orphan", T.BooleanType()), T.StructField("date_to_delete", T.TimestampType()), T.StructField("strings", _STRINGS), T.StructField("text", _STRINGS), T.StructField("context", _STRINGS), T.StructField("metrics", _NUMBERS)]
)

TASK = T.StructType(
    [T.StructField("env", T.StringType()), T.StructField("task_id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("status", T.StringType()), T.StructField("parent_id", T.StringType()), T.StructField("primary_id", T.StringType()), T.StructField("parents_path", T.ArrayType(T.StringType())), T.StructField("task_begin", T.TimestampType()), T.StructField("task_end", T.TimestampType()), T.StructField("duration", T.LongType()), T.StructField("date_to_delete", T.TimestampType()), T.StructField("orphan", T.BooleanType()), T.StructField("ctx", _STRINGS), T.StructField("string", _STRINGS), T.StructField("text", _STRINGS), T.StructField("metric", _NUMBERS)]
)

#: Event column -> task column of the four maps.
MAPS = {"context": "ctx", "strings": "string", "text": "text", "metrics": "metric"}
