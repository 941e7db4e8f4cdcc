"""Schemas: the log envelope, message payloads, stage tables.

All times are BIGINT nanoseconds; Spark timestamps hold microseconds only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ENVELOPE = "episode string, seq bigint, ts_ns bigint, topic string, message_type string, payload string"
#: Payload fields by message type (fixed values of the format).
PAYLOADS = {
    "desktop/KeyboardEvent": "event_type string, vk int, timestamp bigint",
    "desktop/KeyboardState": "buttons array<int>, timestamp bigint",
    "desktop/MouseEvent": "event_type string, x int, y int, button string, pressed boolean, dx int, dy int, timestamp bigint",
    "desktop/MouseState": "x int, y int, buttons array<string>, timestamp bigint",
    "desktop/RawMouseEvent": "last_x int, last_y int, us_flags int, button_flags int, button_data int, device_handle bigint, timestamp bigint",
    "desktop/PointerBallisticsConfig": "mouse_threshold1 int, mouse_threshold2 int, mouse_speed int, mouse_sensitivity int, smooth_mouse_x_curve string, smooth_mouse_y_curve string",
    "desktop/WindowInfo": "title string, rect array<int>, hWnd bigint",
    "desktop/ScreenCaptured": "utc_ns bigint, source_shape array<int>, shape array<int>, media_ref struct<uri:string,pts_ns:bigint>",
}
#: Message types that were registered while the program runs.
_REGISTERED: dict[str, str] = {}
STAGES = {
    "event": "episode_path string, topic string, timestamp_ns bigint, message_type string, mcap_message binary",
    "binned": "episode_path string, bin_idx int, timestamp_ns bigint, state array<binary>, actions array<binary>",
    "tokenized": "episode_path string, topic string, timestamp_ns bigint, text string, images array<string>, token_ids array<int>, total_token_count int",
    "fsl": "input_ids array<int>, attention_mask array<int>, texts string, images array<string>, episode_path string",
}


def stage_of(schema: StructType) -> str:
    """The stage whose columns ``schema`` has, else ``unknown``."""
    names = set(schema.names)
    for stage, ddl in STAGES.items():
        if {part.split()[0] for part in ddl.split(", ")} <= names:
            return stage
    return "unknown"


def valid_type_name(message_type: Column) -> Column:
    """Whether a message type is ``domain/Name``."""
    return F.coalesce(message_type.rlike("^[^/]+/.+"), F.lit(False))


def message_types() -> dict[str, str]:
    """Payload fields of all message types, those of the format and those registered."""
    return {**PAYLOADS, **_REGISTERED}


def register_message_type(name: str, fields: str | StructType) -> None:
    """Make ``domain/Name`` known with its payload's fields; a name that is taken with other fields is an error."""
    domain, slash, rest = name.partition("/")
    if not (domain and slash and rest):
        raise ValueError(f"a message type is named domain/Name, not {name!r}")
    text = fields if isinstance(fields, str) else fields.toDDL()
    if message_types().get(name, text) != text:
        raise ValueError(f"{name} is registered with other fields")
    if name not in PAYLOADS:
        _REGISTERED[name] = text


def decoded(payload: Column, message_type: str, strict: bool = False) -> Column:
    """Payload JSON as a struct; what does not parse is null, or an error where ``strict``."""
    if message_type not in message_types():
        raise KeyError(f"{message_type} is no registered message type")
    return F.from_json(payload, message_types()[message_type], {"mode": "FAILFAST" if strict else "PERMISSIVE"})


def parses(payload: Column, message_type: str) -> Column:
    """Whether a payload is JSON with the fields' types; absent fields are null ones."""
    fields = f"{message_types()[message_type]}, _broken string"
    return payload.isNotNull() & F.from_json(payload, fields, {"columnNameOfCorruptRecord": "_broken"})["_broken"].isNull()


def typed(events: DataFrame, names: list[str] | None = None) -> DataFrame:
    """``events`` with ``typed``: a struct with a field for each message type (domain__Name), of which a row's own is set.

    Where ``names`` is not given, all registered types have a field. Payloads of
    other types, and those that do not parse, have none set.
    """
    wanted = list(message_types()) if names is None else names
    fields = [F.when(F.col("message_type") == n, decoded(F.col("payload"), n)).alias(n.replace("/", "__")) for n in wanted]
    return events.withColumn("typed", F.struct(*fields))
