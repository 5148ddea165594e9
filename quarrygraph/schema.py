"""Table schemas of the engine. Readers use these, never inference."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I, B = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


CRUX = _struct(code=S, span=S)
NODES = _struct(
    id=S, name=S, kind=S, owner=S, language=S, qualified_name=S, path=S, span=S, signature=S, exported=B, origin=S,
    body_hash=S, chars=L, body_text=S, arity=I, variadic=B, summary_state=S, summary=S, crux=CRUX,
)
EDGES = _struct(source=S, target=S, relation=S, confidence=S)
RAW_EDGES = _struct(source=S, relation=S, file=S, target_id=S, specifier=S, name=S, via_member=B, recv_type=S, kinds=T.ArrayType(S), arg_count=I)
SCOPES = _struct(prefix=S, label=S, markers=T.ArrayType(S))
GRAPH_JSON = _struct(meta=_struct(version=I, nodeCount=L, edgeCount=L, languages=T.ArrayType(S)), nodes=T.ArrayType(NODES), edges=T.ArrayType(EDGES))
TRANSCRIPT = _struct(
    type=S, uuid=S, isSidechain=B, isMeta=B,
    message=_struct(id=S, model=S, content=S, usage=_struct(input_tokens=L, cache_creation_input_tokens=L, cache_read_input_tokens=L)),
)
QUEUE_EVENT = T.StructType([T.StructField("event", S), T.StructField("properties", T.MapType(S, S)), T.StructField("timestamp", T.TimestampType()), T.StructField("distinct_id", S)])
EVENTS = T.StructType([T.StructField("event_id", L), T.StructField("ts", T.TimestampType()), T.StructField("user_id", L), T.StructField("event_type", S), T.StructField("value", T.DoubleType()), T.StructField("props", S)])
