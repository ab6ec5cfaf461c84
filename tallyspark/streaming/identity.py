"""Which stateful operators a checkpoint belongs to.

State can be taken up by a plan whose stateful operators are those that wrote it: the same kinds in the same order, keyed by the
same types, with the same state variables.  Whatever else has changed in the code doesn't matter to it.  What a plan has is read
from its analysed form and from what its processors declare; what a checkpoint has, from Spark's ``state-metadata`` and
``statestore`` sources and from a mark written when the query started first.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from itertools import zip_longest
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ..plans.folder import Folder

#: Logical operators that keep state in a stream, by the names that state metadata gives them.
STATEFUL = {
    "Aggregate": "stateStoreSave",
    "Deduplicate": "dedupe",
    "DeduplicateWithinWatermark": "dedupeWithinWatermark",
    "Join": "symmetricHashJoin",
    "TransformWithStateInPySpark": "transformWithStateInPandasExec",
}


class OtherState(RuntimeError):
    """A checkpoint's state is of other operators than those of the plan."""


def _struct(schema: T.StructType | str) -> list[str]:
    """The types of columns without their names, which differ between a plan and its state."""
    return [f.dataType.simpleString() for f in (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields]


class _Declared:
    """A processor's handle that only notes which variables it asks for."""

    def __init__(self) -> None:
        self.variables: dict[str, list] = {}

    def getValueState(self, name: str, schema, *_, **__) -> None:
        self.variables[name] = ["ValueState", _struct(schema)]

    def getListState(self, name: str, schema, *_, **__) -> None:
        self.variables[name] = ["ListState", _struct(schema)]

    def getMapState(self, name: str, key, value, *_, **__) -> None:
        self.variables[name] = ["MapState", _struct(key), _struct(value)]


def declared(processor: StatefulProcessor) -> dict[str, list]:
    """The state variables of a processor: kind and types of each."""
    handle = _Declared()
    processor.init(handle)
    return handle.variables


def _nodes(node) -> Iterator[Any]:
    yield node
    for k in range(node.children().size()):
        yield from _nodes(node.children().apply(k))


def _jvm_types(expressions) -> list[str]:
    return [expressions.apply(k).dataType().catalogString() for k in range(expressions.size())]


def planned(rows: DataFrame, processors: Iterable[StatefulProcessor] = ()) -> list[dict]:
    """The stateful operators of a stream, the last one first, as Spark numbers them; ``processors`` in the same order."""
    found, processors = [], iter(processors)
    for node in _nodes(rows._jdf.queryExecution().analyzed()):
        kind = node.getClass().getSimpleName()
        if kind not in STATEFUL or not node.isStreaming():
            continue
        operator: dict = {"name": STATEFUL[kind]}
        if kind == "Join":
            if not (node.left().isStreaming() and node.right().isStreaming()):
                continue
        elif kind == "Aggregate":
            operator["keys"] = _jvm_types(node.groupingExpressions())
        elif kind == "TransformWithStateInPySpark":
            operator["keys"] = _jvm_types(node.child().output())[: node.groupingAttributesLen()]
            operator["variables"] = declared(next(processors))
            operator["time"] = node.timeMode().toString()
        elif kind == "Deduplicate":
            operator["keys"] = sorted(_jvm_types(node.keys()))
        found.append(operator)
    return found


def stored(spark: SparkSession, checkpoint: str) -> list[dict] | None:
    """The stateful operators of a checkpoint as its state says; None if no batch has been committed."""
    if not [n for n in (Folder(spark, checkpoint) / "commits").names() if n.isdigit()]:
        return None
    found = []
    rows = spark.read.format("state-metadata").load(checkpoint).select("operatorId", "operatorName", "operatorProperties").distinct()
    for r in rows.orderBy("operatorId").collect():  # a row for each operator's store
        if found and found[-1]["id"] == r["operatorId"]:
            continue
        operator: dict = {"id": r["operatorId"], "name": r["operatorName"]}
        reader = lambda: spark.read.format("statestore").option("operatorId", r["operatorId"])  # noqa: B023, E731
        if r["operatorProperties"]:
            about = json.loads(r["operatorProperties"])
            operator["time"], operator["variables"] = about["timeMode"], {}
            for v in about["stateVariables"]:
                if v["stateName"].startswith("$"):  # timers
                    continue
                schema = reader().option("stateVarName", v["stateName"]).load(checkpoint).schema
                operator["keys"] = _struct(schema["key"].dataType)
                parts = [schema[c].dataType for c in ("user_map_key", "user_map_value", "value", "list_element") if c in schema.fieldNames()]
                operator["variables"][v["stateName"]] = [v["stateVariableType"], *map(_struct, parts)]
        elif r["operatorName"] in ("stateStoreSave", "dedupe"):
            keys = _struct(reader().load(checkpoint).schema["key"].dataType)
            operator["keys"] = sorted(keys) if r["operatorName"] == "dedupe" else keys
        found.append(operator)
    return [{k: v for k, v in o.items() if k != "id"} for o in found]


def differences(plan: list[dict], state: list[dict]) -> list[str]:
    """What a plan has otherwise than a state, by the operators' names."""
    found = []
    for k, (new, old) in enumerate(zip_longest(plan, state)):
        if new is None or old is None:
            found.append(f"operator {k} {(new or old)['name']}: {'only in the checkpoint' if new is None else 'not in the checkpoint'}")
            continue
        if new["name"] != old["name"]:
            found.append(f"operator {k} {new['name']}: was {old['name']}")
            continue
        for what in sorted(set(new) & set(old) - {"name"}):
            if new[what] != old[what]:
                found.append(f"operator {k} {new['name']}: {what} {new[what]}, were {old[what]}")
    return found


def guard(spark: SparkSession, place: str, checkpoint: str, operators: list[dict], **about: object) -> None:
    """OtherState if a checkpoint's state isn't of these operators, or was written with other settings (``about``).

    Settings are those that give state another meaning, such as the number of parts of a key.  The mark at ``place`` is written
    again as long as no batch has been committed, for there is nothing yet that it would have to fit.
    """
    mark, now = Folder(spark, place), json.loads(json.dumps({"operators": operators, "about": about}, default=str))
    state = stored(spark, checkpoint)
    if state is not None:
        found = differences(now["operators"], state)
        if mark.exists():
            before = json.loads(mark.read())
            found += differences(now["operators"], before["operators"])
            found += [f"{k}: {now['about'].get(k)}, was {before['about'].get(k)}" for k in sorted(set(now["about"]) | set(before["about"])) if now["about"].get(k) != before["about"].get(k)]
        if found:
            raise OtherState(f"the state in {checkpoint} can't be taken up: {'; '.join(dict.fromkeys(found))}")
    mark.parent.make()
    mark.write(json.dumps(now, indent=1, sort_keys=True))
