"""Blocks for a text model: what it is asked, in which shape it answers, and how often at once."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable, Mapping, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
import pyspark.sql.functions as F
import pyspark.sql.types as T

def _fields(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, k) for n, k in kinds.items()])


_TEXT, _NUMBER, _SHARE = T.StringType(), T.LongType(), T.DoubleType()
_RECORD = _fields(local_id=_NUMBER, name=_TEXT, description=_TEXT, source_local=T.ArrayType(_NUMBER))

#: What each kind of request asks for: the task, the names of its inputs, the shape of its answer.
REQUESTS: dict[str, tuple[str, tuple[str, ...], T.StructType]] = {
    "match": (
        "Find the records of this block that stand for the same thing and merge them. A merged record keeps the lowest local_id of its group; "
        "source_local lists the group's other local ids. Take the fullest value of each field. Answer with every record, merged or not.",
        ("records", "fields", "examples"),
        _RECORD,
    ),
    "merge": ("Merge two records of the same thing. The lower local_id stays; take the fuller value of each field.", ("first", "second"), _RECORD),
    "edges": ("These edges have the same ends. Merge those that say the same, keep those that don't.", ("edges",), _fields(src=_NUMBER, dst=_NUMBER, type=_TEXT)),
    "profile": ("Say which columns of this table name things, which tell them apart, and how many rows may be copies.", ("profile",), _fields(name_field=_TEXT, text_fields=T.ArrayType(_TEXT), estimated_duplicate_rate=_SHARE)),
    "config": (
        "Propose settings to resolve this table: the column that names things, the text columns, the kind of thing, block sizes (30, at most 100), at most 5 rounds, a convergence threshold of 0.01 to 0.05.",
        ("profile", "samples"),
        _fields(name_field=_TEXT, text_fields=T.ArrayType(_TEXT), entity_type=_TEXT, blocking=_fields(method=_TEXT, target_block_size=_NUMBER, max_block_size=_NUMBER), max_iterations=_NUMBER, convergence_threshold=_SHARE),
    ),
}

EXAMPLE = {
    "records": [{"local_id": 0, "name": "Nordwind GmbH", "description": "pumps"}, {"local_id": 1, "name": "NORDWIND", "description": ""}, {"local_id": 2, "name": "Sudwind AG", "description": "fans"}],
    "answer": [{"local_id": 0, "name": "Nordwind GmbH", "description": "pumps", "source_local": [1]}, {"local_id": 2, "name": "Sudwind AG", "description": "fans", "source_local": []}],
}


def examples(own: Sequence[Mapping[str, Any]] = ()) -> str:
    """Worked examples as JSON: the caller's, or one that shows how local ids are kept."""
    return json.dumps(list(own) or [EXAMPLE], indent=1, ensure_ascii=False)


def shape(kind: T.DataType, notes: Mapping[str, str] | None = None, depth: int = 0) -> str:
    """A type as short text: one line a field, a comment before those that `notes` says something about."""
    pad = "  " * (depth + 1)
    match kind:
        case T.StructType():
            lines = []
            for f in kind.fields:
                if notes and f.name in notes:
                    lines.append(f"{pad}# {notes[f.name]}")
                lines.append(f"{pad}{f.name}: {shape(f.dataType, notes, depth + 1)}{' or null' if f.nullable else ''}")
            return "{\n" + "\n".join(lines or [f"{pad}# no fields"]) + "\n" + "  " * depth + "}"
        case T.ArrayType():
            return f"list of {shape(kind.elementType, notes, depth)}"
        case T.MapType():
            return f"map of {shape(kind.keyType)} to {shape(kind.valueType, notes, depth)}"
        case T.LongType() | T.IntegerType() | T.ShortType() | T.ByteType():
            return "int"
        case T.DoubleType() | T.FloatType() | T.DecimalType():
            return "float"
        case T.BooleanType():
            return "boolean"
    return "string"


def prompt(request: str, inputs: Mapping[str, Any], notes: Mapping[str, str] | None = None, many: bool = True) -> str:
    """The text that asks a model: the task, the inputs under their names, the shape of the answer."""
    task, names, kind = REQUESTS[request]
    missing = [n for n in names if n not in inputs]
    if missing:
        raise ValueError(f"{request} needs {', '.join(missing)}")
    parts = [task, *[f"== {n} ==\n{inputs[n] if isinstance(inputs[n], str) else json.dumps(inputs[n], ensure_ascii=False, default=str)}" for n in names]]
    return "\n\n".join([*parts, f"== answer, as JSON ==\n{shape(T.ArrayType(kind) if many else kind, notes)}"])


def answer(text: str) -> Any:
    """The JSON of a model's answer, without a code fence or words around it; ValueError without any."""
    opened = min((i for i in (text.find("["), text.find("{")) if i >= 0), default=-1)
    closed = max(text.rfind("]"), text.rfind("}"))
    if opened < 0 or closed < opened:
        raise ValueError("no JSON in the answer")
    return json.loads(text[opened : closed + 1])


_SLOTS: dict[int, threading.BoundedSemaphore] = {}


def block_function(ask: Callable[[str], str], fields: str = "", own_examples: Sequence[Mapping[str, Any]] = (), at_once: int = 4) -> Callable:
    """A function for `GroupedMatcher` from a client that answers a prompt. Within one Python worker no
    more than `at_once` requests run together; tasks run side by side besides. A failing client or
    an answer without JSON raises, and the matcher then passes the block on as it was."""

    def run(pdf):  # noqa: ANN001, ANN202
        slot = _SLOTS.setdefault(at_once, threading.BoundedSemaphore(at_once))
        records = pdf.to_dict("records")
        with slot:
            got = answer(ask(prompt("match", {"records": records, "fields": fields, "examples": examples(own_examples)})))
        return got if isinstance(got, list) else [got]

    return run


def model_embedding(rows: DataFrame, encode: Callable[[list[str]], Sequence[Sequence[float]]], text: str = "name", batch: int = 64) -> DataFrame:
    """Adds `embedding`, unit vectors of a caller's model: Arrow batches, `batch` texts a call. NULL
    texts get NULL, a zero vector stays one. `encode` is pickled to the tasks; a model should be
    opened on its first call."""
    @F.pandas_udf("array<double>")
    def embed(parts: pd.Series) -> pd.Series:
        out: list[list[float] | None] = [None] * len(parts)
        there = [i for i, t in enumerate(parts) if t is not None]
        for k in range(0, len(there), batch):
            some = there[k : k + batch]
            for i, v in zip(some, encode([parts.iloc[i] for i in some]), strict=True):
                v = np.asarray(v, np.float64)
                n = np.linalg.norm(v)
                out[i] = (v / n if n else v).tolist()
        return pd.Series(out, dtype=object)

    return rows.withColumn("embedding", embed(F.col(text)))
