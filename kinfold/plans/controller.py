"""A run in single steps, each chosen by rule or by a caller's function, such as a model with tools."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame

from kinfold.operators.blocking import blocking_stats, salt
from kinfold.operators.entities import dense_id, to_entities
from kinfold.operators.matching import RuleMatcher
from kinfold.operators.profiling import profile_columns, suggested_config
from kinfold.plans.config import ResolveConfig
from kinfold.plans.resolve import default_blocker, has_converged, one_round
from kinfold.session import checkpointed

State = dict[str, Any]
Tool = Callable[[State], None]


def profile(state: State) -> None:
    """Columns' profile and, if there are none yet, settings by rule."""
    state["profile"] = profile_columns(state["table"])
    state.setdefault("config", ResolveConfig.of(suggested_config(state["profile"], state["table"].count())))


def prepare(state: State) -> None:
    config = state["config"]
    df = state["table"] if config.id_field else dense_id(state["table"], "__id")
    state["rows"] = checkpointed(to_entities(df, config.id_field or "__id", config.name_field, config.text_fields, config.entity_type))
    state["counts"] = [state["rows"].count()]


def block(state: State) -> None:
    config = state["config"]
    state["blocks"] = checkpointed(salt(default_blocker(config)(state["rows"], len(state["counts"])), config.max_block_size))
    state["stats"] = blocking_stats(state["blocks"]).first().asDict()


def match(state: State) -> None:
    blocks, matcher = state.pop("blocks"), state.get("matcher") or RuleMatcher(state["config"].match_threshold)
    merged, _ = one_round(state["rows"], state["config"], lambda rows, i: blocks.select("er_id", "block_key", "block_size"), matcher, len(state["counts"]))
    state["rows"] = checkpointed(merged)
    state["counts"].append(state["rows"].count())


def converged(state: State) -> bool:
    counts = state.get("counts", [])
    if len(counts) < 2:
        return False
    shrunk = 100.0 * (counts[-2] - counts[-1]) / counts[-2] if counts[-2] else 0.0
    return has_converged(shrunk, state["config"].convergence_threshold) or len(counts) > state["config"].max_iterations


TOOLS: dict[str, Tool] = {"profile": profile, "prepare": prepare, "block": block, "match": match}


def by_rule(state: State) -> str:
    """The next tool's name, or finish: profile, prepare, then block and match until it has converged."""
    if "config" not in state:
        return "profile"
    if "rows" not in state:
        return "prepare"
    if "blocks" in state:
        return "match"
    return "finish" if converged(state) else "block"


def control(table: DataFrame, tools: dict[str, Tool] | None = None, decide: Callable[[State], str] = by_rule, most_steps: int = 60, **state: Any) -> State:
    """Runs tools as `decide` chooses until it says finish; the state has the rows, counts by round and
    the steps taken. `tools` replace or add to `TOOLS`. A name that is no tool raises ValueError, more
    than `most_steps` steps RuntimeError."""
    have = TOOLS | (tools or {})
    state |= {"table": table, "steps": []}
    while (step := decide(state)) != "finish":
        if step not in have:
            raise ValueError(f"no tool {step!r}; there are {', '.join(sorted(have))}")
        if len(state["steps"]) >= most_steps:
            raise RuntimeError(f"not finished after {most_steps} steps")
        have[step](state)
        state["steps"].append(step)
    return state
