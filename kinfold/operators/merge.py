"""Merging: entities of one component, edges of one key, values of one group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
import pyspark.sql.functions as F
import pyspark.sql.types as T


def longest(value: Column, ident: Column) -> Column:
    """Aggregate: the longest value that isn't empty, the lowest id's among equals; NULL without any."""
    v = F.nullif(value, F.lit(""))
    return F.max_by(v, F.when(v.isNotNull(), F.struct(F.length(v), -ident)))


def merge_components(entities: DataFrame, component: str = "component") -> DataFrame:
    """One entity for each component: what folding its rows together by ascending id gives.

    The master is the row of the lowest er_id: er_id, er_uuid, type and match_skip fields are its.
    Name, description and every attribute take the longest value that isn't empty. source_ids and
    source_uuids hold the other rows and their sources, each once, in order of id, without the
    master; NULL if none. A component of one row comes out as it went in, but for itself in its sources.
    """
    ident = F.col("er_id")
    uuids, ids = F.coalesce("source_uuids", F.array().cast("array<string>")), F.coalesce("source_ids", F.array().cast("array<bigint>"))
    first = lambda c: F.min_by(F.struct(c), ident)[c]
    ordered = F.array_sort(F.collect_list(F.struct(ident, F.col("er_uuid"), ids.alias("i"), uuids.alias("u"))))
    base = entities.groupBy(component).agg(
        F.min("er_id").alias("er_id"),
        first("er_uuid").alias("er_uuid"),
        F.coalesce(longest(F.col("name"), ident), F.lit("")).alias("name"),
        F.coalesce(longest(F.col("description"), ident), F.lit("")).alias("description"),
        first("entity_type").alias("entity_type"),
        first("match_skip").alias("match_skip"),
        first("match_skip_reason").alias("match_skip_reason"),
        first("match_skip_history").alias("match_skip_history"),
        ordered.alias("__rows"),
    )
    attributes = (
        entities.select(component, "er_id", F.explode("attributes").alias("k", "v"))
        .groupBy(component, "k")
        .agg(F.coalesce(longest(F.col("v"), ident), F.max("v")).alias("v"))
        .groupBy(component)
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("attributes"))
    )
    all_ids = F.flatten(F.transform("__rows", lambda r: F.concat(F.array(r["er_id"]), r["i"])))
    all_uuids = F.filter(F.flatten(F.transform("__rows", lambda r: F.concat(F.array(r["er_uuid"]), r["u"]))), lambda u: u.isNotNull())
    sources = lambda xs, own: F.filter(F.array_distinct(xs), lambda x: ~x.eqNullSafe(own))
    out = base.join(attributes, component, "left")
    none = lambda c: F.when(F.size(c) > 0, c)
    return out.select(
        component, "er_id", "er_uuid", "name", "description", "entity_type",
        F.coalesce("attributes", F.create_map().cast("map<string,string>")).alias("attributes"),
        none(sources(all_ids, F.col("er_id"))).alias("source_ids"),
        none(sources(all_uuids, F.col("er_uuid"))).alias("source_uuids"),
        "match_skip", "match_skip_reason", "match_skip_history",
    )


def most_common(df: DataFrame, group: str, value: str, back: bool = False) -> DataFrame:
    """The most frequent value of each group: the longest among equals, then the first by order.

    One row a group, or with `back` each input row with its group's value in `<value>_common`; rows
    of the NULL group get NULL then. NULL values don't count.
    """
    n = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("__n"))
    rank = F.struct(-F.col("__n"), -F.length(F.col(value).cast("string")), F.col(value))
    top = n.groupBy(group).agg(F.min_by(value, rank).alias(f"{value}_common"))
    return df.join(top, group, "left") if back else top


def edge_keys(df: DataFrame) -> dict[str, Column]:
    """Ends and type of an edge, under either of their names."""
    have = set(df.columns)
    pick = lambda *names: F.coalesce(*[F.col(n) for n in names if n in have]) if have & set(names) else F.lit(None)
    return {"src": pick("src_id", "src"), "dst": pick("dst_id", "dst"), "type": F.coalesce(pick("type", "edge_type").cast("string"), F.lit(""))}


def group_edges(edges: DataFrame) -> DataFrame:
    """src, dst, type and how many edges share them."""
    k = edge_keys(edges)
    return edges.select(*[c.alias(n) for n, c in k.items()]).groupBy("src", "dst", "type").agg(F.count(F.lit(1)).alias("group_size"))


def merge_edges(edges: DataFrame, sums: tuple[str, ...] = (), maxima: tuple[str, ...] = (), texts: tuple[str, ...] = ()) -> DataFrame:
    """One edge for each (src, dst, type): sums and maxima of numbers, the longest of texts.

    The only edge of its key passes as it is, by the same aggregates.
    """
    k = edge_keys(edges)
    return edges.select(*[c.alias(n) for n, c in k.items()], *sums, *maxima, *texts).groupBy("src", "dst", "type").agg(
        *[F.sum(c).alias(c) for c in sums],
        *[F.max(c).alias(c) for c in maxima],
        *[F.max_by(c, F.when(F.col(c) != "", F.struct(F.length(c), F.col(c)))).alias(c) for c in texts],
        F.count(F.lit(1)).alias("group_size"),
    )


def id_map(entities: DataFrame) -> DataFrame:
    """(old_id, new_id) for every source that an entity has swallowed."""
    return entities.select(F.explode("source_ids").alias("old_id"), F.col("er_id").alias("new_id"))


def remap_edges(edges: DataFrame, ids: DataFrame, drop_loops: bool = True) -> DataFrame:
    """Edges (src, dst, ...) between the entities that their ends were merged to; edges that become
    loops go, if so asked. All other columns stay."""
    out = edges
    for end in ("src", "dst"):
        m = ids.select(F.col("old_id").alias(end), F.col("new_id").alias("__new"))
        out = out.join(m, end, "left").withColumn(end, F.coalesce("__new", end)).drop("__new")
    out = out.select(*edges.columns)
    return out.where(~F.col("src").eqNullSafe(F.col("dst"))) if drop_loops else out


def parsed_edges(df: DataFrame, text: str, schema: T.DataType | str, original: str) -> DataFrame:
    """A resolver's JSON answer as rows; the original edges where it isn't a list of edges."""
    return df.withColumn("edges", F.coalesce(F.from_json(text, schema), F.col(original)))


def resolve_edges(edges: DataFrame, resolver: object, schema: str, at_once: bool = False) -> DataFrame:
    """Groups of several edges go to `resolver` (pandas frame to pandas frame), which may fail: the
    group then passes as it was. Edges that are alone in their key don't go to Python at all.

    Rows come sorted by their key, so groups are cut from batches of many, and one that a batch's end
    cuts waits for its rest. A group costs its call, no transfer of its own. With `at_once` there is
    one call for many whole groups, which `__group` tells apart; the answer has that column too.
    Groups that it leaves out pass as they were, and if the call fails, each group is asked alone.
    """
    k = edge_keys(edges)
    own, keys = edges.columns, [f"__{n}" for n in k]
    # A number or truth value becomes another type in pandas by NULLs that other groups have, so these are sent apart.
    zero = {f.name: F.lit(False) if isinstance(f.dataType, T.BooleanType) else F.lit(0).cast(f.dataType) for f in edges.schema.fields if f.nullable and isinstance(f.dataType, T.IntegralType | T.BooleanType)}
    apart = list(zero)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    sized = edges.select("*", *[c.alias(f"__{n}") for n, c in k.items()]).withColumn("__n", n)

    def typed(pdf, several):  # noqa: ANN001, ANN202
        out = pdf[own].copy()
        for c in apart:
            gone = pdf[f"__no_{c}"]
            if gone.any():
                out[c] = out[c].astype(object if several or out[c].dtype == bool else float).mask(gone, None)
        out.index = range(len(out))
        return out

    def solved(pdf, starts):  # noqa: ANN001, ANN202
        import numpy as np
        import pandas as pd

        ends = [*starts[1:], len(pdf)]
        if at_once:
            try:
                asked = typed(pdf, True)
                asked["__group"] = np.repeat(np.arange(len(starts)), np.subtract(ends, starts))
                out = resolver(asked.copy())
                if set(out.columns) != set(asked.columns):
                    raise ValueError("other columns than those of the edges and __group")
                yield out[own]
                yield asked[~asked["__group"].isin(out["__group"])][own]
                return
            except Exception:  # noqa: BLE001 - each group alone, then
                pass
        found = {}
        for i, (a, b) in enumerate(zip(starts, ends)):
            group = typed(pdf.iloc[a:b], False)
            try:
                out = resolver(group.assign(__group=i) if at_once else group.copy())
                out = out[own] if at_once else out
                out = out if len(out) and list(out.columns) == own else group
            except Exception:  # noqa: BLE001 - the contract: a failed group is passed through
                out = group
            found.setdefault(tuple(out.dtypes), []).append(out)
        yield from (pd.concat(same, ignore_index=True) for same in found.values())

    def run(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if not rows or rows < held[0]["__n"].iloc[0]:
                continue
            pdf = pd.concat(held, ignore_index=True)
            sizes, starts, at = pdf["__n"].tolist(), [], 0
            while at < rows and at + sizes[at] <= rows:
                starts.append(at)
                at += sizes[at]
            yield from solved(pdf.iloc[:at], starts)
            held, rows = ([pdf.iloc[at:].copy()], rows - at) if at < rows else ([], 0)

    alone = sized.where("__n = 1").select(*own)
    sent = [F.coalesce(F.col(f"`{c}`"), zero[c]).alias(c) if c in zero else F.col(f"`{c}`") for c in own]
    many = sized.where("__n > 1").sortWithinPartitions(*keys).select(*sent, *[F.col(f"`{c}`").isNull().alias(f"__no_{c}") for c in apart], "__n")
    return alone.unionByName(many.mapInPandas(run, schema))
