"""Ingest operators: idempotent appends, update from a keyed source, data-set merge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairsim.operators.ranking import dense_uid


def insert_groups_if_absent(groups: DataFrame, incoming_names: DataFrame, name: str = "group_name") -> DataFrame:
    """Add names not yet present; new ids continue after the current max (0 when empty).

    A name already present is a success, not an error. New ids are dense in
    md5(name) order so that concurrent writers agree.
    """
    new = incoming_names.select(name).distinct().join(groups.select(name), name, "left_anti")
    base = groups.agg(F.coalesce(F.max("group_id"), F.lit(0)).alias("_base")).scalar()  # scalar subquery
    new = dense_uid(new, [name], out="_u")
    new = new.select((base + F.col("_u") + 1).cast("long").alias("group_id"), name)
    return groups.select("group_id", name).unionByName(new)


def append_entities(entities: DataFrame, rows: DataFrame) -> DataFrame:
    """Append rows carrying a subset of the entity columns; the rest (e.g. encoding) become NULL."""
    return entities.unionByName(rows, allowMissingColumns=True)


def first_writer_wins(existing: DataFrame, incoming: DataFrame, pk: list[str], arrival: Column | str) -> DataFrame:
    """Append incoming rows; per primary key the earliest arrival wins and existing rows are never replaced.

    De-duplication is a grouped ``min_by`` (combined map-side), not a window.
    """
    arrival = F.col(arrival) if isinstance(arrival, str) else arrival
    cols = [c for c in incoming.columns if c not in pk]
    first = incoming.groupBy(*pk).agg(F.min_by(F.struct(*cols), arrival).alias("_r")).select(*pk, "_r.*")
    fresh = first.join(existing.select(*pk), pk, "left_anti")
    return existing.unionByName(fresh.select(*existing.columns))


def update_from(target: DataFrame, source: DataFrame, key: list[str], column: str) -> DataFrame:
    """Set ``column`` from a keyed source; rows without a match keep their value.

    ``updated`` tells which rows received a value (a missing key is reported,
    not an abort; the integrity queries list them).
    """
    src = source.select(*key, F.col(column).alias("_new"), F.lit(True).alias("_hit"))
    j = target.join(src, key, "left")
    return j.withColumn(column, F.coalesce(F.col("_new"), F.col(column))) \
            .withColumn("updated", F.coalesce(F.col("_hit"), F.lit(False))).drop("_new", "_hit")


def lookup_group(groups: DataFrame, names: DataFrame, name: str = "group_name") -> DataFrame:
    """Group id by name, -1 when absent (left join of the probe names)."""
    return names.join(groups.select(name, "group_id"), name, "left").groupBy(name).agg(
        F.coalesce(F.max("group_id"), F.lit(-1)).cast("long").alias("group_id"))


def db_name(name: Column) -> Column:
    """O24, DB side: drop the first character, strip double quotes at both ends."""
    return F.btrim(F.substring(name, 2, 1 << 30), F.lit('"'))


def join_by_name(db_entities: DataFrame, file_entities: DataFrame, db_col: str = "name", file_col: str = "name") -> DataFrame:
    """Join the two producers on the normalised name."""
    l = db_entities.withColumn("_key", db_name(F.col(db_col)))
    r = file_entities.withColumnRenamed(file_col, "_key")
    return l.join(r, "_key")


def _running_offsets(maxima: DataFrame) -> DataFrame:
    """(_src, _mx) -> (_src, _off): sum of the maxima of all earlier sources (one row per source)."""
    w = Window.orderBy("_src").rowsBetween(Window.unboundedPreceding, -1)
    return maxima.select("_src", F.coalesce(F.sum("_mx").over(w), F.lit(0)).cast("long").alias("_off"))


def merge_datasets(datasets: list[dict], policy: str = "reject-source") -> dict:
    """Merge data sets given in argument order, offsetting group ids by the running max.

    Each data set is a dict with ``groups`` (group_id, group_name) and
    ``entities`` (group_id, ...). The offset of a source is the max group id of
    the merged result before it (0 when empty).

    ``reject-source``: a source that repeats a group name of an earlier
    *accepted* source is skipped entirely; later sources are judged on their own.
    ``unify-by-name``: a repeated name maps to the id it already has; names new
    to the merge get fresh ids above the running max.
    """
    if policy not in ("reject-source", "unify-by-name"):
        raise ValueError(policy)
    groups = reduce(DataFrame.unionByName, [d["groups"].select("group_id", "group_name").withColumn("_src", F.lit(i))
                                            for i, d in enumerate(datasets)])
    ents = reduce(DataFrame.unionByName, [d["entities"].withColumn("_src", F.lit(i)) for i, d in enumerate(datasets)])
    if policy == "reject-source":
        a, b = groups.alias("a"), groups.alias("b")
        clash = (a.join(b, (F.col("a.group_name") == F.col("b.group_name")) & (F.col("a._src") < F.col("b._src")))
                  .select(F.col("a._src").alias("i"), F.col("b._src").alias("j")).distinct())
        # At most S x S rows, S = number of data sets passed in: metadata about the argument list.
        clashes = {(r["i"], r["j"]) for r in clash.collect()}
        accepted: list[int] = []
        for k in range(len(datasets)):
            if not any((i, k) in clashes for i in accepted):
                accepted.append(k)
        g = groups.filter(F.col("_src").isin(accepted))
        e = ents.filter(F.col("_src").isin(accepted))
        off = _running_offsets(g.groupBy("_src").agg(F.max("group_id").alias("_mx")))
        merged_g = g.join(F.broadcast(off), "_src").select(
            (F.col("group_id") + F.col("_off")).alias("group_id"), "group_name")
        merged_e = e.join(F.broadcast(off), "_src").withColumn("group_id", F.col("group_id") + F.col("_off"))
        return {"groups": merged_g, "entities": merged_e.drop("_src", "_off"), "accepted": accepted}
    first = groups.groupBy("group_name").agg(F.min("_src").alias("_first"))
    intro = groups.join(first, "group_name").filter(F.col("_src") == F.col("_first"))
    off = _running_offsets(intro.groupBy("_src").agg(F.max("group_id").alias("_mx")))
    ids = intro.join(F.broadcast(off), "_src").select("group_name", (F.col("group_id") + F.col("_off")).alias("_gid"))
    merged_g = ids.select(F.col("_gid").alias("group_id"), "group_name")
    src_map = groups.join(ids, "group_name").select(F.col("_src").alias("_s2"), F.col("group_id").alias("_old"), "_gid")
    merged_e = ents.join(src_map, (F.col("_src") == F.col("_s2")) & (F.col("group_id") == F.col("_old")))
    merged_e = merged_e.drop("group_id", "_old", "_s2", "_src").withColumnRenamed("_gid", "group_id")
    return {"groups": merged_g, "entities": merged_e}
