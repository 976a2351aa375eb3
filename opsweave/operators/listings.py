"""Listings of cluster objects: rollout histories, autoscalers, quotas; as flat rows over the inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Schemas of the objects that ``tables.read_inventory`` takes.
META = "metadata struct<name:string,namespace:string,creation_timestamp:timestamp,annotations:map<string,string>,labels:map<string,string>>"
REPLICA_SETS = f"{META}, spec struct<replicas:int>, status struct<ready_replicas:int>"
AUTOSCALERS = f"{META}, spec struct<scale_target_ref:struct<api_version:string,kind:string,name:string>,min_replicas:int,max_replicas:int>, status struct<current_replicas:int,desired_replicas:int>"
QUOTAS = f"{META}, spec struct<hard:map<string,string>,scopes:array<string>>, status struct<used:map<string,string>>"
# Annotations of a rollout, and what stands for a cause that nobody noted.
REVISION, CAUSE, NO_CAUSE = "deployment.kubernetes.io/revision", "kubernetes.io/change-cause", "未记录"


def rollout_history(replica_sets: DataFrame) -> DataFrame:
    """(namespace, deployment, revision, change_cause, replica_set, created, replicas, ready) of replica sets that carry a
    revision; the deployment is the label ``app``.  A revision that is no number is passed over."""
    note = F.col("metadata.annotations")
    rows = replica_sets.select(
        F.col("metadata.namespace").alias("namespace"),
        F.col("metadata.labels")["app"].alias("deployment"),
        note[REVISION].try_cast("int").alias("revision"),
        F.coalesce(note[CAUSE], F.lit(NO_CAUSE)).alias("change_cause"),
        F.col("metadata.name").alias("replica_set"),
        F.col("metadata.creation_timestamp").alias("created"),
        F.coalesce("spec.replicas", F.lit(0)).alias("replicas"),
        F.coalesce("status.ready_replicas", F.lit(0)).alias("ready"),
    )
    return rows.where(F.col("revision").isNotNull())


def autoscalers(scalers: DataFrame) -> DataFrame:
    """(namespace, name, target ``kind/name``, min, max, current, desired) of each autoscaler."""
    target = F.col("spec.scale_target_ref")
    named = {"min": "spec.min_replicas", "max": "spec.max_replicas", "current": "status.current_replicas", "desired": "status.desired_replicas"}
    return scalers.select("metadata.namespace", "metadata.name", F.concat_ws("/", target["kind"], target["name"]).alias("target"), *[F.col(c).alias(n) for n, c in named.items()])


def _held(values: Column) -> Column:
    return F.coalesce(values, F.create_map().cast("map<string,string>"))


def quotas(quotas: DataFrame) -> DataFrame:
    """(namespace, name, scopes, hard, used): what each quota grants and what is used, as maps that may be empty."""
    scopes = F.coalesce("spec.scopes", F.array().cast("array<string>"))
    return quotas.select("metadata.namespace", "metadata.name", scopes.alias("scopes"), _held(F.col("spec.hard")).alias("hard"), _held(F.col("status.used")).alias("used"))


def quota_rows(quota_maps: DataFrame) -> DataFrame:
    """(namespace, name, resource, hard, used): a row for each resource that a quota names on either side."""
    each = F.explode(F.array_union(F.map_keys("hard"), F.map_keys("used"))).alias("resource")
    rows = quota_maps.select("namespace", "name", each, F.col("hard").alias("_hard"), F.col("used").alias("_used"))
    return rows.select("namespace", "name", "resource", F.col("_hard")[F.col("resource")].alias("hard"), F.col("_used")[F.col("resource")].alias("used"))
