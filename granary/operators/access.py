"""Users, keys and permissions as tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.constants import PERMISSIONS, ROLES


def permission_table(spark: SparkSession) -> DataFrame:
    """role, permission; a few dozen rows by construction, so it may be broadcast."""
    return spark.createDataFrame([(r, p) for r, ps in PERMISSIONS.items() for p in ps], "role string, permission string")


def resolve_keys(requests: DataFrame, keys: DataFrame, users: DataFrame, as_of: dt.datetime) -> DataFrame:
    """requests(request_id, presented) -> request_id, user_id of active, unexpired keys of active users."""
    asked = requests.select("request_id", F.sha2("presented", 256).alias("api_key_hash"), F.substring("presented", 1, 10).alias("prefix"))
    live = keys.where(F.col("is_active") & (F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(as_of))))
    hit = asked.join(live.select("api_key_hash", "prefix", "user_id"), ["api_key_hash", "prefix"])
    return hit.join(users.where("is_active").select("user_id"), "user_id").select("request_id", "user_id")


def key_expiry(keys: DataFrame, days: str = "expires_days") -> DataFrame:
    """created_at plus a number of days, null for none."""
    return keys.withColumn("expires_at", F.col("created_at") + F.make_interval(days=F.col(days).cast("int")))


def list_users(users: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """Newest first."""
    return users.orderBy(F.desc("created_at"), "user_id").offset(offset).limit(limit)


def list_keys(keys: DataFrame, user_id) -> DataFrame:
    """A user's keys without their hash, newest first."""
    return keys.where(F.col("user_id") == user_id).drop("api_key_hash").orderBy(F.desc("created_at"), "key_id")


def role_level(role: Column | str) -> Column:
    """0 user, 1 manager, 2 admin; null for others."""
    role = F.col(role) if isinstance(role, str) else role
    out = F.when(F.lit(False), F.lit(0))
    for k, r in enumerate(ROLES):
        out = out.when(role == r, F.lit(k))
    return out


def check_permission(users: DataFrame, permissions: DataFrame, wanted: str) -> DataFrame:
    """Whether each user's role has a permission."""
    holders = permissions.where(F.col("permission") == wanted).select("role", F.lit(True).alias("has")).distinct()
    return users.join(F.broadcast(holders), "role", "left").withColumn("allowed", F.coalesce("has", F.lit(False))).drop("has")


def owned_rows(df: DataFrame, permissions: DataFrame, user_id, role: str, wanted: str) -> DataFrame:
    """Own rows, or all if the role has the permission wanted."""
    grants = permissions.where((F.col("role") == role) & (F.col("permission") == wanted)).limit(1).select(F.lit(True).alias("granted"))
    return df.join(F.broadcast(grants), F.lit(True), "left").where(F.coalesce("granted", F.lit(False)) | (F.col("user_id") == user_id)).drop("granted")


def sso_upsert(users: DataFrame, logins: DataFrame, as_of: dt.datetime) -> DataFrame:
    """users(user_id, username, email, full_name, sso_subject, sso_provider, last_login) after logins(subject, provider, username, email, full_name)."""
    one = logins.withColumn("n", F.row_number().over(W.partitionBy("subject", "provider").orderBy("username"))).where("n = 1")
    old, new = users.alias("u"), one.alias("l")
    both = old.join(new, (F.col("u.sso_subject") == F.col("l.subject")) & (F.col("u.sso_provider") == F.col("l.provider")), "full")
    fallback = F.concat(F.col("l.provider"), F.lit("_"), F.col("l.subject"))
    seen = F.col("l.subject").isNotNull()
    return both.select(
        F.coalesce(F.col("u.user_id").cast("string"), F.sha2(F.concat_ws("|", "l.provider", "l.subject"), 256)).alias("user_id"),
        F.coalesce("u.username", "l.username", fallback).alias("username"),
        F.coalesce("u.email", "l.email", F.concat(fallback, F.lit("@sso.local"))).alias("email"),
        F.coalesce("u.full_name", "l.full_name", "l.username", fallback).alias("full_name"),
        F.coalesce("u.sso_subject", "l.subject").alias("sso_subject"),
        F.coalesce("u.sso_provider", "l.provider").alias("sso_provider"),
        F.when(seen, F.lit(as_of).cast("timestamp")).otherwise(F.col("u.last_login")).alias("last_login"),
    )


PATCHABLE = ("email", "full_name", "role", "is_active")


def patch_users(users: DataFrame, patches: DataFrame) -> DataFrame:
    """Users with the non-null patchable fields of patches(user_id, ...)."""
    fields = [c for c in PATCHABLE if c in patches.columns]
    p = patches.select("user_id", *[F.col(c).alias(f"new_{c}") for c in fields])
    joined = users.join(p, "user_id", "left")
    return joined.select(*[F.coalesce(f"new_{c}", c).alias(c) if c in fields else F.col(c) for c in users.columns])


def delete_users(users: DataFrame, keys: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Users and keys without those of ids(user_id)."""
    return users.join(ids, "user_id", "left_anti"), keys.join(ids, "user_id", "left_anti")


def validate_users(users: DataFrame) -> DataFrame:
    """user_id and the sorted names of broken rules."""
    def repeated(c):
        return users.where(F.col(c).isNotNull()).groupBy(c).count().where("count > 1").select(c, F.lit(True).alias(f"{c}_twice"))

    u = users.join(repeated("username"), "username", "left").join(repeated("email"), "email", "left")
    rules = {
        "email_taken": F.col("email_twice"), "username_format": ~F.coalesce(F.col("username").rlike("^[a-zA-Z0-9_-]+$"), F.lit(False)),
        "username_length": ~F.coalesce(F.length("username").between(3, 50), F.lit(False)), "username_taken": F.col("username_twice"),
    }
    found = F.filter(F.array(*[F.when(c, k) for k, c in rules.items()]), lambda x: x.isNotNull())
    return u.select("user_id", found.alias("violations"))
