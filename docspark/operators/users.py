"""User table jobs: validation, conflicts, public projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.functions import patterns

PUBLIC = ["id", "email", "username", "role", "created_at"]


def validate_users(df: DataFrame) -> DataFrame:
    """Adds the default role and ``reasons``: one entry per invalid field."""
    def length_between(name: str, low: int, high: int):
        n = F.length(name)
        return F.when(F.coalesce((n < low) | (n > high), F.lit(True)), f"{name} must have {low} to {high} characters")

    email = F.when(
        ~F.coalesce(F.col("email").rlike(patterns.EMAIL), F.lit(False)),
        "email is not valid",
    )
    reasons = F.array_compact(F.array(email, length_between("username", 3, 50), length_between("password", 6, 100)))
    return df.withColumn("role", F.coalesce("role", F.lit("user"))).withColumn("reasons", reasons)


def user_conflicts(new: DataFrame, existing: DataFrame, key: str = "id") -> DataFrame:
    """New users whose email or username is taken: two equi semi-joins, united.

    An OR condition in one join would force a nested loop.
    """
    by_email = new.join(existing.select("email").distinct(), "email", "left_semi")
    by_name = new.join(existing.select("username").distinct(), "username", "left_semi")
    return by_email.select(key).union(by_name.select(key)).distinct()


def accept_users(new: DataFrame, existing: DataFrame) -> DataFrame:
    """New users with neither email nor username taken."""
    free = new.join(existing.select("email").distinct(), "email", "left_anti")
    return free.join(existing.select("username").distinct(), "username", "left_anti")


def public_users(df: DataFrame) -> DataFrame:
    """Users without their password; the column is pruned from the scan."""
    return df.select(*PUBLIC)


def newest_users(df: DataFrame) -> DataFrame:
    return public_users(df).orderBy(F.col("created_at").desc(), "id")


def role_counts(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("role") == "admin").alias("admins"),
        F.count_if(F.col("role") == "user").alias("users"),
    )
