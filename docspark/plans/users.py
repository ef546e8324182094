"""Queries over users; customers play registered users."""

from __future__ import annotations

from pyspark.sql import functions as F

from docspark.operators import users
from docspark.plans import views
from docspark.plans.registry import Tables, query

WITH = f"WITH {views.USER_TABLE}"
NEW_USERS = """,
fresh AS (SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'user' || doc_id || '@example.com'
    ELSE 'new' || doc_id || '@example.org' END AS email,
  CASE WHEN doc_id % 5 = 0 THEN 'user' || (doc_id + 1) ELSE 'new' || doc_id END AS username FROM documents)"""


def fresh_users(t: Tables):
    """Documents as sign-ups, some with an email or a username already taken."""
    d = F.col("doc_id")
    s = d.cast("string")
    return t.documents.select(
        d.alias("id"),
        F.when(d % 3 == 0, F.concat(F.lit("user"), s, F.lit("@example.com")))
        .otherwise(F.concat(F.lit("new"), s, F.lit("@example.org"))).alias("email"),
        F.when(d % 5 == 0, F.concat(F.lit("user"), (d + 1).cast("string"))).otherwise(F.concat(F.lit("new"), s))
        .alias("username"),
    )


@query(
    "user_conflicts",
    WITH + NEW_USERS
    + """
SELECT id FROM fresh f WHERE EXISTS (SELECT 1 FROM user_table u WHERE u.email = f.email)
  OR EXISTS (SELECT 1 FROM user_table u WHERE u.username = f.username)""",
)
def user_conflicts(t: Tables):
    return users.user_conflicts(fresh_users(t), views.user_table(t))


@query(
    "accepted_users",
    WITH + NEW_USERS
    + """
SELECT id, email, username FROM fresh f WHERE NOT EXISTS (SELECT 1 FROM user_table u WHERE u.email = f.email)
  AND NOT EXISTS (SELECT 1 FROM user_table u WHERE u.username = f.username)""",
)
def accepted_users(t: Tables):
    return users.accept_users(fresh_users(t), views.user_table(t))


@query(
    "validate_users",
    WITH
    + r""",
raw AS (SELECT id, CASE WHEN id % 4 = 0 THEN replace(email, '@', ' at ') WHEN id % 7 = 0 THEN '.' || email
    WHEN id % 11 = 0 THEN 'a..' || email ELSE email END AS email,
  CASE WHEN id % 6 = 0 THEN 'ab' ELSE username END AS username,
  CASE WHEN id % 9 = 0 THEN 'short' ELSE password END AS password, CASE WHEN id % 2 = 0 THEN role END AS role
  FROM user_table)
SELECT id, coalesce(role, 'user') AS role, list_filter([
  CASE WHEN starts_with(email, '.') OR contains(email, '..') OR NOT regexp_matches(email, '^[A-Za-z0-9_''+\-.]*[A-Za-z0-9_+\-]@([A-Za-z0-9][A-Za-z0-9\-]*\.)+[A-Za-z]{2,}$')
    THEN 'email is not valid' END,
  CASE WHEN length(username) NOT BETWEEN 3 AND 50 THEN 'username must have 3 to 50 characters' END,
  CASE WHEN length(password) NOT BETWEEN 6 AND 100 THEN 'password must have 6 to 100 characters' END],
  lambda r: r IS NOT NULL) AS reasons FROM raw""",
)
def validate_users(t: Tables):
    i = F.col("id")
    raw = views.user_table(t).select(
        "id",
        F.when(i % 4 == 0, F.replace("email", F.lit("@"), F.lit(" at ")))
        .when(i % 7 == 0, F.concat(F.lit("."), "email")).when(i % 11 == 0, F.concat(F.lit("a.."), "email"))
        .otherwise(F.col("email")).alias("email"),
        F.when(i % 6 == 0, "ab").otherwise(F.col("username")).alias("username"),
        F.when(i % 9 == 0, "short").otherwise(F.col("password")).alias("password"),
        F.when(i % 2 == 0, F.col("role")).alias("role"),
    )
    return users.validate_users(raw).select("id", "role", "reasons")


@query("newest_users", WITH + "\nSELECT id, email, username, role, created_at FROM user_table")
def newest_users(t: Tables):
    return users.newest_users(views.user_table(t))


@query(
    "role_counts",
    WITH
    + """
SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE role = 'admin') AS BIGINT) AS admins,
  CAST(count(*) FILTER (WHERE role = 'user') AS BIGINT) AS users FROM user_table""",
)
def role_counts(t: Tables):
    return users.role_counts(views.user_table(t))
