"""Who sees and does what, and which rows are well formed: predicates and joins over users, roles and rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from agendum.functions import text as X

# fixed values: roles by rank
ROLES = {"viewer": 0, "reviewer": 1, "admin": 2}
# fixed values: how long texts may be where they are kept
LENGTHS = {"summary": 255, "owner": 255, "error": 512, "note": 2000, "reason": 500, "excerpt": 200, "message": 300}


def rank(role: Column) -> Column:
    """A role's rank; null for an unknown one, which may do nothing."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair]), role)


def may(role: Column, least: str) -> Column:
    return F.coalesce(rank(role) >= ROLES[least], F.lit(False))


def where_equal(rows: DataFrame, **wanted) -> DataFrame:
    """The rows whose columns have these values; those asked for as None don't matter."""
    for column, value in wanted.items():
        rows = rows if value is None else rows.where(F.col(column) == value)
    return rows


def where_contains(rows: DataFrame, column: str, part: str | None) -> DataFrame:
    """The rows whose column holds a text, whatever the case; all if that is blank."""
    return rows.where(F.contains(F.lower(column), F.lit(part.strip().lower()))) if part and part.strip() else rows


def visible(rows: DataFrame, jobs: DataFrame, user_id, role: str) -> DataFrame:
    """Row-level security: an admin sees all rows (job_id, ...), others those of jobs (job_id, owner_id) that they own."""
    own = jobs if role == "admin" else jobs.where(F.col("owner_id") == user_id)
    return rows.join(own.select("job_id"), "job_id", "left_semi")


def gates_for(gates: DataFrame, jobs: DataFrame, user_id, role: str, status: str | None = "pending") -> DataFrame:
    """The gates of a status with the columns of their jobs that the user may see."""
    own = jobs if role == "admin" else jobs.where(F.col("owner_id") == user_id)
    return where_equal(gates, status=status).join(own, "job_id")


def registered(people: DataFrame, approved: DataFrame) -> DataFrame:
    """The people (email, ...) whose address, trimmed and in lower case, is an approved one."""
    key = lambda rows: rows.withColumn("__email", X.email(F.col("email")))
    return key(people).join(key(approved).select("__email"), "__email", "left_semi").drop("__email")


def unmatched(rows: DataFrame, matched: DataFrame, *keys: str) -> DataFrame:
    """The rows that nothing was matched with."""
    return rows.join(matched.select(*keys), list(keys), "left_anti")


def shortened(column: Column, kind: str) -> Column:
    """A text cut to what its kind may hold."""
    return F.substring(column, 1, LENGTHS[kind])


def item_rules() -> dict[str, Column]:
    """What a well-formed draft item (text, confidence, owner, deadline, status) fulfils; null owners and deadlines do."""
    text, within = F.coalesce("text", F.lit("")), lambda c, n: F.coalesce(F.length(c) <= n, F.lit(True))
    return {
        "text_length": F.length(text).between(1, 4000), "confidence_range": F.coalesce(F.col("confidence").between(0, 1), F.lit(False)),
        "owner_length": within("owner", 255), "deadline_length": within("deadline", 64), "edited_text": (F.coalesce("status", F.lit("")) != "edited") | (X.strip(text) != ""),
    }


def checked(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds `problems`, the names of the rules that a row breaks."""
    return rows.withColumn("problems", F.array_compact(F.array(*[F.when(~rule, F.lit(name)) for name, rule in rules.items()])))


def split(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that break no rule, and those in quarantine with their problems."""
    looked = checked(rows, rules)
    return looked.where(F.size("problems") == 0).drop("problems"), looked.where(F.size("problems") > 0)
