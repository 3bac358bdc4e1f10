"""Access policy over request tables, visibility, user directory, token events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from ..functions.scalars import role_rank

MATRICES = {"rbac": vocab.RBAC_MATRIX, "opa": vocab.OPA_MATRIX}


def required_rank(resource: Column, action: Column, matrix: str = "rbac") -> Column:
    """Lowest role rank allowed, NULL for unknown pairs. A literal map: no join per request."""
    pairs = []
    for res, actions in MATRICES[matrix].items():
        for act, role in actions.items():
            pairs += [F.lit(f"{res}.{act}"), F.lit(vocab.ROLES.index(role))]
    return F.try_element_at(F.create_map(*pairs), F.concat_ws(".", resource, action))


def rbac_decisions(requests: DataFrame, matrix: str = "rbac") -> DataFrame:
    """Adds ``allowed``: unknown role, resource or action is denied."""
    need = required_rank(F.col("resource"), F.col("action"), matrix)
    return requests.withColumn("allowed", F.coalesce(role_rank("role") >= need, F.lit(False)))


def policy_decisions(requests: DataFrame, mode: str = "as_written") -> DataFrame:
    """Adds ``allowed`` under the central policy.

    Request columns: role, resource, action, and the context fields blocked,
    emergency_access, asset_steward, asset_owner, user_email, justification,
    sensitivity_level, each of which may be missing (NULL). A rule that touches a
    missing field does not grant; ``not blocked`` holds when the field is missing.
    ``mode`` as_written keeps the ungated base rule, which makes the sensitivity
    denials moot; intended drops it.
    """
    def sure(test: Column) -> Column:
        return F.coalesce(test, F.lit(False))

    role, level = F.col("role"), F.col("sensitivity_level")
    ranked = sure(role_rank("role") >= required_rank(F.col("resource"), F.col("action"), "opa"))
    unblocked = ~sure(F.col("blocked"))
    emergency = sure(role == "admin") & sure(F.col("emergency_access"))
    owned = sure(F.col("asset_steward") == F.col("user_email")) | sure(F.col("asset_owner") == F.col("user_email"))
    steward = sure(role == "data_steward") & sure(F.col("resource") == "asset") & sure(F.col("action").isin("write", "delete")) & owned
    justified = (
        sure(role == "admin") & sure(F.col("resource") == "column") & sure(F.col("action") == "read_pii_value")
        & sure(F.col("justification") != "")
    )
    hidden = sure(role == "viewer") & sure(level.isin("CONFIDENTIAL", "RESTRICTED"))
    gated = ranked & unblocked & ~hidden
    allowed = emergency | steward | justified | gated
    if mode == "as_written":
        allowed = allowed | (ranked & unblocked)
    elif mode != "intended":
        raise ValueError(f"unknown mode: {mode}")
    return requests.withColumn("allowed", allowed)


def decision_counts(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("role").agg(
        F.count(F.lit(1)).alias("requests"), F.count_if("allowed").alias("allowed_count"), F.count_if(~F.col("allowed")).alias("denied_count")
    )


def permission_matrix(spark: SparkSession, matrix: str = "rbac") -> DataFrame:
    """Effective matrix: every role against every known pair (a fixed few dozen rows)."""
    rows = [
        (role, res, act, vocab.ROLES.index(role) >= vocab.ROLES.index(need))
        for role in vocab.ROLES for res, actions in MATRICES[matrix].items() for act, need in actions.items()
    ]
    return spark.createDataFrame(rows, "role string, resource string, action string, allowed boolean")


def visible_assets(assets: DataFrame, role: str) -> DataFrame:
    """What a role may see: viewers all but the levels the policy denies by name, unknown roles nothing."""
    if role not in vocab.ROLES:
        return assets.filter(F.lit(False))
    if vocab.ROLES.index(role) >= vocab.ROLES.index("data_analyst"):
        return assets
    return assets.filter(~F.coalesce(F.col("sensitivity_level").isin("CONFIDENTIAL", "RESTRICTED"), F.lit(False)))


def user_search(users: DataFrame, q: str | None = None, role: str | None = None, is_active: bool | None = None) -> DataFrame:
    if q:
        needle = q.lower()
        users = users.filter(F.lower("email").contains(needle) | F.lower("full_name").contains(needle))
    if role:
        users = users.filter(F.col("role") == role)
    if is_active is not None:
        users = users.filter(F.col("is_active") == is_active)
    return users


def token_outcomes(uses: DataFrame, issued: DataFrame, revoked: DataFrame) -> DataFrame:
    """Each use of a token as revoked, expired, ip_mismatch, unknown or valid.

    ``uses``: jti, used_at, request_ip; ``issued``: jti, ip, expires_at; ``revoked``: jti, revoked_at.
    Issue and revocation lists hold one row per token. Uses may be very uneven (one
    token with a third of them): both joins keep the uses on the streamed left side,
    where AQE can split a skewed partition.
    """
    gone = revoked.groupBy("jti").agg(F.min("revoked_at").alias("revoked_at"))
    joined = uses.join(issued.select("jti", "ip", "expires_at"), "jti", "left").join(gone, "jti", "left")
    outcome = (
        F.when(F.col("expires_at").isNull(), "unknown")
        .when(F.col("used_at") > F.col("expires_at"), "expired")
        .when(F.col("revoked_at") <= F.col("used_at"), "revoked")
        .when((F.col("ip") != F.col("request_ip")), "ip_mismatch")
        .otherwise("valid")
    )
    return joined.withColumn("outcome", outcome)
