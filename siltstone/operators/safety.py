"""The ordered safety verdict: deny before allow, the first match decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import paths as P
from siltstone.operators import rules as R

BLOCKED, REVIEW, ELIGIBLE = "blocked", "review_only", "eligible"


def finance_token(name: Column, tokens: tuple[str, ...] = R.FINANCE_TOKENS) -> Column:
    """The first token that the lower-case name contains anywhere; null for none."""
    low = F.lower(name)
    hits = F.array(*(F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in tokens))
    return F.get(F.array_compact(hits), F.lit(0))


def reason(dev_artifacts: bool = True, deny: tuple[str, ...] = (), allow: tuple[str, ...] = (), protected: tuple[str, ...] = R.PROTECTED_ROOTS) -> Column:
    """The reason code of a row."""
    path = F.col("path")
    in_modules = P.has_segment(path, "node_modules")
    in_repo = F.col("git_repo_root").isNotNull()
    exempt = in_modules & F.col("git_repo_clean") & F.lit(dev_artifacts)
    token = finance_token(P.name_of(path)).isNotNull()
    allowed = P.matches_any(path, allow)
    return (
        F.when(P.is_network_path(path), "unc_network_path")
        .when(P.matches_any(path, protected), "protected_system_root")
        .when(in_repo & ~exempt & in_modules & ~F.col("git_repo_clean"), "git_node_modules_dirty")
        .when(in_repo & ~exempt, "in_git_repository")
        .when(F.col("ext").isin(*R.PROTECTED_EXTENSIONS), "protected_extension")
        .when(P.has_segment(path, ".ssh"), "ssh_directory")
        .when(F.col("ext").isin(*R.DATABASE_EXTENSIONS), "database_file")
        .when(F.col("ext").isin(*R.VM_EXTENSIONS), "vm_image")
        .when(P.matches_any(path, R.CONTAINER_ROOTS), "docker_wsl_root")
        .when(F.col("is_cloud_placeholder"), "cloud_placeholder")
        .when(P.matches_any(path, deny), "user_denied")
        .when(token & allowed, "finance_token_allowed")
        .when(token, "finance_token")
        .when(allowed, "user_allowed")
        .when(in_repo & exempt, "node_modules_exempt")
        .otherwise("default_eligible")
    )


ALLOWING = ("finance_token_allowed", "user_allowed", "node_modules_exempt", "default_eligible")


def verdict_of(code: Column) -> Column:
    """The verdict that a reason code stands for."""
    return F.when(code == "finance_token", REVIEW).when(code.isin(*ALLOWING), ELIGIBLE).otherwise(BLOCKED)


def with_verdict(rows: DataFrame, **options) -> DataFrame:
    """Rows with reason_code and verdict."""
    return rows.withColumn("reason_code", reason(**options)).withColumn("verdict", verdict_of(F.col("reason_code")))


def categories(mode: str = "power") -> dict[str, tuple[bool, int | None, bool]]:
    """The category table, with the careful mode's groups off."""
    off = R.OFF_IN_SAFE_MODE if mode == "safe" else ()
    return {g: (on and g not in off, days, exempt) for g, (on, days, exempt) in R.CATEGORIES.items()}


def current_mode(log: DataFrame) -> DataFrame:
    """The mode of the last line (seq, to_mode); safe for an empty log."""
    return log.agg(F.coalesce(F.max_by("to_mode", "seq"), F.lit("safe")).alias("mode"))
