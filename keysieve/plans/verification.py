"""Verdicts on secrets, supplied from outside.  Nothing here tests a credential."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysieve.functions.identity import has_verifier, http_message, http_status
from keysieve.operators.skew import latest, skew_join


def apply_verdicts(findings: DataFrame, verdicts: DataFrame, key=("rule_id", "secret_id")
                   ) -> DataFrame:
    """Findings with the status of the last verdict on their secret.

    ``verdicts`` has the key, http_code and checked_at.  A secret may have copies in a
    third of all findings; its rows are dealt out over many tasks.
    """
    key = list(key)
    last = latest(verdicts.select(*key, "http_code", "checked_at"), key,
                  F.struct("checked_at", "http_code"))
    code = F.col("http_code")
    status = (F.when(~has_verifier(F.col("rule_id")), "not_supported")
              .when(code.isNull(), "pending").otherwise(http_status(code)))
    message = (F.when(~has_verifier(F.col("rule_id")), "No verifier for this secret type")
               .when(code.isNotNull(), http_message(code)))
    return skew_join(findings, last, key, "left").withColumn(
        "verification_status", status).withColumn("verification_message", message).withColumn(
        "verified_at", F.col("checked_at")).drop("http_code", "checked_at")
