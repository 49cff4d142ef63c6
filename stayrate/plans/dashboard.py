"""All figures of the dashboard over one filtered scored table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from stayrate.operators import reports
from stayrate.operators.checks import filter_members, require_non_empty

FILTERS = ("gender", "membership_type", "rfm_segment")


def dashboard(scored: DataFrame, allowed: dict[str, Sequence[str]] | None = None) -> dict[str, DataFrame]:
    """Filter, then the headline figures, the five charts and the high-risk table.

    The filtered columns are kept while the figures are read; call ``unpersist`` on ``"rows"`` after.
    An empty selection is an error.
    """
    needed = [
        *FILTERS, "customer_id", "churn", "predicted_churn", "average_order_value", "total_spend",
        "last_purchase_date", "engagement_score", "loyalty_score",
    ]
    rows = filter_members(scored, allowed) if allowed else scored
    require_non_empty(rows)
    rows = rows.select(*needed).persist(StorageLevel.MEMORY_AND_DISK)
    return {
        "rows": rows,
        "kpis": reports.dashboard_kpis(rows),
        "churn_distribution": reports.churn_distribution(rows),
        "segment_counts": reports.segment_counts(rows),
        "monthly_revenue": reports.monthly_revenue(rows),
        "churn_by_membership": reports.churn_by_membership(rows),
        "engagement_by_prediction": reports.engagement_by_prediction(rows),
        "top_high_risk": reports.display_names(reports.top_high_risk(rows)),
    }
