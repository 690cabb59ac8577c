"""Composite reports (audit, insights, cleaning, exploratory, column, one-click)."""

from .audit import audit_report
from .reports import (cleaning_suggestions, column_report, eda_findings, eda_report,
                      insights_report, one_click_findings, one_click_report, time_analysis)

__all__ = ["audit_report", "cleaning_suggestions", "column_report", "eda_findings", "eda_report",
           "insights_report", "one_click_findings", "one_click_report", "time_analysis"]
