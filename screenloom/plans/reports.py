"""The four sheets of the final report: written together, and each read back from the files."""

from __future__ import annotations

from screenloom.operators.reports import read_sheet, write_report
from screenloom.plans import hiring, interviews, learning
from screenloom.plans.registry import CHECKS, query
from screenloom.plans.screening import ranked
from screenloom.session import new_path, stage

SHEETS = {
    "pipeline": ("export_candidates", hiring.export_candidates),
    "schedule": ("schedule_report", hiring.schedule_report),
    "models": ("model_summary", learning.model_summary),
    "questions": ("questions", interviews.all_questions),
}


RANKED = ("pipeline", "schedule")  # sheets on the same ranking, which is computed once


def _sheet(name: str):
    def run(spark, d):
        """One sheet of a report of all four, from its file."""
        ranking = stage(ranked(spark, d), "ranking")
        sheets = {other: build(spark, d, ranking) if other in RANKED else build(spark, d) for other, (_, build) in SHEETS.items()}
        written = write_report(sheets, new_path(spark, "report"))
        return read_sheet(spark, written[name], sheets[name].schema)

    return run


for _name, (_base, _) in SHEETS.items():
    query(f"report_{_name}_sheet", CHECKS[_base])(_sheet(_name))
