"""Operators: lazy DataFrame -> DataFrame steps (cohort, range joins, stays,
readmissions, scorecard, code statistics)."""
