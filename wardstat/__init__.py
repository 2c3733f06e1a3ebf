"""wardstat: clinical cohort and surgical-readmission analytics on Spark."""

__version__ = "0.1.0"
