"""Plans: the one-plan readmission analysis, the batch run, and the
registered queries with their SQL oracle."""
