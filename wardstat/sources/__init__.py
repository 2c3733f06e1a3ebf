"""Sources: OMOP tables from CSV/Parquet, code dictionaries and
descriptions, and the driver-table adapter."""
