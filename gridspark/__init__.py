"""gridspark: grid fields, interval series, cell graphs, ledgers and corpora as PySpark jobs."""
