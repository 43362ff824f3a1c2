"""flowsentry: PySpark jobs for network-traffic security analytics."""
