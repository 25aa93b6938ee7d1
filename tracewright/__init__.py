"""Evidence-graph analytics on PySpark: relational kernels, fixpoints, argumentation and provenance."""
