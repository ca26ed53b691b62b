"""Composed plans (scorecard, matrix compile, scenario report) and the query catalog that
``__spark_entry__`` exposes."""
