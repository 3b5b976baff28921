"""DataFrame-to-DataFrame operators: routing, extraction, loading, history, reports."""
