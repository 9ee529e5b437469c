"""DataFrame -> DataFrame operators (cleaning, features, text, encoding,
importance, metrics, chart tables, models)."""
