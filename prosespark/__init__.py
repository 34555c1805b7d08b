"""PySpark-native prose audit: units, sentences and words as DataFrames, metrics, ledgers, edits and learning."""
