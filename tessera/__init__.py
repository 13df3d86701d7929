"""PySpark-native analytics for canonical records: text forms, identities, patches, frames and validation."""
