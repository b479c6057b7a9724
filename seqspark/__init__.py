"""seqspark: labelled event-sequence analytics as plain PySpark DataFrame transforms."""
