"""Digests of operators' results, as columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)
