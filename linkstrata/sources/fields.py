"""Mapping of foreign field names to the canonical model (P2, §1.1)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CANONICAL = ("mention_id", "mention_text", "mention_image_list", "gold_entity_id", "entity_id", "entity_name", "entity_description", "entity_image_list")


@dataclass(frozen=True)
class FieldMap:
    """Canonical name to the name in a source; what a source lacks is null."""

    fields: dict[str, str]

    def apply(self, rows: DataFrame) -> DataFrame:
        unknown = set(self.fields) - set(CANONICAL)
        if unknown:
            raise ValueError(f"not in the canonical model: {sorted(unknown)}")
        return rows.select(*(F.col(self.fields[c]).alias(c) if c in self.fields else F.lit(None).cast("string").alias(c) for c in CANONICAL))
