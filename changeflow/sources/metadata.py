"""Rules, transforms and mappings of one config from metadata tables. They become expressions, so they come to the driver."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeflow.schemas import Mapping, Rule, Transform

def load_rules(rules: DataFrame, config_id: str) -> list[Rule]:
    """Enabled rules of one config."""
    rows = rules.where((F.col("config_id") == config_id) & F.col("is_enabled"))
    columns = rows.select("id", "field_name", "rule_type", "rule_params", "severity").orderBy("field_name", "id")
    return [Rule(r.id, r.field_name, r.rule_type, json.loads(r.rule_params or "{}"), r.severity or "warn")
            for r in columns.collect()]


def load_transforms(transforms: DataFrame, config_id: str) -> list[Transform]:
    """Enabled transforms of one config in execution order."""
    rows = transforms.where((F.col("config_id") == config_id) & F.col("is_enabled"))
    columns = rows.select("source_field", "transform_type", "transform_params", "execution_order")
    return [Transform(r.source_field, r.transform_type, json.loads(r.transform_params or "{}"), r.execution_order or 0)
            for r in columns.orderBy("execution_order", "source_field").collect()]


def load_mappings(configs: DataFrame, config_id: str) -> list[Mapping]:
    """Field mappings of one config."""
    rows = configs.where(F.col("id") == config_id).select(F.explode("field_mappings").alias("m")).select("m.*")
    return [Mapping(r.source, r.target, r.transform) for r in rows.collect()]
