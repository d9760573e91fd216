"""Limits of a run by environment. The session says which one, under ``floorlake.environment``; any other name means development."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import SparkSession

ENVIRONMENT = "floorlake.environment"


# The reference's defaults and what its environments change.
@dataclass(frozen=True)
class Settings:
    num_classes: int = 4
    detection_min_confidence: float = 0.15
    image_max_dim: int = 1600
    max_image_size: int = 2048
    min_image_size: int = 100
    allow_image_resize: bool = True
    enable_caching: bool = True
    cache_timeout: int = 300
    max_memory_usage_mb: int = 1024
    debug: bool = True
    log_level: str = "INFO"


DEVELOPMENT = Settings(log_level="DEBUG")
ENVIRONMENTS = {
    "development": DEVELOPMENT,
    "production": replace(Settings(), debug=False, log_level="WARNING", cache_timeout=600),
    "testing": replace(DEVELOPMENT, enable_caching=False),
}


def settings(spark: SparkSession, environment: str | None = None) -> Settings:
    return ENVIRONMENTS.get(environment or spark.conf.get(ENVIRONMENT, "development"), DEVELOPMENT)
