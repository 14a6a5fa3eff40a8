"""Preparation of parallel corpora for training, on Spark."""

from .config import CleanConfig, ConvertOptions, OutputFormat, ValidationConfig

__all__ = ["CleanConfig", "ConvertOptions", "OutputFormat", "ValidationConfig"]
