"""One archive of a cleaned corpus: its records and a report of the stages, for download."""

from __future__ import annotations

import json
import os
import tempfile
import zipfile

from pyspark.sql import DataFrame

from ..config import OutputFormat
from ..operators import analyze, validate
from ..plans import pipeline
from ..scratch import written
from . import write

SUFFIX = {OutputFormat.CSV: ".csv", OutputFormat.JSON: ".json", OutputFormat.PARQUET: ".parquet", OutputFormat.TSV: ".tsv"}


def bundle(units: DataFrame, path: str, fmt: OutputFormat | str = OutputFormat.JSONL, plan: pipeline.Plan = pipeline.Plan()) -> dict:
    """A ZIP file at path: dataset (a file, or a folder of Parquet parts; splits under hf_splits) and pipeline_report.json, which it returns.

    The report has counts, validation before cleaning and after deduplication, and statistics. One
    file passes the driver: for corpora too large for that use pipeline.run().
    """
    fmt = OutputFormat(fmt.lower()) if not isinstance(fmt, OutputFormat) else fmt
    units = written(units, "input")
    ready, counts = pipeline.prepare(units, plan)
    report = {"pipeline": {**counts, "validation_pre": validate.report(units), "validation_post": validate.report(ready)}, "stats": analyze.summary(ready)}
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with tempfile.TemporaryDirectory() as folder:
        at = os.path.join(folder, "hf_splits" if fmt is OutputFormat.HF_DATASET else f"dataset{SUFFIX.get(fmt, '.jsonl')}")
        write.convert(ready, at if fmt is not OutputFormat.PARQUET else f"file://{at}", fmt, plan.options, single=True)
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
            out.writestr("pipeline_report.json", json.dumps(report, ensure_ascii=False, indent=2))
            for base, _, names in os.walk(folder):
                for name in sorted(names):
                    if not name.startswith((".", "_")):
                        full = os.path.join(base, name)
                        out.write(full, os.path.relpath(full, folder))
    return report
