"""Delivery CSV sink: all or nothing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import delivery_columns
from ..operators.delivery import freeze, run_counts, violations
from ..operators.normalization import Vocabulary
from ..scale import materialize

SHOWN = 20  # problems shown beside the full table of violations


def write_delivery(delivery: DataFrame, path: str, template: DataFrame, vocab: Vocabulary | None = None,
                   eligible: DataFrame | None = None, problems: DataFrame | None = None,
                   known: DataFrame | None = None) -> dict:
    """Validate the whole batch, write CSV parts beside the target, check the written
    header and row count, then swap the folder in. Any violation or failure leaves no new output,
    and an earlier delivery stays until the new one is in place.

    A failed validation returns all its reasons: `violations` is a written table
    (product_id, slot, problem), `error_count` its size, and `sample` some problems to show. It names one product
    of each repeated part number; an attempt without the named products takes that table as `known`, and delivers
    the other products of such a number.
    """
    spark = delivery.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    rows = materialize(freeze(delivery), "delivery")
    if eligible is not None:
        wanted = eligible.where(F.col("eligibility").isin("approved", "partial"))
        rows = materialize(rows.join(wanted.select("product_id"), "product_id", "left_semi"), "deliverable")
    counts = run_counts(eligible).first().asDict() if eligible is not None else {}
    found = violations(rows, template, vocab, known)
    if problems is not None:
        found = found.unionByName(problems.select("product_id", F.lit(0).alias("slot"), "problem"))
    found = materialize(found, "violations")
    total = found.count()
    if total:
        sample = [r.problem for r in found.select("problem").limit(SHOWN).collect()]
        return {"status": "OUTPUT_GENERATION_FAILED", "violations": found, "error_count": total, "sample": sample, **counts}
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    draft = f"{path.rstrip('/')}.draft-{uuid.uuid4().hex}"
    draft_path = jvm.org.apache.hadoop.fs.Path(draft)
    try:
        columns = delivery_columns()
        (rows.select(*[F.col(f"`{c}`") for c in columns]).write.option("header", True).option("emptyValue", "")
         .option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", False)
         .option("ignoreTrailingWhiteSpace", False).csv(draft))
        back = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option(
            "escape", '"').csv(draft)
        if back.columns != columns or back.count() != rows.count():
            raise ValueError("written delivery does not match the contract")
        swap_in(fs, draft_path, target, jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.old-{uuid.uuid4().hex}"))
    except Exception as exc:
        fs.delete(draft_path, True)
        return {"status": "OUTPUT_GENERATION_FAILED", "error_count": 1, "sample": [str(exc)], **counts}
    return {"status": "COMPLETED", "output_file": path, "error_count": 0, "sample": [], **counts}


def swap_in(fs, draft, target, aside) -> None:
    """Move the old folder aside, the new one in, and only then delete the old one."""
    had = fs.exists(target)
    if had and not fs.rename(target, aside):
        raise OSError(f"could not move the former delivery from {target}")
    if not fs.rename(draft, target):
        if had:
            fs.rename(aside, target)
        raise OSError(f"could not move delivery to {target}")
    if had:
        fs.delete(aside, True)
