"""End-to-end plan: evidence -> assessment -> scored subsets -> contingency report.

1. drug pairs: the rows of pairs without drug evidence leave every source
   first, by a semi join on the raw evidence;
2. assessment: per source, the one side table its rules need and one CASE;
3. pair profile: evidence counted per (pair, source, label) with map-side
   combination, then folded to one row per pair;
4. report: the scored rows counted per label combination, then the grid.

No join carries a hint and nothing is counted, cached or sized while the
plan is built: Spark picks the joins by bytes when it runs.  ``run``
checkpoints the scored table to the session's checkpoint folder, so a lost
executor never recomputes the evidence scan for the report.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.annotate import matching_pairs, oncogene_label
from ..operators.assess import Sides, assess
from ..operators.clinical import PAIR_FLAG, clinical_spine, pair_profile, restrict_to_drug_pairs
from ..operators.contingency import LABEL_COLUMNS, contingency_grid
from ..operators.matrix import label_counts
from ..operators.ontology import primary_area
from ..operators.scoring import score
from ..session import ensure_checkpoint_dir
from ..sources.sinks import write_contingency
from .inputs import Inputs


def sides(inputs: Inputs) -> Sides:
    return Sides(oncogene_label(inputs.targets), inputs.study, matching_pairs(inputs.mechanisms))


def assessed(inputs: Inputs, full: bool = False, only: str | None = None, split: int = 0) -> DataFrame:
    """All evidence, assessed (of one source with ``only``; with every annotation with ``full``;
    with hot keys of the joins dealt over ``split`` places)."""
    return assess(inputs.evidence, sides(inputs), inputs.params, full=full, only=only, split=split)


def area(inputs: Inputs) -> DataFrame:
    return primary_area(inputs.diseases)


def spine(inputs: Inputs, keep_subsets: bool = False) -> DataFrame:
    rows = assess(restrict_to_drug_pairs(inputs.evidence), sides(inputs), inputs.params)
    return clinical_spine(pair_profile(label_counts(rows)), area(inputs), keep_subsets=keep_subsets)


def scored(inputs: Inputs, keep_pair_flag: bool = False, persist: bool = False, labels_only: bool = False) -> DataFrame:
    """One row per (subset, spine row).  With ``persist`` they are kept in memory
    and on disk when first computed, for several reports of one session; the
    caller unpersists them.  With ``labels_only`` the rows have the columns that
    the reports read (``LABEL_COLUMNS``) and no others, so nothing else is kept."""
    rows = score(spine(inputs, keep_subsets=True), keep_pair_flag)
    if labels_only:
        rows = rows.select(*LABEL_COLUMNS, *([PAIR_FLAG] if keep_pair_flag else []))
    return rows.persist() if persist else rows


def report(inputs: Inputs) -> DataFrame:
    """The contingency grid in one pass over the evidence."""
    return contingency_grid(scored(inputs, keep_pair_flag=True), pair_flag=PAIR_FLAG)


def run(spark: SparkSession, inputs: Inputs, out_path: str, run_date: str) -> DataFrame:
    """Compute the report and write it; returns the checkpointed scored table."""
    ensure_checkpoint_dir(spark)
    scored_rows = scored(inputs, keep_pair_flag=True).checkpoint(eager=True)
    write_contingency(contingency_grid(scored_rows, pair_flag=PAIR_FLAG), out_path, run_date)
    return scored_rows.drop(PAIR_FLAG)
