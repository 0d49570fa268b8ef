"""Frozen decision rules for pattern-search hits and labels, as ordered CASE columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import first_match, join_reasons


@dataclass(frozen=True)
class HitRules:
    """The review thresholds. Equality at an e-value limit goes to review."""

    max_sequence_evalue: float = 1e-5
    max_domain_evalue: float = 1e-5
    min_hit_length: int = 30
    min_hmm_coverage: float = 0.5


#: Decimal notation only; a cast alone would also take ``1d``, ``1f`` and ``0x1p3``.
DECIMAL = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def parse_nonnegative(raw: Column) -> Column:
    """Blank gives NULL; anything else must be a finite number that is not negative."""
    return F.when(is_nonnegative_number(raw), raw.try_cast("double"))


def is_nonnegative_number(raw: Column) -> Column:
    number = F.when(raw.rlike(DECIMAL), raw.try_cast("double"))
    infinite = number == F.lit(float("inf"))
    return F.coalesce(~F.isnan(number) & (number >= 0) & ~infinite, F.lit(False))


def bad_number(raw: Column) -> Column:
    """A cell that is neither blank nor a finite non-negative number."""
    return F.coalesce(raw != "", F.lit(False)) & ~is_nonnegative_number(raw)


def interval_length(start: Column, end: Column) -> Column:
    return end - start + 1


def coverage(start: Column, end: Column, total: Column) -> Column:
    return F.try_divide(interval_length(start, end).cast("double"), total.cast("double"))


def inside(start: Column, end: Column, total: Column) -> Column:
    """``1 <= start <= end <= total``, false when a bound is missing."""
    return F.coalesce((start >= 1) & (start <= end) & (end <= total), F.lit(False))


def review_reasons(
    evalue: Column, domain_evalue: Column, hmm_coverage: Column, hit_length: Column, rules: HitRules
) -> Column:
    missing = evalue.isNull() | domain_evalue.isNull()
    weak = (evalue >= rules.max_sequence_evalue) | (domain_evalue >= rules.max_domain_evalue)
    return join_reasons(
        [
            (missing, "significance_missing"),
            (~missing & weak, "weak_or_boundary_evalue"),
            (hmm_coverage.isNull(), "hmm_coverage_missing"),
            (hmm_coverage < rules.min_hmm_coverage, "low_hmm_coverage"),
            (hit_length < rules.min_hit_length, "short_hit"),
        ],
        "|",
    )


def hit_status(reasons: Column) -> Column:
    return F.when(reasons == "", F.lit("accepted")).otherwise(F.lit("needs_review"))


def classify_hit(
    has_cutoff_hit: Column,
    included_domains: Column,
    permissive_score: Column,
    permissive_best_domain: Column,
    sequence_cutoff: float | Column,
    domain_cutoff: float | Column,
    boundary: float,
) -> Column:
    """Six states of one sequence, from a search at cutoffs and a permissive one.

    A NULL ``permissive_score`` means no permissive hit. A permissive hit
    without domains lies infinitely far below the domain cutoff.
    """
    best = F.coalesce(permissive_best_domain, F.lit(float("-inf")))
    distance = F.least(permissive_score - sequence_cutoff, best - domain_cutoff)
    return first_match(
        [
            (has_cutoff_hit & (F.coalesce(included_domains, F.lit(0)) == 0), "failed"),
            (has_cutoff_hit & (included_domains > 1), "multi_hit"),
            (has_cutoff_hit, "accepted"),
            (permissive_score.isNull(), "no_hit"),
            (distance >= -boundary, "boundary"),
        ],
        "weak_hit",
    )


def scan_state(
    global_error: Column,
    result_present: Column,
    parse_failed: Column,
    review_hits: Column,
    hits: Column,
    eligible_for_negative: Column,
) -> Column:
    """State of one submitted record; an error of the whole run comes first."""
    return first_match(
        [
            (F.coalesce(global_error, F.lit("")) != "", global_error),
            (~result_present, "result_missing"),
            (parse_failed, "parse_failed"),
            (review_hits > 0, "needs_review"),
            ((hits == 0) & ~eligible_for_negative, "needs_review"),
        ],
        "success",
    )


def tri_state_label(state: Column, hits: Column) -> Column:
    """1 or 0 for a verified success; NULL otherwise, which is not a negative."""
    return F.when(state == "success", F.when(hits > 0, F.lit(1)).otherwise(F.lit(0)))


def label_text(label: Column) -> Column:
    return F.coalesce(label.cast("string"), F.lit(""))


def parse_status(state: Column) -> Column:
    return F.when(state.isin("success", "needs_review"), F.lit("success")).otherwise(state)


def artifact_status(actual: Column, expected: Column) -> Column:
    """``match``, ``mismatch``, or ``unverified_missing`` when there is nothing to hash."""
    return first_match(
        [(actual.isNull(), "unverified_missing"), (F.coalesce(actual == expected, F.lit(False)), "match")],
        "mismatch",
    )
