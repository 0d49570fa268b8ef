"""Deposited positions of a structure joined to modelled residues and aligned states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import constraints as c


def structure_map(deposited: DataFrame, modelled: DataFrame, aligned: DataFrame) -> DataFrame:
    """One row per deposited position. ``aligned`` has (file, raw_position, match_state, is_insertion)."""
    model = modelled.select(
        "file", F.col("residue_number").alias("deposited_position"),
        F.col("residue_number").alias("pdb_residue_number"),
        F.col("insertion_code").alias("pdb_insertion_code"), "secondary_structure",
    )
    states = aligned.select(
        "file", F.col("raw_position").alias("deposited_position"),
        F.col("match_state").alias("hmm_match_state"), F.col("is_insertion").alias("is_hmm_insertion"),
        F.lit(True).alias("_aligned"),
    )
    keys = ["file", "deposited_position"]
    return deposited.join(model, keys, "left").join(states, keys, "left").select(
        "file", "deposited_position", "pdb_residue_number", "pdb_insertion_code", "residue",
        F.col("pdb_residue_number").isNotNull().alias("modeled"), "secondary_structure",
        "hmm_match_state", "is_hmm_insertion", F.col("_aligned").isNotNull().alias("hmm_aligned"),
    )


def alignment_violations(aligned: DataFrame) -> DataFrame:
    return c.unique_key(aligned, ["file", "raw_position"], "duplicate residue position")


def structure_summary(mapped: DataFrame) -> DataFrame:
    return mapped.groupBy("file").agg(
        F.count(F.lit(1)).alias("n_deposited_residues"),
        F.count_if("modeled").alias("n_modeled_residues"),
        F.count_if(~F.col("modeled")).alias("n_unmodeled_residues"),
        F.count_if("hmm_aligned").alias("n_hmm_aligned_residues"),
        F.count_if(F.col("modeled") & F.col("hmm_aligned")).alias("n_modeled_hmm_aligned_residues"),
        F.count("hmm_match_state").alias("n_hmm_match_residues"),
        F.count_if("is_hmm_insertion").alias("n_hmm_insertions"),
        F.count_distinct("hmm_match_state").alias("n_distinct_hmm_match_states"),
    )
