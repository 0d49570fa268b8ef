"""Data-quality rules. Each returns its violations as rows (rule, key, detail)."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import sha256

# Letters of a sequence that travel as one row, rows of a task that groups by nearly unique keys,
# and the tasks to which a shuffle writes rows as they come; for more it sorts those of each map task in memory.
PIECE = 64
ROWS_A_TASK = 250_000
UNSORTED_TASKS = 200


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows dealt by their keys to as many tasks as their number asks for.

    Grouping by the same keys then needs no further shuffle and nothing is gathered before this one,
    so where keys rarely repeat a task holds about ``ROWS_A_TASK`` groups, however large an input file is.
    Beyond ``UNSORTED_TASKS`` tasks that number first grows to 20 times as many.
    """
    tasks = df.count() / ROWS_A_TASK
    return df.repartition(max(1, math.ceil(min(tasks, UNSORTED_TASKS)), math.ceil(tasks / 20)), *keys)


def violation(df: DataFrame, rule: str, key: Column, detail: Column | str) -> DataFrame:
    return df.select(
        F.lit(rule).alias("rule"),
        key.cast("string").alias("key"),
        (F.lit(detail) if isinstance(detail, str) else detail).alias("detail"),
    )


def check(df: DataFrame, rule: str, broken: Column, key: Column, detail: Column | str = "") -> DataFrame:
    """Rows for which ``broken`` is true; a NULL condition does not break a rule."""
    return violation(df.filter(broken), rule, key, detail)


def check_all(df: DataFrame, key: Column, rules: list[tuple[str, Column]]) -> DataFrame:
    """Several rules over the same rows in one pass."""
    broken = F.array_compact(F.array(*[F.when(condition, F.lit(rule)) for rule, condition in rules]))
    return df.select(
        F.explode(broken).alias("rule"), key.cast("string").alias("key"), F.lit("").alias("detail")
    )


def all_violations(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def enforce(violations: DataFrame, examples: int = 5) -> None:
    """Raise with the number of violations and the first few of them."""
    total = violations.count()
    if total:
        first = violations.orderBy("rule", "key", "detail").limit(examples).collect()
        shown = "; ".join(f"{r['rule']}: {r['key']} {r['detail']}".strip() for r in first)
        raise ValueError(f"{total} violations; first: {shown}")


def require_rows(df: DataFrame, message: str) -> None:
    if df.isEmpty():
        raise ValueError(message)


def unique_key(df: DataFrame, keys: list[str], rule: str = "duplicate key") -> DataFrame:
    """Keys that are blank or held by more than one row."""
    blank = reduce(
        lambda a, b: a | b,
        [F.col(k).isNull() | (F.col(k).cast("string") == "") for k in keys],
    )
    grouped = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    name = F.concat_ws(",", *[F.col(k).cast("string") for k in keys])
    return check(
        grouped, rule, blank | (F.col("_n") > 1), name,
        F.when(blank, F.lit("blank key")).otherwise(F.concat(F.col("_n").cast("string"), F.lit(" rows"))),
    )


def partition_coverage(expected: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """Every expected key is observed once; nothing else is. Both sides are counted first."""
    want = expected.groupBy(key).agg(F.count(F.lit(1)).alias("_want"))
    got = observed.groupBy(key).agg(F.count(F.lit(1)).alias("_got"))
    both = want.join(got, key, "full_outer")
    return violation(
        both.filter("_want is null or _got is null or _got > 1"),
        "coverage",
        F.col(key),
        F.when(F.col("_want").isNull(), "unknown member")
        .when(F.col("_got").isNull(), "missing")
        .otherwise("appears more than once"),
    )


def set_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, with the side they are on."""
    a = left.select(key).distinct().withColumn("_a", F.lit(True))
    b = right.select(key).distinct().withColumn("_b", F.lit(True))
    return violation(
        a.join(b, key, "full_outer").filter("_a is null or _b is null"),
        "set difference",
        F.col(key),
        F.when(F.col("_b").isNull(), "only left").otherwise("only right"),
    )


def agreement(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Values that differ between two tables with the same unique key."""
    pair = left.select(key, *columns).join(
        right.select(key, *[F.col(c).alias(f"_r_{c}") for c in columns]), key
    )
    differing = F.array_compact(
        F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_r_{c}")), F.lit(c)) for c in columns])
    )
    return violation(
        pair.withColumn("_differ", differing).filter(F.size("_differ") > 0),
        "agreement", F.col(key), F.array_join("_differ", ","),
    )


def leakage(leaking: DataFrame) -> DataFrame:
    return violation(leaking, "cluster leakage", F.col("cluster"), "assigned to more than one split")


def sequence_identity(
    df: DataFrame, key: str, sequence: str, length: str | None = None, digest: str | None = None
) -> DataFrame:
    """A sequence must be present and agree with its recorded length and digest."""
    seq = F.col(sequence)
    parts = [F.when(F.coalesce(seq, F.lit("")) == "", F.lit("empty"))]
    if length is not None:
        parts.append(F.when(~F.length(seq).eqNullSafe(F.col(length)), F.lit("length")))
    if digest is not None:
        parts.append(F.when(~sha256(seq).eqNullSafe(F.col(digest)), F.lit("digest")))
    found = F.array_join(F.array_compact(F.array(*parts)), ",")
    return violation(
        df.withColumn("_found", found).filter("_found <> ''"), "sequence identity", F.col(key), F.col("_found")
    )


def coordinate_integrity(
    coordinates: DataFrame,
    sequences: DataFrame,
    identity: str,
    position: str,
    residue: str,
    sequence: str,
    unit: list[str],
    state: str | None = None,
    states: int | None = None,
) -> DataFrame:
    """Each residue equals its sequence at that position; positions are unique per ``unit``.

    Sequences are cut into short pieces and joined on (identity, piece), so the
    work is linear in their length and one long sequence spreads over tasks. The pieces
    are dealt by that key, never sent whole to each executor: their files say little of their size.
    Only residues found wrong ask whether their identity has a sequence at all.
    """
    at = F.greatest(F.col(position).cast("int"), F.lit(1))
    placed = coordinates.select(identity, position, residue, at.alias("_at")).withColumn(
        "_piece", F.floor((F.col("_at") - 1) / PIECE).cast("int")
    )
    cut = F.posexplode(F.regexp_extract_all(F.col(sequence), F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)))
    pieces = sequences.select(F.col(identity).alias("_owner"), cut.alias("_number", "_letters"))
    offset = F.col("_at") - F.col("_piece") * PIECE
    joined = placed.join(
        pieces.hint("shuffle_hash"),
        (F.col(identity) == F.col("_owner")) & (F.col("_piece") == F.col("_number"))
        & (offset <= F.length("_letters")),
        "left",
    ).withColumn("_letter", F.col("_letters").substr(offset, F.lit(1)))
    wrong = F.col("_letter").isNull() | (F.col(position) < 1) | (F.col("_letter") != F.col(residue))
    owners = sequences.select(F.col(identity).alias("_known"))
    known = F.col("_known").isNotNull() | F.col(identity).isNull()
    judged = (
        joined.filter(wrong).join(owners.hint("shuffle_hash"), F.col(identity) == F.col("_known"), "left")
        .select(identity, position, residue, F.coalesce("_letter", F.when(known, F.lit(""))).alias("_letter"))
        .distinct()
    )
    name = F.concat_ws(":", F.col(identity).cast("string"), F.col(position).cast("string"))
    cells = coordinates.select(*dict.fromkeys([*unit, position]))
    frames = [
        check(judged, "residue identity", wrong, name, F.coalesce("_letter", F.lit("unknown sequence"))),
        unique_key(spread(cells, cells.columns), [*unit, position], "coordinate uniqueness"),
    ]
    if state is not None:
        frames.append(
            check(
                coordinates, "state range",
                (F.col(state) < 1) | (F.col(state) > states), name, F.col(state).cast("string"),
            )
        )
    return all_violations(frames)


def reconcile_counts(
    expected: DataFrame, details: dict[str, DataFrame], identity: str
) -> DataFrame:
    """Stored counts per record against the rows they count, in one grouped pass.

    ``expected`` has one row per record, ``identity`` and a column per name of ``details``;
    each detail table has ``identity`` and the value of which distinct ones are counted.
    Every table is first cut to one row per distinct pair, so no key of a
    shuffle is one record alone, and records meet as partial sums. The rows are dealt by pair
    before anything is gathered, to tasks of bounded size. Returns all records with
    ``<name>`` (counted), ``<name>_stored`` and ``state``: agrees, differs, unknown record, repeated record.
    """
    zero = F.lit(0).cast("bigint")
    parts = [
        spread(expected, [identity]).select(
            identity, F.lit(1).cast("bigint").alias("_records"), *[zero.alias(n) for n in details],
            *[F.coalesce(F.col(n).cast("bigint"), zero).alias(f"{n}_stored") for n in details],
        )
    ]
    for name, rows in details.items():
        value = next(c for c in rows.columns if c != identity)
        parts.append(
            spread(rows.select(identity, value).filter(F.col(value).isNotNull()), [identity, value]).distinct().select(
                identity, zero.alias("_records"), *[F.lit(int(n == name)).cast("bigint").alias(n) for n in details],
                *[zero.alias(f"{n}_stored") for n in details],
            )
        )
    columns = ["_records", *details, *[f"{n}_stored" for n in details]]
    together = reduce(DataFrame.unionByName, parts).groupBy(identity).agg(*[F.sum(n).alias(n) for n in columns])
    same = reduce(lambda a, b: a & b, [F.col(n) == F.col(f"{n}_stored") for n in details])
    state = F.when(F.col("_records") == 0, "unknown record").when(F.col("_records") > 1, "repeated record").when(same, "agrees")
    return together.withColumn("state", state.otherwise("differs")).drop("_records")


def expected_values(observed: DataFrame, expected: dict[str, str]) -> DataFrame:
    """Compare named values (name, value) with a frozen map; absent names differ too."""
    spark = observed.sparkSession
    frozen = spark.createDataFrame(list(expected.items()), "name string, expected string")
    return (
        frozen.join(observed.select("name", F.col("value").alias("observed")), "name", "left")
        .filter(~F.col("observed").eqNullSafe(F.col("expected")))
        .select("name", "observed", "expected")
    )


def named_values(row: DataFrame, columns: list[str]) -> DataFrame:
    """Turn a one-row table into (name, value) pairs."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns]
    )
    return row.select(F.inline(pairs))
