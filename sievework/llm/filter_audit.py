"""How filters interact: every order of them, step by step, by a recursive query.

Documents are first counted by the set of filters that they fail (a mask), which is all
that orders need. The recursion then extends each prefix of filters by every letter it
lacks, joins the mask counts of the part and appends the numbers of that step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import attach_by_key
from .base import Scratch

#: Letters of the filters; a filter's bit in a mask is its place here.
FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
COPY = 1 << FILTERS.index("E")
METRICS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_failures(text: str) -> Column:
    """The mask of the filters A to D, which look at the text alone; NULL is empty."""
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(body, r"[\x20\x09-\x0D]+"), "")
    many, different = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    capitals, points = F.regexp_count(body, F.lit("[A-Z]")).cast("long"), F.length(body).cast("long")
    fails = [many < 100, 100 * different < 80 * many, 100 * capitals > 10 * points, body.rlike("[#$%&*|]")]
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))


def mask_cells(
    scratch: Scratch, docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang"
) -> DataFrame:
    """``(part, n, good, toxic)`` with arrays of document counts by mask, one row per part.

    Texts are looked at once; what is shuffled afterwards are digests and counts. All rows with
    one text, one part and one label first become one row, so a text that
    fills a third of the table is a handful of rows where its copies meet.
    """
    narrow = docs.select(
        F.col(key).alias("_key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))).alias("_text"), text_failures(text).alias("_mask"),
    )
    each = scratch.keep(narrow.groupBy("_text", "_mask", "part", "_key").agg(F.count("*").alias("_rows")))
    marks = labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("_good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("_toxic"),
    )
    weights = each.filter("_key is not null").groupBy("_key").agg(F.count("*").alias("_weight"))
    marked = attach_by_key(
        each, weights.join(marks, "_key"), ["_key"], "_weight", spread=F.col("_text"), unmatched=F.col("_key").isNull()
    )
    none = F.lit(False)
    alike = marked.groupBy(
        "_text", "_mask", "part", F.coalesce("_good", none).alias("_good"), F.coalesce("_toxic", none).alias("_toxic")
    ).agg(
        F.sum("_rows").alias("_all"), F.sum(F.when(F.col("_key").isNull(), F.col("_rows")).otherwise(0)).alias("_free"),
        F.min("_key").alias("_least"), F.min_by("_rows", "_key").alias("_first"),
    )
    # no copy has a smaller id than the least one of its text; rows without an id have no smaller one
    placed = alike.withColumn("_text_least", F.expr("min(_least) over (partition by _text)"))
    passing = F.col("_free") + F.when(F.col("_least") == F.col("_text_least"), F.col("_first")).otherwise(0)
    split = placed.select("part", "_mask", "_good", "_toxic", passing.alias("_passing"), (F.col("_all") - passing).alias("_copies"))
    chosen = {"n": F.lit(True), "good": F.col("_good"), "toxic": F.col("_toxic")}
    sums = [
        F.sum(F.when(when & (F.col("_mask") == mask & ~COPY), F.col("_copies" if mask & COPY else "_passing")).otherwise(0))
        .alias(f"{name}{mask}")
        for name, when in chosen.items() for mask in range(MASKS)
    ]
    counts = split.groupBy("part").agg(*sums)
    return counts.select("part", *[F.array(*[f"{name}{mask}" for mask in range(MASKS)]).alias(name) for name in chosen])


def _total(counts: str, where: str) -> str:
    """Sum over the masks ``m`` for which ``where`` holds."""
    return f"aggregate(filter(c.masks, m -> {where}), 0L, (s, m) -> s + {counts}[m])"


def audit_orders(scratch: Scratch, cells: DataFrame) -> DataFrame:
    """``(part, filter_order, step, …)``: the metrics of every step of every order, and ``shapley``.

    ``kept`` counts what passes the filters up to this step, ``removed`` what this one takes,
    ``redundant`` what fails it but was taken before, ``unique_fails`` what fails no other,
    ``good_lost`` and ``toxic_lost`` the labelled part of ``removed``. ``shapley`` adds
    what the filter removes over all orders.
    """
    spark = scratch.spark
    cells = scratch.keep(cells.withColumn("masks", F.sequence(F.lit(0), F.lit(MASKS - 1))))
    unused = [
        (applied, letter, 1 << k) for applied in range(MASKS) for k, letter in enumerate(FILTERS) if not applied >> k & 1
    ]
    turns = spark.createDataFrame(unused, "applied int, letter string, bit int")
    here = "m & t.bit <> 0 and m & w.applied = 0"
    found = {
        "kept": _total("c.n", "m & (w.applied | t.bit) = 0"),
        "removed": _total("c.n", here),
        "redundant": _total("c.n", "m & t.bit <> 0 and m & w.applied <> 0"),
        "unique_fails": "c.n[t.bit]",
        "good_lost": _total("c.good", here),
        "toxic_lost": _total("c.toxic", here),
    }
    record = ", ".join(f"'{name}', {found[name]}" for name in METRICS)
    kind = "struct<letter: string, step: int, " + ", ".join(f"{name}: bigint" for name in METRICS) + ">"
    walk = spark.sql(
        f"""
        WITH RECURSIVE walk(part, prefix, applied, steps) AS (
          SELECT part, CAST('' AS STRING), 0, CAST(array() AS array<{kind}>) FROM {{cells}}
          UNION ALL
          SELECT w.part, concat(w.prefix, t.letter), w.applied | t.bit,
            array_append(w.steps, CAST(named_struct('letter', t.letter, 'step', length(w.prefix) + 1, {record}) AS {kind}))
          FROM walk w JOIN {{turns}} t ON t.applied = w.applied JOIN {{cells}} c ON c.part = w.part
        )
        SELECT part, prefix, steps FROM walk WHERE applied = {MASKS - 1} LIMIT ALL
        """,
        cells=cells, turns=turns,
    )
    each = walk.select("part", F.col("prefix").alias("filter_order"), F.explode("steps").alias("x"))
    each = each.select("part", "filter_order", "x.*")
    return each.withColumn("shapley", F.expr("sum(removed) over (partition by part, letter)")).select(
        "part", "filter_order", "step", *METRICS, "shapley"
    )


def filter_interactions(
    scratch: Scratch, docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang"
) -> DataFrame:
    """All orders of the filters A (few words), B (few different ones), C (capitals), D (marks) and E (copies).

    NULL texts are empty, NULL parts the empty string. Every row is a document: rows
    with equal id and text are as good as each other and none of them is a copy of the
    other, since E asks for a smaller id. Rows without an id are never copies and have no
    label; several labels of one id count as one, with what any of them says. An
    empty table gives no rows. Further columns are not read.
    """
    return audit_orders(scratch, mask_cells(scratch, docs, labels, key, text, part))


ORACLE = r"""
WITH RECURSIVE
texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
),
marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
),
failing AS (
  SELECT t.part, coalesce(m.good, 0) AS good, coalesce(m.bad, 0) AS bad,
         CASE WHEN len(words) < 100 THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 10 * length(body) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN t.doc_id > min(t.doc_id) OVER (PARTITION BY body) THEN 16 ELSE 0 END AS mask
  FROM texts t LEFT JOIN marks m ON m.doc_id = t.doc_id
),
cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM failing GROUP BY part, mask),
letters(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
walk(prefix, letter, bit, before, step) AS (
  SELECT letter, letter, bit, 0, 1 FROM letters
  UNION ALL
  SELECT w.prefix || l.letter, l.letter, l.bit, w.before | w.bit, w.step + 1
  FROM walk w JOIN letters l ON ((w.before | w.bit) & l.bit) = 0
),
levels AS (
  SELECT c.part, w.prefix, w.letter, w.step,
         sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN bad ELSE 0 END) AS toxic_lost
  FROM walk w CROSS JOIN cells c
  GROUP BY c.part, w.prefix, w.letter, w.step
)
SELECT l.part, o.prefix AS filter_order, l.step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY l.part, l.letter) AS BIGINT) AS shapley
FROM levels l JOIN (SELECT prefix FROM walk WHERE step = 5) o ON substr(o.prefix, 1, l.step) = l.prefix
"""
