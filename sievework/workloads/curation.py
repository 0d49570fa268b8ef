"""Curation queries: normalising, duplicates, flags, cohorts and outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import quality as q
from ..operators.duplicates import (
    mark_exact_duplicates,
    mark_shared_ids,
    split_preferred_copies,
)
from ..session import materialise
from .tables import table

# DuckDB lacks Unicode classes for white space and expands no sharp s.
SPACES = (
    r"[\s\x{000b}\x{001c}-\x{001f}\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
SQL_SEQUENCE = f"upper(replace(regexp_replace(text, '{SPACES}+', '', 'g'), 'ß', 'ss'))"
SQL_MARKED = f"""
    seq as (select doc_id, lang, source, n_chars, sha256({SQL_SEQUENCE}) as sha, {SQL_SEQUENCE} as s
            from documents),
    marked as (select *, min(doc_id) over (partition by sha) as first_id from seq)"""


def sequence_normalise(spark, folder):
    seq = t.normalise_sequence(F.col("text"))
    return table(spark, folder, "documents").select(
        "doc_id",
        F.length(seq).cast("bigint").alias("sequence_length"),
        t.sha256(seq).alias("sequence_sha256"),
    )


def marked_documents(spark, folder):
    """Documents with the digest of their normalised text and the first copy of each.

    The digests are stored once, so the long texts are read in a single pass.
    """
    docs = table(spark, folder, "documents").select(
        "doc_id", "lang", "source", "n_chars",
        t.sha256(t.normalise_sequence(F.col("text"))).alias("sha"),
    )
    return mark_exact_duplicates(materialise(docs), "sha", "doc_id", F.col("doc_id"), "duplicate_of")


def exact_duplicates(spark, folder):
    return marked_documents(spark, folder).select("doc_id", "sha", "duplicate_of")


def preferred_copies(spark, folder):
    docs = table(spark, folder, "documents").select(
        "doc_id",
        (F.col("lang") == "en").alias("is_background"),
        t.sha256(t.normalise_sequence(F.col("text"))).alias("sha"),
    )
    _, rejected = split_preferred_copies(materialise(docs), "sha", ["is_background"], "doc_id")
    return rejected.select("doc_id", "related_accession", F.lit("exact_duplicate").alias("reason"))


def duplicate_ids(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"
    )
    return mark_shared_ids(
        rows, ["l_orderkey", "l_linenumber"], F.struct("l_partkey", "l_suppkey")
    )


def length_outliers(spark, folder):
    marked = marked_documents(spark, folder)
    return q.mark_length_outliers(marked, "n_chars", F.col("duplicate_of").isNull(), 2.0).select(
        "doc_id", "n_chars", "is_length_outlier"
    )


def length_statistics(spark, folder):
    stats = q.length_statistics(
        marked_documents(spark, folder), "n_chars", F.col("duplicate_of").isNull()
    )
    return stats.select(
        "minimum", "maximum",
        F.round("mean", 6).alias("mean"), F.round("population_std", 6).alias("population_std"),
    )


def judged_documents(spark, folder):
    """Documents with labels, ordered cohort, reasons and eligibility."""
    labels = table(spark, folder, "labels")
    docs = marked_documents(spark, folder).join(labels, "doc_id", "left")
    copy = F.col("duplicate_of").isNotNull()
    toxic = F.coalesce(F.col("toxic") == 1, F.lit(False))
    low = F.coalesce(F.col("quality") == 0, F.lit(False))
    short = F.col("n_chars") < 100
    return docs.select(
        "doc_id", "lang", "source", "n_chars",
        q.cohort(copy | toxic, low, short).alias("cohort"),
        t.join_reasons(
            [
                (toxic, "toxic"),
                (low, "low_quality"),
                (copy, F.concat(F.lit("exact_duplicate_of:"), F.col("duplicate_of").cast("string"))),
                (F.col("quality").isNull(), "label_missing"),
            ],
            ";",
        ).alias("reasons"),
        (~(copy | toxic)).alias("eligible"),
    )


SQL_JUDGED = SQL_MARKED + """,
    flagged as (select m.doc_id, m.lang, m.source, m.n_chars, first_id, m.doc_id > first_id as copied,
                  coalesce(toxic = 1, false) as toxic, coalesce(quality = 0, false) as low,
                  n_chars < 100 as short, quality is null as unlabelled
           from marked m left join labels l on m.doc_id = l.doc_id),
    judged as (select doc_id, lang, source, n_chars,
        case when copied or toxic then 'excluded_sequence_qc'
             when low and short then 'sensitivity_partial_and_type_conflict'
             when low then 'sensitivity_partial'
             when short then 'sensitivity_type_conflict' else 'primary' end as cohort,
        concat_ws(';', case when toxic then 'toxic' end, case when low then 'low_quality' end,
            case when copied then 'exact_duplicate_of:' || first_id end,
            case when unlabelled then 'label_missing' end) as reasons,
        not (copied or toxic) as eligible
      from flagged)"""


def quality_cohorts(spark, folder):
    return judged_documents(spark, folder).select("doc_id", "cohort", "reasons", "eligible")


def cohort_counts(spark, folder):
    return q.domain_counts(
        judged_documents(spark, folder), "cohort", q.COHORT_LABELS
    ).select("cohort", "label", "n")


def quality_summary(spark, folder):
    docs = judged_documents(spark, folder)
    eligible = F.when(F.col("eligible"), F.col("n_chars"))
    return docs.agg(
        F.count(F.lit(1)).alias("candidates"),
        F.count_distinct("source").alias("sources"),
        F.count_if("eligible").alias("eligible"),
        *[F.count_if(F.col("cohort") == name).alias(name) for name in q.COHORT_LABELS],
        F.count_if(F.col("reasons") != "").alias("with_reason"),
        F.sum(eligible).alias("eligible_chars"),
        F.min(eligible).alias("minimum"),
        F.max(eligible).alias("maximum"),
        F.round(F.avg(eligible), 6).alias("mean"),
        F.round(F.stddev_pop(eligible), 6).alias("population_std"),
    )


def screen_reasons(spark, folder):
    """Ordered screening reasons: length band, word, annotation and background group."""
    text = F.col("text")
    docs = table(spark, folder, "documents").join(
        table(spark, folder, "labels"), "doc_id", "left"
    )
    return docs.select(
        "doc_id",
        t.join_reasons(
            [
                (F.length(text) == 0, "empty_sequence"),
                (~F.length(text).between(40, 800), "pilot_length_outside_40_800"),
                (t.has_word(text, "the"), "partial_in_representative_or_member"),
                (F.col("quality").isNull() | (F.col("source") == "src3"), "insufficient_annotation"),
                (t.is_low_complexity(text, 0.18), "low_complexity_single_residue_over_60_percent"),
                ((F.col("lang") != "en") & F.coalesce(F.col("toxic") == 1, F.lit(False)),
                 "background_not_unambiguous_nonA"),
            ],
            "|",
        ).alias("reasons"),
    )


def low_complexity(spark, folder):
    share = t.top_character_share(F.col("text"))
    return table(spark, folder, "documents").select(
        "doc_id", F.round(share, 9).alias("top_share"), (share > 0.18).alias("is_low_complexity")
    )


def nonstandard_residues(spark, folder):
    """Characters of each normalised document outside the residue alphabet."""
    seq = t.normalise_sequence(F.col("text"))
    return table(spark, folder, "documents").select(
        "doc_id", t.outside_alphabet(seq).alias("nonstandard"),
    )


def type_set_normalise(spark, folder):
    raw = F.concat(
        F.col("p_type"), F.lit("; "), F.col("p_name"), F.lit(" |,"), F.col("p_brand"), F.lit(","), F.col("p_type")
    )
    types = t.split_types(raw)
    return table(spark, folder, "part").select(
        "p_partkey",
        F.array_join(types, "|").alias("types"),
        F.size(types).cast("bigint").alias("n_types"),
        F.exists(types, lambda x: F.lower(x) == "economy").alias("has_economy"),
    )


def regex_miner(spark, folder):
    """Tags made of a family name and one digit; a second digit spoils the tag."""
    tags = t.mine_type_tags(F.concat_ws(" ", "p_brand", "p_name", "p_brand"), "brand#", "[0-9]")
    return table(spark, folder, "part").select(
        "p_partkey", F.array_join(tags, "|").alias("tags"),
        t.has_word(F.col("p_name"), "RING").alias("has_word"),
    )


def word_flag(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", t.has_word(F.col("text"), "the").alias("has_word")
    )


def first_where(spark, folder):
    docs = judged_documents(spark, folder)
    checks = {
        "primary": F.col("cohort") == "primary",
        "excluded": ~F.col("eligible"),
        "long": F.col("n_chars") > 5000,
        "no_such_row": F.col("n_chars") < 0,
    }
    return q.first_where(docs, "doc_id", checks, ["doc_id", "cohort"])


QUERIES = {
    f.__name__: f
    for f in (
        sequence_normalise, exact_duplicates, preferred_copies, duplicate_ids, length_outliers,
        length_statistics, quality_cohorts, cohort_counts, quality_summary, screen_reasons,
        low_complexity, nonstandard_residues, type_set_normalise, regex_miner, word_flag, first_where,
    )
}

_TOP_SHARE = """
    letters as (select doc_id, unnest(string_split(text, '')) as c from documents),
    per as (select doc_id, c, count(*) as n from letters where c <> '' group by all),
    share as (select d.doc_id, max(p.n)::double / any_value(length(d.text))::double as top_share
              from documents d left join per p on d.doc_id = p.doc_id group by 1)"""
_WORD = r"regexp_matches(text, '(?i)(^|[^\p{L}\p{M}\p{N}_])the([^\p{L}\p{M}\p{N}_]|$)')"

ORACLES = {
    "sequence_normalise": f"""select doc_id, length({SQL_SEQUENCE})::bigint as sequence_length,
        sha256({SQL_SEQUENCE}) as sequence_sha256 from documents""",
    "exact_duplicates": f"""with {SQL_MARKED}
        select doc_id, sha, case when doc_id > first_id then first_id end as duplicate_of from marked""",
    "preferred_copies": f"""with {SQL_MARKED},
        ranked as (select doc_id, first_value(doc_id) over w as kept from seq
                   window w as (partition by sha order by lang = 'en', doc_id
                                rows between unbounded preceding and unbounded following))
        select doc_id, kept as related_accession, 'exact_duplicate' as reason from ranked where doc_id <> kept""",
    "duplicate_ids": """select l_orderkey, l_linenumber, l_partkey, l_suppkey,
        count(*) over (partition by l_orderkey, l_linenumber) > 1 as is_duplicate_id from lineitem""",
    "length_outliers": f"""with {SQL_MARKED},
        stats as (select avg(n_chars) as m, stddev_pop(n_chars) as sd from marked where doc_id = first_id)
        select doc_id, n_chars, n_chars < m - 2 * sd or n_chars > m + 2 * sd as is_length_outlier
        from marked, stats""",
    "length_statistics": f"""with {SQL_MARKED}
        select min(n_chars) as minimum, max(n_chars) as maximum, round(avg(n_chars), 6) as mean,
          round(stddev_pop(n_chars), 6) as population_std from marked where doc_id = first_id""",
    "quality_cohorts": f"with {SQL_JUDGED} select doc_id, cohort, reasons, eligible from judged",
    "cohort_counts": f"""with {SQL_JUDGED},
        domain(cohort, label) as (values ('primary', 'primary'), ('sensitivity_partial', 'partial'),
          ('sensitivity_type_conflict', 'type conflict'),
          ('sensitivity_partial_and_type_conflict', 'partial+type'), ('excluded_sequence_qc', 'excluded'))
        select d.cohort, d.label, count(j.doc_id) as n
        from domain d left join judged j on d.cohort = j.cohort group by all""",
    "quality_summary": f"""with {SQL_JUDGED}
        select count(*) as candidates, count(distinct source) as sources,
          count(*) filter (eligible) as eligible,
          count(*) filter (cohort = 'primary') as "primary",
          count(*) filter (cohort = 'sensitivity_partial') as sensitivity_partial,
          count(*) filter (cohort = 'sensitivity_type_conflict') as sensitivity_type_conflict,
          count(*) filter (cohort = 'sensitivity_partial_and_type_conflict')
            as sensitivity_partial_and_type_conflict,
          count(*) filter (cohort = 'excluded_sequence_qc') as excluded_sequence_qc,
          count(*) filter (reasons <> '') as with_reason,
          (sum(n_chars) filter (eligible))::bigint as eligible_chars,
          min(n_chars) filter (eligible) as minimum, max(n_chars) filter (eligible) as maximum,
          round(avg(n_chars) filter (eligible), 6) as mean,
          round(stddev_pop(n_chars) filter (eligible), 6) as population_std
        from judged""",
    "screen_reasons": f"""with {_TOP_SHARE}
        select d.doc_id, concat_ws('|',
          case when length(text) = 0 then 'empty_sequence' end,
          case when length(text) not between 40 and 800 then 'pilot_length_outside_40_800' end,
          case when {_WORD} then 'partial_in_representative_or_member' end,
          case when quality is null or source = 'src3' then 'insufficient_annotation' end,
          case when top_share > 0.18::double then 'low_complexity_single_residue_over_60_percent' end,
          case when lang <> 'en' and toxic = 1 then 'background_not_unambiguous_nonA' end) as reasons
        from documents d left join labels l on d.doc_id = l.doc_id left join share s on d.doc_id = s.doc_id""",
    "low_complexity": f"""with {_TOP_SHARE}
        select doc_id, round(top_share, 9) as top_share, top_share > 0.18::double as is_low_complexity from share""",
    "nonstandard_residues": f"""with seq as (select doc_id, {SQL_SEQUENCE} as s from documents)
        select doc_id, array_to_string(list_sort(list_distinct(list_filter(string_split(
          regexp_replace(s, '[ACDEFGHIKLMNPQRSTVWY]', '', 'g'), ''), lambda c: c <> ''))), '') as nonstandard
        from seq""",
    "type_set_normalise": r"""with raw as (select p_partkey, unnest(string_split_regex(
            p_type || '; ' || p_name || ' |,' || p_brand || ',' || p_type, '[,;|]')) as item from part),
        items as (select distinct p_partkey, trim(item) as item from raw where trim(item) <> '')
        select p_partkey, string_agg(item, '|' order by item) as types, count(*) as n_types,
          bool_or(lower(item) = 'economy') as has_economy from items group by 1""",
    "regex_miner": r"""select p_partkey,
          array_to_string(list_sort(list_distinct(list_transform(
            regexp_extract_all(p_brand || ' ' || p_name || ' ' || p_brand || ' ', '(?i)brand#([0-9])[^0-9]', 1),
            lambda t: 'Brand#' || t))), '|') as tags,
          regexp_matches(p_name, '(?i)\bring\b') as has_word
        from part""",
    "word_flag": f"select doc_id, {_WORD} as has_word from documents",
    "first_where": f"""with {SQL_JUDGED},
        checks as (
          select 'primary' as "check", min(doc_id) filter (cohort = 'primary') as doc_id from judged union all
          select 'excluded', min(doc_id) filter (not eligible) from judged union all
          select 'long', min(doc_id) filter (n_chars > 5000) from judged union all
          select 'no_such_row', min(doc_id) filter (n_chars < 0) from judged)
        select c."check", c.doc_id, j.cohort from checks c left join judged j on c.doc_id = j.doc_id""",
}
