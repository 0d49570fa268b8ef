"""Selection queries and the whole audit over documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import selection as sel
from ..operators.duplicates import split_preferred_copies
from ..operators.ranking import seeded_rank, tie_key
from ..plans import audit
from ..session import materialise
from .curation import SQL_SEQUENCE
from .tables import table

PROFILE = audit.AuditProfile(
    id_prefix="DOC_", family="xyz", target_type="XyzA", watched_type="XyzJ", partial_word="the",
    alphabet="ABCDEFGHIJKLMNOPQRSTUVWXYZ.,", sigmas=2.0,
)


def _label_pool(spark, folder):
    """Parts as a pool of short labels, ranked by seed, exact copies removed."""
    label = F.concat_ws(" ", "p_name", "p_brand", F.col("p_size").cast("string"), "p_type")
    parts = table(spark, folder, "part").select(
        F.col("p_partkey").cast("string").alias("original_accession"),
        "p_type", "p_brand", label.alias("sequence"), t.sha256(label).alias("sha"),
        (F.col("p_size") % 10).alias("source_file"),
    )
    ranked = seeded_rank(parts, ["original_accession"], 42)
    return split_preferred_copies(materialise(ranked), "sha", ["rank"], "original_accession")


def diversity_select(spark, folder):
    """Selected and rejected labels with their reasons."""
    pool, copies = _label_pool(spark, folder)
    quotas = {"ECONOMY": 12, "SMALL": 6, "PROMO": 6}
    columns = sel.PoolColumns(group="p_type", organism="p_brand", types="p_type")
    chosen, rejected = sel.diversity_select(pool, quotas, columns)
    none = F.lit(None).cast("string")
    return (
        chosen.select("identity", F.lit("selected").alias("reason"), none.alias("related_accession"))
        .unionByName(rejected.select("identity", "reason", "related_accession"))
        .unionByName(
            copies.select(
                F.col("original_accession").alias("identity"),
                F.lit(sel.DUPLICATE).alias("reason"), "related_accession",
            )
        )
    )


def _first_per_group(df, group, identity, per_group):
    order = Window.partitionBy(group).orderBy("_tie")
    keyed = df.withColumn("_tie", tie_key(42, F.col(identity)))
    return keyed.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= per_group).drop("_n")


def near_duplicate_of_selected(spark, folder):
    """For every label the first chosen label it nearly repeats, if any."""
    pool, _ = _label_pool(spark, folder)
    labels = materialise(pool.select("original_accession", "p_type", "sequence"))
    chosen = _first_per_group(labels, "p_type", "original_accession", 5)
    near = sel.first_near_selected(labels, chosen, "original_accession", "sequence", "_tie")
    return labels.select("original_accession").join(near, "original_accession", "left")


def near_duplicate_bounds(spark, folder):
    """Documents whose length and characters come close to a chosen document's."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", "text")
    ids = docs.select("doc_id", "lang")
    chosen = _first_per_group(ids, "lang", "doc_id", 2).select("doc_id", "_tie").join(docs, "doc_id")
    pairs = sel.bounded_pairs(docs, chosen, "doc_id", "text", "_tie")
    return pairs.select("doc_id", "related_accession", F.round("overlap", 9).alias("overlap"))


def _document_records(spark, folder):
    """Documents in the shape of nested source records."""
    docs = table(spark, folder, "documents")
    n = F.col("doc_id")
    lines = F.split("text", "\n")
    text = lambda key, value: F.struct(F.lit(key).alias("key"), value.cast("string").alias("value"))
    member = lambda line: F.map_from_entries(
        F.array(
            text("description", line), text("source_file", F.col("source")),
            text("xyz_types", F.when(F.length(line) % 37 == 0, F.lit(" XyzJ; XyzA")).otherwise(F.lit('["XyzA"]'))),
        )
    )
    members = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    size = F.size(lines)
    return docs.select(
        (n + 1).alias("ordinal"),
        F.array(*[F.lit(f) for f in audit.REQUIRED]).alias("present"),
        F.when(n % 200 == 3, F.lit(" ")).when((n % 100).isin(11, 12), F.concat(F.lit("SHARED"), F.floor(n / 100)))
        .otherwise(F.concat(F.lit("S"), n)).alias("unique_sequence_id"),
        F.col("text").alias("sequence"),
        F.map_from_entries(
            F.array(
                text("id", F.concat("source", F.lit("|"), n)),
                text("organism", F.when(n % 50 != 0, F.col("lang"))),
                text("description", lines[0]),
                text("source_file", F.when(n % 40 == 1, F.lit("")).otherwise(F.col("source"))),
                text("xyz_types", F.when(n % 9 == 0, F.lit("XyzA| XyzK,")).when(n % 9 == 1, F.lit("[]")).otherwise(F.lit("xyza"))),
            )
        ).alias("representative_annotation"),
        F.map_from_entries(
            F.array(text("total_original_sequences", size), text("redundant_count", size - 1))
        ).alias("cluster_statistics"),
        F.transform(members, member).alias("redundant_members_details"),
    )


def _audited(spark, folder):
    return audit.audit_records(materialise(_document_records(spark, folder)), PROFILE)


def document_audit(spark, folder):
    """The metadata table of the whole audit, as text cells."""
    audited = materialise(_audited(spark, folder))
    rows = audit.metadata_table(audit.with_outliers(audited, PROFILE), PROFILE)
    return rows.drop("sequence", "description")


def document_audit_members(spark, folder):
    return audit.member_table(_document_records(spark, folder), PROFILE).select(
        "representative_internal_id", "representative_sequence_id", "source_file", "xyz_types",
        "is_partial", t.sha256(F.col("description")).alias("description_sha256"),
    )


def document_audit_summary(spark, folder):
    audited = audit.with_outliers(materialise(_audited(spark, folder)), PROFILE)
    rounded = {
        "length_mean", "length_population_std", "outlier_lower_exclusive", "outlier_upper_exclusive"
    }
    summary = audit.audit_summary(audited, PROFILE)
    return summary.select(
        *[
            F.round(name, 6).alias(name) if name in rounded else F.col(name).cast("bigint").alias(name)
            for name in summary.columns
        ]
    )


QUERIES = {
    f.__name__: f
    for f in (
        near_duplicate_bounds, near_duplicate_of_selected, diversity_select, document_audit,
        document_audit_members, document_audit_summary,
    )
}

_AUDIT = rf"""
    d as (select *, string_split(text, chr(10)) as lines, {SQL_SEQUENCE} as seq from documents),
    e as (select *, doc_id + 1 as ordinal,
        case when doc_id % 200 = 3 then '' when doc_id % 100 in (11, 12) then 'SHARED' || (doc_id // 100)
             else 'S' || doc_id end as sid,
        sha256(seq) as sha,
        lines[2:] as rest,
        case doc_id % 9 when 0 then ['XyzA', 'XyzK'] when 1 then []::varchar[] else ['xyza'] end as own from d),
    f as (select *, array_to_string(list_sort(list_distinct(list_filter(string_split(
            regexp_replace(seq, '[ABCDEFGHIJKLMNOPQRSTUVWXYZ.,]', '', 'g'), ''), lambda c: c <> ''))), '') as odd,
        list_sort(list_distinct(own || case when len(rest) > 0 then ['XyzA'] else []::varchar[] end
          || case when len(list_filter(rest, lambda l: length(l) % 37 = 0)) > 0 then ['XyzJ'] else []::varchar[] end)) as types,
        regexp_matches(lines[1] || ' ', '(?i)(^|[^\p{{L}}\p{{M}}\p{{N}}_])the([^\p{{L}}\p{{M}}\p{{N}}_]|$)') as part_rep,
        len(list_filter(rest, lambda l: regexp_matches(l, '(?i)(^|[^\p{{L}}\p{{M}}\p{{N}}_])the([^\p{{L}}\p{{M}}\p{{N}}_]|$)'))) > 0 as part_mem,
        first_value(case when sid <> '' then sid else 'record_' || ordinal end)
          over (partition by sha order by ordinal) as first_sid,
        min(ordinal) over (partition by sha) as first_ordinal,
        sid <> '' and count(*) over (partition by sid) > 1 as shared,
        doc_id % 40 = 1 as source_missing, doc_id % 50 = 0 as organism_missing from e),
    g as (select *, ordinal > first_ordinal as copied, part_rep or part_mem as part_any,
        len(list_filter(types, lambda x: lower(x) <> 'xyza')) > 0 as conflict,
        list_contains(types, 'XyzJ') as watched from f),
    h as (select *, odd <> '' or sid = '' or seq = '' or copied or shared as excluded from g),
    j as (select *, case when excluded then 'excluded_sequence_qc'
          when part_any and conflict then 'sensitivity_partial_and_type_conflict'
          when part_any then 'sensitivity_partial' when conflict then 'sensitivity_type_conflict'
          else 'primary' end as cohort from h),
    st as (select avg(length(seq)) as m, stddev_pop(length(seq)) as sd from j where not excluded),
    k as (select j.*, coalesce(length(seq) < m - 2 * sd or length(seq) > m + 2 * sd, false) as outlier from j, st)"""

# Labels with their seeded rank; `kept` holds the first copy of each text.
_LABELS = """
    ranked as (select cast(p_partkey as varchar) as id, p_type, p_brand, p_size % 10 as src,
        concat_ws(' ', p_name, p_brand, p_size, p_type) as s,
        row_number() over (order by sha256('42:' || p_partkey)) - 1 as rank from part),
    firsts as (select *, first_value(id) over (partition by s order by rank) as first_id from ranked),
    kept as (select * from firsts where id = first_id)"""

# Pairs `pairs (p, a_id, a, b_id, b)` that are near repeats, as `near`. Characters that agree form
# diagonal runs; the longest run inside a part (first in a, then in b) is matched and leaves two smaller parts.
_NEAR = """
    close as (select * from pairs where least(len(a), len(b))::double / greatest(len(a), len(b)) >= 0.8
        and list_sum(list_transform(list_distinct(string_split(a, '')), lambda c:
            least(len(a) - len(replace(a, c, '')), len(b) - len(replace(b, c, ''))))) / least(len(a), len(b))::double >= 0.9),
    left_cells as (select p, unnest(range(1, len(a) + 1)) as i, unnest(string_split(a, '')) as c from close),
    right_cells as (select p, unnest(range(1, len(b) + 1)) as j, unnest(string_split(b, '')) as c from close),
    cells as (select p, i, j, i - row_number() over (partition by p, i - j order by i) as g
        from left_cells join right_cells using (p, c)),
    runs as (select p, min(i) as i, min(j) as j, count(*) as n from cells group by p, i - j, g),
    parts(p, alo, ahi, blo, bhi, got) as (
        select p, 1::bigint, len(a) + 1, 1::bigint, len(b) + 1, 0::bigint from close
        union all
        select p, k.alo, k.ahi, k.blo, k.bhi, k.got from (
            select p, unnest([{'alo': alo, 'ahi': -m.i, 'blo': blo, 'bhi': -m.j, 'got': 0::bigint},
                {'alo': m.n - m.i, 'ahi': ahi, 'blo': m.n - m.j, 'bhi': bhi, 'got': 0::bigint},
                {'alo': 0::bigint, 'ahi': 0::bigint, 'blo': 0::bigint, 'bhi': 0::bigint, 'got': m.n}]) as k
            from (select s.p, alo, ahi, blo, bhi, max({
                    'n': least(r.n, ahi - r.i, bhi - r.j) - greatest(0, alo - r.i, blo - r.j),
                    'i': -(r.i + greatest(0, alo - r.i, blo - r.j)), 'j': -(r.j + greatest(0, alo - r.i, blo - r.j))}) as m
                from parts s join runs r on r.p = s.p
                where s.got = 0 and least(r.n, ahi - r.i, bhi - r.j) > greatest(0, alo - r.i, blo - r.j)
                group by s.p, alo, ahi, blo, bhi))),
    near as (select a_id, b_id from close join (select p, sum(got) as got from parts group by p) using (p)
        where got / least(len(a), len(b))::double >= 0.9)"""

ORACLES = {
    "near_duplicate_of_selected": f"""with recursive {_LABELS},
        chosen as (select id, s, sha256('42:' || id) as tie from kept
          qualify row_number() over (partition by p_type order by sha256('42:' || id)) <= 5),
        pairs as (select row_number() over () as p, k.id as a_id, k.s as a, c.id as b_id, c.s as b
          from kept k join chosen c on k.id <> c.id),
        {_NEAR},
        found as (select a_id, arg_min(b_id, tie) as b_id from near join chosen on id = b_id group by a_id)
        select id as original_accession, b_id as related_accession from kept left join found on a_id = id""",
    "diversity_select": f"""with recursive {_LABELS},
        quotas(g, name, quota) as (values (1, 'ECONOMY', 12), (2, 'SMALL', 6), (3, 'PROMO', 6)),
        pool as (select id, s, g, rank, p_brand as o, len(s) // 25 as bin, src from kept join quotas on name = p_type),
        pairs as (select row_number() over () as p, x.id as a_id, x.s as a, y.id as b_id, y.s as b
          from pool x join pool y on x.id <> y.id),
        {_NEAR},
        repeats as (select a_id, list(b_id) as ids from near group by a_id),
        walk(step, g, taken, sel, popped, id, reason, related) as (
          select 0, 1, 0, []::struct(id varchar, g integer, o varchar, bin bigint, src bigint)[], []::varchar[],
            null::varchar, null::varchar, null::varchar
          union all
          select step + 1, case when best is null then g + 1 else g end,
            case when best is null then 0 when other is null then taken + 1 else taken end,
            case when best is not null and other is null
              then list_append(sel, {{'id': best.id, 'g': g, 'o': best.o, 'bin': best.bin, 'src': best.src}}) else sel end,
            case when best is null then popped else list_append(popped, best.id) end, best.id,
            case when best is null then null when other is null then 'selected' else '{sel.NEAR}' end, other
          from (select b.*, list_filter(list_transform(sel, lambda x: x.id), lambda x: list_contains(r.ids, x))[1] as other
            from (select w.step, w.g, w.taken, w.sel, w.popped, min(case when c.id is not null then {{
                'k1': len(list_filter(w.sel, lambda x: x.g = w.g and x.o = c.o)), 'k2': w.taken,
                'k3': len(list_filter(w.sel, lambda x: x.g = w.g and x.bin = c.bin)),
                'k4': len(list_filter(w.sel, lambda x: x.g = w.g and x.src = c.src)),
                'k5': c.rank, 'id': c.id, 'o': c.o, 'bin': c.bin, 'src': c.src}} end) as best
              from walk w join quotas q on q.g = w.g
              left join pool c on c.g = w.g and w.taken < q.quota and not list_contains(w.popped, c.id)
              group by w.step, w.g, w.taken, w.sel, w.popped) b
            left join repeats r on r.a_id = b.best.id))
        select f.id as identity,
          case when f.id <> first_id then '{sel.DUPLICATE}' else coalesce(w.reason, '{sel.UNUSED}') end as reason,
          case when f.id <> first_id then first_id else w.related end as related_accession
        from firsts f left join walk w on w.id = f.id""",
    "near_duplicate_bounds": """with ranked as (select doc_id, lang, row_number() over (partition by lang
            order by sha256('42:' || doc_id)) as n from documents),
        chosen as (select d.doc_id, d.text from ranked r join documents d on d.doc_id = r.doc_id where n <= 2),
        pairs as (select a.doc_id, b.doc_id as other, length(a.text) as la, length(b.text) as lb
          from documents a join chosen b on a.doc_id <> b.doc_id
           and least(length(a.text), length(b.text))::double / greatest(length(a.text), length(b.text)) >= 0.8),
        letters as (select doc_id, unnest(string_split(text, '')) as c from documents),
        counts as (select doc_id, c, count(*) as n from letters where c <> '' group by all),
        shared as (select p.doc_id, p.other, any_value(la) as la, any_value(lb) as lb, sum(least(x.n, y.n)) as s
          from pairs p join counts x on x.doc_id = p.doc_id join counts y on y.doc_id = p.other and y.c = x.c
          group by all)
        select doc_id, other as related_accession, round(s::double / least(la, lb)::double, 9) as overlap
        from shared where s::double / least(la, lb)::double >= 0.9""",
    "document_audit": f"""with {_AUDIT}
        select 'DOC_' || lpad(cast(ordinal as varchar), 6, '0') as internal_id, sid as sequence_id,
          source || '|' || doc_id as accession, cast(length(seq) as varchar) as sequence_length,
          sha as sequence_sha256,
          case when organism_missing then 'None' else lang end as organism,
          case when source_missing then '' else source end as source_file, '' as representative_gene,
          array_to_string(own, '|') as representative_xyz_types,
          cast(len(lines) as varchar) as member_count, cast(len(lines) - 1 as varchar) as redundant_member_count,
          array_to_string(types, '|') as member_xyz_types,
          cast(part_rep as varchar) as is_partial_representative, cast(part_any as varchar) as is_partial_any_member,
          cast(conflict as varchar) as has_type_conflict, cast(watched as varchar) as has_xyzj_member,
          cast(source_missing as varchar) as source_missing, cast(organism_missing as varchar) as organism_missing,
          odd as nonstandard_residues, cast(copied as varchar) as is_exact_duplicate,
          case when copied then first_sid else '' end as exact_duplicate_of,
          cast(outlier as varchar) as is_length_outlier, cast(not excluded as varchar) as sequence_qc_eligible,
          cast(cohort = 'primary' as varchar) as primary_analysis_eligible, cohort as analysis_cohort,
          concat_ws(';', case when sid = '' then 'missing_sequence_id' end, case when seq = '' then 'empty_sequence' end,
            case when odd <> '' then 'nonstandard_residues:' || odd end,
            case when copied then 'exact_duplicate_of:' || first_sid end,
            case when source_missing then 'source_missing' end,
            case when shared then 'duplicate_sequence_id' end) as exclusion_reason
        from k""",
    "document_audit_members": f"""with {_AUDIT},
        x as (select ordinal, sid, source, unnest(rest) as line from e)
        select 'DOC_' || lpad(cast(ordinal as varchar), 6, '0') as representative_internal_id,
          sid as representative_sequence_id, source as source_file,
          case when length(line) % 37 = 0 then 'XyzA|XyzJ' else 'XyzA' end as xyz_types,
          cast(regexp_matches(line, '(?i)(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_])the([^\\p{{L}}\\p{{M}}\\p{{N}}_]|$)') as varchar) as is_partial,
          sha256(regexp_replace(line, '^\\s+|\\s+$', '', 'g')) as description_sha256 from x""",
    "document_audit_summary": f"""with {_AUDIT}
        select count(*) as candidate_records, sum(len(lines))::bigint as total_original_sequence_records,
          sum(len(rest))::bigint as redundant_member_records, count(distinct sid) as unique_sequence_ids,
          count(distinct ordinal) as unique_internal_ids, count(distinct sha) as unique_sequence_hashes,
          count(*) filter (not excluded) as sequence_qc_eligible,
          count(*) filter (cohort = 'primary') as primary_cohort,
          count(*) filter (cohort = 'primary') as cohort_primary,
          count(*) filter (cohort = 'sensitivity_partial') as cohort_sensitivity_partial,
          count(*) filter (cohort = 'sensitivity_type_conflict') as cohort_sensitivity_type_conflict,
          count(*) filter (cohort = 'sensitivity_partial_and_type_conflict')
            as cohort_sensitivity_partial_and_type_conflict,
          count(*) filter (excluded) as cohort_excluded_sequence_qc,
          count(*) filter (part_rep) as partial_representative, count(*) filter (part_any) as partial_any_member,
          count(*) filter (conflict) as type_conflict, count(*) filter (watched) as watched_member,
          count(*) filter (source_missing) as source_missing, count(*) filter (organism_missing) as organism_missing,
          count(*) filter (odd <> '') as nonstandard_sequence, count(*) filter (copied) as exact_duplicate_sequence,
          count(*) filter (shared) as duplicate_sequence_id_records,
          min(length(seq)) filter (not excluded) as length_minimum,
          max(length(seq)) filter (not excluded) as length_maximum,
          round(avg(length(seq)) filter (not excluded), 6) as length_mean,
          round(stddev_pop(length(seq)) filter (not excluded), 6) as length_population_std,
          count(*) filter (outlier) as length_outlier_count,
          round(any_value(m) - 2 * any_value(sd), 6) as outlier_lower_exclusive,
          round(any_value(m) + 2 * any_value(sd), 6) as outlier_upper_exclusive
        from k, st""",
}
