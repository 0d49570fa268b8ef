"""Annotation queries: hit rules, labels, alignments, coordinates and intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import alignment as al
from ..functions import rules
from ..functions import text as t
from ..operators import constraints as c
from ..operators import labels as lab
from ..operators.intervals import label_by_interval
from ..plans import scan
from .splits import manifest
from .tables import table

RULES = rules.HitRules(
    max_sequence_evalue=0.08, max_domain_evalue=0.07, min_hit_length=10, min_hmm_coverage=0.5
)


def hit_rules(spark, folder):
    """Line items as hits: discount and tax are e-values, line number and quantity a span."""
    evalue = F.when(F.col("l_returnflag") != "N", F.col("l_discount"))
    end = F.least(F.col("l_linenumber") + F.col("l_quantity").cast("int"), F.lit(50))
    coverage = F.when(
        F.col("l_linestatus") == "O", rules.coverage(F.col("l_linenumber"), end, F.lit(50))
    )
    length = rules.interval_length(F.col("l_linenumber"), end)
    reasons = rules.review_reasons(evalue, F.col("l_tax"), coverage, length, RULES)
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber",
        F.round(coverage, 9).alias("hmm_coverage"), reasons.alias("review_reason"),
        rules.hit_status(reasons).alias("hit_status"),
    )


def signature_range_filter(spark, folder):
    """Keep one signature, every location, and only spans that lie inside the sequence."""
    start, end = F.col("l_linenumber"), F.col("l_linenumber") + F.col("l_quantity").cast("int")
    return (
        table(spark, folder, "lineitem")
        .filter(F.col("l_returnflag") == "A")
        .filter(rules.inside(start, end, F.lit(45)))
        .select("l_orderkey", "l_partkey", start.alias("start"), end.alias("end"))
    )


def hit_classifier(spark, folder):
    """Orders as records; their line items give a strict and a permissive hit."""
    lines = table(spark, folder, "lineitem")
    strict = F.col("l_quantity") >= 30
    hits = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count_if(strict).alias("strict"),
        F.count_if(strict & (F.col("l_returnflag") != "N")).alias("included"),
        F.max("l_quantity").alias("permissive_score"),
        F.max(F.when(F.col("l_returnflag") != "N", F.col("l_quantity"))).alias("best_domain"),
    )
    state = rules.classify_hit(
        F.coalesce(F.col("strict") > 0, F.lit(False)), F.col("included"),
        F.col("permissive_score"), F.col("best_domain"), 30.0, 28.0, 5.0,
    )
    return table(spark, folder, "orders").select("o_orderkey").join(hits, "o_orderkey", "left").select(
        "o_orderkey", state.alias("status")
    )


def _labelled_events(spark, folder):
    """Events as submitted records: the type says how far the scan of each came."""
    kind = F.col("event_type")
    key = F.get_json_object("props", "$.k").cast("int")
    hits = F.when(kind == "purchase", key % 3).when(kind == "click", key % 2).otherwise(0)
    review = F.when(kind == "click", hits).otherwise(0)
    submitted = kind != "signup"
    state = rules.scan_state(
        F.when(~submitted, "not_submitted").when((kind == "error") & (key < 50), "failed"),
        ~((kind == "view") & (key < 20)),
        (kind == "error"),
        review, hits, key < 90,
    )
    return table(spark, folder, "events").select(
        "event_id", F.col("event_type").alias("sample_group"), submitted.alias("submitted"),
        state.alias("scan_status"), rules.tri_state_label(state, hits).alias("label"),
        (submitted & (state != "result_missing")).alias("result_present"),
        rules.parse_status(state).alias("parse_status"),
    )


def label_precedence(spark, folder):
    rows = _labelled_events(spark, folder)
    return rows.select(
        "event_id", "scan_status", rules.label_text(F.col("label")).alias("label"), "parse_status",
        (F.col("scan_status") != "success").alias("needs_review"),
    )


def group_summary(spark, folder):
    groups = ["click", "error", "purchase", "signup", "view", "absent_group"]
    return lab.group_summary(_labelled_events(spark, folder), "sample_group", groups)


def label_checks(spark, folder):
    """Labels against statuses; labels of a few known keys were spoiled on purpose."""
    rows = _labelled_events(spark, folder).withColumn("internal_id", F.col("event_id").cast("string"))
    spoiled = F.when(F.col("event_id") % 97 == 0, F.lit(0)).otherwise(F.col("label"))
    labels = rows.select("internal_id", "scan_status", spoiled.alias("label"), spoiled.alias("detected"))
    return lab.label_violations(labels, rows).select("rule", "key")


def label_domain(spark, folder):
    """Counts over a fixed domain with zero rows, and the values outside it."""
    from ..operators import quality as q

    labels = {"click": "Click", "view": "View", "error": "Error", "refund": "Refund"}
    events = table(spark, folder, "events")
    known = q.domain_counts(events, "event_type", labels).select("event_type", "label", "n")
    unknown = q.unknown_values(events, "event_type", labels)
    return known.unionByName(unknown.select("event_type", F.lit("unknown").alias("label"), "n"))


def _alignments(spark, folder):
    """Parts as aligned pairs: spaces and some letters stand for insertions and deletions."""
    return table(spark, folder, "part").select(
        "p_partkey",
        F.translate("p_name", " a", "..").alias("profile"),
        F.upper(F.translate("p_name", "eo ", "-.x")).alias("target"),
        (F.col("p_size") % 7 + 1).alias("profile_from"),
        (F.col("p_size") % 5 + 1).alias("target_from"),
    )


def align_fold(spark, folder):
    cells = al.alignment_columns(
        F.col("profile"), F.col("target"), F.col("profile_from"), F.col("target_from")
    )
    return _alignments(spark, folder).select("p_partkey", F.inline(cells))


def alignment_rules(spark, folder):
    """The first rule that alignments break: names aligned to themselves, spoiled in seven ways."""
    seq = F.regexp_replace(F.upper("p_name"), " ", "")
    kind, both = F.col("p_partkey") % 8, F.col("p_partkey") % 16 == 14
    length = F.length(seq)
    last = F.concat(F.substr(seq, F.lit(1), length - 1), F.lit("X"))
    target = (
        F.when(kind == 1, F.concat(seq, F.lit("A"))).when(kind == 3, F.concat(F.lit("1"), F.substr(seq, F.lit(2))))
        .when(kind == 4, F.repeat(F.lit("-"), length)).when(kind == 5, F.concat(F.lit("X"), F.substr(seq, F.lit(2))))
        .when(both, last).otherwise(seq)
    )
    error = al.alignment_error(
        seq, target, F.when(kind == 2, 0).otherwise(1), F.lit(1), F.when(kind == 7, length + 1).otherwise(length), seq,
        F.when(both, 2).when(kind == 6, length - 1).otherwise(length),
    )
    return table(spark, folder, "part").select("p_partkey", error.alias("reason"))


def deleted_states(spark, folder):
    """Line numbers between the first and last of an order that it does not use.

    The set kept per order is bounded by the number of states, not by its rows.
    """
    used = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.min("l_linenumber").alias("first"), F.max("l_linenumber").alias("last"),
        F.collect_set("l_linenumber").alias("used"),
    )
    deleted = al.deleted_states(F.col("first"), F.col("last"), F.col("used"))
    return used.select("l_orderkey", F.explode(deleted).alias("deleted_state"))


def coverage_sums(spark, folder):
    """Distinct line numbers per order and their sums per split; blank ratio if none."""
    lines = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count_distinct("l_linenumber").alias("states"), F.count(F.lit(1)).alias("residues")
    )
    orders = manifest(spark, folder).select("o_orderkey", "split").join(lines, "o_orderkey", "left")
    return orders.groupBy("split").agg(
        F.coalesce(F.sum("states"), F.lit(0)).alias("match_states"),
        F.coalesce(F.sum("residues"), F.lit(0)).alias("residues"),
        F.count_if(F.col("states").isNull()).alias("without_hit"),
        F.round(F.avg(F.col("states") / 7), 6).alias("mean_coverage"),
    )


def scan_annotation(spark, folder):
    """Parts scanned against a profile: states and coverage, one broken record fails alone."""
    parts = table(spark, folder, "part")
    name = F.regexp_replace(F.upper("p_name"), " ", "")
    ident = F.col("p_partkey").cast("string")
    records = parts.select(
        ident.alias("internal_id"), name.alias("sequence"), t.sha256(name).alias("sequence_sha256"),
        F.when(F.col("p_size") < 35, "discovery").otherwise("validation").alias("split"),
        F.lower("p_type").alias("analysis_cohort"),
        (F.col("p_type") != "ECONOMY").alias("primary_analysis_eligible"),
    )
    length = F.length(name)
    domain = lambda score, included, target: F.struct(
        score.alias("score_bits"), F.lit(0.0).alias("i_evalue"), included.alias("included"),
        F.lit(True).alias("reported"), F.lit(1).alias("hmm_from"),
        (length - F.length(F.regexp_replace(name, "[^A]", ""))).cast("int").alias("hmm_to"),
        F.lit(1).alias("target_from"), length.alias("target_to"),
        F.translate(name, "A", ".").alias("hmm_sequence"), target.alias("target_sequence"),
    )
    score = F.col("p_retailprice") - 900
    broken = F.when(F.col("p_size") > 45, F.concat(F.lit("X"), F.substr(name, F.lit(2)))).otherwise(name)
    hit = lambda domains: [
        ident.alias("internal_id"), score.alias("score_bits"), F.lit(0.0).alias("evalue"),
        F.lit(True).alias("included"), F.lit(True).alias("reported"), domains.alias("domains"),
    ]
    strict = parts.filter("p_retailprice >= 950").select(
        *hit(
            F.array(
                domain(score, F.col("p_size") > 3, broken),
                domain(score - 1, F.col("p_brand") == "Brand#7", name),
            )
        )
    )
    loose = parts.filter("p_retailprice >= 910").select(*hit(F.array(domain(score - 2, F.lit(True), name))))
    model = scan.ProfileModel(length=12, sequence_cutoff=50.0, domain_cutoff=45.0, boundary=10.0)
    scanned = scan.scan_records(records, strict, loose, model)
    return scanned.select(
        "internal_id", "split", "status", "failure_reason", "best_score_bits", "n_ga_domains",
        "n_mapped_residues", "n_match_states", "n_deleted_match_states",
        F.round("residue_coverage", 9).alias("residue_coverage"),
        F.round("hmm_coverage", 9).alias("hmm_coverage"),
    )


def interval_priority_join(spark, folder):
    """Sizes labelled by the intervals of their brand: H before E, otherwise C."""
    parts = table(spark, folder, "part")
    intervals = (
        parts.filter(F.col("p_type").isin("ECONOMY", "SMALL"))
        .groupBy("p_brand", "p_type")
        .agg(F.min("p_size").alias("lo"))
        .select(
            "p_brand", "lo", (F.col("lo") + 12).alias("hi"),
            F.when(F.col("p_type") == "ECONOMY", "H").otherwise("E").alias("code"),
        )
    )
    return label_by_interval(
        parts.select("p_partkey", "p_brand", "p_size"), "p_size", intervals, ["p_brand"],
        "lo", "hi", "code", ["H", "E"], "C", "secondary",
    ).select("p_partkey", "p_brand", "p_size", "secondary")


def domain_left_join(spark, folder):
    """Every position 1..7 of every order with the first line that holds it, or none."""
    firsts = table(spark, folder, "lineitem").groupBy(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("position")
    ).agg(F.min(F.struct("l_partkey", "l_suppkey")).alias("first"))
    code = F.element_at(F.array(*[F.lit(x) for x in ("ALA", "CYS", "ASP", "Glu", "???", "TRP", "TYR")]),
                        F.col("position"))
    domain = table(spark, folder, "orders").select(
        "o_orderkey", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("position")
    )
    return domain.join(firsts, ["o_orderkey", "position"], "left").select(
        "o_orderkey", "position", F.col("first.l_partkey").alias("l_partkey"),
        F.col("first").isNotNull().alias("modeled"), t.residue_letter(code).alias("residue"),
    )


def missing_results(spark, folder):
    """Customers and their order totals, with a state for those without any."""
    results = table(spark, folder, "orders").filter("o_totalprice > 480000").groupBy(
        F.col("o_custkey").alias("c_custkey")
    ).agg(F.count(F.lit(1)).alias("n_results"))
    return table(spark, folder, "customer").select("c_custkey").join(results, "c_custkey", "left").select(
        "c_custkey", F.coalesce("n_results", F.lit(0)).alias("n_results"),
        F.when(F.col("n_results").isNull(), "result_missing").otherwise("success").alias("state"),
    )


def coordinate_integrity(spark, folder):
    """Letters of every part name by position, some spoiled, checked against the name."""
    parts = table(spark, folder, "part")
    cells = parts.select(
        "p_partkey", "p_size", "p_brand", F.posexplode(F.split("p_name", "")).alias("i", "letter")
    ).filter("letter <> ''")
    position = F.when(F.col("p_size") == 50, F.col("i")).otherwise(F.col("i") + 1)
    letter = F.when(F.col("p_size") == 49, F.upper("letter")).otherwise(F.col("letter"))
    coordinates = cells.select(
        "p_partkey", position.alias("position"), letter.alias("residue"),
        (F.col("i") + F.col("p_size")).alias("state"), "p_brand",
    )
    twice = coordinates.filter("p_brand = 'Brand#7' and position = 2")
    return c.coordinate_integrity(
        coordinates.unionByName(twice), parts, "p_partkey", "position", "residue", "p_name",
        ["p_partkey"], "state", 60,
    ).select("rule", "key", "detail")


def scan_reconciliation(spark, folder):
    """Stored counts per part against the rows they count; some are off, some parts are missing or there twice."""
    parts = table(spark, folder, "part")
    cells = parts.select("p_partkey", F.posexplode(F.split("p_name", "")).alias("i", "letter")).filter("letter <> ''")
    key = F.col("p_partkey")
    length = F.length("p_name")
    stored = parts.filter(key % 23 != 0).select(
        "p_partkey", F.when(key % 7 == 0, length - 1).otherwise(length).alias("positions"),
        F.size(F.array_distinct(F.split("p_name", ""))).alias("letters"),
    )
    stored = stored.unionByName(stored.filter(key % 29 == 0))
    details = {"positions": cells.unionByName(cells).select("p_partkey", "i"), "letters": cells.select("p_partkey", "letter")}
    return c.reconcile_counts(stored, details, "p_partkey")


QUERIES = {
    f.__name__: f
    for f in (
        hit_rules, signature_range_filter, hit_classifier, label_precedence, group_summary,
        label_checks, label_domain, align_fold, alignment_rules, deleted_states, coverage_sums, scan_annotation,
        interval_priority_join, domain_left_join, missing_results, coordinate_integrity, scan_reconciliation,
    )
}

_EVENTS = """
    raw as (select event_id, event_type as kind, cast(json_extract_string(props, '$.k') as int) as k from events),
    counted as (select *, case kind when 'purchase' then k % 3 when 'click' then k % 2 else 0 end as hits,
                kind <> 'signup' as submitted from raw),
    judged as (select *, case when not submitted then 'not_submitted'
          when kind = 'error' and k < 50 then 'failed'
          when kind = 'view' and k < 20 then 'result_missing'
          when kind = 'error' then 'parse_failed'
          when kind = 'click' and hits > 0 then 'needs_review'
          when hits = 0 and not k < 90 then 'needs_review' else 'success' end as state from counted),
    labelled as (select *, case when state = 'success' then case when hits > 0 then 1 else 0 end end as label,
          case when state in ('success', 'needs_review') then 'success' else state end as parse_status
        from judged)"""

ORACLES = {
    "hit_rules": """with h as (select *, case when l_returnflag <> 'N' then l_discount end as ev,
            least(l_linenumber + l_quantity::int, 50) as stop from lineitem),
        g as (select *, stop - l_linenumber + 1 as len,
            case when l_linestatus = 'O' then (stop - l_linenumber + 1)::double / 50::double end as cov from h),
        r as (select *, concat_ws('|',
            case when ev is null or l_tax is null then 'significance_missing' end,
            case when ev is not null and l_tax is not null and (ev >= 0.08::double or l_tax >= 0.07::double)
              then 'weak_or_boundary_evalue' end,
            case when cov is null then 'hmm_coverage_missing' end,
            case when cov < 0.5::double then 'low_hmm_coverage' end,
            case when len < 10 then 'short_hit' end) as review_reason from g)
        select l_orderkey, l_partkey, l_linenumber, round(cov, 9) as hmm_coverage, review_reason,
          case when review_reason = '' then 'accepted' else 'needs_review' end as hit_status from r""",
    "signature_range_filter": """select l_orderkey, l_partkey, l_linenumber as "start",
          l_linenumber + l_quantity::int as "end" from lineitem
        where l_returnflag = 'A' and l_linenumber >= 1 and l_linenumber <= l_linenumber + l_quantity::int
          and l_linenumber + l_quantity::int <= 45""",
    "hit_classifier": """with h as (select l_orderkey, count(*) filter (l_quantity >= 30) as strict,
            count(*) filter (l_quantity >= 30 and l_returnflag <> 'N') as included, max(l_quantity) as score,
            max(l_quantity) filter (l_returnflag <> 'N') as best from lineitem group by 1)
        select o_orderkey, case when strict > 0 and included = 0 then 'failed'
            when strict > 0 and included > 1 then 'multi_hit' when strict > 0 then 'accepted'
            when score is null then 'no_hit'
            when least(score - 30, coalesce(best, '-infinity'::double) - 28) >= -5 then 'boundary'
            else 'weak_hit' end as status
        from orders left join h on l_orderkey = o_orderkey""",
    "label_precedence": f"""with {_EVENTS}
        select event_id, state as scan_status, coalesce(cast(label as varchar), '') as label, parse_status,
          state <> 'success' as needs_review from labelled""",
    "group_summary": f"""with {_EVENTS},
        domain(sample_group) as (values ('click'), ('error'), ('purchase'), ('signup'), ('view'), ('absent_group'))
        select d.sample_group, count(l.kind) as selected, count(*) filter (submitted) as submitted,
          count(*) filter (submitted and label is not null) as scan_success,
          count(*) filter (submitted and label = 1) as positive,
          count(*) filter (submitted and label = 0) as not_detected,
          count(*) filter (submitted and label is null) as pending_or_failed,
          count(*) filter (not submitted) as not_submitted,
          count(*) filter (submitted and state = 'needs_review') as needs_review
        from domain d left join labelled l on l.kind = d.sample_group group by 1""",
    "label_checks": f"""with {_EVENTS}
        select 'Label without verified successful result' as rule, cast(event_id as varchar) as key
        from labelled where event_id % 97 = 0 and state <> 'success'""",
    "label_domain": """with domain(event_type, label) as (values ('click', 'Click'), ('view', 'View'),
            ('error', 'Error'), ('refund', 'Refund'))
        select d.event_type, d.label, count(e.event_id) as n from domain d
          left join events e on e.event_type = d.event_type group by all
        union all
        select event_type, 'unknown', count(*) from events
          where event_type not in (select event_type from domain) group by 1""",
    "align_fold": """with a as (select p_partkey, translate(p_name, ' a', '..') as profile,
            upper(translate(p_name, 'eo ', '-.x')) as target, p_size % 7 + 1 as pf, p_size % 5 + 1 as tf from part),
        cols as (select *, unnest(range(1, length(profile) + 1)) as i from a),
        chars as (select *, substr(profile, i, 1) as p, substr(target, i, 1) as c from cols),
        fold as (select *,
            tf + count(*) filter (c not in ('.', '-')) over w as position,
            pf + count(*) filter (p <> '.') over w as state
          from chars window w as (partition by p_partkey order by i rows between unbounded preceding and 1 preceding))
        select p_partkey, position::int as raw_position, case when p <> '.' then state::int end as match_state,
          p = '.' as is_insertion, upper(c) as residue from fold where c not in ('.', '-')""",
    "alignment_rules": """with p as (select p_partkey, replace(upper(p_name), ' ', '') as seq from part)
        select p_partkey, case when p_partkey % 8 in (1, 2) then 'Invalid HMM alignment length or 1-based origin'
          when p_partkey % 8 = 3 then 'Invalid HMM alignment symbol'
          when p_partkey % 8 = 4 then 'Reported HMM domain has no aligned residues'
          when p_partkey % 8 = 5 and seq[1] <> 'X' then 'HMM alignment does not match the full input sequence'
          when p_partkey % 8 = 6 then 'HMM match state is out of range'
          when p_partkey % 8 = 7 then 'HMM alignment terminal coordinate disagrees with target_to' end as reason from p""",
    "deleted_states": """with o as (select l_orderkey, min(l_linenumber) as a, max(l_linenumber) as b
            from lineitem group by 1),
        s as (select l_orderkey, unnest(range(a, b + 1))::int as deleted_state from o)
        select s.* from s left join (select distinct l_orderkey, l_linenumber from lineitem) u
          on u.l_orderkey = s.l_orderkey and u.l_linenumber = s.deleted_state where u.l_orderkey is null""",
    "scan_annotation": """with p as (select *, replace(upper(p_name), ' ', '') as seq, p_retailprice - 900 as score
            from part),
        q as (select *, length(seq) as len, length(replace(seq, 'A', '')) as matched,
            p_retailprice >= 950 as strict, p_retailprice >= 910 as loose,
            (case when p_size > 3 then 1 else 0 end) as d1, (case when p_brand = 'Brand#7' then 1 else 0 end) as d2
          from p),
        r as (select *, case when strict then d1 + d2 else 0 end as n,
            case when d1 = 1 and p_size > 45 and seq[1] <> 'X' then 'HMM alignment does not match the full input sequence'
                 when matched > 12 then 'HMM match state is out of range' end as problem from q),
        s as (select *, case when strict and n = 0 then 'failed' when strict and n > 1 then 'multi_hit'
            when strict then 'accepted' when not loose then 'no_hit'
            when least(score - 50, score - 2 - 45) >= -10 then 'boundary' else 'weak_hit' end as state from r),
        u as (select *, case when state in ('accepted', 'multi_hit') then problem end as failure_reason from s),
        v as (select *, case when failure_reason is not null then 'failed' else state end as status from u),
        w as (select *, status in ('accepted', 'multi_hit') as mapped from v)
        select cast(p_partkey as varchar) as internal_id,
          case when p_size < 35 then 'discovery' else 'validation' end as split, status, failure_reason,
          case when strict or loose then score end as best_score_bits, n as n_ga_domains,
          (case when mapped then len else 0 end)::int as n_mapped_residues,
          (case when mapped then matched else 0 end)::int as n_match_states, 0::int as n_deleted_match_states,
          case when mapped then 1.0::double end as residue_coverage,
          case when mapped and matched > 0 then round(matched / 12::double, 9) end as hmm_coverage from w""",
    "interval_priority_join": """with i as (select p_brand, p_type, min(p_size) as lo from part
            where p_type in ('ECONOMY', 'SMALL') group by all)
        select p_partkey, p_brand, p_size, case
          when exists (select 1 from i where i.p_brand = p.p_brand and p_type = 'ECONOMY'
                       and p_size between lo and lo + 12) then 'H'
          when exists (select 1 from i where i.p_brand = p.p_brand and i.p_type = 'SMALL'
                       and p_size between lo and lo + 12) then 'E' else 'C' end as secondary from part p""",
    "domain_left_join": """with f as (select l_orderkey, l_linenumber, min(l_partkey) as l_partkey
            from lineitem group by all),
        d as (select o_orderkey, unnest(range(1, 8))::int as position from orders)
        select o_orderkey, position, l_partkey, l_partkey is not null as modeled,
          substr('ACDEXWY', position, 1) as residue
        from d left join f on l_orderkey = o_orderkey and l_linenumber = position""",
    "missing_results": """with r as (select o_custkey, count(*) as n from orders where o_totalprice > 480000 group by 1)
        select c_custkey, coalesce(n, 0) as n_results,
          case when n is null then 'result_missing' else 'success' end as state
        from customer left join r on o_custkey = c_custkey""",
    "scan_reconciliation": """with p as (select p_partkey as k, length(p_name) as positions,
            len(list_distinct(string_split(p_name, ''))) as letters from part),
        copies as (select *, case when k % 23 = 0 then 0 when k % 29 = 0 then 2 else 1 end as n from p)
        select k as p_partkey, positions, letters, n * (positions - case when k % 7 = 0 then 1 else 0 end) as positions_stored,
          n * letters as letters_stored, case when n = 0 then 'unknown record' when n = 2 then 'repeated record'
            when k % 7 = 0 then 'differs' else 'agrees' end as state from copies""",
    "coordinate_integrity": """with x as (select p_partkey, p_size, p_name, p_brand, unnest(range(0, length(p_name))) as i from part),
        base as (select p_partkey, p_name, case when p_size = 50 then i else i + 1 end as position,
            case when p_size = 49 then upper(substr(p_name, i + 1, 1)) else substr(p_name, i + 1, 1) end as residue,
            i + p_size as state, p_brand from x),
        rows as (select * from base union all select * from base where p_brand = 'Brand#7' and position = 2)
        select distinct 'residue identity' as rule, p_partkey || ':' || position as key,
            case when position < 1 then substr(p_name, 1, 1) else substr(p_name, position, 1) end as detail
          from rows where position < 1 or substr(p_name, position, 1) <> residue
        union all
        select 'coordinate uniqueness', p_partkey || ',' || position, count(*) || ' rows'
          from rows group by p_partkey, position having count(*) > 1
        union all
        select 'state range', p_partkey || ':' || position, cast(state as varchar) from rows
          where state < 1 or state > 60""",
}


def _coverage_oracle() -> str:
    from .splits import _MANIFEST

    return _MANIFEST + """,
        l as (select l_orderkey, count(distinct l_linenumber) as states, count(*) as residues from lineitem group by 1)
        select split, coalesce(sum(states), 0)::bigint as match_states, coalesce(sum(residues), 0)::bigint as residues,
          count(*) filter (states is null) as without_hit, round(avg(states / 7.0::double), 6) as mean_coverage
        from m left join l on l_orderkey = o_orderkey group by split"""


ORACLES["coverage_sums"] = _coverage_oracle()
