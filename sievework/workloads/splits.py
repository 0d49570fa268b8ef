"""Split queries: greedy whole-cluster allocation, manifests, leakage and agreement."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import constraints as c
from ..operators import histograms as h
from ..operators import split as s
from ..operators.ranking import seeded_rank as rank_by_seed
from ..session import materialise
from .tables import table

RATIOS = s.parse_ratios("discovery=0.7,validation=0.3")
THREE_WAY = s.parse_ratios("train=0.6,tune=0.2,test=0.2")


def _members(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey", "o_orderstatus", "o_orderpriority", F.col("o_custkey").cast("string").alias("cluster")
    )


def _sizes(members):
    """Cluster sizes, counted once and stored for the readers that follow."""
    return materialise(s.cluster_sizes(members, "cluster"))


def _assignment(spark, folder):
    return s.allocate_clusters(_sizes(_members(spark, folder)), RATIOS, 42)


def greedy_split(spark, folder):
    return _assignment(spark, folder)


def greedy_split_three(spark, folder):
    """Three splits, two of them with equal ratios, over the events of each user."""
    events = table(spark, folder, "events").select(F.col("user_id").cast("string").alias("cluster"))
    return s.allocate_clusters(_sizes(events), THREE_WAY, 7)


def manifest(spark, folder):
    return s.assign_members(
        _members(spark, folder), _assignment(spark, folder), "cluster", F.col("o_orderkey")
    )


def split_manifest(spark, folder):
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("cluster"), "c_name", "c_mktsegment"
    )
    described = _assignment(spark, folder).join(customers, "cluster")
    members = _members(spark, folder)
    return s.assign_members(members, described, "cluster", F.col("o_orderkey")).select(
        F.col("o_orderkey"), "c_name", "c_mktsegment",
        (F.col("o_orderpriority") == "1-URGENT").alias("primary_analysis_eligible"),
        F.col("cluster").alias("homology_cluster"), "split",
    )


def split_summary(spark, folder):
    return s.split_counts(
        manifest(spark, folder), "cluster", F.col("o_orderpriority") == "1-URGENT"
    )


def split_cohort_counts(spark, folder):
    return manifest(spark, folder).groupBy("split", "o_orderstatus").agg(
        F.count(F.lit(1)).alias("n_sequences")
    )


def split_leakage(spark, folder):
    """Clusters that cross splits: none for the greedy split, many for a naive one."""
    greedy = s.leaking_clusters(manifest(spark, folder), "cluster", "split")
    naive = s.leaking_clusters(
        _members(spark, folder).withColumn(
            "split", F.when(F.col("o_orderkey") % 10 < 7, "discovery").otherwise("validation")
        ),
        "cluster", "split",
    )
    return c.all_violations(
        [
            c.leakage(greedy).withColumn("assignment", F.lit("greedy")),
            c.leakage(naive).withColumn("assignment", F.lit("naive")),
        ]
    ).select("assignment", "key", "detail")


def split_agreement(spark, folder):
    sizes = _sizes(_members(spark, folder))
    return s.split_agreement(
        s.allocate_clusters(sizes, RATIOS, 42), s.allocate_clusters(sizes, RATIOS, 43),
        "cluster", "size",
    )


def cluster_size_stats(spark, folder):
    return s.cluster_statistics(s.cluster_sizes(_members(spark, folder), "cluster"))


def cluster_coverage(spark, folder):
    """Customers in credit are expected once each among the customers of large orders."""
    expected = table(spark, folder, "customer").filter("c_acctbal > 0").select(
        F.col("c_custkey").alias("key")
    )
    observed = table(spark, folder, "orders").filter("o_totalprice > 450000").select(
        F.col("o_custkey").alias("key")
    )
    return c.partition_coverage(expected, observed, "key").select("key", "detail")


def set_difference(spark, folder):
    left = table(spark, folder, "documents").select("doc_id")
    right = table(spark, folder, "labels").select("doc_id")
    return c.set_difference(left, right, "doc_id").select("key", "detail")


def hist_fixed(spark, folder):
    return h.fixed_width(table(spark, folder, "documents"), "n_chars", 50, 1850, 50).select(
        "bin", "lower", "n"
    )


def hist_equal_width(spark, folder):
    return h.equal_width(table(spark, folder, "orders"), "o_totalprice", 30)


def cluster_size_histogram(spark, folder):
    return h.equal_width(s.cluster_sizes(_members(spark, folder), "cluster"), "size", 30)


def occupancy_zero_fill(spark, folder):
    rows = table(spark, folder, "lineitem").withColumn("is_insertion", F.col("l_returnflag") == "R")
    return h.occupancy(rows, "l_linenumber", "l_orderkey", 10, "is_insertion")


def seeded_rank(spark, folder):
    return rank_by_seed(table(spark, folder, "documents").select("doc_id"), ["doc_id"], 42)


QUERIES = {
    f.__name__: f
    for f in (
        greedy_split, greedy_split_three, split_manifest, split_summary, split_cohort_counts,
        split_leakage, split_agreement, cluster_size_stats, cluster_coverage, set_difference,
        hist_fixed, hist_equal_width, cluster_size_histogram, occupancy_zero_fill, seeded_rank,
    )
}


def _greedy_sql(name: str, seed: int) -> str:
    """The two-way rule as a recursive query, one step per cluster."""
    first = "g.dn / (0.7::double * o.total) <= g.vn / (0.3::double * o.total)"
    return f"""
    {name}_o as (select *, row_number() over (order by size desc, sha256('{seed}:' || rep)) as rn,
                 sum(size) over () as total from c),
    {name}_g(rn, rep, size, split, dn, vn) as (
      select 0::bigint, ''::varchar, 0::bigint, ''::varchar, 0::double, 0::double
      union all
      select o.rn, o.rep, o.size, case when {first} then 'discovery' else 'validation' end,
        g.dn + case when {first} then o.size else 0 end,
        g.vn + case when {first} then 0 else o.size end
      from {name}_g g join {name}_o o on o.rn = g.rn + 1),
    {name} as (select rep, size, split from {name}_g where rn > 0)"""


_CLUSTERS = "with recursive c as (select cast(o_custkey as varchar) as rep, count(*) as size from orders group by 1),"
_SPLIT = _CLUSTERS + _greedy_sql("a", 42)
_MANIFEST = _SPLIT + """,
    m as (select o.*, a.rep, a.split from orders o join a on a.rep = cast(o.o_custkey as varchar))"""

ORACLES = {
    "greedy_split": _SPLIT + ' select rep as "cluster", size, split from a',
    "greedy_split_three": """with recursive
        c as (select cast(user_id as varchar) as rep, count(*) as size from events group by 1),
        o as (select *, row_number() over (order by size desc, sha256('7:' || rep)) as rn,
              (sum(size) over ())::double as total from c),
        g(rn, rep, size, split, a, b, t) as (
          select 0::bigint, ''::varchar, 0::bigint, ''::varchar, 0::double, 0::double, 0::double
          union all
          select rn, rep, size, pick, a + case when pick = 'train' then size else 0 end,
            b + case when pick = 'test' then size else 0 end,
            t + case when pick = 'tune' then size else 0 end
          from (select o.rn, o.rep, o.size, g.a, g.b, g.t,
              case when g.a / (0.6::double * total) <= least(g.b / (0.2::double * total), g.t / (0.2::double * total))
                     then 'train'
                   when g.b / (0.2::double * total) <= g.t / (0.2::double * total) then 'test'
                   else 'tune' end as pick
            from g join o on o.rn = g.rn + 1))
        select rep as "cluster", size, split from g where rn > 0""",
    "split_manifest": _MANIFEST + """
        select o_orderkey, c_name, c_mktsegment, o_orderpriority = '1-URGENT' as primary_analysis_eligible,
          rep as homology_cluster, split from m join customer on c_custkey = o_custkey""",
    "split_summary": _MANIFEST + """
        select split, count(*) as n_sequences, count(distinct rep) as n_clusters,
          count(*) filter (o_orderpriority = '1-URGENT') as n_primary from m group by split""",
    "split_cohort_counts": _MANIFEST + """
        select split, o_orderstatus, count(*) as n_sequences from m group by all""",
    "split_leakage": _MANIFEST + """,
        both_ways as (select 'greedy' as assignment, rep as key, split from m union all
          select 'naive', cast(o_custkey as varchar),
            case when o_orderkey % 10 < 7 then 'discovery' else 'validation' end from orders)
        select assignment, key, 'assigned to more than one split' as detail from both_ways
        group by all having count(distinct split) > 1""",
    "split_agreement": _SPLIT + "," + _greedy_sql("b", 43) + """
        select (sum(a.size) filter (a.split = b.split))::bigint as matching, sum(a.size)::bigint as total,
          round((sum(a.size) filter (a.split = b.split))::double / sum(a.size)::double, 6) as agreement
        from a join b on a.rep = b.rep""",
    "cluster_size_stats": """with c as (select o_custkey, count(*) as size from orders group by 1)
        select count(*) as n_clusters, max(size) as max_cluster_size,
          count(*) filter (size = 1) as n_singletons from c""",
    "cluster_coverage": """with e as (select c_custkey as key from customer where c_acctbal > 0),
        g as (select o_custkey as key, count(*) as n from orders where o_totalprice > 450000 group by 1)
        select cast(coalesce(e.key, g.key) as varchar) as key,
          case when e.key is null then 'unknown member' when g.key is null then 'missing'
               else 'appears more than once' end as detail
        from e full join g on e.key = g.key where e.key is null or g.key is null or n > 1""",
    "set_difference": """select cast(coalesce(d.doc_id, l.doc_id) as varchar) as key,
          case when l.doc_id is null then 'only left' else 'only right' end as detail
        from documents d full join labels l on d.doc_id = l.doc_id
        where d.doc_id is null or l.doc_id is null""",
    "hist_fixed": """with b as (select unnest(range(0, 35))::int as bin),
        n as (select least(floor((n_chars - 50) / 50), 34)::int as bin, count(*) as n
              from documents where n_chars between 50 and 1800 group by 1)
        select b.bin, (50 + b.bin * 50)::bigint as "lower", coalesce(n.n, 0) as n from b left join n on b.bin = n.bin""",
    "hist_equal_width": """with l as (select min(o_totalprice) as lo, max(o_totalprice) as hi from orders),
        b as (select unnest(range(0, 30))::int as bin),
        n as (select least(floor((o_totalprice - lo) / (hi - lo) * 30), 29)::int as bin, count(*) as n
              from orders, l group by 1)
        select b.bin, coalesce(n.n, 0) as n from b left join n on b.bin = n.bin""",
    "cluster_size_histogram": """with c as (select count(*)::double as size from orders group by o_custkey),
        l as (select case when max(size) > min(size) then min(size) else min(size) - 0.5 end as lo,
                     case when max(size) > min(size) then max(size) else max(size) + 0.5 end as hi from c),
        b as (select unnest(range(0, 30))::int as bin),
        n as (select least(floor((size - lo) * 30 / (hi - lo)), 29)::int as bin, count(*) as n from c, l group by 1)
        select b.bin, coalesce(n.n, 0) as n from b left join n on b.bin = n.bin""",
    "occupancy_zero_fill": """with s as (select unnest(range(1, 11))::int as state)
        select s.state, count(distinct l_orderkey) as n
        from s left join lineitem l on l.l_linenumber = s.state and l_returnflag <> 'R' group by 1""",
    "seeded_rank": """select doc_id, row_number() over (order by sha256('42:' || doc_id)) - 1 as "rank" from documents""",
}
