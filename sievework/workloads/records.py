"""Record queries: projections, nested members, set operations, formats and digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as t
from ..operators import constraints as c
from ..operators.digests import table_digest
from ..operators.quality import counts_by
from ..sinks.fasta import fasta_entry
from ..sources.fasta import parse_entry
from .tables import table


def record_projection(spark, folder):
    """Formatted ids, trimmed fields and flags as text, for the customers in credit."""
    padded = F.concat(F.lit(" \t"), F.col("c_name"), F.lit("  "))
    return table(spark, folder, "customer").filter("c_acctbal > 0").select(
        t.ordinal_id("REC_", F.col("c_custkey") + 1).alias("internal_id"),
        t.strip_text(padded).alias("name"),
        t.bool_text(F.col("c_acctbal") > 5000).alias("is_rich"),
        t.bool_text(F.col("c_mktsegment") == "BUILDING", capital=True).alias("is_building"),
    )


def _nested(spark, folder):
    """Documents as nested records: the first line represents, the others are members."""
    lines = F.split("text", "\n")
    return table(spark, folder, "documents").select(
        "doc_id", "n_chars", lines[0].alias("representative"),
        F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))).alias("members"),
    )


def member_explode(spark, folder):
    nested = _nested(spark, folder)
    any_word = t.has_word(F.col("representative"), "the") | F.exists(
        "members", lambda m: t.has_word(m, "the")
    )
    return nested.select(
        "doc_id", any_word.alias("any_member"), F.posexplode("members").alias("i", "member")
    ).select(
        "doc_id", (F.col("i") + 1).cast("bigint").alias("member_number"), "any_member",
        F.length("member").cast("bigint").alias("member_length"),
        t.sha256(F.col("member")).alias("member_sha256"),
    )


def nested_invariants(spark, folder):
    """Recorded character counts against the members, with a summary of the members."""
    total = F.length("representative") + F.aggregate(
        "members", F.lit(0), lambda n, m: n + F.length(m) + 1
    )
    checked = _nested(spark, folder).select(
        F.size("members").cast("bigint").alias("n"), (total != F.col("n_chars")).alias("broken")
    )
    return checked.agg(
        F.count(F.lit(1)).alias("records"), F.sum("n").alias("redundant"),
        F.sum(F.col("n") + 1).alias("original"), F.max("n").alias("largest"),
        F.count_if("broken").alias("broken"),
    )


def conversation_invariants(spark, folder):
    """Conversations whose turns are not numbered 0, 1, 2 … without a gap."""
    turns = table(spark, folder, "conversations").groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("turn").alias("last"), F.count_distinct("turn").alias("d"),
        F.count_if(F.col("role") == "user").alias("user_turns"),
    )
    return turns.select(
        "conv_id", "n", "user_turns",
        ((F.col("last") + 1 == F.col("n")) & (F.col("d") == F.col("n"))).alias("complete"),
    )


def length_hash_agreement(spark, folder):
    """Recorded lengths and digests against the texts; a few records were spoiled."""
    docs = table(spark, folder, "documents").select(
        F.col("doc_id"), "text",
        F.when(F.col("doc_id") % 100 == 7, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("n"),
        F.when(F.col("doc_id") % 150 == 7, F.lit("0")).otherwise(t.sha256(F.col("text"))).alias("sha"),
    )
    return c.sequence_identity(docs, "doc_id", "text", "n", "sha").select("key", "detail")


def cross_table_agreement(spark, folder):
    """Lines and their orders must name the same status; the differing orders are listed."""
    lines = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(
        F.max("l_linestatus").alias("status"), F.max("l_shipdate").alias("day")
    )
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"),
        F.col("o_orderdate").alias("day"),
    )
    return c.agreement(lines, orders, "key", ["status", "day"]).select("key", "detail")


def json_key_union(spark, folder):
    """Keys found in a JSON column, with how often each occurs and its distinct values."""
    entries = table(spark, folder, "events").select(
        F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"),
        F.get_json_object("props", "$.absent.path").alias("absent"),
    )
    # Equal entries are merged before the shuffle, so a frequent key is no burden.
    merged = entries.groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"), F.max("absent").alias("absent"))
    return merged.groupBy("key").agg(
        F.sum("n").alias("n"), F.count("value").alias("distinct_values"), F.max("absent").alias("absent")
    )


def group_detail(spark, folder):
    """Per language: source counts and length bins as rows, so nothing is collected per group."""
    docs = table(spark, folder, "documents")
    bins = t.length_bin(F.col("n_chars"), 250)
    sources = docs.groupBy("lang", F.col("source").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    lengths = docs.groupBy("lang", bins.cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return sources.withColumn("detail", F.lit("source")).unionByName(
        lengths.withColumn("detail", F.lit("length_bin"))
    )


def union_exclusions(spark, folder):
    docs = table(spark, folder, "documents")
    labels = table(spark, folder, "labels")
    short = docs.filter("n_chars < 200").select("doc_id", F.lit("too_short").alias("reason"))
    toxic = labels.filter("toxic = 1").select("doc_id", F.lit("toxic").alias("reason"))
    return short.unionByName(toxic)


def multiset_intersection(spark, folder):
    """Common words of both halves of the parts, with their smaller count."""
    parts = table(spark, folder, "part")
    words = parts.select("p_size", F.explode(F.split("p_name", " ")).alias("word"))
    small = counts_by(words.filter("p_size <= 20"), "word").withColumnRenamed("n", "a")
    large = counts_by(words.filter("p_size > 20"), "word").withColumnRenamed("n", "b")
    return small.join(large, "word").select("word", F.least("a", "b").alias("n"))


def set_except(spark, folder):
    """Nations of suppliers with a debt that no customer with a debt comes from."""
    suppliers = table(spark, folder, "supplier").filter("s_acctbal < 500").select(
        F.col("s_nationkey").alias("nation")
    )
    customers = table(spark, folder, "customer").filter("c_acctbal < -900").select(
        F.col("c_nationkey").alias("nation")
    )
    return suppliers.subtract(customers)


def ordered_topk(spark, folder):
    """The first five unlabelled documents by id."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return docs.select("doc_id").join(labels, "doc_id", "left_anti").orderBy("doc_id").limit(5)


def quota_per_group(spark, folder):
    """The three best documents per language by (length bin, source, id)."""
    from pyspark.sql import Window

    order = Window.partitionBy("lang").orderBy("bin", "source", "doc_id")
    docs = table(spark, folder, "documents").select(
        "lang", "source", "doc_id", t.length_bin(F.col("n_chars")).alias("bin")
    )
    # The rank filter is applied before the shuffle too, so a large group sends three rows per task.
    return docs.withColumn("rank", F.row_number().over(order).cast("bigint")).filter("rank <= 3")


def tuple_argmin(spark, folder):
    """Per customer the order with the least (priority, price, key)."""
    first = F.min(F.struct("o_orderpriority", "o_totalprice", "o_orderkey"))
    return table(spark, folder, "orders").groupBy("o_custkey").agg(first.alias("f")).select(
        "o_custkey", "f.*"
    )


def version_ids(spark, folder):
    digest = t.sha256(F.col("p_name"))
    return table(spark, folder, "part").select(
        "p_partkey",
        t.version_id("parts-", digest, 12).alias("data_version"),
        t.version_id("split-", digest, 10, "-s42").alias("split_version"),
    )


def hash_format(spark, folder):
    digest = t.sha256(F.col("p_name"))
    spoiled = (
        F.when(F.col("p_size") < 5, F.upper(digest)).when(F.col("p_size") < 8, F.left(digest, F.lit(63)))
        .when(F.col("p_size") < 10, F.lit("")).when(F.col("p_size") >= 12, digest)
    )
    state = F.when(F.coalesce(spoiled, F.lit("")) == "", "missing hash").when(
        ~t.is_sha256(spoiled), "invalid hash"
    ).otherwise("ok")
    return table(spark, folder, "part").select("p_partkey", state.alias("state"))


def artifact_states(spark, folder):
    """Expected digests of documents against the digests found for the labelled ones."""
    docs = table(spark, folder, "documents").select(
        "doc_id", t.sha256(F.col("text")).alias("expected"), "text"
    )
    found = table(spark, folder, "labels").select("doc_id", F.col("toxic"))
    joined = docs.join(found, "doc_id", "left")
    text = F.when(F.col("toxic") == 1, F.replace("text", F.lit("\n"), F.lit("\r\n"))).when(
        F.col("toxic") == 0, F.col("text")
    )
    actual, lines = t.sha256(text), t.line_ending_digests(text)
    return joined.select(
        "doc_id", rules.artifact_status(actual, F.col("expected")).alias("status"),
        F.coalesce(lines["lf"] == F.col("expected"), F.lit(False)).alias("lf_matches"),
    )


def numeric_parse(spark, folder):
    """Numbers as text with blanks, words, signs and infinities among them."""
    raw = (
        F.when(F.col("l_partkey") % 11 == 0, "").when(F.col("l_partkey") % 11 == 1, "inf")
        .when(F.col("l_partkey") % 11 == 2, "x1").when(F.col("l_partkey") % 11 == 3, "-3")
        .when(F.col("l_partkey") % 11 == 4, "1e-5")
        .otherwise(F.col("l_quantity").cast("int").cast("string"))
    )
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        rules.parse_nonnegative(raw).alias("value"), rules.bad_number(raw).alias("is_bad"),
    )


def line_wrap(spark, folder):
    wrapped = t.wrap_lines(F.translate("text", "\n", " "))
    return table(spark, folder, "documents").select(
        "doc_id", t.sha256(wrapped).alias("wrapped_sha256"),
        F.size(F.split(wrapped, "\n")).cast("bigint").alias("lines"),
    )


def fasta_roundtrip(spark, folder):
    """Documents rendered as FASTA entries and parsed back."""
    docs = table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.regexp_replace("text", r"[\r\n>]", "").alias("s")
    )
    entry = F.substring(fasta_entry(F.col("id"), F.col("s")), F.lit(2), F.length("s") * 2 + 100)
    parsed = parse_entry(entry)
    return docs.select(parsed["internal_id"].alias("internal_id"), t.sha256(parsed["sequence"]).alias("sha256"))


def baseline_diff(spark, folder):
    """Computed counts against frozen ones; the names that differ or are absent."""
    docs = table(spark, folder, "documents").agg(
        F.count(F.lit(1)).alias("documents"), F.count_distinct("lang").alias("languages"),
        F.max("n_chars").alias("longest"),
    )
    values = c.named_values(docs, ["documents", "languages", "longest"])
    frozen = {"documents": "1000", "languages": "5", "longest": "1", "clusters": "478"}
    return c.expected_values(values, frozen)


def receipt_agreement(spark, folder):
    """The same digest taken from two tables: orders found directly and through lines."""
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    orders = table(spark, folder, "orders").select("o_orderkey")
    left = table_digest(lines, ["o_orderkey"]).select(F.lit("lines").alias("receipt"), "*")
    right = table_digest(orders, ["o_orderkey"]).select(F.lit("orders").alias("receipt"), "*")
    return left.unionByName(right)


def content_digest(spark, folder):
    return table_digest(
        table(spark, folder, "documents"), ["doc_id", "text", "lang", "source"]
    )


QUERIES = {
    f.__name__: f
    for f in (
        record_projection, member_explode, nested_invariants, conversation_invariants,
        length_hash_agreement, cross_table_agreement, json_key_union, group_detail,
        union_exclusions, multiset_intersection, set_except, ordered_topk, quota_per_group,
        tuple_argmin, version_ids, hash_format, artifact_states, numeric_parse, line_wrap,
        fasta_roundtrip, baseline_diff, receipt_agreement, content_digest,
    )
}


def _digest_sql(source: str, columns: list[str]) -> str:
    cells = ", ".join(
        f"coalesce(length(cast({x} as varchar)) || ':' || cast({x} as varchar), '-')" for x in columns
    )
    lanes = ", ".join(
        f"cast(coalesce(sum(cast(('0x' || substr(d, {1 + 15 * i}, 15))::ubigint as decimal(38,0))), 0) as varchar)"
        for i in range(4)
    )
    return f"""select count(*) as n_rows, sha256(concat_ws(':', cast(count(*) as varchar), {lanes})) as content_sha256
        from (select sha256(concat_ws(',', {cells})) as d from {source})"""


_WORD = r"(?i)(^|[^\p{L}\p{M}\p{N}_])the([^\p{L}\p{M}\p{N}_]|$)"

ORACLES = {
    "record_projection": """select 'REC_' || lpad(cast(c_custkey + 1 as varchar), 6, '0') as internal_id,
          c_name as name, cast(c_acctbal > 5000 as varchar) as is_rich,
          case when c_mktsegment = 'BUILDING' then 'True' else 'False' end as is_building
        from customer where c_acctbal > 0""",
    "member_explode": f"""with l as (select doc_id, string_split(text, chr(10)) as lines from documents),
        f as (select *, len(list_filter(lines, lambda x: regexp_matches(x, '{_WORD}'))) > 0 as any_member from l),
        m as (select doc_id, any_member, unnest(range(1, len(lines)))::bigint as member_number, lines from f)
        select doc_id, member_number, any_member, length(lines[member_number + 1])::bigint as member_length,
          sha256(lines[member_number + 1]) as member_sha256 from m""",
    "nested_invariants": """with d as (select n_chars, length(text) as n,
            len(string_split(text, chr(10))) - 1 as members from documents)
        select count(*) as records, sum(members)::bigint as redundant, sum(members + 1)::bigint as original,
          max(members)::bigint as largest, count(*) filter (n <> n_chars) as broken from d""",
    "conversation_invariants": """select conv_id, count(*) as n, count(*) filter (role = 'user') as user_turns,
          max(turn) + 1 = count(*) and count(distinct turn) = count(*) as complete
        from conversations group by 1""",
    "length_hash_agreement": """select cast(doc_id as varchar) as key, concat_ws(',',
            case when coalesce(text, '') = '' then 'empty' end, case when doc_id % 100 = 7 then 'length' end,
            case when doc_id % 150 = 7 then 'digest' end) as detail
        from documents where doc_id % 100 = 7 or doc_id % 150 = 7 or coalesce(text, '') = ''""",
    "cross_table_agreement": """with l as (select l_orderkey, max(l_linestatus) as s, max(l_shipdate) as d
            from lineitem group by 1)
        select cast(o_orderkey as varchar) as key, concat_ws(',',
          case when s is distinct from o_orderstatus then 'status' end,
          case when d is distinct from o_orderdate then 'day' end) as detail
        from l join orders on l_orderkey = o_orderkey
        where s is distinct from o_orderstatus or d is distinct from o_orderdate""",
    "json_key_union": """with k as (select props, unnest(json_keys(props)) as key from events)
        select key, count(*) as n, count(distinct json_extract_string(props, '$.' || key)) as distinct_values,
          max(json_extract_string(props, '$.absent.path')) as absent from k group by 1""",
    "group_detail": """select lang, source as value, count(*) as n, 'source' as detail from documents group by all
        union all select lang, cast(n_chars // 250 as varchar), count(*), 'length_bin' from documents group by all""",
    "union_exclusions": """select doc_id, 'too_short' as reason from documents where n_chars < 200
        union all select doc_id, 'toxic' from labels where toxic = 1""",
    "multiset_intersection": """with w as (select p_size, unnest(string_split(p_name, ' ')) as word from part),
        i as (select word from w where p_size <= 20 intersect all select word from w where p_size > 20)
        select word, count(*) as n from i group by 1""",
    "set_except": """select s_nationkey as nation from supplier where s_acctbal < 500
        except select c_nationkey from customer where c_acctbal < -900""",
    "ordered_topk": """select doc_id from documents where doc_id not in (select doc_id from labels)
        order by doc_id limit 5""",
    "quota_per_group": """with d as (select lang, source, doc_id, n_chars // 25 as bin from documents),
        r as (select *, row_number() over (partition by lang order by bin, source, doc_id) as "rank" from d)
        select * from r where "rank" <= 3""",
    "tuple_argmin": """with r as (select *, row_number() over (partition by o_custkey
            order by o_orderpriority, o_totalprice, o_orderkey) as n from orders)
        select o_custkey, o_orderpriority, o_totalprice, o_orderkey from r where n = 1""",
    "version_ids": """select p_partkey, 'parts-' || left(sha256(p_name), 12) as data_version,
          'split-' || left(sha256(p_name), 10) || '-s42' as split_version from part""",
    "hash_format": """with h as (select p_partkey, case when p_size < 5 then upper(sha256(p_name))
            when p_size < 8 then left(sha256(p_name), 63) when p_size < 10 then ''
            when p_size >= 12 then sha256(p_name) end as h from part)
        select p_partkey, case when coalesce(h, '') = '' then 'missing hash'
          when not regexp_full_match(h, '[0-9a-f]{64}') then 'invalid hash' else 'ok' end as state from h""",
    "artifact_states": """with a as (select d.doc_id, d.text, case when toxic = 1 then replace(text, chr(10), chr(13) || chr(10))
            when toxic = 0 then text end as t from documents d left join labels l on d.doc_id = l.doc_id)
        select doc_id, case when t is null then 'unverified_missing' when sha256(t) = sha256(text) then 'match'
            else 'mismatch' end as status,
          coalesce(sha256(replace(t, chr(13) || chr(10), chr(10))) = sha256(text), false) as lf_matches from a""",
    "numeric_parse": """with r as (select *, case l_partkey % 11 when 0 then '' when 1 then 'inf' when 2 then 'x1'
            when 3 then '-3' when 4 then '1e-5' else cast(l_quantity::int as varchar) end as raw from lineitem),
        p as (select *, try_cast(raw as double) as v from r)
        select l_orderkey, l_linenumber, l_partkey, l_suppkey,
          case when v >= 0 and not isinf(v) then v end as value,
          raw <> '' and not coalesce(v >= 0 and not isinf(v), false) as is_bad from p""",
    "line_wrap": """with d as (select doc_id, replace(text, chr(10), ' ') as s from documents),
        w as (select doc_id, array_to_string(list_transform(range(0, greatest((length(s) + 79) // 80, 1)),
            lambda i: substr(s, (i * 80 + 1)::bigint, 80)), chr(10)) as wrapped from d)
        select doc_id, sha256(wrapped) as wrapped_sha256, len(string_split(wrapped, chr(10)))::bigint as lines from w""",
    "fasta_roundtrip": r"""select cast(doc_id as varchar) as internal_id,
          sha256(regexp_replace(text, '[\r\n>]', '', 'g')) as sha256 from documents""",
    "baseline_diff": """with o as (select count(*) as documents, count(distinct lang) as languages,
            max(n_chars) as longest from documents),
        v(name, expected) as (values ('documents', '1000'), ('languages', '5'), ('longest', '1'), ('clusters', '478')),
        j as (select v.*, case name when 'documents' then cast(documents as varchar)
            when 'languages' then cast(languages as varchar) when 'longest' then cast(longest as varchar) end as observed
          from v, o)
        select name, observed, expected from j where observed is distinct from expected""",
    "receipt_agreement": f"""select 'lines' as receipt, * from ({_digest_sql("(select distinct l_orderkey as o_orderkey from lineitem)", ["o_orderkey"])})
        union all select 'orders', * from ({_digest_sql("orders", ["o_orderkey"])})""",
    "content_digest": _digest_sql("documents", ["doc_id", "text", "lang", "source"]),
}


# --- receipts -------------------------------------------------------------


def receipt_rules(spark, folder):
    """One JSON receipt per order, some incomplete or wrong; all broken rules as rows."""
    from ..operators import receipts as rc

    key, flag = F.col("o_orderkey"), F.col("o_orderstatus")
    digest = t.sha256(key.cast("string"))
    body = F.to_json(
        F.struct(
            F.when(key % 7 != 0, flag).alias("status"),
            F.struct(
                F.when(key % 5 == 0, F.upper(digest)).when(key % 11 != 0, digest).alias("metadata.csv")
            ).alias("output_sha256"),
            (key % 13 == 0).alias("cluster_leakage"),
            F.struct(F.floor(key / 10000).alias("discovery")).alias("counts"),
        )
    )
    receipts = table(spark, folder, "orders").select("o_orderkey", F.parse_json(body).alias("audit"))
    rules = [
        rc.Rule("required", "audit", ("status",)), rc.Rule("required", "audit", ("counts",)),
        rc.Rule("digest", "audit", ("output_sha256", "metadata.csv")),
        rc.Rule("equals", "audit", ("cluster_leakage",), False), rc.Rule("equals", "audit", ("counts", "discovery"), 0),
    ]
    return rc.broken_rules(receipts, "o_orderkey", rules).select("o_orderkey", "error")


QUERIES["receipt_rules"] = receipt_rules
ORACLES["receipt_rules"] = """with r as (select o_orderkey as k from orders), e as (
        select k, 'audit.status: no value' as error from r where k % 7 = 0 union all
        select k, 'audit.output_sha256.metadata.csv: not a SHA-256 digest' from r
          where k % 5 = 0 and upper(sha256(cast(k as varchar))) <> sha256(cast(k as varchar)) union all
        select k, 'audit.output_sha256.metadata.csv: no digest' from r where k % 5 <> 0 and k % 11 = 0 union all
        select k, 'audit.cluster_leakage: true instead of false' from r where k % 13 = 0 union all
        select k, 'audit.counts.discovery: ' || (k // 10000) || ' instead of 0' from r
          where k // 10000 <> 0)
    select k as o_orderkey, error from e"""
