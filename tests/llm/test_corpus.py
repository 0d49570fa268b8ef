"""Dealt operators against plain Python on small tables with awkward rows."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sievework.llm import jaccard, language, mixing, packing, sharding, substrings, toxicity
from sievework.llm.base import Scratch, components, numbered
from sievework.llm.html import main_text

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, n string, token string, row int"


def sentence(rng, words=9):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(words)).capitalize() + "."


def prose(rng, sentences=12):
    return " ".join(sentence(rng) for _ in range(sentences))


def table(spark, rows):
    return spark.createDataFrame([(i, t, la, so, len(t or ""), "x", "y", "z", 1) for i, t, la, so in rows], SCHEMA)


@pytest.fixture(scope="module")
def awkward(spark):
    rng = random.Random(3)
    base = [prose(rng) for _ in range(8)]
    rows = [(i, t, "en", "s1") for i, t in enumerate(base)]
    rows += [(20, base[0].upper(), "en", "s1"), (21, base[0], None, None), (21, base[0], None, None), (22, base[1] + " More words.", "en", "s2")]
    rows += [(30, None, None, None), (31, "", "en", "s1"), (32, " \t\n ", "en", "s3"), (33, "one", "en", "s3"), (34, "One", "en", "s3")]
    rows += [(35, "a b", "en", "s3"), (None, base[2], "en", "s3"), (None, "zzz only here", "en", None), (36, "1 2 3 . !", "en", "s2")]
    rows += [(40, "word " * 30_000, "en", "s4"), (41, "x" * 300_000, "en", "s4"), (42, " é　漢字 a\x0bb", "en", "é")]
    words = base[3].split()
    for k in range(6):  # near copies with one word changed
        rows.append((50 + k, " ".join([*words[: 10 + k], "other", *words[11 + k :]]), "en", "s5"))
    return rows


def word_list(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def shingle_set(text, size):
    w = word_list(text)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def brute_groups(rows, size, percent):
    sets = [shingle_set(t, size) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(i)
    return sets, groups


@pytest.mark.parametrize("size,percent,rare", [(3, 90, 32), (5, 80, 32), (3, 90, 1), (2, 60, 2)])
def test_jaccard_join_is_exact(spark, awkward, size, percent, rare):
    found = jaccard.similar_documents(Scratch(spark), table(spark, awkward), size, percent, rare)
    sets, groups = brute_groups(awkward, size, percent)
    expected = Counter()
    for members in groups.values():
        ids = [awkward[i][0] for i in members if awkward[i][0] is not None]
        for i in members:
            expected[awkward[i][0], len(sets[i]), min(ids) if ids else None] += 1
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()) == expected


def test_jaccard_join_random_edits(spark):
    rng = random.Random(8)
    base = [sentence(rng, 60).split() for _ in range(3)]
    rows = []
    for i in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(["p", "q", "r"])
        rows.append((i, " ".join(w), None, None))
    found = jaccard.similar_documents(Scratch(spark), table(spark, rows), 3, 80, rare=4)
    _, groups = brute_groups(rows, 3, 80)
    assert {r.doc_id: r.component_id for r in found.collect()} == {i: min(g) for g in groups.values() for i in g}


def test_one_per_group(spark, awkward):
    kept = jaccard.one_per_group(Scratch(spark), table(spark, awkward), 5, 80)
    assert kept.columns == SCHEMA_NAMES
    sets, groups = brute_groups(awkward, 5, 80)
    expected = Counter()
    for members in groups.values():
        chosen = members if not sets[members[0]] else [min(members, key=lambda i: (awkward[i][0] is None, awkward[i][0] or 0))]
        expected.update(awkward[i][0] for i in chosen)
    assert Counter(r.doc_id for r in kept.collect()) == expected


SCHEMA_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def test_empty_tables(spark):
    none = table(spark, [])
    s = Scratch(spark)
    assert jaccard.similar_documents(s, none).count() == 0
    assert substrings.remove_repeats(s, none).count() == 0
    assert sharding.shard_documents(s, none, 16).count() == 0
    assert mixing.mix_documents(s, none, [5, 2, 1]).count() == 0
    assert packing.pack_documents(s, none).count() == 0
    assert language.identify(none, language.fit_centroids(none, F.lit(True))).count() == 0


def test_numbers_and_components(spark):
    s = Scratch(spark)
    rows = numbered(s, spark.range(1000).select((F.col("id") % 3).alias("k")), ["k"], "at").collect()
    assert sorted(r["at"] for r in rows) == list(range(1000))
    assert [r.k for r in sorted(rows, key=lambda r: r["at"])] == sorted(r.k for r in rows)
    chain = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).filter("a <> 30")
    found = {r.node: r.root for r in components(s, chain).collect()}
    assert found == {**dict.fromkeys(range(31), 0), **dict.fromkeys(range(31, 61), 31)}


def test_sharding(spark, awkward):
    for n in (1, 2, 5, 1000):
        p = sharding.Permutation(n, 3)
        assert sorted(p.forward(range(n))) == list(range(n)) and list(p.inverse(p.forward(range(n)))) == list(range(n))
    rows = sharding.shard_documents(Scratch(spark), table(spark, awkward), 4, seed=4).collect()
    again = sharding.shard_documents(Scratch(spark), table(spark, awkward).repartition(7), 4, seed=4).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    data = [(t or "").encode() for _, t, *_ in awkward]
    assert Counter((r.size, r.text_crc32) for r in rows) == Counter((len(b) + 1, zlib.crc32(b)) for b in data)


def test_mixing(spark, awkward):
    rows = mixing.mix_documents(Scratch(spark), table(spark, awkward), [5, 2, 1]).collect()
    again = mixing.mix_documents(Scratch(spark), table(spark, awkward).repartition(5), [5, 2, 1]).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))
    sizes = Counter()
    for _, text, _, source in awkward:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    assert {r.source: r.source_size for r in rows} == dict(sizes)
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: [5, 2, 1][i % 3] for i, s in enumerate(order)}
    target, capped = {}, set()
    while True:  # reshare until no target is above its limit
        rest = 1.5 * sum(sizes.values()) - sum(2.0 * sizes[s] for s in capped)
        level = rest / sum(weight[s] for s in order if s not in capped)
        more = {s for s in order if s not in capped and weight[s] * level > 2 * sizes[s]}
        if not more:
            break
        capped |= more
    target = {s: 2.0 * sizes[s] if s in capped else weight[s] * level for s in order}
    assert {r.source: r.target for r in rows} == pytest.approx(target)
    assert all(r.taken == r.copies * r.size and 0 <= r.copies <= 2 for r in rows)
    for s in order:
        largest = max(r.size for r in rows if r.source == s)
        assert abs(sum(r.taken for r in rows if r.source == s) - target[s]) <= 2 * largest
    mixed = mixing.mixed_rows(Scratch(spark), table(spark, awkward), [5, 2, 1])
    assert mixed.columns == SCHEMA_NAMES
    assert Counter(r.doc_id for r in mixed.collect()) == Counter(r.doc_id for r in rows for _ in range(r.copies))


def test_packing(spark, awkward):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = packing.pack_documents(Scratch(spark), table(spark, awkward)).collect()
    ids = [[*reference.encode(t or "", add_special_tokens=False).ids, 0] for _, t, *_ in awkward]
    expected = Counter()
    for (doc, *_), x in zip(awkward, ids):
        ends = sorted(range(len(x), 0, -2048))  # only the first piece may be shorter
        for number, (k, to) in enumerate(zip([0, *ends], ends)):
            part = b"".join(i.to_bytes(4, "little") for i in x[k:to])
            expected[doc, number, k, to - k, zlib.crc32(part)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in pieces) == expected
    bins = defaultdict(list)
    for r in pieces:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= 1.1 * sum(map(len, ids)) / 2048 + 1


def test_plan_covers_every_length():
    rng = random.Random(1)
    for _ in range(60):
        capacity = rng.choice([7, 30, 100])
        counts = {rng.randint(1, capacity): rng.randint(1, 200) for _ in range(12)}
        plan, n = packing.plan_bins(counts, capacity)
        use, ranks = defaultdict(list), defaultdict(list)
        for length, rank, many, first, offset in plan:
            ranks[length] += range(rank, rank + many)
            for k in range(many):
                use[first + k].append((offset, length))
        assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(v)) for k, v in counts.items()}
        assert sorted(use) == list(range(n))
        for parts in use.values():
            assert sum(x for _, x in parts) <= capacity
            assert len([1 for _, x in parts if 3 * x > capacity]) <= 2


def test_tokenizers_agree():
    pytest.importorskip("public_tokenizers")
    encode = packing.public_encoder("byte_bpe_50k")
    rng = random.Random(5)
    for start in range(0, 0x3000, 64):
        text = " ".join(f"a{chr(c)}1{chr(c)} {chr(c)}{chr(c)}.'s" for c in range(start, start + 64)) + "".join(
            chr(rng.randrange(0x3000)) for _ in range(50)
        )
        assert encode.slow.encode(text, add_special_tokens=False).ids == encode.fast.encode_ordinary(text)
    assert list(encode("<|endoftext|>")) == encode.slow.encode("<|endoftext|>", add_special_tokens=False).ids


def test_substrings(spark):
    rng = random.Random(11)
    passage = prose(rng, 9)
    first, second, clean = prose(rng), prose(rng), prose(rng)
    near = passage.split()
    near[20] = "changed"
    rows = [
        (1, f"{first} {passage}", None, None),
        (2, f"{second} some words {passage} {sentence(rng)}\nLast line here.", None, None),
        (3, clean, None, None), (4, None, None, None), (5, "", None, None), (None, f"{sentence(rng)} {passage}", None, None),
        (6, sentence(rng) + "\n" + " ".join(near), None, None), (7, passage, None, None), (8, "Same. " * 200, None, None),
    ]
    rows.append((9, clean[: len(clean) // 6], None, None))
    found = {r.doc_id: r for r in substrings.remove_repeats(Scratch(spark), table(spark, rows)).collect()}
    assert len(found) == len(rows)
    texts = {i: t for i, t, *_ in rows}
    for kept in (1, 3, 4, 5, 8, 9):
        assert found[kept].text == texts[kept] and found[kept]._removed_words == 0
    middle = " ".join(passage.split()[10:])
    assert middle not in found[2].text and second in found[2].text and found[2].text.endswith("Last line here.")
    assert middle not in found[None].text and found[7].text == ""
    assert " ".join(near[20:]) not in found[6].text and found[6].text


def test_toxicity(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        text = prose(rng, 4)
        if i % 5 == 0:
            text += " vile " + sentence(rng)
        rows.append((i, text, "en", "s"))
        if i < 300:
            labels.append((i, int(i % 7 != 0), int(i % 5 == 0)))
    rows += [(500, None, None, None), (501, "", None, None), (502, "vile", None, None), (None, "vile thing", None, None), (400, "vile", None, None)]
    labels += [(None, 1, 1), (3, None, 0), (4, 1, None)]
    docs = table(spark, rows)
    chain = toxicity.fit_chain(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), toxicity.label_categories())
    scored = toxicity.score_documents(docs, chain)
    assert scored.columns[: len(SCHEMA_NAMES)] == SCHEMA_NAMES and scored.count() == len(rows)
    for r in scored.collect():
        assert (r.p_toxic >= 0.5) == ("vile" in (r.text or "")), r.doc_id
        assert r.text or r.p_toxic == 0.0
    schema = "doc_id long, quality int, toxic int"

    def toxic_with(given, over=docs):
        fitted = toxicity.fit_chain(over, spark.createDataFrame(given, schema), toxicity.label_categories())
        return {(r.doc_id, r.text) for r in toxicity.score_documents(docs, fitted).filter("p_toxic >= 0.5").collect()}

    # without labels, or with one answer only, nothing is toxic; labels without a quality are as good as others
    assert toxic_with([]) == toxic_with([], docs.limit(0)) == set()
    assert toxic_with([(i, q, None) for i, q, _ in labels]) == toxic_with([(i, 1, 1) for i, *_ in labels]) == set()
    vile = {(r.doc_id, r.text) for r in scored.filter("p_toxic >= 0.5").collect()}
    assert toxic_with([(i, None, t) for i, _, t in labels]) == vile
    assert toxic_with([(i, q if i and i % 3 else None, t) for i, q, t in labels]) == vile


def test_language(spark):
    rng = random.Random(4)
    parts = {"aa": ["the", "and", "with", "this", "there"], "bb": ["und", "nicht", "über", "schön", "sich"]}
    rows = [(i, " ".join(rng.choices(parts[la], k=12)), la, "s") for i in range(200) for la in ("aa", "bb")]
    rows += [(900, None, "aa", None), (901, "123 !?", "aa", None), (902, "", "bb", None), (903, "漢字漢字", None, None), (904, "the", None, None)]
    docs = table(spark, rows)
    model = language.fit_centroids(docs, F.col("doc_id") % 3 != 1)
    found = language.identify(docs, model).collect()
    assert len(found) == len(rows)
    for r in found:
        assert 0 <= r._lang_score <= 1
        if r.doc_id in (900, 901, 902):
            assert (r._lang_pred, r._lang_score, r._lang_rejected) == ("und", 0.0, True)
        elif r.doc_id == 903:
            assert r._lang_rejected
        elif r.doc_id < 900:
            assert r._lang_pred == r.lang


PAGE = """<!doctype html><html><head><title>t</title><style>p{{}}</style><script>var a="<p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-banner">We use cookies, ok?</div>{0}
<div id="sidebar"><p>Side story, really.</p></div><section class="comments"><p>I disagree, strongly! And at length, too.</p></section>
<form><p>Sign up, now.</p><input></form><footer>&copy; 2020</footer></body></html>"""


@pytest.mark.parametrize(
    "body",
    [
        "<article><h1>T &amp; U</h1><p>First  long\n paragraph, with commas.<p>Second <b>bold</b> one.<ul><li>item</ul></article>",
        '<div id="content"><h2>T &amp; U</h2><p>First long paragraph, with commas.</p><p>Second <i>bold</i> one.</p><ul><li>item</li></ul></div>',
        "<main><h2>T &amp; U</h2><div>First&nbsp;long paragraph, with commas.</div><p>Second bold one.<aside>x</aside><p>item</main>",
    ],
)
def test_html(body):
    assert main_text(PAGE.format(body)) == "T & U\nFirst long paragraph, with commas.\nSecond bold one.\nitem"


def test_html_edges():
    assert main_text(None) == main_text("") == main_text("<p>") == main_text("<script>x</script>") == ""
    assert main_text("plain 1 < 2") == "plain 1 < 2"
    assert main_text("<div>" * 5000 + "deep") == "deep"
    assert main_text("<p>" + "long word " * 50_000) == ("long word " * 50_000).strip()


def test_html_keeps_all_content():
    long, rest = "A long first part, with marks. " * 17, "The last part, shorter. " * 4
    split = f"<div id=page><h1>T</h1><div>{long}</div><div>{rest}</div></div>"
    assert main_text(split) == "\n".join(["T", long.strip(), rest.strip()])
    articles = f"<main><article><p>{long}</p></article><article><p>{rest}</p></article></main>"
    assert main_text(articles) == "\n".join([long.strip(), rest.strip()])
    outside = f"<main><article><div>{long}</div></article><section><div>{long}More.</div></section></main>"
    assert main_text(outside) == "\n".join([long.strip(), f"{long}More."])


def test_pipeline_matches_its_parts(spark, tmp_path):
    rng = random.Random(6)
    texts = [prose(rng) for _ in range(60)]
    shared = prose(rng, 8)
    rows = [(i, t + (" vile " + sentence(rng) if i % 10 == 0 else ""), "en", f"s{i % 3}") for i, t in enumerate(texts)]
    rows += [(100, texts[1], "en", "s1"), (101, texts[2] + " extra", "en", "s2"), (102, f"{shared} {texts[3][:90]}", "en", "s1"), (103, f"{prose(rng)} {shared}", "en", None)]
    docs = table(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, int(i % 10 == 0)) for i in range(60)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        later = stage(spark, now, str(tmp_path))
        later.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = now.collect()
        if name != "packing":
            assert now.columns == SCHEMA_NAMES
    clean = {i for i, t, *_ in rows if "vile" not in t}
    assert {r.doc_id for r in seen["toxicity"]} == clean
    assert {r.doc_id for r in seen["jaccard_join"]} == clean - {100, 101}
    deduped = {r.doc_id: r.text for r in seen["substring_dedup"]}
    assert " ".join(shared.split()[10:]) in deduped[102] and " ".join(shared.split()[10:]) not in deduped[103]
    assert all(deduped[i] == t for i, t, *_ in rows if i in deduped and i != 103)
    copies = Counter(r.doc_id for r in seen["mixing"])
    assert set(copies) <= set(deduped) and max(copies.values()) <= 2
    assert Counter(r.doc_id for r in seen["packing"] if r.piece == 0) == copies
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter(map(tuple, whole.collect())) == Counter(map(tuple, seen["packing"]))
