"""Operators that compare or place rows, against plain Python versions."""

import random
from collections import Counter

import pytest
from llm_cases import base_counts, changed, dedup, groups, hits, within_one_edit

import corpus_pipeline
from quire.llm import jaccard, line_dedup, quotes, sharding, url_rules
from quire.llm.components import components
from pyspark.sql import functions as F


def test_distance_equals_the_plain_one(spark):
    rnd = random.Random(5)
    rows = []
    for _ in range(600):
        a = "".join(rnd.choice("abé😀") for _ in range(rnd.randint(5, 20)))
        b = a
        for _ in range(rnd.randint(0, 4)):
            b = changed(rnd, b)
        rows.append((a, b if len(b) > 3 else a))
    df = spark.createDataFrame(rows, "a string, b string")
    for limit in (1, 2, 3):
        assert df.where(line_dedup.edit_distance_within(F.col("a"), F.col("b"), limit) != (F.levenshtein("a", "b") <= limit)).count() == 0
    assert within_one_edit("abc", "abd") and within_one_edit("abc", "ac") and not within_one_edit("abc", "cba")


@pytest.mark.parametrize("bucket", [64, 3])
def test_line_dedup_equals_plain_search(spark, monkeypatch, bucket):
    monkeypatch.setattr(line_dedup, "BUCKET", bucket)
    rnd = random.Random(bucket)
    base = ["".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(14, 60))) for _ in range(25)]
    docs = []
    for d in range(120):
        lines = []
        for _ in range(rnd.randint(0, 6)):
            x = rnd.choice(base[:3] if rnd.random() < 0.6 else base)
            for _ in range(rnd.choice([0, 1, 1, 2])):
                x = changed(rnd, x)
            lines.append(rnd.choice(["", " ", "\t"]) + x)
            if rnd.random() < 0.1:
                lines.append(rnd.choice(["", "short", "  "]))
        docs.append((d, "\n".join(lines) if d % 37 else None))
    got = dict(line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id", "text").collect())
    assert [got[d] for d, _ in docs] == dedup(docs, line_dedup.MIN_CHARS)


@pytest.mark.parametrize("size,percent,bucket", [(4, 85, 64), (5, 80, 64), (4, 85, 2), (2, 50, 3)])
def test_jaccard_equals_plain_search(spark, monkeypatch, size, percent, bucket):
    monkeypatch.setattr(jaccard, "BUCKET", bucket)
    monkeypatch.setattr(jaccard, "BLOCK", 40_000 if bucket > 2 else 150)
    rnd = random.Random(percent + bucket)
    word = lambda: f"w{rnd.randint(0, 3000)}"
    passage = [word() for _ in range(30)]
    docs = []
    for _ in range(14):
        core = [word() for _ in range(rnd.choice([0, 1, 3, 4, 8, 15, 40, 120, 300]))]
        if rnd.random() < 0.5:
            core = core + passage
        for _ in range(rnd.randint(1, 7)):
            w = list(core)
            for _ in range(rnd.choice([0, 1, 1, 2, 3])):
                if w:
                    kind, p = rnd.random(), rnd.randrange(len(w))
                    w[p : p + 1] = [word()] if kind < 0.5 else [] if kind < 0.75 else [word(), w[p]]
            docs.append((len(docs), rnd.choice([" ", "\n"]).join(w).upper() if rnd.random() < 0.2 else " ".join(w)))
    rows = jaccard.similar_groups(spark.createDataFrame(docs, "doc_id long, text string"), size, percent).collect()
    want = groups(docs, size, percent)
    assert {r["doc_id"]: r["component_id"] for r in rows} == want and len(rows) == len(docs)
    assert len(set(want.values())) < len(docs)


def test_budget_is_the_largest_difference():
    for percent in (50, 80, 85):
        for a in range(1, 60):
            for b in range(a, a * 100 // percent + 1):
                best = max((a + b - 2 * o for o in range(a + 1) if 100 * o >= percent * (a + b - o)), default=0)
                assert jaccard.budget(a + b, percent) == best
    plans = jaccard.Schemes(85)
    for a in range(1, 400):
        for b in range(a, a * 100 // 85 + 1):
            shared = {k for k, _, _ in plans.of(a)} & {k for k, _, _ in plans.of(b)}
            met = [k for k in shared if all(dict((x, y) for x, _, y in plans.of(n))[k] >= jaccard.budget(a + b, 85) for n in (a, b))]
            assert met, (a, b)


def test_components(spark):
    rnd = random.Random(9)
    edges = [(i, i + 1) for i in range(100, 140)] + [(rnd.randint(0, 60), rnd.randint(0, 60)) for _ in range(40)] + [(5, 5), (-3, 200)]
    root = {}
    for u, v in edges:
        root.setdefault(u, u), root.setdefault(v, v)
    for _ in range(200):
        for u, v in edges:
            root[u] = root[v] = min(root[u], root[v])
    got = dict(components(spark.createDataFrame(edges, "u long, v long")).distinct().collect())
    assert got == {k: v for k, v in root.items() if k in got} and {k for k in root if k not in got} <= {k for k in root if root[k] == k}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_shards_are_even_and_keep_groups(spark):
    rnd = random.Random(3)
    texts = [f"text {rnd.randint(0, 10**9)}" for _ in range(700)] + ["hot"] * 400 + [f"pair {i // 3}" for i in range(93)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = sharding.op4_sharding(docs).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    counts = Counter(r["shard"] for r in rows)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for s, n in counts.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n))
    at = {}
    for r in rows:
        at.setdefault(texts[r["doc_id"]], Counter())[r["shard"]] += 1
    assert sum(len(c) > 1 for t, c in at.items() if t.startswith("pair")) <= 3
    assert max(at["hot"].values()) >= 90 and all(r["size"] == len(texts[r["doc_id"]]) + 1 for r in rows)


def test_few_rows_for_many_shards(spark):
    rows = sharding.op4_sharding(spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "doc_id long, text string")).collect()
    assert len({r["shard"] for r in rows}) == 3 and {r["slot"] for r in rows} == {0}


def test_url_rules(spark):
    bad = [(f"https://www.spam{i % 3}.example.net/x/{i}?buy=1", True) for i in range(40)]
    good = [(f"https://www.site{i % 7}.example.net/x/{i}", False) for i in range(200)]
    urls = [u for u, _ in bad + good] + ["http://A.EXAMPLE.org/es/1", "http://b.org", "http://b.org/", "http://x.com/de/1?q", "http://y.com/fr/", "http://example.orgx/es/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r for r in url_rules.judge_urls(pages, spark.createDataFrame(bad + good, "url string, bad boolean")).collect()}
    assert all(got[i]["verdict"] == ("block" if i < 40 else "allow") for i in range(240))
    assert [got[240 + i]["rule"] for i in range(6)] == ["example.org/es/", None, "org/", "com/de/", "com/fr/", None]
    assert [got[240 + i]["verdict"] for i in range(5)] == ["block", "allow", "allow", "block", "allow"]


def test_url_rules_on_later_segments_keys_and_words(spark):
    bad = [f"https://h{i % 19}.net/en/{i}/blog/casino/{i}" for i in range(20)] + [f"https://h{i % 19}.net/en/{i}?id={i}&aff=x" for i in range(20)]
    bad += [f"https://h{i % 19}.net/en/{i}/best-pills-{i}" for i in range(20)] + [f"https://h{i % 19}.net/en/{i}?sort=a&page={i}" for i in range(20)]
    bad += [f"https://h{i % 19}.cheap-{i}.net/en/{i}" for i in range(20)]
    good = [f"https://h{i % 19}.net/en/{1000 + i}{('', '/blog/news', '?id=1&ref=x', '/best-news', '?sort=b')[i % 5]}" for i in range(400)]
    for known, free in ((good, 400), (good[:60], 60)):  # in the second more than half of the labels are bad
        labelled = spark.createDataFrame([(u, True) for u in bad] + [(u, False) for u in known], "url string, bad boolean")
        pages = spark.createDataFrame(list(enumerate(bad + known)), "page_id long, url string")
        got = {r["page_id"]: r["verdict"] for r in url_rules.judge_urls(pages, labelled).collect()}
        assert [got[i] for i in range(100)] == ["block"] * 100 and sum(got[100 + i] == "allow" for i in range(free)) == free


def test_url_rules_equal_all_sets(spark):
    from itertools import combinations, product

    rnd = random.Random(5)
    rows = []
    for _ in range(300):
        t = [x for x in "abcdefg" if rnd.random() < 0.45] + ["z"]
        rows.append((t + (["a2"] if "a" in t else []), {"a", "c"} <= set(t) or rnd.random() < 0.15))
    n, nbad = len(rows), sum(b for _, b in rows)
    count = {}
    for t, b in rows:
        for k in range(1, len(t) + 1):
            for x in combinations(sorted(t), k):
                c = count.setdefault(frozenset(x), [0, 0])
                c[0] += 1
                c[1] += b
    floor = url_rules.confidence_floor(n, nbad)
    ok = {x for x, (f, b) in count.items() if b >= 5 and b >= floor * f}
    want = {x for x in ok if not any(y < x for y in ok)}
    rules, known = url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean"))
    tokens_of = {}
    for r in known.collect():
        tokens_of.setdefault(r["item"], []).append(r["t"])
    assert sorted(map(sorted, (ts for ts in tokens_of.values() if len(ts) > 1))) == [["a", "a2"]]
    kept = [r["items"] for r in rules.collect()]
    got = [frozenset(x) for items in kept for x in product(*(tokens_of[i] for i in items))]
    assert want and len(got) == len(want) and set(got) == want and len(kept) < len(want)
    # Both ways of matching agree with the rules.
    pages = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "page_id long, tokens array<string>")
    hit = [any(x <= set(t) for x in want) for t, _ in rows]
    for sent in (url_rules.SENT_ROWS, 0):
        assert [r["_hit"] for r in url_rules.with_hits(pages, rules, known, sent).orderBy("page_id").collect()] == hit


def test_url_rules_equal_their_sql_where_rules_exist(spark, tmp_path):
    import duckdb

    rnd = random.Random(8)
    pages, labels = [], []
    for i in range(700):
        spam = rnd.random() < 0.3
        host = f"{rnd.choice(['www', 'm', 'blog'])}.h{rnd.randrange(9)}.{rnd.choice(['net', 'info'])}"
        tail = rnd.choice(["", "?ref=x", "?page=2&ref=x", "#top"]) + ("/Casino" if spam and rnd.random() < 0.5 else "")
        pages.append((i, f"https://{host}/{rnd.choice(['en', 'it'])}/{i}{tail}"))
        labels.append((i, int(not (spam or (host.startswith("m.") and "info" in host)))))
    pages += [(701, None), (702, "none"), (3, pages[3][1])]
    p = spark.createDataFrame(pages, "page_id long, url string")
    q = spark.createDataFrame(labels, "doc_id long, quality int")
    got = sorted(tuple(r) for r in url_rules.op8_url_rules(p, q).collect())
    con = duckdb.connect()
    p.write.parquet(f"{tmp_path}/pages")
    q.write.parquet(f"{tmp_path}/labels")
    for t in ("pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}/*.parquet'")
    want = sorted(tuple(r) for r in con.execute(url_rules.ORACLE).fetchall())
    assert got == want and 20 < sum(r[4] == "block" for r in got) < 500


def test_quotes(spark):
    rows = [
        (1, 0, "user", "Hello there my friend\nHow are you doing today?"),
        (1, 1, "assistant", "> How are you doing today?\nI am fine, thanks a lot."),
        (1, 2, "user", "> > How are you doing today?\n> I am fine, thanks a lot.\nGood to hear that."),
        (1, 3, "user", "A new thread begins here."),
        (1, 4, "assistant", "> Hello there  MY friend\n> How are you doing today?\nLate answer."),
        (1, 5, "user", "> A new thread begins here.\nAnswer to new."),
        (2, 0, "user", "> A new thread begins here.\ncross quote"),
        (2, 1, "user", "> never written by anyone\nbody"),
    ]
    got = {(r["conv_id"], r["turn"]): r for r in quotes.reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    order = sorted((r["position"], k[1]) for k, r in got.items() if k[0] == 1)
    assert [t for _, t in order] == [0, 1, 2, 4, 3, 5]
    assert [got[1, t]["reply_turn"] for t in range(6)] == [None, 0, 1, None, 0, 3] and [got[1, t]["depth"] for t in range(6)] == [0, 1, 2, 0, 1, 1]
    assert got[1, 2]["text"] == "Good to hear that." and got[2, 1]["text"] == "> never written by anyone\nbody"
    assert (got[2, 0]["reply_conv"], got[2, 0]["reply_turn"], got[2, 0]["depth"]) == (1, 3, 0)


def test_quotes_of_several_lines_from_the_middle(spark):
    five = "first line of it\nsecond line of it\nok\nfourth line of it\nfifth line of it"
    paragraphs = "one paragraph of\ntwo lines\n\nsecond paragraph here\n\nthird paragraph here"
    rows = [
        (1, 0, "u", five),
        (1, 1, "a", "> second line of it\n> ok\nmiddle of five"),
        (1, 2, "u", paragraphs),
        (1, 3, "a", "> one paragraph of two\n> lines\n>\n> second paragraph here\ntwo of three"),
        (1, 4, "u", "> first line of it\nanswer part one\nanswer part two\n> fifth line of it\nlast own words"),
        (1, 5, "a", "> answer part one\n> answer part two\nto the inline answer"),
        (1, 6, "u", "> fourth line of it\n> written by nobody\n>\n> fifth line of it\npartly known"),
        (1, 7, "a", "> ok\n> nothing else known\ntoo short"),
        (2, 0, "u", "> fourth line of it\n> fifth line of it\nelsewhere"),
        (3, 0, "u", "a\nb\nc\nd\ne\nf\ng"),
        (3, 1, "a", "> b\n> c\n> d\n> e\n> f\nshort lines"),
    ]
    got = {(r["conv_id"], r["turn"]): r for r in quotes.reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    want = {
        (1, 1): (1, 0, 1, "middle of five"), (1, 3): (1, 2, 1, "two of three"), (1, 5): (1, 4, 1, "to the inline answer"),
        (1, 4): (1, 0, 2, "answer part one\nanswer part two\nlast own words"), (1, 6): (1, 0, 1, "> written by nobody\n> \npartly known"),
        (1, 7): (None, None, 0, "> ok\n> nothing else known\ntoo short"), (2, 0): (1, 0, 1, "elsewhere"), (3, 1): (3, 0, 1, "short lines"),
    }
    assert {k: (got[k]["reply_conv"], got[k]["reply_turn"], got[k]["n_linked"], got[k]["text"]) for k in want} == want
    assert got[1, 5]["depth"] == 2 and got[1, 5]["thread_turn"] == 0


def test_long_reply_chain(spark):
    words = [f"message number {i} says {i * 7919 % 1000}" for i in range(70)]
    rows = [(1, i, "user", (f"> {words[i - 1]}\n" if i else "") + words[i]) for i in range(70)]
    got = sorted(quotes.reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect(), key=lambda r: r["position"])
    assert [r["turn"] for r in got] == list(range(70)) and [r["depth"] for r in got] == list(range(70)) and {r["thread_turn"] for r in got} == {0}


def test_pipeline_equals_plain_version(spark, tmp_path):
    rnd = random.Random(11)
    word = lambda: f"w{rnd.randint(0, 2000)}"
    item = " ".join(word() for _ in range(14))
    docs = []
    for i in range(90):
        lines = [" ".join(word() for _ in range(rnd.randint(5, 25))) for _ in range(rnd.randint(1, 7))]
        if i % 5 == 0 and docs:
            lines = docs[rnd.randrange(len(docs))][1].split("\n")
            p = rnd.randrange(len(lines))
            lines[p] = lines[p] + " " + word() + " " + word()
        if i % 11 == 0:
            lines.insert(0, item)
        docs.append((i, "\n".join(lines), "en", "s", 0))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    left = [(d, t) for d, t, *_ in docs if not ((c := base_counts(t))[0] < 50 or 100 * c[4] > 50 * c[0])]
    left = [(d, t) for (d, _), t in zip(left, dedup(left, line_dedup.MIN_CHARS), strict=True) if t.strip()]
    root = groups(left, 5, 80)
    left = [(d, t) for d, t in left if root[d] == d and not hits(t, [(1, item)])[1]]
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted(got) == [d for d, _ in left] and 0 < len(left) < 60
    import hashlib

    assert all(got[d]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest() for d, t in left)
