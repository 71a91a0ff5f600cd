"""URL verdicts: fixed rules first, else association rules mined from labelled URLs.

A URL becomes a set of tokens: scheme, host and its last parts, first directory, depth, file ending, first query key and
fragment; every part of the host, every path segment, every query key and every key with its value, wherever they
stand; and the words in host and path. Spark's FP-growth mines the token sets that occur often together with a bad label; a
set is a rule if its confidence is high enough, in itself and over the share of bad labels, and no smaller rule lies in it. An
inverted index from the rarest token of a rule to the rule decides the rest.

Support and pruning bound the sets, not the number of tokens. Tokens that occur in exactly the same labelled URLs are one item,
named by the first of them, so they do not multiply; a token that is a rule alone, or stands in every URL, is not mined
further, since no minimal rule holds it. FP-growth still lists every frequent combination of the other items, which doubles
with each item that always comes with another one; the distinct items of a URL are about ten. Sets, rules and the pruning stay
on Spark; the rules are sent to the tasks only within a counted size, else joined by their anchor.

Defined cases: a null URL or one without ``://`` has an empty host and path, fits no fixed rule and has no tokens, so it is
allowed; a host keeps its port and user part; of several fitting fixed rules the longest counts; repeated rows get the same
verdict; labels that name no page, null labels and duplicates (bad only if every label says so) are settled before
mining; without labels nothing is mined. Only ids and URLs are read from the pages.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import bounded, broadcast_checked, materialize
from quire.session import ship_by_value

#: Fixed verdicts: verdict, host, path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
MIN_SUPPORT = 0.002
MIN_COUNT = 5
#: Rules, and tokens that stand for their items, that are sent to the tasks; more are joined.
SENT_ROWS = 200_000
#: The item that marks a bad URL among the tokens; no token is empty.
LABEL = ""
MIN_CONFIDENCE = 0.5
MIN_LIFT = 2.0
#: The floor of lift stays below this, or half way to 1 where more of the labels are bad, so that rules stay possible.
MAX_FLOOR = 0.9
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def url_parts(url: Column) -> Column:
    """Struct of ``host`` and ``path``; both empty without ``://``."""
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.struct(lower_ascii(host).alias("host"), path.alias("path"))


def fixed_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as a struct of ``rule`` and ``verdict``; null if none fits."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


#: The tokens with one place in a URL, in SQL that both engines read; u: url, host, path.
TOKENS_SQL = (
    "concat('scheme=', lower(split_part(u, '://', 1)))",
    "concat('host=', host)",
    "concat('top=', regexp_extract(host, '([^.]*)$', 1))",
    "concat('site=', regexp_extract(host, '([^.]*[.][^.]*)$', 1))",
    "concat('sub=', split_part(host, '.', 1))",
    "concat('dir=', split_part(path, '/', 2))",
    "concat('depth=', length(path) - length(replace(path, '/', '')))",
    "concat('end=', regexp_extract(path, '([.][a-zA-Z]*)$', 1))",
    "concat('key=', regexp_extract(u, '[?]([^=&#]*)', 1))",
    "CASE WHEN u LIKE '%#%' THEN 'mark' ELSE 'no mark' END",
)


def spread_tokens(u: Column, host: Column, path: Column) -> Column:
    """The tokens that count wherever they stand: host parts, path segments, query keys and values, words."""

    def named(name: str, parts: Column) -> Column:
        return F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(name + "="), x))

    fields = F.split(F.regexp_extract(u, r"[?]([^#]*)", 1), "[&;]", -1)
    words = F.regexp_extract_all(lower_ascii(F.concat(host, F.lit("/"), path)), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    return F.concat(
        named("part", F.split(host, "[.@:]", -1)), named("seg", F.split(path, "/", -1)),
        named("arg", F.transform(fields, lambda x: F.regexp_extract(x, "^[^=]*", 0))), named("val", F.filter(fields, lambda x: x.contains("="))),
        named("word", words),
    )


def with_tokens(pages: DataFrame) -> DataFrame:
    """Add ``tokens`` (distinct; empty without a host) to rows with ``u``, ``host`` and ``path``."""
    tokens = F.concat(F.expr(f"array({', '.join(TOKENS_SQL)})"), spread_tokens(F.col("u"), F.col("host"), F.col("path")))
    return pages.withColumn("tokens", F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(F.array_distinct(tokens)))


def confidence_floor(n: int, bad: int) -> float:
    """The least confidence of a rule, below 1 while any label is good."""
    share = bad / n
    return max(MIN_CONFIDENCE, min(MIN_LIFT * share, max(MAX_FLOOR, (1 + share) / 2)))


def mine(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rules and items from rows with ``tokens`` and boolean ``bad``.

    Rules are rows of ``items`` (sorted, minimal sets); items are rows of (``t``, ``item``): the token and the item it counts
    as. Both are empty with fewer than ``MIN_COUNT`` bad rows.
    """
    rows = labelled.where(F.size("tokens") > 0).select("tokens", "bad", F.monotonically_increasing_id().alias("_r"))
    rows = materialize(rows, "url-items")
    totals = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("bad")).first()
    n, bad = totals["n"], totals["bad"]
    if bad < MIN_COUNT:
        none = rows.limit(0)
        return none.select(F.col("tokens").alias("items")), none.select(F.lit("").alias("t"), F.lit("").alias("item"))
    least = math.ceil(max(MIN_SUPPORT, (MIN_COUNT - 0.5) / n) * n)
    floor = confidence_floor(n, bad)
    known = _items(rows, least)
    alone = F.col("both") >= floor * F.col("freq")
    single = known.where(alone).select(F.array("item").alias("items")).distinct()
    open_ = known.where(~alone & (F.col("freq") < n)).select("t", "item")
    coded = rows.select("_r", "bad", F.explode("tokens").alias("t")).join(broadcast_checked(open_), "t")
    coded = coded.groupBy("_r", "bad").agg(F.collect_set("item").alias("items"))
    coded = materialize(coded.select(F.when(F.col("bad"), F.concat("items", F.array(F.lit(LABEL)))).otherwise(F.col("items")).alias("items")), "url-sets")
    m = coded.count()
    rules = single
    if m >= least:
        # Half below the count, so that rounding cannot move the limit.
        sets = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / m).fit(coded).freqItemsets
        rules = single.unionByName(_minimal(_confident(materialize(sets, "url-frequent"), floor)))
    return materialize(rules, "url-rules"), known.select("t", "item")


def _items(rows: DataFrame, least: int) -> DataFrame:
    """Tokens with enough bad URLs: t, freq, both, item. Tokens of the same URLs share an item, the first of them."""
    seen = rows.select("bad", F.explode("tokens").alias("t"), F.xxhash64("tokens").alias("_a"), F.xxhash64("tokens", F.lit(1)).alias("_b"))
    sums = [F.sum(F.col(c).cast("decimal(28,0)")).alias(c) for c in ("_a", "_b")]  # 128 bits name the set of URLs
    counts = seen.groupBy("t").agg(F.count(F.lit(1)).alias("freq"), F.sum(F.col("bad").cast("long")).alias("both"), *sums).where(F.col("both") >= least)
    same = Window.partitionBy("freq", "both", "_a", "_b")  # all of them stand in one URL
    return materialize(counts.select("t", "freq", "both", F.min("t").over(same).alias("item")), "url-tokens")


def _confident(sets: DataFrame, floor: float) -> DataFrame:
    """Frequent sets of two and more items whose share of bad URLs reaches the floor."""
    marked = F.array_contains("items", LABEL)
    key = F.array_sort(F.array_remove("items", LABEL)).alias("items")
    both = sets.where(marked & (F.size("items") > 2)).select(key, F.col("freq").alias("both"))
    every = sets.where(~marked & (F.size("items") > 1)).select(key, "freq")
    return materialize(both.join(every, "items").where(F.col("both") >= floor * F.col("freq")).select("items"), "url-confident")


def anchored(rules: DataFrame) -> DataFrame:
    """Add ``anchor``: the item of a rule that the fewest rules use."""
    parts = rules.select("items", F.explode("items").alias("t"))
    uses = parts.groupBy("t").agg(F.count(F.lit(1)).alias("_n"))
    return parts.join(uses, "t").groupBy("items").agg(F.min(F.struct("_n", "t"))["t"].alias("anchor"))


def _minimal(rules: DataFrame) -> DataFrame:
    """Rules without a smaller rule inside: candidates meet on the anchor of the smaller one."""
    small = anchored(rules).select(F.col("items").alias("_small"), F.col("anchor").alias("t"))
    large = rules.select("items", F.explode("items").alias("t"))
    inside = (F.size("_small") < F.size("items")) & (F.size(F.array_except("_small", "items")) == 0)
    return rules.join(large.join(small, "t").where(inside).select("items").distinct(), "items", "left_anti")


def with_hits(rows: DataFrame, rules: DataFrame, known: DataFrame, sent: int = SENT_ROWS) -> DataFrame:
    """Add ``_hit``: whether the items of the row's ``tokens`` hold a rule. Small rule sets are sent, larger ones joined."""
    used = rules.select(F.explode("items").alias("item")).distinct()
    known = materialize(known.join(used, "item", "left_semi"), "url-used")
    index = materialize(anchored(rules), "url-anchors")
    if not bounded(index, sent) or not bounded(known, sent):
        return _joined_hits(rows, index, known)
    ship_by_value(__name__)
    lists: dict[str, list[list[str]]] = {}
    for r in index.collect():  # at most ``sent`` rows
        lists.setdefault(r["anchor"], []).append([t for t in r["items"] if t != r["anchor"]])
    shared = rows.sparkSession.sparkContext.broadcast((lists, {r["t"]: r["item"] for r in known.collect()}))

    @F.pandas_udf("boolean")
    def hit(column: pd.Series) -> pd.Series:
        rests, item_of = shared.value

        def one(row) -> bool:
            have = {item_of[t] for t in row if t in item_of}
            return any(all(t in have for t in rest) for t in have for rest in rests.get(t, ()))

        return column.map(one).astype(bool)

    return rows.withColumn("_hit", hit("tokens") if lists else F.lit(False))


def _joined_hits(rows: DataFrame, index: DataFrame, known: DataFrame) -> DataFrame:
    """The same by joins: items of distinct token lists, rules by their anchor."""
    held = rows.select("tokens").distinct().select("tokens", F.explode("tokens").alias("t")).join(known, "t")
    held = held.groupBy("tokens").agg(F.collect_set("item").alias("_have"))
    met = held.select("tokens", "_have", F.explode("_have").alias("anchor")).join(index, "anchor")
    found = met.where(F.size(F.array_except("items", "_have")) == 0).select("tokens").distinct().withColumn("_hit", F.lit(True))
    return rows.join(found, "tokens", "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))


def judge_urls(pages: DataFrame, labelled: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every page.

    ``labelled`` holds ``url`` and boolean ``bad``.
    """

    def cut(df: DataFrame, *more: Column) -> DataFrame:
        rows = df.select(*more, F.col(url).alias("u")).withColumn("_p", url_parts(F.col("u")))
        return with_tokens(rows.select("*", "_p.host", "_p.path").drop("_p"))

    rules, known = mine(cut(labelled, F.col("bad")))
    rows = with_hits(cut(pages, F.col(page_id).alias("page_id")), rules, known).withColumn("_rule", fixed_rule(F.col("host"), F.col("path")))
    mined = F.when(F.col("_hit"), "block").otherwise("allow")
    return rows.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", mined).alias("verdict"))


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """URLs with the label of the document whose number stands in the path (``/en/7817`` is document 7817)."""
    number = F.regexp_extract(url_parts(F.col("url"))["path"], "/([0-9]{1,18})", 1)
    bad = labels.where("quality IS NOT NULL").groupBy(F.col("doc_id").alias("_d")).agg((F.max("quality") == 0).alias("bad"))
    named = pages.select("url", F.when(number != "", number.cast("long")).alias("_d")).where("_d IS NOT NULL")
    return named.join(bad, "_d").select("url", "bad")


def op8_url_rules(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Verdict per page, mined from the quality labels of the documents that the URLs name."""
    return judge_urls(pages, labelled_urls(pages, labels))


_FITS = "WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN "
_BY_LENGTH = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
_RULE = "CASE " + " ".join(_FITS.format(h=h, p=p) + f"'{h + p}'" for _, h, p in _BY_LENGTH) + " END"
_VERDICT = "CASE " + " ".join(_FITS.format(h=h, p=p) + f"'{v}'" for v, h, p in _BY_LENGTH) + " END"
_SPREAD_SQL = tuple(
    f"list_transform(list_filter({parts}, lambda x: x <> ''), lambda x: '{name}=' || x)"
    for name, parts in (
        ("part", "regexp_split_to_array(host, '[.@:]')"), ("seg", "string_split(path, '/')"), ("arg", "list_transform(fields, lambda x: regexp_extract(x, '^[^=]*'))"),
        ("val", "list_filter(fields, lambda x: contains(x, '='))"), ("word", r"regexp_extract_all(low, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"),
    )
)
ORACLE = f"""WITH p0 AS (SELECT row_number() OVER () AS rid, page_id, url AS u, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
 p AS (SELECT rid, page_id, u, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p0),
 q AS (SELECT *, translate(host || '/' || path, '{_UPPER}', '{_LOWER}') AS low, regexp_split_to_array(regexp_extract(u, '[?]([^#]*)', 1), '[&;]') AS fields FROM p),
 t AS (SELECT rid, page_id, host, path, CASE WHEN host = '' THEN [] ELSE list_distinct(list_concat([{', '.join(TOKENS_SQL)}], {', '.join(_SPREAD_SQL)})) END AS tokens FROM q),
 lb AS (SELECT doc_id, max(quality) = 0 AS bad FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
 lt AS (SELECT t.rid, tokens, bad FROM t JOIN lb ON TRY_CAST(regexp_extract(path, '/([0-9]{{1,18}})', 1) AS BIGINT) = lb.doc_id WHERE len(tokens) > 0),
 tot AS (SELECT count(*) AS n, count(*) FILTER (bad) AS nbad FROM lt),
 li AS (SELECT n, nbad, ceil(greatest({MIN_SUPPORT}, ({MIN_COUNT} - 0.5) / n) * n) AS low, greatest({MIN_CONFIDENCE}, least({MIN_LIFT} * (nbad / n), greatest({MAX_FLOOR}, (1 + nbad / n) / 2))) AS floor_ FROM tot WHERE nbad >= {MIN_COUNT}),
 tk AS (SELECT rid, bad, unnest(tokens) AS tok FROM lt),
 k0 AS (SELECT tok, count(*) AS freq, count(*) FILTER (bad) AS both_, list(rid ORDER BY rid) AS cover FROM tk GROUP BY tok),
 kn AS (SELECT tok, freq, both_, min(tok) OVER (PARTITION BY cover) AS item FROM k0, li WHERE both_ >= low),
 mi AS (SELECT tok, item FROM kn, li WHERE both_ < floor_ * freq AND freq < n),
 co AS (SELECT rid, bad, list_sort(list_distinct(list(item))) AS items FROM tk JOIN mi USING (tok) GROUP BY rid, bad),
 sb AS (SELECT items, unnest(range(1, 1 << len(items))) AS m FROM co WHERE bad),
 cb AS (SELECT list_filter(items, lambda x, i: (m >> (i - 1)) & 1 = 1) AS k, count(*) AS both_ FROM sb GROUP BY 1),
 cf AS (SELECT k, both_, count(*) AS freq FROM cb JOIN li ON both_ >= low JOIN co ON list_has_all(items, k) GROUP BY k, both_),
 r AS (SELECT k FROM cf, li WHERE both_ >= floor_ * freq UNION ALL SELECT DISTINCT [item] FROM kn, li WHERE both_ >= floor_ * freq),
 pt AS (SELECT rid, unnest(tokens) AS tok FROM t),
 pi AS (SELECT rid, list_distinct(list(item)) AS have FROM pt JOIN kn USING (tok) GROUP BY rid),
 hit AS (SELECT DISTINCT rid FROM pi JOIN r ON list_has_all(have, k))
SELECT page_id, host, path, {_RULE} AS rule, coalesce({_VERDICT}, CASE WHEN hit.rid IS NULL THEN 'allow' ELSE 'block' END) AS verdict FROM t LEFT JOIN hit USING (rid)"""
