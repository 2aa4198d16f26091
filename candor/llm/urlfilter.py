"""URL filters: association rules over URL tokens, behind explicit host and path rules.

Explicit rules come first: a rule fits its host and all subdomains of it where the URL's path starts with the rule's,
and the longest fitting rule decides. All other URLs are judged by learned rules. Labelled URLs become transactions of
their tokens (labels of the host, path segments, query names) and their label. Tokens of exactly the same URLs are mined
as one item. FP-growth finds the token sets that are frequent among bad URLs; each is recounted on the whole transactions,
and those whose confidence and support towards the bad label suffice become blocking rules. A rule that
contains another of no less confidence is dropped. Rules are posted under their rarest token; a URL looks up its own
tokens there and checks the rest of each rule found.

Everything is DataFrame expressions and Spark's own FP-growth.

Defined cases
* null url, or none with `://`: host and path empty, no explicit rule, no tokens, verdict allow.
* null or empty path: no explicit rule fits, since their paths begin with a slash.
* conflicting labels of one id: bad if any is. Null labels count as good (quality) and not toxic.
* no labelled URL, fewer than LEAST_URLS bad ones, or no rule good enough: everything without an explicit rule is allowed.
* repeated rows: each is judged. Result columns replace input columns of the same name; other columns pass through.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, lower_ascii, sized_broadcast, text_key, written

#: verdict, host, path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Share of labelled URLs that a rule's tokens and label hold together, and share of bad ones among those with its tokens.
SUPPORT = 0.002
CONFIDENCE = 0.6
#: And how many labelled bad URLs it takes at least, so that a rule is never a memory of a few URLs.
LEAST_URLS = 5
#: Tokens of a rule. A longer rule adds something only where none of its parts reaches its confidence, and its URLs are a
#: part of theirs; the sets to recount grow with this power of a URL's tokens.
MAX_TOKENS = 3
#: Items that the miner is given at a time; a URL with more is given in overlapping parts.
BASKET = 12


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def explicit(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The rule that decides, as host and path joined, and its verdict; null if none fits."""
    rule = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def tokens(url: Column) -> Column:
    """Distinct tokens: h:label of the host, p:path segment, q:query name."""
    text = F.coalesce(url, F.lit(""))
    host, path = F.split(host_of(url), r"\."), F.split(path_of(url), "/")
    query = F.split(F.regexp_extract(text, r"(?s)^[^#]*?\?([^#]*)", 1), "&")
    made = F.concat(
        F.transform(F.filter(host, lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x)),
        F.transform(F.filter(path, lambda x: x != ""), lambda x: F.concat(F.lit("p:"), lower_ascii(x))),
        F.transform(F.filter(query, lambda x: x != ""), lambda x: F.concat(F.lit("q:"), lower_ascii(F.substring_index(x, "=", 1)))),
    )
    return F.array_distinct(F.when(F.contains(text, F.lit("://")), made).otherwise(F.array().cast("array<string>")))


def mine(pages: DataFrame, labels: DataFrame, *, id_col: str = "page_id", url_col: str = "url", support: float = SUPPORT, confidence: float = CONFIDENCE, least_urls: int = LEAST_URLS, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Blocking rules: rule (sorted tokens), confidence, support; written to the shared folder."""
    bad = ((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).cast("int")
    known = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(bad).alias("_bad"))
    marked = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url")).join(sized_broadcast(known, 24), "_id")
    baskets = marked.select(F.monotonically_increasing_id().alias("row"), tokens(F.col("_url")).alias("tokens"), "_bad").filter((F.size("tokens") > 0) | (F.col("_bad") == 1))
    baskets = written(baskets, "url-baskets")
    rows, bads = baskets.agg(F.count(F.lit(1)), F.coalesce(F.sum("_bad"), F.lit(0))).first()
    least = next(k for k in count(max(1, least_urls, int(support * rows) - 1)) if k >= support * rows or k / rows >= support)
    if bads < least:
        return pages.sparkSession.createDataFrame([], "rule array<string>, confidence double, support double")
    told = baskets.select("row", "_bad", F.explode("tokens").alias("token"))
    classes = written(_classes(told, least), "url-classes")
    mixed = classes.filter("n > bad").select(F.col("item").alias("token"))
    own = told.join(sized_broadcast(mixed, 40, F.octet_length("token")), "token").groupBy("row", "_bad").agg(F.array_sort(F.collect_list("token")).alias("items"))
    own = written(own.select("_bad", "items"), "url-items")
    folded = written(own.groupBy("items").agg(F.count(F.lit(1)).alias("n"), F.sum("_bad").alias("bad")), "url-folded")
    # an item of bad URLs alone is a rule that every larger one would be dropped for
    found = _recounted(_candidates(own, least, max_tokens), folded).unionByName(classes.filter("n = bad").select(F.array("item").alias("rule"), "n", "bad"))
    good = found.select("rule", (F.col("bad") / F.col("n")).alias("confidence"), (F.col("bad") / F.lit(rows)).alias("support"), "bad")
    good = written(good.filter((F.col("bad") >= least) & (F.col("confidence") >= confidence)).drop("bad"), "url-rules")
    shorter = good.select(F.col("rule").alias("_part"), F.col("confidence").alias("_least"))
    # a rule has at most 2^max_tokens - 2 proper parts, which are looked up by equality
    parts = good.select("rule", "confidence", F.explode(_parts(F.col("rule"), max_tokens)).alias("_part"))
    covered = parts.join(shorter, "_part").filter("_least >= confidence").select("rule").distinct()
    return written(_spelled(good.join(covered, "rule", "left_anti"), classes, max_tokens), "url-rules")


def _classes(told: DataFrame, least: int) -> DataFrame:
    """Tokens of at least `least` bad URLs, those of exactly the same URLs as one item: item (the first), members, n, bad."""
    same = [F.bit_xor(F.xxhash64("row", F.lit(k))) for k in (1, 2)]  # 128 bits that stand for the set of URLs
    stats = told.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum("_bad").alias("bad"), same[0].alias("x"), same[1].alias("y")).filter(F.col("bad") >= least)
    return stats.groupBy("n", "bad", "x", "y").agg(F.min("token").alias("item"), F.collect_list("token").alias("members")).select("item", "members", "n", "bad")


def _candidates(own: DataFrame, least: int, max_tokens: int) -> DataFrame:
    """rule: every set of at most max_tokens items that at least `least` bad URLs hold, and maybe more sets.

    Frequent sets double with every item that URLs share. So a basket over BASKET items goes to the miner as the unions
    of max_tokens of its slices: each small set is in one of them, and in several at most counts too often.
    """
    width = max(1, BASKET // max_tokens)
    bad = own.filter("_bad = 1")
    wide = bad.filter(F.size("items") > width * max_tokens).select("items", F.array().cast("array<string>").alias("union"), F.lit(0).alias("at"))
    for left in range(max_tokens - 1, -1, -1):
        last = F.ceil(F.size("items") / width).cast("int") - left
        wide = wide.select("items", "union", F.explode(F.sequence(F.col("at") + 1, last)).alias("at")).filter(F.col("at") <= last)
        wide = wide.select("items", F.concat("union", F.slice("items", (F.col("at") - 1) * width + 1, width)).alias("union"), "at")
    baskets = written(bad.filter(F.size("items") <= width * max_tokens).select("items").union(wide.select("union")), "url-unions")
    n = baskets.count()
    if n < least:
        return own.sparkSession.createDataFrame([], "rule array<string>")
    sets = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n).fit(baskets).freqItemsets
    return sets.filter(F.size("items") <= max_tokens).select(F.array_sort("items").alias("rule"))


def _recounted(rules: DataFrame, folded: DataFrame) -> DataFrame:
    """rule, with the number of URLs that hold all its items and of the bad ones among them."""
    posted = _posted(written(rules, "url-candidates"))
    looked = folded.select("items", "n", "bad", F.explode("items").alias("token"))
    hits = looked.join(sized_broadcast(posted, 300), "token").filter(F.size(F.array_except("rule", "items")) == 0)
    return hits.groupBy("rule").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))


def _spelled(rules: DataFrame, classes: DataFrame, max_tokens: int) -> DataFrame:
    """The rules with each item in turn replaced by each of its members."""
    members = classes.select(F.col("item").alias("_item"), F.explode("members").alias("_token"))
    members = sized_broadcast(members, 80, F.octet_length("_item") + F.octet_length("_token"))
    out = rules.withColumn("_own", F.array().cast("array<string>"))
    for k in range(max_tokens):
        out = out.join(members, F.get("rule", F.lit(k)) == F.col("_item"), "left").withColumn("_own", F.concat("_own", F.array_compact(F.array("_token")))).drop("_item", "_token")
    return out.select(F.array_sort("_own").alias("rule"), "confidence", "support")


def _posted(rules: DataFrame) -> DataFrame:
    """The rules with token, that of theirs which the fewest rules hold, so common tokens post little."""
    counts = rules.select(F.explode("rule").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    found = rules.select(*rules.columns, F.explode("rule").alias("token")).join(counts, "token").groupBy(*rules.columns).agg(F.min_by("token", F.struct("n", "token")).alias("token"))
    return written(found, "url-index")


def _parts(rule: Column, most: int) -> Column:
    """Proper non-empty parts of the rule, in order."""
    bits = F.sequence(F.lit(1), F.lit((1 << most) - 2)) if most > 1 else F.array().cast("array<int>")
    pick = lambda b: F.filter(rule, lambda _, i: b.bitwiseAND(reduce(lambda acc, k: F.when(i == k, 1 << k).otherwise(acc), range(most), F.lit(0))) > 0)
    return F.array_distinct(F.filter(F.transform(bits, pick), lambda x: (F.size(x) > 0) & (F.size(x) < F.size(rule))))


def match(urls: DataFrame, rules: DataFrame, key: str, token_col: str) -> DataFrame:
    """key and the highest confidence of the rules whose tokens a URL holds. urls: key, token_col."""
    posted = _posted(rules.select("rule", "confidence"))
    looked = urls.select(key, token_col, F.explode(token_col).alias("token"))
    hits = looked.join(sized_broadcast(posted, 300), "token").filter(F.size(F.array_except("rule", token_col)) == 0)
    return hits.groupBy(key).agg(F.max("confidence").alias("confidence"))


def judge(pages: DataFrame, labels: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str, str]] = RULES, support: float = SUPPORT, confidence: float = CONFIDENCE, least_urls: int = LEAST_URLS, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """The pages with host, path, rule, confidence (of the best learned rule that fits) and verdict."""
    learned = mine(pages, labels, id_col=id_col, url_col=url_col, support=support, confidence=confidence, least_urls=least_urls, max_tokens=max_tokens)
    key, fkey, sure = fresh(pages.columns, "_url_key"), fresh(pages.columns, "_found_key"), fresh(pages.columns, "_confidence")
    urls = pages.select(text_key(F.col(url_col)).alias("key"), tokens(F.col(url_col)).alias("tokens"))
    hits = written(match(urls, learned, "key", "tokens").select(F.col("key").alias(fkey), F.col("confidence").alias(sure)), "url-hits")
    out = pages.drop("host", "path", "rule", "verdict", "confidence").withColumn(key, text_key(F.col(url_col)))
    out = out.join(sized_broadcast(hits, 60), out[key] == hits[fkey], "left").drop(key, fkey)
    out = out.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col)), "confidence": F.col(sure)}).drop(sure)
    rule, verdict = explicit(F.col("host"), F.col("path"), rules)
    return out.withColumn("rule", rule).withColumn("verdict", F.coalesce(verdict, F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")))
