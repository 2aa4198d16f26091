"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over all document windows.

Words are runs of letters, digits and characters beyond ASCII of the text with A-Z lower-cased. A window is
`window` consecutive words of a benchmark item; an item of fewer words is one window. The distinct windows' hashes
are broadcast if their counted size fits (else Spark shuffles both sides), every window of every document is looked
up, and each hit is verified word by word, since the fast hash also folds letters beyond A-Z. A document's verified
hits give the words that lie inside any of them; they can be cut out as spans, or the document can go.

Everything is DataFrame expressions. A document's windows depend on its text alone, so hits are kept by text hash.

Defined cases
* null or empty text, document or item: no words, no hits, no windows.
* items alike, or sharing windows: each distinct item_id counts once; null item_ids hit but are not counted.
* repeated rows: each is returned. Empty tables: no rows, or nothing contaminated.
* result columns replace input columns of the same name; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import computed, fresh, lower_ascii, shielded, sized_broadcast, text_key, written

WINDOW = 10
#: Words before lower-casing: A-Z are no separators then.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def _folded(words: Column) -> Column:
    # lower() is far faster than lowering A-Z alone, and words equal by the latter are equal by the former;
    # 32 bits a word are enough before hits are verified
    return F.transform(words, lambda w: F.hash(F.lower(w)))


def _starts(n: Column, length: Column) -> Column:
    return F.when(n >= length, F.sequence(F.lit(1), n - length + 1)).otherwise(F.array().cast("array<int>"))


def _bytes(words: str) -> Column:
    return F.octet_length(F.array_join(words, "")) + F.size(words) * 24


def benchmark_windows(items: DataFrame, *, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, n (words of the window), words (lower-cased), hash; one row an occurrence."""
    split = computed(items.select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).alias("_text")), raw=_words(F.col("_text")), words=_words(lower_ascii(F.col("_text"))))
    split = computed(split.filter(F.size("raw") > 0), folded=_folded(F.col("raw")), n=F.least(F.size("raw"), F.lit(window)))
    each = split.select("item_id", "n", "words", "folded", F.explode(F.sequence(F.lit(1), F.size("raw") - F.col("n") + 1)).alias("p"))
    return each.select("item_id", "n", F.slice("words", F.col("p"), F.col("n")).alias("words"), F.xxhash64(F.slice("folded", F.col("p"), F.col("n"))).alias("hash"))


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    """text, key and folded (a hash a word) of every document."""
    text = F.col(text_col)
    return computed(docs.select(text.alias("text")), key=text_key(text), folded=_folded(_words(text)))


def find_hits(texts: DataFrame, items: DataFrame, *, window: int = WINDOW, id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """By text hash (key) of the texts with hits: hits (array of p, n: first word from 1, words) and items (sorted item_ids). texts: text, key, folded."""
    occurrences = written(benchmark_windows(items, window=window, id_col=id_col, text_col=item_text_col), "windows")
    lengths = sorted(r[0] for r in occurrences.select("n").distinct().collect())  # at most `window` numbers
    hashes = sized_broadcast(occurrences.select("hash").distinct(), 24)
    # the texts are read once, and each is gone through for every length in turn
    scans = texts.select("key", "folded", F.explode(F.array(*[F.lit(n) for n in lengths or [window]])).alias("n"))
    rolled = computed(scans, rolled=F.transform(_starts(F.size("folded"), F.col("n")), lambda p: F.xxhash64(F.slice("folded", p, F.col("n"))))).drop("folded")
    found = rolled.select("key", "n", F.posexplode("rolled").alias("p", "hash")).join(hashes, "hash").select("key", (F.col("p") + 1).alias("p"), "n", "hash")
    found = written(found.groupBy("key").agg(F.collect_set(F.struct("p", "n", "hash")).alias("at")), "hits")  # at most a text's own windows
    # exact words of the hits; lower_ascii is applied to texts with hits only
    with_text = texts.select("key", "text").join(sized_broadcast(found, 60, F.size("at") * 32), "key")
    split = computed(with_text, words=_words(lower_ascii(F.col("text")))).drop("text")
    spans = split.select("key", "words", F.explode("at").alias("at")).select("key", F.slice("words", F.col("at.p"), F.col("at.n")).alias("words"), "at")
    distinct = occurrences.groupBy("hash", "words").agg(F.min("n").alias("_n"))
    verified = spans.join(sized_broadcast(distinct, 60, _bytes("words")), [spans["at"]["hash"] == distinct["hash"], spans["words"] == distinct["words"]], "left_semi")
    verified = written(verified.groupBy("key").agg(F.collect_set(F.struct("at.p", "at.n")).alias("hits"), F.collect_set("words").alias("_windows")), "verified")
    owners = occurrences.select("words", "item_id").distinct()
    named = verified.select("key", F.explode("_windows").alias("words")).join(sized_broadcast(owners, 60, _bytes("words")), "words").groupBy("key").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    return verified.select("key", "hits").join(named, "key", "left").select("key", F.array_sort("hits").alias("hits"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _covered(hits: Column) -> Column:
    """Words inside any of the sorted spans."""
    start = F.struct(F.lit(0).alias("n"), F.lit(1).alias("end"))
    step = lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["p"] + x["n"] - F.greatest(acc["end"], x["p"]))).alias("n"), F.greatest(acc["end"], x["p"] + x["n"]).alias("end"))
    return F.aggregate(hits, start, step, lambda acc: acc["n"])


def scan(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """The documents with n_words, n_hit, n_items, items (array), contaminated, and hit_spans (array of p, n)."""
    key, folded, fkey, spans, names = (fresh(docs.columns, f"_found_{x}") for x in ("text", "folded", "key", "spans", "items"))
    # words are split once: the table serves the scan, the verification and the result, which each read their columns
    out = computed(docs, **{key: text_key(F.col(text_col)), folded: _folded(_words(F.col(text_col)))}).withColumn("n_words", F.size(folded).cast("long"))
    out = written(out, "split-documents")
    texts = out.select(F.col(text_col).alias("text"), F.col(key).alias("key"), F.col(folded).alias("folded"))
    hits = written(find_hits(texts, items, window=window).toDF(fkey, spans, names), "contaminated")
    out = out.drop(folded)
    out = out.join(sized_broadcast(hits, 80, F.size(spans) * 24 + _bytes(names)), out[key] == hits[fkey], "left").drop(key, fkey)
    none = F.array().cast(hits.schema[spans].dataType)
    out = computed(out, hit_spans=F.coalesce(spans, none), items=F.coalesce(names, F.array().cast("array<string>")), n_hit=F.coalesce(_covered(F.col(spans)), F.lit(0)).cast("long")).drop(spans, names)
    return out.withColumns({"n_items": F.size("items").cast("long"), "contaminated": F.col("n_hit") > 0})


def drop_contaminated(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """The documents without a hit."""
    fkey = fresh(docs.columns, "_found_key")
    hits = written(find_hits(_texts(docs, text_col), items, window=window).select(F.col("key").alias(fkey)), "contaminated")
    return docs.join(sized_broadcast(hits, 40), text_key(docs[text_col]) == hits[fkey], "left_anti")


def cut_spans(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """The documents with the words inside hits, and what stands before each of them since the word before, cut out."""
    parts, spans = fresh(docs.columns, "_parts"), fresh(docs.columns, "_spans")
    own, restored = shielded(docs, text_col)
    found = scan(own, items, window=window, text_col=text_col)
    found = computed(found, **{parts: F.regexp_extract_all(F.coalesce(text_col, F.lit("")), F.lit(rf"(?s)[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*(?:{WORD}|\z)"), F.lit(0)), spans: F.col("hit_spans")})
    inside = lambda i: F.exists(F.col(spans), lambda s: (s["p"] <= i + 1) & (i + 1 < s["p"] + s["n"]))
    left = F.array_join(F.filter(F.col(parts), lambda _, i: ~inside(i)), "")
    return restored(found.withColumn(text_col, F.when(F.col("contaminated"), left).otherwise(F.col(text_col))))
