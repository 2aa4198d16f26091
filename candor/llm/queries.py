"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, htmlrender, langid, linededup, lmscore, packing, quality, simhash, urlfilter, warc
from .common import doc_crc, read_table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.cut(read_table(spark, sf_dir, "documents"), tokenizer_path())
    digest = pieces.select("doc_id", "piece", "start", "length", F.crc32("tokens").alias("ids_crc32"))  # before packing: places depend on lengths alone
    return packing.assign(digest)


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


_WORDS3 = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3_SQL = f"""
with items as (select item_id, {_WORDS3} w from benchmark),
wins as (select distinct item_id, least(len(w), 10) n, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') g
         from (select item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) p from items where len(w) > 0)),
docs as (select row_number() over () r, doc_id, {_WORDS3} w from documents),
lens as (select distinct n from wins),
spans as (select r, p, n, array_to_string(w[p:p + n - 1], ' ') g from (select r, w, n, unnest(range(1, len(w) - n + 2)) p from docs, lens where len(w) >= n)),
hits as (select r, p, s.n, item_id from spans s join wins using (g)),
covered as (select r, count(distinct q) n_hit from (select r, unnest(range(p, p + n)) q from hits) group by r),
named as (select r, count(distinct item_id) n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) ids from hits group by r)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from docs left join covered using (r) left join named using (r)
"""


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.drop_boilerplate(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", "text")


OP4_SQL = r"""
with lines as (select doc_id, source, i, l, trim(l, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) t
               from (select doc_id, source, unnest(string_split(text, chr(10))) l, unnest(range(1, len(string_split(text, chr(10))) + 1)) i from documents)),
bad as (select t, min(doc_id) keeper from lines where t <> '' group by t having count(distinct source) >= 10),
marked as (select doc_id, i, l, bad.t is not null and doc_id <> keeper gone from lines left join bad using (t))
select doc_id, count(i)::bigint n_lines, coalesce(sum(gone::int), 0)::bigint n_removed,
  case when any_value(text) is null then null else coalesce(string_agg(l, chr(10) order by i) filter (where not gone), '') end as text
from documents left join marked using (doc_id) group by doc_id
"""


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = F.pmod(doc_crc(F.col("doc_id")), F.lit(7)) != 2
    out = lmscore.score(read_table(spark, sf_dir, "documents"), train)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality_rules(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *quality.STATS, "base_failed", "kept", F.col("score").alias("ratio_score"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(read_table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
with p as (select page_id, coalesce(html, '') h, octet_length(encode(coalesce(html, ''))) n from pages),
last as (select h, max(page_id) last from p where n >= 1000 group by h)
select page_id, n::bigint payload_bytes, sha1(p.h) payload_digest, case when last is null or last = page_id then 'response' else 'revisit' end record_type,
  case when last <> page_id then last end refers_to
from p left join last on p.h = last.h
"""


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlrender.extract(read_table(spark, sf_dir, "pages"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.pmod(doc_crc(F.col("doc_id")), F.lit(4)) == 2
    found = langid.predict(docs, langid.fit(docs.filter(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read_table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "page_id")
    found = urlfilter.judge(read_table(spark, sf_dir, "pages").select("page_id", "url"), labels)
    return found.select("page_id", "host", "path", "rule", "verdict", "confidence")


def url_explicit_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of operator 2: host, path and what the explicit rules decide."""
    return op2_url_filters(spark, sf_dir).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("rule_verdict"))


_URL_REST = "case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end"

URL_SQL = f"""
with rules(rule, rule_host, rule_path, rule_verdict) as (values ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'), ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
parts as (select row_number() over () r, page_id, coalesce(regexp_extract(rest, '^[^/?#]*'), '') h, coalesce(rest, '') rest from (select page_id, {_URL_REST} rest from pages)),
urls as (select r, page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') path from parts),
fits as (select r, max_by(rule, length(rule)) rule, max_by(rule_verdict, length(rule)) rule_verdict from urls join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path) group by r)
select page_id, host, path, rule, rule_verdict from urls left join fits using (r)
"""


def lm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of operator 5: all but the interpolated model's score."""
    return op5_lm_scoring(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
# CRC-32 bit by bit, as DuckDB has no function for it
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::bigint[], lambda a, z: xor(a >> 1, 3988292384::bigint * (a & 1)))))"""

LM_SQL = f"""
with docs as (select row_number() over () r, doc_id, {_CRC} % 7 = 2 held_out,
  {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} w from documents),
tokens as (select r, held_out, unnest(list_append(w, ' ')) t from docs),
counted as (select t, count(*) c from tokens where not held_out group by t),
totals as (select coalesce(sum(c), 0) n, count(*) v from counted),
scored as (select r, count(*) n_tokens, count(c) n_known, sum(log10((coalesce(c, 0) + 1)::double / (n + 1 * (v + 1))::double)) s from tokens left join counted using (t), totals group by r)
select doc_id, held_out, n_tokens::bigint n_tokens, n_known::bigint n_known, n::bigint train_tokens, round(s, 4) base_score from docs join scored using (r), totals
"""


def quality_base_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of operator 6: all but the ratio's verdict."""
    return op6_quality_rules(spark, sf_dir).select("doc_id", *quality.STATS, "base_failed")


QUALITY_SQL = f"""
with docs as (select row_number() over () r, doc_id, t, {_WORDS.format("t")} w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) l from (select doc_id, coalesce(text, '') t from documents)),
wins as (select r, p, array_to_string(w[p:p + 2], ' ') g from (select r, w, unnest(range(1, len(w) - 1)) p from docs where len(w) >= 3)),
often as (select r, g from wins group by r, g having count(*) > 1),
hit as (select r, count(distinct q) n from (select r, unnest(range(p, p + 3)) q from wins join often using (r, g)) group by r),
base as (select doc_id, len(w)::bigint n_words, length(array_to_string(w, ''))::bigint word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint n_symbols,
  (len(l) - len(list_distinct(l)))::bigint n_dup_lines, coalesce(n, 0)::bigint n_repeat_words from docs left join hit using (r))
select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed from base
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_url_filters": op2_url_filters,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_line_dedup": op4_line_dedup,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_quality_rules": op6_quality_rules,
    "op7_warc": op7_warc,
    "op8_html_extraction": op8_html_extraction,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_language_id": op10_language_id,
    # what SQL can express of operators that it cannot express whole
    "url_explicit_rules": url_explicit_rules,
    "lm_base_scores": lm_base_scores,
    "quality_base_statistics": quality_base_statistics,
}

ORACLES: dict[str, str] = {
    "op3_benchmark_decontamination": OP3_SQL,
    "op4_line_dedup": OP4_SQL,
    "op7_warc": OP7_SQL,
    "url_explicit_rules": URL_SQL,
    "lm_base_scores": LM_SQL,
    "quality_base_statistics": QUALITY_SQL,
}
