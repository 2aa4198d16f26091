"""The same queries in SQL, over the same views."""

from __future__ import annotations

from candor.operators.labeling import NAMES
from candor.sources.adapters import sql

_Z = "1.959963984540054e0"

_SCORES = f""",
mu as (select case when sum(1 - p_fake) > 0 then sum(stars * (1 - p_fake)) / sum(1 - p_fake) else avg(stars) end as g from scored),
agg as (select business_id, count(*) as n, avg(stars) as naive, sum(stars * (1 - p_fake)) as w, sum(1 - p_fake) as n_eff, sum(case when p_fake > 0.5e0 then 1 else 0 end)::bigint as f from scored group by business_id),
r as (select agg.*, g, (w + 10e0 * g) / (n_eff + 10e0) as rrs from agg, mu),
s as (select *, greatest(0e0, least(1e0, (rrs - 1) / 4)) as p from r),
c as (select *, (p + {_Z} * {_Z} / (2 * n_eff)) / (1 + {_Z} * {_Z} / n_eff) as mid, {_Z} / (1 + {_Z} * {_Z} / n_eff) * sqrt(p * (1 - p) / n_eff + {_Z} * {_Z} / (4 * n_eff * n_eff)) as half from s),
scores as (select business_id, n as n_reviews, naive as naive_mean, rrs, rrs - naive as rrs_delta, 1 + 4 * case when n_eff > 0 then greatest(0e0, mid - half) else p end as rrs_ci_low,
  1 + 4 * case when n_eff > 0 then least(1e0, mid + half) else p end as rrs_ci_high, n_eff, f::double / n as pct_flagged, f as n_flagged, n - f as n_authentic_reviews, g as global_mean from c)
"""

_SPREAD = "min(n) as min, round(quantile_cont(n, 0.5), 6) as p50, round(quantile_cont(n, 0.9), 6) as p90, round(quantile_cont(n, 0.99), 6) as p99, max(n) as max, round(avg(n), 6) as mean"

_METRO = """,
kept as (select * from businesses where state in ('S1', 'S2', 'S3', 'S4', 'S5') and city in ('City1', 'City2', 'City3'))
"""


def _bursts(source: str) -> str:
    return f""",
daily as (select business_id, cast(date as date) as day, count(*) as n from {source} group by 1, 2),
base as (select *, avg(n) over w as mean, stddev_samp(n) over w as sd, count(n) over w as days from daily window w as (partition by business_id order by day rows between 14 preceding and 1 preceding)),
bursts as (select business_id, day, n from base where days >= 3 and sd > 0 and n > mean + 3 * sd)
"""


def _first_week(reviews: str, users: str) -> str:
    return f"select u.user_id, count(r.review_id) as first_week_count from {users} u left join {reviews} r on r.user_id = u.user_id and r.date >= u.yelping_since and r.date < u.yelping_since + interval '7' day group by u.user_id"


_GAPS = """select user_id, round(avg(g), 6) as gap_mean, round(stddev_samp(g), 6) as gap_std, count(g) as n_gaps
from (select user_id, extract(epoch from date - lag(date) over (partition by user_id order by date, review_id)) / 86400e0 as g from reviews) where g is not null group by user_id"""

_ENTROPY = """select user_id, -sum(n / t * ln(n / t)) as e from (select user_id, n, sum(n) over (partition by user_id) as t
from (select user_id, hour(date) as h, count(*)::double as n from reviews group by 1, 2)) group by user_id"""

_CONTEXT = """select r.review_id, round(r.stars - b.stars, 6) as stars_delta_from_business_mean, round(r.stars - u.average_stars, 6) as stars_delta_from_user_mean,
  round(extract(epoch from r.date - lag(r.date) over (partition by r.business_id order by r.date, r.review_id)) / 3600e0, 6) as hours_since_prev_review_on_business,
  row_number() over (partition by r.business_id order by r.date, r.review_id) as business_review_count_at_time, case when x.business_id is not null then 1 else 0 end::bigint as is_in_burst_window
from reviews r left join businesses b on b.business_id = r.business_id left join users u on u.user_id = r.user_id left join bursts x on x.business_id = r.business_id and x.day = cast(r.date as date)"""

_FRIENDS = "case when friends is null or friends in ('', 'None') then 0 else length(friends) - length(replace(friends, ',', '')) + 1 end::bigint"

_SNAPSHOT = "date '1999-01-01'"
_REVIEWER = f"""select u.user_id, review_count as total_reviews, fans as fan_count, compliment_photos as photo_count, date_diff('day', cast(yelping_since as date), {_SNAPSHOT}) as account_age_days_snapshot,
  round(review_count / greatest(date_diff('day', cast(yelping_since as date), {_SNAPSHOT}) / 30.44e0, 1e0), 6) as reviews_per_month, round(coalesce(v, 0), 6) as rating_variance, round(coalesce(sk, 0), 6) as rating_skew,
  round(coalesce(al, 0), 6) as avg_review_length, round(coalesce(fx, 0), 6) as fraction_extreme_ratings, round(coalesce(e, 0), 6) as posting_hour_entropy, yelping_since, {_FRIENDS} as friend_count
from users u left join (select user_id, var_samp(stars) as v, skewness(stars) as sk, avg(length(text)) as al, avg(case when stars in (1, 5) then 1e0 else 0e0 end) as fx from texts group by user_id) a on a.user_id = u.user_id
left join ({_ENTROPY}) h on h.user_id = u.user_id"""


def _content(text: str, first_person: bool = True) -> str:
    t = f"coalesce({text}, '')"
    count = lambda p: f"len(regexp_extract_all({t}, '{p}'))"
    words = count(r"[\p{L}\p{M}\p{N}\p{Pc}]+")
    per = lambda what, n: f"case when {n} = 0 then 0e0 else round({what}::double / {n}, 6) end"
    out = f"length({t})::bigint as char_length, {words}::bigint as word_count, {count('[.!?]+')}::bigint as sentence_count, {per(count('!'), f'length({t})')} as exclamation_ratio, {per(count('[A-Z]'), f'length({t})')} as caps_ratio"
    if first_person:
        own = rf"len(list_filter(regexp_extract_all(lower({t}), '[\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}]+'), lambda x: x in ('i', 'me', 'my', 'mine', 'we', 'us', 'our', 'ours')))"
        out += f", {per(own, words)} as first_person_ratio"
    return out


def _flesch(text: str) -> str:
    """Characters beyond ASCII become a digit where they are part of a word, else a space, so the pattern needs ASCII alone."""
    ws = rf"regexp_extract_all(regexp_replace(regexp_replace(coalesce({text}, ''), '[^\x00-\x7F\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}]', ' ', 'g'), '[^\x00-\x7F]', '0', 'g'), '\b[a-zA-Z'']+\b')"
    groups = "len(regexp_extract_all(lower(x), '[aeiouy]+'))"
    spoken = f"list_sum(list_transform({ws}, lambda x: greatest(1, {groups} - case when {groups} > 1 and lower(x) like '%e' then 1 else 0 end)))"
    return f"case when len({ws}) = 0 then 0e0 else 206.835e0 - 1.015e0 * len({ws}) / greatest(1, len(regexp_extract_all(coalesce({text}, ''), '[.!?]'))) - 84.6e0 * {spoken} / len({ws}) end"


_TERMS = r"list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"

#: The nearest other text of the same author: weights fitted within the author's reviews, texts alike folded into one.
_COPIES = r"""
told as (select k, hash(t) as t, count(*) as tf from (select k, unnest(""" + _TERMS + r""") as t from (select distinct md5(coalesce(text, '')) as k, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}\p{Pc}]{2,}') as w from documents)) group by 1, 2),
mine as (select user_id, review_id, md5(coalesce(text, '')) as k from texts),
folded as (select user_id, k, count(*) as copies from mine group by 1, 2),
many as (select user_id, count(*) as n from mine group by 1 having count(*) > 1),
held as (select user_id, t, sum(copies) as df, count(*) as h from folded join many using (user_id) join told using (k) group by 1, 2),
heavy as (select f.user_id, f.k, told.t, tf * (ln((1 + n) / (1e0 + df)) + 1) as x, h from folded f join many using (user_id) join told using (k) join held on held.user_id = f.user_id and held.t = told.t),
lengths as (select user_id, k, sqrt(sum(x * x)) as l from heavy group by 1, 2),
units as (select user_id, k, t, x / l as x from heavy join lengths using (user_id, k) where h > 1),
best as (select user_id, k, max(s) as s from (select a.user_id, a.k, b.k as o, sum(a.x * b.x) as s from units a join units b on a.user_id = b.user_id and a.t = b.t and a.k <> b.k group by 1, 2, 3) group by 1, 2),
copies as (select review_id, case when copies > 1 and l is not null then 1e0 when copies > 1 then 0e0 else greatest(0e0, coalesce(s, 0e0)) end as max_dup_sim from mine join folded using (user_id, k) left join lengths using (user_id, k) left join best using (user_id, k)),
"""

_ENRICHED = f"""{_bursts("reviews")},{_COPIES}
gaps as ({_GAPS.replace("round(avg(g), 6)", "avg(g)").replace("round(stddev_samp(g), 6)", "stddev_samp(g)")}),
weeks as ({_first_week("reviews", "users")}),
enriched as (select r.user_id, r.business_id, r.review_id, r.stars, r.date, case when x.business_id is not null then 1 else 0 end::bigint as in_burst_window, b.stars as business_mean_stars, b.review_count as business_total_reviews,
  u.review_count as user_review_count, u.yelping_since, u.fans, u.average_stars as user_avg_stars, u.compliment_photos, gap_mean, gap_std, n_gaps, coalesce(first_week_count, 0) as first_week_count,
  date_diff('day', cast(u.yelping_since as date), cast(r.date as date)) as account_age_days_at_review, length(coalesce(text, ''))::bigint as text_len, len(regexp_extract_all(coalesce(text, ''), '!'))::bigint as exclamation_count,
  case when length(coalesce(text, '')) = 0 then 0e0 else len(regexp_extract_all(text, '[A-Z]'))::double / length(text) end as caps_ratio, {_FRIENDS} as friend_count, c.max_dup_sim
  from texts r left join businesses b on b.business_id = r.business_id left join users u on u.user_id = r.user_id left join bursts x on x.business_id = r.business_id and x.day = cast(r.date as date)
  left join gaps on gaps.user_id = r.user_id left join weeks on weeks.user_id = r.user_id left join copies c on c.review_id = r.review_id)
"""


def _vote(name: str, suspicious: str, authentic: str) -> str:
    return f"(case when {suspicious} then 1 when {authentic} then 0 else -1 end)::bigint as {name}"


_CV = "case when gap_mean = 0 then 'nan'::double else gap_std / nullif(gap_mean, 0) end"
_VOTES = f"""{_ENRICHED},
votes as (select review_id,
  {_vote("lf_burst", "in_burst_window = 1", "in_burst_window = 0 and business_total_reviews >= 20")},
  {_vote("lf_one_shot_extreme", "user_review_count <= 2 and stars in (1, 5)", "user_review_count >= 10")},
  {_vote("lf_rating_deviation", "abs(stars - business_mean_stars) > 2 and abs(stars - user_avg_stars) > 2", "abs(stars - business_mean_stars) < 0.5e0 and abs(stars - user_avg_stars) < 0.5e0")},
  {_vote("lf_temporal_regularity", f"n_gaps >= 3 and {_CV} < 0.1e0", f"n_gaps >= 3 and {_CV} > 0.5e0")},
  {_vote("lf_duplicate_text", "max_dup_sim > 0.9e0", "max_dup_sim < 0.3e0 and user_review_count >= 5")},
  {_vote("lf_template_text", "text_len < 200 and (caps_ratio > 0.2e0 or exclamation_count >= 3) and stars in (1, 5)", "text_len > 500")},
  {_vote("lf_extreme_brevity", "text_len < 20 and stars = 5", "text_len > 200 and stars = 5")},
  {_vote("lf_new_account", "account_age_days_at_review < 30", "account_age_days_at_review > 365")},
  {_vote("lf_no_social", "friend_count = 0 and fans = 0 and compliment_photos = 0", "fans >= 5 or friend_count >= 20")},
  {_vote("lf_account_burst", "first_week_count > 5", "first_week_count <= 1")} from enriched)
"""
_UP, _DOWN = (" + ".join(f"({n} = {v})::int" for n in NAMES) for v in (1, 0))


def _summary() -> str:
    rows = []
    for c in NAMES:
        others = [o for o in NAMES if o != c]
        any_ = " or ".join(f"{o} <> -1" for o in others)
        against = " or ".join(f"({o} <> -1 and {o} <> {c})" for o in others)
        rate = lambda cond: f"round(avg(case when {cond} then 1e0 else 0e0 end), 6)"
        polarity = f"concat_ws(',', case when max(({c} = 0)::int) = 1 then '0' end, case when max(({c} = 1)::int) = 1 then '1' end)"
        rows.append(f"select '{c}' as lf, {polarity} as polarity, {rate(f'{c} <> -1')} as coverage, {rate(f'{c} <> -1 and ({any_})')} as overlaps, {rate(f'{c} <> -1 and ({against})')} as conflicts from votes")
    return " union all ".join(rows)


def _odds() -> str:
    from math import log

    from candor.plans.queries import FIXED_MODEL

    parts = []
    for name, by_vote in zip(FIXED_MODEL.names, FIXED_MODEL.mu, strict=True):
        w = [log(v[1]) - log(v[0]) for v in by_vote]
        parts.append(f"case {name} when 1 then ({w[1]!r}) when 0 then ({w[0]!r}) else 0e0 end")
    return " + ".join(parts)


_RANKED = "(select doc_id, quality as y, (doc_id * 37 % 101 + 20 * quality) / 121e0 as p, (doc_id * 13 % 11) / 10e0 as soft from labels)"
_CLIPPED = "greatest(1e-6, least(1 - 1e-6, p))"


def oracles() -> dict[str, str]:
    out = {
        "rrs_scores": _SCORES + "select business_id, n_reviews, round(naive_mean, 6) as naive_mean, round(rrs, 6) as rrs, round(rrs_delta, 6) as rrs_delta, round(rrs_ci_low, 6) as rrs_ci_low, round(rrs_ci_high, 6) as rrs_ci_high, round(n_eff, 6) as n_eff, pct_flagged, n_flagged, n_authentic_reviews, round(global_mean, 6) as global_mean from scores",
        "global_trust_mean": _SCORES + "select round(g, 6) as global_mean from mu",
        "rrs_top_downward": _SCORES + "select business_id, n_reviews, round(naive_mean, 6) as naive_mean, round(rrs, 6) as rrs, round(rrs_delta, 6) as rrs_delta from scores where n_reviews >= 20 order by rrs_delta, business_id limit 15",
        "rrs_distribution": _SCORES + "select count(*) as n_businesses, round(avg(rrs), 6) as mean_rrs, " + ", ".join(f"round(quantile_cont(rrs, {q}), 6) as p{round(q * 100):02d}" for q in (0.05, 0.25, 0.5, 0.75, 0.95)) + ", round(avg(abs(rrs_delta)), 6) as mean_abs_delta, round(median(pct_flagged), 6) as median_pct_flagged from scores",
        "pfake_histogram": " select least(9, greatest(0, floor(p_fake * 10)))::bigint as bin, count(*) as n from scored where p_fake is not null group by 1",
        "overview": " select 'businesses' as \"table\", count(*) as rows from businesses union all select 'reviews', count(*) from reviews union all select 'users', count(*) from users",
        "geo_breakdown": " select state, count(*) as businesses, sum(review_count)::bigint as listed_reviews from businesses group by state",
        "top_cities": " select city, state, count(*) as businesses from businesses group by city, state order by businesses desc, city, state limit 15",
        "date_range": " select min(date) as first_review, max(date) as last_review, count(*) as n_reviews from reviews",
        "reviews_per_user": f" select count(*) as n_users, {_SPREAD}, sum((n = 1)::int)::bigint as one_review_users from (select user_id, count(*) as n from reviews group by 1)",
        "reviews_per_business": f" select count(*) as n_businesses, {_SPREAD} from (select business_id, count(*) as n from reviews group by 1)",
        "rating_distribution": " select stars, count(*) as n, round(100e0 * count(*) / sum(count(*)) over (), 1) as pct from reviews group by stars",
        "reviews_per_year": " select year(date)::bigint as year, count(*) as n from reviews group by 1",
        "review_length": " select " + ", ".join(f"round(quantile_cont(length(text), {q}), 6) as p{round(100 * q)}" for q in (0.5, 0.9, 0.99)) + ", min(length(text)) as min, max(length(text)) as max, round(avg(length(text)), 6) as mean from texts",
        "account_age_buckets": " select case when d < 30 then '0  <30d' when d < 180 then '1  30-180d' when d < 365 then '2  180-365d' when d < 1095 then '3  1-3y' else '4  >3y' end as account_age, count(*) as n_users, round(avg(review_count), 6) as avg_lifetime_reviews, round(median(review_count), 6) as median_lifetime_reviews from (select review_count, date_diff('day', cast(yelping_since as date), date '1996-06-01') as d from users) group by 1",
        "reviews_per_user_hist": " select least(n, 15)::bigint as reviews, count(*) as users from (select user_id, count(*) as n from reviews group by 1) group by 1",
        "metro_filter": _METRO + "select business_id, city, state from kept",
        "semi_join_reviews": _METRO + "select * from reviews where business_id in (select business_id from kept)",
        "semi_join_users": _METRO + "select user_id, name, review_count from users where user_id in (select user_id from reviews where business_id in (select business_id from kept))",
        "burst_days": _bursts("reviews") + "select * from bursts",
        "burst_days_events": _bursts("event_reviews") + "select * from bursts",
        "context_features": _bursts("reviews") + _CONTEXT,
        "user_gap_stats": " " + _GAPS,
        "first_week_counts": " " + _first_week("reviews", "users"),
        "first_week_counts_events": " " + _first_week("event_reviews", "event_users"),
        "reviewer_features": " " + _REVIEWER,
        "posting_hour_entropy": f" select user_id, round(e, 6) as posting_hour_entropy from ({_ENTROPY})",
        "friend_count": f" select user_id, {_FRIENDS} as friend_count from users",
        "text_features": f" select doc_id, {_content('text')} from documents",
        "caps_excl_ratio": " select conv_id, turn, len(regexp_extract_all(coalesce(text, ''), '!'))::bigint as exclamation_count, case when length(coalesce(text, '')) = 0 then 0e0 else round(len(regexp_extract_all(text, '[A-Z]'))::double / length(text), 6) end as caps_ratio from conversations",
        "flesch": f" select doc_id, round({_flesch('text')}, 6) as flesch_reading_ease from documents",
        "display_formats": " select b.business_id, round((stars - 0.2e0) * 2) / 2 as half_stars, format('{:.2f}', stars / 3) as rating, round(review_count / 64e0 * 100)::bigint || '%' as share, format('{:,}', review_count * 1000 + 7) as count, replace(categories, ', ', '|') as categories, coalesce(strftime(last, '%b %-d, %Y'), '—') as last_review from businesses b left join (select business_id, max(date) as last from reviews group by 1) l on l.business_id = b.business_id",
        "account_age_elapsed": " select review_id, date_sub('day', yelping_since, date) as days_elapsed, date_diff('day', cast(yelping_since as date), cast(date as date)) as days_crossed from reviews join users using (user_id)",
        "dup_text_max_sim": r""",
ws as (select doc_id, source, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}\p{Pc}]{2,}') as w from documents),
tf as (select source, doc_id, t, count(*) as tf from (select source, doc_id, unnest(""" + _TERMS + r""") as t from ws) group by 1, 2, 3),
n as (select source, count(*) as n from documents group by 1),
df as (select source, t, count(*) as df from tf group by 1, 2),
wt as (select tf.source, tf.doc_id, tf.t, tf.tf * (ln((1 + n.n) / (1e0 + df.df)) + 1) as x, df.df from tf join n using (source) join df on df.source = tf.source and df.t = tf.t),
nm as (select doc_id, sqrt(sum(x * x)) as l from wt group by 1),
u as (select wt.source, wt.doc_id, t, x / l as x from wt join nm using (doc_id) where df > 1),
p as (select a.doc_id, b.doc_id as o, sum(a.x * b.x) as s from u a join u b on a.source = b.source and a.t = b.t and a.doc_id <> b.doc_id group by 1, 2)
select d.doc_id, round(coalesce(greatest(0, max(p.s)), 0), 5) as max_sim from documents d left join p on p.doc_id = d.doc_id group by d.doc_id""",
        "embedding_max_sim_label": " select a.vec_id, round(coalesce(max(list_dot_product(a.embedding::double[], b.embedding::double[])), 0), 5) as max_sim from embeddings a left join embeddings b on a.label = b.label and a.vec_id <> b.vec_id group by a.vec_id",
        "enriched_reviews": _ENRICHED + "select * replace (round(gap_mean, 6) as gap_mean, round(gap_std, 6) as gap_std, round(caps_ratio, 6) as caps_ratio, round(max_dup_sim, 6) as max_dup_sim) from enriched",
        "lf_votes": _VOTES + "select * from votes",
        "lf_coverage": _VOTES + " union all ".join(f"select '{c}' as lf, round(avg(({c} <> -1)::int), 6) as coverage, round(avg(({c} = 1)::int), 6) as suspicious_rate from votes" for c in NAMES),
        "lf_summary": _VOTES + _summary(),
        "majority_vote": _VOTES + f"select review_id, case when {_UP} > {_DOWN} then 1e0 when {_UP} < {_DOWN} then 0e0 else 0.5e0 end as p_suspicious from votes",
        "label_model_scores": _VOTES + f"select review_id, round(1 / (1 + exp(-({_odds()}))), 6) as p_suspicious from votes",
        "feature_table": _bursts("reviews") + f", ctx as ({_CONTEXT}), own as ({_REVIEWER}), cnt as (select review_id, {_content('text')}, round(({_flesch('text')})::float::double, 6) as flesch_reading_ease from texts),"
        + ", ".join(f" {n} as (select a.review_id, round(max(list_dot_product(a.v, b.v))::float::double, 6) as s from vectors a join vectors b on a.{k} = b.{k} and a.review_id <> b.review_id group by 1)" for n, k in (("own_sim", "user_id"), ("their_sim", "business_id")))
        +        " select r.review_id, r.user_id, r.business_id, r.stars, r.date, cnt.* exclude (review_id), ctx.* exclude (review_id), own.* exclude (user_id), date_sub('day', own.yelping_since, r.date) as account_age_days_at_review, case when r.review_id in (select review_id from vectors) then coalesce(own_sim.s, 0) end as max_sim_to_user_history, case when r.review_id in (select review_id from vectors) then coalesce(their_sim.s, 0) end as max_sim_to_business_reviews from reviews r left join ctx on ctx.review_id = r.review_id left join cnt on cnt.review_id = r.review_id left join own on own.user_id = r.user_id left join own_sim on own_sim.review_id = r.review_id left join their_sim on their_sim.review_id = r.review_id",
        "time_split_counts": " select case when date < timestamp '1997-01-01' then 'train' else 'test' end as part, count(*) as n, sum(((review_id % 11) / 10e0 >= 0.5e0)::int)::bigint as positives from reviews group by 1",
        "roc_auc": f" select round((sum(case when y = 1 then r end) - count(*) filter (where y = 1) * (count(*) filter (where y = 1) + 1) / 2e0) / (count(*) filter (where y = 1) * count(*) filter (where y = 0)), 6) as roc_auc from (select y, rank() over (order by p) + (count(*) over (partition by p) - 1) / 2e0 as r from {_RANKED})",
        "average_precision": f" select round(sum(pos * (cp / cn)) / sum(pos), 6) as average_precision from (select pos, sum(pos) over (order by p desc)::double as cp, sum(n) over (order by p desc)::double as cn from (select p, sum(y) as pos, count(*) as n from {_RANKED} group by p))",
        "precision_at_k": " union all ".join(f"select {k}::bigint as k, round(avg(y), 6) as precision from (select y from {_RANKED} order by p desc, doc_id limit {k})" for k in (50, 100)).join([" ", ""]),
        "soft_logloss": f" select round(avg(-(soft * ln({_CLIPPED}) + (1 - soft) * ln(1 - {_CLIPPED}))), 6) as soft_logloss from {_RANKED}",
        "pearson": f" select round(corr(soft, p), 6) as pearson from {_RANKED}",
        "search_businesses": _SCORES + "select b.business_id, name, city, state, stars as yelp_rating, review_count as yelp_review_count, round(rrs, 6) as rrs from businesses b left join scores s on s.business_id = b.business_id where lower(name) like '%supplier#0%' and lower(city) = 'city3' order by review_count desc, b.business_id limit 20",
        "business_detail": _SCORES + "select b.business_id, name, address, city, state, categories, stars as yelp_rating, review_count as yelp_review_count, round(rrs, 6) as rrs, round(rrs_ci_low, 6) as rrs_ci_low, round(rrs_ci_high, 6) as rrs_ci_high, pct_flagged, n_flagged, n_authentic_reviews, n_reviews from businesses b left join scores s on s.business_id = b.business_id where b.business_id = 7",
        "business_reviews_page": " select review_id, stars, strftime(date, '%Y-%m-%dT%H:%M:%S') as date, (review_id % 10) / 10e0 as p_fake from reviews r where business_id = 7 order by r.date desc, review_id limit 20 offset 5",
        "audit_snippets": " select doc_id, replace(substr(text, 1, 200), chr(10), ' ') || case when length(text) > 200 then '…' else '' end as snippet from documents order by n_chars desc, doc_id limit 100",
    }
    return {k: sql(v) for k, v in out.items()}
