"""The registered corpus queries and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hmm, html_text, importance, language, line_dedup, media, mixing, ngram_join, packing, pii, quality, warc, whitening
from .common import table


#: Multiples of the expected domain totals in the mixing query. Clean documents hold some toxic mass by their soft
#: membership, so the target for toxic text is a small share, not zero, which would empty them too.
MIX = {"good": 1.0, "poor": 0.5, "toxic": 0.2}


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.mix(docs, table(spark, sf_dir, "labels"), MIX)
    return mixed.select("doc_id", "n_tokens", *(f"p_{d}" for d in mixing.DOMAINS), "rate", "met")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.train(docs))
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "n_labelled")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cleaned = line_dedup.LineIndex.build(docs, min_docs=5, min_chars=40).apply(docs)
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    return cleaned.select("doc_id", "n_lines", "n_dropped", digest.alias("kept_sha256"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read_records(warc.write_archives(table(spark, sf_dir, "pages"), min_bytes=0))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_copies(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find(table(spark, sf_dir, "documents")))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.to_media(table(spark, sf_dir, "documents"))
    return media.media_digests(media.media_index(stored))


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = hmm.prepare(table(spark, sf_dir, "documents"))
    return hmm.score(corpus, hmm.train(corpus))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op9 that are set by the base patterns alone, which SQL can follow."""
    return op9_pii(spark, sf_dir).select("doc_id", *(f"n_{k}" for k in pii.BASE), "base_sha256")


def media_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op10 that are set by the text alone, which SQL can follow."""
    return op10_media_columns(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")


#: Words of a text by the white space of all rules.
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def quality_sql() -> str:
    """The counts by unnested words, windows and lines; the threshold table as conditions."""
    stops = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)
    counted = lambda marks: f"length(t) - length(translate(t, '{marks}', ''))"
    rules = []
    for _, ratio, least, most in quality.THRESHOLDS:
        top, _, bottom = ratio.partition(" / ")
        value = f"({top}) / nullif({bottom}, 0)" if bottom else ratio
        rules += [f"coalesce({value} {sign} {bound}, false)" for sign, bound in ((">=", least), ("<=", most)) if bound is not None]
    return rf"""
with docs as (select row_number() over () as r, doc_id, coalesce(text, '') as t, {WORDS} as w, string_split(coalesce(text, ''), chr(10)) as l from documents),
words as (select r, i, w[i] as x from docs, range(1, len(w) + 1) q(i)),
windows as (select r, i, list_aggregate(w[i:i + 7], 'string_agg', ' ') as x from docs, range(1, len(w) - 6) q(i)),
again as (select r, i from windows qualify count(*) over (partition by r, x) > 1),
covered as (select r, count(distinct i + k) as n from again, range(8) q(k) group by r),
lines as (select r, x from (select r, unnest(l) as x from docs) where regexp_matches(x, '[^\x20\x09-\x0D]')),
lined as (select r, count(*) as n, count(*) - count(distinct x) as d from lines group by r),
worded as (select r, sum(length(x)) as chars, count(*) filter (where x = before) as stutter, count(*) filter (where lower(x) in ({stops})) as stops
    from (select r, x, lag(x) over (partition by r order by i) as before from words) group by r),
counts as (select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(chars, 0) as bigint) as word_chars, cast({counted('#*$%&|<>')} as bigint) as n_symbols,
    cast({counted('!?')} as bigint) as n_marks, cast(length(regexp_replace(t, '[^\p{{L}}]+', '', 'g')) as bigint) as n_letters, cast(coalesce(lined.n, 0) as bigint) as n_lines,
    cast(coalesce(d, 0) as bigint) as n_dup_lines, cast(coalesce(covered.n, 0) as bigint) as n_repeat_words, cast(coalesce(stutter, 0) as bigint) as n_stutter,
    cast(coalesce(stops, 0) as bigint) as n_stop_words
    from docs left join lined using (r) left join covered using (r) left join worded using (r)),
based as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from counts)
select *, not base_failed and {' and '.join(rules)} as kept from based"""


#: A CRC by a table of 256 remainders, which a recursion makes from the polynomial; ``b`` is a list of bytes.
CRCS = """bits as (select i, i as c, 0 as k from range(256) q(i) union all select i, case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from bits where k < 8),
crcs as (select list(c order by i) as t from bits where k = 8)"""
CRC = "xor(list_reduce(list_prepend(4294967295, b), lambda s, c: xor(s >> 8, t[1 + xor(s & 255, c)])), 4294967295)"
BYTES = "list_transform(range(1, 1 + octet_length({x})), lambda i: strpos('0123456789ABCDEF', hex({x})[2 * i - 1]) * 16 + strpos('0123456789ABCDEF', hex({x})[2 * i]) - 17)"

#: The base patterns, and what a match of each must pass (x: the match, d: its digits).
BASE_PATTERNS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(x, '.'), lambda q: length(ltrim(q, '0')) > 3 or lpad(right(q, 3), 3, '0') > '255')) = 0"),
    "card": (r"[0-9]([\x20-]?[0-9])+", """length(d) between 12 and 19 and list_sum(list_transform(range(1, length(d) + 1),
        lambda i: (strpos('0123456789', d[length(d) - i + 1]) - 1) * (1 + (i - 1) % 2) - case when (strpos('0123456789', d[length(d) - i + 1]) - 1) * (1 + (i - 1) % 2) > 9 then 9 else 0 end)) % 10 = 0"""),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "length(d) between 9 and 15"),
}


def pii_sql() -> str:
    """Matches of each pattern; their places follow from the pieces between them."""
    found = " union all ".join(f"select r, '{k}' as kind, {i} as rank, regexp_extract_all(t, '{p}') as m, string_split_regex(t, '{p}') as p from docs" for i, (k, (p, _)) in enumerate(BASE_PATTERNS.items()))
    passes = " or ".join(f"kind = '{k}' and {test}" for k, (_, test) in BASE_PATTERNS.items())
    counts = ", ".join(f"count(*) filter (where kind = '{k}') as n_{k}" for k in BASE_PATTERNS)
    return f"""with docs as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents), found as ({found}),
each as (select r, kind, rank, m[i] as x, regexp_replace(m[i], '[^0-9]', '', 'g') as d,
    cast(list_sum(list_transform(p[1:i], lambda s: length(s))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda s: length(s))), 0) as bigint) as a from found, range(1, len(m) + 1) q(i)),
kept as (select * from each where {passes})
select doc_id, {counts}, sha256(coalesce(string_agg(kind || ':' || a || ':' || (a + length(x)), ',' order by a, rank) filter (where kind is not null), '')) as base_sha256
from docs left join kept using (r) group by r, doc_id"""


QUERIES = {
    f.__name__: f
    for f in (
        op1_source_mixing,
        op2_language_id,
        op3_html_extraction,
        op4_line_dedup,
        op5_warc,
        op6_quality_rules,
        op7_best_fit_packing,
        op8_ngram_jaccard_join,
        op9_pii,
        op10_media_columns,
        op11_lm_scoring,
        op12_embedding_whitening,
        op13_importance_resampling,
        pii_base,
        media_payload,
    )
}

ORACLES: dict[str, str] = {
    "op4_line_dedup": r"""
with lines as (
    select doc_id, i, string_split(coalesce(text, ''), chr(10))[i] as line
    from documents, range(1, 1 + len(string_split(coalesce(text, ''), chr(10)))) r(i)
), keyed as (
    select doc_id, i, line,
        translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
    from lines
), held as (
    select k, max(doc_id) as last from keyed where length(k) >= 40 group by k having count(distinct doc_id) >= 5
), marked as (
    select doc_id, i, line, held.k is not null and doc_id <> last as gone from keyed left join held on keyed.k = held.k
)
select doc_id, cast(count(*) as bigint) as n_lines, cast(count(*) filter (where gone) as bigint) as n_dropped,
    sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
""",
    # Base 32 of the digest: of 160 bits, five at a time from two hexadecimal digits on.
    "op5_warc": r"""
with p as (select page_id, encode(coalesce(html, '')) as data from pages),
d as (select page_id, octet_length(data) as n, sha1(data) || '00' as h from p),
b as (select page_id, n, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + (((strpos('0123456789abcdef', substr(h, 1 + (5 * i) // 4, 1)) - 1) * 16 + strpos('0123456789abcdef', substr(h, 2 + (5 * i) // 4, 1)) - 1)
    >> (3 - (5 * i) % 4)) % 32, 1) for i in range(32)], '') as digest from d),
f as (select *, min(page_id) over (partition by digest) as first from b)
select page_id, cast(n as bigint) as payload_bytes, digest as payload_digest,
    case when page_id > first then 'revisit' else 'response' end as record_type, case when page_id > first then first end as refers_to from f
""",
    "op6_quality_rules": quality_sql(),
    "op8_ngram_jaccard_join": r"""
with recursive w as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), s as (
    select distinct doc_id, array_to_string(w[i:i + 3], ' ') as x from w, range(1, greatest(2, len(w) - 2)) q(i) where len(w) > 0
), n as (select doc_id, count(*) as n from s group by doc_id),
c as (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
e as (select a, b from c join n x on a = x.doc_id join n y on b = y.doc_id where 100 * shared >= 85 * (x.n + y.n - shared)),
g as (select a, b from e union all select b, a from e),
walk as (select doc_id as a, doc_id as low from documents union select g.b, walk.low from walk join g on g.a = walk.a where walk.low < g.b)
select documents.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, low as component_id
from documents left join n on n.doc_id = documents.doc_id join (select a, min(low) as low from walk group by a) m on m.a = documents.doc_id
""",
    "op13_importance_resampling": r"""
with recursive """ + CRCS + r""",
texts as (select 0 as of, doc_id, coalesce(text, '') as t from documents union all select 1, item_id, coalesce(text, '') from benchmark),
worded as (select row_number() over () as r, of, doc_id, regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from texts),
runs as (select r, of, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as x from worded),
features as (select distinct x from runs),
bytes as (select x, """ + BYTES.format(x="encode(x)") + """ as b from features),
hashed as (select x, """ + CRC + """ % 10000 as bucket from bytes, crcs),
counts as (select bucket, count(*) filter (where of = 0) as s, count(*) filter (where of = 1) as t from runs join hashed using (x) group by bucket),
sums as (select sum(s) as s, sum(t) as t from counts),
gains as (select bucket, cast(floor(1000 * ln((counts.t + 1) * (sums.s + 10000) / ((counts.s + 1) * (sums.t + 10000)))) as bigint) as gain from counts, sums),
weighed as (select r, cast(floor(sum(gain) / count(*)) as bigint) as weight, count(*) as n from runs join hashed using (x) join gains using (bucket) where of = 0 group by r),
scored as (select doc_id, len(w) as n_words, coalesce(n, 0) as n_features, coalesce(weight, 0) as weight, coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((
    list_reduce(list_transform(range(1, 9), lambda i: strpos('0123456789abcdef', sha256('7:' || doc_id)[i]) - 1), lambda a, b: a * 16 + b) + 0.5) / 4294967296))) as bigint) as score
    from worded left join weighed using (r) where of = 0),
placed as (select *, n_words >= 20 as fit, row_number() over (partition by n_words >= 20 order by score desc, doc_id) as place, count(*) over (partition by n_words >= 20) as n_fit from scored)
select doc_id, cast(n_features as bigint) as n_features, weight, score, case when fit and place <= 25 * n_fit // 100 then place end as rank from placed
""",
    "pii_base": pii_sql(),
    "media_payload": f"""with recursive {CRCS}, sized as (select row_number() over () as r, doc_id, encode(coalesce(text, '')) as e from documents),
padded as (select r, doc_id, octet_length(e) as n, e || from_hex(repeat('00', cast(64 * greatest(1, (octet_length(e) + 63) // 64) - octet_length(e) as integer))) as p from sized),
tails as (select *, right(hex(p), 128) as h from padded), bytes as (select *, {BYTES.format(x="from_hex(h)")} as b from tails)
select doc_id, n as n_bytes, octet_length(p) as payload_bytes, sha256(p) as payload_sha256, {CRC} as tail_crc32 from bytes, crcs""",
}
