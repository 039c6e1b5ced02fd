"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, collisions, decontaminate, divergence, licenses, neardup, quality, quotes, sharding, substrings, suffixes, urls, whitening
from millrace.llm.batches import bounded

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}

SHARDS = 40
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql:
            CHECKS[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fertility() -> quality.Fertility:
    return quality.Fertility(public_tokenizers.path("piece_bpe_32k.model"))


def byte_bpe() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


OP1_SQL = r"""
with texts as materialized (select doc_id, row_number() over () as r, hex(encode(coalesce(text, ''))) as h from documents),
starts as (select r, h, unnest(range(0, len(h) // 2 - 199)) as i from texts where len(h) >= 400),
keyed as materialized (select r, i, md5(substr(h, 2 * i + 1, 400)) as k from starts),
found as (select r, i from keyed where k in (select k from keyed group by k having count(*) > 1)),
heads as (select r, i, case when i <= lag(i) over (partition by r order by i) + 200 then 0 else 1 end as head from found),
grouped as (select r, i, sum(head) over (partition by r order by i rows unbounded preceding) as g from heads),
spans as (select r, g, min(i) as a, max(i) + 200 as b from grouped group by r, g),
gaps as (select r, a, b, coalesce(lag(b) over (partition by r order by a), 0) as p from spans),
cut as (select r, sum(b - a)::bigint as n_removed, count(*) as n_spans, max(b) as e, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' order by a) as front from gaps join texts using (r) group by r)
select doc_id, (len(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans,
  sha256(unhex(case when n_removed is null then h else front || substr(h, 2 * e + 1) end)) as kept_sha256
from texts left join cut using (r)
"""


@query("op1_suffix_array_dedup", OP1_SQL)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of every document covered by 200-byte strings that start elsewhere, too."""
    return suffixes.dedup(table(spark, folder, "documents"))


@query("op2_quality_rules")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Base counts and the verdict of the fertility bands for every document."""
    judged = quality.judge(table(spark, folder, "documents").select("doc_id", "text", "lang"), fertility())
    return judged.select("doc_id", *quality.ADDED)


OP3_SQL = r"""
with recursive lowered as (select doc_id, row_number() over () as r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') as w from documents),
items as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') as w from benchmark),
spans as (select item_id, w, least(10, len(w)) as m, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from items where len(w) > 0),
windows as (select distinct item_id, m, array_to_string(w[i : i + m - 1], ' ') as k from spans),
sizes as (select distinct m from windows),
places as (select r, w, m, unnest(range(1, len(w) - m + 2)) as i from lowered, sizes where len(w) >= m),
keyed as (select r, m, i, array_to_string(w[i : i + m - 1], ' ') as k from places),
hits as (select r, i, keyed.m, item_id from keyed join windows on keyed.k = windows.k and keyed.m = windows.m),
covered as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + m)) as p from (select distinct r, i, m from hits)) group by r),
named as (select r, count(*) as n_items, string_agg(s, ',' order by s) as names from (select distinct r, item_id::varchar as s from hits where item_id is not null) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from lowered left join covered using (r) left join named using (r)
"""


@query("op3_decontamination", OP3_SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of the benchmark found in every document."""
    return decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op4_substring_dedup")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks that occur in an earlier document or place cut out of every document."""
    return substrings.dedup(table(spark, folder, "documents")).drop("kept")


OP5_COLUMNS = ["conv_id", "turn", "role", "place", "thread", "reply_to", "n_quotes", "deepest", "body_sha256", "origins"]


@query("op5_quotation_linking")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Every message's place in its conversation, what it replies to and its words without quotes."""
    return quotes.link(table(spark, folder, "conversations")).select(*OP5_COLUMNS)


@query("op6_license_scan")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """The best covered license notice of every document."""
    return licenses.scan(table(spark, folder, "documents"))


OP7_SQL = r"""
with recursive split as (select doc_id, row_number() over () as r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
places as (select r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from split where len(w) > 0),
shingles as (select distinct r, array_to_string(w[i : i + 4], ' ') as s from places),
sizes as (select r, count(*) as n from shingles group by r),
common as (select a.r as x, b.r as y, count(*) as c from shingles a join shingles b on a.s = b.s and a.r < b.r group by a.r, b.r),
links as (select x, y from common join sizes a on a.r = x join sizes b on b.r = y where 100 * c >= 75 * (a.n + b.n - c)),
both_ways as (select x, y from links union all select y, x from links),
reached as (select r, r as o from split union select reached.r, y from reached join both_ways on x = o),
named as (select reached.r, min(doc_id) as component_id from reached join split on split.r = o group by reached.r)
select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, coalesce(doc_id = component_id, false) as kept
from split join named using (r) left join sizes using (r)
"""


@query("op7_near_duplicates", OP7_SQL)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """The component of every document under 5-word shingles at a similarity of 0.75."""
    return neardup.near_duplicates(table(spark, folder, "documents"))


@query("op8_bpe")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document and the text they stand for, as digests."""
    return bpe.encoded(table(spark, folder, "documents"), byte_bpe())


def campaign_urls(pages: DataFrame) -> DataFrame:
    """The canonical URLs of pages that were reached with a campaign parameter: the list of the URL query."""
    return pages.where(F.contains("url", F.lit("utm_source="))).select(urls.canonical(urls.host(F.col("url")), urls.path(F.col("url"))).alias("page"))


OP9_SQL = r"""
with rest as (select page_id, url, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
parts as (select page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from rest),
keyed as (select *, nullif(regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', ''), '') as page from parts),
listed as (select distinct page as l from keyed where contains(url, 'utm_source=') and page is not null),
judged as (select *, case
    when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
    when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
    when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/' end as rule from keyed)
select page_id, host, path, rule, case rule when 'net/' then 'block' when 'example.com/de/' then 'block' when 'example.net/en/' then 'allow' when 'org/fr/' then 'allow'
    else case when l is null then 'allow' else 'block' end end as verdict
from judged left join listed on page = l
"""


@query("op9_url_filter", OP9_SQL)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Rules first, then the list of campaign pages by a blocked Bloom filter and an exact join."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    return urls.filter_urls(pages, campaign_urls(pages), RULES)


@query("op10_sharding")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """Forty shards of equal weight, and where each record would be with one more."""
    rows = sharding.measured(table(spark, folder, "documents"))
    placed = sharding.shard_rows(rows, "doc_id", ["text_crc32", "size"], [1.0] * SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.col("grown_shard").cast("int").alias("grown_shard"))


@query("op11_nearest_neighbours")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest vectors found by collision counting for every hundredth vector."""
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return collisions.nearest(vectors, vectors.where("vec_id % 100 = 0"), 10)


OP12_SQL = r"""
with texts as (select coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{80}-\x{10FFFF}]+') as w from documents),
tokens as (select lang, source, r, unnest(w) as term from texts),
counted as (select lang, source, term, count(*) as c, count(distinct r) as d from tokens group by all),
kept as (select lang, term, sum(c) as c from counted group by all having sum(d) >= 30),
langs as (select lang, sum(c) as n, count(*) as v from kept group by lang),
own as (select lang, source, sum(counted.c) as n from counted join kept using (lang, term) group by all),
groups as (select lang, source, coalesce(own.n, 0)::hugeint as n, coalesce(v, 0)::hugeint as v from (select distinct lang, source from texts) left join own using (lang, source) left join langs using (lang)),
shares as (select g.lang, source, term, coalesce(x.c, 0) as c, 1 + (1000000000::hugeint * (coalesce(x.c, 0) + 5)) // (g.n + 5 * g.v) as p,
    1 + (1000000000::hugeint * (k.c + 5)) // (l.n::hugeint + 5 * l.v) as q
  from groups g join kept k using (lang) join langs l using (lang) left join counted x using (lang, source, term)),
sums as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source),
terms as (select lang, source, 'term' as part, term as item, (p - q)::bigint as value from shares where c > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (select * from pairs union all select * from terms))
select lang, source, part, item, value, rank::int as rank from ranked where part = 'pair' or rank <= 50
"""


@query("op12_source_divergence", OP12_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """Distances between the sources of each language and the terms each source uses most above its language."""
    return divergence.audit(table(spark, folder, "documents"))


@query("op13_embedding_whitening")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector on the first sixteen whitened components, with the exact deviation from the mean."""
    return whitening.whiten(table(spark, folder, "embeddings"))
