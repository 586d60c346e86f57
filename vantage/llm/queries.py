"""The registered queries of this folder and the SQL that checks those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage.llm import decontaminate, divergence, jaccard, langid, licenses, mixing, packing, prefix_trie, pseudonyms, quality, resampling, secrets, suffixes
from vantage.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql.strip()
        return fn

    return add


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


@query("op1_secret_scan")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE_KINDS))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in secrets.BASE_KINDS],
        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
    )


MIX_SQL = """
with sizes as (select source, count(*)::DOUBLE as n, sqrt(count(*)::DOUBLE) as w from documents group by source),
rates as (select source, w / (select sum(w) from sizes) * (select sum(n) from sizes) / n as rate from sizes),
terms as (
  with recursive t(source, rate, k, term, upto) as (
    select source, rate, 0, exp(-rate), exp(-rate) from rates
    union all
    select source, rate, k + 1, term * rate / (k + 1), upto + term * rate / (k + 1) from t
    where k + 1 <= ceil(rate + 12 * sqrt(rate) + 20))
  select source, list(upto order by k) as upto from t group by source),
u as (select d.*, t.upto, (('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT + 0.5::DOUBLE)
  / 281474976710656::DOUBLE as u from documents d join terms t on d.source is not distinct from t.source),
times as (select *, len(list_filter(upto, lambda x: x < u)) as times from u)
select doc_id, text, lang, source, n_chars, replica::INT as replica,
  (('0x' || substr(md5('mix-1-order:' || coalesce(doc_id::VARCHAR, 'null') || ':' || replica), 1, 12))::BIGINT + 0.5::DOUBLE)
  / 281474976710656::DOUBLE as place
from (select *, unnest(range(1, times + 1)) as replica from times)
"""


@query("op9_source_mixing", MIX_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


@query("op7_language_id")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.languages(docs, langid.fit(docs))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


SHINGLE_SQL = """
with recursive words as (
  select doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w
  from documents),
sets as (
  select doc_id, case when len(w) = 0 then []::VARCHAR[] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s
  from words),
flat as (select doc_id, len(s) as n, unnest(s) as g from sets),
links as (
  select a.doc_id as a, b.doc_id as b from flat a join flat b on a.g = b.g and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach(a, b) as (
  select doc_id, doc_id from documents
  union
  select reach.a, links.b from reach join links on reach.b = links.a)
select doc_id, len(s)::BIGINT as n_shingles, (select min(b) from reach where reach.a = doc_id) as component_id from sets
"""


@query("op8_jaccard_join", SHINGLE_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_classes(table(spark, sf_dir, "documents"))


@query("op4_decontamination")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


RULES_SQL = """
with base as (
  select doc_id, lang, source, coalesce(text, '') as t,
    list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines
  from documents),
windows as (select doc_id, unnest(range(1, greatest(len(w) - 1, 1))) as i, w from base),
named as (select doc_id, i, count(*) over (partition by doc_id, w[i], w[i + 1], w[i + 2]) as c from windows),
again as (select doc_id, count(distinct x) as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) as x from named where c > 1) group by doc_id),
counted as (
  select doc_id, lang, source, len(w)::BIGINT as n_words, length(array_to_string(w, ''))::BIGINT as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT as n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT as n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT as n_repeat_words, len(lines)::BIGINT as n_lines
  from base left join again using (doc_id)),
failing as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from counted),
long as (
  select *, unnest([{'rate': 'symbols', 'v': n_symbols * 1000 // greatest(n_words, 1), 'wide': 100},
                    {'rate': 'dup_lines', 'v': n_dup_lines * 1000 // greatest(n_lines, 1), 'wide': 400},
                    {'rate': 'repeats', 'v': n_repeat_words * 1000 // greatest(n_words, 1), 'wide': 300},
                    {'rate': 'word_length', 'v': word_chars * 1000 // greatest(n_words, 1), 'wide': 2000}], recursive := true)
  from failing),
bucketed as (select *, greatest(length(bin(v)) - 6, 0) as sh from long where not base_failed),
floored as (select *, (v >> sh) << sh as f from bucketed),
placed as (
  select 'own' as level, lang, source, rate, wide, f, row_number() over (partition by lang, source, rate order by f) as r, count(*) over (partition by lang, source, rate) as n from floored
  union all select 'language', lang, null, rate, wide, f, row_number() over (partition by lang, rate order by f), count(*) over (partition by lang, rate) from floored
  union all select 'overall', null, null, rate, wide, f, row_number() over (partition by rate order by f), count(*) over (partition by rate) from floored),
quartiles as (
  select level, lang, source, rate, any_value(wide) as wide, any_value(n) as n, min(f) filter (4 * r >= n) as q1, min(f) filter (4 * r >= 2 * n) as q2, min(f) filter (4 * r >= 3 * n) as q3
  from placed group by level, lang, source, rate),
limits as (select *, q2 + greatest(6 * (q3 - q1), wide) as high from quartiles),
judged as (
  select l.doc_id, l.rate, not l.base_failed and l.v > case when o.n >= 100 then o.high when g.n >= 100 then g.high else a.high end as above,
    list_position(['symbols', 'dup_lines', 'repeats', 'word_length'], l.rate) as place
  from long l
  left join limits o on o.level = 'own' and o.lang is not distinct from l.lang and o.source is not distinct from l.source and o.rate = l.rate
  left join limits g on g.level = 'language' and g.lang is not distinct from l.lang and g.rate = l.rate
  left join limits a on a.level = 'overall' and a.rate = l.rate),
reasons as (select doc_id, string_agg(rate, ',' order by place) filter (above) as reasons from judged group by doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and reasons is null as kept, coalesce(reasons, '') as reasons
from failing left join reasons using (doc_id)
"""


@query("op3_quality_rules", RULES_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judged(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.concat_ws(",", "reasons").alias("reasons"))


@query("op2_license_scan")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(table(spark, sf_dir, "documents"))


@query("op5_pseudonyms")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The key of a real job comes from its secret store; this one is for the synthetic tables.
    found = pseudonyms.pseudonymised(table(spark, sf_dir, "documents"), b"key of the synthetic tables")
    return found.select("doc_id", "text", _joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


@query("op6_importance_resampling")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SUFFIX_SQL = """
with bytes as (select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents),
starts as (select doc_id, unnest(range(0, greatest(n - 99, 0))) as s, h from bytes),
later as (
  select doc_id, s from (
    select doc_id, s, row_number() over (partition by k order by doc_id, s) as r from (select doc_id, s, md5(substr(h, 2 * s + 1, 200)) as k from starts))
  where r > 1),
marked as (select doc_id, s, case when s > lag(s) over w + 100 or lag(s) over w is null then 1 else 0 end as fresh
  from later window w as (partition by doc_id order by s)),
numbered as (select doc_id, s, sum(fresh) over (partition by doc_id order by s) as run from marked),
runs as (select doc_id, min(s) as lo, max(s) + 100 as hi from numbered group by doc_id, run),
ends as (select doc_id, lo, hi, 1 as real from runs union all select doc_id, n, n, 0 from bytes),
pieces as (select doc_id, lo, hi, real, coalesce(lag(hi) over (partition by doc_id order by lo, hi, real desc), 0) as at from ends)
select b.doc_id, any_value(b.n)::BIGINT as n_bytes, sum(p.hi - p.lo)::BIGINT as n_removed, sum(p.real)::BIGINT as n_spans,
  sha256(unhex(string_agg(substr(b.h, 2 * p.at + 1, 2 * (p.lo - p.at)), '' order by p.lo, p.real desc))) as kept_sha256
from pieces p join bytes b on b.doc_id = p.doc_id group by b.doc_id
"""


@query("op10_suffix_dedup", SUFFIX_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.deduplicated(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


TRIE_SQL = """
with turns as (
  select conv_id, md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) as id,
    octet_length(encode(coalesce(text, ''))) as bytes, turn from conversations where conv_id is not null),
own as (
  select conv_id, list(id order by turn nulls first, id) as ids, list(bytes order by turn nulls first, id) as sizes,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
      lambda a, s: list_reduce(list_prepend(xor(a, s), range(8)), lambda c, k: xor(c >> 1, 3988292384::BIGINT * (c & 1)))), 4294967295) % 9 as h
  from turns group by conv_id),
whole as (
  select o.conv_id, list_concat(coalesce(f.ids, [])[:o.h], o.ids[o.h + 1:]) as ids, list_concat(coalesce(f.sizes, [])[:o.h], o.sizes[o.h + 1:]) as sizes
  from own o left join own f on f.conv_id = o.conv_id - o.conv_id % 5),
starts as (select conv_id, len(ids) as n, ids, sizes, unnest(range(0, len(ids) + 1)) as depth from whole),
named as (select *, array_to_string(ids[:depth], '') as key, array_to_string(ids[:depth - 1], '') as up from starts),
nodes as (
  select key, depth, any_value(case when depth > 0 then up end) as up, any_value(case when depth > 0 then sizes[depth] else 0 end) as size, min(conv_id) as conv_id,
    count(*) as n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' order by conv_id) filter (n = depth), '')) as ends_sha256
  from named group by key, depth),
kids as (select up, count(*) as n_children from nodes where up is not null group by up),
priced as (select n.*, coalesce(n_children, 0) as n_children, (n_convs - 1) * size as own from nodes n left join kids k on k.up = n.key),
sums as (
  select a.key, sum(p.own) as saved, sum((p.n_children = 0)::INT) as leaves
  from priced p join named a on a.conv_id = p.conv_id and a.depth <= p.depth group by a.key)
select p.conv_id, p.depth, f.conv_id as parent_conv_id, p.n_convs, p.n_children, s.leaves::BIGINT as n_leaves, s.saved::BIGINT as saved_tokens, p.ends_sha256
from priced p join sums s on s.key = p.key left join nodes f on f.key = p.up
"""


@query("op11_prefix_trie", TRIE_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


AUDIT_SQL = """
with docs as (
  select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source,
    list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{80}-\\x{10FFFF}]+'), lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as words
  from documents),
words as (select row, lang, source, unnest(words) as term from docs),
kept as (select lang, term from words group by lang, term having count(distinct row) >= 30),
sizes as (select lang, count(*) as v from kept group by lang),
counts as (select lang, source, term, count(*) as n from words semi join kept using (lang, term) group by lang, source, term),
groups as (
  select g.lang, g.source, coalesce(sum(n), 0)::HUGEINT as total, coalesce(any_value(v), 0)::HUGEINT as v
  from (select distinct lang, source from docs) g left join counts c using (lang, source) left join sizes s on s.lang = g.lang group by g.lang, g.source),
shares as (
  select g.lang, g.source, k.term, coalesce(n, 0) as n, 1 + 1000000000::HUGEINT * (coalesce(n, 0) + 5) // (total + 5 * v) as p
  from groups g join kept k on k.lang = g.lang left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term),
overall as (
  select lang, term, 1 + 1000000000::HUGEINT * (sum(n) + 5) // (any_value(t) + 5 * any_value(v)) as q
  from shares join (select lang, sum(total) as t, any_value(v) as v from groups group by lang) using (lang) group by lang, term),
pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(sum(abs(x.p - y.p)), 0)::BIGINT as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join shares x on x.lang = a.lang and x.source = a.source left join shares y on y.lang = b.lang and y.source = b.source and y.term = x.term
  group by a.lang, a.source, b.source),
terms as (select lang, source, 'term' as part, term as item, (p - q)::BIGINT as value from shares join overall using (lang, term) where n > 0 and p > q),
ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, encode(item)) as rank
  from (select * from pairs union all select * from terms))
select lang, source, part, item, value, rank::INT as rank from ranked where part = 'pair' or rank <= 50
"""


@query("op12_source_divergence", AUDIT_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


@query("op13_retrieval_packing")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))
