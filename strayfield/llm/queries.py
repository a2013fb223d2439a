"""The registered queries of the corpus operators, with their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from strayfield.llm import (
    exact_dedup,
    html_extract,
    license_scan,
    merkle,
    minhash,
    mixing,
    packing,
    quality,
    repair,
    sharding,
    simhash,
    suffix_dedup,
    url_filter,
)
from strayfield.session import configure

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{folder}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = _table(spark, folder, "pages").select("page_id", "url")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filter.judged(pages, rules, keep=["page_id"])


def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.labelled(_table(spark, folder, "documents").select("doc_id", "text"))


def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.taken(mixing.mixed(_table(spark, folder, "documents").select("doc_id", "text", "source")))


def op4_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """One old shard per source; eight new shards of equal capacity."""
    docs = _table(spark, folder, "documents").select("doc_id", "source", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("bytes"))
    slim = docs.select("doc_id", "source", F.crc32("bytes").alias("text_crc32"), F.octet_length("bytes").alias("n"))
    placed = sharding.resharded(slim, "source", size=(F.col("n") + 1).cast("long"), key=["doc_id", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard", "moved")


def op5_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scanned(_table(spark, folder, "documents").select("doc_id", "text")).drop("text")


def op6_html_extract(spark: SparkSession, folder: str) -> DataFrame:
    return html_extract.extracted(_table(spark, folder, "pages").select("page_id", "url", "html"))


def op7_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.removed(_table(spark, folder, "documents").select("doc_id", "text")))


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judged(_table(spark, folder, "documents").select("doc_id", "text")).drop("text", "line_chars", "kept_chars")


def op9_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.labelled(_table(spark, folder, "documents").select("doc_id", "text"))


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(_table(spark, folder, "documents").select("doc_id", "text"), vocabulary())


def op11_merkle(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select(*merkle.COLUMNS)
    return merkle.manifest(docs, altered=merkle.lower_cased(docs))


def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    turns = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return repair.report(repair.damaged(turns), ids=turns)


def op13_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.labelled(_table(spark, folder, "documents").select("doc_id", "text"))


def _pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(configure(spark), folder)


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [f for name, f in globals().items() if name.startswith("op") and callable(f)]
    return {f.__name__: f for f in own} | {"pipeline": _pipeline}


_SQL_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

# CRC-32 of a string's bytes: the table of the 256 bytes, and a fold over the string
_CRC_TABLE = """crc_bits(n, k, c) as (
  select n, 0, n from range(256) r(n) union all select n, k + 1, case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end from crc_bits where k < 8),
crc as materialized (select list(c order by n) l from crc_bits where k = 8)"""


def _crc32(ascii: str) -> str:
    codes = f"list_transform(string_split({ascii}, ''), lambda x: ord(x)::bigint)"
    return f"xor(list_reduce({codes}, lambda c, b: xor(c >> 8, l[1 + (xor(c, b) & 255)]), 4294967295), 4294967295)"


_LEAF = "sha256(" + " || ".join(f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')" for c in merkle.COLUMNS) + ")"

SQL = {
    "op11_merkle": rf"""
with recursive {_CRC_TABLE},
own as (select *, {_crc32("doc_id::varchar")} % 5 = 0 as hit from documents, crc),
two as materialized (
  select doc_id, source, {_LEAF} leaf, 0 which, row_number() over () r from own union all by name
  select doc_id, source, {_LEAF} leaf, 1 which, r from (
    select * replace (case when hit then translate(text, '{merkle.UPPER}', '{merkle.LOWER}') else text end as text), row_number() over () r from own)),
d as materialized (
  select a.doc_id, a.source, a.leaf, b.leaf altered, row_number() over (partition by a.source order by a.doc_id nulls first, a.leaf) - 1 i, count(*) over (partition by a.source) n, a.r
  from two a join two b on a.r = b.r and a.which = 0 and b.which = 1),
up(lvl, source, i, n, h) as (
  select 0, source, i, n, leaf from d
  union all select lvl + 1, source, i // 16, (n + 15) // 16, sha256(string_agg(h, '' order by i)) from up where n > 1 group by lvl, source, i // 16, n),
sub as materialized (select source, h subroot, row_number() over (order by source nulls first) - 1 i, count(*) over () n from up where n = 1),
top(lvl, i, n, h) as (
  select 0, i, n, subroot from sub union all select lvl + 1, i // 16, (n + 15) // 16, sha256(string_agg(h, '' order by i)) from top where n > 1 group by lvl, i // 16, n),
side as materialized (
  select lvl, source, i, coalesce(string_agg(h, '') over (w rows between unbounded preceding and 1 preceding), '') bef, coalesce(string_agg(h, '') over (w rows between 1 following and unbounded following), '') aft
  from up where n > 1 window w as (partition by lvl, source, i // 16 order by i)),
over_side as materialized (
  select lvl, i, coalesce(string_agg(h, '') over (w rows between unbounded preceding and 1 preceding), '') bef, coalesce(string_agg(h, '') over (w rows between 1 following and unbounded following), '') aft
  from top where n > 1 window w as (partition by lvl, i // 16 order by i)),
fold(r, lvl, source, i, n, acc, proof) as (
  select r, 0, source, i, n, altered, '' from d
  union all select f.r, f.lvl + 1, f.source, f.i // 16, (f.n + 15) // 16, sha256(bef || acc || aft), proof || bef || aft
  from fold f join side s on s.lvl = f.lvl and s.source is not distinct from f.source and s.i = f.i where f.n > 1),
over_fold(r, lvl, i, n, acc, proof, subroot) as (
  select f.r, 0, s.i, s.n, f.acc, f.proof, s.subroot from fold f join sub s on s.source is not distinct from f.source where f.n = 1
  union all select f.r, f.lvl + 1, f.i // 16, (f.n + 15) // 16, sha256(bef || acc || aft), proof || bef || aft, subroot
  from over_fold f join over_side s on s.lvl = f.lvl and s.i = f.i where f.n > 1)
select d.doc_id, d.leaf, o.subroot, t.h root, sha256(o.proof) proof_sha256, o.acc folded_root, o.acc = t.h verified
from over_fold o join d on d.r = o.r join top t on t.n = 1 where o.n = 1""",
    "op12_conversation_repair": rf"""
with recursive {_CRC_TABLE},
raw as (
  select conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') text, {_crc32("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 f from conversations, crc),
hurt as (
  select conv_id, turn, case when f = 4 then 'user' else role end role, case f when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(range(case f when 0 then 0 when 3 then 2 else 1 end)) copy from raw),
pos as materialized (select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text)) p from hurt),
judged as materialized (
  select *, substr(role, 1, 1) c, not regexp_matches(text, '[^ 	-]') blank, row_number() over (partition by conv_id, role, text order by p) > 1 seen,
    not regexp_matches(text, '[.!?][ 	-]*$') cut, lag(substr(role, 1, 1)) over (partition by conv_id order by p) b4 from pos),
counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint gaps, count(*) filter (blank)::bigint blank, count(*) filter (not blank and seen)::bigint duplicate,
    count(*) filter (not blank and not seen and cut)::bigint truncated, count(*) filter (b4 || c not in ('su', 'ua', 'au'))::bigint illegal, max(p) rows from judged group by conv_id),
ins(q, m, pre, made) as (values (0, 0, '', ''), (0, 2, 'I', chr(10) || 'user:'), (0, 3, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 1, '', ''), (1, 2, 'I', chr(10) || 'user:'),
  (1, 3, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (2, 2, '', ''), (2, 3, 'I', chr(10) || 'assistant:'), (3, 3, '', ''), (3, 2, 'I', chr(10) || 'user:')),
dp(conv_id, p, q, cost, audit, body) as (
  select conv_id, 0::bigint, 0, 0, '', '' from counts
  union all
  select conv_id, p, q2, cost, audit, body from (
    select d.conv_id, j.p, op, case when op = 'D' then m when op = 'K' and c = 's' then 1 when m = 2 then 3 else 2 end q2,
      d.cost + 3 * length(pre) + case op when 'D' then 4 when 'R' then 3 else 0 end + case when op <> 'D' and cut then 3 else 0 end as cost, d.audit || pre || op audit,
      d.body || made || case op when 'D' then '' when 'K' then chr(10) || role || ':' || text else chr(10) || case when m = 2 then 'assistant' else 'user' end || ':' || text end body
    from dp d join judged j on j.conv_id is not distinct from d.conv_id and j.p = d.p + 1 join ins on ins.q = d.q cross join (values ('D'), ('K'), ('R')) o(op)
    where op = 'D' or (not blank and not seen and (op = 'R' or (c = 's' and m = 0) or c = case when m = 2 then 'a' else 'u' end)))
  qualify row_number() over (partition by conv_id, p, q2 order by cost, audit) = 1),
closed as (
  select d.conv_id, cost + 3 * length(pre) as cost, audit || pre audit, body || made body,
    row_number() over (partition by d.conv_id order by cost + 3 * length(pre), audit || pre) k
  from dp d join counts c on c.conv_id is not distinct from d.conv_id and c.rows = d.p join ins on ins.q = d.q and m in (0, 3))
select i.conv_id, coalesce(gaps, 0) gaps, coalesce(blank, 0) blank, coalesce(duplicate, 0) duplicate, coalesce(truncated, 0) truncated, coalesce(illegal, 0) illegal,
  coalesce(cost, 0)::bigint as cost, coalesce(audit, '') audit, sha256(coalesce(substr(body, 2), '')) repaired_sha256
from (select distinct conv_id from conversations) i left join counts n on n.conv_id is not distinct from i.conv_id left join closed x on x.conv_id is not distinct from i.conv_id and k = 1""",
    "op1_url_filter": rf"""
with p as (
  select page_id, coalesce(strpos(url, '://'), 0) pos, url from pages),
h as (
  select page_id, case when pos = 0 then '' else translate(regexp_extract(substr(url, pos + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') end host,
    case when pos = 0 then '' else regexp_replace(regexp_extract(substr(url, pos + 3), '^[^?#]*'), '^[^/]*', '') end path from p),
rules(h, p, v) as (values {_SQL_RULES}),
fit as (
  select page_id, host, path, h || p as rule, v, row_number() over (partition by page_id order by length(h || p) desc) i
  from h left join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p))
select page_id, host, path, rule, coalesce(v, 'allow') verdict from fit where i = 1""",
    "op2_exact_dedup": r"""
with d as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) s from documents)
select doc_id, min(doc_id) over w keep_id, count(*) over w group_size, doc_id = min(doc_id) over w kept, s text_sha256
from d window w as (partition by s)""",
    "op9_minhash": rf"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
s as materialized (
  select distinct doc_id, array_to_string(w[i : i + 4], ' ') s from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) i from w where len(w) > 0)),
n as materialized (select doc_id, count(*) n from s group by 1),
link as materialized (
  select a.doc_id x, b.doc_id y from s a join s b on a.s = b.s and a.doc_id <> b.doc_id join n na on na.doc_id = a.doc_id join n nb on nb.doc_id = b.doc_id
  group by 1, 2, na.n, nb.n having 100 * count(*) >= 75 * (na.n + nb.n - count(*))),
reach as (select doc_id x, doc_id y from documents union select r.x, l.y from reach r join link l on l.x = r.y),
c as (select x doc_id, min(y) component_id from reach group by 1)
select c.doc_id, coalesce(n, 0) n_shingles, component_id, c.doc_id = component_id kept from c left join n on n.doc_id = c.doc_id""",
    "op8_quality_rules": rf"""
with d as (
  select doc_id, coalesce(text, '') t, {_WORDS} w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) ls from documents),
win as (
  select doc_id, i, array_to_string(w[i : i + 7], ' ') s from (select doc_id, w, unnest(range(1, len(w) - 6)) i from d where len(w) >= 8)),
twice as (select doc_id, i, count(*) over (partition by doc_id, s) n from win),
covered as (select doc_id, count(distinct p) n from (select doc_id, unnest(range(i, i + 8)) p from twice where n > 1) group by 1),
line as (
  select doc_id, l, len(list_filter(string_split_regex(l, '[\x20\x09-\x0D]+'), lambda w: w <> '')) n, len(regexp_extract_all(l, '[#*$%&|<>]')) sym,
    len(list_filter(string_split_regex(l, '[\x20\x09-\x0D]+'), lambda w: w in ('|', '»', '›', '>', '•', '·', '/'))) bars,
    list_filter(string_split_regex(l, '[\x20\x09-\x0D]+'), lambda w: w <> '') ws
  from (select doc_id, unnest(ls) l from d)),
fails as (
  select doc_id, length(l) c, (sym * 100 > n * 30) or (bars >= 2 and bars * 8 >= n)
    or (n < 4 and not regexp_matches(right(rtrim(l, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 4), '[.!?…:;。！？][''"’”»)\]]*$'))
    or (n <= 20 and regexp_matches(lower(l), 'javascript is|enable javascript|cookie policy|accept cookies|use of cookies|privacy policy|terms of use|terms of service|all rights reserved|lorem ipsum|click here|read more|sign up for|subscribe to our'))
    or len(list_filter(range(1, n - 2), lambda i: ws[i] = ws[i + 1] and ws[i] = ws[i + 2] and ws[i] = ws[i + 3])) > 0 f
  from line),
chars as (select doc_id, sum(c) total, sum(case when f then 0 else c end) left_over from fails group by 1),
m as (
  select d.doc_id, len(w)::bigint n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint n_symbols, (len(ls) - len(list_distinct(ls)))::bigint n_dup_lines, coalesce(c.n, 0)::bigint n_repeat_words,
    coalesce(total, 0) total, coalesce(left_over, 0) left_over
  from d left join covered c on c.doc_id = d.doc_id left join chars on chars.doc_id = d.doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 20 or 100 * n_repeat_words > 30 * n_words) base_failed,
  not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and left_over * 100 >= total * 50 kept from m""",
}
