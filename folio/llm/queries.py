"""Registered queries of the corpus operators and the SQL that checks them.

Each query reads its whole table and gives the operator's rows in the columns
of its contract.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import read_table
from .decontaminate import find_leaks
from .jaccard import jaccard_groups
from .lines import line_dedup
from .lm import lm_scores
from .packing import pack_documents
from .periods import periodic_runs
from .repeats import repetition_rules
from .substring import substring_dedup
from .tokens import token_counts
from .toxicity import fold, score_toxicity, train_toxicity
from .turns import damaged, repair_turns
from .vectors import near_vectors
from .warc import page_archive


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read_table(spark, sf_dir, "embeddings"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(read_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_archive(read_table(spark, sf_dir, "pages"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    field = train_toxicity(docs, read_table(spark, sf_dir, "labels"))
    return score_toxicity(docs, field).select(
        "doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read_table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(read_table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(read_table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(read_table(spark, sf_dir, "documents"), plant=True)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_turns(damaged(read_table(spark, sf_dir, "conversations")), digest_only=True)


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_rules(read_table(spark, sf_dir, "documents")).drop("longest_repeat")


QUERIES = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op3_warc": op3_warc,
    "op4_toxicity": op4_toxicity,
    "op5_decontamination": op5_decontamination,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_token_counts": op7_token_counts,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_quality_rules": op13_quality_rules,
}


def _crc32(text: str) -> str:
    """SQL for the unsigned CRC-32 of an ASCII string."""
    return (f"xor(list_reduce(list_transform(range(1, length({text}) + 1), "
            f"lambda i: ascii(substr({text}, i::int, 1))::bigint), lambda acc, b: list_reduce(range(0, 8), "
            "lambda a, k: xor(a >> 1, 3988292384 * (a & 1)), xor(acc, b)), 4294967295::bigint), 4294967295)")


def _edit(to: str, cost: str, letter: str, turn: str = "") -> str:
    """SQL for one way on: the costs, audit and turns of state ``to`` behind an edit."""
    rest = f"list_prepend({turn}, {to}.r)" if turn else f"{to}.r"
    return f"{{'c': {to}.c + {cost}, 'a': '{letter}' || {to}.a, 'r': {rest}}}"

ORACLE_SQL = {
    "op1_embedding_dedup": """
with recursive v as (
    select vec_id, label, embedding::double[] as e,
        sqrt(list_dot_product(embedding::double[], embedding::double[])) as norm
    from embeddings where label is not null and embedding is not null),
pairs as (
    select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id < b.vec_id
    where a.norm > 0 and b.norm > 0 and list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
links as (select a, b from pairs union all select b, a from pairs),
reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
n as (select a, count(*) as n from links group by a),
c as (select a, min(b) as low from reach group by a)
select vec_id, coalesce(n, 0)::bigint as n_links, least(vec_id, coalesce(low, vec_id)) as component_id,
    vec_id = least(vec_id, coalesce(low, vec_id)) as kept
from embeddings left join n on n.a = vec_id left join c on c.a = vec_id
""",
    "op2_line_dedup": """
with w as (select doc_id, source, string_split(text, chr(10)) as lines from documents),
l as (select doc_id, source, unnest(lines) as line, unnest(range(1, len(lines) + 1)) as place
      from w),
k as (select doc_id, source, place, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) as bare
      from l),
spread as (select bare, min(doc_id) as first from k where bare <> ''
           group by bare having count(distinct source) >= 10),
gone as (select doc_id, list(place) as gone from k join spread using (bare)
         where doc_id > first group by doc_id)
select doc_id, coalesce(len(lines), 0)::bigint as n_lines,
    coalesce(len(gone), 0)::bigint as n_removed,
    sha256(array_to_string([lines[i] for i in range(1, len(lines) + 1)
                            if gone is null or not list_contains(gone, i)], chr(10))) as kept_sha256
from w left join gone using (doc_id)
""",
    "op3_warc": """
with p as (select page_id, sha256(coalesce(html, '')) as d, octet_length(encode(coalesce(html, ''))) as n,
               url from pages),
h as (select page_id, d, n, n >= 100 and page_id is not null
             and row_number() over (partition by d order by page_id nulls last, url nulls first) > 1 as again,
             min(page_id) over (partition by d) as head
      from p)
select page_id, n::bigint as payload_bytes, d as payload_digest,
    case when again then 'revisit' else 'response' end as record_type,
    case when again then head end as refers_to
from h
""",
    "op8_substring_dedup": """
with w as (
    select doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) as words
    from documents),
win as (
    select doc_id, unnest(range(1, len(words) - 11)) as p, words from w),
keyed as (select doc_id, p, array_to_string(words[p : p + 12], ' ') as k from win),
firsts as (select k, min(doc_id) as first from keyed group by k),
hits as (select doc_id, p from keyed join firsts using (k) where first < doc_id),
gone as (select distinct doc_id, unnest(range(p, p + 13)) as i from hits),
g as (select doc_id, list(i) as gone from gone group by doc_id)
select doc_id, len(words)::bigint as n_words, coalesce(len(gone), 0)::bigint as n_removed,
    sha256(array_to_string([words[i] for i in range(1, len(words) + 1)
                            if gone is null or not list_contains(gone, i)], ' ')) as kept_sha256
from w left join g using (doc_id)
""",
    "op11_periodic_runs": """
with d as (
    select row_number() over () as rid, doc_id,
        coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) as words,
        """ + _crc32("doc_id::varchar") + """ as h from documents),
r as (select *, len(words) as n, h // 10 as g from d),
s as (select *, case when h % 10 = 0 and n > 0 then g % n end as a from r),
u as (select *, 1 + (n - a) // (3 + g % 8) as p from s),
v as (select rid, doc_id, case when a is null then words
        else [words[1 + case when i < a then i else a + (i - a) % p end] for i in range(0, n)] end as words
      from u),
grams as (select rid, i, array_to_string(words[i + 1 : i + 6], ' ') as k
          from (select rid, words, unnest(range(0, len(words) - 5)) as i from v)),
pairs as (select y.rid, y.i - x.i as q, y.i as j from grams x join grams y
          on x.rid = y.rid and x.k = y.k and x.i < y.i),
island as (select rid, q, j, j - row_number() over (partition by rid, q order by j) as k from pairs),
seg as (select rid, q, min(j) - q as start, count(*) + 5 + q as length from island group by rid, q, k
        having count(*) + 5 + q >= greatest(12, 2 * q)),
runs as (select * from seg s where not exists (
    select 1 from seg o where o.rid = s.rid and o.q < s.q and s.q % o.q = 0
        and o.start <= s.start and o.start + o.length >= s.start + s.length)),
best as (select rid, start, length, q from runs
         qualify row_number() over (partition by rid order by length desc, start, q) = 1),
total as (select rid, count(*) as n_runs,
              string_agg(start || ',' || length || ',' || q || chr(10), '' order by start, q) as lines
          from runs group by rid),
gone as (select rid, list(distinct i) as gone
         from (select rid, unnest(range(start + q, start + length)) as i from runs) group by rid)
select doc_id, coalesce(n_runs, 0)::bigint as n_runs, b.start::bigint as start, b.length::bigint as length,
    b.q::bigint as period, (1000 * b.length // b.q)::bigint as exponent_milli,
    sha256(coalesce(lines, '')) as runs_sha256,
    sha256(array_to_string([words[i + 1] for i in range(0, len(words))
                            if gone is null or not list_contains(gone, i)], ' ')) as collapsed_sha256
from v left join total using (rid) left join best b using (rid) left join gone using (rid)
""",
    "op12_conversation_repair": """
with recursive k as (
    select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
        coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations),
c as (select *, """ + _crc32("key") + """ % 20 as rule from k),
d as (
    select conv_id, turn, case when rule = 4 then 'user' else role end as role,
        case when rule = 1 then '' when rule = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
        unnest(case rule when 0 then [] when 3 then [0, 1] else [0] end) as copy from c),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, md5(text), copy) as i,
          regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g') as bare from d),
f as (select *, left(role, 1) as r1, lag(left(role, 1)) over (partition by conv_id order by i) as r0,
          case when bare = '' then 'b'
               when row_number() over (partition by conv_id, role, text order by i) > 1 then 'd'
               when right(bare, 1) not in ('.', '!', '?') then 't' else '' end as fault from o),
n as (select conv_id, count(*) as n, count(*) filter (fault = 'b') as blank,
          count(*) filter (fault = 'd') as duplicate, count(*) filter (fault = 't') as truncated,
          count(*) filter (r0 is not null and r0 || r1 not in ('su', 'ua', 'au')) as illegal,
          coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps from f group by conv_id),
w as (
    select conv_id, n + 1 as i, {'c': 0::bigint, 'a': '', 'r': []::varchar[]} as s0,
        {'c': 6::bigint, 'a': 'II', 'r': ['user:', 'assistant:']} as s1,
        {'c': 3::bigint, 'a': 'I', 'r': ['assistant:']} as s2, {'c': 0::bigint, 'a': '', 'r': []::varchar[]} as s3
    from n
    union all
    select conv_id, i, least(b0, """ + _edit("e2", "3", "I", "'user:'") + """),
        least(b1, """ + _edit("e2", "3", "I", "'user:'") + """), e2, e3
    from (
        select *, least(b2, """ + _edit("b3", "3", "I", "'assistant:'") + """) as e2,
            least(b3, """ + _edit("b2", "3", "I", "'user:'") + """) as e3
        from (
            select f.conv_id, f.i,
                least(""" + _edit("s0", "4", "D") + """,
                      case when ok and r1 = 's' then """ + _edit("s1", "cut", "K", "role || ':' || text") + """ end,
                      case when ok and r1 = 'u' then """ + _edit("s2", "cut", "K", "role || ':' || text") + """ end,
                      case when ok then """ + _edit("s2", "cut + 3", "R", "'user:' || text") + """ end) as b0,
                least(""" + _edit("s1", "4", "D") + """,
                      case when ok and r1 = 'u' then """ + _edit("s2", "cut", "K", "role || ':' || text") + """ end,
                      case when ok then """ + _edit("s2", "cut + 3", "R", "'user:' || text") + """ end) as b1,
                least(""" + _edit("s2", "4", "D") + """,
                      case when ok and r1 = 'a' then """ + _edit("s3", "cut", "K", "role || ':' || text") + """ end,
                      case when ok then """ + _edit("s3", "cut + 3", "R", "'assistant:' || text") + """ end) as b2,
                least(""" + _edit("s3", "4", "D") + """,
                      case when ok and r1 = 'u' then """ + _edit("s2", "cut", "K", "role || ':' || text") + """ end,
                      case when ok then """ + _edit("s2", "cut + 3", "R", "'user:' || text") + """ end) as b3
            from w join (select *, fault in ('', 't') as ok, case when fault = 't' then 3 else 0 end as cut from f) f
                on f.conv_id is not distinct from w.conv_id and f.i = w.i - 1)))
select a.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank,
    coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
    coalesce(illegal, 0)::bigint as illegal, coalesce(s0.c, 0)::bigint as cost, coalesce(s0.a, '') as audit,
    sha256(coalesce(array_to_string(s0.r, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) a
left join n on n.conv_id is not distinct from a.conv_id
left join w on w.conv_id is not distinct from a.conv_id and w.i = 1
""",
    "op13_quality_rules": """
with d as (
    select row_number() over () as rid, doc_id, coalesce(text, '') as text,
        coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) as words from documents),
win as (
    select rid, k, p, array_to_string(words[p : p + k - 1], ' ') as w
    from (select rid, words, k, unnest(range(1, len(words) - k + 2)) as p
          from d, (values (5), (16), (51)) s(k))),
again as (select rid, k, p from win qualify count(*) over (partition by rid, k, w) > 1),
spans as (select rid, k, count(distinct i) as n
          from (select rid, k, unnest(range(p, p + k)) as i from again) group by rid, k),
cover as (select rid, max(n) filter (k = 5) as n5, max(n) filter (k = 16) as n16, max(n) filter (k = 51) as n51
          from spans group by rid),
lines as (select rid, count(*) - count(distinct line) as n
          from (select rid, unnest(string_split(text, chr(10))) as line from d)
          where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by rid),
b as (
    select doc_id, len(words)::bigint as n_words,
        coalesce(list_sum([length(x) for x in words]), 0)::bigint as word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
        coalesce(lines.n, 0)::bigint as n_dup_lines, coalesce(n5, 0)::bigint as n_repeat_words,
        coalesce(n16, 0)::bigint as n_covered, n51
    from d left join cover using (rid) left join lines using (rid))
select * exclude (n51), n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
    not (n_words < 10 or 100 * n_repeat_words > 20 * n_words)
        and 100 * n_covered <= 10 * n_words and n51 is null as kept
from b
""",
}
