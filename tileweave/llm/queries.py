"""Registered queries of this subpackage, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, collocations, decontam, jaccard, language, linedup, mixing, pages, pii, quality, ranking, toxicity, urls

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op5_chat_snapshots", """
with t as (select distinct conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text
           from conversations where conv_id is not null),
c as (select conv_id, list([role, text] order by turn nulls first, role, text) as turns,
             string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '' order by turn nulls first, role, text) as rendered
      from t group by conv_id),
prefixes as (select distinct turns[1:k] as turns from (select turns, unnest(range(1, len(turns))) as k from c)),
whole as (select turns, min(conv_id) as conv_id, count(*) as n_copies, min(rendered) as rendered from c group by turns)
select conv_id, cast(len(turns) as int) as n_turns, n_copies, rendered from whole anti join prefixes using (turns)
""")
def op5(spark, sf_dir):
    return chat.render(table(spark, sf_dir, "conversations"))


@query("op4_line_windows", """
with l as (select doc_id, text, string_split(text, chr(10)) as lines from documents where text is not null),
w as (select doc_id, i - 1 as pos, lines[i:i + 2] as win from (select doc_id, lines, unnest(range(1, len(lines) - 1)) as i from l)
      where trim(array_to_string(lines[i:i + 2], '')) <> ''),
firsts as (select win, min({'d': doc_id, 'p': pos}) as first from w group by win having count(*) > 1),
later as (select doc_id, pos from w join firsts using (win) where {'d': doc_id, 'p': pos} <> first),
gone as (select distinct doc_id, unnest([pos, pos + 1, pos + 2]) as p from later),
kept as (select doc_id, string_agg(lines[p + 1], chr(10) order by p) as text, count(*) as n
         from (select doc_id, lines, unnest(range(0, len(lines))) as p from l) anti join gone using (doc_id, p) group by doc_id)
select d.doc_id, case when d.text is null then null else coalesce(k.text, '') end as text,
       cast(coalesce(len(l.lines), 0) as int) as n_lines, cast(coalesce(len(l.lines), 0) - coalesce(k.n, 0) as int) as n_removed
from documents d left join l using (doc_id) left join kept k using (doc_id)
""")
def op4(spark, sf_dir):
    return linedup.line_dedup_report(table(spark, sf_dir, "documents"))


@query("op10_spaced_seeds", """
with b as (select distinct item_id, list_filter(list_transform(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'),
        lambda w: trim(w, '.,;:!?"''()')), lambda w: w <> '') as w from benchmark where item_id is not null and text is not null),
d as (select doc_id, list_filter(list_transform(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'),
        lambda w: trim(w, '.,;:!?"''()')), lambda w: w <> '') as w from documents where doc_id is not null and text is not null),
bp as (select item_id, least(len(w), 20) as n, w[p] as t, p from (select item_id, w, unnest(range(1, len(w) + 1)) as p from b)),
dp as (select doc_id, w[p] as t, p from (select doc_id, w, unnest(range(1, len(w) + 1)) as p from d)),
hits as (select doc_id, item_id, dp.p - bp.p as diag from dp join bp using (t) group by doc_id, item_id, diag having count(*) * 20 >= any_value(n) * 16),
eq as (select h.doc_id, h.item_id, h.diag, least(len(b.w), 20) as n, list_transform(range(greatest(1, 1 - h.diag), least(len(b.w), len(d.w) - h.diag) + 1), lambda i: case when d.w[i + h.diag] = b.w[i] then 1 else 0 end) as e
       from hits h join b using (item_id) join d using (doc_id)),
best as (select doc_id, item_id, n, list_max(list_transform(range(1, len(e) - n + 2), lambda i: list_sum(e[i:i + n - 1]))) as s from eq where len(e) >= n)
select doc_id, item_id, cast(max(s) as int) as n_equal, cast(max(n) as int) as n_aligned from best where s * 20 >= n * 16 group by doc_id, item_id
""")
def op10(spark, sf_dir):
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op8_soft_mixing")
def op8(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op2_quality_rules")
def op2(spark, sf_dir):
    return quality.judge(table(spark, sf_dir, "documents"))


@query("op1_toxicity")
def op1(spark, sf_dir):
    return toxicity.fit_and_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_personal_data")
def op7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.fit(docs))


@query("op9_main_text")
def op9(spark, sf_dir):
    return pages.extract_text(table(spark, sf_dir, "pages"))


@query("op6_url_templates")
def op6(spark, sf_dir):
    return urls.judge(table(spark, sf_dir, "pages"))


@query("op3_jaccard_join")
def op3(spark, sf_dir):
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"))


@query("op13_language")
def op13(spark, sf_dir):
    return language.fit_and_predict(table(spark, sf_dir, "documents"))


@query("op11_ranked_search", """
with t as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term
           from documents where text is not null),
q as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term
      from benchmark where item_id is not null and text is not null),
d as (select doc_id, count(*) as n from t group by doc_id),
a as (select count(*) as n_all, cast(sum(n) as bigint) as terms_all from d),
f as (select doc_id, term, count(*) as tf from t where term in (select term from q) group by doc_id, term),
w as (select term, cast(floor(1000 * ln((2 * any_value(n_all) + 2) / (2 * count(*) + 1))) as bigint) as weight from f, a group by term),
s as (select item_id, doc_id, cast(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_all) // terms_all)))) as bigint) as score
      from q join f using (term) join w using (term) join d using (doc_id), a group by item_id, doc_id)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) as rank, doc_id, score
from s where score > 0 qualify row_number() over (partition by item_id order by score desc, doc_id) <= 10
""")
def op11(spark, sf_dir):
    return ranking.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_collocations", """
with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece
           from documents where text is not null),
w as (select lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') as w from p),
g as (select lang, unnest(flatten(list_transform([1, 2, 3], lambda k: list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])))) as g from w),
f as (select lang, g, count(*) as f from g group by lang, g),
t as (select lang, cast(sum(f) as bigint) as n from f where len(g) = 1 group by lang),
c as (select lang, g, f as a from f where len(g) > 1 and f >= 10),
cuts as (select lang, g, a, k, g[1:k] as head, g[k + 1:len(g)] as tail from (select *, unnest(range(1, len(g))) as k from c)),
s as (select cuts.lang, cuts.g, a, k, x.f as l, y.f as r, cast(1000000::hugeint * a * a // (x.f::hugeint * y.f) as bigint) as score
      from cuts join f x on x.lang = cuts.lang and x.g = head join f y on y.lang = cuts.lang and y.g = tail),
best as (select * from s qualify row_number() over (partition by lang, g order by score, k) = 1),
inner_ as (select lang, unnest([g[1:2], g[2:3]]) as g, a as longer from c where len(g) = 3),
around as (select lang, g, max(longer) as longer from inner_ group by lang, g),
kept as (select best.*, array_to_string(best.g, ' ') as phrase from best left join around using (lang, g) where longer is null or 100 * longer < 50 * a)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from kept join t using (lang)
qualify row_number() over (partition by lang order by score desc, a desc, phrase) <= 2000
""")
def op12(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))
