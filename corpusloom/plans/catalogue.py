"""The registered queries of the engine itself, each with the SQL that gives the same rows where SQL can.

The test tables stand in for the engine's own: embeddings for chunks with vectors (label: the entry), conversations for
sections in order, documents for long texts, pages for HTML, lineitem for explicit edges, part for titles.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as tx
from ..functions.vectors import unit
from ..operators import chunking, classify, entries, graph, graph_index, retrieval, similarity
from ..sources import html, json_array, snapshots, store
from .service import SearchService

QUERIES: dict = {}
SQL: dict[str, str] = {}

_WORDS = K.NOT_WS + "+"
QUERY_TEXT = "The red widget, a small ring and the blue bolt's view of steel"


def query(sql: str | None = None):
    def registered(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return registered


def _t(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- vectors and retrieval -------------------------------------------------------------------------------------------

_COS = "list_cosine_similarity(e.embedding::double[], q.embedding::double[])"
_Q0 = "q as (select embedding from embeddings where vec_id = 0)"
_SCORED = f"with {_Q0}, s as (select vec_id, label, {_COS} as c from embeddings e, q)"
_MEANS = "m as (select label, list(x order by place) as embedding from (select label, place, cast(avg(x::double) as float) as x from (select label, unnest(embedding) as x, generate_subscripts(embedding, 1) as place from embeddings) group by label, place) group by label)"


def _vector(spark, sf_dir: str, vec_id: int = 0) -> list[float]:
    return list(_t(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()[0])


@query(f"{_SCORED} select vec_id, round(c, 6) as cosine from s order by c desc, vec_id limit 24")
def vec_topk_global(spark, sf_dir):
    rows = _t(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return retrieval.top_k(rows, _vector(spark, sf_dir), K.CHUNK_CANDIDATES, "vec_id").select("vec_id", F.round("cosine", 6).alias("cosine"))


@query(f"with {_Q0}, {_MEANS} select label, round({_COS}, 5) as cosine from m e, q order by {_COS} desc, label limit 24")
def vec_topk_entry(spark, sf_dir):
    means = entries.mean_vectors(_t(spark, sf_dir, "embeddings"), "label")
    return retrieval.top_k(means, _vector(spark, sf_dir), K.ENTRY_CANDIDATES, "label").select("label", F.round("cosine", 5).alias("cosine"))


@query(f"{_SCORED}, {_MEANS} select vec_id, label, round(c, 6) as cosine from s where label in (select label from (select label, {_COS} as c from m e, q order by c desc, label limit 6)) qualify row_number() over (partition by label order by c desc, vec_id) <= 4")
def vec_topk_per_entry(spark, sf_dir):
    rows, vector = _t(spark, sf_dir, "embeddings"), _vector(spark, sf_dir)
    best = retrieval.top_k(entries.mean_vectors(rows, "label"), vector, K.EXPANDED_ENTRIES, "label")
    return retrieval.top_per_group(retrieval.scored(rows, vector), best, "label", K.CHUNKS_PER_ENTRY, "vec_id").select("vec_id", "label", F.round("cosine", 6).alias("cosine"))


_LISTS = f"""{_SCORED}, u as (
  (select vec_id, label, c, 0 as l from s order by c desc, vec_id limit 42)
  union all select vec_id, label, c, 1 from (select *, row_number() over (partition by label order by c desc, vec_id) as n from s) where n <= 4
), d as (select vec_id, label, c, l from u qualify row_number() over (partition by vec_id order by c desc, l) = 1)"""


def _merged(spark, sf_dir) -> DataFrame:
    rows, vector = _t(spark, sf_dir, "embeddings"), _vector(spark, sf_dir)
    scored = retrieval.scored(rows, vector)
    return retrieval.merge_candidates([retrieval.top_k(rows, vector, 42, "vec_id"), retrieval.top_per_group(scored, scored.select("label"), "label", K.CHUNKS_PER_ENTRY, "vec_id")], "vec_id")


@query(f"{_LISTS} select vec_id, label, round(c, 6) as cosine from d")
def merge_candidates(spark, sf_dir):
    return _merged(spark, sf_dir).select("vec_id", "label", F.round("cosine", 6).alias("cosine"))


# A stand-in for the reranker's scores, from the id.
_RERANK_SQL = "(vec_id * 7919 % 1000) / 100.0 - 5.0"


def _rerank() -> Column:
    return F.pmod(F.col("vec_id") * 7919, F.lit(1000)) / 100.0 - 5.0


def _title_bonus_sql(q: str, t: str) -> str:
    return f"""case when len({q}) = 0 or len({t}) = 0 then 0.0 else
      case when array_to_string({q}, ' ') = array_to_string({t}, ' ') then 2.5 when contains(array_to_string({q}, ' '), array_to_string({t}, ' ')) then case when len({t}) >= 2 then 1.5 else 1.0 end else 0.0 end
      + 0.8 * len(list_filter(list_distinct({t}), lambda x: list_contains({q}, x))) / greatest(len(list_distinct({t})), 1)
      + case when len(list_distinct({t})) >= 2 and len(list_filter(list_distinct({t}), lambda x: list_contains({q}, x))) = len(list_distinct({t})) then 0.6 else 0.0 end end"""


def _tokens_sql(c: str, drop: bool = False) -> str:
    base = rf"list_filter(string_split(trim(regexp_replace(regexp_replace(replace(lower({c}), '’', ''''), '''s($|[^\pL\pN_])', '\1', 'g'), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')"
    stop = ", ".join(f"'{w}'" for w in K.STOPWORDS)
    return f"list_filter({base}, lambda x: x not in ({stop}))" if drop else base


_QT = "'" + QUERY_TEXT.replace("'", "''") + "'"
_TOKENS = f"""with p as (select p_partkey, p_name, p_type, {_tokens_sql(_QT, True)} as q, {_tokens_sql("p_name")} as t0, {_tokens_sql("p_type", True)} as s from part),
t as (select *, list_filter(string_split(regexp_replace(array_to_string(t0, ' '), '^((a|an|the)( |$))+', ''), ' '), lambda x: x <> '') as t from p)"""


@query(f"{_TOKENS} select p_partkey, array_to_string(t0, ' ') as tokens, array_to_string(list_filter(t0, lambda x: x not in ({', '.join(repr(w) for w in K.STOPWORDS)})), ' ') as kept from t")
def lexical_tokens(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", F.array_join(tx.lexical_tokens(F.col("p_name")), " ").alias("tokens"), F.array_join(tx.lexical_tokens(F.col("p_name"), True), " ").alias("kept"))


@query(f"{_TOKENS} select p_partkey, round(cast({_title_bonus_sql('q', 't')} as double), 6) as bonus from t")
def title_bonus(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", F.round(tx.title_bonus(F.lit(QUERY_TEXT), F.col("p_name")), 6).alias("bonus"))


@query(f"""{_TOKENS} select p_partkey, round(cast(case when len(q) = 0 or len(s) = 0 then 0.0 else 0.4 * len(list_filter(list_distinct(s), lambda x: list_contains(q, x))) / greatest(len(list_distinct(s)), 1)
  + case when len(s) >= 2 and contains(array_to_string(q, ' '), array_to_string(s, ' ')) then 0.5 else 0.0 end end as double), 6) as bonus from t""")
def section_bonus(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", F.round(tx.section_bonus(F.lit(QUERY_TEXT), F.col("p_type")), 6).alias("bonus"))


@query(f"""{_TOKENS}, {_Q0}, e as (select vec_id, {_RERANK_SQL} as rerank, {_COS} as c from embeddings e, q)
select vec_id, round(cast(rerank + c + {_title_bonus_sql('q', 't')} as double), 6) as final from e join t on vec_id = p_partkey""".replace("embeddings e, q)", "embeddings e, q0 q)").replace("q as (select embedding", "q0 as (select embedding"))
def fuse_entry_scores(spark, sf_dir):
    rows = retrieval.scored(_t(spark, sf_dir, "embeddings"), _vector(spark, sf_dir)).select("vec_id", _rerank().alias("rerank"), "cosine")
    rows = rows.join(_t(spark, sf_dir, "part"), F.col("vec_id") == F.col("p_partkey"))
    return rows.select("vec_id", F.round(retrieval.entry_score(F.col("rerank"), F.col("cosine"), tx.title_bonus(F.lit(QUERY_TEXT), F.col("p_name"))), 6).alias("final"))


_SECTION_SQL = """case when len(q) = 0 or len(s) = 0 then 0.0 else 0.4 * len(list_filter(list_distinct(s), lambda x: list_contains(q, x))) / greatest(len(list_distinct(s)), 1)
  + case when len(s) >= 2 and contains(array_to_string(q, ' '), array_to_string(s, ' ')) then 0.5 else 0.0 end end"""
_FUSED = f"""{_LISTS}, m as (select label, avg(c) as c, avg({_RERANK_SQL}) as r from d group by label), parents as (select label, r + c as final from m order by final desc, label limit 6),
{_TOKENS[5:]}, b as (select p_partkey as vec_id, {_title_bonus_sql("q", "t")} as title, {_SECTION_SQL} as section from t),
f as (select vec_id, label, c, {_RERANK_SQL} as rerank, {_RERANK_SQL} + 0.75 * c + 0.8 * greatest(coalesce(final, 0.0), 0.0) + 0.35 * coalesce(title, 0.0) + 0.2 * coalesce(section, 0.0) as final from d left join parents using (label) left join b using (vec_id)),
r as (select *, row_number() over (order by final desc, c desc, vec_id) as rank from f),
g as (select * from r where not exists (select 1 from r where rank = 1 and rerank < -2.0 and c < 0.3))"""


def _fused(spark, sf_dir) -> DataFrame:
    rows = store.written(_merged(spark, sf_dir).select("vec_id", "label", "cosine").withColumn("rerank", _rerank()), "candidates")
    means = rows.groupBy("label").agg(F.avg("cosine").alias("c"), F.avg("rerank").alias("r"))
    parents = means.select("label", (F.col("r") + F.col("c")).alias("final")).orderBy(F.desc("final"), "label").limit(K.EXPANDED_ENTRIES)
    rows = retrieval.with_parent(rows, parents, "label")
    q, titles = F.lit(QUERY_TEXT), _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("vec_id"), "p_name", "p_type")
    title, section = (F.coalesce(bonus(q, F.col(c)), F.lit(0.0)) for bonus, c in ((tx.title_bonus, "p_name"), (tx.section_bonus, "p_type")))
    rows = rows.join(titles, "vec_id", "left").withColumn("final", retrieval.chunk_score(F.col("rerank"), F.col("cosine"), F.col("parent"), title, section))
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("final"), F.desc("cosine"), "vec_id")))


@query(f"{_FUSED} select vec_id, label, round(cast(final as double), 6) as final from r")
def fuse_chunk_scores(spark, sf_dir):
    return _fused(spark, sf_dir).select("vec_id", "label", F.round("final", 6).alias("final"))


@query(f"{_FUSED} select vec_id, rank from g")
def low_confidence_gate(spark, sf_dir):
    return retrieval.confident(_fused(spark, sf_dir)).select("vec_id", F.col("rank").cast("long").alias("rank"))


@query(f"{_FUSED} select vec_id, rank, round(cast(final as double), 6) as final from g where rank between 8 and 14")
def page_window(spark, sf_dir):
    return retrieval.page(retrieval.confident(_fused(spark, sf_dir)), 7, 7).select("vec_id", F.col("rank").cast("long").alias("rank"), F.round("final", 6).alias("final"))


@query(f"select q.vec_id as query_id, e.vec_id, round({_COS}, 6) as cosine, row_number() over (partition by q.vec_id order by {_COS} desc, e.vec_id) as rank from embeddings e, (select * from embeddings where vec_id < 25) q qualify rank <= 3")
def batch_eval_topk(spark, sf_dir):
    rows = _t(spark, sf_dir, "embeddings")
    queries = rows.filter("vec_id < 25").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))  # the 25 stated queries
    found = similarity.batch_top_k(queries, rows, K.EVAL_RESULTS, "query_id", "vec_id")
    return found.select("query_id", "vec_id", F.round("cosine", 6).alias("cosine"), F.col("rank").cast("long").alias("rank"))


@query("select split_part(url, '#', 1) as page_url, min(page_id) as start, count(*) as passages from pages group by 1")
def group_results_by_entry(spark, sf_dir):
    return retrieval.group_by_entry(_t(spark, sf_dir, "pages").select("url", (F.col("page_id") + 1).alias("rank")))


# --- texts -----------------------------------------------------------------------------------------------------------

_STRIP = f"'^{K.WS}+|{K.WS}+$', '', 'g'"


def _norm_sql(c: str) -> str:
    """normalize_whitespace for texts without garbled characters."""
    return f"regexp_replace(regexp_replace(regexp_replace(replace({c}, chr(160), ' '), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), {_STRIP})"


_W = f"regexp_extract_all(text, '{_WORDS}')"
_NW = f"regexp_extract_all({_norm_sql('text')}, '{_WORDS}')"


@query(f"select doc_id, {_norm_sql('text')} as text from documents")
def normalize_ws(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", tx.normalize_whitespace(F.col("text")).alias("text"))


@query(f"select doc_id, cast(len({_W}) as int) as words from documents")
def word_count(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", tx.word_count(F.col("text")).alias("words"))


@query(f"select doc_id, case when len({_W}) <= 220 then regexp_replace(text, {_STRIP}) else array_to_string({_W}[1:220], ' ') end as text from documents")
def truncate_words(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", tx.truncate_words(F.col("text"), K.RERANK_OVERVIEW_WORDS).alias("text"))


@query(f"select doc_id, array_to_string({_NW}[1:350], ' ') as text from documents")
def trim_words(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", tx.trim_to_words(F.col("text"), K.INTRO_WORDS).alias("text"))


@query(f"select doc_id, array_to_string({_NW}[-40:], ' ') as text from documents")
def tail_words(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", tx.trailing_words(F.col("text"), K.OVERLAP_WORDS).alias("text"))


@query(f"""with f as (select doc_id, array_to_string({_W}, ' ') as flat from documents), c as (select *, flat[1:220] as cut, 220 - instr(reverse(flat[1:220]), ' ') as space from f)
select doc_id, case when length(flat) <= 220 then flat else rtrim(case when instr(cut, ' ') > 0 and space > 132 then cut[1:space] else cut end) || '...' end as text from c""")
def snippet(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", tx.snippet(F.col("text"), K.EVAL_SNIPPET).alias("text"))


@query("select doc_id, text, true as intact from documents")
def mojibake_roundtrip(spark, sf_dir):
    garbled = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return _t(spark, sf_dir, "documents").withColumn("back", tx.fix_mojibake(garbled)).select("doc_id", F.col("back").alias("text"), (F.col("back") == F.col("text")).alias("intact"))


@query(f"""with h as (select distinct source, sha1(unhex('{K.ENTRY_NAMESPACE.replace("-", "")}') || encode(source)) as h from documents)
select source, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || translate(h[17:17], '0123456789abcdef', '89ab89ab89ab89ab') || h[18:20] || '-' || h[21:32] as id from h""")
def uuid5_ids(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("source").distinct().select("source", tx.uuid5(F.col("source")).alias("id"))


_PARA = f"replace(text, chr(10), chr(10) || chr(10))"


@query(f"""with p as (select doc_id, list_filter(list_transform(regexp_split_to_array({_norm_sql(_PARA)}, '\\n{K.WS}*\\n'), lambda x: {_norm_sql('x')}), lambda x: x <> '') as p from documents)
select doc_id, cast(len(p) as int) as n, array_to_string(p, '|') as paragraphs from p""")
def split_paragraphs(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select("doc_id", tx.normalize_whitespace(F.replace("text", F.lit("\n"), F.lit("\n\n"))).alias("t"))
    return rows.select("doc_id", chunking.split_paragraphs(F.col("t")).alias("p")).select("doc_id", F.size("p").alias("n"), F.array_join("p", "|").alias("paragraphs"))


@query(f"""with n as (select doc_id, {_norm_sql('text')} as t from documents), m as (select doc_id, t, regexp_replace(t, '([.!?]){K.WS}+(["''(\\[]?[A-Z0-9])', '\\1' || chr(1) || '\\2', 'g') as s from n),
s as (select doc_id, list_filter(list_transform(string_split(case when contains(s, chr(1)) then s else regexp_replace(t, '([.!?]){K.WS}+', '\\1' || chr(1), 'g') end, chr(1)), lambda x: regexp_replace(x, {_STRIP})), lambda x: x <> '') as p from m)
select doc_id, cast(len(p) as int) as n, md5(array_to_string(p, '|')) as digest from s""")
def split_sentences(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select("doc_id", tx.normalize_whitespace(F.col("text")).alias("t")).select("doc_id", chunking.split_sentences(F.col("t")).alias("p"))
    return rows.select("doc_id", F.size("p").alias("n"), F.md5(F.array_join("p", "|")).alias("digest"))


@query(f"""with w as (select doc_id, {_NW} as w from documents)
select doc_id, cast(i // 350 as int) as chunk_index, array_to_string(w[i + 1:i + 350], ' ') as chunk_text from (select doc_id, w, unnest(range(0, len(w), 350)) as i from w)""")
def chunk_words(spark, sf_dir):
    # outer, since a plain explode brings a filter on the size, which makes the windows once more
    rows = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode_outer(chunking.word_windows("text")).alias("chunk_index", "chunk_text"))
    return rows.filter("chunk_text is not null")


def _sentences_sql(t: str) -> str:
    """The sentences of a text with normalised white space, as in split_sentences."""
    strong = f"regexp_replace({t}, '([.!?]){K.WS}+([\"''(\\[]?[A-Z0-9])', '\\1' || chr(1) || '\\2', 'g')"
    weak = f"regexp_replace({t}, '([.!?]){K.WS}+', '\\1' || chr(1), 'g')"
    return f"list_filter(list_transform(string_split(case when contains({strong}, chr(1)) then {strong} else {weak} end, chr(1)), lambda x: regexp_replace(x, {_STRIP})), lambda x: x <> '')"


def _packed_sql(items: str, joint: str) -> str:
    """Chunks of a list of (t, n, parts): parts stand for an item of over 400 words."""
    full = "len(a.t) > 0 and a.n + x.n > 400 and (a.n >= 300 or 300 - a.n <= a.n + x.n - 400)"
    step = f"""case when x.n > 400 then struct_pack(t := '', n := cast(0 as bigint), parts := a.parts || case when len(a.t) > 0 then [a.t] else [] end || x.parts)
      when {full} then struct_pack(t := x.t, n := x.n, parts := a.parts || [a.t])
      else struct_pack(t := case when len(a.t) > 0 then a.t || {joint} || x.t else x.t end, n := a.n + x.n, parts := a.parts) end"""
    folded = f"list_reduce(list_prepend(struct_pack(t := '', n := cast(0 as bigint), parts := cast([] as varchar[])), {items}), lambda a, x: {step})"
    return f"list_transform([{folded}], lambda f: f.parts || case when len(f.t) > 0 then [f.t] else [] end)[1]"


def _n_words_sql(t: str) -> str:
    return f"cast(len(regexp_extract_all({t}, '{_WORDS}')) as bigint)"




@query(f"""with n as (select doc_id, {_n_words_sql("text")} as raw, {_norm_sql(_PARA)} as t from documents),
p as (select doc_id, generate_subscripts(ps, 1) as i, unnest(ps) as t from (select doc_id, list_filter(list_transform(regexp_split_to_array(t, '\\n{K.WS}*\\n'), lambda x: regexp_replace(x, {_STRIP})), lambda x: x <> '') as ps from n where raw > 400)),
pn as (select *, {_n_words_sql("t")} as n from p),
s as (select doc_id, i, generate_subscripts(ss, 1) as j, unnest(ss) as t from (select doc_id, i, {_sentences_sql("t")} as ss from pn where n > 400)),
sn as (select *, {_n_words_sql("t")} as n from s),
w as (select doc_id, i, j, list(array_to_string(ws[k + 1:k + 350], ' ') order by k) as parts from (select doc_id, i, j, ws, unnest(range(0, len(ws), 350)) as k from (select doc_id, i, j, regexp_extract_all(t, '{_WORDS}') as ws from sn where n > 400)) group by all),
si as (select doc_id, i, list(struct_pack(t := t, n := n, parts := coalesce(parts, cast([] as varchar[]))) order by j) as items from sn left join w using (doc_id, i, j) group by all),
sp as (select doc_id, i, {_packed_sql("items", "' '")} as parts from si),
pi as (select doc_id, list(struct_pack(t := t, n := n, parts := coalesce(parts, cast([] as varchar[]))) order by i) as items from pn left join sp using (doc_id, i) group by all),
base as (select doc_id, {_packed_sql("items", "chr(10) || chr(10)")} as parts from pi union all select doc_id, [t] from n where raw <= 400 and t <> ''),
c as (select doc_id, generate_subscripts(parts, 1) - 1 as chunk_index, unnest(parts) as t from base),
l as (select *, case when len(ss) = 0 then t else ss[-1] end as last from (select *, {_sentences_sql("t")} as ss from c)),
o as (select doc_id, chunk_index, t, lag(case when {_n_words_sql("last")} <= 80 then last else array_to_string(regexp_extract_all(last, '{_WORDS}')[-40:], ' ') end) over (partition by doc_id order by chunk_index) as before from l),
h as (select *, sha1(unhex('{K.ENTRY_NAMESPACE.replace("-", "")}') || encode(doc_id || '/' || chunk_index)) as h from o)
select doc_id, cast(chunk_index as int) as chunk_index, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || translate(h[17:17], '0123456789abcdef', '89ab89ab89ab89ab') || h[18:20] || '-' || h[21:32] as chunk_id,
  case when before is null or before = '' or starts_with(t, before) then t else before || chr(10) || chr(10) || t end as chunk_text from h""")
def chunk_sections(spark, sf_dir):
    text = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    rows = _t(spark, sf_dir, "documents").select("doc_id", text.alias("section_text"))
    return chunking.chunk_sections(rows, ["doc_id"]).select("doc_id", "chunk_index", "chunk_id", "chunk_text")


@query("select item_id, sha256(encode('7') || unhex('00') || encode(text)) as cache_key from benchmark")
def cache_keys(spark, sf_dir):
    return _t(spark, sf_dir, "benchmark").select("item_id", tx.cache_key(F.col("text"), F.lit(7)).alias("cache_key"))


# --- entries ---------------------------------------------------------------------------------------------------------

_SECTIONS = f"""s as (select cast(conv_id as varchar) as slug, turn, role, {_norm_sql('text')} as t from conversations),
n as (select *, regexp_extract_all(t, '{_WORDS}') as w from s),
b as (select *, 350 - coalesce(sum(len(w)) over (partition by slug order by turn rows between unbounded preceding and 1 preceding), 0) as room from n),
e as (select slug, count(*) as section_count, string_agg((turn + 1) || '. ' || role, chr(10) order by turn) as outline,
  coalesce(string_agg(array_to_string(w[1:room], ' '), chr(10) || chr(10) order by turn) filter (where room > 0 and len(w) > 0), '') as intro from b group by slug)"""


def _sections(spark, sf_dir) -> DataFrame:
    c = _t(spark, sf_dir, "conversations")
    slug = F.col("conv_id").cast("string")
    return c.select(F.col("turn").alias("section_ord"), slug.alias("entry_slug"), F.concat(F.lit("Entry "), slug).alias("entry_title"), (F.col("turn") + 1).cast("string").alias("section_number"), F.col("role").alias("section_title"), F.col("text").alias("section_text"), F.concat(F.lit("http://host/entries/"), slug, F.lit("/#"), F.col("turn").cast("string")).alias("url"))


@query(f"""with {_SECTIONS} select slug as entry_slug, 'Entry ' || slug as entry_title, 'http://host/entries/' || slug || '/' as url, section_count, outline as section_outline, intro as intro_text,
  'Entry: Entry ' || slug || chr(10) || chr(10) || 'Section headings:' || chr(10) || outline || case when intro <> '' then chr(10) || chr(10) || 'Overview:' || chr(10) || intro else '' end as search_text from e""")
def entry_documents(spark, sf_dir):
    return entries.entry_documents(_sections(spark, sf_dir)).drop("entry_id")


@query(f"""with {_SECTIONS} select slug as entry_slug, 'Entry: Entry ' || slug || chr(10) || chr(10) || 'Section headings:' || chr(10) || array_to_string(string_split(outline, chr(10))[1:18], chr(10))
  || case when intro <> '' then chr(10) || chr(10) || 'Overview:' || chr(10) || case when len(regexp_extract_all(intro, '{_WORDS}')) <= 220 then intro else array_to_string(regexp_extract_all(intro, '{_WORDS}')[1:220], ' ') end else '' end as rerank_text from e""")
def rerank_text_entry(spark, sf_dir):
    e = entries.entry_documents(_sections(spark, sf_dir))
    return e.select("entry_slug", tx.rerank_text_of_entry(F.col("entry_title"), F.col("section_outline"), F.col("intro_text")).alias("rerank_text"))


@query("select conv_id, turn, 'Entry: ' || conv_id || chr(10) || 'Section: ' || role || chr(10) || 'Passage: ' || text as rerank_text from conversations")
def rerank_text_chunk(spark, sf_dir):
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", tx.rerank_text_of_chunk(F.col("conv_id").cast("string"), F.col("role"), F.col("text")).alias("rerank_text"))


@query("select label, place - 1 as place, round(avg(x::double), 5) as mean from (select label, unnest(embedding) as x, generate_subscripts(embedding, 1) as place from embeddings) group by all")
def vector_mean(spark, sf_dir):
    m = entries.mean_vectors(_t(spark, sf_dir, "embeddings"), "label").select("label", F.posexplode("embedding").alias("place", "mean"))
    return m.select("label", F.col("place").cast("long").alias("place"), F.round(F.col("mean").cast("double"), 5).alias("mean"))


@query("""with n as (select vec_id, list_transform(embedding::double[], lambda x: x * (1 + vec_id)) as v from embeddings)
select vec_id, round(list_sum(list_transform(v, lambda x: x * x / list_dot_product(v, v))), 6) as length, round(v[1] / sqrt(list_dot_product(v, v)), 6) as first from n""")
def l2_normalize(spark, sf_dir):
    rows = _t(spark, sf_dir, "embeddings").select("vec_id", unit(F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("vec_id")))).alias("u"))
    return rows.select("vec_id", F.round(F.aggregate("u", F.lit(0.0), lambda s, x: s + x * x), 6).alias("length"), F.round(F.get("u", F.lit(0)), 6).alias("first"))


# --- graph -----------------------------------------------------------------------------------------------------------

_SIM = "list_dot_product(a.embedding::double[], b.embedding::double[]) / sqrt(list_dot_product(a.embedding::double[], a.embedding::double[]) * list_dot_product(b.embedding::double[], b.embedding::double[]))"
_PAIRS = f"p as (select a.vec_id as src, b.vec_id as dst, {_SIM} as s from embeddings a, embeddings b where a.vec_id <> b.vec_id and {_SIM} > 0.3)"
_MUTUAL = f"with {_PAIRS}, k as (select * from p qualify row_number() over (partition by src order by s desc, dst) <= 5), semantic as (select x.src, x.dst, x.s as similarity from k x join k y on x.src = y.dst and x.dst = y.src where x.src < x.dst)"


@query(f"with {_PAIRS} select src, dst, round(s, 6) as similarity from p")
def pairwise_cosine(spark, sf_dir):
    return similarity.similar_pairs(_t(spark, sf_dir, "embeddings"), 0.3, "vec_id").withColumn("similarity", F.round("similarity", 6))


def _semantic(spark, sf_dir) -> DataFrame:
    return graph.semantic_edges(_t(spark, sf_dir, "embeddings"), "vec_id", 0.3)


@query(f"{_MUTUAL} select src, dst, round(similarity, 6) as similarity from semantic")
def semantic_edges_mutual(spark, sf_dir):
    return _semantic(spark, sf_dir).withColumn("similarity", F.round("similarity", 6))


_LINKS = "l as (select 's' || l_suppkey as src, 'p' || l_partkey as dst, cast(count(*) as int) as weight from lineitem group by all)"
_EDGES = f"{_LINKS}, x as (select * from l where weight >= 2), u as (select src as slug, dst as neighbor from x union select dst, src from x)"


def _links(spark, sf_dir) -> DataFrame:
    i = _t(spark, sf_dir, "lineitem")
    # Grouped by the numbers: texts as keys take twice the memory.
    n = i.groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).cast("int").alias("weight"))
    return n.select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), "weight")


def _edges(spark, sf_dir) -> DataFrame:
    return _links(spark, sf_dir).filter("weight >= 2")


_VALID = "v as (select 's' || s_suppkey as slug from supplier union all select 'p' || p_partkey from part where p_size > 10)"


def _explicit(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    counts = _links(spark, sf_dir).groupBy("src").agg(F.map_from_entries(F.collect_list(F.struct("dst", "weight"))).alias("outbound_link_counts"))
    sections = counts.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("section_ord"), F.col("src").alias("entry_slug"), "outbound_link_counts").withColumn("outbound_links", F.map_keys("outbound_link_counts"))
    # The second section's links differ and must not count.
    sections = sections.withColumn("outbound_link_counts", F.when(F.col("section_ord") == 0, F.col("outbound_link_counts")))
    supplier, part = _t(spark, sf_dir, "supplier"), _t(spark, sf_dir, "part").filter("p_size > 10")
    valid = supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("slug")).union(part.select(F.concat(F.lit("p"), "p_partkey")))
    return graph.explicit_edges(sections, valid)


@query(f"with {_LINKS}, {_VALID} select src, dst, weight from l where src in (select slug from v) and dst in (select slug from v)")
def explicit_edges(spark, sf_dir):
    return _explicit(spark, sf_dir)[0]


@query(f"with {_LINKS}, {_VALID} select src, count(*) as skipped from l where src in (select slug from v) and dst not in (select slug from v) group by src")
def skipped_targets(spark, sf_dir):
    return _explicit(spark, sf_dir)[1].groupBy("src").agg(F.count(F.lit(1)).alias("skipped"))


@query(f"with {_EDGES} select slug, neighbor from u")
def undirected_neighbors(spark, sf_dir):
    return graph.undirected(_edges(spark, sf_dir))


@query(f"with {_EDGES} select slug, string_agg(neighbor, ',' order by neighbor) as neighbors from u group by slug")
def neighbor_sets(spark, sf_dir):
    return graph.neighbor_sets(_edges(spark, sf_dir)).withColumn("neighbors", F.array_join("neighbors", ","))


_FULL = f"{_EDGES}, f as (select slug from u group by slug having count(distinct neighbor) >= 3), i as (select x.* from x where src in (select slug from f) and dst in (select slug from f))"


@query(f"with {_FULL} select slug from f")
def full_graph_nodes(spark, sf_dir):
    return graph.well_linked(_edges(spark, sf_dir))


@query(f"with {_FULL} select src, dst, weight from i")
def induced_edges(spark, sf_dir):
    e = _edges(spark, sf_dir)
    return graph.induced(e, graph.well_linked(e)).select("src", "dst", "weight")


@query(f"with {_FULL}, d as (select slug, count(*) as degree from (select src as slug, dst as o from i union select dst, src from i) group by slug) select slug, coalesce(degree, 0) as degree from f left join d using (slug)")
def node_degrees(spark, sf_dir):
    e = _edges(spark, sf_dir)
    nodes = graph.well_linked(e)
    return graph.degrees(nodes, graph.induced(e, nodes))


@query(f"with {_EDGES}, v as (select distinct slug from u), p as (select 'p' || p_partkey as slug from part where p_size > 10) select slug, 'vectors' as missing_in from v where slug not in (select slug from p) union all select slug, 'documents' from p where slug not in (select slug from v)")
def reconcile_slugs(spark, sf_dir):
    parts = _t(spark, sf_dir, "part").filter("p_size > 10").select(F.concat(F.lit("p"), "p_partkey").alias("slug"))
    return graph.reconcile(graph.undirected(_edges(spark, sf_dir)), parts)[1]


@query(f"""{_MUTUAL}, {_FULL}, m as (select 'p' || src as src, 'p' || dst as dst from semantic where 'p' || src in (select slug from f) and 'p' || dst in (select slug from f)),
c as (select (select count(*) from f) as n, (select count(*) from i) as e, (select count(*) from m) as s) select unnest(['nodes', 'explicit_edges', 'semantic_edges', 'condensed']) as what, unnest([n, e, s, cast(s > least(18000, greatest(10000, n * 12)) as bigint)]) as n from c""")
def graph_summary(spark, sf_dir):
    e = _edges(spark, sf_dir)
    nodes = graph.well_linked(e)
    semantic = _semantic(spark, sf_dir).select(*[F.concat(F.lit("p"), c).alias(c) for c in ("src", "dst")])
    return graph.summary(nodes, graph.induced(e, nodes), graph.induced(semantic, nodes))


_HOP = f"{_EDGES}, h1 as (select 's1' as slug union select neighbor from u where slug = 's1'), h2 as (select slug from h1 union select neighbor from u where slug in (select slug from h1))"


@query(f"with {_HOP} select slug from h1")
def neighborhood_1hop(spark, sf_dir):
    return graph.neighborhood("s1", 1, _edges(spark, sf_dir))


@query(f"with {_HOP} select slug from h2")
def neighborhood_2hop(spark, sf_dir):
    return graph.neighborhood("s1", 2, _edges(spark, sf_dir))


@query(f"""{_MUTUAL}, x as (select cast(vec_id as varchar) as src, cast(vec_id + 1 as varchar) as dst from embeddings), n as (select dst as s from x where src = '7' union select src from x where dst = '7')
select src, dst, round(similarity + case when src = 7 or dst = 7 then 2 when cast(src as varchar) in (select s from n) or cast(dst as varchar) in (select s from n) then 0.6 else 0 end, 6) as score from semantic""")
def edge_score(spark, sf_dir):
    near = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("src"), (F.col("vec_id") + 1).alias("dst"))
    return graph.scored_edges(_semantic(spark, sf_dir), near, 7).select("src", "dst", F.round("score", 6).alias("score"))


# Edges in order; each is taken if both ends have room among those taken before it.
@query(f"""{_MUTUAL}, x as (select vec_id as src, vec_id + 1 as dst from embeddings), n as (select dst as s from x where src = 7 union select src from x where dst = 7),
e as (select src, dst, similarity, similarity + case when src = 7 or dst = 7 then 2 when src in (select s from n) or dst in (select s from n) then 0.6 else 0 end as score from semantic),
r as (select list_reduce(list_prepend(struct_pack(src := -1::bigint, dst := -1::bigint, taken := cast([] as struct(src bigint, dst bigint)[])), list(struct_pack(src := src, dst := dst, taken := cast([] as struct(src bigint, dst bigint)[])) order by score desc, similarity desc, src desc, dst desc)),
  lambda a, x: struct_pack(src := x.src, dst := x.dst, taken := case when len(a.taken) < 300
    and len(list_filter(a.taken, lambda t: t.src = x.src or t.dst = x.src)) < case when x.src = 7 then 4 else 2 end
    and len(list_filter(a.taken, lambda t: t.src = x.dst or t.dst = x.dst)) < case when x.dst = 7 then 4 else 2 end
    then list_append(a.taken, struct_pack(src := x.src, dst := x.dst)) else a.taken end)) as f from e)
select src, dst, round(similarity, 6) as similarity, round(score, 6) as score from e where (select count(*) from e) <= 300 or list_contains((select f.taken from r), struct_pack(src := src, dst := dst))""")
def edge_thinning(spark, sf_dir):
    near = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("src"), (F.col("vec_id") + 1).alias("dst"))
    scored = graph.scored_edges(_semantic(spark, sf_dir), near, 7)
    taken = graph.thinned_edges(store.written(scored, "scored"), 300, 2, 7)
    return taken.select("src", "dst", F.round("similarity", 6).alias("similarity"), F.round("score", 6).alias("score"))


@query(f"with {_FULL}, d as (select slug, count(*) as degree from (select src as slug, dst as o from i union select dst, src from i) group by slug) select slug, coalesce(degree, 0) as degree, row_number() over (order by coalesce(degree, 0), slug) as place from f left join d using (slug)")
def drawing_order(spark, sf_dir):
    return graph.drawing_order(node_degrees(spark, sf_dir))


@query(f"with {_FULL}, d as (select slug, count(*) as degree from (select src as slug, dst as o from i union select dst, src from i) group by slug) select slug, coalesce(degree, 0) as degree from f left join d using (slug)")
def node_degrees(spark, sf_dir):
    e = _edges(spark, sf_dir)
    nodes = graph.well_linked(e)
    return graph.degrees(nodes, graph.induced(e, nodes))


@query(f"with {_EDGES}, v as (select distinct slug from u), p as (select 'p' || p_partkey as slug from part where p_size > 10) select slug, 'vectors' as missing_in from v where slug not in (select slug from p) union all select slug, 'documents' from p where slug not in (select slug from v)")
def reconcile_slugs(spark, sf_dir):
    parts = _t(spark, sf_dir, "part").filter("p_size > 10").select(F.concat(F.lit("p"), "p_partkey").alias("slug"))
    return graph.reconcile(graph.undirected(_edges(spark, sf_dir)), parts)[1]


@query(f"""{_MUTUAL}, {_FULL}, m as (select 'p' || src as src, 'p' || dst as dst from semantic where 'p' || src in (select slug from f) and 'p' || dst in (select slug from f)),
c as (select (select count(*) from f) as n, (select count(*) from i) as e, (select count(*) from m) as s) select unnest(['nodes', 'explicit_edges', 'semantic_edges', 'condensed']) as what, unnest([n, e, s, cast(s > least(18000, greatest(10000, n * 12)) as bigint)]) as n from c""")
def graph_summary(spark, sf_dir):
    e = _edges(spark, sf_dir)
    nodes = graph.well_linked(e)
    semantic = _semantic(spark, sf_dir).select(*[F.concat(F.lit("p"), c).alias(c) for c in ("src", "dst")])
    return graph.summary(nodes, graph.induced(e, nodes), graph.induced(semantic, nodes))


_HOP = f"{_EDGES}, h1 as (select 's1' as slug union select neighbor from u where slug = 's1'), h2 as (select slug from h1 union select neighbor from u where slug in (select slug from h1))"


@query(f"with {_HOP} select slug from h1")
def neighborhood_1hop(spark, sf_dir):
    return graph.neighborhood("s1", 1, _edges(spark, sf_dir))


@query(f"with {_HOP} select slug from h2")
def neighborhood_2hop(spark, sf_dir):
    return graph.neighborhood("s1", 2, _edges(spark, sf_dir))


@query(f"""{_MUTUAL}, x as (select cast(vec_id as varchar) as src, cast(vec_id + 1 as varchar) as dst from embeddings), n as (select dst as s from x where src = '7' union select src from x where dst = '7')
select src, dst, round(similarity + case when src = 7 or dst = 7 then 2 when cast(src as varchar) in (select s from n) or cast(dst as varchar) in (select s from n) then 0.6 else 0 end, 6) as score from semantic""")
def edge_score(spark, sf_dir):
    near = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("src"), (F.col("vec_id") + 1).alias("dst"))
    return graph.scored_edges(_semantic(spark, sf_dir), near, 7).select("src", "dst", F.round("score", 6).alias("score"))


@query()
def edge_thinning(spark, sf_dir):
    """Greedy by a total order: tests hold it against the sequential rule."""
    near = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("src"), (F.col("vec_id") + 1).alias("dst"))
    scored = graph.scored_edges(_semantic(spark, sf_dir), near, 7)
    return graph.thinned_edges(store.written(scored, "scored"), 300, 2, 7)


@query(f"with {_FULL}, d as (select slug, count(*) as degree from (select src as slug, dst as o from i union select dst, src from i) group by slug), g as (select slug, coalesce(degree, 0) as degree from f left join d using (slug)) select slug, degree, round(4.5 + 8.5 * sqrt(degree / greatest((select max(degree) from g), 1)), 6) as radius from g")
def node_radius(spark, sf_dir):
    return graph.node_radius(node_degrees(spark, sf_dir)).withColumn("radius", F.round("radius", 6))


@query(f"with {_EDGES} select src, dst, weight, round(0.8 + coalesce(2.4 * (weight - 1) / nullif(greatest((select max(weight) from x), 1) - 1, 0), 0), 6) as width from x")
def edge_width(spark, sf_dir):
    return graph.edge_width(_edges(spark, sf_dir)).withColumn("width", F.round("width", 6))


@query(f"{_MUTUAL} select src, dst, round(0.05 + 0.15 * (similarity - lo) / (hi - lo), 6) as opacity from semantic, (select least(min(similarity), 0.5) as lo, greatest(max(similarity), 0.9) as hi from semantic)")
def edge_opacity(spark, sf_dir):
    return graph.edge_opacity(_semantic(spark, sf_dir)).select("src", "dst", F.round("opacity", 6).alias("opacity"))


# --- pages -----------------------------------------------------------------------------------------------------------


def _pages(spark, sf_dir) -> DataFrame:
    return html.parse_pages(_t(spark, sf_dir, "pages"), "article", headings=["h1"])


@query(f"""select page_id, regexp_replace(regexp_replace(replace(replace(replace(replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '{K.WS}+', ' ', 'g'), {_STRIP}) as title from pages""")
def html_title(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", "title")


@query(r"""with a as (select page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) as h from pages)
select page_id, case when h like '/%' then regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || h else h end as href, count(*) as links from a group by all""")
def html_links(spark, sf_dir):
    parsed = html.parse_pages(_t(spark, sf_dir, "pages"), "html")
    return parsed.select("page_id", F.explode("hrefs").alias("href")).groupBy("page_id", "href").agg(F.count(F.lit(1)).alias("links"))


def _shown_sql(t: str) -> str:
    """What a reader sees of a string between tags."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "''"), ("&#39;", "''"), ("&nbsp;", "\u00a0"), ("&amp;", "&")):
        t = f"replace({t}, '{entity}', '{char}')"
    return f"regexp_replace(regexp_replace({t}, '{K.WS}+', ' ', 'g'), {_STRIP})"


def _strings_sql(t: str) -> str:
    """The strings of a piece of HTML, stripped, with a space between them."""
    return f"array_to_string(list_filter(list_transform(regexp_split_to_array({t}, '<[^>]*>'), lambda x: {_shown_sql('x')}), lambda x: x <> ''), ' ')"


# Paragraphs of these pages are closed, up to one that opens <b> and leaves it open: all that follows is inside it.
@query(f"""with a as (select page_id, regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1) as a from pages),
r as (select page_id, regexp_extract(a, '(?s)<h1[^>]*>(.*?)</h1>', 1) as h, regexp_extract(a, '(?s)</h1>(.*)$', 1) as rest from a),
c as (select page_id, h, case when contains(rest, '<p><b>') then split_part(rest, '<p><b>', 1) else rest end as closed, case when contains(rest, '<p><b>') then rest[instr(rest, '<p><b>'):] else '' end as opened from r),
b as (select page_id, {_strings_sql("h")} as heading, list_filter(list_transform(regexp_extract_all(closed, '(?s)<p>(.*?)</p>', 1), lambda p: {_strings_sql("p")}) || [{_strings_sql("opened")}], lambda x: x <> '') as blocks from c)
select page_id, 0 as section_ord, coalesce(blocks[1], '') as lead, heading, array_to_string(blocks, chr(10) || chr(10)) as text from b where len(blocks) > 0""")
def html_sections(spark, sf_dir):
    rows = _pages(spark, sf_dir).select("page_id", "lead", F.posexplode("sections").alias("section_ord", "s"))
    return rows.select("page_id", "section_ord", "lead", F.col("s.heading").alias("heading"), F.col("s.text").alias("text"))


@query(r"select page_id, regexp_extract('http://h.org/entries' || regexp_extract(url, '^[a-z]+://[^/?#]*(.*)$', 1), '^[^?#]*/entries/([^/?#]+)/*(?:[?#].*)?$', 1) as slug from pages")
def url_normalize(spark, sf_dir):
    made = F.concat(F.lit("http://h.org/entries"), F.regexp_extract("url", r"^[a-z]+://[^/?#]*(.*)$", 1))
    return _t(spark, sf_dir, "pages").select("page_id", F.coalesce(tx.slug_of(tx.entry_url(made)), F.lit("")).alias("slug"))


@query("select page_id, split_part(url, '#', 1) as base from pages")
def url_base(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", tx.base_url(F.col("url")).alias("base"))


@query(r"select page_id, nullif(regexp_extract(split_part(url, '#', 1), '[?&]page=([^&#]*)', 1), '') as page from pages")
def url_param(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", tx.url_parameter(F.col("url"), "page").alias("page"))


# --- labels ----------------------------------------------------------------------------------------------------------

_SPELLINGS = [*K.ALIASES, "unknown"]


def _spelling() -> Column:
    names = F.array(*[F.lit(f" {a.upper()} ;") for a in _SPELLINGS])
    return F.get(names, F.pmod(F.col("doc_id"), F.lit(len(_SPELLINGS))).cast("int"))


_ALIAS_SQL = "list_extract([" + ", ".join([*[f"'{v}'" for v in K.ALIASES.values()], "null"]) + f"], doc_id % {len(_SPELLINGS)} + 1)"
_TOPIC_SQL = "list_extract([" + ", ".join(f"'{v}'" for v in K.TOPIC_LABELS.values()) + "], doc_id % 20 + 1)"


@query(f"select doc_id, {_ALIAS_SQL} as label, case when {_ALIAS_SQL} is null then '{K.DEFAULT_COLOR}' else case {_ALIAS_SQL} {' '.join(f'''when '{k}' then '{v}' ''' for k, v in K.COLORS.items())} end end as color from documents")
def label_alias(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select("doc_id", tx.label_of(_spelling(), K.ALIASES).alias("label"))
    return rows.withColumn("color", classify.color_of(F.col("label")))


def _payload() -> Column:
    """The first topic and the one after it have the same probability, from 0 to 0.30 by n_chars; a third has less."""
    p = F.format_string("%.2f", F.pmod(F.col("n_chars"), F.lit(31)) / 100.0)
    first, second = F.pmod(F.col("doc_id"), F.lit(20)).cast("string"), F.pmod(F.col("doc_id") + 1, F.lit(20)).cast("string")
    return F.concat(F.lit('[{"topics":{"99":-1.0,"'), first, F.lit('":'), p, F.lit(',"'), second, F.lit('":'), p, F.lit("}}]"))


@query(f"select doc_id, case when n_chars % 31 >= 15 then {_TOPIC_SQL} end as label from documents")
def topic_argmax(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", classify.topic_label(_payload()).alias("label"))


@query(f"""with r as (select doc_id, case when doc_id % 3 = 0 then {_ALIAS_SQL} end as p, case when n_chars % 31 >= 15 then {_TOPIC_SQL} end as t from documents)
select coalesce(p, t) as label, case when p is not null then 'page' when t is not null then 'topic' else 'none' end as source, count(*) as n from r group by all""")
def resolve_label(spark, sf_dir):
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("An entry. Category: "), F.get(F.array(*[F.lit(a) for a in _SPELLINGS]), F.pmod(F.col("doc_id"), F.lit(len(_SPELLINGS))).cast("int")), F.lit("."))).otherwise("no field")
    page = classify.page_label(F.array(F.lit("a page"), F.lit("utf-8")), text)
    rows = _t(spark, sf_dir, "documents").select(classify.resolved(page, classify.topic_label(_payload())).alias("r"))
    return rows.groupBy("r.label", "r.source").agg(F.count(F.lit(1)).alias("n"))


@query("select c_name as entry_slug, c_mktsegment as entry_title, c_name as url, cast(null as varchar) as subdiscipline from customer where c_custkey % 2 = 0")
def label_work_list(spark, sf_dir):
    rows = _t(spark, sf_dir, "customer").select(F.col("c_name").alias("entry_slug"), F.col("c_mktsegment").alias("entry_title"), F.col("c_name").alias("url"), F.when(F.col("c_custkey") % 2 == 1, "Logic").alias("subdiscipline"))
    return classify.work_list(rows, only_missing=True)


# --- tables ----------------------------------------------------------------------------------------------------------


@query("select c_custkey, case when c_custkey % 3 = 0 then upper(c_name) else c_name end as c_name, case when c_custkey % 3 = 0 then 0.0 else c_acctbal end as c_acctbal from customer union all select c_custkey + 1000000, c_name, c_acctbal from customer where c_custkey % 7 = 0")
def upsert_full(spark, sf_dir):
    old = _t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    changed = old.filter("c_custkey % 3 = 0").withColumns({"c_name": F.upper("c_name"), "c_acctbal": F.lit(0.0)}).withColumn("v", F.lit(2))
    stale = old.filter("c_custkey % 3 = 0").withColumn("v", F.lit(1))
    added = old.filter("c_custkey % 7 = 0").withColumn("c_custkey", F.col("c_custkey") + 1_000_000).withColumn("v", F.lit(1))
    return store.upsert(old, stale.unionByName(changed).unionByName(added), ["c_custkey"], "v")


@query("""select c_custkey, case when c_custkey % 3 = 0 then upper(c_name) else c_name end as c_name, c_acctbal from customer
union all select c_custkey + 1000000, upper(c_name), cast(-1.0 as double) from customer where c_custkey % 3 = 0""")
def upsert_partial(spark, sf_dir):
    old = _t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = old.filter("c_custkey % 3 = 0").select("c_custkey", F.upper("c_name").alias("c_name"), F.lit(-1.0).alias("fill"))
    new = new.union(new.withColumn("c_custkey", F.col("c_custkey") + 1_000_000))
    return store.upsert_columns(old, new, "c_custkey", ["c_name"], {"c_acctbal": "fill"})


@query("select c_custkey, case when c_custkey % 2 = 0 then case when c_custkey % 4 = 0 then c_mktsegment end else 'old' end as segment from customer")
def update_labels(spark, sf_dir):
    rows = _t(spark, sf_dir, "customer")
    values = rows.filter("c_custkey % 2 = 0").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, F.col("c_mktsegment")).alias("segment"))
    return store.update_column(rows.select("c_custkey", F.lit("old").alias("segment")), values, "c_custkey", "segment")


@query("""select * from (
  select 'unique o_custkey' as rule, count(*) as broken from (select o_custkey from orders group by 1 having count(*) > 1)
  union all select 'check total', count(*) from orders where not (o_totalprice > 100000)
  union all select 'dimension embedding', count(*) from embeddings where label = 3
  union all select 'reference o_custkey', count(*) from orders where o_custkey not in (select c_custkey from customer where c_acctbal > 0)
) where broken > 0""")
def constraint_violations(spark, sf_dir):
    customers = _t(spark, sf_dir, "customer").filter("c_acctbal > 0")
    cut = _t(spark, sf_dir, "embeddings").withColumn("embedding", F.slice("embedding", F.lit(1), F.when(F.col("label") == 3, 63).otherwise(64)))
    return store.violations(cut, ["vec_id"], ["label"], vectors={"embedding": 64}).unionByName(store.violations(_t(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"], checks={"total": "o_totalprice > 100000"}, references=[("o_custkey", customers, "c_custkey")]))


@query(f"with {_LINKS}, {_VALID} select src, dst, weight from l where src in (select slug from v) and dst in (select slug from v)")
def cascade_delete(spark, sf_dir):
    supplier, part = _t(spark, sf_dir, "supplier"), _t(spark, sf_dir, "part").filter("p_size > 10")
    left = supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("slug")).union(part.select(F.concat(F.lit("p"), "p_partkey")))
    return store.cascade_delete(_links(spark, sf_dir), left, "slug").select("src", "dst", "weight")


@query(SQL["upsert_full"])
def snapshot_upsert(spark, sf_dir):
    """Two commits; rows that come late, with a lower v, don't replace those that are there."""
    held = snapshots.Snapshots(spark, f"{store.shared_dir(spark)}/customers-{uuid.uuid4().hex}")
    old = _t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", F.lit(1).alias("v"))
    third = F.col("c_custkey") % 3 == 0
    added = old.filter("c_custkey % 7 = 0").withColumn("c_custkey", F.col("c_custkey") + 1_000_000)
    changed = old.withColumns({"c_name": F.when(third, F.upper("c_name")).otherwise("late"), "c_acctbal": F.when(third, 0.0).otherwise(-1.0), "v": F.when(third, 2).otherwise(0)})
    held.upsert("customers", old, ["c_custkey"], "v")
    held.upsert("customers", changed.unionByName(added), ["c_custkey"], "v", batch=("orders", 0))
    held.upsert("customers", old.withColumns({"c_name": F.lit("replayed"), "v": F.lit(9)}), ["c_custkey"], "v", batch=("orders", 0))
    return held.read("customers").drop("v")


@query(f"{_MUTUAL}, {_LINKS} select 'explicit' as kind, src, dst, cast(weight as double) as value from l union all select 'semantic', cast(src as varchar), cast(dst as varchar), round(similarity, 6) from semantic")
def snapshot_edges(spark, sf_dir):
    """Both kinds of edges, replaced by one commit and read from one version."""
    root = f"{store.shared_dir(spark)}/edges-{uuid.uuid4().hex}"
    snapshots.reload_edges(root, _links(spark, sf_dir), _semantic(spark, sf_dir))
    held = snapshots.Snapshots(spark, root)
    version = held.pointer()["version"]
    explicit, semantic = (held.read(t, version) for t in ("explicit_edges", "semantic_edges"))
    kinds = [(explicit, "explicit", F.col("weight").cast("double")), (semantic, "semantic", F.round("similarity", 6))]
    rows = [df.select(F.lit(kind).alias("kind"), *[F.col(c).cast("string").alias(c) for c in ("src", "dst")], value.alias("value")) for df, kind, value in kinds]
    return rows[0].union(rows[1])


@query("select doc_id, text, source, lang, cast(doc_id as varchar) || text as kept from documents")
def repair_nested(spark, sf_dir):
    """Garbled strings in structs, arrays and maps of a table come back; keys stay."""
    bad = lambda c: F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")
    rows = _t(spark, sf_dir, "documents").select("doc_id", F.array(F.struct(bad(F.col("text")).alias("t"), F.create_map(F.col("source"), bad(F.col("lang"))).alias("m"))).alias("deep"), F.concat(F.col("doc_id").cast("string"), bad(F.col("text"))).alias("kept"))
    back = store.repair_records(rows)
    return back.select("doc_id", F.col("deep")[0]["t"].alias("text"), F.map_keys(F.col("deep")[0]["m"])[0].alias("source"), F.map_values(F.col("deep")[0]["m"])[0].alias("lang"), "kept")


@query("select row_number() over (order by c_custkey) - 1 as section_ord, c_custkey, c_name, [c_mktsegment, '}]\"[{'] as tags, c_acctbal from customer")
def json_array_records(spark, sf_dir):
    """The customers as one JSON array in one file, read back in byte ranges, each with its place in the list."""
    path = f"{store.shared_dir(spark)}/array-{uuid.uuid4().hex}"
    rows = _t(spark, sf_dir, "customer").select("c_custkey", "c_name", F.array("c_mktsegment", F.lit('}]"[{')).alias("tags"), "c_acctbal")
    lines = html.placed(rows, "c_custkey").select("place", F.concat(F.when(F.col("place") == 1, "[").otherwise(","), F.to_json(F.struct(*rows.columns))).alias("value"))
    end = spark.range(1).select(F.lit((1 << 62)).alias("place"), F.lit("]").alias("value"))
    lines.unionByName(end).orderBy("place").coalesce(1).select("value").write.text(path)
    return json_array.read_records(spark, path, rows.schema)


@query("select conv_id, turn, role, text from conversations")
def json_lines(spark, sf_dir):
    """The conversations as JSON lines, written and read back."""
    rows = _t(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    path = f"{store.shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    store.write_records(rows, path)
    return store.read_lines(spark, path, rows.schema)


@query("select doc_id, row_number() over (order by n_chars, doc_id) as place from documents")
def document_places(spark, sf_dir):
    return html.placed(_t(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id").select("doc_id", "place")


@query(r"""with m as (select page_id, split_part(split_part(translate(regexp_extract(url, '^[a-z]+://[^/?#]*(.*)$', 1), '/', '-'), '?', 1), '#', 1) as slug from pages), f as (select slug, min(page_id) as pos from m where slug <> '' group by slug)
select 'http://h.org/entries/' || slug || '/' as url, pos, row_number() over (order by pos) as place from f""")
def listed_entries(spark, sf_dir):
    made = F.concat(F.lit("http://h.org/entries/"), F.translate(F.regexp_extract("url", r"^[a-z]+://[^/?#]*(.*)$", 1), "/", "-"))
    return html.listed_entries(_t(spark, sf_dir, "pages").select(F.col("page_id").alias("pos"), made.alias("href")))


@query("select count(*) as passages, count(distinct split_part(url, '#', 1)) as entries from pages")
def search_summary(spark, sf_dir):
    return retrieval.search_summary(_t(spark, sf_dir, "pages"))


# --- services --------------------------------------------------------------------------------------------------------


@query()
def graph_index_search(spark, sf_dir):
    """Approximate, so tests hold its recall against exact search: all vectors indexed, those divisible by 100 asked."""
    rows = _t(spark, sf_dir, "embeddings")
    index = store.written(graph_index.build_index(rows, "vec_id"), "graph-index")
    asked = rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = graph_index.search_index(index, asked, 10, exclude_self=True)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), F.round("cosine", 6).alias("cosine"))


@query()
def hybrid_search(spark, sf_dir):
    """Sections to chunks and entries, embedded by feature hashing, then one page of hybrid search. The models are stand-ins, so there is no SQL."""
    from .build import embedded

    sections = _sections(spark, sf_dir)
    chunks = embedded(chunking.chunk_sections(sections, ["entry_slug", "section_ord"]), "chunk_text")
    docs = embedded(entries.entry_documents(sections), "search_text")
    service = SearchService(store.written(chunks, "chunks"), store.written(docs, "entries"))
    return service.search("the thand ofon and then", result_limit=K.PAGE_SIZE)
