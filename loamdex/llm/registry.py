"""The registered queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from loamdex.session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


@query("op3_best_fit_packing")
def _op3(spark, sf_dir):
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"))


@query("op9_token_counts")
def _op9(spark, sf_dir):
    from .tokens import token_counts

    return token_counts(table(spark, sf_dir, "documents"))


@query("op4_mpeg_audio")
def _op4(spark, sf_dir):
    from .media import audio_features, stored_audio

    return audio_features(stored_audio(table(spark, sf_dir, "documents")))


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP5_SQL = rf"""
with d as (select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
i as (select cast(item_id as varchar) item, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
win as (select distinct item, least(10, len(w)) n, array_to_string(list_slice(w, s, s + least(10, len(w)) - 1), ' ') g
        from (select item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) s from i where len(w) > 0)),
dw as (select doc_id, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') g
       from (select doc_id, w, n, unnest(range(1, cast(len(w) as bigint) - n + 2)) s from d, (select distinct n from win) where len(w) >= n)),
hit as (select distinct doc_id, dw.n, s, item from dw join win on win.n = dw.n and win.g = dw.g),
pos as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(s, s + n)) p from (select distinct doc_id, n, s from hit)) group by doc_id),
its as (select doc_id, count(*) n_items, string_agg(item, ',' order by item) x from (select distinct doc_id, item from hit) group by doc_id)
select d.doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items,
       sha256(coalesce(x, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join pos using (doc_id) left join its using (doc_id)
"""


@query("op5_benchmark_decontamination", OP5_SQL)
def _op5(spark, sf_dir):
    from .decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


@query("op6_lpt_sharding")
def _op6(spark, sf_dir):
    from .sharding import shard

    return shard(table(spark, sf_dir, "documents"))


OP10_SQL = """
with p as (select page_id, coalesce(html, '') h from pages), q as (select page_id, h, min(page_id) over (partition by h) kept from p)
select page_id, cast(strlen(h) as bigint) payload_bytes, sha256(h) payload_digest,
       case when strlen(h) >= 100 and page_id <> kept then 'revisit' else 'response' end record_type,
       case when strlen(h) >= 100 and page_id <> kept then kept end refers_to
from q
"""


@query("op10_warc_records", OP10_SQL)
def _op10(spark, sf_dir):
    from .warc import archive

    return archive(table(spark, sf_dir, "pages"))


@query("op1_toxicity")
def _op1(spark, sf_dir):
    from ._common import held_out
    from .toxicity import score, train
    from pyspark.sql import functions as F

    docs = table(spark, sf_dir, "documents")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_hits", "n_quoted")


@query("op8_language_id")
def _op8(spark, sf_dir):
    from ._common import held_out
    from .langid import identify
    from pyspark.sql import functions as F

    out = identify(table(spark, sf_dir, "documents"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query("op7_html_extraction")
def _op7(spark, sf_dir):
    from .html import main_text

    return main_text(table(spark, sf_dir, "pages"))


OP2_SQL = rf"""
with recursive d as (select doc_id, list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') w from documents),
s as (select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, cast(len(w) as bigint) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))
      when len(w) > 0 then [array_to_string(w, ' ')] else [] end) g from d),
c as (select doc_id, count(*) n from s group by doc_id),
h as (select doc_id, n, string_agg(g, '|' order by g) k from s join c using (doc_id) group by doc_id, n),
r as (select doc_id, n, min(doc_id) over (partition by sha256(k)) rep from h),
t as (select s.doc_id, g, n from s join r using (doc_id) where doc_id = rep),
p as (select a.doc_id a, b.doc_id b from t a join t b on a.g = b.g and a.doc_id < b.doc_id and 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n)
      group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))),
e as (select a, b from p union all select b, a from p),
reach(x, y) as (select distinct a, a from e union select reach.x, e.b from reach join e on reach.y = e.a),
comp as (select x, min(y) m from reach group by x)
select d.doc_id, cast(coalesce(r.n, 0) as bigint) n_shingles, cast(coalesce(comp.m, r.rep, d.doc_id) as bigint) component_id
from d left join r using (doc_id) left join comp on comp.x = r.rep
"""


@query("op2_ngram_jaccard_join", OP2_SQL)
def _op2(spark, sf_dir):
    from .jaccard import similar

    return similar(table(spark, sf_dir, "documents"))


@query("pipeline")
def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
