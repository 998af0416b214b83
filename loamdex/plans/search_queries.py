"""Queries over text, vocabulary, vectors, lines and their fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamdex.functions import text as T
from loamdex.operators import fts, fusion, lines, retrieve, vector, vocab
from loamdex.session import table

from .base import DOCS, TURN_FILES, TURNS, bm25_sql, documents, engine, query, text_index, turns, vocabulary


def _search(spark, sf_dir, q, limit=10):
    return fts.search_index(*text_index(spark, sf_dir), q, limit=limit)


@query("fts_bm25_and", f"with {DOCS}, {bm25_sql('docs', [['thing'], ['onble']], 'tf0 > 0 and tf1 > 0')} select * from hits")
def _fts_and(spark, sf_dir):
    return _search(spark, sf_dir, "thing onble")


@query("fts_bm25_or", f"with {DOCS}, {bm25_sql('docs', [['thing'], ['onble']], 'tf0 > 0 or tf1 > 0')} select * from hits")
def _fts_or(spark, sf_dir):
    return _search(spark, sf_dir, "thing OR onble")


@query("fts_bm25_not", f"with {DOCS}, {bm25_sql('docs', [['thing'], ['onble']], 'tf0 > 0 and not tf1 > 0')} select * from hits")
def _fts_not(spark, sf_dir):
    return _search(spark, sf_dir, "thing NOT onble")


@query("fts_bm25_phrase", f"with {DOCS}, {bm25_sql('docs', [['of', 'the'], ['thing']], 'tf0 > 0 and tf1 > 0')} select * from hits")
def _fts_phrase(spark, sf_dir):
    return _search(spark, sf_dir, "of_the thing")


@query("fts_all_matches", f"with {DOCS}, {bm25_sql('docs', [['erble'], ['ering']], '(tf0 > 0 or tf1 > 0)', limit=None)} select * from hits")
def _fts_all(spark, sf_dir):
    return _search(spark, sf_dir, "erble OR ering", None)


@query("fts_scan", f"with {DOCS}, {bm25_sql('docs', [['of', 'the'], ['thing']], 'tf0 > 0 and tf1 > 0')} select * from hits")
def _fts_scan(spark, sf_dir):
    """The same search without an index: a scan of the texts."""
    return fts.search(documents(spark, sf_dir).select("doc_id", "content"), "of_the thing").select("doc_id", "score")


_RANKED = "select file, round(1.0::double / (60 + row_number() over (order by score desc, file)), 9) as score from hits"


@query("fts_path_fallback", f"with {TURN_FILES}, whole as (select kb, path, file, path || ' ' || content as body from cv), {bm25_sql('whole', [['txt']], 'tf0 > 0', text='body', key='kb, path', more=', file')} {_RANKED}")
def _fts_fallback(spark, sf_dir):
    """No chunk holds the word, so the engine searches documents by path and content."""
    return engine(spark, sf_dir).search("txt", engines=("text",), limit=10).select("file", "score")


@query("engine_text", f"with {TURN_FILES}, {bm25_sql('cv', [['the', 'and'], ['of']], 'tf0 > 0 or tf1 > 0', key='kb, path', more=', file')} {_RANKED}")
def _engine_text(spark, sf_dir):
    return engine(spark, sf_dir).search("the_and OR of", engines=("text",), limit=10).select("file", "score")


_MANY = """with q as (select item_id as qid, {tok} as w from benchmark),
terms as (select qid, t as term, count(*) as times from (select qid, unnest(w) as t from q) group by qid, t),
d as (select doc_id, {tok} as w from documents), dl as (select doc_id, len(w) as l from d),
post as (select doc_id, term, count(*) as tf from (select doc_id, unnest(w) as term from d) where term in (select term from terms) group by doc_id, term),
st as (select cast(count(*) as double) as n, avg(l) as a from dl), df as (select term, cast(count(*) as double) as df from post group by term),
sc as (select qid, doc_id, sum(times * (case when ln((n - df + 0.5::double) / (df + 0.5::double)) > 0 then ln((n - df + 0.5::double) / (df + 0.5::double)) else 1e-6::double end) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * l / a))) as s
       from post join terms using (term) join df using (term) join dl using (doc_id), st group by qid, doc_id),
hits as (select qid, doc_id, round(s, 6) as score from sc)
select qid, doc_id, score, cast(row_number() over (partition by qid order by score desc, doc_id) as int) as rank from hits qualify rank <= 10"""


@query("fts_batch", _MANY.format(tok=r"regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+')"))
def _fts_batch(spark, sf_dir):
    """Every benchmark item as a query of all its words, any of which may match; all queries in one plan."""
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    return fts.search_many(text_index(spark, sf_dir)[0], queries, text_index(spark, sf_dir)[1], require_all=False).select("qid", "doc_id", "score", "rank")


@query("fts_postings", r"with d as (select doc_id, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+') as w from documents) select term, count(distinct doc_id) as df, count(*) as cf from (select doc_id, unnest(w) as term from d) group by term")
def _postings(spark, sf_dir):
    """Document and collection frequency of every term."""
    return text_index(spark, sf_dir)[0].groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query("fts_corpus_stats", r"with d as (select len(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+')) as l from documents) select count(*) as n, cast(sum(l) as bigint) as tokens, round(avg(l), 6) as average from d")
def _corpus_stats(spark, sf_dir):
    return fts.corpus_stats(fts.lengths(documents(spark, sf_dir))).withColumn("average", F.round("average", 6))


@query("fts_sanitize", r"""select item_id, trim(regexp_replace(translate('  ("' || text || '"*) ? + {x}^~-y', '?*()"+-^{}~', ''), '\s+', ' ', 'g')) as clean from benchmark""")
def _sanitize(spark, sf_dir):
    dirty = F.concat(F.lit('  ("'), "text", F.lit('"*) ? + {x}^~-y'))
    return table(spark, sf_dir, "benchmark").select("item_id", T.sanitize_query(dirty).alias("clean"))


_VOCAB = "voc as (select word, count(*) as frequency from (select unnest(list_distinct(list_concat([t], list_filter(string_split_regex(t, '[_-]'), lambda p: length(p) >= 3)))) as word from (select lower(unnest(regexp_extract_all(text, '[a-zA-Z][a-zA-Z0-9_-]{2,}'))) as t from documents)) group by word)"


@query("vocab_build", f"with {_VOCAB} select word, frequency from voc")
def _vocab(spark, sf_dir):
    return vocab.build_vocabulary(documents(spark, sf_dir))


@query("vocab_compound", """with n as (select p_partkey, lower(replace(p_name, ' ', case when p_size > 25 then '_' else '-' end)) as t from part),
p as (select p_partkey, t, list_concat([t], list_filter(string_split_regex(t, '[_-]'), lambda x: length(x) >= 3)) as a from n)
select p_partkey, array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i), ' ') as parts from p""")
def _compound(spark, sf_dir):
    token = F.replace("p_name", F.lit(" "), F.when(F.col("p_size") > 25, "_").otherwise("-"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(T.split_compound(token), " ").alias("parts"))


_WORDS = "asked as (select distinct lower(unnest(string_split(p_name || ' ' || p_type, ' '))) as word from part)"
_CORRECT = """near as (select a.word, v.word as candidate, frequency, levenshtein(a.word, v.word) as distance from asked a join voc v on abs(length(a.word) - length(v.word)) <= 3 where a.word not in (select word from voc)),
best as (select word, arg_min(candidate, (distance, -frequency, candidate)) as best from near where distance <= case when strlen(word) <= 8 then 2 else 3 end group by word)"""


def _asked(spark, sf_dir):
    words = F.split(F.concat_ws(" ", "p_name", "p_type"), " ")
    return table(spark, sf_dir, "part").select(F.explode(F.transform(words, F.lower)).alias("word")).distinct()


@query("fuzzy_correct", f"with {_VOCAB}, {_WORDS}, {_CORRECT} select word, coalesce(best, word) as corrected from asked left join best using (word)")
def _correct(spark, sf_dir):
    """The words of all names and types of parts, by the vocabulary of documents."""
    return vocab.correct_words(_asked(spark, sf_dir), vocabulary(spark, sf_dir))


@query("fuzzy_suggest", f"with {_VOCAB} select word, frequency, cast(levenshtein(word, 'thingk') as int) as distance from voc where levenshtein(word, 'thingk') <= 2 order by distance, frequency desc, word limit 5")
def _suggest(spark, sf_dir):
    return vocab.suggest(vocabulary(spark, sf_dir), "thingk")


_FUZZY = _CORRECT.replace("asked a", "asked a")


@query(
    "fuzzy_search",
    f"with {_VOCAB}, asked as (select unnest(['thingg', 'onblle']) as word), {_CORRECT}, fixed as (select max(coalesce(best, word)) filter (word = 'thingg') as t0, max(coalesce(best, word)) filter (word = 'onblle') as t1 from asked left join best using (word)), "
    r"""d as (select doc_id, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+') as w from documents),
c as (select doc_id, len(w) as l, len(list_filter(w, lambda x: x = t0)) as f0, len(list_filter(w, lambda x: x = t1)) as f1 from d, fixed),
s as (select cast(count(*) as double) as n, avg(l) as a, cast(count(*) filter (f0 > 0) as double) as d0, cast(count(*) filter (f1 > 0) as double) as d1 from c)
select doc_id, round((case when ln((n - d0 + 0.5::double) / (d0 + 0.5::double)) > 0 then ln((n - d0 + 0.5::double) / (d0 + 0.5::double)) else 1e-6::double end) * f0 * 2.2::double / (f0 + 1.2::double * (0.25::double + 0.75::double * l / a))
 + (case when ln((n - d1 + 0.5::double) / (d1 + 0.5::double)) > 0 then ln((n - d1 + 0.5::double) / (d1 + 0.5::double)) else 1e-6::double end) * f1 * 2.2::double / (f1 + 1.2::double * (0.25::double + 0.75::double * l / a)), 6) as score
from c, s where f0 > 0 and f1 > 0 order by score desc, doc_id limit 10""",
)
def _fuzzy_search(spark, sf_dir):
    """Typo correction, then BM25 on the corrected words."""
    asked = spark.createDataFrame([(0, "Thingg onblle")], "qid int, query string")
    fixed, _ = vocab.correct_queries(asked, vocabulary(spark, sf_dir))
    return _search(spark, sf_dir, fixed.first().corrected)


def _first_vector(spark, sf_dir):
    return list(table(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding").first()[0])


@query("vec_knn_l2", "with q as (select cast(arg_min(embedding, vec_id) as double[]) as v from embeddings), k as (select vec_id, round(list_distance(cast(embedding as double[]), v), 6) as distance from embeddings, q order by distance, vec_id limit 10) select vec_id, distance, round(1 / (1 + distance), 6) as score from k")
def _knn(spark, sf_dir):
    return vector.knn(table(spark, sf_dir, "embeddings"), _first_vector(spark, sf_dir))


@query("vec_knn_batch", """with q as (select vec_id as qid, cast(embedding as double[]) as v from embeddings where vec_id % 20 = 0),
p as (select qid, vec_id, round(list_distance(cast(embedding as double[]), v), 6) as distance from embeddings, q)
select qid, vec_id, distance, cast(row_number() over (partition by qid order by distance, vec_id) as int) as rank from p qualify rank <= 10""")
def _knn_batch(spark, sf_dir):
    """Every vector whose id is divisible by 20 against all."""
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    return vector.knn_batch(vectors, queries).select("qid", "vec_id", "distance", "rank")


@query("vec_dimensions", "select len(embedding) as dimension, count(*) as vectors from embeddings where len(embedding) = 64 group by 1")
def _dimensions(spark, sf_dir):
    return vector.check_dimension(table(spark, sf_dir, "embeddings"), 64).groupBy(F.size("embedding").cast("long").alias("dimension")).agg(F.count("*").alias("vectors"))


@query("rrf_fuse", """with h as (select event_type as engine, user_id as key, max(value) as score from events group by 1, 2),
r as (select *, row_number() over (partition by engine order by score desc, key) as rank from h)
select key, round(sum(1.0::double / (60 + rank)), 9) as rrf from r group by key""")
def _rrf(spark, sf_dir):
    """Each event type as an engine that ranks users by their largest value."""
    hits = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("engine"), F.col("user_id").alias("key")).agg(F.max("value").alias("score"))
    return fusion.rrf(fusion.rank_lists(hits)).select("key", F.round("rrf", 9).alias("rrf"))


@query("rrf_duplicate_keys", """with r as (select user_id as key, row_number() over (partition by event_type order by value desc, user_id, event_id) as rank from events)
select key, round(sum(1.0::double / (60 + rank)), 9) as rrf from r group by key""")
def _rrf_duplicates(spark, sf_dir):
    """A key that a list holds many times counts each time."""
    hits = table(spark, sf_dir, "events").select(F.col("event_type").alias("engine"), F.col("user_id").alias("key"), F.col("value").alias("score"), "event_id")
    return fusion.rrf(fusion.rank_lists(hits, ties=("key", "event_id"))).select("key", F.round("rrf", 9).alias("rrf"))


@query("dedup_best", """select user_id, event_type, event_id, value as score from events qualify row_number() over (partition by user_id, event_type order by value desc, event_id) = 1""")
def _dedup(spark, sf_dir):
    hits = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.col("value").alias("score"))
    return fusion.dedup_best(hits, ("user_id", "event_type"), ("event_id",)).select("user_id", "event_type", "event_id", "score")


@query("doc_score_top3", "with r as (select l_orderkey as file, l_extendedprice as score, row_number() over (partition by l_orderkey order by l_extendedprice desc) as k from lineitem) select file, round(sum(score), 4) as score from r where k <= 3 group by file")
def _top3(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_extendedprice").alias("score"))
    return fusion.document_scores(rows).select("file", F.round("score", 4).alias("score"))


@query("doc_score_max", "select l_orderkey as file, max(l_extendedprice) as score, min(l_linenumber) as pos from lineitem group by 1")
def _top1(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_extendedprice").alias("score"), F.col("l_linenumber").alias("pos"))
    return fusion.document_max(rows)


_HYBRID = f"""with {TURN_FILES}, {bm25_sql('cv', [['the'], ['and']], '(tf0 > 0 or tf1 > 0)', key='kb, path', limit=20, more=', file')},
f as (select 'fts' as engine, file, row_number() over (order by score desc, file) as rank from hits),
vq as (select cast(arg_min(embedding, vec_id) as double[]) as v from embeddings),
vk as (select vec_id, round(1 / (1 + distance), 6) as score from (select vec_id, round(list_distance(cast(embedding as double[]), v), 6) as distance from embeddings, vq order by distance, vec_id limit 20)),
v as (select 'vector' as engine, file, row_number() over (order by score desc, file) as rank from vk join cv on cv.conv_id = vk.vec_id and turn = 0),
ll as (select file, unnest(range(1, len(x) + 1)) as line_no, trim(unnest(x)) as line from (select file, string_split(content, chr(10)) as x from cv)),
lh as (select file, line_no, line from ll where contains(lower(line), 'from') and line <> '' order by file, line_no limit 20),
l as (select 'fuzzy' as engine, file, line, row_number() over (order by file, line_no) as rank from lh),
gh as (select kb, path, file from cv where len(list_filter(regexp_extract_all(content, '\\b[A-Z][A-Za-z0-9]+(?: [A-Z][A-Za-z0-9]+)*'), lambda n: contains(lower(n), 'ther'))) > 0 order by kb, path limit 20),
g as (select 'graph' as engine, file, row_number() over (order by file) as rank from gh),
a as (select engine, file, rank, null as line from f union all select engine, file, rank, null from v union all select engine, file, rank, line from l union all select engine, file, rank, null from g),
s as (select file, sum(1.0::double / (60 + rank)) as s, list(distinct engine) as src, bool_or(engine in ('fts', 'vector')) as chunk, arg_min(line, rank) filter (line is not null) as line from a group by file)
select file, round(s, 9) as score, array_to_string(list_filter(['fts', 'vector', 'fuzzy', 'graph'], lambda x: list_contains(src, x)), ',') as sources,
case when chunk then content when line is not null then line else content end as content from s join cv using (file) order by score desc, file limit 10"""


@query("hybrid_search", _HYBRID)
def _hybrid(spark, sf_dir):
    """The engine's text, graph and line hits and the nearest vectors, fused: hits of a file count for its chunks, and what the graph alone finds shows the file's first chunk."""
    e = engine(spark, sf_dir)
    hits = e.hits("the OR and", "the OR and", None, 20, ("text",)).unionByName(e.hits("ther", "ther", None, 20, ("graph",))).unionByName(e.hits("from", "from", None, 20, ("local",), True))
    chunks = e._chunks(None)
    near = vector.knn(table(spark, sf_dir, "embeddings"), _first_vector(spark, sf_dir), 20)
    near = chunks.join(near, F.col("path") == F.concat(F.lit("conv/"), F.col("vec_id").cast("string"), F.lit("/0.txt"))).withColumn("engine", F.lit("vector")).select(*hits.columns)
    out = fusion.enrich_graph_only(fusion.fuse(hits.unionByName(near), limit=10), chunks)
    return out.select("file", "score", F.array_join("sources", ",").alias("sources"), "content")


@query("smart_fanout_dedup", f"""with {TURN_FILES}, {bm25_sql('cv', [['the']], 'tf0 > 0', key='kb, path', limit=20, more=', file').replace('hits as', 'h0 as')},
{bm25_sql('cv', [['and']], 'tf0 > 0', key='kb, path', limit=20, more=', file').replace('tok as', 'tok2 as').replace('from tok)', 'from tok2)').replace('cnt as', 'cnt2 as').replace('from cnt)', 'from cnt2)').replace('st as', 'st2 as').replace('from st)', 'from st2)').replace('idfs as', 'idfs2 as').replace('from cnt, idfs', 'from cnt2, idfs2').replace('hits as', 'h1 as')},
hits as (select file, max(score) as score from (select * from h0 union all select * from h1) group by file)
{_RANKED} order by score desc limit 10""")
def _fanout(spark, sf_dir):
    """A smart search of two sub-queries; of a chunk that both find the better hit counts."""
    return engine(spark, sf_dir).search("the! And?", engines=("text",), smart=True, limit=10, fetch_k=20).select("file", "score")


@query("first_chunk_enrich", f"with {TURNS} select file, arg_min(chunk_id, line_start) as chunk_id, arg_min(content, line_start) as content, min(line_start) as line_start from turns group by file")
def _first_chunk(spark, sf_dir):
    return fusion.first_chunks(turns(spark, sf_dir).select("file", "chunk_id", "content", "line_start"))


@query("line_search_exact", f"""with {DOCS}, l as (select path as file, unnest(range(1, len(x) + 1)) as line_no, unnest(x) as line from (select path, string_split(content, chr(10)) as x from docs))
select file, cast(line_no as int) as line_no, trim(line) as line, 1.0::double as score from l where contains(lower(trim(line)), 'onble') and trim(line) <> '' order by file, line_no limit 10""")
def _line_exact(spark, sf_dir):
    return lines.search(documents(spark, sf_dir).select(F.col("path").alias("file"), "content"), "onble", exact=True).select("file", "line_no", "line", "score")


@query("line_search_fuzzy")
def _line_fuzzy(spark, sf_dir):
    return lines.search(documents(spark, sf_dir).select(F.col("path").alias("file"), "content"), "thgonb", limit=20)


@query("retrieve_neighbors", f"""with {TURNS}, p as (select *, row_number() over (partition by doc_id order by line_start, chunk_id) as pos from turns), w as (select chunk_id as wanted_id, doc_id, pos as centre from p where chunk_type = 'assistant')
select wanted_id, chunk_id, cast(pos - centre as int) as "offset" from p join w using (doc_id) where pos between centre - 1 and centre + 2""")
def _neighbours(spark, sf_dir):
    chunks = turns(spark, sf_dir)
    return retrieve.neighbours(chunks, chunks.where("chunk_type = 'assistant'"), 1, 2).select("wanted_id", "chunk_id", "offset")


@query("retrieve_context_lines", """with d as (select doc_id, string_split(case when text[-1] = chr(10) then text[1:-2] else text end, chr(10)) as x from documents where text <> '')
select doc_id, array_to_string(list_slice(x, greatest(1, m - 2), m - 1), '|') as before, array_to_string(list_slice(x, m + 1, m + 2), '|') as after from (select *, len(x) // 2 + 1 as m from d)""")
def _context(spark, sf_dir):
    """The middle line of each document as a chunk, with the two lines before and after."""
    docs = documents(spark, sf_dir).select("doc_id", "content")
    middle = F.floor(F.size(T.lines(F.col("content"))) / 2).cast("int") + 1
    chunks = docs.where("content <> ''").select("doc_id", middle.alias("line_start"), middle.alias("line_end"))
    out = retrieve.line_context(chunks, docs, 2, 2)
    return out.select("doc_id", F.array_join("context_before_lines", "|").alias("before"), F.array_join("context_after_lines", "|").alias("after"))


@query("preview", "select doc_id, replace(substr(text, 1, 200), chr(10), ' ') as preview, source || '/' || doc_id || '.txt' as path from documents")
def _preview(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.preview(F.col("content")).alias("preview"), "path")


@query("snippet", f"""with {DOCS}, {bm25_sql('docs', [['thing'], ['onble']], 'tf0 > 0 and tf1 > 0')},
w as (select doc_id, list_filter(string_split_regex(content, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') as w from docs where doc_id in (select doc_id from hits)),
m as (select doc_id, w, list_transform(w, lambda x: list_filter(['thing', 'onble'], lambda t: list_contains(regexp_extract_all(strip_accents(lower(x)), '[\\p{{L}}\\p{{N}}]+'), t))) as h from w),
c as (select doc_id, w, h, greatest(0, least(i, len(w) - 32)) as s from (select *, unnest(range(0, len(w))) as i from m) where len(h[i + 1]) > 0),
b as (select doc_id, any_value(w) as w, arg_min(s, (-n, s)) as s from (select *, len(list_distinct(flatten(list_slice(h, s + 1, s + 32)))) as n from c) group by doc_id)
select doc_id, case when s > 0 then '...' else '' end || array_to_string(list_slice(w, s + 1, s + 32), ' ') || case when s + 32 < len(w) then '...' else '' end as snippet from b""")
def _snippet(spark, sf_dir):
    hits = _search(spark, sf_dir, "thing onble")
    return documents(spark, sf_dir).join(F.broadcast(hits), "doc_id").select("doc_id", T.snippet(F.col("content"), ["thing", "onble"]).alias("snippet"))


@query("embed_format", """select doc_id, 'title: ' || doc_id || ' | text: ' || text as input, 'task: search result | query: ' || text as query from documents""")
def _embed_format(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return docs.select("doc_id", T.document_input(T.file_stem(F.col("path")), F.col("content")).alias("input"), T.query_input("search result", F.col("content")).alias("query"))


@query("levenshtein_names", "select p_partkey, cast(levenshtein(p_brand, p_type) as int) as distance from part")
def _levenshtein(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.levenshtein("p_brand", "p_type").alias("distance"))
