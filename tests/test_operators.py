import math
import random
import sqlite3

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window, functions as F

from loamdex.functions import text as T
from loamdex.operators import chunking, fts, fusion, graph, ingest, lines, ranks, retrieve, vector, vocab


def column(spark, expression, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x")).alias("y")).first().y


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, content string")


@pytest.mark.parametrize("query", ["alpha", "alpha beta", "alpha OR gamma", "alpha NOT beta", "alpha_beta", "gamma AND (delta", "beta beta", "alpha OR beta NOT gamma", "alpha beta OR delta"])
def test_bm25_equals_sqlite(spark, query):
    rng = random.Random(query)
    texts = [" ".join(rng.choice(["alpha", "Beta", "gámma", "delta", "eps", "zeta9", "x"]) for _ in range(rng.randint(0, 12))) for _ in range(60)]
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(content)")
    con.executemany("insert into t(rowid, content) values (?, ?)", list(enumerate(texts, 1)))
    want = con.execute("select rowid, -bm25(t) from t where t match ? order by bm25(t), rowid", (fts.sanitize(query),)).fetchall()
    d = docs(spark, texts)
    for hits in (fts.search(d, query, limit=None), fts.search_index(fts.postings(d), fts.lengths(d), query, limit=None)):
        assert {r.doc_id: r.score for r in hits.collect()} == pytest.approx({i: round(s, 6) for i, s in want}, abs=1e-6)


def test_query_grammar(spark):
    assert fts.parse_query("?*()")[0] is None
    assert fts.search(docs(spark, ["a"]), "~^").count() == 0
    with pytest.raises(fts.QuerySyntaxError):
        fts.parse_query("a.b", strict=True)
    q, phrases = fts.parse_query("a_b c")
    assert q.kind == "and" and phrases == [["a", "b"], ["c"]]
    assert fts.search(docs(spark, []), "a").count() == 0


def test_phrases_that_overlap(spark):
    tokens = spark.createDataFrame([(["a", "a", "a", "b"],), ([],), (["b"],)], "t array<string>")
    assert [r[0] for r in tokens.select(fts.phrase_count(F.col("t"), ["a", "a"])).collect()] == [2, 0, 0]


def test_batch_equals_single(spark):
    d = docs(spark, ["the cat sat", "the dog", "a cat and a dog and a cat", "nothing"])
    index = fts.postings(d)
    asked = spark.createDataFrame([(1, "cat"), (2, "cat dog")], "qid int, query string")
    many = fts.search_many(index, asked, fts.lengths(d)).collect()
    assert {(r.qid, r.doc_id) for r in fts.search_many(index, asked, fts.lengths(d), require_all=False).collect()} == {(1, 1), (1, 3), (2, 1), (2, 2), (2, 3)}
    for qid, q in ((1, "cat"), (2, "cat dog")):
        assert {r.doc_id: r.score for r in many if r.qid == qid} == {r.doc_id: r.score for r in fts.search(d, q).collect()}


def test_vocabulary_and_correction(spark):
    words = vocab.build_vocabulary(docs(spark, ["sync Sync search snake_case kebab-case ab 12ab", "search"]))
    got = {r.word: r.frequency for r in words.collect()}
    assert got == {"sync": 2, "search": 2, "snake_case": 1, "snake": 1, "case": 2, "kebab-case": 1, "kebab": 1}
    table = spark.createDataFrame([("synca", 2), ("syncb", 20), ("verylongword", 1)], "word string, frequency long")
    asked = spark.createDataFrame([("syncc",), ("syncb",), ("zzzzzzzz",), ("verylongxyz",)], "word string")
    assert dict(map(tuple, vocab.correct_words(asked, table).collect())) == {"syncc": "syncb", "syncb": "syncb", "zzzzzzzz": "zzzzzzzz", "verylongxyz": "verylongxyz"}
    fixed, changes = vocab.correct_queries(spark.createDataFrame([(1, "Syncc synca"), (2, "")], "qid int, query string"), table)
    assert {r.qid: r.corrected for r in fixed.collect()} == {1: "syncb synca", 2: ""}
    assert [tuple(r) for r in changes.collect()] == [(1, 0, "syncc", "syncb")]
    assert column(spark, lambda x: T.split_camel(x), "getHTTPName") == ["get", "H", "T", "T", "P", "Name"]
    assert [column(spark, lambda x: F.levenshtein(x, F.lit(b)), a) for a, b in (("kitten", "sitting"), ("", "abc"), ("fuzzy", "fussy"), ("ä", "ö"))] == [3, 3, 2, 1]


def test_correction_finds_all_candidates(spark):
    """The segments' join against every word of the vocabulary."""
    rng = random.Random(8)
    word = lambda least, most: "".join(rng.choice("abc") for _ in range(rng.randint(least, most)))
    words = {word(1, 13): rng.randint(1, 5) for _ in range(500)}
    asked = {word(1, 13) for _ in range(150)}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = {}
    for a in asked:
        near = [(d, -f, w) for w, f in words.items() if (d := distance(a, w)) <= (2 if len(a) <= 8 else 3)]
        want[a] = a if a in words or not near else min(near)[2]
    got = vocab.correct_words(spark.createDataFrame([(a,) for a in asked], "word string"), spark.createDataFrame(list(words.items()), "word string, frequency long"))
    assert dict(map(tuple, got.collect())) == want
    # a query at a time, by one scan and by segments; a word's rows add up
    table = spark.createDataFrame([(w, n) for w, f in words.items() for n in (f - f // 2, f // 2)], "word string, frequency long")
    for query in (sorted(asked)[: vocab.FEW // 2], sorted(asked)[-vocab.FEW - 4 :]):
        fixed, changes = vocab.correct_query("  ".join(query).upper(), table)
        assert fixed.split() == [want[w] for w in query]
        assert changes == [(i, w, want[w]) for i, w in enumerate(query) if want[w] != w]
    assert vocab.correct_query(" ", table) == ("", [])


@pytest.mark.parametrize("most", [0, 500_000])
def test_long_lists_are_ranked_alike(spark, monkeypatch, most):
    monkeypatch.setattr(ranks, "BROADCAST_COUNTS", most)
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), str(i), rng.choice([*map(float, range(9)), None, float("nan")])) for i in range(300)]
    hits = spark.createDataFrame(rows, "engine string, key string, score double")
    got, want = (fusion.rank_lists(hits, large=large).select("engine", "key", "rank") for large in (10, fusion.LARGE))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_snippet_takes_the_densest_words(spark):
    text = " ".join(["cat"] + ["x"] * 20 + ["cat,", "y", "Dog"] + ["z"] * 9)
    show = lambda n: spark.createDataFrame([(text,)], "c string").select(T.snippet(F.col("c"), ["cat", "dog"], n)).first()[0]
    assert show(5) == "...cat, y Dog z z..." and show(100) == text
    assert spark.createDataFrame([("a b c",)], "c string").select(T.snippet(F.col("c"), ["q"], 2)).first()[0] == "a b..."


def test_fuzzy_score_is_the_best_alignment():
    import itertools

    def brute(line, query):
        best = 0
        for at in itertools.combinations(range(len(line)), len(query)):
            if any(line[i].lower() != q for i, q in zip(at, query, strict=True)):
                continue
            points = 0
            for k, i in enumerate(at):
                edge = i == 0 or not line[i - 1].isalnum() or line[i - 1].islower() and line[i].isupper()
                points += 16 + 8 * edge + (16 * (i == at[k - 1] + 1) - (i - at[k - 1] - 1) if k else 0)
            best = max(best, points)
        return min(best / 256, 1)

    rng = random.Random(1)
    for _ in range(300):
        line, query = "".join(rng.choice("abA -") for _ in range(rng.randint(1, 8))), "".join(rng.choice("ab") for _ in range(rng.randint(1, 3)))
        assert lines.fuzzy_score(line, query) == pytest.approx(brute(line, query)), (line, query)


def test_fuzzy_scores_of_many_lines_are_those_of_each(monkeypatch):
    rng = random.Random(2)
    for step in (1, 7, 1_000_000):
        monkeypatch.setattr(lines, "STEP", step)
        for _ in range(100):
            rows = ["".join(rng.choice("abAB -é1İßK") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 8))]
            query = "".join(rng.choice("abAé 1") for _ in range(rng.randint(0, 4)))
            assert lines.fuzzy_scores(rows, query).tolist() == [lines.fuzzy_score(x, query) for x in rows]
    assert lines.fuzzy_score("", "a") == lines.fuzzy_score("a", "") == 0


def test_rrf(spark):
    hits = spark.createDataFrame([("a", "x", 9.0), ("a", "y", 1.0), ("b", "x", 2.0), ("b", "x", 1.0)], "engine string, key string, score double")
    got = {r.key: r.rrf for r in fusion.rrf(fusion.rank_lists(hits)).collect()}
    assert got == pytest.approx({"x": 1 / 61 + 1 / 61 + 1 / 62, "y": 1 / 62})
    assert fusion.rrf(fusion.rank_lists(hits.limit(0))).count() == 0


HITS = "engine string, file string, chunk_id long, score double, content string, line_start int, line_end int, chunk_type string"


def test_fuse(spark):
    rows = [("fts", "f", 1, 5.0, "one", 1, 2, "p"), ("fts", "f", 2, 4.0, "two", 3, 4, "p"), ("vector", "f", 2, 0.9, "two", 3, 4, "p"), ("fuzzy", "f", None, 1.0, "line", 3, 3, None), ("fuzzy", "f", None, 1.0, "line2", 4, 4, None), ("graph", "g", None, 1.0, None, None, None, None)]
    got = fusion.fuse(spark.createDataFrame(rows, HITS)).collect()
    assert [(r.file, r.chunk_id, r.sources) for r in got] == [("f", 2, ["fts", "vector", "fuzzy"]), ("f", 1, ["fts", "fuzzy"]), ("g", None, ["graph"])]
    path = 1 / 61 + 1 / 62
    assert got[0].score == pytest.approx(1 / 62 + 1 / 61 + path, abs=1e-8) and got[1].score == pytest.approx(1 / 61 + path, abs=1e-8)
    doc = fusion.fuse(spark.createDataFrame(rows, HITS), doc_score=True).collect()
    assert doc[0].file == "f" and doc[0].chunk_id is None and doc[0].score == pytest.approx(got[0].score + got[1].score, abs=1e-8)
    chunks = spark.createDataFrame([("g", 7, "first", 1, 3, "p"), ("g", 8, "second", 4, 5, "p")], "file string, chunk_id long, content string, line_start int, line_end int, chunk_type string")
    rich = {r.file: r for r in fusion.enrich_graph_only(fusion.fuse(spark.createDataFrame(rows, HITS)), chunks).collect()}
    assert rich["g"].chunk_id == 7 and rich["g"].content == "first"


def test_vectors(spark):
    v = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0]), (3, [0.0, 1.0]), (4, None), (5, [1.0])], "vec_id long, embedding array<float>")
    assert [(r.vec_id, r.distance, r.score) for r in vector.knn(v, [0.0, 0.0], 3).collect()] == [(1, 0.0, 1.0), (3, 1.0, 0.5), (2, 5.0, round(1 / 6, 6))]
    q = spark.createDataFrame([(9, [0.0, 0.0]), (8, [3.0, 4.0])], "qid long, qvec array<float>")
    assert {(r.qid, r.rank): r.vec_id for r in vector.knn_batch(v, q, 2, broadcast_rows=2).collect()} == {(9, 1): 1, (9, 2): 3, (8, 1): 2, (8, 2): 3}
    assert vector.check_dimension(v, 2).count() == 3


def test_batch_of_queries_equals_all_pairs(spark, monkeypatch):
    rng, nan = random.Random(5), float("nan")
    grid = [[rng.randint(-2, 2) * 0.5 for _ in range(5)] for _ in range(700)]
    odd = [[1e160] * 5, [-1e160, 1e160, 0.0, 0.0, 0.0], [nan] * 5, [math.inf, 0.0, 0.0, 0.0, 0.0], [5e-7, 0.0, 0.0, 0.0, 0.0], [1.0], [], None]
    rows = [*enumerate([*grid, *odd, *[[0.5] * 5] * 300])]
    rng.shuffle(rows)
    v = spark.createDataFrame([(f"v{i}", x) for i, x in rows], "vec_id string, embedding array<double>")
    asked = {i: x for i, x in rows if i % 9 == 0 or i >= 700}
    q = spark.createDataFrame(list(asked.items()), "qid int, qvec array<double>")
    all_pairs = v.join(q, F.size("embedding") == F.size("qvec")).select("qid", F.round(vector.l2(F.col("embedding"), F.col("qvec")), 6).alias("distance"), "vec_id")
    want = all_pairs.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("distance", "vec_id"))).where("rank <= 7")
    want = sorted(map(str, want.collect()))
    monkeypatch.setattr(vector, "PART_ROWS", 300)
    for broadcast_rows in (1_000_000, 700):
        got = vector.knn_batch(v, q, 7, broadcast_rows=broadcast_rows)
        assert got.columns == ["qid", "distance", "vec_id", "rank"] and sorted(map(str, got.collect())) == want
    # Spark does not multiply the pairs out
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("copies", [0, 1500])
def test_few_pairs_get_a_distance(monkeypatch, copies):
    rng, asked, keep = np.random.default_rng(7), [], vector._Nearest._keep
    monkeypatch.setattr(vector._Nearest, "_keep", lambda self, query, *a: (asked.append(len(query)), keep(self, query, *a)))
    x = rng.normal(size=(3000, 16))
    x[rng.permutation(3000)[:copies]] = x[0]
    search = vector._Nearest(x[::20], 5)
    search.add(pa.array(range(3000)), x)
    row, distance, key = (a.to_numpy() for a in search.found())
    all_pairs = np.round(np.sqrt(((x[::20, None] - x[None]) ** 2).sum(2)), 6)
    assert np.array_equal(key.reshape(150, 5), np.argsort(all_pairs, axis=1, kind="stable")[:, :5])
    assert sum(asked) < 0.05 * all_pairs.size


def test_vectors_with_nulls_or_of_no_query_are_no_neighbours(spark):
    v = spark.createDataFrame([(1, [0.0, None]), (2, [3.0, 4.0]), (3, None), (4, [1.0])], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(9, [0.0, 0.0]), (8, [None, 0.0]), (7, None), (6, [0.0] * 3)], "qid long, qvec array<float>")
    assert [tuple(r) for r in vector.knn_batch(v, q).collect()] == [(9, 5.0, 2, 1)]
    assert vector.knn_batch(v, q.limit(0)).count() == 0 and vector.knn_batch(v.limit(0), q).count() == 0


def test_distances_are_rounded_like_columns(spark):
    rng = random.Random(6)
    x = [0.0, 5e-7, 1.5e-6, 0.0000025, 1.0000005, 2.1234565, 1e9 + 0.0000005, 1e15 + 0.5, 1e300, math.inf, *[rng.randint(0, 10**9) / 1e7 for _ in range(3000)]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, v double").orderBy("i")
    assert [r[0] for r in df.select(F.round("v", 6)).collect()] == vector._six(np.array(x)).tolist()


def test_graph(spark):
    entity, relation = "struct<name:string,type:string,description:string>", "struct<source:string,target:string,relation:string,description:string>"
    rows = [("a.md", [("Rust", "technology", "d"), ("Ann Lee", "person", None)], [("Ann Lee", "Rust", "works on", None), ("Rust", "LLVM", "uses", None)]), ("b.md", [("rust", "tool", "e")], [])]
    nodes, edges = graph.ingest(spark.createDataFrame(rows, f"path string, entities array<{entity}>, relationships array<{relation}>"))
    assert {r.node_id: (r.name, r.type) for r in nodes.where("label = 'Entity'").collect()} == {"rust": ("rust", "tool"), "ann_lee": ("Ann Lee", "person"), "llvm": ("LLVM", None)}
    assert [r.path for r in graph.search(nodes, edges, "RUST x").collect()] == ["a.md", "b.md"]
    assert graph.search(nodes, edges, "zzz").count() == 0
    assert [(r.path, r.score) for r in graph.search(nodes, edges, "llvm", hops=1).collect()] == [("a.md", 0.5), ("b.md", 0.5)]
    assert graph.neighbours(nodes, edges, "rust").first().neighbours == ["Ann Lee", "LLVM"]
    assert tuple(graph.stats(nodes, edges).first()) == (5, 5)
    left = graph.remove_document(nodes, edges, spark.createDataFrame([("a.md",)], "path string"))
    assert tuple(graph.stats(*left).first()) == (4, 1)


def test_lines(spark):
    d = spark.createDataFrame([("f", "  Hello World \n\nother\nsay hello"), ("g", None)], "file string, content string")
    assert [(r.file, r.line_no, r.line, r.score) for r in lines.search(d, "HELLO", exact=True).collect()] == [("f", 1, "Hello World", 1.0), ("f", 4, "say hello", 1.0)]
    got = lines.search(d, "hlwd").collect()
    assert [r.line_no for r in got] == [1] and 0 < got[0].score <= 1
    assert lines.fuzzy_score("abc", "abc") > lines.fuzzy_score("a-x-b-x-c", "abc") > 0 == lines.fuzzy_score("abc", "acb")


LONG = "word " * 10


def test_markdown_chunks():
    text = f"---\ntitle: a long enough frontmatter block\n---\n# One\n{LONG}\n```py\nx = 'a fenced block that is long enough'\n```\n{LONG}\n## Two\n{LONG}"
    got = chunking.chunk("a.md", text)
    assert [(c[3], c[1], c[2]) for c in got] == [("frontmatter", 1, 3), ("heading_section", 4, 5), ("code_block", 6, 8), ("paragraph", 9, 9), ("heading_section", 10, 11)]
    assert chunking.chunk("a.md", "") == [] and chunking.chunk("a.md", "short") == [("short", 1, 1, "paragraph")]
    big = chunking.chunk("a.md", "# H\n" + "\n".join(["x" * 99] * 200))
    assert all(len(c[0].encode()) <= 8100 for c in big) and [c[1] for c in big[1:]] == [c[2] + 1 for c in big[:-1]]
    lines_ = [n for c in chunking.chunk("a.md", text) for n in range(c[1], c[2] + 1)]
    assert len(lines_) == len(set(lines_))


def test_long_sections_are_cut_after_a_blank_line():
    text = "# H\n" + "\n".join("" if i == 60 else "x" * 99 for i in range(1, 92))
    assert [(c[1], c[2]) for c in chunking.chunk("a.md", text)] == [(1, 61), (62, 92)]
    # the 61st line is blank and goes with the first part, also when it is the last line that fits
    assert chunking.chunk("a.md", text)[0][0].endswith("\n")


def test_code_and_text_chunks():
    code = "import a_module_with_a_long_name\ndef first():\n    return 'something long enough'\n\nclass Second:\n    attribute = 'long enough to keep'\n"
    assert [(c[3], c[1], c[2]) for c in chunking.chunk("a.PY", code)] == [("function", 1, 1), ("function", 2, 4), ("function", 5, 6)]
    assert [(c[1], c[2]) for c in chunking.chunk("a.py", "\n".join(f"value_{i} = {i}" for i in range(201)))] == [(1, 100), (101, 200)]
    assert [(c[0], c[1], c[2]) for c in chunking.chunk("a.txt", f"{LONG}\r\n\r\n{LONG}\n{LONG}\n")] == [(LONG, 1, 1), (f"{LONG}\n{LONG}", 3, 4)]
    assert [c[3] for c in chunking.chunk("a.txt", "tiny")] == ["paragraph"]
    assert chunking.chunk("a.txt", "é" * 15)[0][0] == "é" * 15


@pytest.mark.parametrize("name", ["chunk_markdown_long", "chunk_code"])
def test_chunks_of_short_documents_equal_their_sql(spark, tmp_path, name):
    import __spark_entry__ as registered
    import duckdb

    texts = ["Aa. Bb. ", "Aa. Bb", "a\n", "a\nb\nc\n\n", "a\n\n", "\n", "", None, ". . ", f"{LONG}. {LONG}\n", f"{LONG}\n\n", "\n".join(["a long enough line, many times"] * 700) + "\n"]
    rows = [(i, t, "en", "src1", len(t or "")) for i, t in enumerate(texts, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(registered.oracle_sql()[name]).fetchall()
    assert sorted(map(tuple, registered.queries()[name](spark, str(tmp_path)).collect())) == sorted(want) and len({r[0] for r in want}) >= 8


def test_ingest(spark):
    files = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, content string")
    stored = spark.createDataFrame([("b", "2", True), ("c", "x", False), ("d", "4", False)], "path string, content string, extracted boolean").withColumn("content_hash", T.content_hash(F.col("content")))
    changes = ingest.diff(files, stored)
    assert dict(map(tuple, changes.collect())) == {"a": "new", "b": "unchanged", "c": "updated", "d": "deleted"}
    assert dict(map(tuple, ingest.diff(files, stored, force=True).collect()))["b"] == "updated"
    assert ingest.resume(stored, files, changes).count() == 0
    assert ingest.migrate(files, 0)[1] == 2


def test_retrieve(spark):
    chunks = spark.createDataFrame([(i, 1, f"c{i}", 2 * i, 2 * i) for i in range(1, 6)], "chunk_id long, doc_id long, content string, line_start int, line_end int")
    got = retrieve.neighbours(chunks, chunks.where("chunk_id = 1"), 2, 1).orderBy("offset").collect()
    assert [(r.chunk_id, r.offset) for r in got] == [(1, 0), (2, 1)]
    d = spark.createDataFrame([(1, "\n".join(f"l{i}" for i in range(1, 12)) + "\n")], "doc_id long, content string")
    one = retrieve.line_context(chunks.where("chunk_id = 2"), d, 2, 3).first()
    assert one.context_before_lines == ["l2", "l3"] and one.context_after_lines == ["l5", "l6", "l7"]
    parity = retrieve.line_context(chunks.where("chunk_id = 2"), d, 2, 2, parity=True).first()
    assert parity.context_before_lines == ["l3", "l4"] and parity.context_after_lines == ["l6", "l7"]
    last = retrieve.line_context(chunks.where("chunk_id = 5"), d, 99, 99).first()
    assert len(last.context_before_lines) == 9 and last.context_after_lines == ["l11"]


def test_text_functions(spark):
    assert column(spark, T.sanitize_query, '  a?  "b" (c) ') == "a b c"
    assert column(spark, T.fts_tokens, "Café flash_lite x1") == ["cafe", "flash", "lite", "x1"]
    assert column(spark, T.lines, "a\r\nb\n") == ["a", "b"] and column(spark, T.lines, "") == []
    assert column(spark, T.extension, "a/b.TAR.Gz") == "gz" and column(spark, T.extension, "a/.md") == ""
    assert column(spark, T.file_stem, "x/y.z.md") == "y.z"
    assert math.isclose(1 / 61, 0.01639344262295082)
