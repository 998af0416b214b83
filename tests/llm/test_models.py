"""Toxicity, language ID and the pipeline: exact parts against brute force, fitted parts by held-out accuracy."""

import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loamdex.llm import _common, decontaminate, langid, toxicity
from loamdex.session import table

from .util import AWKWARD, docs

SF = "/root/testdata/sf0.001"


def near(a, b):
    """Within one edit, transpositions included."""
    if a == b:
        return True
    cuts = [(a[:i], a[i:]) for i in range(len(a) + 1)]
    letters = set(b) | {"\0"}
    out = {x + y[1:] for x, y in cuts if y} | {x + c + y[1:] for x, y in cuts if y for c in letters} | {x + c + y for x, y in cuts for c in letters}
    out |= {x + y[1] + y[0] + y[2:] for x, y in cuts if len(y) > 1}
    return b in out


def test_automaton_against_brute_force():
    rng = random.Random(2)
    words = {"idiot": 1.0, "abcab": 1.0, "abc": 1.0, "abcde": 0.5}
    lexicon = toxicity.Lexicon(words, {"loweb": 1.0})
    cases = {"".join(rng.choice("abcdeio") for _ in range(rng.randint(1, 7))) for _ in range(3000)}
    for w in list(words):
        for i, c in itertools.product(range(len(w) + 1), "xab"):
            cases |= {w[:i] + c + w[i:], w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :], w[:i] + w[i : i + 2][::-1] + w[i + 2 :]}
    for w in cases | {"lowebxyz", "loweb", "lowe"}:
        found = lexicon.look(w)
        want = "exact" if w in words else "near" if not w.startswith("loweb") and any(len(x) >= toxicity.FUZZY and near(x, w) for x in words) else "stem" if w.startswith("loweb") else None
        assert (found and found[1]) == want, w


def test_quotation():
    scan = toxicity.Scanner(toxicity.Lexicon({"idiot": 1.0}, {}))
    for text, quotes in [("you idiot", [False]), ('he said "you idiot" and left', [True]), ("an «idiot» is a word", [True]), ("Idiot! idi0t? 'x' idoit", [False, False, False]), ("the idiots", [False]), ("", []), (None, [])]:
        assert [q for *_, q in scan.hits(text)[0]] == quotes, text


def test_hits_do_not_depend_on_what_was_read_before(monkeypatch):
    monkeypatch.setattr(toxicity, "CLEAN", 3)
    lexicon = toxicity.Lexicon({"idiot": 1.0}, {"loweb": 1.0})
    texts = [*(f"you idiot#{i} and loweb{'abcdefghijklmnopqrst'[i]}" for i in range(20)), " ".join(f"idiot#{i}" for i in range(20)), "all is well", "an idoit"]
    scanner = toxicity.Scanner(lexicon)
    assert [scanner.hits(t) for t in texts] == [toxicity.Scanner(lexicon).hits(t) for t in texts]
    assert [len(scanner.hits(t)[0]) for t in texts] == [2] * 20 + [20, 0, 1]
    assert len(scanner.bad) <= 3 + 20


def test_toxicity_learns(spark):
    rng = random.Random(1)
    clean = ["".join(rng.choice("bcdfgh") + rng.choice("aeiou") for _ in range(2)) for _ in range(5000)]
    rows, labels = [], []
    for i in range(900):
        words = rng.sample(clean, 40)
        if i % 3 == 0:
            for w in rng.sample(["nastyword", "awfulterm", "uglyname"], 2):
                words.insert(rng.randint(0, 40), w)
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 3 == 0)))
    d = docs(spark, rows)
    model = toxicity.train(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert set(model["words"]) >= {"nastyword", "awfulterm", "uglyname"}
    got = {r.doc_id: r.predicted for r in toxicity.score(d, model).collect()}
    assert sum(got[i] == x for i, x in labels) >= 0.98 * len(labels)
    more = [(1, "aw1 nastywrod b uglynmae c"), (2, 'they wrote "nastyword" and "uglyname" on it'), *AWKWARD]
    scored = toxicity.score(docs(spark, more), model).collect()
    assert {r.predicted for r in scored if r.n_hits == 2 and r.n_quoted == 0} == {1} and {r.predicted for r in scored if r.n_hits != 2 or r.n_quoted} == {0}
    assert len(scored) == len(more) and all(0 <= r.score <= 1 for r in scored)
    assert toxicity.train(d, spark.createDataFrame([(1, None)], "doc_id long, toxic int")) is None
    assert toxicity.score(d.limit(0), None).count() == 0 and toxicity.score(d, None).agg(F.max("score")).first()[0] == 0


def segmentations(word):
    if not word:
        yield []
    for i in range(1, len(word) + 1):
        for rest in segmentations(word[i:]):
            yield [word[:i], *rest]


def test_forward_sums_all_segmentations():
    pieces = ["▁", "a", "b", "ab", "▁a", "ba", "▁ab"]
    p = np.array([[0.1], [0.2], [0.15], [0.25], [0.05], [0.2], [0.05]])
    scorer = langid.Scorer(["x"], pieces, p)
    by = dict(zip(pieces, p[:, 0], strict=True))
    words = ["a", "ab", "abab", "bba", "q", "aqb"]
    for w, got in zip(words, scorer.word_scores(words)[:, 0], strict=True):
        # letters that are no piece cost UNKNOWN; that is a segmentation too
        want = sum(math.prod(by.get(s, 0) + (langid.UNKNOWN if len(s) == 1 else 0) for s in parts) for parts in segmentations("▁" + w))
        assert got == pytest.approx(math.log(want), rel=1e-9)


def test_language_id(spark):
    rows = [*((100 + i, "the cat and the dog walked over the hill with them", "en") for i in range(40)), *((200 + i, "der hund und die katze liefen über den hügel", "de") for i in range(40)), *((i, t, None) for i, t in AWKWARD), (300, "die katze", None), (301, "THE HILL " * 5000, None), (302, "12 ² !", None)]
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.identify(docs(spark, rows)).collect()]
    by = {i: p for i, p, _ in got}
    assert len(got) == len(rows) and by[300] == "de" and by[301] == "en" and by[1] == by[2] == by[8] == by[302] == "und"
    assert all(by[i] == lang for i, _, lang in rows if lang) and all(0 <= s <= 1 for *_, s in got)
    assert {r.lang_pred for r in langid.identify(docs(spark, AWKWARD), docs(spark, AWKWARD).limit(0)).collect()} == {"und"}
    assert langid.identify(docs(spark, rows).limit(0)).count() == 0


def test_held_out_accuracy(spark):
    """Models that saw two thirds of the rows, on the third they didn't."""
    d, sf = table(spark, SF.replace("0.001", "0.01"), "documents"), SF.replace("0.001", "0.01")
    ours = langid.held_out(F.col("doc_id"))
    got = langid.identify(d).join(d.select("doc_id", "lang"), "doc_id").where(ours).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert got > 0.97
    labels = table(spark, sf, "labels")
    scored = toxicity.score(d, toxicity.train(d, labels)).join(labels, "doc_id").where(ours)
    assert scored.agg(F.avg((F.col("toxic") == F.col("predicted")).cast("int"))).first()[0] > 0.93
    assert [r.doc_id for r in d.where(ours).select("doc_id").limit(50).collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1] == []


def test_pipeline(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language ID", "n-gram Jaccard join", "benchmark decontamination", "best-fit packing"]
    before = table(spark, SF, "documents")
    now, kept = before, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.materialise(stage(spark, now, SF), "test-stage")
        assert now.columns == before.columns and now.exceptAll(before).count() == 0
        kept.append(now.count())
    assert before.count() > kept[0] >= kept[1] > kept[2] > kept[3] > 0
    assert corpus_pipeline.STAGES[-1][1](spark, now, SF).select("doc_id").distinct().count() == kept[3]
    odd = docs(spark, [*AWKWARD, (70, "some words that nobody else has here")]).select(before.columns)
    unique = corpus_pipeline.duplicate_stage(spark, odd, SF)
    assert sorted(str(r.doc_id) for r in unique.collect()) == sorted(map(str, [1, 2, 3, 4, None, 6, 7, 8, 9, 70]))


def test_stages_on_awkward_and_empty_tables(spark, tmp_path):
    d = docs(spark, [*AWKWARD, (80, "x" * 3), (None, "no id")]).withColumn("spans", F.lit("clash")).withColumn("row", F.lit("clash")).withColumn("component_id", F.lit(1))
    labels = spark.createDataFrame([(1, 1), (3, 0), (4, None)], "doc_id long, toxic int")
    bench = spark.createDataFrame([(1, "one two three"), (2, None), (None, "")], "item_id long, text string")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    want = {"toxicity": 13, "language ID": 10, "n-gram Jaccard join": 11, "benchmark decontamination": 10}
    for name, stage in corpus_pipeline.STAGES:
        got, none = stage(spark, d, str(tmp_path)), stage(spark, d.limit(0), str(tmp_path))
        assert none.count() == 0, name
        if name in want:
            assert got.columns == none.columns == d.columns and got.count() == want[name], name
            assert got.exceptAll(d).count() == 0
    assert got.select("doc_id", "piece").count() >= 13


def test_pipeline_by_brute_force(spark):
    """run() against its stages' rules applied row by row; scores and predictions are those of the fitted models."""
    d = table(spark, SF, "documents")
    rows = {r.doc_id: r.text for r in d.collect()}
    toxic = {r.doc_id for r in toxicity.score(d, toxicity.train(d, table(spark, SF, "labels"))).where("score >= 0.7").collect()}
    kept = {i: t for i, t in rows.items() if i not in toxic and any(c.isalpha() for c in t or "")}
    sets = {i: (lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)} - {()})(t.lower().split()) for i, t in kept.items()}
    label = {i: i for i in kept}

    def find(i):
        return i if label[i] == i else find(label[i])

    for i, j in itertools.combinations(sorted(kept), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 75 * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            label[b] = a
    kept = {i: t for i, t in kept.items() if find(i) == i}
    bench = [decontaminate.words_of(r.text.encode()) for r in table(spark, SF, "benchmark").collect() if r.text]
    windows = {tuple(w[k : k + min(10, len(w))]) for w in bench if w for k in range(len(w) - min(10, len(w)) + 1)}
    lengths = {len(w) for w in windows}

    def clean(text):
        w = decontaminate.words_of(text.encode())
        return not any(tuple(w[k : k + n]) in windows for n in lengths for k in range(len(w) - n + 1))

    kept = {i for i, t in kept.items() if clean(t)}
    out = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == kept
    spans = {}
    for r in out.collect():
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in spans.values():
        s.sort()
        assert [a for a, _ in s] == [sum(n for _, n in s[:k]) for k in range(len(s))] and sum(n for _, n in s) <= 4096


def test_rows_of_one_id_with_unlike_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(3, a), (5, a), (5, b), (5, b), (6, b + " more"), (7, c), (7, c + " more"), (7, None), (None, c)]
    d = docs(spark, rows)
    kept = corpus_pipeline.duplicate_stage(spark, d, SF)
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert kept.columns == d.columns and len(got) == 5
    assert {(3, a), (5, b), (7, None), (None, c)} < set(got) and {(7, c), (7, c + " more")} & set(got)


def test_training_sees_whole_runs_and_every_language(spark):
    head = "abcdefghijklmnopqrstuvwxyzabcd"
    rows = [*((i, f"{head}katzehund", "de") for i in range(20)), *((100 + i, f"{head}dogandcat", "en") for i in range(20)), (200, "dogandcat", None), (201, "katzehund", None)]
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs(spark, rows), docs(spark, rows)).collect()}
    assert (got[200], got[201]) == ("en", "de")
    many = docs(spark, [(i, "x", f"l{i % 300}") for i in range(900)])
    assert _common.bounded_sample(many, 3, "lang").select("lang").distinct().count() == 300
