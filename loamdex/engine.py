"""The engine: sync, search, retrieve, status over a snapshot store."""

from __future__ import annotations

import datetime
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, functions as F

from loamdex.catalog import SCHEMA_VERSION, TABLES, Store, columns_of
from loamdex.functions import text as T
from loamdex.operators import chunking, fts, fusion, graph, ingest, lines, retrieve, vector, vocab
from loamdex.session import materialise, temporary
from loamdex.sources import files, providers
from loamdex.sources.config import Config

ENGINES = ("fuzzy", "graph", "vector")
#: The counters of a sync, per knowledge base.
REPORT = "kb string, new long, updated long, deleted long, unchanged long, resumed long, chunks long, vocabulary_words long, entities_extracted long, relationships_extracted long, vectors_embedded long, vectors_reembedded long, errors long, status string"
_HIT = "engine string, file string, chunk_id long, score double, content string, line_start int, line_end int, chunk_type string"


class Engine:
    def __init__(self, spark: SparkSession, config: Config, embedder=None, extractor=None, decomposer=None, source=None):
        """source: instead of the watch paths, a function from names of knowledge bases to (kb, path, content)."""
        self.spark, self.config, self.source = spark, config, source
        self.store = Store(spark, config.data_dir)
        self.store.migrate()
        self.embedder = embedder or providers.make_embedder(config.embeddings)
        self.extractor = extractor or providers.make_extractor(config.extraction)
        self.decomposer = decomposer or providers.make_decomposer(config.extraction)

    def _bases(self, kb: str | None, auto_only: bool = False) -> list[str]:
        if kb is not None:
            if kb not in self.config.knowledge_bases:
                raise KeyError(f"unknown knowledge base: {kb}")
            return [kb]
        return sorted(n for n, b in self.config.knowledge_bases.items() if b.auto_sync or not auto_only)

    def _files(self, names: list[str], only: DataFrame | None = None) -> DataFrame:
        """(kb, path, content, content_hash) of what the watch paths hold now; only: of these (kb, path). A file that two watch paths hold
        counts once. Contents are shuffled for `only` at most: a listing of hashes never moves them."""
        found = self._found(names)
        if only is not None:
            found = found.join(only.select("kb", "path"), ["kb", "path"], "left_semi")
        return found.dropDuplicates(["kb", "path"])

    def _found(self, names: list[str]) -> DataFrame:
        if self.source is not None:
            return self.source(names).select("kb", "path", "content", T.content_hash(F.col("content")).alias("content_hash"))
        ignore = self.config.folder / ".loamignore"
        patterns = files.ignore_patterns(ignore.read_text()) if ignore.is_file() else []
        out = self.spark.createDataFrame([], "kb string, path string, content string, content_hash string")
        for kb in names:
            for p in self.config.knowledge_bases[kb].watch_paths:
                df = files.read_watch_path(self.spark, p, patterns)
                if df is not None:
                    out = out.unionByName(df.select(F.lit(kb).alias("kb"), "path", "content", "content_hash"))
        return out

    def diff(self, kb: str, force: bool = False) -> DataFrame:
        """(path, change_type) of one knowledge base."""
        return ingest.diff(self._files([kb]).select("path", "content_hash"), self.store.read("documents", [kb]).select("path", "content_hash"), force)

    # sync

    def sync(self, kb: str | None = None, force: bool = False, dry_run: bool = False, reembed: bool = False) -> DataFrame:
        """Bring the store up to date; a row of counters per knowledge base. All bases are worked through in one plan, and only what
        changes is chunked, indexed, embedded, extracted and written."""
        names = self._bases(kb)
        if not dry_run and not self.store.lock():
            raise RuntimeError("another sync is running")
        try:
            with temporary():
                rows = self._sync(names, force, dry_run, reembed) if names else []
        finally:
            if not dry_run:
                self.store.unlock()
        return self.spark.createDataFrame(rows, REPORT)

    def _sync(self, names: list[str], force: bool, dry_run: bool, reembed: bool) -> list[tuple]:
        store = self.store
        # the listing is written once, so everything below sees one state of the files
        listing = materialise(self._files(names).select("kb", "path", "content_hash"), "sync-listing")
        stored = store.read("documents", names)
        changes = ingest.diff(listing, stored, force, ("kb",))
        none = self.spark.createDataFrame([], "kb string, path string")
        resumed = none if force or self.extractor is None else ingest.resume(stored, listing, changes, ("kb",))
        changes = materialise(changes.unionByName(resumed.withColumn("change_type", F.lit("resumed"))), "sync-changes")
        counts: dict[str, dict[str, int]] = {n: {} for n in names}
        for r in changes.groupBy("kb", "change_type").count().collect():
            counts[r.kb][r.change_type] = r["count"]
        if dry_run:
            return [self._report(n, counts[n], "dry run") for n in names]
        chunks_before, vectors_before = store.read("chunks", names), store.read("vectors", names)
        missing = {r.kb for r in ingest.to_embed(chunks_before, vectors_before, self.embedder.dimension).select("kb").distinct().collect()}
        busy = [n for n in names if set(counts[n]) - {"unchanged"} or reembed or n in missing]
        if not busy:
            return [self._report(n, counts[n], "up to date") for n in names]

        changed = changes.where(F.col("change_type").isin("new", "updated"))
        gone = changes.where(F.col("change_type").isin("new", "updated", "deleted")).select("kb", "path")
        # content and hash come from one read, so they agree even if a file has changed since the listing
        fresh = self._files(names, changed)
        fresh = materialise(fresh.select("kb", F.xxhash64("kb", "path").alias("doc_id"), "path", "content", "content_hash"), "sync-fresh")
        again = stored.join(changes.where("change_type = 'resumed'").select("kb", "path"), ["kb", "path"], "left_semi").select("kb", "path", "content")

        asked = fresh.select("kb", "path", "content").unionByName(again)
        extracted = materialise(providers.extract_column(asked if self.extractor else asked.limit(0), self.extractor).drop("content"), "sync-extracted")
        done = extracted.where("ok").select("kb", "path").withColumn("extracted", F.lit(True))
        fresh_docs = fresh.join(done, ["kb", "path"], "left").withColumn("extracted", F.coalesce("extracted", F.lit(False))).withColumn("updated_at", F.current_timestamp())
        made = chunking.chunk_documents(fresh, also=("kb",))
        made = materialise(made.withColumn("chunk_id", F.xxhash64("kb", "path", "ordinal")).select(*columns_of("chunks")), "sync-chunks")

        # partitions of the paths that change; those of vectors that are to be made too
        touched = changes.where("change_type <> 'unchanged'").select("kb", "path").distinct()
        parts = [r.p for r in touched.select(store.part("documents").alias("p")).distinct().collect()]

        def rest(name: str, where: list[str]) -> DataFrame:
            """What stays in some partitions of a table."""
            return store.read(name, parts=where).join(gone, ["kb", "path"], "left_anti").select(*columns_of(name))

        documents = ingest.mark_extracted(rest("documents", parts), done, ("kb",)).unionByName(fresh_docs.select(*columns_of("documents")))
        whole = fresh.withColumn("level", F.lit("document")).withColumn("key", F.col("doc_id")).withColumn("content", F.concat_ws(" ", "path", "content"))
        texts = made.select("kb", "path", F.lit("chunk").alias("level"), F.col("chunk_id").alias("key"), "content").unionByName(whole.select("kb", "path", "level", "key", "content"))
        postings = fts.postings(texts, keys=("kb", "path", "level", "key"))
        lengths = fts.lengths(texts, by=("kb", "path", "level"))

        dimension = self.embedder.dimension
        kept = vectors_before.join(gone, ["kb", "path"], "left_anti").where(F.size("embedding") == dimension)
        kept = kept.join(chunks_before.select("kb", "chunk_id"), ["kb", "chunk_id"], "left_semi").select(*columns_of("vectors"))
        every = chunks_before.join(gone, ["kb", "path"], "left_anti").select(*columns_of("chunks")).unionByName(made)
        todo = every if reembed else ingest.to_embed(every, kept)
        embedded = providers.embed_column(todo.withColumn("_input", self.embedder.document_input(T.file_stem(F.col("path")), F.col("content"))), self.embedder, "_input")
        embedded = materialise(embedded.select(*columns_of("vectors")), "sync-vectors")
        # those of another dimension and those of chunks that are gone go too
        stale = vectors_before.where(F.size("embedding") != dimension).select("kb", "path").unionByName(embedded.select("kb", "path")).distinct()
        vector_parts = sorted({*parts, *(r.p for r in stale.select(store.part("vectors").alias("p")).distinct().collect())})
        own = kept.join(embedded.select("kb", "chunk_id"), ["kb", "chunk_id"], "left_anti").select(*columns_of("vectors"))
        others = store.read("vectors", parts=vector_parts).where(~F.col("kb").isin(names))
        vectors = own.withColumn("_p", store.part("vectors")).where(F.col("_p").isin(vector_parts)).drop("_p").unionByName(others).unionByName(embedded)

        new_nodes, new_edges = graph.ingest(extracted.where("ok"), ("kb",))
        again_paths = again.select("kb", "path")
        nodes, edges = graph.merge(store.read("nodes", busy), store.read("edges", busy), new_nodes, new_edges, gone.unionByName(again_paths))
        base_parts = [store.base_part(n) for n in busy]
        bases = {n: store.read(n, parts=base_parts).where(~F.col("kb").isin(busy)) for n in ("vocabulary", "nodes", "edges", "meta")}
        words = vocab.build_vocabulary(stored.where(F.col("kb").isin(busy)).join(gone, ["kb", "path"], "left_anti").select("kb", "content").unionByName(fresh.select("kb", "content")), by=("kb",))
        stamp = datetime.datetime.now(datetime.timezone.utc).isoformat()
        meta = self.spark.createDataFrame([x for n in busy for x in ((n, "last_sync", stamp), (n, "schema_version", str(SCHEMA_VERSION)))], TABLES["meta"])
        store.commit({
            "documents": (parts, documents), "chunks": (parts, rest("chunks", parts).unionByName(made)), "postings": (parts, rest("postings", parts).unionByName(postings.select(*columns_of("postings")))),
            "lengths": (parts, rest("lengths", parts).unionByName(lengths.select(*columns_of("lengths")))), "vectors": (vector_parts, vectors),
            "vocabulary": (base_parts, bases["vocabulary"].unionByName(words.select(*columns_of("vocabulary")))), "nodes": (base_parts, bases["nodes"].unionByName(nodes.select(*columns_of("nodes")))),
            "edges": (base_parts, bases["edges"].unionByName(edges.select(*columns_of("edges")))), "meta": (base_parts, bases["meta"].unionByName(meta)),
        })
        return self._reports(names, busy, counts, extracted, embedded, vectors_before)

    def _report(self, kb: str, counts: dict[str, int], status: str, *more: int) -> tuple:
        return (kb, *(counts.get(k, 0) for k in ("new", "updated", "deleted", "unchanged", "resumed")), *(more or (0,) * 7), status)

    def _reports(self, names, busy, counts, extracted, embedded, vectors_before) -> list[tuple]:
        def by_kb(df: DataFrame) -> dict[str, tuple]:
            return {r[0]: tuple(r)[1:] for r in df.collect()}

        chunks = by_kb(self.store.read("chunks", names).groupBy("kb").count())
        words = by_kb(self.store.read("vocabulary", names).groupBy("kb").count())
        found = by_kb(extracted.groupBy("kb").agg(F.sum(F.size("entities")), F.sum(F.size("relationships")), F.count_if(~F.col("ok"))))
        before = vectors_before.select("kb", "chunk_id").withColumn("_had", F.lit(True))
        made = by_kb(embedded.join(before, ["kb", "chunk_id"], "left").groupBy("kb").agg(F.count("*"), F.count("_had")))
        out = []
        for n in names:
            entities, relations, errors = found.get(n, (0, 0, 0))
            new, again = made.get(n, (0, 0))
            out.append(self._report(n, counts[n], "synced" if n in busy else "up to date", chunks.get(n, (0,))[0], words.get(n, (0,))[0], entities, relations, new, again, errors))
        return out

    # search

    def _chunks(self, kb: str | None) -> DataFrame:
        df = self.store.read("chunks", self._bases(kb))
        return df.withColumn("file", F.concat_ws(":", "kb", "path")).withColumn("chunk_type", F.coalesce("chunk_type", F.lit("")))

    def corrections(self, query: str, kb: str | None = None) -> DataFrame:
        """(qid, pos, from_word, to_word) of the words that the vocabulary corrects."""
        changes = vocab.correct_query(query, self.store.read("vocabulary", self._bases(kb)))[1]
        return self.spark.createDataFrame([(0, *c) for c in changes], "qid int, pos int, from_word string, to_word string")

    def sub_queries(self, text: str) -> list[str]:
        """What a smart search asks: at most five queries."""
        return self.decomposer.decompose(text)[:5]

    def _task(self, kb: str | None) -> str:
        """The task that queries are embedded for: code retrieval if the named base holds code."""
        if kb is None:
            return "search result"
        return "code retrieval" if self.store.read("documents", [kb]).agg(files.has_code(F.col("path"))).first()[0] else "search result"

    def _text_hits(self, query: str, bases: list[str], kb: str | None, k: int) -> DataFrame:
        """Chunks by the index; if none matches, documents by path and content."""
        postings, lengths = self.store.read("postings", bases), self.store.read("lengths", bases)
        empty = {"line_start": "int", "line_end": "int", "chunk_type": "string"}
        keys = ("kb", "path", "key")
        top = self._small(fts.search_index(postings.where("level = 'chunk'").drop("level"), lengths.where("level = 'chunk'"), query, keys, k))
        if top.isEmpty():
            top = self._small(fts.search_index(postings.where("level = 'document'").drop("level"), lengths.where("level = 'document'"), query, keys, k))
            docs = self.store.read("documents", bases).select(F.col("doc_id").alias("key"), "content")
            hits = docs.join(F.broadcast(top), "key").select(F.concat_ws(":", "kb", "path").alias("file"), F.lit(None).cast("long").alias("chunk_id"), "score", "content", *[F.lit(None).cast(t).alias(c) for c, t in empty.items()])
        else:
            chunks = self._chunks(kb)
            hits = chunks.join(F.broadcast(top.select(F.col("key").alias("chunk_id"), "score")), "chunk_id").select("file", "chunk_id", "score", "content", "line_start", "line_end", "chunk_type")
        return hits.withColumn("engine", F.lit("fts"))

    def _small(self, df: DataFrame) -> DataFrame:
        """At most k rows, brought to the driver once, so that plans over them stay small."""
        return self.spark.createDataFrame(df.collect(), df.schema)

    def hits(self, query: str, words: str | Callable[[], str], kb: str | None, k: int, engines: tuple[str, ...], exact: bool = False) -> DataFrame:
        """The engines' lists of one query, each cut to k. words: the query as corrected for the text and graph engines, or what corrects it.

        The lists are independent jobs of few tasks each, so they run side by side; what needs no corrected words does not wait for them."""
        bases = self._bases(kb)
        columns = [f.split()[0] for f in _HIT.split(", ")]
        none = {c: F.lit(None).cast(t) for c, t in (f.split() for f in _HIT.split(", "))}

        def text() -> DataFrame:
            return self._text_hits(fixed.result() if "fuzzy" in engines else query, bases, kb, k)

        def near() -> DataFrame:
            v = self.embedder.embed([self.embedder.query_input(self._task(kb), query)])[0]
            top = self._small(vector.knn(self.store.read("vectors", bases), v, k, key="chunk_id").select("chunk_id", "score"))
            return self._chunks(kb).join(F.broadcast(top), "chunk_id").withColumn("engine", F.lit("vector"))

        def related() -> DataFrame:
            nodes, edges = (self.store.read(t, bases) for t in ("nodes", "edges"))
            top = graph.search(nodes, edges, " ".join(dict.fromkeys(f"{query} {fixed.result()}".split())), k, by=("kb",), related=0)
            return top.withColumns(none | {"file": F.concat_ws(":", "kb", "path"), "score": F.col("score"), "engine": F.lit("graph")})

        def local() -> DataFrame:
            docs = self.store.read("documents", bases).select(F.concat_ws(":", "kb", "path").alias("file"), "content")
            place = F.col("line_no").cast("int")
            top = lines.search(docs, query, k, exact).withColumns({"content": F.col("line"), "line_start": place, "line_end": place, "engine": F.lit("fuzzy")})
            return top.withColumns({c: none[c] for c in ("chunk_id", "chunk_type")})

        asked = [(text, {"fuzzy", "text"}), (near, {"vector"}), (related, {"graph"}), (local, {"local"})]
        out = self.spark.createDataFrame([], _HIT)
        with ThreadPoolExecutor(len(asked) + 1) as pool:

            def start(f: Callable):
                return pool.submit(inheritable_thread_target(self.spark)(f))

            fixed = start(words if callable(words) else lambda: words)
            found = [start(lambda f=f: self._small(f().select(*columns))) for f, names in asked if names & set(engines)]
            for df in found:
                out = out.unionByName(df.result())
        return out

    def search(self, query: str, kb: str | None = None, limit: int = 5, engines: tuple[str, ...] = ENGINES, exact: bool = False, doc_score: bool = False, smart: bool = False, fetch_k: int | None = None) -> DataFrame:
        """Ranked results: file, score, sources, content, chunk_id, line_start, line_end, chunk_type.

        engines: fuzzy (corrected text), text, graph, vector, local. exact means a line search. smart: several sub-queries, none corrected."""
        engines = ("local",) if exact or "local" in engines and len(engines) == 1 else tuple(engines)
        k = fetch_k or limit
        if smart:
            hits = self.spark.createDataFrame([], _HIT)
            for q in self.sub_queries(query):
                hits = hits.unionByName(self.hits(q, q, kb, k, engines, exact))
            key = F.coalesce(F.col("chunk_id").cast("string"), F.col("file"))
            hits = fusion.dedup_best(hits.withColumn("_key", key), ("engine", "_key"), ("file",)).drop("_key")
        else:

            def corrected() -> str:
                return vocab.correct_query(fts.sanitize(query), self.store.read("vocabulary", self._bases(kb)))[0] or query

            hits = self.hits(query, corrected if "fuzzy" in engines else query, kb, k, engines, exact)
        out = fusion.fuse(hits, limit=limit, doc_score=doc_score)
        return out if doc_score else fusion.enrich_graph_only(out, self._chunks(kb)).orderBy(F.desc("score"), "file", F.col("line_start").asc_nulls_last(), "chunk_id")

    def retrieve(self, chunk_id: int, lines_before: int = 0, lines_after: int = 0, chunks_before: int = 0, chunks_after: int = 0) -> DataFrame:
        """One row: the chunk with lines and chunks around it."""
        return self.retrieve_many(self.spark.createDataFrame([(chunk_id,)], "chunk_id long"), lines_before, lines_after, chunks_before, chunks_after)

    def retrieve_many(self, wanted: DataFrame, lines_before: int = 0, lines_after: int = 0, chunks_before: int = 0, chunks_after: int = 0) -> DataFrame:
        """A row for each wanted chunk (chunk_id) that there is."""
        chunks, docs = self.store.read("chunks"), self.store.read("documents").select("doc_id", "content")
        some = chunks.join(wanted.select("chunk_id").distinct(), "chunk_id", "left_semi").select(*chunks.columns)
        out = retrieve.line_context(some, docs, lines_before, lines_after)
        near = retrieve.neighbours(chunks, some, chunks_before, chunks_after)
        part = F.struct("offset", "chunk_id", "line_start", "line_end", "content")
        sides = near.groupBy("wanted_id").agg(F.sort_array(F.collect_list(F.when(F.col("offset") < 0, part))).alias("chunks_before"), F.sort_array(F.collect_list(F.when(F.col("offset") > 0, part))).alias("chunks_after"))
        return out.join(sides, out["chunk_id"] == sides["wanted_id"]).drop("wanted_id").withColumn("chunk_type", F.coalesce("chunk_type", F.lit("")))

    # overviews

    def status(self, kb: str | None = None) -> DataFrame:
        """A row per knowledge base: counts, bytes of text, last sync. vectors is -1 where none were ever made."""
        bases = self._bases(kb)
        names = self.spark.createDataFrame([(n, self.config.knowledge_bases[n].description, self.config.knowledge_bases[n].auto_sync) for n in bases], "kb string, description string, auto_sync boolean")
        docs = self.store.read("documents", bases).groupBy("kb").agg(F.count("*").alias("documents"), F.count_if("extracted").alias("extracted"), F.sum(F.octet_length("content").cast("long")).alias("bytes"))
        out = names.join(docs, "kb", "left")
        for table, column in (("chunks", "chunks"), ("vocabulary", "vocabulary"), ("vectors", "vectors"), ("nodes", "node_count"), ("edges", "edge_count")):
            out = out.join(self.store.read(table, bases).groupBy("kb").agg(F.count("*").alias(column)), "kb", "left")
        last = self.store.read("meta", bases).where("key = 'last_sync'").select("kb", F.col("value").alias("last_sync"))
        return out.na.fill(-1, ["vectors"]).na.fill(0).join(last, "kb", "left").orderBy("kb")

    def list_kbs(self) -> DataFrame:
        """A row per configured knowledge base, by name: its settings, documents, last sync."""
        rows = [(n, b.description, b.auto_sync, b.watch_paths) for n, b in sorted(self.config.knowledge_bases.items())]
        names = self.spark.createDataFrame(rows, "kb string, description string, auto_sync boolean, watch_paths array<string>")
        docs = self.store.read("documents").groupBy("kb").agg(F.count("*").alias("documents"))
        last = self.store.read("meta").where("key = 'last_sync'").select("kb", F.col("value").alias("last_sync"))
        return names.join(docs, "kb", "left").join(last, "kb", "left").na.fill(0, ["documents"]).orderBy("kb")
