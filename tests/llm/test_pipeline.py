import corpus_pipeline
from stockloom.llm import queries
from stockloom.session import materialize
from tools.check import compare, connect


def test_stages_in_order(llm, small, documents):
    sizes, docs = [documents.count()], documents
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(llm, docs, small))
        assert docs.columns == documents.columns
        sizes.append(docs.count())
    assert sizes[0] >= sizes[1] > sizes[2] and sizes[3] >= sizes[2]
    tokens = corpus_pipeline.STAGES[-1][1](llm, docs, small)
    assert tokens.where("start = 0").count() == sizes[3]
    assert tokens.select("sequence_id").distinct().count() == tokens.agg({"sequence_id": "max"}).first()[0] + 1
    assert corpus_pipeline.run(llm, small).agg({"length": "sum"}).first() == tokens.agg({"length": "sum"}).first()


def test_odd_rows(llm, small, odd, nothing):
    for docs, rows in ((odd, 5), (nothing, 0)):
        columns = docs.columns
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = materialize(stage(llm, docs, small))
            assert docs.columns == columns
        assert corpus_pipeline.STAGES[-1][1](llm, docs, small).where("start = 0").count() >= rows


def test_packing_follows_the_mixture_over_several_files(llm, documents, tmp_path):
    from stockloom.llm.mixing import mix_sources, mixture_schedule

    places = {}
    for r in mixture_schedule(documents).collect():
        places.setdefault((r.source, r.doc_id), []).append((r.slot, r.start))
    path = str(tmp_path / "mixed")
    llm.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    llm.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        mixed = mix_sources(documents)
        mixed.write.option("parquet.block.size", 65536).parquet(path)
        files = sorted((tmp_path / "mixed").glob("part-*"))
        assert len(files) > 2
        packed = corpus_pipeline.pack(llm, llm.read.parquet(path), None).collect()
    finally:
        llm.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        llm.conf.unset("spark.sql.files.maxPartitionBytes")
    begins = [r.doc_id for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)) if r.start == 0]
    written = [r.doc_id for f in files for r in llm.read.parquet(str(f)).collect()]
    assert begins == written
    source = {r.doc_id: r.source for r in documents.collect()}
    slots = []
    for doc in begins:
        turns = places[source[doc], doc]
        turns.sort()
        slots.append(turns.pop(0)[0])
    assert slots == sorted(slots)
    by_sequence = {}
    for r in packed:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_queries_and_sql(llm, small):
    import __spark_entry__ as contract
    from stockloom.catalog.registry import Query

    names = [f"op{n}_" for n in range(1, 14)]
    assert sorted(queries.QUERIES) == sorted(q for q in contract.queries() if any(q.startswith(n) for n in names))
    assert len(queries.QUERIES) == 13 and "pipeline" in contract.queries()
    for name, sql in queries.SQL.items():
        query = Query(name, lambda t, q=queries.QUERIES[name]: q(t.spark, t.directory), sql)
        status, detail, _ = compare(query, llm, connect(small), small)
        assert status == "ok", (name, detail)
