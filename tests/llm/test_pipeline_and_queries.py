import re
from collections import defaultdict

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.oracle import connect, difference, spark_rows, sql_rows
from tidemill.llm.registry import QUERIES
from tidemill.llm.stages import staged

SMALL = "/root/testdata/sf0.001"
WITH_SQL = [n for n, q in QUERIES.items() if q.sql is not None]


@pytest.mark.parametrize("name", WITH_SQL)
def test_query_against_its_sql(spark, name):
    mine = spark_rows(entry.queries()[name](spark, SMALL))
    assert difference(mine, sql_rows(connect(SMALL), QUERIES[name].sql)) is None
    assert sum(mine[1].values()) > 0


@pytest.mark.parametrize(
    ("name", "columns"),
    [("op2_url_templates", "page_id host path rule verdict"), ("op3_html_content", "page_id url text n_chars"),
     ("op4_kneser_ney", "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept"),
     ("op5_entropy_mix", "doc_id size source_size target taken"),
     ("op6_linear_packing", "doc_id piece start length ids_crc32 sequence_id offset"),
     ("op7_pii_votes", "doc_id n_email n_ip n_card n_phone base_sha256 spans"), ("op8_jaccard_join", "doc_id n_shingles component_id"),
     ("op12_concat_cut", "doc_id start length ids_crc32 doc_tokens sequence_id offset")],
)
def test_query_covers_its_table(spark, name, columns):
    out = entry.queries()[name](spark, SMALL)
    wanted = columns.split()
    assert out.columns[: len(wanted)] == wanted
    table = "pages" if wanted[0] == "page_id" else "documents"
    ids = spark.read.parquet(f"{SMALL}/{table}.parquet").select(wanted[0])
    assert out.select(wanted[0]).distinct().count() == ids.count()


def test_whitening_covers_its_table(spark):
    out = entry.queries()["op11_chebyshev_whitening"](spark, SMALL)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = out.collect()
    assert len(rows) == 4 * spark.read.parquet(f"{SMALL}/embeddings.parquet").where("embedding is not null").count()
    assert max(r.identity_error for r in rows) < 1e-12


def test_mix_comes_near_its_targets(spark):
    by_source = defaultdict(lambda: [0, 0.0])
    for r in entry.queries()["op5_entropy_mix"](spark, SMALL).collect():
        assert 0 <= r.taken <= 3 * r.size
        by_source[r.source][0] += r.taken
        by_source[r.source][1] = r.target
    for taken, target in by_source.values():
        assert abs(taken - target) <= max(0.05 * target, 60)


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.encode().lower().decode())
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    clean = docs.where("doc_id % 2 = 0").limit(20)
    extra = spark.createDataFrame([(9001, None, None, None, None), (None, "lone words", "en", "s", 10)], docs.schema)
    docs = docs.unionByName(extra).unionByName(clean)
    columns, kept = docs.columns, [docs]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(n))
        stage(spark, kept[-1], SMALL).write.parquet(path)
        kept.append(spark.read.parquet(path))
    assert all(k.columns == columns for k in kept[:-1])
    raw, good, single, private, mixed, packed = kept
    failed = {r.doc_id for r in good.collect()}
    for r in raw.collect():
        words = len((r.text or "").split())
        assert words >= 20 or r.doc_id not in failed
    texts = {r.doc_id: shingles(r.text) for r in single.collect()}
    assert len(texts) == single.count()
    for i, a in texts.items():
        for j, b in texts.items():
            assert i >= j or 100 * len(a & b) < 75 * len(a | b)
    assert {r.doc_id for r in private.collect()} == set(texts)
    assert not any(re.search(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+|@mail", r.text) for r in private.collect())
    assert all(r.n_chars == len(r.text) for r in private.where("text like '%<%>%'").collect())
    copies = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert set(copies) <= set(texts) and max(copies.values()) <= 3
    assert packed.where("piece = 0").count() == mixed.count()


def test_stages_take_empty_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        assert docs.count() == 0


def test_freed_memory_of_the_driver_is_given_back(spark):
    jvm = spark._jvm
    pid = jvm.java.lang.ProcessHandle.current().pid()

    def resident():
        with open(f"/proc/{pid}/status") as status:
            return int(re.search(r"VmRSS:\s+(\d+)", status.read())[1]) / 1024

    before = resident()
    taken = [jvm.java.util.zip.Deflater() for _ in range(2000)]  # outside of the heap, in small pieces
    assert resident() - before > 100
    for deflater in taken[:-1]:  # the last one keeps the others from being at the end of what the C library holds
        deflater.end()
    held = resident()
    staged(spark.range(1), "memory")
    assert held - resident() > 60
    taken[-1].end()
