"""Each stage of the pipeline against a plain re-computation on its own input, and the whole of it."""

from collections import Counter, defaultdict

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from driftloom.llm.mixing import mix_sources
from driftloom.llm.pii import find
from driftloom.llm.quality import quality_verdicts
from driftloom.session import settle
from test_neardup import brute as brute_groups
from test_packing import whole_and_gapless

SF = "/root/testdata/sf0.001"


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def masked(text):
    out, at = "", 0
    for kind, start, end in sorted(find(text), key=lambda s: (s[1], -s[2])):
        if start >= at:
            out, at = out + text[at:start] + f"[{kind}]", end
        else:
            at = max(at, end)
    return out + text[at:]


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stage = dict(pipeline.STAGES)
    assert list(stage) == ["quality rules", "near duplicates", "personal data", "source mix", "packing"]

    good = settle(stage["quality rules"](spark, docs, SF))
    kept = {r.doc_id for r in quality_verdicts(docs).filter("kept").collect()}
    assert good.schema == docs.schema and rows(good) == Counter({tuple(r): 1 for r in docs.collect() if r.doc_id in kept})

    single = settle(stage["near duplicates"](spark, good, SF))
    first = {r[0] for r in brute_groups([(r.doc_id, r.text) for r in good.collect()], 5) if r[3]}
    assert single.schema == docs.schema and rows(single) == Counter({tuple(r): 1 for r in good.collect() if r.doc_id in first})

    clean = settle(stage["personal data"](spark, single, SF))
    assert clean.schema == docs.schema
    assert {r.doc_id: (r.text, r.n_chars) for r in clean.collect()} == {r.doc_id: (masked(r.text), len(masked(r.text))) for r in single.collect()}

    mix = settle(stage["source mix"](spark, clean, SF))
    assert mix.schema == docs.schema
    copies = {r.doc_id: r.copies for r in mix_sources(clean).collect()}
    assert rows(mix) == Counter({tuple(r): copies[r.doc_id] for r in clean.collect() if copies[r.doc_id]})

    packed = stage["packing"](spark, mix, SF).collect()
    bins, least = whole_and_gapless(packed, [(r.doc_id, r.text) for r in mix.collect()], 1024)
    assert bins <= 1.02 * least + 1


def test_run_is_registered_and_repeatable(spark):
    assert entry.queries()["pipeline"] is pipeline.run and pipeline.ORACLE_SQL is None
    parts = lambda: Counter(tuple(r)[:5] for r in pipeline.run(spark, SF).collect())
    assert parts() == parts()


def test_edges(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    words = " ".join(f"word{i}," for i in range(80)) + " a@b.cc"
    given = [
        (1, words, "en", "a", 1), (2, words, "en", "a", 1), (2, words, "en", "a", 1), (None, words, None, None, None), (None, "null id", None, None, None),
        (None, "null id", None, None, None), (3, None, "en", "b", 0), (4, "", None, "b", None), (5, words * 200, "en", "b", 1),
    ]
    docs = spark.createDataFrame(given, schema)
    single = pipeline.near_duplicates(spark, docs, SF)
    assert sorted(str(r.doc_id) for r in single.collect()) == ["1", "3", "4", "None", "None"]  # 5 repeats the shingles of 1
    for df in (docs, docs.limit(0)):
        sizes = defaultdict(int)
        for name, stage in pipeline.STAGES:
            out = settle(stage(spark, df, SF))
            sizes[name] = out.count()
            assert name == "packing" or out.schema == schema
        assert (df is docs) == (sizes["packing"] > 0)
