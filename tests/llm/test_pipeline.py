import re
from collections import defaultdict

import corpus_pipeline as cp
from galley.llm import mixing, near_dedup, quality


def test_stages_on_the_smallest_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    inputs = {}
    for name, stage in cp.STAGES:
        inputs[name] = docs.cache()
        docs = stage(spark, docs, sf_dir)
        if name != "packing":
            assert docs.columns == inputs[name].columns
    rows = {n: d.collect() for n, d in inputs.items()}
    texts = lambda n: {r.doc_id: r.text for r in rows[n]}
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for i, t in texts("exact_dedup").items():
        groups[norm(t)].append(i)
    assert set(texts("near_dedup")) == {min(g) for g in groups.values()}

    from tests.llm.test_near_dedup import brute

    found = brute([(i, t) for i, t in texts("near_dedup").items()], near_dedup.SHINGLE, near_dedup.PERCENT)
    assert set(texts("mixing")) == {i for i, (_, c) in found.items() if i == c}
    drawn = {r.doc_id: r.copies for r in mixing.copies(inputs["mixing"]).collect()}
    counts = defaultdict(int)
    for r in rows["packing"]:
        counts[r.doc_id] += 1
    assert counts == {i: n for i, n in drawn.items() if n}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    good = [i for i, q in labels.items() if q == 1 and i in texts("quality")]
    assert sum(i in texts("exact_dedup") for i in good) >= 0.95 * len(good)
    assert len(rows["exact_dedup"]) < len(rows["quality"])
    pieces = docs.collect()
    assert sum(p.length for p in pieces) == sum({(p.doc_id, p.doc_tokens): p.doc_tokens * counts[p.doc_id] for p in pieces}.values())


def test_stages_take_an_empty_table(spark, sf_dir):
    empty = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, stage in cp.STAGES[1:]:
        assert stage(spark, empty, sf_dir).collect() == [], name
    model = quality.RuleModel([], [], [], 0.0)
    assert quality.reject_low(empty, model).collect() == []


def test_results_of_other_calls_stay_readable(spark, sf_dir):
    """Stages called twice, and on two inputs in turn, leave each other's results alone."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    halves = docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1")
    for stage in (cp.drop_copies, cp.drop_near_copies, cp.mix_sources):
        first = [stage(spark, half, sf_dir) for half in halves]
        again = [stage(spark, half, sf_dir) for half in halves]
        counts = [df.count() for df in first]
        assert counts == [df.count() for df in again] == [df.count() for df in first]
        assert all(counts)


def test_run_cleans_up_behind_its_stages(spark, sf_dir):
    from galley.llm.common import collecting

    with collecting() as made:
        out = cp.run(spark, sf_dir)
    assert out.count() > 0
    left = [f for f in made if spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f))]
    assert len(left) == 1  # what the last stage reads
    assert f"/{left[0].rsplit('/', 1)[1]}/" in out.inputFiles()[0] or "galley-mixing" in left[0]
