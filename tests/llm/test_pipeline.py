"""The five stages on a small corpus: each one's decisions take effect on what the last one kept."""

import random

import corpus_pipeline
from provloom.storage import Scratch, load
from test_ngram_join import shingles

RNG = random.Random(4)
WORDS = "the and of to in is that it was for on with as be at by this have from or one had not but what all were when we there can an your which".split()


def write(spark, folder):
    prose = [" ".join(RNG.choice(WORDS) for _ in range(RNG.randint(30, 120))) for _ in range(120)]
    junk = [" ".join(f"{RNG.choice(WORDS)}###" for _ in range(60)) for _ in range(60)]
    copies = [prose[0], prose[0], prose[1] + " extra", None, "", "123 456 ###"]
    texts = prose + junk + copies
    rows = [(k, t, "en", f"src{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    labels = [(k, 1, 0) for k in range(0, 120, 2)] + [(k, 0, 0) for k in range(120, 180, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return texts


def test_stages(spark, tmp_path):
    folder = f"file://{tmp_path}"
    texts = write(spark, folder)
    docs, kept, scratch = load(spark, folder, "documents"), [], Scratch(spark, "test-stages")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.keep(stage(spark, docs, folder), name)
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        assert name == "packing" or docs.columns == columns
    language, quality, single, mixed, packed = kept
    assert language == set(range(183))  # texts without a letter are gone
    assert len(quality & set(range(120))) >= 115 and len(quality & set(range(120, 180))) <= 3
    sets = {k: shingles(texts[k]) for k in quality}
    gone = {a for a in quality for b in quality if b < a and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert {180, 181, 182} <= gone and single == quality - gone
    assert packed == mixed <= single and len(mixed) >= 0.8 * len(single)


def test_run_is_the_stages_in_turn(spark, tmp_path):
    write(spark, f"file://{tmp_path}")
    rows = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    ends = {}
    for r in rows:
        ends[r["sequence_id"]] = max(ends.get(r["sequence_id"], 0), r["offset"] + r["length"])
    assert max(ends.values()) <= 1024 and sum(ends.values()) == sum(r["length"] for r in rows)


def test_stages_on_odd_rows(spark, tmp_path):
    """Extra columns of clashing names, repeated and null ids, another text under a copy's id, a very long text."""
    folder = f"file://{tmp_path}"
    write(spark, folder)
    rng = random.Random(12)
    long, one, two = (" ".join(rng.choice(WORDS) for _ in range(n)) for n in (60_000, 90, 95))
    odd = spark.createDataFrame([(7000, long), (7001, one), (7001, one), (7002, one), (7002, two), (None, two + " and"), (None, None), (7003, "x")], "doc_id long, text string")
    docs = load(spark, folder, "documents").where("doc_id < 180").unionByName(odd, allowMissingColumns=True)
    docs = docs.selectExpr("*", "1 as score", "'a' as later", "true as keep", "doc_id as row_1", "array(1) as posterior", "'t' as tokens", "'v' as label").repartition(3)
    scratch, kept = Scratch(spark, "test-odd"), {}
    columns, kinds = docs.columns, docs.dtypes
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.keep(stage(spark, docs, folder), name)
        if name != "packing":
            assert docs.columns == columns and docs.dtypes == kinds
            kept[name] = sorted(((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").where("doc_id is null or doc_id >= 7000").collect()), key=str)
    assert [t for d, t in kept["language_id"] if d is None] == [two + " and"]
    assert kept["ngram_jaccard"].count((7001, one)) == 1 and (7002, one) not in kept["ngram_jaccard"]
    assert (7002, two) in kept["ngram_jaccard"] and (7000, long) in kept["ngram_jaccard"] and not any(d is None for d, _ in kept["ngram_jaccard"])
    assert docs.where("doc_id = 7000").agg({"length": "sum"}).first()[0] >= 60_000 or (7000, long) not in kept["mixing"]


def test_stages_on_empty_tables(spark, tmp_path):
    folder = f"file://{tmp_path}"
    write(spark, folder)
    for name in ("documents", "labels"):
        load(spark, folder, name).where("false").write.parquet(f"{folder}/none/{name}.parquet")
    docs = load(spark, f"{folder}/none", "documents")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, f"{folder}/none").collect() == [], name
