"""The pipeline on planted cases, odd rows and against plain versions of its stages."""

import random
import re

import corpus_pipeline as P
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

DATA = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, k=5):
    w = text.lower().split()
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, min(len(w), 1)))}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Real documents and labels of a small table with planted cases and odd rows."""
    rng = random.Random(6)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))
    base = [r for r in docs.filter("doc_id < 400").collect()]
    clean = [f"w{rng.randrange(10**5)}" for _ in range(300)]
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").first().text
    near = list(clean)
    near[150] = "changed"
    made = [
        (5000, " ".join(clean)), (5001, " ".join(clean)), (5002, " ".join(near)), (5003, " ".join(clean[::-1]) + "\n" + item),
        (5004, "bad *** ### " * 60), (5005, ""), (5006, None), (5007, "too short"), (None, " ".join(reversed(clean[:200]))),
        (5008, " ".join(f"v{rng.randrange(10**5)}" for _ in range(30_000))),
    ]
    made += [made[0]] * 3
    extra = [(i, t, "en", "mine", len(t or "")) for i, t in made]
    out = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([tuple(r) for r in base] + extra, SCHEMA).write.parquet(f"{out}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{name}.parquet").write.parquet(f"{out}/{name}.parquet")
    return str(out)


@pytest.fixture(scope="module")
def stages(spark, folder, tmp_path_factory):
    """Rows after each stage, by stage name."""
    out = tmp_path_factory.mktemp("stages")
    rows = spark.read.parquet(f"{folder}/documents.parquet").withColumn("_quality", F.lit("x")).withColumn("_leaks", F.lit(1)).withColumn("dropped_lines", F.lit(2))
    kept = {"start": rows}
    for name, stage in P.STAGES:
        stage(spark, rows, folder).write.parquet(f"{out}/{name}")
        rows = kept[name] = spark.read.parquet(f"{out}/{name}")
    return kept


def ids(rows):
    return {r.doc_id for r in rows.select("doc_id").collect()}


def test_columns_stay(stages):
    for name, _ in P.STAGES[:-1]:
        assert stages[name].dtypes == stages["start"].dtypes


def test_quality_stage(stages):
    gone = ids(stages["start"]) - ids(stages["quality_rules"])
    assert {5004, 5005, 5006, 5007} <= gone and not {5000, 5001, 5002, 5003, 5008, None} & gone


def test_lines_stage(stages):
    before = {r.doc_id: r.text for r in stages["quality_rules"].collect()}
    for r in stages["line_dedup"].collect():
        assert r.n_chars == len(r.text) and set(r.text.split("\n")) <= set(before[r.doc_id].split("\n")) | {""}
    assert stages["line_dedup"].count() == stages["quality_rules"].count()


def test_near_duplicates_stage(stages):
    rows = [(r.doc_id, shingles(r.text)) for r in stages["line_dedup"].filter("doc_id is not null").dropDuplicates(["doc_id"]).collect()]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(rows):
        for j, b in rows[:k]:
            both = len(a & b)
            if both and 100 * both >= 80 * (len(a) + len(b) - both):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    assert ids(stages["near_duplicates"]) == {find(i) for i, _ in rows} | {None}
    assert stages["near_duplicates"].groupBy("doc_id").count().filter("count > 1").isEmpty()


def test_near_duplicates_are_rows_not_ids(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(5, a), (5, b), (7, b + " more"), (None, a), (None, "c " + b[::-1]), (None, "c " + b[::-1]), (None, None), (9, ""), (2, a + " also")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).repartition(3)
    kept = P.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(
        [(2, a + " also"), (5, b), (None, "c " + b[::-1]), (None, None), (9, "")], key=str)


def test_decontamination_stage(spark, stages, folder):
    items = [re.findall(r"\w+", r.text.lower()) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    held = {r.doc_id for r in stages["near_duplicates"].collect() for i in items if " ".join(i) in " ".join(re.findall(r"\w+", r.text.lower()))}
    gone = ids(stages["near_duplicates"]) - ids(stages["decontamination"])
    assert 5003 in gone and held <= gone and len(gone) <= len(held) + 1


def test_token_stage(stages):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in stages["decontamination"].collect()}
    rows = stages["token_ids"].collect()
    assert {r.doc_id for r in rows} == set(texts) and all(r.exact and r.n_tokens == len(r.ids) for r in rows)
    assert all(r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids for r in rows)


def test_no_documents(spark, folder, tmp_path):
    rows = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        rows = stage(spark, rows, folder)
        assert rows.count() == 0
