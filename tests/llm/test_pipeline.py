"""The pipeline's stages by brute force and on awkward rows."""

import random
import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in ("ba", "co", "di", "fu") for b in ("lan", "mer", "nos", "pit", "que")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], SCHEMA)


def texts(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


@pytest.fixture()
def sf_dir(spark, tmp_path):
    spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_toxic_rows_go_and_others_stay(spark, sf_dir):
    rng = random.Random(1)
    rows = [(i, prose(rng, 40) + (" zounds blighter scoundrel " if i % 4 == 0 else " ") + prose(rng, 40)) for i in range(400)] + [(None, None), (900, ""), (902, "zounds blighter scoundrel")]
    kept = texts(corpus_pipeline.drop_toxic(spark, frame(spark, rows), sf_dir))
    assert kept == sorted(((i, t) for i, t in rows if "zounds" not in (t or "")), key=str)
    assert corpus_pipeline.drop_toxic(spark, frame(spark, []), sf_dir).count() == 0


def test_exact_copies_go_row_by_row(spark, sf_dir):
    rows = [(1, "a b"), (1, "a b"), (2, "ab"), (None, "x y"), (None, "x y"), (3, "only here"), (3, "a  b"), (4, None), (5, ""), (6, "xy z")]
    kept = corpus_pipeline.drop_exact_copies(spark, frame(spark, rows), sf_dir)
    assert kept.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    got = texts(kept)
    bare = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in got]
    assert len(bare) == len(set(bare)) and set(bare) == {re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows}
    assert (3, "a  b") in got and (3, "only here") in got and (None, "x y") in got
    assert corpus_pipeline.drop_exact_copies(spark, frame(spark, []), sf_dir).count() == 0


def test_near_copies_go_row_by_row(spark, sf_dir):
    rng = random.Random(2)
    base, other, third = prose(rng, 80), prose(rng, 80), prose(rng, 80)
    rows = [(1, base), (2, base + " tail"), (3, other), (3, base + " more"), (None, third), (None, third + " end"), (5, other + " x"), (6, None), (7, ""), (8, prose(rng, 3)), (8, prose(rng, 70))]
    got = texts(corpus_pipeline.drop_near_copies(spark, frame(spark, rows), sf_dir))
    for start, n in ((base, 1), (other, 1), (third, 1)):
        assert sum((t or "").startswith(start) for _, t in got) == n
    assert (6, None) in got and (7, "") in got and sum(i == 8 for i, _ in got) == 2
    assert len(got) == 7


def test_masking_and_packing(spark, sf_dir):
    rows = [(1, "write to john@example.com or +49 30 1234567"), (2, None), (3, ""), (4, "plain"), (None, "10.0.0.1")]
    masked = corpus_pipeline.mask_personal_data(spark, frame(spark, rows), sf_dir)
    assert texts(masked) == sorted([(1, "write to [EMAIL] or [PHONE]"), (2, None), (3, ""), (4, "plain"), (None, "[IP]")], key=str)
    packed = corpus_pipeline.pack(spark, masked, sf_dir).collect()
    assert len(packed) == len(rows) and {r["sequence_id"] for r in packed} == {packed[0]["sequence_id"]}


def test_the_whole_pipeline(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    left = {r["doc_id"] for r in out.select("doc_id").distinct().collect()}
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()}
    assert left <= set(docs) and len(left) > 0.5 * len(docs)
    bare = [re.sub(r"\s", "", docs[i] or "") for i in left]
    assert len(bare) == len(set(bare))
