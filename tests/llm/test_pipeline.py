"""The pipeline's stages one after the other, each on what the one before kept."""

import random

import corpus_pipeline
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

STOCK = {"en": "the of and to in is that for with was which".split(), "fr": "le la les des et une que dans pour qui être".split()}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng = random.Random(3)
    rows = []
    for k in range(160):
        lang = rng.choice(list(STOCK))
        rows.append((k, " ".join(f"{rng.choice(STOCK[lang])} {rng.choice(STOCK[lang])}{k % 7}" for _ in range(60)), lang, f"s{k % 4}"))
    rows += [(200, rows[0][1], "en", "s0"), (201, rows[1][1] + " tail", "en", "s0"), (202, "1234 !!", "en", "s0"), (203, None, "en", None)]
    root = tmp_path_factory.mktemp("tables")
    table = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows], "lang": [r[2] for r in rows], "source": [r[3] for r in rows], "n_chars": pa.array([len(r[1] or "") for r in rows], pa.int64())})
    pq.write_table(table, root / "documents.parquet")
    return str(root)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, folder)
        if k < 4:
            assert docs.columns == columns
        seen[name] = docs.select("doc_id").toPandas().doc_id.tolist()
    assert {202, 203}.isdisjoint(seen["language"]) and set(range(160)) <= set(seen["language"])
    assert sorted(seen["exact_dedup"]) == sorted({*seen["language"]} - {200})
    assert sorted(seen["near_dedup"]) == sorted({*seen["exact_dedup"]} - {201})
    assert set(seen["mixing"]) <= set(seen["near_dedup"]) and max(map(seen["mixing"].count, seen["mixing"])) == 2
    assert sorted(seen["pieces"]) == sorted(seen["mixing"])


def test_run_gives_the_last_stage(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 100


def _folder(root, rows, more=()):
    table = {"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()), "lang": pa.array([r[2] for r in rows], pa.string()), "source": pa.array([r[3] for r in rows], pa.string()), "n_chars": pa.array([len(r[1] or "") for r in rows], pa.int64())}
    root.mkdir()
    pq.write_table(pa.table(table | {name: pa.array([f"{name} {k}" for k in range(len(rows))], pa.string()) for name in more}), root / "documents.parquet")
    return str(root)


def test_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, _folder(tmp_path / "empty", [])).count() == 0


def test_repeated_and_null_ids_and_clashing_columns(spark, tmp_path):
    rng = random.Random(9)
    prose = lambda n: " ".join(f"{rng.choice(STOCK['en'])} {rng.choice(STOCK['en'])}{rng.randrange(30)}" for _ in range(n))
    rows = [(k, prose(40), "en", f"s{k % 2}") for k in range(30)] + [(k, prose(40), "fr", None) for k in range(5)]  # ids 0 to 4 twice
    rows += [(None, prose(40), "en", "s0") for _ in range(4)] + [rows[7], rows[7], (3, "", None, "s1"), (None, None, None, None)]
    folder = _folder(tmp_path / "odd", rows, ("own_doc_id", "owndoc_id", "mix_copies", "label", "node"))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        docs = stage(spark, docs, folder)
        assert docs.columns == columns, k
    kept = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in docs.select("doc_id", "text").collect())
    assert kept == sorted((i is None, i or 0, t) for i, t in {(i, t) for i, t, _, _ in rows if (t or "").strip()})
    out = corpus_pipeline.run(spark, folder).collect()
    assert 30 < len(out) <= 2 * len(kept) and {r.doc_id for r in out} <= {r[0] for r in rows}


def test_scratch_tables_go_when_a_stage_is_written(spark, folder):
    from tidemark.llm.common import staged_so_far

    before = set(staged_so_far())
    assert corpus_pipeline.run(spark, folder).count() > 0
    left = [path.rsplit("/", 1)[1] for path in staged_so_far() if path not in before]
    assert len(left) == 4 and all(name.startswith("pipeline-") for name in left)
