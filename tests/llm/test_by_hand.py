"""Language decisions and pivotal rounding against plain computations."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import extendible, language, mixing

FOLDER = "/root/testdata/sf0.001"


def plain_prediction(model, text):
    """One text by nested loops over its trigrams and the model's weights."""
    if not text or not any(c.isalpha() for c in text):
        return "und", 0.0
    raw = b"  " + bytes(32 if b < 128 and not chr(b).isalpha() else b for b in text.lower().encode()) + b" "
    shares, padded = {}, raw + b"  "
    for k in range(len(raw)):
        code = padded[k] << 16 | padded[k + 1] << 8 | padded[k + 2]
        at = (code * 2654435761 & 0xFFFFFFFF) >> 32 - language.BITS
        shares[at] = shares.get(at, 0) + 1
    margin = [sum(n * float(model.weights[at, m]) for at, n in shares.items()) / len(raw) + model.bias[m] for m in range(len(model.bias))]
    families = len(model.families) if len(model.families) > 1 else 0
    best, sure = 0, 1.0
    if families:
        best = max(range(families), key=lambda m: (margin[m], -m))
        rest = max(margin[m] for m in range(families) if m != best)
        sure = 1 / (1 + math.exp(-1.5 * (margin[best] - rest)))
    members = model.languages[model.families[best]]
    wins, weight = dict.fromkeys(members, 0), dict.fromkeys(members, 0.0)
    for m, (a, b) in enumerate(model.pairs, families):
        if a in wins:
            wins[a if margin[m] > 0 else b] += 1
            weight[a] += margin[m]
            weight[b] -= margin[m]
    order = sorted(members, key=lambda v: (-wins[v], -weight[v], v))
    inner = 1.0 if len(order) < 2 else 1 / (1 + math.exp(-3 * (weight[order[0]] - weight[order[1]]) / max(len(members), 2)))
    return order[0], sure * inner


def test_language_decisions_by_hand(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = language.fit_language(docs)
    assert len(model.families) > 1 and model.pairs
    texts = [r["text"][:4000] for r in docs.limit(60).collect()] + [None, "", "12 !", "é", "Straße und Häuser", "el niño come pan"]
    langs, scores = model.predict(texts)
    want = [plain_prediction(model, t) for t in texts]
    assert langs == [w[0] for w in want] and scores.tolist() == pytest.approx([w[1] for w in want], abs=1e-5)
    assert [model.predict([t])[1][0] for t in texts] == pytest.approx(scores.tolist(), abs=1e-9)  # alone as among others


def test_machine_separates_as_a_dense_solver():
    """The dual ascent against projected gradient on the same dual, without hashing or sampling."""
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0.5, 1, (40, 6)), rng.normal(-0.5, 1, (60, 6))])
    y = np.array([1.0] * 40 + [-1.0] * 60)
    gram = x @ x.T + 1
    limit = np.where(y > 0, 2.0 / 40, 2.0 / 60) * 50
    alpha = np.zeros(100)
    step = 1 / np.linalg.eigvalsh(gram).max()
    for _ in range(60_000):
        alpha = np.clip(alpha + step * (1 - y * (gram @ (alpha * y))), 0, limit)
    got = language._machine(gram, y, cost=2.0, rounds=3000)
    assert gram @ got == pytest.approx(gram @ (alpha * y), abs=2e-2)


def test_predictions_take_the_place_of_columns(spark):
    docs = spark.createDataFrame([(1, "ein Haus und ein Baum", "de", "x", 5), (2, "the house and the tree", "en", "y", 6)], "doc_id bigint, text string, lang string, lang_pred string, score int")
    out = language.predict_language(docs, language.fit_language(docs))
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score"] and dict(out.dtypes)["score"] == "double" and out.count() == 2


def pivotal(items):
    """Fractions rounded one after the other: of two, one hands mass to the other until one of them is whole."""
    snap = lambda v: 0.0 if v < mixing.EPS else 1.0 if v > 1 - mixing.EPS else v
    out, held = {}, None
    for item in items:
        if held is None:
            held = dict(item)
            continue
        new = dict(item)
        ratio = held["size"] / new["size"]
        up = min(1 - new["x"], held["x"] * ratio)  # what the new one can take
        down = min(new["x"], (1 - held["x"]) * ratio)  # what it can give
        gain = 0.0 if up + down <= 0 else up if new["draw"] * (up + down) < down else -down
        held["x"], new["x"] = snap(held["x"] - gain * new["size"] / held["size"]), snap(new["x"] + gain)
        if held["x"] in (0.0, 1.0):
            out[held["doc_id"]] = held["x"]
            held = new
        else:
            out[new["doc_id"]] = new["x"]
    return out, (held["doc_id"], held["x"])


def test_rounding_by_hand(spark):
    rng = random.Random(12)
    groups = [[{"draw": rng.random(), "x": rng.choice([0.5, 0.25, rng.uniform(0.01, 0.99)]), "size": float(rng.randrange(1, 90)), "doc_id": 100 * g + k} for k in range(rng.randrange(1, 40))] for g in range(40)]
    rows = [(g, [(i["draw"], i["x"], i["size"], i["doc_id"], 1, 0, 9, 1.0) for i in items]) for g, items in enumerate(groups)]
    kind = "array<struct<draw:double,x:double,size:double,doc_id:bigint,nth:bigint,whole:bigint,source_size:bigint,target:double>>"
    frame = spark.createDataFrame(rows, f"g int, items {kind}")
    for row in frame.select("g", mixing._reduce(F.col("items")).alias("r")).collect():
        done, last = pivotal(groups[row["g"]])
        assert {i["doc_id"]: i["x"] for i in row["r"]["done"]} == pytest.approx(done) and (row["r"]["held"]["doc_id"], row["r"]["held"]["x"]) == pytest.approx(last)
        assert set(done.values()) <= {0.0, 1.0}
        before, after = (sum(i["x"] * i["size"] for i in groups[row["g"]]), sum(i["x"] * i["size"] for i in [*row["r"]["done"], row["r"]["held"]]))
        assert after == pytest.approx(before, abs=1e-5)


def test_shards_of_a_table_with_the_shard_column(spark, tmp_path):
    docs = spark.createDataFrame([(k, "some text " * 30, "mine") for k in range(40)], "doc_id bigint, text string, shard_name string")
    extendible.write_shards(docs, str(tmp_path / "out"), 2000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 40 and {r["shard_name"] for r in back.collect()} == {"mine"} and "shard_name_" in back.columns
