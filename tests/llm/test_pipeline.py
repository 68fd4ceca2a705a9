"""The pipeline, stage by stage, against brute force on a small corpus."""

from __future__ import annotations

import random

import corpus_pipeline as P
import sentencepiece

from kvlake.llm import sentence_pieces, toxicity

from .test_minhash import brute as near_brute
from .test_mixing import brute as mix_brute


def corpus() -> tuple[list[tuple], list[tuple]]:
    r = random.Random(5)
    vocabulary = [f"word{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(260):
        kind = r.random()
        if kind < 0.15 and docs:
            text = r.choice(docs)[1]
        elif kind < 0.35 and docs:
            w = (r.choice(docs)[1] or "").split(" ")
            w[r.randrange(len(w))] = r.choice(vocabulary)
            text = " ".join(w)
        else:
            w = [r.choice(vocabulary) for _ in range(r.randrange(5, 120))]
            if r.random() < 0.25:
                for _ in range(3):
                    w.insert(r.randrange(len(w)), r.choice(("idiotic", "moronic")))
            text = " ".join(w)
        docs.append((i, text, r.choice(("en", "de")), r.choice(("src0", "src0", "src1", "src9")), len(text)))
        labels.append((i, 1, int("idiotic" in text or "moronic" in text)))
    docs += [(1000, None, None, None, None), (1001, "", "en", "src0", 0)]
    return docs, labels


def test_stages(spark, tmp_path):
    docs, labels = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    seen = {}
    df = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = df.columns
    for i, (name, stage) in enumerate(P.STAGES):
        stage(spark, df, str(tmp_path)).write.parquet(str(tmp_path / f"out{i}"))
        df = spark.read.parquet(str(tmp_path / f"out{i}"))
        assert i == 4 or df.columns == columns
        seen[name] = df.collect()
    rows = {n: {x.doc_id: x for x in found} for n, found in seen.items()}
    assert all(len(rows[n]) == len(seen[n]) for n in rows)

    bad = {d for d, _, y in labels if y}
    kept = set(rows["toxicity"])
    # A few dozen toxic rows to learn from: some held-out ones pass.
    assert len(kept & bad) <= 0.1 * len(bad) and len({d[0] for d in docs} - bad - kept) == 0

    texts = {d: rows["toxicity"][d].text or "" for d in kept}
    last = {}
    for d in sorted(texts):
        last[texts[d]] = d
    assert set(rows["exact_dedup"]) == set(last.values())

    near = near_brute([(d, x.text) for d, x in rows["exact_dedup"].items()], 5)
    assert set(rows["near_dedup"]) == {d for d, (_, _, stays) in near.items() if stays}

    mixed = mix_brute([(d, x.text, x.lang, x.source) for d, x in rows["near_dedup"].items()], P.MIX)
    assert set(rows["mixing"]) == {d for d, _ in mixed}

    library = sentencepiece.SentencePieceProcessor(model_proto=sentence_pieces.read_model())
    for d, x in rows["sentence_pieces"].items():
        assert x.ids == library.encode(rows["mixing"][d].text or "") and x.n_tokens == len(x.ids) and x.round_trip
    assert set(rows["sentence_pieces"]) == set(rows["mixing"])

    whole = P.run(spark, str(tmp_path)).collect()
    assert sorted(map(str, whole)) == sorted(map(str, seen["sentence_pieces"]))
    assert toxicity.Settings().threshold == 0.7


def test_mixing_takes_rows_without_an_id(spark):
    rows = [(None, f"a {i}", "en", "src1", 3) for i in range(10)] + [(None, None, "de", "src2", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = P.mixing_stage(spark, df, "").collect()
    assert len(set(got)) == 7 and set(map(tuple, got)) < set(rows) and rows[-1] in set(map(tuple, got))
