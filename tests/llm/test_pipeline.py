"""The pipeline's stages against brute force, each on what the one before kept."""

import random
from collections import Counter

import public_tokenizers
import pytest
from test_operators import BASE, brute_base, brute_components, brute_fp, brute_kept

import corpus_pipeline
from graphweft.llm import pii, quality
from graphweft.llm.tokens import CachedTokenizer


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    words = [a + b for a in ("ka", "lo", "mi", "nu", "pe") for b in ("ra", "sto", "ven", "xi", "dol")]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(d, text(rng.randint(12, 120)), "en") for d in range(60)]
    rows += [(60 + k, rows[k][1], "en") for k in range(5)]  # copies
    rows += [(70 + k, f"{text(30)} {' '.join(BASE)} {text(30)}", "en") for k in range(4)]  # a passage
    rows += [(80, text(40) + " mail ann@mail.example.com and +1 (555) 123-4567", "en"), (81, "%%% ### " * 30, "en"), (82, None, "fr"), (83, "", "fr"), (84, "same " * 50, "en"), (None, text(25), "en"), (85, text(20000), None)]
    at = tmp_path_factory.mktemp("tables")
    frame = spark.createDataFrame([(d, t, lang, f"s{d}", len(t or ""), 7) for d, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long, score int")
    frame.repartition(2).write.parquet(f"{at}/documents.parquet")
    labels = [(d, 0 if "%%%" in (t or "") else 1, 0) for d, t, _ in rows if d is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in docs.collect()]
        out = stage(spark, docs, folder)
        out.write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert after.columns == docs.columns
        got = Counter(tuple(r) for r in after.collect())
        if k == 0:
            verdict = {(r["doc_id"]): r["kept"] for r in quality.judge(docs, labels).collect()}
            assert got == Counter(r for r in before if verdict[r[0]])
            assert not {81, 82, 83, 84} & {r[0] for r in got} and len(got) >= 68
        elif k == 1:
            fps = {r[0]: brute_fp(r[1]) for r in before}
            part = brute_components(set(fps.values()), 4)
            least = {}
            for d, f in fps.items():
                if d is not None:
                    least[part[f]] = min(d, least.get(part[f], d))
            assert got == Counter(r for r in before if r[0] is None or r[0] == least[part[fps[r[0]]]])
            assert not {60, 61, 62, 63, 64} & {r[0] for r in got}
        elif k == 2:
            want = Counter((d, tuple(text.split())) for d, _, _, text in brute_kept([r[:2] for r in before]))
            assert Counter((r[0], tuple(r[1].split())) for r in after.collect()) == want
            assert sum(" ".join(BASE) in r[1] for r in after.collect()) == 1
            assert all(r["n_chars"] == len(r["text"]) for r in after.collect())
        elif k == 3:
            assert all(not brute_base(r[1]) for r in got)
            assert {r[0]: r[1] for r in got} == {r[0]: pii.redacted(r[1], pii.find_spans(r[1])) for r in before}
        else:
            coder = CachedTokenizer(public_tokenizers.path("byte_bpe_50k.json"), False)
            want = {r[0]: len(raw) // 4 + 1 for r, raw in zip(before, coder.encode([r[1] for r in before]), strict=True)}
            total = Counter()
            for r in after.collect():
                total[r["doc_id"]] += r["length"]
            assert total == want
        docs = after


def test_run(spark, folder):
    found = corpus_pipeline.run(spark, folder)
    assert found.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert found.count() > 60
    assert len(corpus_pipeline.STAGES) == 5
