import corpus_pipeline
from helpers import DATA
from test_simhash import alike, shingles

from spandrel.llm import decontamination, secret_scan

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_on_driver_tables(spark, tmp_path):
    sf = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "secret_scans", "best_fit_packing"]
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == COLUMNS
        kept.append({r.doc_id: r.text for r in docs.collect()})
    quality, unique, clean, safe = kept
    assert 0.5 * 200 < len(quality) <= 200
    # Brute force over all pairs: one document of each class, and none of a class lost.
    sets = {i: shingles(t) for i, t in quality.items()}
    best = {i: i for i in quality}
    for _ in range(6):
        for a in quality:
            best[a] = min([best[a], *(best[b] for b in quality if alike(sets[a], sets[b]))])
    assert set(unique) == {i for i in quality if best[i] == i}
    items = [r.text.lower().split() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]

    def leaks(text):
        w = text.lower().split()
        return any(sum(a == b for a, b in zip(w[i : i + 13], x[j : j + 13], strict=False)) == 13 for x in items for i in range(len(w) - 12) for j in range(len(x) - 12) if w[i] == x[j])

    assert set(clean) == {i for i, t in unique.items() if not leaks(t)}
    assert set(safe) == set(clean)
    for i, text in safe.items():
        assert not any(secret_scan.find_secrets(text)[0]) and (text == clean[i] or secret_scan.REDACTED in text)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in packed} == set(safe)
    assert sum(r.size for r in packed) == sum(len(t.encode().split()) for t in safe.values())


def test_run_gives_the_same_rows(spark):
    sf = f"{DATA}/sf0.001"
    a, b = ({(r.doc_id, r.piece, r.bin, r.start) for r in corpus_pipeline.run(spark, sf).collect()} for _ in range(2))
    assert a == b and a


def test_stages_take_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "x y", None, None, 3), (3, "a " * 40_000, "en", "s", 80_000), (3, "a " * 40_000, "en", "s", 80_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    sf = f"{DATA}/sf0.001"
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, frame, sf).count() <= len(rows)
        packed = corpus_pipeline.STAGES[-1][1](spark, frame, sf)
        assert packed.select("doc_id").distinct().count() == frame.select("doc_id").distinct().count()


def test_decontamination_threshold_is_the_pipelines():
    assert decontamination.WINDOW == 13
