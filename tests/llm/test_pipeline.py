"""The pipeline's five stages on a small table, against plain Python."""

import re


def test_pipeline_against_plain_python(spark, tmp_path):
    import corpus_pipeline
    from revloom.llm import bpe
    from revloom.llm.queries import vocabulary

    clean = {i: " ".join(f"w{i}x{j}" for j in range(40)) + " good clean text" for i in range(0, 120)}
    toxic = {i: "bad idiot text " * 5 + f"word{i}" for i in range(200, 240)}
    copies = {i: clean[i - 300].replace(f"w{i - 300}x1 ", f"w{i - 300}x1 ", 1) + ("" if i % 2 else " end") for i in range(300, 320)}
    secret = {400: clean[5].replace("w5", "v5") + " token = abcdef123456", 401: None, 402: ""}
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in (clean | toxic | copies | secret).items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, int(i >= 200)) for i in [*range(0, 100), *range(200, 240)]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept, docs = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs.write.mode("overwrite").parquet(at := f"{tmp_path}/{name}")
        docs = stage(spark, spark.read.parquet(at), str(tmp_path))
        kept[name] = docs.collect()
        if name != "bpe":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {n: {r.doc_id for r in rows} for n, rows in kept.items()}
    assert ids["toxicity"] == set(clean) | set(copies) | set(secret)
    assert ids["near_dedup"] == set(clean) | set(secret)  # a copy goes, the smaller id stays
    assert ids["secrets"] == ids["near_dedup"]
    texts = {r.doc_id: r.text for r in kept["secrets"]}
    assert texts[400].endswith("token = [SECRET]") and all(texts[i] == clean[i] for i in clean) and texts[401] is None
    words = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in kept["secrets"]}
    taken = {}
    for r in kept["mixing"]:
        taken[r.doc_id] = taken.get(r.doc_id, 0) + 1
    assert all(n <= 3 for n in taken.values()) and set(taken) <= set(words)
    total, share = sum(words.values()), {}
    for i, n in taken.items():
        share[i % 3] = share.get(i % 3, 0) + n * words[i]
    sizes = {s: sum(n for i, n in words.items() if i % 3 == s) for s in range(3)}
    want = {0: min(3 * sizes[0], total * 5 / 8), 1: total * 2 / 8, 2: total / 8}
    assert all(abs(share[s] - want[s]) <= 90 for s in range(3))
    own = bpe.load(vocabulary())
    mixed = sorted((r.doc_id, own.encode(r.text or "")) for r in kept["mixing"])
    assert sorted((r.doc_id, list(r.ids)) for r in kept["bpe"]) == mixed
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(r.doc_id for r in kept["bpe"])
