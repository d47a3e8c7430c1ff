"""The pipeline's near_dedup searches by the Golay keys, and shingles decide on what they link."""

from overscribe.llm import golay


def test_golay_keys_are_among_the_candidates(spark):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join(words[:-1] + ["other"]), " ".join(reversed(words)), " ".join(words[:200]) + " " + " ".join(words[:200])]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate([*texts, texts[0], None, " "])], "doc_id long, text string, lang string, source string, n_chars long")
    rows = golay.shingle_sets(df, 5)
    of = {r.doc_id: r.set for r in rows.collect()}
    fps = {r.doc_id: r.fp for r in golay.fingerprints(df).collect()}
    got = {tuple(sorted(map(bytes, r))) for r in golay.golay_pairs(df, rows).collect()}
    want = {tuple(sorted((bytes(of[i]), bytes(of[j])))) for i in range(4) for j in range(i) if bin((fps[i] ^ fps[j]) & (1 << 64) - 1).count("1") <= 2}
    assert got == want and want
    assert {r.doc_id for r in golay.keep_one(df).collect()} == {0, 2, 3, 5}
