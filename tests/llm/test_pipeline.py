"""The pipeline's stages on a small corpus, each against what it must do."""

import random

import corpus_pipeline
import public_tokenizers
import sentencepiece
from maskwright.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(0)
    words = {"en": [a + b for a in ("th", "wi", "fr", "an") for b in ("e", "th", "om", "d", "at")], "de": [a + b for a in ("de", "mi", "vo", "un") for b in ("r", "t", "n", "d", "ss")]}
    rows = []
    for i in range(120):
        lang = "de" if i % 3 == 0 else "en"
        rows.append((i, " ".join(rng.choices(words[lang], k=80)), lang, f"s{i % 4}", 0))
    rows += [(200 + i, rows[i][1], rows[i][2], "s0", 0) for i in range(5)]
    rows += [(300, "жзик лмно " * 30, None, "s1", 0), (301, None, "en", "s1", 0), (302, rows[7][1][:200] + " password=abcdef123456XYZ", "en", "s2", 0)]
    return rows


def test_stages_and_run(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    seen, given = {}, docs
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, given, str(tmp_path)).write.parquet(f"{tmp_path}/{number}")
        given = spark.read.parquet(f"{tmp_path}/{number}")
        seen[name] = given
        if number < len(corpus_pipeline.STAGES) - 1:
            assert given.columns == docs.columns
    ids = {name: sorted(r["doc_id"] for r in df.collect()) for name, df in seen.items()}
    assert set(ids["language ID"]) == {r[0] for r in rows} - {300, 301}
    assert not {200, 201, 202, 203, 204} & set(ids["SimHash near-dedup"]) and set(range(5)) <= set(ids["SimHash near-dedup"])
    masked = {r["doc_id"]: r for r in seen["secret scans"].collect()}
    assert "abcdef123456XYZ" not in masked[302]["text"] and masked[302]["n_chars"] == len(masked[302]["text"])
    taken = {r["doc_id"]: r["copies"] for r in mixing.mix(seen["secret scans"]).collect()}
    assert ids["mixing sources"] == sorted(i for i, n in taken.items() for _ in range(n))
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert all(r["n_tokens"] == len(model.encode(masked[r["doc_id"]]["text"])) for r in seen["SentencePiece"].collect())
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, seen["SentencePiece"].collect()))


def test_stages_with_null_and_repeated_ids_and_clashing_names(spark, tmp_path):
    rng = random.Random(9)
    words = [a + b for a in ("th", "wi", "fr", "an") for b in ("e", "th", "om", "d", "at")]
    text = lambda n=60: " ".join(rng.choices(words, k=n))
    rows = [(i, text(), "en", f"s{i % 3}", 0) for i in range(60)]
    alike = text(200)
    rows += [(None, alike, "en", "s0", 0), (None, alike + " and", "en", "s1", 0), (None, "token=abcdefghijklmnop " + text(), "en", None, 0)]
    rows += [(70, text(), "en", "s1", 0), (70, text(), "en", "s1", 0), (71, rows[5][1], "en", "s0", 0), (72, text(30_000), "en", "s2", 0), (72, None, "en", "s2", 0), (73, "", None, None, 0)]
    extra = "_own0 string, _OWN1 string, fp int, h int, lang_pred string, spans string, copies int, key string, bytes string"
    docs = spark.createDataFrame([(*r, "a", "b", 1, 2, "c", "d", 3, "e", "f") for r in rows], f"{SCHEMA}, {extra}").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    given, kept = docs, {}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, given, str(tmp_path)).write.parquet(f"{tmp_path}/{number}")
        given = spark.read.parquet(f"{tmp_path}/{number}")
        kept[name] = given.collect()
        assert number == 4 or given.columns == docs.columns
    near = kept["SimHash near-dedup"]
    assert len(kept["language ID"]) == len(rows) - 2 and len(near) == len(rows) - 4
    assert sum(r["doc_id"] == 70 for r in near) == 2 and not any(r["doc_id"] == 71 for r in near)
    assert sum(r["text"].startswith(alike) for r in near) == 1
    masked = kept["secret scans"]
    assert len(masked) == len(near) and not any("abcdefghijklmnop" in r["text"] for r in masked)
    assert len(next(r for r in masked if r["doc_id"] == 72)["text"].split()) == 30_000
    assert len(kept["SentencePiece"]) == len(kept["mixing sources"])


def test_stages_take_an_empty_table(spark, tmp_path):
    given = spark.createDataFrame([], SCHEMA)
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, given, str(tmp_path)).write.parquet(f"{tmp_path}/{number}")
        given = spark.read.parquet(f"{tmp_path}/{number}")
    assert given.count() == 0
