"""Sources, sinks, settings and the whole plan on small inputs."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from segmenta import cli
from segmenta.operators import retrieval
from segmenta.plans import config
from segmenta.plans.annotate import annotate
from segmenta.sinks import transcripts
from segmenta.sources import corpora, segments
from segmenta.streaming import ingest

VERSES = [{"id": 1, "name": "One", "verses": [{"id": 1, "text": "إنا أعطيناك الكوثر فصل لربك وانحر"}, {"id": 2, "text": "قل هو الله أحد الله الصمد"}]}, {"id": 2, "verses": [{"id": 1, "text": "قل هو الله أحد الله الصمد"}, {"id": 2, "text": None}]}]


@pytest.fixture()
def verse_file(tmp_path):
    path = tmp_path / "verses.json"
    path.write_text(json.dumps(VERSES, ensure_ascii=False), encoding="utf-8")
    return str(path)


def test_verses(spark, verse_file):
    rows = [tuple(r) for r in corpora.read_verses(spark, verse_file).select("idx", "surah_id", "surah_name", "ayah_id", "text").orderBy("idx").collect()]
    assert [r[:4] for r in rows] == [(0, 1, "One", 1), (1, 1, "One", 2), (2, 2, "Surah 2", 1), (3, 2, "Surah 2", 2)]
    assert rows[3][4] == ""


def test_chapters_from_lines(spark):
    lines = spark.createDataFrame([("# note",), ("",), ("1|2|b|c",), ("1|1|a",), ("2|1",), ("3|1|z",)], "value string")
    out = [(r["id"], r["name"], [(v["id"], v["text"]) for v in r["verses"]]) for r in corpora.chapters_of(lines).orderBy("id").collect()]
    assert out == [(1, "Surah 1", [(1, "a"), (2, "b|c")]), (3, "Surah 3", [(1, "z")])]


def test_narrations(spark, tmp_path):
    path = tmp_path / "n.csv"
    long = "حدثنا عبد الله بن يوسف"
    path.write_text(f'id,hadith_id,source,chapter_no,hadith_no,chapter,chain_indx,text_ar,text_en\n1,7, Sahih Bukhari ,1,1,c,x,{long},"first, ""one"""\n2,8,Sahih Bukhari,1,1,c,x,{long} ب,second\n3,,Other,1,2,c,x,{long},third\n4,zz,Other,1,3,c,x,{long},fourth\n5,1,Other,1,4,c,x,قصير,short\n', encoding="utf-8")
    rows = corpora.read_narrations(spark, str(path)).orderBy("collection", "hadith_no").collect()
    assert [(r["collection"], r["hadith_no"], r["hadith_id"], r["text_en"]) for r in rows] == [("bukhari", "1", 7, 'first, "one"'), ("other", "2", 0, "third")]


def test_recordings_and_recogniser(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(b"x" * 2000)
    (tmp_path / "b.txt").write_bytes(b"x" * 2000)
    (tmp_path / "c.mp3").write_bytes(b"x" * 10)
    found = {r["path"][-5:]: (r["problem"], r["warning"]) for r in segments.recordings(spark, str(tmp_path), duration=lambda b: 99999.0 if b[:1] == b"y" else 5.0).collect()}
    assert found == {"a.wav": (None, None), "b.txt": (None, "unknown ending"), "c.mp3": ("empty", None)}

    def fake(batches):
        for b in batches:
            for f in b["file_id"]:
                yield pd.DataFrame([{"file_id": f, "seq": 0, "prompt_safe": False, "retry_triggered": False, "language": "ur", "original_text": "", "start": -1.0, "end": -1.0, "text": " hi ", "words": [{"word": "hi", "start": 0.0, "end": 0.1, "probability": 0.5}]}], columns=["file_id", "seq", "start", "end", "text", "language", "language_probability", "avg_logprob", "words", "no_speech_prob", "avg_word_confidence", "compression_ratio", "mixed_script_ratio", "repeated_ngram_score", "prompt_safe", "retry_triggered", "retry_reason", "original_text", "confidence_delta"]).assign(retry_reason=[[]])

    row = segments.recognised(spark.createDataFrame([("f",)], "file_id string"), fake).first()
    assert (row["start"], row["end"], row["text"], row["avg_word_confidence"], row["retry_reason"]) == (0.0, 0.05, "hi", 0.5, [])


def test_settings(monkeypatch):
    assert config.settings("urdu-bayan").beam_size == 8 and config.settings("urdu-bayan", beam_size=3).beam_size == 3
    monkeypatch.setenv("SEGMENTA_BEAM_SIZE", "4")
    monkeypatch.setenv("SEGMENTA_NO_HADITH", "true")
    assert config.from_environment().beam_size == 4 and config.from_environment().no_hadith
    with pytest.raises(ValueError):
        config.settings(nonsense=1)


def lecture(spark):
    word = lambda p: [{"word": "w", "start": 0.0, "end": 0.1, "probability": p}]
    texts = [
        ("قل هو الله أحد الله الصمد", 0.9), ("إنا أعطيناك الكوثر فصل لربك وانحر", 0.9), ("سبحان الله وبحمده سبحان الله العظيم", 0.9),
        ("this is plain English speech", 0.9), ("Thanks for watching", 0.9), ("كلام عربي طويل ليس من المصادر كلها ابدا", 0.1), ("كلام عربي طويل ليس من المصادر كلها ابدا حقا", 0.9),
    ]
    rows = [("f", i, 10.0 * i, 10.0 * i + 4, t, 0.95, -0.2, word(p), p) for i, (t, p) in enumerate(texts)]
    df = spark.createDataFrame(rows, f"file_id string, seq long, start double, end double, text string, language_probability double, avg_logprob double, words array<{segments.WORD}>, avg_word_confidence double")
    return segments.completed(df)


def test_annotation_and_sinks(spark, verse_file, tmp_path):
    verses = corpora.read_verses(spark, verse_file)
    out = annotate(lecture(spark), verses)
    rows = {r["seq"]: r for r in out.collect()}
    assert set(rows) == {0, 1, 2, 3, 5, 6}
    assert rows[0]["quran_match"]["is_ambiguous"] and rows[0]["quran_match"]["ambiguous_count"] == 2 and [r["surah_id"] for r in rows[0]["quran_match"]["alternate_refs"]] == [1, 2]
    assert rows[1]["quran_match"]["is_exact"] and (rows[1]["quran_match"]["surah_id"], rows[1]["quran_match"]["ayah_id"]) == (1, 1)
    assert rows[2]["formula_match"]["label"].startswith("Tasbih") and rows[3]["route"] == "none"
    assert rows[5]["flag_reason"].startswith("Low confidence Arabic (avg=0.10)") and rows[6]["flag_reason"] == "Hadith matching disabled; no Quran match"
    txt = transcripts.txt(out).first()["content"]
    assert "[00:00:10] [AR] إنا أعطيناك الكوثر فصل لربك وانحر\n           ↳ 📖 Quran 1:1 — One ✓exact (100%)" in txt
    assert "Quran [ambiguous — 2 ayahs] (90%) possible: 1:2, 2:1" in txt and "⚠ [unverified — see flagged.txt]" in txt
    assert "[QURAN 1:1]" in transcripts.srt(out).first()["content"]
    assert len(json.loads(transcripts.json_array(out).first()["content"])) == 6
    assert transcripts.flagged(out).first()["content"].count("Verified:") == 3
    assert transcripts.diagnostics(out).where("is_flagged").count() == 2
    lecture(spark).write.parquet(f"{tmp_path}/in")
    assert cli.main([f"{tmp_path}/in", verse_file, f"{tmp_path}/out"]) == 0
    assert spark.read.parquet(f"{tmp_path}/out/segments").count() == 6


def test_narration_search(spark):
    told = ["إنما الأعمال بالنيات وإنما لكل امرئ ما نوى فمن كانت هجرته", "من حسن إسلام المرء تركه ما لا يعنيه في كل حال", "لا يؤمن أحدكم حتى يحب لأخيه ما يحب لنفسه دائما"]
    from segmenta.functions import plain

    corpus = spark.createDataFrame([(i, plain.canonical(t)) for i, t in enumerate(told)], "idx long, canon string")
    asked = spark.createDataFrame([(0, plain.canonical("انما الاعمال بالنيات وانما لكل امرئ ما نوي فمن كانت")), (1, "قصير"), (2, plain.canonical("جملة لا علاقة لها بما سبق ابدا ابدا"))], "qid int, query string")
    found = retrieval.match_narrations(asked, corpus).collect()
    assert [(r["qid"], r["idx"]) for r in found] == [(0, 0)] and 0.8 < found[0]["confidence"] <= 1


def test_stream_equals_batch(spark, tmp_path):
    rows = [("f", i, t) for i, t in enumerate(["Thanks for watching", "real words here", "...", "www.x.org", "بسم الله"])]
    spark.createDataFrame(rows, "file_id string, seq long, text string").write.json(f"{tmp_path}/in")
    source = spark.readStream.schema("file_id string, seq long, text string").json(f"{tmp_path}/in")
    run = ingest.cleaned_stream(source).writeStream.format("memory").queryName("cleaned").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    run.awaitTermination(120)
    assert sorted((r["seq"], r["detected_lang"]) for r in spark.table("cleaned").collect()) == [(1, "en"), (4, "ar")]
    timed = spark.createDataFrame(rows, "file_id string, seq long, text string").withColumn("ts", F.timestamp_seconds(F.col("seq") * 60)).withColumn("detected_lang", F.lit("en"))
    assert sum(r["segments"] for r in ingest.language_counts(timed).collect()) == 5
    assert ingest.quiet_sessions(timed).count() == 5
