"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator
and every pipeline stage."""

import hashlib
from collections import Counter

import corpus_pipeline
import pytest
from helixframe.llm import bpe, decontam, html_main, langid, license, linededup, neardup, quality, substring, toxicity
from pyspark.sql import functions as F

LONG = " ".join(f"w{k * 7919 % 1_000_003}x" for k in range(150_000))
ITEM = "A train leaves the old station at noon and Alice waits 12 minutes for the second train to arrive from the far coast."
ROWS = [
    (1, "plain words of a first line here\nReleased under the MIT License.", "en"),
    (2, None, None),
    (3, "", "en"),
    (4, " \n\t\n ", "fr"),
    (5, LONG, "en"),
    (6, f"he said that {ITEM} and went on", "en"),
    (7, "\x00 \U0001f600 é ü\n\n123 !", None),
    (None, "a text without an id that has some words", "en"),
    (8, "one line", None),
    (8, "one line", None),
    (9, LONG[: 40_000].replace(" ", ""), "en"),
]
CLASHES = ["bucket", "cls", "_own", "_cls", "_keep", "_row", "_rid", "_gone", "_doc", "_n_lines", "_n_removed", "label", "score", "kept", "start", "n", "_id", "_y", "h", "id"]


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.createDataFrame([(i, t, c, "s", len(t or "")) for i, t, c in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    return docs.select("*", *[F.lit("x").alias(c) for c in CLASHES]).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, 1), (6, 1, 1), (None, 1, 1), (8, None, None), (9, 0, 0)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))


def ids(rows):
    return Counter(r.doc_id for r in rows)


WANT = Counter(i for i, _, _ in ROWS)


def test_scorers(spark, odd, labels):
    for out in (quality.quality_rules(odd, labels), toxicity.toxicity(odd, labels), langid.language_id(odd)):
        rows = out.collect()
        assert ids(rows) == WANT
    assert {r.doc_id: r.lang_pred for r in rows}[2] == "und"
    for out in (quality.quality_rules(odd.limit(0), labels), toxicity.toxicity(odd.limit(0), labels.limit(0)), langid.language_id(odd.limit(0)), license.license_scan(odd.limit(0))):
        assert out.count() == 0
    assert {(r.doc_id, r.license_id) for r in license.license_scan(odd).collect()} == {(1, "MIT")}


def test_html(spark):
    page = "<body><article><p>" + "word " * 400_000 + "</p></article>"
    pages = spark.createDataFrame([(1, "u", page, "t"), (1, "u", page, "t"), (2, None, None, None), (None, "u", "<p>x", "t"), (3, "u", "", "t")], "page_id long, url string, html string, text string")
    rows = html_main.main_text(pages).collect()
    assert Counter((r.page_id, r.n_chars) for r in rows) == Counter({(1, 1_999_999): 2, (2, 0): 1, (None, 1): 1, (3, 0): 1})
    assert html_main.main_text(pages.limit(0)).count() == 0


def test_decontamination(spark, odd):
    bench = spark.createDataFrame([(7, ITEM, "x"), (8, None, "x"), (None, ITEM, "x")], "item_id long, text string, doc_id string")
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(odd, bench).collect()} == {(6, 7)}
    left = decontam.drop_leaks(odd, bench)
    assert left.columns == odd.columns and ids(left.collect()) == WANT - Counter([6])
    assert decontam.leaks(odd.limit(0), bench).count() == decontam.leaks(odd, bench.limit(0)).count() == 0


def test_line_dedup(spark, odd):
    out = linededup.dedup_lines(odd)
    assert out.columns[: len(odd.columns)] == odd.columns and linededup.counters(odd.columns) == ("__n_lines", "__n_removed")
    rows = out.collect()
    assert ids(rows) == WANT and all(r["_n_lines"] == r["bucket"] == "x" for r in rows)
    text = {r.doc_id: r.text for r in rows}
    assert text[2] is None and text[3] == "" and text[5] == LONG and [r.text for r in rows if r.doc_id == 8] == ["one line"] * 2


def test_near_duplicates(spark, odd):
    rows = neardup.near_duplicates(odd).collect()
    assert ids(rows) == WANT and all(r.class_id == r.doc_id for r in rows)
    kept = neardup.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and ids(kept.collect()) == Counter(set(WANT))


def test_bpe(spark, odd):
    tok = pytest.importorskip("public_tokenizers")
    path = tok.path("byte_bpe_50k.tiktoken")
    rows = bpe.bpe_round_trip(odd, path, tok.PATTERN).collect()
    sha = {(i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in ROWS}
    assert ids(rows) == WANT and {(r.doc_id, r.decoded_sha256) for r in rows} == sha
    assert bpe.bpe_round_trip(odd.limit(0), path, tok.PATTERN).count() == 0


def test_substring(spark, odd):
    rows = substring.digest_repeats(odd).collect()
    assert ids(rows) == WANT and {r.doc_id: r.n_words for r in rows}[5] == 150_000 and all(r.n_removed == 0 for r in rows)
    twice = substring.digest_repeats(odd.unionByName(odd.where("doc_id = 5").withColumn("doc_id", F.lit(50).cast("long")))).where("doc_id in (5, 50)").collect()
    assert {r.doc_id: r.n_removed for r in twice} == {5: 0, 50: 150_000}


def test_pipeline_stages(spark, odd, labels, tmp_path):
    """Every stage on the odd table and on an empty one, against what each must leave."""
    bench = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    labels.drop("text").write.parquet(f"{tmp_path}/labels.parquet")
    left = {"toxicity": WANT, "line_dedup": WANT, "near_dedup": Counter(set(WANT)), "decontamination": WANT - Counter([6]), "bpe": WANT}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, str(tmp_path))
        assert name == "bpe" or out.columns == odd.columns
        if name != "toxicity":  # six labelled rows teach nothing
            assert ids(out.collect()) == left[name], name
        assert stage(spark, odd.limit(0), str(tmp_path)).count() == 0
