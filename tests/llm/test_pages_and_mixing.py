"""Pages that browsers read in their own way, and mixing beside columns with clashing names."""

from __future__ import annotations

import pytest

import corpus_pipeline
from strayfield.llm import html_extract, minhash, mixing

TEXT = "The river was high and the old bridge of the town had been closed since the night, so the people went by boat to the market. " * 3
WHOLE = " ".join(TEXT.split())


@pytest.mark.parametrize(
    "page, want",
    [
        (f'<body><form id="aspnetForm"><input type="hidden" name="state"><input name="q"><article><p>{TEXT}</p></article></form></body>', WHOLE),
        (f'<body><form id="aspnetForm"><input name="q"><div><p>{TEXT}</p><p>{TEXT}</p></div></form></body>', f"{WHOLE} {WHOLE}"),
        (f"<article><p>{TEXT}</p><form><p>Write to us, and we will be with you as soon as it is our turn.</p><input name=a><textarea></textarea></form></article>", WHOLE),
        (f"<div><p>{TEXT}</p></div><form><p>Write to us, and we will be with you as soon as it is our turn.</p><input name=a>", WHOLE),
        (f'<div class="page ad-free"><p>{TEXT}</p></div>', WHOLE),
        (f'<div class="page"><p>{TEXT}</p></div><div class="ad-box"><p>{TEXT}</p></div>', WHOLE),
        (f"<article><!--><p>{TEXT}</p></article>", WHOLE),
        (f"<article><!---><p>{TEXT}</p><!-- gone > --!></article>", WHOLE),
        (f'<article><p>{TEXT}</p><script src="a.js"/>alert(1); var x = 2;</script></article>', WHOLE),
        (f"<article><style type=text/css/>p {{color:red}}</style><p>{TEXT}</p></article>", WHOLE),
        (f"<div><p>{TEXT}</p></div><div>" + "".join(f"<a href=http://x.com/>Read the news of the day and more of it in number {i}</a> " for i in range(10)) + "</div>", WHOLE),
        (f"<div><p>{TEXT}</p></div><nav/>Home and About", WHOLE),
        (f'<div><a name="top"/><p>{TEXT}</p></div>', WHOLE),
        (f"<article><svg viewBox='0 0 1 1'/><p>{TEXT}</p><svg><title/><path d='M0'/></svg></article>", WHOLE),
        (None, ""),
        ("<form>", ""),
    ],
)
def test_pages_as_browsers_read_them(page, want):
    assert html_extract.main_text(page) == want


def test_mixing_keeps_other_columns_that_begin_alike(spark):
    rows = [(i, f"word{i} " * 30, "ab"[i % 2], 180, f"note {i}", i) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, mix_note string, mix_size long")
    out = mixing.documents(mixing.mixed(docs), docs.columns)
    assert out.columns == ["doc_id", "text", "source", "n_chars", "mix_note"]
    got = out.collect()
    assert got and all(r.mix_note == f"note {r.doc_id}" and r.text in rows[r.doc_id][1] for r in got)


def test_filter_of_ids_lets_all_wanted_ones_pass(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a{i} b c d e f{i}") for i in range(500)], "doc_id long, text string")
    near = spark.createDataFrame([(i,) for i in range(0, 500, 7)], "rep long")
    for most in (minhash.FILTER, 64):
        monkeypatch.setattr(minhash, "FILTER", most)
        got = {r.id: sorted(r.hashes) for r in minhash.shingle_sets(docs, "doc_id", "text", near).collect()}
        assert got == {i: sorted(minhash.shingles(f"a{i} b c d e f{i}").view("int64").tolist()) for i in range(0, 500, 7)}


@pytest.mark.parametrize("n", [0, 60])
def test_pipeline_with_nulls_clashing_columns_and_nothing(spark, tmp_path, n):
    words = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    text = lambda i: " ".join(words[(i * 7 + k * (i % 5 + 1)) % 100] for k in range(40)) + "."
    rows = [(i, text(i), "en", ("a", "b", None)[i % 3], 200, f"m{i}", i, i, "x", 1) for i in range(n)]
    odd = [(1000, None, None, None, None, "m", 1, 1, "x", 1), (1001, "", None, "c", 0, "m", 1, 1, "x", 1), (None, text(500), None, None, None, "m", 1, 1, "x", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, mix_note string, lost_id long, component_id long, piece string, `set` int"
    spark.createDataFrame(rows + odd * bool(n), schema).write.parquet(str(tmp_path / "documents.parquet"))
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
        assert len(docs.columns) == 10
    assert {r.doc_id for r in packed} <= {r.doc_id for r in docs.collect()} and bool(packed) == bool(n)
