import corpus_pipeline
from ledgerlark.llm import lines


def test_line_stage_sorts_suffixes(spark, monkeypatch):
    """The pipeline's stage removes what the suffix order and its common prefixes find."""
    found, real = [], lines.prefix_lengths

    def lengths(kept, scratch):
        out = real(kept, scratch)
        found.extend(out.collect())
        return out

    monkeypatch.setattr(lines, "prefix_lengths", lengths)
    run = "\n".join("abcdefgh")
    docs = spark.createDataFrame([(1, run, "en", "s", 15), (2, "x\n" + run, "en", "s", 17), (3, "y\nz", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.line_runs(spark, docs, "").collect()}
    assert out == {1: (run, 15), 2: ("x", 1), 3: ("y\nz", 3)}
    assert max(r.length for r in found) == 8 and sum(r.first is not None and r.p != r.first for r in found) == 7
