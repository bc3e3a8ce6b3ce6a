"""Each stage of the pipeline against brute force on its own input, written and read between stages as in a run."""

import re
from collections import Counter

import corpus_pipeline
import pytest
from test_llm_operators import SCHEMA, WHITE, check_packing, components_of, library, odd_rows, spans_of  # noqa: F401

DOCS = "/root/testdata/sf0.001"


def rows_of(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def passes(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    three = Counter(zip(words, words[1:], words[2:], strict=False))
    again = {k + j for k, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if three[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    chars = sum(map(len, words))
    return (
        len(words) >= 50 and 100 * len(again) <= 50 * len(words) and 2 * len(words) <= chars <= 20 * len(words)
        and 4 * len(re.findall(r"[#*$%&|<>]", text)) <= len(words) and 2 * (len(lines) - len(set(lines))) <= len(lines)
    )


def test_stages(spark, tmp_path, library):  # noqa: F811
    docs = spark.read.parquet(f"{DOCS}/documents.parquet")
    columns, names = docs.columns, [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "near_dedup", "secret_scan", "best_fit_packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = rows_of(docs)
        out = stage(spark, docs, DOCS)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name == "best_fit_packing":
            bins, total = check_packing(out.collect(), docs, library)
            assert bins <= -(-total // 2048) * 1.02 + 1
            break
        assert out.columns == columns
        after = rows_of(out)
        if name == "quality_rules":
            assert after == {i: t for i, t in before.items() if passes(t)}
        elif name == "line_dedup":
            key = lambda x: x.strip(WHITE).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            found = Counter(k for t in before.values() for k in {key(x) for x in t.split("\n")})
            assert after == {i: "\n".join(x for x in t.split("\n") if not key(x) or found[key(x)] < 10) for i, t in before.items()}
        elif name == "near_dedup":
            assert after == {i: before[i] for i, _, _, kept in components_of(before.items()) if kept}
        else:
            assert set(after) == set(before)
            assert all(not any(spans_of(t)) for t in after.values())
            assert all(after[i] == t for i, t in before.items() if not any(spans_of(t)) and "[SECRET]" not in after[i])
            assert any("[SECRET]" in t for t in after.values())
        docs = out


@pytest.mark.parametrize("kind", ["odd", "empty"])
def test_stages_of_odd_rows(spark, tmp_path, library, kind):  # noqa: F811
    """Nulls in any column, empty and long texts, repeated rows, further columns with names that operators use; and no row."""
    long_text = " ".join(f"word{i % 997} and{i}" for i in range(40_000))
    prose = " ".join(f"sentence{i} of words" for i in range(30))
    rows = odd_rows() + [(70, long_text, None, None, None, None, None, None, None), (71, prose, "en", "s", 1, "n", "k", "r", 1), (72, prose + " more", "en", "s", 1, "n", "k", "r", 1), (None, prose, None, None, None, None, None, None, None)]
    rows += [(73, prose + "\npassword = abcdefghijklmnop", "en", "s", 1, "n", "k", "r", 1)] * 2
    docs = spark.createDataFrame(rows if kind == "odd" else [], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        out = stage(spark, docs, DOCS)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name == "best_fit_packing":
            check_packing(out.collect(), docs, library)
            break
        assert out.columns == SCHEMA.names
        after = out.collect()
        texts = lambda of: sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in of)
        if name == "quality_rules":
            assert texts(after) == texts([r for r in before if passes(r["text"] or "")])
        elif name == "near_dedup":
            kept = {i for i, _, _, kept in components_of([(r["doc_id"], r["text"] or "") for r in before if r["doc_id"] is not None]) if kept}
            assert texts(after) == texts([r for r in before if r["doc_id"] is None or r["doc_id"] in kept])
        else:
            assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in after) == sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in before)
            assert Counter(r["text"] is None for r in after) == Counter(r["text"] is None for r in before)
        docs = out


def test_run(spark):
    assert corpus_pipeline.ORACLE_SQL is None
    assert corpus_pipeline.run(spark, DOCS).count() > 0
