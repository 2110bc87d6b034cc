import corpus_pipeline as pipeline
import pytest

from . import test_mixing, test_near_dedup, test_packing, test_pii

BIG = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def seen(spark, sf, tmp_path_factory):
    """The rows before all stages and after each."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    out["documents"] = docs
    for name, stage in pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, sf).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def rows(df):
    return sorted(df.collect(), key=lambda r: (r.doc_id is None, r.doc_id))


def test_stages_and_columns(seen):
    assert list(seen) == ["documents", "toxicity", "near_dedup", "pii", "mixing", "packing"]
    for name in list(seen)[:-1]:
        assert seen[name].columns == seen["documents"].columns and seen[name].dtypes == seen["documents"].dtypes


def test_toxicity_goes_by_labels(spark, seen, sf):
    """What is labelled toxic goes, almost without exception, and the rest stays, rows unchanged."""
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    before, after = rows(seen["documents"]), {r.doc_id: r for r in rows(seen["toxicity"])}
    assert all(after[r.doc_id] == r for r in before if r.doc_id in after)
    toxic, clean = ([r.doc_id for r in before if labels.get(r.doc_id) == y] for y in (1, 0))
    assert sum(d in after for d in toxic) <= 0.1 * len(toxic) and sum(d in after for d in clean) >= 0.97 * len(clean)


def test_one_of_each_class_stays(seen):
    left = rows(seen["toxicity"])
    classes = test_near_dedup.brute([r.text for r in left])
    assert rows(seen["near_dedup"]) == [r for k, r in enumerate(left) if classes[k] == k]


def test_personal_data_is_masked(seen):
    before, after = rows(seen["near_dedup"]), rows(seen["pii"])
    spans = test_pii.brute_spans([r.text for r in before])
    for a, b, said in zip(before, after, spans, strict=True):
        want, at = "", 0
        found = [(kind, int(s), int(e)) for kind, s, e in (x.split(":") for x in said.split(",") if x)]
        for kind, s, e in sorted(found, key=lambda x: (x[1], -x[2])):
            if s >= at:
                want += a.text[at:s] + f"[{kind.upper()}]"
            at = max(at, e)
        want += a.text[at:]
        assert (b.doc_id, b.text, b.lang, b.source, b.n_chars) == (a.doc_id, want, a.lang, a.source, len(want) if found else a.n_chars)


def test_sources_are_mixed(spark, seen):
    import duckdb

    con, docs = duckdb.connect(), seen["pii"].toArrow()
    con.register("documents", docs)
    want = sorted(con.execute(f"select doc_id, source, text from ({test_mixing.M.ORACLE})").fetchall())
    assert sorted((r.doc_id, r.source, r.text) for r in seen["mixing"].collect()) == want


def test_all_are_packed(seen):
    used = test_packing.check(seen["packing"].collect(), [(r.doc_id, r.text) for r in seen["mixing"].collect()])
    assert used <= -(-sum(r.length for r in seen["packing"].collect()) // 2048) + 1


def test_run_and_empty_table(spark, sf):
    assert pipeline.run(spark, sf).columns[:3] == ["doc_id", "piece", "start"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_clashing_and_dotted_columns(spark, sf, stage):
    """Every stage but the last keeps further columns as they are, nulls, empty and repeated rows without a crash."""
    words = " ".join(f"word{k}" for k in range(30))
    own = [(1, words, "en", "a", 9), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (None, None, None, None, None), (3, "é" * 5, "fr", None, 5)]
    more = ["copy int", "shuffle_key int", "__pii int", "__row string", "__toxicity int", "key int", "id int", "at int", "`a.b` int", "c0 int", "Band int", "place int"]
    docs = spark.createDataFrame([(*r, *("x" if m.endswith("string") else 7 for m in more)) for r in own], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(more))
    out = pipeline.STAGES[stage][1](spark, docs, sf)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    got = out.collect()
    assert got and all(tuple(r)[5:] == tuple(7 if not m.endswith("string") else "x" for m in more) for r in got)
    pipeline.STAGES[4][1](spark, docs, sf).collect()
