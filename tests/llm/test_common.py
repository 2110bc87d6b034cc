import os

import numpy as np
import pyarrow as pa

from sylva.llm import common as C
from sylva.llm import packing, toxicity


def test_intermediate_tables_go_to_the_shared_folder_and_away(spark):
    df = C.materialise(spark.range(5), "five")
    assert df._sylva_path.startswith(spark.conf.get("spark.checkpoint.dir")) and df.count() == 5
    C.discard(df)
    assert not os.path.exists(df._sylva_path)
    other = C.materialise(spark.range(3), "three")
    C.clean(spark)
    assert not os.path.exists(other._sylva_path)


def test_words_and_shingles():
    texts = ["A b, c d e f", "", "a B c", "x" * 100, "é É e", "a b c d e f"]
    words, first = C.word_hashes(texts)
    assert np.diff(first).tolist() == [6, 0, 3, 1, 3, 6]
    assert (words[first[0] : first[1]] == words[first[5] : first[6]]).all()
    assert words[first[4]] == words[first[4] + 1] != words[first[4] + 2]
    h, begin = C.shingles(words, first)
    assert np.diff(begin).tolist() == [2, 0, 1, 1, 1, 2]
    alone = [C.shingles(*C.word_hashes([t]))[0].tolist() for t in texts]
    assert [h[a:b].tolist() for a, b in zip(begin[:-1], begin[1:])] == alone


def test_chunks_cover_all_texts():
    texts = ["a" * n for n in (5, 50, 1, 1, 1, 200, 3)]
    assert [list(range(*c)) for c in C.chunks(texts, 60)] == [[0, 1, 2, 3, 4], [5], [6]]
    assert list(C.chunks([])) == []


def test_workers_keep_caches_of_one_operator_only(spark):
    docs = spark.createDataFrame([(k, f"some words {k}") for k in range(64)], "doc_id long, text string").repartition(8)
    pieces = packing.cut(docs, packing.default_tokenizer())
    assert pieces.count() == 64

    def held(b):
        return pa.RecordBatch.from_arrays([pa.array([len(packing._encoders) + len(toxicity._codes) + len(C._powers)])], ["n"])

    assert {r[0] for r in C.map_arrow(docs, held, "n long").collect()} == {0}


def test_caches_stay_from_task_to_task_of_one_operator():
    C.serve("one")
    toxicity.features(["some words"], frozenset({"some"}))
    C.serve("one")
    assert toxicity._codes
    C.serve("other")
    assert not toxicity._codes
