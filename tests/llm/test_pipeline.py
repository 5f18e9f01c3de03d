import random

import corpus_pipeline
from lodemap.llm import registry

from .test_jaccard_join import brute as components
from .test_decontam import brute as contaminated


def test_registered():
    found = registry()
    numbers = sorted(int(n[2:].split("_")[0]) for n in found if n.startswith("op"))
    assert numbers == list(range(1, 14)) and "pipeline" in found and [s for s, _ in corpus_pipeline.STAGES][0] == "toxicity"


def test_stages_against_brute_force(spark, make, prose, odd_rows, tmp_path):
    r = random.Random(4)
    rows, labels = list(odd_rows), []
    for i in range(200):
        words = prose(2000 + i, 80).split()
        if i % 5 == 0:
            for _ in range(3):
                words.insert(r.randrange(80), "vileword")
            labels.append((100 + i, 1))
        else:
            labels.append((100 + i, 0))
        rows.append((100 + i, " ".join(words)))
    item = prose(7777, 30)
    rows += [(500 + i, prose(2000 + i, 80) + " more") for i in range(1, 4)]
    rows += [(510, prose(1, 50) + " " + item), (511, prose(5000, 60) + ' password = "0123456789abcdef0123456789abcdef" end')]
    make(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    kept = stage["toxicity"](spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    one = [(x.doc_id, x.text) for x in kept.collect()]
    bad = {i for i, y in labels if y}
    assert not bad & {i for i, _ in one} and {i for i, y in labels if not y} <= {i for i, _ in one}
    kept = stage["ngram_jaccard_join"](spark, kept, str(tmp_path))
    assert kept.columns == docs.columns
    two = [(x.doc_id, x.text) for x in kept.collect()]
    stays = {i for i, _, c in components(one, 5, 80) if i == c and i is not None}
    assert sorted(i for i, _ in two if i is not None) == sorted(stays) and sum(i is None for i, _ in two) == sum(i is None for i, _ in one)
    kept = stage["benchmark_decontamination"](spark, kept, str(tmp_path))
    assert kept.columns == docs.columns
    three = [(x.doc_id, x.text) for x in kept.collect()]
    assert sorted(map(str, (x[0] for x in three))) == sorted(str(x[0]) for x in contaminated(two, [(1, item)], 10) if not x[5])
    kept = stage["secret_scans"](spark, kept, str(tmp_path))
    assert kept.columns == docs.columns and kept.count() == len(three)
    assert "[secret]" in kept.filter("doc_id = 511").first().text
    bins = stage["best_fit_packing"](spark, kept, str(tmp_path)).collect()
    assert sorted({str(i) for b in bins for i in b.doc_ids}) == sorted({str(i) for i, _ in three})


def test_empty_tables(spark, make, tmp_path):
    make([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
