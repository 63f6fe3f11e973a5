from collections import Counter

import corpus_pipeline as P
from helpers import rows, solid
from test_decontamination import brute as contaminated
from test_ngram_join import brute as components
from test_toxicity import make

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def build(spark, tmp_path, docs, labels, items):
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages_against_brute_force(spark, tmp_path):
    texts, labels, _ = make(300, 5)
    item = "this item text has ten words or more in it"
    docs = [r[:5] for r in texts] + [(1000 + r[0], *r[1:5]) for r in rows(21, 150, longest=90, pieces=[item + " indeed"])]
    items = [(1, item), (2, None)]
    at = build(spark, tmp_path, docs, labels, items)
    step = [spark.read.parquet(f"{at}/documents.parquet")]
    for name, stage in P.STAGES:
        out = stage(spark, step[-1], at)
        if name != "sharding":
            assert out.columns == step[0].columns
        path = f"{at}/out-{name}"
        out.write.parquet(path)
        step.append(spark.read.parquet(path))
    got = [{r.doc_id: r.text for r in s.select("doc_id", "text").collect()} for s in step[:-1]]
    harsh = {d for d, t in got[0].items() if t and any(w.startswith("bad") for w in t.split())}
    assert len(harsh - set(got[1])) > 0.9 * len(harsh) and len(got[0].keys() - got[1].keys() - harsh) < 0.02 * len(got[0])
    roots = components(list(got[1].items()))
    assert set(got[2]) == {d for d, (_, c) in roots.items() if d == c}
    hit = contaminated(list(got[2].items()), items)
    assert set(got[3]) == {d for d in got[2] if not hit[d][1]}
    assert any(x[1] for x in hit.values())
    taken = Counter(r.doc_id for r in step[4].collect())
    assert set(taken) <= set(got[3]) and max(taken.values()) <= 3
    total = sum(len(solid(t)) for t in got[3].values())
    assert abs(sum(n * len(solid(got[3][d])) for d, n in taken.items()) - total) < 0.02 * total
    shards = step[5].collect()
    assert Counter(r.doc_id for r in shards) == taken
    assert Counter(map(tuple, P.run(spark, at).select("doc_id", "size").collect())) == Counter((r.doc_id, r["size"]) for r in shards)


def test_nulls_repeats_and_empty(spark, tmp_path):
    docs = [(1, "a b c d e f g", None, None, None)] * 2 + [(None, "a b c d e f g", "en", "s", 1), (None, None, None, None, None), (1, "other text", "en", "s", 1)]
    for at, rows_ in (("some", docs), ("none", [])):
        path = build(spark, tmp_path / at, rows_, [], [])
        got = P.run(spark, path).collect()
        assert len(got) == (0 if not rows_ else len({r.slot for r in got}) and len(got))
    base = spark.read.parquet(f"{tmp_path}/some/documents.parquet")
    kept = P.drop_near_copies(spark, base, "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept if r.text) == [(1, "a b c d e f g"), (1, "other text")]


def test_clashing_names_reach_the_last_stage(spark, tmp_path):
    kinds = "doc_id long, text string, lang string, source string, Size long, slot string, `a.b` int"
    docs = spark.createDataFrame([(i, f"text {i}", "en", "s", 7, "x", i) for i in range(30)] + [(5, "same", "en", "s", 7, "x", 1)] * 40, kinds)
    docs.write.parquet(f"{tmp_path}/docs")
    got = P.shard(spark, spark.read.parquet(f"{tmp_path}/docs"), "")
    assert got.columns == ["doc_id", "text", "lang", "source", "a.b", "size", "shard", "slot"]
    rows = got.collect()
    assert len(rows) == 70 and {r["size"] for r in rows if r.text == "same"} == {12}
    assert max(Counter(r.shard for r in rows).values()) <= 5  # equal rows part at cuts
    for shard in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
