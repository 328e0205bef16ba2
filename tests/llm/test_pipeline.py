import base64
import os
import random

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from factloom.llm import quality

from .test_decontaminate import brute as leaks
from .test_decontaminate import plain as all_leaks
from .test_fuzzy_lines import brute as lines
from .test_fuzzy_lines import plain as all_lines
from .test_neardup import brute as near


def corpus():
    rnd = random.Random(11)
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(500)]
    good = lambda: "\n".join(" ".join(rnd.choices(words, k=rnd.randrange(8, 20))).capitalize() + "." for _ in range(rnd.randrange(2, 6)))
    junk = lambda: "\n".join("".join(rnd.choices("$%#*&|@", k=40)) for _ in range(4))
    items = [(i, " ".join(rnd.choices(words, k=25))) for i in range(5)]
    rows = [[i, good() if i % 4 else junk()] for i in range(120)]
    for i in range(1, 117, 8):
        w = rows[i][1].split(" ")
        w[rnd.randrange(len(w))] = "other"
        rows.append([200 + i, " ".join(w)])
        rows.append([400 + i, rows[i][1]])
        rows.append([600 + i, good() + "\n" + items[i % 5][1]])
    docs = [(i, t, "en", "s", len(t)) for i, t in rows] + [(900, None, None, None, None), (901, "", "en", "s", 0)]
    return docs, [(i, int(i % 4 > 0)) for i in range(80)], items


@pytest.mark.skipif("FACTLOOM_SLOW" not in os.environ, reason="takes minutes; set FACTLOOM_SLOW to run it")
def test_run_equals_brute_force(spark, tmp_path):
    docs, labels, items = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    for name, df in (("documents", d), ("labels", spark.createDataFrame(labels, "doc_id long, quality int")), ("benchmark", spark.createDataFrame(items, "item_id long, text string"))):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.unique_lines(spark, d, str(tmp_path)).columns == d.columns
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    model = quality.train(d, spark.createDataFrame(labels, "doc_id long, quality int"))
    rows = [(i, t) for i, t, *_ in docs if model.quality(t) >= corpus_pipeline.LEAST_QUALITY]
    assert {i for i, _ in rows} >= {i for i, *_ in docs if i < 900 and i % 4 == 1} and not {i for i, _ in rows} & {i for i in range(0, 120, 4)}
    before = dict(rows)
    rows = [(i, t) for i, t in lines(rows, most_bits=24) if not ((t or "") != (before[i] or "") and not (t or "").split())]
    rows = [(i, dict(rows)[i]) for i, _, _, kept in near(rows) if kept]
    gone = {r[0] for r in leaks(rows, items)}
    rows = [(i, t) for i, t in rows if i not in gone]
    assert set(got) == {i for i, _ in rows} and gone and len(rows) > 60
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, t in rows:
        assert list(got[i].ids) == encoding.encode_ordinary(t or "") and got[i].n_tokens == len(got[i].ids)


def test_rows_without_ids_or_with_equal_ones_are_judged_each_by_itself(spark, tmp_path):
    rnd = random.Random(5)
    text = [" ".join(rnd.choices([f"w{i}" for i in range(900)], k=40)) for _ in range(8)]
    spark.createDataFrame([(1, text[7])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(3, text[0]), (2, text[0] + " end"), (None, text[0]), (None, text[1]), (None, text[2]), (None, text[2] + " end"), (4, text[3]), (4, text[3]), (4, text[4]), (None, None), (None, text[5] + " " + text[7]), (4, text[7] + " " + text[6])]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string")
    left = corpus_pipeline.no_near_copies(spark, docs, str(tmp_path))
    got = [(r.doc_id, r.text) for r in left.collect()]
    one = [x for x in got if x in rows[4:6]]
    assert len(one) == 1 and sorted([x for x in got if x not in one], key=repr) == sorted([rows[1], rows[3], rows[6], rows[8], rows[9], rows[10], rows[11]], key=repr)
    clean = corpus_pipeline.no_benchmarks(spark, docs, str(tmp_path))
    assert clean.columns == docs.columns and sorted(((r.doc_id, r.text) for r in clean.collect()), key=repr) == sorted(rows[:10], key=repr)


def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path):
    docs, labels, items = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").limit(0)
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, d, str(tmp_path))
        assert out.collect() == [] and (k == len(corpus_pipeline.STAGES) - 1 or out.columns == d.columns)


def test_run_over_a_small_corpus_equals_brute_force(spark, tmp_path):
    docs, labels, items = corpus()
    docs = [r for r in docs if r[0] % 200 < 40 or r[0] >= 900]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    for name, df in (("documents", d), ("labels", spark.createDataFrame(labels, "doc_id long, quality int")), ("benchmark", spark.createDataFrame(items, "item_id long, text string"))):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    model = quality.train(d, spark.createDataFrame(labels, "doc_id long, quality int"))
    before = {i: t for i, t, *_ in docs if model.quality(t) >= corpus_pipeline.LEAST_QUALITY}
    rows = [(i, t) for i, t in all_lines(list(before.items())) if not ((t or "") != (before[i] or "") and not (t or "").split())]
    rows = [(i, dict(rows)[i]) for i, _, _, kept in near(rows) if kept]
    gone = {i for i, _ in all_leaks(rows, items)}
    rows = [(i, t) for i, t in rows if i not in gone]
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert gone and len(before) < len(docs) and len(rows) > 20
    assert got == {i: encoding.encode_ordinary(t or "") for i, t in rows}
