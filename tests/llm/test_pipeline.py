"""The corpus pipeline against a brute-force version of its stages, one after the other."""

import re

import corpus_pipeline
from pyspark.sql import functions as F
from test_operators import BASE, base_spans, edited, free_edits, frame, links, repeat_words, split, whole_units, words

from weftline.llm import decontam, pieces


def passes(t):
    ws, lines = split(t), [x for x in (t or "").split("\n") if split(x)]
    n, letters = len(ws), sum(map(len, ws))
    if n < 50 or 100 * repeat_words(ws) > 50 * n or 10 * len(re.findall(r"[#*$%&|<>]", t)) > n or not 2 * n <= letters <= 20 * n:
        return False
    return 100 * (len(lines) - len(set(lines))) <= 30 * len(lines) and 100 * len(re.findall("[A-Z]", t)) <= 30 * letters


def redact(t):
    spans = sorted((int(a), int(b), kind) for kind, a, b in (s.split(":") for s in base_spans(t)))
    out, at = "", 0
    for a, b, kind in spans:
        if a >= at:
            out += t[at:a] + f"[{kind.upper()}]"
        at = max(at, b)
    return out + t[at:]


def test_stages(spark, tmp_path):
    item = words(30, 500)
    texts = [" ".join(words(120, 700 + k)) for k in range(8)]
    texts += [texts[0], " ".join(edited(words(120, 701), 1, 3)), " ".join(words(10, 1)), "", None, "*** ".join(words(80, 5)), "x y z " * 40]
    texts += [" ".join([*words(60, 41), *edited(item, 3, 8), *words(40, 42)]), " ".join([*words(70, 43), "mail a.b@c.org or +1 (499) 555-6503 now", *words(30, 44)])]
    texts += [" ".join(words(90, 45)).upper(), " ".join(words(2000, 46)) + " 10.0.0.1\nend"]
    frame(spark, texts).drop("row", "t").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(item)), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs = [(i, t) for i, t in enumerate(texts) if passes(t)]
    near, gone = links([t for _, t in docs]), set()
    for k in range(len(docs)):
        if k not in gone:
            todo = [k]
            while todo:
                for j in near[todo.pop()]:
                    if j != k and j not in gone:
                        gone.add(j)
                        todo.append(j)
    docs = [d for k, d in enumerate(docs) if k not in gone]
    clean = lambda t: [c for w in t.encode().split() if (c := decontam.cleaned(w))]
    docs = [(i, t) for i, t in docs if free_edits(item, clean(t)) > len(item) // 5]
    model = pieces.load()
    want = {i: (redact(t), [x for u in whole_units(redact(t)) for x in model.best(u)]) for i, t in docs}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.text, list(r.ids)) for r in got} == want and len(got) == len(want)
    assert all(r.intact and r.n_chars == len(r.text) for r in got)
    assert len(BASE) == 4 and 8 < len(want) < len(texts) and any("[EMAIL]" in t and "[PHONE]" in t for t, _ in want.values())


def test_stages_keep_the_columns_and_stand_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = frame(spark, []).drop("row", "t")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 0


def test_stages_stand_odd_rows_and_clashing_names(spark, tmp_path):
    """Nulls, very long texts, ties, repeated rows and columns that are named like those of the stages."""
    item = words(30, 500)
    long = " ".join([*words(60_000, 71), "write to a.b@c.org now"])
    texts = [long, long, " ".join(words(90, 72)), " ".join(words(90, 72)), None, "", " ".join(words(80, 73)), " ".join([*words(50, 74), *item])]
    ids = [0, 1, 2, 2, 4, 5, None, 7]
    names = {"lang": "ids", "source": "intact", "row": "_gone", "t": "class_id"}
    docs = frame(spark, texts, ids).withColumnsRenamed(names).withColumn("_keep", F.lit(1)).withColumn("score", F.lit(2))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(item)), (None, None), (1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        left.append(sorted(-1 if r.doc_id is None else r.doc_id for r in now.collect()))
    assert left == [[-1, 0, 1, 2, 2, 7], [-1, 0, 2, 7], [-1, 0, 2], [-1, 0, 2], [-1, 0, 2]]
    last = {r.doc_id: r for r in now.collect()}
    assert last[0].text == long.replace("a.b@c.org", "[EMAIL]") and last[0].n_chars == len(last[0].text) and all(r.intact for r in last.values())
    assert len(set(now.columns)) == len(now.columns)
