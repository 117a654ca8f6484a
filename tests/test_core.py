"""The library without its llm subpackage: queries against SQL, and operators on small cases."""

import json
import os
from collections import Counter
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftline import queries as core
from weftline.operators import histogram, intervals, joins, kmers, sets
from weftline.operators.shared import in_order
from weftline.plans import select
from weftline.sources import readers

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents labels".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def rows(df: pd.DataFrame) -> list:
    cell = lambda v: None if v is None or v != v else round(float(v), 6) if isinstance(v, (int, float)) else str(v)
    return sorted((tuple(cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_query_agrees_with_sql(spark, duck, name):
    assert rows(core.QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(core.ORACLES[name]).df())


def test_conditions():
    assert select.condition("") == "1 = 1"
    assert select.condition("10 < x <= 20 or y = '1 < 2 < 3'") == "(10 < x and x <= 20) or y = '1 < 2 < 3'"
    assert select.items("a, f(b, c) as d, 'x,y' as e") == ["a", "f(b, c) as d", "'x,y' as e"]


def test_implicit_group_keeps_order_and_aliases(spark):
    df = spark.createDataFrame([("a", 1), ("a", 5), ("b", 2)], "k string, v int")
    out = select.query(df, "max(v) as m, k as key, count(*) as n", None, "m desc")
    assert out.columns == ["m", "key", "n"]
    assert [tuple(r) for r in out.collect()] == [(5, "a", 2), (2, "b", 1)]


def _naive(a, b, left, right):
    return sorted((x[1], y[1], y[2] - x[2]) for x in a for y in b if x[0] == y[0] and y[3] >= x[2] - left and y[2] <= x[3] + right)


@pytest.mark.parametrize("bin_size", [1, 7, 1000])
def test_interval_join_equals_the_naive_one(spark, bin_size):
    import random

    rnd = random.Random(3)
    make = lambda n: [(rnd.choice("xy"), k, s := rnd.randrange(300), s + rnd.randrange(40)) for k in range(n)]
    a, b = make(60), make(60)
    frames = [spark.createDataFrame(v, "chr string, id int, start long, end long") for v in (a, b)]
    got = intervals.overlap_join(*frames, intervals.Window(12, 5), bin_size=bin_size).select("A__id", "B__id", "start").collect()
    assert sorted(map(tuple, got)) == _naive(a, b, 12, 5)


def test_windows_before_zero_match(spark):
    a = spark.createDataFrame([("x", 2, 4)], "chr string, start long, end long")
    assert intervals.overlap_join(a, a, intervals.Window(10, 10)).count() == 1


def test_set_algebra_invariants(spark):
    a = spark.createDataFrame([(p,) for p in (1, 2, 4, 5, 77, 78, 899, 7654)], "pos long")
    b = spark.createDataFrame([(p,) for p in (1, 2, 3, 4, 5, 77, 899, 7654)], "pos long")
    both = lambda df: sorted(r.pos for r in df.collect())
    assert both(sets.exclusive(a, b)) == [3, 78]
    assert sets.intersect(a, b).count() + sets.union(a, b).count() == a.count() + b.count()
    assert sets.phi(a, a).first().phi == 1.0
    assert sets.phi(a, sets.complement(a, 7655)).first().phi == -1.0
    assert sets.equal(a, a) and not sets.equal(a, b)
    assert both(sets.complement(sets.complement(a, 7655), 7655)) == both(a)
    spans = [(r["first"], r["last"]) for r in sets.spans(a, []).orderBy("first").collect()]
    assert spans == [(1, 2), (4, 5), (77, 78), (899, 899), (7654, 7654)]
    assert sets.cardinality(a.withColumn("k", F.lit(1)), ["k"]).first().n == 8


def test_spans_join_across_blocks(spark):
    df = spark.range((1 << 20) - 3, (1 << 20) + 3).select(F.col("id").alias("pos"))
    assert [tuple(r) for r in sets.spans(df, []).collect()] == [((1 << 20) - 3, (1 << 20) + 2)]


def test_permutations_of_a_set_with_itself(spark):
    a = sets.random_set(spark, 10, 20, 5000, seed=1)
    found = sets.permutation_test(a, a, 6000, times=10).first()
    assert found.times == 10 and found.observed == a.count() and 0 <= found.at_least <= 10


def test_runs_and_intervals(spark):
    runs = spark.createDataFrame([(0, 0, 3), (1, 1, 2), (2, 0, 1), (3, 1, 1)], "k int, bit int, n int")
    assert sorted(r.pos for r in sets.from_runs(runs, "k", "bit", "n").collect()) == [3, 4, 6]
    spans = spark.createDataFrame([(1, 100, 400), (1, 700, 900), (1, 10, 50), (1, 350, 500)], "g int, start long, end long")
    assert sorted((r.start, r.end) for r in intervals.merged(spans, "g").collect()) == [(10, 50), (100, 500), (700, 900)]


def test_kmers(spark):
    df = spark.createDataFrame([("AAAAcgtN",), ("AC",)], "s string")
    total = kmers.counts(df, "s", 3, "A").agg(F.sum("n")).first()[0]
    assert total == 6
    both = {r.kmer: r.n for r in kmers.counts(df, "s", 3, "C").collect()}
    assert both["AAA"] == 2 and both["ACG"] == 2 and "CGT" not in both
    long = spark.createDataFrame([("ACGT" * 20,)], "s string")
    assert kmers.distinct_count(long, "s", 41).first().n == 2  # the four phases are two pairs of reverse complements
    assert kmers.counts(df, "s", 3, "A", drop_poly_a=True).where("kmer = 'AAA'").first().n == 1


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (4.999,), (5.0,), (10.0,), (None,), (-1.0,)], "x double")
    assert [(r.bin, r.n) for r in histogram.uniform_1d(df, "x", 0, 10, 5).orderBy("bin").collect()] == [(0, 2), (1, 1), (2, 1)]
    assert sum(r.n for r in histogram.adaptive_1d(df, "x", 3).collect()) == 5


def test_upsert_and_load(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "k long, s string")
    values = spark.createDataFrame([(2, 7), (3, 9)], "k long, v int")
    assert sorted(map(tuple, joins.upsert_column(table, values, "k", "v").collect())) == [(1, "a", 0), (2, "b", 7), (3, "", 9)]
    pairs = spark.createDataFrame([("x", "1", 0), ("x", "2", 1), ("0", "3", 2), ("y", "0", 3)], "k string, v string, n int")
    assert [tuple(r) for r in joins.load_key_values(pairs, "k", "v", "n").collect()] == [("x", "2")]


def test_gff_bed_and_attributes(spark, tmp_path):
    (tmp_path / "a.gtf").write_text('#c\nchr1\tX\tgene\t11\t20\t.\t+\t.\tgene_id "G1"; level 2; ont "A"; ont "B;C";\nchr1\tX\tgene\t5\t9\t3\t-\t.\tID=g2;Note=n\n')
    gff = readers.gff(spark, str(tmp_path / "a.gtf"))
    one, two = gff.orderBy("start", ascending=False).collect()
    assert (one.start, one.end, one.strand, one.score) == (10, 20, 1, 0.0)
    assert one.attributes == {"gene_id": ["G1"], "level": ["2"], "ont": ["A", "B;C"]}
    assert two.attributes == {"ID": ["g2"], "Note": ["n"]} and two.strand == -1
    assert "ont" not in readers.attribute_columns(gff, drop_incomplete=True).columns
    readers.save_intervals(gff.drop("attributes"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("feature = 'gene'").count() == 2
    (tmp_path / "a.bed").write_text("chr2\t1\t5\tn\t7\t-\n")
    assert tuple(readers.bed(spark, str(tmp_path / "a.bed")).first()) == ("chr2", 1, 5, "n", 7, -1)


def test_fasta_fastq_obo_taxonomy(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">s1 first one\nAC GT\nAC\n>s2\nTT\n")
    assert sorted(map(tuple, readers.fasta(spark, str(tmp_path / "a.fa")).collect())) == [("s1", "first one", "ACGTAC"), ("s2", "", "TT")]
    (tmp_path / "a.fq").write_text("@r1 c\nACG\n+\n@II\n@r2\nA\n+\nI\n")
    assert sorted(map(tuple, readers.fastq(spark, str(tmp_path / "a.fq")).collect())) == [("r1", "c", "ACG", "@II"), ("r2", "", "A", "I")]
    (tmp_path / "a.obo").write_text('format-version: 1.2\nontology: go\n\n[Term]\nid: GO:1\nname: one\nis_a: GO:2 ! two\nis_a: GO:3 ! three\nxref: EC:1.1\nxref: MC:"x"\n\n[Typedef]\nid: part_of\n')
    term = readers.obo(spark, str(tmp_path / "a.obo")).collect()
    assert len(term) == 1 and term[0].id == "GO:1" and term[0].ontology == "go"
    assert term[0].fields["is_a"] == ["GO:2", "GO:3"] and term[0].xref == {"EC": ["1.1"], "MC": ["x"]}
    (tmp_path / "nodes.dmp").write_text("1\t|\t1\t|\tno rank\n2\t|\t1\t|\tx\n9\t|\t2\t|\tx\n")
    paths = joins.tree_paths(readers.taxonomy_nodes(spark, str(tmp_path / "nodes.dmp")), "1", "tax", "parent")
    assert {r.node: r.path for r in paths.collect()} == {"1": "1", "2": "1/2", "9": "1/2/9"}
    sequences = spark.createDataFrame([("gi|5|x", "gi|4|y", "A" * 40), ("gi|7|", "", "A")], "name string, comment string, seq string")
    readers.save_by_taxonomy(sequences, spark.createDataFrame([(4, 9)], "gi long, tax long"), paths, str(tmp_path / "tax"))
    assert spark.read.text(str(tmp_path / "tax")).count() >= 1


def test_sequences_over_splits_and_wrapped(spark, tmp_path):
    import gzip
    import random

    r = random.Random(4)
    rows = [(f"r{k}", "c d" if k % 2 else "", s := "".join(r.choices("ACGT", k=r.randint(1, 60))), "".join(r.choices("@+I#", k=len(s)))) for k in range(400)]
    text = "".join(f"@{n}{' ' + c if c else ''}\n{s}\n+{n}\n{q}\n" for n, c, s, q in rows)
    (tmp_path / "a.fq").write_text(text + "\n")
    (tmp_path / "b.fq").write_text(text.replace("\n", "\r\n"))
    with gzip.open(tmp_path / "c.fastq.gz", "wt") as f:
        f.write(text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        for name in ("a.fq", "b.fq", "c.fastq.gz"):
            assert sorted(map(tuple, readers.fastq(spark, str(tmp_path / name)).collect())) == sorted(rows), name
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    fold = lambda x: "\n".join(x[k : k + 7] for k in range(0, len(x), 7))
    (tmp_path / "w.fq").write_text("".join(f"@{n} {c}\n{fold(s)}\n+\n{fold(q)}\n" for n, c, s, q in rows))
    assert sorted(map(tuple, readers.fastq(spark, str(tmp_path / "w.fq"), wrapped=True).collect())) == sorted(rows)
    (tmp_path / "bad.fq").write_text("@r\nACGT\n+\nII\n")
    with pytest.raises(Exception, match="differ in length"):
        readers.fastq(spark, str(tmp_path / "bad.fq")).collect()
    assert readers.sequences(spark, str(tmp_path / "c.fastq.gz")).count() == 400


def test_kmer_job_from_a_file_to_a_table(spark, tmp_path, monkeypatch):
    import random

    r = random.Random(5)
    seqs = ["".join(r.choices("ACGT", k=n)) for n in (3, 50, 700)]
    (tmp_path / "a.fa").write_text("".join(f">s{k}\n{s}\n" for k, s in enumerate(seqs)))
    flip = str.maketrans("ACGT", "TGCA")
    want = Counter(min(x, x[::-1].translate(flip)) for s in seqs for x in (s[i : i + 5] for i in range(len(s) - 4)))
    for block in (1 << 14, 64):
        monkeypatch.setattr(kmers, "BLOCK", block)
        found = kmers.job(spark, str(tmp_path / "a.fa"), 5, str(tmp_path / "out"))
        assert {x.frequency: x.n_distinct for x in found.collect()} == Counter(want.values())
        assert {x.kmer: x.n for x in spark.read.parquet(str(tmp_path / "out")).collect()} == want
    kmers.save(spark.read.parquet(str(tmp_path / "out")), str(tmp_path / "text"), text=True)
    assert {tuple(x.value.split("\t")) for x in spark.read.text(str(tmp_path / "text")).collect()} == {(x, str(n)) for x, n in want.items()}
    named = spark.createDataFrame([("ACGTA", 1, "x")], "s string, _at int, _part string")
    assert kmers.exploded(named, "s", 3, "A", keep=["_at", "_part"]).columns == ["_at", "_part", "kmer"]


def test_writers_and_small_readers(spark, tmp_path):
    (tmp_path / "g.gtf").write_text('chr1\tX\tgene\t11\t20\t.\t+\t.\tgene_id "G1"; ont "A"; ont "B";\n')
    table = readers.gff(spark, str(tmp_path / "g.gtf"))
    one = json.loads(readers.gff_as_json(table).first().json)
    assert one["attributes"] == {"gene_id": "G1", "ont": "B"} and one["start"] == 10 and one["strand"] == 1
    assert tuple(readers.gff_as_bed(table).first()) == ("chr1", 10, 20, "gene", 0.0)
    (tmp_path / "gi.tsv").write_text("5\t9\n6\t10\n")
    assert sorted(map(tuple, readers.gi_taxid(spark, str(tmp_path / "gi.tsv")).collect())) == [(5, 9), (6, 10)]
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, s string")
    readers.save_json(df, str(tmp_path / "json"))
    assert sorted(map(tuple, spark.read.schema(df.schema).json(str(tmp_path / "json")).collect())) == [(1, "a"), (2, None)]
    readers.save_tsv(df, str(tmp_path / "tsv"))
    assert sorted(x.value for x in spark.read.text(str(tmp_path / "tsv")).collect()) == ["1\ta", "2\t"]
    assert readers.as_columns(df.orderBy("k")) == {"k": [1, 2], "s": ["a", None]}
    df.write.parquet(str(tmp_path / "one"))
    df.withColumn("more", F.lit(7)).write.parquet(str(tmp_path / "two"))
    both = select.union_tables(spark, [str(tmp_path / "one"), str(tmp_path / "two")])
    assert both.columns == ["k", "s", "more"] and sorted(map(str, (x.more for x in both.collect()))) == ["7", "7", "None", "None"]
    (tmp_path / "t.tsv").write_text("#c\na\t1\nb\t2\na\t0\na\t9\na\t3\n")
    kv = joins.load_key_values(readers.key_values(spark, str(tmp_path / "t.tsv")), "key", "value")
    assert {x.key: x.value for x in kv.collect()} == {"a": "3", "b": "2"}
    (tmp_path / "bad.tsv").write_text("a\t1\t2\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.key_values(spark, str(tmp_path / "bad.tsv")).collect()
    (tmp_path / "c.obo").write_text("format-version: 1\r\ndefault-namespace: x\r\n\r\n[Term]\r\nid: A:1\r\nname: n\r\n\r\n[Typedef]\r\nid: p\r\n\r\n[Term]\r\nid: A:2\r\n")
    assert sorted((x.id, x.ontology) for x in readers.obo(spark, str(tmp_path / "c.obo")).collect()) == [("A:1", "x"), ("A:2", "x")]


def test_sets_restored_and_their_bits(spark):
    rows = [(k, p) for k, ps in enumerate(([0, 1, 5, 32767, 32768, 32769, 70_000], [0], [4_061_912_144, 1])) for p in ps]
    df = spark.createDataFrame(rows, "k int, pos long")
    assert sorted(map(tuple, sets.restored(sets.compact(df, ["k"]), ["k"]).collect())) == sorted(rows)
    assert sorted(x.pos for x in sets.with_bits(df.where("k = 1").select("pos"), [0, 9, 70]).collect()) == [0, 9, 70]


def test_all_pairs_have_a_phi(spark):
    own = {"a": {1, 2, 3}, "b": {2, 3, 4}, "c": {9}}
    df = spark.createDataFrame([(k, p) for k, ps in own.items() for p in ps], "k string, pos long")
    got = {(x.a, x.b): (x.n11, x.phi) for x in sets.all_pairs_phi(df, "k").collect()}
    assert set(got) == {("a", "b"), ("a", "c"), ("b", "c")} and got["a", "c"][0] == 0 and got["a", "c"][1] < 0
    assert tuple(sets.closest_pair(df, "k").first())[:3] == ("a", "b", 2)


def test_order_of_all_rows_in_ranges(spark):
    import random

    r = random.Random(8)
    rows = [(7 if k % 3 else r.randrange(5), k, r.randrange(10)) for k in range(500)]
    df = spark.createDataFrame(rows, "x int, tie int, n int")
    got = sorted(in_order(df, ["x", "tie"], "k", {"sum": "n"}).select("k", "x", "tie", "sum").collect())
    total = 0
    for k, (x, row) in enumerate(zip(sorted(rows), got, strict=True)):
        total += x[2]
        assert tuple(row) == (k, *x[:2], total)
    assert sorted(x.n for x in histogram.with_ntile(df, "x", 7, ["tie"]).groupBy("bin").agg(F.count("*").alias("n")).collect()) == [71] * 4 + [72] * 3
    clash = df.withColumnRenamed("n", "_rank")
    assert histogram.with_ntile(clash, "x", 3, ["tie"]).columns == ["x", "tie", "_rank", "bin"]


def test_long_intervals_and_merging_over_blocks(spark):
    import random

    r = random.Random(6)
    make = lambda n: [(r.choice("xy"), k, s := r.randrange(100_000), s + int(10 ** r.uniform(0, 5))) for k in range(n)]
    a, b = make(80), make(80)
    frames = [spark.createDataFrame(v, "chr string, id int, start long, end long") for v in (a, b)]
    got = intervals.overlap_join(*frames, intervals.Window(12, 5), bin_size=16).select("A__id", "B__id", "start").collect()
    assert sorted(map(tuple, got)) == _naive(a, b, 12, 5)
    size = 1 << 20
    wide = [(1, size - 5, 3 * size + 2), (1, 3 * size, 3 * size + 9), (1, 5 * size, 6 * size), (1, 6 * size, 6 * size + 1), (2, 5, 5), (2, -3, 4)]
    out = intervals.merged(spark.createDataFrame(wide, "g int, start long, end long"), "g")
    assert sorted(map(tuple, out.collect())) == [(1, size - 5, 3 * size + 9), (1, 5 * size, 6 * size + 1), (2, -3, 4)]


def test_trees_of_many_levels_and_with_loops(spark):
    chain = [(str(k + 1), str(k)) for k in range(105)]
    more = [("0", "0"), ("x", "3"), ("y", "x"), ("x", "y"), ("lost", "away"), (None, "3"), ("3", None)]
    got = {r.node: (r.depth, r.path) for r in joins.tree_paths(spark.createDataFrame(chain + more, "child string, parent string"), "0").collect()}
    want = {str(k): (k, "/".join(map(str, range(k + 1)))) for k in range(106)}
    assert got == want | {"x": (4, "0/1/2/3/x"), "y": (5, "0/1/2/3/x/y")}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "chr string, start long, end long")
    assert intervals.overlap_join(empty, empty).count() == 0
    assert kmers.counts(spark.createDataFrame([], "s string"), "s", 3).count() == 0
    assert sets.spans(spark.createDataFrame([], "pos long"), []).count() == 0
    assert histogram.adaptive_1d(spark.createDataFrame([], "x double"), "x", 3).count() == 0
