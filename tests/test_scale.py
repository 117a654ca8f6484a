"""Operators whose plan matters: joins that stay near their results, k-mers and records over splits, each against brute force."""

import bisect
import bz2
import itertools
import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.operators import histogram, intervals, joins, kmers, sets
from weftline.sources import readers, wrapped

# --- intervals


def spans(spark, rows):
    return spark.createDataFrame(rows, "chr string, id int, start long, end long")


@pytest.mark.parametrize("seed", [1, 2])
def test_interval_join_over_many_levels(spark, seed):
    r = random.Random(seed)
    length = lambda: int(2 ** r.uniform(0, 18))
    rows = [[(r.choice("xyz"), k, s := r.randrange(200_000), s + length()) for k in range(300)] for _ in range(2)]
    rows[0] += [("x", 900, 0, 1 << 20), (None, 901, 0, 5), ("x", 902, None, 5)]
    rows[1] += [("y", 900, 0, 1 << 20), ("x", 901, 150_000, 150_000), (None, 902, 0, 5)]
    got = intervals.overlap_join(*(spans(spark, x) for x in rows), intervals.Window(40, 7), bin_size=16).select("A__id", "B__id", "start").collect()
    full = [[x for x in side if None not in x] for side in rows]
    want = [(i, j, b - s) for c, i, s, e in full[0] for d, j, b, f in full[1] if c == d and f >= s - 40 and b <= e + 7]
    assert sorted(map(tuple, got)) == sorted(want)


def test_one_long_interval_costs_its_own_pairs_only(spark):
    """Pairs that meet in a bin, with and without an interval as long as the chromosome."""
    r = random.Random(4)
    rows = [[("x", k, s := r.randrange(4_000_000), s + r.randrange(100)) for k in range(4000)] for _ in range(2)]
    met = {}
    for long in (False, True):
        a = spans(spark, rows[0] + [("x", -1, 0, 4_000_000)] * long).withColumn("seen", F.lit(1))
        b = spans(spark, rows[1]).withColumn("seen", F.lit(1))
        size, window = 128, intervals.Window(10, 10)
        near = lambda df, lo, hi: df.withColumns({"lo": F.col("start") - lo, "hi": F.col("end") + hi})
        left, right = near(a, 10, 10), near(b, 0, 0)
        owned = [intervals._owned(x, "lo", "hi", size) for x in (left, right)]
        pairs = 0
        for levels_a, levels_b, least in ((None, owned[0], 0), (owned[1], None, 1)):
            x = intervals._binned(left, "lo", "hi", size, "_a", levels_a, least).groupBy("_a_level", "_a_bin").agg(F.count("*").alias("n"))
            y = intervals._binned(right, "lo", "hi", size, "_b", levels_b, least).groupBy("_b_level", "_b_bin").agg(F.count("*").alias("m"))
            pairs += x.join(y, (F.col("_a_level") == F.col("_b_level")) & (F.col("_a_bin") == F.col("_b_bin"))).agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0))).first()[0]
        met[long] = pairs
        assert intervals.overlap_join(a, b, window, bin_size=size).count() == sum(e >= s - 10 and f <= t + 10 for _, _, s, t in rows[0] + [("x", -1, 0, 4_000_000)] * long for _, _, f, e in rows[1])
    # the long one touches a few bins of its level, in which each row of the other side stands twice at most
    assert met[True] - met[False] <= 2 * 4000


def test_clustered_rows_of_a_group_are_together_and_in_order(spark):
    r = random.Random(5)
    df = spans(spark, [(r.choice("uvw"), k, s := r.randrange(1000), s + r.randrange(9)) for k in range(500)])
    seen = intervals.clustered(df).select(F.spark_partition_id().alias("p"), "chr", "start", "end").collect()
    assert len(seen) == 500 and all(len({x.p for x in seen if x.chr == c}) == 1 for c in "uvw")
    for p in {x.p for x in seen}:
        own = [(x.chr, x.start, x.end) for x in seen if x.p == p]
        assert own == sorted(own)


# --- k-mers


def naive(texts, k, mode, drop=False):
    out = Counter()
    for t in texts:
        t = "".join(c if c in "CGT" else "A" for c in (t or "").translate(str.maketrans("acgt", "ACGT")))
        for i in range(len(t) - k + 1):
            x = t[i : i + k]
            y = x.translate(str.maketrans("ACGT", "TGCA"))[::-1]
            x = min(x, y) if mode == "C" else x
            if drop and x == "A" * k and i:
                continue
            out[x] += 1
            if mode == "B" and not (drop and y == "A" * k):
                out[y] += 1
    return dict(out)


@pytest.fixture(scope="module")
def sequences():
    r = random.Random(8)
    dna = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    base = dna(700)
    mixed = ["".join(r.choice("ACGTacgtN") for _ in range(r.randrange(60))) for _ in range(40)]
    return [base, base, base.translate(str.maketrans("ACGT", "TGCA"))[::-1], base[100:300] + dna(90), *mixed, "A" * 9000, "T" * 30, "AAAAAAAAAAAAAAAACGT" * 9, "naïve 漢字 text é" * 3, "", None, "ac", "TTTTTTTTTTTTTTTTTTTTTTTTTG"]


@pytest.mark.parametrize("k", [1, 3, 9, 10, 13, 21, 40])
@pytest.mark.parametrize(("mode", "drop"), [("A", False), ("B", False), ("C", False), ("A", True), ("B", True), ("C", True)])
def test_kmer_counts_in_every_mode(spark, sequences, monkeypatch, k, mode, drop):
    if k in (13, 40):  # sequences in parts, runs in parts, tasks that hand on early
        for name, value in (("PIECE", 100), ("RUN", 50), ("HELD", 30)):
            monkeypatch.setattr(kmers, name, value)
    df = spark.createDataFrame([(s, "x") for s in sequences], "run string, kmer string").repartition(3)
    found = kmers.counts(df, "run", k, mode, drop).collect()
    assert len(found) == len({r.kmer for r in found})
    assert {r.kmer: r.n for r in found} == naive(sequences, k, mode, drop)


def test_long_sequences_are_cut_in_parts_that_overlap(sequences, monkeypatch):
    monkeypatch.setattr(kmers, "PIECE", 100)
    batches = [pa.RecordBatch.from_arrays([pa.array(sequences[i : i + 7], pa.string())], names=["s"]) for i in range(0, len(sequences), 7)]
    for k in (1, 4, 12):
        seen, firsts, longest = Counter(), 0, 0
        for codes, real, first in kmers._pieces(iter(batches), k):
            seen.update("".join("ACGT"[c] for c in codes[i : i + k]) for i in range(len(real)) if real[i])
            firsts, longest = firsts + int((first & real).sum()), max(longest, len(codes))
        assert dict(seen) == naive(sequences, k, "A") and longest < 100 + 2 * (100 + k)
        assert firsts == sum(len(s or "") >= k for s in sequences)


def test_super_kmers_deal_hot_minimizers_and_shuffle_less(spark):
    r = random.Random(3)
    reads = ["".join(r.choice("ACGT") for _ in range(400)) for _ in range(300)] + ["ACGTTGCATGTCGCATGATGC" * 40] * 60
    rows = spark.createDataFrame([(s,) for s in reads], "s string").repartition(2)
    hot = kmers.crowded(rows, 21)
    assert 0 < len(hot) < 8
    runs = kmers.super_kmers(rows, 21, [], hot).collect()
    own = [x for x in runs if x.bucket < 1 << 32]
    assert max(Counter(x.bucket for x in own).values()) < 0.05 * len(runs)
    assert all(len(x.run) == 21 for x in runs if x.bucket >= 1 << 32)
    total = sum((len(x.run) - 20) * x.times for x in runs)
    assert total == sum(len(s) - 20 for s in reads)
    random_part = [x for x in own if x.times == 1]
    assert sum(len(x.run) for x in random_part) < 21 * sum(len(x.run) - 20 for x in random_part) / 4  # letters against k-mers one by one


def test_kmers_are_counted_where_their_runs_arrive(spark, sequences):
    """One exchange of the runs: the count by bucket and k-mer adds none."""
    df = spark.createDataFrame([(s,) for s in sequences], "s string")
    plan = kmers.counts(df, "s", 21)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_equal_runs_of_all_tasks_are_cut_into_kmers_once(spark):
    """Rows that are cut into k-mers: the different runs, not those of each task."""
    r = random.Random(9)
    text = "".join(r.choice("ACGT") for _ in range(3000))
    rows = spark.createDataFrame([(text,)] * 8, "s string").repartition(8)
    counted = kmers.counts(rows, "s", 21)
    assert {x.kmer: x.n for x in counted.collect()} == naive([text] * 8, 21, "C")
    cut, todo = 0, [counted._jdf.queryExecution().executedPlan()]
    todo[0].execute().count()
    while todo:
        node = todo.pop()
        todo += [node.finalPhysicalPlan()] if node.nodeName() == "AdaptiveSparkPlan" else [node.children().apply(i) for i in range(node.children().size())]
        cut += node.metrics().get("numOutputRows").get().value() if node.nodeName() == "Generate" else 0
    assert 0 < cut <= 2 * (3000 - 20)  # the plan may have run twice


def test_kmers_of_crowded_minimizers_are_counted_as_numbers(spark, sequences, monkeypatch):
    """Many copies of few k-mers cost a task no object for each copy, and agree up to the greatest k of a number and beyond."""
    text = ["ACGTTGCATGTCGCATGATGC" * 60] * 40
    for k in (21, 31, 32):
        rows = spark.createDataFrame([(s,) for s in [*text, *sequences]], "s string").repartition(2)
        assert {x.kmer: x.n for x in kmers.counts(rows, "s", k).collect()} == naive([*text, *sequences], k, "C")
    seen = []
    monkeypatch.setattr(kmers, "Counter", type("Seen", (Counter,), {"update": lambda self, x=(): (seen.append(len(x or ())), Counter.update(self, x))[1]}))
    batch = pa.RecordBatch.from_arrays([pa.array(text)], names=["s"])
    tasks = type("Rows", (), {"mapInArrow": lambda self, f, schema: list(f(iter([batch])))})()
    told = kmers.super_kmers(tasks, 21, [], list(range(4**9)))
    assert sum(sum(x.column("times").to_pylist()) for x in told) == 40 * (21 * 60 - 20)
    assert sum(seen) <= 42


# --- wrapped FASTQ


def fastq_text(r, n, wide):
    """(records, text): sequences and qualities of many lines, qualities that look like headers and marks, blank lines between."""
    records, out = [], []
    for k in range(n):
        size = r.choice([0, 1, 5, 40, 200]) if k % 17 else 1500
        seq = "".join(r.choice("ACGT") for _ in range(size))
        qual = "".join(r.choice("@+I#") for _ in range(size))
        records.append((f"r{k}", "of a file" if k % 2 else "", seq, qual))
        cut = lambda s: [s[i : i + wide] for i in range(0, len(s), wide)]
        out += [f"@r{k}" + (" of a file" if k % 2 else ""), *cut(seq), f"+r{k}" if k % 3 else "+", *cut(qual), *[""] * (k % 5 == 0)]
    return records, "\n".join(out) + "\n"


@pytest.mark.parametrize(("split", "n"), [("70", 10), ("333", 25), ("4000", 60), ("128m", 60)])
def test_wrapped_records_are_equal_at_any_split_size(spark, tmp_path, split, n):
    r = random.Random(int(split.strip("m")))
    wanted = []
    for name, wide in (("a.fq", 17), ("b.fq", 60)):
        records, text = fastq_text(r, n, wide)
        (tmp_path / name).write_text(text)
        wanted += records
    (tmp_path / "c.fq").write_text("")
    (tmp_path / "d.fq").write_bytes(b"junk before\r\n@r1 x\r\nAC\r\nGT\r\n+\r\n@@\r\n@@")
    wanted.append(("r1", "x", "ACGT", "@@@@"))
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "10")
        got = readers.fastq(spark, str(tmp_path / "*.fq"), wrapped=True).collect()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert sorted(map(tuple, got)) == sorted(wanted)


@pytest.mark.parametrize("text", ["@a\nACGT\n+\nII\n", "@a\nACGT\n", "@a\nAC\n+\nIII\n@b\nA\n+\nI\n"])
def test_wrapped_records_of_unequal_lengths_are_errors(spark, tmp_path, text):
    (tmp_path / "x.fq").write_text(text)
    with pytest.raises(Exception, match="differ in length"):
        readers.fastq(spark, str(tmp_path / "x.fq"), wrapped=True).collect()


def test_summaries_of_splits_stay_small():
    """A split of a thousand records tells its exit for any entry in a few intervals."""
    import numpy as np

    r = random.Random(6)
    _, text = fastq_text(r, 1000, 50)
    lines = text.split("\n")[37:]
    told = wrapped.summary(np.array([len(x) for x in lines]), np.flatnonzero([x.startswith("@") for x in lines]), np.flatnonzero([x.startswith("+") for x in lines]))
    assert len(told["quality"]) + len(told["sequence"]["ends"]) < 60


# --- permutations


def layouts(positions, size):
    """Every rearrangement of a set's runs and gaps, as bits of a number."""
    bits = "".join("01"[p in positions] for p in range(size))
    runs = [(k, len(list(g))) for k, g in itertools.groupby(bits)]
    sides = [[n for k, n in runs if k == b] for b in "01"]
    for lead in (0, 1):
        for x, y in itertools.product(*(itertools.permutations(sides[b]) for b in (lead, 1 - lead))):
            pairs = itertools.zip_longest(((lead, n) for n in x), ((1 - lead, n) for n in y))
            yield int("".join(str(b) * n for p in pairs for b, n in filter(None, p)), 2)


@pytest.mark.parametrize(("laid", "few"), [(1 << 17, 256), (1, 0), (2, 256)])
def test_rearrangements_are_as_likely_as_all(spark, monkeypatch, laid, few):
    """The share of replicates that overlap as much as the sets do, beside that of all pairs of rearrangements."""
    monkeypatch.setattr(sets, "LAID", laid)
    monkeypatch.setattr(sets, "FEW", few)
    size, x, y = 19, {0, 1, 2, 3, 7, 11, 12}, {2, 3, 6, 7, 8, 9, 18}
    a, b = (spark.createDataFrame([(p,) for p in z], "pos long") for z in (x, y))
    every = [Counter(layouts(z, size)) for z in (x, y)]
    least = len(x & y)
    hits = sum(n * m for i, n in every[0].items() for j, m in every[1].items() if (i & j).bit_count() >= least)
    p, times = hits / (every[0].total() * every[1].total()), 600
    assert 0.1 < p < 0.9
    found = sets.permutation_test(a, b, size, times).first()
    assert (found.observed, found.times) == (least, times)
    assert abs(found.at_least - p * times) < 4 * math.sqrt(times * p * (1 - p))


@pytest.mark.parametrize("laid", [1 << 17, 16, 7])
def test_replicates_keep_every_position_of_a_set(spark, monkeypatch, laid):
    """Whatever the arrangement, a set meets a full one in all its positions, and an empty one in none."""
    monkeypatch.setattr(sets, "LAID", laid)
    r, size = random.Random(2), 3_000_000
    starts = [(s := r.randrange(size - 3000), s + r.choice([1, 2, 5, 40, 3000])) for _ in range(300)]
    a = sets.from_intervals(spark.createDataFrame([*starts, (0, 70_000), (size - 1, size)], "start long, end long"), [])
    whole, none = spark.range(size).select(F.col("id").alias("pos")), a.where("pos < 0")
    found = sets.permutation_test(a, whole, size, times=9).first()
    assert found.observed == a.count() and found.at_least == found.times == 9
    more = sets.permutation_test(a.where("pos > 0"), whole.where("pos > 0"), size, times=9).first()
    assert more.at_least <= 9 and more.observed == a.count() - 1
    assert tuple(sets.permutation_test(a, none, size, times=3).first()) == (0, 3, 3)


def test_no_run_of_a_replicate_is_a_row(spark, monkeypatch):
    """Orders of rows and tables hold a set's runs once, however many replicates there are."""
    sizes = []
    for name in ("in_order", "written"):
        f = getattr(sets, name)
        monkeypatch.setattr(sets, name, lambda df, *a, f=f: (sizes.append(df.count()), f(df, *a))[1])
    a = spark.range(3000).where("id % 3 != 0 and id % 7 != 0").select(F.col("id").alias("pos"))
    assert sets.permutation_test(a, a, 3000, times=40).first().times == 40
    runs = sets.spans(a, []).count()
    assert runs > 900 and max(sizes) <= 2 * runs


# --- trees


def test_deep_trees_take_few_rounds(spark, monkeypatch):
    calls = []
    real = joins.written
    monkeypatch.setattr(joins, "written", lambda df, name: calls.append(name) or real(df, name))
    depth = 1500
    edges = [(str(k + 1), str(k)) for k in range(depth)] + [(f"b{k}", str(k % 700)) for k in range(900)]
    edges += [("0", "z"), ("u", "v"), ("v", "u"), ("w", "v"), ("lost", "away"), (None, "1"), ("0", "0"), ("5", "4")]
    got = {r.node: (r.depth, r.path) for r in joins.tree_paths(spark.createDataFrame(edges, "child string, parent string"), "0").collect()}
    chain = [str(k) for k in range(depth + 1)]
    want = {c: (k, "/".join(chain[: k + 1])) for k, c in enumerate(chain)}
    want |= {f"b{k}": (k % 700 + 1, "/".join([*chain[: k % 700 + 1], f"b{k}"])) for k in range(900)}
    assert got == want
    assert calls.count("tree") <= 13


# --- correlation of many sets


def families(r, groups, members, universe, size):
    """Sets that share most of their positions within a group; one position is in all of them."""
    out = {}
    for g in range(groups):
        base = r.sample(range(universe), size)
        for m in range(members):
            own = set(base) - set(r.sample(base, max(1, size // (5 + 10 * m)))) | set(r.sample(range(universe), 3)) | {7}
            out[f"s{g:02}{m}"] = own
    return out


def phis(own, n):
    out = {}
    for a in own:
        for b in own:
            if a < b:
                x = len(own[a] & own[b])
                ca, cb = len(own[a]), len(own[b])
                d = math.sqrt(ca * (n - ca) * cb * (n - cb))
                out[a, b] = (x, (x * (n - ca - cb + x) - (ca - x) * (cb - x)) / d if d else None)
    return out


def rows_of(spark, own):
    return spark.createDataFrame([(k, p) for k, ps in own.items() for p in ps] + [(None, 5)], "k string, p long")


def test_all_pairs_by_blocks_and_similar_pairs_by_prefixes(spark):
    r = random.Random(11)
    own = families(r, 8, 4, 40_000, 60) | {"big": set(range(0, 40_000, 3)), "most": set(range(0, 40_000, 3)) - set(range(0, 900, 3)), "one": {7}, "two": {39_999}}
    n = 40_000
    df, want = rows_of(spark, own), phis(own, n)
    for least in (0.3, 0.6, 0.9):
        got = {(x.a, x.b): (x.n11, x.phi) for x in sets.similar_pairs(df, "k", least, "p").collect()}
        assert set(got) == {k for k, (_, v) in want.items() if v >= least}
        assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in got)
    every = {(x.a, x.b): (x.n11, x.phi) for x in sets.all_pairs_phi(df, "k", "p").collect()}
    assert set(every) == set(want) and all(every[k][0] == want[k][0] and abs(every[k][1] - want[k][1]) < 1e-9 for k in want)
    best = max(want.items(), key=lambda x: (x[1][1], [-ord(c) for c in "".join(x[0])]))
    found = sets.closest_pair(df, "k", "p").first()
    assert (found.a, found.b, found.n11) == (*best[0], best[1][0])


def test_more_sets_than_a_block(spark):
    r = random.Random(12)
    own = {f"s{k:03}": set(r.sample(range(70_000), 20)) | {3} for k in range(600)}
    got = {(x.a, x.b): x.n11 for x in sets.common(rows_of(spark, own), "k", "p").collect()}
    assert got == {(a, b): len(own[a] & own[b]) for a in own for b in own if a < b}  # all share one


def test_closest_pair_of_equal_far_and_no_sets(spark):
    own = {"a": {1, 2, 50}, "c": {4, 9}, "d": {4, 9}, "b": {4, 9}, "e": {60}}
    assert tuple(sets.closest_pair(rows_of(spark, own), "k", "p").first()) == ("b", "c", 2, 1.0)
    far = {"a": {1, 2, 3}, "b": {3, 4, 5, 6, 7, 8}, "c": {9, 10}}
    want = phis(far, 11)
    top = max(want, key=lambda k: want[k][1])
    assert tuple(sets.closest_pair(rows_of(spark, far), "k", "p").first())[:2] == top
    assert sets.closest_pair(rows_of(spark, {}), "k", "p").collect() == []
    assert sets.closest_pair(rows_of(spark, {"a": {1, 2}}), "k", "p").collect() == []


# --- adaptive bins by sketches


def test_sketched_bins_keep_their_rank_error(spark):
    r = random.Random(13)
    values = [r.gauss(0, 1) if k % 3 else 0.25 for k in range(30_000)]
    df = spark.createDataFrame([(v, -v) for v in values] + [(None, 1.0)], "x double, y double").repartition(5)
    got = sorted(histogram.adaptive_1d(df, "x", 20, error=0.002).collect())
    ranked = sorted(values)
    assert sum(b.n for b in got) == len(values)
    for b in got[1:]:
        # the border below a bin, which is between its least value and the one before, stands at an even share of rows
        share, wide, at = (b.bin - 1) * len(values) / 20, 0.002 * len(values) + 1, bisect.bisect_left(ranked, b.lower)
        assert b.lower >= ranked[int(share - wide)] and ranked[at - 1] <= ranked[min(len(values) - 1, int(share + wide))]
    cells = histogram.adaptive_2d(df, "x", "y", 4, 4, error=0.002).collect()
    assert sum(c.n for c in cells) == len(values) and all(c.lower1 <= c.upper1 and c.lower2 <= c.upper2 for c in cells)
    plan = df.where("x is not null").select(*[c.alias(f"b{k}") for k, c in enumerate(histogram.sketched_bins(df, {"x": 20, "y": 3}, 0.01))])._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
    assert histogram.adaptive_1d(df.where("x > 99"), "x", 5, error=0.01).collect() == []


# --- loading


def test_last_key_of_several_files_wins_by_file_name(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("".join(f"k{i % 50}\told{i}\n" for i in range(4000)))
    (tmp_path / "b.tsv").write_text("k1\tnew\nk2\t0\n#k3\tno\nk4\t\n")
    kv = joins.load_key_values(readers.key_values(spark, str(tmp_path / "*.tsv"), order="at"), "key", "value", "at")
    got = {x.key: x.value for x in kv.collect()}
    assert got == {f"k{i}": f"old{3950 + i}" for i in range(50)} | {"k1": "new"}


def test_compressed_tables(spark, tmp_path):
    with bz2.open(tmp_path / "t.tsv.bz2", "wt") as f:
        f.write("a\t1\nb\t2\n")
    assert sorted(map(tuple, readers.key_values(spark, str(tmp_path / "t.tsv.bz2")).collect())) == [("a", "1"), ("b", "2")]


def test_a_crowded_taxonomy_path_is_many_files(spark, tmp_path):
    rows = [(f"gi|{1 if k % 3 else 2}|s{k}", "", "ACGT" * 25) for k in range(300)]
    seqs = spark.createDataFrame(rows, "name string, comment string, seq string")
    gi = spark.createDataFrame([(1, 10), (2, 20)], "gi long, tax long")
    paths = spark.createDataFrame([("10", "1/10"), ("20", "1/20")], "node string, path string")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        readers.save_by_taxonomy(seqs, gi, paths, str(tmp_path / "tax"), file_bytes=3000)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    found = spark.read.text(str(tmp_path / "tax"))
    assert found.where("value like '>%'").count() == 300
    files = {p.parent.name: len(list(p.parent.glob("*.txt"))) for p in (tmp_path / "tax").rglob("*.txt")}
    assert len(files) == 2 and max(files.values()) > 1
