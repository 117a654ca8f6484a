"""k-mers of sequences: counts, spectra, lookups and filters.

A k-mer is a string of length k over A, C, G and T, so k has no limit and string order is packed order.

Counting up to k = DENSE: a task counts into one array of all k-mers, so a shuffle has one row for each different k-mer and
task.  Beyond: neighbouring k-mers share most of their letters, and most share their minimizer, the m-mer of theirs that is
first in a fixed order that takes both strands for the same.  A run of k-mers with one minimizer is shuffled as one string, a super-k-mer,
by its minimizer, and cut into k-mers after the exchange, where all copies of a k-mer meet; they are counted there without
another exchange.  Runs that a task has seen already travel once, with their number, and equal runs of all tasks are
added up before they are cut.  A minimizer with too many of all
k-mers would fill one partition: its share is known from a pass of counts before, and its k-mers travel one by one, each counted within a
task first, dealt by the k-mer.  Hash aggregation, spilling and partitioning are Spark's.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.shared import unused

MODES = ("A", "B", "C")
#: The greatest k for which a task holds a count of every k-mer, and the longest minimizer.
DENSE, MINIMIZER = 9, 9
#: Positions that a task looks at together (few enough that its arrays stay in a core's cache, as tasks side by side share the way to memory),
#: k-mers of a run at most, and different runs that a task holds before it hands them on.
PIECE, RUN, HELD = 1 << 16, 1 << 12, 200_000
#: Positions of a sequence in one row while it is cut up, so that a chromosome is never one row of all its k-mers.
BLOCK = 1 << 14


def nucleotides(sequence: Column) -> Column:
    """Upper-case A, C, G, T; any other character reads as A.  Not upper(), which can lengthen text."""
    return F.regexp_replace(F.translate(sequence, "acgt", "ACGT"), "[^CGT]", "A")


def reverse_complement(kmer: Column) -> Column:
    return F.translate(F.reverse(kmer), "ACGT", "TGCA")


def canonical(kmer: Column) -> Column:
    """The lesser of a k-mer and its reverse complement."""
    return F.least(kmer, reverse_complement(kmer))


def exploded(df: DataFrame, sequence: str, k: int, mode: str = "C", keep: list[str] | None = None, drop_poly_a: bool = False) -> DataFrame:
    """One row (kept columns, kmer) for each k-mer.  Mode C: canonical; B: as read and its reverse complement; A: as read.

    drop_poly_a leaves out k-mers of A alone beyond the first of each sequence, as compact counters do.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    own = keep or []
    s, start, part, at = unused([*own, "kmer"], "_s", "_start", "_part", "_at")
    # letters are single bytes, so a k-mer is a slice of bytes; a substring of text would count characters from its start
    long = df.select(*own, F.col(sequence).alias(s)).where(F.length(s) >= k)
    long = long.select(*own, nucleotides(F.col(s)).cast("binary").alias(s))
    blocks = long.select(*own, s, F.explode(F.sequence(F.lit(0), F.length(s) - k, F.lit(BLOCK))).alias(start))
    parts = blocks.select(*own, start, F.substring(s, F.col(start) + 1, F.lit(BLOCK + k - 1)).alias(part))
    each = parts.select(*own, start, part, F.explode(F.sequence(F.lit(1), F.length(part) - k + 1)).alias(at))
    plain = F.substring(part, F.col(at), F.lit(k)).cast("string")
    first = F.col(start) + F.col(at) == 1
    out = each.select(*own, first.alias(at), (canonical(plain) if mode == "C" else plain).alias("kmer"))
    if drop_poly_a:
        out = out.where((F.col("kmer") != "A" * k) | F.col(at))
    if mode == "B":
        back = out.select(*own, at, reverse_complement(F.col("kmer")).alias("kmer"))
        out = out.unionByName(back.where(F.col("kmer") != "A" * k) if drop_poly_a else back)
    return out.drop(at)


_CODE = bytes({ord(c): i for i, x in enumerate("ACGT") for c in (x, x.lower())}.get(b, 0) for b in range(256))
_LETTER = np.frombuffer(b"ACGT", np.uint8)
_COMPLEMENT = bytes.maketrans(b"ACGT", b"TGCA")


def _pieces(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(codes of letters, whether a k-mer starts there, whether it is its sequence's first): many short sequences at once, and
    long ones in parts that overlap by k - 1."""
    held: list[bytes] = []
    firsts: list[bool] = []
    size = 0

    def joined() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        codes, lengths = np.frombuffer(b"".join(held), np.uint8), np.array([len(x) for x in held])
        ends = np.cumsum(lengths)
        real, first = np.ones(len(codes) - k + 1, bool), np.zeros(len(codes) - k + 1, bool)
        real[(ends[:-1, None] - np.arange(1, k)).ravel()] = False  # each part has a k-mer, so none begins before its own start
        first[(ends - lengths)[np.array(firsts)]] = True
        return codes, real, first

    for batch in batches:
        for text in batch.column("s"):
            letters = (text.as_py() or "").encode("latin-1", "replace").translate(_CODE)  # one byte for any character
            for at in range(0, len(letters) - k + 1, PIECE):
                held.append(letters[at : at + PIECE + k - 1])
                firsts.append(at == 0)
                size += len(held[-1])
                if size >= PIECE:
                    yield joined()
                    held, firsts, size = [], [], 0
    if held:
        yield joined()


def _numbers(codes: np.ndarray, k: int, back: bool = False) -> np.ndarray:
    """Each k-mer as a number whose order is that of strings; back: its reverse complement.  Windows double, as in _least."""
    out, have = (3 - codes if back else codes).astype(np.int32 if k < 16 else np.int64), 1
    while have < k:
        step = min(have, k - have)
        ahead = out[step:]
        out = out[:-step] | ahead >> 2 * (have - step) << 2 * have if back else out[:-step] << 2 * step | ahead & (4**step - 1)
        have += step
    return out


def _digits(numbers: np.ndarray, k: int) -> np.ndarray:
    """(numbers x k) codes of the letters of k-mers given as numbers."""
    return ((numbers[:, None] >> (2 * np.arange(k - 1, -1, -1))) & 3).astype(np.uint8)


def _added(numbers: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each different number and the sum of its times."""
    order = np.argsort(numbers)
    numbers, times = numbers[order], times[order]
    begin = np.flatnonzero(np.diff(numbers, prepend=-1))
    return numbers[begin], np.add.reduceat(times, begin) if len(begin) else times


def _dense(rows: DataFrame, k: int, mode: str, drop_poly_a: bool) -> DataFrame:
    """(kmer, n): each task's counts of all k-mers, added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(4**k, np.int64)
        poly = np.array([0, 4**k - 1] if mode == "C" else [0])
        leading = np.zeros(len(poly), np.int64)
        for codes, real, first in _pieces(batches, k):
            found = _numbers(codes, k)
            total += np.bincount(found[real], minlength=4**k)
            leading += (found[first & real, None] == poly).sum(0)
        if drop_poly_a:
            total[poly] = leading
        there = np.flatnonzero(total)
        back = ((3 - _digits(there, k)[:, ::-1]).astype(np.int64) << (2 * np.arange(k - 1, -1, -1))).sum(1)
        if mode == "C":
            number, n = np.minimum(there, back), total[there]
        elif mode == "B":
            kept = back != 0 if drop_poly_a else np.ones(len(back), bool)
            number, n = np.concatenate([there, back[kept]]), np.concatenate([total[there], total[there][kept]])
        else:
            number, n = there, total[there]
        names = _LETTER[_digits(number, k)].tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([names[i : i + k].decode() for i in range(0, len(names), k)], pa.string()), pa.array(n)], names=["kmer", "n"])

    return rows.mapInArrow(run, "kmer string, n long").groupBy("kmer").agg(F.sum("n").alias("n"))


def _least(x: np.ndarray, wide: int) -> np.ndarray:
    """The least of each ``wide`` neighbours, by windows that double."""
    have = 1
    while have < wide:
        step = min(have, wide - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def _minimizers(codes: np.ndarray, real: np.ndarray, k: int, m: int) -> np.ndarray:
    """The place in the order of m-mers of each k-mer's minimizer; -1 where none starts.  AAA... is last in the order."""
    mask = 4**m - 1
    # only the low bits of the product count, so it may overflow
    order = (np.minimum(_numbers(codes, m), _numbers(codes, m, True)) * (0x9E3779B1 & mask) + mask) & mask
    return np.where(real, _least(order, k - m + 1), -1)


def _opening(runs: list[bytes], k: int, m: int) -> list[int]:
    """The place of the minimizer of each run's first k-mer, which is that of the whole run."""
    out = []
    for i in range(0, len(runs), PIECE // k + 1):
        codes = np.frombuffer(b"".join([x[:k] for x in runs[i : i + PIECE // k + 1]]).translate(_CODE), np.uint8)
        out += _minimizers(codes, np.True_, k, m)[::k].tolist()
    return out


def _length(k: int) -> int:
    return min(MINIMIZER, 2 * k // 3)


def crowded(rows: DataFrame, k: int) -> list[int]:
    """Minimizers with more than half of a partition's even share of all k-mers: fewer than twice the partitions."""
    m, parts = _length(k), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = np.zeros(4**m, np.int64), [], 0
        for codes, real, _ in _pieces(batches, k):
            held.append(_minimizers(codes, real, k, m)[real])
            size += len(held[-1])
            if size >= 4 * len(total):
                total += np.bincount(np.concatenate(held), minlength=4**m)
                held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=4**m)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["minimizer", "n"])

    found = rows.mapInArrow(run, "minimizer long, n long").groupBy("minimizer").agg(F.sum("n").alias("n"))
    whole = found.agg(F.sum("n").alias("whole"))
    return [r.minimizer for r in found.join(F.broadcast(whole), F.col("n") * (2 * parts) > F.col("whole")).collect()]


def super_kmers(rows: DataFrame, k: int, poly: list[str], hot: list[int]) -> DataFrame:
    """(bucket, run, first, times): runs of neighbouring k-mers with one minimizer, and how often a task has seen each.
    first: one that begins a sequence with a k-mer of poly.  All copies of a k-mer, on both strands, are in one bucket."""
    m = _length(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()  # runs, runs that open a sequence, k-mers of crowded minimizers, and those that open one
        opening: Counter[bytes] = Counter()
        alone: Counter[bytes] = Counter()
        leading: Counter[bytes] = Counter()
        # k-mers of crowded minimizers that fit a number are counted as numbers: those that wait, and those counted
        waiting: list[np.ndarray] = []
        tally = np.zeros(0, np.int64), np.zeros(0, np.int64)
        polys, crowd = [p.encode() for p in poly], np.zeros(4**m + 1, bool)  # the last entry is for -1
        crowd[hot] = True

        def settled() -> None:
            nonlocal tally
            if waiting:
                found, n = np.unique(np.concatenate(waiting), return_counts=True)
                tally = _added(np.concatenate([tally[0], found]), np.concatenate([tally[1], n]))
                waiting.clear()

        def flushed() -> pa.RecordBatch:
            nonlocal tally
            settled()
            if len(tally[0]):
                names = _LETTER[_digits(tally[0], k)].tobytes()
                alone.update(dict(zip((names[i : i + k] for i in range(0, len(names), k)), tally[1].tolist(), strict=True)))
                tally = np.zeros(0, np.int64), np.zeros(0, np.int64)
            whole = _opening([*seen, *opening], k, m)
            single = [(1 << 32) + zlib.crc32(min(x, x.translate(_COMPLEMENT)[::-1])) for x in (*alone, *leading)]
            kinds = ((seen, False), (opening, True), (alone, False), (leading, True))
            runs = [x for held, _ in kinds for x in held]
            columns = [whole + single, runs, [first for held, first in kinds for _ in held], [n for held, _ in kinds for n in held.values()]]
            for held in (seen, opening, alone, leading):
                held.clear()
            kinds_of = (pa.int64(), pa.binary(), pa.bool_(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds_of, strict=True)], names=["bucket", "run", "first", "times"])

        def counted(held: Counter[bytes], apart: Counter[bytes], found: list[bytes], opens: np.ndarray) -> None:
            if polys and opens.any():
                for x, first in zip(found, opens.tolist(), strict=True):
                    (apart if first and x[:k] in polys else held)[x] += 1
            else:
                held.update(found)

        for codes, real, first in _pieces(batches, k):
            least, text = _minimizers(codes, real, k, m), _LETTER[codes].tobytes()
            single = np.flatnonzero(crowd[least])
            opens = first[single] if polys else np.zeros(len(single), bool)
            if k < 32 and len(single):
                waiting.append(_numbers(codes, k)[single[~opens]])
                single, opens = single[opens], opens[opens]
                if sum(map(len, waiting)) > 1 << 20:
                    settled()
            counted(alone, leading, [text[i : i + k] for i in single.tolist()], opens)
            begin = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | first[1:]]))
            end = np.append(begin[1:], len(least))
            there = (least[begin] >= 0) & ~crowd[least[begin]]
            begin, end = begin[there], end[there]
            parts = -(-(end - begin) // RUN)
            if (parts > 1).any():  # long runs in parts
                at = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
                begin, end = np.repeat(begin, parts) + at * RUN, np.repeat(end, parts)
            stops = np.minimum(end, begin + RUN) + k - 1
            runs = [text[s:e] for s, e in zip(begin.tolist(), stops.tolist(), strict=True)]
            counted(seen, opening, runs, first[begin])
            if len(seen) + len(opening) + len(alone) + len(leading) + len(tally[0]) > HELD:
                yield flushed()
        yield flushed()

    return rows.mapInArrow(run, "bucket long, run binary, first boolean, times long")


def counts(df: DataFrame, sequence: str, k: int, mode: str = "C", drop_poly_a: bool = False) -> DataFrame:
    """(kmer, n).  Mode C: canonical; B: as read and its reverse complement; A: as read.  drop_poly_a leaves out k-mers of A alone
    but for those that begin a sequence, as compact counters do."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    rows = df.select(F.col(sequence).alias("s"))
    if k <= DENSE:
        return _dense(rows, k, mode, drop_poly_a)
    poly = (["A" * k, "T" * k] if mode == "C" else ["A" * k]) if drop_poly_a else []
    dealt = super_kmers(rows, k, poly, crowded(rows, k)).repartition("bucket")
    # what several tasks have seen is cut into k-mers once
    dealt = dealt.groupBy("bucket", "run", "first").agg(F.sum("times").alias("times"))
    # a run is read backwards once, and each of its k-mers is a slice of both
    back = reverse_complement(F.col("run").cast("string")).cast("binary").alias("back")
    at = F.explode(F.sequence(F.lit(1), F.length("run") - k + 1)).alias("at")
    plain = F.substring("run", F.col("at"), F.lit(k)).cast("string").alias("plain")
    other = F.substring("back", F.length("run") - F.col("at") - k + 2, F.lit(k)).cast("string").alias("other")
    cut = dealt.select("bucket", "run", back, "first", "times").select("*", at).select("bucket", "times", plain, other, (F.col("first") & (F.col("at") == 1)).alias("opens"))
    if drop_poly_a:
        cut = cut.where(~F.col("plain").isin(poly) | F.col("opens"))
    plain, other = F.col("plain"), F.col("other")
    if mode == "B":
        both = F.array(plain, other)
        # a copy that is A alone by being read backwards is left out, too
        kmer = F.explode(F.when(F.lit(drop_poly_a) & (plain == "T" * k), F.array(plain)).otherwise(both))
    else:
        kmer = F.least(plain, other) if mode == "C" else plain
    # rows are dealt by bucket already, which is a part of these keys: no further exchange
    return cut.select("bucket", "times", kmer.alias("kmer")).groupBy("bucket", "kmer").agg(F.sum("times").alias("n")).select("kmer", "n")


def job(spark: SparkSession, path: str, k: int, folder: str, mode: str = "C", least: int = 0, most: int = 0, drop_poly_a: bool = False) -> DataFrame:
    """Counts the k-mers of a FASTA or FASTQ file, saves those counted least to most times as a table under folder, and gives
    the spectrum of what is saved."""
    from weftline.sources.readers import sequences

    save(filtered(counts(sequences(spark, path), "seq", k, mode, drop_poly_a), least, most), folder)
    return spectrum(spark.read.parquet(folder))


def spectrum(table: DataFrame) -> DataFrame:
    """(frequency, n_distinct), rarest first."""
    return table.groupBy(F.col("n").alias("frequency")).agg(F.count("*").alias("n_distinct")).orderBy("frequency")


def filtered(table: DataFrame, least: int = 0, most: int = 0) -> DataFrame:
    """k-mers counted least to most times; most of 0, or below least, means no upper bound."""
    kept = table.where(F.col("n") >= least) if least > 1 else table
    return kept.where(F.col("n") <= most) if most > 0 and most >= least else kept


def find(table: DataFrame, asked: DataFrame, sequence: str, mode: str = "C") -> DataFrame:
    """(asked, n): the count of each asked sequence, 0 if it is not there."""
    key = nucleotides(F.col(sequence))
    wanted = asked.select(F.col(sequence).alias("asked"), (canonical(key) if mode == "C" else key).alias("_kmer"))
    return wanted.join(table, F.col("_kmer") == F.col("kmer"), "left").select("asked", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def singletons(table: DataFrame) -> DataFrame:
    """(n): how many k-mers occur once."""
    return table.agg(F.count_if(F.col("n") == 1).alias("n"))


def distinct_count(df: DataFrame, sequence: str, k: int, approximate: bool = False) -> DataFrame:
    """(n): different canonical k-mers over all sequences."""
    if approximate:
        return exploded(df, sequence, k, "C").agg(F.approx_count_distinct("kmer").alias("n"))
    return counts(df, sequence, k, "C").agg(F.count("*").alias("n"))  # each k-mer is one row


def save(table: DataFrame, path: str, text: bool = False) -> None:
    """As a columnar table, or as kmer<tab>count text."""
    if text:
        table.select("kmer", "n").write.mode("overwrite").csv(path, sep="\t")
    else:
        table.repartition("kmer").sortWithinPartitions("kmer").write.mode("overwrite").parquet(path)
