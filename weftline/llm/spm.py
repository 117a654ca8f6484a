"""SentencePiece encoding and decoding over a relational lattice.

A text is cut where no piece reaches over: before each mark that stands for a space, and between two characters that no piece
has next to each other.  What lies between two cuts is a unit.  Every different unit is encoded once, by the relational
lattice:

1. its substrings of bounded length are exploded and equi-joined to the piece table;
2. the edges of the lattice are grouped by unit;
3. a higher-order fold over the edges, in the order of their ends, keeps the best path to each place (Viterbi).  It looks back
   over as many places as the longest piece has, and carries the paths' ids packed.
4. A unit of over WINDOW characters is first cut into windows of so many ends, each with as much text before it as a piece can
   reach back.  Windows are exploded and joined like units; one fold goes over a unit's windows in order, keeps the last piece
   to each place, and a second one reads the path from the end.  So a substring's row carries a window, not the unit.

No text is shuffled.  A text's rows are known by their file and their number in it; units are handed on with the number of
their block of ROWS rows, once for each block and unit.  The ids come back in the shared folder, blocks dealt over as many
buckets as a shuffle has partitions; a bucket's rows are in the order of their blocks, and its row groups tell which blocks
they hold.  The task that streams a block's texts reads the row groups of its block, and looks units up.  A block's table
holds the different units of ROWS texts.  Rows that do not come straight from Parquet files are written there first.

The path with the greatest sum of the table's scores is taken (of equal ones, where they part, the longest last piece), which
is how a unigram model reads a piece table.  A model of merges may cut a word otherwise; ids decode to the same text.
A character that is no piece becomes its bytes.

Defined cases: a null text has null ids and decodes to null; an empty text has no ids; a mark in the text reads as a space, as
the format has it.  Repeated rows, null ids of rows and very long texts and units are encoded like any other; an empty table
gives no rows.  Columns of the rows that are named like a new one give way to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
import pyarrow.parquet
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from weftline.llm import pieces as table
from weftline.llm.shared import new_dir, written

#: Texts whose units share a table.
ROWS = 8192
#: Different units that a task collects before it hands them on, words that it cuts at a time, and characters that it encodes
#: at a time.
COLLECTED, AT_ONCE, CHARS = 400_000, 50_000, 1 << 18
#: Characters of the longest unit that is exploded whole, and of a window of a longer one.
WINDOW = 128
#: Characters of a piece's head: a start whose head begins no piece has shorter pieces only.
HEAD = 4
#: Times as many partitions as a shuffle has for the units: a task sorts the edges of all its units in memory, twice, and 25 MB
#: of shuffled units have 4 GB of rows there.
SPREAD = 4
#: Bytes of a row group of the blocks' tables, before compression.
ROW_GROUP = 8 << 20


class Cutter:
    """Cuts texts into units."""

    def __init__(self, pairs: frozenset[tuple[str, str]]) -> None:
        letters = sorted({c for pair in pairs for c in pair})
        number = {c: k for k, c in enumerate(letters, 1)}  # 0: a character that no piece has beside another
        self.number = np.zeros(0x110000, np.uint16)
        self.number[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.beside = np.zeros((len(letters) + 1,) * 2, bool)
        for a, b in pairs:
            self.beside[number[a], number[b]] = True

    def cut(self, texts: list[str]) -> tuple[list[str], list[int]]:
        """The units of all texts in order, and where those of each begin (and the end of the last).  Marks stand for spaces."""
        marked = [table.MARK + t.replace(" ", table.MARK) if t else "" for t in texts]
        text = "".join(marked)
        raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = self.number[raw]
        heads = raw == ord(table.MARK)  # each text begins with one
        heads[1:] |= ~self.beside[codes[:-1], codes[1:]]
        at = np.flatnonzero(heads)
        begins, ends = at.tolist(), np.append(at[1:], len(text)).tolist()
        first = np.cumsum([0, *map(len, marked)])
        return [text[a:b] for a, b in zip(begins, ends, strict=False)], np.searchsorted(at, first).tolist()


def words(text: str) -> list[str]:
    """What stands between the spaces of a text; each follows a mark."""
    return text.replace(table.MARK, " ").split(" ") if text else []


def piece_table(spark: SparkSession, model: table.Pieces) -> DataFrame:
    """(piece, code, score), as large as the vocabulary; code is the id in bytes."""
    code = [model.code.type(i).tobytes() for i, _ in model.ids.values()]
    return spark.createDataFrame(pa.table({"piece": list(model.ids), "code": pa.array(code, pa.binary()), "score": [s for _, s in model.ids.values()]}))


def head_table(spark: SparkSession, model: table.Pieces) -> DataFrame:
    """(head, most): the first HEAD characters of pieces, and the length of the longest piece that begins with them."""
    most: dict[str, int] = {}
    for piece in model.ids:
        if len(piece) >= HEAD:
            most[piece[:HEAD]] = max(most.get(piece[:HEAD], 0), len(piece))
    return spark.createDataFrame(pa.table({"head": pa.array(list(most), pa.string()), "most": pa.array(list(most.values()), pa.int32())}))


def lattice(found: DataFrame, model: table.Pieces, most_chars: int | None = None) -> DataFrame:
    """found (unit and other columns) with edges: the pieces of each unit, of those up to most_chars, in the order of their
    ends, then starts.  Rows stay where unit put them: substrings join a broadcast table, and their group is the unit again."""
    unit, own = F.col("unit"), found.columns
    places = F.sequence(F.lit(1), F.length(unit))
    # what is too long explodes to nothing here; a filter would be pushed below the units' exchange and make another one of it
    starts = found.select(*own, F.length(unit).alias("n"), F.explode(places if most_chars is None else F.when(F.length(unit) <= most_chars, places)).alias("at"))
    # the longest piece that begins as a start does: most starts need a few substrings
    ahead = starts.withColumn("head", F.substring(unit, F.col("at"), F.lit(HEAD))).join(F.broadcast(head_table(found.sparkSession, model)), "head", "left")
    most = F.least(F.coalesce("most", F.lit(HEAD - 1)), F.col("n") - F.col("at") + 1)
    sizes = ahead.select(*own, "at", F.explode(F.sequence(F.lit(1), most)).alias("size"))
    parts = sizes.select(*own, (F.col("at") - 1).alias("start"), (F.col("at") + F.col("size") - 1).alias("end"), F.substring(unit, F.col("at"), F.col("size")).alias("piece"))
    met = parts.join(F.broadcast(piece_table(found.sparkSession, model)), "piece", "left").where("code is not null or end = start + 1")
    codes = F.array(*[F.lit(bytearray(model.code.type(i).tobytes())) for i in model.bytes])
    letters = F.hex(F.encode("piece", "UTF-8"))
    as_bytes = F.aggregate(F.sequence(F.lit(1), F.length(letters), F.lit(2)), F.lit(bytearray()), lambda a, k: F.concat(a, F.get(codes, F.conv(F.substring(letters, k, F.lit(2)), 16, 10).cast("int"))))
    edge = F.struct("end", "start", F.coalesce("score", F.lit(model.unknown)).alias("score"), F.when(F.col("code").isNotNull(), F.col("code")).otherwise(as_bytes).alias("code"))
    return met.select(*own, edge.alias("edge")).groupBy(*own).agg(F.sort_array(F.collect_list("edge")).alias("edges"))


def best_paths(lattices: DataFrame, model: table.Pieces) -> DataFrame:
    """The lattices with the ids of the best path through each in place of its edges, packed."""

    def step(a: Column, x: Column) -> Column:
        # a: the place that edges end at now, its best path so far, and the best paths of the places before
        further, back = x["end"] > a["end"], x["start"] - a["end"]
        path = lambda c: F.when(back == 0, a[c]).otherwise(F.element_at(a["before"], back)[c])
        score = path("score") + x["score"]
        ahead = F.concat(a["before"], F.array(F.struct(a["score"].alias("score"), a["ids"].alias("ids"))))
        before = F.when(further, F.slice(ahead, F.greatest(F.size(a["before"]) + 2 - model.longest, F.lit(1)), model.longest)).otherwise(a["before"])
        better = F.struct(x["end"].alias("end"), score.alias("score"), F.concat(path("ids"), x["code"]).alias("ids"), before.alias("before"))
        return F.when(further | (score > a["score"]), better).otherwise(a)

    none = F.expr("cast(array() as array<struct<score:double,ids:binary>>)")
    first = F.struct(F.lit(0).alias("end"), F.lit(0.0).alias("score"), F.lit(bytearray()).alias("ids"), none.alias("before"))
    return lattices.select(*[c for c in lattices.columns if c != "edges"], F.aggregate("edges", first, step, lambda a: a["ids"]).alias("ids"))


def windows(long: DataFrame, model: table.Pieces, size: int = WINDOW) -> DataFrame:
    """(key, first, w, skip, unit): the windows of the different units of long (block, unit), as units of their own.  Window w
    holds the ends from w * size + 1 to (w + 1) * size, after skip characters that pieces with these ends can begin in."""
    before = model.longest - 1
    each = long.groupBy(F.sha2("unit", 256).alias("key")).agg(F.min("block").alias("first"), F.first("unit").alias("whole"))

    def cut(w: Column) -> Column:
        skip = F.least(w * size, F.lit(before))
        return F.struct(w.alias("w"), skip.alias("skip"), F.substring(F.col("whole"), w * size - skip + 1, skip + size).alias("unit"))

    last = F.floor((F.length("whole") - 1) / size).cast("int")
    return each.select("key", "first", F.inline(F.transform(F.sequence(F.lit(0), last), cut)))


def best_long_paths(lattices: DataFrame, longest: int, size: int = WINDOW) -> DataFrame:
    """(key, first, ids) of the lattices of windows, as best_paths gives them.

    A fold over windows holds a fold over the edges of each: a list that grows step by step has a window's length at most, and
    one entry for each window is added to the list that has the unit's.
    """
    shift = F.col("w") * size - F.col("skip")
    own = F.transform(F.filter("edges", lambda x: x["end"] > F.col("skip")), lambda x: x.withField("end", x["end"] + shift).withField("start", x["start"] + shift))
    met = lattices.select("key", "first", "w", own.alias("edges")).groupBy("key", "first").agg(F.sort_array(F.collect_list(F.struct("w", "edges"))).alias("windows"))

    def step(a: Column, x: Column) -> Column:
        # a: the place that edges end at now, with the score and last piece of its best path; scores and pieces of those before
        further, back = x["end"] > a["end"], x["start"] - a["end"]
        score = F.when(back == 0, a["score"]).otherwise(F.element_at(a["before"], back)) + x["score"]
        scores = F.concat(a["before"], F.array(a["score"]))
        before = F.when(further, F.slice(scores, F.greatest(F.size(scores) - longest, F.lit(0)) + 1, longest)).otherwise(a["before"])
        done = F.when(further, F.concat(a["done"], F.array(F.struct(a["size"].alias("size"), a["code"].alias("code"))))).otherwise(a["done"])
        better = F.struct(x["end"].alias("end"), score.alias("score"), (x["end"] - x["start"]).alias("size"), x["code"].alias("code"), before.alias("before"), done.alias("done"))
        return F.when(further | (score > a["score"]), better).otherwise(a)

    def back(a: Column, x: Column) -> Column:
        # a: places to pass by before the next one on the path, and the ids after them
        return F.when(a["pass"] > 0, F.struct((a["pass"] - 1).alias("pass"), a["ids"].alias("ids"))).otherwise(F.struct((x["size"] - 1).alias("pass"), F.concat(x["code"], a["ids"]).alias("ids")))

    empty, nothing = F.lit(bytearray()), F.expr("cast(array() as array<struct<size:int,code:binary>>)")
    none = F.struct(F.lit(0).alias("end"), F.lit(0.0).alias("score"), F.lit(0).alias("size"), empty.alias("code"), F.expr("cast(array() as array<double>)").alias("before"), nothing.alias("done"))
    # each fold is named once, as an expression that is named twice runs twice; what it leaves is taken up at the next window
    forward = F.aggregate(
        "windows",
        F.struct(none.alias("at"), F.expr("cast(array() as array<array<struct<size:int,code:binary>>>)").alias("done")),
        lambda a, x: F.struct(F.aggregate(x["edges"], a["at"].withField("done", nothing), step).alias("at"), F.concat(a["done"], F.array(a["at"]["done"])).alias("done")),
        lambda a: F.concat(a["done"], F.array(a["at"]["done"], F.array(F.struct(a["at"]["size"].alias("size"), a["at"]["code"].alias("code"))))),
    )
    path = F.aggregate(
        F.reverse("places"),
        F.struct(F.struct(F.lit(0).alias("pass"), empty.alias("ids")).alias("at"), F.expr("cast(array() as array<binary>)").alias("ids")),
        lambda a, x: F.struct(F.aggregate(F.reverse(x), a["at"].withField("ids", empty), back).alias("at"), F.concat(a["ids"], F.array(a["at"]["ids"])).alias("ids")),
        lambda a: F.concat(a["ids"], F.array(a["at"]["ids"])),
    )
    found = met.select("key", "first", forward.alias("places")).select("key", "first", path.alias("parts"))
    return found.select("key", "first", F.aggregate(F.reverse("parts"), empty, lambda a, x: F.concat(a, x)).alias("ids"))


def _with_blocks(docs: DataFrame) -> tuple[DataFrame, Column, Column]:
    """docs, and a row's file and number in it; docs is written first if it does not come straight from Parquet files."""
    place = lambda d: (d.metadataColumn("_metadata")["file_path"], d.metadataColumn("_metadata")["row_index"])
    try:
        docs.select(*place(docs))
    except AnalysisException:
        docs = written(docs, "texts")
    return docs, *place(docs)


def encoded_units(texts: DataFrame, model: table.Pieces) -> tuple[str, int]:
    """The folder of the blocks' tables (block, unit, ids), and its number of buckets.  texts: (block, text)."""
    pairs = model.pairs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, last = Cutter(pairs), None
        seen: set[str] = set()  # words that are not cut yet
        own: set[str] = set()

        def cut() -> None:
            found = list(seen)
            seen.clear()
            for at in range(0, len(found), AT_ONCE):
                own.update(cutter.cut([" ".join(found[at : at + AT_ONCE]) or " "])[0])  # an empty word alone is a mark

        def flushed() -> pa.RecordBatch:
            cut()
            out = pa.RecordBatch.from_arrays([pa.array(np.full(len(own), last), pa.int64()), pa.array(list(own), pa.string())], names=["block", "unit"])
            own.clear()
            return out

        for batch in batches:
            for block, t in zip(batch.column("block").to_pylist(), batch.column("text"), strict=True):
                if block != last or len(own) > COLLECTED:
                    if seen or own:
                        yield flushed()
                    last = block
                seen.update(words(t.as_py() or ""))
                if len(seen) > AT_ONCE:
                    cut()
        if seen or own:
            yield flushed()

    # dealt by unit once: the different units, the group of the lattice and the join need no further exchange.  Both sides of the
    # join read the same columns and rows (so the first block goes with a unit), and so the same exchange.  The number is given,
    # as partitions would be put together by the size of units, not of their edges
    buckets = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = texts.mapInArrow(run, "block long, unit string").where("block is not null and unit is not null").repartition(SPREAD * buckets, "unit")
    ids = best_paths(lattice(found.groupBy("unit").agg(F.min("block").alias("first")), model, WINDOW), model).withColumnRenamed("unit", "of")
    short = found.join(ids.hint("shuffle_hash"), (F.col("unit") == F.col("of")) & (F.col("block") >= F.col("first"))).select("block", "unit", "ids")
    long = found.select("block", F.explode(F.when(F.length("unit") > WINDOW, F.array("unit"))).alias("unit"))
    paths = best_long_paths(lattice(windows(long, model), model), model.longest)
    met = short.unionByName(long.join(paths, (F.sha2("unit", 256) == F.col("key")) & (F.col("block") >= F.col("first"))).select("block", "unit", "ids"))
    folder = new_dir(texts.sparkSession, "blocks")
    dealt = met.withColumn("bucket", F.pmod("block", F.lit(buckets))).repartition("bucket").sortWithinPartitions("bucket", "block")
    dealt.write.mode("append").option("compression", "zstd").option("parquet.block.size", ROW_GROUP).partitionBy("bucket").parquet(folder)
    return folder, buckets


def block_table(fs: pa.fs.FileSystem, bucket: str, block: int) -> dict[str, bytes]:
    """The ids of the units of a block, from the folder of its bucket.  Row groups are read a part at a time."""
    out: dict[str, bytes] = {}
    if fs.get_file_info(bucket).type == pa.fs.FileType.NotFound:
        return out  # no block of it has a word
    for f in fs.get_file_info(pa.fs.FileSelector(bucket)):
        if f.path.endswith(".parquet"):
            with fs.open_input_file(f.path) as source:
                file = pa.parquet.ParquetFile(source)
                of = file.schema_arrow.names.index("block")
                spans = [file.metadata.row_group(k).column(of).statistics for k in range(file.num_row_groups)]
                held = [k for k, x in enumerate(spans) if x is None or not x.has_min_max or x.min <= block <= x.max]
                for part in file.iter_batches(1 << 14, row_groups=held, columns=["block", "unit", "ids"], use_threads=False):
                    own = part.filter(pa.compute.equal(part.column("block"), block))
                    out.update(zip(own.column("unit").to_pylist(), own.column("ids").to_pylist(), strict=True))
    pa.default_memory_pool().release_unused()
    return out


def encode(docs: DataFrame, text: str = "text", out: str = "ids", keep: list[str] | None = None, model_path: str = table.DEFAULT_MODEL, checked: bool = False) -> DataFrame:
    """The kept columns (all by default) of every row with its ids; checked adds intact, whether they decode to the text
    (where a mark reads as a space; null for null).

    Ids stay packed bytes until they are a column, so a task holds its block's table and a few texts.
    """
    model = table.load(model_path)
    names = [c for c in keep or docs.columns if c != out and not (checked and c == "intact")]
    docs, file, number = _with_blocks(docs)
    block = F.xxhash64(file, F.floor(number / ROWS)).alias("block")  # equal numbers of two blocks only join their tables
    whole = F.col(f"`{text}`").cast("string").alias("text")
    folder, buckets = encoded_units(docs.select(block, whole), model)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # as large as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        back, cutter, last, known = Spellings(model), Cutter(model.pairs), None, {}
        fs, root = pa.fs.FileSystem.from_uri(folder)

        def encoded(texts: list[str | None]) -> list[bytes | None]:
            units, first = cutter.cut([t or "" for t in texts])
            ids = list(map(known.__getitem__, units))
            return [None if t is None else b"".join(ids[a:b]) for t, a, b in zip(texts, first, first[1:], strict=False)]

        def taken(row: pa.Array, rows: list[int], texts: list[str | None]) -> pa.RecordBatch:
            ids = encoded(texts)
            sizes = [len(x or b"") // model.code.itemsize for x in ids]
            offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(x or b"" for x in ids), model.code).astype(np.int32))
            lists = pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array([x is None for x in ids], pa.bool_()))
            same = [None if t is None or not checked else back.spelled(np.frombuffer(x, model.code)) == t.replace(table.MARK, " ") for t, x in zip(texts, ids, strict=True)]
            return pa.RecordBatch.from_arrays([row.take(pa.array(rows, pa.int64())), lists, pa.array(same, pa.bool_())], names=["row", "ids", "intact"])

        for batch in batches:
            rows: list[int] = []
            texts: list[str | None] = []
            size = 0
            given = batch.column("text") if place is None else batch.column("row").field(place)
            for k, (block, t) in enumerate(zip(batch.column("block").to_pylist(), given, strict=True)):
                if block != last or size > CHARS:
                    if rows:
                        yield taken(batch.column("row"), rows, texts)
                        rows, texts, size = [], [], 0
                    if block != last:
                        known = {}  # not two tables at once
                        last, known = block, block_table(fs, f"{root}/bucket={block % buckets}", block)
                t = t.as_py()
                rows.append(k)
                texts.append(t)
                size += len(t or "")
            yield taken(batch.column("row"), rows, texts)

    # a text that is kept goes to Python once, in its row
    place = 1 + names.index(text) if text in names and docs.schema[text].dataType == StringType() else None
    source = docs.select(F.struct(F.lit(1).alias("_"), *[F.col(f"`{c}`") for c in names]).alias("row"), *([whole] if place is None else []), block)
    done = source.mapInArrow(run, f"row {source.schema['row'].dataType.simpleString()}, ids array<int>, intact boolean")
    return done.select(*[F.col("row").getField(c).alias(c) for c in names], F.col("ids").alias(out), *(["intact"] if checked else []))


class Spellings:
    """The bytes of each id, one after the other, and where each begins."""

    def __init__(self, model: table.Pieces) -> None:
        names = {i: p.replace(table.MARK, " ").encode() for p, (i, _) in model.ids.items()} | {i: bytes([b]) for b, i in enumerate(model.bytes)}
        each = [names.get(i, b"") for i in range(max(names) + 1)]
        self.letters, self.sizes = np.frombuffer(b"".join(each), np.uint8), np.array([len(x) for x in each])
        self.begins = np.cumsum(self.sizes) - self.sizes

    def spelled(self, ids: np.ndarray) -> str:
        """The text of ids, without the space that the first mark stands for."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.begins[ids] - (ends - sizes), sizes)
        return self.letters[at].tobytes().decode("utf-8", "replace").removeprefix(" ")


def decode(encoded: DataFrame, ids: str = "ids", out: str = "text", model_path: str = table.DEFAULT_MODEL) -> DataFrame:
    """encoded with the text of its ids."""
    sent = encoded.sparkSession.sparkContext.broadcast(Spellings(table.load(model_path)))  # as large as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [sent.value.spelled(np.array(x.as_py(), np.int64)) if x.is_valid else None for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "decoded"])

    kept = [c for c in encoded.columns if c not in (ids, out)]
    source = encoded.select(F.struct(F.lit(1).alias("_"), *[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{ids}`").alias("ids"))
    done = source.mapInArrow(run, f"row {source.schema['row'].dataType.simpleString()}, decoded string")
    return done.select(*[F.col("row").getField(c).alias(c) for c in kept], F.col("decoded").alias(out))
