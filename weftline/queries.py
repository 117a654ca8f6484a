"""The registered queries over the driver's tables and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import histogram, intervals, joins, kmers, sets
from weftline.plans.select import known_columns, query
from weftline.sources import readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def registered(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- select, where, order -------------------------------------------------------------------------------------------------


@registered("SELECT l_returnflag, count(*) AS tally FROM lineitem WHERE 10 < l_quantity AND l_quantity < 20 GROUP BY l_returnflag ORDER BY tally DESC")
def select_where_order(spark, d):
    return query(table(spark, d, "lineitem"), "l_returnflag, count(*) as tally", "10 < l_quantity < 20", "tally desc")


@registered("SELECT l_orderkey, l_quantity * 2 AS twice FROM lineitem WHERE l_returnflag = 'R' OR l_linestatus = 'O'")
def project_filter(spark, d):
    return query(table(spark, d, "lineitem"), "l_orderkey, l_quantity * 2 as twice", "l_returnflag == 'R' or l_linestatus = 'O'")


@registered("SELECT c_custkey, c_name FROM customer")
def known_columns_only(spark, d):
    return known_columns(table(spark, d, "customer"), "c_custkey, no_such, c_name")


@registered("SELECT o_orderstatus, max(o_totalprice) AS top, max(o_orderkey) AS last, count(*) AS n FROM orders GROUP BY o_orderstatus")
def group_multi_agg(spark, d):
    return query(table(spark, d, "orders"), "o_orderstatus, max(o_totalprice) as top, max(o_orderkey) as last, count(*) as n")


@registered("SELECT DISTINCT l_suppkey FROM lineitem")
def distinct_keys(spark, d):
    return table(spark, d, "lineitem").select("l_suppkey").distinct()


@registered("SELECT count(*) AS hits FROM lineitem WHERE l_quantity > 25 AND l_discount < 0.05")
def mask_count(spark, d):
    return query(table(spark, d, "lineitem"), "count(*) as hits", "l_quantity > 25 and l_discount < 0.05")


@registered("SELECT CASE WHEN l_returnflag = 'A' THEN '+' ELSE '-' END AS side, count(*) AS n FROM lineitem GROUP BY 1")
def strand_split(spark, d):
    strand = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", -1).otherwise(0)
    return table(spark, d, "lineitem").groupBy(intervals.strand_side(strand).alias("side")).agg(F.count("*").alias("n"))


@registered("SELECT s_nationkey AS k, s_acctbal AS b FROM supplier UNION ALL SELECT c_nationkey, c_acctbal FROM customer")
def bag_union(spark, d):
    one = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_acctbal").alias("b"))
    return one.unionByName(table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("b")))


_NUMBERS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


@registered(" UNION ALL ".join(f"SELECT '{c}' AS name, min({c})::DOUBLE + 0.0::DOUBLE AS least, max({c})::DOUBLE + 0.0::DOUBLE AS greatest FROM lineitem" for c in _NUMBERS))
def column_ranges(spark, d):
    return histogram.column_ranges(table(spark, d, "lineitem"))


@registered("SELECT event_type AS key, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT 'never', 0")
def string_frequencies(spark, d):
    seen = table(spark, d, "events").select(F.col("event_type").alias("key"))
    wanted = seen.distinct().union(spark.sql("SELECT 'never' AS key"))
    return histogram.frequencies(seen, "key", wanted)


# --- joins ----------------------------------------------------------------------------------------------------------------


@registered("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 10 AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def semi_join(spark, d):
    return joins.semi_join(table(spark, d, "orders"), table(spark, d, "lineitem"), "o_orderkey", "l_orderkey, l_linenumber, l_quantity", "l_orderkey", "o_orderpriority = '1-URGENT'", "l_quantity > 10")


@registered(
    """SELECT l_partkey, count(*) AS tally FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 1000
       AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) GROUP BY l_partkey"""
)
def semi_chain_count(spark, d):
    steps = [(table(spark, d, "customer"), "c_acctbal > 0", None, "c_custkey"), (table(spark, d, "orders"), "o_totalprice > 1000", "o_custkey", "o_orderkey"), (table(spark, d, "lineitem"), None, "l_orderkey", "l_partkey")]
    return joins.semi_chain_count(steps, "l_partkey")


@registered(
    """SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(quality, 0) AS quality
       FROM documents d FULL OUTER JOIN labels l ON d.doc_id = l.doc_id"""
)
def kv_upsert(spark, d):
    return joins.upsert_column(table(spark, d, "documents").select("doc_id", "lang", "source"), table(spark, d, "labels"), "doc_id", "quality")


@registered("SELECT o_custkey AS k, max(o_orderkey) AS v FROM orders WHERE o_custkey <> 0 AND o_orderkey <> 0 GROUP BY 1")
def kv_load(spark, d):
    return joins.load_key_values(table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v")), "k", "v", "v")


@registered("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def lookup_joins(spark, d):
    nations = table(spark, d, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    regions = table(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return joins.lookup(joins.lookup(table(spark, d, "customer"), nations, "c_nationkey"), regions, "n_regionkey").select("c_custkey", "n_name", "r_name")


def _edges(spark, d) -> DataFrame:
    """The tree of regions, nations and customers; the root is its own parent."""
    edge = lambda name, child, parent: table(spark, d, name).select(child.alias("child"), parent.alias("parent"))
    key = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    root = spark.sql("SELECT 'all' AS child, 'all' AS parent")
    return root.union(edge("region", key("r", "r_regionkey"), F.lit("all"))).union(edge("nation", key("n", "n_nationkey"), key("r", "n_regionkey"))).union(edge("customer", key("c", "c_custkey"), key("n", "c_nationkey")))


@registered(
    """SELECT 'all' AS node, 0 AS depth, 'all' AS path UNION ALL SELECT 'r' || r_regionkey, 1, 'all/r' || r_regionkey FROM region
       UNION ALL SELECT 'n' || n_nationkey, 2, 'all/r' || n_regionkey || '/n' || n_nationkey FROM nation
       UNION ALL SELECT 'c' || c_custkey, 3, 'all/r' || n_regionkey || '/n' || n_nationkey || '/c' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey"""
)
def tree_path(spark, d):
    return joins.tree_paths(_edges(spark, d), "all")


@registered(
    """SELECT node, array_to_string(list_sort(list(child)), ',') AS children FROM (SELECT 'all' AS node, 'r' || r_regionkey AS child FROM region
       UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer) GROUP BY node"""
)
def tree_children(spark, d):
    return joins.tree_children(_edges(spark, d)).select("node", F.array_join("children", ",").alias("children"))


# --- intervals ------------------------------------------------------------------------------------------------------------


def _spans(spark, d, flag: str, plus: str, minus: str) -> DataFrame:
    strand = F.when(F.col(flag) == plus, 1).when(F.col(flag) == minus, -1).otherwise(0)
    return table(spark, d, "lineitem").select(F.col("l_linenumber").alias("chr"), F.col("l_orderkey").alias("start"), (F.col("l_orderkey") + F.col("l_quantity").cast("long")).alias("end"), strand.alias("strand"))


def _overlaps(spark, d, window: intervals.Window) -> DataFrame:
    a, b = _spans(spark, d, "l_returnflag", "A", "R"), _spans(spark, d, "l_linestatus", "O", "F")
    pairs = intervals.overlap_join(a, b, window, strand="strand")
    return pairs.groupBy("start", "end").agg(F.count("*").alias("n"))


def _overlap_sql(left: int, right: int, flip: str, same: str, coordinates: str) -> str:
    return f"""
WITH a AS (SELECT l_linenumber AS chr, l_orderkey AS s, l_orderkey + l_quantity::BIGINT AS e, CASE l_returnflag WHEN 'A' THEN '+' ELSE '-' END AS strand FROM lineitem),
w AS (SELECT *, {flip} AS flip FROM a),
x AS (SELECT chr, strand, flip, s - CASE WHEN flip THEN {right} ELSE {left} END AS lo, e + CASE WHEN flip THEN {left} ELSE {right} END AS hi FROM w),
b AS (SELECT l_linenumber AS chr, l_orderkey AS bs, l_orderkey + l_quantity::BIGINT AS be, CASE l_linestatus WHEN 'O' THEN '+' ELSE '-' END AS strand FROM lineitem),
p AS (SELECT lo, hi, hi - lo AS wide, flip, CASE WHEN flip THEN hi - be ELSE bs - lo END AS rs, CASE WHEN flip THEN hi - bs ELSE be - lo END AS re
      FROM x JOIN b ON x.chr = b.chr AND be >= lo AND bs <= hi {same})
SELECT {coordinates} FROM p GROUP BY 1, 2"""


def _plain(left: int) -> str:
    return f"(rs - {left})::BIGINT AS start, (re - {left})::BIGINT AS \"end\", count(*) AS n"


def _quantised(left: int, bins: int) -> str:
    cut = lambda x: f"trunc(({x})::DOUBLE / greatest(wide, 1))::BIGINT"
    low = f"CASE WHEN rs <= 0 THEN 0 ELSE {cut(f'{bins} * rs')} END"
    high = f"CASE WHEN re >= wide THEN wide - 1 ELSE {cut(f'{bins} * re')} END"
    out = lambda x: f"trunc((wide * ({x} - {cut(f'{bins} * {left}')}))::DOUBLE / {bins})::BIGINT"
    return f"{out(low)} AS start, {out(high)} AS \"end\", count(*) AS n"


@registered(_overlap_sql(10, 10, "false", "", _plain(10)))
def interval_join(spark, d):
    return _overlaps(spark, d, intervals.Window(10, 10))


@registered(_overlap_sql(10, 10, "false", "AND x.strand = b.strand", _plain(10)))
def interval_join_same_strand(spark, d):
    return _overlaps(spark, d, intervals.Window(10, 10, same_strand=True))


@registered(_overlap_sql(20, 5, "strand = '-'", "AND x.strand = b.strand", _plain(20)))
def interval_join_stranded_window(spark, d):
    return _overlaps(spark, d, intervals.Window(20, 5, same_strand=True, stranded=True))


@registered(_overlap_sql(10, 10, "false", "", _quantised(10, 5)))
def interval_join_binned(spark, d):
    return _overlaps(spark, d, intervals.Window(10, 10, bins=5))


@registered(_overlap_sql(20, 5, "strand = '-'", "", _quantised(20, 5)))
def interval_join_flipped_binned(spark, d):
    return _overlaps(spark, d, intervals.Window(20, 5, stranded=True, bins=5))


# --- histograms -----------------------------------------------------------------------------------------------------------


@registered(
    """SELECT b.bin, 0.0 + b.bin * 5.0::DOUBLE AS bound, coalesce(n, 0) AS n FROM (SELECT unnest(range(13)) AS bin) b
       LEFT JOIN (SELECT floor((l_quantity - 0) / 5.0::DOUBLE)::BIGINT AS bin, count(*) AS n FROM lineitem GROUP BY 1) h ON b.bin = h.bin"""
)
def hist1d_uniform(spark, d):
    return histogram.uniform_1d(query(table(spark, d, "lineitem"), "l_quantity"), "l_quantity", 0.0, 60.0, 5.0)


@registered("SELECT bin, min(l_extendedprice) AS lower, count(*) AS n FROM (SELECT l_extendedprice, ntile(25) OVER (ORDER BY l_extendedprice, l_orderkey, l_linenumber) AS bin FROM lineitem) GROUP BY bin")
def hist1d_adaptive(spark, d):
    return histogram.adaptive_1d(table(spark, d, "lineitem"), "l_extendedprice", 25, ["l_orderkey", "l_linenumber"])


@registered(
    """SELECT b.i AS bin1, c.j AS bin2, b.i * 10.0::DOUBLE AS bound1, c.j * 20000.0::DOUBLE AS bound2, coalesce(n, 0) AS n
       FROM (SELECT unnest(range(6)) AS i) b CROSS JOIN (SELECT unnest(range(6)) AS j) c
       LEFT JOIN (SELECT floor(l_quantity / 10.0::DOUBLE)::BIGINT AS i, floor(l_extendedprice / 20000.0::DOUBLE)::BIGINT AS j, count(*) AS n FROM lineitem GROUP BY 1, 2) h ON b.i = h.i AND c.j = h.j"""
)
def hist2d_uniform(spark, d):
    return histogram.uniform_2d(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", 0.0, 50.0, 10.0, 0.0, 100000.0, 20000.0)


@registered(
    """WITH p AS (SELECT l_quantity AS x, l_extendedprice AS y, ntile(10) OVER (ORDER BY l_quantity, l_orderkey, l_linenumber) AS bin1,
                  ntile(10) OVER (ORDER BY l_extendedprice, l_orderkey, l_linenumber) AS bin2 FROM lineitem),
       a AS (SELECT bin1, min(x) AS lower1, max(x) AS upper1 FROM p GROUP BY 1), b AS (SELECT bin2, min(y) AS lower2, max(y) AS upper2 FROM p GROUP BY 1),
       c AS (SELECT bin1, bin2, count(*) AS n FROM p GROUP BY 1, 2)
       SELECT c.bin1, c.bin2, lower1, upper1, lower2, upper2, n FROM c JOIN a ON a.bin1 = c.bin1 JOIN b ON b.bin2 = c.bin2"""
)
def hist2d_adaptive(spark, d):
    return histogram.adaptive_2d(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", 10, 10, ["l_orderkey", "l_linenumber"])


@registered(
    """WITH m AS (SELECT min(l_quantity) AS bx, min(l_extendedprice) AS by_, nextafter((max(l_quantity) - min(l_quantity)) / 25, 'infinity'::DOUBLE) AS sx,
                  nextafter((max(l_extendedprice) - min(l_extendedprice)) / 25, 'infinity'::DOUBLE) AS sy FROM lineitem),
       c AS (SELECT floor((l_quantity - bx) / sx) AS i, floor((l_extendedprice - by_) / sy) AS j, bx, by_, sx, sy, count(*) AS n FROM lineitem CROSS JOIN m GROUP BY ALL)
       SELECT bx + (i + 0.5::DOUBLE) * sx AS center1, by_ + (j + 0.5::DOUBLE) * sy AS center2, n FROM c"""
)
def scatter_centers(spark, d):
    return histogram.scatter(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice")


# --- sets -----------------------------------------------------------------------------------------------------------------

_A = "SELECT DISTINCT l_orderkey AS pos FROM lineitem WHERE l_returnflag = 'R'"
_B = "SELECT DISTINCT l_orderkey AS pos FROM lineitem WHERE l_linestatus = 'O'"


def _set(spark, d, where: str) -> DataFrame:
    return query(table(spark, d, "lineitem"), "l_orderkey as pos", where).distinct()


def _ab(spark, d) -> tuple[DataFrame, DataFrame]:
    return _set(spark, d, "l_returnflag = 'R'"), _set(spark, d, "l_linestatus = 'O'")


@registered(f"({_A}) INTERSECT ({_B})")
def bv_and(spark, d):
    return sets.intersect(*_ab(spark, d))


@registered(f"({_A}) UNION ({_B})")
def bv_or(spark, d):
    return sets.union(*_ab(spark, d))


@registered(f"(({_A}) UNION ({_B})) EXCEPT (({_A}) INTERSECT ({_B}))")
def bv_xor(spark, d):
    return sets.exclusive(*_ab(spark, d))


@registered(f"SELECT range AS pos FROM range((SELECT max(l_orderkey) + 1 FROM lineitem)) EXCEPT ({_A})")
def bv_not(spark, d):
    size = table(spark, d, "lineitem").agg(F.max("l_orderkey") + 1).first()[0]
    return sets.complement(_set(spark, d, "l_returnflag = 'R'"), size)


@registered("SELECT l_returnflag, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1")
def bv_count(spark, d):
    return sets.cardinality(table(spark, d, "lineitem").select("l_returnflag", F.col("l_orderkey").alias("pos")), ["l_returnflag"])


@registered(f"SELECT count(*) AS n FROM (({_A}) INTERSECT ({_B}))")
def bv_and_count(spark, d):
    return sets.intersect_bitmaps(list(_ab(spark, d))).agg(F.coalesce(F.sum(F.bitmap_count("bitmap")), F.lit(0)).alias("n"))


@registered("SELECT count(DISTINCT l_orderkey) AS n FROM lineitem")
def bv_or_many(spark, d):
    parts = [_set(spark, d, f"l_linenumber = {k}") for k in range(1, 8)]
    return sets.many_union([*parts, _set(spark, d, "l_linenumber > 7 or l_linenumber < 1")]).agg(F.sum(F.bitmap_count("bitmap")).alias("n"))


@registered("SELECT l_returnflag, max(l_orderkey) + 1 AS size FROM lineitem GROUP BY 1")
def bv_size(spark, d):
    return sets.size_of(table(spark, d, "lineitem").select("l_returnflag", F.col("l_orderkey").alias("pos")), ["l_returnflag"]).drop("bytes")


@registered(f"SELECT coalesce(min(pos), (SELECT max(l_orderkey) + 1 FROM lineitem)) AS next FROM ({_A}) WHERE pos > 100")
def bv_next(spark, d):
    size = table(spark, d, "lineitem").agg(F.max("l_orderkey") + 1).first()[0]
    return sets.next_one(_set(spark, d, "l_returnflag = 'R'"), 100, size)


@registered(f"SELECT o_orderkey AS pos, o_orderkey IN ({_A}) AS found FROM orders")
def bv_member(spark, d):
    return sets.members(_set(spark, d, "l_returnflag = 'R'"), table(spark, d, "orders").select(F.col("o_orderkey").alias("pos")))


@registered(f"SELECT min(pos) AS first, max(pos) AS last FROM (SELECT pos, pos - row_number() OVER (ORDER BY pos) AS g FROM ({_A})) GROUP BY g")
def bv_spans(spark, d):
    return sets.spans(_set(spark, d, "l_returnflag = 'R'"), [])


@registered("SELECT l_linenumber, count(DISTINCT p) AS n FROM (SELECT l_linenumber, unnest(range(l_orderkey, l_orderkey + l_quantity::BIGINT)) AS p FROM lineitem) GROUP BY 1")
def bv_from_intervals(spark, d):
    spans = intervals.merged(_spans(spark, d, "l_returnflag", "A", "R"), "chr")
    return spans.groupBy(F.col("chr").alias("l_linenumber")).agg(F.sum(F.col("end") - F.col("start")).alias("n"))


@registered("SELECT l_suppkey, array_to_string(list_sort(list(DISTINCT l_partkey)), ',') AS positions FROM lineitem GROUP BY 1")
def bv_to_set(spark, d):
    found = sets.collected(table(spark, d, "lineitem").select("l_suppkey", F.col("l_partkey").alias("pos")), ["l_suppkey"])
    return found.select("l_suppkey", F.array_join(F.transform("positions", lambda x: x.cast("string")), ",").alias("positions"))


_COUNTS = f"""WITH a AS ({_A}), b AS ({_B}), f AS (SELECT a.pos IS NOT NULL AS x, b.pos IS NOT NULL AS y, coalesce(a.pos, b.pos) AS pos FROM a FULL OUTER JOIN b ON a.pos = b.pos),
  c AS (SELECT count(*) FILTER (x AND y) AS n11, count(*) FILTER (x AND NOT y) AS n10, count(*) FILTER (y AND NOT x) AS n01, max(pos) + 1 AS size FROM f),
  t AS (SELECT n11, n10, n01, size - n11 - n10 - n01 AS n00 FROM c)"""


@registered(
    f"""{_COUNTS} SELECT n11, n10, n01, n00, round((n11::DOUBLE * n00 - n10::DOUBLE * n01)
        / sqrt((n11 + n10)::DOUBLE * (n01 + n00) * (n11 + n01) * (n10 + n00)), 9) AS phi FROM t"""
)
def phi(spark, d):
    return sets.phi(*_ab(spark, d)).withColumn("phi", F.round("phi", 9))


@registered(f"{_COUNTS} SELECT n11, n10, n01, round((n11::DOUBLE * n11 - n10::DOUBLE * n01) / sqrt((n11 + n10)::DOUBLE * (n01 + n11) * (n11 + n01) * (n10 + n11)), 9) AS phi FROM t")
def phi_of_union(spark, d):
    return sets.phi_of_union(*_ab(spark, d)).withColumn("phi", F.round("phi", 9))


@registered(
    """WITH o AS (SELECT DISTINCT l_linenumber AS k, l_orderkey AS p FROM lineitem), u AS (SELECT max(p) + 1 AS n FROM o), c AS (SELECT k, count(*) AS c FROM o GROUP BY k),
       j AS (SELECT x.k AS a, y.k AS b, count(*) AS n11 FROM o x JOIN o y ON x.p = y.p AND x.k < y.k GROUP BY 1, 2),
       p AS (SELECT ca.k AS a, cb.k AS b, coalesce(n11, 0) AS n11, ca.c AS ca, cb.c AS cb FROM c ca JOIN c cb ON ca.k < cb.k LEFT JOIN j ON j.a = ca.k AND j.b = cb.k),
       t AS (SELECT a, b, n11, ca - n11 AS n10, cb - n11 AS n01, u.n - ca - cb + n11 AS n00 FROM p CROSS JOIN u)
       SELECT a, b, n11, round((n11::DOUBLE * n00 - n10::DOUBLE * n01) / nullif(sqrt((n11 + n10)::DOUBLE * (n01 + n00) * (n11 + n01) * (n10 + n00)), 0), 9) AS phi FROM t"""
)
def all_pairs_phi(spark, d):
    found = sets.all_pairs_phi(table(spark, d, "lineitem").select("l_linenumber", F.col("l_orderkey").alias("pos")), "l_linenumber")
    return found.withColumn("phi", F.round("phi", 9))


@registered()
def mc_overlap(spark, d):
    size = table(spark, d, "lineitem").agg(F.max("l_orderkey") + 1).first()[0]
    return sets.permutation_test(*_ab(spark, d), size, times=20)


@registered()
def rand_bv(spark, d):
    """As many random runs as there are orders, below the greatest order key."""
    n, most = table(spark, d, "orders").agg(F.count("*"), F.max("o_orderkey")).first()
    return sets.spans(sets.random_set(spark, n, 10, most * 10), [])


# --- k-mers ---------------------------------------------------------------------------------------------------------------

_K, _LONG = 6, 21


def _kmer_sql(k: int) -> str:
    return f"""WITH s AS (SELECT doc_id, regexp_replace(translate(text, 'acgt', 'ACGT'), '[^CGT]', 'A', 'g') AS s FROM documents WHERE length(text) >= {k}),
  k AS (SELECT doc_id, unnest(list_transform(range(1, length(s) - {k - 2}), lambda i: substr(s, i, {k}))) AS f FROM s),
  c AS (SELECT doc_id, f, translate(reverse(f), 'ACGT', 'TGCA') AS r FROM k),
  n AS (SELECT least(f, r) AS kmer, count(*) AS n FROM c GROUP BY 1)"""


_KMERS = _kmer_sql(_K)


def _counts(spark, d) -> DataFrame:
    return kmers.counts(table(spark, d, "documents"), "text", _K)


@registered(f"{_KMERS} SELECT kmer, n FROM n")
def kmer_counts(spark, d):
    return _counts(spark, d)


@registered(f"{_kmer_sql(_LONG)} SELECT kmer, n FROM n")
def kmer_counts_long(spark, d):
    """k beyond what a task counts whole: super-k-mers."""
    return kmers.counts(table(spark, d, "documents"), "text", _LONG)


@registered(f"{_KMERS} SELECT kmer, count(*) AS n FROM (SELECT f AS kmer FROM c UNION ALL SELECT r FROM c) GROUP BY 1")
def kmer_both(spark, d):
    return kmers.counts(table(spark, d, "documents"), "text", _K, "B")


@registered(f"{_KMERS} SELECT n AS frequency, count(*) AS n_distinct FROM n GROUP BY 1")
def kmer_spectrum(spark, d):
    return kmers.spectrum(_counts(spark, d))


@registered(f"{_KMERS} SELECT kmer, n FROM n WHERE n BETWEEN 10 AND 1000")
def kmer_filter(spark, d):
    return kmers.filtered(_counts(spark, d), 10, 1000)


@registered(f"{_KMERS}, q AS (SELECT unnest(['acgtac', 'GGGGGG', 'TTTTTT']) AS asked), p AS (SELECT asked, translate(asked, 'acgt', 'ACGT') AS u FROM q) SELECT asked, coalesce(n.n, 0) AS n FROM p LEFT JOIN n ON least(u, translate(reverse(u), 'ACGT', 'TGCA')) = kmer")
def kmer_find(spark, d):
    asked = spark.sql("SELECT explode(array('acgtac', 'GGGGGG', 'TTTTTT')) AS asked")
    return kmers.find(_counts(spark, d), asked, "asked")


@registered(f"{_KMERS} SELECT count(*) FILTER (n = 1) AS n FROM (SELECT f, count(*) AS n FROM c GROUP BY 1)")
def kmer_singletons(spark, d):
    return kmers.singletons(kmers.counts(table(spark, d, "documents"), "text", _K, "A"))


@registered(f"{_KMERS} SELECT count(*) AS n FROM n")
def kmer_distinct(spark, d):
    return kmers.distinct_count(table(spark, d, "documents"), "text", _K)


# --- loading --------------------------------------------------------------------------------------------------------------


@registered("SELECT event_type, count(*) AS n, sum(user_id)::BIGINT AS users FROM events GROUP BY 1")
def attr_parse(spark, d):
    """Attribute lists made of the events' columns, in both spellings, parsed back."""
    text = F.concat(F.lit('type "'), F.col("event_type"), F.lit('"; user='), F.col("user_id").cast("string"), F.lit(';note "a; b"'))
    bag = table(spark, d, "events").select(readers.attributes(text).alias("a"))
    return bag.groupBy(F.col("a")["type"][0].alias("event_type")).agg(F.count("*").alias("n"), F.sum(F.col("a")["user"][0].cast("long")).alias("users"))


_KINDS = {"c_custkey": "c_custkey::VARCHAR", "c_nationkey": "c_nationkey::VARCHAR", "c_name": "c_name", "c_mktsegment": "c_mktsegment"}


@registered(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS name, CASE WHEN bool_and(regexp_full_match({x}, '\\d+')) THEN CASE WHEN max(try_cast({x} AS BIGINT)) <= 255 THEN 'UBYTE' WHEN max(try_cast({x} AS BIGINT)) <= 65535 THEN 'USHORT' ELSE 'UINT' END
            WHEN count({x}) <= 256 THEN 'CATEGORY' ELSE 'TEXT' END AS type FROM customer"""
        for c, x in _KINDS.items()
    )
)
def infer_types(spark, d):
    return readers.infer_types(table(spark, d, "customer").select(*[F.col(c).cast("string").alias(c) for c in _KINDS]))
