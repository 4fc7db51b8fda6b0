"""The registered queries over the driver's tables, with DuckDB SQL for each that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapline.functions.columns import doubles, fill_ones, unzigzag, zigzag
from gapline.operators import codec, gaps, partition, patched, search, stats, validate
from gapline.plans.index import build
from gapline.sources import collections, store, views
from gapline.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]


def keyed(view: str) -> Query:
    return lambda s, d: stats.positions(views.VIEWS[view](s, d))


def keyed_sql(view: str) -> str:
    return f"SELECT list_id, row_number() OVER (PARTITION BY list_id ORDER BY doc_id) - 1 AS pos, doc_id FROM ({views.SQL[view]})"


def page_sql(view: str) -> str:
    return f"""SELECT list_id, page, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id, count(gap) AS ng, coalesce(sum(gap), 0)::BIGINT AS sg, coalesce(sum(gap * gap), 0)::BIGINT AS sq
FROM (SELECT *, doc_id - lag(doc_id) OVER (PARTITION BY list_id, page ORDER BY pos) AS gap FROM (SELECT *, pos // 1024 AS page FROM ({keyed_sql(view)}))) GROUP BY list_id, page"""


def model_sql(view: str, scale: int) -> str:
    e = f"ceil(sqrt(2 * ln(CAST(2 AS DOUBLE)) * CAST(0.109967 AS DOUBLE) * {scale} * v * (n - 1) / n))"
    cost = f"(n - 1) * greatest(0, 1.957::DOUBLE + 0.5 * log2(CAST(0.109967 AS DOUBLE) * {scale} * v))"
    return f"""SELECT list_id, page, n, CASE WHEN n < 2 OR v <= 0 THEN 1 ELSE (1 << length(bin(greatest(1, {e})::BIGINT))) - 1 END::BIGINT AS epsilon, round(CASE WHEN n < 2 OR v <= 0 THEN 0 ELSE {cost} END, 6) AS cost
FROM (SELECT *, CASE WHEN ng >= 2 THEN (ng::HUGEINT * sq - sg::HUGEINT * sg)::DOUBLE / (ng * (ng - 1))::DOUBLE ELSE 0 END AS v FROM ({page_sql(view)}))"""


def hits_sql(view: str, k: int, source: str | None = None) -> str:
    return f"""SELECT t.query_id, p.doc_id, count(*) AS c, any_value(t.k) AS k FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS k FROM ({views.queries_sql(view, k)})) t
JOIN ({source or views.SQL[view]}) p ON p.list_id = t.list_id GROUP BY t.query_id, p.doc_id"""


def counts_sql(view: str, k: int, op: str) -> str:
    n = "coalesce(sum(CASE WHEN c = k THEN 1 END), 0)" if op == "and" else "count(*)"
    return f"SELECT query_id, {n}::BIGINT AS n FROM ({hits_sql(view, k)}) GROUP BY query_id"


TERMS = {"line": views.line_queries, "qty": views.qty_queries}


def _search(op: str, view: str, k: int, how: Callable = None) -> Query:
    f = how or {"and": search.and_query, "or": search.or_query}[op]
    return lambda s, d: f(views.VIEWS[view](s, d), TERMS[view](s, k))


def _index(view: str, **how) -> Query:
    return lambda s, d: build(keyed(view)(s, d), **how)


def _decode(view: str, **how) -> Query:
    return lambda s, d: codec.decode(_index(view, **how)(s, d))


def _over_index(op: str) -> Query:
    f = {"and": search.and_query, "or": search.or_query}[op]

    def run(s: SparkSession, d: str) -> DataFrame:
        return f(codec.decode(build(keyed("line")(s, d), 63)), views.line_queries(s, 2))

    return run


def _baseline(op: str) -> Query:
    f = {"and": search.and_query, "or": search.or_query}[op]
    return lambda s, d: f(gaps.decode(gaps.encode(keyed("line")(s, d))), views.line_queries(s, 3))


def _probes(s: SparkSession, d: str) -> DataFrame:
    """Every posting asks for the one behind it."""
    return views.supp(s, d).select("list_id", (F.col("doc_id") + 1).alias("x"))


PROBES_SQL = f"SELECT list_id, doc_id + 1 AS x FROM ({views.SQL['supp']})"
SOUGHT_SQL = f"SELECT p.list_id, p.x, s.doc_id, s.pos FROM ({PROBES_SQL}) p ASOF LEFT JOIN ({keyed_sql('supp')}) s ON s.list_id = p.list_id AND p.x <= s.doc_id"


def _tile(method: str, view: str) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        b = partition.blocks(stats.pages(keyed(view)(s, d)), 16, "none", method)
        return b.groupBy("list_id").agg(F.sum(F.col("end_idx") - F.col("start_idx")).cast("bigint").alias("n"), F.min("start_idx").alias("first"), F.max("end_idx").alias("last"))

    return run


def tile_sql(view: str) -> str:
    return f"SELECT list_id, count(*)::BIGINT AS n, 0::BIGINT AS first, count(*)::BIGINT AS last FROM ({views.SQL[view]}) GROUP BY list_id"


def _blocks(pages: Query, **how) -> Query:
    return lambda s, d: partition.blocks(pages(s, d), **how).select("list_id", "start_idx", "end_idx", "epsilon", F.round("cost", 4).alias("cost"))


def _skewed(s: SparkSession, d: str) -> DataFrame:
    """A dense run, gaps that grow from 1 to 1000 three times, and a dense run: 9001 keys."""
    i, k = F.col("id"), F.col("id") - 3000
    rise = F.expr("(id - 3000) div 1000") * 500500 + F.expr("(id - 3000) % 1000 * ((id - 3000) % 1000 + 1) div 2")
    doc = F.when(i <= 3000, i).when(i <= 6000, rise + 3000).otherwise(k - 3000 + 1504500)
    return s.range(9001).select(F.lit(0).cast("bigint").alias("list_id"), i.alias("pos"), doc.cast("bigint").alias("doc_id"))


SKEWED_SQL = """SELECT 0::BIGINT AS list_id, i AS pos, (sum(g) OVER (ORDER BY i))::BIGINT AS doc_id
FROM (SELECT i, CASE WHEN i = 0 THEN 0 WHEN i <= 3000 OR i > 6000 THEN 1 ELSE (i - 3001) % 1000 + 1 END AS g FROM range(9001) r(i))"""


def ranges_sql(keys: str, scale: int = 136) -> str:
    """Every range of consecutive pages a to b - 1 of each list: its keys, epsilon and cost by the cost model."""
    return f"""SELECT list_id, a, b, lo AS start_idx, hi + 1 AS end_idx,
  CASE WHEN n < 2 OR v <= 0 THEN 1 ELSE (1 << length(bin(greatest(1, ceil(sqrt(2 * ln(2::DOUBLE) * 0.109967::DOUBLE * {scale} * v * (n - 1) / n)))::BIGINT))) - 1 END::BIGINT AS epsilon,
  CASE WHEN n < 2 OR v <= 0 THEN 0 ELSE (n - 1) * greatest(0, 1.957::DOUBLE + 0.5 * log2(0.109967::DOUBLE * {scale} * v)) END AS cost
FROM (SELECT *, CASE WHEN n < 3 THEN 0 ELSE greatest(0, ((n - 1) * q - s * s)::DOUBLE / ((n - 1) * (n - 2))) END AS v
  FROM (SELECT k.list_id, x.p AS a, y.p + 1 AS b, min(k.pos) AS lo, max(k.pos) AS hi, count(*) AS n, coalesce(sum(CASE WHEN k.pos > x.p * 1024 THEN gap END), 0)::HUGEINT AS s, coalesce(sum(CASE WHEN k.pos > x.p * 1024 THEN gap * gap END), 0)::HUGEINT AS q
    FROM (SELECT *, doc_id - lag(doc_id) OVER (PARTITION BY list_id ORDER BY pos) AS gap FROM ({keys})) k
    JOIN (SELECT DISTINCT list_id, pos // 1024 AS p FROM ({keys})) x ON x.list_id = k.list_id
    JOIN (SELECT DISTINCT list_id, pos // 1024 AS p FROM ({keys})) y ON y.list_id = k.list_id AND y.p >= x.p
    WHERE k.pos BETWEEN x.p * 1024 AND y.p * 1024 + 1023 GROUP BY k.list_id, x.p, y.p))"""


def merged_sql(chosen: str) -> str:
    """Neighbours of chosen(list_id, a, b, epsilon) with one epsilon united; the cost is that of the whole, from the table r."""
    return f"""SELECT m.list_id, r.start_idx, r.end_idx, m.epsilon, round(r.cost, 4) AS cost
FROM (SELECT list_id, min(a) AS a, max(b) AS b, any_value(epsilon) AS epsilon
  FROM (SELECT *, sum(CASE WHEN epsilon = before THEN 0 ELSE 1 END) OVER (PARTITION BY list_id ORDER BY a) AS run
    FROM (SELECT *, lag(epsilon) OVER (PARTITION BY list_id ORDER BY a) AS before FROM ({chosen}))) GROUP BY list_id, run) m
JOIN r ON r.list_id = m.list_id AND r.a = m.a AND r.b = m.b"""


def single_pages_sql(view: str) -> str:
    """Blocks where more may wait than there are pages: every page is one, before neighbours are united."""
    return f"WITH r AS MATERIALIZED ({ranges_sql(keyed_sql(view))}) {merged_sql('SELECT list_id, a, b, epsilon FROM r WHERE b = a + 1')}"


#: Three blocks: of all ways to cut twice the cheapest, and the costlier part of the best first cut, cut again.
SKEWED_OPTIMAL_SQL = f"""WITH r AS MATERIALIZED ({ranges_sql(SKEWED_SQL)}),
best AS (SELECT x.b AS p, y.b AS q FROM r x JOIN r y ON y.a = x.b JOIN r z ON z.a = y.b WHERE x.a = 0 AND z.b = 9 ORDER BY x.cost + y.cost + z.cost, p, q LIMIT 1)
{merged_sql('SELECT r.list_id, a, b, epsilon FROM r JOIN best ON (a = 0 AND b = p) OR (a = p AND b = q) OR (a = q AND b = 9)')}"""
SKEWED_GREEDY_SQL = f"""WITH r AS MATERIALIZED ({ranges_sql(SKEWED_SQL)}),
one AS (SELECT x.b AS p FROM r x JOIN r y ON y.a = x.b WHERE x.a = 0 AND y.b = 9 ORDER BY x.cost + y.cost, p LIMIT 1),
half AS (SELECT a, b FROM r JOIN one ON (a = 0 AND b = p) OR (a = p AND b = 9) ORDER BY cost DESC, a LIMIT 1),
two AS (SELECT x.b AS q FROM half h JOIN r x ON x.a = h.a JOIN r y ON y.a = x.b AND y.b = h.b ORDER BY x.cost + y.cost, q LIMIT 1),
borders AS (SELECT least(p, q) AS p, greatest(p, q) AS q FROM one, two)
{merged_sql('SELECT r.list_id, a, b, epsilon FROM r JOIN borders ON (a = 0 AND b = p) OR (a = p AND b = q) OR (a = q AND b = 9)')}"""


def segments_sql(view: str, epsilon: int | None, scale: int = 136) -> str:
    """Segments of each list as one block, by the bounds that all pairs of its keys put on a slope; for lists of one page.

    A segment is the longest run whose greatest lower bound isn't over its least upper one; its line is that of the pair with the latter, the
    first later key and the nearest earlier one. Without epsilon the cost model's is taken.
    """
    bound = f"{epsilon}::BIGINT" if epsilon else "m.epsilon"
    model = "" if epsilon else f" JOIN ({model_sql(view, scale)}) m ON m.list_id = k.list_id"
    return f"""WITH RECURSIVE k AS MATERIALIZED (SELECT k.*, {bound} AS epsilon, greatest(doc_id - {bound}, 0) AS lo, least(doc_id + {bound}, 2147483647) AS hi FROM ({keyed_sql(view)}) k{model}),
pair AS MATERIALIZED (SELECT x.list_id, x.pos AS j, y.pos AS i, (y.hi - x.lo)::DOUBLE / (y.pos - x.pos) AS up, (y.lo - x.hi)::DOUBLE / (y.pos - x.pos) AS low FROM k x JOIN k y ON y.list_id = x.list_id AND y.pos > x.pos),
ends AS (SELECT k.list_id, k.pos AS s, p.i, min(up) AS up, max(low) AS low FROM k JOIN pair p ON p.list_id = k.list_id AND p.j >= k.pos GROUP BY k.list_id, k.pos, p.i),
bounds AS (SELECT list_id, s, i, min(up) OVER w AS up, max(low) OVER w AS low FROM ends WINDOW w AS (PARTITION BY list_id, s ORDER BY i ROWS UNBOUNDED PRECEDING)),
stop AS (SELECT list_id, s, min(i) AS e FROM bounds WHERE low > up GROUP BY list_id, s),
next AS MATERIALIZED (SELECT k.list_id, k.pos AS s, coalesce(stop.e, n) AS e FROM k JOIN (SELECT list_id, count(*) AS n FROM k GROUP BY list_id) USING (list_id) LEFT JOIN stop ON stop.list_id = k.list_id AND stop.s = k.pos),
seg AS (SELECT list_id, s, e FROM next WHERE s = 0 UNION ALL SELECT n.list_id, n.s, n.e FROM seg JOIN next n ON n.list_id = seg.list_id AND n.s = seg.e),
pick AS (SELECT seg.list_id, s, e, j, i, row_number() OVER (PARTITION BY seg.list_id, s ORDER BY up, i, j DESC) AS r FROM seg LEFT JOIN pair p ON p.list_id = seg.list_id AND p.j >= s AND p.i < e),
segments AS (SELECT f.list_id, 0::BIGINT AS block_id, f.epsilon, s AS first, e - s AS covered, coalesce(y.hi - x.lo, 0) AS delta_y, coalesce(i - j, 1) AS delta_x, coalesce(x.lo, f.doc_id) AS y_b, coalesce(j, s) AS x_b, f.doc_id AS first_value, l.doc_id AS last_value
  FROM pick JOIN k f ON f.list_id = pick.list_id AND f.pos = s JOIN k l ON l.list_id = pick.list_id AND l.pos = e - 1
  LEFT JOIN k x ON x.list_id = pick.list_id AND x.pos = j LEFT JOIN k y ON y.list_id = pick.list_id AND y.pos = i WHERE r = 1),
residuals AS (SELECT *, n - CASE WHEN pos = first THEN 0 ELSE lag(n) OVER (PARTITION BY list_id, first ORDER BY pos) END AS delta
  FROM (SELECT t.*, k.pos, k.doc_id - (sign(v) * (abs(v) // delta_x) + y_b)::BIGINT AS n
    FROM (SELECT s.*, k.pos AS p, delta_y * (k.pos - x_b) + (delta_x // 2) * sign(k.pos - x_b)::BIGINT AS v FROM segments s JOIN k ON k.list_id = s.list_id AND k.pos BETWEEN first AND first + covered - 1) t JOIN k ON k.list_id = t.list_id AND k.pos = t.p)),
codes AS (SELECT *, CASE WHEN delta >= 0 THEN 2 * delta ELSE -2 * delta - 1 END AS code FROM residuals)"""


def _width(x: str) -> str:
    return f"(CASE WHEN {x} = 0 THEN 0 ELSE length(bin({x})) END)::BIGINT"


def _words(n: str, width: str) -> str:
    return f"(({n} * {width} + 63) // 64 * 8)"


def sizes_sql(view: str, epsilon: int | None, variant: str = "none") -> str:
    """The tables of segments_sql and then sizes: of each list's block."""
    scale = {"none": 136, "pfor": 27200}[variant]
    parts = ("covered", "delta_y", "delta_x", "y_b", "x_b")
    widths = ", ".join(f"{_width(f'max({p})')} AS w_{p}" for p in parts)
    packed = " + ".join(_words("n_segments", f"w_{p}") for p in parts)
    rest = f"{_words('n', _width('epsilon'))} AS correction_bytes, n // 8 AS sign_bytes" if variant == "none" else "(bits + 31) // 32 * 4 AS correction_bytes, 0::BIGINT AS sign_bytes"
    return f"""{segments_sql(view, epsilon, scale)},
sizes AS (SELECT *, segment_bytes + correction_bytes + sign_bytes AS total_bytes FROM (SELECT *, {packed} + 1 AS segment_bytes, {rest}
  FROM (SELECT list_id, block_id, max(epsilon) AS epsilon, sum(covered)::BIGINT AS n, count(*) AS n_segments, {widths} FROM segments GROUP BY list_id, block_id)
  JOIN (SELECT list_id, sum({_width('code')})::BIGINT AS bits FROM codes GROUP BY list_id) USING (list_id)))"""


INDEX_SQL = """SELECT *, n / n_segments AS avg_covered, n_segments / n_lists AS avg_segments, total_bytes / (n * 4) AS compression_ratio, total_bytes / 1073741824::DOUBLE AS gib, total_bytes / n AS bytes_per_int
FROM (SELECT count(*) AS n_lists, sum(n)::BIGINT AS n, sum(n_segments)::BIGINT AS n_segments, sum(segment_bytes)::BIGINT AS segment_bytes, sum(correction_bytes)::BIGINT AS correction_bytes, sum(sign_bytes)::BIGINT AS sign_bytes, sum(total_bytes)::BIGINT AS total_bytes FROM sizes)"""


def _zigzag(s: SparkSession, d: str) -> DataFrame:
    x = views.supp(s, d).select((F.col("list_id") - F.col("doc_id")).alias("x")).distinct()
    return x.withColumn("z", zigzag(F.col("x"))).withColumn("back", unzigzag(F.col("z")))


def _page_model(view: str, variant: str) -> Query:
    return lambda s, d: stats.page_model(stats.pages(keyed(view)(s, d)), variant).select("list_id", "page", "n", "epsilon", F.round("cost", 6).alias("cost"))


def _invariants(s: SparkSession, d: str) -> DataFrame:
    """Per list: keys covered, and how many residuals exceed their bound or anchors stand outside their segment."""
    r = codec.residuals(build(keyed("qty")(s, d), 15))
    return r.groupBy("list_id").agg(F.count("*").alias("n"), F.sum((F.abs("residual") > F.col("epsilon")).cast("bigint")).alias("over"), F.sum(((F.col("x_b") < F.col("first")) | (F.col("delta_x") <= 0)).cast("bigint")).alias("odd"))


def _gap_blocks(s: SparkSession, d: str) -> DataFrame:
    return gaps.encode(keyed("supp")(s, d)).select("list_id", "block_no", F.col("n").cast("bigint").alias("n"), "block_max", F.array_join(F.transform("gaps", lambda x: x.cast("string")), ",").alias("gaps"))


def _stored(s: SparkSession, d: str) -> DataFrame:
    """The lists of suppliers in debt, loaded from a stored index and decoded."""
    folder = store.scratch(s, "index")
    store.save(build(keyed("supp")(s, d), 31), folder)
    some = s.read.parquet(f"{d}/supplier.parquet").where("s_acctbal < 0").select(F.col("s_suppkey").alias("list_id"))
    return codec.decode(store.load(s, folder, some))


def _whole(s: SparkSession, d: str) -> DataFrame:
    """The whole of a stored index, decoded; and a baseline's beside it, held against it."""
    folder, k = store.scratch(s, "index"), keyed("event_user")(s, d)
    store.save(build(k, 31), folder)
    store.save(gaps.encode(k), folder, name="gap_blocks", order="block_no")
    return codec.decode(store.load(s, folder)).intersect(gaps.decode(store.load(s, folder, name="gap_blocks")))


def _key_file(s: SparkSession, d: str) -> DataFrame:
    """Keys that went through a key file and back."""
    path = store.scratch(s, "keys")
    collections.write_keys(s.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("key")), path)
    return collections.read_keys(s, path)


def _records(s: SparkSession, d: str) -> DataFrame:
    """Postings that went through packed records and back."""
    folder = store.scratch(s, "records")
    store.export(_index("qty")(s, d)).write.parquet(folder)
    return codec.decode(store.restore(s.read.parquet(folder)))


def _idx(s: SparkSession, d: str) -> DataFrame:
    """Postings of the view line, whose lists are numbered from 0, that went through record files and back."""
    folder = store.scratch(s, "idx")
    store.save_idx(build(keyed("line")(s, d).withColumn("list_id", F.col("list_id") - 1)), folder)
    return codec.decode(store.load_idx(s, folder))


def _collection(s: SparkSession, d: str) -> str:
    """Collection files of the view line, whose lists are numbered from 0."""
    folder = store.scratch(s, "collection")
    universe = views.line(s, d).agg(F.max("doc_id") + 1).first()[0]
    collections.write_docs(keyed("line")(s, d).withColumn("list_id", F.col("list_id") - 1), folder, universe, files=4)
    return folder


def _query_file(s: SparkSession, d: str) -> DataFrame:
    """Queries that went through a text file and back; terms as text."""
    folder = store.scratch(s, "queries")
    collections.write_queries(search.clean_terms(views.qty_queries(s, 4)).repartition(1), folder)
    return collections.read_queries(s, f"{folder}/part-*.txt").select("query_id", F.array_join(F.transform("terms", lambda x: x.cast("string")), " ").alias("terms"))


def _streamed(s: SparkSession, d: str) -> DataFrame:
    """Positions of postings that came as a stream of files."""
    folder = store.scratch(s, "stream")
    schema = s.read.parquet(f"{d}/events.parquet").schema
    stream = s.readStream.schema(schema).parquet(f"{d}/events.parquet*").select(F.col("user_id").cast("bigint").alias("list_id"), F.col("event_id").alias("doc_id"))
    incremental.ingest(stream, f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
    return stats.positions(incremental.postings(s, f"{folder}/table"))


def _broken(s: SparkSession, d: str) -> DataFrame:
    """Rules that a damaged copy of the view qty breaks: every 500th position repeats the id before it, and the universe ends early."""
    k = keyed("qty")(s, d)
    top = k.agg(F.max("doc_id").alias("m")).select((F.col("m") - 10).alias("universe_size"))
    before = k.select("list_id", (F.col("pos") + 1).alias("pos"), F.col("doc_id").alias("b"))
    bad = k.join(before, ["list_id", "pos"], "left").select("list_id", "pos", F.when(F.col("pos") % 500 == 499, F.col("b")).otherwise(F.col("doc_id")).alias("doc_id"))
    return validate.violations(bad, top)


BROKEN_SQL = f"""WITH k AS ({keyed_sql('qty')}),
b AS (SELECT list_id, pos, CASE WHEN pos % 500 = 499 THEN lag(doc_id) OVER w ELSE doc_id END AS doc_id FROM k WINDOW w AS (PARTITION BY list_id ORDER BY pos)),
v AS (SELECT *, lag(doc_id) OVER (PARTITION BY list_id ORDER BY pos) AS before FROM b)
SELECT list_id, pos, 'order' AS rule FROM v WHERE before >= doc_id
UNION ALL SELECT list_id, pos, 'range' FROM v WHERE doc_id >= (SELECT max(doc_id) - 10 FROM k)"""


def _sought(encoded: str) -> Query:
    """Next-greater-or-equal on stored segments, or on the baseline's stored blocks."""

    def run(s: SparkSession, d: str) -> DataFrame:
        folder, k = store.scratch(s, encoded), keyed("supp")(s, d)
        if encoded == "index":
            store.save(build(k, 63), folder)
            return search.seek_segments(store.load(s, folder), _probes(s, d))
        store.save(gaps.encode(k), folder, name="gap_blocks", order="block_no")
        return search.seek_gaps(store.load(s, folder, name="gap_blocks"), _probes(s, d))

    return run


def _skip_rate(s: SparkSession, d: str) -> DataFrame:
    sizes = views.supp(s, d).groupBy("list_id").agg(F.count("*").alias("n"))
    return search.skip_rate(_sought("gap128")(s, d), sizes).withColumn("rate", F.round("rate", 6))


def _parsed(s: SparkSession, d: str) -> DataFrame:
    """Numbers parsed back from a text of them, among which stands a word."""
    p = s.read.parquet(f"{d}/part.parquet").select("p_partkey", F.concat_ws(", ", "p_retailprice", F.lit("x"), "p_size").alias("t"))
    return p.select("p_partkey", F.posexplode(doubles(F.col("t"))).alias("i", "x")).select("p_partkey", F.col("i").cast("bigint").alias("i"), "x")


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c, kind in df.dtypes if kind == "double"})


def queries() -> dict[str, Query]:
    q: dict[str, Query] = {}
    for v in views.VIEWS:
        q[f"postings_{v}"] = keyed(v)
    q["list_stats"] = lambda s, d: stats.list_stats(keyed("cust")(s, d)).select("list_id", "n", "min_id", "max_id", F.round("mean_gap", 6).alias("mean_gap"), F.round("var_pop", 3).alias("var_pop"))
    q["page_stats"] = lambda s, d: stats.pages(keyed("event_type")(s, d)).withColumn("sum_gap2", F.col("sum_gap2").cast("bigint"))
    q["page_minmax_var"] = lambda s, d: stats.page_extremes(stats.pages(keyed("qty")(s, d))).select("list_id", "n_pages", F.round("max_var", 6).alias("max_var"), F.round("min_var", 6).alias("min_var"))
    q["page_eps_none"] = _page_model("event_type", "none")
    q["page_eps_pfor"] = _page_model("qty", "pfor")
    q["page_cost"] = _page_model("line", "none")
    q["gap_prefix"] = lambda s, d: stats.gap_prefix(keyed("line")(s, d))
    q["blocks_greedy"] = _tile("greedy", "event_type")
    q["blocks_optimal"] = _tile("optimal", "line")
    q["eps_histogram"] = lambda s, d: partition.epsilon_histogram(partition.blocks(stats.pages(keyed("qty")(s, d))))
    q["unparted_lists"] = lambda s, d: partition.unparted(partition.blocks(stats.pages(keyed("qty")(s, d))))
    for e in (1, 15, 63, 255):
        q[f"decode_fixed_eps{e}"] = _decode("supp" if e < 63 else "qty", epsilon=e)
    q["decode_auto_none"] = _decode("line")
    q["decode_auto_optimal"] = _decode("event_type", method="optimal", m=4)
    q["decode_auto_pfor"] = lambda s, d: codec.decode_codes(codec.delta_codes(_index("line", variant="pfor")(s, d)))
    q["decode_token"] = _decode("token", epsilon=63)
    q["decode_patched"] = lambda s, d: codec.decode(patched.expand(patched.compress(_index("line", variant="pfor")(s, d))))
    q["verify_mismatches"] = lambda s, d: validate.mismatches(views.cust(s, d), codec.decode(build(keyed("cust")(s, d), 31)))
    q["residual_bound"] = _invariants
    q["segment_widths"] = lambda s, d: codec.index_sizes(_index("cust", epsilon=511)(s, d)).drop("sign_bytes", "correction_bytes", "segment_bytes", "total_bytes")
    q["index_size"] = lambda s, d: codec.index_stats(codec.index_sizes(_index("qty")(s, d)))
    q["index_size_pfor"] = lambda s, d: _rounded(codec.index_stats(codec.index_sizes(_index("cust", variant="pfor")(s, d), "pfor")))
    q["list_size"] = lambda s, d: codec.list_sizes(codec.index_sizes(_index("cust")(s, d))).withColumn("bits_per_int", F.round("bits_per_int", 6))
    q["zigzag_roundtrip"] = _zigzag
    q["gap128_blocks"] = _gap_blocks
    q["gap128_decode"] = lambda s, d: gaps.decode(gaps.encode(keyed("part")(s, d)))
    q["gap128_widths"] = lambda s, d: gaps.widths(gaps.encode(keyed("supp")(s, d)))
    q["gap128_size"] = lambda s, d: gaps.sizes(gaps.encode(keyed("supp")(s, d))).select("n", "packed_bytes", "orig_bytes", F.round("ratio", 6).alias("ratio"), F.round("bpi", 6).alias("bpi"))
    for k in (2, 3, 4, 5):
        for op in ("and", "or"):
            q[f"{op}_{k}"] = _search(op, "line", k)
            q[f"{op}_{k}_counts"] = lambda s, d, op=op, k=k: search.counts(_search(op, "qty", k)(s, d), views.qty_queries(s, k))
    q["and_array"] = _search("and", "line", 3, lambda p, t: search.by_arrays(p, t, "and"))
    q["or_array"] = _search("or", "line", 3, lambda p, t: search.by_arrays(p, t, "or"))
    q["and_bitmap"] = _search("and", "line", 3, lambda p, t: search.bitmap_counts(p, t, "and"))
    q["or_bitmap"] = _search("or", "line", 3, lambda p, t: search.bitmap_counts(p, t, "or"))
    q["and_semi"] = _search("and", "line", 3, search.and_semi)
    q["and_not"] = _search("and", "line", 2, search.and_not)
    q["and_total_size"] = lambda s, d: _search("and", "qty", 3)(s, d).agg(F.count("*").alias("total_size"))
    q["or_total_size"] = lambda s, d: _search("or", "qty", 3)(s, d).agg(F.count("*").alias("total_size"))
    q["query_load_stats"] = lambda s, d: search.load_stats(views.qty(s, d), views.qty_queries(s, 4))
    q["nextgeq_probe"] = lambda s, d: search.next_geq(keyed("supp")(s, d), _probes(s, d))
    q["nextgeq_skipped"] = lambda s, d: _sought("gap128")(s, d).where("doc_id is not null").select("list_id", "x", "n_skipped")
    q["cursor_next"] = lambda s, d: search.cursor(keyed("event_user")(s, d))
    q["term_dedup"] = lambda s, d: search.clean_terms(views.line_queries(s, 9)).select("query_id", F.array_join(F.transform("terms", lambda x: x.cast("string")), ",").alias("terms"), "k")
    q["query_validate"] = lambda s, d: search.valid_queries(views.line_queries(s, 1).union(views.line_queries(s, 8))).select("query_id", "k")
    q["all_ones"] = lambda s, d: views.supp(s, d).select("doc_id").distinct().withColumn("ones", fill_ones(F.col("doc_id")))
    q["and_over_index"], q["or_over_index"] = _over_index("and"), _over_index("or")
    q["and_over_gap128"], q["or_over_gap128"] = _baseline("and"), _baseline("or")
    q["index_stored_lists"], q["records_roundtrip"] = _stored, _records
    q["idx_roundtrip"] = _idx
    q["docs_roundtrip"] = lambda s, d: collections.read_docs(s, _collection(s, d))
    q["docs_meta"] = lambda s, d: collections.read_meta(s, _collection(s, d))
    q["queries_roundtrip"] = _query_file
    q["stream_postings"] = _streamed
    q["violations"] = _broken
    q["nextgeq_over_index"], q["nextgeq_over_gap128"] = (lambda s, d, e=e: _sought(e)(s, d).drop("n_skipped") for e in ("index", "gap128"))
    q["skip_rate"] = _skip_rate
    q["residual_sample"] = lambda s, d: codec.sample_residuals(_index("cust", epsilon=511)(s, d))
    q["plain_size"] = lambda s, d: codec.plain_sizes(codec.index_sizes(_index("cust", epsilon=511)(s, d))).select("list_id", "block_id", "n", "n_segments", "plain_bytes")
    q["segments"] = lambda s, d: _index("cust", epsilon=511)(s, d).drop("residuals")
    q["segments_auto"] = lambda s, d: _index("cust")(s, d).drop("residuals")
    q["residuals"] = lambda s, d: codec.residuals(_index("cust", epsilon=511)(s, d)).select("list_id", "pos", "residual")
    q["max_slopes"] = lambda s, d: codec.max_slopes(_index("cust", epsilon=511)(s, d)).withColumn("max_slope", F.round("max_slope", 6))
    q["index_size_cust"] = lambda s, d: _rounded(codec.index_stats(codec.index_sizes(_index("cust")(s, d))))
    q["blocks_single_pages"] = _blocks(lambda s, d: stats.pages(keyed("line")(s, d)))
    q["blocks_skewed_optimal"] = _blocks(lambda s, d: stats.pages(_skewed(s, d)), m=3, method="optimal")
    q["blocks_skewed_greedy"] = _blocks(lambda s, d: stats.pages(_skewed(s, d)), m=3)
    q["page_variance"] = lambda s, d: stats.page_model(stats.pages(keyed("line")(s, d))).select("list_id", "page", F.round("variance", 6).alias("variance"))
    q["index_stored_whole"], q["keys_roundtrip"], q["parse_doubles"] = _whole, _key_file, _parsed
    return q


def oracle_sql() -> dict[str, str]:
    o = {f"postings_{v}": keyed_sql(v) for v in views.VIEWS}
    o["list_stats"] = f"""SELECT list_id, n, min_id, max_id, round(s::DOUBLE / m, 6) AS mean_gap, round((m * q - s * s)::DOUBLE / (m::DOUBLE * m::DOUBLE), 3) AS var_pop
FROM (SELECT list_id, count(*) AS n, min(doc_id) AS min_id, max(doc_id) AS max_id, nullif(count(*) - 1, 0)::HUGEINT AS m, (max(doc_id) - min(doc_id))::HUGEINT AS s, sum(gap * gap)::HUGEINT AS q
FROM (SELECT *, doc_id - lag(doc_id) OVER (PARTITION BY list_id ORDER BY doc_id) AS gap FROM ({views.SQL['cust']})) GROUP BY list_id)"""
    o["page_stats"] = f"SELECT list_id, page, n, first_id, last_id, ng AS n_gaps, sg AS sum_gap, sq AS sum_gap2 FROM ({page_sql('event_type')})"
    o["page_minmax_var"] = f"""SELECT list_id, count(*) AS n_pages, round(max(v), 6) AS max_var, round(min(v), 6) AS min_var
FROM (SELECT *, CASE WHEN ng >= 2 THEN (ng::HUGEINT * sq - sg::HUGEINT * sg)::DOUBLE / (ng * (ng - 1))::DOUBLE WHEN ng > 0 THEN 0 END AS v FROM ({page_sql('qty')})) GROUP BY list_id"""
    o["page_eps_none"], o["page_eps_pfor"], o["page_cost"] = model_sql("event_type", 136), model_sql("qty", 27200), model_sql("line", 136)
    o["gap_prefix"] = f"""SELECT list_id, pos, gap, coalesce(sum(gap) OVER w, 0)::BIGINT AS sum_gap, coalesce(sum(gap * gap) OVER w, 0)::BIGINT AS sum_gap2
FROM (SELECT *, doc_id - lag(doc_id) OVER (PARTITION BY list_id ORDER BY pos) AS gap FROM ({keyed_sql('line')})) WINDOW w AS (PARTITION BY list_id ORDER BY pos ROWS UNBOUNDED PRECEDING)"""
    o["blocks_greedy"], o["blocks_optimal"] = tile_sql("event_type"), tile_sql("line")
    for name, v in {"fixed_eps1": "supp", "fixed_eps15": "supp", "fixed_eps63": "qty", "fixed_eps255": "qty", "auto_none": "line", "auto_optimal": "event_type", "auto_pfor": "line", "token": "token"}.items():
        o[f"decode_{name}"] = keyed_sql(v)
    o["decode_patched"] = keyed_sql("line")
    o["verify_mismatches"] = f"SELECT DISTINCT list_id, 0::BIGINT AS n_unequal FROM ({views.SQL['cust']})"
    o["residual_bound"] = f"SELECT list_id, count(*) AS n, 0::BIGINT AS over, 0::BIGINT AS odd FROM ({views.SQL['qty']}) GROUP BY list_id"
    o["zigzag_roundtrip"] = f"SELECT DISTINCT x, CASE WHEN x >= 0 THEN 2 * x ELSE -2 * x - 1 END AS z, x AS back FROM (SELECT list_id - doc_id AS x FROM ({views.SQL['supp']}))"
    gap = f"SELECT list_id, pos, pos // 128 AS block_no, doc_id, doc_id - coalesce(lag(doc_id) OVER (PARTITION BY list_id ORDER BY pos), -1) - 1 AS gap FROM ({keyed_sql('supp')})"
    o["gap128_blocks"] = f"SELECT list_id, block_no, count(*) AS n, max(doc_id) AS block_max, string_agg(gap::VARCHAR, ',' ORDER BY pos) AS gaps FROM ({gap}) GROUP BY list_id, block_no"
    o["gap128_decode"] = keyed_sql("part")
    width = f"SELECT list_id, block_no, count(*) AS n, (CASE WHEN max(gap) = 0 THEN 0 ELSE length(bin(max(gap))) END)::BIGINT AS width FROM ({gap}) GROUP BY list_id, block_no"
    o["gap128_widths"] = f"SELECT list_id, block_no, width FROM ({width})"
    o["gap128_size"] = f"""SELECT n, packed_bytes, n * 4 AS orig_bytes, round(n * 400 / packed_bytes, 6) AS ratio, round(packed_bytes * 8 / n, 6) AS bpi
FROM (SELECT sum(n)::BIGINT AS n, sum((n * width + 31) // 32 * 4 + 8)::BIGINT AS packed_bytes FROM ({width}))"""
    for k in (2, 3, 4, 5):
        o[f"and_{k}"] = f"SELECT query_id, doc_id FROM ({hits_sql('line', k)}) WHERE c = k"
        o[f"or_{k}"] = f"SELECT query_id, doc_id FROM ({hits_sql('line', k)})"
        for op in ("and", "or"):
            o[f"{op}_{k}_counts"] = counts_sql("qty", k, op)
    o["and_array"] = o["and_semi"] = o["and_over_gap128"] = o["and_3"]
    o["or_array"] = o["or_over_gap128"] = o["or_3"]
    o["and_bitmap"], o["or_bitmap"] = (f"SELECT query_id, n FROM ({counts_sql('line', 3, op)}) WHERE n > 0" for op in ("and", "or"))
    line = views.SQL["line"]
    o["and_not"] = f"SELECT q AS query_id, doc_id FROM range(7) r(q) JOIN ({line}) a ON a.list_id = q % 7 + 1 WHERE NOT EXISTS (SELECT 1 FROM ({line}) b WHERE b.list_id = (q + 1) % 7 + 1 AND b.doc_id = a.doc_id)"
    o["and_total_size"] = f"SELECT sum(n)::BIGINT AS total_size FROM ({counts_sql('qty', 3, 'and')})"
    o["or_total_size"] = f"SELECT sum(n)::BIGINT AS total_size FROM ({counts_sql('qty', 3, 'or')})"
    o["query_load_stats"] = f"""SELECT query_id, count(*) AS n_lists, sum(n)::BIGINT AS total_size, avg(n) AS avg_size FROM ({views.queries_sql('qty', 4)}) JOIN (SELECT list_id, count(*) AS n FROM ({views.SQL['qty']}) GROUP BY list_id) USING (list_id) GROUP BY query_id"""
    o["nextgeq_probe"] = f"SELECT list_id, x, doc_id FROM ({SOUGHT_SQL})"
    o["nextgeq_skipped"] = f"SELECT list_id, x, pos // 128 * 128 AS n_skipped FROM ({SOUGHT_SQL}) WHERE pos IS NOT NULL"
    o["cursor_next"] = f"SELECT list_id, doc_id, lead(doc_id) OVER (PARTITION BY list_id ORDER BY doc_id) AS next_id FROM ({views.SQL['event_user']})"
    o["term_dedup"] = "SELECT query_id, string_agg(list_id::VARCHAR, ',' ORDER BY list_id) AS terms, count(*) AS k FROM (" + views.queries_sql("line", 9) + ") GROUP BY query_id"
    o["query_validate"] = "SELECT q AS query_id, 7::BIGINT AS k FROM range(7) r(q)"
    o["all_ones"] = f"SELECT DISTINCT doc_id, CASE WHEN doc_id = 0 THEN 0 ELSE (1 << length(bin(doc_id))) - 1 END::BIGINT AS ones FROM ({views.SQL['supp']})"
    o["and_over_index"], o["or_over_index"] = o["and_2"], o["or_2"]
    o["index_stored_lists"] = f"SELECT * FROM ({keyed_sql('supp')}) WHERE list_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)"
    o["records_roundtrip"] = keyed_sql("qty")
    o["idx_roundtrip"] = f"SELECT list_id - 1 AS list_id, pos, doc_id FROM ({keyed_sql('line')})"
    o["docs_roundtrip"] = f"SELECT list_id - 1 AS list_id, pos, doc_id FROM ({keyed_sql('line')})"
    o["docs_meta"] = f"SELECT max(doc_id) + 1 AS universe_size, count(DISTINCT list_id) AS n_lists, count(*) AS n_postings FROM ({line})"
    o["queries_roundtrip"] = "SELECT query_id, string_agg(list_id::VARCHAR, ' ' ORDER BY list_id) AS terms FROM (" + views.queries_sql("qty", 4) + ") GROUP BY query_id"
    o["stream_postings"] = keyed_sql("event_user")
    o["violations"] = BROKEN_SQL
    o["nextgeq_over_index"] = o["nextgeq_over_gap128"] = o["nextgeq_probe"]
    o["skip_rate"] = f"""SELECT sum(n)::BIGINT AS n, sum(n_skipped)::BIGINT AS n_skipped, round(sum(n_skipped) / sum(n), 6) AS rate
FROM ({o['nextgeq_skipped']}) JOIN (SELECT list_id, count(*) AS n FROM ({views.SQL['supp']}) GROUP BY list_id) USING (list_id)"""
    o["eps_histogram"] = f"SELECT epsilon, count(*) AS n_blocks FROM ({single_pages_sql('qty')}) GROUP BY epsilon"
    o["unparted_lists"] = f"SELECT count(*) AS n_unparted FROM (SELECT list_id FROM ({single_pages_sql('qty')}) GROUP BY list_id HAVING count(*) = 1)"
    o["blocks_single_pages"], o["blocks_skewed_optimal"], o["blocks_skewed_greedy"] = single_pages_sql("line"), SKEWED_OPTIMAL_SQL, SKEWED_GREEDY_SQL
    fixed, auto = sizes_sql("cust", 511), sizes_sql("cust", None)
    ratios = "round(avg_covered, 9) AS avg_covered, round(avg_segments, 9) AS avg_segments, round(compression_ratio, 9) AS compression_ratio, round(gib, 9) AS gib, round(bytes_per_int, 9) AS bytes_per_int"
    o["segments"], o["segments_auto"] = f"{fixed} SELECT * FROM segments", f"{auto} SELECT * FROM segments"
    o["residuals"] = f"{fixed} SELECT list_id, pos, n AS residual FROM residuals"
    o["residual_sample"] = f"{fixed} SELECT list_id, block_id, first, pos, n AS residual, delta, code FROM codes WHERE list_id IN (SELECT list_id FROM (SELECT DISTINCT list_id FROM segments) ORDER BY md5('0:' || list_id), list_id LIMIT 8)"
    o["max_slopes"] = f"{fixed} SELECT list_id, round(max(delta_y / delta_x), 6) AS max_slope FROM segments GROUP BY list_id"
    o["segment_widths"] = f"{fixed} SELECT list_id, block_id, epsilon, n, n_segments, w_covered, w_delta_y, w_delta_x, w_y_b, w_x_b FROM sizes"
    o["plain_size"] = f"{fixed} SELECT list_id, block_id, n, n_segments, n_segments * 20 + 1 + correction_bytes + sign_bytes AS plain_bytes FROM sizes"
    o["list_size"] = f"{auto} SELECT list_id, n, n_segments, segment_bytes, correction_bytes, sign_bytes, total_bytes, round(total_bytes / n * 8, 6) AS bits_per_int FROM sizes"
    o["index_size_cust"] = f"{auto} SELECT * REPLACE ({ratios}) FROM ({INDEX_SQL})"
    o["index_size_pfor"] = f"{sizes_sql('cust', None, 'pfor')} SELECT * REPLACE ({ratios}) FROM ({INDEX_SQL})"
    o["page_variance"] = f"SELECT list_id, page, round(CASE WHEN ng >= 2 THEN (ng::HUGEINT * sq - sg::HUGEINT * sg)::DOUBLE / (ng * (ng - 1))::DOUBLE ELSE 0 END, 6) AS variance FROM ({page_sql('line')})"
    o["index_stored_whole"] = keyed_sql("event_user")
    o["keys_roundtrip"] = "SELECT row_number() OVER (ORDER BY o_custkey) - 1 AS pos, o_custkey AS key FROM orders"
    o["parse_doubles"] = "SELECT p_partkey, 0::BIGINT AS i, p_retailprice AS x FROM part UNION ALL SELECT p_partkey, 1, p_size::DOUBLE FROM part"
    return o
