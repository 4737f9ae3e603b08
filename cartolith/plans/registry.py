"""Queries over the driver's tables, each with its equivalent SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed, scalar
from ..operators import catalog, hierarchy, layout, neighbours, tiles, vectors, view
from ..sources import export, tables
from .storage import stored

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# -- tiles ------------------------------------------------------------------------

MAX_ZOOM, LIMIT, GRID = 5, 64, 8


def points(spark, sf) -> DataFrame:
    e = read(spark, sf, "embeddings")
    rows = e.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), F.col("label").cast("long").alias("category"), F.pmod(F.col("vec_id") * 7919, F.lit(1009)).alias("importance"))
    return tiles.importance_rank(rows)


P_SQL = """
e AS (SELECT vec_id::BIGINT AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, label::BIGINT AS category, (vec_id * 7919) % 1009 AS v FROM embeddings),
r AS (SELECT *, row_number() OVER (ORDER BY v, id) - 1 AS k, count(*) OVER () AS n FROM e),
p AS (SELECT id, x, y, category, CASE WHEN n = 1 THEN 65535 ELSE round_even(k::DOUBLE / (n - 1) * 65535, 0)::INT END AS importance FROM r),
b AS (SELECT min(x) AS minx, min(y) AS miny, max(x) + 1e-9::DOUBLE * (max(x) - min(x)) + 1e-12::DOUBLE AS maxx, max(y) + 1e-9::DOUBLE * (max(y) - min(y)) + 1e-12::DOUBLE AS maxy FROM p)"""


def _cell(v, lo, hi, n):
    return f"least(greatest(trunc((({v}) - ({lo})) / greatest(({hi}) - ({lo}), 1e-12::DOUBLE) * ({n}))::BIGINT, 0), ({n}) - 1)"


A_SQL = f"""{P_SQL},
a AS (SELECT p.*, b.*, z::INT AS z, {_cell('x', 'minx', 'maxx', '(1::BIGINT << z::INT)')} AS tx, {_cell('y', 'miny', 'maxy', '(1::BIGINT << z::INT)')} AS ty
  FROM p, b, (SELECT unnest(range(0, {MAX_ZOOM + 1})) AS z) zz),
c AS (SELECT *, minx + tx * ((maxx - minx) / pow(2.0::DOUBLE, z)) AS bx0, miny + ty * ((maxy - miny) / pow(2.0::DOUBLE, z)) AS by0,
  minx + (tx + 1) * ((maxx - minx) / pow(2.0::DOUBLE, z)) AS bx1, miny + (ty + 1) * ((maxy - miny) / pow(2.0::DOUBLE, z)) AS by1 FROM a),
g AS (SELECT *, {_cell('x', 'bx0', 'bx1', str(GRID))} AS gx, {_cell('y', 'by0', 'by1', str(GRID))} AS gy FROM c),
s1 AS (SELECT *, row_number() OVER (PARTITION BY z, tx, ty, gx, gy ORDER BY importance DESC, id) <= {max(1, LIMIT // GRID**2)} AS first FROM g WHERE z < {MAX_ZOOM}),
s2 AS (SELECT *, row_number() OVER (PARTITION BY z, tx, ty ORDER BY first DESC, importance DESC, id) AS rn FROM s1),
pyr AS (SELECT z, tx, ty, id, x, y, category, importance, false AS is_leaf FROM s2 WHERE rn <= {LIMIT}
  UNION ALL SELECT z, tx, ty, id, x, y, category, importance, true FROM a WHERE z = {MAX_ZOOM})"""


def pyramid(spark, sf, strategy="stratified"):
    return tiles.tile_pyramid(points(spark, sf), MAX_ZOOM, LIMIT, GRID, strategy)


@query(f"WITH {A_SQL} SELECT z, tx, ty, id, category, importance, is_leaf FROM pyr")
def tile_pyramid_stratified(spark, sf):
    return pyramid(spark, sf).select("z", "tx", "ty", "id", "category", "importance", "is_leaf")


@query(f"WITH {A_SQL}, nv AS (SELECT *, row_number() OVER (PARTITION BY z, tx, ty ORDER BY importance DESC, id) AS rn FROM a WHERE z < {MAX_ZOOM}) SELECT z, tx, ty, id, importance FROM nv WHERE rn <= {LIMIT} UNION ALL SELECT z, tx, ty, id, importance FROM a WHERE z = {MAX_ZOOM}")
def tile_pyramid_naive(spark, sf):
    return pyramid(spark, sf, "naive").select("z", "tx", "ty", "id", "importance")


@query(f"WITH {A_SQL} SELECT id, count(*) AS leaf_tiles FROM pyr WHERE is_leaf GROUP BY id")
def tile_leaf_cover(spark, sf):
    return pyramid(spark, sf).filter("is_leaf").groupBy("id").agg(F.count("*").alias("leaf_tiles"))


@query(f"WITH {A_SQL} SELECT z, count(DISTINCT (tx, ty)) AS tiles, count(*) AS points FROM pyr GROUP BY z")
def tile_stats_per_zoom(spark, sf):
    return tiles.stats_per_zoom(pyramid(spark, sf))


@query(f"WITH {A_SQL} SELECT DISTINCT z, tx, ty, round(bx0, 6) AS x0, round(by0, 6) AS y0, round(bx1, 6) AS x1, round(by1, 6) AS y1 FROM c")
def tile_bounds(spark, sf):
    a = tiles.assign(points(spark, sf), MAX_ZOOM)
    b = tiles.tile_bounds(F.col("z"), F.col("tx"), F.col("ty"), tuple(F.col(c) for c in ("minx", "miny", "maxx", "maxy")))
    return a.select("z", "tx", "ty", *[F.round(c, 6).alias(n) for c, n in zip(b, ("x0", "y0", "x1", "y1"))]).distinct()


VIEW = (-0.1, -0.12, 0.08, 0.15)
_VC = [_cell(f"{v}::DOUBLE", lo, hi, "4") for v, lo, hi in zip(VIEW, ("minx", "miny", "minx", "miny"), ("maxx", "maxy", "maxx", "maxy"))]


@query(f"WITH {A_SQL}, v AS (SELECT {_VC[0]} AS x0, {_VC[1]} AS y0, {_VC[2]} AS x1, {_VC[3]} AS y1 FROM b) SELECT pyr.z, pyr.tx, pyr.ty, id FROM pyr, v WHERE pyr.z = 2 AND tx BETWEEN x0 AND x1 AND ty BETWEEN y0 AND y1")
def viewport_tiles(spark, sf):
    p = points(spark, sf)
    wanted = tiles.viewport_tiles(tiles.root_box(p), 2, VIEW)
    return pyramid(spark, sf).filter("z = 2").join(wanted, ["z", "tx", "ty"]).select("z", "tx", "ty", "id")


@query(f"WITH {A_SQL}, o AS (SELECT z, {_cell('x', 'minx', 'maxx', '32')} * 32 + {_cell('y', 'miny', 'maxy', '32')} AS c FROM pyr, b) SELECT z, count(DISTINCT c) AS cells, round(count(DISTINCT c) / 1024.0::DOUBLE, 6) AS share FROM o GROUP BY z")
def selection_occupancy(spark, sf):
    p = points(spark, sf)
    return tiles.occupancy(pyramid(spark, sf), tiles.root_box(p))


@query("SELECT doc_id, n_chars, CASE WHEN count(*) OVER () = 1 THEN 65535 ELSE round_even((row_number() OVER (ORDER BY n_chars, doc_id) - 1)::DOUBLE / (count(*) OVER () - 1) * 65535, 0)::INT END AS importance FROM documents")
def importance_rank(spark, sf):
    return tiles.importance_rank(read(spark, sf, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id")


@query(f"WITH {A_SQL} SELECT z, tx, ty, id, category, importance FROM pyr")
def tile_encode_roundtrip(spark, sf):
    p = pyramid(spark, sf)
    return tables.decode_tiles(tables.encode_tiles(p, compress=True)).select("z", "tx", "ty", "id", "category", "importance")


@query(f"WITH {A_SQL} SELECT z, tx, ty, id, category AS cluster, importance FROM pyr")
def tile_json_roundtrip(spark, sf):
    return tables.tiles_from_json(tables.tiles_as_json(pyramid(spark, sf))).select("z", "tx", "ty", "id", "cluster", "importance")


@query(f"WITH {A_SQL} SELECT (SELECT count(*) FROM pyr) AS records, (SELECT count(*) FROM p) AS points, round((SELECT count(*) FROM pyr)::DOUBLE / (SELECT count(*) FROM p), 6) AS redundancy")
def tile_redundancy(spark, sf):
    return tiles.redundancy(pyramid(spark, sf), points(spark, sf)).withColumn("redundancy", F.round("redundancy", 6))


@query("SELECT vec_id::BIGINT AS id, lpad((vec_id // 4096)::VARCHAR, 4, '0') AS shard FROM embeddings")
def shard_names(spark, sf):
    return tables.with_shard(read(spark, sf, "embeddings").select(F.col("vec_id").cast("long").alias("id")))


# -- catalog -----------------------------------------------------------------------

ENDINGS = [" Demo", " - DLC", " (DLC)", " OST", " Soundtrack Edition", " Artbook", " DLC Quest", " Movie", ""]
_PATTERN = "(?i)(" + "|".join(fixed.NAME_ANYWHERE + fixed.NAME_ANCHORED) + ")"
_GENRES = ", ".join(f"'{g}'" for g in fixed.SOFTWARE_GENRES)
D_SQL = f"""d0 AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'x' || doc_id ELSE doc_id::VARCHAR END AS raw_id, trim(split_part(text, chr(10), 1)) || (list_value({', '.join(f"'{e}'" for e in ENDINGS)}))[doc_id % {len(ENDINGS)} + 1] AS name,
 CASE doc_id % 5 WHEN 0 THEN 'Utilities' WHEN 1 THEN 'Documentary' ELSE 'Action' END AS g1, CASE doc_id % 2 WHEN 0 THEN 'Movie' ELSE 'Action' END AS g2, n_chars FROM documents),
d AS (SELECT *, CASE WHEN try_cast(raw_id AS BIGINT) IS NULL THEN 'bad_appid' WHEN length(trim(coalesce(name, ''))) = 0 THEN 'no_name' WHEN regexp_matches(name, '{_PATTERN}') THEN 'name_pattern'
 WHEN g1 IN ({_GENRES}) AND g2 IN ({_GENRES}) THEN 'software_genre' WHEN coalesce(n_chars, 0) < 500 THEN 'few_reviews' END AS reason FROM d0)"""


def items(spark, sf):
    end = F.element_at(F.array(*map(F.lit, ENDINGS)), (F.pmod("doc_id", F.lit(len(ENDINGS))) + 1).cast("int"))
    d = read(spark, sf, "documents").withColumn("name", F.concat(F.trim(F.split_part("text", F.lit("\n"), F.lit(1))), end))
    raw = F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("x"), F.col("doc_id").cast("string"))).otherwise(F.col("doc_id").cast("string"))
    first = F.when(F.col("doc_id") % 5 == 0, "Utilities").when(F.col("doc_id") % 5 == 1, "Documentary").otherwise("Action")
    genres = F.array(first, F.when(F.col("doc_id") % 2 == 0, "Movie").otherwise("Action"))
    return d.withColumn("reason", catalog.drop_reason(F.col("name"), genres, F.col("n_chars"), least=500, item_id=raw))


@query(f"WITH {D_SQL} SELECT reason, count(*) AS n FROM d WHERE reason IS NOT NULL GROUP BY reason")
def drop_reasons(spark, sf):
    return catalog.drop_counts(items(spark, sf))


@query(f"WITH {D_SQL} SELECT doc_id, name, n_chars FROM d WHERE reason IS NULL")
def kept_items(spark, sf):
    return items(spark, sf).filter("reason IS NULL").select("doc_id", "name", "n_chars")


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages")
def html_clean(spark, sf):
    return read(spark, sf, "pages").select("page_id", scalar.clean_html(F.col("html")).alias("text"))


@query("SELECT p_partkey, list_filter(list_transform(string_split(replace(p_name, ' ', ','), ','), lambda t: trim(t)), lambda t: t <> '')::VARCHAR[] AS tags FROM part")
def tag_parse(spark, sf):
    return read(spark, sf, "part").select("p_partkey", scalar.parse_tags(F.replace("p_name", F.lit(" "), F.lit(","))).alias("tags"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf):
    return read(spark, sf, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


T_SQL = """w AS (SELECT doc_id AS item, unnest(regexp_extract_all(lower(text), '[a-zà-ÿ]+')) AS tag FROM documents),
cnt AS (SELECT item, tag, count(*) AS votes FROM w GROUP BY item, tag),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY votes DESC, tag) - 1 AS rank FROM cnt) WHERE rank < 20)"""


def profile(spark, sf):
    return catalog.tag_profile(read(spark, sf, "documents"))


def kept_profile(spark, sf):
    """The profile as a table, for queries that use it more than once."""
    return stored(profile(spark, sf), "profile")


@query(f"WITH {T_SQL} SELECT item, tag, votes, rank FROM t")
def tag_profile(spark, sf):
    return profile(spark, sf)


@query(f"WITH {T_SQL} SELECT tag, count(*) AS n FROM t GROUP BY tag ORDER BY n DESC, tag LIMIT 20")
def tag_frequency_top(spark, sf):
    return profile(spark, sf).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(20)


@query(f"WITH {T_SQL}, s AS (SELECT item, count(*) AS k FROM t GROUP BY item) SELECT count(*) AS rows_, round(avg((k >= 3)::INT), 6) AS coverage, count(*) >= 100 AND avg((k >= 3)::INT) >= 0.8 AS passed FROM s")
def tag_coverage(spark, sf):
    s = profile(spark, sf).groupBy("item").agg(F.collect_list("tag").alias("tags"))
    return catalog.acceptance(s, least_rows=100).select(F.col("rows").alias("rows_"), F.round("coverage", 6).alias("coverage"), "passed")


@query("SELECT n_chars AS upper_median FROM (SELECT n_chars, row_number() OVER (ORDER BY n_chars) AS k, count(*) OVER () AS n FROM documents) WHERE k = n // 2 + 1")
def upper_median(spark, sf):
    return catalog.upper_median(read(spark, sf, "documents"), "n_chars")


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice::DOUBLE, 0.5), 6) AS median, round(quantile_cont(l_extendedprice::DOUBLE, 0.05), 6) AS p05, round(quantile_cont(l_extendedprice::DOUBLE, 0.95), 6) AS p95 FROM lineitem GROUP BY l_returnflag")
def percentiles(spark, sf):
    return read(spark, sf, "lineitem").groupBy("l_returnflag").agg(*[F.round(F.percentile("l_extendedprice", p), 6).alias(n) for p, n in ((0.5, "median"), (0.05, "p05"), (0.95, "p95"))])


@query("SELECT lang, count(*) AS n, count_if(length(text) > 1000) AS long_texts, count(DISTINCT source) AS sources FROM documents GROUP BY lang")
def field_stats(spark, sf):
    return read(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.length("text") > 1000).alias("long_texts"), F.count_distinct("source").alias("sources"))


def users(spark, sf):
    e = read(spark, sf, "events")
    return e.groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("review_count"), F.array_sort(F.collect_set("event_type")).alias("tags"))


def done(spark, sf):
    last = catalog.upsert_latest(read(spark, sf, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")])
    return last.filter("event_type = 'error'").select(F.col("user_id").alias("id"))


U_SQL = "u AS (SELECT user_id AS id, count(*) AS review_count, count(DISTINCT event_type) AS n_tags FROM events GROUP BY user_id), dn AS (SELECT user_id AS id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1 AND event_type = 'error')"


@query(f"WITH {U_SQL} SELECT id, review_count, n_tags < 5 AS is_gap FROM u WHERE id NOT IN (SELECT id FROM dn) ORDER BY is_gap DESC, review_count DESC, id LIMIT 50")
def worklist_all(spark, sf):
    return catalog.worklist(users(spark, sf), done(spark, sf), limit=50, least=5).select("id", "review_count", "is_gap")


@query(f"WITH {U_SQL} SELECT id, review_count FROM u WHERE id NOT IN (SELECT id FROM dn) AND n_tags < 5")
def worklist_gaps(spark, sf):
    return catalog.worklist(users(spark, sf), done(spark, sf), "gaps", least=5).select("id", "review_count")


@query("SELECT user_id AS id, count(*) AS tries FROM events WHERE event_type = 'error' GROUP BY user_id HAVING count(*) < 12")
def retry_queue(spark, sf):
    f = read(spark, sf, "events").filter("event_type = 'error'").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("tries"))
    return catalog.retry_queue(f, most=12)


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def upsert_latest(spark, sf):
    return catalog.upsert_latest(read(spark, sf, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("WITH f AS (SELECT user_id AS id, count(*) AS n, arg_max('e' || event_id, (ts, event_id)) AS s FROM events WHERE event_type = 'error' GROUP BY user_id), k AS (SELECT c_custkey AS id, 'old' AS status, 1 + c_custkey % 3 AS tries FROM customer) SELECT coalesce(f.id, k.id) AS id, coalesce(s, status) AS status, coalesce(tries, 0) + coalesce(n, 0) AS tries FROM f FULL JOIN k ON f.id = k.id")
def failure_counter(spark, sf):
    known = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit("old").alias("status"), (1 + F.col("c_custkey") % 3).cast("long").alias("tries"))
    ev = read(spark, sf, "events").filter("event_type = 'error'").select(F.col("user_id").alias("id"), F.struct("ts", "event_id").alias("at"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("status"))
    return catalog.count_failures(known, ev)


@query("SELECT d.doc_id, coalesce(b.text, '') AS short_desc FROM documents d LEFT JOIN benchmark b ON d.doc_id = b.item_id")
def short_desc_join(spark, sf):
    b = read(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("s"))
    return read(spark, sf, "documents").select("doc_id").join(b, "doc_id", "left").select("doc_id", F.coalesce("s", F.lit("")).alias("short_desc"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def probe_semi(spark, sf):
    return read(spark, sf, "documents").select("doc_id", "lang").join(read(spark, sf, "labels").filter("quality = 1").select("doc_id"), "doc_id", "left_semi")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def missing_anti(spark, sf):
    return read(spark, sf, "documents").select("doc_id", "lang").join(read(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT 'a' AS part, doc_id FROM documents WHERE n_chars > 5000 UNION ALL SELECT 'b', doc_id FROM documents WHERE n_chars <= 200")
def concat_parts(spark, sf):
    d = read(spark, sf, "documents")
    part = lambda p, c: d.filter(c).select(F.lit(p).alias("part"), "doc_id")
    return part("a", "n_chars > 5000").unionByName(part("b", "n_chars <= 200"))


@query("SELECT o_orderkey, year(o_orderdate) AS release_year, CASE WHEN o_totalprice IS NULL THEN NULL WHEN o_totalprice = 0 THEN 'Free' ELSE printf('$%.2f', o_totalprice) END AS price FROM orders")
def year_and_price(spark, sf):
    o = read(spark, sf, "orders")
    return o.select("o_orderkey", scalar.year_of(F.date_format("o_orderdate", "d MMM, yyyy")).alias("release_year"), scalar.price_text(F.col("o_totalprice")).alias("price"))


# -- vectors and neighbours -----------------------------------------------------------

W_SQL = T_SQL + ", wt AS (SELECT item, tag, 1.0::DOUBLE / (1.0::DOUBLE + 0.05::DOUBLE * rank) AS w FROM t), tot AS (SELECT sum(w) AS total FROM wt), wi AS (SELECT item, sum(w) AS wi FROM wt GROUP BY item), tg AS (SELECT tag, sum(w) AS wt, pow(sum(w) / any_value(total), 0.75::DOUBLE) AS s FROM wt, tot GROUP BY tag), nm AS (SELECT sum(s) AS norm FROM tg), pp AS (SELECT wt.item, wt.tag, ln((w / total) / ((wi / total) * (s / norm))) AS ppmi FROM wt JOIN wi USING (item) JOIN tg USING (tag), tot, nm)"


def weights(spark, sf):
    return kept_profile(spark, sf).select("item", "tag", vectors.rank_weight(F.col("rank")).alias("w"))


@query(f"WITH {W_SQL} SELECT item, tag, round(ppmi, 6) AS ppmi FROM pp WHERE ppmi > 0")
def ppmi_weights(spark, sf):
    return vectors.ppmi(weights(spark, sf)).select("item", "tag", F.round("ppmi", 6).alias("ppmi"))


@query(f"WITH {W_SQL} SELECT tag, round(sum(w), 6) AS weight FROM wt GROUP BY tag")
def ppmi_marginals(spark, sf):
    return weights(spark, sf).groupBy("tag").agg(F.round(F.sum("w"), 6).alias("weight"))


def vecs(spark, sf):
    return read(spark, sf, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("features"), F.col("label").cast("long").alias("label"))


K_SQL = """v AS (SELECT vec_id::BIGINT AS id, list_transform(embedding, lambda q: q::DOUBLE) AS f, label::BIGINT AS label FROM embeddings),
vn AS (SELECT *, greatest(sqrt(list_dot_product(f, f)), 1e-9::DOUBLE) AS nm FROM v),
kn AS (SELECT * FROM (SELECT a.id AS src, b.id AS dst, list_dot_product(a.f, b.f) / (a.nm * b.nm) AS sim, row_number() OVER (PARTITION BY a.id ORDER BY list_dot_product(a.f, b.f) / (a.nm * b.nm) DESC, b.id) AS rank FROM vn a, vn b WHERE a.id <> b.id) WHERE rank <= 10)"""


def knn(spark, sf):
    return neighbours.knn_cosine(vecs(spark, sf), 10)


@query(f"WITH {K_SQL} SELECT src, dst, rank, round(sim, 6) AS sim FROM kn")
def knn_cosine(spark, sf):
    return knn(spark, sf).select("src", "dst", "rank", F.round("sim", 6).alias("sim"))


@query()
def knn_index(spark, sf):
    return neighbours.knn_index(vecs(spark, sf), 10)


@query(f"WITH {K_SQL} SELECT least(src, dst) AS a, greatest(src, dst) AS b, round(max(sim), 6) AS w FROM kn WHERE sim > 0 GROUP BY 1, 2")
def knn_graph(spark, sf):
    return neighbours.knn_graph(knn(spark, sf)).select("a", "b", F.round("w", 6).alias("w"))


@query(f"WITH {K_SQL}, cx AS (SELECT label AS g, i, avg(f[i]) AS m FROM v, (SELECT unnest(range(1, 65)) AS i) GROUP BY label, i), cc AS (SELECT g, list(m ORDER BY i) AS c FROM cx GROUP BY g), sm AS (SELECT id, g, list_dot_product(f, c) / greatest(nm * sqrt(list_dot_product(c, c)), 1e-9::DOUBLE) AS sim FROM vn, cc) SELECT id, g AS \"group\", round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, g) AS k FROM sm) WHERE k = 1")
def nearest_centroid(spark, sf):
    v = vecs(spark, sf)
    return neighbours.nearest_centroid(v, neighbours.centroids(v)).select("id", "group", F.round("sim", 6).alias("sim"))


@query(f"WITH {K_SQL}, k2 AS (SELECT * FROM (SELECT a.id AS src, b.id AS dst, row_number() OVER (PARTITION BY a.id ORDER BY (a.f[1]*b.f[1] + a.f[2]*b.f[2]) / (greatest(sqrt(a.f[1]*a.f[1] + a.f[2]*a.f[2]), 1e-9::DOUBLE) * greatest(sqrt(b.f[1]*b.f[1] + b.f[2]*b.f[2]), 1e-9::DOUBLE)) DESC, b.id) AS rank FROM vn a, vn b WHERE a.id <> b.id) WHERE rank <= 10), o AS (SELECT src, count(*) AS n FROM kn JOIN k2 USING (src, dst) GROUP BY src) SELECT src, round(coalesce(n, 0) / 10.0::DOUBLE, 6) AS overlap FROM (SELECT DISTINCT src FROM kn) LEFT JOIN o USING (src)")
def knn_overlap_2d(spark, sf):
    flat = vecs(spark, sf).withColumn("features", F.slice("features", 1, 2))
    return neighbours.overlap(knn(spark, sf), neighbours.knn_cosine(flat, 10), 10).select("src", F.round("overlap", 6).alias("overlap"))


GR_SQL = "gr AS (SELECT vec_id::BIGINT AS id, CASE WHEN vec_id % 9 = 0 THEN []::BIGINT[] ELSE list_sort(list_distinct([label::BIGINT, (10 + vec_id % 4)::BIGINT])) END AS gs FROM embeddings)"


@query(f"WITH {K_SQL}, {GR_SQL}, h AS (SELECT * FROM gr WHERE len(gs) > 0), ag AS (SELECT avg(list_has_any(a.gs, b.gs)::INT) AS agreement FROM kn JOIN h a ON a.id = src JOIN h b ON b.id = dst), bs AS (SELECT avg(list_has_any(a.gs, b.gs)::INT) AS baseline FROM h a JOIN h b ON a.id <> b.id) SELECT round(agreement, 6) AS agreement, round(baseline, 6) AS baseline, round(agreement / baseline, 6) AS lift FROM ag, bs")
def label_agreement_lift(spark, sf):
    v = vecs(spark, sf)
    groups = F.when(F.col("id") % 9 == 0, F.array().cast("array<bigint>")).otherwise(F.array("label", 10 + F.col("id") % 4))
    return neighbours.agreement_lift(knn(spark, sf), v.select("id", groups.alias("groups"))).select(*[F.round(c, 6).alias(c) for c in ("agreement", "baseline", "lift")])


@query(f"WITH {K_SQL}, {T_SQL}, gen AS (SELECT tag FROM t GROUP BY tag ORDER BY count(*) DESC, tag LIMIT 12), f1 AS (SELECT item, tag FROM t WHERE rank = 0 AND tag NOT IN (SELECT tag FROM gen)) SELECT count(*) AS pairs, round(avg((t.tag IS NOT NULL)::INT), 6) AS agreement FROM kn JOIN f1 ON f1.item = src LEFT JOIN t ON t.item = dst AND t.tag = f1.tag")
def top_tag_agreement(spark, sf):
    return neighbours.top_tag_agreement(knn(spark, sf), profile(spark, sf)).select("pairs", F.round("agreement", 6).alias("agreement"))


M_SQL = ", mk AS (SELECT t.item, t.tag FROM t JOIN (SELECT item, count(*) AS n FROM t GROUP BY item HAVING count(*) >= 4) q ON t.item = q.item AND t.rank = 1 + t.item % (least(n, 10) - 1))"


@query(f"WITH {K_SQL}, {T_SQL}{M_SQL}, vt AS (SELECT src, t.tag, sum(1.0::DOUBLE / k.rank) AS votes FROM kn k JOIN mk ON mk.item = src JOIN t ON t.item = dst GROUP BY src, t.tag), sh AS (SELECT t.item, t.tag FROM t WHERE NOT EXISTS (SELECT 1 FROM mk WHERE mk.item = t.item AND mk.tag = t.tag)), bt AS (SELECT src, tag FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(votes, 9) DESC, tag) AS k FROM vt WHERE NOT EXISTS (SELECT 1 FROM sh WHERE sh.item = src AND sh.tag = vt.tag)) WHERE k <= 5) SELECT (SELECT count(*) FROM bt JOIN mk ON mk.item = src AND mk.tag = bt.tag) AS hits, (SELECT count(*) FROM mk) AS n")
def masked_tag_precision(spark, sf):
    p = kept_profile(spark, sf)
    return neighbours.masked_precision(knn(spark, sf), p, neighbours.masked_tags(p)).select("hits", "n")


@query(f"WITH {K_SQL}, h AS (SELECT id, list_concat(list_transform(f[1:32], lambda q: q / greatest(sqrt(list_dot_product(f[1:32], f[1:32])), 1e-9::DOUBLE) * 0.3::DOUBLE), list_transform(f[33:64], lambda q: q / greatest(sqrt(list_dot_product(f[33:64], f[33:64])), 1e-9::DOUBLE) * 0.7::DOUBLE)) AS f FROM v) SELECT id, i - 1 AS pos, round(f[i], 6) AS value FROM h, (SELECT unnest(range(1, 65)) AS i)")
def hybrid_vectors(spark, sf):
    v = vecs(spark, sf)
    a = v.select("id", scalar.l2_normalise(F.slice("features", 1, 32)).alias("a"))
    b = v.select("id", scalar.l2_normalise(F.slice("features", 33, 32)).alias("b"))
    h = a.join(b, "id").select("id", F.posexplode(scalar.weighted_concat(F.col("a"), F.col("b"), 0.3)).alias("pos", "value"))
    return h.select("id", F.col("pos").cast("long").alias("pos"), F.round("value", 6).alias("value"))


@query()
def svd_embedding(spark, sf):
    v, _ = vectors.svd_embedding(vectors.ppmi(weights(spark, sf)), 128)
    return v


@query()
def pca_embedding(spark, sf):
    return vectors.pca(vecs(spark, sf).select(F.col("id").alias("item"), "features"), 50, "balanced", 32)[0]


@query()
def text_vectors(spark, sf):
    from pyspark.ml.functions import vector_to_array

    v = vectors.text_vectors(read(spark, sf, "documents"), 1024)
    each = v.select("item", F.posexplode(vector_to_array("features")).alias("pos", "value"))
    return each.filter("value <> 0").withColumn("value", F.round("value", 6))


@query()
def community_tree(spark, sf):
    nodes, members = hierarchy.community_tree(vecs(spark, sf).select(F.col("id").alias("item"), "features"))
    return members.groupBy("node").agg(F.count("*").alias("items")).join(nodes, "node", "right")


@query()
def kmeans_tree(spark, sf):
    nodes, members = hierarchy.kmeans_tree(vecs(spark, sf).select(F.col("id").alias("item"), "features"))
    return members.groupBy("node").agg(F.count("*").alias("items")).join(nodes, "node", "right")


@query()
def gated_tree(spark, sf):
    nodes, members = hierarchy.gated_tree(vecs(spark, sf).select(F.col("id").alias("item"), "features"))
    return members.groupBy("node").agg(F.count("*").alias("items")).join(nodes, "node", "right")


# -- trees ------------------------------------------------------------------------------


def doc_tree(spark, sf):
    """all, languages, sources within a language; documents are members of sources."""
    d = read(spark, sf, "documents").select("doc_id", F.coalesce("lang", F.lit("-")).alias("lang"), F.coalesce("source", F.lit("-")).alias("source"))
    pairs = d.select("lang", "source").distinct()
    nodes = (
        spark.sql("SELECT 'all' AS node, CAST(NULL AS STRING) AS parent, 'all' AS name")
        .unionByName(pairs.select("lang").distinct().select(F.col("lang").alias("node"), F.lit("all").alias("parent"), F.col("lang").alias("name")))
        .unionByName(pairs.select(F.concat_ws("/", "lang", "source").alias("node"), F.col("lang").alias("parent"), F.col("source").alias("name")))
    )
    return nodes, d.select(F.col("doc_id").alias("item"), F.concat_ws("/", "lang", "source").alias("node"))


TREE = """nd AS (SELECT 'all' AS node, NULL::VARCHAR AS parent, 'all' AS name UNION ALL SELECT DISTINCT lang, 'all', lang FROM documents UNION ALL SELECT DISTINCT lang || '/' || source, lang, source FROM documents),
mb AS (SELECT doc_id AS item, lang || '/' || source AS node FROM documents),
cl AS (WITH RECURSIVE q(node, ancestor, hops) AS (SELECT node, node, 0 FROM nd UNION ALL SELECT q.node, nd.parent, q.hops + 1 FROM q JOIN nd ON nd.node = q.ancestor WHERE nd.parent IS NOT NULL) SELECT * FROM q),
sz AS (SELECT ancestor AS node, count(item) AS size FROM cl LEFT JOIN mb ON mb.node = cl.node GROUP BY ancestor)"""


@query(f"WITH {TREE} SELECT node, ancestor, hops FROM cl")
def tree_closure(spark, sf):
    return hierarchy.closure(doc_tree(spark, sf)[0])


@query(f"WITH {TREE} SELECT cl.node, string_agg(name, ' > ' ORDER BY hops DESC) AS path FROM cl JOIN nd ON nd.node = cl.ancestor GROUP BY cl.node")
def tree_paths(spark, sf):
    n = doc_tree(spark, sf)[0]
    return hierarchy.paths(hierarchy.closure(n), n)


@query(f"WITH {TREE} SELECT node, size FROM sz")
def tree_size_rollup(spark, sf):
    n, m = doc_tree(spark, sf)
    return hierarchy.sizes(hierarchy.closure(n), m)


@query(f"WITH {TREE}, dp AS (SELECT node, max(hops) AS depth FROM cl GROUP BY node), ch AS (SELECT parent AS node, count(*) AS children FROM nd WHERE parent IS NOT NULL GROUP BY parent) SELECT depth, count(*) AS nodes, count_if(children IS NULL) AS leaves, round(avg(children), 6) AS fan_out, round(max(size)::DOUBLE / (SELECT max(size) FROM sz), 6) AS biggest_share FROM dp JOIN sz USING (node) LEFT JOIN ch USING (node) GROUP BY depth")
def tree_stats(spark, sf):
    n, m = doc_tree(spark, sf)
    c = hierarchy.closure(n)
    s = hierarchy.tree_stats(n, c, hierarchy.sizes(c, m))
    return s.select("depth", "nodes", "leaves", F.round("fan_out", 6).alias("fan_out"), F.round("biggest_share", 6).alias("biggest_share"))


L_SQL = f"""{T_SQL}, {TREE},
cv AS (SELECT x.ancestor AS node, t.tag AS term, count(*)::DOUBLE / any_value(sz.size) AS coverage FROM t JOIN mb ON mb.item = t.item JOIN cl x ON x.node = mb.node JOIN sz ON sz.node = x.ancestor GROUP BY x.ancestor, t.tag),
kd AS (SELECT parent, count(*) AS siblings FROM nd WHERE parent IS NOT NULL GROUP BY parent),
oc AS (SELECT cv.*, nd.parent, siblings, (sum(coverage) OVER (PARTITION BY nd.parent, term) - coverage) / CASE WHEN siblings > 1 THEN siblings - 1 END AS rest0 FROM cv JOIN nd ON nd.node = cv.node JOIN kd ON kd.parent = nd.parent),
sc0 AS (SELECT *, CASE WHEN abs(rest0) < 1e-12 THEN 0.0::DOUBLE ELSE rest0 END AS rest FROM oc),
sc AS (SELECT *, round(CASE WHEN siblings = 1 THEN coverage ELSE coverage * ln((coverage + 0.001::DOUBLE) / (rest0 + 0.001::DOUBLE)) END, 9) AS score FROM sc0),
tm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY score DESC, term) AS k FROM sc) WHERE k <= 10),
l1 AS (SELECT node, round(coverage, 4) AS coverage, round(CASE WHEN rest IS NULL OR rest <= 1e-9 THEN 999.0::DOUBLE ELSE least(coverage / rest, 999.0::DOUBLE) END, 3) AS lift FROM tm WHERE k = 1),
ph AS (SELECT node, string_agg(term, ' / ' ORDER BY k) AS label FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY k) AS p FROM tm WHERE score > 0) WHERE p <= 3 GROUP BY node),
lb AS (SELECT l1.node, coalesce(label, 'unnamed') AS label, coverage, lift, CASE WHEN coverage < 0.25 THEN 'none' WHEN lift >= 4 THEN 'strong' WHEN lift >= 2 THEN 'normal' ELSE 'weak' END AS confidence FROM l1 LEFT JOIN ph USING (node))"""


def label_parts(spark, sf):
    n, m = doc_tree(spark, sf)
    covered = hierarchy.coverage(hierarchy.closure(n), m, profile(spark, sf))
    return n, hierarchy.sibling_terms(n, covered), covered


@query(f"WITH {L_SQL} SELECT node, term, round(coverage, 6) AS coverage FROM cv")
def node_coverage(spark, sf):
    return label_parts(spark, sf)[2].select("node", "term", F.round("coverage", 6).alias("coverage"))


@query(f"WITH {L_SQL} SELECT node, k, term, round(score, 6) AS score FROM tm")
def sibling_terms(spark, sf):
    return label_parts(spark, sf)[1].select("node", "k", "term", F.round("score", 6).alias("score"))


@query(f"WITH {L_SQL} SELECT node, label, coverage, lift, confidence FROM lb")
def label_quality(spark, sf):
    return hierarchy.label_quality(label_parts(spark, sf)[1])


@query(f"WITH {L_SQL}, tp AS (SELECT node, term FROM tm WHERE k = 1) SELECT nd.node, CASE WHEN a.term = b.term THEN 'repeat' WHEN EXISTS (SELECT 1 FROM tm WHERE tm.node = nd.parent AND tm.term = a.term) THEN 'refinement' ELSE 'novel' END AS relation FROM nd JOIN tp a ON a.node = nd.node JOIN tp b ON b.node = nd.parent")
def path_relation(spark, sf):
    n, terms, _ = label_parts(spark, sf)
    return hierarchy.path_relation(n, terms)


@query(f"WITH {L_SQL} SELECT confidence, count(*) AS nodes, sum(size) AS items FROM lb JOIN sz USING (node) GROUP BY confidence")
def confidence_tiers(spark, sf):
    n, m = doc_tree(spark, sf)
    size = hierarchy.sizes(hierarchy.closure(n), m)
    return label_quality(spark, sf).join(size, "node").groupBy("confidence").agg(F.count("*").alias("nodes"), F.sum("size").alias("items"))


@query("WITH f AS (SELECT vec_id AS item, label * 3 + vec_id % 3 AS fine, CASE WHEN vec_id % 11 = 0 THEN (label + 1) % 4 ELSE label % 4 END AS coarse FROM embeddings), n AS (SELECT fine, count(*) AS n FROM f GROUP BY fine), c AS (SELECT fine, coarse, count(*) AS c, row_number() OVER (PARTITION BY fine ORDER BY count(*) DESC, coarse) AS k FROM f GROUP BY fine, coarse) SELECT fine, coarse, round(c::DOUBLE / n, 6) AS purity, c::DOUBLE / n < 0.9 AS straddles FROM c JOIN n USING (fine) WHERE k = 1")
def containment_nesting(spark, sf):
    e = read(spark, sf, "embeddings").select(F.col("vec_id").alias("item"), (F.col("label") * 3 + F.col("vec_id") % 3).alias("fine"), F.when(F.col("vec_id") % 11 == 0, (F.col("label") + 1) % 4).otherwise(F.col("label") % 4).alias("coarse"))
    return hierarchy.nesting(e.select("item", "fine"), e.select("item", "coarse")).withColumn("purity", F.round("purity", 6))


@query("WITH n(node, parent, bb, cc, label, size) AS (VALUES (1, NULL, 4, 2, 'a', 9), (2, 1, 4, 2, 'b', 5), (3, 99, 4, 2, 'c', 1), (4, 5, 4, 2, 'd', 1), (5, 4, 3, 2, 'e', 1), (6, 2, 4, 1, 'f', 1), (7, 98, 3, 1, NULL, NULL), (8, 1, 4, 2, 'h', NULL)) SELECT node::BIGINT AS node, 'parent ' || parent || ' not in manifest' AS problem FROM n WHERE parent = 99 UNION ALL SELECT node::BIGINT, 'bbox is not 4 numbers' FROM n WHERE bb <> 4 AND size IS NOT NULL UNION ALL SELECT node::BIGINT, 'centroid is not 2 numbers' FROM n WHERE cc <> 2 AND size IS NOT NULL UNION ALL SELECT node::BIGINT, 'cycle' FROM n WHERE node IN (4, 5) UNION ALL SELECT node::BIGINT, 'missing ' || concat_ws(', ', CASE WHEN label IS NULL THEN 'label' END, CASE WHEN size IS NULL THEN 'size' END) FROM n WHERE size IS NULL")
def manifest_validate(spark, sf):
    rows = spark.sql("SELECT CAST(node AS BIGINT) AS node, CAST(parent AS BIGINT) AS parent, array_repeat(0.0D, bb) AS bbox, array_repeat(0.0D, cc) AS centroid, label, CAST(size AS BIGINT) AS size FROM VALUES (1, NULL, 4, 2, 'a', 9), (2, 1, 4, 2, 'b', 5), (3, 99, 4, 2, 'c', 1), (4, 5, 4, 2, 'd', 1), (5, 4, 3, 2, 'e', 1), (6, 2, 4, 1, 'f', 1), (7, 98, 3, 1, NULL, NULL), (8, 1, 4, 2, 'h', NULL) AS n(node, parent, bb, cc, label, size)")
    return hierarchy.validate_manifest(rows)


# -- layout -------------------------------------------------------------------------------


def flat(spark, sf):
    return read(spark, sf, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), F.col("label").cast("long").alias("label"), (F.col("label") % 2).cast("long").alias("parity"))


FL = "fl AS (SELECT vec_id::BIGINT AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, label::BIGINT AS label, (label % 2)::BIGINT AS parity FROM embeddings)"


@query(f"WITH {FL} SELECT 'all' AS node, round(min(x), 6) AS x0, round(min(y), 6) AS y0, round(max(x), 6) AS x1, round(max(y), 6) AS y1, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, count(*) AS n FROM fl UNION ALL SELECT 'p' || parity, round(min(x), 6), round(min(y), 6), round(max(x), 6), round(max(y), 6), round(avg(x), 6), round(avg(y), 6), count(*) FROM fl GROUP BY parity UNION ALL SELECT 'l' || label, round(min(x), 6), round(min(y), 6), round(max(x), 6), round(max(y), 6), round(avg(x), 6), round(avg(y), 6), count(*) FROM fl GROUP BY label")
def node_bbox(spark, sf):
    f = flat(spark, sf)
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nodes = spark.sql("SELECT 'all' AS node, CAST(NULL AS STRING) AS parent").unionByName(f.select(name("p", "parity").alias("node"), F.lit("all").alias("parent")).distinct()).unionByName(f.select(name("l", "label").alias("node"), name("p", "parity").alias("parent")).distinct())
    members = f.select(F.col("id").alias("item"), name("l", "label").alias("node"))
    b = layout.node_bbox(hierarchy.closure(nodes), members, f)
    return b.select("node", *[F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1", "cx", "cy")], "n")


@query(f"WITH {FL} SELECT label, round(quantile_cont(x, 0.05), 6) AS x0, round(quantile_cont(y, 0.05), 6) AS y0, round(quantile_cont(x, 0.95), 6) AS x1, round(quantile_cont(y, 0.95), 6) AS y1 FROM fl GROUP BY label")
def core_bbox(spark, sf):
    return layout.core_bbox(flat(spark, sf), "label").select("label", *[F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query(f"WITH {FL} SELECT round(x, 6) AS value FROM (SELECT x, row_number() OVER (ORDER BY x) AS k, count(*) OVER () AS n FROM fl) WHERE k = floor((n - 1) * 0.9::DOUBLE) + 1")
def core_extent(spark, sf):
    return layout.index_quantile(flat(spark, sf), "x", 0.9).select(F.round("value", 6).alias("value"))


BX = f"{FL}, bx AS (SELECT label AS g, quantile_cont(x, 0.05) AS x0, quantile_cont(y, 0.05) AS y0, quantile_cont(x, 0.95) AS x1, quantile_cont(y, 0.95) AS y1 FROM fl GROUP BY label), bp AS (SELECT parity AS g, quantile_cont(x, 0.05) AS x0, quantile_cont(y, 0.05) AS y0, quantile_cont(x, 0.95) AS x1, quantile_cont(y, 0.95) AS y1 FROM fl GROUP BY parity)"


@query(f"WITH {BX} SELECT g AS label, round(avg((label = g)::INT), 6) AS purity FROM fl JOIN bx ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY g")
def bbox_purity(spark, sf):
    f = flat(spark, sf)
    return layout.box_purity(f, "label", layout.core_bbox(f, "label")).withColumn("purity", F.round("purity", 6))


@query(f"WITH {BX} SELECT label, round(avg((x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1)::INT), 6) AS containment FROM fl JOIN bp ON parity = g GROUP BY label")
def bbox_containment(spark, sf):
    f = flat(spark, sf)
    return layout.containment(f, "label", "parity", layout.core_bbox(f, "parity")).withColumn("containment", F.round("containment", 6))


@query(f"WITH {BX}, c AS (SELECT parity, label, avg((x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1)::INT) AS c FROM fl JOIN bp ON parity = g GROUP BY parity, label) SELECT parity, round(avg(c), 6) AS mean, round(quantile_cont(c, 0.5), 6) AS median, round(avg((c < 0.9)::INT), 6) AS below FROM c GROUP BY parity")
def per_depth_summary(spark, sf):
    f = flat(spark, sf)
    c = layout.containment(f, "label", "parity", layout.core_bbox(f, "parity")).withColumn("parity", F.col("label") % 2)
    return c.groupBy("parity").agg(F.round(F.avg("containment"), 6).alias("mean"), F.round(F.percentile("containment", 0.5), 6).alias("median"), F.round(F.avg((F.col("containment") < 0.9).cast("int")), 6).alias("below"))


@query()
def hull_purity(spark, sf):
    f = flat(spark, sf)
    hulls = layout.trimmed_hulls(f.select(F.col("label").cast("string").alias("node"), "x", "y"))
    j = f.join(hulls.filter("planes IS NOT NULL"), layout.inside(F.col("planes"), F.col("x"), F.col("y")))
    return j.groupBy("node").agg(F.round(F.avg((F.col("label").cast("string") == F.col("node")).cast("int")), 6).alias("purity"))


TS = f"{K_SQL}, cx AS (SELECT label AS g, i, avg(f[i]) AS m FROM v, (SELECT unnest(range(1, 65)) AS i) GROUP BY label, i), pr AS (SELECT a.g AS ga, b.g AS gb, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS dh, sqrt(sum(CASE WHEN a.i <= 2 THEN (a.m - b.m) * (a.m - b.m) ELSE 0 END)) AS dl FROM cx a JOIN cx b ON a.i = b.i AND a.g < b.g GROUP BY a.g, b.g)"


def territory_pairs(spark, sf):
    c = neighbours.centroids(vecs(spark, sf))
    j = c.join(c.withColumnsRenamed({"group": "other", "centroid": "oc"}), F.col("group") < F.col("other"))
    d = lambda n: F.sqrt(F.aggregate(F.zip_with(F.slice("centroid", 1, n), F.slice("oc", 1, n), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    return j.select("group", "other", d(64).alias("dh"), d(2).alias("dl"))


@query(f"WITH {TS}, rk AS (SELECT row_number() OVER (ORDER BY dh, ga, gb)::DOUBLE AS ra, row_number() OVER (ORDER BY dl, ga, gb)::DOUBLE AS rb FROM pr) SELECT round(corr(ra, rb), 6) AS spearman FROM rk")
def territory_spearman(spark, sf):
    return layout.territory_spearman(territory_pairs(spark, sf), "dh", "dl", ["group", "other"]).select(F.round("spearman", 6).alias("spearman"))


@query(f"WITH {K_SQL}, pr AS (SELECT a.id AS ia, b.id AS ib, sqrt(greatest(list_dot_product(a.f, a.f) + list_dot_product(b.f, b.f) - 2 * list_dot_product(a.f, b.f), 0)) AS d FROM v a JOIN v b ON a.id < b.id), nn AS (SELECT i, d, row_number() OVER (PARTITION BY i ORDER BY d) AS k FROM (SELECT ia AS i, d FROM pr UNION ALL SELECT ib, d FROM pr)) SELECT round((SELECT stddev_pop(d) / avg(d) FROM pr), 5) AS cv, round((SELECT quantile_cont(d, 0.95) / quantile_cont(d, 0.05) FROM nn WHERE k <= 10), 5) AS knn_contrast, round((SELECT avg(d) FROM pr), 5) AS mean_pairwise, round((SELECT avg(d) FROM nn WHERE k <= 10), 5) AS mean_knn")
def density_contrast(spark, sf):
    return neighbours.contrast(vecs(spark, sf)).select(*[F.round(c, 5).alias(c) for c in ("cv", "knn_contrast", "mean_pairwise", "mean_knn")])


# -- view -----------------------------------------------------------------------------------

VN = f"{TREE}, vn2 AS (SELECT nd.node, parent, (size::DOUBLE / (SELECT max(size) FROM sz)) * 0.3::DOUBLE AS f, nd.node LIKE '%/%' AS is_leaf, nd.node LIKE 'e%' AND nd.node NOT LIKE '%/%' AS pruned FROM nd JOIN sz USING (node))"


def view_nodes(spark, sf):
    n, m = doc_tree(spark, sf)
    c = hierarchy.closure(n)
    s = hierarchy.sizes(c, m)
    total = s.agg(F.max("size").alias("t"))
    leaf = F.col("node").contains("/")
    return n.join(s, "node").crossJoin(F.broadcast(total)).select("node", "parent", (F.col("size") / F.col("t") * 0.3).alias("f"), leaf.alias("is_leaf"), (F.col("node").startswith("e") & ~leaf).alias("pruned")), c


def _smooth(a, b, x):
    t = f"least(greatest((({x}) - {a}::DOUBLE) / ({b}::DOUBLE - {a}::DOUBLE), 0), 1)"
    return f"({t} * {t} * (3 - 2 * {t}))"


@query(f"WITH {VN}, s AS (SELECT * FROM vn2 WHERE parent = 'all' UNION ALL SELECT c.* FROM vn2 c JOIN vn2 p ON c.parent = p.node WHERE p.parent = 'all' AND (p.pruned OR p.f > 0.0012)), o AS (SELECT node, parent, least({_smooth(0.002, 0.005, 'f')}, CASE WHEN is_leaf THEN 1 ELSE 1 - {_smooth(0.175, 0.25, 'f')} END) AS opacity FROM s WHERE NOT pruned AND f > 0.002) SELECT node, round(opacity, 6) AS opacity FROM o WHERE opacity > 0.02")
def visible_labels(spark, sf):
    return view.visible_labels(view_nodes(spark, sf)[0]).select("node", F.round("opacity", 6).alias("opacity"))


@query(f"WITH {VN}, dp AS (SELECT node, max(hops) AS depth FROM cl GROUP BY node), up AS (SELECT cl.node, cl.ancestor, cl.hops, depth, NOT pruned AND f > 0.002 AND (is_leaf OR f < 0.25) AND hops < depth AS good FROM cl JOIN dp USING (node) JOIN vn2 ON vn2.node = cl.ancestor) SELECT node, coalesce(arg_min(ancestor, hops) FILTER (WHERE good), max(ancestor) FILTER (WHERE hops = greatest(depth - 1, 0))) AS active FROM up GROUP BY node")
def active_ancestor(spark, sf):
    n, c = view_nodes(spark, sf)
    return view.active_ancestor(c, n)


@query(f"WITH {FL}, q AS (SELECT id AS cursor, x + 0.01 AS qx, y - 0.01 AS qy FROM fl WHERE id % 50 = 0), c AS (SELECT cursor, id, row_number() OVER (PARTITION BY cursor ORDER BY (x - qx) * (x - qx) + (y - qy) * (y - qy), id) AS k FROM q JOIN fl ON (x - qx) * (x - qx) + (y - qy) * (y - qy) < 0.05::DOUBLE * 0.05::DOUBLE) SELECT q.cursor, coalesce(id, -1) AS id FROM q LEFT JOIN c ON c.cursor = q.cursor AND k = 1")
def nearest_point(spark, sf):
    f = flat(spark, sf)
    q = f.filter("id % 50 = 0").select(F.col("id").alias("cursor"), (F.col("x") + 0.01).alias("x"), (F.col("y") - 0.01).alias("y"))
    return view.nearest_point(q, f, 0.05)


@query(f"WITH {FL}, {K_SQL}, j AS (SELECT src, x, y FROM kn JOIN fl ON fl.id = dst), m AS (SELECT src, avg(x) AS mx, avg(y) AS my FROM j GROUP BY src HAVING count(*) >= 3), s AS (SELECT src, avg(sqrt((x - mx) * (x - mx) + (y - my) * (y - my))) / 2.0::DOUBLE AS spread FROM j JOIN m USING (src) GROUP BY src) SELECT src, round(spread, 6) AS spread, CASE WHEN spread < 0.05 THEN 'cohesive' WHEN spread < 0.14 THEN 'partly' ELSE 'scattered' END AS verdict FROM s")
def neighbour_verdict(spark, sf):
    return view.neighbour_verdict(knn(spark, sf), flat(spark, sf), 2.0).withColumn("spread", F.round("spread", 6))


@query("WITH i AS (SELECT p_partkey AS id, p_name AS name, lower(p_name) AS folded, p_size::BIGINT AS reviews FROM part), s AS (SELECT *, instr(folded, 're') AS pos FROM i), t AS (SELECT *, CASE WHEN pos = 1 THEN 0 WHEN substr(folded, pos - 1, 1) = ' ' THEN 1 ELSE 2 END AS tier FROM s WHERE pos > 0) SELECT id, name, tier, reviews FROM t ORDER BY tier, reviews DESC, id LIMIT 8")
def name_search(spark, sf):
    p = read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lower("p_name").alias("folded"), F.col("p_size").cast("long").alias("reviews"))
    return view.name_search(p, "Ré")


@query("WITH i AS (SELECT p_partkey AS id, lower(p_name) AS folded, p_size::BIGINT AS reviews FROM part), s AS (SELECT *, instr(folded, 'e') AS pos FROM i), t AS (SELECT *, CASE WHEN pos = 1 THEN 0 WHEN substr(folded, pos - 1, 1) = ' ' THEN 1 ELSE 2 END AS tier FROM s WHERE pos > 0) SELECT id, tier, reviews FROM t")
def name_search_tiers(spark, sf):
    p = read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lower("p_name").alias("folded"), F.col("p_size").cast("long").alias("reviews"))
    return view.name_search(p, "e", None).select("id", "tier", "reviews")


LS_SQL = f"{L_SQL}, tt AS (SELECT tm.node, k - 1 AS position, term AS folded, size FROM tm JOIN sz USING (node)), r AS (SELECT node, size, CASE WHEN folded = 'en' THEN 0 WHEN starts_with(folded, 'en') THEN 10 ELSE 20 END + position AS r FROM tt WHERE contains(folded, 'en')), lr AS (SELECT node, min(r) AS rank, max(size) AS size FROM r GROUP BY node)"


def found_labels(spark, sf, limit):
    n, m = doc_tree(spark, sf)
    t = label_parts(spark, sf)[1].join(hierarchy.sizes(hierarchy.closure(n), m), "node").select("node", (F.col("k") - 1).alias("position"), F.col("term").alias("folded"), "size")
    return view.label_search(t, "en", limit)


@query(f"WITH {LS_SQL} SELECT node, rank, size FROM lr ORDER BY rank, size DESC, node LIMIT 4")
def label_search(spark, sf):
    return found_labels(spark, sf, 4)


@query(f"WITH {LS_SQL} SELECT node, rank, size FROM lr")
def label_search_ranks(spark, sf):
    return found_labels(spark, sf, None)


@query(f"WITH {LS_SQL}, lt AS (SELECT 0 AS kind, node AS key, row_number() OVER (ORDER BY rank, size DESC, node) AS k FROM lr), i AS (SELECT p_partkey AS id, instr(lower(p_name), 'en') AS pos, lower(p_name) AS folded, p_size AS reviews FROM part), g AS (SELECT 1 AS kind, id::VARCHAR AS key, row_number() OVER (ORDER BY CASE WHEN pos = 1 THEN 0 WHEN substr(folded, pos - 1, 1) = ' ' THEN 1 ELSE 2 END, reviews DESC, id) AS k FROM i WHERE pos > 0) SELECT kind, key, k FROM (SELECT * FROM lt WHERE k <= 3 UNION ALL SELECT * FROM g) ORDER BY kind, k LIMIT 8")
def merged_results(spark, sf):
    p = read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lower("p_name").alias("folded"), F.col("p_size").cast("long").alias("reviews"))
    return view.merged_results(found_labels(spark, sf, 4), view.name_search(p, "en"))


@query("SELECT doc_id, trim(regexp_replace(lower(strip_accents(text)), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS folded FROM documents")
def fold_text(spark, sf):
    return read(spark, sf, "documents").select("doc_id", scalar.fold(F.col("text")).alias("folded"))


@query("SELECT c_custkey, CASE WHEN s >= 0.95 THEN 'Overwhelmingly positive' WHEN s >= 0.8 THEN 'Very positive' WHEN s >= 0.7 THEN 'Mostly positive' WHEN s >= 0.4 THEN 'Mixed' WHEN s >= 0.2 THEN 'Mostly negative' WHEN s >= 0.1 THEN 'Very negative' ELSE 'Overwhelmingly negative' END AS word, CASE WHEN s >= 0.7 THEN 'good' WHEN s >= 0.4 THEN 'mixed' ELSE 'bad' END AS class FROM (SELECT c_custkey, (c_custkey % 101) / 100.0::DOUBLE AS s FROM customer)")
def score_bands(spark, sf):
    c = read(spark, sf, "customer").withColumn("s", (F.col("c_custkey") % 101) / 100.0)
    return c.select("c_custkey", scalar.score_word(F.col("s")).alias("word"), scalar.score_class(F.col("s")).alias("class"))


@query("SELECT p_partkey, least(greatest(floor(log2(greatest(p_retailprice / 900.0::DOUBLE, 1)) + 0.4::DOUBLE), 0), 5)::INT AS level, CASE WHEN p_size / 1000.0 > 0.055 THEN 3 WHEN p_size / 1000.0 > 0.014 THEN 2 ELSE 1 END AS terms FROM part")
def level_of_detail(spark, sf):
    return read(spark, sf, "part").select("p_partkey", scalar.level_from_scale(F.col("p_retailprice"), 900.0, 5).alias("level"), scalar.terms_for_footprint(F.col("p_size") / 1000.0).alias("terms"))


@query("WITH c AS (SELECT lang, source, count(*)::DOUBLE AS n FROM documents GROUP BY lang, source), t AS (SELECT sum(n) AS t FROM c), a AS (SELECT lang, sum(n) AS na FROM c GROUP BY lang), b AS (SELECT source, sum(n) AS nb FROM c GROUP BY source), mi AS (SELECT sum(n / t * ln(n * t / (na * nb))) AS mi FROM c JOIN a USING (lang) JOIN b USING (source), t), ha AS (SELECT -sum(na / t * ln(na / t)) AS h FROM a, t), hb AS (SELECT -sum(nb / t * ln(nb / t)) AS h FROM b, t) SELECT round(mi / sqrt(ha.h * hb.h), 6) AS nmi FROM mi, ha, hb")
def label_nmi(spark, sf):
    d = read(spark, sf, "documents")
    c = d.groupBy("lang", "source").agg(F.count("*").cast("double").alias("n"))
    t = c.agg(F.sum("n").alias("t"))
    a, b = c.groupBy("lang").agg(F.sum("n").alias("na")), c.groupBy("source").agg(F.sum("n").alias("nb"))
    mi = c.join(a, "lang").join(b, "source").crossJoin(t).agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))).alias("mi"))
    h = lambda x, n, o: x.crossJoin(t).agg((-F.sum(F.col(n) / F.col("t") * F.log(F.col(n) / F.col("t")))).alias(o))
    return mi.crossJoin(h(a, "na", "ha")).crossJoin(h(b, "nb", "hb")).select(F.round(F.col("mi") / F.sqrt(F.col("ha") * F.col("hb")), 6).alias("nmi"))


# -- more of the catalog ----------------------------------------------------------------------

STAMP = "2024-01-01T00:00:00+00:00"


@query("WITH o AS (SELECT c_custkey AS id, [c_mktsegment] AS tags, c_custkey % 7 AS review_count, 0.5::DOUBLE AS review_score FROM customer), n AS (SELECT user_id AS id, count(DISTINCT event_type) FILTER (WHERE event_type <> 'error') AS n_tags, string_agg(DISTINCT event_type, ',' ORDER BY event_type) FILTER (WHERE event_type <> 'error') AS tags, count(*) FILTER (WHERE event_type = 'purchase') AS pos, count(*) FILTER (WHERE event_type = 'error') AS neg FROM events GROUP BY user_id) SELECT o.id, CASE WHEN n_tags > 0 THEN n.tags ELSE o.tags[1] END AS tags, CASE WHEN pos + neg > 0 THEN pos + neg ELSE review_count END AS review_count, round(CASE WHEN pos + neg > 0 THEN pos::DOUBLE / (pos + neg) ELSE review_score END, 6) AS review_score, CASE WHEN n_tags > 0 THEN '" + STAMP + "' END AS fetched_at FROM o LEFT JOIN n ON n.id = o.id")
def item_update(spark, sf):
    old = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.array("c_mktsegment").alias("tags"), (F.col("c_custkey") % 7).alias("review_count"), F.lit(0.5).alias("review_score"), F.lit(None).cast("string").alias("fetched_at"))
    new = looked_up(spark, sf)
    u = catalog.update_if_found(old, new, F.lit(STAMP))
    return u.select("id", F.array_join("tags", ",").alias("tags"), "review_count", F.round("review_score", 6).alias("review_score"), "fetched_at")


def looked_up(spark, sf):
    good = F.when(F.col("event_type") != "error", F.col("event_type"))
    return read(spark, sf, "events").groupBy(F.col("user_id").alias("id")).agg(F.array_sort(F.collect_set(good)).alias("tags"), F.count_if(F.col("event_type") == "purchase").alias("positive"), F.count_if(F.col("event_type") == "error").alias("negative"))


@query("SELECT user_id AS id, '" + STAMP + "' AS fetched_at, count(DISTINCT event_type) FILTER (WHERE event_type <> 'error') AS n_tags FROM events GROUP BY user_id")
def crawl_log(spark, sf):
    return catalog.crawl_log(looked_up(spark, sf), F.lit(STAMP)).withColumn("n_tags", F.col("n_tags").cast("long"))


@query("SELECT user_id AS id, count(*) AS tries FROM events WHERE event_type = 'error' AND user_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY user_id")
def cleared_failures(spark, sf):
    f = read(spark, sf, "events").filter("event_type = 'error'").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("tries"))
    return catalog.clear_failures(f, read(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id")))


@query(r"SELECT doc_id AS id, coalesce(source, '') AS name, trim(regexp_replace(regexp_replace(coalesce(text, ''), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS long_desc, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 2 END AS n_tags, n_chars AS review_count FROM documents")
def ordered_scan(spark, sf):
    tags = F.when(F.col("doc_id") % 3 != 0, F.to_json(F.array("lang", "source")))
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("name"), F.lit(None).cast("string").alias("short_desc"), F.col("text").alias("long_desc"), tags.alias("tags"), F.lit("[]").alias("genres"), F.col("n_chars").alias("review_count"))
    return catalog.ordered_scan(d).select("id", "name", "long_desc", F.size("tags").alias("n_tags"), "review_count")


@query(f"WITH {T_SQL}, g AS (SELECT item, list(tag ORDER BY rank)[1:12] AS tags FROM t GROUP BY item) SELECT doc_id, concat_ws(' ', source || '.', CASE WHEN len(tags) > 0 THEN 'Tags: ' || lower(array_to_string(tags, ', ')) || '.' END, 'Genres: ' || lower(lang) || '.', CASE WHEN length(text) > 0 THEN left(text, 600) END) AS text FROM documents LEFT JOIN g ON item = doc_id")
def item_text(spark, sf):
    g = profile(spark, sf).groupBy("item").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "tag"))), lambda x: x["tag"]).alias("tags"))
    d = read(spark, sf, "documents").join(g, F.col("item") == F.col("doc_id"), "left")
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    return d.select("doc_id", scalar.build_text(F.col("source"), tags, F.array("lang"), F.lit(""), F.col("text")).alias("text"))


@query("SELECT p_partkey, CASE WHEN p_size * 7 <= 50 THEN 50 WHEN p_size * 7 <= 100 THEN 100 WHEN p_size * 7 <= 150 THEN 150 WHEN p_size * 7 <= 200 THEN 200 WHEN p_size * 7 <= 300 THEN 300 WHEN p_size * 7 <= 400 THEN 400 ELSE 10000 END AS bin, round((p_retailprice - 1000) * 0.5::DOUBLE + 320, 6) AS px, round(((p_retailprice - 320) / 0.5::DOUBLE) + 1000, 6) AS back, round((p_size * 0.5::DOUBLE) * (p_size * 0.25::DOUBLE) / (640 * 480), 9) AS share, round(least(640 / (p_size * 1.35::DOUBLE), 480 / (p_retailprice * 1.35::DOUBLE)), 9) AS scale FROM part")
def screen_geometry(spark, sf):
    size, price = F.col("p_size").cast("double"), F.col("p_retailprice")
    bins = scalar.size_bin(F.least(F.col("p_size") * 7, F.lit(401)))
    bins = F.when(F.col("p_size") * 7 > 400, F.lit(10000)).otherwise(bins)
    share = scalar.footprint(F.lit(0.0), F.lit(0.0), size, size / 2, 0.5, 640.0, 480.0)
    return read(spark, sf, "part").select("p_partkey", bins.alias("bin"), F.round(scalar.project(price, 1000.0, 0.5, 640.0), 6).alias("px"), F.round(scalar.unproject(price, 1000.0, 0.5, 640.0), 6).alias("back"), F.round(share, 9).alias("share"), F.round(scalar.fit_scale(size, price, 640.0, 480.0), 9).alias("scale"))


@query("SELECT vec_id::BIGINT AS id, label FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark)")
def point_lookup(spark, sf):
    e = read(spark, sf, "embeddings").select(F.col("vec_id").cast("long").alias("id"), "label")
    return e.join(read(spark, sf, "benchmark").select(F.col("item_id").cast("long").alias("id")), "id", "left_semi")


@query("SELECT d.doc_id AS id, round(CASE WHEN l.doc_id IS NULL THEN NULL ELSE quality END, 1)::DOUBLE AS review_score FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id")
def item_extras(spark, sf):
    extra = read(spark, sf, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").cast("double").alias("review_score")).withColumns({"release_date": F.lit(None).cast("string"), "price": F.lit(None).cast("double")})
    return export.with_extras(read(spark, sf, "documents").select(F.col("doc_id").alias("id")), extra).select("id", "review_score")


@query(f"WITH {T_SQL}, st AS (SELECT item, tag, row_number() OVER (PARTITION BY item ORDER BY rank) AS place FROM t), lv AS (SELECT item, tag, (votes * 7 + length(tag)) % 13 AS votes FROM t WHERE length(tag) > 2), n0 AS (SELECT item FROM t GROUP BY item HAVING count(*) >= 3), e AS (SELECT st.item, st.tag, place, votes FROM st JOIN lv ON lv.item = st.item AND lv.tag = st.tag WHERE st.item IN (SELECT item FROM n0)), r AS (SELECT item, row_number() OVER (PARTITION BY item ORDER BY place)::DOUBLE AS s, row_number() OVER (PARTITION BY item ORDER BY votes DESC, place)::DOUBLE AS v, row_number() OVER (PARTITION BY item ORDER BY lower(tag), place)::DOUBLE AS a FROM e) SELECT item AS id, count(*) AS n, round(corr(s, v), 6) + 0 AS by_votes, round(corr(s, a), 6) + 0 AS by_name FROM r GROUP BY item HAVING count(*) >= 3")
def order_agreement(spark, sf):
    t = kept_profile(spark, sf)
    kept = t.groupBy(F.col("item").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "tag"))), lambda x: x["tag"]).alias("tags"))
    live = t.filter(F.length("tag") > 2).select(F.col("item").alias("id"), "tag", ((F.col("votes") * 7 + F.length("tag")) % 13).alias("votes"))
    return layout.order_agreement(kept, live).select("id", "n", (F.round("by_votes", 6) + 0.0).alias("by_votes"), (F.round("by_name", 6) + 0.0).alias("by_name"))


# -- more of trees and layouts ----------------------------------------------------------------


@query(f"WITH {TREE}, k AS (SELECT parent AS node, count(*) AS c FROM nd WHERE parent IS NOT NULL GROUP BY parent) SELECT coalesce(c, 0) AS children, count(*) AS nodes FROM nd LEFT JOIN k USING (node) GROUP BY 1")
def branch_histogram(spark, sf):
    return hierarchy.branch_histogram(doc_tree(spark, sf)[0])


@query(f"WITH {TREE}, dp AS (SELECT node, max(hops) AS depth FROM cl GROUP BY node) SELECT depth, count(*) AS items FROM mb JOIN dp USING (node) GROUP BY depth")
def landing_depth(spark, sf):
    n, m = doc_tree(spark, sf)
    return hierarchy.landing_depth(hierarchy.closure(n), m)


@query(f"WITH {L_SQL}, tp AS (SELECT node, term FROM tm WHERE k = 1), rl AS (SELECT nd.node, CASE WHEN a.term = b.term THEN 'repeat' WHEN EXISTS (SELECT 1 FROM tm WHERE tm.node = nd.parent AND tm.term = a.term) THEN 'refinement' ELSE 'novel' END AS relation FROM nd JOIN tp a ON a.node = nd.node JOIN tp b ON b.node = nd.parent) SELECT relation, count(*) AS nodes FROM rl GROUP BY relation")
def transition_counts(spark, sf):
    n, terms, _ = label_parts(spark, sf)
    return hierarchy.transition_counts(hierarchy.path_relation(n, stored(terms, "terms")))


@query(f"WITH {L_SQL}, f3 AS (SELECT node, term FROM tm WHERE k <= 3), c AS (SELECT nd.node, nd.parent FROM nd WHERE parent IN (SELECT node FROM f3)), h AS (SELECT node, EXISTS (SELECT 1 FROM f3 a JOIN f3 b ON a.term = b.term WHERE a.node = c.node AND b.node = c.parent) AS r FROM c) SELECT count(*) AS checked, count_if(r) AS repeats, round(count_if(r)::DOUBLE / count(*), 6) AS rate FROM h")
def repeat_rate(spark, sf):
    n, terms, _ = label_parts(spark, sf)
    return hierarchy.repeat_rate(n, stored(terms, "terms")).withColumn("rate", F.round("rate", 6))


@query(f"WITH {TREE} SELECT node, row_number() OVER (ORDER BY size DESC, node) - 1 AS territory FROM nd JOIN sz USING (node) WHERE parent = 'all'")
def territory_order(spark, sf):
    n, m = doc_tree(spark, sf)
    return view.territories(n.join(hierarchy.sizes(hierarchy.closure(n), m), "node"))


@query(f"WITH {TREE}, tp AS (SELECT node AS lang, row_number() OVER (ORDER BY node) - 1 AS t FROM nd WHERE parent = 'all') SELECT item, t AS territory FROM mb JOIN tp ON split_part(mb.node, '/', 1) = tp.lang")
def territory_labels(spark, sf):
    n, m = doc_tree(spark, sf)
    return hierarchy.territory_labels(n, hierarchy.closure(n), m)


@query(f"WITH {L_SQL} SELECT lb.node, confidence, size FROM lb JOIN sz USING (node) JOIN nd USING (node) WHERE parent IS NOT NULL AND confidence IN ('weak', 'none') ORDER BY size DESC, lb.node LIMIT 5")
def weakest_nodes(spark, sf):
    n, m = doc_tree(spark, sf)
    sized = hierarchy.sizes(hierarchy.closure(n), m)
    return view.weakest(label_quality(spark, sf).join(sized, "node").join(n.select("node", "parent"), "node")).select("node", "confidence", "size")


@query(f"WITH {TREE}, pu AS (SELECT nd.node, parent, CASE WHEN size % 5 = 0 THEN NULL ELSE (size % 10) / 10.0::DOUBLE END AS purity FROM nd JOIN sz USING (node)) SELECT node, purity IS NOT NULL AND purity < 0.35 AND node IN (SELECT parent FROM nd WHERE parent IS NOT NULL) AS pruned FROM pu")
def pruned_nodes(spark, sf):
    n, m = doc_tree(spark, sf)
    sized = n.join(hierarchy.sizes(hierarchy.closure(n), m), "node")
    return view.pruned(sized.withColumn("purity", F.when(F.col("size") % 5 != 0, (F.col("size") % 10) / 10.0))).select("node", "pruned")


@query(f"WITH {FL}, s AS (SELECT id, x * 4000 + 320 AS px, y * 4000 + 240 AS py FROM fl) SELECT id FROM s WHERE px >= -90 AND py >= -90 AND px <= 730 AND py <= 570")
def labels_on_screen(spark, sf):
    f = flat(spark, sf).select("id", scalar.project(F.col("x"), 0.0, 4000.0, 640.0).alias("px"), scalar.project(F.col("y"), 0.0, 4000.0, 480.0).alias("py"))
    return view.on_screen(f, 640, 480).select("id")


@query(f"WITH {TREE}, w AS (SELECT ancestor AS node, arg_min(cl.node, (size, cl.node)) AS a FROM cl JOIN sz ON sz.node = cl.node GROUP BY ancestor), q AS (SELECT node FROM nd WHERE node NOT LIKE '%/%' OR node LIKE '%1'), j AS (SELECT cl.node, cl.ancestor, hops FROM cl JOIN q ON q.node = cl.ancestor) SELECT node, arg_min(ancestor, hops) AS kept FROM j GROUP BY node")
def nearest_kept(spark, sf):
    n = doc_tree(spark, sf)[0]
    kept = n.filter(~F.col("node").contains("/") | F.col("node").endswith("1")).select("node")
    return hierarchy.nearest_kept(hierarchy.closure(n), kept)


@query(f"WITH {TREE} SELECT item, node FROM mb")
def leaf_owner(spark, sf):
    n, m = doc_tree(spark, sf)
    c = hierarchy.closure(n)
    both = m.unionByName(m.select("item", F.lit("all").alias("node")))
    return hierarchy.leaf_owner(m.select("item"), both, c)


@query(f"WITH {FL}, b AS (SELECT label AS node, min(x) AS x0, max(y) AS y1, avg(x) AS cx FROM fl GROUP BY label) SELECT node, round(CASE WHEN node % 2 = 0 THEN -1.0::DOUBLE ELSE x0 END, 6) AS x0, round(CASE WHEN node % 2 = 0 THEN 1.0::DOUBLE ELSE y1 END, 6) AS y1, round(CASE WHEN node % 2 = 0 THEN 0.0::DOUBLE ELSE cx END, 6) AS cx, CASE WHEN node % 2 = 0 THEN 0.5::DOUBLE END AS purity FROM b")
def manifest_measures(spark, sf):
    f = flat(spark, sf)
    members = f.select(F.col("id").alias("item"), F.col("label").alias("node"))
    nodes = members.select("node").distinct().withColumn("parent", F.lit(None).cast("long"))
    own = layout.node_bbox(hierarchy.closure(nodes), members, f)
    known = nodes.filter("node % 2 = 0").select("node", F.array(*map(F.lit, (-1.0, -1.0, 1.0, 1.0))).alias("bbox"), F.array(F.lit(0.0), F.lit(0.0)).alias("centroid"), F.lit(0.5).alias("purity"), F.lit(0.9).alias("containment"))
    j = export.measured(nodes, known, own)
    return j.select("node", F.round(F.col("bbox")[0], 6).alias("x0"), F.round(F.col("bbox")[3], 6).alias("y1"), F.round(F.col("centroid")[0], 6).alias("cx"), "purity")


C_SQL = """cr AS (SELECT (1000000 + dense_rank() OVER (ORDER BY lang))::BIGINT AS lang_id, lang, source, doc_id FROM documents),
cs AS (SELECT lang_id, (2000000 + dense_rank() OVER (ORDER BY lang, source))::BIGINT AS source_id, doc_id FROM cr),
ct AS (SELECT 1000000::BIGINT AS parent, lang_id AS child, 0.5::DOUBLE AS lam, count(*) AS size FROM cs GROUP BY lang_id UNION ALL SELECT lang_id, source_id, 1.0, count(*) FROM cs GROUP BY lang_id, source_id UNION ALL SELECT source_id, doc_id, 2.0, 1 FROM cs),
cn AS (SELECT 1000000::BIGINT AS node, NULL::BIGINT AS parent, 1000000::BIGINT AS size UNION ALL SELECT child, parent, size FROM ct WHERE child >= 1000000)"""
POINTS = 1_000_000


def condensed(spark, sf):
    d = read(spark, sf, "documents").select("lang", "source", "doc_id")
    langs = d.groupBy("lang").agg(F.count("*").alias("size")).withColumn("lang_id", (POINTS + F.dense_rank().over(Window.orderBy("lang"))).cast("long"))  # a few languages
    sources = d.groupBy("lang", "source").agg(F.count("*").alias("size")).withColumn("source_id", (2 * POINTS + F.dense_rank().over(Window.orderBy("lang", "source"))).cast("long"))  # and their sources
    row = lambda df, p, c, lam, n: df.select(p.alias("parent"), c.alias("child"), F.lit(lam).alias("lam"), n.alias("size"))
    ids = sources.join(langs.select("lang", "lang_id"), "lang")
    points = d.join(sources.select("lang", "source", "source_id"), ["lang", "source"])
    return row(langs, F.lit(POINTS).cast("long"), F.col("lang_id"), 0.5, F.col("size")).unionByName(row(ids, F.col("lang_id"), F.col("source_id"), 1.0, F.col("size"))).unionByName(row(points, F.col("source_id"), F.col("doc_id"), 2.0, F.lit(1).cast("long")))


@query(f"WITH {C_SQL} SELECT node, coalesce(parent, -1) AS parent, size FROM cn")
def condensed_nodes(spark, sf):
    return hierarchy.condensed_nodes(condensed(spark, sf), POINTS).select("node", F.coalesce("parent", F.lit(-1)).alias("parent"), "size")


@query(f"WITH {C_SQL}, k AS (SELECT cn.node, count(c.node) AS c FROM cn LEFT JOIN cn c ON c.parent = cn.node GROUP BY cn.node) SELECT 'branching' AS measure, c AS key, count(*) AS n FROM k GROUP BY c UNION ALL SELECT 'depth', CASE WHEN node = 1000000 THEN 0 WHEN node < 2000000 THEN 1 ELSE 2 END, count(*) FROM cn GROUP BY 2 UNION ALL SELECT 'clusters', 0, count(*) - 1 FROM cn UNION ALL SELECT 'least', 0, min(size) FROM cn WHERE parent IS NOT NULL UNION ALL SELECT 'greatest', 0, max(size) FROM cn WHERE parent IS NOT NULL")
def condensed_stats(spark, sf):
    n = hierarchy.condensed_nodes(condensed(spark, sf), POINTS)
    return hierarchy.condensed_stats(n, hierarchy.closure(n))


@query(f"WITH {K_SQL}, mm AS (SELECT id AS item, CASE WHEN id % 7 = 0 THEN 100 ELSE label END AS node FROM v), cx AS (SELECT node AS g, i, avg(f[i]) AS m FROM v JOIN mm ON item = id, (SELECT unnest(range(1, 65)) AS i) WHERE node <> 100 GROUP BY node, i), cc AS (SELECT g, list(m ORDER BY i) AS c FROM cx GROUP BY g), sm AS (SELECT id, g, row_number() OVER (PARTITION BY id ORDER BY list_dot_product(f, c) / (nm * sqrt(list_dot_product(c, c))) DESC, g) AS k FROM vn JOIN mm ON item = id, cc WHERE node = 100) SELECT item, node, false AS moved FROM mm WHERE node <> 100 UNION ALL SELECT id, g, true FROM sm WHERE k = 1")
def noise_assignment(spark, sf):
    v = vecs(spark, sf)
    members = v.select(F.col("id").alias("item"), F.when(F.col("id") % 7 == 0, F.lit(100)).otherwise(F.col("label")).cast("long").alias("node"))
    nodes = v.select(F.col("label").alias("node"), F.lit(100).cast("long").alias("parent")).distinct().unionByName(spark.sql("SELECT CAST(100 AS BIGINT) AS node, CAST(NULL AS BIGINT) AS parent"))
    return hierarchy.assign_noise(nodes, members, v)


@query()
def density_tree(spark, sf):
    return hierarchy.condensed_tree(vecs(spark, sf).select("id", "features"), 5, 3)


QZ = "qz AS (SELECT id, f, list_transform(f, lambda q: round(q / list_max(list_transform(f, lambda r: abs(r))) * 127) / 127 * list_max(list_transform(f, lambda r: abs(r)))) AS q FROM v)"


@query(f"WITH {K_SQL}, {QZ}, c AS (SELECT list_dot_product(f, q) / greatest(sqrt(list_dot_product(f, f)) * sqrt(list_dot_product(q, q)), 1e-9::DOUBLE) AS c FROM qz) SELECT round(avg(c), 6) AS mean, round(min(c), 6) AS least, round(quantile_cont(c, 0.01), 6) AS p1, round(avg((c < 0.99)::INT), 6) AS below FROM c")
def quantised_cosine(spark, sf):
    v = vecs(spark, sf)
    return vectors.cosine_stats(v, vectors.quantised(v)).select(*[F.round(c, 6).alias(c) for c in ("mean", "least", "p1", "below")])


@query(f"WITH {FL}, rk AS (SELECT parity, row_number() OVER (PARTITION BY parity ORDER BY x, id)::DOUBLE AS a, row_number() OVER (PARTITION BY parity ORDER BY y, id)::DOUBLE AS b FROM fl) SELECT parity, round(corr(a, b), 6) AS spearman FROM rk GROUP BY parity")
def rank_correlation(spark, sf):
    w = lambda c: F.row_number().over(Window.partitionBy("parity").orderBy(c, "id"))
    ranked = flat(spark, sf).select("parity", w("x").alias("a"), w("y").alias("b"))
    return layout.rank_correlation(ranked, "a", "b", ["parity"]).withColumn("spearman", F.round("spearman", 6))


@query(f"WITH {TREE} SELECT node, round(0.4::DOUBLE * (size % 10) / 10 + 0.3::DOUBLE * (size % 7) / 7 + 0.3::DOUBLE * (1 - (size % 4) / 4.0::DOUBLE), 6) AS score FROM sz")
def frontier_score(spark, sf):
    n, m = doc_tree(spark, sf)
    z = hierarchy.sizes(hierarchy.closure(n), m).select("node", (F.col("size") % 10 / 10).alias("adjacency"), (F.col("size") % 7 / 7).alias("quality"), (F.col("size") % 4 / 4).alias("ownership"))
    return view.frontier_score(z).withColumn("score", F.round("score", 6))


@query(f"WITH {FL}, h AS (SELECT floor(x / 0.1::DOUBLE)::BIGINT AS cx, floor(y / 0.1::DOUBLE)::BIGINT AS cy, sum(ln(1 + (id % 5)::DOUBLE)) AS w FROM fl GROUP BY 1, 2), st AS (SELECT unnest(range(-2, 3)) AS d) SELECT cx + a.d AS gx, cy + b.d AS gy, round(sum(w * exp(-(a.d * a.d + b.d * b.d) / 2.0::DOUBLE)), 6) AS density FROM h, st a, st b GROUP BY 1, 2")
def density_overlay(spark, sf):
    p = flat(spark, sf).select("x", "y", (F.col("id") % 5).cast("double").alias("weight"))
    return view.density_overlay(p, 0.1).withColumn("density", F.round("density", 6))


@query()
def purity_baseline(spark, sf):
    return layout.purity_baseline(flat(spark, sf).select("id", "x", "y"), [50, 100], reps=3)


@query()
def display_layout(spark, sf):
    v = vecs(spark, sf)
    return layout.display_layout(v.select(F.col("id").alias("item"), "features"), "supervised", v.select(F.col("id").alias("item"), "label"))


@query()
def label_placement(spark, sf):
    f = flat(spark, sf).select(F.lit(0).cast("long").alias("view"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("node"), scalar.project(F.col("x"), 0.0, 2000.0, 640.0).alias("px"), scalar.project(F.col("y"), 0.0, 2000.0, 480.0).alias("py"), F.concat(F.lit("label "), F.col("id").cast("string")).alias("label"), F.lit(12.0).alias("height"), (F.col("id") % 17).alias("size"))
    return view.place_labels(f)
