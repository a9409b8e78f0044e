"""Queries of the column functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from trailweave.functions import evidence as ev
from trailweave.functions import quality, text, vectors
from trailweave.plans.catalog import query, table
from trailweave.sources import store

_PAIRS = "SELECT vec_id, embedding::DOUBLE[] v, lead(embedding::DOUBLE[]) OVER (PARTITION BY vec_id // 100 ORDER BY vec_id) n FROM embeddings"


def _pairs(s, d):
    e = table(s, d, "embeddings")
    w = W.partitionBy(F.floor(F.col("vec_id") / 100)).orderBy("vec_id")
    return e.select("vec_id", F.col("embedding").alias("v"), F.lead("embedding").over(w).alias("n"))


@query("f1_f2_inner_product_distance", f"SELECT vec_id, round(list_dot_product(v, n), 6) AS sim, round(coalesce(1 - list_dot_product(v, n), 0.5), 6) AS dist FROM ({_PAIRS})")
def inner_products(s, d):
    return _pairs(s, d).select("vec_id", F.round(vectors.dot(F.col("v"), F.col("n")), 6).alias("sim"), F.round(vectors.cosine_distance(F.col("v"), F.col("n")), 6).alias("dist"))


@query("f3_l2_normalise", "SELECT vec_id, round(2 * v[1] / nullif(sqrt(list_dot_product(v, v)) * 2, 0), 6) AS first, round(v[64] / nullif(sqrt(list_dot_product(v, v)), 0), 6) AS last, 64 AS n FROM (SELECT vec_id, embedding::DOUBLE[] v FROM embeddings)")
def normalised(s, d):
    u = vectors.l2_normalise(F.transform("embedding", lambda x: x.cast("double") * 2))
    return table(s, d, "embeddings").select("vec_id", u.alias("u")).select("vec_id", F.round(F.get("u", F.lit(0)), 6).alias("first"), F.round(F.get("u", F.lit(63)), 6).alias("last"), F.size("u").alias("n"))


@query(
    "f4_a12_centroids",
    "WITH m AS (SELECT label, i, avg(x) m FROM (SELECT label, unnest(embedding::DOUBLE[]) x, generate_subscripts(embedding, 1) i FROM embeddings) GROUP BY ALL), n AS (SELECT label, sqrt(sum(m * m)) n FROM m GROUP BY label) SELECT label, i - 1 AS dim, round(m / n, 6) AS x FROM m JOIN n USING (label)",
)
def centroids(s, d):
    return vectors.centroids(table(s, d, "embeddings"), ["label"], "embedding").select("label", F.posexplode("centroid").alias("dim", "x")).select("label", "dim", F.round("x", 6).alias("x"))


@query("f5_pixel_statistics", "SELECT vec_id, round(list_var_pop(embedding::DOUBLE[]), 8) AS variance, round(list_avg(embedding::DOUBLE[]), 8) AS mean FROM embeddings")
def pixel_statistics(s, d):
    return table(s, d, "embeddings").select("vec_id", F.round(quality.variance_of(F.col("embedding")), 8).alias("variance"), F.round(quality.mean_of(F.col("embedding")), 8).alias("mean"))


@query(
    "f6_f7_frame_quality",
    "SELECT p_partkey, round(CASE WHEN p_size <= 2 THEN 0 ELSE 0.5 * least(1, (p_retailprice % 700) / 500) + 0.5 * (1 - abs(p_size * 5 - 128) / 128) END, 9) AS score, CASE WHEN p_size <= 2 THEN 'invalid_image' ELSE concat_ws(',', CASE WHEN p_retailprice % 700 < 40 THEN 'blurry' END, CASE WHEN p_size * 5 < 20 THEN 'too_dark' END) END AS reasons FROM part",
)
def frame_quality(s, d):
    blur, light, ok = F.col("p_retailprice") % 700, F.col("p_size") * 5.0, F.col("p_size") > 2
    # These scores have eight places at most: rounded to six, many would be ties.
    return table(s, d, "part").select("p_partkey", F.round(quality.quality_score(blur, light, ok), 9).alias("score"), F.array_join(quality.reject_reasons(blur, light, ok), ",").alias("reasons"))


@query(
    "f8_mean_subtracted_descriptor",
    "WITH a AS (SELECT vec_id, embedding::DOUBLE[] v, list_avg(embedding::DOUBLE[]) m FROM embeddings), b AS (SELECT vec_id, list_append(list_transform(v, lambda x: x - m), m / 255) t FROM a) SELECT vec_id, round(t[1] / sqrt(list_dot_product(t, t)), 6) AS first, round(t[65] / sqrt(list_dot_product(t, t)), 8) AS tail FROM b",
)
def descriptors(s, d):
    return table(s, d, "embeddings").select("vec_id", vectors.mean_subtracted(F.col("embedding")).alias("t")).select("vec_id", F.round(F.get("t", F.lit(0)), 6).alias("first"), F.round(F.get("t", F.lit(64)), 8).alias("tail"))


@query(
    "f9_histogram",
    "WITH h AS (SELECT event_type, least(7, greatest(0, floor(value / 25)))::INT bin, count(*) n FROM events GROUP BY ALL) SELECT event_type, bin, round(n / sqrt(sum(n * n) OVER (PARTITION BY event_type)), 6) AS share FROM h",
)
def histogram(s, d):
    h = table(s, d, "events").groupBy("event_type", F.least(F.lit(7), F.greatest(F.lit(0), F.floor(F.col("value") / 25))).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return h.select("event_type", "bin", F.round(F.col("n") / F.sqrt(F.sum(F.col("n") * F.col("n")).over(W.partitionBy("event_type"))), 6).alias("share"))


_SCENE = "CASE event_id % 6 WHEN 0 THEN 'corridor_junction' WHEN 1 THEN 'room' WHEN 2 THEN 'corridor' WHEN 3 THEN 'unknown' WHEN 4 THEN 'attic' END"


def _scene():
    k = F.col("event_id") % 6
    return F.when(k == 0, "corridor_junction").when(k == 1, "room").when(k == 2, "corridor").when(k == 3, "unknown").when(k == 4, "attic")


@query("f10_a18_scene_histogram", f"SELECT coalesce(CASE WHEN s = 'corridor_junction' THEN 'junction' ELSE s END, 'unknown') AS scene, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM (SELECT {_SCENE} s FROM events) GROUP BY 1")
def scene_histogram(s, d):
    h = table(s, d, "events").groupBy(ev.normalise_scene(_scene()).alias("scene")).agg(F.count("*").alias("n"))
    return h.join(F.broadcast(h.agg(F.sum("n").alias("t")))).select("scene", "n", F.round(F.col("n") / F.col("t"), 6).alias("share"))


@query("f11_clean_lists", "SELECT p_partkey, array_to_string(list_distinct_ordered, '|') AS words FROM (SELECT p_partkey, list_filter(list_transform(w, lambda x, i: CASE WHEN list_position(w, x) = i THEN x END), lambda x: x IS NOT NULL) list_distinct_ordered FROM (SELECT p_partkey, list_filter(list_transform(string_split(p_name || '  ' || p_type, ' '), lambda x: substr(trim(x), 1, 5)), lambda x: x <> '') w FROM part))")
def clean_lists(s, d):
    words = F.split(F.concat_ws("  ", "p_name", "p_type"), " ")
    return table(s, d, "part").select("p_partkey", F.array_join(text.clean_list(words, 5), "|").alias("words"))


@query(
    "f12_f13_parse_model_text",
    "SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'room' WHEN 1 THEN 'junction' WHEN 6 THEN 'stairs' ELSE 'unknown' END AS scene_type, CASE event_id % 7 WHEN 0 THEN 'door,desk' WHEN 1 THEN 'stairs' WHEN 3 THEN 'desk' WHEN 5 THEN 'desk' ELSE '' END AS landmarks, CASE event_id % 7 WHEN 0 THEN 'Room ' || user_id WHEN 3 THEN 'a' WHEN 6 THEN '```json x' ELSE '' END AS signs, CASE event_id % 7 WHEN 0 THEN 'left,right' WHEN 6 THEN 'forward' ELSE '' END AS walkable, CASE event_id % 7 WHEN 0 THEN event_type WHEN 5 THEN ' a ```json b ' ELSE '' END AS description FROM events",
)
def parse_model_text(s, d):
    k = F.col("event_id") % 7
    raw = (
        F.when(k == 0, F.concat(F.lit('user\nassistant\n ```json\n{"scene_type":"room","landmarks":["door"," desk ","DESK","teleporter","door",7],"sign_text":["Room '), F.col("user_id").cast("string"), F.lit('"],"walkable":["left","right","left"],"x":[1],"description":"'), F.col("event_type"), F.lit('"}\n```')))
        .when(k == 1, '{"scene_type":"corridor_junction","landmarks":["stairs"]}')
        .when(k == 2, "no json here {")
        .when(k == 3, 'Sure: {"scene_type":"spaceship","landmarks":["desk","blue sign"],"sign_text":[1,"a","a",""],"description":3} ok')
        .when(k == 4, "[1,2]")
        .when(k == 5, '{"scene_type":"ROOM","landmarks":["Door","desk"],"walkable":["Left"],"description":" a ```json b "}')
        .otherwise('```json {"scene_type":"stairs","sign_text":["```json x"],"walkable":["\\u00a0forward\\u2003"]} ```')
    )
    t = table(s, d, "events").select("event_id", text.parse_tags(text.without_echo(raw)).alias("t"))
    join = lambda c: F.array_join(f"t.{c}", ",")
    return t.select("event_id", "t.scene_type", join("landmarks").alias("landmarks"), join("sign_text").alias("signs"), join("walkable").alias("walkable"), "t.description")


@query("f14_stub_tagger", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'room' WHEN p_size % 4 IN (1, 2) THEN 'corridor' ELSE 'unknown' END AS scene, CASE WHEN p_size % 5 = 0 THEN 'fire_equipment' ELSE '' END AS marks FROM part")
def stub_tagger(s, d):
    k = F.col("p_size") % 4
    names = F.array_compact(F.array(F.when(k == 0, "dining chair"), F.when(k.isin(0, 1), "person"), F.when(k == 2, "bench"), F.when(F.col("p_size") % 5 == 0, "fire hydrant"), F.lit("wall")))
    return table(s, d, "part").select("p_partkey", text.stub_scene(names).alias("scene"), F.array_join(text.stub_landmarks(names), ",").alias("marks"))


_WORDS = "SELECT p_partkey k, CASE WHEN p_partkey % 7 = 0 THEN [] ELSE list_distinct(string_split(p_name, ' ')) END a, CASE WHEN p_partkey % 5 = 0 THEN [] ELSE list_distinct(string_split(p_type || ' ' || split_part(p_name, ' ', 1), ' ')) END b FROM part"


def _words(s, d):
    p, none = table(s, d, "part"), F.array().cast("array<string>")
    a = F.when(F.col("p_partkey") % 7 == 0, none).otherwise(F.array_distinct(F.split("p_name", " ")))
    b = F.when(F.col("p_partkey") % 5 == 0, none).otherwise(F.array_distinct(F.split(F.concat_ws(" ", "p_type", F.split_part("p_name", F.lit(" "), F.lit(1))), " ")))
    return p.select(F.col("p_partkey").alias("k"), a.alias("a"), b.alias("b"))


_J = "(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))))"


@query("f15_jaccard_variants", f"SELECT k, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 1 ELSE {_J} END, 6) AS open, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE {_J} END, 6) AS strict, round(CASE WHEN len(a) = 0 THEN 0.5 WHEN len(b) = 0 THEN 0 ELSE greatest({_J}, 0.1) END, 6) AS floored FROM ({_WORDS})")
def jaccards(s, d):
    a, b = F.col("a"), F.col("b")
    return _words(s, d).select("k", F.round(ev.jaccard_open(a, b), 6).alias("open"), F.round(ev.jaccard_strict(a, b), 6).alias("strict"), F.round(ev.jaccard_floored(a, b), 6).alias("floored"))


_SC = "(CASE k % 4 WHEN 0 THEN 'room' WHEN 1 THEN 'corridor' WHEN 2 THEN 'unknown' END)"
_SP = "(CASE k % 3 WHEN 0 THEN 'room' WHEN 1 THEN 'corridor' ELSE 'unknown' END)"
_FL = "(CASE WHEN len(a) = 0 THEN 0.5 WHEN len(b) = 0 THEN 0 ELSE greatest(jl, 0.1) END)"


@query(
    "f16_f19_semantic_similarity",
    f"WITH t AS (SELECT k, a, b, {_SC} qs, {_SP} ps, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE {_J} END j, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(list_transform(a, lambda x: lower(x)), list_transform(b, lambda x: lower(x)))) / len(list_distinct(list_transform(list_concat(a, b), lambda x: lower(x)))) END jl, CASE WHEN k % 11 = 0 THEN [] ELSE ['x', 'y'] END qo FROM ({_WORDS})), u AS (SELECT *, CASE WHEN len(qo) = 0 THEN 0.5 ELSE greatest(CASE WHEN k % 2 = 0 THEN 0.5 ELSE 0.0 END, 0.1) END ob, CASE WHEN coalesce(qs, 'unknown') = 'unknown' OR ps = 'unknown' THEN 0.5 WHEN qs = ps THEN 1 ELSE 0 END sm, coalesce(qs, 'unknown') <> 'unknown' OR len(a) > 0 qi, ps <> 'unknown' OR len(b) > 0 pi FROM t) SELECT k, sm AS scene, round(CASE WHEN NOT qi AND len(qo) = 0 THEN 0.5 WHEN NOT qi AND NOT pi THEN ob ELSE 0.4 * sm + 0.4 * {_FL} + 0.2 * ob END, 6) AS semantic, round(CASE WHEN qs IS NULL AND len(a) = 0 THEN 0.5 ELSE 0.5 * coalesce((qs = ps)::INT, 0) + 0.5 * j END, 6) AS legacy FROM u",
)
def semantic(s, d):
    k = F.col("k")
    qs = F.when(k % 4 == 0, "room").when(k % 4 == 1, "corridor").when(k % 4 == 2, "unknown")
    ps = F.when(k % 3 == 0, "room").when(k % 3 == 1, "corridor").otherwise("unknown")
    qo = F.when(k % 11 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit(" X"), F.lit("y ")))
    po = F.when(k % 2 == 0, F.array(F.lit("x"))).otherwise(F.array(F.lit("z")))
    df = _words(s, d).select("k", "a", "b", qs.alias("qs"), ps.alias("ps"), qo.alias("qo"), po.alias("po"))
    c = F.col
    return df.select("k", ev.scene_match(F.coalesce(c("qs"), F.lit("unknown")), c("ps")).alias("scene"), F.round(ev.semantic_similarity(c("qs"), c("a"), c("qo"), c("ps"), c("b"), c("po")), 6).alias("semantic"), F.round(ev.legacy_semantic(c("qs"), c("a"), c("ps"), c("b")), 6).alias("legacy"))


@query(
    "f22_f23_confidence",
    "SELECT event_id, CASE WHEN u > 0.4 THEN 'UNKNOWN' WHEN v > 0.526 AND m > 0.15 AND h < 0.4 THEN 'HIGH' WHEN v < 0.226 OR m < 0.02 THEN 'LOW' ELSE 'MEDIUM' END AS level, CASE WHEN v < 0.251 THEN 'Unrecognized' ELSE event_type END AS label FROM (SELECT event_id, event_type, (event_id % 101) / 100 v, (event_id % 37) / 100 m, (event_id % 53) / 60 h, (event_id % 29) / 40 u FROM events)",
)
def confidence(s, d):
    part = lambda m, n: (F.col("event_id") % m) / n
    return table(s, d, "events").select("event_id", ev.confidence_level(part(101, 100), part(37, 100), part(53, 60), part(29, 40)).alias("level"), ev.accepted(F.col("event_type"), part(101, 100), 0.251).alias("label"))


@query(
    "f24_f25_f27_routes_and_names",
    "SELECT c_custkey, 'N' || c_nationkey || ' -> Place_' || (c_nationkey + 100) || ' -> N' || ((c_nationkey + 1) % 25) AS directions, c_nationkey AS id_of_name, CASE WHEN c_nationkey < 24 THEN '0,1' END AS polyline FROM customer",
)
def routes_and_names(s, d):
    from trailweave.operators.graph import directions

    n = F.col("c_nationkey")
    names = table(s, d, "nation").select("n_nationkey").agg(F.map_from_entries(F.collect_list(F.struct(F.col("n_nationkey").cast("string"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string"))))).alias("names"))
    ids = F.map_from_entries(F.transform(F.map_entries("names"), lambda e: F.struct(e["value"], e["key"].cast("long"))))
    route = F.array(n, n + 100, (n + 1) % 25)
    drawn = F.when(F.forall(F.array(n, n + 1), lambda i: F.try_element_at("names", i.cast("string")).isNotNull()), F.lit("0,1"))
    df = table(s, d, "customer").crossJoin(F.broadcast(names))
    return df.select("c_custkey", directions(route, F.col("names")).alias("directions"), F.element_at(ids, F.concat(F.lit("N"), n.cast("string"))).alias("id_of_name"), drawn.alias("polyline"))


@query("f26_sign_junk", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'room 101' WHEN 1 THEN '' WHEN 2 THEN 'exit b' ELSE 'room 101,exit b' END AS signs FROM part")
def sign_junk(s, d):
    k = F.col("p_size") % 4
    raw = F.array_compact(F.array(F.when(k.isin(0, 3), " Room 101 "), F.lit("Door"), F.lit("direction sign "), F.when(k >= 2, "EXIT B"), F.lit("unknown")))
    return table(s, d, "part").select("p_partkey", F.array_join(text.without_junk(raw), ",").alias("signs"))


@query("f28_data_urls", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type END AS decoded FROM events")
def data_urls(s, d):
    url = F.when(F.col("event_id") % 4 == 0, "no comma").otherwise(F.concat(F.lit("data:image/png;base64,"), F.base64(F.col("event_type").cast("binary"))))
    return table(s, d, "events").select("event_id", F.decode(text.data_url_bytes(url), "UTF-8").alias("decoded"))


@query("f29_box_normalisation", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'person' ELSE 'cls_' || (p_size % 3) END AS class, round(p_size / 100, 6) AS x1, round(p_size / 50, 6) AS y2 FROM part")
def boxes(s, d):
    b = F.array(F.struct((F.col("p_size") % 3).alias("cls"), F.lit(0.5).alias("confidence"), F.col("p_size").alias("x1"), F.lit(0).alias("y1"), F.lit(1).alias("x2"), F.col("p_size").alias("y2")))
    got = text.normalised_boxes(b, F.lit(100), F.lit(50), F.create_map(F.lit(0), F.lit("person")))[0]
    return table(s, d, "part").select("p_partkey", got["class"].alias("class"), F.round(got["bbox"][0], 6).alias("x1"), F.round(got["bbox"][3], 6).alias("y2"))


@query("s4_s5_lookup_and_scan", "SELECT vec_id, label, NULL::BIGINT AS position FROM embeddings WHERE vec_id = 42 UNION ALL SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 FROM embeddings")
def lookup_and_scan(s, d):
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").cast("double").alias("ts"), "label")
    scan = store.in_order(store.with_index(e, ["ts", "id"])).withColumnRenamed("index", "position")
    return store.lookup(e, 42).withColumn("position", F.lit(None).cast("long")).unionByName(scan).select(F.col("id").alias("vec_id"), "label", "position")


@query("s13_k10_fixed_interval", "SELECT vec_id, label FROM embeddings WHERE vec_id % 15 = 0")
def fixed_interval(s, d):
    from trailweave.operators.sequence import sampled_every

    return sampled_every(table(s, d, "embeddings"), "vec_id", 15).select("vec_id", "label")


@query("s14_s15_observation_rows", "SELECT printf('obs_%06d', row_number() OVER (ORDER BY frame_path) - 1) AS id, (row_number() OVER (ORDER BY frame_path) - 1)::DOUBLE AS ts, frame_path FROM (SELECT 'frame_' || (vec_id * 7919 % 100003) AS frame_path FROM embeddings)")
def observation_rows(s, d):
    e = table(s, d, "embeddings").select(F.concat(F.lit("frame_"), (F.col("vec_id") * 7919 % 100003).cast("string")).alias("frame"), "embedding")
    return store.observations(e, "frame", "embedding").select("id", "ts", "frame_path")


@query("s8_s17_place_names", "SELECT DISTINCT label AS place_id, CASE WHEN label < 5 THEN 'Hall ' || label ELSE 'Place_' || label END AS name FROM embeddings")
def names_of_places(s, d):
    places = table(s, d, "embeddings").select(F.col("label").alias("place_id")).distinct()
    own = places.where("place_id < 5").select("place_id", F.concat(F.lit("Hall "), F.col("place_id").cast("string")).alias("name"))
    return store.place_names(places, own)


_JSON_LIST = "string_agg({x}, ',' ORDER BY {by})"


@query(
    "s9_s11_content_hash_and_graph_json",
    f"""WITH p AS (SELECT label, list(vec_id ORDER BY vec_id) ids FROM embeddings GROUP BY label), e AS (SELECT event_type, user_id % 3 g, round(avg(value), 6) m FROM events GROUP BY ALL),
    h AS (SELECT sha256('place {{"label":' || label || ',"ids":[' || array_to_string(ids, ',') || ']}}') h FROM p UNION ALL SELECT sha256('edge {{"event_type":"' || event_type || '","g":' || g || ',"mean":' || m || '}}') FROM e),
    x AS (SELECT count(*) n, {", ".join(f"sum(('0x' || substr(h, {15 * i + 1}, 15))::BIGINT) s{i}" for i in range(4))} FROM h),
    nj AS (SELECT {_JSON_LIST.format(x="'{\"label\":' || label || '}'", by="label")} j FROM p), ej AS (SELECT {_JSON_LIST.format(x="'{\"event_type\":\"' || event_type || '\",\"g\":' || g || ',\"mean\":' || round(m, 4) || '}'", by="event_type, g")} j FROM e)
    SELECT substr(sha256(concat_ws(',', n, s0, s1, s2, s3)), 1, 16) AS content_hash, '{{"nodes":[' || nj.j || '],"edges":[' || ej.j || ']}}' AS json FROM x, nj, ej""",
)
def hash_and_json(s, d):
    places = table(s, d, "embeddings").groupBy("label").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    edges = table(s, d, "events").groupBy("event_type", F.pmod("user_id", F.lit(3)).alias("g")).agg(F.round(F.avg("value"), 6).alias("mean"))
    return store.content_hash(places, edges).crossJoin(store.graph_json(places.select("label"), edges))


@query("s10_latest_map", "SELECT max_by(user_id, ts) AS path FROM events")
def latest_map(s, d):
    return store.latest(table(s, d, "events"), F.col("user_id"), F.col("ts"))


@query("s1_s2_row_codec", "SELECT event_id, 0 AS n_objects, event_type AS segment_id FROM events")
def row_codec(s, d):
    e = table(s, d, "events").select("event_id", F.lit(None).cast("array<string>").alias("objects"), F.array(F.lit(1.0)).alias("embedding"), F.col("event_type").alias("segment_id"))
    line = store.without_vector(e).select(F.to_json(F.struct("*")).alias("j"))
    back = store.with_defaults(line.select(F.from_json("j", "event_id long, objects array<string>, segment_id string").alias("o")).select("o.*"))
    return back.select("event_id", F.size("objects").alias("n_objects"), "segment_id")
