"""Search queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from karvan.operators import search
from karvan.params import SearchParams
from karvan.plans import views as v
from karvan.plans.q_catalog import crossrefs, product_cards
from karvan.plans.registry import query
from karvan.plans.sqlviews import add_view
from karvan.session import cut_lineage

NOW = "2001-12-01 00:00:00"


def offer_rows(offers):
    return offers.where("is_active").select(
        "product_uid", "title_normalized", "stock_status", F.col("occurred_at").alias("price_observed_at"),
        (F.expr("CAST(substr(seller_key, 2) AS BIGINT)") / 100.0).alias("trust_score"),
    )


def products(cards):
    n = F.col("n")
    return cards.select(
        "product_uid", F.concat_ws(" ", F.lit("spare"), "part_type", F.concat(F.lit("model"), n % 40)).alias("title"),
        F.concat(F.lit("brand"), n % 9).alias("brand"), "part_type",
        F.when(n % 3 == 0, "genuine").otherwise("aftermarket").alias("authenticity_dominant"),
        F.when(n % 4 != 0, F.lit("https://img.example/x.jpg")).alias("image_url"),
        F.slice("vehicles", 1, 3).alias("vehicles_compatible"), F.slice("vehicles", 4, 3).alias("vehicles_incompatible"),
        "offer_count", "min_price_toman", "is_published", "n",
    )


add_view(
    "sproducts",
    "product_cards",
    """
  SELECT product_uid, 'spare ' || part_type || ' model' || (n % 40) AS title, 'brand' || (n % 9) AS brand, part_type,
    CASE WHEN n % 3 = 0 THEN 'genuine' ELSE 'aftermarket' END AS authenticity_dominant, n % 4 <> 0 AS has_image, vehicles[1:3] AS vehicles_compatible,
    vehicles[4:6] AS vehicles_incompatible, offer_count, min_price_toman, is_published, n FROM product_cards""",
)


def codes(cards):
    return cards.select("product_uid", F.explode("codes").alias("code"))


def synonym_decisions(spark, d):
    """Tokens per type from part names: approved unless hashed away, later revoked."""
    p = v.table(spark, d, "part")
    base = p.select(F.lower("p_type").alias("part_type"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("token")).distinct()
    h = F.substring(F.sha2(F.concat("part_type", "token"), 256), 1, 1)
    first = base.select("*", F.lit("approve").alias("decision"), F.lit(True).alias("active"), F.lit(1).alias("decided_at"))
    second = base.where(h < "4").select("*", F.lit("reject").alias("decision"), F.lit(True).alias("active"), F.lit(2).alias("decided_at"))
    third = base.where(h > "c").select("*", F.lit("approve").alias("decision"), F.lit(False).alias("active"), F.lit(3).alias("decided_at"))
    return first.unionByName(second).unionByName(third)


add_view(
    "synonyms",
    "",
    """
  SELECT * FROM (SELECT DISTINCT lower(p_type) AS part_type, split_part(p_name, ' ', 2) AS token FROM part)
  WHERE substr(sha256(part_type || token), 1, 1) >= '4' AND substr(sha256(part_type || token), 1, 1) <= 'c'""",
)
add_view(
    "closure",
    "crossrefs",
    """
  WITH RECURSIVE e AS (SELECT code_a AS a, code_b AS b FROM crossrefs UNION ALL SELECT code_b, code_a FROM crossrefs),
  w(c, x) AS (SELECT DISTINCT a, a FROM e UNION SELECT w.c, e.b FROM w JOIN e ON e.a = w.x) SELECT c AS code, x AS equivalent FROM w""",
)
add_view(
    "closed_codes",
    "closure product_cards",
    """
  WITH m AS (SELECT product_uid, unnest(codes) AS code FROM product_cards)
  SELECT product_uid, code FROM m UNION SELECT product_uid, equivalent FROM m JOIN closure USING (code)""",
)
add_view(
    "sdocs",
    "sproducts active_offers closed_codes synonyms",
    """
  SELECT p.*, coalesce(v, []) AS title_variants, coalesce(c, []) AS part_numbers, coalesce(s, []) AS part_type_synonyms, coalesce(fresh, 0) AS price_freshness, coalesce(trust, 0e0) AS best_seller_trust
  FROM sproducts p
  LEFT JOIN (SELECT product_uid, list_sort(list_distinct(list(title_normalized))) AS v, CAST(max(CASE WHEN stock_status = 'in_stock' THEN epoch(occurred_at) END) AS BIGINT) AS fresh,
      max(CAST(substr(seller_key, 2) AS BIGINT) / 100e0) AS trust FROM active_offers GROUP BY 1) o USING (product_uid)
  LEFT JOIN (SELECT product_uid, list_sort(list(code)) AS c FROM closed_codes GROUP BY 1) k USING (product_uid)
  LEFT JOIN (SELECT part_type, list_sort(list(token)) AS s FROM synonyms GROUP BY 1) y USING (part_type)
  WHERE is_published""",
)


def documents(spark, d):
    cards = cut_lineage(product_cards(spark, d, v.state_by_product(spark, d)))
    closed = search.closed_part_numbers(codes(cards), crossrefs(spark, d))
    syn = search.approved_synonyms(synonym_decisions(spark, d))
    return cut_lineage(search.search_documents(products(cards), offer_rows(v.offers_by_product(spark, d)), closed, syn))


def queries(spark, d):
    """One search per view event: by model words, by brand, or by a part code."""
    ev = v.table(spark, d, "events").where("event_type = 'view'")
    e, u = F.col("event_id"), F.col("user_id")
    number = F.concat(F.lit("PN"), e % 200 + 1000)
    text = (
        F.when(e % 5 == 0, number).when(e % 5 == 1, F.concat(F.lit("spare model"), u % 40))
        .when(e % 5 == 2, F.concat(F.lit("spar brand"), u % 9)).when(e % 5 == 3, F.lit("promo spare"))
        .otherwise(F.lit("nothing here"))
    )
    return ev.select(
        e.alias("query_id"), text.alias("text"), F.when(e % 5 == 0, number).alias("code"),
        F.when(u % 3 != 0, F.concat(F.lit("v"), u)).alias("vehicle_slug"),
        F.when(u % 7 == 0, "brand3").alias("f_brand"), F.when(u % 14 == 0, "promo").alias("f_part_type"),
        F.when(u % 11 == 0, "genuine").alias("f_authenticity"), F.when(u % 19 == 0, 0).cast("long").alias("f_min_price"),
        F.when(u % 13 == 0, 25000).cast("long").alias("f_max_price"), F.when(u % 17 == 0, True).alias("f_has_image"),
    )


add_view(
    "squeries",
    "",
    """
  SELECT event_id AS query_id, CASE event_id % 5 WHEN 0 THEN 'PN' || (event_id % 200 + 1000) WHEN 1 THEN 'spare model' || (user_id % 40) WHEN 2 THEN 'spar brand' || (user_id % 9) WHEN 3 THEN 'promo spare' ELSE 'nothing here' END AS text,
    CASE WHEN event_id % 5 = 0 THEN 'PN' || (event_id % 200 + 1000) END AS code, CASE WHEN user_id % 3 <> 0 THEN 'v' || user_id END AS vehicle_slug,
    CASE WHEN user_id % 7 = 0 THEN 'brand3' END AS f_brand, CASE WHEN user_id % 14 = 0 THEN 'promo' END AS f_part_type, CASE WHEN user_id % 19 = 0 THEN 0 END AS f_min_price,
    CASE WHEN user_id % 11 = 0 THEN 'genuine' END AS f_authenticity,
    CASE WHEN user_id % 13 = 0 THEN 25000 END AS f_max_price, CASE WHEN user_id % 17 = 0 THEN true END AS f_has_image
  FROM events WHERE event_type = 'view'""",
)
FILTER = """(f_brand IS NULL OR brand = f_brand) AND (f_part_type IS NULL OR part_type = f_part_type) AND (f_min_price IS NULL OR coalesce(min_price_toman >= f_min_price, false))
    AND (f_authenticity IS NULL OR authenticity_dominant = f_authenticity)
    AND (f_max_price IS NULL OR coalesce(min_price_toman <= f_max_price, false)) AND (f_has_image IS NULL OR has_image = f_has_image)"""
add_view(
    "sindex",
    "sdocs",
    """
  SELECT product_uid, token, max(w) AS weight FROM (
    SELECT product_uid, unnest(string_split(lower(title), ' ')) AS token, 8 AS w FROM sdocs
    UNION ALL SELECT product_uid, unnest(flatten(list_transform(title_variants, lambda t: string_split(lower(t), ' ')))), 5 FROM sdocs
    UNION ALL SELECT product_uid, brand, 3 FROM sdocs UNION ALL SELECT product_uid, unnest(part_type_synonyms), 4 FROM sdocs) WHERE token <> '' GROUP BY product_uid, token""",
)
add_view(
    "slex",
    "sindex squeries",
    """
  WITH q AS (SELECT DISTINCT query_id, unnest(string_split(lower(text), ' ')) AS asked FROM squeries),
  f AS (SELECT a.asked, t.token, CASE WHEN a.asked = t.token THEN 1e0 ELSE 0.5e0 END AS factor FROM (SELECT DISTINCT asked FROM q) a JOIN (SELECT DISTINCT token FROM sindex) t
      ON a.asked = t.token OR (length(asked) >= 4 AND levenshtein(asked, token) <= 1)),
  s AS (SELECT query_id, product_uid, asked, max(weight * factor) AS s FROM q JOIN f USING (asked) JOIN sindex USING (token) GROUP BY ALL),
  n AS (SELECT query_id, count(*) AS need FROM q GROUP BY 1)
  SELECT query_id, product_uid, sum(s) AS score FROM s JOIN n USING (query_id) GROUP BY query_id, product_uid, need HAVING count(*) = need""",
)


@query("crossref_closure", "closure", "SELECT code, equivalent FROM closure")
def crossref_closure(spark, d):
    return search.crossref_closure(crossrefs(spark, d))


@query("approved_synonyms", "synonyms", "SELECT part_type, token FROM synonyms")
def approved_synonyms(spark, d):
    return search.approved_synonyms(synonym_decisions(spark, d))


@query(
    "search_documents",
    "sdocs",
    """SELECT product_uid, title, array_to_string(title_variants, '|') AS variants, array_to_string(part_numbers, ',') AS part_numbers, array_to_string(part_type_synonyms, ',') AS synonyms,
    has_image, price_freshness, round(best_seller_trust, 6) AS best_seller_trust FROM sdocs""",
)
def search_documents(spark, d):
    return documents(spark, d).select(
        "product_uid", "title", F.array_join("title_variants", "|").alias("variants"), F.array_join("part_numbers", ",").alias("part_numbers"),
        F.array_join("part_type_synonyms", ",").alias("synonyms"), "has_image", "price_freshness", F.round("best_seller_trust", 6).alias("best_seller_trust"),
    )


@query(
    "affected_documents",
    "sdocs crossrefs",
    """
  SELECT DISTINCT product_uid FROM (SELECT product_uid, part_type, unnest(part_numbers) AS code FROM sdocs) WHERE part_type = 'promo' OR code IN (SELECT code_a FROM crossrefs WHERE code_a LIKE '%5')""",
)
def affected_documents(spark, d):
    types = spark.createDataFrame([("promo",)], "part_type string")
    changed = crossrefs(spark, d).where("code_a LIKE '%5'").select(F.col("code_a").alias("code"))
    return search.affected_documents(documents(spark, d), types, changed)


@query(
    "embedding_reuse",
    "sdocs",
    """
  SELECT product_uid, sha256(array_to_string([title] || title_variants || [brand, part_type], ' | ')) AS text_hash, n % 6 = 0 AS needs_embedding FROM sdocs""",
)
def embedding_reuse(spark, d):
    """The stored hash of every sixth product is out of date."""
    docs = documents(spark, d)
    empty = spark.createDataFrame([], "product_uid string, text_hash string, embedding array<float>")
    first = search.embedding_reuse(docs, empty)
    vec = F.array(F.lit(1.0).cast("float"))
    stored = first.select("product_uid", F.when(F.col("n") % 6 == 0, "old").otherwise(F.col("text_hash")).alias("text_hash"), vec.alias("embedding"))
    return search.embedding_reuse(docs, stored).select("product_uid", "text_hash", "needs_embedding")


@query(
    "hashed_embedding",
    "",
    """
  WITH t AS (SELECT doc_id, lower(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) AS t FROM documents),
  f AS (SELECT doc_id, 'w:' || w AS f FROM (SELECT doc_id, unnest(string_split(t, ' ')) AS w FROM t) WHERE w <> ''
    UNION ALL SELECT doc_id, 'c:' || substr(p, CAST(i AS BIGINT), 4) FROM (SELECT doc_id, '  ' || t || '  ' AS p, unnest(range(1, length(t) + 2)) AS i FROM t)),
  n AS (SELECT doc_id, f, sha256(f) AS d, count(*) AS n FROM f GROUP BY doc_id, f),
  x AS (SELECT doc_id, CAST('0x' || substr(d, 1, 8) AS BIGINT) % 384 AS i, CAST(sum(CASE WHEN substr(d, 10, 1) IN ('1', '3', '5', '7', '9', 'b', 'd', 'f') THEN n ELSE -n END) AS BIGINT) AS x FROM n GROUP BY ALL),
  u AS (SELECT doc_id, CAST(sum(x * x) AS DOUBLE) AS sq FROM x GROUP BY doc_id)
  SELECT doc_id, CAST(i AS BIGINT) AS component, round(x / sqrt(sq), 4) AS value FROM x JOIN u USING (doc_id) WHERE x <> 0""",
)
def hashed_embedding(spark, d):
    """All components of all vectors that are not zero."""
    docs = v.spread(v.table(spark, d, "documents").select("doc_id", "text"))
    rows = search.hashed_embedding(docs, "doc_id", "text").select("doc_id", F.posexplode("embedding").alias("component", "value"))
    return rows.where("value <> 0").select("doc_id", "component", F.round(F.col("value").cast("double"), 4).alias("value"))


@query(
    "facet_filters",
    "sdocs squeries",
    f"""SELECT query_id, count(*) AS passing FROM squeries q JOIN sdocs ON {FILTER} AND (vehicle_slug IS NULL OR NOT list_contains(vehicles_incompatible, vehicle_slug)) GROUP BY query_id""",
)
def facet_filters(spark, d):
    """How many documents pass the filters of every search."""
    return search.passing_documents(queries(spark, d), documents(spark, d))


@query("exact_code_match", "sdocs squeries", "SELECT query_id, product_uid FROM squeries JOIN sdocs ON list_contains(part_numbers, code)")
def exact_code_match(spark, d):
    return search.exact_code_match(queries(spark, d), documents(spark, d))


def indexed(docs):
    return cut_lineage(search.inverted_index(docs))


@query("lexical_match", "slex", "SELECT query_id, product_uid, score AS lexical_score FROM slex")
def lexical_match(spark, d):
    return search.lexical_match(queries(spark, d), indexed(documents(spark, d)))


COS = """round(list_sum(list_transform(range(1, 65), lambda i: CAST(a.embedding[i] AS DOUBLE) * CAST(b.embedding[i] AS DOUBLE)))
    / sqrt(list_sum(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) * list_sum(list_transform(b.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6)"""


@query(
    "vector_knn",
    "",
    f"""
  SELECT query_id, id, rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, row_number() OVER (PARTITION BY a.vec_id ORDER BY {COS} DESC, b.vec_id) AS rank
    FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE rank <= 10""",
)
def vector_knn(spark, d):
    """All vectors ask and all answer."""
    vec = v.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    asked = vec.select(F.col("id").alias("query_id"), "embedding", F.col("id").alias("exclude_id"))
    return search.vector_knn(asked, vec.select("id", "embedding"), 10).select("query_id", "id", "rank")


add_view(
    "stexts",
    "squeries sdocs",
    """
  SELECT DISTINCT text FROM squeries UNION SELECT DISTINCT array_to_string([title] || title_variants || [brand, part_type], ' | ') FROM sdocs""",
)
add_view(
    "sfeatures",
    "stexts",
    """
  WITH t AS (SELECT text, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t FROM stexts),
  f AS (SELECT text, 'w:' || w AS f FROM (SELECT text, unnest(string_split(t, ' ')) AS w FROM t) WHERE w <> ''
    UNION ALL SELECT text, 'c:' || substr(p, CAST(i AS BIGINT), 4) FROM (SELECT text, '  ' || t || '  ' AS p, unnest(range(1, length(t) + 2)) AS i FROM t)),
  h AS (SELECT text, sha256(f) AS d FROM f)
  SELECT text, CAST('0x' || substr(d, 1, 8) AS BIGINT) % 384 AS i, CAST(sum(CASE WHEN substr(d, 10, 1) IN ('1', '3', '5', '7', '9', 'b', 'd', 'f') THEN 1 ELSE -1 END) AS BIGINT) AS x FROM h GROUP BY ALL""",
)
add_view("ssquares", "sfeatures", "SELECT text, CAST(sum(x * x) AS BIGINT) AS sq FROM sfeatures GROUP BY text HAVING sum(x * x) > 0")
add_view(
    "svec",
    "squeries sdocs sfeatures ssquares",
    """
  WITH q AS (SELECT DISTINCT text FROM squeries), x AS (SELECT product_uid, array_to_string([title] || title_variants || [brand, part_type], ' | ') AS t FROM sdocs),
  dots AS (SELECT a.text AS q, b.text AS t, CAST(sum(a.x * b.x) AS BIGINT) AS dot FROM sfeatures a JOIN sfeatures b USING (i)
    WHERE a.text IN (SELECT text FROM q) AND b.text IN (SELECT t FROM x) GROUP BY ALL),
  pairs AS (SELECT q.text AS q, x.product_uid, coalesce(dot, 0) / sqrt(CAST(a.sq * b.sq AS DOUBLE)) AS score
    FROM q JOIN ssquares a ON a.text = q.text CROSS JOIN x JOIN ssquares b ON b.text = x.t LEFT JOIN dots d ON d.q = q.text AND d.t = x.t)
  SELECT query_id, product_uid, score FROM squeries JOIN pairs ON q = text""",
)


def hybrid(spark, d):
    docs = documents(spark, d)
    asked = queries(spark, d)
    matched = search.match_texts(asked.select(F.lower("text").alias("text")).distinct(), indexed(docs))
    return search.hybrid_search(asked, docs, cut_lineage(matched), search.product_index(docs), v.as_of(NOW))


BUSINESS = f"""least(ln(1 + offer_count), 4e0) * 0.025e0 + has_image::INT * 0.03e0 + CASE WHEN price_freshness > 0 THEN exp(-greatest(0e0, (epoch(TIMESTAMP '{NOW}') - price_freshness) / 86400e0) / 30e0) ELSE 0e0 END * 0.04e0
    + greatest(0e0, least(1e0, best_seller_trust)) * 0.06e0 + CASE WHEN list_contains(vehicles_compatible, vehicle_slug) THEN 0.45e0 ELSE 0e0 END"""


def _run_views(suffix: str, source: str, use_vehicle: bool) -> None:
    veh = "(vehicle_slug IS NULL OR NOT list_contains(vehicles_incompatible, vehicle_slug))" if use_vehicle else "true"
    for ch, src in (("l", "slex"), ("v", "svec")):
        add_view(
            f"ch_{ch}{suffix}",
            f"{src} {source} sdocs",
            f"""SELECT query_id, product_uid, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_uid) AS rank FROM {src} JOIN {source} USING (query_id) JOIN sdocs USING (product_uid)
            WHERE {FILTER} AND {veh} QUALIFY rank <= 250""",
        )
    add_view(
        f"run{suffix}",
        f"ch_l{suffix} ch_v{suffix} {source} sdocs",
        f"""
  WITH x AS (SELECT query_id, product_uid FROM {source} JOIN sdocs ON list_contains(part_numbers, code) WHERE {FILTER} AND {veh})
  SELECT query_id, product_uid, CAST(NULL AS DOUBLE) AS rrf, true AS is_exact FROM x
  UNION ALL SELECT query_id, product_uid, sum(1e0 / (60 + rank)), false FROM (SELECT * FROM ch_l{suffix} UNION ALL SELECT * FROM ch_v{suffix})
    WHERE (query_id, product_uid) NOT IN (SELECT (query_id, product_uid) FROM x) GROUP BY query_id, product_uid""",
    )


_run_views("1", "squeries", True)
add_view(
    "short_queries",
    "squeries run1",
    "SELECT * FROM squeries WHERE vehicle_slug IS NOT NULL AND query_id NOT IN (SELECT query_id FROM run1 GROUP BY 1 HAVING count(*) >= 5)",
)
_run_views("2", "short_queries", False)
add_view(
    "hits",
    "run1 run2 short_queries",
    f"""
  SELECT r.*, s.*, q.vehicle_slug, round(CASE WHEN is_exact THEN {BUSINESS} ELSE rrf + {BUSINESS} END, 6) AS score FROM (
    SELECT *, false AS fallback_applied FROM run1 WHERE query_id NOT IN (SELECT query_id FROM short_queries) UNION ALL SELECT *, true FROM run2) r
  JOIN squeries q USING (query_id) JOIN sdocs s ON s.product_uid = r.product_uid""",
)


@query(
    "hybrid_search",
    "hits",
    """SELECT query_id, product_uid, is_exact, fallback_applied, score, row_number() OVER (PARTITION BY query_id ORDER BY is_exact DESC, score DESC, product_uid) AS position FROM hits""",
)
def hybrid_search(spark, d):
    return hybrid(spark, d).select("query_id", "product_uid", "is_exact", "fallback_applied", "score", "position")


@query(
    "rrf_fuse",
    "slex svec sdocs",
    f"""
  WITH l AS (SELECT query_id, product_uid, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_uid) AS rank FROM slex QUALIFY rank <= 250 UNION ALL
    SELECT query_id, product_uid, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_uid) AS rank FROM svec JOIN squeries USING (query_id) JOIN sdocs USING (product_uid)
      WHERE {FILTER} QUALIFY rank <= 250)
  SELECT query_id, product_uid, round(sum(1e0 / (60 + rank)), 6) AS rrf FROM l GROUP BY ALL""",
)
def rrf_fuse(spark, d):
    """The candidates of both channels; the vector channel looks at all filters but the vehicle."""
    docs = documents(spark, d)
    asked, members = search.distinct_searches(queries(spark, d))
    lex = search.lexical_match(asked, indexed(docs))
    order = Window.partitionBy("query_id").orderBy(F.desc("lexical_score"), "product_uid")
    lex = lex.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= SearchParams().candidate_limit)
    none = spark.createDataFrame([], "query_id string, product_uid string")
    out = search.rrf_fuse(lex, search.vector_channel(asked, search.product_index(docs), False), none).withColumnRenamed("query_id", "__sign")
    return members.join(out, "__sign").select("query_id", "product_uid", F.round("rrf", 6).alias("rrf"))


@query("business_score", "sdocs", f"SELECT product_uid, round({BUSINESS}, 6) AS score FROM (SELECT *, 'v7' AS vehicle_slug FROM sdocs)")
def business_score(spark, d):
    return documents(spark, d).select("product_uid", F.round(search.business_score(v.as_of(NOW), F.lit("v7")), 6).alias("score"))


@query("vehicle_fallback", "hits", "SELECT query_id, count(*) AS hits FROM hits WHERE fallback_applied GROUP BY query_id")
def vehicle_fallback(spark, d):
    return hybrid(spark, d).where("fallback_applied").groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))


@query(
    "fitment_marker",
    "hits",
    """
  SELECT query_id, fitment_status, count(*) AS n FROM (SELECT query_id, CASE WHEN vehicle_slug IS NULL THEN 'not_requested' WHEN list_contains(vehicles_compatible, vehicle_slug) THEN 'fits'
    WHEN list_contains(vehicles_incompatible, vehicle_slug) THEN 'incompatible' ELSE 'unverified' END AS fitment_status FROM hits) GROUP BY ALL""",
)
def fitment_marker(spark, d):
    return hybrid(spark, d).groupBy("query_id", "fitment_status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "facet_counts",
    "hits",
    """
  SELECT query_id, 'vehicles' AS facet, value, count(*) AS count FROM (SELECT query_id, unnest(vehicles_compatible) AS value FROM hits) GROUP BY ALL
  UNION ALL SELECT query_id, 'brands', brand, count(*) FROM hits GROUP BY ALL UNION ALL SELECT query_id, 'part_types', part_type, count(*) FROM hits GROUP BY ALL
  UNION ALL SELECT query_id, 'authenticity', authenticity_dominant, count(*) FROM hits GROUP BY ALL
  UNION ALL SELECT query_id, 'price_ranges', 'under_1m', count(*) FROM hits WHERE min_price_toman IS NOT NULL GROUP BY ALL""",
)
def facet_counts(spark, d):
    return search.facet_counts(hybrid(spark, d))


@query(
    "suggest",
    "sdocs",
    """
  WITH q AS (SELECT DISTINCT user_id AS query_id, CASE user_id % 4 WHEN 0 THEN 'mod' WHEN 1 THEN 'pn10' || (user_id % 9) WHEN 2 THEN 'pro' ELSE 'RING' END AS prefix FROM events),
  w AS (SELECT product_uid, offer_count, unnest(string_split(lower(title), ' ')) AS w, 8 AS weight FROM sdocs UNION ALL SELECT product_uid, offer_count, unnest(list_transform(part_numbers, lambda t: lower(t))), 6 FROM sdocs
    UNION ALL SELECT product_uid, offer_count, unnest(flatten(list_transform(title_variants, lambda t: string_split(lower(t), ' ')))), 5 FROM sdocs),
  h AS (SELECT query_id, product_uid, offer_count, max(weight) AS weight FROM q JOIN w ON starts_with(w, lower(prefix)) GROUP BY ALL)
  SELECT query_id, product_uid, row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, offer_count DESC, product_uid) AS position FROM h QUALIFY position <= 10""",
)
def suggest(spark, d):
    u = F.col("user_id")
    q = v.table(spark, d, "events").select(
        u.alias("query_id"),
        F.when(u % 4 == 0, "mod").when(u % 4 == 1, F.concat(F.lit("pn10"), u % 9)).when(u % 4 == 2, "pro").otherwise("RING").alias("prefix"),
    ).distinct()
    words = cut_lineage(search.suggestion_words(documents(spark, d)))
    return search.suggest(q, words, search.prefix_table(words)).select("query_id", "product_uid", "position")


def query_log(spark, d):
    ev = v.table(spark, d, "events").where("event_type = 'view'")
    e = F.col("event_id")
    uids = F.transform(F.sequence(F.lit(1), (e % 6).cast("int")), lambda i: F.concat(F.lit("p"), (e + i) % 50))
    shown = F.when(e % 6 == 0, F.array().cast("array<string>")).otherwise(uids)
    return ev.select(
        e.alias("query_id"), F.concat(F.lit("q"), F.col("user_id") % 15).alias("normalized_text"), F.concat(F.lit("v"), F.col("user_id") % 4).alias("vehicle_slug"),
        F.lit("{}").alias("filters"), F.size(shown).cast("long").alias("result_count"), shown.alias("result_uids"), F.col("ts").cast("timestamp").alias("created_at"),
    )


def log_clicks(spark, d):
    log = query_log(spark, d)
    e = F.col("query_id")
    good = log.select("query_id", (e * 2).alias("click_id"), (e % 4 + 1).alias("position"), F.concat(F.lit("p"), (e + e % 4 + 1) % 50).alias("product_uid"), F.lit(2).alias("clicked_at"))
    bad = log.select("query_id", (e * 2 + 1).alias("click_id"), F.lit(1).cast("long").alias("position"), F.lit("pX").alias("product_uid"), F.lit(1).alias("clicked_at"))
    return good.unionByName(bad)


add_view("slog", "", "SELECT event_id AS query_id, event_id % 6 AS result_count, user_id, ts, CASE WHEN event_id % 4 + 1 <= event_id % 6 THEN event_id % 4 + 1 END AS clicked_position FROM events WHERE event_type = 'view'")


@query("query_click_join", "slog", "SELECT query_id, clicked_position, 'p' || ((query_id + clicked_position) % 50) AS clicked_product_uid FROM slog WHERE clicked_position IS NOT NULL")
def query_click_join(spark, d):
    return search.query_click_join(query_log(spark, d), log_clicks(spark, d))


@query(
    "zero_result_report",
    "slog",
    f"""SELECT 'q' || (user_id % 15) AS normalized_text, 'v' || (user_id % 4) AS vehicle_slug, '{{}}' AS filters, count(*) AS query_count, epoch_us(max(ts)) // 1000000 AS last_seen
    FROM slog WHERE result_count = 0 AND ts >= TIMESTAMP '{v.CLICK_NOW}' - INTERVAL 7 DAY GROUP BY ALL""",
)
def zero_result_report(spark, d):
    return search.zero_result_report(query_log(spark, d), v.as_of(v.CLICK_NOW)).withColumn("last_seen", F.unix_timestamp("last_seen"))


@query(
    "search_quality",
    "slog",
    "SELECT count(*) AS queries, count(clicked_position) AS clicked, round(count(clicked_position) / count(*), 6) AS ctr, round(avg(clicked_position), 6) AS mean_clicked_rank, round(count(*) FILTER (WHERE clicked_position = 1) / count(*), 6) AS ctr_top FROM slog",
)
def search_quality(spark, d):
    log = query_log(spark, d).join(search.query_click_join(query_log(spark, d), log_clicks(spark, d)), "query_id", "left")
    out = search.search_quality(log)
    return out.select("queries", "clicked", *[F.round(c, 6).alias(c) for c in ("ctr", "mean_clicked_rank", "ctr_top")])
