"""Product assembly queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from karvan.operators import catalog, cdc, feeds, pricing, ranking
from karvan.plans import views as v
from karvan.plans.q_history import MEDIAN, seller_trust
from karvan.plans.q_ranking import ranked
from karvan.plans.registry import query
from karvan.plans.sqlviews import add_view
from karvan.session import cut_lineage


# ------------------------------------------------------------------ derived inputs


def cluster_events(spark, d):
    """Full-state membership per product and year; at most 100 sellers each."""
    ev = v.price_events(spark, d)
    return ev.groupBy(F.col("product_uid").alias("cluster_uid"), F.year("occurred_at").alias("y")).agg(
        F.max("occurred_at").alias("occurred_at"),
        F.max("event_id").alias("event_id"),
        F.collect_set("offer_uid").alias("members"),
    )


def clusters(spark, d):
    """Current clusters with lineage: n%10=7 -> n+1; n%10=8 is emptied into n%10=9."""
    n = F.floor(F.col("p_partkey") / 10)
    base = v.table(spark, d, "part").select(n.alias("n")).distinct()
    uid = lambda k: F.concat(F.lit("p"), F.col("n") + k)
    tail = F.col("n") % 10
    none = F.array().cast("array<string>")
    return base.select(
        uid(0).alias("cluster_uid"),
        F.timestamp_seconds(F.col("n")).alias("occurred_at"),
        F.when(tail.isin(7, 8), none).otherwise(F.array(uid(0))).alias("members"),
        F.when(tail == 9, F.array(uid(-1), uid(-3))).otherwise(none).alias("predecessor_uids"),
        F.when(tail == 7, uid(1)).alias("successor_uid"),
    )


add_view(
    "clusters",
    "",
    """
  SELECT 'p' || n AS cluster_uid, n, n % 10 AS tail, CASE WHEN n % 10 = 7 THEN 'p' || (n + 1) END AS successor_uid
  FROM (SELECT DISTINCT p_partkey // 10 AS n FROM part)""",
)
add_view(
    "successors",
    "clusters",
    """
  SELECT c.cluster_uid, coalesce(c.successor_uid, CASE WHEN c.tail = 8 THEN n.cluster_uid END) AS successor_uid
  FROM clusters c LEFT JOIN clusters n ON n.n = c.n + 1""",
)
add_view(
    "chain",
    "successors",
    """
  SELECT cluster_uid AS uid, successor_uid AS nxt FROM successors WHERE successor_uid IS NOT NULL
  UNION ALL SELECT uid, s.successor_uid FROM chain JOIN successors s ON s.cluster_uid = nxt WHERE s.successor_uid IS NOT NULL""",
)
add_view(
    "finals",
    "chain successors",
    """SELECT uid, nxt AS final FROM chain JOIN successors s ON s.cluster_uid = nxt WHERE s.successor_uid IS NULL""",
)


def crossrefs(spark, d):
    """Edges PN(n) - PN(n+1) where n%5 < 2: chains of three codes."""
    n = F.floor(F.col("p_partkey") / 10)
    base = v.table(spark, d, "part").select(n.alias("n")).distinct().where("n % 5 < 2")
    return base.select(
        F.concat(F.lit("PN"), F.col("n") + 1000).alias("code_a"),
        F.concat(F.lit("PN"), F.col("n") + 1001).alias("code_b"),
    )


add_view(
    "crossrefs",
    "clusters",
    "SELECT 'PN' || (n + 1000) AS code_a, 'PN' || (n + 1001) AS code_b FROM clusters WHERE n % 5 < 2",
)


def members(spark, d):
    """Active members with the trust of their seller."""
    trust = seller_trust(spark, d).select("supp_key", "trust_score", "is_panel")
    return (
        v.offers(spark, d, trust)
        .where("is_active")
        .withColumnRenamed("occurred_at", "last_seen_at")
        .withColumnRenamed("is_panel", "is_panel_offer")
        .withColumn("raw_title", F.upper("title_normalized"))
    )


def listed_members(spark, d):
    """Members with what elections and titles read, written once; the raw title is spelled after."""
    listed = members(spark, d).select(
        "product_uid", "offer_uid", "authenticity_claim", "title_normalized", "brand", "part_number", "part_type",
        "image_url", "price_toman", "trust_score",
    )
    return cut_lineage(listed).withColumn("raw_title", F.upper("title_normalized"))


add_view(
    "members",
    "active_offers seller_trust",
    "SELECT o.*, t.trust_score, t.is_panel AS is_panel_offer FROM active_offers o JOIN seller_trust t USING (seller_key)",
)
add_view(
    "claims_dominant",
    "members",
    """
  SELECT product_uid, authenticity_claim AS authenticity_dominant FROM (
    SELECT product_uid, authenticity_claim, count(*) AS n FROM members GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY product_uid ORDER BY authenticity_claim = 'unknown', n DESC,
    list_position(['genuine','oem','aftermarket','refurbished','used','unknown'], authenticity_claim)) = 1""",
)
COMPLETE = """((title_normalized <> '')::INT + (brand IS NOT NULL)::INT + (part_number IS NOT NULL)::INT + (part_type IS NOT NULL)::INT
    + (image_url IS NOT NULL)::INT + (coalesce(price_toman, 0) <> 0)::INT) / 6e0"""
IMAGE = "CASE WHEN image_url IS NULL THEN 0e0 WHEN image_url LIKE '%logo%' THEN 0.3e0 ELSE 1e0 END"
add_view(
    "elected",
    "members claims_dominant",
    f"""
  SELECT *, row_number() OVER (PARTITION BY product_uid ORDER BY score DESC, offer_uid) AS place FROM (
    SELECT m.*, authenticity_dominant, round(0.5e0 * {COMPLETE} + 0.25e0 * greatest(0e0, least(1e0, trust_score)) + 0.2e0 * {IMAGE}
      + 0.05e0 * (length(title_normalized) BETWEEN 12 AND 90)::INT, 6) AS score
    FROM members m JOIN claims_dominant c USING (product_uid) WHERE authenticity_claim = authenticity_dominant)""",
)


# ------------------------------------------------------------------------- queries


@query(
    "cluster_membership",
    "price_events",
    """
  SELECT DISTINCT product_uid, offer_uid FROM price_events
  QUALIFY year(occurred_at) = max(year(occurred_at)) OVER (PARTITION BY product_uid)""",
)
def cluster_membership(spark, d):
    return catalog.cluster_membership(cluster_events(spark, d))


@query("retire_predecessors", "successors", "SELECT cluster_uid, successor_uid FROM successors")
def retire_predecessors(spark, d):
    return catalog.retire_predecessors(clusters(spark, d)).select("cluster_uid", "successor_uid")


def finals(spark, d):
    retired = catalog.retire_predecessors(clusters(spark, d))
    pointers = retired.select(F.col("cluster_uid").alias("uid"), F.col("successor_uid").alias("successor"))
    return catalog.successor_chain(pointers)


@query("successor_chain", "finals", "SELECT uid, final FROM finals")
def successor_chain(spark, d):
    return finals(spark, d)


@query(
    "redirect_resolution",
    "finals clusters",
    """
  WITH s AS (SELECT cluster_uid AS slug, cluster_uid AS product_uid FROM clusters
    UNION ALL SELECT 'new-' || cluster_uid, cluster_uid FROM clusters)
  SELECT slug, product_uid, coalesce(final, product_uid) AS target_uid, 'new-' || coalesce(final, product_uid) AS target_slug,
    CASE WHEN final IS NOT NULL THEN 'retired' WHEN slug NOT LIKE 'new-%' THEN 'renamed' ELSE 'current' END AS reason
  FROM s LEFT JOIN finals ON uid = product_uid""",
)
def redirect_resolution(spark, d):
    base = clusters(spark, d).select(F.col("cluster_uid").alias("product_uid"))
    current = base.withColumn("slug", F.concat(F.lit("new-"), "product_uid"))
    history = current.unionByName(base.withColumn("slug", F.col("product_uid")))
    return catalog.redirect_resolution(history, current, finals(spark, d))


@query(
    "modal_brand_part_type",
    "active_offers",
    """
  WITH b AS (SELECT product_uid, brand FROM (SELECT product_uid, brand, count(*) n FROM active_offers WHERE brand IS NOT NULL GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY product_uid ORDER BY n DESC, brand) = 1),
  t AS (SELECT product_uid, part_type FROM (SELECT product_uid, part_type, count(*) n FROM active_offers WHERE part_type IS NOT NULL GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY product_uid ORDER BY n DESC, part_type) = 1)
  SELECT p.product_uid, brand, part_type FROM (SELECT DISTINCT product_uid FROM active_offers) p LEFT JOIN b USING (product_uid) LEFT JOIN t USING (product_uid)""",
)
def modal_brand_part_type(spark, d):
    return catalog.modal(v.offers(spark, d).where("is_active"), "product_uid", ["brand", "part_type"])


@query("authenticity_dominant", "claims_dominant", "SELECT * FROM claims_dominant")
def authenticity_dominant(spark, d):
    return catalog.authenticity_dominant(v.price_state(spark, d).where("is_active"))


@query(
    "elect_representative",
    "elected",
    """
  SELECT product_uid, max(authenticity_dominant) AS authenticity_dominant, max(CASE WHEN place = 1 THEN offer_uid END) AS offer_uid,
    max(CASE WHEN place = 1 THEN score END) AS winning_score, max(CASE WHEN place = 2 THEN offer_uid END) AS runner_up,
    count(*) AS candidates_considered, 'scored' AS rule FROM elected GROUP BY product_uid""",
)
def elect_representative(spark, d):
    return catalog.elect_representative(listed_members(spark, d))


@query(
    "image_score",
    "members",
    f"SELECT offer_uid, round({COMPLETE}, 6) AS completeness, {IMAGE} AS image_score FROM members",
)
def image_score(spark, d):
    return members(spark, d).select(
        "offer_uid", F.bround(catalog.completeness(), 6).alias("completeness"),
        catalog.image_score(F.col("image_url")).alias("image_score"),
    )


@query("completeness", "members", f"SELECT offer_uid, round({COMPLETE}, 6) AS completeness FROM members")
def completeness(spark, d):
    return members(spark, d).select("offer_uid", F.bround(catalog.completeness(), 6).alias("completeness"))


@query(
    "product_title",
    "elected",
    "SELECT product_uid, title_normalized AS title, CAST(0 AS BIGINT) AS title_tier FROM elected WHERE place = 1",
)
def product_title(spark, d):
    m = listed_members(spark, d)
    return catalog.product_title(m, catalog.elect_representative(m))


@query(
    "crossref_expand_one_hop",
    "active_offers crossrefs",
    """
  WITH n AS (SELECT DISTINCT product_uid, part_number AS code FROM active_offers WHERE part_number IS NOT NULL),
  e AS (SELECT code_a AS a, code_b AS b FROM crossrefs UNION ALL SELECT code_b, code_a FROM crossrefs),
  h AS (SELECT product_uid, b AS code FROM n JOIN e ON a = code
    UNION SELECT product_uid, 'SEED' || substr(product_uid, 2) FROM n UNION SELECT product_uid, code FROM n)
  SELECT * FROM h EXCEPT SELECT * FROM n""",
)
def crossref_expand_one_hop(spark, d):
    numbers = (
        v.offers(spark, d).where("is_active AND part_number IS NOT NULL")
        .select("product_uid", F.col("part_number").alias("code")).distinct()
    )
    seed = F.concat(F.lit("SEED"), F.expr("substr(product_uid, 2)"))
    seeds = numbers.unionByName(numbers.withColumn("code", seed))
    return catalog.crossref_expand_one_hop(numbers, crossrefs(spark, d), seeds)


@query(
    "panel_offer_suppression",
    "members",
    """
  SELECT product_uid, count(*) AS visible_offers FROM members
  WHERE NOT (is_panel_offer AND seller_key IN ('s0', 's3', 's30')) GROUP BY product_uid""",
)
def panel_offer_suppression(spark, d):
    state = v.sellers(spark, d).select(
        "seller_key", (~F.col("seller_key").isin("s0", "s3", "s30", "s31")).alias("panel_offers_active")
    )
    out = catalog.panel_offer_suppression(members(spark, d), state)
    return out.groupBy("product_uid").agg(F.count(F.lit(1)).alias("visible_offers"))


@query(
    "publication_gate",
    "price_state",
    """
  WITH p AS (SELECT product_uid, count(*) FILTER (WHERE is_active AND stock_status = 'in_stock') AS offer_count,
      count(price_toman) FILTER (WHERE price_toman > 75000) > 0 AS has_price, count(*) % 3 AS substance_facts,
      count(*) % 7 = 0 AS is_retired, count(*) % 2 = 0 AS has_risky_family FROM price_state GROUP BY product_uid)
  SELECT product_uid, array_to_string(list_filter([
    CASE WHEN is_retired THEN 'retired' END, CASE WHEN offer_count < 1 THEN 'no_active_offers' END,
    CASE WHEN product_uid = 'p3' THEN 'empty_title' END,
    CASE WHEN substr(product_uid, -1) = '5' THEN 'promotional_title' END,
    CASE WHEN NOT has_price THEN 'no_usable_price' END, CASE WHEN substance_facts < 1 THEN 'thin_content' END,
    CASE WHEN has_risky_family AND substance_facts < 2 THEN 'risky_family_without_verdict' END], lambda x: x IS NOT NULL), ',') AS reasons FROM p""",
)
def publication_gate(spark, d):
    s = v.price_state(spark, d)
    n = F.count(F.lit(1))
    p = s.groupBy("product_uid").agg(
        F.count_if(F.col("is_active") & (F.col("stock_status") == "in_stock")).alias("offer_count"),
        (F.count_if(F.col("price_toman") > 75000) > 0).alias("has_price"),
        (n % 3).alias("substance_facts"),
        (n % 7 == 0).alias("is_retired"),
        (n % 2 == 0).alias("has_risky_family"),
    )
    uid = F.col("product_uid")
    p = (
        p.withColumn("title", F.when(uid == "p3", " ").when(F.substring(uid, -1, 1) == "5", F.concat(uid, F.lit(" best price"))).otherwise(uid))
        .withColumn("risky_note", F.lit(None).cast("string"))
        .withColumn("has_explicit_verdict", F.col("substance_facts") >= 2)
    )
    return p.select(uid, F.array_join(catalog.publication_gate(), ",").alias("reasons"))


def documents(spark, d):
    m = cut_lineage(members(spark, d))  # read six times below: written once
    elected = catalog.elect_representative(m)
    title = catalog.product_title(m, elected)
    r = ranking.rank_offers(m, v.as_of())
    badge = pricing.cheapest_badge(r)
    header = catalog.product_header(m, elected, title, pricing.price_stats(m), badge.drop("grade"))
    header = (
        header.withColumn("is_retired", F.lit(False))
        .withColumn("has_risky_family", F.lit(False))
        .withColumn("risky_note", F.lit(None).cast("string"))
    )
    from karvan.plans.q_fitment import product_fitments

    lists = catalog.vehicle_lists(product_fitments(spark, d))
    numbers = m.where("part_number IS NOT NULL").select("product_uid", F.col("part_number").alias("code")).distinct()
    codes = catalog.crossref_expand_one_hop(numbers, crossrefs(spark, d), numbers)
    series = pricing.daily_price_series(cdc.price_change_points(v.price_events(spark, d)), v.SERIES_FROM, v.SERIES_TO)
    return catalog.build_product_document(header, catalog.offer_pages(r, badge), lists, codes, series)


@query(
    "build_product_document",
    "elected product_verdicts crossrefs scored_offers",
    f"""
  WITH t AS (SELECT product_uid, title_normalized AS title, authenticity_dominant, image_url, offer_uid FROM elected WHERE place = 1),
  a AS (SELECT product_uid, count(*) AS offer_count, min(CASE WHEN stock_status = 'in_stock' THEN price_toman END) AS min_price_toman,
      {MEDIAN.format("CASE WHEN stock_status = 'in_stock' THEN price_toman END")} AS median_price_toman,
      array_to_string(list_sort(list_distinct(list(part_number) FILTER (WHERE part_number IS NOT NULL))), ',') AS part_numbers,
      string_agg(offer_uid, ',' ORDER BY rank_position) AS offers FROM (
        SELECT m.*, r.rank_position FROM members m JOIN (SELECT offer_uid, row_number() OVER (PARTITION BY product_uid ORDER BY trust_band DESC, secondary DESC, offer_uid) AS rank_position FROM scored_offers) r USING (offer_uid)) GROUP BY product_uid),
  c AS (SELECT product_uid, count(*) AS n_codes FROM (
      SELECT DISTINCT n.product_uid, e.b FROM members n JOIN (SELECT code_a AS a, code_b AS b FROM crossrefs UNION ALL SELECT code_b, code_a FROM crossrefs) e ON a = n.part_number
      WHERE NOT EXISTS (SELECT 1 FROM members x WHERE x.product_uid = n.product_uid AND x.part_number = e.b)) GROUP BY product_uid),
  f AS (SELECT product_uid, array_to_string(list_sort(list(vehicle_slug) FILTER (WHERE status = 'compatible')), ',') AS vehicles FROM product_verdicts GROUP BY product_uid)
  SELECT t.product_uid, title, authenticity_dominant, t.offer_uid AS representative_uid, offer_count, min_price_toman, median_price_toman,
    coalesce(part_numbers, '') AS part_numbers, coalesce(n_codes, 0) AS n_codes, coalesce(vehicles, '') AS vehicles, offers
  FROM t JOIN a USING (product_uid) LEFT JOIN c USING (product_uid) LEFT JOIN f USING (product_uid)""",
)
def build_product_document(spark, d):
    doc = documents(spark, d)
    return doc.select(
        "product_uid", "title", "authenticity_dominant", "representative_uid", "offer_count",
        "min_price_toman", "median_price_toman",
        F.array_join("part_numbers", ",").alias("part_numbers"),
        F.size("crossref_codes").cast("long").alias("n_codes"),
        F.array_join("vehicles_compatible", ",").alias("vehicles"),
        F.array_join(F.col("offers.offer_uid"), ",").alias("offers"),
    )


def product_cards(spark, d, state=None):
    """Compact product rows for related parts and the public feeds; ``state``: ``price_state`` where it is there already."""
    n = F.floor(F.col("p_partkey") / 10)
    base = v.table(spark, d, "part").groupBy(n.alias("n")).agg(
        F.min_by(F.lower("p_type"), "p_partkey").alias("part_type"),
        F.array_sort(F.collect_set(F.concat(F.lit("v"), F.col("p_partkey") % 250))).alias("vehicles"),
    )
    traffic = v.clicks(spark, d).groupBy("product_uid").agg(F.count(F.lit(1)).alias("click_count"))
    state = v.price_state(spark, d) if state is None else state
    stats = state.where("is_active").groupBy("product_uid").agg(
        F.count(F.lit(1)).alias("offer_count"), F.min("price_toman").alias("min_price_toman"),
        F.max("occurred_at").alias("updated_at"),
    )
    code = F.concat(F.lit("PN"), F.col("n") + 1000)
    nxt = F.concat(F.lit("PN"), F.col("n") + 1001)
    none = F.array().cast("array<string>")
    return (
        base.withColumn("product_uid", F.concat(F.lit("p"), "n"))
        .join(stats, "product_uid")
        .join(traffic, "product_uid", "left")
        .withColumn("click_count", F.coalesce("click_count", F.lit(0)))
        .withColumn("codes", F.concat(F.array(code), F.when(F.col("n") % 5 < 2, F.array(nxt)).otherwise(none)))
        .withColumn("is_published", F.col("n") % 11 != 0)
        .withColumn("is_retired", (F.col("n") % 10).isin(7, 8))
    )


add_view(
    "product_cards",
    "clicks price_state",
    """
  SELECT b.*, s.*, coalesce(click_count, 0) AS click_count, n % 11 <> 0 AS is_published, n % 10 IN (7, 8) AS is_retired,
    CASE WHEN n % 5 < 2 THEN ['PN' || (n + 1000), 'PN' || (n + 1001)] ELSE ['PN' || (n + 1000)] END AS codes
  FROM (SELECT p_partkey // 10 AS n, arg_min(lower(p_type), p_partkey) AS part_type,
      list_sort(list_distinct(list('v' || (p_partkey % 250)))) AS vehicles FROM part GROUP BY 1) b
  JOIN (SELECT product_uid, count(*) AS offer_count, min(price_toman) AS min_price_toman, max(occurred_at) AS updated_at
    FROM price_state WHERE is_active GROUP BY product_uid) s ON s.product_uid = 'p' || n
  LEFT JOIN (SELECT product_uid AS pu, count(*) AS click_count FROM clicks GROUP BY 1) ON pu = s.product_uid""",
)


@query(
    "related_products",
    "product_cards",
    """
  WITH pairs AS (SELECT a.product_uid AS me, b.*, a.part_type AS pt, a.vehicles AS mv, a.codes AS mc FROM product_cards a JOIN product_cards b
      ON a.product_uid <> b.product_uid AND b.is_published AND NOT b.is_retired
      AND (a.part_type = b.part_type OR list_has_any(a.codes, b.codes))
    QUALIFY row_number() OVER (PARTITION BY a.product_uid ORDER BY b.updated_at DESC, b.product_uid) <= 32),
  t AS (SELECT *, CASE WHEN pt = part_type AND list_has_any(mv, vehicles) THEN 0 WHEN list_has_any(mc, codes) THEN 1 ELSE 2 END AS tier FROM pairs)
  SELECT me AS product_uid, product_uid AS related_uid, CAST(tier AS BIGINT) AS tier, row_number() OVER (PARTITION BY me ORDER BY tier, click_count DESC, offer_count DESC, product_uid) AS position
  FROM t QUALIFY position <= 8""",
)
def related_products(spark, d):
    return ranking.related_products(product_cards(spark, d))


@query(
    "product_batch_lookup",
    "product_cards",
    """
  SELECT DISTINCT 'p' || (user_id * 3) AS product_uid, offer_count, pc.product_uid IS NULL AS is_missing
  FROM events LEFT JOIN product_cards pc ON pc.product_uid = 'p' || (user_id * 3)""",
)
def product_batch_lookup(spark, d):
    asked = v.table(spark, d, "events").select(F.concat(F.lit("p"), F.col("user_id") * 3).alias("product_uid"))
    docs = product_cards(spark, d).select("product_uid", "offer_count")
    return catalog.product_batch_lookup(asked, docs)


@query(
    "sitemap_shards",
    "product_cards",
    """
  SELECT product_uid, 'x-' || product_uid AS slug, CAST(epoch(updated_at) AS BIGINT) AS lastmod,
    CAST((row_number() OVER (ORDER BY click_count DESC, product_uid) - 1) // 50 AS BIGINT) AS shard
  FROM product_cards WHERE is_published AND NOT is_retired""",
)
def sitemap_shards(spark, d):
    cards = product_cards(spark, d).select(
        "product_uid", F.concat(F.lit("x-"), "product_uid").alias("slug"), "is_published", "is_retired",
        F.unix_timestamp("updated_at").alias("lastmod"), F.col("click_count").alias("priority"),
    )
    return feeds.sitemap_shards(cards, 50).drop("position")


@query(
    "landing_hubs",
    "product_cards",
    """
  WITH r AS (SELECT unnest(vehicles) AS vehicle, part_type, offer_count, min_price_toman FROM product_cards WHERE is_published)
  SELECT vehicle, part_type, count(*) AS products, CAST(sum(offer_count) AS BIGINT) AS offers, min(min_price_toman) AS min_price_toman FROM r GROUP BY vehicle, part_type
  UNION ALL SELECT vehicle, NULL, count(*), CAST(sum(offer_count) AS BIGINT), min(min_price_toman) FROM r GROUP BY vehicle
  UNION ALL SELECT NULL, part_type, count(*), CAST(sum(offer_count) AS BIGINT), min(min_price_toman) FROM product_cards WHERE is_published GROUP BY part_type""",
)
def landing_hubs(spark, d):
    return feeds.landing_hubs(product_cards(spark, d))
