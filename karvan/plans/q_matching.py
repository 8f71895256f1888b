"""Entity resolution queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from karvan.functions.text import STOP_WORDS
from karvan.operators import graph, matching
from karvan.plans import views as v
from karvan.plans.q_catalog import crossrefs
from karvan.plans.registry import query
from karvan.plans.sqlviews import add_view
from karvan.session import cut_lineage

SIM = 0.5


def match_offers(spark, d):
    """Active offers; the title lacks the number when the field lacks it."""
    o = v.offers(spark, d).where("is_active")
    k = F.expr("CAST(substr(product_uid, 2) AS BIGINT)")
    hidden = F.col("part_number").isNull()
    return o.select(
        "offer_uid", "product_uid", "brand", "part_type", "part_number", "pack_quantity", "authenticity_claim",
        F.when(hidden, F.regexp_replace("title_normalized", " PN[0-9]+$", "")).otherwise(F.col("title_normalized")).alias("title"),
        F.when(k % 3 == 0, "unmapped").when(k % 3 == 1, "v1,v2").otherwise("v2,v3").alias("vehicle_group"),
        "stock_status", "price_toman",
    )


add_view(
    "match_offers",
    "active_offers",
    r"""
  SELECT offer_uid, product_uid, brand, part_type, part_number, pack_quantity, authenticity_claim,
    CASE WHEN part_number IS NULL THEN regexp_replace(title_normalized, ' PN[0-9]+$', '') ELSE title_normalized END AS title,
    CASE CAST(substr(product_uid, 2) AS BIGINT) % 3 WHEN 0 THEN 'unmapped' WHEN 1 THEN 'v1,v2' ELSE 'v2,v3' END AS vehicle_group, stock_status, price_toman
  FROM active_offers""",
)
add_view(
    "profiles",
    "match_offers",
    """
  SELECT substr(sha256(coalesce(brand, '@0') || chr(31) || coalesce(part_type, '@0') || chr(31) || coalesce(part_number, '@0') || chr(31) || pack_quantity || chr(31) || authenticity_claim
      || chr(31) || title || chr(31) || vehicle_group), 1, 32) AS profile, brand, part_type, part_number, pack_quantity, authenticity_claim, title, vehicle_group,
    count(*) AS members, min(CASE WHEN stock_status = 'in_stock' THEN price_toman END) AS min_price, max(CASE WHEN stock_status = 'in_stock' THEN price_toman END) AS max_price,
    CAST(floor(quantile_cont(CAST(CASE WHEN stock_status = 'in_stock' THEN price_toman END AS DOUBLE), 0.5) + 0.5) AS BIGINT) AS median_price
  FROM match_offers GROUP BY brand, part_type, part_number, pack_quantity, authenticity_claim, title, vehicle_group""".replace("'@0'", "chr(0)"),
)
JAC = "len(list_intersect({x}, {y})) / CAST(len({x}) + len({y}) - len(list_intersect({x}, {y})) AS DOUBLE)"
add_view(
    "composite_pairs",
    "profiles",
    f"""
  WITH t AS (SELECT *, list_distinct(string_split(lower(title), ' ')) AS w FROM profiles WHERE brand IS NOT NULL AND part_type IS NOT NULL)
  SELECT least(x.profile, y.profile) AS a, greatest(x.profile, y.profile) AS b FROM t x JOIN t y USING (brand, part_type, pack_quantity)
  WHERE x.part_number IS NULL AND (y.part_number IS NOT NULL OR x.profile < y.profile) AND x.profile <> y.profile
    AND (x.vehicle_group = y.vehicle_group OR x.vehicle_group = 'unmapped' OR y.vehicle_group = 'unmapped')
    AND (x.authenticity_claim = y.authenticity_claim OR x.authenticity_claim = 'unknown' OR y.authenticity_claim = 'unknown')
    AND {JAC.format(x="x.w", y="y.w")} >= {SIM}""",
)
add_view(
    "number_pairs",
    "profiles",
    """
  WITH n AS (SELECT * FROM profiles WHERE part_number IS NOT NULL),
  c AS (SELECT *, min(profile) OVER (PARTITION BY part_number, brand, pack_quantity) AS center FROM n WHERE brand IS NOT NULL),
  o AS (SELECT part_number, pack_quantity, min(profile) AS owner FROM n WHERE brand IS NOT NULL GROUP BY ALL HAVING count(DISTINCT brand) = 1)
  SELECT center AS a, profile AS b, 'part_number' AS channel FROM c WHERE center <> profile
  UNION ALL SELECT least(owner, profile), greatest(owner, profile), 'part_number_no_brand' FROM n JOIN o USING (part_number, pack_quantity) WHERE brand IS NULL""",
)
add_view(
    "crossref_pairs",
    "profiles crossrefs",
    """
  WITH h AS (SELECT part_number, brand, min(profile) AS head FROM profiles WHERE part_number IS NOT NULL AND brand IS NOT NULL GROUP BY ALL)
  SELECT least(x.head, y.head) AS a, greatest(x.head, y.head) AS b, 'crossref' AS channel FROM crossrefs JOIN h x ON x.part_number = code_a JOIN h y ON y.part_number = code_b AND x.brand = y.brand""",
)
add_view(
    "candidates",
    "composite_pairs number_pairs crossref_pairs",
    """
  SELECT a, b, array_to_string(list_sort(list_distinct(list(channel))), ',') AS channels FROM (
    SELECT a, b, 'composite' AS channel FROM composite_pairs UNION ALL SELECT * FROM number_pairs UNION ALL SELECT * FROM crossref_pairs) GROUP BY a, b""",
)
#: Words of a title that say something; these titles hold no phone and no price.
CONTENT = (
    r"list_distinct(list_filter(string_split(regexp_replace(title, '[^0-9A-Za-z\x{0600}-\x{06ff}\-./_+]+', ' ', 'g'), ' '), "
    f"lambda w: length(w) > 1 AND w NOT IN {STOP_WORDS}))"
)
add_view(
    "features",
    "candidates profiles crossrefs",
    f"""
  WITH t AS (SELECT *, list_distinct(string_split(lower(title), ' ')) AS w, {CONTENT} AS cw, CASE WHEN vehicle_group = 'unmapped' THEN [] ELSE string_split(vehicle_group, ',') END AS vg FROM profiles)
  SELECT c.a, c.b, x.brand AS ab, y.brand AS bb, x.part_type AS at_, x.vehicle_group AS avg_, y.vehicle_group AS bvg,
    CASE WHEN x.part_number IS NULL OR y.part_number IS NULL THEN 'none' WHEN x.part_number = y.part_number THEN 'exact'
      WHEN EXISTS (SELECT 1 FROM crossrefs r WHERE least(r.code_a, r.code_b) = least(x.part_number, y.part_number) AND greatest(r.code_a, r.code_b) = greatest(x.part_number, y.part_number)) THEN 'crossref' ELSE 'differ' END AS number_match,
    {JAC.format(x="x.w", y="y.w")} AS title_jaccard,
    CASE WHEN len(x.cw) = 0 OR len(y.cw) = 0 THEN 0e0 ELSE {JAC.format(x="x.cw", y="y.cw")} END AS content_jaccard,
    1 - levenshtein(lower(x.title), lower(y.title)) / CAST(greatest(length(x.title), length(y.title), 1) AS DOUBLE) AS char_similarity,
    x.brand IS NOT DISTINCT FROM y.brand AS brand_match, x.part_type IS NOT DISTINCT FROM y.part_type AS type_match, x.pack_quantity = y.pack_quantity AS pack_match,
    x.authenticity_claim = y.authenticity_claim OR x.authenticity_claim = 'unknown' OR y.authenticity_claim = 'unknown' AS grade_match,
    CASE WHEN len(x.vg) = 0 OR len(y.vg) = 0 THEN 0e0 ELSE {JAC.format(x="x.vg", y="y.vg")} END AS fitment_jaccard,
    abs(ln((x.median_price + 1e0) / (y.median_price + 1e0))) AS price_log_ratio
  FROM candidates c JOIN t x ON x.profile = c.a JOIN t y ON y.profile = c.b""",
)
add_view(
    "judged",
    "features",
    """
  SELECT *, CASE rule WHEN 'number_equal' THEN true WHEN 'same_type' THEN true ELSE false END AS is_same,
    CASE rule WHEN 'brand' THEN 0.95e0 WHEN 'grade' THEN 0.9e0 WHEN 'pack' THEN 0.88e0 WHEN 'number_equal' THEN 0.95e0 WHEN 'number_differs' THEN 0.9e0
      WHEN 'vehicles' THEN 0.7e0 WHEN 'same_type' THEN round_even(least(0.6e0 + content_jaccard / 3, 0.85e0), 2) ELSE round_even(greatest(0.55e0, 0.9e0 - content_jaccard), 2) END AS confidence
  FROM (SELECT *, CASE WHEN ab IS NOT NULL AND bb IS NOT NULL AND NOT brand_match THEN 'brand' WHEN NOT grade_match THEN 'grade' WHEN NOT pack_match THEN 'pack'
      WHEN number_match = 'exact' THEN 'number_equal' WHEN number_match <> 'none' THEN 'number_differs'
      WHEN avg_ <> 'unmapped' AND bvg <> 'unmapped' AND fitment_jaccard = 0 AND content_jaccard < 0.75e0 THEN 'vehicles'
      WHEN at_ IS NOT NULL AND type_match AND content_jaccard >= 0.6e0 THEN 'same_type' ELSE 'no_evidence' END AS rule FROM features)""",
)
add_view(
    "decided",
    "judged",
    """
  SELECT *, CASE WHEN ab IS NOT NULL AND bb IS NOT NULL AND NOT brand_match THEN 'brand_wall' WHEN number_match = 'exact' AND pack_match AND brand_match AND ab IS NOT NULL THEN 'exact'
      WHEN (ab IS NULL) <> (bb IS NULL) AND NOT (number_match = 'exact' AND pack_match) THEN 'no_brand' WHEN number_match = 'differ' THEN 'number_differs'
      WHEN score >= 0.8e0 THEN 'high' WHEN (ab IS NULL) <> (bb IS NULL) AND confidence >= 0.95e0 THEN 'exact_no_brand' WHEN score <= 0.45e0 THEN 'low'
      WHEN confidence >= 0.7e0 AND is_same THEN 'judge_same' WHEN confidence >= 0.7e0 THEN 'judge_different' ELSE 'review' END AS step
  FROM (SELECT *, 0.4e0 * title_jaccard + 0.15e0 * char_similarity + 0.15e0 * type_match::INT + 0.1e0 * grade_match::INT + 0.1e0 * fitment_jaccard
      + 0.1e0 * CASE WHEN price_log_ratio IS NULL THEN 0.5e0 ELSE exp(-price_log_ratio) END AS score FROM judged)""",
)


def profiles(spark, d):
    return matching.profiles(match_offers(spark, d))


def stored_profiles(spark, d, *facts):
    """The fields of every profile and ``facts``, written once; facts that nobody reads are neither summed nor moved."""
    return cut_lineage(profiles(spark, d).select("profile", *matching.PROFILE_FIELDS, *facts))


def candidates(spark, d, p):
    return matching.candidate_union(
        matching.block_composite(p, SIM), matching.block_part_number(p), matching.block_crossref(p, crossrefs(spark, d))
    )


def features(spark, d):
    p = stored_profiles(spark, d, "median_price")
    return matching.pair_features(candidates(spark, d, p), p, crossrefs(spark, d))


@query("block_composite", "composite_pairs", "SELECT a, b FROM composite_pairs")
def block_composite(spark, d):
    return matching.block_composite(stored_profiles(spark, d), SIM).select("a", "b")


@query(
    "block_part_number",
    "number_pairs crossref_pairs",
    "SELECT * FROM number_pairs UNION ALL SELECT * FROM crossref_pairs",
)
def block_part_number(spark, d):
    p = stored_profiles(spark, d)
    return matching.block_part_number(p).unionByName(matching.block_crossref(p, crossrefs(spark, d)))


@query(
    "block_title_similarity",
    "active_offers",
    f"""
  WITH t AS (SELECT DISTINCT brand, title_normalized AS title FROM active_offers WHERE brand IS NOT NULL),
  g AS (SELECT brand, title, list_distinct(flatten(list_transform(string_split(title, ' '), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || lower(w) || ' ', i, 3))))) AS s FROM t)
  SELECT x.brand, x.title AS x, y.title AS y, round({JAC.format(x="x.s", y="y.s")}, 6) AS similarity FROM g x JOIN g y ON x.brand = y.brand AND x.title < y.title
  WHERE {JAC.format(x="x.s", y="y.s")} >= 0.6e0""",
)
def block_title_similarity(spark, d):
    o = v.offers(spark, d).where("is_active").withColumnRenamed("title_normalized", "title")
    return matching.block_title_similarity(o, 0.6).withColumn("similarity", F.bround("similarity", 6))


@query("block_embedding")
def block_embedding(spark, d):
    """Every pair of vectors near each other. A test checks it by brute force."""
    vec = v.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return matching.block_embedding(vec, 64, 0.4)


@query("candidate_union", "candidates", "SELECT * FROM candidates")
def candidate_union(spark, d):
    p = stored_profiles(spark, d)
    return candidates(spark, d, p).withColumn("channels", F.array_join("channels", ","))


@query(
    "pair_features",
    "features",
    """SELECT a, b, number_match, round(title_jaccard, 6) AS title_jaccard, round(content_jaccard, 6) AS content_jaccard, round(char_similarity, 6) AS char_similarity, brand_match, type_match, pack_match, grade_match,
    round(fitment_jaccard, 6) AS fitment_jaccard, round(price_log_ratio, 6) AS price_log_ratio FROM features""",
)
def pair_features(spark, d):
    numbers = ("title_jaccard", "content_jaccard", "char_similarity", "fitment_jaccard", "price_log_ratio")
    return features(spark, d).select(
        "a", "b", "number_match", "brand_match", "type_match", "pack_match", "grade_match",
        *[F.round(c, 6).alias(c) for c in numbers],
    )


@query("pair_rule_judge", "judged", "SELECT a, b, is_same, confidence, rule FROM judged")
def pair_rule_judge(spark, d):
    return features(spark, d).withColumn("j", matching.pair_rule_judge("content_jaccard")).select("a", "b", "j.is_same", "j.confidence", "j.rule")


@query(
    "decision_ladder",
    "decided",
    """SELECT a, b, step, CASE WHEN step IN ('exact', 'high', 'judge_same', 'exact_no_brand') THEN 'merge' WHEN step = 'review' THEN CASE WHEN is_same THEN 'provisional' ELSE 'review' END ELSE 'reject' END AS decision FROM decided""",
)
def decision_ladder(spark, d):
    return matching.decision_ladder(features(spark, d)).select("a", "b", "step", "decision")


@query(
    "brand_wall",
    "decided profiles",
    """
  SELECT count(*) AS merges, count(*) FILTER (WHERE ab IS NOT NULL AND bb IS NOT NULL AND ab <> bb) AS crossing FROM decided
  WHERE step IN ('exact', 'high', 'judge_same', 'exact_no_brand')""",
)
def brand_wall(spark, d):
    """Assertion query: no accepted edge crosses brands."""
    merges = matching.decision_ladder(features(spark, d)).where("decision = 'merge'")
    cross = F.col("a_brand").isNotNull() & F.col("b_brand").isNotNull() & (F.col("a_brand") != F.col("b_brand"))
    return merges.agg(F.count(F.lit(1)).alias("merges"), F.count_if(cross).alias("crossing"))


add_view(
    "number_components",
    "profiles",
    "SELECT profile AS node, min(profile) OVER (PARTITION BY part_number, brand, pack_quantity) AS component FROM profiles WHERE part_number IS NOT NULL AND brand IS NOT NULL",
)


@query(
    "price_circuit_breaker",
    "number_components profiles",
    """
  WITH r AS (SELECT component, min_price, max_price, median_price, members FROM number_components JOIN profiles ON profile = node),
  e AS (SELECT component, median_price, unnest(range(members)) FROM r WHERE median_price IS NOT NULL),
  m AS (SELECT component, CAST(floor(quantile_cont(CAST(median_price AS DOUBLE), 0.5) + 0.5) AS BIGINT) AS median FROM e GROUP BY component)
  SELECT component, min(min_price) AS low, max(max_price) AS high, any_value(median) AS median, count(*) AS profiles,
    count(*) > 1 AND coalesce(max(max_price) - min(min_price) > 2.5 * any_value(median), false) AS tripped
  FROM r LEFT JOIN m USING (component) GROUP BY component""",
)
def price_circuit_breaker(spark, d):
    p = cut_lineage(profiles(spark, d))
    exact = p.where("part_number IS NOT NULL AND brand IS NOT NULL")
    center = exact.groupBy("part_number", "brand", "pack_quantity").agg(F.min("profile").alias("component"))
    comp = exact.join(center, ["part_number", "brand", "pack_quantity"]).select(F.col("profile").alias("node"), "component")
    return matching.price_circuit_breaker(comp, p)


def code_edges(spark, d):
    """Offers around their code's smallest offer, and code heads along cross references."""
    o = v.offers(spark, d).where("part_number IS NOT NULL").select("offer_uid", "part_number")
    star = graph.star_edges(o, ["part_number"], "offer_uid")
    heads = o.groupBy("part_number").agg(F.min("offer_uid").alias("head"))
    x = crossrefs(spark, d)
    link = (
        x.join(heads.select(F.col("part_number").alias("code_a"), F.col("head").alias("a")), "code_a")
        .join(heads.select(F.col("part_number").alias("code_b"), F.col("head").alias("b")), "code_b")
        .select("a", "b")
    )
    return star.unionByName(link)


add_view(
    "code_groups",
    "crossrefs offers",
    """
  SELECT c AS code, min(r) AS root FROM (
    WITH RECURSIVE e AS (SELECT code_a AS a, code_b AS b FROM crossrefs UNION ALL SELECT code_b, code_a FROM crossrefs),
    w(c, r) AS (SELECT DISTINCT part_number, part_number FROM offers WHERE part_number IS NOT NULL
      UNION SELECT e.b, w.r FROM w JOIN e ON e.a = w.c WHERE e.b IN (SELECT part_number FROM offers WHERE part_number IS NOT NULL))
    SELECT c, r FROM w) GROUP BY c""",
)


@query(
    "connected_components",
    "code_groups offers",
    """
  SELECT offer_uid AS node, min(offer_uid) OVER (PARTITION BY root) AS component FROM offers JOIN code_groups ON code = part_number
  QUALIFY count(*) OVER (PARTITION BY root) > 1""",
)
def connected_components(spark, d):
    return graph.connected_components(code_edges(spark, d))


def guarded_edges(spark, d):
    """Scored edges, and as forbidden pairs the first and last neighbour of every node."""
    edges = code_edges(spark, d).withColumn("score", F.pmod(F.xxhash64("a", "b"), F.lit(100)) / 100.0)
    ends = edges.select("a", F.col("b").alias("x"))
    walls = ends.groupBy("a").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).where("lo <> hi")
    return edges, walls.select(F.col("lo").alias("a"), F.col("hi").alias("b"))


@query("transitivity_guard")
def transitivity_guard(spark, d):
    """No oracle: greedy merging under constraints. A test checks it by brute force."""
    return graph.constrained_components(*guarded_edges(spark, d))


def memberships(spark, d):
    """Old clusters by product; the new run merges, splits, shrinks and creates some."""
    o = v.price_state(spark, d).select("offer_uid", "product_uid")
    n = F.expr("CAST(substr(product_uid, 2) AS BIGINT)")
    o = o.withColumn("n", n)
    old = o.where("n % 10 <> 8").select(F.concat(F.lit("c"), "n").alias("cluster_uid"), "offer_uid")
    upper = F.substring("offer_uid", 1, 1) >= "8"
    component = (
        F.when(F.col("n") % 10 == 3, F.concat(F.lit("k"), F.col("n") - 1))
        .when((F.col("n") % 10 == 5) & upper, F.concat(F.lit("k"), "n", F.lit("b")))
        .otherwise(F.concat(F.lit("k"), "n"))
    )
    new = o.where("NOT (n % 10 = 6 AND substr(offer_uid, 1, 1) = 'f')").select(component.alias("component"), "offer_uid")
    return new, old


add_view(
    "old_members",
    "price_state",
    "SELECT 'c' || n AS cluster_uid, offer_uid FROM (SELECT offer_uid, CAST(substr(product_uid, 2) AS BIGINT) AS n FROM price_state) WHERE n % 10 <> 8",
)
add_view(
    "new_members",
    "price_state",
    """
  SELECT CASE WHEN n % 10 = 3 THEN 'k' || (n - 1) WHEN n % 10 = 5 AND substr(offer_uid, 1, 1) >= '8' THEN 'k' || n || 'b' ELSE 'k' || n END AS component, offer_uid
  FROM (SELECT offer_uid, CAST(substr(product_uid, 2) AS BIGINT) AS n FROM price_state) WHERE NOT (n % 10 = 6 AND substr(offer_uid, 1, 1) = 'f')""",
)
UUID4 = """substr(s, 1, 8) || '-' || substr(s, 9, 4) || '-4' || substr(s, 14, 3) || '-' || (['8','9','a','b'])[(CAST('0x' || substr(s, 17, 1) AS INTEGER) % 4) + 1]
    || substr(s, 18, 3) || '-' || substr(s, 21, 12)"""
add_view(
    "stable_uids",
    "old_members new_members",
    f"""
  WITH o AS (SELECT component, cluster_uid, count(*) AS n FROM new_members JOIN old_members USING (offer_uid) GROUP BY ALL),
  h AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY cluster_uid ORDER BY n DESC, component) = 1),
  k AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY component ORDER BY n DESC, cluster_uid) = 1),
  f AS (SELECT component, min(offer_uid) AS first, sha256(min(offer_uid)) AS s FROM new_members GROUP BY component)
  SELECT f.component, coalesce(k.cluster_uid, {UUID4}) AS cluster_uid, k.cluster_uid IS NULL AS is_new FROM f LEFT JOIN k USING (component)""",
)


@query("stable_cluster_uid", "stable_uids", "SELECT * FROM stable_uids")
def stable_cluster_uid(spark, d):
    return matching.stable_cluster_uid(*memberships(spark, d))


@query(
    "cluster_lineage",
    "stable_uids old_members new_members",
    """
  SELECT cluster_uid, new_uid AS successor_uid FROM (SELECT o.cluster_uid, u.cluster_uid AS new_uid, count(*) AS n FROM old_members o JOIN new_members m USING (offer_uid) JOIN stable_uids u USING (component) GROUP BY ALL)
  WHERE cluster_uid NOT IN (SELECT cluster_uid FROM stable_uids) QUALIFY row_number() OVER (PARTITION BY cluster_uid ORDER BY n DESC, new_uid) = 1""",
)
def cluster_lineage(spark, d):
    new, old = memberships(spark, d)
    return matching.cluster_lineage(new, old, matching.stable_cluster_uid(new, old))


@query(
    "cluster_change_events",
    "stable_uids old_members new_members",
    """
  WITH n AS (SELECT u.cluster_uid, offer_uid FROM new_members JOIN stable_uids u USING (component)),
  f AS (SELECT n.cluster_uid AS nu, o.cluster_uid AS ou, count(*) AS c FROM n FULL JOIN old_members o USING (offer_uid) GROUP BY ALL),
  src AS (SELECT nu, count(ou) AS sources, coalesce(sum(c) FILTER (WHERE ou IS NULL), 0) AS fresh,
    array_to_string(list_sort(list(ou) FILTER (WHERE ou IS NOT NULL AND ou <> nu)), ',') AS predecessors FROM f WHERE nu IS NOT NULL GROUP BY nu),
  tgt AS (SELECT ou, count(nu) AS targets, coalesce(sum(c) FILTER (WHERE nu IS NULL), 0) AS lost FROM f WHERE ou IS NOT NULL GROUP BY ou),
  r AS (SELECT src.nu AS cluster_uid, coalesce(predecessors, '') AS predecessors, CASE WHEN sources > 1 THEN 'merged'
      WHEN EXISTS (SELECT 1 FROM f JOIN tgt USING (ou) WHERE f.nu = src.nu AND targets > 1) THEN 'split' WHEN sources = 0 THEN 'created'
      WHEN fresh > 0 THEN 'member_added' WHEN t.lost > 0 THEN 'member_removed' END AS reason FROM src LEFT JOIN tgt t ON t.ou = src.nu)
  SELECT * FROM r WHERE reason IS NOT NULL
  UNION ALL SELECT ou, '', 'retired' FROM tgt WHERE ou NOT IN (SELECT nu FROM src)""",
)
def cluster_change_events(spark, d):
    new, old = memberships(spark, d)
    uids = matching.stable_cluster_uid(new, old)
    named = new.join(uids, "component").select("cluster_uid", "offer_uid")
    out = matching.cluster_change_events(named, old)
    return out.withColumn("predecessors", F.array_join("predecessors", ","))


@query(
    "singleton_ratio",
    "profiles match_offers",
    """
  WITH s AS (SELECT count(*) AS n FROM match_offers GROUP BY brand, part_number, pack_quantity)
  SELECT CAST(sum(n) AS BIGINT) AS offers, count(*) AS clusters, round(count(*) FILTER (WHERE n = 1) / sum(n), 6) AS singleton_ratio, round(avg(n), 6) AS average_size FROM s""",
)
def singleton_ratio(spark, d):
    o = match_offers(spark, d)
    key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in ("brand", "part_number", "pack_quantity")])
    out = matching.singleton_ratio(o.withColumn("cluster_uid", key))
    return out.select("offers", "clusters", F.round("singleton_ratio", 6).alias("singleton_ratio"), F.round("average_size", 6).alias("average_size"))


@query(
    "review_priority",
    "price_state clicks",
    """
  WITH c AS (SELECT product_uid, count(*) AS clicks FROM clicks GROUP BY 1), o AS (SELECT product_uid, count(*) AS n FROM price_state WHERE is_active GROUP BY 1)
  SELECT product_uid, coalesce(clicks, n, 0) AS priority FROM (SELECT DISTINCT product_uid FROM price_state) LEFT JOIN c USING (product_uid) LEFT JOIN o USING (product_uid)""",
)
def review_priority(spark, d):
    s = v.price_state(spark, d)
    clicks = v.clicks(spark, d).groupBy("product_uid").agg(F.count(F.lit(1)).alias("clicks"))
    offers = s.where("is_active").groupBy("product_uid").agg(F.count(F.lit(1)).alias("offer_count"))
    return matching.review_priority(s.select("product_uid").distinct(), clicks, offers)


def decisions(spark, d):
    """Two rounds of verdicts over neighbouring offers of each seller."""
    e = v.price_events(spark, d)
    pair = e.groupBy("product_uid").agg(F.min("offer_uid").alias("offer_uid_a"), F.max("offer_uid").alias("offer_uid_b"))
    pair = pair.where("offer_uid_a <> offer_uid_b")
    n = F.expr("CAST(substr(product_uid, 2) AS BIGINT)")
    first = pair.select("offer_uid_b", "offer_uid_a", F.lit("same").alias("decision"), F.lit(1).alias("decided_at"))
    second = pair.where(n % 3 == 0).select(
        F.col("offer_uid_a").alias("offer_uid_b"), F.col("offer_uid_b").alias("offer_uid_a"),
        F.lit("different").alias("decision"), F.lit(2).alias("decided_at"),
    )
    skipped = pair.select("offer_uid_b", "offer_uid_a", F.lit("skip").alias("decision"), F.lit(3).alias("decided_at"))
    return first.unionByName(second).unionByName(skipped)


add_view(
    "golden",
    "price_events",
    """
  SELECT min(offer_uid) AS a, max(offer_uid) AS b, CAST(substr(product_uid, 2) AS BIGINT) % 3 <> 0 AS is_same FROM price_events GROUP BY product_uid HAVING min(offer_uid) <> max(offer_uid)""",
)


@query("human_decision_overlay", "golden", "SELECT a, b, is_same AS must_link FROM golden")
def human_decision_overlay(spark, d):
    return matching.human_decision_overlay(decisions(spark, d)).select("a", "b", "must_link")


@query("golden_labels", "golden", "SELECT a, b, is_same FROM golden")
def golden_labels(spark, d):
    return matching.golden_labels(decisions(spark, d)).select("a", "b", "is_same")


MERGED = "step IN ('exact', 'high', 'judge_same', 'exact_no_brand')"
add_view(
    "predicted",
    "golden decided match_offers profiles",
    f"""
  WITH RECURSIVE e AS (SELECT a, b FROM decided WHERE {MERGED} UNION ALL SELECT b, a FROM decided WHERE {MERGED}),
  o AS (SELECT offer_uid, profile FROM match_offers m JOIN profiles p ON m.brand IS NOT DISTINCT FROM p.brand AND m.part_type IS NOT DISTINCT FROM p.part_type AND m.part_number IS NOT DISTINCT FROM p.part_number
      AND m.pack_quantity = p.pack_quantity AND m.authenticity_claim = p.authenticity_claim AND m.title = p.title AND m.vehicle_group = p.vehicle_group),
  g AS (SELECT golden.*, x.profile AS pa, y.profile AS pb FROM golden LEFT JOIN o x ON x.offer_uid = a LEFT JOIN o y ON y.offer_uid = b),
  w(s, x) AS (SELECT DISTINCT pa, pa FROM g WHERE pa IS NOT NULL UNION SELECT w.s, e.b FROM w JOIN e ON e.a = w.x)
  SELECT g.a, g.b, is_same, EXISTS (SELECT 1 FROM w WHERE w.s = pa AND w.x = pb) AS p FROM g""",
)


@query(
    "match_evaluate",
    "predicted",
    """
  WITH c AS (SELECT count(*) FILTER (WHERE is_same AND p) AS tp, count(*) FILTER (WHERE NOT is_same AND p) AS fp, count(*) FILTER (WHERE is_same AND NOT p) AS fn FROM predicted)
  SELECT tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall,
    round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / nullif(tp / (tp + fp) + tp / (tp + fn), 0), 6) AS f1, tp / nullif(tp + fp, 0) >= 0.95 AS passes_gate FROM c""",
)
def match_evaluate(spark, d):
    """The matcher's own clusters against the labels of people."""
    golden = matching.golden_labels(decisions(spark, d))
    merges = matching.decision_ladder(features(spark, d)).where("decision = 'merge'").select("a", "b")
    components = graph.connected_components(merges)
    predicted = matching.predicted_same(golden, matching.offer_profile(match_offers(spark, d)), components)
    out = matching.match_evaluate(golden, predicted)
    return out.select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "passes_gate")


