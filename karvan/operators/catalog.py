"""Product assembly: membership, lineage, representative, gate, document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from karvan.functions import titles
from karvan.functions.ids import canonical_hash
from karvan.operators.cdc import latest_state
from karvan.params import RepresentativeParams
from karvan.session import cut_lineage

#: Shown when no member has any usable text (fixed value).
FALLBACK_TITLE = "قطعه یدکی"
#: Authenticity claims, most specific first (fixed values).
CLAIM_PRIORITY = ("genuine", "oem", "aftermarket", "refurbished", "used", "unknown")
WATERMARK_TOKENS = ("watermark", "logo", "placeholder", "no-image", "noimage")
#: Offers per document page: a product's list is paged so that no row is unbounded.
PAGE_OFFERS = 500


# ------------------------------------------------------------ clusters and lineage


def cluster_membership(cluster_events: DataFrame) -> DataFrame:
    """Members arrive as full state, so the newest event per cluster replaces."""
    latest = latest_state(cluster_events, ["cluster_uid"])
    return latest.select(F.col("cluster_uid").alias("product_uid"), F.explode("members").alias("offer_uid"))


def retire_predecessors(clusters: DataFrame) -> DataFrame:
    """Successor of each cluster: its own, else the newest cluster that lists it as a
    predecessor once it is empty."""
    named = clusters.select(
        F.col("cluster_uid").alias("new_uid"), F.col("occurred_at").alias("at"),
        F.explode("predecessor_uids").alias("cluster_uid"),
    ).where(F.col("new_uid") != F.col("cluster_uid"))
    # First claim wins: a predecessor that already has a successor is left alone.
    claimed = named.groupBy("cluster_uid").agg(
        F.min_by("new_uid", F.struct("at", "new_uid")).alias("claimed_by")
    )
    empty = F.size("members") == 0
    return clusters.join(claimed, "cluster_uid", "left").withColumn(
        "successor_uid", F.coalesce("successor_uid", F.when(empty, F.col("claimed_by")))
    ).drop("claimed_by")


def successor_chain(successors: DataFrame) -> DataFrame:
    """Follow pointers to the last product of each chain by path doubling.

    Every round joins the table with itself on the pointer and doubles the reach, so
    a chain of length n takes log2(n) rounds. Pointers that still move after log2 of their
    number run into a cycle; their ``final`` is null. Columns: ``uid``, ``successor``.
    """
    jump = successors.where(F.col("successor").isNotNull()).select("uid", F.col("successor").alias("final"))
    for _ in range(jump.count().bit_length() + 1):
        ahead = jump.select(F.col("uid").alias("final"), F.col("final").alias("further"))
        stepped = jump.join(ahead, "final", "left").select(
            "uid",
            F.coalesce("further", "final").alias("next"),
            F.col("further").isNotNull().alias("moved"),
        )
        stepped = cut_lineage(stepped)
        jump = stepped.select("uid", F.col("next").alias("final"))
        if stepped.where("moved").limit(1).isEmpty():
            return jump
    return stepped.select("uid", F.when(~F.col("moved"), F.col("next")).alias("final"))


def redirect_resolution(slugs: DataFrame, products: DataFrame, finals: DataFrame) -> DataFrame:
    """Where each slug ever used leads now.

    ``slugs``: slug, product_uid. ``products``: product_uid, slug (current).
    ``finals``: uid, final (from ``successor_chain``).
    """
    owner = slugs.join(finals.withColumnRenamed("uid", "product_uid"), "product_uid", "left")
    target = owner.withColumn("target_uid", F.coalesce("final", "product_uid"))
    current = products.select(F.col("product_uid").alias("target_uid"), F.col("slug").alias("target_slug"))
    reason = (
        F.when(F.col("final").isNotNull(), "retired")
        .when(F.col("slug") != F.col("target_slug"), "renamed")
        .otherwise("current")
    )
    return target.join(current, "target_uid", "left").select(
        "slug", "product_uid", "target_uid", "target_slug", reason.alias("reason")
    )


# --------------------------------------------------------------- product aggregates


def fitment_rollup(verdicts: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Product verdict per vehicle from member verdicts.

    Confidence is summed per status as a decimal, so equal evidence ties exactly; the
    strict maximum wins, ties and zero evidence are unknown.
    """
    known = verdicts.join(vehicles.select("vehicle_slug"), "vehicle_slug", "left_semi")
    conf = F.col("confidence").cast("decimal(9,6)")

    def total(status: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("status") == status, conf)), F.lit(0).cast("decimal(9,6)"))

    sums = known.groupBy("product_uid", "vehicle_slug").agg(
        total("compatible").alias("c"), total("incompatible").alias("i"), total("unknown").alias("u")
    )
    c, i, u = F.col("c"), F.col("i"), F.col("u")
    status = (
        F.when((c > i) & (c > u), "compatible").when((i > c) & (i > u), "incompatible").otherwise("unknown")
    )
    return sums.withColumn("status", status).select("product_uid", "vehicle_slug", "status")


def vehicle_lists(rollup: DataFrame) -> DataFrame:
    """The three sorted arrays of the document; bounded by the vehicle table."""

    def pick(status: str) -> Column:
        slugs = F.collect_list(F.when(F.col("status") == status, F.col("vehicle_slug")))
        return F.array_sort(slugs).alias(f"vehicles_{status}")

    return rollup.groupBy("product_uid").agg(pick("compatible"), pick("incompatible"), pick("unknown"))


def crossref_expand_one_hop(numbers: DataFrame, crossrefs: DataFrame, seeds: DataFrame) -> DataFrame:
    """Equivalents of a product's own numbers plus seed codes, minus its own.

    ``numbers`` and ``seeds``: product_uid, code. One row per (product, code).
    """
    both = crossrefs.select(F.col("code_a").alias("code"), F.col("code_b").alias("other")).unionByName(
        crossrefs.select(F.col("code_b").alias("code"), F.col("code_a").alias("other"))
    )
    hop = numbers.join(both, "code").select("product_uid", F.col("other").alias("code"))
    return (
        hop.unionByName(seeds.select("product_uid", "code"))
        .distinct()
        .join(numbers.select("product_uid", "code"), ["product_uid", "code"], "left_anti")
    )


def modal(values: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Most common non-null value per column, ties to the smallest."""
    return values.groupBy(key).agg(*[F.mode(c, True).alias(c) for c in columns])


def claim_rank(claim: Column) -> Column:
    out = F.lit(len(CLAIM_PRIORITY))
    for i, name in reversed(list(enumerate(CLAIM_PRIORITY))):
        out = F.when(claim == name, i).otherwise(out)
    return out


def authenticity_dominant(offers: DataFrame) -> DataFrame:
    """Modal claim; unknown only when nothing else was claimed; ties to the specific."""
    counts = offers.groupBy("product_uid", "authenticity_claim").agg(F.count(F.lit(1)).alias("n"))
    claim = F.col("authenticity_claim")
    key = F.struct((claim == "unknown").alias("u"), (-F.col("n")).alias("n"), claim_rank(claim).alias("r"))
    return counts.groupBy("product_uid").agg(F.min_by(claim, key).alias("authenticity_dominant"))


def completeness() -> Column:
    """Share of the six listing fields that are filled; 0 and '' count as empty."""
    texts = ["title_normalized", "brand", "part_number", "part_type", "image_url"]
    filled = [(F.coalesce(F.col(c), F.lit("")) != "").cast("int") for c in texts]
    filled.append((F.coalesce("price_toman", F.lit(0)) != 0).cast("int"))
    return sum(filled[1:], filled[0]) / F.lit(6.0)


def image_score(url: Column) -> Column:
    lowered = F.lower(F.coalesce(url, F.lit("")))
    return (
        F.when(lowered == "", 0.0)
        .when(lowered.rlike("|".join(WATERMARK_TOKENS)), 0.3)
        .otherwise(1.0)
    )


def elect_representative(
    offers: DataFrame, overrides: DataFrame | None = None, p: RepresentativeParams | None = None
) -> DataFrame:
    """The member that speaks for the product, with the runner-up.

    ``offers`` are active members with ``trust_score``. Only the two best per product
    leave each partition (limit pushed below the shuffle by the rank filter).
    ``overrides`` (product_uid, offer_uid) is a human pick and wins while a member.
    """
    p = p or RepresentativeParams()
    dominant = authenticity_dominant(offers)
    clean = titles.strip_promotional(F.col("title_normalized"))
    trust = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("trust_score", F.lit(0.0))))
    score = F.bround(
        F.lit(p.completeness) * completeness()
        + F.lit(p.seller_trust) * trust
        + F.lit(p.image) * image_score(F.col("image_url"))
        + F.lit(p.title_band)
        * titles.is_sane_title(clean, p.title_min, p.title_max).cast("double"),
        6,
    )
    pool = (
        offers.join(dominant, "product_uid")
        .where(F.col("authenticity_claim") == F.col("authenticity_dominant"))
        .withColumn("score", score)
    )
    best = Window.partitionBy("product_uid").orderBy(F.desc("score"), "offer_uid")
    top = pool.withColumn("place", F.row_number().over(best)).where("place <= 2")
    sizes = pool.groupBy("product_uid").agg(F.count(F.lit(1)).alias("candidates_considered"))

    def at(place: int, column: str) -> Column:
        return F.max(F.when(F.col("place") == place, F.col(column)))

    elected = (
        top.groupBy("product_uid", "authenticity_dominant")
        .agg(
            at(1, "offer_uid").alias("offer_uid"),
            at(1, "score").alias("winning_score"),
            at(2, "offer_uid").alias("runner_up"),
        )
        .join(sizes, "product_uid")
        .withColumn("rule", F.lit("scored"))
    )
    if overrides is None:
        return elected
    forced = overrides.join(
        offers.select("product_uid", "offer_uid"), ["product_uid", "offer_uid"], "left_semi"
    ).select("product_uid", F.col("offer_uid").alias("forced"))
    human = F.col("forced").isNotNull()
    return (
        elected.join(forced, "product_uid", "left")
        .withColumn("rule", F.when(human, "human_override").otherwise(F.col("rule")))
        .withColumn("offer_uid", F.coalesce("forced", "offer_uid"))
        .drop("forced")
    )


def product_title(offers: DataFrame, elected: DataFrame) -> DataFrame:
    """Representative's title, else other members', else raw titles; never empty."""
    chosen = elected.select("product_uid", F.col("offer_uid").alias("rep"))
    rows = offers.join(chosen, "product_uid")
    is_rep = F.col("offer_uid") == F.col("rep")
    normal = titles.strip_promotional(F.col("title_normalized"))
    raw = titles.strip_promotional(F.col("raw_title"))
    candidates = rows.select(
        "product_uid",
        F.explode(
            F.array(
                F.struct(F.when(is_rep, 0).otherwise(1).alias("tier"), "offer_uid", normal.alias("t")),
                F.struct(F.when(is_rep, 2).otherwise(3).alias("tier"), "offer_uid", raw.alias("t")),
            )
        ).alias("c"),
    ).where(F.col("c.t") != "")
    best = candidates.groupBy("product_uid").agg(F.min("c").alias("c"))
    return chosen.join(best, "product_uid", "left").select(
        "product_uid",
        F.coalesce("c.t", F.lit(FALLBACK_TITLE)).alias("title"),
        F.coalesce("c.tier", F.lit(4)).alias("title_tier"),
    )


def publication_gate(min_facts: int = 1, require_price: bool = True) -> Column:
    """Why a product may not be published; an empty array means publish."""
    checks = [
        (F.col("is_retired"), "retired"),
        (F.col("offer_count") < 1, "no_active_offers"),
        (F.trim(F.col("title")) == "", "empty_title"),
        (titles.contains_promotional(F.col("title")), "promotional_title"),
        (F.lit(require_price) & ~F.col("has_price"), "no_usable_price"),
        (F.col("substance_facts") < min_facts, "thin_content"),
        (
            F.col("has_risky_family") & F.col("risky_note").isNull() & ~F.col("has_explicit_verdict"),
            "risky_family_without_verdict",
        ),
    ]
    reasons = F.array(*[F.when(bad, F.lit(name)) for bad, name in checks])
    return F.filter(reasons, lambda r: r.isNotNull())


def panel_offer_suppression(offers: DataFrame, billing_state: DataFrame) -> DataFrame:
    """Hide panel offers of sellers whose wallet is inactive; crawled offers stay."""
    state = billing_state.select("seller_key", "panel_offers_active")
    active = F.coalesce("panel_offers_active", F.lit(True))
    return (
        offers.join(state, "seller_key", "left")
        .where(~(F.col("is_panel_offer") & ~active))
        .drop("panel_offers_active")
    )


def product_batch_lookup(requested: DataFrame, documents: DataFrame) -> DataFrame:
    """Requested uids with their document columns; ``is_missing`` marks the rest."""
    marked = documents.withColumn("__found", F.lit(True))
    return (
        requested.dropDuplicates(["product_uid"])
        .join(marked, "product_uid", "left")
        .withColumn("is_missing", F.col("__found").isNull())
        .drop("__found")
    )


def product_header(
    offers: DataFrame, elected: DataFrame, title: DataFrame, stats: DataFrame, badge: DataFrame
) -> DataFrame:
    """One row per product: everything but the offer list and the arrays."""
    sums = offers.groupBy("product_uid").agg(
        F.count(F.lit(1)).alias("offer_count"),
        (F.count("price_toman") > 0).alias("has_price"),
        F.mode("brand", True).alias("brand"),
        F.mode("part_type", True).alias("part_type"),
        F.array_sort(F.collect_set("part_number")).alias("part_numbers"),
        F.max("last_seen_at").alias("updated_at"),
    )
    image = offers.join(
        elected.select("product_uid", "offer_uid"), ["product_uid", "offer_uid"], "left_semi"
    ).select("product_uid", "image_url")
    rep = elected.select("product_uid", "authenticity_dominant", F.col("offer_uid").alias("representative_uid"))
    joined = sums
    for other in (rep, title.select("product_uid", "title"), image, stats, badge):
        joined = joined.join(other, "product_uid", "left")
    return joined.withColumn("slug", titles.build_slug(F.col("title"), F.col("product_uid")))


def offer_pages(ranked: DataFrame, badge: DataFrame, page_offers: int = PAGE_OFFERS) -> DataFrame:
    """The offer list in rank order, paged: at most ``page_offers`` structs per row."""
    row = F.struct(
        "rank_position", "offer_uid", "seller_key", "title_normalized", "price_toman",
        F.col("last_seen_at").alias("price_observed_at"), "stock_status", "authenticity_claim",
        "trust_score", "is_panel_offer", "url",
        (F.col("offer_uid") == F.col("cheapest_offer_uid")).alias("is_cheapest"),
    )
    paged = ranked.join(badge.select("product_uid", "cheapest_offer_uid"), "product_uid").withColumn(
        "page", F.floor((F.col("rank_position") - 1) / page_offers)
    )
    return paged.groupBy("product_uid", "page").agg(F.array_sort(F.collect_list(row)).alias("offers"))


def build_product_document(
    header: DataFrame, pages: DataFrame, lists: DataFrame, codes: DataFrame, series: DataFrame
) -> DataFrame:
    """Nested document, one row per page of offers (page 0 carries the product).

    Arrays other than offers are bounded by the vehicle table, a product's codes and
    the days of the window.
    """
    code_list = codes.groupBy("product_uid").agg(F.array_sort(F.collect_set("code")).alias("crossref_codes"))
    day_list = series.groupBy("product_uid").agg(
        F.array_sort(F.collect_list(F.struct("date", "min_toman", "median_toman"))).alias("price_series")
    )
    doc = header
    for other in (lists, code_list, day_list):
        doc = doc.join(other, "product_uid", "left")
    empty = F.array().cast("array<string>")
    for name in ("vehicles_compatible", "vehicles_incompatible", "vehicles_unknown", "crossref_codes"):
        doc = doc.withColumn(name, F.coalesce(name, empty))
    facts = (
        F.size("part_numbers") + F.size("crossref_codes") + F.size("vehicles_compatible")
        + F.size("vehicles_incompatible")
    )
    doc = (
        doc.withColumn("substance_facts", facts)
        .withColumn(
            "has_explicit_verdict",
            (F.size("vehicles_compatible") + F.size("vehicles_incompatible")) > 0,
        )
        .withColumn("unpublished_reasons", publication_gate())
        .withColumn("is_published", F.size("unpublished_reasons") == 0)
    )
    material = [c for c in doc.columns if c != "updated_at"]
    doc = doc.withColumn("document_hash", canonical_hash(material))
    return doc.join(pages, "product_uid")
