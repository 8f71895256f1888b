"""Consensus, expansion, corrections and conflicts on a few rows."""

from pyspark.sql import functions as F

from karvan.operators import catalog, fitment, matching

OFFER = (
    "offer_uid string, seller_key string, part_number string, brand string, part_type string, title_normalized string, "
    "vehicle_hints array<string>, vehicle_hints_excluded array<string>, overbroad_claim boolean, is_active boolean"
)
VEHICLE = "vehicle_slug string, brand string, model string, trim string, display_name string, aliases array<string>"
VEHICLES = [
    ("peugeot-206", "Peugeot", "206", None, "پژو ۲۰۶", ["206", "پژو206"]),
    ("peugeot-206-type-2", "Peugeot", "206", "type 2", "پژو ۲۰۶ تیپ ۲", ["206 تیپ 2"]),
    ("peugeot-206-type-5", "Peugeot", "206", "type 5", "پژو ۲۰۶ تیپ ۵", ["206 تیپ 5"]),
    ("peugeot-405", "Peugeot", "405", None, "پژو ۴۰۵", ["405"]),
]


def vehicles(spark):
    return spark.createDataFrame(VEHICLES, VEHICLE)


def offer(i, seller, hints, excluded=(), over=False, active=True, part_type="brake_pad", title="x"):
    return (f"o{i}", seller, "PN1", "b", part_type, title, list(hints), list(excluded), over, active)


def verdict_map(spark, offers):
    df = spark.createDataFrame(offers, OFFER)
    base = fitment.consensus_verdict(fitment.claim_table(df, vehicles(spark)))
    rows = fitment.model_level_expansion(base, vehicles(spark)).collect()
    return {r["vehicle_slug"]: (r["status"], r["confidence"], r["rule"]) for r in rows}


def test_resolution_prefers_the_longer_alias_and_never_guesses_a_trim(spark):
    hints = spark.createDataFrame([("لنت پژو ۲۰۶ تیپ ۵ اصلی",), ("پژو 206",), ("۲۰۶",), ("پژو 2066",), ("برای 405",)], "hint string")
    got = {r["hint"]: r["vehicle_slug"] for r in fitment.resolve_vehicle(hints, vehicles(spark)).collect()}
    assert got == {"لنت پژو ۲۰۶ تیپ ۵ اصلی": "peugeot-206-type-5", "پژو 206": "peugeot-206", "۲۰۶": "peugeot-206", "برای 405": "peugeot-405"}


def test_consensus_levels(spark):
    one = verdict_map(spark, [offer(1, "a", ["405"])])
    assert one["peugeot-405"] == ("unknown", 0.21, "single_seller_claim")
    two = verdict_map(spark, [offer(1, "a", ["405"]), offer(2, "b", ["405"])])
    assert two["peugeot-405"] == ("compatible", 0.68, "consensus_part_number")
    five = verdict_map(spark, [offer(i, f"s{i}", ["405"]) for i in range(5)])
    assert five["peugeot-405"] == ("compatible", 0.94, "consensus_part_number")
    same = verdict_map(spark, [offer(i, "a", ["405"]) for i in range(5)])
    assert same["peugeot-405"][0] == "unknown"


def test_negatives_never_make_incompatible(spark):
    got = verdict_map(spark, [offer(i, f"s{i}", [], ["405"]) for i in range(6)])
    assert got["peugeot-405"] == ("unknown", 0.1, "negative_claim_only")
    got = verdict_map(spark, [offer(i, f"s{i}", ["405"]) for i in range(6)] + [offer(9, "z", [], ["405"])])
    assert got["peugeot-405"] == ("unknown", 0.0, "conflicting_seller_claims")


def test_overbroad_only_and_inactive(spark):
    got = verdict_map(spark, [offer(i, f"s{i}", ["405"], over=True) for i in range(3)])
    assert got["peugeot-405"] == ("unknown", 0.1, "overbroad_claim_only")
    assert verdict_map(spark, [offer(1, "a", ["405"], active=False)]) == {}


def test_model_claim_expands_to_trims(spark):
    got = verdict_map(spark, [offer(1, "a", ["206"]), offer(2, "b", ["206"]), offer(3, "a", ["206 تیپ 2"])])
    assert got["peugeot-206"][0] == "compatible"
    assert got["peugeot-206-type-2"][2] == "single_seller_claim"
    assert got["peugeot-206-type-5"] == ("unknown", 0.0, "model_level_only")


def test_human_and_risky_order_of_authority(spark):
    offers = spark.createDataFrame([offer(i, f"s{i}", ["405"], part_type="timing_belt") for i in range(5)] + [offer(9, "x", ["405"], part_type="timing_belt", title="موتور TU5")], OFFER)
    base = fitment.consensus_verdict(fitment.claim_table(offers, vehicles(spark)))
    decisions = spark.createDataFrame(
        [("PN1", "peugeot-206", "approve", "incompatible", "r1", 1), ("PN1", "peugeot-206", "skip", None, "r2", 2), ("PN1", "peugeot-206-type-2", "approve", "compatible", "r3", 1), ("PN1", "peugeot-206-type-2", None, None, "r3", 5)],
        "part_number string, vehicle_slug string, decision string, status string, request_uid string, decided_at int",
    )
    rows = fitment.offer_fitment_rows(offers, base, fitment.latest_corrections(decisions), fitment.risky_families(spark)).collect()
    got = {(r["offer_uid"], r["vehicle_slug"]): (r["status"], r["confidence"]) for r in rows}
    assert got[("o0", "peugeot-405")] == ("unknown", 0.18)
    assert got[("o9", "peugeot-405")] == ("compatible", 0.94)
    assert got[("o0", "peugeot-206")] == ("incompatible", 1.0)
    assert ("o0", "peugeot-206-type-2") not in got


def test_corrections_meet_verdicts_per_group(spark):
    """One row per (offer, vehicle), of claimed, corrected and of both; no exchange holds a row per offer and vehicle."""
    offers = spark.createDataFrame(
        [("a", "N1", "b", "t", True), ("b", "N1", "b", "t", False), ("c", "", "b", "t", True), ("d", None, "b", "t", True), ("e", None, None, None, True), ("f", "N2", "b", "ecu", True), (None, "N1", "b", "t", True)],
        "offer_uid string, part_number string, brand string, part_type string, is_active boolean",
    ).withColumns({"title_normalized": F.lit("x"), "vehicle_hints": F.array(F.lit("y")), "vehicle_hints_excluded": F.array().cast("array<string>")})
    groups = [("pn:N1", "v1"), ("pn:N1", "v2"), ("brand-type:b:t", "v1"), ("offer:e", "v3"), ("pn:N2", "v1"), ("pn:N2", None), ("pn:gone", "v1")]
    verdicts = spark.createDataFrame([(g, c, "compatible", 0.9, "consensus", "r") for g, c in groups], "group_key string, vehicle_slug string, status string, confidence double, provenance string, rule string")
    corrections = spark.createDataFrame([("N1", "v2", "incompatible"), ("N1", "v9", "unknown"), ("", "v1", "incompatible"), ("", "v8", "compatible"), ("gone", "v1", "compatible")], "part_number string, vehicle_slug string, human_status string")
    rows = fitment.offer_fitment_rows(offers, verdicts, corrections, fitment.risky_families(spark), apply_nfkc=False)
    got = sorted((str(r["offer_uid"]), str(r["vehicle_slug"]), r["part_type"], r["is_active"], r["status"], r["rule"]) for r in rows.collect())
    want = []
    for uid, active in (("a", True), ("b", False), ("None", True)):
        want += [(uid, "v1", "t", active, "compatible", "r"), (uid, "v2", "t", active, "incompatible", "human_correction"), (uid, "v9", "t", active, "unknown", "human_correction")]
    want += [("c", "v1", "t", True, "incompatible", "human_correction"), ("c", "v8", "t", True, "compatible", "human_correction"), ("d", "v1", "t", True, "compatible", "r"), ("e", "v3", None, True, "compatible", "r")]
    want += [("f", v, "ecu", True, "unknown", "risky_family_missing_granularity") for v in ("None", "v1")]
    assert got == sorted(want)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "FullOuter, ((group_key" in plan


def test_rollup_tie_is_unknown(spark):
    rows = [("p", "v1", "compatible", 0.1), ("p", "v1", "compatible", 0.2), ("p", "v1", "incompatible", 0.3), ("p", "v2", "compatible", 0.5), ("p", "gone", "compatible", 1.0)]
    df = spark.createDataFrame(rows, "product_uid string, vehicle_slug string, status string, confidence double")
    known = spark.createDataFrame([("v1",), ("v2",)], "vehicle_slug string")
    got = {r["vehicle_slug"]: r["status"] for r in catalog.fitment_rollup(df, known).collect()}
    assert got == {"v1": "unknown", "v2": "compatible"}


def test_judge_order(spark):
    cols = "a_brand string, b_brand string, a_part_type string, b_part_type string, a_vehicle_group string, b_vehicle_group string, number_match string, title_jaccard double, brand_match boolean, grade_match boolean, pack_match boolean, type_match boolean, fitment_jaccard double"
    base = ["b", "b", "t", "t", "unmapped", "unmapped", "none", 0.9, True, True, True, True, 0.0]

    def row(**kw):
        names = [c.split()[0] for c in cols.split(", ")]
        return tuple(kw.get(n, v) for n, v in zip(names, base, strict=True))

    rows = [row(), row(brand_match=False, b_brand="c"), row(grade_match=False), row(pack_match=False), row(number_match="exact"), row(number_match="crossref"), row(title_jaccard=0.3)]
    out = spark.createDataFrame(rows, cols).select(matching.pair_rule_judge().alias("j")).collect()
    assert [r["j"]["rule"] for r in out] == ["same_type", "brand", "grade", "pack", "number_equal", "number_differs", "no_evidence"]
    assert out[0]["j"]["confidence"] == 0.85 and out[6]["j"]["confidence"] == 0.6


def test_publication_reasons(spark):
    cols = "is_retired boolean, offer_count int, title string, has_price boolean, substance_facts int, has_risky_family boolean, risky_note string, has_explicit_verdict boolean"
    rows = [(False, 1, "لنت", True, 1, False, None, False), (True, 0, " ", False, 0, True, None, False), (False, 1, "لنت ارسال رایگان", True, 2, True, "n", False)]
    df = spark.createDataFrame(rows, cols).select(catalog.publication_gate().alias("r"))
    assert [r["r"] for r in df.collect()] == [
        [], ["retired", "no_active_offers", "empty_title", "no_usable_price", "thin_content", "risky_family_without_verdict"], ["promotional_title"],
    ]


def test_seller_count_is_not_claim_count(spark):
    claims = spark.createDataFrame([("g", "v", "a", True, False, "P", False)] * 9, "group_key string, vehicle_slug string, seller_key string, positive boolean, overbroad_claim boolean, part_number string, is_model_level boolean")
    assert fitment.consensus_verdict(claims).select(F.col("agreeing")).first()[0] == 1
