"""What is moved, and how often: rows of exchanges stay narrow and files do not grow with a table."""

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from karvan.functions import text
from karvan.operators import cdc, fitment, matching, pricing, search, trust
from karvan.plans import q_matching, q_ranking, q_streaming
from karvan.plans import views as v
from karvan.streaming import jobs


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def market(spark, tmp_path_factory):
    """Lines with repeated offers, equal days, unknown parts and null keys; a part that comes twice."""
    d = str(tmp_path_factory.mktemp("market"))
    rows = []
    for i in range(300):
        rows.append((
            i // 3, i % 7 + 1, None if i % 41 == 0 else i % 37, None if i % 29 == 0 else i % 5, 1000.0 * i,
            float(i % 11), "O" if i % 2 else "F", "NAR"[i % 3], dt.date(1999, 1, 1 + i % 9),
        ))
    names = (
        "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double, "
        "l_linestatus string, l_returnflag string, l_shipdate date"
    )
    spark.createDataFrame(rows, names).write.parquet(f"{d}/lineitem.parquet")
    parts = [(k, f"name{k}", f"Brand#{k}", f"TYPE{k}") for k in (*range(30), 3)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(f"{d}/part.parquet")
    return d


def test_offers_are_the_newest_events(spark, market):
    got = sorted(map(str, v.offers(spark, market).collect()))
    assert got == sorted(map(str, cdc.latest_state(v.offer_events(spark, market), ["offer_uid"]).select(*v.offers(spark, market).columns).collect()))
    state = v.price_state(spark, market)
    events = v.price_events(spark, market).select(*state.columns)
    assert sorted(map(str, state.collect())) == sorted(map(str, cdc.latest_state(events, ["offer_uid"]).collect()))


def test_offers_move_stored_columns_only(spark, market):
    for frame in (v.offers(spark, market), v.price_state(spark, market)):
        below = plan(frame).split("Exchange hashpartitioning(l_suppkey", 1)[1]
        assert "sha2" not in below and "img.example" not in below


def test_lines_are_packed_and_read_again(spark, market):
    """What an event says travels as one small number, nulls and unknown words included."""
    lines = v._lines(spark, market)
    odd = [(1, None, 5, 1, None, None, None, None, None), (2, 6, 5, 1, 3e5, 5.0, "O", "A", dt.date(2000, 1, 1)), (3, 1, 5, None, -1.0, 6.0, "x", "R", dt.date(2000, 1, 2))]
    lines = lines.unionByName(spark.createDataFrame(odd, lines.schema))
    packed = v._packed(lines)
    assert packed.columns == [*v.LINE, "__price", "__said"] and packed.schema["__said"].dataType.simpleString() == "tinyint"
    assert sorted(map(str, v._described(packed).collect())) == sorted(map(str, v._described(lines).collect()))
    near = v.with_facts(v.offer_lines(spark, market)).select(*v.price_events(spark, market).columns)
    assert sorted(map(str, near.collect())) == sorted(map(str, v.price_events(spark, market).collect()))


def test_ranked_offers_meet_sellers_on_numbers(spark, market, monkeypatch):
    trust_rows = spark.createDataFrame([(f"s{k}", k, k / 10.0) for k in (0, 1, 1, 3)], "seller_key string, supp_key long, trust_score double")
    monkeypatch.setattr(q_ranking, "seller_trust", lambda spark, d: trust_rows)
    got = q_ranking.rankable(spark, market)
    assert "event_id" not in got.columns
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        moved = [line for line in plan(got).split("\n") if "Exchange hashpartitioning(" in line]
        assert len(moved) == 3 and not any("seller_key" in line or "concat" in line for line in moved)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = v.price_state(spark, market).where("is_active").withColumnRenamed("occurred_at", "last_seen_at").join(trust_rows.drop("supp_key"), "seller_key")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))


def test_price_points_meet_in_stored_columns(spark, market):
    """Days of an offer are found by its numbers, and give the same series as its texts."""
    points = cdc.price_change_points(v.offer_lines(spark, market), offer=v.OFFER, describe=v.with_facts)
    got = pricing.daily_price_series(points, "1999-01-02", "1999-01-20", v.OFFER)
    moved = [line for line in plan(got).split("\n") if "Exchange hashpartitioning(" in line]
    assert len(moved) == 2 and "l_suppkey" in moved[1] and not any("offer_uid" in line for line in moved)
    want = pricing.daily_price_series(cdc.price_change_points(v.price_events(spark, market)), "1999-01-02", "1999-01-20")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))
    for hot_rows in (3, 1_000_000):
        some = cdc.price_change_points(v.offer_lines(spark, market), hot_rows, v.OFFER, v.with_facts).drop(*v.OFFER)
        same = cdc.price_change_points(v.price_events(spark, market), hot_rows).drop("offer_uid")
        assert sorted(map(str, some.collect())) == sorted(map(str, same.select(*some.columns).collect()))


def test_documents_read_the_same_offers(spark, market):
    """What is dealt by product has the rows of the common views, but those of no product."""
    for got, want in ((v.state_by_product, v.price_state), (v.offers_by_product, v.offers)):
        got, want = got(spark, market), want(spark, market).where("product_uid IS NOT NULL")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))


def test_documents_move_lines_once(spark, market):
    """Neither parts nor titles make the lines of an offer move again."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        titled = v.offers_by_product(spark, market).groupBy("product_uid", "title_normalized").agg(F.max("occurred_at"))
        stats = v.state_by_product(spark, market).groupBy("product_uid").agg(F.min("price_toman"))
        for frame, moves in ((titled, 3), (stats, 1)):  # lines, and the parts for either of their joins
            moved = [line for line in plan(frame).split("\n") if "Exchange hashpartitioning(" in line]
            assert len(moved) == moves
            assert sum("l_partkey" in line for line in moved) == 1
            assert not any("l_suppkey" in line or "title" in line for line in moved)
            assert "sha2" not in plan(frame).split("Exchange hashpartitioning(concat(p", 1)[1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_offers_meet_their_seller_in_stored_columns(spark, market):
    """Ids and texts of an offer are written after its joins, those of an event after its offer met."""
    sellers = spark.createDataFrame([(0, 0.5), (1, 0.25), (1, 0.75), (None, 0.0)], "supp_key long, trust_score double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = v.offers(spark, market, sellers)
        moved = [line for line in plan(got).split("\n") if "Exchange hashpartitioning(" in line]
        assert not any(name in line for line in moved for name in ("offer_uid", "seller_key", "part_key"))
        observed = trust.trust_observations(v.offer_lines(spark, market), offer=v.OFFER, describe=v.with_facts)
        assert "sha2" not in plan(observed).split("Exchange hashpartitioning(l_suppkey", 1)[1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    named = sellers.withColumn("seller_key", F.concat(F.lit("s"), "supp_key")).drop("supp_key")
    want = v.offers(spark, market).join(named, "seller_key").select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    for hot_rows in (10, 1_000_000):
        plain = trust.trust_observations(v.price_events(spark, market), hot_rows)
        lines = trust.trust_observations(v.offer_lines(spark, market), hot_rows, v.OFFER, v.with_facts)
        assert sorted(map(str, plain.collect())) == sorted(map(str, lines.collect()))


def test_stored_profiles_hold_what_is_read(spark, market):
    """Blocking writes no prices and no first offers."""
    assert q_matching.stored_profiles(spark, market).columns == ["profile", *matching.PROFILE_FIELDS]
    want = matching.profiles(q_matching.match_offers(spark, market)).select("profile", "median_price")
    got = q_matching.stored_profiles(spark, market, "median_price").select("profile", "median_price")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_codes_are_spelled_once(spark):
    pairs = spark.createDataFrame([("pn-1 0", "PN20", "x", "y"), ("b1", "a1", "x", None), ("b1", "B-1", "x", "y")], "code_a string, code_b string, brand_a string, brand_b string")
    out = fitment.crossref_pair_canonical(pairs, apply_nfkc=False)
    assert plan(out).count("upper(") == 2
    assert sorted(map(tuple, out.collect())) == [("A1", "B1", None, "x"), ("PN10", "PN20", "x", "y")]


def test_plain_text_takes_the_short_way(spark):
    odd = ["pn-1 0", "a^b`c", "x\ty\n", " A.b_C ", "", None, "پژو ۲۰۶", "AB\u200c12", "q~{}|\x7f"]
    df = spark.createDataFrame([(t,) for t in odd], "t string")
    long = F.regexp_replace(F.upper(text.normalize_text(F.col("t"), False)), "[^A-Z0-9]", "")
    fold = F.lower(F.regexp_replace(text.normalize_text(F.col("t"), False), text.ZWNJ, " "))
    fold = F.trim(F.regexp_replace(F.translate(fold, "ۀؤ", "هو"), "[^0-9a-zA-Z\u0600-\u06ff]+", " "))
    got = df.select(text.normalize_part_number(F.col("t"), False), text.match_fold(F.col("t"), False)).collect()
    assert list(map(tuple, got)) == list(map(tuple, df.select(long, fold).collect()))
    assert "CASE WHEN" in plan(df.select(text.match_fold(F.col("t"), False)))


def test_embedding_pairs_are_moved_without_vectors(spark):
    rows = [(i, [float((i * j) % 7 - 3) for j in range(1, 9)]) for i in range(60)]
    out = matching.block_embedding(spark.createDataFrame(rows, "id long, embedding array<double>"), 8, 0.5, tables=3, bits=2)
    assert out.count() == out.select("a", "b").distinct().count() > 0
    assert all("ea#" not in line for line in plan(out).splitlines() if "hashpartitioning(a#" in line or "keys=[a#" in line or "key=[a#" in line)


def test_features_are_counted_where_the_text_is_read(spark):
    texts = spark.createDataFrame([(1, "ab ab"), (1, "x"), (2, None)], "id long, t string")
    got = {r["id"]: r["embedding"] for r in search.hashed_counts(texts, "id", "t", 8).collect()}
    assert sorted(got) == [1, 2] and sum(map(abs, got[2])) == 1
    assert "regexp_extract_all" not in plan(search.hashed_counts(texts, "id", "t"))


def test_a_stream_has_files_as_its_source_has_splits(spark):
    source = spark.range(0, 4000, 1, 5)
    stream = q_streaming.stream_of(spark, source, "id BIGINT", "splits", source)
    seen = []
    out = q_streaming.scratch(spark, "seen")
    jobs.run_available(stream, lambda df, n: seen.append(df.select(F.input_file_name()).distinct().count()), out)
    assert seen == [5] * q_streaming.FILES


def test_state_lies_on_disk(spark):
    source = spark.range(0, 40, 1, 1).select(F.col("id").cast("string").alias("k"), F.col("id"))
    stream = q_streaming.stream_of(spark, source, "k STRING, id BIGINT", "kept", source)
    checkpoint = q_streaming.scratch(spark, "ck")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    jobs.run_available(stream.groupBy("k").agg(F.max("id").alias("id")), lambda df, n: df.count(), checkpoint, "update")
    kept = [p.suffix for p in Path(checkpoint.removeprefix("file:")).glob("state/**/*") if p.is_file()]
    assert ".zip" in kept and ".delta" not in kept
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
