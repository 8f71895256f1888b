"""Entity resolution: offers to clusters.

Offers that agree on every field the rules look at form one *profile*; pairs are
formed between profiles only, and members of one profile are linked by a star. The
channels never emit pairs the rules reject outright (two known, different part
numbers, brands, grades or pack sizes), which is what keeps hot blocks linear.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from karvan.functions import ids
from karvan.functions.text import content_tokens
from karvan.operators import graph
from karvan.operators.pricing import median_half_up
from karvan.params import MatchParams
from karvan.session import cut_lineage

PROFILE_FIELDS = (
    "brand", "part_type", "part_number", "pack_quantity", "authenticity_claim", "title", "vehicle_group",
)
UNMAPPED = "unmapped"


def profiles(offers: DataFrame) -> DataFrame:
    """Distinct field combinations with member count, smallest member and price facts."""
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in PROFILE_FIELDS]
    keyed = offers.withColumn("profile", F.substring(F.sha2(F.concat_ws("\x1f", *fields), 256), 1, 32))
    priced = F.when(F.col("stock_status") == "in_stock", F.col("price_toman"))
    return keyed.groupBy("profile", *PROFILE_FIELDS).agg(
        F.count(F.lit(1)).alias("members"),
        F.min("offer_uid").alias("first_offer"),
        F.min(priced).alias("min_price"),
        F.max(priced).alias("max_price"),
        median_half_up(priced).alias("median_price"),
    )


def offer_profile(offers: DataFrame) -> DataFrame:
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in PROFILE_FIELDS]
    return offers.select(
        "offer_uid", F.substring(F.sha2(F.concat_ws("\x1f", *fields), 256), 1, 32).alias("profile")
    )


# -------------------------------------------------------------------------- blocking


def block_part_number(p: DataFrame) -> DataFrame:
    """Exact number, brand and pack: star edges. A brandless profile may join only
    when exactly one brand uses the number."""
    numbered = p.where("part_number IS NOT NULL")
    branded = numbered.where("brand IS NOT NULL")
    same = graph.star_edges(branded, ["part_number", "brand", "pack_quantity"], "profile")
    owner = (
        branded.groupBy("part_number", "pack_quantity")
        .agg(F.min("profile").alias("a"), F.min("brand").alias("lo"), F.max("brand").alias("hi"))
        .where("lo = hi")
    )
    lone = numbered.where("brand IS NULL")
    adopted = lone.join(owner, ["part_number", "pack_quantity"]).select(
        F.least("a", "profile").alias("a"), F.greatest("a", "profile").alias("b")
    )
    return same.withColumn("channel", F.lit("part_number")).unionByName(
        adopted.withColumn("channel", F.lit("part_number_no_brand"))
    )


def block_crossref(p: DataFrame, crossrefs: DataFrame) -> DataFrame:
    """Cross-referenced numbers of one brand, one pair per edge and brand.

    A hint for candidates only; the rules still see two different numbers.
    """
    heads = p.where("part_number IS NOT NULL AND brand IS NOT NULL").groupBy("part_number", "brand").agg(
        F.min("profile").alias("head")
    )
    left = heads.select(F.col("part_number").alias("code_a"), "brand", F.col("head").alias("ha"))
    right = heads.select(F.col("part_number").alias("code_b"), "brand", F.col("head").alias("hb"))
    return (
        crossrefs.select("code_a", "code_b")
        .join(left, "code_a")
        .join(right, ["code_b", "brand"])
        .select(F.least("ha", "hb").alias("a"), F.greatest("ha", "hb").alias("b"), F.lit("crossref").alias("channel"))
    )


def block_composite(p: DataFrame, threshold: float) -> DataFrame:
    """Same brand, part type and pack, same vehicle group (or one of them unmapped).

    Every pair the rules could still accept has at least one side without a part
    number and enough title words in common, so the side without a number is joined to
    the rest on the rare words of its title (prefix filter, exact for ``threshold``).
    """
    key = ["brand", "part_type", "pack_quantity"]
    usable = p.where("brand IS NOT NULL AND part_type IS NOT NULL")
    words = F.array_distinct(F.split(F.lower("title"), " +"))
    rows = usable.select(
        *key, "profile", "vehicle_group", "part_number", "authenticity_claim", F.filter(words, lambda w: w != "").alias("t")
    )
    exploded = rows.select("profile", F.explode("t").alias("tok"))
    weight = exploded.groupBy("tok").agg(F.count(F.lit(1)).alias("df"))
    ordered = exploded.join(weight, "tok").groupBy("profile").agg(
        F.array_sort(F.collect_list(F.struct("df", "tok"))).alias("s")
    )
    size = F.size("s")
    keep = size - F.ceil(F.lit(threshold) * size).cast("int") + 1
    ready = rows.drop("t").join(
        ordered.select(
            "profile", F.transform("s", lambda x: x["tok"]).alias("t"),
            F.explode(F.transform(F.slice("s", F.lit(1), keep), lambda x: x["tok"])).alias("tok"),
        ),
        "profile",
    )
    cols = ("profile", "vehicle_group", "part_number", "authenticity_claim", "t")
    bare = ready.where("part_number IS NULL").select(*key, "tok", *[F.col(c).alias(f"x_{c}") for c in cols])
    rest = ready.select(*key, "tok", *[F.col(c).alias(f"y_{c}") for c in cols])
    xg, yg = F.col("x_vehicle_group"), F.col("y_vehicle_group")
    xa, ya = F.col("x_authenticity_claim"), F.col("y_authenticity_claim")
    both = F.size(F.array_intersect("x_t", "y_t"))
    overlap = both / (F.size("x_t") + F.size("y_t") - both)
    once = F.col("y_part_number").isNotNull() | (F.col("x_profile") < F.col("y_profile"))
    return (
        bare.join(rest, [*key, "tok"])
        .where(once & (F.col("x_profile") != F.col("y_profile")))
        .where((xg == yg) | (xg == UNMAPPED) | (yg == UNMAPPED))
        .where((xa == ya) | (xa == "unknown") | (ya == "unknown"))
        .where(overlap >= threshold)
        .where(F.col("tok") == F.element_at(F.array_intersect("x_t", "y_t"), 1))
        .select(
            F.least("x_profile", "y_profile").alias("a"),
            F.greatest("x_profile", "y_profile").alias("b"),
            F.lit("composite").alias("channel"),
        )
    )


def trigrams(text: Column) -> Column:
    """Trigrams of each word padded with two blanks before and one after."""
    words = F.filter(F.split(F.lower(text), "[^0-9a-zÀ-ۿ]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.flatten(
        F.transform(
            padded,
            lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))),
        )
    )
    return F.array_distinct(grams)


def block_title_similarity(p: DataFrame, threshold: float) -> DataFrame:
    """Pairs of distinct titles of one brand with trigram similarity >= threshold."""
    titles = p.where("brand IS NOT NULL").select("brand", "title").distinct()
    sets = titles.withColumn("g", trigrams(F.col("title")))
    return graph.pairs_of_similar_sets(sets, ["brand"], "title", "g", threshold)


def cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


#: Vectors of a block and rows and columns of a matrix product.
VECTOR_BLOCK, TILE = 8_192, (512, 4_096)


def _sequential_dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row products, summed from the first component to the last as a fold does."""
    out = np.zeros(len(x))
    for i in range(x.shape[1]):
        out += x[:, i] * y[:, i]
    return out


def _near_pairs(x: np.ndarray, y: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of x, row of y, cosine) of all pairs that reach the threshold, a piece at a time.

    Products of single precision leave out what cannot reach it; the rest is taken in double precision.
    """
    slack = 1e-5 + 3e-7 * x.shape[1]
    lengths = [np.sqrt(_sequential_dots(v, v)) for v in (x, y)]
    short = [(v / n[:, None]).astype(np.float32) for v, n in zip((x, y), lengths, strict=True)]
    rows, columns = TILE
    for i in range(0, len(x), rows):
        for j in range(0, len(y), columns):
            maybe = short[0][i : i + rows] @ short[1][j : j + columns].T >= threshold - slack
            at = np.flatnonzero(maybe)
            for cut in range(0, len(at), 1 << 18):
                r, c = np.divmod(at[cut : cut + (1 << 18)], maybe.shape[1])
                r, c = r + i, c + j
                p, q = x[r], y[c]
                cosines = _sequential_dots(p, q) / np.sqrt(_sequential_dots(p, p) * _sequential_dots(q, q))
                good = cosines >= threshold
                yield r[good], c[good], cosines[good]


def _packed_vectors(vectors: DataFrame) -> DataFrame:
    """Blocks of bounded size: ``block, ids, sizes, data``, the components of all its vectors in a row.

    Vectors with a direction take part: finite components, not all zero. Rows of one id share a block.
    """
    v = F.col("embedding")
    whole = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    squares = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    good = vectors.where(F.col("id").isNotNull() & v.isNotNull() & whole & (squares > 0)).select("id", "embedding")
    n = good.count()
    blocks = max(1, -(-n // VECTOR_BLOCK), min(16, -(-n // 1024)))
    kind = good.schema["id"].dataType.simpleString()
    single = good.schema["embedding"].dataType.elementType.simpleString() == "float"

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        lists = rows["embedding"].combine_chunks()
        numbers = lists.flatten().to_numpy(zero_copy_only=False)
        data = numbers.astype("<f4" if single else "<f8").tobytes()
        sizes = lists.value_lengths().to_pylist()
        block = rows["block"][0].as_py()
        columns = [[block], [rows["id"].to_pylist()], [sizes], [data]]
        types = [pa.int32(), pa.list_(rows.schema.field("id").type), pa.list_(pa.int32()), pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["block", "ids", "sizes", "data"])

    dealt = good.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).repartition(blocks, "block")
    packed = dealt.groupBy("block").applyInArrow(pack, f"block int, ids array<{kind}>, sizes array<int>, data binary")
    return cut_lineage(packed).coalesce(min(blocks, max(24, -(-blocks // 8))))


def block_embedding(
    vectors: DataFrame, dims: int, threshold: float, tables: int = 12, bits: int = 10, seed: int = 7
) -> DataFrame:
    """Auxiliary channel: every two ids whose vectors have a cosine of ``threshold`` or more.

    Exact: blocks of vectors meet as matrix products, each pair of blocks in one place, and only
    pairs that reach the threshold leave a task. Nothing but the vectors is exchanged, once; the
    blocks are written once and read by each task. Equal vectors are pairs as well. Work grows with
    the square of the vectors, memory does not. ``vectors``: id, embedding; those of different
    lengths do not meet. ``dims``, ``tables``, ``bits`` and ``seed`` shaped the former hashing, which
    left pairs out; nothing depends on them.
    """
    packed = _packed_vectors(vectors)
    single = vectors.schema["embedding"].dataType.elementType.simpleString() == "float"
    kind = vectors.schema["id"].dataType.simpleString()

    def by_size(ids: pa.ListScalar, sizes: pa.ListScalar, data: pa.BinaryScalar) -> dict[int, tuple[pa.Array, np.ndarray]]:
        size = sizes.values.to_numpy(zero_copy_only=False).astype(np.int64)
        numbers = np.frombuffer(data.as_py(), "<f4" if single else "<f8").astype(np.float64)
        starts = np.cumsum(size) - size
        own = {}
        for length in np.unique(size).tolist():
            at = np.flatnonzero(size == length)
            own[length] = ids.values.take(pa.array(at)), numbers[starts[at][:, None] + np.arange(length)]
        return own

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x = by_size(*[batch.column(k)[i] for k in ("ids_x", "sizes_x", "data_x")])
                y = by_size(*[batch.column(k)[i] for k in ("ids_y", "sizes_y", "data_y")])
                same_block = batch.column("block_x")[i] == batch.column("block_y")[i]
                again = any(pc.count_distinct(pa.concat_arrays([own for own, _ in side.values()])).as_py() < sum(len(own) for own, _ in side.values()) for side in (x, y))
                held = []
                for length in x.keys() & y.keys():
                    (ids_x, of_x), (ids_y, of_y) = x[length], y[length]
                    for r, c, cosines in _near_pairs(of_x, of_y, threshold):
                        if same_block:  # both orders of a pair are met
                            r, c, cosines = (z[r != c] for z in (r, c, cosines))
                        a, b = ids_x.take(pa.array(r)), ids_y.take(pa.array(c))
                        ahead = pc.less(a, b)
                        if same_block:
                            out = pa.RecordBatch.from_arrays([a, b, pa.array(cosines)], ["a", "b", "cosine"]).filter(ahead)
                        else:
                            out = pa.RecordBatch.from_arrays([pc.if_else(ahead, a, b), pc.if_else(ahead, b, a), pa.array(cosines)], ["a", "b", "cosine"])
                        if again:
                            held.append(out)
                        elif out.num_rows:
                            yield out
                if held:  # an id has several rows: the nearest two of a pair of ids stand for it
                    yield from pa.Table.from_batches(held).group_by(["a", "b"]).aggregate([("cosine", "max")]).rename_columns({"cosine_max": "cosine"}).select(["a", "b", "cosine"]).to_batches()

    left = packed.select(*[F.col(c).alias(f"{c}_x") for c in packed.columns])
    right = packed.select(*[F.col(c).alias(f"{c}_y") for c in packed.columns]).hint("shuffle_replicate_nl")
    met = left.join(right, F.col("block_x") <= F.col("block_y"))
    return met.mapInArrow(meet, f"a {kind}, b {kind}, cosine double")


def candidate_union(*channels: DataFrame) -> DataFrame:
    """Union of the channels; each pair once with the sorted list of its channels."""
    out = channels[0].select("a", "b", "channel")
    for c in channels[1:]:
        out = out.unionByName(c.select("a", "b", "channel"))
    return out.groupBy("a", "b").agg(F.array_sort(F.collect_set("channel")).alias("channels"))


# --------------------------------------------------------------------------- scoring


def _jaccard(x: Column, y: Column) -> Column:
    both = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(
        both / F.size(F.array_union(x, y))
    )


def pair_features(pairs: DataFrame, p: DataFrame, crossrefs: DataFrame) -> DataFrame:
    """Everything the ladder looks at, side by side."""
    cols = [*PROFILE_FIELDS, "median_price"]
    # Content words are taken once per profile, not once per pair.
    worded = p.withColumn("content", F.array_distinct(content_tokens(F.col("title"))))
    left = worded.select(F.col("profile").alias("a"), F.col("content").alias("__ca"), *[F.col(c).alias(f"a_{c}") for c in cols])
    right = worded.select(F.col("profile").alias("b"), F.col("content").alias("__cb"), *[F.col(c).alias(f"b_{c}") for c in cols])
    linked = crossrefs.select(
        F.least("code_a", "code_b").alias("__lo"), F.greatest("code_a", "code_b").alias("__hi")
    ).distinct().withColumn("__x", F.lit(True))
    rows = (
        pairs.join(left, "a").join(right, "b")
        .withColumn("__lo", F.least("a_part_number", "b_part_number"))
        .withColumn("__hi", F.greatest("a_part_number", "b_part_number"))
        .join(linked, ["__lo", "__hi"], "left")
    )
    pa, pb = F.col("a_part_number"), F.col("b_part_number")
    number = (
        F.when(pa.isNull() | pb.isNull(), "none").when(pa == pb, "exact")
        .when(F.col("__x"), "crossref").otherwise("differ")
    )
    words = lambda c: F.array_distinct(F.split(F.lower(c), " +"))
    ta, tb = F.lower("a_title"), F.lower("b_title")
    longest = F.greatest(F.length(ta), F.length(tb), F.lit(1))
    group = lambda c: F.when(F.col(c) == UNMAPPED, F.array().cast("array<string>")).otherwise(F.split(c, ","))
    claims = [F.col(f"{s}_authenticity_claim") for s in "ab"]
    return rows.select(
        *pairs.columns,
        *[F.col(f"{s}_{c}") for s in "ab" for c in cols],
        number.alias("number_match"),
        _jaccard(words("a_title"), words("b_title")).alias("title_jaccard"),
        _jaccard(F.col("__ca"), F.col("__cb")).alias("content_jaccard"),
        (1 - F.levenshtein(ta, tb) / longest).alias("char_similarity"),
        F.col("a_brand").eqNullSafe(F.col("b_brand")).alias("brand_match"),
        F.col("a_part_type").eqNullSafe(F.col("b_part_type")).alias("type_match"),
        (F.col("a_pack_quantity") == F.col("b_pack_quantity")).alias("pack_match"),
        ((claims[0] == claims[1]) | (claims[0] == "unknown") | (claims[1] == "unknown")).alias("grade_match"),
        _jaccard(group("a_vehicle_group"), group("b_vehicle_group")).alias("fitment_jaccard"),
        F.abs(F.log((F.col("a_median_price") + 1.0) / (F.col("b_median_price") + 1.0))).alias("price_log_ratio"),
    )


def pair_rule_judge(overlap_of: str = "title_jaccard") -> Column:
    """struct(is_same, confidence, rule) over the columns of ``pair_features``.

    ``overlap_of`` names the share of common words: of all words, or of content words.
    """
    known = lambda c: F.col(f"a_{c}").isNotNull() & F.col(f"b_{c}").isNotNull()
    overlap = F.col(overlap_of)
    vehicles = (F.col("a_vehicle_group") != UNMAPPED) & (F.col("b_vehicle_group") != UNMAPPED)
    ladder = [
        (known("brand") & ~F.col("brand_match"), False, F.lit(0.95), "brand"),
        (~F.col("grade_match"), False, F.lit(0.9), "grade"),
        (~F.col("pack_match"), False, F.lit(0.88), "pack"),
        (F.col("number_match") == "exact", True, F.lit(0.95), "number_equal"),
        (F.col("number_match") != "none", False, F.lit(0.9), "number_differs"),
        (vehicles & (F.col("fitment_jaccard") == 0) & (overlap < 0.75), False, F.lit(0.7), "vehicles"),
        (
            F.col("a_part_type").isNotNull() & F.col("type_match") & (overlap >= 0.6),
            True, F.bround(F.least(F.lit(0.6) + overlap / 3, F.lit(0.85)), 2), "same_type",
        ),
        (F.lit(True), False, F.bround(F.greatest(F.lit(0.55), F.lit(0.9) - overlap), 2), "no_evidence"),
    ]
    out = None
    for test, same, confidence, rule in ladder:
        value = F.struct(F.lit(same).alias("is_same"), confidence.alias("confidence"), F.lit(rule).alias("rule"))
        out = F.when(test, value) if out is None else out.when(test, value)
    return out


def pair_score() -> Column:
    """Weighted features in [0, 1]; the weights are ours, none are published."""
    price = F.when(F.col("price_log_ratio").isNull(), 0.5).otherwise(F.exp(-F.col("price_log_ratio")))
    return F.bround(
        F.lit(0.40) * F.col("title_jaccard")
        + F.lit(0.15) * F.col("char_similarity")
        + F.lit(0.15) * F.col("type_match").cast("double")
        + F.lit(0.10) * F.col("grade_match").cast("double")
        + F.lit(0.10) * F.col("fitment_jaccard")
        + F.lit(0.10) * price,
        6,
    )


def decision_ladder(features: DataFrame, p: MatchParams = MatchParams()) -> DataFrame:
    """merge / reject / review per pair, with the step that decided."""
    # Written once: the ladder refers to the features many times, and Catalyst would
    # otherwise copy each feature's whole expression into every reference.
    stored = cut_lineage(features)
    judged = stored.withColumn("score", pair_score()).withColumn("judge", pair_rule_judge("content_jaccard"))
    exact = (F.col("number_match") == "exact") & F.col("pack_match")
    one_brand_missing = F.col("a_brand").isNull() != F.col("b_brand").isNull()
    wall = F.col("a_brand").isNotNull() & F.col("b_brand").isNotNull() & ~F.col("brand_match")
    sure = F.col("judge.confidence") >= p.judge_confidence
    step = (
        F.when(wall, "brand_wall")
        .when(exact & F.col("brand_match") & F.col("a_brand").isNotNull(), "exact")
        .when(one_brand_missing & ~exact, "no_brand")
        .when(F.col("number_match") == "differ", "number_differs")
        .when(F.col("score") >= p.high, "high")
        .when(one_brand_missing & exact & (F.col("judge.confidence") >= p.null_brand_high), "exact_no_brand")
        .when(F.col("score") <= p.low, "low")
        .when(sure & F.col("judge.is_same"), "judge_same")
        .when(sure, "judge_different")
        .otherwise("review")
    )
    decision = (
        F.when(F.col("step").isin("exact", "high", "judge_same", "exact_no_brand"), "merge")
        .when(F.col("step") == "review", F.when(F.col("judge.is_same"), "provisional").otherwise("review"))
        .otherwise("reject")
    )
    return judged.withColumn("step", step).withColumn("decision", decision)


def brand_wall_violations(members: DataFrame) -> DataFrame:
    """Clusters holding two brands: must be empty. ``members``: cluster_uid, brand."""
    span = members.where("brand IS NOT NULL").groupBy("cluster_uid").agg(
        F.min("brand").alias("brand_a"), F.max("brand").alias("brand_b")
    )
    return span.where("brand_a <> brand_b")


def price_circuit_breaker(
    components: DataFrame, p: DataFrame, params: MatchParams = MatchParams()
) -> DataFrame:
    """Components whose in-stock price range exceeds the factor times the median.

    ``components``: node (profile), component. The median is over member offers'
    profile medians weighted by members.
    """
    rows = components.join(p.select(F.col("profile").alias("node"), "min_price", "max_price", "median_price", "members"), "node")
    facts = rows.groupBy("component").agg(
        F.min("min_price").alias("low"),
        F.max("max_price").alias("high"),
        F.floor(F.percentile("median_price", 0.5, F.when(F.col("median_price").isNotNull(), F.col("members")).otherwise(0)) + 0.5).alias("median"),
        F.count(F.lit(1)).alias("profiles"),
    )
    span = F.col("high") - F.col("low")
    return facts.withColumn("tripped", (F.col("profiles") > 1) & F.coalesce(span > params.price_range_factor * F.col("median"), F.lit(False)))


def human_decision_overlay(decisions: DataFrame) -> DataFrame:
    """Latest verdict per pair as must-link / cannot-link, replayed after everything."""
    pair = decisions.withColumn("a", F.least("offer_uid_a", "offer_uid_b")).withColumn(
        "b", F.greatest("offer_uid_a", "offer_uid_b")
    )
    latest = pair.where("decision IN ('same', 'different')").groupBy("a", "b").agg(
        F.max_by("decision", F.struct("decided_at", "decision")).alias("verdict")
    )
    return latest.withColumn("must_link", F.col("verdict") == "same")


def apply_overlay(edges: DataFrame, overlay: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, cannot_link): human "same" adds an edge above every score, "different"
    removes the pair's edge and forbids it."""
    walls = overlay.where("NOT must_link").select("a", "b")
    links = overlay.where("must_link").select("a", "b", F.lit(2.0).alias("score"))
    kept = edges.select("a", "b", "score").join(overlay.select("a", "b"), ["a", "b"], "left_anti")
    return kept.unionByName(links), walls


# -------------------------------------------------------------------------- clusters


def stable_cluster_uid(new: DataFrame, old: DataFrame) -> DataFrame:
    """Keep each cluster's uid across runs.

    ``new``: component, offer_uid. ``old``: cluster_uid, offer_uid. An old uid goes to
    the component holding most of its members; a component takes the old uid it
    overlaps most; a component without one gets a deterministic v4-shaped uid.
    """
    overlap = new.join(old, "offer_uid").groupBy("component", "cluster_uid").agg(F.count(F.lit(1)).alias("n"))
    home = overlap.groupBy("cluster_uid").agg(
        F.min_by("component", F.struct((-F.col("n")).alias("n"), "component")).alias("component"),
        F.max("n").alias("n"),
    )
    kept = home.groupBy("component").agg(
        F.min_by("cluster_uid", F.struct((-F.col("n")).alias("n"), "cluster_uid")).alias("kept_uid")
    )
    first = new.groupBy("component").agg(F.min("offer_uid").alias("first_member"))
    return first.join(kept, "component", "left").select(
        "component",
        F.coalesce("kept_uid", ids.uuid4_from(F.col("first_member"))).alias("cluster_uid"),
        F.col("kept_uid").isNull().alias("is_new"),
    )


def cluster_lineage(new: DataFrame, old: DataFrame, uids: DataFrame) -> DataFrame:
    """Successor of every old uid that did not survive: where most members went."""
    named = new.join(uids.select("component", F.col("cluster_uid").alias("new_uid")), "component")
    moved = named.join(old, "offer_uid").groupBy("cluster_uid", "new_uid").agg(F.count(F.lit(1)).alias("n"))
    best = moved.groupBy("cluster_uid").agg(
        F.min_by("new_uid", F.struct((-F.col("n")).alias("n"), "new_uid")).alias("successor_uid")
    )
    survivors = uids.select("cluster_uid")
    return (
        old.select("cluster_uid").distinct()
        .join(survivors, "cluster_uid", "left_anti")
        .join(best, "cluster_uid", "left")
    )


def cluster_change_events(new: DataFrame, old: DataFrame) -> DataFrame:
    """One event per cluster that changed, none when nothing did.

    ``new`` and ``old``: cluster_uid, offer_uid. Reasons in order of precedence:
    retired, merged, split, created, member_added, member_removed.
    """
    n = new.select(F.col("cluster_uid").alias("new_uid"), "offer_uid")
    o = old.select(F.col("cluster_uid").alias("old_uid"), "offer_uid")
    moves = n.join(o, "offer_uid", "full_outer")
    flows = moves.groupBy("new_uid", "old_uid").agg(F.count(F.lit(1)).alias("n"))
    sources = flows.where("new_uid IS NOT NULL").groupBy("new_uid").agg(
        F.count("old_uid").alias("sources"),
        F.sum(F.when(F.col("old_uid").isNull(), F.col("n")).otherwise(0)).alias("fresh"),
        F.max((F.col("old_uid") == F.col("new_uid")).cast("int")).alias("kept"),
        F.array_sort(F.collect_set(F.when(F.col("old_uid") != F.col("new_uid"), F.col("old_uid")))).alias("predecessors"),
    )
    targets = flows.where("old_uid IS NOT NULL").groupBy("old_uid").agg(
        F.count("new_uid").alias("targets"),
        F.sum(F.when(F.col("new_uid").isNull(), F.col("n")).otherwise(0)).alias("lost"),
    )
    split_kin = flows.where("new_uid IS NOT NULL AND old_uid IS NOT NULL").join(targets.where("targets > 1"), "old_uid")
    from_split = split_kin.select("new_uid").distinct().withColumn("split", F.lit(True))
    gone = targets.join(sources.select(F.col("new_uid").alias("old_uid")), "old_uid", "left_anti")
    reason = (
        F.when(F.col("sources") > 1, "merged")
        .when(F.col("split"), "split")
        .when(F.col("sources") == 0, "created")
        .when(F.col("fresh") > 0, "member_added")
        .when(F.col("lost") > 0, "member_removed")
    )
    alive = (
        sources.join(from_split, "new_uid", "left")
        .join(targets.withColumnRenamed("old_uid", "new_uid"), "new_uid", "left")
        .withColumn("reason", reason)
        .where("reason IS NOT NULL")
        .select(F.col("new_uid").alias("cluster_uid"), "reason", "predecessors")
    )
    retired = gone.select(
        F.col("old_uid").alias("cluster_uid"), F.lit("retired").alias("reason"),
        F.array().cast("array<string>").alias("predecessors"),
    )
    return alive.unionByName(retired)


def singleton_ratio(members: DataFrame) -> DataFrame:
    """Share of active offers alone in their cluster, and the average size."""
    sizes = members.groupBy("cluster_uid").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.sum("n").alias("offers"),
        F.count(F.lit(1)).alias("clusters"),
        (F.count_if(F.col("n") == 1) / F.sum("n")).alias("singleton_ratio"),
        F.avg("n").alias("average_size"),
    )


def review_priority(requests: DataFrame, click_counts: DataFrame, offer_counts: DataFrame) -> DataFrame:
    """Clicks decide; without any, the number of offers."""
    return (
        requests.join(click_counts.select("product_uid", "clicks"), "product_uid", "left")
        .join(offer_counts.select("product_uid", "offer_count"), "product_uid", "left")
        .withColumn("priority", F.coalesce("clicks", "offer_count", F.lit(0)))
        .drop("clicks", "offer_count")
    )


def golden_labels(decisions: DataFrame, strata: int = 10) -> DataFrame:
    """Latest human label per pair, with a stable stratum for exports."""
    overlay = human_decision_overlay(decisions)
    return overlay.select(
        "a", "b", F.col("must_link").alias("is_same"),
        F.pmod(F.xxhash64("a", "b"), F.lit(strata)).alias("stratum"),
    )


def predicted_same(pairs: DataFrame, placed: DataFrame, components: DataFrame) -> DataFrame:
    """Those of ``(a, b)`` offers that the matcher puts into one cluster.

    ``placed``: (offer_uid, profile) from ``offer_profile``; ``components``: (node, component) of
    the accepted edges between profiles. Offers of one profile are one cluster from the start;
    an offer without a profile is in none.
    """
    cluster = placed.join(components, F.col("profile") == F.col("node"), "left").select(
        "offer_uid", F.coalesce("component", "profile").alias("cluster")
    )
    a = cluster.select(F.col("offer_uid").alias("a"), F.col("cluster").alias("__a"))
    b = cluster.select(F.col("offer_uid").alias("b"), F.col("cluster").alias("__b"))
    return pairs.select("a", "b").join(a, "a").join(b, "b").where(F.col("__a") == F.col("__b")).select("a", "b")


def match_evaluate(golden: DataFrame, predicted: DataFrame, gate: float = 0.95) -> DataFrame:
    """Precision, recall, F1 of predicted pairs against golden ones."""
    joined = golden.join(predicted.select("a", "b", F.lit(True).alias("p")), ["a", "b"], "left")
    p = F.coalesce("p", F.lit(False))
    counts = joined.agg(
        F.count_if(F.col("is_same") & p).alias("tp"),
        F.count_if(~F.col("is_same") & p).alias("fp"),
        F.count_if(F.col("is_same") & ~p).alias("fn"),
    )
    precision = F.try_divide("tp", F.col("tp") + F.col("fp"))
    recall = F.try_divide("tp", F.col("tp") + F.col("fn"))
    return (
        counts.withColumn("precision", precision)
        .withColumn("recall", recall)
        .withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
        .withColumn("passes_gate", F.coalesce(F.col("precision") >= gate, F.lit(False)))
    )

