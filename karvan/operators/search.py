"""Batch retrieval: a table of queries against a table of product documents."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from karvan.functions.text import let
from karvan.operators import graph, ivf
from karvan.operators.matching import cosine
from karvan.params import SearchParams
from karvan.session import cut_lineage


def crossref_closure(crossrefs: DataFrame) -> DataFrame:
    """(code, equivalent) for every two codes of one component, own code included.

    The pairs are the answer itself here: each document lists all its equivalents.
    """
    comp = graph.connected_components(crossrefs, "code_a", "code_b")
    left = comp.select(F.col("node").alias("code"), "component")
    right = comp.select(F.col("node").alias("equivalent"), "component")
    return left.join(right, "component").select("code", "equivalent")


def closed_part_numbers(codes: DataFrame, crossrefs: DataFrame) -> DataFrame:
    """(product_uid, code): a product's codes closed over cross references.

    Goes through component ids, so codes x component rather than codes x codes.
    """
    comp = graph.connected_components(crossrefs, "code_a", "code_b")
    mine = codes.join(comp.withColumnRenamed("node", "code"), "code", "left")
    components = mine.where("component IS NOT NULL").select("product_uid", "component").distinct()
    linked = components.join(comp, "component").select("product_uid", F.col("node").alias("code"))
    return mine.select("product_uid", "code").unionByName(linked).distinct()


def approved_synonyms(decisions: DataFrame) -> DataFrame:
    """(part_type, token) approved by the latest decision and still active."""
    latest = decisions.groupBy("part_type", "token").agg(
        F.max_by(F.struct("decision", "active"), "decided_at").alias("d")
    )
    return latest.where("d.active AND d.decision = 'approve' AND part_type <> '' AND token <> ''").select(
        "part_type", "token"
    )


def search_documents(
    products: DataFrame, offers: DataFrame, codes: DataFrame, synonyms: DataFrame
) -> DataFrame:
    """Index rows of published products.

    ``products``: product_uid, title, brand, part_type, ... ``offers``: product_uid,
    title_normalized, stock_status, trust_score, price_observed_at. Reduced per product
    before joining; variants are a product's distinct titles.
    """
    title = products.select("product_uid", "title")
    per_title = offers.groupBy("product_uid", "title_normalized").agg(
        F.max(F.when(F.col("stock_status") == "in_stock", F.unix_timestamp("price_observed_at"))).alias("fresh"),
        F.max("trust_score").alias("trust"),
    )
    variant = F.when(
        (F.col("title_normalized") != "") & (F.col("title_normalized") != F.col("title")), F.col("title_normalized")
    )
    facts = per_title.join(title, "product_uid").groupBy("product_uid").agg(
        F.array_sort(F.collect_set(variant)).alias("title_variants"),
        F.coalesce(F.max("fresh"), F.lit(0)).alias("price_freshness"),
        F.max("trust").alias("best_seller_trust"),
    )
    numbers = codes.groupBy("product_uid").agg(F.array_sort(F.collect_set("code")).alias("part_numbers"))
    words = synonyms.groupBy("part_type").agg(F.array_sort(F.collect_set("token")).alias("part_type_synonyms"))
    none = F.array().cast("array<string>")
    return (
        products.where("is_published")
        .join(facts, "product_uid", "left")
        .join(numbers, "product_uid", "left")
        .join(words, "part_type", "left")
        .withColumn("title_variants", F.coalesce("title_variants", none))
        .withColumn("part_numbers", F.coalesce("part_numbers", none))
        .withColumn("part_type_synonyms", F.coalesce("part_type_synonyms", none))
        .withColumn("best_seller_trust", F.coalesce("best_seller_trust", F.lit(0.0)))
        .withColumn("price_freshness", F.coalesce("price_freshness", F.lit(0)))
        .withColumn("has_image", F.col("image_url").isNotNull())
    )


def affected_documents(documents: DataFrame, changed_types: DataFrame, changed_codes: DataFrame) -> DataFrame:
    """Documents touched by a synonym change (part_type) or cross-reference change (code)."""
    by_type = documents.join(changed_types.select("part_type").distinct(), "part_type", "left_semi").select("product_uid")
    coded = documents.select("product_uid", F.explode("part_numbers").alias("code"))
    by_code = coded.join(changed_codes.select("code").distinct(), "code", "left_semi").select("product_uid")
    return by_type.unionByName(by_code).distinct()


def embedding_text(title: Column, variants: Column, brand: Column, part_type: Column) -> Column:
    parts = F.concat(F.array(title), variants, F.array(brand, part_type))
    return F.array_join(F.filter(parts, lambda x: F.coalesce(x, F.lit("")) != ""), " | ")


def embedding_reuse(documents: DataFrame, stored: DataFrame) -> DataFrame:
    """Keep the stored vector where the text hash is unchanged; flag the rest."""
    text = embedding_text(F.col("title"), F.col("title_variants"), F.col("brand"), F.col("part_type"))
    hashed = documents.withColumn("embedding_text", text).withColumn("text_hash", F.sha2("embedding_text", 256))
    old = stored.select("product_uid", F.col("text_hash").alias("__old"), "embedding")
    joined = hashed.join(old, "product_uid", "left")
    same = F.col("__old").eqNullSafe(F.col("text_hash"))
    return joined.withColumn("needs_embedding", ~same).withColumn(
        "embedding", F.when(same, F.col("embedding"))
    ).drop("__old")


#: Features whose place a task remembers.
KNOWN_FEATURES = 200_000


def hashed_counts(texts: DataFrame, key: str, text: str, dims: int = 384) -> DataFrame:
    """(key, embedding): words and character 4-grams in signed hash buckets, as whole numbers.

    Every different feature of a text is hashed once where the text is read, so a text never
    occupies more than ``dims`` rows past the scan. sha256 stands in for blake2b,
    which Spark lacks; the construction is the same.
    """
    clean = F.lower(F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", " ")))

    @F.pandas_udf("array<double>")
    def buckets(column: pd.Series) -> pd.Series:
        known: dict[str, tuple[int, int]] = {}  # of the features of one Arrow batch

        def place(feature: str) -> tuple[int, int]:
            digest = hashlib.sha256(feature.encode()).hexdigest()
            return int(digest[:8], 16) % dims, 1 if int(digest[9], 16) % 2 else -1

        def sums_of(t: str) -> list[float]:
            padded, sums = f"  {t}  ", [0.0] * dims
            counts = Counter(["c:" + padded[i : i + 4] for i in range(len(padded) - 3)])
            counts.update("w:" + w for w in t.split(" ") if w)
            for feature, n in counts.items():
                at = known.get(feature)
                if at is None:
                    at = place(feature)
                    if len(known) < KNOWN_FEATURES:
                        known[feature] = at
                sums[at[0]] += at[1] * n
            return sums

        return column.map(sums_of)

    features = texts.select(key, F.posexplode(buckets(clean)).alias("i", "x"))
    sums = features.groupBy(key, "i").agg(F.sum("x").alias("x"))
    # All places of a key are there, so their order alone makes the vector.
    packed = sums.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("p"))
    return packed.select(key, F.transform("p", lambda e: e["x"]).alias("embedding"))


def hashed_embedding(texts: DataFrame, key: str, text: str, dims: int = 384) -> DataFrame:
    """``hashed_counts`` scaled to unit length."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    unit = let(norm, lambda n: F.transform("embedding", lambda x: (x / F.greatest(n, F.lit(1e-12))).cast("float")))
    return hashed_counts(texts, key, text, dims).select(key, unit.alias("embedding"))


# -------------------------------------------------------------------------- channels


def passes_filters(vehicle: Column) -> Column:
    """Facet filters of the query row (null = not asked) on the document row."""
    ok = vehicle.isNull() | ~F.array_contains("vehicles_incompatible", vehicle)
    for name, column in (("f_brand", "brand"), ("f_part_type", "part_type"), ("f_authenticity", "authenticity_dominant")):
        ok = ok & (F.col(name).isNull() | F.coalesce(F.col(name) == F.col(column), F.lit(False)))
    price = F.col("min_price_toman")
    ok = ok & (F.col("f_min_price").isNull() | F.coalesce(price >= F.col("f_min_price"), F.lit(False)))
    ok = ok & (F.col("f_max_price").isNull() | F.coalesce(price <= F.col("f_max_price"), F.lit(False)))
    return ok & (F.col("f_has_image").isNull() | (F.col("f_has_image") == F.col("has_image")))


def passing_documents(queries: DataFrame, documents: DataFrame) -> DataFrame:
    """(query_id, passing): how many documents pass the filters of each search.

    Documents are counted by each set of the values that filters compare; every different
    combination of filters then meets the counts of its own set by equality (and by price, where
    it asks for one). Of the vehicles only those a search names are taken off again.
    """
    keys = ["f_brand", "f_part_type", "f_authenticity", "f_min_price", "f_max_price", "f_has_image"]
    values = ["brand", "part_type", "authenticity_dominant", "has_image", "min_price_toman"]
    signed = queries.withColumn("__sign", _sign(["vehicle_slug", *keys])).withColumn("__filters", _sign(keys))
    named = [F.col("f_brand").isNotNull(), F.col("f_part_type").isNotNull(), F.col("f_authenticity").isNotNull(), F.col("f_has_image").isNotNull()]
    named.append(F.col("f_min_price").isNotNull() | F.col("f_max_price").isNotNull())
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(named)), F.lit(0))
    filters = signed.select("__filters", *keys).dropDuplicates(["__filters"]).withColumn("__mask", mask)
    none = F.lit(None).cast("string")
    counted = documents.groupBy(*values).agg(F.count(F.lit(1)).alias("n"))
    shown = [F.when(F.col("__set").bitwiseAND(1 << i) > 0, F.col(c)).alias(c) for i, c in enumerate(values)]
    sets = filters.select(F.col("__mask").alias("__set")).distinct()  # 32 rows at most
    by_set = counted.join(F.broadcast(sets)).select("__set", *shown, "n").groupBy("__set", *values).agg(F.sum("n").alias("n"))
    equal = F.col("__mask") == F.col("__set")
    for f, c in zip(("f_brand", "f_part_type", "f_authenticity", "f_has_image"), values, strict=False):
        equal = equal & F.col(f).eqNullSafe(F.col(c))
    both = filters.join(by_set.withColumn("vehicles_incompatible", F.array().cast("array<string>")), equal)
    passing = both.where(passes_filters(none)).groupBy("__filters").agg(F.sum("n").alias("n"))
    slugs = signed.select("vehicle_slug").where("vehicle_slug IS NOT NULL").distinct()
    unfit = documents.select("product_uid", *values, F.explode(F.array_distinct("vehicles_incompatible")).alias("vehicle_slug")).join(slugs, "vehicle_slug")
    unfit = unfit.groupBy("vehicle_slug", *values).agg(F.count(F.lit(1)).alias("n")).withColumn("vehicles_incompatible", F.array().cast("array<string>"))
    different = signed.select("__sign", "vehicle_slug", "__filters", *keys).dropDuplicates(["__sign"])
    barred = different.join(unfit, "vehicle_slug").where(passes_filters(none)).groupBy("__sign").agg(F.sum("n").alias("barred"))
    left = F.col("n") - F.coalesce("barred", F.lit(0))
    per = different.select("__sign", "__filters").join(passing, "__filters").join(barred, "__sign", "left").select("__sign", left.alias("passing"))
    return signed.select("query_id", "__sign").join(per.where("passing > 0"), "__sign").select("query_id", "passing")


def exact_code_match(queries: DataFrame, documents: DataFrame) -> DataFrame:
    """(query_id, product_uid) where the whole query is one of the product's codes."""
    codes = documents.select("product_uid", F.explode("part_numbers").alias("code"))
    asked = queries.where("code IS NOT NULL").select("query_id", "code")
    return asked.join(codes, "code").select("query_id", "product_uid").distinct()


def inverted_index(documents: DataFrame, p: SearchParams = SearchParams()) -> DataFrame:
    """(token, product_uid, weight): the best weight of the fields holding the token."""
    fields = [
        (F.array("title"), p.title_weight), (F.col("title_variants"), p.variants_weight),
        (F.array("brand"), p.brand_weight), (F.col("part_type_synonyms"), p.synonyms_weight),
    ]

    def entries(values: Column, weight: int) -> Column:
        filled = F.filter(values, lambda v: v.isNotNull())
        words = F.flatten(F.transform(filled, lambda v: F.split(F.lower(v), " +")))
        return F.transform(
            F.filter(words, lambda w: w != ""), lambda w: F.struct(w.alias("token"), F.lit(weight).alias("weight"))
        )

    parts = [entries(values, weight) for values, weight in fields]
    rows = documents.select("product_uid", F.explode(F.concat(*parts)).alias("e")).select("product_uid", "e.*")
    return rows.groupBy("token", "product_uid").agg(F.max("weight").alias("weight"))


def _deletions(token: Column) -> Column:
    """The token and every form of it with one character left out."""
    cut = F.transform(
        F.sequence(F.lit(1), F.length(token)),
        lambda i: F.concat(F.substring(token, F.lit(1), i - 1), F.substring(token, i + 1, F.length(token))),
    )
    return F.array_distinct(F.concat(F.array(token), cut))


def typo_tokens(asked: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(asked, token) within edit distance 1, through shared one-deletion forms.

    Two words at distance one always share such a form, which turns the typo
    search into an equi-join; the distance is verified afterwards.
    """
    a = asked.select(F.col("token").alias("asked"), F.explode(_deletions(F.col("token"))).alias("form"))
    v = vocabulary.select("token", F.explode(_deletions(F.col("token"))).alias("form"))
    pairs = a.join(v, "form").select("asked", "token").distinct()
    return pairs.where(F.levenshtein("asked", "token") <= 1)


def match_texts(texts: DataFrame, index: DataFrame, min_token: int = 4) -> DataFrame:
    """(text, product_uid, lexical_score) of distinct lower-case texts; see ``lexical_match``.

    Only the postings of a text's rarest word are read; the products they name are then looked
    up in their own words (token -> weight), so a common word costs nothing beside a rare one.
    """
    words = texts.select("text", F.explode(F.array_distinct(F.filter(F.split("text", " +"), lambda w: w != ""))).alias("asked"))
    need = words.groupBy("text").agg(F.count(F.lit(1)).alias("need"))
    asked = words.select("asked").distinct()
    vocabulary = index.groupBy("token").agg(F.count(F.lit(1)).alias("products"))
    near = typo_tokens(asked.select(F.col("asked").alias("token")).where(F.length("asked") >= min_token), vocabulary.select("token"))
    exact = asked.join(vocabulary.select("token"), F.col("asked") == F.col("token"))
    forms = near.where("asked <> token").withColumn("factor", F.lit(0.5)).unionByName(exact.withColumn("factor", F.lit(1.0)))
    per_word = (
        forms.join(vocabulary, "token").groupBy("asked")
        .agg(F.collect_list(F.struct("token", "factor")).alias("forms"), F.sum("products").alias("products"))
    )
    plan = (
        words.join(per_word, "asked").groupBy("text")
        .agg(F.collect_list("forms").alias("wanted"), F.min_by("forms", F.struct("products", "asked")).alias("rarest"))
        .join(need, "text").where(F.size("wanted") == F.col("need")).select("text", "wanted", "rarest")
    )
    seeds = (
        plan.select("text", F.explode("rarest.token").alias("token")).join(index.select("token", "product_uid"), "token")
        .select("text", "product_uid").distinct()
    )
    own = index.groupBy("product_uid").agg(F.map_from_entries(F.collect_list(F.struct("token", "weight"))).alias("own"))
    weight = lambda f: F.coalesce(F.try_element_at("own", f["token"]), F.lit(0)) * f["factor"]
    scores = F.transform("wanted", lambda fs: F.array_max(F.transform(fs, weight)))
    found = seeds.join(plan.select("text", "wanted"), "text").join(own, "product_uid").withColumn("scores", scores)
    total = F.aggregate("scores", F.lit(0.0), lambda s, x: s + x)
    return found.where(F.array_min("scores") > 0).select("text", "product_uid", total.alias("lexical_score"))


def lexical_match(queries: DataFrame, index: DataFrame, min_token: int = 4) -> DataFrame:
    """(query_id, product_uid, lexical_score): every query word must match a field.

    Exact words count fully, one typo counts half and only for words of at least
    ``min_token`` characters. Every distinct text is matched once.
    """
    asked = queries.select("query_id", F.lower("text").alias("text"))
    matched = match_texts(asked.select("text").distinct(), index, min_token)
    return asked.join(matched, "text").select("query_id", "product_uid", "lexical_score")


#: Rows in a block of vectors; two blocks and their products fit a task.
KNN_BLOCK = 2_048


def vector_knn(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Exact top-k by cosine: (query_id, id, similarity, rank).

    The query rows and the vectors are dealt into blocks of bounded size and every block of
    queries meets every block of vectors in a task of its own, as one matrix product; only
    the best ``k`` of each query leave a task. Rows without a usable vector take no part.
    """
    usable = "embedding IS NOT NULL AND size(embedding) > 0"
    q = queries.where(usable).select("query_id", F.col("embedding").cast("array<double>").alias("v"), "exclude_id")
    x = vectors.where(usable).select("id", F.col("embedding").cast("array<double>").alias("v"))
    nq, nx = (max(1, -(-frame.count() // KNN_BLOCK)) for frame in (q, x))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = q.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(nq)).cast("int")).withColumn("xb", every(nx))
    right = x.withColumn("xb", F.pmod(F.xxhash64("id"), F.lit(nx)).cast("int")).withColumn("qb", every(nq))
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {vectors.schema['id'].dataType.simpleString()}, cosine double"

    def best_of(own: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        if own.empty or other.empty:
            return pd.DataFrame({"query_id": [], "id": [], "cosine": []})
        a, b = np.stack(own["v"].tolist()), np.stack(other["v"].tolist())
        with np.errstate(divide="ignore", invalid="ignore"):
            sims = (a / np.linalg.norm(a, axis=1)[:, None]) @ (b / np.linalg.norm(b, axis=1)[:, None]).T
        sims = np.where(own["exclude_id"].to_numpy()[:, None] == other["id"].to_numpy()[None, :], -np.inf, np.nan_to_num(sims, nan=-np.inf))
        edge = np.partition(sims, -k, axis=1)[:, -k] if sims.shape[1] > k else np.full(len(sims), -np.inf)
        # a little more than k: ties of the rounded similarity are broken by id later
        row, col = np.nonzero((sims >= edge[:, None] - 2e-6) & np.isfinite(sims))
        return pd.DataFrame({"query_id": own["query_id"].to_numpy()[row], "id": other["id"].to_numpy()[col], "cosine": sims[row, col]})

    scored = left.groupBy("qb", "xb").cogroup(right.groupBy("qb", "xb")).applyInPandas(best_of, schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    scored = scored.select("query_id", "id", F.round("cosine", 6).alias("similarity"))
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


# --------------------------------------------------------------------------- ranking


def business_score(now: Column, vehicle: Column) -> Column:
    fresh = F.col("price_freshness")
    age = F.greatest(F.lit(0.0), (F.unix_timestamp(now) - fresh) / 86400.0)
    fits = F.coalesce(F.array_contains("vehicles_compatible", vehicle), F.lit(False))
    return (
        F.least(F.log1p(F.greatest(F.lit(0), F.col("offer_count"))), F.lit(4.0)) * 0.025
        + F.col("has_image").cast("double") * 0.03
        + F.when(fresh > 0, F.exp(-age / 30.0)).otherwise(0.0) * 0.04
        + F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("best_seller_trust"))) * 0.06
        + F.when(fits, 0.45).otherwise(0.0)
    )


def rrf_fuse(lexical: DataFrame, vector: DataFrame, exact: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two ranked channels, exact hits left out."""
    both = lexical.select("query_id", "product_uid", "rank").unionByName(vector.select("query_id", "product_uid", "rank"))
    rest = both.join(exact.select("query_id", "product_uid"), ["query_id", "product_uid"], "left_anti")
    return rest.groupBy("query_id", "product_uid").agg(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("rrf"))


def fitment_marker(vehicle: Column) -> Column:
    return (
        F.when(vehicle.isNull() | (vehicle == ""), "not_requested")
        .when(F.array_contains("vehicles_compatible", vehicle), "fits")
        .when(F.array_contains("vehicles_incompatible", vehicle), "incompatible")
        .otherwise("unverified")
    )


#: Columns of a search that decide its result.
ASKED = ("text", "code", "vehicle_slug", "f_brand", "f_part_type", "f_authenticity", "f_min_price", "f_max_price", "f_has_image")
#: Columns of a document that filters look at.
FILTERED = ("brand", "part_type", "authenticity_dominant", "min_price_toman", "has_image", "vehicles_incompatible")


class Admitted:
    """``passes_filters`` over rows of an index piece, for many searches: each condition is looked at once."""

    EQUAL = {"f_brand": "brand", "f_part_type": "part_type", "f_authenticity": "authenticity_dominant", "f_has_image": "has_image"}

    def __init__(self, rows: pd.DataFrame):
        self.rows, self.known = rows, {}
        self.price = rows["min_price_toman"].to_numpy(float, na_value=np.nan)
        self.barred: dict[str, list[int]] = {}
        for i, slugs in enumerate(rows["vehicles_incompatible"]):
            for slug in () if slugs is None else set(slugs):
                self.barred.setdefault(slug, []).append(i)

    def _passing(self, name: str, value) -> np.ndarray:
        if (name, value) not in self.known:
            if name == "f_min_price":
                ok = self.price >= value
            elif name == "f_max_price":
                ok = self.price <= value
            else:
                ok = (self.rows[self.EQUAL[name]] == value).to_numpy(bool, na_value=False)
            self.known[name, value] = ok
        return self.known[name, value]

    def __call__(self, asked) -> np.ndarray:
        ok = np.ones(len(self.rows), bool)
        for name in (*self.EQUAL, "f_min_price", "f_max_price"):
            if not pd.isna(asked[name]):
                ok &= self._passing(name, asked[name])
        if not pd.isna(asked["vehicle"]):
            ok[self.barred.get(asked["vehicle"], [])] = False
        return ok


def admits(asked: pd.Series, rows: pd.DataFrame) -> np.ndarray:
    """``passes_filters`` of one search over rows of an index piece."""
    return Admitted(rows)(asked)


def product_index(documents: DataFrame, dims: int = 384) -> ivf.IvfIndex | None:
    """Index of the documents' embedding texts, with the columns that filters look at."""
    text = embedding_text(F.col("title"), F.col("title_variants"), F.col("brand"), F.col("part_type"))
    texts = documents.withColumn("__text", text)
    vectors = hashed_counts(texts.select("__text").distinct(), "__text", "__text", dims)
    rows = texts.join(vectors, "__text").select(F.col("product_uid").alias("id"), "embedding", *FILTERED)
    return ivf.build_index(rows)


def vector_channel(asked: DataFrame, index: ivf.IvfIndex | None, use_vehicle: bool, p: SearchParams = SearchParams(), exact: bool = True) -> DataFrame:
    """(query_id, product_uid, rank): the nearest products that pass a search's filters."""
    vectors = hashed_counts(asked.select("text").distinct(), "text", "text")
    vehicle = F.col("vehicle_slug") if use_vehicle else F.lit(None).cast("string")
    # searches of one text and filters ask once; at most one row of them is kept
    keys = [c for c in ASKED if c.startswith("f_")]
    signed = asked.withColumn("vehicle", vehicle).withColumn("__sign", _sign(["text", "vehicle", *keys]))
    distinct = signed.select(F.col("__sign").alias("query_id"), "text", "vehicle", *keys).dropDuplicates(["query_id"])
    found = ivf.search_index(index, distinct.join(vectors, "text").drop("text"), p.candidate_limit, exact=exact, prepared=Admitted)
    found = found.select(F.col("query_id").alias("__sign"), F.col("id").alias("product_uid"), "rank")
    return signed.select("query_id", "__sign").join(found, "__sign").select("query_id", "product_uid", "rank")


def _sign(columns: list[str]) -> Column:
    """One value for equal rows of columns; null differs from any value."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def distinct_searches(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row per different search with its sign as ``query_id``, ``query_id`` -> sign)."""
    signed = queries.withColumn("__sign", _sign(list(ASKED)))
    asked = signed.select(F.col("__sign").alias("query_id"), *ASKED).dropDuplicates(["query_id"])
    return asked, signed.select("query_id", "__sign")


def _ranked_lexical(matches: DataFrame, asked: DataFrame, documents: DataFrame, use_vehicle: bool, p: SearchParams) -> DataFrame:
    """Filter the lexical matches of the texts, then keep and number the best of each search."""
    vehicle = F.col("vehicle_slug") if use_vehicle else F.lit(None).cast("string")
    rows = matches.join(documents.select("product_uid", *FILTERED), "product_uid")
    filtered = asked.withColumn("__t", F.lower("text")).join(rows.withColumnRenamed("text", "__t"), "__t").where(passes_filters(vehicle))
    best = Window.partitionBy("query_id").orderBy(F.desc("lexical_score"), "product_uid")
    ranked = filtered.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= p.candidate_limit)
    return ranked.select("query_id", "product_uid", "rank")


def hybrid_search(
    queries: DataFrame, documents: DataFrame, lexical: DataFrame, index: ivf.IvfIndex | None, now: Column, p: SearchParams = SearchParams()
) -> DataFrame:
    """Exact block first, then fused channels; reruns without the vehicle filter where
    a query with a vehicle found fewer than ``result_floor``.

    ``lexical``: (text, product_uid, lexical_score) of the distinct texts. ``index``: the
    product vectors. Searches that ask the same are run once and joined back at the end.
    """
    asked, members = distinct_searches(queries)
    asked = cut_lineage(asked)
    exact = exact_code_match(asked, documents)

    def run(some: DataFrame, use_vehicle: bool) -> DataFrame:
        vehicle = F.col("vehicle_slug") if use_vehicle else F.lit(None).cast("string")
        hit = exact.join(some, "query_id").join(documents, "product_uid").where(passes_filters(vehicle))
        hit = hit.select("query_id", "product_uid").withColumn("rrf", F.lit(None).cast("double")).withColumn("is_exact", F.lit(True))
        lex = _ranked_lexical(lexical, some, documents, use_vehicle, p)
        vec = vector_channel(some, index, use_vehicle, p)
        return hit.unionByName(rrf_fuse(lex, vec, hit, p.rrf_k).withColumn("is_exact", F.lit(False)))

    first = cut_lineage(run(asked, True))
    found = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("found"))
    short = (
        asked.where("vehicle_slug IS NOT NULL").join(found, "query_id", "left")
        .where(F.coalesce("found", F.lit(0)) < p.result_floor).drop("found")
    )
    kept = first.join(short.select("query_id"), "query_id", "left_anti").withColumn("fallback_applied", F.lit(False))
    again = run(short, False).withColumn("fallback_applied", F.lit(True))
    rows = kept.unionByName(again).join(asked.select("query_id", "vehicle_slug"), "query_id").join(documents, "product_uid")
    business = business_score(now, F.col("vehicle_slug"))
    score = F.when(F.col("is_exact"), business).otherwise(F.col("rrf") + business)
    scored = rows.withColumn("score", F.round(score, 6))
    order = Window.partitionBy("query_id").orderBy(F.desc("is_exact"), F.desc("score"), "product_uid")
    placed = scored.withColumn("position", F.row_number().over(order)).withColumn("fitment_status", fitment_marker(F.col("vehicle_slug")))
    return members.join(placed.withColumnRenamed("query_id", "__sign"), "__sign").drop("__sign")


def facet_counts(hits: DataFrame) -> DataFrame:
    """(query_id, facet, value, count) over all hits of a query."""
    price = F.col("min_price_toman")
    bucket = F.when(price < 1_000_000, "under_1m").when(price < 5_000_000, "1m_to_5m").when(price.isNotNull(), "5m_and_over")
    pair = lambda name, value: F.struct(F.lit(name).alias("facet"), value.alias("value"))
    values = F.concat(
        F.transform("vehicles_compatible", lambda x: F.struct(F.lit("vehicles").alias("facet"), x.alias("value"))),
        F.array(
            pair("brands", F.col("brand")), pair("part_types", F.col("part_type")),
            pair("authenticity", F.col("authenticity_dominant")), pair("price_ranges", bucket),
        ),
    )
    rows = hits.select("query_id", F.explode(values).alias("f")).where("f.value IS NOT NULL AND f.value <> ''")
    return rows.groupBy("query_id", F.col("f.facet").alias("facet"), F.col("f.value").alias("value")).agg(
        F.count(F.lit(1)).alias("count")
    )


def suggestion_words(documents: DataFrame) -> DataFrame:
    """(product_uid, title, offer_count, w, weight): words of titles (8), codes (6) and variants (5)."""
    fields = F.concat(
        F.transform(F.split(F.lower("title"), " +"), lambda w: F.struct(w.alias("w"), F.lit(8).alias("weight"))),
        F.transform("part_numbers", lambda w: F.struct(F.lower(w).alias("w"), F.lit(6).alias("weight"))),
        F.transform(
            F.flatten(F.transform("title_variants", lambda t: F.split(F.lower(t), " +"))),
            lambda w: F.struct(w.alias("w"), F.lit(5).alias("weight")),
        ),
    )
    words = documents.select("product_uid", "title", "offer_count", F.explode(F.array_distinct(fields)).alias("f"))
    return words.where("f.w <> ''").select("product_uid", "title", "offer_count", "f.w", "f.weight")


def _best_of_prefix(hits: DataFrame, limit: int) -> DataFrame:
    """Products of every prefix, a product by its best word; the rank filter cuts before the shuffle."""
    best = Window.partitionBy("prefix").orderBy(F.desc("weight"), F.desc("offer_count"), "product_uid")
    one = hits.groupBy("prefix", "product_uid", "title", "offer_count").agg(F.max("weight").alias("weight"))
    return one.withColumn("position", F.row_number().over(best)).where(F.col("position") <= limit)


def prefix_table(words: DataFrame, limit: int = 10, longest: int = 12) -> DataFrame:
    """The best ``limit`` products of every prefix of up to ``longest`` characters."""
    lengths = F.sequence(F.lit(1), F.least(F.length("w"), F.lit(longest)))
    edges = words.withColumn("prefix", F.explode(F.transform(lengths, lambda n: F.substring("w", F.lit(1), n))))
    return _best_of_prefix(edges.drop("w"), limit)


def suggest(queries: DataFrame, words: DataFrame, table: DataFrame, limit: int = 10, longest: int = 12) -> DataFrame:
    """The best products for the prefix of every query.

    Every different prefix reads its rows of ``table`` (``prefix_table`` of the same ``limit`` and
    ``longest``) once. Longer prefixes look at the words that share their first ``longest``
    characters.
    """
    asked = queries.select("query_id", F.lower("prefix").alias("prefix")).where("prefix <> ''")
    different = asked.select("prefix").distinct()
    short = table.join(different.where(F.length("prefix") <= longest), "prefix")
    long = different.where(F.length("prefix") > longest).withColumn("__edge", F.substring("prefix", 1, longest))
    begun = words.where(F.length("w") > longest).withColumn("__edge", F.substring("w", 1, longest))
    hits = long.join(begun, "__edge").where(F.startswith(F.col("w"), F.col("prefix"))).drop("w", "__edge")
    return asked.join(short.unionByName(_best_of_prefix(hits, limit)), "prefix").drop("prefix")


# ------------------------------------------------------------------------- query log


def query_click_join(log: DataFrame, clicks: DataFrame) -> DataFrame:
    """First click of a query, valid only if that product stood at that position."""
    joined = log.join(clicks, "query_id").where(
        (F.col("position") >= 1)
        & F.coalesce(F.try_element_at("result_uids", F.col("position").cast("int")) == F.col("product_uid"), F.lit(False))
    )
    return joined.groupBy("query_id").agg(
        F.min_by(F.struct("position", "product_uid"), F.struct("clicked_at", "click_id")).alias("c")
    ).select("query_id", F.col("c.position").alias("clicked_position"), F.col("c.product_uid").alias("clicked_product_uid"))


def zero_result_report(log: DataFrame, now: Column, days: int = 7) -> DataFrame:
    recent = log.where((F.col("result_count") == 0) & (F.col("created_at") >= now - F.make_interval(days=F.lit(days))))
    return recent.groupBy("normalized_text", "vehicle_slug", "filters").agg(
        F.count(F.lit(1)).alias("query_count"), F.max("created_at").alias("last_seen")
    )


def search_quality(log: DataFrame) -> DataFrame:
    """Clicks, share of queries and mean clicked rank; a null click is no click."""
    return log.agg(
        F.count(F.lit(1)).alias("queries"),
        F.count("clicked_position").alias("clicked"),
        (F.count("clicked_position") / F.count(F.lit(1))).alias("ctr"),
        F.avg("clicked_position").alias("mean_clicked_rank"),
        (F.count_if(F.col("clicked_position") == 1) / F.count(F.lit(1))).alias("ctr_top"),
    )
